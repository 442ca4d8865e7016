from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from rulespark.llm import mixing


def brute_targets(sizes):
    """{source: size} -> {source: target}, in exact fractions."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = Fraction(3, 2) * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        weights = sum(weight[s] for s in names if s not in full)
        share = {s: left * weight[s] / weights for s in names if s not in full} if weights else {}
        above = {s for s, t in share.items() if t > 2 * sizes[s]}
        if not above:
            return {s: Fraction(2 * sizes[s]) if s in full else share[s] for s in names}
        full |= above


def check(df):
    rows = df.select("doc_id", "source", "text").collect()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").encode().split())
    want = brute_targets(sizes)
    got = mixing.mix(df.withColumn("size", mixing.n_words(F.col("text")))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.size == len((r.text or "").encode().split()) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(float(want[r.source]))
        assert r.copies in (0, 1, 2) and r.taken == r.copies * r.size
    return got, want


def test_documents(spark, docs):
    got, want = check(docs)
    for source, target in want.items():
        own = [r for r in got if r.source == source]
        rate = float(target) / own[0].source_size
        assert abs(sum(r.copies for r in own) - rate * len(own)) < 1 + 1e-6  # systematic: within one copy of the expected
        assert abs(sum(r.taken for r in own) - float(target)) <= 2 * max(r.size for r in own)


def test_odd_rows_and_reruns(spark, odd):
    got, _ = check(odd)
    again = mixing.mix(odd.repartition(7).withColumn("size", mixing.n_words(F.col("text")))).collect()
    key = lambda rows: sorted((str(r.doc_id), str(r.text), str(r.source), r.copies) for r in rows)
    assert key(got) == key(again)
    assert mixing.emit(mixing.mix(odd.withColumn("size", mixing.n_words(F.col("text"))))).count() == sum(r.copies for r in got)


def test_empty(spark, empty):
    assert mixing.mix(empty.withColumn("size", F.lit(1))).count() == 0


def test_wordless_table(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, None, None)], "doc_id long, source string, size long")
    assert [(r.copies, r.target) for r in mixing.mix(df).collect()] == [(0, 0.0), (0, 0.0)]
