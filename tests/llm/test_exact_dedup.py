import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rulespark.llm import exact_dedup


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    out = []
    for i, t in rows:
        ids = groups[lower(t)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits, room", [(64, exact_dedup.WORDS), (None, exact_dedup.WORDS), (None, 1)])  # a full filter flags every row and stays exact
def test_groups(spark, docs, odd, bits, room):
    for df in (docs, odd):
        got = sorted([tuple(r) for r in exact_dedup.exact_groups(df, bits=bits, room=room).collect()], key=str)
        assert got == brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


def test_empty(spark, empty):
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.drop_copies(empty).count() == 0


@pytest.mark.parametrize("bits, room", [(64, exact_dedup.WORDS), (None, exact_dedup.WORDS), (None, 1)])
def test_one_row_of_each_text_stays(spark, odd, bits, room):
    got = exact_dedup.drop_copies(odd, bits=bits, room=room)
    assert got.columns == odd.columns
    rows = [(r.doc_id, lower(r.text)) for r in got.collect()]
    assert sorted(t for _, t in rows) == sorted({lower(r.text) for r in odd.collect()})
    assert (99, "a b c") in rows


@pytest.mark.parametrize("n", [2_000, 20_000, 200_000])
@pytest.mark.parametrize("room", [exact_dedup.WORDS, 10])
def test_filter_flags_few_unique_rows_at_any_size(spark, n, room):
    """A third of the rows is one text, a tenth is pairs: all are flagged, and under 5 % of the others."""
    text = "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 10 = 1 THEN concat('pair', id div 20) ELSE concat('own', id) END AS text"
    rows = spark.range(n).selectExpr("id AS doc_id", text)
    keyed = rows.select("doc_id", "text", exact_dedup.text_sha(F.col("text")).alias("sha")).cache()
    bits = exact_dedup.filter_bits(n)
    assert 16 * n <= max(bits, 1 << 16) <= max(32 * n, 1 << 16)
    words = exact_dedup.repeated_filter(keyed, "sha", bits).cache()
    flagged = exact_dedup.flag_repeated(keyed, "sha", "again", words, bits, room=room)
    assert flagged.columns == [*keyed.columns, "again"]
    counts = keyed.groupBy("sha").count()
    single, wrong, missed = flagged.join(counts, "sha").selectExpr(
        "count_if(count = 1)", "count_if(count = 1 AND again)", "count_if(count > 1 AND NOT again)"
    ).first()
    assert flagged.count() == n and missed == 0 and wrong < 0.05 * single


def test_main_path_has_no_python(spark, docs):
    plan = exact_dedup.exact_groups(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
