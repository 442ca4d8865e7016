import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rulespark.llm import simhash
from rulespark.llm.graph import components


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    if not shingles:
        return 0
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows):
    """(id, fp) rows -> smallest id reachable for each row, by comparing all pairs."""
    fps = sorted({f for _, f in rows})
    u = np.array(fps, np.uint64)
    root = list(range(len(u)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[i] ^ u) <= 3):
            root[max(find(i), find(int(j)))] = min(find(i), find(int(j)))
    place = {f: find(i) for i, f in enumerate(fps)}
    least = {}
    for i, f in rows:
        if i is not None:
            least[place[f]] = min(i, least.get(place[f], i))
    return [(i, f, least.get(place[f])) for i, f in rows]


def unsigned(rows):
    return [(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in rows]


def order(rows):
    return sorted(rows, key=str)


def test_documents_against_all_pairs(spark, docs):
    got = unsigned(simhash.near_duplicates(docs).collect())
    want = brute_groups([(r.doc_id, brute_fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()])
    assert order(got) == order(want)
    assert len({c for _, _, c in got}) < len(got)


def test_odd_rows(spark, odd, empty):
    got = unsigned(simhash.near_duplicates(odd).collect())
    want = brute_groups([(r.doc_id, brute_fingerprint(r.text)) for r in odd.select("doc_id", "text").collect()])
    assert order(got) == order(want)
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.one_per_group(empty).count() == 0


@pytest.mark.parametrize("n_parts", [2, 3, 4])
def test_links_are_complete_for_every_partitioning(spark, n_parts):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**63), 2**63, 60)
    near = [b ^ np.int64(sum(1 << int(i) for i in rng.choice(62, k, replace=False))) for b in base for k in (1, 2, 3, 4, 5)]
    hub = [np.int64(7) ^ np.int64((1 << i) | (1 << j)) for i in range(12) for j in range(i, 12)]  # dense: all share most bits
    fps = sorted({int(x) for x in [*base, *near, *hub, 0, -1]})
    classes = spark.createDataFrame([(f, 0) for f in fps], "fp long, least long")
    got = {(r.a, r.b) for r in simhash.links(classes, n_parts).collect()}
    want = {(a, b) for a in fps for b in fps if a > b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert got == want and len(want) > 500


def test_thresholds_sum_to_the_pigeonhole_bound_and_are_the_cheapest():
    rng = np.random.default_rng(1)
    cost = np.cumsum(rng.random((3, 5, 40)), axis=1)
    cost[:, 0] = 0
    got = simhash.allocate(cost)
    assert (got.sum(0) == 3 - 3 + 1).all()
    for r in range(40):
        best = min(cost[0, a, r] + cost[1, b, r] + cost[2, c, r] for a in range(5) for b in range(5) for c in range(5) if a + b + c == 4)
        assert np.isclose(sum(cost[i, got[i, r] + 1, r] for i in range(3)), best)


def test_block_counts_are_exact(spark):
    fps = np.random.default_rng(2).integers(-(2**63), 2**63, 300)
    classes = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    counts = simhash.block_counts(classes, list(range(64)))
    value = (int(fps[0]) >> 48) & 0xFFFF
    blocks = [(int(f) >> 48) & 0xFFFF for f in fps]
    for d in range(4):
        assert counts[0, d, value] == sum((b ^ value).bit_count() == d for b in blocks)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i + 1, i) for i in range(200)] + [(1000 + i, 999) for i in range(1, 50)] + [(5000, 4000)]
    got = {r.fp: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 999: 999, **{1000 + i: 999 for i in range(1, 50)}, 5000: 4000, 4000: 4000}


def test_one_document_of_each_group_stays(spark, odd):
    groups = simhash.near_duplicates(odd).where(F.col("doc_id").isNotNull()).select("root").distinct().count()
    got = simhash.one_per_group(odd)
    assert got.columns == odd.columns
    assert got.count() == groups
    assert got.where("text = 'one'").count() == 1
