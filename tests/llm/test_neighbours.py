import numpy as np
import pytest
from pyspark.sql import functions as F

from rulespark.llm import neighbours, queries


def brute(rows, asks, k=10):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    out = {}
    for q in np.flatnonzero(asks):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[i]), float(d[i])) for i in order]
    return out


def grouped(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def recall(got, want):
    return sum(len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


def test_recall_on_embeddings(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = brute(rows, [i % 100 == 0 for i, _ in rows])
    got = grouped(queries.op9(spark, sf_dir))
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    exact = {i: np.array(v, np.float64) for i, v in rows}
    assert all(s == pytest.approx(np.linalg.norm(exact[q] - exact[i]), abs=1e-12) for q, v in got.items() for i, s in v)
    assert recall(got, want) >= 0.9


def clustered(n, clusters, dim, seed=11):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim)) * 3
    return (centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, dim))).astype(np.float32)


def recall_of(spark, path, x):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"vec_id": pa.array(np.arange(len(x))), "embedding": pa.array(list(x), pa.list_(pa.float32()))}), path, row_group_size=5_000)
    got = grouped(neighbours.search(spark.read.parquet(path), "vec_id", "embedding", F.col("vec_id") % 100 == 0))
    exact, hits, total = x.astype(np.float64), 0, 0
    for q in range(0, len(x), 100):
        d = ((exact - exact[q]) ** 2).sum(1)
        d[q] = np.inf
        want = set(np.argpartition(d, 10)[:10].tolist())
        hits, total = hits + len(want & {i for i, _ in got[q]}), total + 10
    return hits / total


def test_one_outlier_does_not_flatten_the_rest(spark, tmp_path):
    x = clustered(3_000, 6, 32)
    x[7] = 1e9
    assert recall_of(spark, str(tmp_path / "v.parquet"), x) >= 0.9


def test_recall_on_a_large_clustered_table(spark, tmp_path):
    assert recall_of(spark, str(tmp_path / "v.parquet"), clustered(100_000, 200, 32)) >= 0.9


@pytest.mark.parametrize("shift", [0.0, 1000.0])
def test_vectors_without_clusters_are_all_found(spark, tmp_path, shift):
    """Random directions have no near neighbours for a graph to lead to."""
    x = (np.random.default_rng(5).normal(size=(8_000, 64)) + shift).astype(np.float32)
    assert recall_of(spark, str(tmp_path / "v.parquet"), x) == 1.0


def test_check_finds_what_no_edge_leads_to(spark, monkeypatch):
    """A graph with one edge: the rest comes from the check, ties to smaller ids, also for repeated ids and copies."""
    rng = np.random.default_rng(9)
    rows = [(i, rng.integers(0, 3, 6).astype(float).tolist()) for i in range(1, 600)] + [(5, [1.0] * 6), (5, [2.0] * 6)]
    rows = [r for r in rows if any(r[1])]
    monkeypatch.setattr(neighbours, "build", lambda nodes: spark.createDataFrame([(1, 2, 1.0)], "v long, u long, d float"))
    monkeypatch.setattr(neighbours, "PACK", 50)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = grouped(neighbours.search(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0))
    want = brute(rows, [i % 20 == 0 for i, _ in rows])
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_search_goes_on_while_a_node_is_open(spark, monkeypatch):
    """The graph is a path that leads to the nearest vectors only at its far end."""
    rows = [(0, [1.0, 0.0])] + [(i, [1.0, 30.0 - i]) for i in range(1, 21)]
    monkeypatch.setattr(neighbours, "build", lambda nodes: spark.createDataFrame([(i, i + 1, 1.0) for i in range(20)], "v long, u long, d float"))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = grouped(neighbours.search(df, "vec_id", "embedding", F.col("vec_id") == 0))
    assert [i for i, _ in got[0]] == list(range(20, 10, -1))


def test_small_table_is_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=5).astype(np.float32).tolist()) for i in range(8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = grouped(neighbours.search(df, "vec_id", "embedding", F.lit(True)))
    want = brute(rows, [True] * 8)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_copies_ties_and_invalid_rows(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(i, same) for i in range(400)] + [(1000 + i, [1.0, 2.0, 3.0 + i + 1]) for i in range(20)]
    bad = [(2000, None), (2001, [0.0, 0.0, 0.0]), (2002, [1.0, None, 2.0]), (2003, [float("nan"), 1.0, 1.0]), (2004, [float("inf"), 1.0, 1.0]), (None, same), (2005, [])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + bad], "vec_id long, embedding array<float>, q string, node int").repartition(5)
    got = grouped(neighbours.search(df, "vec_id", "embedding", F.col("vec_id").isin(300, 1000, 2000, 2001, 2003)))
    assert set(got) == {300, 1000}
    assert [i for i, _ in got[300]] == list(range(10)) and {s for _, s in got[300]} == {0.0}
    want = brute(rows, [i in (300, 1000) for i, _ in rows])
    assert got == want


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.search(df, "vec_id", "embedding", F.lit(True)).count() == 0
