import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from rulespark.llm import lexical

TERM = re.compile(lexical.TERM)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k=10):
    counts = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    n_docs = sum(1 for _, c in counts if c)
    total = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for item, terms in asked.items():
        found = []
        for doc_id, c in counts:
            n = sum(c.values())
            score = 0
            for t in terms & c.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * (1000000000 * c[t] // (1000 * c[t] + 8 * (10 + 90 * n * n_docs // total)))
            if score > 0:
                found.append((-score, doc_id is not None, doc_id or 0, doc_id))
        found.sort()
        out += [(item, rank + 1, f[3], -f[0]) for rank, f in enumerate(found[:k])]
    return sorted(out, key=repr)


def answer(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_given_tables(spark, sf_dir, docs):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.collect()])
    assert answer(lexical.search(docs, items)) == want


ITEMS = [(1, "one WORD a"), (1, "word b"), (2, None), (3, ""), (None, "a x"), (4, "é É ß"), (5, "nowhere to be found"), (6, "don't stop 12345"), (7, "\U0001f600 word")]


def test_odd_rows(spark, odd):
    items = spark.createDataFrame([(*i, 1) for i in ITEMS], "item_id long, text string, score int")
    want = brute([tuple(r) for r in odd.select("doc_id", "text").collect()], ITEMS)
    assert answer(lexical.search(odd, items)) == want


def test_empty_tables(spark, odd, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(empty, items).count() == 0
    assert lexical.search(odd, items.limit(0)).count() == 0
    assert lexical.search(odd.where("text is null"), items).count() == 0


def test_chunks_of_items_and_small_blocks_change_nothing(spark, docs, sf_dir, monkeypatch):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    whole = answer(lexical.search(docs, items, k=3))
    monkeypatch.setattr(lexical, "CHUNK_BYTES", 4000)
    assert answer(lexical.search(docs, items, k=3)) == whole


@pytest.mark.parametrize("seed", range(4))
def test_tree_equals_scoring_everything_and_prunes(seed):
    rng = np.random.default_rng(seed)
    dims, rows = 200, 3000
    topic = rng.integers(0, 10, rows)
    ids = [np.unique(np.concatenate([t * 20 + rng.integers(0, 20, 12), rng.integers(0, dims, 2)])) for t in topic]
    tfs = [rng.integers(1, 6, len(i)) for i in ids]
    ns = rng.integers(20, 400, rows)
    ptr = np.concatenate(([0], np.cumsum([len(i) for i in ids])))
    flat, many = np.concatenate(ids), np.concatenate(tfs)
    weights = rng.integers(0, 9000, dims).tolist()
    items = [sorted(set((t * 20 + rng.integers(0, 20, 8)).tolist())) for t in range(10)] + [[0], [199], list(range(dims))]
    dfs = np.bincount(flat, minlength=dims).tolist()
    index = lexical.Index(items, dfs, rows, int(ns.sum()), 10, weights)
    best = [lexical.Best(10) for _ in items]
    doc_ids = rng.permutation(rows).tolist()
    scored = index.search_block(doc_ids, ns, ptr, flat, many, best)
    m = 10 + (90 * ns * rows) // int(ns.sum())
    for item, terms in enumerate(items):
        want = []
        for r in range(rows):
            score = sum(weights[t] * (10**9 * int(f) // (1000 * int(f) + 8 * int(m[r]))) for t, f in zip(ids[r], tfs[r]) if t in terms)
            if score > 0:
                want.append((-score, doc_ids[r]))
        assert sorted((-s, d) for s, d in best[item].rows()) == sorted(want)[:10]
    assert scored < 0.5 * rows * len(items)


def test_bounds_hold_for_every_row_below():
    rng = random.Random(3)
    ids = [np.array(sorted(rng.sample(range(50), rng.randint(1, 20)))) for _ in range(400)]
    x = lexical.Rows(np.concatenate(([0], np.cumsum([len(i) for i in ids]))), np.concatenate(ids), np.concatenate([np.array([rng.random() * 1e6 for _ in i]) for i in ids]))
    q = x.take(np.arange(0, 400, 40))
    space = lexical.Space(q, 50, lexical.term_groups(np.bincount(x.idx, minlength=50), most=20))
    dense = np.zeros((10, 50))
    for i in range(10):
        dense[i, q.idx[q.ptr[i] : q.ptr[i + 1]]] = q.val[q.ptr[i] : q.ptr[i + 1]]

    def walk(ball):
        exact = np.array([x.take(ball.rows).dot(d).max() for d in dense])
        assert (ball.bounds >= exact).all()
        assert not ball.kids or sorted(np.concatenate([k.rows for k in ball.kids])) == sorted(ball.rows)
        for kid in ball.kids:
            walk(kid)

    walk(lexical.ball_tree(x, np.arange(400), space))


def test_ties_go_to_the_smaller_id(spark):
    docs = spark.createDataFrame([(i, "alpha beta") for i in range(40, 0, -1)] + [(99, "gamma")] * 60, "doc_id long, text string").repartition(5)
    items = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert [r["doc_id"] for r in lexical.search(docs, items).orderBy("rank").collect()] == list(range(1, 11))
