"""The pipeline against plain Python, stage by stage."""

import hashlib

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from rulespark.llm import queries, toxicity
from tests.llm.test_mixing import brute_targets
from tests.llm.test_simhash import brute_fingerprint, brute_groups

lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def rows_of(df):
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


def brute_toxic(docs, model):
    hashes = toxicity.WordHashes()
    return [d for d in docs if toxicity.score_text(d[1], *model, hashes) < 0.5]


def brute_exact(docs):
    best = {}
    for d in docs:
        k = lower(d[1])
        if k not in best or d[0] > best[k][0]:
            best[k] = d
    return list(best.values())


def brute_near(docs):
    groups = brute_groups([(d[0], brute_fingerprint(d[1])) for d in docs])
    return [d for d, (i, _, component) in zip(docs, groups) if i == component]


def brute_mix(docs):
    size = lambda t: len((t or "").encode().split())
    total = {}
    for _, t, s in docs:
        total[s] = total.get(s, 0) + size(t)
    targets = brute_targets(total)
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    out = []
    for s, target in targets.items():
        own = [d for d in docs if d[2] == s]
        band = lambda n: (len(f"{n:b}"), n >> max(len(f"{n:b}") - 4, 0))
        own.sort(key=lambda d: (band(size(d[1])), md5(str(d[0])), d[0], size(d[1])))
        rate = round(float(target) / total[s] * 2**24) if total[s] else 0
        at = int(md5(f"offset:{s if s is not None else 'null'}")[:6], 16)
        for d in own:
            out += [d] * (((at + rate) >> 24) - (at >> 24))
            at += rate
    return out


def brute_tokens(docs):
    ranks = queries.tokenizer()
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    out = []
    for i, t, _ in docs:
        ids = reference.encode_ordinary(t or "")
        out.append((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    return out


def test_stages_against_plain_python(spark, sf_dir, docs):
    now, want = docs, rows_of(docs)
    model = toxicity.train(docs, toxicity.training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    brute = [lambda d: brute_toxic(d, model), brute_exact, brute_near, brute_mix]
    for (name, stage), plain in zip(corpus_pipeline.STAGES, brute):
        now = stage(spark, now, sf_dir).cache()
        want = plain(want)
        assert now.columns == docs.columns, name
        assert sorted(rows_of(now), key=str) == sorted(want, key=str), name
    got = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir)
    assert sorted(map(tuple, got.collect())) == sorted(brute_tokens(want))
    run = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, run.collect())) == sorted(brute_tokens(want))


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_stages_on_odd_rows(spark, request, kind, sf_dir):
    now = request.getfixturevalue(kind)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf_dir).cache()
        assert now.columns == request.getfixturevalue(kind).columns, name
    tokens = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir)
    assert tokens.count() == now.count()
    if kind == "empty":
        assert now.count() == 0


def test_shape():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "mix_sources", "byte_bpe"]
    assert corpus_pipeline.ORACLE_SQL is None
