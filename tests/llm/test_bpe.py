import base64
import hashlib
import random

import public_tokenizers
import tiktoken

from rulespark.llm import bpe, queries

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def check(df):
    rows = bpe.encode(df, RANKS, public_tokenizers.PATTERN, decoded=True).collect()
    got = sorted(((r.doc_id, list(r.ids), bytes(r.bytes)) for r in rows), key=str)
    want = sorted(((r.doc_id, REFERENCE.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in df.select("doc_id", "text").collect()), key=str)
    assert got == want


def test_documents_as_tiktoken(spark, docs):
    check(docs)


def test_odd_rows(spark, odd, empty):
    check(odd)
    assert bpe.encode(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_small_chunks(spark, odd, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 10)  # tasks get the value with the pickled function
    check(odd.coalesce(1))


def test_random_unicode(spark):
    rng = random.Random(3)
    alphabet = [chr(c) for c in [*range(32, 127), 9, 10, 13, 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x3000, 0xE9, 0x660, 0xBD, 0x2167, 0x4E2D, 0x1F600, 0x301, 0x5D0, 0x1C, 0x1F, 0x200B]]
    rows = [(i, "".join(rng.choices(alphabet, k=rng.randint(0, 200)))) for i in range(400)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_long_words_merge_alike():
    rng = random.Random(4)
    for _ in range(60):
        word = bytes(rng.choices(b"abehtinos ", k=rng.randint(2, 120)))
        assert bpe._merge_long(word, RANKS) == REFERENCE._encode_single_piece(word) == (bpe.merge_word(word, RANKS) if word not in RANKS else [RANKS[word]])


def test_digests_and_decoding(spark, docs, sf_dir):
    got = {r.doc_id: r for r in queries.op7(spark, sf_dir).collect()}
    for r in docs.collect():
        ids = REFERENCE.encode_ordinary(r.text or "")
        d = got[r.doc_id]
        assert d.n_tokens == len(ids)
        assert d.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert d.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_decoding_of_no_ids(spark):
    df = spark.createDataFrame([(1, []), (2, None), (3, [0])], "doc_id long, ids array<int>")
    got = {r.doc_id: bytes(r.bytes) for r in bpe.decode(df, RANKS).collect()}
    assert got == {1: b"", 2: b"", 3: REFERENCE.decode_single_token_bytes(0)}


def test_ranks_survive_coding():
    import numpy as np

    rng = np.random.default_rng(0)
    for top in (1, 191, 192, 193, 14_527, 14_528, 14_529, 473_279, 473_280, 473_281, 5_000_000, 2**31):
        ranks = np.concatenate([[0, top - 1, top], rng.integers(0, top + 1, 500)])
        assert (bpe._expand_ranks(bpe._squeeze_ranks(ranks)) == ranks).all()
    assert len(bpe._expand_ranks(bpe._squeeze_ranks(np.empty(0, np.int64)))) == 0


def test_sequences_are_not_shuffled(spark, docs):
    plan = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2, plan  # words to their buckets, ids to their chunks
