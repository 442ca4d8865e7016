import time
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rulespark.llm import language, queries
from rulespark.llm.common import remainder

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return language.Vocabulary(MODEL)


def segmentations(s, vocabulary):
    """All ways to write s in pieces; a letter without a piece is its bytes."""
    if not s:
        yield []
    for n in range(1, min(vocabulary.longest, len(s)) + 1):
        piece = vocabulary.piece.get(s[:n])
        ids = [piece] if piece is not None else [vocabulary.byte[b] for b in s[0].encode()] if n == 1 else None
        if ids:
            for rest in segmentations(s[n:], vocabulary):
                yield ids + rest


def test_forward_sums_all_segmentations(vocabulary):
    table = np.log(np.random.default_rng(0).dirichlet(np.ones(vocabulary.size), 3).T)
    words = ["the", "straße", "nö", "a", "日本語", "𐐀x", "queue"]
    got = language.log_probabilities(words, vocabulary, table)
    for w, row in zip(words, got):
        want = np.logaddexp.reduce([table[ids].sum(0) for ids in segmentations(language.START + w, vocabulary)])
        assert np.allclose(row, want)


def test_expected_counts(vocabulary):
    table = np.log(np.random.default_rng(1).dirichlet(np.ones(vocabulary.size), 2).T)
    words, lang, times = ["the", "the", "no日"], np.array([0, 1, 1]), np.array([3, 1, 2])
    got = language.expected_counts(words, lang, times, vocabulary, table)
    want = np.zeros(table.shape)
    for w, l, n in zip(words, lang, times):
        ways = list(segmentations(language.START + w, vocabulary))
        weight = np.exp([table[ids, l].sum() for ids in ways])
        for ids, p in zip(ways, weight / weight.sum()):
            np.add.at(want, (ids, l), n * p)
    assert np.allclose(got, want)


def test_long_word(vocabulary):
    table = np.full((vocabulary.size, 2), -np.log(vocabulary.size))
    assert np.isfinite(language.log_probabilities(["x" * 5000], vocabulary, table)).all()


def test_expected_counts_of_long_words(vocabulary, monkeypatch):
    table = np.log(np.random.default_rng(2).dirichlet(np.full(vocabulary.size, 0.3), 2).T + 1e-10)
    words, lang, times = ["queue日" * 40, "𐐀x" * 60, "the"], np.array([0, 1, 1]), np.array([3, 1, 2])
    want = language.expected_counts(words, lang, times, vocabulary, table)
    monkeypatch.setattr(language, "LONG", 2)
    got = language.expected_counts(words, lang, times, vocabulary, table)
    assert np.allclose(got, want, rtol=1e-8, atol=1e-9)


def log_domain(words, vocabulary, table):
    """The same sums over logs, word by word."""
    out = []
    for w in words:
        unknown = {}
        ids = vocabulary.edges([w], unknown)
        full = vocabulary.with_unknown(table, unknown)
        out.append(language.forward(lambda j, l: full[ids[:, j - 1, l - 1]], ids.shape[1], ids.shape[2])[-1][0])
    return np.array(out)


def test_scaled_sums_equal_sums_of_logs(vocabulary):
    table = np.log(np.random.default_rng(5).dirichlet(np.full(vocabulary.size, 0.2), 3).T + 1e-12)
    words = ["x" * n for n in (1, 2, 40, 254, 255, 256, 257, 900)] + ["日本" * 60, "𐐀" * 130, "ß" * 300, "the", "queue" * 70, "𐐀日x" * 100]
    assert np.allclose(language.log_probabilities(words, vocabulary, table), log_domain(words, vocabulary, table), rtol=1e-9)


def test_long_words_in_stretches_and_a_million_letters(vocabulary):
    table = np.log(np.random.default_rng(6).dirichlet(np.ones(vocabulary.size), 2).T)
    word = "".join(np.random.default_rng(7).choice(list("abcdeétu日"), 700))
    assert np.allclose(language._one_long_word(word, vocabulary, table, step=13), log_domain([word], vocabulary, table)[0], rtol=1e-9)
    start = time.perf_counter()
    assert np.isfinite(language.log_probabilities(["abcdefghij" * 100_000], vocabulary, table)).all()
    assert time.perf_counter() - start < 60


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = queries.op5(spark, sf_dir)
    rows = got.join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 150
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_held_out_languages_are_not_read(spark, docs):
    changed = docs.withColumn("lang", F.when(remainder("doc_id", 4) == 2, F.lit("xx")).otherwise(F.col("lang")))
    assert "xx" not in language.train(language.training_rows(changed), MODEL).languages


def test_odd_rows(spark, odd, empty):
    model = language.train(odd, MODEL)
    got = {(r.doc_id, r.text): r for r in language.identify(odd, model).collect()}
    assert model.languages == ["en"]
    for (_, text), r in got.items():
        assert r.lang_pred == ("en" if text and any(map(str.isalpha, text)) else "und"), repr(text)[:50]
    nothing = language.train(empty, MODEL)
    assert {r.lang_pred for r in language.identify(odd, nothing).collect()} == {"und"}
    assert language.identify(empty, model).count() == 0
