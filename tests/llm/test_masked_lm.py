import zlib
from collections import Counter

import numpy as np

from rulespark.llm import masked_lm


def net():
    rng = np.random.default_rng(2)
    return masked_lm.Network.from_flat(rng.normal(0, 0.3, masked_lm.Network.size()).astype(np.float32))


def brute(model, ids):
    """Plain loops over tokens."""
    total = 0.0
    for t, y in enumerate(ids):
        h = model.bias.astype(float).copy()
        places = [*range(-masked_lm.WINDOW, 0), *range(1, masked_lm.WINDOW + 1)]
        for k, step in enumerate(places):
            at = t + step
            h += model.embed[k][ids[at] if 0 <= at < len(ids) else masked_lm.PAD]
        h = np.tanh(h)
        c, w = divmod(int(y), masked_lm.PER_CLASS)
        for logits, pick in ((model.group @ h + model.group_bias, c), (model.word[c] @ h + model.word_bias[c], w)):
            total += logits[pick] - np.log(np.exp(logits).sum())
    return total


def test_scores_against_plain_loops(spark, docs, odd):
    model = net()
    for df in (docs.limit(20), odd):
        coded = masked_lm.numbers(df, masked_lm.vocabulary(docs), "doc_id", "text").where("n < 3000").cache()
        for r in masked_lm.score(coded, model).collect():
            ids = np.frombuffer(r.numbers, np.uint16).astype(int)
            assert len(ids) == r.n
            assert np.isclose(r.log_likelihood, brute(model, ids), rtol=1e-4, atol=1e-3)


def test_pieces_of_a_long_text_see_beyond_their_ends(spark, monkeypatch):
    model = net()
    df = spark.createDataFrame([(1, "a b c d " * 200)], "doc_id long, text string")
    coded = masked_lm.numbers(df, {t: 100 + i for i, t in enumerate("abcd")}, "doc_id", "text").cache()
    whole = masked_lm.score(coded, model).first().log_likelihood
    monkeypatch.setattr(masked_lm, "PIECE", 7)
    assert np.isclose(masked_lm.score(coded, model).first().log_likelihood, whole, rtol=1e-5)


def test_windows_of_some_positions():
    ids = np.arange(40)
    at = np.array([0, 1, 2, 17, 37, 39])
    assert (masked_lm.windows(ids, at) == masked_lm.windows(ids)[at]).all()
    assert (masked_lm.windows(ids)[0] == [masked_lm.PAD] * 3 + [1, 2, 3]).all()


def test_gradients_lower_the_loss():
    rng = np.random.default_rng(0)
    ids = np.tile(rng.integers(0, masked_lm.VOCABULARY, 12), 300)
    trainer = masked_lm.Trainer(masked_lm.Network.fresh())
    x = masked_lm.windows(ids)
    before = masked_lm.log_probabilities(trainer.net, x, ids).mean()
    for _ in range(5):
        trainer.learn(x, ids)
    assert masked_lm.log_probabilities(trainer.net, x, ids).mean() > before + 2


def test_training_beats_word_frequencies(spark):
    """Real text must be likelier than the same tokens in random order, and than an untrained network says."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    coded = masked_lm.numbers(docs, masked_lm.vocabulary(docs), "doc_id", "text").cache()
    model = masked_lm.train(coded)
    fresh = masked_lm.Network.from_flat(masked_lm.Network.fresh())
    per = lambda m: masked_lm.score(coded, m).selectExpr("sum(log_likelihood) / sum(n)").first()[0]
    assert per(model) > per(fresh) + 1.5


def test_vocabulary_counts_all_texts(spark, docs):
    got = masked_lm.vocabulary(docs)
    assert len(got) <= masked_lm.VOCABULARY - masked_lm.RARE and min(got.values()) == masked_lm.RARE
    want = Counter(t for r in docs.collect() for t in masked_lm.tokens_of(r.text))
    top = sorted(want, key=lambda t: (-want[t], t.encode()))[: len(got)]
    assert sorted(got, key=got.get) == top


def test_rare_tokens_are_told_apart_by_their_counts(spark, monkeypatch):
    """With few numbered tokens: shares of a number add up to one, follow the counts, and their table grows with the corpus."""
    monkeypatch.setattr(masked_lm, "VOCABULARY", masked_lm.RARE + 3)
    sizes = []
    for kinds in (50, 2000):
        texts = [(i, f"the of and the of and w{i % kinds} w{(i * i) % kinds} common") for i in range(4 * kinds)]
        counts = masked_lm.token_counts(masked_lm.chunks(spark.createDataFrame(texts, "doc_id long, text string"))).cache()
        want = Counter(t for _, text in texts for t in masked_lm.tokens_of(text))
        assert {r.token: r.n for r in counts.collect()} == want
        top = masked_lm._most_frequent(counts)
        shares = masked_lm.rare_shares(counts, top)
        assert np.allclose(np.exp(shares.astype(float)).reshape(-1, masked_lm.RARE).sum(0), 1, atol=1e-4)
        slot = lambda t: zlib.crc32(t.encode()) % len(shares)
        rest = {t: n for t, n in want.items() if t not in {r.token for r in top}}
        held = Counter()
        for t, n in rest.items():
            held[slot(t)] += n
        for s, n in held.items():
            bucket = [held.get(k, 0.5) for k in range(s % masked_lm.RARE, len(shares), masked_lm.RARE)]
            assert np.isclose(np.exp(shares[s]), n / sum(bucket), rtol=1e-3)
        sizes.append(len(shares))
        known = {r.token: i + masked_lm.RARE for i, r in enumerate(top)}
        coded = masked_lm.coded_texts(masked_lm.chunks(spark.createDataFrame(texts, "doc_id long, text string")), known, shares)
        for r in coded.collect():
            tokens = masked_lm.tokens_of(texts[r.id][1])
            assert np.frombuffer(r.numbers, np.uint16).tolist() == [known.get(t, zlib.crc32(t.encode()) % masked_lm.RARE) for t in tokens]
            assert np.isclose(r.rare, sum(float(shares[slot(t)]) for t in tokens if t not in known), rtol=1e-4)
    assert sizes[1] > 8 * sizes[0]


def test_every_text_teaches():
    for n in range(1, 40):
        for k in range(20):
            ids = np.arange(k, k + n, dtype=np.uint16)
            for turn in range(masked_lm.ROUNDS):
                at = masked_lm.positions(ids, turn)
                assert len(at) >= max(1, n // masked_lm.EVERY) and (at < n).all()
    assert len(masked_lm.positions(np.empty(0, np.uint16), 0)) == 0


def test_chunks_keep_every_text(spark, docs, odd, monkeypatch):
    for size in (3, masked_lm.CHUNK):
        monkeypatch.setattr(masked_lm, "CHUNK", size)
        for df in (docs.limit(30), odd):
            rows = []
            for r in masked_lm.chunks(df).collect():
                codes, at = np.frombuffer(r.codes, masked_lm._width(len(r.tokens))), 0
                assert r.counts == np.bincount(codes, minlength=len(r.tokens)).tolist()
                for i, n in zip(r.ids, r.sizes):
                    rows.append((i, [r.tokens[c] for c in codes[at : at + n]]))
                    at += n
                assert at == len(codes)
            assert sorted(rows, key=str) == sorted(((r.doc_id, masked_lm.tokens_of(r.text)) for r in df.collect()), key=str)


def test_odd_rows(spark, odd, empty):
    got = masked_lm.pseudo_likelihood(odd)
    rows = got.collect()
    assert len(rows) == odd.count()
    assert all((r.n_tokens == 0) == (r.per_token is None) and (r.n_tokens > 0 or r.log_likelihood == 0) for r in rows)
    assert masked_lm.pseudo_likelihood(empty).count() == 0


def test_classes_of_a_piece_share_one_softmax(monkeypatch):
    """A piece takes one softmax over the classes and one over all tokens in their classes, not one a class."""
    rng = np.random.default_rng(3)
    net = masked_lm.Network.from_flat(masked_lm.Network.fresh())
    context = rng.integers(0, masked_lm.VOCABULARY + 1, (500, 2 * masked_lm.WINDOW))
    target = rng.integers(0, masked_lm.VOCABULARY, 500)
    h = masked_lm._hidden(net, context).astype(np.float64)
    softmax = lambda x: x - np.log(np.exp(x).sum(1, keepdims=True))
    group, word = target // masked_lm.PER_CLASS, target % masked_lm.PER_CLASS
    at = np.arange(500)
    logits = np.einsum("nw,nkw->nk", h, net.word[group].astype(np.float64)) + net.word_bias[group]
    want = softmax(h @ net.group.T + net.group_bias)[at, group] + softmax(logits)[at, word]
    calls, share = [], masked_lm._log_share
    monkeypatch.setattr(masked_lm, "_log_share", lambda x, pick: calls.append(len(x)) or share(x, pick))
    np.testing.assert_allclose(masked_lm.log_probabilities(net, context, target), want, rtol=1e-4)
    assert calls == [500, 500]


def test_a_round_trains_on_every_position(monkeypatch):
    """Also in pieces: their contexts are those of the whole text, and no position is left out or taken twice."""
    monkeypatch.setattr(masked_lm, "PIECE", 7)
    for n in (0, 1, 2, 7, 8, 9, 40):
        ids = np.arange(100, 100 + n)
        for turn in range(masked_lm.ROUNDS):
            assert masked_lm.positions(ids, turn).tolist() == list(range(n))
            pieces = list(masked_lm.lessons(ids, turn))
            assert all(len(y) <= 7 for _, y in pieces)
            assert [y for _, target in pieces for y in target] == ids.tolist()
            assert [x for context, _ in pieces for x in context.tolist()] == masked_lm.windows(ids).tolist()
