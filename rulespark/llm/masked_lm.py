"""Masked pseudo-likelihood: a bidirectional window network predicts every token from both sides."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StringType, StructField, StructType

from rulespark.llm.common import stored

CLASSES, PER_CLASS = 32, 64  # two-level softmax: a token's class, then the token in its class
VOCABULARY = CLASSES * PER_CLASS
RARE = 64  # numbers shared by all other tokens, by hash; a token's share in its number is its part of the corpus counts
MOST_SLOTS = 1 << 21  # of the table of those counts: as many as there are distinct tokens, at most 8 MB as shared
CHUNK = 100_000  # tokens that share a list of their distinct tokens
WINDOW = 3  # tokens seen on either side
WIDTH = 16
ROUNDS = 2  # of training, each over all positions of every text
EVERY = 1  # step from one position that a round trains on to the next: it leaves none out
BATCH = 1024
RATE = 0.15
PIECE = 1 << 12  # positions of a text taken, and positions scored, at a time
PARTS = 16  # pieces of the parameters that are averaged apart
PAD = VOCABULARY

_TOKEN = re.compile(r"\w+|[^\w\s]")


def tokens_of(text: str | None) -> list[str]:
    """Lower-cased words and single marks."""
    return _TOKEN.findall(text.lower()) if text else []


def _width(distinct: int) -> type:
    return np.uint16 if distinct <= 1 << 16 else np.uint32


def chunks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(ids, sizes, codes, tokens, counts): runs of whole texts whose tokens are numbers into the run's distinct tokens.

    Texts are read and cut into tokens here, once; what follows works on numbers and on distinct tokens. A run ends with
    the text that brings it to CHUNK tokens, so a task holds one run and one text.
    """
    kind = df.schema[id_col].dataType
    schema = StructType([
        StructField("ids", ArrayType(kind)), StructField("sizes", ArrayType(LongType())), StructField("codes", BinaryType()),
        StructField("tokens", ArrayType(StringType())), StructField("counts", ArrayType(LongType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, start, sizes, tokens = batch.column(0), 0, [], []
            for i, text in enumerate(batch.column(1)):
                own = tokens_of(text.as_py())
                tokens += own
                sizes.append(len(own))
                if len(tokens) >= CHUNK or i == batch.num_rows - 1:
                    whole = pa.array(tokens, pa.string()).dictionary_encode()  # distinct ones come as they are first seen
                    codes, found = whole.indices.to_numpy(), whole.dictionary
                    counts = np.bincount(codes, minlength=len(found))
                    columns = [
                        pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), ids.slice(start, len(sizes))), pa.array([sizes], pa.list_(pa.int64())),
                        pa.array([codes.astype(_width(len(found))).tobytes()], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), found),
                        pa.array([counts], pa.list_(pa.int64())),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)
                    start, sizes, tokens = i + 1, [], []

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def token_counts(cut: DataFrame) -> DataFrame:
    """(token, n) over all chunks."""
    pairs = cut.select(F.explode(F.arrays_zip("tokens", "counts")).alias("p"))
    return pairs.groupBy(F.col("p.tokens").alias("token")).agg(F.sum("p.counts").alias("n"))


def _most_frequent(counts: DataFrame) -> list:
    return counts.orderBy(F.desc("n"), "token").limit(VOCABULARY - RARE).collect()


def vocabulary(df: DataFrame, text_col: str = "text") -> dict[str, int]:
    """The VOCABULARY - RARE most frequent tokens of the whole corpus, numbered from RARE; ties by the token's order."""
    cut = chunks(df.select(F.lit(0).alias("id"), F.col(text_col).alias("text")), "id", "text")
    return {r.token: i + RARE for i, r in enumerate(_most_frequent(token_counts(cut)))}


def rare_shares(counts: DataFrame, top: list) -> np.ndarray:
    """Log share of every slot (crc32 of a token modulo the slots) in the corpus counts of its number (slot modulo RARE).

    Counts are of all tokens but `top`. There are as many slots as distinct tokens, so what is kept grows with the corpus
    and two tokens seldom share one, up to MOST_SLOTS; a slot that no token of the corpus has counts half a token.
    """
    slots = RARE
    distinct = counts.count()
    while slots < min(2 * distinct, MOST_SLOTS):
        slots *= 2
    sums = counts.groupBy((F.crc32(F.col("token").cast("binary")) % slots).alias("slot")).agg(F.sum("n").alias("n")).toArrow()
    held = np.zeros(slots)
    held[sums.column("slot").to_numpy()] = sums.column("n").to_numpy()
    for r in top:
        held[zlib.crc32(r.token.encode()) % slots] -= r.n
    held = np.maximum(held, 0.5).reshape(-1, RARE)
    return np.log(held / held.sum(0)).reshape(-1).astype(np.float32)


def coded_texts(cut: DataFrame, known: dict[str, int], shares: np.ndarray | None = None) -> DataFrame:
    """(id, n, numbers, rare): every text's token numbers as 16-bit bytes, and the sum of its rare tokens' log shares."""
    shared = cut.sparkSession.sparkContext.broadcast((known, shares))
    kind = cut.schema["ids"].dataType.elementType
    schema = StructType([StructField("id", kind), StructField("n", LongType()), StructField("numbers", BinaryType()), StructField("rare", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, shares = shared.value
        known = {t.encode(): i for t, i in known.items()}
        for batch in batches:
            for row in range(batch.num_rows):
                ids, sizes, codes, tokens = (batch.column(c)[row] for c in range(4))
                names = tokens.values.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
                number = np.fromiter((known.get(t, -1) for t in names), np.int64, len(names))
                rare = np.flatnonzero(number < 0)
                slot = np.fromiter((zlib.crc32(names[k]) for k in rare.tolist()), np.int64, len(rare))
                number[rare] = slot % RARE
                share = np.zeros(len(names))
                if shares is not None:
                    share[rare] = shares[slot % len(shares)]
                codes = np.frombuffer(codes.as_py(), _width(len(names)))
                own, weight = number.astype(np.uint16)[codes], share[codes]
                sizes = sizes.values.to_numpy()
                ends = np.cumsum(sizes)
                sums = np.concatenate([[0.0], np.cumsum(weight)])
                texts = [own[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist())]
                columns = [ids.values, pa.array(sizes, pa.int64()), pa.array(texts, pa.binary()), pa.array(sums[ends] - sums[ends - sizes])]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return cut.mapInArrow(run, schema)


def numbers(df: DataFrame, known: dict[str, int], id_col: str, text_col: str) -> DataFrame:
    """(id, n, numbers, rare) of texts under a given vocabulary; no token is told apart from others of its number."""
    return coded_texts(chunks(df, id_col, text_col), known)


@dataclass
class Network:
    """Sum of one embedding per place in the window, tanh, and a two-level softmax. All float32."""

    embed: np.ndarray  # place x (token and padding) x width
    bias: np.ndarray  # width
    group: np.ndarray  # class x width
    group_bias: np.ndarray
    word: np.ndarray  # class x token in class x width
    word_bias: np.ndarray

    @classmethod
    def shapes(cls) -> list[tuple[int, ...]]:
        return [(2 * WINDOW, VOCABULARY + 1, WIDTH), (WIDTH,), (CLASSES, WIDTH), (CLASSES,), (CLASSES, PER_CLASS, WIDTH), (CLASSES, PER_CLASS)]

    @classmethod
    def size(cls) -> int:
        return sum(int(np.prod(s)) for s in cls.shapes())

    @classmethod
    def from_flat(cls, flat: np.ndarray) -> Network:
        parts, at = [], 0
        for s in cls.shapes():
            n = int(np.prod(s))
            parts.append(flat[at : at + n].reshape(s))
            at += n
        return cls(*parts)

    @classmethod
    def fresh(cls) -> np.ndarray:
        return np.random.default_rng(11).normal(0, 0.1, cls.size()).astype(np.float32)


_PLACES = np.array([k for k in range(2 * WINDOW + 1) if k != WINDOW])
_ROWS = np.arange(2 * WINDOW) * (VOCABULARY + 1)  # where each place's embeddings begin in one list of all; ends below 2^16


def windows(ids: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """positions x 2 WINDOW: the numbers before and after each position (or each of `at`), PAD beyond the ends."""
    padded = np.concatenate([np.full(WINDOW, PAD), ids, np.full(WINDOW, PAD)])
    n = len(ids)
    if at is not None:
        return padded[at[:, None] + _PLACES]
    return np.stack([padded[k : k + n] for k in _PLACES], axis=1) if n else np.empty((0, 2 * WINDOW), np.int64)


def _hidden(net: Network, context: np.ndarray) -> np.ndarray:
    total = net.embed[0].take(context[:, 0], 0)
    for k in range(1, 2 * WINDOW):
        total += net.embed[k].take(context[:, k], 0)
    return np.tanh(total + net.bias)


def _softmax(x: np.ndarray) -> np.ndarray:
    """Of each row; x is used up."""
    x -= x.max(1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(1, keepdims=True)
    return x


def _log_share(x: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """Log softmax of one column per row; x is used up."""
    x -= x.max(1, keepdims=True)
    picked = x[np.arange(len(x)), pick]
    np.exp(x, out=x)
    return picked - np.log(x.sum(1))


def log_probabilities(net: Network, context: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log probability of each target given its context."""
    h = _hidden(net, context)
    group, word = target // PER_CLASS, target % PER_CLASS
    out = _log_share(h @ net.group.T + net.group_bias, group)
    order, _, logits = _word_logits(net, h, group)
    out[order] += _log_share(logits, word[order])
    return out


def _word_logits(net: Network, h: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]], np.ndarray]:
    """Rows ordered by class, each class's share of them, and their logits in their class."""
    order = np.argsort(group.astype(np.uint8), kind="stable")
    edges = np.searchsorted(group[order], np.arange(CLASSES + 1)).tolist()
    shares = [(c, slice(edges[c], edges[c + 1])) for c in range(CLASSES) if edges[c] < edges[c + 1]]
    h, logits = h[order], np.empty((len(order), PER_CLASS), np.float32)
    for c, rows in shares:
        np.matmul(h[rows], net.word[c].T, out=logits[rows])
        logits[rows] += net.word_bias[c]
    return order, shares, logits


class Trainer:
    """Adagrad on a network, in place."""

    def __init__(self, flat: np.ndarray):
        self.flat = flat.copy()
        self.net = Network.from_flat(self.flat)
        self.square = np.full(len(flat), 1e-4, np.float32)
        self.sums = Network.from_flat(self.square)

    def _step(self, name: str, at, gradient: np.ndarray) -> None:
        weights, sums = getattr(self.net, name), getattr(self.sums, name)
        if name == "embed":  # one list of places and tokens
            weights, sums = weights.reshape(-1, WIDTH), sums.reshape(-1, WIDTH)
        total = sums[at] + gradient * gradient
        sums[at] = total
        weights[at] -= RATE * gradient / np.sqrt(total, out=total)

    def learn(self, context: np.ndarray, target: np.ndarray) -> None:
        net, n = self.net, len(target)
        h = _hidden(net, context)
        group, word = target // PER_CLASS, target % PER_CLASS
        g = _softmax(h @ net.group.T + net.group_bias)
        g[np.arange(n), group] -= 1
        g /= n
        back = g @ net.group
        steps = [("group", slice(None), g.T @ h), ("group_bias", slice(None), g.sum(0))]
        order, shares, logits = _word_logits(net, h, group)
        w = _softmax(logits)
        w[np.arange(n), word[order]] -= 1
        w /= n
        sorted_h, more = h[order], np.empty_like(h)
        words = np.empty((len(shares), PER_CLASS, WIDTH), np.float32)
        for i, (c, rows) in enumerate(shares):
            own = w[rows]
            np.matmul(own, net.word[c], out=more[rows])
            np.matmul(own.T, sorted_h[rows], out=words[i])
        back[order] += more
        seen = np.array([c for c, _ in shares])
        steps += [("word", seen, words), ("word_bias", seen, np.add.reduceat(w, [rows.start for _, rows in shares], axis=0))]
        back *= 1 - h * h
        rows = (context + _ROWS).astype(np.uint16).ravel()
        order = np.argsort(rows, kind="stable")  # 16 bits are sorted by their digits
        rows = rows[order]
        starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        steps.append(("embed", rows[starts].astype(np.int64), np.add.reduceat(back.take(order // (2 * WINDOW), 0), starts, axis=0)))
        steps.append(("bias", slice(None), back.sum(0)))
        for step in steps:
            self._step(*step)


def positions(ids: np.ndarray, turn: int) -> np.ndarray:
    """What a round trains on: all positions of a text, in every round."""
    return np.arange(0, len(ids), EVERY)


def lessons(ids: np.ndarray, turn: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(contexts, targets) of a round's positions of a text; a long text goes in pieces that see beyond their ends."""
    every = positions(ids, turn)
    for a in range(0, len(every), PIECE):
        at = every[a : a + PIECE]
        lo = max(0, at[0] - WINDOW)
        yield windows(ids[lo : at[-1] + 1 + WINDOW], at - lo), ids[at]


def train(coded: DataFrame) -> Network:
    """Federated averaging: each task trains a copy on all positions of all its texts; copies are averaged by positions.

    A round takes every position of every text, so what is learned from grows with the input. The result depends on how rows lie in partitions, not on the order in
    which tasks end: a stored input gives the same network again. Averages are running sums: a piece of the parameters is summed by one task, a copy at a time.
    """
    spark = coded.sparkSession
    flat = Network.fresh()
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast(flat)

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trainer = Trainer(shared.value)
            rng = np.random.default_rng(TaskContext.get().partitionId())
            contexts, targets, held, seen = [], [], 0, 0

            def flush() -> None:
                nonlocal contexts, targets, held, seen
                x, y = np.concatenate(contexts), np.concatenate(targets)
                order = rng.permutation(len(y))
                for at in range(0, len(y), BATCH):
                    trainer.learn(x[order[at : at + BATCH]], y[order[at : at + BATCH]])
                seen += len(y)
                contexts, targets, held = [], [], 0

            for batch in batches:
                for blob in batch.column(0):
                    ids = np.frombuffer(blob.as_py(), np.uint16).astype(np.int64)
                    for context, target in lessons(ids, turn):
                        contexts.append(context)
                        targets.append(target)
                        held += len(target)
                        if held >= 64 * BATCH:
                            flush()
            if held:
                flush()
            if seen:
                pieces = [p.tobytes() for p in np.array_split(trainer.flat, PARTS)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(PARTS), pa.int32()), pa.array([seen] * PARTS, pa.int64()), pa.array(pieces, pa.binary())], names=["part", "n", "weights"]
                )

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for batch in batches:
                for part, n, blob in zip(*(c.to_pylist() for c in batch.columns)):
                    total = sums.setdefault(part, [0, 0.0])
                    total[0] += n
                    total[1] = total[1] + np.frombuffer(blob, np.float32).astype(np.float64) * n
            if sums:
                rows = [(p, (w / n).astype(np.float32).tobytes()) for p, (n, w) in sorted(sums.items())]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([w for _, w in rows], pa.binary())], names=["part", "weights"])

        copies = coded.select("numbers").mapInArrow(learn, "part int, n bigint, weights binary")
        found = copies.repartition(PARTS, "part").sortWithinPartitions("part", "n", "weights").mapInArrow(average, "part int, weights binary").collect()
        if found:
            flat = np.concatenate([np.frombuffer(r.weights, np.float32) for r in sorted(found, key=lambda r: r.part)])
    return Network.from_flat(flat)


def score(coded: DataFrame, net: Network) -> DataFrame:
    """coded with log_likelihood: the sum over all tokens of the log probability given both sides; 0 without tokens.

    A rare token's probability is that of its number times its share in it.
    """
    shared = coded.sparkSession.sparkContext.broadcast(net)
    at, rare = coded.columns.index("numbers"), coded.columns.index("rare")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            total = batch.column(rare).to_numpy().copy()
            contexts, targets, owners, held = [], [], [], 0

            def flush() -> None:
                nonlocal contexts, targets, owners, held
                x, y = np.concatenate(contexts), np.concatenate(targets)
                got = log_probabilities(model, x, y).astype(np.float64)
                np.add(total, np.bincount(np.concatenate(owners), got, len(total)), out=total)
                contexts, targets, owners, held = [], [], [], 0

            for i, blob in enumerate(batch.column(at)):
                ids = np.frombuffer(blob.as_py(), np.uint16).astype(np.int64)
                for a in range(0, len(ids), PIECE):  # a long text goes in pieces that see beyond their ends
                    lo, hi = max(0, a - WINDOW), min(len(ids), a + PIECE + WINDOW)
                    own = slice(a - lo, a - lo + min(PIECE, len(ids) - a))
                    contexts.append(windows(ids[lo:hi])[own])
                    targets.append(ids[a : a + PIECE])
                    owners.append(np.full(len(targets[-1]), i))
                    held += len(targets[-1])
                    if held >= PIECE:
                        flush()
            if held:
                flush()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total)], names=[*batch.schema.names, "log_likelihood"])

    return coded.mapInArrow(run, StructType([*coded.schema.fields, StructField("log_likelihood", DoubleType())]))


def pseudo_likelihood(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, log_likelihood, per_token) of every whole text; vocabulary and network come from the same table.

    The network tells VOCABULARY numbers apart; tokens beyond the most frequent share RARE of them, and are told apart there
    by their shares of the corpus counts, in a table that grows with the distinct tokens. Null, empty and wordless texts have no
    tokens, log_likelihood 0 and per_token null. Ids may be null or repeat; each row gets a row. An empty table gives
    an empty result.
    """
    cut = stored(chunks(df, id_col, text_col), "chunks")
    counts = stored(token_counts(cut), "counts")
    top = _most_frequent(counts)
    coded = stored(coded_texts(cut, {r.token: i + RARE for i, r in enumerate(top)}, rare_shares(counts, top)), "numbers")
    scored = score(coded, train(coded))
    mean = F.when(F.col("n") > 0, F.col("log_likelihood") / F.col("n"))
    return scored.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), "log_likelihood", mean.alias("per_token"))
