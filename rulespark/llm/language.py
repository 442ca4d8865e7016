"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from rulespark.llm.common import remainder, stored

PER_LANGUAGE = 1_500  # training texts of a language, those with the smallest id hash
ROUNDS = 4  # of expectation maximisation
SMOOTHING = 0.1  # added to each expected piece count
UNDETERMINED = "und"
START = "▁"  # stands before a word's first letter in the vocabulary

_WORD = re.compile(r"[^\W\d_]+")
_MEMO = 300_000  # words remembered per task


def words_of(text: str) -> list[str]:
    """Letter runs of the text, lower-cased."""
    return _WORD.findall(text.lower())


class Vocabulary:
    """Pieces made of letters, one piece for every byte, and the edges they give a word."""

    def __init__(self, model_file: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        letters = [p for i, p in enumerate(names) if p.lstrip(START).isalpha() and not model.is_byte(i) and not model.is_control(i)]
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(p for i, p in enumerate(names) if model.is_byte(i))}
        self.piece = {p: i + len(self.byte) for i, p in enumerate([START, *(p for p in letters if p != START)])}
        self.size = len(self.byte) + len(self.piece)
        self.longest = max(map(len, self.piece))
        self._build_trie()

    def _build_trie(self) -> None:
        """Nodes are prefixes of pieces; a step is found by its exact number (node, letter) in a sorted list."""
        node, steps, ends = {"": 0}, {}, {}
        for piece, number in self.piece.items():
            for k in range(1, len(piece) + 1):
                if piece[:k] not in node:
                    node[piece[:k]] = len(node)
                    steps[node[piece[: k - 1]] << 21 | ord(piece[k - 1])] = node[piece[:k]]
            ends[node[piece]] = number
        self.step_keys = np.array(sorted(steps), np.int64)
        self.step_to = np.array([steps[k] for k in self.step_keys.tolist()], np.int64)
        self.ends = np.full(len(node), -1, np.int64)
        self.ends[list(ends)] = list(ends.values())

    def live_edges(self, letters: np.ndarray, starts: np.ndarray, unknown: dict[str, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, rows, pieces) of all pieces that begin at `starts`, places in the flat `letters`; a 0 ends a word.

        Rows are places in `starts`, in order. A letter without a piece is spelled in bytes: it gets a number past the
        vocabulary in `unknown`.
        """
        rows, node = np.arange(len(starts)), np.zeros(len(starts), np.int64)
        for length in range(1, self.longest + 1):
            key = node << 21 | letters[starts[rows] + length - 1]
            at = np.minimum(np.searchsorted(self.step_keys, key), len(self.step_keys) - 1)
            hit = self.step_keys[at] == key
            to = np.where(hit, self.step_to[at], 0)
            piece = np.where(hit, self.ends[to], -1)
            if length == 1:
                for i in np.flatnonzero(piece < 0):
                    piece[i] = unknown.setdefault(chr(letters[starts[i]]), self.size + len(unknown))
            found = piece >= 0
            if found.any():
                yield length, rows[found], piece[found]
            rows, node = rows[hit], to[hit]
            if not len(rows):
                return

    def edges(self, words: list[str], unknown: dict[str, int]) -> np.ndarray:
        """ids[word, end - 1, length - 1] of pieces ending there; words have one length. No piece: -1."""
        n = len(words[0]) + 1
        letters = _letters(words)
        ids = np.full((len(words), n, min(self.longest, n)), -1, np.int32)
        word, start = np.divmod(np.arange(len(words) * n), n)
        for length, rows, pieces in self.live_edges(letters, word * (n + 1) + start, unknown):
            ids[word[rows], start[rows] + length - 1, length - 1] = pieces
        return ids

    def spelled(self, unknown: dict[str, int]) -> list[list[int]]:
        return [[self.byte[b] for b in c.encode("utf-8", "surrogatepass")] for c in unknown]

    def with_unknown(self, table: np.ndarray, unknown: dict[str, int]) -> np.ndarray:
        """table (pieces x languages) and rows for spelled letters, then one of -inf for id -1."""
        extra = [table[ids].sum(0) for ids in self.spelled(unknown)]
        return np.concatenate([table, np.array(extra).reshape(len(extra), table.shape[1]), np.full((1, table.shape[1]), -np.inf)])


def _letters(words: list[str]) -> np.ndarray:
    """Code points of all words, each with the start mark before and a 0 after it."""
    text = "".join([f"{START}{w}\0" for w in words])
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _total(terms: list[np.ndarray]) -> np.ndarray:
    """log of the sum of exponentials over a list of arrays."""
    stack = np.stack(terms)
    top = stack.max(0)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(stack - safe).sum(0))


def forward(edge, n: int, longest: int) -> list[np.ndarray]:
    """alpha[j]: log probability of all segmentations of the first j characters; edge(j, l) is a piece of length l ending at j."""
    zero = np.zeros_like(edge(1, 1))
    alpha = [zero]
    for j in range(1, n + 1):
        alpha.append(_total([alpha[j - l] + edge(j, l) for l in range(1, min(longest, j) + 1)]))
    return alpha


def backward(edge, n: int, longest: int) -> list[np.ndarray]:
    zero = np.zeros_like(edge(1, 1))
    beta = [zero] * (n + 1)
    for j in range(n - 1, -1, -1):
        beta[j] = _total([beta[j + l] + edge(j + l, l) for l in range(1, min(longest, n - j) + 1)])
    return beta


def _by_length(words: list[str], most: int = 4096) -> Iterator[list[int]]:
    """Positions of words of one length, few enough at a time that their edges stay small."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    at = 0
    while at < len(order):
        n = len(words[order[at]])
        to, limit = at, max(1, most * 12 // (n + 1))
        while to < len(order) and to - at < limit and len(words[order[to]]) == n:
            to += 1
        yield order[at:to]
        at = to


LONG = 256  # words from this length on are walked one by one
_SMALL, _SHIFT = 1e-120, 1e120  # sums are kept above the one by factors of the other; a single piece never costs that much


def log_probabilities(words: list[str], vocabulary: Vocabulary, table: np.ndarray) -> np.ndarray:
    """words x languages: log of the summed probability of all segmentations.

    Sums run over probabilities, not their logs: those reaching each place in a word are pushed along the pieces that begin there.
    Each word and language is scaled up whenever its sum gets small, and the factors are counted.
    """
    out = np.empty((len(words), table.shape[1]))
    for places in _by_length(words):
        group = [words[i] for i in places]
        if len(group[0]) >= LONG:
            for i, word in zip(places, group):
                out[i] = _one_long_word(word, vocabulary, table)
            continue
        n, unknown = len(group[0]) + 1, {}
        start, word = np.divmod(np.arange(len(group) * n), len(group))  # all words' first places, then all second ones
        edges = []
        for length, rows, pieces in vocabulary.live_edges(_letters(group), word * (n + 1) + start, unknown):
            edges.append((length, word[rows], pieces, np.searchsorted(start[rows], np.arange(n + 1))))
        full = np.exp(vocabulary.with_unknown(table, unknown))
        reached = np.zeros((n + vocabulary.longest + 1, len(group), table.shape[1]))
        reached[0] = 1.0
        shifts = np.zeros(reached.shape[1:])
        for i in range(n):
            low = reached[i] < _SMALL
            if low.any():
                reached[i : i + vocabulary.longest + 1, low] *= _SHIFT
                shifts += low
            for length, at, pieces, bounds in edges:
                cut = slice(bounds[i], bounds[i + 1])
                reached[i + length, at[cut]] += reached[i, at[cut]] * full[pieces[cut]]
        out[places] = np.log(reached[n]) - shifts * np.log(_SHIFT)
    return out


def _one_long_word(word: str, vocabulary: Vocabulary, table: np.ndarray, step: int = 50_000) -> np.ndarray:
    """The same for one word, in stretches of `step` places: memory does not grow with its edges."""
    letters, n, longest = _letters([word]), len(word) + 1, vocabulary.longest
    languages = range(table.shape[1])
    pending = [[1.0] + [0.0] * longest for _ in languages]  # of the places from the current one on
    logs = [0.0] * len(languages)
    for first in range(0, n, step):
        starts, unknown = np.arange(first, min(n, first + step)), {}
        found = list(vocabulary.live_edges(letters, starts, unknown))
        row = np.concatenate([r for _, r, _ in found])
        order = np.argsort(row, kind="stable")
        length = np.concatenate([np.full(len(r), k) for k, r, _ in found])[order].tolist()
        piece = np.concatenate([p for _, _, p in found])[order]
        ends = np.searchsorted(row[order], np.arange(len(starts)), "right").tolist()
        full = np.exp(vocabulary.with_unknown(table, unknown))
        for lang in languages:
            chance, now, edge = full[piece, lang].tolist(), pending[lang], 0
            for end in ends:
                here = now[0]
                if here < _SMALL:
                    now = [x * _SHIFT for x in now]
                    here *= _SHIFT
                    logs[lang] -= math.log(_SHIFT)
                while edge < end:
                    now[length[edge]] += here * chance[edge]
                    edge += 1
                del now[0]
                now.append(0.0)
            pending[lang] = now
    return np.array([math.log(p[0]) + x for p, x in zip(pending, logs)])


def expected_counts(words: list[str], language: np.ndarray, times: np.ndarray, vocabulary: Vocabulary, table: np.ndarray) -> np.ndarray:
    """pieces x languages: expected uses of each piece in the words, each under its own language."""
    counts = np.zeros(table.shape)
    for places in _by_length(words):
        if len(words[places[0]]) >= LONG:
            for i in places:
                _add_long_word(counts[:, language[i]], words[i], times[i], vocabulary, table[:, language[i]])
            continue
        unknown: dict[str, int] = {}
        ids = vocabulary.edges([words[i] for i in places], unknown)
        full = vocabulary.with_unknown(table, unknown)
        lang, n, longest = language[places], ids.shape[1], ids.shape[2]
        edge = lambda j, l: full[ids[:, j - 1, l - 1], lang]
        alpha, beta = forward(edge, n, longest), backward(edge, n, longest)
        use = np.zeros(full.shape)
        for j in range(1, n + 1):
            for l in range(1, min(longest, j) + 1):
                share = np.exp(alpha[j - l] + edge(j, l) + beta[j] - alpha[n]) * times[places]
                np.add.at(use, (ids[:, j - 1, l - 1], lang), share)
        counts += use[: vocabulary.size]
        for row, spelled in zip(use[vocabulary.size : -1], vocabulary.spelled(unknown)):
            np.add.at(counts, spelled, row)
    return counts


def _add_long_word(counts: np.ndarray, word: str, times: float, vocabulary: Vocabulary, table: np.ndarray) -> None:
    """Adds one long word's expected pieces to `counts`, a column; sums from both ends are scaled like those above."""
    n, unknown = len(word) + 1, {}
    found = list(vocabulary.live_edges(_letters([word]), np.arange(n), unknown))
    row = np.concatenate([r for _, r, _ in found])
    order = np.argsort(row, kind="stable")
    start, piece = row[order], np.concatenate([p for _, _, p in found])[order]
    length = np.concatenate([np.full(len(r), k) for k, r, _ in found])[order]
    logs = vocabulary.with_unknown(table[:, None], unknown)[:, 0]
    chance, reach, bounds = np.exp(logs[piece]).tolist(), length.tolist(), np.searchsorted(start, np.arange(n + 1)).tolist()
    ahead, behind = np.zeros(n + 1), np.zeros(n + 1)
    now, scale = [1.0] + [0.0] * vocabulary.longest, 0.0
    for i in range(n + 1):
        if now[0] < _SMALL:
            now, scale = [x * _SHIFT for x in now], scale - math.log(_SHIFT)
        ahead[i] = math.log(now[0]) + scale
        if i < n:
            for e in range(bounds[i], bounds[i + 1]):
                now[reach[e]] += now[0] * chance[e]
        del now[0]
        now.append(0.0)
    after, scale = [1.0] + [0.0] * vocabulary.longest, 0.0  # after[k]: from place i + 1 + k to the end
    for i in range(n - 1, -1, -1):
        here = sum(chance[e] * after[reach[e] - 1] for e in range(bounds[i], bounds[i + 1]))
        if here < _SMALL:
            after, scale, here = [x * _SHIFT for x in after], scale - math.log(_SHIFT), here * _SHIFT
        behind[i] = math.log(here) + scale
        after = [here, *after[:-1]]
    share = np.exp(ahead[start] + logs[piece] + behind[start + length] - ahead[n]) * times
    use = np.bincount(piece, weights=share, minlength=len(logs))
    counts += use[: vocabulary.size]
    for amount, spelled in zip(use[vocabulary.size : -1], vocabulary.spelled(unknown)):
        np.add.at(counts, spelled, amount)


class Model:
    def __init__(self, vocabulary: Vocabulary, languages: list[str], table: np.ndarray, prior: np.ndarray):
        self.vocabulary, self.languages, self.table, self.prior = vocabulary, languages, table, prior


def train(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Per-language piece probabilities by expectation maximisation, from rows with a text and a language.

    Uses at most PER_LANGUAGE texts of each language, chosen by the hash of the id; the prior counts all rows. Their
    distinct words with counts are a table; each round is one job that sums expected piece counts over it, at most
    pieces x languages numbers. Languages are few: each is a column of the model.
    """
    spark = df.sparkSession
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    shares = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(shares)
    vocabulary = Vocabulary(model_file)
    if not languages:
        return Model(vocabulary, [], np.zeros((vocabulary.size, 0)), np.zeros(0))
    drawn = rows.select("id", "lang").withColumn("draw", F.xxhash64(F.col("id").cast("string")))
    # the smallest hashes of a language lie below this bound, so only about as many rows as are wanted meet in its task
    spare = PER_LANGUAGE + 8 * int(PER_LANGUAGE**0.5)
    bounds = [(lang, 2**63 - 1 if spare >= n else int(spare / n * 2**64) - 2**63) for lang, n in shares.items()]
    below = F.broadcast(spark.createDataFrame(bounds, "lang string, bound bigint"))  # a row per language
    drawn = drawn.join(below, "lang").where("draw <= bound").drop("bound")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "id"))
    chosen = drawn.withColumn("place", place).where(F.col("place") <= PER_LANGUAGE).select("id", "lang").distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                seen.setdefault(lang, Counter()).update(words_of(text.as_py()))
            flat = [(lang, w, n) for lang, c in seen.items() for w, n in c.items()]
            if flat:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*flat)], names=["lang", "word", "n"])

    sample = rows.join(F.broadcast(chosen), [rows["id"].eqNullSafe(chosen["id"]), rows["lang"] == chosen["lang"]], "left_semi")
    words = stored(sample.select("lang", "text").mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    words = words.repartition(2 * spark.sparkContext.defaultParallelism, F.xxhash64("word"))
    table = np.full((vocabulary.size, len(languages)), -np.log(vocabulary.size))
    number = {lang: i for i, lang in enumerate(languages)}
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(table)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shared.value.shape)
            for batch in batches:
                lang = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
                total += expected_counts(batch.column(1).to_pylist(), lang, batch.column(2).to_numpy(), vocabulary, shared.value)
            cell = np.flatnonzero(total > 1e-9)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(total.ravel()[cell])], names=["cell", "n"])

        sums = words.select("lang", "word", "n").mapInArrow(expect, "cell bigint, n double").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros(table.size)
        counts[sums["cell"].to_numpy(np.int64)] = sums["n"]
        counts = counts.reshape(table.shape) + SMOOTHING
        table = np.log(counts / counts.sum(0))
    total = np.array([shares[lang] for lang in languages], float)
    return Model(vocabulary, languages, table, np.log(total / total.sum()))


def identify(df: DataFrame, model: Model, text_col: str = "text", out: str = "lang_pred", score: str = "score") -> DataFrame:
    """df with the most probable language of each whole text and its posterior probability.

    A null text, one without a letter, and any text when nothing was learned are UNDETERMINED with score 0. Ties go to
    the language first by code point.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        memo: dict[str, int] = {}
        known = np.empty((0, len(m.languages)))
        letters = np.empty(0, bool)
        for batch in batches:
            found, values = [], []
            texts = batch.column(at)
            start = 0
            while start < len(texts):
                docs, held = [], 0
                while start < len(texts) and (not docs or held < 4_000_000):
                    text = texts[start].as_py()
                    docs.append(words_of(text) if text else [])
                    held += len(text or "")
                    start += 1
                if len(memo) > _MEMO:
                    memo, known, letters = {}, known[:0], letters[:0]
                fresh = list({w for words in docs for w in words}.difference(memo))
                if fresh:
                    memo.update(zip(fresh, range(len(memo), len(memo) + len(fresh))))
                    known = np.concatenate([known, log_probabilities(fresh, m.vocabulary, m.table)])
                    letters = np.concatenate([letters, [any(map(str.isalpha, w)) for w in fresh]])
                for words in docs:
                    ids = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
                    if not m.languages or not letters[ids].any():
                        found.append(UNDETERMINED)
                        values.append(0.0)
                        continue
                    total = m.prior + known[ids].sum(0)
                    best = int(total.argmax())
                    found.append(m.languages[best])
                    values.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(values, pa.float64())], names=[*batch.schema.names, out, score])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out, StringType()), StructField(score, DoubleType())]))


def training_rows(docs: DataFrame) -> DataFrame:
    """Documents that labels may be learned from: crc32(doc_id) mod 4 is not 2."""
    return docs.where(remainder("doc_id", 4) != 2)
