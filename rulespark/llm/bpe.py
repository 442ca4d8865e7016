"""Byte-level BPE over a table: distinct words are shuffled and encoded once, ids return and texts are put together."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from rulespark.llm.common import stored_by

CHUNK_CHARS = 8_000_000  # texts whose words are numbered together: bounds what one group holds, unless one text is longer
BUCKETS = 512  # groups of words by hash; a bucket's distinct words are held by one task


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of least rank, leftmost first, is merged until no pair has a rank."""
    known = ranks.get(word)
    if known is not None:
        return [known]
    if len(word) > 48:
        return _merge_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    get = ranks.get
    none = len(ranks) + 1
    pairs = [get(a + b, none) for a, b in zip(parts, parts[1:])]
    while pairs:
        least = min(pairs)
        if least == none:
            break
        i = pairs.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], none)
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for long words, with a heap of pairs over a linked list: n log n instead of n squared."""
    n = len(word)
    part: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    right = list(range(1, n + 1))
    left = list(range(-1, n - 1))
    heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i]
        if part[i] != a or j >= n or part[j] != b:
            continue
        part[i], part[j] = a + b, None
        right[i] = right[j]
        if right[i] < n:
            left[right[i]] = i
            if (r := ranks.get(part[i] + part[right[i]])) is not None:
                heapq.heappush(heap, (r, i, part[i], part[right[i]]))
        if left[i] >= 0 and (r := ranks.get(part[left[i]] + part[i])) is not None:
            heapq.heappush(heap, (r, left[i], part[left[i]], part[i]))
    return [ranks[p] for p in part if p is not None]


def _squeeze(values: np.ndarray) -> bytes:
    """Non-negative ints as zstd of their byte planes."""
    width = 1 if not len(values) else max(1, (int(values.max()).bit_length() + 7) // 8)
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def _expand(blob: bytes) -> np.ndarray:
    width = blob[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 4), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<u4").astype(np.int64)


_ONE, _TWO, _THREE = 192, 56, 7  # first bytes that stand alone, that need one more, that need two more


def _squeeze_ranks(ranks: np.ndarray) -> bytes:
    """Word ranks, small ones most often: first, second and third bytes and what is larger as separate zstd streams."""
    wide = ranks - _ONE
    far = wide - (_TWO << 8)
    two, three, rest = (wide >= 0) & (far < 0), (far >= 0) & (far < _THREE << 16), far >= _THREE << 16
    first = np.where(wide < 0, ranks, np.where(two, _ONE + (wide >> 8), np.where(three, _ONE + _TWO + (far >> 16), 255)))
    second = np.where(two, wide, far >> 8)[two | three] & 255
    parts = [first.astype(np.uint8), second.astype(np.uint8), (far[three] & 255).astype(np.uint8), far[rest].astype("<u4")]
    blobs = [zstandard.ZstdCompressor(level=3).compress(p.tobytes()) for p in parts]
    return b"".join(len(b).to_bytes(4, "big") + b for b in blobs)


def _expand_ranks(blob: bytes) -> np.ndarray:
    parts, at = [], 0
    for kind in (np.uint8, np.uint8, np.uint8, "<u4"):
        size = int.from_bytes(blob[at : at + 4], "big")
        parts.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[at + 4 : at + 4 + size]), kind).astype(np.int64))
        at += 4 + size
    first, second, third, rest = parts
    two, three, more = (first >= _ONE) & (first < _ONE + _TWO), (first >= _ONE + _TWO) & (first < 255), first == 255
    out = first.copy()
    wide = np.zeros(len(first), np.int64)
    wide[two | three] = second
    out[two] = _ONE + ((first[two] - _ONE) << 8) + wide[two]
    out[three] = _ONE + (_TWO << 8) + ((first[three] - _ONE - _TWO) << 16) + (wide[three] << 8) + third
    out[more] = _ONE + (_TWO << 8) + rest
    return out


def _pack_words(words: list[bytes]) -> bytes:
    sizes = _squeeze(np.fromiter(map(len, words), np.int64, len(words)))
    return len(sizes).to_bytes(4, "big") + sizes + zstandard.ZstdCompressor(level=3).compress(b"".join(words))


def _unpack_words(blob: bytes) -> list[bytes]:
    split = 4 + int.from_bytes(blob[:4], "big")
    ends = np.cumsum(_expand(blob[4:split])).tolist()
    joined = zstandard.ZstdDecompressor().decompress(blob[split:]) if ends and ends[-1] else b""
    return [joined[a:b] for a, b in zip([0, *ends], ends)]


_CHUNKS = "chunk bigint, bucket int, blob binary, ids array<{id}>, n array<bigint>"


def _number_words(df: DataFrame, pattern: str, id_type: str) -> DataFrame:
    """Chunks of texts as rows: bucket -1 has each text's word numbers in order; bucket b the chunk's words in bucket b.

    Words are numbered by frequency. The row of numbers begins with the bucket of each, so a bucket's words, which lie
    in the same order, need no numbers beside them: positions are what the sequences hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        task, turn = TaskContext.get().partitionId(), 0
        ids: list = []
        sizes: list[int] = []
        number: dict[str, int] = {}
        sequence: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal ids, sizes, number, sequence, held, turn
            words = [w.encode() for w in number]
            flat = np.concatenate(sequence)
            by_use = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.int64)
            rank[by_use] = np.arange(len(words))
            bucket = np.fromiter((xxhash.xxh32_intdigest(words[i]) % BUCKETS for i in by_use), np.int64, len(words))
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(BUCKETS + 1)).tolist()
            chunk = task << 24 | turn
            buckets = _squeeze(bucket)
            rows = [(chunk, -1, len(buckets).to_bytes(4, "big") + buckets + _squeeze_ranks(rank[flat]), ids, sizes)]
            for b in range(BUCKETS):
                if edges[b] < edges[b + 1]:
                    rows.append((chunk, b, _pack_words([words[by_use[i]] for i in order[edges[b] : edges[b + 1]]]), None, None))
            ids, sizes, number, sequence, held = [], [], {}, [], 0
            turn += 1
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(id_arrow), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["chunk", "bucket", "blob", "ids", "n"])

        for batch in batches:
            id_arrow = batch.schema.types[0]
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                if ids and held + len(text) > CHUNK_CHARS:
                    yield close()
                found = find(text)
                for w in set(found).difference(number):
                    number[w] = len(number)
                ids.append(i)
                sizes.append(len(found))
                sequence.append(np.fromiter(map(number.__getitem__, found), np.int32, len(found)))
                held += len(text)
        if ids:
            yield close()

    return df.mapInArrow(run, _CHUNKS.format(id=id_type))


def _encode_words(rows: DataFrame, ranks) -> DataFrame:
    """(chunk, bucket, blob): ids of each chunk's words. Rows come sorted by bucket; a word is merged once per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks.value
        current, known = None, {}
        for batch in batches:
            out = []
            for chunk, bucket, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != current:
                    current, known = bucket, {}
                found = []
                for w in _unpack_words(blob):
                    ids = known.get(w)
                    if ids is None:
                        ids = known[w] = merge_word(w, table)
                    found.append(ids)
                sizes = _squeeze(np.fromiter(map(len, found), np.int64, len(found)))
                flat = _squeeze(np.fromiter(chain.from_iterable(found), np.int64))
                out.append((chunk, bucket, len(sizes).to_bytes(4, "big") + sizes + flat))
            kinds = [pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["chunk", "bucket", "blob"])

    return rows.mapInArrow(run, "chunk bigint, bucket int, blob binary")


def token_table(ranks: dict[bytes, int]) -> np.ndarray:
    """Bytes of each token by its id: one entry per rank, a fixed size."""
    table = np.empty(max(ranks.values()) + 1, object)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def _bytes_of(lists: pa.ListArray, tokens: np.ndarray) -> pa.Array:
    edges, values = np.asarray(lists.offsets).tolist(), np.asarray(lists.values)
    return pa.array([b"".join(tokens[values[a:b]].tolist()) for a, b in zip(edges, edges[1:])], pa.binary())


def _reassemble(sequences: DataFrame, coded: DataFrame, id_type: str, ranks, decoded: bool) -> DataFrame:
    """(id, ids) of each text, and its bytes: a chunk's word numbers meet the ids of its words."""
    known: dict = {}  # a worker's token-byte table

    def run(numbers: pa.Table, words: pa.Table) -> pa.Table:
        if decoded and not known:
            known["table"] = token_table(ranks.value)
        sizes, flat = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for blob in words.sort_by("bucket").column("blob").to_pylist():
            split = 4 + int.from_bytes(blob[:4], "big")
            sizes.append(_expand(blob[4:split]))
            flat.append(_expand(blob[split:]))
        size, tokens = np.concatenate(sizes), np.concatenate(flat).astype(np.int32)
        start = np.cumsum(size) - size
        blob = numbers.column("blob")[0].as_py()
        split = 4 + int.from_bytes(blob[:4], "big")
        by_bucket = np.argsort(_expand(blob[4:split]), kind="stable")  # word numbers in the order of the coded words
        place = np.empty(len(by_bucket), np.int64)
        place[by_bucket] = np.arange(len(by_bucket))
        sequence = place[_expand_ranks(blob[split:])]
        n = size[sequence]
        ends = np.cumsum(n)
        take = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n - start[sequence], n)
        offsets = np.concatenate([[0], ends])[np.cumsum([0, *numbers.column("n")[0].as_py()])]
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(tokens[take]))
        texts = [_bytes_of(lists, known["table"])] if decoded else []
        return pa.Table.from_arrays([numbers.column("ids").chunk(0)[0].values, lists, *texts], names=["id", "ids", *["bytes"] * decoded])

    both = sequences.groupBy("chunk").cogroup(coded.groupBy("chunk"))
    return both.applyInArrow(run, f"id {id_type}, ids array<int>" + ", bytes binary" * decoded)


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", *, decoded: bool = False) -> DataFrame:
    """(id, ids): token ids of every whole text, one row per row of df; a null text is empty and has no ids.

    With `decoded` also the bytes of the ids, joined from the token-byte table in the task that put the ids together.

    The global distinct-word shuffle, in compact form. Pre-tokens are exploded inside a task: a chunk of texts becomes
    word numbers in text order (the positions) and its distinct words. Words go by hash to buckets, where each distinct
    word is merged once however many chunks have it; ids go back to the chunks by word number, and texts are put together by
    position. What moves is a chunk's distinct words and their ids, never a row per pre-token, and a frequent word is one
    entry per chunk; the sequences, about a byte and a half a pre-token, are written once in buckets of the chunk number and
    read where the ids arrive. So a lost executor cannot renumber chunks either. Rows need no key: repeated and null ids
    keep their own rows. An empty table gives an empty result.
    """
    spark = df.sparkSession
    id_type = df.schema[id_col].dataType.simpleString()
    chunks = stored_by(_number_words(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), pattern, id_type), "chunks", "chunk")
    shared = spark.sparkContext.broadcast(ranks)
    words = chunks.where("bucket >= 0").select("chunk", "bucket", "blob").repartition("bucket").sortWithinPartitions("bucket", "chunk")
    sequences = chunks.where("bucket < 0").select("chunk", "blob", "ids", "n")
    return _reassemble(sequences, _encode_words(words, shared), id_type, shared, decoded).withColumnRenamed("id", id_col)


def decode(df: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", out: str = "bytes") -> DataFrame:
    """df with `out`, the bytes of its token ids, by the token-byte table, which is broadcast; null ids are empty."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    at = df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_table(shared.value)
        for batch in batches:
            texts = pa.array([b"".join(table[i] for i in ids or ()) for ids in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, out])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out, BinaryType())]))
