"""SimHash near-duplicates by the generalised pigeonhole principle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from rulespark.llm.common import stored, taken_name
from rulespark.llm.graph import components

BITS = 64
DISTANCE = 3
SHINGLE = 3
SEED = 42
PIECE = 1 << 16  # shingles hashed at a time, so that a long text needs no more memory than its own bytes
BLOCK = 16  # bits of a block with an exact histogram; 4 x 65 536 counts are all that estimates need


def fingerprint_of(text: str | None, words: int = SHINGLE) -> int:
    """64-bit SimHash of the text's word shingles, repeats included; a bit is set if it is in over half the hashes."""
    if not text:
        return 0
    tokens = text.encode().lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(tokens) - words + 1)
    starts, ends = starts[:n], ends[min(words, len(tokens)) - 1 :]
    set_bits = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, n, PIECE):
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + PIECE].tolist(), ends[at : at + PIECE].tolist())])
        set_bits += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > n).tobytes(), "big", signed=True)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint of every whole text as a signed long; 0 for null and wordless texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array([fingerprint_of(t.as_py(), words) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], names=["id", "fp"])

    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, fp bigint")


def _bits(fp: np.ndarray) -> np.ndarray:
    """n x 64 zeros and ones; column 0 is the highest bit."""
    return np.unpackbits(fp.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)


def _pack(bits: np.ndarray) -> np.ndarray:
    """Rows of at most 62 bits as longs."""
    return bits.astype(np.int64) @ (np.int64(1) << np.arange(bits.shape[1], dtype=np.int64)[::-1])


def bit_correlation(classes: DataFrame) -> np.ndarray:
    """64 x 64 absolute correlations of the bits over all fingerprints, from sums that each task makes of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS + 1, BITS + 1), np.int64)
        for batch in batches:
            x = np.concatenate([_bits(batch.column(0).to_numpy()), np.ones((batch.num_rows, 1), np.uint8)], axis=1).astype(np.float64)
            total += (x.T @ x).astype(np.int64)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(total.ravel()[cell], pa.int64())], names=["cell", "n"])

    cells = classes.select("fp").mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    total = np.zeros((BITS + 1) ** 2)
    for r in cells:
        total[r.cell] = r.n
    total = total.reshape(BITS + 1, BITS + 1)
    n = max(total[BITS, BITS], 1.0)
    mean = total[BITS, :BITS] / n
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    return np.abs((total[:BITS, :BITS] / n - np.outer(mean, mean)) / np.outer(spread, spread))


def correlated_order(corr: np.ndarray) -> list[int]:
    """All bits in an order that keeps correlated ones together: blocks of BLOCK bits grow from the strongest pair left."""
    left, order = set(range(BITS)), []
    while left:
        free = sorted(left)
        sub = corr[np.ix_(free, free)].copy()
        np.fill_diagonal(sub, -1.0)
        block = [free[i] for i in np.unravel_index(np.argmax(sub), sub.shape)]
        while len(block) < BLOCK:
            rest = sorted(left - set(block))
            block.append(rest[int(np.argmax(corr[np.ix_(rest, block)].sum(1)))])
        order += block
        left -= set(block)
    return order


def block_counts(classes: DataFrame, order: list[int]) -> np.ndarray:
    """counts[b, d, v]: fingerprints whose block b lies at distance d from value v, d up to DISTANCE.

    Histograms of the four blocks (at most 4 x 65 536 rows) come from the cluster; distances follow by the identity
    A N_d = (d+1) N_{d+1} + (w-d+1) N_{d-1}, where A sums over the w values one bit away.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((BITS // BLOCK, 1 << BLOCK), np.int64)
        for batch in batches:
            bits = _bits(batch.column(0).to_numpy())[:, order]
            for b in range(len(sums)):
                sums[b] += np.bincount(_pack(bits[:, b * BLOCK : (b + 1) * BLOCK]), minlength=1 << BLOCK)
        cell = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(sums.ravel()[cell], pa.int64())], names=["cell", "n"])

    rows = classes.select("fp").mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((BITS // BLOCK, DISTANCE + 1, 1 << BLOCK))
    hist = np.zeros(BITS // BLOCK << BLOCK)
    hist[rows["cell"].to_numpy(np.int64)] = rows["n"]
    counts[:, 0] = hist.reshape(-1, 1 << BLOCK)
    values = np.arange(1 << BLOCK)
    for b in range(len(counts)):
        for d in range(DISTANCE):
            near = sum(counts[b, d][values ^ (1 << i)] for i in range(BLOCK))
            counts[b, d + 1] = (near - (BLOCK - d + 1) * (counts[b, d - 1] if d else 0)) / (d + 1)
    return counts.astype(np.float32)


def _partitions(n_parts: int) -> list[slice]:
    edges = [round(i * BITS / n_parts) for i in range(n_parts + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def _masks(width: int, weight: int) -> np.ndarray:
    out = [0]
    level = [(0, 0)]
    for _ in range(weight):
        level = [(m | 1 << b, b + 1) for m, at in level for b in range(at, width)]
        out += [m for m, _ in level]
    return np.array(out, np.int64)


def candidate_costs(bits: np.ndarray, counts: np.ndarray, parts: list[slice], n: float, probe_cost: float) -> np.ndarray:
    """cost[i, t + 1, row]: probes and estimated candidates if partition i is searched up to distance t; t = -1 is free.

    A partition covers parts of blocks; blocks are taken as independent, each giving the share of fingerprints at a
    distance, scaled to the bits of the block that the partition has.
    """
    cost = np.zeros((len(parts), DISTANCE + 2, len(bits)))
    for i, part in enumerate(parts):
        share = np.zeros((DISTANCE + 1, len(bits)))
        share[0] = 1.0
        for b in range(BITS // BLOCK):
            a, z = max(part.start, b * BLOCK), min(part.stop, (b + 1) * BLOCK)
            if a >= z:
                continue
            value = _pack(bits[:, b * BLOCK : (b + 1) * BLOCK])
            own = counts[b][:, value] / max(n, 1.0)
            if z - a < BLOCK:  # a cut block: as likely as the whole to the power of its share of bits
                own = np.cumsum(own, 0) ** ((z - a) / BLOCK)
                own = np.diff(own, axis=0, prepend=0)
            share = np.stack([sum(share[e] * own[d - e] for e in range(d + 1)) for d in range(DISTANCE + 1)])
        near = np.cumsum(share, 0) * n
        for t in range(DISTANCE + 1):
            cost[i, t + 1] = near[t] + probe_cost * len(_masks(part.stop - part.start, t))
    return cost


def allocate(cost: np.ndarray) -> np.ndarray:
    """Thresholds per partition and row, from -1, summing to DISTANCE - partitions + 1 at the least total cost.

    Dynamic programming over partitions on the sum of (threshold + 1); any fingerprint within DISTANCE then lies within
    the threshold of some partition, whatever thresholds the other fingerprint has.
    """
    n_parts, _, rows = cost.shape
    budget = DISTANCE + 1
    best = np.full((budget + 1, rows), np.inf)
    best[0] = 0.0
    picks = []
    for i in range(n_parts):
        options = np.stack([
            np.stack([best[s - t] + cost[i, t] if s >= t else np.full(rows, np.inf) for t in range(DISTANCE + 2)]) for s in range(budget + 1)
        ])
        picks.append(options.argmin(1))
        best = options.min(1)
    out = np.zeros((n_parts, rows), np.int64)
    left = np.full(rows, budget)
    for i in reversed(range(n_parts)):
        out[i] = picks[i][left, np.arange(rows)]
        left = left - out[i]
    return out - 1


def links(classes: DataFrame, n_parts: int | None = None, probe_cost: float = 1.0) -> DataFrame:
    """(a, b), a > b: all pairs of different fingerprints at most DISTANCE bits apart, each at least once.

    Every fingerprint is indexed once per partition and probes with its own thresholds; index and probes meet in one
    join whose condition verifies the distance, so candidates are never written. By the number of fingerprints the
    cheapest of 2, 3 or 4 partitions is chosen: fewer, wider partitions have more probes and fewer candidates. The links are
    the same for each.
    """
    spark = classes.sparkSession
    n = float(classes.count())
    order = correlated_order(bit_correlation(classes))
    counts = block_counts(classes, order)
    if n_parts is None:
        wide = lambda m: BITS // m
        expected = lambda m, t: sum(len(_masks(wide(m), x)) * (probe_cost * 4 + n / 2.0 ** wide(m)) for x in t)
        n_parts = min((expected(2, (1, 1)), 2), (expected(3, (0, 0, 1)), 3), (expected(4, (0, 0, 0, 0)), 4))[1]
    parts = _partitions(n_parts)
    shared = spark.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, 2000) for at in range(0, whole.num_rows, 2000)):
                fp = batch.column(0).to_numpy()
                bits = _bits(fp)[:, order]
                limits = allocate(candidate_costs(bits, shared.value, parts, n, probe_cost))
                for i, part in enumerate(parts):
                    width = part.stop - part.start
                    value = _pack(bits[:, part]) | np.int64(i) << np.int64(40)
                    keys, owners, probes = [value], [fp], [np.zeros(len(fp), bool)]
                    for t in range(DISTANCE + 1):
                        mine = limits[i] == t
                        if mine.any():
                            masks = _masks(width, t)
                            keys.append((value[mine][:, None] ^ masks[None, :]).ravel())
                            owners.append(np.repeat(fp[mine], len(masks)))
                            probes.append(np.ones(len(keys[-1]), bool))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(keys)), pa.array(np.concatenate(owners)), pa.array(np.concatenate(probes))], names=["key", "fp", "probe"]
                    )

    rows = classes.select("fp").mapInArrow(run, "key bigint, fp bigint, probe boolean")
    probes = rows.where("probe").select("key", F.col("fp").alias("a"))
    index = rows.where("not probe").select("key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    return probes.join(index, (probes["key"] == index["key"]) & (F.col("a") > F.col("b")) & near).select("a", "b")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_parts: int | None = None) -> DataFrame:
    """One row per row of df: id, fp, component_id (smallest id reachable over links of at most DISTANCE bits), n_links.

    Equal fingerprints are one class, so copies cost one row however many they are. n_links counts the other
    classes linked to the row's class. Null ids take part and never name a group that has another id; wordless and null
    texts share fingerprint 0; an empty table gives an empty result; repeated rows each get a row.
    """
    found = stored(fingerprints(df, id_col, text_col), "fingerprints")
    classes = stored(found.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    pairs = stored(links(classes, n_parts).distinct(), "links")
    roots = components(pairs)  # fp, root
    degree = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").count()
    linked = stored(roots.join(degree, "fp").join(classes, "fp"), "linked")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    near = stored(linked.join(least, "root").select("fp", "component_id", "root", F.col("count").alias("n_links")), "near")
    lone = classes.join(near.select("fp"), "fp", "left_anti").select("fp", F.col("least").alias("component_id"), F.col("fp").alias("root"), F.lit(0).cast("long").alias("n_links"))
    labels = stored(near.unionByName(lone.select(near.columns)), "labels")
    return found.join(labels, "fp").select(F.col("id").alias(id_col), "fp", "component_id", "root", "n_links")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_per_group(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each near-duplicate group: the smallest id, then the smallest text hash.

    Rows are matched by (id, text hash); rows equal in both count as one.
    """
    ident, key = taken_name(df, "ident", "key")
    keyed = df.withColumn(key, F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).withColumn(ident, F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    both = keyed.select(F.struct(F.col(id_col).alias("i"), F.col(key).alias("k"), F.col(ident).alias("s")).alias("id"), F.col(text_col).alias("text"))
    groups = near_duplicates(both, "id", "text")
    # a null id sorts first among structs, so it names its group only where no other id is there
    best = groups.groupBy("root").agg(F.min_by("id", F.struct(F.col("id.i").isNull(), F.col("id.i"), F.col("id.k"))).alias("id"))
    stays = stored(best.select(F.col("id.s").alias(ident), F.col("id.k").alias(key)).distinct(), "stays")
    return keyed.join(stays, [ident, key], "left_semi").dropDuplicates([ident, key]).select(df.columns)
