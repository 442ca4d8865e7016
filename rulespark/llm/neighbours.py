"""Nearest neighbours: NN-descent builds a graph by Spark joins, queries walk it greedily, blocks prove what the walk found."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from rulespark.llm.common import stored
from rulespark.session import small_side

DEGREE = 24  # neighbours kept for a node
PICKED = 12  # neighbours of a node that join a round
BLOCK = 64  # nodes compared with each other to start the graph
ORDERS = 4  # random orders the graph is started from
BITS = 24  # hyperplanes of an order
SETTLED = 0.02  # share of the edges that may still be new
BEAM = 48  # nodes a query keeps
STEP = 12  # nodes a query expands at a time
PIVOTS = 256  # nodes that the blocks of the check lie around
PACK = 1_024  # nodes or queries of a block


def valid(vector: Column) -> Column:
    """True for vectors with finite components that are not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance in double precision."""
    square = lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(F.zip_with(a, b, square), F.lit(0.0), lambda s, x: s + x))


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    """A binary column of vectors as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _distances(x: np.ndarray) -> np.ndarray:
    """Distances between all rows of a small block."""
    x = x.astype(np.float64)
    norm = (x * x).sum(1)
    return np.sqrt(np.maximum(norm[:, None] + norm[None, :] - 2 * (x @ x.T), 0)).astype(np.float32)


def packed(nodes: DataFrame) -> tuple[DataFrame, type]:
    """(id, packed) with the vectors' own components as bytes, and their type: no row depends on another's size."""
    kind = np.float32 if isinstance(nodes.schema["vec"].dataType.elementType, T.FloatType) else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(kind)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], names=["id", "packed"])

    return nodes.select("id", "vec").mapInArrow(run, "id bigint, packed binary"), kind


def _codes(batch: pa.RecordBatch, order: int, kind: type) -> np.ndarray:
    x = _matrix(batch.column(1), kind).astype(np.float64)
    planes = np.random.default_rng(order).standard_normal((x.shape[1], BITS))
    return ((x - x.mean(1, keepdims=True)) @ planes > 0) @ (np.int64(1) << np.arange(BITS)[::-1])


def start_edges(vectors: DataFrame, kind: type) -> DataFrame:
    """(v, u, d) of near nodes: in each random order by hyperplane signs, blocks of consecutive nodes are compared.

    Blocks have BLOCK nodes however many share their signs, so no bucket can grow.
    """

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for order in range(ORDERS):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(batch.num_rows, order), pa.int32()), pa.array(_codes(batch, order, kind), pa.int64()), *batch.columns], names=["order", "code", "id", "packed"]
                    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def close(rows: list) -> pa.RecordBatch:
            ids = np.array([r[0] for r in rows], np.int64)
            d = _distances(np.frombuffer(b"".join(r[1] for r in rows), kind).reshape(len(rows), -1))
            np.fill_diagonal(d, np.inf)
            k = min(DEGREE, len(rows) - 1)
            near = np.argpartition(d, k - 1, axis=1)[:, :k] if k else np.empty((len(rows), 0), np.int64)
            far = np.take_along_axis(d, near, 1)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)), pa.array(ids[near].ravel()), pa.array(far.ravel())], names=["v", "u", "d"])

        for batch in batches:
            held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            while len(held) >= 2 * BLOCK:
                yield close(held[:BLOCK])
                held = held[BLOCK:]
        if len(held) > 1:
            yield close(held)

    placed = vectors.mapInArrow(coded, "order int, code bigint, id bigint, packed binary")
    sorted_ = placed.repartitionByRange("order", "code", "id").sortWithinPartitions("order", "code", "id")
    return sorted_.select("id", "packed").mapInArrow(compare, "v bigint, u bigint, d float")


def _nearest(edges: DataFrame, key: str, order: list, most: int) -> DataFrame:
    """The first rows of each key; Spark cuts them before the shuffle too, so a hub is cut where its rows are."""
    return edges.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= most).drop("place")


def build(nodes: DataFrame) -> DataFrame:
    """(v, u, d): up to DEGREE near nodes of every node, from nodes (id, vec).

    NN-descent: a round takes PICKED edges of every node, new ones first. A node's picked neighbours and those who picked
    it are brought together with their vectors, all pairs with a new one are compared, and those nearer than a node's
    worst neighbour are kept. A hub is met by its followers in parts of PICKED, all the new ones in the same round, each with
    the hub's own neighbours. An edge stays new until it was picked; rounds go on until SETTLED. What moves is a bounded
    number of vectors per edge picked and the improvements.
    """
    vectors, kind = packed(nodes)
    vectors = stored(vectors, "vectors")
    first = start_edges(vectors, kind).groupBy("v", "u").agg(F.min("d").alias("d"))
    graph = stored(_nearest(first, "v", ["d", "u"], DEGREE).withColumn("new", F.lit(True)), "graph")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            centre, part = table.column("centre").to_numpy(), table.column("part").to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(centre) != 0) | (np.diff(part) != 0)) + 1).tolist()]
            rest = table.slice(edges[-1]).to_batches()[0] if len(centre) else None
            yield from pairs(table, [*edges])
        if rest is not None and rest.num_rows:
            yield from pairs(pa.Table.from_batches([rest]), [0, rest.num_rows])

    def pairs(table: pa.Table, edges: list[int]) -> Iterator[pa.RecordBatch]:
        if len(edges) < 2:
            return
        member = table.column("member").to_numpy()
        fresh = table.column("new").to_numpy()
        worst = table.column("worst").to_numpy()
        x = _matrix(pa.concat_arrays(table.column("packed").chunks), kind)
        out = []
        for a, b in zip(edges, edges[1:]):
            if b - a < 2 or not fresh[a:b].any():
                continue
            d = _distances(x[a:b])
            ok = (d < worst[a:b, None]) & (fresh[a:b, None] | fresh[None, a:b]) & (member[a:b, None] != member[None, a:b])
            i, j = np.nonzero(ok)
            out.append((member[a + i], member[a + j], d[i, j]))
        if out:
            v, u, d = (np.concatenate(c) for c in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(u), pa.array(d)], names=["v", "u", "d"])

    while True:
        total, fresh = graph.agg(F.count(F.lit(1)), F.count(F.when(F.col("new"), 1))).first()
        if fresh <= SETTLED * total:
            break
        worst = graph.groupBy("v").agg(F.when(F.count(F.lit(1)) >= DEGREE, F.max("d")).otherwise(F.lit(float("inf"))).cast("float").alias("worst"))
        carried = vectors.join(worst, vectors["id"] == worst["v"], "left").select("id", "packed", F.coalesce("worst", F.lit(float("inf")).cast("float")).alias("worst"))
        first_new = lambda key, other: F.row_number().over(Window.partitionBy(key).orderBy(F.col("new").desc(), "d", other))
        placed = graph.withColumn("place", first_new("v", "u"))
        picked = placed.where(F.col("place") <= PICKED)
        forward = picked.select(F.col("v").alias("centre"), F.col("u").alias("member"), "new")
        backward = picked.select(F.col("u").alias("centre"), F.col("v").alias("member"), "new", "d").withColumn("place", first_new("centre", "member"))
        backward = backward.where(F.col("new") | (F.col("place") <= PICKED)).select("centre", "member", "new", F.floor((F.col("place") - 1) / PICKED).cast("int").alias("part"))
        parts = backward.groupBy("centre").agg(F.max("part").alias("parts"))
        forward = forward.join(parts, "centre", "left").select("centre", "member", "new", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(0)))).alias("part"))
        both = forward.union(backward.select("centre", "member", "new", "part")).groupBy("centre", "part", "member").agg(F.max("new").alias("new"))
        groups = both.join(carried, both["member"] == carried["id"]).select("centre", "part", "member", "new", "worst", "packed")
        better = groups.repartition("centre", "part").sortWithinPartitions("centre", "part").mapInArrow(compare, "v bigint, u bigint, d float")
        known = placed.select("v", "u", "d", (F.col("new") & (F.col("place") > PICKED)).alias("new"))
        merged = known.union(better.select("v", "u", "d", F.lit(True).alias("new"))).groupBy("v", "u").agg(F.min("d").alias("d"), F.min("new").alias("new"))
        graph = stored(_nearest(merged, "v", ["d", "u"], DEGREE), "graph")
    return graph.select("v", "u", "d")


def _blocks(rows: DataFrame, kind: type, pivots: np.ndarray, extra: str = "") -> DataFrame:
    """(ids, packed, extra): rows (id, packed, extra) near the same pivot together, in blocks of up to PACK."""
    schema = rows.schema

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = pivots - pivots.mean(0)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("packed"), kind).astype(np.float64) - pivots.mean(0)
                with np.errstate(all="ignore"):
                    place = np.argmin((at * at).sum(1) - 2 * (x @ at.T), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), *batch.columns], names=["pivot", *schema.names])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(held: pa.Table) -> pa.RecordBatch:
            arrays = [held["id"].to_numpy().tobytes(), b"".join(held["packed"].to_pylist()), *([held[extra].to_numpy().tobytes()] if extra else [])]
            return pa.RecordBatch.from_arrays([pa.array([a], pa.binary()) for a in arrays], names=["ids", "packed", *([extra] if extra else [])])

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]).drop_columns("pivot")
            held = table if held is None else pa.concat_tables([held, table])
            while held.num_rows >= PACK:
                yield close(held.slice(0, PACK))
                held = held.slice(PACK)
        if held is not None and held.num_rows:
            yield close(held)

    placed = rows.mapInArrow(near, "pivot int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema))
    together = placed.repartitionByRange("pivot", "id").sortWithinPartitions("pivot", "id")
    return together.mapInArrow(pack, "ids binary, packed binary" + (f", {extra} binary" if extra else ""))


def missed(vectors: DataFrame, kind: type, asked: DataFrame, k: int) -> DataFrame:
    """(q, node): every node that may be among the k nearest of a query, from vectors (id, packed) and asked (id, packed, bound).

    A query's bound is the distance of the k-th it has found. Blocks of nodes meet blocks of queries; queries whose bound does
    not reach a block's ball are left out, the others are compared with all its nodes. Comparisons allow for rounding,
    so a node is left out only if it is farther than the bound, or than k others of its block.
    """
    some = vectors.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).toArrow().combine_chunks()
    if not some.num_rows:
        return vectors.sparkSession.createDataFrame([], "q long, node long")
    pivots = _matrix(some["packed"].combine_chunks(), kind).astype(np.float64)
    eps = np.finfo(np.float64).eps

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(batch.num_columns))):
                ids, packed, asking, there, bounds = (c.as_buffer() for c in row)
                ids, asking, bounds = np.frombuffer(ids, np.int64), np.frombuffer(asking, np.int64), np.frombuffer(bounds, np.float64)
                x, y = (np.frombuffer(b, kind).reshape(n, -1).astype(np.float64) for b, n in ((packed, len(ids)), (there, len(asking))))
                with np.errstate(all="ignore"):
                    centre = x.mean(0)
                    lost = 8 * eps * (np.sqrt((x * x).sum(1)).max() + np.sqrt((y * y).sum(1)) + np.sqrt(centre @ centre))
                    x, y = x - centre, y - centre
                    nx, ny = (x * x).sum(1), (y * y).sum(1)
                    slack = 8 * (x.shape[1] + 8) * eps
                    reach = np.flatnonzero(~(np.sqrt(ny) * (1 - slack) - np.sqrt(nx.max()) * (1 + slack) > bounds + lost))
                    if not len(reach):
                        continue
                    asking, bounds, y, ny, lost = asking[reach], bounds[reach], y[reach], ny[reach], lost[reach]
                    d = ny[:, None] + nx[None, :] - 2 * (y @ x.T)
                    most = np.square(bounds + lost) + slack * (ny + nx.max())
                    hit = ~(d > most[:, None])
                    for i in np.flatnonzero(hit.sum(1) > k):
                        worst = np.sqrt(np.maximum(np.partition(d[i], k - 1)[k - 1], 0) + slack * (ny[i] + nx.max())) + 2 * lost[i]
                        hit[i] &= ~(d[i] > worst * worst + slack * (ny[i] + nx.max()))
                i, j = np.nonzero(hit)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(asking[i]), pa.array(ids[j])], names=["q", "node"])

    there = _blocks(asked, kind, pivots, "bound").select(F.col("ids").alias("asking"), F.col("packed").alias("there"), "bound")
    there = stored(there, "asked")
    return stored(_blocks(vectors, kind, pivots), "blocks").crossJoin(small_side(there)).mapInArrow(compare, "q long, node long")


def search(df: DataFrame, id_col: str, vec_col: str, is_query: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows for each query row, ties to the smaller id.

    Equal vectors are one node with its k + 1 smallest ids, so a vector that thousands share is one node and its
    copies are found exactly. A query starts at its own node and its neighbours and expands the STEP nearest nodes not yet
    expanded, keeping BEAM, until nothing nearer turns up. The walk's k-th distance bounds the check by `missed`, which
    finds what a graph of such vectors did not lead to. Distances are on the original vectors in double
    precision. Invalid vectors (null, zero, null or non-finite components) and null ids take no part; rows of one id
    are separate candidates, none of them for its own id; an empty table gives an empty result.
    """
    rows = df.where(F.col(id_col).isNotNull() & valid(F.col(vec_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), is_query.alias("asks"))
    copies = Window.partitionBy("vec").orderBy("id")
    members = rows.select("id", "vec").withColumn("place", F.row_number().over(copies)).where(F.col("place") <= k + 1)
    # An id may have several vectors, so nodes are numbered; the numbers are fixed by being written.
    nodes = stored(members.where("place = 1").select(F.monotonically_increasing_id().alias("id"), "vec"), "nodes")
    members = stored(members.join(nodes.select(F.col("id").alias("node"), F.col("vec").alias("at")), F.col("vec") == F.col("at")).select("node", "id"), "members")
    queries = stored(rows.where("asks").join(nodes.select(F.col("id").alias("node"), F.col("vec").alias("at")), F.col("vec") == F.col("at")).select(F.col("id").alias("q"), "vec", "node").distinct(), "queries")
    graph = build(nodes)
    both = graph.select("v", "u").union(graph.select(F.col("u").alias("v"), F.col("v").alias("u"))).distinct()
    both = stored(_nearest(both.join(graph, ["v", "u"], "left"), "v", [F.col("d").isNull(), "d", "u"], 2 * DEGREE).select("v", "u"), "walk")

    def measured(pairs: DataFrame) -> DataFrame:
        near = pairs.join(nodes.select(F.col("id").alias("node"), F.col("vec").alias("there")), "node").join(queries.select("q", F.col("vec").alias("here")).distinct(), "q")
        return near.select("q", "node", distance(F.col("here"), F.col("there")).alias("d"))

    state = stored(measured(queries.select("q", "node").distinct()).withColumn("open", F.lit(True)), "beam")
    while True:
        expand = _nearest(state.where("open"), "q", ["d", "node"], STEP).select("q", "node")
        reached = expand.join(both, expand["node"] == both["v"]).select("q", F.col("u").alias("node")).distinct()
        fresh = measured(reached.join(state.select("q", "node"), ["q", "node"], "left_anti")).withColumn("open", F.lit(True))
        closed = state.join(expand.withColumn("done", F.lit(True)), ["q", "node"], "left").select("q", "node", "d", (F.col("open") & F.col("done").isNull()).alias("open"))
        state = stored(_nearest(closed.union(fresh), "q", ["d", "node"], BEAM), "beam")
        if not state.where("open").limit(1).count():
            break
    walked = _ranked(state, members, k).groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("d"))
    bound = F.when(F.col("n") >= k, F.col("d")).otherwise(F.lit(float("inf")))
    vectors, kind = packed(nodes)
    asked, _ = packed(queries.select(F.col("q").alias("id"), "vec"))
    nodes_of_id = queries.groupBy("q").agg(F.countDistinct("node").alias("n")).agg(F.max("n")).first()[0] or 0
    asked = asked.distinct().join(walked.select(F.col("q").alias("id"), bound.alias("bound")), "id", "left")
    more = missed(stored(vectors, "vectors"), kind, stored(asked.select("id", "packed", F.coalesce("bound", F.lit(float("inf"))).alias("bound")), "bounds"), k + nodes_of_id)
    fresh = measured(stored(more.distinct(), "more").join(state.select("q", "node"), ["q", "node"], "left_anti"))
    found = _ranked(state.select("q", "node", "d").union(fresh), members, k)
    return found.select(F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", F.col("d").alias("score"))


def _ranked(near: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """The k nearest rows of each query, from its nodes (q, node, d)."""
    found = near.join(members.select("node", F.col("id").alias("vec_id")), "node").where("vec_id <> q")
    place = F.row_number().over(Window.partitionBy("q").orderBy("d", "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)
