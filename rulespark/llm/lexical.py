"""Ranked lexical search: exact top-k by inner products over sparse ball trees.

A document is a sparse vector of impacts (1000000000*tf) div (1000*tf + 8*m), an item a sparse vector of term weights, and the
score is their inner product in integers. Every task builds ball trees over blocks of its documents. A node's centroid c
and radius r bound the score of everything below it by q.c + |q| r, rounded up; since items touch few terms, terms are also
dealt to groups with a radius each (frequent terms have one of their own), and q.c + sum |q_g| r_g is a second bound. An item's
subtrees are opened best first until the next bound is below its tenth score. Leaves are scored exactly, so the result is what
scoring everything gives.

Defined results: a null or empty text has no term, counts neither in N nor as a result; an item without a term has no
rows; rows of one item id are one item with all their terms; every document row is a document of its own, equal scores by
ascending doc_id, a null id first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rulespark.llm.common import ascii_lower, stored
from rulespark.session import row_bytes

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# The same on UTF-8: ASCII other than letters and digits becomes a space, A-Z small; bytes from 0x80 on stay.
_TERM_BYTES = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(0x100))

CHUNK_BYTES = 4 << 20  # items searched at once, in bytes of their terms; what is broadcast never exceeds this and one item
BLOCK_ROWS, BLOCK_TERMS = 8192, 1 << 20  # a ball tree closes at either, one document included
LEAF_ROWS = 32
GROUPS = 256
MERGE_PARTS = 64  # an item's candidates of all tasks are cut to k in this many parts before they meet

COUNTS = "doc_id long, n long, ids array<int>, tfs array<int>"
FOUND = "item int, doc_id long, score long"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, terms): the distinct terms of each item."""
    found = F.regexp_extract_all(ascii_lower(F.col(text_col)), F.lit(TERM), F.lit(0))
    each = items.select(F.col(id_col).alias("item_id"), F.explode(found).alias("term")).distinct()
    return each.groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms"))


def count_terms(docs: DataFrame, id_col: str, text_col: str, vocabulary) -> DataFrame:
    """(doc_id, n, ids, tfs): a text's number of terms and the counts of those in the broadcast vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            ns, ids, tfs = [], [], []
            for text in batch.column(1):
                words = terms_of(text.as_buffer().to_pybytes()) if text.is_valid else ()
                kept = [(known[w], c) for w, c in Counter(words).items() if w in known]
                ns.append(len(words))
                ids.append([i for i, _ in kept])
                tfs.append([c for _, c in kept])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(ns, pa.int64()), pa.array(ids, kind), pa.array(tfs, kind)],
                names=["doc_id", "n", "ids", "tfs"],
            )

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(count, COUNTS)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Rows:
    """Sparse rows in compressed form; every row has an entry."""

    def __init__(self, ptr: np.ndarray, idx: np.ndarray, val: np.ndarray):
        self.ptr, self.idx, self.val = ptr, idx, val

    def __len__(self) -> int:
        return len(self.ptr) - 1

    def take(self, rows: np.ndarray) -> Rows:
        size = self.ptr[rows + 1] - self.ptr[rows]
        ptr = np.concatenate(([0], np.cumsum(size)))
        at = np.arange(ptr[-1]) + np.repeat(self.ptr[rows] - ptr[:-1], size)
        return Rows(ptr, self.idx[at], self.val[at])

    def dot(self, dense: np.ndarray) -> np.ndarray:
        return np.add.reduceat(dense[self.idx] * self.val, self.ptr[:-1])


class Ball:
    __slots__ = ("bounds", "rows", "kids")

    def __init__(self, bounds: np.ndarray, rows: np.ndarray, kids: tuple[Ball, ...]):
        self.bounds, self.rows, self.kids = bounds, rows, kids


class Space:
    """The items in the space of terms, once as vectors and once as lengths over the term groups."""

    def __init__(self, queries: Rows, dims: int, group: np.ndarray):
        self.queries, self.dims, self.group = queries, dims, group
        self.groups = int(group.max()) + 1
        item = np.repeat(np.arange(len(queries)), np.diff(queries.ptr))
        cells = np.bincount(item * self.groups + group[queries.idx], weights=queries.val**2, minlength=len(queries) * self.groups)
        parts = cells.reshape(len(queries), self.groups)
        self.lengths, self.part_lengths = np.sqrt(parts.sum(axis=1)), np.sqrt(parts)


def term_groups(dfs: np.ndarray, most: int = GROUPS) -> np.ndarray:
    """The commonest terms are alone, the others share the second half of the groups in turn."""
    order = np.argsort(-dfs, kind="stable")
    group = np.empty(len(dfs), np.int64)
    alone = len(dfs) if len(dfs) <= most else most // 2
    group[order[:alone]] = np.arange(alone)
    group[order[alone:]] = alone + np.arange(len(dfs) - alone) % (most - most // 2)
    return group


def ball_tree(x: Rows, members: np.ndarray, space: Space, leaf: int = LEAF_ROWS) -> Ball:
    """A tree over the rows `members` of x; each node holds an upper bound of the inner product for every item.

    Rounding: every sum below has at most `terms` terms, so its relative error is under terms * 2^-52. The squared distances are
    differences, so their error is taken from their parts and added before the root; the bound is then raised by as much again.
    """
    own = x.take(members)
    slip = 4 * (space.dims + 16) * 2.0 ** -52
    square = np.add.reduceat(own.val * own.val, own.ptr[:-1])
    centre = np.bincount(own.idx, weights=own.val, minlength=space.dims) / len(own)
    norm = float(centre @ centre)
    slack = slip * (float(square.max()) + norm)
    apart = square - 2 * own.dot(centre) + norm
    radius = math.sqrt(max(0.0, float(apart.max())) + slack)
    row = np.repeat(np.arange(len(own)), np.diff(own.ptr))
    moved = own.val * own.val - 2 * own.val * centre[own.idx]
    cells = np.bincount(row * space.groups + space.group[own.idx], weights=moved, minlength=len(own) * space.groups)
    norms = np.bincount(space.group, weights=centre * centre, minlength=space.groups)
    radii = np.sqrt(np.maximum(0.0, cells.reshape(len(own), space.groups).max(axis=0) + norms) + slack)
    near = space.queries.dot(centre)
    bounds = (near + np.minimum(space.lengths * radius, space.part_lengths @ radii)) * (1 + slip) + 1
    kids: tuple[Ball, ...] = ()
    if len(own) > leaf:
        # two far apart rows give a direction, its median halves the node: depth is logarithmic, equal rows included
        def dense(i: int) -> np.ndarray:
            cut = slice(own.ptr[i], own.ptr[i + 1])
            return np.bincount(own.idx[cut], weights=own.val[cut], minlength=space.dims)

        one = dense(int(apart.argmax()))
        other = dense(int((square - 2 * own.dot(one)).argmax()))
        order = np.argsort(own.dot(one - other), kind="stable")
        half = len(order) // 2
        kids = tuple(ball_tree(x, members[part], space, leaf) for part in (order[:half], order[half:]))
    return Ball(bounds, members, kids)


class Best:
    """The k best (score, least id first) of one item."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    def floor(self) -> int:
        return self.heap[0][0] if len(self.heap) == self.k else 1

    def add(self, score: int, doc_id: int | None) -> None:
        entry = (score, 1, 0) if doc_id is None else (score, 0, -doc_id)
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapq.heapreplace(self.heap, entry)

    def rows(self) -> Iterator[tuple[int, int | None]]:
        return ((s, None if null else -i) for s, null, i in self.heap)


def search_tree(tree: Ball, item: int, query: np.ndarray, exact: Rows, doc_ids: list, best: Best) -> int:
    """Opens subtrees best first; returns the number of rows scored. `query` and `exact` are integers."""
    scored, tie = 0, 0
    heap = [(-tree.bounds[item], tie, tree)]
    while heap and -heap[0][0] >= best.floor():
        ball = heapq.heappop(heap)[2]
        for kid in ball.kids:
            if kid.bounds[item] >= best.floor():
                tie += 1
                heapq.heappush(heap, (-kid.bounds[item], tie, kid))
        if not ball.kids:
            scores = exact.take(ball.rows).dot(query)
            scored += len(scores)
            for i in np.flatnonzero(scores >= best.floor()):
                best.add(int(scores[i]), doc_ids[ball.rows[i]])
    return scored


class Index:
    """What a task needs of the items and the corpus: a few arrays over the chunk's vocabulary."""

    def __init__(self, item_ids: list[list[int]], dfs: list[int], n_docs: int, n_terms: int, k: int, weights: list[int] | None = None):
        self.n_docs, self.n_terms, self.k = n_docs, n_terms, k
        weights = [weight(n_docs, df) for df in dfs] if weights is None else weights
        self.weights = np.array(weights, np.int64)
        self.root = np.sqrt(self.weights)  # sqrt(w) on both sides: the product is the same, the bound closer
        ptr = np.concatenate(([0], np.cumsum([len(i) for i in item_ids])))
        idx = np.concatenate([np.array(i, np.int64) for i in item_ids])
        self.queries = Rows(ptr, idx, self.root[idx])
        self.space = Space(self.queries, len(weights), term_groups(np.array(dfs, np.int64)))

    def search_block(self, doc_ids: list, ns: np.ndarray, ptr: np.ndarray, ids: np.ndarray, tfs: np.ndarray, best: list[Best], leaf: int = LEAF_ROWS) -> int:
        m = 100 - 90 + (90 * ns * self.n_docs) // self.n_terms
        impact = (1000000000 * tfs) // (1000 * tfs + 8 * np.repeat(m, np.diff(ptr)))
        exact = Rows(ptr, ids, impact)
        tree = ball_tree(Rows(ptr, ids, impact * self.root[ids]), np.arange(len(doc_ids)), self.space, leaf)
        query, scored = np.zeros(len(self.weights), np.int64), 0
        for item in range(len(self.queries)):
            on = self.queries.idx[self.queries.ptr[item] : self.queries.ptr[item + 1]]
            query[on] = self.weights[on]
            scored += search_tree(tree, item, query, exact, doc_ids, best[item])
            query[on] = 0
        return scored


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows that hold a term of the vocabulary, in blocks of bounded size."""
    doc_ids, ns, ids, tfs, size = [], [], [], [], 0

    def block():
        ptr = np.concatenate(([0], np.cumsum([len(i) for i in ids])))
        return doc_ids, np.array(ns, np.int64), ptr, np.concatenate(ids).astype(np.int64), np.concatenate(tfs).astype(np.int64)

    for batch in batches:
        found, counts = batch.column(2), batch.column(3)
        at, flat, many = found.offsets.to_numpy(), found.values.to_numpy(), counts.values.to_numpy()
        first = counts.offsets.to_numpy()
        for row, (doc_id, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            a, b = at[row], at[row + 1]
            if a == b:
                continue
            doc_ids.append(doc_id)
            ns.append(n)
            ids.append(flat[a:b])
            tfs.append(many[first[row] : first[row] + b - a])
            size += b - a
            if len(doc_ids) >= BLOCK_ROWS or size >= BLOCK_TERMS:
                yield block()
                doc_ids, ns, ids, tfs, size = [], [], [], [], 0
    if doc_ids:
        yield block()


def _search(counted: DataFrame, index) -> DataFrame:
    """(item, doc_id, score): each task's k best of every item of the broadcast index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        best = [Best(own.k) for _ in range(len(own.queries))]
        for block in _blocks(batches):
            own.search_block(*block, best)
        rows = [(i, doc_id, score) for i, b in enumerate(best) for score, doc_id in b.rows()]
        if rows:
            item, doc_id, score = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc_id, pa.int64()), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return counted.mapInArrow(run, FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    parts = found.withColumn("part", F.spark_partition_id() % MERGE_PARTS)
    near = parts.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))).where(F.col("rank") <= k)
    last = near.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return last.select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above zero.

    Items are searched in chunks of at most CHUNK_BYTES of terms (an item is never split), so the broadcast vocabulary is
    bounded however many there are; each chunk reads the documents once and then their counts of its terms.
    """
    spark = docs.sparkSession
    terms = stored(item_terms(items, item_id, item_text), "item_terms")
    chunks = max(1, math.ceil((terms.agg(F.sum(row_bytes(terms))).first()[0] or 0) / CHUNK_BYTES))
    out = None
    for chunk in range(chunks):
        asked = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(chunks)) == chunk).orderBy("item_id").collect()
        if not asked:
            continue
        known = {w: i for i, w in enumerate(sorted({t for row in asked for t in row["terms"]}))}
        vocabulary = spark.sparkContext.broadcast({w.encode(): i for w, i in known.items()})
        counted = stored(count_terms(docs, doc_id, doc_text, vocabulary), "term_counts")
        n_docs, n_terms = counted.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        if not n_docs:
            continue
        dfs = {r["id"]: r["df"] for r in counted.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("df")).collect()}
        counts = [dfs.get(i, 0) for i in range(len(known))]
        index = spark.sparkContext.broadcast(Index([[known[t] for t in row["terms"]] for row in asked], counts, n_docs, n_terms, k))
        names = spark.createDataFrame([(i, row["item_id"]) for i, row in enumerate(asked)], "item int, item_id " + terms.schema["item_id"].dataType.simpleString())
        found = _search(counted, index).join(F.broadcast(names), "item").select("item_id", "doc_id", "score")
        found = stored(_top(found, k), "ranked")
        out = found if out is None else out.unionByName(found)
    if out is None:
        kind = terms.schema["item_id"].dataType.simpleString()
        out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return out


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '" + TERM + "')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
total AS (SELECT count(*) FILTER (len(words) > 0) AS n_docs, CAST(sum(len(words)) AS BIGINT) AS n_terms FROM d),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(words) AS n, unnest(words) AS term FROM d) GROUP BY doc_id, n, term),
df AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, total GROUP BY term),
asked AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark),
scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN df USING (term) JOIN tf USING (term), total GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10"""
