"""Mixing sources to target weights by systematic sampling; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rulespark.llm.common import WORD, stored, taken_name

WEIGHTS = (5, 2, 1)  # by the source's rank, repeating
SHARE = 1.5  # words of the mix as a share of all words
REPEAT = 2  # no source, and so no document, is taken more often
UNIT = 24  # rates and offsets are integers of 2^-24 copies, so prefix sums are exact


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(keys: DataFrame, col: str) -> DataFrame:
    """keys with `rank` from 0 by code point, null last: range partitions are sorted apart and offset by their sizes."""
    parts = keys.sparkSession.sparkContext.defaultParallelism
    order = [F.col(col).isNull(), F.col(col)]
    placed = stored(keys.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranges")
    before = placed.groupBy("part").count().withColumn("before", F.sum("count").over(Window.orderBy("part")) - F.col("count"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return placed.withColumn("place", place).join(F.broadcast(before), "part").withColumn("rank", F.col("place") + F.col("before")).drop("part", "place", "count", "before")


def source_targets(df: DataFrame, source: str, size: str) -> DataFrame:
    """One row per source: source_size, weight, target, rate (2^-24 copies a document).

    Sources share SHARE of all words by weight; a target stops at REPEAT times its source and the excess is shared
    again until none is above. Each round is two sums over the table of sources.
    """
    sums = df.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    table = ranked(sums, "source").withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int")))
    table = stored(table.drop("rank"), "sources")
    total = (table.agg(F.sum("source_size")).first()[0] or 0) * SHARE
    level, full = F.lit(0.0), None
    while True:
        above = F.lit(False) if full is None else full
        taken, weight, count = table.agg(
            F.sum(F.when(above, REPEAT * F.col("source_size")).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight"))), F.count(F.when(above, 1))
        ).first()
        if not weight:
            break
        level = F.lit(total - taken) * F.col("weight") / F.lit(float(weight))
        now = above | (F.col("source_size") * REPEAT < level)
        if table.where(now).count() == count:
            break
        # the set of full sources only grows; it is kept as a condition on the ratio the last of them has
        ratio = table.where(now).agg(F.max(F.col("source_size") * REPEAT / F.col("weight"))).first()[0]
        full = F.col("source_size") * REPEAT / F.col("weight") <= ratio
    target = F.least(level, (F.col("source_size") * REPEAT).cast("double"))
    rate = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * (1 << UNIT))).otherwise(0).cast("long")
    return table.withColumn("target", target).withColumn("rate", rate)


def _band(size: Column) -> Column:
    """Documents of like size: the octave and three more bits."""
    octave = F.length(F.bin(size))
    return octave * 16 + F.call_function("shiftright", size, F.greatest(octave - 4, F.lit(0))).cast("int")


def _draw(text: Column) -> Column:
    """A fixed number in 0 .. 2^24 - 1 from a text."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 6), 16, 10).cast("long")


def mix(df: DataFrame, id_col: str = "doc_id", source: str = "source", size: str = "size") -> DataFrame:
    """df with source_size, target, copies and taken (copies x size).

    Systematic sampling: within a source, documents lie in order of size band and a hash of the id; each adds its
    expected copies to a prefix sum that starts at one fixed random offset per source, and is taken once per integer
    the sum crosses. Order by size keeps the words taken close to the target. Prefix sums are taken in slices of a
    source (size band x 256 hash values) and offset by the slices before, so no task holds a source. A null source is a
    source, a null size counts as 0, a null id is an id; rows equal in all three are interchangeable. An empty table
    gives an empty one. Names that the result adds must not be in df.
    """
    band, draw, piece, place, key = taken_name(df, "band", "draw", "piece", "place", "key")
    sized = df.withColumn(size, F.coalesce(F.col(size), F.lit(0)).cast("long"))
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    sliced = sized.withColumn(band, _band(F.col(size))).withColumn(draw, F.md5(ident.cast("binary"))).withColumn(piece, F.substring(draw, 1, 2)).withColumn(key, F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("")))
    slices = sliced.groupBy(key, band, piece).count()
    before = F.sum("count").over(Window.partitionBy(key).orderBy(band, piece)) - F.col("count")
    named = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))  # never null, so that the join keeps the window's partitioning
    targets = source_targets(sized, source, size).withColumn("named", named)
    plan = stored(
        slices.withColumn("before", before).drop("count").join(targets, F.col(key) == F.col("named"))
        .select(F.col(key), F.col(band), F.col(piece), "before", "source_size", "target", "rate",
                _draw(F.concat(F.lit("offset:"), F.coalesce(F.col("source"), F.lit("null")))).alias("offset")),
        "slices",
    )
    here = F.row_number().over(Window.partitionBy(key, band, piece).orderBy(draw, F.col(id_col), F.col(size)))
    rows = sliced.withColumn(place, here).alias("r").join(
        plan.alias("p"),
        (F.col(f"r.{key}") == F.col(f"p.{key}")) & (F.col(f"r.{band}") == F.col(f"p.{band}")) & (F.col(f"r.{piece}") == F.col(f"p.{piece}")),
    )
    end = (F.col("p.before") + F.col(place)) * F.col("p.rate") + F.col("p.offset")
    copies = F.shiftright(end, UNIT) - F.shiftright(end - F.col("p.rate"), UNIT)
    return rows.select(
        *[F.col(f"r.`{c}`") for c in df.columns], F.col("p.source_size"), F.col("p.target"), copies.alias("copies"),
        (copies * F.col(f"r.{size}")).alias("taken"),
    )


def emit(mixed: DataFrame, copies: str = "copies") -> DataFrame:
    """Each row as often as `copies` says, rows of 0 copies left out."""
    turn = taken_name(mixed, "turn")[0]
    return mixed.where(F.col(copies) > 0).withColumn(turn, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).drop(turn)


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1] AS weight FROM d GROUP BY source),
f AS (SELECT *, 2 * source_size / weight AS ratio, (SELECT sum(source_size) FROM s)::DOUBLE * 1.5 AS total FROM s),
l AS (SELECT a.ratio, max(a.total) - coalesce(sum(2 * b.source_size) FILTER (b.ratio < a.ratio), 0) AS rest,
             sum(b.weight) FILTER (b.ratio >= a.ratio) AS weights FROM (SELECT DISTINCT ratio, total FROM f) a, f b GROUP BY a.ratio),
c AS (SELECT rest, weights FROM l WHERE ratio * weights >= rest ORDER BY ratio LIMIT 1),
t AS (SELECT source, source_size, least(rest * weight / weights::DOUBLE, (2 * source_size)::DOUBLE) AS target FROM f, c),
r AS (SELECT *, CASE WHEN source_size > 0 THEN round(target / source_size * 16777216) ELSE 0 END::BIGINT AS rate,
             ('0x' || substr(md5('offset:' || coalesce(source, 'null')), 1, 6))::BIGINT AS shift FROM t),
o AS (SELECT d.doc_id, d.size, r.source_size, r.target, r.rate, r.shift, row_number() OVER (PARTITION BY d.source ORDER BY
             length(bin(d.size)), d.size >> greatest(length(bin(d.size)) - 4, 0), md5(coalesce(d.doc_id::VARCHAR, 'null')), d.doc_id, d.size) AS place
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, (((place * rate + shift) >> 24) - (((place - 1) * rate + shift) >> 24)) * size AS taken FROM o
"""
