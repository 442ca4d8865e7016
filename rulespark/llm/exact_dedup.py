"""Exact deduplication by two Bloom passes; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rulespark.llm.common import ascii_lower, stored, taken_name
from rulespark.session import fits_broadcast

HASHES = 2
BITS_PER_ROW = 16  # at least; about 1 in 70 unique rows then has both positions hit by others
WORDS = 1 << 22  # of 64 positions: a filter with more non-empty ones, or over 64 MB, is joined by word instead of broadcast
HOT = 1000  # a word with more than one hit in so many is broadcast all the same: there are at most HOT of them


def text_sha(text: Column) -> Column:
    """SHA-256 (32 bytes) of the text with A-Z lower-cased; null counts as empty."""
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256))


def _positions(sha: str, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.col(sha), F.lit(i)), F.lit(bits)) for i in range(HASHES)]


def filter_bits(rows: int) -> int:
    """Positions of the filter: a power of two, BITS_PER_ROW or more a row, so that flags stay as rare at any size."""
    bits = 1 << 16
    while bits < BITS_PER_ROW * rows:
        bits *= 2
    return bits


def repeated_filter(hashes: DataFrame, sha: str, bits: int) -> DataFrame:
    """First pass: a counting Bloom filter that saturates at two, as (word, set, hits) rows of 64 positions each.

    Counts are added per position before and after the shuffle, so a hot hash is one row per task; only positions hit
    by two or more rows stay. No document and no hash moves, only positions.
    """
    hit = hashes.select(F.explode(F.array(*_positions(sha, bits))).alias("p")).groupBy("p").count().where("count > 1")
    return hit.groupBy(F.shiftright("p", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("set"), F.sum("count").alias("hits")
    )


def flag_repeated(rows: DataFrame, sha: str, flag: str, words: DataFrame, bits: int, *, room: int = WORDS) -> DataFrame:
    """Second pass: adds `flag`, true when every position of the row's hash was hit twice. No repeated hash is missed.

    `words` comes from repeated_filter. Up to `room` words it is broadcast and no row moves. Beyond, rows meet it by word;
    the few words that many rows hit are broadcast then too, and their rows keep a key of their own, so none is hot.
    """
    parts = [F.broadcast(words)]
    if not fits_broadcast(words, room):
        hot = F.col("hits") > F.lit(words.agg(F.sum("hits")).first()[0] / HOT)
        parts = [F.broadcast(words.where(hot)), words.where(~hot)]
    out, test = rows, F.lit(True)
    key, spare, word, bitset, *held = taken_name(rows, "key", "spare", "word", "set", *[f"held{i}" for i in range(HASHES)])
    for i, p in enumerate(_positions(sha, bits)):
        out = out.withColumn(key, F.shiftright(p, 6)).withColumn(held[i], F.lit(None).cast("long"))
        for part in parts:
            side = part.select(F.col("word").alias(word), F.col("set").alias(bitset))
            out = out.join(side, F.col(key) == F.col(word), "left")
            # a row that found its word looks no further: it goes anywhere
            out = out.withColumn(held[i], F.coalesce(held[i], bitset)).withColumn(spare, -1 - F.abs(F.xxhash64(*rows.columns) % 1_000_003))
            out = out.withColumn(key, F.when(F.col(held[i]).isNotNull(), F.col(spare)).otherwise(F.col(key))).drop(word, bitset, spare)
        test = test & (F.coalesce(F.getbit(F.col(held[i]), (p % 64).cast("int")), F.lit(0)) == 1)
    return out.withColumn(flag, test).drop(key, *held)


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, bits: int | None = None, room: int = WORDS) -> DataFrame:
    """One row per row of df: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the largest id stays.
    A null id never stays while its group has another id; rows equal in id and text are all marked kept (drop_copies
    leaves one of them). An empty table gives an empty result; extra columns are not read. The text is read once:
    what follows works on (id, hash) rows, and only rows flagged by the filter are shuffled by hash. Groups are
    counted map-side and joined back from a table, so a hot group is split like any skewed join.
    """
    id_type = df.schema[id_col].dataType
    keyed = stored(df.select(F.col(id_col).alias("id"), text_sha(F.col(text_col)).alias("sha")), "hashes")
    bits = bits or filter_bits(keyed.count())
    words = stored(repeated_filter(keyed, "sha", bits), "bloom")
    flagged = flag_repeated(keyed, "sha", "again", words, bits, room=room)
    alone = flagged.where("not again").select("id", "sha", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("n"))
    rows = flagged.where("again").select("id", "sha")
    groups = stored(rows.groupBy("sha").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n")), "groups")
    found = rows.join(groups, "sha").select("id", "sha", "keep_id", "n")
    return alone.unionByName(found).select(
        F.col("id").cast(id_type).alias(id_col),
        "keep_id",
        F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, bits: int | None = None, room: int = WORDS) -> DataFrame:
    """df without exact copies, all columns kept. Rows whose hash cannot be repeated pass without any shuffle."""
    sha, again, best = taken_name(df, "sha", "again", "best")
    hashed = df.withColumn(sha, text_sha(F.col(text_col)))
    keyed = stored(hashed.select(sha, id_col), "hashes")
    bits = bits or filter_bits(keyed.count())
    words = stored(repeated_filter(keyed, sha, bits), "bloom")
    maybe = flag_repeated(keyed, sha, again, words, bits, room=room).where(again)
    stays = stored(maybe.groupBy(sha).agg(F.max(id_col).alias(best)), "groups")
    marked = flag_repeated(hashed, sha, again, words, bits, room=room)
    alone = marked.where(~F.col(again)).select(df.columns)
    rows = marked.where(again).join(stays, sha).where(F.col(id_col).eqNullSafe(F.col(best)))
    return alone.unionByName(rows.dropDuplicates([sha]).select(df.columns))
