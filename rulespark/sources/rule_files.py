"""Rule tables on disk: a readable text form and the full parquet form."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rulespark.operators.rule_table import certainty_score
from rulespark.session import small_side

ARTIFACT_VERSION = 1
RULE_LINE = r"^\s*class\s+(\S+)\s+::\s+(.*?)(?:\s+→\s+class\s+\S+)?(?:\s+\|\|\s+masses:\s*(\[.*\]))?\s*$"
LITERAL = r"^(.*\S)\s+(==|<|>)\s+(.*)$"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files of any size, numbered from 0 in each file.

    Splits of a file are read by different tasks. A line's number is its place in its split, found in a window of that split,
    plus the lines of the splits before it: one row per split.
    """
    rows = spark.read.text(path).select(
        F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line")
    )
    sizes = rows.groupBy("file", "split").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("split")) - F.col("n")
    starts = small_side(sizes.select("file", "split", before.alias("before")))
    place = F.row_number().over(Window.partitionBy("file", "split").orderBy("at")) - 1
    placed = rows.withColumn("place", place).join(starts, ["file", "split"])
    return placed.select("file", (F.col("before") + F.col("place")).cast("bigint").alias("line_no"), "line")


def read_rules_text(spark: SparkSession, path: str, value_dim: DataFrame | None = None) -> DataFrame:
    """Rules from lines `class <label> :: <literal> & <literal> || masses: [..]`, numbered per file in line order.

    Values that are words are looked up in `value_dim`; a word without an entry leaves the value NULL.
    """
    lines = numbered_lines(spark, path)
    part = lambda i: F.nullif(F.regexp_extract("line", RULE_LINE, i), F.lit(""))
    rules = lines.where(F.col("line").rlike(RULE_LINE)).select(
        "file", "line_no", part(1).try_cast("int").alias("label"), part(2).alias("caption"),
        F.from_json(part(3), "array<double>").alias("mass"),
    )
    words = rules.select("file", "line_no", F.posexplode(F.split("caption", " & ")).alias("pos", "t")).select(
        "file", "line_no", "pos", *[F.regexp_extract("t", LITERAL, i).alias(n) for i, n in ((1, "feature"), (2, "op"), (3, "text"))]
    )
    value = F.col("text").try_cast("double")
    if value_dim is not None:
        names = small_side(value_dim.select("feature", F.col("value").alias("text"), F.col("code").cast("double").alias("code")))
        words = words.join(names, ["feature", "text"], "left")
        value = F.coalesce(F.col("code"), value)
    literal = F.struct("pos", F.struct("feature", "op", value.alias("value")).alias("l"))
    lits = words.groupBy("file", "line_no").agg(
        F.transform(F.array_sort(F.collect_list(literal)), lambda x: x["l"]).alias("literals")
    )
    return rules.join(lits, ["file", "line_no"]).select(
        "file", F.col("line_no").cast("bigint").alias("rule_id"), "label", "literals", F.size("literals").alias("n_literals"), "caption", "mass"
    )


def rule_lines(rules: DataFrame, n_classes: int, *, decimals: int = 4, masses: bool = True) -> DataFrame:
    """(value): one line per rule, the most certain first."""
    head = F.concat(F.lit("class "), F.coalesce(F.col("label").cast("string"), F.lit("None")), F.lit(" :: "), F.col("caption"))
    mass = F.array_join(F.transform("mass", lambda m: F.round(m, decimals).cast("string")), ", ")
    line = F.concat(head, F.lit(" || masses: ["), mass, F.lit("]")) if masses else head
    if masses:
        rules = rules.orderBy(F.desc(F.coalesce(certainty_score(n_classes), F.lit(0.0))), "rule_id")
    else:
        rules = rules.orderBy("rule_id")
    return rules.select(line.alias("value"))


def write_rules_text(rules: DataFrame, path: str, n_classes: int, *, decimals: int = 4, masses: bool = True) -> None:
    rule_lines(rules, n_classes, decimals=decimals, masses=masses).write.text(path)


@dataclass
class RuleArtifact:
    rules: DataFrame
    n_classes: int
    default_label: int
    features: list[str]
    prior: list[float] | None


def write_rules(
    rules: DataFrame, path: str, n_classes: int, *, default_label: int = 0, features: Sequence[str] = (),
    prior: Sequence[float] | None = None, version: int = ARTIFACT_VERSION,
) -> None:
    """The whole rules table plus one row of model facts, as parquet."""
    rules.write.parquet(f"{path}/rules")
    meta = [(version, n_classes, default_label, list(features), [float(p) for p in prior] if prior is not None else None)]
    schema = "version int, n_classes int, default_label int, features array<string>, prior array<double>"
    rules.sparkSession.createDataFrame(meta, schema).write.parquet(f"{path}/meta")


def load_rules(spark: SparkSession, path: str) -> RuleArtifact:
    """Rules of the current version; the prior is renormalised, or dropped when its length does not fit."""
    meta = spark.read.parquet(f"{path}/meta").first()
    if meta["version"] != ARTIFACT_VERSION:
        raise ValueError(f"rules at {path} have version {meta['version']}, this library reads {ARTIFACT_VERSION}")
    prior = meta["prior"]
    if prior is not None:
        total = sum(prior)
        prior = [p / total for p in prior] if len(prior) == meta["n_classes"] and total > 0 else None
    return RuleArtifact(spark.read.parquet(f"{path}/rules"), meta["n_classes"], meta["default_label"], list(meta["features"]), prior)


def rule_file_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files at a path, folder or glob, empty files included (scans skip those)."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s for top in fs.globStatus(root) or [] for s in (fs.listStatus(top.getPath()) if top.isDirectory() else [top])]
    names = [s.getPath().getName() for s in found if not s.isDirectory()]
    return sorted(n for n in names if not n.startswith((".", "_")))


def count_rules_by_file(spark: SparkSession, path: str) -> DataFrame:
    """(file, rules): lines starting with `class`, whatever the case, BOM, NUL characters or line ends; 0 for files without any."""
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    files = spark.createDataFrame([(n,) for n in rule_file_names(spark, path)], "file string")
    clean = F.regexp_replace("value", "[\\x{FEFF}\\x{0000}]", "")
    hits = spark.read.text(path).where(clean.rlike(r"(?i)^\s*class\s+")).groupBy(name(F.col("_metadata.file_path")).alias("file")).agg(F.count("*").alias("n"))
    return files.join(hits, "file", "left").select("file", F.coalesce("n", F.lit(0)).alias("rules"))


def count_rules_by_dataset(counts: DataFrame, *, kind: str = "both") -> DataFrame:
    """(dataset, kind, STATIC, RIPPER, FOIL) from file names.

    Reads `[tag_]algo_dataset_kind.ext` and `dataset__ALGO__splitN__seedM.ext`; the latter count as `dst`.
    """
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    old = r"(?i)^(?:.*?_)?(static|ripper|foil)_(.+)_(raw|dst)$"
    new = r"(?i)^(.+?)__(static|ripper|foil)__split\d+__seed\d+$"
    is_new = stem.rlike(new)
    rows = counts.where(is_new | stem.rlike(old)).select(
        F.when(is_new, F.regexp_extract(stem, new, 1)).otherwise(F.regexp_extract(stem, old, 2)).alias("dataset"),
        F.upper(F.when(is_new, F.regexp_extract(stem, new, 2)).otherwise(F.regexp_extract(stem, old, 1))).alias("algo"),
        F.when(is_new, "dst").otherwise(F.lower(F.regexp_extract(stem, old, 3))).alias("kind"), "rules",
    )
    if kind != "both":
        rows = rows.where(F.col("kind") == kind)
    return rows.groupBy("dataset", "kind").pivot("algo", ["STATIC", "RIPPER", "FOIL"]).agg(F.sum("rules")).na.fill(0)
