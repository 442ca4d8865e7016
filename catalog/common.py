"""Tables, demo rules and SQL fragments shared by the registered queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rulespark.rules import EQ_TOLERANCE, Rule, RuleSet, default_caption
from rulespark.session import tune

DIGITS = 6


class Registry:
    """Queries of one catalog module and, where SQL can recompute them, their SQL."""

    def __init__(self):
        self.QUERIES: dict = {}
        self.ORACLE: dict = {}

    def query(self, name: str, sql: str | None = None):
        def register(fn):
            self.QUERIES[name] = fn
            if sql is not None:
                self.ORACLE[name] = sql
            return fn

        return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded for comparison; + 0.0 removes negative zero."""
    return df.select(
        *[
            (F.round(F.col(f.name), digits) + 0.0).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def rounded_sql(sql: str, doubles: str, digits: int = DIGITS) -> str:
    swaps = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in doubles.split())
    return f"SELECT * REPLACE ({swaps}) FROM ({sql})"


# --- demo rules on lineitem: y = quantity > 25 and discount >= 0.05 ---

LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate"]
LINE_OUT = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "rf"]

DEMO_RULES = RuleSet(
    tuple(
        Rule(i, label, lits, mass, default_caption(lits), {"support": support, "neg_covered": neg})
        for i, (label, lits, mass, support, neg) in enumerate(
            [
                (1, (("l_quantity", ">", 25.0), ("l_discount", ">", 0.045)), (0.0, 0.80, 0.20), 160, 4),
                (0, (("l_quantity", "<", 25.5),), (0.70, 0.0, 0.30), 300, 10),
                (0, (("l_discount", "<", 0.045),), (0.65, 0.0, 0.35), 240, 20),
                (1, (("l_quantity", ">", 40.0),), (0.05, 0.35, 0.60), 70, 50),
                (0, (("l_tax", ">", 0.07),), (0.15, 0.05, 0.80), 40, 15),
                (1, (("l_discount", ">", 0.08), ("l_quantity", ">", 20.0)), (0.05, 0.45, 0.50), 30, 6),
                (0, (("rf", "==", 0.0), ("l_quantity", "<", 10.0)), (0.55, 0.0, 0.45), 50, 0),
                (1, (("l_extendedprice", ">", 100000.0),), (0.10, 0.20, 0.70), 25, 60),
            ]
        )
    ),
    n_classes=2,
)

RETURN_CODES = {"A": 0, "N": 1, "R": 2}


def line_label():
    return ((F.col("l_quantity") > 25) & (F.col("l_discount") >= 0.05)).cast("int")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with the return flag as code `rf`, line status as code `ls` and the label `y`."""
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        *LINE_KEY, "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        F.when(flag == "A", 0.0).when(flag == "N", 1.0).when(flag == "R", 2.0).alias("rf"),
        line_label().alias("y"),
    )


LINES_SQL = """
lines AS (SELECT *, CASE l_returnflag WHEN 'A' THEN 0.0 WHEN 'N' THEN 1.0 WHEN 'R' THEN 2.0 END::DOUBLE AS rf,
                 CASE WHEN l_quantity > 25 AND l_discount >= 0.05 THEN 1 ELSE 0 END AS y FROM lineitem)"""


# --- demo rules on orders joined to customers: three price bands, o_orderkey is the row id ---

ORDER_RULES = RuleSet(
    tuple(
        Rule(i, label, lits, mass, default_caption(lits), {"support": 100 + 10 * i, "neg_covered": 7 * i})
        for i, (label, lits, mass) in enumerate(
            [
                (0, (("o_totalprice", "<", 120000.0),), (0.60, 0.05, 0.0, 0.35)),
                (1, (("o_totalprice", ">", 100000.0), ("o_totalprice", "<", 260000.0)), (0.10, 0.55, 0.05, 0.30)),
                (2, (("o_totalprice", ">", 240000.0),), (0.0, 0.15, 0.55, 0.30)),
                (0, (("c_acctbal", "<", 0.0),), (0.20, 0.05, 0.05, 0.70)),
                (2, (("c_acctbal", ">", 7000.0), ("prio", "==", 0.0)), (0.05, 0.05, 0.30, 0.60)),
                (1, (("prio", "==", 2.0),), (0.10, 0.25, 0.10, 0.55)),
                (2, (("status", "==", 1.0), ("o_totalprice", ">", 200000.0)), (0.0, 0.10, 0.45, 0.45)),
                (None, (("nation", ">", 20.0),), (0.10, 0.10, 0.10, 0.70)),
                (0, (("nation", "<", 5.0), ("o_totalprice", "<", 150000.0)), (0.40, 0.10, 0.0, 0.50)),
            ]
        )
    ),
    n_classes=3,
    default_label=1,
)
ORDER_FEATURES = ["o_totalprice", "c_acctbal", "prio", "status", "nation"]


def orders(spark: SparkSession, sf_dir: str, *, orders_table: DataFrame | None = None) -> DataFrame:
    """orders with numeric features, customer attributes and the price band 0..2 as label `y`."""
    price = F.col("o_totalprice")
    source = table(spark, sf_dir, "orders") if orders_table is None else orders_table
    o = source.select(
        "o_orderkey", "o_custkey", "o_totalprice",
        (F.substring("o_orderpriority", 1, 1).cast("double") - 1).alias("prio"),
        F.when(F.col("o_orderstatus") == "F", 0.0).when(F.col("o_orderstatus") == "O", 1.0).otherwise(2.0).alias("status"),
        F.when(price < 110000, 0).when(price < 250000, 1).otherwise(2).alias("y"),
    )
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("nation"))
    return o.join(c, o.o_custkey == c.c_custkey).drop("o_custkey", "c_custkey")


ORDERS_SQL = """
ord AS (SELECT o_orderkey, o_totalprice, c_acctbal, (substr(o_orderpriority, 1, 1)::DOUBLE - 1) AS prio,
               CASE o_orderstatus WHEN 'F' THEN 0.0 WHEN 'O' THEN 1.0 ELSE 2.0 END::DOUBLE AS status,
               c_nationkey::DOUBLE AS nation,
               CASE WHEN o_totalprice < 110000 THEN 0 WHEN o_totalprice < 250000 THEN 1 ELSE 2 END AS y
        FROM orders JOIN customer ON o_custkey = c_custkey)"""


# --- documents joined to their quality labels ---

DOC_FEATURES = ["n_chars", "letters", "digits", "n_words", "lang_code", "source_code"]


def docs(spark: SparkSession, sf_dir: str, *, labelled: bool = True) -> DataFrame:
    """Labelled documents with whole-text features; letters and digits are shares of all characters."""
    d = table(spark, sf_dir, "documents")
    text = F.col("text")
    size = F.greatest(F.length(text), F.lit(1))
    out = d.select(
        "doc_id", "lang", "source", F.col("n_chars").cast("double").alias("n_chars"),
        (F.length(F.regexp_replace(text, "[^A-Za-z ]", "")) / size).alias("letters"),
        (F.length(F.regexp_replace(text, "[^0-9]", "")) / size).alias("digits"),
        (F.length(F.regexp_replace(text, "[^ ]", "")) + 1).cast("double").alias("n_words"),
    )
    if not labelled:
        return out
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    return out.join(labels, "doc_id")


DOCS_SQL = """
alldocs AS (SELECT doc_id, lang, source, n_chars::DOUBLE AS n_chars,
                   length(regexp_replace(text, '[^A-Za-z ]', '', 'g')) / greatest(length(text), 1) AS letters,
                   length(regexp_replace(text, '[^0-9]', '', 'g')) / greatest(length(text), 1) AS digits,
                   (length(regexp_replace(text, '[^ ]', '', 'g')) + 1)::DOUBLE AS n_words FROM documents),
docs AS (SELECT d.*, l.quality AS y FROM alldocs d JOIN labels l USING (doc_id))"""


# --- SQL twins of rules ---


def literal_sql(f: str, op: str, v: float) -> str:
    if op == "==":
        return f"abs({f} - ({v!r})) <= {EQ_TOLERANCE!r} + {EQ_TOLERANCE!r} * abs({v!r})"
    return f"({f} {op} {v!r}" + (f" AND NOT isnan({f}::DOUBLE))" if op == ">" else ")")


def rule_sql(rule: Rule) -> str:
    return "(" + " AND ".join(literal_sql(*lit) for lit in rule.literals) + ")"


def rules_sql(rules: RuleSet, name: str = "rules") -> str:
    """CTE: rule_id, label, n_literals, caption, support, neg_covered, m0.., om."""
    k = rules.n_classes
    rows = []
    for r in rules:
        label = "NULL" if r.label is None else str(r.label)
        masses = ", ".join(f"{v!r}::DOUBLE" for v in r.mass)
        caption = (r.caption or "").replace("'", "''")
        rows.append(
            f"({r.rule_id}::BIGINT, {label}::INTEGER, {len(r.literals)}, '{caption}', "
            f"{r.stats.get('support', 0)}::BIGINT, {r.stats.get('neg_covered', 0)}::BIGINT, {masses})"
        )
    cols = ", ".join(f"m{i}" for i in range(k))
    return f"{name}(rule_id, label, n_literals, caption, support, neg_covered, {cols}, om) AS (VALUES {', '.join(rows)})"


def fired_sql(src: str, cols: Sequence[str] | str, rules: RuleSet, name: str = "fired") -> str:
    """CTE with one row per (row, fired rule) over the relation `src`."""
    keep = cols if isinstance(cols, str) else ", ".join(cols)
    cases = ", ".join(f"CASE WHEN {rule_sql(r)} THEN {r.rule_id}::BIGINT END" for r in rules)
    return f"{name} AS (SELECT * FROM (SELECT {keep}, unnest([{cases}]) AS rule_id FROM {src}) WHERE rule_id IS NOT NULL)"


def fused_sql(src: str, cols: Sequence[str], rules: RuleSet, name: str = "fused") -> str:
    """CTE with one row per row of `src`: n_fired, m0.., om, unc_rule, p0.., pred, by products of masses."""
    k = rules.n_classes
    keep = ", ".join(cols)
    hit = {r.rule_id: rule_sql(r) for r in rules}

    def product(part) -> str:
        return " * ".join(f"(CASE WHEN {hit[r.rule_id]} THEN {part(r)!r}::DOUBLE ELSE 1.0::DOUBLE END)" for r in rules)

    safe = lambda r: r.safe_mass
    n = " + ".join(f"(CASE WHEN {hit[r.rule_id]} THEN 1 ELSE 0 END)" for r in rules)
    unc = " + ".join(f"(CASE WHEN {hit[r.rule_id]} THEN {safe(r)[-1]!r}::DOUBLE ELSE 0.0::DOUBLE END)" for r in rules)
    prods = ", ".join(f"{product(lambda r, c=c: safe(r)[c] + safe(r)[-1])} AS q{c}" for c in range(k))
    z = " + ".join(f"(q{c} - q)" for c in range(k)) + " + q"
    masses = ", ".join(f"(q{c} - q) / z AS m{c}" for c in range(k))
    probs = ", ".join(f"((q{c} - q) + q / {k}) / z AS p{c}" for c in range(k))
    pred = "CASE " + " ".join(
        f"WHEN {' AND '.join(f'p{c} >= p{d}' for d in range(k) if d != c)} THEN {c}" for c in range(k)
    ) + " END"
    return f"""{name}_a AS (SELECT {keep}, {n} AS n_fired, {unc} AS so, {product(lambda r: safe(r)[-1])} AS q, {prods} FROM {src}),
{name}_b AS (SELECT *, {z} AS z FROM {name}_a),
{name}_c AS (SELECT {keep}, n_fired, {masses}, q / z AS om, {probs},
                    CASE WHEN n_fired > 0 THEN so / n_fired ELSE 1.0 END AS unc_rule FROM {name}_b),
{name} AS (SELECT *, {pred} AS pred FROM {name}_c)"""


def votes_sql(src: str, cols: Sequence[str], rules: RuleSet, name: str = "voted") -> str:
    """CTE: v0.. (fired labelled rules per class), n_fired, first_label, vote (default label when nothing fired)."""
    keep = ", ".join(cols)
    k = rules.n_classes
    counts = ", ".join(
        "(" + (" + ".join(f"(CASE WHEN {rule_sql(r)} THEN 1 ELSE 0 END)" for r in rules if r.label == c) or "0") + f") AS v{c}"
        for c in range(k)
    )
    n = " + ".join(f"(CASE WHEN {rule_sql(r)} THEN 1 ELSE 0 END)" for r in rules)
    first = "CASE " + " ".join(f"WHEN {rule_sql(r)} THEN {r.label}" for r in rules if r.label is not None) + " END"
    win = "CASE WHEN n_fired = 0 THEN " + str(rules.default_label) + " " + " ".join(
        f"WHEN {' AND '.join(f'v{c} >= v{d}' for d in range(k) if d != c)} THEN {c}" for c in range(k)
    ) + " END"
    return f"""{name}_a AS (SELECT {keep}, {counts}, {n} AS n_fired, {first} AS first_label FROM {src}),
{name} AS (SELECT *, {win} AS vote FROM {name}_a)"""
