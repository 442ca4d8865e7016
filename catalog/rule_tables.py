"""Rule-table queries (C) over a rules table derived from the customers, one rule per customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import Registry, rounded, rounded_sql, table
from rulespark.operators import rule_table as R
from rulespark.rules import literals_of

registry = Registry()
query = registry.query

# (feature, operator, value, condition) in literal order, as SQL both engines read.
_LITS = [
    ("bal", ">", "floor(b / 1000) * 1000 - 500", "true"),
    ("bal", "<", "floor(b / 1000) * 1000 + 500 - (k % 3) * 700", "true"),
    ("bal", ">", "floor(b / 2000) * 2000 - 600", "k % 7 > 1"),
    ("nation", "==", "n * 1.0", "k % 2 = 0"),
    ("nation", "==", "n + (k % 8) / 8.0", "k % 4 = 0"),
    ("nation", "<", "15.0", "k % 5 = 0"),
]
_STATS = {
    "stage": "CASE WHEN k % 4 = 0 THEN 'tier_0.80' WHEN k % 4 = 1 THEN 'tier_0.60' ELSE 'tier_0.40' END",
    "support": "(k * 37) % 201",
    "neg": "(k * 11) % 38",
    "label": "CASE WHEN k % 7 = 0 THEN NULL ELSE k % 3 END",
    "m0": "CASE WHEN k % 3 = 0 THEN 0.5 ELSE 0.1 END",
    "m1": "CASE WHEN k % 3 = 1 THEN 0.4 ELSE 0.05 END",
    "om": "(k % 10) / 25.0 + 0.05",
}


def customer_rules(spark, sf_dir):
    base = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "c_acctbal AS b", "c_nationkey AS n")
    lits = ", ".join(
        f"CASE WHEN {cond} THEN named_struct('feature', '{f}', 'op', '{op}', 'value', CAST({v} AS DOUBLE)) END" for f, op, v, cond in _LITS
    )
    s = _STATS
    rules = base.selectExpr(
        "k AS rule_id", f"CAST({s['label']} AS INT) AS label", f"array_compact(array({lits})) AS literals",
        f"""named_struct('kind', 'learned', 'stage', {s['stage']}, 'support', CAST({s['support']} AS BIGINT), 'neg_covered', CAST({s['neg']} AS BIGINT),
            'precision', ({s['support']}) / (({s['support']}) + ({s['neg']}) + 1e-12), 'recall', CAST(0 AS DOUBLE), 'f1', CAST(0 AS DOUBLE),
            'coverage', CAST(0 AS DOUBLE), 'min_precision', CAST(0.2 AS DOUBLE), 'pool_score', CASE WHEN k % 6 = 0 THEN CAST(k AS DOUBLE) END) AS stats""",
        f"array(CAST({s['m0']} AS DOUBLE), CAST({s['m1']} AS DOUBLE), CAST(0 AS DOUBLE), CAST({s['om']} AS DOUBLE)) AS mass",
    )
    rules = rules.withColumn("n_literals", F.size("literals")).withColumn("caption", F.lit(None).cast("string"))
    return rules.select("rule_id", "label", "literals", "n_literals", "caption", "stats", "mass")


BASE_SQL = "base AS (SELECT c_custkey AS k, c_acctbal AS b, c_nationkey AS n FROM customer)"
LITS_SQL = (
    f"{BASE_SQL}, lits AS ("
    + " UNION ALL ".join(
        f"SELECT k AS rule_id, {i} AS pos, '{f}' AS feature, '{op}' AS op, ({v})::DOUBLE AS value FROM base WHERE {cond}"
        for i, (f, op, v, cond) in enumerate(_LITS)
    )
    + ")"
)
RULES_SQL = (
    f"{LITS_SQL}, rules AS (SELECT k AS rule_id, ({_STATS['label']})::INTEGER AS label, {_STATS['stage']} AS stage, "
    f"({_STATS['support']})::BIGINT AS support, ({_STATS['neg']})::BIGINT AS neg, k % 6 = 0 AS shaped, ({_STATS['m0']})::DOUBLE AS m0, "
    f"({_STATS['m1']})::DOUBLE AS m1, 0.0::DOUBLE AS m2, ({_STATS['om']})::DOUBLE AS om, "
    "(SELECT count(*) FROM lits WHERE lits.rule_id = k)::INTEGER AS n_literals FROM base)"
)
CANON_SQL = f"""{LITS_SQL},
g AS (SELECT rule_id, feature, min(value) FILTER (WHERE op = '==') AS eq, max(value) FILTER (WHERE op = '==') AS eq2,
             max(value) FILTER (WHERE op = '>') AS gt, min(value) FILTER (WHERE op = '<') AS lt FROM lits GROUP BY ALL),
bad AS (SELECT DISTINCT rule_id FROM g WHERE (eq IS NOT NULL AND (eq2 - eq > 1e-9 OR coalesce(eq >= lt - 1e-9, false) OR coalesce(eq <= gt + 1e-9, false)))
        OR (eq IS NULL AND coalesce(gt >= lt - 1e-9, false))),
canon AS (SELECT rule_id, feature, '==' AS op, eq AS value FROM g WHERE eq IS NOT NULL
          UNION ALL SELECT rule_id, feature, '>', gt FROM g WHERE eq IS NULL AND gt IS NOT NULL
          UNION ALL SELECT rule_id, feature, '<', lt FROM g WHERE eq IS NULL AND lt IS NOT NULL),
kept AS (SELECT * FROM canon WHERE rule_id NOT IN (SELECT rule_id FROM bad))"""


@query("c1_canonicalize_rules", f"WITH {CANON_SQL} SELECT * FROM kept")
def c1_canonicalize_rules(spark, sf_dir):
    out = R.canonicalize_rules(customer_rules(spark, sf_dir))
    return literals_of(out).select("rule_id", "feature", "op", "value")


@query(
    "c2_dedupe_rules",
    f"""WITH {CANON_SQL}, s AS (SELECT rule_id, string_agg(feature || op || value, '&&' ORDER BY feature, op DESC) AS sig FROM kept GROUP BY rule_id)
        SELECT min(rule_id) AS rule_id, count(*) AS n_same FROM s GROUP BY sig""",
)
def c2_dedupe_rules(spark, sf_dir):
    rules = R.canonicalize_rules(customer_rules(spark, sf_dir)).withColumn("sig", R.rule_signature(F.col("literals")))
    sizes = rules.groupBy("sig").agg(F.count("*").alias("n_same"))
    return R.dedupe_rules(rules).join(sizes, "sig").select("rule_id", "n_same")


@query(
    "c3_rule_caption",
    f"""WITH {LITS_SQL}, t AS (SELECT rule_id, pos, feature || ' ' || op || ' ' ||
            coalesce(CASE WHEN feature = 'nation' THEN n_name END, regexp_replace(value::VARCHAR, '\\.0$', '')) AS txt
            FROM lits LEFT JOIN nation ON value = n_nationkey AND feature = 'nation')
        SELECT rule_id, string_agg(txt, ' & ' ORDER BY pos) AS caption FROM t GROUP BY rule_id""",
)
def c3_rule_caption(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select(
        F.lit("nation").alias("feature"), F.col("n_nationkey").alias("code"), F.col("n_name").alias("value")
    )
    return R.rule_captions(customer_rules(spark, sf_dir), names)


@query(
    "c5_rulebase_stats",
    rounded_sql(
        f"WITH {RULES_SQL} SELECT stage, count(*) AS n_rules, avg(n_literals) AS avg_literals, avg((label IS NOT NULL)::INT) AS labeled_ratio "
        "FROM rules GROUP BY stage",
        "avg_literals labeled_ratio",
    ),
)
def c5_rulebase_stats(spark, sf_dir):
    rules = customer_rules(spark, sf_dir).withColumn("stage", F.col("stats.stage"))
    return rounded(R.rulebase_stats(rules, ["stage"]))


@query(
    "c6_generation_counts",
    f"""WITH {RULES_SQL} SELECT 'stage' AS section, stage AS item, count(*) AS n FROM rules GROUP BY ALL
        UNION ALL SELECT 'class', coalesce(label::VARCHAR, 'None'), count(*) FROM rules GROUP BY ALL
        UNION ALL SELECT 'shaped', shaped::VARCHAR, count(*) FROM rules GROUP BY ALL""",
)
def c6_generation_counts(spark, sf_dir):
    return R.generation_counts(customer_rules(spark, sf_dir))


def _top_sql(score: str) -> str:
    return rounded_sql(
        f"WITH {RULES_SQL} SELECT rule_id, label, stage, support, support / (support + neg + 1e-12) AS precision, n_literals, "
        f"({score})::DOUBLE AS score FROM rules ORDER BY score DESC, rule_id LIMIT 12",
        "precision score",
    )


@query("c6_top_rules_by_support", _top_sql("support"))
def c6_top_rules_by_support(spark, sf_dir):
    return rounded(R.top_rules(customer_rules(spark, sf_dir), "support"))


@query("c6_top_rules_by_precision", _top_sql("support / (support + neg + 1e-12)"))
def c6_top_rules_by_precision(spark, sf_dir):
    return rounded(R.top_rules(customer_rules(spark, sf_dir), "precision"))


@query(
    "c7_sort_rules_by_certainty",
    rounded_sql(
        f"WITH {RULES_SQL} SELECT rule_id, (1 - om) * coalesce(CASE label WHEN 0 THEN m0 WHEN 1 THEN m1 WHEN 2 THEN m2 END, 0) AS score FROM rules",
        "score",
    ),
)
def c7_sort_rules_by_certainty(spark, sf_dir):
    return rounded(R.sort_rules_by_certainty(customer_rules(spark, sf_dir), 3).select("rule_id", "score"))


@query(
    "c8_rule_vote_strength",
    rounded_sql(
        f"WITH {RULES_SQL} SELECT rule_id, (support + 1) / (support + neg + 3) * ln(1 + support) AS strength FROM rules", "strength"
    ),
)
def c8_rule_vote_strength(spark, sf_dir):
    return rounded(R.rule_vote_strength(customer_rules(spark, sf_dir), 3).select("rule_id", "strength"))
