"""Induction queries (D) over orders and labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import DOC_FEATURES, ORDERS_SQL, Registry, docs, orders, rounded, rounded_sql, rule_sql
from rulespark.operators import induce as I, overlap as V, prepare as P, static_rules as S
from rulespark.rules import Rule, RuleSet, default_caption, rules_frame

registry = Registry()
query = registry.query

KEY = ["o_orderkey"]
FEATURES = ["o_totalprice", "c_acctbal", "prio", "status", "nation"]
NUMERIC = ["o_totalprice", "c_acctbal", "nation"]
CATEGORICAL = ["prio", "status"]
CFG = I.InductionConfig(algo="foil")


def task_rows(spark, sf_dir):
    """Orders whose label needs conjunctions: dear orders of solvent customers, or urgent ones of late nations."""
    a = (F.col("o_totalprice") > 180000) & (F.col("c_acctbal") > 1000)
    b = (F.col("prio") == 0) & (F.col("nation") > 12)
    return orders(spark, sf_dir).withColumn("y", (a | b).cast("int"))


T_SQL = (
    f"{ORDERS_SQL}, t AS (SELECT * REPLACE (CASE WHEN (o_totalprice > 180000 AND c_acctbal > 1000) OR (prio = 0 AND nation > 12) THEN 1 ELSE 0 END AS y) FROM ord), "
    "cells AS (" + " UNION ALL ".join(f"SELECT o_orderkey, y, '{f}' AS feature, {f} AS value FROM t" for f in FEATURES) + ")"
)


def task(spark, sf_dir) -> I.Task:
    return I.make_task(task_rows(spark, sf_dir), KEY, FEATURES)


def literal_rows(spark, rows, extra: str = ""):
    return spark.createDataFrame(rows, f"feature string, op string, value double{extra}")


# ---------------------------------------------------------------- D1, D2, D3


@query(
    "d1_feature_score",
    rounded_sql(
        f"WITH {T_SQL} SELECT feature, var_pop(value) AS score FROM cells GROUP BY feature UNION ALL "
        "SELECT 'o_orderpriority', 1 - max(n) / sum(n) FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)",
        "score", 2,
    ),
)
def d1_feature_score(spark, sf_dir):
    from catalog.common import table

    rows = task_rows(spark, sf_dir)
    numbers = S.feature_scores(rows, FEATURES)
    texts = S.feature_scores(table(spark, sf_dir, "orders"), [], ["o_orderpriority"])
    return rounded(numbers.unionByName(texts), 2)


# Numeric features with more than 24 integer values get quantile literals, the others their top values.
POOL_SQL = f"""{T_SQL}, kinds AS (SELECT feature, CASE WHEN count(DISTINCT value) <= 24 AND max(abs(value - round(value))) <= 1e-8 THEN 'c' ELSE 'n' END AS kind,
   var_pop(value) AS score, count(*) AS n FROM cells GROUP BY feature),
qs AS (SELECT feature, unnest([{', '.join(f"quantile_cont(value, {i / 8!r})" for i in range(1, 8))}]) AS v FROM cells JOIN kinds USING (feature) WHERE kind = 'n' GROUP BY feature),
th AS (SELECT feature, v FROM (SELECT feature, v, lag(v) OVER (PARTITION BY feature ORDER BY v) AS pv FROM (SELECT DISTINCT feature, v FROM qs)) WHERE pv IS NULL OR v - pv > 1e-7),
cv AS (SELECT feature, value AS v FROM (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY count(*) DESC, value) AS r
       FROM cells JOIN kinds USING (feature) WHERE kind = 'c' GROUP BY feature, value) WHERE r <= 12),
lit AS (SELECT feature, op, v FROM th, (SELECT unnest(['<', '>']) AS op) UNION ALL SELECT feature, '==', v FROM cv),
pool AS (SELECT l.feature, l.op, l.v AS value, count(*) AS support, count(*) / max(k.n) AS coverage, max(k.score) AS score
         FROM lit l JOIN kinds k USING (feature) JOIN cells c ON c.feature = l.feature AND
              CASE l.op WHEN '<' THEN c.value < l.v WHEN '>' THEN c.value > l.v ELSE c.value = l.v END GROUP BY ALL)"""


def pool_of(spark, sf_dir):
    return S.literal_pool(task_rows(spark, sf_dir).select(*FEATURES), FEATURES)


@query("d2_static_literal_pool", rounded_sql(f"WITH {POOL_SQL} SELECT feature, op, value, support, coverage, round(score, 2) AS score FROM pool", "value coverage score", 4))
def d2_static_literal_pool(spark, sf_dir):
    pool = pool_of(spark, sf_dir)
    rows = [(*e.literal, e.support, e.coverage, round(e.score, 2)) for entries in pool.values() for e in entries]
    return rounded(literal_rows(spark, rows, ", support bigint, coverage double, score double"), 4)


@query(
    "d3_static_single_rules",
    rounded_sql(
        f"WITH {POOL_SQL} SELECT feature, op, value, coverage, row_number() OVER (PARTITION BY feature ORDER BY score DESC, coverage DESC, value, op) AS rank FROM pool",
        "value coverage", 4,
    ),
)
def d3_static_single_rules(spark, sf_dir):
    rows, rank = [], {}
    for (lit,), stats in S.single_rules(pool_of(spark, sf_dir)):
        rank[lit[0]] = rank.get(lit[0], 0) + 1
        rows.append((*lit, stats["coverage"], rank[lit[0]]))
    return rounded(literal_rows(spark, rows, ", coverage double, rank bigint"), 4)


TOP3 = f"""{POOL_SQL}, top3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY score DESC, coverage DESC, value, op) AS r FROM pool) WHERE r <= 3),
ford(feature, o) AS (VALUES {', '.join(f"('{f}', {i})" for i, f in enumerate(FEATURES))}),
fs AS (SELECT feature, o, score, row_number() OVER (ORDER BY score DESC, o) AS sr FROM kinds JOIN ford USING (feature))"""


def _holds(i: int) -> str:
    value = f"CASE l{i}.feature " + " ".join(f"WHEN '{f}' THEN t.{f}" for f in FEATURES) + " END"
    return f"CASE l{i}.op WHEN '<' THEN ({value}) < l{i}.value WHEN '>' THEN ({value}) > l{i}.value ELSE ({value}) = l{i}.value END"


def _text(lit: str) -> str:
    return f"{lit}.feature || {lit}.op || round({lit}.value, 3)::VARCHAR"


def combos(spark, rows, groups, stage, n, pool):
    out = S.combined_rules(rows, pool, groups, stage, n)
    data = [
        ("&".join(sorted(f"{f}{op}{round(v, 3)!r}" for f, op, v in cond)), s["support"]) for cond, s in out
    ]
    return spark.createDataFrame(data, "rule string, support bigint")


@query(
    "d4_static_pair_rules",
    f"""WITH {TOP3}, g AS (SELECT a.feature AS f1, b.feature AS f2 FROM fs a JOIN fs b ON a.o < b.o ORDER BY a.score + b.score DESC, a.o, b.o LIMIT 8)
    SELECT list_aggregate(list_sort([{_text('l1')}, {_text('l2')}]), 'string_agg', '&') AS rule, count(*) AS support
    FROM g JOIN top3 l1 ON l1.feature = f1 JOIN top3 l2 ON l2.feature = f2 JOIN t ON {_holds(1)} AND {_holds(2)} GROUP BY 1""",
)
def d4_static_pair_rules(spark, sf_dir):
    rows = task_rows(spark, sf_dir).select(*FEATURES)
    pool = S.literal_pool(rows, FEATURES)
    groups = S.pair_groups({f: e[0].score for f, e in pool.items()}, FEATURES, 8)
    return combos(spark, rows, groups, "pair", rows.count(), pool)


@query(
    "d5_static_triple_rules",
    f"""WITH {TOP3}, g AS (SELECT a.feature AS f1, b.feature AS f2, c.feature AS f3 FROM fs a JOIN fs b ON a.sr < b.sr JOIN fs c ON b.sr < c.sr ORDER BY a.sr, b.sr, c.sr LIMIT 24)
    SELECT list_aggregate(list_sort([{_text('l1')}, {_text('l2')}, {_text('l3')}]), 'string_agg', '&') AS rule, count(*) AS support
    FROM g JOIN top3 l1 ON l1.feature = f1 JOIN top3 l2 ON l2.feature = f2 JOIN top3 l3 ON l3.feature = f3
         JOIN t ON {_holds(1)} AND {_holds(2)} AND {_holds(3)} GROUP BY 1""",
)
def d5_static_triple_rules(spark, sf_dir):
    rows = task_rows(spark, sf_dir).select(*FEATURES)
    pool = S.literal_pool(rows, FEATURES)
    groups = S.triple_groups({f: e[0].score for f, e in pool.items()}, FEATURES, 24)
    return combos(spark, rows, groups, "triple", rows.count(), pool)


@query(
    "d6_build_static_rules",
    rounded_sql(
        f"""WITH {TOP3}, g2 AS (SELECT a.feature AS f1, b.feature AS f2 FROM fs a JOIN fs b ON a.o < b.o ORDER BY a.score + b.score DESC, a.o, b.o LIMIT 8),
        g3 AS (SELECT a.feature AS f1, b.feature AS f2, c.feature AS f3 FROM fs a JOIN fs b ON a.sr < b.sr JOIN fs c ON b.sr < c.sr ORDER BY a.sr, b.sr, c.sr LIMIT 24),
        r AS (SELECT 'pair' AS stage, l1.feature || l1.op || l1.value || l2.feature || l2.op || l2.value AS k, count(*) AS support FROM g2 JOIN top3 l1 ON l1.feature = f1
                JOIN top3 l2 ON l2.feature = f2 JOIN t ON {_holds(1)} AND {_holds(2)} GROUP BY ALL
              UNION ALL SELECT 'triple', l1.feature || l1.op || l1.value || l2.feature || l2.op || l2.value || l3.feature || l3.op || l3.value, count(*)
                FROM g3 JOIN top3 l1 ON l1.feature = f1 JOIN top3 l2 ON l2.feature = f2 JOIN top3 l3 ON l3.feature = f3
                JOIN t ON {_holds(1)} AND {_holds(2)} AND {_holds(3)} GROUP BY ALL
              UNION ALL SELECT 'single', feature || op || value, support FROM pool)
        SELECT stage, count(*) AS n_rules, sum(support)::BIGINT AS support, avg(support / (SELECT count(*) FROM t)) AS coverage FROM r GROUP BY stage""",
        "coverage",
    ),
)
def d6_build_static_rules(spark, sf_dir):
    rules = S.build_static_rules(task_rows(spark, sf_dir), FEATURES)
    frame = rules_frame(spark, rules)
    return rounded(
        frame.groupBy(F.col("stats.stage").alias("stage")).agg(
            F.count("*").alias("n_rules"), F.sum("stats.support").alias("support"), F.avg("stats.coverage").alias("coverage")
        )
    )


# ---------------------------------------------------------------- D7, D18

PART = RuleSet(
    tuple(
        Rule(i, label, lits, None, default_caption(lits), {"precision": p, "recall": r, "f1": 2 * p * r / (p + r)})
        for i, (label, lits, p, r) in enumerate(
            [
                (1, (("o_totalprice", ">", 180000.0),), 0.70, 0.80),
                (1, (("o_totalprice", ">", 190000.0),), 0.72, 0.75),
                (1, (("o_totalprice", ">", 180000.0), ("c_acctbal", ">", 1000.0)), 0.99, 0.85),
                (1, (("c_acctbal", ">", 1000.0),), 0.45, 0.90),
                (1, (("prio", "==", 0.0), ("nation", ">", 12.0)), 0.98, 0.30),
                (1, (("prio", "==", 0.0),), 0.50, 0.33),
                (0, (("o_totalprice", "<", 180000.0),), 0.80, 0.85),
                (0, (("o_totalprice", "<", 150000.0), ("prio", ">", 0.0)), 0.90, 0.50),
                (0, (("c_acctbal", "<", 1000.0),), 0.85, 0.30),
                (0, (("nation", "<", 12.0), ("o_totalprice", "<", 180000.0)), 0.97, 0.40),
                (1, (("nation", ">", 12.0), ("o_totalprice", ">", 185000.0)), 0.75, 0.40),
            ]
        )
    ),
    2,
)


@query(
    "d7_rule_overlaps",
    f"WITH {T_SQL}, h AS (SELECT o_orderkey, {', '.join(f'{rule_sql(r)} AS h{r.rule_id}' for r in PART)} FROM t) "
    + " UNION ALL ".join(
        f"SELECT {a.rule_id}::BIGINT AS a, {b.rule_id}::BIGINT AS b, count(*) AS n FROM h WHERE h{a.rule_id} AND h{b.rule_id} HAVING count(*) > 0"
        for a in PART for b in PART if a.rule_id <= b.rule_id
    ),
)
def d7_rule_overlaps(spark, sf_dir):
    return V.rule_overlaps(task_rows(spark, sf_dir), PART)


_HITS = f"h AS (SELECT {', '.join(f'({rule_sql(r)})::INT AS h{r.rule_id}' for r in PART)} FROM t)"
_JACCARD = f"""{_HITS}, ov AS ({' UNION ALL '.join(
    f"SELECT {a.rule_id} AS a, {b.rule_id} AS b, sum(h{a.rule_id} * h{b.rule_id}) AS n, sum(h{a.rule_id}) + sum(h{b.rule_id}) - sum(h{a.rule_id} * h{b.rule_id}) AS u FROM h"
    for a in PART for b in PART if a.rule_id != b.rule_id
)}), ja AS (SELECT a, b, CASE WHEN u > 0 THEN n / u ELSE 0 END AS j FROM ov)"""


def _kept_frame(spark, rules):
    return spark.createDataFrame([(i, r.rule_id, r.label) for i, r in enumerate(rules)], "place bigint, rule_id bigint, label int")


_PART_LABELS = f"pl(rule_id, label) AS (VALUES {', '.join(f'({r.rule_id}::BIGINT, {r.label}::INTEGER)' for r in PART)})"


@query(
    "d7_diversity_filter",
    f"""WITH RECURSIVE {T_SQL}, {_JACCARD}, {_PART_LABELS},
    m AS (SELECT list(j ORDER BY a, b) AS js FROM (SELECT a, b, j FROM ja UNION ALL SELECT i, i, 0.0 FROM range({len(PART)}) r(i))),
    g AS (SELECT 0 AS i, [0] AS kept, js FROM m UNION ALL
          SELECT i + 1, CASE WHEN list_max(list_transform(kept, lambda k: js[(i + 1) * {len(PART)} + k + 1])) <= 0.75 THEN list_append(kept, i + 1) ELSE kept END, js FROM g WHERE i < {len(PART) - 1}),
    k AS (SELECT unnest(kept)::BIGINT AS rule_id FROM g WHERE i = {len(PART) - 1})
    SELECT row_number() OVER (ORDER BY rule_id) - 1 AS place, rule_id, label FROM k JOIN pl USING (rule_id)""",
)
def d7_diversity_filter(spark, sf_dir):
    return _kept_frame(spark, V.diversity_filter(task_rows(spark, sf_dir), PART, threshold=0.75))


def _shape_sql(min_keep: int) -> str:
    """Greedy choice per class: the rule of best quality plus novelty against those chosen, the smaller id on a tie."""
    n = len(PART)
    base = "[" + ", ".join(repr(r.stats["precision"] + 0.25 * r.stats["recall"] + 0.15 * r.stats["f1"] - 0.02 * (len(r.literals) - 1)) + "::DOUBLE" for r in PART) + "]"
    parts, picks, place = [], [], 0
    for label in (0, 1):
        own = [r.rule_id for r in PART if r.label == label]
        target = min(len(own), max(min_keep, round(len(own) * 0.7)))
        novelty = f"1 - coalesce(list_max(list_transform(chosen, lambda k: js[c * {n} + k + 1])), 0)"
        parts.append(
            f"""g{label} AS (SELECT 0 AS step, []::INT[] AS chosen, js FROM m UNION ALL
            SELECT step + 1, list_append(chosen, list_extract(list_sort(list_transform(list_filter({own}, lambda c: NOT list_contains(chosen, c)),
                lambda c: {{'v': -round(({base})[c + 1] + 0.12 * ({novelty}), 12), 'c': c}})), 1).c), js FROM g{label} WHERE step < {target})"""
        )
        picks.append(f"SELECT {place} + unnest(range({target})) AS place, unnest(chosen)::BIGINT AS rule_id, {label}::INTEGER AS label FROM g{label} WHERE step = {target}")
        place += target
    return f"""WITH RECURSIVE {T_SQL}, {_JACCARD},
    m AS (SELECT list(j ORDER BY a, b) AS js FROM (SELECT a, b, j FROM ja UNION ALL SELECT i, i, 0.0 FROM range({n}) r(i))), {', '.join(parts)} {' UNION ALL '.join(picks)}"""


@query("d18_shape_rule_pool", _shape_sql(3))
def d18_shape_rule_pool(spark, sf_dir):
    return _kept_frame(spark, V.shape_rule_pool(task_rows(spark, sf_dir), PART, min_keep=3))


# ---------------------------------------------------------------- D8 - D11

_QL = lambda filt: ", ".join(f"quantile_cont(value, {q!r}){filt}" for q in I.QUANTILES)
PROPOSALS = f"""{T_SQL}, nc AS (SELECT * FROM cells WHERE feature IN ('o_totalprice', 'c_acctbal', 'nation')),
vc AS (SELECT feature, value, count(*) AS n, sum(y) AS pos, arg_min(y, o_orderkey) AS fp, arg_max(y, o_orderkey) AS lp FROM nc GROUP BY ALL),
ru AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp, sum(n) OVER (PARTITION BY feature) AS an, sum(pos) OVER (PARTITION BY feature) AS ap,
              lead(value) OVER w AS nv, lead(fp) OVER w AS nf FROM vc WINDOW w AS (PARTITION BY feature ORDER BY value)),
mi AS (SELECT feature, (value + nv) * 0.5 AS threshold, lp <> nf AS change,
              round((2 * (ap / an) * (1 - ap / an)) - (cn / an * 2 * (cp / cn) * (1 - cp / cn) + (an - cn) / an * 2 * ((ap - cp) / (an - cn)) * (1 - (ap - cp) / (an - cn))), 12) AS gain
       FROM ru WHERE nv - value > 1e-12),
pr AS (SELECT feature, 0 AS kind, unnest(range(1, 8))::INTEGER AS rank, unnest([{_QL('')}]) AS threshold FROM nc GROUP BY feature
  UNION ALL SELECT feature, 1, unnest(range(1, 8))::INTEGER, unnest([{_QL(' FILTER (WHERE y = 1)')}]) FROM nc GROUP BY feature
  UNION ALL SELECT feature, 2, r::INTEGER, threshold FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY gain DESC, abs(threshold), threshold) AS r FROM mi WHERE change) WHERE r <= 12
  UNION ALL SELECT feature, 3, r::INTEGER, threshold FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY gain DESC, abs(threshold), threshold) AS r FROM mi) WHERE r <= 6),
dd AS (SELECT feature, threshold, row_number() OVER (PARTITION BY feature ORDER BY kind, rank) AS pos FROM
         (SELECT *, row_number() OVER (PARTITION BY feature, printf('%.12g', threshold) ORDER BY kind, rank) AS dup FROM pr) WHERE dup = 1),
ca AS (SELECT * FROM dd WHERE pos <= 24)"""


@query("d8_threshold_proposals", rounded_sql(f"WITH {PROPOSALS} SELECT * FROM pr", "threshold", 4))
def d8_threshold_proposals(spark, sf_dir):
    return rounded(I.threshold_proposals(task(spark, sf_dir), F.col("y") == 1, CFG), 4)


@query("d8_threshold_proposals_bucketed", rounded_sql(f"WITH {PROPOSALS} SELECT * FROM pr", "threshold", 4))
def d8_threshold_proposals_bucketed(spark, sf_dir):
    t = task(spark, sf_dir)
    t.buckets = 8
    return rounded(I.threshold_proposals(t, F.col("y") == 1, CFG), 4)


@query("d8_threshold_proposals_refined", rounded_sql(f"WITH {PROPOSALS} SELECT * FROM pr", "threshold", 4))
def d8_threshold_proposals_refined(spark, sf_dir):
    t = I.place_in_buckets(task(spark, sf_dir), 64)
    rows = [(r["feature"], r["kind"], r["rank"], r["threshold"]) for r in I.refined_proposals(t, F.col("y") == 1, CFG)]
    return rounded(spark.createDataFrame(rows, "feature string, kind int, rank int, threshold double"), 4)


_LINES = """t AS (SELECT l_orderkey * 10 + l_linenumber AS o_orderkey, l_quantity, l_extendedprice, (l_discount > 0.05 AND l_quantity > 12)::INT AS y FROM lineitem),
cells AS (SELECT o_orderkey, y, 'l_quantity' AS feature, l_quantity AS value FROM t UNION ALL SELECT o_orderkey, y, 'l_extendedprice', l_extendedprice FROM t)"""


@query(
    "d8_threshold_proposals_two_keys",
    rounded_sql(f"WITH {PROPOSALS.replace(T_SQL, _LINES).replace(str(tuple(NUMERIC)), str(('l_quantity', 'l_extendedprice')))} SELECT * FROM pr", "threshold", 4),
)
def d8_threshold_proposals_two_keys(spark, sf_dir):
    """Ties are ordered by the key's columns when it has several, as when it is one number."""
    from catalog.common import table

    lines = table(spark, sf_dir, "lineitem").withColumn("y", ((F.col("l_discount") > 0.05) & (F.col("l_quantity") > 12)).cast("int"))
    t = I.make_task(lines, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice"])
    return rounded(I.threshold_proposals(t, F.col("y") == 1, CFG), 4)


@query("d8_numeric_candidates", rounded_sql(f"WITH {PROPOSALS} SELECT feature, pos, threshold FROM ca", "threshold", 4))
def d8_numeric_candidates(spark, sf_dir):
    cuts = I.numeric_candidates(task(spark, sf_dir), F.col("y") == 1, CFG)
    rows = [(f, i + 1, c) for f, cs in cuts.items() for i, c in enumerate(cs)]
    return rounded(spark.createDataFrame(rows, "feature string, pos bigint, threshold double"), 4)


FIRST_STEP = f"""{PROPOSALS}, lits AS (SELECT feature, op, threshold AS value, pos FROM ca, (SELECT unnest(['<', '>']) AS op)
  UNION ALL SELECT DISTINCT feature, '==', value, 0 FROM cells WHERE feature IN ('prio', 'status')),
ct AS (SELECT l.feature, l.op, l.value, any_value(l.pos) AS pos, count(c.y) FILTER (WHERE c.y = 1) AS p1, count(c.y) FILTER (WHERE c.y = 0) AS n1 FROM lits l
       LEFT JOIN cells c ON c.feature = l.feature AND CASE l.op WHEN '<' THEN c.value < l.value WHEN '>' THEN c.value > l.value ELSE c.value = l.value END GROUP BY l.feature, l.op, l.value),
tt AS (SELECT sum(y) AS p0, sum(1 - y) AS n0 FROM t),
gn AS (SELECT ct.*, p1 / (p1 + n1 + 1e-12) AS prec, CASE WHEN p1 < 1 THEN NULL ELSE p1 * (ln((p1 + 1e-9) / (p1 + n1 + 1e-9)) - ln((p0 + 1e-9) / (p0 + n0 + 1e-9))) END AS gain FROM ct, tt),
ford(feature, o) AS (VALUES {', '.join(f"('{f}', {i})" for i, f in enumerate(FEATURES))}),
od AS (SELECT gn.*, o, row_number() OVER (ORDER BY o, pos, CASE WHEN op = '==' THEN value ELSE 0 END,
              CASE WHEN op = '==' THEN 0 WHEN prec > other OR (prec = other AND op = '>') THEN 0 ELSE 1 END) AS ord
       FROM (SELECT *, CASE WHEN op = '==' THEN NULL ELSE sum(prec) OVER (PARTITION BY feature, value) - prec END AS other0,
                    max(CASE WHEN op = '<' THEN prec END) OVER (PARTITION BY feature, value) AS pl, max(CASE WHEN op = '>' THEN prec END) OVER (PARTITION BY feature, value) AS pg,
                    CASE op WHEN '<' THEN pg WHEN '>' THEN pl END AS other FROM gn) gn JOIN ford USING (feature))"""


def first_step(spark, sf_dir):
    t = task(spark, sf_dir)
    t.rows.persist()
    pos = F.col("y") == 1
    cuts = I.numeric_candidates(t, pos, CFG)
    counts = I.step_counts(t, None, pos, ~pos, cuts, I.count_sets(t, pos, ~pos), every_value=True)
    t.rows.unpersist()
    return t, cuts, counts, I.candidate_literals(t, counts, cuts)


@query("d9_candidate_literals", rounded_sql(f"WITH {FIRST_STEP} SELECT ord, feature, op, value FROM od", "value", 4))
def d9_candidate_literals(spark, sf_dir):
    _, _, _, order = first_step(spark, sf_dir)
    rows = [(i + 1, *lit) for i, lit in enumerate(order)]
    return rounded(spark.createDataFrame(rows, "ord bigint, feature string, op string, value double"), 4)


@query("d10_foil_gain", rounded_sql(f"WITH {FIRST_STEP} SELECT feature, op, value, p1, n1, gain FROM gn", "value gain", 4))
def d10_foil_gain(spark, sf_dir):
    from rulespark.functions import gain

    _, _, counts, order = first_step(spark, sf_dir)
    rows = [(*lit, *counts.literals[lit][:2], counts.pos, counts.neg) for lit in order]
    df = spark.createDataFrame(rows, "feature string, op string, value double, p1 bigint, n1 bigint, p0 bigint, n0 bigint")
    g = gain.foil_gain(F.col("p0"), F.col("n0"), F.col("p1"), F.col("n1"))
    return rounded(df.withColumn("gain", F.when(F.col("p1") >= 1, g)).drop("p0", "n0"), 4)


@query("d11_best_literal", rounded_sql(f"WITH {FIRST_STEP} SELECT feature, op, value, gain FROM od ORDER BY round(gain, 9) DESC NULLS LAST, ord LIMIT 1", "value gain", 4))
def d11_best_literal(spark, sf_dir):
    _, _, counts, order = first_step(spark, sf_dir)
    lit, g = I.best_literal(order, counts, [])
    return rounded(literal_rows(spark, [(*lit, g)], ", gain double"), 4)


# Thresholds that lie on data values, more than any cap that was ever there: 49 cuts, 99 slots.
_CUTS = [float(i) for i in range(2, 51)]


def _step_rows(spark, counts, order):
    rows = [(f, op, v, *counts.literals[(f, op, v)][:2]) for f, op, v in order]
    return spark.createDataFrame(rows, "feature string, op string, value double, p1 bigint, n1 bigint")


@query(
    "d11_counts_on_data_values",
    f"""WITH c AS (SELECT unnest({_CUTS}) AS v), y AS (SELECT l_quantity AS q, (l_discount > 0.05 AND l_quantity > 12)::INT AS y FROM lineitem)
    SELECT 'l_quantity' AS feature, op, v AS value, count(*) FILTER (WHERE y = 1 AND CASE op WHEN '<' THEN q < v ELSE q > v END) AS p1,
           count(*) FILTER (WHERE y = 0 AND CASE op WHEN '<' THEN q < v ELSE q > v END) AS n1 FROM y, c, (SELECT unnest(['<', '>']) AS op) GROUP BY op, v""",
)
def d11_counts_on_data_values(spark, sf_dir):
    from catalog.common import table

    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", ((F.col("l_discount") > 0.05) & (F.col("l_quantity") > 12)).cast("int").alias("y")
    )
    t = I.make_task(lines, ["l_orderkey", "l_linenumber"], ["l_quantity"])
    pos, cuts = F.col("y") == 1, {"l_quantity": _CUTS}
    counts = I.step_counts(t, None, pos, ~pos, cuts, I.count_sets(t, pos, ~pos))
    return _step_rows(spark, counts, I.candidate_literals(t, counts, cuts))


def _coded(spark, sf_dir, code):
    return task_rows(spark, sf_dir).withColumn("code", code.cast("double"))


_GAIN = "p1 * (ln((p1 + 1e-9) / (p1 + n1 + 1e-9)) - ln((p0 + 1e-9) / (p0 + n0 + 1e-9)))"


@query(
    "d11_wide_values_second_step",
    rounded_sql(
        f"""WITH {T_SQL}, i AS (SELECT y, (o_orderkey % 211)::DOUBLE AS code FROM t WHERE o_totalprice > 180000), tt AS (SELECT sum(y) AS p0, sum(1 - y) AS n0 FROM i),
        g AS (SELECT code, sum(y) AS p1, sum(1 - y) AS n1 FROM i GROUP BY code)
        SELECT 'code' AS feature, '==' AS op, code AS value, p1::BIGINT AS p1, n1::BIGINT AS n1, {_GAIN} AS gain FROM g, tt WHERE p1 >= 1 ORDER BY round({_GAIN}, 9) DESC, code LIMIT 1""",
        "gain",
    ),
)
def d11_wide_values_second_step(spark, sf_dir):
    """The best of 211 dictionary values inside a rule, where it differs from the best before the rule."""
    t = I.make_task(_coded(spark, sf_dir, F.col("o_orderkey") % 211), KEY, ["code", "o_totalprice"], dictionary=["code"])
    pos, inside = F.col("y") == 1, F.col("o_totalprice") > 180000
    base = I.count_sets(t, pos & inside, ~pos & inside)
    counts = I.step_counts(t, inside, pos, ~pos, {}, base, ["o_totalprice"])
    lit, g = I.best_literal(I.candidate_literals(t, counts, {}), counts, [])
    return rounded(spark.createDataFrame([(*lit, *counts.literals[lit][:2], g)], "feature string, op string, value double, p1 bigint, n1 bigint, gain double"))


@query(
    "d11_large_codes",
    f"""WITH {T_SQL}, c AS (SELECT y, (1000000 + 4 * (o_orderkey % 9))::DOUBLE AS code FROM t)
    SELECT 'code' AS feature, '==' AS op, v.code AS value, count(*) FILTER (WHERE y = 1) AS p1, count(*) FILTER (WHERE y = 0) AS n1
    FROM (SELECT DISTINCT code FROM c) v JOIN c ON abs(c.code - v.code) <= 1e-5 + 1e-5 * abs(v.code) GROUP BY v.code""",
)
def d11_large_codes(spark, sf_dir):
    """Codes whose neighbours the `==` test of a rule accepts too: growth counts what the rule will cover."""
    t = I.make_task(_coded(spark, sf_dir, F.col("o_orderkey") % 9 * 4 + 1_000_000), KEY, ["code"], dictionary=["code"])
    pos = F.col("y") == 1
    counts = I.step_counts(t, None, pos, ~pos, {}, I.count_sets(t, pos, ~pos), every_value=True)
    return _step_rows(spark, counts, I.candidate_literals(t, counts, {}))


def _grown_sql(max_literals: int, min_literals: int) -> str:
    """CTEs s1, s2, ...: the literal each growth step adds. Candidate order and thresholds are those of the first step."""
    parts = ["in0 AS (SELECT o_orderkey, y FROM t)"]
    for k in range(1, min(max_literals, len(FEATURES)) + 1):
        used = " ".join(f"AND od.feature NOT IN (SELECT feature FROM s{j})" for j in range(1, k))
        # a step needs the one before it, and negatives left once the rule is long enough
        go = "true" if k == 1 else f"EXISTS (SELECT 1 FROM s{k - 1}" + ("" if k <= min_literals else " WHERE n1 > 0") + ")"
        parts += [
            f"tt{k} AS (SELECT sum(y) AS p0, sum(1 - y) AS n0 FROM in{k - 1})",
            f"cc{k} AS (SELECT c.feature, c.value, sum(c.y) AS p, sum(1 - c.y) AS n FROM cells c JOIN in{k - 1} USING (o_orderkey) GROUP BY c.feature, c.value)",
            f"""ct{k} AS (SELECT od.feature, od.op, od.value, od.ord, coalesce(sum(p), 0) AS p1, coalesce(sum(n), 0) AS n1 FROM od
                 LEFT JOIN cc{k} c ON c.feature = od.feature AND CASE od.op WHEN '<' THEN c.value < od.value WHEN '>' THEN c.value > od.value ELSE c.value = od.value END
                 WHERE {go} {used} GROUP BY ALL)""",
            f"""s{k} AS (SELECT * FROM (SELECT feature, op, value, ord, p1, n1, p1 * (ln((p1 + 1e-9) / (p1 + n1 + 1e-9)) - ln((p0 + 1e-9) / (p0 + n0 + 1e-9))) AS gain
                 FROM ct{k}, tt{k} WHERE p1 >= 1 ORDER BY round(gain, 9) DESC, ord LIMIT 1) WHERE gain >= 1e-6)""",
            f"""in{k} AS (SELECT i.* FROM in{k - 1} i JOIN cells c USING (o_orderkey) JOIN s{k} s ON c.feature = s.feature AND
                 CASE s.op WHEN '<' THEN c.value < s.value WHEN '>' THEN c.value > s.value ELSE c.value = s.value END)""",
        ]
    steps = " UNION ALL ".join(f"SELECT {k}::BIGINT AS step, feature, op, value, p1::BIGINT AS pos, n1::BIGINT AS neg FROM s{k}" for k in range(1, min(max_literals, len(FEATURES)) + 1))
    return f"WITH {FIRST_STEP}, {', '.join(parts)} {steps}"


@query("d12_grow_rule", rounded_sql(_grown_sql(8, 2), "value", 4))
def d12_grow_rule(spark, sf_dir):
    pos = F.col("y") == 1
    t = task(spark, sf_dir)
    rule = I.grow_rule(t, pos, ~pos, CFG, max_literals=8, min_literals=2)
    counts = I.prefix_counts(t, rule, pos, ~pos, pos, pos)
    rows = [(i + 1, *lit, *counts.everything[i]) for i, lit in enumerate(rule)]
    return rounded(spark.createDataFrame(rows, "step bigint, feature string, op string, value double, pos bigint, neg bigint"), 4)


@query(
    "d13_grow_prune_split",
    f"""WITH {T_SQL}, c AS (SELECT y, count(*) AS n, least(count(*), greatest(1, round_even(count(*) * CASE WHEN y = 1 THEN 0.67::DOUBLE ELSE 0.5::DOUBLE END, 0)))::BIGINT AS g FROM t GROUP BY y)
    SELECT y, true AS grow, g AS n FROM c UNION ALL SELECT y, false, n - g FROM c""",
)
def d13_grow_prune_split(spark, sf_dir):
    t = task(spark, sf_dir)
    sizes = I.count_sets(t, F.col("y") == 1, F.col("y") == 0)
    rows = I.with_grow_part(t, F.col("y"), sizes, I.InductionConfig(algo="ripper"), 1)
    return rows.groupBy("y", F.col("_grow").alias("grow")).agg(F.count("*").alias("n"))


PREFIX_RULE = [("o_totalprice", ">", 180000.0), ("c_acctbal", ">", 1000.0), ("nation", "<", 20.0), ("prio", "==", 2.0)]


def _prefix_sql() -> str:
    parts = []
    for k in range(1, 5):
        cond = rule_sql(Rule(0, 1, tuple(PREFIX_RULE[:k])))
        hit = lambda extra: f"count(*) FILTER (WHERE {cond} AND {extra})"
        parts.append(
            f"SELECT {k} AS k, {hit('y = 1 AND o_orderkey % 3 = 0')} AS p, {hit('y = 0 AND o_orderkey % 3 = 0')} AS n, {hit('y = 1')} AS support, {hit('y = 0')} AS neg_covered, "
            "count(*) FILTER (WHERE y = 1 AND o_orderkey % 3 = 0) AS ap, count(*) FILTER (WHERE y = 0 AND o_orderkey % 3 = 0) AS an, count(*) FILTER (WHERE y = 1) AS tp FROM t"
        )
    return " UNION ALL ".join(parts)


PREFIXES = f"WITH {T_SQL}, px AS ({_prefix_sql()}), sc AS (SELECT *, (p + an - n) / (ap + an) + 1e-3 * (p + 1) / (p + n + 2) AS score FROM px WHERE p > 0)"


def prefixes(spark, sf_dir):
    t = task(spark, sf_dir)
    third, pos = F.col("o_orderkey") % 3 == 0, F.col("y") == 1
    return I.prefix_counts(t, PREFIX_RULE, pos & third, ~pos & third, pos, pos)


@query("d14_prune_rule", f"{PREFIXES} SELECT k::BIGINT AS length FROM sc ORDER BY round(score, 12) DESC, k LIMIT 1")
def d14_prune_rule(spark, sf_dir):
    return spark.createDataFrame([(I.best_prefix(prefixes(spark, sf_dir)),)], "length bigint")


@query(
    "d15_accept_rule",
    rounded_sql(
        f"{PREFIXES} SELECT k::BIGINT AS length, support, neg_covered, support / (support + neg_covered + 1e-12) AS precision, support / tp AS recall, "
        "support / (support + neg_covered + 1e-12) >= 0.8 AS accepted FROM px",
        "precision recall",
    ),
)
def d15_accept_rule(spark, sf_dir):
    counts = prefixes(spark, sf_dir)
    t = task(spark, sf_dir)
    n_pos, n = I.count_sets(t, F.col("y") == 1, F.lit(True))
    rows = []
    for k, (s, c) in enumerate(counts.everything, start=1):
        stats = I.rule_stats(s, c, n_pos, n)
        rows.append((k, s, c, stats["precision"], stats["recall"], stats["precision"] >= 0.8))
    return rounded(
        spark.createDataFrame(rows, "length bigint, support bigint, neg_covered bigint, precision double, recall double, accepted boolean")
    )


# ---------------------------------------------------------------- D16, D17


@query("d16_induce_class")
def d16_induce_class(spark, sf_dir):
    t = task(spark, sf_dir)
    t.rows.persist()
    sizes = {r["y"]: r["count"] for r in t.rows.groupBy("y").count().collect()}
    cfg = I.InductionConfig(algo="foil")
    rules = I.induce_class(t, 1, sizes, cfg, set(), 0)
    t.rows.unpersist()
    return rules_frame(spark, rules)


@query("d17_induce_rules_foil")
def d17_induce_rules_foil(spark, sf_dir):
    return rules_frame(spark, I.induce_rules(task_rows(spark, sf_dir), KEY, FEATURES, I.InductionConfig(algo="foil")))


@query("d17_induce_rules_ripper_documents")
def d17_induce_rules_ripper_documents(spark, sf_dir):
    coded, _ = P.encode_categoricals(docs(spark, sf_dir).withColumnRenamed("lang", "lang_code").withColumnRenamed("source", "source_code"))
    return rules_frame(
        spark,
        I.induce_rules(coded, ["doc_id"], DOC_FEATURES, I.InductionConfig(algo="ripper"), dictionary=["lang_code", "source_code"]),
    )
