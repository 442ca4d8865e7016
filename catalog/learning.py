"""Mass initialisation, training and the forest baseline (H, G6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import ORDER_FEATURES, ORDER_RULES, ORDERS_SQL, Registry, fired_sql, fused_sql, orders, rounded, rounded_sql
from rulespark.operators import activate as A, learn as L, metrics, prepare as P, predict
from rulespark.rules import OMEGA_FLOOR, rules_frame

registry = Registry()
query = registry.query


@query(
    "h1_init_masses_random",
    f"WITH {ORDERS_SQL}, {fired_sql('ord', 'o_orderkey', ORDER_RULES)} "
    "SELECT rule_id, count(*) AS n, 1.0::DOUBLE AS total, 0.65::DOUBLE AS omega, true AS in_range, true AS same_again FROM fired GROUP BY rule_id",
)
def h1_init_masses_random(spark, sf_dir):
    """What holds for every draw, for the masses each order's fired rules carry: range, sum, the given omega, and the seed's repetition."""
    drawn = lambda seed: rules_frame(spark, L.init_masses_random(ORDER_RULES, rule_uncertainty=0.65, seed=seed))
    frame = drawn(7).join(drawn(7).select("rule_id", F.col("mass").alias("again")), "rule_id").join(drawn(8).select("rule_id", F.col("mass").alias("other")), "rule_id")
    fired = A.activate(orders(spark, sf_dir), ORDER_RULES, ["o_orderkey"]).join(F.broadcast(frame), "rule_id")  # a row per rule
    total = F.aggregate("mass", F.lit(0.0), lambda a, x: a + x)
    in_range = F.forall(F.slice("mass", 1, 3), lambda x: (x > 0) & (x < 0.35))
    same = (F.col("mass") == F.col("again")) & (F.col("mass") != F.col("other"))
    sums = fired.groupBy("rule_id").agg(
        F.count("*").alias("n"), F.max(F.round(total, 12)).alias("total"), F.max(F.get("mass", F.lit(3))).alias("omega"),
        F.min(in_range).alias("in_range"), F.min(same).alias("same_again"),
    )
    return rounded(sums)


@query("h1_score_with_random_masses")
def h1_score_with_random_masses(spark, sf_dir):
    rules = L.init_masses_random(ORDER_RULES, rule_uncertainty=0.65)
    return predict.score(orders(spark, sf_dir), rules).groupBy("pred").agg(F.count("*").alias("n"), F.avg("unc_rule").alias("unc_rule"))


# Prices in thousands and balances in hundreds, so that distances are of the order of 1 to 100.
def scaled(spark, sf_dir):
    return orders(spark, sf_dir).withColumn("sp", F.col("o_totalprice") / 1e5).withColumn("sb", F.col("c_acctbal") / 1e4)


_FEATS = ["sp", "sb", "prio"]


@query(
    "h2_init_masses_coverage",
    rounded_sql(
        f"""WITH {ORDERS_SQL}, s AS (SELECT *, o_totalprice / 1e5 AS sp, c_acctbal / 1e4 AS sb FROM ord),
        ce AS (SELECT y, avg(sp) AS a, avg(sb) AS b, avg(prio) AS c FROM s GROUP BY y),
        rp AS (SELECT s.*, 1 / (1 + sqrt(pow(sp - a, 2) + pow(sb - b, 2) + pow(prio - c, 2))) AS rep FROM s JOIN ce USING (y)),
        {fired_sql('rp', ['y', 'rep'], ORDER_RULES)},
        g AS (SELECT rule_id, y, count(*) AS n, avg(rep) AS r FROM fired GROUP BY rule_id, y),
        d AS (SELECT *, sum(n) OVER (PARTITION BY rule_id) AS t, row_number() OVER (PARTITION BY rule_id ORDER BY n DESC, y) AS k FROM g),
        c AS (SELECT rule_id, y, least(greatest(r / (SELECT max(rep) FROM rp) * n / t, 0.05), 0.95) AS conf FROM d WHERE k = 1)
        SELECT rule_id, CASE WHEN y = 0 THEN conf ELSE 0 END AS m0, CASE WHEN y = 1 THEN conf ELSE 0 END AS m1, CASE WHEN y = 2 THEN conf ELSE 0 END AS m2,
               1 - conf AS om FROM c""",
        "m0 m1 m2 om",
    ),
)
def h2_init_masses_coverage(spark, sf_dir):
    rules = L.init_masses_coverage(scaled(spark, sf_dir), ORDER_RULES, _FEATS)
    frame = rules_frame(spark, rules)
    names = ["m0", "m1", "m2", "om"]
    return rounded(frame.select("rule_id", *[F.get("mass", F.lit(i)).alias(n) for i, n in enumerate(names)]))


@query("h3_train_masses")
def h3_train_masses(spark, sf_dir):
    start = L.init_masses_coverage(scaled(spark, sf_dir), ORDER_RULES, _FEATS)
    got = L.train_masses(orders(spark, sf_dir), ["o_orderkey"], start, L.TrainConfig(lr=0.1))
    return L.history_frame(spark, got)


_P = [f"(m{c} + om * r{c})" for c in range(3)]


@query(
    "h3_training_loss",
    rounded_sql(
        f"""WITH {ORDERS_SQL}, {fused_sql('ord', ['o_orderkey', 'y'], ORDER_RULES)},
        pr AS (SELECT max(w) FILTER (WHERE y = 0) / sum(w) AS r0, max(w) FILTER (WHERE y = 1) / sum(w) AS r1, max(w) FILTER (WHERE y = 2) / sum(w) AS r2
               FROM (SELECT y, sqrt(sum(count(*)) OVER () / count(*)) AS w FROM ord GROUP BY y)),
        l AS (SELECT ({' + '.join(f"pow({_P[c]} - (y = {c})::INT, 2)" for c in range(3))}) / 3 AS loss, unc_rule,
                     (CASE WHEN {_P[0]} >= {_P[1]} AND {_P[0]} >= {_P[2]} THEN 0 WHEN {_P[1]} >= {_P[2]} THEN 1 ELSE 2 END = y)::INT AS hit FROM fused, pr)
        SELECT avg(loss) AS train_loss, avg(loss) AS val_loss, avg(hit) AS acc, avg(unc_rule) AS unc_rule FROM l""",
        "train_loss val_loss acc unc_rule", 5,
    ),
)
def h3_training_loss(spark, sf_dir):
    """The state training starts from: loss, accuracy and mean rule omega over all orders at the given masses."""
    got = L.train_masses(orders(spark, sf_dir), ["o_orderkey"], ORDER_RULES, L.TrainConfig(epochs=0, val_split=0.0))
    return rounded(L.history_frame(spark, got).select("train_loss", "val_loss", "acc", "unc_rule"), 5)


# --- the first three epochs of full-batch AdamW, recomputed in SQL ---

EPOCHS, RATE = 3, 0.1
_K = range(3)
_J = range(4)  # the classes, then omega


def _epoch_sql(e: int) -> list[str]:
    """CTEs of epoch e from l{e} (logits, first and second moments per rule): masses, fusion per pattern, loss, next step."""
    each = lambda form, over=_J: ", ".join(form.format(j=j) for j in over)
    plus = lambda form, over=_J: " + ".join(form.format(j=j) for j in over)
    t = e + 1
    return [
        f"x{e} AS MATERIALIZED (SELECT *, {each('exp(l{j} - greatest(l0, l1, l2, l3)) AS x{j}')} FROM l{e})",
        f"m{e} AS MATERIALIZED (SELECT * EXCLUDE (x0, x1, x2, x3), {each('x{j} / (x0 + x1 + x2 + x3) AS m{j}', _K)}, greatest(x3 / (x0 + x1 + x2 + x3), {OMEGA_FLOOR}) AS m3 FROM x{e})",
        f"u{e} AS (SELECT pid, any_value(y) AS y, any_value(n) AS n, coalesce(avg(m3), 1.0) AS omega, "
        f"{each('coalesce(sum(ln(1 + m{j} / m3)), 0.0) AS s{j}', _K)} FROM pat LEFT JOIN hit USING (pid) LEFT JOIN m{e} USING (rule_id) GROUP BY pid)",
        f"v{e} AS (SELECT *, greatest(0.0, s0, s1, s2) AS top FROM u{e})",
        f"w{e} AS (SELECT *, exp(-top) AS low, {each('exp(s{j} - top) AS g{j}', _K)} FROM v{e})",
        f"z{e} AS (SELECT *, g0 + g1 + g2 - 2 * low AS z FROM w{e})",
        f"p{e} AS (SELECT *, {each('(g{j} - low + low * r{j}) / z AS p{j}', _K)} FROM z{e}, prior)",
        f"q{e} AS MATERIALIZED (SELECT *, {each('2 * (p{j} - (y = {j})::INT) / 3 AS d{j}', _K)} FROM p{e})",
        f"""h{e} AS MATERIALIZED (SELECT {e} AS epoch, sum(n * ({plus('pow(p{j} - (y = {j})::INT, 2)', _K)}) / 3) / sum(n) AS train_loss,
             sum(n * (CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END = y)::INT) / sum(n) AS acc, sum(n * omega) / sum(n) AS unc_rule FROM q{e})""",
        f"a{e} AS (SELECT *, {plus('d{j} * p{j}', _K)} AS mean FROM q{e})",
        f"b{e} AS (SELECT pid, n, {each('(d{j} - mean) * g{j} / z AS a{j}', _K)}, ({plus('d{j} * r{j}', _K)} - mean - ({plus('d{j} - mean', _K)})) * low / z AS a3 FROM a{e})",
        f"c{e} AS (SELECT rule_id, {each('sum(n * a{j}) / (SELECT sum(n) FROM pat) AS t{j}')} FROM hit JOIN b{e} USING (pid) GROUP BY rule_id)",
        f"d{e} AS (SELECT m{e}.*, {each('coalesce(t{j}, 0.0) / (m{j} + m3) AS f{j}', _K)}, coalesce(t3, 0.0) / m3 AS own FROM m{e} LEFT JOIN c{e} USING (rule_id))",
        f"e{e} AS (SELECT * EXCLUDE (own), f0 + f1 + f2 + own AS f3 FROM d{e})",
        f"f{e} AS MATERIALIZED (SELECT *, {each('m{j} * (f{j} - (f0 * m0 + f1 * m1 + f2 * m2 + f3 * m3)) AS y{j}')} FROM e{e})",
        f"n{e} AS (SELECT greatest(1.0, sqrt(sum({plus('y{j} * y{j}')}))) AS norm FROM f{e})",
        f"""o{e} AS (SELECT rule_id, {each('l{j}')}, {each('0.9 * first{j} + 0.1 * y{j} / norm AS first{j}')},
             {each('0.999 * second{j} + 0.001 * pow(y{j} / norm, 2) AS second{j}')} FROM f{e}, n{e})""",
        f"""k{e} AS (SELECT * EXCLUDE (l0, l1, l2, l3), {each(f"l{{j}} - {RATE} * (first{{j}} / {1 - 0.9**t!r}) / (sqrt(second{{j}} / {1 - 0.999**t!r}) + 1e-8) AS l{{j}}")} FROM o{e})""",
        f"l{t} AS MATERIALIZED (SELECT * EXCLUDE (l0, l1, l2, l3), {each('least(greatest(l{j} - (l0 + l1 + l2 + l3) / 4, -12.0), 12.0) AS l{j}')} FROM k{e})",
    ]


def _training_sql() -> str:
    start = ", ".join("(" + ", ".join([str(r.rule_id), *[repr(max(v, 1e-8)) + "::DOUBLE" for v in r.safe_mass]]) + ")" for r in ORDER_RULES)
    logits = ", ".join(f"least(greatest(ln(m{j}) - (ln(m0) + ln(m1) + ln(m2) + ln(m3)) / 4, -12.0), 12.0) AS l{j}" for j in _J)
    zero = ", ".join(f"0.0::DOUBLE AS {c}{j}" for c in ("first", "second") for j in _J)
    parts = [
        ORDERS_SQL.strip(), fired_sql("ord", ["o_orderkey", "y"], ORDER_RULES),
        "sets AS (SELECT o.y, coalesce(f.rules, []) AS rules FROM ord o LEFT JOIN (SELECT o_orderkey, list(rule_id ORDER BY rule_id) AS rules FROM fired GROUP BY o_orderkey) f USING (o_orderkey))",
        "pat AS MATERIALIZED (SELECT row_number() OVER (ORDER BY rules, y) AS pid, rules, y, n FROM (SELECT rules, y, count(*) AS n FROM sets GROUP BY ALL))",
        "hit AS MATERIALIZED (SELECT pid, unnest(rules) AS rule_id FROM pat)",
        """prior AS (SELECT max(w) FILTER (WHERE y = 0) / sum(w) AS r0, max(w) FILTER (WHERE y = 1) / sum(w) AS r1, max(w) FILTER (WHERE y = 2) / sum(w) AS r2
                  FROM (SELECT y, sqrt(sum(count(*)) OVER () / count(*)) AS w FROM ord GROUP BY y))""",
        f"l0 AS MATERIALIZED (SELECT rule_id, {logits}, {zero} FROM (VALUES {start}) v(rule_id, m0, m1, m2, m3))",
    ]
    for e in range(EPOCHS + 1):
        parts += _epoch_sql(e)
    return "WITH " + ", ".join(parts)


def _trained(spark, sf_dir):
    """Every order trains and validates, so that no draw of a validation part stands between the two sides."""
    return L.train_masses(orders(spark, sf_dir), ["o_orderkey"], ORDER_RULES, L.TrainConfig(epochs=EPOCHS, lr=RATE, val_split=0.0))


@query(
    "h3_training_epochs",
    rounded_sql(
        f"{_training_sql()} {' UNION ALL '.join(f'SELECT epoch, train_loss, train_loss AS val_loss, acc, unc_rule FROM h{e}' for e in range(EPOCHS + 1))}",
        "train_loss val_loss acc unc_rule",
    ),
)
def h3_training_epochs(spark, sf_dir):
    """Loss, accuracy and mean rule omega before training and after each of three epochs."""
    return rounded(L.history_frame(spark, _trained(spark, sf_dir)).select("epoch", "train_loss", "val_loss", "acc", "unc_rule"))


@query(
    "h3_masses_after_epochs",
    rounded_sql(
        f"{_training_sql()} SELECT rule_id::BIGINT AS rule_id, m0, m1, m2, m3 AS om FROM m{EPOCHS} "
        f"WHERE (SELECT train_loss FROM h{EPOCHS}) < least({', '.join(f'(SELECT train_loss FROM h{e})' for e in range(EPOCHS))})",
        "m0 m1 m2 om",
    ),
)
def h3_masses_after_epochs(spark, sf_dir):
    """The masses of the best epoch; the SQL has rows only if that is the last one, as it must be while losses fall."""
    frame = rules_frame(spark, _trained(spark, sf_dir).rules)
    return rounded(frame.select(F.col("rule_id").cast("bigint").alias("rule_id"), *[F.get("mass", F.lit(i)).alias(n) for i, n in enumerate(["m0", "m1", "m2", "om"])]))


@query(
    "h4_train_val_split",
    f"WITH {ORDERS_SQL}, s AS (SELECT least(greatest(1, round(0.2 * count(*))), count(*) - 1)::BIGINT AS v, count(*) AS n FROM ord) "
    "SELECT true AS is_val, v AS n FROM s UNION ALL SELECT false, n - v FROM s",
)
def h4_train_val_split(spark, sf_dir):
    split = P.train_val_split(orders(spark, sf_dir), ["o_orderkey"])
    return split.groupBy("is_val").agg(F.count("*").alias("n"))


@query("g6_random_forest_baseline")
def g6_random_forest_baseline(spark, sf_dir):
    split = P.stratified_split(orders(spark, sf_dir), ["o_orderkey"], test_size=0.2)
    train, test = split.where("part = 'train'"), split.where("part = 'test'")
    scored = predict.random_forest_baseline(train, test, ORDER_FEATURES, 3)
    return rounded(metrics.compute_metrics(scored, 3, proba="rf_proba", pred="rf_pred"))
