"""Preparation queries (B) over orders, customers, events and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import LINES_SQL, ORDERS_SQL, Registry, docs, lines, orders, rounded, rounded_sql, table
from rulespark.operators import order_stats as O, prepare as P

registry = Registry()
query = registry.query


# Orders with holes: a quarter of the prices NULL, some balances NaN.
def _holes(spark, sf_dir):
    return orders(spark, sf_dir).select(
        "o_orderkey",
        F.when(F.col("status") != 1, F.col("o_totalprice")).alias("price"),
        F.when(F.col("nation") > 3, F.col("c_acctbal")).otherwise(F.lit(float("nan"))).alias("bal"),
    )


@query(
    "b1_drop_incomplete",
    f"WITH {ORDERS_SQL} SELECT o_orderkey, o_totalprice AS price, c_acctbal AS bal FROM ord WHERE status <> 1 AND nation > 3",
)
def b1_drop_incomplete(spark, sf_dir):
    return P.drop_incomplete(_holes(spark, sf_dir))


ID_TABLES = {
    "customer": ["c_custkey", "c_nationkey"],
    "orders": ["o_orderkey", "o_custkey"],
    "events": ["event_id", "user_id"],
    "lineitem": ["l_orderkey", "l_partkey", "l_linenumber"],
    "embeddings": ["vec_id", "label"],
}


def _id_sql(t: str, c: str) -> str:
    return (
        f"SELECT '{t}' AS tbl, '{c}' AS col, regexp_matches('{c}', '^id_|_id$') OR "
        f"list_has_any(string_split_regex('{c}', '[^a-z0-9]+'), ['id', 'uid', 'identifier']) OR "
        f"(min({c}) IN (0, 1) AND max({c}) = min({c}) + count(*) - 1 AND count(DISTINCT {c}) = count(*)) AS id_like FROM {t}"
    )


@query("b2_drop_id_like", " UNION ALL ".join(_id_sql(t, c) for t, cols in ID_TABLES.items() for c in cols))
def b2_drop_id_like(spark, sf_dir):
    rows = []
    for t, cols in ID_TABLES.items():
        found = P.id_like_columns(table(spark, sf_dir, t).select(*cols))
        rows += [(t, c, c in found) for c in cols]
    return spark.createDataFrame(rows, "tbl string, col string, id_like boolean")


@query("b3_drop_excluded", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def b3_drop_excluded(spark, sf_dir):
    return P.drop_excluded(table(spark, sf_dir, "customer"), "Customer", {"customer": ("c_name", "c_mktsegment")})


LABEL_TABLES = {
    "embeddings": ["vec_id", "label"],
    "labels": ["doc_id", "quality", "toxic"],
    "lineitem": ["l_quantity", "l_returnflag", "l_linestatus", "l_tax"],
    "orders": ["o_totalprice", "o_orderpriority", "o_orderstatus"],
    "part": ["p_retailprice", "p_partkey"],
}
_FLOAT_COLUMNS = ("l_quantity", "l_tax", "o_totalprice", "p_retailprice")
_LABEL_FACTS = " UNION ALL ".join(
    f"SELECT '{t}' AS tbl, '{c}' AS col, {i} AS pos, {c == 'label'} AS named, {c in _FLOAT_COLUMNS} AS is_float, count(*) AS nd, "
    f"abs(max(n) / sum(n) - 0.5) AS imbalance FROM (SELECT {c}, count(*) AS n FROM {t} GROUP BY 1)"
    for t, cols in LABEL_TABLES.items() for i, c in enumerate(cols)
)


@query(
    "b4_pick_label",
    f"""WITH f AS ({_LABEL_FACTS}), k AS (SELECT *, CASE WHEN named THEN 0 WHEN nd = 2 AND NOT is_float THEN 1 WHEN nd BETWEEN 2 AND 10 THEN 2 ELSE 3 END AS kind FROM f)
        SELECT tbl, col AS label FROM (SELECT *, row_number() OVER (PARTITION BY tbl ORDER BY kind, CASE WHEN kind = 1 THEN imbalance ELSE 0 END,
               CASE WHEN kind <= 1 THEN pos ELSE -pos END) AS r FROM k) WHERE r = 1""",
)
def b4_pick_label(spark, sf_dir):
    picks = {t: table(spark, sf_dir, t).select(*cols) for t, cols in LABEL_TABLES.items()}
    return spark.createDataFrame([(t, P.pick_label(df)) for t, df in picks.items()], "tbl string, label string")


@query("b5_factorize_label", "SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INTEGER AS y FROM orders")
def b5_factorize_label(spark, sf_dir):
    coded, _ = P.factorize_label(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority")
    return coded.select("o_orderkey", "y")


ENCODED = """SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::DOUBLE AS o_orderpriority,
    (dense_rank() OVER (ORDER BY o_orderstatus) - 1)::DOUBLE AS o_orderstatus FROM orders"""


@query("b6_encode_categoricals", ENCODED)
def b6_encode_categoricals(spark, sf_dir):
    raw = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return P.encode_categoricals(raw)[0]


@query(
    "b6_value_dictionary_wide",
    "SELECT 'p_name' AS feature, (dense_rank() OVER (ORDER BY p_name) - 1)::INTEGER AS code, p_name AS value FROM (SELECT DISTINCT p_name FROM part)"
    " UNION ALL SELECT 'p_type', (dense_rank() OVER (ORDER BY p_type) - 1)::INTEGER, p_type FROM (SELECT DISTINCT p_type FROM part)",
)
def b6_value_dictionary_wide(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    pairs = part.select(F.lit("p_name").alias("feature"), F.col("p_name").alias("value")).unionByName(
        part.select(F.lit("p_type").alias("feature"), F.col("p_type").alias("value"))
    )
    values = pairs.distinct()
    return P._bucketed_codes(values, values.count())


@query(
    "b7_encode_with_dictionary",
    """WITH ld AS (SELECT o_orderpriority AS v, (row_number() OVER (ORDER BY o_orderpriority) - 1)::INTEGER AS y FROM
                   (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority NOT LIKE '3%')),
            vd AS (SELECT o_orderstatus AS v, (row_number() OVER (ORDER BY o_orderstatus) - 1)::DOUBLE AS c FROM
                   (SELECT DISTINCT o_orderstatus FROM orders WHERE o_orderstatus <> 'O'))
       SELECT o_orderkey::DOUBLE AS o_orderkey, o_totalprice, coalesce(c, -1.0) AS o_orderstatus, y
       FROM orders JOIN ld ON o_orderpriority = ld.v LEFT JOIN vd ON o_orderstatus = vd.v""",
)
def b7_encode_with_dictionary(spark, sf_dir):
    raw = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    label_dim = P.label_dictionary(raw.where(~F.col("o_orderpriority").startswith("3")), "o_orderpriority")
    value_dim = P.value_dictionary(raw.where("o_orderstatus <> 'O'"), ["o_orderstatus"])
    noisy = raw.withColumn("__source", F.lit("x")).withColumn("sample_idx", F.col("o_orderkey"))
    noisy = noisy.withColumn("o_orderstatus", F.concat(F.lit(" "), F.col("o_orderstatus")))
    return P.encode_outliers(noisy, "o_orderpriority", label_dim, value_dim, ["o_orderstatus"])


@query(
    "b7_encode_parse_unknown",
    """WITH vd AS (SELECT v, (row_number() OVER (ORDER BY v) - 1)::DOUBLE AS c FROM
                   (SELECT DISTINCT c_mktsegment AS v FROM customer WHERE c_nationkey < 12 AND c_mktsegment < 'C'))
       SELECT c_custkey, coalesce(c, CASE WHEN c_mktsegment < 'H' THEN 0.0 ELSE c_nationkey::DOUBLE END) AS seg
       FROM customer LEFT JOIN vd ON c_mktsegment = v""",
)
def b7_encode_parse_unknown(spark, sf_dir):
    raw = table(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "seg")
    dim = P.value_dictionary(raw.where("c_nationkey < 12 AND seg < 'C'"), ["seg"])
    # Later segments carry a number instead of a word: those parse.
    mixed = raw.withColumn("seg", F.when(F.col("seg") < "H", F.col("seg")).otherwise(F.col("c_nationkey").cast("string")))
    return P.encode_with_dictionary(mixed, dim, ["seg"], unknown="parse").select("c_custkey", "seg")


@query("b9_decode_features", "SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders")
def b9_decode_features(spark, sf_dir):
    raw = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    coded, dim = P.encode_categoricals(raw)
    return P.decode_features(coded, dim, ["o_orderpriority", "o_orderstatus"])


@query(
    "b10_standardize",
    rounded_sql(
        f"WITH {ORDERS_SQL}, s AS (SELECT avg(o_totalprice) a, stddev_pop(o_totalprice) b, avg(c_acctbal) c, stddev_pop(c_acctbal) d, "
        "avg(prio) e, stddev_pop(prio) f FROM ord) SELECT o_orderkey, (o_totalprice - a) / b AS o_totalprice, (c_acctbal - c) / d AS c_acctbal, "
        "(prio - e) / f AS prio, 0.0 AS flat FROM ord, s",
        "o_totalprice c_acctbal prio flat",
    ),
)
def b10_standardize(spark, sf_dir):
    base = orders(spark, sf_dir).withColumn("flat", F.lit(7.0))
    cols = ["o_totalprice", "c_acctbal", "prio", "flat"]
    return rounded(P.standardize(base, P.standardize_stats(base, cols)).select("o_orderkey", *cols))


@query(
    "b11_stratified_split_sizes",
    f"""WITH {ORDERS_SQL}, c AS (SELECT y, count(*) AS n, sum(count(*)) OVER () AS t FROM ord GROUP BY y),
        s AS (SELECT y, n, ceil(0.16 * t) AS w, ceil(0.16 * t) * n / t AS share FROM c),
        r AS (SELECT y, n, floor(share) + CASE WHEN row_number() OVER (ORDER BY share - floor(share) DESC, y)
                     <= w - sum(floor(share)) OVER () THEN 1 ELSE 0 END AS test FROM s)
        SELECT y, 'test' AS part, test::BIGINT AS n FROM r UNION ALL SELECT y, 'train', (n - test)::BIGINT FROM r""",
)
def b11_stratified_split_sizes(spark, sf_dir):
    split = P.stratified_split(orders(spark, sf_dir), ["o_orderkey"])
    return split.groupBy("y", "part").agg(F.count("*").alias("n"))


@query(
    "b11_split_many_classes",
    """WITH c AS (SELECT o_custkey % 450 AS y, count(*) AS n, sum(count(*)) OVER () AS t FROM orders GROUP BY 1),
        s AS (SELECT y, n, ceil(0.16 * t) AS w, ceil(0.16 * t) * n / t AS share FROM c),
        r AS (SELECT y, n, floor(share) + CASE WHEN row_number() OVER (ORDER BY share - floor(share) DESC, y::VARCHAR)
                     <= w - sum(floor(share)) OVER () THEN 1 ELSE 0 END AS test FROM s)
        SELECT y, 'test' AS part, test::BIGINT AS n FROM r WHERE test > 0 UNION ALL SELECT y, 'train', (n - test)::BIGINT FROM r WHERE n > test""",
)
def b11_split_many_classes(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 450).alias("y"))
    return P.stratified_split(rows, ["o_orderkey"]).groupBy("y", "part").agg(F.count("*").alias("n"))


@query(
    "b11_modulus_split",
    f"WITH {ORDERS_SQL} SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS part FROM ord",
)
def b11_modulus_split(spark, sf_dir):
    return P.modulus_split(orders(spark, sf_dir), "o_orderkey").select("o_orderkey", "part")


@query(
    "b12_upsample_minority",
    """WITH s AS (SELECT count(*) AS n, count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS p FROM orders)
       SELECT 1 AS y, round(0.35 * n / 0.65)::BIGINT AS n FROM s UNION ALL SELECT 0, (n - p)::BIGINT FROM s""",
)
def b12_upsample_minority(spark, sf_dir):
    base = orders(spark, sf_dir).withColumn("y", (F.col("prio") == 0).cast("int"))
    return P.upsample_minority(base, ["o_orderkey"]).groupBy("y").agg(F.count("*").alias("n"))


PROFILE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "rf"]


def _kind_sql(cols, src: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS f, count(DISTINCT {c}) AS d, max(abs({c} - round({c}))) AS off FROM {src}" for c in cols
    )


@query(
    "b13_dataset_profile",
    rounded_sql(
        f"""WITH {LINES_SQL}, k AS ({_kind_sql(PROFILE_FEATURES, 'lines')}),
        z AS (SELECT count(*) FILTER (WHERE d <= 2 OR (d <= 20 AND off <= 1e-8))::INTEGER AS disc, count(*)::INTEGER AS nf,
                     count(*) FILTER (WHERE d <= 2)::INTEGER AS bin FROM k),
        c AS (SELECT sum(n)::BIGINT AS n, count(*) AS kk, max(n) / sum(n) AS m FROM (SELECT count(*) AS n FROM lines GROUP BY y))
        SELECT n AS n_samples, nf AS n_features, kk AS n_classes, m AS majority_ratio, nf - disc AS num_like, disc AS disc_like,
               bin AS bin_like, kk = 2 AS binary_task, nf <= 8 AND nf - disc >= disc AS low_d_continuous,
               disc >= nf - disc + 4 AS categorical_heavy, nf - disc >= 32 AS high_dim_continuous, m >= 0.80 AS imbalanced,
               n < 1500 AS small_dataset, kk = 2 AND n >= 5000 AS threshold_tuning_candidate FROM z, c""",
        "majority_ratio",
    ),
)
def b13_dataset_profile(spark, sf_dir):
    return rounded(P.dataset_profile(lines(spark, sf_dir), PROFILE_FEATURES))


def _numeric_schema_sql(t: str, c: str, whole: bool) -> str:
    step = "1.0::DOUBLE" if whole else f"greatest((max({c}) - min({c})) / 100.0, 0.01)"
    return (
        f"SELECT '{c}' AS feature, 'numeric' AS kind, NULL AS choice, min({c})::DOUBLE AS \"min\", max({c})::DOUBLE AS \"max\", "
        f"quantile_cont({c}, 0.5)::DOUBLE AS \"default\", {step} AS step FROM {t}"
    )


def _choice_schema_sql(t: str, c: str) -> str:
    return f"SELECT DISTINCT '{c}', 'categorical', {c}::VARCHAR, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE FROM {t}"


@query(
    "b15_infer_feature_schema",
    rounded_sql(
        "WITH j AS (SELECT c.*, n_regionkey FROM customer c JOIN nation ON c_nationkey = n_nationkey) "
        + " UNION ALL ".join(
            [
                _numeric_schema_sql("j", "c_acctbal", False),
                _numeric_schema_sql("j", "c_nationkey", True),
                _choice_schema_sql("j", "n_regionkey"),
                _choice_schema_sql("j", "c_mktsegment"),
            ]
        ),
        '"min" "max" "default" step',
    ),
)
def b15_infer_feature_schema(spark, sf_dir):
    nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))  # 25 rows by definition
    j = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rounded(P.infer_feature_schema(j, ["c_acctbal", "c_nationkey", "n_regionkey", "c_mktsegment"]))


@query(
    "b15_schema_of_model",
    """SELECT 1 AS position, 'o_orderpriority' AS feature, 'categorical' AS kind, (row_number() OVER (ORDER BY v) - 1)::INTEGER AS code, v AS choice
       FROM (SELECT DISTINCT o_orderpriority AS v FROM orders) UNION ALL SELECT 0, 'o_totalprice', 'numeric', NULL, NULL""",
)
def b15_schema_of_model(spark, sf_dir):
    dim = P.value_dictionary(table(spark, sf_dir, "orders"), ["o_orderpriority"])
    return P.feature_schema_of_model(spark, ["o_totalprice", "o_orderpriority"], dim)


@query(
    "b16_split_feature_kinds",
    f"""WITH {LINES_SQL}, k AS ({_kind_sql(PROFILE_FEATURES + ['l_linenumber'], 'lines')})
        SELECT f AS feature, CASE WHEN d <= 32 AND off <= 1e-8 THEN 'categorical' ELSE 'numeric' END AS integer32,
               CASE WHEN d <= 20 THEN 'categorical' ELSE 'numeric' END AS any20 FROM k""",
)
def b16_split_feature_kinds(spark, sf_dir):
    base = lines(spark, sf_dir)
    cols = [*PROFILE_FEATURES, "l_linenumber"]
    a = P.feature_kinds(base, cols)
    b = P.feature_kinds(base, cols, cat_threshold=20, require_integer=False)
    return spark.createDataFrame([(c, a[c], b[c]) for c in cols], "feature string, integer32 string, any20 string")


@query("b17_align_features", f"WITH {ORDERS_SQL} SELECT o_orderkey, prio, o_totalprice, nation FROM ord")
def b17_align_features(spark, sf_dir):
    return P.align_features(orders(spark, sf_dir), ["prio", "o_totalprice", "nation"], ["o_orderkey"])


@query(
    "b18_one_hot",
    f"WITH {ORDERS_SQL} SELECT o_orderkey, (prio = 0)::INT::DOUBLE AS c0, (prio = 1)::INT::DOUBLE AS c1, (prio = 2)::INT::DOUBLE AS c2 FROM ord",
)
def b18_one_hot(spark, sf_dir):
    base = orders(spark, sf_dir).withColumn("h", P.one_hot(F.col("prio").cast("int"), 3))
    return base.select("o_orderkey", *[F.get("h", F.lit(i)).alias(f"c{i}") for i in range(3)])


@query(
    "b20_statistic_breaks",
    rounded_sql(
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, i::INTEGER AS pos, m - 2 * s + i * s AS threshold FROM "
            f"(SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM lineitem), (SELECT unnest(range(5)) AS i)"
            for c in ("l_quantity", "l_discount", "l_extendedprice")
        ),
        "threshold",
        5,
    ),
)
def b20_statistic_breaks(spark, sf_dir):
    return rounded(P.statistic_breaks(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_extendedprice"]), 5)


@query("b21_natural_breaks")
def b21_natural_breaks(spark, sf_dir):
    return P.natural_breaks(table(spark, sf_dir, "orders"), "o_totalprice", k=5)


def _least_cost(k: int) -> str:
    """Thresholds of the k ranges of least cost: one layer of dynamic programming over all (start, end) per cluster."""
    cost = "(e.q - s.q) - (e.t - s.t) * (e.t - s.t) / (e.c - s.c)"
    layers = ["d1 AS (SELECT e.i AS j, q - t * t / c AS best, 1 AS start FROM p e WHERE i > 0)"]
    for n in range(2, k + 1):
        layers.append(f"d{n} AS (SELECT e.i AS j, min(d.best + {cost}) AS best, arg_min(s.i + 1, d.best + {cost}) AS start FROM d{n - 1} d JOIN p s ON s.i = d.j JOIN p e ON e.i > s.i GROUP BY e.i)")
    ends = [f"e{k} AS (SELECT max(i) AS j FROM p)"] + [f"e{n} AS (SELECT start - 1 AS j FROM d{n + 1} JOIN e{n + 1} USING (j))" for n in range(k - 1, 0, -1)]
    picks = " UNION ALL ".join(f"SELECT {n - 1} AS pos, x AS threshold FROM p JOIN e{n} ON i = j" for n in range(1, k + 1))
    return f"""WITH v AS (SELECT c_acctbal::DOUBLE - (SELECT avg(c_acctbal) FROM customer) AS z, c_acctbal::DOUBLE AS x, count(*) AS n FROM customer GROUP BY ALL),
        p AS (SELECT row_number() OVER w AS i, x, sum(n) OVER w AS c, sum(n * z) OVER w AS t, sum(n * z * z) OVER w AS q FROM v WINDOW w AS (ORDER BY x)
              UNION ALL SELECT 0, NULL, 0, 0, 0), {", ".join(layers)}, {", ".join(ends)} {picks}"""


@query("b21_natural_breaks_customers", rounded_sql(_least_cost(4), "threshold"))
def b21_natural_breaks_customers(spark, sf_dir):
    return rounded(P.natural_breaks(table(spark, sf_dir, "customer"), "c_acctbal", k=4))


@query(
    "b22_filter_by_rule_confidence",
    rounded_sql(
        f"""WITH {LINES_SQL}, g AS (SELECT rf::INTEGER AS c, count(*) AS n, avg(least(abs(l_extendedprice - 40000) / 100000, 1.0)) AS d
                FROM lines WHERE l_quantity > 30 AND l_discount < 0.07 GROUP BY 1),
        b AS (SELECT c AS dominant, (SELECT sum(n) FROM g)::BIGINT AS n_rows, (1 - d) * n / (SELECT sum(n) FROM g) AS confidence
              FROM g ORDER BY n DESC, c LIMIT 1)
        SELECT *, CASE WHEN dominant = 0 THEN confidence ELSE (1 - confidence) / 2 END AS p0,
               CASE WHEN dominant = 1 THEN confidence ELSE (1 - confidence) / 2 END AS p1,
               CASE WHEN dominant NOT IN (0, 1) THEN confidence ELSE (1 - confidence) / 2 END AS p2 FROM b""",
        "confidence p0 p1 p2",
    ),
)
def b22_filter_by_rule_confidence(spark, sf_dir):
    base = lines(spark, sf_dir).select(
        "l_quantity", "l_discount", F.col("rf").cast("int").alias("cluster_id"),
        F.least(F.abs(F.col("l_extendedprice") - 40000) / 100000, F.lit(1.0)).alias("distance_norm"),
    )
    return rounded(P.filter_by_rule_confidence(base, (F.col("l_quantity") > 30) & (F.col("l_discount") < 0.07)))


QUANTILES = [0.05, 0.15, 0.30, 0.50, 0.70, 0.85, 0.95]


@query(
    "exact_quantiles_bucketed",
    rounded_sql(
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, " + ", ".join(f"quantile_cont({c}, {q}) AS q{i}" for i, q in enumerate(QUANTILES)) + " FROM lineitem"
            for c in ("l_extendedprice", "l_quantity")
        ),
        " ".join(f"q{i}" for i in range(len(QUANTILES))),
        4,
    ),
)
def exact_quantiles_bucketed(spark, sf_dir):
    from rulespark.operators.activate import melt

    cells = melt(table(spark, sf_dir, "lineitem"), [], ["l_extendedprice", "l_quantity"])
    return rounded(O.exact_quantiles(cells, ["feature"], QUANTILES).drop("size"), 4)
