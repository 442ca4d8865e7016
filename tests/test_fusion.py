"""Fusion algebra, activation forms and prediction rules on small tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulespark.functions import mass as M
from rulespark.operators import activate as A, explain as X, fuse, predict
from rulespark.rules import Rule, RuleSet, rules_frame


def pair(a, b, rule="dempster"):
    k = len(a) - 1
    s = [a[i] * b[i] + a[i] * b[k] + a[k] * b[i] for i in range(k)]
    o = a[k] * b[k]
    conflict = sum(a[i] * b[j] for i in range(k) for j in range(k) if i != j)
    if rule == "yager":
        return [*s, o + conflict]
    t = sum(s) + o
    return [x / t for x in [*s, o]]


def fold(masses, k, rule="dempster"):
    acc = [0.0] * k + [1.0]
    for m in masses:
        acc = pair(acc, m, rule)
    return acc


@pytest.fixture(scope="module")
def random_case(spark):
    rng = random.Random(7)
    rows = [(i, rng.uniform(-5, 5), float(rng.randint(0, 3)), rng.choice([1.0, float("nan"), 2.5, float("inf")])) for i in range(300)]
    rules = []
    for r in range(40):
        lits = []
        for f in rng.sample(["a", "b", "c"], rng.randint(1, 3)):
            lits.append((f, "==", float(rng.randint(0, 3))) if f == "b" else (f, rng.choice("<>"), round(rng.uniform(-4, 4), 2)))
        w = [rng.random() for _ in range(4)]
        mass = tuple(x / sum(w) for x in w)
        rules.append(Rule(r, rng.choice([0, 1, 2, None]), tuple(lits), mass, None, {"support": rng.randint(0, 50), "neg_covered": rng.randint(0, 9)}))
    return spark.createDataFrame(rows, "id long, a double, b double, c double"), RuleSet(tuple(rules), 3, 2), rows


def fires(rule, row):
    x = dict(zip(("id", "a", "b", "c"), row))
    for f, op, v in rule.literals:
        u = x[f]
        if u != u or not (u < v if op == "<" else u > v if op == ">" else abs(u - v) <= 1e-5 + 1e-5 * abs(v)):
            return False
    return True


def test_activation_forms_agree_with_brute_force(spark, random_case):
    df, rules, rows = random_case
    want = {(row[0], r.rule_id) for row in rows for r in rules if fires(r, row)}
    for form in ("columns", "batches"):
        assert {tuple(x) for x in A.activate(df, rules, ["id"], form=form).collect()} == want
    got = A.activate_relational(df, rules_frame(spark, rules), ["id"], ["a", "b", "c"])
    assert {tuple(x) for x in got.collect()} == want


def test_relational_form_salted(spark, random_case, monkeypatch):
    df, rules, rows = random_case
    monkeypatch.setattr(A, "fits_broadcast", lambda *a, **k: False)
    want = {(row[0], r.rule_id) for row in rows for r in rules if fires(r, row)}
    got = A.activate_relational(df, rules_frame(spark, rules), ["id"], ["a", "b", "c"], salts=5)
    assert {tuple(x) for x in got.collect()} == want


@pytest.mark.parametrize("form", ["columns", "batches"])
def test_dempster_closed_form_equals_fold(random_case, form):
    df, rules, rows = random_case
    got = {r["id"]: r for r in predict.score(df, rules, form=form).collect()}
    for row in rows:
        fired = [r for r in rules if fires(r, row)]
        want = fold([r.mass for r in fired], 3)
        assert got[row[0]]["n_fired"] == len(fired)
        np.testing.assert_allclose(got[row[0]]["mass"], want, atol=1e-10)
        assert abs(sum(got[row[0]]["proba"]) - 1) < 1e-9
        omega = np.mean([r.mass[-1] for r in fired]) if fired else 1.0
        assert abs(got[row[0]]["unc_rule"] - omega) < 1e-9


def test_dempster_ignores_order_yager_is_the_left_fold(random_case):
    df, rules, rows = random_case
    turned = RuleSet(tuple(reversed(rules.rules)), 3, 2)
    a = {r["id"]: r["mass"] for r in predict.score(df, rules).collect()}
    b = {r["id"]: r["mass"] for r in predict.score(df, turned).collect()}
    for i in a:
        np.testing.assert_allclose(a[i], b[i], atol=1e-10)
    got = {r["id"]: r["yager"] for r in fuse.fuse_yager(df, rules).collect()}
    for row in rows:
        np.testing.assert_allclose(got[row[0]], fold([r.mass for r in rules if fires(r, row)], 3, "yager"), atol=1e-10)


def test_grouped_form_equals_row_local(spark, random_case):
    df, rules, _ = random_case
    local = {r["id"]: r["mass"] for r in predict.score(df, rules).where("n_fired > 0").collect()}
    grouped = fuse.fuse_grouped(A.activate(df, rules, ["id"]), rules_frame(spark, rules), ["id"], 3).collect()
    assert len(grouped) == len(local)
    for r in grouped:
        np.testing.assert_allclose(r["mass"], local[r["id"]], atol=1e-10)


def test_many_rules_and_zero_omega_stay_finite(spark):
    rules = RuleSet(tuple(Rule(i, i % 2, (("x", ">", 0.0),), (0.999, 0.001, 0.0) if i % 2 else (0.001, 0.998, 0.001)) for i in range(400)), 2)
    row = predict.score(spark.createDataFrame([(1.0,)], "x double"), rules).first()
    assert all(0 <= v <= 1 for v in row["mass"]) and abs(sum(row["mass"]) - 1) < 1e-9


def test_five_rule_row(spark):
    masses = [(0, 0.4473, 0.5527), (0, 0.3068, 0.6932), (0.7718, 0, 0.2282), (0.2993, 0, 0.7007), (0.1974, 0, 0.8026)]
    rules = RuleSet(tuple(Rule(i, None, (("x", ">", 0.0),), m) for i, m in enumerate(masses)), 2)
    row = predict.score(spark.createDataFrame([(1.0,)], "x double"), rules).first()
    np.testing.assert_allclose(row["mass"], (0.7225, 0.1712, 0.1063), atol=2e-4)
    np.testing.assert_allclose(row["proba"], (0.7756, 0.2244), atol=2e-4)
    assert abs(row["unc_rule"] - 0.5954) < 2e-4


def test_pair_algebra(spark):
    df = spark.createDataFrame([([0.62, 0.18, 0.20], [0.25, 0.55, 0.20], [0.0, 0.0, 1.0])], "a array<double>, b array<double>, v array<double>")
    a, b, v = (M.unpack(F.col(c), 3) for c in "abv")
    row = df.select(F.array(*M.dempster_pair(a, b)).alias("ab"), F.array(*M.dempster_pair(b, a)).alias("ba"), F.array(*M.dempster_pair(a, v)).alias("av")).first()
    assert abs(sum(row["ab"]) - 1) < 1e-9 and min(row["ab"]) >= 0
    np.testing.assert_allclose(row["ab"], row["ba"], atol=1e-12)
    np.testing.assert_allclose(row["av"], [0.62, 0.18, 0.20], atol=1e-12)


def test_no_rule_fired(spark):
    rules = RuleSet((Rule(0, 1, (("x", ">", 10.0),), (0.1, 0.6, 0.3)),), 2, 1)
    df = spark.createDataFrame([(1.0,)], "x double")
    row = predict.score(df, rules).first()
    assert row["mass"] == [0.0, 0.0, 1.0] and row["proba"] == [0.5, 0.5] and row["pred"] == 0 and row["unc_rule"] == 1.0
    assert predict.predict_vote(df, rules).first()["pred"] == 1
    assert predict.predict_first_rule(df, rules).first()["pred"] == 1


def test_first_rule_one_hot(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0), (0.0, 1.0, 0), (1.0, 0.0, 1), (1.0, 1.0, 1)], "x0 double, x1 double, y int")
    rules = RuleSet((Rule(0, 1, (("x0", ">", 0.5),), (0.1, 0.6, 0.3)), Rule(1, 0, (("x0", "<", 0.5),), (0.6, 0.1, 0.3))), 2)
    got = predict.predict_first_rule(df, rules)
    assert got.where("pred <> y").count() == 0
    vec = got.select(F.array(*predict.first_hit_vec(F.col("pred"), 2)).alias("p")).collect()
    assert len(vec) == 4 and all(abs(sum(r["p"]) - 1) < 1e-12 for r in vec)


@pytest.mark.parametrize("name", ["banana", "dsgd", "cdsgd"])
def test_unknown_fusion_raises(spark, random_case, name):
    with pytest.raises(ValueError):
        predict.score(random_case[0], random_case[1], method=name)


def test_score_plan_is_row_local(random_case):
    df, rules, _ = random_case
    small = RuleSet(rules.rules[:8], 3, 2)
    plan = predict.score(df, small).where("pred = 1")._jdf.queryExecution().executedPlan().toString()
    for word in ("Exchange", "Python", "Cartesian", "NestedLoop"):
        assert word not in plan, word
    for word in ("Exchange", "Cartesian", "NestedLoop"):
        assert word not in predict.score(df, rules)._jdf.queryExecution().executedPlan().toString()


def test_filters_on_explanations_stay_small(random_case):
    df, rules, _ = random_case
    rows = X.explained(df, rules).where("pred = 1 AND size(contributions) > 1")
    assert len(rows._jdf.queryExecution().optimizedPlan().toString()) < 400_000


def test_laplace_first_hit(spark):
    df = spark.createDataFrame([(1, 0.8)], "c int, q double")
    p = df.select(F.array(*predict.first_hit_laplace_vec(F.col("c"), F.col("q"), 3)).alias("p")).first()["p"]
    np.testing.assert_allclose(p, [0.1, 0.8, 0.1])


def test_conformance_and_merge(spark, random_case):
    df, rules, _ = random_case
    row = X.conformance_checks(predict.score(df, rules), 3).first()
    assert row["n_rows"] == 300 and not any(row[c] for c in row.asDict() if c.startswith("bad_"))
    cells = [("f", ">", 1.0, 0.2, 0.6), ("f", ">", 2.0, 0.5, 0.3), ("f", "<", 5.0, 0.4, 0.1), ("g", "==", 1.0, 0.1, 0.5),
             ("g", "==", 2.0, 0.1, 0.5), ("h", "==", 3.0, 0.0, 1.0), ("h", ">", 3.5, 0.1, 0.2)]
    single = RuleSet(tuple(Rule(i, 0, ((f, op, v),)) for i, (f, op, v, _, _) in enumerate(cells)), 2)
    said = [(1, [(i, 0, omega, weight) for i, (_, _, _, omega, weight) in enumerate(cells)]), (2, [])]
    rows = spark.createDataFrame(said, "id long, contributions array<struct<rule_id:int,label:int,omega:double,weight:double>>")
    merged = X.merge_literals(rows, single, ["id"])
    assert "Exchange" not in merged._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in X.combine_literals(rows, single, ["id"])._jdf.queryExecution().executedPlan().toString()
    got = {r["feature"]: r for r in merged.collect()}
    assert (got["f"]["gt"], got["f"]["lt"], got["f"]["contradiction"]) == (2.0, 5.0, False)
    assert got["g"]["contradiction"] and got["h"]["contradiction"] and got["h"]["certainty"] == 1.0
    want = 1 - (1 - 0.6 * 0.8) * (1 - 0.3 * 0.5) * (1 - 0.1 * 0.6)
    assert abs(got["f"]["certainty"] - want) < 1e-12
    assert abs(sum(r["confidence"] for r in got.values()) - 1) < 1e-9


def test_streaming_scores_equal_batch_scores(spark, random_case, tmp_path):
    from rulespark.streaming.scoring import score_stream, write_scored

    df, rules, _ = random_case
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for method in ("dempster", "yager"):
        out = str(tmp_path / method)
        write_scored(score_stream(stream, rules, method=method), out, str(tmp_path / f"{method}-state")).awaitTermination()
        got = {r["id"]: (r["pred"], r["n_fired"]) for r in spark.read.parquet(out).collect()}
        assert got == {r["id"]: (r["pred"], r["n_fired"]) for r in predict.score(df, rules, method=method).collect()}
    with pytest.raises(ValueError):
        score_stream(df, rules)


@pytest.mark.parametrize("exact", [False, True])
def test_forms_agree_on_odd_values(spark, exact):
    """Longs past 2^53, booleans, NULL, NaN and infinities; large codes that the tolerant `==` cannot tell apart."""
    big = 2**53
    rows = [(0, big + 1, True, 1.0), (1, big, False, float("nan")), (2, None, None, None), (3, -5, True, float("inf")), (4, 0, False, float("-inf")),
            (5, 1_000_000, True, 0.0), (6, 1_000_001, False, -0.0), (7, 2**62 + 3, None, 1e-6)]
    df = spark.createDataFrame(rows, "id long, n long, b boolean, x double")
    literals = [("n", "==", float(big)), ("n", ">", 1e15), ("n", "<", 0.0), ("n", "==", 1_000_000.0), ("b", "==", 1.0), ("b", "<", 0.5), ("x", ">", 0.0), ("x", "<", 0.0),
                ("x", "==", 0.0)]
    rules = RuleSet(tuple(Rule(i, 0, (lit,)) for i, lit in enumerate(literals)) + (Rule(len(literals), 1, (("n", ">", 0.0), ("b", "==", 1.0))),), 2, exact_eq=exact)
    pairs = lambda fired: {(r["id"], r["rule_id"]) for r in fired.collect()}
    columns = pairs(A.activate(df, rules, ["id"], form="columns"))
    assert columns == pairs(A.activate(df, rules, ["id"], form="batches"))
    numbers = df.select("id", *[F.col(c).cast("double").alias(c) for c in "nbx"])
    assert columns == pairs(A.activate_relational(numbers, rules_frame(spark, rules), ["id"], ["n", "b", "x"], exact_eq=exact))
    assert ((6, 3) in columns) == (not exact) and (5, 3) in columns


def test_no_rules_fire_nothing(spark):
    none = RuleSet((), 2)
    for form in ("columns", "batches"):
        assert [r["fired"] for r in A.with_fired(spark.range(3), none, form=form).collect()] == [[]] * 3


def test_forest_rows_are_spread_in_a_fixed_order(spark, monkeypatch):
    monkeypatch.setattr(predict, "FOREST_ROWS", 50)
    rows = [(i, float(i * 37 % 101), float(i % 7) if i % 9 else None, int(i % 101 > 50)) for i in range(600)]
    make = lambda data, n: spark.createDataFrame(data, "id long, a double, b double, y int").repartition(n)
    found = [predict.spread(make(data, n), 600).rdd.glom().collect() for data, n in ((rows, 1), (rows[::-1], 5))]
    assert found[0] == found[1] and len(found[0]) == 12 and sorted(r["id"] for part in found[0] for r in part) == list(range(600))
    assert predict.spread(make(rows, 1), 99).rdd.getNumPartitions() == 1


def test_forest_does_not_depend_on_the_input_partitions(spark, monkeypatch):
    monkeypatch.setattr(predict, "FOREST_ROWS", 50)
    rows = [(i, float(i * 37 % 101), float(i % 7), int((i * 37 % 101 > 50) != (i % 11 == 0))) for i in range(300)]
    make = lambda data, n: spark.createDataFrame(data, "id long, a double, b double, y int").repartition(n)
    test = make(rows[:40], 1)
    answers = [sorted((r["id"], *r["rf_proba"], r["rf_pred"]) for r in predict.random_forest_baseline(make(data, n), test, ["a", "b"], 2, trees=5, depth=4).collect()) for data, n in ((rows, 1), (rows[::-1], 4))]
    assert answers[0] == answers[1] and len(answers[0]) == 40
