"""Loader fixtures, encoding, splits and draws."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulespark.operators import order_stats as O, prepare as P
from rulespark.sources import rule_files, runs as run_files, tables
from rulespark.operators import experiments as E


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_unique_continuous_columns_survive(spark, tmp_path):
    path = write(tmp_path, "a.csv", "fixed acidity,Solidity,labels\n0.11,10.0,0\n0.22,20.0,1\n0.33,30.0,0\n0.44,40.0,1\n")
    df = P.drop_id_like(P.drop_incomplete(tables.read_table(spark, path)))
    assert df.columns == ["fixed acidity", "Solidity", "labels"] and P.pick_label(df) == "labels"
    coded, dim = P.factorize_label(df, "labels")
    assert coded.count() == 4 and {tuple(r) for r in dim.collect()} == {(0, 0), (1, 1)}


def test_excluded_column(spark, tmp_path):
    path = write(tmp_path, "df_wine.csv", "fixed acidity;quality;good;labels\n0.1;5;0;0\n0.2;6;0;1\n0.3;7;1;0\n0.4;8;1;1\n")
    df = P.drop_excluded(tables.read_table(spark, path), "df_wine")
    assert df.columns == ["fixed acidity", "quality", "labels"]


def test_missing_tokens_ids_and_codes(spark, tmp_path):
    path = write(tmp_path, "n.csv", "id,cat,num,cls\n1,b,1.5,x\n2,?,2.5,y\n3,a,NA,x\n4,a,4,y\n5,c,5,x\n")
    df = tables.read_table(spark, path)
    assert dict(df.dtypes) == {"id": "bigint", "cat": "string", "num": "double", "cls": "string"}
    clean = P.drop_id_like(P.drop_incomplete(df))
    assert clean.columns == ["cat", "num", "cls"] and clean.count() == 3
    coded, dim = P.encode_categoricals(clean, ["cat"])
    assert sorted(r["cat"] for r in coded.collect()) == [0.0, 1.0, 2.0]
    assert {(r["code"], r["value"]) for r in dim.collect()} == {(0, "a"), (1, "b"), (2, "c")}


def test_one_column_file_is_rejected(spark, tmp_path):
    with pytest.raises(ValueError):
        tables.read_table(spark, write(tmp_path, "x.csv", "a\n1\n2\n"))


def test_row_counters_are_ids(spark):
    df = spark.createDataFrame([(i, i + 1, 2 * i, i % 3) for i in range(9)], "n0 long, n1 long, even long, m long")
    assert P.id_like_columns(df) == ["n0", "n1"]
    assert [c for c in ("id_x", "row_id", "UID", "identity", "paid") if P.has_id_name(c)] == ["id_x", "row_id", "UID"]


def test_wide_dictionary_codes_equal_ranks(spark):
    values = spark.createDataFrame([("f", f"v{i * 7919 % 5000:05d}") for i in range(5000)], "feature string, value string")
    got = {r["value"]: r["code"] for r in P._bucketed_codes(values, 5000).collect()}
    assert got == {v: i for i, v in enumerate(sorted(got))}


def test_exact_draws(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7 == 0).cast("int").alias("y"))
    split = P.stratified_split(df, ["id"], test_size=0.16)
    sizes = {(r["y"], r["part"]): r["count"] for r in split.groupBy("y", "part").count().collect()}
    assert sizes[(0, "test")] + sizes[(1, "test")] == 160 and abs(sizes[(1, "test")] - 0.16 * 143) < 1
    again = P.stratified_split(df.repartition(3), ["id"], test_size=0.16)
    assert {r["id"] for r in split.where("part = 'test'").collect()} == {r["id"] for r in again.where("part = 'test'").collect()}
    up = P.upsample_minority(df, ["id"], target=0.4)
    assert up.where("y = 1").count() == round(0.4 * 1000 / 0.6) and up.where("y = 0").count() == 857
    cuts = O.hash_cuts(df, "y", ["id"], {0: 300, 1: 0}, 5, rank_at_most=3)
    assert O.with_drawn(df, "y", ["id"], 5, cuts, "drawn").where("drawn").count() == 300
    numbered = O.number_rows(df, ["id"], 3, buckets=16)
    assert sorted(r["idx"] for r in numbered.collect()) == list(range(1000))
    assert P.train_val_split(df, ["id"], val_split=1.0).where("is_val").count() == 999


def test_draws_from_thousands_of_classes(spark):
    """Names that need quoting, a null class, and more classes than a nested expression could hold."""
    name = F.when(F.col("id") % 2500 == 7, None).otherwise(F.concat(F.lit("a'b\\"), (F.col("id") % 2500).cast("string")))
    df = spark.range(10_000).select("id", name.alias("y"))
    sizes = P.stratified_split(df, ["id"], test_size=0.25).groupBy("y", "part").count().where("part = 'test'").collect()
    assert len(sizes) == 2500 and {r["count"] for r in sizes} == {1}


def test_confidence_rejects_bad_distances(spark):
    df = spark.createDataFrame([(0, 0.1), (1, float("nan"))], "cluster_id int, distance_norm double")
    with pytest.raises(ValueError):
        P.filter_by_rule_confidence(df, F.lit(True))


def test_rule_line(spark, tmp_path):
    line = "class 0 :: free sulfur dioxide < 49 & total sulfur dioxide < 107 || masses: [0.4299, 0.0, 0.5701]\n"
    path = write(tmp_path, "r.dsb", line + "class None :: grade == high & x > 1.5e-3 → class 1\n# note\n")
    dim = spark.createDataFrame([("grade", 2, "high")], "feature string, code int, value string")
    a, b = rule_files.read_rules_text(spark, path, dim).orderBy("rule_id").collect()
    assert a["label"] == 0 and a["mass"] == [0.4299, 0.0, 0.5701]
    assert [tuple(x) for x in a["literals"]] == [("free sulfur dioxide", "<", 49.0), ("total sulfur dioxide", "<", 107.0)]
    assert b["label"] is None and b["mass"] is None and [tuple(x) for x in b["literals"]] == [("grade", "==", 2.0), ("x", ">", 0.0015)]


def test_rule_counts_survive_odd_files(spark, tmp_path):
    (tmp_path / "static_a_raw.dsb").write_bytes(b"\xef\xbb\xbfclass 0 :: x > 1\r\n  CLASS 1 :: x < 1\rclassy\n")
    (tmp_path / "a__FOIL__split1__seed2.dsb").write_bytes(b"c\x00l\x00a\x00s\x00s\x00 \x000\x00 :: y\n")
    (tmp_path / "ripper_a_dst.dsb").write_bytes(b"")
    counts = rule_files.count_rules_by_file(spark, str(tmp_path))
    assert {tuple(r) for r in counts.collect()} == {("static_a_raw.dsb", 2), ("a__FOIL__split1__seed2.dsb", 1), ("ripper_a_dst.dsb", 0)}
    by = {(r["dataset"], r["kind"]): (r["STATIC"], r["RIPPER"], r["FOIL"]) for r in rule_files.count_rules_by_dataset(counts).collect()}
    assert by == {("a", "raw"): (2, 0, 0), ("a", "dst"): (0, 0, 1)}


def test_version_gate_and_prior(spark, tmp_path):
    from rulespark.rules import Rule, rules_frame

    rules = rules_frame(spark, [Rule(0, 1, (("x", ">", 1.0),), (0.2, 0.3, 0.5))])
    rule_files.write_rules(rules, str(tmp_path / "old"), 2, version=0)
    with pytest.raises(ValueError):
        rule_files.load_rules(spark, str(tmp_path / "old"))
    rule_files.write_rules(rules, str(tmp_path / "ok"), 2, prior=[3.0, 1.0], features=["x"])
    got = rule_files.load_rules(spark, str(tmp_path / "ok"))
    assert got.prior == [0.75, 0.25] and got.features == ["x"] and got.rules.count() == 1
    rule_files.write_rules(rules, str(tmp_path / "short"), 2, prior=[1.0])
    assert rule_files.load_rules(spark, str(tmp_path / "short")).prior is None


# --- run tables ---

RUN = "dataset string, inducer string, seed int, split_seed int, system string, pool_shaping boolean, acc double, macro_f1 double, nll double, ece double, unc_comb double, train_wall_sec double, n_rules double, avg_literals double"


def runs(spark, rows):
    return E.with_method(spark.createDataFrame(rows, RUN))


def test_multi_seed_aggregation(spark):
    nan = float("nan")
    df = runs(spark, [
        ("adult", "FOIL", 1, 42, "dsgd_dempster", True, 0.80, 0.70, 0.3, 0.1, 0.2, 1.2, 10.0, 2.5),
        ("adult", "FOIL", 2, 42, "dsgd_dempster", True, 0.90, 0.80, 0.2, 0.1, 0.3, 1.2, 10.0, 2.5),
        ("adult", "RF", 1, 42, "rf", None, 0.95, 0.85, 0.1, 0.1, nan, 0.5, nan, nan),
    ])
    got = {r["method"]: r for r in E.aggregate_runs(df).collect()}
    foil = got["FOIL:dsgd_dempster"]
    assert (foil["n_runs"], foil["n_seeds"]) == (2, 2) and foil["acc"] == pytest.approx(0.85) and foil["macro_f1"] == pytest.approx(0.75)
    assert foil["std_acc"] == pytest.approx(np.std([0.8, 0.9], ddof=1)) and (foil["min_acc"], foil["max_acc"]) == (0.80, 0.90)
    assert got["RF"]["unc_comb"] is None
    cover = {r["method"]: r for r in E.ablation_coverage(df).collect()}
    assert cover["FOIL:dsgd_dempster"]["paired_combos"] == 0 and E.ablation(df).count() == 0
    cost = {r["method"]: r for r in E.cost_summary(df).collect()}
    assert cost["FOIL:dsgd_dempster"]["train_wall_sec_mean"] == pytest.approx(1.2)


def test_old_column_names(spark):
    df = spark.createDataFrame([("adult", "FOIL", "Dempster", "0.8", "0.7"), ("adult", "RF", "rf", "0.9", "nan")], "Dataset string, Algo string, Method string, Acc string, F1 string")
    got = {r["method"]: r for r in E.with_method(df).collect()}
    assert set(got) == {"FOIL:dsgd_dempster", "RF"} and got["FOIL:dsgd_dempster"]["macro_f1"] == 0.7 and got["RF"]["macro_f1"] is None


def test_wilcoxon_tail_by_enumeration():
    import itertools

    for n, w in ((5, 15), (6, 3), (8, 30.0)):
        sums = [sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in itertools.product([0, 1], repeat=n)]
        assert E._tail(n, w, 0.0, True) == pytest.approx(sum(s >= w for s in sums) / 2**n)
    assert E._tail(100, 2525.0, 0.0, False) == pytest.approx(0.5)


def test_significance(spark):
    rows = []
    for seed, (a, b) in enumerate([(0.9, 0.8), (0.85, 0.8), (0.7, 0.72), (0.9, 0.6), (0.95, 0.7), (0.8, 0.79)]):
        rows += [("d", "FOIL", seed, 1, "dsgd_dempster", None, a, a, 1 - a, 0.1, 0.1, 1.0, 1.0, 1.0), ("d", "FOIL", seed, 1, "weighted_vote", None, b, b, 1 - b, 0.1, 0.1, 1.0, 1.0, 1.0)]
    got = {r["metric"]: r for r in E.significance(E.paired_deltas(runs(spark, rows))).collect()}
    assert (got["acc"]["n"], got["acc"]["wins"], got["acc"]["losses"]) == (6, 5, 1) and got["acc"]["w_plus"] == 19.0
    assert got["acc"]["p_value"] == pytest.approx(3 / 64) and got["nll"]["p_value"] == pytest.approx(3 / 64)
    assert got["nll"]["losses"] == 5 and got["ece"]["p_value"] is None and got["ece"]["test"] == "none"


def test_collected_runs_have_all_columns(spark, tmp_path):
    a = write(tmp_path, "bench__a.csv", "dataset,inducer,seed,system,acc,unc_comb\na,foil,1,dempster,0.5,0.1\na,foil,1,dempster,0.6,0.1\n")
    b = write(tmp_path, "bench__b.csv", "dataset,inducer,seed,system,acc,ece\nb,RF,1,rf,0.7,nan\n")
    got = run_files.collect_runs(spark, [a, b])
    assert got.count() == 2 and {"unc_comb", "ece", "split_seed", "method"} <= set(got.columns)


def test_wide_dictionaries_are_joined_in_salted_parts(spark, monkeypatch):
    """Past the broadcast bound a hot value and the NULLs are spread; codes and decoded strings are the same."""
    rows = [(i, "hot" if i % 3 else None if i % 2 else f"v{i}") for i in range(600)]
    df = spark.createDataFrame(rows, "id long, c string")
    dim = P.value_dictionary(df, ["c"])
    want = {r["id"]: r["c"] for r in P.encode_with_dictionary(df, dim, ["c"]).collect()}
    monkeypatch.setattr(P, "fits_broadcast", lambda entries: False)
    coded = P.encode_with_dictionary(df, dim, ["c"])
    assert {r["id"]: r["c"] for r in coded.collect()} == want
    back = {r["id"]: r["c"] for r in P.decode_features(coded, dim, ["c"]).collect()}
    assert all(back[i] == (c if c is not None else "-1.0") for i, c in rows)


def test_broadcasts_are_measured_in_bytes(spark):
    from rulespark.session import fits_broadcast

    df = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("t"), F.array(F.lit("ab"), F.lit(None)).alias("a"))
    assert fits_broadcast(df) and not fits_broadcast(df, max_bytes=50_000) and not fits_broadcast(df, 99)
