"""Rule files read in splits and hard-case exports."""

import glob

import pandas as pd
import pytest

from rulespark.sources import rule_files, runs


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_lines_are_numbered_across_splits(spark, tmp_path, ending):
    lines = {name: [f"class {i % 3} :: a < {i}.5 & b == {i % 7} || masses: [0.1, 0.2, 0.7]" if i % 11 else "" for i in range(n)] for name, n in (("x", 3000), ("y", 5), ("z", 0))}
    for name, rows in lines.items():
        (tmp_path / f"{name}.txt").write_text(ending.join(rows), newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert spark.read.text(f"{tmp_path}/*.txt").rdd.getNumPartitions() > 10
        got = {(r["file"].rsplit("/", 1)[-1][0], r["line_no"]): r["line"] for r in rule_files.numbered_lines(spark, f"{tmp_path}/*.txt").collect()}
        want = {(name, i): line for name, rows in lines.items() for i, line in enumerate(rows)}
        assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
        rules = rule_files.read_rules_text(spark, f"{tmp_path}/x.txt").orderBy("rule_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["rule_id"] for r in rules] == [i for i in range(3000) if i % 11]
    assert all(r["literals"][0]["value"] == r["rule_id"] + 0.5 and r["label"] == r["rule_id"] % 3 for r in rules)


def test_hard_cases_are_one_sorted_file_each(spark, tmp_path):
    rows = [(f"d{i % 3}", f"a{i % 2}", (i * 7919) % 5000, f"reason {i}") for i in range(5000)]
    base = spark.createDataFrame(rows, "dataset string, algo string, id long, reason string").repartition(6)
    runs.export_hard_cases(base, f"{tmp_path}/out", ["id"])
    for d in range(3):
        for a in range(2):
            files = glob.glob(f"{tmp_path}/out/dataset=d{d}/algo=a{a}/*.parquet")
            assert len(files) == 1
            ids = pd.read_parquet(files[0])["id"].tolist()
            assert ids == sorted(r[2] for r in rows if r[:2] == (f"d{d}", f"a{a}")) and ids
