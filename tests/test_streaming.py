"""Fusion over event time: late rows, repeated deliveries, restarts, every kind of window, against the batch form and plain Python."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from rulespark.rules import Rule, RuleSet, default_caption
from rulespark.streaming.fusion import dropped_late, fuse_windows, write_windows

RULES = RuleSet(
    tuple(
        Rule(i, label, lits, mass, default_caption(lits))
        for i, (label, lits, mass) in enumerate(
            [
                (0, (("x", "<", 5.0),), (0.6, 0.1, 0.3)),
                (1, (("x", ">", 4.0),), (0.1, 0.5, 0.4)),
                (1, (("x", ">", 7.0), ("y", "==", 1.0)), (0.0, 0.7, 0.3)),
                (None, (("y", "==", 2.0),), (0.2, 0.2, 0.6)),
            ]
        )
    ),
    n_classes=2,
)
SCHEMA = "event_id long, ts timestamp, user string, x double, y double"
START = dt.datetime(2024, 1, 1)
KINDS = [dict(size="10 minutes"), dict(size="10 minutes", slide="4 minutes"), dict(size="3 minutes", session=True)]


def events(n, seed=0, minutes=120):
    rng = random.Random(seed)
    return [(i, START + dt.timedelta(seconds=rng.randrange(minutes * 60)), rng.choice("abc"), rng.uniform(0, 10), float(rng.randrange(3))) for i in range(n)]


def columns(df):
    return {
        (r["window_start"], r["window_end"], r["user"]): (r["n_events"], r["n_fired"], round(r["unc_rule"], 9), *[round(m, 9) for m in r["mass"]], r["pred"])
        for r in df.collect()
    }


class Folder:
    """A folder of files a stream reads one per batch."""

    def __init__(self, spark, path):
        self.spark, self.path, self.n = spark, path, 0

    def add(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.path}/in/{self.n:03d}")

    def stream(self):
        return self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/in/*")

    def run(self, **how):
        query = write_windows(fuse_windows(self.stream(), RULES, ["user"], time="ts", **how), f"{self.path}/out", f"{self.path}/state")
        query.awaitTermination()
        return query

    def out(self):
        return self.spark.read.parquet(f"{self.path}/out")


def closed(found, last, lateness):
    return {k: v for k, v in found.items() if k[1] <= last - lateness}


@pytest.mark.parametrize("how", KINDS, ids=["tumbling", "sliding", "session"])
def test_stream_equals_batch_for_closed_windows(spark, tmp_path, how):
    rows = sorted(events(400), key=lambda r: r[1])
    folder = Folder(spark, tmp_path)
    for i in range(0, 400, 100):
        folder.add(rows[i : i + 100])
    query = folder.run(lateness="0 seconds", **how)
    assert dropped_late(query) == 0
    want = columns(fuse_windows(spark.createDataFrame(rows, SCHEMA), RULES, ["user"], time="ts", **how))
    got = columns(folder.out())
    assert got == closed(want, rows[-1][1], dt.timedelta()) and len(got) > 10


def test_late_rows_within_the_watermark_count_and_later_ones_are_dropped(spark, tmp_path):
    at = lambda i, m, x=8.0: (i, START + dt.timedelta(minutes=m), "a", x, 1.0)
    folder = Folder(spark, tmp_path)
    folder.add([at(1, 1), at(2, 12)])
    folder.add([at(3, 3, 1.0), at(4, 40)])  # 3 is late, but the watermark is still at 12 - 15
    folder.add([at(6, 41)])
    folder.add([at(5, 4, 1.0)])  # 5 comes when the watermark, 40 - 15, has closed its window
    folder.add([at(7, 70)])
    query = folder.run(size="10 minutes", lateness="15 minutes")
    got = {k[0].minute + 60 * k[0].hour: v[0] for k, v in columns(folder.out()).items()}
    assert got == {0: 2, 10: 1, 40: 2}
    assert dropped_late(query) == 1


def test_restart_goes_on_from_its_sums(spark, tmp_path):
    rows = sorted(events(300, seed=4), key=lambda r: r[1])
    folder = Folder(spark, tmp_path)
    folder.add(rows[:150])
    folder.run(size="10 minutes", lateness="1 minute")
    before = columns(folder.out())
    folder.add(rows[150:])
    folder.run(size="10 minutes", lateness="1 minute")
    folder.run(size="10 minutes", lateness="1 minute")  # nothing new: nothing is written twice
    got = columns(folder.out())
    want = columns(fuse_windows(spark.createDataFrame(rows, SCHEMA), RULES, ["user"], time="ts", size="10 minutes"))
    assert got == closed(want, rows[-1][1], dt.timedelta(minutes=1))
    assert before.items() <= got.items() and len(before) < len(got) and folder.out().count() == len(got)


def test_repeated_deliveries_count_once(spark, tmp_path):
    rows = sorted(events(200, seed=9), key=lambda r: r[1])
    folder = Folder(spark, tmp_path)
    folder.add(rows[:100] + rows[:30])
    folder.add(rows[90:])
    folder.run(size="10 minutes", lateness="20 minutes", event_id=["event_id"])
    want = columns(fuse_windows(spark.createDataFrame(rows, SCHEMA), RULES, ["user"], time="ts", size="10 minutes"))
    got = columns(folder.out())
    assert got == closed(want, rows[-1][1], dt.timedelta(minutes=20))
    twice = spark.createDataFrame(rows + rows[:50], SCHEMA)
    assert columns(fuse_windows(twice, RULES, ["user"], time="ts", size="10 minutes", event_id=["event_id"])) == want


@pytest.mark.parametrize("method", ["dempster", "vote"])
def test_batch_equals_plain_python(spark, method):
    rows = [*events(150, seed=2), (900, None, "a", 1.0, 1.0), (901, START, None, None, None)]
    got = columns(fuse_windows(spark.createDataFrame(rows, SCHEMA), RULES, ["user"], time="ts", size="10 minutes", method=method))
    groups = {}
    for _, ts, user, x, y in rows:
        if ts is not None:
            groups.setdefault((ts.replace(minute=ts.minute // 10 * 10, second=0), user), []).append((x, y))
    holds = lambda lit, row: row[lit[0]] is not None and {"<": row[lit[0]] < lit[2], ">": row[lit[0]] > lit[2], "==": row[lit[0]] == lit[2]}[lit[1]]
    for (start, user), members in groups.items():
        fired = [r for x, y in members for r in RULES if all(holds(lit, {"x": x, "y": y}) for lit in r.literals)]
        omega = math.prod(r.mass[-1] for r in fired)
        if method == "dempster":
            mass = [math.prod(r.mass[c] + r.mass[-1] for r in fired) - omega for c in range(2)] + [omega]
        else:
            votes = [sum(r.label == c for r in fired) for c in range(2)]
            mass = [*votes, 0.0] if sum(votes) else [0.0, 0.0, 1.0]
        mass = [m / sum(mass) for m in mass]
        unc = sum(r.mass[-1] for r in fired) / len(fired) if fired else 1.0
        n_events, n_fired, unc_rule, *rest = got[start, start + dt.timedelta(minutes=10), user]
        assert (n_events, n_fired) == (len(members), len(fired)) and abs(unc_rule - unc) < 1e-8
        assert all(abs(a - b) < 1e-8 for a, b in zip(rest[:3], mass)) and rest[3] == int(mass[1] > mass[0])
    assert len(got) == len(groups)


def test_state_is_one_row_per_open_window_and_key(spark, tmp_path):
    rows = [(i, START + dt.timedelta(seconds=i % 60), "a", float(i % 10), 1.0) for i in range(5_000)]
    folder = Folder(spark, tmp_path)
    folder.add(rows)
    query = folder.run(size="10 minutes", lateness="1 hour")
    assert [op["numRowsTotal"] for op in query.lastProgress["stateOperators"]] == [1]


def test_unknown_choices_are_refused(spark):
    df = spark.createDataFrame(events(5), SCHEMA)
    with pytest.raises(ValueError):
        fuse_windows(df, RULES, ["user"], time="ts", size="1 minute", method="yager")
    with pytest.raises(ValueError):
        fuse_windows(df, RULES, ["user"], time="ts", size="1 minute", slide="30 seconds", session=True)
