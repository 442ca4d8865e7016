import hashlib
import random
import re
import zlib

import pytest

from rulespark.llm import conversations as c

PATTERN = re.compile(r"(s?(ua)+)?\Z")


def brute_edits(rows):
    """(cost, audit, repaired) of the cheapest edits, by trying all. rows: (role, text, fault)."""
    best = None

    def walk(i, cost, audit, out, free):
        nonlocal best
        roles = "".join(r[:1] or "?" for r, _ in out)
        if best is not None and cost > best[0] or not re.match(r"s?(ua)*u?\Z", roles):
            return
        if i == len(rows) and PATTERN.match(roles):
            best = min(best or (cost, audit, out), (cost, audit, out))
        if free:
            for role in ("user", "assistant"):
                walk(i, cost + 2, audit + "I", out + [(role, "")], free - 1)
        if i == len(rows):
            return
        role, text, fault = rows[i]
        cut = fault == c.CUT
        walk(i + 1, cost + 3, audit + "D", out, 3)
        if fault not in (c.BLANK, c.REPEATED):
            walk(i + 1, cost + cut, audit + "K", out + [(role, text)], 3)
            for new in ("user", "assistant"):
                walk(i + 1, cost + 2 + cut, audit + "R", out + [(new, text)], 3)

    walk(0, 0, "", [], 3)
    return best


def brute(rows):
    """The contract's row for one conversation. rows: (turn, role, text), nulls replaced, in order."""
    seen, faulty, count = set(), [], {c.BLANK: 0, c.REPEATED: 0, c.CUT: 0, None: 0}
    for _, role, text in rows:
        marks = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = c.BLANK if not marks else c.REPEATED if (role, text) in seen else c.CUT if marks[-1] not in ".!?" else None
        seen.add((role, text))
        count[fault] += 1
        faulty.append((role, text, fault))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    first = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
    cost, audit, out = brute_edits(faulty)
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return gaps, count[c.BLANK], count[c.REPEATED], count[c.CUT], illegal, cost, audit, sha


def damaged(rows):
    """The contract's damage in plain Python. rows: (conv_id, turn, role, text)."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def random_rows(seed, n):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "tool", None, "User", ""]
    texts = ["One.", "Two!", "open", "  ", "", None, "x\n.\t", "é?", "same."]
    return [(conv, rng.choice([None, *range(4)]), rng.choices(roles, [2, 6, 6, 1, 1, 1, 1])[0], rng.choice(texts)) for conv in [None, *range(n)] for _ in range(rng.randint(1, 4))]


def check(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, audit string").repartition(3)
    got = {r["conv_id"]: tuple(r[k] for k in COLUMNS) for r in c.audited(df).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        want = [r[1:] for r in damaged([r for r in rows if r[0] == conv])]
        assert got[conv] == (brute(want) if want else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())), (conv, want)


@pytest.mark.parametrize("seed", range(3))
def test_equals_all_edits(spark, seed):
    check(spark, random_rows(seed, 150))


def test_search_equals_all_edits():
    rng = random.Random(5)
    for _ in range(1500):
        rows = [(rng.choice(["system", "user", "assistant", "tool"]), f"t{i}", rng.choice([None, None, None, c.CUT, c.BLANK, c.REPEATED])) for i in range(rng.randint(0, 5))]
        search, out = c.Repair(), []
        for row in rows:
            out += search.add(*row)
        out += search.end()
        cost, audit, repaired = brute_edits(rows)
        assert (search.cost, "".join(e[0] for e in out)) == (cost, audit), rows
        assert [e[1:3] for e in out if e[1] is not None] == repaired


def test_given_tables(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r[k] for k in COLUMNS) for r in c.audited(df).collect()}
    for conv in {r[0] for r in rows}:
        want = [r[1:] for r in damaged([r for r in rows if r[0] == conv])]
        if len(want) <= 6:
            assert got[conv] == brute(want)


def test_memory_is_bounded_while_survivors_meet():
    search, sent = c.Repair(), 0
    for i in range(20_000):
        sent += sum(1 for _ in search.add(("user", "assistant")[i % 2], f"t{i}", None))
    assert search.most_waiting < 50 and sent > 19_900
    rng, search = random.Random(1), c.Repair()
    for i in range(20_000):
        for _ in search.add(rng.choice(["user", "assistant", "system"]), f"t{i}", rng.choice([None, c.CUT, c.BLANK])):
            pass
    assert search.most_waiting < 2_000


def test_repair_gives_rows_in_order(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "assistant", "open"), (2, 0, "user", " "), (1, 2, "assistant", "Hi.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(map(tuple, c.repair(df).collect()))
    assert got == [
        (1, 0, "R", "user", "Hi.", None), (1, 1, "K", "assistant", "open", "truncated"), (1, 2, "D", None, None, "duplicate"),
        (2, 0, "D", None, None, "blank"),
    ]


def test_one_long_conversation(spark):
    from pyspark.sql import functions as F

    role = F.when(F.col("id") % 2 == 0, "user").otherwise("assistant")
    df = spark.range(60_000).select(F.when(F.col("id") < 40_000, 0).otherwise(F.col("id")).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.concat(F.lit("t"), F.col("id"), F.lit(".")).alias("text"))
    row = c.summarise(df).where("conv_id = 0").first()
    assert row["cost"] == 0 and row["audit"] == "K" * 40_000 and row["gaps"] == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id string, turn long, role string, text string")
    assert c.audited(df).count() == 0 and c.repair(df).count() == 0
