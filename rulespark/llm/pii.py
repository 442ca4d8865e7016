"""Personal data by candidate gradient boosting; DataFrame and SQL functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from rulespark.llm.common import stored

KINDS = ("email", "ip", "card", "phone")

# Base formats. Loops are possessive and runs start where no character of the run stands before, or where the last match
# ended: same matches as the plain patterns, in linear time and without deep recursion on long runs.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# High-recall generators: looser forms of each kind. They overlap with the base and with each other.
LOOSE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?(?:@|[(\[{](?i:at)[)\]}])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[{](?i:dot)[)\]}])\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]{1,3}+(?:[.,:_-][0-9]{1,3}+){3}+",
    "card": r"[0-9](?:[\x20._/-]?[0-9]){12,}+",
    "phone": r"\+?\(?[0-9](?:[\x20().-]{0,2}+[0-9]){6,}+",
}
# A text without this has no match of either pattern.
NEEDED = {"email": r"@|[(\[{](?i:at)[)\]}]", "ip": r"[0-9][.,:_-][0-9]", "card": r"[0-9]", "phone": r"[0-9]"}

CONTEXT = 24  # characters looked at on either side
ROUNDS = 12
DEPTH = 2
RATE = 0.5
RIDGE = 1.0
LEAST_GAIN = 1e-3
HELD_OUT = 4  # every fourth text by hash calibrates and does not train
PRECISION = 0.97  # that added spans of a kind must reach among calibration candidates
LEAST_SCORE = 0.0  # log odds: what the trees think less likely than not is never added

_WORDS = {
    "email": "e-?mail|contact|write|reply|address", "ip": "ip|host|server|addr|client|login|from",
    "card": "card|visa|credit|debit|pay|account|cvv", "phone": "phone|tel|call|mobile|cell|fax|contact|whatsapp",
}


def luhn(digits: Column) -> Column:
    """True if a text of digits passes the Luhn check."""
    return F.call_function("luhn_check", digits)


def _passes(kind: str, x: Column) -> Column:
    digits = F.regexp_replace(x, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.transform(F.split(x, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.try_to_number(p, F.lit("999")) <= 255))
    if kind == "card":
        return F.length(digits).between(16, 19) & luhn(digits)
    return F.length(digits).between(8, 15)


# Leftmost non-overlapping matches with their places in code points: Java's split and extract walk the same matches, so
# the pieces between them give the positions.
_PLACE = """
aggregate(
  transform(f_{k}, (x, i) -> named_struct('x', x, 'skip', length(p_{k}[i]),
            'before', right(p_{k}[i], {c}), 'after', left(p_{k}[i + 1], {c}))),
  named_struct('at', 0, 'out', cast(array() as array<struct<s:int,e:int,x:string,before:string,after:string>>)),
  (acc, m) -> named_struct('at', acc.at + m.skip + length(m.x), 'out', array_append(acc.out,
            named_struct('s', acc.at + m.skip, 'e', acc.at + m.skip + length(m.x), 'x', m.x, 'before', m.before, 'after', m.after))),
  acc -> acc.out)"""
_NONE = "cast(array() as array<struct<s:int,e:int,x:string,before:string,after:string>>)"


def _placed(df: DataFrame, text: str, patterns: dict[str, str], out: str) -> DataFrame:
    """df with `out`_kind for each kind: its matches in order as struct(s, e, x, before, after)."""
    for kind, pattern in patterns.items():
        some = F.col(text).rlike(NEEDED[kind])
        df = df.withColumn(f"f_{kind}", F.when(some, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))))
        df = df.withColumn(f"p_{kind}", F.when(F.size(f"f_{kind}") > 0, F.split(F.col(text), pattern, -1)))
        place = F.expr(f"case when size(f_{kind}) > 0 then {_PLACE.format(k=kind, c=CONTEXT)} else {_NONE} end")
        df = df.withColumn(f"{out}_{kind}", place).drop(f"f_{kind}", f"p_{kind}")
    return df


def plausible(kind: str, x: Column) -> Column:
    """Whether a candidate, with its disguise undone, could be of its kind."""
    if kind == "email":
        plain = F.regexp_replace(F.regexp_replace(x, r"\x20", ""), r"(?i)[(\[{]dot[)\]}]", ".")
        return plain.rlike(r"\.[A-Za-z]{2,24}$")
    return _passes(kind, F.regexp_replace(x, "[,:_-]", ".") if kind == "ip" else x)


# How base spans are loosened for training: texts put for the parts that make the format, one choice per span by its hash.
_DISGUISES = {
    "email": [(r"@", " (at) ", r"\.", " (dot) "), (r"@", "(at)", r"\.", "(dot)"), (r"@", " [at] ", r"\.", " [dot] "), (r"@", " @ ", r"\.", " . ")],
    "ip": [(r"\.", "-"), (r"\.", ":"), (r"\.", ","), (r"\.", "_")],
    "card": [(r"[\x20-]", "."), (r"[\x20-]", "_"), (r"[\x20-]", "/"), (r"[\x20-]", "")],
    "phone": [(r"^\+|[()]", "", r"[\x20.-]+", "-"), (r"^\+|[()]", "", r"[\x20.-]+", " "), (r"^\+|[()]", "", r"[\x20.-]+", ""), (r"^\+[0-9]{1,3}(?=[\x20(.-])[\x20.-]*", "", "[()]", "")],
}


def loosened(kind: str, m: Column) -> Column:
    """A match like m whose text is disguised."""
    forms = _DISGUISES[kind]
    choice, x = F.crc32(m["x"].cast("binary")) % len(forms), m["x"]
    for i, form in enumerate(forms):
        y = m["x"]
        for pattern, text in zip(form[::2], form[1::2]):
            y = F.regexp_replace(y, pattern, text)
        x = F.when(choice == i, y).otherwise(x)
    return F.struct(x.alias("x"), m["before"].alias("before"), m["after"].alias("after"))


def _named_near(kind: str, m: Column) -> Column:
    return F.concat_ws(" ", m["before"], m["after"]).rlike(f"(?i)\\b(?:{_WORDS[kind]})\\b")


def _side(c: Column) -> Column:
    """Kind of the character next to a span: 0 none, 1 space, 2 letter, 3 digit, 4 other."""
    return F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike(r"\p{L}"), 2).when(c.rlike("[0-9]"), 3).otherwise(4)


def features(kind: str, m: Column) -> Column:
    """array of small numbers: what a candidate and its context look like, and whether its undisguised form is plausible."""
    x = F.regexp_replace(m["x"], r"^\+", "")
    digits = F.length(F.regexp_replace(x, "[^0-9]", ""))
    apart = F.regexp_extract_all(x, F.lit("[^0-9A-Za-z]+"), F.lit(0))
    near = F.concat_ws(" ", m["before"], m["after"])
    return F.array(
        F.least(digits, F.lit(24)),
        F.least(F.length(x) - digits, F.lit(15)),
        F.least(F.size(apart), F.lit(7)),
        F.least(F.size(F.array_distinct(apart)), F.lit(5)),
        F.when(x.rlike("[(\\[{]"), 1).otherwise(0),
        F.coalesce(F.try_to_number(F.regexp_extract(x, "[0-9]", 0), F.lit("9")).cast("int"), F.lit(10)),
        _side(F.right(m["before"], F.lit(1))),
        _side(F.left(m["after"], F.lit(1))),
        F.when(_named_near(kind, m), 1).otherwise(0),
        F.when(plausible(kind, m["x"]), 1).otherwise(0),
        F.least(F.ceil(F.length(F.regexp_replace(near, "[^0-9]", "")) / 4).cast("int"), F.lit(7)),
        F.least(F.ceil(F.length(F.regexp_replace(near, r"[\p{L}\p{N}\s]", "")) / 4).cast("int"), F.lit(7)),
    )


@dataclass(frozen=True)
class Leaf:
    value: float


@dataclass(frozen=True)
class Split:
    feature: int
    at: int  # goes left if the feature is at most this
    left: Leaf | Split
    right: Leaf | Split


def _value(tree: Leaf | Split, f: Column) -> Column:
    if isinstance(tree, Leaf):
        return F.lit(tree.value)
    return F.when(f[tree.feature] <= tree.at, _value(tree.left, f)).otherwise(_value(tree.right, f))


def score(trees: list, f: Column, bias: float) -> Column:
    return sum((_value(t, f) for t in trees), F.lit(bias))


def _best_split(hist: dict[int, dict[int, tuple[float, float]]]) -> tuple[float, int, int]:
    """(gain, feature, value) of the best split by sums of gradient and curvature per feature value."""
    best = (LEAST_GAIN, -1, -1)
    for feature, cells in sorted(hist.items()):
        g, h = (sum(v[i] for v in cells.values()) for i in (0, 1))
        whole, a, b = g * g / (h + RIDGE), 0.0, 0.0
        for value in sorted(cells)[:-1]:
            a, b = a + cells[value][0], b + cells[value][1]
            gain = a * a / (b + RIDGE) + (g - a) ** 2 / (h - b + RIDGE) - whole
            if gain > best[0] + 1e-9:
                best = (gain, feature, value)
    return best


def _grow(cells: DataFrame, kinds: list[str]) -> dict[str, Leaf | Split]:
    """One tree per kind from cells (kind, f, g, h), level by level: a level is one sum per (kind, node, feature, value)."""
    node = F.lit(0)
    splits: dict[tuple[str, int], tuple[int, int]] = {}
    for level in range(DEPTH):
        sums = cells.withColumn("node", node).select("kind", "node", "g", "h", F.posexplode("f").alias("feature", "value")).groupBy("kind", "node", "feature", "value").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        hist: dict = {}
        for r in sums:
            hist.setdefault((r.kind, r.node), {}).setdefault(r.feature, {})[r.value] = (r.g, r.h)
        step = F.lit(0)
        for (kind, n), h in sorted(hist.items()):
            gain, feature, at = _best_split(h)
            if feature >= 0:
                splits[kind, n] = (feature, at)
                step = F.when((F.col("kind") == kind) & (node == n), F.when(F.col("f")[feature] <= at, 1).otherwise(2)).otherwise(step)
        node = F.when(step > 0, node * 2 + step).otherwise(node)
    ends = {(r.kind, r.node): Leaf(-RATE * r.g / (r.h + RIDGE)) for r in cells.withColumn("node", node).groupBy("kind", "node").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()}

    def tree(kind: str, n: int) -> Leaf | Split:
        if (kind, n) in splits and n < 2**DEPTH - 1:
            feature, at = splits[kind, n]
            return Split(feature, at, tree(kind, 2 * n + 1), tree(kind, 2 * n + 2))
        return ends.get((kind, n), Leaf(0.0))

    return {kind: tree(kind, 0) for kind in kinds}


@dataclass(frozen=True)
class Model:
    trees: dict[str, list]
    bias: dict[str, float]
    threshold: dict[str, float]  # a kind without one adds nothing


def train(cells: DataFrame) -> Model:
    """Boosted trees and thresholds from cells (kind, f, held_out, n, hits): counts of candidates with equal features.

    Labels come from the base: a candidate that overlaps a base span is a hit, and so is a disguised copy of it. Others are
    no hits, unless their undisguised form is plausible and (but for mail addresses, whose form says enough) a word of their
    kind stands near: those may be what is looked for, so nothing is learned from them. Every candidate of the corpus that
    has a label is in a cell; there are as many cells as different feature rows, however large the corpus. A round is
    DEPTH + 1 sums over them. A kind's threshold is the least score, LEAST_SCORE at least, from which on labelled candidates of
    held-out texts are hits with PRECISION.
    """
    totals = {r.kind: (r.n, r.hits) for r in cells.where("not held_out").groupBy("kind").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).collect()}
    kinds = sorted(totals)
    bias = {k: math.log((hits + 1) / (n - hits + 1)) for k, (n, hits) in totals.items()}
    trees: dict[str, list] = {k: [] for k in kinds}
    by_kind = lambda f: sum((F.when(F.col("kind") == k, score(trees[k], f, bias[k])).otherwise(F.lit(0.0)) for k in kinds), F.lit(0.0))
    for _ in range(ROUNDS if kinds else 0):
        p = 1 / (1 + F.exp(-by_kind(F.col("f"))))
        graded = cells.where("not held_out").withColumn("p", p).select(
            "kind", "f", (F.col("p") * F.col("n") - F.col("hits")).alias("g"), (F.col("p") * (1 - F.col("p")) * F.col("n")).alias("h")
        )
        for kind, tree in _grow(stored(graded, "graded"), kinds).items():
            trees[kind].append(tree)
    scored = cells.where("held_out").where(F.col("kind").isin(kinds)).withColumn("score", F.round(by_kind(F.col("f")), 9))
    steps = scored.groupBy("kind", "score").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    above = Window.partitionBy("kind").orderBy(F.desc("score"))
    curve = steps.select("kind", "score", F.sum("n").over(above).alias("n"), F.sum("hits").over(above).alias("hits"))
    good = curve.where((F.col("hits") >= PRECISION * F.col("n")) & (F.col("hits") > 0)).groupBy("kind").agg(F.min("score").alias("t"))
    return Model(trees, bias, {r.kind: max(r.t, LEAST_SCORE) for r in good.collect()})


def spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, base and added: arrays of struct(kind, start, end), in code points, end exclusive.

    base holds the spans of the four formats that pass their tests, by kind as listed in KINDS, then start. added holds
    candidates that overlap no base span and that the boosted trees score above their kind's calibrated threshold;
    where two overlap, the higher score stays, then the earlier and longer. A null text is empty and has no span; an empty
    table gives an empty result; repeated rows each get a row. Texts are read once: matches with some characters on either
    side are written to the shared folder, and training, calibration and selection work on those. Selection is
    within the row, so nothing is joined back.
    """
    id_type = df.schema[id_col].dataType
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("held_out", F.pmod(F.xxhash64("text"), F.lit(HELD_OUT)) == 0)
    placed = _placed(_placed(rows, "text", BASE, "base"), "text", LOOSE, "loose")
    strict = lambda k: F.filter(F.col(f"base_{k}"), lambda m: _passes(k, m["x"]))
    brief = lambda k: F.transform(strict(k), lambda m: F.struct(F.lit(k).alias("kind"), m["s"].alias("s"), m["e"].alias("e")))
    base = F.concat(*map(brief, KINDS))
    found = placed.select("id", "held_out", base.alias("base"), *[f"loose_{k}" for k in KINDS])
    known = lambda k, m: F.exists(F.col("base"), lambda b: (b["kind"] == k) & (b["s"] < m["e"]) & (m["s"] < b["e"]))
    open_question = lambda k, m: plausible(k, m["x"]) & (F.lit(True) if k == "email" else _named_near(k, m))
    describe = lambda k: F.transform(
        F.col(f"loose_{k}"),
        lambda m: F.struct(
            F.lit(k).alias("kind"), m["s"].alias("s"), m["e"].alias("e"), features(k, m).alias("f"),
            F.when(known(k, m), 1).when(~open_question(k, m), 0).alias("hit"),
            F.when(known(k, m), features(k, loosened(k, m))).alias("copy"),
            F.exists(F.col("base"), lambda b: (b["s"] < m["e"]) & (m["s"] < b["e"])).alias("covered"),
        ),
    )
    found = stored(found.select("id", "held_out", "base", F.concat(*map(describe, KINDS)).alias("candidates")), "candidates")
    each = found.where(F.size("candidates") > 0).select("held_out", F.explode("candidates").alias("c")).where("c.hit IS NOT NULL")
    each = each.select("held_out", "c.kind", "c.hit", F.explode(F.array_compact(F.array("c.f", "c.copy"))).alias("f"))
    cells = each.groupBy("held_out", "kind", "f").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"))
    model = train(stored(cells, "cells"))
    # the margin over the kind's threshold makes scores of kinds comparable; below 0 a candidate is not chosen
    none = F.lit(-1.0)

    def margin(c: Column) -> Column:
        out = none
        for k, t in model.threshold.items():
            out = F.when(c["kind"] == k, score(model.trees[k], c["f"], model.bias[k]) - t).otherwise(out)
        return F.round(out, 9)

    free = F.filter(F.col("candidates"), lambda c: ~c["covered"])
    rated = F.filter(F.transform(free, lambda c: F.struct((-margin(c)).alias("m"), c["s"].alias("s"), (-c["e"]).alias("e"), c["kind"].alias("kind"))), lambda c: c["m"] <= 0)
    clash = lambda a, b: (a["s"] < -b["e"]) & (b["s"] < -a["e"])
    taken = F.aggregate(
        F.array_sort("rated"), F.filter("rated", lambda c: F.lit(False)),
        lambda acc, c: F.when(F.exists(acc, lambda x: clash(x, c)), acc).otherwise(F.array_append(acc, c)),
    )
    chosen = found.select("id", "base", rated.alias("rated"))
    added = F.when(F.size("rated") > 0, F.transform(taken, lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("s"), (-c["e"]).alias("e")))).otherwise(F.filter("base", lambda b: F.lit(False)))
    out = lambda a: F.transform(a, lambda b: F.struct(b["kind"].alias("kind"), b["s"].alias("start"), b["e"].alias("end")))
    return chosen.select(F.col("id").cast(id_type).alias(id_col), out(F.col("base")).alias("base"), out(added).alias("added"))


def joined(array: Column) -> Column:
    """kind:start:end by kind as listed, then start, comma-joined."""
    of_kind = lambda k: F.array_sort(F.filter(array, lambda b: b["kind"] == k), lambda a, b: a["start"] - b["start"])
    ordered = F.concat(*map(of_kind, KINDS))
    return F.concat_ws(",", F.transform(ordered, lambda b: F.concat_ws(":", b["kind"], b["start"], b["end"])))


def count_of(array: Column, kind: str) -> Column:
    return F.size(F.filter(array, lambda b: b["kind"] == kind)).cast("long")
