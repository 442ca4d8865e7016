import hashlib
import re

from pyspark.sql import functions as F

from rulespark.llm import pii, queries


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else None,
                "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


TRICKY = [
    "a@b.c_d@e.f, x@y.z.@q.r.s --@--.--", "1.2.3.4.5.6.7.8 007.1.2.3 256.1.1.1 1.2.3 1.2.3.4567 00000000001.2.3.4", "\U0001f600 é +1 (578) 555-6437\n+44 20 7946 0958.",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111-", "+1+2+33333333 +(1) +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "1 " * 40_000, "1" * 40_000, "a" * 60_000 + "@", "a.@-" * 5_000, "+1 " * 9_000,
    "1.2.3." * 4_000, "john (at) example (dot) com or 555-123-4567",
]


def test_base_spans_against_plain_patterns(spark, docs, odd):
    tricky = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    for df in (docs, odd, tricky):
        got = sorted([(r.doc_id, [tuple(b) for b in r.base]) for r in pii.spans(df).collect()], key=str)
        assert got == sorted([(r.doc_id, brute(r.text)) for r in df.select("doc_id", "text").collect()], key=str)


def test_query_digests(spark, docs, sf_dir):
    got = {r.doc_id: r for r in queries.op10(spark, sf_dir).collect()}
    for r in docs.collect():
        want = [f"{k}:{a}:{b}" for k, a, b in brute(r.text)]
        row = got[r.doc_id]
        assert row.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(w.startswith(k + ":") for w in want) for k in pii.KINDS]
        assert set(want) <= set(row.spans.split(",")) or not want


def test_trees_add_loose_spans_and_leave_clean_text_alone(spark):
    near = [f"call the office phone {200 + i} 555-{1000 + i} today" for i in range(100)]
    sure = [f"call the office phone +1 ({200 + i % 700}) 555-{1000 + i} today" for i in range(400)]
    other = [f"serial number {10**9 + 7919 * i} of the batch" for i in range(400)]
    rows = list(enumerate(sure + other + near))
    found = pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    added = {r.doc_id: [(a.kind, a.start, a.end) for a in r.added] for r in found}
    assert not any(added[i] for i in range(800))
    assert all(len(r.base) == (r.doc_id < 400) for r in found)
    texts = dict(rows)
    hit = sum([texts[i][a:b] for _, a, b in added[i]] == [texts[i][22:34]] for i in range(800, 900))
    assert hit >= 90


def test_disguised_addresses_are_added(spark):
    real = [f"please write to anna{i}@mail{i % 9}.example.org soon" for i in range(300)]
    loose = [f"please ask john{i} (at) example{i} (dot) com about it" for i in range(300)]
    clean = [f"the meeting (at) noon in room {i} was long, see point 3.{i} of the list" for i in range(300)]
    rows = list(enumerate(real + loose + clean))
    found = {r.doc_id: r for r in pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    assert all(len(found[i].base) == 1 and not found[i].added for i in range(300))
    assert sum([texts[i][a.start : a.end] for a in found[i].added] == [f"john{i - 300} (at) example{i - 300} (dot) com"] for i in range(300, 600)) >= 270
    assert not any(found[i].added or found[i].base for i in range(600, 900))


def test_few_base_spans_are_enough(spark):
    rows = [(i, f"mail anna{i}@mail.example.org") for i in range(12)] + [(100 + i, f"mail bob{i} [at] mail [dot] org now") for i in range(12)]
    found = pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(len(r.added) for r in found if r.doc_id >= 100) >= 11


def test_added_spans_overlap_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for r in pii.spans(docs).where(F.size("added") > 0).collect():
        for a in r.added:
            assert all(a.end <= b.start or b.end <= a.start for b in [*r.base, *[x for x in r.added if x != a]])


def test_no_rows_and_no_python(spark, empty, docs):
    got = pii.spans(empty)
    assert got.count() == 0
    plan = pii.spans(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
