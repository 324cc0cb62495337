"""Operator 7 against plain regular expressions, and its bootstrapping on a planted corpus."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import pii


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


BASE = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def slow_base(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    rules = (lambda m: True, lambda m: all(int(p) <= 255 for p in m[0].split(".")), lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m)), lambda m: 9 <= len(digits(m)) <= 15)
    return sorted((m.start(), k, m.end()) for k, (pattern, ok) in enumerate(zip(BASE, rules)) for m in re.finditer(pattern, text) if ok(m))


TRICKY = [
    "a@b.c@d.e x%y@b.c%x@d.e .@a.b", "a@b..c a@b.c. é😀 me@x-y.org", "1.2.3.4.5 1.2.3.4.5.6.7.8 256.1.1.1 0255.001.1.1 1.2.3.4", "4046195599780836 4046-1955 9978 0836 40461955997808361234567 4046  195599780836",
    "+1 (229) 555-4838 +12 ++49 30 1234567890 +1-2-3-4-5-6-7-8-9. +123456789012345678", "0.0.0.0", "00000000000000000000.1.1.1", "79927398713 0000000000000000", "x" * 5_000 + "@" + "y." * 3_000, "1" * 20_000, "+1" + " " * 20_000, "a.b" * 20_000, "1.1.1.1 " * 300,
]


@pytest.mark.parametrize("which", ["docs", "awkward", "nothing", "tricky"])
def test_base(request, spark, which):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TRICKY)], "doc_id long, text string, spans int") if which == "tricky" else request.getfixturevalue(which)
    rows = [(r.doc_id, r.text or "") for r in df.collect()]
    got = pii.digest(pii.find_personal_data(df)).collect()
    assert len(got) == len(rows)
    want = []
    for key, text in rows:
        spans = slow_base(text)
        said = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        want.append((key, *(sum(k == n for _, k, _ in spans) for n in range(4)), hashlib.sha256(said.encode()).hexdigest()))
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)


def test_bootstrapping(spark):
    rows = [(i, f"Hello there, please call me on +1 (229) 555-{1000 + i} soon") for i in range(30)]
    rows += [(100, "you may call me on 555-0199 today"), (101, "room number is 555-0199 today"), (102, "nothing here 2024 at all"), (103, None)]
    rows += [(200 + i, f"the order number is 77-{1000 + i}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.digest(pii.find_personal_data(df)).collect()}
    assert got[100] == "ctx_phone:19:27" and got[101] == got[102] == got[103] == ""
    assert all(not got[200 + i] for i in range(30)) and all(got[i].startswith("phone:") for i in range(30))
    text = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert text[100] == "you may call me on [PHONE] today" and text[101] == rows[31][1] and text[103] is None
    assert text[0] == "Hello there, please call me on [PHONE] soon"


def test_main_path_is_native(docs):
    plan = pii.find_personal_data(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_redact_keeps_rows_and_columns(awkward):
    out = pii.redact(awkward)
    assert out.columns == awkward.columns and out.count() == awkward.count()
    assert out.where(F.col("doc_id") == 9).head().text == awkward.where("doc_id = 9").head().text
    assert pii.redact(awkward.limit(0)).count() == 0


def slow_left(gap):
    words = re.findall(r"[^\s.,;:!?()\"']+", gap.lower())
    return " ".join(words[-2:])


def slow_search(rows):
    """All spans, base and discovered, of a list of texts by plain loops."""
    seen, tokens = set(), []
    for n, text in enumerate(rows):
        base = slow_base(text)
        for k in range(4):
            at = 0
            for s, _, e in [(m.start(), 0, m.end()) for m in re.finditer(BASE[k], text)]:
                if (s, k, e) in base:
                    seen.add((slow_left(text[at:s]), text[s:e], k))
                at = e
        at = 0
        for m in re.finditer(r"(?<![A-Za-z0-9._/@+-])[A-Za-z._/@+-]*[0-9][A-Za-z0-9._/@+-]*", text):
            left, value = slow_left(text[at : m.start()]), m[0].rstrip("._/@+-")
            at, s, e = m.end(), m.start(), m.start() + len(value)
            if len(value) >= 5 and len(re.sub("[^0-9]", "", value)) >= 3 and not any(a < e and s < b for a, _, b in base):
                seen.add((left, value, None))
                tokens.append((n, s, e, left))
    seen = {x for x in seen if x[0]}
    pairs = {(p, v) for p, v, _ in seen}
    score = {(v, k): 1.0 for _, v, k in seen if k is not None}
    for _ in range(pii.ROUNDS):
        kept = {}
        for p in {p for p, _ in pairs}:
            inside = [v for q, v in pairs if q == p]
            for k in range(4):
                support = sum(score.get((v, k), 0.0) for v in inside)
                if support >= pii.SUPPORT and support / (len(inside) + pii.DAMPING) >= pii.CONFIDENT:
                    kept[p, k] = support / (len(inside) + pii.DAMPING)
        for p, v in pairs:
            for k in range(4):
                if (p, k) in kept:
                    score[v, k] = max(score.get((v, k), 0.0), kept[p, k])
    best = {p: max((c, -k) for (q, k), c in kept.items() if q == p) for p, _ in kept}
    out = [slow_base(t) for t in rows]
    for n, s, e, left in tokens:
        if left in best:
            out[n].append((s, 4 - best[left][1], e))
    return [sorted(x) for x in out]


def test_all_spans_by_brute_force(spark):
    import random

    rng = random.Random(2)
    long_ = "w" * 120
    parts = ["call me on", "write to the", f"see {long_} {long_}", "room number", "(please, dial", "host:", "é"]
    values = [lambda: f"+1 (229) 555-{rng.randrange(1000, 9999)}", lambda: f"u{rng.randrange(99)}@x.org", lambda: f"10.0.{rng.randrange(255)}.7", lambda: f"555-{rng.randrange(1000, 9999)}-", lambda: f"ab/{rng.randrange(10**6)}.", lambda: "word"]
    likely = {"call me on": 0, "write to the": 1, f"see {long_} {long_}": 2}
    rows = []
    for _ in range(150):
        said = []
        for _ in range(rng.randrange(1, 7)):
            p = rng.choice(parts)
            k = likely[p] if p in likely and rng.random() < 0.93 else rng.randrange(6)
            said.append(f"{p} {values[k]()}")
        rows.append(", ".join(said))
    rows.append(" ".join(f"call me on +1 (229) 555-{i} and a{i % 7}@b.c or x-{i}" for i in range(1000, 4000)))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.spans] for r in pii.find_personal_data(df).collect()}
    want = slow_search(rows)
    assert any(k >= 4 for x in want for _, k, _ in x)
    assert [got[i] for i in range(len(rows))] == want
    text = {r.doc_id: r.text for r in pii.redact(df).collect()}
    for i, spans in enumerate(want):
        out, at = [], 0
        for s, k, e in spans:
            if s >= at:
                out += [rows[i][at:s], f"[{pii.KINDS[k % 4].upper()}]"]
            at = max(at, e)
        assert text[i] == "".join(out) + rows[i][at:]
