"""Operator 9: the parts against brute force, and held-out accuracy."""

import itertools
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import toxicity as tox
from tessera.llm.common import id_and_text, work_dir


def model(texts):
    return tox.log_model(tox.trigram_counts(texts).reshape(tox.SIZE, tox.SIZE, tox.SIZE).astype(float))


LM = model(["idiot loser stupid the small worthless clown pathetic disgusting trash scum moron " * 50, "this is a normal sentence with letters " * 30])


def test_counts():
    counts = tox.trigram_counts(["ab", None, "", "A1"]).reshape(tox.SIZE, tox.SIZE, tox.SIZE)
    a, b = 2, 3
    assert counts.sum() == 4 and counts[0, a, b] == counts[a, b, 0] == counts[0, a, 1] == counts[a, 1, 0] == 1
    long_ = "abc " * 600_000
    assert tox.trigram_counts([long_]).sum() == len(long_)


def slow_restore(word, lm):
    """The best of all readings of a lattice, by trying every one."""
    best = None
    for path in itertools.product(*tox._lattice(word)):
        said = re.sub(" +", " ", "".join(x for x, _ in path)).lstrip(" ")
        total = sum(c for _, c in path) - score(said, lm)
        if best is None or total < best[0] - 1e-9:
            best = (total, " ".join(said.split()))
    return best[1]


def score(text, lm):
    c = [0, 0] + [tox._of[x] for x in text] + ([] if text.endswith(" ") or not text else [0])
    return sum(float(lm[a, b, z]) for a, b, z in zip(c, c[1:], c[2:]))


def test_viterbi_is_exact():
    for word in ("l0ser", "1diot", "$cum", "m0r0n", "stuuupid", "tr@$h", "i.d.i.o.t", "cl*wn", "a i d i o t", "l o s e r  a", "th3_5mall"):
        assert tox.restore(word, LM) == slow_restore(word, LM), word


def test_restores():
    found = {w: " ".join(tox.plain_words(w, LM)) for w in ("l0ser", "1d1ot", "$tupid!", "stuuupid", "tra$h,", "(clown)", "2024", "smaller")}
    assert found == {"l0ser": "loser", "1d1ot": "idiot", "$tupid!": "stupid", "stuuupid": "stupid", "tra$h,": "trash", "(clown)": "clown", "2024": "2024", "smaller": "smaller"}
    for text, word in (("you i d i o t normal", "idiot"), ("(i d i o t), or", "idiot"), ("you i d i o t !", "idiot"), ("l-o-s-e-r", "loser"), ("is a i d i o t", "idiot"), ("a 1 d 1 0 t", "idiot"), ("s  t u p i d", "stupid")):
        assert "=" + word in {f for w in tox.words_of(text) for f in tox.signs(w, LM)}, text


def test_no_length_changes_the_result():
    """Long rows of letters, long words and long texts are read like short ones, at every place."""
    letters = " ".join("the small idiot is a loser and normal")
    for n in (1, 2, 3, 4, 5, 50):
        row = " ".join([letters] * n)
        words = tox.restore(row, LM).split()
        assert words.count("idiot") == words.count("loser") == n, n
    word = "-".join(["l0ser"] * 100)
    assert tox.plain_words(word, LM) == ["loser"] * 100
    assert "=loser" in {f for w in tox.words_of("x" * 100_000 + " " + word) for f in tox.signs(w, LM)}
    tox.restore("a1" * 100_000, LM)  # linear


def test_scores_by_brute_force(spark):
    """Features, weights by Newton's method to convergence, and the sigmoid, in plain Python."""
    rng = random.Random(8)
    plain = ["the", "small", "normal", "sentence", "letters", "this"]
    bad = ["idiot", "l0ser", "tr@sh", "i d i o t", "stuuupid", "s-c-u-m", "$cum", "moron"]
    rows = []
    for i in range(240):
        toxic = rng.random() < 0.4
        words = rng.choices(plain, k=rng.randrange(3, 12)) + (rng.choices(bad, k=2) if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(toxic if rng.random() < 0.95 else not toxic)))
    rows += [(500, None, None), (501, "what a l o s e r", None), (None, "you idiot", None)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows if y is not None], "doc_id long, toxic int")
    lm = model([t for _, t, _ in rows])

    def features(text):
        low, out = (text or "").lower(), set()
        readings = [w for m in re.finditer(r"(?<!\S)[a-z0-9](?:[ -][a-z0-9](?![a-z0-9@])){2,}", low) for w in tox.restore(m[0], lm).split()]
        for w in low.split():
            readings += slow_restore(w, lm).split() if re.search(r"[^a-z]|(.)\1\1", w) else [w]
        for w in readings:
            out |= ({"=" + w} if len(w) > 2 else set()) | {f"{n}{w[:n]}" for n in range(3, 9) if len(w) > n}
        return out

    found = [features(t) for _, t, _ in rows]
    train = [(f, y) for f, (_, _, y) in zip(found, rows) if y is not None]
    n, p = len(train), sum(y for _, y in train)
    names = []
    for f in sorted(set().union(*found)):
        a, b = sum(y for x, y in train if f in x), sum(1 - y for x, y in train if f in x)
        ratio = abs(math.log(((a + 0.5) / (p + 1)) / ((b + 0.5) / (n - p + 1))))
        if a + b >= tox.LEAST_SUPPORT and ratio >= tox.LEAST_RATIO and ratio * math.sqrt(a + b) >= tox.LEAST_WEIGHT:
            names.append(f)
    assert len(names) > 10
    x = np.array([[1.0] + [f in s for f in names] for s, _ in train])
    y, w, ridge = np.array([y for _, y in train], float), np.zeros(len(names) + 1), np.diag([0.0] + [3.0] * len(names))
    for _ in range(50):
        q = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (q * (1 - q))[:, None]) + ridge, x.T @ (q - y) + ridge @ w)
    want = {k: 1 / (1 + math.exp(-(w[0] + sum(v for f, v in zip(names, w[1:]) if f in s)))) for (k, _, _), s in zip(rows, found)}
    got = {r.doc_id: r.score for r in tox.scored(docs, labels).collect()}
    bad_ones = [(k, next(t for j, t, _ in rows if j == k), got[k], want[k]) for k in want if abs(got[k] - want[k]) >= 5e-3]
    assert not bad_ones, bad_ones[:5]
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 5e-3
    assert got[None] > 0.5 > got[500]


def test_sample_is_bounded(spark, monkeypatch):
    """Rows that share a labelled id, alike or not, give one text to learn from."""
    monkeypatch.setattr(tox, "FIT_ROWS", 2)
    df = spark.createDataFrame([(1, f"text {i % 3}") for i in range(3000)] + [(2, "idiot"), (3, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0)], "doc_id long, toxic int")
    folder = work_dir(spark)
    tox.fit(id_and_text(df, "doc_id", "text"), labels, folder)
    marked = spark.read.parquet(f"{folder}/marked")
    assert marked.count() == 2 == marked.select("id").distinct().count()


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = tox.scored(docs, labels, trains=lambda k: ~tox.held_out(k)).join(labels, "doc_id").where(tox.held_out(F.col("doc_id"))).select("doc_id", "score", "toxic").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in found)
    y, p = np.array([r.toxic for r in found]), np.array([r.score for r in found])
    hit = p >= tox.THRESHOLD
    precision, recall = (y & hit).sum() / hit.sum(), (y & hit).sum() / y.sum()
    assert precision > 0.95 and recall > 0.9, (precision, recall)


def test_awkward(spark, awkward, nothing):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (9, 0, 1), (None, 1, 1), (5, None, 1), (6, 1, 0), (7, 0, 0)], "doc_id long, toxic int, score int")
    got = tox.scored(awkward, labels).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted((r.doc_id for r in awkward.collect()), key=str) and all(0 <= r.score <= 1 for r in got)
    assert tox.scored(nothing, labels).count() == 0
    assert {r.score for r in tox.scored(awkward, labels.limit(0)).collect()} == {0.5}
    assert tox.drop_toxic(awkward, labels).columns == awkward.columns
    disguised = spark.createDataFrame([(i, "normal loser text " * 9) for i in range(9)] + [(99, "what a l0ser")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in tox.restored(disguised).collect()}[99] == "what a loser"


def test_features_are_held_for_few_rows():
    """A worker's memory doesn't follow the features of all rows of a batch."""
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=9)) for _ in range(150)) for _ in range(1000)]
    batch = pa.RecordBatch.from_pydict({"_id": [i // 2 for i in range(1000)], "_text": texts, "y": pa.array([1] * 1000, pa.int32())})
    tracemalloc.start()
    try:
        got = [(r.num_rows, r.column("id").to_pylist(), r.column("f").value_lengths().to_pylist()) for r in tox.marks(iter([batch]), LM)]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [k for _, keys, _ in got for k in keys] == list(range(500)) and min(n for _, _, c in got for n in c) > 500
    assert peak < 20e6  # all rows' features take over 30 MB
