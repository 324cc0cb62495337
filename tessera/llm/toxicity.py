"""Operator 9: toxicity behind a noisy channel.

A character trigram model is counted over all documents.  Words that look written to evade (look-alike
symbols between letters, letters repeated three times or more, letters set apart by spaces or marks)
span a lattice: what each character may stand for, and whether a space or mark between letters is noise
or the end of a word.  One Viterbi search under the language model, of a cost linear in the length,
restores the likeliest spelling and decides the words.  A logistic model over the presence of restored
words and their beginnings then scores the text.  It is fitted on at most ``FIT_ROWS`` labelled ids
(those with the smallest hash), one text each: a documented bound.  Its features are all those that
``LEAST_SUPPORT`` of these texts hold and that tell the classes apart by ``LEAST_WEIGHT`` and ``LEAST_RATIO``
(log-likelihood ratio, weighted by support and plain); language-model counts and scores cover every document.

Cases: a null or empty text has the score of a text without any known sign; a null id stays null; very
long texts, words and rows of letters are restored and scored whole; rows of one id with different texts
and repeated rows are each scored, and the text of the smallest hash is the one learnt from; labels that
repeat an id count once (the larger); null labels are ignored; without labels of both kinds the score
is the share of toxic ones (0.5 without any); equally likely spellings: the first in the order of
``LOOKS_LIKE``; an empty table gives no row; other columns are pruned.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, id_and_text, work_dir, worker_cache, written

FIT_ROWS = 20_000
LEAST_SUPPORT, LEAST_WEIGHT, LEAST_RATIO = 4, 7.0, 1.0
THRESHOLD = 0.3
CACHE_WORDS, CACHE_LENGTH = 300_000, 64
#: Rows whose features a worker holds at once.
MARK_ROWS = 100

#: Alphabet of the language model: 0 a boundary, 1 any other character, then the letters.
LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßéèêëàâçîïôûùñáíóúœæ"
SIZE = len(LETTERS) + 2
#: What a symbol may stand for besides itself.
LOOKS_LIKE = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "€": "e", "(": "c", "*": "aeiou"}
_APART = ".-_*~"
_STRIP = ".,;:?\"'()[]{}<>…«»„“”‚‘’-–—_~"
_TRIPLE = re.compile(r"(.)\1\1")
#: A single character that nothing but blanks or marks follow.
_ONE = r"(?:[^\W_]|[@$!|+€(])(?=[\s._*~,;:!?)\]\"'-]|$)"
#: Single characters set apart, three at least; what lies between them is blanks of a line or one mark.
_SPACED = re.compile(rf"(?<![^\s(\[\"']){_ONE}(?:(?:[ \t]++|[._*~-]){_ONE}){{2,}}+")
#: Costs of the channel: a letter kept, a look-alike, a letter doubled, noise and the end of a word at a mark or a space.
LOOK, LOOK_VOWEL, ONE_OF_MANY, TWO_OF_MANY, NOISE, BREAK, STRANGE = 1.2, 1.5, 0.2, 0.6, 0.5, 0.5, 4.0

_class = np.ones(0x10000, np.uint8)
for _c in range(0x10000):
    if chr(_c).isspace():
        _class[_c] = 0
for _i, _c in enumerate(LETTERS):
    _class[ord(_c)] = _i + 2
_of = {c: i + 2 for i, c in enumerate(LETTERS)} | {" ": 0}


def trigram_counts(texts) -> np.ndarray:
    """Counts of character trigrams, boundaries before and after each text."""
    worker_cache("toxicity")
    counts = np.zeros(SIZE**3, np.int64)
    for text in texts:
        if not text:
            continue
        points = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "replace"), "<u4")
        for at in range(0, len(points), 1 << 20):
            c = _class[np.minimum(points[at : at + (1 << 20) + 2], 0xFFFF)].astype(np.int32)
            if len(c) > 2:
                counts += np.bincount((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE**3)
    return counts


def language_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities (SIZE, SIZE, SIZE) of a character after two others, from all documents of (_id, _text)."""

    def count(batches):
        total = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            total += trigram_counts(batch.column(0).to_pylist())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    counts = np.zeros(SIZE**3)
    summed = docs.select("_text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    for batch in summed.toArrow().to_batches():  # one row to a trigram of the alphabet, SIZE ** 3 at most
        counts[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return log_model(counts.reshape(SIZE, SIZE, SIZE))


def log_model(tri: np.ndarray) -> np.ndarray:
    """Trigrams backed off to bigrams and those to single characters."""
    bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
    p1 = (uni + 1) / (uni.sum() + SIZE)
    p2 = (bi + 5 * p1) / (bi.sum(axis=1, keepdims=True) + 5)
    p3 = (tri + 5 * p2[None]) / (tri.sum(axis=2, keepdims=True) + 5)
    return np.log(p3).astype(np.float32)


def _lattice(word: str) -> list[list[tuple[str, float]]]:
    """For each place the choices (what to write, cost); a space ends a word."""
    places, at = [], 0
    while at < len(word):
        c, end = word[at], at
        while end < len(word) and word[end] == c:
            end += 1
        run = end - at
        own = [(c, 0.0)] if c in _of and c != " " else []
        looks = [(x, LOOK_VOWEL if c == "*" else LOOK) for x in LOOKS_LIKE.get(c, "")]
        if c in _APART or c in " \t":
            # one space between letters set apart may be noise, several end a word
            places.append([("", NOISE if run == 1 else 4 * NOISE), (" ", BREAK)] + looks)
        elif run >= 3 and own:
            places.append([(c, ONE_OF_MANY), (c + c, TWO_OF_MANY)])
        elif own or looks:
            places += [own + looks + ([] if own or c.isalnum() else [(" ", LOOK + BREAK)])] * run
        else:
            places.append([("", STRANGE), (" ", STRANGE)])
        at = end
    return places


def restore(word: str, model: np.ndarray) -> str:
    """The likeliest reading of a lower-case run, words divided by spaces.

    Viterbi over the lattice; a state is the last two characters, and each state's best reading is a
    chain of what was written at each place.
    """
    log = _rows(model)
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for choices in _lattice(word):
        nxt: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, chain) in states.items():
            for letters, price in choices:
                x, y, total = a, b, cost + price
                for letter in letters:
                    z = _of[letter]
                    if z or y:  # a word that has ended, or not begun, doesn't end again
                        total -= log[x][y][z]
                        x, y = y, z
                held = nxt.get((x, y))
                if held is None or total < held[0]:
                    nxt[x, y] = (total, (chain, letters) if letters else chain)
        states = nxt
    if not states:
        return word
    _, chain = min(((cost - (log[a][b][0] if b else 0.0), chain) for (a, b), (cost, chain) in states.items()), key=lambda x: x[0])
    said = []
    while chain is not None:
        chain, letters = chain
        said.append(letters)
    return " ".join("".join(reversed(said)).split())


_nested: dict[int, tuple[np.ndarray, list]] = {}


def _rows(model: np.ndarray) -> list:
    """The model as nested lists, which plain Python reads faster; one to a process."""
    held = _nested.get(id(model))
    if held is None or held[0] is not model:
        _nested.clear()
        held = _nested[id(model)] = (model, model.astype(float).tolist())
    return held[1]


def plain_words(raw: str, model: np.ndarray) -> list[str]:
    """A word without its punctuation; where it looks disguised, the words that it is restored to."""
    word = raw.strip(_STRIP)
    trimmed = word.rstrip("!")
    if trimmed.isalpha():
        return restore(trimmed, model).split() if _TRIPLE.search(trimmed) else [trimmed]
    letters = sum(c.isalpha() for c in word)
    odd = [c for c in trimmed if not c.isalpha()]
    if letters and len(odd) <= 2 * letters and all(c in LOOKS_LIKE or c in _APART for c in odd):
        return restore(trimmed, model).split()
    return [word]


def signs_of_word(word: str) -> list[str]:
    """A restored word's features: itself and its beginnings."""
    out = ["=" + word] if len(word) > 2 else []
    return out + [f"{n}{word[:n]}" for n in range(3, 9) if len(word) > n]


def signs(run: str, model: np.ndarray) -> list[str]:
    """The features of a word, or of a row of letters set apart."""
    words = restore(run, model).split() if _SPACED.fullmatch(run) else plain_words(run, model)
    return [f for w in words for f in signs_of_word(w)]


def words_of(text: str) -> set[str]:
    """Distinct lower-case words, and whole rows of letters set apart."""
    low = text.lower()
    return set(low.split()).union(m[0] for m in _SPACED.finditer(low))


def _texts(batch, names):
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def _few(batches):
    """Batches of ``MARK_ROWS`` rows at most: a row has thousands of features."""
    for batch in batches:
        for at in range(0, batch.num_rows, MARK_ROWS):
            yield batch.slice(at, MARK_ROWS)


def marks(batches, model: np.ndarray):
    """id, label and features of the first row of each id, from batches of (_id, _text, y)."""
    seen: set[int] = set()  # of repeated rows a task reads one; FIT_ROWS ids at most
    for batch in _few(batches):
        fresh = []
        for key, text, y in zip(*_texts(batch, ("_id", "_text", "y"))):
            if key not in seen:
                seen.add(key)
                fresh.append((key, y, sorted({f for w in words_of(text) for f in signs(w, model)})))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in fresh], pa.int64()), pa.array([r[1] for r in fresh], pa.int32()), pa.array([r[2] for r in fresh], pa.list_(pa.string()))], names=["id", "y", "f"])


def fit(rows: DataFrame, labels: DataFrame, folder: str, id_col: str = "doc_id", label_col: str = "toxic", trains=None):
    """(language model, weights by feature, intercept) from all texts of (_id, _text) and a bounded labelled sample.

    ``trains``: turns the id column into a boolean one of the rows that may be learnt from.
    """
    spark = rows.sparkSession
    lm = language_model(rows)
    model = spark.sparkContext.broadcast(lm)
    own = labels.select(labels[id_col].cast("long").alias("l_id"), labels[label_col].cast("int").alias("y")).where("l_id is not null and y is not null")
    if trains is not None:
        own = own.where(trains(F.col("l_id")))
    picked = own.groupBy("l_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("l_id"), "l_id").limit(FIT_ROWS)
    # FIT_ROWS rows at most, each with the hash of the one text to learn from
    chosen = rows.select("_id", F.xxhash64("_text").alias("h")).join(F.broadcast(picked), F.col("_id") == F.col("l_id")).groupBy("l_id", "y").agg(F.min("h").alias("l_h"))
    chosen = written(chosen, folder, "chosen")
    sample = rows.join(F.broadcast(chosen), (rows["_id"] == chosen["l_id"]) & (F.xxhash64(rows["_text"]) == chosen["l_h"])).select("_id", "_text", "y")

    marked = written(sample.mapInArrow(lambda batches: marks(batches, model.value), "id long, y int, f array<string>").dropDuplicates(["id"]), folder, "marked")
    total = marked.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("p")).head()
    n, p = total["n"], int(total["p"])
    if not 0 < p < n:
        share = p / n if n else 0.5
        return lm, {}, math.log((share or 1e-6) / ((1 - share) or 1e-6))
    # the features that tell the classes apart, by the smoothed log-likelihood ratio of their presence
    by = marked.select("y", F.explode("f").alias("f")).groupBy("f").agg(F.sum("y").alias("a"), F.sum(F.lit(1) - F.col("y")).alias("b")).where(F.col("a") + F.col("b") >= LEAST_SUPPORT)
    ratio = F.log(((F.col("a") + 0.5) / (p + 1)) / ((F.col("b") + 0.5) / (n - p + 1)))
    telling = by.where((F.abs(ratio) >= LEAST_RATIO) & (F.abs(ratio) * F.sqrt(F.col("a") + F.col("b")) >= LEAST_WEIGHT)).select("f").orderBy("f")
    best = [r["f"] for r in telling.collect()]  # features of FIT_ROWS texts
    number = spark.sparkContext.broadcast({f: i for i, f in enumerate(best)})

    def look_up(batches):
        for batch in _few(batches):
            ys, found = _texts(batch, ("y", "f"))
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array([[number.value[f] for f in x if f in number.value] for x in found], pa.list_(pa.int32()))], names=["y", "f"])

    rows_, cols, ys = [], [], []
    # FIT_ROWS rows at most, as ``marked`` has one to an id
    for r in marked.orderBy("id").select("y", "f").mapInArrow(look_up, "y int, f array<int>").toLocalIterator():
        rows_ += [len(ys)] * len(r["f"])
        cols += r["f"]
        ys.append(r["y"])
    weights, intercept = logistic(np.array(rows_, np.int64), np.array(cols, np.int64), np.array(ys, float), len(best))
    return lm, {f: float(w) for f, w in zip(best, weights) if abs(w) > 1e-3}, intercept


def logistic(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, width: int, penalty: float = 3.0, rounds: int = 50, enough: float = 1e-4) -> tuple[np.ndarray, float]:
    """Ridge-penalised logistic regression on binary features, the intercept free: weights and intercept.

    Newton's method, each step by conjugate gradients and halved while it leads uphill, until no part of
    the gradient exceeds ``enough`` of a row.
    """
    ridge = np.full(width + 1, penalty)
    ridge[width] = 0.0

    def times(w):
        return w[width] + np.bincount(rows, w[cols], len(y))

    def back(v):
        out = np.bincount(cols, v[rows], width + 1)
        out[width] = v.sum()
        return out

    def loss(w, z):
        return np.logaddexp(0, z).sum() - y @ z + 0.5 * ridge @ (w * w)

    w = np.zeros(width + 1)
    w[width] = math.log(y.mean() / (1 - y.mean()))
    z = times(w)
    for _ in range(rounds):
        chance = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        down = back(y - chance) - ridge * w
        if np.abs(down).max() < enough:
            break
        spread = chance * (1 - chance)
        scale = back(spread) + ridge + 1e-9
        step, left = np.zeros_like(w), down.copy()
        near = left / scale
        way, size = near.copy(), left @ near
        first = size
        for _ in range(200):
            bent = back(spread * times(way)) + ridge * way
            far = size / max(way @ bent, 1e-300)
            step += far * way
            left -= far * bent
            near = left / scale
            size, before = left @ near, size
            if size < 1e-4 * first:
                break
            way = near + size / before * way
        now, pace = loss(w, z), 1.0
        while pace > 1e-6 and loss(w + pace * step, ahead := times(w + pace * step)) > now:
            pace /= 2
        w, z = w + pace * step, ahead
    return w[:width], float(w[width])


def scorer(lm: np.ndarray, weights: dict[str, float], intercept: float):
    """A function from a text to its score, with a bounded cache of words."""
    worker_cache("toxicity")
    cache: dict[str, tuple[str, ...]] = {}

    def score(text: str) -> float:
        hits: set[str] = set()
        if len(cache) > CACHE_WORDS:
            cache.clear()
        for word in words_of(text):
            found = cache.get(word)
            if found is None:
                found = tuple(f for f in signs(word, lm) if f in weights)
                if len(word) <= CACHE_LENGTH:  # longer ones are restored anew each time
                    cache[word] = found
            if found:
                hits.update(found)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, intercept + sum(weights[f] for f in sorted(hits))))))

    return score


def held_out(id_col):
    """Rows whose CRC-32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(id_col.cast("string").cast("binary")) % 4 == 2


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", trains=None) -> DataFrame:
    """doc_id, score of every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = id_and_text(docs, id_col, text_col)
    model = spark.sparkContext.broadcast(fit(rows, labels, work_dir(spark), trains=trains))

    def run(batches):
        score = scorer(*model.value)
        for batch in batches:
            keys, texts = batch.columns
            yield pa.RecordBatch.from_arrays([keys, pa.array([score(t) for t in texts.to_pylist()], pa.float64())], names=["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")


def restored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with each disguised word in its restored spelling."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = id_and_text(docs, id_col, text_col)
    model = spark.sparkContext.broadcast(language_model(rows))

    def run(batches):
        for batch in batches:
            keys, texts = batch.columns
            out = [re.sub(r"\S+", lambda m: " ".join(plain_words(m[0], model.value)) or m[0], _SPACED.sub(lambda m: restore(m[0], model.value), t.lower())) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([keys, pa.array(out, pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(run, "doc_id long, text string")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns, in one pass and without a join."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = id_and_text(docs, id_col, text_col)
    model = spark.sparkContext.broadcast(fit(rows, labels, work_dir(spark), trains=lambda key: ~held_out(key)))
    at = docs.columns.index(text_col)

    def run(batches):
        score = scorer(*model.value)
        for batch in batches:
            yield batch.filter(pa.array([score(t or "") < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
