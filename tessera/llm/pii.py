"""Operator 7: personal data, by pattern and by bootstrapped contextual extraction.  DataFrame functions only.

Base kinds (email, ip, card, phone) are matched by pattern and confirmed by their rules.  They seed a
graph of patterns (the two words before an entity) and instances (the values seen there): rounds of
joins and aggregations raise a pattern's confidence with the share of its instances that are known to
be of a kind, and an instance's score with its best pattern.  Patterns that end up confident and well
supported discover further identifiers: tokens with digits that stand in the same place but have
another shape.  Instances count once for a pattern however often a text repeats.

Positions come from splitting a text at the matches: code points, end exclusive, by prefix sums over
the lengths of gaps and matches.  The sums are taken in blocks (``_running``), so that their cost is
linear in the number of matches.  The patterns are written so that no text can make them backtrack:
runs are possessive, and a match starts at the start of a run or where the last match ended.

Cases: a null text counts as empty and has no span; a null id stays null; very long texts are scanned
whole; rows of one id with different texts and repeated rows are each reported; spans that start
together stand in the order of the kinds; an empty table gives no row; other columns are pruned by the
search and kept by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import work_dir, written

KINDS = ("email", "ip", "card", "phone")
FOUND = tuple(f"ctx_{k}" for k in KINDS)
ROUNDS, CONFIDENT, SUPPORT, DAMPING = 3, 0.7, 5.0, 2.0

_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[ -]?[0-9]){11,}+"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_TOKEN = r"(?<![A-Za-z0-9._/@+-])[A-Za-z._/@+-]*+[0-9][A-Za-z0-9._/@+-]*+"
_SPAN = "array<struct<start:int,end:int,value:string,left:string>>"
_WORD, _MARK = r"[^\s.,;:!?()\"']", r"[\s.,;:!?()\"']"
#: Elements of a block of prefix sums, and characters of a piece of a text that is redacted.
BLOCK, PIECE = 64, 1024


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _blocks(values: Column) -> Column:
    """An array cut into arrays of ``BLOCK`` elements."""
    count = F.ceil(F.size(values) / BLOCK).cast("int")
    return F.transform(F.slice(F.sequence(F.lit(0), count), F.lit(1), count), lambda i: F.slice(values, i * BLOCK + 1, F.lit(BLOCK)))


def _running(values: Column, merge, zero: Column, depth: int = 2) -> Column:
    """What ``merge`` makes of all earlier elements, for each element of an array.

    Within a block by aggregation; the blocks' totals are summed up in the same way, so that no element
    is copied more than ``BLOCK`` times.
    """

    def plain(array):
        step = lambda held, v: F.struct(merge(held["at"], v).alias("at"), F.concat(held["out"], F.array(held["at"])).alias("out"))
        return F.aggregate(array, F.struct(zero.alias("at"), F.slice(F.array(zero), 1, 0).alias("out")), step)

    if not depth:
        return plain(values)["out"]

    def whole(blocks):
        bases = _running(F.transform(blocks, lambda b: b["at"]), merge, zero, depth - 1)
        return F.flatten(F.zip_with(blocks, bases, lambda b, base: F.transform(b["out"], lambda x: merge(base, x))))

    return _let(values, lambda v: F.when(F.size(v) <= BLOCK, plain(v)["out"]).otherwise(_let(F.transform(_blocks(v), plain), whole)))


def _left(gap: Column) -> Column:
    """The two words at a gap's end, in lower case."""
    ends = F.reverse(F.regexp_extract(F.reverse(gap), f"^{_MARK}*+{_WORD}++(?:{_MARK}++{_WORD}++)?+", 0))
    return F.trim(F.regexp_replace(F.lower(ends), f"{_MARK}++", " "))


def _spans(pattern: str, guard: Column) -> Column:
    """All matches with their places and the two words before each; the gaps between matches give the places."""
    text = F.col("_text")
    found = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"))

    def placed(pairs):
        lengths = F.transform(pairs, lambda p: F.length(p["gap"]) + F.length(p["value"]))
        return F.zip_with(pairs, _running(lengths, lambda a, b: a + b, F.lit(0)), span)

    def span(pair, at):
        start = at + F.length(pair["gap"])
        return F.struct(start.alias("start"), (start + F.length(pair["value"])).alias("end"), pair["value"].alias("value"), _left(pair["gap"]).alias("left"))

    pairs = lambda f: F.zip_with(F.slice(f["gaps"], F.lit(1), F.size(f["values"])), f["values"], lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    return F.when(guard, _let(_let(found, pairs), placed)).otherwise(F.array().cast(_SPAN))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The check digit fits: every second digit from the right counts double, less nine if over nine."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(places, F.lit(0), lambda a, d: a + d) % 10 == 0


def _confirmed(kind: str, spans: Column) -> Column:
    if kind == "ip":
        return F.filter(spans, lambda s: F.forall(F.split(s["value"], r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))
    if kind == "card":
        return F.filter(spans, lambda s: F.length(_digits(s["value"])).between(12, 19) & _luhn(F.when(F.length(_digits(s["value"])).between(12, 19), _digits(s["value"])).otherwise("1")))
    if kind == "phone":
        return F.filter(spans, lambda s: F.length(_digits(s["value"])).between(9, 15))
    return spans


def _named(k: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"), s["value"].alias("value"), s["left"].alias("left"))


def _apart(tokens: Column, base: Column) -> Column:
    """The tokens that no base span overlaps: in the order of their starts, each is compared with the furthest
    end of earlier base spans and the nearest start of later ones."""
    mark = lambda s, is_base: F.struct(s["start"].alias("start"), F.lit(not is_base).alias("is_token"), s["end"].alias("end"), s["value"].alias("value"), s["left"].alias("left"))
    far = F.lit((1 << 31) - 1)

    def judged(marks):
        reach = _running(F.transform(marks, lambda m: F.when(~m["is_token"], m["end"]).otherwise(F.lit(0))), lambda a, b: F.greatest(a, b), F.lit(0))
        ahead = F.reverse(_running(F.reverse(F.transform(marks, lambda m: F.when(~m["is_token"], m["start"]).otherwise(far))), lambda a, b: F.least(a, b), far))
        free = F.zip_with(F.zip_with(marks, reach, lambda m, r: F.struct(m.alias("m"), r.alias("r"))), ahead, lambda x, n: F.when(x["m"]["is_token"] & (x["r"] <= x["m"]["start"]) & (n >= x["m"]["end"]), x["m"]))
        kept = F.filter(free, lambda m: m.isNotNull())
        return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), m["left"].alias("left")))

    # of equal starts the base span comes first, so that it is an earlier one
    order = F.array_sort(F.concat(F.transform(base, lambda s: mark(s, True)), F.transform(tokens, lambda s: mark(s, False))))
    return F.when(F.size(tokens) == 0, tokens).otherwise(_let(order, judged))


def scanned(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(_row, _id, base, tokens): base spans with their kinds, and other tokens with digits.

    With ``carry`` the row itself comes along, as the struct ``_doc``.
    """
    text = F.col("_text")
    rules = {
        "email": (_EMAIL, text.contains("@")),
        "ip": (_IP, text.rlike(r"[0-9]\.[0-9]")),
        "card": (_CARD, text.rlike(r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]")),
        "phone": (_PHONE, text.contains("+")),
    }
    own = F.struct(*(docs[c] for c in docs.columns)).alias("_doc")
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), docs[id_col].cast("long").alias("_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_text"), *([own] if carry else []))
    base = F.array_sort(
        F.concat(
            *(
                F.transform(_confirmed(kind, _spans(pattern, guard)), _named(k))
                for k, (kind, (pattern, guard)) in enumerate(rules.items())
            )
        )
    )
    trimmed = F.transform(_spans(_TOKEN, text.rlike("[0-9]")), lambda s: _let(F.rtrim(s["value"], F.lit("._/@+-")), lambda v: F.struct(s["start"].alias("start"), (s["start"] + F.length(v)).alias("end"), v.alias("value"), s["left"].alias("left"))))
    long_ = F.filter(trimmed, lambda c: (F.length(c["value"]) >= 5) & (F.length(_digits(c["value"])) >= 3))
    tokens = F.when(F.size("base") == 0, long_).otherwise(_let(long_, lambda t: _apart(t, F.col("base"))))
    return written(rows.withColumn("base", base).withColumn("tokens", tokens).drop("_text"), folder, "scanned")


def patterns(found: DataFrame, folder: str) -> DataFrame:
    """(left, kind, confidence) of the confident patterns, after rounds over the pattern-instance graph."""
    seen = found.select(F.explode(F.concat(F.transform("base", lambda s: F.struct(s["left"].alias("left"), s["value"].alias("value"), s["kind"].alias("seed"))), F.transform("tokens", lambda s: F.struct(s["left"].alias("left"), s["value"].alias("value"), F.lit(None).cast("int").alias("seed"))))).alias("e")).select("e.*")
    edges = written(seen.where("trim(left) <> ''").distinct(), folder, "graph")
    known = edges.where("seed is not null").select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct()
    size = edges.groupBy("left").agg(F.count_distinct("value").alias("n"))
    # only patterns that some seed stands in can ever gain confidence
    pairs = edges.select("left", "value").distinct()
    kept = None
    for _ in range(ROUNDS):
        support = pairs.join(known, "value").groupBy("left", "kind").agg(F.sum("score").alias("support"))
        kept = (
            support.where(F.col("support") >= SUPPORT)
            .join(size, "left")
            .select("left", "kind", (F.col("support") / (F.col("n") + DAMPING)).alias("confidence"))
            .where(F.col("confidence") >= CONFIDENT)
        )
        kept = written(kept, folder, f"patterns-{_}")
        taught = pairs.join(kept, "left").groupBy("value", "kind").agg(F.max("confidence").alias("score"))
        known = known.unionByName(taught).groupBy("value", "kind").agg(F.max("score").alias("score"))
    return kept


def discovered(found: DataFrame, kept: DataFrame) -> DataFrame:
    """(_row, more): spans of tokens that stand in a confident pattern, its best kind first."""
    tokens = found.where(F.size("tokens") > 0).select("_row", F.explode("tokens").alias("t")).select("_row", "t.start", "t.end", "t.left")
    best = kept.groupBy("left").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"))
    hits = tokens.join(best, "left").select("_row", F.struct("start", (F.col("kind") + len(KINDS)).alias("kind"), "end").alias("s"))
    return hits.groupBy("_row").agg(F.array_sort(F.collect_list("s")).alias("more"))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """doc_id, base and spans (base and discovered), each array<struct<start, kind, end>>; kind numbers ``KINDS + FOUND``."""
    folder = folder or work_dir(docs.sparkSession)
    found = scanned(docs, folder, id_col, text_col)
    more = discovered(found, patterns(found, folder)).withColumnRenamed("_row", "m_row")
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return (
        found.select("_row", F.col("_id").alias("doc_id"), plain.alias("base"))
        .join(more, F.col("_row") == F.col("m_row"), "left")
        .select("_row", "doc_id", "base", F.array_sort(F.concat("base", F.coalesce("more", none))).alias("spans"))
    )


def _said(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS + FOUND))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans and all spans as one string."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)), F.sha2(_said("base"), 256).alias("base_sha256"), _said("spans").alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each span replaced by its kind's mark; all columns stay.

    Of overlapping spans the first gives the mark and all are covered.
    """
    folder = work_dir(docs.sparkSession)
    found = scanned(docs, folder, id_col, text_col, carry=True)
    more = discovered(found, patterns(found, folder)).withColumnRenamed("_row", "m_row")
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    found = found.withColumn("base", plain)
    # only rows with further tokens can have further spans: the others don't meet the join
    few = found.where(F.size("tokens") > 0).join(more, F.col("_row") == F.col("m_row"), "left")
    spans = few.select("_doc", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,end:int>>")))).alias("spans"))
    spans = found.where(F.size("tokens") == 0).select("_doc", F.col("base").alias("spans")).unionAll(spans)
    marks = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS * 2))
    text = F.col("_doc")[text_col]

    def clean(pieces):
        """Gaps between the spans, each from the few pieces of the text that it lies in, and marks."""

        def between(start, end):
            first = F.floor(start / PIECE).cast("int")
            held = F.array_join(F.slice(pieces, first + 1, F.floor(end / PIECE).cast("int") - first + 1), "")
            return F.when(end > start, F.substring(held, start - first * PIECE + 1, end - start)).otherwise("")

        covered = F.col("covered")
        parts = F.zip_with("spans", covered, lambda s, at: F.when(s["start"] >= at, F.concat(between(at, s["start"]), F.element_at(marks, s["kind"] + 1))).otherwise(""))
        last = F.array_max(F.transform("spans", lambda s: s["end"]))
        return F.concat(F.array_join(parts, ""), between(last, F.length(text)))

    redacted = _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), clean)
    spans = spans.withColumn("covered", _running(F.transform("spans", lambda s: s["end"]), lambda a, b: F.greatest(a, b), F.lit(0)))
    return spans.select(*(F.when(F.size("spans") > 0, redacted).otherwise(text).alias(c) if c == text_col else F.col("_doc")[c].alias(c) for c in docs.columns))
