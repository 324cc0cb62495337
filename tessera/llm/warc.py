"""Operator 6: resolution of not-modified revisits in web captures.

A revisit record (a 304 answer) holds no payload; it refers to the latest earlier full response of the
same canonical URL.  The as-of step is two-level, so that a URL with a large share of all captures spreads
over many tasks: a range exchange by time and record id deals the captures to slots of equal sizes,
whatever their times are; each URL's last response of a slot is pre-aggregated, a window over these few
rows carries it to later slots, and the exact order within a slot is settled in windows of one URL and
slot.  Only record ids, validators and headers pass through the windows; which payloads are needed is
known before any is joined, and a response that answers many revisits meets them in several copies.

Status: ``response`` (a full record), ``resolved``, ``mismatch`` (validators disagree, or neither side
has one in common) or ``orphan`` (no earlier response).  Entity tags compare weakly; where the revisit
has none, last-modified must be equal.  The merged headers of a resolved record are the response's,
overridden by those of the 304 that may update a stored response (``PERMITTED``).

Cases: records with a null URL or time are orphans (responses stay responses and are never a source);
a null record id is kept, but is never a source.  Ties in time are settled by record id, the larger being
later; an empty table gives no row; repeated rows each get a result; of responses that repeat a record
id, that with the smallest hash gives headers and payload; very long payloads are never compared, only
hashed and joined; null payloads and headers stay null; other columns are pruned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import work_dir, written

#: Captures of a slot, and slots at most: one to a task of the range exchange.
SLOT_ROWS, SLOTS_MAX = 20_000, 4096
#: A response that answers over this share of the revisits is copied, so that no task meets more of them.
HOT_SHARE = 1 / 1000
#: Fields of a 304 answer that update the stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")


def canonical_url(url: Column) -> Column:
    """Without scheme, www, default port, fragment, tracking parameters, empty query and trailing slash; host in lower case."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[hH][tT][tT][pP][sS]?://(?:[wW][wW][wW]\\.)?", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), ":(?:80|443)$", "")
    rest = F.regexp_replace(bare, "^[^/?]*", "")
    rest = F.regexp_replace(rest, "([?&])(?:utm_[a-z]+|ref)=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(rest, "&&+", "&"), "[?]&+", "?")
    return F.concat(host, F.regexp_replace(rest, "/?[?&]*$", ""))


def _tag(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Resolve (record_id long, url string, ts long, is_revisit boolean, headers map<string,string>, payload string).

    Header names are lower-case.  Returns record_id, canonical_url, status, source_id, headers, payload.
    """
    rows = records.select("record_id", canonical_url(F.col("url")).alias("u"), "ts", F.coalesce("is_revisit", F.lit(False)).alias("is_revisit"), "headers")
    spark = records.sparkSession
    folder = work_dir(spark)
    source = F.when(~F.col("is_revisit") & F.col("record_id").isNotNull(), F.struct("ts", "record_id", F.col("headers")["etag"].alias("etag"), F.col("headers")["last-modified"].alias("modified")))
    placed = rows.where("u is not null and ts is not null").withColumn("own", source)
    slots = min(SLOTS_MAX, max(spark.sparkContext.defaultParallelism, placed.count() // SLOT_ROWS))
    placed = written(placed.repartitionByRange(slots, "ts", "record_id").withColumn("slot", F.spark_partition_id()), folder, "placed")

    last = placed.where("own is not null").groupBy("u", "slot").agg(F.max("own").alias("of_slot"))
    # a row to each URL and slot with a response: SLOTS_MAX rows to a URL at most
    # the slots that hold revisits look back over them
    slots = placed.where("is_revisit").select("u", "slot").distinct()
    marks = slots.select("u", "slot", F.lit(None).cast("struct<ts:bigint,record_id:bigint,etag:string,modified:string>").alias("of_slot"), F.lit(True).alias("asks")).unionByName(last.select("u", "slot", "of_slot", F.lit(False).alias("asks")))
    earlier = Window.partitionBy("u").orderBy("slot").rangeBetween(Window.unboundedPreceding, -1)
    before = marks.withColumn("before", F.last("of_slot", ignorenulls=True).over(earlier)).where("asks").select(F.col("u").alias("b_u"), F.col("slot").alias("b_slot"), "before")

    within = Window.partitionBy("u", "slot").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("local", F.last("own", ignorenulls=True).over(within)).where("is_revisit")
    asked = local.join(before, (F.col("u") == F.col("b_u")) & (F.col("slot") == F.col("b_slot")), "left").withColumn("source", F.coalesce("local", "before"))
    tag, modified = F.col("headers")["etag"], F.col("headers")["last-modified"]
    fits = F.when(tag.isNotNull(), F.coalesce(_tag(tag) == _tag(F.col("source.etag")), F.lit(False))).otherwise(F.coalesce(modified == F.col("source.modified"), F.lit(False)))
    status = F.when(F.col("source").isNull(), "orphan").when(fits, "resolved").otherwise("mismatch")
    judged = asked.select("record_id", F.col("u").alias("canonical_url"), status.alias("status"), F.when(status == "resolved", F.col("source.record_id")).alias("source_id"), "headers")

    lost = rows.where("is_revisit and (u is null or ts is null)").select("record_id", F.col("u").alias("canonical_url"), F.lit("orphan").alias("status"), F.lit(None).cast("long").alias("source_id"), "headers")
    judged = written(judged, folder, "judged")
    # the needed responses, and how many copies of each
    most = max(1.0, judged.count() * HOT_SHARE)
    needed = written(judged.where("source_id is not null").groupBy("source_id").agg(F.ceil(F.count("*") / most).cast("int").alias("copies")).withColumnRenamed("source_id", "n_id"), folder, "needed")
    own_hash = F.xxhash64("payload", F.to_json("headers"))
    full_rows = records.where("not coalesce(is_revisit, false)").select(F.col("record_id").alias("s_id"), F.col("headers").alias("s_headers"), F.col("payload").alias("s_payload"), own_hash.alias("h"))
    stored = full_rows.join(needed, F.col("s_id") == F.col("n_id")).withColumn("nth", F.row_number().over(Window.partitionBy("s_id").orderBy("h"))).where("nth = 1")
    stored = stored.select("s_id", "s_headers", "s_payload", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("s_salt"))
    # fewer than 1 / HOT_SHARE responses have several copies
    hot = needed.where("copies > 1")
    asking = judged.where("source_id is not null").join(F.broadcast(hot), F.col("source_id") == F.col("n_id"), "left")
    asking = asking.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("record_id"), F.col("copies")), F.lit(0)))
    allowed = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    kept = F.map_filter("s_headers", lambda k, v: ~F.array_contains(F.map_keys(allowed), k))
    merged = F.map_concat(kept, allowed)
    found = asking.join(stored, (F.col("source_id") == F.col("s_id")) & (F.col("salt") == F.col("s_salt"))).select("record_id", "canonical_url", "status", "source_id", merged.alias("headers"), F.col("s_payload").alias("payload"))
    # what has no source passes by the join
    rest = judged.where("source_id is null").unionByName(lost).withColumn("payload", F.lit(None).cast("string"))
    revisits = found.unionByName(rest)
    full = records.where("not coalesce(is_revisit, false)").select("record_id", canonical_url(F.col("url")).alias("canonical_url"), F.lit("response").alias("status"), F.lit(None).cast("long").alias("source_id"), "headers", "payload")
    return full.unionByName(revisits)


def captures(pages: DataFrame) -> DataFrame:
    """Capture records of a table of pages: each page is a full response in the order of page_id, and every
    third page's URL is asked for again later and answered with 304, one in four of them after a change."""
    p = pages.select("page_id", "url", "html")
    etag = F.concat(F.lit('"'), F.md5(F.coalesce(canonical_url(F.col("url")), F.lit(""))), F.lit('"'))
    ts = F.col("page_id") * 2
    full = p.select(
        (F.col("page_id") * 2).alias("record_id"), "url", ts.alias("ts"), F.lit(False).alias("is_revisit"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.octet_length("html").cast("string"), F.lit("etag"), etag, F.lit("date"), ts.cast("string")).alias("headers"),
        F.col("html").alias("payload"),
    )
    again = ts + 1001
    seen = F.when(F.col("page_id") % 4 == 2, F.lit('"changed"')).otherwise(F.concat(F.lit("W/"), etag))
    revisit = p.where("page_id % 3 = 2").select(
        (F.col("page_id") * 2 + 1).alias("record_id"), "url", again.alias("ts"), F.lit(True).alias("is_revisit"),
        F.create_map(F.lit("content-length"), F.lit("0"), F.lit("etag"), seen, F.lit("date"), again.cast("string"), F.lit("cache-control"), F.lit("max-age=60")).alias("headers"),
        F.lit(None).cast("string").alias("payload"),
    )
    return full.unionByName(revisit)


def digest(resolved: DataFrame) -> DataFrame:
    """Headers as one sorted string and the payload's SHA-256."""
    said = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return resolved.select("record_id", "canonical_url", "status", "source_id", said.alias("headers"), F.sha2(F.col("payload"), 256).alias("payload_sha256"))


ORACLE = r"""
    WITH bare AS (
        SELECT page_id, url, html, regexp_replace(regexp_replace(url, '#.*$', ''), '^[hH][tT][tT][pP][sS]?://(?:[wW][wW][wW]\.)?', '') AS b FROM pages),
    parts AS (
        SELECT page_id, html, regexp_replace(lower(regexp_extract(b, '^[^/?]*')), ':(?:80|443)$', '') AS host,
               regexp_replace(regexp_replace(b, '^[^/?]*', ''), '([?&])(?:utm_[a-z]+|ref)=[^&]*', '\1', 'g') AS rest FROM bare),
    canon AS (
        SELECT page_id, html, host || regexp_replace(regexp_replace(regexp_replace(rest, '&&+', '&', 'g'), '[?]&+', '?', 'g'), '/?[?&]*$', '') AS u FROM parts),
    resp AS (SELECT page_id * 2 AS record_id, u, page_id * 2 AS ts, '"' || md5(u) || '"' AS etag, html FROM canon),
    rev AS (
        SELECT page_id * 2 + 1 AS record_id, u, page_id * 2 + 1001 AS ts,
               CASE WHEN page_id % 4 = 2 THEN '"changed"' ELSE '"' || md5(u) || '"' END AS etag,
               CASE WHEN page_id % 4 = 2 THEN '"changed"' ELSE 'W/"' || md5(u) || '"' END AS said
        FROM canon WHERE page_id % 3 = 2),
    src AS (
        SELECT v.record_id, v.u, v.ts, v.etag, v.said, r.record_id AS s_id, r.etag AS s_etag, r.html AS s_html
        FROM rev v ASOF LEFT JOIN resp r ON v.u = r.u AND v.ts > r.ts)
    SELECT record_id, u AS canonical_url, 'response' AS status, CAST(NULL AS BIGINT) AS source_id,
           'content-length=' || strlen(html) || ';content-type=text/html;date=' || ts || ';etag=' || etag AS headers, sha256(html) AS payload_sha256
    FROM resp
    UNION ALL
    SELECT record_id, u, CASE WHEN s_id IS NULL THEN 'orphan' WHEN etag = s_etag THEN 'resolved' ELSE 'mismatch' END,
           CASE WHEN etag = s_etag THEN s_id END,
           CASE WHEN etag = s_etag
                THEN 'cache-control=max-age=60;content-length=' || strlen(s_html) || ';content-type=text/html;date=' || ts || ';etag=' || said
                ELSE 'cache-control=max-age=60;content-length=0;date=' || ts || ';etag=' || said END,
           CASE WHEN etag = s_etag THEN sha256(s_html) END
    FROM src
"""
