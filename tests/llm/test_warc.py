"""Operator 6 against a plain loop."""

import pytest

from tessera.llm import warc

SCHEMA = "record_id long, url string, ts long, is_revisit boolean, headers map<string,string>, payload string, slot int, u string"


def slow(rows, canon):
    out = []
    for r in rows:
        rid, url, ts, revisit, headers, payload = r[:6]
        if not revisit:
            out.append((rid, canon[url], "response", None, headers, payload))
            continue
        before = [x for x in rows if not x[3] and url is not None and ts is not None and x[2] is not None and canon[x[1]] == canon[url] and (x[2], x[0]) < (ts, rid)]
        if not before:
            out.append((rid, canon[url], "orphan", None, headers, None))
            continue
        s = max(before, key=lambda x: (x[2], x[0]))
        tag, own = (headers or {}).get("etag"), (s[4] or {})
        fits = own.get("etag") is not None and tag.removeprefix("W/") == own["etag"].removeprefix("W/") if tag is not None else (headers or {}).get("last-modified") is not None and (headers or {}).get("last-modified") == own.get("last-modified")
        if not fits:
            out.append((rid, canon[url], "mismatch", None, headers, None))
        else:
            out.append((rid, canon[url], "resolved", s[0], own | {k: v for k, v in (headers or {}).items() if k in warc.PERMITTED and v is not None}, s[5]))
    return sorted(out, key=lambda x: x[0])


def rows():
    import random

    rng = random.Random(5)
    urls = ["http://A.example/x/?utm_source=f", "https://www.a.example/x#top", "http://b.example/?ref=1&p=2", "http://b.example?p=2", None, "http://hot.example/"]
    out = []
    for i in range(400):
        url = rng.choice(urls + ["http://hot.example/"] * 6)
        revisit = rng.random() < 0.5
        headers = rng.choice([None, {}, {"etag": '"1"', "content-type": "t"}, {"etag": 'W/"1"', "date": "d", "content-length": "0"}, {"last-modified": "m", "expires": None}, {"last-modified": "m", "content-length": "9"}])
        out.append((i, url, rng.choice([None, *range(60)]), rng.choice([True, revisit, revisit]) if revisit else False, headers, None if revisit else f"p{i}", 1, "x"))
    return out


@pytest.mark.parametrize("n", [0, 400])
def test_revisits(spark, n):
    data = rows()[:n]
    df = spark.createDataFrame(data, SCHEMA)
    canon = {r.url: r.c for r in df.select("url", warc.canonical_url(df.url).alias("c")).distinct().collect()}
    got = sorted((tuple(r) for r in warc.resolve_revisits(df).collect()), key=lambda x: x[0])
    assert got == slow(data, canon)
    if n:
        assert {g[2] for g in got} == {"response", "resolved", "mismatch", "orphan"}
        assert canon["http://A.example/x/?utm_source=f"] == canon["https://www.a.example/x#top"] == "a.example/x"
        assert canon["http://b.example/?ref=1&p=2"].replace("/?", "?") == canon["http://b.example?p=2"]


def test_hot_source_and_outlier(spark):
    """One response that answers most revisits, one time far off, repeated record ids and a very long payload."""
    data = [(0, "http://h.example:80/", 1, False, {"etag": '"1"'}, "p" * 300_000, 1, "x"), (0, "http://h.example/", 1, False, {"etag": '"1"'}, "p" * 300_000, 1, "x")]
    data += [(i, "https://H.example/", i, True, {"etag": '"1"', "date": str(i)}, None, 1, "x") for i in range(1, 3000)]
    data += [(5000, "http://o.example/", 1 << 40, False, None, "far", 1, "x"), (None, "http://o.example/", 7, False, {"etag": '"1"'}, "no id", 1, "x"), (5001, "http://o.example/", 9, True, {"etag": '"1"'}, None, 1, "x")]
    got = warc.resolve_revisits(spark.createDataFrame(data, SCHEMA)).selectExpr("record_id", "status", "source_id", "length(payload) AS n", "headers['date'] AS d").collect()
    assert len(got) == len(data)
    solved = [r for r in got if r.status == "resolved"]
    assert len(solved) == 2999 and {(r.source_id, r.n) for r in solved} == {(0, 300_000)} and all(r.d == str(r.record_id) for r in solved)
    assert {r.record_id for r in got if r.status == "orphan"} == {5001}
