import base64
import collections
import datetime
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from aeonframe.llm import url_lists, warc_store
from aeonframe.llm._shared import fresh_path

DAY = datetime.date(2024, 1, 1)


def day(n):
    return DAY + datetime.timedelta(days=n)


def test_intervals(spark):
    log = [("2024-01-05", "add", "A.example", "x"), ("2024-01-07", "add", "a.example", "x"), ("2024-01-09", "remove", "a.example", "x"), ("2024-01-09", "remove", "b.example", "x"), ("2024-01-10", "remove", "a.example", "x"), ("2024-01-10", "add", "a.example", "x"), (None, "add", "c", "x"), ("2024-01-10", "add", None, "x")]
    got = {tuple(r) for r in url_lists.intervals(url_lists.entries(spark, log)).collect()}
    assert got == {("a.example", "x", day(4), day(8)), ("a.example", "x", day(9), None)}


def test_keys(spark):
    df = spark.createDataFrame([("HTTPS://u@Blog.A.example:80/x/Y/z?q#f",), ("no url",), (None,), ("http://a.example",)], "url string")
    got = [r[0] and set(r[0]) for r in df.select(url_lists.keys(F.col("url"))).collect()]
    hosts = ["blog.a.example", "a.example", "example"]
    assert got == [{h + p for h in hosts for p in ("", "/", "/x/", "/x/y/")}, None, None, {"a.example", "example"}]


def test_hosts_that_are_addresses(spark):
    urls = ["http://[::1]/a", "http://u@[2001:DB8::1.2.3.4]:80?q", "http://[::1", "http://a]b/", "http://10.0.0.1/"]
    df = spark.createDataFrame([(k, u, day(3)) for k, u in enumerate(urls)], "page_id long, url string, day date")
    assert [r[0] for r in df.select(url_lists.host(F.col("url"))).collect()] == ["[::1]", "[2001:db8::1.2.3.4]", None, None, "10.0.0.1"]
    assert set(df.select(url_lists.keys(F.col("url"))).first()[0]) == {"[::1]", "[::1]/"}
    log = [("2024-01-01", "add", "[::1]", "x"), ("2024-01-01", "add", "[2001:db8::1.2.3.4]", "y")]
    got = {r["page_id"]: r["categories"] for r in url_lists.evaluate(df, url_lists.entries(spark, log)).collect()}
    assert got == {0: "x", 1: "y", 2: "", 3: "", 4: ""}


def test_prefixes_that_end_anywhere(spark):
    log = [("2024-01-01", "add", p, p) for p in ("a.example/ads", "a.example/x/page.html", "b.a.example/ad", "a.example/ads/1/2/3")]
    urls = {1: "http://a.example/ads", 2: "http://a.example/adserver/1?q", 3: "http://c.a.example/x/Page.html#f", 4: "http://b.a.example/ads/", 5: "http://a.example/x/page", 6: "http://a.example"}
    captures = spark.createDataFrame([(k, u, day(3)) for k, u in urls.items()], "page_id long, url string, day date")
    got = {r["page_id"]: r["categories"] for r in url_lists.evaluate(captures, url_lists.entries(spark, log)).collect()}
    assert got == {1: "a.example/ads", 2: "a.example/ads", 3: "a.example/x/page.html", 4: "a.example/ads,b.a.example/ad", 5: "", 6: ""}


def test_evaluation_against_a_plain_model(spark):
    log = [("2024-01-02", "add", "a.example", "bad"), ("2024-01-06", "remove", "a.example", "bad"), ("2024-01-03", "add", "good.a.example", "allow"), ("2024-01-04", "add", "a.example/ads/", "ads"), ("2024-01-08", "add", "a.example", "worse")]
    urls = ["http://a.example/", "http://x.a.example/ads/1", "http://good.a.example/ads/", "http://nota.example/", "no url", None]
    rows = [(k * 10 + n, u, day(n)) for k, u in enumerate(urls) for n in range(10)] + [(999, urls[0], None), (0, urls[0], day(0)), (None, urls[0], day(3))]
    captures = spark.createDataFrame(rows, "page_id long, url string, day date")

    def model(url, when):
        active = {}
        if not url or not when or "://" not in url:
            return "pass", 0
        host, _, path = url.split("://")[1].partition("/")
        for d, action, pattern, category in log:
            if d <= str(when):
                active.pop((pattern, category), None) if action == "remove" else active.setdefault((pattern, category), d)
        hit = []
        for p, c in active:
            h, _, q = p.partition("/")
            if (host == h or host.endswith("." + h)) and (path.startswith(q)):
                hit.append((len(p), c == "allow", p, c))
        return ("pass" if not hit else "allow" if max(hit)[3] == "allow" else "block"), len(hit)

    got = collections.Counter((r["page_id"], r["verdict"], r["n_active"]) for r in url_lists.evaluate(captures, url_lists.entries(spark, log)).collect())
    assert got == collections.Counter((i, *model(u, d)) for i, u, d in rows)
    assert {r["verdict"] for r in url_lists.evaluate(captures, url_lists.entries(spark, [])).collect()} == {"pass"}
    assert url_lists.evaluate(captures.limit(0), url_lists.entries(spark, log)).count() == 0
    plan = url_lists.evaluate(spark.sql("select 1L page_id, 'http://a.b/' url, date'2024-01-01' day"), url_lists.entries(spark, log))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


PAGES = [(1, "http://a/", "<p>one</p>"), (2, "http://b/ x\n", "<p>one</p>"), (3, None, ""), (4, "http://d/", None), (5, "http://e/", "é\r\n\r\nWARC/1.1\r\n" * 50), (6, "http://f/", "<p>one</p>"), (6, "http://f/", "<p>one</p>"), (None, "http://g/", "<p>one</p>"), (None, "http://h/", "alone")]


@pytest.mark.parametrize("least", [0, 5])
def test_archive(spark, least):
    pages = spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id long, url string, html string, digest string")
    largest = {}
    for i, _, h in PAGES:
        if i is not None and len((h or "").encode()) >= least:
            largest[h or ""] = max(largest.get(h or "", -1), i)
    want = collections.Counter()
    for i, _, h in PAGES:
        top, raw = largest.get(h or ""), (h or "").encode()
        again = top is not None and i != top
        want[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", top if again else None] += 1
    assert collections.Counter(tuple(r) for r in warc_store.archive(pages, least).collect()) == want
    assert warc_store.archive(pages.limit(0)).count() == 0


def test_payloads_are_stored_once_and_records_are_exact(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = fresh_path(spark, "warc-test")
    warc_store.write_archive(pages, path)
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for _, _, h in PAGES})
    by_id = {r["page_id"]: bytes(r["record"]) for r in warc_store.records(spark, path).collect()}
    fields, http, payload = warc_store.parse(by_id[5])
    assert payload == PAGES[4][2].encode() and fields["warc-type"] == "response" and http.startswith(b"HTTP/1.1 200")
    fields, _, payload = warc_store.parse(by_id[2])
    assert fields["warc-refers-to"] == "<urn:page:6>" and payload == b"" and fields["warc-target-uri"] == "http://b/%20x%20"
    assert by_id[5].endswith(b"\r\n\r\n")
    with pytest.raises(ValueError):
        warc_store.parse(by_id[5] + b"x")
