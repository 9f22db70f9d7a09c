"""Operators 1 and 6 against DuckDB and plain Python."""

import gzip
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from tilewright.llm import url_filter, warc_captures
from tilewright.llm.common import scratch

QUERIES = {"op1": (warc_captures.op1_warc_captures, warc_captures.ORACLE_SQL), "op6": (url_filter.op6_url_filter, url_filter.ORACLE_SQL)}


@pytest.mark.parametrize("name", QUERIES)
def test_against_sql(spark, small, empty, name):
    query, sql = QUERIES[name]
    found = query(spark, small)
    columns = found.columns
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT page_id, url, html FROM '{small}/pages.parquet'")
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key)
    assert query(spark, empty).count() == 0


@pytest.mark.parametrize("bound", [0, 1000])
def test_filter_has_no_false_negatives_and_the_join_removes_false_positives(spark, monkeypatch, bound):
    monkeypatch.setattr(url_filter, "PER_BLOCK", 1000)  # one block of 256 bits: nearly everything passes
    monkeypatch.setattr(url_filter, "MAX_BLOCKS", bound)  # joined by block, or broadcast
    monkeypatch.setattr(url_filter, "MAX_BROADCAST", bound)
    urls = spark.createDataFrame([(k, f"http://h{k}.test/p") for k in range(400)] + [(None, None)], "page_id long, url string")
    listed = urls.where("page_id % 2 = 0").select(url_filter.canonical(urls.url).alias("listed_url"))
    out = url_filter.judge(urls, listed, rules=()).collect()
    assert len(out) == 401 and {r.page_id for r in out if r.verdict == "block"} == set(range(0, 400, 2))
    assert all(r.possible for r in out if r.listed) and sum(r.possible for r in out) > 250


LISTED = ["http://www.shop.test:80/a/?b=2&a=1", "http://shop.test/b#top", "https://m.shop.test/c/", "http://Shop.TEST/d?utm_source=x"]
SEEN = {
    "https://shop.test/a?a=1&b=2": True, "http://shop.test:443/a/?ref=z&b=2&a=1": True, "http://shop.test/a?a=1": False, "http://shop.test/b/": True, "http://shop.test/b?x=1": False,
    "http://m.shop.test/c": True, "http://www.m.shop.test/c": True, "http://shop.test/c": False, "http://shop.test/d?gclid=1": True, "http://shop.test/dd": False, "no scheme": False, None: False,
}


@pytest.mark.parametrize(("blocks", "broadcast"), [(65_536, 200_000), (65_536, 2), (0, 200_000), (0, 2)])
def test_a_feed_of_pages_in_other_forms(spark, monkeypatch, blocks, broadcast):
    monkeypatch.setattr(url_filter, "MAX_BLOCKS", blocks)
    monkeypatch.setattr(url_filter, "MAX_BROADCAST", broadcast)
    monkeypatch.setattr(url_filter, "PER_BLOCK", 2)
    rows = [(k, u) for k, u in enumerate(SEEN)] + [(100 + k, "https://shop.test/a?a=1&b=2") for k in range(500)] + [(1000 + k, None) for k in range(500)]  # a popular URL, and many without
    feed = spark.createDataFrame([(u,) for u in LISTED], "url string").select(url_filter.canonical(F.col("url")).alias("listed_url"))
    out = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), feed, rules=()).collect()}
    assert len(out) == len(rows)
    for page, url in rows:
        assert out[page].listed == (SEEN[url] if url in SEEN else True) and out[page].verdict == ("block" if out[page].listed else "allow")
        assert out[page].possible or not out[page].listed


def test_the_list_of_the_query(spark):
    urls = ["http://m.free-bets.org/en/1?utm_source=feed", "https://www.free-bets.org/en/2", "http://free-bets.org.clean.org/", "http://clean.org/free-bets", "http://xfree-bets.org/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert {r.listed_url for r in url_filter.listed_urls(pages).collect()} == {"m.free-bets.org/en/1", "free-bets.org/en/2", "free-bets.org.clean.org"}


def test_no_python_in_the_url_filter(spark, small):
    plan = url_filter.op6_url_filter(spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_records_of_foreign_archives(spark, tmp_path):
    def record(kind, rid, block, *more):
        head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", *more, f"Content-Length: {len(block)}"]
        return ("WARC/1.0\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    parts = [
        record("warcinfo", "<i>", b"software: x"),
        record("response", "<r1>", http + b"one", "WARC-Concurrent-To: <q1>"),  # points at its request
        record("request", "<q1>", b"GET / HTTP/1.1\r\n\r\n"),
        record("metadata", "<m1>", b"page-id: 5\r\n", "WARC-Concurrent-To: <q1>"),  # through the request
        record("response", "<r2>", http + b"two"),
        record("metadata", "<m2>", b"page-id: 6\r\n", "WARC-Concurrent-To: <r2>"),
        record("metadata", "<m3>", b"note: x\r\n", "WARC-Concurrent-To: <r2>"),
        record("metadata", "<m4>", b"page-id: 9\r\n", "WARC-Concurrent-To: <gone>"),  # its response is missing
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))  # a member for each record
    (tmp_path / "b.warc").write_bytes(record("revisit", "<v1>", http, "WARC-Refers-To: <r2>", "WARC-Payload-Digest: sha1:" + "A" * 32))
    read = warc_captures.read_records(spark, str(tmp_path), with_payload=True)
    assert {r.id: bytes(r.payload) for r in read.collect() if r.payload is not None} == {"<r1>": b"one", "<r2>": b"two"}
    out = {r.capture: r for r in warc_captures.assemble(read).collect()}
    assert set(out) == {"<r1>", "<r2>", "<v1>", "<gone>"}
    assert out["<r1>"].request.id == "<q1>" and out["<r1>"].metadata[0].page_id == 5
    assert {m.id for m in out["<r2>"].metadata} == {"<m2>", "<m3>"} and out["<r2>"].request is None
    assert out["<v1>"].response.record.refers_to_page == 6 and out["<v1>"].response.record.payload_digest == "0" * 40
    assert out["<gone>"].response is None


def test_written_archives_are_whole(spark, small):
    path = scratch(spark, "warc-test")
    warc_captures.write_captures(spark.read.parquet(f"{small}/pages.parquet"), path)
    kinds = [r.type for r in warc_captures.read_records(spark, path).collect()]
    assert kinds.count("request") == kinds.count("metadata") == 18 and len(kinds) == 54


def test_cut_archives_are_an_error():
    whole = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 20\r\n\r\nshort"
    with pytest.raises(ValueError):
        list(warc_captures.records(whole))


def test_every_row_is_a_capture_of_its_own(spark):
    html = "<p>" + "same " * 400
    pages = spark.createDataFrame([(5, "http://a/", html), (5, "http://b/", html), (None, "http://c/", html), (None, "http://c/", html)], "page_id long, url string, html string")
    path = scratch(spark, "warc-test")
    warc_captures.write_captures(pages, path)
    read = warc_captures.read_records(spark, path)
    assert read.count() == 12 and read.select("id").distinct().count() == 12
    out = warc_captures.assemble(read).collect()
    kinds = sorted((r.metadata[0].page_id or 0, r.response.record_type, r.response.record.refers_to_page, r.response.record.uri) for r in out)
    assert kinds == [(0, "revisit", 5, "http://c/")] * 2 + [(5, "response", None, "http://a/"), (5, "response", None, "http://b/")]


@pytest.mark.parametrize("copies", [1, 3])
def test_revisits_name_their_response_whatever_the_plan(spark, copies):
    body = lambda k: f"<p>{k} " + "words " * 300
    rows = [(k, f"http://t/{k}", body(k // 2)) for k in range(400)] + [(399, "http://t/399", body(199))] * (copies - 1) + [(1, "http://t/1b", body(0))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7, "url")  # not a plain scan
    path = scratch(spark, "warc-test")
    warc_captures.write_captures(pages, path)
    read = warc_captures.read_records(spark, path)
    assert read.count() == 3 * len(rows) == read.select("id").distinct().count()
    out = warc_captures.assemble(read).collect()
    assert len(out) == len(rows)
    for r in out:
        page = r.metadata[0].page_id
        assert (r.response.record_type, r.response.record.refers_to_page) == (("revisit", page + 1) if page % 2 == 0 else ("response", None))


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc_captures, "FILE_BYTES", 400_000)
    rng = random.Random(1)
    rows = [(k, "http://t/", "".join(rng.choices("abcdefgh ", k=200_000 if k % 50 == 0 else 100))) for k in range(300)]
    warc_captures.write_captures(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    sizes = [sum(len(b) for _, b in warc_captures.records(p.read_bytes())) for p in (tmp_path / "w").glob("*.gz")]
    assert sum(sizes) > 1_200_000 and max(sizes) < 700_000


def test_many_members_are_read_in_linear_time():
    member = gzip.compress(b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 5\r\n\r\nshort\r\n\r\n")
    began = time.process_time()
    assert sum(1 for _ in warc_captures.records(member * 40_000)) == 40_000
    assert time.process_time() - began < 20


def test_every_rule_says_what_its_contract_says(spark, tmp_path):
    urls = {"http://a.com/en/1": ("com/en/", "block"), "http://m.example.com/en/71": ("example.com/en/7", "allow"), "http://x.net/de/1": ("net/de/", "allow"), "http://example.net/de/81": ("example.net/de/8", "block"), "http://org/es/": ("org/es/", "block")}
    spark.createDataFrame([(k, u, "") for k, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = url_filter.op6_url_filter(spark, str(tmp_path)).collect()
    assert {r.page_id: (r.rule, r.verdict) for r in found} == dict(enumerate(urls.values()))
