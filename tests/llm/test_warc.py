"""Archives: round trip, revisits, look-ups."""

import gzip
import hashlib

import pytest

from stmtwatch.llm import warc

LONG = "<p>é</p>" * 300
PAGES = [
    (1, "http://www.Example.org/a", LONG), (2, "http://www.example.org/b?q=1", LONG), (5, "https://example.org:8443/", LONG + "x"),
    (3, None, "short"), (4, "not a url\r\nX: y", "short"), (6, "http://b.com/", None), (None, "http://b.com/", ""),
    (7, "http://b.com/", LONG + "x"), (7, "http://b.com/", LONG + "x"),
]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    return warc.write_archive(pages, str(tmp_path_factory.mktemp("warc") / "a"), block_captures=2)


def test_round_trip(spark, archive):
    rows = warc.read_archive(spark, archive, with_payload=True).collect()
    got = sorted((r.page_id or "", r.record_type, r.refers_to or "", r.payload_bytes, r.payload_digest) for r in rows)
    want = []
    for page, _, html in PAGES:
        data = (html or "").encode()
        first = {1: 2, 5: 7}.get(page)
        want.append((str(page or ""), "revisit" if first else "response", str(first or ""), len(data), hashlib.sha1(data).hexdigest()))
    assert got == sorted(want)
    assert {r.payload.decode() for r in rows if r.page_id == "2"} == {LONG}


def test_members_can_be_read_one_by_one(spark, archive):
    system, path = warc.filesystem(archive + "/records")
    for info in system.get_file_info(warc.pafs.FileSelector(path)):
        with open(info.path, "rb") as file:
            assert gzip.decompress(file.read()).startswith(b"WARC/1.1\r\nWARC-Type: ")


def test_lookup(spark, archive):
    asked = ["http://b.com/", "http://www.example.org/A", "http://nowhere.net/", None]
    rows = warc.lookup(spark.createDataFrame([(a,) for a in asked], "url string"), archive).collect()
    assert sorted((r.wanted, r.page_id or "") for r in rows) == [
        ("http://b.com/", ""), ("http://b.com/", "6"), ("http://b.com/", "7"), ("http://b.com/", "7"),
        ("http://www.example.org/A", "1"),
    ]


def test_lookup_of_a_twentieth(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archive = warc.write_archive(pages, block_captures=7)
    asked = pages.filter("page_id % 20 = 0")
    found = {int(r.page_id) for r in warc.lookup(asked, archive).collect()}
    keys = {warc.url_key(r.url) for r in asked.collect()}
    assert found == {r.page_id for r in pages.collect() if warc.url_key(r.url) in keys}


def test_keys():
    assert warc.url_key("http://www.example.org/B?X") == "org,example,www)/b?x"
    assert warc.url_key(None) == "" and warc.url_key("http://[bad") == "http://[bad"


def test_empty(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    archive = warc.write_archive(pages, str(tmp_path / "a"))
    assert warc.read_archive(spark, archive).count() == 0
