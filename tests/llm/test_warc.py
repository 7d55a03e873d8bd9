import gzip
import hashlib
import zlib
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from parlance.llm import warc
from parlance.llm.queries import ORACLE_SQL, op13_warc
from parlance.llm.warc import page_digests, read_index, read_records, spans, write_archives
from tests import oracle

PAGE = "<p>é漢 same page</p>\r\n\r\n" * 10


def pages(spark):
    rows = [
        (7, "http://a/7", PAGE), (3, "http://a/3", PAGE), (5, None, PAGE), (None, "http://a/n", PAGE), (3, "http://a/again", PAGE), (1, "http://a/1", "x" * 99), (2, "http://a/2", "x" * 99),
        (4, "http://a/ 4\r\nWARC-Type: x", "y" * 100), (6, "", "y" * 100), (8, "http://a/8", None), (9, "http://a/9", ""), (10, "http://a/10", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9), (11, None, "z" * 3_000_000),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({x: F.lit(x) for x in ("file", "offset", "length", "digest", "payload", "record_id", "salt", "first_record")})


def test_equals_sql(spark, sf):
    oracle.same(op13_warc(spark, sf), oracle.connect(sf), ORACLE_SQL["op13_warc"])


@pytest.mark.parametrize("broadcast", [0, 50_000])
def test_awkward(spark, broadcast, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", broadcast)
    df = pages(spark)
    path = write_archives(df)
    rows = page_digests(spark, path).collect()
    digest = hashlib.sha256(PAGE.encode()).hexdigest()
    same = [r for r in rows if r["payload_digest"] == digest]
    assert len(rows) == df.count() and len(same) == 5
    assert {r["payload_bytes"] for r in same} == {len(PAGE.encode())}
    assert sorted((r["record_type"], r["refers_to"] or 0) for r in same) == [("response", 0), *[("revisit", 3)] * 4]
    assert next(r["page_id"] for r in same if r["record_type"] == "response") == 3
    assert {r["page_id"]: (r["record_type"], r["refers_to"]) for r in rows if r["page_id"] in (1, 2, 4, 6, 8, 9, 10, 11)} == {i: ("revisit", 4) if i == 6 else ("response", None) for i in (1, 2, 4, 6, 8, 9, 10, 11)}
    assert page_digests(spark, write_archives(df.limit(0))).count() == 0


def test_payloads_and_urls_come_back(spark):
    df = pages(spark)
    path = write_archives(df, level=1)
    want = {(r["page_id"], r["url"]): (r["html"] or "").encode() for r in df.collect()}
    found = read_records(spark, path).collect()
    index = {r["record_id"]: r for r in read_index(spark, path).collect()}
    assert len(found) == len(index) == len(want)
    for r in found:
        url = index[r["record_id"]]["url"]
        assert url == r["url"] or (r["page_id"], r["url"]) == (4, "http://a/%204%0D%0AWARC-Type:%20x")
        assert r["record_type"] == "revisit" or bytes(r["payload"]) == want[r["page_id"], url]
        assert r["stated_bytes"] == len(want[r["page_id"], url]) and r["stated_digest"] == hashlib.sha256(want[r["page_id"], url]).hexdigest()
    one = read_records(spark, path, read_index(spark, path).filter("page_id in (1, 11)")).collect()
    assert sorted(r["page_id"] for r in one) == [1, 11] and read_records(spark, path, read_index(spark, path).limit(0)).count() == 0


def test_files_are_gzip_members_and_whole_archives(spark, tmp_path):
    """A plain reader of the whole files meets the records of the index where it says, and no other files are there."""
    path = write_archives(pages(spark).coalesce(2), f"file://{tmp_path}/out", file_bytes=500)
    (tmp_path / "out/archive/part-9-lost.warc.gz").write_bytes(b"half")
    warc._sweep(spark, path)
    index = read_index(spark, path).collect()
    files = {p.name: p.read_bytes() for p in Path(urlparse(path).path, "archive").iterdir()}
    assert set(files) == {r["file"] for r in index} and len(files) > 3
    assert all(gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") for data in files.values())
    for r in index:
        data = zlib.decompress(files[r["file"]][r["offset"] : r["offset"] + r["length"]], 31)
        assert warc.parsed(data)[0] == r["record_id"] and data.endswith(b"\r\n\r\n")
    assert sum(gzip.decompress(x).count(b"\r\nWARC-Record-ID: ") for x in files.values()) == len(index) + len(files)


def test_damage_is_an_error(spark, tmp_path):
    path = write_archives(pages(spark).coalesce(1), f"file://{tmp_path}/out")
    row = read_index(spark, path).filter("page_id = 10").first()
    file = tmp_path / "out/archive" / row["file"]
    data = bytearray(file.read_bytes())
    data[row["offset"] + 40] ^= 255
    file.write_bytes(data)
    with pytest.raises(PythonException):
        page_digests(spark, path).collect()


def test_spans():
    rows = [("a", 0, 10), ("a", 12, 8), ("a", 40, 5), ("b", 0, 4), ("b", 4, 100), ("b", 104, 1)]
    assert list(spans(rows, 5, 101)) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    assert list(spans([], 5, 101)) == [] and list(spans(rows[:1])) == [(0, 1)]
