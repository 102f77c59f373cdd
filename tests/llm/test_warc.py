import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from hitlytics.llm import warc

BIG, TRAP = "payload " * 30, "x" * 120 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc"
ROWS = [(1, "http://a/", BIG), (2, "http://b/\r\nX: y", BIG), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", TRAP), (8, "ü", TRAP),
        (None, "n", BIG), (9, "é", "日本\r\n\r\n" * 40), (1, "again", BIG), (10, "long", "z" * 2_000_000), (None, None, "only null " * 20)]
PAGES = "page_id long, url string, html string, type string, record_id string, digest string, first long"


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*r, "t", "r", "d", 1) for r in ROWS], PAGES)


def brute(rows):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        first = min(same) if same and len(data) >= 100 else None
        again = first is not None and page != first
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return out


def captured(found):
    f = F.col("metadata.fields")
    return [tuple(r) for r in found.select(f["page-id"].cast("long"), f["payload-bytes"].cast("long"), F.coalesce("computed", "digest"), "type", F.col("refers_to").cast("long")).collect()]


def test_round_trip_equals_brute_force(spark, pages, tmp_path):
    found = warc.captures(pages, str(tmp_path / "w"))
    assert sorted(map(repr, captured(found))) == sorted(map(repr, brute(ROWS)))
    payloads = {r[0]: r[1] for r in found.filter("type = 'response'").select(F.col("metadata.fields")["page-id"], "payload").collect()}
    assert payloads["7"] == TRAP and payloads["9"] == ROWS[9][2] and payloads["3"] == ""
    assert found.filter("request is null or computed != digest").count() == 0


def test_archives_are_split_and_valid(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_RECORDS", 6)
    pages = spark.createDataFrame([(n, "u", f"page {n} " * 40, "t", "r", "d", 1) for n in range(20)], PAGES).coalesce(1)
    warc.write(pages, str(tmp_path / "w"))
    files = list((tmp_path / "w").glob("*.gz"))
    assert len(files) == 10
    kinds = [h["warc-type"] for f in files for h, _ in warc.parse(f.read_bytes())]
    assert sorted(set(kinds)) == ["metadata", "request", "response"] and len(kinds) == 60


def test_several_members_and_damage():
    record = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    assert [b for _, b in warc.parse(gzip.compress(record) + gzip.compress(record))] == [b"hi", b"hi"]
    with pytest.raises(ValueError):
        list(warc.parse(record[:-6]))
    with pytest.raises(ValueError):
        list(warc.parse(b"no archive"))


def test_empty_table_and_missing_companions(spark, pages, tmp_path):
    assert warc.captures(pages.limit(0), str(tmp_path / "e")).count() == 0
    warc.write(pages, str(tmp_path / "p"))
    lone = warc.transactions(warc.read(spark, str(tmp_path / "p")).filter("type not in ('request', 'metadata')"))
    assert lone.count() == len(ROWS) and lone.filter("request is null and metadata is null").count() == len(ROWS)
