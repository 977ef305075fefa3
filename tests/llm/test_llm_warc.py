"""WARC archives: round trip, predicates, skipped blocks, revisits, foreign and compressed files."""

import gzip
import io
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNull, Not, StringStartsWith

from logscope.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, path string"


def brute(rows, min_bytes=0):
    first = {}
    for i, _, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = []
    for i, _, t, *_ in rows:
        p = (t or "").encode()
        f = first.get(t or "") if len(p) >= min_bytes else None
        again = f is not None and (i is None or i > f)
        out.append((i, len(p), warc.base32_sha1(p), "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = ["", None, "hot page", "é😀\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n", "\x00\x01 odd", "x" * 300_000, "HTTP/1.1 200 OK\r\n\r\n"]
    out = [(rng.choice([rng.randrange(500), None]), rng.choice([None, "http://a.example/é", "bad\r\nWARC-Type: x"]),
            rng.choice([*texts, "hot page", f"page {k}"]), "p", "q") for k in range(300)]
    return out + out[:20]


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_round_trip(spark, rows, min_bytes):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in warc.through_archives(df, min_bytes).collect()), key=str)
    assert got == brute(rows, min_bytes)


def test_empty_table(spark):
    assert warc.through_archives(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_pushdown_and_payloads(spark, tmp_path, compression):
    rows = [(i, f"http://h{i % 3}.example/{i}", "same" if i % 2 else f"text {i}", "", "") for i in range(60)]
    path = f"file://{tmp_path}/a"
    warc.write_warc(warc.page_records(spark.createDataFrame(rows, SCHEMA).repartition(3)), path, compression)
    df = warc.read_warc(spark, path).where((F.col("warc_type") == "response") & F.col("target_uri").startswith("http://h1."))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and ") Filter" not in plan  # all predicates went to the reader
    got = {r["record_id"]: bytes(r["payload"]).decode() for r in df.collect()}
    assert got == {f"urn:page:{i}": t for i, u, t, *_ in rows if u.startswith("http://h1.") and (t != "same" or i == 1)}
    again = warc.read_warc(spark, path, payload=False).where("warc_type = 'revisit'").collect()
    assert len(again) == 29 and all(r["refers_to"] == "urn:page:1" and r["payload"] is None and r["payload_length"] == 4 for r in again)
    assert warc.read_warc(spark, path).where("warc_type = 'warcinfo'").count() >= 1


def test_rejected_blocks_are_not_read(tmp_path):
    """The reader seeks over the block of a record whose headers fail a predicate."""
    big = b"y" * (8 << 20)
    with open(tmp_path / "x.warc", "wb") as f:
        for kind in ("metadata", "resource", "metadata"):
            f.write(warc.encode_record([("WARC-Type", kind), ("WARC-Record-ID", f"<{kind}>")], b"small" if kind == "resource" else big))
    reader = warc.WarcReader({"path": str(tmp_path)})
    left = list(reader.pushFilters([EqualTo(("warc_type",), "resource"), Not(IsNull(("warc_type",))), GreaterThan(("payload_length",), 3)]))
    assert len(left) == 2 and len(reader.filters) == 1
    parts = reader.partitions()
    read = []

    class Counting(io.BufferedReader):
        def read(self, n=-1):
            read.append(n)
            return super().read(n)
    old, warc.io.BufferedReader = warc.io.BufferedReader, Counting
    try:
        rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    finally:
        warc.io.BufferedReader = old
    assert [r["payload"] for r in rows] == [b"small"] and sum(read) < 1000


def test_predicates():
    row = {"warc_type": "response", "target_uri": None, "content_length": 7}
    assert warc.holds([In(("warc_type",), ("response", "revisit")), GreaterThan(("content_length",), 6), IsNull(("target_uri",))], row)
    assert not warc.holds([StringStartsWith(("target_uri",), "h")], row) and not warc.holds([EqualTo(("warc_type",), None)], row)


def test_foreign_files_folded_headers_and_lost_attempts(spark, tmp_path):
    folder = tmp_path / "f"
    folder.mkdir()
    record = b"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <urn:x:1>\r\nWARC-Target-URI: http://a\r\n /b\r\nContent-Type: application/http; msgtype=response\r\n"
    block = b"HTTP/1.1 404 Not Found\nX: y\n\nbody"
    record += b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    (folder / "one.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record))
    (folder / "two.warc").write_bytes(record)
    rows = warc.read_warc(spark, str(folder)).collect()
    assert [(r["target_uri"], r["http_status"], bytes(r["payload"])) for r in rows] == [("http://a /b", 404, b"body")] * 3
    (folder / warc.MANIFEST).write_text(json.dumps([{"name": "two.warc", "size": len(record), "offsets": [0], "records": 1}]))
    assert warc.read_warc(spark, str(folder)).count() == 1  # files outside the manifest belong to lost attempts


def test_splits_cover_each_record_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SPLIT_BYTES", 2000)
    w = warc.WarcWriter({"path": str(tmp_path / "s"), "file_bytes": "20000"})
    row = {"warc_type": "response", "warc_date": None, "target_uri": None, "payload_digest": None, "payload_length": 0, "refers_to": None}
    batch = warc.pa.RecordBatch.from_pylist([{**row, "record_id": str(i), "payload": b"z" * (i % 700)} for i in range(300)])
    w.commit([w.write(iter([batch])), None])
    r = warc.WarcReader({"path": str(tmp_path / "s"), "split_bytes": "5000"})
    parts = r.partitions()
    got = [x["record_id"] for p in parts for b in r.read(p) for x in b.to_pylist() if x["warc_type"] == "response"]
    assert len(parts) > 20 and sorted(got, key=int) == [str(i) for i in range(300)]


def test_changed_payload_is_found(tmp_path):
    data = warc.page_record({"record_id": "1", "warc_type": "response", "warc_date": None, "target_uri": None, "payload": b"right", "payload_digest": None,
                             "payload_length": 5, "refers_to": None})
    (tmp_path / "x.warc").write_bytes(data.replace(b"right", b"wrong"))
    r = warc.WarcReader({"path": str(tmp_path / "x.warc")})
    rows = [x for p in r.partitions() for b in r.read(p) for x in b.to_pylist()]
    assert rows[0]["digest_ok"] is False
