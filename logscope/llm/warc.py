"""WARC archives as a Spark data source, written and read in parallel.

Writing: every task writes its own archives under names no other attempt has, and the commit lists
the finished ones, their sizes and a record offset for every ``SPLIT_BYTES`` in one manifest. Files of
lost or repeated attempts are not in it, so readers never see them.

Reading: file ranges from the manifest (whole files where there is none) are packed into partitions of
about ``split_bytes``. Spark's filters on the record type and on other header columns are pushed down:
a record's headers are parsed first, and unless all predicates hold its block is skipped by its
Content-Length, neither read nor decoded. With ``payload=false`` blocks are read up to the end of their HTTP head only.

Of equal payloads one record holds the bytes ("response"), the others name it ("revisit") and keep the HTTP head, whose
Content-Length and the record's WARC-Payload-Digest state the full payload.

Paths are anything that ``pyarrow.fs`` opens (a shared folder, s3://, hdfs://, gs://).

Defined cases: null text is an empty payload, so all empty payloads are one group; a null id counts as greater than any other and is
read back as null; rows that share the smallest id of a group are each a response; a null URL leaves its header out; control
characters in header values are percent-encoded; an empty table writes a manifest without files, read as no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In,
                                    InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage)

from logscope.session import ensure_checkpoint_dir, materialise, ship_package

SCHEMA = ("record_id string, warc_type string, warc_date string, target_uri string, content_type string, content_length long, "
          "payload_digest string, refers_to string, http_status int, payload_length long, payload binary, digest_ok boolean, path string, offset long")
ARROW = pa.schema([("record_id", pa.string()), ("warc_type", pa.string()), ("warc_date", pa.string()), ("target_uri", pa.string()),
                   ("content_type", pa.string()), ("content_length", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()),
                   ("http_status", pa.int32()), ("payload_length", pa.int64()), ("payload", pa.binary()), ("digest_ok", pa.bool_()),
                   ("path", pa.string()), ("offset", pa.int64())])
HEADERS = {"record_id": "warc-record-id", "warc_type": "warc-type", "warc_date": "warc-date", "target_uri": "warc-target-uri",
           "content_type": "content-type", "content_length": "content-length", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
MANIFEST = "_manifest.json"
SPLIT_BYTES = 16 << 20
FILE_BYTES = 1 << 30
HEAD_LIMIT = 1 << 20
BATCH_BYTES = 8 << 20
NO_DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    local = re.sub(r"^file:/+", "/", path)
    if local.startswith("/"):
        return pafs.LocalFileSystem(), local
    return pafs.FileSystem.from_uri(path)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- records ------------------------------------------------------------------------------------


def _value(text: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def encode_record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record: version, headers (nulls left out), an empty line, the block, two line ends."""
    lines = ["WARC/1.1", *(f"{k}: {_value(v)}" for k, v in headers if v is not None), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def page_record(row: dict) -> bytes:
    """A response or revisit record of one row (record_id, warc_type, target_uri, warc_date, payload, payload_digest, payload_length, refers_to)."""
    revisit = row["warc_type"] == "revisit"
    payload = b"" if revisit else row["payload"] or b""
    length = row["payload_length"] if revisit else len(payload)
    digest = row["payload_digest"] if revisit else base32_sha1(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    return encode_record([
        ("WARC-Type", row["warc_type"]), ("WARC-Record-ID", f"<{row['record_id']}>"), ("WARC-Date", row["warc_date"] or NO_DATE),
        ("WARC-Target-URI", row["target_uri"]), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Refers-To", f"<{row['refers_to']}>" if revisit else None), ("WARC-Profile", REVISIT if revisit else None),
        ("Content-Type", "application/http;msgtype=response")], head + payload)


def read_headers(f) -> dict[str, str] | None:
    """The headers of the record that begins here, names in lower case; None at the end of the file."""
    line = f.readline(HEAD_LIMIT)
    while line in (b"\r\n", b"\n"):
        line = f.readline(HEAD_LIMIT)
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record here: {line[:40]!r}")
    out, name = {}, None
    while (line := f.readline(HEAD_LIMIT)) not in (b"\r\n", b"\n", b""):
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and name:  # a folded line
            out[name] += " " + text.strip()
        else:
            name, _, value = text.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _columns(h: dict[str, str]) -> dict:
    """Header columns of a record."""
    row = {c: h.get(name) for c, name in HEADERS.items()}
    for c in ("record_id", "refers_to"):
        if row[c] is not None:
            row[c] = row[c].removeprefix("<").removesuffix(">")
    row["content_length"] = int(row["content_length"] or 0)
    if row["payload_digest"] is not None:
        row["payload_digest"] = row["payload_digest"].removeprefix("sha1:")
    return row


def _skip(f, n: int) -> None:
    if isinstance(f, gzip.GzipFile):
        while n > 0 and (got := len(f.read(min(n, 1 << 20)))):
            n -= got
    else:
        f.seek(n, io.SEEK_CUR)


def _block(f, row: dict, want_payload: bool, verify: bool) -> dict:
    """The rest of a record that is wanted: HTTP head, payload, and whether the payload has the stated digest."""
    left = row["content_length"]
    out = {"http_status": None, "payload_length": left, "payload": None, "digest_ok": None}
    head_end = False
    if (row["content_type"] or "").replace(" ", "").startswith("application/http"):
        first, length, used = True, None, 0
        while left > 0:
            line = f.readline(min(left, HEAD_LIMIT))
            left -= len(line)
            used += len(line)
            if not line:
                break
            if first and (m := re.match(rb"HTTP/\S+ +(\d{3})", line)):
                out["http_status"] = int(m[1])
            elif m := re.match(rb"(?i)content-length:\s*(\d+)\s*$", line):
                length = int(m[1])
            first = False
            if line in (b"\r\n", b"\n"):
                head_end = True
                break
        out["payload_length"] = length if row["warc_type"] == "revisit" and length is not None else left
    if row["warc_type"] == "revisit" and head_end:
        _skip(f, left)
    elif want_payload:
        out["payload"] = f.read(left)
        if verify and row["payload_digest"] is not None:
            out["digest_ok"] = base32_sha1(out["payload"]) == row["payload_digest"]
    else:
        _skip(f, left)
    return out


# --- predicates ---------------------------------------------------------------------------------

_COMPARE = {GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b,
            LessThanOrEqual: lambda a, b: a <= b, EqualTo: lambda a, b: a == b, In: lambda a, b: a in b,
            StringStartsWith: lambda a, b: a.startswith(b)}


def pushable(f: Filter) -> bool:
    """Whether a filter can be decided on a record's headers: a comparison of one header column (text in Spark's order is UTF-8 order)."""
    return isinstance(f, (*_COMPARE, IsNull, IsNotNull)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS


def holds(filters: list[Filter], row: dict) -> bool:
    """Whether the headers fulfil all filters (a comparison with null does not hold)."""
    for f in filters:
        v = row[f.attribute[0]]
        if isinstance(f, IsNull):
            ok = v is None
        elif isinstance(f, IsNotNull):
            ok = v is not None
        else:
            ok = v is not None and f.value is not None and _COMPARE[type(f)](v, f.value)
        if not ok:
            return False
    return True


# --- the data source ----------------------------------------------------------------------------


class WarcFiles(InputPartition):
    """Ranges (path, first byte, end or None) that one task reads."""

    def __init__(self, ranges: list[tuple[str, int, int | None]]) -> None:
        super().__init__(None)
        self.ranges = ranges


class WarcCommit(WriterCommitMessage):
    def __init__(self, files: list[dict]) -> None:
        self.files = files


class WarcSource(DataSource):
    """``format("warc")``. Read options: ``payload`` (true), ``verify`` (true: compare payloads with their digests),
    ``split_bytes``. Write options: ``compression`` (none, or gzip: a member for each record), ``file_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "true").lower() == "true"
        self.split_bytes = int(options.get("split_bytes", 64 << 20))
        self.filters: list[Filter] = []

    def pushFilters(self, filters):
        for f in filters:
            if pushable(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[WarcFiles]:
        fs, root = open_fs(self.path)
        pieces = []
        if fs.get_file_info(f"{root}/{MANIFEST}").type == pafs.FileType.File:
            with fs.open_input_file(f"{root}/{MANIFEST}") as f:
                listed = json.loads(f.read())
            for x in listed:
                cuts = [*x["offsets"], x["size"]]
                gz = x["name"].endswith(".gz")
                pieces += [(x["name"], 0, None, x["size"])] if gz else [(x["name"], a, b, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
        else:
            info = fs.get_file_info(root)
            found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True))
            pieces = [(x.path, 0, None, x.size) for x in sorted(found, key=lambda x: x.path)
                      if x.type == pafs.FileType.File and re.search(r"\.warc(\.gz)?$", x.path)]
        out, size = [], 0
        for name, a, b, n in pieces:
            if not out or size + n > self.split_bytes:
                out.append([])
                size = 0
            size += n
            if out[-1] and out[-1][-1][0] == name and out[-1][-1][2] == a:
                out[-1][-1] = (name, out[-1][-1][1], b)
            else:
                out[-1].append((name, a, b))
        return [WarcFiles(r) for r in out] or [WarcFiles([])]

    def read(self, partition: WarcFiles) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(self.path)
        rows, size = [], 0
        for name, start, end in partition.ranges:
            with fs.open_input_file(name if name.startswith("/") or "/" in name else f"{root}/{name}") as raw:
                f = gzip.GzipFile(fileobj=io.BufferedReader(raw, 1 << 20)) if name.endswith(".gz") else io.BufferedReader(raw, 1 << 20)
                f.seek(start)
                while end is None or f.tell() < end:
                    at = f.tell()
                    h = read_headers(f)
                    if h is None:
                        break
                    row = _columns(h)
                    if not holds(self.filters, row):
                        _skip(f, row["content_length"] + 4)
                        continue
                    row |= _block(f, row, self.payload, self.verify)
                    _skip(f, 4)
                    rows.append({**row, "path": name, "offset": at})
                    size += 500 + len(row["payload"] or b"")
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.gz = options.get("compression", "none") == "gzip"
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WarcCommit:
        fs, root = open_fs(self.path)
        fs.create_dir(root)
        files, f = [], None
        for batch in iterator:
            for row in batch.to_pylist():
                if f is not None and files[-1]["size"] >= self.file_bytes:
                    f.close()
                    f = None
                if f is None:
                    files.append({"name": f"{uuid.uuid4().hex}.warc{'.gz' if self.gz else ''}", "size": 0, "offsets": [0], "records": 0})
                    f = fs.open_output_stream(f"{root}/{files[-1]['name']}", compression=None, buffer_size=1 << 20)
                    info = encode_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", NO_DATE),
                                          ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    self._put(f, files[-1], info)
                self._put(f, files[-1], page_record(row))
        if f is not None:
            f.close()
        return WarcCommit(files)

    def _put(self, f, entry: dict, record: bytes) -> None:
        if entry["size"] - entry["offsets"][-1] >= SPLIT_BYTES:
            entry["offsets"].append(entry["size"])
        data = gzip.compress(record, 6, mtime=0) if self.gz else record
        f.write(data)
        entry["size"] += len(data)
        entry["records"] += 1

    def commit(self, messages) -> None:
        fs, root = open_fs(self.path)
        fs.create_dir(root)
        with fs.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps([x for m in messages if m is not None for x in m.files]).encode())


def register(spark: SparkSession) -> None:
    """Make ``format("warc")`` known to the session, with filter pushdown for Python data sources on."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_warc(spark: SparkSession, path: str, payload: bool = True, verify: bool = True) -> DataFrame:
    """Records of the archives under a path. Filter on header columns to skip the blocks of other records."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload)).option("verify", str(verify)).load(path)


def page_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """A record for each page: of equal payloads (SHA-1) of at least ``min_bytes`` bytes the one with the smallest id is a response, the others
    are revisits of it and carry no payload."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"),
                     F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("payload_length", F.octet_length("payload").cast("long")).withColumn("_sha", F.unhex(F.sha1("payload")))
    large = F.col("payload_length") >= min_bytes
    groups = materialise(p.where(large).groupBy("_sha").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
                         .where("_n > 1 and _first is not null").drop("_n"))
    p = p.join(groups.withColumnRenamed("_sha", "_s"), large & (F.col("_sha") == F.col("_s")), "left")
    again = F.col("_first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("_first")))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    return p.select(urn(F.col("page_id")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("warc_type"), "target_uri",
                    F.lit(None).cast("string").alias("warc_date"), F.when(~again, F.col("payload")).alias("payload"),
                    _base32(F.col("_sha")).alias("payload_digest"), "payload_length", F.when(again, urn(F.col("_first"))).alias("refers_to"))


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _base32(sha):
    """Base32 of 20 bytes: eight groups of 20 bits, four letters each."""
    def group(i):
        bits = F.conv(F.substring(F.hex(sha), 5 * i + 1, 5), 16, 10).cast("int")
        return [F.substring(F.lit(_ALPHABET), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*[c for i in range(8) for c in group(i)])


def write_warc(records: DataFrame, path: str, compression: str = "none") -> None:
    """Write records as made by ``page_records`` into archives under a new path."""
    register(records.sparkSession)
    records.write.format("warc").mode("append").option("compression", compression).save(path)


def through_archives(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write every page as a record into archives in the shared checkpoint folder and read them back:
    ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``; a payload that lost its digest is an error."""
    spark = pages.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/logscope-{uuid.uuid4().hex}"
    write_warc(page_records(pages, min_bytes), path)
    r = read_warc(spark, path).where(F.col("warc_type").isin("response", "revisit"))
    page = lambda c: F.expr(f"try_cast(nullif(substr({c}, 10), '') as long)")
    digest = F.when(F.col("digest_ok") == F.lit(False), F.raise_error(F.concat(F.lit("payload differs from its digest: "), "record_id")).cast("string"))
    return r.select(page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"),
                    F.coalesce(digest, "payload_digest").alias("payload_digest"), F.col("warc_type").alias("record_type"), page("refers_to").alias("refers_to"))


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('{_ALPHABET}',
         CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id > first OR (page_id IS NULL AND first IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first OR (page_id IS NULL AND first IS NOT NULL) THEN first END AS refers_to
FROM m
"""
