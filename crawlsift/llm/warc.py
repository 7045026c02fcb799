"""Legacy ARC archives, versions 1 and 2, converted to WARC."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlsift.llm import common
from crawlsift.sources import io

# Fixed values of the formats: the field lines of both ARC versions.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
NO_PAGE = "-"
OUT_BATCH = 4 << 20
# An HTTP message's headers end at its first empty line; old servers and crawlers also wrote bare newlines.
HEAD_END = re.compile(rb"\r?\n\r?\n")
# An address, the digits of a date, and what follows: tells where the URL ends if it holds blanks.
BEHIND_URL = re.compile(r" (\S+) (\d{4,17}) ")
# Addresses that say nothing of where a record came from.
NO_IP = ("", "-", "0.0.0.0")
# Records of an archive, as the conversion sees them. `block` is the HTTP message.
RECORD = "page string, uri string, ip string, date string, mime string, kind string, block binary, digest string, payload_bytes bigint"


def base32_sha1(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _emit(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of rows of a few MB."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str | bytes))
        if size > OUT_BATCH:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in held], schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in held], schema)


VALUE = pa.schema([("value", pa.binary())])


def _write_records(records: DataFrame, path: str) -> None:
    """Write binary rows one after another, each followed by a newline that belongs to its record; one gzip file per task."""
    records.select(F.col("value").cast("string").alias("value")).write.options(
        **{"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}).text(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of gzip files: a file is never split and its lines come in order, so a task streams records of any size."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))


class Reader:
    """Bytes of the archives of a task, by line and by length."""

    def __init__(self, batches: Iterator[pa.RecordBatch]) -> None:
        self.rows = ((f, v) for b in batches for f, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        self.file, self.rest = "", b""

    def line(self) -> bytes | None:
        """The next line without its newline; None at the end."""
        row = next(self.rows, None)
        if row is None:
            return None
        self.file = row[0]
        return row[1]

    def take(self, length: int) -> tuple[bytes, bytes]:
        """Whole lines that hold `length` bytes at least: those bytes, and what follows on the last line."""
        parts, size = [], 0
        while size < length:
            line = self.line()
            if line is None:
                raise ValueError(f"{self.file} ends inside a record")
            parts += [line, b"\n"]
            size += len(line) + 1
        data = b"".join(parts)
        return data[:length], data[length:]


def write_arc(pages: DataFrame, path: str, date: str = "19970101000000") -> None:
    """Write pages as ARC files, one per task, versions 1 and 2 in turn: the legacy archives that the converter reads.

    A network document is an HTTP response with the html in UTF-8 (null: empty) as its body; the page id travels as a header
    of it. White space and other bytes that a header line can't hold are percent-encoded in URLs; a null URL is `unknown:`.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version = 1 + TaskContext.get().partitionId() % 2
        name = f"pages-{TaskContext.get().partitionId():06}.arc"

        def rows() -> Iterator[tuple[bytes]]:
            body = f"{version} 0 crawlsift\n{FIELDS[version]}\n".encode()
            first = [f"filedesc://{name}", "0.0.0.0", date, "text/plain", *(["200", "-", "-", "0", name] if version == 2 else []), str(len(body))]
            yield (" ".join(first).encode() + b"\n" + body,)
            for whole in batches:
                for batch in common.sliced(whole, 2):
                    for page, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), common.texts(batch.column(2)), strict=True):
                        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {NO_PAGE if page is None else page}\r\n"
                        block = f"{head}Content-Length: {len(html)}\r\n\r\n".encode() + html
                        uri = quote(url, safe="!#$%&'()*+,/:;=?@[]~-._") if url else "unknown:"
                        extra = ["200", base32_sha1(html), "-", "0", name] if version == 2 else []
                        yield (" ".join([uri, "0.0.0.0", date, "text/html", *extra, str(len(block))]).encode() + b"\n" + block,)

        yield from _emit(rows(), VALUE)

    _write_records(common.small_batches(pages).select(F.col("page_id").cast("string"), "url", "html").mapInArrow(run, "value binary"), path)


def _body(block: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of an HTTP message; a block of another kind is its own payload."""
    if not block.startswith(b"HTTP/"):
        return {}, block
    end = _head_size(block)
    pairs = (x.partition(":") for x in block[:end].decode("utf-8", "replace").split("\n")[1:] if x.strip())
    return {name.strip().lower(): value.strip() for name, _, value in pairs}, block[end:]


def _head_size(block: bytes) -> int:
    """Bytes of an HTTP message up to its payload; all of them where no empty line follows the headers."""
    found = HEAD_END.search(block)
    return found.end() if found else len(block)


def header_values(line: str, fields: list[str]) -> list[str]:
    """Values of an ARC header line. Only the URL, its first, may hold blanks, and the media type where the rest is unambiguous."""
    values = line.rsplit(" ", len(fields) - 1)
    if fields == FIELDS[1].split(" ") and not (len(values) == 5 and values[2].isdigit()) and (found := BEHIND_URL.search(line)):
        mime, _, length = line[found.end():].rpartition(" ")
        values = [line[:found.start()], *found.groups(), mime, length]
    return values


def iso_date(date: str) -> str:
    """ARC's digits as a WARC date; archives before version 2 also have dates without seconds or time of day."""
    digits = (date if date.isdigit() else "").ljust(8, "0")[:14].ljust(14, "0")
    month, day = max(digits[4:6], "01"), max(digits[6:8], "01")
    return f"{digits[:4]}-{month}-{day}T{digits[8:10]}:{digits[10:12]}:{digits[12:]}Z"


def arc_records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Records of ARC files. The version block names the version and so the fields of the header lines that follow."""
    reader, file, fields = Reader(batches), "", FIELDS[1].split(" ")
    while (line := reader.line()) is not None:
        if not line.strip():
            continue
        if reader.file != file:
            file = reader.file
            if not line.startswith(b"filedesc://"):
                raise ValueError(f"{file} has no version block")
            length = int(line.rsplit(b" ", 1)[1])
            block, _ = reader.take(length)
            version = int(block.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"{file} has unknown version {version}")
            fields = block.split(b"\n")[1].decode().split(" ")
            continue
        values = header_values(line.decode("utf-8", "replace").rstrip("\r"), fields)
        if len(values) != len(fields):
            raise ValueError(f"{file} has a header line of {len(values)} fields, not {len(fields)}")
        record = dict(zip(fields, values, strict=True))
        block, rest = reader.take(int(record["Archive-length"]) + 1)  # a newline closes the record
        if rest or block[-1:] != b"\n":
            raise ValueError(f"{file} has a record of another length than declared")
        block = block[:-1]
        headers, payload = _body(block)
        page = headers.get("x-page-id", NO_PAGE)
        kind = "response" if headers or record["URL"].startswith("dns:") else "resource"
        yield (None if page == NO_PAGE else page, record["URL"], record["IP-address"], iso_date(record["Archive-date"]), record["Content-type"], kind, block,
               base32_sha1(payload), len(payload))


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """One row per ARC record, with the identity a WARC record needs."""
    schema = pa.schema([
        ("page", pa.string()), ("uri", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("mime", pa.string()), ("kind", pa.string()), ("block", pa.binary()),
        ("digest", pa.string()), ("payload_bytes", pa.int64())])
    return _lines(spark, path).mapInArrow(lambda batches: _emit(arc_records(batches), schema), RECORD)


def record_id(page: str | None, uri: str, date: str, digest: str) -> str:
    """The same identifier whenever the same record is converted."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, '|'.join([page or '', uri, date, digest]))}>"


def convert(spark: SparkSession, arc: str, warc: str, min_revisit_bytes: int = 0) -> None:
    """Write the records of ARC files as WARC files, gzip-compressed, one per task.

    Identifiers are derived from a record's content, dates become ISO 8601, types follow the block, digests are computed over
    the payload. Of records with equal payloads of `min_revisit_bytes` at least, that of the smallest page (rows without a page
    come last) is a response, the others are revisits that refer to it and hold only the HTTP headers. Rows that repeat that
    page are all responses, and so are rows without a page if no row of their payload has one.

    Equal payloads are found on narrow rows, combined before their shuffle. Only payloads that repeat are looked up, in a join
    that Spark may split where one payload is a third of all records.
    """
    records = read_arc(spark, arc)
    narrow = records.select("page", "uri", "date", "digest", "payload_bytes").where(F.col("payload_bytes") >= min_revisit_bytes)
    number = F.col("page").cast("bigint")
    repeated = io.store(narrow.groupBy("digest").agg(
        F.min(number).alias("first"), F.min_by(F.struct("uri", "date"), number).alias("named"), F.count("*").alias("n")).where("n > 1"))
    named = repeated.select(F.col("digest").alias("of"), "first", "named.uri", "named.date").toDF("of", "first", "first_uri", "first_date")
    joined = records.join(named, F.col("digest") == F.col("of"), "left").select(*records.columns, F.col("of").isNotNull().alias("repeats"), "first", "first_uri", "first_date")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"pages-{TaskContext.get().partitionId():06}.warc"
        yield from _emit(_warc_rows(batches, name), VALUE)

    _write_records(joined.mapInArrow(run, "value binary"), warc)


def _warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without its last newline, which the writer adds."""
    lines = [f"{k}: {v}" for k, v in [*headers, ("Content-Length", str(len(block)))]]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block + b"\r\n\r"


def _warc_rows(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[bytes]]:
    info = f"software: crawlsift\r\nformat: WARC file version 1.1\r\nfilename: {name}\r\n".encode()
    yield (_warc_record([
        ("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(NAMESPACE, name)}>"), ("WARC-Date", iso_date("19970101000000")),
        ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], info),)
    for batch in batches:
        for x in batch.to_pylist():
            revisit = x["repeats"] and x["first"] is not None and x["page"] != str(x["first"])
            headers = [
                ("WARC-Type", "revisit" if revisit else x["kind"]), ("WARC-Record-ID", record_id(x["page"], x["uri"], x["date"], x["digest"])),
                ("WARC-Date", x["date"]), ("WARC-Target-URI", x["uri"]), ("WARC-Payload-Digest", f"sha1:{x['digest']}"),
                ("Content-Type", "application/http; msgtype=response" if x["block"].startswith(b"HTTP/") else x["mime"])]
            if x["ip"] not in NO_IP:
                headers.insert(3, ("WARC-IP-Address", x["ip"]))
            block = x["block"]
            if revisit:
                block = block[:_head_size(block)] if block.startswith(b"HTTP/") else b""
                headers += [
                    ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                    ("WARC-Refers-To", record_id(str(x["first"]), x["first_uri"], x["first_date"], x["digest"])),
                    ("WARC-Refers-To-Target-URI", x["first_uri"]), ("WARC-Refers-To-Date", x["first_date"]),
                    ("WARC-Refers-To-Page", str(x["first"]))]
            yield (_warc_record([*headers, ("WARC-Payload-Length", str(x["payload_bytes"]))], block),)


def warc_records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Records of WARC files, but for those about the files."""
    reader = Reader(batches)
    while (line := reader.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{reader.file} has no record where one is due")
        headers = {}
        while (line := reader.line()) not in (b"\r", b"", None):
            name, _, value = line.decode("utf-8", "replace").rstrip("\r").partition(": ")
            headers[name.lower()] = value
        block, rest = reader.take(int(headers["content-length"]) + 4)
        if rest or not block.endswith(b"\r\n\r\n"):
            raise ValueError(f"{reader.file} has a record of another length than declared")
        if headers["warc-type"] == "warcinfo":
            continue
        http, payload = _body(block[:-4])
        full = headers["warc-type"] != "revisit"
        size, digest = (len(payload), base32_sha1(payload)) if full else (
            int(headers["warc-payload-length"]), headers["warc-payload-digest"].removeprefix("sha1:"))
        if full and headers["warc-payload-digest"] != f"sha1:{digest}":
            raise ValueError(f"{reader.file} has a payload of another digest than declared")
        page, refers = http.get("x-page-id", NO_PAGE), headers.get("warc-refers-to-page")
        yield (None if page == NO_PAGE else page, headers["warc-target-uri"], headers["warc-date"], headers["warc-record-id"], headers["warc-type"],
               digest, size, refers)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per WARC record, digests and lengths checked against what the record declares."""
    names = ["page", "uri", "date", "record_id", "record_type", "payload_digest", "payload_bytes", "refers_to"]
    schema = pa.schema([(x, pa.int64() if x == "payload_bytes" else pa.string()) for x in names])
    ddl = ", ".join(f"{x} {'bigint' if x == 'payload_bytes' else 'string'}" for x in names)
    return _lines(spark, path).mapInArrow(lambda batches: _emit(warc_records(batches), schema), ddl)


def report(pages: DataFrame) -> DataFrame:
    """Write pages as ARC, convert to WARC, read the WARC files back: one row per page.

    Nulls in any column, empty html, repeated pages and an empty table are defined above; other columns are ignored.
    """
    spark = pages.sparkSession
    folder = io.shared_dir(spark)
    write_arc(pages, f"{folder}/arc")
    convert(spark, f"{folder}/arc", f"{folder}/warc")
    return read_warc(spark, f"{folder}/warc").select(
        F.col("page").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("bigint").alias("refers_to"), "record_id", F.col("date").alias("record_date"))
