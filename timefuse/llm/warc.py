"""Conversion of legacy ARC archives to WARC, and reading of WARC archives.

An ARC file opens with a version block (``filedesc://``), which names the
fields of the header lines that follow: five in version 1, ten in version 2.
The last field is the number of bytes after the line. Each record becomes a
WARC record with an identifier made from its place, its date in ISO form, a
type, and SHA-1 digests of block and payload; version blocks become
``warcinfo``. Records with equal payloads keep one ``response``, the others are
``revisit`` records that refer to it.

Archives are read whole, one file a row, with Spark's own reader, so any store
that Spark reads will do; they are written with Spark's text writer, whose line
separator is what ends a record in either format.

Defined results: null or empty html is a record without payload; a null id has
no ``X-Page-Id`` and comes back null; of equal payloads the record with the
largest id is the response, among equal ids the first by identifier; records
cut off by the end of a file, or by a damaged gzip member, which ends it, are
returned with ``complete`` false; lines that are no header are skipped up to the
next one, and no bytes make a reader fail; fields that a header does not have
are null and left out of the WARC record; empty tables give no row; other
columns are not carried.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_or_empty, written

#: fixed values: the field names of the two versions' header lines
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: the name under which the fields of a version block say that they are one
VERSION_BLOCK = "Version-block"
_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """Base-32 SHA-1 of a binary column: five bytes at a time through ``conv``."""
    digest = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digest, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*groups), _HEX32, _BASE32)


def write_arc(pages: DataFrame, path: str, version: int = 1, html: str = "html", url: str = "url",
              id_col: str = "page_id") -> None:
    """Write pages as gzipped ARC files: HTTP responses whose header carries the page's id."""
    body = text_or_empty(html)
    number = F.col(id_col).cast("bigint")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
                    F.coalesce(F.concat(F.lit("X-Page-Id: "), number.cast("string"), F.lit("\r\n")), F.lit("")),
                    F.lit("\r\n"))
    place = F.regexp_replace(F.coalesce(F.nullif(F.col(url), F.lit("")), F.lit("-")), r"\s", "%20")
    date = F.date_format(F.timestamp_seconds(1_000_000_000 + F.pmod(F.coalesce(number, F.lit(0)), F.lit(500_000_000))),
                         "yyyyMMddHHmmss")
    size = (F.octet_length(head) + F.octet_length(body)).cast("string")
    more = [] if version == 1 else [F.lit("200"), F.lit("-"), F.lit("-"), F.lit("0"), F.lit("-")]
    line = F.concat_ws(" ", place, F.lit("0.0.0.0"), date, F.lit("text/html"), *more, size)
    rows = pages.select(F.concat(line, F.lit("\n"), head, body).alias("value"))
    about = f"{version} 0 pages\n{ARC_FIELDS[version]}\n"
    extra = "" if version == 1 else " 200 - - 0 -"
    block = f"filedesc://pages.arc 0.0.0.0 20010909014640 text/plain{extra} {len(about)}\n{about}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, b in enumerate(batches):
            if k == 0:  # a task writes one file
                yield pa.RecordBatch.from_arrays([pa.array([block], b.column(0).type)], names=["value"])
            yield pa.RecordBatch.from_arrays(b.columns, names=["value"])

    rows.mapInArrow(run, "value string").write.format("text").options(compression="gzip", lineSep="\n").save(path)


def _count(text: str) -> int | None:
    """A number of bytes: ASCII digits and nothing else."""
    return int(text) if re.fullmatch("[0-9]{1,18}", text) else None


class _Stream:
    """Lines and byte runs of a plain or gzipped file held in memory, unpacked step by step."""

    def __init__(self, content: bytes, packed: bool, step: int = 1 << 20) -> None:
        self.parts = self._unpack(content, step) if packed else iter([content])
        self.held, self.at, self.place = b"", 0, 0

    @staticmethod
    def _unpack(content: bytes, step: int) -> Iterator[bytes]:
        while content:
            z = zlib.decompressobj(31)
            try:
                while content and not z.eof:
                    yield z.decompress(content, step)
                    content = z.unconsumed_tail or z.unused_data
                yield z.flush()
            except zlib.error:  # damaged: what follows has no known place
                return

    def _more(self) -> bool:
        part = next(self.parts, None)
        if part is None:
            return False
        self.held, self.at = self.held[self.at:] + part, 0
        return True

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the file."""
        seen = self.at
        while (end := self.held.find(b"\n", seen)) < 0:
            seen = len(self.held) - self.at
            if not self._more():
                rest = self.take(len(self.held) - self.at)
                return rest or None
        return self.take(end + 1 - self.at)[:-1]

    def take(self, n: int) -> bytes:
        """``n`` bytes, or what is left."""
        if len(self.held) - self.at < n:
            parts, have = [self.held[self.at:]], len(self.held) - self.at
            for part in self.parts:
                parts.append(part)
                have += len(part)
                if have >= n:
                    break
            self.held, self.at = b"".join(parts), 0
        out = self.held[self.at:self.at + n]
        self.at += len(out)
        self.place += len(out)
        return out


def arc_records(content: bytes, packed: bool) -> Iterator[tuple]:
    """(place, version, fields by name, block, complete) of each record of an ARC file."""
    stream, version, names, opening = _Stream(content, packed), 1, ARC_FIELDS[1].split(), True
    while True:
        place, line = stream.place, stream.line()
        if line is None:
            return
        words = line.decode("utf-8", "replace").split(" ")
        named, own = words[0].startswith("filedesc://"), names
        if named and (opening or len(words) != len(names)):  # its own line has the fields of the version that it declares
            own = next((f.split() for f in ARC_FIELDS.values() if len(f.split()) == len(words)), names)
        size = _count(words[-1])
        if len(words) != len(own) or size is None:
            continue
        fields, block = dict(zip(own, words)), stream.take(size)
        # a page may have such a url too: a version block opens the file, or declares fields further on
        if named and not block.startswith(b"HTTP/"):
            lines = block.decode("utf-8", "replace").split("\n")
            declares = re.match("([0-9]{1,4}) ", lines[0]) if len(lines) > 1 and lines[1].startswith("URL ") else None
            if opening or declares:
                fields[VERSION_BLOCK] = "yes"
                version = next((v for v, f in ARC_FIELDS.items() if f.split() == own), version)
                names = own
                if declares:
                    version, names = int(declares[1]), lines[1].split()
        opening = False
        yield place, version, fields, block, len(block) == size


_ARC = pa.schema([("file", pa.string()), ("place", pa.int64()), ("version", pa.int32()), ("url", pa.string()),
                  ("ip", pa.string()), ("date", pa.string()), ("mime", pa.string()), ("status", pa.string()),
                  ("head", pa.binary()), ("payload", pa.binary()), ("complete", pa.bool_()), ("about", pa.bool_())])


def _batched(rows: Iterator[dict], schema: pa.Schema, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of a bounded number of payload bytes."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r["payload"]) + 200
        if size >= most:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _parted(block: bytes) -> tuple[bytes, bytes]:
    """Head and payload of an HTTP message; a block that is none is all payload."""
    if block.startswith(b"HTTP/"):
        end = block.find(b"\r\n\r\n")
        if end >= 0:
            return block[:end + 4], block[end + 4:]
    return b"", block


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).filter("length > 0").select("path", "content")


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """The records of ARC files, version blocks (``about``) included."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                def rows(name=name, content=content):
                    for place, version, f, block, complete in arc_records(content.as_py(), name.endswith(".gz")):
                        head, payload = _parted(block)
                        yield {"file": name.rsplit("/", 1)[-1], "place": place, "version": version, "url": f.get("URL"),
                               "ip": f.get("IP-address"), "date": f.get("Archive-date"), "mime": f.get("Content-type"),
                               "status": f.get("Result-code"), "head": head, "payload": payload, "complete": complete,
                               "about": VERSION_BLOCK in f}
                yield from _batched(rows(), _ARC)

    return _files(spark, path).mapInArrow(run, "file string, place bigint, version int, url string, ip string, "
                                               "date string, mime string, status string, head binary, payload binary, "
                                               "complete boolean, about boolean")


def header_value(head: Column, name: str) -> Column:
    """A field of an HTTP head (binary), or null."""
    return F.nullif(F.regexp_extract(head.cast("string"), rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def convert(spark: SparkSession, arc: DataFrame, min_payload: int = 0) -> DataFrame:
    """WARC records of ARC records: one string ``value`` a record, without the blank lines that end it.

    The payloads' digests find equal payloads: one narrow aggregate gives each
    digest's response, and only digests with several records are joined back.
    """
    made = arc.withColumns({
        "digest": base32_sha1(F.col("payload")), "bytes": F.octet_length("payload").cast("bigint"),
        "number": header_value(F.col("head"), "X-Page-Id").try_cast("bigint"),
        "record": F.regexp_replace(F.md5(F.concat_ws(" ", "file", F.col("place").cast("string"))),
                                   "(.{8})(.{4})(.{4})(.{4})(.{12})", "urn:uuid:$1-$2-$3-$4-$5"),
        "when": F.regexp_replace(F.rpad("date", 14, "0"), r"(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d).*", "$1-$2-$3T$4:$5:$6Z"),
    })
    made = written(spark, made, "arc-records")
    pages = made.filter("not about")
    # the largest id, then the smallest identifier
    largest = F.max(F.struct(F.col("number"), F.translate("record", "0123456789abcdef", "fedcba9876543210").alias("r"),
                             F.col("record"), F.col("url"), F.col("when")))
    first = pages.filter(F.col("bytes") >= min_payload).groupBy("digest").agg(largest.alias("first"), F.count("*").alias("n"))
    # written, so the join knows its size: few equal payloads are broadcast and no payload moves
    first = written(spark, first.filter("n > 1").select("digest", "first"), "equal-payloads")
    out = pages.join(first, "digest", "left")
    same = F.col("first").isNotNull() & (F.col("bytes") >= min_payload) & (F.col("first.record") != F.col("record"))

    def field(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))

    block = F.when(same, F.col("head")).otherwise(F.concat("head", "payload"))
    revisit = F.concat(
        field("WARC-Refers-To", F.concat(F.lit("<"), F.col("first.record"), F.lit(">"))),
        field("WARC-Refers-To-Target-URI", F.col("first.url")), field("WARC-Refers-To-Date", F.col("first.when")),
        F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\n"))
    head = F.concat(
        F.lit("WARC/1.0\r\n"), field("WARC-Type", F.when(same, "revisit").otherwise("response")),
        field("WARC-Record-ID", F.concat(F.lit("<"), F.col("record"), F.lit(">"))), field("WARC-Date", F.col("when")),
        field("WARC-Target-URI", F.col("url")), field("WARC-IP-Address", F.col("ip")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        field("WARC-Block-Digest", F.concat(F.lit("sha1:"), base32_sha1(block))),
        field("X-Payload-Length", F.col("bytes")),
        F.when(same, revisit).otherwise(F.when(~F.col("complete"), F.lit("WARC-Truncated: unspecified\r\n")).otherwise("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        field("Content-Length", F.octet_length(block)), F.lit("\r\n"))
    info = made.filter("about").select(F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: warcinfo\r\n"), field("WARC-Record-ID", F.concat(F.lit("<"), F.col("record"), F.lit(">"))),
        field("WARC-Date", F.col("when")), F.lit("Content-Type: text/plain\r\n"),
        field("Content-Length", F.col("bytes")), F.lit("\r\n"), F.col("payload").cast("string")).alias("value"))
    return out.select(F.concat(head, block.cast("string")).alias("value")).unionByName(info)


def write_warc(records: DataFrame, path: str) -> None:
    """Write ``value`` strings as gzipped WARC files."""
    records.select("value").write.format("text").options(compression="gzip", lineSep="\r\n\r\n").save(path)


def warc_records(content: bytes, packed: bool) -> Iterator[tuple[dict[str, str], bytes, bool]]:
    """(fields by lower-case name, block, complete) of each record of a WARC file."""
    stream = _Stream(content, packed)
    while (line := stream.line()) is not None:
        if not line.startswith(b"WARC/"):
            continue
        fields: dict[str, str] = {}
        while (line := stream.line()) and line != b"\r":
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        n = _count(fields.get("content-length", "0"))
        block = stream.take(n or 0)
        yield fields, block, len(block) == n


_WARC = pa.schema([("type", pa.string()), ("record", pa.string()), ("date", pa.string()), ("url", pa.string()),
                   ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload_length", pa.int64()),
                   ("head", pa.binary()), ("payload", pa.binary()), ("complete", pa.bool_())])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                def rows(name=name, content=content):
                    for f, block, complete in warc_records(content.as_py(), name.endswith(".gz")):
                        head, payload = _parted(block)
                        size = _count(f.get("x-payload-length", ""))
                        yield {"type": f.get("warc-type"), "record": f.get("warc-record-id"), "date": f.get("warc-date"),
                               "url": f.get("warc-target-uri"), "payload_digest": f.get("warc-payload-digest"),
                               "refers_to": f.get("warc-refers-to"),
                               "payload_length": size, "head": head,
                               "payload": payload, "complete": complete}
                yield from _batched(rows(), _WARC)

    return _files(spark, path).mapInArrow(run, "type string, record string, date string, url string, "
                                               "payload_digest string, refers_to string, payload_length bigint, "
                                               "head binary, payload binary, complete boolean")
