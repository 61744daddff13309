"""Headers and first values of CSV files, from the first bytes of each.

Spark lists the files (its binary-file source, whose content column is not
read). A task per group of files then opens each file, reads it in small blocks
and stops as soon as it knows the header, and the first known epoch if one is
asked for. The size of a file plays no part unless none of its epochs is known.

Files are opened through Arrow's file systems (local or mounted folders and the
object stores it speaks to). Where Arrow has none for a scheme, the driver reads
the first bytes through Hadoop's, several files at a time.
"""

from __future__ import annotations

import codecs
import csv
import datetime as dt
import re
from collections.abc import Callable, Iterable, Iterator
from multiprocessing.pool import ThreadPool
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 16_384
SCHEMA = "path string, header array<string>, year int"
_ROW = pa.schema([("path", pa.string()), ("header", pa.list_(pa.string())), ("year", pa.int32())])


class Dialect:
    """What of a CSV reader's options says where cells and records end."""

    def __init__(self, options: dict | None = None) -> None:
        o = {k.lower(): v for k, v in (options or {}).items()}
        self.sep = str(o.get("sep", o.get("delimiter", ",")))
        self.quote, self.escape = str(o.get("quote", '"')), str(o.get("escape", "\\"))
        self.comment = str(o.get("comment", ""))
        self.encoding = str(o.get("encoding", o.get("charset", "utf-8")))
        self.multiline = str(o.get("multiline", False)).lower() == "true"

    def cells(self, lines: Iterable[str]) -> Iterator[list[str]]:
        """Records of the lines that are neither blank nor comments."""
        def kept() -> Iterator[str]:
            for line in lines:
                if line.strip("\r\n \t") and not (self.comment and line.startswith(self.comment)):
                    yield line

        if len(self.sep) > 1:
            yield from (line.rstrip("\r\n").split(self.sep) for line in kept())
            return
        how = {"delimiter": self.sep, "quotechar": self.quote or None, "quoting": csv.QUOTE_MINIMAL if self.quote else csv.QUOTE_NONE,
               "escapechar": self.escape if self.escape != self.quote else None}
        if self.multiline:  # a blank line inside quotes belongs to its cell
            yield from (c for c in csv.reader(lines, **how) if any(x.strip() for x in c)
                        and not (self.comment and c[0].startswith(self.comment)))
        else:
            for line in kept():
                yield from csv.reader([line.rstrip("\r\n")], **how)


def _lines(blocks: Iterable[bytes], encoding: str) -> Iterator[str]:
    decode = codecs.getincrementaldecoder(encoding)(errors="replace").decode
    held, first = "", True
    for block in blocks:
        text = decode(block)
        if first and text:
            text, first = text.removeprefix("﻿"), False
        held += text
        *whole, held = re.split(r"(?<=\n)|(?<=\r)(?=[^\n])", held)
        yield from whole
    held += decode(b"", True)
    if held:
        yield held


def _year(cell: str) -> int | None:
    """The year of epoch seconds; None for what is no number or out of range."""
    try:
        return (dt.datetime(1970, 1, 1) + dt.timedelta(seconds=float(cell))).year
    except (ValueError, OverflowError):
        return None


def head(blocks: Iterable[bytes], dialect: Dialect, epochs: tuple[str, ...] = ()) -> tuple[list[str] | None, int | None]:
    """Header and the year of the first known epoch (in the first of the columns
    ``epochs`` that the file has) of a file given in blocks."""
    records = dialect.cells(_lines(blocks, dialect.encoding))
    header = next(records, None)
    column = next((header.index(c) for c in epochs if c in header), None) if header else None
    if column is None:
        return header, None
    years = (_year(r[column]) for r in records if len(r) > column)
    return header, next((y for y in years if y is not None), None)


def _arrow_blocks(path: str) -> Iterator[bytes]:
    from pyarrow import fs

    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        system, at = fs.LocalFileSystem(), unquote(parts.path)
    else:
        system, at = fs.FileSystem.from_uri(path)
    with system.open_input_stream(at, compression=None, buffer_size=0) as stream:
        while block := stream.read(BLOCK):
            yield block


def _arrow_speaks(path: str) -> bool:
    return urlsplit(path).scheme in ("", "file", "s3", "gs", "abfs", "abfss")


def _hadoop_blocks(spark: SparkSession, path: str) -> Iterator[bytes]:
    at = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(path))
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        while block := bytes(stream.readNBytes(BLOCK)):
            yield block
    finally:
        stream.close()


def files(spark: SparkSession, root: str | list[str], glob: str = "*.csv") -> DataFrame:
    """``path, length`` of the files under ``root`` that have any byte; their content is not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root) \
        .select(F.col("_metadata.file_path").alias("path"), "length")


def probe(spark: SparkSession, root: str | list[str], glob: str = "*.csv", options: dict | None = None,
          epochs: tuple[str, ...] = (), path_filter: Callable | None = None) -> DataFrame:
    """``path`` (decoded), ``header`` (null: no record in the file) and ``year``
    of every file whose decoded path meets ``path_filter``."""
    dialect, found = Dialect(options), files(spark, root, glob).select("path")
    if path_filter is not None:
        found = found.where(path_filter(F.url_decode("path")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = b.column(0).to_pylist()
            heads = [head(_arrow_blocks(p), dialect, epochs) for p in paths]
            yield pa.RecordBatch.from_arrays(
                [pa.array([unquote(p) for p in paths], pa.string()), pa.array([h for h, _ in heads], pa.list_(pa.string())),
                 pa.array([y for _, y in heads], pa.int32())], schema=_ROW)

    one = found.first()
    if one is None or _arrow_speaks(one["path"]):
        return found.mapInArrow(run, SCHEMA)
    with ThreadPool(16) as pool:
        heads = pool.map(lambda p: (unquote(p), *head(_hadoop_blocks(spark, p), dialect, epochs)), [r["path"] for r in found.collect()])
    return spark.createDataFrame(heads, SCHEMA)


def missing_columns(spark: SparkSession, root: str | list[str], required: list[str], glob: str = "*.csv",
                    options: dict | None = None) -> DataFrame:
    """P4 for a tree: ``path, missing``, one row for each required column that a file's header lacks."""
    wanted = F.array(*[F.lit(c) for c in required]).cast("array<string>")
    lacks = F.array_except(wanted, F.coalesce("header", F.array().cast("array<string>")))
    return probe(spark, root, glob, options).select("path", F.explode(lacks).alias("missing"))
