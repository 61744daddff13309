"""Token counts of documents in flat token files that have no index.

A token file is a plain run of unsigned 16-bit ids; each document ends with the
separator id. A document may open with its own number in five digits of base
8,192, which can't be taken for the separator. The scan cuts each file into
blocks, finds the separators of a block with one vector comparison, and joins
documents across block borders with a prefix scan over the blocks' summaries:
tokens before the block, separators before it, and the start of the document
that is open where the block begins.

Defined results: null and empty texts are documents of no token; repeated rows
are counted one by one; a null number comes back as null; tokens after the
last separator of a file are a document with ``closed`` false; no files or
empty ones give no row; other columns of the input are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import slices, text_or_empty

DIGITS, BASE_BITS = 5, 13
#: set in the first digit of a document whose number is null
_NULL = 1 << 12
BLOCK_TOKENS = 1 << 20
#: documents in one file at most
FILE_DOCUMENTS = 10_000


def _digits(number: int | None) -> bytes:
    if number is None:
        return np.array([_NULL, 0, 0, 0, 0], dtype="<u2").tobytes()
    n = number & (1 << 64) - 1
    return np.array([n >> BASE_BITS * k & (1 << BASE_BITS) - 1 for k in range(DIGITS - 1, -1, -1)], dtype="<u2").tobytes()


def write_token_files(df: DataFrame, path: str, vocabulary: str, pattern: str, separator: int,
                      text: str = "text", id_col: str = "doc_id", file_documents: int = FILE_DOCUMENTS) -> None:
    """Encode each whole text and write ``path`` as gzipped flat token files.

    Spark's text writer puts its line separator after each value; here the
    value is a document's packed ids and the separator is the separator id, so
    task retries and commits work as for any other output.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, pattern, "<u2")
        for b in slices(batches):
            numbers, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([_digits(n) + x for n, x in zip(numbers, enc.encode_all(texts))], pa.binary())], names=["value"])

    rows = df.select(F.col(id_col).cast("bigint"), text_or_empty(text)).mapInArrow(run, "value binary")
    end = np.array([separator], dtype="<u2").tobytes().decode("latin-1")
    rows.select(F.col("value").cast("string")).write.format("text").options(
        compression="gzip", lineSep=end, encoding="ISO-8859-1", maxRecordsPerFile=file_documents).save(path)


def _blocks(content: bytes, packed: bool, size: int) -> Iterator[bytes]:
    if not packed:
        yield from (content[i:i + size] for i in range(0, len(content), size))
        return
    rest, held = content, b""
    while rest:
        z = zlib.decompressobj(31)
        while rest and not z.eof:
            held += z.decompress(rest, size)
            rest = z.unconsumed_tail or z.unused_data
            while len(held) >= size:
                yield held[:size]
                held = held[size:]
        held += z.flush()
    while held:
        yield held[:size]
        held = held[size:]


def block_summaries(spark: SparkSession, path: str, separator: int, block_tokens: int = BLOCK_TOKENS,
                    header: int = DIGITS) -> DataFrame:
    """One row per block: ``file, block, n`` tokens, ``seps`` (positions of
    separators), ``heads`` (the first ids of each document that starts in the
    block, as far as the block has them) and ``lead`` (the block's own first ids)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                for k, raw in enumerate(_blocks(content.as_py(), name.endswith(".gz"), 2 * block_tokens)):
                    ids = np.frombuffer(raw, dtype="<u2")
                    seps = np.flatnonzero(ids == separator)
                    starts = np.concatenate([np.zeros(int(k == 0), dtype=np.int64), seps + 1])
                    heads = [ids[s:s + header].tolist() for s in starts.tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name]), pa.array([k], pa.int64()), pa.array([len(ids)], pa.int64()),
                         pa.array([seps], pa.list_(pa.int64())), pa.array([heads], pa.list_(pa.list_(pa.int32()))),
                         pa.array([ids[:header].tolist()], pa.list_(pa.int32()))],
                        names=["file", "block", "n", "seps", "heads", "lead"])

    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("path", "content")
    return files.mapInArrow(run, "file string, block bigint, n bigint, seps array<bigint>, "
                                 "heads array<array<int>>, lead array<int>")


def _number(head: Column) -> Column:
    value = F.aggregate(head, F.lit(0).cast("bigint"),
                        lambda a, d: F.shiftleft(a, BASE_BITS).bitwiseOR(d.cast("bigint")))
    return F.when(F.get(head, F.lit(0)) < _NULL, value)


def documents(spark: SparkSession, path: str, separator: int, block_tokens: int = BLOCK_TOKENS,
              header: int = DIGITS) -> DataFrame:
    """``file, ordinal`` (in the file, from 0), ``start`` (token position),
    ``n_tokens`` (header and separator left out), ``closed`` and, where the
    files have headers, ``doc_id``."""
    if header and block_tokens < header:
        raise ValueError("a block must hold a whole header")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    by_block = Window.partitionBy("file").orderBy("block")
    b = block_summaries(spark, path, separator, block_tokens, header)
    none = F.array().cast("array<int>")
    b = b.withColumn("next_lead", F.coalesce(F.lead("lead").over(by_block), none)) \
        .withColumn("end", F.lead("block").over(by_block).isNull()) \
        .withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))) \
        .withColumn("ordinal", F.coalesce(F.sum(F.size("seps")).over(before), F.lit(0)).cast("bigint"))
    # only the last document that starts in a block can have its header cut by the border
    whole = F.transform(F.col("heads"), lambda h: F.slice(F.concat(h, F.col("next_lead")), 1, header)) if header \
        else F.col("heads")
    b = b.withColumn("heads", whole) \
        .withColumn("starts", F.concat(F.when(F.col("block") == 0, F.array(F.lit(0).cast("bigint")))
                                       .otherwise(F.array().cast("array<bigint>")),
                                       F.transform("seps", lambda s: s + F.col("offset") + 1)))
    last = F.when(F.size("starts") > 0, F.struct(F.element_at("starts", -1).alias("start"),
                                                 F.element_at("heads", -1).alias("head")))
    b = b.withColumn("open", F.last(last, ignorenulls=True).over(before))
    first = F.when(F.col("block") == 0, F.array().cast("array<struct<start:bigint,head:array<int>>>")) \
        .otherwise(F.array("open"))
    begun = F.concat(first, F.transform("starts", lambda s, i: F.struct(
        s.alias("start"), F.get(F.col("heads"), i).alias("head"))))
    ends = F.concat(F.transform("seps", lambda s: F.struct((s + F.col("offset")).alias("stop"), F.lit(True).alias("closed"))),
                    F.when(F.col("end"), F.array(F.struct((F.col("offset") + F.col("n")).alias("stop"),
                                                          F.lit(False).alias("closed"))))
                    .otherwise(F.array().cast("array<struct<stop:bigint,closed:boolean>>")))
    rows = b.select("file", "ordinal", begun.alias("begun"), ends.alias("ends")) \
        .select("file", "ordinal", "begun", F.posexplode("ends").alias("i", "e")) \
        .withColumn("d", F.get("begun", F.col("i"))) \
        .filter(F.col("e.closed") | (F.col("e.stop") > F.col("d.start")))
    out = rows.select("file", (F.col("ordinal") + F.col("i")).alias("ordinal"), F.col("d.start").alias("start"),
                      F.greatest(F.col("e.stop") - F.col("d.start") - header, F.lit(0)).alias("n_tokens"),
                      F.col("e.closed").alias("closed"), F.col("d.head").alias("head"))
    return out.select("*", _number(F.col("head")).alias("doc_id")).drop("head") if header else out.drop("head")
