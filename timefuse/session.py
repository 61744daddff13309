"""Spark session defaults and the shared scratch folder.

Everything in the library is lazy DataFrame code; the only place that decides
configuration is here, so tests, the bench and the entry point run the same
settings.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "true",
    # MIN/MAX/COUNT of raw columns from Parquet footers
    "spark.sql.parquet.aggregatePushdown": "true",
    # HotSpot does not JIT methods above 8000 bytecodes; wider generated code
    # (the 57-format time parser, wide feature projections) falls back to
    # Spark's split/interpreted path instead of running un-compiled bytecode
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.ui.enabled": "false",
    "spark.driver.memory": "8g",
    "spark.ui.showConsoleProgress": "false",
}


# settings that are fixed when the JVM starts; everything else in
# DEFAULT_CONF can also be applied to a session someone else created
STATIC_CONF = {"spark.ui.enabled", "spark.ui.showConsoleProgress", "spark.driver.memory"}


def apply_sql_defaults(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings the library relies on (UTC zone, AQE
    with skew-join handling, generated-method cap) to an existing session,
    and make sure a checkpoint folder is known."""
    for k, v in DEFAULT_CONF.items():
        if k not in STATIC_CONF:
            try:
                spark.conf.set(k, v)
            except Exception:  # noqa: BLE001 - a static or locked setting stays as the cluster set it
                pass
    ensure_checkpoint_dir(spark)
    return spark


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "timefuse", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    # the session may have existed already: pin the settings every time
    return apply_sql_defaults(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    On a cluster ``spark.checkpoint.dir`` points to shared storage and is used
    as given. Only a local master, which has no other machines, gets a folder
    of its own when it is unset; elsewhere that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="timefuse-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-path of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


def written(spark: SparkSession, df, name: str):
    """Write ``df`` as Parquet into the shared checkpoint folder and read it
    back: it is computed once, its size is known, and a lost executor costs no
    recomputation of it."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: bytes of a table that is broadcast
BROADCAST_BYTES = 64 << 20


def table_bytes(table) -> int:
    """The bytes of a table's rows, about as Spark holds them: eight for each
    column, and the length of texts and of nested values (as JSON)."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    size = F.lit(16)
    for f in table.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + 8 + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size = size + 8 + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        else:
            size = size + 8
    return table.agg(F.sum(size.cast("bigint"))).first()[0] or 0


def join_side(table, most: int = BROADCAST_BYTES):
    """A written table for a join, marked for a broadcast if its measured bytes
    allow one; and whether they do."""
    from pyspark.sql import functions as F

    small = table_bytes(table) <= most
    return (F.broadcast(table) if small else table), small
