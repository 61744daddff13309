"""Sinks and stored state.

All outputs are Parquet (or JSON lines) datasets written by Spark tasks in
parallel. Appends are runs: each run has a folder of its own and counts once
its entry is in the sink's ledger (``sources.ledger``). A run that is tried
again overwrites its own folder, or does nothing if it is committed, on
whatever day; readers take committed runs only (``read_committed``).
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ledger import Ledger
from .models import ModelLog, ModelState

_RUN = re.compile(r"[A-Za-z0-9_.-]{1,150}")


def _ledger(spark: SparkSession, path: str) -> Ledger:
    return Ledger(spark, f"{path.rstrip('/')}/_ledger")


def append_run(df: DataFrame, path: str, run: str, partition_by: list[str] | None = None, fmt: str = "parquet",
               fixed: dict | None = None, note: dict | None = None) -> dict | None:
    """Append the rows of ``df`` as one run, exactly once.

    ``fixed`` are values for folders above the run's own (such as the run's
    date): the first attempt's are entered before any row is written, and every
    later attempt uses those. Returns the run's fixed values, or None if it was
    committed before. ``note`` is kept with the commit."""
    if not _RUN.fullmatch(run):
        raise ValueError(f"not a run name: {run!r}")
    ledger = _ledger(df.sparkSession, path)
    if ledger.get(f"done-{run}") is not None:
        return None
    fixed = ledger.commit(f"begun-{run}", fixed or {})
    folder = "/".join([path.rstrip("/"), *(f"{k}={v}" for k, v in fixed.items()), f"run=r-{run}"])
    w = df.write.mode("overwrite").partitionBy(*(partition_by or []))
    if fmt == "csv":
        w.option("header", True).csv(folder)
    else:
        w.format(fmt).save(folder)
    ledger.commit(f"done-{run}", {"fixed": fixed, **(note or {})})
    return fixed


def read_committed(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """The rows of all committed runs, with their ``run``. What an attempt left
    behind that never got to its commit is not seen: those runs are known from
    the ledger and left out of the scan as folders."""
    entries = _ledger(spark, path).keys()
    done = {k[5:] for k in entries if k.startswith("done-")}
    open_runs = [f"r-{k[6:]}" for k in entries if k.startswith("begun-") and k[6:] not in done]
    if not done:
        if schema is None:
            raise ValueError(f"no committed run in {path}, and no schema given")
        return spark.createDataFrame([], schema).withColumn("run", F.lit(None).cast("string"))
    r = spark.read.format(fmt).option("basePath", path)
    out = (r.option("header", True) if fmt == "csv" else r).load(path)
    if open_runs:
        out = out.where(~F.col("run").isin(open_runs))
    return out.withColumn("run", F.substring("run", 3, 200))


def sink_forecast_append(df: DataFrame, path: str, run: str, fmt: str = "parquet") -> bool:
    """K1: append the forecasts of a run, one partition per forecast period.
    False if that run was appended before."""
    return append_run(df, path, run, ["forecast_period"], fmt) is not None


def sink_prediction_by_day(df: DataFrame, path: str, run_date_col: str = "run_date",
                           source_col: str = "source_file") -> None:
    """K2: predictions under (run_date, source_file); a replay of the same
    file on the same day replaces its partition instead of appending twice."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
      .partitionBy(run_date_col, source_col).parquet(path)


def sink_run_by_day(df: DataFrame, path: str, run: str, run_date: dt.date | None = None, note: dict | None = None) -> bool:
    """K2 for runs of many files: the predictions of a run under the date of its
    first attempt (UTC today by default), one folder a run. A replay, also on a
    later day, changes nothing once the run is committed and replaces the rows
    of an attempt that was not."""
    run_date = run_date or dt.datetime.now(dt.timezone.utc).date()
    return append_run(df, path, run, fixed={"run_date": run_date.isoformat()}, note=note) is not None


def json_by_time_lines(df: DataFrame, key: str = "datetime") -> DataFrame:
    """K3 payload: one JSON object per row keyed by the ISO time (ms), value =
    the record with NULL fields kept."""
    iso = F.date_format(F.col(key), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    rec = F.to_json(F.struct(*[F.col(c) for c in df.columns if c != key]), {"ignoreNullFields": "false"})
    return df.select(F.concat(F.lit('{"'), iso, F.lit('":'), rec, F.lit("}")).alias("value"))


def sink_json_by_time(df: DataFrame, path: str, key: str = "datetime") -> None:
    """K3: JSON lines keyed by time."""
    json_by_time_lines(df, key).write.mode("overwrite").text(path)


def read_json_by_time(spark: SparkSession, path: str, schema: str, key: str = "datetime") -> DataFrame:
    """Read K3 output back into (key, fields...)."""
    raw = spark.read.text(path)
    m = F.from_json(F.col("value"), f"map<string, struct<{schema}>>")
    return raw.select(F.explode(m).alias("_k", "_v")) \
              .select(F.to_timestamp("_k", "yyyy-MM-dd'T'HH:mm:ss.SSS").cast("timestamp_ntz").alias(key), "_v.*")


def sink_model_state(spark: SparkSession, path: str, coefs: dict, scaler: dict | None, roles_json: str | None,
                     version: int | None = None, target_scaler: dict | None = None, preparation: str | None = None,
                     statistics: DataFrame | None = None) -> int | None:
    """K4: coefficients, scalers, roles, fitted preparation and statistics as one
    version of the model (the next one by default). None if that version stands
    already; a version is never changed."""
    log = ModelLog(spark, path)
    known = log.versions()
    state = ModelState(coefs=coefs, scaler=scaler or {}, target_scaler=target_scaler or {}, roles=roles_json, preparation=preparation,
                       features=list(dict.fromkeys(f for c in coefs.values() for f in c if f != "intercept")),
                       targets=list(coefs), statistics=statistics, version=known[-1] if known else -1)
    return log.publish(state, version)


def load_model_state(spark: SparkSession, path: str, version: int | None = None) -> tuple[DataFrame | None, dict]:
    """Coefficient table of a version (the newest by default) and the same
    as a dict; (None, {}) if nothing is stored. ``load_model`` gives all of it."""
    state = load_model(spark, path, version)
    if state is None:
        return None, {}
    rows = [(t, term, v) for t, cs in state.coefs.items() for term, v in cs.items()]
    return spark.createDataFrame(rows, "target string, term string, coef double"), state.coefs


def load_model(spark: SparkSession, path: str, version: int | None = None) -> ModelState | None:
    """Model, scalers, roles and preparation of a version; None if nothing is stored."""
    return ModelLog(spark, path).load(version)


def latest_predictions(df: DataFrame, run_col: str, order_by: list[str], n: int = 5) -> DataFrame:
    """Rows of the newest run, first ``n`` by ``order_by``."""
    latest = df.agg(F.max(run_col).alias("_latest"))
    return df.join(F.broadcast(latest), F.col(run_col) == F.col("_latest")).drop("_latest") \
             .orderBy(*order_by).limit(n)
