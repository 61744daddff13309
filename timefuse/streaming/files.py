"""Structured Streaming over a directory of arriving CSV files (L1, L2).

The file source lists new files itself and tracks them in the checkpoint, so
each file is read once per query. ``foreachBatch`` runs at least once for each
batch; what it does is entered in ledgers in shared storage, so it counts once:

* predictions are runs of the sink (``sinks.append_run``), named by stream and
  batch, under the date of the first attempt;
* a model version says which batch of each stream it took in last
  (``models.ModelLog``).

Every batch is prepared and scored with the newest model version at its start.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import linear
from ..plans import preprocess
from ..sources import sinks
from ..sources.models import ModelLog, ModelState


def _trigger(writer, interval: str | None):
    """``interval=None``: process what is there and stop (tests, backfills);
    otherwise a micro-batch every ``interval`` (e.g. "1 minute"), as a
    watched directory needs."""
    return writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)


def file_stream(spark: SparkSession, directory: str, schema: str, max_files: int | None = None,
                options: dict | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).option("header", True).option("recursiveFileLookup", True) \
        .option("pathGlobFilter", "*.csv").options(**(options or {}))
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.csv(directory).withColumns({"source_file": F.col("_metadata.file_name"),
                                         # basenames repeat across directories; the sink keys on the path
                                         "source_id": F.xxhash64(F.col("_metadata.file_path"))})


Prepare = Callable[[DataFrame], DataFrame]


def _prepared(batch: DataFrame, state: ModelState, prepare: Prepare | None, keep: list[str]) -> DataFrame:
    """The batch by ``prepare``, or by the preparation stored with the model."""
    if prepare is not None:
        return prepare(batch)
    if state.preparation is None:
        return batch
    own = [c for c in (*keep, "source_file", "source_id") if c in batch.columns]
    return preprocess.transform(batch, preprocess.PreprocessState.from_json(state.preparation), keep=own)


def score_batch(batch: DataFrame, model: dict | ModelState, prepare: Prepare | None, require: str = "ts",
                keep: list[str] | None = None) -> DataFrame:
    """Prepared, scored rows in the sink's shape: kept columns, predicted
    targets (in the targets' own units), ``timestamp`` (run time), ``source_file``, ``source_id``."""
    state = model if isinstance(model, ModelState) else ModelState(coefs=model)
    rows = _prepared(batch.where(F.col(require).isNotNull()), state, prepare, keep or [])
    scored = linear.predict_linear(rows, state.coefs, prefix="pred_")
    back = {}
    for t, (mean, std) in state.target_scaler.items():
        if t in state.coefs:
            back[f"pred_{t}"] = F.col(f"pred_{t}") * F.lit(std or 1.0) + F.lit(mean or 0.0)
    return scored.withColumns(back).select(*(keep or []), *[f"pred_{t}" for t in state.coefs],
                                           F.current_timestamp().cast("timestamp_ntz").alias("timestamp"),
                                           "source_file", "source_id")


def score_once(batch: DataFrame, run: str, model: dict | ModelState, prepare: Prepare | None, sink: str, require: str = "ts",
               keep: list[str] | None = None, run_date: dt.date | None = None) -> bool:
    """L1 for one batch: its predictions as the run ``run`` of the sink; False if that run is committed."""
    return sinks.sink_run_by_day(score_batch(batch, model, prepare, require, keep), sink, run, run_date)


def _current(spark: SparkSession, model: dict | str) -> dict | ModelState:
    state = sinks.load_model(spark, model) if isinstance(model, str) else model
    if state is None:
        raise ValueError(f"no model version in {model}")
    return state


def stream_score_files(spark: SparkSession, directory: str, schema: str, model: dict | str, prepare: Prepare | None, sink: str,
                       checkpoint: str, require: str = "ts", max_files: int | None = None, options: dict | None = None,
                       interval: str | None = None, keep: list[str] | None = None, stream: str = "score"):
    """L1: every new file -> prepare (fit-free) -> predict -> the per-day
    prediction sink. ``model`` is a folder of versions (read anew for each
    batch) or fixed coefficients. Read the result with ``read_predictions``."""
    files = file_stream(spark, directory, schema, max_files, options)

    def score(batch: DataFrame, batch_id: int) -> None:
        if require in batch.columns:
            score_once(batch, f"{stream}-{batch_id}", _current(spark, model), prepare, sink, require, keep)

    return _trigger(files.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint), interval).start()


def reprocess_files(spark: SparkSession, paths: list[str], schema: str, model: dict | str, prepare: Prepare | None, sink: str,
                    require: str = "ts", options: dict | None = None, keep: list[str] | None = None, run: str | None = None) -> None:
    """Modified files: the stream's file source keys on the path and does not
    read a changed file again, so changed paths are scored again by this batch
    job. Its run names the files it is about; readers take a file's rows from
    the last such run, also if the file is empty now."""
    def tagged(df: DataFrame) -> DataFrame:
        return df.withColumns({"source_file": F.col("_metadata.file_name"), "source_id": F.xxhash64(F.col("_metadata.file_path"))})

    batch = tagged(spark.read.schema(schema).option("header", True).options(**(options or {})).csv(paths))
    ids = [r[0] for r in tagged(spark.read.format("binaryFile").load(paths)).select("source_id").collect()]  # one row a given path
    now = dt.datetime.now(dt.timezone.utc)
    sinks.sink_run_by_day(score_batch(batch, _current(spark, model), prepare, require, keep), sink, run or f"again-{uuid.uuid4().hex}",
                          now.date(), note={"replaces": ids, "at": now.isoformat()})


def read_predictions(spark: SparkSession, sink: str) -> DataFrame:
    """The predictions that stand: all committed runs, and of files that were
    scored again the rows of the last time."""
    out = sinks.read_committed(spark, sink)
    again: dict[int, tuple[str, str]] = {}
    for key, entry in sinks._ledger(spark, sink).entries("done-").items():
        for i in entry.get("replaces", []):
            again[i] = max(again.get(i, ("", "")), (entry["at"], key[5:]))
    if not again:
        return out
    last = spark.createDataFrame([(i, run) for i, (_, run) in again.items()], "source_id bigint, __last string")
    return out.join(last, "source_id", "left").where("__last is null or __last = run").drop("__last")


def stream_update_model(spark: SparkSession, directory: str, schema: str, features: list[str], targets: list[str],
                        prepare: Prepare | None, model: str, checkpoint: str, max_files: int | None = None,
                        options: dict | None = None, interval: str | None = None, stream: str = "update",
                        start: ModelState | None = None):
    """L2: each batch's statistics are merged into the newest version of the
    model under ``model``, and the result is published as the next one (exact,
    replay-safe). ``start`` is what the first version takes over."""
    files, log = file_stream(spark, directory, schema, max_files, options), ModelLog(spark, model)

    def update(batch: DataFrame, batch_id: int) -> None:
        prepared = _prepared(batch, log.load() or start or ModelState(), prepare, [])
        if all(t in prepared.columns for t in targets):
            log.update(prepared, features, targets, stream, batch_id, start=start)

    return _trigger(files.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint), interval).start()


def model_batch(spark: SparkSession, batch: DataFrame, batch_id: int, features: list[str], targets: list[str],
                prepare: Prepare | None, model: str, sink: str, stream: str, require: str = "ts", keep: list[str] | None = None,
                run_date: dt.date | None = None, start: ModelState | None = None, ridge: float = 0.0) -> None:
    """One step of the loop: score with the newest version, then take the batch
    into it. Either part is done once, so a batch that comes again, on whatever
    day, does what an earlier attempt left undone and nothing else. The batches
    before the first version have no model to be scored with."""
    log = ModelLog(spark, model)
    state = log.load()
    if state is not None and state.coefs and state.applied.get(stream, -1) < batch_id:
        score_once(batch, f"{stream}-{batch_id}", state, prepare, sink, require, keep, run_date)
    prepared = _prepared(batch, state or start or ModelState(), prepare, keep or [])
    if all(t in prepared.columns for t in targets):
        log.update(prepared, features, targets, stream, batch_id, ridge, start)


def stream_model_loop(spark: SparkSession, directory: str, schema: str, features: list[str], targets: list[str],
                      prepare: Prepare | None, model: str, sink: str, checkpoint: str, require: str = "ts",
                      max_files: int | None = None, options: dict | None = None, interval: str | None = None,
                      keep: list[str] | None = None, stream: str = "loop", start: ModelState | None = None):
    """L1 and L2 together: each new file is scored by the model of the files
    before it, then updates the model, which is published for the next one."""
    files = file_stream(spark, directory, schema, max_files, options)

    def step(batch: DataFrame, batch_id: int) -> None:
        if require in batch.columns:
            batch = batch.persist()
            try:
                model_batch(spark, batch, batch_id, features, targets, prepare, model, sink, stream, require, keep, start=start)
            finally:
                batch.unpersist()

    return _trigger(files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint), interval).start()


def model_from_state(spark: SparkSession, model: str) -> dict:
    """The coefficients of the newest version."""
    return sinks.load_model_state(spark, model)[1]
