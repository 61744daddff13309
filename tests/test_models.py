"""Ledger, exactly-once runs, model versions and the streaming loop under retries, crashes and two writers."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from timefuse.functions import timeparse as tp
from timefuse.operators import linear
from timefuse.plans import preprocess, train
from timefuse.session import scratch_path
from timefuse.sources import sinks
from timefuse.sources.ledger import Ledger
from timefuse.sources.models import ModelLog, ModelState, TableLog
from timefuse.streaming import files as streams


def test_entries_are_written_once(spark):
    log = Ledger(spark, scratch_path(spark, "led"))
    assert log.get("a") is None and log.entries() == {} and log.keys() == []
    assert log.commit("a", {"d": 1}) == {"d": 1} and log.commit("a", {"d": 2}) == {"d": 1}
    assert not log._create("a.json", {"d": 3})  # a second writer that saw no entry
    for k in "cb":
        log.commit(k, {"é": k})
    log.compact()
    assert [n for n in log._names() if n.endswith(".json")] == [] and log.keys("b") == ["b"]
    assert log.commit("d", {}) == {} and log.commit("a", {"d": 4}) == {"d": 1}
    log.compact()
    log.compact()
    assert log.entries() == {"a": {"d": 1}, "b": {"é": "b"}, "c": {"é": "c"}, "d": {}} and len(log._names()) == 1
    with pytest.raises(ValueError):
        log.commit("../x", {})


def test_runs_count_once(spark):
    path = scratch_path(spark, "sink")
    df = spark.range(10).select("id", F.when(F.col("id") < 5, "day").otherwise("week").alias("forecast_period"))
    none = sinks.read_committed(spark, path, schema="id bigint")
    assert none.count() == 0 and "run" in none.columns
    assert sinks.sink_forecast_append(df, path, "one") and not sinks.sink_forecast_append(df, path, "one")
    assert sinks.sink_forecast_append(df.where("id < 3"), path, "7")  # a run name of digits stays text
    df.write.partitionBy("forecast_period").parquet(f"{path}/run=r-lost")  # an attempt that died before its commit
    sinks._ledger(spark, path).commit("begun-lost", {})
    got = sinks.read_committed(spark, path)
    assert got.count() == 13 and {r.run for r in got.select("run").distinct().collect()} == {"one", "7"}
    assert sinks.sink_forecast_append(df, path, "lost")  # tried again: its own folder is replaced
    assert sinks.read_committed(spark, path).count() == 23
    with pytest.raises(ValueError):
        sinks.append_run(df, path, "a/b")
    csv = scratch_path(spark, "csv-sink")
    assert sinks.sink_forecast_append(df, csv, "x", fmt="csv") and not sinks.sink_forecast_append(df, csv, "x", fmt="csv")
    assert sinks.read_committed(spark, csv, "csv").count() == 10


def test_a_replay_keeps_the_first_date(spark):
    path, df = scratch_path(spark, "sink"), spark.range(4)
    sinks._ledger(spark, path).commit("begun-b-0", {"run_date": "2024-01-01"})  # began before midnight, then died
    assert sinks.sink_run_by_day(df, path, "b-0", dt.date(2024, 1, 2))
    assert not sinks.sink_run_by_day(df, path, "b-0", dt.date(2024, 1, 3))
    assert [(r.run_date, r.n) for r in sinks.read_committed(spark, path).groupBy("run_date").agg(F.count("*").alias("n")).collect()] == [
        (dt.date(2024, 1, 1), 4)]


STATE = ModelState(coefs={"y": {"intercept": 1.0, "x": None}}, scaler={"x": (1.5, 0.0)}, target_scaler={"y": (None, 2.0)}, roles='{"a": 1}',
                   preparation="é", features=["x"], targets=["y"])


def test_versions(spark):
    log = ModelLog(spark, scratch_path(spark, "model"))
    assert log.load() is None and log.versions() == []
    assert log.publish(STATE) == 0
    assert log.publish(STATE) is None  # both writers began at nothing: the second must look again
    got = log.load()
    assert (got.coefs, got.scaler, got.target_scaler, got.roles, got.preparation, got.features, got.targets, got.version) == (
        STATE.coefs, STATE.scaler, STATE.target_scaler, STATE.roles, STATE.preparation, ["x"], ["y"], 0)
    got.coefs["y"]["x"] = 5.0
    assert log.publish(got) == 1 and log.load().coefs["y"]["x"] == 5.0 and log.load(0).coefs["y"]["x"] is None and log.load(9) is None
    log.drop_before(1)
    assert log.load().version == 1


def rows(spark, lo, hi):
    return spark.range(lo, hi).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2 + F.sin("id")).alias("y"))


def same(a, b):
    assert a["y"]["x"] == pytest.approx(b["y"]["x"]) and a["y"]["intercept"] == pytest.approx(b["y"]["intercept"])


def test_updates_are_exact_and_counted_once(spark, monkeypatch):
    log = ModelLog(spark, scratch_path(spark, "model"))
    log.update(rows(spark, 0, 50), ["x"], ["y"], "s", 0)
    for _ in range(2):
        log.update(rows(spark, 50, 80), ["x"], ["y"], "s", 1)
    log.update(rows(spark, 0, 50), ["x"], ["y"], "s", 0)  # an old batch comes again
    same(log.load().coefs, linear.fit_linear_multi(rows(spark, 0, 80), ["x"], ["y"])[0])
    assert log.load().version == 1 and log.load().applied == {"s": 1}
    # another writer publishes between this one's read and its publication
    publish, raced = ModelLog.publish, []

    def late(self, state, version=None):
        if not raced:
            raced.append(1)
            ModelLog(spark, log.path).update(rows(spark, 80, 100), ["x"], ["y"], "t", 0)
        return publish(self, state, version)

    monkeypatch.setattr(ModelLog, "publish", late)
    log.update(rows(spark, 100, 130), ["x"], ["y"], "s", 2)
    same(log.load().coefs, linear.fit_linear_multi(rows(spark, 0, 130), ["x"], ["y"])[0])
    assert log.load().version == 3 and log.load().applied == {"s": 2, "t": 0}


def test_empty_batches_change_no_coefficient(spark):
    log = ModelLog(spark, scratch_path(spark, "model"))
    log.update(rows(spark, 0, 0), ["x"], ["y"], "s", 0)
    log.update(rows(spark, 0, 9), ["x"], ["y"], "s", 1)
    before = log.load().coefs
    log.update(rows(spark, 0, 0), ["x"], ["y"], "s", 2)
    same(before, log.load().coefs)


def batch(spark, lo, hi):
    return rows(spark, lo, hi).withColumns({"ts": F.expr("timestamp_ntz'2024-01-01 00:00:00'"), "source_file": F.lit("f"), "source_id": F.lit(lo)})


def test_a_batch_that_died_between_its_two_parts(spark, monkeypatch):
    model, sink = scratch_path(spark, "model"), scratch_path(spark, "sink")
    step = lambda b, i, day: streams.model_batch(spark, b, i, ["x"], ["y"], lambda d: d, model, sink, "loop", keep=["x"], run_date=dt.date(2024, 1, day))
    step(batch(spark, 0, 10), 0, 1)  # no model yet: nothing to score with
    first = sinks.load_model(spark, model).coefs
    with monkeypatch.context() as m:
        m.setattr(ModelLog, "update", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("died")))
        with pytest.raises(RuntimeError):
            step(batch(spark, 10, 30), 1, 1)
    for day in (2, 3):
        step(batch(spark, 10, 30), 1, day)
    step(batch(spark, 0, 10), 0, 4)
    got = streams.read_predictions(spark, sink).collect()
    assert len(got) == 20 and {r.run_date for r in got} == {dt.date(2024, 1, 1)}
    assert all(r.pred_y == pytest.approx(first["y"]["intercept"] + first["y"]["x"] * r.x) for r in got)
    same(sinks.load_model(spark, model).coefs, linear.fit_linear_multi(rows(spark, 0, 30), ["x"], ["y"])[0])
    assert sinks.load_model(spark, model).version == 1


def test_scoring_needs_a_version(spark):
    with pytest.raises(ValueError, match="no model"):
        streams._current(spark, scratch_path(spark, "none"))
    with pytest.raises(ValueError, match="no trained model"):
        train.stored(spark, scratch_path(spark, "none"))


def test_trained_model_goes_through_its_stored_preparation(spark):
    df = spark.range(200).select(
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(id as int))").alias("ts"), "id",
        F.when(F.col("id") % 5 != 0, F.col("id") * 3.0).alias("x"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("kind"),
        F.when(F.col("id") % 7 != 0, F.col("id") * 10.0 + F.when(F.col("id") % 3 == 0, 5).otherwise(0)).alias("y"))
    path = scratch_path(spark, "model")
    roles = preprocess.Roles(targets=["y"], numeric=["x", "w"], categorical=["kind"], order_by=["ts"])
    assert train.train(spark, df.withColumn("w", F.lit(None).cast("double")), roles, path) == 0
    model, state = train.stored(spark, path)
    assert state.dropped == ["w"] and state.features[0] == "x" and model.statistics is not None
    batch_ = df.withColumns({"source_file": F.lit("f"), "source_id": F.lit(1)})
    scored = streams.score_batch(batch_, model, None, keep=["id"]).collect()
    assert len(scored) == 200 and all(abs(r.pred_y - (r.id * 10 + (5 if r.id % 3 == 0 else 0))) < 60 for r in scored)
    day = train.predict_day(spark, path, train.load_sources_for_date(df, [], "2024-01-02"), ["ts"]).collect()
    assert [r.ts for r in day] == [dt.datetime(2024, 1, 2)]
    assert train.predict_day(spark, path, train.load_sources_for_date(df, [], "2030-01-02"), ["ts"]).count() == 0
    fut = train.forecast(spark, path, dt.datetime(2024, 2, 1), ["y", "other"], hours=30)
    assert fut.count() == 30 and fut.where("y is null or other <> 0").count() == 0


def test_states_survive_json():
    s = preprocess.PreprocessState(preprocess.Roles(["t"], ["x"], prose=["p"], time_text="T"), ["l"], [], {"x": (1.0, 2.0)}, {"c": ["é"]}, ["x"], True, "model",
                                   {"means": {"x": 1.0}, "models": {"x": {"intercept": 0.5, "z": 1.0}}}, {"c": "é"}, {"p": [["w", 1.5]]}, ["n"])
    assert preprocess.PreprocessState.from_json(s.to_json()) == s


def test_tables_are_versioned(spark):
    log = TableLog(spark, scratch_path(spark, "tables"))
    assert log.load() is None
    log.publish(spark.range(3))
    assert log.publish(spark.range(5)).count() == 5 and log.load(0).count() == 3 and log.load(4) is None


def test_calendar_is_unchanged_by_default(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 5, 6, 7),)], "ts timestamp_ntz")
    st = preprocess.fit(df, preprocess.Roles(targets=[], numeric=[]), fill=False)
    assert st.features == preprocess.CALENDAR and tp.calendar_parts(df).first().hour == 7
