"""The model's life: train on combined rows, store a version, forecast from it (M1, M5, M8, K3, K4).

``train`` fits the preparation, scales the targets, fits one linear model per
target and publishes everything as one version (``sources.models``).
``forecast`` and ``predict_day`` read a version back and nothing else: the rows
go through the stored preparation, the model, and the targets' own units.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as fc
from ..operators import align, encode, linear, schema
from ..sources import sinks
from ..sources.models import ModelState
from ..sources.scan import load_for_date
from . import preprocess
from .forecast import HORIZON_HOURS, future_hours


def train(spark: SparkSession, df: DataFrame, roles: preprocess.Roles, path: str, fill: str = "model", rename: bool = False,
          terms: int = 0, ridge: float = 0.0) -> int | None:
    """Fit on the rows of ``df`` whose targets are known and publish the next
    version under ``path``; its number."""
    state = preprocess.fit(df, roles, fill, rename, terms)
    rows = preprocess.transform(df, state)
    targets = [t for t in roles.targets if t in rows.columns]
    rows = rows.dropna(how="any", subset=targets)
    scaler = encode.fit_scaler(rows, targets)
    coefs, stats = linear.fit_linear_multi(encode.standard_scale(rows, scaler), state.features, targets, ridge)
    return sinks.sink_model_state(spark, path, coefs, state.scaler, None, target_scaler=scaler, preparation=state.to_json(), statistics=stats)


def stored(spark: SparkSession, path: str, version: int | None = None) -> tuple[ModelState, preprocess.PreprocessState]:
    """A version and its preparation; an error if there is none."""
    model = sinks.load_model(spark, path, version)
    if model is None or model.preparation is None:
        raise ValueError(f"no trained model in {path}")
    return model, preprocess.PreprocessState.from_json(model.preparation)


def predict(df: DataFrame, model: ModelState, state: preprocess.PreprocessState, keep: list[str]) -> DataFrame:
    """``keep`` and a prediction of each target in its own units."""
    rows = preprocess.transform(df, state, keep=keep).select(*keep, *state.features)
    out = linear.predict_linear(rows, model.coefs).select(*keep, *model.coefs)
    return encode.inverse_scale(out, {t: s for t, s in model.target_scaler.items() if t in model.coefs})


def forecast(spark: SparkSession, path: str, start, targets: list[str], hours: int = HORIZON_HOURS,
             version: int | None = None) -> DataFrame:
    """M8 with everything stored: the next ``hours`` hours through the scaler of
    the features (those that no future hour has at their defaults), the model
    and the scaler of the targets; targets without a model are 0."""
    model, state = stored(spark, path, version)
    rows = future_hours(spark, start, hours).select("datetime").withColumnRenamed("datetime", state.roles.time_key)
    out = schema.pad_targets(predict(rows, model, state, [state.roles.time_key]), targets)
    return out.select(F.col(state.roles.time_key).alias("datetime"), *[fc.clean_nonfinite(F.col(t)).alias(t) for t in targets])


def forecast_json(spark: SparkSession, path: str, start, targets: list[str], sink: str, hours: int = HORIZON_HOURS) -> None:
    """``forecast`` written as JSON lines by time (K3)."""
    sinks.sink_json_by_time(forecast(spark, path, start, targets, hours), sink)


def load_sources_for_date(base: DataFrame, sources: list[tuple], day, key: str = "ts") -> DataFrame:
    """S7 over several sources: the base rows of one day, each with the day's
    aggregate of every source. ``sources`` are (name, rows, aggregate): the day
    is cut out of the rows before the aggregate, so each scan is pruned by it."""
    out = load_for_date(base, day, key)
    for name, rows, aggregate in sources:
        daily = load_for_date(rows, day, key, aggregate)
        if not daily.isEmpty():
            out = align.align_left_join(out, daily, name, key)
    return out


def predict_day(spark: SparkSession, path: str, rows: DataFrame, order_by: list[str], version: int | None = None) -> DataFrame:
    """M5: the prediction of a day's first row (``load_sources_for_date``) by the
    stored model; ``order_by`` must be an order without ties. No rows give an empty frame."""
    model, state = stored(spark, path, version)
    return predict(rows, model, state, order_by).orderBy(*order_by).limit(1)
