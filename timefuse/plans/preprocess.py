"""Feature preparation as fit / transform.

``fit`` takes the data passes that decide columns and statistics (one aggregate
each) and returns a small, serialisable state. ``transform`` applies it: a plan
of expressions over the rows, the same for a batch, a stream and a forecast. It
looks at no data, but for the one case that must: a state with ``fill`` =
"order" carries values along the rows' order, which takes the order's summary.

The chain, with the reference's ordering quirks fixed: rename to the standard
vocabulary -> parse the time key, drop rows without one -> calendar parts ->
JSON first fields -> link / digit rules and TF-IDF of text -> drop columns
without any value, rows without a target (in ``fit``) -> defaults for absent
features -> unknown cells (by regression and mode, or along the order) ->
scaling and one-hot -> non-finite cells to 0.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as fc
from ..functions import timeparse as tp
from ..functions.jsoncols import REFERENCE_JSON_FIELDS, extract_reference_json_features
from ..operators import encode, impute, profile, schema, text
from ..operators.impute import fill_both
from ..session import written

CALENDAR = ["year", "month", "day", "hour", "day_of_week"]


@dataclass
class Roles:
    """Column roles; ordered lists, so output column order is stable.

    ``text`` columns follow the link and digit rules, ``prose`` columns TF-IDF.
    ``time_text`` is a column of time texts that ``time_key`` is parsed from;
    ``calendar`` are the parts of the time key that are features."""
    targets: list[str]
    numeric: list[str]
    categorical: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    time_key: str = "ts"
    order_by: list[str] = field(default_factory=lambda: ["ts"])
    prose: list[str] = field(default_factory=list)
    time_text: str | None = None
    calendar: list[str] = field(default_factory=lambda: list(CALENDAR))


@dataclass
class PreprocessState:
    roles: Roles
    link_cols: list[str]
    digit_cols: list[str]
    scaler: dict[str, tuple[float, float]]
    categories: dict[str, list]
    features: list[str]
    rename: bool = False
    fill: str = "order"
    imputer: dict = field(default_factory=lambda: {"means": {}, "models": {}})
    modes: dict[str, str] = field(default_factory=dict)
    vocabulary: dict[str, list] = field(default_factory=dict)
    dropped: list[str] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> "PreprocessState":
        d = json.loads(text)
        d["roles"] = Roles(**d["roles"])
        d["scaler"] = {k: tuple(v) for k, v in d["scaler"].items()}
        return PreprocessState(**d)


def _timed(df: DataFrame, roles: Roles, rename: bool) -> DataFrame:
    """Renamed rows with their time key, those without one left out."""
    out = schema.rename_columns(df) if rename else df
    if roles.time_text and roles.time_text in out.columns:
        out = tp.standardize_time(out, roles.time_text, roles.time_key).drop(roles.time_text)
    return out


def _base_features(df: DataFrame, roles: Roles, link_cols, digit_cols) -> DataFrame:
    out = extract_reference_json_features(df)
    if roles.time_key in df.columns:
        out = tp.calendar_parts(out, roles.time_key)
    out = out.withColumns({c: fc.link_flag(F.col(c)).cast("double") for c in link_cols if c in out.columns})
    out = out.withColumns({c: fc.first_number(F.col(c)) for c in digit_cols if c in out.columns})
    return out


def top_terms(df: DataFrame, col: str, k: int) -> list[tuple[str, float]]:
    """The ``k`` terms of a text column with the most occurrences (ties: the
    smaller term), with their idf: what the driver receives is ``k`` rows."""
    counts = written(df.sparkSession, df.select(text.counted_terms(col).alias("terms")), "term-counts")
    often = counts.select(F.explode("terms").alias("t")).groupBy("t.term").agg(F.sum("t.tf").alias("n"), F.count(F.lit(1)).alias("df"))
    rows, n = often.orderBy(F.desc("n"), "term").limit(k).collect(), counts.count()
    import math
    return [(r["term"], math.log((1 + n) / (1 + r["df"])) + 1) for r in rows]


def _prose_features(df: DataFrame, col: str, vocabulary: list) -> DataFrame:
    """TF-IDF over a fixed list of terms as columns ``col_term``, made inside the row."""
    if not vocabulary:
        return df
    counts = F.map_from_entries(text.counted_terms(col)) if col in df.columns else F.create_map().cast("map<string,bigint>")
    df = df.withColumn("__counts", counts)
    raw = {t: F.coalesce(F.element_at("__counts", F.lit(t)), F.lit(0)) * F.lit(idf) for t, idf in vocabulary}
    norm = F.sqrt(sum((w * w for w in raw.values()), F.lit(0.0)))
    df = df.withColumn("__norm", norm)
    return df.withColumns({f"{col}_{t}": F.when(F.col("__norm") > 0, w / F.col("__norm")).otherwise(0.0) for t, w in raw.items()}) \
        .drop("__counts", "__norm")


def _shaped(df: DataFrame, state: PreprocessState) -> DataFrame:
    """Everything before unknown cells are filled."""
    out = _base_features(_timed(df, state.roles, state.rename), state.roles, state.link_cols, state.digit_cols)
    for c, vocabulary in state.vocabulary.items():
        out = _prose_features(out, c, vocabulary)
    return out


def _filled(df: DataFrame, state: PreprocessState, numeric: list[str]) -> DataFrame:
    roles = state.roles
    if state.fill == "order" and numeric and all(c in df.columns for c in roles.order_by):
        return fill_both(df, numeric, roles.order_by)
    if state.fill == "model":
        df = impute.apply_imputer(df, state.imputer, [c for c in numeric if c in df.columns])
        df = df.withColumns({c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(m)) for c, m in state.modes.items() if c in df.columns})
    return df


def fit(df: DataFrame, roles: Roles, fill: bool | str = True, rename: bool = False, terms: int = 0) -> PreprocessState:
    """Decide columns, models of unknown cells, scaler statistics and categories.

    ``fill``: "order" (or True) carries known values along ``order_by``, "model"
    predicts unknown numbers from the other numeric columns and takes the most
    frequent category, False leaves them. ``terms`` is the number of TF-IDF
    columns of each prose column. Rows with an unknown target are left out."""
    fill = {True: "order", False: "none"}.get(fill, fill)
    df = _timed(df, roles, rename)
    if rename or roles.time_text:
        df = written(df.sparkSession, df, "timed-rows")
    targets = [t for t in roles.targets if t in df.columns]
    if fill == "model" and targets:
        df = df.dropna(how="any", subset=targets)
    cells = [c for c in roles.text if c in df.columns and c not in REFERENCE_JSON_FIELDS]
    links = []
    if cells:
        flags = profile.contains_any(df, cells).collect()
        links = [r.column_name for r in flags if r.has_marker]
    digits = [c for c in cells if c not in links]
    vocabulary = {c: top_terms(df, c, terms) for c in roles.prose if c in df.columns and terms}
    state = PreprocessState(roles, links, digits, {}, {}, [], rename, fill, vocabulary=vocabulary)
    base = _base_features(df, roles, links, digits)
    for c, words in vocabulary.items():
        base = _prose_features(base, c, words)
    json_feats = [f"{p}{f}" for c, (p, fs) in REFERENCE_JSON_FIELDS.items() if c in df.columns for f in fs]
    numeric = [c for c in [*roles.numeric, *json_feats, *links, *digits]
               if c in base.columns and c not in roles.targets]
    categorical = [c for c in roles.categorical if c in base.columns]
    if fill == "model":
        # several passes follow: times, texts and terms are parsed once
        base = written(df.sparkSession, base, "base-features")
    if fill == "model" and [*numeric, *categorical]:
        known = base.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in [*numeric, *categorical]]).first()
        state.dropped = [c for c in [*numeric, *categorical] if not known[c]]
        numeric, categorical = ([c for c in cs if c not in state.dropped] for cs in (numeric, categorical))
    if roles.time_key in df.columns:
        numeric += [c for c in roles.calendar if c not in numeric]
    prose = [f"{c}_{t}" for c, words in vocabulary.items() for t, _ in words]
    if fill == "model":
        own = [c for c in roles.numeric if c in numeric]
        models = impute.fit_imputer(base, own, own)
        rest = [c for c in numeric if c not in models["means"]]
        if rest:
            r = profile.column_means(base, rest).first()
            models["means"] |= {c: r[c] for c in rest if r[c] is not None}
        state.imputer = models
        state.modes = {r["column_name"]: r["mode"] for r in profile.mode_values(base, categorical).collect()} if categorical else {}
    # the scaler and the categories see what transform makes of the rows
    filled = _filled(base, state, numeric)
    state.scaler = encode.fit_scaler(filled, [*numeric, *prose]) if numeric or prose else {}
    state.categories = {c: encode.fitted_categories(filled, c) for c in categorical}
    state.features = [*numeric, *prose, *[f"{c}_{v}" for c, vs in state.categories.items() for v in vs]]
    return state


def transform(df: DataFrame, state: PreprocessState, fill: bool | None = None, keep: list[str] | None = None) -> DataFrame:
    """Apply the fitted preparation; returns ``keep`` + features + present
    targets. ``fill=False`` leaves unknown cells to the last step (they become 0)."""
    roles = state.roles
    out = _shaped(df, state)
    numeric = list(state.scaler)
    out = out.withColumns({c: F.lit(0.0) for c in numeric if c not in out.columns})
    out = out.withColumns({c: F.lit("missing") for c in state.categories if c not in out.columns})
    out = out.drop(*[c for c in REFERENCE_JSON_FIELDS if c in out.columns])
    if fill is not False:
        out = _filled(out, state, numeric)
    out = encode.standard_scale(out, state.scaler)
    for c, vs in state.categories.items():
        out = encode.one_hot_ignore_unknown(out, c, vs)
    out = out.withColumns({c: fc.clean_nonfinite(F.col(c)) for c in state.features})
    keep = keep or []
    targets = [t for t in roles.targets if t in out.columns]
    return out.select(*keep, *state.features, *targets)
