"""Column-level schema work (P1-P11). Plan-time selections; no data pass
except where a column decision needs one (all-null, numeric check)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference: source column spelling ->
# standard name, in its original order. ``wind_speed`` appears twice; as in a
# Python dict literal the later entry wins.
# ---------------------------------------------------------------------------
REFERENCE_COLUMN_NAMES = [
    ("dt", "UNIX_TIMESTAMP"), ("dt_iso", "UTC_DATE"), ("timezone", "TIMEZONE"),
    ("city_name", "CITY_NAME"), ("visability", "visibility"), ("dew_point", "dew_point_temp"),
    ("feels_like", "feels_like"), ("temp_min", "temp_min"), ("temp_max", "temp_max"),
    ("pressure", "pressure_average"), ("sea_level", "sea_level"), ("grnd_level", "grnd_level"),
    ("humidity", "humidity"), ("wind_speed", "wind_speed"), ("wind_deg", "wind_deg"),
    ("wind_gust", "wind_gust"), ("rain_1h", "rain_1h"), ("rain_3h", "rain_3h"),
    ("snow_1h", "snow_1h"), ("snow_3h", "snow_3h"), ("clouds_all", "clouds_all"),
    ("weather_id", "weather_id"), ("weather_main", "weather_main"),
    ("weather_description", "weather_description"), ("weather_icon", "weather_icon"),
    ("UTC_DATE", "UTC_DATE"), ("LOCAL_DATE", "LOCAL_DATE"), ("UTC_YEAR", "UTC_YEAR"),
    ("UTC_MONTH", "UTC_MONTH"), ("UTC_DAY", "UTC_DAY"), ("LOCAL_YEAR", "LOCAL_YEAR"),
    ("LOCAL_MONTH", "LOCAL_MONTH"), ("LOCAL_DAY", "LOCAL_DAY"), ("LOCAL_HOUR", "LOCAL_HOUR"),
    ("date", "UTC_DATE"), ("startTime", "UTC_DATE"), ("eventTime", "UTC_DATE"),
    ("beginTime", "UTC_DATE"), ("peakTime", "UTC_DATE"), ("endTime", "UTC_DATE"),
    ("submissionTime", "UTC_DATE"), ("time21_5", "UTC_DATE"), ("messageIssueTime", "UTC_DATE"),
    ("modelCompletionTime", "UTC_DATE"), ("temperature_average", "temperature_average"),
    ("temperature_min", "temperature_min"), ("temperature_max", "temperature_max"),
    ("temp", "temperature_average"), ("temperature", "temperature_average"),
    ("Temperature", "temperature_average"), ("Temp (°C)", "temperature_average"),
    ("dew_point_temp", "dew_point_temp"), ("dew_point_temp_flag", "dew_point_temp_flag"),
    ("wind_speed_average", "wind_speed_average"), ("wind_speed_min", "wind_speed_min"),
    ("wind_speed_max", "wind_speed_max"), ("wind_speed", "wind_speed_average"),
    ("Wind Speed", "wind_speed_average"), ("Wind Speed (km/h)", "wind_speed_average"),
    ("station_pressure", "station_pressure"), ("pressure_average", "pressure_average"),
    ("pressure_min", "pressure_min"), ("pressure_max", "pressure_max"),
    ("sourceLocation", "source_location"), ("location", "location"),
    ("activityID", "activity_id"), ("CME_ID", "cme_id"), ("flrID", "flr_id"),
    ("gstID", "gst_id"), ("hssID", "hss_id"), ("mpcID", "mpc_id"), ("rbeID", "rbe_id"),
    ("sepID", "sep_id"), ("simulationID", "simulation_id"), ("messageID", "message_id"),
    ("messageType", "message_type"), ("messageURL", "message_url"), ("sol", "sol"),
    ("catalog", "catalog"), ("cmeAnalyses", "cme_analyses"), ("linkedEvents", "linked_events"),
    ("note", "note"), ("versionId", "version_id"), ("link", "link"),
    ("isMostAccurate", "is_most_accurate"), ("associatedCMEID", "associated_cme_id"),
    ("featureCode", "feature_code"), ("dataLevel", "data_level"),
    ("measurementTechnique", "measurement_technique"), ("imageType", "image_type"),
    ("tilt", "tilt"), ("minorHalfWidth", "minor_half_width"),
    ("speedMeasuredAtHeight", "speed_measured_at_height"), ("latitude", "latitude"),
    ("longitude", "longitude"), ("halfAngle", "half_angle"), ("speed", "speed"),
    ("type", "type"), ("au", "au"), ("cmeInputs", "cme_inputs"),
    ("estimatedShockArrivalTime", "estimated_shock_arrival_time"),
    ("estimatedDuration", "estimated_duration"), ("rmin_re", "rmin_re"), ("kp_18", "kp_18"),
    ("kp_90", "kp_90"), ("kp_135", "kp_135"), ("kp_180", "kp_180"),
    ("isEarthGB", "is_earth_gb"), ("impactList", "impact_list"),
]

# The standard names that are regression targets.
REFERENCE_TARGETS = [
    "visibility", "dew_point_temp", "feels_like", "temp_min", "temp_max",
    "pressure_average", "humidity", "wind_speed", "wind_deg", "wind_gust",
    "clouds_all", "weather_id", "weather_main", "weather_description", "weather_icon",
]


def standard_mapping() -> dict[str, str]:
    return dict(REFERENCE_COLUMN_NAMES)


def rename_plan(columns: list[str], mapping: dict[str, str]) -> list[tuple[str, str]]:
    """(source, target) pairs; for a many-to-one rename the first column wins."""
    seen, plan = set(), []
    for c in columns:
        t = mapping.get(c, c)
        if t in seen:
            continue
        seen.add(t)
        plan.append((c, t))
    return plan


def rename_columns(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """P1 + P2: rename by the synonym table, keeping the first of colliding columns."""
    m = standard_mapping() if mapping is None else mapping
    return df.select(*[F.col(f"`{s}`").alias(t) for s, t in rename_plan(df.columns, m)])


def dedupe_columns(df: DataFrame, mapping: dict[str, str], mode: str = "first") -> DataFrame:
    """Many-to-one rename; ``first`` keeps the first physical column,
    ``coalesce`` takes the first non-null among the colliding ones."""
    if mode == "first":
        return rename_columns(df, mapping)
    groups: dict[str, list[str]] = {}
    for c in df.columns:
        groups.setdefault(mapping.get(c, c), []).append(c)
    return df.select(*[(F.coalesce(*[F.col(s) for s in srcs]) if len(srcs) > 1 else F.col(srcs[0])).alias(t)
                       for t, srcs in groups.items()])


def non_null_counts_row(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in cols])


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """One aggregate decides which columns hold no value at all."""
    counts = non_null_counts_row(df, df.columns).first().asDict()
    return df.select(*[f"`{c}`" for c in df.columns if counts[c] > 0])


def add_default_columns(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """P5: absent numeric feature -> 0, absent categorical -> 'missing'."""
    have = set(df.columns)
    adds = {c: F.lit(0.0) for c in numeric if c not in have}
    adds.update({c: F.lit("missing") for c in categorical if c not in have})
    return df.withColumns(adds) if adds else df


def split_features_targets(df: DataFrame, targets: list[str]) -> tuple[DataFrame, DataFrame]:
    """(features, targets present). Same lineage, so the two can be
    recombined by ``withColumns`` and never by position."""
    t = [c for c in targets if c in df.columns]
    return df.select(*[c for c in df.columns if c not in t]), df.select(*t)


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in exclude]


def string_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, StringType) and f.name not in exclude]


def numeric_only(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Keep numeric columns (plus ``keep``, e.g. the time key)."""
    cols = [c for c in df.columns if c in keep or c in numeric_columns(df)]
    return df.select(*cols)


def conform_schema(df: DataFrame, required: list[str], fill=0.0) -> DataFrame:
    """Exactly ``required`` in that order, absent columns as ``fill``."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(fill).alias(c) for c in required])


def tag_lineage(df: DataFrame, tags: dict, source_file: bool = False) -> DataFrame:
    """Constant tags plus, optionally, the scanned file's name."""
    cols = {k: (v if hasattr(v, "_jc") else F.lit(v)) for k, v in tags.items()}
    if source_file:
        cols["source_file"] = F.col("_metadata.file_name")
    return df.withColumns(cols)


def pad_targets(df: DataFrame, targets: list[str]) -> DataFrame:
    """P10: every target column present; missing ones are 0.0."""
    return df.withColumns({t: F.lit(0.0) for t in targets if t not in df.columns})


def concat_columns(df: DataFrame, derived: dict) -> DataFrame:
    """Horizontal concat of columns derived from the same rows."""
    return df.withColumns(derived)
