"""Registered queries: alignment, time, schema, filters (with DuckDB oracles)."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as fc
from .functions import jsoncols as fj
from .functions import timeparse as tp
from .operators import align, filters, schema
from .catalog import register
from .sources import scan
from .tables import load, r6, rounded

LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
          "l_extendedprice", "l_discount", "l_tax"]


def _avg_sql(cols, src=""):
    return ", ".join(f"avg({src}{c}) AS {c}" for c in cols)


def _r6_sql(cols, src, prefix=""):
    return ", ".join(f"round({src}.{c}, 6) + 0.0 AS {prefix}{c}" for c in cols)


LI_DAILY_CTE = f"""
li_day AS (SELECT CAST(l_shipdate AS DATE) AS d, {_avg_sql(LI_NUM)}
           FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1),
li_spine AS (SELECT CAST(unnest(generate_series(CAST(min(d) AS TIMESTAMP), CAST(max(d) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d FROM li_day),
li_daily AS (SELECT CAST(s.d AS TIMESTAMP) AS ts, {", ".join("li_day." + c for c in LI_NUM)}
             FROM li_spine s LEFT JOIN li_day ON s.d = li_day.d)
"""


def lineitem_ts(spark, sf):
    return schema.rename_columns(load(spark, sf, "lineitem"), {"l_shipdate": "ts"})


def orders_ts(spark, sf):
    return schema.rename_columns(load(spark, sf, "orders"), {"o_orderdate": "ts"})


def events_gappy(spark, sf):
    """Events where an ``error`` event carries no value (the null fixture)."""
    e = load(spark, sf, "events")
    return e.withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))


EVENTS_GAPPY_SQL = "SELECT event_id, ts, user_id, event_type, CASE WHEN event_type <> 'error' THEN value END AS value, props FROM events"

# ---------------------------------------------------------------------------
# The flagship (M12 core): base series left-joined to the daily
# mean of an irregular source, plus calendar parts.
# ---------------------------------------------------------------------------
FLAGSHIP_SQL = f"""
WITH {LI_DAILY_CTE}
SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, o.o_totalprice, o.o_orderdate AS ts, o.o_orderpriority,
       {_r6_sql(LI_NUM, "li_daily", "lineitem_")},
       CAST(year(o.o_orderdate) AS INTEGER) AS year, CAST(month(o.o_orderdate) AS INTEGER) AS month,
       CAST(day(o.o_orderdate) AS INTEGER) AS day, CAST(hour(o.o_orderdate) AS INTEGER) AS hour,
       CAST(isodow(o.o_orderdate) - 1 AS INTEGER) AS day_of_week
FROM orders o LEFT JOIN li_daily ON o.o_orderdate = li_daily.ts
"""


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    daily = align.daily_mean(lineitem_ts(spark, sf))
    joined = align.multi_left_join(orders_ts(spark, sf), [("lineitem", daily)])
    out = tp.calendar_parts(joined)
    return rounded(out, [f"lineitem_{c}" for c in LI_NUM])


register("load_and_combine", FLAGSHIP_SQL)(flagship)


@register("daily_mean", f"WITH {LI_DAILY_CTE} SELECT ts, {_r6_sql(LI_NUM, 'li_daily')} FROM li_daily")
def q_daily_mean(spark, sf):
    return rounded(align.daily_mean(lineitem_ts(spark, sf)), LI_NUM)


EV_NUM = ["event_id", "user_id", "value"]
EV_CATS = ["click", "error", "purchase", "signup"]


@register("daily_mean_by_category", f"""
WITH e AS (SELECT event_type AS category, year(ts) AS yr, CAST(ts AS DATE) AS d, {_avg_sql(EV_NUM)}
           FROM events WHERE ts IS NOT NULL AND event_type IN ({", ".join(repr(c) for c in EV_CATS)}) GROUP BY ALL),
b AS (SELECT category, yr, min(d) AS lo, max(d) AS hi FROM e GROUP BY ALL),
s AS (SELECT category, yr, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d FROM b)
SELECT s.category AS event_type, CAST(s.yr AS INTEGER) AS year, CAST(s.d AS TIMESTAMP) AS ts, {_r6_sql(EV_NUM, "e")}
FROM s LEFT JOIN e ON s.category = e.category AND s.yr = e.yr AND s.d = e.d
""")
def q_daily_mean_by_category(spark, sf):
    out = align.daily_mean_by_category(load(spark, sf, "events"), "event_type", cols=EV_NUM, allowed=EV_CATS)
    return rounded(out, EV_NUM)


@register("multi_left_join", f"""
WITH {LI_DAILY_CTE},
od AS (SELECT CAST(o_orderdate AS DATE) AS d, avg(o_totalprice) AS o_totalprice FROM orders GROUP BY 1),
osp AS (SELECT CAST(unnest(generate_series(CAST(min(d) AS TIMESTAMP), CAST(max(d) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d FROM od),
o_daily AS (SELECT CAST(osp.d AS TIMESTAMP) AS ts, od.o_totalprice FROM osp LEFT JOIN od ON osp.d = od.d)
SELECT o.o_orderkey, o.o_orderdate AS ts, o.o_totalprice,
       {_r6_sql(["l_quantity", "l_extendedprice"], "li_daily", "lineitem_")},
       round(o_daily.o_totalprice, 6) + 0.0 AS ordersday_o_totalprice
FROM orders o LEFT JOIN li_daily ON o.o_orderdate = li_daily.ts LEFT JOIN o_daily ON o.o_orderdate = o_daily.ts
""")
def q_multi_left_join(spark, sf):
    li = align.daily_mean(lineitem_ts(spark, sf), cols=["l_quantity", "l_extendedprice"])
    od = align.daily_mean(orders_ts(spark, sf), cols=["o_totalprice"])
    base = orders_ts(spark, sf).select("o_orderkey", "ts", "o_totalprice")
    out = align.multi_left_join(base, [("lineitem", li), ("ordersday", od)])
    return rounded(out, ["lineitem_l_quantity", "lineitem_l_extendedprice", "ordersday_o_totalprice"])


@register("align_left_join", """
WITH d AS (SELECT CAST(ts AS DATE) AS d, avg(user_id) AS user_id, avg(value) AS value FROM events GROUP BY 1)
SELECT e.event_id, e.ts, e.user_id, e.event_type, e.value, e.props,
       round(d.user_id, 6) + 0.0 AS daily_user_id, round(d.value, 6) + 0.0 AS daily_value
FROM events e LEFT JOIN d ON CAST(e.ts AS DATE) = d.d
""")
def q_align_left_join(spark, sf):
    ev = load(spark, sf, "events")
    daily = align.daily_mean(ev, cols=["user_id", "value"])
    out = align.align_left_join(ev, daily, "daily")
    return rounded(out, ["daily_user_id", "daily_value"])


UNION_SQL = """(SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer)
 UNION ALL BY NAME (SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier)"""


def cust_supp(spark, sf):
    return scan.union_by_name([load(spark, sf, "customer"), load(spark, sf, "supplier")])


@register("union_by_name", f"SELECT * FROM ({UNION_SQL})")
def q_union_by_name(spark, sf):
    return cust_supp(spark, sf)


@register("null_safe_left_join", f"""
WITH u AS ({UNION_SQL}), seg AS (SELECT c_mktsegment, count(*) AS n FROM u GROUP BY 1)
SELECT u.*, seg.n AS segment_n FROM u LEFT JOIN seg ON u.c_mktsegment IS NOT DISTINCT FROM seg.c_mktsegment
""")
def q_null_safe_left_join(spark, sf):
    u = cust_supp(spark, sf)
    seg = u.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return align.null_safe_left_join(u, seg, "segment", key="c_mktsegment")


# ---------------------------------------------------------------------------
# Time functions
# ---------------------------------------------------------------------------
@register("strip_utc_suffix", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS utc_text FROM events")
def q_strip_utc_suffix(spark, sf):
    ev = load(spark, sf, "events")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" +0000 UTC"))
    return ev.select("event_id", tp.strip_utc_suffix(text).alias("utc_text"))


@register("normalize_separators", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS utc_text FROM events")
def q_normalize_separators(spark, sf):
    ev = load(spark, sf, "events")
    text = F.concat(F.lit(" "), F.date_format("ts", "yyyy/MM/dd HH:mm:ss"), F.lit(" "))
    return ev.select("event_id", tp.normalize_separators(text).alias("utc_text"))


@register("parse_epoch", "SELECT event_id, date_trunc('second', ts) AS parsed FROM events")
def q_parse_epoch(spark, sf):
    ev = load(spark, sf, "events")
    text = tp.to_epoch(F.col("ts")).cast("string")
    return ev.select("event_id", tp.parse_epoch(text).cast("timestamp_ntz").alias("parsed"))


_FMTS = tp.reachable_formats()
_N_FMT = len(_FMTS)
_AMBIGUOUS = [i for i, f in enumerate(_FMTS) if f.startswith("%m-%d-%Y")]


def _expected_sql(ts: str, idx: str) -> str:
    """DuckDB expression for what a time rendered in format ``idx`` parses back to."""
    whens = []
    for i, f in enumerate(_FMTS):
        p = tp.format_precision(f)
        val = ts if p == "micros" else f"date_trunc('{p}', {ts})"
        if i in _AMBIGUOUS:  # month-first text read day-first when the day is <= 12
            val = (f"CASE WHEN day({ts}) <= 12 THEN make_timestamp(year({ts}), day({ts}), month({ts}), "
                   f"hour({ts}), minute({ts}), CAST(second({ts}) AS DOUBLE)) ELSE date_trunc('second', {ts}) END")
        whens.append(f"WHEN {idx} = {i} THEN {val}")
    return "CASE " + " ".join(whens) + " END"


def render_round_robin(ts_col: str, idx_col: str):
    """Text of ``ts_col`` in the format chosen by ``idx_col`` (one per row)."""
    return _render_round_robin(ts_col, idx_col, tp.jvm_id())


@lru_cache(maxsize=16)
def _render_round_robin(ts_col: str, idx_col: str, jvm: int):
    ts = F.col(ts_col).cast("timestamp")
    expr = None
    for i, f in enumerate(_FMTS):
        text = F.date_format(ts, tp.render_pattern(f))
        expr = F.when(F.col(idx_col) == i, text) if expr is None else expr.when(F.col(idx_col) == i, text)
    return expr


@register("parse_multi_format", f"""
SELECT event_id, CAST(event_id % {_N_FMT} AS INTEGER) AS fmt, {_expected_sql("ts", f"event_id % {_N_FMT}")} AS parsed FROM events
""")
def q_parse_multi_format(spark, sf):
    ev = load(spark, sf, "events").withColumn("fmt", (F.col("event_id") % _N_FMT).cast("int"))
    staged = ev.select("event_id", "fmt", render_round_robin("ts", "fmt").alias("text"))
    return tp.parse_time_column(staged, "text", "parsed").select("event_id", "fmt", "parsed")


# Texts put together from the parts of a time, not from any parser's patterns:
# what each spells (to the day, minute, second, millisecond) is its oracle.
_MONTH_NAMES = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
_DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def _spelled(ts):
    """(precision, text) of the spellings of a time."""
    y, m, d, h = (f(ts).cast("string") for f in (F.year, F.month, F.dayofmonth, F.hour))
    two = lambda f: F.lpad(f(ts).cast("string"), 2, "0")
    name = F.element_at(F.array(*map(F.lit, _MONTH_NAMES)), F.month(ts))
    short, day_name = F.substring(name, 1, 3), F.element_at(F.array(*map(F.lit, _DAY_NAMES)), F.weekday(ts) + 1)
    half, twelve = F.when(F.hour(ts) < 12, "AM").otherwise("PM"), ((F.hour(ts) + 11) % 12 + 1).cast("string")
    ordinal = F.when(F.dayofmonth(ts).isin(1, 21, 31), "st").when(F.dayofmonth(ts).isin(2, 22), "nd") \
        .when(F.dayofmonth(ts).isin(3, 23), "rd").otherwise("th")
    clock = F.concat_ws(":", two(F.hour), two(F.minute), two(F.second))
    milli = F.lpad((F.unix_millis(ts) % 1000).cast("string"), 3, "0")
    ahead = ts + F.expr("INTERVAL '5:30' HOUR TO MINUTE")
    c = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    return [("day", c(name, " ", d, ", ", y)), ("minute", c(name, " ", d, ", ", y, " ", twelve, ":", two(F.minute), " ", half)),
            ("day", c(d, "-", short, "-", y)), ("second", c(y, "-", m, "-", d, " ", clock, " EST")),
            ("second", c(day_name, ", ", d, " ", F.upper(short), " ", y, " ", clock, " GMT")),
            ("hour", c(d, ordinal, " of ", name, ", ", y, ", ", twelve, F.lower(half))), ("month", c(short, ". ", y)),
            ("second", c(F.substring(day_name, 1, 3), " ", short, " ", d, " ", clock, " ", y)),
            ("millisecond", c(F.date_format(ahead, "yyyy"), "/", F.month(ahead).cast("string"), "/", F.dayofmonth(ahead).cast("string"), "T",
                              F.hour(ahead).cast("string"), ":", F.lpad(F.minute(ahead).cast("string"), 2, "0"), ":", two(F.second), ".", milli, "+0530")),
            ("second", c(two(F.month), "-", two(F.dayofmonth), "-", y, " ", twelve, ":", two(F.minute), ":", two(F.second), half)),
            ("second", c(clock, " ", d, " ", name, " ", y)), ("day", c(m, "/", d, "/", F.substring(y, 3, 2))),
            ("minute", c(y, two(F.month), two(F.dayofmonth), "T", two(F.hour), two(F.minute))),
            ("none", c("around ", name, " ", y)), ("none", c(y, "-", m, "-", d, " ", "25:", two(F.minute))),
            ("none", c("31 ", F.lit("February"), " ", y)), ("none", c(day_name, " ", clock))]


_SPELLINGS = ["day", "minute", "day", "second", "second", "hour", "month", "second", "millisecond", "second", "second", "day", "minute",
              "none", "none", "none", "none"]


@register("parse_fallback", f"""
SELECT event_id, CASE list_value({", ".join(f"'{x}'" for x in _SPELLINGS)})[CAST(event_id % {len(_SPELLINGS)} AS INTEGER) + 1]
                 WHEN 'month' THEN date_trunc('month', ts) WHEN 'day' THEN date_trunc('day', ts) WHEN 'hour' THEN date_trunc('hour', ts)
                 WHEN 'minute' THEN date_trunc('minute', ts) WHEN 'second' THEN date_trunc('second', ts)
                 WHEN 'millisecond' THEN date_trunc('millisecond', ts) END AS parsed FROM events
""")
def q_parse_fallback(spark, sf):
    ev = load(spark, sf, "events")
    spelled = [text for _, text in _spelled(F.col("ts").cast("timestamp"))]
    text = F.element_at(F.array(*spelled), (F.col("event_id") % len(spelled) + 1).cast("int"))
    return ev.select("event_id", text.alias("text")).select("event_id", tp.parse_fallback(F.col("text")).cast("timestamp_ntz").alias("parsed"))


@register("standardize_time", f"""
SELECT o_orderkey, date_trunc('second', {_expected_sql("o_orderdate", f"o_orderkey % {_N_FMT}")}) AS ts
FROM orders WHERE o_orderstatus <> 'P'
""")
def q_standardize_time(spark, sf):
    o = load(spark, sf, "orders").withColumn("fmt", (F.col("o_orderkey") % _N_FMT).cast("int"))
    # pending orders carry no usable date: their text is 'nan' and the row drops
    text = F.when(F.col("o_orderstatus") == "P", F.lit("nan")).otherwise(render_round_robin("o_orderdate", "fmt"))
    o = o.select("o_orderkey", text.alias("date_text"))
    return tp.standardize_time(o, "date_text", "ts").select("o_orderkey", "ts")


@register("calendar_parts", """
SELECT event_id, ts, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
       CAST(day(ts) AS INTEGER) AS day, CAST(hour(ts) AS INTEGER) AS hour,
       CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week FROM events
""")
def q_calendar_parts(spark, sf):
    return tp.calendar_parts(load(spark, sf, "events").select("event_id", "ts"))


def _event_ids(ev):
    return F.concat_ws("-", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.upper("event_type"),
                       F.lpad(F.col("event_id").cast("string"), 3, "0"))


@register("id_to_date", """
SELECT event_id, CAST(make_date(year(ts), 1, 1) AS TIMESTAMP) AS id_date,
       CAST(CAST(ts AS DATE) AS TIMESTAMP) AS id_date_fixed FROM events
""")
def q_id_to_date(spark, sf):
    ev = load(spark, sf, "events")
    ids = _event_ids(ev)
    return ev.select("event_id", tp.id_to_date(ids).alias("id_date"), tp.id_to_date(ids, fixed=True).alias("id_date_fixed"))


@register("to_epoch", "SELECT event_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS epoch_s FROM events")
def q_to_epoch(spark, sf):
    return load(spark, sf, "events").select("event_id", tp.to_epoch(F.col("ts")).alias("epoch_s"))


@register("drop_timezone", "SELECT event_id, date_trunc('second', ts) AS ts_utc FROM events")
def q_drop_timezone(spark, sf):
    ev = load(spark, sf, "events")
    local = F.col("ts") + F.expr("INTERVAL '5:30' HOUR TO MINUTE")
    text = F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30"))
    aware = F.to_timestamp(text, "yyyy-MM-dd'T'HH:mm:ssXXX")
    return ev.select("event_id", tp.to_utc_ntz(aware).alias("ts_utc"))


@register("horizon_start", """
SELECT event_id, CAST(CAST(ts AS DATE) + 1 AS TIMESTAMP) AS daily_start, CAST(CAST(ts AS DATE) + 7 AS TIMESTAMP) AS weekly_start,
       CAST(CAST(ts AS DATE) + 30 AS TIMESTAMP) AS monthly_start, CAST(CAST(ts AS DATE) + 365 AS TIMESTAMP) AS yearly_start FROM events
""")
def q_horizon_start(spark, sf):
    ev = load(spark, sf, "events")
    return ev.select("event_id", *[tp.horizon_start(F.col("ts"), n).alias(f"{name}_start")
                                   for name, n in [("daily", 1), ("weekly", 7), ("monthly", 30), ("yearly", 365)]])


# ---------------------------------------------------------------------------
# Per-cell value rules
# ---------------------------------------------------------------------------
@register("link_flag", """
SELECT page_id, CAST(coalesce(contains(url, 'http'), false) AS INTEGER) AS url_link,
       CAST(coalesce(contains(html, 'http'), false) AS INTEGER) AS html_link FROM pages
""")
def q_link_flag(spark, sf):
    p = load(spark, sf, "pages")
    return p.select("page_id", fc.link_flag(F.col("url")).alias("url_link"), fc.link_flag(F.col("html")).alias("html_link"))


@register("first_number", r"""
SELECT p_partkey, TRY_CAST(regexp_extract(p_name, '(\d+)', 1) AS DOUBLE) AS p_name_num,
       TRY_CAST(regexp_extract(p_brand, '(\d+)', 1) AS DOUBLE) AS p_brand_num,
       TRY_CAST(regexp_extract(p_type, '(\d+)', 1) AS DOUBLE) AS p_type_num FROM part
""")
def q_first_number(spark, sf):
    p = load(spark, sf, "part")
    return p.select("p_partkey", *[fc.first_number(F.col(c)).alias(f"{c}_num") for c in ["p_name", "p_brand", "p_type"]])


_NUM_RX = fc.NUMERIC_TEXT


@register("coerce_numeric", f"""
SELECT c_custkey,
  CASE WHEN regexp_full_match(c_name, '{_NUM_RX}') THEN TRY_CAST(trim(c_name) AS DOUBLE) END AS c_name_num,
  CASE WHEN regexp_full_match(replace(c_name, 'Customer#', ''), '{_NUM_RX}') THEN TRY_CAST(trim(replace(c_name, 'Customer#', '')) AS DOUBLE) END AS c_serial_num,
  CASE WHEN regexp_full_match(c_mktsegment, '{_NUM_RX}') THEN TRY_CAST(trim(c_mktsegment) AS DOUBLE) END AS c_mktsegment_num
FROM customer
""")
def q_coerce_numeric(spark, sf):
    c = load(spark, sf, "customer")
    return c.select("c_custkey", fc.coerce_numeric(F.col("c_name")).alias("c_name_num"),
                    fc.coerce_numeric(F.replace(F.col("c_name"), F.lit("Customer#"), F.lit(""))).alias("c_serial_num"),
                    fc.coerce_numeric(F.col("c_mktsegment")).alias("c_mktsegment_num"))


def broken_props(ev):
    """Damaged JSON variants of ``props`` (one kind per event type)."""
    t, p = F.col("event_type"), F.col("props")
    return F.when(t == "click", F.replace(p, F.lit('"'), F.lit("'"))) \
            .when(t == "error", F.expr("substr(props, 1, length(props) - 1)")) \
            .when(t == "purchase", F.concat(p, F.lit(","))) \
            .when(t == "signup", F.regexp_replace(p, r"\d+", "None")) \
            .otherwise(p)


BROKEN_PROPS_SQL = """CASE event_type WHEN 'click' THEN replace(props, '"', '''')
  WHEN 'error' THEN substr(props, 1, length(props) - 1) WHEN 'purchase' THEN props || ','
  WHEN 'signup' THEN regexp_replace(props, '\\d+', 'None', 'g') ELSE props END"""


def _repair_sql(x: str) -> str:
    v1 = f"replace(trim({x}), '''', '\"')"
    v2 = f"(CASE WHEN starts_with({v1}, '[') OR starts_with({v1}, '{{') THEN {v1} ELSE '[' || {v1} || ']' END)"
    v3 = f"(CASE WHEN ends_with({v2}, ']') OR ends_with({v2}, '}}') THEN {v2} ELSE {v2} || ']' END)"
    return f"regexp_replace(regexp_replace({v3}, ',+$', ''), ';+$', '')"


@register("parse_json_lenient", f"""
WITH b AS (SELECT event_id, {BROKEN_PROPS_SQL} AS txt FROM events),
r AS (SELECT event_id, {_repair_sql("txt")} AS j FROM b)
SELECT event_id, CASE WHEN json_valid(j) THEN CAST(json_extract(CASE WHEN starts_with(j, '{{') THEN '[' || j || ']' ELSE j END, '$[0].k') AS BIGINT) END AS k
FROM r
""")
def q_parse_json_lenient(spark, sf):
    ev = load(spark, sf, "events")
    arr = fj.parse_json_lenient(broken_props(ev), "struct<k: bigint>")
    return ev.select("event_id", F.get(arr, 0).getField("k").alias("k"))


@register("parse_json_strict", """
SELECT 'props' AS column_name, bool_and(json_valid(props)) AS is_json FROM events
UNION ALL SELECT 'event_type', bool_and(json_valid(event_type)) FROM events
UNION ALL SELECT 'number', bool_and(json_valid(CAST(user_id AS VARCHAR))) FROM events
UNION ALL SELECT 'trailing', bool_and(json_valid(props || CASE WHEN event_id % 7 = 3 THEN ' junk' ELSE '' END)) FROM events
""")
def q_parse_json_strict(spark, sf):
    ev = load(spark, sf, "events").withColumns({
        "number": F.col("user_id").cast("string"),
        "trailing": F.concat("props", F.when(F.col("event_id") % 7 == 3, " junk").otherwise(""))})
    return fj.json_column_decisions(ev, ["props", "event_type", "number", "trailing"], "struct<k: bigint>")


@register("json_first_fields", """
SELECT event_id, CAST(json_extract('[' || props || ']', '$[0].k') AS BIGINT) AS impact_k FROM events
""")
def q_json_first_fields(spark, sf):
    ev = load(spark, sf, "events")
    arr = fj.parse_json_strict(F.concat(F.lit("["), F.col("props"), F.lit("]")), "array<struct<k: bigint>>")
    return ev.select("event_id", *[c.alias(n) for n, c in fj.json_first_fields(arr, ["k"], "impact_").items()])


def ieee_ratio(a, b):
    """a / b with IEEE results for a zero divisor (inf, NaN), as NumPy gives."""
    return F.when(b == 0, F.when(a == 0, F.lit(float("nan"))).otherwise(F.signum(a) * F.lit(float("inf")))) \
            .otherwise(a / b)


@register("clean_nonfinite", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_tax = 0 THEN 0.0 ELSE round(l_discount / l_tax, 6) + 0.0 END AS disc_per_tax
FROM lineitem
""")
def q_clean_nonfinite(spark, sf):
    li = load(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     r6(fc.clean_nonfinite(ieee_ratio(F.col("l_discount"), F.col("l_tax")))).alias("disc_per_tax"))


@register("has_nonfinite", """
SELECT bool_or(l_tax = 0) AS disc_per_tax_nonfinite, false AS l_quantity_nonfinite FROM lineitem
""")
def q_has_nonfinite(spark, sf):
    li = load(spark, sf, "lineitem")
    return li.agg(fc.has_nonfinite(ieee_ratio(F.col("l_discount"), F.col("l_tax"))).alias("disc_per_tax_nonfinite"),
                  fc.has_nonfinite(F.col("l_quantity")).alias("l_quantity_nonfinite"))


# ---------------------------------------------------------------------------
# Schema operators
# ---------------------------------------------------------------------------
@register("rename_columns", """
SELECT o_orderkey, o_custkey, o_orderstatus AS status, o_totalprice AS total_price, o_orderdate AS UTC_DATE,
       o_orderpriority AS priority FROM orders
""")
def q_rename_columns(spark, sf):
    user = {"o_orderstatus": "status", "o_totalprice": "total_price", "o_orderdate": "date",
            "o_orderpriority": "priority"}
    # a source spelling first, then the standard synonym table (date -> UTC_DATE)
    return schema.rename_columns(schema.rename_columns(load(spark, sf, "orders"), user))


@register("dedupe_columns", """
SELECT l.l_orderkey, l.l_linenumber, l.l_shipdate AS ts, o.o_totalprice
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
""")
def q_dedupe_columns(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    j = li.join(o, li.l_orderkey == o.o_orderkey).drop("o_orderkey")
    return schema.dedupe_columns(j, {"l_shipdate": "ts", "o_orderdate": "ts"})


@register("drop_all_null_columns", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def q_drop_all_null_columns(spark, sf):
    c = load(spark, sf, "customer")
    wide = c.select("c_custkey", "c_name", fc.coerce_numeric(F.col("c_name")).alias("c_name_num"),
                    "c_acctbal", fc.coerce_numeric(F.col("c_mktsegment")).alias("c_mktsegment_num"))
    return schema.drop_all_null_columns(wide)


REQUIRED = {"orders": ["o_orderkey", "o_orderdate", "o_comment"],
            "lineitem": ["l_orderkey", "l_shipdate", "l_comment", "l_shipmode"]}


@register("check_missing", """
SELECT r.source, r.column_name FROM (VALUES ('orders', 'o_orderkey'), ('orders', 'o_orderdate'), ('orders', 'o_comment'),
  ('lineitem', 'l_orderkey'), ('lineitem', 'l_shipdate'), ('lineitem', 'l_comment'), ('lineitem', 'l_shipmode')) r(source, column_name)
WHERE NOT ((r.source = 'orders' AND r.column_name IN (SELECT column_name FROM (DESCRIBE orders)))
        OR (r.source = 'lineitem' AND r.column_name IN (SELECT column_name FROM (DESCRIBE lineitem))))
""")
def q_check_missing(spark, sf):
    """Required columns that the files of a CSV tree lack, by the files' headers."""
    from .session import scratch_path
    from .sources.probe import missing_columns
    root, parts = scratch_path(spark, "headers"), []
    for source, required in REQUIRED.items():
        load(spark, sf, source).write.option("header", True).option("sep", ";").csv(f"{root}/{source}")
        found = missing_columns(spark, f"{root}/{source}", required, options={"sep": ";"})
        parts.append(found.select(F.lit(source).alias("source"), F.col("missing").alias("column_name")).distinct())
    return parts[0].unionByName(parts[1])


@register("add_default_columns", "SELECT *, 0.0 AS p_weight, 'missing' AS p_container FROM part")
def q_add_default_columns(spark, sf):
    return schema.add_default_columns(load(spark, sf, "part"), ["p_size", "p_weight"], ["p_brand", "p_container"])


@register("split_features_targets", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem
""")
def q_split_features_targets(spark, sf):
    x, _ = schema.split_features_targets(load(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "humidity"])
    return x


@register("numeric_only", f"SELECT {', '.join(LI_NUM)} FROM lineitem")
def q_numeric_only(spark, sf):
    return schema.numeric_only(load(spark, sf, "lineitem"))


@register("conform_schema", "SELECT l_orderkey, l_quantity, 0.0 AS l_weight, l_tax, 0.0 AS l_volume FROM lineitem")
def q_conform_schema(spark, sf):
    return schema.conform_schema(load(spark, sf, "lineitem"), ["l_orderkey", "l_quantity", "l_weight", "l_tax", "l_volume"])


@register("tag_lineage", """
SELECT event_id, ts, 'events' AS category, 'monthly' AS forecast_period, TIMESTAMP '2024-02-01 00:00:00' AS run_ts,
       'events.parquet' AS source_file FROM events
""")
def q_tag_lineage(spark, sf):
    ev = load(spark, sf, "events")
    out = schema.tag_lineage(ev, {"category": "events", "forecast_period": "monthly",
                                  "run_ts": F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")}, source_file=True)
    return out.select("event_id", "ts", "category", "forecast_period", "run_ts", "source_file")


@register("pad_targets", "SELECT l_orderkey, l_linenumber, l_quantity, 0.0 AS humidity, 0.0 AS visibility FROM lineitem")
def q_pad_targets(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return schema.pad_targets(li, ["l_quantity", "humidity", "visibility"])


@register("concat_columns", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) + 0.0 AS revenue,
       round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) + 0.0 AS charge FROM lineitem
""")
def q_concat_columns(spark, sf):
    li = load(spark, sf, "lineitem")
    rev = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    out = schema.concat_columns(li.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax"),
                                {"revenue": r6(rev), "charge": r6(rev * (1 + F.col("l_tax")))})
    return out.select("l_orderkey", "l_linenumber", "revenue", "charge")


# ---------------------------------------------------------------------------
# Filters (F1-F8)
# ---------------------------------------------------------------------------
@register("drop_null_key", f"SELECT * FROM ({UNION_SQL}) WHERE c_custkey IS NOT NULL")
def q_drop_null_key(spark, sf):
    return filters.drop_null_key(cust_supp(spark, sf), "c_custkey")


@register("drop_null_any_target", f"SELECT * FROM ({UNION_SQL}) WHERE c_acctbal IS NOT NULL AND c_nationkey IS NOT NULL")
def q_drop_null_any_target(spark, sf):
    return filters.drop_null_any_target(cust_supp(spark, sf), ["c_acctbal", "c_nationkey", "humidity"])


@register("before_cutoff", "SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00'")
def q_before_cutoff(spark, sf):
    return filters.before_cutoff(load(spark, sf, "events"), "2024-01-15 00:00:00")


@register("on_date", """
SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01' AND l_shipdate < TIMESTAMP '1998-06-02'
""")
def q_on_date(spark, sf):
    return filters.on_date(load(spark, sf, "lineitem"), "1998-06-01", key="l_shipdate")


@register("drop_sparse_columns", f"SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, s_name FROM ({UNION_SQL})")
def q_drop_sparse_columns(spark, sf):
    u = cust_supp(spark, sf)
    return filters.drop_sparse_columns(u, schema.numeric_columns(u))


@register("drop_thin_targets", f"""
SELECT 'c_acctbal' AS target, count(c_acctbal) AS non_null, count(c_acctbal) >= 100 AS kept FROM ({UNION_SQL})
UNION ALL SELECT 's_acctbal', count(s_acctbal), count(s_acctbal) >= 100 FROM ({UNION_SQL})
""")
def q_drop_thin_targets(spark, sf):
    return filters.thin_targets(cust_supp(spark, sf), ["c_acctbal", "s_acctbal", "humidity"])


@register("split_null", f"SELECT *, c_custkey IS NULL AS is_null FROM ({UNION_SQL})")
def q_split_null(spark, sf):
    return filters.split_null(cust_supp(spark, sf), "c_custkey")


@register("uncastable_columns", f"""
SELECT 'c_name' AS column_name, count(CASE WHEN regexp_full_match(c_name, '{_NUM_RX}') THEN TRY_CAST(trim(c_name) AS DOUBLE) END) > 0 AS castable FROM customer
UNION ALL SELECT 'c_mktsegment', count(CASE WHEN regexp_full_match(c_mktsegment, '{_NUM_RX}') THEN TRY_CAST(trim(c_mktsegment) AS DOUBLE) END) > 0 FROM customer
UNION ALL SELECT 'c_acctbal', count(c_acctbal) > 0 FROM customer
""")
def q_uncastable_columns(spark, sf):
    return filters.uncastable_columns(load(spark, sf, "customer"), ["c_name", "c_mktsegment", "c_acctbal"])
