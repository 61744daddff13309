"""Time normalisation as Column expressions.

Every function returns a ``Column``; nothing here runs Python per row. The
multi-format parser turns each strptime format of the fixed list into a Spark
datetime pattern plus a cheap guard regex, so a row is only handed to the
(exception-based, slower) parser for formats whose shape it already has.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference: the ordered list of datetime
# formats it tries (first match wins), in its original order, duplicates kept.
# ---------------------------------------------------------------------------
REFERENCE_TIME_FORMATS = [
    "%Y-%m-%dT%H:%M:%S.%fZ",
    "%Y-%m-%dT%H:%M:%SZ",
    "%Y-%m-%dT%H:%M:%S.%f%z",
    "%Y-%m-%dT%H:%M:%S%z",
    "%Y-%m-%d %H:%M:%S%z",
    "%Y-%m-%d %H:%M:%S.%f%z",
    "%Y-%m-%d %H:%M:%S",
    "%d-%m-%Y %H:%M:%S",
    "%m-%d-%Y %H:%M:%S",
    "%m/%d/%Y %H:%M:%S",
    "%d/%m/%Y %H:%M:%S",
    "%Y.%m.%d %H:%M:%S",
    "%d.%m.%Y %H:%M:%S",
    "%Y%m%d %H:%M:%S",
    "%d%m%Y %H:%M:%S",
    "%Y%m%dT%H%M%S",
    "%Y%m%d %H%M%S",
    "%Y-%m-%d %H:%M:%S.%f",
    "%d-%m-%Y %H:%M:%S.%f",
    "%m/%d/%Y %H:%M:%S.%f",
    "%d/%m/%Y %H:%M:%S.%f",
    "%Y.%m.%d %H:%M:%S.%f",
    "%d.%m.%Y %H:%M:%S.%f",
    "%Y-%m-%d %I:%M:%S %p",
    "%d-%m-%Y %I:%M:%S %p",
    "%m/%d/%Y %I:%M:%S %p",
    "%d/%m/%Y %I:%M:%S %p",
    "%Y.%m.%d %I:%M:%S %p",
    "%d.%m.%Y %I:%M:%S %p",
    "%s",
    "%B %d, %Y %H:%M:%S",
    "%b %d, %Y %H:%M:%S",
    "%d %B %Y %H:%M:%S",
    "%d %b %Y %H:%M:%S",
    "%Y/%m/%d %H:%M:%S",
    "%d/%b/%Y %H:%M:%S",
    "%d-%b-%Y %H:%M:%S",
    "%d.%b.%Y %H:%M:%S",
    "%d %b %Y %H:%M:%S",
    "%Y %b %d %H:%M:%S",
    "%Y %B %d %H:%M:%S",
    "%d %B %Y %H:%M:%S",
    "%Y-%m-%d %H:%M:%S %Z",
    "%d-%m-%Y %H:%M:%S %Z",
    "%m/%d/%Y %H:%M:%S %Z",
    "%d/%m/%Y %H:%M:%S %Z",
    "%Y.%m.%d %H:%M:%S %Z",
    "%d.%m.%Y %H:%M:%S %Z",
    "%Y-%m-%dT%H:%M:%S.%f%z",
    "%Y-%m-%dT%H:%M:%S%z",
    "%Y%m%dT%H%M%S%z",
    "%Y%m%dT%H%M%S.%f%z",
    "%Y/%m/%dT%H:%M:%S",
    "%Y-%m-%dT%H:%M",
    "%Y-%m-%d %H:%M",
    "%d-%m-%Y %H:%M",
    "%m/%d/%Y %H:%M",
    "%d/%m/%Y %H:%M",
    "%Y.%m.%d %H:%M",
    "%d.%m.%Y %H:%M",
    "%Y-%m-%d",
    "%d-%m-%Y",
    "%m/%d/%Y",
    "%d/%m/%Y",
    "%Y.%m.%d",
    "%d.%m.%Y",
    "%Y%m%d",
    "%d%m%Y",
    "%A, %Y-%m-%d %H:%M:%S",
    "%a, %Y-%m-%d %H:%M:%S",
    "%A %d %B %Y %H:%M:%S",
    "%a %d %b %Y %H:%M:%S",
    "%m-%d-%Y %H:%M:%S",
    "%b %d %Y %H:%M:%S",
    "%B %d %Y %H:%M:%S",
    "%Y.%m.%dT%H:%M:%S",
    "%Y.%m.%dT%H:%M:%S.%f",
    "%Y-%m-%d/%H:%M:%S",
    "%d-%m-%Y/%H:%M:%S",
    "%Y-%m-%d %H:%M",
    "%d-%m-%Y %H:%M",
    "%m/%d/%Y %H:%M",
    "%d/%m/%Y %H:%M",
    "%Y.%m.%d %H:%M",
    "%d.%m.%Y %H:%M",
    "%Y%m%d %H:%M",
    "%d%m%Y %H:%M",
    "%Y-%m-%dT%H:%M:%S",
    "%Y-%m-%dT%H:%M",
]

# The suffix the hourly base source carries, and the bounds of
# the nanosecond timestamps the reference can represent.
UTC_SUFFIX_REGEX = r"\s*\+\d{4}\s*UTC$"
MIN_TS = "1677-09-21 00:12:43.145224"
MAX_TS = "2262-04-11 23:47:16.854775"

_MONTHS = ["January", "February", "March", "April", "May", "June", "July",
           "August", "September", "October", "November", "December"]
_DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

_NUMERIC = {"Y", "m", "d", "H", "I", "M", "S", "f"}
# directive -> (spark pattern letter, loose regex, width when packed)
_DIRECTIVES = {
    "Y": ("yyyy", r"\d{4}", 4),
    "m": ("M", r"\d{1,2}", 2),
    "d": ("d", r"\d{1,2}", 2),
    "H": ("H", r"\d{1,2}", 2),
    "I": ("h", r"\d{1,2}", 2),
    "M": ("m", r"\d{1,2}", 2),
    "S": ("s", r"\d{1,2}", 2),
}


def _tokens(fmt: str):
    out, i = [], 0
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            out.append(("dir", fmt[i + 1]))
            i += 2
        else:
            out.append(("lit", fmt[i]))
            i += 1
    return out


def reachable_formats() -> list[str]:
    """Formats of the fixed list that can ever match.

    Rule: ``/`` is rewritten to ``-`` before parsing, so formats holding ``/``
    never match; ``%s`` is not a strptime directive; formats made only of
    digits are caught earlier by the epoch-seconds rule. Later duplicates of
    a format cannot win either.
    """
    seen, out = set(), []
    for fmt in REFERENCE_TIME_FORMATS:
        if "/" in fmt or fmt == "%s" or fmt in seen:
            continue
        toks = _tokens(fmt)
        if all(k == "dir" and v in _NUMERIC for k, v in toks):
            continue
        seen.add(fmt)
        out.append(fmt)
    return out


@lru_cache(maxsize=None)
def compile_format(fmt: str):
    """strptime format -> (guard regex, list of Spark patterns, strip day name)."""
    toks = _tokens(fmt)
    strip_day = bool(toks) and toks[0] in (("dir", "A"), ("dir", "a"))
    regex, spark = ["^"], []
    day_regex = ""
    i = 0
    if strip_day:
        names = _DAYS if toks[0][1] == "A" else [d[:3] for d in _DAYS]
        day_regex = "(?i:" + "|".join(names) + ")"
        regex.append(day_regex)
        i = 1
        # the separator right after the day name goes with it
        while i < len(toks) and toks[i][0] == "lit" and toks[i][1] in ", ":
            regex.append(re.escape(toks[i][1]))
            i += 1
    zone = False
    for j in range(i, len(toks)):
        kind, v = toks[j]
        if kind == "lit":
            regex.append(re.escape(v))
            spark.append(f"'{v}'" if v.isalpha() else v)
            continue
        prev_num = j > i and toks[j - 1][0] == "dir" and toks[j - 1][1] in _NUMERIC
        next_num = j + 1 < len(toks) and toks[j + 1][0] == "dir" and toks[j + 1][1] in _NUMERIC
        packed = prev_num or next_num
        if v in _DIRECTIVES:
            letter, rx, width = _DIRECTIVES[v]
            if packed and v != "Y":
                spark.append(letter * 2)
                regex.append(r"\d{%d}" % width)
            else:
                spark.append(letter)
                regex.append(rx)
        elif v == "f":
            spark.append("SSSSSS")
            regex.append(r"\d{1,9}")
        elif v == "B":
            spark.append("MMMM")
            regex.append("(?i:" + "|".join(_MONTHS) + ")")
        elif v == "b":
            spark.append("MMM")
            regex.append("(?i:" + "|".join(m[:3] for m in _MONTHS) + ")")
        elif v == "p":
            spark.append("a")
            regex.append("(?i:AM|PM)")
        elif v == "Z":
            spark.append("z")
            regex.append("(?i:UTC|GMT)")
        elif v == "z":
            zone = True
            spark.append("\0")
            regex.append(r"(?:Z|[+-]\d{2}:?\d{2})")
        else:  # pragma: no cover - list holds no other directive
            raise ValueError(f"unsupported directive %{v}")
    regex.append("$")
    base = "".join(spark)
    patterns = [base.replace("\0", z) for z in ("XX", "XXX")] if zone else [base]
    return "".join(regex), patterns, day_regex


def strip_utc_suffix(c: Column) -> Column:
    """Drop a trailing ``+0000 UTC`` tail."""
    return F.trim(F.regexp_replace(c, UTC_SUFFIX_REGEX, ""))


def normalize_separators(c: Column) -> Column:
    """``/`` -> ``-`` and trim."""
    return F.trim(F.replace(c, F.lit("/"), F.lit("-")))


def _in_range(ts: Column) -> Column:
    return F.when(ts.between(F.lit(MIN_TS).cast("timestamp"), F.lit(MAX_TS).cast("timestamp")), ts)


def parse_epoch(c: Column) -> Column:
    """An all-digit text, of any number of digits, is seconds since the epoch (range-checked)."""
    seconds = c.try_cast("bigint")
    # beyond the year 9999 nothing is in range, and the conversion would overflow
    return _in_range(F.when(c.rlike(r"^\d+$") & (seconds <= 253_402_300_799), F.timestamp_seconds(seconds)))


def _microseconds(c: Column) -> Column:
    """Fractions of seven to nine digits cut to the six that a timestamp holds."""
    return F.regexp_replace(c, r"([.,]\d{6})\d{1,3}(?!\d)", "$1")


def _parse_one(c: Column, fmt: str) -> Column:
    guard, patterns, day_regex = compile_format(fmt)
    target = c
    if day_regex:
        target = F.regexp_replace(c, "^" + day_regex + r"[, ]*", "")
    if "%f" in fmt:
        target = _microseconds(target)
    parsed = [F.try_to_timestamp(target, F.lit(p)) for p in patterns]
    value = parsed[0] if len(parsed) == 1 else F.coalesce(*parsed)
    return F.when(c.rlike(guard), value)


# The date grammar of X5. A text is read as words of these classes; what is left
# after them must be numbers and separators.
_SHORT_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_MONTH = r"(?<![a-z])(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?" \
         r"|nov(?:ember)?|dec(?:ember)?)(?![a-z])\.?"
_WEEKDAY = r"(?<![a-z])(?:mon|tue(?:s)?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?(?![a-z])\.?"
_FILLER = r"(?<![a-z])(?:at|on|and|of|ad)(?![a-z])"
# a zone name says nothing to a general parser, unless it is UTC's
_ZONE_NAME = r"(?<=\d) (?!(?:AM|PM|UTC|GMT|" + "|".join(m.upper() for m in _SHORT_MONTHS) + r"|MON|TUE|WED|THU|FRI|SAT|SUN)\b)[A-Z]{3,5}$"
_HALF_DAY = r"(?:([ap])\.?m\.?(?![a-z]))?"
_CLOCK = r"(?<![\d:])(\d{1,2}):(\d{1,2})(?::(\d{1,2})?(?:[.,](\d{1,9}))?)? ?" + _HALF_DAY \
    + r" ?(?:(z|utc|gmt)(?![a-z]))? ?(?:([+-])(\d{1,2})(?::?(\d{2}))?(?![\d:-]))?"
# other spellings of a clock, brought to digits and colons: compact after a
# compact date, hours alone after T or before am/pm, 13h45m30s
_CLOCK_SPELLINGS = [(r"\b(\d{4})(\d{2})(\d{2})[t ]?(\d{2})(\d{2})(\d{2})(?!\d)", "$1-$2-$3 $4:$5:$6"),
                    (r"\b(\d{4})(\d{2})(\d{2})t(\d{2})(\d{2})(?!\d)", "$1-$2-$3 $4:$5"),
                    (r"(\d)t(\d{1,2})(?=$|z|[+-])", "$1 $2:0"), (r"(?<=\d)t(?=\d)", " "),
                    (r"(?<![\d:.,])(\d{1,2}) ?([ap])\.?m\b", "$1:0 $2m"), (r"(\d{1,2})h(\d{1,2})m(?:(\d{1,2})s)?", "$1:$2:$3"),
                    (r"(\d)(?:st|nd|rd|th)(?![a-z])", "$1")]


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often it is read."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _date_of(rest: Column) -> Column:
    """(y, m, d) of a text without its clock, NULL if it is no date.

    A month's name settles the month; of two numbers beside it the one that can
    be no day is the year, else the last one, or the first if the name comes
    last. Of three numbers the first is the year if it can be no day, else the
    day if it can be no month, else the month. A year of up to two digits is
    within 1969-2068, as in the listed formats."""
    month = F.regexp_extract(rest, _MONTH, 1)
    before = F.size(F.regexp_extract_all(F.regexp_extract(rest, "^(.*?)" + _MONTH, 1), F.lit(r"\d+"), 0))
    numbers = F.transform(F.regexp_extract_all(F.regexp_replace(rest, _MONTH, " "), F.lit(r"\d+"), 0),
                          lambda x: F.struct(x.try_cast("int").alias("v"), (F.length(x) > 2).alias("long")))
    number = F.struct(F.when(month != "", (F.instr(F.lit("".join(_SHORT_MONTHS)), F.substring(month, 1, 3)) + 2) / 3).cast("int").alias("m"),
                      before.alias("before"), numbers.alias("n"),
                      (F.regexp_replace(rest, _MONTH, " ").rlike(r"^[\d .,;'-]*$") & (F.regexp_count(rest, F.lit(_MONTH)) < 2)).alias("ok"))

    def assembled(x: Column) -> Column:
        n = x["n"]
        a, b, c = (F.get(n, F.lit(i)) for i in range(3))
        year = lambda z: z["long"] | (z["v"] > 31)
        ymd = lambda y, m, d: F.struct(y.cast("int").alias("y"), m.cast("int").alias("m"), d.cast("int").alias("d"))
        one, named, count = F.lit(1), x["m"].isNotNull(), F.size(n)
        return F.when(named & (count == 1) & year(a), ymd(a["v"], x["m"], one)) \
            .when(named & (count == 2) & year(a), ymd(a["v"], x["m"], b["v"])) \
            .when(named & (count == 2) & (year(b) | (x["before"] < 2)), ymd(b["v"], x["m"], a["v"])) \
            .when(named & (count == 2), ymd(a["v"], x["m"], b["v"])) \
            .when(named, None) \
            .when((count == 3) & year(a), ymd(a["v"], b["v"], c["v"])) \
            .when((count == 3) & (a["v"] > 12), ymd(c["v"], b["v"], a["v"])) \
            .when(count == 3, ymd(c["v"], a["v"], b["v"])) \
            .when((count == 2) & year(a), ymd(a["v"], b["v"], one)) \
            .when((count == 2) & year(b), ymd(b["v"], a["v"], one))

    return _let(number, lambda x: F.when(x["ok"], assembled(x)))


def parse_fallback(c: Column) -> Column:
    """What a general date parser reads, by a grammar; else NULL.

    The words of the text are classified: clock (with fraction, half day, zone),
    month name, weekday, ordinal, filler, number. Weekdays and fillers say
    nothing, the clock and the zone are taken out, and the numbers are placed
    around the month (see ``_date_of``). A text with any other word, with two
    clocks, or of an impossible date is NULL; so is a date without a year, and
    words that mean the time of reading (now, today).

    Few texts come here, so each step is a lambda over the result of the one
    before: nothing is evaluated twice and the generated code stays small."""
    quarter = r"^(\d{4})[ -]?q([1-4])$"

    def plain(x: Column) -> Column:
        out = F.lower(F.trim(F.regexp_replace(normalize_separators(F.trim(x)), _ZONE_NAME, "")))
        for pattern, to in _CLOCK_SPELLINGS:
            out = F.regexp_replace(out, pattern, to)
        return out

    def instant(x: Column) -> Column:
        part = lambda i: F.nullif(F.regexp_extract(x, _CLOCK, i), F.lit(""))
        rest = F.trim(F.regexp_replace(x, "|".join([_CLOCK, _WEEKDAY, _FILLER, r"^(?:utc|gmt)|(?<=\d)z$"]), " "))
        clock = F.struct(*[part(i).alias(n) for i, n in enumerate(["h", "m", "s", "f", "half", "utc", "sign", "zh", "zm"], 1)],
                         rest.alias("rest"), F.regexp_count(x, F.lit(_CLOCK)).alias("clocks"))
        return _let(clock, lambda t: _let(_date_of(t["rest"]), lambda d: F.when(t["clocks"] <= 1, placed(t, d))))

    def placed(t: Column, d: Column) -> Column:
        year = F.when(d["y"] < 69, d["y"] + 2000).when(d["y"] < 100, d["y"] + 1900).when(d["y"] <= 9999, d["y"])
        number = lambda n: F.coalesce(t[n].cast("int"), F.lit(0))
        h, half = number("h"), t["half"]
        hour = F.when(half.isNull(), h).when(h > 12, None).otherwise(h % 12 + F.when(half == "p", 12).otherwise(0))
        seconds = F.concat(F.coalesce(t["s"], F.lit("0")), F.lit("."), F.substring(F.coalesce(t["f"], F.lit("0")), 1, 6))
        at = F.try_make_timestamp(year, d["m"], d["d"], hour, number("m"), F.when(number("s") < 60, seconds.cast("decimal(8,6)")))
        # "UTC+2" is read the other way round, as POSIX writes zones
        ahead = F.when((t["sign"] == "+") == t["utc"].isin("utc", "gmt"), -1).when(t["sign"].isNotNull() & t["utc"].isNull(),
                                                                                    F.when(t["sign"] == "+", 1).otherwise(-1)).otherwise(1)
        minutes = ahead * (number("zh") * 60 + number("zm"))
        return F.when(t["sign"].isNull(), at).when(F.abs(minutes) < 1440, at - F.make_dt_interval(mins=minutes))

    def read(x: Column) -> Column:
        month = (F.regexp_extract(x, quarter, 2).try_cast("int") - 1) * 3 + 1
        first = F.try_make_timestamp(F.regexp_extract(x, quarter, 1).try_cast("int"), month, F.lit(1), F.lit(0), F.lit(0),
                                     F.lit(0).cast("decimal(8,6)"))
        return F.when(x.rlike(quarter), first).otherwise(_let(x, instant))

    return _let(c, lambda x: _let(plain(x), read))


def _shape_tokens(fmt: str) -> list[list[str]]:
    """Shape classes of a format: numeric directives -> '9', words -> 'a';
    a zone offset has three spellings (Z, +hhmm, +hh:mm)."""
    out: list[list[str]] = [[]]
    for kind, v in _tokens(fmt):
        if kind == "dir" and v in _NUMERIC:
            piece = ["9"]
        elif kind == "dir" and v == "z":
            piece = None
        elif kind == "dir" or v.isalpha():
            piece = ["a"]
        else:
            piece = [" " if v.isspace() else v]
        if piece is None:
            out = [o + alt for o in out for alt in (["a"], ["+", "9"], ["+", "9", ":", "9"], ["-", "9"],
                                                     ["-", "9", ":", "9"])]
        else:
            out = [o + piece for o in out]
    return out


def format_shapes(fmt: str) -> list[str]:
    """Shape keys (runs of a class collapsed) a text in ``fmt`` can have."""
    keys = []
    for toks in _shape_tokens(fmt):
        key = []
        for t in toks:
            if key and t in ("9", "a") and key[-1] == t:
                continue
            key.append(t)
        keys.append("".join(key))
    return keys


def shape_key(c: Column) -> Column:
    """Cheap structural key of a text: digit runs -> 9, letter runs -> a."""
    return F.regexp_replace(F.regexp_replace(c, r"[0-9]+", "9"), r"[A-Za-z]+", "a")


def _dispatch(c: Column, key: Column, fmts: list[str], parse_one) -> Column:
    by_shape: dict[str, list[str]] = {}
    for f in fmts:
        for k in format_shapes(f):
            by_shape.setdefault(k, [])
            if f not in by_shape[k]:
                by_shape[k].append(f)
    expr = None
    for k, fs in by_shape.items():
        val = F.coalesce(*[parse_one(c, f) for f in fs]) if len(fs) > 1 else parse_one(c, fs[0])
        expr = F.when(key == F.lit(k), val) if expr is None else expr.when(key == F.lit(k), val)
    return expr


def parse_multi_format(c: Column, formats: list[str] | None = None, key: Column | None = None) -> Column:
    """First matching format of the ordered list, as TIMESTAMP (UTC).

    A row only tries the formats whose shape equals its shape key (in list
    order), and each of those only after its guard regex matched, so the
    result is the first match of the whole list at the cost of one or two
    parse attempts."""
    fmts = formats if formats is not None else reachable_formats()
    return _dispatch(c, key if key is not None else shape_key(c), fmts, _parse_one)


def jvm_id() -> int:
    """Identity of the running JVM, for caches of built Column expressions."""
    from pyspark import SparkContext
    return id(SparkContext._jvm)


@lru_cache(maxsize=64)
def _multi_format_by_name(text_col: str, key_col: str, formats: tuple[str, ...], jvm: int) -> Column:
    """The X4 expression over named columns, built once per JVM: it has a few
    hundred nodes and each costs a gateway call, while the result is only an
    unresolved expression that any DataFrame with those columns can reuse."""
    return parse_multi_format(F.col(text_col), list(formats), key=F.col(key_col))


@lru_cache(maxsize=64)
def _fallback_by_name(text_col: str, jvm: int) -> Column:
    """The X5 expression over a named column, built once per JVM (see ``_multi_format_by_name``)."""
    return parse_fallback(F.col(text_col))


def parse_time_text(c: Column, hourly_suffix: bool = True) -> Column:
    """X1-X5 in the reference's order; returns TIMESTAMP_NTZ in UTC, not truncated."""
    s = c.cast("string")
    if hourly_suffix:
        s = strip_utc_suffix(s)
    s = F.regexp_replace(normalize_separators(s), r"\s+", " ")
    ts = F.coalesce(parse_epoch(s), _in_range(parse_multi_format(s)), _in_range(parse_fallback(s)))
    return ts.cast("timestamp_ntz")


def to_utc_ntz(c: Column) -> Column:
    """An instant (TIMESTAMP) as naive UTC wall time; session zone is UTC."""
    return c.cast("timestamp_ntz")


def truncate_seconds(c: Column) -> Column:
    return F.date_trunc("second", c).cast("timestamp_ntz")


def parse_time_column(df, col: str, out: str = "ts", hourly_suffix: bool = True, drop_null: bool = False):
    """Parse ``col`` into ``out`` (UTC, full precision) as a DataFrame step.

    The cleaned text and its shape key are projected once as their own
    columns, so the format branches read those columns instead of repeating
    the cleaning expressions (which would also blow up generated code).
    """
    tmp, key = f"_{out}_text", f"_{out}_shape"
    s = df[col].cast("string")
    if hourly_suffix:
        s = strip_utc_suffix(s)
    s = F.regexp_replace(normalize_separators(s), r"\s+", " ")
    staged = df.withColumn(tmp, s).withColumn(key, shape_key(F.col(tmp)))
    t = F.col(tmp)
    # each parser's result is its own column: the range check reads it three
    # times, which on an inline expression would re-run the parse each time
    p_multi = f"_{out}_multi"
    staged = staged.withColumn(p_multi, _multi_format_by_name(tmp, key, tuple(reachable_formats()), jvm_id()))
    # the fallback shapes only run for rows nothing else parsed (coalesce is lazy)
    fb = _fallback_by_name(tmp, jvm_id())
    ts = F.coalesce(parse_epoch(t), _in_range(F.col(p_multi)), _let(fb, _in_range))
    ts = ts.cast("timestamp_ntz")
    keep = [F.col(f"`{c}`") for c in df.columns if c != out]
    staged = staged.withColumn(out, ts).drop(tmp, key, p_multi)
    if drop_null:
        # rows without a time drop out through an explode of a null-free
        # one-element array: a Filter would be pushed below the projection and
        # would inline (and run) the whole parse expression a second time
        return staged.select(*keep, F.explode(F.array_compact(F.array(F.col(out)))).alias(out))
    return staged.select(*keep, F.col(out))


def standardize_time(df, col: str, out: str = "ts", hourly_suffix: bool = True, as_text: bool = False):
    """Parse ``col`` into ``out`` (UTC, whole seconds) and drop unparsable rows."""
    res = parse_time_column(df, col, out, hourly_suffix, drop_null=True)
    res = res.withColumn(out, truncate_seconds(F.col(out)))
    if as_text:
        res = res.withColumn(out, F.date_format(out, "yyyy-MM-dd HH:mm:ss"))
    return res


def calendar_parts(df, ts: str = "ts", prefix: str = ""):
    """Year, month, day, hour, day_of_week with Monday = 0."""
    c = F.col(ts)
    return df.withColumns({
        f"{prefix}year": F.year(c),
        f"{prefix}month": F.month(c),
        f"{prefix}day": F.dayofmonth(c),
        f"{prefix}hour": F.hour(c),
        f"{prefix}day_of_week": F.weekday(c),
    })


def id_to_date(c: Column, fixed: bool = False) -> Column:
    """Date hidden in an event id such as ``2023-08-15T13:45:00-CME-001``.

    ``fixed=False`` follows the reference exactly: the text before the first
    ``-`` (the year) at midnight, i.e. 1 January of that year. ``fixed=True``
    keeps the full ``yyyy-MM-dd`` head.
    """
    if fixed:
        head = F.regexp_extract(c, r"^(\d{4}-\d{2}-\d{2})", 1)
        return F.try_to_timestamp(head, F.lit("yyyy-MM-dd")).cast("timestamp_ntz")
    head = F.split_part(c, F.lit("-"), F.lit(1))
    return F.try_to_timestamp(head, F.lit("yyyy")).cast("timestamp_ntz")


def to_epoch(c: Column) -> Column:
    """Seconds since the epoch (floor) of a naive-UTC timestamp."""
    return F.unix_seconds(c.cast("timestamp"))


def horizon_start(as_of: Column, days: int | Column) -> Column:
    """X11: ``as_of + days`` floored to midnight, naive UTC."""
    d = days if isinstance(days, Column) else F.lit(days)
    return F.date_add(F.to_date(as_of), d).cast("timestamp_ntz")


def render_pattern(fmt: str) -> str:
    """Spark pattern that writes a timestamp in the shape of ``fmt`` (tests
    and round-trip checks); zones are written as ``+0000``-style offsets."""
    toks = _tokens(fmt)
    _, patterns, day_regex = compile_format(fmt)
    pat = patterns[0]
    if day_regex:
        day = "EEEE" if toks[0][1] == "A" else "EEE"
        sep = ""
        for kind, v in toks[1:]:
            if kind == "lit" and v in ", ":
                sep += v
            else:
                break
        pat = day + sep + pat
    return pat


def format_precision(fmt: str) -> str:
    """Finest unit a format carries: micros, second, minute or day."""
    if "%f" in fmt:
        return "micros"
    if "%S" in fmt:
        return "second"
    if "%M" in fmt:
        return "minute"
    return "day"
