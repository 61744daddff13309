"""The date grammar (X5): texts spelled without the parser, the texts a general parser reads, and pandas."""
import datetime as dt
import random
import re
import warnings

import pandas as pd
import pytest
from pyspark.sql import functions as F

from timefuse.functions import timeparse as tp

MONTHS = "January February March April May June July August September October November December".split()
DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()


def spelled(rng):
    """A text and the instant it spells."""
    t = dt.datetime(1980, 1, 1) + dt.timedelta(seconds=rng.randrange(60 * 365 * 86400))
    y, m, d, month = t.year, t.month, t.day, MONTHS[t.month - 1]
    name = rng.choice([month, month[:3], month[:3].lower(), month[:3].upper(), "Sept" if m == 9 else month])
    day = rng.choice([DAYS[t.weekday()], DAYS[t.weekday()][:3]])
    dd, mm = rng.choice([f"{d}", f"{d:02d}"]), rng.choice([f"{m}", f"{m:02d}"])
    ordinal = "th" if 10 <= d <= 20 else {1: "st", 2: "nd", 3: "rd"}.get(d % 10, "th")
    date, whole = rng.choice([
        (f"{name} {dd}, {y}", 1), (f"{name} {dd} {y}", 1), (f"{dd} {name} {y}", 1), (f"{dd}-{name}-{y}", 1), (f"{d}{ordinal} of {name} {y}", 1),
        (f"{name} {d}{ordinal}, {y}", 1), (f"{day}, {name} {dd}, {y}", 1), (f"{day} {dd} {name} {y}", 1), (f"{y} {name} {dd}", 1),
        (f"{y}-{mm}-{dd}", 1), (f"{y}.{m:02d}.{d:02d}", 1), (f"{mm}/{dd}/{y}", 1), (f"{y}/{mm}/{dd}", 1), (f"{name} {y}", 0)])
    if not whole:
        return date, dt.datetime(y, m, 1)
    H, M, S = t.hour, t.minute, t.second
    half, twelve, milli = "AM" if H < 12 else "PM", H % 12 or 12, rng.randrange(1000)
    clock, at = rng.choice([
        ("", (0, 0, 0)), (f"{H:02d}:{M:02d}", (H, M, 0)), (f"{H:02d}:{M:02d}:{S:02d}", (H, M, S)), (f"{twelve}:{M:02d} {half}", (H, M, 0)),
        (f"{twelve}:{M:02d}{half.lower()}", (H, M, 0)), (f"{twelve} {half}", (H, 0, 0)), (f"{twelve}:{M:02d}:{S:02d} {half}", (H, M, S)),
        (f"{H:02d}:{M:02d}:{S:02d}.{milli:03d}", (H, M, S, milli * 1000))])
    instant = dt.datetime(y, m, d, *at)
    if not clock:
        return date, instant
    zone, minutes = rng.choice([("", 0), ("", 0), ("Z", 0), (" UTC", 0), (" +0200", 120), (" -05:00", -300), ("+05:30", 330), (" EST", 0)]) \
        if "M" not in clock.upper() else ("", 0)
    if not zone and rng.random() < .2:
        return f"{clock} {date}", instant
    return f"{date}{rng.choice([' ', ' ', ', '])}{clock}{zone}", instant - dt.timedelta(minutes=minutes)


def parsed(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.p for r in df.select("i", tp.parse_fallback(F.col("t")).cast("timestamp_ntz").alias("p")).orderBy("i").collect()]


def test_generated_texts(spark):
    rng = random.Random(11)
    made = [spelled(rng) for _ in range(600)]
    got = parsed(spark, [t for t, _ in made])
    assert [(t, g) for (t, w), g in zip(made, got) if g != w] == []
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        there = [pd.to_datetime(t, errors="coerce", utc=True) for t, _ in made]
    same = sum(not pd.isna(p) and p.tz_localize(None).to_pydatetime() == g for p, g in zip(there, got))
    assert same >= 0.97 * len(made)


DAY = dt.datetime(2023, 8, 15)
AT = DAY.replace(hour=13, minute=45)


@pytest.fixture(scope="module")
def read(spark):
    cases = {
        AT: ["August 15, 2023 1:45 PM", "Aug 15, 2023, 1:45 PM", "13:45 15 Aug 2023", "2023-08-15T13:45Z", "20230815T1345", "15.8.2023 13:45",
             "2023-08-15 13:45 CET", "2023-08-15T15:45+02", "2023-08-15 1:45 p.m.", "15/08/2023 13:45", "2023-08-15 13h45m", "  2023-08-15   13:45 "],
        AT.replace(second=30): ["2023-08-15 13:45:30 EST", "Tue Aug 15 13:45:30 2023", "Tue, 15 Aug 2023 13:45:30 GMT", "20230815134530",
                                "2023-08-15 11:45:30 UTC+2", "2023-08-15 08:45:30 -0500", "2023-08-15 13h45m30s", "20230815T134530"],
        DAY: ["15-Aug-2023", "Tuesday, August 15, 2023", "15th of August 2023", "2023 Aug 15", "8/15/23", "15/8/23", "15-Aug-23", "Aug 15 '23",
              "August 2023 15", "15 2023 August", "12 AM Aug 15 2023", "2023.08.15", "on 15 aug 2023", "Aug. 15, 2023", "8-15-2023"],
        dt.datetime(2023, 9, 5): ["Sept 5, 2023", "5 Sept. 2023", "9-5-2023"], dt.datetime(2023, 8, 1): ["Aug 2023", "2023-08", "08-2023", "8/2023"],
        dt.datetime(2003, 1, 2): ["1-2-3", "1/2/03"], dt.datetime(1999, 8, 15): ["99-08-15", "Aug 15 99"], dt.datetime(2023, 7, 1): ["2023Q3", "2023-q3"],
        dt.datetime(2024, 2, 29, 0, 30): ["2024-02-29 12:30 am", "Feb 29 2024 0:30"],
        dt.datetime(2023, 8, 15, 13, 45, 30, 123456): ["2023-08-15T13:45:30.123456789Z", "Aug 15 2023 3:45:30.123456 PM +0200"],
        None: ["1692107130.5", "2023-13-01", "Aug 32, 2023", "2023-08-15 25:00", "2023-08-15 24:00:00", "noon", "", " ", "nan", "now", "today", "2023-227",
               "08-15", "1 Feb", "June 31, 2023", "Feb 30 2023", "2023-02-29", "31/31/2023", "foo 2023-08-15", "2023-08-15 foo", "the 17 Aug 2023",
               "2023-08-15 13:60", "2023-08-15 13:45:60", "13:45 PM Aug 15 2023", "13:45", "Monday", "2023-08-15 1:00 2:00", "Aug Sep 2023", "1 2 3 4",
               "2023-08-15 13:45 +2500", "99999-01-01", "-5", "2023--", "é 2023-08-15", "1:2:3:4 2023-08-15", None]}
    flat = [(t, w) for w, ts in cases.items() for t in ts]
    return list(zip(flat, parsed(spark, [t for t, _ in flat])))


def test_known_texts(read):
    assert [(t, w, g) for (t, w), g in read if g != w] == []


def test_standardize_time_keeps_what_the_grammar_reads(spark):
    df = spark.createDataFrame([(1, "Tuesday, August 15, 2023 1:45 PM"), (2, "nonsense"), (3, None), (4, "1692107130")], "i int, t string")
    assert {r.i: r.ts for r in tp.standardize_time(df, "t").collect()} == {1: AT, 4: dt.datetime(2023, 8, 15, 13, 45, 30)}


def by_strptime(text):
    """The first format of the list that Python's own parser takes, as UTC."""
    for fmt in tp.reachable_formats():
        try:
            t = dt.datetime.strptime(text, fmt)
        except ValueError:
            continue
        return t.astimezone(dt.timezone.utc).replace(tzinfo=None) if t.tzinfo else t
    return None


def test_listed_formats_against_strptime(spark):
    """Texts of all 57 formats written by Python, days up to 12 (where the order of
    formats decides) and beyond, several zones; and texts that just miss a format."""
    rng, texts = random.Random(5), []
    for fmt in tp.reachable_formats():
        for k in range(12):
            t = dt.datetime(rng.randrange(1970, 2038), rng.randrange(1, 13), rng.randrange(1, 13) if k % 2 else rng.randrange(13, 29),
                            rng.randrange(24), rng.randrange(60), rng.randrange(60), rng.randrange(10**6))
            text = t.replace(tzinfo=dt.timezone.utc).strftime(fmt)
            if "%z" in fmt:
                text = text.replace("+0000", rng.choice(["+0000", "+0200", "-0530", "+01:30", "Z"]))
            texts.append(text)
            if k < 2:
                at = rng.randrange(len(text))
                texts += [text[:at] + rng.choice("9x-: ") + text[at + 1:], text + rng.choice([" x", "9"])]
    # white space is brought to one blank before; of a fraction, digits beyond the sixth are cut off
    texts = [" ".join(t.split()) for t in texts if not re.search(r"\.\d{7}", t)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.p for r in df.select("i", tp.parse_multi_format(F.col("t")).cast("timestamp_ntz").alias("p")).orderBy("i").collect()]
    wrong = [(t, by_strptime(t), g) for t, g in zip(texts, got) if by_strptime(t) != g]
    assert wrong == []
