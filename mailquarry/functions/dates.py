"""Header dates, date anomalies and day bounds as column expressions. Times are UTC timestamps or milliseconds."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

#: Minutes east of UTC of the named zones; others count as UTC.
ZONES = {
    "UT": 0,
    "UTC": 0,
    "GMT": 0,
    "Z": 0,
    "EST": -300,
    "EDT": -240,
    "CST": -360,
    "CDT": -300,
    "MST": -420,
    "MDT": -360,
    "PST": -480,
    "PDT": -420,
    "CET": 60,
    "CEST": 120,
    "BST": 60,
    "EET": 120,
    "EEST": 180,
}

_DATE = r"(?i)(\d{1,2})\s+(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+(\d{2,4})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?(?:\s*([+\-]\d{4}|[a-z]{1,5}))?"


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a column that is computed once, however often f names it; an expression that is named twice is computed twice."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def parse_date(c: Column) -> Column:
    """The time that a header date states; null if there is none. Comments in parentheses are ignored."""
    clean = F.regexp_replace(F.coalesce(c, F.lit("")), r"\([^)]*\)", " ")
    # all parts by one match of the text that matches; none of them has a bar
    found = F.split(F.regexp_replace(F.regexp_extract(clean, _DATE, 0), _DATE, "|$1|$2|$3|$4|$5|$6|$7"), r"\|")
    return once(found, _stated)


def _stated(parts: Column) -> Column:
    part = lambda k: F.coalesce(F.get(parts, F.lit(k)), F.lit(""))
    number = lambda k: F.when(part(k) != "", part(k).cast("int"))
    year = number(3)
    year = F.when(year < 70, year + 2000).when(year < 100, year + 1900).otherwise(year)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(part(2))).cast("int")
    day, hour, minute, second = number(1), number(4), number(5), F.coalesce(number(6), F.lit(0))
    valid = (month > 0) & day.between(1, 31) & (hour < 24) & (minute < 60) & (second < 60) & (year > 0)
    local = F.try_to_timestamp(F.when(valid, F.format_string("%04d-%02d-%02d %02d:%02d:%02d", year, month, day, hour, minute, second)), F.lit("yyyy-MM-dd HH:mm:ss"))

    def minutes(zone: Column) -> Column:
        numeric = F.rlike(zone, F.lit(r"^[+\-]\d{4}$"))
        sign = F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1)
        out = F.when(numeric, sign * (F.substring(zone, 2, 2).cast("int") * 60 + F.substring(zone, 4, 2).cast("int")))
        for name, offset in ZONES.items():
            if offset:
                out = out.when(zone == name, offset)
        return F.coalesce(out.otherwise(0), F.lit(0))

    return F.timestamp_seconds(F.unix_seconds(local) - once(F.upper(part(7)), minutes) * 60)


#: Bits of date_flags in the order in which they are shown.
DATE_BITS = [1, 2, 64, 4, 8, 16, 32]


def date_flags(delivery: Column, sent: Column, created: Column, modified: Column, header: Column, hop_times: Column, now: Column) -> Column:
    """Bits: 1 delivered before sent, 2 modified before created, 64 modified before delivered, 4 header date over
    two hours from the sent date, 8 hops going back, 16 a date over a day ahead, 32 a date before 1995."""
    seconds = F.unix_seconds
    slack, wide, day = 300, 7200, 86400
    times = F.filter(hop_times, lambda t: t.isNotNull())
    n = F.size(times)
    steps = F.when(n > 1, F.zip_with(F.slice(times, 1, F.greatest(n - 1, F.lit(0))), F.slice(times, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: seconds(b) < seconds(a) - slack))
    every = F.array_compact(F.array(sent, header, F.get(times, F.lit(0)), F.get(times, n - 1), delivery, created, modified))
    real = F.filter(every, lambda t: F.year(t) > 1700)
    tests = [
        (1, seconds(delivery) < seconds(sent) - slack),
        (2, seconds(modified) < seconds(created) - slack),
        (64, seconds(modified) < seconds(delivery) - slack),
        (4, F.abs(seconds(header) - seconds(sent)) > wide),
        (8, F.exists(steps, lambda x: x)),
        (16, F.exists(real, lambda t: seconds(t) > seconds(now) + day)),
        (32, F.exists(real, lambda t: t < F.lit("1995-01-01 00:00:00").cast("timestamp"))),
    ]
    out = F.lit(0)
    for bit, test in tests:
        out = out + F.when(test, bit).otherwise(0)
    return out


def day_start_ms(day: date, zone: str = "UTC") -> Column:
    """Milliseconds of local midnight."""
    return F.unix_millis(F.to_utc_timestamp(F.lit(day.isoformat()).cast("timestamp"), zone))


_FORMS = [
    (r"(\d{4})-(\d{1,2})-(\d{1,2})", "ymd"),
    (r"(\d{1,2})/(\d{1,2})/(\d{4})", "dmy"),
    (r"(\d{4})-(\d{2})", "ym"),
    (r"(\d{4})", "y"),
    (r"(\d{2})\.(\d{2})\.(\d{4})", "dmy"),
]


def parse_day(text: str) -> date | None:
    """A date bound of a query; a partial one means its first day."""
    for form, order in _FORMS:
        m = re.fullmatch(form, text, re.ASCII)
        if m:
            v = dict(zip(order, map(int, m.groups()), strict=True))
            try:
                return datetime(v["y"], v.get("m", 1), v.get("d", 1)).date()
            except ValueError:
                continue
    return None
