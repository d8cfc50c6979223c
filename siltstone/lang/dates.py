"""Dates in queries: accepted formats, the granularity of a literal, and parsing in Spark."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.lang.jexl import QueryError

# The accepted date formats, tried in this order.
FORMATS = [
    "yyyyMMdd:HH:mm:ss:SSSZ",
    "yyyyMMdd:HH:mm:ss:SSS",
    "EEE MMM dd HH:mm:ss zzz yyyy",
    "d MMM yyyy HH:mm:ss 'GMT'",
    "yyyy-MM-dd HH:mm:ss.SSS Z",
    "yyyy-MM-dd HH:mm:ss.SSS",
    "yyyy-MM-dd HH:mm:ss.S Z",
    "yyyy-MM-dd HH:mm:ss.S",
    "yyyy-MM-dd HH:mm:ss Z",
    "yyyy-MM-dd HH:mm:ssz",
    "yyyy-MM-dd HH:mm:ss",
    "yyyyMMdd HHmmss",
    "yyyy-MM-dd'T'HH'|'mm",
    "yyyy-MM-dd'T'HH':'mm':'ss'.'SSS'Z'",
    "yyyy-MM-dd'T'HH':'mm':'ss'Z'",
    "MM'/'dd'/'yyyy HH':'mm':'ss",
    "E MMM d HH:mm:ss z yyyy",
    "yyyyMMdd_HHmmss",
    "yyyy-MM-dd",
    "MM/dd/yyyy",
    "yyyy-MMMM",
    "yyyy-MMM",
    "yyyyMMddHHmmss",
    "yyyyMMddHHmm",
    "yyyyMMddHH",
    "yyyyMMdd",
]

MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
PARTS = {
    "y": (r"\d{4}", "year"), "M": (r"\d{1,2}", "month"), "d": (r"\d{1,2}", "day"), "H": (r"\d{1,2}", "hour"), "m": (r"\d{1,2}", "minute"),
    "s": (r"\d{1,2}", "second"), "S": (r"\d{1,3}", "milli"), "Z": (r"[+-]\d{4}|Z", "zone"), "z": (r"[A-Za-z]{1,5}|[+-]\d{4}", "zone"), "E": (r"[A-Za-z]+", "weekday"),
}
UNITS = ["milli", "second", "minute", "hour", "day", "month", "year"]


def _regex(pattern: str) -> re.Pattern:
    out = []
    for m in re.finditer(r"'([^']*)'|([A-Za-z])\2*|(.)", pattern):
        if m[1] is not None or m[3]:
            out.append(re.escape(m[1] if m[1] is not None else m[3]))
        else:
            run, kind = m[0], PARTS.get(m[2])
            if not kind:
                raise QueryError(f"unknown letter {m[2]} in the date format {pattern}")
            digits = kind[0] if kind[1] in ("zone", "weekday", "milli") else rf"\d{{{len(run)}}}" if len(run) > 1 else kind[0]
            out.append(f"(?P<{kind[1]}>{'[A-Za-z]+' if kind[1] == 'month' and len(run) > 2 else digits})")
    return re.compile("".join(out))


def granularity(pattern: str) -> str:
    """The finest unit that a format has."""
    have = {PARTS[c][1] for c in re.sub(r"'[^']*'", "", pattern) if c in PARTS}
    return next((u for u in UNITS if u in have), "day")


def _read(text: str, pattern: str) -> datetime | None:
    m = _regex(pattern).fullmatch(text)
    if not m:
        return None
    g = m.groupdict()
    month = g.get("month") or "1"
    if not month.isdigit():
        names = [i for i, n in enumerate(MONTHS, 1) if n.startswith(month.lower()[:3])]
        if not names:
            return None
        month = names[0]
    try:
        at = datetime(int(g.get("year") or 1970), int(month), int(g.get("day") or 1), int(g.get("hour") or 0), int(g.get("minute") or 0), int(g.get("second") or 0), 1000 * int(g.get("milli") or 0), timezone.utc)
    except ValueError:
        return None
    zone = g.get("zone") or "Z"
    if zone[0] in "+-":
        at -= (1 if zone[0] == "+" else -1) * timedelta(hours=int(zone[1:3]), minutes=int(zone[3:5]))
    return at


def parse_date(text: str, pattern: str | None = None) -> tuple[datetime, str]:
    """The instant of a literal and its granularity; e stands for milliseconds since 1970."""
    if pattern == "e":
        return datetime.fromtimestamp(int(text) / 1000, timezone.utc), "milli"
    for f in [pattern] if pattern else FORMATS:
        at = _read(text, f)
        if at:
            return at, granularity(f)
    raise QueryError(f"not a date: {text!r}")


def following(at: datetime, unit: str) -> datetime:
    """The instant one unit later."""
    if unit in ("year", "month"):
        months = at.year * 12 + at.month - 1 + (12 if unit == "year" else 1)
        day = at.day
        while True:
            try:
                return at.replace(year=months // 12, month=months % 12 + 1, day=day)
            except ValueError:
                day -= 1
    return at + {"milli": timedelta(milliseconds=1), "second": timedelta(seconds=1), "minute": timedelta(minutes=1), "hour": timedelta(hours=1), "day": timedelta(days=1)}[unit]


def millis(at: datetime) -> int:
    return int((at - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(milliseconds=1))


#: Formats that Spark's parser can try on column values; offsets and names are left to ISO parsing.
COLUMN_FORMATS = ["yyyyMMdd:HH:mm:ss:SSS", "yyyyMMdd HHmmss", "yyyy-MM-dd'T'HH'|'mm", "MM/dd/yyyy HH:mm:ss", "yyyyMMdd_HHmmss", "MM/dd/yyyy", "yyyyMMddHHmmss", "yyyyMMddHHmm", "yyyyMMddHH", "yyyyMMdd"]


def column_millis(value: Column, kind: str, pattern: str | None = None) -> Column:
    """Milliseconds since 1970 of a value; ``kind`` is its Spark type."""
    if kind.startswith("timestamp") or kind == "date":
        return F.unix_millis(value.cast("timestamp"))
    if kind in ("bigint", "int") or pattern == "e":
        return value.cast("bigint")
    if pattern:
        return F.unix_millis(F.try_to_timestamp(value, F.lit(pattern)))
    return F.unix_millis(F.coalesce(F.expr("cast(null as timestamp)"), *[F.try_to_timestamp(value, F.lit(f)) for f in COLUMN_FORMATS], value.try_cast("timestamp")))
