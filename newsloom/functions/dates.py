"""Date columns.  Text that looks like ISO 8601 or RFC 822 is parsed by built-in
expressions; only ``parse_any`` takes the free-form parser, over Arrow."""

from __future__ import annotations

import datetime as dt
import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Minutes east of UTC of the abbreviations that feeds use.
ZONES = {
    name: minutes
    for minutes, names in {
        -480: "PST", -420: "PDT MST", -360: "MDT CST", -300: "CDT EST", -240: "EDT", 0: "Z GMT UTC", 60: "BST CET", 120: "CEST EET", 180: "EEST MSK", 300: "PKT", 330: "IST SLST",
        345: "NPT", 360: "BDT", 420: "WIB", 480: "AWST HKT PHT SGT", 540: "JST KST", 570: "ACST", 600: "AEST", 660: "AEDT", 720: "NZST", 780: "NZDT",
    }.items()
    for name in names.split()
}
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def parse_iso(c: Column) -> Column:
    """Timestamp of ISO text (a naive one is UTC), else null."""
    good = c.rlike(r"^\s*\d{4}-\d{1,2}-\d{1,2}(?:[T ]\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?\s*(?:Z|[+-]\d{2}:?\d{2})?)?\s*$")
    return F.when(good, F.try_to_timestamp(F.regexp_replace(F.trim(c), r"([+-]\d{2})(\d{2})$", "$1:$2")))


def parse_rfc822(c: Column) -> Column:
    """Timestamp of ``[Mon, ]02 Jan 2024 03:04[:05] zone``, else null."""
    pattern = r"^\s*(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(\d{4})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([A-Za-z]+|[+-]\d{4})?\s*$"
    g = lambda n: F.regexp_extract(c, pattern, n)
    month = F.array_position(F.array(*map(F.lit, _MONTHS)), F.lower(g(2)))
    zones = F.create_map(*[F.lit(x) for k, v in ZONES.items() for x in (k, v)])
    sign = F.when(F.substring(g(7), 1, 1) == "-", -1).otherwise(1)
    digits = F.regexp_extract(g(7), r"[+-](\d{2})(\d{2})", 1), F.regexp_extract(g(7), r"[+-](\d{2})(\d{2})", 2)
    offset = F.when(
        digits[0] != "",
        sign * (F.try_to_number(digits[0], F.lit("99")) * 60 + F.try_to_number(digits[1], F.lit("99")))
    ).otherwise(F.coalesce(F.try_element_at(zones, F.upper(g(7))), F.lit(0)))
    text = F.format_string(
        "%s-%02d-%s %s:%s:%s", g(3), month.cast("int"), F.lpad(g(1), 2, "0"), F.lpad(g(4), 2, "0"), g(5),
        F.when(g(6) == "", "00").otherwise(g(6))
    )
    local = F.when((g(1) != "") & (month > 0), F.try_to_timestamp(text))
    return F.timestamp_micros(F.unix_micros(local) - offset.cast("long") * 60_000_000)


def parse_ts(c: Column) -> Column:
    return F.coalesce(parse_iso(c), parse_rfc822(c))


def _parse_any(column: pa.Array) -> pa.Array:
    import warnings

    from dateutil import parser

    zones, out = {k: v * 60 for k, v in ZONES.items()}, []
    for raw in column.to_pylist():
        when = None
        if raw:
            try:
                with warnings.catch_warnings(action="ignore"):
                    when = parser.parse(raw, tzinfos=zones)
                when = when.replace(tzinfo=dt.UTC) if when.tzinfo is None else when.astimezone(dt.UTC)
            except (ValueError, OverflowError, TypeError):
                when = None
        out.append(when)
    return pa.array(out, pa.timestamp("us", "UTC"))


def parse_any(c: Column) -> Column:
    """Timestamp of free-form date text: built-in where that works, Arrow for the rest."""
    return F.coalesce(parse_ts(c), F.arrow_udf(_parse_any, T.TimestampType())(c))


def date_text(c: Column) -> Column:
    """ISO text of a timestamp in UTC with its offset."""
    plain = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(c), F.lit(1_000_000))
    return F.concat(plain, F.when(micros > 0, F.format_string(".%06d", micros)).otherwise(""), F.lit("+00:00"))


_UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 7 * 86400, "month": 30 * 86400, "year": 365 * 86400}


def relative_date(c: Column, as_of: Column) -> Column:
    """ISO text of ``2 hours ago`` counted from ``as_of``; other text as it is."""
    pattern = r"(?i)(\d+)\s*(second|minute|hour|day|week|month|year)s?\s+ago"
    n = F.regexp_extract(c, pattern, 1).try_cast("long")
    unit = F.create_map(*[F.lit(x) for k, v in _UNIT_SECONDS.items() for x in (k, v)])
    seconds = n * F.try_element_at(unit, F.lower(F.regexp_extract(c, pattern, 2)))
    return F.coalesce(date_text(F.timestamp_micros(F.unix_micros(as_of) - seconds * 1_000_000)), c)


def valid_date(c: Column, as_of: Column) -> Column:
    """Between 1995 and two days from now."""
    return (F.year(c) >= 1995) & (c <= as_of + F.expr("INTERVAL 2 DAYS"))


def age_hours(c: Column, as_of: Column, signed: bool = False) -> Column:
    """Hours from ``c`` to ``as_of``: 0 for a future date, below 0 where ``signed``."""
    age = (F.unix_micros(as_of) - F.unix_micros(c)) / 3_600_000_000
    return age if signed else F.when(age < 0, 0.0).otherwise(age)  # greatest() would skip a null


def freshness(c: Column, as_of: Column, half: float = 48.0, signed: bool = False) -> Column:
    """exp(-age in hours / 48): 0 without a date; 1 for a future one, more where ``signed``."""
    power = -age_hours(c, as_of, signed) / half
    return F.coalesce(F.arrow_udf(_exp, T.DoubleType())(power) if signed else F.exp(power), F.lit(0.0))


def _exp(powers: pa.Array) -> pa.Array:
    """By the C library.  Where a value is large all its digits show, and the JVM's last
    one is often another."""

    def one(x: float | None) -> float | None:
        try:
            return None if x is None else math.exp(x)
        except OverflowError:
            return math.inf

    return pa.array([one(x) for x in powers.to_pylist()], pa.float64())


def display(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm 'UTC'")


def day_of(value: str | dt.date | dt.datetime | None, field: str) -> str | None:
    """A request's date as YYYY-MM-DD, or None."""
    if value is None or (isinstance(value, str) and not value.strip()):
        return None
    if isinstance(value, dt.datetime):
        return value.date().isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if not isinstance(value, str):
        raise ValueError(f"{field} must be a date or its text, got {type(value).__name__}")
    try:
        return dt.datetime.fromisoformat(value.strip().replace("Z", "+00:00").replace("z", "+00:00")).date().isoformat()
    except ValueError:
        raise ValueError(f"{field}={value!r} is no date; YYYY-MM-DD or ISO 8601 is") from None
