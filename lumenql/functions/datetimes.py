"""Dates and times: Julian days, epochs, modifiers and format codes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Julian day of 1970-01-01 00:00.
EPOCH_DAY = 2440587.5


def unixepoch(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def julianday(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(86_400_000_000.0) + F.lit(EPOCH_DAY)


def from_julianday(day: Column) -> Column:
    return F.timestamp_micros(F.round((day - F.lit(EPOCH_DAY)) * 86_400_000_000.0, 0).cast("bigint"))


def modify(ts: Column, *modifiers: str) -> Column:
    """Applies modifiers in order: '+N days', '-N months', 'start of month|year|day', 'weekday N'. Adding months keeps the day and, like the
    reference, runs over into the next month where the day doesn't exist."""
    for m in modifiers:
        if got := re.fullmatch(r"([+-]?\d+)\s+(second|minute|hour|day|month|year)s?", m.strip()):
            n, unit = int(got[1]), got[2]
            if unit in ("month", "year"):
                first = F.date_trunc("month", ts)
                inside = F.unix_micros(ts.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))
                moved = F.add_months(first.cast("date"), n * (12 if unit == "year" else 1)).cast("timestamp")
                ts = F.timestamp_micros(F.unix_micros(moved) + inside)
            else:
                ts = F.timestamp_micros(F.unix_micros(ts.cast("timestamp")) + n * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit] * 1_000_000)
        elif got := re.fullmatch(r"start of (day|month|year)", m.strip()):
            ts = F.date_trunc(got[1], ts)
        elif got := re.fullmatch(r"weekday ([0-6])", m.strip()):
            ahead = F.pmod(F.lit(int(got[1]) + 1) - F.dayofweek(ts), F.lit(7))
            ts = F.timestamp_micros(F.unix_micros(ts.cast("timestamp")) + ahead * F.lit(86_400_000_000))
        else:
            raise ValueError(f"unknown modifier: {m}")
    return ts


def strftime(fmt: str, ts: Column) -> Column:
    """The codes %d %e %f %F %H %I %j %k %l %m %M %p %P %R %s %S %T %u %w %W %Y %%."""
    first = F.make_date(F.year(ts), F.lit(1), F.lit(1))
    monday = F.pmod(F.dayofweek(ts) + 5, F.lit(7))  # 0 for Monday
    simple = {"d": "dd", "F": "yyyy-MM-dd", "H": "HH", "I": "hh", "m": "MM", "M": "mm", "R": "HH:mm", "S": "ss", "T": "HH:mm:ss", "Y": "yyyy"}
    parts: list[Column] = []
    for lit, code in re.findall(r"([^%]+)|%(.)", fmt):
        if lit or code == "%":
            parts.append(F.lit(lit or "%"))
        elif code in simple:
            parts.append(F.date_format(ts, simple[code]))
        elif code in "ekl":
            n = {"e": F.dayofmonth(ts), "k": F.hour(ts), "l": F.pmod(F.hour(ts) + 11, F.lit(12)) + 1}[code]
            parts.append(F.lpad(n.cast("string"), 2, " "))
        elif code == "f":
            parts.append(F.date_format(ts, "ss.SSS"))
        elif code == "j":
            parts.append(F.lpad(F.dayofyear(ts).cast("string"), 3, "0"))
        elif code in "pP":
            ampm = F.when(F.hour(ts) < 12, "AM").otherwise("PM")
            parts.append(ampm if code == "p" else F.lower(ampm))
        elif code == "s":
            parts.append(unixepoch(ts).cast("string"))
        elif code == "u":
            parts.append((monday + 1).cast("string"))
        elif code == "w":
            parts.append((F.dayofweek(ts) - 1).cast("string"))
        elif code == "W":
            week = F.floor((F.datediff(ts.cast("date"), first) + 7 - monday) / 7)
            parts.append(F.lpad(week.cast("string"), 2, "0"))
        else:
            raise ValueError(f"unknown format: %{code}")
    return F.concat(*parts)


#: Nanoseconds.
MICROSECOND, MILLISECOND, SECOND, MINUTE, HOUR = 1_000, 1_000_000, 1_000_000_000, 60_000_000_000, 3_600_000_000_000
#: Julian days from -4713-11-24 12:00 to 9999-12-31, and the epoch seconds that the 'auto' modifier takes numbers beyond for.
LAST_DAY, FIRST_SECOND = 5373484.5, -210866760000


def parse(s: Column) -> Column:
    """A timestamp from text: a date, a date and time (blank or T between), a time (of 2000-01-01), or a Julian day; null for anything else."""
    t = F.trim(s)
    time = r"\d{2}:\d{2}(:\d{2}(\.\d+)?)?"
    day = F.when(t.rlike(rf"^\d{{4}}-\d{{2}}-\d{{2}}([ T]{time})?Z?$"), F.regexp_replace(F.regexp_replace(t, "Z$", ""), "T", " "))
    day = F.coalesce(day, F.when(t.rlike(rf"^{time}$"), F.concat(F.lit("2000-01-01 "), t)))
    return F.coalesce(day.try_cast("timestamp"), F.when(t.rlike(r"^\d+(\.\d*)?$"), from_julianday(F.when(t.try_cast("double") < LAST_DAY, t.try_cast("double")))))


def moment(x: Column, *modifiers: str) -> Column:
    """A timestamp from text or a number, the modifiers applied in order; the first of 'unixepoch', 'julianday' or 'auto' says what a number is."""
    rest = list(modifiers)
    kind = rest.pop(0) if rest and rest[0] in ("unixepoch", "julianday", "auto") else None
    if kind is None:
        ts = parse(x.cast("string"))
    else:
        n = x.cast("double")
        epoch, julian = F.timestamp_micros(F.round(n * 1_000_000).cast("bigint")), from_julianday(n)
        ts = {"unixepoch": epoch, "julianday": julian, "auto": F.when(n.between(0, LAST_DAY), julian).when(n >= FIRST_SECOND, epoch)}[kind]
    return modify(ts, *rest)


def _shown(ts: Column, pattern: str) -> Column:
    return F.date_format(ts, pattern)


def date(x: Column, *modifiers: str) -> Column:
    return _shown(moment(x, *modifiers), "yyyy-MM-dd")


def time(x: Column, *modifiers: str) -> Column:
    return _shown(moment(x, *modifiers), "HH:mm:ss")


def datetime(x: Column, *modifiers: str) -> Column:
    """Years before 1 have a minus sign."""
    ts = moment(x, *modifiers)
    return F.concat(F.when(F.year(ts) <= 0, "-").otherwise(""), F.lpad(F.abs(F.year(ts)).cast("string"), 4, "0"), _shown(ts, "-MM-dd HH:mm:ss"))


def localtime(ts: Column, zone: str) -> Column:
    """UTC to a zone's wall clock."""
    return F.from_utc_timestamp(ts, zone)


def utc(ts: Column, zone: str) -> Column:
    """A zone's wall clock to UTC."""
    return F.to_utc_timestamp(ts, zone)


def to_micro(ns: Column) -> Column:
    return ((ns - ns % MICROSECOND) / MICROSECOND).cast("bigint")


def to_seconds(ns: Column) -> Column:
    return ns / F.lit(float(SECOND))


def to_minutes(ns: Column) -> Column:
    return ns / F.lit(float(MINUTE))


def to_hours(ns: Column) -> Column:
    return ns / F.lit(float(HOUR))


def truncated(ns: Column, unit: int) -> Column:
    """Towards zero, to a multiple of the unit."""
    return ns - ns % F.lit(unit)


def rounded(ns: Column, unit: int) -> Column:
    """To the nearest multiple, halves away from zero."""
    rest = ns % F.lit(unit)
    return ns - rest + F.when(F.abs(rest) * 2 >= unit, F.signum(rest.cast("double")).cast("bigint") * unit).otherwise(0)
