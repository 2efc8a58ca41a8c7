"""Slots, time windows and schedule rules."""

from __future__ import annotations

import calendar
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import BACKTRACK_DAYS, DAY_SECONDS, SLOT_SECONDS


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def truncate(ts, unit: int) -> Column:
    ts = _c(ts)
    return (ts - ts % F.lit(unit)).cast("bigint")


def slot(ts="first") -> Column:
    return truncate(ts, SLOT_SECONDS)


def local_ts(ts, zone: str = "UTC") -> Column:
    """Wall-clock timestamp of an epoch column in a zone."""
    utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    at = utc + F.make_dt_interval(secs=_c(ts).cast("decimal(18,6)"))
    return at if zone == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(zone), at)


def slot_key(ts, zone: str = "UTC") -> Column:
    """``YYYYMMddHHMM`` text of an epoch column."""
    t = local_ts(ts, zone)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(F.lpad(F.year(t).cast("string"), 4, "0"), two(F.month(t)), two(F.dayofmonth(t)),
                    two(F.hour(t)), two(F.minute(t)))


def slot_epoch(key, zone: str = "UTC") -> Column:
    """Epoch seconds of a ``YYYYMMddHHMM`` text."""
    k = _c(key)
    days = F.datediff(F.make_date(k.substr(1, 4).cast("int"), k.substr(5, 2).cast("int"),
                                  k.substr(7, 2).cast("int")), F.lit("1970-01-01").cast("date"))
    secs = k.substr(9, 2).cast("int") * 3600 + k.substr(11, 2).cast("int") * 60
    epoch = days.cast("bigint") * DAY_SECONDS + secs
    if zone == "UTC":
        return epoch
    return F.unix_timestamp(F.to_utc_timestamp(F.timestamp_seconds(epoch), zone))


_DATE = re.compile(r"^(\d{4})(?:/(\d\d?)(?:/(\d\d?)(?:\.(\d\d?)(?::(\d\d?)(?::(\d\d?))?)?)?)?)?$")


def date_start(text: str) -> int:
    """First second (UTC) named by ``yyyy[/MM[/dd[.hh[:mm[:ss]]]]]``."""
    m = _DATE.match(text.strip())
    if not m:
        raise ValueError(f"not a date: {text!r}")
    year, *rest = (int(p) if p else None for p in m.groups())
    month, day, *clock = rest
    return calendar.timegm((year, month or 1, day or 1, *(x or 0 for x in clock)))


def parse_window(text: str) -> tuple[int | None, int | None, int]:
    """Parse a window text to ``(start, end, relative)``.

    ``a-b`` gives the first seconds of both dates as bounds, ``a`` alone has no end; ``+n`` and ``-n`` give the relative
    seconds.
    """
    text = text.strip()
    if text[:1] in "+-":
        return None, None, int(text)
    first, _, second = text.partition("-")
    return date_start(first), date_start(second) if second else None, 0


def time_window(flows: DataFrame, window: str) -> DataFrame:
    """Keep flows with ``first >= start and last <= end``, where the window has an end."""
    start, end, rel = parse_window(window)
    if not rel:
        late = F.col("first") >= start
        return flows.where(late if end is None else late & (F.col("last") <= end))
    span = flows.agg(F.min("first").alias("lo"), F.max("last").alias("hi")).first()
    if span.lo is None:
        return flows.limit(0)
    if rel > 0:
        return flows.where((F.col("first") >= span.lo) & (F.col("last") <= span.lo + rel))
    return flows.where((F.col("first") >= span.hi + rel) & (F.col("last") <= span.hi))


def schedule_ok(ts, rule, zone: str = "UTC", exact: bool = False) -> Column:
    """Weekday and time-of-day window of a rule, WITHIN or WITHOUT.

    ``rule`` is a rule or a column of one.  A weekday outside the rule's list passes only WITHOUT rules.  By default
    the second of the day is compared; ``exact=True`` compares hour, minute and second independently of each other.
    """
    t = local_ts(ts, zone)
    if isinstance(rule, Column):
        days, since, until = rule["weekday"], rule["stime"], rule["etime"]
        without = rule["coverrange"] == "WITHOUT"
    else:
        days, since, until = (F.array(*map(F.lit, x)).cast("array<int>") for x in (rule.weekday, rule.stime, rule.etime))
        without = F.lit(rule.coverrange == "WITHOUT")
    clock = (F.hour(t), F.minute(t), F.second(t))
    if exact:
        inside = F.lit(True)
        for i, part in enumerate(clock):
            inside = inside & part.between(since[i], until[i])
    else:
        def seconds(part) -> Column:
            return part[0] * 3600 + part[1] * 60 + part[2]
        inside = seconds(clock).between(seconds(since), seconds(until))
    due = F.array_contains(days, F.dayofweek(t) - 1) & inside
    return due != without


def align_range(start: int, end: int, step: int, unit: int = SLOT_SECONDS,
                latest: int | None = None, days: int = BACKTRACK_DAYS) -> tuple[int, int, int]:
    """Align a request to the unit and clamp it to the back-track and latest slot."""
    start -= start % unit
    end -= end % unit
    step = max(step - step % unit, unit)
    if latest is not None:
        latest -= latest % unit
        end = min(end, latest)
        start = max(start, latest - days * DAY_SECONDS)
    return start, end, step
