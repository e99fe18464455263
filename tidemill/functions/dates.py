"""Times. Stored times are UTC without a zone; a local zone is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The formats that text times come in, in the order they are tried.
FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyyMMdd'T'HHmmss",
    "yyyy-MM",
    "yyyy MM",
    "yyyy-MM-dd",
    "yyyyMMdd",
    "MM/dd/yyyy hh:mm a",
    "dd MMM yyyy",
    "dd MMMM yyyy",
    "MMM dd, yyyy",
    "MMMM dd, yyyy",
    "yyyy-MM-dd HH:mm",
    "MM/dd/yyyy",
    "dd.MM.yyyy",
    "yyyy年MM月dd日 HH时mm分ss秒",
)


def parse_time(text: Column, zone: str = "UTC") -> Column:
    """A timestamp from text: digits are epoch seconds; a zone in the text counts; else the text is local to zone. Text in
    no known format is null."""
    t = F.trim(text)
    epoch = F.when(F.rlike(t, F.lit(r"^\d{1,12}$")), F.timestamp_seconds(t.try_cast("long")))
    zoned = F.when(F.rlike(t, F.lit(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$")), t.try_cast("timestamp"))
    plain = F.when(F.rlike(t, F.lit(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}\.\d+$")), t.try_cast("timestamp"))
    bare = F.regexp_replace(t, r"\s*[A-Z]{3,4}\s*$", "")
    named = F.coalesce(plain, *[F.try_to_timestamp(bare, F.lit(f)) for f in FORMATS])
    return F.coalesce(epoch, zoned, F.to_utc_timestamp(named, zone))


def from_digits(parts: Column, zone: str = "UTC") -> Column:
    """[year, month, day, hour, minute, second, (ms), (us)] as a timestamp; fewer than six or impossible digits are null."""
    second = parts[5] + F.coalesce(F.get(parts, F.lit(6)), F.lit(0)) / 1e3 + F.coalesce(F.get(parts, F.lit(7)), F.lit(0)) / 1e6
    made = F.try_make_timestamp(parts[0], parts[1], parts[2], parts[3], parts[4], second.cast("decimal(8,6)"))
    return F.when(F.size(parts) >= 6, F.to_utc_timestamp(made, zone))


def published(digits: Column, text: Column, raw: Column) -> Column:
    """Publishing time by precedence: digit list, parsed text, raw timestamp."""
    return F.coalesce(from_digits(digits), parse_time(text), raw)


def to_local(ts: Column, zone: str) -> Column:
    return F.from_utc_timestamp(ts, zone)


def to_utc(ts: Column, zone: str) -> Column:
    return F.to_utc_timestamp(ts, zone)


def local_text(ts: Column, zone: str, with_time: bool = True) -> Column:
    return F.coalesce(F.date_format(to_local(ts, zone), "yyyy-MM-dd HH:mm:ss" if with_time else "yyyy-MM-dd"), F.lit(""))


def epoch(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def shift_hours(ts: Column, hours: int) -> Column:
    return ts + F.make_dt_interval(hours=F.lit(hours))


def sunday_week(ts: Column) -> Column:
    """Week of the calendar year, 0 to 53; weeks start on Sunday, days before the first Sunday are week 0."""
    return F.floor((F.dayofyear(ts) + 7 - F.dayofweek(ts)) / 7).cast("int")


def aligned(ts: Column, unit: str) -> Column:
    """Start of the hour, day, Monday week, month or year that holds ts."""
    return F.date_trunc(unit, ts)


def bucket_end(start: Column, unit: str, n: int = 1) -> Column:
    if unit in ("month", "year"):
        return F.add_months(start, n * (12 if unit == "year" else 1)).cast("timestamp")
    return start + F.make_dt_interval(days=F.lit(n * {"hour": 0, "day": 1, "week": 7}[unit]), hours=F.lit(n if unit == "hour" else 0))


def label(ts: Column, unit: str) -> Column:
    if unit == "week":
        return F.concat(F.year(ts).cast("string"), F.lit("-W"), F.lpad(sunday_week(ts).cast("string"), 2, "0"))
    return F.date_format(ts, {"hour": "yyyy-MM-dd HH:00", "day": "yyyy-MM-dd", "month": "yyyy-MM"}[unit])


def previous_month(ts: Column) -> Column:
    return F.add_months(F.trunc(ts, "MM"), -1)


def iso_week(ts: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def archived(ts: Column, fallback: Column | None = None) -> Column:
    """Epoch seconds of an archive time: a time, or ISO text, without a zone in UTC. What is missing or no time has the
    fallback: by default none, as the present would differ from run to run; pass F.current_timestamp() for it."""
    at = ts.cast("string").try_cast("timestamp")
    return F.unix_micros(at if fallback is None else F.coalesce(at, fallback.cast("timestamp"))) / 1e6


def recency(ts: Column, now: Column, hours: float = 12) -> Column:
    """1 for now, 0 for `hours` ago or earlier."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (epoch(now) - epoch(ts)) / (hours * 3600)))
