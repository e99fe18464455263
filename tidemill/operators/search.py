"""Field, keyword and time-range search with paging."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _time(value: str) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def time_between(name: str, start: str | None, end: str | None) -> Column:
    """Closed range; an open end is None. As a filter it leaves null times out, and reaches the scan: a comparison of a
    plain column with a literal is pushed down, one inside coalesce is not."""
    cond = F.lit(True)
    if start is not None:
        cond &= F.col(name) >= _time(start)
    if end is not None:
        cond &= F.col(name) <= _time(end)
    return cond


def time_between_any(names: list[str], start: str | None, end: str | None) -> Column:
    """Closed range over any of the time columns (schema generations)."""
    return reduce(lambda a, b: a | b, [time_between(n, start, end) for n in names])


def score_at_least(threshold: float, *names: str) -> Column:
    """A filter for rows of which any score column (schema generation) reaches the threshold; null scores do not."""
    return reduce(lambda a, b: a | b, [F.col(n) >= threshold for n in names])


def any_of(name: str, values: list[str]) -> Column:
    """A filter for lists that hold any of the values; no values: everything."""
    return F.arrays_overlap(F.col(name), F.array(*map(F.lit, values))) if values else F.lit(True)


def _word(keyword: str) -> str:
    return r"\b" + re.escape(keyword) + r"\b"


def keywords_any(text: str, *names: str) -> Column:
    """Whitespace-separated keywords, any of them as a whole word in any field, whatever the case. The fields are joined
    once, so one regex pass serves all of them."""
    words = text.split()
    if not words:
        return F.lit(True)
    joined = F.concat_ws("\n", *[F.col(n) for n in names])
    return F.rlike(joined, F.lit("(?i)(?:" + "|".join(map(_word, words)) + ")"))


def keywords_all(text: str, *names: str) -> Column:
    """Every keyword as a whole word in at least one field; no keywords: everything."""
    joined = F.concat_ws("\n", *[F.col(n) for n in names])
    return reduce(lambda a, b: a & b, [F.rlike(joined, F.lit("(?i)" + _word(w))) for w in text.split()], F.lit(True))


def not_blank(name: str) -> Column:
    return F.coalesce(F.rlike(F.col(name), F.lit(r"^\s*\S+")), F.lit(False))


def by_ids(df: DataFrame, name: str, ids: DataFrame | list, light: list[str] | None = None) -> DataFrame:
    """Rows with the given ids; a list becomes a predicate that reaches the scan, a table a semi-join. light: columns to
    leave out."""
    rows = df.where(F.col(name).isin(ids)) if isinstance(ids, list) else df.join(ids, name, "left_semi")
    return rows.drop(*light) if light else rows


def with_defaults(df: DataFrame, lists: list[str] = (), texts: list[str] = (), maps: list[str] = ()) -> DataFrame:
    """Null lists, texts and maps become empty ones."""
    kinds = dict(df.dtypes)
    new = {n: F.coalesce(F.col(n), F.array().cast(kinds[n])) for n in lists}
    new |= {n: F.coalesce(F.col(n), F.lit("")) for n in texts}
    new |= {n: F.coalesce(F.col(n), F.create_map().cast(kinds[n])) for n in maps}
    return df.withColumns(new) if new else df


def page(df: DataFrame, order: list[Column], skip: int = 0, limit: int = 0) -> DataFrame:
    """One page in the given order, with total (rows before paging) and pos (rank from 1). A skip or limit of 0 or less is
    ignored. The total is an aggregate of its own, so the page needs only the top skip + limit rows of each task; the
    broadcast side is that one row. Without a limit rows are ranked where the sort put them, range by range."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    if limit > 0:
        ranked = df.orderBy(*order).limit(max(skip, 0) + limit).withColumn("pos", F.row_number().over(Window.orderBy(*order)))
    else:
        ranked = _ranked(df, order)
    if skip > 0:
        ranked = ranked.where(F.col("pos") > skip)
    return ranked.crossJoin(F.broadcast(total))


def _ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    """All rows with pos: rows of a sorted range count from the number of rows in the ranges before it. The sorted rows are
    written once, as ranges that are sorted again may be cut elsewhere; the driver sees one number for each range."""
    from ..sources.tables import checkpointed

    rows = checkpointed(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r.part, r.n) for r in rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, starts = 0, [F.lit(None).cast("long")] * (counts[-1][0] + 1 if counts else 1)
    for number, n in counts:
        starts[number] = F.lit(before)
        before += n
    return rows.withColumn("pos", (F.get(F.array(*starts), part.cast("int")) + place + 1).cast("int")).drop("_at")


def newest(df: DataFrame, ts: str, key: str) -> DataFrame:
    """Number of rows, the newest row's key, and its time as epoch seconds."""
    last = F.max(F.struct(F.col(ts), F.col(key)))
    return df.agg(F.count(F.lit(1)).alias("total"), last[key].alias("newest_id"), (F.unix_micros(last[ts].cast("timestamp")) / 1e6).alias("newest_epoch"))


def top_counts(df: DataFrame, key: str, n: int, name: str = "n") -> DataFrame:
    """The n most frequent keys; equal counts in order of the key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name)).orderBy(F.col(name).desc(), key).limit(n)


def first_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def coerce_bool(value: Column, default: bool = False) -> Column:
    text = F.lower(F.trim(value.cast("string")))
    return F.when(text.isin("true", "1", "yes", "y", "on"), True).when(text.isin("false", "0", "no", "n", "off"), False).otherwise(default)


def split_list(value: Column) -> Column:
    """A comma-separated parameter as a list of trimmed, non-empty items."""
    return F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != "")


def lastmod_in_range(lastmod: Column, start: str | None, end: str | None) -> Column:
    """Missing or unparseable times are inside."""
    ts = lastmod.try_cast("timestamp_ntz")
    cond = F.lit(True)
    if start is not None:
        cond &= ts >= _time(start)
    if end is not None:
        cond &= ts <= _time(end)
    return F.coalesce(cond, F.lit(True))


def url_date_in_range(url: Column, start: str, end: str) -> Column:
    """Whether the date in an address lies in the range: a full date by itself, a bare year before .xml by overlap; an
    address without a date is inside."""
    day = F.regexp_extract(url, r"(\d{4}-\d{2}-\d{2})", 1).try_cast("date")
    named = F.regexp_extract(url, r"(\d{4}-[A-Za-z]+-\d{1,2})", 1)
    month = F.coalesce(F.to_date(F.try_to_timestamp(named, F.lit("yyyy-MMMM-d"))), F.to_date(F.try_to_timestamp(named, F.lit("yyyy-MMM-d"))))
    year = F.regexp_extract(url, r"(\d{4})\.xml", 1).try_cast("int")
    at = F.coalesce(day, month).cast("timestamp_ntz")
    inside = at.between(_time(start), _time(end))
    overlap = (F.make_date(year, F.lit(12), F.lit(31)) >= _time(start).cast("date")) & (F.make_date(year, F.lit(1), F.lit(1)) <= _time(end).cast("date"))
    return F.coalesce(inside, overlap, F.lit(True))
