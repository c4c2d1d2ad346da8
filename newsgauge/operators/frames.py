"""Column-level helpers: defaults, tolerant projections, ticker and date filters."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Partition column of stored tables by the timestamp it comes from.
DAY_OF = {"published_at_utc": "published_day"}


def with_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Absent columns are added and NULLs filled with the given value."""
    return df.withColumns({
        name: F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value)
        for name, value in defaults.items()
    })


def keep_existing(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.select([name for name in names if name in df.columns])


def filter_tickers(df: DataFrame, tickers: Iterable[str] | DataFrame | None) -> DataFrame:
    """Case-insensitive membership. A list becomes an IN set, a DataFrame a semi join.

    None or an empty list means no filter.
    """
    if tickers is None:
        return df
    if isinstance(tickers, DataFrame):
        wanted = tickers.select(F.upper("ticker").alias("_wanted")).distinct()
        return df.join(wanted, F.upper(df["ticker"]) == wanted["_wanted"], "left_semi")
    wanted = [t.upper() for t in tickers]
    return df.where(F.upper("ticker").isin(wanted)) if wanted else df


def between_dates(df: DataFrame, column: str, start: date, end: date) -> DataFrame:
    """Inclusive range on a date column; unreadable values drop out."""
    kind = df.schema[column].dataType.typeName()
    day = F.col(column) if kind == "date" else F.try_to_timestamp(F.col(column).cast("string")).cast("date")
    return df.withColumn(column, day).where(F.col(column).between(F.lit(start), F.lit(end)))


def within_days(df: DataFrame, column: str, low: Column | None, high: Column | None) -> DataFrame:
    """Limits the day partitions of a stored table to those of [low, high); other tables stay as they are."""
    day = DAY_OF.get(column)
    if day is None or day not in df.columns:
        return df
    if low is not None:
        df = df.where(F.col(day) >= low.cast("date"))
    return df if high is None else df.where(F.col(day) <= high.cast("date"))


def between_days_of(df: DataFrame, column: str, start: date, end: date) -> DataFrame:
    """Inclusive range on the UTC day of a timestamp, written half-open so that file statistics and
    day partitions prune."""
    low = F.lit(start).cast("timestamp")
    high = F.lit(end + timedelta(days=1)).cast("timestamp")
    return within_days(df, column, low, high).where((F.col(column) >= low) & (F.col(column) < high))


def as_one(df: DataFrame) -> DataFrame:
    """The same rows, carried as one value: every reader then asks for all columns, so their plans below are equal
    and Spark computes them once (pruned to different columns, each reader would read the source again)."""
    packed = df.select(F.array(F.struct(*df.columns)).alias("_row"))
    return packed.select(*[F.element_at("_row", 1)[name].alias(name) for name in df.columns])


def shared_exchange(df: DataFrame, spread: Iterable[str]) -> DataFrame:
    """Rows dealt out by ``spread`` in an exchange that all readers share. Readers must not filter on its columns
    directly, nor join on them: the filter, or that of null keys, would move below the exchange and make it another one.
    ``taken`` does it for them."""
    names = df.columns
    packed = df.select(*spread, F.array(F.struct(*names)).alias("_row")).repartition(*spread)
    return packed.select(*[F.element_at("_row", 1)[name].alias(name) for name in names])


def taken(df: DataFrame, keep: Column) -> DataFrame:
    """The rows of a shared exchange for which ``keep`` holds. They pass a generator, which neither this filter nor a
    later one moves below."""
    names = df.columns
    rows = df.select(F.explode(F.array(F.struct(keep.alias("_keep"), *names))).alias("_row"))
    return rows.where("_row._keep").select(*[F.col("_row")[name].alias(name) for name in names])


def at_latest(df: DataFrame, column: str) -> DataFrame:
    """Rows on the latest value of a column (one scalar subquery, no join)."""
    return df.where(F.col(column) == df.agg(F.max(column)).scalar())


def union_all(*frames: DataFrame) -> DataFrame:
    """UNION ALL by name; a column that one side lacks is NULL there."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result


def split_list(text: Column, separator: str = ",") -> Column:
    """Ticker list in one text: trimmed, upper, blanks and # comments dropped."""
    parts = F.transform(F.split(text, separator), lambda p: F.upper(F.trim(p)))
    return F.filter(parts, lambda p: (p != "") & ~p.startswith("#"))
