"""Backward as-of lookup of price quotes with an age limit, and a provider order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgauge.functions import fixed_values as fixed
from newsgauge.functions.numbers import synthetic_price
from newsgauge.operators.keyed import first_rows

QUOTE_FIELDS = ["quote_date", "close_price_usd", "data_source"]


def asof_quotes(lookups: DataFrame, quotes: DataFrame, max_age_days: int | None = 14,
                real_only: bool = True) -> DataFrame:
    """(ticker, as_of) keys -> the latest quote dated as_of - max_age .. as_of, or NULLs.

    Keys and quotes are cut to one row per ticker and day, put in one stream per ticker and
    carried forward. So a ticker costs at most two rows per calendar day, however many rows ask.
    ``quotes`` must be unique per (ticker, quote_date); tickers match whatever their case.
    """
    real = quotes.where(F.col("data_source") != "synthetic") if real_only else quotes
    marks = real.select(
        F.upper("ticker").alias("_key"), F.lit(None).cast("string").alias("ticker"), F.col("quote_date").alias("as_of"), F.lit(0).alias("_kind"),
        F.struct(*QUOTE_FIELDS).alias("_quote"))
    asks = lookups.select("ticker", "as_of").distinct().select(
        F.upper("ticker").alias("_key"), "ticker", "as_of", F.lit(1).alias("_kind"),
        F.lit(None).cast(marks.schema["_quote"].dataType).alias("_quote"))
    back = (Window.partitionBy("_key").orderBy("as_of", "_kind")
            .rowsBetween(Window.unboundedPreceding, 0))
    found = (marks.unionByName(asks)
             .withColumn("_quote", F.last("_quote", ignorenulls=True).over(back))
             .where(F.col("_kind") == 1))
    if max_age_days is not None:
        fresh = F.col("_quote.quote_date") >= F.date_sub("as_of", max_age_days)
        found = found.withColumn("_quote", F.when(fresh, F.col("_quote")))
    return found.select("ticker", "as_of", *[F.col(f"_quote.{f}").alias(f) for f in QUOTE_FIELDS])


def resolve_quotes(lookups: DataFrame, provider_quotes: DataFrame,
                   provider_order: Sequence[str] = tuple(fixed.PROVIDER_ORDER),
                   cached_quotes: DataFrame | None = None, max_age_days: int = 14,
                   synthetic_only: Sequence[str] = tuple(fixed.SYNTHETIC_ONLY_TICKERS),
                   provider_max_age: Mapping[str, int | None] | None = None,
                   days: Mapping[str, str] | None = None) -> DataFrame:
    """Priority fallback: the first provider with a quote in its look-back span, then a recent
    stored quote, else the synthetic close. Always one row per distinct (ticker, as_of).

    With ``days``, {prefix: date column}, every row of ``lookups`` stays, with the fields of the quote as of each of
    its days below the prefix. Rows and quotes move once, by ticker, whatever the number of days.

    ``provider_quotes`` is unique per (ticker, quote_date, data_source); tickers match whatever their case.

    All providers are carried forward in the same pass: one window, one array slot each.
    """
    by_rows = days is not None
    days = days if by_rows else {"": "as_of"}
    asks = lookups if by_rows else lookups.select("ticker", "as_of").distinct()
    key, fields = F.upper("ticker").alias("_key"), F.struct(*QUOTE_FIELDS).alias("_quote")

    def marks_of(quotes: DataFrame, slot: Column) -> DataFrame:
        return quotes.select(key, F.lit(0).alias("_kind"), slot.alias("_slot"), fields,
                             *[F.lit(None).cast(f.dataType).alias(f.name) for f in asks.schema])

    marks = marks_of(provider_quotes.where(F.col("data_source").isin(list(provider_order))), F.col("data_source"))
    if cached_quotes is not None:
        marks = marks.unionByName(marks_of(cached_quotes.where(F.col("data_source") != "synthetic"), F.lit("_cached")))
    rows = marks.unionByName(asks.select(
        key, F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("_slot"),
        F.lit(None).cast(marks.schema["_quote"].dataType).alias("_quote"), *asks.columns))
    slots = [*provider_order, "_cached"]
    ages = {**(fixed.PROVIDER_MAX_AGE if provider_max_age is None else provider_max_age), "_cached": max_age_days}

    def carried(rows: DataFrame, day: str) -> DataFrame:
        at = F.when(F.col("_kind") == 0, F.col("_quote.quote_date")).otherwise(F.col(day))
        back = Window.partitionBy("_key").orderBy(at, "_kind").rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumns({
            f"_q{i}": F.last(F.when(F.col("_slot") == slot, F.col("_quote")), ignorenulls=True).over(back)
            for i, slot in enumerate(slots)})

    def best(day: str) -> Column:
        def usable(i: int) -> Column:
            quote, age = F.col(f"_q{i}"), ages.get(slots[i])
            return quote if age is None else F.when(quote["quote_date"] >= F.date_sub(day, age), quote)

        fallback = F.struct(
            F.col(day).alias("quote_date"),
            synthetic_price(F.upper("ticker"), F.col(day)).alias("close_price_usd"),
            F.lit("synthetic").alias("data_source"))
        found = F.coalesce(*[usable(i) for i in range(len(slots))], fallback)
        return F.when(F.upper("ticker").isin(list(synthetic_only)), fallback).otherwise(found) if synthetic_only else found

    *earlier, (last, last_day) = days.items()
    for prefix, day in earlier:
        rows = carried(rows, day).withColumn(f"_as_of_{prefix}", F.when(F.col("_kind") == 1, best(day)))
    rows = carried(rows, last_day).where(F.col("_kind") == 1)

    def named(prefix: str, quote: Column) -> list[Column]:
        return [quote[f].alias(f"{prefix}_{f}" if by_rows else f) for f in QUOTE_FIELDS]

    # made once a row: a caller's filter on the price is not pushed below a generator, where it would make the price again
    rows = rows.select(*asks.columns, *[f"_as_of_{x}" for x, _ in earlier], F.explode(F.array(best(last_day))).alias("_last"))
    return rows.select(*asks.columns, *[c for x, _ in earlier for c in named(x, F.col(f"_as_of_{x}"))], *named(last, F.col("_last")))


def latest_quote_per_ticker(quotes: DataFrame) -> DataFrame:
    tidy = quotes.select(F.upper("ticker").alias("ticker"), *QUOTE_FIELDS)
    return first_rows(tidy, ["ticker"], [F.col("quote_date").desc_nulls_last(),
                                         F.col("close_price_usd").desc_nulls_last(),
                                         F.col("data_source")])


def best_quote_per_ticker(live: DataFrame, cached: DataFrame) -> DataFrame:
    """With a price first, then real sources, then the newest; live rows win full ties."""
    both = (live.withColumn("_feed", F.lit(0))
            .unionByName(cached.withColumn("_feed", F.lit(1)), allowMissingColumns=True))
    tidy = both.select(F.upper("ticker").alias("ticker"), *QUOTE_FIELDS, "_feed")
    made_up = F.lower(F.coalesce("data_source", F.lit(""))).rlike("synthetic|demo|unavailable")
    return first_rows(tidy, ["ticker"], [
        F.col("close_price_usd").isNull(), made_up, F.col("quote_date").desc_nulls_last(),
        F.col("_feed"), F.col("close_price_usd").desc()]).drop("_feed")
