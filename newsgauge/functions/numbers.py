"""Numeric and date expressions shared by the plans."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column) -> Column:
    """Division where a zero or NULL divisor gives NULL."""
    return F.try_divide(top, F.nullif(bottom, F.lit(0)))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(value, F.lit(float(high))), F.lit(float(low)))


def as_number(df: DataFrame, name: str, default: float = 0.0) -> Column:
    """A double column; absent columns, NULLs and unreadable text give the default."""
    if name not in df.columns:
        return F.lit(float(default))
    number = F.col(name).try_cast("double")
    return F.coalesce(F.when(~F.isnan(number), number), F.lit(float(default)))


def text_to_double(text: Column) -> Column:
    """The number in a text, or NULL. Text that cannot be one is told by its letters: a cast that fails costs an
    exception a row."""
    return F.when(text.rlike("(?i)[0-9]|nan|inf"), text.try_cast("double"))


def nan_as_null(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names if n in df.columns})


def tier_weight(tier: Column, weights: Iterable[tuple[int, float]], other: float) -> Column:
    result = F.lit(float(other))
    for value, weight in weights:
        result = F.when(tier == value, F.lit(float(weight))).otherwise(result)
    return result


def label_by_threshold(score: Column, positive: float = 0.12, negative: float = -0.12) -> Column:
    return (F.when(score >= positive, F.lit("positive"))
            .when(score <= negative, F.lit("negative"))
            .otherwise(F.lit("neutral")))


def zscore(value: Column, mean: Column, stddev: Column, zero_undefined: bool = False) -> Column:
    z = ratio(value - mean, stddev)
    return F.coalesce(z, F.lit(0.0)) if zero_undefined else z


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once and hands it to ``body``, so a long formula is not repeated."""
    return F.transform(F.array(value), body)[0]


def round_exact(value: Column, digits: int) -> Column:
    """Rounds the binary value, exact halves to even.

    ``round`` works on the printed decimal and moves every 'x.xx5' up. Where values come in such
    steps the difference shows, so the product with 10^digits is taken with its rounding error.
    """
    scale = float(10 ** digits)

    def parts(v: Column) -> Column:
        big = v * 134217729.0  # 2^27 + 1 splits a double in two exact halves
        high = big - (big - v)
        scaled = v * scale
        return F.struct(scaled.alias("scaled"), F.floor(scaled).cast("double").alias("low"),
                        ((high * scale - scaled) + (v - high) * scale).alias("error"))

    def whole(p: Column) -> Column:
        low, rest = p["low"], p["scaled"] - p["low"]
        up = F.when(p["error"] != 0, p["error"] > 0).otherwise(low % 2 != 0)
        return F.when((rest > 0.5) | ((rest == 0.5) & up), low + 1).otherwise(low) / scale

    return let(value, lambda v: let(parts(v), whole))


def age_hours(ts: Column, as_of: Column) -> Column:
    return round_exact((F.unix_micros(as_of) - F.unix_micros(ts)) / F.lit(3.6e9), 2)


def forward_return_pct(entry: Column, current: Column) -> Column:
    return F.round(ratio(current - entry, entry) * 100, 6)


def direction_correct(label: Column, move_pct: Column) -> Column:
    return (F.when(label == "positive", move_pct > 0)
            .when(label == "negative", move_pct < 0)
            .otherwise(F.abs(move_pct) <= 1.0))


def evaluation_status(as_of: Column, start: Column, horizon: Column) -> Column:
    return F.when(as_of >= F.date_add(start, horizon), F.lit("matured")).otherwise(F.lit("marked"))


def synthetic_price(ticker: Column, day: Column) -> Column:
    """Deterministic fallback close from the digest of 'ticker:date'."""
    def price(digest: Column) -> Column:
        def hex_at(start: int, length: int) -> Column:
            return F.conv(F.substring(digest, start, length), 16, 10).cast("bigint")

        base = F.lit(40) + hex_at(1, 6) % 360
        drift = (hex_at(7, 4) % 900 - 450) / F.lit(1000.0)
        return F.greatest(F.lit(5.0), base * (1 + drift / 10))

    return round_exact(let(F.sha2(F.concat_ws(":", ticker, day.cast("string")), 256), price), 2)


def epoch_seconds(day: Column) -> Column:
    return F.unix_seconds(day.cast("timestamp"))


def inclusive_days(first: Column, last: Column) -> Column:
    return F.datediff(last, first) + 1
