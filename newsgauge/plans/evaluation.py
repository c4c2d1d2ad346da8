"""Forward-return evaluation of insights and its summaries."""

from __future__ import annotations

from datetime import date
from inspect import signature

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgauge.functions.numbers import (as_number, direction_correct, evaluation_status,
                                         forward_return_pct, ratio)
from newsgauge.operators.asof import QUOTE_FIELDS, resolve_quotes
from newsgauge.operators.frames import union_all
from newsgauge.operators.median import exact_median
from newsgauge.session import staged


def evaluate_insights(insights: DataFrame, quotes: DataFrame, as_of: date,
                      resolve=resolve_quotes) -> DataFrame:
    """Entry quote at the insight date, current quote at min(as_of, insight date + horizon).

    ``resolve`` is ``resolve_quotes`` or takes its ``days``: the insights then get both quotes where they meet the
    quotes of their ticker. Any other ``resolve(lookups, quotes)`` answers each distinct (ticker, as_of) once for both roles.
    """
    today = F.lit(as_of)
    horizon = F.coalesce("horizon_days", F.lit(5))
    rows = (insights.where(F.col("insight_id").isNotNull())
            .withColumn("horizon_days", horizon)
            .withColumn("evaluation_date", F.least(today, F.date_add("insight_date", F.col("horizon_days"))))
            .where(F.col("evaluation_date") >= F.col("insight_date")))
    both = _with_both_quotes(rows, quotes, resolve)
    move = forward_return_pct(F.col("entry_close_price_usd"), F.col("current_close_price_usd"))
    sources = F.array("entry_data_source", "current_data_source")
    raw_move = ratio(F.col("current_close_price_usd") - F.col("entry_close_price_usd"),
                     F.col("entry_close_price_usd")) * 100
    return both.select(
        "insight_id", "ticker", "insight_date", "evaluation_date", "signal_label",
        (F.col("recommendation") if "recommendation" in rows.columns
         else F.lit(None).cast("string").alias("recommendation")),
        "signal_score", "horizon_days",
        F.col("entry_quote_date"), F.col("current_quote_date"),
        F.col("entry_close_price_usd").alias("entry_price_usd"),
        F.col("current_close_price_usd").alias("current_price_usd"),
        move.alias("forward_return_pct"),
        direction_correct(F.col("signal_label"), raw_move).cast("int").alias("direction_correct"),
        (~F.array_contains(sources, "synthetic")).cast("int").alias("is_real_market_data"),
        evaluation_status(today, F.col("insight_date"), F.col("horizon_days")).alias("evaluation_status"),
        F.array_join(F.sort_array(F.array_distinct(sources)), ",").alias("data_source"))


def _with_both_quotes(rows: DataFrame, quotes: DataFrame, resolve) -> DataFrame:
    """Rows of known tickers that have a price on both days, with the fields of the quotes."""
    roles = {"entry": "insight_date", "current": "evaluation_date"}
    if "days" in signature(resolve).parameters:
        found = resolve(rows.where(F.col("ticker").isNotNull()), quotes, days=roles)
        return found.where(F.col("entry_close_price_usd").isNotNull() & F.col("current_close_price_usd").isNotNull())
    lookups = union_all(*[rows.select("ticker", F.col(day).alias("as_of")) for day in roles.values()])
    answers = resolve(lookups, quotes).where(F.col("close_price_usd").isNotNull())
    for prefix, day in roles.items():
        rows = rows.join(answers.select("ticker", F.col("as_of").alias(day),
                                        *[F.col(f).alias(f"{prefix}_{f}") for f in QUOTE_FIELDS]), ["ticker", day])
    return rows


def _real(value: Column) -> Column:
    return F.when(F.col("is_real_market_data") == 1, value)


def performance_summary(evaluations: DataFrame) -> DataFrame:
    """Overall, per signal label and per recommendation, in one pass over three tags per row.

    The median needs three passes, so the few columns that are summed up are stored and the evaluations made once.
    """
    labels = [x for x in ("signal_label", "recommendation") if x in evaluations.columns]
    evaluations = staged(evaluations.select(*labels, "direction_correct", "is_real_market_data", "forward_return_pct",
                                            "evaluation_status"), "evaluations")
    tags = [F.lit("overall"), F.concat(F.lit("signal:"), F.col("signal_label"))]
    if "recommendation" in evaluations.columns:
        tags.append(F.concat(F.lit("recommendation:"), F.col("recommendation")))
    tagged = evaluations.select(
        F.explode(F.array_compact(F.array(*tags))).alias("segment"), "direction_correct",
        "is_real_market_data", "forward_return_pct", "evaluation_status")
    move, right = F.col("forward_return_pct"), F.col("direction_correct")
    zero = F.lit(0.0)
    summary = tagged.groupBy("segment").agg(
        F.count(F.lit(1)).alias("evaluated_insights"),
        F.sum("is_real_market_data").alias("real_market_evaluations"),
        F.count_if(F.col("is_real_market_data") == 0).alias("synthetic_evaluations"),
        (F.avg(right) * 100).alias("win_rate_pct"),
        F.coalesce(F.avg(_real(right)) * 100, zero).alias("real_win_rate_pct"),
        F.avg(move).alias("avg_forward_return_pct"),
        F.coalesce(F.avg(_real(move)), zero).alias("real_avg_forward_return_pct"),
        F.max(move).alias("best_forward_return_pct"), F.min(move).alias("worst_forward_return_pct"),
        F.count_if(F.col("evaluation_status") == "matured").alias("matured_count"))
    return summary.join(exact_median(tagged, ["segment"], "forward_return_pct", "median_forward_return_pct"),
                        "segment", "left")


def run_summary(evaluations: DataFrame) -> DataFrame:
    """One row for a whole evaluation run, zero-safe."""
    n, real = F.count(F.lit(1)), F.count_if(F.col("is_real_market_data") == 1)
    right = F.col("direction_correct")
    zero = F.lit(0.0)
    return evaluations.agg(
        n.alias("evaluations_saved"), real.alias("real_market_evaluations"),
        (n - real).alias("synthetic_evaluations"),
        F.coalesce(F.sum(right), F.lit(0)).alias("directionally_correct"),
        F.coalesce(F.round(F.avg(right) * 100, 4), zero).alias("win_rate_pct"),
        F.coalesce(F.round(F.avg(_real(right)) * 100, 4), zero).alias("real_win_rate_pct"),
        F.coalesce(F.round(F.avg("forward_return_pct"), 6), zero).alias("average_forward_return_pct"),
        F.coalesce(F.round(F.avg(_real(F.col("forward_return_pct"))), 6), zero)
        .alias("real_average_forward_return_pct"))


def evaluation_by_ticker(evaluations: DataFrame) -> DataFrame:
    tidy = evaluations.select(
        F.upper("ticker").alias("ticker"), as_number(evaluations, "direction_correct").alias("right"),
        as_number(evaluations, "is_real_market_data").cast("int").alias("real"),
        as_number(evaluations, "forward_return_pct").alias("move"))
    real = F.col("real") == 1
    return tidy.groupBy("ticker").agg(
        F.count(F.lit(1)).cast("double").alias("evaluated"),
        F.count_if(real).cast("double").alias("real_evaluated"),
        (F.avg("right") * 100).alias("win_rate_pct"),
        F.coalesce(F.avg(F.when(real, F.col("right"))) * 100, F.lit(0.0)).alias("real_win_rate_pct"),
        F.avg("move").alias("avg_forward_return_pct"))
