"""Read-side frames: hot tickers, watchlist, portfolio per ticker, headline numbers, weekly metrics."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgauge.functions import fixed_values as fixed
from newsgauge.functions.numbers import as_number, label_by_threshold, ratio
from newsgauge.operators.asof import best_quote_per_ticker
from newsgauge.operators.frames import at_latest, between_dates, between_days_of, keep_existing, union_all
from newsgauge.operators.keyed import first_rows, latest_rows
from newsgauge.plans.evaluation import evaluation_by_ticker, performance_summary
from newsgauge.session import staged

DEFAULT_TICKERS_SHOWN = 12


def lookup(mapping: Mapping[str, str], key: Column) -> Column:
    """Value of a fixed table, NULL when the key is not in it."""
    table = F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair])
    return F.try_element_at(table, key)


def latest_headline_lookup(latest: DataFrame) -> DataFrame:
    rows = latest.select(F.upper("ticker").alias("ticker"), F.col("headline").alias("latest_headline"),
                         F.col("source").alias("latest_source"),
                         F.col("published_at_utc").cast("timestamp").alias("latest_headline_at_utc"))
    return latest_rows(rows, ["ticker"], "latest_headline_at_utc", [F.col("latest_headline")])


HOT_COLUMNS = ["ticker", "news_heat_score", "signal_label", "headline_count", "political_headline_count",
               "hot_signal_score", "recommendation", "confidence_grade", "latest_source",
               "latest_headline", "why_hot"]


def hot_tickers(signals: DataFrame | None, latest: DataFrame | None, limit: int = 8) -> DataFrame:
    """Top tickers of the latest signal day by heat. Without signals, by the latest headlines."""
    if signals is None:
        own = as_number(latest, "compound_score")
        rows = latest.withColumns({"headline_count": F.lit(1), "avg_compound_score": own, "signal_score": own,
                                   "signal_label": label_by_threshold(own)})
    else:
        rows = at_latest(signals, "sentiment_date") if "sentiment_date" in signals.columns else signals
    if latest is not None:
        rows = rows.drop("latest_headline", "latest_source").join(latest_headline_lookup(latest), "ticker", "left")
    score = next(c for c in ("signal_score", "avg_compound_score", "compound_score") if c in rows.columns)
    rows = rows.withColumn("hot_signal_score", as_number(rows, score))
    rows = rows.withColumns({c: as_number(rows, c) for c in (
        "headline_count", "political_headline_count", "compound_score_zscore", "opportunity_score")})
    if "signal_label" not in rows.columns:
        rows = rows.withColumn("signal_label", label_by_threshold(F.col("hot_signal_score")))
    heat = (F.col("headline_count") * (0.55 + F.abs("hot_signal_score"))
            + F.col("political_headline_count") * 0.75 + F.abs("compound_score_zscore") * 2
            + F.col("opportunity_score") * 3)
    reason = F.coalesce("rationale", F.lit("")) if "rationale" in rows.columns else F.lit("")
    if "latest_headline" in rows.columns:
        reason = F.when(F.trim(reason) == "", F.coalesce("latest_headline", F.lit(""))).otherwise(reason)
    rows = rows.withColumns({"news_heat_score": F.round(heat, 2), "why_hot": reason})
    return keep_existing(rows.orderBy(F.col("news_heat_score").desc(), F.col("ticker")).limit(limit), HOT_COLUMNS)


def default_tickers(daily: DataFrame, known: DataFrame, limit: int = DEFAULT_TICKERS_SHOWN) -> DataFrame:
    """Latest day's tickers by headline count, then the given list (ticker, position): first ``limit``."""
    busy = at_latest(daily, "sentiment_date").where(F.col("ticker").isNotNull()).select(
        F.upper("ticker").alias("ticker"), F.lit(0).alias("_tier"), (-F.col("headline_count")).alias("_at"))
    rest = known.select("ticker", F.lit(1).alias("_tier"), F.col("position").cast("bigint").alias("_at"))
    each = first_rows(busy.unionByName(rest), ["ticker"], [F.col("_tier"), F.col("_at")])
    return each.orderBy("_tier", "_at", "ticker").limit(limit).select("ticker")


def slice_from(tickers: DataFrame, start: str, count: int, position: str = "position") -> DataFrame:
    """``count`` tickers beginning with ``start`` in list order."""
    at = tickers.where(F.col("ticker") == start).agg(F.min(position)).scalar()
    return tickers.where(F.col(position) >= at).orderBy(position).limit(count)


def ordered_tickers(*lists: DataFrame) -> DataFrame:
    """Distinct union of ticker lists: earlier lists first, own ``position`` inside a list."""
    tagged = [frame.select(F.upper("ticker").alias("ticker"), F.lit(i).alias("_list"),
                           (F.col("position").cast("bigint") if "position" in frame.columns
                            else F.lit(0).cast("bigint")).alias("_at"))
              for i, frame in enumerate(lists)]
    each = first_rows(union_all(*tagged).where(F.col("ticker").isNotNull()), ["ticker"],
                      [F.col("_list"), F.col("_at")])
    return each.orderBy("_list", "_at", "ticker").select("ticker")


def watchlist_prices(tickers: DataFrame, cached: DataFrame, live: DataFrame,
                     names: Mapping[str, str] | DataFrame = fixed.COMPANY_NAMES,
                     sectors: Mapping[str, str] | DataFrame = fixed.SECTORS) -> DataFrame:
    """Each listed ticker with company, sector and its best quote."""
    base = tickers.select(F.upper(F.trim("ticker")).alias("ticker")).where(F.col("ticker") != "").distinct()
    rows = base
    for dim, column in ((names, "company"), (sectors, "sector")):
        if isinstance(dim, DataFrame):
            rows = rows.join(dim.select("ticker", column), "ticker", "left")
        else:
            rows = rows.withColumn(column, lookup(dim, F.col("ticker")))
    rows = rows.withColumn("company", F.coalesce("company", "ticker"))
    quotes = best_quote_per_ticker(live, cached)
    return rows.join(quotes, "ticker", "left").select(
        "ticker", "company", "sector", "close_price_usd", "quote_date", "data_source")


def sentiment_breakdown(daily: DataFrame) -> DataFrame:
    """Latest day per ticker: label counts as shares of their sum (or of the headline count)."""
    counts = [as_number(daily, f"{k}_headline_count").alias(f"{k}_count") for k in ("positive", "neutral", "negative")]
    rows = daily.select(F.upper("ticker").alias("ticker"), "sentiment_date", *counts,
                        as_number(daily, "headline_count").alias("_n"),
                        as_number(daily, "avg_compound_score").alias("avg_compound_score"))
    rows = latest_rows(rows, ["ticker"], "sentiment_date")
    labelled = F.col("positive_count") + F.col("neutral_count") + F.col("negative_count")
    rows = rows.withColumn("headline_count", F.when(labelled > 0, labelled).otherwise(F.col("_n")))
    shares = [F.coalesce(ratio(F.col(f"{k}_count"), F.col("headline_count")) * 100, F.lit(0.0)).alias(f"{k}_pct")
              for k in ("positive", "neutral", "negative")]
    return rows.select("ticker", "positive_count", "neutral_count", "negative_count", "headline_count",
                       *shares, "avg_compound_score")


def trade_summary(positions: DataFrame, trades: DataFrame, prices: DataFrame | None = None,
                  rate: float = 1.37) -> DataFrame:
    """Bought and sold quantities, average buy price, open value and return per ticker."""
    side = F.lower(F.coalesce("side", F.lit("")))
    qty, gross = as_number(trades, "quantity"), as_number(trades, "gross_cad")
    price = as_number(trades, "price_cad")
    traded_at = F.col("traded_at_utc") if "traded_at_utc" in trades.columns else F.lit(None).cast("timestamp")
    by_trade = trades.groupBy(F.upper("ticker").alias("ticker")).agg(
        F.sum(F.when(side == "buy", qty)).alias("_bought"), F.sum(F.when(side == "sell", qty)).alias("_sold"),
        F.sum(F.when(side == "buy", gross)).alias("_gross"),
        F.sum(F.when(side == "buy", price * qty)).alias("_cost"), F.max(traded_at).alias("latest_trade_at"))
    held = as_number(positions, "quantity")
    by_position = positions.groupBy(F.upper("ticker").alias("ticker")).agg(
        F.sum(held).alias("_qty"), F.sum(as_number(positions, "market_value_cad")).alias("_value"),
        F.sum(as_number(positions, "unrealized_pnl_cad")).alias("_pnl"),
        F.sum(as_number(positions, "last_price_cad") * held).alias("_last"))
    rows = by_trade.join(by_position, "ticker", "full")
    zero = F.lit(0.0)
    rows = rows.withColumns({c: F.coalesce(c, zero) for c in (
        "_bought", "_sold", "_gross", "_cost", "_qty", "_value", "_pnl", "_last")})
    if prices is not None:
        quoted = prices.select(F.upper("ticker").alias("ticker"), F.col("close_price_usd").alias("_quote"))
        rows = rows.join(quoted, "ticker", "left")
    else:
        rows = rows.withColumn("_quote", F.lit(None).cast("double"))
    paid = F.when(F.col("_gross") != 0, F.col("_gross")).otherwise(F.col("_cost"))
    rows = rows.withColumn("avg_buy_price_cad", F.coalesce(ratio(paid, F.col("_bought")), zero))
    last = F.coalesce(ratio(F.col("_last"), F.col("_qty")), F.col("_quote") * rate, zero)
    open_cost = F.col("_qty") * F.col("avg_buy_price_cad")
    return rows.select(
        "ticker", F.col("_bought").alias("bought_quantity"), F.col("_sold").alias("sold_quantity"),
        "avg_buy_price_cad", F.col("_qty").alias("current_quantity"), last.alias("last_price_cad"),
        F.col("_value").alias("market_value_cad"), F.col("_pnl").alias("unrealized_pnl_cad"),
        F.coalesce(ratio(F.col("_pnl"), open_cost) * 100, zero).alias("open_return_pct"), "latest_trade_at")


def portfolio_tickers(tickers: DataFrame, positions: DataFrame, trades: DataFrame, daily: DataFrame,
                      evaluations: DataFrame, prices: DataFrame,
                      names: Mapping[str, str] = fixed.COMPANY_NAMES, rate: float = 1.37) -> DataFrame:
    """One row per ticker of any input: sentiment, holding and evaluation beside each other.

    Four per-ticker aggregates joined on the ticker; nothing loops over tickers. Each aggregate has all tickers of its
    input, so it is stored and the inputs are read once.
    """
    mood = staged(sentiment_breakdown(daily), "mood")
    holding = staged(trade_summary(positions, trades, None, rate), "holding")
    judged = staged(evaluation_by_ticker(evaluations), "judged")
    every = union_all(*[f.select(F.upper("ticker").alias("ticker")) for f in (tickers, mood, holding, judged)])
    every = every.where(F.col("ticker").isNotNull()).distinct()
    quoted = prices.select(F.upper("ticker").alias("ticker"), F.col("close_price_usd").alias("_watch"))
    rows = (every.join(mood, "ticker", "left").join(holding, "ticker", "left")
            .join(judged, "ticker", "left").join(quoted, "ticker", "left"))
    zero = F.lit(0.0)

    def number(name: str, alias: str | None = None) -> Column:
        return F.coalesce(name, zero).alias(alias or name)

    last = F.when(F.coalesce("current_quantity", zero) != 0, F.col("last_price_cad")).otherwise(
        F.coalesce(F.col("_watch") * rate, zero))
    win = F.coalesce(F.nullif("real_win_rate_pct", zero), F.col("win_rate_pct"), zero)
    return rows.select(
        "ticker", F.coalesce(lookup(names, F.col("ticker")), F.col("ticker")).alias("company"),
        F.coalesce(F.col("headline_count"), zero).cast("bigint").alias("headlines"),
        number("positive_pct"), number("neutral_pct"), number("negative_pct"),
        number("current_quantity", "quantity_owned"), number("avg_buy_price_cad"),
        last.alias("last_price_cad"), number("market_value_cad"), number("unrealized_pnl_cad"),
        number("open_return_pct"), win.alias("model_win_rate_pct"),
        number("avg_forward_return_pct", "avg_market_move_pct"),
    ).orderBy(F.col("market_value_cad").desc(), F.col("headlines").desc(), "ticker")


def headline_numbers(daily: DataFrame, signals: DataFrame) -> DataFrame:
    """One row: headlines of the latest day, buys and sells of the latest signal day."""
    volume = at_latest(daily, "sentiment_date").agg(
        F.coalesce(F.sum("headline_count"), F.lit(0)).alias("latest_headline_count"))
    advice = F.coalesce("recommendation", F.lit(""))
    calls = at_latest(signals, "sentiment_date").agg(
        F.count_if(advice.isin("buy", "strong_buy")).alias("buy_count"),
        F.count_if(advice.isin("sell", "trim")).alias("sell_count"))
    both = volume.unionByName(calls, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def portfolio_summary(runs: DataFrame, snapshots: DataFrame, starting_cash: float = 5000.0,
                      order: str = "updated_at_utc") -> DataFrame:
    """One row from the latest run and the latest snapshot, with defaults when there is none."""
    cash = runs.agg(F.max_by("starting_cash_cad", order).alias("starting_cash_cad"))
    latest = snapshots.agg(F.max_by(F.struct(*[c for c in (
        "snapshot_date", "cash_cad", "positions_value_cad", "total_equity_cad", "cumulative_return_pct",
        "data_source")]), "snapshot_date").alias("_s"))
    row = cash.unionByName(latest, allowMissingColumns=True).agg(
        F.coalesce(F.max("starting_cash_cad"), F.lit(starting_cash)).alias("starting_cash_cad"),
        F.max("_s").alias("_s"))
    start, s = F.col("starting_cash_cad"), F.col("_s")
    equity = F.coalesce(s["total_equity_cad"], start)
    zero = F.lit(0.0)
    return row.select(
        start, F.when(s.isNull(), start).otherwise(F.coalesce(s["cash_cad"], zero)).alias("cash_cad"),
        F.coalesce(s["positions_value_cad"], zero).alias("positions_value_cad"), equity.alias("total_equity_cad"),
        (equity - start).alias("profit_cad"), F.coalesce(s["cumulative_return_pct"], zero).alias("return_pct"),
        s["snapshot_date"].alias("snapshot_date"),
        F.when(s.isNull(), F.lit("none")).otherwise(F.coalesce(s["data_source"], F.lit("n/a"))).alias("data_source"))


PERIOD_COLUMNS = {"insights": ("insight_date", False), "evaluations": ("evaluation_date", False),
                  "snapshots": ("snapshot_date", False), "trades": ("traded_at_utc", True),
                  "runs": ("started_at_utc", True), "alerts": ("detected_at_utc", True)}


def report_frames(frames: Mapping[str, DataFrame], start: date, end: date) -> dict[str, DataFrame]:
    """Each frame cut to the inclusive period by its own date or timestamp column."""
    return {name: (between_days_of if is_stamp else between_dates)(frames[name], column, start, end)
            for name, (column, is_stamp) in PERIOD_COLUMNS.items() if name in frames}


def weekly_metrics(frames: Mapping[str, DataFrame], start: date, end: date) -> DataFrame:
    """The report's measures as one row, each from one aggregate over its period."""
    cut = report_frames(frames, start, end)
    counts = {"insights": "insights_generated", "trades": "trades_executed", "runs": "pipeline_runs",
              "alerts": "health_alerts"}
    parts = [cut[name].agg(F.count(F.lit(1)).alias(metric)) for name, metric in counts.items()]
    real = F.col("is_real_market_data") == 1
    parts.append(cut["evaluations"].agg(
        F.count(F.lit(1)).alias("evaluations_saved"), F.count_if(real).alias("real_market_evaluations"),
        F.count_if(F.col("is_real_market_data") == 0).alias("synthetic_evaluations"),
        F.coalesce(F.avg(F.when(real, F.col("direction_correct"))) * 100, F.lit(0.0)).alias("real_win_rate_pct"),
        F.coalesce(F.avg(F.when(real, F.col("forward_return_pct"))), F.lit(0.0))
        .alias("real_avg_forward_return_pct")))
    parts.append(cut["snapshots"].agg(
        F.coalesce(F.max_by("total_equity_cad", "snapshot_date"), F.lit(0.0)).alias("portfolio_total_equity_cad"),
        F.coalesce(F.max_by("cumulative_return_pct", "snapshot_date"), F.lit(0.0)).alias("portfolio_return_pct")))
    both = union_all(*parts)
    return both.agg(*[F.max(c).alias(c) for c in both.columns]).select(
        F.lit(start).alias("period_start"), F.lit(end).alias("period_end"), "*")


def segment_table(evaluations: DataFrame, limit: int = 20) -> DataFrame:
    """First rows of the performance summary in report order."""
    group = F.when(F.col("segment") == "overall", 0).when(F.col("segment").startswith("signal:"), 1).otherwise(2)
    return performance_summary(evaluations).orderBy(group, "segment").limit(limit)


def newest_runs(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.col("started_at_utc").desc(), "run_id")
