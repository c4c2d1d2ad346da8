"""Paper portfolio sizing: mark, sell, target, buy, apply and snapshot, for all runs at once."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgauge.functions.numbers import ratio
from newsgauge.operators.asof import resolve_quotes
from newsgauge.operators.keyed import first_rows
from newsgauge.options import PortfolioOptions
from newsgauge.plans.insights import latest_insight_per_ticker
from newsgauge.session import staged

POSITION_COLUMNS = ["run_name", "ticker", "quantity", "avg_cost_cad", "last_price_cad",
                    "market_value_cad", "unrealized_pnl_cad"]
TRADE_COLUMNS = ["run_name", "insight_id", "ticker", "side", "quantity", "price_cad", "gross_cad", "reason"]
EMPTY = 1e-9


def tradeable(source: Column) -> Column:
    return source.isNotNull() & (source != "synthetic")


def valued(positions: DataFrame) -> DataFrame:
    """Recomputes market value and profit; positions with no quantity left disappear."""
    worth = F.col("quantity") * F.col("last_price_cad")
    return positions.where(F.col("quantity") > EMPTY).withColumns({
        "market_value_cad": worth,
        "unrealized_pnl_cad": worth - F.col("quantity") * F.col("avg_cost_cad")})


def mark_to_market(positions: DataFrame, quotes: DataFrame, rate: float = 1.37) -> DataFrame:
    """Positions with a real quote take its price; the others keep the old one."""
    prices = quotes.where(tradeable(F.col("data_source"))).select(
        "ticker", (F.col("close_price_usd") * rate).alias("_price"))
    marked = positions.join(prices, "ticker", "left")
    has = F.col("_price").isNotNull()
    worth = F.col("quantity") * F.col("_price")
    marked = marked.withColumns({
        "last_price_cad": F.coalesce("_price", "last_price_cad"),
        "market_value_cad": F.when(has, worth).otherwise(F.col("market_value_cad")),
        "unrealized_pnl_cad": F.when(has, worth - F.col("quantity") * F.col("avg_cost_cad"))
        .otherwise(F.col("unrealized_pnl_cad"))})
    return marked.select(*POSITION_COLUMNS).where(F.col("quantity") > EMPTY)


def sale_prices(latest: DataFrame, quotes: DataFrame, rate: float = 1.37) -> DataFrame:
    """(ticker, price_cad) of tickers whose latest insight is negative and that have a real quote."""
    negative = latest.where(F.col("signal_label") == "negative").select("ticker")
    prices = quotes.where(tradeable(F.col("data_source"))).select(
        "ticker", (F.col("close_price_usd") * rate).alias("price_cad"))
    return prices.join(negative, "ticker", "left_semi")


def sell_orders(marked: DataFrame, latest: DataFrame, quotes: DataFrame, rate: float = 1.37) -> DataFrame:
    """Full sale of holdings whose latest insight is negative and that have a real quote."""
    return _sales(marked.join(sale_prices(latest, quotes, rate), "ticker"))


def _sales(sold: DataFrame) -> DataFrame:
    return sold.select(
        "run_name", F.lit(None).cast("bigint").alias("insight_id"), "ticker", F.lit("sell").alias("side"),
        "quantity", "price_cad", (F.col("quantity") * F.col("price_cad")).alias("gross_cad"),
        F.lit("Liquidated after negative insight signal.").alias("reason"))


def buy_candidates(latest: DataFrame, opts: PortfolioOptions = PortfolioOptions()) -> DataFrame:
    keep = (F.col("signal_label") == "positive") & (F.col("signal_score") >= opts.positive_threshold)
    if "recommendation" in latest.columns:
        keep = keep & F.coalesce("recommendation", F.lit("buy")).isin("strong_buy", "buy", "watch")
    if "risk_score" in latest.columns:
        keep = keep & (F.coalesce("risk_score", F.lit(0.0)) <= opts.max_risk)
    return latest.where(keep)


def raw_weight(columns: Iterable[str]) -> Column:
    columns = set(columns)
    positive_signal = F.greatest(F.col("signal_score"), F.lit(0.0))
    opportunity = (F.coalesce(F.col("opportunity_score"), positive_signal)
                   if "opportunity_score" in columns else positive_signal)
    said = (F.coalesce(F.nullif(F.col("recommendation"), F.lit("")), F.lit("buy"))
            if "recommendation" in columns else F.lit("buy"))
    factor = (F.when(said == "strong_buy", F.lit(1.35)).when(said == "buy", F.lit(1.0))
              .when(said == "watch", F.lit(0.45)).otherwise(F.lit(0.25)))
    return F.greatest(opportunity * F.coalesce("confidence", F.lit(0.5)) * factor, F.lit(0.01))


def target_allocation(latest: DataFrame, opts: PortfolioOptions = PortfolioOptions(),
                      group: Iterable[str] = ()) -> DataFrame:
    """Best ``max_positions`` candidates with their share of the investable equity.

    ``group`` names columns that separate independent insight sets; without it there is one set.
    """
    group = list(group)
    by = group or [F.lit(0)]
    has = "opportunity_score" in latest.columns
    order = [F.col("opportunity_score" if has else "signal_score").desc_nulls_last(),
             F.col("signal_score").desc(), F.col("confidence").desc_nulls_last(), F.col("ticker")]
    picked = first_rows(buy_candidates(latest, opts), by, order, opts.max_positions, "rank")
    picked = picked.withColumn("_raw", raw_weight(latest.columns))
    # At most max_positions rows per set are left here.
    share = F.col("_raw") / F.sum("_raw").over(Window.partitionBy(*by))
    text = F.col("rationale") if "rationale" in latest.columns else F.lit(None).cast("string")
    ident = F.col("insight_id") if "insight_id" in latest.columns else F.lit(None).cast("bigint")
    return picked.select(
        *group, "ticker", "rank", share.alias("weight"), ident.alias("insight_id"),
        F.coalesce(F.nullif(text, F.lit("")), F.lit("Positive insight signal.")).alias("reason"))


def capped_amounts(wants: DataFrame, keys: Iterable[str], order: str, want: str, cash: str,
                   minimum: float) -> DataFrame:
    """Adds ``amount``: wants served in rank order until the cash is gone, small ones skipped."""
    ahead = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    served = wants.where(F.col(want) >= minimum)
    left = F.col(cash) - F.coalesce(F.sum(want).over(ahead), F.lit(0.0))
    amount = F.least(F.col(want), left)
    return served.withColumn("amount", F.when(amount >= minimum, amount).otherwise(F.lit(0.0)))


def buy_orders(funds: DataFrame, targets: DataFrame, held: DataFrame, quotes: DataFrame,
               opts: PortfolioOptions = PortfolioOptions()) -> DataFrame:
    """Orders per run. ``funds`` is (run_name, cash_cad, investable_cad).

    One target list serves all runs: it holds at most ``max_positions`` rows, so it travels to
    the runs as one array value instead of a join, and so does what a run holds of these tickers.
    The runs are dealt out before they are multiplied by the targets.
    """
    priced = targets.join(
        quotes.where(tradeable(F.col("data_source"))).select(
            "ticker", (F.col("close_price_usd") * opts.usd_to_cad_rate).alias("price_cad")), "ticker")
    owned = held.select("run_name", "ticker", F.col("market_value_cad").alias("_held"))
    if "run_name" in targets.columns:
        rows = funds.join(priced, "run_name").join(owned, ["run_name", "ticker"], "left")
    else:
        listed = priced.agg(F.collect_list(F.struct(
            "ticker", "rank", "weight", "price_cad", "insight_id", "reason")).alias("_all"))
        few = owned.join(F.broadcast(priced.select("ticker").distinct()), "ticker", "left_semi")
        own = few.groupBy("run_name").agg(F.collect_list(F.struct("ticker", "_held")).alias("_own"))
        parts = int(funds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        each = (funds.repartition(parts, "run_name").join(own, "run_name", "left")
                .withColumn("_t", F.explode(listed.scalar()))
                .withColumn("_o", F.explode_outer(F.filter("_own", lambda o: o["ticker"] == F.col("_t.ticker")))))
        rows = each.select(*funds.columns, "_t.*", F.col("_o._held").alias("_held"))
    wants = rows.withColumn(
        "_want", F.greatest(F.col("investable_cad") * F.col("weight") - F.coalesce("_held", F.lit(0.0)), F.lit(0.0)))
    sized = capped_amounts(wants, ["run_name"], "rank", "_want", "cash_cad", opts.min_order_cad)
    return sized.where(F.col("amount") > 0).select(
        "run_name", "insight_id", "ticker", F.lit("buy").alias("side"),
        (F.col("amount") / F.col("price_cad")).alias("quantity"), "price_cad",
        F.col("amount").alias("gross_cad"), "reason")


def apply_orders(positions: DataFrame, orders: DataFrame) -> DataFrame:
    """New holdings after one set of orders: sold tickers leave, bought ones average in."""
    net = orders.groupBy("run_name", "ticker").agg(
        F.sum(F.when(F.col("side") == "buy", F.col("quantity"))).alias("_bought"),
        F.sum(F.when(F.col("side") == "buy", F.col("gross_cad"))).alias("_paid"),
        F.sum(F.when(F.col("side") == "sell", F.col("quantity"))).alias("_sold"),
        F.max("price_cad").alias("_price"))
    zero = F.lit(0.0)
    joined = positions.select(*POSITION_COLUMNS).join(net, ["run_name", "ticker"], "full")
    kept = F.greatest(F.coalesce("quantity", zero) - F.coalesce("_sold", zero), zero)
    cost = F.when(kept > EMPTY, F.coalesce("avg_cost_cad", zero)).otherwise(zero)
    total = kept + F.coalesce("_bought", zero)
    changed = joined.select(
        "run_name", "ticker", total.alias("quantity"),
        F.coalesce(ratio(kept * cost + F.coalesce("_paid", zero), total), zero).alias("avg_cost_cad"),
        F.coalesce("_price", "last_price_cad").alias("last_price_cad"))
    return valued(changed).select(*POSITION_COLUMNS)


def portfolio_snapshot(runs: DataFrame, positions: DataFrame, day: date | Column) -> DataFrame:
    """(run_name, starting_cash_cad, cash_cad, data_source) + holdings -> equity and return."""
    value = positions.groupBy("run_name").agg(F.sum("market_value_cad").alias("_value"))
    joined = runs.join(value, "run_name", "left").withColumn(
        "positions_value_cad", F.coalesce("_value", F.lit(0.0)))
    equity = F.col("cash_cad") + F.col("positions_value_cad")
    start = F.col("starting_cash_cad")
    return joined.select(
        "run_name", (day if isinstance(day, Column) else F.lit(day)).alias("snapshot_date"), "cash_cad",
        "positions_value_cad", equity.alias("total_equity_cad"),
        F.coalesce(ratio(equity - start, start) * 100, F.lit(0.0)).alias("cumulative_return_pct"),
        "data_source")


def combined_sources(rows: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """Sorted distinct sources joined by ','; 'none' when there are none."""
    text = F.array_join(F.sort_array(F.collect_set("data_source")), ",")
    return rows.groupBy(*keys).agg(F.coalesce(F.nullif(text, F.lit("")), F.lit("none")).alias("data_source"))


def run_sources(runs: DataFrame, positions: DataFrame, latest: DataFrame, quotes: DataFrame) -> DataFrame:
    """Sources behind the quotes of the union of insight tickers and each run's holdings."""
    # Few distinct provider names exist, so the shared set is one small array value.
    shared = (latest.select("ticker").distinct().join(quotes, "ticker")
              .agg(F.collect_set("data_source").alias("_set")))
    own = (positions.select("run_name", "ticker").join(quotes, "ticker").select("run_name", "data_source").distinct()
           .groupBy("run_name").agg(F.collect_set("data_source").alias("_own")))
    both = runs.join(own, "run_name", "left").withColumn("_all", F.sort_array(F.array_union(
        F.coalesce("_own", F.array().cast("array<string>")), shared.scalar())))
    text = F.nullif(F.array_join("_all", ","), F.lit(""))
    return both.withColumn("data_source", F.coalesce(text, F.lit("none"))).drop("_own", "_all")


def rebalance(runs: DataFrame, positions: DataFrame, insights: DataFrame, quotes: DataFrame,
              day: date, opts: PortfolioOptions = PortfolioOptions(),
              stage: Callable[[DataFrame], DataFrame] = staged) -> dict[str, DataFrame]:
    """One trading day for every run -> trades, positions, runs (new cash) and snapshots.

    ``quotes`` has one row per ticker, synthetic ones included. Marked holdings, funds and buy orders are needed several
    times, so they are stored by ``stage`` at once; the inputs should be stored as well. Which tickers are sold is known
    per ticker, so holdings are sent to their quotes once and never to their own sale.
    """
    rate = opts.usd_to_cad_rate
    latest = latest_insight_per_ticker(insights)
    sale = sale_prices(latest, quotes, rate).withColumn("_sold", F.lit(True))
    marked = stage(mark_to_market(positions, quotes, rate).join(sale, "ticker", "left"))
    sells = _sales(marked.where("_sold"))
    # a sale names its run, so holdings without one stay
    stays = F.col("_sold").isNull() | F.col("run_name").isNull()
    kept = marked.where(stays).select(*POSITION_COLUMNS)

    sums = marked.groupBy("run_name").agg(
        F.sum(F.when(F.col("_sold"), F.col("quantity") * F.col("price_cad"))).alias("_sold"),
        F.sum(F.when(stays, F.col("market_value_cad"))).alias("_value"))
    zero = F.lit(0.0)
    funds = (runs.select("run_name", "cash_cad").join(sums, "run_name", "left")
             .withColumn("cash_cad", F.col("cash_cad") + F.coalesce("_sold", zero)))
    share = max(0.0, min(1.0, 1 - opts.cash_reserve_pct))
    funds = stage(funds.select("run_name", "cash_cad", (
        (F.col("cash_cad") + F.coalesce("_value", zero)) * share).alias("investable_cad")))
    buys = stage(buy_orders(funds, target_allocation(latest, opts), kept, quotes, opts))

    spent = buys.groupBy("run_name").agg(F.sum("gross_cad").alias("_spent"))
    new_runs = (runs.drop("cash_cad").join(funds.select("run_name", "cash_cad"), "run_name")
                .join(spent, "run_name", "left")
                .withColumn("cash_cad", F.col("cash_cad") - F.coalesce("_spent", zero)).drop("_spent"))
    new_positions = apply_orders(kept, buys)
    snapshots = portfolio_snapshot(run_sources(new_runs, positions, latest, quotes), new_positions, day)
    return {"trades": sells.unionByName(buys).select(*TRADE_COLUMNS), "positions": new_positions,
            "runs": new_runs, "snapshots": snapshots, "quotes": quotes}
