"""One run over the stored tables: load, score, judge, size and log, visible to others all at once.

Every step reads tables and writes tables; what a step hands on is what it stored. All of it is one transaction, so a
reader never sees the insights of a run without its evaluations, and a failed run leaves only its log row and alert.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgauge.functions import fixed_values as fixed
from newsgauge.operators.asof import resolve_quotes
from newsgauge.operators.frames import filter_tickers
from newsgauge.operators.keyed import first_rows
from newsgauge.options import HealthOptions, InsightOptions, PortfolioOptions
from newsgauge.plans import evaluation, health, insights, portfolio
from newsgauge.plans.scoring import normalize_headlines, score_headlines, with_content_hash
from newsgauge.sources.tables import RUN_LOG_UPDATES, Tables, get_or_create_runs, run_log_rows

#: rows -> scored rows
Scorer = Callable[[DataFrame], DataFrame]
#: ((ticker, as_of), quotes of the providers, cached_quotes=stored ones) -> the quote of each, synthetic where there is none
Resolver = Callable[..., DataFrame]


@dataclass(frozen=True)
class RunCounts:
    """Counters of a run: each is counted by the write that it names."""

    headlines_fetched: int = 0
    headlines_after_dedupe: int = 0
    raw_saved: int = 0
    scored_saved: int = 0
    insights_generated: int = 0
    evaluations_saved: int = 0
    trades_executed: int = 0


def counters(tables: Tables, counts: RunCounts) -> DataFrame:
    """(stage, n), one row for each counter."""
    return tables.spark.createDataFrame(list(asdict(counts).items()), "stage string, n bigint")


def load_headlines(tables: Tables, raw: DataFrame, as_of: datetime, score: Scorer | None = None) -> RunCounts:
    """Normalizes, stores and scores raw headlines. Copies, and headlines stored before, are counted but not stored.

    Normalized and scored rows are steps of their own: an insert goes over its batch three times."""
    newest = [F.col("published_at_utc").desc_nulls_last()]
    normal = tables.stage(with_content_hash(normalize_headlines(raw)))
    kept = tables.insert_if_absent("raw_headlines", normal, newest)
    scored = tables.stage(with_content_hash(score(normal) if score else score_headlines(normal, as_of)))
    judged = tables.insert_if_absent("scored_headlines", scored, newest)
    tables.drop_steps()
    return RunCounts(kept.fetched, kept.after_dedupe, kept.saved, judged.saved)


def refresh_insights(tables: Tables, as_of: datetime, opts: InsightOptions = InsightOptions(), tickers=None,
                     external: DataFrame | None = None, sectors: DataFrame | None = None) -> DataFrame:
    """Insights of the look-back before ``as_of`` into their table, one for each ticker of the day; the stored ones."""
    recent = insights.recent_headlines(tables.read("scored_headlines"), as_of - timedelta(hours=opts.lookback_hours), tickers)
    fresh = insights.insights_for_window(recent, as_of.date(), opts, external, sectors)
    tables.upsert("insights", fresh.withColumn("generated_at_utc", F.lit(as_of)))
    return tables.read("insights").where((F.col("insight_date") == F.lit(as_of.date())) & (F.col("generated_at_utc") == F.lit(as_of)))


def _keep_quotes(tables: Tables, answers: DataFrame) -> None:
    """Stores the real quotes among the answers, of two sources with one day's quote the one of higher rank."""
    rank = F.array_position(F.array(*[F.lit(x) for x in fixed.PROVIDER_ORDER]), F.col("data_source"))
    real = answers.where(F.col("close_price_usd").isNotNull() & (F.col("data_source") != "synthetic")).select(
        F.upper("ticker").alias("ticker"), "quote_date", "close_price_usd", "data_source").distinct()
    tables.upsert("price_quotes", first_rows(real, ["ticker", "quote_date"], [F.nullif(rank, F.lit(0)).asc_nulls_last(), F.col("data_source")]))


def _answers(tables: Tables, asks: DataFrame, provider_quotes: DataFrame, resolve: Resolver) -> DataFrame:
    """The quote of each (ticker, as_of), looked up once, kept for the next look-up and handed on as a stored step."""
    found = tables.stage(resolve(asks, provider_quotes, cached_quotes=tables.read("price_quotes")))
    _keep_quotes(tables, found)
    return found


def refresh_evaluations(tables: Tables, provider_quotes: DataFrame, as_of: datetime, resolve: Resolver = resolve_quotes) -> DataFrame:
    """Evaluates all stored insights into their table; the rows of this run. Quotes that are used are stored."""
    judged = evaluation.evaluate_insights(tables.read("insights"), provider_quotes, as_of.date(),
                                          lambda asks, quotes: _answers(tables, asks, quotes, resolve))
    tables.upsert("insight_evaluations", judged.withColumn("evaluated_at_utc", F.lit(as_of)))
    return tables.read("insight_evaluations").where(F.col("evaluated_at_utc") == F.lit(as_of))


def trade(tables: Tables, accounts: DataFrame, provider_quotes: DataFrame, as_of: datetime,
          opts: PortfolioOptions = PortfolioOptions(), resolve: Resolver = resolve_quotes) -> tuple[int, DataFrame]:
    """One trading day of the accounts (run_name, starting_cash_cad) over the stored insights and positions: how many
    trades, and the snapshots. Accounts that are not there yet begin with full cash."""
    day, now = as_of.date(), F.lit(as_of)
    tables.insert_if_absent("portfolio_runs", get_or_create_runs(tables.read("portfolio_runs").limit(0), accounts, now))
    mine = accounts.select("run_name").distinct()
    runs = tables.read("portfolio_runs").join(mine, "run_name", "left_semi")
    held = tables.read("portfolio_positions").join(mine, "run_name", "left_semi")
    latest = tables.stage(insights.latest_insight_per_ticker(tables.read("insights").where(F.col("insight_date") <= F.lit(day))))
    asks = latest.select("ticker").union(held.select("ticker")).distinct().withColumn("as_of", F.lit(day))
    quotes = _answers(tables, asks, provider_quotes, resolve).drop("as_of")
    result = portfolio.rebalance(runs.select("run_name", "starting_cash_cad", "cash_cad"), held, latest, quotes, day, opts, tables.stage)
    trades = result["trades"].withColumns({"traded_at_utc": now, "fee_cad": F.lit(0.0)})
    executed = tables.append("portfolio_trades", trades)
    sold = held.join(result["positions"].select("run_name", "ticker"), ["run_name", "ticker"], "left_anti").withColumn("quantity", F.lit(0.0))
    tables.upsert_positions(result["positions"].unionByName(sold.select(portfolio.POSITION_COLUMNS)))
    tables.upsert("portfolio_runs", result["runs"].select("run_name", "cash_cad", now.alias("updated_at_utc")), ["cash_cad", "updated_at_utc"])
    tables.upsert("portfolio_snapshots", result["snapshots"])
    snapshots = tables.read("portfolio_snapshots").where(F.col("snapshot_date") == F.lit(day)).join(mine, "run_name", "left_semi")
    return executed, snapshots


def _log(tables: Tables, run_id: str, as_of: datetime, status: str, summary: dict, error: str | None = None) -> DataFrame:
    row = [(run_id, "local_pipeline", as_of, as_of, status, error, json.dumps(summary))]
    logged = tables.spark.createDataFrame(row, "run_id string, run_type string, started_at_utc timestamp, finished_at_utc timestamp, "
                                               "status string, error_message string, summary_json string")
    tables.upsert("run_logs", run_log_rows(logged), RUN_LOG_UPDATES)
    return logged


def _raise_alerts(tables: Tables, raised: DataFrame, as_of: datetime) -> None:
    tables.resolve_alerts(fixed.MONITORED_ALERTS)
    tables.upsert("health_alerts", raised.select(*health.ALERT_COLUMNS, F.lit(as_of).alias("detected_at_utc"), F.lit("open").alias("status")))


def run_over_tables(tables: Tables, run_id: str, raw: DataFrame, provider_quotes: DataFrame, as_of: datetime,
                    accounts: DataFrame | None = None, tickers=None, external: DataFrame | None = None, sectors: DataFrame | None = None,
                    score: Scorer | None = None, resolve: Resolver = resolve_quotes, opts: InsightOptions = InsightOptions(),
                    trading: PortfolioOptions = PortfolioOptions(), rules: HealthOptions = HealthOptions()) -> RunCounts:
    """Load, insights, trades, evaluations, run log and alerts, committed together.

    A run that fails changes no table; its log row and a critical alert are stored, and the error is raised.
    """
    try:
        with tables.transaction():
            loaded = load_headlines(tables, filter_tickers(raw, tickers), as_of, score)
            made = refresh_insights(tables, as_of, opts, tickers, external, sectors).count()
            executed, simulation = 0, None
            if accounts is not None:
                executed, snapshots = trade(tables, accounts, provider_quotes, as_of, trading, resolve)
                equity = snapshots.agg(F.sum("total_equity_cad").alias("total_equity_cad"), F.sum("cash_cad").alias("cash_cad")).first()
                simulation = {"trades_executed": executed, **equity.asDict()}
            judged = evaluation.run_summary(refresh_evaluations(tables, provider_quotes, as_of, resolve)).first().asDict()
            counts = replace(loaded, insights_generated=made, evaluations_saved=judged["evaluations_saved"], trades_executed=executed)
            summary = {"run_id": run_id, "tickers": len(tickers) if tickers else None, "raw_headlines_collected": counts.headlines_fetched,
                       "raw_headlines_saved_attempted": counts.headlines_after_dedupe, "scored_headlines_saved_attempted": counts.scored_saved,
                       "insights_generated": made, "simulation": simulation, "evaluation": judged}
            _raise_alerts(tables, health.success_alerts(_log(tables, run_id, as_of, "success", summary), rules), as_of)
            return counts
    except Exception as error:
        with tables.transaction():
            failed = _log(tables, run_id, as_of, "failed", {"run_id": run_id}, f"{type(error).__name__}: {error}"[:2000])
            tables.upsert("health_alerts", health.failure_alerts(failed).select(
                *health.ALERT_COLUMNS, F.lit(as_of).alias("detected_at_utc"), F.lit("open").alias("status")))
        raise
