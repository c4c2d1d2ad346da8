"""Row types, natural keys and table names of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "bigint": T.LongType(),
          "date": T.DateType(), "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType())}


def _schema(text: str) -> T.StructType:
    """'name type, ...' to a StructType; works before there is a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in text.split(", "))])


RAW_HEADLINE = _schema(
    "ticker string, headline string, source string, url string, published_at_utc timestamp, "
    "summary string, category string, topic string, industry string")

SCORED_HEADLINE = _schema(
    "ticker string, headline string, source string, url string, published_at_utc timestamp, "
    "sentiment_label string, positive_score double, neutral_score double, negative_score double, "
    "compound_score double, confidence double, headline_age_hours double, source_tier int, "
    "summary string, category string, topic string, industry string, content_hash string")

INSIGHT = _schema(
    "insight_id bigint, ticker string, insight_date date, generated_at_utc timestamp, "
    "signal_label string, signal_score double, confidence double, headline_count bigint, "
    "political_headline_count bigint, financial_headline_count bigint, sector string, "
    "source_count bigint, source_diversity_score double, sentiment_momentum double, "
    "consensus_score double, risk_score double, opportunity_score double, recommendation string, "
    "confidence_grade string, category_mix string, rationale string, horizon_days int, "
    "source_headline_hashes array<string>")

EVALUATION = _schema(
    "insight_id bigint, ticker string, insight_date date, evaluation_date date, "
    "evaluated_at_utc timestamp, signal_label string, recommendation string, signal_score double, "
    "horizon_days int, entry_quote_date date, current_quote_date date, entry_price_usd double, "
    "current_price_usd double, forward_return_pct double, direction_correct int, "
    "is_real_market_data int, evaluation_status string, data_source string")

PRICE_QUOTE = _schema("ticker string, quote_date date, close_price_usd double, data_source string")

RUN_LOG = _schema(
    "run_id string, run_type string, started_at_utc timestamp, finished_at_utc timestamp, "
    "status string, ticker_count int, raw_headlines_collected int, scored_headlines int, "
    "insights_generated int, trades_executed int, error_message string, summary_json string")

PORTFOLIO_RUN = _schema(
    "run_name string, starting_cash_cad double, cash_cad double, status string, "
    "created_at_utc timestamp, updated_at_utc timestamp")

POSITION = _schema(
    "run_name string, ticker string, quantity double, avg_cost_cad double, last_price_cad double, "
    "market_value_cad double, unrealized_pnl_cad double")

TRADE = _schema(
    "run_name string, insight_id bigint, traded_at_utc timestamp, ticker string, side string, "
    "quantity double, price_cad double, gross_cad double, fee_cad double, reason string")

SNAPSHOT = _schema(
    "run_name string, snapshot_date date, cash_cad double, positions_value_cad double, "
    "total_equity_cad double, cumulative_return_pct double, data_source string")

HEALTH_ALERT = _schema(
    "alert_key string, run_id string, severity string, alert_type string, message string, "
    "details_json string, detected_at_utc timestamp, status string")

REPORT_RUN = _schema(
    "report_name string, period_start date, period_end date, generated_at_utc timestamp, "
    "output_dir string, metrics_json string")

# Partial states of the daily measures, a row for each batch, ticker and day.
DAILY_PARTIAL = _schema(
    "ticker string, sentiment_date date, n_rows bigint, n_headlines bigint, n_positive bigint, n_neutral bigint, n_negative bigint, "
    "n_political bigint, n_financial bigint, sum_compound double, n_compound bigint, sum_confidence double, n_confidence bigint, "
    "sum_positive double, n_positive_score bigint, sum_neutral double, n_neutral_score bigint, sum_negative double, "
    "n_negative_score bigint, sum_absolute double, sum_by_confidence double, n_by_confidence bigint, sum_by_weight double, "
    "n_by_weight bigint, sum_weight double, first_headline_at_utc timestamp, latest_headline_at_utc timestamp")

TABLES: dict[str, T.StructType] = {
    "raw_headlines": T.StructType(RAW_HEADLINE.fields + [T.StructField("content_hash", T.StringType())]),
    "scored_headlines": SCORED_HEADLINE,
    "insights": INSIGHT,
    "insight_evaluations": EVALUATION,
    "price_quotes": PRICE_QUOTE,
    "run_logs": RUN_LOG,
    "portfolio_runs": PORTFOLIO_RUN,
    "portfolio_positions": POSITION,
    "portfolio_trades": TRADE,
    "portfolio_snapshots": SNAPSHOT,
    "health_alerts": HEALTH_ALERT,
    "report_runs": REPORT_RUN,
    "rejected_messages": _schema("value string"),
    "outbox": _schema("key string, value string"),
    "daily_partials": DAILY_PARTIAL,
}

NATURAL_KEYS: dict[str, list[str]] = {
    "raw_headlines": ["content_hash"],
    "scored_headlines": ["content_hash"],
    "insights": ["ticker", "insight_date"],
    "insight_evaluations": ["insight_id", "evaluation_date"],
    "price_quotes": ["ticker", "quote_date"],
    "run_logs": ["run_id"],
    "portfolio_runs": ["run_name"],
    "portfolio_positions": ["run_name", "ticker"],
    "portfolio_snapshots": ["run_name", "snapshot_date"],
    "health_alerts": ["alert_key"],
    "report_runs": ["report_name", "period_start", "period_end"],
    "rejected_messages": ["value"],
}

# child table, child column, parent table, parent column
REFERENCES: list[tuple[str, str, str, str]] = [
    ("portfolio_positions", "run_name", "portfolio_runs", "run_name"),
    ("portfolio_trades", "run_name", "portfolio_runs", "run_name"),
    ("portfolio_snapshots", "run_name", "portfolio_runs", "run_name"),
    ("insight_evaluations", "insight_id", "insights", "insight_id"),
    ("portfolio_trades", "insight_id", "insights", "insight_id"),
]

# Tables partitioned by the day of a timestamp, so date filters prune whole folders.
DAY_PARTITIONED = {"raw_headlines": "published_at_utc", "scored_headlines": "published_at_utc"}

# Tables whose natural key holds a day: partitioned by it, so an upsert of some days rewrites these days only.
KEY_DAYS = {"insights": "insight_date", "insight_evaluations": "evaluation_date", "price_quotes": "quote_date",
            "portfolio_snapshots": "snapshot_date", "daily_partials": "sentiment_date"}
