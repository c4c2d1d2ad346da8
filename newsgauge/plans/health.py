"""Health rules over run summaries, alert refresh and alert text."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgauge.functions import fixed_values as fixed
from newsgauge.functions.text import fixed_or_na, iso_timestamp
from newsgauge.options import HealthOptions
from newsgauge.sources.tables import resolve_alerts, upsert

ALERT_COLUMNS = ["alert_key", "run_id", "severity", "alert_type", "message", "details_json"]


def _alert(run_id: Column, kind: str, severity: str, message: Column, details: Column) -> Column:
    return F.struct(
        F.concat(F.coalesce(run_id, F.lit("global")), F.lit(f":{kind}")).alias("alert_key"),
        run_id.alias("run_id"), F.lit(severity).alias("severity"), F.lit(kind).alias("alert_type"),
        message.alias("message"), F.to_json(details).alias("details_json"))


def success_alerts(runs: DataFrame, opts: HealthOptions = HealthOptions(),
                   summary: str = "summary_json") -> DataFrame:
    """Rules over finished runs, all runs in one pass: (summary_json) -> one row per broken rule."""
    def field(path: str, kind: str) -> Column:
        return F.coalesce(F.get_json_object(summary, path).try_cast(kind), F.lit(0).cast(kind))

    run_id = F.coalesce(F.nullif(F.get_json_object(summary, "$.run_id"), F.lit("")), F.lit("unknown"))
    rows = runs.select(
        run_id.alias("run_id"), field("$.raw_headlines_collected", "int").alias("raw"),
        field("$.insights_generated", "int").alias("made"),
        field("$.evaluation.evaluations_saved", "int").alias("total"),
        field("$.evaluation.synthetic_evaluations", "int").alias("made_up"),
        field("$.simulation.total_equity_cad", "double").alias("equity"))
    share = F.coalesce(F.try_divide(F.col("made_up") * 100.0, F.nullif("total", F.lit(0))), F.lit(0.0))
    rid, raw, made, equity = (F.col(c) for c in ("run_id", "raw", "made", "equity"))
    rules = [
        F.when(raw < opts.min_headlines, _alert(
            rid, "low_headline_coverage", "warning",
            F.format_string(f"Only %d raw headlines were collected; expected at least {opts.min_headlines}.", raw),
            F.struct(raw.alias("raw_headlines_collected"), F.lit(opts.min_headlines).alias("threshold")))),
        F.when(made < opts.min_insights, _alert(
            rid, "low_insight_coverage", "warning",
            F.format_string(f"Only %d insights were generated; expected at least {opts.min_insights}.", made),
            F.struct(made.alias("insights_generated"), F.lit(opts.min_insights).alias("threshold")))),
        F.when(share > opts.max_synthetic_pct, _alert(
            rid, "high_synthetic_quote_usage", "warning",
            F.format_string("%.1f%% of insight evaluations used synthetic quote data.", share),
            F.struct(F.col("made_up").alias("synthetic_evaluations"), F.col("total").alias("evaluations_saved"),
                     F.lit(opts.max_synthetic_pct).alias("threshold_pct")))),
        F.when(equity <= 0, _alert(
            rid, "portfolio_equity_invalid", "critical", F.lit("Mock portfolio equity is zero or negative."),
            F.struct(equity.alias("total_equity_cad")))),
    ]
    return rows.select(F.explode(F.array_compact(F.array(*rules))).alias("_a")).select("_a.*")


def failure_alerts(runs: DataFrame) -> DataFrame:
    """One critical alert per failed run."""
    failed = runs.where(F.col("status") == "failed")
    error = F.coalesce("error_message", F.lit(""))
    alert = _alert(F.col("run_id"), "pipeline_failed", "critical",
                   F.concat(F.lit("Local pipeline failed: "), error), F.struct(error.alias("error")))
    return failed.select(alert.alias("_a")).select("_a.*")


def latest_success(runs: DataFrame) -> DataFrame:
    """One row: when the last successful run finished (NULL when none has)."""
    return runs.agg(F.max(F.when(F.col("status") == "success", F.col("finished_at_utc")))
                    .alias("latest_finished_at_utc"))


def staleness_alerts(runs: DataFrame, now: Column | datetime, opts: HealthOptions = HealthOptions()) -> DataFrame:
    """At most one alert: never finished, or finished too long ago."""
    clock = now if isinstance(now, Column) else F.lit(now)
    last = F.col("latest_finished_at_utc")
    age = (F.unix_micros(clock) - F.unix_micros(last)) / F.lit(3.6e9)
    nobody = F.lit(None).cast("string")
    never = _alert(nobody, "pipeline_never_finished", "critical",
                   F.lit("No successful local pipeline run has finished yet."),
                   F.struct(F.lit(None).cast("string").alias("latest_finished_at_utc")))
    stale = _alert(nobody, "pipeline_stale", "critical", F.format_string(
        f"Latest successful run is %.1f hours old; threshold is {opts.stale_hours:.1f} hours.", age),
        F.struct(iso_timestamp(last).alias("latest_finished_at_utc"), age.alias("age_hours"),
                 F.lit(opts.stale_hours).alias("threshold_hours")))
    chosen = F.when(last.isNull(), never).when(age > opts.stale_hours, stale)
    return latest_success(runs).select(chosen.alias("_a")).where(F.col("_a").isNotNull()).select("_a.*")


def refresh_alerts(alerts: DataFrame, raised: DataFrame, now: Column | datetime) -> DataFrame:
    """Resolves every monitored open alert, then upserts the new ones as open."""
    clock = now if isinstance(now, Column) else F.lit(now)
    fresh = raised.select(*ALERT_COLUMNS, clock.alias("detected_at_utc"), F.lit("open").alias("status"))
    return upsert(resolve_alerts(alerts, fixed.MONITORED_ALERTS), fresh, ["alert_key"])


def alert_lines(alerts: DataFrame) -> DataFrame:
    return alerts.select("alert_key", F.concat(
        F.lit("- "), F.upper("severity"), F.lit(" "), F.col("alert_type"), F.lit(": "), F.col("message"))
        .alias("line"))


def signal_lines(active: DataFrame) -> DataFrame:
    kind = F.when(F.col("is_positive_sentiment_signal"), "POSITIVE").otherwise("NEGATIVE")
    return active.select("ticker", F.concat(
        F.lit("- "), F.col("ticker"), F.lit(" | "), kind, F.lit(" | date="), F.col("sentiment_date").cast("string"),
        F.lit(" | headlines="), F.col("headline_count").cast("string"),
        F.lit(" | avg_score="), fixed_or_na(F.col("avg_compound_score")),
        F.lit(" | rolling_avg="), fixed_or_na(F.col("rolling_7_day_avg_compound_score")),
        F.lit(" | volume_weighted="), fixed_or_na(F.col("rolling_7_day_volume_weighted_sentiment_index")),
        F.lit(" | zscore="), fixed_or_na(F.col("compound_score_zscore"))).alias("line"))


def open_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.where(F.lower(F.coalesce("status", F.lit(""))) == "open")
