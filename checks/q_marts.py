"""Marts, signals, market index, audit, alerts text."""

from __future__ import annotations

import dataclasses
import datetime as dt

from pyspark.sql import functions as F

from checks import adapters as a
from checks.registry import register
from newsgauge.options import LOCAL, WAREHOUSE
from newsgauge.plans import health, insights, marts, reports
from newsgauge.functions import numbers
from newsgauge.operators import frames, keyed

DAILY = ("ticker sentiment_date:d headline_count:i avg_compound_score:f avg_confidence:f "
         "positive_headline_count:i neutral_headline_count:i negative_headline_count:i avg_positive_score:f "
         "avg_neutral_score:f avg_negative_score:f compound_score_sum:f absolute_sentiment_volume:f "
         "confidence_weighted_compound_score:f source_weighted_compound_score:f "
         "headline_volume_weighted_sentiment_index:f first_headline_at_utc:t latest_headline_at_utc:t")
ROLLING = ("ticker sentiment_date:d headline_count:i rolling_7_day_avg_compound_score:f "
           "rolling_7_day_avg_headline_count:f rolling_7_day_compound_score_stddev:f "
           "rolling_7_day_volume_weighted_sentiment_index:f rolling_7_day_compound_score_sum:f "
           "rolling_7_day_absolute_sentiment_volume:f")
SIGNALS = ("ticker sentiment_date:d headline_count:i avg_compound_score:f compound_score_zscore:f "
           "is_negative_sentiment_signal:b is_positive_sentiment_signal:b is_negative_zscore_anomaly:b "
           "is_positive_zscore_anomaly:b is_zscore_anomaly:b rolling_7_day_avg_compound_score:f "
           "confidence_weighted_compound_score:f source_weighted_compound_score:f "
           "headline_volume_weighted_sentiment_index:f")
MARKET = ("sentiment_date:d ticker_count:i headline_count:i equal_weight_sentiment_index:f "
          "volume_weighted_sentiment_index:f confidence_volume_weighted_sentiment_index:f "
          "source_volume_weighted_sentiment_index:f rolling_7_day_volume_weighted_sentiment_index:f "
          "rolling_7_day_volume_weighted_sentiment_stddev:f")
WH, LO = a.WAREHOUSE_CHAIN, a.LOCAL_CHAIN


@register("a01_ticker_sentiment_daily_warehouse", DAILY, "SELECT * FROM daily", WH[:2])
def _(spark, d):
    return marts.daily_sentiment(a.scored(spark, d), WAREHOUSE)


@register("a02_ticker_sentiment_daily_local", DAILY + " political_headline_count:i financial_headline_count:i",
          "SELECT * FROM daily", LO[:2])
def _(spark, d):
    return marts.daily_sentiment(a.scored(spark, d), LOCAL)


@register("w04_rolling_seven_rows_warehouse", ROLLING, "SELECT * FROM rolling", WH[:3])
def _(spark, d):
    return marts.rolling_sentiment(marts.daily_sentiment(a.scored(spark, d), WAREHOUSE), WAREHOUSE)


@register("w06_rolling_seven_rows_local", ROLLING, "SELECT * FROM rolling", LO[:3])
def _(spark, d):
    return marts.rolling_sentiment(marts.daily_sentiment(a.scored(spark, d), LOCAL), LOCAL)


@register("p11_c22_signal_summary_warehouse", SIGNALS, "SELECT * FROM signals", WH)
def _(spark, d):
    return marts.build_marts(a.scored(spark, d), WAREHOUSE)["signals"]


@register("p11_c22_signal_summary_local", SIGNALS, "SELECT * FROM signals", LO)
def _(spark, d):
    return marts.build_marts(a.scored(spark, d), LOCAL)["signals"]


def _market_sql(zero: str) -> str:
    return f"""
SELECT *, avg(volume_weighted_sentiment_index) OVER w AS rolling_7_day_volume_weighted_sentiment_index,
  stddev_samp(volume_weighted_sentiment_index) OVER w AS rolling_7_day_volume_weighted_sentiment_stddev
FROM (SELECT sentiment_date, count(DISTINCT ticker) AS ticker_count, sum(headline_count) AS headline_count,
    avg(avg_compound_score) AS equal_weight_sentiment_index,
    coalesce(sum(avg_compound_score * headline_count) / nullif(sum(headline_count), 0), {zero}) AS volume_weighted_sentiment_index,
    sum(confidence_weighted_compound_score * headline_count) / nullif(sum(headline_count), 0) AS confidence_volume_weighted_sentiment_index,
    sum(source_weighted_compound_score * headline_count) / nullif(sum(headline_count), 0) AS source_volume_weighted_sentiment_index
  FROM daily GROUP BY 1)
WINDOW w AS (ORDER BY sentiment_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"""


@register("a03_w05_market_sentiment_index_warehouse", MARKET, _market_sql("NULL"), WH[:2])
def _(spark, d):
    return marts.market_index(marts.daily_sentiment(a.scored(spark, d), WAREHOUSE), WAREHOUSE)


@register("a04_market_sentiment_index_local", MARKET, _market_sql("0.0"), LO[:2])
def _(spark, d):
    return marts.market_index(marts.daily_sentiment(a.scored(spark, d), LOCAL), LOCAL)


_AUDIT = ("first_scored_headline_at_utc:t latest_scored_headline_at_utc:t coverage_days:i total_scored_headlines:i "
          "tracked_ticker_count:i avg_scored_headlines_per_day:f max_scored_headlines_in_one_day:i "
          "days_with_500_plus_scored_headlines:i has_sp500_scale_tickers:b has_six_month_window:b "
          "has_500_plus_daily_headlines:b")


def _audit_sql(days: int, daily: int, tickers: int, local: bool) -> str:
    mean = "avg(n)" if local else "sum(n) / (date_diff('day', min(d), max(d)) + 1)"
    span = "date_diff('day', min(d), max(d)) + 1" if local else "count(*)"
    return f"""
SELECT min(lo) AS first_scored_headline_at_utc, max(hi) AS latest_scored_headline_at_utc,
  date_diff('day', min(d), max(d)) + 1 AS coverage_days, count(*) AS active_scored_days, sum(n) AS total_scored_headlines,
  (SELECT count(DISTINCT ticker) FROM scored) AS tracked_ticker_count, {mean} AS avg_scored_headlines_per_day,
  max(n) AS max_scored_headlines_in_one_day, count(*) FILTER (n >= {daily}) AS days_with_500_plus_scored_headlines,
  (SELECT count(DISTINCT ticker) FROM scored) >= {tickers} AS has_sp500_scale_tickers,
  {span} >= {days} AS has_six_month_window, max(n) >= {daily} AS has_500_plus_daily_headlines
FROM (SELECT CAST(published_at_utc AS DATE) AS d, count(*) AS n, min(published_at_utc) AS lo, max(published_at_utc) AS hi
      FROM scored GROUP BY 1)"""


@register("a05_j04_claim_audit_warehouse", _AUDIT + " active_scored_days:i", _audit_sql(180, 500, 500, False), (a.SCORED,))
def _(spark, d):
    return marts.coverage_audit(a.scored(spark, d), WAREHOUSE)


@register("a05_claim_audit_other_thresholds", _AUDIT + " active_scored_days:i", _audit_sql(30, 330, 100, False), (a.SCORED,))
def _(spark, d):
    opts = dataclasses.replace(WAREHOUSE, min_days=30, min_daily_headlines=330, min_tickers=100)
    return marts.coverage_audit(a.scored(spark, d), opts)


@register("a06_claim_audit_local", _AUDIT, _audit_sql(180, 500, 500, True), (a.SCORED,))
def _(spark, d):
    return marts.coverage_audit(a.scored(spark, d), LOCAL)


@register("w01_w02_latest_headline_per_ticker",
          "ticker headline source url published_at_utc:t sentiment_label positive_score:f neutral_score:f "
          "negative_score:f compound_score:f confidence:f headline_age_hours:f source_tier:i",
          """SELECT * FROM scored QUALIFY row_number() OVER (
               PARTITION BY ticker ORDER BY published_at_utc DESC, content_hash) = 1""", (a.SCORED,))
def _(spark, d):
    return marts.build_marts(a.scored(spark, d), WAREHOUSE)["latest"]


_ACTIVE = """SELECT * FROM signals WHERE sentiment_date = (SELECT max(sentiment_date) FROM signals)
  AND (is_positive_sentiment_signal OR is_negative_sentiment_signal)"""


@register("p12_j18_active_signals",
          "ticker sentiment_date:d headline_count:i avg_compound_score:f rolling_7_day_avg_compound_score:f "
          "rolling_7_day_volume_weighted_sentiment_index:f compound_score_zscore:f is_positive_sentiment_signal:b "
          "is_negative_sentiment_signal:b is_positive_zscore_anomaly:b is_negative_zscore_anomaly:b", _ACTIVE, WH)
def _(spark, d):
    return marts.active_signals(marts.build_marts(a.scored(spark, d), WAREHOUSE)["signals"])


@register("h05_c27_signal_alert_lines", "ticker line", f"""
SELECT ticker, '- ' || ticker || ' | ' || CASE WHEN is_positive_sentiment_signal THEN 'POSITIVE' ELSE 'NEGATIVE' END
  || ' | date=' || sentiment_date || ' | headlines=' || headline_count
  || ' | avg_score=' || printf('%.3f', avg_compound_score)
  || ' | rolling_avg=' || printf('%.3f', rolling_7_day_avg_compound_score)
  || ' | volume_weighted=' || printf('%.3f', rolling_7_day_volume_weighted_sentiment_index)
  || ' | zscore=' || coalesce(printf('%.3f', compound_score_zscore), 'n/a') AS line
FROM ({_ACTIVE})""", WH)
def _(spark, d):
    return health.signal_lines(marts.active_signals(marts.build_marts(a.scored(spark, d), WAREHOUSE)["signals"]))


@register("s27_published_views_read_in_order", "ticker sentiment_date:d headline_count:i",
          "SELECT ticker, sentiment_date, headline_count FROM daily", WH[:2])
def _(spark, d):
    marts.publish_views({f"newsgauge_{k}": v for k, v in marts.build_marts(a.scored(spark, d)).items()})
    return marts.in_read_order("daily", spark.table("newsgauge_daily")).select("ticker", "sentiment_date", "headline_count")


@register("s28_all_marts_row_counts", "mart n:i", """
SELECT 'latest' AS mart, count(DISTINCT ticker) AS n FROM scored UNION ALL SELECT 'daily', count(*) FROM daily
UNION ALL SELECT 'rolling', count(*) FROM daily UNION ALL SELECT 'signals', count(*) FROM daily
UNION ALL SELECT 'market', count(DISTINCT sentiment_date) FROM daily UNION ALL SELECT 'audit', 1""", LO[:2])
def _(spark, d):
    built = marts.build_marts(a.scored(spark, d), LOCAL)
    return frames.union_all(*[m.agg(F.count(F.lit(1)).alias("n")).withColumn("mart", F.lit(name))
                              for name, m in built.items()])


@register("s01_s02_scan_declared_source", "ticker n:i", "SELECT ticker, count(*) AS n FROM scored GROUP BY 1", (a.SCORED,))
def _(spark, d):
    return a.scored(spark, d).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


@register("s03_j06_recent_headlines_of_tickers", "event_id:i ticker published_at_utc:t compound_score:f", """
SELECT * FROM scored WHERE published_at_utc >= TIMESTAMP '2024-01-21' AND ticker IN (SELECT 'T' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
          (a.SCORED,))
def _(spark, d):
    wanted = a.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(
        F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("ticker"))
    return insights.recent_headlines(a.scored(spark, d), dt.datetime(2024, 1, 21, tzinfo=dt.timezone.utc), wanted)


@register("p03_p17_defaults_and_coercion", "event_id:i category topic industry summary missing:f number:f odd:f",
          """SELECT event_id, category, coalesce(topic, '') AS topic, coalesce(industry, '') AS industry,
               coalesce(summary, 'none') AS summary, 7.5 AS missing,
               coalesce(TRY_CAST(regexp_extract(headline, '[0-9]+') AS DOUBLE), 0) AS number, 0.0 AS odd FROM scored""", (a.SCORED,))
def _(spark, d):
    rows = frames.with_defaults(a.scored(spark, d), {"topic": "", "industry": "", "summary": "none", "category": "financial"})
    rows = rows.withColumn("digits", F.regexp_extract("headline", "[0-9]+", 0))
    return rows.withColumns({"missing": numbers.as_number(rows, "absent", 7.5), "number": numbers.as_number(rows, "digits"),
                             "odd": numbers.as_number(rows, "source")})


@register("p04_p05_ticker_filter_and_columns", "event_id:i ticker", """
SELECT event_id, ticker FROM scored WHERE ticker IN ('T1', 'T2', 'T3', 'T5', 'T8')""", (a.SCORED,))
def _(spark, d):
    rows = frames.filter_tickers(a.scored(spark, d), ["t1", "T2", "t3", "T5", "t8"])
    return frames.keep_existing(rows, ["event_id", "ticker", "not_there"])


@register("p16_p18_labels_and_weights", "event_id:i label warehouse_weight:f local_weight:f", """
SELECT event_id, sentiment_label AS label, CASE source_tier WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 1 END AS warehouse_weight,
  CASE source_tier WHEN 1 THEN 1.2 WHEN 2 THEN 1.0 ELSE 0.82 END AS local_weight FROM scored""", (a.SCORED,))
def _(spark, d):
    tier = F.col("source_tier")
    return a.scored(spark, d).select(
        "event_id", numbers.label_by_threshold(F.col("compound_score")).alias("label"),
        numbers.tier_weight(tier, WAREHOUSE.tier_weights, WAREHOUSE.other_weight).alias("warehouse_weight"),
        numbers.tier_weight(tier, LOCAL.tier_weights, LOCAL.other_weight).alias("local_weight"))


@register("p07_p08_period_filters", "sentiment_date:d daily_rows:i headlines:i", """
SELECT sentiment_date, count(*) AS daily_rows, sum(headline_count) AS headlines FROM daily
WHERE sentiment_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-14' GROUP BY 1""", WH[:2])
def _(spark, d):
    start, end = dt.date(2024, 1, 8), dt.date(2024, 1, 14)
    rows = a.scored(spark, d)
    by_day = frames.between_dates(marts.daily_sentiment(rows), "sentiment_date", start, end)
    stamps = frames.between_days_of(rows, "published_at_utc", start, end)
    left = by_day.groupBy("sentiment_date").agg(F.count(F.lit(1)).alias("daily_rows"))
    right = stamps.groupBy(F.col("published_at_utc").cast("date").alias("sentiment_date")).agg(
        F.count(F.lit(1)).alias("headlines"))
    return left.join(right, "sentiment_date")


@register("w03_w16_first_and_newest_per_key", "source newest_id:i first_id:i", """
SELECT source, arg_max(event_id, published_at_utc) AS newest_id, arg_min(event_id, published_at_utc) AS first_id
FROM scored GROUP BY 1""", (a.SCORED,))
def _(spark, d):
    rows = a.scored(spark, d)
    newest = keyed.latest_rows(rows, ["source"], "published_at_utc").select("source", F.col("event_id").alias("newest_id"))
    first = keyed.distinct_in_order(rows, ["source"], [F.col("published_at_utc")]).select(
        "source", F.col("event_id").alias("first_id"))
    return newest.join(first, "source")
