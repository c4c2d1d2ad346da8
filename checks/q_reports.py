"""Read-side frames and health rules."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from checks import adapters as a
from checks.q_insights import ALL_DAYS, INSIGHTS, NO_EXTERNAL
from checks.q_prices import EVAL_CTES, evaluations
from checks.registry import register
from newsgauge.options import LOCAL
from newsgauge.plans import health, insights, marts, reports
from newsgauge.sources import tables

LATEST = """latest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY published_at_utc DESC, content_hash) = 1)"""
HOT = "ticker news_heat_score:f signal_label headline_count:i political_headline_count:i hot_signal_score:f latest_source latest_headline why_hot"


def local_signals(spark, d):
    rows = a.scored(spark, d)
    return marts.build_marts(rows, LOCAL, insights.insights_for_days(rows))["signals"]


@register("t02_j03_hot_tickers_with_insights", HOT + " recommendation confidence_grade", """
SELECT s.ticker, round(s.headline_count * (0.55 + abs(coalesce(i.signal_score, 0))) + s.political_headline_count * 0.75
    + abs(s.compound_score_zscore) * 2 + coalesce(i.opportunity_score, 0) * 3, 2) AS news_heat_score, i.signal_label,
  s.headline_count, s.political_headline_count, coalesce(i.signal_score, 0) AS hot_signal_score, l.source AS latest_source,
  l.headline AS latest_headline, i.rationale AS why_hot, i.recommendation, i.confidence_grade
FROM signals s LEFT JOIN (SELECT *, upper(recommendation[1]) AS initial, CASE recommendation WHEN 'strong_buy' THEN 'Strong Buy' WHEN 'watch_risk' THEN 'Watch Risk'
      ELSE upper(recommendation[1]) || recommendation[2:] END || ' from ' || signal_label || ' ' || printf('%+.3f', sig)
    || ' signal across ' || n || ' headline(s): ' || CASE WHEN n_pol > 0 THEN n_pol || ' political/policy headline(s), ' ELSE '' END
    || n_fin || ' financial headline(s). Opportunity ' || printf('%.2f', opp) || ', risk ' || printf('%.2f', risk)
    || '. Strongest catalyst: ' || top_headline || '.' || CASE WHEN top_topic <> '' THEN ' Topic: ' || top_topic || '.' ELSE '' END AS rationale
  FROM insights) i ON i.ticker = s.ticker AND i.insight_date = s.sentiment_date
LEFT JOIN latest l ON l.ticker = s.ticker WHERE s.sentiment_date = (SELECT max(sentiment_date) FROM signals)
ORDER BY news_heat_score DESC, s.ticker LIMIT 8""", a.LOCAL_CHAIN + (ALL_DAYS, NO_EXTERNAL, INSIGHTS, LATEST))
def _(spark, d):
    return reports.hot_tickers(local_signals(spark, d), marts.latest_headlines(a.scored(spark, d)))


@register("t02_hot_tickers_from_headlines_only", "ticker news_heat_score:f signal_label headline_count:i hot_signal_score:f latest_headline why_hot", """
SELECT ticker, round(0.55 + abs(compound_score), 2) AS news_heat_score, sentiment_label AS signal_label, 1 AS headline_count,
  compound_score AS hot_signal_score, headline AS latest_headline, headline AS why_hot FROM latest
ORDER BY news_heat_score DESC, ticker LIMIT 8""", (a.SCORED, LATEST))
def _(spark, d):
    return reports.hot_tickers(None, marts.latest_headlines(a.scored(spark, d)))


@register("t03_default_tickers", "ticker", """
SELECT ticker FROM (SELECT ticker, 0 AS tier, -headline_count AS spot FROM daily WHERE sentiment_date = (SELECT max(sentiment_date) FROM daily)
  UNION ALL SELECT 'T' || c_custkey, 1, c_custkey FROM customer)
QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY tier, spot) = 1 ORDER BY tier, spot, ticker LIMIT 12""", a.WAREHOUSE_CHAIN[:2])
def _(spark, d):
    known = a.table(spark, d, "customer").select(F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("ticker"),
                                                 F.col("c_custkey").alias("position"))
    return reports.default_tickers(marts.daily_sentiment(a.scored(spark, d)), known)


def customers(spark, d):
    return a.table(spark, d, "customer").select(
        F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("ticker"), F.col("c_custkey").alias("position"))


@register("t08_slice_of_tickers", "ticker position:i", """
SELECT 't' || c_custkey AS ticker, c_custkey AS position FROM customer
WHERE c_custkey >= 17 ORDER BY c_custkey LIMIT 12""")
def _(spark, d):
    return reports.slice_from(customers(spark, d), "t17", 12)


@register("u04_ordered_union_of_ticker_lists", "ticker", """
SELECT DISTINCT ticker FROM (SELECT 'T' || c_custkey AS ticker FROM customer UNION ALL SELECT ticker FROM scored)""", (a.SCORED,))
def _(spark, d):
    return reports.ordered_tickers(customers(spark, d), a.scored(spark, d).select("ticker"))


@register("w11_latest_headline_lookup", "ticker latest_headline latest_source latest_headline_at_utc:t", """
SELECT ticker, headline AS latest_headline, source AS latest_source, published_at_utc AS latest_headline_at_utc FROM latest""", (a.SCORED, LATEST))
def _(spark, d):
    return reports.latest_headline_lookup(a.scored(spark, d))


BREAKDOWN = """breakdown AS (
  SELECT ticker, positive_headline_count AS positive_count, neutral_headline_count AS neutral_count, negative_headline_count AS negative_count,
    headline_count, positive_headline_count * 100.0 / headline_count AS positive_pct, neutral_headline_count * 100.0 / headline_count AS neutral_pct,
    negative_headline_count * 100.0 / headline_count AS negative_pct, avg_compound_score
  FROM daily QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY sentiment_date DESC) = 1)"""


@register("a12_sentiment_breakdown_per_ticker",
          "ticker positive_count:i neutral_count:i negative_count:i headline_count:i positive_pct:f neutral_pct:f negative_pct:f avg_compound_score:f",
          "SELECT * FROM breakdown", a.WAREHOUSE_CHAIN[:2] + (BREAKDOWN,))
def _(spark, d):
    return reports.sentiment_breakdown(marts.daily_sentiment(a.scored(spark, d)))


@register("a13_headline_numbers", "latest_headline_count:i buy_count:i sell_count:i", """
SELECT (SELECT sum(headline_count) FROM daily WHERE sentiment_date = (SELECT max(sentiment_date) FROM daily)) AS latest_headline_count,
  count(*) FILTER (recommendation IN ('buy', 'strong_buy')) AS buy_count, count(*) FILTER (recommendation IN ('sell', 'trim')) AS sell_count
FROM part_insights WHERE insight_date = (SELECT max(insight_date) FROM part_insights)""", a.WAREHOUSE_CHAIN[:2] + (a.PART_INSIGHTS,))
def _(spark, d):
    advice = a.part_insights(spark, d).withColumnRenamed("insight_date", "sentiment_date")
    return reports.headline_numbers(marts.daily_sentiment(a.scored(spark, d)), advice)


TRADE_SUMMARY = """trade_sums AS (
  SELECT ticker, sum(quantity) FILTER (side = 'buy') AS bought, sum(quantity) FILTER (side = 'sell') AS sold,
    sum(gross_cad) FILTER (side = 'buy') AS paid, max(traded_at_utc) AS latest_trade_at FROM trades GROUP BY 1),
position_sums AS (
  SELECT ticker, sum(quantity) AS qty, sum(market_value_cad) AS value, sum(unrealized_pnl_cad) AS pnl, sum(last_price_cad * quantity) AS last FROM positions GROUP BY 1),
trade_summary AS (
  SELECT *, coalesce(pnl / nullif(current_quantity * avg_buy_price_cad, 0) * 100, 0) AS open_return_pct FROM (
    SELECT ticker, coalesce(bought, 0) AS bought_quantity, coalesce(sold, 0) AS sold_quantity, coalesce(paid / nullif(bought, 0), 0) AS avg_buy_price_cad,
      coalesce(qty, 0) AS current_quantity, coalesce(last / nullif(qty, 0), w.close_price_usd * 1.37, 0) AS last_price_cad,
      coalesce(value, 0) AS market_value_cad, coalesce(pnl, 0) AS unrealized_pnl_cad, pnl, latest_trade_at
    FROM trade_sums FULL JOIN position_sums USING (ticker) LEFT JOIN watch w USING (ticker)))"""
WATCH = "watch AS (SELECT * FROM quotes QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY quote_date DESC) = 1)"


def _watch(spark, d):
    from newsgauge.operators.asof import latest_quote_per_ticker

    return latest_quote_per_ticker(a.quotes(spark, d))


@register("a11_trade_summary_per_ticker",
          "ticker bought_quantity:m sold_quantity:m avg_buy_price_cad:m current_quantity:m last_price_cad:m market_value_cad:m "
          "unrealized_pnl_cad:m open_return_pct:f latest_trade_at:t", "SELECT * FROM trade_summary",
          (a.QUOTES, a.TRADES, a.POSITIONS, WATCH, TRADE_SUMMARY))
def _(spark, d):
    return reports.trade_summary(a.positions(spark, d), a.trades(spark, d), _watch(spark, d))


@register("j17_t07_portfolio_per_ticker",
          "ticker company headlines:i positive_pct:f quantity_owned:m avg_buy_price_cad:m last_price_cad:m market_value_cad:m "
          "open_return_pct:f model_win_rate_pct:f avg_market_move_pct:a", """
SELECT k.ticker, k.ticker AS company, coalesce(b.headline_count, 0) AS headlines, coalesce(b.positive_pct, 0) AS positive_pct,
  coalesce(t.current_quantity, 0) AS quantity_owned, coalesce(t.avg_buy_price_cad, 0) AS avg_buy_price_cad,
  CASE WHEN coalesce(t.current_quantity, 0) <> 0 THEN t.last_price_cad ELSE coalesce(w.close_price_usd * 1.37, 0) END AS last_price_cad,
  coalesce(t.market_value_cad, 0) AS market_value_cad, coalesce(t.open_return_pct, 0) AS open_return_pct,
  coalesce(nullif(e.real_win, 0), e.win, 0) AS model_win_rate_pct, coalesce(e.move, 0) AS avg_market_move_pct
FROM (SELECT 'P' || p_partkey AS ticker FROM part UNION SELECT ticker FROM positions UNION SELECT ticker FROM trades
      UNION SELECT ticker FROM daily UNION SELECT ticker FROM evaluations) k
LEFT JOIN breakdown b USING (ticker) LEFT JOIN trade_summary t USING (ticker) LEFT JOIN watch w USING (ticker)
LEFT JOIN (SELECT ticker, avg(direction_correct) * 100 AS win, avg(direction_correct) FILTER (is_real_market_data = 1) * 100 AS real_win,
    avg(forward_return_pct) AS move FROM evaluations GROUP BY 1) e USING (ticker)""",
          EVAL_CTES + a.WAREHOUSE_CHAIN[:2] + (a.TRADES, a.POSITIONS, WATCH, TRADE_SUMMARY, BREAKDOWN))
def _(spark, d):
    listed = a.table(spark, d, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("ticker"))
    return reports.portfolio_tickers(listed, a.positions(spark, d), a.trades(spark, d), marts.daily_sentiment(a.scored(spark, d)),
                                     evaluations(spark, d), _watch(spark, d))


SNAPSHOTS = """snapshots AS (
  SELECT CAST(o_orderdate AS DATE) AS snapshot_date, sum(o_totalprice) AS total_equity_cad, sum(o_totalprice) / 1000 AS cash_cad,
    count(*) AS cumulative_return_pct FROM orders GROUP BY 1)"""


def snapshots(spark, d):
    o = a.table(spark, d, "orders")
    rows = o.groupBy(F.col("o_orderdate").cast("date").alias("snapshot_date")).agg(
        F.sum("o_totalprice").alias("total_equity_cad"), (F.sum("o_totalprice") / 1000).alias("cash_cad"),
        F.count(F.lit(1)).cast("double").alias("cumulative_return_pct"))
    return rows.withColumns({"positions_value_cad": F.col("total_equity_cad") - F.col("cash_cad"), "data_source": F.lit("yahoo_chart")})


@register("a19_t09_portfolio_summary",
          "starting_cash_cad:m cash_cad:m positions_value_cad:m total_equity_cad:m profit_cad:m return_pct:f snapshot_date:d data_source", """
SELECT c.c AS starting_cash_cad, s.cash_cad, s.total_equity_cad - s.cash_cad AS positions_value_cad, s.total_equity_cad,
  s.total_equity_cad - c.c AS profit_cad, s.cumulative_return_pct AS return_pct, s.snapshot_date, 'yahoo_chart' AS data_source
FROM (SELECT arg_max(c_acctbal, c_custkey) AS c FROM customer) c, (SELECT * FROM snapshots ORDER BY snapshot_date DESC LIMIT 1) s""", (SNAPSHOTS,))
def _(spark, d):
    runs = a.table(spark, d, "customer").select(F.col("c_acctbal").alias("starting_cash_cad"), F.col("c_custkey").alias("updated_at_utc"))
    return reports.portfolio_summary(runs, snapshots(spark, d))


WEEK = (dt.date(2000, 5, 1), dt.date(2000, 5, 7))


@register("a14_weekly_metrics",
          "period_start:d period_end:d insights_generated:i evaluations_saved:i real_market_evaluations:i synthetic_evaluations:i "
          "real_win_rate_pct:f real_avg_forward_return_pct:a portfolio_total_equity_cad:m portfolio_return_pct:f trades_executed:i "
          "pipeline_runs:i health_alerts:i", f"""
SELECT DATE '{WEEK[0]}' AS period_start, DATE '{WEEK[1]}' AS period_end, e.*, s.total_equity_cad AS portfolio_total_equity_cad,
  s.cumulative_return_pct AS portfolio_return_pct,
  (SELECT count(*) FROM part_insights WHERE insight_date BETWEEN DATE '{WEEK[0]}' AND DATE '{WEEK[1]}') AS insights_generated,
  (SELECT count(*) FROM trades WHERE CAST(traded_at_utc AS DATE) BETWEEN DATE '{WEEK[0]}' AND DATE '{WEEK[1]}') AS trades_executed,
  (SELECT count(*) FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '{WEEK[0]}' AND DATE '{WEEK[1]}') AS pipeline_runs,
  (SELECT count(*) FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '{WEEK[0]}' AND DATE '{WEEK[1]}') AS health_alerts
FROM (SELECT count(*) AS evaluations_saved, count(*) FILTER (is_real_market_data = 1) AS real_market_evaluations,
    count(*) FILTER (is_real_market_data = 0) AS synthetic_evaluations,
    coalesce(avg(direction_correct) FILTER (is_real_market_data = 1) * 100, 0) AS real_win_rate_pct,
    coalesce(avg(forward_return_pct) FILTER (is_real_market_data = 1), 0) AS real_avg_forward_return_pct
  FROM evaluations WHERE evaluation_date BETWEEN DATE '{WEEK[0]}' AND DATE '{WEEK[1]}') e,
  (SELECT * FROM snapshots WHERE snapshot_date BETWEEN DATE '{WEEK[0]}' AND DATE '{WEEK[1]}' ORDER BY snapshot_date DESC LIMIT 1) s""",
          EVAL_CTES + (a.TRADES, SNAPSHOTS))
def _(spark, d):
    frames = {
        "insights": a.part_insights(spark, d), "evaluations": evaluations(spark, d), "snapshots": snapshots(spark, d),
        "trades": a.trades(spark, d),
        "runs": a.table(spark, d, "orders").select(F.col("o_orderdate").cast("timestamp").alias("started_at_utc")),
        "alerts": a.table(spark, d, "lineitem").select(F.col("l_shipdate").cast("timestamp").alias("detected_at_utc"))}
    return reports.weekly_metrics(frames, *WEEK)


# ---------------------------------------------------------------- health

ALERT = "alert_key run_id severity alert_type message"
SUCCESS_SQL = """
SELECT run_id || ':low_headline_coverage' AS alert_key, run_id, 'warning' AS severity, 'low_headline_coverage' AS alert_type,
  'Only ' || raw || ' raw headlines were collected; expected at least 50.' AS message FROM run_logs WHERE raw < 50
UNION ALL SELECT run_id || ':low_insight_coverage', run_id, 'warning', 'low_insight_coverage',
  'Only ' || made || ' insights were generated; expected at least 10.' FROM run_logs WHERE made < 10
UNION ALL SELECT run_id || ':high_synthetic_quote_usage', run_id, 'warning', 'high_synthetic_quote_usage',
  printf('%.1f', made_up * 100.0 / total) || '% of insight evaluations used synthetic quote data.' FROM run_logs WHERE made_up * 100.0 / total > 35
UNION ALL SELECT run_id || ':portfolio_equity_invalid', run_id, 'critical', 'portfolio_equity_invalid',
  'Mock portfolio equity is zero or negative.' FROM run_logs WHERE coalesce(equity, 0) <= 0"""


@register("h01_success_rules_over_all_runs", ALERT, SUCCESS_SQL, (a.RUN_LOGS,))
def _(spark, d):
    return health.success_alerts(a.run_logs(spark, d))


@register("h02_failed_runs", ALERT, """
SELECT run_id || ':pipeline_failed' AS alert_key, run_id, 'critical' AS severity, 'pipeline_failed' AS alert_type,
  'Local pipeline failed: ' || error_message AS message FROM run_logs WHERE status = 'failed'""", (a.RUN_LOGS,))
def _(spark, d):
    return health.failure_alerts(a.run_logs(spark, d))


@register("h03_a18_stale_runs", ALERT + " latest_finished_at_utc:t", """
SELECT 'global:pipeline_stale' AS alert_key, CAST(NULL AS VARCHAR) AS run_id, 'critical' AS severity, 'pipeline_stale' AS alert_type,
  'Latest successful run is ' || printf('%.1f', (epoch_us(TIMESTAMP '2024-02-02') - epoch_us(t)) / 3.6e9) || ' hours old; threshold is 3.0 hours.' AS message,
  t AS latest_finished_at_utc FROM (SELECT max(finished_at_utc) AS t FROM run_logs WHERE status = 'success')""", (a.RUN_LOGS,))
def _(spark, d):
    runs = a.run_logs(spark, d)
    alert = health.staleness_alerts(runs, F.lit("2024-02-02 00:00:00").cast("timestamp"))
    return alert.withColumn("latest_finished_at_utc", health.latest_success(runs).scalar())


@register("h04_s19_refresh_alerts", ALERT + " status", f"""
WITH old AS (SELECT run_id || ':low_insight_coverage' AS alert_key, run_id, 'warning' AS severity, 'low_insight_coverage' AS alert_type,
    'old text' AS message FROM run_logs WHERE started_at_utc < TIMESTAMP '2024-01-10'
  UNION ALL SELECT run_id || ':custom', run_id, 'warning', 'custom', 'kept' FROM run_logs WHERE status = 'failed'),
fresh AS ({SUCCESS_SQL})
SELECT coalesce(f.alert_key, o.alert_key) AS alert_key, coalesce(f.run_id, o.run_id) AS run_id, coalesce(f.severity, o.severity) AS severity,
  coalesce(f.alert_type, o.alert_type) AS alert_type, coalesce(f.message, o.message) AS message,
  CASE WHEN f.alert_key IS NULL AND o.alert_type <> 'custom' THEN 'resolved' ELSE 'open' END AS status
FROM old o FULL JOIN fresh f ON f.alert_key = o.alert_key""", (a.RUN_LOGS,))
def _(spark, d):
    runs = a.run_logs(spark, d)
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp")

    def stored(rows, kind, text):
        return rows.select(F.concat("run_id", F.lit(f":{kind}")).alias("alert_key"), "run_id", F.lit("warning").alias("severity"),
                           F.lit(kind).alias("alert_type"), F.lit(text).alias("message"), F.lit("{}").alias("details_json"),
                           stamp.alias("detected_at_utc"), F.lit("open").alias("status"))

    early = runs.where(F.col("started_at_utc") < F.lit("2024-01-10").cast("timestamp"))
    old = stored(early, "low_insight_coverage", "old text").union(stored(runs.where("status = 'failed'"), "custom", "kept"))
    return health.refresh_alerts(old, health.success_alerts(runs), a.clock())


@register("p06_open_alerts", "alert_key", """
SELECT run_id AS alert_key FROM run_logs WHERE status = 'success'""", (a.RUN_LOGS,))
def _(spark, d):
    rows = a.run_logs(spark, d).select(F.col("run_id").alias("alert_key"), F.when(F.col("status") == "success", "OPEN").alias("status"))
    return health.open_alerts(rows)


@register("h05_health_alert_lines", "alert_key line", f"""
SELECT alert_key, '- ' || upper(severity) || ' ' || alert_type || ': ' || message AS line FROM ({SUCCESS_SQL})""", (a.RUN_LOGS,))
def _(spark, d):
    return health.alert_lines(health.success_alerts(a.run_logs(spark, d)))


@register("s24_run_log_counters", "run_id status ticker_count:i raw_headlines_collected:i scored_headlines:i insights_generated:i trades_executed:i", """
SELECT run_id, status, 5 AS ticker_count, raw AS raw_headlines_collected, scored_n AS scored_headlines, made AS insights_generated,
  executed AS trades_executed FROM run_logs""", (a.RUN_LOGS,))
def _(spark, d):
    return tables.run_log_rows(a.run_logs(spark, d))


@register("h06_null_rules", "table column violations:i", """
SELECT 'run_logs' AS "table", 'run_id' AS "column", count(*) FILTER (run_id IS NULL) AS violations FROM run_logs
UNION ALL SELECT 'run_logs', 'finished_at_utc', count(*) FILTER (finished_at_utc IS NULL) FROM run_logs
UNION ALL SELECT 'run_logs', 'error_message', count(*) FILTER (error_message IS NULL) FROM run_logs""", (a.RUN_LOGS,))
def _(spark, d):
    return tables.null_violations(a.run_logs(spark, d), "run_logs", ["run_id", "finished_at_utc", "error_message"])


@register("h07_duplicate_keys", "ticker quote_date:d copies:i",
          "SELECT ticker, quote_date, count(*) AS copies FROM provider_quotes GROUP BY 1, 2 HAVING count(*) > 1", (a.QUOTES,))
def _(spark, d):
    return tables.duplicate_keys(a.provider_quotes(spark, d), ["ticker", "quote_date"])


@register("h08_j19_orphan_references", "ticker n:i", """
SELECT ticker, count(*) AS n FROM scored WHERE ticker NOT IN (SELECT 'T' || c_custkey FROM customer WHERE c_nationkey < 12) GROUP BY 1""", (a.SCORED,))
def _(spark, d):
    parents = a.table(spark, d, "customer").where("c_nationkey < 12").select(
        F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("name"))
    return tables.orphans(a.scored(spark, d), "ticker", parents, "name").groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


