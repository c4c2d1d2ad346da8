"""Quotes as of a date, provider fallback, evaluation of insights."""

from __future__ import annotations

import datetime as dt
from functools import partial

from pyspark.sql import functions as F

from checks import adapters as a
from checks.registry import register
from newsgauge.functions import numbers
from newsgauge.operators import asof
from newsgauge.plans import evaluation, reports

PROVIDERS = ("polygon", "yahoo_chart")
RESOLVE = partial(asof.resolve_quotes, provider_order=PROVIDERS, synthetic_only=("P7", "P11"))
AS_OF = dt.date(2001, 6, 30)

_SPLIT = "134217729.0"


def exact_round_sql(x: str, digits: int) -> str:
    """The value times 10^digits with its exact rounding error, so that halves are decided right."""
    s = f"{10 ** digits}.0::DOUBLE"
    return f"""(SELECT CASE WHEN r - lo > 0.5 THEN lo + 1 WHEN r - lo < 0.5 THEN lo
      WHEN e > 0 OR (e = 0 AND lo % 2 <> 0) THEN lo + 1 ELSE lo END / {s}
    FROM (SELECT r, floor(r) AS lo, (h * {s} - r) + (v - h) * {s} AS e
      FROM (SELECT v, v * {s} AS r, v * {_SPLIT}::DOUBLE - (v * {_SPLIT}::DOUBLE - v) AS h FROM (SELECT {x} AS v))))"""


def synthetic_sql(ticker: str, day: str) -> str:
    digest = f"sha256({ticker} || ':' || strftime({day}, '%Y-%m-%d'))"
    return exact_round_sql(
        f"""greatest(5.0::DOUBLE, (40 + CAST('0x' || substr({digest}, 1, 6) AS BIGINT) % 360)
          * (1.0::DOUBLE + ((CAST('0x' || substr({digest}, 7, 4) AS BIGINT) % 900) - 450) / 1000.0::DOUBLE / 10.0::DOUBLE))""", 2)


# answers(ticker, as_of, quote_date, close_price_usd, data_source) for the CTE lookups(ticker, as_of): the newest quote of
# each provider by an as-of join, the first provider whose quote is not too old, else the made-up price.
ANSWERS = f"""asked AS MATERIALIZED (SELECT DISTINCT ticker, as_of FROM lookups),
first_quotes AS MATERIALIZED (SELECT * FROM provider_quotes WHERE data_source = 'polygon' AND ticker NOT IN ('P7', 'P11')),
second_quotes AS MATERIALIZED (SELECT * FROM provider_quotes WHERE data_source = 'yahoo_chart' AND ticker NOT IN ('P7', 'P11')),
newest AS MATERIALIZED (
  SELECT k.ticker, k.as_of, CASE WHEN p.quote_date >= k.as_of - 45 THEN p.quote_date END AS day1, p.close_price_usd AS price1,
    CASE WHEN y.quote_date >= k.as_of - 45 THEN y.quote_date END AS day2, y.close_price_usd AS price2
  FROM asked k ASOF LEFT JOIN first_quotes p ON p.ticker = k.ticker AND p.quote_date <= k.as_of
    ASOF LEFT JOIN second_quotes y ON y.ticker = k.ticker AND y.quote_date <= k.as_of),
answers AS MATERIALIZED (
  SELECT ticker, as_of, coalesce(day1, day2, as_of) AS quote_date,
    CASE WHEN day1 IS NOT NULL THEN price1 WHEN day2 IS NOT NULL THEN price2 ELSE {synthetic_sql('ticker', 'as_of')} END AS close_price_usd,
    CASE WHEN day1 IS NOT NULL THEN 'polygon' WHEN day2 IS NOT NULL THEN 'yahoo_chart' ELSE 'synthetic' END AS data_source
  FROM newest)"""

ORDER_LOOKUPS = """lookups AS (
  SELECT DISTINCT 'P' || l_partkey AS ticker, CAST(o_orderdate AS DATE) AS as_of FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def order_lookups(spark, d):
    l, o = a.table(spark, d, "lineitem"), a.table(spark, d, "orders")
    return l.join(o, l.l_orderkey == o.o_orderkey).select(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("ticker"), F.col("o_orderdate").cast("date").alias("as_of"))


@register("j10_asof_quote_fourteen_days_real_only", "ticker as_of:d quote_date:d close_price_usd:f data_source", """
SELECT k.ticker, k.as_of, q.quote_date, q.close_price_usd, q.data_source FROM lookups k
LEFT JOIN LATERAL (SELECT * FROM quotes q WHERE q.ticker = k.ticker AND q.data_source <> 'synthetic'
    AND q.quote_date BETWEEN k.as_of - 14 AND k.as_of ORDER BY q.quote_date DESC LIMIT 1) q ON TRUE""",
          (a.QUOTES, ORDER_LOOKUPS))
def _(spark, d):
    return asof.asof_quotes(order_lookups(spark, d), a.quotes(spark, d))


@register("j12_provider_fallback_chain", "ticker as_of:d quote_date:d close_price_usd:f data_source",
          "SELECT * FROM answers", (a.QUOTES, ORDER_LOOKUPS, ANSWERS))
def _(spark, d):
    asked = order_lookups(spark, d).withColumn("ticker", F.when(F.dayofmonth("as_of") % 2 == 0, F.lower("ticker")).otherwise(F.col("ticker")))
    return RESOLVE(asked, a.provider_quotes(spark, d)).withColumn("ticker", F.upper("ticker"))


@register("j12_cached_quotes_before_synthetic", "ticker as_of:d quote_date:d close_price_usd:f data_source", f"""
SELECT k.ticker, k.as_of, coalesce(q.quote_date, k.as_of) AS quote_date,
  coalesce(q.close_price_usd, {synthetic_sql('k.ticker', 'k.as_of')}) AS close_price_usd, coalesce(q.data_source, 'synthetic') AS data_source
FROM lookups k LEFT JOIN LATERAL (SELECT * FROM quotes q WHERE q.ticker = k.ticker AND q.data_source <> 'synthetic'
    AND q.quote_date BETWEEN k.as_of - 30 AND k.as_of ORDER BY q.quote_date DESC LIMIT 1) q ON TRUE""",
          (a.QUOTES, ORDER_LOOKUPS))
def _(spark, d):
    stored = a.quotes(spark, d)
    return asof.resolve_quotes(order_lookups(spark, d), stored, provider_order=(), cached_quotes=stored,
                               max_age_days=30, synthetic_only=())


@register("c20_synthetic_prices", "ticker as_of:d price:f",
          f"SELECT ticker, as_of, {synthetic_sql('ticker', 'as_of')} AS price FROM lookups", (ORDER_LOOKUPS,))
def _(spark, d):
    keys = order_lookups(spark, d).distinct()
    return keys.withColumn("price", numbers.synthetic_price(F.col("ticker"), F.col("as_of")))


@register("w08_latest_quote_per_ticker", "ticker quote_date:d close_price_usd:f data_source",
          "SELECT * FROM quotes QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY quote_date DESC) = 1", (a.QUOTES,))
def _(spark, d):
    return asof.latest_quote_per_ticker(a.quotes(spark, d))


BEST = """live AS (SELECT ticker, quote_date, CASE WHEN order_key % 6 <> 0 THEN close_price_usd END AS close_price_usd, data_source
  FROM quotes WHERE quote_date >= DATE '2000-01-01'),
cached AS (SELECT * FROM quotes WHERE quote_date < DATE '2000-01-01'),
best AS (SELECT * FROM (SELECT ticker, quote_date, close_price_usd, data_source FROM live
    UNION ALL SELECT ticker, quote_date, close_price_usd, data_source FROM cached)
  QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY close_price_usd IS NULL, data_source = 'synthetic', quote_date DESC) = 1)"""


def _live_and_cached(spark, d):
    both = a.quotes(spark, d)
    recent = F.col("quote_date") >= F.lit(dt.date(2000, 1, 1))
    live = both.where(recent).withColumn("close_price_usd", F.when(F.col("order_key") % 6 != 0, F.col("close_price_usd")))
    return live, both.where(~recent)


@register("w09_u02_best_quote_per_ticker", "ticker quote_date:d close_price_usd:f data_source", "SELECT * FROM best", (a.QUOTES, BEST))
def _(spark, d):
    return asof.best_quote_per_ticker(*_live_and_cached(spark, d))


@register("j02_j05_watchlist_prices", "ticker company sector close_price_usd:f quote_date:d data_source", """
SELECT t.ticker, coalesce(n.company, t.ticker) AS company, n.sector, b.close_price_usd, b.quote_date, b.data_source
FROM (SELECT 'P' || p_partkey AS ticker FROM part UNION ALL SELECT 'X' || s_suppkey FROM supplier) t
LEFT JOIN (SELECT 'P' || p_partkey AS ticker, p_name AS company, p_brand AS sector FROM part WHERE p_size > 10) n USING (ticker)
LEFT JOIN best b USING (ticker)""", (a.QUOTES, BEST))
def _(spark, d):
    live, cached = _live_and_cached(spark, d)
    part = a.table(spark, d, "part")
    name = F.concat(F.lit("P"), F.col("p_partkey").cast("string"))
    known = part.where("p_size > 10").select(name.alias("ticker"), F.col("p_name").alias("company"), F.col("p_brand").alias("sector"))
    listed = part.select(F.concat(F.lit(" p"), F.col("p_partkey").cast("string")).alias("ticker")).union(
        a.table(spark, d, "supplier").select(F.concat(F.lit("X"), F.col("s_suppkey").cast("string"))))
    return reports.watchlist_prices(listed, cached, live, known, known)


EVALUATIONS = f"""judged AS MATERIALIZED (
  SELECT *, coalesce(horizon_days, 5) AS horizon, least(DATE '{AS_OF}', insight_date + coalesce(horizon_days, 5)) AS evaluation_date
  FROM part_insights),
lookups AS (SELECT ticker, insight_date AS as_of FROM judged WHERE evaluation_date >= insight_date
  UNION SELECT ticker, evaluation_date FROM judged WHERE evaluation_date >= insight_date),
{ANSWERS},
evaluations AS MATERIALIZED (
  SELECT *, round(move, 6) AS forward_return_pct,
    CAST(CASE signal_label WHEN 'positive' THEN move > 0 WHEN 'negative' THEN move < 0 ELSE abs(move) <= 1.0 END AS INTEGER) AS direction_correct
  FROM (SELECT j.insight_id, j.ticker, j.insight_date, j.evaluation_date, j.signal_label, j.recommendation, j.signal_score,
      j.horizon AS horizon_days, e.quote_date AS entry_quote_date, c.quote_date AS current_quote_date,
      e.close_price_usd AS entry_price_usd, c.close_price_usd AS current_price_usd,
      (c.close_price_usd - e.close_price_usd) / nullif(e.close_price_usd, 0) * 100 AS move,
      CAST(e.data_source <> 'synthetic' AND c.data_source <> 'synthetic' AS INTEGER) AS is_real_market_data,
      CASE WHEN DATE '{AS_OF}' >= j.insight_date + j.horizon THEN 'matured' ELSE 'marked' END AS evaluation_status,
      CASE WHEN e.data_source = c.data_source THEN e.data_source
        ELSE least(e.data_source, c.data_source) || ',' || greatest(e.data_source, c.data_source) END AS data_source
    FROM judged j JOIN answers e ON e.ticker = j.ticker AND e.as_of = j.insight_date
      JOIN answers c ON c.ticker = j.ticker AND c.as_of = j.evaluation_date
    WHERE j.evaluation_date >= j.insight_date))"""
EVAL_CTES = (a.QUOTES, a.PART_INSIGHTS, EVALUATIONS)


def evaluations(spark, d):
    return evaluation.evaluate_insights(a.part_insights(spark, d), a.provider_quotes(spark, d), AS_OF, RESOLVE)


@register("j11_p19_p20_c19_evaluate_insights",
          "insight_id:i ticker insight_date:d evaluation_date:d signal_label recommendation signal_score:f horizon_days:i "
          "entry_quote_date:d current_quote_date:d entry_price_usd:f current_price_usd:f forward_return_pct:f "
          "direction_correct:i is_real_market_data:i evaluation_status data_source", "SELECT * FROM evaluations", EVAL_CTES)
def _(spark, d):
    return evaluations(spark, d)


_SEGMENT = """count(*) AS evaluated_insights, sum(is_real_market_data) AS real_market_evaluations,
  count(*) FILTER (is_real_market_data = 0) AS synthetic_evaluations, avg(direction_correct) * 100 AS win_rate_pct,
  coalesce(avg(direction_correct) FILTER (is_real_market_data = 1) * 100, 0.0) AS real_win_rate_pct,
  avg(forward_return_pct) AS avg_forward_return_pct,
  coalesce(avg(forward_return_pct) FILTER (is_real_market_data = 1), 0.0) AS real_avg_forward_return_pct,
  median(forward_return_pct) AS median_forward_return_pct, max(forward_return_pct) AS best_forward_return_pct,
  min(forward_return_pct) AS worst_forward_return_pct, count(*) FILTER (evaluation_status = 'matured') AS matured_count
FROM evaluations"""


@register("a08_u03_performance_summary",
          "segment evaluated_insights:i real_market_evaluations:i synthetic_evaluations:i win_rate_pct:f real_win_rate_pct:f "
          "avg_forward_return_pct:a real_avg_forward_return_pct:a median_forward_return_pct:a best_forward_return_pct:f "
          "worst_forward_return_pct:f matured_count:i", f"""
SELECT 'overall' AS segment, {_SEGMENT}
UNION ALL SELECT 'signal:' || signal_label, {_SEGMENT} GROUP BY signal_label
UNION ALL SELECT 'recommendation:' || recommendation, {_SEGMENT} WHERE recommendation IS NOT NULL GROUP BY recommendation""", EVAL_CTES)
def _(spark, d):
    return evaluation.performance_summary(evaluations(spark, d))


@register("t10_first_segments_of_report", "segment evaluated_insights:i", f"""
SELECT * FROM (SELECT 0 AS g, 'overall' AS segment, {_SEGMENT}
  UNION ALL SELECT 1, 'signal:' || signal_label, {_SEGMENT} GROUP BY signal_label
  UNION ALL SELECT 2, 'recommendation:' || recommendation, {_SEGMENT} WHERE recommendation IS NOT NULL GROUP BY recommendation)
ORDER BY g, segment LIMIT 6""", EVAL_CTES)
def _(spark, d):
    return reports.segment_table(evaluations(spark, d), 6)


@register("a09_evaluation_run_summary",
          "evaluations_saved:i real_market_evaluations:i synthetic_evaluations:i directionally_correct:i win_rate_pct:f "
          "real_win_rate_pct:f average_forward_return_pct:a real_average_forward_return_pct:a", """
SELECT count(*) AS evaluations_saved, count(*) FILTER (is_real_market_data = 1) AS real_market_evaluations,
  count(*) FILTER (is_real_market_data = 0) AS synthetic_evaluations, sum(direction_correct) AS directionally_correct,
  round(avg(direction_correct) * 100, 4) AS win_rate_pct,
  round(avg(direction_correct) FILTER (is_real_market_data = 1) * 100, 4) AS real_win_rate_pct,
  avg(forward_return_pct) AS average_forward_return_pct,
  avg(forward_return_pct) FILTER (is_real_market_data = 1) AS real_average_forward_return_pct FROM evaluations""", EVAL_CTES)
def _(spark, d):
    return evaluation.run_summary(evaluations(spark, d))


@register("a10_evaluation_by_ticker",
          "ticker evaluated:f real_evaluated:f win_rate_pct:f real_win_rate_pct:f avg_forward_return_pct:a", """
SELECT ticker, count(*) AS evaluated, sum(is_real_market_data) AS real_evaluated, avg(direction_correct) * 100 AS win_rate_pct,
  coalesce(avg(direction_correct) FILTER (is_real_market_data = 1) * 100, 0.0) AS real_win_rate_pct,
  avg(forward_return_pct) AS avg_forward_return_pct FROM evaluations GROUP BY 1""", EVAL_CTES)
def _(spark, d):
    return evaluation.evaluation_by_ticker(evaluations(spark, d))


@register("a08_exact_median_of_prices", "l_returnflag median:f",
          "SELECT l_returnflag, median(l_extendedprice) AS median FROM lineitem GROUP BY 1")
def _(spark, d):
    from newsgauge.operators.median import exact_median

    return exact_median(a.table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice")


@register("p14_tradeable_quotes", "ticker quote_date:d data_source",
          "SELECT * FROM quotes WHERE data_source IS NOT NULL AND data_source <> 'synthetic'", (a.QUOTES,))
def _(spark, d):
    from newsgauge.plans.portfolio import tradeable

    return a.quotes(spark, d).where(tradeable(F.col("data_source")))
