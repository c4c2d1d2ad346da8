"""Portfolio sizing for every run on one trading day."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from checks import adapters as a
from checks.q_prices import ANSWERS, RESOLVE
from checks.registry import register
from newsgauge.options import PortfolioOptions
from newsgauge.plans import insights, portfolio
from newsgauge.session import staged

DAY = dt.date.fromisoformat(a.TRADE_DAY)
OPTS = PortfolioOptions(max_positions=40)

STATE = (a.QUOTES, a.PART_INSIGHTS, a.RUNS, a.TRADES, a.POSITIONS, f"""latest AS (
  SELECT * FROM part_insights WHERE insight_date <= DATE '{DAY}'
  QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY insight_date DESC, signal_score DESC) = 1)""",
         f"lookups AS (SELECT ticker, DATE '{DAY}' AS as_of FROM latest UNION SELECT ticker, DATE '{DAY}' FROM positions)",
         ANSWERS, """real_quotes AS (SELECT ticker, close_price_usd * 1.37 AS price_cad FROM answers WHERE data_source <> 'synthetic')""")

MARKED = """marked AS (
  SELECT p.run_name, p.ticker, p.quantity, p.avg_cost_cad, coalesce(q.price_cad, p.last_price_cad) AS last_price_cad,
    coalesce(p.quantity * q.price_cad, p.market_value_cad) AS market_value_cad,
    coalesce(p.quantity * q.price_cad - p.quantity * p.avg_cost_cad, p.unrealized_pnl_cad) AS unrealized_pnl_cad
  FROM positions p LEFT JOIN real_quotes q USING (ticker) WHERE p.quantity > 1e-9)"""
SELLS = """sells AS (
  SELECT m.run_name, CAST(NULL AS BIGINT) AS insight_id, m.ticker, 'sell' AS side, m.quantity, q.price_cad, m.quantity * q.price_cad AS gross_cad,
    'Liquidated after negative insight signal.' AS reason
  FROM marked m JOIN real_quotes q USING (ticker) WHERE m.ticker IN (SELECT ticker FROM latest WHERE signal_label = 'negative'))"""
TARGETS = f"""targets AS (
  SELECT ticker, place AS rank, raw / sum(raw) OVER () AS weight, insight_id, rationale AS reason FROM (
    SELECT *, greatest(opportunity_score * confidence
        * CASE coalesce(recommendation, 'buy') WHEN 'strong_buy' THEN 1.35 WHEN 'buy' THEN 1.0 WHEN 'watch' THEN 0.45 ELSE 0.25 END, 0.01) AS raw
    FROM (SELECT *, row_number() OVER (ORDER BY opportunity_score DESC, signal_score DESC, confidence DESC, ticker) AS place FROM latest
      WHERE signal_label = 'positive' AND signal_score >= 0.12
        AND coalesce(recommendation, 'buy') IN ('strong_buy', 'buy', 'watch') AND coalesce(risk_score, 0) <= 0.65)
    WHERE place <= {OPTS.max_positions}))"""
BUYS = """kept AS (SELECT m.* FROM marked m ANTI JOIN sells s ON s.run_name = m.run_name AND s.ticker = m.ticker),
funds AS (
  SELECT r.run_name, r.cash_cad + coalesce(s.sold, 0) AS cash_cad, (r.cash_cad + coalesce(s.sold, 0) + coalesce(k.held, 0)) * 0.95 AS investable_cad
  FROM runs r LEFT JOIN (SELECT run_name, sum(gross_cad) AS sold FROM sells GROUP BY 1) s USING (run_name)
  LEFT JOIN (SELECT run_name, sum(market_value_cad) AS held FROM kept GROUP BY 1) k USING (run_name)),
wants AS (
  SELECT f.run_name, f.cash_cad, t.*, q.price_cad, greatest(f.investable_cad * t.weight - coalesce(k.market_value_cad, 0), 0) AS want
  FROM funds f CROSS JOIN targets t JOIN real_quotes q ON q.ticker = t.ticker
  LEFT JOIN kept k ON k.run_name = f.run_name AND k.ticker = t.ticker),
steps AS (SELECT *, row_number() OVER (PARTITION BY run_name ORDER BY rank) AS step FROM wants),
walk AS (
  SELECT run_name, 0 AS step, cash_cad AS cash, 0.0::DOUBLE AS amount, CAST(NULL AS VARCHAR) AS ticker, CAST(NULL AS DOUBLE) AS price_cad,
    CAST(NULL AS BIGINT) AS insight_id, CAST(NULL AS VARCHAR) AS reason FROM funds
  UNION ALL
  SELECT w.run_name, s.step::INTEGER, CASE WHEN least(s.want, w.cash) < 25 THEN w.cash ELSE w.cash - least(s.want, w.cash) END,
    CASE WHEN least(s.want, w.cash) < 25 THEN 0.0 ELSE least(s.want, w.cash) END, s.ticker, s.price_cad, s.insight_id, s.reason
  FROM walk w JOIN steps s ON s.run_name = w.run_name AND s.step = w.step + 1),
buys AS (SELECT run_name, insight_id, ticker, 'buy' AS side, amount / price_cad AS quantity, price_cad, amount AS gross_cad, reason
  FROM walk WHERE amount > 0)"""
AFTER = """holdings AS (
  SELECT *, quantity * last_price_cad AS market_value_cad, quantity * last_price_cad - quantity * avg_cost_cad AS unrealized_pnl_cad FROM (
    SELECT coalesce(k.run_name, b.run_name) AS run_name, coalesce(k.ticker, b.ticker) AS ticker,
      coalesce(k.quantity, 0) + coalesce(b.quantity, 0) AS quantity,
      (coalesce(k.quantity * k.avg_cost_cad, 0) + coalesce(b.gross_cad, 0)) / (coalesce(k.quantity, 0) + coalesce(b.quantity, 0)) AS avg_cost_cad,
      coalesce(b.price_cad, k.last_price_cad) AS last_price_cad
    FROM kept k FULL JOIN buys b ON k.run_name = b.run_name AND k.ticker = b.ticker)),
end_cash AS (SELECT run_name, f.cash_cad - coalesce(b.spent, 0) AS cash_cad FROM funds f
  LEFT JOIN (SELECT run_name, sum(gross_cad) AS spent FROM buys GROUP BY 1) b USING (run_name))"""

TRADE = "run_name ticker side quantity:m price_cad:m gross_cad:m reason insight_id:i"
HOLDING = "run_name ticker quantity:m avg_cost_cad:m last_price_cad:m market_value_cad:m unrealized_pnl_cad:m"


def state(spark, d, stage=lambda df: df):
    """Runs, holdings, latest insights and quotes of the day."""
    known = stage(insights.latest_insight_per_ticker(a.part_insights(spark, d).where(F.col("insight_date") <= F.lit(DAY))))
    held = stage(a.positions(spark, d))
    asked = known.select("ticker").union(held.select("ticker")).distinct().withColumn("as_of", F.lit(DAY))
    return a.runs(spark, d), held, known, stage(RESOLVE(asked, a.provider_quotes(spark, d)).drop("as_of"))


def step(spark, d):
    return portfolio.rebalance(*state(spark, d, staged), DAY, OPTS)


@register("b01_j14_mark_to_market", HOLDING, "SELECT * FROM marked", STATE + (MARKED,))
def _(spark, d):
    _, held, _, quotes = state(spark, d)
    return portfolio.mark_to_market(held, quotes)


@register("b02_j15_sell_orders", TRADE, "SELECT * FROM sells", STATE + (MARKED, SELLS))
def _(spark, d):
    _, held, known, quotes = state(spark, d)
    return portfolio.sell_orders(portfolio.mark_to_market(held, quotes), known, quotes)


@register("b03_t01_w12_p13_target_allocation", "ticker rank:i weight:f insight_id:i reason", "SELECT * FROM targets", STATE + (TARGETS,))
def _(spark, d):
    return portfolio.target_allocation(state(spark, d)[2], OPTS)


@register("b04_w13_buy_and_sell_orders_of_a_day", TRADE, "SELECT * FROM sells UNION ALL SELECT * FROM buys",
          STATE + (MARKED, SELLS, TARGETS, BUYS))
def _(spark, d):
    return step(spark, d)["trades"]


@register("b05_positions_after_orders", HOLDING, "SELECT * FROM holdings", STATE + (MARKED, SELLS, TARGETS, BUYS, AFTER))
def _(spark, d):
    return step(spark, d)["positions"]


@register("b06_a17_a15_u05_portfolio_snapshots",
          "run_name snapshot_date:d cash_cad:m positions_value_cad:m total_equity_cad:m cumulative_return_pct:f data_source", f"""
SELECT c.run_name, DATE '{DAY}' AS snapshot_date, c.cash_cad, coalesce(h.value, 0) AS positions_value_cad,
  c.cash_cad + coalesce(h.value, 0) AS total_equity_cad, (c.cash_cad + coalesce(h.value, 0) - 50000.0) / 50000.0 * 100 AS cumulative_return_pct,
  (SELECT string_agg(DISTINCT s, ',' ORDER BY s) FROM (
     SELECT x.data_source AS s FROM answers x JOIN latest i ON i.ticker = x.ticker
     UNION SELECT x.data_source FROM answers x JOIN positions p ON p.ticker = x.ticker WHERE p.run_name = c.run_name)) AS data_source
FROM end_cash c LEFT JOIN (SELECT run_name, sum(market_value_cad) AS value FROM holdings GROUP BY 1) h USING (run_name)""",
          STATE + (MARKED, SELLS, TARGETS, BUYS, AFTER))
def _(spark, d):
    return step(spark, d)["snapshots"]


@register("p13_buy_candidates", "ticker signal_score:f risk_score:f recommendation", """
SELECT * FROM latest WHERE signal_label = 'positive' AND signal_score >= 0.12
  AND coalesce(recommendation, 'buy') IN ('strong_buy', 'buy', 'watch') AND coalesce(risk_score, 0) <= 0.65""", STATE)
def _(spark, d):
    return portfolio.buy_candidates(state(spark, d)[2])


@register("w12_allocation_per_insight_day", "insight_date:d ticker rank:i weight:f", """
SELECT insight_date, ticker, place AS rank, raw / sum(raw) OVER (PARTITION BY insight_date) AS weight FROM (
  SELECT *, greatest(opportunity_score * confidence
      * CASE coalesce(recommendation, 'buy') WHEN 'strong_buy' THEN 1.35 WHEN 'buy' THEN 1.0 WHEN 'watch' THEN 0.45 ELSE 0.25 END, 0.01) AS raw,
    row_number() OVER (PARTITION BY insight_date ORDER BY opportunity_score DESC, signal_score DESC, confidence DESC, ticker) AS place
  FROM part_insights WHERE signal_label = 'positive' AND coalesce(recommendation, 'buy') IN ('strong_buy', 'buy', 'watch')
    AND signal_score >= 0.12 AND coalesce(risk_score, 0) <= 0.65) WHERE place <= 5""", (a.PART_INSIGHTS,))
def _(spark, d):
    return portfolio.target_allocation(a.part_insights(spark, d), PortfolioOptions(), ["insight_date"])


@register("a15_combined_sources_per_ticker", "ticker data_source", """
SELECT ticker, string_agg(DISTINCT data_source, ',' ORDER BY data_source) AS data_source FROM provider_quotes GROUP BY 1""", (a.QUOTES,))
def _(spark, d):
    return portfolio.combined_sources(a.provider_quotes(spark, d), ["ticker"])


@register("s05_positions_of_a_run", HOLDING, "SELECT * FROM positions WHERE run_name = 'C7'", (a.TRADES, a.POSITIONS))
def _(spark, d):
    return a.positions(spark, d).where(F.col("run_name") == "C7")
