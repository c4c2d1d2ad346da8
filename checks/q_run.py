"""Two runs over stored tables, ten days apart, and what each table holds after them."""

from __future__ import annotations

import datetime as dt
from functools import lru_cache, partial

from pyspark.sql import functions as F

from checks import adapters as a
from checks.q_insights import INSIGHTS, NO_EXTERNAL, SELECT, SPEC, _with_hash_text
from checks.q_prices import AS_OF, EVALUATIONS, PROVIDERS
from checks.q_sources import _fresh
from checks.registry import register
from newsgauge.operators import asof
from newsgauge.options import HealthOptions, PortfolioOptions
from newsgauge.plans import run
from newsgauge.sources.tables import Tables

FIRST, SECOND = (dt.datetime(2024, 1, day, tzinfo=dt.timezone.utc) for day in (20, 31))
RULES = HealthOptions(min_headlines=600, min_insights=1)
TRADING = PortfolioOptions(starting_cash_cad=5000.0, max_positions=5)
RAW = ["ticker", "headline", "source", "url", "published_at_utc", "summary", "category", "topic", "industry"]

# The headlines in each run's look-back, of those loaded by then.
FRAMES = """frames AS (
  SELECT DATE '2024-01-20' AS insight_date, * FROM scored WHERE published_at_utc >= TIMESTAMP '2024-01-17' AND published_at_utc < TIMESTAMP '2024-01-20'
  UNION ALL SELECT DATE '2024-01-31', * FROM scored WHERE published_at_utc >= TIMESTAMP '2024-01-28')"""

# Quotes of the events' tickers: one a ticker, day and source; a third of the tickers have made-up prices only.
TICKER_QUOTES = """provider_quotes AS (
  SELECT 'T' || user_id AS ticker, CAST(ts AS DATE) AS quote_date, round(max(abs(value)) + 5, 4) AS close_price_usd,
    CASE user_id % 3 WHEN 0 THEN 'polygon' WHEN 1 THEN 'yahoo_chart' ELSE 'synthetic' END AS data_source FROM events GROUP BY ALL)"""


def ticker_quotes(spark, d):
    e = a.table(spark, d, "events")
    source = F.when(F.col("user_id") % 3 == 0, "polygon").when(F.col("user_id") % 3 == 1, "yahoo_chart").otherwise("synthetic")
    return e.groupBy(F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("ticker"), F.col("ts").cast("date").alias("quote_date"),
                     source.alias("data_source")).agg(F.round(F.max(F.abs("value")) + 5, 4).alias("close_price_usd"))


RESOLVE = partial(asof.resolve_quotes, provider_order=PROVIDERS, synthetic_only=("T7", "T10"))


@lru_cache(maxsize=1)
def _filled(spark, d):
    """The tables after both runs; every query of this module reads them."""
    store = Tables(spark, _fresh(spark, "runs"))
    rows = a.scored(spark, d)
    values = rows.select("content_hash", *[c for c in rows.columns if c not in [*RAW, "event_id", "content_hash"]])
    accounts = spark.createDataFrame([("fund", 5000.0)], "run_name string, starting_cash_cad double")
    early = rows.where("published_at_utc < '2024-01-20'").select(*RAW)
    counts = [run.run_over_tables(store, name, raw, ticker_quotes(spark, d), as_of, accounts, resolve=RESOLVE, rules=RULES, trading=TRADING,
                                  score=lambda normal: normal.join(values, "content_hash"))
              for name, raw, as_of in (("first", early.union(early), FIRST), ("second", rows.select(*RAW), SECOND))]
    return store, counts


@register("run_over_tables_insights", SPEC, SELECT, (a.SCORED, FRAMES, NO_EXTERNAL, INSIGHTS))
def _(spark, d):
    return _with_hash_text(_filled(spark, d)[0].read("insights"))


def _evaluated(as_of: str, insights: str, tag: str) -> str:
    """The evaluation CTEs for some insights as of some day, under names of their own."""
    text = EVALUATIONS.replace(f"DATE '{AS_OF}'", f"DATE '{as_of}'").replace("'P7', 'P11'", "'T7', 'T10'").replace("part_insights", insights)
    for name in ("judged", "lookups", "asked", "first_quotes", "second_quotes", "newest", "answers", "evaluations"):
        text = text.replace(f"{name} AS ", f"{name}_{tag} AS ").replace(f"FROM {name}", f"FROM {name}_{tag}").replace(f"JOIN {name} ", f"JOIN {name}_{tag} ")
    return text


STORED = """stored AS (SELECT 0 AS insight_id, ticker, insight_date, signal_label, recommendation, round(signal_score, 6) AS signal_score, 5 AS horizon_days FROM insights),
early_stored AS (SELECT * FROM stored WHERE insight_date = DATE '2024-01-20')"""
RUN_CTES = (a.SCORED, FRAMES, NO_EXTERNAL, INSIGHTS, STORED, TICKER_QUOTES, _evaluated("2024-01-20", "early_stored", "1"), _evaluated("2024-01-31", "stored", "2"))
EVAL_SPEC = ("ticker insight_date:d evaluation_date:d signal_label recommendation signal_score:f entry_quote_date:d current_quote_date:d "
             "entry_price_usd:f current_price_usd:f forward_return_pct:f direction_correct:i is_real_market_data:i evaluation_status data_source run:d")


@register("run_over_tables_evaluations", EVAL_SPEC, """
SELECT *, DATE '2024-01-20' AS run FROM evaluations_1 UNION ALL SELECT *, DATE '2024-01-31' FROM evaluations_2""", RUN_CTES)
def _(spark, d):
    return _filled(spark, d)[0].read("insight_evaluations").withColumn("run", F.col("evaluated_at_utc").cast("date"))


@register("run_over_tables_quotes", "ticker quote_date:d close_price_usd:f data_source", """
SELECT DISTINCT ticker, quote_date, close_price_usd, data_source FROM (SELECT * FROM answers_1 UNION ALL SELECT * FROM answers_2
  UNION ALL SELECT * FROM bought) WHERE data_source <> 'synthetic'""", (*RUN_CTES, """bought AS (
  SELECT p.ticker, DATE '2024-01-31' AS as_of, q.quote_date, q.close_price_usd, q.data_source
  FROM (SELECT DISTINCT ticker FROM stored) p JOIN provider_quotes q ON q.ticker = p.ticker AND q.data_source <> 'synthetic'
    AND q.quote_date <= DATE '2024-01-31' AND q.quote_date >= DATE '2024-01-31' - 45 AND p.ticker NOT IN ('T7', 'T10')
  QUALIFY row_number() OVER (PARTITION BY p.ticker ORDER BY q.quote_date DESC) = 1)"""))
def _(spark, d):
    return _filled(spark, d)[0].read("price_quotes")


COUNTED = """counted AS (
  SELECT 'first' AS run_id, (SELECT 2 * count(*) FROM scored WHERE published_at_utc < TIMESTAMP '2024-01-20') AS raw,
    (SELECT count(*) FROM scored WHERE published_at_utc < TIMESTAMP '2024-01-20') AS new,
    (SELECT count(*) FROM early_stored) AS insights, (SELECT count(*) FROM evaluations_1) AS evaluations,
    (SELECT count(*) FROM evaluations_1 WHERE is_real_market_data = 0) AS made_up
  UNION ALL SELECT 'second', (SELECT count(*) FROM scored), (SELECT count(*) FROM scored WHERE published_at_utc >= TIMESTAMP '2024-01-20'),
    (SELECT count(*) FROM stored WHERE insight_date = DATE '2024-01-31'), (SELECT count(*) FROM evaluations_2),
    (SELECT count(*) FROM evaluations_2 WHERE is_real_market_data = 0))"""


@register("run_over_tables_log", "run_id status raw_headlines_collected:i scored_headlines:i insights_generated:i evaluations:i made_up:i", """
SELECT run_id, 'success' AS status, raw AS raw_headlines_collected, new AS scored_headlines, insights AS insights_generated, evaluations, made_up FROM counted""",
          (*RUN_CTES, COUNTED))
def _(spark, d):
    return _filled(spark, d)[0].read("run_logs").withColumns({
        "evaluations": F.get_json_object("summary_json", "$.evaluation.evaluations_saved").cast("int"),
        "made_up": F.get_json_object("summary_json", "$.evaluation.synthetic_evaluations").cast("int")})


@register("run_over_tables_alerts", "alert_key severity status", """
SELECT run_id || ':low_headline_coverage' AS alert_key, 'warning' AS severity, CASE run_id WHEN 'first' THEN 'resolved' ELSE 'open' END AS status FROM counted WHERE raw < 600
UNION ALL SELECT run_id || ':high_synthetic_quote_usage', 'warning', CASE run_id WHEN 'first' THEN 'resolved' ELSE 'open' END FROM counted
WHERE evaluations > 0 AND made_up * 100.0 / evaluations > 35""", (*RUN_CTES, COUNTED))
def _(spark, d):
    return _filled(spark, d)[0].read("health_alerts")


@register("a20_counters_of_a_load", "run stage n:i", """
SELECT run_id AS run, unnest(['headlines_fetched', 'headlines_after_dedupe', 'raw_saved', 'scored_saved', 'insights_generated', 'evaluations_saved']) AS stage,
  unnest([raw, CASE run_id WHEN 'first' THEN new ELSE raw END, new, new, insights, evaluations]) AS n FROM counted""", (*RUN_CTES, COUNTED))
def _(spark, d):
    store, both = _filled(spark, d)
    first, second = (run.counters(store, counts).where("stage <> 'trades_executed'").withColumn("run", F.lit(name))
                     for name, counts in zip(("first", "second"), both, strict=True))
    return first.union(second)
