"""Results whose order counts, with the place of each row; files that are read back; arguments that other checks leave out."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks import adapters as a
from checks.q_insights import INSIGHTS, NO_EXTERNAL, SELECT, SPEC, _with_hash_text
from checks.q_reports import customers
from checks.q_sources import CLOSE, _fresh
from checks.registry import register
from newsgauge.plans import insights, marts, reports, scoring
from newsgauge.sources import landing


def placed(ordered):
    """The rows of a sorted frame with their place: ids grow in the order in which the frame hands its rows out. An id is
    its partition and the place in it, so only the partitions' row counts are added up in one task. The frame is stored
    first: run again, its partitions could be cut elsewhere."""
    spark, folder = ordered.sparkSession, _fresh(ordered.sparkSession, "placed")
    numbered = ordered.withColumn("_id", F.monotonically_increasing_id())
    numbered.write.parquet(folder)
    stored = spark.read.schema(numbered.schema).parquet(folder).withColumn("_part", F.shiftright("_id", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    spot = F.col("_id") - F.shiftleft("_part", 33)
    return stored.join(F.broadcast(starts), "_part").withColumn("place", F.col("_start") + spot + 1).drop("_id", "_part", "_start")


@register("t03_default_tickers_in_order", "ticker place:i", """
SELECT ticker, row_number() OVER (ORDER BY tier, spot, ticker) AS place FROM (
  SELECT * FROM (SELECT ticker, 0 AS tier, -headline_count AS spot FROM daily WHERE sentiment_date = (SELECT max(sentiment_date) FROM daily)
    UNION ALL SELECT 'T' || c_custkey, 1, c_custkey FROM customer)
  QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY tier, spot) = 1) ORDER BY place LIMIT 12""", a.WAREHOUSE_CHAIN[:2])
def _(spark, d):
    known = a.table(spark, d, "customer").select(F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("ticker"),
                                                 F.col("c_custkey").alias("position"))
    return placed(reports.default_tickers(marts.daily_sentiment(a.scored(spark, d)), known))


@register("t04_insights_in_order", "ticker insight_date:d place:i", """
SELECT ticker, insight_date, row_number() OVER (ORDER BY insight_date DESC, signal_score DESC, ticker) AS place FROM part_insights
WHERE insight_date <= DATE '1999-06-30'""", (a.PART_INSIGHTS,))
def _(spark, d):
    return placed(insights.latest_insights(a.part_insights(spark, d), dt.date(1999, 6, 30)))


@register("u04_union_of_ticker_lists_in_order", "ticker place:i", """
SELECT ticker, row_number() OVER (ORDER BY list, spot, ticker) AS place FROM (
  SELECT ticker, min(list) AS list, arg_min(spot, (list, spot)) AS spot FROM (
    SELECT 'T' || c_custkey AS ticker, 0 AS list, c_custkey AS spot FROM customer UNION ALL SELECT DISTINCT ticker, 1, 0 FROM scored) GROUP BY ticker)""",
          (a.SCORED,))
def _(spark, d):
    return placed(reports.ordered_tickers(customers(spark, d), a.scored(spark, d).select("ticker")))


@register("t09_newest_runs_in_order", "run_id place:i",
          "SELECT run_id, row_number() OVER (ORDER BY started_at_utc DESC, run_id) AS place FROM run_logs", (a.RUN_LOGS,))
def _(spark, d):
    return placed(reports.newest_runs(a.run_logs(spark, d)))


@register("u08_first_arrival_by_content_hash", "event_id:i content_hash", "SELECT event_id, content_hash FROM scored", (a.SCORED,))
def _(spark, d):
    raw = ["event_id", "ticker", "headline", "source", "url", "published_at_utc", "summary", "category", "topic", "industry"]
    rows = a.scored(spark, d).select(*raw)
    later = rows.withColumn("event_id", F.col("event_id") + 1_000_000_000)
    return scoring.dedupe_headlines(scoring.normalize_headlines(later.unionByName(rows)), [F.col("event_id")])


SOME_DAYS = """chosen AS (SELECT * FROM scored WHERE published_at_utc >= TIMESTAMP '2024-01-10' AND published_at_utc < TIMESTAMP '2024-01-21'
  AND ticker IN (SELECT 'T' || c_custkey FROM customer WHERE c_nationkey < 12)),
frames AS (
  SELECT r.insight_date, s.* FROM (SELECT DISTINCT CAST(published_at_utc AS DATE) AS insight_date FROM chosen) r
  JOIN chosen s ON s.published_at_utc >= r.insight_date - INTERVAL 3 DAY AND s.published_at_utc < r.insight_date + INTERVAL 1 DAY)"""


@register("p09_insights_of_some_days_and_tickers", SPEC, SELECT, (a.SCORED, SOME_DAYS, NO_EXTERNAL, INSIGHTS))
def _(spark, d):
    wanted = a.table(spark, d, "customer").where("c_nationkey < 12").select(F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("ticker"))
    return _with_hash_text(insights.insights_for_days(a.scored(spark, d), start=dt.date(2024, 1, 10), end=dt.date(2024, 1, 20), tickers=wanted))


@register("s13_quote_csv_files", CLOSE, """
SELECT 'L' || l_linenumber AS ticker, CAST(l_shipdate AS DATE) AS quote_date, round(l_extendedprice / 3, 3) AS close_price_usd, 'stooq' AS data_source FROM lineitem""")
def _(spark, d):
    """A folder a ticker, one bad line among each hundred or so."""
    folder = _fresh(spark, "csv")
    l = a.table(spark, d, "lineitem")
    rows = l.select(F.concat(F.lit("L"), F.col("l_linenumber").cast("string")).alias("ticker"), F.col("l_shipdate").cast("date").cast("string").alias("Date"),
                    F.lit("1").alias("Open"), F.round(F.col("l_extendedprice") / 3, 3).cast("string").alias("Close"))
    bad = rows.where("crc32(Close) % 100 = 0").withColumn("Close", F.lit("n/a"))
    rows.unionByName(bad).write.partitionBy("ticker").csv(folder, header=True)
    return landing.read_quote_csv(spark, folder)


@register("s14_ticker_files", "ticker", """
SELECT 'P' || p_partkey AS ticker FROM part UNION ALL SELECT upper(p_brand) FROM part WHERE p_size > 10""")
def _(spark, d):
    folder, part = _fresh(spark, "lists"), a.table(spark, d, "part")
    lines = part.select(F.explode(F.array(F.concat(F.lit("  p"), F.col("p_partkey").cast("string")), F.lit("# a remark"), F.lit(" "))).alias("value"))
    lines.union(part.where("p_size > 10").select("p_brand")).write.text(folder)
    return landing.read_ticker_file(spark, folder)
