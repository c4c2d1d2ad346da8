"""Insights for one window and for all days, and the parts they are made of."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from checks import adapters as a
from checks.registry import register
from newsgauge.operators.halfsplit import half_split_momentum
from newsgauge.operators.keyed import first_rows
from newsgauge.options import InsightOptions
from newsgauge.plans import insights

SINCE = dt.datetime(2024, 1, 28, tzinfo=dt.timezone.utc)
DAY = dt.date(2024, 1, 31)

# frames(insight_date, ticker, all headline columns): the rows of each window, straight from the definition.
WINDOW = """frames AS (
  SELECT DATE '2024-01-31' AS insight_date, * FROM scored WHERE published_at_utc >= TIMESTAMP '2024-01-28')"""
ALL_DAYS = """frames AS (
  SELECT r.insight_date, s.* FROM (SELECT DISTINCT CAST(published_at_utc AS DATE) AS insight_date FROM scored) r
  JOIN scored s ON s.published_at_utc >= r.insight_date - INTERVAL 3 DAY AND s.published_at_utc < r.insight_date + INTERVAL 1 DAY)"""
EXTERNAL = """external AS (SELECT 'T' || c_custkey AS ticker, c_acctbal / 10000.0 AS score FROM customer WHERE c_mktsegment = 'MACHINERY')"""
NO_EXTERNAL = "external AS (SELECT CAST(NULL AS VARCHAR) AS ticker, CAST(NULL AS DOUBLE) AS score LIMIT 0)"

INSIGHTS = """ranked AS (
  SELECT *, coalesce(topic, '') AS topic_text,
    greatest(confidence, 0.2) * CASE source_tier WHEN 1 THEN 1.2 WHEN 2 THEN 1.0 ELSE 0.82 END
      * CASE WHEN category = 'political' THEN 1.15 ELSE 1.0 END AS wt,
    row_number() OVER (PARTITION BY insight_date, ticker ORDER BY published_at_utc, content_hash) AS pos,
    count(*) OVER (PARTITION BY insight_date, ticker) AS n_all FROM frames),
mixes AS (
  SELECT insight_date, ticker, string_agg(category || ':' || k || '/' || tot, ', ' ORDER BY category) AS category_mix FROM (
    SELECT insight_date, ticker, category, count(*) AS k, any_value(n_all) AS tot FROM ranked GROUP BY 1, 2, 3) GROUP BY 1, 2),
base AS (
  SELECT insight_date, ticker, count(*) AS n, sum(compound_score * wt) / sum(wt) AS ws, sum(confidence * wt) / sum(wt) AS conf,
    count(DISTINCT source) AS source_count, count(*) FILTER (category = 'political') AS n_pol,
    count(*) FILTER (category = 'financial') AS n_fin,
    avg(compound_score) FILTER (pos <= greatest(1, n_all // 2)) AS older,
    avg(compound_score) FILTER (pos > greatest(1, n_all // 2)) AS newer,
    list(compound_score) AS cs, avg(CASE WHEN compound_score < -0.2 THEN 1.0 ELSE 0.0 END) AS bad,
    avg(CASE WHEN category = 'political' THEN 1.0 ELSE 0.0 END) AS pol
  FROM ranked GROUP BY 1, 2),
tops AS (SELECT insight_date, ticker, headline AS top_headline, topic_text AS top_topic FROM ranked
  QUALIFY row_number() OVER (PARTITION BY insight_date, ticker ORDER BY abs(compound_score) DESC, published_at_utc DESC, content_hash) = 1),
evidence AS (SELECT insight_date, ticker, string_agg(content_hash, ',' ORDER BY published_at_utc DESC, content_hash) AS hashes FROM (
    SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY insight_date, ticker ORDER BY published_at_utc DESC, content_hash) <= 10)
  GROUP BY 1, 2),
step1 AS (
  SELECT b.*, m.category_mix, t.top_headline, t.top_topic, e.hashes, x.score AS ext,
    CASE WHEN abs(ws) < 1e-9 THEN 0.0
      ELSE greatest(least(ws + sign(ws) * least(0.12, ln(1 + n) / 30), 1.0), -1.0) END AS boosted,
    least(source_count / 4.0, 1.0) AS div,
    CASE WHEN n < 2 THEN 0.0 ELSE greatest(least(coalesce(newer, older) - older, 1.0), -1.0) END AS mom
  FROM base b JOIN mixes m USING (insight_date, ticker) JOIN tops t USING (insight_date, ticker)
    JOIN evidence e USING (insight_date, ticker) LEFT JOIN external x ON x.ticker = b.ticker),
step2 AS (
  SELECT *, CASE WHEN ext IS NULL THEN boosted ELSE greatest(least(boosted * 0.7 + ext * 0.3, 1.0), -1.0) END AS sig FROM step1),
step3 AS (
  SELECT *, CASE WHEN sig >= 0.12 THEN 'positive' WHEN sig <= -0.12 THEN 'negative' ELSE 'neutral' END AS signal_label,
    greatest(least(0.55 * len(list_filter(cs, lambda c: c * sig >= 0)) / n + 0.25 * least(abs(sig), 1.0) + 0.2 * div, 1.0), 0.0) AS cons
  FROM step2),
step4 AS (
  SELECT *, greatest(least(0.45 * (1 - cons) + 0.3 * greatest(0.0, 0.75 - conf) + 0.2 * bad + 0.15 * pol, 1.0), 0.0) AS risk FROM step3),
step5 AS (
  SELECT *, greatest(least(0.45 * greatest(sig, 0.0) + 0.22 * conf + 0.16 * div + 0.11 * greatest(mom, 0.0)
      + CASE WHEN n_pol > 0 THEN 0.06 ELSE 0.0 END - 0.18 * risk, 1.0), 0.0) AS opp,
    0.4 * conf + 0.25 * div + 0.25 * cons + 0.1 * least(n / 6.0, 1.0) AS points FROM step4),
insights AS (
  SELECT *, n AS headline_count, n_pol AS political_headline_count, n_fin AS financial_headline_count, sig AS signal_score,
    conf AS confidence, div AS source_diversity_score, mom AS sentiment_momentum, cons AS consensus_score,
    risk AS risk_score, opp AS opportunity_score,
    CASE WHEN signal_label = 'negative' THEN CASE WHEN sig <= -0.35 OR risk >= 0.45 THEN 'sell' ELSE 'trim' END
      WHEN signal_label = 'positive' THEN CASE WHEN opp >= 0.48 AND risk <= 0.35 THEN 'strong_buy'
        WHEN opp >= 0.28 OR mom > 0.2 THEN 'buy' ELSE 'watch' END
      WHEN risk >= 0.45 THEN 'watch_risk' ELSE 'hold' END AS recommendation,
    CASE WHEN points >= 0.82 THEN 'A' WHEN points >= 0.68 THEN 'B' WHEN points >= 0.52 THEN 'C' ELSE 'D' END AS confidence_grade
  FROM step5)"""

SPEC = ("insight_date:d ticker signal_label signal_score:f confidence:f headline_count:i political_headline_count:i "
        "financial_headline_count:i category_mix source_count:i source_diversity_score:f sentiment_momentum:f "
        "consensus_score:f risk_score:f opportunity_score:f recommendation confidence_grade rationale hashes")
SELECT = """SELECT *, CASE recommendation WHEN 'strong_buy' THEN 'Strong Buy' WHEN 'watch_risk' THEN 'Watch Risk'
    ELSE upper(recommendation[1]) || recommendation[2:] END || ' from ' || signal_label || ' ' || printf('%+.3f', sig)
  || ' signal across ' || n || ' headline(s): ' || CASE WHEN n_pol > 0 THEN n_pol || ' political/policy headline(s), ' ELSE '' END
  || n_fin || ' financial headline(s). Opportunity ' || printf('%.2f', opp) || ', risk ' || printf('%.2f', risk)
  || '. Strongest catalyst: ' || top_headline || '.' || CASE WHEN top_topic <> '' THEN ' Topic: ' || top_topic || '.' ELSE '' END
  || CASE WHEN ext IS NOT NULL THEN ' Finnhub ticker score ' || printf('%+.3f', ext) || ' was blended in.' ELSE '' END AS rationale
FROM insights"""


def _with_hash_text(df):
    return df.withColumn("hashes", F.array_join("source_headline_hashes", ","))


@register("a07_i01_i15_insights_of_last_window", SPEC, SELECT, (a.SCORED, WINDOW, NO_EXTERNAL, INSIGHTS))
def _(spark, d):
    rows = a.scored(spark, d).where(F.col("published_at_utc") >= F.lit(SINCE))
    return _with_hash_text(insights.insights_for_window(rows, DAY))


@register("j16_i04_insights_with_external_scores", SPEC, SELECT, (a.SCORED, WINDOW, EXTERNAL, INSIGHTS))
def _(spark, d):
    rows = insights.recent_headlines(a.scored(spark, d), SINCE)
    outside = a.table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select(
        F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("ticker"), (F.col("c_acctbal") / 10000.0).alias("score"))
    return _with_hash_text(insights.insights_for_window(rows, DAY, external=outside))


@register("w17_p09_insights_of_every_day", SPEC, SELECT, (a.SCORED, ALL_DAYS, NO_EXTERNAL, INSIGHTS))
def _(spark, d):
    return _with_hash_text(insights.insights_for_days(a.scored(spark, d)))


@register("w07_i06_half_split_momentum", "source momentum:f", """
SELECT source, greatest(least(avg(compound_score) FILTER (pos > n // 2) - avg(compound_score) FILTER (pos <= n // 2), 1), -1) AS momentum
FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY published_at_utc, content_hash) AS pos,
        count(*) OVER (PARTITION BY source) AS n FROM scored) GROUP BY 1""", (a.SCORED,))
def _(spark, d):
    return half_split_momentum(a.scored(spark, d), ["source"], "published_at_utc", "content_hash", "compound_score")


@register("w07_half_split_of_day_stamps", "ticker momentum:f", """
SELECT ticker, CASE WHEN any_value(n) < 2 THEN 0.0 ELSE greatest(least(avg(v) FILTER (pos > n // 2) - avg(v) FILTER (pos <= n // 2), 1), -1) END AS momentum
FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts, tie) AS pos, count(*) OVER (PARTITION BY ticker) AS n FROM (
  SELECT 'S' || l_suppkey AS ticker, date_trunc('year', l_shipdate) AS ts,
    sha256(l_orderkey || '-' || l_partkey || '-' || l_linenumber) AS tie, sin(l_orderkey) AS v FROM lineitem))
GROUP BY 1""")
def _(spark, d):
    l = a.table(spark, d, "lineitem")
    tie = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_linenumber")])
    rows = l.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"),
                    F.date_trunc("year", "l_shipdate").cast("timestamp").alias("ts"), F.sha2(tie, 256).alias("tie"),
                    F.sin("l_orderkey").alias("v"))
    return half_split_momentum(rows, ["ticker"], "ts", "tie", "v")


@register("w14_i14_newest_ten_per_ticker", "ticker position:i content_hash", """
SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY published_at_utc DESC, content_hash) AS position FROM scored
QUALIFY position <= 10""", (a.SCORED,))
def _(spark, d):
    return first_rows(a.scored(spark, d), ["ticker"], [F.col("published_at_utc").desc(), F.col("content_hash")], 10, "position")


@register("a16_i12_category_mix", "insight_date:d ticker category_mix", "SELECT * FROM mixes",
          (a.SCORED, WINDOW, NO_EXTERNAL, INSIGHTS))
def _(spark, d):
    rows = a.scored(spark, d).where(F.col("published_at_utc") >= F.lit(SINCE))
    cells = rows.groupBy("ticker", F.lit(DAY).alias("insight_date"), "category").agg(F.count(F.lit(1)).alias("n"))
    return insights.category_mix(cells)


@register("t06_strongest_catalyst_per_ticker", "ticker headline", """
SELECT ticker, headline FROM scored QUALIFY row_number() OVER (
  PARTITION BY ticker ORDER BY abs(compound_score) DESC, published_at_utc DESC, content_hash) = 1""", (a.SCORED,))
def _(spark, d):
    return first_rows(a.scored(spark, d), ["ticker"], [
        F.abs("compound_score").desc(), F.col("published_at_utc").desc(), F.col("content_hash")])


@register("s04_t04_insights_up_to_a_date", "ticker insight_date:d signal_score:f recommendation",
          "SELECT * FROM part_insights WHERE insight_date <= DATE '1999-06-30'", (a.PART_INSIGHTS,))
def _(spark, d):
    return insights.latest_insights(a.part_insights(spark, d), dt.date(1999, 6, 30))


@register("w10_latest_insight_per_ticker", "ticker insight_date:d signal_score:f recommendation insight_id:i", """
SELECT * FROM part_insights QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY insight_date DESC, signal_score DESC) = 1""",
          (a.PART_INSIGHTS,))
def _(spark, d):
    return insights.latest_insight_per_ticker(a.part_insights(spark, d))


@register("j01_signals_beside_insights",
          "ticker sentiment_date:d is_zscore_anomaly:b signal_score:f recommendation political_headline_count:i "
          "political_headline_count_insight:i confidence_grade", """
SELECT s.ticker, s.sentiment_date, s.is_zscore_anomaly, i.signal_score, i.recommendation, s.political_headline_count,
  i.political_headline_count AS political_headline_count_insight, i.confidence_grade
FROM signals s LEFT JOIN insights i ON i.ticker = s.ticker AND i.insight_date = s.sentiment_date""",
          a.LOCAL_CHAIN + (ALL_DAYS, NO_EXTERNAL, INSIGHTS))
def _(spark, d):
    from newsgauge.options import LOCAL
    from newsgauge.plans import marts

    rows = a.scored(spark, d)
    return marts.build_marts(rows, LOCAL, insights.insights_for_days(rows, InsightOptions()))["signals"]
