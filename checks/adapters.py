"""Logical tables derived from the driver's tables, once for Spark and once as SQL CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgauge.functions.numbers import label_by_threshold
from newsgauge.functions.text import content_hash
from newsgauge.operators.keyed import first_rows

CLOCK = "2024-01-31 00:00:00"     # as-of time of the event-based tables
TRADE_DAY = "1999-06-30"          # as-of day of the price-based tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clock():
    return F.lit(CLOCK).cast("timestamp")


# ---------------------------------------------------------------- headlines


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> scored headlines."""
    e = table(spark, sf_dir, "events")
    c = F.sin(F.col("event_id") + F.col("value"))
    kind = F.col("event_type")
    rows = e.select(
        "event_id", F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("ticker"),
        F.col("props").alias("headline"), kind.alias("source"),
        F.concat(F.lit("http://news.example/"), F.col("event_id").cast("string")).alias("url"),
        F.col("ts").cast("timestamp").alias("published_at_utc"), label_by_threshold(c).alias("sentiment_label"),
        F.greatest(c, F.lit(0.0)).alias("positive_score"), (1.0 - F.abs(c)).alias("neutral_score"),
        F.greatest(-c, F.lit(0.0)).alias("negative_score"), c.alias("compound_score"),
        (0.2 + (F.col("event_id") % 80) / 100.0).alias("confidence"),
        ((F.unix_micros(clock()) - F.unix_micros(F.col("ts").cast("timestamp"))) / 3.6e9).alias("headline_age_hours"),
        F.when(kind.isin("purchase", "signup"), 1).when(kind == "click", 2).otherwise(3).alias("source_tier"),
        F.lit(None).cast("string").alias("summary"),
        F.when(kind == "error", "political").otherwise("financial").alias("category"),
        F.when(kind == "error", F.concat(F.lit("topic_"), (F.col("event_id") % 7).cast("string"))).alias("topic"),
        F.lit(None).cast("string").alias("industry"))
    return rows.withColumn("content_hash", content_hash())


SCORED = """events_scored AS (
  SELECT event_id, 'T' || user_id AS ticker, props AS headline, event_type AS source,
    'http://news.example/' || event_id AS url, ts AS published_at_utc,
    sin(event_id + value) AS compound_score,
    CASE WHEN sin(event_id + value) >= 0.12 THEN 'positive'
         WHEN sin(event_id + value) <= -0.12 THEN 'negative' ELSE 'neutral' END AS sentiment_label,
    greatest(sin(event_id + value), 0.0) AS positive_score,
    1.0 - abs(sin(event_id + value)) AS neutral_score,
    greatest(-sin(event_id + value), 0.0) AS negative_score,
    0.2 + (event_id % 80) / 100.0 AS confidence,
    (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts)) / 3.6e9 AS headline_age_hours,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 1 WHEN event_type = 'click' THEN 2 ELSE 3 END AS source_tier,
    CAST(NULL AS VARCHAR) AS summary,
    CASE WHEN event_type = 'error' THEN 'political' ELSE 'financial' END AS category,
    CASE WHEN event_type = 'error' THEN 'topic_' || (event_id % 7) END AS topic,
    CAST(NULL AS VARCHAR) AS industry
  FROM events),
scored AS (
  SELECT *, sha256(concat_ws('||', ticker, headline, source, url,
      strftime(published_at_utc, '%Y-%m-%dT%H:%M:%S')
        || CASE WHEN epoch_us(published_at_utc) % 1000000 = 0 THEN '' ELSE strftime(published_at_utc, '.%f') END
        || '+00:00', '', category, coalesce(topic, ''), '')) AS content_hash
  FROM events_scored)"""

DAILY_WAREHOUSE = """daily AS (
  SELECT ticker, CAST(published_at_utc AS DATE) AS sentiment_date, count(*) AS headline_count,
    avg(compound_score) AS avg_compound_score, avg(confidence) AS avg_confidence,
    sum(CASE WHEN sentiment_label = 'positive' THEN 1 ELSE 0 END) AS positive_headline_count,
    sum(CASE WHEN sentiment_label = 'neutral' THEN 1 ELSE 0 END) AS neutral_headline_count,
    sum(CASE WHEN sentiment_label = 'negative' THEN 1 ELSE 0 END) AS negative_headline_count,
    avg(positive_score) AS avg_positive_score, avg(neutral_score) AS avg_neutral_score,
    avg(negative_score) AS avg_negative_score,
    sum(compound_score) AS compound_score_sum, sum(abs(compound_score)) AS absolute_sentiment_volume,
    sum(compound_score * confidence) / nullif(sum(confidence), 0) AS confidence_weighted_compound_score,
    sum(compound_score * w) / nullif(sum(w), 0) AS source_weighted_compound_score,
    avg(compound_score) * ln(1 + count(*)) AS headline_volume_weighted_sentiment_index,
    min(published_at_utc) AS first_headline_at_utc, max(published_at_utc) AS latest_headline_at_utc
  FROM (SELECT *, CASE source_tier WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 1 END AS w FROM scored)
  GROUP BY 1, 2)"""

DAILY_LOCAL = """daily AS (
  SELECT ticker, CAST(published_at_utc AS DATE) AS sentiment_date, count(headline) AS headline_count,
    avg(compound_score) AS avg_compound_score, avg(confidence) AS avg_confidence,
    count(*) FILTER (sentiment_label = 'positive') AS positive_headline_count,
    count(*) FILTER (sentiment_label = 'neutral') AS neutral_headline_count,
    count(*) FILTER (sentiment_label = 'negative') AS negative_headline_count,
    count(*) FILTER (category = 'political') AS political_headline_count,
    count(*) FILTER (category = 'financial') AS financial_headline_count,
    avg(positive_score) AS avg_positive_score, avg(neutral_score) AS avg_neutral_score,
    avg(negative_score) AS avg_negative_score,
    sum(compound_score) AS compound_score_sum, sum(abs(compound_score)) AS absolute_sentiment_volume,
    avg(compound_score * confidence) AS confidence_weighted_compound_score,
    avg(compound_score * CASE source_tier WHEN 1 THEN 1.2 WHEN 2 THEN 1.0 ELSE 0.82 END) AS source_weighted_compound_score,
    avg(compound_score) * (1 + count(headline) / 20.0) AS headline_volume_weighted_sentiment_index,
    min(published_at_utc) AS first_headline_at_utc, max(published_at_utc) AS latest_headline_at_utc
  FROM scored GROUP BY 1, 2)"""


def _rolling(weighted: str) -> str:
    return f"""rolling AS (
  SELECT *,
    avg(avg_compound_score) OVER w AS rolling_7_day_avg_compound_score,
    avg(headline_count) OVER w AS rolling_7_day_avg_headline_count,
    stddev_samp(avg_compound_score) OVER w AS rolling_7_day_compound_score_stddev,
    sum({weighted}) OVER w / nullif(sum(headline_count) OVER w, 0) AS rolling_7_day_volume_weighted_sentiment_index,
    sum(compound_score_sum) OVER w AS rolling_7_day_compound_score_sum,
    sum(absolute_sentiment_volume) OVER w AS rolling_7_day_absolute_sentiment_volume
  FROM daily
  WINDOW w AS (PARTITION BY ticker ORDER BY sentiment_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))"""


ROLLING_WAREHOUSE = _rolling("avg_compound_score * headline_count")
ROLLING_LOCAL = _rolling("compound_score_sum")


def _signals(threshold: float, z: float, default: str) -> str:
    return f"""signals AS (
  SELECT *,
    coalesce(avg_compound_score <= -{threshold} OR zs <= -{z}, FALSE) AS is_negative_sentiment_signal,
    coalesce(avg_compound_score >= {threshold} OR zs >= {z}, FALSE) AS is_positive_sentiment_signal,
    coalesce(zs <= -{z}, FALSE) AS is_negative_zscore_anomaly,
    coalesce(zs >= {z}, FALSE) AS is_positive_zscore_anomaly,
    coalesce(abs(zs) >= {z}, FALSE) AS is_zscore_anomaly, zs AS compound_score_zscore
  FROM (SELECT *, coalesce((avg_compound_score - rolling_7_day_avg_compound_score)
      / nullif(rolling_7_day_compound_score_stddev, 0), {default}) AS zs FROM rolling))"""


SIGNALS_WAREHOUSE = _signals(0.5, 2.0, "NULL")
SIGNALS_LOCAL = _signals(0.12, 1.5, "0.0")

WAREHOUSE_CHAIN = (SCORED, DAILY_WAREHOUSE, ROLLING_WAREHOUSE, SIGNALS_WAREHOUSE)
LOCAL_CHAIN = (SCORED, DAILY_LOCAL, ROLLING_LOCAL, SIGNALS_LOCAL)


# ---------------------------------------------------------------- texts


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> raw headlines: first line is the headline, the whole text the summary."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", F.concat(F.lit("  d"), (F.col("doc_id") % 50).cast("string"), F.lit(" ")).alias("ticker"),
        F.split("text", "\n").getItem(0).alias("headline"),
        F.when(F.col("lang") == "es", F.lit(None)).otherwise(F.concat("source", F.lit(" Reuters  "), "lang")).alias("source"),
        F.concat(F.lit("http://doc.example/"), F.col("source")).alias("url"),
        F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), F.lit("T08:30:00Z"))
        .alias("published_at_utc"),
        F.col("text").alias("summary"), F.when(F.col("lang") == "en", F.lit(" Political ")).alias("category"),
        F.col("lang").alias("topic"), F.lit("").alias("industry"))


RAW_DOCS = r"""raw_docs AS (
  SELECT doc_id, '  d' || (doc_id % 50) || ' ' AS ticker, string_split(text, chr(10))[1] AS headline,
    CASE WHEN lang = 'es' THEN NULL ELSE source || ' Reuters  ' || lang END AS source,
    'http://doc.example/' || source AS url,
    strptime('2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || ' 08:30:00', '%Y-%m-%d %H:%M:%S') AS published_at_utc,
    text AS summary, CASE WHEN lang = 'en' THEN ' Political ' END AS category, lang AS topic, '' AS industry
  FROM documents)"""

# White space as both engines are told to see it.
_CLEAN = r"trim(regexp_replace(coalesce({0}, ''), '[\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))"


def sql_clean(column: str) -> str:
    return _CLEAN.format(column)


NORMAL_DOCS = f"""normal_docs AS (
  SELECT doc_id, upper({sql_clean('ticker')}) AS ticker, {sql_clean('headline')} AS headline,
    coalesce(nullif({sql_clean('source')}, ''), 'unknown') AS source, {sql_clean('url')} AS url, published_at_utc,
    nullif({sql_clean('summary')}, '') AS summary,
    coalesce(lower(nullif({sql_clean('category')}, '')), 'financial') AS category,
    nullif({sql_clean('topic')}, '') AS topic, nullif({sql_clean('industry')}, '') AS industry
  FROM raw_docs)"""

# The prose is invented, so a lexicon of words that occur in it.
UP_WORDS = {"the": 0.7313, "and": 0.4177, "with": 1.1351, "les": 0.9137, "der": 0.8219, "that": 0.6131, "for the": 1.0191}
DOWN_WORDS = {"of": 0.5279, "on": 0.9371, "is": 0.8087, "des": 1.2239, "und": 0.7573, "are": 1.3127, "in the": 0.6361}


# ---------------------------------------------------------------- prices


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem -> price quotes, unique per ticker and day."""
    return first_rows(provider_quotes(spark, sf_dir), ["ticker", "quote_date"],
                      [F.col("order_key").desc(), F.col("line").desc(), F.col("close_price_usd").desc()])


def provider_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem -> quotes of three sources, unique per ticker, day and source."""
    l = table(spark, sf_dir, "lineitem")
    rows = l.select(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("ticker"),
        F.col("l_shipdate").cast("date").alias("quote_date"),
        (F.col("l_extendedprice") / (F.col("l_quantity") + 0.37)).alias("close_price_usd"),
        F.when(F.col("l_returnflag") == "A", "polygon").when(F.col("l_returnflag") == "N", "yahoo_chart")
        .otherwise("synthetic").alias("data_source"),
        F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"))
    return first_rows(rows, ["ticker", "quote_date", "data_source"],
                      [F.col("order_key").desc(), F.col("line").desc(), F.col("close_price_usd").desc()])


QUOTES = """line_quotes AS (
  SELECT 'P' || l_partkey AS ticker, CAST(l_shipdate AS DATE) AS quote_date, l_extendedprice / (l_quantity + 0.37) AS close_price_usd,
    CASE l_returnflag WHEN 'A' THEN 'polygon' WHEN 'N' THEN 'yahoo_chart' ELSE 'synthetic' END AS data_source,
    l_orderkey AS order_key, l_linenumber AS line FROM lineitem),
provider_quotes AS MATERIALIZED (
  SELECT * FROM line_quotes QUALIFY row_number() OVER (PARTITION BY ticker, quote_date, data_source
    ORDER BY order_key DESC, line DESC, close_price_usd DESC) = 1),
quotes AS (
  SELECT * FROM line_quotes QUALIFY row_number() OVER (PARTITION BY ticker, quote_date
    ORDER BY order_key DESC, line DESC, close_price_usd DESC) = 1)"""


def part_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem -> one insight per part ticker and ship day."""
    l = table(spark, sf_dir, "lineitem")
    day = F.col("l_shipdate").cast("date")
    rows = l.groupBy("l_partkey", day.alias("insight_date")).agg(
        F.avg(F.sin(F.col("l_orderkey") + F.col("l_linenumber"))).alias("_s"),
        F.sum("l_orderkey").alias("_k"), F.sum("l_linenumber").alias("_n"), F.count(F.lit(1)).alias("headline_count"))
    s = F.round("_s", 6)
    rows = rows.withColumns({"signal_score": s, "opportunity_score": F.round(F.abs(F.cos("_k")), 6),
                             "risk_score": F.round(F.abs(F.sin(F.col("_k") * 3)), 6)})
    label = label_by_threshold(F.col("signal_score"))
    advice = (F.when((label == "positive") & (F.col("opportunity_score") >= 0.6), "strong_buy")
              .when((label == "positive") & (F.col("opportunity_score") >= 0.3), "buy")
              .when(label == "positive", "watch").when((label == "negative") & (F.col("risk_score") > 0.5), "sell")
              .when(label == "negative", "trim").when(F.col("_n") % 5 == 0, F.lit(None)).otherwise("hold"))
    ticker = F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    return rows.select(
        (F.col("l_partkey") * 100000 + F.datediff("insight_date", F.lit("1990-01-01").cast("date"))).alias("insight_id"),
        ticker.alias("ticker"), "insight_date", label.alias("signal_label"), "signal_score",
        (0.2 + (F.col("_n") % 80) / 100.0).alias("confidence"), "headline_count", "opportunity_score", "risk_score",
        advice.alias("recommendation"), F.concat(F.lit("view on "), ticker).alias("rationale"),
        F.when(F.col("_n") % 4 != 0, (F.col("_n") % 20).cast("int")).alias("horizon_days"))


PART_INSIGHTS = """part_sums AS (
  SELECT l_partkey, CAST(l_shipdate AS DATE) AS insight_date, round(avg(sin(l_orderkey + l_linenumber)), 6) AS signal_score,
    round(abs(cos(sum(l_orderkey))), 6) AS opportunity_score, round(abs(sin(sum(l_orderkey) * 3)), 6) AS risk_score,
    sum(l_linenumber) AS n_lines, count(*) AS headline_count
  FROM lineitem GROUP BY 1, 2),
part_labels AS (
  SELECT *, CASE WHEN signal_score >= 0.12 THEN 'positive' WHEN signal_score <= -0.12 THEN 'negative' ELSE 'neutral' END AS signal_label
  FROM part_sums),
part_insights AS (
  SELECT l_partkey * 100000 + date_diff('day', DATE '1990-01-01', insight_date) AS insight_id,
    'P' || l_partkey AS ticker, insight_date, signal_label, signal_score, 0.2 + (n_lines % 80) / 100.0 AS confidence,
    headline_count, opportunity_score, risk_score,
    CASE WHEN signal_label = 'positive' AND opportunity_score >= 0.6 THEN 'strong_buy'
         WHEN signal_label = 'positive' AND opportunity_score >= 0.3 THEN 'buy'
         WHEN signal_label = 'positive' THEN 'watch'
         WHEN signal_label = 'negative' AND risk_score > 0.5 THEN 'sell'
         WHEN signal_label = 'negative' THEN 'trim'
         WHEN n_lines % 5 = 0 THEN NULL ELSE 'hold' END AS recommendation,
    'view on P' || l_partkey AS rationale,
    CASE WHEN n_lines % 4 <> 0 THEN CAST(n_lines % 20 AS INTEGER) END AS horizon_days
  FROM part_labels)"""


# ---------------------------------------------------------------- portfolio


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -> portfolio runs."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("run_name"),
                    F.lit(50000.0).alias("starting_cash_cad"), (F.col("c_acctbal") + 2000.0).alias("cash_cad"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders x lineitem -> holdings per customer and part."""
    bought = trades(spark, sf_dir).where(F.col("side") == "buy")
    rows = bought.groupBy("run_name", "ticker").agg(
        F.sum("quantity").alias("quantity"), (F.sum("gross_cad") / F.sum("quantity")).alias("avg_cost_cad"),
        F.max("price_cad").alias("last_price_cad"))
    worth = F.col("quantity") * F.col("last_price_cad")
    return rows.withColumns({"market_value_cad": worth,
                             "unrealized_pnl_cad": worth - F.col("quantity") * F.col("avg_cost_cad")})


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    price = F.col("l_extendedprice") / (F.col("l_quantity") + 0.37)
    return l.join(o, l.l_orderkey == o.o_orderkey).select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("run_name"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("ticker"),
        F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
        F.col("l_quantity").alias("quantity"), price.alias("price_cad"),
        (F.col("l_quantity") * price).alias("gross_cad"), F.col("o_orderdate").cast("timestamp").alias("traded_at_utc"))


RUNS = """runs AS (SELECT 'C' || c_custkey AS run_name, 50000.0 AS starting_cash_cad, c_acctbal + 2000.0 AS cash_cad FROM customer)"""
TRADES = """trades AS (
  SELECT 'C' || o_custkey AS run_name, 'P' || l_partkey AS ticker,
    CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, l_quantity AS quantity,
    l_extendedprice / (l_quantity + 0.37) AS price_cad, l_quantity * (l_extendedprice / (l_quantity + 0.37)) AS gross_cad, o_orderdate AS traded_at_utc
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
POSITIONS = """positions AS (
  SELECT *, quantity * last_price_cad AS market_value_cad,
    quantity * last_price_cad - quantity * avg_cost_cad AS unrealized_pnl_cad
  FROM (SELECT run_name, ticker, sum(quantity) AS quantity, sum(gross_cad) / sum(quantity) AS avg_cost_cad,
          max(price_cad) AS last_price_cad FROM trades WHERE side = 'buy' GROUP BY 1, 2))"""


# ---------------------------------------------------------------- run logs


def run_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events by user and day -> one run log with a JSON summary."""
    e = table(spark, sf_dir, "events")
    rows = e.groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").cast("timestamp").alias("started_at_utc"),
        F.max("ts").cast("timestamp").alias("finished_at_utc"), F.sum("event_id").alias("k"))
    run_id = F.concat(F.lit("run-"), F.col("user_id").cast("string"), F.lit("-"), F.col("day").cast("string"))
    summary = F.to_json(F.struct(
        run_id.alias("run_id"), F.lit(5).alias("tickers"), (F.col("n") * 20).alias("raw_headlines_collected"),
        (F.col("n") * 15).alias("scored_headlines_saved_attempted"), (F.col("n") * 4).alias("insights_generated"),
        F.struct((F.col("n") * 10).alias("evaluations_saved"), (F.col("k") % 10).alias("synthetic_evaluations")).alias("evaluation"),
        F.when(F.col("k") % 3 != 0, F.struct((F.col("k") % 5).cast("double").alias("total_equity_cad"),
                                             (F.col("k") % 4).alias("trades_executed"))).alias("simulation")))
    failed = F.col("k") % 11 == 0
    return rows.select(
        run_id.alias("run_id"), F.lit("local").alias("run_type"), "started_at_utc",
        F.when(~failed, F.col("finished_at_utc")).alias("finished_at_utc"),
        F.when(failed, "failed").otherwise("success").alias("status"),
        F.when(failed, F.concat(F.lit("error "), F.col("k").cast("string"))).alias("error_message"),
        summary.alias("summary_json"))


RUN_LOGS = """run_base AS (
  SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, min(ts) AS started_at_utc, max(ts) AS last_ts, sum(event_id) AS k
  FROM events GROUP BY 1, 2),
run_logs AS (
  SELECT 'run-' || user_id || '-' || day AS run_id, started_at_utc,
    CASE WHEN k % 11 <> 0 THEN last_ts END AS finished_at_utc,
    CASE WHEN k % 11 = 0 THEN 'failed' ELSE 'success' END AS status,
    CASE WHEN k % 11 = 0 THEN 'error ' || k END AS error_message,
    n * 20 AS raw, n * 15 AS scored_n, n * 4 AS made, n * 10 AS total, k % 10 AS made_up,
    CASE WHEN k % 3 <> 0 THEN CAST(k % 5 AS DOUBLE) END AS equity, CASE WHEN k % 3 <> 0 THEN k % 4 END AS executed
  FROM run_base)"""
