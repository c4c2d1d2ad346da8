"""Streams over the driver's files: bounded drains whose stored result is compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import adapters as a
from checks.q_sources import _fresh
from checks.registry import register
from newsgauge.options import LOCAL
from newsgauge.plans import marts
from newsgauge.sources.tables import Tables
from newsgauge.streaming import headlines as stream


def _messages(spark, d):
    """Messages of all headlines in two files' worth of folders, with spoiled copies of some."""
    rows = stream.to_messages(a.scored(spark, d))
    spoiled = F.when(F.col("key").endswith("7"), F.replace("value", F.lit('"ticker"'), F.lit('"tick"'))).when(
        F.col("key").endswith("3"), F.lit("{not json")).otherwise(F.col("value"))
    return rows.select("value").union(rows.select(spoiled))


def _drained(spark, d, handler):
    folder = _fresh(spark, "messages")
    _messages(spark, d).write.text(folder)
    query = stream.drain(stream.subscribe_files(spark, folder), handler, _fresh(spark, "progress"))
    query.awaitTermination()


@register("x01_x04_messages_parsed_and_rejected", "outcome n:i", """
SELECT 'kept' AS outcome, count(*) + count(*) FILTER (NOT (ticker LIKE '%7' OR ticker LIKE '%3')) AS n FROM scored
UNION ALL SELECT 'rejected', count(*) FILTER (ticker LIKE '%7' OR ticker LIKE '%3') FROM scored""", (a.SCORED,))
def _(spark, d):
    good, bad = stream.parse_messages(_messages(spark, d).select(F.lit(None).cast("string").alias("key"), "value"))
    return (good.agg(F.count(F.lit(1)).alias("n")).withColumn("outcome", F.lit("kept"))
            .union(bad.agg(F.count(F.lit(1)).alias("n")).withColumn("outcome", F.lit("rejected"))))


@register("x02_x03_x05_stream_scored_into_table", "ticker source published_at_utc:t content_hash source_tier:i", """
SELECT ticker, source, published_at_utc, content_hash, 3 AS source_tier FROM scored""", (a.SCORED,))
def _(spark, d):
    store = Tables(spark, _fresh(spark, "tables"))
    _drained(spark, d, stream.score_into(store, a.clock()))
    return store.read("scored_headlines")


@register("x06_raw_stored_and_published", "side n:i distinct_hashes:i", """
SELECT 'stored' AS side, count(*) AS n, count(DISTINCT content_hash) AS distinct_hashes FROM scored
UNION ALL SELECT 'published', count(*), count(DISTINCT content_hash) FROM scored""", (a.SCORED,))
def _(spark, d):
    store, outbox = Tables(spark, _fresh(spark, "tables")), _fresh(spark, "outbox")
    source = _fresh(spark, "raw")
    columns = ["ticker", "headline", "source", "url", "published_at_utc", "summary", "category", "topic", "industry"]
    rows = a.scored(spark, d).select(*columns)
    rows.write.parquet(source)
    handler = stream.store_and_publish(store, lambda m: m.select("value").write.mode("append").text(outbox))
    query = stream.drain(spark.readStream.schema(rows.schema).parquet(source), handler, _fresh(spark, "progress"))
    query.awaitTermination()
    sent, _ = stream.parse_messages(spark.read.text(outbox).select(F.lit(None).cast("string").alias("key"), "value"))
    from newsgauge.plans.scoring import with_content_hash

    def counts(frame, side):
        return frame.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("content_hash").alias("distinct_hashes")).withColumn("side", F.lit(side))

    return counts(store.read("raw_headlines"), "stored").unionByName(counts(with_content_hash(sent), "published"))


def _stream_of_scored(spark, d):
    """The events file as a stream, followed by one far later row that closes every window."""
    folder = _fresh(spark, "scored")
    rows = a.scored(spark, d)
    rows.write.parquet(folder)
    closing = rows.limit(1).withColumn("published_at_utc", F.lit("2024-06-01 00:00:00").cast("timestamp")).withColumn("ticker", F.lit("END"))
    return folder, rows.schema, closing


def _run_windowed(spark, d, build):
    folder, schema, closing = _stream_of_scored(spark, d)
    out, progress = _fresh(spark, "windows"), _fresh(spark, "progress")

    def go():
        windowed = build(spark.readStream.schema(schema).parquet(folder))
        (windowed.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress)
         .outputMode("append").trigger(availableNow=True).start()).awaitTermination()

    go()
    closing.write.mode("append").parquet(folder)
    go()
    return spark.read.parquet(out).where("ticker <> 'END'")


DAILY_SPEC = ("ticker sentiment_date:d headline_count:i avg_compound_score:f avg_confidence:f positive_headline_count:i neutral_headline_count:i "
              "negative_headline_count:i avg_positive_score:f avg_neutral_score:f avg_negative_score:f compound_score_sum:f absolute_sentiment_volume:f "
              "confidence_weighted_compound_score:f source_weighted_compound_score:f headline_volume_weighted_sentiment_index:f "
              "first_headline_at_utc:t latest_headline_at_utc:t")


@register("x07_daily_windows_with_watermark", DAILY_SPEC, "SELECT * FROM daily", a.WAREHOUSE_CHAIN[:2])
def _(spark, d):
    return _run_windowed(spark, d, stream.daily_stream)


@register("x07_local_daily_windows_with_watermark", DAILY_SPEC + " political_headline_count:i financial_headline_count:i", "SELECT * FROM daily", a.LOCAL_CHAIN[:2])
def _(spark, d):
    return _run_windowed(spark, d, lambda scored: stream.daily_stream(scored, opts=LOCAL))


@register("x07_daily_mart_from_partials_of_batches", DAILY_SPEC, "SELECT * FROM daily", a.WAREHOUSE_CHAIN[:2])
def _(spark, d):
    """Batches by day of the month, late ones among them, and one that comes twice."""
    store, rows = Tables(spark, _fresh(spark, "partials")), a.scored(spark, d)
    for batch in (rows.where("event_id % 3 = 1"), rows.where("event_id % 3 <> 2"), rows):
        with store.transaction():
            fresh = store.stage(store.absent("scored_headlines", batch)[0])
            store.append("scored_headlines", fresh)
            store.append("daily_partials", marts.daily_partials(fresh))
    store.replace("daily_partials", marts.merged_partials(store.read("daily_partials")))
    return marts.daily_from_partials(store.read("daily_partials"))


@register("x07_daily_mart_from_streamed_partials", "ticker sentiment_date:d headline_count:i first_headline_at_utc:t latest_headline_at_utc:t",
          "SELECT * FROM daily", a.WAREHOUSE_CHAIN[:2])
def _(spark, d):
    store = Tables(spark, _fresh(spark, "tables"))
    _drained(spark, d, stream.score_into(store, a.clock()))
    return marts.daily_from_partials(store.read("daily_partials"))


@register("x07_sliding_windows_with_watermark", "ticker insight_date:d headline_count:i weighted_score:f", """
SELECT ticker, CAST(insight_date AS DATE) AS insight_date, count(*) AS headline_count, sum(compound_score * wt) / sum(wt) AS weighted_score FROM (
  SELECT *, greatest(confidence, 0.2) * CASE source_tier WHEN 1 THEN 1.2 WHEN 2 THEN 1.0 ELSE 0.82 END
    * CASE WHEN category = 'political' THEN 1.15 ELSE 1.0 END AS wt,
    unnest(generate_series(date_trunc('day', published_at_utc), date_trunc('day', published_at_utc) + INTERVAL 3 DAY, INTERVAL 1 DAY)) AS insight_date
  FROM scored) GROUP BY 1, 2""", (a.SCORED,))
def _(spark, d):
    return _run_windowed(spark, d, stream.sliding_stream)


@register("x07_copies_dropped_within_watermark", "event_id:i", "SELECT event_id FROM scored", (a.SCORED,))
def _(spark, d):
    folder = _fresh(spark, "twice")
    rows = a.scored(spark, d)
    rows.union(rows).write.parquet(folder)
    out = _fresh(spark, "once")
    deduped = stream.dedupe_within(spark.readStream.schema(rows.schema).parquet(folder), "60 days")
    (deduped.writeStream.format("parquet").option("path", out).option("checkpointLocation", _fresh(spark, "progress"))
     .trigger(availableNow=True).start()).awaitTermination()
    return spark.read.parquet(out)


@register("x07_marts_from_streamed_table", "ticker sentiment_date:d headline_count:i", """
SELECT ticker, sentiment_date, headline_count FROM daily""", a.WAREHOUSE_CHAIN[:2])
def _(spark, d):
    store = Tables(spark, _fresh(spark, "tables"))
    _drained(spark, d, stream.score_into(store, a.clock()))
    return marts.daily_sentiment(store.read("scored_headlines"))


@register("x06_replayed_batches_change_nothing", "side n:i distinct_hashes:i", """
SELECT side, count(*) AS n, count(DISTINCT content_hash) AS distinct_hashes FROM scored, (VALUES ('stored'), ('outbox')) s(side) GROUP BY side""", (a.SCORED,))
def _(spark, d):
    from newsgauge.plans.scoring import with_content_hash

    store, source, progress = Tables(spark, _fresh(spark, "tables")), _fresh(spark, "raw"), _fresh(spark, "progress")
    columns = ["ticker", "headline", "source", "url", "published_at_utc", "summary", "category", "topic", "industry"]
    rows = a.scored(spark, d).select(*columns)
    rows.write.parquet(source)

    def drain():
        stream.drain(spark.readStream.schema(rows.schema).parquet(source), stream.store_and_publish(store), progress).awaitTermination()

    drain()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{progress}/commits")
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)  # an old checkpoint: the batch was planned, not finished
    drain()
    sent, _ = stream.parse_messages(store.read("outbox"))

    def counts(frame, side):
        return frame.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("content_hash").alias("distinct_hashes")).withColumn("side", F.lit(side))

    return counts(store.read("raw_headlines"), "stored").unionByName(counts(with_content_hash(sent), "outbox"))
