"""Headline streams: publish, subscribe, parse, score, store, and windowed aggregates.

Late rows are never lost by default: the sink inserts by content hash and the marts are computed
from the stored table. The watermark forms bound their state instead and say so.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsgauge.functions.numbers import ratio
from newsgauge.functions.text import HASHED_FIELDS, content_hash, iso_timestamp, parse_timestamp
from newsgauge.options import WAREHOUSE, MartOptions
from newsgauge.plans.insights import row_weight
from newsgauge.plans.marts import daily_partials, daily_windows
from newsgauge.plans.scoring import normalize_headlines, score_headlines, with_content_hash
from newsgauge.sources.tables import Tables

MESSAGE = ("ticker string, headline string, source string, url string, published_at_utc string, "
           "summary string, category string, topic string, industry string")
REQUIRED = ["ticker", "headline", "source", "url", "published_at_utc"]


# ---------------------------------------------------------------- publish and subscribe


def to_messages(headlines: DataFrame) -> DataFrame:
    """(key = ticker, value = JSON) rows. All nine hashed fields travel, so the content hash
    of a headline is the same before and after the stream."""
    fields = [iso_timestamp(F.col(f)).alias(f) if f == "published_at_utc" else F.col(f) for f in HASHED_FIELDS]
    return headlines.select(F.col("ticker").alias("key"), F.to_json(F.struct(*fields)).alias("value"))


def publish_to_kafka(messages: DataFrame, servers: str, topic: str, checkpoint: str | None = None):
    """Batch write, or a streaming write when the input is a stream."""
    options = {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all"}
    if not messages.isStreaming:
        messages.write.format("kafka").options(**options).save()
        return None
    return (messages.writeStream.format("kafka").options(**options)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def subscribe_kafka(spark: SparkSession, servers: str, topic: str, max_per_trigger: int | None = None) -> DataFrame:
    """From the earliest offset on first start; afterwards the checkpoint is the position. A batch takes what is
    there unless the caller limits it."""
    reader = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
              .option("subscribe", topic).option("startingOffsets", "earliest"))
    if max_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
    return reader.load().select(F.col("key").cast("string"), F.col("value").cast("string"))


def subscribe_files(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Message files, one JSON document per line."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(folder).select(F.lit(None).cast("string").alias("key"), F.col("value"))


def parse_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(headlines, rejects). Unreadable JSON, a missing required field or an unreadable date rejects."""
    parsed = messages.withColumn("_m", F.from_json("value", MESSAGE))
    complete = F.col("_ts").isNotNull()
    for name in REQUIRED:
        complete = complete & F.col(f"_m.{name}").isNotNull()
    checked = parsed.withColumn("_ts", parse_timestamp(F.col("_m.published_at_utc"))).withColumn(
        "_ok", F.coalesce(complete, F.lit(False)))
    rows = checked.where("_ok").select(*[
        F.col("_ts").alias(f) if f == "published_at_utc" else F.col(f"_m.{f}").alias(f) for f in HASHED_FIELDS])
    rows = rows.withColumn("category", F.coalesce("category", F.lit("financial")))
    return rows, checked.where("NOT _ok").select("value")


# ---------------------------------------------------------------- drains


def drain(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Processes what is there and stops; the next call goes on from the checkpoint."""
    return (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def query_of(batch: DataFrame) -> str | None:
    """Id of the stream whose batch is handled: it stays with the checkpoint, so a new checkpoint is a new stream."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


def once(tables: Tables, batch: DataFrame, batch_id: int, change: Callable[[], None]) -> bool:
    """Runs ``change`` in one transaction with a note of the batch; a batch that is noted already changes nothing.

    So a start from an old checkpoint, which hands the same batches out again, is harmless for every table.
    """
    stream = query_of(batch)
    if stream is not None and batch_id <= tables.last_batch(stream):
        return False
    with tables.transaction():
        change()
        if stream is not None:
            tables.note_batch(stream, batch_id)
    return True


def score_into(tables: Tables, as_of: Column | datetime, opts: MartOptions = WAREHOUSE, **scoring) -> Callable[[DataFrame, int], None]:
    """Batch handler: parse, score and insert by content hash; messages that cannot be read go to their own
    table, and the new headlines' partial daily states to ``daily_partials``, in the same commit. So the daily mart
    (``marts.daily_from_partials``) needs no headline again, however late it comes. Replays change nothing."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        headlines, rejects = parse_messages(held)
        scored = with_content_hash(score_headlines(headlines, as_of, **scoring)).persist()

        def change() -> None:
            fresh = tables.stage(tables.absent("scored_headlines", scored, [F.col("published_at_utc").desc()])[0])
            tables.append("scored_headlines", fresh)
            tables.append("daily_partials", daily_partials(fresh, opts))
            if not rejects.isEmpty():
                tables.insert_if_absent("rejected_messages", rejects.where("value IS NOT NULL"))

        try:
            once(tables, batch, batch_id, change)
        finally:
            scored.unpersist()
            held.unpersist()

    return handle


def store_and_publish(tables: Tables, publish: Callable[[DataFrame], None] | None = None) -> Callable[[DataFrame, int], None]:
    """Batch handler of the raw path: normalize, store raw by hash, publish the same rows.

    Messages go to the table ``outbox`` in the commit that stores the rows, so the two agree whatever fails.
    ``publish`` (a write to Kafka, say) is called before that commit: a batch that fails in between is published
    again, a batch that is noted is not.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch_rows = with_content_hash(normalize_headlines(batch)).persist()

        def change() -> None:
            messages = to_messages(batch_rows)
            tables.insert_if_absent("raw_headlines", batch_rows, [F.col("published_at_utc").desc()])
            tables.append("outbox", messages.select("key", "value"))
            if publish is not None:
                publish(messages)

        try:
            once(tables, batch, batch_id, change)
        finally:
            batch_rows.unpersist()

    return handle


# ---------------------------------------------------------------- bounded state forms


def dedupe_within(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Drops copies by hash that arrive within the watermark delay of each other."""
    rows = stream if "content_hash" in stream.columns else stream.withColumn("content_hash", content_hash())
    return rows.withWatermark("published_at_utc", delay).dropDuplicatesWithinWatermark(["content_hash"])


def daily_stream(scored: DataFrame, delay: str = "1 day", opts: MartOptions = WAREHOUSE) -> DataFrame:
    """All measures of the daily mart per ticker and day; a day closes once the watermark has passed it."""
    return daily_windows(scored.withWatermark("published_at_utc", delay), opts)


def sliding_stream(scored: DataFrame, lookback_days: int = 3, delay: str = "1 day") -> DataFrame:
    """Weighted score per ticker over sliding windows of lookback + 1 days that move by a day."""
    weighted = scored.withWatermark("published_at_utc", delay).withColumn("_w", row_weight())
    frame = F.window("published_at_utc", f"{lookback_days + 1} days", "1 day")
    return (weighted.groupBy("ticker", frame)
            .agg(F.count(F.lit(1)).alias("headline_count"),
                 ratio(F.sum(F.col("compound_score") * F.col("_w")), F.sum("_w")).alias("weighted_score"))
            .select("ticker", F.date_sub(F.col("window.end").cast("date"), 1).alias("insight_date"),
                    "headline_count", "weighted_score"))
