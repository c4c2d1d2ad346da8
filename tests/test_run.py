"""Runs over stored tables, and streams that start again from an old checkpoint."""

import datetime as dt
import shutil
import uuid

import pytest
from pyspark.sql import functions as F

from newsgauge import schemas
from newsgauge.plans import run
from newsgauge.session import shared_root
from newsgauge.sources import tables
from newsgauge.streaming import headlines as stream


@pytest.fixture
def fresh(spark):
    return lambda name: f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _raw(spark, utc, *rows):
    return spark.createDataFrame([(t, h, "Reuters", f"http://x/{i}", utc(2024, 1, day), None, "financial", "t", None)
                                  for i, (t, h, day) in enumerate(rows)], schemas.RAW_HEADLINE)


def test_a_run_stores_all_tables_and_a_second_one_goes_on(spark, fresh, utc):
    store = tables.Tables(spark, fresh("run"))
    quotes = spark.createDataFrame([(t, dt.date(2024, 1, day), price, "polygon") for t, day, price in
                                    (("UP", 2, 100.0), ("UP", 7, 110.0), ("DOWN", 2, 50.0), ("DOWN", 7, 40.0))], schemas.PRICE_QUOTE)
    accounts = spark.createDataFrame([("fund", 5000.0)], "run_name string, starting_cash_cad double")
    raw = _raw(spark, utc, ("UP", "record profit and strong growth beat", 1), ("UP", "upgrade after record growth", 2), ("DOWN", "lawsuit and fraud losses", 2))
    counts = run.run_over_tables(store, "r1", raw.union(raw), quotes, utc(2024, 1, 2, 12), accounts)
    assert (counts.headlines_fetched, counts.headlines_after_dedupe, counts.raw_saved, counts.scored_saved, counts.insights_generated) == (6, 3, 3, 3, 2)
    assert {(r["ticker"], r["signal_label"]) for r in store.read("insights").collect()} == {("UP", "positive"), ("DOWN", "negative")}
    trades = store.read("portfolio_trades").collect()
    assert [(r["ticker"], r["side"], r["fee_cad"]) for r in trades] == [("UP", "buy", 0.0)] and counts.trades_executed == 1
    assert store.read("portfolio_positions").first()["ticker"] == "UP"
    assert {r["ticker"] for r in store.read("price_quotes").collect()} == {"UP", "DOWN"}
    later = _raw(spark, utc, ("UP", "fraud lawsuit and bankruptcy losses", 8))
    counts = run.run_over_tables(store, "r2", raw.union(later), quotes, utc(2024, 1, 8, 12), accounts)
    assert (counts.raw_saved, counts.scored_saved, counts.insights_generated) == (1, 1, 1)
    moves = {(r["ticker"], r["insight_date"].day, r["evaluation_date"].day): r["forward_return_pct"] for r in store.read("insight_evaluations").collect()}
    assert moves["UP", 2, 7] == 10.0 and moves["DOWN", 2, 7] == -20.0
    assert {r["side"] for r in store.read("portfolio_trades").where("ticker = 'UP'").collect()} == {"buy", "sell"}
    assert store.read("portfolio_positions").count() == 0 and store.read("portfolio_snapshots").count() == 2
    assert {(r["run_id"], r["status"], r["scored_headlines"]) for r in store.read("run_logs").collect()} == {("r1", "success", 3), ("r2", "success", 1)}
    opened = {r["alert_key"]: r["status"] for r in store.read("health_alerts").collect()}
    assert opened["r1:low_headline_coverage"] == "resolved" and opened["r2:low_headline_coverage"] == "open"


def test_a_failed_run_leaves_its_log_and_alert_only(spark, fresh, utc):
    store = tables.Tables(spark, fresh("failed"))

    def broken(rows):
        raise ValueError("no model")

    quotes = spark.createDataFrame([], schemas.PRICE_QUOTE)
    with pytest.raises(ValueError, match="no model"):
        run.run_over_tables(store, "r1", _raw(spark, utc, ("A", "h", 1)), quotes, utc(2024, 1, 2), score=broken)
    assert store.read("raw_headlines").count() == 0
    logged = store.read("run_logs").first()
    assert (logged["status"], logged["error_message"]) == ("failed", "ValueError: no model")
    assert [(r["alert_key"], r["severity"]) for r in store.read("health_alerts").collect()] == [("r1:pipeline_failed", "critical")]


def test_an_old_checkpoint_changes_nothing(spark, fresh, utc):
    store, source, progress = tables.Tables(spark, fresh("tables")), fresh("raw"), fresh("progress")
    rows = _raw(spark, utc, ("A", "one", 1), ("B", "two", 2))
    rows.write.parquet(source)
    published = []

    def go(where):
        handler = stream.store_and_publish(store, lambda m: published.append(m.count()))
        stream.drain(spark.readStream.schema(rows.schema).parquet(source), handler, where).awaitTermination()

    go(progress)
    shutil.rmtree(f"{progress.removeprefix('file:')}/commits")
    go(progress)
    assert store.read("raw_headlines").count() == 2 and store.read("outbox").count() == 2 and published == [2]
    go(fresh("progress"))  # another checkpoint is another stream: rows are known by hash, messages are sent again
    assert store.read("raw_headlines").count() == 2 and store.read("outbox").count() == 4


def test_counters_are_rows(spark, fresh):
    got = run.counters(tables.Tables(spark, fresh("c")), run.RunCounts(3, 2, 1)).collect()
    assert [(r["stage"], r["n"]) for r in got][:3] == [("headlines_fetched", 3), ("headlines_after_dedupe", 2), ("raw_saved", 1)]


def test_a_load_goes_over_its_raw_rows_once(spark):
    import datetime as dt
    import uuid

    from pyspark.sql import functions as F

    from newsgauge.plans import run
    from newsgauge.session import shared_root
    from newsgauge.sources import tables

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    rows = spark.createDataFrame([("A", f"h{i % 3}", "s", "u", "2024-01-20T00:00:00Z") for i in range(6)],
                                 "ticker string, headline string, source string, url string, published_at_utc string")
    store = tables.Tables(spark, f"{shared_root(spark).rstrip('/')}/once-{uuid.uuid4().hex}")
    counts = run.load_headlines(store, rows.withColumn("headline", counted("headline")), dt.datetime(2024, 1, 21, tzinfo=dt.timezone.utc))
    assert (counts.headlines_fetched, counts.headlines_after_dedupe, counts.raw_saved, counts.scored_saved) == (6, 3, 3, 3)
    assert seen.value == 6
