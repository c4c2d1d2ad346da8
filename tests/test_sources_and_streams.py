"""Parsers, stored tables and streams."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from newsgauge import schemas
from newsgauge.options import WAREHOUSE
from newsgauge.plans import marts
from newsgauge.operators import frames
from newsgauge.plans import insights
from newsgauge.session import shared_root, shuffle_partitions_for
from newsgauge.sources import landing, tables, versions
from newsgauge.streaming import headlines as stream


@pytest.fixture
def fresh(spark):
    return lambda name: f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def payload(spark, text, name="payload", ticker="T"):
    return spark.createDataFrame([(ticker, text)], f"ticker string, {name} string")


def test_rss_repeats_prefixes_and_breakage(spark):
    text = ("<rss xmlns:m='u'><channel><item><m:title>Media</m:title><title>Second</title><link>http://a</link><pubDate>Mon, 01 Jan 2024 01:00:00 GMT</pubDate></item>"
            "<item><title>Undated</title></item></channel></rss>")
    rdf = "<RDF><item><title>Root item</title><link>l</link><pubDate>2024-01-01T00:00:00Z</pubDate><content>c</content></item></RDF>"
    feeds = spark.createDataFrame([("f", text), ("g", "<rss><broken"), ("h", rdf)], "feed_name string, payload string")
    got = {r["title"]: r for r in landing.feed_items(feeds).collect()}
    assert set(got) == {"Media", "Root item"} and got["Media"]["source"] == "f" and got["Root item"]["summary"] == "c"


@pytest.mark.parametrize("text,score", [
    ('{"sentiment": {"bullishPercent": 0.8, "bearishPercent": 0.1}}', 0.7), ('{"sentiment": {"bullishPercent": 3, "bearishPercent": 0}}', 1.0),
    ('{"companyNewsScore": "0.25"}', 0.25), ('{"sentiment": {"bullishPercent": "x"}, "companyNewsScore": -4}', -1.0), ("{}", None), ("[1]", None)])
def test_sentiment_payloads(spark, text, score):
    got = payload(spark, text).select(landing.sentiment_score(F.col("payload"))).first()[0]
    assert got == (None if score is None else pytest.approx(score))


def test_price_payloads_without_usable_rows(spark):
    day = F.lit(dt.date(2024, 1, 31))
    for parse, text in ((landing.bar_closes, '{"results": [{"t": null, "c": 1}]}'), (landing.daily_map_closes, '{"Note": "limit"}'),
                        (landing.chart_closes, '{"chart": {"result": null}}')):
        assert parse(payload(spark, text), day).count() == 0
    assert landing.csv_closes(payload(spark, "Date,Open\n2024-01-01,3")).count() == 0
    late = '{"results": [{"t": 1706745600000, "c": 2.0}, {"t": 1704067200000, "c": 1.23456}]}'
    assert landing.bar_closes(payload(spark, late), day).first()["close_price_usd"] == 1.2346


def test_universe_and_lists(spark, fresh):
    folder = fresh("tickers")
    spark.createDataFrame([("# list",), (" aapl ",), ("",), ("msft",)], "value string").coalesce(1).write.text(folder)
    assert sorted(r[0] for r in landing.read_ticker_file(spark, folder).collect()) == ["AAPL", "MSFT"]
    listed = landing.ticker_list(spark.createDataFrame([(" a, B,,a ",)], "value string"))
    inside, outside = landing.keep_members(listed, spark.createDataFrame([("b",)], "ticker string"))
    assert [r[0] for r in inside.collect()] == ["B"] and [r[0] for r in outside.collect()] == ["A"]


def test_date_chunks(spark):
    rows = spark.createDataFrame([(1,)], "k int")
    got = [(r["chunk_start"].day, r["chunk_end"].day) for r in landing.date_chunks(rows, dt.date(2024, 1, 1), dt.date(2024, 1, 10), 4).collect()]
    assert got == [(1, 4), (5, 8), (9, 10)]
    assert landing.date_chunks(rows, dt.date(2024, 1, 2), dt.date(2024, 1, 1), 4).count() == 0


def test_heavy_windows_equal_recursion(spark):
    days = {dt.date(2024, 1, 1) + dt.timedelta(days=i): n for i, n in enumerate([0, 9, 0, 3, 3, 250, 1, 0, 0, 2, 40])}
    want = []

    def split(lo, hi):
        n = sum(v for k, v in days.items() if lo <= k <= hi)
        span = (hi - lo).days + 1
        if n >= 10 and span > 1:
            mid = lo + dt.timedelta(days=span // 2 - 1)
            split(lo, mid)
            split(mid + dt.timedelta(days=1), hi)
        else:
            want.append((lo, hi, n))

    split(min(days), max(days))
    counts = spark.createDataFrame([("T", d, n) for d, n in days.items() if n], "ticker string, day date, n bigint")
    windows = spark.createDataFrame([("T", min(days), max(days)), ("U", min(days), max(days))], "ticker string, start_date date, end_date date")
    got = landing.split_heavy_windows(counts, windows, 10).collect()
    assert sorted((r["start_date"], r["end_date"], r["n"]) for r in got if r["ticker"] == "T") == sorted(want)
    assert [(r["start_date"], r["end_date"], r["n"]) for r in got if r["ticker"] == "U"] == [(min(days), max(days), 0)]


def test_table_store(spark, fresh, utc):
    store = tables.Tables(spark, fresh("store"))
    with pytest.raises(ValueError):
        store.read("secrets")
    assert store.read("price_quotes").count() == 0
    shape = schemas.PRICE_QUOTE
    store.upsert("price_quotes", spark.createDataFrame([("A", dt.date(2024, 1, 1), 1.0, "stooq")], shape))
    store.upsert("price_quotes", spark.createDataFrame([("A", dt.date(2024, 1, 1), 2.0, "polygon"), ("B", dt.date(2024, 1, 1), 3.0, "stooq")], shape), ["close_price_usd"])
    assert {tuple(r) for r in store.read("price_quotes").select("ticker", "close_price_usd", "data_source").collect()} == {("A", 2.0, "stooq"), ("B", 3.0, "stooq")}
    rows = spark.createDataFrame([("A", "h", "s", "u", utc(2024, 1, 1, 3), None, "financial", None, None, "k1"), ("A", "h2", "s", "u", utc(2024, 1, 2), None, "financial", None, None, "k2")],
                                 schemas.TABLES["raw_headlines"])
    for _ in range(2):
        store.insert_if_absent("raw_headlines", rows.union(rows))
    assert store.read("raw_headlines").count() == 2
    assert "PartitionFilters: [isnotnull(published_day" in store.read("raw_headlines").where("published_day = date'2024-01-01'")._jdf.queryExecution().toString()
    store.append("raw_headlines", rows.limit(1).withColumn("content_hash", F.lit("k3")).withColumn("added", F.lit(1)))
    assert "added" in store.read("raw_headlines", every_column=True).columns and store.read("raw_headlines").count() == 3
    assert store.empty(["raw_headlines"]) == {"raw_headlines": 3} and store.read("raw_headlines").count() == 0


def test_upsert_keeps_first_insert_columns(spark):
    old = spark.createDataFrame([("a", 1, "first"), ("b", None, "first")], "k string, v int, made string")
    new = spark.createDataFrame([("b", 5, "second", 1), ("b", None, "third", 2), ("c", 7, "third", 3)], "k string, v int, made string, n int")
    got = {r["k"]: (r["v"], r["made"]) for r in tables.upsert(old, new, ["k"], ["v"], "n").collect()}
    assert got == {"a": (1, "first"), "b": (None, "first"), "c": (7, "third")}


def headline(ticker, text, at):
    return (ticker, text, "Reuters", "http://x", at, None, "financial", "t", None)


def test_stream_replay_adds_nothing(spark, fresh, utc):
    folder, progress = fresh("in"), fresh("progress")
    store = tables.Tables(spark, fresh("store"))
    rows = spark.createDataFrame([headline("A", "profit record", utc(2024, 1, 1)), headline("B", "lawsuit", utc(2024, 1, 2, 1))], schemas.RAW_HEADLINE)
    stream.to_messages(rows).select("value").union(spark.createDataFrame([("{bad",), ('{"ticker": "A"}',)], "value string")).write.text(folder)

    def go(where):
        stream.drain(stream.subscribe_files(spark, folder), stream.score_into(store, utc(2024, 1, 3)), where).awaitTermination()

    go(progress)
    assert store.read("scored_headlines").count() == 2
    more = spark.createDataFrame([headline("C", "growth", utc(2024, 1, 3))], schemas.RAW_HEADLINE)
    stream.to_messages(rows.union(more)).select("value").write.mode("append").text(folder)
    go(progress)
    go(fresh("progress"))  # a lost checkpoint replays everything
    stored = store.read("scored_headlines")
    assert stored.count() == 3 and {r["sentiment_label"] for r in stored.where("ticker = 'B'").collect()} == {"negative"}
    assert marts.daily_sentiment(stored, WAREHOUSE).count() == 3


def test_session_helpers(spark):
    assert shuffle_partitions_for(100 << 40, 4000) == 819200 and shuffle_partitions_for(1, 8) == 8
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"


def _headlines(spark, n, days):
    return spark.range(n).select(
        F.concat(F.lit("T"), (F.col("id") % 5).cast("string")).alias("ticker"), F.lit("h").alias("headline"), F.lit("s").alias("source"),
        F.timestamp_seconds(F.lit(1_704_067_200) + (F.col("id") % days) * 86_400).alias("published_at_utc"),
        F.sha2(F.col("id").cast("string"), 256).alias("content_hash"))


def test_stored_days_are_few_files_and_pruned(spark, fresh):
    store = tables.Tables(spark, fresh("pruned"))
    store.insert_if_absent("scored_headlines", _headlines(spark, 2_000, 9).repartition(8))
    read = store.read("scored_headlines")
    assert len(read.inputFiles()) <= 9
    for narrow in (insights.recent_headlines(read, dt.datetime(2024, 1, 8, tzinfo=dt.timezone.utc)),
                   frames.between_days_of(read, "published_at_utc", dt.date(2024, 1, 2), dt.date(2024, 1, 3))):
        plan = narrow._jdf.queryExecution().executedPlan().toString()
        assert "published_day" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_rows_without_a_day_are_inserted_once(spark, fresh):
    store = tables.Tables(spark, fresh("undated"))
    batch = _headlines(spark, 4, 2).withColumn("published_at_utc", F.when(F.col("ticker") != "T1", F.col("published_at_utc")))
    for _ in range(3):
        store.insert_if_absent("scored_headlines", batch)
    assert store.read("scored_headlines").count() == 4


QUOTE = "ticker string, quote_date date, close_price_usd double, data_source string"


def _quotes(spark, *rows):
    return spark.createDataFrame([(t, dt.date(2024, 1, day), price, "x") for t, day, price in rows], QUOTE)


def test_old_versions_go(spark, fresh):
    store = tables.Tables(spark, fresh("versions"))
    for price in (1.0, 2.0, 3.0, 4.0):
        store.upsert("price_quotes", _quotes(spark, ("A", 1, price)))
    assert store.read("price_quotes").first()["close_price_usd"] == 4.0
    assert len(store.versions.numbers()) == versions.KEPT_VERSIONS
    assert len([x for x in store.versions._names(f"{store.root}/price_quotes") if x.startswith("write=")]) == versions.KEPT_VERSIONS


def test_upsert_leaves_the_files_of_other_days(spark, fresh):
    store = tables.Tables(spark, fresh("days"))
    assert store.upsert("price_quotes", _quotes(spark, ("A", 1, 1.0), ("A", 2, 1.0), ("B", 3, 1.0), ("B", 2, 7.0))) == 4
    before = set(store.read("price_quotes").inputFiles())
    assert store.upsert("price_quotes", _quotes(spark, ("A", 2, 2.0), ("C", 2, 3.0))) == 3
    after = set(store.read("price_quotes").inputFiles())
    kept = before & after
    assert {x.split("part=")[1][:10] for x in kept} == {"2024-01-01", "2024-01-03"} and len(after - before) >= 1
    for _ in range(3):  # folders that no kept version names are deleted, the others stay
        store.upsert("price_quotes", _quotes(spark, ("A", 3, 9.0)))
    got = {(r["ticker"], r["quote_date"].day, r["close_price_usd"]) for r in store.read("price_quotes").collect()}
    assert got == {("A", 1, 1.0), ("A", 2, 2.0), ("A", 3, 9.0), ("B", 2, 7.0), ("B", 3, 1.0), ("C", 2, 3.0)}
    first = next(x for x in kept if "2024-01-01" in x)
    assert first in store.read("price_quotes").inputFiles()


def test_stored_positions_and_alerts_are_rewritten_in_place(spark, fresh):
    store = tables.Tables(spark, fresh("positions"))
    shape = "run_name string, ticker string, quantity double, avg_cost_cad double, last_price_cad double"
    store.upsert_positions(spark.createDataFrame([("r", f"T{i}", 2.0, 1.0, 3.0) for i in range(40)], shape))
    before = set(store.read("portfolio_positions").inputFiles())
    store.upsert_positions(spark.createDataFrame([("r", "T7", 0.0, 1.0, 3.0), ("r", "T8", 5.0, 1.0, 2.0)], shape))
    got = {r["ticker"]: (r["quantity"], r["market_value_cad"], r["unrealized_pnl_cad"]) for r in store.read("portfolio_positions").collect()}
    assert len(got) == 39 and got["T8"] == (5.0, 10.0, 5.0) and got["T1"] == (2.0, 6.0, 4.0)
    assert len(before & set(store.read("portfolio_positions").inputFiles())) >= len(before) - 2
    alert = [(f"g:{k}", None, "warning", k, "m", "{}", None, "open") for k in ("low_headline_coverage", "other")]
    store.upsert("health_alerts", spark.createDataFrame(alert, schemas.HEALTH_ALERT))
    store.resolve_alerts(["low_headline_coverage"])
    assert {(r["alert_type"], r["status"]) for r in store.read("health_alerts").collect()} == {("low_headline_coverage", "resolved"), ("other", "open")}


def test_transactions_commit_all_tables_or_none(spark, fresh):
    store, other = (tables.Tables(spark, root) for root in [fresh("together")] * 2)
    with store.transaction():
        store.append("price_quotes", _quotes(spark, ("A", 1, 1.0)))
        store.note_batch("s", 4)
        assert store.read("price_quotes").count() == 1 and other.read("price_quotes").count() == 0
    assert other.read("price_quotes").count() == 1 and other.last_batch("s") == 4 and other.last_batch("t") == -1
    with pytest.raises(RuntimeError, match="stop"), store.transaction():
        store.append("price_quotes", _quotes(spark, ("B", 1, 1.0)))
        raise RuntimeError("stop")
    assert store.read("price_quotes").count() == 1


def test_loads_are_counted_as_they_pass(spark, fresh):
    store = tables.Tables(spark, fresh("counts"))
    rows = _headlines(spark, 30, 3)
    assert store.insert_if_absent("scored_headlines", rows.where("ticker = 'T0'")) == tables.LoadCounts(6, 6, 6)
    assert store.insert_if_absent("scored_headlines", rows.union(rows)) == tables.LoadCounts(60, 30, 24)
    assert store.insert_if_absent("scored_headlines", rows.limit(0)) == tables.LoadCounts(0, 0, 0)
    assert store.insert_if_absent("scored_headlines", rows) == tables.LoadCounts(30, 30, 0)
    assert store.read("scored_headlines").count() == 30


def test_small_batches_do_not_shuffle_the_stored_day(spark, fresh):
    store = tables.Tables(spark, fresh("small"))
    store.append("scored_headlines", _headlines(spark, 500, 2))
    met = tables.keys_met(store.read("scored_headlines"), _headlines(spark, 20, 2), ["content_hash"], few=True)
    plan = met._jdf.queryExecution().executedPlan().toString()
    stored_side = plan[plan.index("BroadcastHashJoin"):].split("BroadcastExchange")[0]
    assert "Exchange" not in stored_side and "FileScan parquet" in stored_side and met.count() == 20


def test_unreadable_messages_are_kept(spark, fresh, utc):
    folder = fresh("messages")
    good = '{"ticker":"A","headline":"h","source":"s","url":"u","published_at_utc":"1704067200"}'
    bad = ["not json", good.replace("1704067200", "99999999999999999999"), good.replace("1704067200", "1704067200000000")]
    spark.createDataFrame([(x,) for x in [good, *bad]], "value string").coalesce(1).write.text(folder)
    store = tables.Tables(spark, fresh("store"))
    for run in range(2):
        stream.drain(stream.subscribe_files(spark, folder), stream.score_into(store, utc(2024, 1, 3)), fresh(f"at{run}")).awaitTermination()
    assert store.read("scored_headlines").count() == 1
    assert sorted(r["value"] for r in store.read("rejected_messages").collect()) == sorted(bad)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_quote_csv_is_reduced_by_hashing_and_its_header_read_once(spark):
    rows = spark.createDataFrame([
        ("A", " \nDate,Open, Close\r\n2024-01-02,1,5.5\r\n\r\n2024-01-03,1,bad\noops,1,2\n2024-01-02,2,6.5"),
        ("A", "Close,Date\n9,2023-12-31"), ("B", "Close,Date\n3, 2024-02-01 \n1e1,2024-02-02"), ("C", "Date,Open\n2024-01-01,2"),
        ("D", None), ("E", "Date,Close"), (None, "Date,Close\n1960-01-01,-Infinity")], "ticker string, payload string")
    found = landing.csv_closes(rows)
    got = {(r["ticker"], str(r["quote_date"]), r["close_price_usd"]) for r in found.collect()}
    assert got == {("A", "2024-01-02", 6.5), ("B", "2024-02-02", 10.0), (None, "1960-01-01", float("-inf"))}
    plan = _plan(found)
    assert "HashAggregate" in plan and "Window" not in plan and "SortAggregate" not in plan


def test_daily_maps_are_reduced_by_hashing_and_cast_only_what_can_be_a_number(spark):
    entry = '"%s": {"4. close": "%s", "5. adjusted close": "%s"}'
    body = ", ".join(entry % x for x in (("2024-01-02", "5", ""), ("2024-01-03", "n/a", "n/a"), ("no date", "1", "1"), ("2024-01-01", "9", "NaN")))
    rows = spark.createDataFrame([("A", '{"Time Series (Daily)": {%s}}' % body), ("B", "{}"), ("C", None)], "ticker string, payload string")
    found = landing.daily_map_closes(rows, F.lit("2024-01-31").cast("date"))
    assert [(r["ticker"], str(r["quote_date"]), r["close_price_usd"]) for r in found.collect()] == [("A", "2024-01-02", 5.0)]
    plan = _plan(found)
    assert "HashAggregate" in plan and "Window" not in plan and "(?i)[0-9]|nan|inf" in plan
