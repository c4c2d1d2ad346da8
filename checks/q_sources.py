"""Landing parsers, text matching, table maintenance. Payloads are built from the tables row by row."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from checks import adapters as a
from checks.registry import register
from newsgauge.functions import fixed_values as fixed
from newsgauge.operators import matching
from newsgauge.plans import ingest
from newsgauge.session import shared_root
from newsgauge.sources import landing, tables

# ---------------------------------------------------------------- news payloads


def _s(column):
    return F.col(column).cast("string")


def news_payloads(spark, d):
    """Three news items per event: a full one, one without source, one without date."""
    e = a.table(spark, d, "events")
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    full = F.struct(F.col("props").alias("headline"), F.col("event_type").alias("source"), F.lit("http://n/1").alias("url"), at.alias("datetime"))
    bare = F.struct(F.concat(F.lit("second "), "props").alias("headline"), F.lit(None).cast("string").alias("source"),
                    F.lit(None).cast("string").alias("url"), (at + 60).alias("datetime"))
    undated = F.struct(F.lit("never").alias("headline"), F.lit("x").alias("source"), F.lit("y").alias("url"), F.lit(None).cast("bigint").alias("datetime"))
    return e.select(F.concat(F.lit("T"), _s("user_id")).alias("ticker"), F.to_json(F.array(full, bare, undated)).alias("payload"))


NEWS = """news AS (
  SELECT 'T' || user_id AS ticker, props AS headline, event_type AS source, 'http://n/1' AS url, date_trunc('second', ts) AS published_at_utc FROM events
  UNION ALL SELECT 'T' || user_id, 'second ' || props, '', '', date_trunc('second', ts) + INTERVAL 60 SECOND FROM events)"""


@register("s06_s07_company_news_payloads", "ticker headline source url published_at_utc:t", "SELECT * FROM news", (NEWS,))
def _(spark, d):
    return landing.company_news(news_payloads(spark, d))


@register("s08_sentiment_payload_scores", "event_id:i score:f", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN greatest(least(value / 10, 1), -1) WHEN 1 THEN greatest(least(value / 50 - 0.3, 1), -1)
  WHEN 2 THEN greatest(least(value / 20 - 1, 1), -1) END AS score FROM events""")
def _(spark, d):
    e = a.table(spark, d, "events")
    v, kind = F.col("value"), F.col("event_id") % 4

    def js(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    payload = (F.when(kind == 0, js('{"companyNewsScore": ', v / 10, ', "sentiment": {"bullishPercent": "n/a", "bearishPercent": 0.1}}'))
               .when(kind == 1, js('{"sentiment": {"bullishPercent": ', v / 50, ', "bearishPercent": 0.3}, "companyNewsScore": 0.9}'))
               .when(kind == 2, js('{"companyNewsScore": "', v / 20 - 1, '"}')).otherwise(F.lit('{"sentiment": null}')))
    return e.select("event_id", landing.sentiment_score(payload).alias("score"))


def feed_payloads(spark, d):
    """One small feed per page: RSS, Atom, prefixed Atom or a broken document."""
    p = a.table(spark, d, "pages")
    n, url = F.col("page_id"), F.col("url")
    safe = F.replace(url, F.lit("&"), F.lit("&amp;"))
    day = F.lpad((n % 28 + 1).cast("string"), 2, "0")

    def cat(*parts):
        return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])

    rss = cat('<?xml version="1.0"?><rss version="2.0"><channel><title>feed</title><item><title>First  ', n, '</title><link>', safe,
              '</link><pubDate>Mon, ', (n % 28 + 1), ' Jan 2024 10:00:00 GMT</pubDate><source url="http://s">Wire</source>',
              '<description>about ', n, '</description></item><item><title>No date</title><link>x</link></item>',
              '<item><title>Third ', n, '</title><pubDate>2024-01-', day, 'T11:00:00Z</pubDate></item>',
              '<item><title>Cut ', n, '</title><pubDate>2024-01-', day, 'T12:00:00Z</pubDate></item></channel></rss>')
    atom = cat('<feed xmlns="http://www.w3.org/2005/Atom"><title>t</title><entry><title>Entry ', n, '</title><link href="', safe,
               '"/><updated>2024-01-', day, 'T10:00:00+02:00</updated><summary>sum ', n, '</summary></entry></feed>')
    prefixed = cat('<a:feed xmlns:a="http://www.w3.org/2005/Atom"><a:entry><a:title>Pre ', n, '</a:title><a:link href="', safe,
                   '"/><a:published>2024-01-', day, 'T09:00:00Z</a:published><a:content>body</a:content></a:entry></a:feed>')
    broken = cat('<rss><channel><item><title>Broken ', n)
    return p.select("page_id", F.concat(F.lit("Feed "), (n % 5).cast("string")).alias("feed_name"),
                    F.when(n % 4 == 0, rss).when(n % 4 == 1, atom).when(n % 4 == 2, prefixed).otherwise(broken).alias("payload"))


FEEDS = """feed_items AS (
  SELECT page_id, 'Feed ' || (page_id % 5) AS feed_name, 0 AS position, 'First ' || page_id AS title, url AS link, 'Wire' AS source,
    TIMESTAMP '2024-01-01 10:00:00' + to_days(CAST(page_id % 28 AS INTEGER)) AS published_at_utc, 'about ' || page_id AS summary FROM pages WHERE page_id % 4 = 0
  UNION ALL SELECT page_id, 'Feed ' || (page_id % 5), 2, 'Third ' || page_id, '', 'Feed ' || (page_id % 5),
    TIMESTAMP '2024-01-01 11:00:00' + to_days(CAST(page_id % 28 AS INTEGER)), NULL FROM pages WHERE page_id % 4 = 0
  UNION ALL SELECT page_id, 'Feed ' || (page_id % 5), 0, 'Entry ' || page_id, url, 'Feed ' || (page_id % 5),
    TIMESTAMP '2024-01-01 08:00:00' + to_days(CAST(page_id % 28 AS INTEGER)), 'sum ' || page_id FROM pages WHERE page_id % 4 = 1
  UNION ALL SELECT page_id, 'Feed ' || (page_id % 5), 0, 'Pre ' || page_id, url, 'Feed ' || (page_id % 5),
    TIMESTAMP '2024-01-01 09:00:00' + to_days(CAST(page_id % 28 AS INTEGER)), 'body' FROM pages WHERE page_id % 4 = 2)"""
ITEM = "page_id:i position:i title link source published_at_utc:t summary"


@register("s09_w15_feed_documents", ITEM, "SELECT * FROM feed_items", (FEEDS,))
def _(spark, d):
    return landing.feed_items(feed_payloads(spark, d), per_feed=3)


@register("p10_feed_items_in_lookback", ITEM, "SELECT * FROM feed_items WHERE published_at_utc >= TIMESTAMP '2024-01-24'", (FEEDS,))
def _(spark, d):
    return landing.published_since(landing.feed_items(feed_payloads(spark, d), per_feed=3), a.clock(), 7)


# ---------------------------------------------------------------- price payloads


def _lines(spark, d):
    l = a.table(spark, d, "lineitem")
    return l.select(F.concat_ws("-", _s("l_orderkey"), _s("l_linenumber"), _s("l_partkey"), _s("l_extendedprice")).alias("ticker"),
                    F.col("l_shipdate").cast("date").alias("day"), F.round(F.col("l_extendedprice") / 3, 3).alias("price"))


CUT = dt.date(1999, 6, 30)


def _closes_sql(source: str, second: str, third: str, digits: int | None, cut: bool = True) -> str:
    """Three bars per line item: its day, ten days on, and one that is not usable."""
    price = "round(l_extendedprice / 3, 3)"
    shown = f"round({price}, {digits})" if digits else price
    more = f"round({price} + 1.25, {digits})" if digits else f"{price} + 1.25"
    where = f"WHERE day <= DATE '{CUT}'" if cut else ""
    later = f"day + 10 <= DATE '{CUT}'" if cut else "TRUE"
    return f"""SELECT ticker, CASE WHEN {later} THEN day + 10 ELSE day END AS quote_date,
      CASE WHEN {later} THEN {more} ELSE {shown} END AS close_price_usd, '{source}' AS data_source
    FROM (SELECT *, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_extendedprice AS ticker, CAST(l_shipdate AS DATE) AS day FROM lineitem) {where}
    QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY day DESC) = 1"""


CLOSE = "ticker quote_date:d close_price_usd:f data_source"


@register("s10_bar_payloads", CLOSE, _closes_sql("polygon", "", "", 4))
def _(spark, d):
    def bar(day, close):
        return F.struct((F.unix_seconds(day.cast("timestamp")) * 1000 + 43200000).alias("t"), close.alias("c"))

    day, price = F.col("day"), F.col("price")
    rows = _lines(spark, d).select("ticker", F.to_json(F.struct(F.array(
        bar(F.date_add(day, 10), price + 1.25), bar(day, price), bar(F.date_add(day, 11), F.lit(None).cast("double"))).alias("results"))).alias("payload"))
    return landing.bar_closes(rows, F.lit(CUT))


@register("s11_daily_map_payloads", CLOSE, _closes_sql("alpha_vantage", "", "", 4))
def _(spark, d):
    day, price = F.col("day"), F.col("price")

    def entry(when, adjusted, close):
        return F.concat(F.lit('"'), when.cast("string"), F.lit('": {"4. close": "'), close.cast("string"),
                        F.lit('", "5. adjusted close": "'), adjusted.cast("string"), F.lit('"}'))

    body = F.concat_ws(", ", entry(day, price, price * 2), entry(F.date_add(day, 10), F.lit(""), price + 1.25),
                       entry(F.date_add(day, 11), F.lit("n/a"), price), entry(F.lit("not a date"), price, price))
    rows = _lines(spark, d).select("ticker", F.concat(F.lit('{"Time Series (Daily)": {'), body, F.lit("}}")).alias("payload"))
    return landing.daily_map_closes(rows, F.lit(CUT))


@register("s12_chart_payloads", CLOSE, _closes_sql("yahoo_chart", "", "", 4))
def _(spark, d):
    day, price = F.col("day"), F.col("price")
    stamps = F.array(*[F.unix_seconds(F.date_add(day, n).cast("timestamp")) + 52200 for n in (0, 10, 11)])
    closes = F.array(price, price + 1.25, F.lit(None).cast("double"))
    rows = _lines(spark, d).select("ticker", F.to_json(F.struct(F.struct(F.array(F.struct(
        stamps.alias("timestamp"), F.struct(F.array(F.struct(closes.alias("close"))).alias("quote")).alias("indicators"))).alias("result"))
        .alias("chart"))).alias("payload"))
    return landing.chart_closes(rows, F.lit(CUT))


@register("s13_quote_csv_payloads", CLOSE, _closes_sql("stooq", "", "", None, cut=False))
def _(spark, d):
    day, price = F.col("day"), F.col("price")
    text = F.concat_ws("\n", F.lit("Date,Open,Close"), F.concat_ws(",", day.cast("string"), F.lit("1"), price.cast("string")),
                       F.concat_ws(",", F.date_add(day, 10).cast("string"), F.lit("1"), (price + 1.25).cast("string")),
                       F.concat_ws(",", F.date_add(day, 11).cast("string"), F.lit("1"), F.lit("bad")), F.lit("oops,1,3.5"))
    return landing.csv_closes(_lines(spark, d).select("ticker", text.alias("payload")))


# ---------------------------------------------------------------- lists, universe, request plans


@register("s14_ticker_lists_from_text", "ticker n:i", """
SELECT upper(replace(c_mktsegment, ' ', '')) AS ticker, count(*) AS n FROM customer GROUP BY 1
UNION ALL SELECT 'N' || c_nationkey, count(*) FROM customer GROUP BY 1""")
def _(spark, d):
    texts = a.table(spark, d, "customer").select(F.concat(
        F.lit(" "), F.lower("c_mktsegment"), F.lit(", ,n"), _s("c_nationkey"), F.lit(" ,# c"), _s("c_custkey")).alias("value"))
    return landing.ticker_list(texts).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


@register("p15_u06_u07_universe_members_and_outsiders", "ticker member:b", """
SELECT DISTINCT s.ticker, s.ticker IN (SELECT 'T' || c_custkey FROM customer WHERE c_acctbal > 3000) AS member FROM scored s""", (a.SCORED,))
def _(spark, d):
    universe = a.table(spark, d, "customer").where("c_acctbal > 3000").select(F.concat(F.lit("t"), _s("c_custkey"), F.lit(" ")).alias("ticker"))
    listed = a.scored(spark, d).select(F.concat(F.lit(" "), F.lower("ticker")).alias("ticker"), "event_id")
    inside, outside = landing.keep_members(listed, universe, "event_id")
    return inside.select("ticker", F.lit(True).alias("member")).union(outside.select("ticker", F.lit(False)))


@register("c24_inclusive_date_chunks", "c_custkey:i chunk_start:d chunk_end:d", """
SELECT c_custkey, CAST(g AS DATE) AS chunk_start, least(CAST(g AS DATE) + 13, DATE '2024-03-10' + CAST(c_custkey % 7 AS INTEGER)) AS chunk_end
FROM customer, LATERAL (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-03-10' + to_days(CAST(c_custkey % 7 AS INTEGER)), INTERVAL 14 DAY)) AS g)""")
def _(spark, d):
    end = F.date_add(F.lit("2024-03-10").cast("date"), (F.col("c_custkey") % 7).cast("int"))
    return landing.date_chunks(a.table(spark, d, "customer").select("c_custkey"), F.lit("2024-01-01").cast("date"), end, 14)


@register("c25_split_heavy_windows", "ticker start_date:d end_date:d n:i", """
SELECT ticker, s AS start_date, e AS end_date, n FROM halves WHERE n < 6 OR s = e""", (a.SCORED, """per_day AS (
  SELECT ticker, CAST(published_at_utc AS DATE) AS d, count(*) AS n FROM scored GROUP BY 1, 2),
halves AS (
  SELECT t.ticker, DATE '2024-01-01' AS s, DATE '2024-01-30' AS e, coalesce((SELECT sum(p.n) FROM per_day p WHERE p.ticker = t.ticker), 0)::BIGINT AS n
  FROM (SELECT DISTINCT ticker FROM scored) t
  UNION ALL
  SELECT * FROM (SELECT ticker, s, e, coalesce((SELECT sum(p.n) FROM per_day p WHERE p.ticker = q.ticker AND p.d BETWEEN q.s AND q.e), 0)::BIGINT AS n FROM (
    SELECT ticker, CASE k WHEN 0 THEN s ELSE s + days // 2 END AS s, CASE k WHEN 0 THEN s + days // 2 - 1 ELSE e END AS e FROM (
      SELECT *, CAST(e - s + 1 AS INTEGER) AS days FROM halves WHERE n >= 6 AND s < e), (SELECT unnest([0, 1]) AS k)) q))"""))
def _(spark, d):
    counts = a.scored(spark, d).groupBy("ticker", F.col("published_at_utc").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    windows = counts.select("ticker").distinct().select(
        "ticker", F.lit("2024-01-01").cast("date").alias("start_date"), F.lit("2024-01-30").cast("date").alias("end_date"))
    return landing.split_heavy_windows(counts, windows, 6)


# ---------------------------------------------------------------- matching


def doc_items(spark, d):
    docs = a.table(spark, d, "documents")
    return docs.select("doc_id", F.split("text", "\n", 2).getItem(0).alias("title"), F.col("text").alias("summary"), "source",
                       F.concat(F.lit("http://doc/"), _s("doc_id")).alias("link"),
                       F.lit("2024-01-20 00:00:00").cast("timestamp").alias("published_at_utc"))


# Symbols are words of the invented prose; names are parts of words.
MATCH_TICKERS = ["THE", "AND", "OF", "A.ND", "HASH", "LES", "ZZZZ", "IS"]
MATCH_NAMES = [("THE", "Ation"), ("HASH", "hation onst"), ("LES", "réaux"), ("IS", "oute")]


def _match_frames(spark):
    return (spark.createDataFrame([(t,) for t in MATCH_TICKERS], "ticker string"),
            spark.createDataFrame(MATCH_NAMES, "ticker string, name string"))


_PAIRS_SQL = """match_pairs AS (
  SELECT doc_id, title, text, ticker FROM (SELECT doc_id, string_split(text, chr(10))[1] AS title, text,
      lower(string_split(text, chr(10))[1] || ' ' || text) AS body FROM documents) d, (VALUES %s) t(ticker, name)
  WHERE contains(body, '$' || lower(replace(ticker, '.', '')))
    OR (len(replace(ticker, '.', '')) > 2 AND (contains(' ' || body || ' ', ' ' || lower(ticker) || ' ')
      OR contains(' ' || body || ' ', ' ' || lower(replace(ticker, '.', '')) || ' ')))
    OR (name IS NOT NULL AND contains(body, lower(name))))""" % ", ".join(
    f"('{t}', {repr(dict(MATCH_NAMES)[t]) if t in dict(MATCH_NAMES) else 'NULL::VARCHAR'})" for t in MATCH_TICKERS)


@register("j07_match_tickers_in_texts", "doc_id:i ticker", "SELECT doc_id, ticker FROM match_pairs", (_PAIRS_SQL,))
def _(spark, d):
    listed, names = _match_frames(spark)
    return matching.match_tickers(doc_items(spark, d), listed, ["doc_id"], names)


@register("j07_match_many_names_by_grams", "doc_id:i ticker", "SELECT DISTINCT doc_id, ticker FROM match_pairs WHERE name IS NOT NULL AND contains(body, lower(name))",
          (_PAIRS_SQL.replace("doc_id, title, text, ticker FROM", "doc_id, body, name, ticker FROM"),))
def _(spark, d):
    _, names = _match_frames(spark)
    items = doc_items(spark, d).withColumn("_search", matching.search_text())
    return matching.phrase_matches(items, names, ["doc_id"], "_search")


@register("j07_match_thousands_of_names", "doc_id:i ticker", """
SELECT DISTINCT d.doc_id, 'N' || n.doc_id AS ticker
FROM (SELECT doc_id, lower(string_split(text, chr(10))[1] || ' ' || text) AS body FROM documents) d
JOIN (SELECT doc_id, lower(string_split(text, ' ')[2] || ' ' || string_split(text, ' ')[3]) AS name FROM documents
  WHERE len(string_split(text, ' ')) > 3) n ON contains(d.body, n.name)""")
def _(spark, d):
    words = F.split("text", " ", 4)  # the rest of a text stays in one piece
    names = a.table(spark, d, "documents").where(F.size(words) > 3).select(
        F.concat(F.lit("N"), _s("doc_id")).alias("ticker"), F.concat_ws(" ", words[1], words[2]).alias("name"))
    items = doc_items(spark, d).withColumn("_search", matching.search_text())
    return matching.phrase_matches(items, names, ["doc_id"], "_search")


@register("j07_legacy_raw_symbol_match", "doc_id:i ticker", """
SELECT doc_id, ticker FROM match_pairs UNION SELECT doc_id, ticker FROM (SELECT doc_id, lower(string_split(text, chr(10))[1] || ' ' || text) AS body FROM documents) d,
  (VALUES ('AND'), ('OF'), ('A.ND'), ('ZZZZ')) t(ticker) WHERE contains(body, lower(ticker))""", (_PAIRS_SQL,))
def _(spark, d):
    listed, names = _match_frames(spark)
    return matching.match_tickers(doc_items(spark, d), listed, ["doc_id"], names, legacy_match=True)


# Topics over the invented prose, and the standing ones over the same texts.
OWN_TOPICS = [("articles", "words", ["the ", "les "]), ("endings", "parts", ["ation onst", "hablend", "ouèa"]), ("nothing", "words", ["qqqq"])]
OWN_SPREAD = {"words": ["AAA", "BBB", "CCC"], "parts": ["BBB", "DDD"]}


def _topics_sql(topics, spread, where: str) -> str:
    parts = []
    for topic, industry, words in topics:
        hit = " OR ".join(f"contains(folded, '{w}')" for w in words)
        listed = ", ".join(f"('{t}')" for t in spread[industry])
        parts.append(f"""SELECT doc_id, ticker, '{topic}' AS topic, '{industry}' AS industry FROM topic_docs, (VALUES {listed}) t(ticker)
          WHERE ({hit}) AND {where}""")
    return " UNION ALL ".join(parts)


TOPIC_DOCS = """topic_docs AS (SELECT doc_id, replace(replace(lower(string_split(text, chr(10))[1] || ' ' || text), 'ß', 'ss'), 'ς', 'σ') AS folded FROM documents)"""


@register("j08_u06_policy_topics_own", "url ticker topic industry",
          f"SELECT 'http://doc/' || doc_id AS url, * FROM ({_topics_sql(OWN_TOPICS, OWN_SPREAD, chr(40) + 'ticker <> ' + chr(39) + 'CCC' + chr(39) + chr(41))})", (TOPIC_DOCS,))
def _(spark, d):
    selected = spark.createDataFrame([("aaa",), ("BBB",), ("DDD",)], "ticker string")
    return matching.fan_out_topics(doc_items(spark, d), selected, OWN_TOPICS, OWN_SPREAD)


@register("j08_policy_topics_standing", "url ticker topic industry",
          f"SELECT 'http://doc/' || doc_id AS url, * FROM ({_topics_sql(fixed.POLICY_TOPICS, fixed.INDUSTRY_TICKERS, 'TRUE')})", (TOPIC_DOCS,))
def _(spark, d):
    every = spark.createDataFrame([(t,) for ts in fixed.INDUSTRY_TICKERS.values() for t in ts], "ticker string")
    return matching.fan_out_topics(doc_items(spark, d), every)


@register("j09_topic_search_results_fan_out", "url ticker topic industry headline category", """
SELECT 'http://doc/' || doc_id AS url, t.ticker, p.topic, p.industry, string_split(text, chr(10))[1] AS headline, 'political' AS category
FROM documents JOIN (VALUES ('en', 'words'), ('fr', 'parts')) p(topic, industry) ON lang = topic
JOIN (VALUES ('words', 'AAA'), ('words', 'BBB'), ('parts', 'BBB')) t(industry, ticker) ON t.industry = p.industry""")
def _(spark, d):
    docs = doc_items(spark, d).join(a.table(spark, d, "documents").select("doc_id", F.col("lang").alias("topic")), "doc_id")
    topics = matching.topic_dimension(spark, [("en", "words", ["x"]), ("fr", "parts", ["y"])], OWN_SPREAD)
    selected = spark.createDataFrame([("AAA",), ("bbb",)], "ticker string")
    return matching.fan_out_topic_queries(docs, selected, topics)


@register("u01_w16_collect_from_all_feeds", "ticker url category topic", """
SELECT * FROM (SELECT ticker, 'http://doc/' || doc_id AS url, 'financial' AS category, 'market_news' AS topic, title, 0 AS place FROM match_pairs
  UNION ALL SELECT ticker, 'http://doc/' || x.doc_id, 'political', topic, string_split(d.text, chr(10))[1], 1
  FROM (%s) x JOIN documents d ON d.doc_id = x.doc_id)
QUALIFY row_number() OVER (PARTITION BY ticker, lower(title), url, category ORDER BY place, topic) = 1"""
          % _topics_sql([("articles", "words", ["the ", "les "])], {"words": ["THE", "AND"]}, "TRUE"), (_PAIRS_SQL, TOPIC_DOCS))
def _(spark, d):
    listed, names = _match_frames(spark)
    items = doc_items(spark, d)
    market = matching.financial_rows(items, matching.match_tickers(items, listed, ["doc_id"], names), ["doc_id"], "market_news")
    policy = matching.fan_out_topics(items, listed, [("articles", "words", ["the ", "les "])], {"words": ["THE", "AND"]})
    return ingest.collect_headlines(market, policy, market)


# ---------------------------------------------------------------- table maintenance

# The stored table is all before the 20th, the batch all from the 10th on: ten days overlap.
def _target_and_batch(spark, d):
    rows = a.scored(spark, d).select("event_id", "ticker", "source", "published_at_utc", "compound_score", "content_hash")
    at = F.col("published_at_utc")
    return (rows.where(at < F.lit("2024-01-20").cast("timestamp")).withColumn("origin", F.lit("stored")),
            rows.where(at >= F.lit("2024-01-10").cast("timestamp")).withColumn("origin", F.lit("batch")))


MERGE = """stored AS (SELECT *, 'stored' AS origin FROM scored WHERE published_at_utc < TIMESTAMP '2024-01-20'),
batch AS (SELECT *, 'batch' AS origin FROM scored WHERE published_at_utc >= TIMESTAMP '2024-01-10')"""


@register("s15_j13_insert_if_absent", "event_id:i origin", """
SELECT event_id, origin FROM stored UNION ALL SELECT event_id, origin FROM batch WHERE content_hash NOT IN (SELECT content_hash FROM stored)""",
          (a.SCORED, MERGE))
def _(spark, d):
    target, batch = _target_and_batch(spark, d)
    return tables.insert_if_absent(target, batch.unionByName(batch), ["content_hash"], [F.col("event_id")])


@register("s02_s15_stored_table_filled_twice", "ticker source published_at_utc:t content_hash", """
SELECT ticker, source, published_at_utc, content_hash FROM scored
UNION ALL SELECT ticker, source, NULL, content_hash || '-undated' FROM scored WHERE event_id % 10 = 0""", (a.SCORED,))
def _(spark, d):
    store = tables.Tables(spark, _fresh(spark, "stored"))
    rows = a.scored(spark, d)
    undated = rows.where("event_id % 10 = 0").withColumns({
        "content_hash": F.concat("content_hash", F.lit("-undated")), "published_at_utc": F.lit(None).cast("timestamp")})
    every = rows.unionByName(undated).drop("event_id")
    for batch in (every.where("published_at_utc < '2024-01-15' OR ticker LIKE '%1'"), every, every):
        store.insert_if_absent("scored_headlines", batch)
    return store.read("scored_headlines")


@register("s16_staged_merge_newest_per_key", "ticker source event_id:i origin", """
SELECT ticker, source, event_id, origin FROM (SELECT * FROM stored QUALIFY row_number() OVER (PARTITION BY ticker, source ORDER BY published_at_utc) = 1)
UNION ALL SELECT ticker, source, event_id, origin FROM (SELECT * FROM batch QUALIFY row_number() OVER (PARTITION BY ticker, source ORDER BY published_at_utc DESC) = 1) b
WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.ticker = b.ticker AND s.source = b.source)""", (a.SCORED, MERGE))
def _(spark, d):
    target, batch = _target_and_batch(spark, d)
    from newsgauge.operators.keyed import first_rows

    stored = first_rows(target, ["ticker", "source"], [F.col("published_at_utc")])
    return tables.staged_merge(stored, batch, ["ticker", "source"])


@register("s17_s26_upsert_last_of_batch_wins", "ticker source first_seen:t score:f origin extra:i", """
SELECT coalesce(s.ticker, b.ticker) AS ticker, coalesce(s.source, b.source) AS source, coalesce(s.published_at_utc, b.published_at_utc) AS first_seen,
  coalesce(b.compound_score, s.compound_score) AS score, coalesce(b.origin, s.origin) AS origin, b.event_id AS extra
FROM (SELECT * FROM stored QUALIFY row_number() OVER (PARTITION BY ticker, source ORDER BY event_id) = 1) s
FULL JOIN (SELECT * FROM batch QUALIFY row_number() OVER (PARTITION BY ticker, source ORDER BY event_id DESC) = 1) b
  ON s.ticker = b.ticker AND s.source = b.source""", (a.SCORED, MERGE))
def _(spark, d):
    from newsgauge.operators.keyed import first_rows

    target, batch = _target_and_batch(spark, d)
    shape = ["ticker", "source", F.col("published_at_utc").alias("first_seen"), F.col("compound_score").alias("score"), "origin"]
    stored = first_rows(target, ["ticker", "source"], [F.col("event_id")]).select(*shape)
    updates = batch.select(*shape, F.col("event_id").alias("extra"), F.col("event_id").alias("batch_order"))
    return tables.upsert(stored, updates, ["ticker", "source"], ["score", "origin", "extra"], "batch_order")


@register("s18_position_upsert_or_delete", "run_name ticker quantity:m avg_cost_cad:m market_value_cad:m unrealized_pnl_cad:m", """
SELECT *, quantity * last_price_cad AS market_value_cad, quantity * last_price_cad - quantity * avg_cost_cad AS unrealized_pnl_cad FROM (
  SELECT p.run_name, p.ticker, CASE WHEN s.ticker IS NULL THEN p.quantity ELSE greatest(p.quantity - s.sold, 0) END AS quantity,
    p.avg_cost_cad, p.last_price_cad
  FROM positions p LEFT JOIN (SELECT run_name, ticker, sum(quantity) AS sold FROM trades WHERE side = 'sell' GROUP BY 1, 2) s
    ON s.run_name = p.run_name AND s.ticker = p.ticker) WHERE quantity > 1e-9""", (a.TRADES, a.POSITIONS))
def _(spark, d):
    held = a.positions(spark, d)
    sold = a.trades(spark, d).where("side = 'sell'").groupBy("run_name", "ticker").agg(F.sum("quantity").alias("sold"))
    updates = held.join(sold, ["run_name", "ticker"]).select(
        "run_name", "ticker", F.greatest(F.col("quantity") - F.col("sold"), F.lit(0.0)).alias("quantity"), "avg_cost_cad", "last_price_cad")
    return tables.upsert_positions(held, updates)


@register("s17_s24_run_logs_stored_twice", "run_id started_at_utc:t finished_at_utc:t status raw_headlines_collected:i insights_generated:i error_message", """
SELECT run_id, started_at_utc - INTERVAL 1 HOUR AS started_at_utc, finished_at_utc, status, raw AS raw_headlines_collected, made AS insights_generated, error_message
FROM run_logs""", (a.RUN_LOGS,))
def _(spark, d):
    """Every run is logged when it starts and again when it ends: the start stays, the rest is taken over."""
    store = tables.Tables(spark, _fresh(spark, "logs"))
    ended = tables.run_log_rows(a.run_logs(spark, d))
    started = ended.select("run_id", "run_type", (F.col("started_at_utc") - F.expr("INTERVAL 1 HOUR")).alias("started_at_utc"), F.lit("running").alias("status"))
    store.upsert("run_logs", started)
    store.upsert("run_logs", ended, tables.RUN_LOG_UPDATES)
    return store.read("run_logs")


@register("s18_positions_stored_and_sold", "run_name ticker quantity:m avg_cost_cad:m market_value_cad:m unrealized_pnl_cad:m", """
SELECT *, quantity * last_price_cad AS market_value_cad, quantity * last_price_cad - quantity * avg_cost_cad AS unrealized_pnl_cad FROM (
  SELECT p.run_name, p.ticker, CASE WHEN s.ticker IS NULL THEN p.quantity ELSE greatest(p.quantity - s.sold, 0) END AS quantity,
    p.avg_cost_cad, p.last_price_cad
  FROM positions p LEFT JOIN (SELECT run_name, ticker, sum(quantity) AS sold FROM trades WHERE side = 'sell' GROUP BY 1, 2) s
    ON s.run_name = p.run_name AND s.ticker = p.ticker) WHERE quantity > 1e-9""", (a.TRADES, a.POSITIONS))
def _(spark, d):
    store = tables.Tables(spark, _fresh(spark, "held"))
    store.upsert_positions(a.positions(spark, d))
    sold = a.trades(spark, d).where("side = 'sell'").groupBy("run_name", "ticker").agg(F.sum("quantity").alias("sold"))
    store.upsert_positions(store.read("portfolio_positions").join(sold, ["run_name", "ticker"]).select(
        "run_name", "ticker", F.greatest(F.col("quantity") - F.col("sold"), F.lit(0.0)).alias("quantity"), "avg_cost_cad", "last_price_cad"))
    return store.read("portfolio_positions")


@register("h08_j19_declared_references", "child column parent orphans:i", """
SELECT 'portfolio_positions' AS child, 'run_name' AS "column", 'portfolio_runs' AS parent, (SELECT count(*) FROM positions WHERE run_name NOT IN (SELECT run_name FROM known)) AS orphans
UNION ALL SELECT 'portfolio_trades', 'run_name', 'portfolio_runs', (SELECT count(*) FROM trades WHERE run_name NOT IN (SELECT run_name FROM known))
UNION ALL SELECT 'portfolio_snapshots', 'run_name', 'portfolio_runs', (SELECT count(*) FROM runs WHERE run_name NOT IN (SELECT run_name FROM known))
UNION ALL SELECT 'insight_evaluations', 'insight_id', 'insights', (SELECT count(DISTINCT l_partkey) FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size <= 10)
UNION ALL SELECT 'portfolio_trades', 'insight_id', 'insights', (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN part ON l_partkey = p_partkey WHERE p_size <= 10)""",
          (a.TRADES, a.POSITIONS, a.RUNS, "known AS (SELECT 'C' || c_custkey AS run_name FROM customer WHERE c_nationkey < 20)"))
def _(spark, d):
    """Accounts of some nations and insights on large parts are stored; trades and evaluations of all."""
    store, day = tables.Tables(spark, _fresh(spark, "references")), F.lit("2024-01-31").cast("date")
    part = a.table(spark, d, "part")
    by_ticker = F.substring("ticker", 2, 20).cast("bigint").alias("insight_id")
    store.append("portfolio_runs", a.table(spark, d, "customer").where("c_nationkey < 20").select(F.concat(F.lit("C"), _s("c_custkey")).alias("run_name")))
    store.append("insights", part.where("p_size > 10").select(F.col("p_partkey").cast("bigint").alias("insight_id"), day.alias("insight_date")))
    store.append("portfolio_positions", a.positions(spark, d))
    store.append("portfolio_trades", a.trades(spark, d).withColumn("insight_id", by_ticker))
    store.append("portfolio_snapshots", a.runs(spark, d).select("run_name", day.alias("snapshot_date")))
    store.append("insight_evaluations", a.trades(spark, d).select(by_ticker, day.alias("evaluation_date")).distinct())
    return tables.broken_references(store)


@register("s20_get_or_create_runs_and_cash", "run_name starting_cash_cad:m cash_cad:m created_at_utc:t updated_at_utc:t", """
SELECT r.run_name, r.start AS starting_cash_cad, coalesce(o.total, r.cash) AS cash_cad, r.made AS created_at_utc,
  CASE WHEN o.total IS NULL THEN r.made ELSE TIMESTAMP '2024-01-31' END AS updated_at_utc
FROM (SELECT 'C' || c_custkey AS run_name, CASE WHEN c_nationkey < 10 THEN 1000.0 ELSE 5000.0 END AS start,
    CASE WHEN c_nationkey < 10 THEN c_acctbal ELSE 5000.0 END AS cash,
    CASE WHEN c_nationkey < 10 THEN TIMESTAMP '2023-01-01' ELSE TIMESTAMP '2024-01-31' END AS made FROM customer) r
LEFT JOIN (SELECT 'C' || o_custkey AS run_name, max(o_totalprice) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) o USING (run_name)""")
def _(spark, d):
    c = a.table(spark, d, "customer")
    name = F.concat(F.lit("C"), _s("c_custkey")).alias("run_name")
    old = F.lit("2023-01-01").cast("timestamp")
    runs = c.where("c_nationkey < 10").select(name, F.lit(1000.0).alias("starting_cash_cad"), F.col("c_acctbal").alias("cash_cad"),
                                              F.lit("active").alias("status"), old.alias("created_at_utc"), old.alias("updated_at_utc"))
    grown = tables.get_or_create_runs(runs, c.select(name, F.lit(5000.0).alias("starting_cash_cad")), a.clock())
    cash = a.table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(
        F.concat(F.lit("C"), _s("o_custkey")).alias("run_name")).agg(F.max("o_totalprice").alias("cash_cad"))
    return tables.update_cash(grown, cash, a.clock())


@register("s21_s22_append_and_empty_tables", "table n:i", """
SELECT 'after append' AS "table", 2 * count(*) AS n FROM trades UNION ALL SELECT 'removed', 2 * count(*) FROM trades UNION ALL SELECT 'after empty', 0""",
          (a.TRADES,))
def _(spark, d):
    store = tables.Tables(spark, _fresh(spark, "ledger"))
    rows = a.trades(spark, d)
    store.append("portfolio_trades", rows)
    store.append("portfolio_trades", rows)
    before = store.read("portfolio_trades").agg(F.count(F.lit(1)).alias("n")).withColumn("table", F.lit("after append"))
    removed = store.empty(["portfolio_trades"])["portfolio_trades"]
    after = store.read("portfolio_trades").agg(F.count(F.lit(1)).alias("n")).withColumn("table", F.lit("after empty"))
    return before.union(before.select(F.lit(removed).cast("bigint"), F.lit("removed"))).union(after)


def _fresh(spark, name: str) -> str:
    """A new folder in the shared place; nothing is cleared."""
    import uuid

    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("s23_csv_export_of_frames", "sentiment_date headline_count ticker_count", """
SELECT strftime(CAST(published_at_utc AS DATE), '%Y-%m-%d') AS sentiment_date, CAST(count(*) AS VARCHAR) AS headline_count,
  CAST(count(DISTINCT ticker) AS VARCHAR) AS ticker_count FROM scored GROUP BY 1""", (a.SCORED,))
def _(spark, d):
    from newsgauge.plans import marts

    market = marts.market_index(marts.daily_sentiment(a.scored(spark, d)))
    paths = tables.export_csv({"market": market}, _fresh(spark, "csv"))
    return spark.read.csv(paths["market"], header=True)


@register("s25_c26_report_run_rows", "report_name period_start:d output_dir metrics_json", """
SELECT 'weekly' AS report_name, d AS period_start, '/reports' AS output_dir,
  '{"period_start":"' || d || '","period_end":"' || (d + 6) || '","trades_executed":' || n || '}' AS metrics_json
FROM (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1)""")
def _(spark, d):
    weekly = a.table(spark, d, "orders").groupBy(F.date_trunc("week", "o_orderdate").cast("date").alias("period_start")).agg(
        F.count(F.lit(1)).alias("trades_executed"))
    metrics = weekly.select("period_start", F.date_add("period_start", 6).alias("period_end"), "trades_executed")
    return tables.report_run_rows(metrics, "weekly", "/reports", a.clock())


@register("a20_load_counters", "stage n:i", """
SELECT 'fetched' AS stage, count(*) AS n FROM documents UNION ALL SELECT 'after_dedupe', count(DISTINCT text) FROM documents
UNION ALL SELECT 'saved', count(DISTINCT text) FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE lang = 'fr')""")
def _(spark, d):
    docs = a.table(spark, d, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("content_hash"))
    unique = docs.select("content_hash").distinct()
    saved = tables.absent_rows(docs.where("lang = 'fr'"), docs, ["content_hash"])
    return tables_counts({"fetched": docs, "after_dedupe": unique, "saved": saved})


def tables_counts(frames):
    result = None
    for name, frame in frames.items():
        row = frame.agg(F.count(F.lit(1)).alias("n")).withColumn("stage", F.lit(name))
        result = row if result is None else result.unionByName(row)
    return result
