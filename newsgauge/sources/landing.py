"""Landing payloads -> rows. Collectors drop files; these parsers read whole folders at once.

Every parser takes a DataFrame with a text payload column and explodes it in place, so a
thousand feeds are one narrow pass. Payloads that cannot be read give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsgauge.functions.numbers import clamp, text_to_double
from newsgauge.functions.text import collapse_or_null, epoch_timestamp, parse_feed_date, parse_timestamp
from newsgauge.operators.frames import split_list
from newsgauge.operators.keyed import first_rows

# ---------------------------------------------------------------- news


def company_news(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """(ticker, payload = JSON array of news) -> raw headlines of all tickers.

    Items without headline or date are dropped; a missing source or url becomes ''.
    """
    item = "array<struct<headline:string,source:string,url:string,datetime:string>>"
    rows = payloads.select("ticker", F.explode(F.from_json(payload, item)).alias("_i"))
    published = F.nullif(F.nullif(F.col("_i.datetime"), F.lit("")), F.lit("0"))
    return (rows.where((F.coalesce("_i.headline", F.lit("")) != "") & published.isNotNull())
            .select("ticker", F.col("_i.headline").alias("headline"),
                    F.coalesce("_i.source", F.lit("")).alias("source"),
                    F.coalesce("_i.url", F.lit("")).alias("url"),
                    parse_timestamp(published).alias("published_at_utc")))


def sentiment_score(payload: Column) -> Column:
    """JSON -> score in [-1, 1]: bullish minus bearish, else the company score, else NULL."""
    def number(path: str) -> Column:
        return F.get_json_object(payload, path).try_cast("double")

    spread = number("$.sentiment.bullishPercent") - number("$.sentiment.bearishPercent")
    return clamp_or_null(F.coalesce(spread, number("$.companyNewsScore")))


def clamp_or_null(value: Column, low: float = -1, high: float = 1) -> Column:
    return F.when(value.isNotNull() & ~F.isnan(value), clamp(value, low, high))


_ENTRY = ("array<struct<title:array<string>,link:array<struct<_VALUE:string,_href:string>>,"
          "source:array<string>,pubDate:array<string>,published:array<string>,updated:array<string>,"
          "description:array<string>,summary:array<string>,content:array<string>>>")
_FEED = f"channel struct<item:{_ENTRY}>, item {_ENTRY}, entry {_ENTRY}"


def _first_text(values: Column) -> Column:
    """First entry with any text, whitespace collapsed."""
    filled = F.filter(values, lambda v: v.isNotNull() & (v != ""))
    return collapse_or_null(F.try_element_at(filled, F.lit(1)))


def feed_items(payloads: DataFrame, per_feed: int = 8, payload: str = "payload",
               name: str = "feed_name") -> DataFrame:
    """RSS or Atom documents -> (feed columns, position, title, link, source, published_at_utc, summary).

    The first ``per_feed`` entries of each document in document order; entries without a title
    or a readable date are dropped after that cut. Namespace prefixes are stripped first.
    """
    bare = F.regexp_replace(F.col(payload), r"<(/?)[A-Za-z_][\w.\-]*:([A-Za-z_])", "<$1$2")
    feed = F.from_xml(bare, _FEED, {"mode": "PERMISSIVE", "valueTag": "_VALUE", "attributePrefix": "_"})
    parsed = payloads.withColumn("_feed", feed)
    items = F.coalesce(F.col("_feed.channel.item"), F.col("_feed.item"), F.col("_feed.entry"))
    rows = (parsed.select("*", F.posexplode(F.slice(items, 1, per_feed)).alias("position", "_e"))
            .drop("_feed", payload))
    e = F.col("_e")
    links = F.transform(e["link"], lambda x: x["_VALUE"])
    hrefs = F.transform(e["link"], lambda x: x["_href"])
    published = parse_feed_date(F.coalesce(
        _first_text(e["pubDate"]), _first_text(e["published"]), _first_text(e["updated"])))
    shaped = rows.select(
        *[c for c in rows.columns if c != "_e"], _first_text(e["title"]).alias("title"),
        F.coalesce(_first_text(links), _first_text(hrefs), F.lit("")).alias("link"),
        F.coalesce(_first_text(e["source"]), F.col(name)).alias("source"),
        published.alias("published_at_utc"),
        F.coalesce(_first_text(e["description"]), _first_text(e["summary"]), _first_text(e["content"]))
        .alias("summary"))
    return shaped.where(F.col("title").isNotNull() & F.col("published_at_utc").isNotNull())


def published_since(items: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Lookback filter against an explicit clock."""
    return items.where(F.col("published_at_utc") >= as_of - F.expr(f"interval {int(days)} days"))


# ---------------------------------------------------------------- prices

_QUOTE = "struct<quote_date:date,close:double>"


def _latest_close(rows: DataFrame, keys: Sequence[str], source: str, as_of: Column | None,
                  digits: int | None = 4) -> DataFrame:
    """(keys, quote_date, _at, close) -> newest usable close per key, on or before ``as_of``. Day and place are one
    number, so that each key is a few fixed-size values, reduced by hashing before the shuffle."""
    usable = rows.where(F.col("quote_date").isNotNull() & F.col("close").isNotNull())
    if as_of is not None:
        usable = usable.where(F.col("quote_date") <= as_of)
    place = F.shiftleft(F.unix_date("quote_date").cast("bigint"), 32) + F.col("_at")
    newest = usable.groupBy(*keys).agg(F.max(place).alias("_place"), F.max_by("close", place).alias("close"))
    close = F.col("close") if digits is None else F.round("close", digits)
    return newest.select(*keys, F.date_from_unix_date(F.shiftright("_place", 32).cast("int")).alias("quote_date"),
                         close.alias("close_price_usd"), F.lit(source).alias("data_source"))


def bar_closes(payloads: DataFrame, as_of: Column, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Aggregate-bars JSON: results[] of {t: epoch ms, c: close}."""
    bars = F.from_json("payload", "results array<struct<t:bigint,c:double>>")["results"]
    rows = payloads.select(*keys, F.posexplode(bars).alias("_at", "_b")).select(
        *keys, "_at", F.to_date(epoch_timestamp(F.col("_b.t") / 1000, fractions=True)).alias("quote_date"),
        F.col("_b.c").alias("close"))
    return _latest_close(rows, list(keys), "polygon", as_of)


def daily_map_closes(payloads: DataFrame, as_of: Column, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """JSON keyed by date; adjusted close, else close; unreadable entries are skipped."""
    series = F.from_json("payload", "`Time Series (Daily)` map<string,map<string,string>>")["Time Series (Daily)"]
    value = F.coalesce(F.nullif(F.try_element_at("_v", F.lit("5. adjusted close")), F.lit("")),
                       F.nullif(F.try_element_at("_v", F.lit("4. close")), F.lit("")))
    rows = payloads.select(*keys, F.explode(series).alias("_d", "_v")).select(
        *keys, F.lit(0).alias("_at"),
        F.when(F.col("_d").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date("_d")).alias("quote_date"),
        text_to_double(value).alias("close"))
    return _latest_close(rows, list(keys), "alpha_vantage", as_of)


def chart_closes(payloads: DataFrame, as_of: Column, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Parallel arrays of epoch seconds and closes."""
    schema = ("chart struct<result:array<struct<timestamp:array<bigint>,"
              "indicators:struct<quote:array<struct<close:array<double>>>>>>>")
    result = F.try_element_at(F.from_json("payload", schema)["chart"]["result"], F.lit(1))
    stamps = result["timestamp"]
    closes = F.try_element_at(result["indicators"]["quote"], F.lit(1))["close"]
    pairs = F.arrays_zip(stamps.alias("t"), closes.alias("c"))
    rows = payloads.select(*keys, F.posexplode(pairs).alias("_at", "_p")).select(
        *keys, "_at", F.to_date(epoch_timestamp(F.col("_p.t"))).alias("quote_date"),
        F.col("_p.c").alias("close"))
    return _latest_close(rows, list(keys), "yahoo_chart", as_of)


def csv_closes(payloads: DataFrame, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Quote CSV text with a header that names Date and Close; bad rows dropped, not rounded.

    The header is read once a payload, as the places of the two columns; a blank line has no date."""
    text = F.regexp_replace(F.replace("payload", F.lit("\r\n"), F.lit("\n")), r"^(?: *\n)+", "")
    lines = payloads.select(*keys, F.split(text, "\n").alias("_lines"))
    header = F.transform(F.split(F.get("_lines", F.lit(0)), ","), lambda h: F.trim(h))
    lines = lines.select(*keys, "_lines", header.alias("_h"))
    placed = lines.select(*keys, "_lines", *[F.nullif(F.array_position("_h", name).cast("int"), F.lit(0)).alias(f"_{name}") for name in ("Date", "Close")])
    rows = (placed.select(*keys, "_Date", "_Close", F.posexplode("_lines").alias("_at", "_l")).where("_at > 0")
            .withColumn("_l", F.split("_l", ",")))

    def cell(name: str) -> Column:
        return F.trim(F.get("_l", F.col(f"_{name}") - 1))

    rows = rows.select(*keys, "_at", F.try_to_timestamp(cell("Date")).cast("date").alias("quote_date"),
                       text_to_double(cell("Close")).alias("close"))
    return _latest_close(rows, list(keys), "stooq", None, digits=None)


def read_quote_csv(spark: SparkSession, path: str) -> DataFrame:
    """Folder of quote CSV files, one ticker per ``ticker=...`` sub-folder -> all valid quotes."""
    rows = spark.read.csv(path, header=True)
    return rows.select(
        "ticker", F.try_to_timestamp("Date").cast("date").alias("quote_date"),
        F.col("Close").try_cast("double").alias("close_price_usd"), F.lit("stooq").alias("data_source")
    ).dropna(subset=["quote_date", "close_price_usd"])


# ---------------------------------------------------------------- lists and plans


def ticker_list(texts: DataFrame, column: str = "value", separator: str = ",") -> DataFrame:
    """Comma lists, or file lines (one ticker per line, # comments), to one ticker per row."""
    return texts.select(F.explode(split_list(F.col(column), separator)).alias("ticker"))


def read_ticker_file(spark: SparkSession, path: str) -> DataFrame:
    line = F.trim(F.col("value"))
    return (spark.read.text(path).where((line != "") & ~line.startswith("#"))
            .select(F.upper(line).alias("ticker")))


def keep_members(tickers: DataFrame, universe: DataFrame, position: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Normalized, distinct tickers split into members of the universe and dropped outsiders."""
    tidy = tickers.withColumn("ticker", F.upper(F.trim("ticker"))).where(F.col("ticker") != "")
    distinct = (first_rows(tidy, ["ticker"], [F.col(position)]) if position
                else tidy.select("ticker").distinct())
    members = universe.select(F.upper(F.trim("ticker")).alias("ticker")).distinct()
    return distinct.join(members, "ticker", "left_semi"), distinct.join(members, "ticker", "left_anti")


def date_chunks(rows: DataFrame, start: Column | date, end: Column | date, chunk_days: int) -> DataFrame:
    """Adds one row per inclusive (chunk_start, chunk_end); planned requests = rows of the result."""
    first = start if isinstance(start, Column) else F.lit(start)
    last = end if isinstance(end, Column) else F.lit(end)
    step = F.expr(f"interval {int(chunk_days)} days")
    starts = F.when(first <= last, F.sequence(first, last, step)).otherwise(F.array().cast("array<date>"))
    return (rows.withColumn("chunk_start", F.explode(starts))
            .withColumn("chunk_end", F.least(F.date_add("chunk_start", chunk_days - 1), last)))


def split_heavy_windows(daily_counts: DataFrame, windows: DataFrame, threshold: int = 240) -> DataFrame:
    """Windows halved until each holds fewer than ``threshold`` rows or is one day long.

    ``daily_counts`` is (ticker, day, n); ``windows`` is (ticker, start_date, end_date), disjoint
    per ticker. A window of N days can only break along one fixed halving tree, and a part is
    reached exactly when its parent is heavy. So every day is added to the at most log2(N) + 1 parts
    that hold it, whose bounds follow from its offset, and all splits are decided in one aggregation
    instead of a request loop.
    """
    key = ["ticker", "start_date", "days"]
    spans = windows.withColumn("days", F.datediff("end_date", "start_date") + 1)
    # Windows and days of a ticker in one order: the last window begun is the only one that can hold a day.
    begun = spans.select("ticker", F.col("start_date").alias("_day"), F.lit(0).alias("_kind"), F.lit(None).cast("bigint").alias("n"),
                         F.struct("start_date", "days").alias("_w"))
    days = daily_counts.select("ticker", F.col("day").alias("_day"), F.lit(1).alias("_kind"), F.col("n").cast("bigint").alias("n"),
                               F.lit(None).cast(begun.schema["_w"].dataType).alias("_w"))
    back = Window.partitionBy("ticker").orderBy("_day", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    per_day = (begun.unionByName(days).withColumn("_w", F.last("_w", ignorenulls=True).over(back)).where("_kind = 1")
               .select("ticker", "_w.start_date", "_w.days", "n", F.datediff("_day", "_w.start_date").alias("at"))
               .where(F.col("at") < F.col("days")))
    counted = (per_day.select(*key, "n", F.explode(_halves_of(F.col("at"), F.col("days"))).alias("_p"))
               .select(*key, "n", "_p.lo", "_p.hi").groupBy(*key, "lo", "hi").agg(F.sum("n").alias("n")))
    middle = F.col("lo") + F.expr("(hi - lo + 1) div 2").cast("int")
    heavy = counted.where((F.col("n") >= threshold) & (F.col("hi") > F.col("lo")))
    # The whole window is always reached; a part is reached through its heavy parent.
    parts = heavy.select(*key, F.explode(F.array(
        F.struct(F.col("lo"), (middle - 1).alias("hi")), F.struct(middle.alias("lo"), F.col("hi")))).alias("_p")).select(*key, "_p.lo", "_p.hi")
    roots = spans.select(*key, F.lit(0).alias("lo"), (F.col("days") - 1).alias("hi"))
    reached = roots.unionByName(parts).join(counted, [*key, "lo", "hi"], "left")
    rows = F.coalesce("n", F.lit(0))
    final = reached.where((rows < threshold) | (F.col("hi") == F.col("lo")))
    return final.select("ticker", F.date_add("start_date", F.col("lo")).alias("start_date"),
                        F.date_add("start_date", F.col("hi")).alias("end_date"), rows.alias("n"))


def _halves_of(at: Column, days: Column) -> Column:
    """array<struct<lo, hi>>: the parts of the halving tree that hold offset ``at``; the left part gets days // 2."""
    def part(lo: Column, hi: Column) -> Column:
        return F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))

    def deeper(parts: Column, _level: Column) -> Column:
        lo, hi = (F.element_at(parts, -1)[x] for x in ("lo", "hi"))
        middle = lo + F.floor((hi - lo + 1) / 2)
        half = F.when(at < middle, part(lo, middle - 1)).otherwise(part(middle, hi))
        return F.when(lo == hi, parts).otherwise(F.concat(parts, F.array(half)))

    levels = F.sequence(F.lit(1), F.greatest(F.ceil(F.log2(days.cast("double"))), F.lit(1)).cast("int"))
    return F.aggregate(levels, F.array(part(F.lit(0), days - 1)), deeper)
