"""Text to ticker and text to policy topic matching, and the fan-out of matched rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgauge.functions import fixed_values as fixed
from newsgauge.functions.text import casefold, policy_impact_of, policy_sentence
from newsgauge.operators.patterns import keyword_groups, pattern_hits


def search_text(title: str = "title", summary: str = "summary") -> Column:
    return F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(" "),
                    F.coalesce(F.col(summary), F.lit("")))


def symbol_patterns(tickers: DataFrame) -> DataFrame:
    """(pattern, value) of a text with a blank at either end: symbols over two characters as a token between blanks or
    after '$', shorter ones only after '$'."""
    symbol = F.lower("ticker")
    compact = F.replace(symbol, F.lit("."), F.lit(""))

    def token(word: Column) -> Column:
        return F.concat(F.lit(" "), word, F.lit(" "))

    after_dollar = F.concat(F.lit("$"), compact)
    wanted = F.when(F.length(compact) > 2, F.array(token(compact), token(symbol), after_dollar)).otherwise(F.array(after_dollar))
    return tickers.select(F.explode(F.array_distinct(wanted)).alias("pattern"), F.col("ticker").alias("value"))


def name_patterns(names: DataFrame) -> DataFrame:
    """(pattern, value) for (ticker, name): the name wherever the text contains it."""
    return names.select(F.lower("name").alias("pattern"), F.col("ticker").alias("value"))


def _pairs(items: DataFrame, patterns: DataFrame, item_keys: Sequence[str], folded: Column) -> DataFrame:
    searched = items.select(*item_keys, folded.alias("_folded"))
    return pattern_hits(searched, patterns, item_keys, "_folded").withColumnRenamed("value", "ticker")


def _padded(folded: Column) -> Column:
    """Blanks at both ends make the first and last word tokens like the others."""
    return F.concat(F.lit(" "), folded, F.lit(" "))


def symbol_matches(items: DataFrame, tickers: DataFrame, item_keys: Sequence[str], text: str) -> DataFrame:
    """(item_keys, ticker) pairs where the symbol itself is mentioned."""
    return _pairs(items, symbol_patterns(tickers), item_keys, _padded(F.lower(F.col(text))))


def phrase_matches(items: DataFrame, names: DataFrame, item_keys: Sequence[str], text: str) -> DataFrame:
    """(item_keys, ticker) pairs where lower(name) is contained in lower(text): one pass for lists of any length."""
    return _pairs(items, name_patterns(names), item_keys, F.lower(F.col(text)))


def match_tickers(items: DataFrame, tickers: DataFrame, item_keys: Sequence[str],
                  names: DataFrame | None = None, legacy_match: bool = False,
                  text: Column | None = None) -> DataFrame:
    """(item_keys, ticker): company name in the text, or symbol mentioned.

    ``names`` is (ticker, name). With ``legacy_match`` a ticker that has no name is matched as a
    raw substring of the text too. Symbols and names are looked for in one pass; a name that begins or ends
    with a blank could match the blanks put around the text, so such names take a pass of their own.
    """
    searched = items.withColumn("_search", text if text is not None else search_text())
    known = names.join(tickers.select("ticker").distinct(), "ticker", "left_semi") if names is not None else None
    if legacy_match:
        unnamed = tickers.select("ticker").distinct()
        if known is not None:
            unnamed = unnamed.join(known, "ticker", "left_anti")
        bare = unnamed.select("ticker", F.col("ticker").alias("name"))
        known = bare if known is None else known.select("ticker", "name").unionByName(bare)
    patterns, odd = symbol_patterns(tickers), None
    if known is not None:
        at_edge = F.col("name").startswith(" ") | F.col("name").endswith(" ")
        patterns = patterns.unionByName(name_patterns(known.where(~at_edge)))
        odd = known.where(at_edge)
    found = _pairs(searched, patterns, item_keys, _padded(F.lower("_search")))
    if odd is not None and not odd.isEmpty():
        found = found.unionByName(phrase_matches(searched, odd, item_keys, "_search")).distinct()
    return found


def topic_dimension(spark: SparkSession,
                    topics: Iterable[tuple[str, str, Sequence[str]]] = fixed.POLICY_TOPICS,
                    industry_tickers: dict[str, list[str]] = fixed.INDUSTRY_TICKERS) -> DataFrame:
    rows = [(i, t, ind, list(kw), list(industry_tickers.get(ind, []))) for i, (t, ind, kw) in enumerate(topics)]
    return spark.createDataFrame(
        rows, "position int, topic string, industry string, keywords array<string>, tickers array<string>")


def matching_topics(text: Column, topics: Iterable[tuple[str, str, Sequence[str]]] = fixed.POLICY_TOPICS,
                    industry_tickers: dict[str, list[str]] = fixed.INDUSTRY_TICKERS) -> Column:
    """array<struct<topic, industry, tickers>> of the topics with any keyword in the text, all looked for in one pass."""
    topics = list(topics)
    table = F.array(*[F.struct(
        F.lit(topic).alias("topic"), F.lit(industry).alias("industry"),
        F.array(*[F.lit(t) for t in industry_tickers.get(industry, [])]).cast("array<string>").alias("tickers"))
        for topic, industry, _ in topics])
    places = keyword_groups(casefold(text), [[k.lower() for k in keywords] for _, _, keywords in topics])
    return F.transform(places, lambda place: F.get(table, place))


def fan_out_topics(items: DataFrame, selected: DataFrame, topics=fixed.POLICY_TOPICS,
                   industry_tickers=fixed.INDUSTRY_TICKERS) -> DataFrame:
    """Feed item x matched policy topic x selected ticker of the topic -> political headlines."""
    hits = items.withColumn("_topics", matching_topics(search_text(), topics, industry_tickers)).where(F.size("_topics") > 0)
    matched = (hits.withColumn("_impact", policy_impact_of(F.col("title"), F.col("summary")))
               .withColumn("_topic", F.explode("_topics")).withColumn("ticker", F.explode("_topic.tickers")))
    return _political_rows(_selected(matched, selected), F.col("_topic.topic"), F.col("_topic.industry"))


def fan_out_topic_queries(results: DataFrame, selected: DataFrame, topics: DataFrame) -> DataFrame:
    """Search results that were fetched for one topic -> that topic's selected tickers.

    Same target as above, but the topic is already known per row (column ``topic``).
    """
    judged = results.withColumn("_impact", policy_impact_of(F.col("title"), F.col("summary")))
    matched = (judged.join(topics.select("topic", "industry", "tickers"), "topic")
               .withColumn("ticker", F.explode("tickers")))
    return _political_rows(_selected(matched, selected), F.col("topic"), F.col("industry"))


def _selected(rows: DataFrame, selected: DataFrame) -> DataFrame:
    wanted = selected.select(F.upper("ticker").alias("ticker")).distinct()
    return rows.withColumn("ticker", F.upper("ticker")).join(wanted, "ticker", "left_semi")


def _political_rows(rows: DataFrame, topic: Column, industry: Column) -> DataFrame:
    return rows.select(
        "ticker", F.col("title").alias("headline"), "source", F.col("link").alias("url"),
        "published_at_utc",
        policy_sentence(F.col("summary"), F.col("_impact"), topic, industry).alias("summary"),
        F.lit("political").alias("category"), topic.alias("topic"), industry.alias("industry"))


def financial_rows(items: DataFrame, matches: DataFrame, item_keys: Sequence[str], topic: str,
                   sectors: DataFrame | None = None) -> DataFrame:
    """Feed items joined with their matched tickers -> financial headlines."""
    rows = items.join(matches, list(item_keys))
    if sectors is not None:
        rows = rows.join(sectors.select("ticker", "sector"), "ticker", "left")
    else:
        rows = rows.withColumn("sector", F.lit(None).cast("string"))
    return rows.select(
        "ticker", F.col("title").alias("headline"), "source", F.col("link").alias("url"),
        "published_at_utc", "summary", F.lit("financial").alias("category"),
        F.lit(topic).alias("topic"), F.col("sector").alias("industry"))
