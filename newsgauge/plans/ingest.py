"""Collected feed items and news payloads -> one deduplicated headline table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgauge.functions.text import casefold
from newsgauge.operators.frames import union_all
from newsgauge.operators.keyed import first_rows
from newsgauge.operators.matching import (fan_out_topic_queries, fan_out_topics, financial_rows,
                                          match_tickers, topic_dimension)
from newsgauge.sources.landing import published_since


def collect_headlines(*collectors: DataFrame) -> DataFrame:
    """UNION ALL of collectors in priority order, first copy of each headline kept.

    A copy shares ticker, folded headline, url and category. Rows keep ``arrival``: the collector
    number, then the row's own ``position`` where it has one.
    """
    tagged = [frame.withColumns({
        "_collector": F.lit(i),
        "_position": F.col("position") if "position" in frame.columns else F.lit(0)})
        for i, frame in enumerate(collectors)]
    rows = union_all(*tagged)
    key = [F.col("ticker"), casefold(F.col("headline")), F.col("url"), F.col("category")]
    order = [F.col("_collector"), F.col("_position"), F.col("published_at_utc"), F.col("source")]
    return first_rows(rows, key, order).drop("_collector", "_position")


def collect_public_news(tickers: DataFrame, as_of: Column, lookback_days: int,
                        company_items: DataFrame | None = None, market_items: DataFrame | None = None,
                        topic_items: DataFrame | None = None, policy_items: DataFrame | None = None,
                        names: DataFrame | None = None, sectors: DataFrame | None = None,
                        item_keys: list[str] | None = None) -> DataFrame:
    """All four collectors: company searches (column ticker), market feeds matched by text, topic
    searches (column topic) and policy feeds matched by keyword."""
    keys = item_keys or ["item_id"]
    parts = []
    if company_items is not None:
        recent = published_since(company_items, as_of, lookback_days)
        items = recent.drop("ticker")
        pairs = recent.select(*keys, F.upper("ticker").alias("ticker"))
        parts.append(financial_rows(items, pairs, keys, "company_news", sectors))
    if market_items is not None:
        recent = published_since(market_items, as_of, lookback_days)
        pairs = match_tickers(recent, tickers, keys, names)
        parts.append(financial_rows(recent, pairs, keys, "market_news", sectors))
    if topic_items is not None:
        recent = published_since(topic_items, as_of, lookback_days)
        parts.append(fan_out_topic_queries(recent, tickers, topic_dimension(recent.sparkSession)))
    if policy_items is not None:
        parts.append(fan_out_topics(published_since(policy_items, as_of, lookback_days), tickers))
    if not parts:
        raise ValueError("no collector was given")
    return collect_headlines(*parts)
