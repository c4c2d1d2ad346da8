"""Daily, rolling, signal, market, latest and audit tables, in both flavours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgauge.functions.numbers import inclusive_days, nan_as_null, ratio, tier_weight, zscore
from newsgauge.operators.frames import at_latest
from newsgauge.operators.keyed import latest_rows
from newsgauge.options import LOCAL, WAREHOUSE, MartOptions

SCORES = ["compound_score", "confidence", "positive_score", "neutral_score", "negative_score"]
LATEST_COLUMNS = ["ticker", "headline", "source", "url", "published_at_utc", "sentiment_label",
                  "positive_score", "neutral_score", "negative_score", "compound_score",
                  "confidence", "headline_age_hours", "source_tier"]
ROLLING_ROWS = 7


def _label_count(label: str) -> Column:
    return F.count_if(F.col("sentiment_label") == label)


def _weighed(scored: DataFrame, opts: MartOptions) -> DataFrame:
    if opts.plain_means:
        scored = nan_as_null(scored, SCORES).where(
            F.col("ticker").isNotNull() & F.col("published_at_utc").isNotNull())
    return scored.withColumns({
        "sentiment_date": F.col("published_at_utc").cast("date"),
        "_weight": tier_weight(F.col("source_tier"), opts.tier_weights, opts.other_weight)})


def daily_measures(opts: MartOptions = WAREHOUSE) -> list[Column]:
    """The measures of a ticker's day over its headlines."""
    c, conf, weight = F.col("compound_score"), F.col("confidence"), F.col("_weight")
    n = F.count("headline") if opts.plain_means else F.count(F.lit(1))
    if opts.plain_means:
        by_confidence, by_source = F.avg(c * conf), F.avg(c * weight)
    else:
        by_confidence = ratio(F.sum(c * conf), F.sum(conf))
        by_source = ratio(F.sum(c * weight), F.sum(weight))
    volume = F.log(1 + n) if opts.volume_scale is None else 1 + n / opts.volume_scale
    measures = [
        n.alias("headline_count"),
        F.avg(c).alias("avg_compound_score"), F.avg(conf).alias("avg_confidence"),
        _label_count("positive").alias("positive_headline_count"),
        _label_count("neutral").alias("neutral_headline_count"),
        _label_count("negative").alias("negative_headline_count"),
        F.avg("positive_score").alias("avg_positive_score"),
        F.avg("neutral_score").alias("avg_neutral_score"),
        F.avg("negative_score").alias("avg_negative_score"),
        F.sum(c).alias("compound_score_sum"), F.sum(F.abs(c)).alias("absolute_sentiment_volume"),
        by_confidence.alias("confidence_weighted_compound_score"),
        by_source.alias("source_weighted_compound_score"),
        (F.avg(c) * volume).alias("headline_volume_weighted_sentiment_index"),
        F.min("published_at_utc").alias("first_headline_at_utc"),
        F.max("published_at_utc").alias("latest_headline_at_utc"),
    ]
    if opts.category_counts:
        measures += [F.count_if(F.col("category") == k).alias(f"{k}_headline_count")
                     for k in ("political", "financial")]
    return measures


def daily_sentiment(scored: DataFrame, opts: MartOptions = WAREHOUSE) -> DataFrame:
    """One row per ticker and day. The only plan here that reads every headline."""
    return _weighed(scored, opts).groupBy("ticker", "sentiment_date").agg(*daily_measures(opts))


def daily_windows(scored: DataFrame, opts: MartOptions = WAREHOUSE) -> DataFrame:
    """``daily_sentiment`` by windows of a day, for a stream with a watermark: a day's state is its sums and extremes."""
    day = F.window("published_at_utc", "1 day")
    rows = _weighed(scored, opts).groupBy("ticker", day).agg(*daily_measures(opts))
    return rows.select("ticker", F.col("window.start").cast("date").alias("sentiment_date"), *[c for c in rows.columns if c not in ("ticker", "window")])


# ---------------------------------------------------------------- days from stored partial states

_SUMMED = ["n_rows", "n_headlines", "n_positive", "n_neutral", "n_negative", "n_political", "n_financial", "sum_compound", "n_compound",
           "sum_confidence", "n_confidence", "sum_positive", "n_positive_score", "sum_neutral", "n_neutral_score", "sum_negative",
           "n_negative_score", "sum_absolute", "sum_by_confidence", "n_by_confidence", "sum_by_weight", "n_by_weight", "sum_weight"]


def daily_partials(scored: DataFrame, opts: MartOptions = WAREHOUSE) -> DataFrame:
    """Sums, counts and extremes by ticker and day: all that the measures need, and they can be added up."""
    c, conf, weight = F.col("compound_score"), F.col("confidence"), F.col("_weight")

    def both(name: str, value: Column, count: str) -> list[Column]:
        return [F.sum(value).alias(name), F.count(value).alias(count)]

    return _weighed(scored, opts).groupBy("ticker", "sentiment_date").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("headline").alias("n_headlines"),
        *[_label_count(x).alias(f"n_{x}") for x in ("positive", "neutral", "negative")],
        *[F.count_if(F.col("category") == x).alias(f"n_{x}") for x in ("political", "financial")],
        *both("sum_compound", c, "n_compound"), *both("sum_confidence", conf, "n_confidence"),
        *[x for k in ("positive", "neutral", "negative") for x in both(f"sum_{k}", F.col(f"{k}_score"), f"n_{k}_score")],
        F.sum(F.abs(c)).alias("sum_absolute"), *both("sum_by_confidence", c * conf, "n_by_confidence"),
        *both("sum_by_weight", c * weight, "n_by_weight"), F.sum(weight).alias("sum_weight"),
        F.min("published_at_utc").alias("first_headline_at_utc"), F.max("published_at_utc").alias("latest_headline_at_utc"))


def merged_partials(partials: DataFrame) -> DataFrame:
    """One row per ticker and day of partial states of several batches."""
    return partials.groupBy("ticker", "sentiment_date").agg(
        *[F.sum(x).alias(x) for x in _SUMMED], F.min("first_headline_at_utc").alias("first_headline_at_utc"),
        F.max("latest_headline_at_utc").alias("latest_headline_at_utc"))


def daily_from_partials(partials: DataFrame, opts: MartOptions = WAREHOUSE) -> DataFrame:
    """The rows of ``daily_sentiment`` without reading a headline. Weights are those that the partials were made with."""
    merged = merged_partials(partials)

    def mean(total: str, count: str) -> Column:
        return ratio(F.col(total), F.col(count))

    n = F.col("n_headlines") if opts.plain_means else F.col("n_rows")
    volume = F.log(1 + n) if opts.volume_scale is None else 1 + n / opts.volume_scale
    average = mean("sum_compound", "n_compound")
    by_confidence = mean("sum_by_confidence", "n_by_confidence" if opts.plain_means else "sum_confidence")
    by_source = mean("sum_by_weight", "n_by_weight" if opts.plain_means else "sum_weight")
    extra = [F.col(f"n_{k}").alias(f"{k}_headline_count") for k in ("political", "financial")] if opts.category_counts else []
    return merged.select(
        "ticker", "sentiment_date", n.alias("headline_count"), average.alias("avg_compound_score"),
        mean("sum_confidence", "n_confidence").alias("avg_confidence"),
        *[F.col(f"n_{k}").alias(f"{k}_headline_count") for k in ("positive", "neutral", "negative")],
        *[mean(f"sum_{k}", f"n_{k}_score").alias(f"avg_{k}_score") for k in ("positive", "neutral", "negative")],
        F.col("sum_compound").alias("compound_score_sum"), F.col("sum_absolute").alias("absolute_sentiment_volume"),
        by_confidence.alias("confidence_weighted_compound_score"), by_source.alias("source_weighted_compound_score"),
        (average * volume).alias("headline_volume_weighted_sentiment_index"), "first_headline_at_utc", "latest_headline_at_utc", *extra)


def rolling_sentiment(daily: DataFrame, opts: MartOptions = WAREHOUSE) -> DataFrame:
    """Adds the seven-row measures. One window, so one exchange and one sort serve all of them."""
    w = (Window.partitionBy("ticker").orderBy("sentiment_date")
         .rowsBetween(-(ROLLING_ROWS - 1), Window.currentRow))
    avg, n = F.col("avg_compound_score"), F.col("headline_count")
    weighted = F.sum("compound_score_sum") if opts.plain_means else F.sum(avg * n)
    return daily.withColumns({
        "rolling_7_day_avg_compound_score": F.avg(avg).over(w),
        "rolling_7_day_avg_headline_count": F.avg(n).over(w),
        "rolling_7_day_compound_score_stddev": F.stddev_samp(avg).over(w),
        "rolling_7_day_volume_weighted_sentiment_index": ratio(weighted.over(w), F.sum(n).over(w)),
        "rolling_7_day_compound_score_sum": F.sum("compound_score_sum").over(w),
        "rolling_7_day_absolute_sentiment_volume": F.sum("absolute_sentiment_volume").over(w),
    })


JOINED_INSIGHT_COLUMNS = [
    "insight_date", "signal_label", "signal_score", "confidence", "sector", "source_count",
    "source_diversity_score", "sentiment_momentum", "consensus_score", "risk_score",
    "opportunity_score", "recommendation", "confidence_grade", "political_headline_count",
    "financial_headline_count", "category_mix", "rationale"]


def sentiment_signals(rolling: DataFrame, opts: MartOptions = WAREHOUSE,
                      insights: DataFrame | None = None) -> DataFrame:
    """Z-score and flags; optionally the same-day insight of the ticker beside them."""
    avg, z = F.col("avg_compound_score"), F.col("compound_score_zscore")
    t, tz = opts.score_threshold, opts.zscore_threshold

    def flag(condition: Column) -> Column:
        return F.when(condition, F.lit(True)).otherwise(F.lit(False))

    signals = rolling.withColumn("compound_score_zscore", zscore(
        avg, F.col("rolling_7_day_avg_compound_score"),
        F.col("rolling_7_day_compound_score_stddev"), opts.zero_undefined))
    signals = signals.withColumns({
        "is_negative_sentiment_signal": flag((avg <= -t) | (z <= -tz)),
        "is_positive_sentiment_signal": flag((avg >= t) | (z >= tz)),
        "is_negative_zscore_anomaly": flag(z <= -tz),
        "is_positive_zscore_anomaly": flag(z >= tz),
        "is_zscore_anomaly": flag(F.abs(z) >= tz),
    })
    if insights is None:
        return signals
    taken = set(signals.columns)
    side = insights.select(
        F.col("ticker"), F.col("insight_date").alias("sentiment_date"),
        *[F.col(c).alias(f"{c}_insight" if c in taken else c)
          for c in JOINED_INSIGHT_COLUMNS if c in insights.columns])
    return signals.join(side, ["ticker", "sentiment_date"], "left")


def market_index(daily: DataFrame, opts: MartOptions = WAREHOUSE) -> DataFrame:
    """One row per day. Daily is unique per ticker, so counting rows counts tickers.

    The closing window has no partition key: it only ever sees one row per calendar day.
    """
    n = F.col("headline_count")

    def weighted(name: str) -> Column:
        return ratio(F.sum(F.col(name) * n), F.sum(n))

    volume = weighted("avg_compound_score")
    by_day = daily.groupBy("sentiment_date").agg(
        F.count("ticker").alias("ticker_count"), F.sum(n).alias("headline_count"),
        F.avg("avg_compound_score").alias("equal_weight_sentiment_index"),
        (F.coalesce(volume, F.lit(0.0)) if opts.zero_undefined else volume)
        .alias("volume_weighted_sentiment_index"),
        weighted("confidence_weighted_compound_score").alias("confidence_volume_weighted_sentiment_index"),
        weighted("source_weighted_compound_score").alias("source_volume_weighted_sentiment_index"))
    w = Window.orderBy("sentiment_date").rowsBetween(-(ROLLING_ROWS - 1), Window.currentRow)
    index = F.col("volume_weighted_sentiment_index")
    return by_day.withColumns({
        "rolling_7_day_volume_weighted_sentiment_index": F.avg(index).over(w),
        "rolling_7_day_volume_weighted_sentiment_stddev": F.stddev_samp(index).over(w)})


def latest_headlines(scored: DataFrame) -> DataFrame:
    """Newest headline per ticker, content hash as the last tie-break."""
    tie = [F.col("content_hash")] if "content_hash" in scored.columns else [F.col("url")]
    return latest_rows(scored, ["ticker"], "published_at_utc", tie).select(
        [c for c in LATEST_COLUMNS if c in scored.columns])


def coverage_audit(scored: DataFrame, opts: MartOptions = WAREHOUSE,
                   loaded_at: Column | None = None) -> DataFrame:
    """One row of totals and target flags.

    Headlines are first counted per ticker and day; both the per-day figures and the ticker count
    come from that small table and meet as two one-row frames in a union.
    """
    per_key = (scored.groupBy("ticker", F.col("published_at_utc").cast("date").alias("sentiment_date"))
               .agg(F.count(F.lit(1)).alias("n"), F.min("published_at_utc").alias("first_at"),
                    F.max("published_at_utc").alias("last_at")))
    per_day = per_key.groupBy("sentiment_date").agg(
        F.sum("n").alias("n"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))
    totals = per_day.agg(
        F.min("first_at").alias("first_scored_headline_at_utc"),
        F.max("last_at").alias("latest_scored_headline_at_utc"),
        F.count("sentiment_date").alias("active_scored_days"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_scored_headlines"),
        F.avg(F.when(F.col("sentiment_date").isNotNull(), F.col("n"))).alias("_mean_active"),
        F.max("n").alias("max_scored_headlines_in_one_day"),
        F.count_if(F.col("n") >= opts.min_daily_headlines).alias("days_with_500_plus_scored_headlines"))
    tickers = (per_key.where(F.col("ticker").isNotNull()).groupBy("ticker").agg(F.lit(1).alias("one"))
               .agg(F.count(F.lit(1)).alias("tracked_ticker_count")))
    both = totals.unionByName(tickers, allowMissingColumns=True)
    one = both.agg(*[F.max(c).alias(c) for c in both.columns])
    first_day = F.col("first_scored_headline_at_utc").cast("date")
    last_day = F.col("latest_scored_headline_at_utc").cast("date")
    one = one.withColumn("coverage_days", inclusive_days(first_day, last_day))
    mean = (F.col("_mean_active") if opts.plain_means
            else ratio(F.col("total_scored_headlines"), F.col("coverage_days")))
    span = F.col("coverage_days") if opts.plain_means else F.col("active_scored_days")
    result = one.withColumns({
        "avg_scored_headlines_per_day": mean,
        "has_sp500_scale_tickers": F.col("tracked_ticker_count") >= opts.min_tickers,
        "has_six_month_window": span >= opts.min_days,
        "has_500_plus_daily_headlines": F.col("max_scored_headlines_in_one_day") >= opts.min_daily_headlines,
    }).drop("_mean_active")
    if opts.plain_means:
        result = result.drop("active_scored_days").withColumn(
            "loaded_at_utc", loaded_at if loaded_at is not None else F.current_timestamp())
    return result


def active_signals(signals: DataFrame) -> DataFrame:
    """Signals of the latest day that point either way, by ticker."""
    latest = at_latest(signals, "sentiment_date")
    return latest.where(F.col("is_positive_sentiment_signal") | F.col("is_negative_sentiment_signal")).select(
        "ticker", "sentiment_date", "headline_count", "avg_compound_score",
        "rolling_7_day_avg_compound_score", "rolling_7_day_volume_weighted_sentiment_index",
        "compound_score_zscore", "is_positive_sentiment_signal", "is_negative_sentiment_signal",
        "is_positive_zscore_anomaly", "is_negative_zscore_anomaly").orderBy("ticker")


def build_marts(scored: DataFrame, opts: MartOptions = WAREHOUSE,
                insights: DataFrame | None = None) -> dict[str, DataFrame]:
    """All marts of one flavour, lazily and unordered; ``in_read_order`` sorts what a reader takes."""
    daily = daily_sentiment(scored, opts)
    rolling = rolling_sentiment(daily, opts)
    return {
        "latest": latest_headlines(scored),
        "daily": daily,
        "rolling": rolling,
        "signals": sentiment_signals(rolling, opts, insights),
        "market": market_index(daily, opts),
        "audit": coverage_audit(scored, opts),
    }


def in_read_order(name: str, mart: DataFrame) -> DataFrame:
    """Newest first, then by ticker; the audit is one row."""
    stamp = {"latest": "published_at_utc", "audit": None}.get(name, "sentiment_date")
    if stamp is None:
        return mart
    return mart.orderBy(F.col(stamp).desc(), *(["ticker"] if "ticker" in mart.columns else []))


def publish_views(marts: dict[str, DataFrame]) -> None:
    for name, frame in marts.items():
        frame.createOrReplaceTempView(name)


__all__ = ["LOCAL", "WAREHOUSE", "active_signals", "build_marts", "coverage_audit",
           "daily_sentiment", "in_read_order", "latest_headlines", "market_index", "publish_views",
           "rolling_sentiment", "sentiment_signals"]
