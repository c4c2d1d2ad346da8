"""One recommendation per ticker from a window of scored headlines.

The headlines are read three times. Everything that adds up is reduced first to (ticker, slot, minute,
category, source), in one hash aggregation. A slot is the day for sliding windows and a constant for
a single window; sliding windows repeat these counts, not the headlines. The counts also tell which
minutes hold the midpoint in time; only the headlines of those that it cuts are opened in a second
read. The third keeps the strongest headline and the newest ones of each slot; those of a window are among them.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgauge.functions.numbers import clamp, label_by_threshold, ratio, tier_weight
from newsgauge.functions.text import title_case
from newsgauge.operators.frames import as_one, filter_tickers, shared_exchange, with_defaults, within_days
from newsgauge.operators.halfsplit import KNOWN, finish_split, locate_midpoints, tie_of
from newsgauge.operators.keyed import first_rows
from newsgauge.options import LOCAL, InsightOptions

KEYS = ["insight_date", "ticker"]
DEFAULTS = {"category": "financial", "topic": "", "industry": "", "source_tier": 3,
            "content_hash": "", "source": "unknown", "headline": ""}


def row_weight() -> Column:
    """max(confidence, 0.2) x tier weight x 1.15 for political headlines."""
    return (F.greatest(F.col("confidence"), F.lit(0.2))
            * tier_weight(F.col("source_tier"), LOCAL.tier_weights, LOCAL.other_weight)
            * F.when(F.col("category") == "political", F.lit(1.15)).otherwise(F.lit(1.0)))


def recent_headlines(scored: DataFrame, since: datetime | Column, tickers=None) -> DataFrame:
    """Published on or after ``since``, optionally for some tickers; day partitions before it are not read."""
    low = since if isinstance(since, Column) else F.lit(since)
    rows = within_days(scored, "published_at_utc", low, None).where(F.col("published_at_utc") >= low)
    return filter_tickers(rows, tickers)


def newest_first(headlines: DataFrame) -> DataFrame:
    """The order of the reader; inside a plan nothing needs it."""
    return headlines.orderBy(F.col("published_at_utc").desc())


def insights_for_window(scored: DataFrame, insight_date: date, opts: InsightOptions = InsightOptions(),
                        external: DataFrame | None = None, sectors: DataFrame | None = None) -> DataFrame:
    """Every row of ``scored`` belongs to the one window; filter it beforehand."""
    day = F.lit(insight_date)
    return _insights(scored, day, lambda cells, _: cells.withColumn("insight_date", F.col("_slot")),
                     opts, external, sectors)


def insights_for_days(scored: DataFrame, opts: InsightOptions = InsightOptions(),
                      external: DataFrame | None = None, sectors: DataFrame | None = None,
                      start: date | None = None, end: date | None = None,
                      tickers=None) -> DataFrame:
    """Insights of every active day d over headlines of [d - lookback, d + 1), all days in one job."""
    rows = filter_tickers(scored.withColumn("ticker", F.upper("ticker")), tickers)
    ts = F.col("published_at_utc")
    low = F.lit(start).cast("timestamp") if start is not None else None
    high = F.lit(end + timedelta(days=1)).cast("timestamp") if end is not None else None
    rows = within_days(rows, "published_at_utc", low, high)
    if low is not None:
        rows = rows.where(ts >= low)
    if high is not None:
        rows = rows.where(ts < high)

    def slide(cells: DataFrame, slots: DataFrame) -> DataFrame:
        active = slots.select(F.col("_slot").alias("insight_date")).distinct()
        frames = F.sequence(F.col("_slot"), F.date_add("_slot", opts.lookback_days))
        return cells.withColumn("insight_date", F.explode(frames)).join(active, "insight_date", "left_semi")

    return _insights(rows, ts.cast("date"), slide, opts, external, sectors)


def _insights(scored: DataFrame, slot: Column, slide: Callable[[DataFrame, DataFrame], DataFrame],
              opts: InsightOptions, external: DataFrame | None, sectors: DataFrame | None) -> DataFrame:
    rows = with_defaults(scored.withColumn("_tie", tie_of(scored, "content_hash")), DEFAULTS)
    ts, c = F.col("published_at_utc"), F.col("compound_score")
    rows = (rows.where(F.col("ticker").isNotNull())
            .withColumns({"_slot": slot, "_w": row_weight(), "_minute": F.date_trunc("minute", ts)}))
    fine = as_one(rows.groupBy("ticker", "_slot", "_minute", "category", "source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_w").alias("w"),
        F.sum(c * F.col("_w")).alias("cw"), F.sum(F.col("confidence") * F.col("_w")).alias("fw"),
        F.count_if(c >= 0).alias("n_up"), F.count_if(c <= 0).alias("n_down"), F.count_if(c < -0.2).alias("n_bad"),
        F.sum(c).alias("total"), F.count(c).alias("n_value")))

    def expand(cells: DataFrame) -> DataFrame:
        return slide(cells, fine)

    cells = fine.groupBy("ticker", "_slot", "category", "source").agg(
        *[F.sum(name).alias(name) for name in ("n", "w", "cw", "fw", "n_up", "n_down", "n_bad")])
    # a slot's sources are listed, so that windows repeat one row a slot
    slots = cells.groupBy("ticker", "_slot").agg(
        *[F.sum(name).alias(name) for name in ("n", "w", "cw", "fw", "n_up", "n_down", "n_bad")],
        F.collect_set("source").alias("sources"),
        *[F.sum(F.when(F.col("category") == name, F.col("n"))).alias(name) for name in ("political", "financial")])
    sums = expand(slots).groupBy(*KEYS).agg(
        F.sum("n").alias("headline_count"), F.sum("w").alias("w"), F.sum("cw").alias("cw"),
        F.sum("fw").alias("fw"), F.sum("n_up").alias("n_up"), F.sum("n_down").alias("n_down"),
        F.sum("n_bad").alias("n_bad"),
        F.size(F.array_distinct(F.flatten(F.collect_list("sources")))).cast("bigint").alias("source_count"),
        F.coalesce(F.sum("political"), F.lit(0)).alias("political_headline_count"),
        F.coalesce(F.sum("financial"), F.lit(0)).alias("financial_headline_count"))
    mix = category_mix(expand(cells.groupBy("ticker", "_slot", "category").agg(F.sum("n").alias("n"))))

    minutes = locate_midpoints(expand(fine.groupBy("ticker", "_slot", "_minute").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("n_value").alias("n_value"))), KEYS)
    cut = _cut(rows, minutes).select(*KEYS, "place", ts.alias("_ts"), "_tie", c.alias("_value"), *KNOWN)
    joined = (sums.join(finish_split(cut, KEYS), KEYS, "left").join(mix, KEYS, "left")
              .join(_outstanding(rows, expand, opts.evidence_rows), KEYS, "left"))
    if external is not None:
        scores = (external.where(F.col("score").isNotNull())
                  .groupBy(F.upper("ticker").alias("_upper")).agg(F.max("score").alias("external_score")))
        joined = joined.join(scores, F.upper("ticker") == F.col("_upper"), "left").drop("_upper")
    else:
        joined = joined.withColumn("external_score", F.lit(None).cast("double"))
    if sectors is not None:
        known = sectors.select(F.upper("ticker").alias("_upper"), "sector")
        joined = joined.join(known, F.upper("ticker") == F.col("_upper"), "left").drop("_upper")
    else:
        joined = joined.withColumn("sector", F.lit(None).cast("string"))
    return _finish(_scores(joined, opts), opts)


def category_mix(cells: DataFrame) -> DataFrame:
    """'category:count/total' by category. One entry per distinct category is collected."""
    per_category = cells.groupBy(*KEYS, "category").agg(F.sum("n").alias("n"))
    listed = per_category.groupBy(*KEYS).agg(
        F.sort_array(F.collect_list(F.struct("category", "n"))).alias("_mix"), F.sum("n").alias("_all"))
    entry = F.transform("_mix", lambda e: F.concat(
        e["category"], F.lit(":"), e["n"].cast("string"), F.lit("/"), F.col("_all").cast("string")))
    return listed.select(*KEYS, F.array_join(entry, ", ").alias("category_mix"))


def _cut(rows: DataFrame, minutes: DataFrame) -> DataFrame:
    """The minutes that hold a midpoint with what is known of their window; the headlines of those that it cuts."""
    wanted = minutes.where("place > 0").select(*KEYS, "_slot", "_minute", "place", *KNOWN)
    wanted = wanted.withColumnsRenamed({x: f"{x}_" for x in ("ticker", "_slot", "_minute")})
    narrow = rows.select("ticker", "_slot", "_minute", "published_at_utc", "_tie", "compound_score")
    same = ((F.col("ticker") == F.col("ticker_")) & F.col("_slot").eqNullSafe(F.col("_slot_"))
            & F.col("_minute").eqNullSafe(F.col("_minute_")))
    # dealt out by headline: a burst in one minute is not one task
    opened = wanted.join(narrow, same & (F.col("place") == 2), "left").drop("ticker", "_slot", "_minute")
    return shared_exchange(opened.withColumnRenamed("ticker_", "ticker").drop("_slot_", "_minute_"), [*KEYS, "_tie"])


def _outstanding(rows: DataFrame, expand: Callable[[DataFrame], DataFrame], k: int) -> DataFrame:
    """Strongest headline (largest |compound|, then newest, then hash) and hashes of the newest k, newest first.

    A window's are among those of its slots. So each slot is cut to its own first, and only these are repeated for the
    windows. Both orders go through one exchange, as two rows of a headline, whose columns sort in either order.
    """
    strength = F.abs("compound_score")
    age = F.coalesce(-F.unix_micros("published_at_utc"), F.lit((1 << 63) - 1))
    by_strength = F.struct(F.lit(1).alias("_kind"), F.when(strength.isNull(), 2).when(F.isnan(strength), 0).otherwise(1).alias("_weak"),
                           F.when(strength.isNull() | F.isnan(strength), 0.0).otherwise(-strength).alias("_minus"),
                           F.col("headline"), F.col("topic"))
    nothing = F.lit(None).cast("string")
    by_age = F.struct(F.lit(0).alias("_kind"), F.lit(0).alias("_weak"), F.lit(0.0).alias("_minus"),
                      nothing.alias("headline"), nothing.alias("topic"))
    order = ["_weak", "_minus", "_age", "content_hash", "_tie"]
    # the tie is the hash unless that is empty
    tagged = rows.select("ticker", "_slot", age.alias("_age"), "content_hash", F.nullif("_tie", "content_hash").alias("_tie"),
                         F.inline(F.array(by_age, by_strength)))
    first = first_rows(tagged, ["ticker", "_slot", "_kind"], [F.col(x) for x in order], max(k, 1), "_pos")
    strong, packed = F.col("_kind") == 1, _packed(F.col("content_hash")).alias("_hash")
    slots = first.where(~strong | (F.col("_pos") == 1)).groupBy("ticker", "_slot", "_kind").agg(
        F.collect_list(F.when(~strong, F.struct("_age", packed, "_tie"))).alias("_new"),
        F.collect_list(F.when(strong, F.struct("_weak", "_minus", "_age", packed, "_tie", "headline", "topic"))).alias("_top"))
    whole = expand(slots).groupBy(*KEYS).agg(*[F.flatten(F.collect_list(x)).alias(x) for x in ("_new", "_top")])

    def in_order(name: str) -> Column:
        return F.sort_array(F.transform(name, lambda e: e.withField("_hash", _unpacked(e["_hash"]))))

    top = F.get(in_order("_top"), 0)
    return whole.select(*KEYS, top["headline"].alias("top_headline"), top["topic"].alias("top_topic"),
                        F.transform(F.slice(in_order("_new"), 1, k), lambda e: e["_hash"]).alias("source_headline_hashes"))


def _packed(text: Column) -> Column:
    """The bytes of a SHA-256 in hex, or of any other text, behind a byte that tells which: half the size to move."""
    return F.when(text.rlike("^[0-9a-f]{64}$"), F.concat(F.lit(bytearray(b"\x01")), F.unhex(text))).otherwise(
        F.concat(F.lit(bytearray(b"\x00")), text.cast("binary")))


def _unpacked(packed: Column) -> Column:
    rest = F.substr(packed, F.lit(2))
    return F.when(F.substr(packed, F.lit(1), F.lit(1)) == F.lit(bytearray(b"\x01")), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def volume_boost(score: Column, n: Column) -> Column:
    boost = F.least(F.lit(0.12), F.log1p(n) / 30)
    return F.when(F.abs(score) < 1e-9, F.lit(0.0)).otherwise(
        clamp(score + F.signum(score) * boost, -1, 1))


def blend(score: Column, external: Column) -> Column:
    return F.when(external.isNull(), score).otherwise(clamp(score * 0.7 + external * 0.3, -1, 1))


def recommend(label: Column, signal: Column, opportunity: Column, risk: Column, momentum: Column) -> Column:
    selling = F.when((signal <= -0.35) | (risk >= 0.45), "sell").otherwise("trim")
    buying = (F.when((opportunity >= 0.48) & (risk <= 0.35), "strong_buy")
              .when((opportunity >= 0.28) | (momentum > 0.2), "buy").otherwise("watch"))
    holding = F.when(risk >= 0.45, "watch_risk").otherwise("hold")
    return F.when(label == "negative", selling).when(label == "positive", buying).otherwise(holding)


def confidence_grade(confidence: Column, diversity: Column, consensus: Column, n: Column) -> Column:
    points = (confidence * 0.4 + diversity * 0.25 + consensus * 0.25
              + F.least(n / F.lit(6.0), F.lit(1.0)) * 0.1)
    return (F.when(points >= 0.82, "A").when(points >= 0.68, "B")
            .when(points >= 0.52, "C").otherwise("D"))


def _scores(df: DataFrame, opts: InsightOptions) -> DataFrame:
    n = F.col("headline_count")
    df = df.withColumns({
        "_confidence": ratio(F.col("fw"), F.col("w")),
        "_signal": blend(volume_boost(ratio(F.col("cw"), F.col("w")), n), F.col("external_score")),
        "_diversity": F.least(F.col("source_count") / F.lit(4.0), F.lit(1.0)),
        "_momentum": F.coalesce("momentum", F.lit(0.0)),
    })
    signal, div, mom = F.col("_signal"), F.col("_diversity"), F.col("_momentum")
    # Rows that agree with the signal: those not below zero, not above zero, or all of them.
    agreeing = F.when(signal > 0, F.col("n_up")).when(signal < 0, F.col("n_down")).otherwise(n)
    df = df.withColumn("_consensus", clamp(
        agreeing / n * 0.55 + F.least(F.abs(signal), F.lit(1.0)) * 0.25 + div * 0.2, 0, 1))
    df = df.withColumn("_risk", clamp(
        (1.0 - F.col("_consensus")) * 0.45
        + F.greatest(F.lit(0.0), 0.75 - F.col("_confidence")) * 0.3
        + F.col("n_bad") / n * 0.2 + F.col("political_headline_count") / n * 0.15, 0, 1))
    policy = F.when(F.col("political_headline_count") > 0, F.lit(0.06)).otherwise(F.lit(0.0))
    df = df.withColumn("_opportunity", clamp(
        F.greatest(signal, F.lit(0.0)) * 0.45 + F.col("_confidence") * 0.22 + div * 0.16
        + F.greatest(mom, F.lit(0.0)) * 0.11 + policy - F.col("_risk") * 0.18, 0, 1))
    df = df.withColumn("signal_label", label_by_threshold(signal, opts.positive_threshold, opts.negative_threshold))
    return df.withColumns({
        "recommendation": recommend(F.col("signal_label"), signal, F.col("_opportunity"), F.col("_risk"), mom),
        "confidence_grade": confidence_grade(F.col("_confidence"), div, F.col("_consensus"), n),
    })


def rationale() -> Column:
    political = F.when(F.col("political_headline_count") > 0, F.format_string(
        "%d political/policy headline(s), ", "political_headline_count")).otherwise(F.lit(""))
    topic = F.when(F.coalesce("top_topic", F.lit("")) != "",
                   F.concat(F.lit(" Topic: "), F.col("top_topic"), F.lit("."))).otherwise(F.lit(""))
    external = F.when(F.col("external_score").isNotNull(), F.format_string(
        " Finnhub ticker score %+.3f was blended in.", "external_score")).otherwise(F.lit(""))
    return F.concat(
        title_case(F.col("recommendation")), F.lit(" from "), F.col("signal_label"),
        F.format_string(" %+.3f signal across %d headline(s): ", "_signal", "headline_count"),
        political,
        F.format_string("%d financial headline(s). Opportunity %.2f, risk %.2f. Strongest catalyst: ",
                        "financial_headline_count", "_opportunity", "_risk"),
        F.coalesce("top_headline", F.lit("")), F.lit("."), topic, external)


def _finish(df: DataFrame, opts: InsightOptions) -> DataFrame:
    def six(name: str) -> Column:
        return F.round(F.col(name), 6)

    return df.select(
        F.xxhash64("ticker", "insight_date").alias("insight_id"), "ticker", "insight_date",
        "signal_label", six("_signal").alias("signal_score"), six("_confidence").alias("confidence"),
        "headline_count", "political_headline_count", "financial_headline_count", "category_mix",
        "sector", "source_count", six("_diversity").alias("source_diversity_score"),
        six("_momentum").alias("sentiment_momentum"), six("_consensus").alias("consensus_score"),
        six("_risk").alias("risk_score"), six("_opportunity").alias("opportunity_score"),
        "recommendation", "confidence_grade", rationale().alias("rationale"),
        F.lit(opts.horizon_days).alias("horizon_days"), "source_headline_hashes")


def latest_insights(insights: DataFrame, as_of: date | None = None) -> DataFrame:
    """Stored insights up to a date, newest day first, best score first."""
    rows = insights if as_of is None else insights.where(F.col("insight_date") <= F.lit(as_of))
    return rows.orderBy(F.col("insight_date").desc(), F.col("signal_score").desc(), F.col("ticker"))


def latest_insight_per_ticker(insights: DataFrame, keys=("ticker",)) -> DataFrame:
    return first_rows(insights, list(keys), [F.col("insight_date").desc(), F.col("signal_score").desc()])
