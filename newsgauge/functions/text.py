"""Text cleaning, hashing, source tiers, policy wording and symbol mapping."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsgauge.functions import fixed_values as fixed
from newsgauge.functions.numbers import let


# White space as Unicode sees it, and the four separators that only some libraries count.
_SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"


def collapse(value: Column) -> Column:
    """Whitespace runs (Unicode ones too) become one blank; NULL becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), _SPACE_RUN, " "))


def collapse_or_null(value: Column) -> Column:
    return F.nullif(collapse(value), F.lit(""))


def casefold(value: Column) -> Column:
    """Lower case with the two full case folds that ``lower`` leaves alone."""
    return F.replace(F.replace(F.lower(value), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def normalize_symbol(value: Column) -> Column:
    return F.upper(F.trim(value))


def iso_timestamp(ts: Column) -> Column:
    """ISO-8601 in UTC; the fraction appears only when it is not zero."""
    fraction = F.date_format(ts, "SSSSSS")
    return F.concat(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(fraction == "000000", F.lit("")).otherwise(F.concat(F.lit("."), fraction)),
        F.lit("+00:00"),
    )


HASHED_FIELDS = ["ticker", "headline", "source", "url", "published_at_utc",
                 "summary", "category", "topic", "industry"]


def content_hash(ts: str = "published_at_utc") -> Column:
    parts = [iso_timestamp(F.col(ts)) if name == "published_at_utc"
             else F.coalesce(F.col(name), F.lit("")) for name in HASHED_FIELDS]
    return F.sha2(F.concat_ws("||", *parts), 256)


#: Seconds from year 1 to year 9999; times outside cannot be stored.
FIRST_SECOND, LAST_SECOND = -62_135_596_800, 253_402_300_799


def epoch_timestamp(seconds: Column, fractions: bool = False) -> Column:
    """Seconds since 1970, with ``fractions`` to the nearest microsecond; NULL outside the years 1 to 9999."""
    fitting = F.when((seconds >= FIRST_SECOND) & (seconds <= LAST_SECOND), seconds)
    return F.timestamp_micros(F.round(fitting * 1_000_000).cast("bigint")) if fractions else F.timestamp_seconds(fitting)


def parse_timestamp(value: Column) -> Column:
    """Epoch seconds as digits or as a number, or ISO text with Z, an offset, or no zone (read as UTC); otherwise NULL."""
    text = F.trim(value.cast("string"))
    fraction = F.typeof(value).rlike("^(float|double|decimal)")
    return (F.when(fraction, epoch_timestamp(text.try_cast("double"), fractions=True))
            .when(text.rlike(r"^\d+$"), epoch_timestamp(text.try_cast("bigint")))
            .when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(text)))


def parse_feed_date(value: Column) -> Column:
    """RFC-822 date (weekday optional), else ISO text, else NULL. No zone means UTC."""
    text = collapse(value)
    bare = F.regexp_replace(text, r"^[A-Za-z]{3,9},\s*", "")
    zoned = F.regexp_replace(bare, r"\s+(GMT|UTC|UT|Z)$", " +0000")
    zoned = F.when(zoned.rlike(r"[+-]\d{4}$"), zoned).otherwise(F.concat(zoned, F.lit(" +0000")))
    rfc = F.coalesce(F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss Z")),
                     F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm Z")))
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(text))
    return F.when(text != "", F.coalesce(iso, rfc))


def _any_of(values: Sequence[str]) -> str:
    return "|".join(re.escape(v) for v in values)


def source_tier(source: Column, whole_word: bool = False) -> Column:
    """Tier 1 list first, then tier 2, else 3. Matching is by substring unless ``whole_word``."""
    text = F.lower(F.trim(F.coalesce(source, F.lit(""))))
    guard = (lambda p: rf"(?<![\p{{L}}\p{{N}}])(?:{p})(?![\p{{L}}\p{{N}}])") if whole_word else (lambda p: p)
    return (F.when(text.rlike(guard(_any_of(fixed.TIER_1_SOURCES))), F.lit(1))
            .when(text.rlike(guard(_any_of(fixed.TIER_2_SOURCES))), F.lit(2))
            .otherwise(F.lit(3)))


def headline_text(headline: str = "headline", summary: str = "summary") -> Column:
    return F.concat(F.coalesce(F.col(headline), F.lit("")), F.lit(". "),
                    F.coalesce(F.col(summary), F.lit("")))


def keyword_hits(text: Column, keywords: Sequence[str]) -> Column:
    """How many distinct keywords the text contains; ``text`` must be folded already."""
    hits = F.lit(0)
    for keyword in keywords:
        hits = hits + F.contains(text, F.lit(keyword)).cast("int")
    return hits


def policy_impact(text: Column,
                  supportive: Sequence[str] = fixed.SUPPORTIVE_POLICY_WORDS,
                  restrictive: Sequence[str] = fixed.RESTRICTIVE_POLICY_WORDS) -> Column:
    lead = let(casefold(text), lambda t: keyword_hits(t, supportive) - keyword_hits(t, restrictive))
    return let(lead, lambda n: F.when(n > 0, F.lit("supportive")).when(n < 0, F.lit("restrictive"))
               .otherwise(F.lit("mixed_or_unclear")))


def policy_impact_of(title: Column, summary: Column) -> Column:
    """The impact of an item's whole text; it does not depend on the topic."""
    return policy_impact(F.concat_ws(" ", title, F.coalesce(summary, F.lit(""))))


def policy_sentence(summary: Column, impact: Column, topic: Column, industry: Column) -> Column:
    """Summary (when there is one) followed by the catalyst sentence."""
    sentence = F.concat(F.lit("Policy catalyst: "), topic, F.lit(" for "), industry,
                        F.lit("; estimated policy impact is "), impact, F.lit("."))
    return F.concat_ws(" ", F.nullif(summary, F.lit("")), sentence)


def policy_summary(title: Column, summary: Column, topic: Column, industry: Column) -> Column:
    return policy_sentence(summary, policy_impact_of(title, summary), topic, industry)


def provider_symbol(ticker: Column, style: str) -> Column:
    """The ticker as one quote provider spells it: 'dotted', 'dashed' or 'us_suffix'."""
    if style == "us_suffix":
        return F.concat(F.replace(F.lower(ticker), F.lit("."), F.lit("-")), F.lit(".us"))
    old, new = ("-", ".") if style == "dotted" else (".", "-")
    result = F.upper(F.replace(ticker, F.lit(old), F.lit(new)))
    for symbol, spelled in fixed.SYMBOL_OVERRIDES.items():
        result = F.when(F.upper(ticker) == symbol, F.lit(spelled)).otherwise(result)
    return result


def title_case(value: Column) -> Column:
    return F.initcap(F.replace(value, F.lit("_"), F.lit(" ")))


def fixed_or_na(value: Column, digits: int = 3) -> Column:
    return F.when(value.isNull(), F.lit("n/a")).otherwise(F.format_string(f"%.{digits}f", value))


def money(value: Column, currency: str = "CAD") -> Column:
    return F.when(value.isNull(), F.lit("n/a")).otherwise(
        F.concat(F.lit("$"), F.format_number(value, 2), F.lit(f" {currency}")))


def money_short(value: Column) -> Column:
    return F.when(value.isNull(), F.lit("n/a")).otherwise(
        F.concat(F.lit("CAD "), F.format_number(value, 0)))


def percent(value: Column) -> Column:
    return F.when(value.isNull(), F.lit("n/a")).otherwise(
        F.concat(F.format_string("%+.2f", value), F.lit("%")))
