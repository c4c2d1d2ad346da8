"""Lexicon scoring as native expressions: hits, probabilities, label."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgauge.functions import fixed_values as fixed
from newsgauge.functions.numbers import clamp
from newsgauge.functions.text import casefold, collapse

WORD_BREAK = r"[^\p{L}\p{N}_]+"
_PLAIN_WORD = re.compile(r"\w+\Z")


def _plain_words(terms: dict[str, float]) -> dict[str, float]:
    return {t: w for t, w in terms.items() if " " not in t and _PLAIN_WORD.match(t)}


def word_hits(text: Column, *lexicons: dict[str, float]) -> Column:
    """Tokens of folded text that are single words of any of the lexicons, in text order.

    The text is split once and the tokens are cut to lexicon words by a hash-set test, so the
    cost does not grow with the lexicon and only few tokens are looked up later.
    """
    words = sorted({w for terms in lexicons for w in _plain_words(terms)})
    return F.filter(F.split(text, WORD_BREAK), lambda token: token.isin(words))


def term_score(text: Column, terms: dict[str, float], hits: Column | None = None) -> Column:
    """Weighted hits in folded text: words count each time, phrases once when contained.

    ``hits`` may be the tokens of several lexicons; words of the others weigh nothing here.
    """
    words = _plain_words(terms)
    score = F.lit(0.0)
    if words:
        weights = F.create_map(*[F.lit(v) for pair in words.items() for v in pair])
        found = hits if hits is not None else word_hits(text, terms)
        score = score + F.aggregate(found, F.lit(0.0), lambda acc, token: acc + F.coalesce(
            F.try_element_at(weights, token), F.lit(0.0)))
    for term, weight in terms.items():
        if " " in term:
            score = score + F.when(F.contains(text, F.lit(term)), F.lit(weight)).otherwise(F.lit(0.0))
        elif term not in words:  # terms with punctuation keep the boundary regex
            score = score + F.regexp_count(text, F.lit(rf"(?U)\b{re.escape(term)}\b")) * F.lit(weight)
    return score


def with_lexicon_scores(df: DataFrame, text: Column,
                        positive: dict[str, float] = fixed.POSITIVE_TERMS,
                        negative: dict[str, float] = fixed.NEGATIVE_TERMS) -> DataFrame:
    """Adds label, three scores, compound and confidence. Blank texts are dropped."""
    scored = (df.where(text.rlike(r"(?U)\S")).withColumn("_text", collapse(casefold(text)))
              .withColumn("_hits", word_hits(F.col("_text"), positive, negative))
              .withColumns({"_p": term_score(F.col("_text"), positive, F.col("_hits")),
                            "_n": term_score(F.col("_text"), negative, F.col("_hits"))}))
    raw = clamp((F.col("_p") - F.col("_n")) / (F.col("_p") + F.col("_n") + 1.0), -1, 1)
    scored = scored.withColumn("_c", raw)
    scored = scored.withColumns({
        "_pp": 1.0 / (1.0 + F.exp(F.col("_c") * -3)),
        "_np": 1.0 / (1.0 + F.exp(F.col("_c") * 3)),
        "_up": F.greatest(F.lit(0.05), 1.0 - F.abs("_c")),
    })
    total = F.col("_pp") + F.col("_up") + F.col("_np")
    scored = scored.withColumns({"_pp": F.col("_pp") / total, "_up": F.col("_up") / total,
                                 "_np": F.col("_np") / total})
    return scored.withColumns({
        "sentiment_label": first_best(F.col("_pp"), F.col("_up"), F.col("_np")),
        "positive_score": F.round("_pp", 6),
        "neutral_score": F.round("_up", 6),
        "negative_score": F.round("_np", 6),
        "compound_score": F.round(F.col("_pp") - F.col("_np"), 6),
        "confidence": F.round(F.greatest("_pp", "_up", "_np"), 6),
    }).drop("_text", "_hits", "_p", "_n", "_c", "_pp", "_up", "_np")


def first_best(positive: Column, neutral: Column, negative: Column) -> Column:
    """Label of the largest score; ties go to positive, then neutral."""
    return (F.when((positive >= neutral) & (positive >= negative), F.lit("positive"))
            .when(neutral >= negative, F.lit("neutral"))
            .otherwise(F.lit("negative")))


def model_output_scores(output: Column) -> dict[str, Column]:
    """array<struct<label, score>> -> label, scores, compound and confidence columns."""
    cleaned = F.transform(output, lambda item: F.struct(
        F.lower(F.trim(item["label"])).alias("label"), item["score"].cast("double").alias("score")))

    def score_of(label: str) -> Column:
        # The last entry wins when a label repeats.
        mine = F.filter(cleaned, lambda item: item["label"] == label)
        return F.coalesce(F.try_element_at(mine, F.lit(-1))["score"], F.lit(0.0))

    positive, neutral, negative = map(score_of, ("positive", "neutral", "negative"))
    top = F.array_max(F.transform(cleaned, lambda item: item["score"]))
    best = F.try_element_at(F.filter(cleaned, lambda item: item["score"] == top), F.lit(1))["label"]
    return {
        "sentiment_label": best,
        "positive_score": positive, "neutral_score": neutral, "negative_score": negative,
        "compound_score": F.round(positive - negative, 6), "confidence": F.round(top, 6),
    }
