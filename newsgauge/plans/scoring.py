"""Normalizing and scoring headlines: the lexicon natively, models as a batch callable."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Sequence
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsgauge.functions import fixed_values as fixed
from newsgauge.functions.lexicon import model_output_scores, with_lexicon_scores
from newsgauge.functions.numbers import age_hours
from newsgauge.functions.text import (collapse, collapse_or_null, content_hash, headline_text,
                                      parse_timestamp, source_tier)
from newsgauge.operators.keyed import first_rows

logger = logging.getLogger(__name__)

# A model maker runs once per Python worker and returns texts -> list of [{label, score}, ...].
Model = Callable[[Sequence[str]], Sequence[Sequence[dict]]]
OUTPUT = "array<struct<label:string,score:double>>"


def normalize_headlines(raw: DataFrame) -> DataFrame:
    """Clean text, upper ticker, defaults for source and category, UTC timestamp."""
    ts = F.col("published_at_utc")
    if not isinstance(raw.schema["published_at_utc"].dataType, T.TimestampType):
        ts = (ts.cast("timestamp") if isinstance(raw.schema["published_at_utc"].dataType, T.TimestampNTZType)
              else parse_timestamp(ts))
    rows = raw
    for name in ("summary", "category", "topic", "industry"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    return rows.withColumns({
        "ticker": F.upper(collapse(F.col("ticker"))), "headline": collapse(F.col("headline")),
        "source": F.coalesce(collapse_or_null(F.col("source")), F.lit("unknown")),
        "url": collapse(F.col("url")), "published_at_utc": ts,
        "summary": collapse_or_null(F.col("summary")),
        "category": F.coalesce(F.lower(collapse_or_null(F.col("category"))), F.lit("financial")),
        "topic": collapse_or_null(F.col("topic")), "industry": collapse_or_null(F.col("industry"))})


def with_content_hash(rows: DataFrame) -> DataFrame:
    """Adds the hash, or fills it in where it is missing or empty."""
    if "content_hash" in rows.columns:
        own = F.nullif(F.col("content_hash"), F.lit(""))
        return rows.withColumn("content_hash", F.coalesce(own, content_hash()))
    return rows.withColumn("content_hash", content_hash())


def dedupe_headlines(rows: DataFrame, arrival: Sequence[Column]) -> DataFrame:
    """First arrival per content hash."""
    return first_rows(with_content_hash(rows), ["content_hash"], arrival)


def _describe(scored: DataFrame, as_of: Column | datetime) -> DataFrame:
    clock = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return scored.withColumns({"headline_age_hours": age_hours(F.col("published_at_utc"), clock),
                               "source_tier": source_tier(F.col("source"))})


def score_with_lexicon(headlines: DataFrame, as_of: Column | datetime,
                       positive: dict[str, float] = fixed.POSITIVE_TERMS,
                       negative: dict[str, float] = fixed.NEGATIVE_TERMS) -> DataFrame:
    """Scores 'headline. summary' without leaving the JVM."""
    return _describe(with_lexicon_scores(headlines, headline_text(), positive, negative), as_of)


def score_with_model(headlines: DataFrame, make_model: Callable[[], Model], as_of: Column | datetime,
                     batch_size: int = 64) -> DataFrame:
    """Scores the headline text with a user model in Arrow batches.

    The model is made once per worker. A batch that fails is retried row by row, and rows that
    still fail, or are blank, are dropped.
    """
    schema = T.StructType(headlines.schema.fields + [
        T.StructField("_output", T.StructType.fromDDL(f"o {OUTPUT}")["o"].dataType)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for frame in batches:
            for start in range(0, len(frame), batch_size):
                part = frame.iloc[start:start + batch_size]
                part = part.assign(_output=_score_texts(model, part["headline"].tolist()))
                kept = part[part["_output"].notna()]
                if len(kept):
                    yield kept

    scored = headlines.mapInPandas(run, schema)
    scored = scored.withColumns(model_output_scores(F.col("_output"))).drop("_output")
    return _describe(scored, as_of)


def _score_texts(model: Model, texts: list[str]) -> list:
    usable = [i for i, t in enumerate(texts) if t and t.strip()]
    results: list = [None] * len(texts)
    try:
        outputs = list(model([texts[i] for i in usable]))
        if len(outputs) != len(usable) or not all(outputs):
            raise ValueError("model returned a result of another length")
        for i, output in zip(usable, outputs):
            results[i] = list(output)
    except Exception as error:  # any model error: fall back to one text at a time
        logger.info("batch scoring failed, scoring rows one by one: %s", error)
        for i in usable:
            try:
                results[i] = list(model([texts[i]])[0]) or None
            except Exception as row_error:
                logger.info("dropping a headline that cannot be scored: %s", row_error)
    return results


def score_headlines(headlines: DataFrame, as_of: Column | datetime, backend: str = "lexicon",
                    make_model: Callable[[], Model] | None = None, **kwargs) -> DataFrame:
    """Chooses the scorer by name: lexicon, model, or auto (the model when one is given and loads)."""
    if backend not in ("lexicon", "model", "auto"):
        raise ValueError(f"backend must be lexicon, model or auto, not {backend!r}")
    if backend == "model" and make_model is None:
        raise ValueError("backend 'model' needs make_model")
    if backend == "auto" and make_model is not None:
        try:
            make_model()
        except Exception as error:
            logger.warning("model unavailable, using the lexicon: %s", error)
            make_model = None
    if backend == "lexicon" or make_model is None:
        return score_with_lexicon(headlines, as_of, **kwargs)
    return score_with_model(headlines, make_model, as_of, **kwargs)
