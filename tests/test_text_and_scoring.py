import datetime as dt
import hashlib
import math
import re
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from newsgauge.functions import fixed_values as fixed
from newsgauge.functions import lexicon, numbers, text
from newsgauge.plans import ingest, scoring


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


@pytest.mark.parametrize("raw", ["  a\t b \n", "x  y", "Straße  ", "\x1cq\x1d", "", "a  b   c", "été　z"])
def test_collapse_equals_python(spark, raw):
    assert one(spark, text.collapse(F.col("v")), v=raw) == re.sub(r"\s+", " ", raw).strip()


@pytest.mark.parametrize("raw", ["Straße", "ΟΔΟΣ", "ÀÉ", "Plain"])
def test_casefold_equals_python(spark, raw):
    assert one(spark, text.casefold(F.col("v")), v=raw) == raw.casefold()


def test_normalize_and_hash(spark):
    raw = spark.createDataFrame([(" aapl ", " Apple \n wins ", "", "http://x", "1704067200", None, " Political", "", None)],
                                "ticker string, headline string, source string, url string, published_at_utc string, "
                                "summary string, category string, topic string, industry string")
    row = scoring.with_content_hash(scoring.normalize_headlines(raw)).first()
    assert (row["ticker"], row["headline"], row["source"], row["category"], row["topic"]) == (
        "AAPL", "Apple wins", "unknown", "political", None)
    joined = "||".join(["AAPL", "Apple wins", "unknown", "http://x", "2024-01-01T00:00:00+00:00", "", "political", "", ""])
    assert row["content_hash"] == hashlib.sha256(joined.encode()).hexdigest()


@pytest.mark.parametrize("value,expected", [
    ("Tue, 02 Jan 2024 10:00:00 GMT", (2024, 1, 2, 10)), ("2 Jan 2024 10:00:00 +0200", (2024, 1, 2, 8)),
    ("02 Jan 2024 10:00:00", (2024, 1, 2, 10)), ("2024-01-02T10:00:00Z", (2024, 1, 2, 10)),
    ("2024-01-02 10:00:00+05:00", (2024, 1, 2, 5)), ("garbage", None), ("", None)])
def test_feed_dates(spark, value, expected):
    got = one(spark, F.date_format(text.parse_feed_date(F.col("v")), "yyyy-MM-dd HH"), v=value)
    assert got == (None if expected is None else "%04d-%02d-%02d %02d" % expected)


@pytest.mark.parametrize("source,tier", [("Reuters", 1), (" The Wall Street Journal ", 1), ("Seeking Alpha", 2), ("Blog", 3), ("Shaft News", 1), ("", 3)])
def test_source_tier_matches_substrings(spark, source, tier):
    assert one(spark, text.source_tier(F.col("v")), v=source) == tier


def test_source_tier_whole_word(spark):
    assert one(spark, text.source_tier(F.col("v"), whole_word=True), v="Shaft News") == 3
    assert one(spark, text.source_tier(F.col("v"), whole_word=True), v="the FT online") == 1


def python_term_score(folded, terms):
    return sum(w * (1 if " " in t and t in folded else 0 if " " in t else len(re.findall(rf"\b{re.escape(t)}\b", folded)))
               for t, w in terms.items())


@pytest.mark.parametrize("headline", [
    "Company beats, raises guidance; record profit", "Higher rates: lawsuit, probe and tariff-risk", "nothing here", "Fraud FRAUD fraud_x récord",
    "tax  credit approved with growth", "bané ban"])
def test_lexicon_equals_python(spark, headline):
    folded = re.sub(r"\s+", " ", f"{headline}. ".casefold()).strip()
    p, n = python_term_score(folded, fixed.POSITIVE_TERMS), python_term_score(folded, fixed.NEGATIVE_TERMS)
    c = max(min((p - n) / (p + n + 1), 1), -1)
    a, b, d = 1 / (1 + math.exp(-3 * c)), max(0.05, 1 - abs(c)), 1 / (1 + math.exp(3 * c))
    total = a + b + d
    rows = spark.createDataFrame([("T", headline, None)], "ticker string, headline string, summary string")
    got = lexicon.with_lexicon_scores(rows, text.headline_text()).first()
    assert got["positive_score"] == pytest.approx(a / total, abs=1e-6)
    assert got["compound_score"] == pytest.approx((a - d) / total, abs=1e-6)
    assert got["confidence"] == pytest.approx(max(a, b, d) / total, abs=1e-6)
    assert got["sentiment_label"] == max([("positive", a), ("neutral", b), ("negative", d)], key=lambda x: x[1])[0]


def test_terms_with_punctuation_and_ties(spark):
    rows = spark.createDataFrame([("the u.s. deal, u.s.a",)], "t string")
    assert rows.select(lexicon.term_score(F.col("t"), {"u.s.a": 2.0, "deal": 1.0})).first()[0] == 3.0
    third = F.lit(1 / 3)
    assert rows.select(lexicon.first_best(third, third, third)).first()[0] == "positive"


@pytest.mark.parametrize("value", [2.675, 1.005, 0.125, 2.5, 3.5, 10.235, 4097.055, 1e-9, 399.995, 0.285])
def test_round_exact_equals_python(spark, value):
    assert one(spark, numbers.round_exact(F.col("v"), 2), v=value) == round(value, 2)


def test_synthetic_price_equals_python(spark):
    for ticker, day in (("AAPL", "2024-01-05"), ("BRK.B", "2023-12-31"), ("ATD", "2024-02-29")):
        digest = hashlib.sha256(f"{ticker}:{day}".encode()).hexdigest()
        base, drift = 40 + int(digest[:6], 16) % 360, (int(digest[6:10], 16) % 900 - 450) / 1000
        want = round(max(5.0, base * (1 + drift / 10)), 2)
        assert one(spark, numbers.synthetic_price(F.col("t"), F.col("d").cast("date")), t=ticker, d=day) == want


def headlines(spark, utc, texts):
    return spark.createDataFrame([("T", t, "Reuters", "u", utc(2024, 1, 1), None, "financial", None, None) for t in texts],
                                 "ticker string, headline string, source string, url string, published_at_utc timestamp, "
                                 "summary string, category string, topic string, industry string")


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def make_model():
    def model(texts):
        if any("poison" in t for t in texts):
            raise RuntimeError("cannot score")
        return [[{"label": " POSITIVE ", "score": 0.7}, {"label": "negative", "score": 0.2}, {"label": "neutral", "score": 0.1}] for _ in texts]
    return model


def broken_model():
    raise OSError("no weights")


def test_model_scoring_drops_only_bad_rows(spark, utc):
    rows = headlines(spark, utc, ["one", "poison", "two", "  "])
    got = scoring.score_headlines(rows, utc(2024, 1, 1, 3), "model", make_model, batch_size=3).collect()
    assert sorted(r["headline"] for r in got) == ["one", "two"]
    assert {(r["sentiment_label"], r["compound_score"], r["confidence"], r["headline_age_hours"], r["source_tier"]) for r in got} == {
        ("positive", 0.5, 0.7, 3.0, 1)}
    assert scoring.score_headlines(rows.limit(0), utc(2024, 1, 1), "model", make_model).count() == 0


def test_backend_choice(spark, utc):
    rows = headlines(spark, utc, ["profit"])
    assert scoring.score_headlines(rows, utc(2024, 1, 1), "auto", broken_model).first()["sentiment_label"] == "positive"
    with pytest.raises(ValueError):
        scoring.score_headlines(rows, utc(2024, 1, 1), "other")
    with pytest.raises(ValueError):
        scoring.score_headlines(rows, utc(2024, 1, 1), "model")


def test_collectors_keep_the_first_copy(spark, utc):
    a = headlines(spark, utc, ["Same", "Other"]).withColumn("topic", F.lit("first"))
    b = headlines(spark, utc, ["SAME"]).withColumn("topic", F.lit("second"))
    got = {(r["headline"], r["topic"]) for r in ingest.collect_headlines(a, b).collect()}
    assert got == {("Same", "first"), ("Other", "first")}


def test_collect_public_news_from_four_feeds(spark, utc):
    shape = "item_id int, title string, link string, source string, published_at_utc timestamp, summary string"
    now = utc(2024, 1, 10)
    market = spark.createDataFrame([(1, "Nvidia soars", "l1", "s", now, None), (2, "Nvidia old", "l2", "s", utc(2023, 1, 1), None)], shape)
    company = spark.createDataFrame([(3, "Apple event", "l3", "s", now, "AAPL", None)], shape.replace("summary", "ticker string, summary"))
    policy = spark.createDataFrame([(4, "New ransomware rules", "l4", "s", now, None)], shape)
    topic = spark.createDataFrame([(5, "Rate notice", "l5", "s", now, None, "managed_care_medicare_policy")], shape + ", topic string")
    tickers = spark.createDataFrame([("NVDA",), ("AAPL",), ("PANW",), ("UNH",)], "ticker string")
    names = spark.createDataFrame([("NVDA", "Nvidia")], "ticker string, name string")
    rows = ingest.collect_public_news(tickers, F.lit(now), 3, company, market, topic, policy, names).collect()
    assert {(r["ticker"], r["topic"]) for r in rows} == {
        ("NVDA", "market_news"), ("AAPL", "company_news"), ("PANW", "cybersecurity_policy"), ("UNH", "managed_care_medicare_policy")}


def test_numeric_epochs(spark, utc):
    df = spark.createDataFrame([(1_700_000_000.5, 1_700_000_000, "1700000000000000"), (float("nan"), None, "-1"), (1e300, 10**15, "1" * 40)],
                               "f double, i bigint, s string")
    got = [tuple(r) for r in df.select(*[text.parse_timestamp(F.col(c)).cast("double") for c in "fis"]).collect()]
    assert got == [(1_700_000_000.5, 1_700_000_000.0, None), (None, None, None), (None, None, None)]
