"""Normalizing, hashing, scoring and classifying texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import adapters as a
from checks.registry import register
from newsgauge.functions import fixed_values as fixed
from newsgauge.functions import lexicon, numbers, text
from newsgauge.operators.keyed import distinct_in_order
from newsgauge.plans import scoring

NORMAL = (a.RAW_DOCS, a.NORMAL_DOCS)
_ISO = """strftime(published_at_utc, '%Y-%m-%dT%H:%M:%S') ||
  CASE WHEN epoch_us(published_at_utc) % 1000000 = 0 THEN '' ELSE strftime(published_at_utc, '.%f') END || '+00:00'"""
_HASH = f"""sha256(concat_ws('||', ticker, headline, source, url, {_ISO}, coalesce(summary, ''), category,
  coalesce(topic, ''), coalesce(industry, '')))"""


@register("p01_c01_c02_c06_normalize_headlines",
          "doc_id:i ticker headline source url published_at_utc:t summary category topic industry",
          "SELECT * FROM normal_docs", NORMAL)
def _(spark, d):
    return scoring.normalize_headlines(a.raw_documents(spark, d))


@register("c04_c05_content_hash", "doc_id:i iso content_hash",
          f"SELECT doc_id, {_ISO} AS iso, {_HASH} AS content_hash FROM normal_docs", NORMAL)
def _(spark, d):
    rows = scoring.with_content_hash(scoring.normalize_headlines(a.raw_documents(spark, d)))
    return rows.withColumn("iso", text.iso_timestamp(F.col("published_at_utc")))


@register("c05_iso_text_of_event_times", "event_id:i iso",
          f"SELECT event_id, {_ISO} AS iso FROM scored", (a.SCORED,))
def _(spark, d):
    return a.scored(spark, d).withColumn("iso", text.iso_timestamp(F.col("published_at_utc")))


@register("u08_dedupe_by_content_hash", "doc_id:i content_hash", """
SELECT min(doc_id) AS doc_id, content_hash FROM (
  SELECT doc_id, sha256(summary || '|' || coalesce(topic, '')) AS content_hash FROM normal_docs) GROUP BY 2""", NORMAL)
def _(spark, d):
    rows = scoring.normalize_headlines(a.raw_documents(spark, d)).withColumn(
        "content_hash", F.sha2(F.concat_ws("|", "summary", F.coalesce("topic", F.lit(""))), 256))
    return scoring.dedupe_headlines(rows, [F.col("doc_id")])


@register("w16_first_arrival_of_each_text", "content_hash first_doc:i lang", """
SELECT sha256(text) AS content_hash, min(doc_id) AS first_doc, arg_min(lang, doc_id) AS lang FROM documents GROUP BY 1""")
def _(spark, d):
    rows = a.table(spark, d, "documents").select(
        F.sha2("text", 256).alias("content_hash"), F.col("doc_id").alias("first_doc"), "lang")
    return distinct_in_order(rows, ["content_hash"], [F.col("first_doc")])


def _term_sql(terms: dict[str, float]) -> str:
    words = {t: w for t, w in terms.items() if " " not in t}
    phrases = {t: w for t, w in terms.items() if " " in t}
    parts = [f"{w} * len(list_filter(tokens, lambda x: x = '{t}'))" for t, w in words.items()]
    parts += [f"CASE WHEN contains(folded, '{t}') THEN {w} ELSE 0 END" for t, w in phrases.items()]
    return " + ".join(parts)


_FOLDED = rf"""folded_docs AS (
  SELECT *, string_split_regex(folded, '[^\p{{L}}\p{{N}}_]+') AS tokens FROM (
    SELECT *, {a.sql_clean("replace(replace(lower(headline || '. ' || coalesce(summary, '')), 'ß', 'ss'), 'ς', 'σ')")} AS folded
    FROM normal_docs))"""


def _score_sql(up: dict[str, float], down: dict[str, float]) -> str:
    return f"""
SELECT *, CASE WHEN pp >= up AND pp >= np THEN 'positive' WHEN up >= np THEN 'neutral' ELSE 'negative' END AS sentiment_label,
  pp AS positive_score, up AS neutral_score, np AS negative_score, pp - np AS compound_score, greatest(pp, up, np) AS confidence
FROM (SELECT *, a / (a + b + c) AS pp, b / (a + b + c) AS up, c / (a + b + c) AS np FROM (
  SELECT *, 1 / (1 + exp(-3 * raw)) AS a, greatest(0.05, 1 - abs(raw)) AS b, 1 / (1 + exp(3 * raw)) AS c FROM (
    SELECT *, greatest(least((p - n) / (p + n + 1.0), 1), -1) AS raw FROM (
      SELECT *, {_term_sql(up)} AS p, {_term_sql(down)} AS n FROM folded_docs))))"""


_SCORE_SPEC = ("doc_id:i sentiment_label positive_score:f neutral_score:f negative_score:f compound_score:f confidence:f")


@register("c10_lexicon_term_scores", "doc_id:i up:f down:f",
          f"SELECT doc_id, {_term_sql(a.UP_WORDS)} AS up, {_term_sql(a.DOWN_WORDS)} AS down FROM folded_docs",
          NORMAL + (_FOLDED,))
def _(spark, d):
    rows = scoring.normalize_headlines(a.raw_documents(spark, d))
    rows = rows.withColumn("folded", text.collapse(text.casefold(text.headline_text())))
    return rows.select("doc_id", lexicon.term_score(F.col("folded"), a.UP_WORDS).alias("up"),
                       lexicon.term_score(F.col("folded"), a.DOWN_WORDS).alias("down"))


@register("c11_c13_g01_lexicon_scores_own_words", _SCORE_SPEC, _score_sql(a.UP_WORDS, a.DOWN_WORDS), NORMAL + (_FOLDED,))
def _(spark, d):
    rows = scoring.normalize_headlines(a.raw_documents(spark, d))
    return scoring.score_headlines(rows, a.clock(), "lexicon", positive=a.UP_WORDS, negative=a.DOWN_WORDS)


@register("c11_g01_lexicon_scores_default_words", _SCORE_SPEC,
          _score_sql(fixed.POSITIVE_TERMS, fixed.NEGATIVE_TERMS), NORMAL + (_FOLDED,))
def _(spark, d):
    return scoring.score_headlines(scoring.normalize_headlines(a.raw_documents(spark, d)), a.clock())


def _tier_sql(column: str) -> str:
    one = " OR ".join(f"contains(lower(trim({column})), '{s}')" for s in fixed.TIER_1_SOURCES)
    two = " OR ".join(f"contains(lower(trim({column})), '{s}')" for s in fixed.TIER_2_SOURCES)
    return f"CASE WHEN {one} THEN 1 WHEN {two} THEN 2 ELSE 3 END"


@register("p02_c08_c09_scored_row_assembly",
          "doc_id:i ticker headline source published_at_utc:t headline_age_hours:f source_tier:i category topic", f"""
SELECT *, round((epoch_us(TIMESTAMP '{a.CLOCK}') - epoch_us(published_at_utc)) / 3.6e9, 2) AS headline_age_hours,
  {_tier_sql('source')} AS source_tier FROM normal_docs""", NORMAL)
def _(spark, d):
    return scoring.score_headlines(scoring.normalize_headlines(a.raw_documents(spark, d)), a.clock())


@register("c09_source_tier_of_page_hosts", "page_id:i tier:i", f"SELECT page_id, {_tier_sql('url')} AS tier FROM pages")
def _(spark, d):
    return a.table(spark, d, "pages").select("page_id", text.source_tier(F.col("url")).alias("tier"))


@register("c03_case_and_strip", "event_id:i up low stripped", """
SELECT event_id, upper(source) AS up, lower(ticker) AS low, trim('  ' || headline || ' ') AS stripped FROM scored""", (a.SCORED,))
def _(spark, d):
    return a.scored(spark, d).select(
        "event_id", text.normalize_symbol(F.concat(F.lit(" "), "source")).alias("up"),
        text.casefold(F.col("ticker")).alias("low"), F.trim(F.concat(F.lit("  "), "headline", F.lit(" "))).alias("stripped"))


def _hits_sql(words: list[str]) -> str:
    return " + ".join(f"CAST(contains(folded, '{w}') AS INTEGER)" for w in words)


_IMPACT_SQL = f"""CASE WHEN s > r THEN 'supportive' WHEN r > s THEN 'restrictive' ELSE 'mixed_or_unclear' END"""
_IMPACTS = rf"""impacts AS (
  SELECT *, {_IMPACT_SQL} AS impact FROM (
    SELECT *, {_hits_sql(fixed.SUPPORTIVE_POLICY_WORDS)} AS s, {_hits_sql(fixed.RESTRICTIVE_POLICY_WORDS)} AS r FROM (
      SELECT doc_id, string_split(text, chr(10))[1] AS title, CASE WHEN lang <> 'de' THEN text END AS summary, lang, source,
        replace(replace(lower(string_split(text, chr(10))[1] || ' ' || CASE WHEN lang <> 'de' THEN text ELSE '' END), 'ß', 'ss'), 'ς', 'σ') AS folded
      FROM documents)))"""


@register("c14_c15_policy_impact_and_summary", "doc_id:i impact policy_text", """
SELECT doc_id, impact, CASE WHEN coalesce(summary, '') <> '' THEN summary || ' ' ELSE '' END || 'Policy catalyst: ' || lang
  || ' for ' || source || '; estimated policy impact is ' || impact || '.' AS policy_text FROM impacts""", (_IMPACTS,))
def _(spark, d):
    docs = a.table(spark, d, "documents").select(
        "doc_id", F.split("text", "\n").getItem(0).alias("title"), F.when(F.col("lang") != "de", F.col("text")).alias("summary"),
        "lang", "source")
    return docs.select(
        "doc_id", text.policy_impact(F.concat_ws(" ", "title", F.coalesce("summary", F.lit("")))).alias("impact"),
        text.policy_summary(F.col("title"), F.col("summary"), F.col("lang"), F.col("source")).alias("policy_text"))


@register("c12_model_output_to_scores",
          "event_id:i sentiment_label positive_score:f neutral_score:f negative_score:f compound_score:f confidence:f", """
SELECT event_id, CASE WHEN p >= q AND p >= n THEN 'positive' WHEN n >= q THEN 'negative' ELSE 'neutral' END AS sentiment_label,
  p AS positive_score, q AS neutral_score, n AS negative_score, p - n AS compound_score, greatest(p, q, n) AS confidence
FROM (SELECT event_id, positive_score AS p, negative_score AS n, CASE WHEN event_id % 3 = 0 THEN 0 ELSE neutral_score END AS q FROM scored)""",
          (a.SCORED,))
def _(spark, d):
    def item(label, score):
        return F.struct(F.lit(label).alias("label"), F.col(score).alias("score"))

    both = F.array(item(" Positive", "positive_score"), item("NEGATIVE ", "negative_score"))
    output = F.when(F.col("event_id") % 3 == 0, both).otherwise(F.concat(both, F.array(item("neutral", "neutral_score"))))
    return a.scored(spark, d).select("event_id", *[
        c.alias(n) for n, c in lexicon.model_output_scores(output).items()])


def _letters_model():
    """A stand-in model: the score depends on the text alone."""
    def model(texts):
        if any(t.startswith("{\"k\": 7}") for t in texts):
            raise RuntimeError("this text cannot be scored")
        return [[{"label": "Positive", "score": (len(t) % 10) / 10.0}, {"label": "negative", "score": 0.05},
                 {"label": "neutral", "score": 0.45}] for t in texts]
    return model


@register("g02_model_scores_in_batches", "event_id:i sentiment_label compound_score:f confidence:f source_tier:i", f"""
SELECT event_id, CASE WHEN s >= 0.45 THEN 'positive' ELSE 'neutral' END AS sentiment_label, s - 0.05 AS compound_score,
  greatest(s, 0.45) AS confidence, {_tier_sql('source')} AS source_tier
FROM (SELECT *, (len(headline) % 10) / 10.0 AS s FROM scored WHERE NOT starts_with(headline, '{{"k": 7}}'))""", (a.SCORED,))
def _(spark, d):
    rows = a.scored(spark, d).select("event_id", "ticker", "headline", "source", "published_at_utc")
    return scoring.score_headlines(rows, a.clock(), "model", _letters_model)


@register("c07_parse_feed_dates", "event_id:i rfc:t iso:t bad:t", """
SELECT event_id, date_trunc('second', ts) AS rfc, date_trunc('second', ts) AS iso, CAST(NULL AS TIMESTAMP) AS bad FROM events""")
def _(spark, d):
    e = a.table(spark, d, "events")
    ts = F.col("ts").cast("timestamp")
    zone = F.when(F.col("event_id") % 3 == 0, " GMT").when(F.col("event_id") % 3 == 1, " +0000").otherwise("")
    rfc = F.concat(F.date_format(ts, "EEE, d MMM yyyy HH:mm:ss"), zone)
    iso = F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 2 == 0, "Z").otherwise("+00:00"))
    return e.select("event_id", text.parse_feed_date(rfc).alias("rfc"), text.parse_feed_date(iso).alias("iso"),
                    text.parse_feed_date(F.col("props")).alias("bad"))


@register("c06_parse_timestamps", "event_id:i digits:t number:t fraction:t huge:t zulu:t offset:t naive:t bad:t", """
SELECT event_id, date_trunc('second', ts) AS digits, date_trunc('second', ts) AS number,
  date_trunc('second', ts) + INTERVAL 500 MILLISECOND AS fraction, CAST(NULL AS TIMESTAMP) AS huge, date_trunc('second', ts) AS zulu,
  date_trunc('second', ts) - INTERVAL 2 HOUR AS "offset", ts AS naive, CAST(NULL AS TIMESTAMP) AS bad FROM events""")
def _(spark, d):
    e = a.table(spark, d, "events")
    ts = F.col("ts").cast("timestamp")
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    parse = text.parse_timestamp
    seconds = F.unix_seconds(ts)
    return e.select("event_id", parse(seconds.cast("string")).alias("digits"), parse(seconds.cast("double")).alias("number"),
                    parse(seconds + F.lit(0.5)).alias("fraction"), parse(F.concat(seconds.cast("string"), F.lit("000000"))).alias("huge"),
                    parse(F.concat(iso, F.lit("Z"))).alias("zulu"), parse(F.concat(iso, F.lit("+02:00"))).alias("offset"),
                    parse(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("naive"), parse(F.col("props")).alias("bad"))


@register("c17_provider_symbols", "p_partkey:i dotted dashed suffixed", """
SELECT p_partkey, upper(replace(t, '-', '.')) AS dotted, upper(replace(t, '.', '-')) AS dashed,
  replace(lower(t), '.', '-') || '.us' AS suffixed FROM (SELECT p_partkey, p_brand || '.' || p_size || '-x' AS t FROM part)""")
def _(spark, d):
    t = F.concat("p_brand", F.lit("."), F.col("p_size").cast("string"), F.lit("-x"))
    return a.table(spark, d, "part").select(
        "p_partkey", text.provider_symbol(t, "dotted").alias("dotted"), text.provider_symbol(t, "dashed").alias("dashed"),
        text.provider_symbol(t, "us_suffix").alias("suffixed"))


@register("c21_money_and_percent_text", "l_orderkey:i l_linenumber:i cad:f whole change", r"""
SELECT l_orderkey, l_linenumber, l_extendedprice * 1.37 AS cad, 'CAD ' || format('{:,}', CAST(floor(l_quantity) AS BIGINT)) AS whole,
  printf('%+.2f', sin(l_orderkey) * 10) || '%' AS change FROM lineitem""")
def _(spark, d):
    l = a.table(spark, d, "lineitem")
    return l.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * 1.37).alias("cad"),
                    text.money_short(F.col("l_quantity")).alias("whole"), text.percent(F.sin("l_orderkey") * 10).alias("change"))


@register("c08_c16_c18_c23_number_and_date_math", "o_orderkey:i safe:f held:f seconds:i later:d span:i ratio:f", """
SELECT o_orderkey, coalesce(TRY_CAST(o_orderstatus AS DOUBLE), 0) AS safe, greatest(least(o_totalprice / 170000.0, 1.0), -1.0) AS held,
  CAST(epoch(CAST(o_orderdate AS DATE)) AS BIGINT) AS seconds, CAST(o_orderdate AS DATE) + 5 AS later,
  date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) + 1 AS span,
  CASE WHEN o_custkey % 5 <> 0 THEN o_totalprice / (o_custkey % 5) END AS ratio FROM orders""")
def _(spark, d):
    o = a.table(spark, d, "orders")
    day = F.col("o_orderdate").cast("date")
    return o.select(
        "o_orderkey", numbers.as_number(o, "o_orderstatus").alias("safe"),
        numbers.clamp(F.col("o_totalprice") / 170000.0, -1, 1).alias("held"), numbers.epoch_seconds(day).alias("seconds"),
        F.date_add(day, 5).alias("later"), numbers.inclusive_days(F.lit("1995-01-01").cast("date"), day).alias("span"),
        numbers.ratio(F.col("o_totalprice"), F.col("o_custkey") % 5).alias("ratio"))
