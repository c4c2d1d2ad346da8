"""Set-based forms against plain Python, on groups that are small, tied or hot."""

import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from newsgauge.operators import asof, frames, keyed, matching, patterns
from newsgauge.operators.halfsplit import half_split_momentum
from newsgauge.operators.median import exact_median
from newsgauge.plans.portfolio import capped_amounts


def momentum(values):
    if len(values) < 2:
        return 0.0
    mid = max(1, len(values) // 2)
    older, newer = values[:mid], values[mid:]
    return max(min(sum(newer) / len(newer) - sum(older) / len(older), 1.0), -1.0)


def test_half_split_equals_sorting_each_group(spark):
    rng = random.Random(4)
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = []
    for key, n, spread in (("hot", 900, 0), ("minute", 400, 50), ("spread", 300, 400_000), ("one", 1, 0), ("two", 2, 1), ("three", 3, 0)):
        for i in range(n):
            at = start + dt.timedelta(seconds=rng.randint(0, spread))
            rows.append((key, at, f"{rng.getrandbits(64):016x}", rng.uniform(-1, 1)))
    # A cell that shares timestamp and tie prefix must be opened row by row.
    rows += [("cell", start, f"abcd{i:04d}", rng.uniform(-1, 1)) for i in range(101)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, tie string, v double").repartition(5)
    got = {r["k"]: r["momentum"] for r in half_split_momentum(df, ["k"], "ts", "tie", "v").collect()}
    for key in {r[0] for r in rows}:
        values = [r[3] for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))]
        assert got[key] == pytest.approx(momentum(values), abs=1e-9), key


def test_exact_median_equals_statistics(spark):
    rng = random.Random(7)
    groups = {"even": [rng.gauss(0, 5) for _ in range(4000)], "odd": [rng.gauss(0, 5) for _ in range(4001)],
              "tied": [1.0] * 3000 + [2.0] * 100 + [5.0] * 50, "one": [3.5], "two": [1.0, 2.0],
              "far": [1e300, -1e300, 0.5, 0.25, 0.125], "steps": [float(i % 7) for i in range(5000)]}
    rows = [(k, v) for k, values in groups.items() for v in values] + [("even", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    got = {r["k"]: r["median"] for r in exact_median(df, ["k"], "v").collect()}
    assert got == {k: pytest.approx(statistics.median(v)) for k, v in groups.items()}


def test_cash_cap_equals_the_sequential_loop(spark):
    rng = random.Random(11)
    rows, expected = [], {}
    for run in range(400):
        cash = round(rng.choice([0, 20, 60, 200, 1000]) * rng.random() * 2, 4)
        left = cash
        for rank in range(rng.randint(1, 6)):
            want = round(rng.choice([10, 24, 26, 80, 300]) * rng.random() * 2, 4)
            rows.append((run, rank, want, cash))
            amount = min(want, left)
            if amount >= 25:
                expected[run, rank] = amount
                left -= amount
    df = spark.createDataFrame(rows, "run int, rank int, want double, cash double")
    got = capped_amounts(df, ["run"], "rank", "want", "cash", 25.0).where("amount > 0").collect()
    assert {(r["run"], r["rank"]): pytest.approx(r["amount"]) for r in got} == expected


def test_asof_respects_age_and_real_only(spark):
    day = dt.date
    quotes = spark.createDataFrame([
        ("A", day(2024, 1, 1), 10.0, "stooq"), ("A", day(2024, 1, 5), 11.0, "synthetic"),
        ("A", day(2024, 1, 20), 12.0, "polygon"), ("B", day(2024, 1, 1), 5.0, "stooq")],
        "ticker string, quote_date date, close_price_usd double, data_source string")
    asks = [("A", day(2024, 1, 1)), ("A", day(2024, 1, 6)), ("A", day(2024, 1, 15)), ("A", day(2024, 1, 16)),
            ("A", day(2024, 1, 25)), ("B", day(2023, 12, 31)), ("C", day(2024, 1, 1))]
    got = {(r["ticker"], r["as_of"]): r["close_price_usd"] for r in asof.asof_quotes(
        spark.createDataFrame(asks + asks, "ticker string, as_of date"), quotes).collect()}
    assert got == dict(zip(asks, [10.0, 10.0, 10.0, None, 12.0, None, None]))


def test_provider_order_cache_and_synthetic(spark):
    day = dt.date(2024, 3, 1)
    providers = spark.createDataFrame([
        ("A", day, 1.0, "stooq"), ("A", dt.date(2024, 1, 20), 2.0, "polygon"), ("B", day, 3.0, "stooq"), ("B", dt.date(2024, 1, 10), 2.0, "polygon"), ("ATD", day, 4.0, "polygon")],
        "ticker string, quote_date date, close_price_usd double, data_source string")
    cached = spark.createDataFrame([
        ("C", dt.date(2024, 2, 20), 6.0, "yahoo_chart"), ("D", dt.date(2024, 1, 1), 7.0, "yahoo_chart")], providers.schema)
    asks = spark.createDataFrame([(t, day) for t in ("A", "B", "C", "D", "ATD")], "ticker string, as_of date")
    got = {r["ticker"]: (r["data_source"], r["close_price_usd"]) for r in
           asof.resolve_quotes(asks, providers, cached_quotes=cached).collect()}
    assert got["A"] == ("polygon", 2.0) and got["B"] == ("stooq", 3.0) and got["C"] == ("yahoo_chart", 6.0)
    assert got["D"][0] == "synthetic" and got["ATD"][0] == "synthetic"


def test_first_rows_limit_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = keyed.first_rows(df, ["k"], [F.col("id").desc()], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert keyed.first_rows(df, ["k"], [F.col("id").desc()], 5).count() == 15


def test_best_quote_prefers_real_prices(spark):
    schema = "ticker string, quote_date date, close_price_usd double, data_source string"
    cached = spark.createDataFrame([("AAPL", dt.date(2026, 6, 5), 200.0, "cached_real"), ("MSFT", dt.date(2026, 6, 6), 1.0, "synthetic")], schema)
    live = spark.createDataFrame([("aapl", dt.date(2026, 6, 6), None, "unavailable"), ("MSFT", dt.date(2026, 6, 1), 9.0, "yahoo_chart")], schema)
    got = {r["ticker"]: r["close_price_usd"] for r in asof.best_quote_per_ticker(live, cached).collect()}
    assert got == {"AAPL": 200.0, "MSFT": 9.0}


def test_ticker_matching_rules(spark):
    items = spark.createDataFrame([
        (1, "Nvidia jumps", "chips"), (2, "A big day", "it is on"), (3, "buy $A and $BRKB now", None),
        (4, "traders like brk.b today", ""), (5, "NVDA rises", None), (6, "xnvda", "$NVDAQ")],
        "item_id int, title string, summary string")
    tickers = spark.createDataFrame([("A",), ("NVDA",), ("BRK.B",), ("ON",)], "ticker string")
    names = spark.createDataFrame([("NVDA", "Nvidia")], "ticker string, name string")
    got = {(r["item_id"], r["ticker"]) for r in matching.match_tickers(items, tickers, ["item_id"], names).collect()}
    assert got == {(1, "NVDA"), (3, "A"), (3, "BRK.B"), (4, "BRK.B"), (5, "NVDA"), (6, "NVDA")}
    searched = items.withColumn("body", matching.search_text())
    assert set(map(tuple, matching.symbol_matches(searched, tickers, ["item_id"], "body").collect())) == got - {(1, "NVDA")}
    legacy = {(r["item_id"], r["ticker"]) for r in matching.match_tickers(
        items, tickers, ["item_id"], names, legacy_match=True).collect()}
    assert (2, "ON") in legacy and (2, "A") in legacy and got < legacy


def test_names_are_found_wherever_texts_contain_them(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "ga", "x", "delta corp", "café noir"]
    texts = [(i, " ".join(rng.choice(words + ["zeta", "betamax", "cafés"]) for _ in range(6))) for i in range(60)]
    listed = [(f"N{i}", w) for i, w in enumerate(words + ["eta b", "Q", "nowhere at all", "Alpha"])]
    items, names = spark.createDataFrame(texts, "id int, body string"), spark.createDataFrame(listed, "ticker string, name string")
    got = set(map(tuple, matching.phrase_matches(items, names, ["id"], "body").collect()))
    assert got == {(i, t) for i, body in texts for t, name in listed if name.lower() in body}


def test_long_name_lists_go_in_pieces_and_texts_are_not_shuffled(spark, monkeypatch):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    texts = [(i, None if i == 3 else " ".join(rng.sample(words, 30))) for i in range(50)]
    items = spark.createDataFrame(texts, "id int, body string")
    listed = [(w, f"V{i % 40}") for i, w in enumerate(words)] + [("", "empty"), (None, "none"), ("a", None)]
    patterns_df = spark.createDataFrame(listed, "pattern string, value string")
    want = {(i, v) for i, body in texts if body for w, v in listed if w and v and w in body}
    for letters in (1 << 20, 100):
        monkeypatch.setattr(patterns, "PIECE_LETTERS", letters)
        hits = patterns.pattern_hits(items, patterns_df, ["id"], "body")
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and (plan.count("MapInArrow") == 1) == (letters > 100)
        assert set(map(tuple, hits.distinct().collect())) == want


def test_names_with_blanks_at_their_ends(spark):
    items = spark.createDataFrame([(1, "corp up"), (2, "big corp up"), (3, "up corp")], "id int, body string")
    names = spark.createDataFrame([("A", " corp"), ("B", "corp "), ("C", "corp")], "ticker string, name string")
    got = set(map(tuple, matching.match_tickers(items, names.select("ticker"), ["id"], names, text=F.col("body")).collect()))
    assert got == {(2, "A"), (3, "A"), (1, "B"), (2, "B"), (1, "C"), (2, "C"), (3, "C")}


def test_policy_topics_fan_out_with_impact(spark, utc):
    items = spark.createDataFrame([("Chip export controls tighten", "New tariff and export control rules", "Wire", "http://x", utc(2026, 6, 6)),
                                   ("Quiet day", None, "Wire", "http://y", utc(2026, 6, 6))],
                                  "title string, summary string, source string, link string, published_at_utc timestamp")
    selected = spark.createDataFrame([("nvda",), ("AMD",), ("JPM",)], "ticker string")
    rows = matching.fan_out_topics(items, selected).collect()
    assert {(r["ticker"], r["topic"]) for r in rows} == {("NVDA", "semiconductor_export_controls"), ("AMD", "semiconductor_export_controls")}
    assert all("restrictive" in r["summary"] and r["category"] == "political" for r in rows)


def test_tolerant_frames(spark):
    df = spark.createDataFrame([("a", None, "x"), ("B", "2024-01-02", "3.5")], "ticker string, day string, n string")
    assert frames.with_defaults(df, {"day": "none", "extra": 7}).select("day", "extra").collect()[0] == ("none", 7)
    assert frames.keep_existing(df, ["n", "gone", "ticker"]).columns == ["n", "ticker"]
    assert frames.filter_tickers(df, []).count() == 2 and frames.filter_tickers(df, ["A"]).count() == 1
    assert frames.between_dates(df, "day", dt.date(2024, 1, 1), dt.date(2024, 1, 3)).count() == 1
    assert math.isclose(df.select(F.col("n").try_cast("double")).collect()[1][0], 3.5)


def test_asof_ignores_case_and_answers_as_asked(spark):
    quotes = spark.createDataFrame([("AAPL", dt.date(2024, 1, 3), 5.0, "polygon")], "ticker string, quote_date date, close_price_usd double, data_source string")
    asks = spark.createDataFrame([("aapl", dt.date(2024, 1, 4)), ("AAPL", dt.date(2024, 1, 5))], "ticker string, as_of date")
    for found in (asof.asof_quotes(asks, quotes), asof.resolve_quotes(asks, quotes)):
        assert {(r["ticker"], r["close_price_usd"]) for r in found.collect()} == {("aapl", 5.0), ("AAPL", 5.0)}


def test_momentum_without_ties_splits_a_burst(spark):
    rows = [("a", dt.datetime(2024, 1, 1), float(v)) for v in (0.1, 0.2, 0.3, 0.4)]
    got = half_split_momentum(spark.createDataFrame(rows, "k string, ts timestamp, v double"), ["k"], "ts", "content_hash", "v").first()
    assert -1 <= got["momentum"] <= 1


def test_hits_of_a_batch_come_in_bounded_batches():
    import pyarrow as pa

    from newsgauge.operators import patterns

    names = [f"n{i}" for i in range(50)]
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, None, 3, 4], "_text": ["ab", "xabx", None, "a"]})
    got = list(patterns.hit_batches(batch, patterns.automaton_of(["ab", "b"]), [names, ["n0", "m"]], most=8))
    assert max(b.num_rows for b in got) < 16 and len(got) > 10
    assert sorted((str(r["doc_id"]), r["value"]) for b in got for r in b.to_pylist()) == sorted((k, v) for k in ("1", "None") for v in [*names, "m"])


def test_keyword_groups_read_arrow_batches_of_bounded_bytes(spark):
    from newsgauge.operators import patterns

    rows = spark.createDataFrame([(1, "The oil price"), (2, None), (3, ""), (4, "x" * 100 + "gas, oil")], "id int, t string")
    found = rows.select("id", patterns.keyword_groups(F.col("t"), [["oil"], ["gas", "coal"], []]).alias("g"))
    assert {r["id"]: r["g"] for r in found.collect()} == {1: [0], 2: [], 3: [], 4: [0, 1]}
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("16m", "16777216b", "16777216")


def test_only_pairs_of_repeated_keys_are_shuffled(spark):
    from newsgauge.operators import patterns

    rows = spark.createDataFrame([(1, "ab"), (2, "b"), (2, "ab"), (None, "b"), (None, "xb"), (5, None)], "doc_id int, t string")
    names = spark.createDataFrame([("ab", "X"), ("b", "Y"), ("a", "X")], "pattern string, value string")
    found = patterns.pattern_hits(rows, names, ["doc_id"], "t")
    got = sorted((str(r["doc_id"]), r["value"]) for r in found.collect())
    assert got == [("1", "X"), ("1", "Y"), ("2", "X"), ("2", "Y"), ("None", "Y")]
    top = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert top[0].startswith("Union") and "MapInArrow" in top[1]


def test_a_filter_on_the_price_does_not_make_prices_again(spark):
    quotes = spark.createDataFrame([("A", dt.date(2024, 1, 3), 5.0, "polygon"), ("A", dt.date(2024, 1, 5), None, "polygon")],
                                   "ticker string, quote_date date, close_price_usd double, data_source string")
    asks = spark.createDataFrame([("A", dt.date(2024, 1, 4)), ("A", dt.date(2024, 1, 6)), ("B", dt.date(2024, 1, 4)), (None, None)], "ticker string, as_of date")
    found = asof.resolve_quotes(asks, quotes).where(F.col("close_price_usd").isNotNull())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" in plan and not any("sha2" in line for line in plan.splitlines() if "Filter " in line)
    got = {(r["ticker"], r["as_of"]): r["data_source"] for r in found.collect()}
    assert got[("A", dt.date(2024, 1, 4))] == "polygon" and got[("B", dt.date(2024, 1, 4))] == "synthetic" and ("A", dt.date(2024, 1, 6)) not in got


def test_rows_get_the_quotes_of_several_days_in_one_exchange(spark):
    rng = random.Random(8)
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    quotes = spark.createDataFrame(
        [(t, day(n), rng.random(), s) for t in ("AA", "BB", "CC") for s in ("yahoo_chart", "polygon", "synthetic") for n in rng.sample(range(80), 9)]
        + [("AA", None, 1.5, "polygon")], "ticker string, quote_date date, close_price_usd double, data_source string")
    asked = [(i, rng.choice(["AA", "aa", "BB", "DD", None]), day(rng.randrange(90)), day(rng.randrange(90))) for i in range(80)]
    asked = spark.createDataFrame(asked + asked[:9] + [(99, "AA", None, day(3))], "id int, ticker string, a date, b date")
    got = asof.resolve_quotes(asked, quotes, cached_quotes=quotes, days={"first": "a", "second": "b"})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    want = asked
    for prefix, name in (("first", "a"), ("second", "b")):
        one = asof.resolve_quotes(asked.select("ticker", F.col(name).alias("as_of")), quotes, cached_quotes=quotes)
        one = one.toDF("_t", "_d", *[f"{prefix}_{f}" for f in asof.QUOTE_FIELDS])
        want = want.join(one, F.col("ticker").eqNullSafe(F.col("_t")) & F.col(name).eqNullSafe(F.col("_d"))).drop("_t", "_d")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect())) and got.count() == 90


def test_values_of_few_groups_are_not_shuffled_for_their_median(spark, monkeypatch):
    from newsgauge.operators import median

    rows = spark.createDataFrame([(k, float(v)) for k in ("a", "b") for v in range(7)] + [(None, 1.0), ("c", None)], "k string, v double")
    for few in (10, 1):
        monkeypatch.setattr(median, "FEW_GROUPS", few)
        got = exact_median(rows, ["k"], "v")
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Aggregate") == (2 if few > 1 else 3)  # the values are counted before the join only there
        assert {tuple(r) for r in got.collect()} == {("a", 3.0), ("b", 3.0)}


def test_names_that_many_share_take_one_pass(spark, monkeypatch):
    from newsgauge.operators import patterns

    rng = random.Random(12)
    words = ["oil", "il", "gas co", "s", "coal"]
    listed = [(w, f"V{rng.randrange(60)}") for w in words for _ in range(40)]
    items = spark.createDataFrame([(i, " ".join(rng.sample(words + ["x", "co"], 3))) for i in range(30)], "id int, body string")
    monkeypatch.setattr(patterns, "PIECE_LETTERS", 40)  # 14 letters, 560 with the repeats
    want = sorted({(i, v) for i, body in items.collect() for w, v in listed if w in body})
    for most, passes in ((1000, 1), (100, 2)):
        monkeypatch.setattr(patterns, "PIECE_VALUES", most)
        hits = patterns.pattern_hits(items, spark.createDataFrame(listed, "pattern string, value string"), ["id"], "body")
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert (plan.count("MapInArrow") == 1) == (passes == 1) and "Exchange" not in plan
        assert sorted(map(tuple, hits.collect())) == want
