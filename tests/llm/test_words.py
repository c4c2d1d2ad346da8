"""Spelling variants, periodic runs and source mixing against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from newsgauge.llm import mixing, periodic_runs, queries, spelling

WORDS = "[^\x20\x09-\x0d]+"


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# ---------------------------------------------------------------- spelling variants


def brute_counts(docs, min_chars, min_count, every):
    found = Counter()
    for doc, text in docs:
        for run in re.findall("[a-zÀ-ÿ]+", (text or "").encode().lower().decode()):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if every and h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= min_chars:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= min_count}


@pytest.mark.parametrize(("min_chars", "every"), [(7, 31), (2, 3), (4, None)])
def test_words_are_counted_as_they_are_damaged(odd_docs, no_docs, no_id_docs, min_chars, every):
    for docs in (odd_docs, no_docs, no_id_docs):
        got = spelling.count_words(docs, min_chars, 1, every).collect()
        assert {r["word"]: r["n"] for r in got} == brute_counts(rows(docs), min_chars, 1, every)


def test_long_vocabularies_are_counted_in_parts(odd_docs, monkeypatch):
    monkeypatch.setattr(spelling, "COUNTED", 3)
    got = spelling.count_words(odd_docs, 2, 2).collect()
    assert {r["word"]: r["n"] for r in got} == brute_counts(rows(odd_docs), 2, 2, None)


def brute_variants(counts, ratio):
    letters = sorted({c for w in counts if len(w) < 100 for c in w})

    def near(w):
        found = {w[:i] + w[i + 1:] for i in range(len(w))}
        for i in range(len(w) + 1):
            found |= {w[:i] + c + w[i:] for c in letters}
            found |= {w[:i] + c + w[i + 1:] for c in letters} if i < len(w) else set()
        return [x for x in found if x in counts and x != w]

    forms = {}
    for w, n in counts.items():
        others = near(w)
        best = min(others, key=lambda x: (-counts[x], x)) if others else None
        good = best is not None and counts[best] >= ratio * n
        forms[w] = (best if good else None, n, len(others), counts[best] if good else None)

    def root(w):
        while forms[w][0]:
            w = forms[w][0]
        return w

    return {(w, form, root(w), n, k, m) for w, (form, n, k, m) in forms.items()}


@pytest.mark.parametrize("group_words", [2048, 4])
def test_variants(spark, group_words, monkeypatch):
    monkeypatch.setattr(spelling, "ROWS", 5_000)
    monkeypatch.setattr(spelling, "LETTERS", 2_000)
    draw = random.Random(3)
    words = {"".join(draw.choice("abé") for _ in range(draw.randint(1, 9))) for _ in range(900)}
    words |= {"a" * k for k in range(1, 16)} | {"a" * 7 + "b" * k for k in range(1, 5)} | {"é" * 8, "é" * 7 + "a"}
    counts = {w: int(10 ** draw.uniform(0.4, 5)) for w in words}
    frame = spark.createDataFrame([(w, n, "z") for w, n in counts.items()] + [(None, 3, "z")], "word string, n long, free string").repartition(3)
    got = spelling.spelling_variants(frame, 10, group_words).collect()
    assert {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == brute_variants(counts, 10)
    assert len(got) == len(words) and any(r["root"] not in (r["word"], r["form"]) for r in got)


def test_variants_of_very_long_words_ties_and_no_words(spark):
    counts = {"x" * 3000: 5, "x" * 3001: 50, "x" * 2999 + "y": 500, "tie": 1, "tia": 10, "tib": 10, "lonely": 4}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r["word"]: (r["form"], r["root"], r["n_near"]) for r in spelling.spelling_variants(frame, 10).collect()}
    assert got["x" * 3000] == ("x" * 2999 + "y", "x" * 2999 + "y", 2) and got["x" * 3001] == (None, "x" * 3001, 1)
    assert got["tie"] == ("tia", "tia", 2) and got["lonely"] == (None, "lonely", 0)
    assert spelling.spelling_variants(frame.limit(0)).collect() == []


def test_a_hot_half_is_dealt_again(spark):
    """All words share their first half: groups are cut until they are small, and no pair is lost or met twice."""
    draw = random.Random(6)
    words = sorted({"common" + "".join(draw.choice("abc") for _ in range(6)) for _ in range(400)})
    frame = spark.createDataFrame([(w, 10 + i) for i, w in enumerate(words)], "word string, n long")
    groups = spelling.dealt(frame, 20).groupBy("short", "left", "right", "shared").count()
    assert groups.filter("short - left - right > 3").agg(F.max("count")).first()[0] <= 20
    got = {r["word"]: r["n_near"] for r in spelling.near_words(frame, 20).collect()}
    assert got == {w: k for w in words if (k := sum(len(w) == len(x) and sum(a != b for a, b in zip(w, x, strict=True)) == 1 for x in words))}


# ---------------------------------------------------------------- periodic runs


def brute_runs(words, exponent, least):
    n, found = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, exponent * q) and not any(
                    all(words[i + k] == words[i + k + p] for k in range(length - p)) for p in range(1, q)):
                found.append((i, length, q))
            i = max(j, i) + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    draw = random.Random(1)
    total = 0
    for _ in range(3000):
        letters = draw.choice([1, 2, 2, 3, 4])
        words = [draw.randrange(letters) for _ in range(draw.randint(0, 50))]
        for _ in range(draw.randint(0, 4)):
            root = [draw.randrange(letters) for _ in range(draw.randint(1, draw.choice([3, 8, 30])))]
            if draw.random() < 0.5:  # repetitions inside the root
                root = root * draw.randint(1, 5) + [draw.randrange(letters)]
            at = draw.randint(0, len(words))
            words[at:at] = (root * draw.randint(2, 7))[:draw.randint(2, 200)]
        exponent, least = draw.choice([4, 4, 5]), draw.choice([1, 6])
        want = brute_runs(words, exponent, least)
        total += len(want)
        assert periodic_runs.periodic_runs(words, exponent, least) == want
    assert total > 5000


@pytest.mark.parametrize("words", [["a"] * 200_000, ["a", "b"] * 50_000, list("aabb") * 20_000, list("aabaabX") * 10_000])
def test_long_repetitions_take_linear_time(words):
    (run,) = [r for r in periodic_runs.periodic_runs(words, 4, 6) if r[1] > 1000]
    assert run[0] == 0 and run[1] == len(words)


def planted(doc, words):
    h = zlib.crc32(str(doc).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_collapsed_texts(spark, odd_docs, no_docs, no_id_docs):
    loops = spark.createDataFrame([(1000 + k, f"start {'x y z ' * k}end " + "w " * k, None, None, k) for k in range(40)],
                                  "doc_id long, text string, lang string, source string, n_chars long")
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars").union(loops)
    got = periodic_runs.collapse_runs(queries.with_planted_runs(docs)).collect()
    want = Counter()
    for doc, text in rows(docs):
        words = planted(doc, re.findall(WORDS, text or ""))
        runs = brute_runs(words, 4, 6)
        gone = {i for a, n, q in runs for i in range(a + q, a + n)}
        want[doc, len(words), tuple(runs), " ".join(w for i, w in enumerate(words) if i not in gone)] += 1
    assert Counter((r["doc_id"], r["n_words"], tuple(tuple(x) for x in r["runs"]), r["text"]) for r in got) == want
    assert sum(bool(r["runs"]) for r in got) > 40
    assert periodic_runs.collapse_runs(no_docs).collect() == []
    assert [r["runs"] for r in periodic_runs.collapse_runs(no_id_docs).collect()] == [[]] * 3
    with pytest.raises(ValueError):
        periodic_runs.collapse_runs(docs, exponent=3)


# ---------------------------------------------------------------- mixing


def brute_targets(sizes, weights, share, epochs):
    """Reshares the excess until no source is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()) * share, set()
    while True:
        open_ = [s for s in order if s not in full]
        rest = total - sum(sizes[s] * epochs for s in full)
        target = {s: sizes[s] * epochs if s in full else rest * weight[s] / sum(weight[x] for x in open_) for s in order}
        over = {s for s in open_ if target[s] >= sizes[s] * epochs}
        if not over:
            return target
        full |= over
        if len(full) == len(order):
            return {s: float(sizes[s] * epochs) for s in order}


@pytest.fixture(scope="module")
def sources(spark):
    """A hot source, a tiny one, an empty name, none at all, one without words; repeated ids, null ids and texts."""
    draw = random.Random(8)
    names = ["hot"] * 300 + ["b", "Z", "é", "", None] * 25 + ["tiny"] + ["blank"] * 3
    docs = [(k if k % 50 else None, None if s == "blank" and k % 2 else " " if s == "blank" else "one two" if s == "tiny" else
             " ".join(f"{k}w{j}" for j in range(draw.choice([0, 1, 5, 40, 200]))), s) for k, s in enumerate(names)]
    docs += [docs[1], (7, "seven " * 3000, "b"), (7, "eight", "b")]
    return spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, source string, index string").repartition(3)


@pytest.mark.parametrize(("group", "block", "shard"), [(512, 1024, 1024), (3, 16, 8), (4, 1, 64)])
def test_mixed_words_meet_their_targets(sources, monkeypatch, group, block, shard):
    monkeypatch.setattr(mixing, "GROUP", group)
    mixed = mixing.mix_shares(sources, block=block, shard=shard).collect()
    sizes = defaultdict(int)
    for r in sources.collect():
        sizes[r["source"]] += len(re.findall(WORDS, r["text"] or ""))
    target = brute_targets(sizes, (3, 1, 2), 1.5, 2)
    want = Counter((r["doc_id"], len(re.findall(WORDS, r["text"] or "")), sizes[r["source"]], round(target[r["source"]], 6)) for r in sources.collect())
    assert Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in mixed) == want
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in mixed)
    taken = defaultdict(int)
    for r in mixed:
        taken[round(r["target"], 6), r["source_size"]] += r["taken"]
    assert sum(taken.values()) == pytest.approx(sum(target.values()), abs=len(target))
    for (goal, _), n in taken.items():
        same = sum(round(t, 6) == goal for t in target.values())
        assert abs(n - goal * same) <= same
    again = mixing.mix_shares(sources.repartition(5), block=block, shard=shard).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, mixed))


def test_blocks_hold_the_words_that_were_counted(sources):
    named = sources.filter("doc_id <> 7").dropDuplicates()  # ids that name one text
    shares = {r["doc_id"]: r["taken"] for r in mixing.mix_shares(named, block=16, shard=8, seed=3).collect()}
    blocks = mixing.mixed_blocks(named, block=16, shard=8, seed=3).collect()
    assert sorted(r["slot"] for r in blocks) == list(range(len(blocks))) and all(r["shard"] == r["slot"] // 8 for r in blocks)
    per_source = Counter()
    for r in blocks:
        per_source[r["source"]] += len(r["text"].split(" "))
        assert 1 <= len(r["text"].split(" ")) <= 16
    seen = Counter(w for r in blocks for w in r["text"].split(" "))
    whole = {r["doc_id"]: re.findall(WORDS, r["text"] or "") for r in named.collect()}
    for doc, words in whole.items():
        if words and len(set(words)) == len(words) and words[0].startswith(f"{doc}w"):
            assert sum(seen[w] for w in words) == shares[doc] and max(seen[w] for w in words) <= 2
    assert sum(per_source.values()) == sum(shares.values())


def test_mixing_odd_tables(no_docs, no_id_docs, odd_docs):
    assert mixing.mix_shares(no_docs).collect() == []
    with_source = no_id_docs.withColumn("source", F.lit(None).cast("string"))
    assert Counter((r["size"], r["source_size"], r["target"]) for r in mixing.mix_shares(with_source).collect()) == Counter({(5, 10, 15.0): 2, (0, 10, 15.0): 1})
    assert mixing.mix_shares(odd_docs).count() == odd_docs.count()


def test_mixing_runs_on_functions_alone(sources):
    plan = mixing.mix_shares(sources)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_permutations_and_prefix_sums(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 3)
    for size in (1, 2, 7, 100):
        for key in ("a", "b"):
            got = spark.range(size).select(mixing.permuted(F.col("id"), F.lit(size).cast("bigint"), F.lit(key)).alias("x")).collect()
            assert sorted(r["x"] for r in got) == list(range(size))
    frame = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("p"), (F.col("id") * 7 % 11).alias("v"))
    got = {r["p"]: r["before"] for r in mixing.sums_before(frame, "k", "p", "v").collect()}
    assert got == {p: sum(x * 7 % 11 for x in range(p) if x % 3 == p % 3) for p in range(100)}


def test_query_digests(spark):
    found = {r["doc_id"]: r for r in queries.op12_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    for doc, text in rows(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        words = planted(doc, re.findall(WORDS, text or ""))
        runs = periodic_runs.periodic_runs(words, 4, 6)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        r = found[doc]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()).hexdigest()
