"""Exact, near, line and substring dedup against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsgauge.llm import exact_dedup, graph, line_dedup, minhash, shingles, substring_dedup

WHITE = "[\x20\x09-\x0d]+"


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def normal(text):
    return re.sub(WHITE, " ", text or "")


@pytest.mark.parametrize("salted", [2048, 1])
def test_exact(odd_docs, monkeypatch, salted):
    monkeypatch.setattr(exact_dedup, "ROWS_PER_SALT", salted)
    groups = defaultdict(list)
    for doc, text in rows(odd_docs):
        groups[normal(text)].append(doc)
    want = Counter((doc, min(ids), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for doc in ids)
    got = exact_dedup.exact_duplicates(odd_docs).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert sorted(r["doc_id"] for r in got if r["kept"]) == sorted(min(x) for x in groups.values())
    kept = exact_dedup.drop_exact_duplicates(odd_docs)
    assert kept.schema == odd_docs.schema and kept.count() == len(groups)


def test_exact_of_odd_tables(no_docs, no_id_docs):
    assert exact_dedup.exact_duplicates(no_docs).collect() == []
    got = exact_dedup.exact_duplicates(no_id_docs).collect()
    assert sorted((r["keep_id"], r["group_size"], r["kept"]) for r in got) == [(None, 1, True), (None, 2, False), (None, 2, True)]


def test_exact_runs_on_functions_alone(odd_docs):
    plan = exact_dedup.exact_duplicates(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("rangepartitioning") == 1


def brute_lines(docs, min_docs, min_chars):
    def key(line):
        return re.sub(f"^{WHITE}|{WHITE}$", "", line).translate({c: c + 32 for c in range(65, 91)})

    holders = defaultdict(list)
    for doc, text in docs:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= min_chars:
                holders[k].append(doc)
    result = Counter()
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(h := holders.get(key(x), [])) < min_docs or doc == max(h)]
        result[doc, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return result


@pytest.mark.parametrize("min_docs", [2, 5])
def test_lines(odd_docs, min_docs):
    got = line_dedup.drop_repeated_lines(odd_docs, min_docs=min_docs)
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()) == brute_lines(rows(odd_docs), min_docs, 40)


def test_lines_of_odd_tables(no_docs, no_id_docs):
    assert line_dedup.drop_repeated_lines(no_docs).collect() == []
    got = line_dedup.drop_repeated_lines(no_id_docs, min_docs=2, min_chars=4).collect()
    assert sorted((r["n_lines"], r["n_dropped"]) for r in got) == [(1, 0)] * 3


def test_merged_filters_know_what_two_parts_share():
    hashes = np.arange(1, 3000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    first, second = hashes[:2000], hashes[1500:]
    parts = [next(iter(line_dedup._segment_filters(x, 1)))[1:] for x in (first, second)]
    twice = np.frombuffer(__import__("zlib").decompress(line_dedup.merge_filters(iter(parts))[1]), dtype=np.uint8)
    _, places = line_dedup.probe_bits(hashes, 1)
    hit = np.unpackbits(twice)[places].all(axis=1)
    assert hit[1500:2000].all() and hit.mean() < 0.3


def brute_repeats(docs, window):
    words = [[x for x in re.split(WHITE, t or "") if x] for _, t in docs]
    starts = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    result = Counter()
    for (doc, _), w in zip(docs, words, strict=True):
        gone = {j for i in range(len(w) - window + 1) if starts[tuple(w[i:i + window])] > 1 for j in range(i, i + window)}
        result[doc, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)] += 1
    return result


@pytest.mark.parametrize("group", [4096, 1])
def test_substrings(odd_docs, monkeypatch, group):
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    got = substring_dedup.remove_repeats(odd_docs, window=35).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in got) == brute_repeats(rows(odd_docs), 35)
    assert any(0 < r["n_removed"] < r["n_words"] for r in got)


def test_substrings_of_odd_tables(no_docs, no_id_docs, odd_docs):
    assert substring_dedup.remove_repeats(no_docs).collect() == []
    assert [r["n_removed"] for r in substring_dedup.remove_repeats(no_id_docs).collect()] == [0] * 3
    cut = substring_dedup.drop_repeats(odd_docs)
    assert cut.schema.fieldNames() == odd_docs.columns and cut.count() == odd_docs.count()


def test_subtrees_mark_repeats_only():
    text = b"a b c d e f g h"
    marks = substring_dedup.deep_nodes([(text, 1), (b"x b c d e", 1)], 3)
    assert [m.tolist() for m in marks] == [[False, True, True, False, False, False], [False, True, True]]
    assert substring_dedup.deep_nodes([(b"a a a a", 1)], 3)[0].all()


def brute_classes(docs, frequencies, threshold):
    """Classes by comparing all texts."""
    known = [(d, t) for d, t in docs if d is not None]
    owner, shingle, weight, _ = minhash.weighted_shingles(pa.array([t for _, t in known], pa.string()), frequencies)
    sets = defaultdict(dict)
    for o, s, w in zip(owner.tolist(), shingle.tolist(), weight.tolist(), strict=True):
        sets[o][s] = w
    root = {d: d for d, _ in known}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(known)):
        for j in range(i):
            a, b = sets.get(i), sets.get(j)
            if a and b:
                both = sum(min(w, b[s]) for s, w in a.items() if s in b)
                if both / (sum(a.values()) + sum(b.values()) - both) >= threshold:
                    x, y = sorted((find(known[i][0]), find(known[j][0])))
                    root[y] = x
    return {d: find(d) for d, _ in known}


def test_near(odd_docs):
    docs = odd_docs.dropDuplicates(["doc_id"])
    want = brute_classes(rows(docs), minhash.document_frequencies(docs.select("doc_id", "text")), 0.8)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs).collect()}
    assert {d: r["class_id"] for d, r in got.items()} == want
    sizes = Counter(want.values())
    assert all(r["class_size"] == sizes[r["class_id"]] and r["kept"] == (d == r["class_id"]) for d, r in got.items())
    assert minhash.drop_near_duplicates(docs).count() == len(sizes)


def test_near_on_the_given_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute_classes(rows(docs), minhash.document_frequencies(docs.select("doc_id", "text")), 0.8)
    assert {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()} == want


def test_near_of_odd_tables(no_docs, no_id_docs, odd_docs):
    assert minhash.near_duplicates(no_docs).collect() == []
    assert [(r["class_id"], r["class_size"], r["kept"]) for r in minhash.near_duplicates(no_id_docs).collect()] == [(None, 1, True)] * 3
    assert minhash.near_duplicates(odd_docs).count() == odd_docs.count()


def test_near_when_all_texts_share_a_bucket(spark, monkeypatch, sentences):
    """Links that the smallest text of a bucket doesn't show come from the prefix filter, and all of them do."""
    monkeypatch.setattr(minhash, "band_keys", lambda owner, *_: (np.unique(owner), np.ones((len(np.unique(owner)), minhash.BANDS), dtype=np.uint64)))
    draw = np.random.default_rng(6)
    passage, texts = sentences[0].split(), []
    for k in range(40):
        words = [*passage, *sentences[1 + k % 3].split()[:5 + 12 * (k % 4)]]
        for at in draw.integers(0, len(words), size=k % 3):
            words[at] = f"w{k}x{at}"
        texts.append((100 - k, " ".join(words)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = brute_classes(rows(docs), minhash.document_frequencies(docs), 0.8)
    assert {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()} == want
    assert 1 < len(set(want.values())) < 30


def test_near_with_repeated_rows_in_a_mixed_bucket(spark, monkeypatch, sentences):
    """Repeated rows and ids with several texts lose no link that the smallest text of a bucket doesn't show."""
    monkeypatch.setattr(minhash, "band_keys", lambda owner, *_: (np.unique(owner), np.ones((len(np.unique(owner)), minhash.BANDS), dtype=np.uint64)))
    texts = [(0, sentences[0])]
    for k in range(1, 5):
        words = sentences[k].split()
        near = [*words[:60], "changed", *words[61:]]
        texts += [(10 * k, " ".join(words))] * k + [(10 * k + 1, " ".join(near))]
    texts += [(70, sentences[5]), (70, sentences[6]), (71, sentences[5] + " more"), (72, sentences[6] + " more"), (70, None), (73, ""), (73, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    want = {0: 0, **{10 * k + j: 10 * k for k in range(1, 5) for j in range(2)}, 70: 70, 71: 70, 72: 70, 73: 73}
    got = minhash.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["class_id"]) for r in got) == Counter((d, want[d]) for d, _ in texts)
    sizes = Counter(want.values())
    assert all(r["class_size"] == sizes[r["class_id"]] and r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)


def test_samples_collide_as_often_as_weights_agree():
    draw = np.random.default_rng(3)
    shingle = draw.integers(1 << 63, size=400).astype(np.uint64)
    hits = 0
    for trial in range(20):
        owner = np.repeat([0, 1], [300, 300])
        both = np.concatenate([shingle[:300], shingle[60:360]])
        order = np.lexsort((both, owner))
        _, keys = minhash.band_keys(owner, both[order], np.ones(600)[order], seed=trial)
        hits += (keys[0] == keys[1]).sum()
    rate = hits / (20 * minhash.BANDS)  # similarity 240 / 360
    assert abs(rate - (2 / 3) ** minhash.ROWS) < 0.1


def test_components(spark):
    links = [(1, 2), (3, 2), (5, 4), (6, 5), (7, 6), (8, 7), (9, 8), (9, 4), (10, 10)]
    got = graph.components(spark.createDataFrame(links, "a long, b long"))
    assert {r["id"]: r["component"] for r in got.collect()} == {1: 1, 2: 1, 3: 1, **dict.fromkeys(range(4, 10), 4)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_word_hashes():
    texts = [b"ab  c", b"", b" ab c", b"c", b"\nab c\t", b"abc"]
    edges = np.append(0, np.cumsum([len(t) for t in texts]))
    words = shingles.words_of(np.frombuffer(b"".join(texts), dtype=np.uint8), edges)
    assert words.counts.tolist() == [2, 0, 2, 1, 2, 1]
    assert len(set(words.hashes.tolist())) == 3
    same = shingles.whole(words.hashes, words.first)
    assert same[0] == same[2] == same[4] and len({*same.tolist()}) == 4
    assert SimpleNamespace(n=len(shingles.windows(words.hashes, 9))).n == 0


def test_links_to_the_smallest_connect_the_same_texts(spark):
    draw = random.Random(12)
    links = {tuple(sorted(draw.sample(range(60), 2))) for _ in range(45)}

    def classes(pairs):
        root = {k: k for k in range(60)}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            low, high = sorted((find(a), find(b)))
            root[high] = low
        return [find(k) for k in range(60)]

    thinned = [tuple(r) for r in minhash.to_smallest(spark.createDataFrame(sorted(links), "a long, b long")).select("a", "b").collect()]
    assert classes(thinned) == classes(links)
    star = spark.createDataFrame([(k % 3, 10 + k // 3) for k in range(300)], "a long, b long")
    assert minhash.to_smallest(star).count() == 102  # of 300: each text once, and two of its three centres


def test_large_groups_of_near_copies_are_joined_by_few_pairs(spark, monkeypatch):
    draw = random.Random(8)
    base, texts = [f"w{draw.randrange(10 ** 6)}" for _ in range(160)], []
    for k in range(300):
        words = list(base)
        for _ in range(2):
            words[draw.randrange(160)] = f"x{k}y{draw.randrange(10 ** 6)}"
        texts.append((k, " ".join(words)))
    compared, verified = [], minhash.verified
    monkeypatch.setattr(minhash, "verified", lambda pairs, *rest: compared.append(pairs.count()) or verified(pairs, *rest))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()}
    assert got == brute_classes(texts, minhash.document_frequencies(docs), 0.8)
    assert sum(compared) < 300 * 300 / 16


def test_line_filters_of_many_lines_have_a_bounded_size(odd_docs, monkeypatch):
    assert [line_dedup.segments_for(x) for x in (1, 1 << 17, 1 << 18, 1 << 25, 1 << 40)] == [1, 2, 4, 256, 256]
    want = sorted(map(str, line_dedup.drop_repeated_lines(odd_docs, min_docs=2).collect()))
    monkeypatch.setattr(line_dedup, "MOST_BITS", line_dedup.SEGMENT_BITS)
    monkeypatch.setattr(line_dedup, "LINES_PER_DOCUMENT", 1 << 20)
    assert sorted(map(str, line_dedup.drop_repeated_lines(odd_docs, min_docs=2).collect())) == want
