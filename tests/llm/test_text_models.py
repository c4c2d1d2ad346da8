"""BPE, packing, language identification, LM scoring, archives, vectors and the pipeline."""

import base64
import gzip
import hashlib
import math
import os
import random
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from newsgauge.llm import byte_bpe, language_id, lm_scoring, packing, pq_dedup, queries, trie_bpe, warc

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def vocab():
    return byte_bpe.load_vocabulary(open(VOCABULARY).read())


def encoded(vocab, texts, encoder):
    raw = [t.encode() for t in texts]
    edges = np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64)
    ids, at = byte_bpe.encode_texts(vocab, np.frombuffer(b"".join(raw), dtype=np.uint8), edges, encoder)
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]


@pytest.mark.parametrize("encoder", [byte_bpe.merge_words, trie_bpe.trie_words])
def test_encoders_equal_the_library(vocab, tokenizer, encoder):
    draw = random.Random(2)
    parts = [*"abst  \n\t\r'''relvdm019.,!é漢 　²́ 😀-_<|>\x1c\x85", "<|endoftext|>", "'s", "'ll", "'re", " the", " and", "ing", "aaaa"]
    texts = ["", "a", "'s", "it's", "  x", "x  ", "\n\n a", "a" * 400, "<|endoftext|>", "a <|endoftext|> b", "<|endoftext|", " 's", "''s", "a'", "'l"]
    texts += ["".join(draw.choice(parts) for _ in range(draw.randint(0, 40))) for _ in range(3000)]
    assert encoded(vocab, texts, encoder) == [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_round_trip(odd_docs, no_docs, tokenizer):
    got = trie_bpe.encode_and_decode(odd_docs, VOCABULARY).collect()
    texts = Counter((r["doc_id"], r["text"] or "") for r in odd_docs.select("doc_id", "text").collect())
    assert Counter((r["doc_id"], r["decoded"]) for r in got) == texts
    for r in got:
        ids = tokenizer.encode(r["decoded"], add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == tokenizer.decode(ids, skip_special_tokens=False)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert trie_bpe.encode_and_decode(no_docs, VOCABULARY).collect() == []


def test_packing(odd_docs, no_docs, no_id_docs, tokenizer):
    for docs in (odd_docs, no_id_docs):
        got = packing.pack(docs, VOCABULARY, capacity=64).collect()
        want = Counter()
        for r in docs.select("doc_id", "text").collect():
            ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2], dtype="<u4")
            cuts = [0, *range((len(ids) - 1) % 64 + 1, len(ids) + 1, 64)]
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                want[r["doc_id"], k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
        bins = defaultdict(list)
        for r in got:
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        for places in bins.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 64
        assert len(bins) <= math.ceil(sum(r["length"] for r in got) / 64) * 1.05 + 1
    assert packing.pack(no_docs, VOCABULARY).collect() == []


def test_fullest_bin():
    counts = np.zeros(11, dtype=np.int64)
    counts[[7, 5, 4, 3]] = [1, 2, 1, 1]
    assert packing.fullest(counts, 10) == [(7, 1), (3, 1)]
    draw = np.random.default_rng(1)
    for _ in range(30):
        counts = draw.integers(0, 4, size=21)
        counts[0] = 0
        counts[5] += 1
        plan = packing.plan_bins(counts, 20)
        used = np.zeros(21, dtype=np.int64)
        for bins, combination in plan:
            assert sum(n * k for k, n in combination) <= 20
            for k, n in combination:
                used[k] += n * bins
        assert (used == counts).all()
        largest = max(np.flatnonzero(counts))
        sums = {largest}
        left = counts.copy()
        left[largest] -= 1
        for k in np.repeat(np.arange(21), left):
            sums |= {s + k for s in sums}
        assert sum(n * k for k, n in packing.fullest(counts, 20)) == max(s for s in sums if s <= 20)


def test_forward_sums_all_segmentations():
    pieces = language_id.Pieces(open(VOCABULARY).read())
    names = sorted({x for x in byte_bpe.load_vocabulary(open(VOCABULARY).read()).pieces if x and (len(x) == 1 or pieces._usable(x))})
    chance = np.random.default_rng(1).random((len(names) + 1, 2))
    chance[-1] = 0
    place = {x: k for k, x in enumerate(names)}

    def total(word):
        return sum((chance[place[word[:k]]] * total(word[k:]) for k in range(1, len(word) + 1) if word[:k] in place), np.zeros(2)) if word else np.ones(2)

    words = ["thing", "été", "a"]
    got = pieces.log_words(words, chance)
    for k, w in enumerate(words):
        assert np.allclose(got[k], np.log(total(b" " + w.encode())))


def test_language(spark, no_docs, no_id_docs):
    draw = random.Random(4)
    letters = {"xx": "abcdefg", "yy": "éàüßnopq"}
    rows = [(k, " ".join("".join(draw.choice(letters[lang]) for _ in range(4)) for _ in range(15)), lang if k % 5 else None)
            for k, lang in enumerate(draw.choices(["xx", "yy"], k=90))]
    odd = [(200, None, "xx"), (201, "", "xx"), (202, "12 345 --!", "yy"), (203, "abc" * 4000, None), (None, "abcdefg abc", "xx"), rows[0]]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("held_out", F.lit("z"))
    got = {r["doc_id"]: r for r in language_id.identify(docs, VOCABULARY).collect()}
    truth = {k: "xx" if set(t) & set("abcdefg") else "yy" for k, t, _ in rows}
    assert all(got[k]["lang_pred"] == v and 0.5 < got[k]["score"] <= 1 for k, v in truth.items())
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in got.items() if k is not None)
    assert [got[k]["lang_pred"] for k in (200, 201, 202, 203, None)] == ["und", "und", "und", "xx", "xx"]
    assert language_id.identify(no_docs, VOCABULARY).collect() == []
    assert {r["lang_pred"] for r in language_id.identify(no_id_docs, VOCABULARY).collect()} == {"und"}
    kept = language_id.drop_unidentified(docs, VOCABULARY)
    assert kept.schema == docs.schema and kept.count() == docs.count() - 3


def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    told = language_id.identify(docs, VOCABULARY).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert told.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def brute_scores(rows, told):
    """The automaton by dictionaries, one token after the other."""
    texts = {d: [w.decode() for w in lm_scoring.words_of(t)] for d, t in rows}
    training = [(d, t) for d, t in rows if zlib.crc32(b"" if d is None else str(d).encode()) % 10]
    counts, pairs, ids = Counter(), Counter(), {}
    for d, _ in training:
        counts.update([*texts[d], "\n"])
    n, v = sum(counts.values()), len(counts)
    history = {w for w, c in counts.items() if c >= n / lm_scoring.HISTORY_SHARE} | {"\n", "^"}
    for d, _ in training:
        walk = ["^", *texts[d], "\n"]
        pairs.update((a, b) for a, b in zip(walk, walk[1:], strict=False) if a in history and b in history)
    off = lm_scoring.discount(sum(c == 1 for c in pairs.values()), sum(c == 2 for c in pairs.values()))
    less = lm_scoring.discount(sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values()))
    arcs = {k: c for k, c in pairs.items() if c > 1 and c >= n / lm_scoring.ARC_SHARE}
    follows = counts | {"^": counts["\n"]}
    left = {a: 1.0 for a in history}
    for (a, _), c in arcs.items():
        left[a] -= (c - off) / follows[a]
    for d, _ in rows:
        state, score, base = "^", 0.0, 0.0
        for w in [*texts[d], "\n"]:
            root = max(counts[w] - less, less) / n if counts[w] else less / n
            p = left.get(state, 1.0) * root
            if (state, w) in arcs:
                p += (arcs[state, w] - off) / follows[state]
            score += math.log10(p)
            base += math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1)))
            state = w
        ids[d] = (len(texts[d]) + 1, sum(counts[w] > 0 for w in [*texts[d], "\n"]), n, base, score)
    for r in told:
        want = ids[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[:3]
        assert math.isclose(r["base_score"], want[3], rel_tol=1e-9) and math.isclose(r["score"], want[4], rel_tol=1e-9)


@pytest.mark.parametrize("common", [1 << 17, 16])
def test_lm(odd_docs, no_docs, no_id_docs, monkeypatch, common):
    monkeypatch.setattr(lm_scoring, "COMMON_SHARE", common)
    monkeypatch.setattr(lm_scoring, "HISTORY_SHARE", min(common, 64))
    docs = odd_docs.dropDuplicates(["doc_id"])
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    told = lm_scoring.score_texts(docs).collect()
    assert len(told) == len(rows) and {r["held_out"] for r in told} == {True, False}
    brute_scores(rows, told)
    assert lm_scoring.score_texts(odd_docs).count() == odd_docs.count()
    assert lm_scoring.score_texts(no_docs).collect() == []
    assert {(r["train_tokens"], r["n_known"], r["base_score"]) for r in lm_scoring.score_texts(no_id_docs).collect()} == {(0, 0, 0.0)}


def test_lm_keeps_pairs_that_are_rare_in_a_large_corpus(spark, monkeypatch):
    """Pairs seen twice are arcs, however many other tokens there are, in the cache or not."""
    draw = random.Random(8)
    texts = [" ".join(draw.choice("abcdefgh") for _ in range(300)) for _ in range(60)]
    for k in range(60):
        texts[k] += f" rare{k % 20} seldom{k % 20} once{k} Rare{k % 7}"
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = lm_scoring.score_texts(docs).collect()
    monkeypatch.setattr(lm_scoring, "COMMON_SHARE", 64)
    monkeypatch.setattr(lm_scoring, "CACHE_SHARE", 64, raising=False)
    joined = lm_scoring.score_texts(docs).collect()
    monkeypatch.setattr(lm_scoring, "HISTORY_SHARE", math.inf)
    monkeypatch.setattr(lm_scoring, "ARC_SHARE", math.inf)
    for told in (kept, joined):
        assert len(told) == len(rows)
        brute_scores(rows, told)


@pytest.mark.parametrize("min_bytes", [0, 20])
def test_archives(spark, tmp_path, min_bytes):
    tricky = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + "é漢" * 30
    pages = [(3, "http://a", "same text of twenty letters or more"), (1, "http://b\r\nX: y", "same text of twenty letters or more"), (2, None, None),
             (5, "u", ""), (4, "u", "short"), (6, "u", "short"), (7, "u", tricky), (8, "v", tricky), (None, "w", "short"), (9, "u", "z" * 300_000), (1, "q", "other")]
    frame = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, digest string").repartition(3)
    folder = str(tmp_path / "archives")
    warc.write_archives(frame, folder, min_bytes)
    read = warc.read_archives(spark, folder)
    got = {(r["page_id"], r["payload_digest"]): r for r in warc.resolve_revisits(read).collect()}
    assert len(got) == len(pages)
    first = {}
    for page, _, html in pages:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    for page, _, html in pages:
        body = (html or "").encode()
        r = got[page, base64.b32encode(hashlib.sha1(body).digest()).decode()]
        own = page is None or len(body) < min_bytes or first[html or ""] == page
        assert r["payload_bytes"] == len(body) and (r["record_type"], r["refers_to"]) == (("response", None) if own else ("revisit", first[html or ""]))
    payloads = {r["page_id"]: r["payload"] for r in read.filter("record_type = 'response'").collect()}
    assert payloads[7] == tricky and payloads[9] == "z" * 300_000
    part = next(p for p in (tmp_path / "archives").glob("part-*"))
    assert gzip.decompress(part.read_bytes()).startswith(b"WARC/1.1\r\nWARC-Type: ")


def test_archives_of_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "none"))
    assert warc.resolve_revisits(warc.read_archives(spark, str(tmp_path / "none"))).collect() == []


def test_payloads_are_hashed_once_and_archives_read_once(spark, tmp_path):
    texts = spark.createDataFrame([("a" * k,) for k in range(40)] + [(None,)], "html string").select("html", warc.sha1_base32(F.encode("html", "UTF-8")).alias("d"))
    assert texts._jdf.queryExecution().optimizedPlan().toString().count("sha1(") == 1
    want = {h: h and base64.b32encode(hashlib.sha1(h.encode()).digest()).decode() for h in [*["a" * k for k in range(1, 40)], None]}
    assert {r["html"]: r["d"] for r in texts.where("html IS NULL OR html <> ''").collect()} == want
    warc.write_archives(spark.createDataFrame([(1, "u", "x"), (2, "u", "x")], "page_id long, url string, html string"), str(tmp_path / "two"))
    found = warc.resolve_revisits(warc.read_archives(spark, str(tmp_path / "two")))
    assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count() == 2


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(pq_dedup, "BLOCK", 16)
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(6, 12))
    points = [centres[k % 6] + draw.normal(size=12) * 0.09 for k in range(120)]
    rows = [(k, p.tolist(), str(k % 2)) for k, p in enumerate(points)]
    rows += [(200, points[0].tolist(), "0"), (201, (points[0] * 3).tolist(), "0"), (202, points[0].tolist(), None), (203, None, "0"), (204, [0.0] * 12, "0"),
             (205, [1.0, None] + [0.0] * 10, "0"), (206, [float("nan")] * 12, "0"), (207, [float("inf")] * 12, "0"), (208, [], "0"),
             (209, [1.0, 0.0], "0"), (210, [2.0, 0.0], "0"), (211, [1e300] * 12, "1"), (0, points[0].tolist(), "0")]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "vec_id long, embedding array<double>, label string, rep string").repartition(3)
    fine = [(i, k, np.array(v) / max(map(abs, v)), lab) for i, (k, v, lab) in enumerate(rows)
            if lab and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, root = Counter(), {k: k for k, *_ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a, x, la in fine:
        for j, b, y, lb in fine:
            if i != j and la == lb and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                links[i] += 1
                p, q = sorted((find(a), find(b)))
                root[q] = p
    want = Counter((r[0], links[i], find(r[0]), find(r[0]) == r[0]) for i, r in enumerate(rows))
    got = pq_dedup.near_duplicate_vectors(frame).collect()
    assert Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == want
    assert max(links.values()) > 5
    none = spark.createDataFrame([], "vec_id long, embedding array<double>, label string")
    assert pq_dedup.near_duplicate_vectors(none).collect() == []


@pytest.mark.parametrize("element", ["double", "float"])
def test_vectors_with_repeated_and_missing_ids(spark, element):
    """Ids name rows, not vectors: each (label, vector) links and groups by itself."""
    draw = np.random.default_rng(9)
    near = [(np.array([1.0, 2.0, 3.0, 4.0]) + draw.normal(size=4) * 0.02).astype(np.float32).tolist() for _ in range(8)]
    far = [4.0, -3.0, 2.0, -1.0]
    rows = [(1, near[0], "a"), (1, near[1], "a"), (2, near[2], "a"), (None, near[3], "a"), (5, near[4], "b"), (6, near[5], "b"),
            (5, far, "c"), (7, [x * 2 for x in far], "c"), (None, [0.0, 0.0, 0.0, 1.0], "d"), (None, near[6], "e"), (None, near[7], "e"), (9, near[0], "f")]
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{element}>, label string").repartition(3)
    got = Counter(tuple(r) for r in pq_dedup.near_duplicate_vectors(frame).select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == Counter([(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (None, 3, 1, False), (5, 1, 5, True), (6, 1, 5, False),
                           (5, 1, 5, True), (7, 1, 5, False), (None, 0, None, True), (None, 1, None, True), (None, 1, None, True), (9, 0, 9, True)])


def test_queries_run_where_workers_lack_the_package(tmp_path):
    """A session started in another folder, whose workers find neither this package nor its modules."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    script = tmp_path / "far.py"
    script.write_text(f"""
import os, sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
for name, query in entry.queries().items():
    if name.startswith("op"):
        query(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
        print("ran", name)
""")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.stdout.count("ran op") == len(queries.QUERIES), done.stdout + done.stderr[-3000:]


def test_no_link_of_vectors_in_few_directions_is_lost(spark):
    """Where all displacements lie in three of 64 dimensions, many of them point straight to another list."""
    draw = np.random.default_rng(4)
    plane = np.linalg.qr(draw.normal(size=(64, 3)))[0]
    points = draw.normal(size=(2000, 3)) @ plane.T
    points /= np.sqrt((points * points).sum(axis=1, keepdims=True))
    frame = spark.createDataFrame([(k, p.tolist(), "0") for k, p in enumerate(points)], "vec_id long, embedding array<double>, label string")
    want = (points @ points.T >= 0.98).sum(axis=1) - 1
    got = {r["vec_id"]: r["n_links"] for r in pq_dedup.near_duplicate_vectors(frame.repartition(3)).collect()}
    assert [got[k] for k in range(2000)] == want.tolist() and want.sum() > 2000


def test_pipeline(spark, tmp_path, odd_texts):
    folder = str(tmp_path)
    rows = [(k, t, "xx", f"s{k}", len(t or "")) for k, t in enumerate(odd_texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        left.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    letters = {k for k, t, *_ in rows if any(c.isalpha() for c in t or "")}
    assert left[0] == letters
    assert left[0] - left[1] == {1, 2, 11}  # copies of 0 and of 10
    assert 3 in left[1] - left[2] and left[2] == left[3] == left[4]
    once = sorted(map(str, corpus_pipeline.run(spark, folder).drop("sequence_id", "offset").collect()))
    assert once == sorted(map(str, docs.drop("sequence_id", "offset").collect()))


def test_pipeline_keeps_short_texts_that_languages_share(spark):
    rows = [(k, f"shared {own} shared", own) for k, own in enumerate(["aaa", "bbb", "ccc"] * 6)] + [(100, "shared", None), (101, "12", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, "").collect()} == {*range(18), 100}


def test_pipeline_drops_long_texts_without_one_language(spark):
    learned = [k for k in range(90) if zlib.crc32(str(k).encode()) % 3 != 1][:9]
    rows = [(k, "shared words", lang) for k, lang in zip(learned, ["aaa", "bbb", "ccc"] * 3, strict=True)]  # the same in each language
    rows += [(100, "shared " * 7, None), (101, "shared " * 8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, "").collect()} == {*learned, 100}


def test_every_query_is_registered():
    assert sorted({int(x[2:].split("_")[0]) for x in queries.QUERIES}) == list(range(1, 11))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
