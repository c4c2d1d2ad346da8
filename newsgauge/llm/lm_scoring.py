"""Log-probabilities of texts by a weighted backoff automaton over words.

The root state has an arc for every word, weighted by its smoothed unigram probability. Every word of the training
texts is a state of its own, with an arc for each pair that is seen twice or more, and a failure arc to the root that
carries the probability left. A text goes through once from left to right; the state after a token is that token's.

Nothing of the model depends on the size of the input: all pairs are counted, and the words and arcs are one staged
table. A token adds what its word has in the table (log10 of the root's arc to it and of its own failure arc), and what
its pair has (log10 of how much the arc raises the failure path). Tasks carry only a cache of the table's most frequent
rows; all other words and pairs of the texts are joined with it, in a few rounds. Words are told apart by 63-bit hashes, and so are
pairs with a word that is not in the cache.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgauge.llm import shingles
from newsgauge.llm.shared import crc_of_id, identified, slices, staged, text_bytes

START, END = 0, 1  # ids; those of cached words follow, all others are negative hashes
#: Shares of the tokens below which words have no state and pairs no arc: none.
HISTORY_SHARE = math.inf
ARC_SHARE = math.inf
#: Words and arcs that make up these shares of the tokens or more are looked up in the task.
COMMON_SHARE = 1 << 17
CACHE_SHARE = 1 << 22
FLUSH = 4_000_000
#: Words and pairs are looked up in so many rounds by their hash: what a round shuffles is gone before the next begins.
#: The texts are read once a round, which is a constant factor at any input.
LOOKUP_ROUNDS = 3
_TOP = np.uint64(1 << 63)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(text: str | None) -> list[bytes]:
    """A-Z in lower case; bytes.split() without an argument splits at space and tab to carriage return."""
    return text.encode().lower().split() if text else []


def tokens_of(column: pa.Array, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, place of each START) of the texts of a column; ``known`` are the sorted hashes of the cached words."""
    data, edges = text_bytes(column)
    words = shingles.words_of(_LOWER[data], edges)
    hashes = (words.hashes | _TOP).view(np.int64)
    starts = words.first[:-1] + 2 * np.arange(len(column))
    ids = np.full(len(hashes) + 2 * len(column), END, dtype=np.int64)
    ids[starts] = START
    ids[np.arange(len(hashes)) + 2 * np.repeat(np.arange(len(column)), words.counts) + 1] = cached(hashes, known)
    return ids, starts


def cached(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Ids of cached words, hashes of others."""
    at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
    return np.where(known[at] == hashes, at + END + 1, hashes) if len(known) else hashes


def pair_keys(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Not negative; exact where both ids are cached words'."""
    both = shingles.mixed(shingles.mixed(history.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + word.view(np.uint64))
    return np.where((history >= 0) & (word >= 0), history << 31 | word, (both & ~_TOP).view(np.int64))


def word_counts(training: DataFrame) -> DataFrame:
    """(word, count) over all training texts, END included; counted in the task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            ids, n = np.unique(np.concatenate([*held, np.zeros(0, dtype=np.int64)]), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_pydict({"word": pa.array(ids), "n": pa.array(n.astype(np.int64))})

        for batch in slices(batches):
            ids, _ = tokens_of(batch.column("text"), np.zeros(0, dtype=np.int64))
            held.append(ids[ids != START])
            if sum(map(len, held)) > FLUSH:
                yield flush()
        yield flush()

    return training.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("count"))


def round_of(key: np.ndarray, rounds: int) -> np.ndarray:
    """The round that a key belongs to, in 0 .. rounds - 1."""
    return shingles.mixed(key.view(np.uint64)) % np.uint64(rounds)


def pair_counts(training: DataFrame, known: np.ndarray) -> DataFrame:
    """(history, word, count) of all neighbouring tokens of the training texts; counted in the task before the shuffle."""
    shared = training.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            words, codes = np.unique(np.concatenate([*held, np.zeros(0, dtype=np.int64)]), return_inverse=True)
            held.clear()
            size = max(len(words), 1)
            pairs = codes[:-1] * size + codes[1:]
            pairs, n = np.unique(pairs[words[codes[1:]] != START] if len(codes) else pairs, return_counts=True)
            return pa.RecordBatch.from_pydict({"history": pa.array(words[pairs // size]), "word": pa.array(words[pairs % size]),
                                               "n": pa.array(n.astype(np.int64))})

        for batch in slices(batches):
            held.append(tokens_of(batch.column("text"), shared.value)[0])
            if sum(map(len, held)) > FLUSH:
                yield flush()
        yield flush()

    return (training.select("text").mapInArrow(count, "history long, word long, n long")
            .groupBy("history", "word").agg(F.sum("n").alias("count")))


def discount(ones: int | None, twos: int | None) -> float:
    """Absolute discount from how many are seen once and twice."""
    return ones / (ones + 2 * twos) if ones and twos else 0.5


def score_texts(docs: DataFrame, held_out_of: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Training texts are those whose crc32 of the id's text mod ``held_out_of`` is not 0 (a null id counts as ''). A
    null or empty text is one END token. base_score adds 0.1 to every count; score is the automaton's log10
    probability, in which all words never seen share, evenly over as many words as were seen, what discounting the
    unigrams leaves. Without training texts base_score is 0 and every word has the same score.
    """
    own = identified(docs, id_col, text_col).withColumn("held_out", crc_of_id(F.col("doc_id")) % held_out_of == 0)
    training = own.filter(~F.col("held_out"))
    context = own.sparkSession.sparkContext
    counts = staged(word_counts(training), "words")
    told = counts.agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("count") == 1).alias("ones"),
                      F.count_if(F.col("count") == 2).alias("twos")).first()
    n, v, less = told["n"] or 0, told["v"], discount(told["ones"], told["twos"])
    base_total, total, least = n + 0.1 * (v + 1), max(n, 1), n / COMMON_SHARE
    common = counts.filter((F.col("count") >= least) | (F.col("word") == END)).toPandas().sort_values("word")
    end_count = int(common.loc[common["word"] == END, "count"].sum())
    common = common[common["word"] != END]
    known = common["word"].to_numpy(dtype=np.int64)
    by_id = np.concatenate([[end_count, end_count], common["count"].to_numpy(dtype=np.float64)])  # every training text starts once
    rare_words = counts.filter((F.col("count") < least) & (F.col("word") != END))

    pairs, n_pairs = pair_counts(training, known), n
    if HISTORY_SHARE < math.inf:
        ids = np.flatnonzero(by_id >= n / HISTORY_SHARE).tolist()
        states = (rare_words.filter(F.col("count") >= n / HISTORY_SHARE).select("word")
                  .unionByName(own.sparkSession.createDataFrame([(k,) for k in {START, END, *ids}], "word long")))
        pairs = staged(pairs.join(states, "word", "left_semi").join(states.withColumnRenamed("word", "history"), "history", "left_semi"), "pairs")
        n_pairs = pairs.agg(F.sum("count")).first()[0] or 0
    arcs = staged(pairs.select("history", "word", "count").filter("count > 1"), "arcs")
    seen = arcs.agg(F.sum("count").alias("n"), F.count_if(F.col("count") == 2).alias("twos")).first()
    off = discount(n_pairs - (seen["n"] or 0), seen["twos"])  # every pair that is no arc is seen once
    arcs = arcs.filter(F.col("count") >= n / ARC_SHARE)

    # probability that arcs take from their history: in the words' table, and by id
    taken = staged(arcs.groupBy("history").agg(F.sum(F.col("count") - off).alias("taken")), "taken")
    by_history = taken.filter("history >= 0").toPandas()
    left = np.ones(len(by_id))
    at = by_history["history"].to_numpy(dtype=np.int64)
    left[at] -= by_history["taken"].to_numpy(dtype=np.float64) / np.maximum(by_id[at], 1)
    left = np.clip(left, 1e-9, 1)
    unseen = less / total
    root = np.where(by_id > 0, np.maximum(by_id - less, less) / total, unseen)
    rare = staged(rare_words.join(taken.filter("history < 0").withColumnRenamed("history", "word"), "word", "left").select(
        "word", "count", F.greatest(F.lit(1e-9), 1 - F.coalesce("taken", F.lit(0.0)) / F.col("count")).alias("left"),
        (F.greatest(F.col("count") - less, F.lit(less)) / total).alias("root")), "rare")
    model = context.broadcast((by_id, left, root))

    def raise_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id, left, root = model.value
        for batch in batches:
            history, word, count, own_left, own_root, follows = (batch.column(x).to_numpy(zero_copy_only=False)
                                                                 for x in ("history", "word", "count", "left", "root", "follows"))
            near, here = history >= 0, word >= 0
            own_left, follows = (np.where(near, x[np.where(near, history, 0)], y) for x, y in ((left, own_left), (by_id, follows)))
            own_root = np.where(here, root[np.where(here, word, 0)], own_root)
            held = (count - off) / np.maximum(follows, 1)
            yield pa.RecordBatch.from_pydict({"key": pa.array(pair_keys(history, word)), "count": pa.array(count),
                                              "score": pa.array(np.log10(1 + held / (own_left * own_root)))})

    none = F.lit(None).cast("double")
    far = rare.select(F.col("word").alias("history"), "left", F.col("count").cast("double").alias("follows"))
    by_left = arcs.filter("history >= 0").withColumns({"left": none, "follows": none}).unionByName(arcs.filter("history < 0").join(far, "history"))
    by_root = (by_left.filter("word >= 0").withColumn("root", none)
               .unionByName(by_left.filter("word < 0").join(rare.select("word", "root"), "word")))
    raised = staged(by_root.select("history", "word", "count", "left", "root", "follows")
                    .mapInArrow(raise_by, "key long, count long, score double"), "raised")
    often = raised.filter(F.col("count") >= n / CACHE_SHARE).select("key", "score").toPandas().sort_values("key")
    table = (raised.filter(F.col("count") < n / CACHE_SHARE).select("key", "score", F.lit(0.0).alias("base"), F.lit(0).alias("known"))
             .unionByName(rare.select(F.col("word").alias("key"), F.log10(F.col("root") * F.col("left")).alias("score"),
                                      F.log10((F.col("count") + 0.1) / base_total).alias("base"), F.lit(1).alias("known"))))
    by_token = np.stack([np.log10(root) + np.log10(left), np.log10((by_id + 0.1) / base_total), by_id > 0])
    by_token[:, START] = np.log10(left[START]), 0, 0
    shared = context.broadcast((known, by_token, often["key"].to_numpy(dtype=np.int64), often["score"].to_numpy(dtype=np.float64)))

    never = float(np.log10(unseen)), float(np.log10(0.1 / base_total))

    def walk(batches: Iterator[pa.RecordBatch], own_round: int) -> Iterator[pa.RecordBatch]:
        """A row for each word and pair to look up in a round; in the first one also a row for each text with what the cache
        says, as if none of its other words were known and none of its other pairs an arc."""
        known, by_token, keys, scores = shared.value
        for batch in slices(batches):
            ids, starts = tokens_of(batch.column("text"), known)
            pair = pair_keys(ids[:-1], ids[1:])
            at = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
            hit = keys[at] == pair if len(keys) else np.zeros(len(pair), dtype=bool)
            hit &= ids[1:] != START
            text = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ids))))
            asked_words, asked_pairs = ids < 0, ~hit & (ids[1:] != START)
            if own_round == 0:
                score, base, seen = (np.where(asked_words, other, x[np.maximum(ids, 0)]) for x, other in zip(by_token, (*never, 0), strict=True))
                score[1:][hit] += scores[at[hit]]
                held = [np.add.reduceat(x, starts) for x in (score, base, seen)]
                own = pa.StructArray.from_arrays(
                    [pa.array(np.diff(np.append(starts, len(ids))) - 1), pa.array(held[2].astype(np.int64)), pa.array(held[1]), pa.array(held[0])],
                    ["n_tokens", "known", "base", "score"])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.nulls(batch.num_rows, pa.int64()), own],
                                                 ["doc_id", "text_hash", "key", "own"])
            asked_words &= round_of(ids, LOOKUP_ROUNDS) == own_round
            asked_pairs &= round_of(pair, LOOKUP_ROUNDS) == own_round
            for some, key in ((np.flatnonzero(asked_words), ids), (np.flatnonzero(asked_pairs), pair)):
                for a in range(0, len(some), 1 << 17):
                    part = some[a:a + (1 << 17)]
                    rows = pa.array(text[part])
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("text_hash").take(rows), pa.array(key[part]),
                                                      pa.nulls(len(part), kind)], ["doc_id", "text_hash", "key", "own"])

    # a text is known by its id and hash, which are the same whenever it is read; rows with equal ones have equal results
    texts = own.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    kind = pa.struct([("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])
    names = "doc_id long, text_hash long, key long, own struct<n_tokens:long,known:long,base:double,score:double>"
    told = table.select(F.col("key").alias("told"), *[F.col(x).alias(f"told_{x}") for x in ("score", "base", "known")])
    # what a found word has is more than an unknown one has; sums of plain columns, so that rows need no sorting by text
    word = F.col("told") < 0
    found = {"known": F.col("told_known"), "base": F.when(word, F.col("told_base") - never[1]), "score": F.col("told_score") - F.when(word, never[0]).otherwise(0.0)}
    parts = []
    for k in range(LOOKUP_ROUNDS):
        asked = texts.mapInArrow(lambda batches, k=k: walk(batches, k), names)
        # a text's own row has no key and is dealt out by its hash
        joined = (asked.withColumn("at", F.coalesce("key", "text_hash")).join(told, (F.col("at") == F.col("told")) & F.col("key").isNotNull(), "left" if k == 0 else "inner")
                  .filter("own is not null or told is not null"))
        mine = F.col("own").isNotNull()
        sums = joined.groupBy("doc_id", "text_hash").agg(
            F.count("own").alias("copies"), F.sum("own.n_tokens").alias("n_tokens"),
            *[F.sum(F.when(mine, F.col(f"own.{x}")).otherwise(y)).alias(x) for x, y in found.items()])
        parts.append(staged(sums, "sums"))
    added = reduce(DataFrame.unionByName, parts).groupBy("doc_id", "text_hash").agg(*[F.sum(x).alias(x) for x in ("copies", "n_tokens", "known", "base", "score")])
    return added.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        "doc_id", (crc_of_id(F.col("doc_id")) % held_out_of == 0).alias("held_out"), F.expr("n_tokens div copies").alias("n_tokens"),
        F.expr("known div copies").alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base") / F.col("copies")).alias("base_score"), (F.col("score") / F.col("copies")).alias("score"))
