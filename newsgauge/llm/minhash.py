"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles, in bands, verified exactly.

A shingle is five words; its weight is how often it is in the text times the mean inverse document frequency of its
words, scaled to 1 .. 2 so that edits don't outweigh what two copies share. Each of BANDS x ROWS samples is equal in
two texts with the probability of their weighted Jaccard similarity. Texts with an equal band are candidates:

1. each against the first of its bucket, so that a bucket of copies costs one comparison a member;
2. where that leaves a bucket in several clusters, its texts are paired by an exact filter over all their shingles
   (``prefix_pairs``), which drops no pair that is similar enough; first with a few members of other clusters, then with
   one of each cluster that is left, then with all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsgauge.llm.graph import components
from newsgauge.llm.shared import identified, slices, staged, text_bytes
from newsgauge.llm.shingles import mixed, windows, words_of, whole

SHINGLE = 5
BANDS, ROWS = 12, 3
#: Words in fewer than one of so many documents all have the weight 2; the others are a table of (mean distinct words
#: of a document) x RARE entries at most.
RARE = 500
POOL_BITS = 14
SLICE = 3 << 20
#: Weights travel as 32-bit floats, so bounds leave this much room.
SLACK = 1e-4
#: Members that a text of an open bucket is compared with at first, for each size that differs by SIZE_STEP.
HEADS = 4
SIZE_STEP = 1.25


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted word hashes, weights) of the words in one of RARE documents or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sums = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        for batch in slices(batches, limit=SLICE):
            words = words_of(*text_bytes(batch.column("text")))
            doc = np.repeat(np.arange(len(words.counts)), words.counts)
            order = np.lexsort((words.hashes, doc))
            h, d = words.hashes[order], doc[order]
            once = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))[:len(h)]
            found, n = np.unique(h[once], return_counts=True)
            joined, back = np.unique(np.concatenate([hashes, found]), return_inverse=True)
            hashes, sums = joined, np.bincount(back, weights=np.concatenate([sums, n]), minlength=len(joined)).astype(np.int64)
            if len(hashes) > 1_000_000:
                yield pa.RecordBatch.from_pydict({"word": pa.array(hashes.view(np.int64)), "n": pa.array(sums)})
                hashes, sums = hashes[:0], sums[:0]
        yield pa.RecordBatch.from_pydict({"word": pa.array(hashes.view(np.int64)), "n": pa.array(sums)})

    total = max(1, docs.count())
    table = (docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
             .filter(F.col("n") * RARE >= total).toPandas())
    words = table["word"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(words)
    share = table["n"].to_numpy(dtype=np.float64)[order] / total
    return words[order], 1 + np.clip(-np.log(np.minimum(share, 1)) / np.log(RARE), 0, 1)


def weighted_shingles(column: pa.Array, frequencies: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight) of the distinct shingles of a column's texts, sorted by text and shingle, and each
    text's word sequence as two hashes. A text of one to four words has one shingle, of all of them."""
    words = words_of(*text_bytes(column))
    known, weights = frequencies
    at = np.minimum(np.searchsorted(known, words.hashes), max(len(known) - 1, 0))
    weight = np.where(known[at] == words.hashes, weights[at], 2.0) if len(known) else np.full(len(words.hashes), 2.0)
    counts = words.counts
    doc = np.repeat(np.arange(len(counts)), counts)
    sums = np.append(0, np.cumsum(weight))
    full = np.flatnonzero(doc[SHINGLE - 1:] == doc[:len(doc) - SHINGLE + 1]) if len(doc) >= SHINGLE else np.zeros(0, dtype=np.int64)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    sequence = np.stack([whole(words.hashes, words.first, salt) for salt in (1, 2)], 1)
    shingle = np.concatenate([windows(words.hashes, SHINGLE)[full], sequence[short, 0]])
    value = np.concatenate([(sums[full + SHINGLE] - sums[full]) / SHINGLE,
                            (sums[words.first[short + 1]] - sums[words.first[short]]) / np.maximum(counts[short], 1)])
    owner = np.concatenate([doc[full], short])
    order = np.lexsort((shingle, owner))
    shingle, value, owner = shingle[order], value[order], owner[order]
    head = np.flatnonzero(np.append(True, (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1]))[:len(shingle)])
    times = np.diff(np.append(head, len(shingle)))
    return owner[head], shingle[head], value[head] * times, sequence


def band_keys(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(texts with shingles, their BANDS keys). The random numbers of a sample come from a pool by the shingle's hash."""
    edges = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])[:len(owner)])
    logs, place = np.log(weight).astype(np.float32), np.arange(len(owner), dtype=np.uint64)
    draw = np.random.default_rng(seed)
    keys = np.zeros((len(edges), BANDS), dtype=np.uint64)
    for k in range(BANDS * ROWS):
        r, c = (draw.gamma(2.0, 1.0, 1 << POOL_BITS).astype(np.float32) for _ in range(2))
        beta = draw.random(1 << POOL_BITS, dtype=np.float32)
        odd = np.uint64(draw.integers(1 << 62, dtype=np.int64) * 2 + 1)
        if not len(edges):
            continue
        at = ((shingle * odd) >> np.uint64(64 - POOL_BITS)).astype(np.int32)
        rk, bk = r[at], beta[at]
        t = np.floor(logs / rk + bk)
        a = np.log(c)[at] - rk * (t - bk + 1)
        bits = a.view(np.int32).astype(np.int64)
        bits = np.where(bits < 0, ~bits & 0xFFFFFFFF, bits | 0x80000000).astype(np.uint64)
        least = (np.minimum.reduceat(bits << np.uint64(32) | place, edges) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        sample = mixed(shingle[least] ^ mixed(t[least].astype(np.int64).view(np.uint64) + np.uint64(k)))
        keys[:, k // ROWS] = mixed(keys[:, k // ROWS] * np.uint64(31) + sample + np.uint64(k))
    return owner[edges], keys


def signatures(docs: DataFrame, frequencies) -> DataFrame:
    """doc_id, text, s1 and s2 (the word sequence; null without words), bands."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            owner, shingle, weight, sequence = weighted_shingles(batch.column("text"), frequencies.value)
            own, keys = band_keys(owner, shingle, weight)
            lengths = np.zeros(batch.num_rows, dtype=np.int64)
            lengths[own] = BANDS
            none = lengths == 0
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "text": batch.column("text"), "s1": pa.array(sequence[:, 0].view(np.int64) if len(sequence) else [], pa.int64(), mask=none),
                "s2": pa.array(np.ascontiguousarray(sequence[:, 1]).view(np.int64), pa.int64(), mask=none),
                "bands": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), pa.array(keys.ravel().view(np.int64)))})

    return docs.mapInArrow(sign, "doc_id long, text string, s1 long, s2 long, bands array<long>")


def similarities(left: pa.Array, right: pa.Array, frequencies) -> np.ndarray:
    """Weighted Jaccard similarity of the texts in two columns, row by row."""
    sides = [weighted_shingles(x, frequencies)[:3] for x in (left, right)]
    pair, shingle, weight = (np.concatenate(x) for x in zip(*sides, strict=True))
    order = np.lexsort((shingle, pair))
    pair, shingle, weight = pair[order], shingle[order], weight[order]
    same = np.flatnonzero((pair[1:] == pair[:-1]) & (shingle[1:] == shingle[:-1]))
    total = np.bincount(pair, weights=weight, minlength=len(left))
    both = np.bincount(pair[same], weights=np.minimum(weight[same], weight[same + 1]), minlength=len(left))
    return both / np.maximum(total - both, 1e-300)


def verified(pairs: DataFrame, docs: DataFrame, frequencies, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) whose texts are similar enough; ``docs`` has one row for each. The text of b is fetched first: a may be in many pairs,
    and such rows are then large enough for Spark to split."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches, "text_a", SLICE), "text_b", SLICE):
            good = similarities(batch.column("text_a"), batch.column("text_b"), frequencies.value) >= threshold - 1e-9
            yield batch.select(["a", "b"]).filter(pa.array(good))

    texts = docs.select("doc_id", "text")
    with_b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return staged(both.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long"), "links")


def to_smallest(links: DataFrame) -> DataFrame:
    """(a, b) links that connect the same texts: each b to its smallest a, and its other a to that one. A text has a link
    for each band at most, and texts of a large class have theirs to the same few."""
    low = links.select("a", "b", F.min("a").over(Window.partitionBy("b")).alias("low"))
    return low.select(F.col("low").alias("a"), "b").distinct().unionByName(
        low.filter("a <> low").select(F.col("low").alias("a"), F.col("a").alias("b")).distinct())


def prefix_lists(docs: DataFrame, ids: DataFrame, frequencies, threshold: float) -> DataFrame:
    """(shingle, id, total, rest): of the texts with these ids, the shingles by which a similar text must be found;
    ``docs`` has one row for each id.

    Take each text's shingles from the rarest to the most frequent, all in one order. Of two texts with a similarity of
    t, both have their first common shingle within the first 1 - t of their weight, and what is left from it on must
    make up t / (1 + t) of both weights together. So a passage that many texts share makes no pairs of texts that also
    have much of their own.
    """

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            owner, shingle, weight, _ = weighted_shingles(batch.column("text"), frequencies.value)
            yield pa.RecordBatch.from_pydict({"id": batch.column("doc_id").take(pa.array(owner)), "shingle": pa.array(shingle.view(np.int64)),
                                              "weight": pa.array(weight.astype(np.float32))})

    chosen = docs.join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    rows = chosen.select("doc_id", "text").mapInArrow(unfold, "id long, shingle long, weight float")
    shared = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("texts"))
    one = Window.partitionBy("id")
    before = one.orderBy("texts", "shingle").rowsBetween(Window.unboundedPreceding, -1)
    return staged(rows.join(shared, "shingle")
                  .withColumns({"before": F.coalesce(F.sum("weight").over(before), F.lit(0.0)), "total": F.sum("weight").over(one)})
                  .filter((F.col("texts") > 1) & (F.col("before") <= (1 - threshold) * F.col("total") * (1 + SLACK)))
                  .select("shingle", "id", "total", (F.col("total") - F.col("before")).alias("rest")), "lists")


def prefix_pairs(lists: DataFrame, clusters: DataFrame, threshold: float, first: bool = False, heads: int = 0) -> DataFrame:
    """(a, b), a < b: pairs in different ``clusters`` (id, cluster) that can be similar enough, by their ``lists``.

    In a list of texts with a shingle, members of its largest cluster are not paired with each other. With ``first``,
    texts are paired with only one member of each other cluster in a list, the one with most left: where a text belongs
    to a large cluster, one such link spares it the pairs with all members. With ``heads``, clusters are dealt into so
    many classes by hash, and texts are paired with one member of a class and of about a size: a large group that is
    still in many clusters is joined by pairs in proportion to its size.
    """
    lists = lists.join(clusters, "id")
    sizes = lists.groupBy("shingle", "cluster").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("shingle").agg(F.max_by("cluster", F.struct("n", "cluster")).alias("main"), F.count(F.lit(1)).alias("clusters")).filter("clusters > 1")
    inside = lists.join(largest.select("shingle", "main"), "shingle")
    left = inside.filter("cluster <> main").select("shingle", *[F.col(x).alias(f"left_{x}") for x in ("id", "cluster", "total", "rest")])
    if first or heads:
        head = F.max(F.struct("rest", "total", "id", "cluster")).alias("head")
        own = [F.floor(F.log("total") / math.log(SIZE_STEP)), F.pmod(F.xxhash64("cluster"), F.lit(heads))] if heads else ["cluster"]
        inside = inside.groupBy("shingle", *own).agg(head).select("shingle", "head.*")
    needed = threshold / (1 + threshold) * (1 - SLACK)
    one_way = F.lit(True) if first or heads else (F.col("cluster") == F.col("main")) | (F.col("left_id") < F.col("id"))
    both = left.join(inside, "shingle").filter(
        (F.col("left_cluster") != F.col("cluster")) & one_way & (F.least("left_rest", "rest") >= needed * (F.col("left_total") + F.col("total"))))
    return both.select(F.least("left_id", "id").alias("a"), F.greatest("left_id", "id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, class_size, kept.

    class_id is the smallest id reachable by links between texts of at least ``threshold`` weighted Jaccard
    similarity; texts with the same words in the same order are one. Texts without words are each alone. Rows without
    an id are alone: class_id is null and they are kept. Rows that repeat an id share its class; kept is true for
    all of them or none. An empty table gives an empty result.
    """
    spark: SparkSession = docs.sparkSession
    own = identified(docs, id_col, text_col)
    frequencies = spark.sparkContext.broadcast(document_frequencies(own))
    # one key for each row, and of rows with the same words that of one of them; ids come back in at the end
    signed = staged(signatures(own.filter("doc_id is not null"), frequencies).withColumn("row", F.monotonically_increasing_id()), "signatures")
    bodies = signed.select(F.col("row").alias("doc_id"), "text")
    texts = staged(signed.filter("s1 is not null").groupBy("s1", "s2").agg(F.min("row").alias("id"), F.min_by("bands", "row").alias("bands")), "texts")
    placed = staged(signed.select("doc_id", "row", "s1", "s2").join(texts.select("s1", "s2", "id"), ["s1", "s2"], "left")
                    .select("doc_id", F.coalesce("id", "row").alias("id")), "placed")
    several = placed.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("high")).filter("a <> high").drop("high")
    same_id = placed.join(several, "doc_id").select("a", F.col("id").alias("b"))  # rows that repeat an id share its class
    members = texts.select("id", F.posexplode("bands").alias("band", "value")).select(F.xxhash64("band", "value").alias("bucket"), "id")
    leaders = members.groupBy("bucket").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    members = staged(members.join(leaders, "bucket"), "members")  # only buckets of two texts or more
    tested = staged(members.filter("id <> a").select("a", F.col("id").alias("b")).distinct(), "pairs")
    links = staged(to_smallest(verified(tested, bodies, frequencies, threshold)).unionByName(same_id), "links")
    found = components(links)

    def clustered(ids: DataFrame, found: DataFrame) -> DataFrame:
        """(..., id, cluster): ids without links are clusters of their own."""
        known = found.withColumnRenamed("id", "own")
        return ids.join(known, F.col("id") == F.col("own"), "left").withColumn("cluster", F.coalesce("component", "id")).drop("own", "component")

    inside = clustered(members.select("bucket", "id"), found)
    apart = inside.groupBy("bucket").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high")).filter("low <> high").select("bucket")
    open_texts = staged(inside.join(apart, "bucket", "left_semi").select("id").distinct(), "open")
    if not open_texts.isEmpty():
        lists = prefix_lists(bodies, open_texts, frequencies, threshold)
        for first, heads in ((False, HEADS), (True, 0), (False, 0)):
            clusters = clustered(open_texts, found)
            more = staged(prefix_pairs(lists, clusters, threshold, first, heads).join(tested, ["a", "b"], "left_anti"), "pairs")
            links = staged(links.unionByName(verified(more, bodies, frequencies, threshold)), "links")
            tested = tested.unionByName(more)
            found = components(links)
    groups = placed.join(found, "id", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "id")).alias("group"))
    sizes = groups.groupBy("group").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    classes = groups.join(sizes, "group").drop("group")
    return own.select("doc_id").join(classes, "doc_id", "left").select(
        "doc_id", "class_id", F.coalesce("class_size", F.lit(1)).alias("class_size"),
        (F.col("class_id").isNull() | (F.col("doc_id") == F.col("class_id"))).alias("kept"))


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps: of each class the one with the smallest id."""
    lost = near_duplicates(docs, threshold, id_col, text_col).filter(~F.col("kept")).select(F.col("doc_id").alias("_lost")).distinct()
    return docs.join(lost, docs[id_col].cast("bigint") == lost["_lost"], "left_anti")
