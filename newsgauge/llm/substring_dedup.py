"""Repeated runs of words by suffix trees over prefix-partitioned suffixes.

Every suffix of interest starts a window of ``window`` words. Shuffling all of them would move the text ``window``
times over, so the tree is sparse: of each window the least of its hashed ANCHOR-word runs is chosen, the suffixes of
a window are grouped by these words, and consecutive windows with the same choice travel as one segment of text.
Equal windows make the same choice, so they meet in one group, and a run of words that is found once in all texts
rules out its windows at once; only the others are shuffled.

A group is one subtree: its suffixes are sorted, and neighbours that share ``window`` words lie below a deep internal
node, so they are repeats. Overlapping windows then make up the maximal repeats. Where a group would be too large
(more than GROUP occurrences), its prefix is lengthened to the whole window; such suffixes need only be counted,
which is done in the task before the shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from newsgauge.llm.shared import identified, slices
from newsgauge.llm.shingles import Words, windows, words_of

ANCHOR = 12
GROUP = 4_096
SLICE = 3 << 20
_PLACE_BITS = np.uint64(28)


def _spaced(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' words with one space between them, behind each other, and the texts' edges."""
    raw = [b" ".join(x.encode().split()) if x else b"" for x in texts]
    return np.frombuffer(b"".join(raw), dtype=np.uint8), np.append(0, np.cumsum([len(x) for x in raw])).astype(np.int64)


def segments(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, windows, anchor) of the runs of windows that choose the same anchor."""
    n, width, counts = len(words.hashes), window - ANCHOR + 1, words.counts
    if n < window:
        return (np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0, dtype=np.uint64),)
    runs = windows(words.hashes, ANCHOR)
    low = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
    least = (runs & ~low) | np.arange(len(runs), dtype=np.uint64)
    have = 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    doc = np.repeat(np.arange(len(counts)), counts)
    start = np.flatnonzero(doc[:n - window + 1] == doc[window - 1:])
    place, owner = (least[start] & low).astype(np.int64), doc[start]
    head = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (owner[1:] != owner[:-1]))[:len(start)])
    return owner[head], start[head], np.diff(np.append(head, len(start))), runs[place[head]]


def _pair_of(data: bytes) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(data)
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _repeated_pieces(batch: pa.RecordBatch, window: int) -> Iterator[tuple[int, int, int, bytes, int | None]]:
    """(row, first word in its text, windows, content, anchor) of the slice's segments with repeated anchors; with
    anchor None, of the single windows of frequent ones."""
    data, edges = _spaced(batch.column("text").to_pylist())
    words, raw = words_of(data, edges), data.tobytes()
    owner, start, count, anchor = segments(words, window)
    listed = batch.column("anchors").flatten()
    known, often = (listed.field(k).to_numpy(zero_copy_only=False) for k in range(2))
    known, first = np.unique(known, return_index=True)
    if not len(known):
        return
    often = often[first]
    at = np.minimum(np.searchsorted(known, anchor.view(np.int64)), len(known) - 1)
    hit = np.flatnonzero(known[at] == anchor.view(np.int64))
    begins, ends, texts = words.begins, words.ends, words.first
    for row, a, n, key, many in zip(owner[hit].tolist(), start[hit].tolist(), count[hit].tolist(), anchor[hit].view(np.int64).tolist(),
                                    often[at[hit]].tolist(), strict=True):
        place = a - int(texts[row])
        if many:
            for k in range(n):
                yield row, place + k, 1, raw[begins[a + k]:ends[a + k + window - 1]], None
        else:
            yield row, place, n, raw[begins[a]:ends[a + n + window - 2]], key


def deep_nodes(contents: list[tuple[bytes, int]], window: int) -> list[np.ndarray]:
    """For each (segment, how often): which of its windows occur more than once. Suffixes of ``window`` words in
    sorted order are the subtree's leaves; equal neighbours hang below one internal node of that depth."""
    leaves = []
    for number, (content, times) in enumerate(contents):
        data = np.frombuffer(content, dtype=np.uint8)
        gaps = np.flatnonzero(data == 0x20)
        begins, ends = np.append(0, gaps + 1).tolist(), np.append(gaps, len(data)).tolist()
        leaves += [(content[begins[k]:ends[k + window - 1]], number, k, times) for k in range(len(begins) - window + 1)]
    marks = [np.zeros(content.count(b" ") + 2 - window, dtype=bool) for content, _ in contents]
    leaves.sort()
    k = 0
    while k < len(leaves):
        stop, total = k, 0
        while stop < len(leaves) and leaves[stop][0] == leaves[k][0]:
            total += leaves[stop][3]
            stop += 1
        if total > 1:
            for _, number, place, _ in leaves[k:stop]:
                marks[number][place] = True
        k = stop
    return marks


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text (the words that stay, one space between them), n_words, n_removed.

    ``text`` of a row that loses nothing is its words with one space between them, too.

    A word goes if it is in a run of ``window`` words that starts anywhere else too, in another row or the same one.
    Words are what white space leaves, unchanged. Null and empty texts have no words; texts shorter than ``window``
    stay. Rows that repeat an id are texts of their own, so repeated rows lose what they share.
    """
    return _removed(identified(docs, id_col, text_col), window).drop("rest")


def drop_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without what ``remove_repeats`` removes; rows that lose nothing stay as they are."""
    own = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"),
                      F.struct(*[docs[c].alias(f"c{k}") for k, c in enumerate(docs.columns)]).alias("rest"))
    changed = F.col("n_removed") > 0
    return _removed(own, window).select(*[
        (F.when(changed, F.col("text")).otherwise(F.col(f"rest.c{k}")) if c == text_col else F.col(f"rest.c{k}")).alias(c)
        for k, c in enumerate(docs.columns)])


def _removed(own: DataFrame, window: int) -> DataFrame:
    """``own`` has doc_id, text and maybe ``rest``, which passes through."""
    if window < 2 * ANCHOR:
        raise ValueError(f"a window has {2 * ANCHOR} words or more")
    if "rest" not in own.columns:
        own = own.withColumn("rest", F.lit(True))
    own = own.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "rest").withColumn("row", F.xxhash64("doc_id", "text"))

    def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            owner, _, _, anchor = segments(words_of(*_spaced(batch.column("text").to_pylist())), window)
            order = np.lexsort((anchor, owner))  # one row for each anchor of a text: a text may repeat a word pair for long
            owner, anchor = owner[order], anchor[order]
            head = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (anchor[1:] != anchor[:-1]))[:len(owner)])
            rows = batch.column("row").to_numpy(zero_copy_only=False)[owner[head]]
            yield pa.RecordBatch.from_pydict({"row": pa.array(rows, pa.int64()), "anchor": pa.array(anchor[head].view(np.int64)),
                                              "n": pa.array(np.diff(np.append(head, len(owner))).astype(np.int32))})

    anchors = own.select("row", "text").mapInArrow(anchor_rows, "row long, anchor long, n int")
    repeated = anchors.groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select(
        "anchor", (F.col("n") > GROUP).alias("often"))
    lists = anchors.drop("n").join(repeated, "anchor").groupBy("row").agg(F.collect_set(F.struct("anchor", "often")).alias("anchors"))
    dealt = own.join(lists, "row")

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments under their anchor, and counted windows of frequent anchors under their own hash."""
        counted: Counter = Counter()
        for batch in slices(batches, limit=SLICE):
            keys, contents = [], []
            for *_, content, anchor in _repeated_pieces(batch, window):
                if anchor is None:
                    counted[_pair_of(content)] += 1
                else:
                    keys.append(anchor)
                    contents.append(content)
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(keys, pa.int64()), "other": pa.nulls(len(keys), pa.int64()), "times": pa.nulls(len(keys), pa.int64()),
                "content": pa.array(contents, pa.binary())})
            if len(counted) > 500_000:
                yield flush(counted)
        yield flush(counted)

    def flush(counted: Counter) -> pa.RecordBatch:
        out = pa.RecordBatch.from_pydict({
            "key": pa.array([x for x, _ in counted], pa.int64()), "other": pa.array([x for _, x in counted], pa.int64()),
            "times": pa.array(counted.values(), pa.int64()), "content": pa.nulls(len(counted), pa.binary())})
        counted.clear()
        return out

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come sorted by key; a subtree is done when the next key begins."""
        key, held, counted = None, Counter(), Counter()
        rows: list[tuple[int, int, bytes]] = []

        def close() -> None:
            if sum(held.values()) > 1:
                contents = list(held.items())
                for (content, _), mark in zip(contents, deep_nodes(contents, window), strict=True):
                    if mark.any():
                        rows.append((*_pair_of(content), np.packbits(mark).tobytes()))
            elif held and window < (content := next(iter(held))).count(b" ") + 1:  # a window may repeat inside its segment
                mark = deep_nodes([(content, 1)], window)[0]
                if mark.any():
                    rows.append((*_pair_of(content), np.packbits(mark).tobytes()))
            rows.extend((key, other, b"\x80") for other, n in counted.items() if n > 1)
            held.clear()
            counted.clear()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pydict({"h1": pa.array([x[0] for x in rows], pa.int64()), "h2": pa.array([x[1] for x in rows], pa.int64()),
                                               "mark": pa.array([x[2] for x in rows], pa.binary())})
            rows.clear()
            return made

        for batch in batches:
            for now, other, times, content in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if now != key:
                    close()
                    key = now
                if content is None:
                    counted[other] += times
                else:
                    held[content] += 1
            yield out()
        close()
        yield out()

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            found = [(row, place, n, *_pair_of(content)) for row, place, n, content, _ in _repeated_pieces(batch, window)]
            rows = np.array([x[0] for x in found], dtype=np.int64)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").take(pa.array(rows)), "row": batch.column("row").take(pa.array(rows)),
                "place": pa.array([x[1] for x in found], pa.int32()), "n": pa.array([x[2] for x in found], pa.int32()),
                "h1": pa.array([x[3] for x in found], pa.int64()), "h2": pa.array([x[4] for x in found], pa.int64())})

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            texts, counts, removed = [], [], []
            for doc, text, marks in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "text", "marks")), strict=True):
                words = text.encode().split()
                counts.append(len(words))
                if marks:
                    steps = np.zeros(len(words) + 1, dtype=np.int32)
                    for one in marks:
                        if one["doc_id"] != doc:  # another document whose row hash is the same
                            continue
                        at = one["place"] + np.flatnonzero(np.unpackbits(np.frombuffer(one["mark"], dtype=np.uint8))[:one["n"]])
                        np.add.at(steps, at, 1)
                        np.add.at(steps, at + window, -1)
                    words = [w for w, gone in zip(words, (np.cumsum(steps[:-1]) > 0).tolist(), strict=True) if not gone]
                texts.append(b" ".join(words).decode())
                removed.append(counts[-1] - len(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                 batch.column("rest")], names=["doc_id", "text", "n_words", "n_removed", "rest"])

    grouped = (dealt.mapInArrow(suffixes, "key long, other long, times long, content binary")
               .repartition("key").sortWithinPartitions("key"))
    marked = grouped.mapInArrow(trees, "h1 long, h2 long, mark binary")
    marks = (dealt.mapInArrow(places, "doc_id long, row long, place int, n int, h1 long, h2 long").join(marked, ["h1", "h2"])
             .groupBy("row").agg(F.collect_set(F.struct("doc_id", "place", "n", "mark")).alias("marks")))
    kind = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("n_words", LongType()),
                       StructField("n_removed", LongType()), StructField("rest", own.schema["rest"].dataType)])
    return own.join(marks, "row", "left").mapInArrow(remove, kind)
