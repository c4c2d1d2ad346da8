"""Repeated lines: two Bloom filters, for hashes seen once and seen twice; only suspected repeats are shuffled.

Each task sets bits for the lines of its documents, a document counting once, and sends the filters' segments; they
are merged segment by segment: a bit set in two once-filters goes to the twice-filter. So the twice-filter has every
line that two documents share, and some by chance. Suspects are then counted exactly by their text, summed before the
shuffle, and the largest document is chosen; the documents themselves move once, by id.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgauge.llm.shared import WHITE_BYTES, identified, slices

SEGMENT_BITS = 1 << 20
PROBES = 4
#: The filter has about ten bits a line and this many bits at most (32 MB). Beyond that more suspects are shuffled; none are lost.
MOST_BITS = 1 << 28
LINES_PER_DOCUMENT = 16


def line_key(line: bytes) -> bytes:
    """White space at both ends stripped, A-Z in lower case."""
    return line.strip(WHITE_BYTES).lower()


def long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars)


def document_keys(text: str, min_chars: int) -> set[bytes]:
    keys = {line_key(x) for x in text.encode().split(b"\n") if len(x) >= min_chars}
    return {x for x in keys if long_enough(x, min_chars)}


def probe_bits(hashes: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment of each hash, and its PROBES bit places there (hashes x PROBES)."""
    segment = (hashes >> np.uint64(44)).astype(np.int64) % segments
    places = [(hashes >> np.uint64(20)) & np.uint64(SEGMENT_BITS - 1), hashes & np.uint64(SEGMENT_BITS - 1)]
    step = places[1] | np.uint64(1)
    return segment, np.stack([(places[0] + np.uint64(k) * step) & np.uint64(SEGMENT_BITS - 1) for k in range(PROBES)], 1).astype(np.int64)


def _segment_filters(hashes: np.ndarray, segments: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(segment, once bits, twice bits) of the hashes of one task, each hash once a document."""
    found, counts = np.unique(hashes, return_counts=True)
    segment, places = probe_bits(found, segments)
    order = np.argsort(segment, kind="stable")
    edges = np.searchsorted(segment[order], np.arange(segments + 1))
    for s in range(segments):
        mine = order[edges[s]:edges[s + 1]]
        if len(mine):
            bits = np.zeros((2, SEGMENT_BITS), dtype=bool)
            bits[0, places[mine].ravel()] = True
            bits[1, places[mine[counts[mine] > 1]].ravel()] = True
            yield s, *(zlib.compress(np.packbits(x).tobytes(), 1) for x in bits)


def merge_filters(parts: Iterator[tuple[bytes, bytes]]) -> tuple[bytes, bytes]:
    """Once and twice bits of several parts together."""
    once, twice = (np.zeros(SEGMENT_BITS // 8, dtype=np.uint8) for _ in range(2))
    for a, b in parts:
        new = np.frombuffer(zlib.decompress(a), dtype=np.uint8)
        twice |= np.frombuffer(zlib.decompress(b), dtype=np.uint8) | (once & new)
        once |= new
    return zlib.compress(once.tobytes(), 1), zlib.compress(twice.tobytes(), 1)


def segments_for(lines: int) -> int:
    """A power of two: about ten bits a line, MOST_BITS at most."""
    return max(1, min(MOST_BITS, 1 << math.ceil(math.log2(lines * 10))) // SEGMENT_BITS)


def twice_filter(docs: DataFrame, min_chars: int) -> dict[int, bytes]:
    """The twice-seen filter by segment; MOST_BITS bounds it."""
    segments = segments_for(max(1, docs.count()) * LINES_PER_DOCUMENT)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] = []

        def flush() -> pa.RecordBatch:
            rows = list(_segment_filters(np.array(held, dtype=np.uint64), segments))
            held.clear()
            return pa.RecordBatch.from_pydict({
                "segment": pa.array([x[0] for x in rows], pa.int32()), "once": pa.array([x[1] for x in rows], pa.binary()),
                "twice": pa.array([x[2] for x in rows], pa.binary())})

        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                if text:
                    held.extend(map(xxhash.xxh3_64_intdigest, document_keys(text, min_chars)))
            if len(held) > 2_000_000:
                yield flush()
        if held:
            yield flush()

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        once, twice = merge_filters(zip(part["once"], part["twice"], strict=True))
        return pd.DataFrame({"segment": part["segment"].iloc[:1], "once": [once], "twice": [twice]})

    kind = "segment int, once binary, twice binary"
    parts = docs.select("text").mapInArrow(fill, kind)
    some = F.pmod(F.spark_partition_id(), F.lit(max(1, math.isqrt(docs.rdd.getNumPartitions()))))
    merged = parts.withColumn("part", some).groupBy("segment", "part").applyInPandas(merge, kind).groupBy("segment").applyInPandas(merge, kind)
    return {row["segment"]: bytes(row["twice"]) for row in merged.select("segment", "twice").toLocalIterator()} | {-1: str(segments).encode()}


def repeated_lines(docs: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """(doc_id, keys): MD5s of the line keys that each document loses."""
    spark = docs.sparkSession
    known = docs.filter("doc_id is not null")
    shared = spark.sparkContext.broadcast(twice_filter(known, min_chars))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = int(shared.value[-1])
        empty = np.zeros(SEGMENT_BITS, dtype=bool)
        packed = {s: np.frombuffer(zlib.decompress(x), dtype=np.uint8) for s, x in shared.value.items() if s >= 0}
        for batch in slices(batches):
            ids, keys = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text and (own := list(document_keys(text, min_chars))):
                    keys += own
                    ids += [doc] * len(own)
            hashes = np.array([xxhash.xxh3_64_intdigest(x) for x in keys], dtype=np.uint64)
            segment, places = probe_bits(hashes, segments)
            hit = np.zeros(len(keys), dtype=bool)
            for s in np.unique(segment).tolist():
                mine = np.flatnonzero(segment == s)
                bits = packed.get(s)
                hit[mine] = empty[:1][0] if bits is None else ((bits[places[mine] >> 3] >> (7 - (places[mine] & 7)).astype(np.uint8)) & 1).all(axis=1)
            chosen = np.flatnonzero(hit)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(np.array(ids, dtype=np.int64)[chosen]),
                                              "key": pa.array([keys[i].decode() for i in chosen.tolist()], pa.string())})

    found = known.mapInArrow(suspects, "doc_id long, key string")
    confirmed = (found.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("keeper"))
                 .filter(F.col("docs") >= min_docs).select(F.unhex(F.md5(F.col("key").cast("binary"))).alias("hash"), "keeper"))
    lost = (found.select("doc_id", F.unhex(F.md5(F.col("key").cast("binary"))).alias("hash")).join(confirmed, "hash")
            .filter("doc_id <> keeper"))
    return lost.groupBy("doc_id").agg(F.collect_set("hash").alias("keys"))


def drop_repeated_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, id_col: str = "doc_id",
                        text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text (the lines that stay), n_lines, n_dropped.

    Lines end at \\n. Keys of at least ``min_chars`` code points found in at least ``min_docs`` rows go from all of
    them except the row with the largest id. A null or empty text is one empty line. Rows without an id stay as they
    are and don't count; rows that repeat an id count each, and keep the line together if theirs is the largest.
    """
    own = identified(docs, id_col, text_col)
    lost = repeated_lines(own, min_docs, min_chars)

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, lines, dropped = [], [], []
            for text, keys in zip(batch.column("text").to_pylist(), batch.column("keys").to_pylist(), strict=True):
                parts = (text or "").encode().split(b"\n")
                lines.append(len(parts))
                if keys:
                    gone = set(keys)
                    parts = [x for x in parts if len(x) < min_chars or not long_enough(key := line_key(x), min_chars)
                             or hashlib.md5(key).digest() not in gone]
                texts.append(b"\n".join(parts).decode())
                dropped.append(lines[-1] - len(parts))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string()),
                                              "n_lines": pa.array(lines, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())})

    return own.join(lost, "doc_id", "left").mapInArrow(drop, "doc_id long, text string, n_lines long, n_dropped long")
