"""Best-fit packing by minimum bin slack.

For each bin a subset-sum over the lengths still there, on a bitset, finds the fullest combination that fits. Pieces of
one length are alike, so the search runs on the histogram of lengths (``capacity`` numbers, whatever the input) and
takes a found combination as often as its lengths allow; each step uses up at least one length. Pieces then find their
place from their rank among the pieces of their length, which is a sum of counts and a rank in a small group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsgauge.llm.byte_bpe import encoded_slices, load_vocabulary, merge_words
from newsgauge.llm.shared import identified, staged

END_ID = 2
#: Pieces of a length are ranked in groups of about this many documents.
GROUP_DOCUMENTS = 4096
#: Text that is encoded at a time; the arrays of a slice take some twenty times its bytes.
ENCODED_BYTES = 2 << 20


def fullest(counts: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """(length, how many) of the fullest feasible bin; the longest piece there is is always in it.

    Lengths are tried from long to short, in powers of two of their number; ``reach`` has a bit for each sum.
    """
    lengths = np.flatnonzero(counts)[::-1].tolist()
    first, mask = lengths[0], (1 << (capacity + 1)) - 1
    reach, steps = 1 << first, []
    for length in lengths:
        there = min(int(counts[length]) - (length == first), (capacity - first) // length)
        take = 1
        while there > 0:
            take = min(take, there)
            before, reach = reach, (reach | reach << (take * length)) & mask
            steps.append((length, take, before))
            there -= take
            take *= 2
        if reach >> capacity & 1:
            break
    total = reach.bit_length() - 1
    chosen = {first: 1}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= take * length
    return sorted(chosen.items(), reverse=True)


def plan_bins(counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of bins, their combination) until no piece is left; at most ``capacity`` entries."""
    left, plan = counts.astype(np.int64).copy(), []
    while left.any():
        combination = fullest(left, capacity)
        bins = min(int(left[length]) // n for length, n in combination)
        for length, n in combination:
            left[length] -= n * bins
        plan.append((bins, combination))
    return plan


def place(plan: list[tuple[int, list[tuple[int, int]]]], capacity: int) -> dict[int, np.ndarray]:
    """For each length rows of (first rank, first bin, pieces in a bin, offset in the bin) by rank."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used, first_bin = np.zeros(capacity + 1, dtype=np.int64), 0
    for bins, combination in plan:
        offset = 0
        for length, n in combination:
            rows.setdefault(length, []).append((int(used[length]), first_bin, n, offset))
            used[length] += n * bins
            offset += n * length
        first_bin += bins
    return {k: np.array(v, dtype=np.int64) for k, v in rows.items()}


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int) -> DataFrame:
    """doc_id, row (tells repeated ids apart), piece, start, length, ids_crc32 of every document's tokens and the end id."""
    spec = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = load_vocabulary(spec.value)
        for batch, ids, at in encoded_slices(batches, vocab, merge_words, ENCODED_BYTES):
            flat, n = ids.astype("<u4"), np.diff(at) + 1
            pieces = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = np.maximum(0, n[doc] - (pieces[doc] - piece) * capacity)
            length = n[doc] - (pieces[doc] - piece - 1) * capacity - begin
            end = np.array([END_ID], dtype="<u4").tobytes()
            sums = []
            for d, b, k, last in zip(doc.tolist(), begin.tolist(), length.tolist(), (piece == pieces[doc] - 1).tolist(), strict=True):
                data = flat[at[d] + b:at[d] + b + k - last].tobytes()
                sums.append(zlib.crc32(data + end if last else data))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").take(pa.array(doc)), "piece": pa.array(piece.astype(np.int32)),
                "start": pa.array(begin), "length": pa.array(length), "ids_crc32": pa.array(sums, pa.int64())})

    return docs.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, vocabulary: str, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its tokens and one end id, so a null or empty text is one piece of length 1. Documents longer than
    ``capacity`` are cut from the end into full pieces; the first piece may be shorter. Shorter ones stay whole. Rows
    that repeat an id, or have none, are documents of their own. An empty table gives no piece.
    """
    if docs.isEmpty():
        return docs.sparkSession.createDataFrame(
            [], "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    pieces = staged(token_pieces(identified(docs, id_col, text_col), vocabulary, capacity), "pieces")
    groups = max(1, pieces.count() // GROUP_DOCUMENTS)
    grouped = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    sizes = grouped.groupBy("length", "group").agg(F.count(F.lit(1)).alias("size"))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in grouped.groupBy("length").count().collect():  # one row per length: ``capacity`` at most
        counts[row["length"]] = row["count"]
    places = place(plan_bins(counts, capacity), capacity)
    before = Window.partitionBy("length").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("length", "group").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (grouped.join(sizes.withColumn("skip", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size"), ["length", "group"])
              .withColumn("rank", F.col("skip") + F.row_number().over(inside) - 1).drop("skip", "group"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            for one in np.unique(length).tolist():
                mine, table = np.flatnonzero(length == one), places[one]
                step = table[np.searchsorted(table[:, 0], rank[mine], "right") - 1]
                there = rank[mine] - step[:, 0]
                sequence[mine] = step[:, 1] + there // step[:, 2]
                offset[mine] = step[:, 3] + there % step[:, 2] * one
            columns = {x: batch.column(x) for x in ("doc_id", "piece", "start", "length", "ids_crc32")}
            yield pa.RecordBatch.from_pydict(columns | {"sequence_id": pa.array(sequence), "offset": pa.array(offset)})

    return ranked.mapInArrow(
        settle, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
