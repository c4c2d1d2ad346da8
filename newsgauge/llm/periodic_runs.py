"""Periodic runs of words: an online sparse diagonal dynamic program, one document at a time.

A diagonal is a lag q; its match length at word i says for how many words up to i the word q places before was the same.
Each word's earlier occurrences start or lengthen the diagonals of their lags; a diagonal that the next word does not
lengthen ends, and gives a run at once if it is long enough. Documents are independent, so nothing is shuffled.

Three things keep the diagonals sparse without losing a run. A run holds each of its words at least ``exponent`` times,
so a word that its neighbourhood holds less often ends all diagonals: the document falls apart at such words first. A
diagonal of lag q is worth starting only where it goes on for q words, so lags from g to 4g are looked up among the
earlier places that the same g words follow. And where the last words already have a period p twice over, a longer lag
is looked up only when that period changes: two runs of periods p < q share fewer than p + q words, so a run of period q
has, 2q words after its diagonal began or sooner, a word where the shortest period changes, and what is found there is
followed back to its beginning.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from newsgauge.llm.shared import identified, slices

#: Times that a part of a document is split at its rarer words before its diagonals are followed.
THINNINGS = 4


def dense_parts(words: list, least: int, shortest: int) -> list[tuple[int, int]]:
    """(begin, end) of the stretches of words that could hold a run: split at words that the stretch holds under ``least`` times."""
    parts = [(0, len(words))]
    for _ in range(THINNINGS):
        found = []
        for begin, end in parts:
            counts = Counter(words[begin:end])
            if min(counts.values(), default=least) >= least:
                found.append((begin, end))
                continue
            at = begin
            for i in range(begin, end + 1):
                if i == end or counts[words[i]] < least:
                    if i - at >= shortest:
                        found.append((at, i))
                    at = i + 1
        if found == parts:
            break
        parts = found
    return [(a, b) for a, b in parts if b - a >= shortest]


def has_shorter_period(words: list, begin: int, period: int, length: int) -> bool:
    """Whether the first ``length`` words have a period that divides ``period``."""
    for p in range(1, period // 2 + 1):
        if period % p == 0 and words[begin] == words[begin + p] and words[begin:begin + length - p] == words[begin + p:begin + length]:
            return True
    return False


def continued_words(words: list, most_lag: int) -> list[tuple[int, list[int]]]:
    """(g, names) for g = 1, 4, 16, ... up to ``most_lag``: places have one name where the g words from there are the same."""
    numbers: dict = {}
    levels = [(1, [numbers.setdefault(word, len(numbers)) for word in words])]
    while (size := levels[-1][0]) * 4 <= most_lag:
        last, numbers = levels[-1][1], {}
        parts = zip(last, last[size:], last[2 * size:], last[3 * size:], strict=False)
        levels.append((4 * size, [numbers.setdefault(part, len(numbers)) for part in parts]))
    return levels


def runs_in(words: list, exponent: int, least_length: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs in one stretch, in the order in which they end."""
    n, runs = len(words), []
    most_lag = n // exponent
    levels = [(size, names, defaultdict(list)) for size, names in continued_words(words, most_lag)]
    starts: dict[int, int] = {}  # lag -> first place of its diagonal
    held = 0  # shortest period that the words before have twice over

    def close(lag: int, end: int) -> None:
        begin = starts.pop(lag) - lag
        length = end - begin
        if length >= least_length and length >= exponent * lag and not has_shorter_period(words, begin, lag, length):
            runs.append((begin, length, lag))

    for i, word in enumerate(words):
        for lag in [q for q in starts if words[i - q] != word]:
            close(lag, i)
        lasting = min((q for q, first in starts.items() if i - first + 1 >= q), default=0)
        reach = lasting if lasting and lasting == held else most_lag
        held = lasting
        for size, names, seen in levels:
            if i >= len(names):
                break
            earlier = seen[names[i]]
            if size <= reach:
                for j in earlier[bisect_left(earlier, i - min(reach, 4 * size - 1)):bisect_right(earlier, i - size)]:
                    if i - j not in starts:
                        first = i
                        while first > i - j and words[first - 1] == words[first - 1 - i + j]:
                            first -= 1
                        starts[i - j] = first
            earlier.append(i)
    for lag in list(starts):
        close(lag, n)
    return runs


def periodic_runs(words: list, exponent: int, least_length: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs, by start and period."""
    found = []
    for begin, end in dense_parts(words, exponent, max(least_length, exponent)):
        found += [(begin + start, length, period) for start, length, period in runs_in(words[begin:end], exponent, least_length)]
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapse_runs(docs: DataFrame, exponent: int = 4, least_length: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs (array of start, length, period), text (the words that stay).

    A run is a stretch of words with smallest period q, at least ``least_length`` and ``exponent`` * q words long, that
    no neighbouring word extends; of each run the first q words stay, unless another run drops them, joined by one
    space. Null, empty and white texts have no words and no runs. Rows that repeat an id, or have none, stand for
    themselves; other columns are ignored; an empty table gives no row. ``exponent`` is 4 at least.
    """
    if exponent < 4:
        raise ValueError("runs of under four periods share too many words to be found this way")

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n_words, runs, texts = [], [], []
            for text in batch.column("text").to_pylist():
                words = text.encode().split() if text else []  # bytes split at exactly the white space of the contract
                found = periodic_runs(words, exponent, least_length)
                n_words.append(len(words))
                runs.append([{"start": a, "length": n, "period": q} for a, n, q in found])
                if found:
                    gone = bytearray(len(words))
                    for start, length, period in found:
                        gone[start + period:start + length] = b"\x01" * (length - period)
                    words = [w for w, g in zip(words, gone, strict=True) if not g]
                texts.append(b" ".join(words).decode())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_words": pa.array(n_words, pa.int64()),
                                              "runs": pa.array(runs, kind), "text": pa.array(texts, pa.string())})

    return identified(docs, id_col, text_col).mapInArrow(
        collapse, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, text string")
