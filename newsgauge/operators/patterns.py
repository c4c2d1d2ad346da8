"""Many patterns in texts at once: an automaton over the patterns, run over each text once.

The automaton (goto, failure and output links) costs one step a letter whatever the number of patterns is, so texts are
neither cut into parts nor shuffled; only the hits travel on. Pattern lists go to the tasks in pieces of at most
``PIECE_LETTERS`` letters and ``PIECE_VALUES`` values, which bounds what is collected and broadcast; a longer list takes
one pass over the texts for each piece.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from operator import and_

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsgauge.session import staged

#: Letters of the patterns in one automaton: some 60,000 names, about 100 MB in a worker.
PIECE_LETTERS = 1 << 20
#: Pairs of a pattern and a value in one piece.
PIECE_VALUES = 1 << 20
#: Hits are handed on in batches of at most so many.
HITS = 1 << 15


def automaton_of(patterns: Sequence[str]) -> ahocorasick.Automaton:
    """Gives the place in the list of each pattern that it meets."""
    automaton = ahocorasick.Automaton()
    for place, pattern in enumerate(patterns):
        automaton.add_word(pattern, place)
    automaton.make_automaton()
    return automaton


def places_in(automaton: ahocorasick.Automaton, text: str | None) -> set[int]:
    return {place for _, place in automaton.iter(text)} if text and len(automaton) else set()


class Spread:
    """Values by the patterns that lead to them, laid out flat. Values of the same patterns form a class, so that the classes
    of a text's patterns, each once, give each value once."""

    def __init__(self, values: Sequence[Sequence[str]]):
        places: dict[str, list[int]] = {}
        for place, own in enumerate(values):
            for value in set(own):
                places.setdefault(value, []).append(place)
        classes: dict[tuple[int, ...], list[str]] = {}
        for value, own in places.items():
            classes.setdefault(tuple(own), []).append(value)
        self._lay(len(values), classes.keys(), pa.array([v for own in classes.values() for v in own], pa.string()), [len(x) for x in classes.values()])

    def _lay(self, count: int, places: Iterable[Sequence[int]], flat: pa.Array, sizes: Sequence[int]) -> None:
        self.flat, self.sizes = flat, np.array(sizes, dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.classes: list[list[int]] = [[] for _ in range(count)]
        for k, own in enumerate(places):
            for place in own:
                self.classes[place].append(k)

    @classmethod
    def of_classes(cls, table: pa.Table) -> tuple[list[str], Spread]:
        """(patterns, their spread) of a table (patterns, values) with a row for each class."""
        table = table.combine_chunks()
        patterns, values = (table.column(x).chunk(0) if table.num_rows else pa.array([], pa.list_(pa.string())) for x in ("patterns", "values"))
        names, spread = pc.unique(patterns.flatten()), cls.__new__(cls)
        places = pa.ListArray.from_arrays(pc.subtract(patterns.offsets, patterns.offsets[0]), pc.index_in(patterns.flatten(), names))
        spread._lay(len(names), places.to_pylist(), values.flatten(), values.value_lengths().to_numpy(zero_copy_only=False))
        return names.to_pylist(), spread


def hit_batches(batch: pa.RecordBatch, automaton: ahocorasick.Automaton, values: Sequence[Sequence[str]] | Spread, most: int = HITS) -> Iterator[pa.RecordBatch]:
    """(keys, value) for the keys and texts, the last column, of a batch; at most ``most`` rows at a time, as a text
    may hold thousands of names and a batch thousands of texts."""
    spread = values if isinstance(values, Spread) else Spread(values)
    *keys, text = batch.schema.names
    texts, keyed = batch.column(text), batch.select(keys)
    rows, classes, held = [], [], 0

    def taken() -> Iterator[pa.RecordBatch]:
        own = np.array(classes, dtype=np.int64)
        sizes = spread.sizes[own]
        row = np.repeat(np.array(rows, dtype=np.int64), sizes)
        at = np.repeat(spread.starts[own] - np.cumsum(sizes) + sizes, sizes) + np.arange(len(row))
        for a in range(0, len(row), most):
            yield pa.RecordBatch.from_arrays([*keyed.take(pa.array(row[a:a + most])).columns, spread.flat.take(pa.array(at[a:a + most]))], names=[*keys, "value"])

    for row in range(batch.num_rows):  # one text at a time: a batch may hold very long ones
        hit = list({k for place in places_in(automaton, texts[row].as_py()) for k in spread.classes[place]})
        rows += [row] * len(hit)
        classes += hit
        held += int(spread.sizes[hit].sum())
        if held >= most:
            yield from taken()
            rows, classes, held = [], [], 0
    if rows:
        yield from taken()


def _scanned(items: DataFrame, shared: Broadcast, keys: Sequence[str], text: str) -> DataFrame:
    fields = [items.schema[k] for k in keys]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, spread = Spread.of_classes(shared.value)
        automaton = automaton_of(patterns)
        for batch in batches:
            yield from hit_batches(batch, automaton, spread)

    shape = T.StructType([*fields, T.StructField("value", T.StringType())])
    return items.select(*keys, F.col(text).alias("_text")).mapInArrow(scan, shape)


def pattern_hits(items: DataFrame, patterns: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Distinct (keys, value) of the rows of ``items`` and the values that have a pattern contained in their ``text``.

    ``patterns`` is (pattern, value); letters are compared as they are. Null texts and null or empty patterns match
    nothing. A row gives a value once, as a piece holds all patterns of its values; so only the pairs of keys that
    several rows have are made distinct. Texts are shuffled only where some key repeats, which is looked up first.
    """
    tidy = patterns.select("pattern", F.col("value").cast("string").alias("value")).where("pattern <> '' AND value IS NOT NULL").distinct()
    sizes = (tidy.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
             .agg(F.sum(F.length("pattern")), F.sum(F.length("pattern") * F.col("n")), F.sum("n")).first())
    once_each, letters, pairs = (x or 0 for x in sizes)
    # by values: letters of several values' common patterns may stand in each piece, which matters only where all are too many
    pieces = max(1, math.ceil(pairs / PIECE_VALUES), math.ceil(letters / PIECE_LETTERS) if once_each > PIECE_LETTERS else 1)
    tidy = staged(tidy, "patterns") if pieces > 1 else tidy
    again = items.groupBy(*[F.col(k).alias(f"_{k}_") for k in keys]).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    once, repeated = items, None
    if not again.isEmpty():
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}_")) for k in keys])
        once, repeated = items.join(again, same, "left_anti"), items.join(again, same, "left_semi")
    found = None
    for k in range(pieces):
        piece = tidy if pieces == 1 else tidy.where(F.pmod(F.xxhash64("value"), F.lit(pieces)) == k)
        listed = (piece.groupBy("value").agg(F.sort_array(F.collect_set("pattern")).alias("patterns"))
                  .groupBy("patterns").agg(F.collect_list("value").alias("values")).toArrow())  # one piece
        shared = items.sparkSession.sparkContext.broadcast(listed)
        hits = _scanned(once, shared, keys, text)
        if repeated is not None:
            hits = hits.unionByName(_scanned(repeated, shared, keys, text).distinct())
        found = hits if found is None else found.unionByName(hits)
    return found


def keyword_groups(text: Column, groups: Sequence[Sequence[str]]) -> Column:
    """array<int>: places, in order, of the groups of which the text contains any keyword."""
    words = sorted({w for group in groups for w in group if w})
    holders = [[k for k, group in enumerate(groups) if w in group] for w in words]

    @F.arrow_udf("array<int>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = automaton_of(words)
        for texts in batches:  # one text at a time becomes a Python string
            yield pa.array([sorted({k for place in places_in(automaton, t.as_py()) for k in holders[place]}) for t in texts], pa.list_(pa.int32()))

    return found(text)
