"""Spelling variants: words one edit apart, by dynamic programming over sorted lists.

Two words one edit apart share their first or their second half, so the vocabulary is dealt out by halves (a half that
very many words share is halved again, see ``dealt``). In a group only the free parts of the words, those that are not
shared, are compared. They are sorted; a range of neighbours with a common prefix of d letters shares row d of the edit
matrix, so the row is computed once for the range, from the row of the range that holds it, for each word it is compared
with. Rows are banded (three cells), and a range whose row exceeds one edit is skipped with all that is in it. The work
goes by depth: ranges come from the common prefixes of neighbours, and all words of a group walk them together.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgauge.llm.shared import identified, slices, staged

#: Groups of more words are dealt again by longer shared parts, as long as there are letters left to share.
GROUP_WORDS = 2048
#: Rows of the edit matrix that are worked on at a time, and letters of a batch of groups.
ROWS, LETTERS = 1 << 20, 1 << 20
#: Distinct words that a task counts before it sends its counts.
COUNTED = 400_000
LETTER_RUN = "[a-zÀ-ÿ]"


def damaged_run(doc: str, run: str, every: int) -> str:
    """Without one letter if ``every`` divides the checksum of document and run."""
    h = zlib.crc32(f"{doc}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def count_words(docs: DataFrame, min_chars: int = 7, min_count: int = 2, damage_every: int | None = None, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """(word, n): maximal runs of letters (A-Z in lower case, and U+00C0 to U+00FF) of at least ``min_chars`` letters
    that all documents together have at least ``min_count`` times.

    With ``damage_every``, about one in so many runs of a document loses a letter first (a planted misspelling). Null
    and empty texts have no words, a null id stands as an empty text in the checksum, repeated rows count each.
    """
    runs = re.compile(f"{LETTER_RUN}{{{min_chars},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})
            held.clear()
            return batch

        for batch in slices(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = runs.findall(text.encode().lower().decode()) if text else []  # bytes: only A-Z change
                if damage_every:
                    name = "" if doc is None else str(doc)
                    for run, n in Counter(own).items():
                        word = damaged_run(name, run, damage_every)
                        if len(word) >= min_chars:
                            held[word] += n
                else:
                    held.update(own)
                if len(held) > COUNTED:
                    yield flush()
        if held:
            yield flush()

    counted = identified(docs, id_col, text_col).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


# ---------------------------------------------------------------- groups that share all but a free part


def _with_key(rows: DataFrame) -> DataFrame:
    """``shared``: the letters that a group has in common, ``left`` at the beginning and ``right`` at the end."""
    word = F.col("word")
    return rows.withColumn("shared", F.concat(F.substr(word, F.lit(1), F.col("left")), F.substr(word, F.length(word) - F.col("right") + 1, F.col("right"))))


def _halves(short: Column, left: Column, right: Column) -> Column:
    """The two ways in which words one edit apart, at least ``short`` letters long, can share more than left and right."""
    free = short - left - right
    half = F.floor(free / 2).cast("int")
    return F.array(F.struct(short.alias("short"), (left + half).alias("left"), right.alias("right")),
                   F.struct(short.alias("short"), left.alias("left"), (right + free - half).alias("right")))


def dealt(words: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """(word, n, short, left, right, shared): every pair of words one edit apart meets in exactly one group.

    ``short`` is the length of a pair's shorter word. A pair that agrees in the first half of what is free goes left, any
    other right; right groups leave out the pairs of which one free part begins with the other (they went left).
    """
    length = F.length("word").cast("int")
    lengths = F.when(length > 1, F.array(length, length - 1)).otherwise(F.array(length))
    rows = words.select("word", "n", F.explode(lengths).alias("short"))
    none = F.lit(0)
    rows = _with_key(rows.select("word", "n", F.explode(_halves(F.col("short"), none, none)).alias("_g")).select("word", "n", "_g.*"))
    key = ["short", "left", "right", "shared"]
    done = []
    while True:
        large = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_size")).filter(
            (F.col("_size") > group_words) & (F.col("short") - F.col("left") - F.col("right") > 3)).drop("_size")
        large = staged(large, "large")
        if large.isEmpty():
            break
        done.append(rows.join(large, key, "left_anti"))
        again = rows.join(large, key, "left_semi").select("word", "n", F.explode(_halves(F.col("short"), F.col("left"), F.col("right"))).alias("_g"))
        rows = staged(_with_key(again.select("word", "n", "_g.*")), "dealt")
    for part in done:
        rows = rows.unionByName(part)
    return rows


# ---------------------------------------------------------------- the edit matrix over sorted lists


def common_prefixes(letters: np.ndarray, lengths: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Letters that each free part has in common with the one before it; -1 at the first of a group, and an end mark."""
    n, width = letters.shape
    same = (letters[1:] == letters[:-1]) & (letters[1:] != 0)
    common = np.full(n + 1, -1, dtype=np.int32)
    common[1:n] = np.where(same.all(axis=1), width, np.argmin(same, axis=1)) if width else 0
    common[1:n][group[1:] != group[:-1]] = -1
    return common


def near_pairs(letters: np.ndarray, lengths: np.ndarray, group: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, other) rows of one group whose free parts are exactly one edit apart.

    ``letters`` has a row of code points for each free part, 0 beyond its end; rows are sorted by group and letters.
    """
    n, width = letters.shape
    common = common_prefixes(letters, lengths, group)
    wide = np.zeros((n, width + 3), dtype=letters.dtype)
    wide[:, 1:width + 1] = letters  # wide[q, j] is the j-th letter of q, counted from 1
    edges = np.flatnonzero(common < 0)
    node = edges[np.searchsorted(edges, queries, "right") - 1]
    who = queries
    cells = [np.full(len(who), x, dtype=np.uint8) for x in (2, 0, 1)]  # row 0: columns -1, 0, 1
    found = []
    for depth in range(width + 1):
        ends = lengths[node] == depth
        column = lengths[who] - depth + 1
        value = np.choose(np.clip(column, 0, 2), cells)
        hit = ends & (column >= 0) & (column <= 2) & (value == 1)
        found.append((who[hit], node[hit]))
        if depth == width:
            break
        # Ranges of depth + 1 letters inside the ranges of depth letters.
        begins = np.flatnonzero((common[:n] <= depth) & (lengths > depth))
        edges = np.flatnonzero(common < depth) if depth else edges
        low = np.searchsorted(begins, node)
        count = np.searchsorted(begins, edges[np.searchsorted(edges, node, "right")]) - low
        at = np.repeat(np.arange(len(who)), count)
        if not len(at):
            break
        node = begins[np.repeat(low - np.cumsum(count) + count, count) + np.arange(len(at))]
        who = who[at]
        a, b, c = (x[at] for x in cells)
        letter = letters[node, depth]
        first = np.minimum(a + (wide[who, depth] != letter), b + 1)
        second = np.minimum(np.minimum(b + (wide[who, depth + 1] != letter), c + 1), first + 1)
        third = np.minimum(c + (wide[who, depth + 2] != letter), second + 1)
        own = lengths[who] - depth  # columns beyond the end of the word don't exist
        second[own < 1] = 2
        third[own < 2] = 2
        alive = np.minimum(np.minimum(first, second), third) <= 1
        node, who = node[alive], who[alive]
        cells = [np.minimum(x[alive], 2).astype(np.uint8) for x in (first, second, third)]
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _letters(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(x) for x in parts], dtype=np.int32)
    flat = np.frombuffer("".join(parts).encode("utf-32-le"), dtype=np.uint32)
    matrix = np.zeros((len(parts), int(lengths.max(initial=0))), dtype=np.uint32)
    matrix[np.arange(matrix.shape[1]) < lengths[:, None]] = flat
    return matrix, lengths


def _query_blocks(asked: np.ndarray, group: np.ndarray) -> Iterator[np.ndarray]:
    """Rows to compare at a time: their groups together hold about ROWS rows at the second letter."""
    sizes = np.bincount(group)
    weight = np.cumsum(np.minimum(sizes, 4096)[group] * asked)
    for k in range(int(weight[-1] // ROWS) + 1):
        block = np.flatnonzero((weight // ROWS == k) & asked)
        if len(block):
            yield block


def best_of_groups(words: list[str], counts: np.ndarray, free: list[str], group: np.ndarray, short: np.ndarray,
                   right: np.ndarray) -> dict[str, list]:
    """For words with near ones in their groups: how many, the largest count among them, and the word that has it.

    ``short`` is the length of the free parts of a group's shorter words; only those ask, the longer ones answer.
    """
    letters, lengths = _letters(free)
    rank = np.empty(len(words), dtype=np.int64)
    rank[pc.sort_indices(pa.array(words)).to_numpy()] = np.arange(len(words))  # bytes of UTF-8: code-point order
    result: dict[str, list] = {"word": [], "n_near": [], "best_n": [], "best": []}
    for block in _query_blocks(lengths == short, group):
        who, other = near_pairs(letters, lengths, group, block)
        strict = right[who] > 0
        if strict.any():  # a free part that begins with the other: the pair is in a left group
            shorter = np.minimum(lengths[who], lengths[other])
            inside = np.arange(letters.shape[1]) < shorter[:, None]
            prefix = ((letters[who] == letters[other]) | ~inside).all(axis=1) & (lengths[who] != lengths[other])
            who, other = who[~(strict & prefix)], other[~(strict & prefix)]
        longer = lengths[other] > lengths[who]  # not asked for themselves: two of them meet in the groups of their own length
        who, other = np.concatenate([who, other[longer]]), np.concatenate([other, who[longer]])
        order = np.lexsort((rank[other], -counts[other], who))
        who, other = who[order], other[order]
        heads = np.flatnonzero(np.diff(who, prepend=-1))
        result["word"] += [words[i] for i in who[heads].tolist()]
        result["n_near"] += np.diff(np.append(heads, len(who))).tolist()
        result["best_n"] += counts[other[heads]].tolist()
        result["best"] += [words[i] for i in other[heads].tolist()]
    return result


def near_words(words: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """(word, n_near, best_n, best) for the words that have one a single edit away: how many, and the most frequent of
    them (ties: the smallest in code-point order) with its count."""
    key = ["short", "left", "right", "shared"]
    groups = (dealt(words, group_words)
              .withColumn("free", F.substr("word", F.col("left") + 1, F.length("word") - F.col("left") - F.col("right")))
              .repartition(*key).sortWithinPartitions(*key, "free"))
    kind = "word string, n_near long, best_n long, best string"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(table: pa.Table) -> Iterator[pa.RecordBatch]:
            """Whole groups, as many at a time as LETTERS allows."""
            change = np.zeros(table.num_rows, dtype=bool)
            for name in key:
                column = table.column(name)
                change[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False).astype(bool)
            group = np.cumsum(change)
            sizes = np.bincount(group)
            paired = sizes[group] > 1
            table, group = table.filter(pa.array(paired)), group[paired]
            if not table.num_rows:
                return
            heads = np.flatnonzero(np.diff(group, prepend=-1))
            size = np.diff(np.append(heads, table.num_rows))
            longest = np.maximum.reduceat(pc.utf8_length(table.column("free")).to_numpy(), heads)
            begin, held, most = 0, 0, 0
            for k, head in enumerate(heads.tolist()):
                width = max(most, int(longest[k]))
                if held and (held + int(size[k])) * width > LETTERS:
                    yield one(table.slice(begin, head - begin), group[begin:head])
                    begin, held, width = head, 0, int(longest[k])
                held, most = held + int(size[k]), width
            yield one(table.slice(begin), group[begin:])

        def one(table: pa.Table, group: np.ndarray) -> pa.RecordBatch:
            short, left, right = (table.column(x).to_numpy() for x in ("short", "left", "right"))
            found = best_of_groups(table.column("word").to_pylist(), table.column("n").to_numpy(), table.column("free").to_pylist(),
                                   group - group[0], (short - left - right).astype(np.int32), right)
            return pa.RecordBatch.from_pydict({"word": pa.array(found["word"], pa.string()), "n_near": pa.array(found["n_near"], pa.int64()),
                                               "best_n": pa.array(found["best_n"], pa.int64()), "best": pa.array(found["best"], pa.string())})

        held = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            if held.num_rows < 50_000 or not new.num_rows:
                continue
            last = np.ones(held.num_rows, dtype=bool)  # the group of the last row may go on in the next batch
            for name in key:
                last &= pc.equal(held.column(name), held.column(name)[-1]).to_numpy().astype(bool)
            cut = held.num_rows - int(last.sum())
            if cut:
                yield from solved(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from solved(held)

    found = groups.mapInArrow(compare, kind)
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("_n"), F.col("best").alias("_w"))).alias("_best")).select(
        "word", "n_near", (-F.col("_best._n")).alias("best_n"), F.col("_best._w").alias("best"))


def spelling_variants(words: DataFrame, ratio: int = 10, group_words: int = GROUP_WORDS) -> DataFrame:
    """One row per row of ``words`` (word, n; words distinct): word, form, root, n, n_near, form_n.

    A word's form is its most frequent word one inserted, deleted or replaced code point away, if that has at least
    ``ratio`` times the word's count; root follows the forms to the last. Words without one are their own root. Null
    words are left out. An empty table gives no row.
    """
    if ratio < 2:
        raise ValueError("forms must be more frequent than their words, or they could go round in circles")
    known = staged(words.select(words["word"].cast("string").alias("word"), words["n"].cast("bigint").alias("n")).filter("word is not null"), "words")
    near = near_words(known, group_words)
    chosen = F.col("best_n") >= ratio * F.col("n")
    judged = staged(known.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(chosen, F.col("best")).alias("form"),
        F.when(chosen, F.col("best_n")).alias("form_n")), "judged")
    links = judged.filter("form is not null").select(F.col("word").alias("_from"), F.col("form").alias("_to"))
    most = judged.agg(F.max("n").alias("n")).first()["n"] or 1
    paths = judged.filter("form is not null").select("word", F.col("form").alias("root"))
    hops = 1
    while ratio ** hops <= most:  # each form has ``ratio`` times the count, so paths are short
        paths = paths.join(links, paths["root"] == links["_from"], "left").select("word", F.coalesce("_to", "root").alias("root"))
        hops += 1
    return (judged.join(paths, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
