"""Language of texts by unigrams of word pieces, summed over all segmentations.

The pieces are a fixed public vocabulary (byte-level BPE, so that every word has a segmentation). Each language has a
probability for every piece, fitted by expectation maximisation on a bounded sample of labelled texts. A word's
probability is the sum over all its segmentations into pieces, found by a forward pass; a text's is the product over
its words. Words are runs of letters in lower case with one space before them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsgauge.llm.byte_bpe import load_vocabulary
from newsgauge.llm.shared import crc_of_id, identified, slices, staged

#: Labelled texts of a language that the pieces are fitted on: those whose hashed ids are smallest.
FIT_TEXTS = 800
ROUNDS = 2
FIT_TASKS = 8
PRIOR = 0.05
#: A run of letters longer than this many bytes is cut there into several words.
LONGEST = 40
NOTHING = "und"
_WORD = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def word_counts(text: str | None) -> Counter:
    return Counter(_WORD.findall(text.lower())) if text else Counter()


class Pieces:
    """Pieces by hash; probabilities by language are given to the passes."""

    def __init__(self, spec: str):
        pieces = sorted({x for x in load_vocabulary(spec).pieces if x and (len(x) == 1 or self._usable(x))})
        self.longest = max(map(len, pieces))
        self.powers = np.array([pow(int(_BASE), k, 1 << 64) for k in range(LONGEST + 2)], dtype=np.uint64)
        hashes = np.array([self._hash(x) for x in pieces], dtype=np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.count = len(pieces)

    @staticmethod
    def _usable(piece: bytes) -> bool:
        body = piece.removeprefix(b" ")
        return len(piece) <= LONGEST and piece == piece.lower() and all(b >= 0x80 or 0x61 <= b <= 0x7A for b in body)

    @staticmethod
    def _hash(piece: bytes) -> int:
        value = 0
        for b in piece:
            value = (value * int(_BASE) + b + 1) & 0xFFFFFFFFFFFFFFFF
        return value

    def find(self, prefix: np.ndarray, begin: int, end: int) -> np.ndarray:
        """Piece at [begin, end) of each word, ``count`` where there is none."""
        wanted = prefix[:, end] - prefix[:, begin] * self.powers[end - begin]
        at = np.minimum(np.searchsorted(self.hashes, wanted), self.count - 1)
        return np.where(self.hashes[at] == wanted, self.order[at], self.count)

    def groups(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(index of the word, prefix hashes, length) of words cut to LONGEST bytes, by length."""
        parts = [(k, b" " + raw[a:a + LONGEST]) for k, w in enumerate(words) for raw in [w.encode()] for a in range(0, len(raw), LONGEST)]
        by_length: dict[int, list[tuple[int, bytes]]] = {}
        for part in parts:
            by_length.setdefault(len(part[1]), []).append(part)
        for length, own in by_length.items():
            for a in range(0, len(own), 20_000):
                some = own[a:a + 20_000]
                letters = np.frombuffer(b"".join(x for _, x in some), dtype=np.uint8).reshape(len(some), length)
                prefix = np.zeros((len(some), length + 1), dtype=np.uint64)
                for k in range(length):
                    prefix[:, k + 1] = prefix[:, k] * _BASE + letters[:, k] + np.uint64(1)
                yield np.array([k for k, _ in some]), prefix, length

    def forward(self, prefix: np.ndarray, length: int, chance: np.ndarray) -> np.ndarray:
        """alpha[word, position, language]: summed probability of all segmentations up to there."""
        alpha = np.zeros((len(prefix), length + 1, chance.shape[1]))
        alpha[:, 0] = 1
        for end in range(1, length + 1):
            for begin in range(max(0, end - self.longest), end):
                alpha[:, end] += alpha[:, begin] * chance[self.find(prefix, begin, end)]
        return alpha

    def log_words(self, words: list[str], chance: np.ndarray) -> np.ndarray:
        """Log-probability of each word in each language."""
        result = np.zeros((len(words), chance.shape[1]))
        for index, prefix, length in self.groups(words):
            np.add.at(result, index, np.log(np.maximum(self.forward(prefix, length, chance)[:, length], 1e-300)))
        return result

    def expected(self, words: list[str], weights: np.ndarray, chance: np.ndarray) -> np.ndarray:
        """Expected count of each piece in each language; ``weights``: the words' counts in the languages."""
        total = np.zeros((self.count + 1, chance.shape[1]))
        for index, prefix, length in self.groups(words):
            alpha, beta = self.forward(prefix, length, chance), np.zeros((len(prefix), length + 1, chance.shape[1]))
            beta[:, length] = 1
            share = weights[index] / np.maximum(alpha[:, length], 1e-300)
            for begin in range(length - 1, -1, -1):
                for end in range(begin + 1, min(length, begin + self.longest) + 1):
                    piece = self.find(prefix, begin, end)
                    there = chance[piece] * beta[:, end]
                    beta[:, begin] += there
                    np.add.at(total, piece, alpha[:, begin] * there * share)
        return total[:-1]


def fit(labelled: DataFrame, spec: Broadcast) -> tuple[list[str], np.ndarray]:
    """(languages, piece probabilities) from at most FIT_TEXTS texts a language of (doc_id, text, lang)."""
    hashed = F.xxhash64("doc_id")
    first = Window.partitionBy("lang").orderBy(hashed, "doc_id")
    # Of a language with many texts only those below a cut are ranked, about four times as many as are taken.
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # one row per language
    cut = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(4.0 * FIT_TEXTS / n)) for lang, n in sizes.items()], F.lit(1.0))
    below = hashed.cast("double") / 2.0**64 + 0.5 <= cut
    chosen = (labelled.select("doc_id", "lang").filter(below).withColumn("place", F.row_number().over(first))
              .filter(F.col("place") <= FIT_TEXTS).select("doc_id", "lang").distinct())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in slices(batches):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                for word, n in word_counts(text).items():
                    held[lang, word] += n
        yield pa.RecordBatch.from_pydict({"lang": pa.array([x for x, _ in held], pa.string()),
                                          "word": pa.array([x for _, x in held], pa.string()), "n": pa.array(held.values(), pa.int64())})

    sample = labelled.join(F.broadcast(chosen), ["doc_id", "lang"]).select("text", "lang")
    table = staged(sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
                   .repartition(FIT_TASKS, "word"), "words")  # a word's languages in one task
    languages = sorted(r["lang"] for r in table.select("lang").distinct().collect())
    if not languages:
        return [], np.zeros((0, 0))
    chance = np.zeros((0, len(languages)))
    for _ in range(ROUNDS):
        chance = _maximised(table, languages, spec, chance)
    return languages, chance


def _maximised(table: DataFrame, languages: list[str], spec: Broadcast, chance: np.ndarray) -> np.ndarray:
    """Piece probabilities after a round; ``chance`` are those before it, none for even ones. Tasks load the vocabulary and
    add up their words; only one sum for each piece and language comes to the driver."""
    given = table.sparkSession.sparkContext.broadcast(chance)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches, schema) if (batches := list(batches)) else None
        if not rows:
            return
        words, place = np.unique(np.array(rows["word"].to_pylist(), dtype=object), return_inverse=True)
        weights = np.zeros((len(words), len(languages)))
        weights[place, np.searchsorted(languages, rows["lang"].to_pylist())] = rows["n"].to_numpy()
        pieces = Pieces(spec.value)
        before = given.value
        if not len(before):
            before = np.full((pieces.count + 1, len(languages)), 1 / pieces.count)
            before[-1] = 0
        got = pieces.expected(words.tolist(), weights, before)
        piece, lang = np.nonzero(got)
        # the last row tells how many pieces there are
        yield pa.RecordBatch.from_pydict({"piece": pa.array(np.append(piece, pieces.count)), "lang": pa.array(np.append(lang, 0)),
                                          "n": pa.array(np.append(got[piece, lang], 0.0))})

    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
    sums = table.mapInArrow(expect, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
    got = np.zeros((int(sums["piece"].max()) + 1, len(languages)))
    got[sums["piece"], sums["lang"]] = sums["n"]
    got = got[:-1] + PRIOR
    return np.append(got / got.sum(axis=0), np.zeros((1, len(languages))), axis=0)


def _predictions(docs: DataFrame, vocabulary: str, held_out_of: int, id_col: str, text_col: str, lang_col: str):
    """A function that gives slices of batches with the languages, scores and numbers of words of their texts."""
    labelled = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"),
                           docs[lang_col].cast("string").alias("lang"))
    labelled = labelled.filter((crc_of_id(F.col("doc_id")) % held_out_of != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    context = docs.sparkSession.sparkContext
    spec = context.broadcast(Path(vocabulary).read_text())
    languages, chance = fit(labelled, spec)
    shared = context.broadcast(chance)

    def predict(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[str], list[float], list[int]]]:
        chance = shared.value
        pieces = Pieces(spec.value) if languages else None
        for batch in slices(batches, column):
            counts = [word_counts(x) for x in batch.column(column).to_pylist()]
            words = sorted(set().union(*counts))
            place = {w: k for k, w in enumerate(words)}
            logs = pieces.log_words(words, chance) if languages else np.zeros((len(words), 1))
            names, scores = [], []
            for own in counts:
                if not own or not languages:
                    names.append(NOTHING)
                    scores.append(0.0)
                    continue
                sums = np.array(list(own.values()), dtype=np.float64) @ logs[[place[w] for w in own]]
                best = int(np.argmax(sums))
                names.append(languages[best])
                scores.append(float(1 / np.exp(np.maximum(sums - sums[best], -700)).sum()))
            yield batch, names, scores, [own.total() for own in counts]

    return predict


def identify(docs: DataFrame, vocabulary: str, held_out_of: int = 3, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    Texts whose crc32 of the id's text mod ``held_out_of`` is 1 are held out; the others with a language and a text
    may be fitted on. ``und`` with score 0 where the text is null or has no letter, or no language was learned.
    score is the language's share of the summed probabilities of the whole text; of equal languages the first by
    name is taken.
    """
    own = identified(docs, id_col, text_col).withColumn("held_out", crc_of_id(F.col("doc_id")) % held_out_of == 1)
    predict = _predictions(docs, vocabulary, held_out_of, id_col, text_col, lang_col)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, names, scores, _ in predict(batches, "text"):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                                              "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())})

    return own.mapInArrow(told, "doc_id long, held_out boolean, lang_pred string, score double")


def drop_unidentified(docs: DataFrame, vocabulary: str, least_score: float = 0.5, held_out_of: int = 3, id_col: str = "doc_id",
                      text_col: str = "text", lang_col: str = "lang", least_words: int = 1) -> DataFrame:
    """The rows of ``docs`` whose text has a language with ``least_score`` or more, unchanged and where they are. Texts of
    fewer than ``least_words`` words need no score: what few words languages share says little of any of them."""
    predict = _predictions(docs, vocabulary, held_out_of, id_col, text_col, lang_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, names, scores, words in predict(batches, text_col):
            yield batch.filter(pa.array([n != NOTHING and (s >= least_score or w < least_words)
                                         for n, s, w in zip(names, scores, words, strict=True)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
