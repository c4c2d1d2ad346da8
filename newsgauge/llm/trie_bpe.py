"""BPE by walking a trie of distinct words: the encoding of a prefix that words share is computed once.

The state of a trie node is the last token of the encoding of the path to it. It is the one suffix of the path that is
a token and stands stably after the last token of what is before it; the tokens of a word follow from the states on
its path, back to front. Words in sorted order are the trie in depth-first order: what two neighbours share stays on
the stack.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from newsgauge.llm.byte_bpe import Vocabulary, decode_ids, encoded_slices, load_vocabulary
from newsgauge.llm.shared import identified


def stable_pair(vocab: Vocabulary, left: int, right: int) -> bool:
    """Whether the encoding of both tokens' bytes together is just these two tokens.

    Undo merges from the end: at each time the border has one piece of either token beside it. A pair of pieces that
    merges earlier than the merge that took one of them away would have crossed the border.
    """
    ranks, splits, pairs = vocab.rank_of, vocab.splits, vocab.pair_rank
    before = len(pairs) * 2 + 2  # the pieces beside the border last until this time; of equal ranks the left pair merges first
    while True:
        rank = pairs.get(left << 20 | right)
        if rank is not None and 2 * rank + 1 < before:
            return False
        a, b = ranks[left], ranks[right]
        if a < 0 and b < 0:
            return True
        if a > b:
            before, left = 2 * a, splits[left][1]
        else:
            before, right = 2 * b + 2, splits[right][0]


def trie_words(vocab: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of distinct words."""
    raw, at = data.tobytes(), offsets.tolist()
    words = [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    order = sorted(range(len(words)), key=words.__getitem__)
    token_of, pieces, longest = vocab.ids, vocab.pieces, max(map(len, vocab.ids))
    stable: dict[int, bool] = {}
    result: list[list[int]] = [[]] * len(words)
    states: list[int] = [-1]  # states[i]: last token of the encoding of the first i bytes
    last = b""
    for k in order:
        word = words[k]
        shared, most = 0, min(len(word), len(states) - 1)
        while shared < most and word[shared] == last[shared]:
            shared += 1
        del states[shared + 1:]
        for end in range(shared + 1, len(word) + 1):
            for begin in range(max(0, end - longest), end):
                token = token_of.get(word[begin:end])
                if token is None:
                    continue
                if begin == 0:
                    break
                pair = states[begin] << 20 | token
                good = stable.get(pair)
                if good is None:
                    good = stable[pair] = stable_pair(vocab, states[begin], token)
                if good:
                    break
            states.append(token)
        last, end, tokens = word, len(word), []
        while end:
            tokens.append(states[end])
            end -= len(pieces[states[end]])
        tokens.reverse()
        result[k] = tokens
    counts = np.array([len(x) for x in result], dtype=np.int64)
    return np.array([t for x in result for t in x], dtype=np.int32), np.append(0, np.cumsum(counts))


def encode_and_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (array of int), ids_sha256, decoded (text), decoded_sha256.

    ``vocabulary`` is the path of a tokenizers file on the driver; it travels with the tasks (1.5 MB). Null and empty
    texts have no ids; a special token's text in a document is that token, as in the library. Every text is encoded
    whole, in slices of whole documents; the trie holds the distinct pre-tokens of a slice.
    """
    spec = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = load_vocabulary(spec.value)
        for batch, ids, at in encoded_slices(batches, vocab, trie_words):
            flat = ids.astype("<u4")
            own = [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            decoded = [decode_ids(vocab, x) for x in own]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "ids": pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)),
                "ids_sha256": pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in own]),
                "decoded": pa.array([x.decode() for x in decoded], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in decoded])})

    return identified(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, ids array<int>, ids_sha256 string, decoded string, decoded_sha256 string")
