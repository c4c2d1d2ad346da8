"""Byte-level BPE on arrays: pre-tokens of many texts at once, distinct ones encoded, ids gathered for every text.

``encode_texts`` takes the encoder of distinct pre-tokens as an argument: ``merge_words`` here replays the ranked
merges for all of them together; the prefix trie is in trie_bpe.py. Results equal the tokenizers library's.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex

from newsgauge.llm.shared import SLICE_BYTES, kept_in_process, slices, text_bytes

LETTER, NUMBER, SPACE, OTHER = range(4)
#: Code points with the property White_Space beyond ASCII.
WIDE_SPACES = {0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
#: Endings that stand alone after an apostrophe.
ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
NEVER = np.iinfo(np.int32).max
#: Longer pre-tokens go through the prefix walk of trie_bpe, whose time is linear in their length.
LONG_WORD = 64


@dataclass
class Vocabulary:
    pieces: list[bytes]
    byte_ids: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    splits: list[tuple[int, int] | None]
    rank_of: list[int]
    pair_rank: dict[int, int]
    ids: dict[bytes, int]
    specials: dict[bytes, int]


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte: itself where it prints, else the next free one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def load_vocabulary(text: str) -> Vocabulary:
    """From the JSON text of a tokenizers file with a byte-level BPE model; a worker process keeps the last one."""
    return kept_in_process("vocabulary", text, _read_vocabulary)


def _read_vocabulary(text: str) -> Vocabulary:
    spec, letters = json.loads(text), byte_letters()
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    names = spec["model"]["vocab"]
    pieces = [b""] * (max([*names.values(), *special.values()]) + 1)
    for name, k in names.items():
        pieces[k] = name.encode() if name in special else bytes(letters[c] for c in name)
    for name, k in special.items():
        pieces[k] = name.encode()
    byte_ids = np.zeros(256, dtype=np.int32)
    for letter, b in letters.items():
        byte_ids[b] = names[letter]
    pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in spec["model"]["merges"]]
    a, b, m = (np.array(x, dtype=np.int64) for x in zip(*[(names[x], names[y], names[x + y]) for x, y in pairs], strict=True))
    keys = a << 20 | b
    order = np.argsort(keys, kind="stable")
    splits: list[tuple[int, int] | None] = [None] * len(pieces)
    rank_of = [-1] * len(pieces)
    for rank, (x, y, z) in enumerate(zip(a.tolist(), b.tolist(), m.tolist(), strict=True)):
        if splits[z] is None:
            splits[z], rank_of[z] = (x, y), rank
    return Vocabulary(pieces, byte_ids, keys[order], order.astype(np.int32), m[order].astype(np.int32), splits, rank_of,
                      dict(zip(keys.tolist(), range(len(keys)), strict=True)),
                      {x: k for k, x in enumerate(pieces) if k not in special.values()}, {k.encode(): v for k, v in special.items()})


def _kind(code: int) -> int:
    letter = chr(code)
    if code in WIDE_SPACES or letter in " \t\n\x0b\x0c\r":
        return SPACE
    return LETTER if regex.match(r"\p{L}", letter) else NUMBER if regex.match(r"\p{N}", letter) else OTHER


_ASCII = np.array([_kind(c) for c in range(128)] + [OTHER] * 128, dtype=np.uint8)


def _kinds(data: np.ndarray) -> np.ndarray:
    """Kind of the character that each byte belongs to."""
    kinds = _ASCII[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        padded = np.concatenate([data, np.zeros(3, dtype=np.uint8)]).astype(np.int32)
        b0, b1, b2, b3 = (padded[lead + k] for k in range(4))
        size = 2 + (b0 >= 0xE0) + (b0 >= 0xF0)
        code = np.where(size == 2, (b0 & 0x1F) << 6 | b1 & 0x3F, np.where(
            size == 3, (b0 & 0x0F) << 12 | (b1 & 0x3F) << 6 | b2 & 0x3F,
            (b0 & 0x07) << 18 | (b1 & 0x3F) << 12 | (b2 & 0x3F) << 6 | b3 & 0x3F))
        found, back = np.unique(code, return_inverse=True)
        kind = np.array([_kind(c) for c in found.tolist()], dtype=np.uint8)[back]
        for k in range(4):
            part = size > k
            kinds[lead[part] + k] = kind[part]
    return kinds


def pretoken_starts(data: np.ndarray, edges: np.ndarray, specials: list[tuple[int, int]]) -> np.ndarray:
    """Starts of the pre-tokens of texts that lie behind each other in ``data``; ``edges`` are the texts' starts.

    Letters, numbers and other signs make runs that take one space before them; of white space before a run the last
    character stands alone unless it is that space; apostrophe endings stand alone where the apostrophe begins a run.
    """
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kinds = _kinds(data)
    cut = np.zeros(n + 1, dtype=bool)
    cut[edges] = True
    cut[[0, n]] = True
    for a, b in specials:
        cut[a] = cut[b] = True
    start = cut[:n].copy()
    start[1:] |= kinds[1:] != kinds[:-1]
    runs = np.flatnonzero(start)
    ends = np.append(runs[1:], n)
    spaces = (kinds[runs] == SPACE) & ~cut[ends]
    after = ends[spaces]
    last = after - 1
    for _ in range(3):
        last = np.where((data[last] & 0xC0) == 0x80, last - 1, last)
    start[last] = True
    start[after[data[last] == 0x20]] = False
    mark = (data[runs] == 0x27) & (ends - runs == 1) & start[runs] & ~cut[ends]
    for at in runs[mark].tolist():
        if kinds[at + 1] == LETTER:
            stop = at + 2
            while stop < min(at + 3, n) and not cut[stop]:
                stop += 1
            follow = data[at + 1:stop].tobytes()
            size = next((len(x) for x in ENDINGS if follow.startswith(x)), 0)
            if size:
                start[at + 1] = False
                if at + 1 + size < n:
                    start[at + 1 + size] = True
    for a, b in specials:
        start[a:b] = False
        start[a] = True
    return np.flatnonzero(start)


def _find_specials(data: np.ndarray, edges: np.ndarray, specials: dict[bytes, int]) -> list[tuple[int, int]]:
    raw, found = None, []
    for content in specials:
        raw = data.tobytes() if raw is None else raw
        at = raw.find(content)
        while at >= 0:
            if np.searchsorted(edges, at, "right") == np.searchsorted(edges, at + len(content) - 1, "right"):
                found.append((at, at + len(content)))
                at = raw.find(content, at + len(content))
            else:
                at = raw.find(content, at + 1)
    return sorted(found)


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each run, behind each other."""
    total = np.cumsum(counts)
    return np.repeat(starts - (total - counts), counts) + np.arange(total[-1] if len(total) else 0)


def _rank_pairs(vocab: Vocabulary, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = a.astype(np.int64) << 20 | b
    at = np.minimum(np.searchsorted(vocab.keys, key), len(vocab.keys) - 1)
    hit = vocab.keys[at] == key
    return np.where(hit, vocab.ranks[at], NEVER), vocab.merged[at]


def merge_words(vocab: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of distinct words: each round applies every word's first pair of lowest rank."""
    lengths = np.diff(offsets)
    long = np.flatnonzero(lengths > LONG_WORD)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(long):
        from newsgauge.llm.trie_bpe import trie_words

        ids, at = trie_words(vocab, data[_ragged(offsets[long], lengths[long])], np.append(0, np.cumsum(lengths[long])))
        done.append((long, np.diff(at), ids))
    words = np.flatnonzero((lengths > 0) & (lengths <= LONG_WORD))
    sizes = lengths[words]
    tokens = vocab.byte_ids[data[_ragged(offsets[words], sizes)]]
    owner = np.repeat(np.arange(len(words)), sizes)
    rank, into = np.full(len(tokens), NEVER, dtype=np.int32), np.zeros(len(tokens), dtype=np.int32)
    if len(tokens) > 1:
        first, inverse = np.unique(tokens[:-1].astype(np.int64) << 20 | tokens[1:], return_inverse=True)
        r, m = _rank_pairs(vocab, first >> 20, first & 0xFFFFF)
        rank[:-1], into[:-1] = r[inverse], m[inverse]
        rank[:-1][owner[:-1] != owner[1:]] = NEVER
    while len(words):
        begin = np.append(0, np.cumsum(sizes)[:-1])
        least = np.minimum.reduceat(rank, begin)
        ended = least == NEVER
        if ended.any():
            mine = np.repeat(ended, sizes)
            done.append((words[ended], sizes[ended], tokens[mine]))
            live = ~mine
            words, sizes, least = words[~ended], sizes[~ended], least[~ended]
            tokens, rank, into = tokens[live], rank[live], into[live]
            if not len(words):
                break
        owner = np.repeat(np.arange(len(words)), sizes)
        hit = np.flatnonzero(rank == least[owner])
        hit = hit[np.append(True, owner[hit[1:]] != owner[hit[:-1]])]
        tokens[hit] = into[hit]
        keep = np.ones(len(tokens), dtype=bool)
        keep[hit + 1] = False
        tokens, rank, into, owner = tokens[keep], rank[keep], into[keep], owner[keep]
        sizes = sizes - 1
        at = hit - np.arange(len(hit))
        for left in (at, at - 1):
            ok = (left >= 0) & (left + 1 < len(tokens))
            ok[ok] = owner[left[ok]] == owner[left[ok] + 1]
            pair = left[ok]
            rank[left[(left >= 0) & ~ok & (left == at)]] = NEVER
            rank[pair], into[pair] = _rank_pairs(vocab, tokens[pair], tokens[pair + 1])
    counts = np.zeros(len(lengths), dtype=np.int64)
    for own, size, _ in done:
        counts[own] = size
    out = np.append(0, np.cumsum(counts))
    ids = np.zeros(out[-1], dtype=np.int32)
    for own, size, flat in done:
        ids[_ragged(out[own], size)] = flat
    return ids, out


Encoder = Callable[[Vocabulary, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def encode_texts(vocab: Vocabulary, data: np.ndarray, edges: np.ndarray, encoder: Encoder) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of texts that lie behind each other in ``data`` between ``edges``."""
    specials = _find_specials(data, edges, vocab.specials)
    starts = pretoken_starts(data, edges, specials)
    if not len(starts):
        return np.zeros(0, dtype=np.int32), np.zeros(len(edges), dtype=np.int64)
    bounds = np.append(starts, len(data)).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    codes, words = coded.indices.to_numpy(), coded.dictionary
    word_at = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    word_data = np.frombuffer(words.buffers()[2], dtype=np.uint8)
    fixed = {words.index(pa.scalar(x, pa.binary())).as_py(): k for x, k in vocab.specials.items()} if specials else {}
    ids, at = encoder(vocab, word_data[word_at[0]:word_at[-1]], word_at - word_at[0])
    counts = np.diff(at)
    if fixed:
        first = at[:-1].copy()
        for word, k in fixed.items():
            if word >= 0:
                ids, first[word], counts[word] = np.append(ids, np.int32(k)), len(ids), 1
    else:
        first = at[:-1]
    own = counts[codes]
    flat = ids[_ragged(first[codes], own)]
    total = np.append(0, np.cumsum(own))
    return flat, total[np.searchsorted(starts, edges)]


def decode_ids(vocab: Vocabulary, ids: np.ndarray) -> bytes:
    """UTF-8 of the text of some ids; broken sequences become U+FFFD."""
    return b"".join(map(vocab.pieces.__getitem__, ids.tolist())).decode(errors="replace").encode()


def encoded_slices(batches: Iterator[pa.RecordBatch], vocab: Vocabulary,
                   encoder: Encoder, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each slice of the batches, of about ``limit`` bytes, with the ids of its texts and their offsets."""
    for batch in slices(batches, limit=limit):
        data, edges = text_bytes(batch.column("text"))
        yield batch, *encode_texts(vocab, data, edges, encoder)
