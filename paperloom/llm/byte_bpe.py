"""Byte-level BPE: ranked merges folded over the bytes of distinct words, and decoding.

A text is cut into segments at single spaces between two other characters: a match of the pattern always
begins at such a space, so segments can be encoded apart. Each different segment of a task is split by the
pattern and each different word of it is folded once: starting from its bytes, the adjacent pair with the
lowest rank is merged until no pair has a rank. Decoding concatenates the pieces of the ids.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from .common import by_bytes

_CUT = re.compile(r"(?<=\S) (?=\S)")
#: A text that has one of these, or begins or ends with white space, is cut with care.
_ODD = [x for w in map(chr, range(0x3001)) if w.isspace() for x in dict.fromkeys((w + " ", " " + w))]
_NONE = 1 << 40


@cache
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Merges:
    """The literal rank map, by bytes and by pairs of ids."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.pieces = {i: p for p, i in self.ranks.items()}
        self.names = {i: str(i) for i in self.pieces}
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        found = ((self.ranks.get(p[:k]), self.ranks.get(p[k:]), r) for p, r in self.ranks.items() for k in range(1, len(p)))
        pairs = np.array([(a << 32 | b, r) for a, b, r in found if a is not None and b is not None], np.int64)
        pairs = pairs[np.argsort(pairs[:, 0])]
        self.keys, self.values = np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])

    def of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each two neighbours merged; _NONE where they don't merge or there is no neighbour."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.values[at], _NONE)


@cache
def _merges(path: str) -> Merges:
    return Merges(path)


def fold(words: list[bytes], merges: Merges) -> list[list[int]]:
    """Token ids of each word: a step merges, in all words at once, the first pair of the lowest rank."""
    out: list[list[int]] = [[]] * len(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    floor = 0
    for width in (4, 8, 12, 16, 24, 40, 64):
        rows = np.flatnonzero((lengths > floor) & (lengths <= width))
        floor = width
        for s in range(0, len(rows), 50_000):
            part = rows[s : s + 50_000]
            text = np.frombuffer(b"".join([words[i].ljust(width, b"\0") for i in part]), np.uint8).reshape(-1, width)
            for i, ids in zip(part, _fold_block(text, lengths[part], merges), strict=True):
                out[i] = ids
    for i in np.flatnonzero(lengths > floor):
        out[i] = fold_long(words[i], merges.ranks)
    return out


def _fold_block(text: np.ndarray, lengths: np.ndarray, merges: Merges) -> list[list[int]]:
    width = text.shape[1]
    steps = np.arange(width)
    ids = np.where(steps < lengths[:, None], merges.bytes[text], -1)
    ids = np.concatenate([ids, np.full((len(ids), 1), -1)], axis=1)
    ranks = merges.of_pairs(ids[:, :-1], ids[:, 1:])
    live = np.arange(len(ids))
    while len(live):
        at = ranks[live].argmin(axis=1)
        least = ranks[live, at]
        going = least < _NONE
        live, at, least = live[going], at[going], least[going]
        if not len(live):
            break
        shift = steps + (steps > at[:, None])  # what stands right of the pair moves left by one
        new = ids[live[:, None], np.minimum(shift, width)]
        new[np.arange(len(live)), at] = least
        ids[live, :-1] = new
        ranks[live] = np.where(shift < width, ranks[live[:, None], np.minimum(shift, width - 1)], _NONE)
        ranks[live, at] = merges.of_pairs(least, ids[live, at + 1])
        inner = at > 0
        ranks[live[inner], at[inner] - 1] = merges.of_pairs(ids[live[inner], at[inner] - 1], least[inner])
    counts = (ids >= 0).sum(axis=1).tolist()
    return [row[:n] for row, n in zip(ids.tolist(), counts, strict=True)]


def fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for one long word, with a heap, so that its cost is not quadratic."""
    after, before = [*range(1, len(word) + 1)], [*range(-1, len(word) - 1)]
    parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    heap = [(r, i, parts[i] + parts[i + 1]) for i in range(len(word) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if parts[i] is None or j >= len(word) or parts[i] + parts[j] != pair:
            continue
        parts[i], parts[j], after[i] = pair, None, after[j]
        if after[j] < len(word):
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < len(word) and (r := ranks.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (r, a, parts[a] + parts[b]))
    return [ranks[p] for p in parts if p is not None]


@cache
def _unlike() -> dict[int, str]:
    """The code points that the library's pattern engine and ours, of different Unicode versions, put in different
    classes, and for each a character of the library's class: letters, numbers, white space, others."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([b]): b for b in range(256)}

    def chosen(pattern: str) -> tuple[set[str], set[str]]:
        library = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        parts = (every[i : i + 1024] for i in range(0, len(every), 1024))
        theirs = set().union(*(library.decode(library.encode_ordinary(part)) for part in parts))
        return theirs, set(regex.findall(pattern, every))

    found, unlike = {}, set()
    for pattern, like in ((r"\s", "\t"), (r"\p{N}", "0"), (r"\p{L}", "a")):
        theirs, ours = chosen(pattern)
        unlike |= theirs ^ ours
        found |= dict.fromkeys(theirs, like)
    return {ord(c): found.get(c, "!") for c in unlike}


class Codec:
    """Encodes and decodes texts; remembers up to ``memo`` different segments."""

    def __init__(self, path: str, pattern: str, memo: int = 400_000):
        self.merges = _merges(path)
        self.pattern = regex.compile(pattern)
        self.unlike = _unlike()
        self.rare = frozenset(map(chr, self.unlike))
        self.memo = memo
        self.known: dict[str, str] = {}  # the ids, as decimals, of a space and the key
        self.odd: dict[str, bytes] = {}  # what they decode to, where that isn't a space and the key

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.merges.pieces.__getitem__, ids))

    def split(self, text: str) -> list[str]:
        """The matches of the pattern as the library finds them."""
        if text.isascii() or self.rare.isdisjoint(text):  # versions of Unicode agree on ASCII
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.unlike))]

    def encode_segments(self, segments: list[str]) -> list[list[int]]:
        """Ids of each segment; each different word of them is folded once."""
        split = list(map(self.split, segments))
        words = list(set().union(*split))
        ids = dict(zip(words, fold([w.encode() for w in words], self.merges), strict=True))
        return [ids[parts[0]] if len(parts) == 1 else [i for w in parts for i in ids[w]] for parts in split]

    def encode(self, texts: list[str]) -> list[tuple[str, bytes]]:
        """For each text: its ids as decimals joined by one space, and the bytes they decode to."""
        cuts = [_CUT.split(t) if any(w in t for w in _ODD) or t[:1].isspace() or t[-1:].isspace() else t.split(" ") for t in texts]
        if len(self.known) > self.memo:
            self.known.clear()
            self.odd.clear()
        name, known, odd = self.merges.names.__getitem__, self.known, self.odd
        new = list(set().union(*[c[1:] for c in cuts]) - known.keys())
        for x, ids in zip(new, self.encode_segments([" " + x for x in new]), strict=True):
            known[x] = " ".join(map(name, ids))
            if (raw := self.decode(ids)) != b" " + x.encode():
                odd[x] = raw
        out = []
        for text, cut, ids in zip(texts, cuts, self.encode_segments([c[0] for c in cuts]), strict=True):
            head = self.decode(ids)
            whole = head == cut[0].encode() and not (odd and any(x in odd for x in cut[1:]))
            decoded = text.encode() if whole else head + b"".join([odd.get(x) or b" " + x.encode() for x in cut[1:]])
            out.append((" ".join([*map(name, ids), *map(known.__getitem__, cut[1:])]), decoded))
        return out


def encode_decode(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, keep: list[str] | None = None) -> DataFrame:
    """For every row: its id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` (and the ids, if wanted).

    ``ranks`` is the path of a file of base64 tokens and ranks, at the same place on every executor; each match
    of ``pattern`` in the whole text is encoded separately, without special tokens. The hashes are of the
    decimal ids joined by one space and of the decoded bytes. A null text counts as empty. ``keep`` names
    further columns to carry. No shuffle.
    """
    kept = [id_col, *(keep or [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks, pattern)
        for batch in by_bytes(batches, text_col, 2 << 20):
            rows: tuple[list, list, list, list] = ([], [], [], [])
            for ids, decoded in codec.encode([t or "" for t in batch.column(text_col).to_pylist()]):
                rows[0].append(ids.count(" ") + 1 if ids else 0)
                rows[1].append(sha256(ids.encode()).hexdigest())
                rows[2].append(sha256(decoded).hexdigest())
                if keep_ids:
                    rows[3].append([int(i) for i in ids.split()])
            columns = [*(batch.column(c) for c in kept), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())]
            names = [*kept, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(rows[3], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    head = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
    return df.select(*dict.fromkeys([*kept, text_col])).mapInArrow(run, f"{head}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)
