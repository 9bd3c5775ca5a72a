"""Exact substring deduplication with difference-cover anchors.

A word is removed if a window of ``window`` consecutive words that covers it also starts earlier (in a
smaller id, or earlier in the same text). Comparing all windows would shuffle a hash for each word. Here a
difference cover D of a period P picks word positions: for any two positions i and j some shift below P takes
both into D (modulo P). So two equal windows share an aligned anchor, a run of ``window - P + 1`` words that
starts at a cover position of both, and only anchors at cover positions are hashed and exchanged at first. Windows
are then hashed in full only where they hold an anchor that occurs more than once.

1. Texts are dealt into chunks by a hash of the id. Each chunk sends the set of its anchors, as sorted
   arrays, to buckets of the hash range; buckets return to each chunk which of its anchors recur.
2. Each chunk extends recurring anchors to full windows and sends the set of their hashes, each with the
   smallest id that holds it. Buckets return the hashes whose first occurrence lies elsewhere, and those
   which recur within the chunk that holds the first one.
3. Each chunk marks the windows, takes the union of their words and writes its texts.

A hash appears once a chunk, however often the chunk repeats it, so a passage that a third of all texts
share costs a bucket one entry a chunk. The exchange of the texts is the same in all three steps, and
Spark reuses it. Hashes have 64 bits for anchors (a collision costs time only) and 96 for windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import sha256
from itertools import combinations, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes, utf8_buffer
from .word_hashes import window_hashes, word_hashes, word_spans

#: Bytes of text in a chunk; a task holds one chunk at a time.
CHUNK_BYTES = 8 << 20


@cache
def difference_cover(period: int) -> tuple[int, ...]:
    """A smallest set whose differences give every residue modulo ``period``."""
    if period == 1:
        return (0,)
    for size in range(2, period + 1):
        if size * (size - 1) + 1 < period:
            continue
        for rest in combinations(range(2, period), size - 2):
            cover = (0, 1, *rest)
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return cover
    raise ValueError("period must be positive")


class _Chunk:
    """The words of a chunk's texts in the order of their ids."""

    def __init__(self, rows: pa.Table, id_col: str, text_col: str, lanes: int):
        order = pc.sort_indices(rows.select([id_col, text_col]), sort_keys=[(id_col, "ascending"), (text_col, "ascending")], null_placement="at_start")
        self.rows = rows.take(order)
        self.ids = self.rows.column(id_col).combine_chunks()
        self.data, self.offsets = utf8_buffer(self.rows.column(text_col))
        starts, ends, self.first = word_spans(self.data, self.offsets)
        self.words = word_hashes(self.data, starts, ends, lanes)
        self.n = len(starts)
        counts = np.diff(self.first)
        self.row = np.repeat(np.arange(len(counts)), counts)
        self.place = np.arange(self.n) - np.repeat(self.first[:-1], counts)
        self.left = np.repeat(counts, counts) - self.place  # words from here to the end of the text


def _anchors(c: _Chunk, window: int, period: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions of the anchors of texts that have a window, and their hashes."""
    length = window - period + 1
    hashes = window_hashes(c.words[0], length)
    covered = np.zeros(period, bool)
    covered[list(difference_cover(period))] = True
    at = np.flatnonzero(covered[c.place % period] & (c.left >= length) & (c.place + c.left >= window))
    return at, hashes[at]


def _buckets(sorted_hashes: np.ndarray, n: int) -> np.ndarray:
    """Bounds of the buckets in an array of sorted hashes (n + 1)."""
    limits = (np.arange(1, n, dtype=np.float64) * (2.0**64 / n)).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_hashes, limits), [len(sorted_hashes)]])


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _join(column: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """Arrays held as binary cells, joined, and the row of each element."""
    parts = [np.frombuffer(x.as_py() or b"", kind) for x in column]
    return np.concatenate(parts) if parts else np.zeros(0, kind), np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def _in_sorted(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.searchsorted(among, values)
    at[at == len(among)] = 0
    return among[at] == values


def removals(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, period: int | None = None, chunk_bytes: int = CHUNK_BYTES, keep_text: bool = True) -> DataFrame:
    """For every row: its id, ``n_words``, ``n_removed``, ``kept_sha256`` and, if wanted, ``kept_text``.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, unchanged; kept words are joined by one space. A null or
    empty text has no words and keeps the empty string. Rows with the same id are ordered by their texts; a
    null id comes before all others. An empty table gives no rows; extra columns are ignored.
    """
    kind = df.schema[id_col].dataType.simpleString()
    if kind not in ("bigint", "int"):
        raise ValueError(f"{id_col} must be a long or an int, not {kind}")
    period = period or min(13, window)
    if not 1 <= period <= window:
        raise ValueError("the period must lie between 1 and the window")
    n = max(1, -(-text_bytes(df, text_col) // chunk_bytes))
    texts = df.select(F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int").alias("chunk"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def anchors(key: tuple, rows: pa.Table) -> pa.Table:
        values, counts = np.unique(_anchors(_Chunk(rows, "id", "text", 1), window, period)[1], return_counts=True)
        cuts = _buckets(values, n)
        full = np.flatnonzero(np.diff(cuts)).tolist()
        spans = [slice(cuts[i], cuts[i + 1]) for i in full]
        return pa.table({
            "bucket": pa.array(full, pa.int32()),
            "chunk": pa.array([key[0].as_py()] * len(full), pa.int32()),
            "hashes": pa.array([_blob(values[s]) for s in spans], pa.binary()),
            "again": pa.array([_blob(np.packbits(counts[s] > 1)) for s in spans], pa.binary()),
        })

    def recurring(key: tuple, rows: pa.Table) -> pa.Table:
        hashes, row = _join(rows.column("hashes"), np.uint64)
        sizes = np.bincount(row, minlength=rows.num_rows)
        again = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8))[:m] for x, m in zip(rows.column("again"), sizes, strict=True)]).astype(bool)
        order = np.argsort(hashes, kind="stable")
        same = hashes[order][1:] == hashes[order][:-1]
        hit = again.copy()
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        out = [hashes[hit & (row == i)] for i in range(rows.num_rows)] if rows.num_rows < 64 else np.split(hashes[hit], np.cumsum(np.bincount(row[hit], minlength=rows.num_rows))[:-1])
        chunks = rows.column("chunk").to_pylist()
        full = [i for i, x in enumerate(out) if len(x)]
        return pa.table({"chunk": pa.array([chunks[i] for i in full], pa.int32()), "hashes": pa.array([_blob(out[i]) for i in full], pa.binary())})

    def extend(key: tuple, rows: pa.Table, shared: pa.Table) -> pa.Table:
        schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("h1", pa.binary()), ("h2", pa.binary()), ("again", pa.binary()), ("ids", pa.binary()), ("nulls", pa.binary())])
        if not rows.num_rows or not shared.num_rows:
            return schema.empty_table()
        c = _Chunk(rows, "id", "text", 2)
        at, hashes = _anchors(c, window, period)
        among = np.sort(_join(shared.column("hashes"), np.uint64)[0])
        # a window may recur if one of the cover positions it starts at, or passes within a period, has such an anchor
        marks = np.zeros(c.n + period, np.int32)
        marks[at[_in_sorted(hashes, among)]] = 1
        sums = np.concatenate([[0], np.cumsum(marks)])
        near = np.flatnonzero((sums[period : c.n + period] > sums[: c.n]) & (c.left >= window))
        h1, h2 = window_hashes(c.words[0], window)[near], window_hashes(c.words[1], window)[near].astype(np.uint32)
        order = np.lexsort((near, h2, h1))
        h1, h2, near = h1[order], h2[order], near[order]
        fresh = np.ones(len(h1), bool)
        fresh[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        first = np.flatnonzero(fresh)
        again = np.diff(np.append(first, len(h1))) > 1
        h1, h2, owner = h1[first], h2[first], c.row[near[first]]
        ids = c.ids.take(pa.array(owner))
        nulls = ids.is_null().to_numpy(zero_copy_only=False)
        ids = ids.cast(pa.int64()).fill_null(0).to_numpy()
        cuts = _buckets(h1, n)
        full = np.flatnonzero(np.diff(cuts)).tolist()
        spans = [slice(cuts[i], cuts[i + 1]) for i in full]
        packed = [_pack(ids[s]) for s in spans]
        return pa.table([
            pa.array(full, pa.int32()), pa.array([key[0].as_py()] * len(full), pa.int32()), pa.array([_blob(h1[s]) for s in spans], pa.binary()), pa.array([_blob(h2[s]) for s in spans], pa.binary()),
            pa.array([_blob(np.packbits(again[s])) for s in spans], pa.binary()), pa.array(packed, pa.binary()), pa.array([_blob(np.packbits(nulls[s])) for s in spans], pa.binary()),
        ], schema=schema)

    def later(key: tuple, rows: pa.Table) -> pa.Table:
        h1, row = _join(rows.column("h1"), np.uint64)
        h2, _ = _join(rows.column("h2"), np.uint32)
        sizes = np.bincount(row, minlength=rows.num_rows)
        bits = lambda name: np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8))[:m] for x, m in zip(rows.column(name), sizes, strict=True)]).astype(bool)
        again, known = bits("again"), ~bits("nulls")
        ids = np.concatenate([_unpack(x.as_py()) for x in rows.column("ids")])
        order = np.lexsort((ids, known, h2, h1))
        a, b = h1[order], h2[order]
        first = np.ones(len(a), bool)
        first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        state = np.where(first, np.where(again[order], 1, 0), 2)  # 1: all but this chunk's first are later; 2: all are
        chunks = np.array(rows.column("chunk").to_pylist(), np.int32)[row[order]]
        keep = state > 0
        a, b, state, chunks = a[keep], b[keep], state[keep], chunks[keep]
        order = np.lexsort((a, state, chunks))
        a, b, state, chunks = a[order], b[order], state[order], chunks[order]
        group = chunks.astype(np.int64) * 4 + state
        bounds = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)] if len(group) else [0]
        spans = [slice(s, e) for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
        return pa.table({
            "chunk": pa.array([int(chunks[s.start]) for s in spans], pa.int32()), "state": pa.array([int(state[s.start]) for s in spans], pa.int32()),
            "h1": pa.array([_blob(a[s]) for s in spans], pa.binary()), "h2": pa.array([_blob(b[s]) for s in spans], pa.binary()),
        })

    def write(key: tuple, rows: pa.Table, found: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return out_schema.empty_table()
        c = _Chunk(rows, "id", "text", 2 if found.num_rows else 0)
        marks = np.zeros(c.n + 1, np.int32)
        if found.num_rows:
            whole = np.flatnonzero(c.left >= window)
            h1 = window_hashes(c.words[0], window)[whole]
            known1, row = _join(found.column("h1"), np.uint64)
            known2, _ = _join(found.column("h2"), np.uint32)
            own = np.array(found.column("state").to_pylist(), np.int32)[row] == 1
            order = np.lexsort((known2, known1))
            known1, known2, own = known1[order], known2[order], own[order]
            likely = _in_sorted(h1, known1)
            whole, h1 = whole[likely], h1[likely]
            h2 = window_hashes(c.words[1], window)[whole].astype(np.uint32)
            order = np.lexsort((whole, h2, h1))
            whole, h1, h2 = whole[order], h1[order], h2[order]
            at = np.searchsorted(known1, h1)
            hit = known2[at] == h2
            for step in range(1, int(np.max(np.unique(known1, return_counts=True)[1], initial=1))):  # windows that differ but share 64 bits
                other = np.minimum(at + step, len(known1) - 1)
                better = ~hit & (known1[other] == h1) & (known2[other] == h2)
                at, hit = np.where(better, other, at), hit | better
            opening = np.ones(len(h1), bool)
            opening[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            gone = whole[hit & ~(own[at] & opening)]
            np.add.at(marks, gone, 1)
            sums = np.concatenate([[0], np.cumsum(marks[: c.n])])
            lower = np.maximum(np.arange(c.n) - window + 1, c.first[:-1][c.row])
            marks = sums[1:] - sums[lower]
        removed = marks[: c.n] > 0
        raw, offsets, first = c.data.tobytes(), c.offsets.tolist(), c.first.tolist()
        totals = np.concatenate([[0], np.cumsum(removed)])
        gone = (totals[c.first[1:]] - totals[c.first[:-1]]).tolist()
        kept = []
        for i, g in enumerate(gone):
            words = raw[offsets[i] : offsets[i + 1]].split()
            kept.append(b" ".join(compress(words, (~removed[first[i] : first[i + 1]]).tolist()) if g else words))
        columns = {id_col: c.ids, "n_words": pa.array(np.diff(c.first)), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array([sha256(x).hexdigest() for x in kept])}
        if keep_text:
            columns["kept_text"] = pa.array(kept, pa.binary()).cast(pa.string())
        return pa.table(list(columns.values()), schema=out_schema)

    id_type = {"bigint": pa.int64(), "int": pa.int32()}[kind]
    out_schema = pa.schema([(id_col, id_type), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), *([("kept_text", pa.string())] * keep_text)])

    dealt = texts.groupBy("chunk")
    shared = dealt.applyInArrow(anchors, "bucket int, chunk int, hashes binary, again binary").groupBy("bucket").applyInArrow(recurring, "chunk int, hashes binary")
    wide = dealt.cogroup(shared.groupBy("chunk")).applyInArrow(extend, "bucket int, chunk int, h1 binary, h2 binary, again binary, ids binary, nulls binary")
    found = wide.groupBy("bucket").applyInArrow(later, "chunk int, state int, h1 binary, h2 binary")
    return dealt.cogroup(found.groupBy("chunk")).applyInArrow(write, f"`{id_col}` {kind}, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * keep_text)


def _pack(ids: np.ndarray) -> bytes:
    """Ids as 32-bit distances from the least one where they fit."""
    least = int(ids.min())
    narrow = int(ids.max()) - least < 1 << 32
    return np.array([least, narrow], np.int64).tobytes() + _blob((ids - least).astype(np.uint32) if narrow else ids)


def _unpack(cell: bytes) -> np.ndarray:
    least, narrow = np.frombuffer(cell[:16], np.int64)
    return np.frombuffer(cell[16:], np.uint32).astype(np.int64) + least if narrow else np.frombuffer(cell[16:], np.int64)
