"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is embedded as 32 counts of ones, one for each segment of two bits. The Manhattan
distance of two embeddings never exceeds the Hamming distance of the fingerprints. The counts span a
grid. Two points at a distance of at most ``k`` have equal counts in all but ``k`` of ``k + 4`` slabs of
coordinates, so they meet in a cell that fixes four slabs (21 counts for k = 2) and leaves ``k`` free. In a cell the
Manhattan distance over the free coordinates prunes the pairs and the Hamming distance decides.

Equal fingerprints are collapsed before any join. A cell that holds more than ``max_cell`` different
fingerprints is split in the same way: its free coordinates make up slabs of which ``k`` stay free, until only ``k``
coordinates are. Only a cell that is crowded even then, where the counts agree and bits are swapped within segments,
links its members through *masked* keys (the fingerprint with ``k`` of the bits that vary in the cell set to zero): members
with the same masked key differ in at most those bits, so a star to the smallest loses no component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, cut, utf8_buffer
from .components import connected_components

#: For each byte, its bits as the 8 bytes of an integer; sums of up to 255 of them count all 8 bits.
_SPREAD = np.array([sum((b >> i & 1) << 8 * i for i in range(8)) for b in range(256)], np.uint64)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BLOCK = 255


def shingle_hashes(text: bytes, size: int) -> list[int]:
    """XXH64 (seed 42) of every run of ``size`` words, or of the whole sequence if it is shorter."""
    words = text.translate(_LOWER).split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, 42)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-size].tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], 42) for s, e in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)]


def bit_majority(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each row of ``hashes[offsets[i]:offsets[i + 1]]``: the bits set in over half of them."""
    counts = np.diff(offsets)
    out = np.zeros(len(counts), np.uint64)
    rows = np.flatnonzero(counts)
    if not len(rows):
        return out
    blocks = -(-counts[rows] // _BLOCK)
    first = np.cumsum(blocks) - blocks
    within = np.arange(blocks.sum()) - np.repeat(first, blocks)
    cuts = np.repeat(offsets[:-1][rows], blocks) + within * _BLOCK
    data = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)
    for byte in range(8):
        lanes = np.add.reduceat(_SPREAD[data[:, byte]], cuts).view(np.uint8).reshape(-1, 8).astype(np.int64)
        ones = np.add.reduceat(lanes, first, axis=0) * 2 > counts[rows, None]
        out[rows] |= np.packbits(ones, axis=1, bitorder="little")[:, 0].astype(np.uint64) << np.uint64(8 * byte)
    return out


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """``(id_col, fp)``: the SimHash of every row's whole text as a signed long; no shuffle.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; repeated shingles count each time. A text that is
    null or has no word gets 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text_col, 2 << 20):
            data, offsets = utf8_buffer(batch.column(text_col))
            raw = data.tobytes()
            lists = [np.array(shingle_hashes(raw[s:e], size), np.uint64) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            ends = np.cumsum([0, *map(len, lists)])
            fp = bit_majority(np.concatenate(lists) if lists else np.zeros(0, np.uint64), ends)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(fp.view(np.int64))], [id_col, "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp bigint")


_EVEN = 0x5555555555555555


def _counts(fp: Column) -> Column:
    """The 32 segment counts, each as two bits of a long."""
    upper = F.shiftrightunsigned(fp, 1)
    twos = fp.bitwiseAND(upper).bitwiseAND(F.lit(_EVEN))
    return F.shiftleft(twos, 1).bitwiseOR(fp.bitwiseXOR(upper).bitwiseAND(F.lit(_EVEN)))


def manhattan(a: Column, b: Column) -> Column:
    """Manhattan distance of two embeddings."""
    a, b = _counts(a), _counts(b)
    ones = lambda x: x.bitwiseAND(F.lit(_EVEN))
    twos = lambda x: F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(_EVEN))
    apart = F.bit_count(ones(a).bitwiseXOR(ones(b)))
    return apart + 2 * F.bit_count(twos(a).bitwiseXOR(twos(b)).bitwiseAND(F.bitwise_not(ones(a).bitwiseOR(ones(b)))))


def _splits(free: tuple[int, ...], k: int) -> list[tuple[int, ...]]:
    """For each choice of ``k`` of the k + 4 slabs of the free coordinates (of as many as there are): those in them."""
    m = min(k + 4, len(free))
    slabs = [tuple(s for i, s in enumerate(free) if i * m // len(free) == j) for j in range(m)]
    return [tuple(sorted(sum(some, ()))) for some in combinations(slabs, k)]


def _mask(coordinates: tuple[int, ...]) -> int:
    """Both bits of the counts, as a signed long."""
    mask = sum(3 << 2 * s for s in coordinates)
    return mask - (1 << 64) if mask >> 63 else mask


def _in_cells(points: DataFrame) -> DataFrame:
    """``fp, free, counts``: each point in the cell that leaves the coordinates of ``free`` open."""
    return points.select("fp", "free", _counts(F.col("fp")).bitwiseAND(F.bitwise_not("free")).alias("counts"))


def _masked(crowded: DataFrame, k: int) -> DataFrame:
    """Stars that join what lies within ``k`` bits in each cell (``fp, free, counts, varying``); a row a fingerprint is masked."""
    crowded = crowded.groupBy("fp").agg(F.bit_or("varying").alias("varying"))
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("varying", i) == 1)
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    masks = F.transform(places, bit)  # of one to k bits: what varies for one of two fingerprints need not vary for the other
    for _ in range(k - 1):
        masks = F.array_distinct(F.flatten(F.transform(masks, lambda m: F.transform(places, lambda i: m.bitwiseOR(bit(i))))))
    keyed = crowded.select("fp", F.explode(masks).alias("mask"))
    keyed = keyed.select("fp", "mask", F.col("fp").bitwiseAND(F.bitwise_not("mask")).alias("masked")).distinct()
    least = cut(keyed.groupBy("mask", "masked").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).filter("a < z").drop("z"))
    return keyed.join(least, ["mask", "masked"]).filter("a < fp").select("a", F.col("fp").alias("b"))


def links(prints: DataFrame, k: int = 2, max_cell: int = 64) -> DataFrame:
    """Edges ``(a, b)`` between different values of the column ``fp`` whose components are those of all
    pairs at a Hamming distance of at most ``k``. ``prints`` holds each fingerprint once."""
    spark, cell = prints.sparkSession, ["free", "counts"]
    level, found = [tuple(range(32))], None
    keyed = prints.select("fp", F.explode(F.array(*[F.lit(_mask(f)) for f in _splits(level[0], k)])).alias("free"))
    while True:
        keyed = _in_cells(keyed)
        sizes = cut(keyed.groupBy(*cell).agg(F.count("*").alias("n"), F.bit_or("fp").bitwiseXOR(F.bit_and("fp")).alias("varying")).filter("n > 1"))
        shared = cut(keyed.join(sizes, cell))
        small, crowded = shared.filter(F.col("n") <= max_cell), shared.filter(F.col("n") > max_cell)
        pairs = small.select(*cell, F.col("fp").alias("a")).join(small.select(*cell, F.col("fp").alias("b")), cell)
        pairs = pairs.filter((F.col("a") < F.col("b")) & (manhattan(F.col("a"), F.col("b")) <= k) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= k)).select("a", "b")
        found = pairs if found is None else found.union(pairs)
        if crowded.isEmpty():
            return found.distinct()
        level = list(dict.fromkeys(f for parent in level for f in _splits(parent, k)))
        if all(len(f) <= k for f in level):
            return found.union(_masked(crowded, k)).distinct()
        finer = [(_mask(f), [_mask(x) for x in _splits(f, k)]) for f in level]  # some hundred rows, whatever the input
        finer = F.broadcast(spark.createDataFrame(finer, "free long, parts array<long>"))
        keyed = crowded.join(finer, "free").select("fp", F.explode("parts").alias("free")).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, k: int = 2, max_cell: int = 64) -> DataFrame:
    """``(id_col, fp, component_id)`` for every row: ``component_id`` is the smallest id reachable over links.

    Fingerprints link at ``k`` or fewer differing bits. Rows without words share the fingerprint 0 and link
    like any other. Repeated ids give repeated rows; a null id is never a component's name unless every id
    of the component is null. An empty table gives an empty result. Extra columns are ignored.
    """
    if not 1 <= k <= 4:
        raise ValueError("k must lie between 1 and 4")
    prints = cut(fingerprints(df, id_col, text_col, size))
    owners = prints.groupBy("fp").agg(F.min(id_col).alias("owner"))
    edges = links(owners.select("fp"), k, max_cell)
    groups = connected_components(edges)
    named = owners.join(groups, owners.fp == groups.node, "left").select("fp", "owner", F.coalesce("component", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("owner").alias("component_id"))
    named = named.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(id_col, "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
