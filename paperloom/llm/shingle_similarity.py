"""Pairs of texts by the Jaccard similarity of their sets of word shingles.

MinHash bands give candidates and the two texts' whole sets decide. Texts with equal sets are collapsed first, and
each candidate's set of hashes is made and stored once. In a
round all sets of a band's cell are compared with one of them, its hub, and what is similar becomes one component.
Rounds with other hubs follow while the cells hold many more pairs of different components than sets and the last
round joined a fair share of what it compared. What is in one component needs no further link, so no component is lost, and
the work is linear where a cell is one group of near copies. Of the cells that still hold different components small ones
are paired off, and large ones are cut into blocks: a pair of blocks is one task, which gets each set once and
counts the common shingles of all its pairs as a product of matrices. That work grows with the square of a cell whose
texts are all just below the similarity, but not its traffic, and no task's share does.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, by_bytes, utf8_buffer
from .components import connected_components
from .word_hashes import window_hashes, word_hashes, word_spans

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Rows of ids, cells or edges that a partition may hold between rounds; fewer, larger files than a shuffle has partitions.
FILL = 100_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The different shingles of each text of a UTF-8 buffer, hashed and sorted; a text of fewer than ``size`` words has itself."""
    data = _LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)[0]
    windows = window_hashes(words, size)
    out = []
    for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        short = window_hashes(words[s:e], e - s) if 0 < e - s < size else words[:0]
        out.append(np.unique(windows[s : e - size + 1]) if e - s >= size else short)
    return out


def shingle_set(text: bytes, size: int) -> np.ndarray:
    return shingle_sets(np.frombuffer(text, np.uint8), np.array([0, len(text)]), size)[0]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / max(len(a) + len(b) - common, 1)


def _min_hashes(sets: list[np.ndarray], masks: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least value of each hash (a column) over each set (a row; none may be empty)."""
    out = np.empty((len(masks), len(sets)), np.uint32)
    if sets:
        shingles = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
        first, hashed = np.cumsum([0, *map(len, sets[:-1])]), np.empty_like(shingles)
        for mask, factor, low in zip(masks, factors, out, strict=True):
            np.bitwise_xor(shingles, mask, out=hashed)
            np.multiply(hashed, factor, out=hashed)
            np.minimum.reduceat(hashed, first, out=low)
    return np.ascontiguousarray(out.T)


def _signatures(df: DataFrame, id_col: str, text_col: str, size: int, bands: int, rows: int) -> DataFrame:
    r = np.random.default_rng(5)
    masks, factors = r.integers(0, 1 << 32, bands * rows, np.uint32), r.integers(0, 1 << 31, bands * rows, np.uint32) * np.uint32(2) + np.uint32(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 2 << 20):
            sets = shingle_sets(*utf8_buffer(batch.column("text")), size)
            full = np.array([len(own) > 0 for own in sets], bool)
            batch, sets = batch.filter(pa.array(full)), [own for own in sets if len(own)]
            keys = [xxhash.xxh3_128_digest(own.tobytes()) for own in sets]
            low = _min_hashes(sets, masks, factors).reshape(-1, bands, rows)
            cells = [[xxhash.xxh64_intdigest(x.tobytes(), i) - (1 << 63) for i, x in enumerate(one)] for one in low]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(keys, pa.binary()), pa.array(cells, pa.list_(pa.int64())), pa.array([len(own) for own in sets], pa.int64())], ["id", "shingles", "cells", "size"])

    kind = df.schema[id_col].dataType.simpleString()
    found = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, shingles binary, cells array<bigint>, size bigint")
    return found.filter("id is not null")


def _sets(df: DataFrame, ids: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``id, hashes``: the sorted shingle hashes of the rows with these ids."""
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(ids, "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 2 << 20):
            sets = shingle_sets(*utf8_buffer(batch.column("text")), size)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([own.tobytes() for own in sets], pa.binary())], ["id", "hashes"])

    return texts.mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, hashes binary").dropDuplicates(["id"])


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The rows ``(a, b)`` of ``pairs`` (a table of different pairs) whose sets are similar."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")), "a")
    both = both.join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lambda x: np.frombuffer(x.as_buffer(), np.uint64)
        for batch in batches:
            close = [similarity(own(x), own(y)) >= least for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(close, pa.bool_()))

    kind = sets.schema["id"].dataType.simpleString()
    return both.mapInArrow(run, f"a {kind}, b {kind}")


def common_counts(sets: list[np.ndarray], heavy: int = 32) -> np.ndarray:
    """How many shingles each two sets share: a product of matrices over those of many sets, sums by shingle over the others."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(own) for own in sets])
    _, at, held = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True, return_counts=True)
    order = np.argsort(at, kind="stable")
    row, ends = row[order], np.cumsum(held)
    out = np.zeros((n, n), np.float32)
    many = np.flatnonzero(held * heavy > n) if n > 2 * heavy else np.flatnonzero(held > 1)
    for s in range(0, len(many), 2048):
        part = many[s : s + 2048]
        has = np.zeros((n, len(part)), np.float32)
        for j, k in enumerate(part):
            has[row[ends[k] - held[k] : ends[k]], j] = 1
        out += has @ has.T
    for k in np.setdiff1d(np.flatnonzero(held > 1), many, assume_unique=True):
        who = row[ends[k] - held[k] : ends[k]]
        out[who[:, None], who] += 1
    return out


def spanning_pairs(close: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of a symmetric relation that connect what all of its pairs connect: one less than members for each component."""
    out, left = [], np.ones(len(close), bool)
    for start in range(len(close)):
        waiting = [start] if left[start] else []
        left[start] = False
        while waiting:
            i = waiting.pop()
            fresh = np.flatnonzero(close[i] & left).tolist()
            left[fresh] = False
            out += [(i, j) for j in fresh]
            waiting += fresh
    return out


def _in_blocks(keyed: DataFrame, sets: DataFrame, least: float, block: int) -> DataFrame:
    """Links between sets of one cell in different groups, a pair of blocks of a cell a task; enough of them to connect what all links connect."""
    counts = keyed.groupBy("band", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rows = keyed.join(counts, ["band", "cell"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("band", "cell", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "id", F.xxhash64("group").alias("group"), "size").join(sets, "id")

    def compare(table: pa.Table) -> pa.Table:
        size, group = np.asarray(table.column("size")), np.asarray(table.column("group"))
        common = common_counts([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("hashes")])
        # as ``similarity`` divides: whole numbers below 2 ** 24 are exact here
        close = common / np.maximum(size[:, None] + size[None] - common.astype(np.float64), 1) >= least
        pairs = spanning_pairs(close & (group[:, None] != group[None]))
        a, b = (pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1))
        ids = table.column("id").combine_chunks()
        return pa.table({"a": ids.take(a), "b": ids.take(b)})

    kind = sets.schema["id"].dataType.simpleString()
    return rows.groupBy("band", "cell", "one", "two").applyInArrow(compare, f"a {kind}, b {kind}")


def links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, least: float = 0.8, bands: int = 24, rows: int = 5, few: int = 4, share: float = 0.05, small: int = 16, block: int = 1024) -> DataFrame:
    """Edges ``(a, b)`` between ids, whose components are those of all pairs with a similarity of ``least`` or more.

    A pair of similarity s is no candidate with probability (1 - s ** rows) ** bands: 0.00007 at 0.8, less above.
    Rounds of hubs end at ``few`` pairs a set, or when less than ``share`` of what they compare is similar; then cells of up to
    ``small`` sets are paired off and larger ones go in blocks of about ``block``. These change the work, not the components. Every link
    that is given is checked on the whole sets. Ids must be unique; null ones and texts without words have no links.
    """
    table = Scratch(df.sparkSession)
    prints = table(_signatures(df, id_col, text_col, size, bands, rows))
    classes = table(prints.groupBy("shingles").agg(F.min("id").alias("owner"), F.first("cells").alias("cells"), F.first("size").alias("size")))
    found = table(prints.join(classes.select("shingles", "owner"), "shingles").filter("id != owner").select(F.col("owner").alias("a"), F.col("id").alias("b")))
    keyed = classes.select(F.col("owner").alias("id"), "size", F.posexplode("cells").alias("band", "cell"))
    parts = 1 + bands * classes.count() // FILL
    shared = table(keyed.groupBy("band", "cell").agg(F.count("*").alias("n")).filter("n > 1").drop("n").coalesce(parts))
    keyed = table(keyed.join(shared, ["band", "cell"]).withColumn("group", F.col("id")).coalesce(parts))
    sets = table(_sets(df, keyed.select("id").distinct(), id_col, text_col, size))
    table.free_all_but(found, keyed, sets)
    fits = lambda x, y: F.least(x, y) >= least * F.greatest(x, y)
    for step in count():
        groups = keyed.groupBy("band", "cell", "group").agg(F.count("*").alias("n")).groupBy("band", "cell").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"))
        members, pairs = groups.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("same")) / 2)).first()
        if not members or pairs <= few * members:
            break
        hubs = table(keyed.groupBy("band", "cell").agg(F.min(F.struct(F.xxhash64(F.lit(step), "id").alias("at"), "id", "group", "size")).alias("hub")).coalesce(parts))
        stars = keyed.join(hubs, ["band", "cell"]).filter((F.col("group") != F.col("hub.group")) & fits(F.col("size"), F.col("hub.size")))
        stars = table(stars.select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct().coalesce(parts))
        near = table(_similar(stars, sets, least))
        compared, joined = stars.count(), near.count()
        if joined:
            found = table(found.union(near).coalesce(parts))
            keyed = _grouped(keyed, near, parts, table)
        table.free_all_but(found, keyed, sets)
        if joined <= share * compared:
            break
    counts = keyed.groupBy("band", "cell").agg(F.count("*").alias("n"))
    keyed = table(keyed.join(counts, ["band", "cell"]).coalesce(parts))
    one, two = (keyed.filter(F.col("n") <= small).select("band", "cell", F.col("id").alias(x), F.col("group").alias(f"{x}_group"), F.col("size").alias(f"{x}_size")) for x in ("a", "b"))
    apart = one.join(two, ["band", "cell"]).filter((F.col("a") < F.col("b")) & (F.col("a_group") != F.col("b_group")) & fits(F.col("a_size"), F.col("b_size")))
    apart = table(apart.select("a", "b").distinct())
    large = keyed.filter(F.col("n") > small).drop("n")
    out = table(found.union(_similar(apart, sets, least)).union(_in_blocks(large, sets, least, block)).distinct())
    table.free_all_but(out)
    return out


def _grouped(keyed: DataFrame, edges: DataFrame, parts: int, table: Scratch) -> DataFrame:
    """``keyed`` with the groups that ``edges`` between ids join made one, without the cells that are in one group."""
    ids = keyed.select("id", "group").distinct()
    name = lambda end: ids.select(F.col("id").alias(end), F.col("group").alias(f"{end}_group"))
    between = edges.join(name("a"), "a").join(name("b"), "b").select(F.col("a_group").alias("a"), F.col("b_group").alias("b"))
    between = table(between.coalesce(1 + edges.count() // FILL))
    whole = table(connected_components(between, fill=FILL, scratch=table).withColumnRenamed("node", "group"))
    keyed = table(keyed.join(whole, "group", "left").select("band", "cell", "id", "size", F.coalesce("component", "group").alias("group")).coalesce(parts))
    mixed = table(keyed.groupBy("band", "cell").agg(F.min("group").alias("x"), F.max("group").alias("y")).filter("x != y").select("band", "cell").coalesce(parts))
    return table(keyed.join(mixed, ["band", "cell"]).coalesce(parts))


def merge(groups: DataFrame, edges: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``groups`` (``id_col`` and ``component_id``) with components that ``edges`` between ids join made one."""
    table = Scratch(groups.sparkSession)
    groups = table(groups.select(id_col, "component_id"))
    name = lambda end: groups.select(F.col(id_col).alias(end), F.col("component_id").alias(f"{end}_group"))
    between = edges.join(name("a"), "a").join(name("b"), "b").select(F.col("a_group").alias("a"), F.col("b_group").alias("b")).filter("a != b")
    between = table(between.coalesce(1 + edges.count() // FILL))
    whole = connected_components(between, fill=FILL, scratch=table).withColumnRenamed("node", "component_id")
    out = table(groups.join(whole, "component_id", "left").select(id_col, F.coalesce("component", "component_id").alias("component_id")))
    table.free_all_but(out)
    return out
