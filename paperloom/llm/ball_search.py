"""Exact top-k search by integer inner product with ball trees, branch and bound.

The rows are dealt to cells, whose centres are the leaves of a ball tree over a bounded sample, and the rows of a
cell to shards of bounded size. Each shard's ball tree is built once, by one task, and stored as a row a node.
No inner product of a query q with a point of a ball exceeds q . centre + |q| * radius. A query visits the cells
in the order of that bound: first the best one, then the next few and then the rest, and each time only
cells (and in their shards only nodes) whose bound reaches the k-th score known by then.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .integer_vectors import LEAST, MOST, as_long, as_type, exact_type, integer_vectors, matrix, smallest_copies

NODE = "cell int, sub int, node int, up int, centre array<double>, radius double, leaf boolean, ids array<long>, v array<double>"
FOUND = "query_id long, vec_id long, score long"


def ball_tree(x: np.ndarray, leaf: int) -> list[tuple[int, np.ndarray, np.ndarray, float, bool]]:
    """Nodes ``(parent, rows, centre, radius, is_leaf)``, parents first. A ball is halved along the line between two far points of it."""
    nodes, waiting = [], [(-1, np.arange(len(x)))]
    while waiting:
        up, rows = waiting.pop()
        part = x[rows]
        centre = part.mean(axis=0)
        far = np.sqrt(((part - centre) ** 2).sum(axis=1))
        radius = float(far.max(initial=0.0))
        done = len(rows) <= leaf or radius == 0
        nodes.append((up, rows, centre, radius, done))
        if not done:
            one = part[far.argmax()]
            other = part[((part - one) ** 2).sum(axis=1).argmax()]
            order = np.argsort(part @ (one - other), kind="stable")
            half = len(rows) // 2
            waiting += [(len(nodes) - 1, rows[order[:half]]), (len(nodes) - 1, rows[order[half:]])]
    return nodes


def bounds(q: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """For each query and ball what no inner product exceeds; rounding is allowed for."""
    long = np.sqrt((q * q).sum(axis=1))[:, None]
    wide = long * (np.sqrt((centres * centres).sum(axis=1)) + radii)[None]
    return q @ centres.T + long * radii[None] + 1e-9 * wide + 1e-3


class Best:
    """The ``k`` best rows of each query so far, and the score that a further row has to reach."""

    def __init__(self, bound: np.ndarray, k: int) -> None:
        self.k, self.bound = k, bound.copy()
        self.q, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, found: list[np.ndarray]) -> None:
        q, score, ids = np.concatenate([np.array([self.q, self.score, self.id]), *found], axis=1)
        order = np.lexsort((ids, np.where(score == LEAST, MOST, -score), q))
        q, score, ids = q[order], score[order], ids[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        self.q, self.score, self.id = (a[place < self.k] for a in (q, score, ids))
        last = place == self.k - 1
        self.bound[q[last]] = np.maximum(self.bound[q[last]], score[last])


def search_tree(nodes: pa.Table, dim: int, q_ids: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int) -> Best:
    """Branch and bound of a block of queries in one shard's tree.

    A query takes its leaves in the order of their bounds, twice as many each time; between times the bounds rise.
    """
    nodes = nodes.sort_by("node")
    up, radii = np.asarray(nodes.column("up")), np.asarray(nodes.column("radius"))
    limit = bounds(q, matrix(nodes.column("centre"), dim), radii)
    for n in range(1, len(up)):  # a node holds no more than its parent does
        limit[:, n] = np.where(limit[:, up[n]] >= bound, np.minimum(limit[:, n], limit[:, up[n]]), -np.inf)
    leaves = np.flatnonzero(np.asarray(nodes.column("leaf")))
    held = [(np.asarray(ids.values), np.asarray(v.values, np.float64).reshape(-1, dim)) for ids, v in ((nodes.column("ids")[int(n)], nodes.column("v")[int(n)]) for n in leaves)]
    limit = limit[:, leaves]
    order = np.argsort(-limit, axis=1, kind="stable")
    best, taken, step = Best(bound, k), 0, 1
    while taken < len(leaves):
        turn = order[:, taken : taken + step]
        reach = np.take_along_axis(limit, turn, axis=1) >= best.bound[:, None]
        if not reach.any():
            break
        rows, cols = np.nonzero(reach)
        leaf_of = turn[rows, cols]
        by_leaf = np.argsort(leaf_of, kind="stable")
        starts = np.flatnonzero(np.diff(leaf_of[by_leaf], prepend=-1))
        found = []
        for who in np.split(by_leaf, starts[1:]):
            ids, v = held[leaf_of[who[0]]]
            asked = rows[who]
            kind = exact_type(q[asked], v)
            score = as_long(as_type(q[asked], kind) @ as_type(v, kind).T)
            other = q_ids[asked][:, None] != ids
            score[~other] = LEAST
            edge = best.bound[asked]
            if len(ids) > k:
                edge = np.maximum(edge, np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k])
            r, c = np.nonzero((score >= edge[:, None]) & other)
            found.append(np.array([asked[r], score[r, c], ids[c]]))
        best.add(found)
        taken, step = taken + step, step * 2
    return best


def search(df: DataFrame, is_query: Column, k: int = 10, factor: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 8192, leaf: int = 128, block: int = 8192, sample: int = 8192, cells: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query (a row for whose id ``is_query`` holds) the ``k`` rows with the
    largest inner products of integer vectors, largest first, ties to the smaller id. Exact, whatever the parameters.

    Components become ``floor(factor * x)``; which vectors take part and how repeated ids count is told at
    ``integer_vectors`` (null, non-finite, odd lengths; extra columns don't matter). A query finds every row but its
    own, all if there are no more than ``k``; an empty table gives no rows. Scores beyond a long become the nearest
    long. Equal vectors of a shard collapse to the ``k + 1`` smallest ids, as no list can hold others.
    The cells are fitted on about ``sample`` rows (those with the smallest hashes) and are at most ``cells``; every
    row is in a cell, and every cell's radius is that of all its rows.
    """
    spark = df.sparkSession
    rows = cut(integer_vectors(df, factor, id_col, vector_col))
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    part = rows.filter(F.xxhash64("id").bitwiseAND(2**63 - 1) <= (2**63 - 1) * min(sample, n) // n).orderBy("id").toArrow()
    part = part if part.num_rows else rows.orderBy("id").limit(1).toArrow()
    dim = len(part.column("v")[0])
    fitted = matrix(part.column("v"), dim)
    fitted = ball_tree(fitted, max(1, -(-len(fitted) // min(cells, max(1, n // shard_rows)))))
    centres = np.stack([centre for _, _, centre, _, done in fitted if done])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square = (centres * centres).sum(axis=1)
        for batch in batches:
            for s in range(0, batch.num_rows, 4096):
                piece = batch.slice(s, 4096)
                x = matrix(piece.column("v"), dim)
                cell = (square[None] - 2 * (x @ centres.T)).argmin(axis=1)
                far = np.sqrt(((x - centres[cell]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("v"), pa.array(cell, pa.int32()), pa.array(far)], ["id", "v", "cell", "far"])

    placed = cut(rows.mapInArrow(place, "id long, v array<double>, cell int, far double"))
    sizes, radii = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # a row a cell
        sizes[r.cell], radii[r.cell] = r.n, r.far
    filled = np.flatnonzero(sizes)
    by_cell = lambda counts: F.get(F.array(*[F.lit(int(c)) for c in counts]), F.col("cell"))
    n_subs = by_cell(np.maximum(1, -(-sizes // shard_rows)))

    def build(key: tuple, table: pa.Table) -> pa.Table:
        ids, x = np.asarray(table.column("id")), matrix(table.column("v"), dim)
        once = smallest_copies(ids, k + 1, *x.T)
        ids, x = ids[once], x[once]
        nodes = ball_tree(x, leaf)
        held = [own if done else own[:0] for _, own, _, _, done in nodes]
        own = {"cell": [key[0].as_py()] * len(nodes), "sub": [key[1].as_py()] * len(nodes), "node": list(range(len(nodes))), "up": [n[0] for n in nodes], "centre": [n[2] for n in nodes], "radius": [n[3] for n in nodes], "leaf": [n[4] for n in nodes]}
        own |= {"ids": [ids[h] for h in held], "v": [x[h].ravel() for h in held]}
        types = [pa.int32()] * 4 + [pa.list_(pa.float64()), pa.float64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.float64())]
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(own.items(), types, strict=True)})

    dealt = placed.withColumn("sub", F.pmod(F.xxhash64("id"), n_subs).cast("int"))
    trees = cut(dealt.groupBy("cell", "sub").applyInArrow(build, NODE))

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells of each query by their bounds, best first."""
        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                piece = batch.slice(s, 1024)
                limit = bounds(matrix(piece.column("v"), dim), centres[filled], radii[filled])
                order = np.argsort(-limit, axis=1, kind="stable")
                cell, at = filled[order], np.take_along_axis(limit, order, axis=1)
                yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("v"), pa.array(list(cell), pa.list_(pa.int32())), pa.array(list(at), pa.list_(pa.float64()))], ["id", "v", "cells", "limits"])

    asked = placed.select("id", "v").withColumn(id_col, F.col("id")).filter(is_query).select("id", "v")
    asked = cut(asked.repartition("id").mapInArrow(aim, "id long, v array<double>, cells array<int>, limits array<double>"))

    def visit(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        parts = []
        for s in range(0, right.num_rows, 1024):
            piece = right.slice(s, 1024)
            q_ids = np.asarray(piece.column("id"))
            best = search_tree(left, dim, q_ids, matrix(piece.column("v"), dim), np.asarray(piece.column("bound"), np.int64), k)
            parts.append(np.array([q_ids[best.q], best.id, best.score]))
        q, ids, score = np.concatenate(parts, axis=1)
        return pa.table({"query_id": q, "vec_id": ids, "score": score})

    keys = ["cell", "sub", "q_block"]

    def read(wanted: DataFrame) -> DataFrame:
        """What the cells give that ``id, v, bound, cell`` ask for; a cell's shards and blocks of its queries are tasks of their own."""
        wanted = cut(wanted)
        counts = np.zeros(len(centres), np.int64)
        for r in wanted.groupBy("cell").count().collect():  # a row a cell
            counts[r.cell] = r["count"]
        n_blocks = by_cell(-(-counts // block))
        stored = trees.filter(n_blocks > 0).withColumn("q_block", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
        wanted = wanted.select("cell", F.explode(F.sequence(F.lit(0), n_subs - 1)).alias("sub"), F.pmod(F.xxhash64("id", F.lit(1)), n_blocks).cast("int").alias("q_block"), "id", "v", "bound")
        return stored.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInArrow(visit, FOUND)

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = None
    for at, many in ((0, 1), (1, 4), (5, len(filled))):  # each query's best cell, the next four, the rest
        if at >= len(filled):
            break
        turn = asked.select("id", "v", F.explode(F.arrays_zip(*(F.slice(c, at + 1, many).alias(c) for c in ("cells", "limits")))).alias("to"))
        turn = turn.select("id", "v", F.col("to.cells").alias("cell"), F.col("to.limits").alias("limit"))
        if best is None:
            turn = turn.withColumn("bound", F.lit(int(LEAST)))
        else:
            known = best.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
            turn = turn.join(known, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(int(LEAST)))).filter(F.col("limit") >= F.col("bound"))
        found = read(turn.select("id", "v", "bound", "cell"))
        found = found if best is None else found.unionByName(best.drop("rank"))
        best = cut(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
