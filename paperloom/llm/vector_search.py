"""Approximate nearest neighbours by inner product with balanced posting lists.

Vectors are put on a sphere by one more coordinate, so that the nearest in Euclidean distance has the largest
inner product. Hierarchical balanced clustering of a bounded sample gives the centroids of the posting lists.
Every vector joins the list of its nearest centroid; vectors near a boundary also join others that are almost as
near, unless a chosen centroid lies closer to the next one than the vector does. The centroids are searched through
a neighbourhood graph held in memory. A query reads the lists whose distance is within a ratio of the
nearest one's; the ratio is calibrated on the sample. Lists are dealt out in blocks, so a list that holds a third
of all vectors is many tasks' work.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


@dataclass
class Index:
    dim: int
    scale: float  # the largest length
    centroids: np.ndarray  # (lists, dim + 1)
    graph: np.ndarray  # (lists, degree)
    entry: np.ndarray
    ratio: float

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Rows on the unit sphere of one more dimension."""
        x = x / self.scale
        return np.concatenate([x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1, keepdims=True)))], axis=1)

    @staticmethod
    def aim(q: np.ndarray) -> np.ndarray:
        return np.concatenate([q / np.sqrt((q * q).sum(axis=1, keepdims=True)), np.zeros((len(q), 1))], axis=1)

    def nearest(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all rows at once: list numbers and distances, nearest first (-1, inf: none)."""
        n, lists = len(x), len(self.centroids)
        width = min(width, lists)
        seen = np.zeros((n, lists), bool)
        rows = np.arange(n)[:, None]
        ids = np.full((n, width), -1)
        near = np.full((n, width), np.inf)
        done = np.ones((n, width), bool)

        def meet(who: np.ndarray, new: np.ndarray) -> None:
            fresh = ~seen[who[:, None], new]
            seen[who[:, None], new] = True
            gap = self.centroids[new] - x[who][:, None, :]
            far = np.where(fresh, np.sqrt(np.einsum("ijk,ijk->ij", gap, gap)), np.inf)
            all_ids = np.concatenate([ids[who], np.where(fresh, new, -1)], axis=1)
            all_far = np.concatenate([near[who], far], axis=1)
            all_done = np.concatenate([done[who], ~fresh], axis=1)
            order = np.argsort(all_far, axis=1, kind="stable")[:, :width]
            ids[who], near[who], done[who] = (np.take_along_axis(a, order, axis=1) for a in (all_ids, all_far, all_done))

        meet(np.arange(n), np.broadcast_to(self.entry, (n, len(self.entry))))
        while True:
            who = np.flatnonzero(~done.all(axis=1))
            if not len(who):
                return ids, near
            at = (~done[who]).argmax(axis=1)
            done[who, at] = True
            meet(who, self.graph[ids[who, at]])


def _balanced(x: np.ndarray, leaf: int, fan: int = 8, rounds: int = 6) -> list[np.ndarray]:
    """Row numbers of the leaves of a tree that splits ``x`` until a part has at most ``leaf`` rows."""
    waiting, leaves = [np.arange(len(x))], []
    while waiting:
        rows = waiting.pop()
        if len(rows) <= leaf:
            leaves.append(rows)
            continue
        part = x[rows]
        k = min(fan, -(-len(rows) // leaf))
        centres = part[np.linspace(0, len(part) - 1, k).astype(int)]
        for _ in range(rounds):
            own = _fill(part, centres, -(-len(part) * 5 // (4 * k)))
            centres = np.stack([part[own == j].mean(axis=0) if (own == j).any() else centres[j] for j in range(k)])
        waiting += [r for j in range(k) if len(r := rows[own == j])]
    return leaves


def _fill(x: np.ndarray, centres: np.ndarray, most: int) -> np.ndarray:
    """The nearest centre of each row that has room; the rows with most to lose choose first."""
    far = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
    order = np.argsort(far, axis=1)
    own = np.full(len(x), -1)
    room = np.full(len(centres), most)
    for choice in range(len(centres)):
        open_rows = np.flatnonzero(own < 0)
        for j in range(len(centres)):
            mine = open_rows[order[open_rows, choice] == j]
            later = far[mine, order[mine, min(choice + 1, len(centres) - 1)]] - far[mine, j]
            mine = mine[np.argsort(-later, kind="stable")][: room[j]]
            own[mine] = j
            room[j] -= len(mine)
    return own


def fit(sample: np.ndarray, scale: float, n: int, k: int, list_rows: int = 400, degree: int = 24, goal: float = 0.98) -> Index:
    """Centroids, their graph and the pruning ratio from a sample of different vectors.

    ``n`` is the number of all vectors: a list is meant to hold ``list_rows`` of them, but a centroid stands for
    16 rows of the sample at least. The ratio is the smallest that, for sampled queries, reaches the share
    ``goal`` of their ``k`` nearest in the sample.
    """
    index = Index(sample.shape[1], scale, np.zeros((0, 0)), np.zeros((0, 0), int), np.zeros(0, int), 1.0)
    x = index.lift(sample)
    leaf = max(16, int(len(x) * list_rows / max(n, 1)))
    index.centroids = np.stack([x[rows].mean(axis=0) for rows in _balanced(x, leaf)])
    lists = len(index.centroids)
    gaps = ((index.centroids[:, None, :] - index.centroids[None]) ** 2).sum(axis=2) if lists <= 2048 else np.stack([((index.centroids - c) ** 2).sum(axis=1) for c in index.centroids])
    np.fill_diagonal(gaps, np.inf)
    near = np.argsort(gaps, axis=1, kind="stable")[:, : min(degree, lists - 1)]
    hops = (np.arange(lists)[:, None] + 2 ** np.arange(max(1, (lists - 1).bit_length()))) % lists  # keeps the graph in one piece
    index.graph = np.concatenate([near, hops], axis=1)
    index.entry = np.unique(np.linspace(0, lists - 1, min(lists, 8)).astype(int))

    asked = sample[:: max(1, len(sample) // 256)]
    own = np.concatenate([assign(index, sample[s : s + 2048])[0] for s in range(0, len(sample), 2048)])
    q = index.aim(asked)
    to_lists = np.sqrt(np.maximum(0, ((q[:, None, :] - index.centroids[None]) ** 2).sum(axis=2)))
    ratios = to_lists / to_lists.min(axis=1, keepdims=True)
    scores = asked @ sample.T
    top = np.argsort(-scores, axis=1, kind="stable")[:, : k + 1]
    reach = np.where(own[top] >= 0, np.take_along_axis(ratios, own[top].reshape(len(q), -1), axis=1).reshape(own[top].shape), np.inf).min(axis=2)
    index.ratio = float(np.quantile(reach, goal))
    return index


def assign(index: Index, x: np.ndarray, slack: float = 0.06, copies: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Lists of each row, nearest first and -1 where there is none."""
    lifted = index.lift(x)
    ids, far = index.nearest(lifted, 4 * copies)
    chosen = np.full((len(x), copies), -1)
    chosen[:, 0] = ids[:, 0]
    held = np.ones(len(x), int)
    for j in range(1, ids.shape[1]):
        ok = (far[:, j] <= (1 + slack) * far[:, 0]) & (held < copies) & (ids[:, j] >= 0)
        rows = np.flatnonzero(ok)
        gap = index.centroids[chosen[rows]] - index.centroids[ids[rows, j]][:, None, :]
        apart = np.where(chosen[rows] >= 0, np.sqrt((gap * gap).sum(axis=2)), np.inf).min(axis=1)
        rows = rows[apart >= far[rows, j]]
        chosen[rows, held[rows]] = ids[rows, j]
        held[rows] += 1
    return chosen, far


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v`` of the vectors that take part: not null or zero, all components finite, the commonest length."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.filter(F.col(id_col).isNotNull() & v.isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (lengths.n if lengths else 0))


def search(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = 8192, list_rows: int = 400, block: int = 4096, first_lists: int = 3) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query (a row of ``df`` for which ``is_query`` holds of its id
    column) the ``k`` nearest rows found, nearest first, ties to the smaller id.

    The score is the inner product of the original vectors in double precision. A query finds every row but those
    with its own id; ids that repeat count once. Vectors that are null or zero, hold a null or a non-finite component
    or have another length than most take no part, nor do null ids. A query gets all others if there are no
    more than ``k``. The index is fitted on about ``sample`` rows (those with the smallest hashes); every row
    is indexed. A query reads its ``first_lists`` nearest lists first; the others only send rows that reach the
    ``k``-th score found there.
    """
    rows = usable(df, id_col, vector_col)
    n, longest = rows.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()
    out_schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return df.sparkSession.createDataFrame([], out_schema)
    limit = (2**63 - 1) * min(sample, n) // n
    part = rows.filter(F.xxhash64("id").bitwiseAND(2**63 - 1) <= limit).orderBy("id").toArrow()
    if not part.num_rows:
        part = rows.orderBy("id").limit(1).toArrow()
    vectors = np.unique(_matrix(part.column("v"), len(part.column("v")[0])), axis=0)
    vectors = vectors[np.random.Generator(np.random.PCG64(5)).permutation(len(vectors))]
    index = fit(vectors, float(np.sqrt(longest)) * (1 + 1e-12), n, k, list_rows)
    dim, lists = index.dim, len(index.centroids)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                piece = batch.slice(s, 1024)
                chosen, _ = assign(index, _matrix(piece.column("v"), dim))
                yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("v"), pa.array([r[r >= 0].tolist() for r in chosen], pa.list_(pa.int32()))], ["id", "v", "lists"])

    placed = cut(rows.mapInArrow(place, "id long, v array<double>, lists array<int>"))
    posted = placed.select("id", "v", F.explode("lists").alias("list"), (F.col("lists")[0]).alias("home"))
    sizes = posted.groupBy("list").agg(F.count("*").alias("n"), F.sum((F.col("home") == F.col("list")).cast("int")).alias("own")).collect()  # a row a list
    held, own = np.zeros(lists, np.int64), np.zeros(lists, np.int64)
    for r in sizes:
        held[r.list], own[r.list] = r.n, r.own
    blocks = np.maximum(1, -(-held // block))

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                piece = batch.slice(s, 256)
                q = index.aim(_matrix(piece.column("v"), dim))
                width = min(lists, 32)
                while True:  # widen the beam until it holds all lists within the ratio
                    ids, far = index.nearest(q, width)
                    inside = (far <= index.ratio * far[:, :1]) & (ids >= 0)
                    if width == lists or not inside[:, -1].any():
                        break
                    width = min(lists, 2 * width)
                found = []
                for i, row in enumerate(ids):
                    row = row[inside[i]]
                    if own[row].sum() <= k:  # too few rows: go on by distance
                        order = np.argsort(((index.centroids - q[i]) ** 2).sum(axis=1), kind="stable")
                        row = order[: int(np.searchsorted(np.cumsum(own[order]), k + 1)) + 1]
                    found.append(row.tolist())
                yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("v"), pa.array(found, pa.list_(pa.int32()))], ["id", "v", "lists"])

    asked = placed.select("id", "v").withColumn(id_col, F.col("id")).filter(is_query).select("id", "v").dropDuplicates(["id"])
    asked = cut(asked.mapInArrow(aim, "id long, v array<double>, lists array<int>"))
    at = lambda counts: F.get(F.array(*[F.lit(int(c)) for c in counts]), F.col("list"))
    n_blocks = at(blocks)
    keys = ["list", "block", "q_block"]

    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """Of each query in turn the block's rows from its bound on, the best ``k`` of them."""
        parts: list[np.ndarray] = []
        if left.num_rows and right.num_rows:
            ids, v = np.asarray(left.column("id")), _matrix(left.column("v"), dim)
            ids, once = np.unique(ids, return_index=True)
            v = np.ascontiguousarray(v[once])
            q_ids, q = np.asarray(right.column("id")), _matrix(right.column("v"), dim)
            bound = np.asarray(right.column("bound"), np.float64)
            for s in range(0, len(q), 256):
                rough = q[s : s + 256] @ v.T
                rough[q_ids[s : s + 256, None] == ids] = -np.inf
                edge = bound[s : s + 256]
                if len(ids) > k:  # at least the block's own k-th best
                    edge = np.maximum(edge, np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k])
                slack = np.where(np.isfinite(edge), 1e-9 * (1 + np.abs(edge)), 0.0)
                row, col = np.nonzero((rough >= (edge - slack)[:, None]) & (rough > -np.inf))
                exact = (v[col] * q[s + row]).sum(axis=1)  # the same sum for equal vectors, wherever they stand
                good = exact >= bound[s + row]
                row, col, exact = row[good], col[good], exact[good]
                order = np.lexsort((ids[col], -exact, row))
                row, col, exact = row[order], col[order], exact[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                best = place < k
                parts.append(np.array([q_ids[s + row[best]], ids[col[best]], exact[best].view(np.int64)]))
        q_id, v_id, bits = np.concatenate(parts, axis=1) if parts else np.zeros((3, 0), np.int64)
        return pa.table({"query_id": q_id, "vec_id": v_id, "score": np.ascontiguousarray(bits).view(np.float64)})

    def read(wanted: DataFrame) -> DataFrame:
        """Rows of the lists that ``id, v, bound, lists`` ask for; large lists and many queries of a list are dealt in blocks."""
        wanted = cut(wanted.select("id", "v", "bound", F.explode("lists").alias("list")))
        counts = np.zeros(lists, np.int64)
        for r in wanted.groupBy("list").count().collect():  # a row a list
            counts[r.list] = r["count"]
        n_q = at(np.maximum(1, -(-counts // 1024)))
        stored = posted.select("list", F.pmod(F.xxhash64("id"), n_blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), n_q - 1)).alias("q_block"), "id", "v")
        wanted = wanted.select("list", F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("block"), F.pmod(F.xxhash64("id", F.lit(1)), n_q).cast("int").alias("q_block"), "id", "v", "bound")
        return stored.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInArrow(score, "query_id long, vec_id long, score double").dropDuplicates(["query_id", "vec_id"])

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = lambda found: found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    # the nearest lists first: what they give bounds what the others have to send
    near = cut(best(read(asked.select("id", "v", F.lit(float("-inf")).alias("bound"), F.slice("lists", 1, first_lists).alias("lists")))))
    bounds = near.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
    rest = asked.select("id", "v", F.slice("lists", first_lists + 1, F.greatest(F.size("lists"), F.lit(1))).alias("lists")).filter(F.size("lists") > 0)
    far = read(rest.join(bounds, "id", "left").select("id", "v", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"), "lists"))
    both = near.drop("rank").unionByName(far).dropDuplicates(["query_id", "vec_id"])
    return best(both).select("query_id", "rank", "vec_id", "score")
