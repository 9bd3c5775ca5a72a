"""Hard negatives by bit-sliced integer products.

Components are integers in two's complement. The rows' bit-planes are processed most significant first: after some
planes the product of an anchor and a row lies in an interval, from all lower bits taken against the
anchor to all taken for it. Each plane halves the interval. A row is dropped as soon as its interval can't qualify:
for positives, if it ends below the least of the best intervals' starts; for negatives, if it misses all the anchor's windows or
ends below the starts of enough intervals that lie wholly in them.

Rows are dealt to shards of bounded size and anchors to blocks; each pair of them is a task's work.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .integer_vectors import LEAST, as_long, as_type, exact_type, integer_vectors, matrix, smallest_copies

#: Takes the pairs' anchors and the ends of their intervals; returns which of them stay.
Judge = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def kth_largest(group: np.ndarray, value: np.ndarray, k: int, groups: int) -> np.ndarray:
    """The ``k``-th largest value of each group; minus infinity where there are fewer."""
    out = np.full(groups, -np.inf, value.dtype if value.dtype == object else np.float64)
    order = np.lexsort((-value, group)) if value.dtype != object else np.array(sorted(range(len(value)), key=lambda i: (group[i], -value[i])), np.int64)
    group, value = group[order], value[order]
    place = np.arange(len(group)) - np.searchsorted(group, group)
    out[group[place == k - 1]] = value[place == k - 1]
    return out


def sliced_products(a: np.ndarray, x: np.ndarray, pairs: np.ndarray, bits: int, judge: Judge) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(anchor, row, product)`` of the pairs that the judge keeps to the end; ``pairs`` masks those to begin with.

    ``x`` must lie in [-2**bits, 2**bits). The planes are the sign, which weighs -2**bits, and then the bits from
    the highest on; while many pairs are left a plane's products are a matrix product, then they are summed by pair.
    """
    kind = exact_type(np.abs(a) + 1, np.full((1, x.shape[1]), 2.0 ** (bits + 1)))
    whole = as_type(x, object) if bits > 51 else x.astype(np.int64)
    a = as_type(a, kind)
    up, down = (a * (a > 0)).sum(axis=1), (a * (a < 0)).sum(axis=1)
    r, c = np.nonzero(pairs)
    got = np.zeros(len(r), kind) if kind is np.float64 else np.array([0] * len(r), object)
    for t in range(bits, -1, -1):
        plane = (whole < 0) if t == bits else (whole >> t) & 1
        plane = plane.astype(np.float64) if kind is np.float64 else np.array([int(b) for b in plane.ravel()], object).reshape(plane.shape)
        weight = -(2**t) if t == bits else 2**t
        if len(r) * 8 > pairs.size or kind is object:
            got = got + weight * (a @ plane.T)[r, c]
        else:
            for s in range(0, len(r), 1 << 16):
                got[s : s + (1 << 16)] += weight * np.einsum("ij,ij->i", a[r[s : s + (1 << 16)]], plane[c[s : s + (1 << 16)]])
        rest = 2**t - 1
        stay = judge(r, got + rest * down[r], got + rest * up[r])
        r, c, got = r[stay], c[stay], got[stay]
    return r, c, as_long(got)


def best_of(bound_k: int, groups: int) -> Judge:
    def judge(r: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return high >= kth_largest(r, low, bound_k, groups)[r]

    return judge


def in_windows(least: np.ndarray, most: np.ndarray, k: int) -> Judge:
    """Keeps what may be among the ``k`` best of a window; row i of ``least`` and ``most`` has the windows of anchor i."""

    def judge(r: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        stay = np.zeros(len(r), bool)
        for w in range(least.shape[1]):
            may = (high >= least[r, w]) & (low <= most[r, w])
            sure = may & (low >= least[r, w]) & (high <= most[r, w])
            if sure.any():
                may &= high >= kth_largest(r[sure], low[sure], k, len(least))[r]
            stay |= may
        return stay

    return judge


def mine(df: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, factor: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 8192, block: int = 8192) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` in whole numbers.

    The score of a row with an anchor is the inner product of the vectors with components ``floor(factor * x)``.
    An anchor (a row for whose id ``is_anchor`` holds) has as positives the first ``positives`` other rows of its label,
    highest scores first, ties to smaller ids. Each of them has as negatives the first ``negatives`` rows of other
    labels with ``least`` * positive_score <= 100 * negative_score <= ``most`` * positive_score, in the same order; a
    positive without any has no row. All are exact, whatever ``shard_rows`` and ``block``.

    Which vectors take part and how repeated ids count is told at ``integer_vectors`` (null labels, null or non-finite
    components, odd lengths; extra columns don't matter). An empty table gives no rows. Scores beyond a long become the
    nearest long. Equal vectors of a label and shard collapse to as many smallest ids as a list can hold.
    """
    rows = cut(integer_vectors(df, factor, id_col, vector_col, label))
    n, far, dim = rows.agg(F.count("*"), F.max(F.array_max(F.transform("v", lambda x: F.greatest(x, -x - 1)))), F.max(F.size("v"))).first()
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return df.sparkSession.createDataFrame([], out)
    bits = int(far or 0).bit_length()
    shards = -(-n // shard_rows)
    stored = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    anchors = cut(rows.withColumn(id_col, F.col("id")).filter(is_anchor).select("id", "label", "v"))
    blocks = max(1, -(-anchors.count() // block))
    keys = ["shard", "block"]
    stored = stored.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def dealt(asked: DataFrame) -> DataFrame:
        return asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def shard(table: pa.Table, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, labels, x = np.asarray(table.column("id")), np.asarray(table.column("label")), matrix(table.column("v"), dim)
        once = smallest_copies(ids, keep, labels, *x.T)
        return ids[once], labels[once], x[once]

    def lists(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """The best rows of the shard of each anchor's label."""
        parts = [np.zeros((3, 0), np.int64)]
        if left.num_rows and right.num_rows:
            ids, labels, x = shard(left, positives + 1)
            a_ids, a_labels, a = np.asarray(right.column("id")), np.asarray(right.column("label")), matrix(right.column("v"), dim)
            for one in np.unique(a_labels):
                mine, own = np.flatnonzero(a_labels == one), np.flatnonzero(labels == one)
                for s in range(0, len(mine) if len(own) else 0, 128):
                    who = mine[s : s + 128]
                    r, c, score = sliced_products(a[who], x[own], a_ids[who][:, None] != ids[own][None], bits, best_of(positives, len(who)))
                    parts.append(np.array([a_ids[who[r]], ids[own[c]], score]))
        anchor, other, score = np.concatenate(parts, axis=1)
        return pa.table({"anchor_id": anchor, "positive_id": other, "positive_score": score})

    first = stored.groupBy(*keys).cogroup(dealt(anchors).groupBy(*keys)).applyInArrow(lists, "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    first = first.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)
    first = first.groupBy(F.col("anchor_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("found"))
    windows = cut(anchors.join(first, "id").select("id", "label", "v", F.col("found.positive_id").alias("p_ids"), F.col("found.positive_score").alias("p_scores")))

    def answers(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """The best rows of other labels in the shard for each positive of each anchor."""
        parts = [np.zeros((5, 0), np.int64)]
        if left.num_rows and right.num_rows:
            ids, labels, x = shard(left, negatives)
            for s in range(0, right.num_rows, 128):
                piece = right.slice(s, 128)
                a_ids, a_labels, a = np.asarray(piece.column("id")), np.asarray(piece.column("label")), matrix(piece.column("v"), dim)
                p_ids, p_scores = piece.column("p_ids").to_pylist(), piece.column("p_scores").to_pylist()
                low, high = (np.array([[edge(p) for p in own] + [out] * (positives - len(own)) for own in p_scores], object) for edge, out in ((lambda p: -(-least * p // 100), 1), (lambda p: most * p // 100, 0)))
                if max(map(abs, low.ravel()), default=0) < 2**52 and max(map(abs, high.ravel()), default=0) < 2**52:
                    low, high = low.astype(np.float64), high.astype(np.float64)
                r, c, score = sliced_products(a, x, a_labels[:, None] != labels[None], bits, in_windows(low, high, negatives))
                for w in range(positives):
                    good = (score >= low[r, w]) & (score <= high[r, w])
                    who, row, s_ = r[good], c[good], score[good]
                    o = np.lexsort((ids[row], np.where(s_ == LEAST, np.iinfo(np.int64).max, -s_), who))
                    who, row, s_ = who[o], row[o], s_[o]
                    top = np.arange(len(who)) - np.searchsorted(who, who) < negatives
                    who, row, s_ = who[top], row[top], s_[top]
                    parts.append(np.array([a_ids[who], [p_ids[i][w] for i in who], ids[row], [p_scores[i][w] for i in who], s_], np.int64).reshape(5, -1))
        anchor, positive, negative, p_score, score = np.concatenate(parts, axis=1)
        return pa.table({"anchor_id": anchor, "positive_id": positive, "negative_id": negative, "positive_score": p_score, "negative_score": score})

    found = stored.groupBy(*keys).cogroup(dealt(windows).groupBy(*keys)).applyInArrow(answers, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
