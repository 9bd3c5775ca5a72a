"""The trie of conversation prefixes from mergeable partial tries.

A node is a sequence of turns, named by a chain of digests. Each partition reads its conversations as a stream and
emits a table of the nodes they pass, combined locally: members, the smallest of them, and lists of those that end there,
in pieces by ranges of ids, so that no list has an unbounded length. Rounds of merges keyed by node (and piece) sum
members and join lists, a group of partitions at a time, until one row a key is left. The rollup goes up from the
leaves by doubling: a node that knows the sums of what is less than d below it adds those of its descendants
exactly d below, whose digests the streams have noted, and then knows all that is less than 2 d below.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .mixing import word_count

ROOT = bytes(16)
PARTIAL = "node binary, piece long, parent binary, above array<binary>, depth long, words long, n_convs long, first long, longest long, ends array<long>, part int"
#: Ids of a piece of a list of ends lie within 2**PIECE of each other.
PIECE = 12


def turns_of(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv, turn, role, digest, words``: what the trie needs of each turn, without its text."""
    role, text = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    digest = F.unhex(F.md5(F.concat_ws(" ", F.octet_length(role).cast("string"), role, text)))
    return df.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), role.alias("role"), F.md5(text).alias("by"), digest.alias("digest"), word_count(text).alias("words")
    )


def rebuilt(turns: DataFrame, donor: Column, head: Column, most: int) -> DataFrame:
    """``conv, head, borrowed, turn, role, by, digest, words``: each conversation's own turns (of which the first ``head`` are to
    be left out by the reader) and the first ``head`` turns of its donor. ``head`` must not exceed ``most``."""
    ids = turns.select("conv").distinct().select("conv", donor.alias("donor"), head.alias("head"))
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", "by")
    lent = turns.join(ids.select(F.col("donor").alias("conv")).distinct(), "conv", "left_semi")
    lent = lent.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).withColumnRenamed("conv", "donor")
    lent = ids.join(lent, "donor").filter("place <= head")
    columns = ["conv", "head", "borrowed", "turn", "role", "by", "digest", "words"]
    own = turns.withColumn("head", head).withColumn("borrowed", F.lit(0))
    return own.select(*columns).unionByName(lent.withColumn("borrowed", F.lit(1)).select(*columns))


def partial_tries(rows: DataFrame, held: int) -> DataFrame:
    """A locally combined node table a partition (more where it would hold more than ``held`` nodes at a time)."""
    types = pa.schema([("node", pa.binary()), ("piece", pa.int64()), ("parent", pa.binary()), ("above", pa.list_(pa.binary())), *((c, pa.int64()) for c in ("depth", "words", "n_convs", "first", "longest")), ("ends", pa.list_(pa.int64())), ("part", pa.int32())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        nodes: dict[bytes, list] = {}
        ends: dict[tuple[bytes, int], list[int]] = {}
        path, words = [ROOT], [0]
        now, skip = None, 0

        def close() -> None:
            for depth, node in enumerate(path):
                if (own := nodes.get(node)) is None:
                    above = [path[depth - (1 << i)] for i in range(depth.bit_length())]
                    nodes[node] = [above, depth, words[depth], 1, now, len(path) - 1]
                else:
                    own[3] += 1
                    own[4] = min(own[4], now)
                    own[5] = max(own[5], len(path) - 1)
            ends.setdefault((path[-1], now >> PIECE), []).append(now)

        def table() -> Iterator[pa.RecordBatch]:
            rows = [{"node": k, "above": v[0], "parent": v[0][0] if v[0] else None, "depth": v[1], "words": v[2], "n_convs": v[3], "first": v[4], "longest": v[5], "part": part} for k, v in nodes.items()]
            rows += [{"node": k, "piece": p, "ends": v, "part": part} for (k, p), v in ends.items()]
            for s in range(0, len(rows), 8192):
                yield pa.RecordBatch.from_pylist(rows[s : s + 8192], schema=types)
            nodes.clear()
            ends.clear()

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv", "head", "borrowed", "digest", "words"))
            for conv, head, borrowed, digest, n_words in zip(*columns, strict=True):
                if conv != now:
                    if now is not None:
                        close()
                        if len(nodes) >= held:
                            yield from table()
                    now, skip, path, words = conv, head, [ROOT], [0]
                if not borrowed and skip:
                    skip -= 1
                    continue
                path.append(hashlib.md5(path[-1] + digest).digest())
                words.append(n_words)
        if now is not None:
            close()
        yield from table()

    ordered = rows.repartition("conv").sortWithinPartitions("conv", F.desc("borrowed"), F.asc_nulls_first("turn"), "role", "by")
    return ordered.select("conv", "head", "borrowed", "digest", "words").mapInArrow(walk, PARTIAL)


def merged(parts: DataFrame, fan: int) -> DataFrame:
    """One row a node and piece: rounds of merges, each of ``fan`` groups of partitions into one."""
    groups = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        groups = -(-groups // fan)
        keys = ["node", "piece"] if groups == 1 else ["node", "piece", F.floor(F.col("part") / fan).cast("int").alias("part")]
        parts = parts.groupBy(*keys).agg(
            *(F.any_value(c, ignoreNulls=True).alias(c) for c in ("parent", "above", "depth", "words")),
            F.sum("n_convs").alias("n_convs"), F.min("first").alias("first"), F.max("longest").alias("longest"), F.flatten(F.collect_list("ends")).alias("ends"),
        )
        if groups == 1:
            return cut(parts)


def digests(ends: DataFrame) -> DataFrame:
    """``node, ends_sha256`` from sorted pieces of lists: each list is hashed as a stream, a piece at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, hashlib.sha256()
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if node == now:
                    state.update(b",")
                else:
                    if now is not None:
                        done.append((now, state.hexdigest()))
                    now, state = node, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string())], ["node", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["node", "ends_sha256"])

    text = ends.select("node", "piece", F.array_join(F.array_sort("ends").cast("array<string>"), ",").alias("ids"))
    return text.repartition("node").sortWithinPartitions("node", "piece").select("node", "ids").mapInArrow(run, "node binary, ends_sha256 string")


def rolled_up(nodes: DataFrame) -> DataFrame:
    """Add ``n_children, n_leaves, saved_tokens``; the last two are sums over each node's subtree."""
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    now = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    now = cut(now.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")}))
    done, i = [], 0
    while True:
        # no conversation through these is as long as 2 ** i turns: they have nothing so far below them, and nothing so far above
        done.append(now.filter(F.col("longest") < 2**i))
        now = now.filter(F.col("longest") >= 2**i)
        if now.isEmpty():
            break
        below = now.filter(F.col("depth") >= 2**i).groupBy(F.get("above", F.lit(i)).alias("node")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_tokens"))
        now = now.join(below, "node", "left")
        now = cut(now.withColumns({"n_leaves": F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0)), "saved_tokens": F.col("saved_tokens") + F.coalesce("more_tokens", F.lit(0))}).drop("more_leaves", "more_tokens"))
        i += 1
    out = done[0]
    for other in done[1:]:
        out = out.unionByName(other)
    return out


def with_parents(nodes: DataFrame) -> DataFrame:
    """Add ``parent_first``, the parent's smallest member. At most 1,000 nodes have more than a thousandth of all
    nodes as children; those are broadcast, so that none of them is a hot key of a join."""
    large = F.col("n_children") > max(1000, nodes.count() // 1000)
    pick = [F.col("node").alias("parent"), F.col("first").alias("parent_first")]
    found = nodes.join(F.broadcast(nodes.filter(large).select(*pick)), "parent", "left")
    rest = found.filter(F.col("parent_first").isNull()).drop("parent_first")
    rest = rest.join(nodes.filter(~large & (F.col("n_children") > 0)).select(*pick), "parent", "left")
    return found.filter(F.col("parent_first").isNotNull()).unionByName(rest)


def trie(df: DataFrame, donor: Column, head: Column, most_head: int, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", held: int = 100_000, fan: int = 32) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of each node of the
    trie of rebuilt conversations.

    A conversation's turns go by ``turn``, null first; equal ones by role and then by the MD5 digest of the text.
    Null roles and texts count as empty, rows without a conversation's id as none; extra columns don't matter, and a repeated row
    is a turn of its own. Conversation ``conv`` is rebuilt from the first ``head`` turns of
    conversation ``donor`` (columns over ``conv``, ``head`` at most ``most_head``; all if it has fewer, none if there is no such
    conversation) and its own turns after its first ``head``; it may come out without turns and then
    ends at the root. An empty table has no nodes, not even a root.

    ``conv_id`` is a node's smallest member, a member being a rebuilt conversation that begins with the node's turns, and
    ``parent_conv_id`` the parent's; ``n_leaves`` counts nodes without children in the subtree; ``saved_tokens`` sums (members - 1) x words of the
    last turn over the subtree; ``ends_sha256`` digests the ids of the members that have no further turn, ascending
    and joined by commas. A task holds one conversation's path (16 bytes a turn) and ``held`` nodes.
    """
    turns = cut(turns_of(df, conv, turn, role, text))
    parts = cut(partial_tries(rebuilt(turns, donor, head, most_head), held))
    table = merged(parts, fan)
    nodes = with_parents(rolled_up(table.filter("piece is null").drop("ends", "piece")))
    found = nodes.join(digests(table.filter("piece is not null").select("node", "piece", "ends")), "node", "left")
    return found.select(
        F.col("first").alias("conv_id"), "depth", F.col("parent_first").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
