"""Label sequences: spans, alignment, accuracy; a linear-chain CRF trained by distributed gradients."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bound


def spans(labels: Column) -> Column:
    """Array of tag, start, stop of an array of labels: B_x I_x* E_x of one tag, or W_x; broken runs are dropped.

    Only neighbours among the labels that are not I_ can begin and end a run, so the work grows with the labels; of those only B_ and W_ begin one.
    """
    kind, tag = lambda c: F.left(c, F.lit(2)), lambda c: F.substr(c, F.lit(3))
    places = F.filter(F.sequence(F.lit(0), F.size(labels) - 1), lambda i: ~F.coalesce(F.get(labels, i), F.lit("O")).startswith("I_"))
    pairs = bound(places, lambda p: F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda p, q: F.struct(p.alias("p"), q.alias("q"))))
    both = F.when(F.size(labels) > 0, F.filter(pairs, lambda x: kind(F.get(labels, x["p"])).isin("B_", "W_")))
    span = lambda label, start, stop: F.struct(tag(label).alias("tag"), start.alias("start"), stop.alias("stop"))

    def found(x: Column) -> Column:
        first, last = F.get(labels, x["p"]), F.get(labels, x["q"])
        inside = F.slice(labels, x["p"] + 2, F.greatest(x["q"] - x["p"] - 1, F.lit(0)))
        whole = (kind(first) == "B_") & (kind(last) == "E_") & (tag(first) == tag(last)) & F.forall(inside, lambda i: tag(i) == tag(first))
        return F.when(kind(first) == "W_", span(first, x["p"], x["p"] + 1)).when(whole, span(first, x["p"], x["q"] + 1))

    return F.coalesce(F.filter(F.transform(both, found), lambda x: x.isNotNull()), F.array().cast("array<struct<tag:string,start:int,stop:int>>"))


def span_text(tokens: Column, span: Column) -> Column:
    return F.array_join(F.slice(tokens, span["start"] + 1, span["stop"] - span["start"]), " ")


def metadata(sequences: DataFrame, title_tag: str = "T", author_tag: str = "A") -> DataFrame:
    """``id, title, authors`` from ``id, tokens, labels``: the first title span and all author spans."""
    found = sequences.withColumn("spans", spans(F.col("labels")))
    of = lambda tag: F.filter("spans", lambda s: s["tag"] == tag)
    title = F.transform(F.slice(of(title_tag), 1, 1), lambda s: span_text(F.col("tokens"), s))
    return found.select("id", F.get(title, F.lit(0)).alias("title"), F.transform(of(author_tag), lambda s: span_text(F.col("tokens"), s)).alias("authors"))


def first_occurrence(tokens: Column, target: Column) -> Column:
    """Place (from 0) at which the target tokens first stand consecutively, ignoring case; null if nowhere or empty."""
    n = F.size(target)
    places = F.sequence(F.lit(0), F.greatest(F.size(tokens) - n, F.lit(0)))
    # a token is lower-cased where it is compared, not the whole array at each place
    same = lambda i: F.transform(F.slice(tokens, i + 1, n), F.lower) == F.transform(target, F.lower)
    hits = F.filter(places, lambda i: (F.lower(F.get(tokens, i)) == F.lower(F.get(target, F.lit(0)))) & same(i))
    return F.when(n > 0, F.get(hits, F.lit(0)))


def align_labels(tokens: Column, target: Column, tag: str) -> Column:
    """Labels of the tokens: the target's first occurrence as B, I, E (or W), all else O."""
    at, n = first_occurrence(tokens, target), F.size(target)
    return F.transform(
        tokens,
        lambda t, i: F.when(at.isNull() | (i < at) | (i >= at + n), "O").when(n == 1, f"W_{tag}").when(i == at, f"B_{tag}").when(i == at + n - 1, f"E_{tag}").otherwise(f"I_{tag}"),
    )


def token_accuracy(rows: DataFrame, gold: str = "gold", guess: str = "guess") -> DataFrame:
    return rows.agg(F.avg((F.col(gold) == F.col(guess)).cast("double")).alias("accuracy"))


def label_scores(rows: DataFrame, gold: str = "gold", guess: str = "guess") -> DataFrame:
    """``label, precision, recall, f1`` of every label: one pass, two counts a row."""
    hit = (F.col(gold) == F.col(guess)).cast("long")
    both = rows.select(F.explode(F.array(F.struct(F.col(gold).alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p"), hit.alias("h")), F.struct(F.col(guess).alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p"), F.lit(0).cast("long").alias("h")))).alias("x")).select("x.*")
    s = both.groupBy("label").agg(F.sum("g").alias("g"), F.sum("p").alias("p"), F.sum("h").alias("h"))
    precision, recall = F.coalesce(F.try_divide("h", "p"), F.lit(0.0)), F.coalesce(F.try_divide("h", "g"), F.lit(0.0))
    return s.select("label", precision.alias("precision"), recall.alias("recall"), F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"))


@dataclass
class Crf:
    """Weights of a linear-chain CRF over hashed features."""

    labels: list[str]
    node: np.ndarray  # (slots, labels)
    edge: np.ndarray  # (labels, labels)

    def decode(self, features: list[list[np.ndarray]]) -> list[list[str]]:
        """The best label path of each sequence; those of a length step together."""
        paths: list[list[str]] = [[] for _ in features]
        for rows, scores, _, _ in self._by_length(features):
            best, back = scores[:, 0], []
            for i in range(1, scores.shape[1]):
                ways = best[:, :, None] + self.edge
                back.append(ways.argmax(axis=1))
                best = ways.max(axis=1) + scores[:, i]
            path = [best.argmax(axis=1)]
            for b in reversed(back):
                path.append(b[np.arange(len(rows)), path[-1]])
            for r, labels in zip(rows, np.stack(path[::-1], axis=1).tolist(), strict=True):
                paths[r] = [self.labels[i] for i in labels]
        return paths

    def gradient(self, features: list[list[np.ndarray]], gold: list[np.ndarray], node: np.ndarray, edge: np.ndarray) -> float:
        """Add the gradient of the sequences' log-likelihood to ``node`` and ``edge``; return the latter. Those of a length step together."""
        likelihood = 0.0
        for rows, scores, slot, at in self._by_length(features):
            n, k = scores.shape[1:]
            g = np.stack([np.asarray(gold[r], int) for r in rows])
            ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
            ahead[:, 0] = scores[:, 0]
            for i in range(1, n):
                ahead[:, i] = scores[:, i] + _logsum(ahead[:, i - 1, :, None] + self.edge, 1)
            for i in range(n - 2, -1, -1):
                behind[:, i] = _logsum(self.edge + (scores[:, i + 1] + behind[:, i + 1])[:, None, :], 2)
            total = _logsum(ahead[:, -1], 1)
            step = -np.exp(ahead + behind - total[:, None, None])
            step.reshape(-1, k)[np.arange(g.size), g.ravel()] += 1.0
            step = step.reshape(-1, k)[at]
            for j in range(k):
                node[:, j] += np.bincount(slot, step[:, j], len(node))
            if n > 1:
                edge += np.bincount((g[:, :-1] * k + g[:, 1:]).ravel(), minlength=k * k).reshape(k, k)
            for i in range(1, n):
                edge -= np.exp(ahead[:, i - 1, :, None] + self.edge + (scores[:, i] + behind[:, i])[:, None, :] - total[:, None, None]).sum(axis=0)
            likelihood += float(np.take_along_axis(scores, g[:, :, None], 2).sum() + self.edge[g[:, :-1], g[:, 1:]].sum() - total.sum())
        return likelihood

    def _by_length(self, features: list[list[np.ndarray]], tokens: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Rows, scores (rows x tokens x labels), feature slots and the token of each slot, of sequences of a length; about ``tokens`` at once, without empty ones."""
        sizes = np.fromiter(map(len, features), int, len(features))
        for n in np.unique(sizes[sizes > 0]):
            same = np.flatnonzero(sizes == n)
            for s in range(0, len(same), max(tokens // n, 1)):
                rows = same[s : s + max(tokens // n, 1)]
                each = [np.asarray(x, int) for r in rows for x in features[r]]
                slot, at = np.concatenate(each), np.repeat(np.arange(len(each)), [len(x) for x in each])
                k = len(self.labels)
                scores = np.stack([np.bincount(at, self.node[slot, j], len(each)) for j in range(k)], axis=1)
                yield rows, scores.reshape(len(rows), n, k), slot, at


def _logsum(x: np.ndarray, axis: int):
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train_crf(sequences: DataFrame, labels: list[str], slots: int = 2048, rounds: int = 12, rate: float = 0.5, decay: float = 1e-4) -> Crf:
    """Gradient ascent; each round is one job that sums the gradient by partition and then by weight.

    ``sequences`` has ``features`` (an array of feature slots for each token) and ``gold`` (label numbers). Only the
    summed gradient, of a fixed number of weights, comes to the driver. Persist ``sequences`` beforehand.
    """
    k = len(labels)
    model = Crf(labels, np.zeros((slots, k)), np.zeros((k, k)))
    memory = np.zeros(slots * k + k * k)
    for _ in range(rounds):
        weights = model

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            node, edge, n = np.zeros((slots, k)), np.zeros((k, k)), 0
            for batch in batches:
                weights.gradient(list(batch.features), list(batch.gold), node, edge)
                n += sum(map(len, batch.gold))
            flat = np.concatenate([node.ravel(), edge.ravel(), [float(n)]])
            at = np.flatnonzero(flat)
            yield pd.DataFrame({"at": at, "value": flat[at]})

        total = np.zeros(slots * k + k * k + 1)
        for at, value in sequences.mapInPandas(part, "at long, value double").groupBy("at").agg(F.sum("value")).collect():
            total[at] = value
        grad = total[:-1] / max(total[-1], 1.0)
        memory += grad * grad
        flat = np.concatenate([model.node.ravel(), model.edge.ravel()]) * (1 - decay) + rate * grad / (np.sqrt(memory) + 1e-8)
        model = Crf(labels, flat[: slots * k].reshape(slots, k), flat[slots * k :].reshape(k, k))
    return model


def decode_crf(sequences: DataFrame, model: Crf, id_col: str = "id") -> DataFrame:
    """``id, labels``: the best path of each sequence of ``features``; batches of sequences, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({id_col: batch[id_col], "labels": model.decode(list(batch.features))})

    return sequences.select(id_col, "features").mapInPandas(run, f"`{id_col}` {sequences.schema[id_col].dataType.simpleString()}, labels array<string>")
