"""Language identification by the nearest of several TF-IDF centroids a language."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, cut

_BITS = 13
DIM = 1 << _BITS
_LETTER = re.compile(r"[^\W\d_]")
_BLANK = np.array([32 if b < 0x80 and not chr(b).isalpha() else b for b in range(256)], np.uint32)
_BLOCK = 1 << 20


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots and counts of the text's byte trigrams (lower case, all but letters as blanks), hashed to DIM slots."""
    raw = np.frombuffer(f" {text.lower()} ".encode(), np.uint8)
    total = np.zeros(DIM, np.int64)
    for s in range(0, len(raw) - 2, _BLOCK):
        b = _BLANK[raw[s : s + _BLOCK + 2]]
        code = ((b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]) * np.uint32(2654435761)
        total += np.bincount((code >> np.uint32(32 - _BITS))[b[1:-1] != 32], minlength=DIM)
    at = np.flatnonzero(total)
    return at, total[at]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m[0].isalpha() for m in _LETTER.finditer(text))


def pieces(text: str, shortest: int = 8) -> list[str]:
    """A piece of 8, 16, 32 ... characters of a text, each from a place of its own: what shorter texts look like."""
    at, size, out = zlib.crc32(text.encode()), shortest, []
    while size < len(text):
        start = at % (len(text) - size + 1)
        out.append(text[start : start + size])
        at, size = at * 69069 + 1 & 0xFFFFFFFF, 2 * size
    return out


def floors(near: np.ndarray, slots: np.ndarray, share: float = 0.3, quantile: float = 0.01) -> list[float]:
    """The least similarity that isn't rejected at 1, 2, 4 ... different trigrams; :func:`floor_at` is linear in between.

    ``share`` of the ``quantile`` of the similarities of texts with about as many trigrams; it never falls with the length. Where
    there are no such texts it lies on the line between its neighbours, above the longest it stays, below the
    shortest it goes down to 0.
    """
    knots, at = np.arange(_BITS + 1), np.log2(slots)
    close = [near[np.abs(at - k) <= 0.5] for k in knots]
    known = [(k, np.quantile(c, quantile)) for k, c in zip(knots, close, strict=True) if len(c)]
    low = np.interp(knots, *zip((-1, 0.0), *known, strict=True))
    return (share * np.minimum.accumulate(low[::-1])[::-1]).tolist()


def floor_at(knots: list[float], slots: int) -> float:
    return float(np.interp(np.log2(slots), np.arange(_BITS + 1), knots))


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray  # rows of length 1
    idf: np.ndarray
    floors: dict[str, list[float]]  # least similarity that is not rejected, at 1, 2, 4 ... different trigrams

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine with its nearest centroid, whether that is too far off."""
        if not self.languages or not has_letter(text):
            return "und", 0.0, True
        at, counts = gram_counts(text)
        weights = (1 + np.log(counts)) * self.idf[at]
        length = np.sqrt(weights @ weights)
        if not length:
            return "und", 0.0, True
        near = self.centroids[:, at] @ (weights / length)
        best = int(near.argmax())
        score = float(min(1.0, max(0.0, near[best])))
        return self.languages[best], score, score < floor_at(self.floors[self.languages[best]], len(at))


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from rows far from those chosen before."""
    chosen = [int((x @ x.mean(axis=0)).argmax())]
    near = x @ x[chosen[0]]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    centroids = x[chosen]
    for _ in range(rounds):
        own = (x @ centroids.T).argmax(axis=1)
        sums = np.stack([x[own == j].sum(axis=0) if (own == j).any() else centroids[j] for j in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400, clusters: int = 4, most_broadcast: int = 50_000) -> Model:
    """Learn from a bounded sample: of each language the ``per_language`` rows with the smallest hash of id and text.

    Rows without an id, a language or a letter teach nothing, equal rows teach once; an empty table gives a model that finds
    nothing. The sample's vectors stay on the executors: document frequencies are an aggregate and each language is
    clustered by its own task; only ``clusters`` centroids a language come back. The chosen rows' hashes, and the
    counts of the languages, are broadcast if they are no more than ``most_broadcast``, else joined by a shuffle. About a quarter
    of the sample stays out of the clustering; its texts and pieces of them show how near texts of that
    language and length lie. One that is much farther off is rejected, see :func:`floors`.
    """
    texts = train.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    texts = texts.select(F.shiftrightunsigned(F.xxhash64(id_col, text_col), 1).alias("h"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    narrow = cut(texts.select("lang", "h"))
    # of a language with many rows only those with a small hash are ranked: four times as many as wanted, on average
    likely = F.col("h") < F.least(F.lit(1.0), 4.0 * per_language / F.col("n")) * float(2**63)
    held = cut(narrow.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")))
    narrow = narrow.join(F.broadcast(held) if held.count() <= most_broadcast else held, "lang").filter(likely).select("lang", "h").distinct()
    order = Window.partitionBy("lang").orderBy("h")
    picked = cut(narrow.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= per_language).select("lang", "h"))
    few = picked.count() <= most_broadcast  # per_language rows a language: small unless languages are many
    sample = texts.join(F.broadcast(picked) if few else picked, ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The vector of each whole text (``part`` 0) and of its pieces."""
        for batch in by_bytes(batches, "text"):
            rows = [(h, lang, i, *gram_counts(t)) for h, lang, text in zip(*(batch.column(c).to_pylist() for c in ("h", "lang", "text")), strict=True) for i, t in enumerate([text, *pieces(text)])]
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["h", "lang", "part", "slots", "counts"])

    sample = cut(sample.select("h", "lang", "text").mapInArrow(vectors, "h long, lang string, part int, slots array<int>, counts array<int>"))
    whole = sample.filter("part = 0")
    n = whole.count()
    seen = np.zeros(DIM)
    for slot, count in whole.select(F.explode("slots").alias("slot")).groupBy("slot").count().collect():  # DIM rows at most
        seen[slot] = count
    idf = np.log((1 + n) / (1 + seen)) + 1

    def unit(slots: np.ndarray, counts: np.ndarray) -> np.ndarray:
        weights = (1 + np.log(counts)) * idf[slots]
        return weights / np.linalg.norm(weights)

    def cluster(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows.slots.map(len) > 0].sort_values(["h", "part"], kind="stable")
        if not len(rows):
            return pd.DataFrame({"lang": [], "centroid": [], "floors": []})
        out = (rows.h // 2 % 4 == 3).to_numpy()  # low bits: the smallest hashes are alike only in the high ones
        full = (rows.part == 0).to_numpy()
        if not (out & full).any() or not (~out & full).any():
            out[:] = False
        x = np.zeros(((full & ~out).sum(), DIM), np.float32)
        for i, r in enumerate(rows[full & ~out].itertuples()):
            x[i, r.slots] = unit(r.slots, r.counts)
        centroids = _kmeans(x, clusters)
        held = rows[out] if out.any() else rows
        near = np.array([(centroids[:, r.slots] @ unit(r.slots, r.counts)).max() for r in held.itertuples()])
        low = floors(near, held.slots.map(len).to_numpy())
        return pd.DataFrame({"lang": [rows.lang.iloc[0]] * len(centroids), "centroid": [c.tolist() for c in centroids], "floors": [low] * len(centroids)})

    found = sample.groupBy("lang").applyInPandas(cluster, "lang string, centroid array<float>, floors array<double>").collect()
    found.sort(key=lambda r: r.lang)  # stable: the centroids of a language keep their order
    return Model([r.lang for r in found], np.array([r.centroid for r in found]).reshape(len(found), DIM), idf, {r.lang: list(r.floors) for r in found})


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``lang_pred``, ``score`` and ``rejected`` of every row's whole text, besides its id and ``keep``; no shuffle.

    ``und``, 0 and rejected where the text is null or has no letter, or where nothing was learned. Repeated rows and ids are
    judged row by row, an empty table gives no rows. A ``keep`` column that has the name of a result is an error.
    """
    kept = list(dict.fromkeys([id_col, *(keep or [])]))
    if clash := {c.lower() for c in kept} & {"lang_pred", "score", "rejected"}:
        raise ValueError(f"columns to keep that have the name of a result: {sorted(clash)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text_col):
            rows = [model.predict(t) for t in batch.column(text_col).to_pylist()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.float64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], [*kept, "lang_pred", "score", "rejected"])

    head = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
    return df.select(*dict.fromkeys([*kept, text_col])).mapInArrow(run, f"{head}, lang_pred string, score double, rejected boolean")


def held_out(id_col: str = "doc_id"):
    """True for the quarter of the ids that a model never learns from."""
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2
