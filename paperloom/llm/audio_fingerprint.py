"""Chroma audio fingerprints and the alignment of recordings.

A frame of samples gives the energy of the twelve pitch classes. Sixteen filters compare rectangles of pitch
classes by frames, read from an integral image; each result is quantised to two bits, so a place in a recording
has an integer of 32 bits. Runs of equal integers are landmarks. Two recordings that share one are linked; they align
at the offset that most of their landmarks vote for, and the share of different bits over the passage that the votes
lie in says how well.

Every pair of a query and a recording that share a landmark is compared, however many hold it: a recording's best partner
is the best of all. Such pairs are no more than queries times recordings, and a landmark's holders are joined by shuffle, so a
landmark of many holders is work for many tasks. Groups need fewer links: of each landmark, every query's to one recording and every
recording's to one query connect what all pairs do.

All steps after the spectrum use integers, so equal recordings have equal fingerprints wherever they are computed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, cut, utf8_buffer
from .components import connected_components


@dataclass(frozen=True)
class Filter:
    """Compares two parts of a rectangle of ``width`` frames by ``height`` pitch classes from ``low`` on.

    kind 0: the whole against nothing; 1: lower and upper half; 2: first and second half in time; 3: the two
    diagonals of quarters; 4: the middle third of the classes against the rest; 5: the same in time.
    """

    kind: int
    low: int
    height: int
    width: int


#: By rule: the six comparisons over bands that move up the scale, with widths that cycle.
FILTERS = tuple(Filter((i + 1) % 6, (5 * i) % (13 - h), h, w) for i in range(16) for h, w in [((4, 6, 12, 3)[i % 4] if (i + 1) % 6 != 4 else (3, 6, 9, 12)[i % 4], (4, 8, 12, 6)[(i // 2) % 4] if (i + 1) % 6 != 5 else (3, 6, 9, 12)[i % 4])])
SPAN = max(f.width for f in FILTERS)


def _box(image: np.ndarray, n: int, t: int, w: int, low: int, h: int) -> np.ndarray:
    """Sums of the rectangles that begin at frame s + t for s = 0 .. n - 1."""
    return image[t + w : t + w + n, low + h] - image[t : t + n, low + h] - image[t + w : t + w + n, low] + image[t : t + n, low]


def _compare(f: Filter, image: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    whole = _box(image, n, 0, f.width, f.low, f.height)
    h, w = f.height // 2, f.width // 2
    if f.kind == 0:
        return whole, np.full(n, 255 * f.width * f.height // 6)
    if f.kind == 1:
        part = _box(image, n, 0, f.width, f.low, h)
    elif f.kind == 2:
        part = _box(image, n, 0, w, f.low, f.height)
    elif f.kind == 3:
        part = _box(image, n, 0, w, f.low, h) + _box(image, n, w, f.width - w, f.low + h, f.height - h)
    elif f.kind == 4:
        third = f.height // 3
        part = 2 * _box(image, n, 0, f.width, f.low + third, third)
        return part, whole - part // 2
    else:
        third = f.width // 3
        part = 2 * _box(image, n, third, third, f.low, f.height)
        return part, whole - part // 2
    return part, whole - part


def codes(chroma: np.ndarray, margin: int = 8) -> np.ndarray:
    """The 32-bit integers of the places of a row of chroma frames (frames x 12 small integers).

    A comparison gives 0 to 3 by whether the first part is below the second by over one ``margin``-th, below,
    above, or above by over one ``margin``-th; two bits, neighbours differing in one.
    """
    n = len(chroma) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(chroma) + 1, 13), np.int64)
    image[1:, 1:] = np.cumsum(np.cumsum(chroma, axis=0, dtype=np.int64), axis=1)
    out = np.zeros(n, np.uint32)
    for i, f in enumerate(FILTERS):
        a, b = _compare(f, image, n)
        level = (a * (margin + 1) > b * margin).astype(np.uint32) + (a > b) + (a * margin > b * (margin + 1))
        out |= (level ^ (level >> np.uint32(1))) << np.uint32(2 * i)
    return out


class Chroma:
    def __init__(self, rate: int, frame: int, hop: int, lowest: float = 55.0, highest: float = 3520.0):
        self.frame, self.hop = frame, hop
        self.window = np.hanning(frame)
        hertz = np.arange(frame // 2 + 1) * rate / frame
        self.classes = np.zeros((len(hertz), 12))
        used = np.flatnonzero((hertz >= lowest) & (hertz <= highest))
        self.classes[used, np.round(12 * np.log2(hertz[used] / 440.0)).astype(int) % 12] = 1.0

    def frames(self, samples: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Pitch-class energies, 0 to 255 by the loudest class, of the frames at ``starts``."""
        out = np.zeros((len(starts), 12), np.int64)
        views = sliding_window_view(samples, self.frame)
        for s in range(0, len(starts), 1024):
            x = views[starts[s : s + 1024]].astype(np.float64)
            power = np.abs(np.fft.rfft((x - x.mean(axis=1, keepdims=True)) * self.window, axis=1)) ** 2
            energy = np.sqrt(power @ self.classes)
            loudest = energy.max(axis=1, keepdims=True)
            out[s : s + 1024] = np.rint(255 * np.divide(energy, loudest, out=np.zeros_like(energy), where=loudest > 1e-6))
        return out


def fingerprints(df: DataFrame, id_col: str, audio_col: str, rate: int = 8000, frame: int = 512, hop: int = 128, sample_bytes: int = 1, least_codes: int = 0, phases: int = 1) -> DataFrame:
    """``(id, key, phase, codes)``: the integers of every whole recording; no shuffle.

    ``audio_col`` holds raw mono samples as binary: unsigned bytes (``sample_bytes`` 1) or signed 16-bit little-endian
    ones (2; a last odd byte is ignored). A recording that is null or empty has no codes. One that is too short for
    ``least_codes`` codes (0: for ``SPAN`` frames, and it has none) is looped until it has as many. ``key`` is a digest of
    the codes from the first sample on, and of the samples too if they were looped; it is null without codes. With ``phases`` p a
    recording has p rows, which begin at its samples 0, 1, ... p - 1. Repeated ids and rows give rows of their own, an
    empty table none; other columns are not carried.
    """
    chroma = Chroma(rate, frame, hop)
    kind = {1: np.uint8, 2: np.dtype("<i2")}[sample_bytes]
    least = SPAN + least_codes - 1 if least_codes else 0  # frames

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "audio", 1 << 20):
            data, offsets = utf8_buffer(batch.column("audio"))
            ids, keys, found = [], [], []
            for row, (s, e) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                samples, looped = data[s : e - (e - s) % sample_bytes].view(kind), b""
                if len(samples) and (len(samples) - frame) // hop + 1 < least:
                    looped = samples.tobytes()
                    samples = np.resize(samples, frame + (least - 1) * hop + phases - 1)
                counts = [max((len(samples) - p - frame) // hop + 1, 0) for p in range(phases)]
                ids += [row] * phases
                if counts[0] < SPAN:
                    found += [np.zeros(0, np.int32)] * phases
                    keys += [None] * phases
                    continue
                # all phases one after another; places that reach into the next phase are left out
                starts = np.concatenate([np.arange(n) * hop + p for p, n in enumerate(counts)])
                every, at = codes(chroma.frames(samples, starts)).view(np.int32), 0
                for n in counts:
                    found.append(every[at : at + max(n - SPAN + 1, 0)])
                    at += n
                keys += [xxhash.xxh3_128_digest(found[-phases].tobytes() + looped)] * phases
            columns = [batch.column("id").take(pa.array(ids, pa.int64())), pa.array(keys, pa.binary()), pa.array(list(range(phases)) * batch.num_rows, pa.int32()), pa.array(found, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "key", "phase", "codes"])

    id_type = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(audio_col).cast("binary").alias("audio")).mapInArrow(run, f"id {id_type}, key binary, phase int, codes array<int>")


def _landmarks(df: DataFrame, run: int) -> DataFrame:
    """``no, place, mark``: the hashes of ``run`` codes in a row; where a recording stands still, of the first place only.

    ``place`` holds the number of the first code above sixteen bits for the phase.
    """
    starts = F.sequence(F.lit(0), F.size("codes") - run)
    mark = lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice("codes", i + 1, run)).alias("mark"), F.when(i > 0, F.xxhash64(F.slice("codes", i, run))).alias("before"))
    found = df.filter(F.size("codes") >= run).select("no", "phase", F.inline(F.transform(starts, mark))).filter("before is null or before != mark")
    return found.select("no", (F.shiftleft(F.col("at").cast("long"), 16) + F.col("phase")).alias("place"), "mark")


def _passage(pairs: DataFrame, run: int, most_errors: float) -> DataFrame:
    """``votes, overlap, bit_error`` of rows with codes ``a`` and ``b`` at ``offset``, in place of the codes.

    Of the passages that begin wherever errors so far exceed ``most_errors``: the one with most landmarks.
    """
    a_from, b_from = F.greatest(-F.col("offset"), F.lit(0)), F.greatest("offset", F.lit(0))
    both = F.least(F.size("a") - a_from, F.size("b") - b_from)
    wrong = F.zip_with(F.slice("a", a_from + 1, both), F.slice("b", b_from + 1, both), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    limit = 32 * most_errors
    none = F.struct(F.lit(0).cast("long").alias("votes"), F.lit(0.0).alias("gain"), F.lit(0).alias("overlap"), F.lit(0).cast("long").alias("bits"))
    start = F.struct(F.lit(0).alias("same"), none.alias("now"), none.alias("best"))

    def follow(s: Column, x: Column) -> Column:
        """The passage that ends here (``gain``: bits short of the limit) and the best so far."""
        same = F.when(x == 0, s["same"] + 1).otherwise(0)
        old = F.when(s["now"]["gain"] > 0, s["now"]).otherwise(none)
        now = F.struct((old["votes"] + (same >= run).cast("long")).alias("votes"), (old["gain"] + limit - x).alias("gain"), (old["overlap"] + 1).alias("overlap"), (old["bits"] + x).alias("bits"))
        return F.struct(same.alias("same"), now.alias("now"), F.greatest(s["best"], now).alias("best"))

    kept = [c for c in pairs.columns if c not in ("a", "b")]
    best = pairs.select(*kept, F.aggregate(wrong, start, follow)["best"].alias("h"))
    return best.select(*kept, "h.votes", "h.overlap", (F.col("h.bits") / (32 * F.col("h.overlap"))).alias("bit_error"))


def shared_landmarks(prints: DataFrame, shifted: DataFrame, run: int = 3) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """``recordings`` and ``queries`` (by number, with their codes), the landmarks that link (each with its first query and recording), and the places of these in queries and in recordings."""
    reps = prints.filter("key is not null").groupBy("key").agg(F.min("codes").alias("codes"))  # equal keys, equal codes
    reps = cut(reps.orderBy("key").select("key", F.monotonically_increasing_id().alias("no"), F.lit(0).alias("phase"), "codes"))
    heard = shifted.filter("key is not null").groupBy("key", "phase").agg(F.min(F.struct("id", "codes"))["codes"].alias("codes"))
    heard = cut(heard.join(reps.select("key", "no"), "key").select("no", "phase", "codes"))
    one, two = _landmarks(heard, run), _landmarks(reps, run)
    none = F.lit(None).cast("long")
    holders = one.select("mark", F.col("no").alias("q"), none.alias("m")).union(two.select("mark", none.alias("q"), F.col("no").alias("m")))
    hubs = holders.groupBy("mark").agg(F.min("q").alias("q"), F.max("q").alias("q_top"), F.min("m").alias("m"), F.max("m").alias("m_top"))
    # one recording alone links nothing
    hubs = cut(hubs.filter("q is not null and m is not null and (q != m or q != q_top or m != m_top)").select("mark", "q", "m"))
    return reps, heard, hubs, cut(one.join(hubs.select("mark"), "mark")), cut(two.join(hubs.select("mark"), "mark"))


def _alignments(one: DataFrame, two: DataFrame) -> DataFrame:
    """``q, m, phase, offset``: of every query and other recording that share a landmark, where most of their landmarks vote for.

    ``one`` and ``two`` hold the places of the landmarks that link. Where a tone stands still, a query's landmark has the same first
    place at many phases: these are one row, with the phases it spans, and the votes at a phase are the sum of what begins
    and ends up to it. They are most where a span begins. Recordings with the same landmarks at the same places are one profile, voted for once.
    """
    at, phase = F.shiftright("place", 16), F.col("place").bitwiseAND(0xFFFF).cast("int")
    asked = one.groupBy("mark", F.col("no").alias("q"), phase.alias("phase")).agg(F.min(at).alias("from"))
    nth = F.row_number().over(Window.partitionBy("mark", "q", "from").orderBy("phase"))
    spans = asked.withColumn("span", F.col("phase") - nth).groupBy("mark", "q", "from", "span").agg(F.min("phase").alias("begin"), (F.max("phase") + 1).alias("end"))
    held = cut(two.groupBy(F.col("no").alias("m")).agg(F.sort_array(F.collect_list(F.struct(at.alias("to"), "mark"))).alias("places")))
    profiles = cut(held.groupBy("places").agg(F.min("m").alias("p"), F.count("*").alias("members")))
    held = held.join(profiles, "places").select("p", "m")
    voted = spans.join(profiles.select("p", "members", F.inline("places")), "mark").filter("q != p or members > 1")
    voted = voted.select("q", "p", (F.col("to") - F.col("from")).alias("offset"), "begin", "end").repartition("q", "p")  # once for all three steps by pair
    edges = F.array(F.struct(F.col("begin").alias("phase"), F.lit(1).alias("more")), F.struct(F.col("end").alias("phase"), F.lit(-1).alias("more")))
    edges = voted.select("q", "p", "offset", F.inline(edges)).groupBy("q", "p", "offset", "phase").agg(F.sum("more").alias("more"))
    votes = edges.withColumn("n", F.sum("more").over(Window.partitionBy("q", "p", "offset").orderBy("phase")))
    best = F.struct(F.col("n"), -F.abs("offset"), -F.col("offset"), -F.col("phase"))
    best = votes.groupBy("q", "p").agg(F.max_by(F.struct("phase", F.col("offset").cast("int").alias("offset")), best).alias("r"))
    return best.join(held, "p").filter("q != m").select("q", "m", "r.*")


def links(prints: DataFrame, shifted: DataFrame, hop: int = 128, run: int = 3, most_errors: float = 0.35) -> tuple[DataFrame, DataFrame]:
    """``q, m, shift, votes, overlap, bit_error``: all pairs of keys of queries (``shifted``) and of other recordings (``prints``) that share
    a landmark of ``run`` codes; and ``q, m``: some of those pairs, with the same components.

    Queries must be among the recordings. The offset is the one that most of the pair's landmarks vote for, ties to the smallest
    size of the offset, the negative and the smallest phase; a landmark counts at its first place in the query at a phase and at
    all places in the recording. ``shift`` is the place in the recording less that in the query, in samples. ``overlap`` and ``bit_error`` are
    the codes and the share of different bits of a passage there: of those that begin wherever errors so far exceed
    ``most_errors``, the one with most landmarks (``votes``).
    """
    reps, heard, hubs, one, two = shared_landmarks(prints, shifted, run)
    few = two.join(hubs, "mark").select("q", F.col("no").alias("m")).union(one.join(hubs, "mark").select(F.col("no").alias("q"), "m")).filter("q != m").distinct()
    pairs = cut(_alignments(one, two))
    pairs = pairs.join(reps.select(F.col("no").alias("m"), F.col("key").alias("m_key"), F.col("codes").alias("b")), "m")
    pairs = pairs.join(heard.select(F.col("no").alias("q"), "phase", F.col("codes").alias("a")), ["q", "phase"])
    pairs = _passage(pairs, run, most_errors).join(reps.select(F.col("no").alias("q"), F.col("key").alias("q_key")), "q")
    pairs = pairs.select(F.col("q_key").alias("q"), F.col("m_key").alias("m"), (hop * F.col("offset") - F.col("phase")).cast("long").alias("shift"), "votes", "overlap", "bit_error")
    few = few.join(reps.select(F.col("no").alias("q"), F.col("key").alias("q_key")), "q").join(reps.select(F.col("no").alias("m"), F.col("key").alias("m_key")), "m")
    return pairs, few.select(F.col("q_key").alias("q"), F.col("m_key").alias("m"))


def align(prints: DataFrame, is_query: Column, shifted: DataFrame | None = None, hop: int = 128, run: int = 3, most_errors: float = 0.35) -> DataFrame:
    """``id, is_query, class_id, group_id, partner_id, shift, votes, overlap, bit_error``: a row for every recording.

    ``prints`` has a row a recording (phase 0), ``shifted`` the queries' rows at their phases (all of a hop's samples to find
    every shift); without it they are those of ``prints``. Recordings with one key are a class, named by its smallest id.
    ``group_id`` is the smallest id of the recordings that links connect, the own one included: each query to all recordings
    that share a landmark with it, see :func:`links`. ``partner_id`` names the class at the best of all of the class's links
    (most votes, then least bit error, then the smallest id), and the rest says how they align: ``shift`` is the place in
    the partner less that here, in samples. Without a link these are null. A recording without codes is alone. Null ids take part
    but name nothing unless all are null; repeated ids give a row each. An empty table gives no rows.
    """
    rows = cut(prints.select("id", "key", is_query.alias("is_query"), "codes"))
    heard = shifted if shifted is not None else prints.filter(is_query)
    found, few = links(rows, heard, hop, run, most_errors)
    classes = cut(rows.filter("key is not null").groupBy("key").agg(F.min("id").alias("class_id")))
    groups = connected_components(few.select(F.col("q").alias("a"), F.col("m").alias("b")))
    named = groups.join(classes, groups.node == classes.key)
    least = cut(named.groupBy("component").agg(F.min("class_id").alias("group_id")))
    named = named.join(least, "component").select("key", "group_id")
    found = cut(found)
    both = found.unionByName(found.select(F.col("m").alias("q"), F.col("q").alias("m"), (-F.col("shift")).alias("shift"), "votes", "overlap", "bit_error"))
    both = both.join(classes.select(F.col("key").alias("m"), F.col("class_id").alias("partner_id")), "m")
    how = ["partner_id", "shift", "votes", "overlap", "bit_error"]
    best = both.groupBy("q").agg(F.max_by(F.struct(*how), F.struct("votes", -F.col("bit_error"), -F.col("partner_id"), "shift")).alias("r")).select(F.col("q").alias("key"), "r.*")
    classes = cut(classes.join(named, "key", "left").join(best, "key", "left").select("key", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), *how))
    out = rows.select("id", "is_query", "key").join(classes, "key", "left")
    return out.select("id", "is_query", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("group_id", "id").alias("group_id"), *how)
