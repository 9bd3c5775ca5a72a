"""Glyphs to tokens: islands of a run's glyphs, their bounds, font and text with superscripts marked.

A row is a run, the glyphs that a page draws with one call: ``glyphs`` is an array of ``char, x, y, width, height, font, size,
space``. ``y`` is the lower edge and grows downwards, ``space`` is the width of a blank. All glyphs of a batch of runs are
looked at together, a step a property, so work grows with glyphs however long a run is: no shuffle.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .mentions import NUMBERS, SUPER, UNSUPER

GLYPH = "struct<char: string, x: double, y: double, width: double, height: double, font: string, size: double, space: double>"
#: What a run of raised glyphs must be as a whole to stay.
RAISED = rf"{NUMBERS}|\[{NUMBERS}\]|\({NUMBERS}\)"
#: Sizes above are taken for tenths.
LARGEST = 45.0
_OPEN, _CLOSE = "\x02", "\x03"


def _single() -> tuple[str, str]:
    """Characters of the basic plane whose compatibility form is one other character, and these forms."""
    pairs = [(chr(i), unicodedata.normalize("NFKC", chr(i))) for i in range(0x80, 0x10000) if not 0xD800 <= i < 0xE000]
    pairs = [(c, to) for c, to in pairs if c != to and len(to) == 1]
    return "".join(c for c, _ in pairs), "".join(to for _, to in pairs)


def compatible(text: Column) -> Column:
    """Compatibility forms (NFKC) of characters that have a single one, and Latin ligatures apart.

    Fractions and other signs with longer forms stay, and letters and combining marks aren't composed.
    """
    out = F.translate(text, *_single())
    for ligature in map(chr, range(0xFB00, 0xFB07)):
        out = F.replace(out, F.lit(ligature), F.lit(unicodedata.normalize("NFKC", ligature)))
    return F.when(text.rlike(r"[^\x00-\x7F]"), out).otherwise(text)


def _le(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a <= b`` where NaN is the largest number, as in Spark."""
    return (a <= b) | np.isnan(b)


def _lt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a < b) | (np.isnan(b) & ~np.isnan(a))


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values (NaN for null) and which of them are there."""
    return column.to_numpy(zero_copy_only=False).astype(np.float64), ~column.is_null().to_numpy(zero_copy_only=False)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows (nulls are empty)."""
    column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]), offsets - offsets[0]


def _bounds(value: tuple[np.ndarray, np.ndarray], at: np.ndarray, high: bool) -> tuple[np.ndarray, np.ndarray]:
    """Least or largest value of the glyphs of each token (``at``: its first glyph), and which tokens have none."""
    number, there = value
    found = np.maximum.reduceat(np.where(there, number, -np.inf), at) if high else np.fmin.reduceat(np.where(there, number, np.nan), at)
    none = np.add.reduceat(there.astype(np.int64), at) == 0
    return np.where(none, np.nan, found), none


def _tokens(run: np.ndarray, glyphs: pa.StructArray) -> tuple[np.ndarray, list[pa.Array]] | None:
    """The run of each token, and ``n``, its text with raised islands marked, bounds and the first glyph's font, size and blank.

    A run is cut at blank glyphs and where ``x`` falls below that of the glyph before. A glyph at or left of 0 says nothing
    about what follows it; null characters are blank. A glyph is raised if its lower edge is at most at mid-height, but no
    more than a sixth of the height above it.
    """
    field = {name: pc.struct_field(glyphs, name) for name in ("char", "x", "y", "width", "height", "font", "size", "space")}
    char = field["char"]
    for sign in (_OPEN, _CLOSE):
        char = pc.replace_substring(char, sign, "")
    data, offsets = _bytes(char)
    inked = np.concatenate([[0], np.cumsum(data > 0x20)])
    blank = inked[offsets[1:]] == inked[offsets[:-1]]
    x, x_there = _numbers(field["x"])
    follows = np.concatenate([[False], run[1:] == run[:-1]])
    back = np.concatenate([[False], _lt(np.zeros(len(x) - 1), x[:-1]) & _lt(x[1:], x[:-1]) & x_there[1:] & x_there[:-1]])
    starts = ~blank & (~follows | back | np.concatenate([[True], blank[:-1]]))
    used = np.flatnonzero(~blank)
    if not len(used):
        return None
    at = np.flatnonzero(starts[used])
    first = used[at]
    token = np.cumsum(starts[used]) - 1

    picked = {name: tuple(v[used] for v in _numbers(field[name])) for name in ("x", "y", "width", "height")}
    both = lambda a, b, f: (f(picked[a][0], picked[b][0]), picked[a][1] & picked[b][1])
    bounds = [_bounds(picked["x"], at, False), _bounds(both("y", "height", np.subtract), at, False), _bounds(both("x", "width", np.add), at, True), _bounds(picked["y"], at, True)]
    (y0, _), (y1, _) = bounds[1], bounds[3]
    middle, y = ((y0 + y1) / 2)[token], picked["y"][0]
    up = _le(y, middle) & _le(middle - y, ((y1 - y0) / 6)[token]) & picked["y"][1] & ~(bounds[1][1] | bounds[3][1])[token]

    same = np.concatenate([[False], token[1:] == token[:-1]])
    opens = up & ~(same & np.concatenate([[False], up[:-1]]))
    closes = up & ~np.concatenate([same[1:] & up[1:], [False]])
    length = np.diff(offsets)[used]
    end = np.cumsum(length + opens + closes)
    begin = end - length - opens - closes
    text = np.empty(end[-1], np.uint8)
    text[begin[opens]] = ord(_OPEN)
    text[end[closes] - 1] = ord(_CLOSE)
    within = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    text[np.repeat(begin + opens, length) + within] = data[np.repeat(offsets[used], length) + within]
    cuts = np.concatenate([begin[at], end[-1:]])
    texts = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(text)).cast(pa.string())

    owner = run[first]
    new = np.concatenate([[True], owner[1:] != owner[:-1]])
    place = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    out = [pa.array(place.astype(np.int32)), texts, *[pa.array(v, pa.float64(), mask=none) for v, none in bounds]]
    return owner, out + [field[name].take(pa.array(first)) for name in ("font", "size", "space")]


def tokens(runs: DataFrame, *keys: str, glyphs_col: str = "glyphs") -> DataFrame:
    """``keys, n, token, x0, y0, x1, y1, font, size``: a row a token of a run, numbered from 0.

    Bounds are those of all glyphs of the token, font and size those of its first: sizes over 45 are divided by ten and the
    font's name ends with size and width of a blank, so that sizes have names of their own. A run of raised glyphs stays
    between superscript signs if it is a mention as a whole, else it is left out. A token of which superscripts
    alone were left out has an empty text, as its bounds still count. Runs that are null, empty or blank have no tokens;
    repeated rows give tokens each.
    """
    rows = runs.select(*keys, F.col(glyphs_col).cast(f"array<{GLYPH}>").alias("__glyphs"))
    key_types = [rows.schema[k] for k in keys]
    made = StructType(key_types).add("n", "integer").add("__text", "string")
    for name in ("x0", "y0", "x1", "y1"):
        made = made.add(name, "double")
    made = made.add("__font", "string").add("__size", "double").add("__space", "double")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("__glyphs")
            length = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
            found = _tokens(np.repeat(np.arange(batch.num_rows), length), lists.flatten()) if length.sum() else None
            if found is not None:
                owner, columns = found
                yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(owner)) for k in keys] + columns, made.names)

    found = rows.mapInArrow(scan, made)
    size = F.when(F.col("__size") > LARGEST, F.col("__size") / 10).otherwise(F.col("__size"))
    kept = F.regexp_replace("__text", f"{_OPEN}({RAISED}){_CLOSE}", f"{SUPER}$1{UNSUPER}")
    token = F.regexp_replace(kept, f"{_OPEN}[^{_CLOSE}]*{_CLOSE}", "")
    # most texts hold no raised glyphs
    found = found.withColumn("size", size).withColumn("token", F.when(F.col("__text").contains(_OPEN), token).otherwise(F.col("__text")))
    name = F.concat_ws("_", F.coalesce("__font", F.lit("unknown")), F.col("size").cast("string"), F.col("__space").cast("string"))
    return found.select(*keys, "n", compatible(F.col("token")).alias("token"), "x0", "y0", "x1", "y1", name.alias("font"), "size")
