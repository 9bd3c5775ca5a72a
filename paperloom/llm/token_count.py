"""Token counts of whole texts, encoded in batches inside Arrow functions that return lengths only."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import by_bytes, utf8_buffer

#: A single space after which a text may be cut: what stands before it is neither a space nor the library's
#: own sign for one, and the run of spaces does not end the text.
_SAFE = re.compile("(?<=[^ ▁]) (?= *[^ ])")
_ODD = re.compile("  |^ | $|▁", re.ASCII)


@cache
def _processor(model: str) -> tuple[sentencepiece.SentencePieceProcessor, bool]:
    """The model, and whether its texts can be cut at spaces: it puts a space before every text and no piece
    has a space after another character, so no merge reaches across a cut."""
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    inner = any(re.search("[^▁]▁", sp.id_to_piece(i)) for i in range(sp.get_piece_size()))
    prefix = sp.encode("a", out_type=str)[:1] in (["▁a"], ["▁"])
    spaces = len(sp.encode("a  b")) > len(sp.encode("a b")) and sp.encode("a b") == sp.encode("a") + sp.encode("b")
    return sp, not inner and prefix and spaces


def cut_safely(text: str) -> list[str]:
    """Parts whose token counts add up to the text's; each but the first lost the space that leads it."""
    return _SAFE.split(text) if _ODD.search(text) else text.split(" ")


def token_counts(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 4 << 20, memo: int = 400_000) -> DataFrame:
    """``(id_col, n_bytes, n_tokens)`` of every row's whole text; no shuffle.

    ``model`` is the path of a sentencepiece model, at the same place on every executor. Counts are those of
    the library without begin, end or added special tokens. Record batches are cut to about ``batch_bytes`` of
    text; texts are cut at safe boundaries and each different part of a batch is encoded once. A task remembers
    the lengths of up to ``memo`` parts. A null text counts as empty: 0 bytes, 0 tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, cuttable = _processor(model)
        known: dict[str, int] = {"": 0}
        for batch in by_bytes(batches, text_col, batch_bytes):
            texts = batch.column(text_col)
            sizes = np.diff(utf8_buffer(texts)[1])
            parts = [cut_safely(t) if cuttable else [t] for t in (x or "" for x in texts.to_pylist())]
            if len(known) > memo:
                known = {"": 0}
            new = list(set().union(*parts) - known.keys())
            for i in range(0, len(new), 20_000):
                known.update(zip(new[i : i + 20_000], map(len, sp.encode(new[i : i + 20_000], num_threads=1)), strict=True))
            counts = [sum(map(known.__getitem__, p)) for p in parts]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], [id_col, "n_bytes", "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint")
