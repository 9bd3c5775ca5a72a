"""Licence scan: Aho-Corasick for notices and identifier tags, a shunting-yard parser for expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_bytes, utf8_buffer

#: Phrases that the contract fixes.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further notices and the labels they give.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit-text",
    "redistribution and use in source and binary forms": "bsd-text",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0": "cc0",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
#: Identifier tags, lower case.
TAGS = ("spdx-license-identifier:",)
#: Identifiers (lower case) whose terms allow use without copyleft or field-of-use limits.
PERMISSIVE = frozenset("mit mit-0 apache-2.0 apache-1.1 bsd-2-clause bsd-3-clause 0bsd isc zlib unlicense cc0-1.0 cc-by-4.0 bsl-1.0 python-2.0 postgresql".split())
#: Other public SPDX identifiers (lower case) in common use; with the permissive ones, those that count as known.
OTHER_KNOWN = frozenset(
    """
    afl-3.0 agpl-3.0 agpl-3.0-only agpl-3.0-or-later apache-1.0 artistic-1.0 artistic-2.0 blueoak-1.0.0 bsd-1-clause bsd-2-clause-patent
    bsd-3-clause-clear bsd-4-clause cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-nc-3.0 cc-by-nc-4.0 cc-by-nc-nd-4.0 cc-by-nc-sa-4.0 cc-by-nd-4.0
    cc-by-sa-3.0 cc-by-sa-4.0 cddl-1.0 cddl-1.1 cecill-2.1 cpl-1.0 ecl-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 gfdl-1.3 gfdl-1.3-only gfdl-1.3-or-later
    gpl-1.0-only gpl-1.0-or-later gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only gpl-3.0-or-later ijg json lgpl-2.0-only lgpl-2.0-or-later
    lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later libpng libtiff lpl-1.02 mpl-1.0 mpl-1.1 mpl-2.0 ms-pl ms-rl mulanpsl-2.0
    ncsa odbl-1.0 ofl-1.1 openssl osl-3.0 php-3.01 psf-2.0 ruby sleepycat sspl-1.0 tcl unicode-dfs-2016 upl-1.0 vim w3c wtfpl x11 zpl-2.1
    """.split()
)

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_TOKEN = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
_RANK = {"or": 1, "and": 2, "with": 3}


@cache
def _automaton(base: tuple, notices: tuple) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    kinds: dict[str, list] = {}
    for phrase, label in base:
        kinds.setdefault(phrase, []).append((True, label))
    for phrase, label in notices:
        kinds.setdefault(phrase, []).append((False, label))
    for phrase, what in kinds.items():
        found.add_word(f" {phrase} ", (len(phrase) + 2, what))
    found.make_automaton()
    return found


@cache
def _tags() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for tag in TAGS:
        found.add_word(tag, len(tag))
    found.make_automaton()
    return found


def leading_expression(text: str, at: int = 0, stop: int | None = None) -> str:
    """What stands at ``at``, before ``stop``, up to the first token of the line that cannot continue an expression.

    A full stop, colon or hyphen that ends a word ends the expression and is left out. What is read may still
    be incomplete, as after ``MIT or``.
    """
    start = end = at
    stop = len(text) if stop is None else stop
    depth, operand, after_with = 0, True, False
    while m := _TOKEN.match(text, end, stop):
        token = m[1]
        word = token.lower()
        if token == "(":
            fits = operand and not after_with
            depth += fits
        elif token == ")":
            fits = not operand and depth > 0
            depth -= fits
        elif word in _RANK:
            fits, after_with = not operand, word == "with"
            operand = True
        else:
            fits, operand, after_with = operand, False, False
            token = token.rstrip(".:-")
        if not fits:
            break
        end = m.start(1) + len(token)
        if end < m.end():
            break
    return text[start:end].strip()


def is_known(identifier: str) -> bool:
    """A listed identifier, with or without ``+``, or a reference to a licence defined elsewhere."""
    plain = identifier.removesuffix("+")
    return plain in PERMISSIVE or plain in OTHER_KNOWN or plain.startswith(("licenseref-", "documentref-"))


def tag_expressions(text: bytes) -> list[str]:
    """The well-formed expressions after the identifier tags of a text, in order; a tag must not continue a word."""
    raw = text.decode()
    places = [(end - length + 1, end + 1) for end, length in _tags().iter(text.translate(_LOWER).decode())]
    places = [(b, e) for b, e in places if not b or not (raw[b - 1].isalnum() or raw[b - 1] in "_-")]
    stops = [*(b for b, _ in places[1:]), len(raw)]
    found = [leading_expression(raw, e, stop) for (_, e), stop in zip(places, stops, strict=False)]
    return [x for x in found if to_postfix(x)]


def to_postfix(expression: str) -> list[str] | None:
    """The expression's identifiers and operators in postfix order; None if it is not well formed.

    ``with`` binds before ``and``, ``and`` before ``or``; all are left-associative and may have any case.
    The whole string must be the expression; :func:`leading_expression` cuts it out of a line.
    """
    out: list[str] = []
    waiting: list[str] = []
    at, operand = 0, True  # operand: an identifier or an opening bracket comes next
    expression = expression.strip()
    while at < len(expression):
        m = _TOKEN.match(expression, at)
        if not m:
            return None
        token, at = m[1], m.end()
        word = token.lower()
        if token == "(":
            if not operand:
                return None
            waiting.append(token)
        elif token == ")":
            if operand:
                return None
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        elif word in _RANK:
            if operand:
                return None
            while waiting and _RANK.get(waiting[-1], 0) >= _RANK[word]:
                out.append(waiting.pop())
            waiting.append(word)
            operand = True
        else:
            if not operand:
                return None
            out.append(word)
            operand = False
    if operand or "(" in waiting:
        return None
    return out + waiting[::-1]


def evaluate(postfix: list[str], permissive: frozenset[str] = PERMISSIVE) -> tuple[bool, list[str]]:
    """Whether some choice of the expression is permissive throughout, and its licence identifiers.

    An exception after ``with`` only widens what its licence grants, so it changes no verdict and is no label.
    """
    stack: list[tuple[bool, list[str]]] = []
    for token in postfix:
        if token in _RANK:
            (b, names_b), (a, names_a) = stack.pop(), stack.pop()
            stack.append((a, names_a) if token == "with" else (a and b if token == "and" else a or b, names_a + names_b))
        else:
            stack.append((token in permissive, [token]))
    return stack[0]


def scan_text(text: bytes, automaton: ahocorasick.Automaton) -> tuple:
    """n_words, n_base, first_word, last_word, base labels, labels, score, expressions, permissive."""
    words = text.translate(_WORDS).split()
    joined = f" {b' '.join(words).decode()} "
    starts, base, more = [], set(), set()
    for end, (length, what) in automaton.iter(joined):
        for is_base, label in what:
            if is_base:
                starts.append(end - length + 1)
                base.add(label)
            else:
                more.add(label)
    first = last = None
    if starts:
        first = joined.count(" ", 0, min(starts))
        last = joined.count(" ", 0, max(starts))
    expressions, verdicts, known, unknown = [], [], 0, set()
    for expression in tag_expressions(text):
        good, names = evaluate(to_postfix(expression))
        expressions.append(" ".join(expression.split()))
        verdicts.append(good)
        odd = {x for x in names if not is_known(x)}
        known += not odd
        unknown |= odd
        more.update(f"spdx:{x}" for x in names if x not in odd)
    evidence = 2 * len(base) + 3 * known + len(more)
    more.update(f"spdx-unknown:{x}" for x in unknown)
    return len(words), len(starts), first, last, sorted(base), sorted(base | more), 1.0 - 0.5**evidence, expressions, all(verdicts) if verdicts else None


_SCHEMA = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>, labels array<string>, score double, expressions array<string>, permissive boolean"


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """What every row's whole text says about its licence; no shuffle.

    A-Z is lower-cased and words are runs of digits, a-z and characters beyond ASCII. ``base`` maps phrases to
    labels: ``n_base`` counts all places (also overlapping ones) where the words of one stand consecutively,
    ``first_word`` and ``last_word`` are the smallest and largest start (null without a place). ``notices`` adds
    labels; ``SPDX-License-Identifier:`` tags, found in the raw text, add labels from the expression that follows on their line
    up to the first token that cannot continue it, if it is well formed: ``spdx:`` for known identifiers, ``spdx-unknown:`` for
    others, which are not permissive and no evidence. ``permissive`` tells whether all expressions allow a permissive choice
    (null without one). ``score`` is 1 - 0.5 ** evidence: two a base label, three an expression of known identifiers, one any other
    known label. A null text counts as empty: no words, no labels, score 0. A row a row of ``df``, repeated rows and ids
    and null ids included; an empty table gives none; other columns are not carried.
    """
    base = BASE_PHRASES if base is None else base
    notices = NOTICES if notices is None else notices
    keys = tuple(sorted(base.items())), tuple(sorted(notices.items()))
    kinds = [pa.int64()] * 4 + [pa.list_(pa.string())] * 2 + [pa.float64(), pa.list_(pa.string()), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(*keys)
        for batch in by_bytes(batches, text_col):
            data, offsets = utf8_buffer(batch.column(text_col))
            raw = data.tobytes()
            rows = [scan_text(raw[s:e], automaton) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *columns], [id_col, *(x.split()[0] for x in _SCHEMA.split(", "))])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, {_SCHEMA}")
