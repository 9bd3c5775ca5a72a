"""Tagged references to label sequences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The label of each tag in the three ways of tagging references.
SCHEMES: dict[str, dict[str, str]] = {
    "umass": {
        "address": "address", "authors": "A", "booktitle": "V", "editor": "editor", "institution": "institution", "journal": "V", "pages": "pages", "publisher": "publisher",
        "tech": "tech", "thesis": "V", "title": "T", "volume": "volume", "year": "Y",
    },
    "cora": {
        "author": "A", "booktitle": "V", "date": "Y", "editor": "editor", "institution": "institution", "journal": "V", "location": "location", "note": "note", "pages": "pages",
        "publisher": "publisher", "tech": "V", "title": "T", "volume": "volume",
    },
    "kermit": {
        "author": "A", "booktitle": "V", "date": "Y", "editor": "editor", "note": "note", "pages": "pages", "publisher": "publisher", "pubPlace": "location", "title": "T", "volume": "volume",
    },
}
#: Tags whose label depends on an attribute, as ``tag attribute value``.
BY_ATTRIBUTE = {"title level j": "V", "title level m": "V", "title level a": "T", "biblScope type vol": "volume", "biblScope type pp": "pages"}

_TAG = re.compile(r"<(/?)([A-Za-z][\w-]*)((?:\s[^<>]*)?)>")
_ATTRIBUTE = re.compile(r'([\w-]+)="([^"]*)"')


def _label(scheme: str, tag: str, attributes: str) -> str | None:
    for name, value in _ATTRIBUTE.findall(attributes) if scheme == "kermit" else ():
        if f"{tag} {name} {value}" in BY_ATTRIBUTE:
            return BY_ATTRIBUTE[f"{tag} {name} {value}"]
    return SCHEMES[scheme].get(tag)


def _events(line: str, scheme: str) -> Iterator[tuple[str, str]]:
    """The words of a line, each with the number and label of the innermost element that has a label; one pass, a stack of open tags."""
    stack: list[tuple[str, str]] = []  # an open tag, and what its words get
    at, n = 0, 0
    for m in [*_TAG.finditer(line), None]:
        inner = next((held for _, held in reversed(stack) if held), "")
        yield from ((word, inner) for word in line[at : m.start() if m else len(line)].split() if not word.endswith(">"))
        if m is None:
            return
        at, (close, tag, attributes) = m.end(), m.groups()
        if not close:
            n += 1
            label = _label(scheme, tag, attributes)
            stack.append((tag, f"{n} {label}" if label else ""))
        elif any(tag == open_tag for open_tag, _ in stack):  # what was left open inside ends with it
            while stack.pop()[0] != tag:
                pass


def label_line(line: str | None, scheme: str) -> list[dict[str, str]]:
    if scheme == "umass":
        line = re.sub(r"<ref-marker>.*?</ref-marker>", " ", line or "")
    words = list(_events(line or "", scheme))
    first, last = {}, {}
    for i, (_, held) in enumerate(words):
        first.setdefault(held, i)
        last[held] = i
    out = [{"token": "<S>", "label": "<S>"}]
    for i, (word, held) in enumerate(words):
        kind = {(True, True): "W_", (True, False): "B_", (False, True): "E_", (False, False): "I_"}[first[held] == i, last[held] == i]
        out.append({"token": word, "label": kind + held.split(" ", 1)[1] if held else "O"})
    return [*out, {"token": "</S>", "label": "</S>"}]


def labelled_line(line: Column, scheme: str) -> Column:
    """Array of ``token, label`` of a tagged reference, from ``<S>`` to ``</S>``; null counts as empty.

    A word gets the label of the innermost open tag that has one, else O: B for the element's first word, E for its last, W if
    it is the only one, else I, wherever nested tags end. A closing tag ends what is open up to its opening one, and is ignored if
    there is none. Words that end in ``>`` and aren't tags are dropped. Schemes: ``umass``, ``cora``, ``kermit``.
    """

    @F.pandas_udf("array<struct<token:string,label:string>>")
    def run(lines: pd.Series) -> pd.Series:
        return pd.Series([label_line(x, scheme) for x in lines])

    return run(line)
