"""String functions on columns: normalisers, keys, cleaners, finders. All stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _accent_table() -> tuple[str, str]:
    """Letters that are one letter with combining marks, and that letter."""
    pairs = []
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if base != c and len(base) == 1:
            pairs.append((c, base))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


_ACCENTED, _PLAIN = _accent_table()
#: Typographic signs and the plain ones they stand for; soft hyphen and zero-width characters vanish.
_FANCY = {"‘": "'", "’": "'", "“": '"', "”": '"', "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", " ": " ", " ": " ", " ": " ", " ": " ", "ı": "i"}
_VANISH = "­​‌‍﻿"
_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}


def remove_diacritics(c: Column | str) -> Column:
    return F.regexp_replace(F.translate(col(c), _ACCENTED, _PLAIN), r"\p{Mn}+", "")


def normalize_characters(c: Column | str) -> Column:
    """Plain quotes, dashes, spaces and ligatures; no control characters but newline; dotless i as i."""
    c = F.translate(col(c), "".join(_FANCY) + _VANISH, "".join(_FANCY.values()))
    for sign, plain in _LIGATURES.items():
        c = F.replace(c, F.lit(sign), F.lit(plain))
    return F.regexp_replace(c, r"[\x00-\x09\x0B-\x1F\x7F]", "")


def single_line(c: Column | str) -> Column:
    return F.replace(F.replace(col(c), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def implode_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, " +", " "))


def normalize(c: Column | str) -> Column:
    """Lower case, no diacritics, punctuation as blanks, single blanks."""
    return implode_spaces(F.regexp_replace(remove_diacritics(F.lower(col(c))), r"\p{P}", " "))


def alnum_normalize(c: Column | str) -> Column:
    return implode_spaces(F.regexp_replace(remove_diacritics(F.lower(col(c))), "[^A-Za-z0-9]", " "))


def alnum_normalize_no_spaces(c: Column | str) -> Column:
    return F.regexp_replace(remove_diacritics(F.lower(col(c))), "[^A-Za-z0-9]", "")


def strict_normalize(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(col(c)), "[^a-z]", "")


def mention_normalize(c: Column | str) -> Column:
    """Keep a-z and 0-9 of each part between bars."""
    return F.array_join(F.transform(F.split(F.lower(col(c)), r"\|"), lambda p: F.regexp_replace(p, "[^a-z0-9]", "")), "|")


#: Letter groups of the sound code and their digits, in the order of replacement.
SOUND_GROUPS = (("[hw]", ""), ("[bfpv]", "1"), ("[cgjkqsxz]", "2"), ("[dt]", "3"), ("l", "4"), ("[mn]", "5"), ("r", "6"))


def sound_code(c: Column | str) -> Column:
    """First letter and two more signs; a run of digits shrinks to its last one before vowels go."""
    s = strict_normalize(c)
    rest = F.substr(s, F.lit(2))
    for letters, digit in SOUND_GROUPS:
        rest = F.regexp_replace(rest, letters, digit)
    rest = F.regexp_replace(F.regexp_replace(rest, "[0-9]*([0-9])", "$1"), "[aeiouy]", "")
    return F.when(s == "", "").otherwise(F.concat(F.left(s, F.lit(1)), F.left(F.concat(rest, F.lit("000")), F.lit(3))))


def sound_codes(c: Column | str) -> Column:
    return F.array_join(F.transform(F.split(col(c), " "), sound_code), " ")


def truncate_words(c: Column | str, n: int = 3) -> Column:
    return F.array_join(F.transform(F.split(col(c), " "), lambda w: F.left(strict_normalize(w), F.lit(n))), " ")


def clean_title(c: Column | str) -> Column:
    """No diacritics, no entities, no final full stop."""
    return F.regexp_replace(F.regexp_replace(remove_diacritics(col(c)), "&[^;\n]*;", ""), r"\.\z", "")


def title_key(c: Column | str) -> Column:
    return F.regexp_replace(clean_title(F.lower(F.trim(col(c)))), "[^A-Za-z0-9_]", "")


def fix_extracted_title(c: Column | str) -> Column:
    """Join words at a dash and a blank; drop one sign at the end unless it is ? \" or )."""
    joined = F.regexp_replace(col(c), "([a-z])- ", "$1")
    return F.trim(F.regexp_replace(joined, r"[^A-Za-z0-9_?\")]\z", ""))


def clean_line(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(col(c), "[\r\t\n]", " "), " +", " "))


def join_broken_lines(c: Column | str, how: str = "hyphen") -> Column:
    """``<lb>`` marks resolved: ``hyphen`` joins at any dash, ``lower`` only before a lower-case letter; others become blanks."""
    c = col(c)
    c = F.regexp_replace(c, r"-<lb>(\p{Ll})", "$1") if how == "lower" else F.replace(c, F.lit("-<lb>"), F.lit(""))
    return F.replace(c, F.lit("<lb>"), F.lit(" "))


def gazetteer_key(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(col(c)), r"\p{P}+", " "), "  +", " "))


def within_length(c: Column | str, words: int = 7) -> Column:
    """False from the ``words``-th blank on."""
    t = F.trim(col(c))
    return F.length(t) - F.length(F.replace(t, F.lit(" "))) < words


def tokenize(c: Column | str) -> Column:
    """Parts between single blanks, without empty ones at the end (one empty part for the empty string)."""
    trimmed = F.regexp_replace(col(c), r" +\z", "")
    return F.when(trimmed == "", F.when(col(c) == "", F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))).otherwise(F.split(trimmed, " "))


def emails(token: Column | str) -> Column:
    """Addresses of a token: the part after a colon; lists in braces or brackets or with commas or bars share the domain."""
    t = F.regexp_replace(col(token), r"[^\x20-\x7E]", "")
    t = F.when(F.size(F.filter(F.split(t, ":"), lambda p: p != "")) > 1, F.get(F.split(t, ":"), F.lit(1))).otherwise(t)
    parts = F.split(F.regexp_replace(t, r"@+\z", ""), "@")
    names, domain = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    listed = names.rlike(r"^\{.*\}$") | names.rlike(r"^\[.*\]$") | names.contains(",") | names.contains("|")
    split = F.when(listed, F.split(F.regexp_replace(names, r"[{}\[\]]", ""), r"[,|]")).otherwise(F.array(names))
    found = F.transform(split, lambda e: F.concat(F.trim(e), F.lit("@"), domain))
    return F.when(col(token).contains("@") & (F.size(parts) == 2), found).otherwise(F.array().cast("array<string>"))


#: Years that a reference may have: after the first and up to ten years from now.
MIN_YEAR, MAX_YEAR = 1800, 2036


def ref_year(c: Column | str) -> Column:
    """First four digits 1xxx or 2xxx in range, else the last such four, else 0."""
    found = F.transform(F.regexp_extract_all(col(c), F.lit("([1-2][0-9][0-9][0-9])"), 1), lambda y: y.cast("int"))
    good = F.filter(found, lambda y: (y > MIN_YEAR) & (y < MAX_YEAR))
    return F.coalesce(F.get(good, F.lit(0)), F.try_element_at(found, F.lit(-1)), F.lit(0))


def modern_year(c: Column | str) -> Column:
    return F.regexp_extract(col(c), "(19[0-9]{2}|20[0-9]{2})", 1)


def first_four_digits(c: Column | str) -> Column:
    return F.regexp_extract(col(c), "([0-9]{4})", 1)


def bracket_year(c: Column | str) -> Column:
    """Digits after an opening bracket if they lie between 1800 and 2100."""
    y = F.regexp_extract(col(c), r"\(([0-9]{4})", 1)
    return F.when(y.between("1800", "2100"), y).otherwise("")


def first_and_last_word(c: Column | str) -> Column:
    words = F.split(col(c), r"\s+")
    return F.concat_ws(" ", F.get(words, F.lit(0)), F.try_element_at(words, F.lit(-1)))


def eval_author(c: Column | str) -> Column:
    """Lower case without diacritics; punctuation but a closing bracket is deleted."""
    return F.trim(F.regexp_replace(remove_diacritics(F.lower(col(c))), r"[\p{P}&&[^)]]", ""))


def eval_title(c: Column | str) -> Column:
    return implode_spaces(F.regexp_replace(remove_diacritics(F.lower(col(c))), r"[\p{P}&&[^)]]", " "))


def title_or_empty(c: Column | str) -> Column:
    t = F.regexp_replace(col(c), r"^[,.\s]+|[,.\s]+\z", "")
    return F.when(t.rlike(r"\p{L}"), t).otherwise("")


def add_dot(c: Column | str) -> Column:
    return F.when(F.length(col(c)) == 1, F.concat(col(c), F.lit("."))).otherwise(col(c))


def strip_superscripts(c: Column | str) -> Column:
    """Without runs between the signs that surround superscripts (U+2350 .. U+2357)."""
    return F.regexp_replace(col(c), "[⍐-⍗][^⍐-⍗]*[⍐-⍗]", "")


def superscripts_to_brackets(c: Column | str) -> Column:
    return F.translate(col(c), "⍐⍗", "()")
