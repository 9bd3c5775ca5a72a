"""Each operator against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import base64
import collections
import hashlib
import itertools
import random
import re

import numpy as np
import public_tokenizers
import pytest
import regex
import sentencepiece
import tiktoken
import xxhash
from pyspark.sql import functions as F

from paperloom.llm import audio_fingerprint, byte_bpe, components, language_id, license_scan, line_dedup, mixing, simhash_dedup, substring_dedup, token_count, vector_search

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, chunk string, size string"


def words_of(n, seed, vocab=40):
    r = random.Random(seed)
    return " ".join(r.choice("abcdefghijklmnop") + str(r.randrange(vocab)) for _ in range(n))


def fixture_rows():
    base = words_of(90, 1)
    shared = words_of(30, 2)
    lines = "\n".join(words_of(6, s) for s in range(10, 16))
    texts = [
        (0, base), (1, base), (2, base + " tail " + shared), (3, words_of(5, 3)), (4, None), (5, ""), (6, "  \n\t "), (7, words_of(3000, 4, 9)),
        (8, shared + "\n" + words_of(40, 5)), (9, words_of(12, 6) + "\n" + shared + "\n\n" + shared), (10, lines), (11, "other first line of words\n" + lines + "\nlast line here"),
        (12, "x" * 4000), (13, base.upper()), (14, "ééé ça\x1cva　bien ▁ ok  so"), (None, base), (16, lines), (17, "same same same same same same same same same same same same same same same same same same same same same same same same"),
    ]
    return [(i, t, ["en", "fr", None][n % 3], ["b", None, "a"][n % 3], len(t or ""), 7, "clash", "clash") for n, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture_rows(), SCHEMA).repartition(3)


def order(i):
    return -1 if i is None else i


def brute_substring(rows, window):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (order(r[0]), r[1] or "")):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            if key in seen:
                gone[p : p + window] = [True] * window
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=lambda r: (order(r[0]), r[3]))


@pytest.mark.parametrize(("window", "period", "chunk"), [(20, None, 1 << 20), (20, 7, 700), (5, 5, 700), (20, 1, 2000), (1, 1, 5000)])
def test_substring_dedup(docs, window, period, chunk):
    got = substring_dedup.removals(docs, window=window, period=period, chunk_bytes=chunk).collect()
    want = brute_substring([(r[0], r[1]) for r in fixture_rows()], window)
    assert sorted(map(tuple, got), key=lambda r: (order(r[0]), r[3])) == want


def test_substring_dedup_repeated_rows_and_empty_table(spark, docs):
    text = words_of(25, 8)
    twice = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    assert sorted(r.n_removed for r in substring_dedup.removals(twice).collect()) == [0, 25]
    assert substring_dedup.removals(docs.filter("doc_id < 0")).collect() == []


@pytest.mark.parametrize("period", range(1, 21))
def test_difference_cover(period):
    cover = substring_dedup.difference_cover(period)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_simhash_against_brute_force(docs, spark):
    got = simhash_dedup.near_duplicates(docs).collect()

    def fingerprint(text):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", w)
        shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
        return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))

    want = sorted((order(r[0]), f"{fingerprint(r[1]):016x}") for r in fixture_rows())
    shown = simhash_dedup.near_duplicates(docs).select("doc_id", simhash_dedup.hex16(F.col("fp")).alias("f")).collect()
    assert sorted((order(r.doc_id), r.f) for r in shown) == want
    groups = {order(r.doc_id): r.component_id for r in got}
    assert groups[0] == groups[1] == groups[13] == groups[-1] == 0  # upper case is the same text; a null id names nothing
    assert groups[4] == groups[5] == groups[6] == 4
    assert simhash_dedup.near_duplicates(docs.filter("doc_id < 0")).collect() == []


def test_simhash_cells_hold_every_close_pair():
    """Whatever k coordinates differ, some choice leaves them free, at every level."""
    for k in (1, 2, 3):
        level = [tuple(range(32))]
        while any(len(f) > k for f in level):
            for parent in level[:: max(1, len(level) // 20)]:
                parts = [set(x) for x in simhash_dedup._splits(parent, k)]
                assert all(any(set(some) <= p for p in parts) for some in itertools.combinations(parent, k))
            level = list(dict.fromkeys(f for parent in level for f in simhash_dedup._splits(parent, k)))


@pytest.mark.parametrize(("max_cell", "swaps"), [(1, 0), (2, 1), (4, 0), (64, 1)])
def test_simhash_links_lose_no_component(spark, max_cell, swaps):
    r = random.Random(max_cell)
    fps = set()
    if swaps:  # equal counts, swapped bits: cells that can't be split
        centre = r.getrandbits(64)
        pairs = [s for s in range(32) if (centre >> 2 * s & 3) in (1, 2)]
        for _ in range(60):
            fps.add(centre ^ sum(3 << 2 * s for s in r.sample(pairs, r.randrange(4))))
    for _ in range(12):
        centre = r.getrandbits(64)
        fps.add(centre)
        for _ in range(40):
            x = centre
            for _ in range(r.randrange(1, 6)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    prints = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    edges = simhash_dedup.links(prints, 2, max_cell)
    found = {r.node: r.component for r in components.connected_components(edges).collect()}
    groups = {}
    for f in fps:
        groups.setdefault(root(f), set()).add(found.get(signed(f), signed(f)))
    assert all(len(g) == 1 for g in groups.values())
    assert len({min(g) for g in groups.values()}) == len(groups)


def test_components_of_a_long_path(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (200, 200), (None, 3)], "a long, b long")
    found = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert found == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100, 200: 200}


def brute_lines(rows, least):
    """Of each start the longest run of lines that also starts earlier, if it has enough words."""
    docs = []
    for i, text in sorted(rows, key=lambda r: order(r[0])):
        lines = (text or "").split("\n")
        n = [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in lines]
        docs.append((i, text, lines, n, [k for k in range(len(lines)) if n[k]]))
    starts, out = {}, []
    for d, (i, text, lines, n, full) in enumerate(docs):
        gone = set()
        for a, k in enumerate(full):
            for e, b in starts.get(lines[k], []):
                other, size = docs[e], 0
                while a + size < len(full) and b + size < len(other[4]) and lines[full[a + size]] == other[2][other[4][b + size]]:
                    size += 1
                if sum(n[x] for x in full[a : a + size]) >= least:
                    gone.update(full[a : a + size])
            starts.setdefault(lines[k], []).append((d, a))
        out.append((order(i), None if text is None else "\n".join(x for k, x in enumerate(lines) if k not in gone), 0 if text is None else len(lines), len(gone)))
    return sorted(out, key=lambda r: (r[0], r[3]))


@pytest.mark.parametrize("least", [1, 5, 14, 31])
def test_line_dedup(docs, least):
    got = line_dedup.dedup_lines(docs, min_words=least)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    rows = sorted(((order(r.doc_id), r.text, r.n_lines, r.n_removed) for r in got.collect()), key=lambda r: (r[0], r[3]))
    assert rows == brute_lines([(r[0], r[1]) for r in fixture_rows()], least)


@pytest.mark.parametrize("least", [1, 3, 5, 12])
def test_line_dedup_of_nested_runs(spark, least):
    """Few different lines of one to three words, so that repeated runs of all lengths overlap; one long copied text."""
    r = random.Random(least)
    line = lambda: " ".join(r.choice("abc") for _ in range(r.choice([0, 1, 1, 2, 3])))
    rows = [(i, "\n".join(line() for _ in range(r.randrange(1, 40)))) for i in range(30)]
    long = [f"line {k} of a long text" for k in range(150)]
    rows += [(40, "\n".join(long)), (41, "\n".join(["one more", *long, "and more"])), (42, "\n".join(long[:70] + ["between"] + long[70:]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((x.doc_id, x.text, x.n_lines, x.n_removed) for x in line_dedup.dedup_lines(df, min_words=least).collect()), key=lambda x: (x[0], x[3]))
    assert got == brute_lines(rows, least)


def test_suffix_array_and_common_prefixes(spark):
    r = random.Random(2)
    texts = {(d, 0): [r.randrange(3) for _ in range(r.randrange(1, 90))] for d in range(12)} | {(20, 0): [1] * 70, (21, 0): [1] * 70}
    rows = [(d, h, 0, k, x) for (d, h), t in texts.items() for k, x in enumerate(t)]
    positions = spark.createDataFrame(rows, "id long, hash long, segment long, seq int, rank long")
    ranked, rounds = line_dedup.suffix_ranks(positions, 90)
    suffixes = {}
    for x in ranked.collect():
        suffixes.setdefault(x["rank"], set()).add(tuple(texts[x.id, x.hash][x.seq :]))
    assert all(len(v) == 1 for v in suffixes.values())
    ordered = [next(iter(suffixes[k])) for k in sorted(suffixes)]
    assert ordered == sorted({tuple(t[k:]) for t in texts.values() for k in range(len(t))})
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    lcps = {x["rank"]: x.lcp for x in line_dedup.common_prefixes(rounds).collect()}
    assert [lcps[k] for k in sorted(suffixes)] == [0, *(common(a, b) for a, b in zip(ordered, ordered[1:]))]


def test_line_dedup_rows_alike_and_empty_table(spark, docs):
    alike = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert [r.n_removed for r in line_dedup.dedup_lines(alike).collect()] == [0, 0]
    clash = alike.withColumns({c: F.lit(9) for c in ("places", "n_lines", "hash", "rank", "seq", "Found", "__hash")})
    assert line_dedup.dedup_lines(clash).columns == ["doc_id", "text", "places", "hash", "rank", "seq", "Found", "__hash", "n_lines", "n_removed"]
    assert {(r["__hash"], r.Found) for r in line_dedup.dedup_lines(clash).collect()} == {(9, 9)}
    assert {r.n_lines for r in line_dedup.dedup_lines(clash).collect()} == {1}
    assert line_dedup.dedup_lines(docs.filter("doc_id < 0")).collect() == []


ODD = ["", " ", "  ", "a  b", "a \n b", "\n\n\nfoo  bar ", "don't we'll  X", "a▁ b", " ▁", "x▁y  z", "foo\tbar 　 baz", "\x1c a", "a \x1cb", "<|endoftext|> <s> hi", "ab" * 400 + " c", "\x85 a b", "a\x00b c", "日本語 テ", "\U0001f642\U0001f642 ok", "1 234 5.6!!! ???"]


def test_token_counts(spark, docs):
    model = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = [(r[0], r[1]) for r in fixture_rows()] + [(100 + i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted((order(r[0]), r[1], r[2]) for r in token_count.token_counts(df, model, batch_bytes=500, memo=10).collect())
    assert got == sorted((order(i), len((t or "").encode()), len(sp.encode(t or ""))) for i, t in texts)
    assert token_count.token_counts(docs.filter("doc_id < 0"), model).collect() == []


def test_byte_bpe_round_trip(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [(r[0], r[1]) for r in fixture_rows()] + [(100 + i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = byte_bpe.encode_decode(df, path, public_tokenizers.PATTERN, keep_ids=True).collect()
    by_text = {}
    for i, t in texts:
        by_text.setdefault(order(i), []).append(t or "")
    for r in got:
        t = by_text[order(r.doc_id)][0]
        ids = own.encode_ordinary(t)
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert len(got) == len(texts)
    assert byte_bpe.encode_decode(docs.filter("doc_id < 0"), path, public_tokenizers.PATTERN).collect() == []


def test_byte_bpe_classes_over_all_code_points():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    codec = byte_bpe.Codec(path, public_tokenizers.PATTERN)
    r = random.Random(4)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    chosen = sorted({*codec.unlike, *range(0x600), *r.sample(points, 20_000)})
    texts = [t for c in map(chr, chosen) for t in (c + "'s", f"a{c}1 {c} {c}")]
    got = [ids for ids, _ in codec.encode(texts)]
    assert got == [" ".join(map(str, own.encode_ordinary(t))) for t in texts]
    # the classes themselves, everywhere: what the engine finds in all code points after translation
    single = {bytes([b]): b for b in range(256)}
    every = "".join(map(chr, points))
    for pattern in (r"\p{L}", r"\p{N}", r"\s"):
        library = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        shown = regex.finditer(pattern, every.translate(codec.unlike))
        assert "".join(every[m.start()] for m in shown) == library.decode(library.encode_ordinary(every))


def test_license_scan(spark, docs):
    rows = [
        (1, "Released under the MIT License. Again: UNDER-THE-MIT-LICENSE, and CC BY-NC 4.0"),
        (2, "// SPDX-License-Identifier: (GPL-2.0-only OR MIT) AND Apache-2.0\ncode"),
        (3, "SPDX-License-Identifier: GPL-3.0-only WITH\nApache License, Version 2.0"), (4, None), (5, ""), (6, "under the mit licenses"),
    ]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word) == (16, 3, 1, 11)
    assert got[1].base_labels == ["cc-by-nc", "mit"]
    assert got[2].labels == ["spdx:apache-2.0", "spdx:gpl-2.0-only", "spdx:mit"] and got[2].permissive is True
    assert got[3].expressions == [] and got[3].base_labels == ["apache-2"]
    assert (got[4].n_words, got[4].n_base, got[4].first_word, got[4].score) == (0, 0, None, 0.0)
    assert got[6].n_base == 0 and all(0 <= r.score <= 1 for r in got.values())
    assert len(license_scan.scan(docs).collect()) == len(fixture_rows())
    assert license_scan.scan(docs.filter("doc_id < 0")).collect() == []


@pytest.mark.parametrize(
    ("text", "want"),
    [("MIT", True), ("GPL-2.0 OR MIT", True), ("GPL-2.0 AND MIT", False), ("GPL-2.0 OR MIT AND GPL-3.0", False), ("(GPL-2.0 OR MIT) and ISC", True), ("Apache-2.0 WITH LLVM-exception", True), ("MIT OR", None), ("(MIT", None), ("MIT)", None), ("MIT ISC", None), ("", None), ("OR MIT", None), ("()", None)],
)
def test_license_expressions(text, want):
    postfix = license_scan.to_postfix(text)
    assert (None if postfix is None else license_scan.evaluate(postfix)[0]) is want


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("MIT -- see LICENSE", ["MIT"]), ("<!-- SPDX-License-Identifier: MIT -->", ["MIT"]), ("MIT. See file", ["MIT"]), ("MIT.", ["MIT"]), ("MIT OR", []), ("MIT OR -- x", []), ("MIT)", ["MIT"]), ("(MIT", []),
        ("(MIT OR  ISC) */", ["(MIT OR ISC)"]), ("Apache-2.0 WITH (x)", []), ("GPL-2.0+, or later", ["GPL-2.0+"]), ("", []), ("MIT\nor ISC", ["MIT"]), ("MIT SPDX-License-Identifier: ISC", ["MIT", "ISC"]),
    ],
)
def test_license_tags(line, want):
    text = line if line.startswith("<") else f"# SPDX-license-identifier: {line}"
    assert [" ".join(x.split()) for x in license_scan.tag_expressions(text.encode())] == want
    assert license_scan.tag_expressions(b"x" + text.encode().lstrip(b"# <!-")) == want[1:]


def test_license_labels_of_unknown_identifiers(spark):
    rows = [(1, "SPDX-License-Identifier: Foo-Bar"), (1, "SPDX-License-Identifier: MIT. See file"), (None, "SPDX-License-Identifier: Foo OR ISC"), (2, "word " * 900_000 + "é SPDX-License-Identifier: MIT under the mit license")]
    got = sorted(license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=lambda r: r.labels)
    assert [(r.doc_id, r.labels, r.permissive) for r in got] == [
        (2, ["mit", "spdx:mit"], True), (None, ["spdx-unknown:foo", "spdx:isc"], True), (1, ["spdx-unknown:foo-bar"], False), (1, ["spdx:mit"], True),
    ]
    assert got[0].first_word == 900_005 and got[2].score == 0.0 and got[1].score == 0.5 and got[3].score == 1 - 0.5**4


def test_license_scan_against_brute_force(spark):
    r = random.Random(4)
    parts = ["under", "the", "mit", "license", "Under The MIT License", "apache license, version 2", "cc", "by", "nc", "cc-by-nc", "é", "\n", "SPDX-License-Identifier:", "MIT", "OR", "and", "WITH", "(", ")", "ISC.", "GPL-2.0", "--", "odd"]
    texts = [" ".join(r.choices(parts, k=r.randrange(40))) for _ in range(400)]
    got = {x.doc_id: x for x in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}

    def parse(tokens):
        """Recursive descent over whole token lists: or below and below with."""

        def term(i):
            if i < len(tokens) and tokens[i] == "(":
                j = level(i + 1, 0)
                return j + 1 if j and j < len(tokens) and tokens[j] == ")" else None
            return i + 1 if i < len(tokens) and tokens[i] not in {"or", "and", "with", "(", ")"} else None

        def level(i, k):
            if k == 2:
                j = term(i)
                while j and j < len(tokens) and tokens[j] == "with":
                    j = j + 2 if j + 1 < len(tokens) and tokens[j + 1] not in {"or", "and", "with", "(", ")"} else None
                return j
            j = level(i, k + 1)
            while j and j < len(tokens) and tokens[j] == ("or", "and")[k]:
                j = level(j + 1, k + 1)
            return j

        return level(0, 0) == len(tokens)

    def could_go_on(tokens):
        ends = [["x"], [], ["x", ")"], [")"]]
        return any(parse([*tokens, *e, *[")"] * n]) for e in ends for n in range(len(tokens) + 1))

    for i, text in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
        places = [(w, label) for phrase, label in license_scan.BASE_PHRASES.items() for w in range(len(words)) if words[w : w + len(phrase.split())] == phrase.split()]
        row = got[i]
        assert (row.n_words, row.n_base, row.base_labels) == (len(words), len(places), sorted({b for _, b in places}))
        assert (row.first_word, row.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        want = []
        for rest in text.split("SPDX-License-Identifier:")[1:]:
            tokens = []
            for t in rest.split("\n")[0].split(" "):
                t = t.lower()
                if not t:
                    continue
                if not re.match(r"[(a-z0-9)]", t) or not could_go_on([*tokens, t.rstrip(".").removesuffix(",")]):
                    break
                tokens.append(t.rstrip(".").removesuffix(","))
                if t[-1] in ".,":
                    break
            if tokens and parse(tokens):
                want.append(tokens)
        assert [x.lower().split() for x in row.expressions] == want, text


def test_language_id(spark, sf_dir, docs):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.fit(table.filter(~language_id.held_out()))
    got = language_id.predict(table, model, keep=["lang"]).withColumn("held", language_id.held_out()).toPandas()
    held = got[got.held]
    assert len(held) > 20 and (held.lang == held.lang_pred).mean() > 0.97
    assert not got.rejected.any() and got.score.between(0, 1).all()
    odd = {order(r.doc_id): r for r in language_id.predict(docs, model).collect()}
    assert [odd[i].lang_pred for i in (4, 5, 6)] == ["und"] * 3 and odd[4].score == 0.0 and odd[4].rejected
    assert set(r.lang_pred for r in odd.values()) <= {*model.languages, "und"}
    r = random.Random(1)
    letters = " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(200))
    italian = "il treno per la campagna parte ogni mattina dalla vecchia stazione e arriva quando le botteghe aprono sulla piazza del mercato " * 4
    script = spark.createDataFrame([(1, "добрый день мои друзья"), (2, "123 !?"), (3, letters), (4, italian)], "doc_id long, text string")
    found = {r.doc_id: r for r in language_id.predict(script, model).collect()}
    assert found[1].rejected and found[1].lang_pred in model.languages and found[2].lang_pred == "und"
    assert found[3].rejected and found[4].rejected
    # floors: from one knot to the next without a step, never lower for more trigrams
    for lang, knots in model.floors.items():
        steps = [language_id.floor_at(knots, n) for n in range(1, 4096)]
        assert all(0 <= b - a < 0.05 for a, b in zip(steps, steps[1:])), lang
    low = language_id.floors(np.array([0.2, 0.4, 0.6, 0.5]), np.array([8, 8, 32, 128]), share=0.5, quantile=0.0)
    assert np.allclose(low[:8], [0.025, 0.05, 0.075, 0.1, 0.2, 0.25, 0.25, 0.25]) and low[13] == low[7]
    # a row that repeats teaches once, rows that share an id each for themselves
    rows = table.filter("lang is not null").limit(60)
    many = rows.crossJoin(spark.range(5)).drop("id").union(rows.withColumn("doc_id", F.lit(1).cast("long")))
    once = language_id.fit(rows.union(rows.withColumn("doc_id", F.lit(1).cast("long"))))
    again = language_id.fit(many)
    assert once.languages == again.languages and np.allclose(once.centroids, again.centroids) and np.allclose(once.idf, again.idf)
    with pytest.raises(ValueError, match="score"):
        language_id.predict(table.withColumn("score", F.lit(1)), model, keep=["score"])
    assert language_id.predict(table.limit(0), model).count() == 0
    # an independent cosine: plain Python over dictionaries of trigrams
    for t in (table.orderBy("doc_id").limit(5).collect()):
        raw, grams = f" {t.text.lower()} ".encode(), {}
        blank = bytes(32 if b < 0x80 and not chr(b).isalpha() else b for b in raw)
        for i in range(len(blank) - 2):
            if blank[i + 1] != 32:
                slot = ((blank[i] << 16 | blank[i + 1] << 8 | blank[i + 2]) * 2654435761 & 0xFFFFFFFF) >> 19
                grams[slot] = grams.get(slot, 0) + 1
        v = {k: (1 + np.log(n)) * model.idf[k] for k, n in grams.items()}
        length = sum(x * x for x in v.values()) ** 0.5
        near = [sum(x * c[k] for k, x in v.items()) / length for c in model.centroids]
        assert abs(max(near) - got[got.doc_id == t.doc_id].score.iloc[0]) < 1e-5
    nothing = language_id.fit(table.filter("false"))
    assert {r.lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"}


def test_mixing(spark, docs):
    r = random.Random(3)
    rows = [(i, r.choice(["a", "a", "a", "b", "c", None]), r.randrange(0, 50), r.choice([0.5, 1.0, 2.0, None])) for i in range(3000)] + [(5, "b", 10, 1.0)] * 2
    df = spark.createDataFrame(rows, "doc_id long, source string, words long, q double")
    run = lambda parts: mixing.mix(df.repartition(parts), size=F.col("words"), weight=F.col("q"), slot_rows=50).toPandas()
    got, again = run(3), run(7)
    key = ["doc_id", "size", "taken"]
    assert got.sort_values(key)[key].reset_index(drop=True).equals(again.sort_values(key)[key].reset_index(drop=True))
    sizes = {s: sum(x[2] for x in rows if x[1] == s) for s in ("a", "b", "c", None)}
    weight, total = {"a": 3, "b": 1, "c": 2, None: 3}, 1.5 * sum(sizes.values())
    free = set(sizes)
    while True:
        rate = (total - sum(2 * sizes[s] for s in sizes if s not in free)) / sum(weight[s] for s in free)
        over = {s for s in free if 2 * sizes[s] < rate * weight[s]}
        if not over:
            break
        free -= over
    for s, size in sizes.items():
        part = got[got.source.isna()] if s is None else got[got.source == s]
        want = rate * weight[s] if s in free else 2 * size
        assert abs(part.target.iloc[0] - want) < 1e-6 and (part.source_size == size).all()
        assert abs(part.taken.sum() - want) <= 25
    assert (got.taken <= 2 * got["size"]).all() and len(got) == len(rows)
    # the selected documents: whole epochs, then by the order of the keys up to what is left
    def key(i, w):
        u = ((xxhash64_of[i] & (1 << 64) - 1) >> 11) + 0.5
        return -np.log(u * 2.0**-53) / (w or 1.0)

    xxhash64_of = {r.id: r.h for r in spark.range(3000).select("id", F.xxhash64("id", F.lit(7)).alias("h")).collect()}
    part = got[got.source == "a"]
    epochs, rest = divmod(part.target.iloc[0], sizes["a"])
    total, want = 0, {}
    for i, _, n, w in sorted((x for x in rows if x[1] == "a"), key=lambda x: (key(x[0], x[3]), x[0])):
        total += n
        want[i] = int(epochs) + (total - n / 2 < rest)
    assert part.set_index("doc_id").epochs.to_dict() == want
    odd = mixing.mix(df.withColumn("q", F.when(F.col("doc_id") % 3 == 0, 0.0).when(F.col("doc_id") % 3 == 1, 1e-3)), size=F.col("words"), weight=F.col("q"), slot_rows=50).toPandas()
    assert len(odd) == len(rows) and abs(odd[odd.source == "a"].taken.sum() - odd[odd.source == "a"].target.iloc[0]) <= 25
    whole = mixing.mix(docs).toPandas()
    assert len(whole) == len(fixture_rows()) and (whole["size"][whole.doc_id == 4] == 0).all()
    assert mixing.mix(docs.filter("doc_id < 0")).collect() == []


def test_vector_search(spark):
    r = np.random.default_rng(1)
    centres = r.normal(size=(12, 16))
    x = centres[r.integers(12, size=1500)] + 0.4 * r.normal(size=(1500, 16))
    x[100:400] = x[100]  # one vector is a fifth of all
    rows = [(i, v.astype(np.float32).tolist(), "clash") for i, v in enumerate(x)]
    rows += [(2000, None, ""), (2001, [0.0] * 16, ""), (2002, [float("nan")] + [1.0] * 15, ""), (2003, [None] + [1.0] * 15, ""), (2004, [1.0] * 3, ""), (2005, [float("inf")] * 16, ""), (None, [1.0] * 16, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string")
    got = vector_search.search(df, F.col("vec_id") % 20 == 0, 20, sample=512, list_rows=60, block=200).toPandas()
    x = x.astype(np.float32).astype(np.float64)
    hits = total = 0
    for q, part in got.groupby("query_id"):
        scores = (x * x[q]).sum(axis=1)
        best = [i for i in np.lexsort((np.arange(1500), -scores)) if i != q][:20]
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, 21)) and (part.vec_id != q).all() and part.vec_id.is_unique
        assert np.allclose(part.score, scores[part.vec_id], rtol=0, atol=1e-12)
        assert part[["score", "vec_id"]].apply(lambda s: (-s.score, s.vec_id), axis=1).is_monotonic_increasing
        hits += len(set(best) & set(part.vec_id))
        total += 20
    assert got.query_id.nunique() == 75 and hits / total >= 0.9
    few = vector_search.search(df.filter("vec_id < 5"), F.col("vec_id") % 2 == 0, 20).toPandas()
    assert few.groupby("query_id").size().tolist() == [4, 4, 4]
    assert vector_search.search(df.filter("vec_id < 0"), F.col("vec_id") % 2 == 0).collect() == []


def brute_align(prints, shifted, queries, hop, run=3):
    """Groups by all pairs of queries and recordings that share a landmark, and the shifts at which each pair shares one."""
    marks = lambda codes: {tuple(codes[i : i + run]): i for i in reversed(range(len(codes) - run + 1))}
    rows = [(r.id, r.key, r.codes) for r in prints]
    root = {k: k for _, k, _ in rows if k is not None}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    shifts = {}
    for q in shifted:
        for _, key, codes in rows:
            if q.id in queries and q.key is not None and key is not None and key != q.key and len(q.codes) >= run:
                own = marks(q.codes)
                at = {hop * (i - j) - q.phase for i in range(len(codes) - run + 1) for w, j in [(tuple(codes[i : i + run]), own.get(tuple(codes[i : i + run])))] if j is not None}
                if at:
                    shifts.setdefault((q.key, key), set()).update(at)
                    root[find(q.key)] = find(key)
    least = {}
    for i, k, _ in rows:
        if k is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, i if k is None else least[find(k)]) for i, k, _ in rows), shifts


def check_align(prints, shifted, is_query, queries, hop=128):
    got = audio_fingerprint.align(prints, is_query, shifted, hop).collect()
    rows = prints.collect()
    groups, shifts = brute_align(rows, (shifted if shifted is not None else prints).collect(), queries, hop)
    assert sorted((r.id, r.group_id) for r in got) == groups
    keys = {}
    for r in rows:
        keys.setdefault(r.id, r.key)
    for r in got:
        if r.partner_id is not None:
            a, b = keys[r.id], keys[r.partner_id]
            assert r.shift in shifts.get((a, b), set()) | {-x for x in shifts.get((b, a), set())}
            assert r.votes >= 1 and r.bit_error <= 0.35
    return {r.id: r for r in got}


def test_audio_fingerprints_align(spark):
    r = np.random.default_rng(2)
    t = np.arange(8000 * 6) / 8000
    tune = sum(np.sin(2 * np.pi * 440 * 2 ** (n / 12) * t) * (r.random(len(t) // 4000).repeat(4000)) for n in (0, 3, 7, 10, 14))
    pcm = (128 + 20 * tune).clip(0, 255).astype(np.uint8)
    noise = lambda n: r.integers(0, 256, n).astype(np.uint8)
    soft = (pcm.astype(int) + r.integers(-2, 3, len(pcm))).clip(0, 255).astype(np.uint8)
    rows = [(0, pcm.tobytes()), (1, pcm.tobytes()), (2, noise(20000).tobytes() + b""), (3, np.concatenate([noise(128 * 50), pcm[:30000]]).tobytes()), (4, soft.tobytes()), (5, None), (6, b""), (7, b"short")]
    prints = audio_fingerprint.fingerprints(spark.createDataFrame([(i, bytearray(b) if b is not None else None, "x", 1) for i, b in rows], "doc_id long, sound binary, id string, phase int"), "doc_id", "sound")
    sizes = {r.id: len(r.codes) for r in prints.collect()}
    assert sizes[5] == sizes[6] == sizes[7] == 0 and sizes[0] == (len(pcm) - 512) // 128 + 1 - audio_fingerprint.SPAN + 1
    found = check_align(prints, None, F.col("id").isin(0, 1, 3, 5), {0, 1, 3, 5})
    assert (found[1].class_id, found[1].group_id, found[3].group_id, found[4].group_id, found[2].group_id) == (0, 0, 0, 0, 2)
    assert found[3].partner_id in (0, 4) and found[3].shift == -50 * 128 and found[3].bit_error < 0.2
    assert found[4].partner_id in (0, 3) and found[5].group_id == 5 and found[5].partner_id is None
    assert audio_fingerprint.align(prints.filter("id < 0"), F.col("id") == 0).collect() == []


def test_audio_null_and_repeated_ids(spark):
    r = np.random.default_rng(5)
    say = lambda n: bytearray(r.integers(97, 123, n).astype(np.uint8).tobytes())
    a, b = say(4000), say(4000)
    prints = audio_fingerprint.fingerprints(spark.createDataFrame([(None, a), (3, a), (3, b), (3, b), (9, None), (None, say(3000))], "doc_id long, sound binary"), "doc_id", "sound")
    got = audio_fingerprint.align(prints, F.coalesce(F.col("id") > 0, F.lit(False))).collect()
    assert sorted((order(x.id), order(x.class_id), order(x.group_id)) for x in got) == [(-1, -1, -1), (-1, 3, 3), (3, 3, 3), (3, 3, 3), (3, 3, 3), (9, 9, 9)]


def test_audio_groups_equal_all_pairs(spark):
    """A group of near copies, a passage that many share, ties between offsets."""
    r = np.random.default_rng(7)
    say = lambda n: r.integers(97, 123, n).astype(np.uint8).tobytes()
    base, passage, rows = say(6000), say(3000), []
    for i in range(40):  # near copies: one word each
        at = int(r.integers(0, 6000))
        rows.append((len(rows), base[:at] + say(8) + base[at:]))
    for _ in range(12):
        rows.append((len(rows), say(int(r.integers(100, 3000))) + passage + say(int(r.integers(100, 3000)))))
    rows += [(len(rows) + i, say(5000)) for i in range(5)] + [(100, passage + passage), (101, passage), (102, passage), (103, base[:3000] + passage), (104, say(9) * 900), (105, say(9) * 900)]
    rows += [(106, rows[-1][1][3:])]
    docs = spark.createDataFrame([(i, bytearray(b)) for i, b in rows], "doc_id long, sound binary").repartition(3)
    prints = audio_fingerprint.fingerprints(docs, "doc_id", "sound", least_codes=3).cache()
    queries = {i for i, _ in rows if i % 5 == 1}
    shifted = audio_fingerprint.fingerprints(docs.filter("doc_id % 5 = 1"), "doc_id", "sound", least_codes=3, phases=128).cache()
    found = check_align(prints, shifted, F.col("id") % 5 == 1, queries)
    assert len({found[i].group_id for i in range(12)}) == 1 and found[101].class_id == found[102].class_id == 101
    assert found[106].group_id == found[105].group_id


def test_box_sums_match_direct_sums():
    chroma = np.random.default_rng(4).integers(0, 256, (40, 12))
    got = audio_fingerprint.codes(chroma)
    for place in (0, 7, 28):
        code = 0
        for i, f in enumerate(audio_fingerprint.FILTERS):
            part = chroma[place : place + f.width, f.low : f.low + f.height]
            h, w = f.height // 2, f.width // 2
            if f.kind == 0:
                a, b = part.sum(), 255 * f.width * f.height // 6
            elif f.kind == 1:
                a, b = part[:, :h].sum(), part[:, h:].sum()
            elif f.kind == 2:
                a, b = part[:w].sum(), part[w:].sum()
            elif f.kind == 3:
                a = part[:w, :h].sum() + part[w:, h:].sum()
                b = part.sum() - a
            else:
                t = (f.height if f.kind == 4 else f.width) // 3
                inner = part[:, t : 2 * t].sum() if f.kind == 4 else part[t : 2 * t].sum()
                a, b = 2 * inner, part.sum() - inner
            level = int(a * 9 > b * 8) + int(a > b) + int(a * 8 > b * 9)
            code |= (level ^ level >> 1) << 2 * i
        assert got[place] == code


def test_audio_short_recordings_align(spark):
    r = np.random.default_rng(8)
    say = lambda n: bytes(r.integers(97, 123, n).astype(np.uint8))
    tiny, short = say(9), say(1500)
    rows = [(0, tiny), (1, tiny), (2, short), (3, short), (4, say(9)), (5, say(1500)), (6, b""), (7, None)]
    df = spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in rows], "doc_id long, sound binary")
    prints = audio_fingerprint.fingerprints(df, "doc_id", "sound", least_codes=3)
    assert {x.id: len(x.codes) for x in prints.collect()} == {i: 3 if b else 0 for i, b in rows}
    found = check_align(prints, None, F.col("id") > 0, {1, 2, 3, 4, 5, 6, 7})
    assert {i: (x.class_id, x.group_id) for i, x in found.items()} == {0: (0, 0), 1: (0, 0), 2: (2, 2), 3: (2, 2), **{i: (i, i) for i in range(4, 8)}}


def test_audio_passages_align_at_any_shift(spark):
    r = np.random.default_rng(9)
    say = lambda n: bytes(r.integers(97, 123, n).astype(np.uint8))
    shared, text = say(4000), say(9000)
    rows = [(0, say(3001) + shared + say(5000)), (1, say(777) + shared + say(9000)), (2, text), (3, text[:3000] + b"inserted" + text[3000:]), (4, say(9000))]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in rows], "doc_id long, sound binary")
    prints = audio_fingerprint.fingerprints(df, "doc_id", "sound", least_codes=3)
    shifted = audio_fingerprint.fingerprints(df, "doc_id", "sound", least_codes=3, phases=128)
    found = check_align(prints, shifted, F.lit(True), {0, 1, 2, 3, 4})
    assert {i: x.partner_id for i, x in found.items()} == {0: 1, 1: 0, 2: 3, 3: 2, 4: None}
    assert abs(found[0].shift - (777 - 3001)) <= 64 and abs(found[1].shift - (3001 - 777)) <= 64
    assert found[2].shift == 8 and all(x.bit_error < 0.2 for i, x in found.items() if i != 4)


def test_audio_partners_are_the_best_of_all_pairs(spark):
    """Every pair that shares a landmark is a link, also where many hold it and the one with the smallest key is no good partner."""
    r = np.random.default_rng(11)
    say = lambda n: bytes(r.integers(97, 123, n).astype(np.uint8))
    jingle, long = say(2600), say(9000)
    rows = [(i, say(1280) + jingle + say(300 * i)) for i in range(12)]  # all share the jingle
    rows += [(20 + i, long[:2560] + say(128 * i) + jingle + long[2560:]) for i in range(4)]  # these share more with each other
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in rows], "doc_id long, sound binary")
    prints = audio_fingerprint.fingerprints(df, "doc_id", "sound", least_codes=3).cache()
    queries = {0, 1, 2, 3, 20, 21}
    asked = prints.filter(F.col("id").isin(*queries)).cache()
    pairs, few = audio_fingerprint.links(prints, asked)
    got = {(bytes(x.q), bytes(x.m)): x.votes for x in pairs.collect()}
    _, shifts = brute_align(prints.collect(), asked.collect(), queries, 128)
    assert set(got) == {(bytes(a), bytes(b)) for a, b in shifts} and len(got) > few.count()
    found = check_align(prints, asked, F.col("id").isin(*queries), queries)
    assert all(found[i].partner_id >= 20 for i in range(20, 24))
    best = {}
    for (a, b), votes in got.items():
        for k in (a, b):
            best[k] = max(best.get(k, 0), votes)
    keys = {x.id: bytes(x.key) for x in prints.collect()}
    assert {i: x.votes for i, x in found.items()} == {i: best.get(keys[i]) for i in found}


def made_by_joins(spark, run):
    """The rows that each join makes while ``run`` runs."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    out, executions = [], store.executionsList()
    for e in (executions.apply(i).executionId() for i in range(before, executions.size())):
        values, nodes = store.executionMetrics(e), store.planGraph(e).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            metrics = [node.metrics().apply(i) for i in range(node.metrics().size())] if "Join" in node.name() else []
            out += [int(values.apply(m.accumulatorId()).replace(",", "")) for m in metrics if m.name() == "number of output rows" and values.contains(m.accumulatorId())]
    return out


def test_audio_still_passages_are_voted_for_once(spark):
    """A passage that stands still has one landmark at all phases, and each pair is still aligned where all phases and places say."""
    r = np.random.default_rng(12)
    say = lambda n: bytes(r.integers(97, 123, n).astype(np.uint8))
    still, tail = say(32) * 100, say(1500)
    rows = [(i, say(1024 + 128 * (i % 3)) + still[: 2400 + 128 * (i % 2)] + say(700)) for i in range(60)]  # equal landmarks at equal places too
    rows += [(60 + i, say(300 + 77 * i) + still + tail) for i in range(6)] + [(70, say(2500) + tail), (71, say(6000))]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in rows], "doc_id long, sound binary").repartition(3)
    prints = audio_fingerprint.fingerprints(df, "doc_id", "sound", least_codes=3).cache()
    asked = audio_fingerprint.fingerprints(df.filter("doc_id % 10 = 0"), "doc_id", "sound", least_codes=3, phases=128).cache()
    got = []
    joined = made_by_joins(spark, lambda: got.extend(audio_fingerprint.links(prints, asked)[0].collect()))
    recordings = {bytes(x.key): x.codes for x in prints.collect()}
    votes = {}
    for q in asked.collect():
        own = {tuple(q.codes[i : i + 3]): i for i in reversed(range(len(q.codes) - 2)) if i == 0 or q.codes[i : i + 3] != q.codes[i - 1 : i + 2]}
        for key, codes in recordings.items():
            for i in range(len(codes) - 2 if key != bytes(q.key) else 0):
                if (j := own.get(tuple(codes[i : i + 3]))) is not None and (i == 0 or codes[i : i + 3] != codes[i - 1 : i + 2]):
                    at = votes.setdefault((bytes(q.key), key), collections.Counter())
                    at[i - j, q.phase] += 1
    best = {pair: max((n, -abs(o), -o, -p) for (o, p), n in at.items()) for pair, at in votes.items()}
    assert {(bytes(x.q), bytes(x.m)): x["shift"] for x in got} == {pair: -128 * o + p for pair, (_, _, o, p) in best.items()} and len(got) > 300
    assert 5 * max(joined) < sum(sum(at.values()) for at in votes.values())
