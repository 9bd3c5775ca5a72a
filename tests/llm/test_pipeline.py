"""The corpus pipeline against its stages' brute-force forms."""

import hashlib
import itertools
import random
import re

import corpus_pipeline
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from paperloom.llm import queries, shingle_similarity
from paperloom.llm.common import utf8_buffer


def test_stages_keep_the_columns_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir).persist()
        sizes.append(out.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == corpus_pipeline.COLUMNS
            docs = out
    assert 195 <= sizes[0] <= 200 and sizes[1] < sizes[0] and sizes[2] <= sizes[1] and sizes[3] == sizes[4]
    encoded = {r.doc_id: r.decoded_sha256 for r in out.collect()}
    for r in docs.select("doc_id", "text").collect():
        assert encoded[r.doc_id] == hashlib.sha256(r.text.encode()).hexdigest()
    words = docs.agg(F.sum(F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")))).first()[0]
    assert words > 0


def test_run_gives_the_rows_of_the_stages(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 100


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_registered_names():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))


def test_near_copies_of_five_word_similarity_are_dropped(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=7))
    rows, cut_off = [], 1000
    for g in range(30):
        base = [word() for _ in range(120)]
        other = list(base)
        other[20 + g] = word()
        other[80] = word()  # 106 of 126 five-word shingles in common: 0.84
        far = list(base)
        for at in (10, 30, 50, 70, 90):
            far[at] = word()  # 91 of 141: 0.65
        rows += [(g, " ".join(base)), (cut_off + g, " ".join(other)), (2 * cut_off + g, " ".join(far))]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {x.doc_id for x in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept & set(range(cut_off)) == set(range(30))
    assert not kept & set(range(cut_off, 2 * cut_off))
    assert len(kept & set(range(2 * cut_off, 3 * cut_off))) >= 29  # these are far in shingles and in bits


def test_shingle_sets_tell_texts_apart_as_their_words_do():
    texts = ["", " ", "a", "A b", "a b c d e", "a b c d e f a b c d e", "\u00e4 b\tc d e f \u00c4", None, "x " * 5000]
    got = shingle_similarity.shingle_sets(*utf8_buffer(pa.array(texts)), 5)
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split() for t in texts]
    want = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} - {()} for w in words]
    assert [len(s) for s in got] == [len(s) for s in want]
    for a, b in itertools.combinations(range(len(texts)), 2):
        assert len(set(got[a].tolist()) & set(got[b].tolist())) == len(want[a] & want[b])
    low = shingle_similarity._min_hashes([s for s in got if len(s)], np.array([5, 9], np.uint32), np.array([3, 2**31 + 1], np.uint32))
    hashed = lambda s, m, f: min(((x >> 32) ^ m) * f % 2**32 for x in s.tolist())
    assert low.tolist() == [[hashed(s, 5, 3), hashed(s, 9, 2**31 + 1)] for s in got if len(s)]


def test_similarity_links_join_what_all_pairs_join(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    r = random.Random(4)
    base = [f"w{i}" for i in range(100)]
    near = [(10_000 + i, " ".join(base[:at] + [f"x{i}"] + base[at + 1 :])) for i in range(40) for at in [r.randrange(100)]]
    docs = docs.union(spark.createDataFrame([*near, (20_000, None), (20_001, " ")], "doc_id long, text string"))
    sets = {x.doc_id: shingle_similarity.shingle_set((x.text or "").encode(), 5) for x in docs.collect()}

    def components(pairs):
        root = {i: i for i in sets}
        find = lambda i: i if root[i] == i else find(root[i])
        for a, b in pairs:
            a, b = sorted((find(a), find(b)))
            root[b] = a
        return {i: find(i) for i in sets}

    want = components((a, b) for a, b in itertools.combinations(sorted(sets), 2) if shingle_similarity.similarity(sets[a], sets[b]) >= 0.8)
    # rounds of hubs as long as they join any; none; no pairing off, blocks of a few sets
    for how in ({"few": 0, "share": 0}, {"few": 1_000_000}, {"few": 1_000_000, "small": 1, "block": 7}, {"few": 0, "small": 1, "block": 1000}):
        got = [(x.a, x.b) for x in shingle_similarity.links(docs, **how).collect()]
        assert components(got) == want
        assert all(shingle_similarity.similarity(sets[a], sets[b]) >= 0.8 for a, b in got)


def test_a_hot_cell_just_below_the_similarity():
    r = random.Random(9)
    base = np.sort(np.array(r.sample(range(1 << 40), 150), np.uint64))
    sets = [np.sort(np.concatenate([np.array(r.sample(base.tolist(), 133), np.uint64), np.array(r.sample(range(1 << 40), 17), np.uint64)])) for _ in range(300)]
    sets += [np.array([5], np.uint64), np.zeros(0, np.uint64)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    got = shingle_similarity.common_counts(sets)
    off = ~np.eye(len(sets), dtype=bool)
    assert (got[off] == want[off]).all()
    assert 0.6 < np.median([shingle_similarity.similarity(a, b) for a, b in itertools.combinations(sets[:50], 2)]) < 0.8
    close = want >= 122
    root = list(range(len(sets)))
    find = lambda i: i if root[i] == i else find(root[i])
    for a, b in shingle_similarity.spanning_pairs(close & off):
        assert close[a, b] and find(a) != find(b)  # no link more than needed
        root[find(a)] = find(b)
    assert all(find(a) == find(b) for a, b in zip(*np.nonzero(close & off)))


def test_null_and_repeated_ids_lose_no_document(spark, sf_dir):
    r = random.Random(6)
    text = lambda: " ".join("".join(r.choices("abcdefghijklmnop", k=7)) for _ in range(60))
    a, b, c, d, e, g = (text() for _ in range(6))
    rows = [(None, a), (None, b), (None, b), (1, c), (1, d), (1, d), (2, e), (None, e), (3, g)]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(((x.doc_id, x.text) for x in out.collect()), key=str) == sorted([(None, a), (None, b), (1, c), (1, d), (2, e), (3, g)], key=str)
    taken = corpus_pipeline.mix_sources(spark, out.withColumn("source", F.concat(F.lit("s"), F.crc32("text"))), sf_dir).collect()
    sizes = {t: sum(x.text == t for x in taken) for t in (a, b, c, d, e, g)}
    assert all(0 < n <= 3 for n in sizes.values())
