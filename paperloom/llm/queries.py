"""The registered queries of the training-data operators and, where SQL can say it, the same in SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio_fingerprint, ball_search, byte_bpe, hard_negatives, language_id, license_scan, line_dedup, mixing, prefix_trie, simhash_dedup, substring_dedup, token_count, vector_search
from .common import cut, table


def op1_audio_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings are the bytes of whole texts, played as 8-bit samples; every hundredth id is looked up, at all shifts of a hop."""
    docs, how = table(spark, sf_dir, "documents"), {"rate": 8000, "frame": 512, "hop": 128, "least_codes": 3}
    prints = audio_fingerprint.fingerprints(docs, "doc_id", "text", **how)
    shifted = audio_fingerprint.fingerprints(docs.filter("doc_id % 100 = 0"), "doc_id", "text", phases=128, **how)
    return audio_fingerprint.align(prints, F.col("id") % 100 == 0, shifted, hop=128, run=3).withColumnRenamed("id", "doc_id")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removals(table(spark, sf_dir, "documents"), window=20, keep_text=False)


def op3_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")}).withColumn("expressions", F.array_join("expressions", "; "))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(~language_id.held_out()))
    found = language_id.predict(docs, model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumn("over_limit", F.col("n_tokens") > 4096)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=5)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def quality_weights(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Add ``quality``: 2 for rows labelled good, 0.5 for bad ones, 1 for the others."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("label"))
    return rows.join(labels, "doc_id", "left").withColumn("quality", F.when(F.col("label") == 1, 2.0).when(F.col("label") == 0, 0.5).otherwise(1.0)).drop("label")


def mixed(docs: DataFrame, spark: SparkSession, sf_dir: str, id_col: str = "doc_id") -> DataFrame:
    sizes = docs.select(*dict.fromkeys([id_col, "doc_id"]), "source", mixing.word_count(F.col("text")).alias("size"))
    return mixing.mix(quality_weights(cut(sizes), spark, sf_dir), id_col, size=F.col("size"), weight=F.col("quality"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"), spark, sf_dir).select("doc_id", "size", "source_size", "target", "taken", "source", "epochs")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=3, k=2)
    return found.select("doc_id", simhash_dedup.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op11_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, factor=1024)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv")
    return prefix_trie.trie(table(spark, sf_dir, "conversations"), donor=conv - conv % 20, head=F.crc32(conv.cast("string").cast("binary")) % 4, most_head=3)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label, positives=5, negatives=10, least=30, most=90, factor=256)


QUERIES = {
    f.__name__: f
    for f in (
        op1_audio_fingerprint, op2_substring_dedup, op3_vector_search, op4_license_scan, op5_language_id, op6_token_counts, op7_line_dedup, op8_mixing, op9_byte_bpe, op10_simhash,
        op11_exact_search, op12_prefix_trie, op13_hard_negatives,
    )
}

_WORD = r"[^\x20\x09-\x0D]+"

ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": f"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
        p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20),
        f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY md5(array_to_string(ws[i:i + 19], ' ')) ORDER BY doc_id, i) AS r FROM p),
        gone AS (SELECT DISTINCT doc_id, i + j AS x FROM f, range(20) AS t(j) WHERE r > 1),
        words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS x FROM w),
        kept AS (
            SELECT doc_id, count(gone.x) AS n_removed, string_agg(word, ' ' ORDER BY words.x) FILTER (WHERE gone.x IS NULL) AS kept
            FROM words LEFT JOIN gone USING (doc_id, x) GROUP BY doc_id
        )
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)
    """,
    "op7_line_dedup": f"""
        WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
        e AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM l),
        n AS (SELECT *, len(regexp_extract_all(line, '{_WORD}')) AS words FROM e),
        s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS seq FROM n WHERE words > 0),
        same AS (
            SELECT a.doc_id, a.pos, a.seq, a.words, b.doc_id AS other, a.seq - b.seq AS apart
            FROM s a JOIN s b ON a.line = b.line AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.seq < a.seq))
        ),
        runs AS (SELECT *, seq - row_number() OVER (PARTITION BY doc_id, other, apart ORDER BY seq) AS run FROM same),
        long AS (SELECT *, sum(words) OVER (PARTITION BY doc_id, other, apart, run) AS total FROM runs),
        gone AS (SELECT DISTINCT doc_id, pos FROM long WHERE total >= 5),
        kept AS (
            SELECT doc_id, count(gone.pos) AS n_removed, string_agg(line, chr(10) ORDER BY e.pos) FILTER (WHERE gone.pos IS NULL) AS kept
            FROM e LEFT JOIN gone USING (doc_id, pos) GROUP BY doc_id
        )
        SELECT l.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM l LEFT JOIN kept USING (doc_id)
    """,
    "op11_exact_search": """
        WITH e AS (
            SELECT vec_id AS id, min(list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE)))) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id
        ),
        s AS (SELECT q.id AS query_id, c.id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM e q JOIN e c ON q.id <> c.id WHERE q.id % 100 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op12_prefix_trie": f"""
        WITH t AS (
            SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS p,
                   coalesce(role, '') AS role, coalesce(text, '') AS text
            FROM conversations WHERE conv_id IS NOT NULL
        ),
        ids AS (SELECT DISTINCT c, c - c % 20 AS donor, CAST(c AS VARCHAR) AS name FROM t),
        -- crc32 of the decimal: for each byte, the byte and then eight shifts (-1)
        steps AS (SELECT c, donor, flatten(list_transform(string_split(name, ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])) AS ops FROM ids),
        heads AS (
            SELECT c, donor,
                   xor(list_reduce(list_prepend(4294967295, ops), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 4 AS h
            FROM steps
        ),
        turns AS (
            SELECT heads.c, 0 AS own, t.p, role, text FROM heads JOIN t ON t.c = heads.donor AND t.p <= heads.h
            UNION ALL SELECT heads.c, 1, t.p, role, text FROM heads JOIN t ON t.c = heads.c AND t.p > heads.h
        ),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY own, p) AS depth FROM turns),
        chained AS (
            SELECT c, depth, len(regexp_extract_all(text, '{_WORD}')) AS words,
                   sha256(string_agg(md5(role) || md5(text), ',') OVER (PARTITION BY c ORDER BY depth)) AS node
            FROM numbered
        ),
        m AS (SELECT c, depth, words, node FROM chained UNION ALL SELECT c, 0, 0, 'root' FROM ids),
        lasts AS (SELECT c, max(depth) AS depth FROM m GROUP BY c),
        n AS (SELECT node, depth, min(c) AS conv_id, count(*) AS n_convs, max(words) AS words FROM m GROUP BY node, depth),
        up AS (SELECT n.node, p.node AS parent FROM n JOIN m p ON p.c = n.conv_id AND p.depth = n.depth - 1),
        kids AS (SELECT parent AS node, count(*) AS n_children FROM up GROUP BY parent),
        below AS (
            SELECT a.node, sum(CASE WHEN kids.node IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved_tokens
            FROM n JOIN m a ON a.c = n.conv_id AND a.depth <= n.depth LEFT JOIN kids ON kids.node = n.node GROUP BY a.node
        ),
        ends AS (SELECT m.node, string_agg(CAST(m.c AS VARCHAR), ',' ORDER BY m.c) AS ids FROM m JOIN lasts ON lasts.c = m.c AND lasts.depth = m.depth GROUP BY m.node)
        SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs,
               CAST(coalesce(n_children, 0) AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens,
               sha256(coalesce(ids, '')) AS ends_sha256
        FROM n JOIN below ON below.node = n.node LEFT JOIN up ON up.node = n.node LEFT JOIN n p ON p.node = up.parent
        LEFT JOIN kids ON kids.node = n.node LEFT JOIN ends ON ends.node = n.node
    """,
    "op13_hard_negatives": """
        WITH e AS (
            SELECT vec_id AS id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
            FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        s AS (
            SELECT q.id AS anchor_id, c.id, q.label = c.label AS same, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM e q JOIN e c ON q.id <> c.id WHERE q.id % 100 = 0
        ),
        p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 10
    """,
}
