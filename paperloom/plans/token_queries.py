"""Queries over tokens and layout, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import layout as L
from ..sources.derived import GEOMETRY_SQL, LINES_SQL, TOKENS_SQL, line_tokens, lines, references, references_sql, table, tokens, with_geometry

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def toks(spark, sf_dir):
    return tokens(table(spark, sf_dir, "documents"))


def words(spark, sf_dir):
    return toks(spark, sf_dir).select("token").distinct()


_WORDS_SQL = f"SELECT DISTINCT token FROM ({TOKENS_SQL})"
_SEQ_SQL = f"SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, pos) AS seq, count(*) OVER (PARTITION BY doc_id) AS total FROM ({TOKENS_SQL})"


@query(TOKENS_SQL)
def tokens_flat(spark, sf_dir):
    return toks(spark, sf_dir)


@query(f"""WITH s AS (SELECT doc_id, token, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, pos) AS seq FROM ({TOKENS_SQL})), h AS (SELECT * FROM s WHERE seq <= 500),
    e AS (SELECT doc_id, max(seq) AS n FROM h GROUP BY doc_id)
    SELECT doc_id, seq, token FROM h UNION ALL SELECT doc_id, 0, NULL FROM e UNION ALL SELECT doc_id, n + 1, NULL FROM e""")
def header_cut(spark, sf_dir):
    return X.with_sentinels(X.sequence_of(toks(spark, sf_dir), 500))


_MASK_SQL = ", ".join(f"CASE WHEN regexp_full_match(token, '{p}', 's') THEN '{n}' END" for n, p in X.CASE_MASKS.items())


@query(f"SELECT token, array_to_string(list_filter([{_MASK_SQL}], lambda x: x IS NOT NULL), ',') AS masks FROM ({_WORDS_SQL})")
def case_masks(spark, sf_dir):
    return words(spark, sf_dir).select("token", F.array_join(X.case_masks(F.col("token")), ",").alias("masks"))


_STOP_SQL = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


@query(f"SELECT token, token IN ({_STOP_SQL}) AS stop, token NOT IN ({_STOP_SQL}) AND regexp_full_match(token, '[a-z]+') AS uncapns, token IN ('and', ',') AS is_and FROM ({_WORDS_SQL})")
def stopword_flags(spark, sf_dir):
    return words(spark, sf_dir).select("token", *X.stop_flags(F.col("token")))


@query(f"SELECT token, round(least(length(token), 10) / 10.0, 6) AS adj_len, round((least(length(token), 10) / 10.0 - 0.5) ** 2, 6) AS adj_len_sq FROM ({_WORDS_SQL})")
def adjusted_length(spark, sf_dir):
    n, sq = X.length_features(F.col("token"))
    return words(spark, sf_dir).select("token", F.round(n, 6).alias("adj_len"), F.round(sq, 6).alias("adj_len_sq"))


def _flags_sql(patterns: dict[str, str]) -> str:
    return ", ".join(f"regexp_matches(token, '{p}') AS \"{n.strip('%')}\"" for n, p in patterns.items())


@query(f"SELECT token, {_flags_sql(X.PUNCTUATION)} FROM ({_WORDS_SQL})")
def punct_features(spark, sf_dir):
    return words(spark, sf_dir).select("token", *X.pattern_flags(F.col("token"), X.PUNCTUATION))


@query(f"SELECT token, {_flags_sql(X.NUMBERS)}, CASE WHEN regexp_matches(token, '^[0-9]+\\p{{P}}?$') THEN CAST(least(length(token), 5) AS INTEGER) END AS digits FROM ({_WORDS_SQL})")
def number_features(spark, sf_dir):
    return words(spark, sf_dir).select("token", *X.pattern_flags(F.col("token"), X.NUMBERS), X.digit_length(F.col("token")).alias("digits"))


@query(f"SELECT token, regexp_replace(lower(token), '\\p{{P}}', '', 'g') AS no_punct, left(token, 4) AS prefix, right(token, 4) AS suffix FROM ({_WORDS_SQL})")
def token_affixes(spark, sf_dir):
    return words(spark, sf_dir).select("token", *X.affixes(F.col("token")))


@query(f"""SELECT tri, count(*) AS n FROM (SELECT unnest(list_transform(range(1, length(token || '$') - 1), lambda i: substr(token || '$', i, 3))) AS tri FROM ({TOKENS_SQL}))
    GROUP BY tri""")
def char_trigrams(spark, sf_dir):
    return toks(spark, sf_dir).select(F.explode(X.trigrams(F.col("token"))).alias("tri")).groupBy("tri").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, seq, CAST((12 * (seq - 1)) // total AS INTEGER) AS bin FROM ({_SEQ_SQL})")
def location_bins(spark, sf_dir):
    return X.sequence_of(toks(spark, sf_dir)).select("doc_id", "seq", X.location_bin(F.col("seq"), F.col("total")).alias("bin"))


@query(f"SELECT doc_id, max(lower(replace(token, ',', '')) IN ('eds.', 'ed.', 'editor', 'editors')) AS editor, min(line_no <= 2)::BOOLEAN AS top FROM ({TOKENS_SQL}) GROUP BY doc_id")
def editor_flag(spark, sf_dir):
    return toks(spark, sf_dir).groupBy("doc_id").agg(F.max(X.has_editor(F.col("token"))).alias("editor"), F.min(F.col("line_no") <= 2).alias("top"))


_CHANGE_SQL = ", ".join(
    f"coalesce(lag({c}) OVER w <> {c}, TRUE) AS {n}_cb, coalesce(lead({c}) OVER w <> {c}, TRUE) AS {n}_cf" for n, c in (("font", "font"), ("line", "line_no"), ("h", "(y1 - y0)"))
)


@query(f"""SELECT doc_id, line_no, pos, {_CHANGE_SQL}, round(coalesce(CASE WHEN y0 > lag(y1) OVER w THEN ln(1 + y0 - lag(y1) OVER w) ELSE 0.0 END, 0.0), 6) AS gap_b,
    round(coalesce(CASE WHEN lead(y0) OVER w > y1 THEN ln(1 + lead(y0) OVER w - y1) ELSE 0.0 END, 0.0), 6) AS gap_f
    FROM ({GEOMETRY_SQL}) WINDOW w AS (PARTITION BY doc_id ORDER BY line_no, pos)""")
def change_features(spark, sf_dir):
    out = X.change_features(with_geometry(toks(spark, sf_dir)))
    return out.select("doc_id", "line_no", "pos", *[f"{n}_{d}" for n in ("font", "line", "h") for d in ("cb", "cf")], *[F.round(c, 6).alias(c) for c in ("gap_b", "gap_f")])


@query(f"""SELECT doc_id, line_no, pos, round(CASE WHEN max(font) OVER w = min(font) OVER w THEN 0.5 ELSE (font - min(font) OVER w) / (max(font) OVER w - min(font) OVER w) END, 6) AS font,
    round(CASE WHEN max(x1 - x0) OVER w = min(x1 - x0) OVER w THEN 0.5 ELSE (x1 - x0 - min(x1 - x0) OVER w) / (max(x1 - x0) OVER w - min(x1 - x0) OVER w) END, 6) AS width
    FROM ({GEOMETRY_SQL}) WINDOW w AS (PARTITION BY doc_id)""")
def minmax_font(spark, sf_dir):
    g = with_geometry(toks(spark, sf_dir)).withColumn("width", F.col("x1") - F.col("x0"))
    return g.select("doc_id", "line_no", "pos", F.round(X.min_max("font"), 6).alias("font"), F.round(X.min_max("width"), 6).alias("width"))


# layout

_BOUNDS_SQL = f"""SELECT doc_id, line_no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, avg(font) AS font, max(y1) - min(y0) AS height,
    string_agg(token, ' ' ORDER BY pos) AS line FROM ({GEOMETRY_SQL}) GROUP BY doc_id, line_no"""
_BREAKS_SQL = f"""SELECT *, coalesce((y0 - lag(y1) OVER w) / least(height, lag(height) OVER w), 0.0) AS brk FROM ({_BOUNDS_SQL}) WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)"""


def _threshold_sql(a: int, b: int) -> str:
    return f"""SELECT d.doc_id, coalesce(t.brk, 1.0) AS threshold FROM (SELECT DISTINCT doc_id FROM br) d LEFT JOIN (
        SELECT doc_id, brk FROM (SELECT doc_id, brk, row_number() OVER (PARTITION BY doc_id ORDER BY brk, line_no) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS n
        FROM br WHERE brk > 0) WHERE k = n * {a} // {b}) t ON d.doc_id = t.doc_id"""


_BLOCKS_SQL = f"""br AS ({_BREAKS_SQL}), th AS ({_threshold_sql(7, 9)}),
    bl AS (SELECT br.doc_id, line_no, line, sum(CASE WHEN brk > threshold THEN 1 ELSE 0 END) OVER (PARTITION BY br.doc_id ORDER BY line_no) AS block FROM br JOIN th ON br.doc_id = th.doc_id),
    blocks AS (SELECT doc_id, CAST(block AS BIGINT) AS block, count(*) AS n_lines, string_agg(line, '<lb>' ORDER BY line_no) AS block_text FROM bl GROUP BY doc_id, block)"""


def bounds(spark, sf_dir):
    return L.bounds_of_rows(line_tokens(table(spark, sf_dir, "documents")))


def the_blocks(spark, sf_dir):
    return L.blocks(L.with_threshold(L.breaks(bounds(spark, sf_dir))))


@query(_BOUNDS_SQL)
def line_bounds(spark, sf_dir):
    return bounds(spark, sf_dir)


@query(f"SELECT doc_id, line_no, round(brk, 6) AS brk FROM ({_BREAKS_SQL})")
def line_breaks(spark, sf_dir):
    return L.breaks(bounds(spark, sf_dir)).select("doc_id", "line_no", F.round("brk", 6).alias("brk"))


@query(f"WITH br AS ({_BREAKS_SQL}), a AS ({_threshold_sql(7, 9)}), b AS ({_threshold_sql(3, 6)}) SELECT a.doc_id, round(a.threshold, 6) AS raw, round(CASE WHEN EXISTS (SELECT 1 FROM br WHERE br.doc_id = a.doc_id AND brk > 0) THEN b.threshold + 0.5 ELSE 1.0 END, 6) AS first_page FROM a JOIN b ON a.doc_id = b.doc_id")
def break_quantile(spark, sf_dir):
    br = L.breaks(bounds(spark, sf_dir))
    first = L.break_threshold(br, 3, 6, 0.5).withColumnRenamed("threshold", "t2")
    return L.break_threshold(br).join(first, "doc_id").select("doc_id", F.round("threshold", 6).alias("raw"), F.round("t2", 6).alias("first_page"))


@query(f"WITH {_BLOCKS_SQL} SELECT * FROM blocks")
def text_blocks(spark, sf_dir):
    return the_blocks(spark, sf_dir)


_FIRST_SQL = """first AS (SELECT d.doc_id, coalesce(f.block_text, '') AS first_block FROM (SELECT DISTINCT doc_id FROM blocks) d LEFT JOIN (
    SELECT doc_id, arg_min(block_text, block) AS block_text FROM (SELECT *, lead(block) OVER (PARTITION BY doc_id ORDER BY block) AS nxt FROM blocks)
    WHERE length(block_text) > 400 AND nxt IS NOT NULL GROUP BY doc_id) f ON d.doc_id = f.doc_id)"""


@query(f"WITH {_BLOCKS_SQL}, {_FIRST_SQL} SELECT * FROM first")
def first_block(spark, sf_dir):
    return L.first_text_block(the_blocks(spark, sf_dir))


def _abstract_sql() -> str:
    c = "coalesce(found, other)"
    for tail in L.ABSTRACT_TAILS:
        c = f"regexp_replace({c}, '{tail}', '')"
    return f"""WITH {_BLOCKS_SQL}, {_FIRST_SQL}, pl AS (SELECT *, replace(block_text, '<lb>', ' ') AS b FROM blocks),
        st AS (SELECT doc_id, min(block) AS start FROM pl WHERE regexp_matches(b, '(?i)^abstract ?\\p{{P}}?') GROUP BY doc_id),
        af AS (SELECT pl.*, start, min(CASE WHEN block > start AND length(b) < 20 THEN block END) OVER (PARTITION BY pl.doc_id) AS stop FROM pl JOIN st ON pl.doc_id = st.doc_id WHERE block >= start),
        fo AS (SELECT doc_id, string_agg(trim(CASE WHEN block = start THEN regexp_replace(b, '(?i)^abstract ?\\p{{P}}?', '') ELSE b END), ' ' ORDER BY block) AS found FROM af WHERE stop IS NULL OR block < stop GROUP BY doc_id)
        SELECT doc_id, trim(replace({c}, '- ', '')) AS abstract FROM (
            SELECT f.doc_id, found, regexp_replace(replace(first_block, '<lb>', ' '), '(?i)^summary ?\\p{{P}}?', '') AS other FROM first f LEFT JOIN fo ON f.doc_id = fo.doc_id)"""


@query(_abstract_sql())
def abstracts(spark, sf_dir):
    b = the_blocks(spark, sf_dir)
    return L.abstracts(b, L.first_text_block(b))


@query(f"""SELECT doc_id, max(c) + 1 AS columns, max(n) AS largest FROM (SELECT doc_id, c, count(*) AS n FROM (
    SELECT doc_id, sum(t) OVER (PARTITION BY doc_id ORDER BY pos, line_no) AS c FROM (
        SELECT *, CASE WHEN y0 < lag(y0) OVER (PARTITION BY doc_id ORDER BY pos, line_no) THEN 1 ELSE 0 END AS t FROM ({GEOMETRY_SQL})))
    GROUP BY doc_id, c) GROUP BY doc_id""")
def column_runs(spark, sf_dir):
    from pyspark.sql import Window

    g = with_geometry(toks(spark, sf_dir)).withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "line_no")))
    return L.columns(g).groupBy("doc_id").agg((F.max("column") + 1).alias("columns"), F.max("n").alias("largest"))


@query(f"""SELECT doc_id, seq, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY seq) AS line FROM (
    SELECT doc_id, seq, coalesce(y0 < lag(y1) OVER w AND lag(y0) OVER w < y1 AND x0 - lag(x1) OVER w BETWEEN 0 AND 4 * font, FALSE) AS same
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, pos) AS seq FROM ({GEOMETRY_SQL})) WINDOW w AS (PARTITION BY doc_id ORDER BY seq))""")
def token_lines(spark, sf_dir):
    g = X.sequence_of(with_geometry(toks(spark, sf_dir)))
    return L.new_lines(g).select("doc_id", "seq", "line")


@query(f"""SELECT doc_id, min(CASE WHEN lower(regexp_replace(string_split(trim(line), ' ')[-1], '\\p{{P}}', '', 'g')) IN ('references', 'citations', 'bibliography', 'reference', 'bibliographie')
    AND len(string_split(trim(line), ' ')) < 5 THEN line_no END) AS heading FROM (SELECT doc_id, line_no, replace(replace(line, 'the.', 'References'), 'de.', 'Bibliography:') AS line FROM ({LINES_SQL})) GROUP BY doc_id""")
def reference_heading(spark, sf_dir):
    line = F.replace(F.replace("line", F.lit("the."), F.lit("References")), F.lit("de."), F.lit("Bibliography:"))
    return L.reference_heading(lines(table(spark, sf_dir, "documents")).withColumn("line", line))


@query(f"""WITH l AS (SELECT section, 2 * n + k AS line_no, CASE WHEN k = 0 THEN entry ELSE 'continued' END AS line FROM ({references_sql("bracket")}), range(2) AS t(k)),
    s AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^[0-9]{{1,2}}(\\.|\\s|$)|^\\[.+?\\]') THEN 1 ELSE 0 END) OVER (PARTITION BY section ORDER BY line_no) AS st FROM l),
    k AS (SELECT *, (row_number() OVER (PARTITION BY section, st ORDER BY line_no) - 1) // 6 AS part FROM s)
    SELECT section, min(line_no) AS line_no, string_agg(line, '<lb>' ORDER BY line_no) AS entry FROM k GROUP BY section, st, part""")
def reference_entries(spark, sf_dir):
    refs = references(table(spark, sf_dir, "part"), "bracket")
    both = refs.select("section", F.posexplode(F.array("entry", F.lit("continued"))).alias("k", "line"), "n").select("section", (2 * F.col("n") + F.col("k")).cast("long").alias("line_no"), "line")
    return L.reference_entries(both)


@query(f"""SELECT doc_id, string_agg(line, ' ' ORDER BY line_no) AS title FROM (
    SELECT *, min(run) OVER (PARTITION BY doc_id) AS first FROM (
        SELECT *, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM (SELECT *, max(font) OVER (PARTITION BY doc_id) AS most FROM ({_BOUNDS_SQL})) WHERE font = most))
    WHERE run = first GROUP BY doc_id""")
def heuristic_title(spark, sf_dir):
    return L.heuristic_title(bounds(spark, sf_dir))


@query(r"""SELECT doc_id, regexp_matches(t, '(?i)\.(pdf|doc|docx|tex|dvi|ps)$') OR regexp_matches(t, '(?i)proceedings of') OR regexp_matches(t, '(?i)arxiv:') OR NOT regexp_matches(t, '(^|\s)\p{Lu}') AS bad
    FROM (SELECT doc_id, split_part(text, chr(10), 1) AS t FROM documents)""")
def bad_titles(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", L.bad_title(F.split_part("text", F.lit("\n"), F.lit(1))).alias("bad"))
