"""Queries with joins and aggregations: language model, gazetteers, evaluation, similarity, feedback, control."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import gazetteer_key, title_key
from ..operators import control as C
from ..operators import evaluate as E
from ..operators import features as X
from ..operators import language_model as G
from ..operators import similarity as S
from ..sources.derived import GOLD_SQL, GUESS_SQL, LINES_SQL, TOKENS_SQL, gold_and_guess, lines, table, tokens

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_KEY_SQL = r"trim(regexp_replace(regexp_replace(lower({}), '\p{{P}}+', ' ', 'g'), '  +', ' ', 'g'))"
_ALNUM_SQL = r"trim(regexp_replace(regexp_replace(strip_accents(lower({})), '[^A-Za-z0-9]', ' ', 'g'), ' +', ' ', 'g'))"

# language model


@query("SELECT token, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS token FROM part) GROUP BY token")
def bow_all(spark, sf_dir):
    return G.bag(table(spark, sf_dir, "part"), "p_name")


@query("SELECT string_split(p_name, ' ')[1] AS token, count(*) AS n FROM part GROUP BY 1")
def bow_first(spark, sf_dir):
    return G.bag(table(spark, sf_dir, "part"), "p_name", "first")


@query("SELECT string_split(p_name, ' ')[-1] AS token, count(*) AS n FROM part GROUP BY 1")
def bow_last(spark, sf_dir):
    return G.bag(table(spark, sf_dir, "part"), "p_name", "last")


@query("SELECT token, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS token FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)) GROUP BY token")
def bow_excluding_ids(spark, sf_dir):
    out = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return G.bag(table(spark, sf_dir, "part").join(out, "p_partkey", "left_anti"), "p_name")


@query("""SELECT tri, count(*) AS n FROM (SELECT unnest(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) AS tri
    FROM (SELECT '^' || unnest(string_split(p_name, ' ')) || '$' AS t FROM part)) GROUP BY tri""")
def trigram_bow(spark, sf_dir):
    toks = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("t"))
    return toks.select(F.explode(X.trigrams(F.col("t"), "^", "$")).alias("tri")).groupBy("tri").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS i, count(*) OVER () AS total FROM orders) WHERE i * 100 // total > (i - 1) * 100 // total")
def background_stride_sample(spark, sf_dir):
    return G.stride_sample(table(spark, sf_dir, "orders").select("o_orderkey"), 100, "o_orderkey")


@query(f"""WITH s AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i, count(*) OVER () AS total FROM documents) WHERE i * 100 // total > (i - 1) * 100 // total)
    SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM ({TOKENS_SQL}) WHERE doc_id IN (SELECT doc_id FROM s) GROUP BY token""")
def background_bow(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sample = G.stride_sample(docs.select("doc_id"), 100, "doc_id")
    toks = tokens(docs.join(sample, "doc_id", "left_semi"))
    per_doc = toks.groupBy("token", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


@query(f"""WITH b AS (SELECT token, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS token FROM part) GROUP BY token)
    SELECT w.token, round(log10(CASE WHEN coalesce(n, 0) > 0 THEN n - 0.6 ELSE 0 END + 0.1), 6) AS freq FROM (SELECT DISTINCT lower(token) AS token FROM ({TOKENS_SQL})) w LEFT JOIN b ON w.token = b.token""")
def smooth_freq(spark, sf_dir):
    bow = G.bag(table(spark, sf_dir, "part"), "p_name")
    words = tokens(table(spark, sf_dir, "documents")).select(F.lower("token").alias("token")).distinct()
    return words.join(bow, "token", "left").select("token", F.round(X.smooth_frequency(F.col("n")), 6).alias("freq"))


# gazetteers

_GAZ_SQL = f"""gaz AS (SELECT DISTINCT gazetteer, {_KEY_SQL.format('entry')} AS key FROM (
    SELECT 'parts' AS gazetteer, p_name AS entry FROM part UNION ALL SELECT 'nations', n_name FROM nation UNION ALL SELECT 'regions', r_name FROM region
    UNION ALL SELECT 'function', unnest(['of the', 'and the', 'in the', 'de la', 'the', '# comment'])) WHERE entry NOT LIKE '#%')"""


def gazetteers(spark, sf_dir):
    entries = table(spark, sf_dir, "part").select(F.lit("parts").alias("gazetteer"), F.col("p_name").alias("entry"))
    entries = entries.union(table(spark, sf_dir, "nation").select(F.lit("nations"), "n_name")).union(table(spark, sf_dir, "region").select(F.lit("regions"), "r_name"))
    words = F.explode(F.array(*map(F.lit, ["of the", "and the", "in the", "de la", "the", "# comment"])))
    return G.gazetteer(entries.union(spark.range(1).select(F.lit("function"), words)))


@query(f"""WITH {_GAZ_SQL}, k AS (SELECT DISTINCT {_KEY_SQL.format('token')} AS key FROM ({TOKENS_SQL}) UNION SELECT {_KEY_SQL.format('p_name')} FROM part)
    SELECT k.key, coalesce(bool_or(gazetteer = 'parts'), FALSE) AS parts, coalesce(bool_or(gazetteer = 'nations'), FALSE) AS nations, coalesce(bool_or(gazetteer = 'function'), FALSE) AS function
    FROM k LEFT JOIN gaz ON k.key = gaz.key GROUP BY k.key""")
def gaz_membership(spark, sf_dir):
    keys = tokens(table(spark, sf_dir, "documents")).select(gazetteer_key("token").alias("key")).union(table(spark, sf_dir, "part").select(gazetteer_key("p_name"))).distinct()
    return G.membership(keys, gazetteers(spark, sf_dir), ["parts", "nations", "function"])


_SPAN_SQL = f"""WITH {_GAZ_SQL}, l AS (SELECT doc_id, line_no, list_filter(string_split(line, ' '), lambda t: t <> '') AS toks FROM ({LINES_SQL})),
    s AS (SELECT doc_id, line_no, toks, i AS start, i + k AS stop FROM l, LATERAL (SELECT unnest(range(0, len(toks))) AS i), range(1, 7) AS t(k) WHERE i + k <= len(toks)),
    f AS (SELECT doc_id, line_no, start, stop, gazetteer FROM (SELECT *, {_KEY_SQL.format("array_to_string(toks[start + 1:stop], ' ')")} AS key FROM s) x JOIN gaz ON x.key = gaz.key)"""


def _spans(spark, sf_dir):
    toks = lines(table(spark, sf_dir, "documents")).select("doc_id", "line_no", F.filter(F.split("line", " "), lambda t: t != "").alias("toks"))
    return G.spans(toks, gazetteers(spark, sf_dir))


@query(f"{_SPAN_SQL} SELECT doc_id, line_no, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, gazetteer FROM f")
def gaz_spans(spark, sf_dir):
    return _spans(spark, sf_dir)


@query(f"""{_SPAN_SQL} SELECT feature, count(*) AS n FROM (SELECT '%gaz_' || CASE WHEN stop - start = 1 THEN 'W' WHEN pos = start THEN 'B' WHEN pos = stop - 1 THEN 'E' ELSE 'I' END || '_' || gazetteer AS feature
    FROM (SELECT *, unnest(range(start, stop)) AS pos FROM f)) GROUP BY feature""")
def gaz_span_labels(spark, sf_dir):
    return G.span_labels(_spans(spark, sf_dir)).groupBy("feature").agg(F.count("*").alias("n"))


def _papers(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", title_key(F.split_part("text", F.lit("\n"), F.lit(1))).alias("key"), "lang")


_PAPER_KEY = "regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(trim(split_part(text, chr(10), 1)))), '&[^;\\n]*;', '', 'g'), '\\.$', ''), '[^A-Za-z0-9_]', '', 'g')"


_KNOWN_SQL = f"WITH p AS (SELECT doc_id, {_PAPER_KEY} AS key, lang FROM documents), k AS (SELECT key, lang FROM p WHERE doc_id IN (SELECT doc_id FROM labels)), u AS (SELECT * FROM p WHERE doc_id NOT IN (SELECT doc_id FROM labels))"


def _known_and_new(spark, sf_dir):
    """Papers with a label are known; the others are looked up among them by key and language."""
    p, ids = _papers(spark, sf_dir), table(spark, sf_dir, "labels").select("doc_id")
    return p.join(ids, "doc_id", "left_semi").select("key", "lang").distinct(), p.join(ids, "doc_id", "left_anti")


@query(f"{_KNOWN_SQL} SELECT doc_id FROM u WHERE EXISTS (SELECT 1 FROM k WHERE k.key = u.key AND k.lang = u.lang)")
def known_papers(spark, sf_dir):
    known, new = _known_and_new(spark, sf_dir)
    return new.join(known, ["key", "lang"], "left_semi").select("doc_id")


@query(f"{_KNOWN_SQL} SELECT doc_id FROM u WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.key = u.key AND k.lang = u.lang)")
def unknown_papers(spark, sf_dir):
    known, new = _known_and_new(spark, sf_dir)
    return new.join(known, ["key", "lang"], "left_anti").select("doc_id")


# evaluation

_COUNTED_SQL = f"""c AS (SELECT paper, item, CAST(sum(a) AS BIGINT) AS in_gold, CAST(sum(b) AS BIGINT) AS in_guess FROM (
    SELECT paper, item, 1 AS a, 0 AS b FROM ({GOLD_SQL}) UNION ALL SELECT paper, item, 0, 1 FROM ({GUESS_SQL})) GROUP BY paper, item)"""
_PR = """CASE WHEN gold = 0 AND guess = 0 THEN 1.0 WHEN gold = 0 OR guess = 0 THEN 0.0 ELSE hits / guess END AS precision,
    CASE WHEN gold = 0 THEN 1.0 WHEN guess = 0 THEN 0.0 ELSE hits / gold END AS recall"""
_MULTI_SQL = f"{_COUNTED_SQL}, s AS (SELECT paper, sum(in_gold) AS gold, sum(in_guess) AS guess, sum(least(in_gold, in_guess)) AS hits FROM c GROUP BY paper), pr AS (SELECT paper, {_PR} FROM s)"
_SET_SQL = f"{_COUNTED_SQL}, s AS (SELECT paper, sum(least(in_gold, 1)) AS gold, sum(least(in_guess, 1)) AS guess, sum(least(in_gold, in_guess, 1)) AS hits FROM c GROUP BY paper), pr AS (SELECT paper, {_PR} FROM s)"
_OUT = "round(precision, 6) AS precision, round(recall, 6) AS recall"


def both(spark, sf_dir):
    return gold_and_guess(table(spark, sf_dir, "events"))


def rounded(d, *keys):
    return d.select(*keys, F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"WITH {_SET_SQL} SELECT paper, {_OUT} FROM pr")
def pr_sets(spark, sf_dir):
    return rounded(E.precision_recall(*both(spark, sf_dir), multiset=False), "paper")


@query(f"WITH {_MULTI_SQL} SELECT paper, {_OUT} FROM pr")
def pr_multiset(spark, sf_dir):
    return rounded(E.precision_recall(*both(spark, sf_dir)), "paper")


@query(f"SELECT paper, item, row_number() OVER (PARTITION BY paper, item) AS k FROM ({GOLD_SQL})")
def occurrence_index(spark, sf_dir):
    return E.with_occurrence(both(spark, sf_dir)[0])


@query(f"WITH {_COUNTED_SQL}, s AS (SELECT paper, sum(in_gold) AS gold, sum(in_guess) AS guess FROM c GROUP BY paper) SELECT paper, 1.0 AS precision, round(CASE WHEN gold = 0 THEN 1.0 ELSE guess / gold END, 6) AS recall FROM s")
def count_metric(spark, sf_dir):
    return rounded(E.count_metric(*both(spark, sf_dir)), "paper")


@query(f"WITH {_MULTI_SQL} SELECT round(avg(coalesce(precision, 0)), 6) AS precision, round(avg(coalesce(recall, 0)), 6) AS recall FROM (SELECT c_custkey AS paper FROM customer) LEFT JOIN pr USING (paper)")
def macro_average(spark, sf_dir):
    papers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("paper"))
    return rounded(E.macro_average(E.precision_recall(*both(spark, sf_dir)), papers))


@query(f"WITH {_COUNTED_SQL} SELECT paper, item, in_gold - in_guess AS n FROM c WHERE in_gold > in_guess")
def missing_items(spark, sf_dir):
    return E.missing(*both(spark, sf_dir))


@query(f"WITH {_COUNTED_SQL} SELECT paper, item, in_guess - in_gold AS n FROM c WHERE in_guess > in_gold")
def excess_items(spark, sf_dir):
    return E.excess(*both(spark, sf_dir))


def _system(spark, sf_dir, parity):
    e = table(spark, sf_dir, "events").filter((F.col("event_id") % 3 == parity) & (F.col("user_id") % 7 != parity))
    return e.groupBy(F.concat_ws("-", "event_type", (F.col("user_id") % 7).cast("string")).alias("metric")).agg(F.round(F.avg("value"), 4).alias("value"))


_SYSTEM_SQL = "SELECT event_type || '-' || user_id % 7 AS metric, round(avg(value), 4) AS value FROM events WHERE event_id % 3 = {p} AND user_id % 7 <> {p} GROUP BY 1"


@query(f"SELECT coalesce(a.metric, b.metric) AS metric, coalesce(a.value, 0) AS a, coalesce(b.value, 0) AS b, round(coalesce(a.value, 0) - coalesce(b.value, 0), 4) AS difference FROM ({_SYSTEM_SQL.format(p=0)}) a FULL JOIN ({_SYSTEM_SQL.format(p=1)}) b ON a.metric = b.metric")
def two_system_report(spark, sf_dir):
    return E.two_system_report(_system(spark, sf_dir, 0), _system(spark, sf_dir, 1)).withColumn("difference", F.round("difference", 4))


@query("SELECT event_type || ':' || json_extract_string(props, '$.k') AS error, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, error LIMIT 10")
def top_errors(spark, sf_dir):
    error = F.concat(F.col("event_type"), F.lit(":"), F.get_json_object("props", "$.k"))
    return table(spark, sf_dir, "events").groupBy(error.alias("error")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error").limit(10)


@query(f"SELECT round(avg(CAST(a.key = b.key AS INTEGER)), 6) AS accuracy FROM (SELECT doc_id, {_PAPER_KEY} AS key FROM documents) a JOIN (SELECT doc_id - 1 AS doc_id, {_PAPER_KEY} AS key FROM documents) b USING (doc_id)")
def title_accuracy(spark, sf_dir):
    a = _papers(spark, sf_dir)
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("key").alias("other"))
    return a.join(b, "doc_id").agg(F.round(F.avg((F.col("key") == F.col("other")).cast("int")), 6).alias("accuracy"))


_GRAMS_SQL = "list_distinct(list_concat(list_transform(range(1, length({c})), lambda i: substr({c}, i, 2)), list_transform(range(1, length({c}) - 1), lambda i: substr({c}, i, 3))))"


@query(f"""WITH p AS (SELECT p_size AS paper, p_partkey, p_name AS item FROM part), a AS (SELECT DISTINCT paper, item, {_GRAMS_SQL.format(c='item')} AS g FROM p WHERE p_partkey % 2 = 0), b AS (SELECT DISTINCT paper, item, {_GRAMS_SQL.format(c='item')} AS h FROM p WHERE p_partkey % 2 = 1)
    SELECT a.paper, a.item AS gold, b.item AS guess, round(len(list_intersect(g, h)) / greatest(len(g), len(h)), 6) AS score FROM a JOIN b ON a.paper = b.paper WHERE len(list_intersect(g, h)) / greatest(len(g), len(h)) >= 0.5""")
def error_pairs(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_size").alias("paper"), "p_partkey", F.col("p_name").alias("item"))
    a, b = (p.filter(F.col("p_partkey") % 2 == k).select("paper", "item").distinct() for k in (0, 1))
    return E.error_pairs(a, b).withColumn("score", F.round("score", 6))


# sources and control


@query("SELECT doc_id AS id, coalesce(CASE WHEN doc_id % 3 = 0 THEN lang END, CASE WHEN doc_id % 3 = 1 THEN source END, 'none') AS content FROM documents")
def fallback_source(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    pick = lambda k, c: d.filter(F.col("doc_id") % 3 == k).select(F.col("doc_id").alias("id"), c.alias("content"))
    return C.fallback(d.select(F.col("doc_id").alias("id")), pick(0, F.col("lang")), pick(1, F.col("source")), pick(2, F.lit("none")))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.05)")
def resume_anti(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").filter("l_discount > 0.05").select(F.col("l_orderkey").alias("o_orderkey"))
    return C.resume(table(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")


@query("""SELECT coalesce(a.id, b.id, c.id) AS id, a.lang, b.source, c.quality FROM (SELECT doc_id AS id, lang FROM documents WHERE doc_id % 2 = 0) a
    FULL JOIN (SELECT doc_id AS id, source FROM documents WHERE doc_id % 3 = 0) b ON a.id = b.id FULL JOIN (SELECT doc_id AS id, quality FROM labels) c ON coalesce(a.id, b.id) = c.id""")
def gold_union_keys(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id")
    quality = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality")
    return C.union_of_keys(d.filter("id % 2 = 0").select("id", "lang"), d.filter("id % 3 = 0").select("id", "source"), quality)


@query("SELECT event_id, coalesce(r.fresh, e.event_type) AS event_type FROM events e LEFT JOIN (SELECT 'error' AS old, 'failure' AS fresh UNION ALL SELECT 'click', 'press') r ON e.event_type = r.old")
def gold_replace(spark, sf_dir):
    repl = spark.createDataFrame([("error", "failure"), ("click", "press")], "old string, new string")
    return C.replace_values(table(spark, sf_dir, "events").select("event_id", "event_type"), repl, "event_type")


@query("""SELECT k, source, turn FROM (SELECT c_custkey AS k, 0 AS source, row_number() OVER (ORDER BY c_custkey) AS turn FROM customer UNION ALL
    SELECT s_suppkey, 1, row_number() OVER (ORDER BY s_suppkey) FROM supplier UNION ALL SELECT n_nationkey, 2, row_number() OVER (ORDER BY n_nationkey) FROM nation)""")
def interleave(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    c = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    return C.interleave(a, b, c, order="k")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50 OFFSET 1000")
def drop_take(spark, sf_dir):
    return C.drop_take(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 1000, 50, "o_totalprice", "o_orderkey")


@query("SELECT doc_id, ('0x' || left(md5(CAST(doc_id AS VARCHAR)), 8))::BIGINT < 3865470566 AS train FROM documents")
def hash_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.hash_split(F.col("doc_id"), 0.9).alias("train"))


@query("SELECT regexp_replace(trim(p_name), '\\s+', ' ', 'g') AS title, p_partkey FROM part WHERE p_name IS NOT NULL AND p_brand IS NOT NULL ORDER BY p_partkey LIMIT 1000 OFFSET 100")
def gazetteer_export(spark, sf_dir):
    kept = table(spark, sf_dir, "part").na.drop(subset=["p_name", "p_brand"]).select(F.regexp_replace(F.trim("p_name"), r"\s+", " ").alias("title"), "p_partkey")
    return C.drop_take(kept, 100, 1000, "p_partkey")


@query("SELECT doc_id FROM documents WHERE len(list_filter(string_split(text, chr(10)), lambda l: NOT (trim(l) <> '' AND regexp_matches(l, '[A-Za-z]')))) = 0")
def clean_papers(spark, sf_dir):
    ok = F.forall(F.split("text", "\n"), lambda l: (F.trim(l) != "") & l.rlike("[A-Za-z]"))
    return table(spark, sf_dir, "documents").filter(ok).select("doc_id")


# similarity

_WORDS = f"list_filter(string_split({_ALNUM_SQL.format('t')}, ' '), lambda w: w <> '')[1:40]"
_TITLE_WORDS = f"tw AS (SELECT doc_id, {_WORDS} AS ws FROM (SELECT doc_id, split_part(text, chr(10), 1) AS t FROM documents))"
_GRAMS3 = "CASE WHEN len(ws) >= {n} THEN list_transform(range(1, len(ws) - {n} + 2), lambda i: array_to_string(ws[i:i + {n} - 1], '_')) WHEN len(ws) > 0 THEN [array_to_string(ws, '_')] ELSE [] END"


def titles(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("t"))


@query(f"WITH {_TITLE_WORDS} SELECT doc_id AS id, ({_GRAMS3.format(n=3)})[1] AS bucket FROM tw WHERE len(ws) > 0")
def word_ngrams(spark, sf_dir):
    return S.buckets(titles(spark, sf_dir), "doc_id", F.col("t"), 3)


@query(f"WITH {_TITLE_WORDS} SELECT doc_id AS id, unnest(({_GRAMS3.format(n=3)})[1:2]) AS bucket FROM (SELECT doc_id, list_reverse(ws) AS ws FROM tw) WHERE len(ws) > 0")
def tail_ngrams(spark, sf_dir):
    return S.buckets(titles(spark, sf_dir), "doc_id", F.col("t"), 3, reverse=True, upto=2)


@query(f"""WITH {_TITLE_WORDS}, g AS (SELECT doc_id AS id, unnest({_GRAMS3.format(n=2)}) AS bucket, generate_subscripts({_GRAMS3.format(n=2)}, 1) AS place FROM tw),
    f AS (SELECT bucket FROM g GROUP BY bucket HAVING count(*) >= 20), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY place) AS k FROM g WHERE bucket NOT IN (SELECT bucket FROM f))
    SELECT id, bucket FROM k WHERE k <= 3""")
def highfreq_cut(spark, sf_dir):
    t = titles(spark, sf_dir)
    # words in a column of their own: inside the windows' lambda they would be made anew for each window
    freq = t.select(S.words(F.col("t")).alias("ws")).select(F.explode(S.word_ngrams(F.col("ws"), 2)).alias("ngram")).groupBy("ngram").agg(F.count("*").alias("freq"))
    return S.buckets(t, "doc_id", F.col("t"), 2, frequent=freq, cutoff=20, upto=3)


_SETS = "SELECT item_id, list_distinct(string_split(text, ' ')) AS s FROM benchmark"


@query(f"SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) AS jaccard, round(len(list_intersect(a.s, b.s)) / least(len(a.s), len(b.s)), 6) AS containment FROM ({_SETS}) a JOIN ({_SETS}) b ON b.item_id = a.item_id + 1")
def set_similarity(spark, sf_dir):
    s = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(F.split("text", " ")).alias("s"))
    a, b = s.select(F.col("item_id").alias("a"), F.col("s").alias("x")), s.select((F.col("item_id") - 1).alias("a"), F.col("item_id").alias("b"), F.col("s").alias("y"))
    return a.join(b, "a").select("a", "b", F.round(S.jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"), F.round(S.containment(F.col("x"), F.col("y")), 6).alias("containment"))


_CHARS = "list_distinct(list_transform(range(1, greatest(length(t) - 1, 2)), lambda i: substr(t, i, 3)))"
_SIM = "(len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) + f * len(list_intersect(a.g, b.g)) / least(len(a.g), len(b.g))) / (1 + f)"


@query(f"""WITH g AS (SELECT item_id, {_CHARS} AS g FROM (SELECT item_id, text AS t FROM benchmark))
    SELECT a.item_id AS a, b.item_id AS b, round({_SIM}, 6) AS score FROM g a JOIN g b ON b.item_id = a.item_id + 1, LATERAL (SELECT least(pow(1.2, least(len(a.g), len(b.g)) - 10), 100000.0) AS f)""")
def ngram_similarity(spark, sf_dir):
    s = table(spark, sf_dir, "benchmark").select("item_id", S.char_grams(F.col("text")).alias("s"))
    a, b = s.select(F.col("item_id").alias("a"), F.col("s").alias("x")), s.select((F.col("item_id") - 1).alias("a"), F.col("item_id").alias("b"), F.col("s").alias("y"))
    return a.join(b, "a").select("a", "b", F.round(S.ngram_similarity(F.col("x"), F.col("y")), 6).alias("score"))


@query("""SELECT a.p_partkey AS a, b.p_partkey AS b, CASE WHEN starts_with(a.t, b.t) OR starts_with(b.t, a.t) OR ends_with(a.t, b.t) OR ends_with(b.t, a.t) THEN round(w / (w + 0.5), 6) END AS score
    FROM (SELECT p_partkey, p_name AS t FROM part) a JOIN (SELECT p_partkey, split_part(p_name, ' ', CAST(1 + p_partkey % 2 AS INTEGER)) AS t FROM part) b ON a.p_partkey = b.p_partkey,
    LATERAL (SELECT len(string_split(CASE WHEN length(a.t) <= length(b.t) THEN a.t ELSE b.t END, ' ')) AS w)""")
def prefix_suffix_score(spark, sf_dir):
    part = F.get(F.split("p_name", " "), (F.col("p_partkey") % 2).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("a"), F.col("p_partkey").alias("b"), F.round(S.prefix_suffix(F.col("p_name"), part), 6).alias("score"))


_REFS = "SELECT p_size AS paper, p_partkey AS id, p_name || ' ' || lower(p_type) || ' ' || lower(replace(p_brand, '#', ' ')) AS title, [p_name, lower(p_type) || ' x'] AS authors, 1970 + p_partkey % 50 AS year FROM part"


def _refs(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    title = F.concat_ws(" ", "p_name", F.lower("p_type"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(" "))))
    refs = p.select(F.col("p_size").alias("paper"), F.col("p_partkey").alias("id"), title.alias("title"), F.array("p_name", F.concat(F.lower("p_type"), F.lit(" x"))).alias("authors"), (1970 + F.pmod("p_partkey", F.lit(50))).alias("year"))
    return refs.filter("id % 2 = 0"), refs.filter("id % 2 = 1")


def _fuzzy_sql(out: str) -> str:
    norm = r"trim(regexp_replace(regexp_replace(strip_accents(lower(title)), '\p{P}', ' ', 'g'), ' +', ' ', 'g'))"
    return f"""WITH r AS ({_REFS}), n AS (
            SELECT *, list_distinct(list_transform(range(1, greatest(length(nt) - 1, 2)), lambda i: substr(nt, i, 3))) AS g, list_distinct(ls) AS l,
                list_distinct(list_concat(CASE WHEN len(sh) >= 3 THEN list_transform(range(1, len(sh) - 1), lambda i: 't:' || array_to_string(sh[i:i + 2], '_')) ELSE [] END,
                    CASE WHEN len(ls) >= 3 THEN list_transform(range(1, len(ls) - 1), lambda i: 'a:' || array_to_string(ls[i:i + 2], '_')) ELSE ['a:' || array_to_string(ls, '_')] END)) AS keys
            FROM (SELECT *, {norm} AS nt, list_transform(authors, lambda a: regexp_replace(lower(string_split(a, ' ')[-1]), '[^a-z]', '', 'g')) AS ls,
                list_transform(list_filter(string_split({_ALNUM_SQL.format('title')}, ' '), lambda w: w <> ''), lambda w: left(w, 3)) AS sh FROM r)),
        c AS (SELECT DISTINCT a.paper, a.id AS guess_id, b.id AS gold_id FROM (SELECT *, unnest(keys) AS key FROM n WHERE id % 2 = 1) a JOIN (SELECT *, unnest(keys) AS key FROM n WHERE id % 2 = 0) b ON a.paper = b.paper AND a.key = b.key),
        s AS (SELECT c.*, {_SIM} AS t, len(list_intersect(a.l, b.l)) / len(list_distinct(list_concat(a.l, b.l))) AS j, a.year = b.year AS same
            FROM c JOIN n a ON a.id = c.guess_id JOIN n b ON b.id = c.gold_id, LATERAL (SELECT least(pow(1.2, least(len(a.g), len(b.g)) - 10), 100000.0) AS f)),
        k AS (SELECT *, CASE WHEN t > 0.8 THEN greatest(t, CASE WHEN same THEN j - 0.01 ELSE 0.0 END) ELSE t END AS score FROM s),
        m AS (SELECT *, row_number() OVER (PARTITION BY paper, guess_id ORDER BY round(score, 9) DESC, gold_id) AS place FROM k WHERE score > 0.94) {out}"""


@query(_fuzzy_sql("SELECT paper, guess_id, gold_id, round(score, 6) AS score FROM m WHERE place = 1"))
def fuzzy_match(spark, sf_dir):
    return S.fuzzy_match(*_refs(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(_fuzzy_sql("SELECT r.paper, r.id FROM r WHERE id % 2 = 0 AND id NOT IN (SELECT gold_id FROM m WHERE place = 1)"))
def fuzzy_unmatched(spark, sf_dir):
    gold, guess = _refs(spark, sf_dir)
    return gold.select("paper", "id").join(S.fuzzy_match(gold, guess).select(F.col("gold_id").alias("id")).distinct(), "id", "left_anti").select("paper", "id")


@query(_fuzzy_sql("""SELECT q.paper, round(coalesce(total, 0) / guesses, 6) AS precision, round(coalesce(total, 0) / golds, 6) AS recall FROM (
    SELECT paper, count(*) FILTER (WHERE id % 2 = 1) AS guesses, count(*) FILTER (WHERE id % 2 = 0) AS golds FROM r GROUP BY paper) q LEFT JOIN (SELECT paper, sum(score) AS total FROM m WHERE place = 1 GROUP BY paper) x ON q.paper = x.paper WHERE guesses > 0 AND golds > 0"""))
def fuzzy_precision_recall(spark, sf_dir):
    """Sum of the best scores by the number of guesses and of gold references (in the usual sense of both ratios)."""
    gold, guess = _refs(spark, sf_dir)
    n = gold.groupBy("paper").agg(F.count("*").alias("golds")).join(guess.groupBy("paper").agg(F.count("*").alias("guesses")), "paper")
    total = S.fuzzy_match(gold, guess).groupBy("paper").agg(F.sum("score").alias("total"))
    ratio = lambda c: F.round(F.coalesce("total", F.lit(0.0)) / F.col(c), 6)
    return n.join(total, "paper", "left").select("paper", ratio("guesses").alias("precision"), ratio("golds").alias("recall"))


# feedback and serialisation


def log(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("paper_id"), F.col("ts").alias("time_added"), "event_id", F.col("props").alias("value"))


_LATEST_SQL = "SELECT user_id AS paper_id, ts AS time_added, event_id, props AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


@query(f"SELECT paper_id, event_id, value FROM ({_LATEST_SQL})")
def latest_per_key(spark, sf_dir):
    return C.latest_per_key(log(spark, sf_dir), "paper_id", "time_added", "event_id").select("paper_id", "event_id", "value")


@query("SELECT event_id, props AS value FROM events WHERE user_id = 8 ORDER BY ts DESC, event_id DESC LIMIT 1")
def latest_one_key(spark, sf_dir):
    return log(spark, sf_dir).filter("paper_id = 8").orderBy(F.desc("time_added"), F.desc("event_id")).limit(1).select("event_id", "value")


@query(f"SELECT paper_id, event_id, value FROM ({_LATEST_SQL}) WHERE time_added >= TIMESTAMP '2024-01-30' AND time_added < TIMESTAMP '2024-02-01'")
def latest_in_window(spark, sf_dir):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return C.latest_in_window(log(spark, sf_dir), "paper_id", "time_added", at("2024-01-30"), at("2024-02-01"), "event_id").select("paper_id", "event_id", "value")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, '{\"k\":' || json_extract_string(props, '$.k') || ',\"type\":\"' || event_type || '\",\"missing\":null}' AS again FROM events")
def json_roundtrip(spark, sf_dir):
    parsed = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k int"))
    out = F.to_json(F.struct(F.col("p.k").alias("k"), F.col("event_type").alias("type"), F.lit(None).cast("string").alias("missing")), {"ignoreNullFields": "false"})
    return parsed.select("event_id", F.col("p.k").alias("k"), out.alias("again"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS heading, len(regexp_extract_all(html, '<p>')) AS paragraphs, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang FROM pages")
def page_structure(spark, sf_dir):
    x = lambda p: F.regexp_extract("html", p, 1)
    return table(spark, sf_dir, "pages").select("page_id", x("<title>([^<]*)</title>").alias("title"), x("<h1>([^<]*)</h1>").alias("heading"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("paragraphs"), x('<html lang="([a-z]+)"').alias("lang"))

