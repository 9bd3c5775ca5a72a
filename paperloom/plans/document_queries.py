"""Queries over references, citations, label sequences and whole documents, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bibliography as B
from ..operators import evaluate as E
from ..operators import features as X
from ..operators import layout as L
from ..operators import sequence as Q
from ..sources.derived import TOKENS_SQL, references, references_sql, table, tokens
from .extract import extract, precedence

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _titles_sql(c: str = "text") -> str:
    return f"regexp_replace(regexp_replace(strip_accents(split_part({c}, chr(10), 1)), '&[^;\\n]*;', '', 'g'), '\\.$', '')"


@query(f"""WITH m AS (SELECT doc_id, string_agg(token, ' ' ORDER BY line_no, pos) AS emails FROM ({TOKENS_SQL}) WHERE regexp_full_match(token, '[^@]+@[^@]+') GROUP BY doc_id),
    t AS (SELECT doc_id, count(*) AS n_tokens FROM ({TOKENS_SQL}) GROUP BY doc_id),
    y AS (SELECT doc_id, text, list_transform(regexp_extract_all(text, '[1-2][0-9][0-9][0-9]'), lambda y: CAST(y AS INTEGER)) AS ys FROM documents)
    SELECT y.doc_id, {_titles_sql()} AS title, coalesce(emails, '') AS emails, coalesce(list_filter(ys, lambda y: y > 1800 AND y < 2036)[1], ys[-1], 0) AS year,
        coalesce(list_filter(string_split(text, chr(10)), lambda l: length(l) > 200)[1], '') AS block, coalesce(n_tokens, 0) AS n_tokens
    FROM y LEFT JOIN m USING (doc_id) LEFT JOIN t USING (doc_id)""")
def document_headers(spark, sf_dir):
    """Title, e-mails, year, first long line and token count of each document: one pass, no shuffle."""
    lines = F.split("text", "\n")
    toks = F.filter(F.flatten(F.transform(lines, lambda l: F.split(l, " "))), lambda t: t != "")
    mails = F.filter(toks, lambda t: t.rlike("^[^@]+@[^@]+$"))
    block = F.coalesce(F.get(F.filter(lines, lambda l: F.length(l) > 200), F.lit(0)), F.lit(""))
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.clean_title(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title"), F.array_join(mails, " ").alias("emails"), T.ref_year("text").alias("year"),
        block.alias("block"), F.size(toks).cast("long").alias("n_tokens"),
    )


# references


def _parse_query(style: str, fixture: str):
    def run(spark, sf_dir):
        refs = references(table(spark, sf_dir, "part"), fixture)
        return refs.withColumn("r", B.parse(F.col("entry"), style)).filter("r is not null").select("section", "n", "r.authors", "r.title", "r.venue", "r.year")

    _, pattern, groups = B.STYLES[style]
    names = ", ".join(f"'{g}'" for g in groups)
    pattern = pattern.replace("'", "''")
    year = "CAST(g.year AS INTEGER)" if "year" in groups else "coalesce(CAST(nullif(regexp_extract(g.venue, '([1-2][0-9][0-9][0-9])', 1), '') AS INTEGER), 0)"
    title = "g.title" if "title" in groups else "''"
    sql = f"""SELECT section, n, g.authors AS authors, {title} AS title, g.venue AS venue, {year} AS year FROM (
        SELECT section, n, regexp_extract(entry, '{pattern}', [{names}]) AS g FROM ({references_sql(fixture)}) WHERE regexp_matches(entry, '{pattern}'))"""
    return run, sql


_STYLES = [("parse_bracket", "bracket_quoted", "bracket"), ("parse_dot", "dot_plain", "dot"), ("parse_named_year", "named_year", "named")]
_STYLES += [(f"parse_{s}", s, s) for s in ("close_paren", "named_year_parens", "dot_colon", "dot_no_title", "bracket_commas", "bracket_plain", "bracket_name")]
for _name, _style, _fixture in _STYLES:
    QUERIES[_name], ORACLE_SQL[_name] = _parse_query(_style, _fixture)


def sections(spark, sf_dir):
    """Bibliographies as texts: brackets where the section number leaves 0 by three, dots 1, named 2."""
    part = table(spark, sf_dir, "part")
    out = None
    for k, style in enumerate(("bracket", "dot", "named")):
        refs = references(part, style).filter(F.col("section") % 3 == k)
        mark = "<bb>" if style == "named" else "<lb>"
        body = F.concat(F.lit("<bb>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "entry"))), lambda x: x["entry"]), mark))
        one = refs.groupBy("section").agg(body.alias("body"))
        out = one if out is None else out.union(one)
    return out


_ALL_REFS = " UNION ALL ".join(f"SELECT * FROM ({references_sql(s)}) WHERE section % 3 = {k}" for k, s in enumerate(("bracket", "dot", "named")))


@query(f"SELECT section, CASE section % 3 WHEN 0 THEN 'bracket_quoted' WHEN 1 THEN 'dot_plain' ELSE 'named_year' END AS style, count(*) AS records, min(year) AS first_year, max(year) AS last_year FROM ({_ALL_REFS}) GROUP BY section")
def style_select(spark, sf_dir):
    best = B.select_style(sections(spark, sf_dir))
    return best.groupBy("section", "style").agg(F.count("*").alias("records"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def _segment_query(how: str, fixture: str):
    """Bibliographies of one style whose entries run over several lines, one of them within a word."""

    def run(spark, sf_dir):
        refs = references(table(spark, sf_dir, "part"), fixture)
        long = F.replace("entry", F.concat(F.lit(" "), "p_type"), F.concat(F.lit("<lb>"), "p_type"))
        long = F.replace(long, F.col("p_name"), F.concat(F.left("p_name", F.lit(3)), F.lit("-<lb>"), F.expr("substr(p_name, 4)")))
        mark = "<bb>" if how.startswith(("named", "bracket_name")) else "<lb>"
        body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", long.alias("entry")))), lambda x: x["entry"]), mark)
        whole = refs.groupBy("section").agg(F.concat(F.lit("<bb>"), body).alias("body"))
        return whole.select("section", F.posexplode(B.segment(F.col("body"), how)).alias("n", "entry"))

    return run, f"SELECT section, n - 1 AS n, entry FROM ({references_sql(fixture)})"


for _name, _how, _fixture in (("segment_brackets", "bracket", "bracket"), ("segment_dots", "dot", "dot"), ("segment_parens", "paren", "close_paren"), ("segment_named", "named", "named"), ("segment_bracket_names", "bracket_name", "bracket_name")):
    QUERIES[_name], ORACLE_SQL[_name] = _segment_query(_how, _fixture)


@query(f"SELECT section, n, title FROM (SELECT section, n, regexp_replace('\"' || p_name || ',\"', '^[\"''“”.,\\s]+|[\"''“”.,\\s]+$', '', 'g') AS title, p_type FROM ({references_sql('bracket')})) WHERE length(title) BETWEEN 1 AND 511")
def bib_clean(spark, sf_dir):
    refs = references(table(spark, sf_dir, "part"), "bracket")
    raw = refs.select("section", "n", F.concat(F.lit('"'), "p_name", F.lit(',"')).alias("title"), F.lit("A").alias("authors"), F.col("p_type").alias("venue"))
    return B.clean_records(raw).select("section", "n", "title")


# citations

_CITE_SQL = """SELECT p_partkey AS id, p_size AS section, 'The ' || p_name || ' was studied at length by two groups [' || p_partkey % 40 || ', ' || p_partkey % 40 + 2 || '] and others. Later work [' || p_partkey % 30 || '-' || p_partkey % 30 + p_partkey % 4
    || '] confirmed this for the type ' || p_type || '. Short [1].' AS body FROM part"""


def cite_text(spark, sf_dir):
    m = lambda k: F.pmod("p_partkey", F.lit(k))
    body = F.format_string("The %s was studied at length by two groups [%d, %d] and others. Later work [%d-%d] confirmed this for the type %s. Short [1].", "p_name", m(40), m(40) + 2, m(30), m(30) + m(4), "p_type")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("section"), body.alias("body"))


_MARKS_SQL = f"""m AS (SELECT id, section, 0 AS sentence, 'The ' || p_name || ' was studied at length by two groups [' || id % 40 || ', ' || id % 40 + 2 || '] and others.' AS context, id % 40 || ', ' || id % 40 + 2 AS marker, [id % 40, id % 40 + 2] AS numbers FROM (SELECT p_partkey AS id, p_size AS section, p_name FROM part)
    UNION ALL SELECT id, section, 1, 'Later work [' || id % 30 || '-' || id % 30 + id % 4 || '] confirmed this for the type ' || p_type || '.', id % 30 || '-' || id % 30 + id % 4, range(id % 30, id % 30 + id % 4 + 1) FROM (SELECT p_partkey AS id, p_size AS section, p_type FROM part)
    UNION ALL SELECT p_partkey, p_size, 2, 'Short [1].', '1', [1] FROM part)"""


def marked(spark, sf_dir):
    t = cite_text(spark, sf_dir)
    return B.markers(t, "id", "body").join(t.select("id", "section"), "id")


@query(f"WITH {_MARKS_SQL} SELECT id, sentence, marker, CAST(position('[' IN context) - 1 AS INTEGER) AS start, CAST(position(']' IN context) AS INTEGER) AS stop FROM m")
def cite_offsets(spark, sf_dir):
    return B.with_offsets(marked(spark, sf_dir)).select("id", "sentence", "marker", "start", "stop")


@query(f"WITH {_MARKS_SQL} SELECT id, sentence, CAST(unnest(numbers) AS INTEGER) AS n FROM m")
def cite_ranges(spark, sf_dir):
    return marked(spark, sf_dir).select("id", "sentence", F.explode(B.expand_numbers(F.col("marker"))).alias("n"))


@query(f"WITH {_MARKS_SQL}, r AS ({references_sql('bracket')}) SELECT x.id, x.sentence, CAST(x.n AS INTEGER) AS n FROM (SELECT id, section, sentence, unnest(numbers) AS n FROM m) x JOIN r ON r.section = x.section AND r.n = x.n")
def cite_lookup(spark, sf_dir):
    refs = references(table(spark, sf_dir, "part"), "bracket")
    return B.resolve(marked(spark, sf_dir), refs, "section").select("id", "sentence", "n")


@query(f"WITH {_MARKS_SQL} SELECT id, sentence, context FROM m WHERE length(context) - (length(marker) + 2) >= 35")
def cite_context(spark, sf_dir):
    return B.long_contexts(B.with_offsets(marked(spark, sf_dir))).select("id", "sentence", "context")


_SIGN_SQL = "SELECT user_id AS id, CASE event_id % 3 WHEN 0 THEN '(' WHEN 1 THEN '[' ELSE 'other' END AS sign, event_id AS at_place FROM events WHERE event_type = 'click'"


@query(f"""SELECT id, sign AS style FROM (SELECT id, sign, count(*) AS n, max(at_place) AS last_place FROM ({_SIGN_SQL}) GROUP BY id, sign)
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, last_place) = 1""")
def cite_style(spark, sf_dir):
    sign = F.when(F.col("event_id") % 3 == 0, "(").when(F.col("event_id") % 3 == 1, "[").otherwise("other")
    found = table(spark, sf_dir, "events").filter("event_type = 'click'").select(F.col("user_id").alias("id"), sign.alias("sign"), F.col("event_id").alias("at"))
    return B.predominant_style(found)


# labels

_RULE = "CASE (doc_id * 7 + seq * 5 + seq // 3) % 9 WHEN 0 THEN 'B_T' WHEN 1 THEN 'I_T' WHEN 2 THEN 'I_T' WHEN 3 THEN 'E_T' WHEN 4 THEN 'W_A' WHEN 5 THEN 'B_A' WHEN 6 THEN 'E_A' WHEN 7 THEN 'I_A' ELSE 'O' END"
_LABEL_SQL = f"l AS (SELECT doc_id, seq, token, {_RULE} AS label FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, pos) - 1 AS seq FROM ({TOKENS_SQL})))"


def labelled(spark, sf_dir):
    toks = F.filter(F.flatten(F.transform(F.split("text", "\n"), lambda l: F.split(l, " "))), lambda t: t != "")
    names = F.array(*map(F.lit, ["B_T", "I_T", "I_T", "E_T", "W_A", "B_A", "E_A", "I_A", "O"]))
    label = lambda t, i: F.get(names, ((F.col("doc_id") * 7 + i * 5 + F.floor(i / 3)) % 9).cast("int"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), toks.alias("tokens")).withColumn("doc_id", F.col("id")).withColumn("labels", F.transform("tokens", label)).drop("doc_id")


_SPANS_SQL = f"""WITH {_LABEL_SQL}, c AS (SELECT *, sum(CAST(label = 'I_T' AS INTEGER)) OVER w AS inner_t, sum(CAST(label = 'I_A' AS INTEGER)) OVER w AS inner_a FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
    n AS (SELECT doc_id, seq, label, lead(seq) OVER w AS last, lead(label) OVER w AS next, lead(inner_t) OVER w - inner_t AS t, lead(inner_a) OVER w - inner_a AS a FROM c WHERE left(label, 2) <> 'I_' WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
    s AS (SELECT doc_id, 'A' AS tag, seq AS start, seq + 1 AS stop FROM n WHERE label = 'W_A' UNION ALL
    SELECT doc_id, substr(label, 3), seq, last + 1 FROM n WHERE left(label, 2) = 'B_' AND next = 'E_' || substr(label, 3) AND CASE substr(label, 3) WHEN 'T' THEN t ELSE a END = last - seq - 1)"""


@query(f"{_SPANS_SQL} SELECT doc_id AS id, tag, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop FROM s")
def spans_from_labels(spark, sf_dir):
    return labelled(spark, sf_dir).select("id", F.inline(Q.spans(F.col("labels"))))


@query(f"""{_SPANS_SQL}, t AS (SELECT doc_id, tag, start, string_agg(token, ' ' ORDER BY seq) AS txt FROM (SELECT l.doc_id, tag, start, stop, seq, token FROM l ASOF JOIN s ON l.doc_id = s.doc_id AND l.seq >= s.start) l WHERE seq < stop GROUP BY doc_id, tag, start)
    SELECT d.doc_id AS id, (SELECT arg_min(txt, start) FROM t WHERE t.doc_id = d.doc_id AND tag = 'T') AS title, coalesce((SELECT string_agg(txt, ';' ORDER BY start) FROM t WHERE t.doc_id = d.doc_id AND tag = 'A'), '') AS authors FROM documents d""")
def metadata_from_spans(spark, sf_dir):
    return Q.metadata(labelled(spark, sf_dir)).select("id", "title", F.array_join("authors", ";").alias("authors"))


_ALIGN_SQL = f"""WITH {_LABEL_SQL}, a AS (SELECT doc_id, list(lower(token) ORDER BY seq) AS toks FROM l GROUP BY doc_id),
    p AS (SELECT doc_id, toks, list_filter(range(0, len(toks) - 1), lambda i: toks[i + 1:i + 2] = [toks[len(toks) - 1], toks[len(toks)]])[1] AS place FROM a)"""


@query(f"{_ALIGN_SQL} SELECT doc_id AS id, CAST(place AS INTEGER) AS place FROM p")
def label_alignment(spark, sf_dir):
    s = labelled(spark, sf_dir)
    n = F.size("tokens")
    return s.select("id", F.when(n >= 2, Q.first_occurrence(F.col("tokens"), F.slice("tokens", F.greatest(n - 1, F.lit(1)), F.lit(2)))).alias("place"))


_PAIRS_SQL = f"WITH {_LABEL_SQL}, g AS (SELECT label AS gold, CASE WHEN seq % 4 = 0 THEN 'O' ELSE label END AS guess FROM l)"


def pairs(spark, sf_dir):
    s = labelled(spark, sf_dir).select(F.posexplode("labels").alias("seq", "gold"))
    return s.select("gold", F.when(F.col("seq") % 4 == 0, "O").otherwise(F.col("gold")).alias("guess"))


@query(f"{_PAIRS_SQL} SELECT round(avg(CAST(gold = guess AS INTEGER)), 6) AS accuracy FROM g")
def token_accuracy(spark, sf_dir):
    return Q.token_accuracy(pairs(spark, sf_dir)).select(F.round("accuracy", 6).alias("accuracy"))


@query(f"""{_PAIRS_SQL}, s AS (SELECT label, sum(g) AS g, sum(p) AS p, sum(h) AS h FROM (SELECT gold AS label, 1 AS g, 0 AS p, CAST(gold = guess AS INTEGER) AS h FROM g UNION ALL SELECT guess, 0, 1, 0 FROM g) GROUP BY label)
    SELECT label, round(coalesce(h / nullif(p, 0), 0), 6) AS precision, round(coalesce(h / nullif(g, 0), 0), 6) AS recall, round(coalesce(2.0 * h / nullif(p + g, 0), 0), 6) AS f1 FROM s""")
def label_scores(spark, sf_dir):
    return Q.label_scores(pairs(spark, sf_dir)).select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query()
def crf_labels(spark, sf_dir):
    """A CRF trained to tell the authors, title and year of the dot style; labels of the references held out."""
    refs = references(table(spark, sf_dir, "part"), "dot").select((F.col("section") * 1000 + F.col("n")).alias("id"), F.split("entry", " ").alias("tokens"))
    t = F.col("tokens")
    gold = F.transform(t, lambda x, i: F.when(i.isin(1, 2), 1).when((i > 2) & (i < F.size(t) - 2), 2).when(i == F.size(t) - 1, 3).otherwise(0))
    slot = lambda *parts: F.pmod(F.xxhash64(*parts), F.lit(2048)).cast("int")
    feats = F.transform(t, lambda x, i: F.array(slot(F.lit("t"), x), slot(F.lit("m"), F.array_join(X.case_masks(x), ",")), slot(F.lit("p"), F.least(i, F.lit(4))), slot(F.lit("e"), F.right(x, F.lit(1)))))
    seqs = refs.select("id", feats.alias("features"), gold.alias("gold")).persist()
    try:
        model = Q.train_crf(seqs.filter("id % 2 = 0"), ["O", "A", "T", "Y"], rounds=6)
    finally:
        seqs.unpersist()
    return Q.decode_crf(seqs.filter("id % 2 = 1"), model).select("id", F.array_join("labels", " ").alias("labels"))


# whole documents


def papers(spark, sf_dir):
    """A document a section of the bracket bibliography, with title, abstract, citing sentences and references."""
    refs = references(table(spark, sf_dir, "part"), "bracket")
    bib = refs.groupBy("section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "entry"))), lambda x: x["entry"]), "\n").alias("bib"))
    text = F.format_string("A study of group %d.\nAbstract: We look at parts of size %d, 2001.\nWrite to {first,last}@g%d.org today.\nMany results on this kind of part are known [1, 2] by now. A longer line of work [3-5] goes on and on since then. Few [1].\nReferences\n%s", "section", "section", "section", "bib")
    return bib.select(F.col("section").alias("id"), text.alias("text"))


@query(f"""SELECT section AS id, 'A study of group ' || section AS title, 'first@g' || section || '.org;last@g' || section || '.org' AS emails, 2001 AS year, 'We look at parts of size ' || section || ', 2001.' AS abstract,
    count(*) AS n_references, CAST(least(count(*), 5) AS BIGINT) AS n_mentions, min(year) AS oldest FROM ({references_sql('bracket')}) GROUP BY section""")
def extract_papers(spark, sf_dir):
    out = extract(papers(spark, sf_dir))
    return out.select(
        "id", "title", F.array_join("emails", ";").alias("emails"), "year", "abstract", F.size("references").cast("long").alias("n_references"), F.size("mentions").cast("long").alias("n_mentions"),
        F.array_min(F.transform("references", lambda r: r["year"])).alias("oldest"),
    )


@query("SELECT p_size AS paper, CAST(row_number() OVER (PARTITION BY p_size ORDER BY p_name) AS INTEGER) AS number, p_name AS cell FROM part")
def annotation_sheet(spark, sf_dir):
    cells = table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("paper")).agg(F.array_sort(F.collect_list("p_name")).alias("cells"))
    return E.annotation_sheet(E.from_sheet(E.annotation_sheet(cells)))


_WORDS_SQL = "SELECT doc_id AS paper, unnest(regexp_extract_all(lower({}), '[\\p{{L}}0-9]+')) AS item FROM documents"


@query(f"""WITH c AS (SELECT paper, item, sum(a) AS x, sum(b) AS y FROM (SELECT *, 1 AS a, 0 AS b FROM ({_WORDS_SQL.format('text')}) UNION ALL SELECT *, 0, 1 FROM ({_WORDS_SQL.format("split_part(text, chr(10), 1)")})) GROUP BY 1, 2),
    s AS (SELECT paper, sum(x) AS g, sum(y) AS p, sum(least(x, y)) AS h FROM c GROUP BY 1) SELECT paper, round(CASE WHEN p = 0 THEN 0.0 ELSE h / p END, 6) AS precision, round(h / g, 6) AS recall FROM s""")
def section_tokens(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper"), "text", F.split_part("text", F.lit("\n"), F.lit(1)).alias("t"))
    out = E.precision_recall(E.token_items(d, "text"), E.token_items(d, "t"))
    return out.select("paper", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"""SELECT doc_id, CASE WHEN bad THEN lang ELSE t END AS title, CASE WHEN bad THEN 'CRF' ELSE 'META' END AS source FROM (
    SELECT doc_id, lang, t, regexp_matches(t, '(?i)\\.(pdf|doc|docx|tex|dvi|ps)$') OR regexp_matches(t, '(?i)proceedings of') OR regexp_matches(t, '(?i)arxiv:') OR NOT regexp_matches(t, '(^|\\s)\\p{{Lu}}') AS bad
    FROM (SELECT doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN lower(split_part(text, chr(10), 1)) ELSE split_part(text, chr(10), 1) END AS t FROM documents))""")
def title_precedence(spark, sf_dir):
    t = F.split_part("text", F.lit("\n"), F.lit(1))
    title, source = precedence(F.col("lang"), F.when(F.col("doc_id") % 3 == 0, F.lower(t)).otherwise(t))
    return table(spark, sf_dir, "documents").select("doc_id", title.alias("title"), source.alias("source"))


@query("SELECT vec_id AS id, CAST(unnest(range(0, len(embedding))) AS INTEGER) AS i, round(CAST(unnest(embedding) AS DOUBLE), 6) AS value FROM embeddings WHERE vec_id IN (SELECT p_partkey FROM part)")
def vector_features(spark, sf_dir):
    """Components of the word vectors of known tokens; a token without a vector has none."""
    keys = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("vec_id"))
    found = table(spark, sf_dir, "embeddings").join(keys, "vec_id", "left_semi")
    return found.select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("i", "v")).select("id", "i", F.round(F.col("v").cast("double"), 6).alias("value"))


@query("""SELECT section, line_no, entry FROM (SELECT section, line_no, entry || ' ' || follow AS entry FROM (SELECT p_size AS section, 2 * p_partkey AS line_no, '[' || p_partkey || ']' AS entry, p_name AS follow FROM part))""")
def merge_bare_numbers(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    number = p.select(F.col("p_size").alias("section"), (2 * F.col("p_partkey")).alias("line_no"), F.format_string("[%d]", "p_partkey").alias("entry"))
    name = p.select(F.col("p_size").alias("section"), (2 * F.col("p_partkey") + 1).alias("line_no"), F.col("p_name").alias("entry"))
    return L.merge_bare_numbers(number.union(name))


@query()
def indent_clusters(spark, sf_dir):
    """Clusters of the lengths of each document's lines; a fold, checked against Python in the tests."""
    widths = F.transform(F.split("text", "\n"), lambda l: F.length(l).cast("double"))
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(L.greedy_clusters(widths, 20.0)))


@query("SELECT doc_id, line_no, pos, 0 AS column, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, pos) AS place FROM (" + TOKENS_SQL + ")")
def column_repair(spark, sf_dir):
    """Pages of one column keep their order; two-column ones are checked in the tests."""
    from ..sources.derived import with_geometry

    return L.repair_columns(with_geometry(tokens(table(spark, sf_dir, "documents"))).withColumn("x1", F.col("x0") + 36.0))
