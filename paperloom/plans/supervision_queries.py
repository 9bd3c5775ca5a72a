"""Queries over labels made from names and titles that documents hold, and the same in SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import supervision as D
from ..operators.tagged import SCHEMES, labelled_line
from ..sources.derived import TOKENS_SQL, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _capital(letter):
    """Upper case of one letter as one letter: sharp s has one, and what only has a longer form stays."""
    upper = F.upper(F.translate(letter, "ß", "ẞ"))
    return F.when(F.length(upper) == F.length(letter), upper).otherwise(letter)


def _papers(spark, sf_dir):
    """Documents as tokens, with names and titles made of their own words: shortened, with an initial, or not there at all."""
    d = table(spark, sf_dir, "documents")
    tokens = F.array_remove(F.split(F.translate("text", "\n", " "), " "), "")
    # a generator, so that no filter on names or titles makes the tokens anew
    rows = d.select(F.col("doc_id").alias("id"), F.explode(F.array(tokens)).alias("tokens")).filter(F.size("tokens") >= 14)
    t = lambda i: F.get("tokens", F.lit(i))
    s = F.format_string
    names = F.array(s("%s %s", t(4), t(5)), s("%s. %s", _capital(F.left(t(8), F.lit(1))), t(9)), s("%s Q. %s", t(12), t(13)))
    authors = F.when(F.col("id") % 10 == 3, F.concat(names, F.array(F.lit("Nobody Atall")))).otherwise(names)
    title = F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 7 == 1, "not a title of any").otherwise(F.concat_ws(" ", t(0), F.lower(t(1)), t(2)))
    return rows.select("id", "tokens", authors.alias("authors"), title.alias("title"), (1990 + F.pmod("id", F.lit(30))).alias("year"))


_PLAIN = r"lower(regexp_replace(replace(replace(replace(replace(replace(translate({c}, '‘’“”‐‑‒–—−ıﬀﬁﬂﬃﬄ', '''''""------iﬀﬁﬂﬃﬄ'), 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), '[\x00-\x1F\x7F]', '', 'g'))"
_PAPERS = rf"""WITH t AS (SELECT doc_id AS id, list(token ORDER BY line_no, pos) AS tokens FROM ({TOKENS_SQL}) GROUP BY doc_id HAVING count(*) >= 14),
    p AS (SELECT id, tokens, [tokens[5] || ' ' || tokens[6], upper(left(tokens[9], 1)) || '. ' || tokens[10], tokens[13] || ' Q. ' || tokens[14]] || CASE WHEN id % 10 = 3 THEN ['Nobody Atall'] ELSE [] END AS authors,
        CASE WHEN id % 7 = 0 THEN NULL WHEN id % 7 = 1 THEN 'not a title of any' ELSE tokens[1] || ' ' || lower(tokens[2]) || ' ' || tokens[3] END AS title, 1990 + id % 30 AS year FROM t),
    w AS (SELECT id, pos, {_PLAIN.format(c="token")} AS word FROM (SELECT id, unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS pos FROM t)),
    a AS (SELECT id, n, name, list_filter(string_split({_PLAIN.format(c="translate(name, '()?*+^', '')")}, ' '), lambda x: x <> '') AS ws FROM (SELECT id, unnest(authors) AS name, generate_subscripts(authors, 1) - 1 AS n FROM p)),
    f AS (SELECT a.id, n, name, ws, pos FROM a JOIN w ON w.id = a.id AND CASE WHEN regexp_full_match(ws[1], '[a-z]\.?') THEN regexp_full_match(word, left(ws[1], 1) || '(\.?|[a-z]+)')
        ELSE word IN (ws[1], left(ws[1], 1), left(ws[1], 1) || '.') END),
    l AS (SELECT f.id, n, name, f.pos AS start, y.pos AS y, z.pos AS z, ws, y.word AS w2, z.word AS w3 FROM f LEFT JOIN w y ON y.id = f.id AND y.pos = f.pos + 1 LEFT JOIN w z ON z.id = f.id AND z.pos = f.pos + 2),
    e AS (SELECT *, starts_with(w2, ws[-1]) AND regexp_full_match(substr(w2, length(ws[-1]) + 1), '[\W0-9]*') AS two, starts_with(w3, ws[-1]) AND regexp_full_match(substr(w3, length(ws[-1]) + 1), '[\W0-9]*')
        AND regexp_full_match(w2, CASE WHEN len(ws) = 2 THEN '[a-z]\.?' ELSE left(ws[2], 1) || '(\.?|[a-z]+)' END) AS three FROM l),
    names AS (SELECT id, n, name, start, CASE WHEN three THEN start + 3 ELSE start + 2 END AS stop FROM e WHERE two OR three QUALIFY row_number() OVER (PARTITION BY id, n ORDER BY start) = 1)"""


@query(f"{_PAPERS} SELECT id, CAST(n AS INTEGER) AS n, name, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop FROM names")
def author_patterns(spark, sf_dir):
    return D.find_names(_papers(spark, sf_dir))


_LABELLED = f"""{_PAPERS}, tw AS (SELECT id, list_filter(string_split({_PLAIN.format(c="title")}, ' '), lambda x: x <> '') AS ws FROM p WHERE title IS NOT NULL),
    th AS (SELECT tw.id, w.pos AS start, w.pos + len(ws) AS stop FROM tw JOIN w ON w.id = tw.id AND w.word = ws[1] JOIN w y ON y.id = tw.id AND y.pos = w.pos + 1 AND y.word = ws[2]
        JOIN w z ON z.id = tw.id AND z.pos = w.pos + 2 AND z.word = ws[3] WHERE len(ws) = 3 QUALIFY row_number() OVER (PARTITION BY tw.id ORDER BY w.pos) = 1),
    marks AS (SELECT id, n, start, stop, 'A' AS tag FROM names UNION ALL SELECT id, 1000, start, stop, 'T' FROM th),
    ml AS (SELECT w.id, pos, arg_max(CASE WHEN stop - start = 1 THEN 'W_' WHEN pos = start THEN 'B_' WHEN pos = stop - 1 THEN 'E_' ELSE 'I_' END || tag, n) AS label
        FROM w JOIN marks m ON m.id = w.id AND w.pos >= start AND w.pos < stop GROUP BY w.id, pos),
    lab AS (SELECT w.id, '<S> ' || string_agg(coalesce(label, 'O'), ' ' ORDER BY w.pos) || ' </S>' AS labels FROM w LEFT JOIN ml USING (id, pos) WHERE w.id IN (SELECT id FROM th) GROUP BY w.id)"""


@query(f"{_LABELLED} SELECT id, labels FROM lab")
def supervised_labels(spark, sf_dir):
    return D.labelled(_papers(spark, sf_dir)).select("id", F.array_join("labels", " ").alias("labels"))


@query(f"""{_LABELLED},
    counted AS (SELECT lab.id, labels, len(regexp_extract_all(labels, 'W_A|B_A (?:I_A )*E_A')) AS k FROM lab)
    SELECT c.id, c.labels FROM counted c JOIN p USING (id) WHERE k = len(authors) AND year >= 1995 AND c.id % 11 <> 0 ORDER BY c.id LIMIT 300""")
def bulk_labels(spark, sf_dir):
    papers = _papers(spark, sf_dir)
    excluded = table(spark, sf_dir, "documents").filter("doc_id % 11 = 0").select(F.col("doc_id").alias("id"))
    return D.label_in_bulk(papers, excluded, min_year=1995, most=300, check_authors=True).select("id", F.array_join("labels", " ").alias("labels"))


# tagged references

_TAGGED = {
    "cora": "<author> A. {a} and B. {b} </author> <title> {n} study. </title> <booktitle> In {t} Conf., </booktitle> <unknown> x </unknown> <date> {y}. </date> end",
    "umass": "<ref-marker> [{k}] </ref-marker> <authors> <person> <person-first> A. </person-first> <person-last> {a} , </person-last> </person> <person> <person-last> {b} </person-last> </person> </authors> <venue> <booktitle> {n} <volume> {k} </volume> of {t} , </booktitle> <date> <year> {y} , </year> </date> </venue>",
    "kermit": '<bibl> <author> {a}, et al. </author> , <title level="a"> On {n} </title> <title level="j"> {t} </title> <biblScope type="vol"> {k} </biblScope> , <biblScope type="pp"> 1-{k} </biblScope> ( <date> {y} </date> ) </bibl>',
}


def _tagged_query(scheme: str):
    line = _TAGGED[scheme]
    part = "SELECT p_partkey AS id, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, p_name AS n, p_type AS t, CAST(p_partkey AS VARCHAR) AS k, CAST(1970 + p_partkey % 50 AS VARCHAR) AS y FROM part"
    text = "'" + line.format(**{c: f"' || {c} || '" for c in "abntky"}) + "'"
    for tag, value, name in (("title level", "j", "booktitle"), ("title level", "a", "title"), ("biblScope type", "vol", "volume"), ("biblScope type", "pp", "pages")):
        text = f"replace({text}, '<{tag}=\"{value}\">', '<{name}>')"
    names = " ".join(f"WHEN '{tag}' THEN '{label}'" for tag, label in SCHEMES[scheme].items())
    sql = f"""WITH l AS (SELECT id, regexp_replace({text}, '<ref-marker>.*</ref-marker> ', '') AS line FROM ({part})),
        t AS (SELECT id, unnest(string_split(line, ' ')) AS token, generate_subscripts(string_split(line, ' '), 1) AS pos FROM l),
        e AS (SELECT *, regexp_matches(token, '^<[^/]') AS opens, regexp_matches(token, '^</') AS closes, CASE regexp_extract(token, '^</?(.*)>$', 1) {names} END AS label FROM t),
        -- only elements with a label count; in this scheme's lines they close in order
        d AS (SELECT *, sum(CASE WHEN label IS NULL AND token <> '</biblScope>' THEN 0 WHEN opens THEN 1 WHEN closes THEN -1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos) AS depth FROM e),
        o AS (SELECT *, last_value(CASE WHEN opens AND label IS NOT NULL THEN pos END IGNORE NULLS) OVER (PARTITION BY id, depth ORDER BY pos ROWS UNBOUNDED PRECEDING) AS held FROM d),
        w AS (SELECT o.id, o.pos, o.token, CASE WHEN o.depth > 0 THEN o.held END AS held, h.label FROM o LEFT JOIN e h ON h.id = o.id AND h.pos = o.held AND o.depth > 0 WHERE NOT (o.opens OR o.closes)),
        s AS (SELECT *, min(pos) OVER (PARTITION BY id, held) = pos AS first, max(pos) OVER (PARTITION BY id, held) = pos AS last, row_number() OVER (PARTITION BY id ORDER BY pos) AS n FROM w)
        SELECT id, CAST(n AS INTEGER) AS n, token, CASE WHEN held IS NULL THEN 'O' ELSE CASE WHEN first AND last THEN 'W_' WHEN first THEN 'B_' WHEN last THEN 'E_' ELSE 'I_' END || label END AS label FROM s"""

    def run(spark, sf_dir):
        w = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
        values = {"a": w(1), "b": w(2), "n": F.col("p_name"), "t": F.col("p_type"), "k": F.col("p_partkey").cast("string"), "y": (1970 + F.pmod("p_partkey", F.lit(50))).cast("string")}
        pieces = [values[p[1]] if p.startswith("{") else F.lit(p) for p in re.split(r"(\{\w\})", line) if p]
        # a small file is one task; its rows are much work
        part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type").repartition(4 * spark.sparkContext.defaultParallelism)
        rows = part.select(F.col("p_partkey").alias("id"), F.posexplode(labelled_line(F.concat(*pieces), scheme)).alias("n", "x"))
        return rows.select("id", "n", "x.token", "x.label").filter("label not in ('<S>', '</S>')")

    run.__name__ = f"tagged_{scheme}"
    return query(sql)(run)


for _scheme in _TAGGED:
    _tagged_query(_scheme)
