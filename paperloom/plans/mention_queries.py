"""Queries over citation mentions in texts made from documents and parts, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mentions as M
from ..sources.derived import LINES_SQL, lines, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _named(spark, sf_dir):
    """A paragraph a line of a document, most with citations of records whose authors are words of the part with the document's number."""
    docs = table(spark, sf_dir, "documents")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), *(F.initcap(F.split_part("p_name", F.lit(" "), F.lit(i))).alias(f"w{i}") for i in (1, 2)))
    part = part.withColumn("y", (1970 + F.pmod("id", F.lit(50))).cast("int"))
    rows = lines(docs).select(F.col("doc_id").alias("id"), F.col("line_no").alias("unit"), "line").join(part, "id")
    w1, w2, y, line = (F.col(c) for c in ("w1", "w2", "y", "line"))
    s = F.format_string
    texts = [
        s("%s (%d) %s", w1, y, line), s("%s as %s and %s (%d) show.", line, w1, w2, y + 1), s("%s et al. [%da] %s (%d) agree. %s", w2, y + 2, w1, y, line), s("See De %s (%d) on %s", w2, y + 3, line),
        s("%s, as Nobody (%d) and %s (2035) say", line, y, w1), s("%s (%s and %s, %d; %s et al., %db).", line, w1, w2, y + 1, w2, y + 2), line, s("%s [%s %d; Nobody %d] (De %s %d)", line, w1, y, y, w2, y + 3),
    ]
    case = F.pmod(F.col("id") + F.col("unit"), F.lit(8))
    text = F.coalesce(*[F.when(case == i, t) for i, t in enumerate(texts)])
    of = lambda n, k, *names: F.struct(F.lit(n).alias("n"), F.array(*names).alias("authors"), (y + k).alias("year"))
    j = lambda first, last: F.concat(F.lit(first + " "), last)
    records = [of(1, 0, j("A.", w1)), of(2, 1, j("A.", w1), j("B. C.", w2)), of(3, 2, j("B.", w2), j("A.", w1), F.lit("C. Third")), of(4, 3, j("Ann De", w2)), of(5, 3, j("Z.", w2)), of(6, 1, j("X.", w2))]
    return rows.select("id", "unit", text.alias("text")), part.select("id", F.inline(F.array(*records)))


_P = r"""p AS (SELECT p_partkey AS id, 1970 + p_partkey % 50 AS y, upper(left(split_part(p_name, ' ', 1), 1)) || substr(split_part(p_name, ' ', 1), 2) AS w1,
    upper(left(split_part(p_name, ' ', 2), 1)) || substr(split_part(p_name, ' ', 2), 2) AS w2 FROM part)"""
_NAMED = rf"""WITH {_P},
    u AS (SELECT id, line_no AS unit, CASE (id + line_no) % 8 WHEN 0 THEN w1 || ' (' || y || ') ' || line WHEN 1 THEN line || ' as ' || w1 || ' and ' || w2 || ' (' || (y + 1) || ') show.'
        WHEN 2 THEN w2 || ' et al. [' || (y + 2) || 'a] ' || w1 || ' (' || y || ') agree. ' || line WHEN 3 THEN 'See De ' || w2 || ' (' || (y + 3) || ') on ' || line
        WHEN 4 THEN line || ', as Nobody (' || y || ') and ' || w1 || ' (2035) say'
        WHEN 5 THEN line || ' (' || w1 || ' and ' || w2 || ', ' || (y + 1) || '; ' || w2 || ' et al., ' || (y + 2) || 'b).' WHEN 6 THEN line
        ELSE line || ' [' || w1 || ' ' || y || '; Nobody ' || y || '] (De ' || w2 || ' ' || (y + 3) || ')' END AS text
        FROM ({LINES_SQL}) l JOIN p ON p.id = l.doc_id),
    k AS (SELECT id, 1 AS n, w1 AS key, y AS year FROM p UNION ALL SELECT id, 2, w1 || ' and ' || w2, y + 1 FROM p UNION ALL SELECT id, 3, w2 || ' et al.', y + 2 FROM p
        UNION ALL SELECT id, 4, w2, y + 3 FROM p UNION ALL SELECT id, 5, w2, y + 3 FROM p UNION ALL SELECT id, 6, w2, y + 1 FROM p)"""


@query(f"""{_NAMED}, s AS (SELECT u.id, unit, n, text, key || ' ' || mark AS needle FROM u JOIN k USING (id), LATERAL (SELECT unnest(['(' || year || ')', '[' || year || ']', '(' || year || 'a)', '[' || year || 'a]']) AS mark) WHERE contains(text, key || ' ' || mark)),
    h AS (SELECT *, string_split(text, needle) AS parts, unnest(range(1, len(string_split(text, needle)))) AS j FROM s),
    hit AS (SELECT id, unit, n, text, length(needle) AS size, list_sum(list_transform(parts[1:j], lambda x: length(x))) + (j - 1) * length(needle) AS start FROM h),
    one AS (SELECT *, row_number() OVER (PARTITION BY id, unit, start + size ORDER BY start, n) AS place FROM hit WHERE start = 0 OR NOT regexp_matches(substr(text, CAST(start AS BIGINT), 1), '[\\p{{L}}\\p{{N}}]'))
    SELECT id, unit, n, CAST(start AS INTEGER) AS start, CAST(start + size AS INTEGER) AS stop FROM one WHERE place = 1""")
def narrative_mentions(spark, sf_dir):
    units, records = _named(spark, sf_dir)
    return M.narrative(units, records)


def _places_sql(pattern: str, source: str = "u") -> str:
    """``id, unit, text, marker, start, stop`` of the matches of a pattern."""
    return f"""SELECT id, unit, text, ms[j] AS marker, CAST(list_sum(list_transform(hs[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:j - 1], lambda x: length(x))), 0) AS INTEGER) AS start
        FROM (SELECT *, string_split_regex(text, '{pattern}') AS hs, unnest(range(1, len(ms) + 1)) AS j FROM (SELECT *, regexp_extract_all(text, '{pattern}') AS ms FROM {source}))"""


_PLAIN = r"regexp_replace(trim(regexp_replace(regexp_replace(lower({c}), '\p{{P}}+', '', 'g'), '\s+', ' ', 'g')), '([12][0-9]{{3}})[a-z]$', '\1')"


@query(f"""{_NAMED}, f AS ({_places_sql(M.MARKERS['named'][0])}), q AS (SELECT *, unnest(string_split_regex(marker[2:-2], '; ?')) AS piece FROM f),
    keys AS (SELECT id, {_PLAIN.format(c="key || ' ' || year")} AS key, min(n) AS n FROM k GROUP BY 1, 2)
    SELECT q.id, unit, n, start, CAST(start + length(marker) AS INTEGER) AS stop FROM q JOIN keys ON keys.id = q.id AND keys.key = {_PLAIN.format(c="piece")}""")
def named_mentions(spark, sf_dir):
    units, records = _named(spark, sf_dir)
    return M.marked(units, records, "named")


def _numbered(spark, sf_dir):
    """A paragraph a line of a document, most with numbers of its five records."""
    docs = table(spark, sf_dir, "documents")
    rows = lines(docs).select(F.col("doc_id").alias("id"), F.col("line_no").alias("unit"), F.col("line").alias("t"))
    texts = ["%s As in [1, 3] it holds. More.", "%s.⍐2⍗ Next one of [4]", "(2-4) %s", "%s (1) and (5).(3)", "%s", "[9] [2]%s.", "⍐7⍗ %s (1) . ", "%s (3,1)"]
    case = F.pmod(F.col("id") * 3 + F.col("unit"), F.lit(8))
    text = F.coalesce(*[F.when(case == i, F.format_string(t, F.col("t"))) for i, t in enumerate(texts)])
    return rows.select("id", "unit", text.alias("text")), docs.filter("text is not null").select(F.col("doc_id").alias("id")).distinct().select("id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("n"))


_NUMBERED = f"""WITH u AS (SELECT doc_id AS id, line_no AS unit, CASE (doc_id * 3 + line_no) % 8 WHEN 0 THEN line || ' As in [1, 3] it holds. More.' WHEN 1 THEN line || '.⍐2⍗ Next one of [4]' WHEN 2 THEN '(2-4) ' || line
        WHEN 3 THEN line || ' (1) and (5).(3)' WHEN 4 THEN line WHEN 5 THEN '[9] [2]' || line || '.' WHEN 6 THEN '⍐7⍗ ' || line || ' (1) . ' ELSE line || ' (3,1)' END AS text FROM ({LINES_SQL})),
    f AS ({_places_sql(M.MARKERS["number"][0])}),
    q AS (SELECT *, unnest(string_split_regex(regexp_replace(regexp_replace(marker, '^\\.?[\\[(⍐]', ''), '[\\])⍗]$', ''), '{M.MARKERS["number"][1]}')) AS piece FROM f),
    r AS (SELECT *, unnest(CASE WHEN regexp_full_match(piece, '[0-9]+-[0-9]+') THEN range(CAST(split_part(piece, '-', 1) AS INTEGER), CAST(split_part(piece, '-', 2) AS INTEGER) + 1)
        WHEN regexp_full_match(piece, '[0-9]+') THEN [CAST(piece AS BIGINT)] ELSE [] END) AS n FROM q),
    m AS (SELECT id, unit, text, CAST(n AS INTEGER) AS n, CAST(start + CAST(marker[1] = '.' AS INTEGER) AS INTEGER) AS start, CAST(start + length(marker) AS INTEGER) AS stop FROM r WHERE n BETWEEN 1 AND 5)"""


@query(f"{_NUMBERED} SELECT id, unit, n, start, stop FROM m")
def numbered_mentions(spark, sf_dir):
    return M.marked(*_numbered(spark, sf_dir), "number")


_CONTEXTS = f"""{_NUMBERED},
    b AS (SELECT *, CASE WHEN substr(text, start + 1, 1) IN ('(', '[', '.', '⍐') THEN rtrim(left(text, start), '([.⍐') ELSE left(text, start) END AS back, substr(text, stop + 1) AS rest FROM m),
    c AS (SELECT *, length(back) - length(string_split(back, '.')[-1]) AS s0, CASE WHEN contains(rest, '.') THEN stop + strpos(rest, '.') ELSE length(text) END AS e FROM b),
    d AS (SELECT *, CASE WHEN substr(text, s0 + 1, 1) = '⍐' AND strpos(substr(text, s0 + 1), '⍗') > 0 AND s0 + strpos(substr(text, s0 + 1), '⍗') - 1 < start THEN s0 + strpos(substr(text, s0 + 1), '⍗') ELSE s0 END AS s1 FROM c),
    w AS (SELECT *, substr(text, s1 + 1, e - s1) AS whole, regexp_replace(substr(text, s1 + 1, e - s1), '^[\\x00-\\x20]+', '') AS rear FROM d),
    x AS (SELECT id, unit, start AS place, n, regexp_replace(rear, '[\\x00-\\x20]+$', '') AS context, CAST(start - s1 - (length(whole) - length(rear)) AS INTEGER) AS start,
        CAST(stop - s1 - (length(whole) - length(rear)) AS INTEGER) AS stop FROM w),
    ctx AS (SELECT * FROM x WHERE length(context) - (stop - start) >= 35)"""


@query(f"{_CONTEXTS} SELECT * FROM ctx")
def mention_contexts(spark, sf_dir):
    units, records = _numbered(spark, sf_dir)
    return M.with_contexts(M.marked(units, records, "number"), units)


@query(f"""{_CONTEXTS}, g AS (SELECT *, CASE WHEN substr(context, start + 1, 1) IN ('(', '[', '⍐') THEN substr(context, start + 1, 1) ELSE '' END AS sign FROM ctx),
    run AS (SELECT *, row_number() OVER (PARTITION BY id, sign ORDER BY unit, place, n) AS so_far, row_number() OVER (PARTITION BY id ORDER BY unit, place, n) AS turn FROM g),
    lead AS (SELECT id, sign FROM run QUALIFY row_number() OVER (PARTITION BY id ORDER BY so_far DESC, turn) = 1),
    sq AS (SELECT id, count(*) AS n FROM g WHERE sign = '[' GROUP BY id),
    st AS (SELECT lead.id, CASE WHEN sign = '(' AND coalesce(sq.n, 0) > 4 THEN '[' ELSE sign END AS style FROM lead LEFT JOIN sq USING (id))
    SELECT g.id, unit, place, g.n, replace(replace(context, '⍐', '('), '⍗', ')') AS context, start, stop, style FROM g JOIN st ON st.id = g.id WHERE style = '' OR style = sign""")
def kept_mentions(spark, sf_dir):
    units, records = _numbered(spark, sf_dir)
    return M.kept_in_style(units, records, "number")
