"""Sections of pages and of pages with more headings, made from them, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sections as S
from ..sources.derived import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _headed(spark, sf_dir):
    """Every page; each second paragraph has a heading before it, of level 2 to 5, each seventh one *References:* and some left open."""
    case = lambda i: F.pmod(F.col("page_id") + i, F.lit(7))
    level = lambda i: (2 + F.pmod(F.col("page_id") + i * i, F.lit(4))).cast("string")
    name = lambda i: F.when(case(i) == 0, "References:").when(case(i) == 1, "Open &amp; <i>n</i>ear").otherwise(F.concat(F.lit("Part "), i.cast("string")))
    head = lambda i: F.when((i == 0) | (i % 2 == 1), "").otherwise(F.concat(F.lit("<h"), level(i), F.lit(">"), name(i), F.when(case(i) == 1, "").otherwise(F.concat(F.lit("</h"), level(i), F.lit(">")))))
    parts = F.transform(F.split("html", "<p>"), lambda p, i: F.when(i == 0, p).otherwise(F.concat(head(i), F.lit("<p>"), p)))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(parts, "").alias("html"))


_HEADED = """SELECT page_id, array_to_string([CASE WHEN i = 1 THEN p WHEN i % 2 = 0 THEN '<p>' || p
        ELSE '<h' || (2 + (page_id + (i - 1) * (i - 1)) % 4) || '>' || CASE (page_id + i - 1) % 7 WHEN 0 THEN 'References:' WHEN 1 THEN 'Open &amp; <i>n</i>ear' ELSE 'Part ' || (i - 1) END
            || CASE WHEN (page_id + i - 1) % 7 = 1 THEN '' ELSE '</h' || (2 + (page_id + (i - 1) * (i - 1)) % 4) || '>' END || '<p>' || p END
        FOR p, i IN string_split(html, '<p>')], '') AS html FROM pages"""


def _text(x: str) -> str:
    x = f"regexp_replace(regexp_replace({x}, '{S.INLINE}', '', 'g'), '<[^>]*>', ' ', 'g')"
    for name, char in S.ENTITIES:
        x = f"replace({x}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _sections(source: str) -> str:
    clean = "replace(html, chr(1), ' ')"
    for pattern in S.UNREAD:
        clean = f"regexp_replace({clean}, '{pattern}', ' ', 'g')"
    words = ", ".join(f"'{w}'" for w in S.REFERENCE_HEADINGS)
    return rf"""WITH src AS ({source}),
        cut AS (SELECT page_id, string_split('0' || regexp_replace({clean}, '{S.HEADING}', chr(1) || '\1', 'g'), chr(1)) AS ps FROM src WHERE html IS NOT NULL),
        piece AS (SELECT page_id, unnest(range(len(ps))) AS n, unnest(ps) AS p FROM cut),
        split AS (SELECT page_id, n, CAST(left(p, 1) AS INTEGER) AS level, substr(p, 2) AS rest, CASE WHEN left(p, 1) <> '0' THEN regexp_extract(substr(p, 2), '{S.HEADING_TEXT}', 1) END AS head FROM piece),
        s AS (SELECT page_id, n, level, {_text("head")} AS heading, {_text("substr(rest, coalesce(length(head), 0) + 1)")} AS text FROM split),
        up AS (SELECT a.page_id, a.n, max(b.n) AS parent FROM s a JOIN s b ON a.page_id = b.page_id AND b.n < a.n AND b.level < a.level GROUP BY ALL),
        down AS (SELECT a.page_id, a.n, min(b.n) AS stop FROM s a JOIN s b ON a.page_id = b.page_id AND b.n > a.n AND b.level <= a.level GROUP BY ALL),
        most AS (SELECT page_id, max(n) AS top FROM s GROUP BY ALL)
        SELECT page_id, CAST(n AS INTEGER) AS n, level, heading, CAST(CASE WHEN level > 0 THEN parent END AS INTEGER) AS parent,
            CAST(CASE WHEN level > 0 THEN coalesce(stop - 1, top) ELSE 0 END AS INTEGER) AS last, text
        FROM s LEFT JOIN up USING (page_id, n) LEFT JOIN down USING (page_id, n) JOIN most USING (page_id)
        WHERE (level > 0 OR text <> '') AND (heading IS NULL OR regexp_replace(lower(trim(heading)), '\p{{P}}+$', '') NOT IN ({words}))"""


@query(_sections("SELECT page_id, html FROM pages"))
def page_sections(spark, sf_dir):
    return S.sections(table(spark, sf_dir, "pages"), "page_id")


@query(_sections(_HEADED))
def nested_sections(spark, sf_dir):
    return S.sections(_headed(spark, sf_dir), "page_id")
