"""Tokens of glyphs, on runs made from the lines of documents, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import glyphs as G
from ..sources.derived import LINES_SQL, lines, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def glyph_runs(spark, sf_dir):
    """A run a line: 6 apart, back to the left after 80 glyphs; of 17 glyphs three are at times raised, and one a ligature."""
    chars = F.filter(F.split("line", ""), lambda c: c != "")
    # by the place in three turns of 17: the sign in place of the glyph, and the height
    cycle = [(t, p, (t != 1 and 8 <= p <= 10) or (t == 1 and p == 8)) for t in range(3) for p in range(17)]
    signs = F.array(*[F.lit(("a" if t == 2 else "," if p == 9 else "7") if up else "ﬁ" if p == 13 else None) for t, p, up in cycle])
    heights = F.array(*[F.lit(4.5 if up else 1.0 if p == 15 else 10.0) for _, p, up in cycle])

    def glyph(c, i):
        k = F.pmod(i, F.lit(51))
        return F.struct(
            F.coalesce(F.get(signs, k), c).alias("char"), (6.0 * F.pmod(i, F.lit(80))).alias("x"), (12.0 * F.col("line_no") + F.get(heights, k)).alias("y"), F.lit(5.0).alias("width"), F.get(heights, k).alias("height"),
            F.when(i % 2 == 0, "Serif").otherwise("Sans").alias("font"), F.when(F.col("line_no") % 5 == 0, 105.0).otherwise(10.0).alias("size"), F.lit(2.5).alias("space"),
        )

    return lines(table(spark, sf_dir, "documents")).select("doc_id", "line_no", F.transform(chars, glyph).cast(f"array<{G.GLYPH}>").alias("glyphs"))


_GLYPHS = rf"""l AS (SELECT doc_id, line_no, unnest(string_split(line, '')) AS c, generate_subscripts(string_split(line, ''), 1) - 1 AS i FROM ({LINES_SQL}) WHERE line <> ''),
    u AS (SELECT *, ((i // 17) % 3 <> 1 AND i % 17 BETWEEN 8 AND 10) OR ((i // 17) % 3 = 1 AND i % 17 = 8) AS up FROM l),
    g AS (SELECT doc_id, line_no, i, CASE WHEN up THEN CASE WHEN (i // 17) % 3 = 2 THEN 'a' WHEN i % 17 = 9 THEN ',' ELSE '7' END WHEN i % 17 = 13 THEN chr(64257) ELSE c END AS ch,
        CAST(6 * (i % 80) AS DOUBLE) AS x, CAST(12 * line_no AS DOUBLE) + h AS y, h, CASE WHEN i % 2 = 0 THEN 'Serif' ELSE 'Sans' END AS font, CASE WHEN line_no % 5 = 0 THEN 10.5 ELSE 10.0 END::DOUBLE AS size
        FROM (SELECT *, CASE WHEN up THEN 4.5 WHEN i % 17 = 15 THEN 1.0 ELSE 10.0 END::DOUBLE AS h FROM u))"""
_TOKENS = rf"""WITH {_GLYPHS}, b AS (SELECT *, NOT regexp_matches(ch, '[^\x00-\x20]') AS blank, coalesce(lag(x) OVER w > 0 AND x < lag(x) OVER w, false) AS back FROM g WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY i)),
    p AS (SELECT *, sum(CASE WHEN blank OR back THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, line_no ORDER BY i) AS piece FROM b),
    t AS (SELECT *, min(y - h) OVER q AS y0, max(y) OVER q AS y1 FROM p WHERE NOT blank WINDOW q AS (PARTITION BY doc_id, line_no, piece)),
    f AS (SELECT *, y <= (y0 + y1) / 2 AND (y0 + y1) / 2 - y <= (y1 - y0) / 6 AS raised FROM t),
    k AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, line_no, piece, raised ORDER BY i) AS island FROM f),
    s AS (SELECT doc_id, line_no, piece, raised, island, min(i) AS i, string_agg(ch, '' ORDER BY i) AS part FROM k GROUP BY ALL),
    x AS (SELECT doc_id, line_no, piece, string_agg(CASE WHEN NOT raised THEN part WHEN regexp_full_match(part, '{G.RAISED}') THEN '{G.SUPER}' || part || '{G.UNSUPER}' ELSE '' END, '' ORDER BY i) AS token FROM s GROUP BY ALL),
    o AS (SELECT doc_id, line_no, piece, min(x) AS x0, min(y0) AS y0, max(x) + 5.0 AS x1, max(y1) AS y1, arg_min(font, i) AS font, min(size) AS size FROM f GROUP BY ALL)
    SELECT doc_id, line_no, CAST(row_number() OVER (PARTITION BY doc_id, line_no ORDER BY piece) - 1 AS INTEGER) AS n, replace(token, chr(64257), 'fi') AS token, x0, y0, x1, y1, font || '_' || size || '_2.5' AS font, size
    FROM o JOIN x USING (doc_id, line_no, piece)"""
ORACLE_SQL["glyph_tokens"] = _TOKENS


def glyph_tokens(spark, sf_dir):
    """Tokens, bounds, fonts and superscripts of all lines."""
    return G.tokens(glyph_runs(spark, sf_dir), "doc_id", "line_no")


QUERIES["glyph_tokens"] = glyph_tokens
