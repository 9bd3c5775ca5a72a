"""Metrics of an extraction against gold, on papers made from documents, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..sources.derived import references, references_sql, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _norm(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(strip_accents(lower({x})), '\p{{P}}', ' ', 'g'), ' +', ' ', 'g'))"


def _norms(x: str) -> str:
    return f"list_transform({x}, lambda a: {_norm('a')})"


#: Items of a record in SQL.
_RECORD_ITEMS = {
    "bibTitles": "[title]", "bibTitlesNormalized": f"[{_norm('title')}]", "bibAuthors": "authors", "bibAuthorsNormalized": _norms("authors"),
    "bibVenues": "[venue]", "bibVenuesNormalized": f"[{_norm('venue')}]", "bibYears": "[nullif(CAST(year AS VARCHAR), '0')]", "bibCounts": "['record']",
    "bibAll": "[concat(title, '|', array_to_string(authors, ':'), '|', venue, '|', year)]",
    "bibAllNormalized": f"[concat({_norm('title')}, '|', array_to_string({_norms('authors')}, ':'), '|', {_norm('venue')}, '|', year)]",
    "bibAllButVenuesNormalized": f"[concat({_norm('title')}, '|', array_to_string({_norms('authors')}, ':'), '|', year)]",
}
_LAST = r"list_filter(regexp_split_to_array(a, '\s+'), lambda w: w <> 'Jr.')[-1]"
_ENDS = r"(regexp_split_to_array(abstract, '\s+')[1] || ' ' || regexp_split_to_array(abstract, '\s+')[-1])"
_PAPER_ITEMS = {
    "authorFullName": "authors", "authorFullNameNormalized": _norms("authors"), "authorLastName": f"list_transform(authors, lambda a: {_LAST})",
    "authorLastNameNormalized": f"list_transform(list_transform(authors, lambda a: {_LAST}), lambda b: {_norm('b')})", "title": "[title]", "titleNormalized": f"[{_norm('title')}]",
    "abstract": f"[{_ENDS}]", "abstractNormalized": f"[{_norm(_ENDS)}]",
}
_MENTION = "concat(context, '|', regexp_replace(mention, '[()]', '', 'g'))"
_MENTION_ITEMS = {"bibMentions": f"[{_MENTION}]", "bibMentionsNormalized": f"[array_to_string(list_transform(string_split(lower({_MENTION}), '|'), lambda p: regexp_replace(p, '[^a-z0-9]', '', 'g')), '|')]"}


def _items(source: str, metrics: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{m}' AS metric, paper, unnest({x}) AS item FROM {source}" for m, x in metrics.items())


def _scores(gold: str, guess: str) -> str:
    once = ", ".join(f"'{m}'" for m in E.SET_METRICS)
    return f"""c AS (SELECT metric, paper, item, sum(a) AS x, sum(b) AS y FROM (SELECT *, 1 AS a, 0 AS b FROM ({gold}) UNION ALL SELECT *, 0, 1 FROM ({guess})) WHERE item <> '' GROUP BY 1, 2, 3),
        d AS (SELECT metric, paper, CASE WHEN metric IN ({once}) THEN least(x, 1) ELSE x END AS x, CASE WHEN metric IN ({once}) THEN least(y, 1) ELSE y END AS y FROM c),
        s AS (SELECT metric, paper, sum(x) AS g, sum(y) AS p, sum(least(x, y)) AS h FROM d GROUP BY 1, 2),
        r AS (SELECT metric, paper, CASE WHEN metric = 'bibCounts' OR (g = 0 AND p = 0) THEN 1.0 WHEN g = 0 OR p = 0 THEN 0.0 ELSE h / p END AS precision,
            CASE WHEN g = 0 THEN 1.0 WHEN metric = 'bibCounts' THEN p / g WHEN p = 0 THEN 0.0 ELSE h / g END AS recall FROM s)"""


_WORDS = [f"upper(left(split_part(p_name, ' ', {k}), 1)) || substr(split_part(p_name, ' ', {k}), 2)" for k in (1, 2)]


@query(f"""WITH gold AS (SELECT section AS paper, n, p_name AS title, ['A. ' || {_WORDS[0]}, 'B. ' || {_WORDS[1]}] AS authors, p_type AS venue, year FROM ({references_sql('bracket')})),
    guess AS (SELECT paper, CASE WHEN n % 4 = 0 THEN title || '!' WHEN n % 4 = 1 THEN upper(title) ELSE title END AS title, CASE WHEN n % 6 = 0 THEN authors[1:1] ELSE authors END AS authors,
        CASE WHEN n % 3 = 0 THEN '' ELSE venue END AS venue, CASE WHEN n % 5 = 0 THEN NULL ELSE year END AS year FROM gold WHERE n % 8 <> 3),
    {_scores(_items("gold", _RECORD_ITEMS), _items("guess", _RECORD_ITEMS))}
    SELECT metric, round(sum(precision) / (SELECT count(DISTINCT paper) FROM gold), 6) AS precision, round(sum(recall) / (SELECT count(DISTINCT paper) FROM gold), 6) AS recall FROM r GROUP BY metric""")
def record_metrics(spark, sf_dir):
    """Every metric of records."""
    names = F.array(*[F.concat(F.lit(f"{i}. "), F.initcap(F.split_part("p_name", F.lit(" "), F.lit(k)))) for k, i in ((1, "A"), (2, "B"))])
    gold = references(table(spark, sf_dir, "part"), "bracket").select(F.col("section").alias("paper"), "n", F.col("p_name").alias("title"), names.alias("authors"), F.col("p_type").alias("venue"), "year")
    title = F.when(F.col("n") % 4 == 0, F.concat("title", F.lit("!"))).when(F.col("n") % 4 == 1, F.upper("title")).otherwise(F.col("title"))
    authors, venue = F.when(F.col("n") % 6 == 0, F.slice("authors", 1, 1)).otherwise(F.col("authors")), F.when(F.col("n") % 3 == 0, "").otherwise(F.col("venue"))
    guess = gold.filter("n % 8 != 3").select("paper", title.alias("title"), authors.alias("authors"), venue.alias("venue"), F.when(F.col("n") % 5 != 0, F.col("year")).alias("year"))
    return E.record_metrics(gold.drop("n"), guess).select("metric", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def gold_papers(spark, sf_dir) -> E.Extraction:
    """Documents as papers: the first line as title, names made of the first six words, the text as abstract, each line as record and context."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper"), "text", F.split("text", "\n").alias("lines"), F.split("text", r"\s+").alias("words"))
    word = lambda i: F.coalesce(F.get("words", F.lit(i)), F.lit(""))
    authors = F.array(*[F.concat(word(2 * i), F.lit(" "), word(2 * i + 1), F.lit(" Jr." if i == 1 else "")) for i in range(3)])
    papers = docs.select("paper", authors.alias("authors"), F.get("lines", F.lit(0)).alias("title"), F.col("text").alias("abstract"))
    lines = docs.select("paper", F.posexplode("lines").alias("i", "line"))
    first, last, n = F.split_part("line", F.lit(" "), F.lit(1)), F.split_part("line", F.lit(" "), F.lit(-1)), F.length("line")
    records = lines.select("paper", "i", F.col("line").alias("title"), F.array(first, last).alias("authors"), F.concat(last, F.lit(" "), first).alias("venue"), F.when(n % 7 != 0, 1950 + n % 70).otherwise(0).alias("year"))
    return E.Extraction(papers, records, lines.select("paper", "i", F.col("line").alias("context"), F.concat(F.lit("("), first, F.lit(")")).alias("mention")))


_WORD = r"coalesce(regexp_split_to_array(text, '\s+')[{}], '')"
_LINES = "(SELECT doc_id AS paper, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)"
_NAMES = ", ".join(f"{_WORD.format(2 * i + 1)} || ' ' || {_WORD.format(2 * i + 2)} || '{' Jr.' if i == 1 else ''}'" for i in range(3))
_GOLD = f"""gp AS (SELECT doc_id AS paper, [{_NAMES}] AS authors, split_part(text, chr(10), 1) AS title, text AS abstract FROM documents WHERE text IS NOT NULL),
    gr AS (SELECT paper, i, line AS title, [split_part(line, ' ', 1), split_part(line, ' ', -1)] AS authors, split_part(line, ' ', -1) || ' ' || split_part(line, ' ', 1) AS venue, CASE WHEN length(line) % 7 <> 0 THEN 1950 + length(line) % 70 ELSE 0 END AS year FROM {_LINES}),
    gm AS (SELECT paper, i, line AS context, '(' || split_part(line, ' ', 1) || ')' AS mention FROM {_LINES})"""
_GUESS = """xp AS (SELECT paper, CASE WHEN paper % 3 = 0 THEN authors[2:] ELSE authors END AS authors, CASE WHEN paper % 9 <> 0 THEN CASE WHEN paper % 4 = 0 THEN replace(title, 'e', 'E') ELSE title END END AS title,
        CASE WHEN paper % 5 <> 0 THEN abstract END AS abstract FROM gp WHERE paper % 11 <> 0),
    xr AS (SELECT paper, CASE WHEN i % 3 = 0 THEN title || '!' ELSE title END AS title, authors, CASE WHEN i % 5 = 1 THEN '' ELSE venue END AS venue, CASE WHEN i % 6 = 0 THEN year + 1 ELSE year END AS year FROM gr WHERE paper % 11 <> 0 AND i % 4 <> 0),
    xm AS (SELECT paper, CASE WHEN i % 3 = 1 THEN replace(context, 'e', 'E') ELSE context END AS context, CASE WHEN i % 2 = 0 THEN replace(mention, '(', '') ELSE mention END AS mention FROM gm WHERE paper % 11 <> 0 AND i % 5 <> 2)"""


def _all(kind: str) -> str:
    return " UNION ALL ".join(_items(f"{kind}{t}", m) for t, m in (("p", _PAPER_ITEMS), ("r", _RECORD_ITEMS), ("m", _MENTION_ITEMS)))


@query(f"""WITH {_GOLD}, {_GUESS}, {_scores(_all("g"), _all("x"))}, k AS (SELECT count(*) AS n, count(*) FILTER (paper % 11 <> 0) AS f FROM gp),
    u AS (SELECT metric, count(*) AS scored, sum(precision) AS p, sum(recall) AS q FROM r WHERE paper % 11 <> 0 GROUP BY 1)
    SELECT metric, n AS papers, n - f AS failed, round((coalesce(p, 0) + f - coalesce(scored, 0)) / n, 6) AS precision, round((coalesce(q, 0) + f - coalesce(scored, 0)) / n, 6) AS recall
    FROM (SELECT unnest([{", ".join(f"'{m}'" for m in (*_PAPER_ITEMS, *_RECORD_ITEMS, *_MENTION_ITEMS))}]) AS metric) JOIN k ON true LEFT JOIN u USING (metric)""")
def gold_metrics(spark, sf_dir):
    """All 21 metrics of an extraction that errs by rule; every eleventh paper fails."""
    gold = gold_papers(spark, sf_dir)
    p, i = F.col("paper"), F.col("i")
    seen = lambda df: df.filter(p % 11 != 0)
    other = lambda c: F.replace(c, F.lit("e"), F.lit("E"))
    papers = seen(gold.papers).select(
        "paper", F.when(p % 3 == 0, F.slice("authors", 2, 2)).otherwise(F.col("authors")).alias("authors"), F.when(p % 9 != 0, F.when(p % 4 == 0, other("title")).otherwise(F.col("title"))).alias("title"),
        F.when(p % 5 != 0, F.col("abstract")).alias("abstract"),
    )
    records = seen(gold.records).filter(i % 4 != 0).select(
        "paper", F.when(i % 3 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title")).alias("title"), "authors", F.when(i % 5 == 1, "").otherwise(F.col("venue")).alias("venue"),
        F.when(i % 6 == 0, F.col("year") + 1).otherwise(F.col("year")).alias("year"),
    )
    mentions = seen(gold.mentions).filter(i % 5 != 2).select(
        "paper", F.when(i % 3 == 1, other("context")).otherwise(F.col("context")).alias("context"), F.when(i % 2 == 0, F.replace("mention", F.lit("("), F.lit(""))).otherwise(F.col("mention")).alias("mention")
    )
    return E.gold_metrics(gold, E.Extraction(papers, records, mentions)).withColumns({c: F.round(c, 6) for c in ("precision", "recall")})
