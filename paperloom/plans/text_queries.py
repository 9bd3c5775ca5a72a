"""Queries over strings and names, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as T
from ..sources.derived import LINES_SQL, TOKENS_SQL, author_name_sql, author_names, lines, table, tokens

QUERIES: dict = {}
ORACLE_SQL: dict = {}

_TITLES_SQL = "SELECT doc_id, split_part(text, chr(10), 1) AS t FROM documents"
_NORM_SQL = r"trim(regexp_replace(regexp_replace(strip_accents(lower({})), '{}', '{}', 'g'), ' +', ' ', 'g'))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def titles(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("t"))


def words(spark, sf_dir):
    return tokens(table(spark, sf_dir, "documents")).select("token").distinct()


def names(spark, sf_dir):
    return author_names(table(spark, sf_dir, "part"))


@query(f"SELECT doc_id, {_NORM_SQL.format('text', chr(92) + 'p{P}', ' ')} AS norm FROM documents")
def text_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize("text").alias("norm"))


@query(f"SELECT doc_id, {_NORM_SQL.format('text', '[^A-Za-z0-9]', ' ')} AS norm, regexp_replace(strip_accents(lower(text)), '[^A-Za-z0-9]', '', 'g') AS joined FROM documents")
def alnum_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.alnum_normalize("text").alias("norm"), T.alnum_normalize_no_spaces("text").alias("joined"))


@query("""SELECT doc_id, regexp_replace(lower(t), '[^a-z]', '', 'g') AS strict,
    array_to_string(list_transform(string_split(lower(t), '|'), lambda p: regexp_replace(p, '[^a-z0-9]', '', 'g')), '|') AS mention FROM (""" + _TITLES_SQL + ")")
def strict_normalize(spark, sf_dir):
    return titles(spark, sf_dir).select("doc_id", T.strict_normalize("t").alias("strict"), T.mention_normalize("t").alias("mention"))


@query("SELECT doc_id, strip_accents(text) AS plain FROM documents")
def strip_diacritics(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.remove_diacritics("text").alias("plain"))


@query(r"SELECT doc_id, replace(text, chr(10), '\n') AS line FROM documents")
def single_line(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.single_line("text").alias("line"))


@query(r"SELECT doc_id, regexp_replace(translate(text, '‘’“”–—', '''''""--'), '[\x00-\x09\x0B-\x1F\x7F]', '', 'g') AS plain FROM documents")
def normalize_characters(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_characters("text").alias("plain"))


def _sound_sql() -> str:
    rest = "substr(s, 2)"
    for letters, digit in T.SOUND_GROUPS:
        rest = f"regexp_replace({rest}, '{letters}', '{digit}', 'g')"
    rest = f"regexp_replace(regexp_replace({rest}, '[0-9]*([0-9])', '\\1', 'g'), '[aeiouy]', '', 'g')"
    return f"""SELECT token, CASE WHEN s = '' THEN '' ELSE left(s, 1) || left({rest} || '000', 3) END AS code
        FROM (SELECT DISTINCT token, regexp_replace(lower(token), '[^a-z]', '', 'g') AS s FROM ({TOKENS_SQL}))"""


@query(_sound_sql())
def soundex_words(spark, sf_dir):
    return words(spark, sf_dir).select("token", T.sound_code("token").alias("code"))


@query(f"SELECT doc_id, array_to_string(list_transform(string_split(t, ' '), lambda w: left(regexp_replace(lower(w), '[^a-z]', '', 'g'), 3)), ' ') AS short FROM ({_TITLES_SQL})")
def truncate_words(spark, sf_dir):
    return titles(spark, sf_dir).select("doc_id", T.truncate_words("t").alias("short"))


_CLEAN_SQL = r"regexp_replace(regexp_replace(strip_accents({}), '&[^;\n]*;', '', 'g'), '\.$', '')"


@query(f"""SELECT doc_id, {_CLEAN_SQL.format('t')} AS clean, regexp_replace({_CLEAN_SQL.format('lower(trim(t))')}, '[^A-Za-z0-9_]', '', 'g') AS key FROM ({_TITLES_SQL})""")
def title_key(spark, sf_dir):
    return titles(spark, sf_dir).select("doc_id", T.clean_title("t").alias("clean"), T.title_key("t").alias("key"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(t, '([a-z])- ', '\1', 'g'), '[^A-Za-z0-9_?")]$', '')) AS fixed FROM (""" + _TITLES_SQL + ")")
def fix_extracted_title(spark, sf_dir):
    return titles(spark, sf_dir).select("doc_id", T.fix_extracted_title("t").alias("fixed"))


@query(f"SELECT page_id, {_CLEAN_SQL.format('t')} AS clean FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages)")
def clean_entities(spark, sf_dir):
    t = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", T.clean_title(t).alias("clean"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\r\t\n]', ' ', 'g'), ' +', ' ', 'g')) AS line FROM documents")
def clean_line(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_line("text").alias("line"))


_BROKEN_SQL = "SELECT doc_id, regexp_replace(text, 'e.?\\n', 'e-<lb>', 'g') AS b FROM documents"


@query(f"""SELECT doc_id, replace(replace(b, '-<lb>', ''), '<lb>', ' ') AS joined, replace(regexp_replace(b, '-<lb>(\\p{{Ll}})', '\\1', 'g'), '<lb>', ' ') AS careful FROM ({_BROKEN_SQL})""")
def join_broken_lines(spark, sf_dir):
    b = F.regexp_replace("text", "e.?\\n", "e-<lb>")
    return table(spark, sf_dir, "documents").select("doc_id", T.join_broken_lines(b).alias("joined"), T.join_broken_lines(b, "lower").alias("careful"))


_GAZ_KEY_SQL = r"trim(regexp_replace(regexp_replace(lower({}), '\p{{P}}+', ' ', 'g'), '  +', ' ', 'g'))"


@query(f"SELECT doc_id, line_no, {_GAZ_KEY_SQL.format('line')} AS key, length(trim(line)) - length(replace(trim(line), ' ', '')) < 7 AS short FROM ({LINES_SQL})")
def gazetteer_key(spark, sf_dir):
    return lines(table(spark, sf_dir, "documents")).select("doc_id", "line_no", T.gazetteer_key("line").alias("key"), T.within_length("line").alias("short"))


@query("SELECT doc_id, sha1(text) AS sha FROM documents")
def doc_sha1(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha1("text").alias("sha"))


@query()
def string_hash(spark, sf_dir):
    """64-bit keys of titles; the hash function has no counterpart in SQL."""
    return titles(spark, sf_dir).select("doc_id", F.xxhash64("t").alias("hash"))


_MAIL_SQL = r"""
    WITH t AS (SELECT doc_id, line_no, pos, regexp_replace(token, '[^\x20-\x7E]', '', 'g') AS t0 FROM ({tokens}) WHERE token LIKE '%@%'),
    c AS (SELECT *, CASE WHEN len(list_filter(string_split(t0, ':'), lambda p: p <> '')) > 1 THEN string_split(t0, ':')[2] ELSE t0 END AS t1 FROM t),
    p AS (SELECT *, string_split(regexp_replace(t1, '@+$', ''), '@') AS parts FROM c),
    n AS (
        SELECT doc_id, line_no, pos, parts[2] AS domain, parts[1] AS names,
            regexp_matches(parts[1], '^\{{.*\}}$') OR regexp_matches(parts[1], '^\[.*\]$') OR contains(parts[1], ',') OR contains(parts[1], '|') AS listed
        FROM p WHERE len(parts) = 2
    )
    SELECT doc_id, line_no, pos, trim(name) || '@' || domain AS email FROM (
        SELECT doc_id, line_no, pos, domain,
            unnest(CASE WHEN listed THEN regexp_split_to_array(regexp_replace(names, '[{{}}\[\]]', '', 'g'), '[,|]') ELSE [names] END) AS name FROM n)
"""


@query(_MAIL_SQL.format(tokens=TOKENS_SQL))
def email_extract(spark, sf_dir):
    toks = tokens(table(spark, sf_dir, "documents")).filter(F.col("token").contains("@"))
    return toks.select("doc_id", "line_no", "pos", F.explode(T.emails("token")).alias("email"))


@query(_MAIL_SQL.format(tokens="SELECT c_custkey AS doc_id, 0 AS line_no, 0 AS pos, 'mail:{' || lower(replace(c_name, '#', '')) || ',' || lower(c_mktsegment) || '}@n' || c_nationkey || '.org' AS token FROM customer"))
def email_lists(spark, sf_dir):
    token = F.format_string("mail:{%s,%s}@n%d.org", F.lower(F.replace("c_name", F.lit("#"), F.lit(""))), F.lower("c_mktsegment"), F.col("c_nationkey"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("line_no"), F.lit(0).alias("pos"), F.explode(T.emails(token)).alias("email"))


@query(f"SELECT doc_id, line_no, CAST(len(string_split(regexp_replace(line, ' +$', ''), ' ')) AS INTEGER) AS n, string_split(regexp_replace(line, ' +$', ''), ' ')[1] AS head FROM ({LINES_SQL}) WHERE line <> '' AND trim(line) <> ''")
def tokenize_lines(spark, sf_dir):
    found = lines(table(spark, sf_dir, "documents")).filter("line <> '' and trim(line) <> ''").withColumn("toks", T.tokenize("line"))
    return found.select("doc_id", "line_no", F.size("toks").alias("n"), F.get("toks", F.lit(0)).alias("head"))


_YEARS = "list_transform(regexp_extract_all(text, '[1-2][0-9][0-9][0-9]'), lambda y: CAST(y AS INTEGER))"


@query(f"""SELECT doc_id, coalesce(list_filter(ys, lambda y: y > 1800 AND y < 2036)[1], ys[-1], 0) AS year, regexp_extract(text, '(19[0-9]{{2}}|20[0-9]{{2}})', 1) AS modern,
    regexp_extract(text, '([0-9]{{4}})', 1) AS four, CASE WHEN regexp_extract(text, '\\(([0-9]{{4}})', 1) BETWEEN '1800' AND '2100' THEN regexp_extract(text, '\\(([0-9]{{4}})', 1) ELSE '' END AS bracketed
    FROM (SELECT doc_id, text, {_YEARS} AS ys FROM documents)""")
def ref_year(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.ref_year("text").alias("year"), T.modern_year("text").alias("modern"), T.first_four_digits("text").alias("four"), T.bracket_year("text").alias("bracketed"))


@query(f"SELECT doc_id, concat_ws(' ', ws[1], ws[-1]) AS ends FROM (SELECT doc_id, regexp_split_to_array(t, '\\s+') AS ws FROM ({_TITLES_SQL}))")
def first_last_word(spark, sf_dir):
    return titles(spark, sf_dir).select("doc_id", T.first_and_last_word("t").alias("ends"))


@query(f"""SELECT doc_id, trim(regexp_replace(replace(regexp_replace(replace(strip_accents(lower(t)), ')', chr(1)), '\\p{{P}}', '', 'g'), chr(1), ')'), '^$', '')) AS author,
    trim(regexp_replace(replace(regexp_replace(replace(strip_accents(lower(t)), ')', chr(1)), '\\p{{P}}', ' ', 'g'), chr(1), ')'), ' +', ' ', 'g')) AS title FROM ({_TITLES_SQL})""")
def eval_normalizers(spark, sf_dir):
    return titles(spark, sf_dir).select("doc_id", T.eval_author("t").alias("author"), T.eval_title("t").alias("title"))


@query(f"""SELECT doc_id, CASE WHEN regexp_matches(s, '\\p{{L}}') THEN s ELSE '' END AS title FROM (
    SELECT doc_id, regexp_replace(regexp_replace(t, '^[,.\\s]+', ''), '[,.\\s]+$', '') AS s FROM ({_TITLES_SQL}))""")
def title_guard(spark, sf_dir):
    return titles(spark, sf_dir).select("doc_id", T.title_or_empty("t").alias("title"))


@query(r"SELECT doc_id, regexp_replace(s, '[⍐-⍗][^⍐-⍗]*[⍐-⍗]', '', 'g') AS plain, translate(s, '⍐⍗', '()') AS bracketed FROM (SELECT doc_id, replace(split_part(text, chr(10), 1), ' th', ' ⍐1⍗ th') AS s FROM documents)")
def superscripts(spark, sf_dir):
    s = F.replace(F.split_part("text", F.lit("\n"), F.lit(1)), F.lit(" th"), F.lit(" ⍐1⍗ th"))
    return table(spark, sf_dir, "documents").select("doc_id", T.strip_superscripts(s).alias("plain"), T.superscripts_to_brackets(s).alias("bracketed"))


# names

_NAMES_SQL = author_name_sql()


@query(f"""WITH n AS ({_NAMES_SQL}), w AS (SELECT p_partkey, name, string_split(name, ' ') AS w FROM n),
    a AS (SELECT *, len(w) AS k, CASE WHEN w[-1] IN ('Jr.', 'Sr.', 'II', 'III') AND len(w) > 1 THEN len(w) - 1 ELSE len(w) END AS l FROM w),
    b AS (SELECT *, CASE WHEN l > 2 AND w[l - 1] IN ('van', 'da', 'von') THEN l - 1 ELSE l END AS m FROM a)
    SELECT p_partkey, CASE WHEN k = 1 THEN '' ELSE array_to_string(w[1:m - 1], ' ') END AS first_name, CASE WHEN k = 1 THEN name ELSE array_to_string(w[m:k], ' ') END AS last_name FROM b""")
def split_name(spark, sf_dir):
    return names(spark, sf_dir).withColumn("s", N.split_name("name")).select("p_partkey", F.col("s.first").alias("first_name"), F.col("s.last").alias("last_name"))


@query(f"SELECT p_partkey, list_filter(regexp_split_to_array(name, '\\s+'), lambda w: w <> 'Jr.')[-1] AS last_name, regexp_replace(lower(string_split(name, ' ')[-1]), '[^a-z0-9_]', '', 'g') AS key FROM ({_NAMES_SQL})")
def last_name(spark, sf_dir):
    return names(spark, sf_dir).select("p_partkey", N.eval_last_name("name").alias("last_name"), N.last_name_key("name").alias("key"))


_FIX_SQL = r"(CASE WHEN {s} LIKE '%Jr' THEN {s} || '.' ELSE {s} END)"


def _fix_sql(c: str) -> str:
    return _FIX_SQL.format(s=f"split_part(regexp_replace({c}, '[^\\p{{Ll}}\\p{{Lu}}]+$', ''), ',', 1)")


@query(f"SELECT p_partkey, {_fix_sql('name')} AS fixed FROM ({_NAMES_SQL})")
def fix_authors(spark, sf_dir):
    return names(spark, sf_dir).select("p_partkey", N.fix_author("name").alias("fixed"))


_LISTS_SQL = f"SELECT p_partkey, name, lag(name, 1, '') OVER (ORDER BY p_partkey) AS other FROM ({_NAMES_SQL})"


def name_lists(spark, sf_dir):
    """Pairs of authors in one string: a part's and that of the part whose key is one less."""
    own = names(spark, sf_dir)
    before = own.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("name").alias("other"))
    return own.join(before, "p_partkey", "left").fillna("", ["other"])


@query(f"""SELECT p_partkey, array_to_string(list_distinct_ordered, ';') AS authors FROM (
    SELECT p_partkey, list_transform(list_filter(list_transform(fixed, lambda x, i: CASE WHEN length(x) BETWEEN 2 AND 32 AND list_position(fixed, x) = i THEN x END), lambda x: x IS NOT NULL), lambda x: x) AS list_distinct_ordered
    FROM (SELECT p_partkey, list_transform(regexp_split_to_array(name || ' and ' || other, ',|\\band\\b'), lambda a: {_fix_sql('trim(a)')}) AS fixed FROM ({_LISTS_SQL})))""")
def trim_authors(spark, sf_dir):
    return name_lists(spark, sf_dir).select("p_partkey", F.array_join(N.trim_authors(F.array(F.concat_ws(" and ", "name", "other"))), ";").alias("authors"))


@query(f"SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace('A. B. C. ' || name || ' et al.', '(\\b\\p{{Lu}}\\.) (\\p{{Lu}}\\.)', '\\1\\2', 'g'), '(\\b\\p{{Lu}}\\.) (\\p{{Lu}}\\.)', '\\1\\2', 'g'), '\\s*et al\\.?$', '') AS name FROM ({_NAMES_SQL})")
def normalize_initials(spark, sf_dir):
    return names(spark, sf_dir).select("p_partkey", N.normalize_initials(F.concat(F.lit("A. B. C. "), "name", F.lit(" et al."))).alias("name"))


@query(f"SELECT p_partkey, CASE WHEN len(s) = 2 THEN s[2] || ' ' || s[1] ELSE name END AS name FROM (SELECT p_partkey, name, regexp_split_to_array(name, '\\s*,\\s*') AS s FROM ({_NAMES_SQL}))")
def invert_comma(spark, sf_dir):
    return names(spark, sf_dir).select("p_partkey", N.invert_around_comma("name").alias("name"))


@query(f"""SELECT p_partkey, regexp_replace(CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN k WHEN 2 THEN k || ' and ' || k ELSE k || ' et al.' END, '\\p{{P}}', '.', 'g') AS key
    FROM (SELECT p_partkey, split_part(name, ' ', 1) AS k FROM ({_NAMES_SQL}))""")
def cite_author_key(spark, sf_dir):
    k = F.split_part("name", F.lit(" "), F.lit(1))
    return names(spark, sf_dir).select("p_partkey", N.cite_author_key(F.array_repeat(k, F.pmod("p_partkey", F.lit(4)).cast("int"))).alias("key"))


@query(f"""SELECT p_partkey, CAST(len(list_filter([k1, k2], lambda x: x = g)) AS INTEGER) AS hits FROM (
    SELECT p_partkey, regexp_replace(lower(string_split(name, ' ')[-1]), '[^a-z0-9_]', '', 'g') AS k1, regexp_replace(lower(string_split(other, ' ')[-1]), '[^a-z0-9_]', '', 'g') AS k2,
        regexp_replace(lower(string_split(name, ' ')[-1]), '[^a-z0-9_]', '', 'g') AS g FROM ({_LISTS_SQL}))""")
def score_authors(spark, sf_dir):
    return name_lists(spark, sf_dir).select("p_partkey", N.score_authors(F.array("name", "other"), F.array("name")).alias("hits"))


@query()
def author_list(spark, sf_dir):
    """Author strings of several shapes, split; checked against literal cases in the tests."""
    return name_lists(spark, sf_dir).select("p_partkey", F.array_join(N.author_list(F.concat_ws(" and ", "name", "other")), ";").alias("authors"))
