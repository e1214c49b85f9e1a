"""Registry of queries with the SQL that must give the same rows, and SQL shared by many of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import fixed
from ..operators.classify import first_match_rules, weighted_rules
from ..sources.pages import scan_pages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

AS_OF = "1998-01-01"
DAY = AS_OF.replace("-", "")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_pages(spark, f"{sf_dir}/pages.parquet")


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


# --- SQL pieces -----------------------------------------------------------------------------------


def sql_strip(text: str) -> str:
    return rf"regexp_replace({text}, '^[\s\x0b\x1c-\x1f]+|[\s\x0b\x1c-\x1f]+$', '', 'g')"


def sql_clean(text: str) -> str:
    plain = f"translate({text}, '–—‘’“”…', '--''''\"\"')"
    return sql_strip(rf"regexp_replace({plain}, '[^\x00-\x7F]+', '', 'g')")


def sql_unescape(text: str) -> str:
    for entity, character in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{character}')"
    return text


def sql_pieces(html: str) -> str:
    """Stripped, non-empty texts between tags."""
    pieces = f"regexp_split_to_array({html}, '<[^>]+>')"
    return f"[{sql_strip('x')} for x in {pieces} if {sql_strip('x')} <> '']"


def sql_joined(html: str, sep: str = " ") -> str:
    return sql_unescape(f"array_to_string({sql_pieces(html)}, '{sep}')")


VISIBLE = (
    r"regexp_replace(regexp_replace(html, '(?s)<style>.*?</style>|<script>.*?</script>|<!--.*?-->', '<x>', 'g'),"
    r" '<!DOCTYPE[^>]*>', '<x>')"
)
ARTICLE = r"regexp_extract(html, '(?s)<article>(.*)</article>', 1)"

LINKS = f"""links AS (
  SELECT page_id, CAST(i AS INT) AS pos, href[i] AS href, {sql_unescape('text[i]')} AS text
  FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS href,
               regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS text FROM pages),
       unnest(range(1, len(href) + 1)) AS r(i))"""


def sql_any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {quote(w)})" for w in words) + ")"


def _values(rules) -> str:
    rows = ", ".join(f"({quote(r.category)}, {r.ord}, {quote(r.tier)}, {quote(r.keyword)})" for r in rules)
    return f"rules(category, ord, tier, keyword) AS (VALUES {rows})"


# the relation src(id, title, description, company) must exist
_LOWERED = """low AS (SELECT id, lower(coalesce(title, '')) AS t, lower(coalesce(description, '')) AS d,
    lower(coalesce(company, '')) AS c FROM src)"""

HITS = f"""{_values(weighted_rules())}, {_LOWERED},
hits AS (SELECT * FROM (
  SELECT id, category, ord, tier, keyword, CAST(CASE tier
    WHEN 'primary' THEN CASE WHEN contains(t, keyword) THEN 10 WHEN contains(d, keyword) THEN 8 END
    WHEN 'secondary' THEN CASE WHEN contains(t, keyword) THEN 3 WHEN contains(d, keyword) THEN 2
                               WHEN contains(c, keyword) THEN 1 END
    WHEN 'company' THEN CASE WHEN contains(c, keyword) THEN 5 END
    ELSE -3 END AS INT) AS points
  FROM low, rules WHERE contains(t || ' ' || d || ' ' || c, keyword)) WHERE points IS NOT NULL)"""

SCORES = f"""{HITS},
scores AS (SELECT id, category, ord, CAST(sum(points) AS INT) AS score FROM hits GROUP BY ALL)"""


def _fallback() -> str:
    everything = "(t || ' ' || d || ' ' || c)"
    titles = "".join(f" WHEN {sql_any('t', w)} THEN {quote(c)}" for c, w in fixed.FALLBACK_TITLE)
    context = "".join(
        f" WHEN {sql_any(everything, w)} THEN {quote(c)}" for c, w in fixed.FALLBACK_CONTEXT
    )
    roles = f"CASE {context} ELSE {quote(fixed.FALLBACK_ROLE_CATEGORY)} END"
    return (
        f"CASE {titles} WHEN {sql_any('t', fixed.FALLBACK_ROLES)} THEN {roles}"
        f" ELSE {quote(fixed.NO_CATEGORY)} END"
    )


CATEGORIES = f"""{SCORES},
categories AS (SELECT low.id, coalesce(best.category, {_fallback()}) AS category FROM low LEFT JOIN
  (SELECT id, arg_max(category, score * 1000 - ord) AS category FROM scores WHERE score > 0 GROUP BY id) best
  USING (id))"""

FIRST_CATEGORIES = f"""{_values(first_match_rules())}, {_LOWERED},
categories AS (SELECT low.id, coalesce(best.category, {quote(fixed.NO_CATEGORY)}) AS category FROM low LEFT JOIN
  (SELECT id, arg_min(category, ord) AS category FROM low, rules
   WHERE contains(t, keyword) OR contains(d, keyword) OR contains(c, keyword) GROUP BY id) best USING (id))"""

# --- expiry texts in eight forms, one per order ---------------------------------------------------

FORMS = """forms AS (
  SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS day, CAST(o_orderkey % 8 AS INT) AS form FROM orders),
dated AS (SELECT *, CASE form
    WHEN 0 THEN 'Expires ' || strftime(day, '%-d %b %Y')
    WHEN 1 THEN 'Expires ' || strftime(day, '%B %-d, %Y')
    WHEN 2 THEN 'Posted on ' || strftime(day, '%B %-d, %Y')
    WHEN 3 THEN 'Expiry: ' || strftime(day, '%Y-%m-%d')
    WHEN 4 THEN 'Closing date: ' || strftime(day, '%-d %b %Y')
    WHEN 5 THEN 'Closing date: ' || strftime(day, '%B %-d, %Y')
    WHEN 6 THEN 'Apply by ' || strftime(day, '%b %-d, %Y') || ' at noon'
    ELSE 'N/A' END AS expiry_text,
  CASE WHEN form IN (0, 1, 3, 5, 6) THEN day WHEN form = 2 THEN day + 30 END AS strict_day,
  CASE WHEN form = 0 THEN day END AS lenient_day FROM forms)"""

SPARK_EXPIRY_TEXT = """CASE o_orderkey % 8
    WHEN 0 THEN date_format(o_orderdate, "'Expires' d MMM yyyy")
    WHEN 1 THEN date_format(o_orderdate, "'Expires' MMMM d, yyyy")
    WHEN 2 THEN date_format(o_orderdate, "'Posted on' MMMM d, yyyy")
    WHEN 3 THEN date_format(o_orderdate, "'Expiry:' yyyy-MM-dd")
    WHEN 4 THEN date_format(o_orderdate, "'Closing date:' d MMM yyyy")
    WHEN 5 THEN date_format(o_orderdate, "'Closing date:' MMMM d, yyyy")
    WHEN 6 THEN date_format(o_orderdate, "'Apply by' MMM d, yyyy 'at noon'")
    ELSE 'N/A' END"""


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(k, day, expiry_text)`` with the order date written in one of eight forms."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS k", "CAST(o_orderdate AS DATE) AS day", f"{SPARK_EXPIRY_TEXT} AS expiry_text"
    )
