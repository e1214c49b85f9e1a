"""Text, date, URL and address functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..functions import dates, emails, text, urls
from ..operators import classify as C
from ..operators import extract as X
from ..operators.places import place_by_table
from ..operators import reports
from ..plans.listings import record_id
from ..sources.pages import route_by_host
from .base import (
    AS_OF,
    CATEGORIES,
    DAY,
    FIRST_CATEGORIES,
    FORMS,
    HITS,
    SCORES,
    forms,
    query,
    quote,
    sql_any,
    sql_clean,
    sql_strip,
    table,
)

col = F.col

# --- text -------------------------------------------------------------------------------------------


@query(
    "clean_text",
    f"SELECT doc_id, {sql_clean('concat(chr(10), chr(8220), text, chr(8221), chr(8211), text, chr(8230), chr(9))')}"
    " AS cleaned FROM documents",
)
def _(spark, sf):
    marked = F.concat(F.lit("\n“"), col("text"), F.lit("”–"), col("text"), F.lit("…\t"))
    return table(spark, sf, "documents").select("doc_id", text.clean_text(marked).alias("cleaned"))


@query(
    "truncate_text",
    "SELECT doc_id, "
    + ", ".join(f"left(text, {n}) AS t{n}" for n in (80, 200, 400, 500))
    + " FROM documents",
)
def _(spark, sf):
    cut = [text.truncate(col("text"), n).alias(f"t{n}") for n in (80, 200, 400, 500)]
    return table(spark, sf, "documents").select("doc_id", *cut)


_SQL_LINES = f"[{sql_strip('x')} for x in string_split(text, chr(10)) if {sql_strip('x')} <> '']"


@query(
    "lead_lines",
    f"""SELECT doc_id, CASE WHEN len({_SQL_LINES}) >= 3 THEN array_to_string(list_slice({_SQL_LINES}, 1, 3), ' ')
        ELSE left(text, 200) END AS lead FROM documents""",
)
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.lead_lines(col("text")).alias("lead"))


@query(
    "default_values",
    "SELECT doc_id, coalesce(nullif(regexp_extract(text, '[0-9]+', 0), ''), 'N/A') AS number FROM documents",
)
def _(spark, sf):
    number = F.regexp_extract("text", "[0-9]+", 0)
    return table(spark, sf, "documents").select(
        "doc_id", text.or_default(number, fixed.MISSING).alias("number")
    )


@query(
    "split_title_company",
    """SELECT p_partkey, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN p_brand || ' – ' || p_type END AS company
       FROM part""",
)
def _(spark, sf):
    both = F.concat("p_name", F.lit(" – "), "p_brand", F.lit(" – "), "p_type")
    heading = F.when(col("p_partkey") % 2 == 0, both).otherwise(col("p_name"))
    title, company = text.split_title(heading)
    return table(spark, sf, "part").select("p_partkey", title.alias("title"), company.alias("company"))


_JOB_TEXT = f"{sql_clean('text')} || CASE WHEN doc_id % 3 = 0 THEN ' Apply' ELSE '' END"


@query(
    "looks_like_job",
    f"""SELECT doc_id FROM (SELECT doc_id, {_JOB_TEXT} AS text FROM documents)
        WHERE length(text) >= 20 AND {sql_any('lower(text)', fixed.JOB_TEXT_WORDS)} AND len({_SQL_LINES}) >= 2""",
)
def _(spark, sf):
    marked = F.concat(
        text.clean_text(col("text")), F.when(col("doc_id") % 3 == 0, F.lit(" Apply")).otherwise("")
    )
    docs = table(spark, sf, "documents").select("doc_id", marked.alias("text"))
    return docs.filter(X.looks_like_job(col("text"))).select("doc_id")


# --- dates ------------------------------------------------------------------------------------------


@query(
    "strip_expiry_prefix",
    rf"""WITH {FORMS} SELECT k, {sql_strip(r"regexp_replace(expiry_text, '(?i)^(expires|expiry|closing|closing date)[:\s-]*', '')")}
        AS rest FROM dated""",
)
def _(spark, sf):
    rest = dates.strip_expiry_prefix(col("expiry_text"))
    return forms(spark, sf).select("k", rest.alias("rest"))


@query(
    "parse_date_multi",
    "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 6 < 5 THEN CAST(o_orderdate AS DATE) END AS day FROM orders",
)
def _(spark, sf):
    written = """CASE o_orderkey % 6 WHEN 0 THEN date_format(o_orderdate, 'MMMM d, yyyy')
        WHEN 1 THEN date_format(o_orderdate, 'MMM dd yyyy') WHEN 2 THEN date_format(o_orderdate, 'd MMMM yyyy')
        WHEN 3 THEN date_format(o_orderdate, 'dd MMM, yyyy') WHEN 4 THEN date_format(o_orderdate, 'yyyy-M-d')
        ELSE date_format(o_orderdate, "MMMM d, yyyy 'or so'") END"""
    orders = table(spark, sf, "orders").selectExpr("o_orderkey AS k", f"{written} AS written")
    return orders.select("k", dates.parse_date(col("written")).alias("day"))


@query("parse_expiry_strict", f"WITH {FORMS} SELECT k, strict_day AS expiry FROM dated")
def _(spark, sf):
    return forms(spark, sf).select("k", dates.parse_expiry(col("expiry_text")).alias("expiry"))


@query("parse_expiry_lenient", f"WITH {FORMS} SELECT k, lenient_day AS expiry FROM dated")
def _(spark, sf):
    expiry = dates.parse_expiry(col("expiry_text"), "lenient")
    return forms(spark, sf).select("k", expiry.alias("expiry"))


@query(
    "current_strict", f"WITH {FORMS} SELECT k FROM dated WHERE strict_day >= DATE '{AS_OF}'"
)
def _(spark, sf):
    expiry = dates.parse_expiry(col("expiry_text"))
    return forms(spark, sf).filter(dates.is_current(expiry, AS_OF)).select("k")


@query(
    "current_lenient",
    f"WITH {FORMS} SELECT k FROM dated WHERE lenient_day IS NULL OR lenient_day >= DATE '{AS_OF}'",
)
def _(spark, sf):
    expiry = dates.parse_expiry(col("expiry_text"), "lenient")
    return forms(spark, sf).filter(dates.is_current(expiry, AS_OF, "keep")).select("k")


_POSTED = """CASE k % 4 WHEN 0 THEN date_format(day, "'Posted on' MMMM d, yyyy 'in town'")
    WHEN 1 THEN date_format(day, "'Firm, posted' MMMM d yyyy") WHEN 2 THEN date_format(day, "'posted on' MMM d, yyyy")
    ELSE date_format(day, 'MMMM d, yyyy') END"""


@query(
    "posted_date",
    """SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%B %-d, %Y')
       WHEN 1 THEN strftime(o_orderdate, '%B %-d %Y') WHEN 2 THEN strftime(o_orderdate, '%b %-d, %Y') END AS posted
       FROM orders""",
)
def _(spark, sf):
    return forms(spark, sf).select("k", dates.posted_text(F.expr(_POSTED)).alias("posted"))


# the short form of May is a full month name as well
@query(
    "posted_plus_30",
    """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 < 2 OR o_orderkey % 4 = 2 AND month(o_orderdate) = 5
       THEN CAST(o_orderdate AS DATE) + 30 END AS expiry FROM orders""",
)
def _(spark, sf):
    posted = dates.posted_text(F.expr(_POSTED))
    return forms(spark, sf).select("k", dates.posted_expiry(posted).alias("expiry"))


@query(
    "expiry_label", "SELECT o_orderkey AS k, 'Expires ' || strftime(o_orderdate, '%B %d, %Y') AS label FROM orders"
)
def _(spark, sf):
    return forms(spark, sf).select("k", dates.expiry_label(col("day")).alias("label"))


@query(
    "first_date_text",
    f"""WITH {FORMS} SELECT k, CASE WHEN form IN (1, 2, 5) THEN strftime(day, '%B %-d, %Y')
        WHEN form = 6 THEN strftime(day, '%b %-d, %Y') END AS found FROM dated""",
)
def _(spark, sf):
    return forms(spark, sf).select("k", dates.first_date_text(col("expiry_text")).alias("found"))


@query(
    "detail_date",
    """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 > 0 THEN
       'Expires ' || strftime(CAST(o_orderdate AS DATE) + 30, '%B %d, %Y') END AS label FROM orders""",
)
def _(spark, sf):
    page = """concat('About us\n', CASE k % 3 WHEN 0 THEN lower(date_format(day, 'MMMM d, yyyy'))
        WHEN 1 THEN date_format(day, 'MMMM d, yyyy') ELSE date_format(day, 'MMMM dd yyyy') END,
        '\nJanuary 1, 2001')"""
    # a lower-case date is not read, so the next one is
    shown = F.when(col("k") % 3 > 0, F.expr(page)).otherwise(F.expr("lower(date_format(day, 'MMMM d, yyyy'))"))
    posted = dates.posted_expiry(dates.detail_date_text(shown))
    return forms(spark, sf).select("k", dates.expiry_label(posted).alias("label"))


@query(
    "record_id",
    f"""SELECT o_orderkey AS k, printf('VM_%03d_%03d_{DAY}', (o_orderkey // 10) % 1200, o_orderkey % 10 + 1) AS id
        FROM orders""",
)
def _(spark, sf):
    page = F.expr("CAST((k div 10) % 1200 AS INT)")
    pos = F.expr("CAST(k % 10 + 1 AS INT)")
    return forms(spark, sf).select("k", record_id("VM", page, pos, AS_OF).alias("id"))


# --- URLs -------------------------------------------------------------------------------------------

_HREF = """CASE o_orderkey % 5 WHEN 0 THEN concat('/job/', o_orderkey) WHEN 1 THEN concat('jobs/', o_orderkey)
    WHEN 2 THEN concat('https://o.example/', o_orderkey) WHEN 3 THEN concat('mailto:x', o_orderkey, '@y.example')
    ELSE concat('/Vacancy/', o_orderkey) END"""


@query(
    "absolute_url",
    f"SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 IN (0, 4) THEN 'https://h.example' ELSE '' END || {_HREF} AS url FROM orders",
)
def _(spark, sf):
    url = urls.absolute_url(F.expr(_HREF), "https://h.example")
    return table(spark, sf, "orders").select(col("o_orderkey").alias("k"), url.alias("url"))


@query(
    "http_only",
    f"SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 5 = 2",
)
def _(spark, sf):
    kept = table(spark, sf, "orders").filter(urls.is_http(F.expr(_HREF)))
    return kept.select(col("o_orderkey").alias("k"))


@query("href_hint", "SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 5 IN (0, 4)")
def _(spark, sf):
    kept = table(spark, sf, "orders").filter(urls.href_hint(F.expr(_HREF)))
    return kept.select(col("o_orderkey").alias("k"))


@query(
    "resolve_url",
    """WITH b AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS page, regexp_replace(url, '[?#].*$', '') AS path,
         regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') AS dir,
         regexp_extract(url, '^https?://[^/]+', 0) AS origin FROM pages)
       SELECT page_id, dir || 'item/1' AS relative, origin || '/item?x=1' AS rooted, path || '?page=2' AS query,
         page || '#next' AS fragment, CASE WHEN dir = origin || '/' THEN dir ELSE regexp_replace(dir, '[^/]+/$', '') END
         || 'x' AS up, regexp_extract(origin, '^https?:', 0) || '//o.example/y' AS other_host, 'mailto:a@b.c' AS foreign_url
       FROM b""",
)
def _(spark, sf):
    refs = {
        "relative": "item/1",
        "rooted": "/item?x=1",
        "query": "?page=2",
        "fragment": "#next",
        "up": "../x",
        "other_host": "//o.example/y",
        "foreign_url": "mailto:a@b.c",
    }
    resolved = [urls.resolve_url(col("url"), F.lit(ref)).alias(name) for name, ref in refs.items()]
    return table(spark, sf, "pages").select("page_id", *resolved)


@query(
    "page_number_text",
    "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS n FROM orders",
)
def _(spark, sf):
    shown = F.expr("CASE k % 3 WHEN 0 THEN CAST(k AS STRING) WHEN 1 THEN 'Next' ELSE concat(k, ',1') END")
    return forms(spark, sf).select("k", urls.number(shown).alias("n"))


_PAGE_HREF = "CASE k % 4 WHEN 0 THEN concat('?page=', k) WHEN 1 THEN concat('/page/', k, '/') WHEN 2 THEN concat('?paged=', k) ELSE '/about' END"


@query(
    "page_number_href",
    """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey END AS by_parameter,
       CASE WHEN o_orderkey % 4 = 1 THEN o_orderkey END AS by_path,
       CASE WHEN o_orderkey % 4 < 2 THEN o_orderkey END AS last_link,
       CASE WHEN o_orderkey % 4 IN (0, 2) THEN o_orderkey END AS paged FROM orders""",
)
def _(spark, sf):
    patterns = {
        "by_parameter": r"page=(\d+)",
        "by_path": r"/page/(\d+)/",
        "last_link": r"page[=/](\d+)",
        "paged": r"pag(?:e|ed)=(\d+)",
    }
    found = [urls.page_number(F.expr(_PAGE_HREF), p).alias(name) for name, p in patterns.items()]
    return forms(spark, sf).select("k", *found)


@query(
    "page_number_text_label",
    "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END AS n FROM orders",
)
def _(spark, sf):
    shown = F.expr("concat('See Page', CASE k % 2 WHEN 0 THEN ' ' ELSE '\n' END, format_number(k, 0), ' of many')")
    return forms(spark, sf).select("k", urls.page_label(shown).alias("n"))


def _near_sql(most: str) -> str:
    numbers = f"[n for n in list_distinct(regexp_extract_all(t, '\\b(\\d+)\\b', 1)) if try_cast(n AS BIGINT) >= 2 {most}]"
    return f"""WITH d AS (SELECT doc_id, {sql_clean('text')} || '; see page ' || (doc_id % 120) AS t FROM documents),
        n AS (SELECT doc_id, t, unnest({numbers}) AS n FROM d),
        w AS (SELECT *, instr(t, n) - 1 AS spot FROM n)
        SELECT d.doc_id, max(CAST(n AS BIGINT)) AS n FROM d LEFT JOIN (SELECT * FROM w WHERE
        {sql_any("lower(substring(t, greatest(spot - 50, 0) + 1, spot + 50 - greatest(spot - 50, 0)))", ['page', 'next', 'previous'])}) w
        USING (doc_id) GROUP BY d.doc_id"""


def _near(spark, sf, most=None):
    shown = F.concat(text.clean_text(col("text")), F.lit("; see page "), col("doc_id") % 120)
    docs = table(spark, sf, "documents").select("doc_id", shown.alias("t"))
    return docs.select("doc_id", urls.page_number_near_words(col("t"), most=most).alias("n"))


@query("page_number_context", _near_sql(""))
def _(spark, sf):
    return _near(spark, sf)


@query("page_number_context_limited", _near_sql("AND try_cast(n AS BIGINT) <= 100"))
def _(spark, sf):
    return _near(spark, sf, most=100)


@query(
    "route_by_host",
    """SELECT page_id, CASE regexp_extract(url, '^https?://([^/?#]+)', 1) WHEN 'blog.tionsh.example.net' THEN 'first'
       WHEN 'thther.example.org' THEN 'second' END AS site FROM pages""",
)
def _(spark, sf):
    hosts = {"blog.tionsh.example.net": "first", "thther.example.org": "second"}
    return route_by_host(table(spark, sf, "pages").select("page_id", "url"), hosts).drop("url")


# --- places, labels -----------------------------------------------------------------------------------

_CITY = "CASE c_custkey % 4 WHEN 0 THEN 'gweru' WHEN 1 THEN 'Harareville' WHEN 2 THEN 'Gweru, near MUTARE' ELSE 'London' END"


def _town_query(whole_word):
    def run(spark, sf):
        shown = F.expr(f"concat(c_name, ' at ', {_CITY})")
        place = F.coalesce(X.place(shown, whole_word=whole_word), F.lit(fixed.DEFAULT_PLACE))
        return table(spark, sf, "customer").select("c_custkey", place.alias("place"))

    return run


for _name, _second in (("place_word", "Zimbabwe"), ("place_substring", "Harare")):
    query(
        _name,
        f"""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Gweru' WHEN 1 THEN '{_second}' WHEN 2 THEN 'Mutare'
            ELSE 'Zimbabwe' END AS place FROM customer""",
    )(_town_query(_name == "place_word"))


@query(
    "labelled_company",
    """SELECT c_custkey, CASE WHEN c_custkey % 4 < 3 THEN left(c_name || repeat(' and sons', c_custkey % 12), 80) END
       AS company FROM customer""",
)
def _(spark, sf):
    page = """concat('Intro\n', CASE c_custkey % 4 WHEN 0 THEN 'Company: ' WHEN 1 THEN 'employer -' WHEN 2 THEN
        'Organisation:\n ' ELSE 'Firm: ' END, c_name, repeat(' and sons', CAST(c_custkey % 12 AS INT)), '\nEmployer: none')"""
    shown = F.when(col("c_custkey") % 4 == 3, F.expr("concat('Firm: ', c_name)")).otherwise(F.expr(page))
    found = X.labelled_field(shown, fixed.COMPANY_LABELS, 80)
    return table(spark, sf, "customer").select("c_custkey", found.alias("company"))


@query(
    "labelled_location",
    """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN n_name END AS location
       FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def _(spark, sf):
    nation = table(spark, sf, "nation")
    customer = table(spark, sf, "customer").join(nation, col("c_nationkey") == col("n_nationkey"))
    page = "concat('x\nLOCATION', CASE WHEN c_custkey % 2 = 0 THEN ' : ' ELSE ' ' END, n_name, '\r\nmore')"
    found = X.labelled_field(F.expr(page), fixed.LOCATION_LABELS, 60)
    return customer.select("c_custkey", found.alias("location"))


# --- contact addresses ------------------------------------------------------------------------------

_SQL_MAIL = (
    f"{sql_clean('text')} || ' ...' || CASE doc_id % 4 WHEN 0 THEN 'Send it to hr' || (doc_id % 7) || ' @ acme . com now'"
    " WHEN 1 THEN 'noreply@x.com; Jobs [at] acme [dot] com' WHEN 2 THEN 'admin [at] acme [dot] com, c.d@e.org c.d@e.org'"
    " ELSE '' END"
)
_MAIL_DOCS = f"WITH d AS (SELECT doc_id, {_SQL_MAIL} AS t FROM documents)"
_SQL_FOUND = (
    f"list_concat(list_concat(regexp_extract_all(t, {quote('(?i)' + emails.PATTERNS[0])}),"
    f" regexp_extract_all(t, {quote('(?i)' + emails.PATTERNS[1])})),"
    f" regexp_extract_all(t, {quote('(?i)' + emails.PATTERNS[2])}))"
)


def _sql_normal(e: str) -> str:
    return f"replace(replace(lower(replace({e}, ' ', '')), '[at]', '@'), '[dot]', '.')"


def _sql_wanted(e: str) -> str:
    return f"NOT {sql_any(f'''lower(replace({e}, ' ', ''))''', fixed.UNWANTED_EMAILS)}"


def _mail_docs(spark, sf):
    tail = """CASE doc_id % 4 WHEN 0 THEN concat('Send it to hr', doc_id % 7, ' @ acme . com now')
        WHEN 1 THEN 'noreply@x.com; Jobs [at] acme [dot] com' WHEN 2 THEN
        'admin [at] acme [dot] com, c.d@e.org c.d@e.org' ELSE '' END"""
    shown = F.concat(text.clean_text(col("text")), F.lit(" ..."), F.expr(tail))
    return table(spark, sf, "documents").select("doc_id", shown.alias("t"))


@query(
    "first_email",
    f"{_MAIL_DOCS} SELECT doc_id, nullif(regexp_extract(t, {quote(fixed.PLAIN_EMAIL)}, 0), '') AS email FROM d",
)
def _(spark, sf):
    return _mail_docs(spark, sf).select("doc_id", emails.first_email(col("t")).alias("email"))


@query("all_emails", f"{_MAIL_DOCS} SELECT doc_id, array_to_string({_SQL_FOUND}, '|') AS emails FROM d")
def _(spark, sf):
    found = F.array_join(emails.all_emails(col("t")), "|")
    return _mail_docs(spark, sf).select("doc_id", found.alias("emails"))


@query(
    "normalize_email",
    f"{_MAIL_DOCS} SELECT doc_id, array_to_string([{_sql_normal('e')} for e in {_SQL_FOUND}], '|') AS emails FROM d",
)
def _(spark, sf):
    found = F.transform(emails.all_emails(col("t")), emails.normalize_email)
    return _mail_docs(spark, sf).select("doc_id", F.array_join(found, "|").alias("emails"))


@query(
    "filter_emails",
    f"{_MAIL_DOCS} SELECT doc_id, array_to_string([e for e in {_SQL_FOUND} if {_sql_wanted('e')}], '|') AS emails FROM d",
)
def _(spark, sf):
    found = F.filter(emails.all_emails(col("t")), lambda e: emails.is_wanted(e))
    return _mail_docs(spark, sf).select("doc_id", F.array_join(found, "|").alias("emails"))


_ORDERED = f"""{_MAIL_DOCS}, seen AS (SELECT doc_id, t,
    unnest([{_sql_normal('x')} for x in {_SQL_FOUND} if {_sql_wanted('x')}]) AS email,
    generate_subscripts([x for x in {_SQL_FOUND} if {_sql_wanted('x')}], 1) AS i FROM d),
    ordered AS (SELECT doc_id, any_value(t) AS t, email, min(i) AS i FROM seen GROUP BY doc_id, email)"""


@query(
    "distinct_emails",
    f"{_ORDERED} SELECT doc_id, string_agg(email, '|' ORDER BY i) AS emails FROM ordered GROUP BY doc_id",
)
def _(spark, sf):
    found = F.array_join(emails.candidate_emails(col("t")), "|")
    return _mail_docs(spark, sf).select("doc_id", found.alias("emails")).filter("emails <> ''")


@query(
    "contextual_email",
    f"""{_ORDERED}, spots AS (SELECT *, instr(lower(t), email) - 1 AS spot FROM ordered),
        a AS (SELECT doc_id, email, i, spot >= 0 AND {sql_any("lower(substring(t, greatest(spot - 100, 0) + 1, spot + length(email) + 100 - greatest(spot - 100, 0)))", fixed.APPLY_WORDS)}
        AS applies FROM spots)
        SELECT d.doc_id, coalesce(arg_min(a.email, i) FILTER (WHERE applies), arg_min(a.email, i), 'none') AS email
        FROM d LEFT JOIN a USING (doc_id) GROUP BY d.doc_id""",
)
def _(spark, sf):
    email = F.coalesce(emails.contextual_email(col("t")), F.lit("none"))
    return _mail_docs(spark, sf).select("doc_id", email.alias("email"))


# --- bad rows ---------------------------------------------------------------------------------------


@query(
    "bad_record_split",
    """SELECT event_id, CASE WHEN event_id % 3 > 0 THEN CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) END AS k,
       event_id % 3 > 0 AS ok FROM events""",
)
def _(spark, sf):
    props = F.when(col("event_id") % 3 == 0, F.concat(F.lit("x"), "props")).otherwise(col("props"))
    value = F.try_variant_get(F.try_parse_json(props), "$.k", "bigint")
    events = table(spark, sf, "events").select("event_id", value.alias("k"))
    good, bad = reports.split_bad(events, ["k"])
    return good.withColumn("ok", F.lit(True)).unionByName(bad.withColumn("ok", F.lit(False)))


# --- categories -------------------------------------------------------------------------------------

_SQL_SRC = """src AS (SELECT doc_id AS id, regexp_extract(text, '^[^\\n]*', 0) AS title, text AS description,
    source || ' bank' AS company FROM documents)"""


def _docs(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id",
        F.regexp_extract("text", r"^[^\n]*", 0).alias("title"),
        col("text").alias("description"),
        F.concat("source", F.lit(" bank")).alias("company"),
    )


_TEXTS = ("title", "description", "company")


@query(
    "keyword_hits",
    f"WITH {_SQL_SRC}, {HITS} SELECT id AS doc_id, category, ord, tier, keyword, points FROM hits",
)
def _(spark, sf):
    hits = C.keyword_hits(*map(col, _TEXTS))
    return _docs(spark, sf).select("doc_id", F.inline(hits))


@query("category_scores", f"WITH {_SQL_SRC}, {SCORES} SELECT id AS doc_id, category, ord, score FROM scores")
def _(spark, sf):
    scores = C.category_scores(*map(col, _TEXTS))
    return _docs(spark, sf).select("doc_id", F.inline(scores))


@query("classify_weighted", f"WITH {_SQL_SRC}, {CATEGORIES} SELECT id AS doc_id, category FROM categories")
def _(spark, sf):
    return C.classify(_docs(spark, sf)).select("doc_id", "category")


@query("classify_first_match", f"WITH {_SQL_SRC}, {FIRST_CATEGORIES} SELECT id AS doc_id, category FROM categories")
def _(spark, sf):
    return C.classify(_docs(spark, sf), "first").select("doc_id", "category")


_RULES = """rules AS (SELECT 'R' || n_regionkey AS category, CAST(n_regionkey AS INT) AS ord, 'primary' AS tier,
    lower(n_name) AS keyword FROM nation UNION ALL SELECT DISTINCT 'S', 9, 'secondary', lower(c_mktsegment) FROM customer)"""


@query(
    "classify_by_table",
    f"""WITH {_RULES}, src AS (SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN lower(n_name) ELSE '' END AS t,
        CASE WHEN c_custkey % 4 > 0 THEN lower(c_mktsegment) ELSE '' END AS d FROM customer JOIN nation ON c_nationkey = n_nationkey),
        points AS (SELECT c_custkey, category, ord, sum(CASE WHEN tier = 'primary' THEN 10 ELSE 2 END) AS score FROM src, rules
        WHERE contains(CASE WHEN tier = 'primary' THEN t ELSE d END, keyword) GROUP BY ALL),
        best AS (SELECT c_custkey, arg_max(category, score * 1000 - ord) AS category, max(score) AS score FROM points GROUP BY 1)
        SELECT c_custkey, category, CAST(score AS BIGINT) AS score FROM src LEFT JOIN best USING (c_custkey)""",
)
def _(spark, sf):
    nations, customers = table(spark, sf, "nation"), table(spark, sf, "customer")
    rules = nations.selectExpr("concat('R', n_regionkey) AS category", "CAST(n_regionkey AS INT) AS ord", "'primary' AS tier", "n_name AS keyword")
    rules = rules.unionByName(customers.selectExpr("'S' AS category", "9 AS ord", "'secondary' AS tier", "c_mktsegment AS keyword").distinct())
    named = customers.join(nations, col("c_nationkey") == col("n_nationkey")).select(
        "c_custkey",
        F.when(col("c_custkey") % 3 > 0, col("n_name")).alias("title"),
        F.when(col("c_custkey") % 4 > 0, col("c_mktsegment")).alias("description"),
        F.lit(None).cast("string").alias("company"),
    )
    return C.classify_by_table(named, rules, "c_custkey", fold_keywords=True)


def _own_rules(spark, rules):
    """Rules as a table, as another system would hand them over."""
    return spark.createDataFrame([tuple(r) for r in rules], "category string, ord int, tier string, keyword string")


@query("keyword_hits_by_table", f"WITH {_SQL_SRC}, {HITS} SELECT id AS doc_id, category, tier, keyword, points FROM hits")
def _(spark, sf):
    found = C.hits_by_table(_docs(spark, sf), _own_rules(spark, C.weighted_rules()), "doc_id")
    return found.select("doc_id", "category", "tier", "keyword", "points")


@query("classify_first_by_table", f"WITH {_SQL_SRC}, {FIRST_CATEGORIES} SELECT id AS doc_id, nullif(category, 'Other') AS category FROM categories")
def _(spark, sf):
    found = C.classify_by_table(_docs(spark, sf), _own_rules(spark, C.first_match_rules()), "doc_id", mode="first")
    return found.select("doc_id", "category")


@query(
    "classify_benchmark_terms",
    f"""WITH {_SQL_SRC}, terms AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^a-z]+')) AS keyword FROM benchmark),
        rules AS (SELECT 'T' || length(keyword) AS category, length(keyword) AS ord, keyword FROM terms WHERE length(keyword) > 7), hits AS (SELECT id, category, ord, count(*) * 8 AS score FROM (SELECT id, lower(coalesce(description, '')) AS d FROM src), rules
        WHERE contains(d, keyword) GROUP BY ALL),
        best AS (SELECT id, arg_max(category, score * 1000 - ord) AS category, max(score) AS score FROM hits GROUP BY 1)
        SELECT id AS doc_id, category, score FROM src LEFT JOIN best USING (id)""",
)
def _(spark, sf):
    """Rules that Spark takes from the benchmark's texts, one for each longer word."""
    docs = _docs(spark, sf)
    terms = table(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("keyword")).where("length(keyword) > 7").distinct()
    rules = terms.selectExpr("concat('T', length(keyword)) AS category", "length(keyword) AS ord", "'primary' AS tier", "keyword")
    untitled = docs.withColumns({"title": F.lit(None).cast("string"), "company": F.lit(None).cast("string")})
    return C.classify_by_table(untitled, rules, "doc_id").select("doc_id", "category", "score")


# --- places of a table ------------------------------------------------------------------------------

_PLACE_TABLE = """places AS (SELECT CAST(o_orderkey AS INT) AS position, 'Fort' || o_orderkey % 5000 || ' ' || CASE o_orderkey % 3 WHEN 0 THEN 'North'
    WHEN 1 THEN 'Bay' ELSE 'on Sea' END AS place FROM orders)"""
_PLACE_TEXTS = """texts AS (SELECT c_custkey, 'Desk ' || c_custkey || ': from fort' || c_custkey * 7 % 5000 || ' bay, FORT' || c_custkey * 11 % 5000
    || ' ON SEA. Fort' || c_custkey || ' Northern' AS text FROM customer)"""


def _places_query(whole_word):
    def run(spark, sf):
        orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer")
        places = orders.selectExpr(
            "o_orderkey AS position", "concat('Fort', o_orderkey % 5000, ' ', CASE o_orderkey % 3 WHEN 0 THEN 'North' WHEN 1 THEN 'Bay' ELSE 'on Sea' END) AS place"
        )
        texts = customers.selectExpr(
            "c_custkey", "concat('Desk ', c_custkey, ': from fort', c_custkey * 7 % 5000, ' bay, FORT', c_custkey * 11 % 5000, ' ON SEA. Fort', c_custkey, ' Northern') AS text"
        )
        return place_by_table(texts, places, "c_custkey", whole_word=whole_word)

    return run


for _name, _whole in (("place_by_table", True), ("place_by_table_anywhere", False)):
    _shown = "' ' || regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') || ' '" if _whole else "lower(text)"
    _sought = "' ' || lower(place) || ' '" if _whole else "lower(place)"
    query(
        _name,
        f"""WITH {_PLACE_TABLE}, {_PLACE_TEXTS}, shown AS (SELECT c_custkey, {_shown} AS t FROM texts),
            sought AS (SELECT position, place, {_sought} AS p FROM places)
            SELECT c_custkey, arg_min(place, position) AS place FROM shown LEFT JOIN sought ON contains(t, p) GROUP BY c_custkey""",
    )(_places_query(_whole))
