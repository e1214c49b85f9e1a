"""Value tables of the column functions, and checks against Python's own libraries."""

import datetime as dt
import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from gleanspark import fixed
from gleanspark.functions import dates, emails, text, urls
from gleanspark.functions.arrays import first_by
from gleanspark.operators import classify as C
from gleanspark.operators import extract as X
from gleanspark.operators.places import place_by_table
from gleanspark.operators.reports import email_rate
from gleanspark.plans.listings import record_id


def values(spark, inputs, *columns, schema="t string"):
    rows = [v if isinstance(v, tuple) else (v,) for v in inputs]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [tuple(r) for r in df.orderBy("i").select(*columns).collect()]


AUG = dt.date(2025, 8, 24)


@pytest.mark.parametrize("mode", ["strict", "lenient"])
def test_expiry(spark, mode):
    table = [
        ("Expires 24 Aug 2025", AUG, AUG),
        ("Expires August 24, 2025", AUG, None),
        ("Posted on August 17, 2025", dt.date(2025, 9, 16), None),
        ("Expiry: 2025-08-24", AUG, None),
        ("Expiry: 2025-8-4", dt.date(2025, 8, 4), None),
        ("Closing date: 24 Aug 2025", None, None),
        ("Closing date: August 24, 2025", AUG, None),
        ("Apply by Aug 24, 2025 at noon", AUG, None),
        ("N/A", None, None),
        ("Posted 17 August 2025", None, None),
        ("Sept 5, 2025", None, None),
        ("Posted on Sept 5, 2025", None, None),
        ("Closing 5 September 2025 at noon", None, None),
        ("Expires 24 August 2025", AUG, None),
        ("expires 24 aug 25", None, AUG),
        ("expires 24 aug 69", None, dt.date(1969, 8, 24)),
        ("Expires 30 February 2025", None, None),
        ("Expires - Aug  5, 2025", dt.date(2025, 8, 5), None),
        ("", None, None),
        (None, None, None),
    ]
    got = values(spark, [t[0] for t in table], dates.parse_expiry(F.col("t"), mode))
    assert [g[0] for g in got] == [t[1 if mode == "strict" else 2] for t in table]


def test_dates_like_strptime(spark):
    rng, texts = random.Random(1), []
    forms = ["%B %d, %Y", "%b %d %Y", "%d %B %Y", "%d %b %Y", "%Y-%m-%d", "%d/%m/%Y", "%B %Y"]
    for _ in range(400):
        day = dt.date(1990, 1, 1) + dt.timedelta(days=rng.randrange(20000))
        written = day.strftime(rng.choice(forms))
        texts.append(rng.choice([written, written.lower(), written.replace(" ", "  "), written + " x"]))

    def python(value):
        for form in ("%B %d %Y", "%b %d %Y", "%d %B %Y", "%d %b %Y", "%Y-%m-%d"):
            try:
                return dt.datetime.strptime(value.replace(",", "").strip(), form).date()
            except ValueError:
                pass

    got = values(spark, texts, dates.parse_date(F.col("t")))
    assert [g[0] for g in got] == [python(t) for t in texts]


def test_clean_text(spark):
    table = [
        ("A – B…", "A - B"),
        ("“Hi” ‘x’", "\"Hi\" 'x'"),
        ("Café Bar", "CafBar"),
        ("\t a \n", "a"),
        ("\x1c  b \x0b", "b"),
        (None, None),
    ]
    got = values(spark, [t[0] for t in table], text.clean_text(F.col("t")))
    assert [g[0] for g in got] == [t[1] for t in table]


def test_py_strip_and_lines(spark):
    inputs = [" x　", "\x1fy\x0b", " z ", "a b\r\n\n c\x85d"]
    got = values(spark, inputs, text.py_strip(F.col("t")), text.lines(F.col("t")))
    assert [g[0] for g in got] == [i.strip() for i in inputs]
    assert [g[1] for g in got] == [[p.strip() for p in i.splitlines() if p.strip()] for i in inputs]


def test_lead_lines_and_title(spark):
    lead = values(spark, ["a\nb\nc\nd", "x" * 300], text.lead_lines(F.col("t")))
    assert [v[0] for v in lead] == ["a b c", "x" * 200]
    pairs = values(spark, ["A – B – C", "A - B", "A –  "], *text.split_title(F.col("t")))
    assert pairs == [("A", "B – C"), ("A - B", None), ("A", "")]


def test_resolve_url_like_urljoin(spark):
    refs = ["job/1", "/job/1", "//x.example/a", "?page=2", "#top", "../x", "https://o.example/y"]
    refs += ["mailto:a@b.c", "", "./a/../b/./c", "..", "a/..", "/a/./b/..", "job//x", "//x.example"]
    refs += ["HTTPS://O.e/Y", "https:foo", "a?x=1#f", "a/b/../../../../c", ".", "?", "a#", "/"]
    refs += [";x", "javascript:void(0)", "x:y", "a b", "é/ü", ".//a", "a//../b", "?x#", "../../"]
    bases = ["https://h.example/careers/", "https://h.example", "https://h.example/a/b?q=1#z"]
    pairs = [(b, r) for b in bases for r in refs]
    got = values(spark, pairs, urls.resolve_url(F.col("b"), F.col("r")), schema="b string, r string")
    assert [g[0] for g in got] == [urljoin(b, r) for b, r in pairs]
    assert values(spark, [None], urls.resolve_url("https://h.example/", F.col("t"))) == [(None,)]


def test_page_numbers(spark):
    got = values(spark, ["12", "1a", "", "١"], urls.number(F.col("t")))
    assert [g[0] for g in got] == [12, None, None, None]
    got = values(spark, ["Page 1,234 x", "Page\n5", "page 3", "x"], urls.page_label(F.col("t")))
    assert [g[0] for g in got] == [1234, None, None, None]
    near = ["see page 7", "7 " + "x" * 60 + " page 9 7", "101 pages", "1 page", "« 3", ""]
    got = values(spark, near, urls.page_number_near_words(F.col("t")))
    # the first 7 of the second text is too far from the word, and later ones do not count
    assert [g[0] for g in got] == [7, 9, 101, None, 3, None]
    got = values(spark, near, urls.page_number_near_words(F.col("t"), most=100))
    assert [g[0] for g in got] == [7, 9, None, None, 3, None]


def test_frontier(spark):
    base = F.lit("https://h.example/")
    made = {
        "parameter": urls.parameter_url,
        "query": urls.query_url,
        "path": urls.path_url,
        "offset": urls.offset_url,
    }
    totals = F.lit(40).cast("bigint")
    columns = [
        urls.frontier(totals, lambda n, f=f: f(base, n)).alias(name) for name, f in made.items()
    ]
    (row,) = spark.range(1).select(*columns).collect()
    assert [p.page_num for p in row.path] == list(range(2, 41))
    for cap, last, end in ((20, None, 20), (None, 29, 29), (50, 49, 40)):
        found = urls.frontier(totals, lambda n: base, cap, last)
        assert [p.page_num for p in spark.range(1).select(found.alias("x")).first().x] == list(range(2, end + 1))
    assert row.parameter[0].url == row.query[0].url == "https://h.example/?page=2"
    assert row.path[0].url == "https://h.example/page/2/"
    assert row.offset[1].url == "https://h.example/?start=20"
    one = spark.range(1).select(urls.frontier(F.lit(1).cast("bigint"), lambda n: base).alias("x"))
    assert one.first().x == []


def test_record_id(spark):
    got = spark.range(1).select(record_id("VM", F.lit(2), F.lit(13), "2025-08-07").alias("id"))
    assert got.first().id == "VM_002_013_20250807"


def test_places(spark):
    inputs = ["Gweru office, HQ Harare", "Harareville", "mutare", "London"]
    got = values(spark, inputs, X.place(F.col("t")), X.place(F.col("t"), whole_word=False))
    assert got == [("Harare", "Harare"), (None, "Harare"), ("Mutare", "Mutare"), (None, None)]


def test_labelled_field(spark):
    inputs = ["x\nCompany:\n Acme Ltd \nEmployer: B", "organisation - CD", "Company", "Employer:" + "z" * 90]
    got = values(spark, inputs, X.labelled_field(F.col("t"), fixed.COMPANY_LABELS, 80))
    assert [g[0] for g in got] == ["Acme Ltd", "CD", None, "z" * 80]


def test_emails(spark):
    far = "Press desk: a@b.com" + " x" * 200 + " Please apply: c@d.org"
    table = [
        ("Send your CV to hr@firm.example or info@firm.example", "hr@firm.example", "hr@firm.example", "hr@firm.example"),
        ("Write to jobs [at] acme [dot] com", None, "jobs@acme.com", "jobs@acme.com"),
        ("Mail hr @ acme . com", None, "hr@acme.com", None),
        ("noreply@x.com then vacancies@x.com", "noreply@x.com", "vacancies@x.com", None),
        ("admin [at] acme [dot] com", None, "admin@acme.com", "admin@acme.com"),
        (far, "a@b.com", "c@d.org", "a@b.com"),
        ("no address", None, None, None),
    ]
    got = values(
        spark,
        [t[0] for t in table],
        emails.first_email(F.col("t")),
        emails.contextual_email(F.col("t")),
        emails.link_or_text_email(F.array().cast("array<string>"), F.col("t")),
    )
    assert got == [t[1:] for t in table]
    hrefs = F.split("t", " ")
    linked = emails.link_or_text_email(hrefs, F.lit("x@y.example"))
    got = values(spark, ["/a mailto:noreply@x.com MAILTO:HR@x.com?s=1", "mailto:?x", "/b"], linked)
    assert [g[0] for g in got] == ["hr@x.com", "x@y.example", "x@y.example"]


def test_categories(spark):
    table = [
        ("Registered Nurse", "Ward duty, paid weekly.", "City Clinic", "Healthcare", "Healthcare"),
        ("Accountant", None, "N/A", "Finance & Banking", "Finance & Banking"),
        ("Software Engineer", "N/A", "N/A", "IT & Technology", "IT & Technology"),
        ("IT Officer", "N/A", "N/A", "Administration", "Administration"),
        ("HR Manager", "N/A", "N/A", "Human Resources", "Management"),
        ("Clerk", "Balances accounts daily", "City Bank", "Finance & Banking", "Administration"),
        ("Coordinator", "N/A", "N/A", "Administration", "Administration"),
        ("Coordinator", "N/A", "Smith Accounting", "Finance & Banking", "Finance & Banking"),
        ("Project Coordinator", "N/A", "N/A", "NGO & Development", "Administration"),
        ("Clinical Data Analyst", "N/A", "N/A", "Healthcare", "Healthcare"),
        ("Welder", "N/A", "N/A", "Other", "Other"),
    ]
    texts = [F.col(c) for c in ("t", "d", "c")]
    got = values(
        spark,
        [t[:3] for t in table],
        C.weighted_category(*texts),
        C.first_match_category(*texts),
        C.weighted_category(*texts, fold_keywords=True),
        schema="t string, d string, c string",
    )
    assert [g[:2] for g in got] == [t[3:] for t in table]
    assert got[3][2] == "IT & Technology"


def test_rules_as_parameter(spark):
    rules = spark.createDataFrame([("B", 1, "primary", "x"), ("A", 0, "primary", "x")], "category string, ord int, tier string, keyword string")
    category = C.weighted_category(F.lit("an x"), F.lit(""), F.lit(""), C.rules_from(rules))
    assert spark.range(1).select(category.alias("c")).first().c == "A"
    assert spark.range(1).select(C.weighted_category(F.lit("a nurse"), F.lit(""), F.lit(""), []).alias("c")).first().c == "Other"
    shared = [C.Rule("A", 0, "primary", "nurse"), C.Rule("B", 0, "primary", "zebra")]
    scores = C.category_scores(F.lit("a nurse"), F.lit(""), F.lit(""), shared)
    assert [tuple(x) for x in spark.range(1).select(scores.alias("s")).first().s] == [("A", 0, 10)]


def test_rules_by_table(spark):
    """As the rules of the plan, whatever their number, keywords shorter than three characters included."""
    rules = [C.Rule("A", 0, "primary", "xy"), C.Rule("B", 1, "secondary", "nurse"), C.Rule("C", 2, "company", "firm"), C.Rule("A", 0, "exclusion", "not")]
    rules += [C.Rule("D", 3, "primary", f"word{i}") for i in range(6000)]
    texts = [(0, "xy nurse", "not", ""), (1, "", "a nurse", "the firm"), (2, None, None, None), (3, "word5999", "", "firm"), (4, "x", "y", "z")]
    df = spark.createDataFrame(texts, "k int, title string, description string, company string")
    table = spark.createDataFrame(rules, "category string, ord int, tier string, keyword string")
    got = {r.k: (r.category, r.score) for r in C.classify_by_table(df, table, "k").collect()}
    assert got == {0: ("A", 7), 1: ("C", 5), 2: (None, None), 3: ("D", 40), 4: (None, None)}


@pytest.mark.parametrize("characters", [2_000_000, 300])
def test_rules_by_table_for_any_keys(spark, characters):
    """Null and repeated keys, keywords that contain each other or cross two texts, repeated and null rules; one automaton or several."""
    rules = [("A", 0, "primary", "nurse"), ("A", 0, "primary", "nurse"), ("B", 1, "primary", "urs"), ("B", 1, "exclusion", "x y"), (None, 2, "primary", "odd"), ("C", 3, "primary", None), ("C", 3, "primary", "")]
    rules += [("D", 4, "secondary", f"word{i}") for i in range(200)]
    table = spark.createDataFrame(rules, "category string, ord int, tier string, keyword string")
    texts = [(1, "nurse", "", ""), (1, "nurse", "", ""), (None, "a nurse", None, None), (None, "none", "", ""), (2, "urs x", "y", ""), (3, "", "odd", ""), (4, "", "", "word1 word7"), (5, "é word3", None, "")]
    df = spark.createDataFrame(texts, "k int, title string, description string, company string").withColumn("found", F.lit(1)).withColumn("row", F.lit(2))
    got = sorted(map(tuple, C.classify_by_table(df, table, "k", characters=characters).collect()), key=repr)
    # both rules of a keyword inside another count; "x y" is met across the border of two texts
    want = [(1, "A", 10), (1, "A", 10), (None, "A", 10), (None, None, None), (2, "B", 7), (3, None, 8), (4, "D", 2), (5, "D", 3)]
    assert got == sorted(want, key=repr)
    firsts = sorted(((r.k, r.category) for r in C.classify_by_table(df, table, "k", mode="first", characters=characters).collect()), key=repr)
    assert firsts == sorted([(1, "A"), (1, "A"), (None, "A"), (None, None), (2, "B"), (3, None), (4, "D"), (5, "D")], key=repr)
    hits = sorted((tuple(r) for r in C.hits_by_table(df, table, "k", characters=characters).where("k in (1, 2)").collect()), key=repr)
    once = [(1, "A", 0, "primary", "nurse", 10), (1, "B", 1, "primary", "urs", 10)]
    assert hits == sorted([*once, *once, (2, "B", 1, "exclusion", "x y", -3), (2, "B", 1, "primary", "urs", 10)], key=repr)
    none = C.classify_by_table(df, table.limit(0), "k", characters=characters).collect()
    assert len(none) == len(texts) and all(r.category is None for r in none)


def test_hundred_thousand_rules_without_a_shuffle(spark):
    rules = spark.range(100_000).selectExpr("concat('C', id % 50) AS category", "CAST(id % 50 AS INT) AS ord", "'primary' AS tier", "concat('word', id, 'x') AS keyword")
    df = spark.range(200).selectExpr("id AS k", "concat('a word', id * 499, 'x here') AS title", "CAST(NULL AS STRING) AS description", "'' AS company")
    found = C.classify_by_table(df, rules, "k")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.k: (r.category, r.score) for r in found.collect()} == {k: (f"C{k * 499 % 50}", 10) for k in range(200)}


def test_too_many_rules_for_a_plan(spark):
    table = spark.range(30).selectExpr("'A' AS category", "0 AS ord", "'primary' AS tier", "concat('word', id) AS keyword")
    assert len(C.rules_from(table)) == 30
    with pytest.raises(ValueError, match="classify_by_table"):
        C.rules_from(table, most=20)


@pytest.mark.parametrize("whole_word", [True, False])
def test_places_by_table(spark, whole_word):
    """As the places of the plan, for ten thousand places, null and repeated keys, several words, and names that begin alike."""
    listed = ["Victoria Falls", "Victoria", "São Paulo", "St. Ives", "Ives", "Falls", "New"] + [f"New Town {i}" for i in range(10_000)] + ["Victoria", "(odd)"]
    texts = ["in VICTORIA  falls", "victoria falls!", "Victorian house", "são paulo.", "são paulos", "(st. ives)", "new town 7777 x", "newtown 5", "falls", "", None, "new-town", "an (odd) one", "x" * 500 + " ives"]
    places = spark.createDataFrame([(n, p) for n, p in enumerate(listed)] + [(None, None)], "position int, place string")
    rows = [(k % 5 or None, t, "x") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "k int, t string, place string")
    got = place_by_table(df, places, "k", "t", whole_word).collect()
    want = spark.createDataFrame([(k % 5 or None, t) for k, t in enumerate(texts)], "k int, t string")
    want = want.select("k", X.place(F.coalesce("t", F.lit("")), listed[:7], whole_word).alias("place")).collect()
    want = [(r.k, "(odd)" if not whole_word and t and "(odd)" in t else r.place) for r, t in zip(want, texts, strict=True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert [r.place for r in place_by_table(df, places.limit(0), "k", "t", whole_word).collect()] == [None] * len(texts)


def test_scores_like_a_plain_loop(spark):
    rng = random.Random(2)
    words = sorted({r.keyword for r in C.weighted_rules()}) + ["zz", "of", "IT", "accountants"]

    def phrase(n):
        return rng.choice(["", " "]).join(rng.choice(words) for _ in range(rng.randrange(n)))

    inputs = [(phrase(4), phrase(12), phrase(3)) for _ in range(300)]

    def plain(title, description, company):
        t, d, c = title.lower(), description.lower(), company.lower()
        scores = {}
        for r in C.weighted_rules():
            k, points = r.keyword, 0
            if r.tier == "primary":
                points = 10 if k in t else 8 if k in d else 0
            elif r.tier == "secondary":
                points = 3 if k in t else 2 if k in d else 1 if k in c else 0
            elif r.tier == "company":
                points = 5 if k in c else 0
            elif k in f"{t} {d} {c}":
                points = -3
            if points:
                scores[r.category] = scores.get(r.category, 0) + points
        return scores

    scored = C.category_scores(F.col("t"), F.col("d"), F.col("c"))
    got = values(spark, inputs, scored, schema="t string, d string, c string")
    assert [{s.category: s.score for s in g[0]} for g in got] == [plain(*i) for i in inputs]


def test_first_by(spark):
    rng = random.Random(3)
    lists = [[rng.randrange(6) for _ in range(rng.randrange(12))] for _ in range(50)]
    got = values(spark, [(x,) for x in lists], first_by(F.col("t"), lambda v: v), schema="t array<int>")
    assert [g[0] for g in got] == [list(dict.fromkeys(x)) for x in lists]


def test_email_rate(spark):
    rows = [("a@b.c",), ("N/A",), ("Apply on site",), ("c@d.e",)]
    got = email_rate(spark.createDataFrame(rows, "apply_email string")).first()
    assert (got.email_rate, got.valid_email_rate) == (75.0, 50.0)
    assert email_rate(spark.createDataFrame([], "apply_email string")).first().email_rate == 0.0


def test_page_key(spark):
    same = ["https://A.example/jobs/?b=2&a=1", "HTTPS://a.example/jobs?a=1&b=2#x", "https://a.example/jobs/page/1/?b=2&&a=1", "https://a.example/jobs?a=1&b=2&page=1", "https://a.example/jobs?start=0&a=1&b=2"]
    other = ["https://a.example/jobs?a=1&b=3", "https://a.example/jobs/page/2/?a=1&b=2", "https://a.example/jobs?a=1&b=2&page=11", "http://a.example/jobs?a=1&b=2", "https://a.example/Jobs?a=1&b=2"]
    df = spark.createDataFrame([(u,) for u in [*same, *other, None]], "url string").select(urls.page_key(F.col("url")).alias("k"))
    keys = [r.k for r in df.collect()]
    assert len(set(keys[: len(same)])) == 1 and len(set(keys)) == len(other) + 2 and keys[-1] is None
