"""Shapes of plans, skew, sinks and streams."""

import os

import pytest
from pyspark.sql import functions as F

from gleanspark import fixed
from gleanspark.catalog import rendered, sites
from gleanspark.operators import enrich, reports, wanted
from gleanspark.operators import extract as X
from gleanspark.operators import nodes as N
from gleanspark.operators.classify import classify
from gleanspark.operators.nodes import shred
from gleanspark.plans import listings as L
from gleanspark.plans.profiles import CURRENT, Registry, builtin_profiles
from gleanspark.sources import pages as P
from gleanspark.sources import sinks
from gleanspark.streaming import pages as S

SF = "/root/testdata/sf0.001"
AS_OF = "1998-01-01"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_listings_need_no_shuffle(spark):
    """Extraction, filtering, classification and cleaning stay in the task that read the page."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").withColumn("site", F.lit("candidates"))
    pages = pages.withColumn("page_num", F.lit(1))
    text = plan(L.extract(pages, [Registry()["candidates"]], AS_OF))
    assert "Exchange" not in text and text.count("MapInArrow") == 1
    assert "ReadSchema: struct<page_id:bigint,html:string>" in text


def test_one_read_and_one_join_for_all_sites(spark):
    registry = Registry()
    schema = "page_id long, site string, page_num int, url string, html string"
    pages = spark.createDataFrame([(1, "cards", 1, "u", "<p>")], schema)
    text = plan(L.run(pages, pages.select("page_id", "url", "html"), AS_OF, registry))
    # listings are stored before the join, so what is left reads each detail page once, after the filter on its URL
    assert text.count("MapInArrow") == 1 and text.count("ArrowEvalPython") == 1
    assert text.index("MapInArrow") < text.index("ArrowEvalPython")
    assert text.count("Join") == 1
    assert "CartesianProduct" not in text


def test_only_wanted_details_are_parsed(spark):
    """No wanted page is lost, hardly any other is read, and a page is searched only for what it is looked up for."""
    details = spark.range(30_000).selectExpr("id AS page_id", "concat('u', id, IF(id % 5 = 0, '#x', '')) AS url", "concat('<p>e', id, '@x.com</p>') AS html")
    wanted = spark.range(0, 30_000, 10).selectExpr("concat('u', id, '#y') AS url", "CAST(id % 20 DIV 10 AS INT) AS use")
    wanted = wanted.unionByName(wanted.limit(1).selectExpr("CAST(NULL AS STRING) AS url", "0 AS use"))
    contact = Registry()["cards"].contact
    facts = {int(r.detail_url[1:]): r.detail for r in enrich.detail_facts(details, {"a": contact, "b": contact}, wanted=wanted).collect()}
    assert set(range(0, 30_000, 10)) <= set(facts) and len(facts) < 3_200
    for k in range(0, 30_000, 10):
        assert (facts[k].a, facts[k].b)[k % 20 // 10] == f"e{k}@x.com"
    assert sum(f.a is not None and f.b is not None for f in facts.values()) < 200
    assert enrich.detail_facts(details, {"a": contact}, wanted=wanted.limit(0)).isEmpty()


def test_filter_of_wanted_details_takes_a_row_for_each_url(spark):
    """A URL sets bits of one word, so that a row for each is all that is shuffled, and every URL is found again."""
    one = spark.sql("SELECT 'u' AS url, 1 AS use UNION ALL SELECT 'u#x', 1 UNION ALL SELECT NULL, 1 UNION ALL SELECT 'v', NULL")
    size, bits = wanted.filter_of(one)
    assert len(bits) * 8 == size == 1 << 16
    assert [1 <= n.bit_count() <= 4 for n in memoryview(bits).cast("Q") if n] == [True]
    many = spark.range(20_000).selectExpr("concat('u', id) AS url", "CAST(id % 3 AS INT) AS use")
    size, bits = wanted.filter_of(many)
    assert size == 1 << 18 and sum(n != 0 for n in memoryview(bits).cast("Q")) > 3_900
    found = spark.range(40_000).selectExpr("id", "concat('u', id) AS url")
    found = found.select("id", wanted.uses_of(many, found["url"], 3).alias("uses")).collect()
    assert all(r.uses >> r.id % 3 & 1 for r in found if r.id < 20_000)
    assert sum(r.uses == 0 for r in found if r.id >= 20_000) > 19_000


def test_top_n_reads_only_their_pages(spark):
    rows = spark.range(100).selectExpr("id AS page_id", "1 AS pos", "concat('u', id) AS detail_url", "CAST(id AS INT) AS rank")
    details = spark.range(100).selectExpr("id AS page_id", "concat('u', id) AS url", "concat('<p>e', id, '@x.com</p>') AS html")
    found = enrich.enrich(rows, details, Registry()["cards"].contact, top_n=5, default="none")
    assert {r.page_id: r.apply_email for r in found.collect()} == {k: f"e{k}@x.com" if k <= 5 else "none" for k in range(100)}


def test_classify_is_map_only(spark):
    texts = spark.range(3).selectExpr("id", "'Nurse' title", "'' description", "'' company")
    text = plan(classify(texts))
    assert "Exchange" not in text and "Join" not in text


def test_top_k(spark):
    assert "TakeOrderedAndProject" in plan(reports.count_by(spark.range(9), "id", top=5))


def test_hot_detail_url_is_split(spark):
    """A third of all listings share one URL, another third have none; the hot partition is split."""
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB",
    }
    before = {k: spark.conf.get(k) for k in changed}
    for key, value in changed.items():
        spark.conf.set(key, value)
    try:
        rows = spark.range(0, 60_000, 1, 8).selectExpr(
            "id AS page_id",
            "1 AS pos",
            "CASE id % 3 WHEN 0 THEN 'u0' WHEN 1 THEN concat('u', id) END AS detail_url",
            "concat('text of ', id) AS title",
        )
        # each page twice, one of them with a fragment; the first counts
        details = spark.range(0, 6_000, 1, 8).selectExpr(
            "id AS page_id",
            "concat('u', id % 3000, CASE WHEN id >= 3000 THEN '#x' ELSE '' END) AS url",
            "concat('<p>e', id, '@x.com</p>') AS html",
        )
        facts = enrich.detail_facts(details, {"apply_email": Registry()["cards"].contact})
        joined = enrich.lookup(rows, facts)
        run = joined.select("page_id", "detail.apply_email")
        found = run.collect()
        assert "skew=true" in plan(run) and "SortAggregate" not in plan(run)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    expected = {i: "e0@x.com" if i % 3 == 0 else f"e{i}@x.com" if i % 3 == 1 and i < 3000 else None for i in range(60_000)}
    assert {r.page_id: r.apply_email for r in found} == expected


def test_one_detail_page_per_url(spark):
    details = [(2, "u", "<p>b@x.com</p>"), (1, "u", "<p>a@x.com</p>"), (3, None, "<p>c@x.com</p>")]
    table = spark.createDataFrame(details, "page_id long, url string, html string")
    (row,) = enrich.detail_facts(table, {"e": Registry()["cards"].contact}).collect()
    assert (row.detail_url, row.detail.e) == ("u", "a@x.com")


def test_unknown_sites_and_first_pages(spark):
    pages = rendered.listing_pages(spark, SF, "cards", "headings")
    registry = Registry()
    everything = L.run(pages.withColumn("site", F.lit("unknown")), None, AS_OF, registry)
    assert everything.isEmpty()
    only_first = L.run(pages, None, AS_OF, registry, first_page_only=True)
    assert {r.page_num for r in only_first.select("page_num").distinct().collect()} == {1}
    assert set(CURRENT) == {p.name for p in registry.current()}


def test_snapshot_and_empty_guard(spark, tmp_path):
    out = str(tmp_path)
    found = sites.listed(spark, SF, "cards").drop("expiry_date")
    scratch = str(tmp_path / "scratch")
    assert sinks.write_snapshot(found, out, "19980101_000000", scratch)
    latest = sinks.read_csv(spark, f"{out}/csv/latest").count()
    assert latest == sinks.read_json(spark, f"{out}/json/run_ts=19980101_000000").count() == found.count()
    assert not sinks.write_snapshot(found.filter("false"), out, "19980102_000000", scratch)
    assert sinks.read_csv(spark, f"{out}/csv/latest").count() == latest
    assert not os.path.exists(f"{out}/csv/run_ts=19980102_000000")
    assert not os.listdir(scratch) and not [x for x in os.listdir(f"{out}/csv") if x.startswith("_new")]
    assert sinks.write_snapshot(found.limit(1), out, "19980103_000000", scratch)
    assert sinks.read_json(spark, f"{out}/json/latest").count() == 1


@pytest.mark.parametrize("step", ["write_csv", "write_json", "_write_text", "_put_over", None])
def test_a_stopped_run_leaves_a_whole_snapshot(spark, tmp_path, monkeypatch, step):
    """Wherever a second run stops, both copies are those of the first; when it ends, those of the second. A repeated run is one more."""
    out, scratch = str(tmp_path), str(tmp_path / "scratch")
    names = ["title", "company", "location", "category", "expiry_text", "description", "source_site", "apply_email"]
    made = lambda n: spark.range(n).select(*[F.lit(f"{n}").alias(x) for x in names], F.lit("1").alias("id"))

    def read():
        return [(df.count(), df.first()[0]) for df in (sinks.read_csv(spark, f"{out}/csv/latest"), sinks.read_json(spark, f"{out}/json/latest"))]

    assert sinks.latest(spark, out) is None
    assert sinks.write_snapshot(made(3), out, "t1", scratch)
    assert [n for n, _ in read()] == [3, 3]
    if step is not None:
        monkeypatch.setattr(sinks, step, lambda *a: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError, match="stopped"):
            sinks.write_snapshot(made(2), out, "t1", scratch)
        assert [n for n, _ in read()] == [3, 3] and sinks.latest(spark, out) == "run_ts=t1"
        monkeypatch.undo()
    assert sinks.write_snapshot(made(2), out, "t1", scratch)
    assert [n for n, _ in read()] == [2, 2] and sinks.read_csv(spark, f"{out}/csv/run_ts=t1").count() == 3


def test_csv_keeps_awkward_text(spark, tmp_path):
    values = [' a "b"\nc, ', "\\", "", None, "tab\t"]
    columns = ["title", "company", "location", "category", "expiry_text", "description", "source_site", "apply_email"]
    rows = [(v,) + ("x",) * 7 for v in values]
    sinks.write_csv(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns)), str(tmp_path))
    got = sinks.read_csv(spark, str(tmp_path)).select(F.coalesce("Job Title", F.lit(""))).collect()
    assert sorted(r[0] for r in got) == sorted("N/A" if v is None else v for v in values)


def test_raw_dumps(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>one\n\ntwo</p>")
    (row,) = P.scan_dumps(spark, str(tmp_path)).collect()
    assert row.url.endswith("/a.html") and row.html == "<p>one\n\ntwo</p>"


def test_site_counts_show_zero(spark):
    listed = spark.createDataFrame([("A",), ("A",)], "source_site string")
    counts = enrich.site_counts(listed, ["A", "B"]).collect()
    assert {r.source_site: r.n for r in counts} == {"A": 2, "B": 0}


def test_streams(spark, tmp_path):
    pages = rendered.listing_pages(spark, SF, "cards")
    pages.write.parquet(str(tmp_path / "pages"))
    profile = [Registry()["cards"]]
    details = rendered.detail_pages(spark, SF, "cards")
    expected = L.extract(pages, profile, AS_OF, details).select("id", "page_id", "apply_email")
    stream = S.page_stream(spark, str(tmp_path / "pages"))
    assert S.listing_stream(stream, profile, AS_OF).isStreaming
    query = S.append_listings(
        stream, details, profile, AS_OF, str(tmp_path / "out"), str(tmp_path / "state")
    )
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("id", "page_id", "apply_email")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_stream_parses_each_detail_page_once(spark, tmp_path):
    """Three batches that look up the same pages: each is read by the first of them alone, and all get what was read."""
    pages = rendered.listing_pages(spark, SF, "cards").cache()
    profile, details = [Registry()["cards"]], rendered.detail_pages(spark, SF, "cards")
    for n in range(3):  # the first half of the pages twice, then all
        part = pages if n == 2 else pages.where("page_id % 2 = 0")
        part.write.parquet(str(tmp_path / "pages" / f"n{n}"))
        stream = spark.readStream.schema(S.PAGE_SCHEMA).parquet(str(tmp_path / "pages" / "*"))
        S.append_listings(stream, details, profile, AS_OF, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    facts = spark.read.parquet(str(tmp_path / "state-facts"))
    per_batch = {r.batch: r["count"] for r in facts.groupBy("batch").count().collect()}
    assert facts.count() == facts.select("detail_url").distinct().count() and set(per_batch) == {0, 2} and facts.count() > 50
    got = spark.read.parquet(str(tmp_path / "out")).where("batch = 2").select("id", "apply_email")
    expected = L.extract(pages, profile, AS_OF, details).select("id", "apply_email")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_shred_keeps_other_columns(spark):
    table = spark.createDataFrame([(1, ["a"], "<p>")], "k int, `odd name` array<string>, html string")
    row = shred(table).first()
    assert (row.k, row["odd name"], len(row.nodes)) == (1, ["a"], 2)


def one(spark, html, column):
    return shred(spark.createDataFrame([(html,)], "html string")).select(column.alias("v")).first().v


def test_large_pages_come_whole(spark):
    nodes = F.col("nodes")
    site = Registry()["candidates"]
    blocks = "".join(f"<article><a href='/job/{i}'>Job number {i}</a></article>" for i in range(300))
    rows = one(spark, blocks, site.rows(nodes))
    assert len(rows) == 300 and all(r.detail_url for r in rows)
    links = "".join(f"<a href='/careers/job/{i}'>Job number {i}</a>" for i in range(600))
    assert len(one(spark, links, Registry()["link_detail"].rows(nodes))) == 600
    alike = "".join(f"<article>{'same ' * 60}{x}</article>" for x in "ab")
    assert len(one(spark, alike, X.unique_candidates(nodes))) == 2
    limited = Registry(builtin_profiles(fixed.LIMITS))
    rows = one(spark, blocks, limited["candidates"].rows(nodes))
    assert len(rows) == 50 and sum(r.detail_url is not None for r in rows) == 5
    assert len(one(spark, links, limited["link_detail"].rows(nodes))) == 200


def test_posting_is_classified_as_a_whole_and_cut_by_a_limit(spark):
    text = "x " * 300 + "nurse midwife"
    html = f'<script type="application/ld+json">{{"@type":"JobPosting","title":"T","title":"Post","description":"{text}"}}</script>'
    pages = spark.createDataFrame([(1, "jsonld", 1, html)], "page_id long, site string, page_num int, html string")
    for limits, size in ((None, len(text)), (fixed.LIMITS, 499)):
        (row,) = L.extract(pages, [Registry(builtin_profiles(limits))["jsonld"]], AS_OF).collect()
        assert (row.title, row.category) == ("Post", "Healthcare") and len(row.description) == size


def test_links_without_details_make_no_listing(spark):
    pages = rendered.listing_pages(spark, SF, "link_detail")
    assert L.run(pages, None, AS_OF, profiles=["link_detail"]).isEmpty()


def test_marked_section_and_list_valued_links(spark):
    assert one(spark, "a<![CDATA[b]]>c", N.page_text(F.col("nodes"))) == "abc"
    html = '<script type="application/ld+json">{"@type":"JobPosting","sameAs":["https://a.example/1"]}</script>'
    assert one(spark, html, X.second_pass_links(F.col("nodes"), "https://h.example/careers/")) == []


def test_routing_by_host_and_path(spark):
    registry = Registry()
    urls = ["https://vacancymail.co.zw/jobs/?ordering=later&page=3", "https://zimbojobs.com/jobs?start=20", "https://zimbojobs.com/?page=2", "https://other.example/", None]
    pages = spark.createDataFrame([(u, "<p>") for u in urls], "url string, html string")
    every = L.routed(pages, registry, list(registry)).select("site", "page_num").collect()
    assert [(r.site, r.page_num) for r in every] == [("cards", 3), ("cards_alt_second", 3), ("jsonld", 2), (None, 1), (None, 1)]


def test_deep_and_wide_pages_take_linear_steps(spark):
    item = "<ul><li><i>{}</i></li></ul>"
    html = "".join(item.format(i) for i in range(3000))
    found = F.transform(N.select(F.col("nodes"), "i"), lambda n: N.trimmed_text(F.col("nodes"), N.ancestor(F.col("nodes"), n, "li")))
    assert one(spark, html, found) == [str(i) for i in range(3000)]


def test_quarantine_keeps_html_and_is_written(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "<p>x</p>"), (2, "v", "<a href='/jobs/1'>one job</a><a href='/jobs/2'>two</a>")], "page_id long, url string, html string")
    aside = L.quarantine(pages, Registry()["link_detail"])
    sinks.write_quarantine(aside, str(tmp_path), "t")
    (row,) = spark.read.json(str(tmp_path)).collect()
    assert (row.page_id, row.html, row.n_links) == (1, "<p>x</p>", 0)
