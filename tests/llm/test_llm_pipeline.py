"""The corpus pipeline, stage by stage and as a whole."""

import zlib

import numpy as np
import public_tokenizers
from plain import near_copies, tables, without_repeats
from tokenizers import Tokenizer

import corpus_pipeline
from gleanspark.llm import langid, quality

FOLDER = "/root/testdata/sf0.001"


def stages(spark, tmp_path):
    """Every stage's input and result, each written and read again."""
    (docs,) = tables(spark, FOLDER, "documents")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, FOLDER).write.parquet(path)
        found = spark.read.parquet(path)
        yield name, docs, found
        docs = found


def test_every_stage(spark, tmp_path):
    (labels,) = tables(spark, FOLDER, "labels")
    done = {name: (before, after) for name, before, after in stages(spark, tmp_path)}
    assert [name for name, _ in corpus_pipeline.STAGES] == list(done)
    for before, after in list(done.values())[:-1]:
        assert after.dtypes == before.dtypes
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}

    before, after = done["quality classifier"]
    assert ids(after) == {r.doc_id for r in quality.classify(before, labels).collect() if r.predicted == 1}
    before, after = done["language ID"]
    assert ids(after) == {r.doc_id for r in langid.identify(before).collect() if r.lang_pred != "und" and r.score >= langid.SURE}
    before, after = done["n-gram Jaccard join"]
    docs = [(r.doc_id, r.text) for r in before.collect()]
    assert ids(after) == {v[1] for v in near_copies(docs).values()} and after.count() == len(ids(after))
    before, after = done["suffix-array dedup"]
    docs = [(r.doc_id, r.text) for r in before.collect()]
    kept = {k: w[3].decode("utf-8", "ignore") for (k, _), w in zip(docs, without_repeats([t.encode() for _, t in docs], 400), strict=True)}
    got = {r.doc_id: r for r in after.collect()}
    assert {k: r.text for k, r in got.items()} == kept and all(r.n_chars == len(r.text) for r in got.values())
    before, after = done["best-fit packing"]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids_of = {r.doc_id: [*library.encode(r.text, add_special_tokens=False).ids, 1] for r in before.collect()}
    for r in after.collect():
        part = ids_of[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32


def test_odd_documents(spark):
    """Null ids, texts and languages, repeated rows and further columns, through every stage."""
    long = "".join(chr(97 + (k * k) % 23) for k in range(900))
    rows = [(1, "A text of some words that is long enough.", "en", "s", 1, 0), (1, "A text of some words that is long enough.", "en", "s", 1, 0), (None, long + " end", "en", None, None, 0), (2, None, None, None, None, 0), (3, "", "en", "s", 0, 0), (4, long, "en", "s", 5, 0)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, score int"
    for docs in (spark.createDataFrame(rows, kind), spark.createDataFrame([], kind)):
        for _, stage in corpus_pipeline.STAGES:
            found = stage(spark, docs, FOLDER)
            assert found.count() <= len(rows)
            if stage is not corpus_pipeline.pack:
                assert found.columns == docs.columns


def test_cuts_inside_characters(spark):
    """Characters that a cut splits go whole, at both ends of it, and nothing else does."""
    same, stage = "b" * 399, dict(corpus_pipeline.STAGES)["suffix-array dedup"]
    texts = ["hello Ã" + same, "other ă" + same, "日" + "c" * 398 + "é1", "月" + "c" * 398 + "è2", "clean � text"]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in stage(spark, docs, FOLDER).collect()}
    want = [w[3].decode("utf-8", "ignore") for w in without_repeats([t.encode() for t in texts], 400)]
    assert got == {k: (t, len(t)) for k, t in enumerate(want)} and got[4][0] == texts[4]


def test_repeated_ids_keep_their_texts(spark):
    docs = spark.createDataFrame([(1, "one text of six plain words", "en"), (1, "one text of six plain words", "en"), (1, "quite another story told to nobody", "en"), (2, "a third text that stands alone here", "en")], "doc_id long, text string, lang string")
    got = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"](spark, docs, FOLDER).collect()
    assert sorted(r.text for r in got) == sorted({r.text for r in docs.collect()})


def test_run(spark):
    found = corpus_pipeline.run(spark, FOLDER)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(found.columns) and found.count() > 50
