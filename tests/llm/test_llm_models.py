"""Classifiers, language and fingerprints: held-out accuracy, and rows that a model must survive."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from plain import sha, tables

from gleanspark.llm import fingerprint, langid, quality, queries, toxicity

FOLDER = "/root/testdata/sf0.01"
ODD = [(0, None, "en", 1), (1, "", "en", 1), (2, "12 34 !!", None, 1), (3, "word " * 50_000, "en", 1), (4, "a", "fr", 1), (4, "a", "fr", 1), (None, "le mot", "fr", 1)]
KIND = "doc_id long, text string, lang string, score int"


def remainder(key, folds):
    return zlib.crc32(str(key).encode()) % folds


@pytest.mark.parametrize(("module", "query", "label", "rest"), [(quality, queries.op4_quality, "quality", 0.3), (toxicity, queries.op5_toxicity, "toxic", 0.5)])
def test_held_out_labels(spark, module, query, label, rest):
    docs, labels = tables(spark, FOLDER, "documents", "labels")
    got = {r.doc_id: r for r in query(spark, FOLDER).collect()}
    assert len(got) == docs.count()
    for r in got.values():
        assert r.held_out == (remainder(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= rest)
    marked = [(got[x.doc_id], x[label]) for x in labels.collect()]
    held = [r.predicted == y for r, y in marked if r.held_out]
    assert len(held) > 40 and np.mean(held) > 0.93


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_odd_rows_and_labels(spark, module, label):
    """Null and long texts, no rows, no labels, labels that are null, of one kind, or of unknown keys."""
    docs = spark.createDataFrame(ODD, KIND)
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    some = spark.createDataFrame([(0, 1), (1, 0), (2, None), (3, 1), (99, 0), (None, 1)], f"doc_id long, {label} int")
    one = spark.createDataFrame([(0, 1), (2, 1), (3, 1)], f"doc_id long, {label} int")
    for labels in (none, some, one):
        got = module.classify(docs, labels, label=label).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
        assert module.classify(docs.limit(0), labels, label=label).collect() == []


def test_isotonic():
    count, good = np.zeros(6), np.zeros(6)
    count[[0, 2, 3, 5]], good[[0, 2, 3, 5]] = [4, 2, 2, 4], [0, 2, 0, 4]
    assert quality.isotonic(count, good).tolist() == pytest.approx([0, 0.25, 0.5, 0.5, 0.75, 1])


def test_statistics_by_hand():
    text = "One two two.\nTHREE!! ### é\n\nx"
    data = np.frombuffer(("skip me " + text).encode(), np.uint8)
    row = dict(zip(quality.NAMES, quality.statistics_of(data, np.array([0, 8, len(data)]))[1], strict=True))
    words = text.split()
    assert row["log_words"] == pytest.approx(np.log1p(len(words))) and row["upper_words"] == pytest.approx(1 / len(words))
    assert row["repeats"] == 0 and row["bare_words"] == pytest.approx(1 / len(words)) and row["sign_ends"] == pytest.approx(2 / len(words))
    assert row["distinct_lines"] == 1 and row["short_lines"] == 1


def test_pair_of_harmless_terms():
    """What no additive score can tell: either term alone is harmless, both together are not."""
    machine = toxicity.Machine(np.array([5, 9, 70]))
    kinds = [([], 0), ([5], 0), ([9], 0), ([5, 9], 1), ([70], 0), ([5, 70], 0)] * 200
    inputs = machine.inputs([np.array(x, int) for x, _ in kinds])
    machine.fit(inputs, np.array([float(y) for _, y in kinds]), np.ones(len(kinds)))
    score = machine.score([np.array(x, int) for x, _ in kinds[:6]])
    assert [int(s >= 0.5) for s in score] == [y for _, y in kinds[:6]]


def test_languages(spark):
    (docs,) = tables(spark, FOLDER, "documents")
    got = {r.doc_id: r for r in queries.op9_langid(spark, FOLDER).collect()}
    right = []
    for r in docs.select("doc_id", "lang").collect():
        found = got[r.doc_id]
        assert found.held_out == (remainder(r.doc_id, 3) == 1) and 0 <= found.score <= 1
        if found.held_out and r.lang:
            right.append(found.lang_pred == r.lang)
    assert len(got) == docs.count() and np.mean(right) > 0.95


def test_language_of_odd_rows(spark):
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(spark.createDataFrame(ODD, KIND)).collect()}
    assert {(0, "und"), (1, "und"), (2, "und")} <= got and (3, "und") not in got
    empty = spark.createDataFrame(ODD, KIND).limit(0)
    assert langid.identify(empty).collect() == []
    unknown = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in langid.identify(unknown).collect()] == [("und", 0.0)]


def test_unseen_words_back_off():
    words = pa.table({"lang": ["a", "b"], "word": ["abab", "cdcd"], "n": [9, 9]})
    grams = pa.table({"lang": ["a", "b", "a", "b"], "gram": ["ab", "cd", "a", "c"], "n": [5, 5, 5, 5]})
    model = langid.Model(["a", "b"], np.array([0.5, 0.5]), words, grams)
    assert [model.predict(t)[0] for t in ("abab", "xxab", "yycd", "cz")] == ["a", "a", "b", "b"]


def test_rare_words_and_languages_are_kept(spark, monkeypatch):
    """Whatever part of the words is sent: scores of a model that holds all of them, and a rare language is told by its own words."""
    monkeypatch.setattr(langid, "WORDS", 3)
    rows = [(n, f"common words of many texts {chr(97 + n % 26) * 3}{chr(97 + n // 26) * 2}", "a") for n in range(200)]
    rows += [(1000 + n, w, "b") for n, w in enumerate(("zyxq", "vuqz yqqx", "qzzy zyxq", "zyxq vuqz", "yqqx qzzy", "zyxqs"))]
    learnt = [r for r in rows if remainder(r[0], 3) != 1]
    counts = {}
    for _, text, lang in learnt:
        for w in langid.words_of(text):
            counts[lang, w] = counts.get((lang, w), 0) + 1
    grams = {}
    for (lang, w), n in counts.items():
        for g in (g for k in range(1, 6) for g in langid.grams_of(w, k)):
            grams[lang, g] = grams.get((lang, g), 0) + n
    shares = np.array([sum(r[2] == x for r in learnt) for x in "ab"]) / len(learnt)
    whole = langid.Model(["a", "b"], shares, *[pa.table({"lang": [x for x, _ in c], "text": [x for _, x in c], "n": list(c.values())}) for c in (counts, grams)])
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for key, text, lang in rows:
        want = whole.predict(text)
        assert (got[key].lang_pred, got[key].score) == (want[0], pytest.approx(want[1], abs=1e-6))
        assert want[0] == lang or lang == "b" and remainder(key, 3) == 1


def edited(docs):
    """Edited texts by descending key."""
    docs = sorted(docs, key=lambda d: -d[0])
    return {k: t[: len(t) - len(t) // 3] + docs[(n + 1) % len(docs)][1][: len(t) // 3] for n, (k, t) in enumerate(docs)}


@pytest.mark.parametrize("run", [4000, 50])
def test_fingerprints(spark, monkeypatch, run):
    monkeypatch.setattr(fingerprint, "RUN", run)
    (docs,) = tables(spark, FOLDER, "documents")
    docs = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in queries.op7_fingerprint(spark, FOLDER).collect()}
    for key, text in edited(docs).items():
        assert got[key].edited_sha256 == sha(text)
    texts = dict(docs)
    by_text = {}
    for key, r in got.items():
        assert r.n_chars == len(texts[key]) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by_text.setdefault(hashlib.md5(texts[key].encode()).digest(), set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    long = [r for r in got.values() if r.n_chars > 300]
    assert np.median([r.near_edited for r in long]) > 0.4 and np.quantile([r.near_edited for r in long], 0.01) > 0.1
    assert np.quantile([r.near_next for r in long], 0.9) < 0.02


def test_entropy_of_windows():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 110, 400).astype(np.uint8)
    steps = fingerprint.entropies(data)
    for k in range(len(steps)):
        total = fingerprint._PART[np.bincount(data[k : k + 64])].sum()
        assert steps[k] == (fingerprint._MOST - total) * fingerprint.STEPS // (fingerprint._MOST + 1)


def test_fingerprints_of_odd_rows(spark):
    """Null and empty texts, null and repeated keys, one row alone, and none."""
    rows = [(5, "some words of a text " * 40), (5, "some words of a text " * 40), (None, "x"), (3, None), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in fingerprint.fingerprints(df).collect()), key=str)
    assert len(got) == 5 and all(r[3] == "" for r in got if r[1] == 0)
    assert [r[2] for r in got if r[0] is None] == ["x"]
    (one,) = fingerprint.fingerprints(df.where("doc_id = 2")).collect()
    assert (one.edited_text, one.near_edited, one.near_next) == ("", 1.0, 1.0)
    assert fingerprint.fingerprints(df.limit(0)).collect() == []


def test_pair_of_harmless_words_through_classify(spark):
    """The label depends only on whether two words stand together; each alone tells nothing."""
    random = np.random.default_rng(0)
    rows = []
    for k in range(1200):
        said = [f"w{x}" for x in random.integers(0, 300, 20)]
        said += ["alpha"] * (k % 4 in (1, 3)) + ["omega"] * (k % 4 in (2, 3))
        rows.append((k, " ".join(said), int(k % 4 in (0, 3))))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(table, table).collect()}
    right = [got[k].predicted == y for k, _, y in rows if got[k].held_out]
    assert len(right) > 200 and np.mean(right) > 0.9


def test_toxicity_of_plain_sums():
    """The score of a text is that of the sum over its pairs of terms, written out."""
    machine = toxicity.Machine(np.array([3, 7, 11]), np.array([0.5, 1, 0.25], np.float32))
    machine.bias, machine.weights = -0.5, np.array([0.3, -0.2, 0.9], np.float32)
    x = np.array([0.5, 1, 0.25]) / (0.25 + 1 + 0.0625) ** 0.25
    value = -0.5 + x @ [0.3, -0.2, 0.9] + sum(x[a] * x[b] * machine.vectors[a] @ machine.vectors[b] for a in range(3) for b in range(a))
    both = machine.score([np.array([3, 7, 11]), np.array([], int), np.array([5])])
    assert both == pytest.approx([1 / (1 + np.exp(-value)), 1 / (1 + np.exp(0.5)), 1 / (1 + np.exp(0.5))], abs=1e-5)


def test_sample_of_one_key_on_most_rows(spark):
    """A key with a third of the rows and equal texts counts once in the sample."""
    rows = [(7, "same text here")] * 300 + [(k, f"other text {k}") for k in range(8, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(7, 200)], "doc_id long, toxic int")
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == len(rows) and len({r.score for r in got if r.doc_id == 7}) == 1
