"""Suffix arrays, repeated strings, near copies among texts and vectors."""

import random

import numpy as np
import pytest
from plain import close_vectors, near_copies, sha, tables, without_repeats
from pyspark.sql import functions as F

from gleanspark.llm import embed_dedup, jaccard, queries, suffix_dedup
from gleanspark.llm.common import components

FOLDER = "/root/testdata/sf0.001"


def test_suffix_array():
    rng = random.Random(5)
    for _ in range(1500):
        n, k = rng.randint(0, 24), rng.randint(1, 4)
        s = [rng.randint(0, k) for _ in range(n)]
        s = (s[:4] * 8)[:n] if rng.random() < 0.3 else s
        assert suffix_dedup.suffix_array(s) == sorted(range(n), key=lambda i: s[i:])


def passages(rng, n, words, size):
    return [" ".join(rng.choice(words) for _ in range(size)) for _ in range(n)]


def shared_texts(rng):
    """Texts that share passages, whole or cut, some of them many times."""
    words = ["".join(rng.choices("abcdeéß", k=rng.randint(2, 7))) for _ in range(300)]
    common = passages(rng, 6, words, 20)
    texts = []
    for _ in range(150):
        parts = passages(rng, 3, words, rng.randint(1, 25))
        if rng.random() < 0.6:
            whole = rng.choice(common)
            a, b = sorted((rng.randrange(len(whole)), rng.randrange(len(whole))))
            parts.insert(1, whole if rng.random() < 0.5 else whole[a:b])
        texts.append(" ".join(parts))
    return [*texts, *texts[:5], "", None, "short", "ab" * 200, "x" * 500]


@pytest.mark.parametrize(("length", "most"), [(50, 4096), (50, 3), (75, 4096)])
def test_repeated_strings(spark, monkeypatch, length, most):
    """As by brute force, also where an anchor has more segments than are sorted together."""
    monkeypatch.setattr(suffix_dedup, "SEGMENTS", most)
    texts = shared_texts(random.Random(length))
    rows = [(n, t, f"s{n}", 1) for n, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, doc int").repartition(5)
    got = {r.doc_id: r for r in suffix_dedup.dedup(df, length=length, keep=("kept",)).drop().toDF("doc_id", "source", "n", "removed", "spans", "rest").collect()}
    want = without_repeats([(t or "").encode() for t in texts], length)
    assert sum(w[1] for w in want) > 1000
    for n, w in enumerate(want):
        assert (got[n].n, got[n].removed, got[n].spans, bytes(got[n].rest)) == w and got[n].source == f"s{n}", n


def test_repeated_strings_odd_rows(spark):
    """Null keys, repeated rows, rows that share a key, and no rows."""
    long = "".join(chr(97 + (k * k) % 23) for k in range(150))
    rows = [(None, long), (1, "q" * 30), (1, long), (2, None), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed) for r in suffix_dedup.dedup(df, length=50).collect())
    want = without_repeats([(t or "").encode() for _, t in rows], 50)
    assert got == sorted(((k or -1), w[0], w[1]) for (k, _), w in zip(rows, want, strict=True))
    assert suffix_dedup.dedup(df.limit(0)).collect() == []


def test_suffix_query(spark):
    (docs,) = tables(spark, FOLDER, "documents")
    docs = docs.select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op6_suffix_dedup(spark, FOLDER).collect()}
    for (key, _), w in zip(docs, without_repeats([(t or "").encode() for _, t in docs], 400), strict=True):
        assert got[key] == (*w[:3], sha(w[3]), w[3].decode("utf-8", "ignore"))


def near_texts(rng):
    """Groups of copies with growing changes, a common passage, and texts of few words."""
    words = [f"w{k}" for k in range(4000)]
    texts = passages(rng, 40, words, 60)
    hot = rng.choices(words, k=40)
    for n in range(120):  # one large group of near copies
        copy = list(hot)
        for _ in range(rng.randint(0, 2)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(" ".join(copy) + " " * (n % 3))
    passage = " ".join(rng.choices(words, k=30))
    texts += [passage + " " + p for p in passages(rng, 60, words, 25)]
    chain = rng.choices(words, k=80)
    for n in range(12):  # a chain: ends alike only through the middle
        texts.append(" ".join(chain))
        chain = chain[2:] + rng.choices(words, k=2)
    return [*texts, *texts[:3], "A b c", "a B c", "a b", "one", "ONE ", "", None, "  \t", "é É", "É é"]


@pytest.mark.parametrize("lot", [20_000, 7])
def test_near_copies(spark, monkeypatch, lot):
    """Components as by brute force, also where a common shingle is met in many lots."""
    monkeypatch.setattr(jaccard, "LOT", lot)
    texts = near_texts(random.Random(lot))
    rows = [(1000 - n, t, n, 0) for n, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, component_id int").repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in jaccard.cluster(df).collect()}
    want = near_copies([r[:2] for r in rows])
    assert len(set(v[1] for v in want.values())) < len(texts) - 60
    assert got == want


def test_exact_copies_and_one_near_copy(spark, monkeypatch):
    """Two groups of a common shingle that fall in different lots meet, whichever of them is in the first."""
    monkeypatch.setattr(jaccard, "LOT", 30)
    rng, rows = random.Random(3), []
    for n in range(12):
        words = rng.choices([f"w{k}" for k in range(4000)], k=80)
        rows += [(100 * n + k, " ".join(words)) for k in range(40)]
        rows.append((100 * n + 99, " ".join([*words[:40], "other", *words[41:]])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: tuple(r)[1:] for r in jaccard.cluster(df).collect()}
    assert got == near_copies(rows)


def test_many_near_copies_unlike_their_first_make_few_pairs(spark, monkeypatch):
    """Near copies of which many do not link with the first of a shingle's groups are joined in turns, not by all their pairs."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(4000)]
    hot = rng.choices(words, k=120)
    rows = []
    for n in range(160):  # two that differ in two places each from the common text do not link
        copy = list(hot)
        for at in rng.sample(range(120), rng.choice([1, 2, 2])):
            copy[at] = rng.choice(words)
        rows.append((n, " ".join(copy)))
    found, crossing = [], jaccard._crossing
    monkeypatch.setattr(jaccard, "_crossing", lambda x: found.append(crossing(x).count()) or crossing(x))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: tuple(r)[1:] for r in jaccard.cluster(df).collect()}
    assert got == near_copies(rows)
    assert found[0] < 10 * len(rows)


def test_groups_that_share_too_little_are_no_pairs(spark):
    """Sets of 140 with 28 rare shingles of their own and a common rest cannot link; with 10 of their own they are pairs still."""
    rows = []
    for gid in range(200):
        own = 10 if gid < 3 else 28
        rows += [(k, own + k, gid, 140, gid, gid) for k in range(36 - own)]
    made = jaccard._crossing(spark.createDataFrame(rows, "token long, pos long, gid long, n long, r1 long, r2 long"))
    assert set(map(tuple, made.collect())) == {(0, 1), (0, 2), (1, 2)}


def test_near_copies_meet_once_in_a_run_of_shared_shingles(spark):
    # 20 groups of one document share tokens 1 to 6 in a row, behind a token of their own; half of them share token 9 further on, too
    rows = []
    for gid in range(20):
        own = [100 + gid, *range(1, 7), *([9] if gid % 2 else [])]
        rows += [(token, pos, gid, 100, gid, gid) for pos, token in enumerate(own)]
    made = jaccard._crossing(spark.createDataFrame(rows, "token long, pos long, gid long, n long, r1 long, r2 long")).collect()
    assert sorted(map(tuple, made)) == [(a, b) for a in range(20) for b in range(a + 1, 20)]
    # another token between two shared ones makes a pair meet again, and a forerunner that is shared but has no row here hides nothing
    rows = [(1, 0, 0, 100, 0, 0), (2, 1, 0, 100, 0, 0), (1, 0, 1, 100, 1, 1), (7, 1, 1, 100, 1, 1), (2, 2, 1, 100, 1, 1), (2, 2, 2, 100, 2, 2)]
    made = jaccard._crossing(spark.createDataFrame(rows, "token long, pos long, gid long, n long, r1 long, r2 long")).collect()
    assert sorted(map(tuple, made)) == [(0, 1), (0, 1), (0, 2), (1, 2)]


def test_near_copies_odd_rows(spark):
    text = "one two three four five six"
    rows = [(5, text), (5, text), (3, text), (None, text), (7, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, jaccard.cluster(df).collect()), key=str)
    assert got == sorted([(5, 2, 3), (5, 2, 3), (3, 2, 3), (None, 2, None), (7, 0, 7), (9, 0, 9)], key=str)
    assert jaccard.cluster(df.limit(0)).collect() == []


def test_jaccard_query(spark):
    (docs,) = tables(spark, FOLDER, "documents")
    got = {r.doc_id: tuple(r)[1:] for r in queries.op8_jaccard(spark, FOLDER).collect()}
    assert got == near_copies([tuple(r) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("lot", [8192, 16])
def test_close_vectors(spark, monkeypatch, lot):
    """Groups of near vectors, equal and scaled ones, other dimensions, and rows that link with nothing."""
    monkeypatch.setattr(embed_dedup, "LOT", lot)
    rng = np.random.default_rng(lot)
    rows = [rng.normal(size=16) for _ in range(60)]
    for n in range(120):
        rows.append(rows[n % 9] + rng.normal(size=16) * rng.choice([0.02, 0.2, 0.4]))
    rows += [rows[0], rows[0] * 3, rows[1], rng.normal(size=16) * 1e200, rows[2] * 1e-200]
    vectors = [x.tolist() for x in rows] + [[1.0, 0.0, 0.0], [1.0, 0.1, 0.0], None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] * 16]
    table = [(n, v, 0, "x") for n, v in enumerate(vectors)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, n_links int, cid string").repartition(4)
    got = {r.vec_id: tuple(r)[1:] for r in embed_dedup.cluster(df).collect()}
    want = close_vectors([r[:2] for r in table])
    assert sum(v[0] for v in want.values()) > 300
    assert got == want


def test_vectors_without_key_and_none(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, embed_dedup.cluster(df).collect()), key=str)
    assert got == sorted([(None, 0, None, None), (1, 1, 1, True), (1, 1, 1, True)], key=str)
    assert embed_dedup.cluster(df.limit(0)).collect() == []


def test_embedding_query(spark):
    (vectors,) = tables(spark, "/root/testdata/sf0.001", "embeddings")
    got = {r.vec_id: tuple(r)[1:] for r in queries.op10_embeddings(spark, FOLDER).collect()}
    assert got == close_vectors([tuple(r) for r in vectors.select("vec_id", "embedding").collect()])


def test_components_of_long_paths(spark):
    n = 300
    path = spark.range(n - 1).select(F.pmod(F.col("id") * 7, F.lit(n)).alias("a"), F.pmod(F.col("id") * 7 + 7, F.lit(n)).alias("b"))
    assert {r.root for r in components(path).collect()} == {0}
    assert components(path.limit(0)).collect() == []
