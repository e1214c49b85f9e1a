"""BPE against the tokenizers library, and packing."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from plain import sha, tables
from tokenizers import Tokenizer

from gleanspark.llm import bpe, packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
FOLDER = "/root/testdata/sf0.001"
AWKWARD = [None, "", " \n\t", "<|endoftext|>a<|startoftext|> x<|endoftext|>", "ΑΣ ΣΑΣ", "a\x1cb c\x1f d", "a\x85b　c d", "it's they'll 123 4½ Ⅷ² ..!!", "x</w> <w> </w></w>", "ﷺ İstanbul Ångström é é ́e", "日本語テスト 한국어", "👍🏽👍 ok", "x" * 700 + "yz" * 300, "ab" * 5000, "don't 'S 'T we'Re"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_ids_and_texts_are_the_library_s(spark, library):
    """Nulls, empty and long texts, repeated rows, and columns named as the operator's own."""
    rows = [(n, t, 7, "x") for n, t in enumerate(AWKWARD)] + [(0, "again", 7, "x"), (0, "again", 7, "x"), (None, "no key", 7, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string")
    got = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert len(got) == len(rows)
    want = Counter()
    for key, text, *_ in rows:
        ids, decoded = expected(library, text)
        want[key, len(ids), np.array(ids, "<u4").tobytes(), decoded] += 1
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in got) == want


def test_random_words(library):
    rng = random.Random(4)
    vocabulary = bpe.Vocabulary(open(PATH, encoding="utf-8").read())
    letters = "aeinrstlhodcuéüß'’-<>/w"
    texts = [" ".join("".join(rng.choices(letters, k=rng.randint(1, 14))) for _ in range(200)) for _ in range(30)]
    for text in texts:
        assert np.frombuffer(vocabulary.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_query_over_documents(spark, library):
    (docs,) = tables(spark, FOLDER, "documents")
    got = {r.doc_id: r for r in queries.op1_bpe(spark, FOLDER).collect()}
    for doc_id, text in docs.select("doc_id", "text").collect():
        ids, decoded = expected(library, text)
        assert tuple(got[doc_id])[:4] == (doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(decoded))


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(df, PATH), PATH).collect() == []
    assert packing.pack(packing.pieces(df, PATH)).collect() == []


def sequences(rows, capacity):
    """Number of sequences; fails where one overlaps, has a gap, or is too long."""
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_plan_places_every_piece():
    rng = random.Random(3)
    for trial in range(300):
        counts = Counter(rng.randint(1, 12) for _ in range(rng.randint(0, 60)))
        bins = defaultdict(list)
        rows = packing.plan(counts, 12)
        assert rows == sorted(rows)
        for length, n in counts.items():
            own = [r for r in rows if r[0] == length] + [(length, n, 1, 0, 0)]
            assert own[0][1] == 0
            for (_, rank, each, first, offset), following in zip(own, own[1:]):
                for k in range(following[1] - rank):
                    bins[first + k // each].append((offset + k % each * length, length))
        for places in bins.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 12
            assert sum(3 * x > 12 for _, x in places) <= 2


def test_plan_is_small_and_close_to_the_least():
    rng = random.Random(1)
    for n in (1_000, 300_000):
        counts = Counter(min(4096, int(rng.lognormvariate(6.6, 1.1)) + 1) for _ in range(n))
        rows = packing.plan(counts)
        least = -(-sum(k * v for k, v in counts.items()) // 4096)
        assert 1 + max(r[3] + (0 if r[2] == 1 else 0) for r in rows) <= 1.01 * least + 2
        assert len(rows) < 40_000


def test_pieces_and_places(spark, library):
    """Null and long texts, repeated rows, null keys, and a length that nearly all have."""
    rows = [(n, "same words here", 1) for n in range(500)] + [(1, "word " * 9000, 1), (2, None, 1), (2, None, 1), (None, "", 1), (3, "a b c " * 1365 + "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = packing.pack(packing.pieces(df, PATH)).collect()
    assert sequences(got, 4096) == -(-sum(r.length for r in got) // 4096)
    parts = defaultdict(list)
    for r in got:
        if r.doc_id in (1, 3):
            parts[r.doc_id].append(r)
    for key, text in ((1, "word " * 9000), (3, "a b c " * 1365 + "a")):
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        own = sorted((r for r in parts[key] if r.length > 10 or r.piece > 0), key=lambda r: r.piece)
        for r in own:
            part = ids[r.start : r.start + r.length]
            assert len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        assert sum(r.length for r in own) == len(ids) and all(r.length == 4096 for r in own[:-1])


def test_packing_query(spark):
    (docs,) = tables(spark, FOLDER, "documents")
    got = queries.op3_packing(spark, FOLDER).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert sequences(got, 4096) <= 1.01 * sum(r.length for r in got) / 4096 + 1


def test_packing_keeps_ids_of_many_pieces():
    """A quarter of a million different pieces are encoded once, however often they come again."""
    vocabulary, made = bpe.loaded(open(PATH, encoding="utf-8").read(), packing.KEPT), []
    make = vocabulary.pieces.make
    vocabulary.pieces.make = lambda piece: made.append(1) or make(piece)
    text = " ".join(f"{k}" for k in range(250_000))
    assert vocabulary.encode(text) == vocabulary.encode(text) and len(made) == 250_000
