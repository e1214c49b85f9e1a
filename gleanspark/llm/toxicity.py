"""Toxicity scores by a factorization machine over hashed terms.

A term is a word or the first letters of one, hashed into a fixed table. Every term of the labelled texts is an input of the machine,
which has a weight and a short vector for each, so that two terms that are harmless alone can count together. How strong an input is
follows from counts over the texts that are learnt from: terms whose share differs between the labels are strong, frequent ones
weaker, those that hardly occur next to nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.common import checkpointed, held_out, lowered, prefix_hashes, slices, span_hashes, words

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.5
BUCKETS = 1 << 18
#: Bytes of the beginnings of words that are terms beside the whole word.
BEGINNINGS = (4, 6)
#: Likelihood gain at which a term has half its strength; strength of a term for its frequency alone, and the rows that give half of it.
GAIN, COMMON, ROWS = 10.0, 0.2, 200.0
#: Length of the vectors, rows of a step, steps, and first rate of the descent.
RANK, BATCH, STEPS, RATE, DECAY, SEED = 6, 128, 600, 0.15, 1e-5, 5
#: How often a labelled row of label 1 counts, as texts of that label are the rarer and the costlier to miss.
POSITIVE = 3.0
#: Labelled texts of each label from which counts and machine are learnt, by order of a hash of key and text.
SAMPLE = 10_000


def term_sets(data: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """Distinct hashed terms of every text, in order."""
    low = lowered(data)
    start, end, row = words(low, begin, letters=True)
    sums = prefix_hashes(low)
    found = [span_hashes(sums, start, end)]
    for n in BEGINNINGS:
        longer = end - start > n
        cut = span_hashes(sums, start, np.where(longer, start + n, end)) + np.uint64(n)
        found.append(np.where(longer, cut, found[0]))
    bucket = (np.stack(found, axis=1) >> np.uint64(46)).astype(np.int64)
    both = np.unique((row[:, None] << 18 | bucket).ravel())
    cut = np.searchsorted(both, np.arange(len(begin)) << 18)
    return [both[a:b] & (BUCKETS - 1) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _packed(terms: np.ndarray) -> bytes:
    """An ascending set of terms as compressed steps from one to the next."""
    return zlib.compress(np.diff(terms, prepend=0).astype("<u4").tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), "<u4"), dtype=np.int64)


def strengths(sets: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """How strong an input each term is, by the likelihood ratio of its counts in the two labels and by its frequency."""
    seen, rows = np.zeros((2, BUCKETS)), np.bincount(label, minlength=2).astype(float)[:, None]
    for terms, y in zip(sets, label, strict=True):
        seen[y, terms] += 1
    share = seen.sum(axis=0) / max(len(sets), 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(seen > 0, seen * np.log(seen / (rows * share)), 0) + np.where(rows - seen > 0, (rows - seen) * np.log((rows - seen) / (rows * (1 - share))), 0)
    gain, n = np.maximum(np.nan_to_num(ratio.sum(axis=0)), 0), seen.sum(axis=0)
    return (gain**2 / (gain**2 + GAIN**2) + COMMON * n / (n + ROWS)).astype(np.float32)


class Machine:
    """y = bias + sum of weights + sum over pairs of the product of their vectors, as a logistic score.

    Each input counts by the strength of its term; the strengths of a text are divided by the fourth root of the sum of their squares.
    """

    def __init__(self, terms: np.ndarray, strength: np.ndarray | None = None) -> None:
        self.place = np.full(BUCKETS, -1, np.int32)
        self.place[terms] = np.arange(len(terms))
        self.strength = np.ones(len(terms), np.float32) if strength is None else strength
        self.bias, self.weights = 0.0, np.zeros(len(terms), np.float32)
        self.vectors = np.random.default_rng(SEED).normal(0, 0.05, (len(terms), RANK)).astype(np.float32)

    def inputs(self, sets: list[np.ndarray]) -> list[np.ndarray]:
        return [x[x >= 0] for x in (self.place[s] for s in sets)]

    def _values(self, inputs: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """Inputs in a row and of which text each is, their strengths, vectors, the sum of a text's vectors, and its value."""
        n = len(inputs)
        flat, row = np.concatenate(inputs), np.repeat(np.arange(n), [len(x) for x in inputs])
        x = self.strength[flat]
        x = (x / np.maximum(np.bincount(row, x * x, n), 1e-6)[row] ** 0.25).astype(np.float32)
        each = self.vectors[flat] * x[:, None]
        total = np.stack([np.bincount(row, each[:, k], n) for k in range(RANK)], axis=1).astype(np.float32)
        value = self.bias + np.bincount(row, self.weights[flat] * x, n) + 0.5 * ((total**2).sum(axis=1) - np.bincount(row, (each**2).sum(axis=1), n))
        return flat, row, x, each, total, value

    def score(self, sets: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._values(self.inputs(sets))[-1], -30, 30)))

    def fit(self, inputs: list[np.ndarray], label: np.ndarray, weight: np.ndarray) -> None:
        """Steps over mini-batches of the sampled rows; each touches the terms of its rows only, at a rate that falls with their past slopes."""
        random = np.random.default_rng(SEED)
        seen = np.zeros(len(self.weights), bool)
        seen[np.concatenate(inputs)] = True
        self.vectors[~seen] = 0  # what no step will reach must not count
        past, past_vectors, past_bias = np.full_like(self.weights, 1e-8), np.full_like(self.vectors, 1e-8), 1e-8
        share = np.clip((weight * label).sum() / max(weight.sum(), 1e-9), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(share / (1 - share)))
        here, place, order = np.zeros(len(self.weights), bool), np.zeros(len(self.weights), np.int64), np.zeros(0, np.int64)
        for _ in range(STEPS):
            if not len(order):
                order = random.permutation(len(inputs))
            pick, order = order[:BATCH], order[BATCH:]
            flat, row, x, each, total, value = self._values([inputs[k] for k in pick])
            error = (1 / (1 + np.exp(-np.clip(value, -30, 30))) - label[pick]) * weight[pick] / weight.mean() / len(pick)
            slope = float(error.sum())
            past_bias += slope * slope
            self.bias -= RATE * slope / past_bias**0.5
            here[flat] = True
            used = np.flatnonzero(here)
            here[used], place[used] = False, np.arange(len(used))
            at, part = place[flat], (error[row] * x).astype(np.float32)
            slopes = np.bincount(at, part, len(used)) + DECAY * self.weights[used]
            past[used] += slopes**2
            self.weights[used] -= RATE * slopes / np.sqrt(past[used])
            part = part[:, None] * (total[row] - each)
            slopes = np.stack([np.bincount(at, part[:, k], len(used)) for k in range(RANK)], axis=1) + DECAY * self.vectors[used]
            past_vectors[used] += slopes**2
            self.vectors[used] -= RATE * slopes / np.sqrt(past_vectors[used])


def chosen(docs: DataFrame, known: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """At most SAMPLE texts (key, digest, label) of each label, and how many there are; a key's equal texts are one.

    Digests instead of texts meet the labels, so what is shuffled and stored is a few bytes a row.
    """
    met = docs.select("key", "digest").distinct().join(known, "key").withColumn("place", F.xxhash64("key", "digest"))
    met = checkpointed(met)
    of = {r.label: r["count"] for r in met.groupBy("label").count().collect()}
    parts = [met.limit(0)]
    for y, n in sorted(of.items()):
        last = min(int(-(2**63) + 2**64 * min(1, 2 * SAMPLE / n)), 2**63 - 1)  # twice the sample is expected up to here, whatever n is
        parts.append(met.where((F.col("label") == y) & (F.col("place") <= last)).orderBy("place", "key", "digest").limit(SAMPLE))
    picked = parts[0]
    for part in parts[1:]:
        picked = picked.unionByName(part)
    return picked.drop("place"), of


def fit(docs: DataFrame, known: DataFrame) -> Machine:
    """A machine from rows (key, digest, text) and distinct labels (key, label), learnt from at most SAMPLE texts of each label.

    The driver gets the sample's sets of terms, each of at most 2^18.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, begin in slices(batch, "text"):
                terms = pa.array([_packed(x) for x in term_sets(data, begin)], pa.binary())
                yield pa.RecordBatch.from_arrays([*rows.columns[:3], terms], ["key", "digest", "label", "terms"])

    picked, of = chosen(docs, known)
    found = docs.join(F.broadcast(picked), ["key", "digest"]).select("key", "digest", "label", "text")
    kind = docs.schema["key"].dataType.simpleString()
    found = found.mapInArrow(run, f"key {kind}, digest long, label int, terms binary").dropDuplicates(["key", "digest", "label"])
    rows = sorted(found.select(F.xxhash64("key", "digest").alias("place"), "label", "terms").collect())  # at most 2 SAMPLE rows
    sets, label = [_unpacked(r.terms) for r in rows], np.array([r.label for r in rows], np.int64)
    seen = np.zeros(BUCKETS, bool)
    for x in sets:
        seen[x] = True
    terms = np.flatnonzero(seen)
    machine = Machine(terms, strengths(sets, label)[terms])
    if sets:
        each = np.bincount(label, minlength=2)
        weight = np.array([1.0, POSITIVE]) * [of.get(y, 0) / max(each[y], 1) for y in (0, 1)]
        machine.fit(machine.inputs(sets), label.astype(float), weight[label])
    return machine


def classify(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """Toxicity of every whole text: (key, held_out, score, predicted); score is the chance of label 1, counted POSITIVE times, predicted 1 from a half.

    Learns from the labelled rows (labels: key, label 0 or 1) that are not held out: crc32 of the key as text modulo 5 is not 0.
    Null labels are left out, a key with both labels counts for both; a null text is scored as an empty one; repeated rows are
    scored each; other columns are not read. Without labels every score is a half. No text is shuffled.
    """
    kind = df.schema[key].dataType.simpleString()
    docs = df.select(df[key].alias("key"), df[text].alias("text"))
    known = labels.select(labels[key].alias("key"), labels[label].cast("int").alias("label")).where("label in (0, 1) and key is not null")
    known = known.where(~held_out("key", FOLDS, HELD_OUT)).distinct()

    learnt = docs.where("key is not null").where(~held_out("key", FOLDS, HELD_OUT)).withColumn("digest", F.xxhash64(F.coalesce("text", F.lit(""))))
    machine = fit(learnt, known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, begin in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(machine.score(term_sets(data, begin)))], ["key", "score"])

    scored = docs.mapInArrow(run, f"key {kind}, score double")
    done = scored.select("key", held_out("key", FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
    return done.withColumnRenamed("key", key)
