"""Document fingerprints of improbable features.

Every window of 64 bytes has an entropy; how rare that entropy is among all windows of the corpus ranks the windows, and
those that are the rarest of their neighbourhood for long enough are a text's features. They are put into a chain of Bloom
filters, and two chains are compared by how many more bits their filters share than chance would give.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gleanspark.llm.common import SLICE, mixed, prefix_hashes, slices, span_hashes

WINDOW, NEIGHBOURS, LEAST = 64, 64, 16
#: Steps of entropy that the corpus is counted by.
STEPS = 1000
FILTER_BITS, HASHES, FEATURES = 2048, 5, 160
#: Texts that one task holds in order, about.
RUN = 4000
_SCALE = 1 << 20
_COUNTS = np.arange(WINDOW + 2)
#: c log2 c in whole numbers, so that sums are exact in any order.
_PART = np.round(_COUNTS * np.log2(np.maximum(_COUNTS, 1)) * _SCALE).astype(np.int64)
_MOST = WINDOW * int(np.log2(WINDOW)) * _SCALE
#: Texts of fewer bytes are also known by all their strings of so many bytes.
SHORT = ((512, 12), (128, 4))


def entropies(data: np.ndarray) -> np.ndarray:
    """The entropy of each window, in steps from 0 to STEPS - 1; windows cross texts if data holds several."""
    n = len(data) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.int16)
    before, after = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for k in range(1, WINDOW):  # equal bytes within a window before and after each byte
        same = (data[k:] == data[:-k]).view(np.uint8)
        before[k:] += same
        after[:-k] += same
    # the first window adds its bytes one by one; then one byte comes and one goes
    early = before[:WINDOW]
    total = np.empty(n, np.int64)
    total[0] = (_PART[early.astype(np.int64) + 1] - _PART[early]).sum()
    if n > 1:
        gone, come = after[: n - 1].astype(np.int64), before[WINDOW:].astype(np.int64)
        # the byte that comes counts equal bytes of the window before it, less the one that goes where they are equal
        change = _PART[come + 1] - _PART[come] - (_PART[gone + 1] - _PART[gone])
        total[1:] = total[0] + np.cumsum(change)
    return np.clip((_MOST - total) * STEPS // (_MOST + 1), 0, STEPS - 1).astype(np.int16)


def features(steps: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Windows that are the first rarest one of LEAST neighbourhoods or more."""
    if not len(steps):
        return np.zeros(0, np.int64)
    # rank above, place below: the least number is the leftmost of the rarest
    least = rarity[steps].astype(np.int64) << 40 | np.arange(len(steps))
    width, reach = min(NEIGHBOURS, len(steps)), 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    place = least & ((1 << 40) - 1)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    times = np.diff(np.append(first, len(place)))
    found = place[first[times >= min(LEAST, len(place))]]
    return found[rarity[steps[found]] < len(rarity)]


def digest(data: np.ndarray, found: np.ndarray) -> bytes:
    """Bloom filters of the features in order, FEATURES to a filter; none for an empty text."""
    if not len(data):
        return b""
    sums = prefix_hashes(data)
    value = span_hashes(sums, found, found + WINDOW)
    for most, size in SHORT:
        if len(data) < most or not len(value):
            start = np.arange(max(1, len(data) - size + 1))
            value = np.concatenate([value, span_hashes(sums, start, np.minimum(start + size, len(data)))])
    _, seen = np.unique(value, return_index=True)
    value = value[np.sort(seen)]  # a feature counts once
    bits = np.stack([mixed(value + np.uint64(0x9E37 * (k + 1))) >> np.uint64(53) for k in range(HASHES)], axis=1).astype(np.int64)
    filters = np.zeros((-(-len(value) // FEATURES), FILTER_BITS), bool)
    filters[np.repeat(np.arange(len(value)) // FEATURES, HASHES), bits.ravel()] = True
    return np.packbits(filters, axis=1).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """From 0 (no more bits in common than by chance) to 1: the shorter chain's filters, each against its best partner."""
    if not a or not b:
        return float(a == b)
    if a == b:
        return 1.0
    x, y = (np.unpackbits(np.frombuffer(z, np.uint8).reshape(-1, FILTER_BITS // 8), axis=1).astype(np.float32) for z in sorted((a, b), key=len))
    n, m = x.sum(axis=1)[:, None], y.sum(axis=1)[None, :]
    common, chance, most = x @ y.T, n * m / FILTER_BITS, np.minimum(n, m)
    # the overlap counts from a third of the way between chance and the most there can be
    floor = chance + 0.3 * (most - chance)
    part = np.where(most > floor, (common - floor) / np.maximum(most - floor, 1e-9), 0).clip(0, 1)
    weight = np.ravel(n)
    return float(np.clip((part.max(axis=1) * weight).sum() / weight.sum(), 0, 1))


def rarities(docs: DataFrame) -> np.ndarray:
    """The rank of each step of entropy by how many windows of the corpus have it, the rarest first; steps that say nothing come last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(STEPS, np.int64)
        for batch in batches:
            for _, data, begin in slices(batch, "text"):
                inside = np.zeros(len(data) + 1, np.int8)
                long = np.flatnonzero(np.diff(begin) >= WINDOW)
                np.add.at(inside, begin[long], 1)
                np.add.at(inside, begin[long + 1] - WINDOW + 1, -1)
                steps = entropies(data)
                counts += np.bincount(steps[np.cumsum(inside)[: len(steps)] > 0], minlength=STEPS)
        yield pa.RecordBatch.from_arrays([pa.array(range(STEPS), pa.int32()), pa.array(counts)], ["step", "n"])

    counts = np.zeros(STEPS, np.int64)
    for r in docs.select("text").mapInArrow(run, "step int, n long").groupBy("step").agg(F.sum("n").alias("n")).collect():  # STEPS rows
        counts[r.step] = r.n
    rarity = np.empty(STEPS, np.int64)
    rarity[np.argsort(counts, kind="stable")] = np.arange(STEPS)
    rarity[: STEPS // 10] = STEPS  # nearly one byte again and again: no feature
    return rarity


def digests(texts: list[bytes], rarity: np.ndarray) -> list[bytes]:
    """The digest of each text."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    steps = entropies(data)
    end = np.cumsum([len(x) for x in texts])
    return [digest(data[e - len(x) : e], features(steps[e - len(x) : max(e - len(x), e - WINDOW + 1)], rarity)) for x, e in zip(texts, end.tolist(), strict=True)]


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the beginning of the following one."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _block(rows: list[tuple], following: str, rarity: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    """Rows (key, text) in order, and the text after the last of them."""
    texts = [x for _, x in rows]
    own = digests([x.encode() for x in (*texts, following)], rarity)
    changed = [edited(a, b) for a, b in zip(texts, [*texts[1:], following], strict=True)]
    others = digests([x.encode() for x in changed], rarity)
    columns = [
        pa.array([len(x) for x in texts], pa.int64()),
        pa.array(changed, pa.string()),
        *(pa.array([base64.b64encode(x).decode() for x in y], pa.string()) for y in (own[:-1], others)),
        *(pa.array([likeness(a, b) for a, b in zip(own[:-1], y, strict=True)], pa.float64()) for y in (others, own[1:])),
    ]
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], kind), *columns], ["key", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every whole text's fingerprint and its edited text's: (key, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has its last third of code points replaced by the first of the next text, by descending key (a number; null keys
    last, equal keys by a hash of the text); after the last comes the first, and a lone text follows itself. near_*: likeness, 0 to 1, of
    the fingerprint to the edited text's and to the next text's. Null is an empty text, whose fingerprint is empty; it is like
    another empty one only. Other columns are not read.

    Keys are cut into runs by their quantiles. A run's texts pass through one task in order, and the first text of a run goes to the run
    before it too: texts are shuffled once, and a task holds a block of them.
    """
    kind, arrow_kind = df.schema[key].dataType.simpleString(), to_arrow_type(df.schema[key].dataType)
    docs = df.select(df[key].alias("key"), F.coalesce(df[text], F.lit("")).alias("text"))
    rarity = rarities(docs)
    keys = docs.select("key").where("key is not null")
    runs = max(1, keys.count() // RUN)
    cuts = np.array(sorted(set(keys.approxQuantile("key", [k / runs for k in range(1, runs)], 0.2 / runs))) if runs > 1 else [])

    @F.pandas_udf("int")
    def run_of(key: pd.Series) -> pd.Series:
        # the run of the largest keys is 0; null keys have the last
        number = key.astype(float).to_numpy()
        return pd.Series(np.where(np.isnan(number), len(cuts) + 1, len(cuts) - np.searchsorted(cuts, number, "right"))).astype("int32")

    hashed = docs.withColumn("h", F.xxhash64("text")).withColumn("run", run_of("key"))
    heads = hashed.groupBy("run").agg(F.max(F.struct("key", F.bitwise_not("h").alias("h"))).alias("head")).orderBy("run").collect()  # a row for each run
    before = {x.run: heads[n - 1].run for n, x in enumerate(heads)}
    guests = docs.sparkSession.createDataFrame([(x.run, x.head.key, ~x.head.h, before[x.run]) for x in heads], f"run int, head {kind}, head_h long, host int")
    guests = hashed.join(F.broadcast(guests), "run").where(F.col("key").eqNullSafe(F.col("head")) & (F.col("h") == F.col("head_h")))
    guests = guests.select("key", "text", "h", F.col("host").alias("run"), F.lit(True).alias("guest"))
    rows = hashed.select("key", "text", "h", "run", F.lit(False).alias("guest")).unionByName(guests)
    rows = rows.repartition("run").sortWithinPartitions("run", "guest", F.desc_nulls_last("key"), "h").select("key", "text", "run", "guest")

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, run, over = 0, None, True
        for batch in batches:
            for key_, text_, run_, guest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if run_ != run:
                    held, size, run, over = [], 0, run_, False
                if over:
                    continue  # a second guest, equal to the first
                if held and (guest or size >= SLICE):
                    yield _block(held, text_, rarity, arrow_kind)
                    held, size = [], 0
                over = guest
                held.append((key_, text_))
                size += len(text_)

    schema = f"key {kind}, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.mapInArrow(chained, schema).withColumnRenamed("key", key)
