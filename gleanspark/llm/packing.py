"""Best-fit packing of token sequences with large-item matching.

Token counts are small whole numbers, so the packing of any corpus is the packing of its histogram: lengths above a
third of the capacity are matched in pairs, smaller ones are put by best fit into the gaps, and both for whole runs of
equal bins at once. The plan has a row for each run (its number depends on the capacity, not on the data), and a piece
finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanspark.llm.bpe import loaded, read_file
from gleanspark.llm.common import checkpointed, slices

CAPACITY, END = 4096, 1
#: Pieces of one length that are ranked together in one task, about.
RANKED = 2_000
#: Pieces of text whose ids a worker keeps: nothing else takes memory beside them here.
KEPT = 400_000


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token pieces of every whole text (null: empty): (key, piece, start, length, ids_crc32), each of capacity tokens but the last.

    A text's tokens are those of gleanspark.llm.bpe, then the id end; so even an empty text has a piece of one token.
    """
    file, kind, most = read_file(df, path), df.schema[key].dataType.simpleString(), 4 * capacity
    mark = int(end).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = loaded(file.value, KEPT)
        for batch in batches:
            for rows, data, begin in slices(batch, "text"):
                raw, row, number, size, check = data.tobytes(), [], [], [], []
                for n, (a, b) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)):
                    ids = vocabulary.encode(raw[a:b].decode()) + mark
                    for k, at in enumerate(range(0, len(ids), most)):
                        part = ids[at : at + most]
                        row.append(n), number.append(k), size.append(len(part) // 4), check.append(zlib.crc32(part))
                number = pa.array(number, pa.int32())
                start = pa.array(np.asarray(number, np.int64) * capacity)
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(row, pa.int64())), number, start, pa.array(size, pa.int64()), pa.array(check, pa.int64())], ["key", "piece", "start", "length", "ids_crc32"])

    found = df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(run, f"key {kind}, piece int, start long, length long, ids_crc32 long")
    return found.withColumnRenamed("key", key)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Where the pieces of each length go: (length, first rank, pieces in a bin, first bin, offset), each up to the next first rank.

    counts: pieces by length, 1 to capacity. Ties need no rule: pieces of one length differ by rank alone.
    """
    left, rank, bins = dict(counts), dict.fromkeys(counts, 0), 0
    rows: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # runs of bins (first, how many) by what is free in each
    free: list[int] = []  # the keys of gaps, in order

    def put(length: int, first: int, n_bins: int, each: int, gap: int) -> None:
        rows.append((length, rank[length], each, first, capacity - gap))
        rank[length] += n_bins * each
        left[length] -= n_bins * each
        opened(gap - each * length, first, n_bins)

    def opened(gap: int, first: int, n_bins: int) -> None:
        if gap:
            if not gaps.get(gap):
                gaps[gap] = []
                bisect.insort(free, gap)
            gaps[gap].append((first, n_bins))

    def taken(gap: int, n_bins: int | None = None) -> tuple[int, int]:
        first, n = gaps[gap].pop()
        if n_bins is not None and n_bins < n:
            gaps[gap].append((first + n_bins, n - n_bins))
            n = n_bins
        if not gaps[gap]:
            free.remove(gap)
        return first, n

    large = sorted(x for x in left if 3 * x > capacity)
    for length in reversed(large):
        while left[length]:
            fit = bisect.bisect_right(large, min(length, capacity - length)) - 1
            while fit >= 0 and left[large[fit]] < (2 if large[fit] == length else 1):
                fit -= 1
            if fit < 0:
                first, bins, n = bins, bins + left[length], left[length]
                put(length, first, n, 1, capacity)
            elif (other := large[fit]) == length:
                first, n = bins, left[length] // 2
                bins += n
                put(length, first, n, 2, capacity)
            else:
                first, n = bins, min(left[length], left[other])
                bins += n
                rows.append((length, rank[length], 1, first, 0))
                rank[length] += n
                left[length] -= n
                put(other, first, n, 1, capacity - length)
    for length in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        while left[length]:
            at = bisect.bisect_left(free, length)
            gap = free[at] if at < len(free) else capacity
            each = min(gap // length, left[length])  # the last bin may get fewer
            if at < len(free):
                first, n = taken(gap, left[length] // each)
            else:
                first, n = bins, left[length] // each
                bins += n
            put(length, first, n, each, gap)
    return sorted(rows)


def pack(found: DataFrame, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """A place for every piece: the columns of pieces() with sequence_id and offset, sequences of at most capacity tokens without gaps.

    found: rows (key, piece, start, length, ids_crc32), lengths 1 to capacity; keys may be null or repeated. An empty table gives none.
    Pieces are ranked within (length, bucket of the key), so a length that a third of all pieces have is many small
    groups; the driver gets the histogram, at most capacity rows.
    """
    found = checkpointed(found)
    counts = {r.length: r["count"] for r in found.groupBy("length").count().collect()}
    rows = np.array(plan(counts, capacity), np.int64).reshape(-1, 5)
    slots = found.sparkSession.sparkContext.broadcast((rows[:, 0] << 44 | rows[:, 1], rows))
    buckets = max(1, sum(counts.values()) // RANKED)
    dealt = found.withColumn("bucket", F.pmod(F.xxhash64(key, "piece"), F.lit(buckets)))
    before = dealt.groupBy("length", "bucket").count()
    before = before.withColumn("before", F.sum("count").over(W.partitionBy("length").orderBy("bucket")) - F.col("count")).drop("count")
    inside = F.row_number().over(W.partitionBy("length", "bucket").orderBy(key, "piece", "start", "ids_crc32"))
    ranked = dealt.withColumn("inside", inside).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("inside") - 1)
    ranked = ranked.select(F.col(key).alias("key"), "piece", "start", "length", "ids_crc32", "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, table = slots.value
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            row = table[np.searchsorted(starts, length.astype(np.int64) << 44 | rank, "right") - 1]
            nth = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(row[:, 3] + nth // row[:, 2]), pa.array(row[:, 4] + nth % row[:, 2] * length)], [*batch.schema.names[:5], "sequence_id", "offset"])

    kind = found.schema[key].dataType.simpleString()
    placed = ranked.mapInArrow(place, f"key {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumnRenamed("key", key)
