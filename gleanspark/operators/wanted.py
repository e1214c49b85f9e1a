"""Which detail pages are wanted: a Bloom filter over the URLs of the listings that are kept.

The filter's words are set and joined by Spark, its size follows from the number of URLs, and it is tested on the URL alone, so a
page that no listing looks up is neither sent to a Python worker nor parsed. It may let a page through that is not wanted, never the
other way round; the exact join comes afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import without_fragment

#: Bits for each URL, and of the whole filter at most (64 MB): beyond that more pages come through, none is lost.
BITS, MOST = 12, 1 << 29
#: A URL sets bits of a single word, so it is one row where the filter is built; the hash's low half names the word, these parts of the rest the bits.
SHIFTS = (40, 46, 52, 58)
_WORDS = 1024  # words that travel in one row


def _hash(url: Column, use: int | Column) -> Column:
    return F.xxhash64(without_fragment(url), F.lit(use) if isinstance(use, int) else use)


def filter_of(keys: DataFrame) -> tuple[int, bytes]:
    """Size in bits and bits of the filter over rows ``(url, use)``: a URL and the number of what it is looked up for."""
    hashes = keys.where("url IS NOT NULL AND use IS NOT NULL").select(_hash(F.col("url"), F.col("use").cast("int")).alias("h"))
    size = 1 << 16
    while size < min(BITS * hashes.count(), MOST):
        size *= 2
    bits = " | ".join(f"shiftleft(1L, CAST(shiftrightunsigned(h, {n}) & 63 AS INT))" for n in SHIFTS)
    words = hashes.groupBy(F.col("h").bitwiseAND(F.lit(size // 64 - 1).cast("bigint")).alias("word")).agg(F.bit_or(F.expr(bits)).alias("bits"))
    lots = words.groupBy(F.floor(F.col("word") / _WORDS).alias("lot")).agg(F.collect_list(F.struct("word", "bits")).alias("words"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words of a lot, given as lists of places and of bits, as bytes."""
        for batch in batches:
            found = []
            for places, bits in zip(batch.column(1), batch.column(2), strict=True):
                words = np.zeros(_WORDS, np.int64)
                words[np.asarray(places.values) % _WORDS] = np.asarray(bits.values)
                found.append(words.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["lot", "packed"])

    table = np.zeros(size // 64, np.int64)
    for row in lots.selectExpr("lot", "words.word", "words.bits").mapInArrow(packed, "lot long, packed binary").toLocalIterator():
        table[row.lot * _WORDS : (row.lot + 1) * _WORDS] = np.frombuffer(row.packed, np.int64)
    return size, table.tobytes()


def uses_of(keys: DataFrame, url: Column, uses: int) -> Column:
    """What a URL is wanted for, as a number with a bit for each of the ``uses``; zero for a page that nobody looks up."""
    size, bits = filter_of(keys)
    sent, shifts = keys.sparkSession.sparkContext.broadcast(bits), SHIFTS

    @F.arrow_udf("int")
    def test(*hashes: pa.Array) -> pa.Array:
        words = np.frombuffer(sent.value, np.uint64)
        found = np.zeros(len(hashes[0]), np.int32)
        for use, column in enumerate(hashes):
            h = np.asarray(column.fill_null(0)).view(np.uint64)
            asked = np.zeros(len(h), np.uint64)
            for n in shifts:
                asked |= np.uint64(1) << (h >> np.uint64(n) & np.uint64(63))
            there = words[(h & np.uint64(size // 64 - 1)).astype(np.int64)] & asked == asked
            found |= np.where(there, np.int32(1 << use), np.int32(0))
        return pa.array(found)

    # else the filter on this number would test every URL a second time
    once = test.asNondeterministic()
    return F.when(url.isNotNull(), once(*[_hash(url, n) for n in range(uses)])).otherwise(F.lit(0))
