"""Helpers that several operators share: Arrow text buffers, rolling hashes, word tables, checkpoints, components."""

from __future__ import annotations

import gc
import tempfile
import zipfile
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are turned into numpy arrays at a time; a longer text is taken alone.
SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def shipped(spark: SparkSession) -> SparkSession:
    """The session, with this package sent to its Python workers, so that a query runs where it is not installed."""
    context = spark.sparkContext
    if not any(Path(x).name.startswith("gleanspark-") for x in context._python_includes):
        source = Path(__file__).resolve().parents[1]
        name = f"{tempfile.mkdtemp()}/gleanspark-package.zip"  # on the driver, which hands it out
        with zipfile.ZipFile(name, "w") as archive:
            for file in sorted(source.rglob("*.py")):
                archive.write(file, file.relative_to(source.parent))
        context.addPyFile(name)
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df from the folder of spark.checkpoint.dir: lineage is cut, a lost executor costs no earlier step.

    Where the setting is unset, a temporary folder is taken in local mode (tests) and an error is raised on a cluster.
    Spark removes the shuffle files of finished steps when the driver collects its garbage, which it is asked to do here: on large
    inputs they would fill the disks long before the driver's memory.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp())
    done = df.checkpoint()
    del df  # else its own shuffles would stay until the next step
    gc.collect()
    context._jvm.System.gc()
    return done


def held_out(key: str, folds: int, rest: int) -> Column:
    """Whether crc32 of the key as text leaves this remainder; a null key counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(folds)) == rest


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, nulls as empty texts, and where each text begins (one more entry: the end)."""
    texts = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    begin = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[begin[0] : begin[-1]], begin - begin[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of a batch's rows with at most limit bytes of text (one row at least), with utf8() of the column."""
    data, begin = utf8(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(begin, begin[first] + limit, "right")) - 1)
        yield batch.slice(first, last - first), data[begin[first] : begin[last]], begin[first : last + 1] - begin[first]
        first = last


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _power_table(n: int, base: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64."""
    table = _powers.get(base)
    if table is None or len(table) < n:
        size = max(n, SLICE + 4096)
        table = np.full(size, base, np.uint64)
        table[0] = 1
        table = _powers[base] = np.multiply.accumulate(table)
        if n > 4 * SLICE:
            del _powers[base]
    return table[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sums from which span_hashes() takes the hash of any span; one more entry than bytes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * _power_table(len(data), _BASE), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from begin to end, whatever their place."""
    return mixed((sums[end] - sums[begin]) * _power_table(len(sums), _INVERSE)[begin])


def summed_blocks(df: DataFrame) -> DataFrame:
    """(block, sums) of rows (block, counts): compressed 32-bit counts added up by block."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        total: np.ndarray | int = 0
        for counts in table.column("counts"):
            total = total + np.frombuffer(zlib.decompress(counts.as_py()), np.uint32).astype(np.uint64)
        packed = zlib.compress(np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes(), 1)
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([packed], pa.binary())], ["block", "sums"])

    return df.groupBy("block").applyInArrow(run, "block int, sums binary")


def table_of_blocks(df: DataFrame, buckets: int, block: int) -> np.ndarray:
    """A table of counts of a fixed size from rows (block, counts)."""
    table = np.zeros(buckets, np.uint32)
    for row in summed_blocks(df).toLocalIterator():
        table[row.block * block : (row.block + 1) * block] = np.frombuffer(zlib.decompress(row.sums), np.uint32)
    return table


def blocks_of(counts: np.ndarray, block: int) -> tuple[pa.Array, pa.Array]:
    """The parts of a table of counts that hold any, as (block, counts)."""
    parts = [(n, counts[n * block : (n + 1) * block]) for n in range(len(counts) // block)]
    parts = [(n, zlib.compress(x.astype(np.uint32).tobytes(), 1)) for n, x in parts if x.any()]
    return pa.array([n for n, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


_NO_LETTER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])


def words(data: np.ndarray, begin: np.ndarray, letters: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes without ASCII white space (letters: of ASCII letters and non-ASCII bytes): first byte, end, and row of each.

    No word crosses texts.
    """
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    solid = ~(_NO_LETTER if letters else _SPACE)[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[begin] = True
    first = solid & edge[:-1]
    first[1:] |= solid[1:] & ~solid[:-1]
    last = solid & edge[1:]
    last[:-1] |= solid[:-1] & ~solid[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(begin, start, "right") - 1


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links (a, b): one row (node, root) for each node, root being the smallest node it reaches.

    Large-star and small-star rounds: every round joins each node's links with the least of its neighbours, so a node
    of many links is a skewed join, which Spark splits, and never a list. Rounds grow with the logarithm of the longest path.
    """
    ordered = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    found = checkpointed(ordered)
    mark = None
    while True:
        both = found.unionByName(found.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        found = checkpointed(small.where("u <> v").distinct())
        seen = found.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    return found.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(found.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
