"""Near copies among embeddings by a subspace pigeonhole join.

Two unit vectors of cosine c lie at squared distance 2 - 2c. After a rotation to the axes of the table's own spread, the
dimensions are split into blocks, and every block gets a share of the allowed squared distance in proportion to its spread:
a pair within the whole allowance is within its share in one block at least. Each block is joined by range, on a grid over its
widest axes; the union of the candidates is verified in double precision, each pair in the first block that has it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.common import checkpointed, components

COSINE = 0.95
#: Blocks, and axes of a block that its grid has; a cell is two ranges wide.
BLOCKS, AXES = 4, 3
#: Vectors of one cell that are compared in one task; the vectors of a fuller cell are dealt into lots, and lots meet in pairs.
LOT = 16_384
_STRIP = 256


def _good(x: list | None) -> bool:
    return x is not None and len(x) > 0 and all(v is not None and math.isfinite(v) for v in x) and any(x)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, dims, vector): the parts as bytes, of the column's own precision; dims 0 and no vector where the row links with nothing."""
    for batch in batches:
        kind = np.float32 if batch.column(1).type.value_type == pa.float32() else np.float64
        for at in range(0, batch.num_rows, 4096):
            rows = batch.slice(at, 4096)
            each = [x if _good(x) else None for x in rows.column(1).to_pylist()]
            vectors = [None if x is None else (np.asarray(x, kind) + kind(0)).tobytes() for x in each]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(x or ()) for x in each], pa.int32()), pa.array(vectors, pa.binary())], ["key", "dims", "vector"])


def _units(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors of one number of dimensions, in double precision, scaled to length one."""
    raw = b"".join(column.to_pylist())
    vectors = np.frombuffer(raw, np.float32 if len(raw) == 4 * dims * len(column) else np.float64).astype(np.float64).reshape(len(column), dims)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # no square overflows or vanishes
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def _by_dims(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            rows = batch.slice(at, step)
            dims = np.asarray(rows.column("dims"))
            for d in np.unique(dims).tolist():
                yield d, rows.filter(pa.array(dims == d))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of products of unit vectors, a row for each dimension."""
    sums: dict[int, np.ndarray] = {}
    for d, rows in _by_dims(batches, 4096):
        v = _units(rows.column("vector"), d)
        sums[d] = sums.get(d, 0) + v.T @ v
    for d, m in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array(list(m), pa.list_(pa.float64()))], ["dims", "row", "sums"])


def _blocks(moments: np.ndarray, allowed: float) -> list[tuple[np.ndarray, float]]:
    """For each block its axes, widest first, and the distance allowed in it."""
    values, axes = np.linalg.eigh(moments)
    order = np.argsort(values)[::-1]
    values, axes = np.maximum(values[order], 0) / max(values.sum(), 1e-300), axes[:, order]
    blocks = max(1, min(BLOCKS, len(values) // AXES))
    own = [np.arange(b, len(values), blocks) for b in range(blocks)]
    share = np.array([max(values[x].sum(), 1e-3) for x in own])
    # a little more than the exact share, so that rounding loses no pair
    return [(axes[:, x], math.sqrt(allowed * s) + 1e-6) for x, s in zip(own, share / share.sum(), strict=True)]


def _cells(plans: dict):
    """Each vector in its own cell of every block, and as a visitor in the next cells that its range reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, rows in _by_dims(batches, 1024):
            v = _units(rows.column("vector"), d)
            for b, (axes, reach) in enumerate(plans[d]):
                x = (v @ axes[:, :AXES]) / (2 * reach)
                home = np.floor(x).astype(np.int64)
                inside = x - home  # up to a half from an edge is within the range
                for step in product((-1, 0, 1), repeat=x.shape[1]):
                    if step < (0,) * len(step):
                        continue  # of two neighbours, one visits the other
                    near = np.ones(len(v), bool)
                    for k, s in enumerate(step):
                        near &= (s == 0) | (inside[:, k] >= 0.5 - 1e-6 if s > 0 else inside[:, k] <= 0.5 + 1e-6)
                    cell = np.zeros(len(v), np.int64)
                    for k, s in enumerate(step):
                        cell = cell * 4099 + home[:, k] + s
                    kept, n = pa.array(near), int(near.sum())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, d, np.int32)), pa.array(np.full(n, b, np.int32)), pa.array(cell[near]), pa.array(np.full(n, not any(step))), *(rows.column(c).filter(kept) for c in ("cid", "copies", "vector"))],
                        ["dims", "block", "cell", "home", "cid", "copies", "vector"],
                    )

    return run


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of n reaches over the links."""
    root = np.arange(n)
    while len(a):
        before = root.copy()
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        root = root[root]
        if (root == before).all():
            break
    return root


def _compared(plans: dict, cosine: float):
    """Of one cell (or two lots of it), each vector's links: (cid, links, root), root being one of the cell's it is connected with."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        d, b, _, i, j = (x.as_py() for x in key)
        table = table.sort_by("cid")
        cid, copies, home, lot = (table.column(c) for c in ("cid", "copies", "home", "lot"))
        copies, home, lot = np.asarray(copies), np.asarray(home), np.asarray(lot)
        v = _units(table.column("vector").combine_chunks(), d)
        spread = [v @ axes for axes, _ in plans[d]]
        # a first look in single precision, with more than its rounding added to the range
        x, reach = spread[b].astype(np.float32), plans[d][b][1] ** 2 + 1e-5
        square = np.einsum("ij,ij->i", x, x)
        own, guests = ([np.flatnonzero((home == h) & (lot == k)) for k in (i, j)] for h in (True, False))
        # vectors that live here with each other and with visitors; of two lots, across the lots only
        sides = [(own[0], np.concatenate([own[1], guests[1]]))] + ([(own[1], guests[0])] if i != j else [])
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for side, other in sides:
            for at in range(0, len(side), _STRIP):
                strip = side[at : at + _STRIP]
                far = square[strip, None] + square[None, other] - 2 * x[strip] @ x[other].T
                p, q = np.nonzero(far <= reach)
                p, q = strip[p], other[q]
                if i == j:
                    fit = (p < q) | ~home[q]
                    p, q = p[fit], q[fit]
                linked = np.einsum("ij,ij->i", v[p], v[q]) >= cosine
                p, q = p[linked], q[linked]
                for k in range(b):  # a pair that an earlier block has is counted there
                    gap = spread[k][p] - spread[k][q]
                    new = np.einsum("ij,ij->i", gap, gap) > plans[d][k][1] ** 2
                    p, q = p[new], q[new]
                found.append((p, q))
        p, q = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        links = np.zeros(len(v), np.int64)
        np.add.at(links, p, copies[q])
        np.add.at(links, q, copies[p])
        root = _roots(len(v), p, q)
        hit = np.flatnonzero(links)
        ids = cid.combine_chunks()
        return pa.table([ids.take(pa.array(hit)), pa.array(links[hit]), ids.take(pa.array(root[hit]))], ["cid", "links", "root"])

    return run


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """Near copies of every vector: (key, n_links, component_id, kept), kept where key is its component's smallest.

    Pairs of a cosine of at least this are linked, by double precision, whatever other columns say. Null, empty and zero vectors, those
    with null or non-finite parts, and rows without a key link with nothing; vectors of different dimensions never link. Equal
    vectors are one class that is compared once and counted by its copies. An empty table gives no rows.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = checkpointed(df.select(df[key].alias("key"), df[vector].alias("vector")).mapInArrow(_packed, f"key {kind}, dims int, vector binary"))
    classes = rows.where("dims > 0 and key is not null").groupBy("dims", "vector").agg(F.min("key").alias("cid"), F.count("*").alias("copies"))
    classes = checkpointed(classes)
    sums = classes.mapInArrow(_moments, "dims int, row int, sums array<double>").select("dims", "row", F.posexplode("sums").alias("at", "x"))
    moments: dict[int, np.ndarray] = {}
    for r in sums.groupBy("dims", "row", "at").agg(F.sum("x").alias("x")).toLocalIterator():  # as many as dimensions squared, whatever the rows
        moments.setdefault(r.dims, np.zeros((r.dims, r.dims)))[r.row, r["at"]] = r.x
    plans = {d: _blocks(m, 2 - 2 * cosine) for d, m in moments.items()}
    placed = classes.mapInArrow(_cells(plans), f"dims int, block int, cell long, home boolean, cid {kind}, copies long, vector binary")
    cell = ["dims", "block", "cell"]
    full = placed.groupBy(*cell).agg(F.ceil(F.count("*") / LOT).cast("int").alias("lots"), F.max("home").alias("lived"))
    dealt = placed.join(full.where("lived"), cell).withColumn("lot", F.pmod(F.xxhash64("cid"), F.col("lots")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("lots") - 1))
    dealt = dealt.withColumn("other", other).withColumn("i", F.least("lot", "other")).withColumn("j", F.greatest("lot", "other")).drop("other", "lots", "lived")
    found = dealt.groupBy(*cell, "i", "j").applyInArrow(_compared(plans, cosine), f"cid {kind}, links long, root {kind}")
    found = checkpointed(found)
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    known = classes.join(links, "cid", "left").join(roots, classes["cid"] == roots["node"], "left")
    known = known.select("dims", "vector", "copies", "cid", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "cid").alias("root"))
    lone = rows.where("dims = 0 or key is null").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    done = rows.where("dims > 0 and key is not null").join(known, ["dims", "vector"]).select("key", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("root").alias("component_id"))
    done = done.unionByName(lone).withColumn("kept", F.col("key") == F.col("component_id"))
    return done.withColumnRenamed("key", key)
