"""The trie of conversation beginnings: what conversations share, and what sharing it saves.

Conversations are sorted by the codes of their turns and dealt out in ranges. Every batch of a range is a shard, written as balanced
parentheses: one pair for each node, in the order of a walk. The close that belongs to an open is found with blocks of least
excess (findclose), so a subtree is a span of the walk: leaves are counted by the rank of the pairs "()", all else by
differences of cumulative sums. Nodes on a shard's first and last path, its spine, may go on in the shards beside it: their sums
travel as two paths, and neighbouring shards' paths are merged by the same encoding, in a task first and then in rounds of
a fixed number of tasks, until none is open.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.common import checkpointed

#: Parentheses in a block of the range min-max tree; bytes of a turn's code; summaries that one task merges.
BLOCK, CODE, FAN = 64, 16, 64
_NO_KEY = np.iinfo(np.int64).max  # least member of a node without members of its own
_EMPTY = hashlib.sha256(b"").digest()

#: Rows of the working table: finished nodes, member lists of open ones, and the paths of open ones.
NODE, ENDS, SPINE = 0, 1, 2
_ROWS = (
    "kind int, place int, seq int, path int, key binary, parent_key binary, code binary, size bigint, conv bigint, parent_conv bigint, "
    "depth bigint, n_ends bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved bigint, ends binary"
)
_SCHEMA = pa.schema([(name, {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}[kind]) for name, kind in (x.split() for x in _ROWS.split(", "))])


# --- balanced parentheses -------------------------------------------------------------------------


def findclose(opens: np.ndarray, excess: np.ndarray) -> np.ndarray:
    """For every open parenthesis the place of its close: the next place of less excess.

    A place in the same block is looked for first; then the tree of the blocks' least excess is climbed to the first
    block further on that goes low enough, and that block is searched.
    """
    n = len(excess)
    blocks = max(1, 1 << int(-(-n // BLOCK) - 1).bit_length())
    padded = np.full(blocks * BLOCK + 1, np.iinfo(np.int32).max // 2, np.int32)
    padded[:n] = excess
    levels = [padded[:-1].reshape(blocks, BLOCK).min(axis=1)]
    while len(levels[-1]) > 1:
        levels.append(levels[-1].reshape(-1, 2).min(axis=1))
    target = excess[opens] - 1
    found = np.full(len(opens), -1)

    def search(which: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Looks from `at` to the end of its block; returns those of `which` that found nothing."""
        end = (at // BLOCK + 1) * BLOCK
        while len(which):
            inside = at < end
            hit = inside & (padded[at] <= target[which])
            found[which[hit]] = at[hit]
            go = inside & ~hit
            lost = which[~inside]
            which, at, end = which[go], at[go] + 1, end[go]
            if len(lost):
                rest.append(lost)
        return np.concatenate(rest) if rest else np.zeros(0, np.int64)

    rest: list[np.ndarray] = []
    left = search(np.arange(len(opens)), opens + 1)
    block, level = opens[left] // BLOCK, np.zeros(len(left), np.int64)
    climbing = np.arange(len(left))
    height = 0
    while len(climbing):  # up to the first right neighbour that goes low enough
        b = block[climbing]
        right = b % 2 == 0
        low = np.full(len(b), np.iinfo(np.int32).max)
        low[right] = levels[height][b[right] + 1]
        hit = low <= target[left[climbing]]
        block[climbing] = np.where(hit, b + 1, b // 2)
        level[climbing[hit]] = height
        climbing = climbing[~hit]
        height += 1
    for height in range(len(levels) - 1, 0, -1):  # and down again to its first block that does
        down = np.flatnonzero(level == height)
        b = block[down] * 2
        block[down] = np.where(levels[height - 1][b] <= target[left[down]], b, b + 1)
        level[down] = height - 1
    rest = []
    search(left, block * BLOCK)
    return found


def _least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least value of every span from first to last (last not included, spans not empty)."""
    tables = [values]
    while 1 << len(tables) <= len(values):
        half, before = 1 << len(tables) - 1, tables[-1]
        tables.append(np.minimum(before[:-half], before[half:]))
    length = last - first
    level = np.floor(np.log2(length)).astype(np.int64)
    level -= (np.int64(1) << level) > length
    result = np.empty(len(first), values.dtype)
    for k, table in enumerate(tables):
        at = np.flatnonzero(level == k)
        result[at] = np.minimum(table[first[at]], table[last[at] - (1 << k)])
    return result


class Paths(NamedTuple):
    """Paths from the root, in order, as rows of nodes: codes, sizes, keys where known, and what hangs on a node beside the paths."""

    offsets: np.ndarray
    code: np.ndarray  # two numbers a row; zeros for the root
    size: np.ndarray
    key: list[bytes] | None
    low: np.ndarray  # least member that ends here or in what hangs here
    weights: np.ndarray  # a column each: members that end here; hanging members, children, leaves, savings

    def rows(self) -> int:
        return int(self.offsets[-1])


def _joined(parts: list[Paths]) -> Paths:
    cuts = np.cumsum([0] + [p.rows() for p in parts])
    return Paths(
        np.concatenate([[0], *[p.offsets[1:] + cut for p, cut in zip(parts, cuts, strict=False)]]),
        np.concatenate([p.code for p in parts]),
        np.concatenate([p.size for p in parts]),
        [k for p in parts for k in p.key],
        np.concatenate([p.low for p in parts]),
        np.concatenate([p.weights for p in parts]),
    )


def _shared(paths: Paths) -> np.ndarray:
    """How many nodes every path shares with the one before; none for the first."""
    length = np.diff(paths.offsets)
    least = np.minimum(length[:-1], length[1:])
    if not len(least):
        return np.zeros(len(length), np.int64)
    start = np.concatenate([[0], np.cumsum(least)])
    step = np.arange(start[-1]) - np.repeat(start[:-1], least)
    a, b = np.repeat(paths.offsets[:-2], least) + step, np.repeat(paths.offsets[1:-1], least) + step
    differ = (paths.code[a] != paths.code[b]).any(axis=1)
    shared = np.minimum.reduceat(np.where(differ, step, np.iinfo(np.int64).max), start[:-1])
    return np.concatenate([[0], np.minimum(shared, least)])


class Trie:
    """The trie of sorted paths: `node` of every row, and of every node, in the order of a walk, its parent and what its subtree holds."""

    def __init__(self, paths: Paths, whole: bool) -> None:
        length, shared = np.diff(paths.offsets), _shared(paths)
        new = length - shared
        first = np.cumsum(new) - new
        n = int(new.sum())
        self.node = np.empty(paths.rows(), np.int64)
        self.row = np.empty(n, np.int64)  # a row that has the node
        self.parent, self.depth = np.full(n, -1), np.empty(n, np.int64)
        open_ = np.zeros(int(length.max(initial=0)) + 1, np.int64)
        for at, size, common, k in zip(paths.offsets[:-1].tolist(), length.tolist(), shared.tolist(), first.tolist(), strict=True):
            fresh = size - common
            open_[common:size] = np.arange(k, k + fresh)
            self.node[at : at + size] = open_[:size]
            if fresh:
                self.row[k : k + fresh] = np.arange(at + common, at + size)
                self.depth[k : k + fresh] = np.arange(common, size)
                self.parent[k + 1 : k + fresh] = np.arange(k, k + fresh - 1)
                self.parent[k] = open_[common - 1] if common else -1
        # the parentheses: before a path the closes of what it doesn't share, then its opens; all closes at the end
        closes = np.concatenate([[0], length[:-1] - shared[1:], [length[-1]]])
        counts = np.stack([closes, np.append(new, 0)], axis=1).ravel()
        bits = np.repeat(np.tile([0, 1], len(new) + 1), counts).astype(np.int8)
        excess = np.cumsum(2 * bits - 1, dtype=np.int32)
        self.opens = np.flatnonzero(bits)
        close = findclose(self.opens, excess)
        self.end = np.arange(n) + (close - self.opens + 1) // 2

        # nodes on the first and the last path are not finished, unless this is the whole trie
        spine = np.zeros(n, bool)
        self.last = np.unique(self.node[paths.offsets[-2] : paths.offsets[-1]])
        if not whole:
            spine[self.node[: length[0]]] = True
            spine[self.last] = True
        self.spine = spine
        self.size = paths.size[self.row]
        self.own = np.zeros((n, paths.weights.shape[1]), np.int64)
        np.add.at(self.own, self.node, paths.weights)
        self.low_own = np.full(n, _NO_KEY)
        np.minimum.at(self.low_own, self.node, paths.low)

        ends, convs, children, leaves, saved = self.own.T
        self.children = children + np.bincount(self.parent[1:], minlength=n)
        self.convs = self._sum(ends + convs)
        finished = ~spine
        # a pair "()" is a leaf; what hangs on a node beside these paths makes it none
        pair = np.zeros(len(bits), np.int64)
        pair[:-1] = (bits[:-1] == 1) & (bits[1:] == 0)
        mark = np.where(finished & (children == 0), pair[self.opens], 0)
        rank = np.zeros(len(bits), np.int64)
        rank[self.opens] = mark + leaves
        rank = np.concatenate([[0], np.cumsum(rank)])
        self.leaves = rank[close] - rank[self.opens]
        self.saved = self._sum(np.where(finished, (self.convs - 1) * self.size, 0) + saved)
        self.low = _least(self.low_own, np.arange(n), self.end)

    def _sum(self, values: np.ndarray) -> np.ndarray:
        """Sums over every node's subtree."""
        total = np.concatenate([[0], np.cumsum(values)])
        return total[self.end] - total[: len(values)]

    def summary(self, paths: Paths, keys: dict[int, bytes]) -> Paths:
        """First and last path, with what hangs on their nodes; a node of both is counted on the first."""
        hanging = np.flatnonzero(~self.spine & (self.parent >= 0) & self.spine[self.parent])
        up = self.parent[hanging]
        weights, low = self.own.copy(), self.low_own.copy()
        np.add.at(weights, up, np.stack([np.zeros_like(up), self.convs[hanging], np.ones_like(up), self.leaves[hanging], self.saved[hanging]], axis=1))
        np.minimum.at(low, up, self.low[hanging])
        head = self.node[: paths.offsets[1]]
        if len(paths.offsets) == 2 or np.array_equal(head, self.last):
            picked, offsets, again = head, np.array([0, len(head)]), np.zeros(len(head), bool)
        else:
            picked = np.concatenate([head, self.last])
            offsets = np.array([0, len(head), len(picked)])
            again = np.concatenate([np.zeros(len(head), bool), np.isin(self.last, head)])
        row = self.row[picked]
        return Paths(offsets, paths.code[row], self.size[picked], [keys[k] for k in picked.tolist()], np.where(again, _NO_KEY, low[picked]), np.where(again[:, None], 0, weights[picked]))


# --- rows of the working table --------------------------------------------------------------------


def _batch(columns: dict[str, list | np.ndarray | pa.Array], rows: int, **same: int) -> pa.RecordBatch:
    arrays = []
    for field in _SCHEMA:
        if field.name in same:
            arrays.append(pa.array(np.full(rows, same[field.name]), field.type))
        elif field.name in columns:
            arrays.append(pa.array(columns[field.name], field.type))
        else:
            arrays.append(pa.nulls(rows, field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=_SCHEMA)


def _binary(code: np.ndarray) -> list[bytes]:
    data = np.ascontiguousarray(code).tobytes()
    return [data[k : k + CODE] for k in range(0, len(data), CODE)]


def _keys(trie: Trie, paths: Paths) -> dict[int, bytes]:
    """Keys of the nodes on the spine: a digest of the way there."""
    keys: dict[int, bytes] = {}
    for k in np.flatnonzero(trie.spine).tolist():
        up = int(trie.parent[k])
        keys[k] = hashlib.sha256((keys[up] if up >= 0 else b"") + paths.code[trie.row[k]].tobytes()).digest()[:CODE]
    return keys


def _finished(trie: Trie, keys: dict[int, bytes], known: list[bytes] | None, ends: list[bytes] | None) -> pa.RecordBatch:
    """Rows of the finished nodes. A parent that isn't finished is named by its key."""
    at = np.flatnonzero(~trie.spine)
    parent = trie.parent[at]
    there = (parent >= 0) & ~trie.spine[parent]
    open_ = ((parent >= 0) & trie.spine[parent]).tolist()
    columns = {
        "key": [known[k] for k in at.tolist()] if known else pa.nulls(len(at), pa.binary()),
        "parent_key": [keys[int(p)] if o else None for p, o in zip(parent, open_, strict=True)],
        "conv": trie.low[at],
        "parent_conv": pa.array(trie.low[parent], mask=~there) if len(at) else [],
        "depth": trie.depth[at],
        "n_convs": trie.convs[at],
        "n_children": trie.children[at],
        "n_leaves": trie.leaves[at],
        "saved": trie.saved[at],
        "ends": ends if ends is not None else pa.nulls(len(at), pa.binary()),
    }
    return _batch(columns, len(at), kind=NODE)


def _spine_rows(paths: Paths, place: int) -> pa.RecordBatch:
    length = np.diff(paths.offsets)
    names = ("n_ends", "n_convs", "n_children", "n_leaves", "saved")
    columns = {
        "path": np.repeat(np.arange(len(length)), length),
        "depth": np.arange(paths.rows()) - np.repeat(paths.offsets[:-1], length),
        "key": paths.key,
        "code": _binary(paths.code),
        "size": paths.size,
        "conv": paths.low,
        **{name: paths.weights[:, k] for k, name in enumerate(names)},
    }
    return _batch(columns, paths.rows(), kind=SPINE, place=place)


def _merged(parts: list[Paths], whole: bool) -> tuple[pa.RecordBatch, Paths | None]:
    """Neighbouring summaries as one: the nodes that are finished by it, and the summary of the rest."""
    paths = _joined(parts)
    trie = Trie(paths, whole)
    key = [paths.key[k] for k in trie.row.tolist()]
    rows = _finished(trie, dict(enumerate(key)), key, None)
    return rows, None if whole else trie.summary(paths, dict(enumerate(key)))


def _first_paths(batch: pa.RecordBatch) -> tuple[Paths, np.ndarray]:
    """The paths of sorted conversations (conv, codes, sizes), the root in front of each, and the conversations' keys."""
    conv = np.asarray(batch.column("conv"))
    codes = batch.column("codes").cast(pa.large_list(pa.binary()))
    length = np.diff(np.asarray(codes.offsets)) + 1
    offsets = np.concatenate([[0], np.cumsum(length)])
    turns = np.ones(offsets[-1], bool)
    turns[offsets[:-1]] = False
    code, size = np.zeros((offsets[-1], 2), np.uint64), np.zeros(offsets[-1], np.int64)
    code[turns] = np.frombuffer(b"".join(codes.flatten().to_pylist()), np.uint64).reshape(-1, 2)
    size[turns] = np.asarray(batch.column("sizes").flatten())
    low, weights = np.full(offsets[-1], _NO_KEY), np.zeros((offsets[-1], 5), np.int64)
    low[offsets[1:] - 1] = conv
    weights[offsets[1:] - 1, 0] = 1
    return Paths(offsets, code, size, None, low, weights), conv


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every batch as a shard: its finished nodes, its open nodes' members, and in the end one summary of all batches of the task."""
    place, seen = TaskContext.get().partitionId(), None
    for seq, batch in enumerate(b for b in batches if b.num_rows):
        paths, conv = _first_paths(batch)
        trie = Trie(paths, False)
        keys = _keys(trie, paths)
        at = trie.node[paths.offsets[1:] - 1]  # where conversations end; equal ones are neighbours, by falling key
        cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        members = {int(at[a]): ",".join(map(str, conv[a:b].tolist())).encode() for a, b in zip(cut, [*cut[1:], len(at)], strict=True)}
        ends = [hashlib.sha256(members.get(k, b"")).digest() for k in np.flatnonzero(~trie.spine).tolist()]
        yield _finished(trie, keys, None, ends)
        still = [k for k in keys if k in members]
        yield _batch({"key": [keys[k] for k in still], "ends": [members[k] for k in still]}, len(still), kind=ENDS, place=place, seq=seq)
        summary = trie.summary(paths, keys)
        if seen is None:
            seen = summary
        else:
            rows, seen = _merged([seen, summary], False)
            yield rows
    if seen is not None:
        yield _spine_rows(seen, place)


def _round(whole: bool):
    """Merges the summaries of one group of neighbouring places."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("place", "ascending"), ("path", "ascending"), ("depth", "ascending")])
        column = {name: table.column(name).combine_chunks() for name in table.column_names}
        depth = np.asarray(column["depth"])
        offsets = np.append(np.flatnonzero(depth == 0), len(depth))
        code = np.frombuffer(b"".join(column["code"].to_pylist()), np.uint64).reshape(-1, 2)
        weights = np.stack([np.asarray(column[n]) for n in ("n_ends", "n_convs", "n_children", "n_leaves", "saved")], axis=1)
        rows, rest = _merged([Paths(offsets, code, np.asarray(column["size"]), column["key"].to_pylist(), np.asarray(column["conv"]), weights)], whole)
        return pa.Table.from_batches([rows] if rest is None else [rows, _spine_rows(rest, key[0].as_py())])

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of every node's member list from its parts (key, ends), which come in order."""
    key, digest = None, None
    for batch in batches:
        done = []
        for k, part in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    done.append((key, digest.digest()))
                key, digest = k, hashlib.sha256(part)
            else:
                digest.update(b"," + part)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([d for _, d in done], pa.binary())], ["key", "found"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.digest()], pa.binary())], ["key", "found"])


# --- the operator -----------------------------------------------------------------------------------


def conversations(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv, turns)``: every conversation's turns as ``array<struct<turn, code, size>>`` in order.

    Turns are ordered by turn, null first; equal ones by their code, which is a digest of role and text (null: empty). Size is the
    text's code points. Rows without a conversation are left out.
    """
    said, by = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    digest = F.sha2(F.concat(F.char_length(by).cast("string"), F.lit(":"), by, said), 256)
    turns = df.where(F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias("conv"),
        F.struct(F.col(turn).alias("turn"), F.unhex(F.substring(digest, 1, 2 * CODE)).alias("code"), F.char_length(said).cast("bigint").alias("size")).alias("turn"),
    )
    return turns.groupBy("conv").agg(F.sort_array(F.collect_list("turn")).alias("turns"))


def rebuilt(found: DataFrame, every: int = 100, heads: int = 6) -> DataFrame:
    """Conversations that begin like the first of their hundred: its first h turns, then their own after the first h.

    h is the CRC-32 of the conversation's number as text, modulo `heads`. Where that first conversation is missing, nothing takes the
    place of the turns.
    """
    found = checkpointed(found)
    base = F.col("conv") - F.col("conv") % every
    first = found.where(F.col("conv") % every == 0).select(F.col("conv").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).cast("int")
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    head = F.coalesce(F.slice("head", F.lit(1), h), F.slice("turns", 1, 0))
    return found.withColumn("base", base).join(first, "base", "left").select("conv", F.concat(head, own).alias("turns"))


def prefix_trie(found: DataFrame) -> DataFrame:
    """One row for every distinct beginning of the conversations ``(conv, turns)``, the empty one included.

    Returns (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends): the least conversation that begins so, the
    number of its turns, the least one of the beginning a turn shorter (null for the root), how many conversations begin so, how many
    beginnings are a turn longer, how many in the subtree have none longer, what sharing saves in the subtree, and the SHA-256 of the
    conversations that end there (bytes). Conversations are taken as distinct numbers; equal ones and those without turns are members like
    others. No conversations give no rows. One conversation's codes (24 bytes a turn) are held by one task; how many share a beginning
    is not bounded.
    """
    turns = F.col("turns")
    paths = found.select("conv", F.transform(turns, lambda t: t["code"]).alias("codes"), F.transform(turns, lambda t: t["size"]).alias("sizes"))
    ordered = checkpointed(paths).repartitionByRange("codes", "conv").sortWithinPartitions("codes", "conv")
    rounds = [checkpointed(ordered.mapInArrow(_shards, _ROWS))]
    spine, last = rounds[0].where(F.col("kind") == SPINE), rounds[0].agg(F.max("place")).first()[0]
    while last is not None:
        last = last // FAN
        groups = spine.withColumn("group", F.floor(F.col("place") / FAN).cast("int"))
        step = checkpointed(groups.groupBy("group").applyInArrow(_round(last == 0), _ROWS))
        rounds.append(step)
        spine, last = step.where(F.col("kind") == SPINE), last or None
    return _results(rounds)


def _results(rounds: list[DataFrame]) -> DataFrame:
    """The finished nodes of all rounds; open parents and members of the spines' nodes are looked up by key."""
    first, *later = rounds
    nodes = first
    for step in later:
        nodes = nodes.unionByName(step)
    nodes = nodes.where(F.col("kind") == NODE)
    parts = first.where(F.col("kind") == ENDS).select("key", "place", "seq", "ends")
    digests = parts.repartition("key").sortWithinPartitions("key", "place", "seq").select("key", "ends").mapInArrow(_digests, "key binary, found binary")
    spines = nodes.where("key is not null").join(digests, "key", "left")
    spines = checkpointed(spines.withColumn("ends", F.coalesce("found", F.lit(_EMPTY))).drop("found"))
    names = spines.select(F.col("key").alias("parent_key"), F.col("conv").alias("found"))
    done = nodes.where("key is null").unionByName(spines.select(nodes.columns))
    open_ = done.where("parent_key is not null").join(names, "parent_key")
    closed = done.where("parent_key is null").withColumn("found", F.col("parent_conv"))
    return closed.unionByName(open_.select(closed.columns)).select(
        F.col("conv").alias("conv_id"), "depth", F.col("found").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends"
    )


def hex_digest(ends: Column) -> Column:
    return F.lower(F.hex(ends))
