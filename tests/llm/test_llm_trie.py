"""The trie of conversations against a plain one, over batches and partitions of many sizes."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from plain import tables

from gleanspark.llm import queries, trie

KIND = "conv_id long, turn long, role string, text string"


def plain(rows, heads=True):
    """Every node as the query returns it, from rows (conversation, turn, role, text)."""
    said = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            code = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()
            said.setdefault(conv, []).append((turn is not None, turn or 0, code, (role or "", text or "")))
    said = {conv: [x[3] for x in sorted(turns)] for conv, turns in said.items()}
    members, ends, below = {}, {}, {}
    for conv, turns in said.items():
        h = zlib.crc32(str(conv).encode()) % 6 if heads else 0
        path = tuple(said.get(conv - conv % 100, [])[:h] + turns[h:])
        for depth in range(len(path) + 1):
            members.setdefault(path[:depth], []).append(conv)
        ends.setdefault(path, []).append(conv)
    for node in members:
        if node:
            below.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in below.get(node, [])) or 1
        saved[node] = sum(saved[x] for x in below.get(node, [])) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    digest = {node: hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest() for node in members}
    return sorted(
        (min(found), len(node), min(members[node[:-1]]) if node else -1, len(found), len(below.get(node, [])), leaves[node], saved[node], digest[node])
        for node, found in members.items()
    )


def nodes(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.select(names).collect())


def of(found):
    return nodes(trie.prefix_trie(found).withColumn("ends_sha256", trie.hex_digest(trie.F.col("ends"))))


def test_query(spark):
    (df,) = tables(spark, "/root/testdata/sf0.01", "conversations")
    assert nodes(queries.op13_prefix_trie(spark, "/root/testdata/sf0.01")) == plain([tuple(r) for r in df.collect()])


@pytest.mark.parametrize(("partitions", "rows_of_batch"), [(8, 10_000), (5, 1), (70, 3)])
def test_any_shards(spark, partitions, rows_of_batch):
    """One conversation a shard, several rounds of merging, a third of all conversations equal, null and tied turns."""
    pick = random.Random(partitions)
    rows = [(pick.choice([None, *range(0, 420)]), pick.choice([None, 0, 1, 2, 2, 3, 5]), pick.choice([None, "u", "a"]), pick.choice([None, "", "x", "yé"])) for _ in range(1200)]
    rows += [(conv, turn, "u", "the same") for conv in range(1000, 1200) for turn in range(3)]
    rows += [(5000, turn, "u", f"turn {turn % 7}") for turn in range(3000)]
    settings = {"spark.sql.shuffle.partitions": partitions, "spark.sql.adaptive.coalescePartitions.enabled": False, "spark.sql.execution.arrow.maxRecordsPerBatch": rows_of_batch}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        assert of(trie.conversations(spark.createDataFrame(rows, KIND))) == plain(rows, heads=False)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_odd_rows(spark):
    """No rows, null conversations only, conversations that lose all turns, and clashing columns."""
    none = spark.createDataFrame([], KIND + ", depth int, ends string")
    lost = [(None, 1, "u", "x")]
    assert of(trie.rebuilt(trie.conversations(none))) == [] == of(trie.rebuilt(trie.conversations(spark.createDataFrame(lost, KIND))))
    rows = [(conv, 0, "u", "hello") for conv in range(301, 330)]  # the first of their hundred is missing
    got = of(trie.rebuilt(trie.conversations(spark.createDataFrame(rows, KIND).withColumn("key", trie.F.lit(1)).withColumn("path", trie.F.lit("p")))))
    assert got == plain(rows) and got[0][1] == 0


def test_findclose():
    random_bits = np.random.default_rng(1)
    for n in (1, 2, 40, 3000):
        bits, depth = [], 0
        for left in range(2 * n, 0, -1):
            up = depth < left and (depth == 0 or random_bits.random() < 0.5)
            bits.append(1 if up else 0)
            depth += 1 if up else -1
        bits = np.array([1] * (5 * n) + bits + [0] * (5 * n))
        excess = np.cumsum(2 * bits - 1).astype(np.int32)
        opens, stack, close = np.flatnonzero(bits), [], {}
        for at, bit in enumerate(bits.tolist()):
            if bit:
                stack.append(at)
            else:
                close[stack.pop()] = at
        assert trie.findclose(opens, excess).tolist() == [close[k] for k in opens.tolist()]
