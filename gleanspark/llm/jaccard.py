"""N-gram Jaccard join by prefixes of grouped documents.

A document's word shingles are ordered by how rare they are, so two documents that link share a shingle among the first
few of both (their prefixes). Documents with the same prefix and size are one group: groups, not documents, meet on shared
shingles, are filtered by size and position, and are then expanded and verified. Links are wanted for components only,
so the members of a shingle are first verified against one of them; pairs that still lie in different components follow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanspark.llm.common import blocks_of, checkpointed, components, lowered, mixed, prefix_hashes, slices, span_hashes, table_of_blocks, words

WORDS = 5
#: Buckets of the table of shingle counts: its size is fixed, 4 MB, whatever the corpus.
BUCKETS, BLOCK = 1 << 20, 1 << 14
#: Groups that share a shingle are met in lots of about this many.
LOT = 20_000
#: At most so many turns of verifying groups against a few of their shingle, as long as a row of open pairs meets this many on average.
TURNS, CROWD, LEADS = 6, 50, 4
_MULTIPLIERS = mixed(np.arange(101, 101 + WORDS, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(data: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct shingles."""
    text = lowered(data)
    start, end, row = words(text, begin)
    word = span_hashes(prefix_hashes(text), start, end)
    texts = len(begin) - 1
    n_words = np.bincount(row, minlength=texts)
    first = np.concatenate([[0], np.cumsum(n_words)])
    joint = np.zeros(len(word), np.uint64)
    for k in range(WORDS):  # a shingle that runs into the next text is not read below
        joint[: max(0, len(word) - k)] += word[k:] * _MULTIPLIERS[k]
    joint = mixed(joint)
    found = []
    for n in range(texts):
        size, at = int(n_words[n]), int(first[n])
        if size >= WORDS:
            part = np.sort(joint[at : at + size - WORDS + 1])
            found.append(part[np.concatenate([[True], part[1:] != part[:-1]])])
        elif size:
            whole = (word[at : at + size] * _MULTIPLIERS[:size]).sum(dtype=np.uint64)
            found.append(mixed(np.array([whole + np.uint64(size)], np.uint64)))
        else:
            found.append(np.zeros(0, np.uint64))
    return found


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(44)).astype(np.int64)


def _as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document with two sums over its shingles, and packed counts of shingles by bucket."""
    counts = np.zeros(BUCKETS, np.uint32)
    names = ["key", "n", "s1", "s2", "block", "counts"]
    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for rows, data, begin in slices(batch, "text"):
            sets = shingle_sets(data, begin)
            every = np.concatenate(sets)
            np.add.at(counts, _bucket(every), 1)
            sums = [[int(f(x).sum(dtype=np.uint64)) for x in sets] for f in (mixed, lambda x: mixed(x ^ np.uint64(0x5851F42D4C957F2D)))]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(x) for x in sets], pa.int64()), *map(_as_long, sums), pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())], names)
    if kind is not None:
        block, packed = blocks_of(counts, BLOCK)
        n = len(block)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, kind), *(pa.nulls(n, pa.int64()),) * 3, block, packed], names)


def _likely(met: DataFrame, one: str, other: str) -> DataFrame:
    """Of rows (one, other, n1, n2), one for each prefix shingle that two groups share, the pairs that share enough to link.

    Two sets that link have at most size - common shingles of their own, so the first shared ones stand in both prefixes: at least
    common - three quarters of the larger size + 1 of them.
    """
    n1, n2 = F.col("n1"), F.col("n2")
    shared = met.where(4 * F.least(n1, n2) >= 3 * F.greatest(n1, n2)).groupBy(one, other, "n1", "n2").count()
    common, most = F.floor((3 * (n1 + n2) + 6) / 7), F.greatest(n1, n2)
    return shared.where(F.col("count") >= common - F.floor((3 * most + 3) / 4) + 1).select(one, other)


def _crossing(rows: DataFrame) -> DataFrame:
    """Pairs (gid_1, gid_2) of groups that may link and do not lie in one component, of rows (token, pos, gid, n, r1, r2).

    pos is a token's place among all of a set, r1 and r2 the least and the largest component of a group. All that two sets share stands at
    or behind the first token that they share, so that one leaves room for common tokens in both; other shared tokens tell nothing new.
    A token whose forerunner among its set's rows is the same in both sets is such another one: the pair is met at the forerunner.
    """
    rows = rows.withColumn("before", F.lag("token").over(W.partitionBy("gid").orderBy("pos")))
    x, y = (rows.select("token", *[F.col(c).alias(c + k) for c in ("gid", "r1", "r2", "before")], F.col("n").alias("n" + k[1]), F.col("pos").alias("p" + k[1])) for k in ("_1", "_2"))
    apart = F.expr("r1_1 <> r2_1 OR r1_2 <> r2_2 OR r1_1 <> r1_2")  # not all of both groups in one component
    n1, n2 = F.col("n1"), F.col("n2")
    common = F.floor((3 * (n1 + n2) + 6) / 7)
    room = (F.col("p1") <= n1 - common) & (F.col("p2") <= n2 - common) & (4 * F.least(n1, n2) >= 3 * F.greatest(n1, n2))
    first = F.coalesce(F.col("before_1") != F.col("before_2"), F.lit(True))
    return x.join(y, "token").where("gid_1 < gid_2").where(apart & room & first).select("gid_1", "gid_2")


def _open(units: DataFrame, met: DataFrame) -> DataFrame:
    """Rows (token, pos, gid, n, r1, r2) of the shingles whose groups do not all lie in one component; r1 and r2 are a group's least and largest."""
    spans = units.groupBy("gid").agg(F.min("root").alias("r1"), F.max("root").alias("r2"))
    spread = met.select("token", "gid").join(spans, "gid").groupBy("token").agg(F.min("r1").alias("r1"), F.max("r2").alias("r2")).where("r1 <> r2").select("token")
    open_rows = met.join(spread, "token", "left_semi").select("token", "gid", "n", "pos").distinct().join(spans, "gid")
    return checkpointed(open_rows.select("token", "pos", "gid", "n", "r1", "r2"))


def _crowded(open_rows: DataFrame) -> bool:
    """So many groups meet at one shingle that their pairs are far more than the rows."""
    pairs, rows = open_rows.groupBy("token").count().select(F.sum(F.col("count") * F.col("count")), F.sum("count")).first()
    return rows is not None and pairs > CROWD * rows


def _star(open_rows: DataFrame, turn: int) -> DataFrame:
    """Pairs (gid_1, gid_2) that may link, of a group and one that lies in the component with most groups of a shingle of both, as it does not.

    Up to LEADS groups stand for such a component this turn, and each other group meets one of them.
    """
    most = open_rows.groupBy("token", "r1").count().groupBy("token").agg(F.max(F.struct("count", "r1")).alias("most"))
    rows = open_rows.join(most.select("token", F.col("most.r1").alias("main"), F.col("most.count").alias("size")), "token")
    at = F.xxhash64("gid", F.lit(turn))
    rows = rows.withColumn("slot", F.pmod(at, F.greatest(F.lit(1), F.least(F.lit(LEADS), F.floor(F.col("size") / 4)))))
    leads = rows.where("r1 = main").groupBy("token", "slot").agg(F.min(F.struct(at.alias("at"), "gid", "n", "pos", "r2")).alias("lead"))
    met = rows.where("r1 <> main").join(leads, ["token", "slot"])
    n1, n2 = F.col("n"), F.col("lead.n")
    common = F.floor((3 * (n1 + n2) + 6) / 7)
    room = (F.col("pos") <= n1 - common) & (F.col("lead.pos") <= n2 - common) & (4 * F.least(n1, n2) >= 3 * F.greatest(n1, n2))
    return met.where(room).select(F.col("gid").alias("gid_1"), F.col("lead.gid").alias("gid_2")).distinct()


def _prefix(shingles: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, int]:
    """The rarest shingles of a set, of which two sets that link share one, and a hash of them with the set's size."""
    size = len(shingles)
    prefix = shingles[np.argsort(table[_bucket(shingles)], kind="stable")[: size - (3 * size + 3) // 4 + 1]]
    return prefix, int(mixed(np.array([mixed(prefix).sum(dtype=np.uint64) + np.uint64(size)], np.uint64))[0])


def _groups(counts):
    """(key, gid) of every text with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, begin in slices(batch, "text"):
                sets = shingle_sets(data, begin)
                filled = pa.array([len(x) > 0 for x in sets])
                yield pa.RecordBatch.from_arrays([rows.column(0).filter(filled), _as_long([_prefix(x, counts.value)[1] for x in sets if len(x)])], ["key", "gid"])

    return run


def _met(docs: DataFrame, counts) -> DataFrame:
    """(token, lot, gid, n, pos) of every prefix shingle that several groups have; one that the table shows as common is dealt into lots.

    Lot 0 is that of shingles met in one lot. The lots of others count from 1 and are kept whole: a group alone in its lot still meets
    the other lots. pos is the shingle's place among those of the set, the rarest first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # groups that this task has sent
        for batch in batches:
            for _, data, begin in slices(batch, "text"):
                tokens, gids, sizes, places = [], [], [], []
                for x in shingle_sets(data, begin):
                    if not len(x):
                        continue
                    prefix, gid = _prefix(x, counts.value)
                    if gid in done:
                        continue
                    done.add(gid)
                    tokens.append(prefix)
                    gids.append(np.full(len(prefix), gid, np.uint64))
                    sizes.append(np.full(len(prefix), len(x)))
                    places.append(np.arange(len(prefix)))
                if len(done) > 1_000_000:
                    done.clear()
                if tokens:
                    token, gid = np.concatenate(tokens), np.concatenate(gids)
                    lots = (counts.value[_bucket(token)] // LOT + 1).astype(np.uint64)
                    lot = np.where(lots > 1, mixed(gid ^ np.uint64(0x51)) % lots + np.uint64(1), 0)
                    yield pa.RecordBatch.from_arrays([_as_long(token), pa.array(lot.astype(np.int32)), _as_long(gid), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places))], ["token", "lot", "gid", "n", "pos"])

    rows = docs.mapInArrow(run, "token long, lot int, gid long, n long, pos long")
    lot = W.partitionBy("token", "lot")
    shared = rows.withColumn("least", F.min("gid").over(lot)).withColumn("most", F.max("gid").over(lot))
    # equal groups of several tasks are several rows, which the pairs drop again
    return shared.where("least <> most or lot > 0").select("token", "lot", "gid", "n", "pos").distinct()


def _linked(docs: DataFrame, pairs: DataFrame, kind: str) -> DataFrame:
    """Of the pairs (a, b) of documents, those whose whole shingle sets are alike enough; only their texts are shuffled."""
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = checkpointed(pairs)
    wanted = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, begin in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([x.tobytes() for x in shingle_sets(data, begin)], pa.binary())], ["key", "shingles"])

    chosen = docs.join(wanted, "key", "left_semi").dropDuplicates(["key"])
    sets = checkpointed(chosen.mapInArrow(whole, f"key {kind}, shingles binary"))
    one = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa")), "a")
    both = one.join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb")), "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                rows = batch.slice(first, 512)
                good = []
                for x, y in zip(rows.column(2), rows.column(3), strict=True):
                    x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                    common = len(x) + len(y) - len(np.union1d(x, y))
                    good.append(len(x) > 0 and 100 * common >= 75 * (len(x) + len(y) - common))
                kept = pa.array(good, pa.bool_())
                yield pa.RecordBatch.from_arrays([rows.column(0).filter(kept), rows.column(1).filter(kept)], ["a", "b"])

    return both.mapInArrow(run, pairs.select("a", "b").schema)


def cluster(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Near copies of every whole text: (key, n_shingles, component_id), component_id the smallest key reachable by links.

    Two texts link when their shingle sets have a Jaccard similarity of 0.75 or more; links are exact (by 64-bit shingle hashes).
    A null or empty text has no shingles and links with nothing; a text of fewer words is one shingle. Rows that share a key
    are one document, linked; rows without a key link with nothing and get a null component_id. Other columns are not read.

    Counts of shingles are a fixed table of buckets over all documents; exact copies are one class; a shingle's groups are
    met in lots, so no shingle, however common, is one task; only texts of candidates are shuffled.
    """
    kind = df.schema[key].dataType.simpleString()
    docs = df.select(df[key].alias("key"), df[text].alias("text"))
    first = checkpointed(docs.mapInArrow(_signatures, f"key {kind}, n long, s1 long, s2 long, block int, counts binary"))
    signed = first.where("block is null").select("key", "n", "s1", "s2")
    table = table_of_blocks(first.where("block is not null").select("block", "counts"), BUCKETS, BLOCK)  # 4 MB
    counts = docs.sparkSession.sparkContext.broadcast(table)

    # classes: equal sets
    filled = signed.where("n > 0 and key is not null")
    classes = filled.groupBy("s1", "s2", "n").agg(F.min("key").alias("cid"))
    same = checkpointed(filled.join(classes, ["s1", "s2", "n"]).select("key", "n", "cid"))
    # groups: equal prefix and size, by a hash of both
    keyed = docs.where("key is not null")
    grouped = keyed.mapInArrow(_groups(counts), f"key {kind}, gid long")
    members = checkpointed(grouped.join(same.select("key", "cid"), "key").select("gid", "cid").distinct())
    leaders = checkpointed(members.groupBy("gid").agg(F.min("cid").alias("leader")))
    met = checkpointed(_met(keyed, counts))

    # the first of a lot stands for it: members against their group's leader, groups against their lot's first, lots against the first lot
    inner = members.join(leaders, "gid").where("cid <> leader").select(F.col("cid").alias("a"), F.col("leader").alias("b"))
    led = met.withColumn("lead", F.min(F.struct("gid", "n")).over(W.partitionBy("token", "lot")))
    star = led.where("gid <> lead.gid").select(F.col("gid").alias("g"), F.col("lead.gid").alias("h"), F.col("n").alias("n1"), F.col("lead.n").alias("n2"))
    firsts = led.where("gid = lead.gid")
    zero = firsts.groupBy("token").agg(F.min(F.struct("lot", "gid", "n")).alias("f")).select("token", F.col("f.gid").alias("h"), F.col("f.n").alias("n2"))
    across = firsts.where("lot > 0").join(zero, "token").where("gid <> h").select(F.col("gid").alias("g"), "h", F.col("n").alias("n1"), "n2")
    outer = _likely(star.unionByName(across), "g", "h")
    outer = outer.join(leaders.select(F.col("gid").alias("g"), F.col("leader").alias("a")), "g").join(leaders.select(F.col("gid").alias("h"), F.col("leader").alias("b")), "h")
    # rows that share a key are one document
    twins = same.groupBy("key").agg(F.min("cid").alias("b"), F.max("cid").alias("top")).where("b <> top")
    twins = same.join(twins, "key").select(F.col("cid").alias("a"), "b").where("a <> b")
    links = checkpointed(_linked(keyed, outer.select("a", "b").unionByName(inner), kind).unionByName(twins))
    roots = components(links)

    # what still lies in different components, though enough shingles or a group are shared; as long as very many groups meet at one
    # shingle, they are verified against a few of them in turns, since links found there spare all pairs between two components
    turn, worth = 0, True
    while True:
        units = members.join(roots, members["cid"] == roots["node"], "left").select("gid", "cid", F.coalesce("root", "cid").alias("root"))
        units = checkpointed(units)
        open_rows = _open(units, met)
        if turn == TURNS or not worth or not _crowded(open_rows):
            break
        g, h = (leaders.select(F.col("gid").alias("gid" + k), F.col("leader").alias(c)) for k, c in (("_1", "a"), ("_2", "b")))
        tried = checkpointed(_star(open_rows, turn).join(g, "gid_1").join(h, "gid_2").select("a", "b"))
        more = checkpointed(_linked(keyed, tried, kind))
        links = links.unionByName(more)
        roots = components(links)
        turn, worth = turn + 1, 10 * more.count() >= tried.count()
    # of a group, the first member of each component
    parts = units.groupBy("gid", "root").agg(F.min("cid").alias("cid"))
    cross = _crossing(open_rows).distinct()
    u, v = (units.select(F.col("gid").alias("gid" + k), F.col("cid").alias("cid" + k), F.col("root").alias("root" + k)) for k in ("_1", "_2"))
    cross = cross.join(u, "gid_1").join(v, "gid_2").where("root_1 <> root_2").select(F.col("cid_1").alias("a"), F.col("cid_2").alias("b"))
    several = parts.groupBy("gid").count().where("count > 1").select("gid")
    some = units.join(several, "gid", "left_semi")
    u, v = (some.select("gid", F.col("cid").alias("cid" + k), F.col("root").alias("root" + k)) for k in ("_1", "_2"))
    within = u.join(v, "gid").where("root_1 < root_2").select(F.col("cid_1").alias("a"), F.col("cid_2").alias("b"))
    links = links.unionByName(checkpointed(_linked(keyed, cross.unionByName(within), kind)))
    roots = components(links)
    found = same.join(roots, same["cid"] == roots["node"], "left").select("key", F.coalesce("root", "cid").alias("root"))
    found = found.groupBy("key").agg(F.min("root").alias("component_id"))
    done = signed.join(found, "key", "left").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id"))
    return done
