"""Removal of byte strings that occur more than once, by suffix arrays of the places where texts agree.

Of every window of a text the least k-gram hash is its anchor, so equal windows have equal anchors at equal places, and a
run of windows with one anchor is a segment. Segments that repeat as a whole are counted; an anchor with different
segments has them sorted: cut into cells aligned to the anchor, they are one string of cell symbols, whose suffix array is
built by linear grouping, and neighbours in it show which windows start elsewhere too.

The suffix array groups suffixes by their longest Lyndon prefix: groups are taken in descending order, each suffix
points to the nearest earlier one in a lower group, and those pointed at move to the top of their group. Then the order within
every group follows from the suffixes that come first, without naming groups anew.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.common import checkpointed, mixed, prefix_hashes, slices, span_hashes, utf8

LENGTH = 400
#: Symbols that are sorted together, about, and the most segments of one anchor that are; above it their windows are counted by hash.
SYMBOLS, SEGMENTS = 120_000, 4096


def suffix_array(symbols: list[int]) -> list[int]:
    """The suffixes of a string of small whole numbers in ascending order, in about linear time."""
    n = len(symbols)
    if not n:
        return []
    # groups are runs of order; where[i] is the place of suffix i, group[i] the first place of its group, size[g] how many are in it
    order = sorted(range(n), key=symbols.__getitem__)
    where, group, size = [0] * n, [0] * n, [0] * n
    first = 0
    for place, suffix in enumerate(order):
        if symbols[suffix] != symbols[order[first]]:
            first = place
        where[suffix], group[suffix] = place, first
        size[first] += 1
    previous = [-1] * n
    end = n
    while end:
        # phase one: the highest group that is not done
        start = group[order[end - 1]]
        pointed: list[int] = []
        for suffix in sorted(order[start:end]) if end - start > 1 else order[start:end]:
            at = suffix - 1
            while at >= 0 and group[at] >= start:
                at = previous[at]
            previous[suffix] = at
            if at >= 0:
                pointed.append(at)
        end = start
        if not pointed:
            continue
        times = Counter(pointed)
        by_times: dict[int, list[int]] = {}
        for suffix, count in times.items():
            by_times.setdefault(count, []).append(suffix)
        for count in sorted(by_times, reverse=True):  # those pointed at more often move higher
            moved: dict[int, int] = {}
            for suffix in by_times[count]:
                old = group[suffix]
                k = moved[old] = moved.get(old, 0) + 1
                place, last = where[suffix], old + size[old] - k
                other = order[last]
                order[place], order[last] = other, suffix
                where[other], where[suffix] = place, last
            for old, k in moved.items():
                if k < size[old]:
                    size[old] -= k
                    new = old + size[old]
                    size[new] = k
                    for place in range(new, new + k):
                        group[order[place]] = new
    # phase two: the end of the string is the least suffix of all; each suffix emitted puts the one before it next in its group
    found, filled = [-1] * n, [0] * n

    def emit(suffix: int) -> None:
        while suffix >= 0:
            g = group[suffix]
            if group[suffix] < 0:
                return
            found[g + filled[g]] = suffix
            filled[g] += 1
            group[suffix] = -1
            suffix = previous[suffix]

    emit(n - 1)
    for place in range(n):
        suffix = found[place] - 1
        if suffix >= 0 and group[suffix] >= 0:
            emit(suffix)
    return found


def _shape(length: int) -> tuple[int, int]:
    """Bytes of an anchor and of a cell for windows of this length: 128 and 16 for 400."""
    return max(1, length * 8 // 25), max(1, length // 25)


def _segments(data: np.ndarray, begin: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of every text its runs of windows with one anchor: row, first and last window, anchor's place, anchor's hash, hash of the whole."""
    k, _ = _shape(length)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    sums = prefix_hashes(data)
    start = np.arange(len(data) - k + 1)
    gram = span_hashes(sums, start, start + k)
    # hash above, place below: the least number is the leftmost of the least hashes
    least = (gram & np.uint64(0xFFFFFFFF00000000)) | start.astype(np.uint64)
    width, reach = length - k + 1, 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    whole = np.flatnonzero(np.diff(begin) >= length)
    inside = np.zeros(len(place) + 1, np.int8)
    np.add.at(inside, begin[whole], 1)
    np.add.at(inside, begin[whole + 1] - length + 1, -1)
    inside = np.cumsum(inside[:-1]) > 0
    opens = inside.copy()
    opens[1:] &= (place[1:] != place[:-1]) | ~inside[:-1]
    opens[begin[whole]] = True
    first = np.flatnonzero(opens)
    row = np.searchsorted(begin, first, "right") - 1
    last = np.minimum(np.append(first[1:] - 1, len(place) - 1), begin[row + 1] - length)
    anchor = place[first]
    text = mixed(span_hashes(sums, first, last + length) + (anchor - first).astype(np.uint64))
    return row, first - begin[row], last - begin[row], anchor - begin[row], gram[anchor], text


_PACKED = np.dtype([("anchor", "<i8"), ("whole", "<i8"), ("first", "<i4"), ("last", "<i4"), ("at", "<i4")])


def _packed(length: int):
    """A row for each text: its size, its key and its segments in one binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, begin in slices(batch, "text"):
                row, first, last, at, anchor, whole = _segments(data, begin, length)
                table = np.empty(len(row), _PACKED)
                table["anchor"], table["whole"] = anchor.view(np.int64), whole.view(np.int64)
                table["first"], table["last"], table["at"] = first, last, at
                cut = np.searchsorted(row, np.arange(rows.num_rows + 1))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([table[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["doc", "segments"])

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            rows = batch.slice(at, 1024)
            raw = rows.column(1).to_pylist()
            table = np.frombuffer(b"".join(raw), _PACKED)
            doc = rows.column(0).take(pa.array(np.repeat(np.arange(len(raw)), [len(x) // _PACKED.itemsize for x in raw])))
            yield pa.RecordBatch.from_arrays([doc, *(pa.array(np.ascontiguousarray(table[c])) for c in _PACKED.names)], ["doc", *_PACKED.names])


def _texts_of_segments(length: int):
    """Of each document the wanted segments' bytes, from its text, its segments and the wanted (anchor, whole)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                rows = batch.slice(k, 64)
                data, begin = utf8(rows.column("text"))
                out: list[list] = [[], [], [], [], []]
                for n, (packed, wanted) in enumerate(zip(rows.column("segments").to_pylist(), rows.column("wanted").to_pylist(), strict=True)):
                    left = {(x["anchor"], x["whole"]) for x in wanted}
                    for anchor, whole, first, last, at in np.frombuffer(packed, _PACKED).tolist():
                        if (anchor, whole) in left:
                            left.discard((anchor, whole))
                            span = data[begin[n] + first : begin[n] + last + length].tobytes()
                            for column, x in zip(out, (anchor, whole, at - first, last - first + 1, span), strict=True):
                                column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["anchor", "whole", "at", "windows", "span"])

    return run


def repeated_windows(spans: list[bytes], at: list[int], windows: list[int], groups: list[int], length: int) -> list[np.ndarray]:
    """Of every segment, which windows also start in another one of its group or elsewhere in itself.

    at: the anchor's place in each span; windows: how many start in it. Spans of one group agree at their anchors.
    """
    _, cell = _shape(length)
    full = (length - cell) // cell  # whole cells that every window has after its first bytes
    phase = [a % cell for a in at]
    data = np.frombuffer(b"".join(spans), np.uint8)
    base = np.concatenate([[0], np.cumsum([len(s) for s in spans])])
    # cells of all spans as symbols, a separator after each span
    cells = [(len(s) - p) // cell for s, p in zip(spans, phase, strict=True)]
    starts = np.concatenate([base[n] + phase[n] + cell * np.arange(c) for n, c in enumerate(cells)])
    grid = data[starts[:, None] + np.arange(cell)]
    _, symbol = np.unique(np.ascontiguousarray(grid).view(f"V{cell}").ravel(), return_inverse=True)
    first = np.concatenate([[0], np.cumsum(np.array(cells) + 1)])  # of each span, in the string
    string = np.zeros(first[-1], np.int64)
    keep = np.ones(len(string), bool)
    keep[first[1:] - 1] = False
    string[keep] = symbol.ravel() + 1
    array = np.array(suffix_array(string.tolist()), np.int64)
    # classes of suffixes that agree in their next cells: neighbours in the array
    after = np.repeat(first[1:] - 1, np.diff(first)) - np.arange(len(string))  # cells up to the separator
    ranked = np.concatenate([string, np.zeros(full + 1, np.int64)])
    alike = (after[array[1:]] >= full) & (after[array[:-1]] >= full)
    for k in range(full):
        alike &= ranked[array[1:] + k] == ranked[array[:-1] + k]
    number = np.empty(len(string), np.int64)
    number[array] = np.concatenate([[0], np.cumsum(~alike)])
    shared = np.bincount(number)[number] > 1
    # a window: bytes up to the next cell, then the class, then the bytes left
    span = np.repeat(np.arange(len(spans)), windows)
    nth = np.arange(len(span)) - np.repeat(np.cumsum(windows) - windows, windows)
    phases = np.array(phase)[span]
    following = (nth - phases) // cell + 1  # cell that begins after the window's first byte
    suffix = first[span] + following
    open_ = np.flatnonzero(shared[suffix])
    sums = prefix_hashes(data)
    begin = base[span] + nth
    middle = base[span] + phases + following * cell
    key = span_hashes(sums, begin[open_], middle[open_]) ^ mixed(span_hashes(sums, middle[open_] + full * cell, begin[open_] + length) + np.uint64(1))
    key = mixed(key + number[suffix[open_]].astype(np.uint64)) ^ mixed((middle - begin)[open_].astype(np.uint64) + np.array(groups, np.uint64)[span[open_]] * np.uint64(0x9E3779B97F4A7C15))
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    hit = np.zeros(len(span), bool)
    hit[open_] = count[inverse.ravel()] > 1
    return np.split(hit, np.cumsum(windows)[:-1])


def _checked(length: int):
    """Which windows repeat of each segment that was seen once, for rows that are sorted by anchor; whole groups are sorted together."""

    def done(rows: list[tuple]) -> pa.RecordBatch:
        numbers = {a: n for n, a in enumerate(dict.fromkeys(r[0] for r in rows))}
        hits = repeated_windows([r[4] for r in rows], [r[2] for r in rows], [r[3] for r in rows], [numbers[r[0]] for r in rows], length)
        new = [(r[0], r[1], np.packbits(x).tobytes()) for r, x in zip(rows, hits, strict=True) if r[5] == 1 and x.any()]
        return pa.RecordBatch.from_arrays([pa.array([x[n] for x in new], t) for n, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["anchor", "whole", "hits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group, symbols, cell = None, 0, _shape(length)[1]
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns[:6]), strict=True):
                if row[0] != group:
                    group = row[0]
                    if symbols >= SYMBOLS:
                        yield done(held)
                        held, symbols = [], 0
                held.append(row)
                symbols += len(row[4]) // cell
        if held:
            yield done(held)

    return run


def _windows(length: int):
    """Every window of a segment by hash, for anchors of more segments than are sorted together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns[:5]), strict=True):
                anchor, whole, at, windows, span = row
                nth = np.arange(windows)
                value = span_hashes(prefix_hashes(np.frombuffer(span, np.uint8)), nth, nth + length)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(windows, anchor)), pa.array(np.full(windows, whole)), pa.array(nth), pa.array((at - nth)), pa.array(value.view(np.int64))], ["anchor", "whole", "nth", "ahead", "value"])

    return run


def _cut(length: int):
    """The text without its repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                rows = batch.slice(k, 64)
                data, begin = utf8(rows.column("text"))
                sizes, removed, spans, kept = [], [], [], []
                for n, found in enumerate(rows.column("found").to_pylist()):
                    text = data[begin[n] : begin[n + 1]]
                    change = np.zeros(len(text) + 1, np.int32)
                    for x in found or ():
                        if x["hits"] is None:
                            change[x["first"]] += 1
                            change[x["last"] + length] -= 1
                        else:
                            hit = np.flatnonzero(np.unpackbits(np.frombuffer(x["hits"], np.uint8))[: x["last"] - x["first"] + 1]) + x["first"]
                            np.add.at(change, hit, 1)
                            np.add.at(change, hit + length, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    sizes.append(len(text)), removed.append(int(gone.sum()))
                    spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                    kept.append(text[~gone].tobytes())
                whole = pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string())
                more = [n for n in rows.schema.names if n not in ("text", "found")]
                yield pa.RecordBatch.from_arrays([*map(rows.column, more), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(kept, pa.binary()), whole], [*more, "n_bytes", "n_removed", "n_spans", "kept", "kept_text"])

    return run


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, keep: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """Texts without the bytes of strings of this length that start more than once: (key, *keep, n_bytes, n_removed, n_spans, kept).

    With as_text there is a column kept_text more: what is kept, without the rest of characters that a cut falls into. Strings are
    judged on the input; they may overlap, and both may lie in one text. kept is binary, since a cut can fall inside a
    character; n_spans counts maximal removed runs. A null or empty text stays empty; repeated rows are repeats of
    each other, rows that share a key but not a text are handled apart, and columns beside those to keep are not read.

    Only keys, hashes and, where texts agree in part, segments of about length to twice that are shuffled by anchor; whole
    texts are shuffled by key alone. Exact copies meet as counts, and an anchor of very many segments is counted by window.
    """
    # a row's own name: its key and text's hash, since keys may repeat or be null
    more = {f"k{n}": c for n, c in enumerate(keep)}
    docs = df.select(df[key].alias("key"), *[df[c].alias(n) for n, c in more.items()], F.coalesce(df[text], F.lit("")).alias("text"))
    named = docs.withColumn("doc", F.xxhash64("key", "text"))
    packed = checkpointed(named.where(F.octet_length("text") >= length).select("doc", "text").mapInArrow(_packed(length), "doc long, segments binary"))
    segments = packed.mapInArrow(_unpacked, "doc long, anchor long, whole long, first int, last int, at int")
    kinds = segments.groupBy("anchor", "whole").agg(F.count("*").alias("times"), F.min("doc").alias("doc"))
    anchors = kinds.groupBy("anchor").agg(F.count("*").alias("segments"), F.max("times").alias("most")).where("segments > 1 or most > 1")
    kinds = checkpointed(kinds.join(anchors.drop("most"), "anchor"))
    open_ = kinds.where("segments > 1")
    wanted = open_.groupBy("doc").agg(F.collect_list(F.struct("anchor", "whole")).alias("wanted"))
    wanted = wanted.join(packed.dropDuplicates(["doc"]), "doc")
    spans = named.select("doc", "text").join(wanted, "doc").select("doc", "text", "segments", "wanted").mapInArrow(_texts_of_segments(length), "anchor long, whole long, at int, windows int, span binary")
    sized = checkpointed(spans.join(open_.select("anchor", "whole", "times", "segments"), ["anchor", "whole"]).select("anchor", "whole", "at", "windows", "span", "times", "segments"))
    hits_type = "anchor long, whole long, hits binary"
    sorted_ = sized.where(F.col("segments") <= SEGMENTS).repartition("anchor").sortWithinPartitions("anchor", "whole").mapInArrow(_checked(length), hits_type)
    rows = sized.where(F.col("segments") > SEGMENTS).mapInArrow(_windows(length), "anchor long, whole long, nth long, ahead long, value long")
    twice = rows.groupBy("anchor", "ahead", "value").agg(F.count("*").alias("n")).where("n > 1")
    by_window = rows.join(twice, ["anchor", "ahead", "value"]).groupBy("anchor", "whole").agg(F.collect_list("nth").alias("nth"))
    by_window = by_window.join(open_.where("times = 1").select("anchor", "whole"), ["anchor", "whole"], "left_semi")

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for nth in batch.column(2).to_pylist():
                hit = np.zeros(max(nth) + 1, bool)
                hit[nth] = True
                out.append(np.packbits(np.append(hit, np.zeros(length, bool))).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["anchor", "whole", "hits"])

    hits = sorted_.unionByName(by_window.mapInArrow(bits, hits_type))
    whole = kinds.where("times > 1").select("anchor", "whole", F.lit(None).cast("binary").alias("hits"))
    known = checkpointed(whole.unionByName(hits))
    found = segments.join(known, ["anchor", "whole"]).groupBy("doc").agg(F.collect_list(F.struct("first", "last", "hits")).alias("found"))
    joined = named.join(found, "doc", "left").drop("doc")
    schema = ", ".join(f"{c} {named.schema[c].dataType.simpleString()}" for c in ("key", *more))
    done = joined.mapInArrow(_cut(length), f"{schema}, n_bytes long, n_removed long, n_spans long, kept binary, kept_text string")
    named = done.toDF(key, *keep, "n_bytes", "n_removed", "n_spans", "kept", "kept_text")
    return named if as_text else named.drop("kept_text")
