"""Secrets in texts: patterns, and a linear-chain conditional random field that finds what they miss.

A text is cut into tokens. Each is tagged as the begin of a secret, inside one, or outside, from its shape, the words beside it, what
stands between them, and features of the whole text; Viterbi finds the best tags. The field learns from the patterns' own
matches: their values are secrets, all else in the sampled texts is not, and every window is learnt a second time without its
words, so that the shape has to tell on its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.common import checkpointed, lowered, mixed, prefix_hashes, slices, span_hashes

#: Kind, pattern, group that has the value, least length of it. The kinds' order is that of equal starts; ADDED comes last.
RULES = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]{32,}"), 0, 32),
)
KINDS, ADDED = tuple(rule[0] for rule in RULES), "crf"
#: Distinct texts with a match and distinct ones without, by order of their hash, from which the field learns; windows of a text,
#: tokens beside the middle one of a window.
SAMPLE, WINDOWS, REACH = 1000, 4, 8
#: Rounds over the windows, windows at a time and rate of the fit, and how strongly weights are drawn to zero.
ROUNDS, BATCH, RATE, DECAY, SEED = 12, 512, 0.05, 3e-4, 11
BEGIN, INSIDE, OUTSIDE = 0, 1, 2
SPANS = "array<struct<kind:string,start:int,end:int>>"


def matches(text: str) -> list[tuple[int, int, int, int, int]]:
    """The patterns' matches: (start, kind's number, end, start and end of the value), by start, then kind."""
    found = []
    for n, (_, pattern, group, least) in enumerate(RULES):
        found += [(m.start(), n, m.end(), *m.span(group)) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found)


# --- tokens and their features ----------------------------------------------------------------------


def _classes() -> np.ndarray:
    """Of every byte: 0 sign or space, 1 lower, 2 upper, 3 digit, 4 sign within tokens, 5 part of another letter."""
    table = np.zeros(256, np.int8)
    for n, signs in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"+/_-"), 1):
        table[list(signs)] = n
    table[128:] = 5
    return table


_CLASS = _classes()


def _among(signs: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(signs)] = True
    return table


_HEX, _BLANK = _among(b"0123456789abcdef"), _among(b" \n\t\r")
_MARKS = [_among(signs) for signs in (b"=:", b"\"'`", b"\n", b".@")]
_LENGTHS = np.array([2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 24, 32, 40, 48, 64])
_HASHED = 1 << 12
#: Entries that each feature has in the table of weights: shape and length, changes of class, share of digits, hex or not, first bytes;
#: word before, the one before that, word after; gap before and after; the text's digits, signs and length of words; shape of longer tokens.
_SIZES = np.array([512, 128, 144, 32, _HASHED, _HASHED + 1, _HASHED + 1, _HASHED + 1, 32, 32, 32, 32, 32, 256])
_OFFSETS = np.concatenate([[0], np.cumsum(_SIZES)])
_WORDS = (5, 6, 7)  # the features that name a word beside the token


def tokens(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters, digits and a few signs: first byte, end, and text of each. No token crosses texts."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    solid = _CLASS[data] > 0
    edge = np.zeros(len(data) + 1, bool)
    edge[begin] = True
    first, last = solid & edge[:-1], solid & edge[1:]
    first[1:] |= solid[1:] & ~solid[:-1]
    last[:-1] |= solid[:-1] & ~solid[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(begin, start, "right") - 1


def _between(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many bytes of each span have a flag."""
    sums = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=sums[1:])
    return sums[end] - sums[start]


def features(data: np.ndarray, begin: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> Iterator[np.ndarray]:
    """For every token the entries of the table of weights that it has, one feature after the other."""
    kind, n = _CLASS[data], len(start)
    length = end - start
    size = np.searchsorted(_LENGTHS, length, "right")
    count = [_between(kind == k, start, end) for k in range(1, 6)]
    shape = sum((c > 0).astype(np.int64) << k for k, c in enumerate(count))
    change = np.zeros(len(data), bool)
    change[1:] = kind[1:] != kind[:-1]
    changes = np.minimum(_between(change, np.minimum(start + 1, end), end), 7)
    yield shape * 16 + size
    yield _OFFSETS[1] + changes * 16 + size
    yield _OFFSETS[2] + count[2] * 8 // length * 16 + size
    hexes = _between(_HEX[data], start, end) == length
    yield _OFFSETS[3] + hexes * 16 + size
    four = np.zeros(n, np.uint64)
    for k in range(4):
        four = four << np.uint64(8) | np.where(start + k < end, data[np.minimum(start + k, len(data) - 1)], 0).astype(np.uint64)
    yield _OFFSETS[4] + (mixed(four) >> np.uint64(52)).astype(np.int64)
    sums = prefix_hashes(lowered(data))
    word = (span_hashes(sums, start, end) >> np.uint64(52)).astype(np.int64)
    del sums
    for k, step in enumerate((1, 2, -1), 5):
        beside = np.full(n, _HASHED)
        here, there = (slice(step, None), slice(None, -step)) if step > 0 else (slice(None, step), slice(-step, None))
        beside[here] = np.where(row[here] == row[there], word[there], _HASHED)
        yield _OFFSETS[k] + beside
    text_start, text_end = begin[row], begin[row + 1]
    before, after = text_start.copy(), text_end.copy()
    before[1:] = np.maximum(end[:-1], text_start[1:])
    after[:-1] = np.minimum(start[1:], text_end[:-1])
    marks = [table[data] for table in _MARKS]
    for k, (a, b) in enumerate(((before, start), (end, after)), 8):
        gap = sum((_between(m, a, b) > 0).astype(np.int64) << j for j, m in enumerate(marks))
        yield _OFFSETS[k] + gap * 2 + (b - a > 1)
    # features of the whole text, apart for tokens with digits or of some length
    odd = (count[2] > 0).astype(np.int64) + 2 * (length >= 12)
    whole = np.maximum(np.diff(begin), 1)
    n_tokens = np.maximum(np.bincount(row, minlength=len(begin) - 1), 1)
    solid = _between(kind > 0, begin[:-1], begin[1:])
    digits = np.minimum(_between(kind == 3, begin[:-1], begin[1:]) * 40 // whole, 7)
    signs = np.minimum(_between((kind == 0) & ~_BLANK[data], begin[:-1], begin[1:]) * 40 // whole, 7)
    for k, of_text in enumerate((digits, signs, np.minimum(solid // n_tokens, 7)), 10):
        yield _OFFSETS[k] + of_text[row] * 4 + odd
    yield _OFFSETS[13] + shape * 8 + hexes * 4 + (length >= 12) * 2 + (changes > 3)


# --- the field ----------------------------------------------------------------------------------------


class Field:
    """Weights of every feature for each tag, of a tag after another, and of a text's first tag."""

    def __init__(self) -> None:
        self.weights = np.zeros((int(_OFFSETS[-1]), 3))
        self.step, self.start = np.zeros((3, 3)), np.zeros(3)

    def fit(self, ids: np.ndarray, tags: np.ndarray) -> None:
        """Most likely tags (windows, tokens), -1 for none, of features (windows, tokens, features), by Adam over small batches of windows."""
        held = [self.weights, self.step, self.start]
        state = [(np.zeros_like(x), np.zeros_like(x)) for x in held]
        random, order, turn = np.random.default_rng(SEED), np.arange(len(ids)), 0
        for _ in range(ROUNDS):
            random.shuffle(order)
            for at in range(0, len(order), BATCH):
                pick, turn = order[at : at + BATCH], turn + 1
                for value, g, (m, v) in zip(held, self._slope(ids[pick], tags[pick]), state, strict=True):
                    g = g + DECAY * value
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    value -= RATE * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)

    def _slope(self, ids: np.ndarray, tags: np.ndarray) -> list[np.ndarray]:
        """By how much the tags expected exceed those given, for every weight."""
        n, length, width = ids.shape
        live = tags >= 0
        both = live[:, 1:] & live[:, :-1]
        first = live & ~np.concatenate([np.zeros((n, 1), bool), live[:, :-1]], axis=1)
        gold = np.eye(3)[np.where(live, tags, 0)] * live[..., None]
        emit = self.weights[np.where(live[..., None], ids, 0)].sum(axis=2)
        # sums over all tags, forward and backward, by logarithms
        ahead, back = np.zeros((n, length, 3)), np.zeros((n, length, 3))
        for t in range(length):
            ahead[:, t] = self.start + emit[:, t]
            if t:
                goes = _total(ahead[:, t - 1, :, None] + self.step, 1) + emit[:, t]
                ahead[:, t] = np.where(both[:, t - 1, None], goes, ahead[:, t])
        for t in range(length - 2, -1, -1):
            goes = _total(self.step + (emit[:, t + 1] + back[:, t + 1])[:, None, :], 2)
            back[:, t] = np.where(both[:, t, None], goes, 0)
        whole = _total(ahead + back, 2)[..., None]
        chance = np.exp(ahead + back - whole) * live[..., None]
        move = ahead[:, :-1, :, None] + self.step + (emit + back)[:, 1:, None, :] - whole[:, 1:, :, None]
        moves = np.where(both[..., None, None], np.exp(np.minimum(move, 0)), 0).sum(axis=(0, 1))
        error, flat = (chance - gold)[live], ids[live].ravel()
        weights = [np.bincount(flat, weights=np.repeat(error[:, k], width), minlength=len(self.weights)) for k in range(3)]
        pairs = np.einsum("nls,nlt->st", gold[:, :-1] * both[..., None], gold[:, 1:])
        return [np.stack(weights, axis=1) / n, (moves - pairs) / n, (chance[first].sum(axis=0) - gold[first].sum(axis=0)) / n]

    def emissions(self, data: np.ndarray, begin: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> np.ndarray:
        total = np.zeros((len(start), 3))
        for ids in features(data, begin, start, end, row):
            total += self.weights[ids]
        return total

    def tags(self, emit: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best tags of tokens, where `first` begins a text, by Viterbi.

        The tokens are cut into blocks of equal length that advance side by side: once from each of the three tags that may stand before
        a block, then, as the best one is known from the blocks before, from that one.
        """
        n = len(emit)
        if not n:
            return np.zeros(0, np.int8)
        size = int(np.ceil(np.sqrt(n)))
        blocks = -(-n // size)
        scores, fresh = np.zeros((blocks * size, 3)), np.ones(blocks * size, bool)
        scores[:n], fresh[:n] = emit, first
        scores = np.ascontiguousarray(scores.reshape(blocks, size, 3).transpose(1, 2, 0))  # token, tag, block
        fresh = [np.flatnonzero(x) for x in fresh.reshape(blocks, size).T]
        step, start = self.step[:, :, None], self.start[:, None]
        best = np.where(np.eye(3, dtype=bool), 0.0, -np.inf)[:, :, None] * np.ones(blocks)  # tag before the block, tag now, block
        for t in range(size):
            goes = np.maximum(np.maximum(best[:, :1] + step[0], best[:, 1:2] + step[1]), best[:, 2:] + step[2])
            if len(fresh[t]):
                goes[:, :, fresh[t]] = best[:, :, fresh[t]].max(axis=1, keepdims=True) + start
            best = goes + scores[t]
        entry, by_block = np.zeros((blocks + 1, 3)), np.ascontiguousarray(best.transpose(2, 0, 1))
        for b in range(blocks):
            reached = (entry[b][:, None] + by_block[b]).max(axis=0)
            entry[b + 1] = reached - reached.max()
        back = np.empty((size, 3, blocks), np.int8)
        value = np.ascontiguousarray(entry[:-1].T)
        for t in range(size):
            goes = value[:, None, :] + step
            if len(fresh[t]):
                goes[:, :, fresh[t]] = value[:, None, fresh[t]] + start
            most = np.maximum(goes[0], goes[1])
            back[t] = goes[1] > goes[0]
            np.copyto(back[t], 2, where=goes[2] > most)
            value = np.maximum(most, goes[2]) + scores[t]
        at = np.zeros(blocks, np.int64)
        at[-1] = value[:, -1].argmax()
        for b in range(blocks - 1, 0, -1):
            at[b - 1] = (entry[b] + by_block[b][:, at[b]]).argmax()
        found, every = np.empty((size, blocks), np.int8), np.arange(blocks)
        for t in range(size - 1, -1, -1):
            found[t] = at
            at = back[t, at, every]
        return found.T.ravel()[:n]


def _total(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis=axis, keepdims=True)
    return (most + np.log(np.exp(x - most).sum(axis=axis, keepdims=True))).squeeze(axis)


# --- learning from the patterns' matches --------------------------------------------------------------


def _windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and tags of some windows of a text: around its matches, else around the longest tokens, with digits and of any kind."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    begin = np.array([0, len(data)])
    start, end, row = tokens(data, begin)
    n = len(start)
    if not n:
        return np.zeros((0, 2 * REACH + 1, len(_SIZES)), np.int32), np.zeros((0, 2 * REACH + 1), np.int8)
    places = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # first byte of every character
    tag, middles = np.full(n, OUTSIDE, np.int8), []
    for *_, a, b in matches(text):
        inside = np.flatnonzero((end > places[a]) & (start < places[b]))
        if len(inside) and tag[inside[0]] == OUTSIDE:
            tag[inside], tag[inside[0]] = INSIDE, BEGIN
            middles.append(int(inside[0]))
    if not middles:
        length, digits = end - start, _between(_CLASS[data] == 3, start, end)
        longest = [np.lexsort((np.arange(n), -x)) for x in (np.where(digits > 0, length, 0), length)]
        middles = [int(x[k]) for k in range(min(WINDOWS // 2, n)) for x in longest]
    ids = np.stack(list(features(data, begin, start, end, row)), axis=1)
    spot = np.array(sorted(set(middles))[:: max(1, len(set(middles)) // WINDOWS)][:WINDOWS])[:, None] + np.arange(-REACH, REACH + 1)
    there = (spot >= 0) & (spot < n)
    spot = np.where(there, spot, 0)
    return ids[spot].astype(np.int32), np.where(there, tag[spot], -1).astype(np.int8)


def learnt(texts: DataFrame) -> Field | None:
    """The field of a table (text); None if no text has a match. The windows of at most twice SAMPLE texts come to the driver."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [bool(matches(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("hash"), pa.array(hit, pa.bool_())], ["hash", "hit"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_windows(t) for t in batch.column("text").to_pylist()]
            columns = [batch.column("hash"), pa.array([a.tobytes() for a, _ in found], pa.binary()), pa.array([b.tobytes() for _, b in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["hash", "ids", "tags"])

    texts = texts.select("text", F.xxhash64("text").alias("hash")).where("text <> ''")
    marks = checkpointed(texts.mapInArrow(marked, "hash bigint, hit boolean").distinct())
    picked = [marks.where("hit" if hit else "not hit").orderBy("hash").limit(SAMPLE) for hit in (True, False)]
    if picked[0].isEmpty():
        return None
    sample = texts.join(F.broadcast(picked[0].unionByName(picked[1])), "hash", "left_semi")  # 2,000 numbers at most
    rows = sample.mapInArrow(cut, "hash bigint, ids binary, tags binary").dropDuplicates(["hash"]).orderBy("hash").collect()
    ids = np.concatenate([np.frombuffer(bytes(r.ids), np.int32) for r in rows]).reshape(-1, 2 * REACH + 1, len(_SIZES)).astype(np.int64)
    tags = np.concatenate([np.frombuffer(bytes(r.tags), np.int8) for r in rows]).reshape(-1, 2 * REACH + 1)
    blind = ids.copy()
    blind[..., _WORDS] = _OFFSETS[list(_WORDS)] + _HASHED
    field = Field()
    field.fit(np.concatenate([ids, blind]), np.concatenate([tags, tags]))
    return field


# --- the operator -------------------------------------------------------------------------------------


def _added(field: Field, data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and end (code points of the text) of the secrets that the field finds."""
    start, end, row = tokens(data, begin)
    first = np.ones(len(row), bool)
    first[1:] = row[1:] != row[:-1]
    tag = field.tags(field.emissions(data, begin, start, end, row), first)
    # a secret begins at a begin, and at an inside that follows no secret
    secret = tag != OUTSIDE
    follows = np.zeros(len(tag), bool)
    follows[1:] = secret[:-1] & ~first[1:]
    opens = np.flatnonzero(secret & ((tag == BEGIN) | ~follows))
    goes = np.zeros(len(tag) + 1, bool)
    goes[:-1] = secret & (tag == INSIDE) & follows
    stops = np.flatnonzero(~goes)
    closes = stops[np.searchsorted(stops, opens + 1)] - 1
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    base = points[begin[row[opens]]]
    return row[opens], points[start[opens]] - base, points[end[closes]] - base


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", field: Field | None = None) -> DataFrame:
    """The secrets of every whole text: (key, n_assign, n_access, n_hex, base, spans).

    `base` has the patterns' matches as (kind, start, end) in code points, end exclusive, by start, then kind; `spans` has these and what
    the field adds, of kind `crf`, where it touches no match. A null text counts as an empty one; null keys and repeated rows are
    returned like others; other columns are not read. Without a field, one is learnt from these texts; where none has a match,
    nothing can be learnt and nothing is added.
    """
    kind = df.schema[key].dataType.simpleString()
    docs = df.select(df[key].alias("key"), F.coalesce(df[text], F.lit("")).alias("text"))
    field = field or learnt(docs.select("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, begin in slices(batch, "text"):
                own = [matches(t) for t in rows.column("text").to_pylist()]
                base = [[{"kind": KINDS[n], "start": a, "end": b} for a, n, b, *_ in found] for found in own]
                spans = [list(x) for x in base]
                for r, a, b in zip(*(x.tolist() for x in _added(field, data, begin)), strict=True) if field else ():
                    if not any(a < m[2] and m[0] < b for m in own[r]):
                        spans[r].append({"kind": ADDED, "start": a, "end": b})
                order = {k: n for n, k in enumerate((*KINDS, ADDED))}
                spans = [sorted(x, key=lambda s: (s["start"], order[s["kind"]])) for x in spans]
                counts = [pa.array([sum(m[1] == n for m in found) for found in own], pa.int64()) for n in range(len(KINDS))]
                shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([rows.column("key"), *counts, pa.array(base, shape), pa.array(spans, shape)], ["key", *[f"n_{k}" for k in KINDS], "base", "spans"])

    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return docs.mapInArrow(run, f"key {kind}, {counts}, base {SPANS}, spans {SPANS}").withColumnRenamed("key", key)


def written(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
