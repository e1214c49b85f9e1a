"""Quality scores from document statistics.

Random Fourier features of a text's statistics approximate a Gaussian kernel; each partition sums the normal equations of its
labelled rows, a ridge fit of their total gives raw scores, and an isotonic step makes them shares of good documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.common import checkpointed, held_out, lowered, prefix_hashes, slices, span_hashes, words

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
FEATURES, WIDTH, RIDGE, SEED = 384, 4.0, 1e-4, 20
#: Steps of the raw score by which the isotonic step counts labels.
STEPS, LOW, HIGH = 2000, -0.5, 1.5
NAMES = (
    "log_bytes log_words word_bytes long_words lower upper digit space line mark exclaim sign wide upper_words sign_ends bare_words "
    "distinct repeats top_word pairs line_bytes distinct_lines short_lines pipes first_upper"
).split()
_MARKS = np.isin(np.arange(256), np.frombuffer(b".,;:'\"-?()", np.uint8))
_SIGNS = np.isin(np.arange(256), np.frombuffer(b"#$%&*+/<=>@[\\]^_`{|}~", np.uint8))
_CLASSES = {
    "lower": (np.arange(256) >= 97) & (np.arange(256) <= 122),
    "upper": (np.arange(256) >= 65) & (np.arange(256) <= 90),
    "digit": (np.arange(256) >= 48) & (np.arange(256) <= 57),
    "space": np.isin(np.arange(256), [9, 32]),
    "line": np.arange(256) == 10,
    "mark": _MARKS,
    "exclaim": np.arange(256) == 33,
    "sign": _SIGNS,
    "wide": np.arange(256) >= 128,
    "pipes": np.arange(256) == 124,
}


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _spread(rows: int, row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By row: how many distinct values, how many that equal the one before, and the most frequent one's count."""
    again = np.zeros(rows)
    if len(row) > 1:
        same = (row[1:] == row[:-1]) & (value[1:] == value[:-1])
        again = np.bincount(row[1:][same], minlength=rows).astype(float)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    first = np.flatnonzero(new)
    most = np.zeros(rows)
    np.maximum.at(most, row[first], np.diff(np.append(first, len(row))))
    return np.bincount(row[first], minlength=rows), again, most


def statistics_of(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A row of NAMES for every text."""
    rows = len(begin) - 1
    size = np.diff(begin).astype(float)
    start, end, row = words(data, begin)
    n = np.bincount(row, minlength=rows).astype(float)

    def by_row(values: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=values, minlength=rows)

    low = lowered(data)
    sums = prefix_hashes(low)
    value = span_hashes(sums, start, end)
    out: dict[str, np.ndarray] = {"log_bytes": np.log1p(size), "log_words": np.log1p(n)}
    counts = {}
    for name, table in _CLASSES.items():
        total = np.concatenate([[0], np.cumsum(table[data])])
        counts[name] = total
        out[name] = _ratio(total[begin[1:]] - total[begin[:-1]], size)
    length = (end - start).astype(float)
    letters = sum(counts[c][end] - counts[c][start] for c in ("lower", "upper", "wide"))
    out["word_bytes"] = _ratio(by_row(length), n)
    out["long_words"] = _ratio(by_row(length > 20), n)
    out["upper_words"] = _ratio(by_row((counts["lower"][end] == counts["lower"][start]) & (counts["upper"][end] - counts["upper"][start] > 1)), n)
    last = data[end - 1] if len(end) else data[:0]
    out["sign_ends"] = _ratio(by_row(_SIGNS[last] | (last == 33)), n)
    out["bare_words"] = _ratio(by_row(letters == 0), n)
    out["first_upper"] = _ratio(by_row(_CLASSES["upper"][data[start]]) if len(start) else np.zeros(rows), n)
    distinct, again, most = _spread(rows, row, value)
    out["distinct"], out["repeats"], out["top_word"] = _ratio(distinct, n), _ratio(again, n), _ratio(most, n)
    joint = value[:-1] * np.uint64(0x9E3779B97F4A7C15) + value[1:]
    within = row[1:] == row[:-1]
    pairs, _, _ = _spread(rows, row[:-1][within], joint[within])
    out["pairs"] = _ratio(pairs, n - 1)
    # lines: runs without a line end
    solid = np.concatenate([data != 10, [False]])
    edge = np.zeros(len(data) + 1, bool)
    edge[begin] = True
    opens = solid.copy()
    opens[1:] &= ~solid[:-1] | edge[1:]
    line_start = np.flatnonzero(opens)
    line_row = np.searchsorted(begin, line_start, "right") - 1
    until = np.flatnonzero(np.concatenate([data == 10, [True]]))
    line_end = np.minimum(until[np.searchsorted(until, line_start)], begin[line_row + 1])
    lines = np.bincount(line_row, minlength=rows).astype(float)
    unique_lines, _, _ = _spread(rows, line_row, span_hashes(sums, line_start, line_end))
    out["line_bytes"] = np.log1p(_ratio(size, lines))
    out["distinct_lines"] = _ratio(unique_lines, lines)
    out["short_lines"] = _ratio(np.bincount(line_row, weights=(line_end - line_start) < 20, minlength=rows), lines)
    return np.stack([out[x] for x in NAMES], axis=1).astype(np.float64)


def document_statistics(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, stats): the statistics of every whole text, those of an empty one for null."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, begin in slices(batch, "text"):
                stats = statistics_of(data, begin)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, stats.size + 1, len(NAMES)), pa.int32()), pa.array(stats.ravel()))], ["key", "stats"])

    return df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(run, f"key {kind}, stats array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


class Model:
    """What a fit gives: scale of the statistics, weights of the random features, and the isotonic steps."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray) -> None:
        random = np.random.default_rng(SEED)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.turn = random.normal(size=(len(mean), FEATURES)) / WIDTH
        self.phase = random.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.steps = np.linspace(0, 1, STEPS)

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.deviation, -8, 8)
        return np.hstack([np.cos(x @ self.turn + self.phase) * np.sqrt(2 / FEATURES), np.ones((len(x), 1))])

    def step(self, stats: np.ndarray) -> np.ndarray:
        raw = self.features(stats) @ self.weights
        return np.clip(((raw - LOW) / (HIGH - LOW) * STEPS).astype(np.int64), 0, STEPS - 1)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return self.steps[self.step(stats)]


def isotonic(count: np.ndarray, good: np.ndarray) -> np.ndarray:
    """The non-decreasing share of good rows by step that fits best; empty steps lie between their neighbours."""
    pools: list[list[float]] = []  # share, rows, first step
    for step in np.flatnonzero(count):
        pools.append([good[step] / count[step], count[step], step])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            share, n, _ = pools.pop()
            pools[-1][0] = (pools[-1][0] * pools[-1][1] + share * n) / (pools[-1][1] + n)
            pools[-1][1] += n
    if not pools:
        return np.full(len(count), 0.5)
    filled = np.flatnonzero(count)
    at = np.searchsorted([p[2] for p in pools], filled, "right") - 1
    return np.interp(np.arange(len(count)), filled, np.array([p[0] for p in pools])[at])


def fit(stats: DataFrame, labelled: DataFrame) -> Model:
    """A model of rows (stats, label) of 0 and 1, scaled by the statistics of all rows of stats.

    Without labelled rows every score is a half.
    """
    moments = stats.select(F.posexplode("stats").alias("at", "x")).groupBy("at").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("deviation")).collect()
    mean, deviation = np.zeros(len(NAMES)), np.ones(len(NAMES))
    for r in moments:
        mean[r["at"]], deviation[r["at"]] = r.mean, r.deviation
    model = Model(mean, deviation)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                rows = batch.slice(at, 4096)
                z, y = model.features(_matrix(rows.column(0))), np.asarray(rows.column(1), np.float64)
                total += z.T @ np.hstack([z, y[:, None]])
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(FEATURES + 1), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["row", "sums"])

    def added(key: tuple, table: pa.Table) -> pa.Table:
        total = _matrix(table.column("sums").combine_chunks()).sum(axis=0)
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([total], pa.list_(pa.float64()))], ["row", "sums"])

    kind = "row int, sums array<double>"
    labelled = labelled.select("stats", "label")
    rows = labelled.mapInArrow(sums, kind).groupBy("row").applyInArrow(added, kind).collect()  # the features squared, whatever the rows
    if rows:
        equations = np.zeros((FEATURES + 1, FEATURES + 2))
        for r in rows:
            equations[r.row] = r.sums
        n = equations[-1, -2]
        model.weights = np.linalg.solve(equations[:, :-1] + RIDGE * n * np.eye(FEATURES + 1) / FEATURES, equations[:, -1])

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = model.step(_matrix(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(step), batch.column(1)], ["step", "label"])

    count, good = np.zeros(STEPS), np.zeros(STEPS)
    for r in labelled.mapInArrow(steps, "step long, label int").groupBy("step").agg(F.count("*").alias("n"), F.sum("label").alias("good")).collect():
        count[r.step], good[r.step] = r.n, r.good
    model.steps = isotonic(count, good)
    return model


def fitted(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> tuple[Model, DataFrame]:
    """A model of the labelled rows that are not held out, and the statistics (key, stats) of all rows."""
    stats = checkpointed(document_statistics(df, key, text))
    known = labels.select(labels[key].alias("key"), labels[label].cast("int").alias("label")).where("label in (0, 1)")
    known = stats.join(known, "key").where(~held_out("key", FOLDS, HELD_OUT)).select("stats", "label")
    return fit(stats, checkpointed(known)), stats


def good(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The rows whose text classify() predicts to be of quality, with all their columns; each is judged where it lies."""
    model, _ = fitted(df, labels, key, text, label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, begin in slices(batch, text):
                yield rows.filter(pa.array(model.score(statistics_of(data, begin)) >= THRESHOLD))

    return df.mapInArrow(run, df.schema)


def classify(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Quality of every whole text: (key, held_out, score, predicted); score is the share of good documents among its like, 0 to 1.

    Learns from the labelled rows (labels: key, label 0 or 1) that are not held out: crc32 of the key as text modulo 5 is not 0.
    Null labels are left out; a null text is scored as an empty one; repeated rows are scored each; other columns are not read.
    predicted is 1 from a score of 0.3. Texts are read once; their statistics, 25 numbers each, are kept for fit and scores.
    """
    kind = df.schema[key].dataType.simpleString()
    model, stats = fitted(df, labels, key, text, label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                rows = batch.slice(at, 4096)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(model.score(_matrix(rows.column(1))))], ["key", "score"])

    scored = stats.mapInArrow(run, f"key {kind}, score double")
    done = scored.select("key", held_out("key", FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
    return done.withColumnRenamed("key", key)
