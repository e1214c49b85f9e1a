"""Language of texts by words first and character n-grams where a word is not known.

A known word speaks for each language by the logarithm of its frequency there. A word that no language has is split into
n-grams, and the longest length at which any of them is known speaks instead, down to single characters.

All counted words and n-grams stay in Spark tables. The most frequent words are sent to the texts, which are scored where they lie;
the words of a text that were not sent are looked up by a join, and their sums come back to the text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.common import checkpointed, held_out, slices

FOLDS, HELD_OUT = 3, 1
LONGEST = 5
#: Most frequent words that are sent to all tasks; all others are joined.
WORDS = 200_000
#: Joined values are summed as whole numbers of this part of one, so that their order does not matter.
_PARTS = 1 << 32
#: Texts of more words than this weigh as if they had so many, so that scores tell how sure a text is.
WEIGHT = 24
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
_CACHED = 100_000


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    return _LETTERS.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    """The n-grams of a word with its two edges; single characters without."""
    shown = word if n == 1 else f"<{word}>"
    return [shown[k : k + n] for k in range(len(shown) - n + 1)]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n): summed within parts of a partition."""
    counts: dict[str, Counter] = {}
    size = 0

    def out() -> pa.RecordBatch:
        rows = [(lang, word, n) for lang, c in counts.items() for word, n in c.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

    for batch in batches:
        langs = batch.column("lang").to_pylist()
        at = 0
        for rows, data, begin in slices(batch, "text"):
            raw = data.tobytes()
            for n, (a, b) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)):
                counts.setdefault(langs[at + n], Counter()).update(words_of(raw[a:b].decode()))
            at += rows.num_rows
            size = sum(map(len, counts.values()))
            if size > 1_000_000:
                yield out()
                counts.clear()
    if counts:
        yield out()


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of rows (lang, word, n), summed within a batch."""
    for batch in batches:
        counts: dict[str, dict[str, int]] = {}
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = counts.setdefault(lang, {})
            for k in range(1, LONGEST + 1):
                for gram in grams_of(word, k):
                    own[gram] = own.get(gram, 0) + n
        langs = [x for x, own in counts.items() for _ in own]
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([g for own in counts.values() for g in own], pa.string()), pa.array([n for own in counts.values() for n in own.values()], pa.int64())], ["lang", "gram", "n"])


def _most_frequent(table: DataFrame, most: int) -> DataFrame:
    """The rows of the largest n, at most so many: a histogram of n by steps gives the least n that is kept."""
    step = F.floor(F.log2("n") * 16).cast("int")
    total, least = 0, None
    for r in table.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # a few hundred steps
        total += r["count"]
        if total > most:
            break
        least = r.step
    return table.where(F.lit(False) if least is None else step >= least)


def _by_entry(rows: DataFrame, entry: str, names: list[str]) -> DataFrame:
    """(entry, c, n) of rows (lang, entry, n): its counts in every language and their sum."""
    counts = F.array(*[F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)) for x in names])
    return rows.groupBy(entry).agg(counts.alias("c"), F.sum("n").alias("n"))


def _rows(table: DataFrame, entry: str, names: list[str]) -> DataFrame:
    """Rows (lang, entry, n) of _by_entry()."""
    rows = table.select(entry, F.posexplode("c").alias("at", "n")).where("n > 0")
    return rows.select(F.get(F.array(*map(F.lit, names)), F.col("at")).alias("lang"), entry, "n")


def _sizes(table: DataFrame, names: list[str]) -> tuple[np.ndarray, int]:
    """Of _by_entry(), the sum of every language and the number of entries."""
    found = table.agg(F.count("*"), *[F.sum(F.col("c")[k]) for k in range(len(names))]).first()
    return np.array([x or 0 for x in found[1:]], float), found[0]


def _values(sizes: tuple[np.ndarray, int]):
    """The values of a row's counts c, as Model has them."""
    least = (sizes[0] + 1 + 0.5 * max(sizes[1], 1)).tolist()
    logs = F.zip_with("c", F.array(*map(F.lit, least)), lambda c, d: F.log((c + 0.5) / d))
    mean = F.aggregate("logs", F.lit(0.0), lambda x, y: x + y) / len(least)
    return lambda table: table.withColumn("logs", logs).withColumn("mean", mean).withColumn("v", F.transform("logs", lambda x: x - F.col("mean"))).drop("logs", "mean", "c", "n")


class Model:
    """Log frequencies of words and n-grams in every language, less their mean over the languages."""

    def __init__(self, langs: list[str], shares: np.ndarray, words: pa.Table, grams: pa.Table, sizes: tuple[np.ndarray, int] | None = None) -> None:
        """words, grams: rows (lang, text, n); sizes: sum of every language and number of all words, where words are a part of them."""
        self.langs, self.prior = langs, np.log(shares)
        self.words, self.word_rows = self._table(words, sizes)
        self.grams, self.gram_rows = self._table(grams)
        self.unseen: dict[str, list[int]] = {}

    def _table(self, rows: pa.Table, sizes: tuple[np.ndarray, int] | None = None) -> tuple[dict[str, int], np.ndarray]:
        place, names = pd.factorize(rows.column(1).to_pandas())
        lang = pd.Categorical(rows.column(0).to_pandas(), categories=self.langs).codes
        counts = np.zeros((len(names), len(self.langs)))
        np.add.at(counts, (place, lang), rows.column(2).to_numpy())
        totals, entries = (counts.sum(axis=0), len(names)) if sizes is None else sizes
        values = np.log((counts + 0.5) / (totals + 1 + 0.5 * max(entries, 1)))
        return {x: k for k, x in enumerate(names)}, values - values.mean(axis=1, keepdims=True)

    def backoff(self, word: str) -> list[int]:
        """Rows of the word's longest n-grams of which any is known; none where no character is."""
        found = self.unseen.get(word)
        if found is None:
            for k in range(LONGEST, 0, -1):
                found = [x for x in map(self.grams.get, grams_of(word, k)) if x is not None]
                if found:
                    break
            if len(self.unseen) >= _CACHED:
                self.unseen.clear()
            self.unseen[word] = found
        return found

    def known_words(self, text: str) -> tuple[int, np.ndarray | None, list[str]]:
        """Number of words, the sum of those that the model has, and the others; no sum where there is no letter."""
        words = words_of(text)
        if not self.langs or not any(map(str.isalpha, words)):
            return len(words), None, []
        known = list(map(self.words.get, words))
        return len(words), self.word_rows[[x for x in known if x is not None]].sum(axis=0), [w for w, x in zip(words, known, strict=True) if x is None]

    def told(self, n_words: int, value: np.ndarray) -> tuple[str, float]:
        value = value * min(1.0, WEIGHT / n_words) + self.prior
        odds = np.exp(value - value.max())
        best = int(np.argmax(value))  # of equals, the first by name
        return self.langs[best], float(odds[best] / odds.sum())

    def predict(self, text: str) -> tuple[str, float]:
        n_words, value, others = self.known_words(text)
        if value is None:
            return UNKNOWN, 0.0
        others = [x for x in map(self.backoff, others) if x]
        if others:
            sizes = np.array([len(x) for x in others])
            sums = np.add.reduceat(self.gram_rows[[k for x in others for k in x]], np.cumsum(sizes) - sizes)
            value = value + (sums / sizes[:, None]).sum(axis=0)
        return self.told(n_words, value)


def fit(df: DataFrame) -> tuple[Model, DataFrame, DataFrame, tuple, tuple] | None:
    """From all rows (text, lang): a model of the most frequent words, the tables of all words and of all n-grams, and their sizes."""
    langs = {r.lang: r["count"] for r in df.groupBy("lang").count().collect()}
    if not langs:
        return None
    names = sorted(langs)
    shares = np.array([langs[x] for x in names], float) / sum(langs.values())
    words = checkpointed(_by_entry(df.select("text", "lang").mapInArrow(_word_counts, "lang string, word string, n long"), "word", names))
    grams = _rows(words, "word", names).mapInArrow(_grams, "lang string, gram string, n long")
    grams = checkpointed(_by_entry(grams, "gram", names))
    sizes = _sizes(words, names)
    sent = _rows(_most_frequent(words, WORDS), "word", names).toArrow()
    return Model(names, shares, sent, sent.slice(0, 0), sizes), words, grams, sizes, _sizes(grams, names)


def _backoff(unseen: DataFrame, grams: DataFrame, langs: int) -> DataFrame:
    """(word, v) of words that no language has: the mean of the longest n-grams of which any is known.

    Nearly every word has one of the greatest length; shorter ones are looked up for the rest only.
    """

    def found(words: DataFrame, lengths: range) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(w, k, g) for w in batch.column(0).to_pylist() for k in lengths for g in grams_of(w, k)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string()))], ["word", "k", "gram"])

        asked = words.mapInArrow(run, "word string, k int, gram string").join(grams, "gram")
        means = asked.groupBy("word", "k").agg(*[F.sum(F.round(F.col("v")[n] * _PARTS).cast("long")).alias(f"s{n}") for n in range(langs)], F.count("*").alias("m"))
        means = means.select("word", "k", F.array(*[F.col(f"s{n}") / _PARTS / F.col("m") for n in range(langs)]).alias("v"))
        return means.groupBy("word").agg(F.max_by("v", "k").alias("v"))

    longest = checkpointed(found(unseen, range(LONGEST, LONGEST + 1)))
    return longest.unionByName(found(unseen.join(longest, "word", "left_anti"), range(1, LONGEST)))


def _identified(df: DataFrame, key: str, text: str, lang: str, keep: list[str]) -> DataFrame:
    """The columns of keep as c0, c1, ..., with lang_pred and score, for every row."""
    names = [f"c{n}" for n in range(len(keep))]
    learnt = df.select(df[key].alias("key"), df[text].alias("text"), df[lang].cast("string").alias("lang"))
    fitted = fit(learnt.where("lang is not null and text is not null").where(~held_out("key", FOLDS, HELD_OUT)))
    docs = df.select(*[df[c].alias(n) for n, c in zip(names, keep, strict=True)], df[text].alias("text"))
    if fitted is None:
        return docs.select(*names, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    model, words, grams, word_sizes, gram_sizes = fitted
    sent, langs = df.sparkSession.sparkContext.broadcast(model), len(model.langs)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, begin in slices(batch, "text"):
                raw = data.tobytes()
                found = [sent.value.known_words(raw[a:b].decode()) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
                others = [Counter(x) for _, _, x in found]
                more = [
                    pa.array([n for n, _, _ in found], pa.int64()),
                    pa.array([None if v is None else v.tolist() for _, v, _ in found], pa.list_(pa.float64())),
                    pa.array([list(x.keys()) for x in others], pa.list_(pa.string())),
                    pa.array([list(x.values()) for x in others], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(names)], *more], [*names, "n_words", "value", "others", "times"])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, value, more = (batch.column(c).to_pylist() for c in ("n_words", "value", "more"))
            found = [(UNKNOWN, 0.0) if v is None else sent.value.told(n, np.array(v) + (0.0 if x is None else np.array(x))) for n, v, x in zip(n_words, value, more, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], [*names, "lang_pred", "score"])

    kinds = "".join(f"{n} {df.schema[c].dataType.simpleString()}, " for n, c in zip(names, keep, strict=True))
    scanned = docs.mapInArrow(scan, kinds + "n_words long, value array<double>, others array<string>, times array<long>")
    scanned = checkpointed(scanned.withColumn("id", F.monotonically_increasing_id()))  # written once, so ids stay
    others = scanned.select("id", F.explode(F.arrays_zip("others", "times")).alias("o")).select("id", F.col("o.others").alias("word"), F.col("o.times").alias("times"))
    asked = others.select("word").distinct()
    seen = _values(word_sizes)(words)
    unseen = checkpointed(asked.join(words, "word", "left_anti"))
    values = seen.unionByName(_backoff(unseen, _values(gram_sizes)(grams), langs))
    sums = others.join(values, "word").groupBy("id").agg(*[F.sum(F.col("times") * F.round(F.col("v")[n] * _PARTS).cast("long")).alias(f"s{n}") for n in range(langs)])
    sums = sums.select("id", F.array(*[F.col(f"s{n}") / _PARTS for n in range(langs)]).alias("more"))
    return scanned.drop("others", "times").join(sums, "id", "left").select(*names, "n_words", "value", "more").mapInArrow(tell, kinds + "lang_pred string, score double")


#: Least score of a text whose language counts as known.
SURE = 0.4


def known(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sure: float = SURE) -> DataFrame:
    """The rows whose text has a language by identify() and a score of this at least, with all their columns."""
    found = _identified(df, key, text, lang, df.columns)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= sure)).drop("lang_pred", "score").toDF(*df.columns)


def identify(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The language of every whole text: (key, held_out, lang_pred, score); score is the chance of lang_pred, 0 to 1.

    Learns from the text and lang of all rows that are not held out (crc32 of the key as text modulo 3 is 1) and have a lang. A text
    without a letter, a null or empty one, and any text where nothing was learnt is 'und' with score 0. Repeated rows are scored each;
    other columns are not read.
    """
    scored = _identified(df, key, text, lang, [key]).withColumnRenamed("c0", "key")
    return scored.select("key", held_out("key", FOLDS, HELD_OUT).alias("held_out"), "lang_pred", "score").withColumnRenamed("key", key)
