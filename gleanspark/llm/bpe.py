"""BPE encoding and decoding with the vocabulary of a public tokenizer file.

Encoding is exact and linear: Aho-Corasick finds the longest token at every place of a word, and a backtracking walk
takes a token only where a pair table says that the merge rules would leave it beside the token before. Decoding
slices one byte buffer by a table of offsets.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from unicodedata import category, normalize

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gleanspark.llm.common import slices

_SPACES = re.compile("[\t-\r \x85\xa0  -     　]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")  # white space to str.split, but not to the tokenizer
_PLAIN = re.compile(r"([^\W\d_]+)([.,;:!?*%&#$|]*)")  # letters, then signs of which the tokenizer makes one word
_PIECES, _WORDS, _PAIRS, _CACHED_CHARS = 100_000, 400_000, 400_000, 48
_loaded: dict[tuple[int, int], Vocabulary] = {}


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256)]


class _Recent(dict):
    """What make() gives for a text, kept for the texts met lately: a full table becomes the older one, whose hits move back."""

    def __init__(self, make, most: int) -> None:
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, text: str) -> bytes:
        found = self.older.get(text)
        if found is None:
            found = self.make(text)
            if len(text) > _CACHED_CHARS:
                return found
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[text] = found
        return found


class Vocabulary:
    """One tokenizer file: word-level BPE over byte characters with an end-of-word mark."""

    def __init__(self, content: str, pieces: int = _PIECES) -> None:
        file = json.loads(content)
        vocabulary, mark = file["model"]["vocab"], file["model"]["end_of_word_suffix"]
        split = file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = regex.compile(split).finditer
        self.bytes = byte_characters()
        # a character with the end-of-word mark is one symbol of its own, so that a word is a plain string of symbols
        symbols = {c: c for c in self.bytes} | {c + mark: chr(0x1000 + ord(c)) for c in self.bytes}
        self.rank = {vocabulary[k]: n for n, k in enumerate(symbols)}  # single symbols rank before every merge
        spelled = {vocabulary[k]: s for k, s in symbols.items()}
        self.parts = {i: (i, i) for i in spelled}
        self.merged: dict[tuple[int, int], int] = {}
        for left, right in file["model"]["merges"]:
            a, b, ab = vocabulary[left], vocabulary[right], vocabulary[left + right]
            self.merged[a, b] = ab
            if ab not in spelled:
                self.rank[ab], self.parts[ab], spelled[ab] = len(self.rank), (a, b), spelled[a] + spelled[b]
        self.length = {i: len(s) for i, s in spelled.items()}
        self.pairs: dict[int, bool] = {}
        self.words = ahocorasick.Automaton()
        for i, s in spelled.items():
            self.words.add_word(s, i)
        self.words.make_automaton()
        self.shorter: dict[int, int | None] = {}
        self.spelled = spelled
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        names = {i: k for k, i in vocabulary.items()} | {i: k for k, i in self.special.items()}
        texts = [names.get(i, "").encode() + b" " for i in range(max(names) + 1)]  # tokens are shown with a space between
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        self.buffer = np.frombuffer(b"".join(texts), np.uint8)
        self.code = {i: int(i).to_bytes(4, "little") for i in spelled}
        self.known_words, self.pieces = _Recent(self.encode_word, _WORDS), _Recent(self.encode_piece, pieces)

    def compatible(self, first: int, second: int) -> bool:
        """Whether the merge rules leave these two tokens side by side; kept in the pair table."""
        known = self.pairs.get(first << 32 | second)
        if known is None:
            if len(self.pairs) >= _PAIRS:
                self.pairs.clear()
            known = self.pairs[first << 32 | second] = self._compatible(first, second)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        # undo the later of the two merges, again and again: a rule that joins the facing parts earlier breaks the pair
        rank, parts, limit = self.rank, self.parts, float("inf")
        while True:
            joined = self.merged.get((a, b))
            if joined is not None and rank[joined] < limit:
                return False
            if rank[a] > rank[b]:
                limit, a_new = rank[a], parts[a][1]
                if a_new == a:
                    limit, b_new = rank[b] + 1, parts[b][0]
                    if b_new == b:
                        return True
                    b = b_new
                else:
                    a = a_new
            else:
                limit, b_new = rank[b] + 1, parts[b][0]
                if b_new == b:
                    limit, a_new = rank[a], parts[a][1]
                    if a_new == a:
                        return True
                    a = a_new
                else:
                    b = b_new

    def _shorter(self, token: int) -> int | None:
        """The longest token that begins this one and is shorter."""
        if token not in self.shorter:
            text = self.spelled[token]
            self.shorter[token] = next((self.words.get(text[:n]) for n in range(len(text) - 1, 0, -1) if text[:n] in self.words), None)
        return self.shorter[token]

    def encode_word(self, word: str) -> bytes:
        """Ids of one word, given in lower case."""
        shown = word if word.isascii() and word.isprintable() else "".join(map(self.bytes.__getitem__, word.encode()))
        text = shown[:-1] + chr(0x1000 + ord(shown[-1]))
        code, known = self.code, self.pairs
        taken = [token for _, token in self.words.iter_long(text)]
        # mostly each longest match fits the one before
        for n in range(1, len(taken)):
            fits = known.get(taken[n - 1] << 32 | taken[n])
            if not (self.compatible(taken[n - 1], taken[n]) if fits is None else fits):
                taken = self._backtrack(text, taken[:n], taken[n])
                break
        return b"".join([code[i] for i in taken])

    def _backtrack(self, text: str, taken: list[int], token: int) -> list[int]:
        """The walk over all of text, from tokens taken so far and the longest match that comes next."""
        length, known, shorter, n = self.length, self.pairs, self.shorter, len(text)
        at, open_at = sum([length[i] for i in taken]), bytearray(b"\1") * (n + 1)
        longest: dict[int, int] = {}
        while at < n:
            end = at + length[token]
            fits = open_at[end]
            if fits and taken:
                fits = known.get(taken[-1] << 32 | token)
                if fits is None:
                    fits = self.compatible(taken[-1], token)
            if fits:
                taken.append(token)
                at = end
                if at < n:
                    token = longest.get(at)
                    if token is None:
                        _, token = next(self.words.iter_long(text, at))
                        longest[at] = token
                continue
            less = shorter[token] if token in shorter else self._shorter(token)
            if less is not None:
                token = less
            else:
                open_at[at] = 0  # nothing fits from here: give back the token before and go on with a shorter one
                token = taken.pop()
                at -= length[token]
        return taken

    def encode_piece(self, piece: str) -> bytes:
        """Ids of a text without white space."""
        text = piece.lower() if piece.isascii() else normalize("NFC", piece).replace("Σ", "σ").lower()  # as if lowered one character at a time
        plain = _PLAIN.fullmatch(text)
        if plain and plain[1].isalpha():
            return self.known_words[plain[1]] + (self.known_words[plain[2]] if plain[2] else b"")
        shown = text
        if not text.isascii():  # the tokenizer knows no characters newer than those of unicodedata: they count as signs
            shown = "".join("\ue000" if c > "\x7f" and category(c) == "Cn" else c for c in text)
        return b"".join([self.known_words[text[m.start() : m.end()]] for m in self.find(shown)])

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit numbers."""
        if "<|" in text and self.cut.search(text):
            return b"".join(np.array([self.special[x]], "<u4").tobytes() if x in self.special else self.encode(x) for x in self.cut.split(text))
        pieces = _SPACES.split(text) if _SEPARATORS.search(text) else text.split()
        return b"".join(map(self.pieces.__getitem__, filter(None, pieces)))

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 text of ids: their tokens with a space between."""
        out = []
        for first in range(0, len(ids), 1 << 17):
            part = ids[first : first + (1 << 17)].astype(np.int64)
            begin = self.offsets[part]
            size = self.offsets[part + 1] - begin
            place = np.cumsum(size)
            out.append(self.buffer[np.repeat(begin - place + size, size) + np.arange(place[-1])].tobytes())
        return b"".join(out)[:-1]


def loaded(content: str, pieces: int = _PIECES) -> Vocabulary:
    """The vocabulary of a file's content, built once for each Python worker; it keeps the ids of about this many pieces, twice at most."""
    key = hash(content), pieces
    if key not in _loaded:
        _loaded[key] = Vocabulary(content, pieces)
    return _loaded[key]


def read_file(df: DataFrame, path: str):
    """The tokenizer file (a fixed size of a few MB) as a broadcast text; executors need no file of their own."""
    with open(path, encoding="utf-8") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token ids of every whole text: (key, n_tokens, ids), ids as little-endian unsigned 32-bit numbers.

    path: a tokenizer file of the tokenizers library with word-level BPE and an end-of-word mark. Special tokens in a text
    are found as that library finds them. A null or empty text has no tokens; repeated rows are encoded each; other columns are
    not read. One map over the rows: nothing is shuffled, and a word is encoded once for each worker while it is cached.
    """
    file, kind = read_file(df, path), df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = loaded(file.value)
        for batch in batches:
            for rows, data, begin in slices(batch, "text"):
                raw = data.tobytes()
                ids = [vocabulary.encode(raw[a:b].decode()) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["key", "n_tokens", "ids"])

    found = df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(run, f"key {kind}, n_tokens long, ids binary")
    return found.withColumnRenamed("key", key)


def decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """The text of every row's ids (as encode() gives them): (key, n_tokens, ids, decoded). Null or empty ids give an empty text."""
    file, kind = read_file(df, path), df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = loaded(file.value)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                rows = batch.slice(first, 256)
                numbers = [np.frombuffer(x or b"", "<u4") for x in rows.column(1).to_pylist()]
                texts = pa.array([vocabulary.decode(x).decode() for x in numbers], pa.string())
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(x) for x in numbers], pa.int64()), rows.column(1), texts], ["key", "n_tokens", "ids", "decoded"])

    found = df.select(df[key].alias("key"), df[ids].alias("ids")).mapInArrow(run, f"key {kind}, n_tokens long, ids binary, decoded string")
    return found.withColumnRenamed("key", key)

