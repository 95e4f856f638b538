"""Byte-level BPE: a backtracking encoder and an offset-table decoder.

The encoder never replays merges.  An Aho-Corasick automaton over the
vocabulary gives the longest token at every byte; tokens are laid from left to
right, each one checked against a table of token pairs that can stand side by
side in a BPE result, with backtracking to shorter tokens where none fits.
Every byte position is tried once at most, so the time is linear, and the
result is the one that the merge list defines.

Texts are cut at single spaces first; pieces between spaces, with the space
before them, never share a token with their neighbours, and most of them are
known already, so the automaton runs only for pieces that a worker has not met
lately.

Defined results: a null text encodes as the empty text; an empty text gives no
ids; repeated rows each give their row; all other columns pass through
unchanged, and a column that has the name of an output column is replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from linkmap.llm.common import tune

#: Pieces and words that a worker remembers; beyond it the older half is forgotten.
CACHE = 400_000
#: Longer ones are not remembered, so what a worker remembers has a bound in bytes.
LONG = 64
PAIRS = 1_000_000

#: Fixed: how byte-level BPE files cut a text before merging.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: itself if printable, else the next free one from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Recent(dict):
    """A memo of two generations with a bounded number of entries, none of them for a key longer than LONG."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit // 2, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if not isinstance(key, int) and len(key) > LONG:
            return found
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class BacktrackingBPE:
    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        raw = {t: bytes(letters[c] for c in t) for t in vocab}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for t, i in vocab.items():
            self.bytes[i] = raw[t]
        # a token's rank is the place of the merge that makes it; single bytes come before all merges
        self.rank = [-1] * size
        self.left, self.right = list(range(size)), list(range(size))
        self.merged: dict[int, int] = {}
        for place, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            i, x, y = vocab[a + b], vocab[a], vocab[b]
            self.merged[x << 32 | y] = place
            if self.rank[i] < 0:
                self.rank[i], self.left[i], self.right[i] = place, x, y
        self.id_of = {b: i for i, b in enumerate(self.bytes) if b}
        self.size = [len(b) for b in self.bytes]
        self.automaton = ahocorasick.Automaton()
        for b, i in self.id_of.items():
            self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.fits = _Recent(self._fits, PAIRS)
        self.shorter = _Recent(self._shorter, 2 * size + 2)
        self.word = _Recent(self._word, CACHE)
        self.piece = _Recent(lambda p: self._cut(" " + p), CACHE)
        self.find = regex.compile(WORD).findall
        self.wide = regex.compile(r"\p{White_Space} ").search
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.offsets = np.zeros(size + 1, np.int64)
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        np.cumsum([len(b) for b in self.bytes], out=self.offsets[1:])
        self.blob = np.frombuffer(b"".join(self.bytes), np.uint8)

    def _fits(self, pair: int) -> bool:
        """Whether two tokens stay apart when their bytes are encoded together.

        Undo the later of the two tokens' merges step by step; they don't fit
        if at some moment the tokens that touch would have merged before
        what is still undone was made.
        """
        a, b = pair >> 32, pair & 0xFFFFFFFF
        rank, merged = self.rank, self.merged
        bound, strict = 1 << 40, True
        while True:
            place = merged.get(a << 32 | b)
            if place is not None and (place < bound or not strict and place == bound):
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:  # the left one is later: what merges at its own rank comes from the left first, so it wins ties
                bound, strict, a = ra, True, self.right[a]
            else:
                bound, strict, b = rb, False, self.left[b]

    def _shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        b = self.bytes[token]
        for n in range(len(b) - 1, 0, -1):
            if (i := self.id_of.get(b[:n])) is not None:
                return i
        return -1

    def ids(self, b: bytes) -> list[int]:
        """Encode one word."""
        whole = self.id_of.get(b)
        if whole is not None and self._alone(whole):
            return [whole]
        n, size = len(b), self.size
        longest, reach = [0] * n, [0] * n
        for end, i in self.automaton.iter(b.decode("latin-1")):
            start = end - size[i] + 1
            if size[i] > reach[start]:
                longest[start], reach[start] = i, size[i]
        out: list[int] = []
        dead: set[int] = set()
        at, token, fits, shorter = 0, longest[0], self.fits, self.shorter
        while at < n:
            end = at + size[token]
            if end not in dead and (not out or fits[out[-1] << 32 | token]):
                out.append(token)
                at = end
                if at < n:
                    token = longest[at]
                continue
            less = shorter[token]
            if less >= 0:
                token = less
            else:
                dead.add(at)
                token = out.pop()
                at -= size[token]
        return out

    def _alone(self, token: int) -> bool:
        """Whether a token's own bytes encode as that token: its halves must not have split otherwise."""
        return self.rank[token] < 0 or self.fits_whole[token]

    @property
    def fits_whole(self) -> _Recent:
        if "_whole" not in self.__dict__:
            self._whole = _Recent(self._is_whole, 2 * len(self.bytes) + 2)
        return self._whole

    def _is_whole(self, token: int) -> bool:
        if self.rank[token] < 0:
            return True
        a, b = self.left[token], self.right[token]
        if not (self.fits_whole[a] and self.fits_whole[b]):
            return False
        # the two halves touch only by this very merge, or by one after it
        rank, merged, bound, strict = self.rank, self.merged, self.rank[token], True
        while True:
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                bound, strict, a = min(bound, ra), True, self.right[a]
            else:
                bound, strict, b = min(bound, rb), False, self.left[b]
            place = merged.get(a << 32 | b)
            if place is not None and (place < bound or not strict and place == bound):
                return False

    def _word(self, word: str) -> bytes:
        return np.array(self.ids(word.encode("utf-8")), "<u4").tobytes()

    def _cut(self, text: str) -> bytes:
        return b"".join(map(self.word.__getitem__, self.find(text)))

    def encode(self, text: str) -> bytes:
        """The ids of a text, each as four bytes, least first."""
        if self.at_special is not None and any(s in text for s in self.special):
            return b"".join(self.special[p].to_bytes(4, "little") if p in self.special else self._plain(p) for p in self.at_special.split(text) if p)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if self.wide(text):  # a run of white space may cross a cut
            return self._cut(text)
        pieces = text.split(" ")
        first = pieces[0]
        del pieces[0]
        return (self._cut(first) if first else b"") + b"".join(map(self.piece.__getitem__, pieces))

    def decode(self, ids: bytes) -> str:
        """Gather each token's bytes from the offset table."""
        i = np.frombuffer(ids, "<u4").astype(np.int64)
        if not len(i):
            return ""
        start, n = self.offsets[i], self.offsets[i + 1] - self.offsets[i]
        ends = np.cumsum(n)
        where = np.repeat(start - ends + n, n) + np.arange(ends[-1])
        return self.blob[where].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> BacktrackingBPE:
    return BacktrackingBPE(path)


def _mapped(df: DataFrame, drop: set[str], out: list[T.StructField], make) -> DataFrame:
    kept = [f for f in df.schema.fields if f.name.lower() not in {d.lower() for d in drop}]
    schema = T.StructType(kept + out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = make(b)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(f.name)) for f in kept] + columns, names=[f.name for f in kept + out])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, column: str = "text") -> DataFrame:
    """Add ``ids`` (binary, little-endian unsigned 32-bit) and ``n_tokens``; the text column stays."""
    tune(df.sparkSession)

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        t = tokenizer(path)
        ids = [t.encode(x or "") for x in b.column(b.schema.get_field_index(column)).to_pylist()]
        return [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]

    return _mapped(df, {"ids", "n_tokens"}, [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())], make)


def decode(df: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """Add ``decoded``: the text of the ids; null ids decode as the empty text."""
    tune(df.sparkSession)

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        t = tokenizer(path)
        return [pa.array([t.decode(x or b"") for x in b.column(b.schema.get_field_index(column)).to_pylist()], pa.string())]

    return _mapped(df, {"decoded"}, [T.StructField("decoded", T.StringType())], make)
