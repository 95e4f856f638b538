"""Near-duplicate documents by improved consistent weighted sampling.

A document is the bag of its five-word shingles, weighted by TF-IDF.  The
sampler draws, for each of ``bands * rows`` hash functions, one shingle of a
document such that two documents draw the same one with a probability equal to
their weighted Jaccard similarity.  Documents that agree on all rows of a band
meet in a bucket; what meets is verified with the true similarity.

* IDF is the smoothed kind, ``1 + gain * ln(N / df) / ln(RARE)`` with df taken
  as ``N / RARE`` at least: a rare shingle counts up to half as much again as one
  in all documents, at every size of the corpus.  With plain IDF the shingles
  that a thousand near copies share would weigh so little beside each copy's own
  edits that copies with nine tenths of their shingles in common would fall
  below the threshold.
* Document frequencies are exact, over all documents, and only needed above
  that floor: a pass adds up ``2**DF_BITS`` hashed counters, and a second one
  counts the shingles of those slots that reach the floor.  At most ``2**18``
  shingles can, whatever the corpus, and these are broadcast.
* Equal texts are one text from the start; copies only get their class.
* Each text is paired with its bucket's hub, the member that meets most others
  over all bands.  Where that leaves several classes in a bucket, its members
  are compared exactly, all with all, by products of matrices over the shingles
  that they share; only links that join two classes are written.  Large buckets
  are cut into parts, and all pairs of parts are compared, so a task holds two
  parts and no row stands for a pair that isn't a link.
* Only texts that have a pair, or a bucket that is left open, are shuffled; a
  bitmap of fixed size keeps the others out.
* Links are joined into classes by distributed connected components.

Defined results: a text of fewer than five words is one shingle; a null text
or one without words is like no other; rows that share a doc_id are one
document; a row without doc_id takes no part and its class is null; every row
gives a row; repeated rows have one class; other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkmap.llm.common import materialise, tune
from linkmap.llm.key_filter import has, key_filter, mix
from linkmap.operators.components import connected_components

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 10, 3
IDF_GAIN = 0.5
#: A shingle in fewer than one of so many documents counts as rare.
RARE = 1024
#: Hashed counters that find the shingles above the floor, and how many times their mean load the floor is at least.
DF_BITS, LOADS = 20, 4
#: The share of samples that a pair must have in common to be verified: a pair at the threshold has fewer about once in ten million.
LEAST_SHARED = 0.4
#: Members of a large bucket that are dealt together; a task compares two such parts at a time.
BLOCK = 500
#: Shingles that so many texts of a block share at most are counted pair by pair, the others by products of matrices.
FEW = 24
#: Similarities are sums of weights, which may come out this much too low.
ROUNDING = 1e-12
#: Shingles that are sampled at a time.
CHUNK = 1 << 16

_R = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    base = 0x5851F42D4C957F2D
    inverse = pow(base, -1, 1 << 64)
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    up[0] = down[0] = 1
    for p, b in ((up, base), (down, inverse)):
        have = 1
        while have < n:
            m = min(have, n - have)
            p[have : have + m] = p[:m] * np.uint64(pow(b, have, 1 << 64))
            have += m
    return up, down


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _R)


PIECE = 1 << 18


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word of a text."""
    return word_spans(text)[0]


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash of each word of a text, by prefix sums, and where it begins and ends; long texts go in pieces that end between words."""
    out, spans, at = [], [], 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        if end < len(text):
            a = np.frombuffer(text, np.uint8, end - at, at)
            spaces = np.flatnonzero(_SPACE[a])
            if len(spaces):
                end = at + int(spaces[-1]) + 1
            else:  # a word longer than a piece
                more = np.flatnonzero(_SPACE[np.frombuffer(text, np.uint8, -1, end)])
                end = end + int(more[0]) + 1 if len(more) else len(text)
        a = np.frombuffer(text, np.uint8, end - at, at)
        up, down = _powers(1 << max(18, math.ceil(math.log2(len(a) + 1))))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_letters()[a] * up[: len(a)])])
        gap = np.concatenate([[True], _SPACE[a], [True]])
        start = np.flatnonzero(gap[:-1] & ~gap[1:])
        stop = np.flatnonzero(~gap[:-1] & gap[1:])
        out.append(mix((total[stop] - total[start]) * down[start]))
        spans.append((start + at, stop + at))
        at = end
    none = np.zeros(0, np.int64)
    return np.concatenate([np.zeros(0, np.uint64), *out]), np.concatenate([none, *(x for x, _ in spans)]), np.concatenate([none, *(y for _, y in spans)])


def shingles(text: bytes, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of a text, in order, and how often each occurs."""
    w = word_hashes(text)
    if not len(w):
        return w, np.zeros(0, np.int64)
    n = min(words, len(w))
    h = np.zeros(len(w) - n + 1, np.uint64)
    for k in range(n):
        h = h * _R + w[k : k + len(h)]
    h = np.sort(mix(h))
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[first], np.diff(np.append(first, len(h)))


class Weights:
    """IDF of shingles: a table of those above the floor; all others have the largest weight."""

    def __init__(self, h: np.ndarray, weight: np.ndarray, rare: float):
        order = np.argsort(h)
        self.h, self.weight, self.rare = h[order], weight[order].astype(np.float32), np.float32(rare)
        self.slots = np.zeros(1 << DF_BITS, bool)
        self.slots[self.h >> np.uint64(64 - DF_BITS)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), self.rare, np.float32)
        at = np.flatnonzero(self.slots[h >> np.uint64(64 - DF_BITS)])
        if len(at):
            k = np.minimum(np.searchsorted(self.h, h[at]), len(self.h) - 1)
            hit = self.h[k] == h[at]
            out[at[hit]] = self.weight[k[hit]]
        return out


def idf_table(rows: DataFrame, gain: float = IDF_GAIN, bits: int = DF_BITS) -> Weights:
    """IDF from all rows of ``__text``; texts without words aren't counted as documents."""
    parts = 64
    width = (1 << bits) // parts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << bits, np.uint32), 0
        for b in batches:
            held = [shingles(x or b"")[0] for x in b.column(0).cast(pa.binary()).to_pylist()]
            n += sum(len(x) > 0 for x in held)
            if held:
                slot, times = np.unique(np.concatenate(held) >> np.uint64(64 - bits), return_counts=True)
                total[slot] += times.astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, parts), pa.int32()), pa.array([np.uint32(n).tobytes(), *(total[k * width : (k + 1) * width].tobytes() for k in range(parts))], pa.binary())], names=["part", "counts"])

    def add(key, pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(1 if key[0] < 0 else width, np.int64)
        for x in pdf["counts"]:
            out += np.frombuffer(x, "<u4")
        return pd.DataFrame({"part": [key[0]], "counts": [out.tobytes()]})

    found = {r: np.frombuffer(bytes(c), "<i8") for r, c in rows.select("__text").mapInArrow(count, "part int, counts binary").groupBy("part").applyInPandas(add, "part int, counts binary").collect()}
    n = int(found[-1][0]) if found else 0
    counts = np.concatenate([found.get(k, np.zeros(width, np.int64)) for k in range(parts)])
    floor = max(1.0, n / RARE, LOADS * float(counts.sum()) / (1 << bits))
    open_ = rows.sparkSession.sparkContext.broadcast(counts > floor)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            h, times = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(times)], names=["h", "n"])

        for b in batches:
            for x in b.column(0).cast(pa.binary()).to_pylist():
                h = shingles(x or b"")[0]
                h = h[open_.value[h >> np.uint64(64 - bits)]]
                if len(h):
                    held.append(h)
                    size += len(h)
            if size > 1 << 21:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    # fewer than 2**bits / LOADS rows reach the floor
    top = rows.select("__text").mapInArrow(exact, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > floor).toPandas() if n else pd.DataFrame({"h": [], "n": []})
    weight = lambda df: 1 + gain * np.log(np.maximum(n, 1) / df) / np.log(RARE)
    return Weights(top["h"].to_numpy(np.int64).view(np.uint64), weight(top["n"].to_numpy(np.float64)), float(weight(floor)) if n else 1.0)


@lru_cache(maxsize=1)
def _variates() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantiles of a Gamma(2, 1) variate at 2**16 places: itself, its inverse, its logarithm."""
    p = (np.arange(1 << 16) + 0.5) / (1 << 16)
    x = np.sqrt(2 * p)
    for _ in range(60):  # solve 1 - (1 + x) exp(-x) = p by Newton's method
        f = 1 - (1 + x) * np.exp(-x) - p
        x = np.maximum(1e-9, x - f / (x * np.exp(-x)))
    return x.astype(np.float32), (1 / x).astype(np.float32), np.log(x).astype(np.float32)


def sample(h: np.ndarray, log_weight: np.ndarray, starts: np.ndarray, n_samples: int) -> np.ndarray:
    """The samples (documents x n_samples, 32 bits each) of documents whose shingles begin at starts."""
    gamma, inverse, log_gamma = _variates()
    size = np.diff(np.append(starts, len(h)))
    out = np.empty((len(starts), n_samples), np.uint32)
    for k in range(n_samples):
        e = mix(h + np.uint64((k + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
        i = (e & np.uint64(0xFFFF)).astype(np.int32)
        beta = ((e >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.float32) * np.float32(1 / 65536)
        t = np.floor(log_weight * inverse[i] + beta)
        a = log_gamma[((e >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int32)] - gamma[i] * (t - beta + np.float32(1))
        least = np.minimum.reduceat(a, starts)
        at = np.flatnonzero(a == np.repeat(least, size))
        doc = np.searchsorted(starts, at, "right") - 1
        first = np.concatenate([[True], doc[1:] != doc[:-1]])
        at = at[first]
        out[:, k] = mix(h[at] + t[at].astype(np.int64).view(np.uint64) * _R) >> np.uint64(32)
    return out


SIGNED = "__id long, digest binary, sketch binary"


def signatures(rows: DataFrame, idf: Weights, n_samples: int) -> DataFrame:
    """(__id, digest of the text, samples) of all rows with an id and a word."""
    table = rows.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index("__text")).cast(pa.binary()).to_pylist()
            ids = b.column(b.schema.get_field_index("__id"))
            digests = b.column(b.schema.get_field_index("digest"))
            kept: list[int] = []
            sketches: list[bytes] = []
            held: list[tuple[np.ndarray, np.ndarray]] = []
            size = 0

            def flush():
                starts = np.cumsum([0] + [len(x) for x, _ in held[:-1]])
                h = np.concatenate([x for x, _ in held])
                w = np.log(np.concatenate([n for _, n in held]).astype(np.float32) * table.value(h))
                sketches.extend(x.tobytes() for x in sample(h, w, starts, n_samples))

            for k, t in enumerate(texts):
                s = shingles(t or b"")
                if not len(s[0]) or not ids[k].is_valid:
                    continue
                kept.append(k)
                held.append(s)
                size += len(s[0])
                if size >= CHUNK:
                    flush()
                    held, size = [], 0
            if held:
                flush()
            take = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(take), digests.take(take), pa.array(sketches, pa.binary())], names=["__id", "digest", "sketch"])

    return rows.select("__id", "digest", "__text").mapInArrow(run, SIGNED)


def _banded(reps: DataFrame, bands: int, rows: int) -> DataFrame:
    """(bucket, rep) for each band: a bucket is a hash of the band's number and samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            s = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(b.num_rows, -1).astype(np.uint64)
            out = np.empty((b.num_rows, bands), np.uint64)
            for k in range(bands):
                h = np.full(b.num_rows, k + 1, np.uint64)
                for j in range(rows):
                    h = mix(h * _R + s[:, k * rows + j])
                out[:, k] = h
            yield pa.RecordBatch.from_arrays([pa.array(out.ravel().view(np.int64)), pa.array(np.repeat(np.array(b.column(0)), bands))], names=["bucket", "rep"])

    return reps.select("rep", "sketch").mapInArrow(run, "bucket long, rep long").distinct()


def _alike(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose samples agree often enough to be worth their texts."""
    one = sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("sa"))
    two = sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if not x.num_rows:
                continue
            sa, sb = (np.frombuffer(b"".join(x.column(x.schema.get_field_index(n)).to_pylist()), np.uint32).reshape(x.num_rows, -1) for n in ("sa", "sb"))
            keep = pa.array((sa == sb).mean(1) >= least)
            yield pa.RecordBatch.from_arrays([x.column(x.schema.get_field_index(n)).filter(keep) for n in ("a", "b")], names=["a", "b"])

    return pairs.join(one, "a").join(two, "b").mapInArrow(run, "a long, b long").distinct()


def jaccard(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], idf: Weights) -> float:
    """Weighted Jaccard similarity of two documents' shingles."""
    total = lambda h, n: float((n * idf(h).astype(np.float64)).sum())
    both, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    shared = total(both, np.minimum(x[1][i], y[1][j]))
    return shared / max(total(*x) + total(*y) - shared, 1e-300)


def verify(pairs: DataFrame, rows: DataFrame, idf: Weights, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs at or above the threshold; only texts that a pair needs are shuffled."""
    sc = pairs.sparkSession.sparkContext
    bitmap = sc.broadcast(key_filter(pairs.select("a").union(pairs.select("b"))))
    table = sc.broadcast(idf)

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.column(0)
            yield b.filter(pa.array(has(bitmap.value, np.array(i.fill_null(0))) & np.array(i.is_valid())))

    texts = rows.select("__id", "__text").mapInArrow(needed, "__id long, __text string")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of_last = None, None
        for x in batches:
            a, b = (x.column(x.schema.get_field_index(n)).to_pylist() for n in ("a", "b"))
            ta, tb = (x.column(x.schema.get_field_index(n)).cast(pa.binary()).to_pylist() for n in ("ta", "tb"))
            found = []
            for p, q in zip(ta, tb, strict=True):
                if q != last:  # pairs of one hub follow one another
                    last, of_last = q, shingles(q or b"")
                found.append(jaccard(shingles(p or b""), of_last, table.value))
            s = pa.array(found, pa.float64())
            keep = pa.array([v >= threshold - ROUNDING for v in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()).filter(keep), pa.array(b, pa.int64()).filter(keep), s.filter(keep)], names=["a", "b", "similarity"])

    one = texts.withColumnsRenamed({"__id": "a", "__text": "ta"})
    two = texts.withColumnsRenamed({"__id": "b", "__text": "tb"})
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(compare, "a long, b long, similarity double").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def similarities(bags: list[tuple[np.ndarray, np.ndarray]], idf: Weights) -> np.ndarray:
    """The weighted Jaccard similarity of all pairs of documents, given by their shingles: exact, above the diagonal."""
    m = len(bags)
    doc = np.repeat(np.arange(m), [len(x) for x, _ in bags])
    h, n = np.concatenate([x for x, _ in bags]), np.concatenate([x for _, x in bags])
    w = idf(h).astype(np.float64)
    total = np.bincount(doc, weights=n * w, minlength=m)
    if n.max(initial=0) > 1:  # a shingle's second occurrence is a shingle of its own, and so on
        at = np.repeat(np.arange(len(h)), n)
        k = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        h, doc, w = np.where(k > 0, mix(h[at] + k.astype(np.uint64) * _R), h[at]), doc[at], w[at]
    order = np.argsort(h, kind="stable")
    h, doc, w = h[order], doc[order], w[order]
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(h)))
    rest = np.repeat(start + size, size) - np.arange(len(h))  # of the shingle's documents, this one and those behind it
    few = np.flatnonzero(np.repeat(size <= FEW, size))
    shared = np.zeros(m * m)
    for d in range(1, FEW):
        few = few[rest[few] > d]
        if not len(few):
            break
        shared += np.bincount(doc[few] * m + doc[few + d], weights=w[few], minlength=m * m)
    shared = shared.reshape(m, m)
    many = np.flatnonzero(size > FEW)
    for a in range(0, len(many), 1024):
        x = np.zeros((m, len(many[a : a + 1024])))
        for c, f in enumerate(many[a : a + 1024]):
            x[doc[start[f] : start[f] + size[f]], c] = 1
        shared += (x * w[start[many[a : a + 1024]]]) @ x.T
    return np.triu(shared / np.maximum(total[:, None] + total - shared, 1e-300), 1)


def _block_links(idf, threshold: float):
    """Rows sorted by block: verified pairs of texts of different classes that join these."""

    def joins(ids: list[int], classes: list[int], bags: list) -> list[tuple[int, int, float]]:
        root = {c: c for c in classes}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        out = []
        if len(root) > 1:
            s = similarities(bags, idf.value)
            for i, j in zip(*np.nonzero(s >= threshold - ROUNDING), strict=True):
                x, y = find(classes[i]), find(classes[j])
                if x != y:
                    root[max(x, y)] = min(x, y)
                    out.append((min(ids[i], ids[j]), max(ids[i], ids[j]), float(s[i, j])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, classes, bags = None, [], [], []

        def batch(found: list[tuple[int, int, float]]) -> pa.RecordBatch:
            a, b, s = zip(*found, strict=True) if found else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], names=["a", "b", "similarity"])

        for x in batches:
            texts = x.column(x.schema.get_field_index("__text")).cast(pa.binary()).to_pylist()
            others = [x.column(x.schema.get_field_index(c)).to_pylist() for c in ("bucket", "block", "rep", "class")]
            for bucket, block, rep, cls, t in zip(*others, texts, strict=True):
                key = (bucket, *block.values())
                if key != last:
                    yield batch(joins(ids, classes, bags))
                    last, ids, classes, bags = key, [], [], []
                ids.append(rep)
                classes.append(cls)
                bags.append(shingles(t or b""))
        yield batch(joins(ids, classes, bags))

    return run


def _needed_texts(reps: DataFrame, rows: DataFrame) -> DataFrame:
    """(rep, __text): the different texts of the ids in reps."""
    bitmap = rows.sparkSession.sparkContext.broadcast(key_filter(reps.select("rep")))

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.column(0)
            yield b.filter(pa.array(has(bitmap.value, np.array(i.fill_null(0))) & np.array(i.is_valid())))

    return rows.select("__id", "digest", "__text").mapInArrow(needed, "__id long, digest binary, __text string").dropDuplicates(["__id", "digest"]).select(F.col("__id").alias("rep"), "__text")


def _unsettled(member: DataFrame, found: DataFrame) -> DataFrame:
    """(bucket, rep, class) of the buckets of three texts and more that aren't all of one class yet."""
    parts = connected_components(found, u="a", v="b", vertex="part")
    state = member.join(parts, member["rep"] == parts["part"], "left").select("bucket", "rep", F.coalesce("component", "rep").alias("class"))
    open_ = state.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("x"), F.max("class").alias("y")).where("n > 2 and x <> y")
    return state.join(materialise(open_.select("bucket"), "open"), "bucket")


def _dealt(left: DataFrame) -> DataFrame:
    """(bucket, block, rep, class): any two members of different classes meet in a block of about two times BLOCK at most.

    The largest class and the others are cut into parts by hash, and a block is
    two parts: all pairs of the others' parts, and each of these with each part
    of the largest class, whose members needn't meet.
    """
    by_class = left.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("n"))
    largest = by_class.groupBy("bucket").agg(F.max(F.struct("n", "class")).alias("top"), F.sum("n").alias("n"))
    cuts = materialise(largest.select("bucket", F.col("top.class").alias("top"), F.ceil(F.col("top.n") / BLOCK).alias("cut_top"), F.ceil((F.col("n") - F.col("top.n")) / BLOCK).alias("cut_rest")), "cuts")
    # a few members need one block only
    whole = (F.col("cut_top") == 1) & (F.col("cut_rest") == 1)
    is_top = F.col("class") == F.col("top")
    part = F.pmod(F.xxhash64("rep", F.lit(1)), F.when(is_top, F.col("cut_top")).otherwise(F.col("cut_rest")))
    rest = F.sequence(F.lit(0).cast("long"), F.col("cut_rest") - 1)
    with_top = F.sequence(F.lit(0).cast("long"), F.col("cut_top") - 1)
    block = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))
    blocks = (
        F.when(whole, F.array(block(0, F.lit(0).cast("long"), F.lit(0).cast("long"))))
        .when(is_top, F.transform(rest, lambda j: block(1, F.col("part"), j)))
        .otherwise(F.concat(F.transform(rest, lambda j: block(0, F.least("part", j), F.greatest("part", j))), F.transform(with_top, lambda j: block(1, j, F.col("part")))))
    )
    return left.join(cuts, "bucket").withColumn("part", part).select("bucket", F.explode(blocks).alias("block"), "rep", "class")


def links(reps: DataFrame, rows: DataFrame, idf: Weights, threshold: float, bands: int, n_rows: int) -> DataFrame:
    """Verified links (a, b, similarity) between different texts that connect what is alike.

    What is joined to members by bucket is written before, so that a bucket
    that a large part of all texts share can be split.
    """
    spark = reps.sparkSession
    member = materialise(_banded(reps, bands, n_rows), "buckets")
    sizes = materialise(member.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    member = materialise(member.join(sizes, "bucket"), "met")
    meets = member.groupBy("rep").agg(F.sum("n").alias("meets"))
    hubs = member.join(meets, "rep").groupBy("bucket").agg(F.max(F.struct("meets", -F.col("rep"))).alias("hub")).select("bucket", (-F.col("hub.col2")).alias("hub"))
    member = materialise(member.join(materialise(hubs, "hubs"), "bucket"), "members")
    stars = _alike(member.where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct(), reps, LEAST_SHARED)
    found = materialise(verify(materialise(stars, "stars"), rows, idf, threshold), "links")
    # what is left: members of a bucket that aren't of one class, all with all
    left = materialise(_unsettled(member, found), "unsettled")
    if left.isEmpty():
        return found
    table = spark.sparkContext.broadcast(idf)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = _dealt(left).join(_needed_texts(left, rows), "rep").repartition(parts, "bucket", "block").sortWithinPartitions("bucket", "block", "rep")
    more = blocks.mapInArrow(_block_links(table, threshold), "a long, b long, similarity double")
    return found.unionByName(materialise(more.groupBy("a", "b").agg(F.max("similarity").alias("similarity")), "links"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with ``class_id``: the smallest doc_id of those that a document is a copy of or linked to, its own included."""
    tune(docs.sparkSession)
    text = F.coalesce(F.col(text_column), F.lit(""))
    digest = F.concat(F.unhex(F.md5(text)), F.unhex(F.sha1(text)))
    plain = docs.select(F.col(id_column).cast("long").alias("__id"), text.alias("__text"), digest.alias("digest"))
    idf = idf_table(plain)
    signed = materialise(signatures(plain, idf, bands * rows), "signed")
    reps = materialise(signed.groupBy("digest").agg(F.min("__id").alias("rep"), F.min("sketch").alias("sketch")), "texts")
    sketches = reps.select("rep", "sketch").distinct()  # rows of one id with several texts are one document with several sketches
    found = links(sketches, plain, idf, threshold, bands, rows)
    parts = connected_components(found, u="a", v="b", vertex="part")
    classes = reps.join(parts, reps["rep"] == parts["part"], "left").select("digest", F.coalesce("component", "rep").alias("class_id"))
    # a row with several texts to its id stands with the class of that id
    own = docs.drop("class_id").withColumn("__digest", digest)
    return own.join(classes, own["__digest"] == classes["digest"], "left").withColumn("class_id", F.when(F.col(id_column).isNotNull(), F.coalesce("class_id", F.col(id_column).cast("long")))).drop("__digest", "digest")
