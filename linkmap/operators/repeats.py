"""K-mer spectra and repeated k-mers, exact and as sketches."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkmap.functions import kernels as K
from linkmap.operators import sequences

CAP, MOST = 10_000, 65_535


#: Bytes of packed k-mers, and distinct ones, that a task counts at a time.
COUNTED, HELD = 1 << 20, 1 << 19


def kmer_counts(reads: DataFrame, k: int) -> DataFrame:
    """(code, n) of the reads' canonical k-mers, with counts capped as a 16-bit counter is.

    Up to 32 bases k-mers move as packed runs by bucket, some two bytes each, and
    a task has all of its buckets' k-mers and holds one bucket's distinct ones.
    """
    if not 0 < k <= 32:
        return sequences.kmer_tallies(reads, k).groupBy("code").agg(F.least(F.sum("n"), F.lit(MOST)).alias("n"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        rows: list[tuple[bool, bytes, bytes]] = []
        size, last = 0, None

        def add() -> None:
            nonlocal code, times, rows, size
            runs = [x for x in rows if not x[0]]
            found, n = np.unique(K.unpacked_kmers([x[1] for x in runs], [x[2] for x in runs], k), return_counts=True)
            told = [x for x in rows if x[0]]
            code = np.concatenate([code, found, *(np.frombuffer(x[2], "<u8") for x in told)])
            times = np.concatenate([times, n, *(np.frombuffer(x[1], "<i8") for x in told)])
            order = np.argsort(code, kind="stable")
            code, times = code[order], times[order]
            first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
            code, times = code[first], np.add.reduceat(times, first) if len(first) else times
            rows, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal code, times
            n = np.minimum(times, MOST)
            for a in range(0, len(code), HELD):
                yield pa.RecordBatch.from_arrays([pa.array(code[a : a + HELD].view(np.int64)), pa.array(n[a : a + HELD])], names=["code", "n"])
            code, times = code[:0], times[:0]

        for b in batches:
            for bucket, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if size > COUNTED:
                    add()
                if bucket != last and len(code) > HELD:
                    add()
                    yield from out()
                last = bucket
                rows.append(tuple(row))
                size += len(row[1]) + len(row[2])
        add()
        yield from out()

    n_parts = min(K.BUCKETS, int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    packed = sequences.packed_kmers(reads, k).repartitionById(n_parts, F.pmod("bucket", F.lit(n_parts)).cast("int")).sortWithinPartitions("bucket")
    return packed.mapInArrow(count, "code long, n long")


def approximate_counts(reads: DataFrame, k: int, width: int, depth: int = 4) -> CountMin:
    """A count-min sketch of the reads' k-mers: each task fills its own, and rows are added up a stretch at a time; the size is the caller's and doesn't grow with the input."""
    stretch = 1 << 16

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = CountMin(width, depth), False
        for b in batches:
            own.insert(np.array(b.column(0)).view(np.uint64), np.array(b.column(1)))
            seen = True
        if seen:
            at = [(d, a) for d in range(depth) for a in range(0, width, stretch) if own.rows[d, a : a + stretch].any()]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in at], pa.int32()), pa.array([x for _, x in at], pa.int32()), pa.array([own.rows[d, a : a + stretch].tobytes() for d, a in at], pa.binary())], names=["d", "a", "counts"])

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(min(stretch, width - key[1]), np.int64)
        for x in pdf["counts"]:
            total += np.frombuffer(x, np.uint16)
        return pd.DataFrame({"d": [key[0]], "a": [key[1]], "counts": [np.minimum(total, MOST).astype(np.uint16).tobytes()]})

    schema = "d int, a int, counts binary"
    out = CountMin(width, depth)
    for d, a, x in sequences.kmer_tallies(reads, k).mapInArrow(fill, schema).groupBy("d", "a").applyInPandas(add, schema).collect():
        out.rows[d, a : a + stretch] = np.frombuffer(bytes(x), np.uint16)
    return out


def approximate_repeats(reads: DataFrame, k: int, least: int, width: int, depth: int = 4) -> DataFrame:
    """(code): k-mers whose sketched count is at least ``least``; a sketch never counts too few, so none of the repeated ones is missing."""
    sketch = reads.sparkSession.sparkContext.broadcast(approximate_counts(reads, k, width, depth))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = b.column(0)
            yield pa.RecordBatch.from_arrays([code.filter(pa.array(sketch.value.query(np.array(code).view(np.uint64)) >= least))], names=["code"])

    return sequences.kmer_tallies(reads, k).select("code").mapInArrow(pick, "code long").distinct()


def histogram(counts: DataFrame) -> DataFrame:
    """(mult, freq): how many k-mers have each multiplicity."""
    return counts.groupBy(F.least("n", F.lit(CAP)).alias("mult")).agg(F.count(F.lit(1)).alias("freq"))


def histogram_mode(hist: DataFrame, last_of_ties: bool = True) -> int | None:
    """The multiplicity of the peak behind the first rise; at most CAP rows come to the driver."""
    freq = {r["mult"]: r["freq"] for r in hist.where(F.col("mult") >= 1).collect()}
    return mode_of(freq, last_of_ties)


def mode_of(freq: dict[int, int], last_of_ties: bool = True) -> int | None:
    if not any(freq.values()):
        return None
    dense = [freq.get(i, 0) for i in range(1, max(freq) + 1)]
    valley = next((i - 1 for i in range(1, len(dense)) if dense[i] > dense[i - 1]), 0)
    top = max(dense[valley:])
    at = [i for i in range(valley, len(dense)) if dense[i] == top]
    return (at[-1] if last_of_ties else at[0]) + 1


def mode_of_table(lines: list[str]) -> int | None:
    """The same of a histogram file's lines, whose place is the multiplicity; lines that begin with k or F are left out; the first peak of ties."""
    values = [int(x.split("\t")[-1] or 0) for x in lines if x.strip() and x[0] not in "kF"]
    return mode_of(dict(enumerate(values, 1)), last_of_ties=False)


def mode_frame(hist: DataFrame) -> DataFrame:
    """histogram_mode as a one-row frame, for SQL use."""
    top = hist.agg(F.max("mult").alias("top"))
    dense = top.select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("top").cast("long"))).alias("mult")).join(hist, "mult", "left").select("mult", F.coalesce("freq", F.lit(0)).alias("freq"))
    w = W.orderBy("mult")  # CAP rows at most
    rise = dense.withColumn("rise", F.col("freq") > F.lag("freq").over(w)).withColumn("valley", F.min(F.when(F.col("rise"), F.col("mult") - 1)).over(W.partitionBy()))
    return rise.where(F.col("mult") >= F.coalesce("valley", F.lit(1))).agg(F.max_by("mult", F.struct("freq", "mult")).alias("mode"))


def threshold(mode: int, multiplier: int) -> int:
    return min(mode * multiplier, MOST)


def repeated_kmers(counts: DataFrame, least: int) -> DataFrame:
    return counts.where(F.col("n") >= least)


@dataclass
class Bloom:
    """A Bloom filter with a binary file form: bits and hashes, padding, words, least byte first."""

    n_bits: int
    n_hashes: int
    words: np.ndarray = field(default=None)

    def __post_init__(self) -> None:
        if self.words is None:
            self.words = np.zeros((self.n_bits + 63) // 64, np.uint64)

    def _slots(self, x: np.ndarray) -> np.ndarray:
        from linkmap.functions.kernels import mix64

        a = mix64(np.asarray(x, np.uint64))
        b = mix64(a) | np.uint64(1)
        with np.errstate(over="ignore"):
            return np.stack([(a + np.uint64(i) * b) % np.uint64(self.n_bits) for i in range(self.n_hashes)])

    def insert(self, x: np.ndarray) -> None:
        s = self._slots(np.atleast_1d(x)).ravel()
        np.bitwise_or.at(self.words, s >> np.uint64(6), np.uint64(1) << (s & np.uint64(63)))

    def contains(self, x: np.ndarray) -> np.ndarray:
        s = self._slots(np.atleast_1d(x))
        return ((self.words[s >> np.uint64(6)] >> (s & np.uint64(63))) & np.uint64(1)).astype(bool).all(0)

    def popcount(self) -> int:
        return int(np.unpackbits(self.words.view(np.uint8)).sum())

    def false_positive_rate(self) -> float:
        return (self.popcount() / self.n_bits) ** self.n_hashes

    def to_bytes(self) -> bytes:
        return struct.pack("<QII", self.n_bits, self.n_hashes, 0) + self.words.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Bloom:
        n_bits, n_hashes, _ = struct.unpack_from("<QII", data)
        return cls(n_bits, n_hashes, np.frombuffer(data, "<u8", (n_bits + 63) // 64, 16).astype(np.uint64))


@dataclass
class CountMin:
    """Saturating 16-bit counters in several rows."""

    width: int
    depth: int = 4
    rows: np.ndarray = field(default=None)

    def __post_init__(self) -> None:
        if self.rows is None:
            self.rows = np.zeros((self.depth, self.width), np.uint16)

    def _slots(self, x: np.ndarray) -> np.ndarray:
        from linkmap.functions.kernels import mix64

        x = np.asarray(x, np.uint64)
        with np.errstate(over="ignore"):
            return np.stack([mix64(x + np.uint64(d) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.width) for d in range(self.depth)])

    def insert(self, x: np.ndarray, times: np.ndarray | None = None) -> None:
        x = np.atleast_1d(x)
        times = np.ones(len(x), np.int64) if times is None else times
        for row, s in zip(self.rows, self._slots(x), strict=True):
            at, inverse = np.unique(s.astype(np.int64), return_inverse=True)
            row[at] = np.minimum(row[at].astype(np.int64) + np.bincount(inverse, weights=times, minlength=len(at)).astype(np.int64), MOST)

    def query(self, x: np.ndarray) -> np.ndarray:
        return np.min([row[s] for row, s in zip(self.rows, self._slots(np.atleast_1d(x)), strict=True)], axis=0)

    def merge(self, other: CountMin) -> CountMin:
        return CountMin(self.width, self.depth, np.minimum(self.rows.astype(np.int64) + other.rows, MOST).astype(np.uint16))
