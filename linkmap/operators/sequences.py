"""Minimizers, k-mers and the relations built of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkmap.functions import columns as C
from linkmap.functions import kernels as K


#: Bytes of sequences that a kernel takes at a time.
PIECE = 1 << 20
#: Bits of the filter of repeated k-mers.
FILTER_BITS = 24
#: Repeated k-mers up to which each task has them all.
EXACT = 1 << 22
#: Reads of a barcodes' bucket up to which a barcode's reads meet in one task, and buckets.
TOGETHER, BARCODE_BUCKETS = 1 << 17, 1 << 12

Kernel = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _pieces(b: pa.RecordBatch, name: str) -> Iterator[tuple[int, list[bytes]]]:
    """A batch's sequences, some at a time: (number of the first, sequences)."""
    held: list[bytes] = []
    begin, size = 0, 0
    for i, s in enumerate(b.column(b.schema.get_field_index(name)).cast(pa.binary()).to_pylist()):
        held.append(s or b"")
        size += len(held[-1])
        if size > PIECE:
            yield begin, held
            held, begin, size = [], i + 1, 0
    if held:
        yield begin, held


def _exploded(df: DataFrame, seq: str, keep: list[str], out: str, make: Kernel) -> DataFrame:
    """Rows (keep..., pos, out) for all (sequence, pos, out) that make gives of some sequences; never groups."""
    kept = [df.schema[k] for k in keep]
    schema = T.StructType([*kept, T.StructField("pos", T.LongType()), T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin, seqs in _pieces(b, "__seq"):
                row, pos, val = make(seqs)
                if len(row):
                    take = pa.array(row + begin)
                    yield pa.RecordBatch.from_arrays([*(b.column(j).take(take) for j in range(len(kept))), pa.array(pos.astype(np.int64)), pa.array(val.astype(np.uint64).view(np.int64))], names=schema.names)

    return df.select(*[F.col(k) for k in keep], F.col(seq).alias("__seq")).mapInArrow(run, schema)


def kmer_codes(df: DataFrame, k: int, keep: list[str], seq: str = "seq") -> DataFrame:
    """(keep..., pos, code): canonical k-mers before mixing."""
    return _exploded(df, seq, keep, "code", lambda s: K.kmers_of(s, k))


def kmer_hashes(df: DataFrame, k: int, keep: list[str], seq: str = "seq") -> DataFrame:
    def make(seqs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, pos, x = K.kmers_of(seqs, k)
        return row, pos, K.mix64(x)

    return _exploded(df, seq, keep, "mx", make)


def kmer_tallies(df: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """(code, n): canonical k-mers, counted among some sequences of a task; a code may have several rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, seqs in _pieces(b, "__seq"):
                code, n = np.unique(K.kmers_of(seqs, k)[2], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(n.astype(np.int64))], names=["code", "n"])

    return df.select(F.col(seq).alias("__seq")).mapInArrow(run, "code long, n long")


def packed_kmers(df: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """(bucket, counted, n, data): canonical k-mers in the form of the kernel of that name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, seqs in _pieces(b, "__seq"):
                if found := K.packed_kmers(seqs, k):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int32(), pa.bool_(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "counted", "n", "data"])

    return df.select(F.col(seq).alias("__seq")).mapInArrow(run, "bucket int, counted boolean, n binary, data binary")


def _numbered(found: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return found[0], K.numbered(found[0]), found[1]


def minimizers(df: DataFrame, k: int, w: int, keep: list[str], seq: str = "seq") -> DataFrame:
    """(keep..., pos, mx): pos counts the minimizers of a sequence."""
    return _exploded(df, seq, keep, "mx", lambda s: _numbered(K.minimizers_of(s, k, w)))


def minimizer_positions(df: DataFrame, k: int, w: int, keep: list[str], seq: str = "seq") -> DataFrame:
    """(keep..., pos, bp): the start of each minimizer."""
    return _exploded(df, seq, keep, "bp", lambda s: _numbered(K.minimizer_positions_of(s, k, w)))


def _repeat_bits(repeats: DataFrame) -> np.ndarray:
    """A bitmap of 2**FILTER_BITS bits over the mixed codes; what comes back is a word for each 64 bits that are not all clear."""
    slot = F.shiftrightunsigned(C.mix64(F.col("code")), 64 - FILTER_BITS)
    words = repeats.select(F.shiftright(slot, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int")).alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    for w, bits in words.collect():
        out[w] = np.uint64(bits & 0xFFFFFFFFFFFFFFFF)
    return out


def _filtered(repeats: DataFrame, k: int, w: int, exact: int) -> Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]] | None:
    """The kernel of minimizers that leaves out the repeats, if there are at most ``exact``."""
    found = repeats.select("code").limit(exact + 1).toPandas()["code"].to_numpy(np.int64)
    if len(found) > exact:
        return None
    h = np.unique(K.mix64(found.view(np.uint64)))
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    shared = repeats.sparkSession.sparkContext.broadcast((h, np.packbits(bits)))

    def make(seqs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        known, bits = shared.value
        row, _, x = K.kmers_of(seqs, k)
        h = K.mix64(x)
        slot = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
        at = np.flatnonzero(bits[slot >> 3] << (slot & 7).astype(np.uint8) & 128)
        if len(at):
            keep = np.ones(len(h), bool)
            keep[at] = known[np.minimum(np.searchsorted(known, h[at]), len(known) - 1)] != h[at]
            row, h = row[keep], h[keep]
        return K.minimizers_of_hashes(row, h, w)

    return make


def minimizers_filtered(df: DataFrame, k: int, w: int, keep: list[str], repeats: DataFrame, seq: str = "seq", exact: int = EXACT) -> DataFrame:
    """The same over the k-mers that are not in repeats (column code), which may be of any size.

    Up to ``exact`` repeats each task has them all.  Of more a bitmap of fixed
    size clears most sequences, which are done on the spot; only those with a
    k-mer that it marks meet the repeats in an anti-join.
    """
    if exact >= 0 and (make := _filtered(repeats, k, w, exact)):
        return _exploded(df, seq, keep, "mx", lambda s: _numbered(make(s)))
    bits = df.sparkSession.sparkContext.broadcast(_repeat_bits(repeats))
    source = df.select(*[F.col(c) for c in keep], F.col(seq).alias("__seq"))
    kept = [source.schema[c] for c in keep]
    schema = T.StructType([*kept, T.StructField("pos", T.LongType()), T.StructField("mx", T.LongType())])

    def marked(seqs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, hash) of the k-mers, and which sequences have one that the bitmap marks."""
        row, _, x = K.kmers_of(seqs, k)
        h = K.mix64(x)
        slot = h >> np.uint64(64 - FILTER_BITS)
        hit = (bits.value[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) > 0
        out = np.zeros(len(seqs), bool)
        out[row[hit]] = True
        return row, h, out

    def clear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin, seqs in _pieces(b, "__seq"):
                row, h, out = marked(seqs)
                row, m = K.minimizers_of_hashes(row[~out[row]], h[~out[row]], w)
                if len(row):
                    take = pa.array(row + begin)
                    yield pa.RecordBatch.from_arrays([*(b.column(j).take(take) for j in range(len(kept))), pa.array(K.numbered(row)), pa.array(m.view(np.int64))], names=schema.names)

    def doubtful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mask = np.concatenate([marked(seqs)[2] for _, seqs in _pieces(b, "__seq")]) if b.num_rows else np.zeros(0, bool)
            yield b.filter(pa.array(mask))

    rows = source.mapInArrow(doubtful, source.schema).withColumn("__read", F.monotonically_increasing_id())
    left = kmer_codes(rows, k, [*keep, "__read"], "__seq").join(repeats.select("code").distinct(), "code", "left_anti")
    grouped = left.groupBy(*keep, "__read").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]).alias("codes"))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = b.column(b.num_columns - 1)
            if b.num_rows:
                row = np.repeat(np.arange(len(codes)), np.diff(np.array(codes.offsets)))
                row, m = K.minimizers_of_hashes(row, K.mix64(np.array(codes.flatten()).view(np.uint64)), w)
                yield pa.RecordBatch.from_arrays([*(b.column(j).take(pa.array(row)) for j in range(len(kept))), pa.array(K.numbered(row)), pa.array(m.view(np.int64))], names=schema.names)

    return source.mapInArrow(clear, schema).unionByName(grouped.select(*keep, "codes").mapInArrow(exact, schema))


def read_key(header: str = "header"):
    """A linked read's barcode, else its name."""
    return F.coalesce(C.barcode(F.col(header)), C.first_token(F.col(header)))


def _together(rows: DataFrame, make: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], together: int) -> DataFrame:
    """(bx, mx): the distinct minimizers of the rows (bx, seq), which make gives of some sequences.

    Sequences are far smaller than their minimizers, so a barcode's sequences
    meet in one task, sorted, and give each minimizer once.  Barcodes of buckets
    with more than ``together`` reads are too many for a task; their minimizers
    are told apart by a shuffle.
    """
    bucket = F.pmod(F.xxhash64("bx"), F.lit(BARCODE_BUCKETS)).cast("int")
    hot = [r[0] for r in rows.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > together).collect()]
    schema = T.StructType([rows.schema["bx"], T.StructField("mx", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, given = None, np.zeros(0, np.uint64)  # the barcode before, and its minimizers so far
        begun = False
        for b in batches:
            names = b.column(0)
            for begin, seqs in _pieces(b, "seq"):
                code = names.slice(begin, len(seqs)).dictionary_encode(null_encoding="encode")
                own = np.array(code.indices)
                row, h = make(seqs)
                order = np.lexsort((h, own[row]))
                group, h = own[row[order]], h[order]
                if len(h):
                    first = np.concatenate([[True], (group[1:] != group[:-1]) | (h[1:] != h[:-1])])
                    group, h = group[first], h[first]
                keys = code.dictionary.to_pylist()
                if begun and keys[own[0]] == last:
                    new = (group != own[0]) | ~np.isin(h, given)
                    group, h = group[new], h[new]
                else:
                    given = given[:0]
                mine = h[group == own[-1]]
                given = np.concatenate([given, mine]) if own[-1] == own[0] else mine
                last, begun = keys[own[-1]], True
                if len(h):
                    yield pa.RecordBatch.from_arrays([code.dictionary.take(pa.array(group)), pa.array(h.view(np.int64))], names=schema.names)

    n_parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = rows.where(~bucket.isin(hot)).repartition(n_parts, "bx").sortWithinPartitions("bx").mapInArrow(run, schema)
    if hot:
        out = out.unionByName(_exploded(rows.where(bucket.isin(hot)), "seq", ["bx"], "mx", lambda s: _numbered(make(s))).select("bx", "mx").distinct())
    return out


def _index(rows: DataFrame, k: int, w: int, repeats: DataFrame | None, together: int, exact: int) -> DataFrame:
    make = (lambda s: K.minimizers_of(s, k, w)) if repeats is None else _filtered(repeats, k, w, exact)
    return _together(rows, make, together) if make else minimizers_filtered(rows, k, w, ["bx"], repeats, exact=-1).select("bx", "mx").distinct()


def index_linked(reads: DataFrame, k: int, w: int, repeats: DataFrame | None = None, together: int = TOGETHER, exact: int = EXACT) -> DataFrame:
    """incidence(bx, mx) of linked reads: the union of their minimizers by barcode."""
    return _index(reads.select(read_key().alias("bx"), "seq"), k, w, repeats, together, exact)


def index_long(reads: DataFrame, k: int, w: int, repeats: DataFrame | None = None) -> DataFrame:
    """incidence of long reads: by name, after runs of equal bases are compressed."""
    rows = reads.select(C.first_token(F.col("header")).alias("bx"), C.compress_runs(F.col("seq")).alias("seq"))
    mx = minimizers(rows, k, w, ["bx"]) if repeats is None else minimizers_filtered(rows, k, w, ["bx"], repeats)
    return mx.select("bx", "mx").distinct()


def compressed_reads(reads: DataFrame) -> DataFrame:
    """Reads with runs compressed; a run keeps its first base's quality, or I without one."""
    starts = C.run_starts(F.col("seq"))
    kept = F.array_join(F.transform(starts, lambda i: F.substring(F.col("qual"), i + 1, F.lit(1))), "")
    short = C.compress_runs(F.col("seq"))
    # two steps: beside an alias of the same name the lambdas would see the new sequence
    out = reads.withColumn("qual", F.when(F.col("qual").isNotNull(), kept).otherwise(F.repeat(F.lit("I"), F.length(short))))
    return out.withColumn("seq", short)


def index_ordered(named: DataFrame, k: int, w: int) -> DataFrame:
    """(name, qpos, mx) of contigs or references; the last of several sequences with one name counts."""
    last = named.groupBy(C.first_token(F.col("name")).alias("name")).agg(F.max_by("seq", "ord").alias("seq"))
    return minimizers(last, k, w, ["name"]).select("name", F.col("pos").cast("int").alias("qpos"), "mx")


def index_positions(named: DataFrame, k: int, w: int, step: int = 100) -> DataFrame:
    """Every step-th minimizer's place, the first and the last among them."""
    rows = named.select(C.first_token(F.col("name")).alias("chrom"), F.length("seq").cast("long").alias("seq_len"), F.col("ord"), "seq")
    mx = minimizer_positions(rows, k, w, ["chrom", "ord", "seq_len"])
    total = F.count(F.lit(1)).over(W.partitionBy("chrom", "ord"))
    return mx.withColumn("total", total).where((F.col("pos") % step == 0) | (F.col("pos") == F.col("total") - 1)).select("chrom", F.col("pos").alias("mx_index"), "bp", "total", "seq_len")


def detect_protocol(reads: DataFrame, first: int = 1000, share: float = 0.1) -> str:
    """linked if at least a tenth of the first file's first reads carry a barcode, else long."""
    if "file" in reads.columns:
        reads = reads.join(F.broadcast(reads.agg(F.min("file").alias("file"))), "file")  # one row
    head = reads.orderBy("rec_no").limit(first).select(F.avg(C.barcode(F.col("header")).isNotNull().cast("int")).alias("a")).first()["a"]
    if head is None:
        raise ValueError("no reads to tell the protocol from")
    return "linked" if head >= share else "long"
