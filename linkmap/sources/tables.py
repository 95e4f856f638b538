"""Readers of the engine's text formats; gzip is read by suffix, as Spark does."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkmap.functions.columns import first_token, from_unsigned_text
from linkmap.operators.numbers import row_numbers
from linkmap.types import BED, PAF, POSITIONS, READS


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line_no, line): lines are numbered in each file, which is one task's unless it is larger than a split."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    return raw.withColumn("line_no", F.struct("block", "id")).drop("block", "id")


#: Bytes of a plain sequence file that one task reads.
SPLIT = 64 << 20


def read_fastx(spark: SparkSession, path: str | list[str], split: int = SPLIT) -> DataFrame:
    """Reads of FASTA or FASTQ files, told by each record's first letter; rec_no is where the record begins in its file's text.

    Plain files are read in stretches of ``split`` bytes: a task takes the
    records that begin in its stretch.  Compressed ones can't be split and are
    streamed by one task each.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").distinct()
    spans = [(r["path"], a, a + split if not r["path"].endswith(".gz") else -1) for r in files.collect() for a in range(0, 1 if r["path"].endswith(".gz") else max(r["length"], 1), split)]  # names only
    rows = spark.createDataFrame(spans or [("", 0, -1)], "path string, a long, b long").repartition(max(1, len(spans)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for name, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not name:
                    continue
                system, p = fs.FileSystem.from_uri(name)
                if b < 0:
                    with system.open_input_stream(p, compression="gzip") as raw:
                        yield from _batches(name, parse_fastx(_text_lines(raw, 0)))
                else:
                    with system.open_input_file(p) as raw:
                        yield from _batches(name, _records_in(raw, a, b))

    return rows.mapInArrow(run, READS)


def _records_in(raw, a: int, b: int) -> Iterator[tuple[int, str, str, str | None]]:
    """The records of a file that begin from byte a to byte b."""
    first = raw.read(1).decode("latin-1")
    raw.seek(max(a - 1, 0))
    lines = _text_lines(raw, max(a - 1, 0))
    if a:
        next(lines, None)  # the end of a line that another stretch has
    for r in parse_fastx(_from_record(lines, first) if a else lines):
        if r[0] >= b:
            return
        yield r


def _from_record(lines: Iterator[tuple[int, str]], first: str) -> Iterator[tuple[int, str]]:
    """Lines from the first one on that begins a record of a file with that first letter: a quality line that looks like a header has no + two lines below."""
    held = list(islice(lines, 3))
    while held and not (held[0][1].startswith(first) and (first == ">" or len(held) > 2 and held[2][1].startswith("+"))):
        held = held[1:] + list(islice(lines, 1))
    return chain(held, lines)


def _text_lines(raw, at: int) -> Iterator[tuple[int, str]]:
    """(place, line) of a stream that is at a place."""
    rest = b""
    while data := raw.read(1 << 20):
        *lines, rest = (rest + data).split(b"\n")
        for x in lines:
            yield at, x.rstrip(b"\r").decode("utf-8", "replace")
            at += len(x) + 1
    if rest:
        yield at, rest.rstrip(b"\r").decode("utf-8", "replace")


def parse_fastx(lines: Iterator[tuple[int, str]]) -> Iterator[tuple[int, str, str, str | None]]:
    """(place, header, sequence, quality or None) of each record."""
    begin, header, seq = 0, None, []
    lines = iter(lines)
    after = lambda: next(lines, (0, ""))[1]
    for at, x in lines:
        if header is None and x.startswith("@"):
            s, _, q = after(), after(), after()
            yield at, x[1:], s, q
        elif x.startswith(">"):
            if header is not None:
                yield begin, header, "".join(seq), None
            begin, header, seq = at, x[1:], []
        elif header is not None:
            seq.append(x.strip())
    if header is not None:
        yield begin, header, "".join(seq), None


def _batches(name: str, records: Iterator[tuple[int, str, str, str | None]]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in records:
        held.append(r)
        size += len(r[2])
        if len(held) == 10_000 or size > 8 << 20:
            yield _batch(name, held)
            held, size = [], 0
    if held:
        yield _batch(name, held)


def _batch(name: str, held: list) -> pa.RecordBatch:
    no, header, seq, qual = zip(*held, strict=True)
    return pa.RecordBatch.from_arrays([pa.array([name] * len(held)), pa.array(no, pa.int64()), pa.array(header), pa.array(seq), pa.array(qual, pa.string())], names=READS.names)


def named_sequences(reads: DataFrame) -> DataFrame:
    """(name, seq, ord) by the header's first token."""
    return reads.select(first_token(F.col("header")).alias("name"), "seq", F.col("rec_no").alias("ord"))


def _hashes(lines: DataFrame) -> DataFrame:
    parts = F.split("line", "\t", 2)
    token = F.filter(F.split(F.trim(F.element_at(parts, 2)), r"\s+"), lambda x: x != "")
    values = F.filter(F.transform(token, lambda x: from_unsigned_text(F.split(x, ":")[0])), lambda x: x.isNotNull())
    return lines.select("file", "line_no", F.trim(parts[0]).alias("name"), F.when(F.size(parts) > 1, values).otherwise(F.array().cast("array<bigint>")).alias("mxs")).where("name <> ''")


def read_minimizers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """incidence(bx, mx): lines with one barcode are united; bad hashes are left out."""
    return _hashes(_lines(spark, path)).select(F.col("name").alias("bx"), F.explode("mxs").alias("mx")).distinct()


def read_minimizer_lists(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(name, qpos, mx): the last line of a name counts."""
    last = _hashes(_lines(spark, path)).groupBy("name").agg(F.max_by("mxs", F.struct("file", "line_no")).alias("mxs"))
    return last.select("name", F.posexplode("mxs").alias("qpos", "mx"))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of a two-section table; vertices that only edges name have m 0, and a name's first m counts."""
    lines = _lines(spark, path).withColumn("f", F.split("line", "\t"))
    # the sections differ in width: U, m[, mol] against U, V, m under a header of its own
    head = lines.where(F.col("line").rlike("^U\tV\tm\\s*$")).agg(F.min("line_no").alias("at"))
    marked = lines.join(F.broadcast(head)).withColumn("edge", F.coalesce(F.col("line_no") > F.col("at"), F.lit(False)))
    number = lambda i: F.coalesce(F.expr(f"try_cast(get(f, {i}) as bigint)"), F.lit(0))
    body = marked.where((F.size("f") >= 2) & ~F.col("line").rlike("^U\t(V\t)?m"))
    edges = body.where("edge").where(F.size("f") >= 3).select(F.least(F.col("f")[0], F.col("f")[1]).alias("u"), F.greatest(F.col("f")[0], F.col("f")[1]).alias("v"), number(2).alias("m"))
    own = body.where("not edge").groupBy(F.col("f")[0].alias("id")).agg(F.min_by(F.struct(number(1).alias("m"), F.expr("try_cast(get(f, 2) as bigint)").alias("mol")), "line_no").alias("x")).select("id", "x.m", "x.mol")
    ends = edges.select(F.explode(F.array("u", "v")).alias("id")).distinct().join(own, "id", "left_anti").select("id", F.lit(0).cast("long").alias("m"), F.lit(None).cast("long").alias("mol"))
    return own.unionByName(ends), edges


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    """(tid, tpos, mol) of a file with a path on each line; empty lines are no paths."""
    rows = _lines(spark, path).withColumn("x", F.filter(F.split("line", r"\s+"), lambda t: t != "")).where(F.size("x") > 0)
    return row_numbers(rows.select("file", "line_no", "x"), ["file", "line_no"], "tid").select("tid", F.posexplode("x").alias("tpos", "mol")).select("tid", F.col("tpos").cast("long").alias("tpos"), "mol")


def _delimited(spark: SparkSession, path: str, schema: T.StructType, least: int, defaults: dict | None = None) -> DataFrame:
    """Lenient reading: short lines are passed over, bad numbers are 0."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("f")).where(F.size("f") >= least)
    cols = []
    for i, f in enumerate(schema.fields):
        raw = F.expr(f"get(f, {i})")
        cols.append((F.coalesce(F.expr(f"try_cast(get(f, {i}) as bigint)"), F.lit(0)) if f.dataType == T.LongType() else F.coalesce(raw, F.lit((defaults or {}).get(f.name)))).alias(f.name))
    return rows.select(*cols)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    return _delimited(spark, path, BED, 5, {"orientation": "."})


def read_paf(spark: SparkSession, path: str) -> DataFrame:
    return _delimited(spark, path, PAF, 12)


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    return _delimited(spark, path, POSITIONS, 5)


def read_bloom(spark: SparkSession, path: str):
    from linkmap.operators.repeats import Bloom

    return Bloom.from_bytes(bytes(spark.read.format("binaryFile").load(path).first()["content"]))
