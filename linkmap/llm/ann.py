"""Approximate nearest neighbours over shifted space-filling curves.

Vectors are projected at random to a few dimensions, shifted, and laid on a
Hilbert curve; several curves with other projections and shifts are kept.  On
each curve the vectors are range-partitioned by key and numbered; a query
meets all vectors whose number on some curve is within a window of its own,
and the best of what it meets is ranked by its true distance.

The window is fitted, by one rule at every size: for ``SAMPLE`` points, chosen
by hash, the true neighbours are found by brute force in one pass over all
vectors, and the window is the distance along the nearest curve that reaches
``TARGET`` of them.  In data with structure that is a small part of the table;
in data without any it is a part that doesn't shrink, and the work grows with
the square of the table.

Only short codes of vectors move with the curves: eight bits a component, with
a scale for each vector.  What a query meets in a block is ordered by the codes'
distance, the ``NEAR`` nearest go on, and of these the ``KEPT`` nearest meet the
vectors themselves, once.

Equal vectors are one vector with the few smallest ids that an answer can
hold, so a vector that a third of all rows share is one point.  A window's
neighbours are blocks of consecutive vectors, so no task holds more than a
block and the queries near it, some at a time.

Defined results: vectors that are null, zero, of another length than the most
frequent one, or have null or non-finite components take no part, nor do rows
without id; rows that share an id are separate candidates; fewer candidates
than k give all of them; an empty table gives no rows; other columns of the
table, whatever their names, play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkmap.llm.common import materialise, tune

CURVES = 32
DIMS, LEVELS = 12, 3
#: Points whose true neighbours the window is fitted to, and the share of these that it has to reach.
SAMPLE, TARGET = 400, 0.96
#: Vectors of a block, at least and at most.
LEAST_BLOCK, BLOCK = 512, 4096
#: Queries that are compared with a block at a time.
QUERIES = 256
#: Neighbours beyond k that go on from a block, and that meet their vectors.
NEAR, KEPT = 16, 64


def hilbert_keys(cells: np.ndarray, levels: int) -> np.ndarray:
    """Places on the Hilbert curve of points given by their cell in each dimension (Skilling's transposed form)."""
    x = cells.T.astype(np.uint64).copy()
    n = len(x)
    one = np.uint64(1)
    for level in range(levels - 1, 0, -1):
        q = one << np.uint64(level)
        low = q - one
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.uint64)
    for level in range(levels - 1, 0, -1):
        q = one << np.uint64(level)
        t ^= np.where((x[n - 1] & q) != 0, q - one, np.uint64(0))
    x ^= t
    key = np.zeros(x.shape[1], np.uint64)
    for level in range(levels - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(level)) & one)
    return key


def projections(dim: int, curves: int, seed: int = 7) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each curve's projection and shift."""
    rng = np.random.default_rng(seed)
    return [(rng.normal(size=(dim, min(DIMS, dim))), rng.random(min(DIMS, dim)) * 0.5) for _ in range(curves)]


def valid(c: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return c.isNotNull() & finite & F.exists(c, lambda x: x != 0)


def _points(vectors: DataFrame, k: int, is_query: Column) -> DataFrame:
    """(rid, vec, ids, asks): distinct vectors, their k + 1 smallest ids, whether a query has them."""
    rank = F.row_number().over(W.partitionBy("vec").orderBy("id"))
    few = vectors.select("vec", "id").withColumn("rank", rank).where(F.col("rank") <= k + 1)  # Spark limits groups before it shuffles
    ids = few.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.min("id").alias("rid"))
    asks = vectors.where(is_query).groupBy("vec").agg(F.lit(True).alias("asks"))
    return ids.join(asks, "vec", "left").select("rid", "vec", "ids", F.coalesce("asks", F.lit(False)).alias("asks"))


def _column(b: pa.RecordBatch, name: str) -> pa.Array:
    return b.column(b.schema.get_field_index(name))


def _matrix(c: pa.Array, dim: int) -> np.ndarray:
    return np.array(c.flatten(), np.float64).reshape(-1, dim)


def fit_window(points: DataFrame, ranked: DataFrame, n: int, dim: int, k: int) -> int:
    """How far along its nearest curve a true neighbour lies, at the share TARGET of those of SAMPLE points."""
    spark = points.sparkSession
    chosen = points.select("rid", "vec").orderBy(F.xxhash64("vec"), "rid").limit(SAMPLE).collect()
    sample = spark.sparkContext.broadcast((np.array([r["rid"] for r in chosen]), np.array([r["vec"] for r in chosen], np.float64)))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = sample.value
        ids, found = np.zeros((len(own), 0), np.int64), np.zeros((len(own), 0))
        for b in batches:
            v, rid = _matrix(b.column(1), dim), np.array(b.column(0))
            d = np.maximum((q * q).sum(1)[:, None] + (v * v).sum(1) - 2 * (q @ v.T), 0)
            d[own[:, None] == rid] = np.inf
            ids, found = np.concatenate([ids, np.broadcast_to(rid, d.shape)], 1), np.concatenate([found, d], 1)
            if found.shape[1] > k:
                at = np.argpartition(found, k - 1, axis=1)[:, :k]
                ids, found = np.take_along_axis(ids, at, 1), np.take_along_axis(found, at, 1)
        good = np.isfinite(found)
        yield pa.RecordBatch.from_arrays([pa.array(own[np.nonzero(good)[0]]), pa.array(ids[good]), pa.array(found[good])], names=["qid", "rid", "d"])

    near = points.select("rid", "vec").mapInArrow(best, "qid long, rid long, d double")
    near = near.withColumn("o", F.row_number().over(W.partitionBy("qid").orderBy("d", "rid"))).where(F.col("o") <= k).select("qid", "rid").collect()  # SAMPLE * k rows
    wanted = sorted({r["qid"] for r in near} | {r["rid"] for r in near})
    if not wanted:
        return max(n, 1)
    places = ranked.join(F.broadcast(spark.createDataFrame([(int(i),) for i in wanted], "rid long")), "rid").toPandas()  # a row for each of these and each curve
    at = places.pivot(index="rid", columns="curve", values="r")
    apart = np.abs(at.loc[[r["qid"] for r in near]].to_numpy() - at.loc[[r["rid"] for r in near]].to_numpy()).min(1)
    return max(1, int(np.quantile(apart, TARGET, method="higher")))


def search(table: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", curves: int = CURVES, window: int | None = None) -> DataFrame:
    """(query_id, rank, id, score): each query's k nearest other rows that were found; is_query is a condition on column ``id``."""
    spark = tune(table.sparkSession)
    rows = table.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vec")).where(F.col("id").isNotNull() & valid(F.col("vec")))
    dims = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, id long, score double")
    if not dims:
        return empty
    dim = dims[0]["d"]
    rows = rows.where(F.size("vec") == dim)
    # equal ids with other vectors are points of their own: a point is named by its own number
    points = materialise(_points(rows, k, is_query).withColumn("rid", F.monotonically_increasing_id()), "points")
    n = points.count()
    spread = points.select(F.posexplode("vec").alias("i", "x")).groupBy("i").agg(F.percentile_approx("x", [0.25, 0.5, 0.75]).alias("q")).orderBy("i").collect()  # three numbers for each dimension
    low, centre, high = np.array([r["q"] for r in spread], np.float64).T
    scale = float(np.sqrt(np.mean(((high - low) / 1.349) ** 2))) or 1.0  # that of a normal distribution, whatever outliers there are

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = projections(dim, curves)
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column(1), dim) - centre
            keys = []
            for p, shift in lines:
                y = v @ p / (scale * np.sqrt((p * p).sum(0)))  # about one standard deviation is 1
                cell = np.clip((np.clip(y, -1e9, 1e9) + 2.3) / 4.6 * 0.5 + shift * 0.999, 0, 1 - 1e-9) * (1 << LEVELS)
                keys.append(hilbert_keys(cell.astype(np.int64), LEVELS))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(curves, dtype=np.int32), b.num_rows)), pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(np.array(b.column(0)), curves))],
                names=["curve", "key", "rid"],
            )

    order = points.select("rid", "vec").mapInArrow(keyed, "curve int, key long, rid long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = materialise(order.repartitionByRange(parts, "curve", "key", "rid").sortWithinPartitions("curve", "key", "rid").withColumn("place", F.monotonically_increasing_id()), "curves")
    # numbers along the curves from places in partitions: one count for each partition
    part = F.shiftright("place", 33)
    counts = sorted((r["part"], r["n"]) for r in order.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, total = {}, 0
    for p, c in counts:
        before[p], total = total, total + c
    offsets = spark.createDataFrame([(int(p), int(x)) for p, x in before.items()] or [(0, 0)], "part long, before long")
    number = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    # every curve has each point once, so curve c begins at number c * n
    ranked = order.withColumn("part", part).join(F.broadcast(offsets), "part").select("curve", "rid", (number - F.col("curve") * F.lit(n)).alias("r"))
    window = window or fit_window(points, ranked, n, dim, k)
    size = min(max(window, LEAST_BLOCK), BLOCK)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = np.clip(_matrix(b.column(2), dim) - centre, -1e37, 1e37)
                most = np.maximum(np.abs(v).max(1), 1e-37)
                code = np.rint(v / most[:, None] * 127).astype(np.int8)
                scaled = (most / 127).astype("<f4")
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([s.tobytes() + c.tobytes() for s, c in zip(scaled, code, strict=True)], pa.binary())], names=["rid", "asks", "code"])

    placed = ranked.join(points.select("rid", "asks", "vec").mapInArrow(coded, "rid long, asks boolean, code binary"), "rid")
    block = F.floor(F.col("r") / size)
    blocks = math.ceil(n / size)
    owned = placed.select("curve", block.alias("block"), F.lit(False).alias("q"), "r", "rid", "code")
    near = F.sequence(F.greatest(F.lit(0).cast("long"), F.floor((F.col("r") - window) / size)), F.least(F.lit(blocks - 1).cast("long"), F.floor((F.col("r") + window) / size)))
    asked = placed.where("asks").select("curve", F.explode(near).alias("block"), F.lit(True).alias("q"), "r", "rid", "code")

    def vectors(codes: pa.Array) -> np.ndarray:
        raw = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(-1, dim + 4)
        return raw[:, 4:].copy().view(np.int8).astype(np.float32) * raw[:, :4].copy().view("<f4")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by curve, block and q: a block's vectors, then the queries near it."""
        last, held, kept = None, [], None

        def nearest(q: pa.RecordBatch) -> pa.RecordBatch:
            cv, c2, cr, ids = kept
            qv, qr = vectors(_column(q, "code")), np.array(_column(q, "r"))
            with np.errstate(over="ignore", invalid="ignore"):
                d = np.nan_to_num((qv * qv).sum(1)[:, None] + c2 - 2 * (qv @ cv.T), nan=np.inf)
            np.maximum(d, 0, out=d)
            outside = np.abs(cr - qr[:, None]) > window
            d[outside] = np.inf
            m = min(k + NEAR, d.shape[1])
            best = np.argpartition(d, m - 1, axis=1)[:, :m]
            rows = np.arange(len(d))[:, None]
            good = ~outside[rows, best]
            at = np.repeat(np.arange(len(d)), good.sum(1))
            return pa.RecordBatch.from_arrays([_column(q, "rid").take(pa.array(at)), pa.array(ids[best[good]]), pa.array(d[rows, best][good].astype(np.float64))], names=["qid", "rid", "near"])

        for b in batches:
            if not b.num_rows:
                continue
            curve, blk, is_query = (np.array(_column(b, x)) for x in ("curve", "block", "q"))
            key = np.stack([curve, blk, is_query]).T
            cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
            for x, y in zip(cut, np.append(cut[1:], len(key)), strict=True):
                piece, name = b.slice(int(x), int(y - x)), tuple(key[x, :2])
                if name != last:
                    last, held, kept = name, [], None
                if not key[x, 2]:
                    held.append(piece)
                    continue
                if kept is None:
                    t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    cv = vectors(_column(t, "code"))
                    kept = cv, (cv * cv).sum(1), np.array(_column(t, "r")), np.array(_column(t, "rid"))
                for a in range(0, piece.num_rows, QUERIES):
                    yield nearest(piece.slice(a, QUERIES))

    met = owned.unionByName(asked).repartition(parts, "curve", "block").sortWithinPartitions("curve", "block", "q").mapInArrow(compare, "qid long, rid long, near double")
    met = met.groupBy("qid", "rid").agg(F.min("near").alias("near"))
    met = met.withColumn("o", F.row_number().over(W.partitionBy("qid").orderBy("near", "rid"))).where(F.col("o") <= k + KEPT).select("qid", "rid")
    asks = points.where("asks").select(F.col("rid").alias("qid"), F.col("vec").alias("qvec"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = _matrix(_column(b, "vec"), dim) - _matrix(_column(b, "qvec"), dim)
                yield pa.RecordBatch.from_arrays([_column(b, "qid"), _column(b, "rid"), pa.array(np.sqrt((d * d).sum(1)))], names=["qid", "rid", "score"])

    met = met.join(asks, "qid").join(points.select("rid", "vec"), "rid").select("qid", "rid", "qvec", "vec").mapInArrow(measure, "qid long, rid long, score double")
    best = met.groupBy("qid", "rid").agg(F.min("score").alias("score"))
    best = best.unionByName(points.where("asks").select(F.col("rid").alias("qid"), "rid", F.lit(0.0).alias("score"))).groupBy("qid", "rid").agg(F.min("score").alias("score"))
    offered = best.join(points.select("rid", "ids"), "rid").select("qid", "score", F.explode("ids").alias("id"))
    top = offered.withColumn("o", F.row_number().over(W.partitionBy("qid").orderBy("score", "id"))).where(F.col("o") <= k + 1).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("score", "id"))).alias("found"))
    asking = rows.where(is_query).join(points.select(F.col("rid").alias("qid"), "vec"), "vec").select(F.col("id").alias("query_id"), "qid")
    answers = asking.join(top, "qid")
    # a query leaves out one row of its own id
    own = F.array_position(F.transform("found", lambda x: x["id"]), F.col("query_id")).cast("int")
    others = F.slice(F.filter("found", lambda x, i: (own == 0) | (i + 1 != own)), 1, k)
    return answers.select("query_id", F.posexplode(others).alias("rank", "x")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias("id"), F.col("x.score").alias("score"))
