"""Maximum spanning forests, branch pruning and diameters.

The forest is Borůvka's: in each round every component takes its heaviest
edge out, by joins and aggregates, and components meet.  Edges are in a total
order (weight down, then names up), so the forest is the one Kruskal's
algorithm finds in that order.  Components with few edges are left to Kruskal's
algorithm, each in one task; the rounds are for those that are too large for
that.  What follows works on trees, whose edges are one fewer than their
vertices; each tree is one group.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkmap.operators.components import connected_components, cut_lineage

Tree = dict[str, dict[str, int]]


#: Components with more edges than this are not given to one task.
LOCAL_EDGES = 200_000


def per_group(rows: DataFrame, run: Callable[[list[tuple]], list[tuple]], schema: str, key: str = "component") -> DataFrame:
    """run(rows of a group, without the key) for each group; groups stream through tasks, so many small ones cost little."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    other = [c for c in rows.columns if c != key]
    empty = spark.createDataFrame([], schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(empty.schema)

    def batch(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], f.type) for i, f in enumerate(arrow)], schema=arrow)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        found: list[tuple] = []
        for _, group in groupby(flat, key=lambda r: r[0]):
            found += run([r[1:] for r in group])
            if len(found) > 10_000:
                yield batch(found)
                found = []
        yield batch(found)

    return rows.select(key, *other).repartition(n, key).sortWithinPartitions(key).mapInArrow(stream, schema)


def kruskal(rows: list[tuple]) -> list[tuple]:
    """The maximum spanning forest of (u, v, m) rows, in the order of weight and names."""
    root: dict[str, str] = {}

    def find(x: str) -> str:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for u, v, m in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        a, b = find(u), find(v)
        if a != b:
            root[a] = b
            out.append((u, v, m))
    return out


def by_size(edges: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Edges with their component: those of components with at most so many edges, and the others."""
    comp = connected_components(edges).withColumnRenamed("id", "u")
    tagged = cut_lineage(edges.select("u", "v", "m").join(comp, "u").select("u", "v", "m", "component"), "components")
    large = tagged.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("component")
    return tagged.join(large, "component", "left_anti"), tagged.join(large, "component", "left_semi")


def simple(edges: DataFrame) -> DataFrame:
    """u < v, no loops, the heaviest of parallel edges."""
    return edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "m").where("u <> v").groupBy("u", "v").agg(F.max("m").alias("m"))


def spanning_forest(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(u, v, m) of the maximum spanning forest; of parallel edges the heaviest counts."""
    small, large = by_size(cut_lineage(simple(edges), "forest"), local_edges)
    done = per_group(small.select("component", F.col("u").cast("string").alias("u"), F.col("v").cast("string").alias("v"), F.col("m").cast("long").alias("m")), kruskal, "u string, v string, m long")
    if large.isEmpty():
        return done
    return done.unionByName(boruvka(large.select("u", "v", "m")))


def boruvka(edges: DataFrame) -> DataFrame:
    """The forest of simple edges, in rounds."""
    best = cut_lineage(edges, "forest")
    open_ = best.select("u", "v", "m", F.col("u").alias("cu"), F.col("v").alias("cv"))
    forest = best.limit(0)
    while True:
        key = F.struct((-F.col("m")).alias("w"), F.col("u"), F.col("v"))
        out = open_.select(F.explode(F.array("cu", "cv")).alias("c"), key.alias("e")).groupBy("c").agg(F.min("e").alias("e"))
        chosen = cut_lineage(out.select("e.u", "e.v", (-F.col("e.w")).alias("m")).distinct().join(open_.select("u", "v", "cu", "cv"), ["u", "v"]), "chosen")
        if chosen.isEmpty():
            return forest
        forest = cut_lineage(forest.unionByName(chosen.select("u", "v", "m")), "forest")
        parts = connected_components(chosen, u="cu", v="cv", vertex="c").withColumnRenamed("component", "p")
        step = open_.join(parts.select(F.col("c").alias("cu"), F.col("p").alias("pu")), "cu", "left").join(parts.select(F.col("c").alias("cv"), F.col("p").alias("pv")), "cv", "left")
        open_ = cut_lineage(step.select("u", "v", "m", F.coalesce("pu", "cu").alias("cu"), F.coalesce("pv", "cv").alias("cv")).where("cu <> cv"), "open")


def tree_of(rows) -> Tree:
    t: Tree = {}
    for u, v, m in rows:
        t.setdefault(u, {})[v] = m
        t.setdefault(v, {})[u] = m
    return t


def drop_nodes(t: Tree, nodes) -> None:
    for x in nodes:
        for y in t.pop(x, {}):
            t[y].pop(x, None)


def reach(t: Tree, start: str) -> list[str]:
    """All vertices that start reaches, nearest first."""
    seen, queue = {start: None}, deque([start])
    while queue:
        for y in sorted(t[queue.popleft()]):
            if y not in seen:
                seen[y] = None
                queue.append(y)
    return list(seen)


def parts(t: Tree) -> list[list[str]]:
    out, seen = [], set()
    for x in sorted(t):
        if x not in seen:
            p = reach(t, x)
            seen.update(p)
            out.append(p)
    return out


def branch_lengths(t: Tree) -> dict[tuple[str, str], int]:
    """For each edge taken from u to v: the vertices on the longest way from v that doesn't lead back."""
    out: dict[tuple[str, str], int] = {}
    for part in parts(t):
        up = {part[0]: None}
        for x in part:  # parents stand before children
            for y in t[x]:
                if y != up[x]:
                    up[y] = x
        for x in reversed(part[1:]):
            out[up[x], x] = 1 + max((out[x, y] for y in t[x] if y != up[x]), default=0)
        for x in part:
            ways = sorted(((out[x, y], y) for y in t[x] if (x, y) in out), reverse=True)
            for y in t[x]:
                if y != up[x]:
                    out[y, x] = 1 + next((n for n, z in ways if z != y), 0)
    return out


def prune(t: Tree, least: int) -> int:
    """Take away branches of fewer than least vertices at vertices of degree three and more, all at once, until none is left; returns the vertices gone."""
    gone = 0
    while least:
        short = [(u, v) for (u, v), n in branch_lengths(t).items() if len(t[u]) >= 3 and n < least]
        if not short:
            break
        for u, v in short:
            t[u].pop(v, None)
            t[v].pop(u, None)
        lost = {y for _, v in short if v in t for y in reach(t, v)}
        drop_nodes(t, lost)
        gone += len(lost)
    return gone


def farthest(t: Tree, start: str, inside: set[str]) -> tuple[str, dict[str, str | None]]:
    """The vertex of the greatest total weight from start, the least name of several, and the way back."""
    far, back = {start: 0}, {start: None}
    queue = deque([start])
    while queue:
        x = queue.popleft()
        for y, m in t[x].items():
            if y in inside and y not in far:
                far[y], back[y] = far[x] + m, x
                queue.append(y)
    return min(far, key=lambda x: (-far[x], x)), back


def diameter(t: Tree, nodes) -> list[str]:
    """The heaviest path of a tree, weights as lengths, from its end with the lesser name."""
    inside = set(nodes)
    a, _ = farthest(t, min(inside), inside)
    b, back = farthest(t, a, inside)
    path = [b]
    while back[path[-1]] is not None:
        path.append(back[path[-1]])
    return path if path[0] <= path[-1] else path[::-1]


def per_tree(forest: DataFrame, run: Callable[[Tree], list[tuple]], schema: str) -> DataFrame:
    """run(tree) for each tree of a forest."""
    comp = connected_components(forest).withColumnsRenamed({"id": "u", "component": "tree"})
    return per_group(forest.join(comp, "u").select("tree", "u", "v", "m"), lambda rows: run(tree_of(rows)), schema, "tree")


def pruned_forest(edges: DataFrame, least: int) -> DataFrame:
    """The spanning forest's edges that pruning leaves."""

    def run(t: Tree) -> list[tuple]:
        prune(t, least)
        return [(u, v, m) for u in t for v, m in t[u].items() if u < v]

    return per_tree(spanning_forest(edges), run, "u string, v string, m long")
