"""Backbone paths of a molecule graph."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkmap.operators import forest as T
from linkmap.operators.components import cut_lineage
from linkmap.operators.numbers import row_numbers
from linkmap.types import BackboneParams


def bridges(t: T.Tree, length: int) -> set[str]:
    """Vertices of short unbranched stretches between junctions, and of edges from junction to junction."""
    junction = {x for x in t if len(t[x]) >= 3}
    rest = {x: {y: m for y, m in t[x].items() if y not in junction} for x in t if x not in junction}
    out = {x for p in T.parts(rest) if len(p) < length and all(len(t[x]) == 2 for x in p) for x in p}
    return out | {x for x in junction if any(y in junction for y in t[x])}


def _without_bridges(rows: list[tuple], length: int, branch: int) -> list[tuple]:
    """The same for one component's edges in memory."""
    while True:
        t = T.tree_of(T.kruskal(rows))
        T.prune(t, branch)
        gone = bridges(t, length)
        if not gone:
            return rows
        rows = [r for r in rows if r[0] not in gone and r[1] not in gone]


def remove_bridges(edges: DataFrame, length: int, branch: int, local_edges: int = T.LOCAL_EDGES) -> DataFrame:
    """Edges of the graph without bridge vertices, found and taken out in the pruned forest until it has none."""
    small, edges = T.by_size(cut_lineage(T.simple(edges), "edges"), local_edges)
    done = T.per_group(small.select("component", "u", "v", F.col("m").cast("long").alias("m")), lambda rows: _without_bridges(rows, length, branch), "u string, v string, m long")
    edges = edges.select("u", "v", "m")
    if edges.isEmpty():
        return done
    while True:

        def run(t: T.Tree) -> list[tuple]:
            T.prune(t, branch)
            return [(x,) for x in bridges(t, length)]

        found = cut_lineage(T.per_tree(T.spanning_forest(edges, local_edges), run, "id string"), "bridges")
        if found.isEmpty():
            return done.unionByName(edges)
        edges = cut_lineage(edges.join(found.withColumnRenamed("id", "u"), "u", "left_anti").join(found.withColumnRenamed("id", "v"), "v", "left_anti").select("u", "v", "m"), "edges")


def junctions(t: T.Tree, part: list[str], least: int) -> set[str]:
    """Vertices with three branches or more of at least so many vertices."""
    size = T.branch_lengths({x: t[x] for x in part})
    return {x for x in part if len(t[x]) >= 3 and sum(size[x, y] >= least for y in t[x]) >= 3}


def paths_of_tree(t: T.Tree, junction_size: int) -> list[list[str]]:
    """One round: each tree's heaviest path, or, where it has junctions, those of the pieces without the junctions' edges."""
    out = []
    for part in T.parts(t):
        cut = junctions(t, part, junction_size) if junction_size > 0 and len(part) > 1 else set()
        if not cut:
            out.append(T.diameter(t, part))
            continue
        pieces = {x: {} if x in cut else {y: m for y, m in t[x].items() if y not in cut} for x in part}
        out += [T.diameter(pieces, p) for p in T.parts(pieces)]
    return out


def peel(t: T.Tree, p: BackboneParams) -> list[list[str]]:
    """Take paths out of a tree until nothing is left; those that are long enough count."""
    out = []
    while t:
        found = paths_of_tree(t, p.prune_junction_size)
        out += [x for x in found if len(x) >= p.prune_branch_size]
        T.drop_nodes(t, [x for path in found for x in path])
    return out


def numbered(paths: DataFrame) -> DataFrame:
    """(tid, tpos, mol) of rows with arrays, longest first, then by first name.

    Only names and lengths of paths are put in order; there are far fewer paths
    than molecules.
    """
    heads = paths.select(F.size("path").alias("n"), F.element_at("path", 1).alias("head"), F.element_at("path", -1).alias("tail"))
    tid = row_numbers(heads, [F.desc("n"), "head", "tail"], "tid")
    body = paths.select(F.element_at("path", 1).alias("head"), F.posexplode("path").alias("tpos", "mol"))
    return tid.select("head", "tid").join(body, "head").select("tid", F.col("tpos").cast("long").alias("tpos"), "mol")


def raw_backbones(edges: DataFrame, params: BackboneParams | None = None) -> DataFrame:
    """(tid, tpos, mol) before paths are merged."""
    p = params or BackboneParams()
    e = edges.select(F.col("u").cast("string").alias("u"), F.col("v").cast("string").alias("v"), F.col("m").cast("long").alias("m"))
    if p.prune_bridge_size > 0:
        e = remove_bridges(e, p.prune_bridge_size, p.prune_branch_size)

    def run(t: T.Tree) -> list[tuple]:
        T.prune(t, p.prune_branch_size)
        return [(x,) for x in peel(t, p)]

    return numbered(cut_lineage(T.per_tree(T.spanning_forest(e), run, "path array<string>"), "paths"))


def adjacent_ends(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, a_last, b_last): ends of different paths that touch, or that a vertex on no path touches both."""
    size = paths.groupBy("tid").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    ends = paths.join(size, "tid").where((F.col("tpos") == 0) | (F.col("tpos") == F.col("n") - 1)).select(F.col("mol").alias("x"), "tid", (F.col("tpos") > 0).alias("last"))
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    free = both.join(paths.select(F.col("mol").alias("v")), "v", "left_anti")
    from_end = ends.withColumnsRenamed({"x": "u", "tid": "a", "last": "a_last"})
    to_end = ends.withColumnsRenamed({"x": "v", "tid": "b", "last": "b_last"})
    direct = both.join(from_end, "u").join(to_end, "v")
    hop = free.join(from_end, "u").select(F.col("v").alias("w"), "a", "a_last").join(both.withColumnsRenamed({"u": "w"}), "w").join(to_end, "v")
    keep = ["a", "b", "a_last", "b_last"]
    return direct.select(*keep).unionByName(hop.select(*keep)).where("a <> b").distinct()


def chain_adjacent(sizes: dict[int, int], links: list[tuple], fix_direction: bool = True) -> list[list[tuple[int, bool]]]:
    """Chains of (path, reversed) by greedy joins of the longest first, without cycles.

    A chain follows an end that its path has not been entered by, if
    fix_direction; else any join, and the first path is never turned.
    """
    root = {i: i for i in sizes}

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    joins: dict[int, list[tuple[bool, int, bool]]] = defaultdict(list)
    used: set[tuple[int, bool]] = set()
    for a, b, a_last, b_last in sorted(links, key=lambda x: (-min(sizes[x[0]], sizes[x[1]]), x)):
        if find(a) == find(b) or fix_direction and ((a, a_last) in used or (b, b_last) in used):
            continue
        used |= {(a, a_last), (b, b_last)}
        root[find(a)] = find(b)
        joins[a].append((a_last, b, b_last))
        joins[b].append((b_last, a, a_last))
    out, seen = [], set()
    for start in sorted(sizes, key=lambda i: (len(joins[i]) > 1, i)):
        if start in seen:
            continue
        turned = fix_direction and bool(joins[start]) and not joins[start][0][0]
        chain, at = [], start
        while True:
            seen.add(at)
            chain.append((at, turned))
            leave = not turned
            nxt = next(((p, e) for mine, p, e in joins[at] if p not in seen and (mine == leave or not fix_direction)), None)
            if nxt is None:
                break
            at, turned = nxt
        out.append(chain)
    return out


def _rebuilt(spark: SparkSession, paths: DataFrame, chains: list[list[tuple[int, bool]]], min_size: int) -> DataFrame:
    rows = [(c, k, tid, turned) for c, chain in enumerate(chains) for k, (tid, turned) in enumerate(chain)]
    plan = spark.createDataFrame(rows, "chain long, k long, tid long, turned boolean") if rows else spark.createDataFrame([], "chain long, k long, tid long, turned boolean")
    placed = paths.join(plan, "tid")  # a row for each path: Spark broadcasts it while it is small
    where = F.when(F.col("turned"), -F.col("tpos")).otherwise(F.col("tpos"))
    arrays = placed.groupBy("chain").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", where.alias("p"), "mol"))), lambda x: x["mol"]).alias("path"))
    return numbered(cut_lineage(arrays.where(F.size("path") >= min_size), "paths"))


def merge_adjacent(paths: DataFrame, edges: DataFrame, min_size: int, fix_direction: bool = True) -> DataFrame:
    """Paths joined where their ends are adjacent; a single path stays whatever its size.

    The joins are found on the executors; the greedy choice among paths, of
    which there are few, is the driver's.
    """
    sizes = {r["tid"]: r["n"] for r in paths.groupBy("tid").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) <= 1:
        return paths
    links = [tuple(r) for r in adjacent_ends(paths, edges).where("a < b").collect()]
    return _rebuilt(paths.sparkSession, paths, chain_adjacent(sizes, links, fix_direction), min_size)


def backbones(edges: DataFrame, params: BackboneParams | None = None, fix_direction: bool = True) -> DataFrame:
    """(tid, tpos, mol) of all backbone paths."""
    p = params or BackboneParams()
    return merge_adjacent(raw_backbones(edges, p), edges, p.min_path_size, fix_direction)
