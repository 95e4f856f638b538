"""Paths merged by the evidence of molecules that bridge their ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkmap.operators.backbone import _rebuilt
from linkmap.types import MergeParams


def path_sizes(paths: DataFrame) -> DataFrame:
    return paths.groupBy("tid").agg(F.count(F.lit(1)).alias("n"))


def path_ends(paths: DataFrame, depth: int) -> DataFrame:
    """(mol, tid, is_end) of the first and last molecules of each path; a molecule in both counts for the end."""
    p = paths.join(path_sizes(paths), "tid")
    end = F.col("tpos") >= F.col("n") - depth
    return p.where((F.col("tpos") < depth) | end).select("mol", "tid", end.alias("is_end"))


def bridge_evidence(paths: DataFrame, inc: DataFrame, p: MergeParams) -> DataFrame:
    """(a, a_end, b, b_end, bridges), a < b: molecules on no path that speak for joining two ends; inc is (mol, mx)."""
    ends = path_ends(paths, p.endpoint_depth)
    end_mx = ends.join(inc, "mol").withColumnRenamed("mol", "end_mol")
    free = inc.join(paths.select("mol"), "mol", "left_anti")
    hits = free.join(end_mx, "mx").groupBy("mol", "end_mol", "tid", "is_end").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= p.min_shared_mx)
    strong = hits.groupBy("mol", "tid", "is_end").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= p.min_endpoint_hits)
    spans = strong.groupBy("mol").agg(F.count_distinct("tid").alias("paths")).where((F.col("paths") >= 2) & (F.col("paths") <= p.max_path_connections)).select("mol")
    good = strong.join(spans, "mol", "left_semi")  # at most two ends of max_path_connections paths for each molecule
    x, y = good.select("mol", F.col("tid").alias("a"), F.col("is_end").alias("a_end")), good.select("mol", F.col("tid").alias("b"), F.col("is_end").alias("b_end"))
    return x.join(y, "mol").where("a < b").groupBy("a", "a_end", "b", "b_end").agg(F.count_distinct("mol").alias("bridges"))


def merge_links(paths: DataFrame, inc: DataFrame, p: MergeParams) -> DataFrame:
    """Links that are strong enough and whose ends have few of them."""
    size = path_sizes(paths)
    e = bridge_evidence(paths, inc, p).where(F.col("bridges") >= p.min_bridges)
    e = e.join(size.withColumnsRenamed({"tid": "a", "n": "na"}), "a").join(size.withColumnsRenamed({"tid": "b", "n": "nb"}), "b")
    e = e.where((F.least("na", "nb") >= p.min_path_size))
    if p.min_bridge_density > 0:
        e = e.where(F.col("bridges") / F.least("na", "nb") >= p.min_bridge_density)
    ends = e.select(F.explode(F.array(F.struct(F.col("a").alias("t"), F.col("a_end").alias("x")), F.struct(F.col("b").alias("t"), F.col("b_end").alias("x")))).alias("s")).groupBy("s.t", "s.x").agg(F.count(F.lit(1)).alias("c"))
    few = ends.where(F.col("c") <= p.max_links_per_endpoint)
    one, two = few.select(F.col("t").alias("a"), F.col("x").alias("a_end")), few.select(F.col("t").alias("b"), F.col("x").alias("b_end"))
    return e.join(one, ["a", "a_end"], "left_semi").join(two, ["b", "b_end"], "left_semi").select("a", "a_end", "b", "b_end", "bridges")


def choose(sizes: dict[int, int], links: list[tuple]) -> dict[tuple[int, bool], tuple[int, bool]]:
    """Joins by most bridges first, one to an end, without cycles."""
    root = {i: i for i in sizes}

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out: dict[tuple[int, bool], tuple[int, bool]] = {}
    for a, a_end, b, b_end, _ in sorted(links, key=lambda x: (-x[4], x)):
        if (a, a_end) in out or (b, b_end) in out or find(a) == find(b):
            continue
        out[a, a_end], out[b, b_end] = (b, b_end), (a, a_end)
        root[find(a)] = find(b)
    return out


def chains_of(sizes: dict[int, int], joins: dict, fix_direction: bool, min_size: int = 0) -> list[list[tuple[int, bool]]]:
    """Chains of (path, reversed) along joins.

    With fix_direction a chain begins at an end without a join and is walked
    through, so every join is followed.  Without it a chain is looked for
    through starts only and always walked from a path's own start, which
    leaves paths alone that meet start to start.
    """
    out, seen = [], set()

    def walk(at: int, turned: bool) -> list[tuple[int, bool]]:
        chain = []
        while at not in seen:
            seen.add(at)
            chain.append((at, turned))
            nxt = joins.get((at, not turned))
            if nxt is None:
                break
            at, turned = nxt
        return chain

    for i in sorted(sizes):
        if i in seen or (i, False) not in joins and (i, True) not in joins:
            continue
        if fix_direction:
            at, turned, back = i, False, {i}
            while (prev := joins.get((at, turned))) and prev[0] not in back:
                back.add(prev[0])
                at, turned = prev[0], not prev[1]
            out.append(walk(at, turned))
        elif sizes[i] >= min_size:
            at, back = i, {i}
            while (prev := joins.get((at, False))) and prev[0] not in back and prev[0] not in seen:
                back.add(prev[0])
                at = prev[0]
            out.append(walk(at, False))
    return out + [[(i, False)] for i in sorted(sizes) if i not in seen]


def merge_paths(paths: DataFrame, inc: DataFrame, params: MergeParams | None = None) -> DataFrame:
    """(tid, tpos, mol) after paths are merged; evidence is gathered on the executors, the choice among links is the driver's."""
    p = params or MergeParams()
    links = [tuple(r) for r in merge_links(paths, inc, p).collect()]
    if not links:
        return paths
    sizes = {r["tid"]: r["n"] for r in path_sizes(paths).collect()}
    return _rebuilt(paths.sparkSession, paths, chains_of(sizes, choose(sizes, links), p.fix_direction, p.min_path_size), 0)


def links_by_end(links: DataFrame) -> DataFrame:
    """How many links each end has."""
    w = W.partitionBy("tid", "is_end")
    sides = links.select(F.explode(F.array(F.struct(F.col("a").alias("tid"), F.col("a_end").alias("is_end")), F.struct(F.col("b").alias("tid"), F.col("b_end").alias("is_end")))).alias("s")).select("s.*")
    return sides.withColumn("n", F.count(F.lit(1)).over(w)).distinct()
