"""Communities in ego networks: what a group's neighbours say about how many molecules it mixes."""

from __future__ import annotations

import hashlib
import logging
from collections import deque
from collections.abc import Iterator
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkmap.types import MoleculeParams

log = logging.getLogger(__name__)
Nodes = list[int]


def ego_edges(edges: DataFrame) -> DataFrame:
    """(ego, a, b), a < b: edges among the neighbours of each vertex, which are its triangles.

    Edges point from the vertex of lesser degree, so a hub has few outgoing
    ones and no vertex forms pairs of all of its neighbours.
    """
    both = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x")), F.struct(F.col("v").alias("x")))).alias("s")).select("s.x")
    degree = both.groupBy("x").agg(F.count(F.lit(1)).alias("d"))
    e = edges.select("u", "v").join(degree.withColumnsRenamed({"x": "u", "d": "du"}), "u").join(degree.withColumnsRenamed({"x": "v", "d": "dv"}), "v")
    up = F.struct("du", "u") < F.struct(F.col("dv").alias("du"), F.col("v").alias("u"))
    directed = e.select(F.when(up, F.col("u")).otherwise(F.col("v")).alias("x"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("y"))
    a, b = directed.select("x", F.col("y").alias("y1")), directed.select("x", F.col("y").alias("y2"))
    wedges = a.join(b, "x").where(F.col("y1") < F.col("y2"))
    closed = wedges.join(edges.select(F.col("u").alias("y1"), F.col("v").alias("y2")), ["y1", "y2"], "left_semi")
    t = F.sort_array(F.array("x", "y1", "y2"))
    ordered = closed.select(t[0].alias("p"), t[1].alias("q"), t[2].alias("r"))
    sides = F.array(*[F.struct(F.col(e).alias("ego"), F.col(x).alias("a"), F.col(y).alias("b")) for e, x, y in (("p", "q", "r"), ("q", "p", "r"), ("r", "p", "q"))])
    return ordered.select(F.explode(sides).alias("s")).select("s.*")


class Ego:
    """A local graph over 0..n-1 as neighbour sets."""

    def __init__(self, n: int, pairs):
        self.adj: list[set[int]] = [set() for _ in range(n)]
        for a, b in pairs:
            self.adj[a].add(b)
            self.adj[b].add(a)


def cc(g: Ego, nodes: Nodes) -> list[Nodes]:
    """Connected parts of the graph on nodes, by their least members."""
    left, out = set(nodes), []
    for s in sorted(nodes):
        if s not in left:
            continue
        left.discard(s)
        part, queue = [s], deque([s])
        while queue:
            for y in g.adj[queue.popleft()] & left:
                left.discard(y)
                part.append(y)
                queue.append(y)
        out.append(sorted(part))
    return out


def articulation_points(g: Ego, nodes: Nodes) -> set[int]:
    inside = set(nodes)
    entry: dict[int, int] = {}
    low: dict[int, int] = {}
    cut: set[int] = set()
    for root in nodes:
        if root in entry:
            continue
        entry[root] = low[root] = len(entry)
        frames = [(root, None, iter(g.adj[root] & inside))]
        top_branches = 0
        while frames:
            x, up, todo = frames[-1]
            y = next(todo, None)
            if y is not None:
                if y not in entry:
                    entry[y] = low[y] = len(entry)
                    frames.append((y, x, iter(g.adj[y] & inside)))
                elif y != up:
                    low[x] = min(low[x], entry[y])
                continue
            frames.pop()
            if up is None:
                continue
            low[up] = min(low[up], low[x])
            if up == root:
                top_branches += 1
            elif low[x] >= entry[up]:
                cut.add(up)
        if top_branches > 1:
            cut.add(root)
    return cut


def bc(g: Ego, nodes: Nodes) -> list[Nodes]:
    """Connected parts without the articulation points, which belong to none."""
    if len(nodes) < 2:
        return [list(nodes)]
    cut = articulation_points(g, nodes)
    return cc(g, [x for x in nodes if x not in cut])


def k3(g: Ego, nodes: Nodes) -> list[Nodes]:
    """Unions of triangles that share edges; parts may overlap in nodes."""
    inside = set(nodes)
    parent: dict[tuple[int, int], tuple[int, int]] = {}

    def find(e: tuple[int, int]) -> tuple[int, int]:
        while parent.setdefault(e, e) != e:
            parent[e] = parent[parent[e]]
            e = parent[e]
        return e

    for x in sorted(inside):
        later = sorted(y for y in g.adj[x] & inside if y > x)
        for y, z in combinations(later, 2):
            if z in g.adj[y]:
                a = find((x, y))
                parent[find((x, z))] = a
                parent[find((y, z))] = a
    parts: dict[tuple[int, int], set[int]] = {}
    for e in list(parent):
        parts.setdefault(find(e), set()).update(e)
    return sorted((sorted(p) for p in parts.values()), key=lambda p: (p[0], p))


def sqcos(g: Ego, nodes: Nodes, threshold: float, skip_small: int) -> list[Nodes]:
    """Connected parts after edges go whose ends' rows of the squared adjacency matrix have a cosine below the threshold."""
    if len(nodes) < skip_small or len(nodes) <= 1:
        return [list(nodes)]
    place = {x: i for i, x in enumerate(nodes)}
    a = np.zeros((len(nodes), len(nodes)), np.float32)
    for x in nodes:
        for y in g.adj[x]:
            if y in place:
                a[place[x], place[y]] = 1
    squared = a @ a
    norm = np.sqrt((squared * squared).sum(1))
    scale = norm[:, None] * norm
    cosine = np.divide(squared @ squared.T, scale, out=np.zeros_like(a), where=scale > 0)
    kept = (a > 0) & (cosine >= np.float32(threshold))
    small = Ego(len(nodes), zip(*np.nonzero(kept), strict=True))
    return [[nodes[int(i)] for i in p] for p in cc(small, list(range(len(nodes))))]


def bins(nodes: Nodes, largest: int, seed: int) -> list[Nodes]:
    """Nodes in a keyed random order, dealt into 1 + n div largest bins of about equal size; one bin keeps its order."""
    n = 1 + len(nodes) // largest
    if n == 1:
        return [list(nodes)]
    key = seed + nodes[0]
    order = sorted(nodes, key=lambda x: hashlib.blake2b(f"{key}:{x}".encode(), digest_size=8).digest())
    size = len(nodes) // n
    out = [order[i * size : (i + 1) * size] for i in range(n)]
    for i, x in enumerate(order[n * size :]):
        out[i % n].append(x)
    return out


def merge(g: Ego, parts: list[Nodes], cutoff: int) -> list[Nodes]:
    """Unions of parts with more than cutoff adjacencies between them; members of several stay as often; -1 merges nothing."""
    if cutoff == -1 or len(parts) <= 1:
        return [list(p) for p in parts]
    parent = list(range(len(parts)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in combinations(range(len(parts)), 2):
        if sum(y in g.adj[x] for x in parts[i] for y in parts[j]) > cutoff:
            parent[max(find(i), find(j))] = min(find(i), find(j))
    out: dict[int, Nodes] = {}
    for i, p in enumerate(parts):
        out.setdefault(find(i), []).extend(p)
    return list(out.values())


def k3bin(g: Ego, nodes: Nodes, p: MoleculeParams) -> list[Nodes]:
    return merge(g, [c for b in bins(nodes, p.bin_size, p.seed) for c in k3(g, b)], p.merge_cutoff)


def sqcosbin(g: Ego, nodes: Nodes, p: MoleculeParams) -> list[Nodes]:
    return merge(g, [c for b in bins(nodes, p.bin_size, p.seed) for c in sqcos(g, b, p.square_threshold, p.skip_small)], p.merge_cutoff)


def distributed(g: Ego, nodes: Nodes, p: MoleculeParams) -> list[Nodes]:
    out = []
    for part in bc(g, nodes):
        inner = [c for b in (bins(part, p.bin_size, p.seed) if part else []) for i in bc(g, b) for c in k3(g, i)]
        out += merge(g, inner, p.merge_cutoff)
    return out


STRATEGIES = {
    "cc": lambda g, n, p: cc(g, n),
    "bc": lambda g, n, p: bc(g, n),
    "k3": lambda g, n, p: k3(g, n),
    "sqcos": lambda g, n, p: sqcos(g, n, p.square_threshold, p.skip_small),
    "k3bin": k3bin,
    "sqcosbin": sqcosbin,
    "distributed": distributed,
}


def parse_strategy(text: str) -> list[str]:
    """Names joined by +; unknown ones are left out with a warning."""
    out = []
    for part in (x.strip() for x in text.split("+")):
        if part in STRATEGIES:
            out.append(part)
        elif part:
            log.warning("unknown strategy %s is left out", part)
    return out


def communities(g: Ego, nodes: Nodes, p: MoleculeParams, trace: list | None = None) -> list[Nodes]:
    """All nodes as one community, taken through the chain of strategies (bc+cc if it names none)."""
    found = [list(nodes)]
    for name in parse_strategy(p.strategy) or ["bc", "cc"]:
        found = [c for part in found if part for c in STRATEGIES[name](g, part, p)]
        if trace is not None:
            trace.append((name, sorted(map(len, found), reverse=True)))
    return found


def assignment(found: list[Nodes]) -> dict[int, int]:
    """Molecule numbers: communities by size, then by least member; those of one node give none; a node of several goes to the first."""
    out: dict[int, int] = {}
    for i, c in enumerate(sorted(found, key=lambda c: (-len(c), min(c, default=0)))):
        if len(c) > 1:
            for x in c:
                out.setdefault(x, i)
    return out


def _ego_rows(edges: DataFrame) -> DataFrame:
    """Neighbour rows (b null) and ego edge rows, sorted by ego within partitions."""
    sides = F.array(F.struct(F.col("u").alias("ego"), F.col("v").alias("a")), F.struct(F.col("v").alias("ego"), F.col("u").alias("a")))
    neighbours = edges.select(F.explode(sides).alias("s")).select("s.ego", "s.a", F.lit(None).cast("string").alias("b"))
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return neighbours.unionByName(ego_edges(edges)).repartition(n, "ego").sortWithinPartitions("ego", F.col("b").isNotNull(), "a", "b")


def _egos(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str], Ego]]:
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for ego, group in groupby(rows, key=lambda r: r[0]):
        names: list[str] = []
        place: dict[str, int] = {}
        pairs = []
        for _, a, b in group:
            if b is None:
                place.setdefault(a, len(names))
                if len(place) > len(names):
                    names.append(a)
            else:
                pairs.append((place[a], place[b]))
        yield ego, names, Ego(len(names), pairs)


def assign_molecules(edges: DataFrame, params: MoleculeParams | None = None, junctions: DataFrame | None = None) -> DataFrame:
    """(u, v, mol): the molecule of u that its neighbour v belongs to.

    A vertex listed in junctions (column id) has all neighbours in molecule 0
    if it has more than one.
    """
    p = params or MoleculeParams()
    plain = edges.select(F.col("u").cast("string").alias("u"), F.col("v").cast("string").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v, m = [], [], []
        for ego, names, g in _egos(batches):
            for x, mol in assignment(communities(g, list(range(len(names))), p)).items():
                u.append(ego)
                v.append(names[x])
                m.append(mol)
            if len(u) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.string()), pa.array(v, pa.string()), pa.array(m, pa.int64())], names=["u", "v", "mol"])
                u, v, m = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.string()), pa.array(v, pa.string()), pa.array(m, pa.int64())], names=["u", "v", "mol"])

    found = _ego_rows(plain).mapInArrow(run, "u string, v string, mol long")
    if junctions is None:
        return found
    sides = plain.unionByName(plain.select(F.col("v").alias("u"), F.col("u").alias("v")))
    many = sides.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(junctions.select(F.col("id").alias("u")), "u", "left_semi").select("u")
    whole = sides.join(many, "u", "left_semi").select("u", "v", F.lit(0).cast("long").alias("mol"))
    return found.join(junctions.select(F.col("id").alias("u")), "u", "left_anti").unionByName(whole)


def trace_molecules(edges: DataFrame, params: MoleculeParams | None = None) -> DataFrame:
    """(ego, step, strategy, sizes): community sizes after each strategy of the chain."""
    p = params or MoleculeParams(strategy="distributed+sqcosbin")
    plain = edges.select(F.col("u").cast("string").alias("u"), F.col("v").cast("string").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ego, names, g in _egos(batches):
            steps: list = []
            communities(g, list(range(len(names))), p, steps)
            yield pa.RecordBatch.from_arrays([pa.array([ego] * len(steps)), pa.array(range(len(steps)), pa.int32()), pa.array([s for s, _ in steps]), pa.array([n for _, n in steps], pa.list_(pa.int64()))], names=["ego", "step", "strategy", "sizes"])

    return _ego_rows(plain).mapInArrow(run, "ego string, step int, strategy string, sizes array<long>")


def ego_components(edges: DataFrame) -> DataFrame:
    """(ego, a, part): components of each ego network, named by their least member; all communities of strategy cc."""
    plain = edges.select(F.col("u").cast("string").alias("u"), F.col("v").cast("string").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ego, names, g in _egos(batches):
            rows = [(names[x], names[min(c, key=lambda i: names[i])]) for c in cc(g, list(range(len(names)))) for x in c]
            yield pa.RecordBatch.from_arrays([pa.array([ego] * len(rows)), pa.array([a for a, _ in rows]), pa.array([b for _, b in rows])], names=["ego", "a", "part"])

    return _ego_rows(plain).mapInArrow(run, "ego string, a string, part string")
