"""Graph operators against plain models on random graphs, trees and paths."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkmap.operators import backbone, components, ego, filters, forest, merge, molecules, overlap
from linkmap.types import BackboneParams, MergeParams, MoleculeParams, with_defaults


def random_graph(rng, n, p):
    return ego.Ego(n, [(a, b) for a in range(n) for b in range(a) if rng.random() < p])


def random_tree(rng, n, weights=(1, 2, 3)):
    """n vertices t00, t01...: a tree, by each vertex's choice of an earlier one, mostly a near one."""
    rows = [(f"t{rng.randrange(max(0, i - rng.choice([1, 1, 3, i])), i):02}", f"t{i:02}", rng.choice(weights)) for i in range(1, n)]
    return forest.tree_of(rows)


def united(parts):
    """Sets that overlap, joined until none do."""
    parts = [set(p) for p in parts]
    out = []
    while parts:
        p = parts.pop()
        while meet := [q for q in parts if p & q]:
            for q in meet:
                p |= q
                parts.remove(q)
        out.append(p)
    return out


def edges(spark, rows):
    return spark.createDataFrame(rows, "u string, v string, m long")


def test_components_of_a_path_and_loops(spark):
    rows = [(f"n{i:03}", f"n{i + 1:03}", 1) for i in range(50)] + [("z", "z", 1), ("x", "y", 1), ("y", "x", 1)]
    v = spark.createDataFrame([("lonely",), ("x",), ("n004",)], "id string")
    got = {r.id: r.component for r in components.connected_components(edges(spark, rows), v).collect()}
    assert got == {"lonely": "lonely", "x": "x", "n004": "n000"}


def test_communities_equal_their_definitions():
    rng = random.Random(11)
    for _ in range(150):
        g = random_graph(rng, rng.randint(1, 14), rng.choice([0.1, 0.25, 0.5, 0.8]))
        nodes = sorted(rng.sample(range(len(g.adj)), rng.randint(1, len(g.adj))))
        pairs = [{x, y} for x, y in combinations(nodes, 2) if y in g.adj[x]]
        assert sorted(ego.cc(g, nodes)) == sorted(map(sorted, united(pairs + [{x} for x in nodes])))
        # triangles as sets of edges: those that share one are one part
        triangles = [{(x, y), (x, z), (y, z)} for x, y, z in combinations(nodes, 3) if y in g.adj[x] and z in g.adj[x] and z in g.adj[y]]
        assert sorted(ego.k3(g, nodes)) == sorted(sorted({x for e in t for x in e}) for t in united(triangles))
        for threshold, least in ((0.3, 1), (0.75, 4)):
            m = np.array([[float(y in g.adj[x]) for y in nodes] for x in nodes])
            two = m @ m
            norm = np.maximum(np.linalg.norm(two, axis=1), 1e-30)
            cosine = two @ two.T / norm[:, None] / norm
            near = abs(cosine - threshold) < 1e-6
            if len(nodes) < max(least, 2):
                assert ego.sqcos(g, nodes, threshold, least) == [nodes]
            elif not (near & (m > 0)).any():
                kept = [{nodes[i], nodes[j]} for i, j in zip(*np.nonzero((m > 0) & (cosine >= threshold)), strict=True)]
                assert sorted(map(sorted, ego.sqcos(g, nodes, threshold, least))) == sorted(map(sorted, united(kept + [{x} for x in nodes])))
        parts = [rng.sample(nodes, rng.randint(1, len(nodes))) for _ in range(rng.randint(0, 5))]
        cutoff = rng.choice([-1, 0, 1, 3, 8])
        joined = [{i, j} for i, j in combinations(range(len(parts)), 2) if cutoff >= 0 and sum(y in g.adj[x] for x in parts[i] for y in parts[j]) > cutoff]
        want = sorted(sorted(x for i in u for x in parts[i]) for u in united(joined + [{i} for i in range(len(parts))]))
        assert sorted(sorted(p) for p in ego.merge(g, parts, cutoff)) == want


def test_bins_deal_all_nodes_evenly():
    rng = random.Random(5)
    for _ in range(60):
        nodes, largest, seed = sorted(rng.sample(range(500), rng.randint(1, 120))), rng.randint(2, 40), rng.randrange(1000)
        b = ego.bins(nodes, largest, seed)
        assert len(b) == 1 + len(nodes) // largest and sorted(x for p in b for x in p) == nodes
        assert max(map(len, b)) - min(map(len, b)) <= 1 and b == ego.bins(nodes, largest, seed)
    assert ego.bins(list(range(90)), 30, 1) != ego.bins(list(range(90)), 30, 2)


def test_assignment_goes_by_size_and_least_member():
    rng = random.Random(6)
    for _ in range(200):
        found = [sorted(rng.sample(range(20), rng.randint(1, 6))) for _ in range(rng.randint(0, 6))]
        order = sorted(found, key=lambda c: (-len(c), c[0]))
        want = {x: min(i for i, c in enumerate(order) if x in c and len(c) > 1) for x in range(20) if any(x in c and len(c) > 1 for c in order)}
        assert ego.assignment(found) == want
    assert ego.parse_strategy("k3 + what+cc") == ["k3", "cc"] and ego.parse_strategy(" ") == []


def test_bc_alone_equals_bc_then_cc():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 12)
        g = ego.Ego(n, [(a, b) for a in range(n) for b in range(a) if rng.random() < 0.3])
        nodes = list(range(n))
        cut = {x for x in nodes if len(ego.cc(g, [y for y in nodes if y != x])) > len(ego.cc(g, nodes)) - (not g.adj[x])}
        if n > 1:
            assert ego.bc(g, nodes) == ego.cc(g, [x for x in nodes if x not in cut])
            assert sorted(ego.communities(g, nodes, MoleculeParams(strategy="bc+cc"))) == sorted(ego.bc(g, nodes))


def test_assignment_and_molecules(spark):
    e = edges(spark, [("c", x, 5) for x in "de"] + [("a", "c", 5), ("b", "c", 5), ("c", "f", 5)] + [("a", "b", 5), ("d", "e", 5)])
    got = {r.v: r.mol for r in ego.assign_molecules(e, MoleculeParams(strategy="cc")).where("u = 'c'").collect()}
    assert got == {"a": 0, "b": 0, "d": 1, "e": 1}
    j = ego.assign_molecules(e, MoleculeParams(strategy="cc"), spark.createDataFrame([("c",)], "id string")).where("u = 'c'").collect()
    assert {r.mol for r in j} == {0} and len(j) == 5
    v, m = molecules.molecule_graph(spark.createDataFrame([(x, 9) for x in "abcde"], "id string, m long"), e, ego.assign_molecules(e, MoleculeParams(strategy="cc")))
    assert {(r.u, r.v) for r in m.collect()} == {("a_0", "c_0"), ("b_0", "c_0"), ("a_0", "b_0"), ("c_1", "d_0"), ("c_1", "e_0"), ("d_0", "e_0")}
    assert {(r.id, r.m, r.mol) for r in v.collect()} >= {("c_1", 9, 1)}


def test_filters(spark):
    inc = spark.createDataFrame([("a", i) for i in range(3)] + [("b", 0)] + [("c", i) for i in range(100)], "bx string, mx long")
    assert {r.bx for r in filters.filter_barcodes(inc, 2, 50).collect()} == {"a"} and tuple(filters.barcode_counts(inc, 2, 50).first()) == (1, 1)
    assert {r.mx for r in filters.remove_singletons(inc).collect()} == {0, 1, 2}
    flat = spark.createDataFrame([("a", 1), ("b", 1), ("a", 2), ("b", 2)], "bx string, mx long")
    assert filters.remove_repetitive(flat).count() == 0 and filters.remove_repetitive(flat, 3).count() == 4
    o = spark.createDataFrame([("a", i) for i in range(1, 6)] + [("b", i) for i in range(3, 8)] + [("c", 10)], "bx string, mx long")
    assert [tuple(r) for r in overlap.overlap_edges(o, 2).collect()] == [("a", "b", 3)] and overlap.overlap_edges(o, 4).count() == 0 and overlap.overlap_vertices(o).count() == 3
    e = edges(spark, [("a", "b", 5), ("b", "c", 2), ("a", "c", 2), ("d", "e", 1)])
    assert filters.filter_by_percentile(e, 50).count() == 3 and filters.filter_by_percentile(e, 0).count() == 4 and filters.filter_edges(e, 3).count() == 1
    v = spark.createDataFrame([(x,) for x in "abcdef"], "id string")
    v2, e2 = filters.remove_small_components(v, e, 3)
    assert {r.id for r in v2.collect()} == set("abc") and e2.count() == 3 and filters.remove_isolated(v, e).count() == 5
    assert with_defaults("long").compress and with_defaults("linked", min_n=7).min_n == 7
    with pytest.raises(ValueError):
        with_defaults("other")


def test_forest_in_rounds_equals_local(spark):
    rng = random.Random(7)
    rows = [(f"n{a:02}", f"n{b:02}", rng.randint(1, 4)) for a in range(40) for b in range(a + 1, 40) if rng.random() < 0.08] + [("n01", "n00", 9), ("n00", "n01", 2)]
    e = edges(spark, rows)
    local = {tuple(r) for r in forest.spanning_forest(e).collect()}
    assert local == {tuple(r) for r in forest.spanning_forest(e, local_edges=0).collect()}
    assert {tuple(r) for r in backbone.remove_bridges(e, 4, 2).collect()} == {tuple(r) for r in backbone.remove_bridges(e, 4, 2, local_edges=0).collect()}
    # an edge stays unless its ends are joined by edges that come before it
    simple = sorted({(min(u, v), max(u, v)): max(m for x, y, m in rows if {x, y} == {u, v}) for u, v, _ in rows}.items(), key=lambda x: (-x[1], x[0]))
    want = {(*e, m) for k, (e, m) in enumerate(simple) if not any(set(e) <= p for p in united([set(x) for x, _ in simple[:k]]))}
    assert local == want


def ways(t, start, without):
    """Vertices that start reaches without going over one edge."""
    seen, todo = {start}, [start]
    while todo:
        x = todo.pop()
        for y in t[x]:
            if {x, y} != without and y not in seen:
                seen.add(y)
                todo.append(y)
    return seen


def distances(t, start, inside):
    far, todo = {start: (0, 1)}, [start]
    while todo:
        x = todo.pop()
        for y, m in t[x].items():
            if y in inside and y not in far:
                far[y] = far[x][0] + m, far[x][1] + 1
                todo.append(y)
    return far


def test_trees_equal_their_definitions():
    rng = random.Random(8)
    for _ in range(80):
        t = random_tree(rng, rng.randint(2, 25))
        size = forest.branch_lengths(t)
        for u in t:
            for v in t[u]:
                side = ways(t, v, {u, v})
                assert size[u, v] == max(n for _, n in distances(t, v, side).values())
        # the heaviest path, by all pairs
        path = forest.diameter(t, t)
        assert sum(t[x][y] for x, y in zip(path, path[1:], strict=False)) == max(d for x in t for d, _ in distances(t, x, set(t)).values()) and path[0] <= path[-1]
        short = lambda g, least: [(u, v) for u in g if len(g[u]) >= 3 for v in g[u] if max(n for _, n in distances(g, v, ways(g, v, {u, v})).values()) < least]  # noqa: B023, E731
        least = rng.randint(1, 5)
        model = {x: dict(y) for x, y in t.items()}
        while cut := short(model, least):
            lost = set().union(*(ways(model, v, {u, v}) for u, v in cut))
            model = {x: {y: m for y, m in ys.items() if y not in lost} for x, ys in model.items() if x not in lost}
        before = len(t)
        assert forest.prune(t, least) == before - len(t) and t == model


def test_peeling_gives_every_vertex_once():
    rng = random.Random(9)
    for _ in range(40):
        t = random_tree(rng, rng.randint(2, 30))
        names, joined = set(t), {frozenset((u, v)) for u in t for v in t[u]}
        found = backbone.peel(t, BackboneParams(prune_branch_size=1, prune_junction_size=rng.choice([0, 3, 6])))
        assert sorted(x for p in found for x in p) == sorted(names) and not t
        assert all(frozenset(e) in joined for p in found for e in zip(p, p[1:], strict=False))


def test_bridges_equal_their_definition():
    rng = random.Random(10)
    for _ in range(60):
        t, length = random_tree(rng, rng.randint(2, 25)), rng.randint(1, 5)
        junction = {x for x in t if len(t[x]) >= 3}
        want = {x for x in junction if junction & set(t[x])}
        for x in set(t) - junction:  # the stretch of x between junctions
            stretch, todo = {x}, [x]
            while todo:
                for y in t[todo.pop()]:
                    if y not in stretch and y not in junction:
                        stretch.add(y)
                        todo.append(y)
            if len(stretch) < length and all(len(t[y]) == 2 for y in stretch):
                want |= stretch
        assert backbone.bridges(t, length) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_merge_paths_puts_a_cut_line_together(spark, seed):
    """A line cut into pieces that lie in any order and direction; bridges join neighbours, weak and crowded links are turned down."""
    rng = random.Random(seed)
    line = [[f"m{c}x{i:02}" for i in range(rng.randint(24, 40))] for c in range(5)]
    lie = [(tid, c, rng.random() < 0.5) for tid, c in enumerate(rng.sample(range(5), 5))]
    paths = [(tid, i, m) for tid, c, turned in lie for i, m in enumerate(line[c][::-1] if turned else line[c])]
    place, inc = {}, []
    for m in sorted(x for p in line for x in p):
        place[m] = 10 * len(place)
        inc += [(m, place[m] + j) for j in range(3)]

    def bridge(name, *ends):
        return [(name, place[m] + j) for end in ends for m in end[:2] for j in range(3)]

    for c in range(4):  # two or three bridges between neighbours
        for k in range(rng.choice([2, 3])):
            inc += bridge(f"b{c}x{k}", line[c][-3:], line[c + 1][:3])
    inc += bridge("weak", line[0][:3], line[4][-3:])  # one bridge only
    p = MergeParams(endpoint_depth=8, min_shared_mx=3, min_bridges=2, min_path_size=10, min_bridge_density=0.0, min_endpoint_hits=2)
    df, mx = spark.createDataFrame(paths, "tid long, tpos long, mol string"), spark.createDataFrame(inc, "mol string, mx long")
    got = [r.mol for r in merge.merge_paths(df, mx, p).orderBy("tid", "tpos").collect()]
    whole = [m for piece in line for m in piece]
    assert got in (whole, whole[::-1])
    assert merge.merge_paths(df, mx.where(~F.col("mol").startswith("b")), p).select("tid").distinct().count() == 5
    assert merge.links_by_end(merge.merge_links(df, mx, p)).count() == 8


def test_start_to_start_joins():
    joins = merge.choose({0: 5, 1: 5}, [(0, False, 1, False, 3)])
    chain = merge.chains_of({0: 5, 1: 5}, joins, True)[0]
    assert [(0, True), (1, False)] in (chain, [(i, not turned) for i, turned in reversed(chain)])  # a chain reads either way
    assert sorted(map(len, merge.chains_of({0: 5, 1: 5}, joins, False))) == [1, 1]
    assert backbone.chain_adjacent({0: 3, 1: 3, 2: 3}, [(0, 1, True, False), (1, 2, True, True)]) == [[(0, False), (1, False), (2, True)]]
