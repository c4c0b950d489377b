"""A small graph worked out by hand, and the kernels against plain brute force."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from lodestrata.operators import graph, linking
from lodestrata.operators import graph_kernels as K
from lodestrata.operators.components import connected

#: Who imports whom, in which file.
SHOP = [
    ("shop", "stock", "shop/cart"), ("shop", "stock", "shop/list"), ("shop", "mail", "shop/cart"), ("stock", "mail", "stock/count"),
    ("stock", "mail", "stock/count"), ("mail", "shop", "mail/send"), ("mail", "log", "mail/send"),
]


@pytest.fixture(scope="module")
def shop(spark):
    return spark.createDataFrame(SHOP, "from string, to string, file string")


def adj(edges):
    return K.adjacency([tuple(e.split()) for e in edges])


def by_name(df, *columns):
    return {r["name"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_couplings(shop):
    got = by_name(graph.couplings(shop), *[f"modularity__coupling__{c}" for c in ("afferent", "efferent", "dependents", "dependencies")])
    assert got == {"shop": (1, 2, 1, 2), "stock": (2, 1, 1, 1), "mail": (2, 1, 2, 2), "log": (1, 0, 1, 0)}


def test_direct(shop):
    got = {tuple(r) for r in linking.direct_connections(shop).collect()}
    assert ("stock", "mail", "stock/count", 2) in got and len(got) == 6


def test_indirect(shop):
    got = {(r["from"], r["to"], r["shortest_path_length"], r["shortest_path"]) for r in graph.indirect_connections(graph.distinct_edges(shop)).collect()}
    assert got == {
        ("shop", "stock", 2, "shop -> stock"), ("shop", "mail", 2, "shop -> mail"), ("shop", "log", 3, "shop -> mail -> log"), ("stock", "mail", 2, "stock -> mail"),
        ("stock", "shop", 3, "stock -> mail -> shop"), ("stock", "log", 3, "stock -> mail -> log"), ("mail", "shop", 2, "mail -> shop"),
        ("mail", "log", 2, "mail -> log"), ("mail", "stock", 3, "mail -> shop -> stock"),
    }


def test_furthest(shop):
    got = {r["component"]: (r["furthest_component"], r["furthest_component_distance"]) for r in graph.furthest_connections(graph.distinct_edges(shop)).collect()}
    assert got == {"shop": ("log", 3), "stock": ("log", 3), "mail": ("stock", 3)}


def test_groups_cycles_closeness_ranks(spark, shop):
    edges = graph.distinct_edges(shop)
    dist = graph.distances(edges)
    groups = {r["component"]: (r["group"], r["group_size"]) for r in graph.strong_groups(edges, graph.graph_nodes(edges)).collect()}
    assert groups == {"log": (0, 1), "mail": (1, 3), "shop": (1, 3), "stock": (1, 3)}
    cycles = graph.shortest_cycles(edges)
    assert sorted(r["cycle"] for r in cycles.collect()) == ["mail -> shop -> mail", "mail -> shop -> stock -> mail"]
    got = by_name(graph.cycles_per_component(cycles), "cycles__short__count", "cycles__short__avg", "cycles__short__max")
    assert got == {"mail": (4, 2.5, 3), "shop": (2, 2.5, 3), "stock": (1, 3.0, 3)}
    near = by_name(graph.closeness(dist), "graph__harmonic_centrality", "graph__farness_centrality", "graph__residual_closeness")
    assert near == {"shop": (1.5, 3.0, 0.75), "stock": (1.5, 3.0, 0.75), "mail": (2.0, 2.0, 1.0), "log": (2.0, 5.0, 1.0)}
    assert by_name(graph.betweenness(edges), "graph__betweenness") == {"mail": (3.0,), "shop": (1.0,), "stock": (0.0,), "log": (0.0,)}
    ranks = by_name(graph.ranks(edges, graph.graph_nodes(edges)), "graph__page_rank", "graph__hits__hub_score", "graph__hits__authority_score")
    want = by_matrices({(a, b) for a, b, _ in SHOP})
    assert all(ranks[n] == pytest.approx(want[n], abs=1e-5) for n in want) and ranks.keys() == want.keys()
    loops = by_name(graph.page_rank(edges, graph.graph_nodes(edges), 60), "graph__page_rank")
    assert all(loops[n][0] == pytest.approx(want[n][0], abs=1e-4) for n in want)


def by_matrices(pairs):
    """Page rank as the solution of its equations, hubs and authorities as eigenvectors."""
    nodes = sorted({n for p in pairs for n in p})
    a = np.array([[float((x, y) in pairs) for y in nodes] for x in nodes])
    out = a.sum(axis=1)
    step = np.where(out[:, None] > 0, a / np.maximum(out, 1)[:, None], 1 / len(nodes))
    rank = np.linalg.solve(np.eye(len(nodes)) - 0.85 * step.T, np.full(len(nodes), 0.15 / len(nodes)))
    hub, authority = (np.abs(np.linalg.eigh(m)[1][:, -1]) for m in (a @ a.T, a.T @ a))
    return dict(zip(nodes, zip(rank, hub, authority, strict=True), strict=True))


def shortest_by_warshall(pairs, nodes):
    far = {(x, y): 0 if x == y else 1 if (x, y) in pairs else 10**6 for x in nodes for y in nodes}
    for k, x, y in itertools.product(nodes, nodes, nodes):
        far[x, y] = min(far[x, y], far[x, k] + far[k, y])
    return far


@pytest.mark.parametrize("seed", range(3))
def test_cycles_betweenness_groups_against_brute_force(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(7)]
    pairs = {(a, b) for a, b in itertools.permutations(nodes, 2) if rng.random() < 0.25}
    far = shortest_by_warshall(pairs, nodes)

    def paths(x, y):
        if x == y:
            return [[x]]
        return [[x, *p] for z in nodes if (x, z) in pairs and far[z, y] + 1 == far[x, y] for p in paths(z, y)]

    want = set()
    for x, y in pairs:
        if far[y, x] < 10**6:
            c = min(paths(y, x))
            at = c.index(min(c))
            want.add(tuple(c[at:] + c[:at]))
    assert {tuple(c) for c in K.shortest_cycles(K.adjacency(pairs))} == want
    through = dict.fromkeys(nodes, 0.0)
    for x, y in itertools.permutations(nodes, 2):
        if far[x, y] < 10**6:
            every = paths(x, y)
            for p in every:
                for n in p[1:-1]:
                    through[n] += 1 / len(every)
    got = K.betweenness(K.adjacency(pairs))
    assert all(got.get(n, 0.0) == pytest.approx(through[n]) for n in nodes)
    edges = spark.createDataFrame(sorted(pairs), "from string, to string")
    heads = {n: min(m for m in nodes if far[n, m] < 10**6 and far[m, n] < 10**6) for n in nodes}
    numbers = {h: i for i, h in enumerate(sorted(set(heads.values())))}
    all_nodes = spark.createDataFrame([(n,) for n in nodes], "name string")
    for limit in (20_000, 2):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(graph, "LARGEST", limit)
            rows = graph.strong_groups(edges, all_nodes).collect()
        assert {r["component"]: (r["group"], r["group_size"]) for r in rows} == {n: (numbers[h], list(heads.values()).count(h)) for n, h in heads.items()}
    above = {}
    for r in graph.reachable(graph.distances(edges)).collect():
        above.setdefault(r["name"], set()).add(r["ancestor"])
    assert above == {k: v for k in nodes if (v := {x for x in nodes if x != k and far[x, k] < 10**6})}


def test_rotation():
    assert [K.rotated(list(x)) for x in ("BCA", "CAB", "BAC", "CBA")] == [list("ABC"), list("ABC"), list("ACB"), list("ACB")]


def test_ring_and_acyclic(spark):
    assert K.elementary_cycles(adj(["A B", "B C", "C D", "D A"])) == [list("ABCD")]
    edges = spark.createDataFrame([("a", "b")], "from string, to string")
    assert graph.largest_cycle(graph.elementary_cycles(edges)).count() == 0


def test_no_edges(spark):
    none = spark.createDataFrame([], "from string, to string")
    assert graph.distances(none).count() == 0 and graph.distances_by_level(none).count() == 0
    assert connected(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_kernels_against_brute_force(seed):
    rng = random.Random(seed)
    nodes = list("abcdefg")
    edges = [(a, b) for a, b in itertools.permutations(nodes, 2) if rng.random() < 0.3]
    g = K.adjacency(edges)
    want = set()
    for k in range(2, len(nodes) + 1):
        for p in itertools.permutations(nodes, k):
            if p[0] == min(p) and all(b in g.get(a, ()) for a, b in zip(p, (*p[1:], p[0]), strict=True)):
                want.add(p)
    assert {tuple(c) for c in K.elementary_cycles(g)} == want
    for s in g:
        dist, ways, before = K.shortest_from(g, s)
        paths = K.all_shortest_paths(g, s)
        for t in dist:
            mine = [p for p in paths if p[-1] == t]
            if t != s:
                assert len(mine) == ways[t] and min(mine) == K.path_to(before, t) and len(mine[0]) == dist[t] + 1
    cover = [n for c in K.communities(g) for n in c]
    assert sorted(cover) == sorted(g)


def test_level_search_equals_kernel(spark):
    rng = random.Random(3)
    pairs = {(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(60)}
    edges = spark.createDataFrame([p for p in pairs if p[0] != p[1]], "from string, to string")
    assert sorted(map(tuple, graph.distances(edges).collect())) == sorted(map(tuple, graph.distances_by_level(edges).collect()))


@pytest.mark.parametrize("limit", [0, 200_000])
def test_connected(spark, monkeypatch, limit):
    monkeypatch.setattr("lodestrata.operators.components.IN_ONE_TASK", limit)
    rng = random.Random(1)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(40)] + [(5, 5)]
    parent = list(range(200))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    want = {n: root(n) for a, b in pairs if a != b for n in (a, b)}
    assert {r["node"]: r["label"] for r in connected(spark.createDataFrame(pairs, "u long, v long")).collect()} == want


def test_group_metrics(spark, shop):
    edges = graph.distinct_edges(shop)
    members = graph.strong_groups(edges, graph.graph_nodes(edges))
    got = {r["component"]: r.asDict() for r in graph.group_metrics(shop, members, "group", "group__").collect()}
    assert got["log"]["group__graph__page_rank"] == 0.0 and got["log"]["group__modularity__coupling__afferent"] == 0
    assert got["shop"]["group__modularity__coupling__efferent"] == 2 and got["mail"]["group__cycles__short__count"] == 4
    assert sum(got[n]["group__graph__page_rank"] for n in ("shop", "stock", "mail")) == pytest.approx(1)


def test_islands_beyond_the_limit_give_the_same(spark, monkeypatch):
    # an island of 12 nodes with groups of 5 and 3, one of 3 nodes, and a limit between
    text = "A B,B C,C D,D E,E A,B D,C A,A D,E F,E G,F H,G H,H I,I J,J H,J K,F K,H L,x y,y z,z x,x z"
    edges = spark.createDataFrame([tuple(e.split()) for e in text.split(",")], "from string, to string")
    queries = {
        f.__name__: f
        for f in (
            graph.distances, graph.indirect_connections, graph.furthest_connections, graph.shortest_cycles, graph.elementary_cycles, graph.communities
        )
    }
    rows = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    want = {name: rows(f(edges)) for name, f in queries.items()}
    between = by_name(graph.betweenness(edges), "graph__betweenness")
    monkeypatch.setattr(graph, "PAIRS", 10)
    for name, f in queries.items():
        assert rows(f(edges)) == want[name], name
    parts = by_name(graph.betweenness(edges), "graph__betweenness")
    assert parts.keys() == between.keys() and all(parts[n] == pytest.approx(between[n]) for n in parts)
    monkeypatch.setattr(graph, "LARGEST", 4)
    for name, f in queries.items():
        assert rows(f(edges)) == want[name], name
    got = by_name(graph.betweenness(edges), "graph__betweenness")
    assert got.keys() == between.keys() and all(got[n] == pytest.approx(between[n]) for n in got)
    known = graph.islands(edges).persist()
    assert rows(graph.furthest_connections(known)) == want["furthest_connections"]


def test_ranks_in_one_task_and_as_joins_are_the_same(spark, monkeypatch):
    # the largest singular values are close (12 and 11), so 100 rounds of HITS are too few to converge
    pairs = [(f"a{i}", f"b{j}") for i in range(3) for j in range(4)] + [("c", f"d{j}") for j in range(11)]
    want_hits, want_rank = K.hits(K.adjacency(pairs)), K.page_rank(K.adjacency(pairs))
    assert want_hits["c"][0] < 1e-8 and want_hits["d0"][1] < 1e-8 and sum(want_rank.values()) == pytest.approx(1)
    edges = spark.createDataFrame(pairs, "from string, to string")
    columns = ("graph__page_rank", "graph__hits__hub_score", "graph__hits__authority_score")
    # a coarser tolerance ends both forms after the same, few rounds
    monkeypatch.setattr(K, "TOLERANCE", 0.06, raising=False)
    kernels = {n: (K.page_rank(K.adjacency(pairs))[n], *K.hits(K.adjacency(pairs))[n]) for n in want_rank}
    monkeypatch.setattr(graph, "ONE_TASK", 0)
    got = by_name(graph.ranks(edges, graph.graph_nodes(edges)), *columns)
    assert got.keys() == kernels.keys() and all(got[n] == pytest.approx(kernels[n], abs=1e-9) for n in got)


def test_a_long_chain_and_a_large_random_graph(spark):
    n = 100_000
    rng = random.Random(4)
    ring = [(f"c{i:06}", f"c{i + 1:06}") for i in range(n - 1)] + [(f"c{n - 1:06}", f"c{n // 2:06}")]
    wild = [(f"r{rng.randrange(n):06}", f"r{rng.randrange(n):06}") for _ in range(2 * n)]
    edges = graph.distinct_edges(spark.createDataFrame(ring + wild, "from string, to string"))
    sizes = {r["group_size"]: r["n"] for r in graph.strong_groups(edges, graph.graph_nodes(edges)).where("component < 'd'").groupBy("group_size").agg({"component": "count"}).withColumnRenamed("count(component)", "n").collect()}
    assert sizes == {1: n // 2, n // 2: n // 2}


def test_places_in_order(spark):
    df = spark.createDataFrame([(f"k{i:04}",) for i in random.Random(1).sample(range(5000), 3000)], "k string").repartition(7)
    got = [tuple(r) for r in graph.in_order(df, "k", "nr", 1).collect()]
    assert sorted(got) == list(zip(sorted(k for k, _ in got), range(1, 3001), strict=True))
    assert graph.in_order(df.limit(0), "k", "nr").count() == 0
