"""The component graph: reachability, paths, cycles, groups and centralities.

A graph of components falls into islands (code bases that never import each other), found by distributed connected
components. An island up to ``LARGEST`` edges goes to the kernels whole, its sources spread over as many tasks as its pairs
need; so no task holds more than the edges of an island and a bounded number of rows. Larger ones go through level-by-level
searches over DataFrames: :func:`distances_by_level`, from which closeness and reachability follow, and the functions that
end in ``_by_level``, with the same results. Strong groups take linear time in a task, or colours passed along the edges.
Communities are found by one task per island of any size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators import graph_kernels as K
from lodestrata.operators.components import connected
from lodestrata.session import checkpointed

#: Edges of the largest island that a kernel takes, at about two hundred bytes each.
LARGEST = 1_000_000
#: Pairs of nodes of an island that one task goes through.
PAIRS = 500_000
#: Edges of the largest graph whose ranks are computed in one task.
ONE_TASK = 1_000_000


def distinct_edges(connections: DataFrame) -> DataFrame:
    """``from, to`` of the graph: no loops, no parallel edges."""
    return connections.where(F.col("from") != F.col("to")).select("from", "to").distinct()


def graph_nodes(edges: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """``name`` of every end of an edge, and of every given component (column ``name``)."""
    ends = edges.select(F.col("from").alias("name")).union(edges.select(F.col("to").alias("name")))
    return (ends if components is None else ends.union(components.select("name"))).distinct()


def islands(edges: DataFrame) -> DataFrame:
    """``from, to, island, nodes, edges``: each edge with the smallest node of its island, and the nodes and edges of that."""
    labels = connected(edges.select(F.col("from").alias("u"), F.col("to").alias("v")))
    known = checkpointed(edges.join(labels, edges["from"] == labels["node"]).select("from", "to", F.col("label").alias("island")))
    nodes = labels.groupBy(F.col("label").alias("island")).agg(F.count(F.lit(1)).alias("nodes"))
    sizes = known.groupBy("island").agg(F.count(F.lit(1)).alias("edges")).join(nodes, "island")
    return known.join(sizes, "island").select("from", "to", "island", "nodes", "edges")


def parted(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Edges of the islands that a kernel takes, with their ``island``; and ``from, to`` of the larger ones, None without such."""
    grouped = edges if "island" in edges.columns else checkpointed(islands(edges))
    large = grouped.where(F.col("edges") > LARGEST).select("from", "to")
    return (grouped, None) if large.isEmpty() else (grouped.where(F.col("edges") <= LARGEST), checkpointed(large))


def per_graph(
    edges: DataFrame,
    kernel: Callable[..., list[tuple]],
    schema: str,
    group: str | None = None,
    joined: Callable[[DataFrame], DataFrame] | None = None,
    spread: bool = False,
) -> DataFrame:
    """The rows of ``kernel`` for each island of ``edges``, or for each value of the column ``group``.

    ``joined`` gives the same rows from the edges of all islands beyond LARGEST; without it a kernel takes any size. With
    ``spread`` the kernel is called with the graph and some of its nodes at a time, in as many tasks as PAIRS asks for, and its
    rows are those of these nodes. Edges that come with their ``island`` already are not searched for islands again.
    """
    large = None
    if group:
        grouped = edges.withColumnRenamed(group, "island")
    elif joined:
        grouped, large = parted(edges)
    else:
        grouped = edges if "island" in edges.columns else islands(edges)
    parts = F.least("nodes", F.ceil(F.col("nodes") * F.col("nodes") / PAIRS)).cast("int") if spread else F.lit(1)
    grouped = grouped.select("from", "to", "island", parts.alias("parts")).select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    names = [x.split()[0] for x in schema.split(", ")]
    kind = next(f.dataType.simpleString() for f in grouped.schema.fields if f.name == "island")
    full = (f"{group} {kind}, " if group else "") + schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        adj = K.adjacency(list(zip(pdf["from"], pdf["to"], strict=True)))
        rows = kernel(adj, list(adj)[int(pdf["part"].iloc[0]) :: int(pdf["parts"].iloc[0])]) if spread else kernel(adj)
        out = pd.DataFrame(rows, columns=names)
        if group:
            out.insert(0, group, pdf["island"].iloc[0])
        return out

    rows = grouped.groupBy("island", "part").applyInPandas(run, full)
    return rows if large is None else rows.unionByName(joined(large))


def in_order(df: DataFrame, key: str, name: str, first: int = 0) -> DataFrame:
    """``df`` with the place ``name`` of each row in the order of ``key``, from ``first`` on.

    Rows are sorted by ranges, so no task has them all; of each range its number of rows goes to the driver.
    """
    rows = checkpointed(df.orderBy(key).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    sizes = sorted((r["_part"], r["n"]) for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = [], first
    for part, n in sizes:
        starts += [F.lit(part), F.lit(total)]
        total += n
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    start = F.create_map(*starts)[F.col("_part")] if starts else F.lit(0)
    return rows.select(*df.columns, (start + inside).cast("long").alias(name))


def predecessors(edges: DataFrame) -> DataFrame:
    """``name, predecessor`` of direct edges."""
    return edges.select(F.col("to").alias("name"), F.col("from").alias("predecessor"))


def successors(edges: DataFrame) -> DataFrame:
    """``name, successor`` of direct edges."""
    return edges.select(F.col("from").alias("name"), F.col("to").alias("successor"))


def has_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``from, to, from_to, between`` of ``pairs`` (``from, to``): whether there is an edge that way, and one either way.

    A null end has no edge; a pair that comes again comes out again.
    """
    known = edges.select(F.col("from").alias("a"), F.col("to").alias("b"), F.lit(True).alias("hit")).distinct()
    back = known.select(F.col("a").alias("c"), F.col("b").alias("d"), F.col("hit").alias("back"))
    out = pairs.select("from", "to").join(known, (F.col("from") == F.col("a")) & (F.col("to") == F.col("b")), "left")
    out = out.join(back, (F.col("from") == F.col("d")) & (F.col("to") == F.col("c")), "left")
    return out.select("from", "to", F.col("hit").isNotNull().alias("from_to"), (F.col("hit").isNotNull() | F.col("back").isNotNull()).alias("between"))


def distances(edges: DataFrame) -> DataFrame:
    """``src, dst, distance, ways`` of all reachable ordered pairs of different nodes; ``ways`` counts shortest paths."""

    def kernel(adj: K.Adjacency, sources: list[str]) -> list[tuple]:
        out = []
        for s in sources:
            dist, ways, _ = K.shortest_from(adj, s)
            out += [(s, t, d, ways[t]) for t, d in dist.items() if t != s]
        return out

    return per_graph(edges, kernel, "src string, dst string, distance long, ways long", joined=distances_by_level, spread=True)


def distances_by_level(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """The same as :func:`distances` for graphs of any size: a frontier joined with the edges, level by level.

    ``sources`` (column ``src``) limits where the search begins. Each level is checkpointed.
    """
    return _levels(edges, sources).where(F.col("distance") > 0)


def _levels(edges: DataFrame, sources: DataFrame | None = None, ways: str = "long") -> DataFrame:
    """The rows of :func:`distances_by_level` and each source itself at distance 0; ``ways`` is the type of their number."""
    edges = checkpointed(edges.select("from", "to"))
    start = edges.select(F.col("from").alias("src")).distinct()
    if sources is not None:
        start = start.join(sources.select("src"), "src", "left_semi")
    frontier = start.select("src", F.col("src").alias("dst"), F.lit(0).cast("long").alias("distance"), F.lit(1).cast(ways).alias("ways"))
    seen = frontier
    level = 0
    while True:
        level += 1
        frontier = checkpointed(
            frontier.join(edges, frontier["dst"] == edges["from"])
            .groupBy("src", F.col("to").alias("dst"))
            .agg(F.sum("ways").alias("ways"))
            .join(seen.select("src", "dst"), ["src", "dst"], "left_anti")
            .select("src", "dst", F.lit(level).cast("long").alias("distance"), "ways")
        )
        if frontier.isEmpty():
            break
        seen = checkpointed(seen.unionByName(frontier))
    return seen


def _smallest_paths(edges: DataFrame) -> Iterator[DataFrame]:
    """For each distance from 1 on ``src, dst, path``: the smallest shortest path in text order, as an array of nodes.

    Paths to one node are of one length, so the smallest goes on from a smallest one.
    """
    at = edges.select(F.col("from").alias("src")).distinct().select("src", F.col("src").alias("dst"), F.array("src").alias("path"))
    seen = at.select("src", "dst")
    while True:
        at = checkpointed(
            at.join(edges, at["dst"] == edges["from"])
            .groupBy("src", F.col("to").alias("dst"))
            .agg(F.min("path").alias("path"))
            .join(seen, ["src", "dst"], "left_anti")
            .select("src", "dst", F.concat("path", F.array("dst")).alias("path"))
        )
        if at.isEmpty():
            return
        yield at
        seen = checkpointed(seen.union(at.select("src", "dst")))


def _none(edges: DataFrame, schema: str) -> DataFrame:
    return edges.sparkSession.createDataFrame([], schema)


def reachable(dist: DataFrame) -> DataFrame:
    """``name, ancestor``: every node from which ``name`` can be reached; no node is its own ancestor."""
    return dist.select(F.col("dst").alias("name"), F.col("src").alias("ancestor"))


def closeness(dist: DataFrame) -> DataFrame:
    """Harmonic, farness and residual closeness of each node, over the finite distances of incoming paths."""
    d = F.col("distance")
    return dist.groupBy(F.col("dst").alias("name")).agg(
        F.sum(1.0 / d).alias("graph__harmonic_centrality"),
        F.sum(d).cast("double").alias("graph__farness_centrality"),
        F.sum(F.pow(F.lit(2.0), -d)).alias("graph__residual_closeness"),
    )


def strong_groups(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``component, group, group_size``: strongly connected groups, singles included.

    Two nodes are in one group if each reaches the other. Groups are numbered from 0 by their smallest member.
    """

    def kernel(adj: K.Adjacency) -> list[tuple]:
        return [(n, g[0], len(g)) for g in K.strong_components(adj) for n in g]

    def joined(large: DataFrame) -> DataFrame:
        heads = strong_heads(large)
        sizes = heads.groupBy("head").agg(F.count(F.lit(1)).alias("group_size"))
        return heads.join(sizes, "head").select("member", "head", "group_size")

    found = per_graph(edges, kernel, "member string, head string, group_size long", joined=joined)
    named = nodes.join(found, nodes["name"] == found["member"], "left").select(
        "name", F.coalesce("head", "name").alias("head"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size")
    )
    heads = in_order(named.select("head").distinct(), "head", "group")
    return named.join(heads, "head").select(F.col("name").alias("component"), "group", "group_size")


def strong_heads(edges: DataFrame) -> DataFrame:
    """``member, head`` (the smallest member of its group) for graphs of any size, by colours.

    Each node takes the smallest node that reaches it as its colour; what reaches that node inside its colour is its group. The
    groups found are taken out, and the rest is coloured again. Each step along the edges is a join, checkpointed.
    """
    edges = checkpointed(edges.select("from", "to"))
    found = _none(edges, "member string, head string")
    rest = graph_nodes(edges)
    while not edges.isEmpty():
        colour = checkpointed(rest.select("name", F.col("name").alias("colour")))
        fresh = colour
        while True:
            pushed = fresh.join(edges, F.col("name") == F.col("from")).groupBy(F.col("to").alias("t")).agg(F.min("colour").alias("c"))
            merged = checkpointed(
                colour.join(pushed, F.col("name") == F.col("t"), "left").select("name", F.least("colour", "c").alias("colour"), (F.col("c") < F.col("colour")).alias("new"))
            )
            fresh = merged.where("new").select("name", "colour")
            colour = merged.select("name", "colour")
            if fresh.isEmpty():
                break
        inside = edges.join(colour.select(F.col("name").alias("from"), F.col("colour").alias("x")), "from")
        inside = inside.join(colour.select(F.col("name").alias("to"), F.col("colour").alias("y")), "to").where(F.col("x") == F.col("y"))
        inside = checkpointed(inside.select("from", "to"))
        group = checkpointed(colour.where(F.col("name") == F.col("colour")).select(F.col("name").alias("member"), F.col("colour").alias("head")))
        fresh = group
        while True:
            back = inside.join(fresh, F.col("to") == F.col("member")).select(F.col("from").alias("member"), "head").distinct()
            fresh = checkpointed(back.join(group, "member", "left_anti"))
            if fresh.isEmpty():
                break
            group = checkpointed(group.unionByName(fresh))
        found = checkpointed(found.unionByName(group))
        rest = checkpointed(rest.join(group.select(F.col("member").alias("name")), "name", "left_anti"))
        edges = checkpointed(
            edges.join(rest.select(F.col("name").alias("from")), "from", "left_semi").join(rest.select(F.col("name").alias("to")), "to", "left_semi").select("from", "to")
        )
    return found.unionByName(rest.select(F.col("name").alias("member"), F.col("name").alias("head")))


def indirect_connections(edges: DataFrame) -> DataFrame:
    """Every shortest path between every ordered pair: ``from, to, shortest_path_length, shortest_path``; length in nodes."""

    def kernel(adj: K.Adjacency, sources: list[str]) -> list[tuple]:
        return [(p[0], p[-1], len(p), " -> ".join(p)) for s in sources for p in K.all_shortest_paths(adj, s)]

    schema = "from string, to string, shortest_path_length long, shortest_path string"
    return per_graph(edges, kernel, schema, joined=indirect_by_level, spread=True)


def indirect_by_level(edges: DataFrame) -> DataFrame:
    """The same as :func:`indirect_connections` for graphs of any size: paths grow by an edge where the distance does."""
    edges = checkpointed(edges.select("from", "to"))
    # the number of ways is not used, and as a double does not overflow
    dist = _levels(edges, ways="double")
    at = edges.select(F.col("from").alias("src")).distinct().select("src", F.col("src").alias("last"), F.array("src").alias("path"))
    found = _none(edges, "src string, last string, path array<string>")
    level = 0
    while True:
        level += 1
        there = dist.where(F.col("distance") == level).select(F.col("src").alias("s"), "dst")
        grown = at.join(edges, at["last"] == edges["from"]).select("src", "to", "path")
        at = checkpointed(
            grown.join(there, (F.col("src") == F.col("s")) & (F.col("to") == F.col("dst"))).select(
                "src", F.col("to").alias("last"), F.concat("path", F.array("to")).alias("path")
            )
        )
        if at.isEmpty():
            break
        found = checkpointed(found.union(at))
    return found.select(
        F.col("src").alias("from"),
        F.col("last").alias("to"),
        F.size("path").cast("long").alias("shortest_path_length"),
        F.array_join("path", " -> ").alias("shortest_path"),
    )


def furthest_connections(edges: DataFrame) -> DataFrame:
    """Per component the longest shortest path that begins there; of several the smallest in text order."""

    def kernel(adj: K.Adjacency, sources: list[str]) -> list[tuple]:
        out = []
        for s in sources:
            dist, _, before = K.shortest_from(adj, s)
            far = max(dist.values())
            if far:
                path = min(K.path_to(before, t) for t, d in dist.items() if d == far)
                out.append((s, path[-1], far + 1, " -> ".join(path)))
        return out

    return per_graph(
        edges,
        kernel,
        "component string, furthest_component string, furthest_component_distance long, furthest_component_shortest_path string",
        joined=furthest_by_level,
        spread=True,
    )


def furthest_by_level(edges: DataFrame) -> DataFrame:
    """The same as :func:`furthest_connections` for graphs of any size: the paths of the last level that a source has."""
    edges = checkpointed(edges.select("from", "to"))
    far = _none(edges, "src string, path array<string>")
    for at in _smallest_paths(edges):
        now = at.groupBy("src").agg(F.min("path").alias("path"))
        far = checkpointed(now.union(far.join(now.select("src"), "src", "left_anti")))
    return far.select(
        F.col("src").alias("component"),
        F.element_at("path", -1).alias("furthest_component"),
        F.size("path").cast("long").alias("furthest_component_distance"),
        F.array_join("path", " -> ").alias("furthest_component_shortest_path"),
    )


def within_cycles(edges: DataFrame) -> DataFrame:
    """The edges that lie on a cycle; their islands are the strongly connected groups."""
    heads = checkpointed(strong_heads(edges))
    a = heads.select(F.col("member").alias("from"), F.col("head").alias("x"))
    b = heads.select(F.col("member").alias("to"), F.col("head").alias("y"))
    return checkpointed(edges.join(a, "from").join(b, "to").where(F.col("x") == F.col("y")).select("from", "to"))


def _closed(members: DataFrame) -> DataFrame:
    return members.select(F.array_join(F.concat("members", F.slice("members", 1, 1)), " -> ").alias("cycle"), "members")


def shortest_cycles(edges: DataFrame) -> DataFrame:
    """``cycle, members`` (the path as text, closed, and its nodes, not closed) of the shortest cycles."""

    def kernel(adj: K.Adjacency, sources: list[str]) -> list[tuple]:
        return [(" -> ".join([*c, c[0]]), c) for c in K.shortest_cycles(adj, sources)]

    def joined(large: DataFrame) -> DataFrame:
        # of a large island only its strongly connected groups matter, and most of them fit a task
        return per_graph(within_cycles(large), kernel, schema, joined=shortest_cycles_by_level, spread=True)

    schema = "cycle string, members array<string>"
    # a cycle comes once for each of its nodes that has a way back on it
    return per_graph(edges, kernel, schema, joined=joined, spread=True).distinct()


def shortest_cycles_by_level(edges: DataFrame) -> DataFrame:
    """The same as :func:`shortest_cycles` for graphs of any size: the smallest paths that an edge closes."""
    edges = checkpointed(edges.select("from", "to"))
    closing = edges.select(F.col("from").alias("dst"), F.col("to").alias("src"))
    at_least = F.array_position("path", F.array_min("path")).cast("int")
    rotated = F.concat(F.slice("path", at_least, F.size("path")), F.slice("path", F.lit(1), at_least - 1))
    found = _none(edges, "members array<string>")
    for at in _smallest_paths(edges):
        found = checkpointed(found.union(at.join(closing, ["src", "dst"], "left_semi").select(rotated.alias("members"))).distinct())
    return _closed(found)


def elementary_cycles(edges: DataFrame) -> DataFrame:
    """``cycle, members`` of all elementary cycles."""

    def kernel(adj: K.Adjacency, sources: list[str]) -> list[tuple]:
        return [(" -> ".join([*c, c[0]]), c) for c in K.elementary_cycles(adj, sources)]

    def joined(large: DataFrame) -> DataFrame:
        # of a large island only its strongly connected groups matter, and most of them fit a task
        return per_graph(within_cycles(large), kernel, schema, joined=elementary_cycles_by_level, spread=True)

    schema = "cycle string, members array<string>"
    return per_graph(edges, kernel, schema, joined=joined, spread=True)


def elementary_cycles_by_level(edges: DataFrame) -> DataFrame:
    """The same as :func:`elementary_cycles` for graphs of any size: paths over later nodes than their first, until closed."""
    edges = checkpointed(edges.select("from", "to"))
    at = edges.where(F.col("to") > F.col("from")).select(F.array("from", "to").alias("path"), F.col("to").alias("last"))
    found = _none(edges, "members array<string>")
    first = F.element_at("path", 1)
    while not at.isEmpty():
        grown = at.join(edges, at["last"] == edges["from"]).select("path", "to")
        found = checkpointed(found.union(grown.where(F.col("to") == first).select(F.col("path").alias("members"))))
        on = (F.col("to") > first) & ~F.array_contains("path", F.col("to"))
        at = checkpointed(grown.where(on).select(F.concat("path", F.array("to")).alias("path"), F.col("to").alias("last")))
    return _closed(found)


def numbered(cycles: DataFrame) -> DataFrame:
    """Cycles with ``cycle_nr`` from 1 in the order of their text."""
    return cycles.join(in_order(cycles.select("cycle").distinct(), "cycle", "cycle_nr", 1), "cycle")


def cycle_rows(cycles: DataFrame) -> DataFrame:
    """One row per node of a closed cycle: ``cycle_nr, component, cycle_size, cycle``; the first node comes twice."""
    closed = F.concat("members", F.slice("members", 1, 1))
    return numbered(cycles).select(
        "cycle_nr", F.explode(closed).alias("component"), F.size("members").cast("long").alias("cycle_size"), "cycle"
    )


def cycle_neighbours(cycles: DataFrame) -> DataFrame:
    """``cycle_nr, cycle_size, component, cycle_successor, cycle_predecessor`` of each node of each cycle."""
    n = F.size("members")
    at = F.col("pos")
    return (
        numbered(cycles)
        .select("cycle_nr", "members", n.cast("long").alias("cycle_size"), F.posexplode("members").alias("pos", "component"))
        .select(
            "cycle_nr",
            "cycle_size",
            "component",
            F.element_at("members", F.pmod(at + 1, n) + 1).alias("cycle_successor"),
            F.element_at("members", F.pmod(at - 1, n) + 1).alias("cycle_predecessor"),
        )
    )


def largest_cycle(cycles: DataFrame) -> DataFrame:
    """The longest cycle, of several the first in text order; without cycles no rows."""
    top = cycles.orderBy(F.size("members").desc(), "cycle").limit(1)
    return cycle_neighbours(top).select("component", "cycle_successor", "cycle_predecessor")


def cycles_per_component(cycles: DataFrame) -> DataFrame:
    """``name, cycles__short__count, __avg, __max``. Cycles are closed lists, so the smallest node of each counts twice."""
    closed = F.concat("members", F.slice("members", 1, 1))
    rows = cycles.select(F.explode(closed).alias("name"), F.size("members").alias("n"))
    return rows.groupBy("name").agg(
        F.count(F.lit(1)).alias("cycles__short__count"),
        F.avg("n").alias("cycles__short__avg"),
        F.max("n").cast("long").alias("cycles__short__max"),
    )


def betweenness(edges: DataFrame) -> DataFrame:
    """``name, graph__betweenness``: directed, not normalised; each task has the shares of some of the sources."""

    def kernel(adj: K.Adjacency, sources: list[str]) -> list[tuple]:
        return list(K.betweenness(adj, sources).items())

    rows = per_graph(edges, kernel, "name string, graph__betweenness double", joined=betweenness_by_level, spread=True)
    return rows.groupBy("name").agg(F.sum("graph__betweenness").alias("graph__betweenness"))


def betweenness_by_level(edges: DataFrame) -> DataFrame:
    """The same as :func:`betweenness` for graphs of any size: shares are handed back from each level to the one before.

    Shortest paths are counted as doubles; more of them between two nodes than a double holds is an error.
    """
    edges = checkpointed(edges.select("from", "to"))
    dist = _levels(edges, ways="double")
    ways = F.when(F.col("ways") < float("inf"), F.col("ways")).otherwise(F.raise_error(F.lit("too many shortest paths")))
    total = graph_nodes(edges).select("name", F.lit(0.0).alias("need"))
    handed = _none(edges, "s string, b string, need double")
    for level in range(dist.agg(F.max("distance")).first()[0] or 0, 1, -1):
        far = dist.where(F.col("distance") == level).select(F.col("src").alias("s"), F.col("dst").alias("b"), ways.alias("ways_b"))
        far = far.join(handed, ["s", "b"], "left").select("s", "b", "ways_b", F.coalesce("need", F.lit(0.0)).alias("need"))
        near = dist.where(F.col("distance") == level - 1).select("src", "dst", ways.alias("ways_a"))
        steps = near.join(edges, near["dst"] == edges["from"]).select("src", "dst", "to", "ways_a")
        handed = checkpointed(
            steps.join(far, (F.col("src") == F.col("s")) & (F.col("to") == F.col("b")))
            .groupBy("src", "dst")
            .agg(F.sum(F.col("ways_a") / F.col("ways_b") * (1 + F.col("need"))).alias("need"))
            .select(F.col("src").alias("s"), F.col("dst").alias("b"), "need")
        )
        total = checkpointed(total.union(handed.select("b", "need")).groupBy("name").agg(F.sum("need").alias("need")))
    return total.select("name", F.col("need").alias("graph__betweenness"))


def page_rank(edges: DataFrame, nodes: DataFrame, rounds: int = 20, damping: float = 0.85, tolerance: float = 0.0) -> DataFrame:
    """``name, graph__page_rank`` after ``rounds`` rounds over all edges; nodes without successors give to all.

    Rounds end earlier once one changes the ranks by less than ``tolerance`` in sum.
    """
    edges, nodes = checkpointed(edges), checkpointed(nodes)
    n = nodes.count()
    if not n:
        return nodes.select("name", F.lit(0.0).alias("graph__page_rank"))
    degree = edges.groupBy("from").agg(F.count(F.lit(1)).alias("degree"))
    links = checkpointed(edges.join(degree, "from"))
    rank = checkpointed(nodes.join(degree, nodes["name"] == degree["from"], "left").select("name", "degree", F.lit(1.0 / n).alias("rank")))
    for i in range(rounds):
        loose = rank.where(F.col("degree").isNull()).agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        given = links.join(rank.select("name", "rank"), F.col("from") == F.col("name")).groupBy(F.col("to").alias("t")).agg(
            F.sum(F.col("rank") / F.col("degree")).alias("given")
        )
        new = F.lit((1 - damping) / n + damping * loose / n) + damping * F.coalesce("given", F.lit(0.0))
        rank = rank.join(given, F.col("name") == F.col("t"), "left").select(
            "name", "degree", new.alias("rank"), F.abs(new - F.col("rank")).alias("change")
        )
        rank = checkpointed(rank)
        if tolerance and rank.agg(F.sum("change")).first()[0] < tolerance:
            break
    return rank.select("name", F.col("rank").alias("graph__page_rank"))


def hits(edges: DataFrame, nodes: DataFrame, rounds: int = 20, tolerance: float = 0.0) -> DataFrame:
    """``name, graph__hits__hub_score, graph__hits__authority_score`` after ``rounds`` rounds, each of length 1.

    Rounds end earlier once one changes the hub scores by less than ``tolerance`` in sum.
    """
    edges, nodes = checkpointed(edges), checkpointed(nodes)
    hub = nodes.select("name", F.lit(1.0).alias("hub"))
    auth = nodes.select("name", F.lit(0.0).alias("auth"))

    def scaled(values: DataFrame, c: str) -> DataFrame:
        values = checkpointed(values)
        size = values.agg(F.coalesce(F.sqrt(F.sum(F.col(c) * F.col(c))), F.lit(0.0))).first()[0] or 1.0
        return values.withColumn(c, F.col(c) / size)

    for _ in range(rounds):
        last = hub.select("name", F.col("hub").alias("last"))
        got = edges.join(hub, edges["from"] == hub["name"]).groupBy(F.col("to").alias("t")).agg(F.sum("hub").alias("got"))
        auth = scaled(nodes.join(got, F.col("name") == F.col("t"), "left").select("name", F.coalesce("got", F.lit(0.0)).alias("auth")), "auth")
        got = edges.join(auth, edges["to"] == auth["name"]).groupBy(F.col("from").alias("t")).agg(F.sum("auth").alias("got"))
        hub = scaled(nodes.join(got, F.col("name") == F.col("t"), "left").select("name", F.coalesce("got", F.lit(0.0)).alias("hub")), "hub")
        if tolerance and (hub.join(last, "name").agg(F.sum(F.abs(F.col("hub") - F.col("last")))).first()[0] or 0.0) < tolerance:
            break
    return hub.join(auth, "name").select(
        "name", F.col("hub").alias("graph__hits__hub_score"), F.col("auth").alias("graph__hits__authority_score")
    )


def ranks(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``name, graph__page_rank, graph__hits__hub_score, graph__hits__authority_score``, converged.

    Both are of the whole graph, so islands do not part it. Up to ``ONE_TASK`` edges it is one task, at a 100 bytes each;
    beyond that the rounds run as joins, with the same tolerance and bound on rounds.
    """
    edges = edges.select("from", "to")
    if edges.count() > ONE_TASK:
        converged = {"rounds": K.ROUNDS, "tolerance": K.TOLERANCE}
        return page_rank(edges, nodes, **converged).join(hits(edges, nodes, **converged), "name")

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        linked = pdf[pdf["to"].notna()]
        adj = K.adjacency(list(zip(linked["from"], linked["to"], strict=True)))
        adj = {n: adj.get(n, []) for n in sorted(set(pdf["from"]) | set(adj))}
        rank, score = K.page_rank(adj), K.hits(adj)
        return pd.DataFrame(
            [(n, rank[n], *score[n]) for n in adj],
            columns=["name", "graph__page_rank", "graph__hits__hub_score", "graph__hits__authority_score"],
        )

    whole = edges.unionByName(nodes.select(F.col("name").alias("from"), F.lit(None).cast("string").alias("to")))
    schema = "name string, graph__page_rank double, graph__hits__hub_score double, graph__hits__authority_score double"
    return whole.groupBy(F.lit(1).alias("whole")).applyInPandas(kernel, schema)


def communities(edges: DataFrame) -> DataFrame:
    """``component, community_nr, community_size``: Louvain, the same every time; numbered from 0 by smallest member."""

    def kernel(adj: K.Adjacency) -> list[tuple]:
        return [(n, c[0], len(c)) for c in K.communities(adj) for n in c]

    rows = per_graph(edges, kernel, "component string, head string, community_size long")
    heads = in_order(rows.select("head").distinct(), "head", "community_nr")
    return rows.join(heads, "head").select("component", "community_nr", "community_size")


def induced(edges: DataFrame, members: DataFrame, group: str) -> DataFrame:
    """Edges with both ends in the same group: ``from, to, <group>``. ``members``: ``component, <group>``."""
    a = members.select(F.col("component").alias("from"), F.col(group).alias("ga"))
    b = members.select(F.col("component").alias("to"), F.col(group).alias("gb"))
    ends = edges.select("from", "to").join(a, "from").join(b, "to")
    return ends.where(F.col("ga") == F.col("gb")).select("from", "to", F.col("ga").alias(group))


#: The metrics of a graph, in their order.
METRICS = (
    "modularity__coupling__dependents",
    "modularity__coupling__dependencies",
    "cycles__short__count",
    "cycles__short__avg",
    "cycles__short__max",
    "modularity__coupling__afferent",
    "modularity__coupling__efferent",
    "graph__betweenness",
    "graph__page_rank",
    "graph__hits__hub_score",
    "graph__hits__authority_score",
    "graph__harmonic_centrality",
    "graph__farness_centrality",
    "graph__residual_closeness",
)
_WHOLE = {m for m in METRICS if m.startswith("modularity") or m in ("cycles__short__count", "cycles__short__max")}


def _kernel_metrics(adj: K.Adjacency) -> dict[str, dict[str, float]]:
    """The metrics that follow from the distinct edges alone, of every node."""
    out: dict[str, dict[str, float]] = {n: dict.fromkeys(METRICS, 0.0) for n in adj}
    for a, bs in adj.items():
        out[a]["modularity__coupling__dependencies"] = len(bs)
        for b in bs:
            out[b]["modularity__coupling__dependents"] += 1
    sizes: dict[str, list[int]] = {}
    for c in K.shortest_cycles(adj):
        for n in [*c, c[0]]:
            sizes.setdefault(n, []).append(len(c))
    for n, v in sizes.items():
        out[n] |= {"cycles__short__count": len(v), "cycles__short__avg": sum(v) / len(v), "cycles__short__max": max(v)}
    for n, x in K.betweenness(adj).items():
        out[n]["graph__betweenness"] = x
    for n, x in K.page_rank(adj).items():
        out[n]["graph__page_rank"] = x
    for n, (h, a) in K.hits(adj).items():
        out[n] |= {"graph__hits__hub_score": h, "graph__hits__authority_score": a}
    for s in adj:
        for t, d in K.shortest_from(adj, s)[0].items():
            if d:
                out[t]["graph__harmonic_centrality"] += 1 / d
                out[t]["graph__farness_centrality"] += d
                out[t]["graph__residual_closeness"] += 2.0**-d
    return out


def couplings(connections: DataFrame) -> DataFrame:
    """``name`` with distinct importing files towards it (afferent) and from it (efferent), and distinct neighbours."""
    real = connections.where(F.col("from") != F.col("to"))
    into = real.groupBy(F.col("to").alias("name")).agg(
        F.count_distinct("file").alias("modularity__coupling__afferent"), F.count_distinct("from").alias("modularity__coupling__dependents")
    )
    out = real.groupBy(F.col("from").alias("name")).agg(
        F.count_distinct("file").alias("modularity__coupling__efferent"), F.count_distinct("to").alias("modularity__coupling__dependencies")
    )
    zero = F.lit(0).cast("long")
    names = ["afferent", "efferent", "dependents", "dependencies"]
    return into.join(out, "name", "full_outer").select(
        "name", *[F.coalesce(f"modularity__coupling__{c}", zero).alias(f"modularity__coupling__{c}") for c in names]
    )


def group_metrics(connections: DataFrame, members: DataFrame, group: str, prefix: str) -> DataFrame:
    """The metrics of each member inside the subgraph of its group, with ``prefix``: ``component, <group>, metrics...``.

    Couplings count the importing files of edges inside the group.
    """
    inside = induced(distinct_edges(connections), members, group)
    schema = "name string, " + ", ".join(f"{m} {'long' if m in _WHOLE else 'double'}" for m in METRICS)

    def kernel(adj: K.Adjacency) -> list[tuple]:
        return [
            (n, *[int(v[m]) if m in _WHOLE else float(v[m]) for m in METRICS]) for n, v in _kernel_metrics(adj).items()
        ]

    rows = per_graph(inside, kernel, schema, group).drop("modularity__coupling__afferent", "modularity__coupling__efferent", group)
    a = members.select(F.col("component").alias("from"), F.col(group).alias("ga"))
    b = members.select(F.col("component").alias("to"), F.col(group).alias("gb"))
    kept = connections.join(a, "from").join(b, "to").where(F.col("ga") == F.col("gb"))
    files = couplings(kept).select("name", "modularity__coupling__afferent", "modularity__coupling__efferent")
    out = members.join(rows, members["component"] == rows["name"], "left").drop("name")
    out = out.join(files, out["component"] == files["name"], "left").drop("name")
    zero: Callable[[str], Column] = lambda m: F.lit(0).cast("long") if m in _WHOLE else F.lit(0.0)
    kept_columns = [c for c in members.columns]
    return out.select(*kept_columns, *[F.coalesce(m, zero(m)).alias(prefix + m) for m in METRICS])

