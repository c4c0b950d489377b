"""Algorithms on one graph that fits in a task, in plain Python; node names are strings, edges are distinct, without loops."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Collection

Adjacency = dict[str, list[str]]

#: Ranks have converged when a round changes them by less in sum; and the most rounds.
TOLERANCE, ROUNDS = 1e-10, 500


def adjacency(edges: list[tuple[str, str]]) -> Adjacency:
    """Successors of every node, each list sorted; nodes without successors have an empty one."""
    out: Adjacency = {}
    for a, b in sorted(set(edges)):
        out.setdefault(a, [])
        out.setdefault(b, [])
        if a != b:
            out[a].append(b)
    return dict(sorted(out.items()))


def shortest_from(adj: Adjacency, source: str) -> tuple[dict[str, int], dict[str, int], dict[str, str | None]]:
    """Distance, number of shortest paths, and the step before on the smallest path in text order, of each node reached.

    Levels are walked in the order of their smallest paths, so the first step to reach a node is the smallest.
    """
    dist, ways, before = {source: 0}, {source: 1}, {source: None}
    queue = deque([source])
    while queue:
        a = queue.popleft()
        for b in adj[a]:
            if b not in dist:
                dist[b], ways[b], before[b] = dist[a] + 1, 0, a
                queue.append(b)
            if dist[b] == dist[a] + 1:
                ways[b] += ways[a]
    return dist, ways, before


def path_to(before: dict[str, str | None], node: str) -> list[str]:
    out = [node]
    while before[out[-1]] is not None:
        out.append(before[out[-1]])
    return out[::-1]


def all_shortest_paths(adj: Adjacency, source: str) -> list[list[str]]:
    """Every shortest path from ``source`` to every other node it reaches, ties included."""
    dist, _, _ = shortest_from(adj, source)
    paths = {source: [[source]]}
    for b in sorted(dist, key=lambda n: (dist[n], n)):
        for a in (x for x in dist if dist[x] + 1 == dist[b] and b in adj[x]):
            paths.setdefault(b, []).extend(p + [b] for p in paths[a])
    return [p for n, ps in paths.items() if n != source for p in ps]


def strong_components(adj: Adjacency) -> list[list[str]]:
    """Strongly connected components, singles included, each sorted, ordered by their smallest node (Tarjan, iterative)."""
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    on, stack, out = set(), [], []
    for root in adj:
        if root in index:
            continue
        work = [(root, iter(adj[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            step = next(rest, None)
            if step is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    group = []
                    while not group or group[-1] != node:
                        group.append(stack.pop())
                        on.discard(group[-1])
                    out.append(sorted(group))
            elif step not in index:
                index[step] = low[step] = len(index)
                stack.append(step)
                on.add(step)
                work.append((step, iter(adj[step])))
            elif step in on:
                low[node] = min(low[node], index[step])
    return sorted(out)


def rotated(cycle: list[str]) -> list[str]:
    """The cycle (not closed) with its smallest node first, direction kept."""
    at = cycle.index(min(cycle))
    return cycle[at:] + cycle[:at]


def shortest_cycles(adj: Adjacency, ends: Collection[str] | None = None) -> list[list[str]]:
    """Per edge inside a strongly connected component its smallest shortest way back, as distinct cycles, not closed.

    ``ends`` limits the edges to those that end there.
    """
    found = set()
    ends = adj if ends is None else set(ends)
    for group in strong_components(adj):
        if len(group) < 2:
            continue
        inside = set(group)
        sub = {n: [m for m in adj[n] if m in inside] for n in group}
        for v in group:
            if v not in ends:
                continue
            _, _, before = shortest_from(sub, v)
            for p in group:
                if v in sub[p]:
                    found.add(tuple(rotated(path_to(before, p))))
    return [list(c) for c in sorted(found)]


def elementary_cycles(adj: Adjacency, starts: Collection[str] | None = None) -> list[list[str]]:
    """All elementary cycles, smallest node first, not closed; ``starts`` limits their smallest nodes.

    From each start node, in order, paths over later nodes of its component are followed; a blocked node is left until a
    cycle through it closes (Johnson's rule), so time is bounded by the number of cycles.
    """
    out = []
    starts = adj if starts is None else set(starts)
    for group in strong_components(adj):
        nodes = list(group)
        while len(nodes) > 1:
            start = nodes[0]
            if start in starts:
                inside = set(nodes)
                sub = {n: [m for m in adj[n] if m in inside] for n in nodes}
                part = set(next(g for g in strong_components(sub) if start in g))
                sub = {n: [m for m in sub[n] if m in part] for n in sorted(part)}
                _cycles_from(start, sub, out)
            nodes = nodes[1:]
    return sorted(out)


def _cycles_from(start: str, sub: Adjacency, out: list[list[str]]) -> None:
    blocked, waiting = {start}, defaultdict(set)
    path, closed = [start], set()
    work = [(start, iter(sub.get(start, ())))]
    while work:
        node, rest = work[-1]
        step = next(rest, None)
        if step is not None:
            if step == start:
                out.append(list(path))
                closed.update(path)
            elif step not in blocked:
                path.append(step)
                closed.discard(step)
                blocked.add(step)
                work.append((step, iter(sub[step])))
            continue
        if node in closed:
            free = [node]
            while free:
                x = free.pop()
                if x in blocked:
                    blocked.discard(x)
                    free += waiting.pop(x, ())
        else:
            for m in sub[node]:
                waiting[m].add(node)
        work.pop()
        path.pop()
        if work and node in closed:
            closed.add(work[-1][0])


def betweenness(adj: Adjacency, sources: Collection[str] | None = None) -> dict[str, float]:
    """Directed betweenness, not normalised: shares of shortest paths between other nodes (Brandes), from ``sources`` or all."""
    total = dict.fromkeys(adj, 0.0)
    for s in adj if sources is None else sources:
        dist, ways, _ = shortest_from(adj, s)
        need = dict.fromkeys(dist, 0.0)
        for a in sorted(dist, key=dist.get, reverse=True):
            for b in adj[a]:
                if dist.get(b) == dist[a] + 1:
                    need[a] += ways[a] / ways[b] * (1 + need[b])
            if a != s:
                total[a] += need[a]
    return total


def page_rank(adj: Adjacency, damping: float = 0.85) -> dict[str, float]:
    """PageRank that sums to 1; nodes without successors give to all. No edges: zeros."""
    n = len(adj)
    if not any(adj.values()):
        return dict.fromkeys(adj, 0.0)
    rank = dict.fromkeys(adj, 1.0 / n)
    for _ in range(ROUNDS):
        loose = sum(r for a, r in rank.items() if not adj[a])
        new = dict.fromkeys(adj, (1 - damping) / n + damping * loose / n)
        for a, bs in adj.items():
            for b in bs:
                new[b] += damping * rank[a] / len(bs)
        change = sum(abs(new[a] - rank[a]) for a in adj)
        rank = new
        if change < TOLERANCE:
            break
    return rank


def hits(adj: Adjacency) -> dict[str, tuple[float, float]]:
    """Hub and authority of each node, each of length 1 over all nodes. No edges: zeros."""
    if not any(adj.values()):
        return {a: (0.0, 0.0) for a in adj}
    hub, auth = dict.fromkeys(adj, 1.0), {}
    for _ in range(ROUNDS):
        auth = dict.fromkeys(adj, 0.0)
        for a, bs in adj.items():
            for b in bs:
                auth[b] += hub[a]
        size = sum(x * x for x in auth.values()) ** 0.5 or 1.0
        auth = {a: x / size for a, x in auth.items()}
        new = {a: sum(auth[b] for b in bs) for a, bs in adj.items()}
        size = sum(x * x for x in new.values()) ** 0.5 or 1.0
        new = {a: x / size for a, x in new.items()}
        change = sum(abs(new[a] - hub[a]) for a in adj)
        hub = new
        if change < TOLERANCE:
            break
    return {a: (hub[a], auth[a]) for a in adj}


def communities(adj: Adjacency, resolution: float = 1.0) -> list[list[str]]:
    """Louvain communities by modularity of the directed edges; nodes in text order, so the result is always the same."""
    members = {i: [n] for i, n in enumerate(adj)}
    ids = {n: i for i, n in enumerate(adj)}
    weight: dict[tuple[int, int], float] = defaultdict(float)
    for a, bs in adj.items():
        for b in bs:
            weight[ids[a], ids[b]] += 1.0
    m = sum(weight.values())
    if not m:
        return sorted(members.values())
    while True:
        nodes = sorted(members)
        out_w, in_w, links = defaultdict(float), defaultdict(float), defaultdict(lambda: defaultdict(float))
        for (a, b), w in weight.items():
            out_w[a] += w
            in_w[b] += w
            if a != b:
                links[a][b] += w
                links[b][a] += w
        home = {n: n for n in nodes}
        sum_out, sum_in = dict(out_w), dict(in_w)
        moved_any, moved = False, True
        while moved:
            moved = False
            for n in nodes:
                old = home[n]
                sum_out[old] = sum_out.get(old, 0.0) - out_w[n]
                sum_in[old] = sum_in.get(old, 0.0) - in_w[n]
                near = defaultdict(float)
                for o, w in links[n].items():
                    near[home[o]] += w
                near.setdefault(old, 0.0)
                gain = {
                    c: w / m - resolution * (out_w[n] * sum_in.get(c, 0.0) + in_w[n] * sum_out.get(c, 0.0)) / m**2
                    for c, w in near.items()
                }
                best = max(sorted(gain), key=lambda c: (gain[c], c == old))
                if gain[best] <= gain[old] + 1e-12:
                    best = old
                home[n] = best
                sum_out[best] = sum_out.get(best, 0.0) + out_w[n]
                sum_in[best] = sum_in.get(best, 0.0) + in_w[n]
                if best != old:
                    moved = moved_any = True
        if not moved_any:
            break
        new_members, new_weight = defaultdict(list), defaultdict(float)
        for n in nodes:
            new_members[home[n]] += members[n]
        for (a, b), w in weight.items():
            new_weight[home[a], home[b]] += w
        members, weight = dict(new_members), new_weight
    return sorted(sorted(v) for v in members.values())
