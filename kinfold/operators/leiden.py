"""The Leiden algorithm (Traag, Waltman and van Eck, 2019) on one graph in memory, seeded.

All four qualities have one form: the weight inside communities less ``gamma`` times half the square of each community's
node weight. A node weighs 1 for constant Potts and Erdos-Renyi, its strength for modularity and the configuration model.
"""

from __future__ import annotations

import math
import random
from collections import deque

QUALITIES = ("mvp", "rbcv", "rber", "cmp")
ITERATIONS = 10
THETA = 0.01


class Graph:
    def __init__(self, n: int, edges: list[tuple[int, int, float]], weights: list[float] | None = None):
        self.n, self.adj, self.loops = n, [{} for _ in range(n)], [0.0] * n
        for u, v, w in edges:
            if u == v:
                self.loops[u] += w
            else:
                self.adj[u][v] = self.adj[u].get(v, 0.0) + w
                self.adj[v][u] = self.adj[v].get(u, 0.0) + w
        self.total = sum(sum(a.values()) for a in self.adj) / 2 + sum(self.loops)
        self.weight = weights or [1.0] * n


def scaled(n: int, edges: list[tuple[int, int, float]], quality: str, resolution: float, sizes: list[float] | None = None) -> tuple[Graph, float]:
    """The graph with node weights, and ``gamma``, of a quality at a resolution (which modularity hasn't). ``sizes``: how many vertices each node stands for; a node's own links are loops."""
    g = weighted(n, edges, quality, sizes)
    return g, gamma_at(g, quality, resolution)


def weighted(n: int, edges: list[tuple[int, int, float]], quality: str, sizes: list[float] | None = None) -> Graph:
    if quality not in QUALITIES:
        raise ValueError(f"no quality {quality}")
    g = Graph(n, edges, sizes)
    if quality in ("rbcv", "mvp"):
        g.weight = [sum(a.values()) + 2 * x for a, x in zip(g.adj, g.loops)]
    return g


def gamma_at(g: Graph, quality: str, resolution: float) -> float:
    if quality == "cmp":
        return resolution
    if quality == "rber":
        n = sum(g.weight)
        return resolution * (g.total / (n * (n - 1) / 2) if n > 1 else 0.0)
    return (1.0 if quality == "mvp" else resolution) / (2 * g.total or 1.0)


def value(g: Graph, gamma: float, part: list[int]) -> float:
    inside, weight = 0.0, {}
    for u in range(g.n):
        here = part[u]
        inside += g.loops[u] + sum([w for v, w in g.adj[u].items() if part[v] == here]) / 2
        weight[here] = weight.get(here, 0.0) + g.weight[u]
    return inside - gamma * sum(w * w for w in weight.values()) / 2


def _move(g: Graph, gamma: float, part: list[int], rng: random.Random) -> bool:
    """Local moves until no node gains; true if any moved."""
    weight: dict[int, float] = {}
    for u, c in enumerate(part):
        weight[c] = weight.get(c, 0.0) + g.weight[u]
    free = g.n
    order = list(range(g.n))
    rng.shuffle(order)
    queue, waiting, moved = deque(order), [True] * g.n, False
    while queue:
        u = queue.popleft()
        waiting[u] = False
        here = part[u]
        links: dict[int, float] = {}
        for v, w in g.adj[u].items():
            links[part[v]] = links.get(part[v], 0.0) + w
        weight[here] -= g.weight[u]
        best, gain = here, links.get(here, 0.0) - gamma * g.weight[u] * weight[here]
        for c, w in sorted(links.items()):
            x = w - gamma * g.weight[u] * weight[c]
            if x > gain + 1e-12:
                best, gain = c, x
        if gain < -1e-12:  # alone is better
            free += 1
            best = free
        weight[best] = weight.get(best, 0.0) + g.weight[u]
        if best != here:
            part[u], moved = best, True
            for v in g.adj[u]:
                if part[v] != best and not waiting[v]:
                    waiting[v] = True
                    queue.append(v)
    return moved


def _refine(g: Graph, gamma: float, part: list[int], rng: random.Random) -> list[int]:
    """Within each community, single nodes join well-connected parts at random, by gain."""
    fine, weight, alone = list(range(g.n)), list(g.weight), [True] * g.n
    whole: dict[int, float] = {}
    for u, c in enumerate(part):
        whole[c] = whole.get(c, 0.0) + g.weight[u]
    out = [sum([w for v, w in g.adj[u].items() if part[v] == c]) for u, c in enumerate(part)]  # of each part, to the rest of its community
    order = list(range(g.n))
    rng.shuffle(order)
    for u in order:
        if not alone[u] or out[u] < gamma * g.weight[u] * (whole[part[u]] - g.weight[u]):
            continue
        links: dict[int, float] = {}
        for v, w in g.adj[u].items():
            if part[v] == part[u]:
                links[fine[v]] = links.get(fine[v], 0.0) + w
        choice, odds = [fine[u]], [1.0]
        for c, w in sorted(links.items()):
            x = w - gamma * g.weight[u] * weight[c]
            if c != fine[u] and x > 0 and out[c] >= gamma * weight[c] * (whole[part[u]] - weight[c]):
                choice.append(c)
                odds.append(math.exp(min(x / THETA, 500)))
        if len(choice) == 1:
            rng.random()  # as a choice among several takes one
            continue
        c = rng.choices(choice, odds)[0]
        if c != fine[u]:
            weight[c] += weight[u]
            out[c] += out[u] - 2 * links[c]
            alone[c] = alone[u] = False
            fine[u] = c
    return fine


def _renumbered(part: list[int]) -> list[int]:
    seen: dict[int, int] = {}
    return [seen.setdefault(c, len(seen)) for c in part]


def partition(n: int, edges: list[tuple[int, int, float]], quality: str = "rber", resolution: float = 1.0, seed: int = 0, iterations: int = ITERATIONS) -> tuple[list[int], float]:
    """(community of each node, quality). The same seed gives the same result."""
    return search(*scaled(n, edges, quality, resolution), seed, iterations)


def search(g0: Graph, gamma: float, seed: int = 0, iterations: int = ITERATIONS) -> tuple[list[int], float]:
    """``partition`` of a graph that has been made."""
    rng = random.Random(seed)
    part = list(range(g0.n))
    now = value(g0, gamma, part)
    for _ in range(iterations):
        before = now
        g, level, at = g0, _renumbered(part), list(range(g0.n))  # at: each node's place in the aggregate
        while True:
            moved = _move(g, gamma, level, rng)
            level = _renumbered(level)
            fine = _renumbered(_refine(g, gamma, level, rng))
            k = max(fine, default=-1) + 1
            if k == g.n and not moved or k <= 1:
                break
            links: dict[tuple[int, int], float] = {}
            weight = [0.0] * k
            up = [0] * k
            for u in range(g.n):
                weight[fine[u]] += g.weight[u]
                up[fine[u]] = level[u]
                if g.loops[u]:
                    links[fine[u], fine[u]] = links.get((fine[u], fine[u]), 0.0) + g.loops[u]
                for v, w in g.adj[u].items():
                    if u < v:
                        key = (min(fine[u], fine[v]), max(fine[u], fine[v]))
                        links[key] = links.get(key, 0.0) + w
            if k == g.n:
                break
            at = [fine[x] for x in at]
            g, level = Graph(k, [(u, v, w) for (u, v), w in links.items()], weight), up
        part = _renumbered([level[x] for x in at])
        now = value(g0, gamma, part)
        if now <= before + 1e-12:
            break
    return part, now
