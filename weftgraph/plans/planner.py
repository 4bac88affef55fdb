"""Processing orders and join skeletons for patterns. Pure Python; ties go to the smallest vertex id.

sizes: number of candidates by pattern vertex; weights: number of candidate edges by pattern edge.
"""

from __future__ import annotations

from dataclasses import dataclass

from weftgraph.plans.pattern import Pattern

ORDERS = ("groundTruth", "graphQL", "quickSI", "DAF")
DYNAMIC = "dynamic"


def ground_truth_order(pattern: Pattern, sizes: dict[int, int]) -> list[int]:
    """From the vertex with the fewest candidates breadth first, component by component."""
    order: list[int] = []
    while left := [u for u in pattern.vertices if u not in order]:
        order += [u for u, _ in pattern.breadth_first(min(left, key=lambda u: (sizes[u], u)))]
    return order


def join_cost(pattern: Pattern, so_far: float, size: int, order: list[int], u: int, gamma: float) -> float:
    return so_far * size * gamma ** sum(pattern.adjacent(u, v) for v in order)


def graphql_order(pattern: Pattern, sizes: dict[int, int], gamma: float = 0.5) -> tuple[list[int], float]:
    """Greedily the vertex that makes the smallest estimated join; and the sum of the estimates."""
    first = min(pattern.vertices, key=lambda u: (sizes[u], u))
    order, cost = [first], float(sizes[first])
    total = cost
    while left := [u for u in pattern.vertices if u not in order]:
        cost, u = min((join_cost(pattern, cost, sizes[u], order, u, gamma), u) for u in left)
        order.append(u)
        total += cost
    return order, total


def quicksi_order(pattern: Pattern, sizes: dict[int, int], weights: dict[tuple[int, int], int]) -> list[int]:
    """Along a spanning tree of light edges; of equally light ones, with most links into the tree, then of the highest degree."""
    order: list[int] = []
    for component in pattern.components():
        edges = [e for e in pattern.edges if e[0] in component]
        if not edges:
            order += component
            continue
        a, b = min(edges, key=lambda e: (weights[e], -(pattern.degree(e[0]) + pattern.degree(e[1])), e))
        inside = sorted((a, b), key=lambda u: (sizes[u], -pattern.degree(u), u))
        while len(inside) < len(component):

            def rank(e):
                new = e[1] if e[0] in inside else e[0]
                return weights[e], -sum(v in inside for v in pattern.neighbours(new)), -pattern.degree(new), new

            frontier = [e for e in edges if (e[0] in inside) != (e[1] in inside)]
            inside.append(rank(min(frontier, key=rank))[-1])
        order += inside
    return order


def breadth_first_order(pattern: Pattern, order: list[int]) -> list[int]:
    """The order rearranged layer by layer from its first vertex, within a layer as before; other components follow likewise."""
    out: list[int] = []
    while left := [u for u in order if u not in out]:
        layers = dict(pattern.breadth_first(left[0]))
        out += sorted(layers, key=lambda u: (layers[u], order.index(u)))
    return out


def daf_order(pattern: Pattern, sizes: dict[int, int]) -> list[int]:
    """From the vertex with the fewest candidates for its degree, layer by layer, few candidates and high degrees first."""
    out: list[int] = []
    while left := [u for u in pattern.vertices if u not in out]:
        root = min(left, key=lambda u: (sizes[u] / max(pattern.degree(u), 1), u))
        layers = dict(pattern.breadth_first(root))
        out += sorted(layers, key=lambda u: (layers[u], sizes[u], -pattern.degree(u), u))
    return out


def directed(pattern: Pattern, order: list[int]) -> list[tuple[int, int]]:
    """The edges as (parent, child), from earlier to later in the breadth-first form of the order."""
    place = {u: i for i, u in enumerate(breadth_first_order(pattern, order))}
    return sorted(((a, b) if place[a] < place[b] else (b, a) for a, b in pattern.edges), key=lambda e: (place[e[0]], place[e[1]]))


def ancestors(edges: list[tuple[int, int]], u: int) -> set[int]:
    found: set[int] = set()
    grown = {u}
    while grown:
        grown = {a for a, b in edges if b in grown} - found
        found |= grown
    return found


@dataclass(frozen=True)
class Step:
    """How a vertex joins: from its parent's image, with edges that must be and edges that must not be there."""

    vertex: int
    parent: int | None
    extra: tuple[int, ...]
    absent: tuple[int, ...]
    degree: int


def skeleton(pattern: Pattern, order: list[int]) -> list[Step]:
    """A step for each vertex: its parent is the nearest earlier neighbour, other earlier neighbours are extra edges."""
    if sorted(order) != pattern.vertices:
        raise ValueError("an order names each vertex of the pattern once")
    steps = []
    for i, u in enumerate(order):
        linked = [v for v in order[:i] if pattern.adjacent(u, v)]
        steps.append(Step(u, linked[-1] if linked else None, tuple(linked[:-1]), tuple(v for v in order[:i] if not pattern.adjacent(u, v)), pattern.degree(u)))
    return steps


def processing_order(pattern: Pattern, sizes: dict[int, int], method: str = "graphQL", gamma: float = 0.5, weights: dict | None = None) -> list[int]:
    """The order by a method's name. The dynamic one is not among them: it chooses anew for each partial match (matcher.dynamic_levels)."""
    if method == "groundTruth":
        return ground_truth_order(pattern, sizes)
    if method == "graphQL":
        return graphql_order(pattern, sizes, gamma)[0]
    if method == "quickSI":
        if weights is None:
            raise ValueError("quickSI needs the candidate edges of each pattern edge")
        return quicksi_order(pattern, sizes, weights)
    if method == "DAF":
        return daf_order(pattern, sizes)
    raise ValueError(f"unknown processing order: {method}; known are {', '.join(ORDERS)}")
