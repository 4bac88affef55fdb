"""Patterns: small labelled graphs that live on the driver."""

from __future__ import annotations

from collections import Counter, deque
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Pattern:
    """labels by vertex; undirected edges as (smaller, larger)."""

    labels: dict[int, str]
    edges: frozenset[tuple[int, int]] = field(default_factory=frozenset)

    @classmethod
    def of(cls, labels: dict[int, str] | list[str], edges) -> Pattern:
        labels = dict(enumerate(labels)) if isinstance(labels, list) else dict(labels)
        pairs = frozenset((min(a, b), max(a, b)) for a, b in edges if a != b)
        if missing := {v for e in pairs for v in e} - set(labels):
            raise ValueError(f"edges name vertices without a label: {sorted(missing)}")
        return cls(labels, pairs)

    @property
    def vertices(self) -> list[int]:
        return sorted(self.labels)

    def adjacent(self, a: int, b: int) -> bool:
        return (min(a, b), max(a, b)) in self.edges

    def neighbours(self, u: int) -> list[int]:
        return sorted(b if a == u else a for a, b in self.edges if u in (a, b))

    def degree(self, u: int) -> int:
        return len(self.neighbours(u))

    def profile(self, u: int) -> Counter:
        """The vertex's own label and its neighbours', as a multiset."""
        return Counter([self.labels[u], *(self.labels[v] for v in self.neighbours(u))])

    def token_profile(self, u: int) -> Counter:
        return Counter(t for label, n in self.profile(u).items() for t in label.split(",") for _ in range(n))

    def leaves(self) -> list[int]:
        return [u for u in self.vertices if self.degree(u) == 1]

    def shifted(self, by: int) -> Pattern:
        return Pattern({u + by: label for u, label in self.labels.items()}, frozenset((a + by, b + by) for a, b in self.edges))

    def union(self, other: Pattern) -> tuple[Pattern, int]:
        """The disjoint union with ``other`` moved behind, and by how much it was moved."""
        by = max(self.labels, default=-1) + 1 - min(other.labels, default=0)
        moved = other.shifted(by)
        return Pattern(self.labels | moved.labels, self.edges | moved.edges), by

    def with_edges(self, more) -> Pattern:
        return Pattern.of(self.labels, [*self.edges, *more])

    def without_edge(self, edge) -> Pattern:
        return Pattern(self.labels, self.edges - {(min(edge), max(edge))})

    def breadth_first(self, root: int) -> list[tuple[int, int]]:
        """(vertex, layer) from the root, neighbours by ascending id."""
        seen, queue, out = {root}, deque([(root, 0)]), []
        while queue:
            u, layer = queue.popleft()
            out.append((u, layer))
            for v in self.neighbours(u):
                if v not in seen:
                    seen.add(v)
                    queue.append((v, layer + 1))
        return out

    def components(self) -> list[list[int]]:
        left, out = set(self.labels), []
        while left:
            part = [u for u, _ in self.breadth_first(min(left))]
            left -= set(part)
            out.append(sorted(part))
        return out

    def connected(self) -> bool:
        return len(self.components()) <= 1

    def diameter(self) -> int | None:
        """The longest shortest path; None if not connected or empty."""
        if not self.labels or not self.connected():
            return None
        return max(layer for u in self.vertices for _, layer in self.breadth_first(u))

    def average_degree(self) -> float:
        return 2 * len(self.edges) / len(self.labels) if self.labels else 0.0

    def density(self) -> float:
        n = len(self.labels)
        return 2 * len(self.edges) / (n * (n - 1)) if n > 1 else 0.0
