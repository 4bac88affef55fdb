"""Depth-first search with failing sets, for its counters; matches themselves come from the join chain.

A failing set names the pattern vertices that are to blame for a dead end. Where a subtree fails for reasons that the current
vertex has no part in, its other candidates fail alike and are cut off. Every candidate of the first vertex is the root of a
search of its own, so roots are dealt to tasks; the candidate space that they search is sent to all of them, behind a check of its size.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.candidates import edge_candidates
from weftgraph.operators.matcher import Plan
from weftgraph.plans.planner import ancestors, directed

#: Most edges of a candidate space, 32 bytes each, that are sent to all executors.
FEW = 1_000_000
COUNTERS = ("n_calls", "n_full", "n_cut", "n_empty", "n_conflicts")


class Search:
    """The counters of searches over a candidate space. edges: (u, w, v, x) for edges of the pattern from earlier to later; apart: the same for pairs that must not be linked."""

    def __init__(self, plan_order: list[int], links: list[tuple[int, int]], edges, apart, cut: bool = True):
        self.order, self.cut = plan_order, cut
        place = {u: i for i, u in enumerate(plan_order)}
        self.before = {u: [a for a, b in links if b == u] for u in plan_order}
        above = {u: ancestors(sorted(links, key=lambda e: place[e[0]]), u) | {u} for u in plan_order}
        self.above = {u: frozenset(x) for u, x in above.items()}
        self.to: dict[tuple[int, int, int], set[int]] = {}
        for u, w, v, x in edges:
            self.to.setdefault((u, w, v), set()).add(x)
        self.apart = {(u, v, w, x) for u, w, v, x in apart}
        self.counts = dict.fromkeys(COUNTERS, 0)

    def run(self, candidates: dict[int, list[int]], root: int) -> dict[str, int]:
        self.candidates, self.image, self.taken = candidates, {self.order[0]: root}, {root: self.order[0]}
        self.counts = dict.fromkeys(COUNTERS, 0)
        self.counts["n_calls"] = 1
        self._below(1)
        return self.counts

    def _left(self, u: int) -> list[int]:
        """Candidates of u next to the images of all its earlier neighbours."""
        sets = [self.to.get((w, u, self.image[w]), set()) for w in self.before[u]]
        return sorted(set.intersection(*sets)) if sets else self.candidates[u]

    def _below(self, i: int) -> frozenset[int]:
        """The failing set of the current partial match; empty where it leads to a match."""
        if i == len(self.order):
            self.counts["n_full"] += 1
            return frozenset()
        u = self.order[i]
        left = self._left(u)
        if not left:
            self.counts["n_empty"] += 1
            return self.above[u]
        blame, found = self.above[u], False
        for v in left:
            self.counts["n_calls"] += 1
            if v in self.taken:
                self.counts["n_conflicts"] += 1
                blame |= self.above[self.taken[v]]
                continue
            far = [w for w, x in self.image.items() if (w, x, u, v) in self.apart or (u, v, w, x) in self.apart]
            if far:
                blame |= frozenset().union(*(self.above[w] for w in far))
                continue
            self.image[u], self.taken[v] = v, u
            part = self._below(i + 1)
            del self.image[u], self.taken[v]
            if not part:
                found = True
            elif u not in part and not found and self.cut:
                self.counts["n_cut"] += 1
                return part
            else:
                blame |= part
        return frozenset() if found else blame


def failing_set_counters(p: Plan, induced: bool, cut: bool = True) -> DataFrame:
    """One row: n_calls, n_full (matches), n_cut (subtrees whose blame cut off the candidates after it), n_empty (no candidate left), n_conflicts (candidate taken).

    cut: whether failing sets cut anything off; without, every call of the search counts. A candidate space of more than FEW edges is an error.
    """
    spark = p.pairs.sparkSession
    order = p.order
    links = [(a, b) for a, b in directed(p.pattern, order)]
    place = {u: i for i, u in enumerate(order)}
    links = [(a, b) if place[a] < place[b] else (b, a) for a, b in links]
    apart = [(a, b) for i, a in enumerate(order) for b in order[i + 1 :] if not p.pattern.adjacent(a, b)] if induced else []

    def few(rows: DataFrame) -> list[tuple]:
        found = rows.limit(FEW + 1).collect()
        if len(found) > FEW:
            raise ValueError(f"the candidate space has over {FEW} rows")
        return [tuple(r) for r in found]

    def space(pairs: list[tuple[int, int]]) -> list[tuple]:
        return few(edge_candidates(p.graph, p.pairs, pairs)) if pairs else []

    free = [u for u in order[1:] if not any(b == u for _, b in links)]  # first vertices of further components
    sent = spark.sparkContext.broadcast((space(links), space(apart), {u: [v for (v,) in few(p.pairs.filter(F.col("u") == u).select("v"))] for u in free}))

    def search(batches):
        edges, far, candidates = sent.value
        s = Search(order, links, edges, far, cut)
        for rows in batches:
            yield pd.DataFrame([s.run(candidates, int(v)) for v in rows["v"]], columns=list(COUNTERS))

    roots = p.pairs.filter(F.col("u") == order[0]).select("v").repartition("v")
    counted = roots.mapInPandas(search, ", ".join(f"{c} long" for c in COUNTERS))
    return counted.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS])
