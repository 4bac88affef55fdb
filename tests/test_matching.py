import itertools
import random

import pytest

from weftgraph.functions.columns import COMPLETE, SUBSETS
from weftgraph.operators import backtrack
from weftgraph.operators import candidates as cand
from weftgraph.operators import estimate as est
from weftgraph.operators import matcher
from weftgraph.operators.graph import LabeledGraph
from weftgraph.plans.pattern import Pattern

A, B, C, L = "A", "B", "C", "L"
K3 = Pattern.of([A] * 3, [(0, 1), (1, 2), (0, 2)])
P3 = Pattern.of([A] * 3, [(0, 1), (1, 2)])
K4 = Pattern.of([A] * 4, itertools.combinations(range(4), 2))
C4 = Pattern.of([A] * 4, [(0, 1), (1, 2), (2, 3), (0, 3)])

# target, pattern, induced, mode, mappings: counted by hand
KNOWN = [
    (K3, K3, True, COMPLETE, 6),
    (K3, K3, False, COMPLETE, 6),
    (K3, P3, False, COMPLETE, 6),
    (K3, P3, True, COMPLETE, 0),
    (P3, Pattern.of([A, A], [(0, 1)]), True, COMPLETE, 4),
    (Pattern.of([C, L, L, L], [(0, 1), (0, 2), (0, 3)]), Pattern.of([C, L, L], [(0, 1), (0, 2)]), True, COMPLETE, 6),
    (K4, K3, True, COMPLETE, 24),
    (C4, P3, True, COMPLETE, 8),
    (Pattern.of([A, B], []), Pattern.of([A], []), True, COMPLETE, 1),
    (Pattern.of([A] * 3, [(0, 1)]), Pattern.of([A, A], []), False, COMPLETE, 6),
    (Pattern.of([A] * 3, [(0, 1)]), Pattern.of([A, A], []), True, COMPLETE, 4),
    (Pattern.of(["A,B", "A"], [(0, 1)]), Pattern.of([A], []), True, SUBSETS, 2),
    (Pattern.of(["A,B", "A"], [(0, 1)]), Pattern.of([A], []), True, COMPLETE, 1),
    (Pattern.of(["A,B"], []), Pattern.of(["A,A"], []), True, SUBSETS, 0),
    (P3, K3, False, COMPLETE, 0),
]


def brute(target: Pattern, pattern: Pattern, induced: bool) -> set[tuple]:
    """All injective mappings that keep labels, degrees and edges (and non-edges)."""
    us, out = pattern.vertices, set()
    for image in itertools.permutations(target.vertices, len(us)):
        to = dict(zip(us, image))
        if any(pattern.labels[u] != target.labels[to[u]] or pattern.degree(u) > target.degree(to[u]) for u in us):
            continue
        pairs = list(itertools.combinations(us, 2))
        if all(target.adjacent(to[a], to[b]) for a, b in pairs if pattern.adjacent(a, b)) and not (induced and any(target.adjacent(to[a], to[b]) for a, b in pairs if not pattern.adjacent(a, b))):
            out.add(image)
    return out


@pytest.mark.parametrize("target,pattern,induced,mode,n", KNOWN)
def test_known_counts(spark, target, pattern, induced, mode, n):
    g = LabeledGraph.from_pattern(spark, target) if target.edges else LabeledGraph(spark.createDataFrame(sorted(target.labels.items()), "id long, label string"), spark.createDataFrame([], "src long, dst long"))
    pairs = cand.label_degree_profile(g, pattern, mode)
    assert matcher.embeddings(g, pattern, pairs, pattern.vertices, induced).count() == n


def _random(rng: random.Random, n: int, labels: str, p: float) -> Pattern:
    return Pattern.of([rng.choice(labels) for _ in range(n)], [e for e in itertools.combinations(range(n), 2) if rng.random() < p])


def test_algorithms_agree_with_brute_force(spark):
    rng = random.Random(5)
    target = _random(rng, 9, "AB", 0.45)
    pattern = Pattern.of(["A", "B", "A", "B"], [(0, 1), (1, 2), (2, 3), (0, 2)])
    g = LabeledGraph.from_pattern(spark, target).cached()
    for by, order, enumeration in (("graphQL", "graphQL", "quickSI"), ("DAF", "DAF", "DAF"), ("groundTruth", "quickSI", "VEQs")):
        plan = matcher.plan(g, pattern, matcher.Config(by, order, enumeration))
        for induced in (False, True):
            assert {tuple(r) for r in plan.matches(induced).collect()} == brute(target, pattern, induced)


def test_filters_only_shrink_and_lose_no_match(spark):
    rng = random.Random(8)
    target = _random(rng, 10, "AB", 0.4)
    g = LabeledGraph.from_pattern(spark, target).cached()
    pattern = Pattern.of(["A", "B", "B", "A"], [(0, 1), (0, 2), (1, 2), (2, 3)])
    rows = lambda df: {(r["u"], r["v"]) for r in df.collect()}
    ldf, profile = cand.label_degree(g, pattern), cand.label_degree_profile(g, pattern)
    globally = cand.prune_globally(g, pattern, profile)
    refined, dropped = cand.refine(g, pattern, ldf, [0, 1, 2, 3])
    assert rows(ldf) >= rows(profile) >= rows(globally) and rows(ldf) >= rows(refined)
    assert dropped == len(rows(ldf)) - len(rows(refined))
    needed = {(u, v) for image in brute(target, pattern, False) for u, v in zip(pattern.vertices, image)}
    assert needed <= rows(globally) and needed <= rows(refined)


def test_hall_by_subsets_and_by_paths_are_the_same(spark, monkeypatch):
    rng = random.Random(3)
    g = LabeledGraph.from_pattern(spark, _random(rng, 10, "AB", 0.5)).cached()
    pattern = Pattern.of(["A", "B", "B", "A"], [(0, 1), (0, 2), (0, 3), (1, 2)])
    pairs = cand.label_degree(g, pattern)
    rows = lambda df: sorted(map(tuple, df.collect()))
    first = rows(cand.prune_globally(g, pattern, pairs))
    monkeypatch.setattr(cand, "SUBSETS_UP_TO", 1)
    assert rows(cand.prune_globally(g, pattern, pairs)) == first


def test_search_profile_counts_calls(spark):
    g = LabeledGraph.from_pattern(spark, K4).cached()
    pairs = cand.label_degree(g, K3)
    plan = matcher.Plan(g, K3, pairs, [0, 1, 2], {0: 4, 1: 4, 2: 4})
    rows = [tuple(r) for r in matcher.search_profile(plan, True).orderBy("level").collect()]
    assert [r[2:5] for r in rows] == [(1, 4, 4), (4, 4, 16), (12, 4, 48)]
    assert [r[5] for r in rows] == [0, 0, 0]


@pytest.mark.parametrize("induced", [False, True])
def test_dynamic_order_against_depth_first_search(spark, induced):
    """Matches and counts of a search that picks, at each partial match, the vertex with the fewest candidates next to its mapped neighbours."""
    rng = random.Random(6)
    target = _random(rng, 9, "AB", 0.45)
    for pattern in (Pattern.of(["A", "B", "A", "B"], [(0, 1), (1, 2), (2, 3), (0, 2)]), Pattern.of(["A", "B", "B"], [(0, 1)])):
        g = LabeledGraph.from_pattern(spark, target).cached()
        pairs = cand.label_degree(g, pattern)
        own = {u: {r["v"] for r in pairs.filter(f"u = {u}").collect()} for u in pattern.vertices}
        found, levels = set(), {}

        def search(m):
            if len(m) == len(pattern.vertices):
                found.add(tuple(m[u] for u in pattern.vertices))
                return
            left = {u: {x for x in own[u] if all(target.adjacent(x, m[w]) for w in pattern.neighbours(u) if w in m)} for u in pattern.vertices if u not in m}
            u = min(left, key=lambda u: (len(left[u]), -pattern.degree(u), u))
            row = levels.setdefault((len(m), u), [0, 0, 0, 0])
            row[0] += 1
            row[1] += len(left[u])
            row[2] += not left[u]
            for x in left[u]:
                if induced and any(target.adjacent(x, m[w]) for w in m if not pattern.adjacent(u, w)):
                    continue
                if x in m.values():
                    row[3] += 1
                else:
                    search({**m, u: x})

        search({})
        matches, counts = matcher.dynamic_levels(g, pattern, pairs, induced)
        assert {tuple(r) for r in matches.collect()} == found == brute(target, pattern, induced)
        assert {(r["level"], r["vertex"]): [r["n_partial"], r["n_candidates"], r["n_stuck"], r["n_conflicts"]] for r in counts.collect()} == levels
        plan = matcher.plan(g, pattern, matcher.Config("groundTruth", "dynamic", "groundTruth"))
        assert {tuple(r) for r in plan.matches(induced).collect()} == found


@pytest.mark.parametrize("induced", [False, True])
def test_failing_sets_lose_no_match(spark, induced):
    """Without cuts, the counters are those of a plain search; with them, fewer calls find as many matches."""
    rng = random.Random(11)
    fewer = 0
    for k in range(3):
        target = _random(rng, 11, "AB", 0.4)
        pattern = Pattern.of(["A", "B", "A", "B", "A"], [(0, 1), (1, 2), (2, 3), (0, 4)] + [(1, 4)] * (k % 2))
        g = LabeledGraph.from_pattern(spark, target).cached()
        pairs = cand.materialised(cand.label_degree(g, pattern))
        plan = matcher.Plan(g, pattern, pairs, pattern.vertices, cand.sizes(pairs, pattern))
        own = {u: {r["v"] for r in pairs.filter(f"u = {u}").collect()} for u in pattern.vertices}
        plain = dict.fromkeys(backtrack.COUNTERS, 0)

        def search(m):
            u = len(m)
            if u == len(pattern.vertices):
                plain["n_full"] += 1
                return
            left = [x for x in own[u] if all(target.adjacent(x, m[w]) for w in pattern.neighbours(u) if w < u)]
            plain["n_empty"] += not left and u > 0
            for x in left:
                plain["n_calls"] += 1
                if x in m:
                    plain["n_conflicts"] += 1
                elif not (induced and any(target.adjacent(x, m[w]) for w in range(u) if not pattern.adjacent(u, w))):
                    search([*m, x])

        search([])
        whole = backtrack.failing_set_counters(plan, induced, cut=False).first().asDict()
        assert whole == plain
        found = backtrack.failing_set_counters(plan, induced).first().asDict()
        assert found["n_full"] == plain["n_full"] and found["n_calls"] <= plain["n_calls"]
        fewer += found["n_calls"] < plain["n_calls"]
    assert fewer


def test_report_is_ordered(spark):
    g = LabeledGraph.from_pattern(spark, K3)
    rows = matcher.report(matcher.embeddings(g, K3, cand.label_degree(g, K3), [0, 1, 2], True), K3).orderBy("idx").collect()
    assert [r["idx"] for r in rows] == list(range(1, 7))
    assert [r["mapping"] for r in rows] == sorted(r["mapping"] for r in rows)


def test_walks_are_unbiased(spark):
    rng = random.Random(2)
    target = _random(rng, 12, "AB", 0.5)
    g = LabeledGraph.from_pattern(spark, target).cached()
    pattern = Pattern.of(["A", "B", "A"], [(0, 1), (1, 2)])
    pairs = cand.label_degree(g, pattern)
    found = est.summary(est.walks(g, pattern, pairs, [0, 1, 2], 0, 2000, induced=True), z=4.0).first()
    assert abs(found["mean"] - len(brute(target, pattern, True))) <= found["half_width"]


def test_wrong_names_are_errors(spark):
    g = LabeledGraph.from_pattern(spark, K3)
    with pytest.raises(ValueError):
        cand.candidates(g, K3, "other")
    with pytest.raises(ValueError):
        matcher.Config(enumeration="other").checked()
    with pytest.raises(ValueError):
        matcher.Config(order="dynamic", enumeration="DAF").checked()
