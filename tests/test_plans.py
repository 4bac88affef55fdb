import pytest

from weftgraph.plans import planner
from weftgraph.plans.pattern import Pattern

P = Pattern.of(["A", "B", "C", "D", "E"], [(0, 1), (1, 2), (2, 3), (0, 3), (3, 4)])
SIZES = {0: 5, 1: 2, 2: 9, 3: 1, 4: 4}


def test_orders_by_hand():
    assert planner.ground_truth_order(P, SIZES) == [3, 0, 2, 4, 1]
    order, cost = planner.graphql_order(P, SIZES, 0.5)
    assert order == [3, 1, 0, 4, 2] and cost == 1 + 2 + 2.5 + 5 + 11.25
    assert planner.daf_order(P, SIZES)[0] == 3
    weights = {(0, 1): 4, (1, 2): 3, (2, 3): 8, (0, 3): 5, (3, 4): 2}
    assert planner.quicksi_order(P, SIZES, weights) == [3, 4, 0, 1, 2]


def test_every_order_names_each_vertex_once():
    apart = Pattern.of(["A"] * 4, [(0, 1)])
    for p, sizes in ((P, SIZES), (apart, dict.fromkeys(range(4), 3))):
        for method in planner.ORDERS:
            order = planner.processing_order(p, sizes, method, weights=dict.fromkeys(p.edges, 1))
            assert sorted(order) == p.vertices
            assert sorted(planner.breadth_first_order(p, order)) == p.vertices
    with pytest.raises(ValueError):
        planner.processing_order(P, SIZES, "other")


def test_skeleton_takes_the_nearest_parent():
    steps = planner.skeleton(P, [0, 1, 2, 3, 4])
    assert (steps[3].parent, steps[3].extra, steps[3].absent) == (2, (0,), (1,))
    assert steps[4].parent == 3 and steps[4].absent == (0, 1, 2)


def test_pattern_measures():
    assert P.diameter() == 3 and P.connected() and P.average_degree() == 2.0 and P.density() == 0.5
    assert Pattern.of(["A", "A"], []).diameter() is None
    assert planner.ancestors(planner.directed(P, [0, 1, 3, 2, 4]), 4) == {0, 3}
    both, by = P.union(Pattern.of(["X", "Y"], [(0, 1)]))
    assert by == 5 and len(both.labels) == 7 and (5, 6) in both.edges
