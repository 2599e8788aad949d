import itertools
import math

import numpy as np

from tessera.functions.boxes import BOX
from tessera.operators import matching as M
from tessera.operators.graph import components

DET, GT = f"image_id string, scene_id string, class string, idx bigint, obb {BOX}, score double", f"image_id string, scene_id string, class string, idx bigint, obb {BOX}"


def det(spark, rows):
    return spark.createDataFrame([(i, "s", c, k, tuple(map(float, b)), float(s)) for i, c, k, b, s in rows], DET)


def gt(spark, rows):
    return spark.createDataFrame([(i, "s", c, k, tuple(map(float, b))) for i, c, k, b in rows], GT)


def kinds(df):
    out = {"tp": 0, "fp": 0, "fn": 0}
    for r in df.groupBy("match_type").count().collect():
        out[r.match_type] = r["count"]
    return out


BOX1 = (0, 0, 10, 4, 0)


def test_class_and_distance_decide(spark):
    g = gt(spark, [("a", "ship", 0, BOX1)])
    assert kinds(M.matched(det(spark, [("a", "ship", 0, BOX1, 0.9)]), g, 0.5)) == {"tp": 1, "fp": 0, "fn": 0}
    assert kinds(M.matched(det(spark, [("a", "plane", 0, BOX1, 0.9)]), g, 0.5)) == {"tp": 0, "fp": 1, "fn": 1}
    assert kinds(M.matched(det(spark, [("a", "ship", 0, (90, 0, 10, 4, 0), 0.9)]), g, 0.5)) == {"tp": 0, "fp": 1, "fn": 1}
    assert kinds(M.matched(det(spark, [("b", "ship", 0, BOX1, 0.9)]), g, 0.5)) == {"tp": 0, "fp": 1, "fn": 1}


def test_confidence_goes_first_and_objects_are_used_once(spark):
    d = det(spark, [("a", "s", 0, (1, 0, 10, 4, 0), 0.5), ("a", "s", 1, BOX1, 0.9)])
    m = M.greedy(M.candidates(d, gt(spark, [("a", "s", 7, BOX1)]), 0.3)).collect()
    assert [(r.det_idx, r.gt_idx) for r in m] == [(1, 7)]


def test_ties(spark):
    g = gt(spark, [("a", "s", 1, BOX1), ("a", "s", 2, BOX1)])
    d = det(spark, [("a", "s", 0, BOX1, 0.5)])
    c = M.candidates(d, g, 0.3)
    assert M.greedy(c).first().gt_idx == 1 and M.greedy(c, tie="last").first().gt_idx == 2


def test_empty_sides(spark):
    assert kinds(M.matched(det(spark, []), gt(spark, [("a", "s", 0, BOX1)]), 0.5)) == {"tp": 0, "fp": 0, "fn": 1}
    assert kinds(M.matched(det(spark, [("a", "s", 0, BOX1, 0.5)]), gt(spark, []), 0.5)) == {"tp": 0, "fp": 1, "fn": 0}


def test_assignment_is_optimal():
    r = np.random.default_rng(0)
    for n, m in ((3, 3), (2, 4), (4, 2), (1, 1), (5, 5)):
        c = r.random((n, m))
        got = sum(c[i, j] for i, j in M.assignment(c))
        best = min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n)) if n <= m else min(sum(c[p[j], j] for j in range(m)) for p in itertools.permutations(range(n), m))
        assert math.isclose(got, best)


def test_hungarian_beats_greedy(spark):
    d = det(spark, [("a", "s", 0, (0, 0, 10, 4, 0), 0.9), ("a", "t", 1, (2, 0, 10, 4, 0), 0.8)])
    g = gt(spark, [("a", "s", 0, (1, 0, 10, 4, 0)), ("a", "s", 1, (3, 0, 10, 4, 0))])
    assert {(r.det_idx, r.gt_idx, r.same_class) for r in M.hungarian(d, g, 0.5, 0.3).collect()} == {(0, 0, True), (1, 1, False)}


def test_maximum_matching(spark):
    e = spark.createDataFrame([("p", 1, 1), ("p", 1, 2), ("p", 2, 1), ("p", 3, 1), ("q", 1, 1)], "pair string, a int, b int")
    assert {r.pair: r["size"] for r in M.maximum_matching(e, "pair", "a", "b").collect()} == {"p": 2, "q": 1}


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)]
    got = {r.id: r.label for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(51)) and got[101] == got[100] == 100 and 7 in got
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_average_precision(spark):
    d = det(spark, [("a", "s", 0, BOX1, 0.9), ("a", "s", 1, (50, 0, 10, 4, 0), 0.8), ("b", "s", 0, BOX1, 0.7)])
    g = gt(spark, [("a", "s", 0, BOX1), ("b", "s", 0, BOX1)])
    assert math.isclose(M.average_precision(d, g, [0.5]).first().ap, (1 + 2 / 3) / 2)
