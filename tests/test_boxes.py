import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import arrow as AR
from tessera.functions import boxes as B

SCHEMA = "a struct<cx:double,cy:double,w:double,h:double,theta:double>, b struct<cx:double,cy:double,w:double,h:double,theta:double>"


def value(spark, column, a, b=(0, 0, 1, 1, 0)):
    row = [tuple(map(float, a)), tuple(map(float, b))]
    return spark.createDataFrame([tuple(row)], SCHEMA).select(column.alias("v")).first().v


def random_boxes(n, seed=0):
    r = np.random.default_rng(seed)
    return np.column_stack([r.uniform(0, 30, n), r.uniform(0, 30, n), r.uniform(2, 30, n), r.uniform(2, 30, n), r.uniform(-4, 4, n)])


A, G = F.col("a"), F.col("b")


def test_canonical_swaps_and_wraps(spark):
    r = value(spark, F.struct(*[v.alias(k) for k, v in B.canonical(A).items()]), (1, 2, 3, 8, math.pi / 2))
    assert (r.w, r.h) == (8, 3) and abs(r.theta) < 1e-12


def test_negative_side_raises(spark):
    with pytest.raises(Exception, match="negative side"):
        value(spark, B.canonical(A, checked=True)["w"], (0, 0, -1, 1, 0))


def test_gwd_is_a_metric_and_isotropic_on_squares(spark):
    x, y = random_boxes(200), random_boxes(200, 1)
    df = spark.createDataFrame([(tuple(map(float, p)), tuple(map(float, q))) for p, q in zip(x, y)], SCHEMA)
    rows = df.select(B.gwd(A, G).alias("d"), B.gwd(G, A).alias("e"), B.gwd(A, A).alias("z")).toPandas()
    assert np.allclose(rows.d, rows.e) and np.all(rows.z < 1e-5)
    assert value(spark, B.gwd(A, G), (0, 0, 5, 5, 0), (0, 0, 5, 5, 0.7)) < 1e-6


def test_gwd_against_matrices(spark):
    def gauss(p):
        r = np.array([[math.cos(p[4]), -math.sin(p[4])], [math.sin(p[4]), math.cos(p[4])]])
        return r @ np.diag([p[2] ** 2 / 4, p[3] ** 2 / 4]) @ r.T

    def root(m):
        w, v = np.linalg.eigh(m)
        return v @ np.diag(np.sqrt(np.maximum(w, 0))) @ v.T

    x, y = random_boxes(50, 2), random_boxes(50, 3)
    df = spark.createDataFrame([(tuple(map(float, p)), tuple(map(float, q))) for p, q in zip(x, y)], SCHEMA)
    got = df.select(B.gwd(A, G).alias("d")).toPandas().d
    for p, q, d in zip(x, y, got):
        s, t = gauss(p), gauss(q)
        r = root(s)
        want = np.sum((p[:2] - q[:2]) ** 2) + np.trace(s + t - 2 * root(r @ t @ r))
        assert math.isclose(d, math.sqrt(want), rel_tol=1e-7, abs_tol=1e-7)


def test_seam_is_continuous(spark):
    near = value(spark, B.gwd(A, G), (0, 0, 9, 3, math.pi / 2 - 1e-6), (0, 0, 9, 3, -math.pi / 2 + 1e-6))
    assert near < 1e-4
    assert value(spark, B.naive_residuals(A, G)["theta"], (0, 0, 9, 3, math.pi / 2 - 1e-6), (0, 0, 9, 3, -math.pi / 2 + 1e-6)) > 3


def test_overlap_forms_agree(spark):
    x, y = random_boxes(300, 4), random_boxes(300, 5)
    df = spark.createDataFrame([(tuple(map(float, p)), tuple(map(float, q))) for p, q in zip(x, y)], SCHEMA)
    r = df.select(B.rotated_iou(A, G).alias("i"), B.rotated_iou_native(A, G).alias("n"), B.rotated_iou(A, A).alias("s")).toPandas()
    assert np.allclose(r.i, r.n, atol=1e-9) and np.allclose(r.s, 1) and (r.i > 0).sum() > 100


def test_overlap_of_known_shapes(spark):
    assert math.isclose(value(spark, B.rotated_iou(A, G), (0, 0, 10, 4, 0), (5, 0, 10, 4, 0)), 20 / 60)
    assert value(spark, B.rotated_iou(A, G), (0, 0, 10, 0, 0), (0, 0, 10, 4, 0)) == 0
    assert value(spark, B.rotated_iou(A, G), (0, 0, 2, 2, 0), (50, 0, 2, 2, 0)) == 0
    assert math.isclose(value(spark, B.rotated_iou(A, G), (0, 0, 2, 2, 0), (0, 0, 2, 2, math.pi / 4)), (8 * (math.sqrt(2) - 1)) / (8 - 8 * (math.sqrt(2) - 1)), rel_tol=1e-9)


@pytest.mark.parametrize(
    ("score", "a", "b", "want"),
    [
        (B.expansion_margin, (0, 0, 10, 4, 0), (0, 0, 8, 2, 0), 0.0), (B.expansion_margin, (0, 0, 10, 4, 0), (3, 0, 10, 4, 0), 3.0),
        (B.expansion_margin, (0, 0, 10, 4, math.pi / 2), (0, 3, 10, 4, math.pi / 2), 3.0), (B.corner_max, (0, 0, 10, 4, 0), (3, 4, 10, 4, 0), 5.0),
        (B.kld, (1, 0, 4, 4, 0), (0, 0, 4, 4, 0), 0.125), (B.bhattacharyya, (1, 0, 4, 4, 0), (0, 0, 4, 4, 0), 0.03125), (B.coord_max_additive, (0, 0, 10, 4, 0), (2, 0, 10, 4, 0), 2.0),
        (B.coord_max_multiplicative, (0, 0, 10, 4, 0), (0, 2, 10, 4, 0), 0.5), (B.coord_max_additive, (0, 0, 10, 4, 0), (0, 0, 10, 4, 0.5), 2.5),
    ],
)
def test_scores_of_known_pairs(spark, score, a, b, want):
    assert math.isclose(value(spark, score(A, G), a, b), want, rel_tol=1e-9, abs_tol=1e-9)


def test_orientation_extent(spark):
    at = lambda c: value(spark, c, (0, 0, 10, 2, 0))
    assert math.isclose(at(B.free_radius(A["w"], A["h"])), 8 / (2 * math.sqrt(2)))
    half = at(B.half_extent(A["w"], A["h"], F.lit(2.38)))
    assert abs(math.degrees(half) - 31.72) < 0.01
    assert math.isclose(at(B.half_extent_stable(A["w"], A["h"], F.lit(2.38))), half, rel_tol=1e-9)
    assert math.isclose(at(B.least_bures(A["w"], A["h"], F.lit(half))), 2.38, rel_tol=1e-9)
    assert at(B.half_extent(A["w"], A["h"], F.lit(3.0))) == math.pi / 2


def test_single_precision_margin_follows_the_double_one(spark):
    x, y = random_boxes(200, 6), random_boxes(200, 7)
    df = spark.createDataFrame([(tuple(map(float, p)), tuple(map(float, q))) for p, q in zip(x, y)], SCHEMA)
    r = df.select(B.expansion_margin(A, G).alias("d"), AR.single_precision_margin(A, G).alias("f")).toPandas()
    assert np.abs(r.d - r.f).max() < 1e-3
    grown = df.select(AR.grown_readout(A, G, B.expansion_margin(A, G) + 0.01).alias("r")).select("r.covered").toPandas()
    assert grown.covered.all()


def test_smallest_rectangle_recovers_a_box():
    x = random_boxes(50, 8)
    c, s = np.cos(x[:, 4:5]), np.sin(x[:, 4:5])
    u, v = np.array([-0.5, 0.5, 0.5, -0.5]) * x[:, 2:3], np.array([-0.5, -0.5, 0.5, 0.5]) * x[:, 3:4]
    r = AR.smallest_rectangle(np.stack([x[:, :1] + c * u - s * v, x[:, 1:2] + s * u + c * v], 2))
    assert np.allclose(np.sort(x[:, 2:4], 1)[:, ::-1], r[:, 2:4]) and np.allclose(x[:, :2], r[:, :2])


def test_shape_extents_hold_the_box():
    w_lo, w_hi, h_lo, h_hi, lo, hi, full, edge, status = AR.shape_extents(10, 4, 0.3, 1.0)
    assert w_lo <= 10 <= w_hi and h_lo <= 4.2 and h_hi >= 3.8 and lo <= 0.3 <= hi and not full and status == "sampled_feasible_extrema"
    assert AR.shape_extents(10, 4, 0.3, 0.0)[-1] == "insufficient_grid_resolution"
    assert AR.arc_of(np.array([-1.5, 1.5]), 181) == (1.5, -1.5 + math.pi, False)


def test_star_area_of_a_disc():
    assert math.isclose(AR.star_area(lambda x, y: np.hypot(x, y) <= 3.0), math.pi * 9, rel_tol=1e-9)
