"""Geometry endpoints by plain numpy, exact moments, export checks and the convention gate on small tables."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.boxes import BOX
from tessera.operators import readouts, risk
from tessera.sources import exports

HALF = math.pi / 2


def boxes(n, seed):
    r = np.random.default_rng(seed)
    w = r.uniform(3, 20, n)
    return np.column_stack([r.uniform(0, 5, n), r.uniform(0, 5, n), w, w * r.uniform(0.1, 0.99, n), r.uniform(-HALF, HALF - 1e-6, n)])


def half_extent(w, h, q):
    if q >= (w - h) / (2 * math.sqrt(2)):
        return HALF
    a, b = w * w / 4, h * h / 4
    t = (a + b) / 2 - q * q
    return math.acos(max(-1, min(1, math.sqrt(max(0, t * t - a * b)) / ((a - b) / 2)))) / 2


def plain(name, p, g, q):
    """radius, length, half, centre, angle, area of one pair; None is undefined."""
    (px, py, pw, ph, pt), (gx, gy, gw, gh, gt) = p, g
    dx, dy = gx - px, gy - py
    wrap = min(abs(gt - pt), math.pi - abs(gt - pt))
    u, v = math.cos(pt) * dx + math.sin(pt) * dy, -math.sin(pt) * dx + math.cos(pt) * dy
    if name in ("gwd", "gwd_normalized"):
        rad = q[0] * math.sqrt(pw * ph) if name == "gwd_normalized" else q[0]
        half = half_extent(pw, ph, rad)
        return rad, 2 * half, half, math.hypot(dx, dy) <= rad, wrap <= half, None
    if name in ("naive", "wrapped", "doubled", "hull"):
        rad, centre = math.hypot(q[0], q[1]), abs(dx) <= q[0] and abs(dy) <= q[1]
        if name == "naive":
            lo, hi = max(-HALF, pt - q[4]), min(HALF, pt + q[4])
            return rad, hi - lo, None, centre, lo <= gt <= hi, None
        if name == "wrapped":
            half = min(q[4], HALF)
            return rad, 2 * half, half, centre, wrap <= half, None
        if name == "doubled":
            t = np.linspace(0, 2 * math.pi, 400_001)[:-1]
            ok = (abs(np.cos(t) - math.cos(2 * pt)) <= q[4]) & (abs(np.sin(t) - math.sin(2 * pt)) <= q[5])
            inside = abs(math.cos(2 * gt) - math.cos(2 * pt)) <= q[4] and abs(math.sin(2 * gt) - math.sin(2 * pt)) <= q[5]
            return rad, float(ok.mean() * math.pi), None, centre, inside, None
        return rad, None, None, centre, None, None
    if name.startswith("coord_max") or name == "max_rank":
        bx, by, bt = (q[1], q[2], q[5]) if name == "max_rank" else (q[0], q[0], 2 * q[0] / pw) if name == "coord_max_additive" else (q[0] * max(pw, 1), q[0] * max(ph, 1), 2 * q[0])
        half = min(bt, HALF)
        return math.hypot(bx, by), 2 * half, half, abs(u) <= bx and abs(v) <= by, wrap <= half, None
    if name == "corner_max":
        return q[0], None, None, math.hypot(dx, dy) <= q[0], None, None
    if name == "expansion_analytic":
        rad = math.hypot(pw / 2 + q[0], ph / 2 + q[0])
        return rad, math.pi, HALF, math.hypot(dx, dy) <= rad, True, (pw + 2 * q[0]) * (ph + 2 * q[0])
    return None, None, None, None, None, None


@pytest.mark.parametrize("name, q", [("gwd", [1.7]), ("gwd_normalized", [0.2]), ("naive", [2.0, 1.5, 1.0, 1.0, 0.4]), ("wrapped", [2.0, 1.5, 1.0, 1.0, 0.4]), ("doubled", [2.0, 1.5, 1.0, 1.0, 0.5, 0.6]), ("hull", [2.0, 1.0, 1.0, 1.0]),
    ("coord_max_additive", [2.5]), ("coord_max_multiplicative", [0.3]), ("max_rank", [0.9, 2.0, 1.0, math.inf, 1.0, 0.3]), ("corner_max", [2.0]), ("expansion_analytic", [1.0]), ("iou", [0.4]), ("hellinger", [1.2])])
def test_geometry_endpoints(spark, name, q):
    p, g = boxes(40, 1), boxes(40, 2)
    df = spark.createDataFrame([(i, tuple(map(float, a)), tuple(map(float, b))) for i, (a, b) in enumerate(zip(p, g))], f"i int, pred {BOX}, gt {BOX}")
    out = {r.i: r for r in readouts.geometry_endpoints(df, name, [F.lit(v) for v in q]).collect()}
    for i, (a, b) in enumerate(zip(p, g)):
        rad, length, half, centre, angle, area = plain(name, a, b, q)
        r, size = out[i], math.sqrt(a[2] * a[3])
        close = lambda x, y, tol=1e-6: x is None and y is None or x is not None and y is not None and abs(x - y) < tol
        assert close(r.normalized_radius, None if rad is None else rad / size) and close(r.angle_length, length, 1e-4) and close(r.half_width, half) and close(r.area, area)
        assert (r.center_defined, r.angle_defined) == (float(rad is not None), float(length is not None))
        assert r.full == (None if length is None else float(length >= math.pi)) and r.informative == (None if length is None else 1 - r.full)
        assert r.joint == (None if rad is None or length is None else float(centre and angle))
        assert r.bounded == float((name not in ("iou", "hellinger") or q[0] < 1) and max(q) < math.inf) and r.finite == 1.0
        ratio = a[2] / a[3]
        assert (r.near_square, r.middle, r.elongated) == (float(ratio < 1.2), float(1.2 <= ratio < 3), float(ratio >= 3)) and r.seam + r.off_seam == 1 and r.seam == float(HALF - abs(a[4]) <= math.pi / 36)


def test_unbounded_thresholds_and_unknown_scores(spark):
    df = spark.createDataFrame([((0.0, 0.0, 4.0, 2.0, 0.0), (1.0, 0.0, 4.0, 2.0, 0.1))], f"pred {BOX}, gt {BOX}")
    r = readouts.geometry_endpoints(df, "gwd", [F.lit(math.inf)]).first()
    assert (r.finite, r.bounded, r.full, r.joint) == (0.0, 0.0, 1.0, 1.0) and r.normalized_radius == math.inf
    with pytest.raises(ValueError, match="no geometry"):
        readouts.geometry_endpoints(df, "other", [F.lit(1.0)])


def test_margin_of_single_precision(spark):
    """A finite margin says nothing of the region but what the grown polygon shows; an infinite one holds everything."""
    df = spark.createDataFrame([((0.0, 0.0, 4.0, 2.0, 0.0), (0.5, 0.0, 4.0, 2.0, 0.0), c, q) for c in (True, False) for q in (0.4, 0.6, math.inf)], f"pred {BOX}, gt {BOX}, covered boolean, q double")
    out = {(r.covered, r.q): r for r in readouts.geometry_endpoints(df, "expansion_margin", [F.col("q")]).collect()}
    for covered in (True, False):
        for q, native in ((0.4, 0.0), (0.6, 1.0)):
            r = out[covered, q]
            assert (r.finite, r.bounded, r.center_defined, r.angle_defined, r.joint, r.area) == (1.0, None, 0.0, 0.0, None, None)
            assert (r.native, r.native_only, r.strict_only) == (native, float(native and not covered), float(covered and not native))
            assert abs(r.native_area - (4 + 2 * q) * (2 + 2 * q)) < 1e-5 and abs(r.native_radius - math.hypot(2 + q, 1 + q) / math.sqrt(8)) < 1e-6
        r = out[covered, math.inf]
        assert (r.finite, r.bounded, r.full, r.informative, r.joint, r.native, r.half_width) == (0.0, 0.0, 1.0, 0.0, 1.0, 1.0, HALF)
        assert r.normalized_radius == r.area == r.native_area == math.inf


def test_rank_thresholds_beside_open_coordinates(spark):
    df = spark.createDataFrame([((0.0, 0.0, 4.0, 2.0, 0.0), (1.0, 0.0, 4.0, 2.0, 0.1))], f"pred {BOX}, gt {BOX}")
    r = readouts.geometry_endpoints(df, "max_rank", [F.lit(v) for v in (0.99, 2.0, 2.0, math.inf, math.inf, 0.2)]).first()
    assert (r.finite, r.bounded, r.joint) == (1.0, 0.0, 1.0) and r.native is None
    with pytest.raises(ValueError, match="takes 6"):
        readouts.geometry_endpoints(df, "max_rank", [F.lit(1.0)])


@pytest.mark.parametrize("name", ["kld", "bhattacharyya"])
def test_scores_without_geometry(spark, name):
    df = spark.createDataFrame([((0.0, 0.0, 4.0, 2.0, 0.0), (1.0, 0.0, 4.0, 2.0, 0.1))], f"pred {BOX}, gt {BOX}")
    r = readouts.geometry_endpoints(df, name, [F.lit(2.0)]).first()
    assert (r.finite, r.bounded, r.center_defined, r.angle_defined, r.joint) == (1.0, 1.0, 0.0, 0.0, None)


def test_exact_moments(spark):
    rows = [("a", 1, 3, 2), ("a", 2, 6, 1), ("a", 0, 7, 3), ("a", 5, 0, 9), ("a", 1, 1, 0), ("b", 7, 7, 1)]
    got = {r["class"]: r for r in risk.exact_moments(spark.createDataFrame(rows, "class string, miss long, n long, mult int"), ["class"]).collect()}
    assert (got["a"].n, Fraction(got["a"].exact_mean), Fraction(got["a"].exact_square)) == (6, Fraction(1, 6), Fraction(1, 18))
    assert (got["b"].exact_mean, got["b"].exact_square) == ("1", "1")
    with pytest.raises(Exception, match="bounds"):
        risk.exact_moments(spark.createDataFrame([("a", 4, 3, 1)], "class string, miss long, n long, mult int"), ["class"]).collect()


def test_sound_exports_have_no_problem(spark):
    tiles = spark.createDataFrame([(0, "a", 0), (1, "b", 4)], "tile int, name string, tile_index int")
    gt = spark.createDataFrame([(0, 1, [0.5, 0.5, 0.1, 0.2, 3.0])], "tile int, label int, box array<double>")
    pred = spark.createDataFrame([(1, [0.5, 0.5, 0.1, 0.2, -1.0], [0.1, 0.9])], "tile int, box array<double>, prob array<double>")
    assert exports.export_problems(tiles, gt, pred, 2).count() == 0
    odd = pred.unionByName(spark.createDataFrame([(9, [0.5, math.nan, 0.1], [0.01]), (0, None, [2.0, math.inf]), (0, [0.5, 0.5, 0.0, 1.2, 0.0], [0.04, 0.0])], pred.schema))
    told = {r.problem: r.n for r in exports.export_problems(tiles.unionByName(tiles.limit(1)), gt.withColumn("label", F.lit(2)), odd, 2).collect()}
    assert told["pred: unknown tile"] == 1 and told["pred: box shape"] == 2 and told["pred: box not finite"] == 2 and told["gt: label outside"] == 1
    assert told["pred: score below floor"] == 2 and told["pred: probability outside"] == 1 and told["tiles: name repeated"] == 1 and told["pred: probabilities"] == 1


def test_convention_gate(spark):
    right = [((10.0, 5.0, 8.0, 2.0, 0.5), 10 - 3.99, 5 - 2.80, 10 + 3.99, 5 + 2.80)] * 3
    df = spark.createDataFrame(right, f"obb {BOX}, x0 double, y0 double, x1 double, y1 double")
    assert exports.convention_gate(df).first().passes
    turned = df.withColumn("obb", F.col("obb").withField("theta", F.col("obb.theta") + HALF))
    r = exports.convention_gate(turned).first()
    assert not r.passes and r.median_iou < 0.6 and r.n == 3
    none = exports.convention_gate(df.withColumn("x0", F.lit(None).cast("double"))).first()
    assert (none.median_iou, none.n, none.passes) == (0.0, 0, False)


def test_parity_picks(spark):
    rows = [(f"i{k:03}", 1, k % 20) for k in range(100)]
    got = sorted(r.image_id for r in exports.parity_picks(spark.createDataFrame(rows, "image_id string, n_det int, n_gt int")).collect())
    both = [n for n, _, g in rows if g]
    near = sorted(both, key=lambda n: (abs(int(n[1:]) % 20 - 12), n))[:3]
    assert got == sorted(set(both[:: max(1, len(both) // 12)][:12] + near))
