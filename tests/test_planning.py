"""Exact sample sizes, accelerated intervals, and both certificates of the same pairs, on small tables."""

import math
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.boxes import BOX
from tessera.operators import accelerated, comparison, planning
from tessera.operators.studies import bias_corrected_interval


def test_smallest_samples_are_smallest():
    rng = np.random.default_rng(1)
    for _ in range(60):
        mean, var = Fraction(int(rng.integers(0, 60)), 400), Fraction(int(rng.integers(0, 90)), 1000)
        eta, target = Fraction(1, int(rng.integers(10, 2000))), Fraction(int(rng.integers(61, 120)), 400)
        b = planning.Bound(mean, var, eta)
        n = b.smallest(target)
        goal = Decimal(target.numerator) / Decimal(target.denominator)
        assert b.at(n) <= goal < b.at(n - 1)
        now, found, status = planning.plan(50, mean, var, eta, target)
        assert (found, status) == (n, planning.FOUND) and Decimal(now) >= b.at(50) > Decimal(math.nextafter(now, 0))
    assert planning.plan(9, Fraction(1, 2), Fraction(0), Fraction(1, 20), Fraction(1, 2))[1:] == (None, planning.ABOVE)
    assert planning.plan(1, Fraction(0), None, Fraction(1, 20), Fraction(1, 2)) == (1.0, None, planning.UNSUPPORTED)
    assert planning.plan(9, Fraction(1999, 10000), Fraction(1, 10), Fraction(1, 20), Fraction(1, 5), 1000)[1:] == (None, planning.BEYOND)
    assert planning.Bound(Fraction(0), Fraction(0), Fraction(1, 20)).smallest(Fraction(999, 1000)) >= 2


def test_planned_rows(spark):
    rows = [("a", 0, 3)] * 40 + [("a", 1, 4)] * 5 + [("a", 0, 0)] * 9 + [("b", 1, 1)] * 3 + [("c", 0, 2)]
    out = {(r["class"], r.target): r for r in planning.planned(spark.createDataFrame(rows, "class string, miss int, n int"), ["class"], "0.05", ["0.3", "0.1"]).collect()}
    a, b, c = out["a", 0.3], out["b", 0.3], out["c", 0.1]
    assert len(out) == 6 and a.n == 45 and math.isclose(a.mean, 1.25 / 45) and a.status == "found" and a.more == max(0, a.smallest - 45) and a.half_smallest <= a.smallest
    assert b.status == "mean_at_or_above_target" and b.smallest is None and (c.status, c.upper, c.variance) == ("unsupported_moments", 1.0, None)


def test_accelerated_interval_is_that_of_arrays(spark):
    rng = np.random.default_rng(3)
    units = [(k, i, float(x), 1.0) for k in "ab" for i, x in enumerate(rng.gamma(2 if k == "a" else 9, size=30))] + [("c", 0, 1.0, 2.0)]
    weights = [(d, i, int(c)) for d in range(400) for i, c in enumerate(np.bincount(rng.integers(0, 30, 30), minlength=30))]
    u, w = spark.createDataFrame(units, "k string, unit int, top double, bottom double"), spark.createDataFrame(weights, "draw int, unit int, mult int")
    got = {r.k: r for r in accelerated.accelerated_interval(u, w, "unit", "top", "bottom", ["k"]).collect()}
    counts = np.zeros((400, 30))
    for d, i, c in weights:
        counts[d, i] = c
    for k in "ab":
        x = np.array([t for key, _, t, _ in units if key == k])
        means = counts @ x / 30
        from statistics import NormalDist

        z = NormalDist()
        shift = z.inv_cdf(np.mean(means < x.mean()))
        left = (x.sum() - x) / 29
        d = left.mean() - left
        a = (d**3).sum() / (6 * (d**2).sum() ** 1.5)
        levels = [z.cdf(shift + (shift + e) / (1 - a * (shift + e))) for e in (z.inv_cdf(0.025), z.inv_cdf(0.975))]
        assert np.allclose([got[k].low, got[k].high], np.quantile(means, levels)) and math.isclose(got[k].acceleration, a) and got[k].draws == 400
        low, high = bias_corrected_interval(x)
        assert abs(got[k].low - low) < 0.1 * (high - low) and abs(got[k].high - high) < 0.15 * (high - low)
    assert got["c"].acceleration is None and got["c"].low is None


def test_common_events(spark):
    box, inf = (0.0, 0.0, 4.0, 2.0, 0.0), math.inf
    rows = spark.createDataFrame([(k, box, (0.5, 0.0, 4.0, 2.0, 0.0), 0.5, 0.5) for k in ("a", "b", "c", None, "d")], f"class string, pred {BOX}, gt {BOX}, margin double, distance double")
    t = spark.createDataFrame([("a", 0.6, 0.4), ("b", inf, inf), ("c", None, 0.6), (None, 0.2, None)], "class string, margin_q double, ball_q double")
    got = {r["class"]: r for r in comparison.common_events(rows, t).collect()}
    say = lambda k: (got[k].margin_holds, got[k].grown_holds, got[k].ball_holds, got[k].margin_status, got[k].ball_status)
    assert say("a") == (True, True, False, "finite", "finite") and say("b") == (True, True, True, "no_finite_certificate", "no_finite_certificate")
    assert say("c") == (None, None, True, "missing_class", "finite") and say(None) == (False, False, None, "finite", "missing_class") and say("d") == (None, None, None, "missing_class", "missing_class")
    counts = comparison.event_counts(comparison.common_events(rows, t), ["class"]).where("class = 'a'").first()
    assert (counts.pairs, counts.margin_holds, counts.ball_holds, counts.disagree) == (1, 1, 0, 1)
    for bad in (float("nan"), -1.0, -inf):
        with pytest.raises(Exception, match="negative or not a number"):
            comparison.common_events(rows, spark.createDataFrame([("a", bad, 1.0)], "class string, margin_q double, ball_q double")).collect()
    assert comparison.common_events(rows.where(F.lit(False)), t).count() == 0
