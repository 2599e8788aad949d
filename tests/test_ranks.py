"""Range-based ranks, rank bounds, matched levels, splits and precision curves against plain definitions."""

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import arrow as AR
from tessera.functions.boxes import BOX
from tessera.operators import audit, matching, ranks, risk, simulate, splits, studies, thresholds


def table(spark, seed=0, n=600):
    r = random.Random(seed)
    rows = [(r.choice("ab"), round(r.gauss(0, 1), 1), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, score double, i int").repartition(7)


def test_numbers_and_running_values(spark, monkeypatch):
    monkeypatch.setattr(ranks, "BUCKETS", 5)
    rows, df = table(spark)
    got = {r.i: r.at for r in ranks.numbered(df, ["k"], ["score", "i"], "at").collect()}
    for k in "ab":
        own = sorted((s, i) for c, s, i in rows if c == k)
        assert [got[i] for _, i in own] == list(range(1, len(own) + 1))
    whole = {r.i: r.at for r in ranks.numbered(df, [], [F.col("score").desc(), "i"], "at").collect()}
    assert [whole[i] for _, i in sorted((-s, i) for _, s, i in rows)] == list(range(1, len(rows) + 1))
    assert ranks.numbered(df.where("false"), ["k"], ["score"], "at").count() == 0
    run = ranks.running(df.withColumn("one", F.lit(1)), ["k"], seen="one")
    for r in run.collect():
        assert r.seen == sum(s <= r.score and c == r.k for c, s, _ in rows)
    top = ranks.highest_so_far(ranks.ranged(df, ["k"], "i"), ["k"], "i", "score", "top")
    for r in top.collect():
        assert r.top == max(s for c, s, i in rows if c == r.k and i <= r.i)


def test_tertiles_and_differences(spark):
    rows, df = table(spark, 1, 100)
    got = {r.i: r.tertile for r in audit.rank_tertiles(df, "score", "i", by=["k"]).collect()}
    for k in "ab":
        own = sorted((s, i) for c, s, i in rows if c == k)
        assert [got[i] for _, i in own] == [3 * j // len(own) for j in range(len(own))]
    other, df2 = table(spark, 2, 90)
    for r in audit.control_difference(df, df2, "k", "score").collect():
        a, b = (sorted(s for c, s, _ in x if c == r.k) for x in (rows, other))
        assert (r.n_a, r.n_b) == (len(a), len(b)) and math.isclose(r.largest, max(abs(x - y) for x, y in zip(a, b)), abs_tol=1e-12)


def test_max_rank_with_weights_and_its_bounds(spark):
    r = np.random.default_rng(3)
    design, rows = np.round(r.exponential(size=(40, 3)), 1), np.round(r.exponential(size=(25, 3)), 1)
    weight = r.integers(0, 3, 40)
    d = spark.createDataFrame([("c", int(m), *map(float, x)) for m, x in zip(weight, design)], "class string, mult int, x double, y double, z double")
    e = spark.createDataFrame([("c", i, *map(float, x)) for i, x in enumerate(rows)], "class string, id int, x double, y double, z double")
    got = {x.id: x.score for x in thresholds.max_rank(d, e, ["x", "y", "z"], ["id"], ["class"], "mult").collect()}
    total = weight.sum()
    for i, x in enumerate(rows):
        assert math.isclose(got[i], max(weight[design[:, j] < x[j]].sum() for j in range(3)) / total)
    for q in (0.0, 0.3, 0.77, 1.0):
        b = {x.coord: x.q for x in thresholds.max_rank_bounds(d, spark.createDataFrame([("c", q)], "class string, q double"), ["x", "y", "z"], ["class"], "mult").collect()}
        for j, c in enumerate("xyz"):
            allowed = [v for v in np.unique(design[weight > 0, j]) if weight[design[:, j] < v].sum() <= q * total + 1e-9]
            assert b[c] == (math.inf if q >= 1 else max(allowed)), (q, c)


def test_chosen_level(spark):
    rows = [("a", 0.1, 0.95), ("b", 0.1, 0.89), ("a", 0.2, 0.8), ("b", 0.2, 0.9), ("a", 0.05, 0.96), ("b", 0.05, 0.96)]
    df = spark.createDataFrame(rows, "class string, alpha double, coverage double")
    r = thresholds.choose_alpha(df).first()
    assert r.alpha == 0.1 and math.isclose(r.macro, 0.92)
    for odd in (None, math.nan, math.inf):
        assert thresholds.choose_alpha(df.unionByName(spark.createDataFrame([("a", 0.3, odd), ("b", 0.3, 0.9)], df.schema))).first().alpha is None
    assert thresholds.choose_alpha(df.unionByName(spark.createDataFrame([("a", 0.3, 0.9)], df.schema))).first().alpha is None


@pytest.mark.parametrize("n, target", [(30, 0.9), (30, 0.2), (7, 0.99), (60, 1.0), (60, 0.0)])
def test_matched_level_against_bisection(spark, n, target):
    r, coords = np.random.default_rng(n), ["x", "y"]
    cal, ev = np.round(r.exponential(size=(n, 2)), 2), np.round(r.exponential(size=(45, 2)), 2)
    rows = [("g", "cal", *map(float, x)) for x in cal] + [("g", "eval", *map(float, x)) for x in ev]
    got = simulate.matched_level(spark.createDataFrame(rows, "k string, role string, x double, y double"), target, coords, ["k"]).first()

    def coverage(alpha):
        k = (n + 1) - math.floor((n + 1) * alpha / 2)
        return 1.0 if k > n else float((ev <= np.sort(cal, axis=0)[k - 1]).all(axis=1).mean())

    lo, hi = 1e-6, 1 - 1e-6
    if coverage(lo) <= target:
        best = lo
    elif coverage(hi) >= target:
        best = hi
    else:
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if coverage(mid) >= target else (lo, mid)
        best = lo
    assert abs(got.alpha - best) < 1e-9 and math.isclose(got.coverage, coverage(best)) and got.n == n


@pytest.mark.parametrize("law", [splits.STREAMS, splits.HASHES])
def test_splits_of_either_law(spark, monkeypatch, law):
    names = [f"s{i:03}" for i in range(50)]
    scenes = spark.createDataFrame([(x,) for x in names], "scene_id string")
    out = splits.repeated(spark, scenes, 3, law).collect()
    for repeat in range(3):
        own = {r.scene_id: r.role for r in out if r["repeat"] == repeat}
        assert sorted(own) == names and Counter(own.values()) == {"calibration": 20, "matching": 10, "eval": 20}
        assert law == splits.HASHES or own == splits.three_way(names, repeat)
    assert len({tuple(sorted((r.scene_id, r.role) for r in out if r["repeat"] == k)) for k in range(3)}) == 3
    roles = spark.createDataFrame([(x, "cal" if i < 30 else "eval") for i, x in enumerate(names)], "scene_id string, role string")
    draws = splits.resampled(spark, roles, 40, 7, law).toPandas().merge(roles.toPandas())
    assert (draws.groupby(["draw", "role"])["mult"].sum().unstack() == [30, 20]).all().all()
    kept = draws.groupby(["draw", "role"]).size().unstack() / [30, 20]
    assert 0.55 < kept.mean().mean() < 0.72  # 1 - 1/e of the scenes on average
    # the size of a table never picks the law: streams over too many ids are an error
    monkeypatch.setattr(splits, "MOST_SCENES", 49)
    for draw in (lambda: splits.repeated(spark, scenes, 3, law), lambda: splits.resampled(spark, roles, 2, 7, law)):
        if law == splits.HASHES:
            draw()
        else:
            with pytest.raises(splits.SplitError, match="too many"):
                draw()
    hashed = splits.hash_roles(scenes, "p").collect()
    assert Counter(r.role for r in hashed) == {"calibration": 25, "eval": 25}


def test_representatives_take_the_tolerant_rank(spark):
    rows = [("c", f"s{i}", 1 + (i == 3), float(i)) for i in range(80)]
    r = studies.representatives(spark.createDataFrame(rows, "class string, scene string, mult int, score double"), ["class"], 5).first()
    drawn = sorted([float(i) for i in range(80)] + [3.0])  # one object a scene: the draws are known
    assert r.n == 81 and r["rank"] == risk.tolerance_rank(81, 0.9, 0.05) and r.q == drawn[r["rank"] - 1]


def test_cell_codes_follow_the_names(spark):
    rows = [(f"i{k}", f"s{k % 7:02}", "ba"[k % 2], None, None, 0.5, 0.5, ("tp", "fp", "fn")[k % 3]) for k in range(42)]
    m = spark.createDataFrame(rows, f"image_id string, scene_id string, class string, pred_obb {BOX}, gt_obb {BOX}, pred_score double, iou double, match_type string")
    c = studies.cell_tables(m)
    assert [(r.scene_code, r.scene_id, r.n_tiles) for r in c["scenes"].orderBy("scene_code").collect()] == [(k, f"s{k:02}", 6) for k in range(7)]
    assert {(r.class_code, r["class"]) for r in c["classes"].collect()} == {(0, "a"), (1, "b")}


def brute_ap(dets, objects, tau):
    """dets: (image, idx, score, {object: iou}); all-point interpolated precision."""
    used, flags = set(), []
    for image, idx, score, overlaps in sorted(dets, key=lambda d: (d[0], -d[2], d[1])):
        free = [(-v, g) for g, v in overlaps.items() if v >= tau and (image, g) not in used]
        if free:
            used.add((image, min(free)[1]))
        flags.append((score, bool(free)))
    points = []
    for s in sorted({f[0] for f in flags}, reverse=True):
        seen = [hit for score, hit in flags if score >= s]
        points.append((sum(seen) / len(seen), sum(hit for score, hit in flags if score == s)))
    return sum(new * max(p for p, _ in points[i:]) for i, (_, new) in enumerate(points)) / objects


def test_average_precision_against_plain_folding(spark):
    r = random.Random(8)
    boxes = lambda n: [(float(r.randint(0, 12)), 0.0, 10.0, 4.0, 0.0) for _ in range(n)]
    d, g = [], []
    for image in ("p", "q", "r"):
        d += [(image, "s", "c", i, b, r.randint(1, 12) / 13) for i, b in enumerate(boxes(9))]
        g += [(image, "s", "c", i, b) for i, b in enumerate(boxes(6))]
    iou = lambda a, b: max(0.0, 10 - abs(a[0] - b[0])) * 4 / (80 - max(0.0, 10 - abs(a[0] - b[0])) * 4)
    dets = [(x[0], x[3], x[5], {y[3]: iou(x[4], y[4]) for y in g if y[0] == x[0]}) for x in d]
    det = spark.createDataFrame(d, f"image_id string, scene_id string, class string, idx bigint, obb {BOX}, score double")
    gt = spark.createDataFrame(g, f"image_id string, scene_id string, class string, idx bigint, obb {BOX}")
    taus = [0.3, 0.55, 0.8]
    got = {x.tau: x.ap for x in matching.average_precision(det, gt, taus).collect()}
    for tau in taus:
        assert math.isclose(got[tau], brute_ap(dets, len(g), tau), rel_tol=1e-9)
    levels = matching.greedy_levels(matching.candidates(det, gt, 0.3), taus)
    for tau in taus:
        one = {(x.image_id, x.det_idx, x.gt_idx) for x in matching.greedy(matching.candidates(det, gt, tau)).collect()}
        assert one == {(x.image_id, x.det_idx, x.gt_idx) for x in levels.where(F.col("tau") == tau).collect()}


def test_adaptive_thresholds_with_and_without_keys(spark):
    rows, df = table(spark, 4, 300)
    df = df.withColumn("scene", F.concat("k", (F.col("i") % 30).cast("string")))
    for by in ([], ["k"]):
        deployed = df.groupBy(*by, "scene").agg((F.count("*") * 5 - 20).alias("d")).where("d > 0")
        for r in thresholds.crc_adaptive(df, 0.1, deployed, by).collect():
            own = sorted(s for c, s, _ in rows if not by or c == r.k)
            budget = 0.1 * len(own) - 0.9 * r.d
            k = len(own) - min(len(own), math.floor(budget + 1e-9))
            assert r.q == (math.inf if budget < -1e-9 else -math.inf if k <= 0 else own[k - 1])


def test_hoeffding_bentkus_by_exact_sums(spark):
    for n, mean, limit in ((20, 0.1, 0.3), (50, 0.02, 0.1), (9, 0.5, 0.4), (30, 0.0, 0.2)):
        got = spark.range(1).select(risk.hb_p(F.lit(n), F.lit(mean), limit).alias("p")).first().p
        kl = (mean * math.log(mean / limit) if mean else 0.0) + ((1 - mean) * math.log((1 - mean) / (1 - limit)))
        hoeffding = math.exp(-n * kl) if mean < limit else 1.0
        bentkus = math.e * sum(math.comb(n, i) * limit**i * (1 - limit) ** (n - i) for i in range(math.ceil(n * mean) + 1))
        assert math.isclose(got, min(1.0, hoeffding, bentkus), rel_tol=1e-9), (n, mean, limit, got)


def test_simulated_thresholds_by_definition():
    rng = np.random.default_rng(5)
    for c in (simulate.conditions()[0], simulate.conditions()[20]):
        scene, score = simulate.scenes(c, 60, rng)
        q = simulate.thresholds(scene, score, 0.1, c["bound"])
        m = np.bincount(scene)
        n = len(score)
        assert q["pooled"] == np.sort(score)[(n + 1) - math.floor((n + 1) * 0.1) - 1]
        tops = np.sort(pd.Series(score).groupby(scene).max().to_numpy())
        assert q["scene_max"] == tops[61 - math.floor(6.1) - 1]
        mass = lambda x: sum(1 / m[s] for s, v in zip(scene, score) if v <= x)
        ordered = np.sort(score)
        want = next((v for v in ordered if mass(v) >= 0.9 * 61 - 1e-9), math.inf)
        assert q["hcp"] == want
        fits = [v for v in [0.0, *ordered] if (score > v).sum() <= 0.1 * n - 0.9 * c["bound"] + 1e-9]
        assert q["crc_object"] == (min(fits) if 0.1 * n - 0.9 * c["bound"] >= -1e-9 else math.inf)
    sizes = np.bincount(simulate.scenes(simulate.conditions()[30], 20_000, rng)[0])
    assert abs((sizes == 8).mean() - 0.3) < 0.02 and set(sizes.tolist()) == {1, 8, 64}


def test_shape_extents_against_the_whole_grid():
    r = np.random.default_rng(6)
    for _ in range(25):
        w, h = sorted(r.uniform(1, 20, 2))[::-1]
        theta, q = float(r.uniform(-1.5, 1.5)), float(r.uniform(0.2, 6))
        room = 4 * q + 1e-3
        gw = np.linspace(max(1e-6, w - room), w + room, 81)[:, None, None]
        gh = gw * np.linspace(1e-3, 1.0, 41)[None, :, None]
        gt = np.linspace(-math.pi / 2, math.pi / 2, 181, endpoint=False)[None, None, :]
        cov = lambda u, v, t: (u * u / 4 * np.cos(t) ** 2 + v * v / 4 * np.sin(t) ** 2, u * u / 4 * np.sin(t) ** 2 + v * v / 4 * np.cos(t) ** 2, (u * u - v * v) / 4 * np.sin(t) * np.cos(t))
        a, b = cov(gw, gh, gt), cov(w, h, theta)
        cross = a[0] * b[0] + 2 * a[2] * b[2] + a[1] * b[1] + 2 * (gw * gh * w * h) / 16
        ok = a[0] + a[1] + b[0] + b[1] - 2 * np.sqrt(np.maximum(0, cross)) <= q * q
        got = AR.shape_extents(w, h, theta, q)
        if not ok.any():
            assert got[-1] == "insufficient_grid_resolution"
            continue
        at = np.nonzero(ok)
        assert np.allclose(got[:4], [gw[at[0], 0, 0].min(), gw[at[0], 0, 0].max(), gh[at[0], at[1], 0].min(), gh[at[0], at[1], 0].max()])
        assert got[6] == (len(set(at[2])) == 181) and np.allclose(got[4:6], AR.arc_of(gt[0, 0, at[2]], 181)[:2])


def test_arcs_against_all_rotations():
    r = np.random.default_rng(7)
    for n in (1, 2, 3, 9):
        t = np.sort(r.uniform(-math.pi / 2, math.pi / 2, n))
        lo, hi, full = AR.arc_of(np.append(t, t[0]), 181)
        widths = [max((v - t[k]) % math.pi for v in t) for k in range(n)]
        assert not full and math.isclose(hi - lo, min(widths), abs_tol=1e-12) and lo in t
