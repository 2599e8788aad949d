"""Steps whose cost must not outgrow their input, against plain definitions."""

import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import risk


def test_tolerance_rank_of_many_trials(monkeypatch):
    risk.tolerance_rank.cache_clear()
    began = time.time()
    assert risk.tolerance_rank(20_000_000, 0.9, 0.05) == 18_002_208 and time.time() - began < 20
    cases = [(n, c, d) for n in (1, 2, 5, 28, 29, 30, 77, 500, 501, 700) for c in (0.9, 0.5, 0.99) for d in (0.05, 0.5)]
    found = {}
    for least in (0, 10**9):  # in fixed point wherever it decides, and by exact integers
        monkeypatch.setattr(risk, "EXACT_TRIALS", least)
        risk.tolerance_rank.cache_clear()
        found[least] = [risk.tolerance_rank(*c) for c in cases]
    risk.tolerance_rank.cache_clear()
    assert found[0] == found[10**9] and None in found[0]


def test_samples_of_any_number_of_scenes(spark, monkeypatch):
    from tessera.operators import splits
    from tessera.plans import catalog

    monkeypatch.setattr(splits, "MOST_SCENES", 10)
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey").distinct().count()
    cal, match = splits.sizes(n)
    got = {(r["repeat"], r.role): r.scenes for r in catalog.repeated_splits(spark, sf).collect()}
    assert got == {(k, role): c for k in range(5) for role, c in zip(splits.ROLES, (cal, match, n - cal - match))}
    drawn = catalog.resampled_scenes(spark, sf).collect()
    assert len(drawn) == 10 and all(r.copies == n and 0.55 * n < r.scenes < 0.72 * n for r in drawn)


def _links(names, linked):
    """name -> (links, smallest name reachable) by looking at all pairs."""
    near = {a: {b for b in names if a != b and linked(a, b)} for a in names}
    out = {}
    for a in names:
        seen, todo = {a}, [a]
        while todo:
            todo += [b for b in near[todo.pop()] if b not in seen and not seen.add(b)]
        out[a] = (len(near[a]), min(seen))
    return out


def test_links_of_centroids(spark):
    import random

    from tessera.operators import audit

    r = random.Random(4)
    rows = {f"i{k:03}": (r.choice([3.0, r.uniform(-200, 200)]), r.choice([9.0, r.uniform(-200, 200)]), r.randint(4, 9)) for k in range(150)}
    cell = lambda v: v // 16
    like = lambda a, b: min(a[2], b[2]) >= 0.8 * max(a[2], b[2])
    want = _links(rows, lambda a, b: all(abs(cell(rows[a][k]) - cell(rows[b][k])) <= 1 for k in (0, 1)) and like(rows[a], rows[b]))
    images = spark.createDataFrame([(k, *v) for k, v in rows.items()], "image_id string, x double, y double, n long")
    assert {x.image_id: (x.n_links, x.component) for x in audit.centroid_links(images).collect()} == want
    pairs = audit.centroid_neighbours(images).collect()
    assert 2 * len(pairs) == sum(n for n, _ in want.values())


def test_links_of_windows(spark):
    import random

    from tessera.operators import audit

    r = random.Random(5)
    rows = {}
    for k in range(160):
        x, y, w = r.choice([10.0, r.uniform(-900, 900)]), r.choice([10.0, r.uniform(-900, 900)]), r.choice([0.0, 30.0, 90.0, 90.0, 90.0])
        rows[k] = (k % 2, x, y, x + w, y + w / 2)
    hit = lambda a, b: a[0] == b[0] and a[1] < b[3] and b[1] < a[3] and a[2] < b[4] and b[2] < a[4]
    want = _links(rows, lambda a, b: hit(rows[a], rows[b]))
    chips = spark.createDataFrame([(p, k, *v) for k, (p, *v) in rows.items()] + [(None, 999, 1.0, 1.0, 2.0, 2.0)], "panorama long, chip long, x0 double, y0 double, x1 double, y1 double")
    got = {x.chip: (x.n_links, x.component) for x in audit.overlapping_windows(chips).collect()}
    assert got.pop(999) == (0, 999) and got == want


def test_ratios_of_hashed_draws(spark):
    from tessera.operators import splits

    rows = [("ab"[k % 2], f"s{k // 2}", k % 5, 5) for k in range(80)]
    units = spark.createDataFrame(rows, "k string, scene string, hits long, n long")
    weights = splits.hash_weights(units.select("scene").distinct(), 30, "p", "scene")
    want = {(r.k, r.draw): r.value for r in splits.blocked_ratio(units, weights, "scene", "hits", "n", ["k"]).collect()}
    got = {(r.k, r.draw): r.value for r in splits.hashed_ratio(units, 30, "p", "scene", "hits", "n", ["k"]).collect()}
    assert got == want and len(got) == 60


def test_median_of_any_number_of_boxes(spark):
    from tessera.functions.boxes import BOX
    from tessera.sources import exports

    for n, want in ((4, 0.5 * 0.2 + 0.5 * 0.3), (5, 0.3), (0, 0.0)):
        rows = [((0.5, 0.5, 1.0, 1.0, 0.0), 0.0, 0.0, (k + 1) / 10, 1.0) for k in range(n)]
        out = exports.convention_gate(spark.createDataFrame(rows, f"obb {BOX}, x0 double, y0 double, x1 double, y1 double"))
        assert "percentile(" not in out._jdf.queryExecution().optimizedPlan().toString()
        r = out.first()
        assert abs(r.median_iou - want) < 1e-12 and r.n == n


def test_assignment_across_batches(spark):
    from tessera.functions.boxes import BOX
    from tessera.operators import matching

    box = lambda x: (float(x), 0.0, 10.0, 4.0, 0.0)
    images = [f"i{k:03}" for k in range(60)]
    det = [(i, 2 * k, "a", 0.9, box(x)) for i in images for k, x in enumerate((0, 3, 500))]
    gt = [(i, 3 * k, "ab"[k % 2], box(x)) for i in images for k, x in enumerate((1, 4, 900, 500))]
    d, g = spark.createDataFrame(det, f"image_id string, idx long, class string, score double, obb {BOX}"), spark.createDataFrame(gt, f"image_id string, idx long, class string, obb {BOX}")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = matching.hungarian(d, g, 0.5, 0.3)
        got = [(r.image_id, r.det_idx, r.gt_idx, r.same_class) for r in out.collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got) == sorted((i, *x) for i in images for x in ((0, 0, True), (2, 3, False), (4, 9, False)))
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_geometry_is_compiled_and_reckoned_once_a_box(spark):
    from tessera.operators import matching
    from tessera.plans import fixtures

    spark.conf.set("spark.sql.codegen.hugeMethodLimit", 65535)
    det, gt = (f(spark, "/root/testdata/sf0.001") for f in (fixtures.detections, fixtures.ground_truth))
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"  # larger methods are not compiled by the JVM
    plan = matching.candidates(det, gt, 0.3)._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.split("\n") if "Join" in x]
    assert joins and not any("COS(" in x.upper() for x in joins)


def test_scores_are_reckoned_below_the_explode(spark):
    from tessera.operators import functional
    from tessera.plans import fixtures

    pairs = fixtures.pairs(spark, "/root/testdata/sf0.001").withColumnRenamed("idx", "id").withColumnRenamed("scene_id", "scene")
    plan = functional.scored(pairs, ["gwd", "kld", "naive"])._jdf.queryExecution().optimizedPlan().toString()
    rows = [x for x in plan.split("\n") if "Generate explode" in x]
    assert rows and not any("COS(" in x.upper() for x in rows)  # an explode shares nothing between its elements


def test_splits_share_scores_and_ranks(spark, monkeypatch):
    from tessera.operators import efficiency
    from tessera.plans import fixtures

    kept, stored = {}, efficiency.stored
    monkeypatch.setattr(efficiency, "stored", lambda df, name: kept.setdefault(name, stored(df, name)))
    p = fixtures.pairs(spark, "/root/testdata/sf0.001").where("idx % 10 = 0")
    p = p.select(F.concat_ws(":", "image_id", "idx").alias("id"), F.col("scene_id").alias("scene"), "class", "pred", "gt")
    roles = F.element_at(F.array(*[F.lit(x) for x in ("calibration", "matching", "eval")]), (F.abs(F.xxhash64("scene", "repeat")) % 3 + 1).cast("int"))
    splits = p.select("scene").distinct().withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("role", roles)
    efficiency.efficiency(p, splits, ["gwd", "max_rank"], sample=5)
    n = p.count()
    assert n and kept["scores"].count() == n and kept["below"].count() <= 5 * n and kept["split_scores"].count() == 6 * n


def test_grids_of_sides_are_shared():
    import numpy as np

    from tessera.functions import arrow

    arrow.KNOWN_SIDES.clear()
    r = np.random.default_rng(5)
    w, h, t, q = r.choice([8.0, 20.0], 300), r.choice([3.0, 20.0], 300), r.uniform(-2, 2, 300), r.choice([0.0, 1.0, 9.0], 300)
    together = arrow.shapes_extents(w, h, t, q)
    assert len(arrow.KNOWN_SIDES) <= 2 * 2 * 3  # a grid for each pair of sides and threshold, not for each box
    for i in range(0, 300, 17):
        assert together[i] == arrow.shape_extents(w[i], h[i], t[i], q[i])
    assert {x[-1] for x in together} == {"sampled_feasible_extrema", "insufficient_grid_resolution"} and any(x[6] for x in together)


def test_every_image_has_a_centroid(spark):
    from tessera.plans import catalog

    sf = "/root/testdata/sf0.001"
    images = catalog.ground_truth(spark, sf).select("image_id").distinct().count()
    assert catalog.centroid_neighbours(spark, sf).count() == images


def test_match_records_are_written_once_and_narrow(spark):
    from tessera.operators import matching, studies
    from tessera.plans import fixtures

    det, gt = (f(spark, "/root/testdata/sf0.001") for f in (fixtures.detections, fixtures.ground_truth))
    c = studies.cell_tables(matching.matched(det, gt, 0.3).select("image_id", "scene_id", "class", "match_type"))
    for t in c.values():
        assert not any(x in t._jdf.queryExecution().optimizedPlan().toString() for x in ("MapInArrow", "ArrowEvalPython"))  # matched by none of them
    joined = matching.candidates(det, gt, 0.3)._jdf.queryExecution().optimizedPlan().toString().split("Join")[1]
    assert "COS(" not in joined.upper()  # no envelopes below the join


def test_envelopes_meet_beyond_circles(spark):
    from tessera.functions.boxes import BOX
    from tessera.operators import matching

    far = [("i", "a", k, 0.5, (x, x, 10.0, 10.0, 0.785398)) for k, x in enumerate((0.0, 13.0))]  # turned squares: apart, but not their envelopes
    rows = spark.createDataFrame(far, f"image_id string, class string, idx long, score double, obb {BOX}")
    found = lambda *iou: matching.candidates(rows.where("idx = 0"), rows.where("idx = 1"), 0.001, *iou).count()
    assert found(matching.hull_iou) == 1 and found() == 0
