import math

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import arrow as AR
from tessera.functions import boxes as B
from tessera.functions import names as N
from tessera.functions import windows as W
from tessera.operators import audit as A
from tessera.operators import splits as S
from tessera.operators import studies as ST
from tessera.operators.readouts import doubled_length
from tessera.streaming import monitor

BOX = "struct<cx:double,cy:double,w:double,h:double,theta:double>"


def test_slice_areas_match_the_general_routine(spark):
    rng = np.random.default_rng(0)
    for name, score, q in (("gwd", B.gwd, 2.0), ("expansion_margin", B.expansion_margin, 1.5), ("coord_max_multiplicative", B.coord_max_multiplicative, 0.2), ("kld", B.kld, 0.3), ("hellinger", B.hellinger, 0.4), ("iou", None, 0.4)):
        b = (0.0, 0.0, float(rng.uniform(6, 12)), float(rng.uniform(2, 5)), 0.4)
        df = spark.createDataFrame([(b,)], f"b {BOX}")
        got = df.select(B.slice_area_by_rays(name, F.col("b"), F.lit(q), 720).alias("a")).first().a

        def inside(x, y, b=b, score=score, q=q, name=name):
            rows = spark.createDataFrame([((*map(float, (u, v)), *b[2:]),) for u, v in zip(x, y)], f"m {BOX}")
            base = F.struct(*[F.lit(v).alias(k) for v, k in zip(b, ("cx", "cy", "w", "h", "theta"))])
            col = 1 - B.rotated_iou(base, F.col("m")) if name == "iou" else score(base, F.col("m"))
            return (rows.select((col <= q).alias("i")).toPandas().i).to_numpy()

        want = AR.star_area(inside, directions=24, steps=14)
        assert abs(got - want) < 0.12 * want, name
    edge = spark.createDataFrame([((0.0, 0.0, 4.0, 2.0, 0.0), q) for q in (None, 0.0, math.inf)], f"b {BOX}, q double")
    assert [r.a for r in edge.select(B.slice_area_by_rays("kld", F.col("b"), F.col("q")).alias("a")).collect()] == [None, 0.0, math.inf]


def test_area_ratio(spark):
    inf = math.inf
    rows = [(None, 1.0), (inf, inf), (0.0, 0.0), (1.0, 0.0), (1.0, inf), (inf, 1.0), (1.0, 2.0)]
    r, s = B.area_ratio(F.col("a"), F.col("b"))
    got = [(x.r, x.s) for x in spark.createDataFrame(rows, "a double, b double").select(r.alias("r"), s.alias("s")).collect()]
    assert got == [(None, "out_of_support"), (None, "both_unbounded"), (None, "both_zero"), (inf, "zero_reference"), (0.0, "finite_over_unbounded"), (inf, "unbounded_numerator"), (0.5, "finite")]


def test_half_extents_agree(spark):
    df = spark.createDataFrame([(10.0, 2.0, 1.0), (10.0, 9.9, 0.01), (5.0, 5.0, 0.3), (8.0, 3.0, 0.0)], "w double, h double, q double")
    r = df.select(B.half_extent_stable(F.col("w"), F.col("h"), F.col("q")).alias("a"), B.half_extent_tangent(F.col("w"), F.col("h"), F.col("q")).alias("b")).toPandas()
    assert np.allclose(r.a, r.b, rtol=1e-9)
    d = spark.createDataFrame([(0.3, 2.0, 2.0), (0.3, 0.0, 0.0), (0.0, 0.5, 2.0)], "t double, c double, s double").select(doubled_length(F.col("t"), F.col("c"), F.col("s")).alias("v")).toPandas().v
    assert np.allclose(d, [math.pi, 0.0, math.acos(0.5)])


def test_windows_and_assignment(spark):
    w = W.tile_windows(spark.createDataFrame([("a", 1400, 1000), ("b", 500, 400)], "picture string, width int, height int"))
    assert {(r.picture, r.x0, r.y0) for r in w.collect()} == {("a", 0, 0), ("a", 376, 0), ("b", 0, 0)}
    boxes = spark.createDataFrame([("a", 1, "s", 0, (1024.0, 500.0, 40.0, 10.0, 0.0)), ("a", 2, "s", 0, (100.0, 100.0, 40.0, 10.0, 1.0)), ("a", 3, "s", 0, (2000.0, 0.0, 4.0, 4.0, 0.0))], f"picture string, idx int, class string, difficult int, obb {BOX}")
    got = ST.window_assignment(boxes, w)
    assert {(r.idx, r.x0, r.difficult) for r in got.collect()} == {(1, 376, 0), (2, 0, 0)}
    assert ST.tile_accounting(boxes, got).first().asDict() == {"boxes": 3, "represented": 2, "unrepresented": 1, "emitted": 2}


def test_names(spark):
    df = spark.createDataFrame([("x/P0001__1024__0___0.png", "dota"), ("a_day_30m_45c_frame_7__1__0", "codrone"), ("q", "rsar"), ("plain.v1.png", "other")], "n string, d string")
    assert [r.s for r in df.select(N.scene_of_crop(F.col("n")).alias("s")).collect()][:1] == ["P0001"]
    assert [r.s for r in df.select(N.dataset_scene(F.col("d"), F.regexp_replace("n", "^x/|[.]png$", "")).alias("s")).collect()] == ["P0001", "a_day_30m_45c", None, "plain.v1"]
    r = spark.createDataFrame([("day_old park_30m_45c_frame_7",)], "n string").select(N.condition_of(F.col("n")).alias("c"), N.location_of(F.col("n")).alias("l"), N.pose(F.lit("x")).alias("p")).first()
    assert (r.c, r.l, r.p) == ("30m_45deg", "oldpark", "unknown")


def test_intervals():
    x = np.random.default_rng(0).normal(0.9, 0.01, 20)
    low, high = ST.bias_corrected_interval(x)
    assert low < x.mean() < high and high - low < 0.02
    assert ST.order_ranks(1000, 0.5) == (469, 532)
    assert S.sign_flip(np.full(10, -1.0), 200) < 0.02
    assert S.shuffled(["c", "a", "b"], 0)[0] and len(sum(S.shuffled(["c", "a", "b"], 0), [])) == 3


def test_report_statuses(spark):
    rows = [("up", i, 1 + i / 1000) for i in range(1000)] + [("flat", i, (i % 7) - 3.0) for i in range(1000)] + [("gone", i, None) for i in range(1000)]
    got = {r.arm: r for r in ST.interval_report(spark.createDataFrame(rows, "arm string, draw int, value double"), ["arm"]).collect()}
    assert got["up"].status == "positive" and got["up"].sign_claimed and got["flat"].status == "interval_includes_zero" and not got["flat"].sign_claimed
    assert got["gone"].status == "unavailable" and got["gone"].low is None


def test_near_identical_images(spark):
    b = lambda x, y: (float(x), float(y), 10.0, 4.0, 0.1)
    rows = [(im, i, "s", b(50 * i + d, 30 * i)) for im, d in (("a", 0), ("b", 3), ("c", 200)) for i in range(4)]
    boxes = spark.createDataFrame(rows, f"image_id string, idx bigint, class string, obb {BOX}")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "a string, b string")
    found = A.near_identical(pairs, boxes)
    assert [(r.a, r.b, r.matched) for r in found.collect()] == [("a", "b", 4)]
    comp = {r.image_id: r.component for r in A.clusters(found, boxes, "image_id").collect()}
    assert comp == {"a": "a", "b": "a"}
    assert A.geometric_votes(boxes).where("a = 'a' and b = 'b'").agg(F.max("votes")).first()[0] == 4


def test_stream_monitor(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    spark.createDataFrame([("2020-01-01 00:10:00", "s", 1.0), ("2020-01-01 00:20:00", "s", 3.0), ("2020-01-01 03:00:00", "s", 1.0)], "ts string, class string, score double").selectExpr("cast(ts as timestamp) ts", "class", "score").write.parquet(str(src))
    q = spark.createDataFrame([("s", 2.0)], "class string, q double")
    stream = spark.readStream.schema("ts timestamp, class string, score double").parquet(str(src))
    run = monitor.coverage_windows(stream, q).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(120)
    rows = spark.read.parquet(str(out)).collect()
    assert [(r.n, r.covered) for r in rows] == [(2, 0.5)]


def test_drawn_roles(spark):
    roles = spark.createDataFrame([(f"P{i}", "all") for i in range(20)], "scene_id string, role string")
    d = S.drawn_roles(S.resampled(spark, roles, 3, 1), 5)
    one = d.where("draw = 1").toPandas()
    assert one["mult"].sum() == 20 and set(one.role) == set(S.ROLES) and one.scene_id.is_unique
    again = S.drawn_roles(S.resampled(spark, roles, 3, 1), 5).where("draw = 1").toPandas()
    assert one.sort_values("scene_id").values.tolist() == again.sort_values("scene_id").values.tolist()


def test_simulations_run_whole(spark):
    from tessera.plans import catalog

    sf = "/root/testdata/sf0.001"
    assert catalog.QUERIES["bootstrap_interval_1000"](spark, sf).first().n == 1000
    assert catalog.QUERIES["familywise_error_rate"](spark, sf).first().draws == 20_000
    assert catalog.QUERIES["simulated_calibration"](spark, sf).select("condition").distinct().count() == 36
