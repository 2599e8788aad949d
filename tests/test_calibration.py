import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import coverage as C
from tessera.operators import risk as R
from tessera.operators import splits as S
from tessera.operators import thresholds as T


def scored(spark, scenes):
    return spark.createDataFrame([(str(i), float(s)) for i, g in enumerate(scenes) for s in g], "scene string, score double")


def q_of(df):
    return df.first().q


@pytest.mark.parametrize(("alpha", "want"), [(0.5, 3.0), (0.4, 4.0), (0.6, 2.0)])
def test_hcp_of_two_scenes(spark, alpha, want):
    assert q_of(T.hcp(scored(spark, [[1], [2, 3, 4]]), alpha)) == want


def test_hcp_support_floor(spark):
    assert q_of(T.hcp(scored(spark, [[i] for i in range(8)]), 0.1)) == math.inf
    assert q_of(T.hcp(scored(spark, [[i] for i in range(9)]), 0.1)) == 8.0


@pytest.mark.parametrize(("alpha", "bound", "want"), [(0.8, 3, 2.0), (0.4, 3, 5.0), (0.8, 10, 3.0)])
def test_crc(spark, alpha, bound, want):
    assert q_of(T.crc_object(scored(spark, [[1, 2], [3, 4, 5]]), alpha, bound)) == want


def test_crc_limits(spark):
    assert q_of(T.crc_object(scored(spark, [[1, 2], [3]]), 0.1, 100)) == math.inf
    with pytest.raises(Exception, match="more objects"):
        T.crc_object(scored(spark, [[1, 2], [3]]), 0.1, 1).collect()
    with pytest.raises(T.CalibrationError):
        T.pooled(scored(spark, [[1]]), 1.5)


def test_scene_max(spark):
    assert q_of(T.scene_max(scored(spark, [[i, -1] for i in range(9)]), 0.1)) == 8.0
    assert q_of(T.scene_max(scored(spark, [[i, -1] for i in range(8)]), 0.1)) == math.inf


def test_adaptive_is_the_fixed_threshold_at_each_count(spark):
    s = scored(spark, [[1, 2], [3, 4, 5]])
    d = spark.createDataFrame([("x", 3), ("y", 10), ("z", 0)], "scene string, d int")
    got = {r.scene: r.q for r in T.crc_adaptive(s, 0.8, d).collect()}
    assert got["x"] == 2.0 and got["y"] == 3.0 and got["z"] == 1.0


def test_evaluate_all_fields(spark):
    rows = [(0, 0, 1.0), (0, 0, 3.0), (1, 0, 2.0), (1, 1, 9.0), (2, 3, 1.0)]
    s = spark.createDataFrame(rows, "scene int, class int, score double")
    q = spark.createDataFrame([(0, 2.0), (1, math.inf)], "class int, q double")
    out = {r["class"]: r for r in C.evaluate(s, q).collect()}
    assert (out[0].cov_scene, out[0].cov_sim) == (0.75, 0.5) and math.isclose(out[0].cov_object, 2 / 3)
    assert out[1].cov_object == 1.0 and 3 not in out
    assert out[None].n_out_of_support == 1 and out[None].cov_scene == 0.75


def test_losses(spark):
    gt = spark.createDataFrame([("s", 0.9, 1.0), ("s", 0.2, 1.0), ("s", None, None), ("m", None, None)], "scene string, conf double, score double")
    got = {(r.scene, r.q): r.loss for r in C.loss_matrix(gt, [0.5, 2.0, math.inf], 0.5).collect()}
    assert got["s", 0.5] == 1.0 and math.isclose(got["s", 2.0], 2 / 3) and got["m", math.inf] == 1.0
    ties = C.miss_matrix(gt, [0.9]).where("scene = 's'").first().risk
    assert math.isclose(ties, 2 / 3)


def test_sequence_and_p_values(spark):
    rows = [(str(i), q, v) for i in range(4000) for q, v in ((1.0, 0.9), (2.0, 0.2), (3.0, 0.05))]
    loss = spark.createDataFrame(rows, "scene string, q double, loss double")
    r = R.certify_sequence(loss, 0.3, 0.05).first()
    assert r.certified and r.q_star == 2.0
    assert R.binomial_cdf(3, 10, 0.5) == pytest.approx(sum(math.comb(10, i) for i in range(4)) / 1024)
    assert R.binomial_cdf(990, 1000, 0.5) == 1.0
    risk = loss.withColumnRenamed("q", "lambda").withColumnRenamed("loss", "risk")
    hb = {x["lambda"]: x.p_value for x in R.ltt(risk, 0.3, 0.05, p_value="hb").collect()}
    assert hb[1.0] == 1.0 and hb[3.0] < 1e-6


def test_grid_provenance_and_premise():
    with pytest.raises(R.GridProvenanceError):
        R.certify_risk(None, 0.1, 0.1, grid_source="data")
    assert R.premise_death(1.0, [(0.99, False)])["premise_death"]
    assert not R.premise_death(1.0, [(0.7, True)] * 3)["premise_death"]
    assert R.sign_test(8, 0) == pytest.approx(2 / 256) and R.sign_test(0, 0) == 1.0
    assert R.tolerance_rank(22, 0.9, 0.1) == 22 and R.tolerance_rank(5, 0.9, 0.1) is None


def test_smallest_sample(spark):
    got = spark.range(1).select(R.eb_smallest(F.lit(0.1), F.lit(0.02), 0.2, 0.05).alias("n"), R.eb_smallest(F.lit(0.3), F.lit(0.02), 0.2, 0.05).alias("i")).first()
    big, n = math.log(40), int(got.n)
    ok = lambda n: 7 * big / (3 * (n - 1)) + math.sqrt(0.04 * big / n) <= 0.1
    assert ok(n) and not ok(n - 1) and got.i == math.inf


def test_max_rank(spark):
    design = spark.createDataFrame([(float(i), float(10 - i)) for i in range(1, 6)], "x double, y double")
    rows = spark.createDataFrame([(1, 3.5, 0.0), (2, 0.0, 8.5)], "id int, x double, y double")
    got = {r.id: r.score for r in T.max_rank(design, rows, ["x", "y"], ["id"]).collect()}
    assert got == {1: 0.6, 2: 0.8}


def test_splits():
    ids = [f"P{i:03}" for i in range(10)]
    roles = S.three_way(ids, 3)
    assert sorted(roles) == ids and [list(roles.values()).count(r) for r in S.ROLES] == [4, 2, 4]
    assert S.three_way(ids, 3) == roles != S.three_way(ids, 4)
    assert S.sizes(3) == (1, 1) and S.sizes(2) == (0, 0)
    mixed = S.three_way(ids, 1, strata=["a"] * 5 + ["b", "c", "d", "b", "e"])
    assert set(mixed) == set(ids)
    with pytest.raises(S.SplitError):
        S.three_way(["a", "a", "b"], 0)


def test_intervals_are_withheld(spark):
    d = spark.createDataFrame([("a", 0, 1.0), ("a", 1, None), ("b", 0, 1.0), ("b", 1, math.inf)], "arm string, draw int, value double")
    got = {r.arm: r for r in S.interval(d, ["arm"]).collect()}
    assert got["a"].status == "withheld" and got["a"].low is None and got["b"].status == "complete"


def test_coverage_of_hcp_by_simulation(spark):
    from tessera.operators import simulate

    r = simulate.simulated(spark, 30, [12]).where("method = 'hcp'").agg(F.avg("cov_scene")).first()[0]
    assert 0.87 < r <= 1
    assert len(simulate.conditions()) == 36
    assert np.isclose(spark.range(1).select(simulate.normal_tail(F.lit(1.96)).alias("p")).first().p, 0.0249979, atol=1e-6)
