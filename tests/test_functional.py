"""The functional of a cell against literal copies of scenes, and studies over conditions on small tables."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.boxes import BOX
from tessera.operators import conditions, endpoints, functional
from tessera.sources.checkpoints import problems, run_blocks

LEVELS, PARTS = functional.LEVELS, functional.LEVEL_PARTS


def cell_pairs(seed=0, scenes=24):
    r, rows, i = np.random.default_rng(seed), [], 0
    for s in range(scenes):
        role = ("cal", "design", "eval")[s % 3]
        for _ in range(int(r.integers(1, 7))):
            w = float(r.uniform(4, 20))
            gt = [*r.uniform(0, 50, 2), w, w * float(r.uniform(0.2, 0.95)), float(r.uniform(-1.5, 1.5))]
            pred = [g + float(d) for g, d in zip(gt, r.normal(0, [1, 1, 0.6, 0.3, 0.1]))]
            pred[2:4] = [max(0.5, v) for v in pred[2:4]]
            rows.append((i, f"s{s}", "ab"[int(r.integers(0, 2))], role, tuple(map(float, pred)), tuple(map(float, gt))))
            i += 1
    return rows


def brute_grid(values, mode):
    """q per level for rows (scene copy, value) of one coordinate; d coordinates share a level."""
    rows, d = values
    if not rows:
        return [math.inf] * len(LEVELS)
    scenes = {}
    for s, v in rows:
        scenes.setdefault(s, []).append(v)
    every, out = sorted(v for _, v in rows), []
    for a in LEVELS:
        if mode == "linear":
            at = Fraction(PARTS - a, PARTS) * (len(every) - 1)
            lo = every[at.numerator // at.denominator]
            hi = every[min(at.numerator // at.denominator + 1, len(every) - 1)]
            out.append(lo + (hi - lo) * float(at % 1))
            continue
        level = Fraction(a, PARTS * d)
        if mode == "object":
            need = math.ceil((1 - level) * (len(every) + 1))
            out.append(every[need - 1] if need <= len(every) else math.inf)
        else:
            target = (1 - level) * (len(scenes) + 1)
            reached = [v for v in sorted(set(every)) if sum(Fraction(sum(x <= v for x in vs), len(vs)) for vs in scenes.values()) >= target]
            out.append(reached[0] if reached else math.inf)
    return out


@pytest.fixture(scope="module")
def study(spark):
    rows = cell_pairs()
    pairs = spark.createDataFrame(rows, f"id int, scene string, class string, role string, pred {BOX}, gt {BOX}")
    cell = functional.Cell(pairs, spark.createDataFrame([("a",), ("b",)], "class string"))
    r = np.random.default_rng(4)
    draws = [(d, f"s{s}", 1 if d == 0 else int(r.integers(0, 4))) for d in range(2) for s in range(24)]
    out = cell.run(spark.createDataFrame(draws, "draw int, scene string, mult int"))
    values = {(x.id, x.score): x.v for x in cell.fixed.collect()}
    return rows, {(d, s): m for d, s, m in draws}, values, {(x.draw, x.arm, x.policy, x["class"]): x for x in out.collect()}


def rank_values(rows, mult, draw, residuals):
    design = [residuals[i] for i, s, _, role, _, _ in rows if role == "design" for _ in range(mult[draw, s])]
    return {i: [max(sum(x[j] < residuals[i][j] for x in design) / len(design) for j in range(5))] for i, *_ in rows}


def test_every_arm_against_copied_scenes(study):
    rows, mult, values, out = study
    assert len(out) == 2 * 22 * 2 * 2
    residuals = {i: values[i, "wrapped"] for i, *_ in rows}
    for draw in (0, 1):
        ranked = rank_values(rows, mult, draw, residuals)
        for arm, score, mode in functional.arms():
            v = ranked if score == "max_rank" else {i: values[i, score] for i, *_ in rows}
            grids, curves = {}, {}
            for k in "ab":
                copies = [((s, c), i) for i, s, cls, role, _, _ in rows if role == "cal" and cls == k for c in range(mult[draw, s])]
                d = len(v[rows[0][0]])
                grids[k] = [brute_grid(([(s, v[i][j]) for s, i in copies], d), mode) for j in range(d)]
                own = {}
                for i, s, cls, role, _, _ in rows:
                    if role == "design" and cls == k and mult[draw, s]:
                        own.setdefault(s, []).append([all(v[i][j] <= grids[k][j][a] for j in range(d)) for a in range(len(LEVELS))])
                total = sum(mult[draw, s] for s in own)
                curves[k] = [sum(mult[draw, s] * np.mean([x[a] for x in xs]) for s, xs in own.items()) / total for a in range(len(LEVELS))]
            gaps = [round(abs((curves["a"][a] + curves["b"][a]) / 2 - 0.9), 12) for a in range(len(LEVELS))]
            for policy, j in (("nominal", LEVELS.index(400)), ("tuned", gaps.index(min(gaps)))):
                for k in "ab":
                    got = out[draw, arm, policy, k]
                    assert got.alpha == LEVELS[j] / PARTS and np.isclose(got.design_coverage, curves[k][j])
                    q = [g[j] for g in grids[k]]
                    assert np.allclose(got.q, q, rtol=1e-9), (arm, policy, k)
                    own = {}
                    for i, s, cls, role, pred, _ in rows:
                        if role == "eval" and cls == k and mult[draw, s]:
                            own.setdefault(s, []).append((all(x <= y for x, y in zip(v[i], q)), q[0] / math.sqrt(pred[2] * pred[3])))
                    total = sum(mult[draw, s] for s in own)
                    cover = sum(mult[draw, s] * np.mean([x[0] for x in xs]) for s, xs in own.items()) / total
                    assert np.isclose(got.score_coverage, cover), (arm, policy, k)
                    if score == "gwd":
                        assert np.isclose(got.normalized_radius, sum(mult[draw, s] * np.mean([x[1] for x in xs]) for s, xs in own.items()) / total)
                        assert got.joint is not None and got.bounded == float(q[0] < math.inf) and got.native is None
                    if score == "max_rank":
                        assert got.finite == float(q[0] < math.inf) and (got.bounded == 1) == (q[0] < 1)
                    if score in ("kld", "bhattacharyya"):
                        assert got.center_defined == 0 and got.joint is None


def test_blocks_of_draws_resume(spark, study, tmp_path):
    pairs = spark.createDataFrame(cell_pairs(1, 9), f"id int, scene string, class string, role string, pred {BOX}, gt {BOX}")
    few = [("gwd", "gwd", "hcp"), ("naive/object", "naive", "object")]
    cell = functional.Cell(pairs, spark.createDataFrame([("a",), ("b",), ("never",)], "class string"), few)
    scenes = pairs.select("scene").distinct()
    made = []

    def make(ids):
        made.append(ids.count())
        return cell.run(ids.crossJoin(scenes).withColumn("mult", (F.crc32(F.concat("scene", F.col("draw").cast("string"))) % 3).cast("int")))

    path = str(tmp_path / "draws")
    first = run_blocks(spark, path, 1, 2, make)
    assert first.select("draw").distinct().count() == 1
    every = run_blocks(spark, path, 3, 2, make)
    assert made == [1, 2, 1] and run_blocks(spark, path, 3, 2, make).count() == every.count() == 3 * 2 * 2 * 3 and len(made) == 3
    assert problems(every.select("draw", "arm", "policy", "class", "block"), 3).first()[:] == (0, 0)
    never = every.where("class = 'never'").collect()
    assert all(r.score_coverage is None and (r.policy == "tuned") == (r.alpha is None) for r in never)
    assert all(x == math.inf for r in never if r.q is not None for x in r.q)
    assert functional.macro(every.drop("block")).where("score_coverage is not null").count() == 0


def test_conditions_share_geometry(spark):
    rows = cell_pairs(2, 12)
    o = spark.createDataFrame([(*r, c) for r in rows for c in range(3)], f"id int, scene string, class string, role string, pred {BOX}, gt {BOX}, condition int").withColumn("score", F.col("id") * 0.1)
    o = o.withColumn("has_gt", F.lit(True)).withColumn("has_det", (F.col("id") + F.col("condition")) % 4 != 0)
    tp = o.where("has_det")
    counts = endpoints.source_counts(o, tp, ["condition", "class"])
    draws = spark.createDataFrame([(d, f"s{s}", "cal" if s % 3 == 0 else "eval", 1 + s * d % 3) for d in range(4) for s in range(12)], "draw int, scene string, role string, mult int")
    roster = spark.createDataFrame([("a",), ("b",), ("never",)], "class string")
    study = conditions.Study(tp, tp.withColumnRenamed("pred", "obb"), counts, draws, conditions.arms_of(spark, [0, 1, 2]), roster)
    memo, cells = study.memo(), study.cells()
    assert memo.count() == memo.select("condition", "class", "q", "scene").distinct().count()
    assert memo.select("condition", "class", "q").distinct().count() <= cells.select("condition", "class", "q").distinct().count() < cells.count()
    e = study.endpoints()
    assert e.count() == 4 * 5 * 2 * 3 and e.where("class = 'never' and (q < double('inf') or coverage_scene is not null or tp_count <> 0)").isEmpty()
    one = e.where("draw = 2 and arm = '0:1' and method = 'hcp' and class = 'a'").first()
    own = endpoints.class_metrics(
        tp.where("condition = 1").select("class", "scene", "score", "pred", "gt"), tp.where("condition = 1").select("class", "scene", F.col("pred").alias("obb")), counts.where("condition = 1").drop("condition"),
        draws.where("draw = 2 and role = 'eval'").select("scene", "mult"), spark.createDataFrame([("a", one.q)], "class string, q double"),
        spark.createDataFrame([("a", one.cal_tp_sources, one.cal_tp_objects)], "class string, cal_tp_sources long, cal_tp_objects long"),
    ).first()
    for name in own.__fields__:
        assert one[name] == own[name] or math.isclose(one[name], own[name], rel_tol=1e-12), name
    means = conditions.macro(e.where("class <> 'never'"), ["draw", "arm", "method"])
    c = conditions.contrasted(means, conditions.contrasts_of(spark, [0, 1, 2]), ["draw", "method"]).where("draw = 0 and method = 'pooled' and contrast = 'drop 2'").first()
    left, right = (means.where(f"draw = 0 and method = 'pooled' and arm = '{a}'").first() for a in ("0:2", "0:0"))
    assert c.coverage_scene == left.coverage_scene - right.coverage_scene


def test_only_pairs_and_different_values_are_written(spark, monkeypatch):
    rows = cell_pairs(5, 30)
    pairs = spark.createDataFrame(rows, f"id int, scene string, class string, role string, pred {BOX}, gt {BOX}")
    roster = spark.createDataFrame([("a",), ("b",)], "class string")
    draws = spark.createDataFrame([(d, f"s{s}", 1 + (s + d) % 3 // 2) for d in range(3) for s in range(30)], "draw int, scene string, mult int")
    table = [("gwd", "gwd", "hcp"), ("wrapped", "wrapped", "object"), ("max_rank", "max_rank", "hcp")]
    kept, stored = {}, functional.stored
    monkeypatch.setattr(functional, "stored", lambda df, name: kept.setdefault(name, stored(df, name)))
    own = functional.Cell(pairs, roster, table, 6).run(draws)
    assert {k: v.count() for k, v in kept.items() if k == "cell_pairs"} == {"cell_pairs": len(rows)}
    assert all(v.count() <= 5 * len(rows) for v in kept.values())  # neither scores nor draws multiply rows
    # ranks by joins, where different values are too many to send, are the same
    monkeypatch.setattr(functional, "MOST_VALUES", 0)
    monkeypatch.setattr(functional, "stored", stored)
    joined = functional.Cell(pairs, roster, table, 6).run(draws)
    by = lambda df: sorted(df.drop("q").fillna(-1.0).collect(), key=str)
    for x, y in zip(by(own), by(joined)):
        assert x[:4] == y[:4] and np.allclose(x[4:], y[4:], equal_nan=True), (x, y)


def test_arrays_equal_columns(spark):
    from tessera.functions import arrays
    from tessera.operators import readouts

    rows = cell_pairs(8, 12) + [(999, "s0", "a", "eval", (1.0, 2.0, 5.0, 5.0, 0.3), (1.0, 2.0, 5.0, 5.0, 0.3))]
    df = spark.createDataFrame(rows, f"id int, scene string, class string, role string, pred {BOX}, gt {BOX}").coalesce(1).sort("id")
    p = arrays.Pairs(*(np.array([r[i] for r in sorted(rows)], float).T for i in (4, 5)))
    names = [*sorted(functional.SCALARS), *sorted(functional.VECTORS)]
    want = {(r.id, r.score): r.v for r in functional.scored(df, names, 6).collect()}
    for name in names:
        got = [arrays.rounded(x, 6) for x in arrays.SCORES[name](p)]
        for i, r in enumerate(sorted(rows)):
            assert np.allclose([x[i] for x in got], want[r[0], name], atol=2e-6), name
    for name, q in (("gwd", [2.5]), ("gwd", [math.inf]), ("naive", [1.0, 2.0, 9.0, 9.0, 0.2]), ("doubled", [1.0, 2.0, 9.0, 9.0, 0.4, 0.3]), ("max_rank", [0.9, 1.0, 2.0, 3.0, 4.0, 0.2]), ("expansion_margin", [1.5]), ("hellinger", [0.3])):
        covered = np.arange(len(rows)) % 2 == 0
        made = readouts.geometry_endpoints(df.withColumn("covered", (F.monotonically_increasing_id() % 2) == 0), name, [F.lit(v) for v in q]).sort("id").collect()
        got = arrays.readout(name, p, q, covered)
        for k in readouts.METRICS:
            for i, r in enumerate(made):
                x = got.get(k)
                x = None if x is None else float(x if np.ndim(x) == 0 else x[i])
                assert (x is None) == (r[k] is None) and (x is None or np.isclose(x, r[k])), (name, k, x, r[k])


def test_halves_round_as_columns_do(spark):
    from tessera.functions import arrays

    values = [0.5, 1.5, 2.675, 1.0000005, 0.1234565, 0.1234575, 2.5e-7, 5e-7, 1e300, math.inf, 0.0, 33.3333335]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    for digits in (2, 6):
        want = [r.x for r in df.select("i", F.round("v", digits).alias("x")).sort("i").collect()]
        assert arrays.rounded(np.array(values), digits).tolist() == want


def test_sources_carry_hits_and_draws(spark):
    rows = cell_pairs(3, 14)
    o = spark.createDataFrame([(*r, c) for r in rows for c in range(2)], f"id int, scene string, class string, role string, pred {BOX}, gt {BOX}, condition int").withColumn("score", F.col("id") * 0.1)
    o = o.withColumn("has_gt", F.lit(True)).withColumn("has_det", (F.col("id") + F.col("condition")) % 4 != 0)
    tp = o.where("has_det")
    draws = spark.createDataFrame([(d, f"s{s}", "cal" if s % 3 == 0 else "eval", s * d % 3) for d in range(1, 4) for s in range(14)], "draw int, scene string, role string, mult int")
    roster = spark.createDataFrame([("a",), ("b",), ("never",)], "class string")
    study = conditions.Study(tp, tp.withColumnRenamed("pred", "obb"), endpoints.source_counts(o, tp, ["condition", "class"]), draws, conditions.arms_of(spark, [0, 1]), roster)
    plan = study._drawn(geometry=False)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Join" in x and "draw#" in x for x in plan.split("\n"))  # draws do not multiply what is shuffled
    by = ["draw", "arm", "method", "class"]
    few = study.endpoints(geometry=False)
    order = lambda df: df.select(few.columns).sort(by).collect()
    every = order(study.endpoints())
    assert len(every) == 2 * 3 * 2 * 3  # the third draw has no scene
    for x, y in zip(order(few), every):
        assert all(u == v or math.isclose(u, v, rel_tol=1e-12) for u, v in zip(x, y)), (x, y)
