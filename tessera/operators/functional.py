"""The functional of a cell: every score under its calibrator, at the nominal and at a design-tuned level, for any number of draws.

One draw gives every scene of the three roles a multiplicity. Calibration scenes fit the thresholds of all levels; design
scenes say how much each level covers, which picks the tuned one, and rank the residuals of the rank score; evaluation scenes
measure the geometry of both. Arms are a table, so a calibrator is one more row. Blocks of draws are independent and seeded,
so ``studies`` can break off and go on (``run_blocks``).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import boxes as B
from ..functions.arrow import single_precision_margin
from ..sources.scratch import stored
from .levels import blobs, cuts_of, found, summed
from .readouts import METRICS, STRATA, THRESHOLDS
from .thresholds import INF, SLACK, max_rank, max_rank_bounds

#: Levels are whole parts of LEVEL_PARTS, in rising order; the nominal one is a tenth.
LEVELS, LEVEL_PARTS, NOMINAL = tuple(range(80, 1201, 10)), 4000, 400
COORDS = ["cx", "cy", "w", "h", "theta"]
#: Scores of one value; of one a coordinate; and the rank score, which every draw fits anew on its design scenes.
SCALARS = {**B.SCALAR, "gwd_normalized": lambda a, b: B.gwd(a, b, scaled=True), "expansion_analytic": B.expansion_margin, "expansion_margin": single_precision_margin}
VECTORS = {"naive": B.naive_residuals, "wrapped": B.wrapped_residuals, "doubled": B.doubled_residuals, "hull": B.hull_residuals}
RANK = "max_rank"
#: Different residuals up to which the rank score's weights go to every task, and pairs from which bins are cut.
MOST_VALUES, SAMPLE = 1_000_000, 30_000
#: Model number of scores that no draw fits.
FIXED = -1
MODES = ("hcp", "object", "linear")
STRATUM_METRICS = ("score_coverage", "informative", "normalized_radius")
SCORE_METRICS = ("score_coverage", *METRICS)


def arms() -> list[tuple[str, str, str]]:
    """(arm, score, mode): every score under source masses, vectors and the margin also under their object-level calibrators."""
    scores = [*sorted(SCALARS), RANK, *sorted(VECTORS)]
    out = [(s, s, "hcp") for s in scores]
    out += [(f"{s}/object", s, "object") for s in sorted(VECTORS)]
    return out + [("expansion_margin/object", "expansion_margin", "object"), ("expansion_margin/linear", "expansion_margin", "linear")]


def _digits(x: Column, digits: int | None) -> Column:
    return x.cast("double") if digits is None else F.round(x.cast("double"), digits)


def scored(pairs: DataFrame, names: list[str], digits: int | None = None) -> DataFrame:
    """A row per pair (id, scene, class, role, pred, gt) and fixed score of ``names``: score, model and the values v."""
    a, b = F.col("pred"), F.col("gt")
    every = {k: [SCALARS[k](a, b)] if k in SCALARS else list(VECTORS[k](a, b).values()) for k in names if k != RANK}
    # columns first: a projection reckons what scores share once, an explode would reckon it at every use
    keep = ["id", "scene", "class", "role", "pred", "gt"]
    wide = pairs.select(*keep, *[_digits(x, digits).alias(f"_{k}_{i}") for k, v in every.items() for i, x in enumerate(v)])
    made = [F.struct(F.lit(k).alias("score"), F.lit(FIXED).cast("long").alias("model"), F.array(*[F.col(f"_{k}_{i}") for i in range(len(v))]).alias("v")) for k, v in every.items()]
    return wide.select(*keep, F.explode(F.array(*made)).alias("s")).select(*keep, "s.*")


class Cell:
    """``pairs``: id, scene, class, role ('cal', 'design', 'eval'), pred, gt; ``roster``: class.

    A class without calibration pairs has +inf thresholds, which cover all; one without design or evaluation pairs has no
    coverage, so no level is tuned (its macro is undefined) or its metrics are null. ``digits`` rounds scores and residuals.

    Boxes are written once with the multiplicities of their scene in all draws; scores are reckoned from them on arrays wherever
    they are needed, and a task returns sums: no table of scores, arms or draws is made.
    """

    def __init__(self, pairs: DataFrame, roster: DataFrame, table: list[tuple[str, str, str]] | None = None, digits: int | None = None):
        self.pairs, self.table, self.digits = pairs, table or arms(), digits
        self.classes = [r[0] for r in roster.select("class").distinct().sort("class").collect()]
        self.names = sorted({score for _, score, _ in self.table})
        self.place, at = {}, 0  # score -> its first coordinate, and how many
        for name in self.names:
            self.place[name] = (at, 1 if name == RANK else THRESHOLDS.get(name, 1))
            at += self.place[name][1]
        self.width = at

    @property
    def fixed(self) -> DataFrame:
        """A row per pair and score that no draw fits."""
        return scored(self.pairs, self.names, self.digits)

    def run(self, draws: DataFrame, metrics: bool = True) -> DataFrame:
        """``draws``: draw, scene, mult. Returns draw, arm, policy ('nominal', 'tuned'), class, alpha, design_coverage, q, metrics and strata.

        Without ``metrics`` of SCORE_METRICS and strata only score_coverage.
        """
        spark = draws.sparkSession
        ids = [r[0] for r in draws.select("draw").where("mult > 0").distinct().sort("draw").collect()]
        rows = self._rows(draws, ids)
        study = _Arrays(self, ids)
        if RANK in self.names:
            rows = self._ranked(rows, study, stored(self._design(rows.where("r = 1"), study), "design_values"))
        cal, design, ev = (rows.where(F.col("r") == i) for i in range(3))
        grids = self._grids(cal, study)
        levels = self._levels(design, study, grids)
        if RANK in self.names:
            self._bounds(design, study, levels)
        values = study.measured(ev, levels, metrics)
        kinds = [f.simpleString() for f in draws.select("draw").schema.fields]
        names = [*(SCORE_METRICS if metrics else SCORE_METRICS[:1]), *([f"{s}_{k}" for s in STRATA for k in STRATUM_METRICS] if metrics else [])]
        shape = f"{kinds[0].replace(':', ' ')}, arm string, policy string, class string, alpha double, design_coverage double, q array<double>, " + ", ".join(f"{n} double" for n in names)
        made = []
        for (k, arm, policy, c), (alpha, cover, q) in levels.items():
            found = values.get((k, arm, policy, c), {})
            made.append((ids[k], arm, policy, self.classes[c], alpha, cover, q, *(found.get(n) for n in names)))
        return spark.createDataFrame(made, shape)

    def _rows(self, draws: DataFrame, ids: list) -> DataFrame:
        """A row per pair: c, r (numbers of class and role), its boxes, m and n_* (pairs of its scene and class, in all and by stratum), mult (of every draw)."""
        drawn = draws.where("mult > 0").groupBy("scene").agg(F.array(*[F.coalesce(F.sum(F.when(F.col("draw") == F.lit(d), F.col("mult"))), F.lit(0)).cast("long") for d in ids]).alias("mult"))
        number = lambda name, of: F.array_position(F.array(*[F.lit(x) for x in of]), F.col(name)).cast("int") - 1
        box = [F.col(f"{b}.{k}").cast("double").alias(f"{b[0]}_{k}") for b in ("pred", "gt") for k in COORDS]
        own = self.pairs.where(F.col("class").isin(self.classes) & F.col("role").isin("cal", "design", "eval"))
        own = own.select("id", "scene", number("class", self.classes).alias("c"), number("role", ["cal", "design", "eval"]).alias("r"), *box)
        group = Window.partitionBy("scene", "c", "r")
        a = dict(zip(("cx", "cy", "w", "h", "theta"), (F.col(f"p_{k}") for k in COORDS)))
        a = B.canonical(F.struct(*[v.alias(k) for k, v in a.items()]))
        ratio, seam = a["w"] / a["h"], B.HALF - F.abs(a["theta"]) <= math.radians(5)
        inside = {"near_square": ratio < 1.2, "middle": (ratio >= 1.2) & (ratio < 3), "elongated": ratio >= 3, "seam": seam, "off_seam": ~seam}
        counts = [F.count_if(inside[s]).over(group).cast("int").alias(f"n_{s}") for s in STRATA]
        own = own.join(drawn, "scene").select("*", F.count("*").over(group).cast("int").alias("m"), *counts)
        return stored(own.drop("scene") if RANK in self.names else own.drop("scene", "id"), "cell_pairs")

    def _residuals(self, rows: DataFrame) -> DataFrame:
        """id, mult and the coordinates' residuals that the rank score ranks."""
        a, b = (F.struct(*[F.col(f"{s}_{k}").alias(k) for k in COORDS]) for s in "pg")
        wrapped = B.wrapped_residuals(a, b)
        return rows.select("id", "r", "mult", *[_digits(wrapped[k], self.digits).alias(k) for k in COORDS])

    def _design(self, rows: DataFrame, study: _Arrays) -> DataFrame:
        """coord, value and the weight of the design rows with that residual in every draw."""
        sums = [F.sum(F.col("mult")[k]).alias(f"w{k}") for k in range(study.draws)]
        return self._residuals(rows).unpivot(["mult"], COORDS, "coord", "value").groupBy("coord", "value").agg(*sums)

    def _ranked(self, rows: DataFrame, study: _Arrays, counts: DataFrame, design: str = "r = 1", asked: str = "copies > 0") -> DataFrame:
        """``counts`` go to the tasks where they are few; else ``rows`` get their ranks by joins (column ranks)."""
        if counts.count() <= MOST_VALUES:
            study.steps = [[] for _ in COORDS]
            held = counts.toPandas().sort_values("value")
            for i, k in enumerate(COORDS):
                own = held[held["coord"] == k]
                study.steps[i] = (own["value"].to_numpy(float), np.cumsum(own[[f"w{j}" for j in range(study.draws)]].to_numpy(float), axis=0))
            return rows
        long = self._residuals(rows).select("id", "r", *COORDS, F.posexplode("mult").alias("draw", "copies"))
        score = max_rank(long.where(design).select("draw", "copies", *COORDS), long.where(asked).select("draw", "id", *COORDS), COORDS, ["id"], ["draw"], "copies")
        by_id = score.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("draw", "score"))).alias("by"))
        ranks = F.array(*[F.col("by")[k] for k in range(study.draws)])
        return stored(rows.join(by_id, "id", "left").withColumn("ranks", ranks).drop("by"), "ranked")

    def _grids(self, cal: DataFrame, study: _Arrays) -> dict[tuple[int, str, int], np.ndarray]:
        """(draw, arm, class) -> thresholds (coordinate, level)."""
        levels, modes = np.array(LEVELS), {}
        for _, score, mode in self.table:
            modes.setdefault(score, [])
            if mode not in modes[score]:
                modes[score].append(mode)
        owner = [name for name in self.names for _ in range(self.place[name][1])]
        n, width = len(self.classes), self.width

        def wants(g: int, scenes: float, objects: int) -> list:
            name = owner[g % width]
            parts, out = LEVEL_PARTS * self.place[name][1], []
            for mode in modes[name]:
                if mode == "hcp":
                    out += [(0, (scenes + 1) * (parts - a) / parts - SLACK) for a in LEVELS]
                elif mode == "object":
                    out += [(1, float(objects + 1 - (objects + 1) * a // parts)) for a in LEVELS]
                else:
                    at = [(LEVEL_PARTS - a) * (objects - 1) for a in LEVELS]
                    out += [(1, float(x // LEVEL_PARTS + 1)) for x in at] + [(1, float(min(x // LEVEL_PARTS + 2, objects))) for x in at]
            return out

        cuts = study.sampled(cal)
        objects: dict[int, int] = {}

        def noted(g: int, scenes: float, n_objects: int) -> list:
            objects[g] = n_objects
            return wants(g, scenes, n_objects)

        got = found(cal, study.parts(), lambda g: cuts[g % (n * width)], noted)
        study.present = {(g // width // n, owner[g % width], g // width % n) for g in got}
        out = {}
        for arm, score, mode in self.table:
            first, d = self.place[score]
            for k in range(study.draws):
                for c in range(n):
                    rows = []
                    for i in range(first, first + d):
                        g = (k * n + c) * width + i
                        if g not in got:
                            rows.append(np.full(len(LEVELS), INF))
                            continue
                        at = sum(len(LEVELS) * (2 if m == "linear" else 1) for m in modes[score][: modes[score].index(mode)])
                        q = got[g][at : at + len(LEVELS)]
                        if mode == "linear":
                            high = got[g][at + len(LEVELS) : at + 2 * len(LEVELS)]
                            q = q + (high - q) * ((LEVEL_PARTS - levels) * (objects[g] - 1) % LEVEL_PARTS / LEVEL_PARTS)
                        rows.append(q)
                    out[k, arm, c] = np.stack(rows)
        return out

    def _levels(self, design: DataFrame, study: _Arrays, grids: dict) -> dict[tuple, tuple]:
        """(draw, arm, policy, class) -> alpha, design coverage, thresholds."""
        held = study.passed(design, grids)
        out = {}
        n = len(self.classes)
        for k in range(study.draws):
            for a, (arm, _, _) in enumerate(self.table):
                curves = []
                for c in range(n):
                    mass = held.get((k * n + c) * len(self.table) + a)
                    # a pair that passes j levels or more is covered at the first j of them
                    curves.append(None if mass is None or not mass.sum() > 0 else [float(x) for x in (mass[::-1].cumsum()[::-1][1:] / mass.sum())])
                tuned = None
                if all(x is not None for x in curves):
                    gaps = [round(abs(sum(x[j] for x in curves) / n - 0.9), 12) for j in range(len(LEVELS))]
                    tuned = gaps.index(min(gaps))
                for policy, j in (("nominal", LEVELS.index(NOMINAL)), ("tuned", tuned)):
                    for c in range(n):
                        if j is None:
                            out[k, arm, policy, c] = (None, None, None)
                        else:
                            out[k, arm, policy, c] = (LEVELS[j] / LEVEL_PARTS, curves[c] and curves[c][j], grids[k, arm, c][:, j].tolist())
        return out

    def _bounds(self, design: DataFrame, study: _Arrays, levels: dict) -> None:
        """What the thresholds of the rank score leave each coordinate, as ``limits`` of the study."""
        asked = sorted({(key[0], q[0]) for key, (_, _, q) in levels.items() if q is not None and dict((a, s) for a, s, _ in self.table)[key[1]] == RANK})
        if study.steps is not None:
            for k, q in asked:
                limits = []
                for values, run in study.steps:
                    own = run[:, k] if len(run) else np.empty(0)
                    at = int(np.searchsorted(own, round(q * own[-1], 6), "right")) if q < 1 and len(own) else len(own)
                    limits.append(float(values[at]) if at < len(values) else INF)
                study.limits[k, q] = [q, *limits]
            return
        spark = design.sparkSession
        long = self._residuals(design).select(F.posexplode("mult").alias("model", "mult"), *COORDS)
        bounds = max_rank_bounds(long, spark.createDataFrame(asked, "model int, q double"), COORDS, ["model"], "mult", many=True)
        wide = {(r.model, r["rank"], r.coord): r.q for r in bounds.collect()}
        study.limits |= {(k, q): [q, *(wide.get((k, q, x), INF) for x in COORDS)] for k, q in asked}


class _Arrays:
    """What tasks need of a cell to reckon on batches of its rows; travels to them by value."""

    def __init__(self, cell: Cell, ids: list):
        self.draws, self.classes, self.names, self.place, self.width, self.table, self.digits = len(ids), len(cell.classes), cell.names, cell.place, cell.width, cell.table, cell.digits
        self.steps: list | None = None
        self.limits: dict = {}
        self.present: set = set()  # (draw, score, class) that calibration pairs exist of

    def read(self, b: pa.RecordBatch):
        """For every class: (number, pairs, pairs of the scene, multiplicities (row, draw), ranks (row, draw), rows of the batch); None for what a batch lacks."""
        get = lambda name: b.column(name).to_numpy(zero_copy_only=False)
        wide = lambda name: b.column(name).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, self.draws) if name in b.schema.names else None
        mult, ranks, m = wide("mult"), wide("ranks"), get("m") if "m" in b.schema.names else None
        cut = lambda x, at: None if x is None else x[at]
        boxes = [np.stack([get(f"{s}_{k}") for k in COORDS]) for s in "pg"]
        code = get("c")
        for c in np.unique(code).tolist():
            at = np.flatnonzero(code == c)
            yield c, A.Pairs(*(x[:, at] for x in boxes)), cut(m, at), cut(mult, at), cut(ranks, at), at

    def ranked(self, p, ranks):
        """Ranks (row, draw); NaN where a draw has no design pair."""
        if RANK not in self.names or ranks is not None:
            return ranks
        out = np.full((len(p.turn), self.draws), -INF)
        with np.errstate(all="ignore"):
            for x, (values, run) in zip(self.values(p, "wrapped"), self.steps):
                below = np.vstack([np.zeros((1, self.draws)), run])
                out = np.maximum(out, below[np.searchsorted(values, x)] / below[-1])
        return out

    def values(self, p, name: str) -> list[np.ndarray]:
        with np.errstate(all="ignore"):
            out = A.SCORES[name](p)
        return out if self.digits is None else [A.rounded(x, self.digits) for x in out]

    def every(self, b: pa.RecordBatch):
        """For every class of a batch what ``read`` gives, and score -> its values; those of the rank score a list by draw."""
        for c, p, m, mult, ranks, at in self.read(b):
            v = {name: self.values(p, name) for name in self.names if name != RANK}
            yield c, p, m, mult, v, self.ranked(p, ranks), at

    def of_draw(self, v, ranks, name: str, k: int, at: np.ndarray) -> list[np.ndarray] | None:
        """Values of a score for the rows ``at`` in draw k; None where the draw cannot rank."""
        if name != RANK:
            return [x[at] for x in v[name]]
        own = ranks[at, k]
        return None if np.isnan(own).any() else [own]

    def parts(self):
        def of(b: pa.RecordBatch):
            for c, _, m, mult, v, ranks, _ in self.every(b):
                for k in range(self.draws):
                    at = np.flatnonzero(mult[:, k] > 0)
                    if not len(at):
                        continue
                    objects = mult[at, k]
                    share = objects / m[at]
                    for name in self.names:
                        first = (k * self.classes + c) * self.width + self.place[name][0]
                        for i, x in enumerate(self.of_draw(v, ranks, name, k, at) or ()):
                            yield first + i, x, share, objects

        return of

    def sampled(self, cal: DataFrame) -> list[np.ndarray]:
        """Cuts for every class and coordinate, from some SAMPLE rows: where bins end decides nothing but how many values are looked at again."""
        got: dict[int, list] = {}
        part = max(1, cal.count() // SAMPLE)
        some = cal.where(F.pmod(F.xxhash64("p_cx", "p_cy", "p_w", "g_theta"), F.lit(part)) == 0)
        one = self.parts()

        def take(batches):
            for b in batches:
                rows = [(g, v) for g, v, _, _ in one(b)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in rows], pa.int32()), pa.array([v.tobytes() for _, v in rows], pa.binary())], ["g", "x"])

        for r in some.mapInArrow(take, "g int, x binary").collect():
            got.setdefault(r.g % (self.classes * self.width), []).append(np.frombuffer(r.x, float))
        owner = [self.place[name][1] for name in self.names for _ in range(self.place[name][1])]
        return [cuts_of(np.concatenate(got.get(g, [np.empty(0)])), 1.05 * LEVELS[-1] / LEVEL_PARTS / owner[g % self.width]) for g in range(self.classes * self.width)]

    def passed(self, design: DataFrame, grids: dict) -> dict[int, np.ndarray]:
        """(draw, class, arm) as a number -> mass of pairs by how many levels they pass."""
        falling = {key: np.ascontiguousarray(q[:, ::-1]) for key, q in grids.items()}

        def count(batches):
            total: dict[int, np.ndarray] = {}
            for b in batches:
                for c, _, m, mult, v, ranks, _ in self.every(b):
                    for k in range(self.draws):
                        at = np.flatnonzero(mult[:, k] > 0)
                        if not len(at):
                            continue
                        w = mult[at, k] / m[at]
                        for a, (arm, score, _) in enumerate(self.table):
                            x = self.of_draw(v, ranks, score, k, at)
                            if x is None:
                                continue
                            # thresholds fall with the level: what a pair passes is a prefix of the levels
                            n = np.min([len(q) - np.searchsorted(q, y) for q, y in zip(falling[k, arm, c], x)], axis=0)
                            g = (k * self.classes + c) * len(self.table) + a
                            held = np.bincount(n, w, len(LEVELS) + 1)
                            total[g] = total[g] + held if g in total else held
            yield blobs(total)

        return summed(design.mapInArrow(count, "g int, x binary"))

    def measured(self, ev: DataFrame, levels: dict, metrics: bool) -> dict[tuple, dict]:
        """(draw, arm, policy, class) -> metrics: means by multiplicity over scenes of means over a scene's pairs; absent is undefined.

        A mean over scenes of means over pairs is a sum over pairs, each with its scene's multiplicity over the scene's pairs.
        """
        keys = [key for key, (_, _, q) in levels.items() if q is not None]
        place = {key: g for g, key in enumerate(keys)}
        score_of = {arm: score for arm, score, _ in self.table}
        names = list(SCORE_METRICS if metrics else SCORE_METRICS[:1])
        # of each metric: weighted sum of finite values, weight of infinite ones, rows without a value; then of strata; last come weights
        width = 3 * len(names)

        def judge(batches):
            total: dict[int, np.ndarray] = {}
            for b in batches:
                strata_n = np.stack([b.column(f"n_{s}").to_numpy() for s in STRATA])
                for c, p, m, mult, v, ranks, rows in self.every(b):
                    inside = A.strata(p) if metrics else {}
                    for k in range(self.draws):
                        at = np.flatnonzero(mult[:, k] > 0)
                        if not len(at):
                            continue
                        part = p if len(at) == len(rows) else A.Pairs(p.pred[:, at], p.gt[:, at])
                        weight = [mult[at, k] / m[at]]
                        for i, s in enumerate(STRATA if metrics else ()):
                            weight.append(np.where(inside[s][at], mult[at, k] / np.maximum(strata_n[i, rows[at]], 1), 0.0))
                        weight = np.stack(weight)
                        for arm, score, _ in self.table:
                            x = self.of_draw(v, ranks, score, k, at)
                            for policy in ("nominal", "tuned"):
                                g = place.get((k, arm, policy, c))
                                if g is None or x is None:
                                    continue
                                q = levels[keys[g]][2]
                                covered = np.logical_and.reduce([y <= z for y, z in zip(x, q)])
                                made = A.readout(score, part, self.limits[k, q[0]] if score == RANK else q, covered) if metrics else {"score_coverage": covered}
                                held = sums(made, weight)
                                total[g] = total[g] + held if g in total else held
            yield blobs(total)

        def sums(made: dict, weight: np.ndarray) -> np.ndarray:
            own = weight.sum(axis=1)
            out = np.zeros((len(weight), width + 1))
            out[:, -1] = own
            given = (weight > 0).sum(axis=1)
            arrays = []
            for i, name in enumerate(names):
                x = made.get(name)
                if x is None:
                    out[:, 3 * i + 2] = given
                elif np.ndim(x) == 0:
                    out[:, 3 * i] = 0 if math.isinf(x) else own * float(x)
                    out[:, 3 * i + 1] = own if math.isinf(x) else 0
                else:
                    arrays.append((i, np.asarray(x, float)))
            if arrays:
                x = np.stack([y for _, y in arrays], axis=1)
                ok = np.isfinite(x)
                at = [3 * i for i, _ in arrays]
                if not ok.all():
                    none = np.isnan(x)
                    out[:, [i + 1 for i in at]] = weight @ (~ok & ~none)
                    out[:, [i + 2 for i in at]] = (weight > 0).astype(float) @ none
                    x = np.where(ok, x, 0.0)
                out[:, at] = weight @ x
            return out.ravel()

        out = {}
        for g, x in summed(ev.mapInArrow(judge, "g int, x binary")).items():
            x = x.reshape(-1, width + 1)
            found_ = {}
            for row, prefix, chosen in [(x[0], "", names)] + [(y, f"{s}_", STRATUM_METRICS) for y, s in zip(x[1:], STRATA)]:
                if row[-1] > 0:
                    for name in chosen:
                        total, open_, missing = row[3 * names.index(name) : 3 * names.index(name) + 3]
                        found_[prefix + name] = None if missing else float(INF if open_ else total / row[-1])
            out[keys[g]] = found_
        return out


def macro(values: DataFrame, by: list[str] = ("draw", "arm", "policy")) -> DataFrame:
    """Means over classes; null where a class lacks a metric."""
    names = [c for c in values.columns if c not in (*by, "class", "q")]
    return values.groupBy(*by).agg(*[F.when(F.count(c) == F.count("*"), F.avg(c)).alias(c) for c in names])
