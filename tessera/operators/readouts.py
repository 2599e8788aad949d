"""What the region of a score says of a pair: sizes of its centre and angle sets, and whether the true box lies in them.

A score is described by the sets that its threshold leaves open for the centre and for the angle, each with its size and a
membership test; whatever it leaves undetermined is absent. One assembly derives all metrics from such a description.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions.arrow import grown_readout
from ..functions.enclosures import half_width

INF = math.inf


class Pair(NamedTuple):
    """A predicted box a and a true box b, canonical, with the centre's offset in the image's and in a's own frame."""

    a: dict[str, Column]
    b: dict[str, Column]
    offset: tuple[Column, Column]
    own: tuple[Column, Column]
    turn: Column


class Centres(NamedTuple):
    radius: Column
    holds: Column


class Angles(NamedTuple):
    length: Column
    holds: Column
    half: Column | None = None


class Readout(NamedTuple):
    """``bounded`` is None where that is the finiteness of the thresholds."""

    centres: Centres | None = None
    angles: Angles | None = None
    area: Column | None = None
    bounded: Column | None = None


def pair_of(pred: Column, gt: Column) -> Pair:
    a, b = B.canonical(pred), B.canonical(gt)
    dx, dy = b["cx"] - a["cx"], b["cy"] - a["cy"]
    c, s = F.cos(a["theta"]), F.sin(a["theta"])
    return Pair(a, b, (dx, dy), (c * dx + s * dy, c * dy - s * dx), B.angle_distance(a["theta"], b["theta"]))


def finite(values: list[Column]) -> Column:
    return F.forall(F.array(*values), lambda v: v < INF)


def disc(p: Pair, radius: Column) -> Centres:
    return Centres(radius, F.hypot(*p.offset) <= radius)


def rectangle(offset: tuple[Column, Column], x: Column, y: Column) -> Centres:
    return Centres(F.hypot(x, y), (F.abs(offset[0]) <= x) & (F.abs(offset[1]) <= y))


def arc(p: Pair, half: Column) -> Angles:
    half = F.least(half, F.lit(B.HALF))
    return Angles(2 * half, p.turn <= half, half)


def window(p: Pair, reach: Column) -> Angles:
    """Canonical angles within reach, without wrapping round."""
    low, high = F.greatest(F.lit(-B.HALF), p.a["theta"] - reach), F.least(F.lit(B.HALF), p.a["theta"] + reach)
    return Angles(high - low, p.b["theta"].between(low, high))


def doubled_length(theta: Column, by_cosine: Column, by_sine: Column) -> Column:
    """Length of the angles whose doubles agree in cosine and in sine within the bounds.

    On the circle of doubled angles each bound leaves two mirrored arcs; the common parts of the four pairs add up.
    """
    near = lambda v, r, f: (f(F.greatest(F.lit(-1.0), v - r)), f(F.least(F.lit(1.0), v + r)))
    far, close = near(F.cos(2 * theta), by_cosine, F.acos)
    low, high = near(F.sin(2 * theta), by_sine, F.asin)
    total = F.lit(0.0)
    for x0, x1 in ((close, far), (-far, -close)):
        for y0, y1 in ((low, high), (B.PI - high, B.PI - low)):
            for turn in (-2 * B.PI, 0.0, 2 * B.PI):
                total = total + F.greatest(F.lit(0.0), F.least(x1, y1 + turn) - F.greatest(x0, y0 + turn))
    return F.when((by_cosine >= 2) & (by_sine >= 2), F.lit(B.PI)).otherwise(total / 2)


def doubled(p: Pair, by_cosine: Column, by_sine: Column) -> Angles:
    gap = lambda f: F.abs(f(2 * p.a["theta"]) - f(2 * p.b["theta"]))
    return Angles(doubled_length(p.a["theta"], by_cosine, by_sine), (gap(F.cos) <= by_cosine) & (gap(F.sin) <= by_sine))


def every_angle() -> Angles:
    return Angles(F.lit(B.PI), F.lit(True), F.lit(B.HALF))


def ball(p: Pair, radius: Column) -> Readout:
    """The distance ball: a disc of centres; a square true box has every orientation, so only the full set holds it."""
    found = half_width(p.a["w"], p.a["h"], radius)
    half = found["half"]
    return Readout(disc(p, radius), Angles(2 * half, F.when(p.b["w"] == p.b["h"], found["full"]).otherwise(p.turn <= half), half))


def box_of(angles: Callable[[Pair, list[Column]], Angles] | None) -> Callable[[Pair, list[Column]], Readout]:
    """A score of one threshold a coordinate: the first two bound the centre, the first four the region."""
    return lambda p, q: Readout(rectangle(p.offset, q[0], q[1]), angles(p, q) if angles else None, bounded=finite(q[:4]))


def grown(p: Pair, q: list[Column]) -> Readout:
    """The rectangle grown by q on all sides: it holds a true box of any angle."""
    w, h = p.a["w"], p.a["h"]
    return Readout(disc(p, F.hypot(w / 2 + q[0], h / 2 + q[0])), every_angle(), (w + 2 * q[0]) * (h + 2 * q[0]))


def margin(p: Pair, q: list[Column]) -> Readout:
    """The margin in single precision: no closed form of its level set is known, so only an infinite threshold says anything."""
    all_ = lambda v: F.when(q[0] == INF, F.lit(v))
    return Readout(Centres(all_(INF), all_(True)), Angles(all_(B.PI), all_(True), all_(B.HALF)), all_(INF), all_(False))


def own_frame(sides: Callable[[Pair, list[Column]], tuple[Column, Column, Column]]) -> Callable[[Pair, list[Column]], Readout]:
    """A rectangle in the predicted box's frame and an arc, from (x, y, angle) bounds."""

    def of(p: Pair, q: list[Column]) -> Readout:
        x, y, turn = sides(p, q)
        return Readout(rectangle(p.own, x, y), arc(p, turn))

    return of


def ranks(p: Pair, q: list[Column]) -> Readout:
    """q: the rank threshold itself, then the bounds of the five coordinates that it allows."""
    return Readout(rectangle(p.own, q[1], q[2]), arc(p, q[5]), bounded=finite(q))


def below_one(p: Pair, q: list[Column]) -> Readout:
    return Readout(bounded=q[0] < 1)


#: Score -> what its thresholds leave open.
READOUTS: dict[str, Callable[[Pair, list[Column]], Readout]] = {
    "gwd": lambda p, q: ball(p, q[0]),
    "gwd_normalized": lambda p, q: ball(p, q[0] * F.sqrt(p.a["w"] * p.a["h"])),
    "naive": box_of(lambda p, q: window(p, q[4])),
    "wrapped": box_of(lambda p, q: arc(p, q[4])),
    "doubled": box_of(lambda p, q: doubled(p, q[4], q[5])),
    "hull": box_of(None),
    "coord_max_additive": own_frame(lambda p, q: (q[0], q[0], 2 * q[0] / p.a["w"])),
    "coord_max_multiplicative": own_frame(lambda p, q: (q[0] * F.greatest(p.a["w"], F.lit(1.0)), q[0] * F.greatest(p.a["h"], F.lit(1.0)), 2 * q[0])),
    "max_rank": ranks,
    "corner_max": lambda p, q: Readout(disc(p, q[0])),
    "expansion_margin": margin,
    "expansion_analytic": grown,
    "iou": below_one,
    "hellinger": below_one,
    "kld": lambda p, q: Readout(),
    "bhattacharyya": lambda p, q: Readout(),
}
#: Thresholds of a score: one, or one a coordinate, or a rank with the bounds of five coordinates.
THRESHOLDS = {"naive": 5, "wrapped": 5, "doubled": 6, "hull": 4, "max_rank": 6}
METRICS = (
    "finite", "bounded", "center_defined", "normalized_radius", "angle_defined", "informative", "full", "angle_length", "half_width", "joint", "area",
    "native", "native_only", "strict_only", "native_area", "native_radius",
)
STRATA = ("near_square", "middle", "elongated", "seam", "off_seam")


def strata(p: Pair) -> dict[str, Column]:
    ratio, seam = p.a["w"] / p.a["h"], B.HALF - F.abs(p.a["theta"]) <= math.radians(5)
    return {"near_square": ratio < 1.2, "middle": (ratio >= 1.2) & (ratio < 3), "elongated": ratio >= 3, "seam": seam, "off_seam": ~seam}


def geometry_endpoints(rows: DataFrame, name: str, q: list[Column]) -> DataFrame:
    """``rows`` (pred, gt, and covered for expansion_margin) with METRICS and STRATA of score ``name`` at thresholds ``q``.

    All are doubles; null is undefined. ``q``: as many as THRESHOLDS says; max_rank takes the rank threshold and the bounds
    that ``max_rank_bounds`` gives. The ``native`` metrics tell how the grown single-precision polygon of
    expansion_margin and the score's own event agree.
    """
    if name not in READOUTS:
        raise ValueError(f"no geometry of score {name!r}")
    if len(q) != THRESHOLDS.get(name, 1):
        raise ValueError(f"{name} takes {THRESHOLDS.get(name, 1)} thresholds")
    p = pair_of(F.col("pred"), F.col("gt"))
    r = READOUTS[name](p, q)
    known = finite(q[:1] if name == "max_rank" else q)
    none = F.lit(None).cast("double")
    centres, angles = r.centres or Centres(none, none.cast("boolean")), r.angles or Angles(none, none.cast("boolean"))
    size = F.sqrt(p.a["w"] * p.a["h"])
    out = {
        "finite": known, "bounded": known if r.bounded is None else (r.bounded if name == "expansion_margin" else known & r.bounded), "center_defined": centres.radius.isNotNull(), "normalized_radius": centres.radius / size,
        "angle_defined": angles.length.isNotNull(), "informative": angles.length < B.PI, "full": angles.length >= B.PI, "angle_length": angles.length, "half_width": none if angles.half is None else angles.half,
        "joint": F.when(centres.radius.isNotNull() & angles.length.isNotNull(), centres.holds & angles.holds), "area": none if r.area is None else r.area,
    }
    if name == "expansion_margin":
        n = grown_readout(F.col("pred"), F.col("gt"), q[0])
        held, strict = n["covered"], F.col("covered")
        out |= {"native": held, "native_only": held & ~strict, "strict_only": strict & ~held, "native_area": n["area"], "native_radius": n["radius"] / size}
    else:
        out |= {k: none for k in METRICS if k.startswith(("native", "strict"))}
    return rows.select("*", *[v.cast("double").alias(k) for k, v in (out | strata(p)).items()])
