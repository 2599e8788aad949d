"""Geometry of oriented boxes as Column expressions.

A box is a struct (cx, cy, w, h, theta in radians); every function takes struct Columns and returns
a Column (or a dict of Columns), so scores stay inside whole-stage code generation.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

PI, HALF = math.pi, math.pi / 2
#: Sides below one pixel are raised to it where a Gaussian must be invertible.
MIN_SIDE = 1.0
BOX = "struct<cx:double,cy:double,w:double,h:double,theta:double>"


def box(cx, cy, w, h, theta) -> Column:
    c = lambda v: v if isinstance(v, Column) else F.expr(v) if isinstance(v, str) else F.lit(float(v))
    return F.struct(c(cx).alias("cx"), c(cy).alias("cy"), c(w).alias("w"), c(h).alias("h"), c(theta).alias("theta"))


def parts(b: Column) -> dict[str, Column]:
    return {k: b[k] for k in ("cx", "cy", "w", "h", "theta")}


def pmod(x: Column, m: float) -> Column:
    """Floor modulus."""
    return x - F.lit(m) * F.floor(x / F.lit(m))


def wrap(theta: Column) -> Column:
    """The angle modulo pi, in [-pi/2, pi/2)."""
    return pmod(theta + HALF, PI) - HALF


def canonical(b: Column, checked: bool = False) -> dict[str, Column]:
    """Long side first (a strictly longer height swaps), angle wrapped. ``checked`` raises on negative sides."""
    p = parts(b)
    if checked:
        p["w"] = F.when((p["w"] < 0) | (p["h"] < 0), F.raise_error(F.lit("negative side"))).otherwise(p["w"])
    swap = p["h"] > p["w"]
    return {"cx": p["cx"], "cy": p["cy"], "w": F.greatest(p["w"], p["h"]), "h": F.least(p["w"], p["h"]), "theta": wrap(F.when(swap, p["theta"] + HALF).otherwise(p["theta"]))}


def canonical_positive(b: Column) -> dict[str, Column]:
    """As canonical, but a side that is not positive raises."""
    p = canonical(b)
    p["h"] = F.when(p["h"] > 0, p["h"]).otherwise(F.raise_error(F.lit("sides must be positive")))
    return p


def canonical_closed(b: Column) -> dict[str, Column]:
    """The angle wrapped by the nearest multiple of pi: both ends of [-pi/2, pi/2] occur."""
    p = parts(b)
    t = F.when(p["h"] > p["w"], p["theta"] + HALF).otherwise(p["theta"])
    return {**canonical(b), "theta": t - PI * F.rint(t / PI)}


def gaussian(p: dict[str, Column], floor: float = 0.0) -> dict[str, Column]:
    """Mean and covariance entries of the box's Gaussian."""
    w, h = (F.greatest(p[k], F.lit(floor)) if floor else p[k] for k in ("w", "h"))
    c, s = F.cos(p["theta"]), F.sin(p["theta"])
    a, b = (w / 2) * (w / 2), (h / 2) * (h / 2)
    return {"mx": p["cx"], "my": p["cy"], "s11": a * c * c + b * s * s, "s22": a * s * s + b * c * c, "s12": (a - b) * s * c}


def _det(g: dict[str, Column]) -> Column:
    return g["s11"] * g["s22"] - g["s12"] * g["s12"]


def _positive(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def bures_sq(g: dict[str, Column], k: dict[str, Column]) -> Column:
    mixed = g["s11"] * k["s11"] + 2 * g["s12"] * k["s12"] + g["s22"] * k["s22"]
    inner = _positive(mixed + 2 * F.sqrt(_positive(_det(g) * _det(k))))
    return _positive(g["s11"] + g["s22"] + k["s11"] + k["s22"] - 2 * F.sqrt(inner))


def centre_sq(g: dict[str, Column], k: dict[str, Column]) -> Column:
    dx, dy = g["mx"] - k["mx"], g["my"] - k["my"]
    return dx * dx + dy * dy


def gwd_parts(a: Column, b: Column) -> tuple[Column, Column]:
    """Squared centre and shape terms of the Gaussian Wasserstein distance."""
    g, k = gaussian(canonical(a)), gaussian(canonical(b))
    return centre_sq(g, k), bures_sq(g, k)


def gwd(a: Column, b: Column, scaled: bool = False) -> Column:
    """Gaussian Wasserstein distance of two boxes; ``scaled`` divides by the root of the first box's area."""
    centre, shape = gwd_parts(a, b)
    d = F.sqrt(centre + shape)
    if scaled:
        p = canonical(a)
        d = d / F.greatest(F.sqrt(p["w"] * p["h"]), F.lit(1e-12))
    return d


def angle_distance(a: Column, b: Column) -> Column:
    """Distance of two orientations modulo pi, in [0, pi/2]."""
    d = pmod(F.abs(a - b), PI)
    return F.least(d, PI - d)


def corners(p: dict[str, Column]) -> list[tuple[Column, Column]]:
    c, s = F.cos(p["theta"]), F.sin(p["theta"])
    out = []
    for u, v in ((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5)):
        lx, ly = p["w"] * u, p["h"] * v
        out.append((p["cx"] + c * lx - s * ly, p["cy"] + s * lx + c * ly))
    return out


def polygon(b: Column) -> Column:
    """The corners as an array of points."""
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners(canonical(b))])


def hull(b: Column) -> dict[str, Column]:
    """Centre and half sides of the axis-aligned envelope."""
    p = canonical(b)
    c, s = F.abs(F.cos(p["theta"])), F.abs(F.sin(p["theta"]))
    return {"cx": p["cx"], "cy": p["cy"], "half_w": (c * p["w"] + s * p["h"]) / 2, "half_h": (s * p["w"] + c * p["h"]) / 2}


def box_iou(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """IoU of axis-aligned boxes (x0, y0, x1, y1); 0 where an area or the union is not positive."""
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    w = _positive(F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = _positive(F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    union = area(a) + area(b) - w * h
    return F.when((area(a) > 0) & (area(b) > 0) & (union > 0), w * h / union).otherwise(F.lit(0.0))


def envelope(b: Column) -> tuple[Column, Column, Column, Column]:
    e = hull(b)
    return e["cx"] - e["half_w"], e["cy"] - e["half_h"], e["cx"] + e["half_w"], e["cy"] + e["half_h"]


def hull_iou(a: Column, b: Column) -> Column:
    return box_iou(envelope(a), envelope(b))


def envelopes_meet(a: Column, b: Column) -> Column:
    """Whether the envelopes overlap: without it the rotated IoU is 0."""
    p, q = envelope(a), envelope(b)
    return (p[0] < q[2]) & (q[0] < p[2]) & (p[1] < q[3]) & (q[1] < p[3])


_POINT = "struct<x:double,y:double>"


def clipped(points: Column, axis: str, sign: int, limit: Column) -> Column:
    """A convex polygon cut to sign * point[axis] <= limit, keeping its order."""
    other = "y" if axis == "x" else "x"
    n = F.size(points)

    def cut(p: Column, i: Column) -> Column:
        q = F.element_at(points, F.when(i + 1 < n, i + 2).otherwise(F.lit(1)))
        dp, dq = sign * p[axis] - limit, sign * q[axis] - limit
        t = dp / (dp - dq)
        at = {axis: sign * limit, other: p[other] + t * (q[other] - p[other])}
        cross = F.struct(at["x"].alias("x"), at["y"].alias("y"))
        none = F.array().cast(f"array<{_POINT}>")
        return F.concat(F.when(dp <= 0, F.array(p)).otherwise(none), F.when(((dp <= 0) & (dq > 0)) | ((dp > 0) & (dq <= 0)), F.array(cross)).otherwise(none))

    return F.flatten(F.transform(points, cut))


def area(points: Column) -> Column:
    """Shoelace area of a polygon in order."""
    n = F.size(points)

    def wedge(p: Column, i: Column) -> Column:
        q = F.element_at(points, F.when(i + 1 < n, i + 2).otherwise(F.lit(1)))
        return p["x"] * q["y"] - q["x"] * p["y"]

    terms = F.transform(points, wedge)
    return F.when(n < 3, F.lit(0.0)).otherwise(F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) / 2)


def _cutter(axis: str, sign: int, limit: Column):
    return lambda r: clipped(r, axis, sign, limit)


def intersection_area(a: Column, b: Column) -> Column:
    """Area common to two boxes: b in the frame of a, clipped by the four sides of a."""
    p, q = canonical(a), canonical(b)
    c, s = F.cos(p["theta"]), F.sin(p["theta"])
    dx, dy = q["cx"] - p["cx"], q["cy"] - p["cy"]
    moved = {"cx": c * dx + s * dy, "cy": c * dy - s * dx, "w": q["w"], "h": q["h"], "theta": q["theta"] - p["theta"]}
    ring = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners(moved)])
    # each cut is bound once through a one-element array, so that it is not evaluated again at every use
    for axis, sign, limit in (("x", 1, p["w"] / 2), ("x", -1, p["w"] / 2), ("y", 1, p["h"] / 2), ("y", -1, p["h"] / 2)):
        ring = F.transform(F.array(ring), _cutter(axis, sign, limit))[0]
    return F.transform(F.array(ring), area)[0]


def rotated_iou_native(a: Column, b: Column) -> Column:
    """rotated_iou by array functions alone; slower, without Python workers."""
    pa, pb = a["w"] * a["h"], b["w"] * b["h"]
    common = F.when(envelopes_meet(a, b), intersection_area(a, b)).otherwise(F.lit(0.0))
    iou = F.transform(F.array(common), lambda i: F.when(pa + pb - i > 0, F.least(F.lit(1.0), i / (pa + pb - i))).otherwise(F.lit(0.0)))[0]
    return F.when((pa > 0) & (pb > 0), iou).otherwise(F.lit(0.0))


def common_area(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Areas common to boxes a and b (arrays of cx, cy, w, h, theta by row).

    The border of the common polygon is what of a's sides lies in b and what of b's sides lies strictly in a;
    each piece is cut by parameter along its side, and their cross products add up to twice the area.
    """
    ox, oy = a[0].copy(), a[1].copy()
    a, b = a.copy(), b.copy()
    for box_ in (a, b):
        box_[0] -= ox
        box_[1] -= oy

    def ring(p):
        c, s = np.cos(p[4]), np.sin(p[4])
        u, v = np.array([-0.5, 0.5, 0.5, -0.5])[:, None] * p[2], np.array([-0.5, -0.5, 0.5, 0.5])[:, None] * p[3]
        return p[0] + c * u - s * v, p[1] + s * u + c * v

    def pieces(p, q, margin):
        x, y = ring(p)
        c, s = np.cos(q[4]), np.sin(q[4])
        lx, ly = c * (x - q[0]) + s * (y - q[1]), c * (y - q[1]) - s * (x - q[0])
        total = np.zeros(p.shape[1])
        for i in range(4):
            j = (i + 1) % 4
            lo, hi = np.zeros(p.shape[1]), np.ones(p.shape[1])
            for at, to, half in ((lx[i], lx[j], q[2] / 2), (ly[i], ly[j], q[3] / 2)):
                step = to - at
                flat = np.abs(step) <= 1e-12 * (half + np.abs(at))
                safe = np.where(flat, 1.0, step)
                t0, t1 = (-half - at) / safe, (half - at) / safe
                lo = np.where(flat, lo, np.maximum(lo, np.minimum(t0, t1)))
                hi = np.where(flat, np.where(np.abs(at) <= half * (1 + margin), hi, -1.0), np.minimum(hi, np.maximum(t0, t1)))
            keep = hi > lo
            dx, dy = x[j] - x[i], y[j] - y[i]
            x0, y0, x1, y1 = x[i] + lo * dx, y[i] + lo * dy, x[i] + hi * dx, y[i] + hi * dy
            total += np.where(keep, x0 * y1 - x1 * y0, 0.0)
        return total

    return np.maximum(0.0, (pieces(a, b, 1e-9) + pieces(b, a, -1e-9)) / 2)


@F.pandas_udf(DoubleType())
def _iou(ax: pd.Series, ay: pd.Series, aw: pd.Series, ah: pd.Series, at: pd.Series, bx: pd.Series, by: pd.Series, bw: pd.Series, bh: pd.Series, bt: pd.Series) -> pd.Series:
    a, b = np.array([ax, ay, aw, ah, at], float), np.array([bx, by, bw, bh, bt], float)
    with np.errstate(all="ignore"):
        common, area_a, area_b = common_area(a, b), a[2] * a[3], b[2] * b[3]
        union = area_a + area_b - common
        return pd.Series(np.where((area_a > 0) & (area_b > 0) & (union > 0), np.minimum(1.0, common / np.where(union > 0, union, 1.0)), 0.0))


def rotated_iou(a: Column, b: Column) -> Column:
    """IoU of two oriented boxes; 0 where an area or the union is not positive.

    An Arrow batch function: the clipping takes many more steps in array functions (rotated_iou_native).
    """
    return _iou(*[x[k] for x in (a, b) for k in ("cx", "cy", "w", "h", "theta")])


# ---- residuals and scores -------------------------------------------------------------------------------------------------------------


def naive_residuals(a: Column, b: Column) -> dict[str, Column]:
    """Absolute coordinate differences; the angle is deliberately not wrapped."""
    p, q = canonical(a), canonical(b)
    return {k: F.abs(p[k] - q[k]) for k in p}


def hull_residuals(a: Column, b: Column) -> dict[str, Column]:
    p, q = hull(a), hull(b)
    return {k: F.abs(p[k] - q[k]) for k in p}


def wrapped_residuals(a: Column, b: Column) -> dict[str, Column]:
    """As naive, with the angle modulo pi; offsets along the image axes."""
    p, q = canonical(a), canonical(b)
    return {**naive_residuals(a, b), "theta": angle_distance(p["theta"], q["theta"])}


def doubled_residuals(a: Column, b: Column) -> dict[str, Column]:
    p, q = canonical(a), canonical(b)
    out = {k: F.abs(p[k] - q[k]) for k in ("cx", "cy", "w", "h")}
    out["cos2t"] = F.abs(F.cos(2 * p["theta"]) - F.cos(2 * q["theta"]))
    out["sin2t"] = F.abs(F.sin(2 * p["theta"]) - F.sin(2 * q["theta"]))
    return out


def framed_residuals(a: Column, b: Column) -> dict[str, Column]:
    """Offsets in the frame of the first box."""
    p, q = canonical(a), canonical(b)
    c, s = F.cos(p["theta"]), F.sin(p["theta"])
    dx, dy = q["cx"] - p["cx"], q["cy"] - p["cy"]
    return {"cx": F.abs(c * dx + s * dy), "cy": F.abs(c * dy - s * dx), "w": F.abs(q["w"] - p["w"]), "h": F.abs(q["h"] - p["h"]), "theta": angle_distance(q["theta"], p["theta"])}


def aleatoric_sigma(score: Column, floor: float = 1e-3) -> Column:
    return 1 / F.greatest(score, F.lit(floor))


def kld(a: Column, b: Column) -> Column:
    """KL divergence of the first box's Gaussian from the second's."""
    g, k = gaussian(canonical(a), MIN_SIDE), gaussian(canonical(b), MIN_SIDE)
    d, dx, dy = _det(k), g["mx"] - k["mx"], g["my"] - k["my"]
    far = (k["s22"] * dx * dx - 2 * k["s12"] * dx * dy + k["s11"] * dy * dy) / d
    trace = (k["s22"] * g["s11"] - 2 * k["s12"] * g["s12"] + k["s11"] * g["s22"]) / d
    return _positive((far + trace + F.log(d) - F.log(_det(g))) / 2 - 1)


def bhattacharyya(a: Column, b: Column) -> Column:
    g, k = gaussian(canonical(a), MIN_SIDE), gaussian(canonical(b), MIN_SIDE)
    m = {s: (g[s] + k[s]) / 2 for s in ("s11", "s12", "s22")}
    d, dx, dy = _det(m), g["mx"] - k["mx"], g["my"] - k["my"]
    far = (m["s22"] * dx * dx - 2 * m["s12"] * dx * dy + m["s11"] * dy * dy) / d
    return _positive(far / 8 + (F.log(d) - (F.log(_det(g)) + F.log(_det(k))) / 2) / 2)


def hellinger(a: Column, b: Column) -> Column:
    return F.sqrt(F.least(F.lit(1.0), _positive(1 - F.exp(-bhattacharyya(a, b)))))


def corner_max(a: Column, b: Column) -> Column:
    """Largest corner distance under the best cyclic correspondence."""
    p, q = corners(canonical(a)), corners(canonical(b))
    far = lambda u, v: F.sqrt((u[0] - v[0]) * (u[0] - v[0]) + (u[1] - v[1]) * (u[1] - v[1]))
    return F.least(*[F.greatest(*[far(p[i], q[(i - k) % 4]) for i in range(4)]) for k in range(4)])


def expansion_margin(a: Column, b: Column) -> Column:
    """How far the sides of the first box must move out to hold the second's corners."""
    p = canonical(a)
    c, s = F.cos(p["theta"]), F.sin(p["theta"])
    need = [F.lit(0.0)]
    for x, y in corners(canonical(b)):
        rx, ry = x - p["cx"], y - p["cy"]
        need += [F.abs(c * rx + s * ry) - p["w"] / 2, F.abs(c * ry - s * rx) - p["h"] / 2]
    return F.greatest(*need)


def coord_max_additive(a: Column, b: Column) -> Column:
    r = framed_residuals(a, b)
    return F.greatest(r["cx"], r["cy"], r["w"], r["h"], canonical(a)["w"] * r["theta"] / 2)


def coord_max_multiplicative(a: Column, b: Column) -> Column:
    r, p = framed_residuals(a, b), canonical(a)
    w, h = (F.greatest(p[k], F.lit(MIN_SIDE)) for k in ("w", "h"))
    return F.greatest(r["cx"] / w, r["cy"] / h, r["w"] / w, r["h"] / h, r["theta"] / 2)


def shift_iou_score(b: Column, dx: Column, dy: Column) -> Column:
    """1 - IoU of a box and its own translation."""
    p = canonical(b)
    c, s = F.cos(p["theta"]), F.sin(p["theta"])
    common = _positive(p["w"] - F.abs(c * dx + s * dy)) * _positive(p["h"] - F.abs(c * dy - s * dx))
    return 1 - common / (2 * p["w"] * p["h"] - common)


# ---- orientation geometry of the distance ball --------------------------------------------------------------------------------------------


def free_radius(w: Column, h: Column) -> Column:
    """The radius from which every orientation is within reach."""
    return F.abs(w - h) / (2 * math.sqrt(2))


def least_bures(w: Column, h: Column, phi: Column) -> Column:
    """Smallest shape distance of a box turned by phi or more."""
    a, b = F.greatest(w, h), F.least(w, h)
    a, b = a * a / 4, b * b / 4
    t = pmod(F.abs(phi), PI)
    t = F.least(t, PI - t)
    c = F.cos(2 * t)
    d = (a + b) / 2 - F.sqrt((a - b) / 2 * ((a - b) / 2) * c * c + a * b)
    return F.when(t >= PI / 4, free_radius(w, h)).otherwise(F.sqrt(_positive(d)))


def half_extent(w: Column, h: Column, q: Column) -> Column:
    """Half width of the orientations within distance q; pi/2 where all are."""
    long, short = F.greatest(w, h), F.least(w, h)
    a, b = long * long / 4, short * short / 4
    t = (a + b) / 2 - q * q
    ratio = F.sqrt(_positive(t * t - a * b)) / F.nullif((a - b) / 2, F.lit(0.0))
    return F.when(q >= free_radius(w, h), F.lit(HALF)).otherwise(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), ratio))) / 2)


def half_extent_stable(w: Column, h: Column, q: Column) -> Column:
    """The same by arc sine: accurate for small q, and 0 at q = 0 whatever the shape."""
    long, short = F.greatest(w, h), F.least(w, h)
    a, b = long * long / 4, short * short / 4
    m = (a - b) / 2
    x = q * F.sqrt(_positive((a + b) - q * q)) / F.nullif(m, F.lit(0.0))
    return F.when(q <= 0, F.lit(0.0)).when(q >= free_radius(w, h), F.lit(HALF)).otherwise(F.asin(F.least(F.lit(1.0), x)) / 2)


def extremal_sides(w: Column, h: Column, phi: Column) -> tuple[Column, Column]:
    """Sides of the box turned by phi that is nearest in shape."""
    a, b = w * w / 4, h * h / 4
    c = F.cos(2 * phi)
    mid, off = (a + b) / 2, (a - b) / 2 * c
    root = F.sqrt(off * off + a * b)
    return 2 * F.sqrt(_positive((mid + off + root) / 2)), 2 * F.sqrt(_positive((mid - off + root) / 2))


def in_ball(a: Column, b: Column, q: Column) -> Column:
    return gwd(a, b) <= q


def centre_envelope(b: Column, q: Column) -> Column:
    return F.struct((b["cx"] - q).alias("cx_lo"), (b["cx"] + q).alias("cx_hi"), (b["cy"] - q).alias("cy_lo"), (b["cy"] + q).alias("cy_hi"))


def theta_stratum(b: Column, boundary_degrees: float = 5.0, square: float = 0.9) -> Column:
    p = canonical(b)
    near = HALF - F.abs(p["theta"]) <= math.radians(boundary_degrees)
    return F.when(p["h"] / F.nullif(p["w"], F.lit(0.0)) >= square, "square").when(near, "boundary").otherwise("interior")


def aspect(b: Column) -> Column:
    p = canonical(b)
    return p["w"] / F.nullif(p["h"], F.lit(0.0))


def aspect_regime(b: Column, cut: float = 3.0) -> Column:
    return F.when(aspect(b) < cut, "compact").otherwise("elongated")


def from_rotated_box(cx: Column, cy: Column, w: Column, h: Column, angle: Column, degrees: bool = True) -> Column:
    """A box from a clockwise 5-parameter annotation."""
    t = F.radians(angle) if degrees else angle
    p = canonical(box(cx, cy, w, h, t))
    return box(*p.values())


def pixel_box(b: Column, width: Column, height: Column) -> Column:
    """A box of normalised coordinates in pixels."""
    return box(b["cx"] * width, b["cy"] * height, b["w"] * width, b["h"] * height, b["theta"])


def sigmoid(x: Column) -> Column:
    """Logistic function that never overflows."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def kl_bernoulli(a: Column, b: Column) -> Column:
    a = F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))
    b = F.least(F.lit(1 - 1e-12), F.greatest(F.lit(1e-12), b))
    one = F.when(a <= 0, F.lit(0.0)).otherwise(a * F.log(a / b))
    two = F.when(a >= 1, F.lit(0.0)).otherwise((1 - a) * F.log((1 - a) / (1 - b)))
    return one + two


def slice_area(name: str, q: dict[str, Column]) -> Column:
    """Area of the centre slice of a coverage region; null for scores without a closed form."""
    if name == "gwd":
        return PI * q["q"] * q["q"]
    return F.lit(None).cast("double") if name == "iou" else 4 * q["cx"] * q["cy"]


#: score name -> one residual (scalar scores) or residuals per coordinate.
SCALAR = {
    "gwd": gwd, "iou": lambda a, b: 1 - rotated_iou(a, b), "kld": kld, "hellinger": hellinger, "bhattacharyya": bhattacharyya, "corner_max": corner_max,
    "expansion_margin": expansion_margin, "coord_max_additive": coord_max_additive, "coord_max_multiplicative": coord_max_multiplicative,
}
COORDINATES = {"naive-coord": naive_residuals, "hull": hull_residuals, "wrapped-coord": wrapped_residuals, "doubled": doubled_residuals, "framed": framed_residuals}


# ---- areas of the centre slice -----------------------------------------------------------------------------------------------------------


def slice_area_by_rays(name: str, b: Column, q: Column, directions: int = 90) -> Column:
    """Area of {shift: score(b, shifted b) <= q} by polar quadrature over exact ray radii, in Arrow batches.

    Null q is null; q = inf (or a bounded score's maximum) has no bound and gives inf; q = 0 gives 0.
    """
    if name not in ("gwd", "corner_max", "gwd_normalized", "coord_max_additive", "expansion_margin", "coord_max_multiplicative", "kld", "bhattacharyya", "hellinger", "iou"):
        raise ValueError(f"no ray radius for {name!r}")
    p = canonical(b)
    return _slice_area(F.lit(name), p["w"], p["h"], p["theta"], q.cast("double"), F.lit(directions))


@F.pandas_udf(DoubleType())
def _slice_area(name: pd.Series, w: pd.Series, h: pd.Series, theta: pd.Series, q: pd.Series, directions: pd.Series) -> pd.Series:
    if not len(w):
        return pd.Series([], dtype=float)
    name, n = name.iloc[0], int(directions.iloc[0])
    w, h, t, q = (np.asarray(x, float)[:, None] for x in (w, h, theta, q))
    a = np.arange(n)[None, :] * (2 * PI / n) - t
    c, s = np.abs(np.cos(a)), np.abs(np.sin(a))
    fw, fh = np.maximum(w, MIN_SIDE), np.maximum(h, MIN_SIDE)
    full = np.isposinf(q)
    with np.errstate(all="ignore"):
        if name in ("gwd", "corner_max", "gwd_normalized"):
            r2 = np.broadcast_to(q * q * (w * h if name == "gwd_normalized" else 1.0), c.shape)
        elif name in ("coord_max_additive", "expansion_margin", "coord_max_multiplicative"):
            x, y = (q * fw, q * fh) if name == "coord_max_multiplicative" else (q, q)
            r2 = np.minimum(np.where(c > 1e-15, x / c, np.inf), np.where(s > 1e-15, y / s, np.inf)) ** 2
        elif name == "iou":
            full = q >= 1
            k = np.minimum(q, 1) / (2 - np.minimum(q, 1))
            u, v = c / w, s / h
            r2 = (2 * k / (u + v + np.sqrt(np.maximum(0, (u + v) ** 2 - 4 * u * v * k)))) ** 2
        else:
            full = q >= 1 if name == "hellinger" else full
            bound = -np.log1p(-np.minimum(q, 1) ** 2) if name == "hellinger" else q
            r2 = bound / ((2.0 if name == "kld" else 0.5) * ((c / fw) ** 2 + (s / fh) ** 2))
        area_ = PI * r2.mean(axis=1)
    q, full = q[:, 0], full[:, 0]
    return pd.Series(np.where(np.isnan(q), np.nan, np.where(q == 0, 0.0, np.where(full, np.inf, area_)))).where(~np.isnan(q), None)


@F.pandas_udf(DoubleType())
def _common(ax: pd.Series, ay: pd.Series, aw: pd.Series, ah: pd.Series, at: pd.Series, bx: pd.Series, by: pd.Series, bw: pd.Series, bh: pd.Series, bt: pd.Series) -> pd.Series:
    return pd.Series(common_area(np.array([ax, ay, aw, ah, at], float), np.array([bx, by, bw, bh, bt], float)))


def overlap_area(a: Column, b: Column) -> Column:
    """Area common to two boxes, in Arrow batches."""
    return _common(*[x[k] for x in (a, b) for k in ("cx", "cy", "w", "h", "theta")])


def area_ratio(a: Column, b: Column) -> tuple[Column, Column]:
    """Ratio of two areas and what it is: null areas are out of support."""
    inf = float("inf")
    status = (
        F.when(a.isNull() | b.isNull(), "out_of_support").when((a == inf) & (b == inf), "both_unbounded").when((b == 0) & (a == 0), "both_zero").when(b == 0, "zero_reference")
        .when(b == inf, "finite_over_unbounded").when(a == inf, "unbounded_numerator").otherwise("finite")
    )
    ratio = F.when(status == "finite", a / F.nullif(b, F.lit(0.0))).when(status == "finite_over_unbounded", F.lit(0.0)).when(status.isin("zero_reference", "unbounded_numerator"), F.lit(inf))
    return ratio, status


def half_extent_tangent(w: Column, h: Column, q: Column) -> Column:
    """Half width of the orientations within q by arc tangent: factors cancel before the root, also for nearly square boxes."""
    long, short = F.greatest(w, h), F.least(w, h)
    t, x = short / long, q / long
    r = (1 - t) / (2 * math.sqrt(2)) * 1.0
    top = x * F.sqrt(_positive((1 + t * t) / 4 - x * x))
    bottom = F.sqrt(_positive(r * r - x * x)) * F.sqrt(_positive((1 + t) * (1 + t) / 8 - x * x))
    return F.when(q >= free_radius(w, h), F.lit(HALF)).when(q <= 0, F.lit(0.0)).otherwise(F.atan2(top, bottom) / 2)


def hazed(value: Column, row: Column, height: Column, beta: float) -> Column:
    """A pixel behind haze that thickens down the picture: attenuated, lifted to white, rounded half to even."""
    depth = 0.5 + 0.5 * row / F.greatest(height - 1, F.lit(1))
    t = F.exp(-beta * depth)
    return F.least(F.lit(255), F.greatest(F.lit(0), F.rint(value * t + 255 * (1 - t)).cast("int")))
