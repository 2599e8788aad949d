"""Scores and readouts of boxes on arrays: what ``boxes`` and ``operators.readouts`` state as Columns, for studies that judge
every pair under many thresholds. A box is an array of five rows (cx, cy, w, h, theta), a canonical one a list of five.
"""

from __future__ import annotations

import math

import numpy as np

from .arrow import _signed, float_corners, grown_polygon, polygon_margin, side_lines
from .boxes import HALF, MIN_SIDE, PI, common_area
from .enclosures import enclosed

INF = math.inf
NAN = math.nan


def _pmod(x, m):
    return x - m * np.floor(x / m)


def canonical(b: np.ndarray) -> list[np.ndarray]:
    """Long side first, angle wrapped."""
    cx, cy, w, h, t = b
    return [cx, cy, np.maximum(w, h), np.minimum(w, h), _pmod(np.where(h > w, t + HALF, t) + HALF, PI) - HALF]


def angle_distance(a, b):
    d = _pmod(np.abs(a - b), PI)
    return np.minimum(d, PI - d)


class Pairs:
    """Predicted and true boxes with what their scores and readouts share."""

    def __init__(self, pred: np.ndarray, gt: np.ndarray):
        self.pred, self.gt, self.a, self.b = pred, gt, canonical(pred), canonical(gt)
        self.cos, self.sin = np.cos(self.a[4]), np.sin(self.a[4])
        dx, dy = self.b[0] - self.a[0], self.b[1] - self.a[1]
        self.offset, self.own = (dx, dy), (self.cos * dx + self.sin * dy, self.cos * dy - self.sin * dx)
        self.turn, self.size = angle_distance(self.a[4], self.b[4]), np.sqrt(self.a[2] * self.a[3])

    def gaussians(self, floor: float = 0.0):
        out = []
        for p, c, s in ((self.a, self.cos, self.sin), (self.b, np.cos(self.b[4]), np.sin(self.b[4]))):
            w, h = (np.maximum(p[k], floor) if floor else p[k] for k in (2, 3))
            a, b = (w / 2) * (w / 2), (h / 2) * (h / 2)
            out.append((a * c * c + b * s * s, a * s * s + b * c * c, (a - b) * s * c))
        return out

    def corners(self, p):
        c, s = (self.cos, self.sin) if p is self.a else (np.cos(p[4]), np.sin(p[4]))
        places = ((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5))
        return [(p[0] + c * (p[2] * u) - s * (p[3] * v), p[1] + s * (p[2] * u) + c * (p[3] * v)) for u, v in places]


def _det(g):
    return g[0] * g[1] - g[2] * g[2]


def _far(g, d, dx, dy):
    return (g[1] * dx * dx - 2 * g[2] * dx * dy + g[0] * dy * dy) / d


def gwd(p: Pairs):
    g, k = p.gaussians()
    inner = np.maximum(g[0] * k[0] + 2 * g[2] * k[2] + g[1] * k[1] + 2 * np.sqrt(np.maximum(_det(g) * _det(k), 0.0)), 0.0)
    shape = np.maximum(g[0] + g[1] + k[0] + k[1] - 2 * np.sqrt(inner), 0.0)
    dx, dy = p.offset
    return np.sqrt(dx * dx + dy * dy + shape)


def kld(p: Pairs):
    g, k = p.gaussians(MIN_SIDE)
    d = _det(k)
    trace = (k[1] * g[0] - 2 * k[2] * g[2] + k[0] * g[1]) / d
    return np.maximum((_far(k, d, *p.offset) + trace + np.log(d) - np.log(_det(g))) / 2 - 1, 0.0)


def bhattacharyya(p: Pairs):
    g, k = p.gaussians(MIN_SIDE)
    m = [(x + y) / 2 for x, y in zip(g, k)]
    d = _det(m)
    return np.maximum(_far(m, d, *p.offset) / 8 + (np.log(d) - (np.log(_det(g)) + np.log(_det(k))) / 2) / 2, 0.0)


def iou(p: Pairs):
    common, area_a, area_b = common_area(p.pred, p.gt), p.pred[2] * p.pred[3], p.gt[2] * p.gt[3]
    union = area_a + area_b - common
    return np.where((area_a > 0) & (area_b > 0) & (union > 0), np.minimum(1.0, common / np.where(union > 0, union, 1.0)), 0.0)


def corner_max(p: Pairs):
    u, v = p.corners(p.a), p.corners(p.b)
    far = [[np.sqrt((x[0] - y[0]) * (x[0] - y[0]) + (x[1] - y[1]) * (x[1] - y[1])) for y in v] for x in u]
    return np.min([np.max([far[i][(i - k) % 4] for i in range(4)], axis=0) for k in range(4)], axis=0)


def expansion_margin(p: Pairs):
    need = np.zeros_like(p.turn)
    for x, y in p.corners(p.b):
        rx, ry = x - p.a[0], y - p.a[1]
        need = np.maximum(need, np.maximum(np.abs(p.cos * rx + p.sin * ry) - p.a[2] / 2, np.abs(p.cos * ry - p.sin * rx) - p.a[3] / 2))
    return need


def _framed(p: Pairs):
    return np.abs(p.own[0]), np.abs(p.own[1]), np.abs(p.b[2] - p.a[2]), np.abs(p.b[3] - p.a[3])


def coord_max_additive(p: Pairs):
    return np.max([*_framed(p), p.a[2] * p.turn / 2], axis=0)


def coord_max_multiplicative(p: Pairs):
    x, y, dw, dh = _framed(p)
    w, h = np.maximum(p.a[2], MIN_SIDE), np.maximum(p.a[3], MIN_SIDE)
    return np.max([x / w, y / h, dw / w, dh / h, p.turn / 2], axis=0)


def _sides(p: Pairs):
    return [np.abs(p.a[i] - p.b[i]) for i in range(4)]


def _hull(p: Pairs):
    half = lambda v: ((np.abs(np.cos(v[4])) * v[2] + np.abs(np.sin(v[4])) * v[3]) / 2, (np.abs(np.sin(v[4])) * v[2] + np.abs(np.cos(v[4])) * v[3]) / 2)
    u, v = half(p.a), half(p.b)
    return [np.abs(p.a[0] - p.b[0]), np.abs(p.a[1] - p.b[1]), np.abs(u[0] - v[0]), np.abs(u[1] - v[1])]


#: Score -> its values, one or one a coordinate.
SCORES = {
    "gwd": lambda p: [gwd(p)], "gwd_normalized": lambda p: [gwd(p) / np.maximum(p.size, 1e-12)], "iou": lambda p: [1 - iou(p)], "kld": lambda p: [kld(p)], "bhattacharyya": lambda p: [bhattacharyya(p)],
    "hellinger": lambda p: [np.sqrt(np.minimum(1.0, np.maximum(1 - np.exp(-bhattacharyya(p)), 0.0)))], "corner_max": lambda p: [corner_max(p)], "expansion_analytic": lambda p: [expansion_margin(p)],
    "expansion_margin": lambda p: [polygon_margin(p.pred.T, p.gt.T)], "coord_max_additive": lambda p: [coord_max_additive(p)], "coord_max_multiplicative": lambda p: [coord_max_multiplicative(p)],
    "naive": lambda p: [*_sides(p), np.abs(p.a[4] - p.b[4])], "wrapped": lambda p: [*_sides(p), p.turn], "hull": _hull,
    "doubled": lambda p: [*_sides(p), *(np.abs(f(2 * p.a[4]) - f(2 * p.b[4])) for f in (np.cos, np.sin))],
}


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Half away from zero in decimal, as Spark rounds: doubles near a tie are looked at by their shortest text."""
    from decimal import ROUND_HALF_UP, Decimal

    scale = 10.0**digits
    with np.errstate(all="ignore"):
        y = np.abs(x) * scale
        part = y < 2.0**52  # larger doubles are whole at these digits
        out = np.where(part, np.rint(x * scale) / scale, x)
        tie = np.flatnonzero(part & (np.abs(y - np.floor(y) - 0.5) < 1e-4 + y * 1e-15))
    step = Decimal(1).scaleb(-digits)
    for i in tie.tolist():
        out[i] = float(Decimal(repr(float(x[i]))).quantize(step, ROUND_HALF_UP))
    return out


# ---- readouts ---------------------------------------------------------------------------------------------------------------------------


def doubled_length(theta, by_cosine, by_sine):
    near = lambda v, r, f: (f(np.maximum(-1.0, v - r)), f(np.minimum(1.0, v + r)))
    far, close = near(np.cos(2 * theta), by_cosine, np.arccos)
    low, high = near(np.sin(2 * theta), by_sine, np.arcsin)
    total = 0.0
    for x0, x1 in ((close, far), (-far, -close)):
        for y0, y1 in ((low, high), (PI - high, PI - low)):
            for turn in (-2 * PI, 0.0, 2 * PI):
                total = total + np.maximum(0.0, np.minimum(x1, y1 + turn) - np.maximum(x0, y0 + turn))
    return np.full_like(theta, PI) if by_cosine >= 2 and by_sine >= 2 else total / 2


def readout(name: str, p: Pairs, q: list[float], covered: np.ndarray) -> dict:
    """METRICS of score ``name`` at thresholds ``q`` as ``geometry_endpoints`` has them: arrays or numbers; NaN is undefined, absent is undefined for all."""
    known = all(v < INF for v in (q[:1] if name == "max_rank" else q))
    out = {"finite": known, "bounded": known, "score_coverage": covered}
    w, h, t = p.a[2], p.a[3], p.a[4]
    radius = held = length = turned = half = None

    def disc(r):
        return r + np.zeros_like(w), np.hypot(*p.offset) <= r

    def rectangle(offset, x, y):
        return np.hypot(x, y) + np.zeros_like(w), (np.abs(offset[0]) <= x) & (np.abs(offset[1]) <= y)

    def arc(reach):
        half = np.minimum(reach, HALF) + np.zeros_like(w)
        return 2 * half, p.turn <= half, half

    if name in ("gwd", "gwd_normalized"):
        r = q[0] * p.size if name == "gwd_normalized" else np.full_like(w, q[0])
        radius, held = disc(r)
        _, half, full, _ = enclosed(w, h, r)
        length, turned = 2 * half, np.where(p.b[2] == p.b[3], full, p.turn <= half)
    elif name in ("naive", "wrapped", "doubled", "hull"):
        radius, held = rectangle(p.offset, q[0], q[1])
        out["bounded"] = known and all(v < INF for v in q[:4])
        if name == "naive":
            low, high = np.maximum(-HALF, t - q[4]), np.minimum(HALF, t + q[4])
            length, turned = high - low, (p.b[4] >= low) & (p.b[4] <= high)
        elif name == "wrapped":
            length, turned, half = arc(q[4])
        elif name == "doubled":
            gap = [np.abs(f(2 * t) - f(2 * p.b[4])) for f in (np.cos, np.sin)]
            length, turned = doubled_length(t, q[4], q[5]), (gap[0] <= q[4]) & (gap[1] <= q[5])
    elif name == "coord_max_additive":
        radius, held = rectangle(p.own, q[0], q[0])
        length, turned, half = arc(2 * q[0] / w)
    elif name == "coord_max_multiplicative":
        radius, held = rectangle(p.own, q[0] * np.maximum(w, 1.0), q[0] * np.maximum(h, 1.0))
        length, turned, half = arc(2 * q[0])
    elif name == "max_rank":
        radius, held = rectangle(p.own, q[1], q[2])
        length, turned, half = arc(q[5])
        out["bounded"] = known and all(v < INF for v in q)
    elif name == "corner_max":
        radius, held = disc(q[0])
    elif name == "expansion_analytic":
        radius, held = disc(np.hypot(w / 2 + q[0], h / 2 + q[0]))
        length, turned, half = np.full_like(w, PI), True, HALF
        out["area"] = (w + 2 * q[0]) * (h + 2 * q[0])
    elif name == "expansion_margin":
        if q[0] == INF:
            radius, held, length, turned, half = np.full_like(w, INF), True, np.full_like(w, PI), True, HALF
            out["area"] = INF
        out["bounded"] = False if q[0] == INF else None
    elif name in ("iou", "hellinger"):
        out["bounded"] = known and q[0] < 1
    out["center_defined"], out["angle_defined"] = radius is not None, length is not None
    if radius is not None:
        with np.errstate(all="ignore"):
            out["normalized_radius"] = radius / p.size
    if length is not None:
        out |= {"informative": length < PI, "full": length >= PI, "angle_length": length, "half_width": half}
    if radius is not None and length is not None:
        out["joint"] = np.asarray(held) & turned & np.ones(len(w), bool)
    if name == "expansion_margin":
        native, area, reach = native_readout(p, q[0])
        out |= {"native": native, "native_only": native & ~covered, "strict_only": covered & ~native, "native_area": area, "native_radius": reach / p.size}
    return {k: v for k, v in out.items() if v is not None}


def native_readout(p: Pairs, q: float):
    """Whether the predicted polygon grown by q holds the true corners, with its area and radius; all at q = inf."""
    n = len(p.turn)
    if not q < INF:
        return np.ones(n, bool), np.full(n, INF), np.full(n, INF)
    grown = grown_polygon(float_corners(p.pred.T), np.full(n, q))
    covered = (_signed(side_lines(grown), float_corners(p.gt.T).astype(float)) <= 1e-3).all(axis=(1, 2))
    v = grown.astype(float)
    z, o = v - v[:, :1], np.roll(v - v[:, :1], -1, axis=1)
    return covered, np.abs((z[..., 0] * o[..., 1] - z[..., 1] * o[..., 0]).sum(1)) / 2, np.linalg.norm(v - p.pred.T[:, None, :2], axis=2).max(1)


def strata(p: Pairs) -> dict:
    ratio, seam = p.a[2] / p.a[3], HALF - np.abs(p.a[4]) <= math.radians(5)
    return {"near_square": ratio < 1.2, "middle": (ratio >= 1.2) & (ratio < 3), "elongated": ratio >= 3, "seam": seam, "off_seam": ~seam}
