"""How many sources a risk certificate would need if the observed moments stayed as they are, exactly."""

from __future__ import annotations

import math
from decimal import ROUND_CEILING, Decimal, localcontext
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Digits of the logarithm and root, which are rounded up; sources beyond which no plan is made.
DIGITS, MOST = 60, 10_000_000
UNSUPPORTED, ABOVE, BEYOND, FOUND = "unsupported_moments", "mean_at_or_above_target", "above_cap", "found"


class Bound:
    """The empirical-Bernstein upper bound of a mean at level eta, as a function of the sample size; moments are fractions."""

    def __init__(self, mean: Fraction, var: Fraction, eta: Fraction):
        with localcontext() as c:
            c.prec, c.rounding = DIGITS, ROUND_CEILING
            up = lambda x: Decimal(x.numerator) / Decimal(x.denominator)
            self.mean, self.log = up(mean), (up(2 / eta)).ln().next_plus()
            self.spread = Decimal(0) if var == 0 else (2 * up(var) * self.log).sqrt().next_plus()

    def at(self, n: int) -> Decimal:
        """1 where the sample is too small for a variance."""
        if n < 2:
            return Decimal(1)
        with localcontext() as c:
            c.prec, c.rounding = DIGITS, ROUND_CEILING
            return min(Decimal(1), self.mean + self.spread / Decimal(n).sqrt(c).next_minus(c) + 7 * self.log / (3 * (n - 1)))

    def smallest(self, target: Fraction, most: int = MOST) -> int | None:
        """The smallest n whose bound is ``target`` or less. The bound falls with n: the search widens from a guess, then halves."""
        goal = Decimal(target.numerator) / Decimal(target.denominator)
        enough = lambda n: self.at(n) <= goal
        room = float(goal - self.mean)
        s, t = float(self.spread), 7 * float(self.log) / 3
        guess = ((s + math.sqrt(s * s + 4 * room * t)) / (2 * room)) ** 2 if room > 0 else math.inf
        if not guess < most:
            guess = most
        low = high = max(2, int(guess))
        step = 1
        while low > 1 and enough(low):
            low, step = max(1, low - step), 2 * step
        step = 1
        while not enough(high):
            if high >= most:
                return None
            low, high, step = high, min(most, high + step), 2 * step
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (low, middle) if enough(middle) else (middle, high)
        return high


def plan(n: int, mean: Fraction | None, var: Fraction | None, eta: Fraction, target: Fraction, most: int = MOST) -> tuple[float, int | None, str]:
    """The bound now, the smallest sufficient n, and what that is."""
    if var is None:
        return 1.0, None, UNSUPPORTED
    b = Bound(mean, var, eta)
    now = float(b.at(n))
    now = math.nextafter(now, math.inf) if Decimal(now) < b.at(n) else now
    if mean >= target:
        return now, None, ABOVE
    found = b.smallest(target, most)
    return now, found, BEYOND if found is None else FOUND


def planned(losses: DataFrame, by: list[str], eta: str, targets: list[str], most: int = MOST) -> DataFrame:
    """by, target, n, mean, variance, upper, status, smallest, more, multiplier, half_status, half_smallest.

    ``losses``: by, miss, n per source; sources with n = 0 have no say. ``eta`` and ``targets`` are decimals as text, so
    that they are exact. ``smallest`` is the sample size at which the certificate would pass with these very moments,
    ``half_smallest`` with half the variance; ``more`` is what is missing now. Spark counts each (miss, n) first, so that
    different fractions, not sources, are summed in arbitrary precision. Nothing here promises new data of these moments.
    """
    counts = losses.where("n > 0").groupBy(*by, F.col("miss").cast("long").alias("miss"), F.col("n").cast("long").alias("size")).agg(F.count("*").alias("times"))
    shape = ", ".join(f"`{k}` {losses.schema[k].dataType.simpleString()}" for k in by)
    level, goals = Fraction(eta), [Fraction(t) for t in targets]

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(Fraction(a, d), m) for a, d, m in zip(pdf.miss.tolist(), pdf["size"].tolist(), pdf.times.tolist())]
        n = sum(m for _, m in rows)
        mean = sum((x * m for x, m in rows), Fraction(0)) / n
        var = sum(((x - mean) ** 2 * m for x, m in rows), Fraction(0)) / (n - 1) if n > 1 else None
        out = []
        for text, goal in zip(targets, goals):
            upper, found, status = plan(n, mean, var, level, goal, most)
            _, half, half_status = plan(n, mean, None if var is None else var / 2, level, goal, most)
            out.append((float(text), n, float(mean), None if var is None else float(var), upper, status, found, None if found is None else max(0, found - n), None if found is None else found / n, half_status, half))
        made = pd.DataFrame(out, columns=["target", "n", "mean", "variance", "upper", "status", "smallest", "more", "multiplier", "half_status", "half_smallest"])
        made = made.astype({"smallest": "Int64", "more": "Int64", "half_smallest": "Int64"})
        return pd.concat([pd.DataFrame({k: [pdf[k].iloc[0]] * len(made) for k in by}), made], axis=1)

    return counts.groupBy(*by).applyInPandas(make, f"{shape}, target double, n long, mean double, variance double, upper double, status string, smallest long, more long, multiplier double, half_status string, half_smallest long")
