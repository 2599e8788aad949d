"""Tests of risk limits, certificates and multiplicity. Moments are aggregated in Spark; bounds are Columns over them."""

from __future__ import annotations

import math
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.boxes import kl_bernoulli

#: Candidate confidence thresholds fixed in advance: 0.01, 0.03, ... 0.99.
FIXED_GRID = [round(0.01 + 0.02 * i, 2) for i in range(50)]


class GridProvenanceError(ValueError):
    """The grid was not fixed before the calibration data were seen."""


def moments(risk: DataFrame, by: list[str], value: str = "risk") -> DataFrame:
    """by, n, mean, var; a value outside [0, 1] raises."""
    v = F.when((F.col(value) >= -1e-9) & (F.col(value) <= 1 + 1e-9), F.col(value)).otherwise(F.raise_error(F.lit("risk outside [0, 1]")).cast("double"))
    return risk.groupBy(*by).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.coalesce(F.var_samp(v), F.lit(0.0)).alias("var"))


def eb_p(n: Column, mean: Column, var: Column, limit: Column | float) -> Column:
    """Empirical-Bernstein p-value of 'the mean is limit or more'."""
    gap = F.lit(limit) - mean if not isinstance(limit, Column) else limit - mean
    a = F.lit(7.0) / (3 * F.greatest(n - 1, F.lit(1)))
    b = F.sqrt(2 * var / n)
    root = (F.sqrt(b * b + 4 * a * F.greatest(gap, F.lit(0.0))) - b) / (2 * a)
    return F.when((gap <= 0) | (n < 2), F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * F.exp(-root * root)))


def log_choose(n: int, k: np.ndarray) -> np.ndarray:
    g = np.vectorize(math.lgamma, otypes=[float])
    return math.lgamma(n + 1) - g(k + 1.0) - g(n - k + 1.0)


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k), summed in logs over the shorter tail."""
    if k < 0:
        return 0.0
    if k >= n:
        return 1.0
    low = k <= n * p
    i = np.arange(0, k + 1) if low else np.arange(k + 1, n + 1)
    terms = log_choose(n, i) + i * math.log(p) + (n - i) * math.log1p(-p)
    top = terms.max()
    total = math.exp(top) * math.fsum(np.exp(terms - top))
    return min(1.0, total) if low else max(0.0, 1.0 - total)


@F.pandas_udf(DoubleType())
def _binomial(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series([binomial_cdf(int(a), int(b), float(c)) for a, b, c in zip(k, n, p)])


def hb_p(n: Column, mean: Column, limit: float) -> Column:
    """Hoeffding-Bentkus p-value of 'the mean is limit or more'."""
    hoeffding = F.exp(-n * kl_bernoulli(F.least(mean, F.lit(limit)), F.lit(float(limit))))
    bentkus = math.e * _binomial(F.ceil(n * mean), n, F.lit(float(limit)))
    return F.least(F.lit(1.0), hoeffding, bentkus)


def _tested(risk: DataFrame, by: list[str], step: str, value: str, limit: float, p_value: str) -> DataFrame:
    if p_value not in ("eb", "hb"):
        raise ValueError("p_value must be 'eb' or 'hb'")
    m = moments(risk, [*by, step], value)
    p = eb_p(F.col("n"), F.col("mean"), F.col("var"), limit) if p_value == "eb" else hb_p(F.col("n"), F.col("mean"), limit)
    return m.withColumn("p_value", p)


def lambda_grid(scores: DataFrame, n_grid: int = 50, least_share: float = 0.05, by: list[str] = ()) -> DataFrame:
    """by, lambda: distinct quantiles of the scores from 0 to 1 - least_share."""
    levels = F.array(*[F.lit(float(x)) for x in np.linspace(0, 1 - least_share, n_grid)])
    return scores.groupBy(*by).agg(F.percentile("score", levels).alias("q")).select(*by, F.explode(F.array_distinct("q")).alias("lambda"))


def ltt(risk: DataFrame, beta: float, delta: float, by: list[str] = (), procedure: str = "bonferroni", p_value: str = "eb", step: str = "lambda", value: str = "risk") -> DataFrame:
    """The trace (by, step, n, mean, p_value, rejected, selected) of threshold tests at each candidate.

    'bonferroni' tests all at delta / K and selects the smallest that passes; 'fixed-sequence' walks from the largest
    down at delta and selects the last before the first failure; candidates after it are not part of the trace.
    A diagnostic: certify_risk and certify_sequence state certificates.
    """
    by = list(by)
    rows = _tested(risk, by, step, value, beta, p_value)
    part = Window.partitionBy(*by)
    if procedure == "bonferroni":
        rows = rows.withColumn("rejected", F.col("p_value") <= delta / F.count("*").over(part))
        first = F.min(F.when(F.col("rejected"), F.col(step))).over(part)
        return rows.withColumn("selected", F.coalesce(F.col(step) == first, F.lit(False)))
    if procedure != "fixed-sequence":
        raise ValueError("procedure must be 'bonferroni' or 'fixed-sequence'")
    return _sequence(rows, by, step, delta)


def _sequence(rows: DataFrame, by: list[str], step: str, delta: float) -> DataFrame:
    down = Window.partitionBy(*by).orderBy(F.col(step).desc())
    rows = rows.withColumn("rejected", F.col("p_value") <= delta)
    failed = F.sum(F.when(F.col("rejected"), 0).otherwise(1)).over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("failed", failed).where("failed = 0 or (failed = 1 and not rejected)").drop("failed")
    last = F.min(F.when(F.col("rejected"), F.col(step))).over(Window.partitionBy(*by))
    return rows.withColumn("selected", F.coalesce(F.col(step) == last, F.lit(False)))


def certify_risk(risk: DataFrame, beta: float, delta: float, by: list[str] = (), family: int = 1, grid_source: str = "fixed", p_value: str = "eb") -> DataFrame:
    """by, certified, lambda_star, realized_risk, lambda_max, realized_risk_max, n_rejected, level: tests at delta / (grid * family)."""
    if grid_source not in ("fixed", "design_split"):
        raise GridProvenanceError("the grid must be fixed or come from a design split")
    if family < 1:
        raise ValueError("family must be 1 or more")
    by = list(by)
    rows = _tested(risk, by, "lambda", "risk", beta, p_value)
    level = F.lit(delta) / (F.count("*").over(Window.partitionBy(*by)) * family)
    rows = rows.withColumn("level", level).withColumn("rejected", F.col("p_value") <= F.col("level"))
    hit = F.when(F.col("rejected"), F.struct("lambda", "mean"))
    return rows.groupBy(*by).agg(F.min(hit).alias("a"), F.max(hit).alias("z"), F.count_if(F.expr("rejected")).alias("n_rejected"), F.first("level").alias("level")).select(
        *by, (F.col("n_rejected") > 0).alias("certified"), F.col("a.lambda").alias("lambda_star"), F.col("a.mean").alias("realized_risk"),
        F.col("z.lambda").alias("lambda_max"), F.col("z.mean").alias("realized_risk_max"), "n_rejected", "level",
    )


def certify_sequence(loss: DataFrame, eps: float, delta: float, by: list[str] = (), p_value: str = "eb") -> DataFrame:
    """by, certified, q_star, realized_loss: end-to-end limits tested from the largest q down, each at delta."""
    by = list(by)
    trace = _sequence(_tested(loss, by, "q", "loss", eps, p_value), by, "q", delta)
    star = F.min(F.when(F.col("rejected"), F.struct("q", "mean")))
    return trace.groupBy(*by).agg(star.alias("s")).select(*by, F.col("s").isNotNull().alias("certified"), F.col("s.q").alias("q_star"), F.col("s.mean").alias("realized_loss"))


def roster_certificates(risk: DataFrame, roster: DataFrame, beta: float, delta: float, key: str = "class") -> DataFrame:
    """ltt per class of a declared roster at delta / K; absent classes keep their share and are refused."""
    k = roster.select(key).distinct().count()
    found = ltt(risk.join(F.broadcast(roster.select(key).distinct()), key, "left_semi"), beta, delta / max(1, k), [key]).where("selected")
    return roster.select(key).distinct().join(found.select(key, "lambda", "mean", "p_value"), key, "left").select(key, F.col("lambda").alias("lambda_star"), F.col("mean").alias("realized_risk"), F.col("lambda").isNotNull().alias("diagnostic_pass"))


def power_floor(beta: float, delta: float, grid: int, mean: Column, factor: float = 1.75) -> tuple[Column, Column]:
    """Historical planning screen: Hoeffding sample size and its fitted fraction; infinite where the mean reaches beta."""
    gap = F.lit(beta) - mean
    n = F.when(gap > 0, math.log(grid / delta) / (2 * gap * gap)).otherwise(F.lit(float("inf")))
    return n, n / factor


def eb_necessary(mean: Column, beta: float, eta: float) -> Column:
    """Sample size without which no zero-variance sample passes."""
    return F.when(F.lit(beta) > mean, 1 + 7 * math.log(2 / eta) / (3 * (F.lit(beta) - mean))).otherwise(F.lit(float("inf")))


def eb_smallest(mean: Column, var: Column, beta: float, eta: float, most: int = 10**9) -> Column:
    """Smallest n at which a sample of this mean and variance passes; inf beyond ``most``. Bisection as a fold of 31 steps."""
    big = math.log(2 / eta)
    gap = F.lit(beta) - mean
    passes = lambda n: 7 * big / (3 * (n - 1)) + F.sqrt(2 * var * big / n) <= gap
    start = F.struct(F.lit(2).cast("double").alias("lo"), F.lit(most).cast("double").alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("double")
        ok = passes(mid)
        return F.when(s["lo"] >= s["hi"], s).otherwise(F.struct(F.when(ok, s["lo"]).otherwise(mid + 1).alias("lo"), F.when(ok, mid).otherwise(s["hi"]).alias("hi")))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(31)), start, step)["lo"]
    return F.when((gap <= 0) | ~passes(F.lit(float(most))), F.lit(float("inf"))).otherwise(found)


def eb_upper(n: Column, mean: Column, var: Column, eta: float) -> Column:
    """Empirical-Bernstein upper bound of the mean; null below two observations."""
    big = math.log(2 / eta)
    return F.when(n >= 2, mean + F.sqrt(2 * var * big / n) + 7 * big / (3 * (n - 1)))


def hoeffding_upper(n: Column, mean: Column, eta: float) -> Column:
    return mean + F.sqrt(F.lit(math.log(1 / eta)) / (2 * n))


def holm(tests: DataFrame, by: list[str] = (), alpha: float = 0.05, key: str = "test") -> DataFrame:
    """``tests`` (by, key, p_value) with p_holm and reject; the family is what is given."""
    by = list(by)
    order = Window.partitionBy(*by).orderBy("p_value", key)
    rows = tests.withColumn("i", F.row_number().over(order)).withColumn("m", F.count("*").over(Window.partitionBy(*by)))
    step = F.col("p_value") * (F.col("m") - F.col("i") + 1)
    rows = rows.withColumn("p_holm", F.least(F.lit(1.0), F.max(step).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    return rows.withColumn("reject", F.col("p_holm") <= alpha).drop("i", "m")


def reading(lower: Column, upper: Column, target: float = 0.9) -> Column:
    """CHECK_FAILED where the interval lies below the target, WITHIN_1PP where it is above target - 0.01, else INCONCLUSIVE."""
    return F.when(upper < target, "CHECK_FAILED").when(lower >= target - 0.01, "WITHIN_1PP").otherwise("INCONCLUSIVE")


def composition_bound(alpha: float, beta: float) -> float:
    return alpha + beta


def premise_death(gap_pp: float, results: list[tuple[float, bool]], gap_limit: float = 2.0, floor_pp: float = 5.0, base_gap_pp: float | None = None, advantage: float = 0.05, least_cells: int = 3) -> dict:
    """Decision table over (ratio, rejected) results of the set-size contrasts."""
    if not results:
        raise ValueError("results must not be empty")
    base = gap_pp if base_gap_pp is None else base_gap_pp
    significant, best = sum(bool(r) for _, r in results), max(1 - x for x, _ in results)
    under, inflated = base >= floor_pp, best >= advantage and significant >= least_cells
    return {"premise_death": not under and not inflated and gap_pp < gap_limit, "undercover_confirmed": under, "inflation_confirmed": inflated, "n_significant": significant, "max_advantage": best}


@lru_cache(maxsize=None)
def tolerance_rank(n: int, coverage: float, delta: float) -> int | None:
    """Smallest rank whose order statistic covers ``coverage`` with confidence 1 - delta, by exact integers; None if there is none."""
    from fractions import Fraction

    p, d = Fraction(repr(coverage)), Fraction(repr(delta))
    a, b = p.numerator, p.denominator
    if n > EXACT_TRIALS and 0 < p < 1 and 0 < d < 1 and (k := _tolerance_rank(n, p, 1 - d)) is not None:
        return k if k <= n else None
    total, bound = 0, (1 - d) * b**n
    for k in range(n + 1):  # P(X <= k - 1) >= 1 - delta, X ~ Bin(n, coverage)
        if total >= bound:
            return k if k >= 1 else 1
        total += math.comb(n, k) * a**k * (b - a) ** (n - k)
    return None


#: Trials from which on a rank is sought in fixed point, and the bits behind the point.
EXACT_TRIALS, RANK_BITS = 500, 320


def _tolerance_rank(n: int, p, level) -> int | None:
    """``tolerance_rank`` (n + 1: there is none) from probabilities in units of that of the mode, some 21 standard deviations to either side.

    Terms fall away from the mode and each step floors one, so a term lacks no more units than it is steps away; so do the
    up to n terms behind the last whole unit. A comparison within the sum of all that is not decided here: None.
    """
    a, c = p.numerator, p.denominator - p.numerator
    mode = min(n, int((n + 1) * p))
    one = 1 << RANK_BITS
    down, w, k = [], one, mode
    while k > 0 and w:
        w = w * k * c // ((n - k + 1) * a)
        k -= 1
        down.append(w)
    up, w, k = [one], one, mode
    while k < n and w:
        w = w * (n - k) * a // ((k + 1) * c)
        k += 1
        up.append(w)
    off = 2 * (n + 1) * (len(down) + len(up))
    total, seen, first = sum(down) + sum(up), 0, mode - len(down)
    num, den = level.numerator, level.denominator
    for i, w in enumerate([*reversed(down), *up]):
        seen += w  # P(X <= first + i)
        if seen * den >= (total + off) * num:
            return first + i + 1
        if (seen + off) * den >= total * num:
            return None
    return None


def sign_test(wins: int, losses: int) -> float:
    """Exact two-sided sign test; ties are dropped before."""
    n = wins + losses
    return 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(min(wins, losses) + 1)) / 2**n)


def clopper_pearson_upper(k: int, n: int, eta: float) -> float:
    """One-sided upper limit of a binomial share, by bisection of the exact tail."""
    if k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if binomial_cdf(k, n, mid) > eta else (lo, mid)
    return hi


def exact_moments(losses: DataFrame, by: list[str]) -> DataFrame:
    """by, n, mean, square, exact_mean, exact_square: moments of losses ``miss`` / ``n`` with multiplicity ``mult``, exact as fractions.

    Losses with n = 0 are outside the support; a miss outside 0 to n raises. Spark counts each (miss, n) first, so that
    only different fractions, not sources, are summed in arbitrary precision.
    """
    bad = (F.col("miss") < 0) | (F.col("miss") > F.col("n"))
    own = losses.where("n > 0 and mult > 0").withColumn("miss", F.when(bad, F.raise_error(F.lit("a loss is outside its bounds")).cast("long")).otherwise(F.col("miss").cast("long")))
    counts = own.groupBy(*by, "miss", F.col("n").cast("long").alias("size")).agg(F.sum("mult").cast("long").alias("mult"))
    shape = ", ".join(f"`{k}` {losses.schema[k].dataType.simpleString()}" for k in by)

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(pdf["mult"].tolist())
        first = sum((Fraction(a, d) * m for a, d, m in zip(pdf.miss.tolist(), pdf["size"].tolist(), pdf["mult"].tolist())), Fraction(0)) / total
        second = sum((Fraction(a, d) ** 2 * m for a, d, m in zip(pdf.miss.tolist(), pdf["size"].tolist(), pdf["mult"].tolist())), Fraction(0)) / total
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in by}, "n": [total], "mean": [float(first)], "square": [float(second)], "exact_mean": [str(first)], "exact_square": [str(second)]})

    return counts.groupBy(*by).applyInPandas(summed, f"{shape}, n long, mean double, square double, exact_mean string, exact_square string")
