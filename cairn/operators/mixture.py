"""Gamma mixtures of distance profiles: initialisation, EM, and choice of the number of components.

The block form is NumPy on one profile.  The global form (``global_em``) needs
one aggregate per iteration over a DataFrame of any size: the responsibilities
are column expressions with the parameters as constants, and a step's result is
three sums per component.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.special import digamma, gamma_pdf, log_gamma, log_gamma_pdf, trigamma

FLOOR = 1e-10
#: Values of a step of an expectation: their responsibilities stay in the processor's cache.
STEP = 4096


@dataclass
class GammaMixture:
    """Weights, shapes and scales of the components, and how well they fit."""

    weight: np.ndarray
    shape: np.ndarray
    scale: np.ndarray
    loglik: float = -math.inf
    aicc: float = math.inf
    path: list[float] = field(default_factory=list)

    @property
    def m(self) -> int:
        return len(self.weight)


def aicc(loglik: float, m: int, n: int) -> float:
    """-2 l + 2 p n / (n - p - 1) with p = 3 m; infinite where the denominator is not positive."""
    p = 3.0 * m
    return math.inf if n - p - 1 <= 0 else -2.0 * loglik + 2.0 * p * n / (n - p - 1)


def search_window(first: int, delta: int = 5, cap: int = 500) -> tuple[int, int]:
    """Numbers of components to try around a first guess: 2 delta + 1 of them from max(1, first - delta), none above ``cap``.

    A guess that lies too high gives the last ones below ``cap``.
    """
    lo = max(1, first - delta)
    return (max(1, cap - 2 * delta), cap) if lo >= cap else (lo, min(cap, lo + 2 * delta))


def search_window_columns(first: Column, delta: int = 5, cap: int = 500) -> tuple[Column, Column]:
    """``search_window`` as expressions."""
    lo = F.greatest(F.lit(1), first - delta).cast("int")
    high = lo >= cap
    return F.when(high, max(1, cap - 2 * delta)).otherwise(lo).cast("int"), F.when(high, cap).otherwise(F.least(F.lit(cap), lo + 2 * delta)).cast("int")


def moments_start(x: np.ndarray, m: int) -> GammaMixture:
    """Equal-count bins of the sorted values; shape and scale by the method of moments."""
    bins = np.array_split(np.sort(x), m)
    mean = np.array([b.mean() if len(b) else x.mean() for b in bins])
    floor = max(1e-12, 1e-6 * float(x.var()) + 1e-12)
    var = np.array([max(b.var(), floor) if len(b) else floor for b in bins])
    return GammaMixture(np.full(m, 1 / m), mean**2 / var, var / mean)


def shapes_by_newton(s: np.ndarray) -> np.ndarray:
    """The shapes a with ln a - digamma(a) = s."""
    s = np.maximum(s, 1e-9)
    a = (3 - s + np.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    for _ in range(8):
        a = np.maximum(a - (np.log(a) - digamma(a) - s) / (1 / a - trigamma(a)), 1e-6)
    return a


def maximised(s0: np.ndarray, s1: np.ndarray, s2: np.ndarray, n: int) -> GammaMixture:
    """Parameters from the sums of responsibilities, of them times x, and of them times ln x."""
    shape = shapes_by_newton(np.log(s1 / s0) - s2 / s0)
    return GammaMixture(s0 / n, shape, s1 / (s0 * shape))


def expected(x: np.ndarray, logs: np.ndarray, g: GammaMixture, live: np.ndarray | None = None) -> tuple[float, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(log likelihood, sums of the responsibilities, of them times x, of them times ln x), ``STEP`` values at a time.

    With ``live``, the responsibilities are those among these components.
    """
    loglik, s0, s1, s2 = 0.0, 0.0, 0.0, 0.0
    constant = (np.log(g.weight) - g.shape * np.log(g.scale) - log_gamma(g.shape))[:, None]
    power, rate = (g.shape - 1)[:, None], 1 / g.scale[:, None]
    for lo in range(0, len(x), STEP):
        a, b = x[lo : lo + STEP], logs[lo : lo + STEP]
        r = power * b - rate * a + constant
        top = r.max(0)
        r -= top
        np.exp(r, out=r)
        total = r.sum(0)
        loglik += float((top + np.log(total)).sum())
        if live is not None:
            r = r[live] / total
            total = np.maximum(r.sum(0), 1e-300)
        r /= total
        s0, s1, s2 = s0 + r.sum(1), s1 + r @ a, s2 + r @ b
    return loglik, (s0, s1, s2)


def em(x: np.ndarray, m: int, epsilon: float = 0.1, most: int = 1000, restarts: int = 10, seed: int = 0) -> GammaMixture:
    """The EM fit of ``m`` components to positive values.

    A component that loses all weight is dropped and the fit begins again from a
    jittered start with the same ``m``, ``restarts`` times at most; then the
    remaining components stand.
    """
    x = np.asarray(x, float)
    if len(x) == 0 or (x <= 0).any() or not np.isfinite(x).all():
        raise ValueError("gamma mixtures need finite positive values")
    rng = np.random.default_rng(seed)
    logs = np.log(x)
    start = moments_start(x, m)
    for attempt in range(restarts + 1):
        g, before, path = start, -math.inf, []
        while True:
            loglik, sums = expected(x, logs, g)
            path.append(loglik)
            if abs(loglik - before) < epsilon or len(path) > most:
                g.loglik, g.path, g.aicc = loglik, path, aicc(loglik, g.m, len(x))
                return g
            before = loglik
            live = sums[0] > 1e-8 * len(x)
            if not live.all():
                if attempt < restarts:
                    break
                sums = expected(x, logs, g, live)[1]
            g = maximised(*sums, len(x))
        jitter = moments_start(x * np.exp(rng.normal(0, 0.05, len(x))), m)
        start = GammaMixture(jitter.weight, jitter.shape, jitter.scale)
    raise AssertionError("unreachable")


def select_in_window(x: np.ndarray, lo: int, hi: int, **how) -> GammaMixture:
    """The fit with the least AICc among lo..hi components, the smallest number at a tie."""
    best = None
    for m in range(lo, hi + 1):
        g = em(x, m, **how)
        if best is None or g.aicc < best.aicc:
            best = g
    if best is None or not math.isfinite(best.aicc):
        raise ValueError("no number of components has a finite AICc")
    return best


def select_in_turn(x: np.ndarray, most: int = 1000, patience: int = 6, **how) -> GammaMixture:
    """m = 1, 2, ... until AICc has exceeded its minimum ``patience`` times in a row; the fit of the minimum."""
    best, worse = None, 0
    for m in range(1, max(1, min(most, len(x) // 3 - 1)) + 1):
        g = em(x, m, **how)
        if not math.isfinite(g.aicc):
            continue
        if best is None or g.aicc < best.aicc:
            best, worse = g, 0
        else:
            worse += 1
            if worse >= patience:
                break
    if best is None:
        raise ValueError("no number of components has a finite AICc")
    return best


def classify(x: np.ndarray, g: GammaMixture) -> np.ndarray:
    """The component of greatest weighted density, the first at a tie; 0 where all densities vanish."""
    return np.exp(np.log(g.weight) + log_gamma_pdf(np.asarray(x, float), g.shape, g.scale)).argmax(1)


def weighted_densities(x: Column, g: GammaMixture) -> Column:
    return F.array(*(float(w) * gamma_pdf(x, float(a), float(b)) for w, a, b in zip(g.weight, g.shape, g.scale)))


def component(x: Column, g: GammaMixture) -> Column:
    """``classify`` as an expression."""
    d = weighted_densities(x, g)
    return (F.array_position(d, F.array_max(d)) - 1).cast("int")


def log_likelihood(profile: DataFrame, g: GammaMixture, by: list[str]) -> DataFrame:
    """by, n, loglik: the sum of ln(density + 1e-10)."""
    total = F.aggregate(weighted_densities(F.col("dist"), g), F.lit(0.0), lambda a, x: a + x)
    return profile.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.log(total + FLOOR)).alias("loglik"))


def aicc_column(loglik: Column, m: Column, n: Column) -> Column:
    p = 3.0 * m
    return F.when(n - p - 1 <= 0, F.lit(float("inf"))).otherwise(-2.0 * loglik + 2.0 * p * n / (n - p - 1))


def densest_under(points: DataFrame, by: list[str], shape: float, scale: float) -> DataFrame:
    """by, id: the point whose first coordinate has the greatest gamma density, the smallest id at a tie."""
    d = gamma_pdf(F.get("v", F.lit(0)), shape, scale)
    return points.groupBy(*by).agg(F.max_by("id", F.struct(d.alias("d"), (-F.col("id")).alias("i"))).alias("id"))


def em_sums(profile: DataFrame, g: GammaMixture) -> DataFrame:
    """component, s0, s1, s2, of one step: one pass, three sums per component."""
    d = weighted_densities(F.col("dist"), g)
    total = F.aggregate(d, F.lit(0.0), lambda a, x: a + x)
    shares = profile.filter("dist > 0").select("dist", F.posexplode(F.transform(d, lambda x: x / F.greatest(total, F.lit(1e-300)))).alias("component", "r"))
    return shares.groupBy("component").agg(F.sum("r").alias("s0"), F.sum(F.col("r") * F.col("dist")).alias("s1"), F.sum(F.col("r") * F.log("dist")).alias("s2"))


def global_em(profile: DataFrame, start: GammaMixture, steps: int = 50, epsilon: float = 1e-6) -> GammaMixture:
    """EM over a DataFrame of any size; per step one row per component comes to the driver."""
    profile = profile.filter("dist > 0").select("dist").persist()
    g, path = GammaMixture(start.weight, start.shape, start.scale), []
    try:
        for step in range(steps + 1):
            fit = log_likelihood(profile, g, []).first()
            if not fit["n"]:
                break
            g.loglik, g.aicc = float(fit["loglik"]), aicc(float(fit["loglik"]), g.m, fit["n"])
            path.append(g.loglik)
            if step == steps or len(path) > 1 and abs(path[-1] - path[-2]) < epsilon * max(1.0, abs(path[-2])):
                break
            rows = sorted((r for r in em_sums(profile, g).collect() if r["s0"] > 1e-8 * fit["n"]), key=lambda r: r["component"])
            g = maximised(*(np.array([r[k] for r in rows]) for k in ("s0", "s1", "s2")), n=fit["n"])
    finally:
        profile.unpersist()
    g.path = path
    return g
