"""Log-gamma, digamma and trigamma, and densities, as arrays and as columns."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def digamma(x: np.ndarray | float) -> np.ndarray:
    """Asymptotic series, after the recurrence has lifted the argument above 6."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    for _ in range(6):
        low = x < 6
        out = np.where(low, out - 1 / np.where(low, x, 1), out)
        x = np.where(low, x + 1, x)
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def trigamma(x: np.ndarray | float) -> np.ndarray:
    x = np.array(x, float)
    out = np.zeros_like(x)
    for _ in range(6):
        low = x < 6
        out = np.where(low, out + 1 / np.where(low, x * x, 1), out)
        x = np.where(low, x + 1, x)
    f = 1 / (x * x)
    return out + 1 / x + f / 2 + f / x * (1 / 6 - f * (1 / 30 - f * (1 / 42 - f / 30)))


def log_gamma(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.lgamma, otypes=[float])(np.asarray(x, float))


def log_gamma_pdf(x: np.ndarray, shape: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Log density of gamma(shape, scale) for x > 0: rows are points, columns components."""
    return (shape - 1) * np.log(x)[:, None] - x[:, None] / scale - shape * np.log(scale) - log_gamma(shape)


def gamma_pdf(x: Column, shape: float, scale: float) -> Column:
    """Density of gamma(shape, scale); 0 for x <= 0.  The constants are folded on the driver."""
    constant = -shape * math.log(scale) - math.lgamma(shape)
    return F.when(x <= 0, F.lit(0.0)).otherwise(F.exp((shape - 1) * F.log(x) - x / scale + constant))


def gaussian_pdf(x: Column, mean: float = 0.0, sigma: float = 1.0) -> Column:
    z = (x - mean) / sigma
    return F.exp(-0.5 * z * z) / (sigma * math.sqrt(2 * math.pi))
