"""Gaussian and Watson distributions in expectation form: numpy per component, columns per pixel."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Protocol

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class ExponentialFamily(Protocol):
    """What a mixture needs of a component's distribution."""

    def logpdf(self, x: np.ndarray) -> np.ndarray: ...


def kummer(a: float, b: float, x: float) -> float:
    """Kummer's confluent hypergeometric function 1F1(a; b; x); infinite at the poles b = 0, -1, .."""
    if b <= 0 and b == math.floor(b):
        return math.inf
    if a == b:
        return math.exp(x)
    return math.exp(log_kummer(a, b, x)) if a > 0 and b > a else _series(a, b, x)


def _series(a: float, b: float, x: float) -> float:
    """The power series; its terms grow until about the x-th and fall from there on."""
    if x < 0:
        return math.exp(x) * _series(b - a, b, -x)
    term = total = 1.0
    for k in range(500 + int(4 * (abs(x) + abs(a) + abs(b)))):
        term *= (a + k) / (b + k) * x / (k + 1)
        total += term
        if k > abs(b) and abs(term) < 1e-15 * abs(total):
            break
    return total


def log_kummer(a: float, b: float, x: float) -> float:
    """Logarithm of 1F1 for 0 < a < b, without overflow for large x."""
    if x < 0:
        return x + log_kummer(b - a, b, -x)
    if x <= 30 + abs(b):
        return math.log(_series(a, b, x))
    term = total = 1.0
    for k in range(8):
        term *= (b - a + k) * (1 - a + k) / ((k + 1) * x)
        total += term
    return math.lgamma(b) - math.lgamma(a) + x + (a - b) * math.log(x) + math.log(total)


def log_gamma(x: float) -> float:
    return math.lgamma(x)


def kummer_ratio(a: float, c: float, x: float) -> float:
    """Derivative of log 1F1(a; c; x): the mean squared projection at concentration x."""
    return a / c * math.exp(log_kummer(a + 1, c + 1, x) - log_kummer(a, c, x))


def concentration(dim: int, length: float, tolerance: float = 1e-6, most: float = 500.0) -> float:
    """The concentration whose mean statistic has this length, by Newton's method from 1."""
    a, c, k = 0.5, dim / 2, 1.0
    for _ in range(200):
        q = kummer_ratio(a, c, k)
        slope = (1 - c / k) * q + a / k - q * q if abs(k) > 1e-9 else 1e-3
        step = (q - length) / (slope if abs(slope) > 1e-12 else 1e-12)
        k -= step
        if abs(step) <= tolerance or k >= most:
            break
    return min(k, most)


def concentration_bounds(r: float, c: float, a: float, variant: str = "paper") -> tuple[float, float, float]:
    """Lower, middle and upper closed-form bounds of the concentration at mean r.

    ``variant="source"``: the middle one with r for 4 under its root, as the public package has it.
    """
    low = (r * c - a) / (r * (1 - r)) * (1 + (1 - r) / (c - a))
    root = math.sqrt(1 + (4 if variant == "paper" else r) * (c + 1) * r * (1 - r) / (a * (c - a)))
    middle = (r * c - a) / (2 * r * (1 - r)) * (1 + root)
    high = (r * c - a) / (r * (1 - r)) * (1 + r / a)
    return low, middle, high


def concentration_approximate(r: float, c: float, a: float, variant: str = "paper") -> float:
    """The bound that fits r: for small, middle and large r the lower, middle and upper one; with
    ``variant="source"`` the upper, middle and lower one, parted at half the places."""
    low, middle, high = concentration_bounds(r, c, a, variant)
    if variant == "paper":
        return low if r < a / c else middle if r < 2 * a / math.sqrt(c) else high
    return high if r < a / (2 * c) else middle if r < a / math.sqrt(c) else low


def concentration_along(axis: np.ndarray, s: np.ndarray, c: float, a: float, variant: str = "paper") -> float:
    """The same for a scatter along an axis, whose mean is kept within (0, 1)."""
    eps = np.finfo(float).eps
    return concentration_approximate(min(max(float(axis @ s @ axis), eps), 1 - 5 * eps), c, a, variant)


def watson_statistic(x: np.ndarray) -> np.ndarray:
    """Squares, then products of each later with each earlier component times the root of 2."""
    x = np.atleast_2d(x)
    d = x.shape[1]
    cross = [math.sqrt(2) * x[:, i] * x[:, j] for i in range(d) for j in range(i + 1, d)]
    return np.column_stack([x * x, *cross])


def statistic_dimension(d: int) -> int:
    return d + d * (d - 1) // 2


@dataclass(frozen=True)
class Watson:
    """A Watson distribution given by its mean statistic."""

    mean: np.ndarray
    dim: int = 3

    @property
    def length(self) -> float:
        return float(np.linalg.norm(self.mean))

    @property
    def kappa(self) -> float:
        return concentration(self.dim, min(max(self.length, 1e-6), 1 - 1e-6))

    @property
    def theta(self) -> np.ndarray:
        k = self.kappa
        return self.mean * k / kummer_ratio(0.5, self.dim / 2, k)

    def log_normaliser(self) -> float:
        return log_kummer(0.5, self.dim / 2, self.kappa)

    def dual(self) -> float:
        return float(self.theta @ self.mean) - self.log_normaliser()

    def logpdf(self, x: np.ndarray) -> np.ndarray:
        return watson_statistic(x) @ self.theta - self.log_normaliser()

    def density(self, x: np.ndarray) -> np.ndarray:
        """The density, relative to the uniform one."""
        return np.exp(self.logpdf(x))

    def divergence(self, other: "Watson") -> float:
        """Bregman divergence from this mean statistic to the other's."""
        return self.dual() - other.dual() - float((self.mean - other.mean) @ other.theta)

    def axis(self) -> np.ndarray:
        """The axis, as the leading eigenvector of the matrix that the statistic packs."""
        d, m = self.dim, np.zeros((self.dim, self.dim))
        m[np.diag_indices(d)] = self.mean[:d]
        at = d
        for i in range(d):
            for j in range(i + 1, d):
                m[i, j] = m[j, i] = self.mean[at] / math.sqrt(2)
                at += 1
        return np.linalg.eigh(m)[1][:, -1]


def watson_divergence(axis: np.ndarray, kappa: float, other_axis: np.ndarray, other_kappa: float) -> float:
    """Bregman divergence of two Watsons given by axis and concentration."""
    a, c = 0.5, len(axis) / 2
    one, other = kappa * watson_statistic(axis)[0], other_kappa * watson_statistic(other_axis)[0]
    return log_kummer(a, c, kappa) - log_kummer(a, c, other_kappa) - float((one - other) @ other) / other_kappa * kummer_ratio(a, c, other_kappa)


def scatter(x: np.ndarray) -> np.ndarray:
    """Mean of the outer squares of rows."""
    return x.T @ x / len(x)


def log_likelihood(x: np.ndarray, axis: np.ndarray, kappa: float) -> float:
    """Watson log likelihood of rows from their scatter: n (k u'Su - log M)."""
    return len(x) * (kappa * float(axis @ scatter(x) @ axis) - log_kummer(0.5, x.shape[1] / 2, kappa))


def watson_mle(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Axis and concentration of greatest likelihood: along the largest or the least eigenvector."""
    s = scatter(x)
    values, vectors = np.linalg.eigh(s)
    d, best = x.shape[1], None
    for at in (-1, 0):
        k = concentration(d, float(min(max(values[at], 1e-6), 1 - 1e-6)))
        fit = k * values[at] - log_kummer(0.5, d / 2, k)
        if best is None or fit > best[0]:
            best = fit, vectors[:, at], k
    return best[1], best[2]


def gaussian_dimension(n: int) -> int:
    """Dimension of a Gaussian whose mean and mean square have n numbers together."""
    return round((math.sqrt(1 + 4 * n) - 1) / 2)


def gaussian_parameters(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and mean square (column by column) from one flat array."""
    d = gaussian_dimension(len(flat))
    return flat[:d], flat[d:].reshape(d, d).T


def trace_of_product(a: np.ndarray, b: np.ndarray) -> float:
    """Trace of a b without the product."""
    return float((a * b.T).sum())


@dataclass(frozen=True)
class Gaussian:
    """A Gaussian given by its mean and minus its mean square (mu, H)."""

    mu: np.ndarray
    h: np.ndarray
    constants: str = "exact"

    @classmethod
    def of(cls, x: np.ndarray, constants: str = "exact") -> "Gaussian":
        mu = x.mean(axis=0)
        return cls(mu, -(np.cov(x.T, ddof=1) + np.outer(mu, mu)), constants)

    def covariance(self) -> np.ndarray:
        return -self.h - np.outer(self.mu, self.mu)

    def dual(self) -> float:
        """The dual potential; with ``constants="reference"`` three constants are perturbed."""
        d = len(self.mu)
        one, eps, e = (1.0001, np.finfo(float).eps, 2.71) if self.constants == "reference" else (1.0, 0.0, math.e)
        inner = abs(one + self.mu @ np.linalg.solve(self.h, self.mu))
        return -0.5 * math.log(inner) - 0.5 * math.log(np.linalg.det(-self.h) + eps) - d / 2 * math.log(2 * math.pi * e)

    def logpdf(self, x: np.ndarray) -> np.ndarray:
        """Dual potential plus the first-order terms at the statistic of x: the log density."""
        s = np.linalg.inv(self.covariance())
        first = (x - self.mu) @ (s @ self.mu)
        second = 0.5 * (-np.einsum("ni,ij,nj->n", x, s, x) - np.trace(self.h @ s))
        return self.dual() + first + second


def gaussian_logpdf(names: tuple[str, str, str], mu: list[float], cov: list[list[float]]) -> Column:
    """Log density of three columns under literal parameters."""
    s, det = np.linalg.inv(np.array(cov)), float(np.linalg.det(np.array(cov)))
    d = [F.col(c) - m for c, m in zip(names, mu)]
    form = sum((float(s[i, j]) * d[i] * d[j] for i in range(3) for j in range(3)), F.lit(0.0))
    return -0.5 * (form + math.log(det) + 3 * math.log(2 * math.pi))


def watson_logpdf(names: tuple[str, str, str], axis: list[float], kappa: float) -> Column:
    dot = sum((F.col(c) * a for c, a in zip(names, axis)), F.lit(0.0))
    return kappa * dot * dot - log_kummer(0.5, 1.5, kappa)


def watson_pdf(names: tuple[str, str, str], axis: list[float], kappa: float) -> Column:
    """The density, relative to the uniform one."""
    return F.exp(watson_logpdf(names, axis, kappa))
