"""Scalar functions of the contact-matrix model."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def bin_of(pos: Column, size: int) -> Column:
    """X01."""
    return F.floor(pos / size).cast("int")


def block_number(bin_x: Column, bin_y: Column, intra: Column, columns: int, block_bins: int, base: float = 2.0) -> Column:
    """The tile of a cell; within a chromosome by depth from the diagonal and by place along it."""
    depth = F.floor(F.log(base, 1 + F.abs(bin_x - bin_y) / math.sqrt(2) / block_bins))
    along = F.floor(F.floor((bin_x + bin_y) / 2) / block_bins)
    plain = F.floor(bin_y / block_bins) * columns + F.floor(bin_x / block_bins)
    return F.when(intra, depth * columns + along).otherwise(plain).cast("long")


def lambda_bin(expected: Column, width: int = 40) -> Column:
    """The bin of an expected value, a third of a doubling wide."""
    step = math.log(2**0.33)
    return F.when(expected <= 1, F.lit(0)).otherwise(F.least(F.floor(F.log(expected) / step), F.lit(width - 1))).cast("int")


def poisson_z(observed: Column, expected: Column) -> Column:
    """X07."""
    return 2 * (F.sqrt(observed) - F.sqrt(expected))


def poisson_p(observed: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """P(X >= observed) of Poisson variables of any mean: the regularized incomplete gamma function, by its series or its continued fraction.

    Each value takes as many terms as it needs, a few times the root of its count at most; those that have settled take no part any more.
    """
    a, x = (np.array(v, float) for v in np.broadcast_arrays(observed, mean))
    a, x = np.atleast_1d(a), np.atleast_1d(x)
    p = np.where(a <= 0, 1.0, 0.0)
    told = (a > 0) & (x > 0) & np.isfinite(x)
    p[np.isnan(x) | np.isnan(a)] = np.nan
    p[(a > 0) & np.isposinf(x)] = 1.0
    front = np.zeros(len(a))
    front[told] = np.exp(a[told] * np.log(x[told]) - x[told] - np.array([math.lgamma(v) for v in a[told]]))
    at = np.flatnonzero(told & (x < a + 1))
    term = 1 / a[at]
    total, k = term.copy(), 0
    while len(at):
        k += 1
        term = term * x[at] / (a[at] + k)
        total = total + term
        p[at] = front[at] * total
        on = term > total * 1e-16
        at, term, total = at[on], term[on], total[on]
    at = np.flatnonzero(told & (x >= a + 1))
    tiny = 1e-300
    b = x[at] + 1 - a[at]
    c = np.full(len(at), 1 / tiny)
    d = 1 / np.where(np.abs(b) < tiny, tiny, b)
    h, k = d.copy(), 0
    while len(at):
        k += 1
        step, b = -k * (k - a[at]), b + 2
        d = step * d + b
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        c = b + step / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        h = h * d * c
        p[at] = 1 - front[at] * h
        on = np.abs(d * c - 1) > 1e-15
        at, b, c, d, h = at[on], b[on], c[on], d[on], h[on]
    return np.clip(p, 0.0, 1.0)


def poisson_upper(observed: Column | str, mean: Column | str) -> Column:
    """P(X >= observed), by poisson_p() in whole batches."""

    @F.pandas_udf("double")
    def tail(o: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series(poisson_p(o.to_numpy(float), m.to_numpy(float)))

    return tail(observed, mean)


def poisson_tail(mu: float, n: int) -> list[float]:
    """P(X >= k) for k below n."""
    return poisson_p(np.arange(n), np.full(n, float(mu))).tolist()


def clean_chromosome(name: Column) -> Column:
    """Upper case without a leading chr; MT for M."""
    bare = F.regexp_replace(F.upper(name), "^CHR", "")
    return F.when(bare == "M", "MT").otherwise(bare)


def commify(n: Column) -> Column:
    """X15."""
    return F.format_number(n.cast("long"), 0)


def library_sizes(unique: np.ndarray, duplicates: np.ndarray) -> np.ndarray:
    """Distinct molecules from reads, by c/x - 1 + exp(-n/x) = 0, found by halving; 0 where there are no unique reads or no duplicates."""
    c, n = np.array(unique, float), np.array(unique, float) + np.array(duplicates, float)
    told = (c > 0) & (n > c)
    low, high = np.where(told, c, 1.0), np.where(told, c * 10, 1.0)
    above = lambda x: told & (c / x - 1 + np.exp(-n / x) > 0)
    while (far := above(high)).any():
        high = np.where(far, high * 10, high)
    while (high - low > 1e-12 * high).any():
        middle = (low + high) / 2
        up = above(middle)
        low, high = np.where(up, middle, low), np.where(up, high, middle)
    return np.where(told, (low + high) / 2, 0.0)


def library_size(unique: float, duplicates: float) -> float:
    """A23, of one library."""
    return float(library_sizes(np.array([unique]), np.array([duplicates]))[0])


def library_size_of(unique: Column | str, duplicates: Column | str) -> Column:
    """A23, of a library a row, in whole batches."""

    @F.pandas_udf("double")
    def size(u: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(library_sizes(u.to_numpy(float), d.to_numpy(float)))

    return size(unique, duplicates)


def is_debris(name: Column) -> Column:
    """Whether a scaffold's name marks it as debris."""
    return name.rlike(r":::debris\b|:::debris$")


def original_name(name: Column) -> Column:
    """A scaffold's name without its fragment and debris marks."""
    return F.regexp_replace(name, r":::.*$", "")
