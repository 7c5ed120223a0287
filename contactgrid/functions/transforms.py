"""Cell transforms of one and of two maps (the matrix types), as column expressions.

o, c are the observed and control counts, e, ec the expected ones, a, ac the average counts, e0, ec0 the expected ones
at distance 0. A result that is no number is null.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

P = 1.0


def _cols(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def _by(x: Column, y: Column) -> Column:
    return F.try_divide(x, y)


def _log_eo(x: Column, y: Column) -> Column:
    return _by(F.log(x + 1), F.log(y + 1))


def transforms() -> dict[str, Column]:
    """By name, the value in the upper triangle, or everywhere."""
    o, c, e, ec, a, ac, e0, ec0 = _cols("o", "c", "e", "ec", "a", "ac", "e0", "ec0")
    return {
        "observed": o, "control": c, "log": F.log(1 + o), "logc": F.log(1 + c), "expected": e, "oe": _by(o, e), "oectrl": _by(c, ec),
        "oep1": _by(o + P, e + P), "oectrlp1": _by(c + P, ec + P), "ome": o - e, "cme": c - ec, "logeo": _log_eo(o, e), "logceo": _log_eo(c, ec),
        "explogeo": F.exp(_log_eo(o, e)), "explogceo": F.exp(_log_eo(c, ec)), "ratio": _by(_by(o, a), _by(c, ac)),
        "ratiop1": _by(_by(o + P, a + P), _by(c + P, ac + P)), "ratio0": _by(_by(o, e0), _by(c, ec0)), "ratio0p1": _by(_by(o + P, e0 + P), _by(c + P, ec0 + P)),
        "logratio": _by(F.log(_by(o, a) + 1), F.log(_by(c, ac) + 1)), "logeoratio": _by(_log_eo(o, e), _log_eo(c, ec)), "oeratio": _by(_by(o, e), _by(c, ec)),
        "oeratiop1": _by(_by(o + P, e + P), _by(c + P, ec + P)), "oeratiominus": _by(o, e) - _by(c, ec), "oeratiominusp1": _by(o + P, e + P) - _by(c + P, ec + P),
        "diff": (_by(o, a) - _by(c, ac)) * (a + ac) / 2,
    }


def split_transforms() -> dict[str, tuple[Column, Column]]:
    """By name, the values above and below the diagonal."""
    o, c, e, ec, a, ac = _cols("o", "c", "e", "ec", "a", "ac")
    mean = (a + ac) / 2
    up, down = _by(o, a) * mean, _by(c, ac) * mean
    return {
        "vs": (up, down), "logvs": (F.log(1 + up), F.log(1 + down)), "oevs": (_by(o, e), _by(c, ec)), "oevsp1": (_by(o + P, e + P), _by(c + P, ec + P)),
        "ocmevs": (o - e, c - ec), "logeovs": (_log_eo(o, e), _log_eo(c, ec)),
    }


def exp_log_digits(count: Column, expected: Column) -> Column:
    """"explogeo" to nine digits, by the C library's logarithms and exponentials, which are those of the SQL.

    Java's differ from them in the last bits, and what the quotient of logarithms loses its exponential makes a thousand times as much: enough to round another way. Values
    are few, as counts and distances are, so each of a batch is found once.
    """

    @F.pandas_udf("double")
    def digits(c: pd.Series, e: pd.Series) -> pd.Series:
        pairs, at = np.unique(np.c_[c.to_numpy(float), e.to_numpy(float)], axis=0, return_inverse=True)
        return pd.Series([_exp_log(x, y) for x, y in pairs.tolist()], dtype="object")[at.ravel()].reset_index(drop=True)

    return digits(count.cast("double"), expected.cast("double"))


def _exp_log(x: float, y: float) -> float | None:
    if not (x > -1 and y > -1) or not (below := math.log(y + 1)):  # nan too
        return None
    try:
        return float(f"{math.exp(math.log(x + 1) / below):.8e}")
    except OverflowError:
        return math.inf


def norm_squared(v1: Column, v2: Column, dist: Column) -> Column:
    """X20."""
    return _by(F.lit(1.0), v1 * v2 * F.pow(F.greatest(dist, F.lit(1)).cast("double"), F.lit(4.0)))
