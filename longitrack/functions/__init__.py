"""Scalar expressions shared by the operators; all but c_log stay inside generated code."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Fixed values of the data model.
INADMISSIBLE = 1e6
EPSILON = 1e-6


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def ratio(a: Column, b: Column, empty: float | None) -> Column:
    """a / b, or `empty` where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(empty).cast("double"))


def f1(tp: Column, fp: Column, fn: Column, empty: float | None) -> Column:
    return ratio(2.0 * tp, 2.0 * tp + fp + fn, empty)


@F.pandas_udf(DoubleType())
def c_log(x: pd.Series) -> pd.Series:
    """ln as the C library rounds it, and SQL engines with it; Spark's own differs in the last bit, which tells ties apart."""
    some = x.to_numpy(float, na_value=np.nan)
    values, at = np.unique(some, return_inverse=True)
    return pd.Series(np.array([math.log(v) if v > 0 else np.nan for v in values])[at]).where(x.notna().to_numpy() & (some > 0), None)


def overlap_cost(similarity: Column, epsilon: float = EPSILON, log: Callable[[Column], Column] = F.log) -> Column:
    """-ln of a similarity clipped away from 0."""
    return -log(clip(similarity, epsilon, 1.0))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def logit(p: Column, epsilon: float = EPSILON) -> Column:
    q = clip(p, epsilon, 1.0 - epsilon)
    return F.log(q / (1.0 - q))


def admissible(cost: Column) -> Column:
    return cost.isNotNull() & ~F.isnan(cost) & (cost < INADMISSIBLE)
