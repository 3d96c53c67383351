"""Posterior arithmetic on columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(z: Column) -> Column:
    """Logistic function that doesn't overflow on either side."""
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def log_odds(p: float) -> float:
    return math.log(p / (1 - p))


def calibrated(z: Column, *, temperature: float, train_prior: float, target_prior: float) -> Column:
    """Posterior after temperature and prior shift."""
    return sigmoid(z / temperature + F.lit(log_odds(target_prior) - log_odds(train_prior)))


def prevalence_lambda(ratio: Column, positives: Column, negatives: Column) -> Column:
    """Weight of a false hit so that decoys stand at ``ratio`` to one."""
    return F.try_divide(ratio * positives, negatives)


def reweighted_precision(tp: Column, fp: Column, lam: Column) -> Column:
    return F.try_divide(tp, tp + lam * fp)
