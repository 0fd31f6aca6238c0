"""Linear least squares over rows: products are summed by one aggregation, the small system is solved on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def least_squares(rows: DataFrame, inputs: list[str], targets: list[str]) -> np.ndarray:
    """Matrix (targets, inputs) with the least squared error of targets; rows with a null among them are left out.

    The products of a row are columns, so they number (inputs + targets) * inputs at most whatever the rows.  Inputs that depend on
    each other linearly get the shortest solution.
    """
    held = rows.select(*(F.col(c).cast("double").alias(c) for c in [*inputs, *targets])).dropna()
    names = [(a, b) for k, a in enumerate(inputs) for b in [*inputs[k:], *targets]]
    got = held.agg(*(F.sum(F.col(a) * F.col(b)).alias(f"p{k}") for k, (a, b) in enumerate(names))).first()
    if got[0] is None:
        raise ValueError("there are no rows to fit")
    total = {pair: got[k] for k, pair in enumerate(names)}
    square = np.array([[total[a, b] if (a, b) in total else total[b, a] for b in inputs] for a in inputs])
    return np.linalg.lstsq(square, np.array([[total[a, t] for t in targets] for a in inputs]), rcond=None)[0].T
