"""Logistic regressions of all segments at once, by Newton steps from grouped sums.

A step is one aggregation: gradient, Hessian and log-likelihood are sums of each segment, made before the shuffle, so that a segment with
most of the rows is no hot key. Only one small system a segment is solved in Python; only the largest step comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from adjudica.functions.measures import logistic
from adjudica.operators.components import stored


def fit_logistic_by(rows: DataFrame, segment: str, features: list[str], label: str, ridge: float = 0.1, tolerance: float = 1e-9, most_steps: int = 60) -> DataFrame:
    """(segment, n, intercept, coefficients): the regression of each segment with the penalty ``ridge`` / 2 * sum of squared coefficients (the
    intercept is free). Null features are 0; rows without segment or label count for nothing.

    A Newton step that makes the likelihood worse is halved. A segment whose labels are all alike gets as far as ``most_steps`` steps take it.
    """
    size = len(features) + 1
    x = [F.lit(1.0), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]]
    own = rows.where(F.col(segment).isNotNull() & F.col(label).isNotNull()).select(F.col(segment).alias("segment"), F.col(label).cast("double").alias("y"), *[v.alias(f"x{k}") for k, v in enumerate(x)])
    kind = own.schema["segment"].dataType.simpleString()
    own = stored(own, "fit-rows")
    at, upper = [F.col(f"x{k}") for k in range(size)], [(i, j) for i in range(size) for j in range(i, size)]
    state = f"segment {kind}, n long, beta array<double>, base array<double>, step array<double>, best double, moved double"
    zeros = F.array(*[F.lit(0.0)] * size)
    now = own.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).select("segment", "n", zeros.alias("beta"), zeros.alias("base"), zeros.alias("step"), F.lit(float("-inf")).alias("best"), F.lit(1.0).alias("moved"))

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples():
                beta, base, step = (np.asarray(v, float) for v in (r.beta, r.base, r.step))
                free = np.r_[0.0, np.full(size - 1, ridge)]
                value = r.likelihood - (free * beta**2).sum() / 2
                if value < r.best - 1e-12 * abs(r.best):
                    step = step / 2
                    out.append((r.segment, r.n, (base + step).tolist(), base.tolist(), step.tolist(), r.best, float(np.abs(step).max())))
                    continue
                hessian = np.zeros((size, size))
                for (i, j), v in zip(upper, r.hessian):
                    hessian[i, j] = hessian[j, i] = v
                hessian += np.diag(free) + 1e-12 * np.eye(size)
                step = np.linalg.lstsq(hessian, np.asarray(r.gradient, float) - free * beta, rcond=None)[0]
                out.append((r.segment, r.n, (beta + step).tolist(), beta.tolist(), step.tolist(), value, float(np.abs(step).max())))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in state.split(", ")])

    for _ in range(most_steps):
        now = stored(now, "fit-state")
        if (now.agg(F.max("moved")).first()[0] or 0.0) < tolerance:
            break
        z = sum((F.element_at("beta", k + 1) * at[k] for k in range(1, size)), F.element_at("beta", 1))
        p = logistic(F.col("z"))
        told = own.join(now.select("segment", "beta"), "segment").withColumn("z", z).withColumn("p", p)
        sums = told.groupBy("segment").agg(
            F.array(*[F.sum((F.col("y") - F.col("p")) * v) for v in at]).alias("gradient"), F.array(*[F.sum(F.col("p") * (1 - F.col("p")) * at[i] * at[j]) for i, j in upper]).alias("hessian"),
            F.sum(F.col("y") * F.col("z") - F.greatest("z", F.lit(0.0)) - F.log1p(F.exp(-F.abs("z")))).alias("likelihood"),
        )
        now = now.join(sums, "segment").mapInPandas(solve, state)
    return now.select(F.col("segment").alias(segment), "n", F.element_at("beta", 1).alias("intercept"), F.slice("beta", 2, size - 1).alias("coefficients"))
