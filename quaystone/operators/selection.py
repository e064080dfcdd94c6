"""Small-matrix models of a panel's assets: components, clusters, weights, greedy choice, bootstrap.

Second moments come from Spark sums; what follows works on one matrix of assets by assets (or of one asset's scenarios),
whose size is the number of assets, not of rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def matrix(long: pd.DataFrame, value: str) -> tuple[list[str], np.ndarray]:
    wide = long.pivot(index="a", columns="b", values=value).sort_index(axis=0).sort_index(axis=1)
    return list(wide.index), wide.to_numpy(float)


def per_matrix(long: DataFrame, fn, schema: str) -> DataFrame:
    """fn(pdf) once per group column g of a long matrix (g, a, b, ...)."""
    return long.groupBy("g").applyInPandas(fn, schema)


def moments(rets: DataFrame) -> DataFrame:
    """g, a, b, corr and cov of every two assets, both ways round and with themselves."""
    a, b = rets.select("date", F.col("asset").alias("a"), F.col("ret").alias("x")), rets.select("date", F.col("asset").alias("b"), F.col("ret").alias("y"))
    return a.join(b, "date").groupBy(F.lit("all").alias("g"), "a", "b").agg(F.corr("x", "y").alias("corr"), F.covar_samp("x", "y").alias("cov"))


def components(pdf: pd.DataFrame) -> pd.DataFrame:
    """Loadings of the three largest components of the correlations; the largest loading of each is positive."""
    names, m = matrix(pdf, "corr")
    values, vectors = np.linalg.eigh(m)
    order = np.argsort(values)[::-1][:3]
    v = vectors[:, order]
    v = v * np.sign(v[np.abs(v).argmax(axis=0), range(v.shape[1])])
    return pd.DataFrame([(n, k + 1, v[i, k], values[order[k]]) for i, n in enumerate(names) for k in range(v.shape[1])], columns=["asset", "component", "loading", "eigenvalue"])


def clusters(distance: float = 1.3):
    """Average-linkage clusters under sqrt(2 (1 - corr)), cut at a distance; numbered by their first asset."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, m = matrix(pdf, "corr")
        d = np.sqrt(np.maximum(2 * (1 - m), 0))
        groups = [[i] for i in range(len(names))]
        while len(groups) > 1:
            gap, i, j = min((d[np.ix_(groups[i], groups[j])].mean(), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
            if gap > distance:
                break
            groups[i] += groups.pop(j)
        return pd.DataFrame([(names[i], k + 1) for k, g in enumerate(sorted(groups, key=min)) for i in g], columns=["asset", "cluster"])

    return run


def least_variance(shrink: float = 0.2):
    """Long-only weights of least variance for covariances shrunk to their diagonal, by dropping negative weights in turn."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, m = matrix(pdf, "cov")
        m = (1 - shrink) * m + shrink * np.diag(np.diag(m))
        live = np.ones(len(names), bool)
        while True:
            w = np.zeros(len(names))
            w[live] = np.linalg.solve(m[np.ix_(live, live)], np.ones(live.sum()))
            w /= w.sum()
            if (w[live] >= 0).all():
                return pd.DataFrame({"asset": names, "weight": w})
            live &= w > 0

    return run


def greedy(most: float = 0.8, count: int = 3):
    """Scenarios in order of score, each taken if its correlation with all taken ones is at most a bound. pdf: a, b, corr, score (of a)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        score = pdf.groupby("a")["score"].first().sort_values(ascending=False, kind="stable")
        corr, taken = pdf.set_index(["a", "b"])["corr"], []
        for a in score.index:
            if len(taken) < count and all(corr.get((a, b), 0.0) <= most for b in taken):
                taken.append(a)
        return pd.DataFrame({"g": pdf["g"].iloc[:1].repeat(len(taken)).to_numpy(), "a": taken, "place": range(1, len(taken) + 1)})

    return run
