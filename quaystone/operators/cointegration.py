"""Unit roots and cointegration from second moments: no history is ever one group.

A panel has g, asset, seq (a long that counts steps: days, weeks) and x, one row per asset and step. Lags are those of the
steps before, so a row takes part where the asset has the two former steps as well. Each asset (or pair of assets of a g)
then costs one aggregate with partial sums before the shuffle; the regressions are closed forms of its moments.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Response surfaces (limit, 1/n, 1/n^2, 1/n^3) of the Dickey-Fuller statistic with a constant at 1, 5 and 10 per cent, for one series and for the residual of two.
SURFACES = {
    1: {"cv_1": (-3.43035, -6.5393, -16.786, -79.433), "cv_5": (-2.86154, -2.8903, -4.234, -40.040), "cv_10": (-2.56677, -1.5384, -2.809, 0.0)},
    2: {"cv_1": (-3.89644, -10.9519, -33.527, 0.0), "cv_5": (-3.33613, -6.1101, -6.823, 0.0), "cv_10": (-3.04445, -4.2412, -2.720, 0.0)},
}

#: 90, 95 and 99 per cent points of the trace and the largest-root statistic with a constant, by the number of series less the rank.
TRACE = (
    (2.7055, 3.8415, 6.6349), (13.4294, 15.4943, 19.9349), (27.0669, 29.7961, 35.4628), (44.4929, 47.8545, 54.6815), (65.8202, 69.8189, 77.8202), (91.1090, 95.7542, 104.9637),
    (120.3673, 125.6185, 135.9825), (153.6341, 159.5290, 171.0905), (190.8714, 197.3772, 210.0366), (232.1030, 239.2468, 253.2526), (277.3740, 285.1402, 300.2821), (326.5354, 334.9795, 351.2150),
)
LARGEST = (
    (2.7055, 3.8415, 6.6349), (12.2971, 14.2639, 18.5200), (18.8928, 21.1314, 25.8650), (25.1236, 27.5858, 32.7172), (31.2379, 33.8777, 39.3693), (37.2786, 40.0763, 45.8662),
    (43.2947, 46.2299, 52.3069), (49.2855, 52.3622, 58.6634), (55.2412, 58.4332, 64.9960), (61.2041, 64.5040, 71.2525), (67.1307, 70.5392, 77.4877), (73.0563, 76.5734, 83.7105),
)


def lagged(panel: DataFrame) -> DataFrame:
    """d, l and p of each row: the change from the step before, the level there, and the change before that; null where a step is missing."""
    w = Window.partitionBy("g", "asset").orderBy("seq")
    one, two = (F.first("x").over(w.rangeBetween(-k, -k)) for k in (1, 2))
    return panel.withColumns({"l": one, "l2": two}).select("g", "asset", "seq", "x", (F.col("x") - F.col("l")).alias("d"), "l", (F.col("l") - F.col("l2")).alias("p"))


def critical(series: int, n: str = "n") -> dict[str, Column]:
    """Critical values of the statistic for so many rows."""
    return {k: F.lit(a) + b / F.col(n) + c / F.col(n) ** 2 + d / F.col(n) ** 3 for k, (a, b, c, d) in SURFACES[series].items()}


def statistic(ll: Column, lp: Column, pp: Column, ld: Column, pd: Column, dd: Column, n: Column) -> Column:
    """t of the level in the regression of changes on a constant, the level and the change before, from mean products of deviations."""
    det = ll * pp - lp * lp
    level, lag = (ld * pp - pd * lp) / det, (pd * ll - ld * lp) / det
    left = dd - level * ld - lag * pd
    t = level / F.sqrt(left / (n - 3) * pp / det)
    return F.when((n > 4) & (det > 1e-12 * ll * pp) & (left > 1e-12 * dd), t)


def unit_roots(panel: DataFrame) -> DataFrame:
    """Dickey-Fuller statistic of every asset with a constant and one lag, critical values, and whether it is stationary at 1 per cent; null where the regression has no rest or too few rows."""
    rows = lagged(panel).where("p IS NOT NULL AND d IS NOT NULL")
    m = rows.groupBy("g", "asset").agg(F.count("*").alias("n"), *[F.covar_pop(a, b).alias(a + b) for a, b in combinations_with_replacement("dlp", 2)])
    c = F.col
    m = m.withColumn("adf", statistic(c("ll"), c("lp"), c("pp"), c("dl"), c("dp"), c("dd"), c("n"))).withColumns(critical(1))
    return m.select("g", "asset", "n", "adf", *SURFACES[1], (c("adf") < c("cv_1")).alias("stationary"))


NAMES = ("da", "db", "la", "lb", "pa", "pb")


def pair_moments(panel: DataFrame) -> DataFrame:
    """Per pair of a g's assets (a before b): rows n with all lags of both, the covariances of both sides' d, l and p over them, and those of the levels xa, xb over all common steps.

    A step of k assets makes k(k-1)/2 rows before the partial sums: a pair's sums need each of its rows once.
    """
    rows = lagged(panel)
    side = lambda s: rows.select("g", "seq", F.col("asset").alias(s), *[F.col(v).alias(v + s) for v in "xdlp"])
    both = side("a").join(side("b"), ["g", "seq"]).where("a < b")
    whole = F.col("da").isNotNull() & F.col("pa").isNotNull() & F.col("db").isNotNull() & F.col("pb").isNotNull()
    seen = both.withColumns({v: F.when(whole, F.col(v)) for v in NAMES})
    covs = [F.covar_pop(u, v).alias(f"{u}_{v}") for u, v in combinations_with_replacement(NAMES, 2)]
    levels = [F.covar_pop(u, v).alias(f"{u}_{v}") for u, v in (("xa", "xa"), ("xa", "xb"), ("xb", "xb"))]
    return seen.groupBy("g", "a", "b").agg(F.count("da").alias("n"), F.count("*").alias("common"), *covs, *levels)


def _m(u: str, v: str) -> Column:
    return F.col(f"{u}_{v}" if NAMES.index(u) <= NAMES.index(v) else f"{v}_{u}")


def engle_granger(moments: DataFrame) -> DataFrame:
    """Both ways round (dep on indep): slope of the levels, Dickey-Fuller statistic of the residual and its critical values, from one pass over the moments."""
    sums = moments
    for y, x in (("a", "b"), ("b", "a")):
        beta = f"beta_{y}"
        sums = sums.withColumn(beta, F.col("xa_xb") / F.nullif(F.col(f"x{x}_x{x}"), F.lit(0.0)))

        def of(u, v):
            b = F.col(beta)  # noqa: B023
            return _m(u + y, v + y) - b * (_m(u + y, v + x) + _m(u + x, v + y)) + b * b * _m(u + x, v + x)  # noqa: B023

        sums = sums.withColumns({f"{u}{v}_{y}": of(u, v) for u, v in combinations_with_replacement("dlp", 2)})
        rest = {k: F.col(f"{k}_{y}") for k in ("ll", "lp", "pp", "dl", "dp", "dd")}
        sums = sums.withColumn(f"t_{y}", statistic(rest["ll"], rest["lp"], rest["pp"], rest["dl"], rest["dp"], rest["dd"], F.col("n")))
    ways = [F.struct(F.col(y).alias("dep"), F.col(x).alias("indep"), F.col(f"beta_{y}").alias("beta"), F.col(f"t_{y}").alias("adf")) for y, x in (("a", "b"), ("b", "a"))]
    out = sums.select("g", "n", "common", F.explode(F.array(*ways)).alias("w")).select("g", "w.*", "n", "common").withColumns(critical(2))
    return out.withColumn("cointegrated", F.col("adf") < F.col("cv_5"))


def johansen_pairs(moments: DataFrame) -> DataFrame:
    """Trace and largest-root statistics of ranks 0 and 1 for every pair with one lag and a constant, with their 95 per cent points and the rank these give.

    Differences and levels are freed of both lagged differences by their partial covariances; the two squared canonical
    correlations are the roots of a quadratic.
    """
    det = _m("pa", "pa") * _m("pb", "pb") - _m("pa", "pb") ** 2

    def free(u, v):
        ua, ub, va, vb = _m(u, "pa"), _m(u, "pb"), _m(v, "pa"), _m(v, "pb")
        return _m(u, v) - (ua * va * _m("pb", "pb") - (ua * vb + ub * va) * _m("pa", "pb") + ub * vb * _m("pa", "pa")) / F.nullif(det, F.lit(0.0))

    keep = [("da", "da"), ("da", "db"), ("db", "db"), ("la", "la"), ("la", "lb"), ("lb", "lb"), ("da", "la"), ("da", "lb"), ("db", "la"), ("db", "lb")]
    s = moments.select("g", "a", "b", "n", *[free(u, v).alias(u + v) for u, v in keep])
    c = F.col
    s = s.withColumns({"d0": c("dada") * c("dbdb") - c("dadb") ** 2, "d1": c("lala") * c("lblb") - c("lalb") ** 2, "dx": c("dala") * c("dblb") - c("dalb") * c("dbla")})

    def q(i, j):  # levels against differences, through the adjugate of the differences' matrix
        a = lambda v: c("da" + v)
        b = lambda v: c("db" + v)
        return a(i) * a(j) * c("dbdb") - (a(i) * b(j) + b(i) * a(j)) * c("dadb") + b(i) * b(j) * c("dada")

    both = F.nullif(c("d0") * c("d1"), F.lit(0.0))
    s = s.withColumns({"sum": (c("lblb") * q("la", "la") - 2 * c("lalb") * q("la", "lb") + c("lala") * q("lb", "lb")) / both, "product": c("dx") ** 2 / both})
    spread = F.sqrt(F.greatest(c("sum") ** 2 / 4 - c("product"), F.lit(0.0)))
    s = s.withColumns({"first": F.least(c("sum") / 2 + spread, F.lit(1 - 1e-12)), "second": F.greatest(c("sum") / 2 - spread, F.lit(0.0))}).where("n > 8 AND sum IS NOT NULL")
    gain = lambda r: -c("n") * F.log1p(-c(r))
    s = s.withColumns({"trace_0": gain("first") + gain("second"), "trace_1": gain("second"), "largest_0": gain("first")})
    rank = F.when(c("trace_0") <= TRACE[1][1], 0).when(c("trace_1") <= TRACE[0][1], 1).otherwise(2)
    return s.select("g", "a", "b", "n", "trace_0", "trace_1", "largest_0", F.lit(TRACE[1][1]).alias("trace_0_95"), F.lit(TRACE[0][1]).alias("trace_1_95"), F.lit(LARGEST[1][1]).alias("largest_0_95"), rank.alias("rank"))


def with_points(ranks: DataFrame) -> DataFrame:
    """Statistics of groups of series (g, rank, trace, largest) with their 90, 95 and 99 per cent points, for up to twelve series of a group."""
    left = F.count("*").over(Window.partitionBy("g")).cast("int") - F.col("rank")
    table = lambda rows, k: F.element_at(F.lit([r[k] for r in rows]), F.when(left <= len(rows), left))
    return ranks.withColumns({f"{name}_{p}": table(rows, k) for name, rows in (("trace", TRACE), ("largest", LARGEST)) for k, p in enumerate((90, 95, 99))})
