"""Registered queries of stored signal definitions, run in one pass over the panel (operators/definitions.py)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaystone.functions.recipe import tidy
from quaystone.operators.definitions import TABLE, Stored, run_stored
from quaystone.operators.signals import Definition
from quaystone.plans.roll_queries import PAIR_SQL, pair_panel
from quaystone.plans.signal_queries import BY_PART, INDEXED_SQL, PAIRED, definitions_sql, indexed, kept

FEATURES = {"px": "close", "lpx": "ln(close)", "vol": "volume", "span": "high - low", "gap": "ln(close / open)"}
CHAINS = ("ema5", "sma3|hmp0.3", "hys_0.5_0.25", "pos", "neg|sgn", "acl2", "arr2", "buf0.1", "bfc0.3", "ema2|buf0.2")


def library() -> list[Stored]:
    """A store of definitions: every method and step, each with several features and windows."""
    d = {}
    for f, x in FEATURES.items():
        for method in ("ma_dff", "ema_dff_sgn", "zscore", "hlratio", "qtl", "kdj"):
            for length, windows in {"st": (10, 20, 5), "mt": (40, 60, 10)}.items():
                d[f"{f}_{method}_{length}"] = Stored("", Definition(x, method, windows, freq=""))
    for f in ("px", "vol", "gap"):
        for how in ("demean", "score", "rank"):
            for after in ("buf0.2", "bfc0.5"):
                d[f"{f}_zs_x{how}_{after[:3]}"] = Stored("", Definition(FEATURES[f], "zscore", (20, 40, 10), "ema3", "", after=after), across=how)
    for n in (20, 60, 120):
        for change in ("diff", "pct_change"):
            d[f"px_mom{n}_{change}"] = Stored("", Definition("close", "ema", (1, 2, 1), f"df{n}", change, after="ema1", vol=60))
    for i, after in enumerate(CHAINS):
        d[f"px_chain{i}"] = Stored("", Definition("close", "ewmac", (3, 9, 3), after=after, vol=40))
    for day in ("MON", "TUE", "WED", "THU", "FRI"):
        d[f"px_week_{day.lower()}"] = Stored("", Definition("close", "emad", (4, 8, 2), freq=f"W-{day}", vol=52))
    for kind in ("cal_yoy", "lunar_yoy", "yoy"):
        for group in ("_day", "_wk"):
            d[f"px_{kind}{group}"] = Stored("", Definition("close", "ema_sgn", (5, 15, 5), f"{kind}{group}|ema3", "diff"))
    for method, grid, days in (("seasonal_score_w", "W-FRI", 14), ("seasonal_score_d", "price", 15)):
        for f in ("px", "vol"):
            d[f"{f}_{method}"] = Stored("", Definition(FEATURES[f], method, (days, days, 3), freq=grid))
    d["px_thrust"] = Stored("", Definition("close", "dbl_th", (0.6, 40), "", "pct_score", freq=""))
    d["px_range"] = Stored("", Definition("close", "rng", (1000.0, 500.0, 500.0), freq=""))
    d["px_hys"] = Stored("", Definition("close", "hysteresis", (0.5, 60, 0.5), "", "hlratio", False, ""))
    d["px_resid"] = Stored("", Definition("close", "zscore", (20, 40, 10, 120), "beta_resid", "pct_change", freq="", index="idx"))
    d["px_csum"] = Stored("", Definition("close / 1000", "", (), "df1|csum|sum5|lr", "pct_change"))
    own = Definition("close", "zscore", (20, 40, 10), "ema3", "", after="ema2")
    d["joint_all"] = Stored("", own, "shared", ("Brand#1", "Brand#2", "Brand#3", "Brand#4"))
    d["joint_pair"] = Stored("", own, "pair", ("Brand#5", "Brand#6"))
    d["joint_neutral"] = Stored("", own, "neutral", ("Brand#7", "Brand#8", "Brand#9"))
    d["some_assets"] = Stored("", own, "own", ("Brand#10", "Brand#11"))
    return [Stored(name, s.definition, s.kind, s.assets, s.across) for name, s in d.items()]


def table_of(sp, stored: list[Stored]):
    """The definitions as rows of a stored table."""
    return kept(sp, sp.createDataFrame([s.row() for s in stored], TABLE), "definitions")


def result(out):
    return out.select("signal", "asset", "date", tidy(out, "value"))


def parts(which, panel):
    stored = [Stored(n, d) for n, d in which.items()]
    return lambda sp, sf: result(run_stored(panel(sp, sf), table_of(sp, stored)))


def store(sp, sf):
    """All definitions of library() over all assets: of each the assets, days and values, and the mean of its sign."""
    out = run_stored(kept(sp, indexed(sp, sf), "panel"), table_of(sp, library()))
    return out.groupBy("signal").agg(F.count_distinct("asset").alias("assets"), F.count("*").alias("days"), F.count("value").alias("n_values"), F.round(F.avg(F.signum("value")), 6).alias("tilt"))


QUERIES = {"sig_store": store, "sig_pair_definitions": parts(PAIRED, pair_panel)} | {f"sig_definitions_{p}": parts(d, indexed) for p, d in BY_PART.items()}
SQL = {"sig_pair_definitions": definitions_sql(PAIRED, PAIR_SQL)} | {f"sig_definitions_{p}": definitions_sql(d, INDEXED_SQL) for p, d in BY_PART.items()}
