"""Machines that run in blocks against the loops that they stand for."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quaystone.functions import kernels as kn
from quaystone.functions import segments as sg


@pytest.fixture(scope="module")
def frame():
    rng, out = np.random.default_rng(3), []
    for asset, n in (("a", 500), ("b", 37), ("one", 1)):
        x = rng.normal(0, 1.2, n).cumsum() * 0.3 + rng.normal(0, 0.7, n)
        for i in range(n):
            out.append((asset, i, None if rng.random() < 0.1 and i else float(x[i]), float(rng.uniform(0, 0.6)), None if rng.random() < 0.7 else float(rng.integers(-1, 2))))
    return out


@pytest.fixture(scope="module")
def panel(spark, frame):
    return spark.createDataFrame(frame, "asset string, rn int, x double, gap double, event double").repartition(3).cache()


def loop(rows, step, state):
    out = []
    for row in rows:
        state = step(state, *[np.nan if v is None else v for v in row])
        out.append(state[0])
    return out


@pytest.mark.parametrize("block, longest", [("rn", None), ("rn div 7", 7), ("rn div 64", None), ("0", None), ("cast(sqrt(rn) as int)", 64)])
def test_scans_equal_loops(panel, frame, block, longest):
    machines = {"side": sg.hysteresis("x", 0.8, 0.5, "rn = 0"), "held": sg.clamp(F.col("x") - F.col("gap"), F.col("x") + F.col("gap")), "kept": sg.set_or_keep(F.col("event"), 0.0)}
    got = sg.scan(panel, machines, F.expr(block), order=("rn",), longest=longest).toPandas()
    assert len(got) == len(frame)
    for asset, p in pd.DataFrame(frame, columns=["asset", "rn", "x", "gap", "event"]).groupby("asset"):
        mine = got[got["asset"] == asset].sort_values("rn")
        rows = [(None if np.isnan(x) else x, g) for x, g in zip(p["x"], p["gap"])]
        assert loop([r[:1] for r in rows], kn.hysteresis(0.8, 0.5), (0.0, 0.0)) == mine["side"].tolist()
        assert np.allclose(loop(rows, kn.buffered, (0.0,)), mine["held"])
        assert p["event"].ffill().fillna(0).tolist() == mine["kept"].tolist()


def test_tables_compose(spark):
    """A counter modulo three that some rows advance and some set back, from state 1."""
    rng = np.random.default_rng(1)
    step = rng.integers(0, 3, 300)
    df = spark.createDataFrame([("k", i, int(v)) for i, v in enumerate(step)], "asset string, rn int, v int")
    machine = sg.table((10.0, 20.0, 30.0), tuple(f"CASE v WHEN 0 THEN {(i + 1) % 3} WHEN 1 THEN {i} ELSE 0 END" for i in range(3)), first=1)
    got = [r[0] for r in sg.scan(df, {"state": machine}, F.expr("rn div 50"), order=("rn",)).orderBy("rn").select("state").collect()]
    state, want = 1, []
    for v in step:
        state = (state + 1) % 3 if v == 0 else state if v == 1 else 0
        want.append((10.0, 20.0, 30.0)[state])
    assert got == want


def test_rows_are_exchanged_by_key_and_block(panel):
    plan = sg.scan(panel, {"kept": sg.set_or_keep(F.col("event"))}, F.expr("rn div 64"), order=("rn",), longest=64)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "SinglePartition" not in plan and "hashpartitioning(asset" in plan


def test_no_rows(spark, panel):
    assert sg.scan(panel.where("false"), {"kept": sg.set_or_keep(F.col("event"))}, F.expr("rn div 64"), order=("rn",)).count() == 0
