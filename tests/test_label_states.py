"""Season states: sums and differences against numpy, samples against a plain loop, rows that don't count."""

import datetime

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quaystone.operators import label_states as ls


def made(seed=3, n=300):
    rng = np.random.default_rng(seed)
    days = [datetime.date(2019, 1, 1) + datetime.timedelta(int(i)) for i in np.sort(rng.choice(1800, n, replace=False))]
    x = [None if rng.random() < 0.1 else float(v) for v in rng.normal(5, 2, n)]
    return pd.DataFrame({"asset": "a", "date": days, "x": x, "label": rng.integers(-4, 5, n), "year": [d.year for d in days]})


def frame(spark, pdf):
    return spark.createDataFrame(pdf.astype({"x": object}).where(pdf.notna(), None), "asset string, date date, x double, label int, year int")


def near(j, label, labels):
    """Whether a label counts for label j."""
    if not labels.low <= label <= labels.high:
        return False
    size = labels.high - labels.low + 1
    around = range(j - labels.back, j + labels.forward + 1)
    hit = any((label - k) % size == 0 for k in around) if labels.wrap else label in around
    return hit and (not labels.split or (label >= 0) == (j >= 0))


def samples(pdf, labels, shift, years):
    for r in pdf.itertuples():
        if labels.low <= r.label <= labels.high:
            seen = pdf[(pdf["date"] <= r.date) & (pdf["year"] <= r.year - shift) & (pdf["year"] >= r.year - (years or 99))]
            seen = seen[[near(r.label, k, labels) for k in seen["label"]]] if len(seen) else seen
            yield r.date, seen["x"].dropna().astype(float)


def test_samples_are_those_of_a_loop(spark):
    pdf = made()
    for labels, shift, years in [(ls.Labels(-4, 4), 0, None), (ls.Labels(-4, 4, split=True), 0, 2), (ls.Labels(-3, 3, back=2, forward=0), 1, None), (ls.Labels(-4, 4, wrap=False), 1, 2), (ls.Labels(0, 1, back=3, forward=3), 0, 1)]:
        got = ls.running(frame(spark, pdf), "x", "label", "year", labels, shift, years).select("date", "st.*", ls.deviation().alias("sd")).toPandas().set_index("date")
        want = dict(samples(pdf, labels, shift, years))
        assert set(got.index) == set(want)
        for d, x in want.items():
            assert got.loc[d, "n"] == len(x)
            if len(x) > 1:
                assert np.isclose(got.loc[d, "mean"], x.mean()) and np.isclose(got.loc[d, "sd"], x.std(), atol=1e-9)


def test_states_add_up_and_can_be_taken_back(spark):
    parts = [[1.0, 2.0, 4.0], [10.0], [], [3.0, 3.0]]
    rows = [(i, j, parts[i] + parts[j], parts[i], parts[j]) for i in range(4) for j in range(4)]
    df = spark.createDataFrame(rows, "i int, j int, w array<double>, a array<double>, b array<double>")
    for c in "wab":
        df = df.join(df.select("i", "j", F.explode_outer(c).alias("v")).groupBy("i", "j").agg(ls.state("v").alias(f"s{c}")), ["i", "j"])
    got = df.select(ls.plus("sa", "sb").alias("p"), ls.minus("sw", "sb").alias("m"), "sw", "sa").collect()
    for r in got:
        assert np.allclose(tuple(r["p"]), tuple(r["sw"])) and np.allclose(tuple(r["m"]), tuple(r["sa"]))


def test_resumed_states_are_those_of_all_rows(spark):
    df, labels = frame(spark, made()), ls.Labels(-4, 4)
    cut = F.lit("2021-03-01").cast("date")
    want = {r["label"]: r["st"] for r in ls.closing(df, "x", "label", labels).collect()}
    got = {r["label"]: r["st"] for r in ls.resumed(ls.closing(df.where(F.col("date") <= cut), "x", "label", labels), ls.closing(df.where(F.col("date") > cut), "x", "label", labels)).collect()}
    assert set(got) == set(want) and all(np.allclose(tuple(got[k]), tuple(want[k])) for k in want)
    alone = ls.resumed(ls.closing(df, "x", "label", labels), ls.closing(df.where("false"), "x", "label", labels))
    assert {r["label"]: tuple(r["st"]) for r in alone.collect()} == {k: tuple(v) for k, v in want.items()}


def test_no_rows_give_none(spark):
    df = frame(spark, made()).where("false")
    assert ls.scored(ls.running(df, "x", "label", "year", ls.Labels(-4, 4), years=1)).count() == 0
