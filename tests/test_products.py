"""Dated products, expiries and code changes against plain Python."""

import datetime

from pyspark.sql import functions as F

from quaystone.operators import market as mk
from quaystone.operators import products as pr

D = datetime.date


def test_expiries_are_those_of_a_walk_over_days(spark):
    holidays = ("2024-03-15", "2024-05-10", "2024-01-31", "2024-06-03")
    cal = mk.calendar(spark.createDataFrame([(D(2023, 12, 1), D(2024, 12, 31))], "first date, last date"), holidays)
    names = [("sc", "INE"), ("lh", "DCE"), ("IF", "CFFEX"), ("T", "CFFEX"), ("ZC", "CZCE"), ("m", "DCE"), ("rb", "SHFE"), ("pb", "LME"), ("x", "none"), ("y", None)]
    contracts = spark.createDataFrame([(p, e, D(2024, m, 1)) for p, e in names for m in range(1, 13)], "product string, exch string, month date")
    got = {(r["product"], r["month"]): r["expiry"] for r in pr.expiries(contracts, cal).collect()}
    assert len(got) == 120
    one = datetime.timedelta(1)
    open_ = lambda d: d.weekday() < 5 and str(d) not in holidays

    def step(d, n):
        """n business days after d, or before it."""
        while n:
            d += one if n > 0 else -one
            n -= (1 if n > 0 else -1) if open_(d) else 0
        return d

    for m in range(1, 13):
        first, after = D(2024, m, 1), D(2024 + m // 12, m % 12 + 1, 1)
        fridays = [first + i * one for i in range(28) if (first + i * one).weekday() == 4]
        want = {"sc": step(first, -1), "lh": step(after, -4), "IF": step(fridays[2] - one, 1), "T": step(fridays[1] - one, 1), "ZC": step(first - one, 5), "m": step(first - one, 10), "rb": step(D(2024, m, 14), 1), "pb": step(after, -1), "x": None, "y": None}
        for p, day in want.items():
            assert got[(p, first)] == day, (p, first)


def test_a_span_holds_its_ends_and_rows_without_one_stay(spark):
    dim = spark.createDataFrame([("a", D(2020, 1, 1), D(2020, 6, 30), 10), ("a", D(2020, 7, 1), None, 20), ("b", D(2020, 1, 1), D(2020, 1, 31), 5)], "asset string, from_date date, to_date date, lot int")
    rows = spark.createDataFrame([("a", D(2019, 12, 31)), ("a", D(2020, 6, 30)), ("a", D(2020, 7, 1)), ("a", D(2030, 1, 1)), ("b", D(2020, 2, 1)), ("c", D(2020, 1, 1)), (None, D(2020, 1, 1)), ("a", None)], "asset string, date date")
    got = {(r["asset"], r["date"]): r["lot"] for r in pr.as_dated(rows, dim, ["asset"]).collect()}
    assert got == {("a", D(2019, 12, 31)): None, ("a", D(2020, 6, 30)): 10, ("a", D(2020, 7, 1)): 20, ("a", D(2030, 1, 1)): 20, ("b", D(2020, 2, 1)): None, ("c", D(2020, 1, 1)): None, (None, D(2020, 1, 1)): None, ("a", None): None}
    assert pr.overlapping(dim, ["asset"]).count() == 0
    bad = dim.union(spark.createDataFrame([("b", D(2020, 1, 31), None, 6), ("a", D(2021, 1, 1), None, 7)], dim.schema))
    assert {(r["asset"], r["lot"]) for r in pr.overlapping(bad, ["asset"]).collect()} == {("b", 6), ("a", 7)}


def test_old_codes_count_for_the_new_product(spark):
    rows = spark.createDataFrame([("ME1409",), ("MA1509",), ("TC1601",), ("ZC1609",), ("m1505",), ("MAX15",), ("rb1510",), (None,)], "inst string")
    got = {r["inst"]: r["product"] for r in pr.contracts_of(rows, ["MA", "ZC"], dropped=("TC1601",), renamed={"MA1509": "MA1510"}).collect()}
    assert got == {"ME1409": "MA", "MA1510": "MA", "ZC1609": "ZC"}
    all_ = {r["inst"]: r["product"] for r in pr.contracts_of(rows).collect()}
    assert all_["TC1601"] == "ZC" and all_["MAX15"] == "MAX" and len(all_) == 8
    listed = spark.createDataFrame([("MA", D(2015, 5, 1)), ("MA", D(2015, 6, 1)), ("ZC", D(2016, 4, 1)), ("rb", D(2010, 1, 1))], "p string, m date")
    assert [r[0] for r in listed.select(pr.stored_code("p", "m")).collect()] == ["ME", "MA", "TC", "rb"]


def test_the_first_price_known(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (None, 2.0), (None, None)], "a double, b double")
    assert [tuple(r) for r in rows.select(*pr.first_known(a=F.col("a"), b=F.col("b"))).collect()] == [(1.0, "a"), (2.0, "b"), (None, None)]
