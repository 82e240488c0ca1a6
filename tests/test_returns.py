"""Return projection: golden numbers and invariants."""

import pytest
from pyspark.sql import functions as F

from brickyard.plans import returns as R

SCHEMA = ("property_id string, purchase_price double, monthly_rent double, refnis bigint,"
          " province string, region string, ptype string, scenario string, include_costs boolean")


def test_projection(spark):
    rows = [("a", 300_000.0, 1_200.0, 1, None, "Flanders", "house", "base", False),
            ("b", 300_000.0, 1_200.0, 1, None, "Wallonia", "house", "cons", True),
            ("c", 100_000.0, 5_000.0, 1, None, None, "house", "opt", False)]
    out = {r.property_id: r for r in R.project(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out["a"].gross_yield_pct == pytest.approx(4.8) and out["c"].gross_yield_pct == 9.0
    for r in out.values():
        assert len(r.series) == 21
        assert all(s.roi_total_pct >= s.roi_rent_only_pct for s in r.series)
        assert [m.year for m in r.milestones] == [5, 10, 15, 20]
    ten = out["b"].series[10]
    assert ten.roi_total_pct == pytest.approx(4.8 * 0.85 * 10 + (1.02 ** 10 - 1) * 100, abs=0.006)
    assert ten.profit_eur == pytest.approx(300_000 * 1.02 ** 10 + 14_400 * 0.85 * 10 - 339_000, abs=0.01)
    before, after = (4.8 * y + (1.03 ** y - 1) * 100 for y in (11, 12))
    assert before < 100 <= after
    assert out["a"].breakeven_total == pytest.approx(11 + (100 - before) / (after - before), abs=0.006)
    assert out["a"].breakeven_rent is None


def test_unknown_scenario_fails(spark):
    row = [("a", 1e5, 1e3, 1, None, None, "house", "wild", False)]
    with pytest.raises(Exception, match="unknown scenario"):
        R.project(spark.createDataFrame(row, SCHEMA)).collect()


def test_growth_fallbacks(spark):
    hist = spark.createDataFrame(
        [(1, "apartments", 2015, 100.0), (1, "apartments", 2025, 100.0),
         (1, "houses_all", 2014, 1.0), (1, "houses_all", 2016, 100.0), (1, "houses_all", 2025, 120.0),
         (2, "houses_all", 2023, 100.0), (2, "houses_all", 2025, 200.0),
         (3, "houses_all", 2015, 100.0), (3, "houses_all", 2025, 900.0)],
        "refnis bigint, property_type string, year int, median_price_eur double")
    regions = spark.createDataFrame([(1, "N"), (2, "N"), (3, "S"), (4, "E")], "refnis bigint, region string")
    got = {(r.refnis, r.ptype): (round(r.g, 6), r.g_basis)
           for r in R.appreciation_table(hist, regions).collect()}
    house = round(1.2 ** (1 / 9) - 1, 6)
    assert got[(1, "apartment")] == (house, "municipality")  # a growth of 0 is missing
    assert got[(2, "house")] == (house, "region")
    assert got[(3, "house")] == (0.06, "municipality") and got[(4, "house")] == (0.03, "base")
    assert R.cagr(hist).filter(F.col("refnis") == 2).count() == 0


def test_years_and_break_even_are_compiled(spark):
    """No interpreted loop over the years of a property, and the same years either way."""
    rows = [("a", 200000.0, 1500.0, 1, "P", "Wallonia", "house", "base", True),
            ("b", 90000.0, 0.0, 1, "P", "Flanders", "apartment", "opt", False)]
    df = spark.createDataFrame(rows, SCHEMA)
    projected = R.project(df)
    plan = projected._jdf.queryExecution().analyzed().toString()
    assert "transform(" not in plan and "lambda" not in plan
    want = sorted(map(tuple, R.explode_series(projected).collect()))
    assert sorted(map(tuple, R.yearly(df).collect())) == want and len(want) == 42
