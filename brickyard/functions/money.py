"""Price and return formulas as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the return projection.
YIELD_CAP = 9.0
CAGR_LOW, CAGR_HIGH = 0.0, 0.06
BASE_GROWTH = 0.03
SCENARIOS = {"cons": 0.02, "base": 0.03, "opt": 0.043}
ACQUISITION_WALLONIA, ACQUISITION_OTHER = 0.13, 0.125
HOLDING_COST = 0.15


def price_per_sqm(price: Column, surface: Column) -> Column:
    """Price per square metre where the surface is positive, else NULL."""
    return F.when(surface > 0, price / surface)


def gross_yield_pct(monthly_rent: Column, price: Column) -> Column:
    """Yearly rent as a percentage of the price, capped."""
    return F.when((monthly_rent > 0) & (price > 0),
                  F.least(monthly_rent * 12 / price * 100, F.lit(YIELD_CAP)))


def acquisition_rate(region: Column) -> Column:
    """Registration duties by region; unknown regions pay the lower rate."""
    return F.when(F.lower(region).contains("wallon"), ACQUISITION_WALLONIA).otherwise(
        F.lit(ACQUISITION_OTHER))


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def band(prediction: Column, mae: Column) -> tuple[Column, Column]:
    """Prediction interval of one typical miss, floored at zero."""
    return F.greatest(F.lit(0.0), prediction - mae), prediction + mae


def rounded(c: Column, digits: int = 2) -> Column:
    """Half-to-even rounding of the scaled value."""
    scale = F.lit(float(10 ** digits))
    return F.rint(c * scale) / scale
