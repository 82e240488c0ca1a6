"""Appreciation, rental yield and return projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickyard.functions import money
from brickyard.operators import clean, enrich
from brickyard.operators.quantiles import group_medians

# Fixed values.
BASE_YEAR, END_YEAR, MIN_SPAN = 2015, 2025, 3
MIN_SALES, MIN_RENTS = 5, 5
HORIZONS = (5, 10, 15, 20)
APARTMENTS, HOUSES = "apartments", "houses_all"


# -- appreciation ------------------------------------------------------------
def cagr(history: DataFrame, base_year: int = BASE_YEAR, end_year: int = END_YEAR) -> DataFrame:
    """Clipped yearly growth per (refnis, property_type), one combinable aggregation.

    Starts at the first known year from ``base_year`` on (else the earliest known year) and
    needs a price in ``end_year`` and a span of at least three years.
    """
    price, year = F.col("median_price_eur"), F.col("year")
    late = F.when(year >= base_year, year)
    ends = history.filter(price.isNotNull()).groupBy("refnis", "property_type").agg(
        F.max(F.when(year == end_year, price)).alias("p1"),
        F.coalesce(F.min(late), F.min(year)).alias("y0"),
        F.coalesce(F.min_by(price, late), F.min_by(price, year)).alias("p0"))
    span = F.lit(end_year) - F.col("y0")
    growth = F.pow(F.col("p1") / F.col("p0"), F.lit(1.0) / span) - 1
    return (ends.filter(F.col("p1").isNotNull() & (span >= MIN_SPAN) & (F.col("p0") > 0))
            .select("refnis", "property_type",
                    money.clip(growth, money.CAGR_LOW, money.CAGR_HIGH).alias("cagr")))


def regional_cagr(growth: DataFrame, regions: DataFrame) -> DataFrame:
    """Median municipal growth per (region, property_type); ``regions`` maps refnis to region."""
    joined = growth.join(regions.select("refnis", "region"), "refnis").filter(
        F.col("region").isNotNull())
    return group_medians(joined, ["region", "property_type"], {"cagr": F.col("cagr")})


def _by_type(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """One row per key with the apartment and the house growth side by side."""
    pick = {t: F.max(F.when(F.col("property_type") == name, F.col("cagr")))
            for t, name in (("apt", APARTMENTS), ("house", HOUSES))}
    return df.groupBy(F.col(key).alias(f"{prefix}_key")).agg(
        *[c.alias(f"{prefix}_{t}") for t, c in pick.items()])


def with_growth(df: DataFrame, growth: DataFrame, regional: DataFrame,
                ptype: str = "ptype") -> DataFrame:
    """Add ``g`` and ``g_basis`` from (refnis, region, ptype); a growth of 0 is missing.

    Apartments try the municipality's apartments, its houses, then the region's; houses
    only house figures; the last resort is three percent.
    """
    muni, reg = _by_type(growth, "refnis", "_m"), _by_type(regional, "region", "_r")
    out = df.join(muni, df["refnis"] == muni["_m_key"], "left").join(
        reg, df["region"] == reg["_r_key"], "left")

    def known(c: str) -> Column:
        return F.nullif(F.col(c), F.lit(0.0))

    flat = F.col(ptype) == "apartment"
    local = F.when(flat, F.coalesce(known("_m_apt"), known("_m_house"))).otherwise(known("_m_house"))
    area = F.when(flat, F.coalesce(known("_r_apt"), known("_r_house"))).otherwise(known("_r_house"))
    g = money.clip(F.coalesce(local, area, F.lit(money.BASE_GROWTH)), money.CAGR_LOW,
                   money.CAGR_HIGH)
    basis = (F.when(local.isNotNull(), "municipality").when(area.isNotNull(), "region")
             .otherwise("base"))
    return out.withColumns({"g": g, "g_basis": basis}).drop(*muni.columns, *reg.columns)


def appreciation_table(history: DataFrame, regions: DataFrame, base_year: int = BASE_YEAR,
                       end_year: int = END_YEAR) -> DataFrame:
    """Growth per (refnis, ptype) for every municipality of ``regions``, with its basis."""
    growth = cagr(history, base_year, end_year)
    places = regions.select("refnis", "region").distinct().withColumn(
        "ptype", F.explode(F.array(F.lit("apartment"), F.lit("house"))))
    return with_growth(places, growth, regional_cagr(growth, regions))


# -- yields ------------------------------------------------------------------
def yield_listings(listings: DataFrame, xw: DataFrame) -> DataFrame:
    """Guarded listings with a resolved municipality and ``ptype``."""
    return enrich.resolve_refnis(clean.roi_guard(listings), xw).withColumn(
        "ptype", F.col("category"))


def sale_base(rows: DataFrame) -> DataFrame:
    """Sales per (refnis, ptype): count, median price per m², median price."""
    return group_medians(rows.filter(F.col("market") == "sale"), ["refnis", "ptype"],
                         {"sale_ppsqm": F.col("ppsqm"), "sale_price": F.col("price")},
                         count_as="n_sale")


def rent_levels(rows: DataFrame) -> DataFrame:
    """Median rent per m² by level (muni, prov, region), area and ptype, in one pass."""
    level = F.explode(F.array(
        F.struct(F.lit("muni").alias("level"), F.col("refnis").cast("string").alias("area")),
        F.struct(F.lit("prov").alias("level"), F.col("province").alias("area")),
        F.struct(F.lit("region").alias("level"), F.col("region").alias("area"))))
    long = (rows.filter(F.col("market") == "rent").select("ptype", "ppsqm", level.alias("_l"))
            .select("ptype", "ppsqm", "_l.level", "_l.area").filter(F.col("area").isNotNull()))
    return group_medians(long, ["level", "area", "ptype"], {"rent_ppsqm": F.col("ppsqm")},
                         count_as="n_rent")


def yield_fallback(base: DataFrame, rents: DataFrame, areas: DataFrame) -> DataFrame:
    """Capped gross yield per (refnis, ptype) with the level its rent comes from.

    Needs five sales; the municipality's rent needs five rentals, else the province's, else
    the region's median is used. Rows without any rent are dropped.
    """
    out = base.filter((F.col("n_sale") >= MIN_SALES) & (F.col("sale_ppsqm") > 0)).join(
        areas.select("refnis", "province", "region"), "refnis", "left")
    for level, area in (("muni", F.col("refnis").cast("string")), ("prov", F.col("province")),
                        ("region", F.col("region"))):
        r = rents.filter(F.col("level") == level).select(
            F.col("area").alias("_a"), F.col("ptype").alias("_t"),
            F.col("rent_ppsqm").alias(f"_{level}"), F.col("n_rent").alias(f"_n_{level}"))
        out = out.join(r, (area == F.col("_a")) & (F.col("ptype") == F.col("_t")), "left").drop(
            "_a", "_t")
    muni = F.when(F.col("_n_muni") >= MIN_RENTS, F.col("_muni"))
    rent = F.coalesce(muni, "_prov", "_region")
    basis = (F.when(muni.isNotNull(), "muni").when(F.col("_prov").isNotNull(), "prov")
             .when(F.col("_region").isNotNull(), "region"))
    return (out.withColumns({"rent_ppsqm": rent, "basis": basis}).filter(rent.isNotNull())
            .withColumn("gross_yield_pct", F.least(
                F.col("rent_ppsqm") * 12 / F.col("sale_ppsqm") * 100, F.lit(money.YIELD_CAP)))
            .select("refnis", "ptype", "province", "region", "n_sale", "sale_ppsqm",
                    "sale_price", "rent_ppsqm", "basis", "gross_yield_pct"))


def yield_table(listings: DataFrame, xw: DataFrame) -> DataFrame:
    rows = yield_listings(listings, xw)
    return yield_fallback(sale_base(rows), rent_levels(rows), enrich.crosswalk_by_refnis(xw))


# -- projection --------------------------------------------------------------
def _break_even(rate: Column, g: Column, threshold: Column, years: int) -> Column:
    """First year the cumulative return reaches the threshold, interpolated; else NULL.

    The years are branches of one compiled expression, which stops at the first that holds.
    """

    def total(y: Column) -> Column:
        return rate * y + (F.pow(1.0 + g, y) - 1.0) * 100.0

    first = F.coalesce(*[F.when(total(F.lit(y)) >= threshold, y) for y in range(1, years + 1)])
    before, at = total(first - 1), total(first)
    part = F.when(at != before, (threshold - before) / (at - before)).otherwise(0.0)
    return money.rounded((first - 1) + part, 2)


def _terms(df: DataFrame, growth: tuple[DataFrame, DataFrame] | None,
           yields: DataFrame | None) -> DataFrame:
    """What a property's years are computed from: growth, yield, yearly rent and costs."""
    out = df.withColumn("ptype", F.when(
        F.col("ptype").isNotNull(), F.col("ptype")).otherwise("house"))
    if growth is not None:
        out = with_growth(out, *growth)
    else:
        out = out.withColumns({"g": F.lit(money.BASE_GROWTH), "g_basis": F.lit("base")})
    uniform = F.lit(None).cast("double")
    for name, rate in money.SCENARIOS.items():
        uniform = F.when(F.col("scenario") == name, rate).otherwise(uniform)
    bad = F.raise_error(F.concat(F.lit("unknown scenario "), F.coalesce("scenario", F.lit("NULL"))))
    g = (F.when(F.col("scenario") == "hist", F.col("g")).when(uniform.isNotNull(), uniform)
         .otherwise(bad.cast("double")))
    out = out.withColumns({"g": g, "g_basis": F.when(F.col("scenario") == "hist", F.col("g_basis"))
                           .otherwise("scenario")})

    price, rent = F.col("purchase_price"), F.coalesce("monthly_rent", F.lit(0.0))
    implied = money.gross_yield_pct(rent, price)
    if yields is not None:
        y = yields.select(F.col("refnis").alias("_yr"), F.col("ptype").alias("_yt"),
                          F.col("gross_yield_pct").alias("_gy"))
        # only rows without a usable rent look a yield up
        key = F.when(implied.isNull(), F.col("refnis"))
        out = out.withColumn("_k", key)
        out = out.join(y, (F.col("_k") == F.col("_yr")) & (F.col("ptype") == F.col("_yt")), "left")
    else:
        out = out.withColumn("_gy", F.lit(None).cast("double"))
    gross = F.coalesce(implied, "_gy", F.lit(0.0))
    acq = F.when(F.col("include_costs"), money.acquisition_rate(F.col("region"))).otherwise(0.0)
    net = F.when(F.col("include_costs"), 1.0 - money.HOLDING_COST).otherwise(1.0)
    out = out.withColumns({
        "gross_yield_pct": gross, "_net": net, "_acq": acq,
        "annual_net_rent": F.when(rent > 0, rent * 12).otherwise(gross / 100 * price) * net})
    return out.withColumn("_rate", F.col("gross_yield_pct") * F.col("_net")).drop("_k", "_yr", "_yt", "_gy")


def _year(y: Column) -> Column:
    """One year of a property's projection as a struct."""
    price = F.col("purchase_price")
    appreciation = F.pow(1.0 + F.col("g"), y)
    value = price * appreciation
    earned = F.col("annual_net_rent") * y
    return F.struct(
        y.alias("year"), money.rounded(F.col("_rate") * y, 2).alias("roi_rent_only_pct"),
        money.rounded(F.col("_rate") * y + (appreciation - 1.0) * 100.0, 2).alias("roi_total_pct"),
        money.rounded(value, 2).alias("cumulative_value_eur"),
        money.rounded(earned, 2).alias("cumulative_rent_eur"),
        money.rounded(value + earned, 2).alias("net_worth_eur"),
        money.rounded(value + earned - price * (1.0 + F.col("_acq")), 2).alias("profit_eur"))


def project(df: DataFrame, horizons: Sequence[int] = HORIZONS,
            growth: tuple[DataFrame, DataFrame] | None = None,
            yields: DataFrame | None = None) -> DataFrame:
    """Return projection of a table of properties; nothing is shuffled but the look-ups.

    Needs property_id, purchase_price, monthly_rent, refnis, province, region, ptype,
    scenario (hist, cons, base, opt) and include_costs. ``growth`` is (municipal, regional)
    growth for the hist scenario, ``yields`` a yield table for rows without a rent. Adds the
    yearly ``series`` and the ``milestones`` as arrays, and the break-even years.
    """
    last = max(horizons)
    # a struct per known year: compiled, and a reader of one value pays for that value only
    series = F.array(*[_year(F.lit(y)) for y in range(last + 1)])
    marks = F.array(*[_year(F.lit(y)) for y in sorted(set(horizons)) if 0 <= y <= last])
    threshold = (1.0 + F.col("_acq")) * 100.0
    return (_terms(df, growth, yields)
            .withColumns({
                "series": series, "milestones": marks,
                "breakeven_rent": _break_even(F.col("_rate"), F.lit(0.0), threshold, last),
                "breakeven_total": _break_even(F.col("_rate"), F.col("g"), threshold, last),
                "appreciation_pct": money.rounded(F.col("g") * 100, 2)})
            .drop("_net", "_acq", "_rate"))


def yearly(df: DataFrame, horizons: Sequence[int] = HORIZONS,
           growth: tuple[DataFrame, DataFrame] | None = None,
           yields: DataFrame | None = None) -> DataFrame:
    """The rows of :func:`project`'s ``series``: years are dealt out first, then computed by row."""
    years = F.explode(F.sequence(F.lit(0), F.lit(max(horizons))))
    rows = _terms(df, growth, yields).select(
        "property_id", "purchase_price", "annual_net_rent", "g", "_rate", "_acq", years.alias("_y"))
    return rows.select("property_id", _year(F.col("_y")).alias("_s")).select("property_id", "_s.*")


def explode_series(projected: DataFrame, column: str = "series") -> DataFrame:
    """One row per property and year of ``series`` or ``milestones``."""
    return projected.select("property_id", F.explode(column).alias("_s")).select(
        "property_id", "_s.*")


def unpivot_series(long: DataFrame) -> DataFrame:
    """(property_id, year, kind, roi) rows for the two return curves."""
    return long.unpivot(["property_id", "year"], ["roi_rent_only_pct", "roi_total_pct"],
                        "kind", "roi").withColumn(
        "kind", F.when(F.col("kind") == "roi_rent_only_pct", "Rent only")
        .otherwise("Rent + appreciation"))
