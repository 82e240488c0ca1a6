"""Queries: growth, yields and return projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickyard.functions import money
from brickyard.operators import enrich
from brickyard.plans import returns as R
from brickyard.plans.bind import (CROSSWALK, LISTINGS, PRICE_HISTORY, crosswalk, listings,
                                  price_history, table)
from brickyard.plans.registry import query

Y0, Y1 = 1996, 2000


# -- growth ------------------------------------------------------------------
_CAGR = f"""
h AS ({PRICE_HISTORY}),
e AS (SELECT refnis, property_type, max(CASE WHEN year = {Y1} THEN median_price_eur END) AS p1,
    coalesce(min(CASE WHEN year >= {Y0} THEN year END), min(year)) AS y0 FROM h GROUP BY 1, 2),
g AS (SELECT e.refnis, e.property_type, least(greatest(
    pow(p1 / h.median_price_eur, 1E0 / ({Y1} - y0)) - 1, 0E0), 0.06E0) AS cagr
  FROM e JOIN h ON h.refnis = e.refnis AND h.property_type = e.property_type AND h.year = e.y0
  WHERE p1 IS NOT NULL AND {Y1} - y0 >= 3 AND h.median_price_eur > 0),
nr AS (SELECT cast(n_nationkey AS bigint) AS refnis, n_name AS province, r_name AS region
  FROM nation JOIN region ON n_regionkey = r_regionkey),
rg AS (SELECT region, property_type, median(cagr) AS cagr FROM g JOIN nr USING (refnis) GROUP BY 1, 2)"""
_GROWTH = _CAGR + """,
mw AS (SELECT refnis, max(CASE WHEN property_type = 'apartments' THEN cagr END) AS m_apt,
    max(CASE WHEN property_type = 'houses_all' THEN cagr END) AS m_house FROM g GROUP BY 1),
rw AS (SELECT region, max(CASE WHEN property_type = 'apartments' THEN cagr END) AS r_apt,
    max(CASE WHEN property_type = 'houses_all' THEN cagr END) AS r_house FROM rg GROUP BY 1)"""
_G_LOCAL = """CASE WHEN ptype = 'apartment' THEN coalesce(nullif(m_apt, 0), nullif(m_house, 0))
  ELSE nullif(m_house, 0) END"""
_G_AREA = """CASE WHEN ptype = 'apartment' THEN coalesce(nullif(r_apt, 0), nullif(r_house, 0))
  ELSE nullif(r_house, 0) END"""


def _regions(spark: SparkSession, sf: str) -> DataFrame:
    """The price history is keyed by nation."""
    return (table(spark, sf, "nation").join(table(spark, sf, "region"),
                                            F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("n_nationkey").cast("bigint").alias("refnis"),
                    F.col("n_name").alias("province"), F.col("r_name").alias("region")))


def _growth(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    g = R.cagr(price_history(spark, sf), Y0, Y1)
    return g, R.regional_cagr(g, _regions(spark, sf))


@query("cagr", "WITH " + _CAGR + "SELECT refnis, property_type, round(cagr, 9) AS cagr FROM g")
def cagr(spark: SparkSession, sf: str) -> DataFrame:
    return R.cagr(price_history(spark, sf), Y0, Y1).withColumn("cagr", F.round("cagr", 9))


@query("regional_cagr", "WITH " + _CAGR + """
SELECT region, property_type, round(cagr, 9) AS cagr FROM rg""")
def regional_cagr(spark: SparkSession, sf: str) -> DataFrame:
    return _growth(spark, sf)[1].withColumn("cagr", F.round("cagr", 9))


@query("appreciation_table", "WITH " + _GROWTH + f"""
, pl AS (SELECT nr.refnis, nr.region, t.ptype FROM nr, (VALUES ('apartment'), ('house')) t(ptype))
SELECT pl.refnis, pl.region, ptype, round(least(greatest(coalesce({_G_LOCAL}, {_G_AREA}, 0.03E0), 0E0), 0.06E0), 9) AS g,
  CASE WHEN {_G_LOCAL} IS NOT NULL THEN 'municipality' WHEN {_G_AREA} IS NOT NULL THEN 'region'
    ELSE 'base' END AS g_basis
FROM pl LEFT JOIN mw ON mw.refnis = pl.refnis LEFT JOIN rw ON rw.region = pl.region""")
def appreciation_table(spark: SparkSession, sf: str) -> DataFrame:
    return R.appreciation_table(price_history(spark, sf), _regions(spark, sf), Y0, Y1).withColumn(
        "g", F.round("g", 9))


# Listings located in the price history: the nation is the municipality there.
_PLACED = f"""l AS ({LISTINGS}),
pl AS (SELECT l.listing_id, l.category AS ptype, nr.refnis, nr.province, nr.region, l.price, l.bedrooms,
  l.refnis AS muni FROM l JOIN nr ON nr.province = l.province WHERE l.market = 'sale')"""


def _placed(spark: SparkSession, sf: str) -> DataFrame:
    nr = _regions(spark, sf).select("refnis", F.col("province").alias("_p"))
    rows = listings(spark, sf).filter(F.col("market") == "sale").withColumnRenamed("refnis", "muni")
    return rows.join(nr, F.col("province") == F.col("_p")).withColumn("ptype", F.col("category"))


@query("cagr_fallback", "WITH " + _GROWTH + ", " + _PLACED + f"""
SELECT listing_id, round(least(greatest(coalesce({_G_LOCAL}, {_G_AREA}, 0.03E0), 0E0), 0.06E0), 9) AS g
FROM pl LEFT JOIN mw ON mw.refnis = pl.refnis LEFT JOIN rw ON rw.region = pl.region""")
def cagr_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return R.with_growth(_placed(spark, sf), *_growth(spark, sf)).select(
        "listing_id", F.round("g", 9).alias("g"))


# -- yields ------------------------------------------------------------------
_YL = f"""xw AS ({CROSSWALK}), l AS ({LISTINGS}),
y AS (SELECT l.market, l.refnis, l.province, l.region, category AS ptype, price,
    price / livable_surface AS ppsqm FROM l
  WHERE category IN ('house', 'apartment') AND livable_surface BETWEEN 9 AND 3000
    AND ((market = 'sale' AND price BETWEEN 25000 AND 15000000 AND price / livable_surface BETWEEN 400 AND 18000)
      OR (market = 'rent' AND price BETWEEN 200 AND 25000 AND price / livable_surface BETWEEN 3 AND 70))),
sb AS (SELECT refnis, ptype, count(*) AS n_sale, median(ppsqm) AS sale_ppsqm, median(price) AS sale_price
  FROM y WHERE market = 'sale' GROUP BY 1, 2),
rl AS (SELECT 'muni' AS level, cast(refnis AS varchar) AS area, ptype, median(ppsqm) AS rent_ppsqm, count(*) AS n_rent
    FROM y WHERE market = 'rent' GROUP BY refnis, ptype
  UNION ALL SELECT 'prov', province, ptype, median(ppsqm), count(*) FROM y WHERE market = 'rent' GROUP BY province, ptype
  UNION ALL SELECT 'region', region, ptype, median(ppsqm), count(*) FROM y WHERE market = 'rent' GROUP BY region, ptype)"""


def _yield_rows(spark: SparkSession, sf: str) -> DataFrame:
    return R.yield_listings(listings(spark, sf), crosswalk(spark, sf))


@query("sale_yield_base", "WITH " + _YL + "SELECT * FROM sb")
def sale_yield_base(spark: SparkSession, sf: str) -> DataFrame:
    return R.sale_base(_yield_rows(spark, sf))


@query("rent_levels", "WITH " + _YL + "SELECT * FROM rl")
def rent_levels(spark: SparkSession, sf: str) -> DataFrame:
    return R.rent_levels(_yield_rows(spark, sf))


_YT = """
SELECT sb.refnis, sb.ptype, a.province, a.region, n_sale, sale_ppsqm, sale_price,
  coalesce(m.rent_ppsqm, p.rent_ppsqm, r.rent_ppsqm) AS rent_ppsqm,
  CASE WHEN m.rent_ppsqm IS NOT NULL THEN 'muni' WHEN p.rent_ppsqm IS NOT NULL THEN 'prov' ELSE 'region' END AS basis,
  round(least(coalesce(m.rent_ppsqm, p.rent_ppsqm, r.rent_ppsqm) * 12 / sale_ppsqm * 100, 9E0), 6) AS gross_yield_pct
FROM sb LEFT JOIN xw a ON a.refnis = sb.refnis
LEFT JOIN rl m ON m.level = 'muni' AND m.area = cast(sb.refnis AS varchar) AND m.ptype = sb.ptype AND m.n_rent >= 5 @M@
LEFT JOIN rl p ON p.level = 'prov' AND p.area = a.province AND p.ptype = sb.ptype
LEFT JOIN rl r ON r.level = 'region' AND r.area = a.region AND r.ptype = sb.ptype
WHERE n_sale >= 5 AND coalesce(m.rent_ppsqm, p.rent_ppsqm, r.rent_ppsqm) IS NOT NULL"""


@query("yield_table", "WITH " + _YL + _YT.replace("@M@", ""))
def yield_table(spark: SparkSession, sf: str) -> DataFrame:
    return R.yield_table(listings(spark, sf), crosswalk(spark, sf)).withColumn(
        "gross_yield_pct", F.round("gross_yield_pct", 6))


# Every seventh municipality counts as having one rental, so that fallbacks occur.
@query("yield_fallback", "WITH " + _YL + _YT.replace("@M@", "AND sb.refnis % 7 <> 0"))
def yield_fallback(spark: SparkSession, sf: str) -> DataFrame:
    rows = _yield_rows(spark, sf)
    few = R.rent_levels(rows).withColumn("n_rent", F.when(
        (F.col("level") == "muni") & (F.col("area").try_cast("bigint") % 7 == 0), F.lit(1))
        .otherwise(F.col("n_rent")))
    return R.yield_fallback(R.sale_base(rows), few,
                            enrich.crosswalk_by_refnis(crosswalk(spark, sf))).withColumn(
        "gross_yield_pct", F.round("gross_yield_pct", 6))


# -- projection --------------------------------------------------------------
# Every sale listing is a request; scenario, rent and costs vary by bedrooms.
_SCEN = ["hist", "cons", "base", "opt", "hist", "base"]
_PROJ = "WITH " + _GROWTH + ", " + _PLACED + f""",
b AS (SELECT listing_id AS property_id, price AS p, CASE WHEN bedrooms = 5 THEN 0E0 ELSE price * 0.004E0 * (1 + bedrooms) END AS rent,
    ['hist','cons','base','opt','hist','base'][bedrooms + 1] AS scenario, bedrooms % 2 = 0 AS costs,
    lower(pl.region) AS reg, coalesce({_G_LOCAL}, {_G_AREA}, 0.03E0) AS gh
  FROM pl LEFT JOIN mw ON mw.refnis = pl.refnis LEFT JOIN rw ON rw.region = pl.region),
c AS (SELECT property_id, p, rent, costs,
    CASE scenario WHEN 'hist' THEN least(greatest(gh, 0E0), 0.06E0) WHEN 'cons' THEN 0.02E0 WHEN 'base' THEN 0.03E0 ELSE 0.043E0 END AS g,
    CASE WHEN rent > 0 THEN least(rent * 12 / p * 100, 9E0) ELSE 0E0 END AS gy,
    CASE WHEN costs THEN 0.85E0 ELSE 1E0 END AS net,
    CASE WHEN NOT costs THEN 0E0 WHEN reg LIKE '%wallon%' THEN 0.13E0 ELSE 0.125E0 END AS acq FROM b),
s AS (SELECT c.*, y.year, gy * net * y.year AS rent_roi, gy * net * y.year + (pow(1 + g, y.year) - 1) * 100 AS total_roi,
    p * pow(1 + g, y.year) AS value, rent * 12 * net * y.year AS earned
  FROM c, (SELECT unnest(range(0, 21))::INTEGER AS year) y)"""


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    beds = F.col("bedrooms")
    return _placed(spark, sf).select(
        F.col("listing_id").alias("property_id"), F.col("price").alias("purchase_price"),
        F.when(beds != 5, F.col("price") * 0.004 * (beds + 1)).otherwise(0.0).alias("monthly_rent"),
        F.get(F.array(*[F.lit(s) for s in _SCEN]), beds.cast("int")).alias("scenario"),
        (beds % 2 == 0).alias("include_costs"), "refnis", "province", "region", "ptype")


def _projected(spark: SparkSession, sf: str) -> DataFrame:
    return R.project(_requests(spark, sf), growth=_growth(spark, sf))


def _yearly(spark: SparkSession, sf: str) -> DataFrame:
    return R.yearly(_requests(spark, sf), growth=_growth(spark, sf))


@query("roi_series", _PROJ + """
SELECT property_id, year, round_even((rent_roi) * 100, 0) / 100 AS roi_rent_only_pct, round_even((total_roi) * 100, 0) / 100 AS roi_total_pct,
  round_even((value) * 100, 0) / 100 AS cumulative_value_eur, round_even((earned) * 100, 0) / 100 AS cumulative_rent_eur,
  round_even((value + earned) * 100, 0) / 100 AS net_worth_eur FROM s""")
def roi_series(spark: SparkSession, sf: str) -> DataFrame:
    return _yearly(spark, sf).drop("profit_eur")


@query("roi_milestones", _PROJ + """
SELECT property_id, year, round_even((rent_roi) * 100, 0) / 100 AS roi_rent_only_pct, round_even((total_roi) * 100, 0) / 100 AS roi_total_pct,
  round_even((value + earned - p * (1 + acq)) * 100, 0) / 100 AS profit_eur FROM s WHERE year IN (5, 10, 15, 20)""")
def roi_milestones(spark: SparkSession, sf: str) -> DataFrame:
    return R.explode_series(_projected(spark, sf), "milestones").select(
        "property_id", "year", "roi_rent_only_pct", "roi_total_pct", "profit_eur")


@query("roi_unpivot", _PROJ + """
SELECT property_id, year, 'Rent only' AS kind, round_even((rent_roi) * 100, 0) / 100 AS roi FROM s
UNION ALL SELECT property_id, year, 'Rent + appreciation', round_even((total_roi) * 100, 0) / 100 FROM s""")
def roi_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    return R.unpivot_series(_yearly(spark, sf))


_BREAK = """,
w AS (SELECT *, (1 + acq) * 100 AS th, lag(@C@) OVER (PARTITION BY property_id ORDER BY year) AS prev FROM s),
x@N@ AS (SELECT property_id, round_even((year - 1 + CASE WHEN @C@ <> prev THEN (th - prev) / (@C@ - prev) ELSE 0 END) * 100, 0) / 100 AS be
  FROM w WHERE @C@ >= th AND year > 0 QUALIFY row_number() OVER (PARTITION BY property_id ORDER BY year) = 1)"""
_BOTH = (_PROJ + _BREAK.replace("@C@", "rent_roi").replace("@N@", "1")
         + _BREAK.replace("@C@", "total_roi").replace("@N@", "2").replace("w AS", "w2 AS").replace("FROM w ", "FROM w2 "))


@query("breakeven", _BOTH + """
SELECT c.property_id, x1.be AS breakeven_rent, x2.be AS breakeven_total FROM c
LEFT JOIN x1 USING (property_id) LEFT JOIN x2 USING (property_id)""")
def breakeven(spark: SparkSession, sf: str) -> DataFrame:
    return _projected(spark, sf).select("property_id", "breakeven_rent", "breakeven_total")


@query("roi_projection", _BOTH + """
SELECT c.property_id, round(gy, 6) AS gross_yield_pct, round_even((g * 100) * 100, 0) / 100 AS appreciation_pct,
  round_even((rent * 12 * net) * 100, 0) / 100 AS annual_net_rent, x2.be AS breakeven_total,
  f.total_roi AS roi_total_20 FROM c LEFT JOIN x2 USING (property_id)
JOIN (SELECT property_id, round_even((total_roi) * 100, 0) / 100 AS total_roi FROM s WHERE year = 20) f USING (property_id)""")
def roi_projection(spark: SparkSession, sf: str) -> DataFrame:
    return _projected(spark, sf).select(
        "property_id", F.round("gross_yield_pct", 6).alias("gross_yield_pct"), "appreciation_pct",
        money.rounded(F.col("annual_net_rent")).alias("annual_net_rent"), "breakeven_total",
        F.get("milestones", F.lit(3))["roi_total_pct"].alias("roi_total_20"))
