"""The neighbourhood price surface: points, area statistics, tiles and lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickyard.functions import geo, money
from brickyard.operators import clean
from brickyard.operators.knn import Brief, nearest
from brickyard.operators.quantiles import group_medians, with_percentile
from brickyard.session import written

NEIGHBOURS = 20
TILE_MIN = 5
TILE_DEG = 0.01
NEAR_M = 1_000.0
POINT_COLUMNS = ["market", "listing_id", "latitude", "longitude", "refnis", "price_per_sqm"]


def surface_points(listings: DataFrame) -> DataFrame:
    """Guarded points with ``price_per_sqm``."""
    ratio = money.price_per_sqm(F.col("price"), F.col("livable_surface"))
    return clean.ppsqm_guard(listings.withColumn("price_per_sqm", ratio))


def muni_stats(points: DataFrame) -> DataFrame:
    """Mean, sum and count of the price per m² by municipality."""
    v = F.col("price_per_sqm")
    return (points.filter(F.col("refnis").isNotNull()).groupBy("market", "refnis")
            .agg(F.avg(v).alias("mean_ppsqm"), F.sum(v).alias("sum_ppsqm"),
                 F.count("*").alias("n")))


def area_medians(points: DataFrame) -> DataFrame:
    """Province medians and, in the row with a NULL province, the market's median."""
    levels = F.explode(F.array(
        F.struct(F.lit(0).alias("level"), F.col("province").alias("area")),
        F.struct(F.lit(1).alias("level"), F.lit(None).cast("string").alias("area"))))
    rows = (points.select("market", "price_per_sqm", levels.alias("_l"))
            .select("market", "price_per_sqm", "_l.level", "_l.area")
            .filter("level = 1 or area is not null"))
    return group_medians(rows, ["market", "level", "area"],
                         {"median_ppsqm": F.col("price_per_sqm")}, count_as="n")


def province_medians(points: DataFrame) -> DataFrame:
    return (area_medians(points).filter("level = 0")
            .select("market", F.col("area").alias("province"), "median_ppsqm", "n"))


def national_medians(points: DataFrame) -> DataFrame:
    """One row per market."""
    return group_medians(points, ["market"], {"national_ppsqm": F.col("price_per_sqm")},
                         count_as="n_points")


def tiles(points: DataFrame, width: float = TILE_DEG, at_least: int = TILE_MIN) -> DataFrame:
    """Heat-map tiles: centre, median, percentile and count of cells with enough listings."""
    cells = points.withColumns({"ty": geo.cell(F.col("latitude"), width),
                                "tx": geo.cell(F.col("longitude"), width)})
    med = group_medians(cells, ["market", "ty", "tx"],
                        {"price_per_sqm": F.col("price_per_sqm")}, count_as="n")
    ranked = with_percentile(med.filter(F.col("n") >= at_least), points, ["market"],
                             "price_per_sqm", "percentile")
    return ranked.select("market", "ty", "tx",
                         money.rounded((F.col("ty") + 0.5) * width, 5).alias("lat"),
                         money.rounded((F.col("tx") + 0.5) * width, 5).alias("lon"),
                         "price_per_sqm", "percentile", "n")


def neighbours(queries: DataFrame, points: DataFrame, k: int = NEIGHBOURS,
               exclude_id: str | None = None) -> DataFrame:
    """Queries with the local estimate of their nearest points.

    Adds ``local_ppsqm`` (median), ``radius_m`` (farthest neighbour), ``n_near`` (neighbours
    within 1 km), ``n_neighbours``, ``nearest_id`` and ``nearest_refnis``.
    """
    brief = Brief("price_per_sqm", NEAR_M, "refnis")
    return nearest(queries, points, k, carry=["price_per_sqm", "refnis"], exclude_id=exclude_id,
                   brief=brief).withColumnRenamed("local_price_per_sqm", "local_ppsqm")


def confidence(n_near: Column, radius_m: Column) -> Column:
    """Local sample density, 0.05 to 1; estimates from far away get 0.25."""
    return F.when(radius_m > geo.FAR_M, 0.25).otherwise(
        F.rint(money.clip(n_near / 10.0, 0.05, 1.0) * 100) / 100)


def back_off(found: DataFrame, points: DataFrame) -> DataFrame:
    """``value``: the local median, or the nearest municipality's mean, or the market's median."""
    # written, these are small files, so that the rows need not be shuffled to meet them
    stats = written(muni_stats(points).select(F.col("market").alias("_sm"), F.col("refnis").alias("_sr"),
                                              "mean_ppsqm"), "muni-stats")
    nat = written(national_medians(points).select(F.col("market").alias("_nm"), "national_ppsqm"), "national")
    far = F.col("radius_m") > geo.FAR_M
    # only far queries look a municipality up
    key = F.when(far, F.col("nearest_refnis"))
    out = found.withColumn("_k", key)
    out = out.join(stats, (F.col("market") == F.col("_sm")) & (F.col("_k") == F.col("_sr")), "left")
    out = out.join(nat, F.col("market") == F.col("_nm"), "left")
    value = F.when(far, F.coalesce("mean_ppsqm", "national_ppsqm")).otherwise(F.col("local_ppsqm"))
    return out.withColumn("value", value).drop("_k", "_sm", "_sr", "_nm", "mean_ppsqm",
                                               "national_ppsqm")


def lookup(queries: DataFrame, points: DataFrame, k: int = NEIGHBOURS,
           exclude_id: str | None = None) -> DataFrame:
    """Value, percentile, confidence, granularity and radius for every located query."""
    located = queries.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    points = written(points.select(*POINT_COLUMNS), "surface-points")
    # the ranks read the values twice; the search is not to run twice
    out = written(back_off(neighbours(located, points, k, exclude_id), points), "surface-values")
    out = with_percentile(out, points, ["market"], "price_per_sqm", "percentile", probe="value")
    return out.withColumns({
        "confidence": confidence(F.col("n_near"), F.col("radius_m")),
        "granularity": geo.granularity(F.col("radius_m"))})


def neighbourhood_index(listings: DataFrame, points: DataFrame,
                        leave_one_out: bool = True) -> DataFrame:
    """Add the model feature; listings without coordinates get 50."""
    own = "listing_id" if leave_one_out else None
    idx = lookup(listings.select("listing_id", "market", "latitude", "longitude"), points,
                 exclude_id=own).select("listing_id", F.col("percentile").alias("_pct"))
    return (listings.join(idx, "listing_id", "left")
            .withColumn("neighbourhood_price_index", F.coalesce("_pct", F.lit(50.0))).drop("_pct"))


def build_surface(listings: DataFrame) -> dict[str, DataFrame]:
    """The tables a surface consists of, ready to be written."""
    points = written(surface_points(listings).select(*POINT_COLUMNS, "province"), "surface-points")
    return {"points": points.select(*POINT_COLUMNS),
            "muni_stats": muni_stats(points), "province_medians": province_medians(points),
            "national": national_medians(points), "tiles": tiles(points)}
