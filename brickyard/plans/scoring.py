"""Serving: feature completion, neighbourhood index, batch scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickyard.operators.quantiles import with_percentile
from brickyard.plans import surface
from brickyard.session import written


def serve_index(df: DataFrame, points: DataFrame) -> DataFrame:
    """Add ``neighbourhood_price_index`` and its basis.

    Exact coordinates read the surface; a row with only a province gets the percentile of
    the province median; anything else keeps 50.
    """
    points = written(points.select(*surface.POINT_COLUMNS, "province"), "surface-points")
    exact = surface.lookup(df.select("listing_id", "market", "latitude", "longitude"), points)
    exact = exact.select("listing_id", F.col("percentile").alias("_exact"))
    med = with_percentile(surface.province_medians(points), points, ["market"], "price_per_sqm",
                          "_province", probe="median_ppsqm")
    med = med.select(F.col("market").alias("_m"), F.col("province").alias("_p"), "_province")
    out = df.join(exact, "listing_id", "left")
    out = out.join(med, (F.col("market") == F.col("_m")) & (F.col("province") == F.col("_p")), "left")
    basis = (F.when(F.col("_exact").isNotNull(), "exact")
             .when(F.col("_province").isNotNull(), "province").otherwise("default"))
    return out.withColumns({
        "neighbourhood_price_index": F.coalesce("_exact", "_province", F.lit(50.0)),
        "index_basis": basis}).drop("_exact", "_province", "_m", "_p")
