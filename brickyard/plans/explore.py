"""Exploratory summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brickyard.operators.quantiles import group_medians


def province_extremes(points: DataFrame, each: int = 3) -> DataFrame:
    """Provinces with the highest and lowest median price per m² of each market."""
    med = group_medians(points.filter(F.col("province").isNotNull()), ["market", "province"],
                        {"median_ppsqm": F.col("price_per_sqm")})
    by = Window.partitionBy("market")
    ranked = med.withColumns({
        "_hi": F.row_number().over(by.orderBy(F.desc("median_ppsqm"), "province")),
        "_lo": F.row_number().over(by.orderBy("median_ppsqm", "province"))})
    return (ranked.filter((F.col("_hi") <= each) | (F.col("_lo") <= each))
            .select("market", "province", "median_ppsqm",
                    F.when(F.col("_hi") <= each, "top").otherwise("bottom").alias("side")))


def feature_profile(df: DataFrame, feature: str, target: str) -> DataFrame:
    """Correlation of a feature with the target, and the feature's range, per market."""
    return df.groupBy("market").agg(
        F.round(F.corr(feature, target), 6).alias("correlation"),
        F.min(feature).alias("lowest"), F.max(feature).alias("highest"))
