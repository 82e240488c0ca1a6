"""Look-up joins that complete listings: crosswalk, URLs, geography, seen sets.

Dimensions are joined without broadcast hints: Spark reads their size at run time and
broadcasts below its threshold, or shuffles with skew splitting above it. The only hinted
table is the constant list of provinces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickyard import schema as S
from brickyard.functions import text
from brickyard.operators.clean import fix_province
from brickyard.operators.dedup import first_per_key


def crosswalk_by_postcode(xw: DataFrame) -> DataFrame:
    """One row per postal code: the smallest municipality code; Dutch name, else French."""
    one = first_per_key(xw, ["postal_code"], [F.col("refnis").asc()])
    return one.select("postal_code", "refnis",
                      F.coalesce("municipality_nl", "municipality_fr").alias("municipality"),
                      fix_province(F.col("province")).alias("province"), "region")


def crosswalk_by_refnis(xw: DataFrame) -> DataFrame:
    """One row per municipality code: the smallest postal code."""
    one = first_per_key(xw, ["refnis"], [F.col("postal_code").asc()])
    return one.select("refnis", "postal_code",
                      F.coalesce("municipality_nl", "municipality_fr").alias("municipality"),
                      fix_province(F.col("province")).alias("province"), "region")


def crosswalk_by_name(xw: DataFrame) -> DataFrame:
    """One row per lower-cased municipality name in either language."""
    names = xw.select("*", F.explode(F.array(
        F.struct(F.lit(0).alias("lang"), F.col("municipality_nl").alias("name")),
        F.struct(F.lit(1).alias("lang"), F.col("municipality_fr").alias("name")))).alias("_n"))
    names = (names.withColumn("name", F.lower(F.trim("_n.name")))
             .filter(F.col("name").isNotNull()))
    one = first_per_key(names, ["name"], [F.col("refnis").asc(), F.col("postal_code").asc(),
                                          F.col("_n.lang").asc()])
    return one.select("name", "postal_code", "refnis",
                      F.coalesce("municipality_nl", "municipality_fr").alias("municipality"),
                      fix_province(F.col("province")).alias("province"), "region")


def _prefixed(dim: DataFrame, prefix: str) -> DataFrame:
    return dim.select(*[F.col(c).alias(prefix + c) for c in dim.columns])


def crosswalk_enrich(df: DataFrame, xw: DataFrame,
                     columns: Sequence[str] = ("refnis", "province", "region",
                                               "municipality")) -> DataFrame:
    """Fill only the missing geography columns from the postal code."""
    dim = _prefixed(crosswalk_by_postcode(xw), "_x_")
    keyed = df.withColumn("postal_code", text.postal_key(F.col("postal_code")))
    out = keyed.join(dim, keyed["postal_code"] == dim["_x_postal_code"], "left")
    filled = {c: F.coalesce(F.col(c), F.col(f"_x_{c}")) if c in df.columns
              else F.col(f"_x_{c}") for c in columns}
    return out.withColumns(filled).drop(*dim.columns)


def finalize(df: DataFrame, xw: DataFrame) -> DataFrame:
    """Derived category and price per m² plus crosswalk geography."""
    ratio = F.when((F.col("price") != 0) & (F.col("livable_surface") > 0),
                   F.bround(F.col("price") / F.col("livable_surface"), 2))
    return crosswalk_enrich(df.withColumns({
        "category": F.coalesce("category", text.category_of(F.col("property_type"))),
        "price_per_sqm": F.coalesce(ratio, F.col("price_per_sqm")),
    }), xw)


def resolve_locality(df: DataFrame, xw: DataFrame, postcode: str, name: str) -> DataFrame:
    """Crosswalk row by postal code, else by municipality name, with the basis used.

    Adds ``res_postcode``, ``res_municipality``, ``res_province``, ``res_region``,
    ``res_basis``.
    """
    by_pc, by_name = _prefixed(crosswalk_by_postcode(xw), "_p_"), _prefixed(
        crosswalk_by_name(xw), "_n_")
    keyed = df.withColumns({"_pc": text.postcode(F.col(postcode)),
                            "_nm": F.lower(F.trim(F.col(name)))})
    out = keyed.join(by_pc, F.col("_pc") == F.col("_p_postal_code"), "left")
    # a name is only looked up where the postal code gave nothing
    out = out.withColumn("_nm", F.when(F.col("_p_refnis").isNull(), F.col("_nm")))
    out = out.join(by_name, F.col("_nm") == F.col("_n_name"), "left")
    pick = {f"res_{c}": F.coalesce(f"_p_{c}", f"_n_{c}") for c in ("province", "region")}
    return out.withColumns({
        "res_postcode": F.coalesce("_pc", "_n_postal_code"),
        "res_municipality": F.coalesce("_p_municipality", "_n_municipality", F.col(name)),
        **pick,
        "res_basis": F.when(F.col("_p_refnis").isNotNull(), "postcode")
        .when(F.col("_n_refnis").isNotNull(), "name").otherwise("none"),
    }).drop("_pc", "_nm", *by_pc.columns, *by_name.columns)


def resolve_refnis(df: DataFrame, xw: DataFrame) -> DataFrame:
    """Municipality code from the row, else the postal code; geography from the code.

    Rows that stay without a code are dropped; province and region are re-derived.
    """
    by_pc = _prefixed(crosswalk_by_postcode(xw), "_p_").select("_p_postal_code", "_p_refnis")
    by_ref = _prefixed(crosswalk_by_refnis(xw), "_g_").select("_g_refnis", "_g_province",
                                                              "_g_region")
    # only rows without a code need the postal look-up
    key = F.when(F.col("refnis").isNull(), text.postcode(F.col("postal_code")))
    out = df.withColumn("_k", key)
    out = out.join(by_pc, F.col("_k") == F.col("_p_postal_code"), "left")
    out = (out.withColumn("refnis", F.coalesce(F.col("refnis"), F.col("_p_refnis")))
           .filter(F.col("refnis").isNotNull()))
    out = out.join(by_ref, F.col("refnis") == F.col("_g_refnis"), "left")
    return (out.withColumns({"province": F.col("_g_province"), "region": F.col("_g_region")})
            .drop("_k", *by_pc.columns, *by_ref.columns))


def recover_urls(df: DataFrame, urls: DataFrame, key: str = "listing_id") -> DataFrame:
    """URL of each listing from a (property_id, url) table; the last row per id wins."""
    one = first_per_key(urls, ["property_id"], [F.col("url").desc_nulls_last()])
    one = one.select(F.col("property_id").cast("string").alias("_u_id"),
                     F.col("url").alias("_u_url"))
    out = df.join(one, df[key] == one["_u_id"], "left")
    url = F.coalesce("url", "_u_url") if "url" in df.columns else F.col("_u_url")
    return out.withColumn("url", url).drop("_u_id", "_u_url")


def centroids(df: DataFrame, key: str, point: str) -> DataFrame:
    """Mean of ``"lat, lon"`` texts per municipality, five digits; bad points skipped."""
    lat = F.trim(F.split_part(F.col(point), F.lit(","), F.lit(1))).try_cast("double")
    lon = F.trim(F.split_part(F.col(point), F.lit(","), F.lit(2))).try_cast("double")
    pts = df.select(F.col(key).alias("refnis"), lat.alias("lat"), lon.alias("lon"))
    return (pts.dropna(subset=["lat", "lon"]).groupBy("refnis")
            .agg(F.round(F.avg("lat"), 5).alias("lat"), F.round(F.avg("lon"), 5).alias("lon")))


def centroid_attributes(cents: DataFrame, xw: DataFrame) -> DataFrame:
    """Centroids with municipality name, province and region."""
    attrs = crosswalk_by_refnis(xw).drop("postal_code")
    return cents.join(attrs, "refnis", "left")


def unseen(df: DataFrame, seen: DataFrame, key: str = "url") -> DataFrame:
    """Rows whose key is not in the seen table."""
    return df.join(seen.select(key).distinct(), key, "left_anti")


def mark_seen(seen: DataFrame, new: DataFrame, key: str = "url") -> DataFrame:
    """Seen keys after an insert-or-ignore of the new ones."""
    fresh = first_per_key(new.dropna(subset=[key]), [key],
                          [F.col(c).asc_nulls_last() for c in seen.columns if c != key])
    return seen.unionByName(unseen(fresh, seen, key).select(seen.columns))


def province_centroids(spark: SparkSession) -> DataFrame:
    """The constant list of provinces with centroid and region (eleven rows)."""
    return spark.createDataFrame(S.PROVINCE_CENTROIDS,
                                 "c_province string, c_lat double, c_lon double, c_region string")


def fill_geo(df: DataFrame) -> DataFrame:
    """Missing coordinates and region from the province; adds ``geo_basis``."""
    dim = F.broadcast(province_centroids(df.sparkSession))  # eleven constant rows
    out = df.join(dim, df["province"] == dim["c_province"], "left")
    exact = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    region = F.coalesce("region", "c_region",
                        F.when(F.col("province").isNotNull(), "Flanders"))
    basis = (F.when(exact, "exact").when(F.col("c_lat").isNotNull(), "province")
             .otherwise("none"))
    return (out.withColumn("geo_basis", basis)
            .withColumns({"latitude": F.coalesce("latitude", "c_lat"),
                          "longitude": F.coalesce("longitude", "c_lon"), "region": region})
            .drop("c_province", "c_lat", "c_lon", "c_region"))


def resolve_addresses(df: DataFrame, xw: DataFrame, address: str) -> DataFrame:
    """Parts of a free-text address plus its crosswalk geography."""
    out = df.withColumn("_a", text.split_address(F.col(address)))
    out = out.select("*", "_a.street", "_a.house_number", "_a.postcode", "_a.city").drop("_a")
    return resolve_locality(out, xw, "postcode", "city")


def house_numbers(df: DataFrame, keys: Sequence[str], number: str = "house_number") -> DataFrame:
    """Distinct house numbers per street in numeric-aware order, one row each.

    Rows instead of one array per street, so that a street's numbers are never gathered
    into a single value; ``position`` gives the order.
    """
    from pyspark.sql import Window

    nums = (df.select(*keys, text.clean_string(F.col(number)).alias(number))
            .dropna(subset=[number]).distinct())
    lead = F.nullif(F.regexp_extract(number, r"^\s*(\d+)", 1), F.lit("")).try_cast("bigint")
    order = [F.coalesce(lead, F.lit(10 ** 9)).asc(), F.col(number).asc()]
    return nums.withColumn("position", F.row_number().over(
        Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
