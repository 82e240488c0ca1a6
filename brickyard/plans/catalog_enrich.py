"""Queries: look-up joins, seeding, addresses, ingest counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickyard import schema as S
from brickyard.operators import enrich
from brickyard.plans.bind import CROSSWALK, LISTINGS, crosswalk, listings, table
from brickyard.plans.registry import query
from brickyard.sources import store

L = f"WITH l AS ({LISTINGS}), xw AS ({CROSSWALK})"


def _gappy(spark: SparkSession, sf: str) -> DataFrame:
    """Listings with geography missing in two of three municipalities."""
    miss = F.col("refnis") % 3
    return listings(spark, sf).withColumns({
        "municipality": F.when(miss == 0, F.col("municipality")),
        "province": F.when(miss != 2, F.col("province")),
        "region": F.when(miss != 1, F.col("region")),
        "refnis": F.when(miss == 0, F.col("refnis")),
        "postal_code": F.concat(F.lit("B-"), "postal_code")})


@query("crosswalk_enrich", L + """
SELECT listing_id, postal_code, refnis, municipality, province, region FROM l""")
def crosswalk_enrich(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.crosswalk_enrich(_gappy(spark, sf), crosswalk(spark, sf)).select(
        "listing_id", "postal_code", "refnis", "municipality", "province", "region")


@query("crosswalk_dims", L + """
SELECT 'postcode' AS dim, postal_code AS key, refnis, municipality_nl AS municipality, province, region FROM xw
UNION ALL SELECT 'refnis', cast(refnis AS varchar), refnis, municipality_nl, province, region FROM xw
UNION ALL SELECT 'name', lower(municipality_nl), refnis, municipality_nl, province, region FROM xw""")
def crosswalk_dims(spark: SparkSession, sf: str) -> DataFrame:
    xw = crosswalk(spark, sf)
    # every municipality twice, the second time under a larger code
    twice = xw.unionByName(xw.withColumn("refnis", F.col("refnis") + 1_000_000).withColumn(
        "municipality_nl", F.concat(F.lit("other "), "municipality_nl")).withColumn(
        "municipality_fr", F.lit(None).cast("string")))
    cols = ["refnis", "municipality", "province", "region"]
    pc = enrich.crosswalk_by_postcode(twice).select(F.lit("postcode").alias("dim"),
                                                    F.col("postal_code").alias("key"), *cols)
    ref = enrich.crosswalk_by_refnis(xw).select(F.lit("refnis").alias("dim"),
                                                F.col("refnis").cast("string").alias("key"), *cols)
    name = enrich.crosswalk_by_name(xw).select(F.lit("name").alias("dim"),
                                               F.col("name").alias("key"), *cols)
    return pc.unionByName(ref).unionByName(name)


@query("resolve_locality", L + """
SELECT listing_id, CASE WHEN refnis % 4 = 3 THEN NULL ELSE postal_code END AS res_postcode,
  CASE WHEN refnis % 4 = 3 THEN 'Nowhere' ELSE municipality END AS res_municipality,
  CASE WHEN refnis % 4 = 3 THEN NULL ELSE province END AS res_province,
  CASE WHEN refnis % 4 = 3 THEN NULL ELSE region END AS res_region,
  CASE refnis % 4 WHEN 3 THEN 'none' WHEN 0 THEN 'postcode' ELSE 'name' END AS res_basis FROM l""")
def resolve_locality(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("refnis") % 4
    rows = listings(spark, sf).withColumns({
        "postal_code": F.when(kind == 0, F.concat(F.lit("BE "), "postal_code")),
        "municipality": F.when(kind == 3, "Nowhere").when(kind == 1, F.upper("municipality"))
        .otherwise(F.concat(F.lit(" "), F.lower("municipality")))})
    out = enrich.resolve_locality(rows, crosswalk(spark, sf), "postal_code", "municipality")
    return out.select("listing_id", "res_postcode",
                      "res_municipality", "res_province", "res_region", "res_basis")


@query("resolve_refnis", L + """
SELECT listing_id, refnis, province, region FROM l WHERE refnis % 4 <> 3""")
def resolve_refnis(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("refnis") % 4
    rows = listings(spark, sf).withColumns({
        "postal_code": F.when(kind != 3, F.col("postal_code")),
        "refnis": F.when(kind == 0, F.col("refnis"))})
    return enrich.resolve_refnis(rows, crosswalk(spark, sf)).select(
        "listing_id", "refnis", "province", "region")


@query("recover_urls", L + """
SELECT listing_id, CASE WHEN refnis % 2 = 0 THEN concat('https://seed/', listing_id) ELSE url END AS url
FROM l""")
def recover_urls(spark: SparkSession, sf: str) -> DataFrame:
    rows = listings(spark, sf)
    urls = rows.filter(F.col("refnis") % 2 == 0).select(
        F.col("listing_id").alias("property_id"),
        F.concat(F.lit("https://seed/"), "listing_id").alias("url"))
    blank = rows.withColumn("url", F.when(F.col("refnis") % 2 != 0, F.col("url")))
    return enrich.recover_urls(blank, urls).select("listing_id", "url")


@query("centroids", L + """
SELECT refnis, round(avg(latitude), 5) AS lat, round(avg(longitude), 5) AS lon FROM l
WHERE latitude IS NOT NULL GROUP BY refnis""")
def centroids(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.centroids(_point_texts(spark, sf), "refnis", "point")


def _point_texts(spark: SparkSession, sf: str) -> DataFrame:
    pair = F.concat_ws(", ", "latitude", "longitude")
    return listings(spark, sf).select(
        "refnis", F.when(F.col("latitude").isNotNull(), pair).otherwise("unknown, n/a").alias("point"))


@query("centroid_attrs", L + """
SELECT refnis, round(avg(latitude), 5) AS lat, round(avg(longitude), 5) AS lon,
  any_value(municipality) AS municipality, any_value(province) AS province, any_value(region) AS region
FROM l WHERE latitude IS NOT NULL GROUP BY refnis""")
def centroid_attrs(spark: SparkSession, sf: str) -> DataFrame:
    cents = enrich.centroids(_point_texts(spark, sf), "refnis", "point")
    return enrich.centroid_attributes(cents, crosswalk(spark, sf))


@query("unseen_urls", L + """
SELECT listing_id, url FROM l WHERE url IS NOT NULL
  AND url NOT IN (SELECT url FROM l WHERE source = 'site_a' AND url IS NOT NULL)""")
def unseen_urls(spark: SparkSession, sf: str) -> DataFrame:
    rows = listings(spark, sf).dropna(subset=["url"])
    return enrich.unseen(rows, rows.filter(F.col("source") == "site_a")).select("listing_id", "url")


_CENTROIDS = "c(province, lat, lon, creg) AS (VALUES " + ", ".join(
    f"('{p}', {a}E0, {b}E0, '{r}')" for p, a, b, r in S.PROVINCE_CENTROIDS) + ")"
_NAMES = [p for p, *_ in S.PROVINCE_CENTROIDS]


@query("fill_geo", L + ", " + _CENTROIDS + f"""
, g AS (SELECT listing_id, latitude, longitude,
  {_NAMES!r}[refnis % 13 + 1] AS province FROM l)
SELECT listing_id, g.province, coalesce(g.latitude, c.lat) AS latitude, coalesce(g.longitude, c.lon) AS longitude,
  coalesce(c.creg, CASE WHEN g.province IS NOT NULL THEN 'Flanders' END) AS region,
  CASE WHEN g.latitude IS NOT NULL THEN 'exact' WHEN c.lat IS NOT NULL THEN 'province' ELSE 'none' END AS geo_basis
FROM g LEFT JOIN c ON c.province = g.province""")
def fill_geo(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in _NAMES])
    rows = listings(spark, sf).select(
        "listing_id", "latitude", "longitude", F.lit(None).cast("string").alias("region"),
        F.get(names, (F.col("refnis") % 13).cast("int")).alias("province"))
    return enrich.fill_geo(rows).select("listing_id", "province", "latitude", "longitude",
                                        "region", "geo_basis")


@query("seed_listings", L + """
SELECT listing_id, 'seed' AS source, CASE WHEN refnis % 2 = 0 THEN concat('https://seed/', listing_id) END AS url,
  market, postal_code, refnis, municipality, province, region, price, livable_surface,
  price / livable_surface AS price_per_sqm, cast(NULL AS varchar) AS house_number FROM l""")
def seed_listings(spark: SparkSession, sf: str) -> DataFrame:
    rows = listings(spark, sf)
    cleaned = rows.select(
        F.col("listing_id").alias("property_id"), "market", "postal_code", "price",
        "livable_surface", F.col("municipality").alias("locality"),
        F.when(F.col("refnis") % 3 == 0, F.col("province")).alias("province"),
        F.when(F.col("refnis") % 3 == 1, F.col("region")).alias("region"))
    urls = rows.filter(F.col("refnis") % 2 == 0).select(
        F.col("listing_id").alias("property_id"),
        F.concat(F.lit("https://seed/"), "listing_id").alias("url"))
    return store.seed_listings(cleaned, urls, crosswalk(spark, sf)).select(
        "listing_id", "source", "url", "market", "postal_code", "refnis", "municipality",
        "province", "region", "price", "livable_surface", "price_per_sqm", "house_number")


@query("resolve_addresses", L + """
SELECT listing_id, street, house_number, postal_code AS postcode, municipality AS city,
  municipality AS res_municipality, province AS res_province, region AS res_region FROM l""")
def resolve_addresses(spark: SparkSession, sf: str) -> DataFrame:
    label = F.concat("street", F.lit(" "), "house_number", F.lit(", "), "postal_code",
                     F.lit(" "), "municipality")
    rows = listings(spark, sf).select("listing_id", label.alias("address"))
    return enrich.resolve_addresses(rows, crosswalk(spark, sf), "address").select(
        "listing_id", "street", "house_number", "postcode", "city", "res_municipality",
        "res_province", "res_region")


@query("house_numbers", L + """
SELECT street, municipality, house_number, row_number() OVER (PARTITION BY street, municipality
  ORDER BY cast(house_number AS bigint), house_number) AS position
FROM (SELECT DISTINCT street, municipality, house_number FROM l) q""")
def house_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.house_numbers(listings(spark, sf), ["street", "municipality"])


@query("ingest_funnel", """
SELECT event_type AS source, count(*) AS found, count(*) FILTER (WHERE user_id % 5 = 0) AS already_seen,
  count(*) FILTER (WHERE user_id % 5 <> 0) AS fetched,
  count(*) FILTER (WHERE user_id % 5 <> 0 AND value > 5) AS parsed,
  count(*) FILTER (WHERE user_id % 5 <> 0 AND value > 5 AND event_id % 2 = 0) AS written
FROM events GROUP BY 1""")
def ingest_funnel(spark: SparkSession, sf: str) -> DataFrame:
    from brickyard.operators.extract import ingest_funnel as job

    seen = F.col("user_id") % 5 == 0
    log = table(spark, sf, "events").select(
        F.col("event_type").alias("source"), seen.alias("seen"), (~seen).alias("fetched"),
        (~seen & (F.col("value") > 5)).alias("parsed"),
        (~seen & (F.col("value") > 5) & (F.col("event_id") % 2 == 0)).alias("written"))
    return job(log)
