"""Queries: scans, projections, filters, scalar functions on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickyard import schema as S
from brickyard.functions import geo, money, text
from brickyard.operators import clean
from brickyard.operators.dedup import (blocking_key, dedup_by_url, first_per_key)
from brickyard.plans.bind import DUP_LISTINGS, LISTINGS, dup_listings, listings, table
from brickyard.plans.registry import query
from brickyard.sources import store

L = f"WITH l AS ({LISTINGS}) "
D = f"WITH d AS ({DUP_LISTINGS}) "


# -- scans -------------------------------------------------------------------
@query("scan_listings", L + """
SELECT listing_id, source, market, url, price, livable_surface, latitude, longitude FROM l
WHERE market = 'sale'""")
def scan_listings(spark: SparkSession, sf: str) -> DataFrame:
    return (listings(spark, sf).filter(F.col("market") == "sale")
            .select("listing_id", "source", "market", "url", "price", "livable_surface",
                    "latitude", "longitude"))


@query("total_size", L + "SELECT market, count(*) AS n FROM l GROUP BY market")
def total_size(spark: SparkSession, sf: str) -> DataFrame:
    return store.total_size(listings(spark, sf))


@query("pool_size", L + """
SELECT market, count(*) AS n FROM l
WHERE price IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY market""")
def pool_size(spark: SparkSession, sf: str) -> DataFrame:
    return store.total_size(clean.usable(listings(spark, sf)))


@query("dataset_stats", L + """
SELECT market, count(*) AS n_total,
  count(*) FILTER (WHERE price IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL)
    AS n_pool,
  count(*) FILTER (WHERE cast(concat('0x', substr(md5(listing_id), 1, 8)) AS BIGINT) % 100 >= 20)
    AS n_train,
  count(*) FILTER (WHERE cast(concat('0x', substr(md5(listing_id), 1, 8)) AS BIGINT) % 100 < 20)
    AS n_test
FROM l GROUP BY market""")
def dataset_stats(spark: SparkSession, sf: str) -> DataFrame:
    from brickyard.operators.model import split_bucket

    usable = F.col("price").isNotNull() & F.col("latitude").isNotNull() & F.col(
        "longitude").isNotNull()
    test = split_bucket(F.col("listing_id")) < 20
    return listings(spark, sf).groupBy("market").agg(
        F.count("*").alias("n_total"), F.count_if(usable).alias("n_pool"),
        F.count_if(~test).alias("n_train"), F.count_if(test).alias("n_test"))


# -- canonical form ----------------------------------------------------------
@query("canonicalize", L + """
SELECT listing_id, source, nullif(trim(url), '') AS url, market, street, house_number,
  postal_code, municipality, refnis, province, region, latitude, longitude, livable_surface,
  cast(bedrooms AS double) AS bedrooms, property_type, category, price,
  cast(NULL AS double) AS bathrooms, cast(NULL AS integer) AS terrace,
  cast(NULL AS varchar) AS epc
FROM l""")
def canonicalize(spark: SparkSession, sf: str) -> DataFrame:
    full = clean.canonicalize(listings(spark, sf))
    return full.select("listing_id", "source", "url", "market", "street", "house_number",
                       "postal_code", "municipality", "refnis", "province", "region",
                       "latitude", "longitude", "livable_surface", "bedrooms",
                       "property_type", "category", "price", "bathrooms", "terrace", "epc")


@query("clean_strings", L + """
SELECT listing_id,
  nullif(trim(CASE WHEN refnis % 4 = 0 THEN '   ' ELSE concat('  ', street, ' ') END), '')
    AS street,
  cast(cast(livable_surface AS bigint) AS varchar) AS surface_text
FROM l""")
def clean_strings(spark: SparkSession, sf: str) -> DataFrame:
    dirty = F.when(F.col("refnis") % 4 == 0, "   ").otherwise(
        F.concat(F.lit("  "), "street", F.lit(" ")))
    return listings(spark, sf).select(
        "listing_id", text.clean_string(dirty).alias("street"),
        text.number_as_text(F.col("livable_surface")).alias("surface_text"))


@query("replace_province", L + """
SELECT listing_id, CASE WHEN refnis % 3 = 0 THEN 'Brussels' WHEN refnis % 3 = 1 THEN 'Liège'
  ELSE province END AS province FROM l""")
def replace_province(spark: SparkSession, sf: str) -> DataFrame:
    spelled = (F.when(F.col("refnis") % 3 == 0, "Brussels-Capital")
               .when(F.col("refnis") % 3 == 1, "Liege").otherwise(F.col("province")))
    return listings(spark, sf).select("listing_id", clean.fix_province(spelled).alias("province"))


@query("ppsqm_guard", L + """
SELECT listing_id, market, price / livable_surface AS price_per_sqm FROM l
WHERE livable_surface > 0 AND latitude IS NOT NULL AND longitude IS NOT NULL
  AND ((market = 'sale' AND price / livable_surface BETWEEN 400 AND 18000)
    OR (market = 'rent' AND price / livable_surface BETWEEN 3 AND 70))""")
def ppsqm_guard(spark: SparkSession, sf: str) -> DataFrame:
    from brickyard.plans.surface import surface_points

    return surface_points(listings(spark, sf)).select("listing_id", "market", "price_per_sqm")


@query("roi_guard", L + """
SELECT listing_id, market, refnis, category, price, price / livable_surface AS ppsqm FROM l
WHERE category IN ('house', 'apartment') AND livable_surface BETWEEN 9 AND 3000
  AND ((market = 'sale' AND price BETWEEN 25000 AND 15000000
        AND price / livable_surface BETWEEN 400 AND 18000)
    OR (market = 'rent' AND price BETWEEN 200 AND 25000
        AND price / livable_surface BETWEEN 3 AND 70))""")
def roi_guard(spark: SparkSession, sf: str) -> DataFrame:
    return clean.roi_guard(listings(spark, sf)).select(
        "listing_id", "market", "refnis", "category", "price", "ppsqm")


@query("target_bounds", L + """
SELECT listing_id, market, price FROM l
WHERE (market = 'sale' AND price BETWEEN 25000 AND 5000000)
   OR (market = 'rent' AND price BETWEEN 200 AND 12000)""")
def target_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return clean.target_guard(listings(spark, sf)).select("listing_id", "market", "price")


@query("null_impossible", L + """
SELECT listing_id,
  CASE WHEN livable_surface - 5 > 0 THEN livable_surface - 5 END AS livable_surface,
  CASE WHEN refnis * 20 BETWEEN 0 AND 1500 THEN refnis * 20 END AS primary_energy_consumption,
  CASE WHEN 1700 + refnis * 5 BETWEEN 1750 AND 2031 THEN 1700 + refnis * 5 END AS build_year,
  CASE WHEN bedrooms * 4 <= 15 THEN bedrooms * 4 END AS bedrooms
FROM l""")
def null_impossible(spark: SparkSession, sf: str) -> DataFrame:
    wild = listings(spark, sf).select(
        "listing_id", (F.col("livable_surface") - 5).alias("livable_surface"),
        (F.col("refnis") * 20).alias("primary_energy_consumption"),
        (F.col("refnis") * 5 + 1700).alias("build_year"),
        (F.col("bedrooms") * 4).alias("bedrooms"))
    return clean.null_impossible(wild)


@query("binary_flags", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  cast(trunc(least(greatest(l_linenumber - 3, 0), 1)) AS integer) AS terrace,
  CASE WHEN l_returnflag = 'A' THEN 0 WHEN l_discount * 20 >= 1 THEN 1 ELSE 0 END AS garden,
  0 AS elevator
FROM lineitem""")
def binary_flags(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (F.col("l_linenumber") - 3).alias("terrace"),
        F.when(F.col("l_returnflag") != "A", (F.col("l_discount") * 20).cast("string"))
        .alias("garden"), F.col("l_returnflag").alias("elevator"))
    return clean.binary_flags(raw)


@query("price_per_sqm", L + """
SELECT listing_id, CASE WHEN livable_surface - 3 > 0 THEN price / (livable_surface - 3) END
  AS price_per_sqm FROM l""")
def price_per_sqm(spark: SparkSession, sf: str) -> DataFrame:
    return listings(spark, sf).select("listing_id", money.price_per_sqm(
        F.col("price"), F.col("livable_surface") - 3).alias("price_per_sqm"))


_SLUGS = ["apartment", "Manor_House", "KOT", "Rez-de-chaussée", "tent", "Villa "]


@query("category_from_type", L + """
, t AS (SELECT listing_id, ['flat','masterHouse','studentFlat','groundFloor',NULL,'villa'][bedrooms + 1]
  AS property_type, ['apartment','Manor_House','KOT','Rez-de-chaussée','tent','Villa '][bedrooms + 1]
  AS word FROM l)
SELECT listing_id, property_type,
  CASE WHEN property_type IN ('flat','studentFlat','groundFloor') THEN 'apartment'
       WHEN property_type IS NOT NULL THEN 'house' END AS category,
  CASE WHEN word = 'apartment' THEN 'apartment' ELSE 'house' END AS return_category
FROM t""")
def category_from_type(spark: SparkSession, sf: str) -> DataFrame:
    word = F.get(F.array(*[F.lit(w) for w in _SLUGS]), F.col("bedrooms").cast("int"))
    return (listings(spark, sf).select("listing_id", word.alias("word"))
            .withColumn("property_type", text.map_vocabulary(F.col("word"), text.PROPERTY_TYPES))
            .select("listing_id", "property_type",
                    text.category_of(F.col("property_type")).alias("category"),
                    text.category_of_prefix(F.col("word")).alias("return_category")))


@query("fill_defaults", L + """
SELECT listing_id, cast(CASE WHEN bedrooms < 4 THEN bedrooms ELSE 2 END AS double) AS bedrooms,
  coalesce(latitude, 50.85E0) AS latitude, coalesce(longitude, 4.35E0) AS longitude,
  1995E0 AS build_year, 'C' AS epc, 'Gas' AS heating_type, 0 AS terrace,
  50E0 AS neighbourhood_price_index
FROM l""")
def fill_defaults(spark: SparkSession, sf: str) -> DataFrame:
    gaps = listings(spark, sf).withColumn(
        "bedrooms", F.when(F.col("bedrooms") < 4, F.col("bedrooms").cast("double")))
    return clean.fill_defaults(gaps).select(
        "listing_id", "bedrooms", "latitude", "longitude", "build_year", "epc",
        "heating_type", "terrace", "neighbourhood_price_index")


@query("missingness", D + """
, n AS (SELECT count(*) AS n, count(url) AS url, count(latitude) AS latitude,
  count(longitude) AS longitude, count(epc) AS epc, count(price) AS price FROM d)
SELECT column_name, missing_share FROM (
  SELECT 'url' AS column_name, (n - url) / n AS missing_share FROM n
  UNION ALL SELECT 'latitude', (n - latitude) / n FROM n
  UNION ALL SELECT 'longitude', (n - longitude) / n FROM n
  UNION ALL SELECT 'epc', (n - epc) / n FROM n
  UNION ALL SELECT 'price', (n - price) / n FROM n) q
WHERE missing_share > 0 ORDER BY 2 DESC, 1 LIMIT 5""")
def missingness(spark: SparkSession, sf: str) -> DataFrame:
    return clean.missingness(dup_listings(spark, sf),
                             ["url", "latitude", "longitude", "epc", "price"])


_COUNTED = ["listing_id", "source", "url", "latitude", "longitude", "livable_surface",
            "bedrooms", "postal_code", "street", "house_number", "market", "epc", "price"]


@query("count_filled", D + """
SELECT listing_id, 11 - (CASE WHEN latitude IS NULL THEN 2 ELSE 0 END)
  + (CASE WHEN url IS NULL THEN 0 ELSE 1 END) + (CASE WHEN epc IS NULL THEN 0 ELSE 1 END)
  AS n_filled FROM d""")
def count_filled(spark: SparkSession, sf: str) -> DataFrame:
    return dup_listings(spark, sf).select("listing_id",
                                          clean.count_filled(_COUNTED).alias("n_filled"))


@query("prediction_band", L + """
SELECT listing_id, market, price AS prediction,
  greatest(0E0, price - CASE market WHEN 'sale' THEN 75891E0 ELSE 203.3E0 END) AS low,
  price + CASE market WHEN 'sale' THEN 75891E0 ELSE 203.3E0 END AS high,
  CASE market WHEN 'rent' THEN 'per month' ELSE 'total' END AS unit
FROM l""")
def prediction_band(spark: SparkSession, sf: str) -> DataFrame:
    mae = F.when(F.col("market") == "sale", F.lit(75891.0)).otherwise(F.lit(203.3))
    low, high = money.band(F.col("price"), mae)
    return listings(spark, sf).select(
        "listing_id", "market", F.col("price").alias("prediction"), low.alias("low"),
        high.alias("high"), F.when(F.col("market") == "rent", "per month")
        .otherwise("total").alias("unit"))


# -- scalar text functions ---------------------------------------------------
@query("norm_key", """
SELECT doc_id, length(k) AS key_length, md5(k) AS key_md5 FROM (
  SELECT doc_id, regexp_replace(lower(strip_accents(text)), '[^a-z0-9]', '', 'g') AS k
  FROM documents) q""")
def norm_key(spark: SparkSession, sf: str) -> DataFrame:
    k = text.norm_key(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", F.length(k).cast("bigint").alias("key_length"), F.md5(k).alias("key_md5"))


@query("clean_numbers", L + """
SELECT listing_id, floor(price) AS price, livable_surface + 0.5 AS surface,
  floor(price) AS plain_price, round_even(livable_surface / 2, 0)::BIGINT AS half_even,
  cast(bedrooms AS double) AS first_number
FROM l""")
def clean_numbers(spark: SparkSession, sf: str) -> DataFrame:
    whole = F.floor("price").cast("bigint")
    euro = F.concat(F.lit("€ "), F.replace(F.format_number(whole, 0), F.lit(","), F.lit(".")),
                    F.lit(",50"))
    size = F.concat(F.col("livable_surface").cast("bigint").cast("string"), F.lit(",5 m²"))
    return listings(spark, sf).select(
        "listing_id", text.parse_price(euro).alias("price"),
        text.parse_surface(size).alias("surface"),
        text.parse_price(F.concat(whole.cast("string"), F.lit(".00"))).alias("plain_price"),
        text.first_int((F.col("livable_surface") / 2).cast("string")).alias("half_even"),
        text.first_number(F.concat(F.lit("about "), F.col("bedrooms").cast("string"),
                                   F.lit(" rooms"))).alias("first_number"))


_FLAG_WORDS = ["Yes", "nee", " OUI ", "2", "0", "maybe"]


@query("truthy_flags", L + """
SELECT listing_id, [1, 0, 1, 1, 0, NULL][bedrooms + 1] AS flag FROM l""")
def truthy_flags(spark: SparkSession, sf: str) -> DataFrame:
    word = F.get(F.array(*[F.lit(w) for w in _FLAG_WORDS]), F.col("bedrooms").cast("int"))
    return listings(spark, sf).select("listing_id", text.truthy_flag(word).alias("flag"))


@query("vocab_map", L + """
SELECT listing_id, ['flat','masterHouse','studentFlat','groundFloor',NULL,'villa'][bedrooms + 1]
    AS property_type,
  ['A','D','B','C','A',NULL][bedrooms + 1] AS building_state,
  ['Super equipped','Fully equipped','Partially equipped','Not equipped','Not equipped',NULL][bedrooms + 1]
    AS kitchen_equipment,
  ['Gas','Fuel oil','Electricity','Wood','Coal','Hot air'][bedrooms + 1] AS heating_type
FROM l""")
def vocab_map(spark: SparkSession, sf: str) -> DataFrame:
    words = {
        "property_type": _SLUGS,
        "building_state": ["AS_NEW", "To renovate", "Goed", "to refresh", "just renovated", "?"],
        "kitchen_equipment": ["HYPER_EQUIPPED", "installed", "semi equipped", "none",
                              "USA_UNINSTALLED", "gold"],
        "heating_type": ["gaz", "FUELOIL", "Électrique", "pellets", "charbon", "hot air"],
    }
    at = F.col("bedrooms").cast("int")
    return listings(spark, sf).select("listing_id", *[
        text.map_vocabulary(F.get(F.array(*[F.lit(w) for w in ws]), at),
                            text.VOCABULARIES[c]).alias(c) for c, ws in words.items()])


@query("epc_label", L + """
SELECT listing_id, ['A++','A+','B','G',NULL,'D'][bedrooms + 1] AS epc FROM l""")
def epc_label(spark: SparkSession, sf: str) -> DataFrame:
    words = [" a++", "A + (12)", " B ", "g", "BC", "D_12"]
    word = F.get(F.array(*[F.lit(w) for w in words]), F.col("bedrooms").cast("int"))
    return listings(spark, sf).select("listing_id", text.epc_label(word).alias("epc"))


@query("postcode", L + """
SELECT listing_id, CASE WHEN bedrooms = 0 THEN NULL ELSE substr(postal_code, 1, 4) END
  AS postcode FROM l""")
def postcode(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("bedrooms") == 0, F.lit("B-12 Gent")).otherwise(
        F.concat(F.lit("BE-"), "postal_code", F.lit(" "), "municipality"))
    return listings(spark, sf).select("listing_id", text.postcode(raw).alias("postcode"))


@query("haversine", L + """
SELECT listing_id, round(2 * 6371000E0 * asin(least(1E0, sqrt(
    pow(sin(radians(latitude - 50.85E0) / 2), 2) + cos(radians(50.85E0))
    * cos(radians(latitude)) * pow(sin(radians(longitude - 4.35E0) / 2), 2)))), 3) AS metres
FROM l WHERE latitude IS NOT NULL""")
def haversine(spark: SparkSession, sf: str) -> DataFrame:
    d = geo.haversine_m(F.lit(50.85), F.lit(4.35), F.col("latitude"), F.col("longitude"))
    return (listings(spark, sf).filter(F.col("latitude").isNotNull())
            .select("listing_id", F.round(d, 3).alias("metres")))


@query("granularity", L + """
SELECT listing_id, CASE WHEN price / 3 < 500 THEN 'street/block' WHEN price / 3 < 1500
    THEN 'neighbourhood' WHEN price / 3 < 5000 THEN 'district' WHEN price / 3 > 20000
    THEN 'municipality' ELSE 'area' END AS granularity FROM l""")
def granularity(spark: SparkSession, sf: str) -> DataFrame:
    return listings(spark, sf).select("listing_id",
                                      geo.granularity(F.col("price") / 3).alias("granularity"))


@query("spatial_cell", L + """
SELECT listing_id, concat(printf('%.1f', round_even(latitude * 10, 0) / 10), '_',
  printf('%.1f', round_even(longitude * 10, 0) / 10)) AS cell
FROM l WHERE latitude IS NOT NULL""")
def spatial_cell(spark: SparkSession, sf: str) -> DataFrame:
    return (listings(spark, sf).filter(F.col("latitude").isNotNull())
            .select("listing_id", geo.spatial_cell(F.col("latitude"), F.col("longitude"))
                    .alias("cell")))


@query("split_address", L + """
SELECT listing_id, street, house_number, postal_code AS postcode, municipality AS city,
  concat(street, ' ', house_number, ', ', postal_code, ' ', municipality) AS label FROM l""")
def split_address(spark: SparkSession, sf: str) -> DataFrame:
    label = text.address_label(*[F.col(c) for c in ("street", "house_number", "postal_code",
                                                    "municipality")])
    return (listings(spark, sf).select("listing_id", label.alias("label"))
            .withColumn("a", text.split_address(F.col("label")))
            .select("listing_id", "a.*", "label"))


@query("coalesce_alias", D + """
SELECT listing_id, coalesce(nullif(url, ''), nullif(epc, ''), listing_id) AS first_known FROM d""")
def coalesce_alias(spark: SparkSession, sf: str) -> DataFrame:
    from brickyard.operators.extract import first_alias

    doc = F.to_json(F.struct("url", "epc", F.col("listing_id").alias("id")))
    return dup_listings(spark, sf).select(
        "listing_id", first_alias(F.try_parse_json(doc), ["$.url", "$.epc", "$.id"])
        .alias("first_known"))


@query("gross_yield", L + """
SELECT listing_id, round(least(price * 0.004E0 * (1 + bedrooms) * 12 / price * 100, 9E0), 6)
    AS gross_yield_pct,
  CASE WHEN lower(region) LIKE '%wallon%' THEN 0.13E0 ELSE 0.125E0 END AS acquisition_rate
FROM l WHERE market = 'sale'""")
def gross_yield(spark: SparkSession, sf: str) -> DataFrame:
    rent = F.col("price") * 0.004 * (F.col("bedrooms") + 1)
    return (listings(spark, sf).filter(F.col("market") == "sale")
            .select("listing_id",
                    F.round(money.gross_yield_pct(rent, F.col("price")), 6)
                    .alias("gross_yield_pct"),
                    money.acquisition_rate(F.col("region")).alias("acquisition_rate")))


# -- distinct and keys -------------------------------------------------------
@query("exact_distinct", L + "SELECT DISTINCT refnis, category, bedrooms, source FROM l")
def exact_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return listings(spark, sf).select("refnis", "category", "bedrooms", "source").distinct()


@query("first_per_key", L + """
SELECT refnis, category, market, listing_id, price FROM (
  SELECT *, row_number() OVER (PARTITION BY refnis, category, market
    ORDER BY price, listing_id) AS rn FROM l) q WHERE rn = 1""")
def first_per_key_query(spark: SparkSession, sf: str) -> DataFrame:
    return first_per_key(listings(spark, sf), ["refnis", "category", "market"],
                         [F.col("price").asc(), F.col("listing_id").asc()]).select(
        "refnis", "category", "market", "listing_id", "price")


@query("dedup_by_url", L + """
SELECT listing_id, url, price FROM (
  SELECT *, row_number() OVER (PARTITION BY coalesce('u:' || url, 'i:' || listing_id)
    ORDER BY scraped_at, listing_id) AS rn FROM l) q WHERE rn = 1""")
def dedup_by_url_query(spark: SparkSession, sf: str) -> DataFrame:
    return dedup_by_url(listings(spark, sf),
                        [F.col("scraped_at").asc(), F.col("listing_id").asc()]).select(
        "listing_id", "url", "price")


@query("blocking_key", D + """
SELECT listing_id, postal_code AS block_postal,
  concat(regexp_replace(lower(strip_accents(street)), '[^a-z0-9]', '', 'g'), house_number)
    AS block_street,
  round_even(livable_surface / 5, 0) AS block_surface,
  cast(bedrooms AS double) AS block_bedrooms FROM d""")
def blocking_key_query(spark: SparkSession, sf: str) -> DataFrame:
    return dup_listings(spark, sf).select(
        "listing_id", *[c.alias(k) for k, c in blocking_key(dup_listings(spark, sf)).items()])
