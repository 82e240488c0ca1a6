"""Star-schema tables read as property data: listings, price history, crosswalk.

Each binding has a DataFrame form for the jobs and a SQL form for the comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brickyard.operators.quantiles import group_medians


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal a small fact table out to all cores.

    A table of one row group is read by one task whatever the number of cores. Tables with
    at least one scan task per core, such as any large one, are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def listings(spark: SparkSession, sf_dir: str, items: DataFrame | None = None) -> DataFrame:
    """One listing per line item (batch or stream), located by supplier, nation and region."""
    li = items if items is not None else spread(table(spark, sf_dir, "lineitem"))
    part = table(spark, sf_dir, "part")
    geo = (table(spark, sf_dir, "supplier")
           .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
           .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")))
    df = (li.join(part, F.col("l_partkey") == F.col("p_partkey"))
          .join(geo, F.col("l_suppkey") == F.col("s_suppkey")))
    text = {k: F.col(k).cast("string") for k in
            ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")}
    located = F.col("l_orderkey") % 17 != 0
    sale = F.col("l_linestatus") == "O"
    return df.select(
        F.concat_ws("-", *text.values()).alias("listing_id"),
        F.when(F.col("l_returnflag") == "A", "site_a").when(F.col("l_returnflag") == "N", "site_b")
        .otherwise("site_c").alias("source"),
        F.when(F.col("l_orderkey") % 13 != 0,
               F.concat(F.lit("https://x/"), F.concat_ws("/", text["l_partkey"],
                                                         text["l_suppkey"],
                                                         text["l_linenumber"]))).alias("url"),
        F.when(sale, "sale").otherwise("rent").alias("market"),
        F.col("l_shipdate").alias("scraped_at"),
        F.col("p_name").alias("street"), text["l_linenumber"].alias("house_number"),
        (F.col("l_suppkey") + 1000).cast("string").alias("postal_code"),
        F.col("s_name").alias("municipality"), F.col("l_suppkey").cast("bigint").alias("refnis"),
        F.col("n_name").alias("province"), F.col("r_name").alias("region"),
        F.when(located, 49.5 + ((F.col("l_suppkey") * 104729 + F.col("l_partkey") * 31)
                                % 20011).cast("double") / 10000.0).alias("latitude"),
        F.when(located, 2.6 + ((F.col("l_suppkey") * 15485863 + F.col("l_partkey") * 37
                                + F.col("l_orderkey") * 3) % 37003).cast("double")
               / 10000.0).alias("longitude"),
        F.col("l_quantity").alias("livable_surface"),
        (F.col("p_size") % 6).cast("bigint").alias("bedrooms"),
        F.col("p_type").alias("property_type"),
        F.when(F.col("p_type").isin("SMALL", "ECONOMY", "STANDARD"), "apartment")
        .otherwise("house").alias("category"),
        F.when(sale, F.col("l_extendedprice")).otherwise(F.col("l_extendedprice") * 0.005)
        .alias("price"),
    )


LISTINGS = """
SELECT concat(cast(l_orderkey AS varchar(40)),'-',cast(l_linenumber AS varchar(40)),'-',
         cast(l_partkey AS varchar(40)),'-',cast(l_suppkey AS varchar(40))) AS listing_id,
  CASE l_returnflag WHEN 'A' THEN 'site_a' WHEN 'N' THEN 'site_b' ELSE 'site_c' END AS source,
  CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE concat('https://x/',cast(l_partkey AS varchar(40)),
    '/',cast(l_suppkey AS varchar(40)),'/',cast(l_linenumber AS varchar(40))) END AS url,
  CASE l_linestatus WHEN 'O' THEN 'sale' ELSE 'rent' END AS market,
  l_shipdate AS scraped_at,
  p_name AS street, cast(l_linenumber AS varchar(40)) AS house_number,
  cast(1000 + l_suppkey AS varchar(40)) AS postal_code,
  s_name AS municipality, cast(l_suppkey AS bigint) AS refnis, n_name AS province,
  r_name AS region,
  CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE 49.5E0 +
    cast((l_suppkey * 104729 + l_partkey * 31) % 20011 AS double) / 10000E0 END AS latitude,
  CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE 2.6E0 +
    cast((l_suppkey * 15485863 + l_partkey * 37 + l_orderkey * 3) % 37003 AS double)
    / 10000E0 END AS longitude,
  l_quantity AS livable_surface, cast(p_size % 6 AS bigint) AS bedrooms,
  p_type AS property_type,
  CASE WHEN p_type IN ('SMALL','ECONOMY','STANDARD') THEN 'apartment' ELSE 'house' END
    AS category,
  CASE l_linestatus WHEN 'O' THEN l_extendedprice ELSE l_extendedprice * 0.005E0 END AS price
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""


def dup_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings plus re-listed sale copies at other prices on two more sites."""
    base = listings(spark, sf_dir)
    cols = ["listing_id", "source", "price", "url", "latitude", "longitude",
            "livable_surface", "bedrooms", "postal_code", "street", "house_number", "market",
            "epc"]

    def copy(suffix: str, source: str, factor: float, url, every: int, epc) -> Column:
        row = F.struct(F.concat("listing_id", F.lit(suffix)).alias("listing_id"),
                       F.lit(source).alias("source"), (F.col("price") * factor).alias("price"),
                       url.alias("url"), epc.alias("epc"))
        return F.when((F.col("refnis") % every == 0) & (F.col("market") == "sale"), row)

    none = F.lit(None).cast("string")
    own = F.struct("listing_id", "source", "price", "url",
                   F.when(F.col("refnis") % 2 == 0, "B").alias("epc"))
    rows = F.array(own, copy("-d1", "site_d", 1.03, F.concat("listing_id", F.lit("/d1")), 5,
                             F.lit("C")),
                   copy("-d2", "site_e", 1.07, none, 10, none))
    # one pass over the joined tables, whatever the number of copies
    changed = ["listing_id", "source", "price", "url", "epc"]
    return (base.select(*[c for c in cols if c not in changed],
                        F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("_c"))
            .select(*[F.col(f"_c.{c}").alias(c) if c in changed else c for c in cols]))


DUP_LISTINGS = f"""
SELECT listing_id, source, price, url, latitude, longitude, livable_surface, bedrooms,
  postal_code, street, house_number, market, epc
FROM (SELECT *, CASE WHEN refnis % 2 = 0 THEN 'B' ELSE NULL END AS epc FROM ({LISTINGS}) l0) q0
UNION ALL
SELECT concat(listing_id,'-d1'), 'site_d', price * 1.03E0, concat(listing_id,'/d1'), latitude,
  longitude, livable_surface, bedrooms, postal_code, street, house_number, market, 'C'
FROM ({LISTINGS}) l1 WHERE refnis % 5 = 0 AND market = 'sale'
UNION ALL
SELECT concat(listing_id,'-d2'), 'site_e', price * 1.07E0, NULL, latitude, longitude,
  livable_surface, bedrooms, postal_code, street, house_number, market, NULL
FROM ({LISTINGS}) l2 WHERE refnis % 10 = 0 AND market = 'sale'
"""


def price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly median price per (municipality, type) from the orders."""
    rows = (table(spark, sf_dir, "orders")
            .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
            .filter(F.col("o_orderkey") % 11 != F.col("c_nationkey") % 11)
            .select(F.col("c_nationkey").cast("bigint").alias("refnis"),
                    F.when(F.col("c_mktsegment") == "BUILDING", "apartments")
                    .otherwise("houses_all").alias("property_type"),
                    F.year("o_orderdate").cast("bigint").alias("year"), "o_totalprice"))
    return group_medians(rows, ["refnis", "property_type", "year"],
                         {"median_price_eur": F.col("o_totalprice")})


PRICE_HISTORY = """
SELECT cast(c_nationkey AS bigint) AS refnis,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'apartments' ELSE 'houses_all' END AS property_type,
  cast(year(o_orderdate) AS bigint) AS year, median(o_totalprice) AS median_price_eur
FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderkey % 11 <> c_nationkey % 11 GROUP BY 1,2,3
"""


def crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postal code to municipality, province and region; several rows per code."""
    return (table(spark, sf_dir, "supplier")
            .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("s_suppkey").cast("bigint").alias("refnis"),
                    (F.lit(1000) + F.col("s_suppkey")).cast("string").alias("postal_code"),
                    F.col("s_name").alias("municipality_nl"),
                    F.when(F.col("s_suppkey") % 3 != 0, F.upper("s_name"))
                    .alias("municipality_fr"),
                    F.col("n_name").alias("province"), F.col("r_name").alias("region")))


CROSSWALK = """
SELECT cast(s_suppkey AS bigint) AS refnis, cast(1000 + s_suppkey AS varchar) AS postal_code,
  s_name AS municipality_nl,
  CASE WHEN s_suppkey % 3 <> 0 THEN upper(s_name) END AS municipality_fr,
  n_name AS province, r_name AS region
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

# Guarded points of the price surface, shared by several comparisons.
POINTS = f"""
SELECT market, listing_id, latitude, longitude, refnis, province, region,
  price / livable_surface AS price_per_sqm
FROM ({LISTINGS}) l
WHERE livable_surface > 0 AND latitude IS NOT NULL AND longitude IS NOT NULL
  AND ((market = 'sale' AND price / livable_surface BETWEEN 400 AND 18000)
    OR (market = 'rent' AND price / livable_surface BETWEEN 3 AND 70))
"""
