"""Queries: price surface, nearest neighbours, tiles, comparables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickyard.functions import geo
from brickyard.operators.quantiles import group_medians, with_percentile
from brickyard.plans import comparables as comps
from brickyard.plans import surface
from brickyard.plans.bind import LISTINGS, POINTS, listings
from brickyard.plans.registry import query
from brickyard.session import written

P = f"WITH p AS ({POINTS})"


def _dist(a: str, b: str) -> str:
    return (f"2 * 6371000E0 * asin(least(1E0, sqrt(pow(sin(radians({b}.latitude - {a}.latitude) / 2), 2)"
            f" + cos(radians({a}.latitude)) * cos(radians({b}.latitude))"
            f" * pow(sin(radians({b}.longitude - {a}.longitude) / 2), 2))))")


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return surface.surface_points(listings(spark, sf))


# -- statistics of the surface -----------------------------------------------
@query("muni_stats", P + """
SELECT market, refnis, round(avg(price_per_sqm), 6) AS mean_ppsqm,
  round(sum(price_per_sqm), 4) AS sum_ppsqm, count(*) AS n FROM p GROUP BY 1, 2""")
def muni_stats(spark: SparkSession, sf: str) -> DataFrame:
    return surface.muni_stats(_points(spark, sf)).withColumns({
        "mean_ppsqm": F.round("mean_ppsqm", 6), "sum_ppsqm": F.round("sum_ppsqm", 4)})


@query("prov_median", P + """
SELECT market, province, median(price_per_sqm) AS median_ppsqm, count(*) AS n FROM p
GROUP BY GROUPING SETS ((market, province), (market))""")
def prov_median(spark: SparkSession, sf: str) -> DataFrame:
    return surface.area_medians(_points(spark, sf)).select(
        "market", F.col("area").alias("province"), "median_ppsqm", "n")


@query("eda_province", P + """
, m AS (SELECT market, province, median(price_per_sqm) AS median_ppsqm FROM p GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY median_ppsqm DESC, province) AS hi,
  row_number() OVER (PARTITION BY market ORDER BY median_ppsqm, province) AS lo FROM m)
SELECT market, province, median_ppsqm, CASE WHEN hi <= 3 THEN 'top' ELSE 'bottom' END AS side
FROM r WHERE hi <= 3 OR lo <= 3""")
def eda_province(spark: SparkSession, sf: str) -> DataFrame:
    from brickyard.plans.explore import province_extremes

    return province_extremes(_points(spark, sf))


@query("eda_corr", P + """
SELECT p.market, round(corr(price_per_sqm, l.price), 6) AS correlation,
  min(price_per_sqm) AS lowest, max(price_per_sqm) AS highest
FROM p JOIN """ + f"({LISTINGS}) l USING (listing_id) GROUP BY 1")
def eda_corr(spark: SparkSession, sf: str) -> DataFrame:
    from brickyard.plans.explore import feature_profile

    return feature_profile(_points(spark, sf), "price_per_sqm", "price")


@query("ppsqm_percentile", P + """
SELECT listing_id, market, round_even(cume_dist() OVER (PARTITION BY market
  ORDER BY price_per_sqm) * 1000, 0) / 10 AS percentile FROM p""")
def ppsqm_percentile(spark: SparkSession, sf: str) -> DataFrame:
    pts = _points(spark, sf)
    return with_percentile(pts, pts, ["market"], "price_per_sqm", "percentile").select(
        "listing_id", "market", "percentile")


@query("heatmap_tiles", P + """
, t AS (SELECT market, cast(floor(latitude / 0.05E0) AS bigint) AS ty,
    cast(floor(longitude / 0.05E0) AS bigint) AS tx, median(price_per_sqm) AS price_per_sqm,
    count(*) AS n FROM p GROUP BY 1, 2, 3 HAVING count(*) >= 5)
SELECT t.market, ty, tx, round_even((ty + 0.5E0) * 0.05E0 * 100000, 0) / 100000 AS lat,
  round_even((tx + 0.5E0) * 0.05E0 * 100000, 0) / 100000 AS lon,
  t.price_per_sqm, n, round_even(count(*) FILTER (WHERE p.price_per_sqm <= t.price_per_sqm)
    * 100.0E0 / count(*) * 10, 0) / 10 AS percentile,
  m.national_ppsqm
FROM t JOIN p ON p.market = t.market
JOIN (SELECT market, median(price_per_sqm) AS national_ppsqm FROM p GROUP BY 1) m ON m.market = t.market
GROUP BY ALL""")
def heatmap_tiles(spark: SparkSession, sf: str) -> DataFrame:
    pts = _points(spark, sf)
    nat = surface.national_medians(pts).drop("n_points")
    return surface.tiles(pts, width=0.05).join(nat, "market")


@query("build_surface", P + """
SELECT 'points' AS part, market, count(*) AS n_rows FROM p GROUP BY 2
UNION ALL SELECT 'muni_stats', market, count(DISTINCT refnis) FROM p GROUP BY 2
UNION ALL SELECT 'province_medians', market, count(DISTINCT province) FROM p GROUP BY 2
UNION ALL SELECT 'national', market, 1 FROM p GROUP BY 2
UNION ALL SELECT 'tiles', market, count(*) FROM (SELECT market FROM p
  GROUP BY market, floor(latitude / 0.01E0), floor(longitude / 0.01E0) HAVING count(*) >= 5) t GROUP BY 2""")
def build_surface(spark: SparkSession, sf: str) -> DataFrame:
    parts = surface.build_surface(listings(spark, sf))
    out = None
    for name, df in parts.items():
        n = df.groupBy("market").agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("part"), "market", "n_rows")
        out = n if out is None else out.unionByName(n)
    return out


# -- nearest neighbours over all listings ------------------------------------
# The comparison searches a window of 0.14 x 0.22 degrees around each listing; the 20th
# neighbour of every listing lies inside it at the checked scale.
_NB = P + f"""
, q AS (SELECT listing_id, market, latitude, longitude, province, region FROM ({LISTINGS}) l0
  WHERE latitude IS NOT NULL),
pc AS (SELECT *, floor(latitude / 0.14) AS r, floor(longitude / 0.22) AS c FROM p),
qc AS (SELECT q.*, floor(latitude / 0.14) + i AS r, floor(longitude / 0.22) + j AS c
  FROM q, (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j)),
pairs AS (SELECT q.listing_id, q.market, p.listing_id AS pid, p.price_per_sqm, p.refnis,
    {_dist('q', 'p')} AS d
  FROM qc q JOIN pc p ON q.market = p.market AND p.r = q.r AND p.c = q.c AND p.latitude BETWEEN q.latitude - 0.14 AND q.latitude + 0.14
    AND p.longitude BETWEEN q.longitude - 0.22 AND q.longitude + 0.22 AND @COND@),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY d, pid) AS rn
  FROM pairs) x WHERE rn <= 20),
n AS (SELECT listing_id, market, median(price_per_sqm) AS local_ppsqm, max(d) AS radius_m,
    count(*) FILTER (WHERE d <= 1000) AS n_near, count(*) AS n_neighbours,
    max(CASE WHEN rn = 1 THEN pid END) AS nearest_id FROM r GROUP BY 1, 2)"""
_ANY = _NB.replace("@COND@", "true")
_OTHER = _NB.replace("@COND@", "p.listing_id <> q.listing_id")


def _near(spark: SparkSession, sf: str, leave_one_out: bool) -> DataFrame:
    rows = listings(spark, sf).select("listing_id", "market", "latitude", "longitude").dropna()
    out = surface.neighbours(rows, _points(spark, sf),
                             exclude_id="listing_id" if leave_one_out else None)
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("n_neighbours", "n_near")})


_NB_COLS = """SELECT listing_id, nearest_id, n_neighbours, local_ppsqm,
  round(radius_m, 3) AS radius_m FROM n"""


@query("knn_join", _ANY + _NB_COLS)
def knn_join(spark: SparkSession, sf: str) -> DataFrame:
    return _near(spark, sf, False).select("listing_id", "nearest_id", "n_neighbours",
                                          "local_ppsqm", F.round("radius_m", 3).alias("radius_m"))


@query("knn_loo", _OTHER + _NB_COLS)
def knn_loo(spark: SparkSession, sf: str) -> DataFrame:
    return _near(spark, sf, True).select("listing_id", "nearest_id", "n_neighbours",
                                         "local_ppsqm", F.round("radius_m", 3).alias("radius_m"))


@query("knn_confidence", _OTHER + """
SELECT listing_id, n_near, CASE WHEN radius_m > 20000 THEN 0.25E0
  ELSE round_even(least(greatest(n_near / 10, 0.05E0), 1E0) * 100, 0) / 100 END AS confidence
FROM n""")
def knn_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return _near(spark, sf, True).select(
        "listing_id", "n_near",
        surface.confidence(F.col("n_near"), F.col("radius_m")).alias("confidence"))


_PCT = """, v AS (SELECT market, val, count(*) AS c FROM (
    SELECT market, price_per_sqm AS val FROM p) x GROUP BY 1, 2),
cum AS (SELECT market, val, sum(c) OVER (PARTITION BY market ORDER BY val) AS le,
    sum(c) OVER (PARTITION BY market) AS total FROM v)"""


@query("neighbourhood_index", _OTHER + _PCT + f"""
, f AS (SELECT n.listing_id, round_even(cum.le * 100.0E0 / cum.total * 10, 0) / 10 AS pct
  FROM n ASOF JOIN cum ON n.market = cum.market AND n.local_ppsqm >= cum.val)
SELECT l.listing_id, l.market, coalesce(f.pct, 50E0) AS neighbourhood_price_index
FROM ({LISTINGS}) l LEFT JOIN f USING (listing_id)""")
def neighbourhood_index(spark: SparkSession, sf: str) -> DataFrame:
    rows = listings(spark, sf)
    return surface.neighbourhood_index(rows, surface.surface_points(rows)).select(
        "listing_id", "market", "neighbourhood_price_index")


@query("serve_index", _ANY + _PCT + f"""
, pm AS (SELECT market, province, median(price_per_sqm) AS med FROM p GROUP BY 1, 2),
a AS (SELECT n.listing_id, round_even(cum.le * 100.0E0 / cum.total * 10, 0) / 10 AS pct
  FROM n ASOF JOIN cum ON n.market = cum.market AND n.local_ppsqm >= cum.val),
b AS (SELECT pm.market, pm.province, round_even(cum.le * 100.0E0 / cum.total * 10, 0) / 10 AS pct
  FROM pm ASOF JOIN cum ON pm.market = cum.market AND pm.med >= cum.val)
SELECT l.listing_id, coalesce(a.pct, b.pct, 50E0) AS neighbourhood_price_index,
  CASE WHEN a.pct IS NOT NULL THEN 'exact' WHEN b.pct IS NOT NULL THEN 'province'
    ELSE 'default' END AS index_basis
FROM ({LISTINGS}) l LEFT JOIN a USING (listing_id)
LEFT JOIN b ON l.market = b.market AND l.province = b.province""")
def serve_index(spark: SparkSession, sf: str) -> DataFrame:
    from brickyard.plans.scoring import serve_index as job

    rows = listings(spark, sf)
    return job(rows, surface.surface_points(rows)).select(
        "listing_id", "neighbourhood_price_index", "index_basis")


# -- lookup of one point per municipality and of far-away points --------------
def municipality_requests(spark: SparkSession, sf: str) -> DataFrame:
    """The median property of every municipality and market, as a request table."""
    m = group_medians(listings(spark, sf), ["market", "refnis"], {
        "latitude": F.col("latitude"), "longitude": F.col("longitude"),
        "livable_surface": F.col("livable_surface"), "bedrooms": F.col("bedrooms"),
        "prediction": F.col("price")})
    return m.withColumns({
        "request_id": F.concat_ws("-", "market", "refnis"),
        "livable_surface": F.when(F.col("refnis") % 5 != 0, F.col("livable_surface")),
        "property_type": F.when(F.col("refnis") % 3 == 0, "SMALL"),
        "category": F.when(F.col("refnis") % 3 == 1, "house")})


_REQ = f"""
req AS (SELECT concat(market, '-', refnis) AS request_id, market, refnis, median(latitude) AS latitude,
    median(longitude) AS longitude,
    CASE WHEN refnis % 5 <> 0 THEN median(livable_surface) END AS livable_surface,
    median(bedrooms) AS bedrooms, median(price) AS prediction,
    CASE WHEN refnis % 3 = 0 THEN 'SMALL' END AS property_type,
    CASE WHEN refnis % 3 = 1 THEN 'house' END AS category
  FROM ({LISTINGS}) l1 GROUP BY market, refnis)"""

# @SHIFT@: added to the query latitude
_LOOK = P + "," + _REQ + f"""
, q AS (SELECT request_id, market, latitude + @SHIFT@ AS latitude, longitude FROM req),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY d, pid) AS rn
  FROM (SELECT q.request_id, q.market, p.listing_id AS pid, p.price_per_sqm, p.refnis,
    {_dist('q', 'p')} AS d FROM q JOIN p ON q.market = p.market) y) x WHERE rn <= 20),
n AS (SELECT request_id, market, median(price_per_sqm) AS local_ppsqm, max(d) AS radius_m,
    count(*) FILTER (WHERE d <= 1000) AS n_near,
    max(CASE WHEN rn = 1 THEN refnis END) AS nearest_refnis FROM r GROUP BY 1, 2),
ms AS (SELECT market, refnis, avg(price_per_sqm) AS mean_ppsqm FROM p GROUP BY 1, 2),
nm AS (SELECT market, median(price_per_sqm) AS national FROM p GROUP BY 1),
v AS (SELECT n.*, CASE WHEN radius_m > 20000 THEN coalesce(mean_ppsqm, national)
    ELSE local_ppsqm END AS value
  FROM n LEFT JOIN ms ON ms.market = n.market AND ms.refnis = n.nearest_refnis
  JOIN nm ON nm.market = n.market)"""


@query("priciness_lookup", _LOOK.replace("@SHIFT@", "0E0") + """
SELECT v.request_id, v.value, round(radius_m, 3) AS radius_m,
  CASE WHEN radius_m < 500 THEN 'street/block' WHEN radius_m < 1500 THEN 'neighbourhood'
    WHEN radius_m < 5000 THEN 'district' WHEN radius_m > 20000 THEN 'municipality'
    ELSE 'area' END AS granularity,
  CASE WHEN radius_m > 20000 THEN 0.25E0
    ELSE round_even(least(greatest(n_near / 10, 0.05E0), 1E0) * 100, 0) / 100 END AS confidence,
  round_even(count(*) FILTER (WHERE p.price_per_sqm <= v.value) * 100.0E0 / count(*) * 10, 0) / 10
    AS percentile
FROM v JOIN p ON p.market = v.market GROUP BY ALL""")
def priciness_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return surface.lookup(municipality_requests(spark, sf), _points(spark, sf)).select(
        "request_id", "value", F.round("radius_m", 3).alias("radius_m"), "granularity",
        "confidence", "percentile")


@query("priciness_backoff", _LOOK.replace("@SHIFT@", "0.9E0") + """
SELECT request_id, nearest_refnis, radius_m > 20000 AS far, round(value, 6) AS value FROM v""")
def priciness_backoff(spark: SparkSession, sf: str) -> DataFrame:
    north = municipality_requests(spark, sf).withColumn("latitude", F.col("latitude") + 0.9)
    pts = written(_points(spark, sf).select(*surface.POINT_COLUMNS), "surface-points")
    return surface.back_off(surface.neighbours(north, pts), pts).select(
        "request_id", "nearest_refnis", (F.col("radius_m") > geo.FAR_M).alias("far"),
        F.round("value", 6).alias("value"))


# -- comparables -------------------------------------------------------------
_POOL = "WITH " + _REQ + f"""
, u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce('u:' || url, 'i:' || listing_id)
    ORDER BY scraped_at, listing_id) AS rn FROM ({LISTINGS}) l2 WHERE latitude IS NOT NULL) x WHERE rn = 1),
a AS (SELECT req.request_id, u.listing_id, {_dist('req', 'u')} AS d, u.price, u.livable_surface,
    u.bedrooms, u.property_type, u.category
  FROM req JOIN u ON u.market = req.market),
c AS (SELECT *, count(*) FILTER (WHERE d <= 25000) OVER (PARTITION BY request_id) AS n_within,
    row_number() OVER (PARTITION BY request_id ORDER BY d, listing_id) AS near FROM a),
b AS (SELECT c.*, n_within < 20 AS widened FROM c
  WHERE CASE WHEN n_within < 20 THEN near <= 40 ELSE d <= 25000 END)"""
_SCORED = _POOL + """
, e AS (SELECT b.*, req.property_type AS q_type, req.category AS q_cat, req.livable_surface AS q_surf,
    req.bedrooms AS q_beds, req.prediction,
    CASE WHEN req.property_type IS NOT NULL THEN b.property_type = req.property_type
      WHEN req.category IS NOT NULL THEN b.category = req.category END AS fits
  FROM b JOIN req USING (request_id)),
f AS (SELECT * FROM (SELECT *, count(*) FILTER (WHERE fits) OVER (PARTITION BY request_id) AS n_fit FROM e) x
  WHERE n_fit < 5 OR fits),
m AS (SELECT request_id, median(livable_surface) AS ms, median(bedrooms) AS mb FROM f GROUP BY 1),
s AS (SELECT f.*, coalesce(nullif(q_surf, 0), nullif(ms, 0), 100E0) AS s0,
    coalesce(nullif(q_beds, 0), nullif(mb, 0), 2E0) AS b0 FROM f JOIN m USING (request_id)),
t AS (SELECT *, 0.9E0 * (d / 1000 / 25) + abs(livable_surface - s0) / greatest(s0, 1E0)
    + 0.5E0 * (abs(bedrooms - b0) / 3E0) + 1.2E0 * (abs(price - prediction) / greatest(prediction, 1E0)) AS score
  FROM s),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score, listing_id)
  AS rank FROM t) y WHERE rank <= 5)"""


@query("comparables_pool", _POOL + """
SELECT request_id, n_within, widened, count(*) AS n_pool, round(max(d), 3) AS farthest_m FROM b
GROUP BY 1, 2, 3""")
def comparables_pool(spark: SparkSession, sf: str) -> DataFrame:
    pool = written(comps.candidates(listings(spark, sf)), "comparables-pool")
    return comps.pool_summary(municipality_requests(spark, sf), pool, k=5).withColumn(
        "farthest_m", F.round("farthest_m", 3))


@query("comparables_topk", _SCORED + """
SELECT request_id, cast(rank AS integer) AS rank, listing_id, round(score, 9) AS score,
  round(d / 1000, 2) AS distance_km FROM top""")
def comparables_topk(spark: SparkSession, sf: str) -> DataFrame:
    return comps.top_comparables(municipality_requests(spark, sf), listings(spark, sf)).withColumn(
        "score", F.round("score", 9))


@query("comparables", _SCORED + f"""
SELECT request_id, cast(rank AS integer) AS rank, listing_id, round(d / 1000, 2) AS distance_km, l.source,
  l.url, round(l.price, 1) AS price, round(l.price / l.livable_surface, 1) AS price_per_sqm,
  round(l.livable_surface, 1) AS livable_surface, l.bedrooms, l.property_type, l.category,
  cast(NULL AS varchar) AS locality, l.municipality, l.province, round(l.latitude, 4) AS latitude,
  round(l.longitude, 4) AS longitude, cast(NULL AS varchar) AS epc,
  cast(NULL AS varchar) AS building_state
FROM top JOIN ({LISTINGS}) l USING (listing_id)""")
def comparables(spark: SparkSession, sf: str) -> DataFrame:
    return comps.comparables(municipality_requests(spark, sf), listings(spark, sf))


@query("similarity_score", "WITH " + _REQ + f"""
SELECT l.listing_id, round(0.9E0 * ({_dist('req', 'l')} / 1000 / 25)
  + abs(l.livable_surface - coalesce(req.livable_surface, 100E0)) / greatest(coalesce(req.livable_surface, 100E0), 1E0)
  + 0.5E0 * (abs(l.bedrooms - req.bedrooms) / 3E0)
  + 1.2E0 * (abs(l.price - req.prediction) / greatest(req.prediction, 1E0)), 6) AS score
FROM ({LISTINGS}) l JOIN req ON req.market = l.market AND req.refnis = l.refnis
WHERE l.latitude IS NOT NULL""")
def similarity_score(spark: SparkSession, sf: str) -> DataFrame:
    req = municipality_requests(spark, sf).select(
        "market", "refnis", F.col("latitude").alias("q_lat"), F.col("longitude").alias("q_lon"),
        F.coalesce("livable_surface", F.lit(100.0)).alias("q_surface"),
        F.col("bedrooms").alias("q_beds"), "prediction")
    km = geo.haversine_km(F.col("q_lat"), F.col("q_lon"), F.col("latitude"), F.col("longitude"))
    return (listings(spark, sf).filter(F.col("latitude").isNotNull())
            .join(req, ["market", "refnis"])
            .select("listing_id", F.round(comps.similarity_score(
                km, F.col("livable_surface"), F.col("bedrooms"), F.col("price"),
                F.col("q_surface"), F.col("q_beds"), F.col("prediction")), 6).alias("score")))
