"""Nearest neighbours, radius join, quantiles and ranks against brute force."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from brickyard.operators import best, knn
from brickyard.operators.knn import nearest
from brickyard.operators.quantiles import group_quantiles, value_ranks, with_percentile
from brickyard.operators.radius import within_radius
from brickyard.plans import comparables as comps


def metres(a, b):
    p1, p2 = math.radians(a[0]), math.radians(b[0])
    h = (math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2)
         * math.sin(math.radians(b[1] - a[1]) / 2) ** 2)
    return 2 * 6371000 * math.asin(min(1, math.sqrt(h)))


def skewed_points(n, seed):
    """A third at one address, a third in a dense block, the rest spread out."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if i % 3 == 0:
            place = (50.85, 4.35)
        elif i % 3 == 1:
            place = (51.0 + rng.random() * 1e-3, 4.4 + rng.random() * 1e-3)
        else:
            place = (rng.uniform(49.5, 51.5), rng.uniform(2.5, 6.4))
        out.append((f"{i:05d}", "sale", *place))
    return out


def test_nearest_equals_brute_force_on_skewed_points(spark):
    rows = skewed_points(240, 3)
    df = spark.createDataFrame(rows, "listing_id string, market string, latitude double, longitude double")
    for exclude in (None, "listing_id"):
        got = nearest(df, df, 5, exclude_id=exclude).select(
            "listing_id", F.transform("neighbours", lambda x: x["id"]).alias("ids")).collect()
        for lid, ids in got:
            me = next(r for r in rows if r[0] == lid)
            want = sorted((metres(me[2:], r[2:]), r[0]) for r in rows
                          if exclude is None or r[0] != lid)[:5]
            assert ids == [w[1] for w in want]


def test_nearest_from_far_away_and_with_few_points(spark):
    schema = "listing_id string, market string, latitude double, longitude double"
    pts = spark.createDataFrame([("a", "sale", 50.0, 4.0), ("b", "sale", 50.1, 4.0)], schema)
    q = spark.createDataFrame([("q", "sale", 10.0, -60.0), ("n", "sale", None, 4.0),
                               ("r", "rent", 50.0, 4.0)], schema)
    got = {r.listing_id: r.neighbours for r in nearest(q, pts, 5).collect()}
    assert sorted(x.id for x in got["q"]) == ["a", "b"] and got["n"] is None and got["r"] is None


def test_far_queries_see_a_multiple_of_k_candidates(spark):
    """A dense cluster seen from 300 km and from the other side of the globe."""
    rng, k = random.Random(2), 10
    rows = [(f"{i:05d}", "sale", 50.8 + rng.gauss(0, 0.05), 4.3 + rng.gauss(0, 0.05)) for i in range(4000)]
    rows += [("lone", "sale", 49.0, 6.0), ("rent", "rent", 50.0, 4.0)]
    pts = spark.createDataFrame(rows, "listing_id string, market string, latitude double, longitude double")
    asked = [("a", "sale", 53.5, 4.3), ("b", "sale", 50.8, 8.6), ("c", "sale", 48.3, 2.0), ("d", "sale", -40.0, 175.0),
             ("e", "sale", 89.9, 100.0), ("f", "rent", 10.0, 10.0), ("g", "none", 10.0, 10.0)]
    q = spark.createDataFrame(asked, "request_id string, market string, latitude double, longitude double")
    got = {r.request_id: r.neighbours for r in nearest(q, pts, k).collect()}
    for rid, market, *place in asked:
        want = sorted((metres(place, r[2:]), r[0]) for r in rows if r[1] == market)[:k]
        assert [x.id for x in got[rid] or []] == [w[1] for w in want]
    own = pts.filter("market = 'sale'").selectExpr("market", "latitude _plat", "longitude _plon", "listing_id _pid")
    finest = knn.finest_cell(own, ["market"], k)
    x, y = knn._cells(F.col("_plat"), F.col("_plon"), finest)
    cells, top = knn.pyramid(own, x, y, finest, ["market"])
    far = q.limit(5).selectExpr("market", "request_id _q", "latitude _qlat", "longitude _qlon")
    left = (knn.descend(far, cells, top, ["market"], k).join(cells.filter("lv = 0"), ["market", "cx", "cy"])
            .groupBy("_q").agg(F.sum("n").alias("n")).collect())
    assert len(left) == 5 and all(k <= r.n <= 12 * k for r in left), left


def test_radius_join(spark):
    rows = skewed_points(150, 9)
    df = spark.createDataFrame(rows, "listing_id string, market string, latitude double, longitude double")
    q = df.withColumnRenamed("listing_id", "request_id")
    got = {(r[0], r[1]) for r in within_radius(q, df, 20_000.0, "request_id", "listing_id").select(
        "request_id", "listing_id").collect()}
    assert got == {(a[0], b[0]) for a in rows for b in rows if metres(a[2:], b[2:]) <= 20_000}


def test_quantiles_with_a_hot_group_and_value(spark):
    rng = np.random.default_rng(4)
    rows = [("hot", 7.0)] * 400 + [("hot", float(v)) for v in rng.normal(0, 1000, 401)]
    rows += [("small", v) for v in (1.0, 2.0, 4.0, 10.0)] + [("small", None), (None, 3.5)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in group_quantiles(df, ["g"], {
        "med": (F.col("v"), 0.5), "p1": (F.col("v"), 0.01), "p99": (F.col("v"), 0.99)},
        count_as="n").collect()}
    assert got["small"].med == 3.0 and got["small"].n == 4 and got[None].med == 3.5
    hot = [v for g, v in rows if g == "hot"]
    for name, p in (("med", 50), ("p1", 1), ("p99", 99)):
        assert abs(got["hot"][name] - np.percentile(hot, p)) < 1e-9


def test_ranks_of_stored_and_foreign_values(spark):
    pts = spark.createDataFrame([("s", v) for v in (1.0, 2.0, 2.0, 5.0)], "m string, v double")
    ranks = {r.v: (r.n_le, r.n_total) for r in value_ranks(pts, ["m"], "v").collect()}
    assert ranks == {1.0: (1, 4), 2.0: (3, 4), 5.0: (4, 4)}
    probes = spark.createDataFrame([("s", 0.5), ("s", 2.0), ("s", 9.0), ("s", None), ("t", 1.0)],
                                   "m string, v double")
    got = {(r.m, r.v): r.p for r in with_percentile(probes, pts, ["m"], "v", "p").collect()}
    assert got == {("s", 0.5): 0.0, ("s", 2.0): 75.0, ("s", 9.0): 100.0, ("s", None): 50.0,
                   ("t", 1.0): 50.0}


def test_comparables_widen_and_narrow(spark):
    rows = [(f"{i:03d}", None, "sale", 50.0 + i * 0.01, 4.0, 100.0 + i, 2.0,
             "house" if i % 2 else "flat", 1000.0 * i) for i in range(60)]
    df = spark.createDataFrame(rows, "listing_id string, url string, market string, latitude double,"
                               " longitude double, livable_surface double, bedrooms double,"
                               " property_type string, price double").withColumn("category", F.lit("house"))
    req = spark.createDataFrame([("near", "sale", 50.0, 4.0, "flat"), ("far", "sale", 53.0, 4.0, "flat")],
                                "request_id string, market string, latitude double, longitude double,"
                                " property_type string")
    sizes = {r.request_id: r for r in comps.pool_size_per_request(req, df, 5).collect()}
    assert sizes["near"].n_within == 23 and sizes["far"].widened
    out = comps.top_comparables(req, df).collect()
    assert len(out) == 10 and all(int(r.listing_id) % 2 == 0 for r in out)
    assert {r.listing_id for r in out if r.request_id == "far"} <= {f"{i:03d}" for i in range(20, 60)}


def _requests_and_listings(seed, n=300):
    rng = random.Random(seed)
    listings = [(i, m, a, b, rng.choice([None, 80.0, 100.0, 140.0]), rng.choice([None, 1.0, 3.0]),
                 rng.choice(["house", "flat", None]), rng.choice(["a", "b"]), float(rng.randrange(50, 60)))
                for i, m, a, b in skewed_points(n, seed)]
    requests = [(f"q{i}", "sale" if i % 9 else "rent", *(rng.choice(listings)[2:4] if i % 4 else (53.5, 4.0 + i * 0.01)),
                 rng.choice([None, 0.0, 90.0]), rng.choice([None, 2.0]), rng.choice(["house", "flat", "barn", None]),
                 rng.choice(["a", None]), rng.choice([None, 0.0, 55.0])) for i in range(40)]
    return requests, listings


def _median(values):
    v = sorted(x for x in values if x is not None)
    return (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2 if v else None


def _comparables(request, listings, k=5, radius_km=25.0):
    rid, market, lat, lon, surface, beds, kind, category, prediction = request
    pool = sorted((metres((lat, lon), x[2:4]), x[0], x) for x in listings if x[1] == market)
    near = [x for x in pool if x[0] <= radius_km * 1000]
    pool = near if len(near) >= 4 * k else pool[:max(8 * k, 40)]
    fit = [x for x in pool if (x[2][6] == kind if kind else category is not None and x[2][7] == category)]
    pool = fit if len(fit) >= k else pool
    surface = surface or _median([x[2][4] for x in pool]) or 100.0
    beds = beds or _median([x[2][5] for x in pool]) or 2.0
    scored = []
    for d, lid, x in pool:
        own = 0.9 * d / 25_000 + abs((surface if x[4] is None else x[4]) - surface) / max(surface, 1)
        own += 0.5 * abs((beds if x[5] is None else x[5]) - beds) / 3
        own += 1.2 * abs(x[8] - prediction) / max(prediction, 1) if prediction else 0
        scored.append((round(own, 9), lid))
    return [(rid, n + 1, lid, s) for n, (s, lid) in enumerate(sorted(scored)[:k])]


def test_comparables_equal_brute_force_in_parts(spark, monkeypatch):
    monkeypatch.setattr(best, "POINTS_PER_PART", 16)
    monkeypatch.setattr(best, "QUERIES_PER_PART", 4)
    monkeypatch.setattr(best, "PAIRS", 64)
    requests, rows = _requests_and_listings(11)
    listings = spark.createDataFrame(rows, "listing_id string, market string, latitude double, longitude double,"
                                     " livable_surface double, bedrooms double, property_type string,"
                                     " category string, price double").withColumn("url", F.lit(None).cast("string"))
    asked = spark.createDataFrame(requests, "request_id string, market string, latitude double, longitude double,"
                                  " livable_surface double, bedrooms double, property_type string, category string,"
                                  " prediction double")
    got = sorted((r.request_id, r.rank, r.listing_id, round(r.score, 9))
                 for r in comps.top_comparables(asked, listings).collect())
    assert got == sorted(x for q in requests for x in _comparables(q, rows))
    pool = comps.pool_summary(asked, listings, 5).collect()
    assert {r.request_id for r in pool} == {q[0] for q in requests if q[1] == "sale"}
    pairs = comps.request_pool(asked, listings, 5).groupBy("request_id").count().collect()
    assert {r.request_id: r.n_pool for r in pool} == {r.request_id: r["count"] for r in pairs}


def test_pairs_of_a_radius_are_not_shuffled(spark):
    """Ten times the listings inside make no more rows after the pass than parts and lists hold."""
    sizes = []
    for n in (500, 5000):
        points = spark.range(n).selectExpr("cast(id as string) listing_id", "'sale' market", "50.0 + id * 1e-5 latitude",
                                           "4.0 longitude", "100.0 price")
        asked = spark.range(3).selectExpr("id", "'sale' market", "50.0 latitude", "4.0 longitude", "90.0 q_price")
        found, _ = best.best_within(
            asked, points, 25_000.0, 5, lambda q, p, km: np.abs(p["price"] - q["q_price"]) + km,
            lambda q, p, km: km < 0, query_id="id", point_id="listing_id", numbers=["price"])
        rows = found.collect()
        assert [(r.n, r.n_fit, [x.id for x in r.best], r.best_fit) for r in rows] == [
            (n, 0, ["0", "1", "2", "3", "4"], [])] * 3
        sizes.append(sum(len(r.best) for r in rows))
    assert sizes[0] == sizes[1]


def test_small_and_large_groups_have_equal_quantiles(spark, monkeypatch):
    """Groups sorted as arrays, by histogram, or some of each way: the same rows."""
    from pyspark.sql import functions as F

    from brickyard.operators import quantiles

    rows = [(g, float(v) if v % 7 else None, float("nan") if v % 5 == 0 else -v / 3)
            for g, n in (("a", 1), ("b", 2), ("c", 9), ("d", 40), (None, 12)) for v in range(n)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    found = []
    for limit in (0, 10, 10**6):
        monkeypatch.setattr(quantiles, "GROUP_ROWS", limit)
        out = quantiles.group_quantiles(df, ["g"], {"x50": (F.col("x"), 0.5), "y50": (F.col("y"), 0.5),
                                                    "x10": (F.col("x"), 0.1)}, count_as="n")
        found.append(sorted(map(str, out.collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) == 4


def test_work_of_a_radius_grows_slower_than_its_points():
    """All points are inside; ten times as many are not scored ten times as often, and the result is exact."""
    import pyarrow as pa

    scored = []
    for n in (4_000, 40_000):
        rng, seen = np.random.default_rng(n), []
        lat, lon, price = np.radians(50 + rng.random(n) * 0.1), np.radians(4 + rng.random(n) * 0.1), rng.integers(50, 90, n) * 1.0
        points = pa.table({"_pid": [f"{i:06d}" for i in range(n)], "lat": lat, "lon": lon, "price": price,
                           "kind": pa.array(["a", "b"] * (n // 2))})
        asked = pa.table({"query_id": [0, 1], "lat": lat[:2], "lon": lon[:2], "q_price": [60.0, 70.0], "open": [False, True],
                          "q_kind": pa.array(["b", "a"])})

        def score(q, p, km):
            seen.append(len(km))
            return np.abs(p["price"] - q["q_price"]) + km

        got = best._met(25_000.0, 5, score, lambda q, p, km: q["q_kind"] == p["kind"], ["price"], ["kind"], ["price"], [])(
            asked, points).to_pylist()
        scored.append(sum(seen))
        place = {"lat": lat, "lon": lon}
        for r in got:
            metres_ = best._metres(place, place, np.full(n, r["query_id"]), np.arange(n))
            fit = np.arange(n) % 2 == 1 - r["query_id"]
            assert (r["n"], r["n_fit"], r["farthest_m"]) == (n, n // 2, metres_.max())
            values = np.abs(price - [60.0, 70.0][r["query_id"]]) + metres_ / 1000.0
            order = np.lexsort((np.arange(n), values))
            assert [x["id"] for x in r["best"]] == ([f"{i:06d}" for i in order[:5]] if r["query_id"] == 0 else [])
            assert [x["id"] for x in r["best_fit"]] == ([f"{i:06d}" for i in order[fit[order]][:5]] if r["query_id"] == 0 else [])
            assert sum(x["n"] for x in r["hist"]) == (0 if r["query_id"] == 0 else n)
    assert scored[1] < 4 * scored[0]


def test_lists_are_found_in_tiles_and_not_shuffled(spark, monkeypatch):
    """Many tiles, a crowded place and split queries give brute force; no list or pair meets a shuffle."""
    monkeypatch.setattr(knn, "TILE_ROWS", 40)
    rng = random.Random(5)
    rows = [(f"{i:05d}", "sale", *((50.05, 4.05) if i % 4 == 0 else (50 + rng.random() * 0.1, 4 + rng.random() * 0.1)))
            for i in range(400)]
    df = spark.createDataFrame(rows, "listing_id string, market string, latitude double, longitude double").withColumn(
        "v", F.expr("cast(listing_id as double) % 17"))
    found = nearest(df, df, 6, carry=["v"], exclude_id="listing_id")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroups" in plan and "collect_list" not in plan and "LeftOuter" not in plan
    brief = nearest(df, df, 6, carry=["v"], exclude_id="listing_id", brief=knn.Brief("v", 1000.0, "v"))
    short = {r.listing_id: r for r in brief.collect()}
    got = {r.listing_id: r.neighbours for r in found.collect()}
    assert len(got) == len(short) == len(rows)
    for lid, _, *place in rows:
        want = sorted((metres(place, r[2:]), r[0]) for r in rows if r[0] != lid)[:6]
        assert [x.id for x in got[lid]] == [w[1] for w in want]
        v, s = sorted(int(w[1]) % 17 for w in want), short[lid]
        assert (s.local_v, s.nearest_id, s.nearest_v, s.n_neighbours) == ((v[2] + v[3]) / 2, want[0][1], int(want[0][1]) % 17, 6)
        assert s.n_near == sum(w[0] <= 1000 for w in want) and abs(s.radius_m - want[-1][0]) < 1e-6
