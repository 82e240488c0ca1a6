"""Duplicate resolution against brute force, on skewed blocks, and through the store."""

import math
import random

from brickyard.operators import dedup
from brickyard.operators.components import connected_components
from brickyard.sources import store

SCHEMA = ("listing_id string, source string, url string, market string, scraped_at timestamp,"
          " street string, house_number string, postal_code string, livable_surface double,"
          " bedrooms double, price double, latitude double, longitude double, epc string")


def rec(i, price, lat=None, lon=None, street="Main", source="a", surface=85.0, url=None, epc=None):
    return (str(i), source, url, "sale", None, street, "1" if street else None,
            "1000" if street else None, surface, 2.0, price, lat, lon, epc)


def metres(a, b):
    p1, p2 = math.radians(a[0]), math.radians(b[0])
    h = (math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2)
         * math.sin(math.radians(b[1] - a[1]) / 2) ** 2)
    return 2 * 6371000 * math.asin(min(1, math.sqrt(h)))


def brute(rows):
    """Single-link clusters by comparing every pair of a block."""
    def block(r):
        return (r[7], r[5], r[6], round(r[8] / 5), r[9])

    parent = {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(rows):
        for b in rows[:i]:
            if block(a) != block(b):
                continue
            if a[10] and b[10] and abs(a[10] - b[10]) > 0.05 * max(a[10], b[10]):
                continue
            if None not in (a[11], b[11]) and metres(a[11:13], b[11:13]) > 40:
                continue
            ra, rb = sorted((root(a[0]), root(b[0])))
            parent[rb] = ra
    groups = {}
    for r in rows:
        groups.setdefault(root(r[0]), []).append(r[0])
    return {m: min(g) for g in groups.values() for m in g}


def test_clusters_equal_brute_force_in_one_hot_block(spark):
    rng = random.Random(5)
    for round_ in range(3):
        rows = []
        for i in range(220):
            price = None if rng.random() < (0.0, 0.01, 0.03)[round_] else rng.choice(
                [rng.uniform(1e5, 2e6), 250_000.0])
            place = None if rng.random() < (0.05, 0.02, 0.3)[round_] else (
                50.85 + rng.randint(0, 12) * 0.0002, 4.35 + rng.randint(0, 12) * 0.0003)
            street = None if rng.random() < 0.7 else rng.choice(["Main", "Side"])
            rows.append(rec(f"{i:04d}", price, *(place or (None, None)), street=street))
        got = dedup.dedup_clusters(spark.createDataFrame(rows, SCHEMA)).select(
            "listing_id", "cluster_id").collect()
        assert {r[0]: r[1] for r in got} == brute(rows)


def test_links_stay_linear_in_a_hot_group(spark):
    rows = [rec(f"{i:05d}", 200_000.0 + i, street=None) for i in range(3000)]
    rows += [rec(f"x{i:05d}", 300_000.0, 50.0, 4.0, street=None) for i in range(3000)]
    assert dedup.duplicate_links(spark.createDataFrame(rows, SCHEMA)).count() < 3 * len(rows)


def test_distinct_places_close_together_stay_linear(spark):
    """3,000 places within 40 m of each other: few links a node, the same clusters."""
    rng = random.Random(8)
    rows = [rec(f"{i:05d}", rng.choice([1e5, 2e5, 4e5]) * (1 + rng.random() * 0.2), 50.85 + rng.random() * 2.4e-4,
                4.35 + rng.random() * 3.8e-4) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert dedup.duplicate_links(df).count() < 5 * len(rows)
    got = {r[0]: r[1] for r in dedup.dedup_clusters(df).select("listing_id", "cluster_id").collect()}
    assert got == brute(rows)


def test_two_dense_places_at_the_edge_of_the_tolerance(spark):
    """Two groups 25 to 45 m apart: joined by few links or not at all, never by all pairs."""
    for east in (3.6e-4, 5.5e-4, 5.7e-4, 6.5e-4):
        rng = random.Random(int(east * 1e6))
        rows = [rec(f"{i:05d}", 2e5 + i, 50.85 + rng.random() * 2e-5, 4.35 + (i % 2) * east + rng.random() * 2e-5)
                for i in range(400)]
        df = spark.createDataFrame(rows, SCHEMA)
        assert dedup.duplicate_links(df).count() < 5 * len(rows)
        got = {r[0]: r[1] for r in dedup.dedup_clusters(df).select("listing_id", "cluster_id").collect()}
        assert got == brute(rows)


def test_places_over_cells_equal_brute_force(spark):
    """Places spread over cells, north, south and far north, with unpriced ones among them."""
    for seed, (lat, lon) in enumerate([(50.85, 4.35), (-0.0001, -0.0002), (89.99, 10.0)]):
        rng = random.Random(seed)
        wide = 1 / math.cos(math.radians(lat))
        rows = [rec(f"{i:04d}", None if rng.random() < 0.02 else rng.choice([1e5, 1.2e5, 3e5]) * (1 + rng.random() * 0.05),
                    lat + rng.random() * 2e-3, lon + rng.random() * 2e-3 * wide) for i in range(260)]
        got = {r[0]: r[1] for r in dedup.dedup_clusters(spark.createDataFrame(rows, SCHEMA)).select(
            "listing_id", "cluster_id").collect()}
        assert got == brute(rows)


def test_components_of_a_long_chain(spark):
    n = 3000
    ids = list(range(n))
    random.Random(1).shuffle(ids)
    edges = spark.createDataFrame([(f"{a:06d}", f"{b:06d}") for a, b in zip(ids, ids[1:])],
                                  "a string, b string")
    out = connected_components(edges, "a", "b")
    assert out.count() == n - 1 and out.select("label").distinct().collect() == [("000000",)]


def test_survivor_and_coalescing(spark):
    rows = [rec(1, 849_000.0, 50.85, 4.35, epc="B", source="a"),
            rec(2, 855_000.0, 50.85001, 4.35001, surface=84.0, url="u2", source="b"),
            rec(3, 500_000.0, 50.85, 4.35)]
    out = dedup.dedupe(spark.createDataFrame(rows, SCHEMA),
                       dedup.priority_table(spark, {"a": 5.0, "b": 1.0})).collect()
    kept = {r.listing_id: r for r in out}
    assert set(kept) == {"1", "3"} and kept["1"].url == "u2" and kept["1"].epc == "B"
    assert kept["1"].cluster_size == 2


def test_isolated_null_keys(spark):
    rows = [rec(1, 1e5, street=None), rec(2, 1e5, street=None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert dedup.dedup_clusters(df).select("cluster_id").distinct().count() == 1
    lone = dedup.dedup_clusters(df, isolate_null_keys=True)
    assert lone.select("cluster_id").distinct().count() == 2


def test_merge_is_idempotent(spark, tmp_path):
    raw, target = f"{tmp_path}/raw", f"{tmp_path}/store"
    weights = dedup.priority_table(spark, {"a": 2.0, "b": 1.0})
    assert store.merge_market(spark, raw, target, weights) is None
    rows = [rec(1, 849_000.0, 50.85, 4.35, url="u1"),
            rec(2, 855_000.0, 50.85001, 4.35001, surface=84.0, url="u2", source="b"),
            rec(3, 500_000.0, 50.85, 4.35, url="u3")]
    store.append_raw(spark.createDataFrame(rows, SCHEMA), raw, "b1")
    report = {r.source: r for r in store.merge_market(spark, raw, target, weights).collect()}
    assert (report["(all)"].n_input, report["(all)"].n_kept) == (3, 2)
    store.merge_market(spark, raw, target, weights)
    assert store.read_store(spark, target).count() == 2 and store.current_version(spark, target) == 2


def test_small_blocks_are_clustered_where_they_lie(spark, monkeypatch):
    """Blocks in one task, or some of them by links: the same clusters; small blocks write no node and join nothing."""
    rng = random.Random(3)
    rows = [rec(f"{i:04d}", rng.choice([1e5, 1.03e5, 2e5]), *rng.choice([(50.0, 4.0), (50.0001, 4.0), (50.1, 4.1), (None, None)]),
                street=rng.choice(["Main", "Side", f"S{i}"]), source=rng.choice("ab"), url=rng.choice([None, f"u{i}"]),
                epc=rng.choice([None, "B"])) for i in range(160)]
    df = spark.createDataFrame(rows, SCHEMA)
    made, found = [], []
    monkeypatch.setattr(dedup, "_nodes", lambda x, own=dedup._nodes: made.append(1) or own(x))
    weights = dedup.priority_table(spark, {"a": 2.0, "b": 1.0})
    for limit in (1000, 20):
        monkeypatch.setattr(dedup, "SMALL_BLOCK", limit)
        got = {r[0]: r[1] for r in dedup.dedup_clusters(df).select("listing_id", "cluster_id").collect()}
        assert got == brute(rows) and bool(made) == (limit == 20)
        found.append(sorted(map(tuple, dedup.dedupe(df, weights).collect()), key=repr))
    assert found[0] == found[1] and any(r[1] > 1 for r in found[0])
    plan = dedup.dedup_clusters(df, columns=["listing_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan
