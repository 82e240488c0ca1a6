"""How often queries read their tables and what they shuffle."""

import pytest
from pyspark.sql import functions as F

from brickyard.operators import clean, dedup
from brickyard.plans.bind import dup_listings, listings

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_model_frame_shuffles_rows_once(spark):
    rows = spark.createDataFrame(
        [("a", "sale", "2024-01-02", 300_000.0, 2), ("a", "sale", "2024-01-01", 250_000.0, 3),
         ("a", "sale", "2024-01-01", 250_000.0, 3), ("b", "rent", "2024-01-01", 900.0, 1), ("b", "rent", None, 800.0, 1),
         ("c", "sale", "2024-01-01", 10.0, 1)],
        "listing_id string, market string, scraped_at string, price double, bedrooms int")
    frame = clean.clean_model_frame(rows)
    assert {tuple(r) for r in frame.select("listing_id", "price").collect()} == {("a", 250_000.0), ("b", 900.0)}
    assert plan(frame).count("Exchange hashpartitioning") == 1


def test_model_frame_reads_no_column_it_does_not_return(spark):
    text = plan(clean.clean_model_frame(listings(spark, SF)))
    assert "p_size" in text and not any(c in text for c in ("p_name", "s_name", "l_returnflag"))


def test_duplicate_listings_read_the_tables_once(spark):
    rows = dup_listings(spark, SF)
    assert plan(rows).count("lineitem.parquet") == 1


def test_only_clusters_of_several_are_marked(spark):
    rows = [("a", 100.0, "u1", None), ("b", 102.0, None, "B"), ("c", 500.0, "u3", None), ("d", 900.0, None, "C"),
            ("e", 900.0, "u5", None)]
    df = spark.createDataFrame(rows, "listing_id string, price double, url string, epc string").withColumns({
        "source": F.lit("s"), "market": F.lit("sale"), "postal_code": F.lit("1000"), "street": F.lit("x"),
        "house_number": F.lit("1"), "livable_surface": F.lit(80.0), "bedrooms": F.lit(2),
        "latitude": F.lit(50.0), "longitude": F.lit(4.0), "source_weight": F.lit(1.0)})
    marked = dedup.dedup_clusters(df, mark=True)
    assert {r.listing_id: r[dedup.SEVERAL] for r in marked.collect()} == {
        "a": True, "b": True, "c": False, "d": True, "e": True}
    columns = ["listing_id", "price", "url", "epc"]
    got = [sorted(map(tuple, dedup.resolve_clusters(x, columns).collect()), key=repr)
           for x in (marked, marked.drop(dedup.SEVERAL))]
    assert got[0] == got[1] and len(got[0]) == 3
    assert ("c", 1, "c", 500.0, "u3", None) in got[0]


def test_neighbour_lists_are_not_joined_back(spark):
    import re

    from brickyard.operators.knn import nearest

    rows = spark.range(300).select(
        F.concat(F.lit("p"), "id").alias("listing_id"), F.lit("sale").alias("market"),
        (50 + (F.col("id") * 37 % 101) / 1000).alias("latitude"), (4 + (F.col("id") * 53 % 97) / 1000).alias("longitude"))
    found = nearest(rows, rows, 3)
    assert not re.search(r"Join \[_q#", plan(found))
    assert {(r.n, r.own) for r in found.select(F.size("neighbours").alias("n"), (
        F.get("neighbours", F.lit(0))["distance_m"] == 0).alias("own")).collect()} == {(3, True)}


def test_train_models_trims_rows_that_are_written(spark, monkeypatch):
    """What the price index adds is searched once: the trimming, which reads its rows three times, gets a file."""
    from brickyard.operators import model
    from brickyard.plans import catalog_model, scorer

    seen = []

    def trim(df):
        seen.append(df._jdf.queryExecution().toString())
        raise StopIteration

    monkeypatch.setattr(scorer, "with_index", lambda rows: (None, rows.repartition(3, "listing_id")))
    monkeypatch.setattr(model, "trim_outliers", trim)
    with pytest.raises(StopIteration):
        catalog_model.train_models(spark, SF)
    assert len(seen) == 1 and "Exchange" not in seen[0]


def test_train_models_fits_ensembles_of_full_size(spark, monkeypatch):
    """The query names no sizes of its own: forest and boosting have those of the operator."""
    from types import SimpleNamespace

    from brickyard.operators import model
    from brickyard.plans import catalog_model, scorer

    own, seen = model.regressors, []

    def regressors(*sizes, **named):
        seen.append(own(*sizes, **named))
        raise StopIteration

    rows = spark.createDataFrame([("a", "sale", "train", 1.0)], "listing_id string, market string, split string, price double")
    rows = rows.withColumns({c: F.lit(1.0) for c in catalog_model.S.MODEL_FEATURES})
    monkeypatch.setattr(scorer, "training_rows", lambda listings: rows)
    monkeypatch.setattr(scorer, "with_index", lambda listings: (None, rows))
    monkeypatch.setattr(scorer, "encoded", lambda train: SimpleNamespace(
        transform=lambda df: df.withColumn("features", F.lit(0.0))))
    monkeypatch.setattr(model, "trim_outliers", lambda df: df)
    monkeypatch.setattr(model, "regressors", regressors)
    with pytest.raises(StopIteration):
        catalog_model.train_models(spark, SF)
    forest, boosted = seen[0]["random_forest"], seen[0]["boosted_trees"]
    assert (forest.getNumTrees(), forest.getMaxDepth()) == (300, 22)
    assert (boosted.getMaxIter(), boosted.getMaxDepth()) == (400, 6)
