"""Delimited files, nightly consolidation, search, validation gap, fitted importances."""

import random

import pytest
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from brickyard.operators import dedup, model
from brickyard.sources import store
from brickyard.streaming import jobs

NUMERIC, CATEGORICAL = ["livable_surface", "latitude"], ["property_type"]


@pytest.fixture(scope="module")
def homes(spark):
    """Prices that follow the surface, over a few cells; the type adds little."""
    rng = random.Random(1)
    rows = []
    for i in range(400):
        surface, kind = rng.uniform(40, 200), rng.choice(["house", "villa", None])
        rows.append((str(i), "sale", 50 + (i % 12) * 0.1, 4 + (i % 7) * 0.1, surface, kind,
                     1000 * surface + (500.0 if kind == "villa" else 0.0)))
    df = spark.createDataFrame(rows, "listing_id string, market string, latitude double, longitude double, "
                                     "livable_surface double, property_type string, price double")
    return model.prepare(df, [], CATEGORICAL, [], {}).cache()


def features(df):
    from pyspark.ml import Pipeline

    return Pipeline(stages=model.encoder(CATEGORICAL, NUMERIC)).fit(df).transform(df)


def test_delimited_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 1.5), ('say "x"', None), (None, 2.0)], "name string, value double")
    for sep in (True, False):
        store.write_split(df, str(tmp_path / f"out{sep}"), as_csv=sep)
    got = store.read_csv(spark, str(tmp_path / "outTrue"), "name string, value double")
    assert sorted(got.collect(), key=str) == sorted(df.collect(), key=str)
    assert spark.read.parquet(str(tmp_path / "outFalse")).count() == 3
    (tmp_path / "bad.csv").write_text("name;value\nx;1\ny;many\n")
    got = store.read_csv(spark, str(tmp_path / "bad.csv"), "name string, value double", sep=";")
    assert [tuple(r) for r in got.orderBy("name").collect()] == [("x", 1.0), ("y", None)]


def test_consolidation_takes_each_pass_once(spark, tmp_path):
    raw, kept, inbox = (str(tmp_path / n) for n in ("raw", "store", "inbox"))
    priority = dedup.priority_table(spark, {"site_a": 2, "site_b": 1})
    schema = ("listing_id string, source string, market string, url string, postal_code string, "
              "street string, house_number string, livable_surface double, bedrooms bigint, price double")

    def capture(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)

    def run():
        def merge(batch, number):
            store.append_raw(batch, raw, f"b{number}")
            store.merge_market(spark, raw, kept, priority)
        stream = jobs.file_stream(spark, inbox, "*.parquet", spark.read.parquet(inbox).schema)
        jobs.consolidate(stream, merge, str(tmp_path / "checkpoint"))
        return {r.listing_id for r in store.read_store(spark, kept).select("listing_id").collect()}

    capture(("1", "site_a", "sale", "u1", "1000", "Main", "1", 100.0, 2, 100_000.0),
            ("2", "site_b", "sale", "u2", "1000", "Main", "1", 100.0, 2, 102_000.0))
    assert run() == {"1"}
    capture(("3", "site_b", "sale", "u3", "2000", "Side", "5", 80.0, 1, 90_000.0))
    assert run() == {"1", "3"}
    version = store.current_version(spark, kept)
    assert run() == {"1", "3"} and store.current_version(spark, kept) == version == 2


def test_search_prefers_the_weaker_penalty(homes):
    est = LinearRegression(labelCol="price", solver="normal")
    space = model.search_space("linear_regression")
    assert len(space) == 10
    found = model.tune("linear_regression", est, features(homes), [space[0], {"regParam": 1e7}], folds=2)
    assert found.bestModel.getRegParam() == space[0]["regParam"]
    assert found.avgMetrics[0] > found.avgMetrics[1]


def test_validation_gap_of_spatial_folds(homes):
    folds = model.spatial_folds(homes, 3)
    assert folds.groupBy("market", "cell").agg(F.countDistinct("fold").alias("n")).filter("n > 1").isEmpty()
    gap = model.cv_gap(LinearRegression(labelCol="price", solver="normal"), features(folds), folds=3)
    assert gap["random_r2"] > 0.99 and gap["spatial_r2"] > 0.99
    assert gap["gap"] == pytest.approx(gap["random_r2"] - gap["spatial_r2"])


def test_importances_of_a_fitted_forest(homes):
    forest = RandomForestRegressor(labelCol="price", numTrees=5, maxDepth=4, seed=1)
    fitted = model.train_pipeline(homes, NUMERIC, CATEGORICAL, [], forest)
    names = model.fitted_importances(fitted, "sale", NUMERIC, CATEGORICAL, [])
    assert {r.name for r in names.collect()} == {"num__livable_surface", "num__latitude",
        "cat__property_type_house", "cat__property_type_missing", "cat__property_type_villa"}
    top = model.importance_rollup(names).orderBy("position").collect()
    assert top[0].feature == "livable_surface"
    assert {r.feature for r in top} == {"livable_surface", "latitude", "property_type"}
    assert sum(r.importance for r in top) == pytest.approx(1.0)
