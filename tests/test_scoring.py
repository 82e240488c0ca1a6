"""Retraining and request scoring: no leak of test prices, saved pipelines, single rows, attribution."""

import random

import pytest
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from brickyard import schema as S
from brickyard.operators import model
from brickyard.plans import scorer

SCHEMA = ("listing_id string, market string, price double, livable_surface double, bedrooms double, epc string,"
          " property_type string, province string, region string, refnis bigint, latitude double, longitude double,"
          " garden string, scraped_at timestamp")


def _listings(seed=1, n=400):
    rng, rows = random.Random(seed), []
    for i in range(n):
        sale, surface = i % 3 != 0, rng.uniform(40, 250)
        place = (50.85 + rng.gauss(0, 0.02), 4.35 + rng.gauss(0, 0.02)) if i % 7 else (None, None)
        price = surface * (3000 if sale else 12) * rng.uniform(0.7, 1.4)
        rows.append((f"l{i:04d}", "sale" if sale else "rent", price, surface, float(rng.randint(1, 5)), rng.choice("ABC"),
                     rng.choice(["house", "apartment"]), "Brussels" if i % 5 else "Antwerp", "Brussels", 21000 + i % 4,
                     *place, rng.choice(["1", "0", None]), None))
    return rows


@pytest.fixture(scope="module")
def listings(spark):
    return spark.createDataFrame(_listings(), SCHEMA).cache()


@pytest.fixture(scope="module")
def trained(listings):
    return scorer.train(listings, lambda: DecisionTreeRegressor(labelCol="price", maxDepth=5, seed=1))


def test_a_test_price_moves_no_training_feature(spark, listings):
    def features(rows):
        _, out = scorer.with_index(scorer.training_rows(rows))
        return {r.listing_id: tuple(r) for r in out.filter("split = 'train'").collect()}

    bucket = model.split_bucket(F.col("listing_id")) < model.TEST_PERCENT
    moved = listings.withColumn("price", F.when(bucket, F.col("price") * 1.31).otherwise(F.col("price")))
    assert moved.filter(bucket).count() > 40
    one, two = features(listings), features(moved)
    assert one == two and len(one) > 250


def test_a_training_row_does_not_see_its_own_price(spark, listings):
    rows = scorer.training_rows(listings).filter("split = 'train' and latitude is not null and market = 'sale'").cache()
    own = rows.orderBy("listing_id").first().listing_id
    bent = rows.withColumn("price", F.when(F.col("listing_id") == own, F.col("price") * 1.3).otherwise(F.col("price")))

    def value(frame):
        fitted = scorer.NeighbourhoodIndex().fit(frame)
        near = fitted.transform(frame.filter(F.col("listing_id") == own)).first()
        return near.neighbourhood_price_index, fitted

    from brickyard.plans import surface
    found = [surface.lookup(f.filter(F.col("listing_id") == own), value(f)[1].points, exclude_id="listing_id").first().value
             for f in (rows, bent)]
    assert found[0] == found[1]


def test_saved_scorer_gives_the_same_scores_alone_and_in_a_batch(spark, trained, tmp_path):
    requests = spark.createDataFrame(
        [("a", "sale", 120.0, "Antwerp", None, None, "1"), ("b", "rent", None, None, 50.85, 4.35, None),
         ("c", "sale", 60.0, "Brussels", 50.86, 4.36, "yes"), ("d", "lease", 60.0, "Brussels", None, None, None)],
        "request_id string, market string, livable_surface double, province string, latitude double,"
        " longitude double, garden string")
    batch = {r.request_id: r for r in trained.score(requests).collect()}
    assert set(batch) == {"a", "b", "c"} and batch["b"].unit == "per month"
    assert all(0 <= r.low <= r.prediction <= r.high for r in batch.values())
    trained.save(str(tmp_path / "scorer"))
    again = scorer.Scorer.load(str(tmp_path / "scorer"))
    for rid in batch:
        assert again.score(requests.filter(F.col("request_id") == rid)).first() == batch[rid]
    ready = {r.request_id: r for r in again.prepare(requests).collect()}
    assert ready["a"].latitude == 51.21 and ready["a"].region == "Flanders" and ready["a"].garden == 1
    assert ready["b"].province == "Brussels" and ready["b"].livable_surface == 120 and ready["c"].garden == 0
    assert set(S.MODEL_FEATURES) <= set(again.prepare(requests).columns)


def test_whole_contract_is_trained_on(trained):
    stages = trained.models["sale"].stages
    assert stages[0].getOrDefault("numeric") == S.MODEL_NUMERIC
    assert stages[0].getOrDefault("categorical") == S.MODEL_CATEGORICAL and stages[0].getOrDefault("flags") == S.FLAGS
    assert trained.metrics["sale"]["r2"] > 0.3 and set(trained.models) == {"sale", "rent"}


@pytest.mark.parametrize("kind", ["tree", "forest", "boosted"])
def test_contributions_add_up_to_the_prediction(spark, listings, kind):
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    from brickyard.operators import attribution
    from pyspark.ml import Pipeline

    estimator = {"tree": DecisionTreeRegressor(labelCol="price", maxDepth=4),
                 "forest": RandomForestRegressor(labelCol="price", numTrees=4, maxDepth=4, seed=2),
                 "boosted": GBTRegressor(labelCol="price", maxIter=4, maxDepth=3, stepSize=0.2, seed=2)}[kind]
    rows = scorer.training_rows(listings).filter("market = 'sale'")
    names = ["livable_surface", "bedrooms", "latitude"], ["property_type", "epc"], ["garden"]
    fitted = Pipeline(stages=[scorer.Preparation(numeric=names[0], categorical=names[1], flags=names[2]),
                              *model.encoder(names[1], [*names[0], *names[2]]), estimator]).fit(rows)
    out = attribution.pipeline_attribution(rows, fitted)
    sums = out.groupBy("listing_id").agg(F.sum("contribution").alias("c"), F.first("base_value").alias("b"),
                                         F.first("prediction").alias("p")).collect()
    assert len(sums) == rows.count()
    assert all(abs(r.b + r.c - r.p) <= 1e-6 * max(1.0, abs(r.p)) for r in sums)
    assert {r.feature for r in out.select("feature").distinct().collect()} <= {n for g in names for n in g}
    top = model.top_drivers(out, top=2)
    assert top.groupBy("listing_id").count().agg(F.max("count")).first()[0] <= 2


def test_paths_looked_up_equal_paths_joined(spark, listings, monkeypatch):
    from pyspark.ml.regression import RandomForestRegressor

    from brickyard.operators import attribution

    rows = scorer.training_rows(listings).filter("market = 'sale'")
    fitted = scorer.fitted(rows, RandomForestRegressor(labelCol="price", numTrees=3, maxDepth=4, seed=2),
                           ["livable_surface", "bedrooms"], ["epc"], ["garden"])

    def contributions():
        out = attribution.pipeline_attribution(rows, fitted)
        plan = out._jdf.queryExecution().executedPlan().toString()
        return plan, {(r.listing_id, r.feature): (r.base_value, r.prediction, r.contribution) for r in out.collect()}

    plan, one = contributions()
    # beyond the one of the model frame no row of the table is shuffled
    assert plan.count("Exchange hashpartitioning(listing_id") == 1
    monkeypatch.setattr(attribution, "PATH_LEAVES", 0)
    _, two = contributions()
    assert one.keys() == two.keys() and len(one) > 500
    assert all(abs(x - y) <= 1e-6 * max(1.0, abs(y)) for k in one for x, y in zip(one[k], two[k]))


def test_a_model_without_the_index_looks_no_row_up(spark, listings, monkeypatch):
    from pyspark.ml.regression import LinearRegression

    from brickyard.plans import surface

    def train():
        return scorer.train(listings, lambda: LinearRegression(labelCol="price", solver="normal"),
                            numeric=["livable_surface", "bedrooms"], categorical=[], flags=[])

    requests = spark.createDataFrame(
        [("r1", "sale", 90.0, None, 50.85, 4.35), ("r2", "rent", None, 2.0, None, None), ("r3", "none", 1.0, 1.0, None, None)],
        "request_id string, market string, livable_surface double, bedrooms double, latitude double, longitude double")
    asked = []
    found = surface.lookup
    monkeypatch.setattr(surface, "lookup", lambda *a, **k: asked.append(1) or found(*a, **k))
    fitted = train()
    scores = {r.request_id: r for r in fitted.score(requests).collect()}
    assert set(scores) == {"r1", "r2"} and all(r.prediction > 0 for r in scores.values()) and not asked
    # the matrix of the requests still has the index
    matrix = {r.request_id: r.neighbourhood_price_index for r in fitted.prepare(requests).collect()}
    assert asked and set(matrix) == {"r1", "r2"} and all(0 <= v <= 100 for v in matrix.values())


def test_search_ranks_the_seeded_draws_the_same_twice(spark, listings):
    from pyspark.ml import Pipeline

    from brickyard.operators import search

    rows = scorer.training_rows(listings).filter("market = 'sale'")
    stages = [scorer.Preparation(numeric=["livable_surface", "bedrooms"], categorical=["property_type"], flags=[]),
              *model.encoder(["property_type"], ["livable_surface", "bedrooms"])]
    folds = search.search_folds(Pipeline(stages=stages).fit(rows).transform(rows))
    assert folds.count() == rows.count()
    est, space = model.regressors()["decision_tree"], model.search_space("decision_tree", 40)
    rungs = ((0.3, 1, 1.0), (1.0, 2, 1.0))
    one, two = (search.successive_halving("decision_tree", est, folds, space, rungs=rungs, keep=0.1).collect()
                for _ in range(2))
    assert one == two and len(one) == 40 and sorted(r.position for r in one) == list(range(1, 41))
    best = min(one, key=lambda r: r.position)
    assert best.rung == 1 and best.score > 0.3 and best.spatial_score is not None
    assert sum(r.rung == 1 for r in one) == 4 and all(r.params for r in one)


@pytest.mark.parametrize("algorithm", ["linear_regression", "random_forest", "boosted_trees"])
def test_search_covers_the_other_algorithms(spark, listings, algorithm):
    from pyspark.ml import Pipeline

    from brickyard.operators import search

    rows = scorer.training_rows(listings).filter("market = 'sale'")
    stages = [scorer.Preparation(numeric=["livable_surface", "bedrooms"], categorical=[], flags=[]),
              *model.encoder([], ["livable_surface", "bedrooms"])]
    folds = search.search_folds(Pipeline(stages=stages).fit(rows).transform(rows))
    space = [{**p, **({"maxDepth": 3} if "maxDepth" in p else {})} for p in model.search_space(algorithm, 3)[:3]]
    got = search.successive_halving(algorithm, model.regressors()[algorithm], folds, space,
                                    rungs=((0.5, 1, 0.005), (1.0, 1, 0.01)), keep=0.4).collect()
    assert len(got) == 3 and min(got, key=lambda r: r.position).spatial_score is not None
