"""Registered queries against their SQL on the smallest tables."""

import pytest

import parity
from __spark_entry__ import entry
from brickyard.plans.catalog import QUERIES, SQL
from conftest import SF

# The SQL of these searches a fixed window around each listing, which is too small for the
# sparse smallest tables; test_spatial compares the operator with brute force.
WINDOWED = {"knn_join", "knn_loo", "knn_confidence", "neighbourhood_index", "serve_index"}
# These need unique listing ids; the smallest tables hold one id twice, the next ones none.
KEYED = {"eda_corr", "pages_to_listings"}
# Trained trees: SQL cannot express them; test_scoring holds them to sums and to a second run.
TRAINED = {"train_models", "attribution_trees", "forest_importances"}
UNIQUE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def duck():
    return {sf: parity.duck(sf) for sf in (SF, UNIQUE)}


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == TRAINED


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WINDOWED - TRAINED))
def test_query(spark, duck, name):
    sf = UNIQUE if name in KEYED else SF
    problem, *_ = parity.compare(spark, duck[sf], sf, name, QUERIES[name], SQL[name])
    assert problem is None or (problem == "no rows" and name == "build_surface"), problem
