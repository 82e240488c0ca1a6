"""Hyper-parameter search by successive halving over folds that are prepared once.

All draws of an algorithm start on a small share of the training rows and one fold; the better
part of them goes on to a larger share and more folds, until the last few see everything. Every
draw leaves a row: its parameters, how far it came and its score under random and under spatial
folds. Shares are by hash of the id and draws are seeded, so a search can be repeated.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickyard.operators.model import SEED, spatial_folds
from brickyard.session import cut

#: (share of the training rows, folds, share of an ensemble's trees) of each rung.
RUNGS = ((0.125, 1, 0.125), (0.5, 2, 0.5), (1.0, 4, 1.0))
KEEP = 1 / 3
FOLDS = 4
_TREES = ("numTrees", "maxIter")


def search_folds(rows: DataFrame, folds: int = FOLDS, id_col: str = "listing_id") -> DataFrame:
    """Rows with ``random_fold``, ``spatial_fold`` and ``_share`` (0 to 1 by hash), written once.

    ``rows`` have the feature vector already, so no draw prepares anything again. A row without
    coordinates is a cell of its own.
    """
    mark = F.pmod(F.xxhash64(F.lit(SEED), F.col(id_col)), F.lit(1 << 20))
    random_fold = F.pmod(F.xxhash64(F.lit(SEED + 1), F.col(id_col)), F.lit(folds)).cast("int")
    located = rows.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    placed = spatial_folds(located, folds).select(id_col, F.col("fold").alias("spatial_fold"))
    return cut(rows.join(placed, id_col, "left").withColumns({
        "random_fold": random_fold, "spatial_fold": F.coalesce("spatial_fold", random_fold),
        "_share": mark / float(1 << 20)}))


def _score(estimator, params: Mapping[str, object], rows: DataFrame, fold_col: str, share: float, folds: int,
           trees: float) -> float:
    """Mean R² over the first ``folds`` folds, trained on ``share`` of the other rows."""
    own = {k: max(1, round(v * trees)) if k in _TREES else v for k, v in params.items()}
    chosen = estimator.copy({estimator.getParam(k): v for k, v in own.items()})
    evaluator = RegressionEvaluator(labelCol="price", predictionCol="prediction", metricName="r2")
    scores = []
    for fold in range(folds):
        train = rows.filter((F.col(fold_col) != fold) & (F.col("_share") < share))
        scores.append(evaluator.evaluate(chosen.fit(train).transform(rows.filter(F.col(fold_col) == fold))))
    return sum(scores) / len(scores)


def successive_halving(algorithm: str, estimator, rows: DataFrame, space: Sequence[Mapping[str, object]],
                       fold_col: str = "random_fold", rungs: Sequence[tuple[float, int, float]] = RUNGS,
                       keep: float = KEEP, parallelism: int = 4) -> DataFrame:
    """One row per draw: algorithm, draw, params, rung, score, spatial_score, position.

    ``rows`` come from :func:`search_folds`. The score is that of the draw's last rung; draws
    rank by rung, then score, then number. The draws of the last rung also get their score
    under spatial folds.
    """
    state = {i: (-1, float("-inf")) for i in range(len(space))}
    alive = list(state)
    with ThreadPoolExecutor(parallelism) as pool:
        for rung, (share, folds, trees) in enumerate(rungs):
            got = pool.map(lambda i: _score(estimator, space[i], rows, fold_col, share, folds, trees), alive)
            for i, score in zip(alive, got):
                state[i] = (rung, score)
            if rung + 1 < len(rungs):
                alive = sorted(alive, key=lambda i: (-state[i][1], i))[:max(1, round(len(alive) * keep))]
        share, folds, trees = rungs[-1]
        spatial = dict(zip(alive, pool.map(
            lambda i: _score(estimator, space[i], rows, "spatial_fold", share, folds, trees), alive)))
    order = sorted(state, key=lambda i: (-state[i][0], -state[i][1], i))
    table = [(algorithm, i, json.dumps(space[i], sort_keys=True), state[i][0], float(state[i][1]),
              None if i not in spatial else float(spatial[i]), order.index(i) + 1) for i in sorted(state)]
    return rows.sparkSession.createDataFrame(
        table, "algorithm string, draw int, params string, rung int, score double, spatial_score double, position int")
