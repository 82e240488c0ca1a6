"""Model preparation, training, evaluation and attribution with MLlib and columns."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, LinearRegression,
                                   RandomForestRegressor)
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brickyard import schema as S
from brickyard.functions import geo, money
from brickyard.operators.quantiles import group_quantiles, value_ranks

SEED = 42
TEST_PERCENT = 20


# -- splits ------------------------------------------------------------------
def split_bucket(c: Column) -> Column:
    """0..99 from a hash of the id, the same on every run and partitioning."""
    head = F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("bigint")
    return F.pmod(head, F.lit(100))


def hash_split(df: DataFrame, id_col: str = "listing_id",
               test_percent: int = TEST_PERCENT) -> DataFrame:
    """Add ``split``: test or train."""
    return df.withColumn("split", F.when(split_bucket(F.col(id_col)) < test_percent, "test")
                         .otherwise("train"))


def trim_outliers(df: DataFrame, target: str = "price", low: float = 0.01,
                  high: float = 0.99) -> DataFrame:
    """Drop training rows outside their market's quantiles; test rows are kept as they are.

    The quantiles read ``df`` twice and the result reads it again; a caller whose ``df`` is much
    work writes it before.
    """
    q = group_quantiles(df.filter(F.col("split") == "train"), ["market"],
                        {"_lo": (F.col(target), low), "_hi": (F.col(target), high)})
    return (df.join(q, "market", "left")
            .filter((F.col("split") != "train") | F.col(target).between(F.col("_lo"), F.col("_hi")))
            .drop("_lo", "_hi"))


def spatial_folds(df: DataFrame, folds: int = 4) -> DataFrame:
    """Add ``fold`` so that all listings of a coarse cell share one, with balanced sizes.

    Cells are dealt out in order of size, forth and back over the folds. The order is found
    from ranks of the cell sizes, not by sorting the cells in one task.
    """
    cell = geo.spatial_cell(F.col("latitude"), F.col("longitude"))
    rows = df.withColumn("cell", cell)
    cells = rows.groupBy("market", "cell").agg(F.count("*").alias("n"))
    ranks = value_ranks(cells, ["market"], "n")
    same = Window.partitionBy("market", "n").orderBy("cell")
    placed = cells.join(ranks, ["market", "n"]).withColumn(
        "_at", F.col("n_total") - F.col("n_le") + F.row_number().over(same) - 1)
    turn = F.pmod(F.col("_at"), F.lit(2 * folds))
    fold = F.when(turn < folds, turn).otherwise(F.lit(2 * folds - 1) - turn).cast("int")
    return rows.join(placed.select("market", "cell", fold.alias("fold")), ["market", "cell"])


# -- preprocessing -----------------------------------------------------------
def fit_scaling(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float, float]]:
    """Exact median, and mean and population deviation after imputing it, per column."""
    med = group_quantiles(df, [], {c: (F.col(c), 0.5) for c in columns}).first()
    fill = {c: float(med[c]) for c in columns if med is not None and med[c] is not None}
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(fill.get(c, 0.0))) for c in columns}
    row = df.agg(*[F.avg(e).alias(f"m_{c}") for c, e in filled.items()],
                 *[F.stddev_pop(e).alias(f"s_{c}") for c, e in filled.items()]).first()
    return {c: (fill.get(c, 0.0), row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in columns}


def apply_scaling(df: DataFrame, fitted: Mapping[str, tuple[float, float, float]],
                  suffix: str = "") -> DataFrame:
    """Impute the median and standardise."""
    return df.withColumns({
        f"{c}{suffix}": (F.coalesce(F.col(c).cast("double"), F.lit(med)) - F.lit(mean)) / F.lit(std)
        for c, (med, mean, std) in fitted.items()})


def encoder(categorical: Sequence[str], numeric: Sequence[str]) -> list:
    """Pipeline stages: one-hot categories (unseen ones are all zeros) and one vector."""
    idx = [f"{c}_idx" for c in categorical]
    stages: list = []
    if categorical:
        stages.append(StringIndexer(inputCols=list(categorical), outputCols=idx,
                                    handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCols=idx, outputCols=[f"{c}_vec" for c in categorical],
                                    dropLast=True))
    stages.append(VectorAssembler(inputCols=[*numeric, *[f"{c}_vec" for c in categorical]],
                                  outputCol="features"))
    return stages


def prepare(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
            flags: Sequence[str], fitted: Mapping[str, tuple[float, float, float]]) -> DataFrame:
    """Scaled numbers, ``missing`` for absent categories, 0 for absent flags."""
    out = apply_scaling(df, {c: fitted[c] for c in numeric})
    return out.withColumns({
        **{c: F.coalesce(F.col(c), F.lit("missing")) for c in categorical},
        **{c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in flags}})


# -- training ----------------------------------------------------------------
# Defaults of the four regressors and their search spaces.
def regressors(forest_trees: int = 300, forest_depth: int = 22, boost_rounds: int = 400,
               boost_depth: int = 6) -> dict[str, object]:
    common = dict(featuresCol="features", labelCol="price", predictionCol="prediction")
    return {
        "linear_regression": LinearRegression(**common),
        "decision_tree": DecisionTreeRegressor(seed=SEED, maxDepth=min(forest_depth, 30), **common),
        "random_forest": RandomForestRegressor(
            seed=SEED, numTrees=forest_trees, maxDepth=forest_depth, minInstancesPerNode=2, **common),
        "boosted_trees": GBTRegressor(seed=SEED, maxIter=boost_rounds, maxDepth=boost_depth,
                                      stepSize=0.05, subsamplingRate=0.9, **common),
    }


def search_space(algorithm: str, draws: int = 40) -> list[dict[str, float]]:
    """Grid for the linear model, seeded random draws for the trees."""
    rng = random.Random(SEED)
    if algorithm == "linear_regression":
        return [{"regParam": a} for a in (0.001, 0.01, 0.1, 1, 3, 10, 30, 100, 300, 1000)]
    if algorithm == "decision_tree":
        return [{"maxDepth": rng.choice([4, 6, 8, 10, 12, 16, 20, 30]),
                 "minInstancesPerNode": rng.randint(1, 39)} for _ in range(draws)]
    if algorithm == "random_forest":
        return [{"numTrees": rng.choice([200, 300, 400, 600]),
                 "maxDepth": rng.choice([12, 16, 22, 30]),
                 "minInstancesPerNode": rng.choice([1, 2, 4, 8]),
                 "featureSubsetStrategy": rng.choice(["all", "sqrt", "0.5", "0.7"])}
                for _ in range(draws)]
    if algorithm == "boosted_trees":
        return [{"maxIter": rng.randint(300, 1299), "stepSize": 10 ** rng.uniform(-2, -0.69897),
                 "maxDepth": rng.randint(3, 8), "subsamplingRate": rng.uniform(0.7, 1.0),
                 "minInstancesPerNode": rng.randint(1, 7)} for _ in range(draws)]
    raise ValueError(f"unknown algorithm {algorithm}")


def tune(algorithm: str, estimator, train: DataFrame, space: Sequence[Mapping[str, object]],
         folds: int = 4, parallelism: int = 2, fold_col: str | None = None) -> CrossValidatorModel:
    """Cross-validated search by R²; ``fold_col`` gives spatial instead of random folds."""
    maps = [{estimator.getParam(k): v for k, v in params.items()} for params in space]
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=maps, numFolds=folds, seed=SEED,
                        parallelism=parallelism, evaluator=RegressionEvaluator(
                            labelCol="price", predictionCol="prediction", metricName="r2"))
    if fold_col:
        cv = cv.setFoldCol(fold_col)
    return cv.fit(train)


def cv_gap(estimator, train: DataFrame, fold_col: str = "fold", folds: int = 4) -> dict[str, float]:
    """R² under random and under spatial folds; the gap is the cost of unseen areas."""
    space = [{}]
    rand = tune("", estimator, train.drop(fold_col), space, folds).avgMetrics[0]
    spatial = tune("", estimator, train, space, folds, fold_col=fold_col).avgMetrics[0]
    return {"random_r2": rand, "spatial_r2": spatial, "gap": rand - spatial}


def train_pipeline(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                   flags: Sequence[str], estimator) -> PipelineModel:
    """Encoder and estimator fitted on prepared rows."""
    stages = [*encoder(categorical, [*numeric, *flags]), estimator]
    return Pipeline(stages=stages).fit(train)


# -- evaluation --------------------------------------------------------------
def regression_metrics(df: DataFrame, keys: Sequence[str], actual: str = "price",
                       predicted: str = "prediction") -> DataFrame:
    """R², MAE and RMSE per group in one combinable aggregation."""
    err = F.col(actual) - F.col(predicted)
    sums = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.abs(err)).alias("mae"), F.avg(err * err).alias("_mse"),
        F.var_pop(actual).alias("_var"))
    return sums.select(*keys, "n", (1 - F.col("_mse") / F.nullif(F.col("_var"), F.lit(0.0)))
                       .alias("r2"), "mae", F.sqrt("_mse").alias("rmse"))


def ensemble_average(df: DataFrame, id_col: str, algorithms: Sequence[str]) -> DataFrame:
    """One column per algorithm and their mean, per row id."""
    out = df.groupBy(id_col).pivot("algorithm", list(algorithms)).agg(F.first("prediction"))
    total = sum((F.coalesce(F.col(a), F.lit(0.0)) for a in algorithms), F.lit(0.0))
    known = sum((F.col(a).isNotNull().cast("int") for a in algorithms), F.lit(0))
    return out.withColumn("average", total / F.nullif(known, F.lit(0)))


def leaderboard(metrics: DataFrame) -> DataFrame:
    """Algorithms of a market by tuned, else trained, test R²."""
    score = F.coalesce("tuned_test_r2", "trained_test_r2")
    w = Window.partitionBy("market").orderBy(F.col("score").desc_nulls_last(), "algorithm")
    return metrics.withColumn("score", score).withColumn("position", F.row_number().over(w))


# -- attribution -------------------------------------------------------------
def origin_feature(name: Column, categorical: Sequence[str] = S.MODEL_CATEGORICAL) -> Column:
    """Raw feature of a transformed column (``cat__province_Namur`` is province)."""
    rest = F.regexp_replace(name, r"^(num|cat|bin)__", "")
    out = rest
    for c in sorted(categorical, key=len):  # the longest matching name is applied last
        out = F.when(name.startswith("cat__") & ((rest == c) | rest.startswith(c + "_")), c).otherwise(out)
    return out


def importance_rollup(df: DataFrame, keys: Sequence[str] = ("market",), top: int = 8) -> DataFrame:
    """Importance summed back to raw features, the largest ``top`` per group."""
    summed = (df.groupBy(*keys, origin_feature(F.col("name")).alias("feature"))
              .agg(F.sum("importance").alias("importance")))
    w = Window.partitionBy(*keys).orderBy(F.desc("importance"), "feature")
    return (summed.withColumn("position", F.row_number().over(w))
            .filter(F.col("position") <= top))


def feature_names(model: PipelineModel, numeric: Sequence[str], categorical: Sequence[str],
                  flags: Sequence[str]) -> list[str]:
    """Transformed column names in vector order."""
    names = [*[f"num__{c}" for c in numeric], *[f"bin__{c}" for c in flags]]
    if categorical:
        for c, labels in zip(categorical, model.stages[0].labelsArray):
            names.extend(f"cat__{c}_{v}" for v in labels)
    return names


def fitted_importances(fitted: PipelineModel, market: str, numeric: Sequence[str],
                       categorical: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """Importances of a fitted tree model (market, name, importance), one row per vector entry."""
    values = fitted.stages[-1].featureImportances.toArray().tolist()
    names = feature_names(fitted, numeric, categorical, flags)
    return SparkSession.active().createDataFrame(
        [(market, n, v) for n, v in zip(names, values, strict=True)],
        "market string, name string, importance double")


def linear_attribution(df: DataFrame, coefficients: Mapping[str, float], intercept: float,
                       means: Mapping[str, float], id_col: str = "listing_id") -> DataFrame:
    """Exact contributions ``coef * (x - mean)``: id, base, feature, contribution (long)."""
    base = intercept + sum(coefficients[c] * means[c] for c in coefficients)
    items = F.array(*[F.struct(F.lit(c).alias("feature"), (F.lit(w) * (F.col(c) - F.lit(means[c])))
                               .alias("contribution")) for c, w in coefficients.items()])
    return (df.select(id_col, F.lit(base).alias("base_value"), F.explode(items).alias("_x"))
            .select(id_col, "base_value", "_x.feature", "_x.contribution"))


def top_drivers(contributions: DataFrame, id_col: str = "listing_id", top: int = 6) -> DataFrame:
    """Largest contributions by absolute value per row, with their direction."""
    w = Window.partitionBy(id_col).orderBy(F.desc(F.abs("contribution")), "feature")
    return (contributions.withColumn("position", F.row_number().over(w))
            .filter(F.col("position") <= top)
            .withColumn("direction", F.when(F.col("contribution") >= 0, "up").otherwise("down")))


def batch_score(df: DataFrame, model: PipelineModel, mae: float, market: str) -> DataFrame:
    """Prediction floored at zero, two digits, with its band and unit."""
    scored = model.transform(df)
    value = F.greatest(F.lit(0.0), money.rounded(F.col("prediction")))
    low, high = money.band(F.col("prediction"), F.lit(mae))
    return (scored.withColumn("prediction", value)
            .withColumns({"low": money.rounded(low), "high": money.rounded(high),
                          "unit": F.lit("per month" if market == "rent" else "total")}))
