"""Path attribution of tree ensembles: what each feature moved a prediction by.

A row's prediction in a tree is the mean of its root plus the change of the node mean at each
step down to its leaf; the change counts for the feature that the step split on. The changes
on the way to a leaf are the same for all rows, so the paths are followed once, level by
level, over the table of nodes. Rows then look up the leaves that the fitted model puts them in:
in a table that goes along with the rows, so that a row is finished where it is read, or, beyond
``PATH_LEAVES`` leaves, by a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brickyard.operators.model import feature_names, origin_feature
from brickyard.session import cut, new_path

PATH_LEAVES = 50_000  # counted leaves up to which the paths go along with the rows


def tree_nodes(fitted) -> DataFrame:
    """Nodes of a fitted MLlib tree, forest or boosted model: (tree, weight, node, mean, left, right, feature).

    ``weight`` is the tree's share in the prediction; leaves have no children (-1).
    """
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    path = new_path(spark, "trees")
    fitted.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "treeID" in data.columns:
        boosted = "GBT" in type(fitted).__name__
        weights = [float(w) for w in fitted.treeWeights] if boosted else [1.0 / fitted.getNumTrees] * fitted.getNumTrees
        data = data.select(F.col("treeID").alias("tree"), "nodeData.*")
    else:
        weights, data = [1.0], data.withColumn("tree", F.lit(0))
    shares = spark.createDataFrame(list(enumerate(weights)), "tree int, weight double")
    return cut(data.select("tree", F.col("id").alias("node"), F.col("prediction").alias("mean"),
                           F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
                           F.col("split.featureIndex").alias("feature")).join(F.broadcast(shares), "tree"))


def leaf_paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, base, steps): each leaf's number from the left, its root's mean, its steps.

    A step is (feature, contribution), already weighted by the tree.
    """
    steps = "array<struct<feature:int,contribution:double>>"
    at = nodes.filter("node = 0").select("tree", "node", "mean", "left", "right", "feature", "weight",
                                         (F.col("mean") * F.col("weight")).alias("base"),
                                         F.array().cast(steps).alias("steps"))
    done = None
    while True:
        leaves = at.filter("left < 0").select("tree", "node", "base", "steps")
        done = leaves if done is None else cut(done.unionByName(leaves))
        inner = at.filter("left >= 0")
        if inner.isEmpty():
            break
        child = nodes.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("mean").alias("_m"),
                             F.col("left").alias("_l"), F.col("right").alias("_r"), F.col("feature").alias("_f"))
        down = inner.withColumn("_next", F.explode(F.array("left", "right"))).join(
            child, (F.col("tree") == F.col("_t")) & (F.col("_next") == F.col("_n")))
        step = F.struct("feature", ((F.col("_m") - F.col("mean")) * F.col("weight")).alias("contribution"))
        at = cut(down.select("tree", F.col("_n").alias("node"), F.col("_m").alias("mean"), F.col("_l").alias("left"),
                             F.col("_r").alias("right"), F.col("_f").alias("feature"), "weight", "base",
                             F.concat("steps", F.array(step)).alias("steps")))
    number = F.row_number().over(Window.partitionBy("tree").orderBy("node")) - 1
    return cut(done.withColumn("leaf", number).drop("node"))


def tree_attribution(df: DataFrame, fitted: PipelineModel, names: Sequence[str], id_col: str = "listing_id",
                     roll_up: bool = True) -> DataFrame:
    """(id, base_value, prediction, feature, contribution), long; base and contributions add up.

    ``names`` are the entries of the feature vector; with ``roll_up`` those of one raw feature
    are summed. Features that no path of a row used are left out. ``id_col`` tells rows apart.
    """
    model = fitted.stages[-1].copy()
    model.setLeafCol("_leaf")
    paths = leaf_paths(tree_nodes(model))
    base = paths.select("tree", "base").distinct().agg(F.sum("base")).first()[0]
    rows = df
    for stage in fitted.stages[:-1]:
        rows = stage.transform(rows)
    scored = model.transform(rows)
    kind = dict(scored.dtypes)["_leaf"]
    leaves = F.array("_leaf") if kind == "double" else vector_to_array(F.col("_leaf"))
    if paths.count() <= PATH_LEAVES:
        out = _looked_up(scored.select(id_col, "prediction", leaves.alias("_leaves")), paths, names, roll_up)
        return out.select(id_col, F.lit(base).alias("base_value"), "prediction", "feature", "contribution")
    hits = scored.select(id_col, "prediction", F.posexplode(leaves).alias("tree", "leaf")).withColumn(
        "leaf", F.col("leaf").cast("int"))
    label: Column = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_s.feature") + 1)
    label = origin_feature(label) if roll_up else label
    out = (hits.join(paths.select("tree", "leaf", "steps"), ["tree", "leaf"])
           .select(id_col, "prediction", F.explode("steps").alias("_s"))
           .groupBy(id_col, "prediction", label.alias("feature"))
           .agg(F.sum("_s.contribution").alias("contribution")))
    return out.select(id_col, F.lit(base).alias("base_value"), "prediction", "feature", "contribution")


def _looked_up(rows: DataFrame, paths: DataFrame, names: Sequence[str], roll_up: bool) -> DataFrame:
    """(..., feature, contribution) of rows with ``_leaves``; nothing of a row is shuffled.

    The table holds, by tree and by leaf from the left, the sum of the steps on each feature,
    null for those that the path does not use.
    """
    label: Column = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_s.feature") + 1)
    label = origin_feature(label) if roll_up else label
    sums = cut(paths.select("tree", "leaf", F.explode_outer("steps").alias("_s"))
               .groupBy("tree", "leaf", label.alias("feature")).agg(F.sum("_s.contribution").alias("c")))
    features = [r.feature for r in sums.filter("feature IS NOT NULL").select("feature").distinct().orderBy("feature").collect()]
    if not features:
        return rows.select(*[c for c in rows.columns if c != "_leaves"], F.lit(None).cast("string").alias("feature"),
                           F.lit(None).cast("double").alias("contribution")).limit(0)
    leaf = sums.groupBy("tree", "leaf").agg(
        F.array(*[F.sum(F.when(F.col("feature") == f, F.col("c"))) for f in features]).alias("c"))
    tree = leaf.groupBy("tree").agg(F.array_sort(F.collect_list(F.struct("leaf", "c"))).alias("leaves"))
    tables = tree.agg(F.transform(F.array_sort(F.collect_list(F.struct("tree", "leaves"))),
                                  lambda t: t["leaves"]["c"]).alias("_tables"))
    used = F.transform("_leaves", lambda leaf, tree: F.get(F.get("_tables", tree), leaf.cast("int")))

    def total(i: int) -> Column:
        own = F.filter(F.transform("_used", lambda c: F.get(c, F.lit(i))), lambda v: v.isNotNull())
        return F.when(F.size(own) > 0, F.aggregate(own, F.lit(0.0), lambda a, v: a + v))

    items = F.array(*[F.struct(F.lit(f).alias("feature"), total(i).alias("contribution")) for i, f in enumerate(features)])
    kept = [c for c in rows.columns if c != "_leaves"]
    return (rows.crossJoin(F.broadcast(tables)).select(*kept, used.alias("_used"))
            .select(*kept, F.explode(F.filter(items, lambda x: x["contribution"].isNotNull())).alias("_x"))
            .select(*kept, "_x.feature", "_x.contribution"))


def pipeline_attribution(df: DataFrame, fitted: PipelineModel, id_col: str = "listing_id") -> DataFrame:
    """Attribution by a pipeline of ``plans/scorer.py``: preparation, encoder, tree model."""
    first = fitted.stages[0]
    numeric, categorical, flags = (first.getOrDefault(p) for p in ("numeric", "categorical", "flags"))
    encoder = PipelineModel(stages=fitted.stages[1:])
    return tree_attribution(df, fitted, feature_names(encoder, numeric, categorical, flags), id_col)
