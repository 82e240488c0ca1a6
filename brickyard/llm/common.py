"""Shared helpers of the text operators: written stages, table access, partition counts."""

from __future__ import annotations

import contextlib
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brickyard.session import new_path

REPEATS = 4  # rows of one labelled id that a model is fitted on

_SCOPES: list[list[str]] = [[]]


@contextlib.contextmanager
def scope() -> Iterator[list[str]]:
    """Collect the paths of the stages written inside, for ``release``."""
    _SCOPES.append([])
    try:
        yield _SCOPES[-1]
    finally:
        _SCOPES.pop()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    Later steps start from the file, whatever executors were lost before; unlike a
    checkpoint the file keeps column pruning, filter push-down and row counts.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    _SCOPES[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_path(path: str) -> str:
    """Let ``release`` delete ``path`` as well."""
    _SCOPES[-1].append(path)
    return path


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete stages (all outside a scope by default) once the results that read them are saved."""
    paths = _SCOPES[0] if paths is None else paths
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def parts(total: float, each: float, least: int = 1) -> int:
    """Partitions so that each holds about ``each`` of ``total``."""
    return max(least, math.ceil((total or 0) / each))


def at_most(rows: DataFrame, each: int) -> DataFrame:
    """At most ``each`` rows per ``_id`` by hash order of ``_text``, kept before the shuffle."""
    order = Window.partitionBy("_id").orderBy(F.xxhash64("_text"))
    return rows.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= each).drop("_rn")
