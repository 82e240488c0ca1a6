"""Versions of a partitioned store: immutable folders, one small manifest file a version.

A manifest names the folder of every partition; partitions that a version did not change keep
the folder of the version before. A version exists once its manifest does, and that file is
created exclusively, complete: of two writers one gets the number, the other starts again from
the new version. Folders have names of their own, so what a failed write leaves behind is in
nobody's way.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ATTEMPTS = 20


class Conflict(Exception):
    """Another writer has committed the version in the meantime."""


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, pattern: str) -> list[str]:
    p, fs = _path(spark, pattern)
    return [s.getPath().toString() for s in fs.globStatus(p) or []]


def current_version(spark: SparkSession, path: str) -> int:
    """Number of the last version, 0 when there is none."""
    names = [os.path.basename(n) for n in _names(spark, f"{path}/manifest/*")]
    odd = [n for n in names if not (n.endswith(".json") and n[:-5].isdigit()) and not n.startswith(("_", "."))]
    if odd:
        raise ValueError(f"not a manifest: {odd[0]}")
    return max((int(n[:-5]) for n in names if n[:-5].isdigit()), default=0)


def manifest(spark: SparkSession, path: str, version: int) -> dict[str, dict[str, str]]:
    """Table name -> partition -> folder of a version; version 0 has none."""
    if not version:
        return {}
    rows = spark.read.option("wholetext", True).text(f"{path}/manifest/{version:012d}.json").collect()
    return json.loads(rows[0].value)["tables"]


def commit(spark: SparkSession, path: str, version: int, tables: Mapping[str, Mapping[str, str]]) -> None:
    """Create the manifest of ``version``, or raise ``Conflict`` if it exists."""
    text = json.dumps({"version": version, "tables": tables}, sort_keys=True)
    own, final = f"{path}/manifest/_{uuid.uuid4().hex}", f"{path}/manifest/{version:012d}.json"
    draft, fs = _path(spark, own)
    out = fs.create(draft, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    try:
        if fs.getScheme() == "file":  # a rename would replace the file of another writer, a link does not
            files = spark.sparkContext._jvm.java.nio.file.Files
            files.createLink(fs.pathToFile(_path(spark, final)[0]).toPath(), fs.pathToFile(draft).toPath())
        elif not fs.rename(draft, _path(spark, final)[0]):
            raise Conflict(final)
    except Conflict:
        raise
    except Exception as e:
        if fs.exists(_path(spark, final)[0]):
            raise Conflict(final) from e
        raise
    finally:
        fs.delete(draft, False)


def write_folders(df: DataFrame, path: str, by: Sequence[str]) -> dict[str, str]:
    """Write ``df`` into new folders, one per partition of ``by``; partition -> folder.

    The columns of ``by`` are in the names only.
    """
    base = f"{path}/data/{uuid.uuid4().hex}"
    df.write.mode("errorifexists").partitionBy(*by).parquet(base)
    found = _names(df.sparkSession, base + "/*=*" * len(by))
    return {"/".join(n.split("/")[-len(by):]): n for n in found}


def read_folders(spark: SparkSession, folders: Sequence[str], schema: T.StructType) -> DataFrame:
    """Rows of the folders; without any, an empty table of the schema."""
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*sorted(folders))


def update(spark: SparkSession, path: str,
           change: Callable[[dict[str, dict[str, str]]], Mapping[str, Mapping[str, str]]]) -> int:
    """Commit what ``change`` makes of the current manifest; tried anew after a conflict."""
    for _ in range(ATTEMPTS):
        version = current_version(spark, path)
        tables = change(manifest(spark, path, version))
        try:
            commit(spark, path, version + 1, tables)
        except Conflict:
            continue
        return version + 1
    raise Conflict(f"{ATTEMPTS} times: {path}")


def partition_name(columns: Sequence[str]) -> Column:
    """The name ``write_folders`` gives the partition of a row (values without special characters)."""
    return F.concat_ws("/", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"),
                                                                  F.lit("__HIVE_DEFAULT_PARTITION__"))) for c in columns])
