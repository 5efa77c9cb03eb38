"""Written intermediate tables: they end lineage and live in the cluster's shared folder (where all of Spark is one process, and only there, in a temporary one if none is named)."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_HEAD = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*"


def shared_folder(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.conf.get("spark.master", "").split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plain_path(path: Column) -> Column:
    """A file's whole path without scheme and host, as told_path gives it."""
    return F.regexp_replace(path, _HEAD, "/")


def told_path(path: str) -> str:
    """plain_path of a path that a caller names; a relative one is made whole."""
    return re.sub(_HEAD, "/", path) if re.match(_HEAD, path) else os.path.abspath(path)
