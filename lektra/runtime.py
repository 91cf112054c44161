"""Session-level helpers: table access, the shared folder, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_ROOTS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A path for a new folder below ``spark.checkpoint.dir``.

    The setting is the cluster's. Where it is unset a temporary folder takes its place in
    local mode (tests, a laptop); on a cluster executors would not share it, so that fails.
    What an application wrote goes when it ends.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lektra-")
        spark.conf.set("spark.checkpoint.dir", base)
    key = f"{sc.applicationId} {base}"
    if key not in _ROOTS:
        _ROOTS[key] = f"{base.rstrip('/')}/lektra-{uuid.uuid4().hex}"
        path = sc._jvm.org.apache.hadoop.fs.Path(_ROOTS[key])
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return f"{_ROOTS[key]}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back: ends its lineage."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def task_count(spark: SparkSession) -> int:
    """How many reducers the session is set up for."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 1)


def local_path(uri: str) -> str:
    return uri[len("file://"):] if uri.startswith("file://") else uri
