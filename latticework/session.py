"""What a session needs before Python code of this package runs on executors, and the storage that the
driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def share_package(spark: SparkSession) -> None:
    """Have Python workers look for the package where the driver found it, whatever folder they start
    in. Where executors have it installed or shipped, this changes nothing."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as a URI: the cluster names it in
    ``spark.checkpoint.dir``, and Hadoop's default file system completes a name without a scheme. Where it is
    unset, one machine makes a temporary folder and a cluster raises."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and executors share")
        root = spark.conf.get("latticework.local.shared", None)
        if not root:
            root = "file://" + tempfile.mkdtemp(prefix="latticework-")
            spark.conf.set("latticework.local.shared", root)
    path = sc._jvm.org.apache.hadoop.fs.Path(root)
    return str(path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()).rstrip("/")


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Have the driver's file system delete ``path`` when it closes."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_root(spark)}/latticework/{name}-{uuid.uuid4().hex}"


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends
    here, and a lost executor costs no more than the stage that reads the table. The table goes
    when the driver ends."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    delete_on_exit(spark, path)
    return spark.read.schema(schema).parquet(path)
