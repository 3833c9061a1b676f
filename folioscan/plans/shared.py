"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[object, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Where neither is set, local sessions (tests) use a temporary folder and others one under the warehouse, which all
    executors share.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if found:
        return found.rstrip("/")
    own = spark.conf.get("spark.folioscan.shared.dir", None)
    if not own:
        local = context.master.startswith("local") and not context.master.startswith("local-cluster")
        own = "file://" + tempfile.mkdtemp(prefix="folioscan-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        spark.conf.set("spark.folioscan.shared.dir", own)
    return own


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001  the session may be gone; the cluster's own cleaning takes over
        pass


def _remove_all() -> None:
    for spark, path in _written:
        _remove(spark, path)


atexit.register(_remove_all)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it back.

    Cuts the lineage and survives the loss of executors: the copy is on shared storage, not in executor memory.
    The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folioscan/{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(schema).parquet(path)
