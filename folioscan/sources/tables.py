"""Reading the Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One table of ``directory`` as it is stored; Spark prunes its columns and pushes filters down."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def spread(scan: DataFrame, key: str) -> DataFrame:
    """A scan, or if ``spark.folioscan.scan.partitions`` is set its rows spread over so many partitions by ``key``.

    Files of one row group can't be split by the scan itself; whoever knows theirs to be such asks for it.
    """
    parts = scan.sparkSession.conf.get("spark.folioscan.scan.partitions", None)
    return scan.repartition(int(parts), key) if parts else scan
