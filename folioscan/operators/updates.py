"""What writes do to a set of records, as operations on frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def without(docs: DataFrame, keys: DataFrame, field: str) -> DataFrame:
    """The records whose ``field`` is none of ``keys``; null keys delete nothing."""
    return docs.join(keys.select(F.col(field)).where(F.col(field).isNotNull()).distinct(), field, "left_anti").select(docs.columns)


def last_of_each(docs: DataFrame, key: str, *order: str) -> DataFrame:
    """Of records with one ``key`` the last by ``order``: what remains if all are upserted one after another."""
    return docs.groupBy(key).agg(F.max_by(F.struct(*docs.columns), F.struct(*order)).alias("d")).select("d.*")


def upserted(docs: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``docs`` with the records of ``new``, which hold each key once, in place of those with the same key."""
    return without(docs, new, key).unionByName(new)
