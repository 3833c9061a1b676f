"""How distinctive a term is of a record: smoothed positive pointwise mutual information."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscan.llm.common import MAX_TERM_BYTES, TERM, pick
from folioscan.plans.shared import materialise

SMOOTHING = 0.75


def term_record_counts(df: DataFrame, row_id: str = "row_id", text: str = "text") -> DataFrame:
    """Joint counts ``(row_id, term, tf, n)``, ``n`` the tokens of the record. The texts move once, by id; the counting then needs no further shuffle."""
    words = F.explode(F.regexp_extract_all("t", F.lit(TERM), F.lit(0)))
    return (
        pick(df, row_id=row_id, t=text)
        .where("t is not null")
        .repartition("row_id")
        .select("row_id", words.alias("w"))
        .where(F.octet_length("w") < MAX_TERM_BYTES)
        .groupBy("row_id", F.lower("w").alias("term"))
        .agg(F.count("*").alias("tf"))
        .withColumn("n", F.sum("tf").over(Window.partitionBy("row_id")))
    )


def distinctive_terms(
    df: DataFrame, row_id: str = "row_id", text: str = "text", smoothing: float = SMOOTHING, min_tf: int = 1, max_records: int | None = None
) -> DataFrame:
    """Rows ``(row_id, term, tf, records, ppmi)``: how strongly each term marks its record against all records.

    ``ppmi = max(0, ln(p(term, record) / (p(term) * q(record))))`` with ``q(record)`` in proportion to the record's
    token count to the power ``smoothing``. All marginals are taken over all records; ``min_tf`` and ``max_records``
    (records that hold the term) only choose the rows reported. Rows with an equal id are one record; null and empty
    texts hold no terms; further columns are ignored; an empty table gives no rows.
    """
    joint = materialise(term_record_counts(df, row_id, text))
    whole = joint.groupBy("row_id").agg(F.first("n").alias("n")).agg(F.sum(F.pow("n", F.lit(smoothing))).alias("s")).first().s or 0.0
    terms = joint.groupBy("term").agg(F.sum("tf").alias("c"), F.count("*").alias("records"))
    if max_records is not None:
        terms = terms.where(F.col("records") <= max_records)
    told = joint.where(F.col("tf") >= min_tf) if min_tf > 1 else joint
    pmi = F.log(F.col("tf") * F.lit(float(whole)) / (F.col("c") * F.pow("n", F.lit(smoothing))))
    return told.join(terms, "term").select("row_id", "term", "tf", "records", F.greatest(F.lit(0.0), pmi).alias("ppmi"))
