"""Tables derived from the records: postings, vocabulary, lengths."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.functions.analysis import LONGEST, raw_tokens, strip_marks

#: Places that the postings of one term are spread over.
SPREAD = 16


@dataclass(frozen=True)
class Index:
    """``docs`` (row_id and the stored fields), ``postings`` (term, row_id, positions), ``vocabulary`` (term, df),
    ``lengths`` (row_id, dl)."""

    docs: DataFrame
    postings: DataFrame
    vocabulary: DataFrame
    lengths: DataFrame

    @property
    def spark(self):
        return self.docs.sparkSession

    def kept(self, write: Callable[[DataFrame], DataFrame]) -> Index:
        """The same index with its tables written by ``write``, the postings in order of terms."""
        docs = write(self.docs)
        postings = write(ordered(build_index(docs).postings))
        return Index(docs, postings, write(in_order(vocabulary_of(postings))), write(lengths_of(docs, postings)))


def ordered(postings: DataFrame) -> DataFrame:
    """Postings placed for reading by term: each file is in order of terms, so a query for some terms reads only the row
    groups that hold them. The rows of one term, however many, go to ``SPREAD`` places."""
    return postings.repartition("term", F.pmod("row_id", F.lit(SPREAD))).sortWithinPartitions("term", "row_id")


def vocabulary_of(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def in_order(vocabulary: DataFrame) -> DataFrame:
    """A vocabulary whose files and row groups hold ranges of terms."""
    return vocabulary.repartitionByRange("term").sortWithinPartitions("term")


def lengths_of(docs: DataFrame, postings: DataFrame) -> DataFrame:
    """``(row_id, dl)`` for every record, 0 without tokens; counted from the positions, so no text is read again."""
    counted = postings.groupBy("row_id").agg(F.sum(F.size("positions")).alias("dl"))
    return docs.select("row_id").join(counted, "row_id", "left").select("row_id", F.coalesce("dl", F.lit(0)).cast("long").alias("dl"))


def build_index(docs: DataFrame, unmarked: bool = False) -> Index:
    """The index of ``docs``. Over-long tokens keep their position empty. ``unmarked`` strips marks from the texts first.

    The records move once, by ``row_id``; collecting the positions then needs no shuffle, and each list is bounded
    by one text.
    """
    text = strip_marks(F.col("text")) if unmarked else F.col("text")
    placed = docs.select("row_id", "text").repartition("row_id").select("row_id", F.posexplode(raw_tokens(text)).alias("pos", "raw")).where(F.octet_length("raw") < LONGEST)
    postings = placed.groupBy("row_id", F.lower("raw").alias("term")).agg(F.sort_array(F.collect_list("pos")).alias("positions")).select("term", "row_id", "positions")
    return Index(docs, postings, vocabulary_of(postings), lengths_of(docs, postings))
