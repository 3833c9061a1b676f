"""Mixtures of sources with target shares of the tokens."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import arrow_stage, pick, term_array
from folioscan.plans.shared import materialise

#: The dynamic programme fits the last tokens of a budget: so many of the longest document, FIT_TOKENS at most.
SPARE, FIT_TOKENS = 16, 1 << 16
#: Bytes of a vocabulary that is broadcast, at most.
MAX_VOCABULARY = 1 << 26
#: Parts of a length's documents by their seeded hash: only in one of them are documents ranked one by one.
HASH_PARTS = 1 << 12


def term_tokens(text: Column) -> Column:
    """Number of runs of letters, marks and digits in ``text``."""
    return F.size(term_array(text)).cast("long")


def tokenizer_lengths(documents: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``(doc_id, source, n_tokens)`` with the byte-level BPE vocabulary of ranks at ``path``.

    The file is read on the driver, its size checked, and shipped to the executors; they need no copy of their own.
    """
    import base64

    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    with open(path, "rb") as f:
        vocabulary = f.read(MAX_VOCABULARY + 1)
    if len(vocabulary) > MAX_VOCABULARY:
        raise ValueError(f"{path} has more than {MAX_VOCABULARY} bytes")
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            n = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "source", "n_tokens"])

    return arrow_stage(pick(documents, doc_id=doc_id, source=source, t=text).withColumn("doc_id", F.col("doc_id").cast("long")), stage, "doc_id long, source string, n_tokens long")


def fit_counts(lengths: dict[int, int], budget: int) -> dict[int, int]:
    """How many documents of each length to take so that their tokens come as near to ``budget`` from below as can be.

    All but the last ``SPARE`` document lengths of the budget is an even share of every length, what rounding leaves going to
    the largest remainders, one document a length. The rest is a bounded knapsack over (length, count), solved as
    subset sums in the bits of an integer, counts split into powers of two.
    """
    lengths = {n: c for n, c in lengths.items() if n > 0 and c > 0}
    total = sum(n * c for n, c in lengths.items())
    if budget >= total:
        return dict(lengths)
    spare = min(FIT_TOKENS, SPARE * max(lengths))
    bulk = max(0, budget - spare)
    taken = {n: c * bulk // total for n, c in lengths.items()}
    left = budget - sum(n * c for n, c in taken.items())
    for n in sorted(lengths, key=lambda n: (-(lengths[n] * bulk % total), n)):
        if taken[n] < lengths[n] and left - n >= spare:
            taken[n] += 1
            left -= n
    mask = (1 << (left + 1)) - 1
    reach, steps = 1, []
    for n in sorted(lengths):
        have, part = min(lengths[n] - taken[n], left // n), 1
        while have > 0:
            k = min(part, have)
            steps.append((n, k, reach))
            reach |= (reach << (n * k)) & mask
            have -= k
            part *= 2
    at = reach.bit_length() - 1
    for n, k, before in reversed(steps):
        if not before >> at & 1:
            at -= n * k
            taken[n] += k
    return {n: c for n, c in taken.items() if c}


def plan_mixture(lengths: DataFrame, targets: DataFrame, source: str = "source", target_share: str = "target_share", max_repeats: str = "max_repeats") -> tuple[DataFrame, DataFrame]:
    """From ``(doc_id, source, n_tokens)`` and targets the report and the numbers of documents to take.

    The mixture is as large as all documents together. The report has one row per target source: ``(source,
    target_share, max_repeats, available_tokens, wanted_tokens, whole_repeats, mixed_tokens, reached_share,
    reachable)``; ``reached_share`` is of the tokens of the mixture, ``reachable`` is false where all repeats together leave the mixture short of the share. A source without documents has 0 tokens; a null share is
    0, null repeats are 1; of a source named twice the larger share holds. The second frame is ``(source, n_tokens,
    take, whole_repeats)``.
    """
    counts = materialise(lengths.groupBy("source", "n_tokens").agg(F.count("*").alias("docs")))
    total = counts.agg(F.sum(F.col("n_tokens") * F.col("docs")).alias("t")).first().t or 0
    wanted = (
        pick(targets, source=source, share=target_share, repeats=max_repeats)
        .where("source is not null")
        .select("source", F.coalesce("share", F.lit(0.0)).alias("share"), F.coalesce("repeats", F.lit(1)).cast("long").alias("repeats"))
        .groupBy("source")
        .agg(F.max_by("repeats", F.struct("share", "repeats")).alias("repeats"), F.max("share").alias("share"))
    )
    have = counts.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("docs")).alias("tokens"))
    plan = wanted.join(have, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0))).withColumn("wanted", F.floor(F.col("share") * F.lit(total)))
    whole = F.when(F.col("tokens") > 0, F.least("repeats", F.floor(F.col("wanted") / F.col("tokens")))).otherwise(0)
    plan = plan.withColumn("whole", whole.cast("long")).withColumn("rest", F.when(F.col("whole") < F.col("repeats"), F.col("wanted") - F.col("whole") * F.col("tokens")).otherwise(0))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        got = fit_counts(dict(zip(pdf.n_tokens.tolist(), pdf.docs.tolist())), int(pdf.rest.iloc[0]))
        return pd.DataFrame({"source": pdf.source, "n_tokens": pdf.n_tokens, "take": [got.get(n, 0) for n in pdf.n_tokens.tolist()], "whole_repeats": pdf.whole})

    takes = materialise(counts.join(plan.select("source", "whole", "rest"), "source").groupBy("source").applyInPandas(fit, "source string, n_tokens long, take long, whole_repeats long"))
    partly = takes.groupBy("source").agg(F.sum(F.col("take") * F.col("n_tokens")).alias("part"))
    mixed = F.col("whole") * F.col("tokens") + F.coalesce("part", F.lit(0))
    told = materialise(plan.join(partly, "source", "left").withColumn("mixed", mixed))
    whole_mixture = told.agg(F.sum("mixed").alias("m")).first().m or 0
    spent = (F.col("whole") >= F.col("repeats")) | (F.col("tokens") == 0)
    report = told.select(
        "source",
        F.col("share").alias("target_share"),
        F.col("repeats").alias("max_repeats"),
        F.col("tokens").alias("available_tokens"),
        F.col("wanted").alias("wanted_tokens"),
        F.col("whole").alias("whole_repeats"),
        F.col("mixed").alias("mixed_tokens"),
        F.round(F.col("mixed") / F.lit(float(max(whole_mixture, 1))), 6).alias("reached_share"),
        (~(spent & (F.col("mixed") < F.col("share") * F.lit(float(total))))).alias("reachable"),
    )
    return report, takes


def select_mixture(lengths: DataFrame, takes: DataFrame, seed: int = 42) -> DataFrame:
    """The mixture as ``(doc_id, source, n_tokens, copies)``: of each source and length the planned number of
    documents, in the order of a hash that ``seed`` gives, gets one copy beyond the whole repeats.

    Documents are counted by part of the hash's range first; whole parts are in or out, and only within the part where the
    number is reached are documents ranked: a source and length of any size is no task of its own.
    """
    from pyspark.sql import Window

    h = F.xxhash64(F.lit(seed), "doc_id")
    parted = lengths.select("doc_id", "source", "n_tokens", h.alias("h"), F.pmod(F.shiftrightunsigned(h, 48), F.lit(HASH_PARTS)).alias("part"))
    counted = parted.groupBy("source", "n_tokens", "part").agg(F.count("*").alias("docs"))
    before = Window.partitionBy("source", "n_tokens").orderBy("part")
    upto = counted.withColumn("before", F.sum("docs").over(before) - F.col("docs")).join(takes, ["source", "n_tokens"])
    part = materialise(upto.select("source", "n_tokens", "part", "whole_repeats", F.least(F.greatest(F.col("take") - F.col("before"), F.lit(0)), "docs").alias("wanted"), "docs"))
    # the parts compress so well that Spark would take their table for small and broadcast it
    placed = parted.join(part.where("wanted > 0 or whole_repeats > 0").hint("merge"), ["source", "n_tokens", "part"])
    split = (F.col("wanted") > 0) & (F.col("wanted") < F.col("docs"))
    names = ["doc_id", "source", "n_tokens"]
    even = placed.where(~split).select(*names, (F.col("whole_repeats") + (F.col("wanted") > 0).cast("long")).alias("copies"))
    order = Window.partitionBy("source", "n_tokens", "part").orderBy("h", "doc_id")
    edge = placed.where(split).withColumn("rank", F.row_number().over(order)).select(*names, (F.col("whole_repeats") + (F.col("rank") <= F.col("wanted")).cast("long")).alias("copies"))
    return even.unionByName(edge).where("copies > 0")
