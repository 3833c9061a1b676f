"""Queries of the training-data operators over the whole tables of a directory."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm import distinctive, frequency, leakage, lookalike, mixing, near, scans, spans, split, subjects
from folioscan.sources.tables import spread, table

TOKENIZER = os.environ.get("FOLIOSCAN_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")


def _inputs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "document_input"), "row_id")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"), "doc_id")


def _repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired_pages(_inputs(spark, d), table(spark, d, "book_list"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.page_marks(_repaired(spark, d))


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    return _repaired(spark, d).select("row_id", "text")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return split.cut_kinds(split.split_oversized(_inputs(spark, d)))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_oversized(_inputs(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.canonical_forms(_inputs(spark, d), whole=False).where("changed").select("row_id", "field").distinct()


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_alike_groups(lookalike.canonical_forms(_inputs(spark, d), whole=False))


def p3_titles(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.matched_titles(_inputs(spark, d), table(spark, d, "book_list"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.distinctive_terms(_inputs(spark, d), min_tf=4, max_records=5).select("row_id", "term")


def p4_scores(spark: SparkSession, d: str) -> DataFrame:
    scored = distinctive.distinctive_terms(_inputs(spark, d))
    return scored.select("row_id", "term", "tf", "records", F.round("ppmi", 6).alias("ppmi"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_pairs(*spans.shared_spans(_inputs(spark, d)))


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    df = _inputs(spark, d)
    return spans.shared_shares(df, *spans.repeated_spans(df))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return frequency.marked_terms(_inputs(spark, d)).where("mark is not null").select("term", "mark")


def p6_terms(spark: SparkSession, d: str) -> DataFrame:
    return frequency.marked_terms(_inputs(spark, d))


def p6_phrases(spark: SparkSession, d: str) -> DataFrame:
    return frequency.term_frequencies(_inputs(spark, d), max_len=3, min_records=2).select(F.array_join("terms", " ").alias("phrase"), "occurrences", "records")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return near.linked_pairs(*near.near_duplicates(_inputs(spark, d)))


def p7_links(spark: SparkSession, d: str) -> DataFrame:
    return near.linked_rows(*near.near_duplicates(_inputs(spark, d)))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    return near.near_groups(_inputs(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(_documents(spark, d), table(spark, d, "eval_item")).select("doc_id", "item_id")


def p8_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return leakage.without_leaks(_documents(spark, d), table(spark, d, "eval_item"), min_coverage=0.8).where("removed_words > 0")


def _regex_lengths(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", "source", mixing.term_tokens(F.col("text")).alias("n_tokens"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.plan_mixture(_regex_lengths(spark, d), table(spark, d, "mix_target"))[0].where("not reachable").select("source")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.plan_mixture(mixing.tokenizer_lengths(_documents(spark, d), TOKENIZER), table(spark, d, "mix_target"))[0]


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    lengths = mixing.materialise(mixing.tokenizer_lengths(_documents(spark, d), TOKENIZER))
    return mixing.select_mixture(lengths, mixing.plan_mixture(lengths, table(spark, d, "mix_target"))[1])


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    model = subjects.fit_subjects(table(spark, d, "subject_example"))
    return subjects.subject_areas(_documents(spark, d), model, table(spark, d, "eval_item")).select("doc_id", "subject").distinct()


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    model = subjects.fit_subjects(table(spark, d, "subject_example"))
    found = subjects.subject_areas(_documents(spark, d), model, table(spark, d, "eval_item"))
    return found.groupBy("subject").agg(F.count("*").alias("documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit()}
