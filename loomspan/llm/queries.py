"""Queries of the text problems over the tables of a data folder."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from loomspan.llm import lookalikes, mixing, overlap, packing, tokens, truncation
from loomspan.runtime import stage, table


def p2_found(spark, d):
    return overlap.overlap_pairs(*overlap.overlap_classes(overlap.split_rows(partial(table, spark, d))))


def p2_links(spark, d):
    return overlap.overlap_counts(*overlap.overlap_classes(overlap.split_rows(partial(table, spark, d))))


def p2_report(spark, d):
    rows = overlap.split_rows(partial(table, spark, d))
    counts = overlap.overlap_counts(*overlap.overlap_classes(rows))
    named = counts.join(rows.where("eval").select("row_id", "jsonl_path", "source"), "row_id")
    return named.groupBy(F.col("jsonl_path").alias("path"), "source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum((F.col("n_links") > 0).cast("long")).alias("n_overlapping"), F.sum("n_links").alias("n_pairs"))


def _forms(spark, d, with_text):
    values = lookalikes.memory_values(partial(table, spark, d))
    return lookalikes.consistent_forms(values, lookalikes.representatives(values.select("text")), with_text)


def p5_found(spark, d):
    return lookalikes.same_look_pairs(stage(_forms(spark, d, False).select("src_table", "src_field", "key", "form", "value")))


def p5_classes(spark, d):
    return lookalikes.look_classes(stage(_forms(spark, d, False).select("src_table", "src_field", "key", "form", "value")))


def p5_forms(spark, d):
    return _forms(spark, d, True).where("changed").select("src_table", "src_field", "key", F.col("form_text").alias("form"))


def p5_counts(spark, d):
    return _forms(spark, d, False).groupBy("src_table", "src_field").agg(F.count(F.lit(1)).alias("n_values"), F.sum(F.col("changed").cast("long")).alias("n_changed"))


def _sizes(spark, d):
    return stage(tokens.token_sizes(table(spark, d, "documents")))


def p6_packing(spark, d):
    return packing.containers(_sizes(spark, d), table(spark, d, "pack_capacities"))


def p6_fill(spark, d):
    specs = table(spark, d, "pack_capacities")
    return packing.fill(packing.containers(_sizes(spark, d), specs), specs)


def p7_draw(spark, d):
    return mixing.draw(_sizes(spark, d), table(spark, d, "mixture_targets"))[0]


def p7_shares(spark, d):
    return mixing.shares(*mixing.draw(_sizes(spark, d), table(spark, d, "mixture_targets")))


def p8_found(spark, d):
    return truncation.cut_texts(table(spark, d, "documents")).where("cut").select("doc_id")


def p8_rates(spark, d):
    return truncation.cut_rates(truncation.cut_texts(table(spark, d, "documents")))


QUERIES = {f.__name__: f for f in (p2_found, p2_links, p2_report, p5_found, p5_classes, p5_forms, p5_counts, p6_packing, p6_fill, p7_draw, p7_shares, p8_found, p8_rates)}
ORACLES: dict[str, str] = {}
