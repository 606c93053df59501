"""Selections that depend on order: quotas, even samples, interleaving, chunks, inversions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators import blocks


def stratified(rows: DataFrame, stratum: str, order: str, limit: int, strata: list[str]) -> DataFrame:
    """The first rows of each stratum by quota: limit divided evenly, the remainder to the first strata."""
    share, rest = divmod(limit, len(strata))
    quota = F.lit(0)
    for i, name in enumerate(strata):
        quota = F.when(F.col(stratum) == name, share + (i < rest)).otherwise(quota)
    rn = F.row_number().over(Window.partitionBy(stratum).orderBy(order))
    return rows.withColumn("_rn", rn).where(F.col("_rn") <= quota).drop("_rn")


def even_sample(rows: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """n rows of each group at evenly spaced places, halves rounded to even; all rows of a group of at most n."""
    placed = blocks.numbered(rows, group, order, "_rn", "_n").withColumn("_rn", F.col("_rn") - 1)
    step = (F.col("_n") - 1) / F.lit(max(1, n - 1))
    wanted = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * step).cast("long")))
    return placed.where((F.col("_n") <= n) | F.array_contains(wanted, F.col("_rn"))).drop("_rn", "_n")


def round_robin(rows: DataFrame, kind: str, order: list, limit: int) -> DataFrame:
    """Rows of the kinds by turns, kinds in order of name, until the limit; turn tells the round."""
    turn = F.row_number().over(Window.partitionBy(kind).orderBy(*order))
    return rows.withColumn("turn", turn).where(F.col("turn") <= limit).orderBy("turn", kind).limit(limit)


def chunked(rows: DataFrame, group: list[str], order: list, size: int) -> DataFrame:
    """Adds ``chunk``: the place of a row in its group divided by the size."""
    return blocks.numbered(rows, group, order, "_rn").withColumn("chunk", F.floor((F.col("_rn") - 1) / size)).drop("_rn")


def weighted_inversions(values: np.ndarray, weights: np.ndarray) -> int:
    """Sum of the products of weights of all pairs that stand in the wrong order of values, by merge sort."""

    def count(v, w):
        if len(v) < 2:
            return v, w, 0
        left, left_w, a = count(v[: len(v) // 2], w[: len(v) // 2])
        right, right_w, b = count(v[len(v) // 2 :], w[len(v) // 2 :])
        upto = np.concatenate(([0], np.cumsum(left_w)))
        across = int(((upto[-1] - upto[np.searchsorted(left, right, side="right")]) * right_w).sum())
        both, both_w = np.concatenate((left, right)), np.concatenate((left_w, right_w))
        order = np.argsort(both, kind="stable")
        return both[order], both_w[order], a + b + across

    return count(values, weights)[2]


def inversions(rows: DataFrame, group: list[str], order: Column, value: Column) -> DataFrame:
    """Rows of each group, and pairs of them that stand in the wrong order of values.

    Null values are left out; equal values or equal places are in order.  A
    group of any size is cut twice: pairs within a range of places are counted
    there; pairs across ranges of places within a range of values, from counts
    of each value and range of places; all others from counts of both ranges.
    """
    names = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in group)

    def counted(df: DataFrame, by: list[str], sort: list[str], v: str) -> DataFrame:
        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(sort, kind="stable")
            head = pdf[group].head(1).reset_index(drop=True)
            return head.assign(n_rows=0, n_inversions=weighted_inversions(pdf[v].to_numpy(), pdf["n"].to_numpy()))

        return df.groupBy(*by).applyInPandas(one, f"{names}, n_rows long, n_inversions long")

    placed = blocks.blocked(rows.select(*group, order.alias("_o"), value.alias("_v")).where("_v IS NOT NULL"), group, [F.col("_o")]).withColumn("n", F.lit(1).cast("long"))
    near = counted(placed, [*group, "_block"], ["_o", "_v"], "_v")
    per = blocks.blocked(placed.groupBy(*group, "_v", "_block").agg(F.sum("n").alias("n")).withColumnRenamed("_block", "_place"), group, [F.col("_v")])
    same = counted(per, [*group, "_block"], ["_place", "_v"], "_v")
    far = counted(per.groupBy(*group, "_block", "_place").agg(F.sum("n").alias("n")), group, ["_place", "_block"], "_block")
    sizes = placed.groupBy(*group).agg(F.sum("n").alias("n_rows"), F.lit(0).cast("long").alias("n_inversions"))
    return near.unionByName(same).unionByName(far).unionByName(sizes).groupBy(*group).agg(F.sum("n_rows").alias("n_rows"), F.sum("n_inversions").alias("n_inversions"))
