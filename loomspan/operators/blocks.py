"""Running sums and places within groups of any size: by blocks, so that no task holds a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.runtime import stage


def blocked(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The rows in ranges of (keys, order), with the number of the range as ``_block``.

    Ranges are cut at sampled bounds, so a group of many rows spans several of
    them and blocks follow one another in the order of the group.  Written out,
    as the sampled bounds must not change afterwards.
    """
    asked = [F.asc(k) for k in keys] + order
    return stage(rows.repartitionByRange(*asked).withColumn("_block", F.spark_partition_id()))


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    return reduce(Column.__and__, (a[n].eqNullSafe(b[n]) for n in names))


def running(rows: DataFrame, keys: list[str], order: list, values: dict[str, Column], totals: dict[str, str] | None = None) -> DataFrame:
    """Adds, for each name of ``values``, the sum of its column over the rows of the group up to and with this one.

    ``totals`` maps names of ``values`` to the column that gets the whole
    group's sum.  Null keys are a group of their own, null values count as 0;
    ties of ``order`` come in any order, so make it unique where that matters.
    """
    given = rows.withColumns({f"_v_{n}": F.coalesce(v, F.lit(0)) for n, v in values.items()})
    parts = blocked(given, keys, order)
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = parts.withColumns({f"_l_{n}": F.sum(f"_v_{n}").over(inside) for n in values})
    # a row for each group and block: a group has at most as many as there are partitions
    per = parts.groupBy(*keys, "_block").agg(*(F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values))
    group = Window.partitionBy(*keys)
    before = group.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = {f"_b_{n}": F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)) for n in values}
    sums |= {f"_t_{n}": F.sum(f"_s_{n}").over(group) for n in totals or {}}
    per = per.withColumns(sums).select(*(F.col(k).alias(f"_k_{i}") for i, k in enumerate(keys)), F.col("_block").alias("_at"), *sums)
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_k_{i}")) for i, k in enumerate(keys)), F.col("_block") == F.col("_at"))
    joined = local.join(per, same)
    out = joined.withColumns({n: F.col(f"_l_{n}") + F.col(f"_b_{n}") for n in values} | {c: F.col(f"_t_{n}") for n, c in (totals or {}).items()})
    return out.select(*rows.columns, *values, *(totals or {}).values())


def numbered(rows: DataFrame, keys: list[str], order: list, name: str, total: str | None = None) -> DataFrame:
    """Adds the place of each row in its group, from 1, and the number of rows of the group."""
    return running(rows, keys, order, {name: F.lit(1).cast("long")}, {name: total} if total else None)
