"""Writes that can be repeated: upserts by key, canonical lines, versions that are never overwritten."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert_ignore(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The stored rows and those new ones (each key once) whose key isn't stored."""
    return stored.unionByName(new.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti"))


def upsert_update(stored: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """For each key the row of the greatest version; the new one wins a tie."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in stored.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(version, "_new"))
    return both.groupBy(*keys).agg(best.alias("_r")).select(*keys, "_r.*").select(*stored.columns)


def json_lines(df: DataFrame) -> DataFrame:
    """One column ``value`` of JSON objects with sorted names and nulls kept."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_json_lines(df: DataFrame, path: str) -> None:
    """Canonical JSON lines below ``path``; raises if it is there already."""
    json_lines(df).write.mode("error").text(path)


def pages(df: DataFrame, key: str, after, limit: int) -> DataFrame:
    """The next page by key: rows after a value, in order."""
    return df.where(F.col(key) > after).orderBy(key).limit(limit)
