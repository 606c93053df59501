"""References to records that do not exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions.text import BLANK

SALTS = 16


def key_form(key: Column) -> Column:
    """A key without surrounding blanks, in lower case; null if nothing is left."""
    bare = F.lower(F.regexp_replace(key, f"^{BLANK}|{BLANK}$", ""))
    return F.when(bare != "", bare)


def living_keys(parents: DataFrame, key: str, written: Column, forgotten: DataFrame, target: str) -> DataFrame:
    """Distinct keys (column ``ref``) that have a row and no deletion at or after their latest row.

    A key whose rows have no time counts as older than any deletion; deletions
    without a time or of unknown keys change nothing.
    """
    rows = parents.select(key_form(F.col(key)).alias("ref"), written.alias("at"), F.lit(1).alias("row"), F.lit(None).cast("timestamp_ntz").alias("gone"))
    log = forgotten.where(F.lower(F.trim("target_table")) == target).select(key_form(F.col("target_key")).alias("ref"), F.lit(None).cast("timestamp_ntz").alias("at"), F.lit(0).alias("row"), F.col("forgotten_at").cast("timestamp_ntz").alias("gone"))
    # one aggregation of both logs: combined before the shuffle, no join
    state = rows.unionByName(log).where("ref IS NOT NULL").groupBy("ref").agg(F.max("at").alias("at"), F.max("row").alias("row"), F.max("gone").alias("gone"))
    return state.where("row = 1 AND (gone IS NULL OR gone < at)").select("ref")


def orphan_rows(children: DataFrame, living: DataFrame) -> DataFrame:
    """Rows of ``children`` (columns ref, child_key, ...) whose ``ref`` is in no living key.

    Left anti-join of the distinct references, joined back to their rows.  The
    rows of one reference are spread over SALTS groups and the few orphan keys
    repeated for each, so a reference that a third of all rows name splits.
    Null or blank references are no orphans; no children give no rows.
    """
    named = children.where("ref IS NOT NULL")
    orphans = named.select("ref").distinct().join(living, "ref", "left_anti")
    salted = named.withColumn("_salt", F.pmod(F.xxhash64("child_key"), F.lit(SALTS)).cast("int"))
    spread = orphans.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, ["ref", "_salt"], "left_semi").drop("_salt")


def reference_sets(read) -> list[tuple[str, DataFrame, DataFrame]]:
    """(child table, its rows with ref, child_key and period, living parent keys) for the three references.

    ``read`` gives a table by name.  Periods are months; null where unknown.
    """
    forgotten = read("forgotten_keys")
    month = lambda c: F.date_format(c, "yyyy-MM")
    seconds = lambda c: F.expr(f"timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast({c} AS decimal(18, 6)))")
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    events = read("memory_events").select(key_form(F.col("episode_id")).alias("ref"), F.col("ingest_order").cast("string").alias("child_key"), month("created_at").alias("period"))
    runs = read("injection_test_runs").groupBy("run_id").agg(F.min("created_at").alias("run_at"))
    jobs = read("injection_test_run_jobs").join(runs, "run_id", "left").select(key_form(F.col("job_id")).alias("ref"), F.concat_ws("#", part("run_id"), part("ordinal")).alias("child_key"), month(seconds("run_at")).alias("period"))
    sources = read("claim_sources").select(key_form(F.col("statement_id")).alias("ref"), F.concat_ws("#", part("import_id"), part("entry_name"), part("line_number")).alias("child_key"), F.col("dataset_release").alias("period"))
    stamp = F.col("created_at").cast("timestamp_ntz")
    return [
        ("memory_events", events, living_keys(read("episodes"), "id", stamp, forgotten, "episodes")),
        ("injection_test_run_jobs", jobs, living_keys(read("injection_jobs"), "id", seconds("enqueued_at"), forgotten, "injection_jobs")),
        ("claim_sources", sources, living_keys(read("claims"), "statement_id", stamp, forgotten, "claims")),
    ]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dangling_references(read) -> DataFrame:
    """child_table, child_key of every reference without a living parent, each once."""
    return _union([orphan_rows(rows, living).select(F.lit(name).alias("child_table"), "child_key").distinct() for name, rows, living in reference_sets(read)])


def dangling_counts(read) -> DataFrame:
    """References and orphans per child table and period; a repeated row counts once."""
    parts = []
    for name, rows, living in reference_sets(read):
        all_refs = rows.where("ref IS NOT NULL").distinct()
        orphan = orphan_rows(rows, living).distinct().groupBy("period").agg(F.count(F.lit(1)).alias("n_orphans"), F.countDistinct("ref").alias("n_orphan_keys"))
        total = all_refs.groupBy("period").agg(F.count(F.lit(1)).alias("n_references"))
        joined = total.join(orphan, total.period.eqNullSafe(orphan.period), "left").select(F.lit(name).alias("child_table"), total.period, "n_references", F.coalesce("n_orphans", F.lit(0)).alias("n_orphans"), F.coalesce("n_orphan_keys", F.lit(0)).alias("n_orphan_keys"))
        parts.append(joined)
    return _union(parts)
