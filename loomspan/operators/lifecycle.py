"""The life of a ticket as changes to the table of tickets: acknowledgement, leases, retries, runs, clean-up.

Every change takes the latest row of each ticket and gives the rows after it.
Requests that a ticket's state or owner refuses come back apart; nothing raises
half way.  Times are epoch seconds that the caller states.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators.queue import TERMINAL
from loomspan.runtime import path_exists, replace_text



def _free() -> dict[str, Column]:
    return {"claimed_by": F.lit(None).cast("string"), "claimed_at": F.lit(None).cast("double")}


def _changed(jobs: DataFrame, when: Column, values: dict[str, Column]) -> DataFrame:
    out = {c: F.when(when, v).otherwise(F.col(c)).cast(jobs.schema[c].dataType) for c, v in values.items()}
    return jobs.withColumns(out).select(*jobs.columns)


def complete(jobs: DataFrame, acks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tickets after acknowledgement; id, worker of refused ones).

    ``acks`` has id, worker, at, result; of several for one ticket the first by
    (at, worker) holds.  Only the worker that holds a ticket in processing may
    complete it; unknown tickets are refused too.
    """
    first = acks.where("id IS NOT NULL").groupBy("id").agg(F.min(F.struct("at", "worker", "result")).alias("_ack"))
    met = jobs.join(first, "id", "left")
    ok = F.coalesce((F.col("state") == "processing") & (F.col("claimed_by") == F.col("_ack.worker")), F.lit(False))
    values = {"state": F.lit("completed"), "updated_at": F.col("_ack.at"), "completed_at": F.col("_ack.at"), "last_error": F.lit(None), "result_json": F.col("_ack.result"), **_free()}
    after = met.withColumns({c: F.when(ok, v).otherwise(F.col(c)).cast(jobs.schema[c].dataType) for c, v in values.items()}).select(*jobs.columns)
    accepted = met.where(ok).select("id")
    return after, first.join(accepted, "id", "left_anti").select("id", F.col("_ack.worker").alias("worker"))


def fail(jobs: DataFrame, failures: DataFrame, base: float, most: float, now: float) -> DataFrame:
    """Tickets after failures (id, worker, error, permanent): back off while attempts are left, else fail for good.

    A permanent failure, such as a key that another content holds, isn't tried
    again.  A failure that a worker tells of a ticket it doesn't hold is ignored.
    """
    first = failures.where("id IS NOT NULL").groupBy("id").agg(F.max(F.struct("permanent", "error", "worker")).alias("_f"))
    met = jobs.join(first, "id", "left")
    held = F.coalesce((F.col("state") == "processing") & (F.col("claimed_by") == F.col("_f.worker")), F.lit(False))
    spent = F.coalesce(F.col("_f.permanent"), F.lit(False)) | (F.col("attempts") >= F.col("max_attempts"))
    delay = F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), F.greatest(F.col("attempts") - 1, F.lit(0))))
    values = {"state": F.when(spent, "failed").otherwise("pending"), "available_at": F.when(spent, F.col("available_at")).otherwise(F.lit(now) + delay), "updated_at": F.lit(now), "last_error": F.col("_f.error"), "completed_at": F.when(spent, F.lit(now)), **_free()}
    return met.withColumns({c: F.when(held, v).otherwise(F.col(c)).cast(jobs.schema[c].dataType) for c, v in values.items()}).select(*jobs.columns)


def release(jobs: DataFrame, ids: DataFrame, worker: str, now: float, delay: float = 0.0) -> DataFrame:
    """Tickets that a worker claimed and didn't begin go back to pending without spending an attempt."""
    asked = ids.select("id").distinct().withColumn("_asked", F.lit(True))
    met = jobs.join(asked, "id", "left")
    ok = F.coalesce(F.col("_asked") & (F.col("state") == "processing") & (F.col("claimed_by") == worker), F.lit(False))
    return _changed(met, ok, {"state": F.lit("pending"), "available_at": F.lit(now + delay), "updated_at": F.lit(now), "attempts": F.greatest(F.col("attempts") - 1, F.lit(0)), **_free()}).select(*jobs.columns)


def heartbeat(jobs: DataFrame, worker: str, now: float) -> DataFrame:
    """The leases of one worker renewed."""
    return _changed(jobs, F.coalesce((F.col("state") == "processing") & (F.col("claimed_by") == worker), F.lit(False)), {"claimed_at": F.lit(now)})


def recover(jobs: DataFrame, now: float, stale_after: float) -> DataFrame:
    """Leases that ran out go back to pending; the attempt isn't charged."""
    stale = F.coalesce((F.col("state") == "processing") & (F.col("claimed_at").isNull() | (F.col("claimed_at") <= now - stale_after)), F.lit(False))
    return _changed(jobs, stale, {"state": F.lit("pending"), "available_at": F.lit(now), "updated_at": F.lit(now), "attempts": F.greatest(F.col("attempts") - 1, F.lit(0)), "last_error": F.coalesce("last_error", F.lit("worker_interrupted")), **_free()})


def redeliver(jobs: DataFrame, ids: DataFrame, now: float) -> tuple[DataFrame, DataFrame]:
    """(tickets with the asked terminal ones pending again; ids that aren't in a terminal state)."""
    asked = ids.select(F.trim("id").alias("id")).where("id IS NOT NULL").distinct()
    met = jobs.join(asked.withColumn("_asked", F.lit(True)), "id", "left")
    ok = F.coalesce(F.col("_asked") & F.col("state").isin(*TERMINAL), F.lit(False))
    none = F.lit(None)
    after = _changed(met, ok, {"state": F.lit("pending"), "attempts": F.lit(0), "available_at": F.lit(now), "updated_at": F.lit(now), "completed_at": none, "last_error": none, "result_json": none, **_free()}).select(*jobs.columns)
    return after, asked.join(jobs.where(F.col("state").isin(*TERMINAL)).select("id"), "id", "left_anti")


def run_admission(wanted: DataFrame, jobs: DataFrame) -> DataFrame:
    """run_id, n_tickets, n_conflicts, admitted: a run's tickets are taken all or none.

    ``wanted`` has run_id, idempotency_key, payload_hash.  A key that a stored
    ticket or another ticket of the run holds with another payload is a conflict.
    """
    stored = jobs.where("idempotency_key IS NOT NULL").groupBy("idempotency_key").agg(F.min("payload_hash").alias("_lo"), F.max("payload_hash").alias("_hi"))
    own = wanted.groupBy("run_id", "idempotency_key").agg(F.count(F.lit(1)).alias("n"), F.min("payload_hash").alias("lo"), F.max("payload_hash").alias("hi"))
    met = own.join(stored, "idempotency_key", "left")
    bad = (F.col("lo") != F.col("hi")) | F.coalesce((F.col("_lo") != F.col("lo")) | (F.col("_hi") != F.col("hi")), F.lit(False))
    return met.groupBy("run_id").agg(F.sum("n").alias("n_tickets"), F.sum(bad.cast("long")).alias("n_conflicts")).withColumn("admitted", F.col("n_conflicts") == 0)


def run_cleanup(states: DataFrame, run_jobs: DataFrame, jobs: DataFrame, forgotten: DataFrame) -> DataFrame:
    """The summary that stays of each run: successful, failed and forgotten tickets and the state after clean-up.

    ``states`` is of :func:`queue.run_states`, ``forgotten`` has id.  A run with
    tickets under way is ``active``; an ended one is ``cleaned`` once every
    completed ticket is forgotten or gone, until then ``cleanup_failed``.
    """
    listed = run_jobs.select("run_id", "ordinal", "job_id").distinct().join(jobs.select(F.col("id").alias("job_id"), "state"), "job_id", "left")
    gone = forgotten.select(F.col("id").alias("job_id"), F.lit(1).alias("_gone")).distinct()
    per = listed.join(gone, "job_id", "left").groupBy("run_id").agg(F.sum(F.coalesce((F.col("_gone").isNotNull() & (F.col("state") == "completed")).cast("long"), F.lit(0))).alias("forgotten_count"))
    out = states.join(per, "run_id", "left").na.fill(0, ["forgotten_count"])
    open_ = F.col("n_pending") + F.col("n_processing") > 0
    state = F.when(open_, "active").when(F.col("forgotten_count") >= F.col("n_completed"), "cleaned").otherwise("cleanup_failed")
    return out.select("run_id", "expected_count", F.col("n_completed").alias("successful_count"), F.col("n_failed").alias("failed_count"), "forgotten_count", state.alias("state"))


def lag(jobs: DataFrame, now: float) -> DataFrame:
    """For each unfinished state: tickets, age of the oldest, mean age, and how many are overdue."""
    age = F.lit(now) - F.col("enqueued_at")
    return jobs.where(~F.col("state").isin(*TERMINAL)).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.max(age).alias("oldest_age"), F.avg(age).alias("mean_age"), F.sum((F.col("available_at") <= now).cast("long")).alias("n_overdue"))


def bind(spark: SparkSession, folder: str, identity: str) -> None:
    """Tie a queue's folder to one store: the first identity is kept, another one raises ValueError."""
    path = f"{folder.rstrip('/')}/STORE"
    if not path_exists(spark, path):
        replace_text(spark, path, identity)
    kept = spark.read.text(path).first()[0]
    if kept != identity:
        raise ValueError(f"this queue belongs to the store {kept}")


def public(rows: DataFrame, allowed: list[str]) -> DataFrame:
    """The columns that may be shown, of those that are there, in the order of ``allowed``."""
    return rows.select(*(c for c in allowed if c in rows.columns))


def gated(rows: DataFrame, gate: Column, metrics: list[str]) -> DataFrame:
    """Metrics only where the gate holds: a report that failed its gate has nulls and ``scored`` false."""
    ok = F.coalesce(gate, F.lit(False))
    return rows.withColumn("scored", ok).withColumns({m: F.when(F.col("scored"), F.col(m)) for m in metrics})
