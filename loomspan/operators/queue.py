"""The durable ingestion queue as tables: latest state, counters, runs, order of claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators import blocks

TERMINAL = ("completed", "failed")


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """The latest row of each ticket: the one of the greatest sequence."""
    last = jobs.groupBy("id").agg(F.max("sequence").alias("sequence"))
    return jobs.join(last.select("sequence"), "sequence", "left_semi")


def conflicting_tickets(jobs: DataFrame) -> DataFrame:
    """Idempotency keys with requests of more than one payload, and how many requests were duplicates."""
    per = jobs.where("idempotency_key IS NOT NULL").groupBy("idempotency_key", "payload_hash").agg(F.count(F.lit(1)).alias("n"))
    out = per.groupBy("idempotency_key").agg(F.sum("n").alias("n_requests"), F.count(F.lit(1)).alias("n_payloads"))
    return out.withColumn("n_deduplicated", F.col("n_requests") - F.col("n_payloads")).withColumn("conflict", F.col("n_payloads") > 1)


def counters(jobs: DataFrame, as_of: float) -> DataFrame:
    """One row: tickets by state, the oldest unfinished, ready ones, attempts, and the latest error."""
    state = lambda s: F.sum((F.col("state") == s).cast("long")).alias(s)
    ready = F.sum(((F.col("state") == "pending") & (F.col("available_at") <= as_of)).cast("long")).alias("ready")
    oldest = F.min(F.when(~F.col("state").isin(*TERMINAL), F.col("enqueued_at"))).alias("oldest_unfinished")
    error = F.max_by("last_error", F.when(F.col("last_error").isNotNull(), F.struct("updated_at", "sequence"))).alias("latest_error")
    return jobs.agg(*map(state, ("pending", "processing", "completed", "failed")), ready, oldest, F.sum("attempts").alias("attempts"), error)


def claim_order(jobs: DataFrame, as_of: float, limit: int) -> DataFrame:
    """Pending tickets that may be claimed now: in order, up to the first that isn't available yet."""
    # the head of the queue: one number, then a top-k; no window over the whole queue
    pending = jobs.where("state = 'pending'")
    stop = pending.where(F.col("available_at") > as_of).agg(F.min("sequence")).first()[0]
    return (pending if stop is None else pending.where(F.col("sequence") < stop)).orderBy("sequence").limit(limit)


def run_states(runs: DataFrame, run_jobs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Tickets of each run by state; a ticket that is gone counts as purged, a repeated row once."""
    listed = run_jobs.select("run_id", "ordinal", "job_id").distinct()
    state = listed.join(jobs.select(F.col("id").alias("job_id"), "state"), "job_id", "left").withColumn("state", F.coalesce("state", F.lit("purged")))
    count = lambda s: F.sum((F.col("state") == s).cast("long")).alias(f"n_{s}")
    per = state.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_jobs"), *map(count, ("pending", "processing", "completed", "failed", "purged")))
    return runs.join(per, "run_id", "left").select("run_id", F.col("state").alias("run_state"), "expected_count", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_jobs", "n_pending", "n_processing", "n_completed", "n_failed", "n_purged")))


def complete_runs(states: DataFrame) -> DataFrame:
    """Runs whose every expected ticket is there and ended."""
    return states.where("n_jobs = expected_count AND n_completed + n_failed = expected_count")


def lookup_in_order(ids: list[str], jobs: DataFrame) -> DataFrame:
    """Rows of the given ids (250 at most), each once, in the order of their first mention; position tells it."""
    if len(ids) > 250:
        raise ValueError("at most 250 ids")
    wanted = list(dict.fromkeys(ids))
    asked = jobs.sparkSession.createDataFrame(list(enumerate(wanted)), "position long, id string")
    return jobs.drop("position").join(F.broadcast(asked), "id").orderBy("position")


def purge(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Tickets without the given ones; raises unless every given ticket is there and completed."""
    wrong = ids.select("id").distinct().join(jobs.where("state = 'completed'").select("id"), "id", "left_anti")
    if wrong.take(1):
        raise ValueError("only completed tickets can be purged")
    return jobs.join(ids.select("id").distinct(), "id", "left_anti")


def backoff(jobs: DataFrame, base: float, most: float, now: float) -> DataFrame:
    """After a failure: attempts left go back to pending later (base * 2^attempts, capped), others fail."""
    delay = F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), F.col("attempts")))
    spent = F.col("attempts") + 1 >= F.col("max_attempts")
    return jobs.withColumns({"state": F.when(spent, "failed").otherwise("pending"), "available_at": F.when(spent, F.col("available_at")).otherwise(F.lit(now) + delay), "attempts": F.col("attempts") + 1})


def recent_runs(runs: DataFrame, limit: int) -> DataFrame:
    """The newest runs, 250 at most."""
    return runs.orderBy(F.desc("created_at"), "run_id").limit(min(limit, 250))


def latencies(jobs: DataFrame) -> DataFrame:
    """Seconds from claim to completion by four definitions of a percentile, for each state.

    linear interpolates, ceiling takes the value at ceil(p n), nearest at
    round(p (n-1)) with halves to even, floor at floor(p (n-1)).  All are read
    off the running counts of distinct values, which are summed by blocks.
    """
    seconds = jobs.where("completed_at IS NOT NULL AND claimed_at IS NOT NULL").select("state", (F.col("completed_at") - F.col("claimed_at")).alias("s"))
    counts = seconds.groupBy("state", "s").agg(F.count(F.lit(1)).alias("c"))
    ranked = blocks.running(counts, ["state"], [F.col("s")], {"upto": F.col("c")}, {"upto": "n"})
    at = lambda place: F.min(F.when(F.col("upto") >= place, F.col("s")))
    p, last = F.lit(0.95), F.col("n") - 1
    out = ranked.groupBy("state").agg(
        F.max("n").alias("n"), at(F.floor(p * last) + 1).alias("floor"), at(F.least(F.col("n"), F.floor(p * last) + 2)).alias("above"),
        at(F.greatest(F.lit(1), F.ceil(p * F.col("n")))).alias("ceiling"), at(F.bround(p * last) + 1).alias("nearest"),
    )
    share = p * (F.col("n") - 1) - F.floor(p * (F.col("n") - 1))
    return out.select("state", "n", ((1 - share) * F.col("floor") + share * F.col("above")).alias("linear"), "ceiling", "nearest", "floor")
