"""Queries of fact timelines, the queue, the hub and ordered selections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspan.functions import civil, mathx, units
from loomspan.operators import hub, intervals, queue, ranking, scoring, timeline
from loomspan.runtime import stage, table

NOW = 1767225600.0


def _facts(spark, d):
    """Facts of claims: each statement once, at the first day its start means."""
    claims = table(spark, d, "claims").groupBy("statement_id").agg(F.min(F.struct("created_at", "subject_value", "predicate_iri", "object_value", "temporal_start")).alias("c")).select("statement_id", "c.*")
    start = F.trim("temporal_start")
    precision = F.when(start.rlike(r"^\d{4}$"), 9).when(start.rlike(r"^\d{4}-\d{2}$"), 10).otherwise(11)
    return claims.select(F.col("subject_value").alias("entity"), F.col("predicate_iri").alias("predicate"), precision.alias("precision"), intervals.day_number(F.col("temporal_start"), end=False).alias("position"), F.col("object_value").alias("object"), F.col("statement_id").alias("fact_id")).where("position IS NOT NULL")


def _measures(spark, d):
    """Facts of the event stream: a user's value of an event type on a day."""
    day = F.unix_date(F.to_date("ts"))
    return table(spark, d, "events").select(F.col("user_id").alias("entity"), F.col("event_type").alias("predicate"), F.lit(11).alias("precision"), day.alias("position"), F.col("value").alias("object"), F.col("event_id").alias("fact_id"))


def a24_contradictions(spark, d):
    return timeline.contradictions(_facts(spark, d))


def w3_previous_fact(spark, d):
    return timeline.with_previous(_facts(spark, d)).select("fact_id", F.col("previous.fact_id").alias("previous_id"))


def w4_latest_state(spark, d):
    return timeline.latest_state(_facts(spark, d)).select("entity", "predicate", "fact_id", "object")


def f17_changes(spark, d):
    out = timeline.changes(_measures(spark, d))
    return out.select("entity", "predicate", "fact_id", "previous_id", "kind", F.round("value", 6).alias("value"))


def f17_durations(spark, d):
    """Spans whose bounds have one precision, each on the axis of that precision."""
    claims = table(spark, d, "claims").select("statement_id", F.trim("temporal_start").alias("s"), F.trim("temporal_end").alias("e"))

    def bound(c):
        # a time of day or Z behind a day leaves it a day; days count on the axis of civil.day_number
        day = intervals.day_number(F.col(c), end=False)
        year, month = F.substring(c, 1, 4).cast("long"), F.substring(c, 6, 2).cast("long")
        precision = F.when(F.col(c).rlike(r"^\d{4}$"), 9).when(day.isNull(), None).when(F.col(c).rlike(r"^\d{4}-\d{2}$"), 10).otherwise(11)
        return precision, F.when(precision == 9, year).when(precision == 10, year * 12 + month - 1).otherwise(day + 306)

    (p, a), (q, b) = bound("s"), bound("e")
    spans = claims.select("statement_id", p.alias("precision"), q.alias("other"), a.alias("a"), b.alias("b")).where("precision = other").distinct()
    return timeline.durations(spans, F.col("a"), F.col("b"), F.col("precision")).select("statement_id", "kind", "value", "exact")


def j13_two_hops(spark, d):
    """Customer to order to part, as facts of one table."""
    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    orders = table(spark, d, "orders").select(text("c", "o_custkey").alias("entity"), text("o", "o_orderkey").alias("object"), text("order-", "o_orderkey").alias("fact_id"))
    lines = table(spark, d, "lineitem").select(text("o", "l_orderkey").alias("entity"), text("p", "l_partkey").alias("object"), F.concat_ws("-", F.lit("line"), "l_orderkey", "l_linenumber").alias("fact_id"))
    return timeline.two_hops(orders.unionByName(lines)).select("first_id", "second_id")


def u4_reference_cycles(spark, d):
    """Nodes on cycles of any length in a graph of numbered nodes."""
    return timeline.on_cycles(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")))


def f14_day_numbers(spark, d):
    dates = table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("ship_day")).distinct()
    y, m, dd = F.year("ship_day"), F.month("ship_day"), F.dayofmonth("ship_day")
    return dates.select("ship_day", civil.day_number(y, m, dd).alias("day_number"), civil.is_leap(y).alias("leap"), civil.month_length(y, m).alias("month_days"), civil.label(y - 4000).alias("label"))


def f20_calendar_ages(spark, d):
    claims = table(spark, d, "claims").select("statement_id", F.trim("temporal_start").alias("born"), F.trim("temporal_end").alias("at")).distinct()
    return claims.select("statement_id", civil.calendar_age(F.col("born"), F.col("at")).alias("age")).where("age IS NOT NULL")


def f16_units(spark, d):
    unit = F.when(F.col("event_type") == "click", "km").when(F.col("event_type") == "view", "Celsius").when(F.col("event_type") == "purchase", "mg").otherwise("parsec")
    rows = table(spark, d, "events").select("event_id", units.canonical(F.col("value"), unit).alias("m"))
    return rows.select("event_id", "m.dimension", "m.unit", F.round("m.value", 12).alias("value"), "m.exact")


def f18_distances(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 180 - 90).cast("double").alias("a"), (F.col("c_nationkey") * 14.0 - 180).alias("b"), (F.col("c_custkey") % 120 - 60).cast("double").alias("c"))
    return rows.select("c_custkey", F.round(units.haversine_km(F.col("a"), F.col("b"), F.col("c"), F.lit(10.0)), 3).alias("km"))


def f37_scalar_math(spark, d):
    r = table(spark, d, "lineitem")
    q, x = F.col("l_quantity"), F.col("l_extendedprice")
    k = F.col("l_partkey")
    cols = {
        "floor_quotient": mathx.floor_div(-x, q), "floor_remainder": F.round(mathx.floor_mod(-x, q), 4), "whole": mathx.truncated(-x / q), "root": F.round(mathx.safe_sqrt(x), 6), "log_base": F.round(mathx.safe_log(x, q), 6),
        "divisor": mathx.fold_gcd(k, F.col("l_suppkey") * 6), "choices": mathx.falling(F.col("l_linenumber") + 5, F.col("l_linenumber")), "half_even": F.bround(q / 2), "angle": F.round(F.atan2(x, q), 6), "safe": mathx.json_safe(k.cast("decimal(20,0)") * F.lit(10_000_000_000_000).cast("decimal(14,0)")),
    }
    return r.select("l_orderkey", "l_linenumber", *(c.alias(n) for n, c in cols.items()))


def a27_statistics(spark, d):
    x = F.col("l_extendedprice")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.sum(x), 2).alias("total"), F.min(x).alias("least"), F.max(x).alias("most"), F.round(F.avg(x), 6).alias("mean"), F.round(F.median(x), 6).alias("median"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY l_extendedprice)").alias("median_low"),
        F.round(F.var_pop(x), 2).alias("pvariance"), F.round(F.stddev_pop(x), 4).alias("pstdev"), F.round(F.var_samp(x), 2).alias("variance"), F.round(F.stddev_samp(x), 4).alias("stdev"),
    )


def f38_expressions(spark, d):
    """The expression workload, one for each order; compared with SQL for the families that SQL has."""
    i = F.col("o_orderkey")
    rows = table(spark, d, "orders").select("o_orderkey", mathx.workload(i).alias("expression"))
    return rows.select("o_orderkey", "expression", mathx.evaluate("expression").alias("r")).select("o_orderkey", "expression", "r.kind", F.round("r.approximation", 6).alias("approximation"), "r.error")


def d2_ticket_conflicts(spark, d):
    return queue.conflicting_tickets(table(spark, d, "injection_jobs"))


def k3_latest_jobs(spark, d):
    return queue.latest_jobs(table(spark, d, "injection_jobs")).select("sequence", "id", "state", "attempts")


def a8_queue_counters(spark, d):
    return queue.counters(queue.latest_jobs(table(spark, d, "injection_jobs")), NOW).withColumn("oldest_unfinished", F.round("oldest_unfinished", 3))


def w16_claim_order(spark, d):
    """Tickets in order from the head of the queue at a time when all that wait are due, and at one when some aren't yet."""
    jobs = stage(queue.latest_jobs(table(spark, d, "injection_jobs")))
    parts = [queue.claim_order(jobs, at, 25).select(F.lit(at).alias("as_of"), "sequence", "id") for at in (NOW, 1735689600.0)]
    return parts[0].unionByName(parts[1])


def d1_lookup(spark, d):
    jobs = queue.latest_jobs(table(spark, d, "injection_jobs"))
    ids = [r[0] for r in jobs.orderBy(F.desc("sequence")).select("id").limit(40).collect()]
    return queue.lookup_in_order([*ids, ids[0], "unknown"] if ids else [], jobs).select("position", "id", "state")


def u6_purged(spark, d):
    jobs = stage(queue.latest_jobs(table(spark, d, "injection_jobs")))
    return queue.purge(jobs, jobs.where("state = 'completed' AND sequence % 2 = 0").select("id")).select("id", "state")


def j16_corrected(spark, d):
    """Facts after corrections: every fact with an even last digit of its hash retracts the one before it."""
    facts = stage(_facts(spark, d))
    told = timeline.with_previous(facts).where("previous IS NOT NULL").select("fact_id", F.col("previous.fact_id").alias("target_id"), F.lit("retracts").alias("kind"))
    edges = told.where(F.substring(F.sha2("fact_id", 256), 64, 1).isin("0", "2", "4", "6", "8"))
    return timeline.effective(facts, edges).select("fact_id", "entity", "predicate")


def u4_correction_problems(spark, d):
    """Problems of corrections among parts: each corrects its number's remainder by 97, which may be itself, unknown or on a cycle."""
    parts = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("fact_id"), F.col("p_partkey").alias("n"))
    facts = parts.where("n % 10 <> 3").select(F.lit("e").alias("entity"), F.when(F.col("n") % 4 == 0, "p").otherwise("q").alias("predicate"), F.lit(11).alias("precision"), F.col("n").alias("position"), F.lit("o").alias("object"), "fact_id")
    edges = parts.where("n % 10 <> 3 AND n < 200").select("fact_id", ((F.col("n") * 7) % 97).cast("string").alias("target_id"), F.lit("supersedes").alias("kind"))
    return timeline.correction_problems(facts, edges)


def j20_retrieval(spark, d):
    """Documents returned for their own source by size, against the largest three of each source."""
    docs = table(spark, d, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").cast("string").alias("episode"), "n_chars", "doc_id")
    by = lambda *order: F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    returned = docs.withColumn("rank", by(F.desc("n_chars"), "doc_id")).where("rank <= 10").select("query_id", "episode", "rank")
    expected = docs.withColumn("r", by(F.desc("doc_id"))).where("r <= 3").select("query_id", "episode").unionByName(returned.where("rank = 2").select("query_id", "episode")).distinct()
    return scoring.retrieval(returned, expected)


def j9_run_states(spark, d):
    return queue.run_states(table(spark, d, "injection_test_runs"), table(spark, d, "injection_test_run_jobs"), queue.latest_jobs(table(spark, d, "injection_jobs")))


def j8_complete_runs(spark, d):
    return queue.complete_runs(j9_run_states(spark, d))


def o10_recent_runs(spark, d):
    return queue.recent_runs(table(spark, d, "injection_test_runs"), 250).select("run_id", "state")


def a21_latencies(spark, d):
    out = queue.latencies(table(spark, d, "injection_jobs"))
    return out.select("state", "n", *(F.round(c, 4).alias(c) for c in ("linear", "ceiling", "nearest", "floor")))


POLICIES = [("json_import", "shared", None, ["ana"], []), ("chat_memory", "private", "ana", [], []), ("rdf_import", "reference", None, [], []), ("math_notes", "private", "bob", [], []), ("queue_log", "shared", None, ["*"], ["bob"]), ("hub_capsule", "reference", None, ["bob"], [])]


def _policies(spark):
    return spark.createDataFrame(POLICIES, "space string, kind string, owner string, readers array<string>, writers array<string>")


def proj10_readable(spark, d):
    docs = table(spark, d, "documents").withColumnRenamed("source", "space")
    return hub.readable(docs, _policies(spark), "ana").groupBy("space").agg(F.count(F.lit(1)).alias("n_documents"))


def proj20_policy_problems(spark, d):
    spaces = table(spark, d, "documents").select(F.col("source").alias("space")).distinct()
    return hub.policy_problems(_policies(spark), spaces)


def d3_merged_spaces(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("space"), (F.col("doc_id") % 10).alias("rank"), F.col("n_chars").cast("double").alias("score"), F.sha2("text", 256).alias("fingerprint"))
    return hub.merged_spaces(docs).select("fingerprint", "space", "rank", "score", F.array_join("origins", ",").alias("origins"))


def d4_best_evidence(spark, d):
    status = F.when(F.col("confidence_level") == "statement-attributed", 2).otherwise(1)
    items = table(spark, d, "claims").select(F.col("subject_value").alias("key"), F.concat_ws(" ", "predicate_label", "object_label").alias("text"), status.alias("status_rank"), F.lit(0.5).alias("confidence"), F.lit(1).alias("space_rank"), F.unix_micros(F.col("created_at").cast("timestamp")).alias("position"), F.array("predicate_label", "epistemic_status").alias("tags"))
    return hub.best_evidence(items).select("key", "text", "status_rank", "position", F.array_join("tags", "|").alias("tags"), "n_merged")


def w9_budget(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return hub.within_budget(docs, ["source"], ["doc_id"], "n_chars", 20_000)


def w10_prefix_budget(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return hub.until_budget(docs, ["source"], ["doc_id"], F.col("n_chars"), 20_000)


def w11_stratified(spark, d):
    ex = table(spark, d, "training_examples")
    tasks = ["direct_recall_with_citations", "multi_hop_relation", "unsupported_abstention", "temporal_age", "role_disambiguation"]
    return ranking.stratified(ex, "task", "row_id", 98, tasks).select("row_id", "task")


def w12_even_sample(spark, d):
    return ranking.even_sample(table(spark, d, "documents"), ["source"], ["doc_id"], 7).select("source", "doc_id")


def w13_round_robin(spark, d):
    return ranking.round_robin(table(spark, d, "documents"), "source", ["doc_id"], 40).select("source", "doc_id", "turn")


def w14_chunks(spark, d):
    return ranking.chunked(table(spark, d, "documents"), ["source"], ["doc_id"], 32).groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


def a22_inversions(spark, d):
    return ranking.inversions(table(spark, d, "memory_events").select("source_type", "ingest_order", "created_at"), ["source_type"], F.col("ingest_order"), F.unix_micros(F.col("created_at").cast("timestamp")))


QUERIES = {f.__name__: f for f in (a24_contradictions, w3_previous_fact, w4_latest_state, f17_changes, f17_durations, j13_two_hops, u4_reference_cycles, f14_day_numbers, f20_calendar_ages, f16_units, f18_distances, f37_scalar_math, a27_statistics, f38_expressions, d2_ticket_conflicts, k3_latest_jobs, a8_queue_counters, w16_claim_order, d1_lookup, u6_purged, j16_corrected, u4_correction_problems, j20_retrieval, j9_run_states, j8_complete_runs, o10_recent_runs, a21_latencies, proj10_readable, proj20_policy_problems, d3_merged_spaces, d4_best_evidence, w9_budget, w10_prefix_budget, w11_stratified, w12_even_sample, w13_round_robin, w14_chunks, a22_inversions)}

FACTS = r"""
stated AS (
  SELECT statement_id, min((created_at, subject_value, predicate_iri, object_value, temporal_start)) AS c FROM claims GROUP BY statement_id
),
parsed AS (
  SELECT statement_id AS fact_id, c[2] AS entity, c[3] AS predicate, c[4] AS object, trim(c[5]) AS s,
    regexp_extract(trim(c[5]), '^(\d{4})(-(\d{2})(-(\d{2})([Zz]|T.*)?)?)?$', ['y', 'm0', 'm', 'd0', 'd', 'z']) AS p FROM stated
),
facts AS (
  SELECT fact_id, entity, predicate, object, CASE WHEN regexp_matches(s, '^\d{4}$') THEN 9 WHEN regexp_matches(s, '^\d{4}-\d{2}$') THEN 10 ELSE 11 END AS precision,
    try_cast(p.y || '-' || CASE WHEN p.m = '' THEN '01' ELSE p.m END || '-' || CASE WHEN p.d = '' THEN '01' ELSE p.d END AS date) AS position
  FROM parsed WHERE p.y <> '' AND p.y <> '0000'
),
dated AS (SELECT * FROM facts WHERE position IS NOT NULL),
instants AS (SELECT entity, predicate, precision, position, count(*) AS n, min((fact_id, object)) AS one FROM dated GROUP BY ALL)"""
_MEASURES = """
facts AS (SELECT user_id AS entity, event_type AS predicate, ts::date AS position, value AS object, event_id AS fact_id FROM events),
instants AS (SELECT entity, predicate, position, count(*) AS n, min(fact_id) AS fact_id, min(object) AS object FROM facts GROUP BY ALL),
chained AS (
  SELECT *, lag(n) OVER w AS pn, lag(fact_id) OVER w AS pf, lag(object) OVER w AS po, lag(position) OVER w AS pp FROM instants WINDOW w AS (PARTITION BY entity, predicate ORDER BY position)
),
pairs AS (SELECT entity, predicate, fact_id, pf AS previous_id, object, po, (position - pp)::double AS days FROM chained WHERE n = 1 AND pn = 1)"""
_JOBS = "latest AS (SELECT * FROM injection_jobs QUALIFY row_number() OVER (PARTITION BY id ORDER BY sequence DESC) = 1)"
_RUN_STATES = f"""{_JOBS},
listed AS (SELECT DISTINCT run_id, ordinal, job_id FROM injection_test_run_jobs),
per AS (
  SELECT run_id, count(*) AS n_jobs, count(*) FILTER (WHERE state = 'pending') AS n_pending, count(*) FILTER (WHERE state = 'processing') AS n_processing,
    count(*) FILTER (WHERE state = 'completed') AS n_completed, count(*) FILTER (WHERE state = 'failed') AS n_failed, count(*) FILTER (WHERE state IS NULL) AS n_purged
  FROM listed LEFT JOIN latest ON job_id = id GROUP BY run_id
),
states AS (
  SELECT r.run_id, r.state AS run_state, expected_count, coalesce(n_jobs, 0) AS n_jobs, coalesce(n_pending, 0) AS n_pending, coalesce(n_processing, 0) AS n_processing,
    coalesce(n_completed, 0) AS n_completed, coalesce(n_failed, 0) AS n_failed, coalesce(n_purged, 0) AS n_purged FROM injection_test_runs r LEFT JOIN per USING (run_id)
)"""
_POLICY_ROWS = ", ".join("('{}', '{}', {}, [{}]::varchar[], [{}]::varchar[])".format(s, k, f"'{o}'" if o else "NULL", ", ".join(f"'{x}'" for x in r), ", ".join(f"'{x}'" for x in w)) for s, k, o, r, w in POLICIES)
_POLICIES = f"policies AS (SELECT * FROM (VALUES {_POLICY_ROWS}) AS t(space, kind, owner, readers, writers))"

ORACLES = {
    "a22_inversions": """WITH e AS (SELECT source_type, ingest_order AS o, created_at AS v FROM memory_events WHERE created_at IS NOT NULL)
SELECT a.source_type, count(DISTINCT a.o) AS n_rows, count(b.v) AS n_inversions
FROM e a LEFT JOIN e b ON b.source_type IS NOT DISTINCT FROM a.source_type AND b.o > a.o AND b.v < a.v GROUP BY a.source_type""",
    "w9_budget": """WITH RECURSIVE d AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
fold AS (
  SELECT source, doc_id, n_chars, rn, n_chars <= 20000 AS kept, CASE WHEN n_chars <= 20000 THEN n_chars ELSE 0 END AS used FROM d WHERE rn = 1
  UNION ALL SELECT d.source, d.doc_id, d.n_chars, d.rn, f.used + d.n_chars <= 20000, f.used + CASE WHEN f.used + d.n_chars <= 20000 THEN d.n_chars ELSE 0 END
  FROM fold f JOIN d ON d.source = f.source AND d.rn = f.rn + 1
)
SELECT source, doc_id, n_chars FROM fold WHERE kept""",
    "a24_contradictions": f"WITH {FACTS} SELECT entity, predicate, precision, (position - DATE '0001-01-01')::bigint AS position, count(DISTINCT object) + max(CASE WHEN object IS NULL THEN 1 ELSE 0 END) AS n_objects, count(*) AS n_facts FROM dated GROUP BY ALL HAVING n_objects > 1",
    "w3_previous_fact": f"""WITH {FACTS}, chained AS (SELECT *, lag(n) OVER w AS pn, lag(one) OVER w AS po FROM instants WINDOW w AS (PARTITION BY entity, predicate ORDER BY position, precision))
SELECT one[1] AS fact_id, CASE WHEN pn = 1 THEN po[1] END AS previous_id FROM chained WHERE n = 1""",
    "w4_latest_state": f"""WITH {FACTS}, last AS (SELECT * FROM instants QUALIFY row_number() OVER (PARTITION BY entity, predicate ORDER BY position DESC, precision DESC) = 1)
SELECT entity, predicate, one[1] AS fact_id, one[2] AS object FROM last WHERE n = 1""",
    "f17_changes": f"""WITH {_MEASURES}
SELECT entity, predicate, fact_id, previous_id, 'interval_from_previous' AS kind, round(days, 6) AS value FROM pairs
UNION ALL SELECT entity, predicate, fact_id, previous_id, 'absolute_change', round(object - po, 6) FROM pairs WHERE object - po IS NOT NULL
UNION ALL SELECT entity, predicate, fact_id, previous_id, 'percent_change', round((object - po) / abs(po) * 100, 6) FROM pairs WHERE po <> 0 AND object IS NOT NULL
UNION ALL SELECT entity, predicate, fact_id, previous_id, 'annual_rate', round((object - po) / (days / 365.2425), 6) FROM pairs WHERE days > 0 AND object - po IS NOT NULL""",
    "f17_durations": r"""WITH raw AS (SELECT DISTINCT statement_id, trim(temporal_start) AS s, trim(temporal_end) AS e FROM claims),
bounds AS (
  SELECT statement_id, side, v, try_cast(substr(v, 1, 4) || '-' || CASE WHEN length(v) > 4 THEN substr(v, 6, 2) ELSE '01' END || '-' || CASE WHEN length(v) > 7 THEN substr(v, 9, 2) ELSE '01' END AS date) AS day, s, e
  FROM (SELECT statement_id, s, e, unnest(['s', 'e']) AS side, unnest([s, e]) AS v FROM raw) WHERE regexp_matches(v, '^\d{4}(-\d{2}(-\d{2}([Zz]|T.*)?)?)?$')
),
placed AS (
  SELECT statement_id, s, e, side, CASE WHEN length(v) = 4 THEN 9 WHEN year(day) < 1 OR day IS NULL THEN NULL WHEN length(v) = 7 THEN 10 ELSE 11 END AS p,
    CASE length(v) WHEN 4 THEN substr(v, 1, 4)::bigint WHEN 7 THEN year(day) * 12 + month(day) - 1 ELSE (day - DATE '0001-01-01')::bigint + 306 END AS at FROM bounds
),
spans AS (
  SELECT DISTINCT a.statement_id, a.p, a.at AS lo, b.at AS hi FROM placed a JOIN placed b ON a.statement_id = b.statement_id AND a.s = b.s AND a.e = b.e AND a.p = b.p AND a.side = 's' AND b.side = 'e' WHERE b.at >= a.at
)
SELECT statement_id, CASE p WHEN 9 THEN 'duration_years' WHEN 10 THEN 'duration_months' ELSE 'duration_days' END AS kind, (hi - lo)::double AS value, p = 11 AS exact FROM spans
UNION ALL SELECT statement_id, 'temporal_midpoint', (lo + hi) / 2.0, p = 11 FROM spans""",
    "j13_two_hops": "SELECT 'order-' || o_orderkey AS first_id, 'line-' || l_orderkey || '-' || l_linenumber AS second_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    "u4_reference_cycles": """WITH RECURSIVE edges AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS o FROM lineitem WHERE l_partkey IN (SELECT l_suppkey FROM lineitem)),
walks AS (
  SELECT s AS node, o AS reached, 1 AS length FROM edges
  UNION SELECT w.node, e.o, w.length + 1 FROM walks w JOIN edges e ON w.reached = e.s WHERE w.reached <> w.node AND w.length < (SELECT count(DISTINCT s) FROM edges)
)
SELECT node, min(length)::integer AS length FROM walks WHERE node = reached GROUP BY node""",
    "f14_day_numbers": """WITH d AS (SELECT DISTINCT l_shipdate::date AS ship_day FROM lineitem)
SELECT ship_day, (ship_day - DATE '0001-01-01')::bigint + 306 AS day_number, (year(ship_day) % 4 = 0 AND (year(ship_day) % 100 <> 0 OR year(ship_day) % 400 = 0)) AS leap,
  day(last_day(ship_day))::integer AS month_days, (4000 - year(ship_day)) || ' AEC' AS label FROM d""",
    "f20_calendar_ages": r"""WITH raw AS (SELECT DISTINCT statement_id, trim(temporal_start) AS b, trim(temporal_end) AS e FROM claims),
bounds AS (
  SELECT statement_id,
    CASE WHEN regexp_matches(b, '^\d{4}$') THEN try_cast(b || '-01-01' AS date) WHEN regexp_matches(b, '^\d{4}-\d{2}$') THEN try_cast(b || '-01' AS date) WHEN regexp_matches(b, '^\d{4}-\d{2}-\d{2}$') THEN try_cast(b AS date) END AS b0,
    CASE WHEN regexp_matches(b, '^\d{4}$') THEN try_cast(b || '-12-31' AS date) WHEN regexp_matches(b, '^\d{4}-\d{2}$') THEN last_day(try_cast(b || '-01' AS date)) WHEN regexp_matches(b, '^\d{4}-\d{2}-\d{2}$') THEN try_cast(b AS date) END AS b1,
    CASE WHEN regexp_matches(e, '^\d{4}$') THEN try_cast(e || '-01-01' AS date) WHEN regexp_matches(e, '^\d{4}-\d{2}$') THEN try_cast(e || '-01' AS date) WHEN regexp_matches(e, '^\d{4}-\d{2}-\d{2}$') THEN try_cast(e AS date) END AS e0,
    CASE WHEN regexp_matches(e, '^\d{4}$') THEN try_cast(e || '-12-31' AS date) WHEN regexp_matches(e, '^\d{4}-\d{2}$') THEN last_day(try_cast(e || '-01' AS date)) WHEN regexp_matches(e, '^\d{4}-\d{2}-\d{2}$') THEN try_cast(e AS date) END AS e1
  FROM raw
),
ages AS (SELECT statement_id,
  year(e0) - year(b1) - CASE WHEN month(e0) * 100 + day(e0) < month(b1) * 100 + day(b1) THEN 1 ELSE 0 END AS a,
  year(e1) - year(b0) - CASE WHEN month(e1) * 100 + day(e1) < month(b0) * 100 + day(b0) THEN 1 ELSE 0 END AS z FROM bounds WHERE b0 IS NOT NULL AND e0 IS NOT NULL)
SELECT statement_id, CASE WHEN a = z THEN a::varchar ELSE a || '..' || z END AS age FROM ages WHERE a >= 0""",
    "f16_units": """SELECT event_id, CASE event_type WHEN 'click' THEN 'length' WHEN 'view' THEN CASE WHEN value + 273.15 >= 0 THEN 'temperature' END WHEN 'purchase' THEN 'mass' END AS dimension,
  CASE event_type WHEN 'click' THEN 'm' WHEN 'view' THEN CASE WHEN value + 273.15 >= 0 THEN 'K' END WHEN 'purchase' THEN 'kg' END AS unit,
  round(CASE event_type WHEN 'click' THEN value * 1000.0::double WHEN 'view' THEN CASE WHEN value + 273.15::double >= 0 THEN value + 273.15::double END WHEN 'purchase' THEN value * 1e-6 END, 12) AS value,
  CASE WHEN event_type IN ('click', 'view', 'purchase') THEN true END AS exact FROM events""",
    "f18_distances": """WITH p AS (SELECT c_custkey, radians((c_custkey % 180 - 90)::double) AS a, radians(c_nationkey * 14.0::double - 180) AS b, radians((c_custkey % 120 - 60)::double) AS c, radians(10.0::double) AS e FROM customer)
SELECT c_custkey, round(2 * 6371.0088::double * asin(least(1.0, sqrt(pow(sin((c - a) / 2), 2) + cos(a) * cos(c) * pow(sin((e - b) / 2), 2)))), 3) AS km FROM p""",
    "f37_scalar_math": """SELECT l_orderkey, l_linenumber, floor(-l_extendedprice / l_quantity)::bigint AS floor_quotient, round(-l_extendedprice - l_quantity * floor(-l_extendedprice / l_quantity), 4) AS floor_remainder,
  trunc(-l_extendedprice / l_quantity)::bigint AS whole, round(sqrt(l_extendedprice), 6) AS root, CASE WHEN l_quantity <> 1 THEN round(ln(l_extendedprice) / ln(l_quantity), 6) END AS log_base,
  gcd(l_partkey, l_suppkey * 6)::bigint AS divisor, (factorial(l_linenumber + 5) / factorial(5))::double AS choices, round_even(l_quantity / 2, 0) AS half_even, round(atan2(l_extendedprice, l_quantity), 6) AS angle,
  CASE WHEN l_partkey * 10000000000000 > 9007199254740991 THEN (l_partkey * 10000000000000)::varchar END AS safe FROM lineitem""",
    "a27_statistics": """SELECT l_returnflag, round(sum(l_extendedprice), 2) AS total, min(l_extendedprice) AS least, max(l_extendedprice) AS most, round(avg(l_extendedprice), 6) AS mean, round(median(l_extendedprice), 6) AS median,
  quantile_disc(l_extendedprice, 0.5) AS median_low, round(var_pop(l_extendedprice), 2) AS pvariance, round(stddev_pop(l_extendedprice), 4) AS pstdev, round(var_samp(l_extendedprice), 2) AS variance, round(stddev_samp(l_extendedprice), 4) AS stdev
FROM lineitem GROUP BY l_returnflag""",
    "f38_expressions": """WITH v AS (SELECT o_orderkey, o_orderkey % 10 AS k, 2 + (17 * o_orderkey) % 997 AS a, 2 + (31 * o_orderkey) % 499 AS b, 2 + (13 * o_orderkey) % 97 AS c FROM orders)
SELECT o_orderkey,
  CASE k WHEN 0 THEN a || ' + ' || b || ' * ' || c WHEN 1 THEN 'gcd(' || a || ', ' || b || ')' WHEN 2 THEN 'comb(' || (c + 10) || ', ' || (c % 5) || ')' WHEN 3 THEN 'sqrt(' || a || ')' WHEN 4 THEN 'mean(' || a || ', ' || b || ', ' || c || ')'
    WHEN 5 THEN 'sin(' || a || ') + cos(' || b || ')' WHEN 6 THEN 'floor(' || a || ' / ' || b || ')' WHEN 7 THEN 'isqrt(' || (a * b) || ')' WHEN 8 THEN 'hypot(' || a || ', ' || b || ')' ELSE 'log2(2 ** ' || c || ')' END AS expression,
  CASE WHEN k IN (3, 5, 8, 9) THEN 'float' WHEN k = 4 AND (a + b + c) % 3 <> 0 THEN 'fraction' ELSE 'integer' END AS kind,
  round(CASE k WHEN 0 THEN (a + b * c)::double WHEN 1 THEN gcd(a, b)::double
    WHEN 2 THEN CASE c % 5 WHEN 0 THEN 1 WHEN 1 THEN (c + 10)::double WHEN 2 THEN (c + 10.0) * (c + 9) / 2 WHEN 3 THEN (c + 10.0) * (c + 9) * (c + 8) / 6 ELSE (c + 10.0) * (c + 9) * (c + 8) * (c + 7) / 24 END
    WHEN 3 THEN sqrt(a) WHEN 4 THEN (a + b + c) / 3.0 WHEN 5 THEN sin(a) + cos(b) WHEN 6 THEN floor(a / b) WHEN 7 THEN floor(sqrt(a * b)) WHEN 8 THEN sqrt(a * a + b * b) ELSE c::double END, 6) AS approximation,
  NULL::varchar AS error FROM v""",
    "d2_ticket_conflicts": "SELECT idempotency_key, count(*) AS n_requests, count(DISTINCT payload_hash) AS n_payloads, count(*) - count(DISTINCT payload_hash) AS n_deduplicated, count(DISTINCT payload_hash) > 1 AS conflict FROM injection_jobs WHERE idempotency_key IS NOT NULL GROUP BY idempotency_key",
    "k3_latest_jobs": f"WITH {_JOBS} SELECT sequence, id, state, attempts FROM latest",
    "a8_queue_counters": f"""WITH {_JOBS} SELECT count(*) FILTER (WHERE state = 'pending') AS pending, count(*) FILTER (WHERE state = 'processing') AS processing, count(*) FILTER (WHERE state = 'completed') AS completed,
  count(*) FILTER (WHERE state = 'failed') AS failed, count(*) FILTER (WHERE state = 'pending' AND available_at <= {NOW}) AS ready, round(min(enqueued_at) FILTER (WHERE state NOT IN ('completed', 'failed')), 3) AS oldest_unfinished,
  sum(attempts)::bigint AS attempts, (SELECT last_error FROM latest WHERE last_error IS NOT NULL ORDER BY updated_at DESC, sequence DESC LIMIT 1) AS latest_error FROM latest""",
    "w16_claim_order": f"""WITH {_JOBS}, p AS (SELECT sequence, id, available_at, unnest([1767225600.0::double, 1735689600.0::double]) AS as_of FROM latest WHERE state = 'pending'),
ready AS (SELECT * FROM p WHERE sequence < coalesce((SELECT min(sequence) FROM p q WHERE q.as_of = p.as_of AND q.available_at > q.as_of), 9223372036854775807))
SELECT as_of, sequence, id FROM ready QUALIFY row_number() OVER (PARTITION BY as_of ORDER BY sequence) <= 25""",
    "d1_lookup": f"WITH {_JOBS} SELECT row_number() OVER (ORDER BY sequence DESC) - 1 AS position, id, state FROM latest ORDER BY sequence DESC LIMIT 40",
    "u6_purged": f"WITH {_JOBS} SELECT id, state FROM latest WHERE NOT (state = 'completed' AND sequence % 2 = 0)",
    "j16_corrected": f"""WITH {FACTS}, c AS (SELECT entity, predicate, n, one[1] AS id, lag(CASE WHEN n = 1 THEN one[1] END) OVER (PARTITION BY entity, predicate ORDER BY position, precision) AS before FROM instants),
gone AS (SELECT before AS id FROM c WHERE n = 1 AND before IS NOT NULL AND sha256(id)[64:64] IN ('0', '2', '4', '6', '8'))
SELECT fact_id, entity, predicate FROM dated WHERE fact_id NOT IN (SELECT id FROM gone)""",
    "u4_correction_problems": """WITH RECURSIVE f AS (SELECT p_partkey AS n, CASE WHEN p_partkey % 4 = 0 THEN 'p' ELSE 'q' END AS k FROM part WHERE p_partkey % 10 <> 3),
e AS (SELECT n, k, (n * 7) % 97 AS t FROM f WHERE n < 200),
w AS (SELECT n, t AS reached, 1 AS steps FROM e WHERE n <> t UNION SELECT w.n, e.t, steps + 1 FROM w JOIN e ON e.n = w.reached AND e.n <> e.t WHERE w.reached <> w.n AND steps < 100)
SELECT n::varchar AS fact_id, t::varchar AS target_id, 'unknown_target' AS problem FROM e WHERE t NOT IN (SELECT n FROM f)
UNION ALL SELECT n::varchar, t::varchar, 'self' FROM e WHERE n = t
UNION ALL SELECT e.n::varchar, t::varchar, 'other_key' FROM e JOIN f ON f.n = e.t WHERE f.k <> e.k
UNION ALL SELECT DISTINCT n::varchar, NULL, 'cycle' FROM w WHERE n = reached""",
    "j20_retrieval": """WITH r AS (SELECT source AS query_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS last FROM documents),
e AS (SELECT query_id, doc_id, CASE WHEN rank <= 10 THEN rank END AS rank FROM r WHERE last <= 3 OR rank = 2)
SELECT query_id, coalesce(min(rank) = 1, false) AS top1, coalesce(min(rank) <= 5, false) AS top5, count(rank) = count(*) AS complete FROM e GROUP BY query_id""",
    "j9_run_states": f"WITH {_RUN_STATES} SELECT * FROM states",
    "j8_complete_runs": f"WITH {_RUN_STATES} SELECT * FROM states WHERE n_jobs = expected_count AND n_completed + n_failed = expected_count",
    "o10_recent_runs": "SELECT run_id, state FROM injection_test_runs ORDER BY created_at DESC, run_id LIMIT 250",
    "a21_latencies": """WITH s AS (SELECT state, completed_at - claimed_at AS s FROM injection_jobs WHERE completed_at IS NOT NULL AND claimed_at IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY s) AS rn, count(*) OVER (PARTITION BY state) AS n FROM s)
SELECT state, max(n) AS n, round(quantile_cont(s, 0.95), 4) AS linear, round(max(s) FILTER (WHERE rn = greatest(1, ceil(0.95 * n))), 4) AS ceiling,
  round(max(s) FILTER (WHERE rn = round_even(0.95 * (n - 1), 0) + 1), 4) AS nearest, round(max(s) FILTER (WHERE rn = floor(0.95 * (n - 1)) + 1), 4) AS floor FROM r GROUP BY state""",
    "proj10_readable": f"""WITH {_POLICIES} SELECT source AS space, count(*) AS n_documents FROM documents JOIN policies ON source = space
WHERE owner = 'ana' OR list_contains(readers, 'ana') OR list_contains(readers, '*') OR (kind = 'reference' AND len(readers) = 0) GROUP BY source""",
    "proj20_policy_problems": f"""WITH {_POLICIES}, spaces AS (SELECT DISTINCT source AS space FROM documents)
SELECT space, 'policy_without_space' AS problem FROM policies WHERE space NOT IN (SELECT space FROM spaces) UNION ALL SELECT space, 'space_without_policy' FROM spaces WHERE space NOT IN (SELECT space FROM policies)""",
    "d3_merged_spaces": "SELECT sha256(text) AS fingerprint, min((source, doc_id % 10))[1] AS space, min((source, doc_id % 10))[2] AS rank, max(n_chars)::double AS score, array_to_string(list_sort(list_distinct(list(source))), ',') AS origins FROM documents GROUP BY sha256(text)",
    "d4_best_evidence": """WITH i AS (SELECT subject_value AS key, concat_ws(' ', predicate_label, object_label) AS text, CASE WHEN confidence_level = 'statement-attributed' THEN 2 ELSE 1 END AS status_rank, epoch_us(created_at) AS position, [predicate_label, epistemic_status] AS tags FROM claims),
best AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY key ORDER BY status_rank DESC, text DESC, position) = 1),
per AS (SELECT key, min(position) AS position, array_to_string(list_sort(list_distinct(flatten(list(tags))))[1:16], '|') AS tags, count(*) AS n_merged FROM i GROUP BY key)
SELECT per.key, best.text, best.status_rank, per.position, per.tags, per.n_merged FROM per JOIN best USING (key)""",
    "w10_prefix_budget": "SELECT source, doc_id, n_chars FROM documents QUALIFY sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) <= 20000",
    "w11_stratified": """SELECT row_id, task FROM training_examples QUALIFY row_number() OVER (PARTITION BY task ORDER BY row_id) <=
  CASE task WHEN 'direct_recall_with_citations' THEN 20 WHEN 'multi_hop_relation' THEN 20 WHEN 'unsupported_abstention' THEN 20 WHEN 'temporal_age' THEN 19 WHEN 'role_disambiguation' THEN 19 ELSE 0 END""",
    "w12_even_sample": """WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, doc_id FROM r WHERE n <= 7 OR rn IN (0, round_even((n - 1) / 6.0::double, 0), round_even(2 * ((n - 1) / 6.0::double), 0), round_even(3 * ((n - 1) / 6.0::double), 0), round_even(4 * ((n - 1) / 6.0::double), 0), round_even(5 * ((n - 1) / 6.0::double), 0), n - 1)""",
    "w13_round_robin": "SELECT source, doc_id, turn::integer AS turn FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents) ORDER BY turn, source LIMIT 40",
    "w14_chunks": "WITH r AS (SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 32 AS chunk FROM documents) SELECT source, chunk, count(*) AS n, min(doc_id) AS first_id FROM r GROUP BY source, chunk",
}
