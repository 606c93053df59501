"""Queries of the life of tickets, of spaces' guards and of evidence capsules."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.operators import capsules, evidence, hub, lifecycle, memory, queue, ranking, timeline
from loomspan.plans.facts import _JOBS, _RUN_STATES
from loomspan.plans.memory import EVENTS
from loomspan.plans.quality import WELL_FORMED
from loomspan.runtime import stage, table

NOW = 1764600000.0


def _jobs(spark, d):
    return stage(queue.latest_jobs(table(spark, d, "injection_jobs")))


def _acks(spark, d):
    """Acknowledgements of all tickets by the last worker that was told of them, of every third one by another."""
    worker = F.when(F.col("sequence") % 3 == 0, "intruder").otherwise(F.coalesce("claimed_by", F.lit("nobody")))
    return _jobs(spark, d).select("id", worker.alias("worker"), F.lit(NOW).alias("at"), F.lit("{}").alias("result"))


def t3_completed(spark, d):
    after, _ = lifecycle.complete(_jobs(spark, d), _acks(spark, d))
    return after.select("id", "state", "claimed_by", "completed_at", "result_json")


def t3_refused(spark, d):
    return lifecycle.complete(_jobs(spark, d), _acks(spark, d))[1]


def t4_failed(spark, d):
    jobs = _jobs(spark, d)
    told = jobs.select("id", F.col("claimed_by").alias("worker"), F.lit("boom").alias("error"), (F.col("sequence") % 5 == 0).alias("permanent"))
    return lifecycle.fail(jobs, told, 2.0, 60.0, NOW).select("id", "state", "available_at", "completed_at", "last_error")


def t5_recovered(spark, d):
    return lifecycle.recover(_jobs(spark, d), NOW, 30.0).select("id", "state", "attempts", "claimed_by", "last_error")


def t5_released(spark, d):
    jobs = _jobs(spark, d)
    return lifecycle.release(jobs, jobs.select("id"), "worker-1", NOW, 5.0).select("id", "state", "attempts", "available_at")


def t5_heartbeat(spark, d):
    return lifecycle.heartbeat(_jobs(spark, d), "worker-2", NOW).select("id", "claimed_at")


def t6_redelivered(spark, d):
    jobs = _jobs(spark, d)
    return lifecycle.redeliver(jobs, jobs.where("attempts > 1").select("id"), NOW)[0].select("id", "state", "attempts", "completed_at", "result_json")


def t6_refused(spark, d):
    jobs = _jobs(spark, d)
    return lifecycle.redeliver(jobs, jobs.where("attempts > 1").select("id"), NOW)[1]


def t7_admission(spark, d):
    """Runs whose tickets would be enqueued again with what each listed job's key held first."""
    jobs = table(spark, d, "injection_jobs")
    listed = table(spark, d, "injection_test_run_jobs").select("run_id", "job_id").distinct()
    first = jobs.groupBy("id").agg(F.min_by(F.struct("idempotency_key", "payload_hash"), "sequence").alias("j"))
    wanted = listed.join(first.withColumnRenamed("id", "job_id"), "job_id").select("run_id", "j.*").where("idempotency_key IS NOT NULL")
    return lifecycle.run_admission(wanted, jobs)


def t7_cleanup(spark, d):
    jobs = _jobs(spark, d)
    states = queue.run_states(table(spark, d, "injection_test_runs"), table(spark, d, "injection_test_run_jobs"), jobs)
    gone = table(spark, d, "forgotten_keys").where("target_table = 'injection_jobs'").select(F.trim("target_key").alias("id"))
    return lifecycle.run_cleanup(states, table(spark, d, "injection_test_run_jobs"), jobs, gone)


def t13_lag(spark, d):
    out = lifecycle.lag(_jobs(spark, d), NOW)
    return out.select("state", "n", F.round("oldest_age", 3).alias("oldest_age"), F.round("mean_age", 3).alias("mean_age"), "n_overdue")


def proj6_public_jobs(spark, d):
    return lifecycle.public(_jobs(spark, d), ["id", "state", "attempts", "max_attempts", "enqueued_at", "last_error", "not_there"])


def a30_gated(spark, d):
    runs = table(spark, d, "injection_test_runs").select("run_id", "expected_count", (F.col("successful_count") / F.col("expected_count")).alias("success_rate"), (F.col("failed_count") / F.col("expected_count")).alias("failure_rate"))
    out = lifecycle.gated(runs, F.col("success_rate") + F.col("failure_rate") >= 1, ["success_rate", "failure_rate"])
    return out.select("run_id", "scored", F.round("success_rate", 6).alias("success_rate"), F.round("failure_rate", 6).alias("failure_rate"))


def u2_ids_by_key(spark, d):
    rows = table(spark, d, "memory_events")
    keys = rows.select(F.concat(F.lit(" "), "idempotency_key", F.lit(" ")).alias("key")).unionByName(spark.createDataFrame([("unknown",), ("  ",), (None,)], "key string"))
    return memory.event_ids(rows, keys)


def u2_forgotten_by_key(spark, d):
    rows = table(spark, d, "memory_events")
    log = stage(memory.event_log(rows))
    keys = rows.where("source_type = 'generated'").select(F.col("idempotency_key").alias("key"))
    return memory.forget_by_key(rows, log, keys)[0].groupBy("episode").agg(F.count(F.lit(1)).alias("n_events"), F.max("ingest_order").alias("last_order"))


def u3_cascade(spark, d):
    log = stage(memory.event_log(table(spark, d, "memory_events")))
    kept = stage(memory.forget(log, log.where("source_type = 'observed'")))
    concepts = table(spark, d, "concepts").select(T.normalised(F.col("canonical_key")).alias("canonical_key"))
    return memory.cascade(kept, concepts)


def proj11_generated_guard(spark, d):
    out = hub.generated_guard(table(spark, d, "memory_events"), "source_json")
    return out.groupBy("source_type", "refused").agg(F.count(F.lit(1)).alias("n"))


def proj12_semantic_contexts(spark, d):
    stamped = hub.stamped_context(F.col("context_json"), F.lit("ana"), F.lit("notes"))
    jobs = table(spark, d, "injection_jobs").select("sequence", "context_json", stamped.alias("stamped"))
    out = jobs.select("sequence", (hub.semantic_context("stamped") == T.context_json("context_json")).alias("same"), F.get_json_object("stamped", "$.memory_hub_agent").alias("agent"))
    return out.where("same IS NOT NULL")


def o5_ranked_items(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("space"), (F.col("doc_id") % 10).alias("rank"), F.col("n_chars").cast("double").alias("score"), F.sha2("text", 256).alias("fingerprint"))
    return hub.ranked_items(hub.merged_spaces(docs), 50).select("fingerprint", "space", "score")


def o6_ranked_evidence(spark, d):
    items = table(spark, d, "claims").select(F.col("statement_id").alias("evidence_id"), F.unix_seconds(F.col("created_at").cast("timestamp")).alias("position"), F.split(F.lower(F.concat_ws(" ", "subject_label", "predicate_label")), " ").alias("tokens")).dropDuplicates(["evidence_id", "position"])
    return hub.ranked_evidence(items, ["dirige", "reside"], 64).select("evidence_id", "position", "overlap")


def _evidence_facts(spark, d):
    """Statements of claims as facts, their subject as dossier."""
    said = F.concat_ws(" ", "subject_label", "predicate_label", "object_label")
    facts = table(spark, d, "claims").groupBy("statement_id").agg(F.min(F.struct("subject_value", "subject_label", said.alias("statement"), "temporal_start", "epistemic_status")).alias("c"))
    return facts.select(F.col("c.subject_value").alias("dossier"), F.col("statement_id").alias("fact_id"), "c.subject_label", "c.statement", F.col("c.temporal_start").alias("date"), F.col("c.epistemic_status").alias("status"), F.split(F.lower("c.statement"), " ").alias("tokens"))


def _questions(facts):
    """For each dossier the words of its label: a question that the dossier should answer."""
    return facts.groupBy(F.col("dossier").alias("question_id")).agg(F.min("subject_label").alias("q")).where("q IS NOT NULL").select("question_id", F.split(F.lower("q"), " ").alias("tokens"))


def proj16_stable_items(spark, d):
    sources = table(spark, d, "claim_sources").select(F.col("statement_id").alias("fact_id"), F.concat_ws("#", "import_id", "entry_name").alias("source_id"))
    return capsules.stable_item(_evidence_facts(spark, d), sources)


def _capsule_facts(spark, d):
    """The evidence facts written with no more columns than capsules need; tokens are split on reading."""
    facts = stage(_evidence_facts(spark, d).select("dossier", "fact_id", "subject_label", "statement"))
    return facts.withColumn("tokens", F.split(F.lower("statement"), " "))


def o7_matches(spark, d):
    facts = _capsule_facts(spark, d)
    return capsules.matches(_questions(facts), facts, 3)


def u8_capsules(spark, d):
    facts = _capsule_facts(spark, d)
    return capsules.capsules(_questions(facts), facts, 3, 200).select("question_id", "dossier", "rank", "fact_id")


def u8_coverage(spark, d):
    facts = _capsule_facts(spark, d)
    rows = capsules.capsules(_questions(facts), facts, 3, 200)
    return capsules.capsule_coverage(rows, facts.select(F.col("dossier").alias("question_id"), "fact_id"))


def u8_leaks(spark, d):
    rows = table(spark, d, "training_examples").select("row_id", F.when(F.col("row_id") % 4 == 0, F.concat(F.lit('{"answer_status":1,'), F.substring("target", 2, 100_000))).otherwise(F.col("target")).alias("text"))
    return capsules.evaluation_leaks(rows, "text").select("row_id")


def u7_fingerprint(spark, d):
    facts = _evidence_facts(spark, d).select("dossier", "fact_id", "statement")
    return capsules.table_digest(facts, ["dossier", "fact_id", "statement"]).select("n_rows", (F.length("digest") == 64).alias("digested"))


def f25_status(spark, d):
    rows = table(spark, d, "memory_events").select("source_type", capsules.status_of(F.col("source_type"), F.col("source_type") == "inferred", ["generated", "assistant", "model"]).alias("status"))
    return rows.select("source_type", "status", capsules.confidence_of(F.lit(None).cast("double"), F.col("status")).alias("confidence")).distinct()


def f39_comb_bits(spark, d):
    n, k = (F.col("p_size") * 7).alias("n"), F.col("p_size").alias("k")
    return table(spark, d, "part").select(n, k).distinct().select("n", "k", capsules.comb_bits("n", "k").alias("bits"))


def f41_first_objects(spark, d):
    said = F.concat(F.lit("note {x} {\"a\": 1} => "), "target", F.lit(" fin {}"))
    return table(spark, d, "training_examples").select("row_id", F.get_json_object(capsules.first_mappings(said), "$.answer").alias("answer"))


def f42_recalculated(spark, d):
    day = F.to_date(F.col("o_orderdate").cast("timestamp"))
    born = F.date_sub(day, (F.col("o_orderkey") % 20000).cast("int"))
    call = F.concat(F.lit("calendar_age("), born.cast("string"), F.lit(","), F.date_format(day, "yyyy-MM"), F.lit(",precision=month)"))
    answer = F.lit("Donc le calcul donne 7 ans.")
    out = table(spark, d, "orders").select("o_orderkey", capsules.recalculated(F.col("o_orderkey").cast("string"), answer, F.array(call)).alias("r"))
    return out.select("o_orderkey", F.col("r.results")[0].alias("result"), "r.answer")


def g7_baseline(spark, d):
    rows = table(spark, d, "training_examples").select("row_id", "task", "evidence_ids", F.lit(True).alias("evidence_required"))
    return capsules.without_evidence(rows, "evidence_ids", "evidence_required").groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("evidence_ids")).alias("n_evidence"), F.sum(F.col("evidence_required").cast("int")).alias("n_required"))


def _measured(spark):
    """The generated facts as dated measurements: years, a unit for each predicate, a birth year, a place."""
    units = F.create_map(*(F.lit(x) for p, u in (("population", "person"), ("distance", "km"), ("temperature", "c"), ("duration", "h")) for x in (p, u)))
    rows = evidence.base_facts(spark, 1000)
    ordinal = F.when(F.col("year") > 0, F.col("year")).otherwise(F.col("year") + 1)
    number = F.substring("fact_id", 5, 10).cast("long")
    return rows.select(
        "fact_id", "entity", "predicate", F.lit(9).alias("precision"), ordinal.alias("position"), ordinal.alias("year"), F.when(number % 5 == 0, 9).alias("end_precision"), (ordinal + number % 7).alias("end_position"),
        F.when(number % 3 == 0, F.lit(100).cast("long")).alias("birth_ordinal"), F.col("object").cast("double").alias("value"), units[F.col("predicate")].alias("unit"), F.when(number % 2 == 0, (number % 90).cast("double")).alias("latitude"), (number % 180).cast("double").alias("longitude"),
    )


def f17_derived(spark, d):
    out = timeline.derived(_measured(spark))
    return out.select("event_id", "id", "kind", F.round("value", 6).alias("value"), "unit", "exact", F.array_join("dependencies", ",").alias("dependencies"))


def d7_with_derived(spark, d):
    facts = _measured(spark)
    direct = facts.select(F.col("fact_id").alias("id"), F.lit("direct").alias("origin"))
    both = direct.unionByName(timeline.derived(facts).select("id", F.lit("derived").alias("origin")))
    return both.groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_ids"))


def proj15_derived_records(spark, d):
    told = F.concat_ws(" ", F.col("event_id"), F.col("kind"), F.format_string("%.3f", "value"))
    out = capsules.derived_records(timeline.derived(_measured(spark)), told, quota=3)
    return out.select("id", "marker", "episode_id", "source_type", F.array_join("dependencies", ",").alias("dependencies"))


def g2_disturbed(spark, d):
    return evidence.disturbed(evidence.base_facts(spark, 1000), 11).select("arrival", "fact_id", "object", "kind")


def g3_workload(spark, d):
    return evidence.workload_queries(_evidence_facts(spark, d).select("fact_id", F.col("dossier").alias("entity"), F.col("status").alias("predicate"), F.trim("date").alias("date")), 20)


def proj19_models(spark, d):
    return evidence.filtered_models(table(spark, d, "training_configs"), ["base", "embedding"], [], 5).select("config_id", "base_model", "kind")


def s20_question_problems(spark, d):
    rows = table(spark, d, "training_examples").select("row_id", "example_id", F.element_at("messages", 2)["content"].alias("question"), F.when(F.col("task") == "unsupported_abstention", "unanswerable").otherwise("answerable").alias("status"), F.size("evidence_ids").alias("n_fragments"))
    return evidence.question_problems(rows)


QUERIES = {f.__name__: f for f in (t3_completed, t3_refused, t4_failed, t5_recovered, t5_released, t5_heartbeat, t6_redelivered, t6_refused, t7_admission, t7_cleanup, t13_lag, proj6_public_jobs, a30_gated, u2_ids_by_key, u2_forgotten_by_key, u3_cascade, proj11_generated_guard, proj12_semantic_contexts, o5_ranked_items, o6_ranked_evidence, proj16_stable_items, o7_matches, u8_capsules, u8_coverage, u8_leaks, u7_fingerprint, f25_status, f39_comb_bits, f41_first_objects, f42_recalculated, g7_baseline, f17_derived, d7_with_derived, proj15_derived_records, g2_disturbed, g3_workload, proj19_models, s20_question_problems)}

_FACTS = """ev AS (SELECT statement_id AS fact_id, min((subject_value, subject_label, concat_ws(' ', subject_label, predicate_label, object_label), temporal_start, epistemic_status)) AS c FROM claims GROUP BY statement_id),
facts AS (SELECT fact_id, c[1] AS dossier, c[2] AS label, c[3] AS statement, c[4] AS date, c[5] AS status FROM ev),
words AS (SELECT DISTINCT dossier, unnest(string_split(lower(statement), ' ')) AS token FROM facts),
asked AS (SELECT DISTINCT question_id, unnest(string_split(q, ' ')) AS token FROM (SELECT dossier AS question_id, lower(min(label)) AS q FROM facts GROUP BY dossier)),
sizes AS (SELECT dossier, count(*) AS n_facts FROM facts GROUP BY dossier),
met AS (SELECT question_id, a.dossier, matched, n_facts, row_number() OVER (PARTITION BY question_id ORDER BY matched DESC, n_facts DESC, a.dossier) AS rank
  FROM (SELECT question_id, dossier, count(*) AS matched FROM asked JOIN words USING (token) GROUP BY question_id, dossier) a JOIN sizes USING (dossier) QUALIFY rank <= 3)"""
_CAPSULES = f"""{_FACTS},
capsule AS (SELECT question_id, met.dossier, rank, fact_id FROM met JOIN facts ON met.dossier = facts.dossier
  QUALIFY sum(length(statement)) OVER (PARTITION BY question_id ORDER BY rank, met.dossier, fact_id ROWS UNBOUNDED PRECEDING) <= 200)"""
_BASE = """base AS (SELECT i, 'evt-' || i AS fact_id, 'Entite-' || (i % 8) AS entity, ['population', 'distance', 'temperature', 'duration'][i % 4 + 1] AS predicate, -49 + i * 7 % 2000 AS pos, 1000 + i * 37 % 9973 AS object FROM range(1000) t(i)),
m AS (SELECT *, CASE predicate WHEN 'population' THEN object::double WHEN 'distance' THEN object * 1000.0 WHEN 'temperature' THEN object + 273.15 ELSE object * 3600.0 END AS value,
  CASE predicate WHEN 'population' THEN 'person' WHEN 'distance' THEN 'm' WHEN 'temperature' THEN 'K' ELSE 's' END AS unit, CASE WHEN i % 2 = 0 THEN (i % 90)::double END AS lat, (i % 180)::double AS lon FROM base),
inst AS (SELECT entity, predicate, pos, count(*) AS n, min(i) AS i FROM m GROUP BY ALL),
prev AS (SELECT i, lag(CASE WHEN n = 1 THEN i END) OVER (PARTITION BY entity, predicate ORDER BY pos) AS pi, n FROM inst),
pair AS (SELECT m.*, q.fact_id AS pf, q.pos AS pp, q.value AS pv, q.lat AS plat, q.lon AS plon FROM m LEFT JOIN prev ON prev.i = m.i AND prev.n = 1 LEFT JOIN m q ON q.i = prev.pi),
derived AS (
  SELECT fact_id AS event_id, 'duration_years' AS kind, (i % 7)::double AS value, 'year' AS unit, false AS exact, fact_id AS dependencies FROM pair WHERE i % 5 = 0
  UNION ALL SELECT fact_id, 'temporal_midpoint', (pos + pos + i % 7) / 2.0, 'civil_year_ordinal', false, fact_id FROM pair WHERE i % 5 = 0
  UNION ALL SELECT fact_id, 'age_at_start', (pos - 100)::double, 'year', false, fact_id FROM pair WHERE i % 3 = 0 AND pos >= 100
  UNION ALL SELECT fact_id, 'normalized_measurement', value, unit, true, fact_id FROM pair
  UNION ALL SELECT fact_id, 'interval_from_previous', (pos - pp)::double, 'year', false, pf || ',' || fact_id FROM pair WHERE pf IS NOT NULL
  UNION ALL SELECT fact_id, 'absolute_change', value - pv, unit, true, pf || ',' || fact_id FROM pair WHERE pf IS NOT NULL
  UNION ALL SELECT fact_id, 'percent_change', (value - pv) / pv * 100, '%', false, pf || ',' || fact_id FROM pair WHERE pv <> 0
  UNION ALL SELECT fact_id, 'annual_rate', (value - pv) / (pos - pp), unit || '/year', false, pf || ',' || fact_id FROM pair WHERE pos <> pp
  UNION ALL SELECT fact_id, 'distance_from_previous', 2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2)))), 'km', false, pf || ',' || fact_id FROM pair WHERE lat IS NOT NULL AND plat IS NOT NULL
)"""

ORACLES = {
    "t3_completed": f"""WITH {_JOBS}, j AS (SELECT *, state = 'processing' AND claimed_by IS NOT NULL AND sequence % 3 <> 0 AS ok FROM latest)
SELECT id, CASE WHEN ok THEN 'completed' ELSE state END AS state, CASE WHEN NOT ok THEN claimed_by END AS claimed_by, CASE WHEN ok THEN {NOW} ELSE completed_at END AS completed_at, CASE WHEN ok THEN '{{}}' ELSE result_json END AS result_json FROM j""",
    "t3_refused": f"WITH {_JOBS} SELECT id, CASE WHEN sequence % 3 = 0 THEN 'intruder' ELSE coalesce(claimed_by, 'nobody') END AS worker FROM latest WHERE NOT coalesce(state = 'processing' AND claimed_by IS NOT NULL AND sequence % 3 <> 0, false)",
    "t4_failed": f"""WITH {_JOBS}, j AS (SELECT *, state = 'processing' AND claimed_by IS NOT NULL AS held, sequence % 5 = 0 OR attempts >= max_attempts AS spent FROM latest)
SELECT id, CASE WHEN NOT held THEN state WHEN spent THEN 'failed' ELSE 'pending' END AS state, CASE WHEN held AND NOT spent THEN {NOW} + least(60.0, 2.0 * pow(2.0, greatest(attempts - 1, 0))) ELSE available_at END AS available_at,
  CASE WHEN held THEN CASE WHEN spent THEN {NOW} END ELSE completed_at END AS completed_at, CASE WHEN held THEN 'boom' ELSE last_error END AS last_error FROM j""",
    "t5_recovered": f"""WITH {_JOBS}, j AS (SELECT *, state = 'processing' AND (claimed_at IS NULL OR claimed_at <= {NOW} - 30) AS stale FROM latest)
SELECT id, CASE WHEN stale THEN 'pending' ELSE state END AS state, CASE WHEN stale THEN greatest(attempts - 1, 0) ELSE attempts END AS attempts, CASE WHEN NOT stale THEN claimed_by END AS claimed_by, CASE WHEN stale THEN coalesce(last_error, 'worker_interrupted') ELSE last_error END AS last_error FROM j""",
    "t5_released": f"""WITH {_JOBS}, j AS (SELECT *, state = 'processing' AND coalesce(claimed_by = 'worker-1', false) AS own FROM latest)
SELECT id, CASE WHEN own THEN 'pending' ELSE state END AS state, CASE WHEN own THEN greatest(attempts - 1, 0) ELSE attempts END AS attempts, CASE WHEN own THEN {NOW} + 5 ELSE available_at END AS available_at FROM j""",
    "t5_heartbeat": f"WITH {_JOBS} SELECT id, CASE WHEN state = 'processing' AND claimed_by = 'worker-2' THEN {NOW} ELSE claimed_at END AS claimed_at FROM latest",
    "t6_redelivered": f"""WITH {_JOBS}, j AS (SELECT *, state IN ('completed', 'failed') AND attempts > 1 AS again FROM latest)
SELECT id, CASE WHEN again THEN 'pending' ELSE state END AS state, CASE WHEN again THEN 0 ELSE attempts END AS attempts, CASE WHEN NOT again THEN completed_at END AS completed_at, CASE WHEN NOT again THEN result_json END AS result_json FROM j""",
    "t6_refused": f"WITH {_JOBS} SELECT id FROM latest WHERE attempts > 1 AND state NOT IN ('completed', 'failed')",
    "t7_admission": """WITH first AS (SELECT id, arg_min((idempotency_key, payload_hash), sequence) AS j FROM injection_jobs GROUP BY id),
wanted AS (SELECT run_id, j[1] AS k, j[2] AS p FROM (SELECT DISTINCT run_id, job_id FROM injection_test_run_jobs) r JOIN first ON r.job_id = first.id WHERE j[1] IS NOT NULL),
per AS (SELECT run_id, k, count(*) AS n, count(DISTINCT p) AS own, any_value(p) AS p FROM wanted GROUP BY run_id, k),
bad AS (SELECT run_id, n, own > 1 OR (SELECT count(*) FROM injection_jobs s WHERE s.idempotency_key = per.k AND s.payload_hash <> per.p) > 0 AS conflict FROM per)
SELECT run_id, sum(n)::bigint AS n_tickets, count(*) FILTER (WHERE conflict) AS n_conflicts, count(*) FILTER (WHERE conflict) = 0 AS admitted FROM bad GROUP BY run_id""",
    "t7_cleanup": f"""WITH {_RUN_STATES}, gone AS (SELECT DISTINCT trim(target_key) AS id FROM forgotten_keys WHERE target_table = 'injection_jobs'),
f AS (SELECT run_id, count(*) FILTER (WHERE latest.state = 'completed' AND gone.id IS NOT NULL) AS forgotten FROM listed LEFT JOIN latest ON job_id = latest.id LEFT JOIN gone ON gone.id = job_id GROUP BY run_id)
SELECT run_id, expected_count, n_completed AS successful_count, n_failed AS failed_count, coalesce(forgotten, 0) AS forgotten_count,
  CASE WHEN n_pending + n_processing > 0 THEN 'active' WHEN coalesce(forgotten, 0) >= n_completed THEN 'cleaned' ELSE 'cleanup_failed' END AS state FROM states LEFT JOIN f USING (run_id)""",
    "t13_lag": f"WITH {_JOBS} SELECT state, count(*) AS n, round(max({NOW} - enqueued_at), 3) AS oldest_age, round(avg({NOW} - enqueued_at), 3) AS mean_age, count(*) FILTER (WHERE available_at <= {NOW}) AS n_overdue FROM latest WHERE state NOT IN ('completed', 'failed') GROUP BY state",
    "proj6_public_jobs": f"WITH {_JOBS} SELECT id, state, attempts, max_attempts, enqueued_at, last_error FROM latest",
    "a30_gated": """WITH r AS (SELECT run_id, successful_count / expected_count::double AS s, failed_count / expected_count::double AS f FROM injection_test_runs)
SELECT run_id, coalesce(s + f >= 1, false) AS scored, CASE WHEN s + f >= 1 THEN round(s, 6) END AS success_rate, CASE WHEN s + f >= 1 THEN round(f, 6) END AS failure_rate FROM r""",
    "u2_ids_by_key": "SELECT trim(idempotency_key) AS key, arg_min(id, ingest_order) AS id FROM memory_events WHERE idempotency_key IS NOT NULL AND trim(idempotency_key) <> '' GROUP BY trim(idempotency_key)",
    "u2_forgotten_by_key": f"""WITH {EVENTS},
keys AS (SELECT DISTINCT trim(idempotency_key) AS key FROM memory_events WHERE source_type = 'generated' AND trim(idempotency_key) <> ''),
gone AS (SELECT DISTINCT h.id FROM (SELECT trim(idempotency_key) AS key, arg_min(id, ingest_order) AS id FROM memory_events WHERE trim(idempotency_key) <> '' GROUP BY 1) h JOIN keys USING (key)),
marked AS (SELECT ev.*, (ev.id IN (SELECT id FROM gone))::int AS g FROM ev),
parts AS (SELECT *, coalesce(sum(g) OVER (PARTITION BY episode ORDER BY ingest_order DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS part FROM marked)
SELECT CASE WHEN part = 0 THEN episode ELSE episode || '/' || part END AS episode, count(*) AS n_events, max(ingest_order) AS last_order FROM parts WHERE g = 0 GROUP BY ALL""",
    "proj11_generated_guard": f"""WITH s AS (SELECT source_type, CASE WHEN {WELL_FORMED.format('source_json')} AND json_type(source_json) = 'OBJECT' THEN source_json END AS j FROM memory_events),
f AS (SELECT source_type, j, lower(trim(coalesce(j ->> '$.type', ''))) AS t, lower(trim(coalesce(j ->> '$.origin', ''))) AS o, lower(trim(coalesce(j ->> '$.kind', ''))) AS k, coalesce(j ->> '$.generated', '') = 'true' AS g FROM s),
r AS (SELECT source_type, CASE WHEN j IS NULL THEN 'no_source' WHEN g OR t IN ('generated', 'model_generated', 'assistant_generated', 'llm_generated') OR o IN ('generated', 'model_generated', 'assistant_generated', 'llm_generated') OR k IN ('generated', 'model_generated', 'assistant_generated', 'llm_generated') THEN 'generated'
  WHEN t NOT IN ('user_confirmed', 'observed', 'executed') THEN 'not_writable' END AS refused FROM f)
SELECT source_type, refused, count(*) AS n FROM r GROUP BY ALL""",
    "o5_ranked_items": """WITH m AS (SELECT sha256(text) AS fingerprint, min(source) AS space, max(n_chars)::double AS score FROM documents WHERE text IS NOT NULL GROUP BY 1)
SELECT fingerprint, space, score FROM m ORDER BY score DESC, fingerprint LIMIT 50""",
    "o6_ranked_evidence": """WITH i AS (SELECT DISTINCT statement_id AS evidence_id, floor(epoch(created_at))::bigint AS position, list_distinct(string_split(lower(concat_ws(' ', subject_label, predicate_label)), ' ')) AS t FROM claims),
o AS (SELECT *, len(list_intersect(t, ['dirige', 'reside'])) AS overlap FROM i)
SELECT evidence_id, position, overlap FROM o ORDER BY floor(position / 1000), overlap DESC, position, evidence_id LIMIT 64""",
    "proj16_stable_items": f"""WITH {_FACTS}, s AS (SELECT statement_id AS fact_id, array_to_string(list_sort(list_distinct(list(import_id || '#' || entry_name))), ',') AS ids FROM claim_sources GROUP BY 1)
SELECT dossier, fact_id, statement, date, status, coalesce(ids, '') AS source_ids FROM facts LEFT JOIN s USING (fact_id)""",
    "o7_matches": f"WITH {_FACTS} SELECT * FROM met",
    "u8_capsules": f"WITH {_CAPSULES} SELECT * FROM capsule",
    "u8_coverage": f"""WITH {_CAPSULES}, per AS (SELECT f.dossier AS question_id, count(*) AS e, count(c.fact_id) AS r FROM facts f LEFT JOIN (SELECT DISTINCT question_id, fact_id FROM capsule) c ON c.question_id = f.dossier AND c.fact_id = f.fact_id GROUP BY 1)
SELECT question_id, e AS n_expected, r AS n_recalled, round(r / e::double, 6) AS coverage FROM per UNION ALL SELECT NULL, sum(e)::bigint, sum(r)::bigint, round(sum(r) / sum(e)::double, 6) FROM per""",
    "u8_leaks": "SELECT row_id FROM training_examples WHERE row_id % 4 = 0 AND target IS NOT NULL",
    "u7_fingerprint": "SELECT count(DISTINCT statement_id) AS n_rows, true AS digested FROM claims",
    "f25_status": """SELECT DISTINCT source_type, CASE source_type WHEN 'generated' THEN NULL WHEN 'inferred' THEN 'verified' WHEN 'user_confirmed' THEN 'confirmed' WHEN 'executed' THEN 'executed' WHEN 'observed' THEN 'observed' ELSE 'unverified' END AS status,
  CASE source_type WHEN 'generated' THEN NULL WHEN 'inferred' THEN 1.0 WHEN 'user_confirmed' THEN 1.0 WHEN 'executed' THEN 1.0 WHEN 'observed' THEN 0.9 ELSE 0.5 END::double AS confidence FROM memory_events""",
    "f39_comb_bits": "SELECT DISTINCT p_size * 7 AS n, p_size AS k, greatest(1, ceil((lgamma(p_size * 7 + 1) - lgamma(p_size + 1) - lgamma(p_size * 6 + 1)) / ln(2)))::integer AS bits FROM part",
    "f41_first_objects": "SELECT row_id, target ->> '$.answer' AS answer FROM training_examples",
    "f42_recalculated": """WITH o AS (SELECT o_orderkey, o_orderdate::date AS d, o_orderdate::date - (o_orderkey % 20000)::int AS b FROM orders),
s AS (SELECT o_orderkey, b, date_trunc('month', d)::date AS lo, last_day(d) AS hi FROM o),
a AS (SELECT o_orderkey, year(lo) - year(b) - (month(lo) * 100 + day(lo) < month(b) * 100 + day(b))::int AS x, year(hi) - year(b) - (month(hi) * 100 + day(hi) < month(b) * 100 + day(b))::int AS y FROM s)
SELECT o_orderkey, CASE WHEN x < 0 THEN NULL WHEN x = y THEN x::varchar ELSE x || '..' || y END AS result,
  CASE WHEN x < 0 THEN 'Donc le calcul donne 7 ans.' WHEN x = y THEN 'Donc le calcul donne ' || x || ' ans.' ELSE 'Donc le calcul donne entre ' || x || ' et ' || y || ' ans.' END AS answer FROM a""",
    "g7_baseline": "SELECT task, count(*) AS n, 0::bigint AS n_evidence, 0::bigint AS n_required FROM training_examples GROUP BY task",
    "f17_derived": f"WITH {_BASE} SELECT event_id, 'calc:' || event_id || ':' || kind AS id, kind, round(value, 6) AS value, unit, exact, dependencies FROM derived WHERE value IS NOT NULL",
    "d7_with_derived": f"WITH {_BASE} SELECT 'direct' AS origin, count(*) AS n, count(DISTINCT fact_id) AS n_ids FROM base UNION ALL SELECT 'derived', count(*), count(DISTINCT event_id || kind) FROM derived WHERE value IS NOT NULL",
    "proj15_derived_records": f"""WITH {_BASE}, r AS (SELECT *, 'calc:' || event_id || ':' || kind AS id FROM derived WHERE value IS NOT NULL)
SELECT id, 'derived:' || sha256(id)[1:16] AS marker, 'derived:' || event_id AS episode_id, 'inferred' AS source_type, dependencies FROM r QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY id) <= 3""",
    "g2_disturbed": """WITH b AS (SELECT 'evt-' || i AS fact_id, 1000 + i * 37 % 9973 AS object FROM range(1000) t(i)),
h AS (SELECT *, ('0x' || sha256('11:' || fact_id)[1:16])::ubigint AS x FROM b),
k AS (SELECT fact_id, object, 'base' AS kind FROM h UNION ALL SELECT fact_id || ':contradiction', object + 1, 'contradiction' FROM h WHERE x % 12 = 0 UNION ALL SELECT fact_id, object, 'duplicate' FROM h WHERE x % 40 = 1)
SELECT sha256('11:' || kind || ':' || fact_id)[1:16] AS arrival, fact_id, object, kind FROM k""",
    "proj19_models": "SELECT config_id, base_model, CASE WHEN regexp_matches(base_model, '(?i)embed') THEN 'embedding' WHEN regexp_matches(base_model, '(?i)local|base') THEN 'base' ELSE 'other' END AS kind FROM training_configs WHERE kind IN ('base', 'embedding') ORDER BY lower(base_model), config_id LIMIT 5",
    "s20_question_problems": """WITH q AS (SELECT row_id, example_id, messages[2].content AS question, len(evidence_ids) AS n, task = 'unsupported_abstention' AS u, count(*) OVER (PARTITION BY example_id) AS c FROM training_examples)
SELECT row_id AS key, rule FROM (SELECT row_id, unnest([CASE WHEN NOT coalesce(length(trim(example_id)) > 0, false) THEN 'id_given' END, CASE WHEN NOT coalesce(c = 1, false) THEN 'id_unique' END,
  CASE WHEN NOT coalesce(length(trim(question)) > 0, false) THEN 'question_given' END, CASE WHEN NOT coalesce(u OR n > 0, false) THEN 'answerable_has_fragments' END]) AS rule FROM q) WHERE rule IS NOT NULL""",
}
