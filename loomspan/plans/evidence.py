"""Queries of evidence rows, groups, summaries and generators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspan.functions import civil, mathx
from loomspan.operators import contracts, evidence, ranking, timeline
from loomspan.plans.facts import FACTS, _facts
from loomspan.runtime import table

ARMS = ["baseline", "memory", "specialised"]
TASKS = ["direct_recall_with_citations", "multi_hop_relation", "unsupported_abstention", "temporal_age", "role_disambiguation"]


def proj14_atomic_evidence(spark, d):
    return evidence.atomic_evidence(table(spark, d, "training_examples"), "row_id", "evidence_ids")


def proj13_sources(spark, d):
    return evidence.normalised_source(table(spark, d, "injection_jobs"))


def a14_by_digest(spark, d):
    out = evidence.by_digest(table(spark, d, "documents").where("title IS NOT NULL"), F.sha2("text", 256), "title", "n_chars")
    return out.withColumn("tags", F.array_join("tags", "|"))


def a15_dossiers(spark, d):
    return evidence.dossiers(table(spark, d, "documents"))


def a15_dossier_lines(spark, d):
    return evidence.dossier_lines(table(spark, d, "documents"))


def a26_history_tail(spark, d):
    runs = table(spark, d, "injection_test_runs").select("run_id", "state", "created_at")
    return evidence.history_tail(runs, [F.desc("created_at"), "run_id"], 20).select("run_id", "state", "n_all", "truncated")


def a28_catalog(spark, d):
    rows = spark.createDataFrame(sorted(mathx.CATALOG.items()), "name string, family string")
    return rows.groupBy("family").agg(F.count(F.lit(1)).alias("n"))


def a31_differential(spark, d):
    """The evaluator against Spark's own functions, for every order, by family."""
    i = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(mathx.workload_family(i).alias("family"), mathx.evaluate(mathx.workload(i)).alias("r"), mathx.workload_value(i).alias("own"))
    same = F.coalesce(mathx.agrees(F.col("r.approximation"), F.col("own")), F.lit(False))
    return rows.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum(same.cast("long")).alias("n_agreeing"))


def a32_arms(spark, d):
    rows = evidence.arms(table(spark, d, "training_examples").select("row_id", "task"), ARMS)
    return rows.groupBy("arm", "task").agg(F.count(F.lit(1)).alias("n"))


def a33_status(spark, d):
    return evidence.status(table(spark, d, "injection_jobs"))


def w8_rank_in_space(spark, d):
    rn = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return table(spark, d, "documents").select("source", "doc_id", "n_chars", (rn - 1).alias("rank")).where("rank < 5")


def j12_claim_labels(spark, d):
    claims = table(spark, d, "claims")
    names = claims.where("subject_label IS NOT NULL").groupBy("subject_value").agg(F.min("subject_label").alias("name"))
    rows = claims.select("statement_id", "subject_value", "predicate_label", "object_label").distinct()
    return rows.join(names, "subject_value", "left").select("statement_id", F.concat_ws(" ", F.coalesce("name", "subject_value"), "predicate_label", "object_label").alias("text"))


def j14_ages(spark, d):
    claims = table(spark, d, "claims").where("temporal_start IS NOT NULL").select(F.col("subject_value").alias("entity"), F.col("statement_id").alias("fact_id"), "predicate_iri", F.trim("temporal_start").alias("date")).distinct()
    born = claims.where("predicate_iri = 'urn:mem:rel/reside_a'").drop("predicate_iri")
    return evidence.ages(born, claims.where("predicate_iri <> 'urn:mem:rel/reside_a'").drop("predicate_iri"))


def u5_ground_truth(spark, d):
    """Facts, ambiguous instants and the latest state of each entity and predicate."""
    facts = _facts(spark, d)
    per = timeline.instants(facts).groupBy("entity", "predicate").agg(F.sum("n_facts").alias("n_facts"), F.sum((F.col("n_facts") > 1).cast("long")).alias("n_ambiguous"))
    latest = timeline.latest_state(facts).select("entity", "predicate", F.col("fact_id").alias("latest_id"))
    return per.join(latest, ["entity", "predicate"], "left").select("entity", "predicate", "n_facts", "n_ambiguous", "latest_id")


def f19_years(spark, d):
    y = F.when(F.col("n_nationkey") >= 12, F.col("n_nationkey") - 11).otherwise(F.col("n_nationkey") - 12)
    return table(spark, d, "nation").select("n_nationkey", y.alias("year"), civil.label(y).alias("label"), civil.shifted_year(y, F.lit(5)).alias("later"), civil.year_ordinal(y).alias("ordinal"))


def f33_model_kinds(spark, d):
    kind = F.when(F.col("base_model").rlike("(?i)embed"), "embedding").when(F.col("base_model").rlike("(?i)local|base"), "base").otherwise("other")
    return table(spark, d, "training_configs").select("config_id", kind.alias("kind"))


def f40_order_texts(spark, d):
    parts = F.map_from_arrays(F.array(F.lit("status"), F.lit("priority"), F.lit("client")), F.array("o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string")))
    context = F.array_join(F.transform(F.array_sort(F.map_entries(parts)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
    return table(spark, d, "orders").select("o_orderkey", F.concat_ws(". ", F.concat(F.lit("Order "), "o_orderkey"), context).alias("text"))


def f43_selection_digest(spark, d):
    chosen = ranking.stratified(table(spark, d, "training_examples"), "task", "row_id", 98, TASKS).select("row_id", "example_id")
    # at most 98 rows, by the quota
    return chosen.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_id", "example_id"))), lambda s: s["example_id"]), "\n"), 256).alias("digest"), F.count(F.lit(1)).alias("n"))


def f45_confidence_basis(spark, d):
    basis = F.to_json(F.struct(F.lit("statement_provenance").alias("kind"), F.col("confidence_level").alias("level"), F.lit(None).cast("double").alias("numeric_probability")), {"ignoreNullFields": "false"})
    return table(spark, d, "claims").select("statement_id", basis.alias("basis")).distinct()


def f48_forbidden_keys(spark, d):
    docs = table(spark, d, "injection_jobs").select(F.col("sequence").alias("key"), F.col("context_json").alias("doc"))
    return evidence.has_key(docs, {"session"}).groupBy("found").agg(F.count(F.lit(1)).alias("n"))


def g1_base_facts(spark, d):
    return evidence.base_facts(spark, 1000)


def s14_unknown_files(spark, d):
    configs, known = table(spark, d, "training_configs"), table(spark, d, "dataset_summaries")
    parts = [contracts.missing_keys(configs, c, known, "path").select(F.lit(c).alias("field"), "missing") for c in ("train_jsonl", "eval_jsonl")]
    return parts[0].unionByName(parts[1])


def d6_set_differences(spark, d):
    """Ids that a file's summary lists and its rows don't have, and the other way round, as counts."""
    rows = table(spark, d, "training_examples").select(F.col("jsonl_path").alias("path"), F.col("example_id").alias("id"), F.lit(1).alias("r"), F.lit(0).alias("s"))
    listed = table(spark, d, "dataset_summaries").select("path", F.explode("example_ids").alias("id"), F.lit(0).alias("r"), F.lit(1).alias("s"))
    per = rows.unionByName(listed).groupBy("path", "id").agg(F.max("r").alias("r"), F.max("s").alias("s"))
    return per.groupBy("path").agg(F.sum(F.col("r") * F.col("s")).alias("n_both"), F.sum(F.col("r") * (1 - F.col("s"))).alias("n_only_rows"), F.sum((1 - F.col("r")) * F.col("s")).alias("n_only_summary"))


def x1_registered_functions(spark, d):
    evidence.register_functions(spark)
    table(spark, d, "part").createOrReplaceTempView("loomspan_part")
    return spark.sql("SELECT p_partkey, evaluate_expression(concat(p_partkey, ' * 2 + ', p_size)).approximation AS twice, normalise_token(p_brand) AS brand FROM loomspan_part")


QUERIES = {f.__name__: f for f in (proj14_atomic_evidence, proj13_sources, a14_by_digest, a15_dossiers, a15_dossier_lines, a26_history_tail, a28_catalog, a31_differential, a32_arms, a33_status, w8_rank_in_space, j12_claim_labels, j14_ages, u5_ground_truth, f19_years, f33_model_kinds, f40_order_texts, f43_selection_digest, f45_confidence_basis, f48_forbidden_keys, g1_base_facts, s14_unknown_files, d6_set_differences, x1_registered_functions)}

_DATE = r"""CASE WHEN regexp_matches({0}, '^\d{{4}}$') THEN try_cast({0} || '-01-01' AS date) WHEN regexp_matches({0}, '^\d{{4}}-\d{{2}}$') THEN try_cast({0} || '-01' AS date) WHEN regexp_matches({0}, '^\d{{4}}-\d{{2}}-\d{{2}}$') THEN try_cast({0} AS date) END"""
_LAST = r"""CASE WHEN regexp_matches({0}, '^\d{{4}}$') THEN try_cast({0} || '-12-31' AS date) WHEN regexp_matches({0}, '^\d{{4}}-\d{{2}}$') THEN last_day(try_cast({0} || '-01' AS date)) WHEN regexp_matches({0}, '^\d{{4}}-\d{{2}}-\d{{2}}$') THEN try_cast({0} AS date) END"""
_JSON = "CASE WHEN json_valid({0}) THEN nullif(trim(json_extract_string({0}, '$.{1}')), '') END"

ORACLES = {
    "proj14_atomic_evidence": """SELECT row_id, unnest(evidence_ids) AS evidence, row_id * 1000 + unnest(range(len(evidence_ids))) AS position FROM training_examples WHERE len(evidence_ids) > 0
UNION ALL SELECT row_id, 'item-' || row_id, row_id * 1000 FROM training_examples WHERE evidence_ids IS NULL OR len(evidence_ids) = 0""",
    "proj13_sources": f"""SELECT sequence, coalesce(nullif(trim(idempotency_key), ''), {_JSON.format('source_json', 'idempotency_key')}, {_JSON.format('context_json', 'idempotency_key')}) AS key,
  coalesce({_JSON.format('source_json', 'type')}, 'user_confirmed') AS source_type FROM injection_jobs""",
    "a14_by_digest": """SELECT sha256(text) AS digest, array_to_string(list_sort(list_distinct(list(title))), '|') AS tags, arg_min(title, (length(title), title)) AS tag, max(n_chars) AS size, count(*) AS n FROM documents WHERE title IS NOT NULL GROUP BY sha256(text)""",
    "a15_dossiers": "SELECT dossier_id, count(*) AS n_documents, sum(n_chars)::bigint AS n_chars, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM documents WHERE dossier_id IS NOT NULL GROUP BY dossier_id",
    "a15_dossier_lines": "SELECT dossier_id, doc_id, row_number() OVER (PARTITION BY dossier_id ORDER BY doc_id) AS line FROM documents WHERE dossier_id IS NOT NULL",
    "a26_history_tail": "SELECT run_id, state, (SELECT count(*) FROM injection_test_runs) AS n_all, (SELECT count(*) > 20 FROM injection_test_runs) AS truncated FROM injection_test_runs ORDER BY created_at DESC, run_id LIMIT 20",
    "a28_catalog": "SELECT * FROM (VALUES ('arithmetic', 6), ('aggregate', 5), ('power', 7), ('trigonometry', 9), ('number', 5), ('statistics', 9)) AS t(family, n)",
    "a31_differential": """WITH t AS (SELECT o_orderkey AS i, 2 + (17 * o_orderkey) % 997 AS a, 2 + (31 * o_orderkey) % 499 AS b, 2 + (13 * o_orderkey) % 97 AS c FROM orders),
v AS (SELECT ['sum_product', 'gcd', 'comb', 'sqrt', 'mean', 'sin_cos', 'floor', 'isqrt', 'hypot', 'log2'][(i % 10 + 1)::int] AS family, CASE i % 10
  WHEN 0 THEN a + b * c WHEN 1 THEN gcd(a, b) WHEN 2 THEN factorial((c % 5)::int) WHEN 3 THEN sqrt(a) WHEN 4 THEN (a + b + c) / 3.0 WHEN 5 THEN sin(a) + cos(b) WHEN 6 THEN floor(a / b)
  WHEN 7 THEN floor(sqrt(a * b)) WHEN 8 THEN sqrt(a * a + b * b) ELSE log2(pow(2, c)) END AS value FROM t)
SELECT family, count(*) AS n, count(*) FILTER (WHERE isfinite(value::double)) AS n_agreeing FROM v GROUP BY family""",
    "a32_arms": "SELECT arm, task, count(*) AS n FROM (SELECT task, unnest(['baseline', 'memory', 'specialised']) AS arm FROM training_examples) GROUP BY ALL",
    "a33_status": "SELECT count(*) AS received, count(DISTINCT id) AS distinct_tickets, count(*) - count(DISTINCT id) AS repeated, round(100.0::double * (count(*) - count(DISTINCT id)) / count(*), 2) AS deduplication_percent FROM injection_jobs",
    "w8_rank_in_space": "SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1 AS rank FROM documents QUALIFY rank < 5",
    "j12_claim_labels": """WITH n AS (SELECT subject_value, min(subject_label) AS name FROM claims WHERE subject_label IS NOT NULL GROUP BY subject_value), r AS (SELECT DISTINCT statement_id, subject_value, predicate_label, object_label FROM claims)
SELECT statement_id, concat_ws(' ', coalesce(name, subject_value), predicate_label, object_label) AS text FROM r LEFT JOIN n USING (subject_value)""",
    "j14_ages": f"""WITH c AS (SELECT DISTINCT subject_value AS entity, statement_id AS fact_id, predicate_iri, trim(temporal_start) AS d FROM claims WHERE temporal_start IS NOT NULL),
b AS (SELECT entity, max(fact_id) AS birth_id, arg_max(d, fact_id) AS bd FROM c WHERE predicate_iri = 'urn:mem:rel/reside_a' GROUP BY entity),
p AS (SELECT c.entity, c.fact_id AS event_id, birth_id, {_DATE.format('bd')} AS b0, {_LAST.format('bd')} AS b1, {_DATE.format('d')} AS e0, {_LAST.format('d')} AS e1 FROM c JOIN b USING (entity) WHERE predicate_iri <> 'urn:mem:rel/reside_a'),
a AS (SELECT *, year(e0) - year(b1) - CASE WHEN month(e0) * 100 + day(e0) < month(b1) * 100 + day(b1) THEN 1 ELSE 0 END AS lo, year(e1) - year(b0) - CASE WHEN month(e1) * 100 + day(e1) < month(b0) * 100 + day(b0) THEN 1 ELSE 0 END AS hi FROM p)
SELECT entity, event_id, birth_id, CASE WHEN lo = hi THEN lo::varchar ELSE lo || '..' || hi END AS age FROM a WHERE lo >= 0 AND hi IS NOT NULL""",
    "u5_ground_truth": f"""WITH {FACTS}, per AS (SELECT entity, predicate, sum(n)::bigint AS n_facts, count(*) FILTER (WHERE n > 1) AS n_ambiguous FROM instants GROUP BY ALL),
last AS (SELECT * FROM instants QUALIFY row_number() OVER (PARTITION BY entity, predicate ORDER BY position DESC, precision DESC) = 1)
SELECT per.entity, per.predicate, n_facts, n_ambiguous, CASE WHEN last.n = 1 THEN last.one[1] END AS latest_id FROM per JOIN last ON per.entity = last.entity AND per.predicate = last.predicate""",
    "f19_years": """WITH y AS (SELECT n_nationkey, CASE WHEN n_nationkey >= 12 THEN n_nationkey - 11 ELSE n_nationkey - 12 END AS year FROM nation), o AS (SELECT *, CASE WHEN year > 0 THEN year ELSE year + 1 END AS ordinal FROM y)
SELECT n_nationkey, year, CASE WHEN year < 0 THEN (-year) || ' AEC' ELSE year || ' EC' END AS label, CASE WHEN ordinal + 5 > 0 THEN ordinal + 5 ELSE ordinal + 4 END AS later, ordinal FROM o""",
    "f33_model_kinds": "SELECT config_id, CASE WHEN regexp_matches(base_model, '(?i)embed') THEN 'embedding' WHEN regexp_matches(base_model, '(?i)local|base') THEN 'base' ELSE 'other' END AS kind FROM training_configs",
    "f40_order_texts": "SELECT o_orderkey, 'Order ' || o_orderkey || '. client=' || o_custkey || ', priority=' || o_orderpriority || ', status=' || o_orderstatus AS text FROM orders",
    "f43_selection_digest": """WITH s AS (SELECT row_id, example_id FROM training_examples QUALIFY row_number() OVER (PARTITION BY task ORDER BY row_id) <=
  CASE task WHEN 'direct_recall_with_citations' THEN 20 WHEN 'multi_hop_relation' THEN 20 WHEN 'unsupported_abstention' THEN 20 WHEN 'temporal_age' THEN 19 WHEN 'role_disambiguation' THEN 19 ELSE 0 END)
SELECT sha256(string_agg(example_id, chr(10) ORDER BY row_id)) AS digest, count(*) AS n FROM s""",
    "f45_confidence_basis": """SELECT DISTINCT statement_id, '{"kind":"statement_provenance","level":"' || confidence_level || '","numeric_probability":null}' AS basis FROM claims""",
    "f48_forbidden_keys": r"""SELECT regexp_matches(context_json, '(^|[^\\])"session"\s*:') AS found, count(*) AS n FROM injection_jobs WHERE json_valid(context_json) GROUP BY 1""",
    "g1_base_facts": """SELECT 'evt-' || i AS fact_id, 'Entite-' || (i % 8) AS entity, ['population', 'distance', 'temperature', 'duration'][i % 4 + 1] AS predicate,
  CASE WHEN -49 + i * 7 % 2000 > 0 THEN -49 + i * 7 % 2000 ELSE -50 + i * 7 % 2000 END AS year, 1000 + i * 37 % 9973 AS object, i % 12 + 1 AS month, i % 28 + 1 AS day FROM range(1000) t(i)""",
    "s14_unknown_files": """SELECT DISTINCT 'train_jsonl' AS field, train_jsonl AS missing FROM training_configs WHERE train_jsonl NOT IN (SELECT path FROM dataset_summaries)
UNION ALL SELECT DISTINCT 'eval_jsonl', eval_jsonl FROM training_configs WHERE eval_jsonl IS NOT NULL AND eval_jsonl NOT IN (SELECT path FROM dataset_summaries)""",
    "d6_set_differences": """WITH r AS (SELECT DISTINCT jsonl_path AS path, example_id AS id FROM training_examples), s AS (SELECT DISTINCT path, unnest(example_ids) AS id FROM dataset_summaries)
SELECT coalesce(r.path, s.path) AS path, count(*) FILTER (WHERE r.id IS NOT NULL AND s.id IS NOT NULL) AS n_both, count(*) FILTER (WHERE s.id IS NULL) AS n_only_rows, count(*) FILTER (WHERE r.id IS NULL) AS n_only_summary
FROM r FULL JOIN s ON r.path = s.path AND r.id = s.id GROUP BY 1""",
    "x1_registered_functions": "SELECT p_partkey, (p_partkey * 2 + p_size)::double AS twice, lower(p_brand) AS brand FROM part",
}
