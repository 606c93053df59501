"""Queries of claims, training records, scores, JSON and text functions, and writes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.operators import contracts, hub, memory, scoring, sinks
from loomspan.sources import jsonio, rdf
from loomspan.plans.quality import WELL_FORMED
from loomspan.runtime import shared_dir, table

LIMITS = [200, 400]


def a10_variants(spark, d):
    return rdf.variants(table(spark, d, "claims"))


def a29_totals(spark, d):
    claims, sources = table(spark, d, "claims"), table(spark, d, "claim_sources")
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
    parts = [one("claims", claims.select("statement_id").distinct()), one("entities", claims.select("subject_value").distinct()), one("relations", claims.select("predicate_iri").distinct()), one("claim_sources", sources.distinct()), one("imports", sources.select("import_id").distinct())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def w17_preferred_labels(spark, d):
    rows = table(spark, d, "claims").where("object_label IS NOT NULL")
    labels = rows.select(F.col("predicate_iri").alias("entity"), F.col("object_label").alias("label"), F.col("object_language").alias("language"), F.struct("created_at", "statement_id", "object_label").alias("seen"))
    return rdf.preferred_labels(labels)


def s12_components(spark, d):
    return table(spark, d, "claim_sources").groupBy(rdf.component(F.col("entry_name")).alias("component_of_name")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("entry_name").alias("n_entries"))


def p3_provenance_prefix(spark, d):
    basis = F.get_json_object("confidence_basis_json", "$.provenance_iri")
    return table(spark, d, "claims").where(basis.startswith("urn:mem:prov/")).groupBy(basis.alias("provenance")).agg(F.count(F.lit(1)).alias("n"))


def p4_confidence(spark, d):
    level = F.when(F.col("temporal_start").isNotNull() | F.col("temporal_end").isNotNull(), "temporal").otherwise("plain")
    return table(spark, d, "claims").groupBy(level.alias("kind"), "confidence_level").agg(F.count(F.lit(1)).alias("n"))


def p5_first_writer(spark, d):
    first = lambda c: F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.struct("created_at", c))).alias(c)
    return table(spark, d, "claims").groupBy("subject_value", "predicate_iri").agg(first("temporal_start"), first("temporal_end"))


def j10_claim_sources(spark, d):
    notes = table(spark, d, "claim_sources").distinct().groupBy("statement_id").agg(F.count(F.lit(1)).alias("n_sources"), F.min(F.struct("import_id", "entry_name", "line_number")).alias("first"))
    claims = table(spark, d, "claims").select("statement_id", "confidence_level").distinct()
    return claims.join(notes, "statement_id", "left").select("statement_id", "confidence_level", F.coalesce("n_sources", F.lit(0)).alias("n_sources"), F.col("first.entry_name").alias("entry_name"))


def f31_claim_text(spark, d):
    rows = table(spark, d, "claims").select("statement_id", "subject_value", "predicate_label", "object_label").distinct()
    return rows.select("statement_id", rdf.iri_label("subject_value").alias("subject"), F.concat_ws(" — ", "predicate_label", "object_label").alias("text"))


def j11_missing_keys(spark, d):
    """Episodes that tickets name and that aren't there."""
    return contracts.missing_keys(table(spark, d, "injection_jobs"), "episode_id", table(spark, d, "episodes"), "id")


def p8_training_violations(spark, d):
    return contracts.violations(table(spark, d, "training_examples"), "row_id", contracts.training_rules())


def s16_duplicate_examples(spark, d):
    rows = table(spark, d, "training_examples")
    return rows.groupBy("jsonl_path", "example_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("target").alias("n_targets")).where("n > 1")


def s17_lengths(spark, d):
    size = F.aggregate("messages", F.lit(0), lambda a, m: a + F.length(m["content"]))
    return contracts.lengths(table(spark, d, "training_examples"), size, "task", LIMITS)


def a23_task_counts(spark, d):
    return table(spark, d, "training_examples").groupBy("jsonl_path", "task").agg(F.count(F.lit(1)).alias("n"))


def a25_split_inventory(spark, d):
    return table(spark, d, "training_examples").groupBy("jsonl_path").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("example_id").alias("n_ids"), F.countDistinct("task").alias("n_tasks"), F.countDistinct("provenance_sha256").alias("n_provenances"))


def j19_shared_keys(spark, d):
    """Example ids and provenances that two files of different use share."""
    configs = table(spark, d, "training_configs")
    train, evals = configs.select(F.col("train_jsonl").alias("jsonl_path")).distinct(), configs.where("eval_jsonl IS NOT NULL").select(F.col("eval_jsonl").alias("jsonl_path")).distinct()
    rows = table(spark, d, "training_examples")
    out = None
    for name in ("example_id", "provenance_sha256"):
        keys = rows.where(F.col(name).isNotNull()).select("jsonl_path", F.col(name).alias("k"))
        both = keys.join(train, "jsonl_path", "left_semi").select("k").distinct().join(keys.join(evals, "jsonl_path", "left_semi").select("k").distinct(), "k", "left_semi")
        part = both.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("dimension"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def p0_summary_gaps(spark, d):
    """Files whose summary misses example ids that they hold."""
    rows = table(spark, d, "training_examples").select(F.col("jsonl_path").alias("path"), F.col("example_id").alias("id")).distinct()
    listed = table(spark, d, "dataset_summaries").select("path", F.explode("example_ids").alias("id")).distinct()
    return rows.join(listed, ["path", "id"], "left_anti").groupBy("path").agg(F.count(F.lit(1)).alias("n_missing"))


def a16_coverage(spark, d):
    rows = table(spark, d, "training_examples").groupBy("example_id").agg(F.min_by("evidence_ids", "row_id").alias("wanted"), F.max_by("evidence_ids", "row_id").alias("found"))
    out = scoring.coverage(rows, F.col("found"), F.col("wanted"))
    return out.select("example_id", "n_found", "n_wanted", F.round("coverage", 6).alias("coverage"))


def a18_rates(spark, d):
    grounding = F.get_json_object("target", "$.grounding")
    rows = table(spark, d, "training_examples").select("task", (grounding == "fully_supported").alias("supported"), (F.size("evidence_ids") > 0).alias("with_evidence"), F.col("provenance_sha256").isNotNull().alias("with_provenance"))
    return scoring.rates(rows, "task", ["supported", "with_evidence", "with_provenance"])


def a19_evidence_scores(spark, d):
    rows = table(spark, d, "training_examples").groupBy("example_id").agg(F.min_by("evidence_ids", "row_id").alias("target"), F.max_by("evidence_ids", "row_id").alias("predicted"))
    return rows.select("example_id", scoring.evidence_scores(F.col("predicted"), F.col("target"), F.col("target")).alias("s")).select("example_id", "s.*")


def a20_arms(spark, d):
    rows = table(spark, d, "training_examples").select(F.when(F.size("evidence_ids") > 0, "memory").otherwise("baseline").alias("arm"), (F.get_json_object("target", "$.grounding") == "fully_supported").alias("ok"))
    out = scoring.arms_delta(rows, "arm", "baseline", "memory", "ok")
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


def f27_anchors(spark, d):
    return table(spark, d, "memory_events").select("ingest_order", F.array_join(F.array_sort(scoring.anchors(F.col("text"))), ",").alias("anchors")).where("anchors <> ''")


def f28_fragments(spark, d):
    answer = F.element_at("messages", -1)["content"]
    s = scoring.fragment_scores(answer, F.array(F.lit("le"), F.lit("la")), F.array(F.lit("rouge")), F.col("task") != "unsupported_abstention")
    return table(spark, d, "training_examples").select("row_id", s.alias("s")).select("row_id", "s.*")


def j18_leaks(spark, d):
    names = table(spark, d, "concepts").select(F.explode(F.split("label", " ")).alias("token"))
    return contracts.leaks(table(spark, d, "documents"), "text", names)


def g6_capped_tasks(spark, d):
    return contracts.capped(table(spark, d, "training_examples"), "task", ["row_id"], 25).select("task", "row_id")


def g4_synthetic_worlds(spark, d):
    return contracts.synthetic_worlds(spark, 2000, 7).drop("id")


def s3_event_props(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, d, "events").select("event_id", k.alias("k"), F.try_parse_json("props").isNotNull().alias("well_formed"))


def s4_json_facts(spark, d):
    return jsonio.json_facts(table(spark, d, "injection_jobs").select(F.col("sequence").alias("key"), F.col("context_json").alias("doc")))


def s4_json_problems(spark, d):
    return jsonio.json_problems(table(spark, d, "injection_jobs").select(F.col("sequence").alias("key"), F.col("context_json").alias("doc")))


def s5_categories(spark, d):
    return jsonio.category_summary(s4_json_facts(spark, d))


def s7_filenames(spark, d):
    name = F.concat_ws("/", "import_id", "dataset_name", "entry_name")
    return table(spark, d, "claim_sources").select("import_id", jsonio.clean_filename(name).alias("file"), jsonio.import_id(F.col("lineage_id"), F.col("entry_name")).alias("plan_id")).distinct()


def f4_slugs(spark, d):
    return table(spark, d, "concepts").select("id", T.slug(F.lower("canonical_key"), "concept").alias("slug"))


def f5_clean_titles(spark, d):
    return table(spark, d, "documents").select("doc_id", T.ellipsis(T.clean(F.col("text")), 40).alias("head"), (F.length(T.clean(F.col("text"))) > 40).alias("shortened"))


def f6_signatures(spark, d):
    return table(spark, d, "memory_events").select("ingest_order", T.context_signature("context_json").alias("signature"))


def f9_recency(spark, d):
    return table(spark, d, "episodes").select("id", F.round(memory.recency(F.col("updated_at"), "2026-01-01 00:00:00"), 6).alias("recency"))


def f12_context_match(spark, d):
    wanted = memory.wanted_context({"space": "cours", "lang": "fr"})
    return table(spark, d, "episodes").select("id", F.round(memory.context_match(T.json_entries(F.col("context_json")), wanted), 6).alias("context_match"))


def s8_ntriples_round_trip(spark, d):
    """The claims between IRIs written as N-Triples and read back, with a broken line in between."""
    iri = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    claims = table(spark, d, "claims").where("object_kind = 'iri' AND subject_kind = 'iri'").select("subject_value", "predicate_iri", "object_value").distinct()
    lines = claims.select(F.explode(F.array(F.concat_ws(" ", iri("subject_value"), iri("predicate_iri"), iri("object_value"), F.lit(".")), F.lit("<broken> no triple ."))).alias("value"))
    path = f"{shared_dir(spark)}/loomspan-{uuid.uuid4().hex}.nt"
    lines.write.text(path)
    rows = rdf.ntriples(spark, path)
    return rows.where("error IS NULL").select("subject_value", "predicate_iri", "object_value")


def f29_json_objects(spark, d):
    fenced = F.concat(F.lit("Here it is:\n```json\n"), F.col("target"), F.lit("\n```\n"))
    found = table(spark, d, "training_examples").select("row_id", T.json_object(fenced).alias("o"))
    return found.select("row_id", F.get_json_object("o", "$.answer").alias("answer"), F.get_json_object("o", "$.grounding").alias("grounding"))


def f22_ids(spark, d):
    return table(spark, d, "concepts").select("id", T.hashed_id("ev:", F.col("canonical_key"), 20).alias("evidence_id"), T.hash_number(F.col("canonical_key"), 997).alias("number"))


def f24_overlap(spark, d):
    stop = ["le", "la", "de", "the", "of", "que"]
    q, t = T.concept_keys(F.col("title")), T.concept_keys(F.col("text"))
    return table(spark, d, "documents").where("title IS NOT NULL").select("doc_id", hub.lexical_overlap(q, t, stop).alias("overlap"))


# The intents of a message by how it begins, in order of precedence.
INTENTS = {
    "calculate": r"(?i)^\s*(?:calcule|calculer|combien\s+font)\s+",
    "observe": r"(?i)^\s*(?:souviens[\s-]*toi|m[ée]morise)\s+que\s+",
    "know": r"(?i)^\s*que\s+sais[\s-]*tu",
    "remind": r"(?i)^\s*rappelle[\s-]*moi",
    "forget": r"(?i)^\s*oublie\s+",
}


def f34_intents(spark, d):
    intent = F.lit("free")
    for name, pattern in reversed(INTENTS.items()):
        intent = F.when(F.col("text").rlike(pattern), name).otherwise(intent)
    return table(spark, d, "memory_events").groupBy(intent.alias("intent")).agg(F.count(F.lit(1)).alias("n"))


def p21_hub_keys(spark, d):
    return table(spark, d, "injection_jobs").select("sequence", hub.namespaced_key(F.lit("agent"), F.lit("space"), F.col("idempotency_key")).alias("key"))


def p7_previews(spark, d):
    return table(spark, d, "memory_events").select("ingest_order", T.ellipsis(F.col("text"), 60).alias("preview"))


def k2_upsert_ignore(spark, d):
    jobs = table(spark, d, "injection_jobs").select("sequence", "id", "state")
    first = jobs.groupBy("id").agg(F.min("sequence").alias("sequence")).join(jobs, ["id", "sequence"]).select("sequence", "id", "state").where("state = 'completed'")
    rest = jobs.groupBy("id").agg(F.max("sequence").alias("sequence")).join(jobs, ["id", "sequence"]).select("sequence", "id", "state")
    return sinks.upsert_ignore(first, rest, ["id"])


def k3_upsert_update(spark, d):
    jobs = table(spark, d, "injection_jobs").select("id", "sequence", "state", "attempts")
    return sinks.upsert_update(jobs.where("attempts = 0"), jobs.where("attempts > 0"), ["id"], "sequence")


def k6_json_lines(spark, d):
    return sinks.json_lines(table(spark, d, "nation"))


def k5_page(spark, d):
    return sinks.pages(table(spark, d, "orders"), "o_orderkey", 1000, 250).select("o_orderkey", "o_orderstatus")


def t12_windows(spark, d):
    ts = F.col("ts").cast("timestamp")
    return table(spark, d, "events").groupBy(F.window(ts, "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def a2_sessions(spark, d):
    """Sessions of a user's events that end after half an hour without any."""
    s = F.session_window(F.col("ts").cast("timestamp"), "30 minutes")
    return table(spark, d, "events").groupBy(s.alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").cast("timestamp_ntz").alias("start"), "n")


QUERIES = {f.__name__: f for f in (a10_variants, a29_totals, w17_preferred_labels, s12_components, p3_provenance_prefix, p4_confidence, p5_first_writer, j10_claim_sources, f31_claim_text, j11_missing_keys, p8_training_violations, s16_duplicate_examples, s17_lengths, a23_task_counts, a25_split_inventory, j19_shared_keys, p0_summary_gaps, a16_coverage, a18_rates, a19_evidence_scores, a20_arms, f27_anchors, f28_fragments, j18_leaks, g6_capped_tasks, g4_synthetic_worlds, s3_event_props, s4_json_facts, s4_json_problems, s5_categories, s7_filenames, f4_slugs, f5_clean_titles, f6_signatures, f9_recency, f12_context_match, s8_ntriples_round_trip, f29_json_objects, f22_ids, f24_overlap, f34_intents, p21_hub_keys, p7_previews, k2_upsert_ignore, k3_upsert_update, k6_json_lines, k5_page, t12_windows, a2_sessions)}
# pN_ names belong to the problems of TESTDATA.md; predicates and projections of the inventory are registered as projN_
QUERIES = {f"proj{name[1:]}" if name.startswith("p") else name: f for name, f in QUERIES.items()}

_FIRST_LAST = "pair AS (SELECT example_id, arg_min(evidence_ids, row_id) AS wanted, arg_max(evidence_ids, row_id) AS found FROM training_examples GROUP BY example_id)"
_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_FOLD_SLUG = "regexp_replace(regexp_replace(translate(lower(canonical_key), '" + T.FOLD_FROM + "', '" + T.FOLD_TO + "'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_CLEAN = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"

ORACLES = {
    "a10_variants": "SELECT subject_value, predicate_iri, count(DISTINCT (object_kind, object_value, coalesce(object_datatype, ''), coalesce(object_language, ''))) AS n_objects FROM claims GROUP BY ALL HAVING n_objects > 1",
    "a29_totals": """SELECT 'claims' AS name, count(DISTINCT statement_id) AS n FROM claims UNION ALL SELECT 'entities', count(DISTINCT subject_value) FROM claims UNION ALL SELECT 'relations', count(DISTINCT predicate_iri) FROM claims
UNION ALL SELECT 'claim_sources', count(*) FROM (SELECT DISTINCT * FROM claim_sources) UNION ALL SELECT 'imports', count(DISTINCT import_id) FROM claim_sources""",
    "w17_preferred_labels": """SELECT predicate_iri AS entity, object_label AS label FROM claims WHERE object_label IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY predicate_iri ORDER BY CASE object_language WHEN 'fr' THEN 0 WHEN 'en' THEN 1 ELSE 2 END, created_at, statement_id, object_label) = 1""",
    "s12_components": """SELECT CASE WHEN lower(entry_name) LIKE '%meta%' OR lower(entry_name) LIKE '%.ntx' THEN 'meta' WHEN lower(entry_name) LIKE '%schema%' OR lower(entry_name) LIKE '%shape%' THEN 'schema'
  WHEN lower(entry_name) LIKE '%taxonom%' OR lower(entry_name) LIKE '%type%' THEN 'taxonomy' WHEN lower(entry_name) LIKE '%beyond%' THEN 'facts_beyond_wikipedia' ELSE 'facts' END AS component_of_name,
  count(*) AS n, count(DISTINCT entry_name) AS n_entries FROM claim_sources GROUP BY 1""",
    "proj3_provenance_prefix": "SELECT json_extract_string(confidence_basis_json, '$.provenance_iri') AS provenance, count(*) AS n FROM claims WHERE starts_with(json_extract_string(confidence_basis_json, '$.provenance_iri'), 'urn:mem:prov/') GROUP BY 1",
    "proj4_confidence": "SELECT CASE WHEN temporal_start IS NOT NULL OR temporal_end IS NOT NULL THEN 'temporal' ELSE 'plain' END AS kind, confidence_level, count(*) AS n FROM claims GROUP BY ALL",
    "proj5_first_writer": """SELECT subject_value, predicate_iri, arg_min(temporal_start, (created_at, temporal_start)) FILTER (WHERE temporal_start IS NOT NULL) AS temporal_start,
  arg_min(temporal_end, (created_at, temporal_end)) FILTER (WHERE temporal_end IS NOT NULL) AS temporal_end FROM claims GROUP BY ALL""",
    "j10_claim_sources": """WITH n AS (SELECT statement_id, count(*) AS n_sources, min((import_id, entry_name, line_number))[2] AS entry_name FROM (SELECT DISTINCT * FROM claim_sources) GROUP BY statement_id),
c AS (SELECT DISTINCT statement_id, confidence_level FROM claims)
SELECT statement_id, confidence_level, coalesce(n_sources, 0) AS n_sources, entry_name FROM c LEFT JOIN n USING (statement_id)""",
    "f31_claim_text": "SELECT DISTINCT statement_id, replace(regexp_replace(subject_value, '^.*/', ''), '_', ' ') AS subject, concat_ws(' — ', predicate_label, object_label) AS text FROM claims",
    "j11_missing_keys": "SELECT DISTINCT episode_id AS missing FROM injection_jobs WHERE episode_id IS NOT NULL AND episode_id NOT IN (SELECT id FROM episodes)",
    "proj8_training_violations": """WITH r AS (SELECT row_id AS key, example_id, provenance_sha256 AS prov, list_transform(messages, lambda m: m.role) AS roles, messages[-1].content AS last, target, len(list_filter(messages, lambda m: trim(m.content) = '')) AS empty FROM training_examples)
SELECT key, 'id_given' AS rule FROM r WHERE coalesce(trim(example_id), '') = '' UNION ALL SELECT key, 'starts_with_system' FROM r WHERE roles[1] IS DISTINCT FROM 'system' UNION ALL SELECT key, 'ends_with_assistant' FROM r WHERE roles[-1] IS DISTINCT FROM 'assistant'
UNION ALL SELECT key, 'provenance_given' FROM r WHERE coalesce(trim(prov), '') = '' UNION ALL SELECT key, 'no_empty_message' FROM r WHERE empty > 0 UNION ALL SELECT key, 'target_is_json' FROM r WHERE target IS NULL OR NOT json_valid(target)
UNION ALL SELECT key, 'target_holds_answer' FROM r WHERE coalesce(CASE WHEN json_valid(target) THEN json_extract_string(target, '$.answer') END, '') IS DISTINCT FROM last""",
    "s16_duplicate_examples": "SELECT jsonl_path, example_id, count(*) AS n, count(DISTINCT target) AS n_targets FROM training_examples GROUP BY ALL HAVING n > 1",
    "s17_lengths": f"""WITH s AS (SELECT task, list_sum(list_transform(messages, lambda m: length(m.content)))::integer AS n FROM training_examples), r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY n) AS rn, count(*) OVER (PARTITION BY task) AS t FROM s)
SELECT task, count(*) AS n_rows, max(n) AS largest, max(n) FILTER (WHERE rn = floor(0.95 * (t - 1)) + 1) AS p95, count(*) FILTER (WHERE n > {LIMITS[0]}) AS over_{LIMITS[0]}, count(*) FILTER (WHERE n > {LIMITS[1]}) AS over_{LIMITS[1]} FROM r GROUP BY task""",
    "a23_task_counts": "SELECT jsonl_path, task, count(*) AS n FROM training_examples GROUP BY ALL",
    "a25_split_inventory": "SELECT jsonl_path, count(*) AS n_rows, count(DISTINCT example_id) AS n_ids, count(DISTINCT task) AS n_tasks, count(DISTINCT provenance_sha256) AS n_provenances FROM training_examples GROUP BY jsonl_path",
    "j19_shared_keys": """WITH tr AS (SELECT * FROM training_examples WHERE jsonl_path IN (SELECT train_jsonl FROM training_configs)), ev AS (SELECT * FROM training_examples WHERE jsonl_path IN (SELECT eval_jsonl FROM training_configs WHERE eval_jsonl IS NOT NULL))
SELECT 'example_id' AS dimension, count(DISTINCT example_id) AS n FROM tr WHERE example_id IN (SELECT example_id FROM ev) UNION ALL SELECT 'provenance_sha256', count(DISTINCT provenance_sha256) FROM tr WHERE provenance_sha256 IN (SELECT provenance_sha256 FROM ev WHERE provenance_sha256 IS NOT NULL)""",
    "proj0_summary_gaps": """WITH r AS (SELECT DISTINCT jsonl_path AS path, example_id AS id FROM training_examples), l AS (SELECT DISTINCT path, unnest(example_ids) AS id FROM dataset_summaries)
SELECT path, count(*) AS n_missing FROM r ANTI JOIN l USING (path, id) GROUP BY path""",
    "a16_coverage": f"WITH {_FIRST_LAST} SELECT example_id, len(list_intersect(found, wanted))::integer AS n_found, len(wanted)::integer AS n_wanted, CASE WHEN len(wanted) = 0 THEN 1.0 ELSE round(len(list_intersect(found, wanted)) / len(wanted)::double, 6) END AS coverage FROM pair",
    "a18_rates": """WITH r AS (SELECT task, (json_extract_string(target, '$.grounding') = 'fully_supported')::integer AS s, (len(evidence_ids) > 0)::integer AS e, (provenance_sha256 IS NOT NULL)::integer AS p FROM training_examples)
SELECT task, count(*) AS n, sum(s)::bigint AS supported, sum(e)::bigint AS with_evidence, sum(p)::bigint AS with_provenance, grouping(task)::integer AS overall, round(sum(s) / count(*), 6) AS supported_rate, round(sum(e) / count(*), 6) AS with_evidence_rate, round(sum(p) / count(*), 6) AS with_provenance_rate
FROM r GROUP BY ROLLUP (task)""",
    "a19_evidence_scores": f"""WITH {_FIRST_LAST}, m AS (SELECT example_id, found, wanted, len(list_intersect(found, wanted)) AS shared, len(list_distinct(found)) = len(found) AS valid,
  CASE WHEN len(found) > 0 THEN len(list_intersect(found, wanted)) / len(found)::double ELSE (len(wanted) = 0)::integer::double END AS p, CASE WHEN len(wanted) > 0 THEN len(list_intersect(found, wanted)) / len(wanted)::double ELSE (len(found) = 0)::integer::double END AS r FROM pair)
SELECT example_id, CASE WHEN valid THEN round(p, 6) END AS precision, CASE WHEN valid THEN round(r, 6) END AS recall, CASE WHEN valid THEN round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) END AS f1,
  CASE WHEN valid THEN len(list_filter(found, lambda x: NOT list_contains(wanted, x)))::integer END AS invented, CASE WHEN valid THEN found = wanted END AS exact FROM m""",
    "a20_arms": """WITH r AS (SELECT len(evidence_ids) > 0 AS m, (json_extract_string(target, '$.grounding') = 'fully_supported')::integer::double AS ok FROM training_examples)
SELECT round(avg(ok) FILTER (WHERE NOT m), 6) AS baseline, round(avg(ok) FILTER (WHERE m), 6) AS memory, round(avg(ok) FILTER (WHERE m) - avg(ok) FILTER (WHERE NOT m), 6) AS delta FROM r""",
    "f28_fragments": r"""WITH a AS (SELECT row_id, trim(regexp_replace(lower(messages[-1].content), '\s+', ' ', 'g')) AS t, task <> 'unsupported_abstention' AS answerable FROM training_examples),
f AS (SELECT row_id, answerable, contains(t, 'le') AND contains(t, 'la') AS all_found, contains(t, 'rouge') AS wrong,
  contains(t, 'je ne sais pas') OR contains(t, 'information insuffisante') OR contains(t, 'i don''t know') OR contains(t, 'cannot determine') OR contains(t, 'je_ne_sais_pas') AS abstained FROM a)
SELECT row_id, CASE WHEN answerable THEN all_found AND NOT wrong AND NOT abstained ELSE abstained AND NOT wrong END AS correct, abstained, CASE WHEN answerable THEN wrong ELSE NOT abstained OR wrong END AS hallucinated FROM f""",
    "j18_leaks": """WITH t AS (SELECT DISTINCT lower(unnest(string_split(label, ' '))) AS token FROM concepts), d AS (SELECT lower(text) AS text FROM documents)
SELECT token, count(*) AS n_texts FROM t JOIN d ON contains(d.text, t.token) WHERE length(trim(token)) >= 4 GROUP BY token""",
    "g6_capped_tasks": "SELECT task, row_id FROM training_examples QUALIFY row_number() OVER (PARTITION BY task ORDER BY row_id) <= 25",
    "g4_synthetic_worlds": """WITH w AS (SELECT i, 'world:7:' || i AS world FROM range(2000) t(i))
SELECT 'ex-' || sha256(world)[1:20] AS example_id, ['direct_recall', 'multi_hop', 'temporal_age', 'role', 'causal', 'abstention', 'contradiction', 'correction', 'calculation'][i % 9 + 1] AS task, 'SYN-' || upper(sha256(world || ':name')[1:8]) AS entity,
  1900 + (('0x' || sha256(world || ':year')[1:16])::ubigint % 120)::bigint AS year, 'code-fictif-' || (('0x' || sha256(world || ':code')[1:16])::ubigint % 10000) AS value FROM w""",
    "s3_event_props": "SELECT event_id, try_cast(CASE WHEN json_valid(props) THEN json_extract_string(props, '$.k') END AS bigint) AS k, json_valid(props) AS well_formed FROM events",
    "s7_filenames": "SELECT DISTINCT import_id, entry_name AS file, 'json-v1-' || lineage_id || '-' || sha256(entry_name)[1:12] AS plan_id FROM claim_sources",
    "f4_slugs": f"""WITH s AS (SELECT id, lower(canonical_key) AS k, {_FOLD_SLUG} AS base FROM concepts)
SELECT id, CASE WHEN base = '' THEN 'concept-' || sha256(k)[1:8] WHEN length(base) > 48 THEN regexp_replace(base[1:39], '-+$', '') || '-' || sha256(k)[1:8] ELSE base END AS slug FROM s""",
    "f5_clean_titles": f"SELECT doc_id, CASE WHEN length({_CLEAN}) > 40 THEN {_CLEAN}[1:39] || '…' ELSE {_CLEAN} END AS head, length({_CLEAN}) > 40 AS shortened FROM documents",
    "f9_recency": "SELECT id, round(1.0 / (1.0 + greatest(epoch(TIMESTAMP '2026-01-01') - epoch(updated_at), 0) / 86400.0 / 30.0), 6) AS recency FROM episodes",
    "f12_context_match": f"""WITH e AS (SELECT id, context_json, {WELL_FORMED.format('context_json')} AND json_type(context_json) = 'OBJECT' AS good FROM episodes),
m AS (SELECT id, CASE WHEN good THEN len(json_keys(context_json)) ELSE 0 END AS n, CASE WHEN good THEN coalesce(json_extract(context_json, '$.space')::varchar = '"cours"', false)::int + coalesce(json_extract(context_json, '$.lang')::varchar = '"fr"', false)::int ELSE 0 END AS shared FROM e)
SELECT id, CASE WHEN n = 0 THEN 0.25 ELSE round(shared / (n + 2 - shared)::double, 6) END AS context_match FROM m""",
    "s8_ntriples_round_trip": "SELECT DISTINCT subject_value, predicate_iri, object_value FROM claims WHERE object_kind = 'iri' AND subject_kind = 'iri'",
    "f29_json_objects": "SELECT row_id, target ->> '$.answer' AS answer, target ->> '$.grounding' AS grounding FROM training_examples",
    "f22_ids": "SELECT id, 'ev:' || sha256(canonical_key)[1:20] AS evidence_id, (('0x' || sha256(canonical_key)[1:16])::ubigint % 997)::bigint AS number FROM concepts",
    "f24_overlap": f"""WITH d AS (SELECT doc_id, {T.SQL_TOKENS.format('title')} AS q, {T.SQL_TOKENS.format('text')} AS t FROM documents WHERE title IS NOT NULL)
SELECT doc_id, len(list_filter(list_intersect(list_distinct(q), list_distinct(t)), lambda x: length(x) > 1 AND x NOT IN ('le', 'la', 'de', 'the', 'of', 'que')))::integer AS overlap FROM d""",
    "f34_intents": "SELECT CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in INTENTS.items()) + " ELSE 'free' END AS intent, count(*) AS n FROM memory_events GROUP BY 1",
    "proj21_hub_keys": "SELECT sequence, 'memory-hub:' || sha256(concat_ws(chr(0), 'agent', 'space', idempotency_key)) AS key FROM injection_jobs",
    "proj7_previews": "SELECT ingest_order, CASE WHEN length(text) > 60 THEN text[1:59] || '…' ELSE text END AS preview FROM memory_events",
    "k2_upsert_ignore": """WITH f AS (SELECT sequence, id, state FROM injection_jobs QUALIFY row_number() OVER (PARTITION BY id ORDER BY sequence) = 1), l AS (SELECT sequence, id, state FROM injection_jobs QUALIFY row_number() OVER (PARTITION BY id ORDER BY sequence DESC) = 1)
SELECT * FROM f WHERE state = 'completed' UNION ALL SELECT * FROM l WHERE id NOT IN (SELECT id FROM f WHERE state = 'completed')""",
    "k3_upsert_update": "SELECT id, sequence, state, attempts FROM injection_jobs QUALIFY row_number() OVER (PARTITION BY id ORDER BY sequence DESC) = 1",
    "k6_json_lines": """SELECT '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS value FROM nation""",
    "k5_page": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 250",
    "t12_windows": "SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    "a2_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, session""",
}
