"""Queries of the general data problems: nested records, intervals, references."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from loomspan.operators import intervals, nested, references
from loomspan.runtime import stage, table


def _docs(spark, d):
    return nested.memory_documents(partial(table, spark, d))


def p1_found(spark, d):
    return nested.array_objects(nested.inline(_docs(spark, d)))


def p1_schema_graph(spark, d):
    return nested.schema_graph(_docs(spark, d))


def p1_relations(spark, d):
    return nested.relations(nested.schema_graph(_docs(spark, d)))


def p1_tables(spark, d):
    return nested.inline(_docs(spark, d)).select("src_table", "src_field", "src_key", "relation", "node_path", "parent_relation", "parent_path", F.to_json("fields").alias("fields_json"))


def p1_links(spark, d):
    return nested.relation_links(nested.inline(_docs(spark, d)))


def p1_flat_sources(spark, d):
    rows = stage(nested.inline(_docs(spark, d).where("src_field = 'source_json'")))
    return nested.relation_table(rows, "memory_events", "source_json", "source_json")


def p1_columns(spark, d):
    return nested.relation_columns(nested.inline(_docs(spark, d)))


def p3_found(spark, d):
    return intervals.claim_spans(table(spark, d, "claims"))


def p4_found(spark, d):
    return references.dangling_references(partial(table, spark, d))


def p4_counts(spark, d):
    return references.dangling_counts(partial(table, spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_schema_graph, p1_relations, p1_tables, p1_links, p1_flat_sources, p1_columns, p3_found, p4_found, p4_counts)}

_TRIM = r"regexp_replace({0}, '^[\s\x{{00a0}}]+|[\s\x{{00a0}}]+$', '', 'g')"
_LIVING = """
living AS (
  SELECT t, k FROM (
    SELECT t, k, max(ts) AS ts, max(has) AS has, max(gone) AS gone FROM (
      SELECT 'memory_events' AS t, lower(trim(id)) AS k, created_at AS ts, 1 AS has, NULL::timestamp AS gone FROM episodes
      UNION ALL SELECT 'injection_test_run_jobs', lower(trim(id)), make_timestamp((enqueued_at * 1000000)::bigint), 1, NULL FROM injection_jobs
      UNION ALL SELECT 'claim_sources', lower(trim(statement_id)), created_at, 1, NULL FROM claims
      UNION ALL SELECT CASE target_table WHEN 'episodes' THEN 'memory_events' WHEN 'injection_jobs' THEN 'injection_test_run_jobs' ELSE 'claim_sources' END,
        lower(trim(target_key)), NULL, 0, forgotten_at FROM forgotten_keys
    ) GROUP BY t, k
  ) WHERE has = 1 AND (gone IS NULL OR gone < ts)
),
refs AS (
  SELECT 'memory_events' AS t, lower(trim(episode_id)) AS k, ingest_order::varchar AS child_key, strftime(created_at, '%Y-%m') AS period FROM memory_events
  UNION SELECT 'injection_test_run_jobs', lower(trim(job_id)), j.run_id || '#' || ordinal, strftime(make_timestamp((r.created_at * 1000000)::bigint), '%Y-%m')
    FROM injection_test_run_jobs j LEFT JOIN injection_test_runs r ON j.run_id = r.run_id
  UNION SELECT 'claim_sources', lower(trim(statement_id)), import_id || '#' || entry_name || '#' || line_number, dataset_release FROM claim_sources
),
marked AS (
  SELECT refs.*, living.k IS NULL AS orphan FROM refs LEFT JOIN living ON refs.t = living.t AND refs.k = living.k
  WHERE refs.k IS NOT NULL AND refs.k <> ''
)"""

_BOUND = """regexp_extract(trim({0}), '^(\\d{{4}})(-(\\d{{2}})(-(\\d{{2}})([Zz]|T.*)?)?)?$', ['y', 'm0', 'm', 'd0', 'd', 'z'])"""

#: Well-formed JSON: DuckDB also takes commas before a closing bracket and NaN, which RFC 8259 doesn't.
WELL_FORMED = r"""(json_valid({0}) AND NOT regexp_matches(regexp_replace({0}, '"([^"\\]|\\.)*"', '""', 'g'), ',\s*[}}\]]|NaN|nan|[Ii]nf'))"""


def _opened(x: str) -> str:
    held = f"json_extract_string({x}, '$')"
    return rf"CASE WHEN json_type({x}) = 'VARCHAR' AND regexp_matches({held}, '^[ \t\n\r]*[{{\[]') THEN CASE WHEN {WELL_FORMED.format(held)} THEN {held}::json ELSE {x} END ELSE {x} END"


ORACLES = {
    "p1_found": rf"""WITH RECURSIVE docs AS (
  SELECT 'memory_events' AS src_table, 'context_json' AS src_field, ingest_order AS src_key, context_json AS doc FROM memory_events
  UNION ALL SELECT 'memory_events', 'source_json', ingest_order, source_json FROM memory_events
  UNION ALL SELECT 'injection_jobs', 'context_json', sequence, context_json FROM injection_jobs
),
well AS (SELECT src_table, src_field, src_key, doc::json AS v FROM docs WHERE {WELL_FORMED.format('doc')}),
node AS (
  SELECT src_table, src_field, src_key, '$' AS path, '$' AS around, false AS element, {_opened('v')} AS v FROM well
  UNION ALL
  SELECT n.src_table, n.src_field, n.src_key,
    n.path || CASE WHEN json_type(n.v) = 'ARRAY' THEN '[' || e.key || ']' WHEN regexp_matches(e.key, '^[A-Za-z_][A-Za-z0-9_]*$') THEN '.' || e.key ELSE '[' || to_json(e.key) || ']' END,
    CASE WHEN n.element THEN n.path ELSE n.around END, json_type(n.v) = 'ARRAY' AND json_type({_opened('e.value')}) = 'OBJECT', {_opened('e.value')}
  FROM node n, json_each(n.v) e WHERE json_type(n.v) IN ('OBJECT', 'ARRAY')
)
SELECT src_table, src_field, src_key, path AS node_path, around AS parent_path FROM node WHERE element""",
    "p3_found": f"""
WITH raw AS (
  SELECT subject_value, predicate_iri, {_BOUND.format('temporal_start')} AS s, {_BOUND.format('temporal_end')} AS e,
    temporal_end IS NULL OR trim(temporal_end) = '' AS is_open
  FROM claims WHERE temporal_start IS NOT NULL
),
dated AS (
  SELECT subject_value, predicate_iri,
    CASE WHEN s.y <> '' THEN try_cast(s.y || '-' || CASE WHEN s.m = '' THEN '01' ELSE s.m END || '-' || CASE WHEN s.d = '' THEN '01' ELSE s.d END AS date) END AS lo,
    CASE WHEN is_open THEN DATE '10000-01-01'
      WHEN e.y = '' THEN NULL
      WHEN e.d <> '' THEN try_cast(e.y || '-' || e.m || '-' || e.d AS date)
      WHEN e.m <> '' THEN last_day(try_cast(e.y || '-' || e.m || '-01' AS date))
      ELSE try_cast(e.y || '-12-31' AS date) END AS hi
  FROM raw
),
spans AS (SELECT * FROM dated WHERE lo IS NOT NULL AND hi IS NOT NULL AND hi >= lo AND year(lo) BETWEEN 1 AND 9999),
flagged AS (
  SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY subject_value, predicate_iri ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh
  FROM spans
),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY subject_value, predicate_iri ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM flagged),
periods AS (SELECT subject_value, predicate_iri, island, min(lo) AS lo, max(hi) AS hi FROM numbered GROUP BY ALL),
chained AS (SELECT *, lead(lo) OVER (PARTITION BY subject_value, predicate_iri ORDER BY island) AS next_lo FROM periods)
SELECT subject_value, predicate_iri, 'period' AS span_kind, strftime(lo, '%Y-%m-%d') AS start_day,
  CASE WHEN hi >= DATE '10000-01-01' THEN 'open' ELSE strftime(hi, '%Y-%m-%d') END AS end_day FROM chained
UNION ALL
SELECT subject_value, predicate_iri, 'gap', strftime(hi + 1, '%Y-%m-%d'), strftime(next_lo - 1, '%Y-%m-%d') FROM chained WHERE next_lo IS NOT NULL
""",
    "p4_found": f"WITH {_LIVING} SELECT DISTINCT t AS child_table, child_key FROM marked WHERE orphan",
    "p4_counts": f"""WITH {_LIVING}
SELECT t AS child_table, period, count(*) AS n_references, count(*) FILTER (WHERE orphan) AS n_orphans,
  count(DISTINCT k) FILTER (WHERE orphan) AS n_orphan_keys FROM marked GROUP BY t, period""",
}
