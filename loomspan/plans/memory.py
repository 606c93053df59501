"""Queries of the event memory over memory_events."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions.text import SQL_TOKENS, concept_keys
from loomspan.operators import memory
from loomspan.runtime import stage, table

AS_OF = "2026-01-01 00:00:00"
HISTORY = ["la", "carte"]
QUERY_TEXT = "Température du capteur rouge introuvable"
QUERY = ["temperature", "du", "capteur", "rouge", "introuvable"]
FORGOTTEN, TAUGHT = "generated", "executed"


CONTEXT = {"space": "cours", "lang": "fr"}


def _log(spark, d):
    return memory.event_log(table(spark, d, "memory_events"))


def _staged(spark, d):
    """The log without redeliveries, tokenised once."""
    return stage(_log(spark, d))


def predict_next(spark, d):
    history, context = memory.prepared_query({"history": HISTORY, "context": CONTEXT})
    return memory.predict(memory.evidence_spans(_staged(spark, d), history[-1]), history, 10, AS_OF, context)


def f1_event_tokens(spark, d):
    log = _log(spark, d)
    return log.select("ingest_order", F.size("tokens").alias("n_tokens"), F.size(F.array_distinct("tokens")).alias("n_distinct"), F.col("tokens")[0].alias("first_token"))


def f2_document_concepts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.explode(concept_keys(F.col("text"))).alias("token"))
    per = docs.groupBy("token", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("token").agg(F.sum("n").alias("n_occurrences"), F.count(F.lit(1)).alias("n_documents"))


def a7_stats(spark, d):
    return memory.stats(_staged(spark, d))


def d2_key_conflicts(spark, d):
    return memory.key_conflicts(table(spark, d, "memory_events"))


def w1_segments(spark, d):
    log = memory.with_history(_staged(spark, d))
    return log.where("trusted").groupBy("episode").agg(F.count(F.lit(1)).alias("n_events"), F.sum((F.size("carry") == 0).cast("long")).alias("n_segments"))


def w2_evidence_spans(spark, d):
    spans = memory.evidence_spans(_staged(spark, d))
    return spans.groupBy("episode", "length").agg(F.count(F.lit(1)).alias("n_spans"), F.min("ingest_order").alias("first_order"), F.max("ingest_order").alias("last_order"))


def a1_continuations(spark, d):
    return memory.continuations(memory.evidence_spans(_staged(spark, d))).drop("decayed_support")


def a2_decayed_support(spark, d):
    out = memory.decayed_support(memory.evidence_spans(_staged(spark, d)), AS_OF, 30.0)
    return out.withColumn("decayed_support", F.round("decayed_support", 4))


def w5_lineage(spark, d):
    spans = memory.evidence_spans(_staged(spark, d))
    return memory.lineage(spans, "la", "mesure").select("id", "episode", "ingest_order", "ordinal", "length", "created_at")


def w6_paths(spark, d):
    return memory.token_paths(_log(spark, d))


def recall_ranked(spark, d):
    query, context = memory.prepared_query({"text": QUERY_TEXT, "context": CONTEXT})
    return memory.recall(_staged(spark, d), query, 10, AS_OF, context).drop("text")


def recall_newest(spark, d):
    return memory.recall(_log(spark, d), [], 10, AS_OF)


def u1_forget_continuations(spark, d):
    log = _staged(spark, d)
    kept = memory.forget(log, log.where(F.col("source_type") == FORGOTTEN))
    return kept.groupBy("episode").agg(F.count(F.lit(1)).alias("n_events"), F.min("ingest_order").alias("first_order"), F.sum(F.size("tokens")).alias("n_tokens"))


def u1_rebuilt_continuations(spark, d):
    """What the memory has learnt after a deletion: nothing bridges a hole."""
    log = _staged(spark, d)
    kept = stage(memory.forget(log, log.where(F.col("source_type") == TAUGHT)))
    return memory.continuations(memory.evidence_spans(kept)).groupBy("length", "pattern", "next_token").agg(F.sum("support").alias("support"))


def a11_episode_bounds(spark, d):
    return _log(spark, d).groupBy("episode").agg(F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), F.count(F.lit(1)).alias("n_events"), F.sum(F.col("trusted").cast("long")).alias("n_trusted"))


QUERIES = {f.__name__: f for f in (predict_next, f1_event_tokens, f2_document_concepts, a7_stats, d2_key_conflicts, w1_segments, w2_evidence_spans, a1_continuations, a2_decayed_support, w5_lineage, w6_paths, recall_ranked, recall_newest, u1_forget_continuations, u1_rebuilt_continuations, a11_episode_bounds)}

_TOKENS = SQL_TOKENS.format("text")
EVENTS = f"""
numbered_rows AS (
  SELECT *, row_number() OVER (PARTITION BY coalesce(nullif(trim(idempotency_key), ''), id) ORDER BY ingest_order) AS delivery FROM memory_events
),
tokenised AS (SELECT *, {_TOKENS} AS tokens FROM numbered_rows WHERE delivery = 1),
ev AS (
  SELECT ingest_order, id, coalesce(nullif(trim(episode_id), ''), id) AS episode, text, source_type, context_json,
    source_type IN ('observed', 'executed', 'user_confirmed') AS trusted, context_signature, created_at, tokens
  FROM tokenised WHERE len(tokens) > 0
)"""
GRAMS = f"""{EVENTS},
segmented AS (SELECT *, sum(CASE WHEN trusted THEN 0 ELSE 1 END) OVER (PARTITION BY episode ORDER BY ingest_order) AS seg FROM ev),
occ AS (
  SELECT episode, seg, id, ingest_order, context_signature, context_json, created_at, unnest(tokens) AS token, unnest(range(len(tokens))) AS ordinal FROM segmented WHERE trusted
),
lagged AS (
  SELECT *, lag(token, 1) OVER w AS t1, lag(token, 2) OVER w AS t2, lag(token, 3) OVER w AS t3
  FROM occ WINDOW w AS (PARTITION BY episode, seg ORDER BY ingest_order, ordinal)
),
spans AS (
  SELECT 1 AS length, t1 AS pattern, token AS next_token, * FROM lagged WHERE t1 IS NOT NULL
  UNION ALL SELECT 2, t2 || ' ' || t1, token, * FROM lagged WHERE t2 IS NOT NULL
  UNION ALL SELECT 3, t3 || ' ' || t2 || ' ' || t1, token, * FROM lagged WHERE t3 IS NOT NULL
)"""
_RECENCY = "1.0 / (1.0 + greatest(epoch(TIMESTAMP '" + AS_OF + "') - epoch({0}), 0) / 86400.0 / 30.0)"
#: Likeness of the JSON {0} to CONTEXT: shared members over members of either, a quarter for no members.
_KEYS = "CASE WHEN json_valid({0}) AND json_type({0}) = 'OBJECT' THEN len(json_keys({0})) ELSE 0 END"
_SHARED = "(coalesce(json_extract({0}, '$.space')::varchar = '\"cours\"', false)::int + coalesce(json_extract({0}, '$.lang')::varchar = '\"fr\"', false)::int)"
_LIKE = f"CASE WHEN NOT json_valid({{0}}) THEN 0.25 WHEN {_KEYS} = 0 THEN 0.25 ELSE {_SHARED} / ({_KEYS} + 2 - {_SHARED})::double END"
_TERMS = "[" + ", ".join(f"'{t}'" for t in QUERY) + "]"

ORACLES = {
    "predict_next": f"""WITH {GRAMS},
hits AS (SELECT * FROM spans WHERE (length = 1 AND pattern = '{HISTORY[1]}') OR (length = 2 AND pattern = '{HISTORY[0]} {HISTORY[1]}')),
merged AS (
  SELECT length, next_token, count(*) AS support, count(DISTINCT episode) AS episodes, max(created_at) AS last_seen, max({_LIKE.format('context_json')}) AS context_match,
    count(DISTINCT context_signature) AS n_contexts FROM hits WHERE length = (SELECT max(length) FROM hits) GROUP BY length, next_token
),
top AS (
  SELECT *, round(2 * ln(1 + support) + ln(1 + episodes) + 0.75 * length + context_match + {_RECENCY.format('last_seen')}, 6) AS score
  FROM merged ORDER BY score DESC, support DESC, next_token DESC LIMIT 10
)
SELECT *, round(score / sum(score) OVER (), 6) AS ranking_share FROM top""",
    "f1_event_tokens": f"WITH {EVENTS} SELECT ingest_order, len(tokens) AS n_tokens, len(list_distinct(tokens)) AS n_distinct, tokens[1] AS first_token FROM ev",
    "f2_document_concepts": f"WITH t AS (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents) SELECT token, count(*) AS n_occurrences, count(DISTINCT doc_id) AS n_documents FROM t GROUP BY token",
    "a7_stats": f"""WITH {EVENTS}
SELECT 'events' AS counter, count(*) AS n FROM ev UNION ALL SELECT 'trusted_events', count(*) FILTER (WHERE trusted) FROM ev
UNION ALL SELECT 'occurrences', sum(len(tokens))::bigint FROM ev UNION ALL SELECT 'episodes', count(DISTINCT episode) FROM ev
UNION ALL SELECT 'concepts', count(DISTINCT t) FROM (SELECT unnest(tokens) AS t FROM ev)
UNION ALL SELECT 'events from ' || source_type, count(*) FROM ev GROUP BY source_type""",
    "d2_key_conflicts": """SELECT trim(idempotency_key) AS key, count(*) AS n_deliveries, count(DISTINCT (text, source_type, coalesce(episode_id, ''))) AS n_contents,
  count(DISTINCT (text, source_type, coalesce(episode_id, ''))) > 1 AS conflict
FROM memory_events WHERE idempotency_key IS NOT NULL AND trim(idempotency_key) <> '' GROUP BY trim(idempotency_key)""",
    "w1_segments": f"WITH {GRAMS} SELECT episode, count(*) AS n_events, count(DISTINCT seg) AS n_segments FROM segmented WHERE trusted GROUP BY episode",
    "w2_evidence_spans": f"WITH {GRAMS} SELECT episode, length, count(*) AS n_spans, min(ingest_order) AS first_order, max(ingest_order) AS last_order FROM spans GROUP BY episode, length",
    "a1_continuations": f"""WITH {GRAMS} SELECT length, pattern, context_signature, next_token, count(*) AS support, count(DISTINCT episode) AS episode_support,
  min(created_at) AS first_seen, max(created_at) AS last_seen FROM spans GROUP BY length, pattern, context_signature, next_token""",
    "a2_decayed_support": f"""WITH {GRAMS} SELECT length, pattern, next_token,
  round(sum(pow(0.5, greatest(floor(epoch(TIMESTAMP '{AS_OF}')) - floor(epoch(created_at)), 0) / 86400.0 / 30.0)), 4) AS decayed_support
FROM spans GROUP BY length, pattern, next_token""",
    "w5_lineage": f"WITH {GRAMS} SELECT id, episode, ingest_order, ordinal, length, created_at FROM spans WHERE pattern = 'la' AND next_token = 'mesure' ORDER BY ingest_order DESC, ordinal DESC LIMIT 25",
    "w6_paths": f"""WITH {EVENTS},
occ AS (SELECT episode, ingest_order, unnest(tokens) AS token, unnest(range(len(tokens))) AS ordinal FROM ev),
placed AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY ingest_order, ordinal) AS rn FROM occ)
SELECT episode, string_agg(token, ' ' ORDER BY rn) FILTER (WHERE rn <= 100) AS path, max(rn) > 100 AS truncated FROM placed GROUP BY episode""",
    "recall_ranked": f"""WITH {EVENTS},
hit AS (SELECT *, list_filter(tokens, lambda t: list_contains({_TERMS}, t)) AS hits FROM ev),
per AS (
  SELECT episode, count(DISTINCT t) AS m, count(*) AS o, max(created_at) AS latest FROM (SELECT episode, created_at, unnest(hits) AS t FROM hit) GROUP BY episode
  ORDER BY m DESC, o DESC, latest DESC, episode LIMIT 40
),
ranked AS (
  SELECT episode, ingest_order, row_number() OVER (PARTITION BY episode ORDER BY len(list_distinct(hits)) DESC, ingest_order DESC) AS rn
  FROM hit WHERE len(hits) > 0 AND episode IN (SELECT episode FROM per)
),
ordered AS (
  SELECT episode, ingest_order, lag(ingest_order) OVER w AS before, lead(ingest_order) OVER w AS after FROM hit WHERE episode IN (SELECT episode FROM per)
  WINDOW w AS (PARTITION BY episode ORDER BY ingest_order)
),
seeds AS (SELECT o.* FROM ordered o JOIN ranked r USING (episode, ingest_order) WHERE r.rn <= 6),
picked AS (
  SELECT episode, ingest_order, min(p) AS p FROM (
    SELECT episode, ingest_order, 0 AS p FROM seeds UNION ALL SELECT episode, before, 1 FROM seeds UNION ALL SELECT episode, after, 1 FROM seeds
  ) WHERE ingest_order IS NOT NULL GROUP BY episode, ingest_order
),
firsts AS (SELECT episode, arg_min(context_json, ingest_order) AS ctx FROM ev GROUP BY episode),
capped AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY p, ingest_order DESC) AS rn FROM picked),
chosen AS (SELECT h.* FROM hit h JOIN capped c USING (episode, ingest_order) WHERE c.rn <= 12),
scored AS (
  SELECT episode, count(*) AS n_events, sum(len(hits))::bigint AS n_occurrences, len(list_distinct(flatten(list(hits)))) AS matched,
    array_to_string(flatten(list(tokens ORDER BY ingest_order))[1:100], ' ') AS path FROM chosen GROUP BY episode
),
updated AS (SELECT episode, max(created_at) AS updated_at FROM ev GROUP BY episode)
SELECT episode, matched, n_occurrences, n_events, round({_LIKE.format('ctx')}, 6) AS context_match, path,
  round(2.0 * matched + 2.0 * matched / {len(QUERY)} + ln(1 + n_occurrences) + {_LIKE.format('ctx')} + {_RECENCY.format('updated_at')}, 6) AS score
FROM scored JOIN updated USING (episode) JOIN firsts USING (episode) ORDER BY score DESC, least(n_occurrences, 25) DESC, episode DESC LIMIT 10""",
    "recall_newest": f"""WITH {EVENTS}, updated AS (SELECT episode, max(created_at) AS updated_at FROM ev GROUP BY episode)
SELECT episode, 0 AS matched, 0 AS n_occurrences, round({_RECENCY.format('updated_at')}, 6) AS score FROM updated ORDER BY updated_at DESC, episode LIMIT 10""",
    "u1_forget_continuations": f"""WITH {EVENTS},
holes AS (
  SELECT *, coalesce(sum(CASE WHEN source_type = '{FORGOTTEN}' THEN 1 ELSE 0 END) OVER (PARTITION BY episode ORDER BY ingest_order DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS part FROM ev
)
SELECT CASE WHEN part = 0 THEN episode ELSE episode || '/' || part END AS episode, count(*) AS n_events, min(ingest_order) AS first_order, sum(len(tokens))::bigint AS n_tokens
FROM holes WHERE source_type <> '{FORGOTTEN}' GROUP BY ALL""",
    "u1_rebuilt_continuations": f"""WITH {EVENTS},
holes AS (SELECT *, coalesce(sum(CASE WHEN source_type = '{TAUGHT}' THEN 1 ELSE 0 END) OVER (PARTITION BY episode ORDER BY ingest_order DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS part FROM ev),
kept AS (SELECT * REPLACE (episode || '/' || part AS episode) FROM holes WHERE source_type <> '{TAUGHT}')
{GRAMS[len(EVENTS):].replace('FROM ev)', 'FROM kept)')}
SELECT length, pattern, next_token, count(*) AS support FROM spans GROUP BY length, pattern, next_token""",
    "a11_episode_bounds": f"WITH {EVENTS} SELECT episode, min(created_at) AS first_at, max(created_at) AS last_at, count(*) AS n_events, count(*) FILTER (WHERE trusted) AS n_trusted FROM ev GROUP BY episode",
}
