"""Access-controlled retrieval over several spaces, and retrieval under a size budget."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomspan.functions.text import canonical_json
from loomspan.operators import blocks

# What a source says of itself when its text was generated, sources that may be written, names that the hub sets.
GENERATED = ("generated", "model_generated", "assistant_generated", "llm_generated")
WRITABLE = ("user_confirmed", "observed", "executed")
RESERVED = ("memory_hub_agent", "memory_hub_space")


def can_read(principal: Column) -> Column:
    """Whether a principal may read a space (kind, owner, readers).

    The owner always may; ``*`` among the readers is everybody; a reference
    space without readers is public.
    """
    listed = F.array_contains(F.coalesce("readers", F.array().cast("array<string>")), principal) | F.array_contains(F.coalesce("readers", F.array().cast("array<string>")), "*")
    public = (F.col("kind") == "reference") & (F.size(F.coalesce("readers", F.array().cast("array<string>"))) == 0)
    return F.coalesce(F.col("owner") == principal, F.lit(False)) | listed | public


def can_write(principal: Column) -> Column:
    """Whether a principal may write to a space; nobody writes to a reference space."""
    writers = F.coalesce("writers", F.array().cast("array<string>"))
    return (F.col("kind") != "reference") & (F.coalesce(F.col("owner") == principal, F.lit(False)) | F.array_contains(writers, principal) | F.array_contains(writers, "*"))


def policy_problems(policies: DataFrame, spaces: DataFrame) -> DataFrame:
    """space, problem: private without owner, reference with writers, policy without space, space without policy, repeated policy."""
    writers = F.size(F.coalesce("writers", F.array().cast("array<string>")))
    kind = F.when((F.col("kind") == "private") & F.col("owner").isNull(), "private_without_owner").when((F.col("kind") == "reference") & (writers > 0), "reference_with_writers").when(~F.col("kind").isin("private", "shared", "reference"), "unknown_kind")
    own = policies.select("space", kind.alias("problem")).where("problem IS NOT NULL")
    no_space = policies.join(spaces, "space", "left_anti").select("space", F.lit("policy_without_space").alias("problem"))
    no_policy = spaces.join(policies, "space", "left_anti").select("space", F.lit("space_without_policy").alias("problem"))
    twice = policies.groupBy("space").count().where("count > 1").select("space", F.lit("repeated_policy").alias("problem"))
    return own.unionByName(no_space).unionByName(no_policy).unionByName(twice)


def readable(items: DataFrame, policies: DataFrame, principal: str) -> DataFrame:
    """Items of the spaces that the principal may read."""
    return items.join(policies.where(can_read(F.lit(principal))).select("space"), "space", "left_semi")


def merged_spaces(items: DataFrame) -> DataFrame:
    """Items that are equal but for their space come once: the first space by name, the best score, all origins.

    ``items`` has space, rank, score and fingerprint.
    """
    out = items.groupBy("fingerprint").agg(F.min(F.struct("space", "rank")).alias("first"), F.max("score").alias("score"), F.array_sort(F.collect_set("space")).alias("origins"))
    return out.select("fingerprint", F.col("first.space").alias("space"), F.col("first.rank").alias("rank"), "score", "origins")


def best_evidence(items: DataFrame, most_tags: int = 16) -> DataFrame:
    """One row of each key: the best by (status rank, confidence, space rank, text, earliest), tags of all merged."""
    best = F.max_by(F.struct("text", "status_rank", "confidence", "space_rank"), F.struct("status_rank", "confidence", "space_rank", "text", -F.col("position")))
    out = items.groupBy("key").agg(best.alias("b"), F.min("position").alias("position"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))), 1, most_tags).alias("tags"), F.count(F.lit(1)).alias("n_merged"))
    return out.select("key", "b.*", "position", "tags", "n_merged")


def within_budget(items: DataFrame, group: list[str], order: list, size: str, budget: int) -> DataFrame:
    """In order, every item that still fits the budget of its group; one that doesn't is skipped, not the end.

    A fold over sorted rows that holds one number, so a group of any length
    streams through.  Null sizes count as 0.
    """
    schema = items.schema

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, used = None, 0
        for pdf in frames:
            keep = []
            for key, n in zip(zip(*(pdf[c] for c in group)), pdf[size]):
                if key != at:
                    at, used = key, 0
                n = 0 if n is None or n != n else int(n)
                fits = used + n <= budget
                used += n * fits
                keep.append(fits)
            yield pdf[keep]

    return items.repartition(*group).sortWithinPartitions(*group, *order).mapInPandas(fold, schema)


def until_budget(items: DataFrame, group: list[str], order: list, size: Column, budget: int) -> DataFrame:
    """In order, the items before the first that exceeds the budget of its group; null sizes count as 0."""
    return blocks.running(items, group, order, {"_upto": size}).where(F.col("_upto") <= budget).drop("_upto")


def namespaced_key(agent: Column, space: Column, key: Column) -> Column:
    """The idempotency key of a hub write."""
    return F.concat(F.lit("memory-hub:"), F.sha2(F.concat_ws("\u0000", agent, space, key), 256))


def lexical_overlap(question: Column, text: Column, stopwords: list[str]) -> Column:
    """Number of shared distinct terms of two letters or more, but for stop words; both are token arrays."""
    stop = F.array(*map(F.lit, stopwords)) if stopwords else F.array().cast("array<string>")
    terms = lambda a: F.filter(F.array_except(F.array_distinct(a), stop), lambda t: F.length(t) > 1)
    return F.size(F.array_intersect(terms(question), terms(text)))


def generated_guard(rows: DataFrame, source_json: str) -> DataFrame:
    """Adds ``accepted``: whether a source may be written to a space, and ``refused`` why not.

    A source is ``generated`` if it says so, or if its type, origin or kind is of
    GENERATED; ``not_writable`` if its type isn't of WRITABLE; ``no_source`` if
    it is no JSON object.
    """
    well = F.when(F.try_parse_json(source_json).isNotNull(), F.col(source_json))
    field = lambda name: F.lower(F.trim(F.coalesce(F.get_json_object(well, f"$.{name}"), F.lit(""))))
    said = field("type").isin(*GENERATED) | field("origin").isin(*GENERATED) | field("kind").isin(*GENERATED) | (F.get_json_object(well, "$.generated") == "true")
    is_object = F.coalesce(F.trim(well).startswith("{"), F.lit(False))
    refused = F.when(~is_object, "no_source").when(F.coalesce(said, F.lit(False)), "generated").when(~field("type").isin(*WRITABLE), "not_writable")
    return rows.withColumn("refused", refused).withColumn("accepted", F.col("refused").isNull())


@F.udf(StringType(), useArrow=True)
def semantic_context(context):
    """Canonical JSON of a context without the names that the hub sets, at any depth; null for no JSON object."""

    def bare(value):
        return {k: bare(v) for k, v in value.items() if k not in RESERVED} if isinstance(value, dict) else value

    shape = canonical_json(context)
    value = None if shape is None else json.loads(shape)
    return json.dumps(bare(value), ensure_ascii=False, sort_keys=True, separators=(",", ":")) if isinstance(value, dict) else None


@F.udf(StringType(), useArrow=True)
def stamped_context(context, agent, space):
    """Canonical JSON of a context with the writing agent and space; what a caller set there is overwritten."""
    shape = canonical_json(context or "{}")
    value = None if shape is None else json.loads(shape)
    return json.dumps({**value, RESERVED[0]: agent, RESERVED[1]: space}, ensure_ascii=False, sort_keys=True, separators=(",", ":")) if isinstance(value, dict) else None


def ranked_items(items: DataFrame, limit: int) -> DataFrame:
    """The best items of a merged recall: score, then fingerprint; null scores are 0."""
    return items.orderBy(F.desc(F.coalesce("score", F.lit(0.0))), "fingerprint").limit(limit)


def ranked_evidence(items: DataFrame, question: list[str], limit: int) -> DataFrame:
    """Evidence for a question: item of origin, most shared terms, position, id; ``limit`` is 1 to 64.

    ``items`` has evidence_id, position (item * 1000 + part) and tokens.
    """
    if not 1 <= limit <= 64:
        raise ValueError("limit must be 1 to 64")
    overlap = F.size(F.array_intersect(F.array_distinct("tokens"), F.array(*map(F.lit, question)) if question else F.array().cast("array<string>")))
    return items.withColumn("overlap", overlap).orderBy(F.floor(F.col("position") / 1000), F.desc("overlap"), "position", "evidence_id").limit(limit)
