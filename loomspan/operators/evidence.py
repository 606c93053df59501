"""Evidence rows, groups of documents, status summaries and small projections."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions import civil, mathx
from loomspan.functions.text import hash_number, normalise_token
from loomspan.operators import contracts
from loomspan.operators.nested import Members, Parser


def atomic_evidence(items: DataFrame, key: str, parts: str, most: int = 256) -> DataFrame:
    """One row for each part of an item, or one for the item itself without parts; at most ``most`` parts.

    ``position`` orders all rows: item * 1000 + part.
    """
    listed = F.slice(F.coalesce(parts, F.array().cast(items.schema[parts].dataType)), 1, most)
    rows = items.select(key, F.posexplode_outer(F.when(F.size(listed) > 0, listed)).alias("pos", "part"))
    return rows.select(key, F.coalesce("part", F.concat(F.lit("item-"), F.col(key).cast("string"))).alias("evidence"), (F.col(key) * 1000 + F.coalesce("pos", F.lit(0))).alias("position"))


def by_digest(rows: DataFrame, digest: Column, tag: str, size: str) -> DataFrame:
    """One row for each digest: sorted tags, the shortest tag (then the first by name), the largest size."""
    best = F.min_by(tag, F.struct(F.length(tag), F.col(tag)))
    return rows.groupBy(digest.alias("digest")).agg(F.array_sort(F.collect_set(tag)).alias("tags"), best.alias("tag"), F.max(size).alias("size"), F.count(F.lit(1)).alias("n"))


def dossiers(docs: DataFrame) -> DataFrame:
    """Documents, characters and sorted sources of each dossier; texts are never gathered into one row."""
    per = docs.where("dossier_id IS NOT NULL").groupBy("dossier_id", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("c"))
    return per.groupBy("dossier_id").agg(F.sum("n").alias("n_documents"), F.sum("c").alias("n_chars"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def dossier_lines(docs: DataFrame) -> DataFrame:
    """The place of each document in its dossier."""
    rn = F.row_number().over(Window.partitionBy("dossier_id").orderBy("doc_id"))
    return docs.where("dossier_id IS NOT NULL").select("dossier_id", "doc_id", rn.alias("line"))


def history_tail(rows: DataFrame, order: list, n: int) -> DataFrame:
    """The last n rows, how many there are, and whether some are left out."""
    last = rows.orderBy(*order).limit(n)
    total = rows.count()
    return last.withColumns({"n_all": F.lit(total), "truncated": F.lit(total > n)})


def normalised_source(jobs: DataFrame) -> DataFrame:
    """Key and source of a request: the argument before the source document before the context; blanks are nothing."""
    well = lambda c: F.when(F.try_parse_json(c).isNotNull(), F.col(c))
    field = lambda c, path: F.nullif(F.trim(F.get_json_object(well(c), path)), F.lit(""))
    key = F.coalesce(F.nullif(F.trim("idempotency_key"), F.lit("")), field("source_json", "$.idempotency_key"), field("context_json", "$.idempotency_key"))
    return jobs.select("sequence", key.alias("key"), F.coalesce(field("source_json", "$.type"), F.lit("user_confirmed")).alias("source_type"))


def ages(births: DataFrame, events: DataFrame) -> DataFrame:
    """Age of an entity at its events from partial dates; the last birth (by id) of an entity counts.

    Both have entity, fact_id, date; an event is no birth, and none is before it.
    """
    born = births.groupBy("entity").agg(F.max_by(F.struct("fact_id", "date"), "fact_id").alias("b"))
    pairs = events.join(born, "entity").where(F.col("fact_id") != F.col("b.fact_id"))
    return pairs.select("entity", F.col("fact_id").alias("event_id"), F.col("b.fact_id").alias("birth_id"), civil.calendar_age(F.col("b.date"), F.col("date")).alias("age")).where("age IS NOT NULL")


def status(jobs: DataFrame) -> DataFrame:
    """One row: requests received, distinct tickets, repeated ones and their percentage."""
    per = jobs.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    out = per.agg(F.sum("n").alias("received"), F.count(F.lit(1)).alias("distinct_tickets"))
    repeated = F.col("received") - F.col("distinct_tickets")
    return out.withColumns({"repeated": repeated, "deduplication_percent": F.round(100.0 * repeated / F.col("received"), 2)})


def has_key(docs: DataFrame, names: set[str]) -> DataFrame:
    """key, found: whether a JSON document has one of the names at any depth; no row for anything but JSON."""

    def search(value) -> bool:
        stack = [value]
        while stack:
            v = stack.pop()
            if isinstance(v, Members):
                if any(k in names for k, _ in v):
                    return True
                stack.extend(x for _, x in v)
            elif isinstance(v, list):
                stack.extend(v)
        return False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse = Parser()
        for batch in batches:
            keys, found = [], []
            for key, doc in zip(batch.column("key").to_pylist(), batch.column("doc").to_pylist()):
                try:
                    hit = search(parse(doc))
                except ValueError:
                    continue
                keys.append(key)
                found.append(hit)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.bool_())], names=["key", "found"])

    return docs.select("key", "doc").mapInArrow(run, "key long, found boolean")


def arms(cases: DataFrame, names: list[str]) -> DataFrame:
    """Every case in every arm, arms in order."""
    return cases.withColumn("arm", F.explode(F.array(*map(F.lit, names))))


def base_facts(spark: SparkSession, count: int) -> DataFrame:
    """Deterministic dated facts of eight entities and four predicates."""
    row = spark.range(count)
    i = F.col("id")
    predicates = F.array(*map(F.lit, ["population", "distance", "temperature", "duration"]))
    return row.select(
        F.concat(F.lit("evt-"), i).alias("fact_id"), F.concat(F.lit("Entite-"), i % 8).alias("entity"), F.element_at(predicates, (i % 4 + 1).cast("int")).alias("predicate"),
        civil.shifted_year(F.lit(-50).cast("long"), i * 7 % 2000).alias("year"), (1000 + i * 37 % 9973).alias("object"), (i % 12 + 1).alias("month"), (i % 28 + 1).alias("day"),
    )


def register_functions(spark: SparkSession) -> None:
    """SQL functions: evaluate_expression(text), normalise_token(text)."""
    spark.udf.register("evaluate_expression", mathx.evaluate)
    spark.udf.register("normalise_token", normalise_token)


def disturbed(facts: DataFrame, seed: int) -> DataFrame:
    """Facts with contradictions and duplicates in an order of arrival that has nothing to do with time.

    ``facts`` has fact_id and object.  Hashes of seed and id choose: every
    twelfth fact gets a contradicting one with another value, every fortieth
    arrives twice.  arrival sorts the rows.
    """
    hashed = facts.withColumn("_x", hash_number(F.concat(F.lit(f"{seed}:"), "fact_id"), 120))
    other = hashed.where("_x % 12 = 0").withColumns({"fact_id": F.concat("fact_id", F.lit(":contradiction")), "object": F.col("object") + 1, "kind": F.lit("contradiction")})
    twice = hashed.where("_x % 40 = 1").withColumn("kind", F.lit("duplicate"))
    rows = hashed.withColumn("kind", F.lit("base")).unionByName(other).unionByName(twice).drop("_x")
    return rows.withColumn("arrival", F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), "kind", "fact_id"), 256), 1, 16))


def workload_queries(facts: DataFrame, each: int) -> DataFrame:
    """kind, fact_id, query: up to ``each`` retrieval queries of six kinds over dated facts, chosen by hash.

    direct names entity, predicate and date; partial leaves the predicate out;
    temporal the entity and date; entity the entity alone; predicate the
    predicate alone; unknown asks for an entity that isn't there and has no
    expected fact.
    """
    parts = {
        "direct": F.concat_ws(" ", "entity", "predicate", "date"), "partial": F.concat_ws(" ", "entity", "date"), "temporal": F.concat_ws(" ", F.lit("when"), "entity", "date"),
        "entity": F.col("entity"), "predicate": F.col("predicate"), "unknown": F.concat(F.lit("missing-"), F.substring(F.sha2("fact_id", 256), 1, 12)),
    }
    asked = facts.withColumn("q", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("query")) for k, v in parts.items()))))
    first = F.row_number().over(Window.partitionBy("q.kind").orderBy(F.sha2("fact_id", 256)))
    return asked.withColumn("_rn", first).where(F.col("_rn") <= each).select("q.kind", F.when(F.col("q.kind") != "unknown", F.col("fact_id")).alias("fact_id"), "q.query")


def model_kind(name: Column) -> Column:
    """The kind of a model by its name."""
    return F.when(name.rlike("(?i)embed"), "embedding").when(name.rlike("(?i)local|base"), "base").otherwise("other")


def filtered_models(models: DataFrame, kinds: list[str], names: list[str], most: int) -> DataFrame:
    """Models of the kinds and, if given, the names; first by name, ``most`` of them."""
    rows = models.withColumn("kind", model_kind(F.col("base_model"))).where(F.col("kind").isin(kinds))
    return (rows.where(F.col("base_model").isin(names)) if names else rows).orderBy(F.lower("base_model"), "config_id").limit(most)


def question_problems(rows: DataFrame) -> DataFrame:
    """Rules that questions (row_id, example_id, question, status, n_fragments) break: key, rule."""
    times = rows.groupBy("example_id").agg(F.count(F.lit(1)).alias("_times"))
    met = rows.join(times, rows["example_id"].eqNullSafe(times["example_id"])).drop(times["example_id"])
    return contracts.violations(met, "row_id", {
        "id_given": F.length(F.trim("example_id")) > 0, "id_unique": F.col("_times") == 1, "question_given": F.length(F.trim("question")) > 0,
        "answerable_has_fragments": (F.col("status") == "unanswerable") | (F.col("n_fragments") > 0),
    })
