"""Rules that records must keep, as violations; and examples mined from facts."""

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomspan.functions.text import hash_number, hashed_id
from loomspan.runtime import stage


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key, rule of every rule that a row breaks; a rule that is null for a row counts as broken."""
    broken = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())), lambda x: x.isNotNull())
    return rows.select(F.col(key).alias("key"), F.explode(broken).alias("rule"))


def answer_rules() -> dict[str, Column]:
    """Rules of an answer (answer, confidence, evidence_ids, abstained, reason, evidence_required, permitted_ids)."""
    ids, abstained = F.col("evidence_ids"), F.col("abstained")
    return {
        "confidence_in_bounds": F.col("confidence").between(0, 1),
        "ids_unique": F.size(F.array_distinct(ids)) == F.size(ids),
        "ids_permitted": F.size(F.array_except(ids, F.col("permitted_ids"))) == 0,
        "abstention_consistent": F.when(abstained, (F.col("confidence") == 0) & (F.col("reason") != "none")).otherwise(F.col("reason") == "none"),
        "answer_given": abstained | (F.length(F.trim("answer")) > 0),
        "evidence_given": abstained | ~F.col("evidence_required") | (F.size(ids) > 0),
    }


def missing_keys(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Distinct non-null values of a column (arrays are exploded) without a parent row."""
    kind = child.schema[column].dataType.typeName()
    value = F.explode(column) if kind == "array" else F.col(column)
    keys = child.select(value.alias("missing")).where("missing IS NOT NULL").distinct()
    return keys.join(parent.select(F.col(parent_column).alias("missing")), "missing", "left_anti")


def training_rules() -> dict[str, Column]:
    """Rules of a training row (messages, target, example_id, task)."""
    roles = F.transform("messages", lambda m: m["role"])
    last = F.element_at("messages", -1)["content"]
    return {
        "id_given": F.length(F.trim("example_id")) > 0,
        "starts_with_system": F.element_at(roles, 1) == "system",
        "ends_with_assistant": F.element_at(roles, -1) == "assistant",
        "no_empty_message": F.forall("messages", lambda m: F.length(F.trim(m["content"])) > 0),
        "target_is_json": F.try_parse_json("target").isNotNull(),
        "provenance_given": F.coalesce(F.length(F.trim("provenance_sha256")) > 0, F.lit(False)),
        "target_holds_answer": F.coalesce(F.get_json_object("target", "$.answer") == last, F.lit(False)),
    }


def lengths(rows: DataFrame, size: Column, by: str, limits: list[int]) -> DataFrame:
    """Rows, largest and 95th percentile (value at floor(p (n-1))) of a size for each group, and how many exceed each limit."""
    rows = rows.select(by, size.alias("_n"))
    counts = rows.groupBy(by, "_n").agg(F.count(F.lit(1)).alias("c"))
    # percentile over counts of distinct sizes: bounded by the sizes, not by the rows
    upto = F.sum("c").over(Window.partitionBy(by).orderBy("_n").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("c").over(Window.partitionBy(by))
    ranked = counts.withColumns({"_u": upto, "_t": total})
    over = [F.sum(F.when(F.col("_n") > x, F.col("c")).otherwise(0)).alias(f"over_{x}") for x in limits]
    return ranked.groupBy(by).agg(F.sum("c").alias("n_rows"), F.max("_n").alias("largest"), F.min(F.when(F.col("_u") > F.floor(0.95 * (F.col("_t") - 1)), F.col("_n"))).alias("p95"), *over)


#: Characters of the tokens that one automaton holds; more tokens take more passes over the texts.
AUTOMATON_CHARS = 16 << 20


def leaks(corpus: DataFrame, text: str, tokens: DataFrame, least: int = 4, most_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """Forbidden tokens that a text contains anywhere, whatever their case: token and number of texts.

    A multi-pattern automaton looks for all of them in one pass over whole
    texts.  Tokens of less than ``least`` characters are left out.  What the
    automaton holds is measured: tokens of more than ``most_chars`` characters
    together are dealt into several automata, one pass each.
    """
    wanted = stage(tokens.select(compatible_fold("token").alias("token")).where(F.length(F.trim("token")) >= least).distinct())
    chars = wanted.agg(F.sum(F.length("token"))).first()[0] or 0
    passes = -(-chars // most_chars)
    out = corpus.sparkSession.createDataFrame([], "token string, n_texts long")
    for i in range(passes):
        part = [r[0] for r in wanted.where(F.pmod(F.xxhash64("token"), F.lit(passes)) == i).collect()]
        out = out.unionByName(_contained(corpus.select(text), corpus.sparkSession.sparkContext.broadcast(part)))
    return out


def compatible_fold(column: str) -> Column:
    """A token as the automaton compares it: case-folded."""
    return _folded(F.col(column))


@F.arrow_udf(StringType())
def _folded(batch: pa.Array) -> pa.Array:
    return pa.array([None if t is None else t.casefold() for t in batch.to_pylist()], pa.string())


def _contained(texts: DataFrame, tokens) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for t in tokens.value:
            automaton.add_word(t, t)
        automaton.make_automaton()
        found: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text and tokens.value:
                    found.update({t for _, t in automaton.iter(text.casefold())})
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["token", "n_texts"])

    return texts.mapInArrow(run, "token string, n_texts long").groupBy("token").agg(F.sum("n_texts").alias("n_texts"))


def capped(rows: DataFrame, by: str, order: list, most: int) -> DataFrame:
    """The first rows of each group: the examples kept of each task."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_rn") <= most).drop("_rn")


def synthetic_worlds(spark, count: int, seed: int) -> DataFrame:
    """One synthetic record for each number: independent names and values derived by hashing."""
    row = spark.range(count).withColumn("world", F.concat_ws(":", F.lit("world"), F.lit(seed), F.col("id")))
    tasks = ["direct_recall", "multi_hop", "temporal_age", "role", "causal", "abstention", "contradiction", "correction", "calculation"]
    return row.select(
        "id", hashed_id("ex-", F.col("world"), 20).alias("example_id"), F.element_at(F.array(*map(F.lit, tasks)), (F.col("id") % 9 + 1).cast("int")).alias("task"),
        F.concat(F.lit("SYN-"), F.upper(F.substring(F.sha2(F.concat("world", F.lit(":name")), 256), 1, 8))).alias("entity"), (1900 + hash_number(F.concat("world", F.lit(":year")), 120)).alias("year"),
        F.concat(F.lit("code-fictif-"), hash_number(F.concat("world", F.lit(":code")), 10_000)).alias("value"),
    )
