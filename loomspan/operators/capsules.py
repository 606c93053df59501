"""Evidence capsules: facts of dossiers recalled for questions, projections that stay stable, recalculated answers."""

import datetime
import hashlib
import json
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.runtime import stage

# How a source's type reads as a status, the confidence of a status, the names that only an evaluation may hold.
STATUS = {"user_confirmed": "confirmed", "confirmed": "confirmed", "verified": "verified", "executed": "executed", "observed": "observed", "derived": "derived"}
CONFIDENCE = {"verified": 1.0, "confirmed": 1.0, "executed": 1.0, "observed": 0.9, "derived": 0.7, "unverified": 0.5}
EVALUATION_KEYS = ("expected_answer_fragments", "forbidden_answer_fragments", "supporting_claim_ids", "answer_status")
# The grammar of a calculation, and of an answer that states its result.
AGE_CALL = re.compile(r"calendar_age\((\d{4}-\d{2}-\d{2}),(\d{4}(?:-\d{2}){0,2}),precision=(day|month|year)\)")
STATED_AGE = re.compile(r"(\ble calcul donne[ \t]+)(entre[ \t]+[0-9]{1,4}[ \t]+et[ \t]+[0-9]{1,4}|[0-9]{1,4})([ \t]+ans\b)", re.IGNORECASE)
#: Most tokens of a question that is met by pairs of its tokens, and most of a dossier whose own pairs are listed.
MOST_PAIRED, MOST_TOKENS = 16, 64
#: Openings of an object that are tried in an answer.
MOST_STARTS = 32


def status_of(source_type: Column, science: Column, generated: list[str]) -> Column:
    """The evidence status of a source's type; null for generated text; ``verified`` for claims of a science corpus."""
    kind = F.lower(F.trim(F.coalesce(source_type, F.lit(""))))
    known = F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in STATUS.items()), F.lit("unverified"))
    return F.when(kind.isin(generated), None).when(science, "verified").otherwise(known)


def confidence_of(value: Column, status: Column) -> Column:
    """A stated confidence between 0 and 1, else the usual one of the status."""
    usual = F.coalesce(*(F.when(status == k, F.lit(v)) for k, v in CONFIDENCE.items()))
    return F.when(value.between(0, 1), value).otherwise(usual)


def table_digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: SHA-256 of a table as a set of rows, whatever their order, and the number of distinct rows.

    Digests of rows are gathered by their first four digits, digests of those
    groups once more; so no task sees more than a 65 536th of the rows.
    """
    line = F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
    per = rows.select(line.alias("h")).distinct().groupBy(F.substring("h", 1, 4).alias("g")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("d"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "d"))), lambda x: x["d"]), ""), 256).alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))


def stable_item(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """Facts of each dossier in order of their id, each with its sorted source ids; nothing in it depends on when it was read.

    ``facts`` has dossier, fact_id, statement, date, status; ``sources`` fact_id, source_id.
    """
    listed = sources.where("source_id IS NOT NULL").groupBy("fact_id").agg(F.array_sort(F.collect_set("source_id")).alias("source_ids"))
    rows = facts.dropDuplicates(["dossier", "fact_id"]).join(listed, "fact_id", "left")
    return rows.select("dossier", "fact_id", "statement", "date", "status", F.array_join(F.coalesce("source_ids", F.array().cast("array<string>")), ",").alias("source_ids"))


def matches(questions: DataFrame, facts: DataFrame, top_k: int) -> DataFrame:
    """question_id, dossier, matched, n_facts, rank: the dossiers that share most distinct tokens with a question.

    ``questions`` has question_id and tokens, ``facts`` dossier, fact_id and
    tokens (arrays).  Ranked by matches, then facts, then name.

    Questions of the same tokens are answered once.  Of the dossiers that share
    one token with a question only the ``top_k`` largest of that token can be
    among its first; those that share two or more are met by pairs of tokens.  So
    a token of many questions and many dossiers isn't multiplied out.  Questions
    of more than MOST_PAIRED tokens are met by single tokens.
    """
    asking = stage(questions.select("question_id", F.array_sort(F.array_distinct(F.filter("tokens", lambda t: t.isNotNull()))).alias("asked")))
    sets = asking.select("asked").distinct().select("asked", F.explode("asked").alias("token"))
    sizes = stage(facts.where("dossier IS NOT NULL").groupBy("dossier").agg(F.countDistinct("fact_id").alias("n_facts")))
    held = facts.where("dossier IS NOT NULL").select("dossier", F.explode("tokens").alias("token")).join(sets.select("token").distinct(), "token", "left_semi").distinct()
    held = stage(held.join(held.groupBy("dossier").agg(F.count(F.lit(1)).alias("n_tokens")), "dossier").join(sizes, "dossier"))

    order = Window.partitionBy("token").orderBy(F.desc("n_facts"), "dossier")
    first = held.select("token", "dossier", "n_facts").withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= top_k).select("token", "dossier")
    alone = sets.where(F.size("asked") <= MOST_PAIRED).join(first, "token").select("asked", "dossier", "token")
    long = sets.where(F.size("asked") > MOST_PAIRED).join(held.select("token", "dossier"), "token").select("asked", "dossier", "token")

    wanted = sets.where(F.size("asked").between(2, MOST_PAIRED)).select("asked", F.col("token").alias("a"), F.explode(F.filter("asked", lambda t: t > F.col("token"))).alias("b"))
    pairs = wanted.select("a", "b").distinct()
    few, many = held.where(F.col("n_tokens") <= MOST_TOKENS), held.where(F.col("n_tokens") > MOST_TOKENS)
    named = lambda rows, name: rows.select("dossier", F.col("token").alias(name))
    in_few = named(few, "a").join(named(few, "b"), "dossier").where("a < b").join(pairs, ["a", "b"]).select("a", "b", "dossier")
    in_many = pairs.join(named(many, "a"), "a").join(named(many, "b"), ["dossier", "b"]).select("a", "b", "dossier")
    both = wanted.join(in_few.unionByName(in_many), ["a", "b"]).select("asked", "dossier", F.explode(F.array("a", "b")).alias("token"))

    per = alone.unionByName(both).unionByName(long).groupBy("asked", "dossier").agg(F.countDistinct("token").alias("matched")).join(sizes, "dossier")
    order = Window.partitionBy("asked").orderBy(F.desc("matched"), F.desc("n_facts"), "dossier")
    ranked = per.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    return asking.join(ranked, "asked").select("question_id", "dossier", "matched", "n_facts", "rank")


def _beginnings(facts: DataFrame, budget: int) -> DataFrame:
    """dossier, fact_id, statement, _upto: each dossier's facts by id up to the first that exceeds the budget, with the characters so far.

    A budget ends after as many facts that say something at the latest, so each
    task passes on that many of a dossier, however large it is.
    """
    rows = facts.where("dossier IS NOT NULL").select("dossier", "fact_id", "statement", F.coalesce(F.length("statement"), F.lit(0)).cast("long").alias("_length"))
    order = Window.partitionBy("dossier").orderBy("fact_id")
    told = rows.where("_length > 0").withColumn("_place", F.dense_rank().over(order)).where(F.col("_place") <= budget + 1).dropDuplicates(["dossier", "fact_id"])
    upto = F.sum("_length").over(order.rowsBetween(Window.unboundedPreceding, 0))
    told = stage(told.withColumn("_upto", upto).where(F.col("_upto") - F.col("_length") <= budget).select("dossier", "fact_id", "statement", "_upto"))
    silent = rows.where("_length = 0")
    if not silent.take(1):
        return told
    silent = silent.select("dossier", "fact_id", "statement").dropDuplicates(["dossier", "fact_id"]).join(told.select("dossier", "fact_id"), ["dossier", "fact_id"], "left_anti")
    before = told.select("dossier", F.col("fact_id").alias("_at"), F.col("_upto").alias("_sum"))
    placed = silent.join(before, (silent["dossier"] == before["dossier"]) & (F.col("_at") < F.col("fact_id")), "left")
    return told.unionByName(placed.groupBy(silent["dossier"], "fact_id", "statement").agg(F.coalesce(F.max("_sum"), F.lit(0)).alias("_upto")))


def capsules(questions: DataFrame, facts: DataFrame, top_k: int, budget: int) -> DataFrame:
    """question_id, dossier, rank, fact_id: the facts of each question's capsule, within a budget of characters.

    Facts follow the rank of their dossier and their id; the capsule ends before
    the fact that would exceed the budget.  Only the question's id and tokens
    are used, so nothing of an evaluation can reach a capsule.

    Of a dossier a capsule can hold only its beginning; so lengths are summed up
    once a dossier, not once a question.
    """
    chosen = matches(questions, facts, top_k)
    begun = _beginnings(facts, budget)
    totals = begun.groupBy("dossier").agg(F.max("_upto").alias("_total"))
    before = Window.partitionBy("question_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    left = chosen.join(totals, "dossier").withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0))).where(F.col("_before") <= budget)
    met = left.select("question_id", "dossier", "rank", "_before").join(begun, "dossier").where(F.col("_before") + F.col("_upto") <= budget)
    return met.select("question_id", "dossier", "rank", "fact_id", "statement")


def capsule_coverage(rows: DataFrame, supporting: DataFrame) -> DataFrame:
    """question_id, n_expected, n_recalled, coverage of each question, and with a null question_id over all of them."""
    met = supporting.select("question_id", "fact_id").distinct().join(rows.select("question_id", "fact_id", F.lit(1).alias("there")).distinct(), ["question_id", "fact_id"], "left")
    out = met.rollup("question_id").agg(F.count(F.lit(1)).alias("n_expected"), F.count("there").alias("n_recalled"))
    return out.withColumn("coverage", F.round(F.col("n_recalled") / F.col("n_expected"), 6))


def evaluation_leaks(rows: DataFrame, text: str) -> DataFrame:
    """Rows whose text holds the quoted name of an evaluation's field."""
    return rows.where(F.col(text).rlike('"(' + "|".join(EVALUATION_KEYS) + ')"'))


def without_evidence(rows: DataFrame, ids: str, required: str) -> DataFrame:
    """The baseline of an ablation: the same rows with no evidence, and none required."""
    return rows.withColumns({ids: F.array().cast(rows.schema[ids].dataType), required: F.lit(False)})


def _bounds(text: str) -> tuple[datetime.date, datetime.date]:
    y, m, d = (list(map(int, text.split("-"))) + [0, 0])[:3]
    first = datetime.date(y, m or 1, d or 1)
    if d:
        return first, first
    after = datetime.date(y + (m in (0, 12)), 1 if m in (0, 12) else m + 1, 1) if y < 9999 else None
    return first, after - datetime.timedelta(days=1) if after else datetime.date(9999, 12, 31)


def recalculated_age(expression: str | None) -> str | None:
    """The result of one ``calendar_age(birth,event,precision=p)``: a number or ``min..max``; null for anything else."""
    m = AGE_CALL.fullmatch(expression or "")
    if not m or len(m[2]) != {"day": 10, "month": 7, "year": 4}[m[3]]:
        return None
    try:
        born, (first, last) = datetime.date.fromisoformat(m[1]), _bounds(m[2])
    except ValueError:
        return None
    low, high = (at.year - born.year - ((at.month, at.day) < (born.month, born.day)) for at in (first, last))
    return None if low < 0 else str(low) if low == high else f"{low}..{high}"


def corrected_answer(answer: str | None, results: list[str]) -> str | None:
    """The answer with its stated ages replaced by the recalculated ones, in order, if there are as many."""
    if answer is None or not results or len(STATED_AGE.findall(answer)) != len(results):
        return answer
    left = iter(results)
    return STATED_AGE.sub(lambda m: m[1] + (lambda r: f"entre {r.replace('..', ' et ')}" if ".." in r else r)(next(left)) + m[3], answer)


@F.arrow_udf(T.StructType([T.StructField("results", T.ArrayType(T.StringType())), T.StructField("answer", T.StringType()), T.StructField("calculation_ids", T.ArrayType(T.StringType()))]))
def recalculated(request: pa.Array, answers: pa.Array, expressions: pa.Array) -> pa.Array:
    """struct(results, answer, calculation_ids) of an answer's calculations; a calculation outside the grammar gives null results."""
    out = []
    for key, answer, calls in zip(request.to_pylist(), answers.to_pylist(), expressions.to_pylist()):
        results = [recalculated_age(c) for c in calls or ()]
        good = None not in results
        ids = [f"calc:{hashlib.sha256(f'{key}:{i}'.encode()).hexdigest()[:16]}" for i in range(len(results))]
        out.append({"results": results if good else None, "answer": corrected_answer(answer, results) if good else answer, "calculation_ids": ids})
    return pa.array(out, pa.struct([("results", pa.list_(pa.string())), ("answer", pa.string()), ("calculation_ids", pa.list_(pa.string()))]))


def first_mapping(text: str | None, known: tuple[str, ...] = ("answer", "request_id", "evidence_ids")) -> str | None:
    """The first JSON object in a text that has one of the known names, as canonical JSON; MOST_STARTS openings are tried."""

    def pairs(items):
        if len({k for k, _ in items}) < len(items):
            raise ValueError("repeated name")
        return dict(items)

    def refuse(name):
        raise ValueError(name)

    decoder, at = json.JSONDecoder(object_pairs_hook=pairs, parse_constant=refuse), -1
    for _ in range(MOST_STARTS):
        at = (text or "").find("{", at + 1)
        if at < 0:
            return None
        try:
            value, _ = decoder.raw_decode(text, at)
        except (ValueError, RecursionError):
            continue
        if isinstance(value, dict) and any(k in value for k in known):
            return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return None


@F.arrow_udf(T.StringType())
def first_mappings(texts: pa.Array) -> pa.Array:
    """:func:`first_mapping` of a column."""
    return pa.array([first_mapping(t) for t in texts.to_pylist()], pa.string())


def estimated_bits(kind: str, n: int, k: int = 0) -> int:
    """About how many bits n!, C(n, k) or P(n, k) has, without working it out."""
    lower = {"factorial": 0.0, "comb": math.lgamma(k + 1) + math.lgamma(n - k + 1), "perm": math.lgamma(n - k + 1)}[kind]
    return max(1, math.ceil((math.lgamma(n + 1) - lower) / math.log(2))) if n > 1 and not (kind == "comb" and k in (0, n)) and not (kind == "perm" and k == 0) else 1


@F.arrow_udf(T.IntegerType())
def comb_bits(n: pa.Array, k: pa.Array) -> pa.Array:
    """:func:`estimated_bits` of C(n, k)."""
    return pa.array([None if a is None or b is None else estimated_bits("comb", a, b) for a, b in zip(n.to_pylist(), k.to_pylist())], pa.int32())


def derived_records(derived: DataFrame, texts: Column, quota: int = 16, most: int = 8000) -> DataFrame:
    """Derived measures as records to remember: text, marker, episode, inferred source with its ordered dependencies.

    ``derived`` has event_id, id, kind and dependencies (array); at most
    ``quota`` records of an event, first by id, none longer than ``most``.
    """
    order = Window.partitionBy("event_id").orderBy("id")
    rows = derived.withColumn("text", texts).where(F.length("text") <= most).withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= quota)
    marker = F.concat(F.lit("derived:"), F.substring(F.sha2("id", 256), 1, 16))
    return rows.select("id", "text", marker.alias("marker"), F.concat(F.lit("derived:"), F.col("event_id")).alias("episode_id"), F.lit("inferred").alias("source_type"), F.array_distinct("dependencies").alias("dependencies"))
