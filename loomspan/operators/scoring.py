"""Scores of answers and retrieval, and the coverage of evidence."""

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.functions.text import clean, compatible

# Words of an abstention, and the patterns of verifiable parts of an answer.
ABSTENTION = ["je ne sais pas", "information insuffisante", "i don't know", "cannot determine", "je_ne_sais_pas"]

SYNTHETIC_ID = r"(?i)(?<![A-Za-z0-9])SYN-[A-Za-z0-9-]+"
FICTIONAL_VALUE = r"(?i)(?<![\w-])(?:code|état)-fictif-\d+"
ISO_DATE = r"(?<!\d)\d{4}-\d{2}-\d{2}(?!\d)"
AGE = r"(?i)(?<!\w)\d{1,3}\s+ans\b"
UNKNOWN = r"(?i)(?<!\w)JE_NE_SAIS_PAS(?!\w)"
DECISION = r"(?i)^\s*(oui|non)(?=\s|[.!?:;,])"


def exact_form(text: Column) -> Column:
    """An answer in NFKC, case-folded, with single blanks."""
    return clean(compatible(text, fold=True))


def anchors(text: Column) -> Column:
    """Distinct verifiable parts of an answer in NFKC: ids, fictional values, dates, ages, the unknown marker, a leading yes or no."""
    text = compatible(text)
    every = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tag = lambda name, found: F.transform(found, lambda x: F.concat(F.lit(name + ":"), x))
    upper, lower = (lambda a: F.transform(a, F.upper)), (lambda a: F.transform(a, lambda x: clean(F.lower(x))))
    unknown = F.when(text.rlike(UNKNOWN), F.array(F.lit("unknown:JE_NE_SAIS_PAS"))).otherwise(F.array().cast("array<string>"))
    word = F.lower(F.regexp_extract(text, DECISION, 1))
    decision = F.when(word != "", F.array(F.concat(F.lit("decision:"), word))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(
        tag("id", upper(every(SYNTHETIC_ID))), tag("value", lower(every(FICTIONAL_VALUE))),
        tag("date", every(ISO_DATE)), tag("age", lower(every(AGE))), unknown, decision,
    ))


def _exact(text: str | None) -> str:
    return " ".join(unicodedata.normalize("NFKC", text or "").casefold().split())


_FRAGMENT_SCORES = pa.struct([("correct", pa.bool_()), ("abstained", pa.bool_()), ("hallucinated", pa.bool_())])


@F.arrow_udf(T.StructType([T.StructField(n, T.BooleanType()) for n in ("correct", "abstained", "hallucinated")]))
def _fragment_scores(answers: pa.Array, expected: pa.Array, forbidden: pa.Array, answerable: pa.Array) -> pa.Array:
    marks, out = [_exact(x) for x in ABSTENTION], []
    for answer, want, bar, can in zip(answers.to_pylist(), expected.to_pylist(), forbidden.to_pylist(), answerable.to_pylist()):
        text = _exact(answer)
        abstained, wrong = any(m in text for m in marks), any(_exact(x) in text for x in bar or () if x)
        found = all(_exact(x) in text for x in want or () if x)
        out.append({"correct": found and not wrong and not abstained if can else abstained and not wrong, "abstained": abstained, "hallucinated": wrong if can else not abstained or wrong})
    return pa.array(out, _FRAGMENT_SCORES)


def fragment_scores(answer: Column, expected: Column, forbidden: Column, answerable: Column) -> Column:
    """struct(correct, abstained, hallucinated) of an answer by the fragments it holds.

    Answer and fragments are compared in NFKC, case-folded, with single blanks.
    A null answer is an empty one, null fragments are none, a null answerable is
    no.
    """
    return _fragment_scores(answer, expected, forbidden, answerable)


def evidence_scores(predicted: Column, target: Column, permitted: Column) -> Column:
    """struct(precision, recall, f1, invented, exact) of predicted ids; null for a null or repeating list."""
    valid = predicted.isNotNull() & (F.size(F.array_distinct(predicted)) == F.size(predicted))
    shared = F.size(F.array_intersect(predicted, target))
    precision = F.when(F.size(predicted) > 0, shared / F.size(predicted)).otherwise((F.size(target) == 0).cast("double"))
    recall = F.when(F.size(target) > 0, shared / F.size(target)).otherwise((F.size(predicted) == 0).cast("double"))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return F.when(valid, F.struct(F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"), F.size(F.array_except(predicted, permitted)).alias("invented"), (predicted == target).alias("exact")))


def coverage(rows: DataFrame, found: Column, wanted: Column) -> DataFrame:
    """Adds n_found, n_wanted and coverage (1 for nothing wanted)."""
    n = F.size(F.array_intersect(found, wanted))
    return rows.withColumns({"n_found": n, "n_wanted": F.size(wanted), "coverage": F.when(F.size(wanted) == 0, 1.0).otherwise(n / F.size(wanted))})


def rates(rows: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """Counts and rates of boolean metrics for each value of ``by`` and, with a null there, for all rows."""
    sums = [F.sum(F.coalesce(F.col(m), F.lit(False)).cast("long")).alias(m) for m in metrics]
    out = rows.rollup(by).agg(F.count(F.lit(1)).alias("n"), *sums, F.grouping(by).alias("overall"))
    return out.withColumns({f"{m}_rate": F.round(F.col(m) / F.col("n"), 6) for m in metrics})


def arms_delta(scored: DataFrame, arm: str, base: str, other: str, metric: str) -> DataFrame:
    """Mean of a metric in both arms and their difference, one row."""
    mean = lambda a: F.avg(F.when(F.col(arm) == a, F.col(metric).cast("double")))
    return scored.agg(mean(base).alias(base), mean(other).alias(other)).withColumn("delta", F.col(other) - F.col(base))


def retrieval(returned: DataFrame, expected: DataFrame) -> DataFrame:
    """query_id, top1, top5, complete: whether all expected episodes of a query come back, and at what rank the first does.

    ``returned`` has query_id, episode, rank (from 1); ``expected`` query_id, episode.
    """
    per = expected.join(returned, ["query_id", "episode"], "left").groupBy("query_id").agg(F.min("rank").alias("best"), F.count("rank").alias("hits"), F.count(F.lit(1)).alias("wanted"))
    return per.select("query_id", F.coalesce(F.col("best") == 1, F.lit(False)).alias("top1"), F.coalesce(F.col("best") <= 5, F.lit(False)).alias("top5"), (F.col("hits") == F.col("wanted")).alias("complete"))
