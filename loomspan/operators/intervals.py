"""Continuous periods and gaps of overlapping intervals.

Exact days are discretised into run-compressed bitmaps, one per entity and time
shard of 65 536 days.  Bitmaps are united before and after the shuffle, so one
shuffled row per entity, shard and map task is all that a hot entity costs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.functions.text import BLANK

SHARD_BITS = 16
SHARD = 1 << SHARD_BITS
#: Day 0 is 0001-01-01; OPEN is the day after 9999-12-31 and stands for "no end".
OPEN = 3652059
_EPOCH = 719162
_DATE = r"^(\d{4}(?:-\d{2}(?:-\d{2})?)?)(?:(?<=-\d\d-\d\d)(?:[Zz]|[Tt ]\d{2}(?::?\d{2}(?::?\d{2}(?:[.,]\d+)?)?)?(?:[Zz]|[+-]\d{2}(?::?\d{2})?)?))?\z"


def day_number(bound: Column, end: bool) -> Column:
    """Days since 0001-01-01 of the first (``end``: last) day that a bound means.

    A bound is ``YYYY``, ``YYYY-MM`` or ``YYYY-MM-DD``; blanks around it and a
    time of day or ``Z`` after a day are ignored.  Null for anything else.
    """
    bare = F.regexp_extract(F.regexp_replace(bound, f"^{BLANK}|{BLANK}\\z", ""), _DATE, 1)
    whole = F.concat(bare, F.substring(F.lit("YYYY-12-01" if end else "YYYY-01-01"), F.length(bare) + 1, F.lit(10)))
    date = F.when((bare != "") & ~bare.startswith("0000"), whole.try_cast("date"))
    return F.unix_date(F.when(F.length(bare) < 10, F.last_day(date)).otherwise(date) if end else date) + F.lit(_EPOCH)


def _merge(group: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of runs that touch, within each group; group must not decrease after sorting."""
    order = np.lexsort((lo, group))
    group, lo, hi = group[order], lo[order], hi[order]
    base = group * (SHARD * 4)
    reach = np.maximum.accumulate(hi + base)
    new = np.ones(len(lo), dtype=bool)
    new[1:] = (lo + base)[1:] > reach[:-1] + 1
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(lo)) - 1
    return group[starts], lo[starts], reach[ends] - base[starts]


def _pack(lo: np.ndarray, hi: np.ndarray) -> bytes:
    """A run container: pairs of 16-bit start and length - 1."""
    return np.column_stack((lo, hi - lo)).astype("<u2").tobytes()


def _unpack(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the blob, first and last bit of every run."""
    flat = np.frombuffer(b"".join(blobs), dtype="<u2").astype(np.int64).reshape(-1, 2)
    index = np.repeat(np.arange(len(blobs)), [len(b) // 4 for b in blobs])
    return index, flat[:, 0], flat[:, 0] + flat[:, 1]


def _changes(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """True where a row's values of ``names`` differ from the row before (nulls are equal)."""
    new = np.zeros(batch.num_rows, dtype=bool)
    new[:1] = True
    for name in names:
        codes = batch.column(name).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return new


def _united(keys: list[str], schema: pa.Schema):
    """For batches sorted by keys and shard: one row for each key and shard with the union of its bitmaps."""
    names = [*keys, "shard"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last group so far, as one row
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if not batch.num_rows:
                continue
            first = np.flatnonzero(_changes(batch, names))
            group_of_row = np.repeat(np.arange(len(first)), np.diff(np.append(first, batch.num_rows)))
            index, lo, hi = _unpack(batch.column("runs").to_pylist())
            group, lo, hi = _merge(group_of_row[index], lo, hi)
            cut = np.searchsorted(group, np.arange(len(first) + 1))
            runs = [_pack(lo[a:b], hi[a:b]) for a, b in zip(cut[:-1], cut[1:])]
            rows = batch.take(pa.array(first))
            out = pa.RecordBatch.from_arrays([*(rows.column(n) for n in names), pa.array(runs, pa.binary())], schema=schema)
            held = out.slice(out.num_rows - 1)
            yield out.slice(0, out.num_rows - 1)
        if held is not None:
            yield held

    return run


def _as_runs(keys: list[str], schema: pa.Schema):
    """Each row's first and last bit as a run container of one run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = np.column_stack((batch.column("lo").to_numpy(), batch.column("hi").to_numpy() - batch.column("lo").to_numpy())).astype("<u2")
            runs = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4), len(pairs), [None, pa.py_buffer(pairs.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in [*keys, "shard"]), runs], schema=schema)

    return run


def _extracted(keys: list[str], schema: pa.Schema):
    """The set runs of every bitmap as days."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, lo, hi = _unpack(batch.column("runs").to_pylist())
            base = batch.column("shard").to_numpy()[index] * SHARD
            rows = batch.take(pa.array(index))
            yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in keys), pa.array(base + lo), pa.array(base + hi)], schema=schema)

    return run


def continuous_periods(df: DataFrame, keys: list[str], lo: Column, hi: Column) -> DataFrame:
    """Merge the day intervals [lo, hi] of each key into ``period`` rows and list the ``gap`` rows between them.

    Returns keys, span_kind, lo, hi (day numbers).  Intervals that overlap or
    touch form one period.  Rows with a null bound or hi < lo are left out;
    repeated rows change nothing; null keys are a key of their own; an empty
    table gives an empty result; other columns of ``df`` are ignored.
    """
    key_fields = [df.schema[k] for k in keys]
    arrow = pa.schema([*((k.name, pa.string()) for k in key_fields), ("shard", pa.int64()), ("runs", pa.binary())])
    bitmap = T.StructType([*key_fields, T.StructField("shard", T.LongType()), T.StructField("runs", T.BinaryType())])
    spans = df.select(*keys, lo.cast("long").alias("_lo"), hi.cast("long").alias("_hi")).where("_hi >= _lo")
    first, last = F.shiftright("_lo", SHARD_BITS), F.shiftright("_hi", SHARD_BITS)
    low = lambda c: F.col(c).bitwiseAND(SHARD - 1)
    piece = lambda shard, a, b: F.struct(shard.cast("long").alias("shard"), F.lit(a).cast("long").alias("lo") if isinstance(a, int) else a.alias("lo"), F.lit(b).cast("long").alias("hi") if isinstance(b, int) else b.alias("hi"))
    pieces = F.when(first == last, F.array(piece(first, low("_lo"), low("_hi")))).otherwise(F.array(piece(first, low("_lo"), SHARD - 1), piece(last, 0, low("_hi"))))
    parts = spans.select(*keys, F.explode(pieces).alias("p")).select(*keys, "p.shard", "p.lo", "p.hi")
    order = [*keys, "shard"]
    bitmaps = parts.mapInArrow(_as_runs(keys, arrow), bitmap).sortWithinPartitions(*order).mapInArrow(_united(keys, arrow), bitmap)
    bitmaps = bitmaps.repartition(*order).sortWithinPartitions(*order).mapInArrow(_united(keys, arrow), bitmap)
    days = pa.schema([*((k.name, pa.string()) for k in key_fields), ("lo", pa.int64()), ("hi", pa.int64())])
    runs = bitmaps.mapInArrow(_extracted(keys, days), T.StructType([*key_fields, T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())]))
    # whole shards between the first and the last are fills: one run however long, each once
    fills = spans.where(last - first > 1).select(*keys, ((first + 1) * SHARD).alias("lo"), (last * SHARD - 1).alias("hi")).distinct()
    by_key = Window.partitionBy(*keys).orderBy("lo", "hi")
    before = F.max("hi").over(by_key.rowsBetween(Window.unboundedPreceding, -1))
    islands = runs.unionByName(fills).withColumn("_new", F.when(F.col("lo") <= before + 1, 0).otherwise(1))
    islands = islands.withColumn("_island", F.sum("_new").over(by_key.rowsBetween(Window.unboundedPreceding, 0)))
    periods = islands.groupBy(*keys, "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    following = F.lead("lo").over(Window.partitionBy(*keys).orderBy("_island"))
    periods = periods.withColumn("_next", following)
    row = lambda kind, a, b: F.struct(F.lit(kind).alias("span_kind"), a.alias("lo"), b.alias("hi"))
    both = F.array(row("period", F.col("lo"), F.col("hi")), F.when(F.col("_next").isNotNull(), row("gap", F.col("hi") + 1, F.col("_next") - 1)))
    return periods.select(*keys, F.explode(F.array_compact(both)).alias("s")).select(*keys, "s.span_kind", "s.lo", "s.hi")


def day_text(day: Column) -> Column:
    """``YYYY-MM-DD`` of a day number, ``open`` from OPEN on."""
    date = F.date_from_unix_date((F.least(day, F.lit(OPEN - 1)) - _EPOCH).cast("int"))
    return F.when(day >= OPEN, "open").otherwise(F.date_format(date, "yyyy-MM-dd"))


def claim_spans(claims: DataFrame) -> DataFrame:
    """Periods and gaps of the claims of each subject and predicate (see :func:`continuous_periods`).

    A claim without a usable start, with an unusable end, or ending before it
    starts is left out; an absent or blank end means open.
    """
    start = day_number(F.col("temporal_start"), end=False)
    blank = F.col("temporal_end").isNull() | (F.regexp_replace("temporal_end", BLANK, "") == "")
    end = F.when(blank, F.lit(OPEN)).otherwise(day_number(F.col("temporal_end"), end=True))
    keys = ["subject_value", "predicate_iri"]
    spans = continuous_periods(claims, keys, start, end)
    return spans.select(*keys, "span_kind", day_text(F.col("lo")).alias("start_day"), day_text(F.col("hi")).alias("end_day"))
