"""Queries do the whole job: nothing is filtered, capped or fixed to one case."""

import math
import os
import random

import pytest

from loomspan import runtime
from loomspan.operators import timeline
from loomspan.plans import evidence, facts, memory

SMALL = "/root/testdata/sf0.001"


def test_differential_check_covers_every_family(spark, tmp_path):
    spark.range(1, 201).withColumnRenamed("id", "o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.family: (r.n, r.n_agreeing) for r in evidence.a31_differential(spark, str(tmp_path)).collect()}
    names = ("sum_product", "gcd", "comb", "sqrt", "mean", "sin_cos", "floor", "isqrt", "hypot", "log2")
    assert got == {name: (20, 20) for name in names}


def test_durations_of_years_months_and_days(spark, tmp_path):
    rows = [("y", " 1990 ", "1995"), ("m", "1990-11", "1991-02"), ("d", "0001-01-01", "0001-01-31T10:00:00Z"), ("mixed", "1990", "1991-02"), ("back", "1991-02", "1990-11"), ("bad", "1999-13", "2000-01"), ("badday", "1999-02-30", "1999-03-01"), ("open", "1990", None)]
    spark.createDataFrame(rows, "statement_id string, temporal_start string, temporal_end string").write.parquet(f"{tmp_path}/claims.parquet")
    got = {tuple(r) for r in facts.f17_durations(spark, str(tmp_path)).collect()}
    month = 1990 * 12 + 10
    assert got == {
        ("y", "duration_years", 5.0, False), ("y", "temporal_midpoint", 1992.5, False), ("m", "duration_months", 3.0, False), ("m", "temporal_midpoint", month + 1.5, False),
        ("d", "duration_days", 30.0, True), ("d", "temporal_midpoint", 321.0, True),
    }


def test_distance_from_previous(spark):
    f = lambda at, i, lat, lon, p=11: ("e", "at", p, at, (lat, lon), i)
    rows = [f(1, "a", 0.0, 0.0), f(2, "b", 0.0, 180.0, 9), f(3, "c", None, 1.0), f(4, "d", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "entity string, predicate string, precision int, position long, object struct<latitude: double, longitude: double>, fact_id string")
    assert [(r.fact_id, r.previous_id, r.kind, r.exact) for r in timeline.distances(df).collect()] == [("b", "a", "distance_from_previous", False)]
    assert abs(timeline.distances(df).first().value - math.pi * 6371.0088) < 1e-6


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_decayed_support_covers_all_lengths(spark):
    got = {(r.length, r.pattern, r.next_token) for r in memory.a2_decayed_support(spark, SMALL).collect()}
    want = {(r.length, r.pattern, r.next_token) for r in memory.a1_continuations(spark, SMALL).collect()}
    assert got == want and {length for length, _, _ in got} == {1, 2, 3}


def test_cycles_of_any_length(spark):
    ring = [(f"r{i}", f"r{(i + 1) % 18}") for i in range(18)]
    square = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("c", "a"), ("d", "tail"), ("head", "a"), ("s", "s"), ("d", "s"), (None, "a")]
    rows = timeline.on_cycles(spark.createDataFrame(ring + square, "src string, dst string")).collect()
    want = {f"r{i}": 18 for i in range(18)} | {"a": 3, "b": 3, "c": 3, "d": 4, "s": 1}
    assert len(rows) == len(want) and {r.node: r.length for r in rows} == want
    facts_ = spark.createDataFrame([("e", "p", 11, i, "o", f"r{i}") for i in range(18)], "entity string, predicate string, precision int, position long, object string, fact_id string")
    edges = spark.createDataFrame([(a, b, "retracts") for a, b in ring], "fact_id string, target_id string, kind string")
    assert {(r.fact_id, r.problem) for r in timeline.correction_problems(facts_, edges).collect()} == {(f"r{i}", "cycle") for i in range(18)}


def test_cycles_by_hand(spark):
    rng = random.Random(8)
    for n, m in ((40, 60), (60, 90), (25, 100)):
        edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
        after = {}
        for a, b in edges:
            after.setdefault(a, set()).add(b)
        want = {}
        for v in range(n):
            reached, length = set(after.get(v, ())), 1
            seen = set(reached)
            while reached and v not in reached:
                reached = {y for x in reached for y in after.get(x, ())} - seen
                seen |= reached
                length += 1
            if v in reached:
                want[v] = length
        rows = timeline.on_cycles(spark.createDataFrame(sorted(edges), "src long, dst long")).collect()
        assert len(rows) == len(want) and {r.node: r.length for r in rows} == want


def test_cycles_meet_half_way(spark):
    """No table that is written holds a fifth of the pairs of start and end."""
    rng, n = random.Random(9), 1000
    edges = [(i, rng.randrange(n)) for i in range(n) for _ in range(5)]
    runtime.drop_staged(spark)
    assert timeline.on_cycles(spark.createDataFrame(edges, "src long, dst long")).count() > 0.9 * n
    where = runtime._stage_dir(spark)
    assert max(spark.read.parquet(f"{where}/{x}").count() for x in os.listdir(where)) < 0.2 * n * n
