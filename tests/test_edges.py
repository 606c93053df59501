"""Every registered query of the core on empty tables, and on tables with null rows and extra columns."""

import os

import pytest
from pyspark.sql import functions as F

from loomspan.functions import mathx
from loomspan.plans import evidence, facts, lifecycle, memory, quality, records

SOURCE = "/root/testdata/sf0.001"
IDS = {"memory_events": "ingest_order", "injection_jobs": "sequence", "documents": "doc_id", "training_examples": "row_id", "concepts": "id"}
EXTRA = ["key", "salt", "n", "tokens", "own", "place", "ref", "shard", "lo", "hi", "doc", "words", "value", "copies", "position"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SOURCE), reason="no test tables")


def with_nulls(name, df):
    none = df.limit(2).select(*(F.col(c) if c == IDS.get(name) else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns))
    if name in IDS:
        none = none.withColumn(IDS[name], F.col(IDS[name]) + 10_000_000)
    return df.limit(30).unionByName(none).withColumns({x: F.lit("x") for x in EXTRA if x not in df.columns})


@pytest.fixture(scope="module", params=["empty", "nulls"])
def folder(spark, request, tmp_path_factory):
    out = str(tmp_path_factory.mktemp(request.param))
    for file in os.listdir(SOURCE):
        df = spark.read.parquet(f"{SOURCE}/{file}")
        df = df.limit(0) if request.param == "empty" else with_nulls(file.split(".")[0], df)
        df.coalesce(1).write.parquet(f"{out}/{file}")
    return out


@pytest.mark.parametrize("module", [quality, memory, facts, records, evidence, lifecycle], ids=lambda m: m.__name__.rpartition(".")[2])
def test_no_query_fails(spark, folder, module):
    for name, query in module.QUERIES.items():
        assert query(spark, folder).count() >= 0, name


def test_scalar_math_past_64_bits(spark, tmp_path):
    keys = (900, 901, 922_337, 922_338, 1_199_999)
    rows = spark.createDataFrame([(1, k, 7, 1, 3.0, 10.5) for k in keys], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double")
    rows.withColumn("l_orderkey", rows["l_partkey"]).write.parquet(f"{tmp_path}/lineitem.parquet")
    out = {r["l_orderkey"]: r["safe"] for r in facts.f37_scalar_math(spark, str(tmp_path)).collect()}
    assert out == {k: str(k * 10**13) if k * 10**13 > 2**53 - 1 else None for k in keys}
    least = spark.createDataFrame([(-(2**63),), (None,)], "x long")
    assert [r[0] for r in least.select(mathx.json_safe(F.col("x"))).collect()] == [str(-(2**63)), None]
