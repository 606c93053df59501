"""Every registered query of the subpackage on empty tables, and on tables with null rows and extra columns."""

import os

import pytest
from pyspark.sql import functions as F

pytest.importorskip("loomspan.llm")
from loomspan.llm import queries  # noqa: E402

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


def test_no_query_fails(spark, folder):
    for name, query in queries.QUERIES.items():
        assert query(spark, folder).count() >= 0, name
