"""Ingestion as Structured Streaming: idempotent appends, dead letters, episode state, windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from loomspan.functions.text import concept_keys
from loomspan.operators.memory import MAX_ORDER, TRUSTED
from loomspan.runtime import path_exists, replace_text

#: Folders of stored keys by hash.
BUCKETS = 64
EVENT = "idempotency_key string, episode_id string, text string, source_type string, created_at timestamp"


def fresh_events(batch: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new events, conflicts) of a batch: each key once, not stored yet; a key that comes with another text is a conflict."""
    digest = F.sha2(F.concat_ws("\u0001", "text", "source_type"), 256)
    keyed = batch.withColumn("content", digest)
    first = Window.partitionBy("idempotency_key").orderBy("created_at", "content")
    ranked = keyed.withColumn("_first", F.first("content").over(first)).withColumn("_rn", F.row_number().over(first))
    known = stored.select("idempotency_key", F.col("content").alias("stored_content"))
    joined = ranked.join(known, "idempotency_key", "left")
    original = F.coalesce("stored_content", "_first")
    conflicts = joined.where(F.col("content") != original).drop("_first", "_rn", "stored_content")
    new = joined.where("stored_content IS NULL AND _rn = 1").drop("_first", "_rn", "stored_content")
    return new, conflicts


def start_ingestion(spark: SparkSession, incoming: str, store: str, checkpoint: str):
    """Files of events below ``incoming`` into parquet tables ``store``/events and ``store``/conflicts.

    Every batch writes a folder of its own number and replaces it when it is
    retried, so a batch that is run again after a crash changes nothing.  Stored
    keys lie in BUCKETS folders by hash; a batch reads those of its own keys.
    """

    path = f"{store}/events"

    def append(batch: DataFrame, number: int) -> None:
        own = f"batch={number}"
        batch = batch.withColumn("bucket", F.pmod(F.xxhash64("idempotency_key"), F.lit(BUCKETS)).cast("int"))
        stored = spark.createDataFrame([], "idempotency_key string, content string")
        # the first batch finds no folder; any other failure to read is one
        if path_exists(spark, path):
            met = [r[0] for r in batch.select("bucket").distinct().collect()]  # at most BUCKETS numbers
            stored = spark.read.parquet(path).where((F.col("batch") != number) & F.col("bucket").isin(met))
        new, conflicts = fresh_events(batch, stored)
        new.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{own}")
        conflicts.drop("bucket").write.mode("overwrite").parquet(f"{store}/conflicts/{own}")

    source = spark.readStream.schema(EVENT).json(incoming)
    return source.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(events: DataFrame, delay: str) -> DataFrame:
    """A stream's events once per key within the watermark."""
    return events.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["idempotency_key"])


def windowed_counts(events: DataFrame, delay: str, width: str, slide: str | None = None) -> DataFrame:
    """Events by source in tumbling (or sliding) windows of event time."""
    return events.withWatermark("created_at", delay).groupBy(F.window("created_at", width, slide) if slide else F.window("created_at", width), "source_type").agg(F.count(F.lit(1)).alias("n"))


def session_counts(events: DataFrame, delay: str, gap: str) -> DataFrame:
    """Events of each episode in sessions that end after a gap."""
    return events.withWatermark("created_at", delay).groupBy(F.session_window("created_at", gap), "episode_id").agg(F.count(F.lit(1)).alias("n"))


SPANS = "episode_id string, length int, pattern string, next_token string"


class EpisodeState(StatefulProcessor):
    """Keeps the last three trusted tokens of each episode and emits the patterns that new events teach."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tail = handle.getValueState("tail", "tokens string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = (self.tail.get()[0] if self.tail.exists() else "").split()
        out = []
        events = pd.concat(list(rows)).sort_values(["created_at", "idempotency_key"])
        for trusted, tokens in zip(events.trusted, events.tokens):
            if not trusted:
                held = []
                continue
            for t in tokens.split():
                out.extend((key[0], n, " ".join(held[-n:]), t) for n in range(1, min(MAX_ORDER, len(held)) + 1))
                held = [*held[-(MAX_ORDER - 1) :], t]
        self.tail.update((" ".join(held),))
        yield pd.DataFrame(out, columns=["episode_id", "length", "pattern", "next_token"])

    def close(self) -> None:
        pass


def incremental_spans(events: DataFrame) -> DataFrame:
    """Patterns of a stream of events, learnt in order of arrival; needs the RocksDB state store."""
    prepared = events.select("episode_id", "idempotency_key", "created_at", F.col("source_type").isin(*TRUSTED).alias("trusted"), F.array_join(concept_keys(F.col("text")), " ").alias("tokens")).where("tokens <> ''")
    return prepared.groupBy("episode_id").transformWithStateInPandas(EpisodeState(), SPANS, "Append", "None")


def publish(df: DataFrame, root: str, version: str) -> str:
    """Write a version beside the others and point ``CURRENT`` to it; readers keep the version they opened.

    The pointer is replaced in one step of the file system that ``root`` lies in.
    """
    path = f"{root.rstrip('/')}/version={version}"
    df.write.mode("error").parquet(path)
    replace_text(df.sparkSession, f"{root.rstrip('/')}/CURRENT", version)
    return path
