"""Streams against the same rows as a batch."""

import datetime as dt
import json
import os

import pytest

from loomspan.operators import memory
from loomspan.streaming import ingest


def write(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows), encoding="utf-8")


def event(key, episode, text, minute, source="user_confirmed"):
    return {"idempotency_key": key, "episode_id": episode, "text": text, "source_type": source, "created_at": (dt.datetime(2025, 1, 1) + dt.timedelta(minutes=minute)).isoformat()}


def test_ingestion_is_idempotent(spark, tmp_path):
    inbox, store, state = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "state")
    inbox.mkdir()
    write(inbox / "1.json", [event("a", "x", "alpha", 0), event("a", "x", "alpha", 1), event("b", "x", "beta", 2)])
    ingest.start_ingestion(spark, str(inbox), store, state).awaitTermination()
    write(inbox / "2.json", [event("a", "x", "other", 5), event("b", "x", "beta", 6), event("c", "x", "gamma", 7)])
    ingest.start_ingestion(spark, str(inbox), store, state).awaitTermination()
    ingest.start_ingestion(spark, str(inbox), store, state).awaitTermination()
    assert sorted((r.idempotency_key, r.text) for r in spark.read.parquet(f"{store}/events").collect()) == [("a", "alpha"), ("b", "beta"), ("c", "gamma")]
    assert [(r.idempotency_key, r.text) for r in spark.read.parquet(f"{store}/conflicts").collect()] == [("a", "other")]


def run(spark, df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_episode_state_equals_the_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    inbox = tmp_path / "in"
    inbox.mkdir()
    rows = [event(f"k{i}", "xy"[i % 2], f"mot{i % 5} suite{i % 3}", i, "generated" if i % 6 == 0 else "observed") for i in range(24)]
    for n in range(3):
        write(inbox / f"{n}.json", rows[n * 8 : n * 8 + 8])
        os.utime(inbox / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))  # files arrive in this order
    stream = spark.readStream.schema(ingest.EVENT).option("maxFilesPerTrigger", 1).json(str(inbox))
    try:
        got = run(spark, ingest.incremental_spans(stream), "spans", "append", tmp_path).collect()
    except Exception as e:  # noqa: BLE001
        if "rocksdb" in str(e).lower() and "UnsatisfiedLink" in str(e):
            pytest.skip("no RocksDB here")
        raise
    batch = spark.createDataFrame([(i, r["idempotency_key"], r["episode_id"], r["text"], r["source_type"], r["idempotency_key"], "global", dt.datetime.fromisoformat(r["created_at"])) for i, r in enumerate(rows)], "ingest_order long, id string, episode_id string, text string, source_type string, idempotency_key string, context_signature string, created_at timestamp")
    want = memory.evidence_spans(memory.event_log(batch)).collect()
    assert sorted((r.episode_id, r.length, r.pattern, r.next_token) for r in got) == sorted((r.episode, r.length, r.pattern, r.next_token) for r in want)


def test_windows_and_duplicates(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    write(inbox / "1.json", [event("a", "x", "t", 0), event("a", "x", "t", 1), event("b", "x", "t", 20), event("c", "x", "t", 300)])
    stream = lambda: spark.readStream.schema(ingest.EVENT).json(str(inbox))
    assert run(spark, ingest.deduplicated(stream(), "1 hour"), "once", "append", tmp_path).count() == 3
    counts = run(spark, ingest.windowed_counts(stream(), "10 minutes", "1 hour"), "hours", "complete", tmp_path)
    assert sorted(r.n for r in counts.collect()) == [1, 3]
    assert sorted(r.n for r in run(spark, ingest.session_counts(stream(), "10 minutes", "30 minutes"), "sessions", "complete", tmp_path).collect()) == [1, 3]


def test_versions_are_published(spark, tmp_path):
    ingest.publish(spark.range(3), str(tmp_path), "1")
    ingest.publish(spark.range(5), str(tmp_path), "2")
    assert (tmp_path / "CURRENT").read_text() == "2" and spark.read.parquet(str(tmp_path / "version=1")).count() == 3
    with pytest.raises(Exception):
        ingest.publish(spark.range(1), str(tmp_path), "2")
