"""Streaming forms fed in several micro-batches, restarted from their checkpoint in between."""

import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from agentmeter.operators.ordered import collapse_runs
from agentmeter.streaming import loops, streams

STEP = "session string, chunk long, pos long, idx long, tool string, hash string, is_error boolean, denied int, at timestamp"
LOOP = ["session", "tool", "hash", "streak", "denied", "pos"]


def steps(spark, rows):
    """(session, pos, tool, hash, is_error, denied) as joined results, ten to a chunk and a second apart."""
    full = [(s, p // 10, p, 0, tool, digest, bad, denied) for s, p, tool, digest, bad, denied in rows]
    found = spark.createDataFrame(full, STEP.rsplit(",", 1)[0])
    return found.withColumn("at", F.timestamp_seconds(F.col("pos") + 1_700_000_000))


def batch_loops(spark, rows):
    whole = steps(spark, rows).withColumn("streak", F.lit(1).cast("long"))
    runs = collapse_runs(whole, ["session"], ["tool", "hash", "is_error"], ["streak", "denied"])
    return sorted(map(tuple, runs.filter("is_error and streak >= 3").select(*LOOP).collect()))


class Feed:
    def __init__(self, spark, tmp_path, late="1 HOUR", idle="10 MINUTES"):
        self.spark, self.path, self.late, self.idle = spark, tmp_path, late, idle

    def land(self, rows):
        rows.repartition(3).write.mode("append").parquet(str(self.path / "in"))

    def drain(self):
        stream = self.spark.readStream.schema(STEP).parquet(str(self.path / "in"))
        return streams.drain(loops.retry_loops(stream, self.late, self.idle), str(self.path / "out"), str(self.path / "mark"), keyed=True)

    def found(self):
        return sorted(map(tuple, self.spark.read.parquet(str(self.path / "out")).select(*LOOP).collect()))


def test_retry_loops_over_restarts_equal_the_batch_operator(spark, tmp_path):
    rnd = random.Random(5)
    rows = [
        (rnd.choice(["hot", "hot", "b", "c"]), pos, rnd.choice("TU"), rnd.choice("xy"), rnd.random() < 0.9, rnd.randrange(2))
        for pos in range(300)
    ]
    rows += [("tail", 300 + k, "T", "x", True, 1) for k in range(4)]
    feed = Feed(spark, tmp_path)
    for start in range(0, len(rows), 76):
        feed.land(steps(spark, rows[start:start + 76]))
        feed.drain()
    want = batch_loops(spark, rows)
    assert len(want) > 5 and len({w[1] for w in want}) == 2
    # What a later result ended is out already; the last session is still open.
    early = feed.found()
    assert set(early) < set(want) and ("tail", "T", "x", 4, 4, 300) not in early
    feed.land(streams.heartbeat(steps(spark, rows), "at", "2 HOURS"))
    assert feed.drain().late_rows == 0
    assert feed.found() == want
    feed.drain()
    assert feed.found() == want


def test_an_idle_session_is_closed_by_its_timer(spark, tmp_path):
    feed = Feed(spark, tmp_path, late="1 SECOND", idle="1 MINUTE")
    feed.land(steps(spark, [("idle", k, "T", "x", True, 0) for k in range(3)]))
    feed.drain()
    assert feed.found() == []
    feed.land(steps(spark, [("busy", 500, "T", "x", True, 0)]))
    found = feed.drain()
    assert feed.found() == [("idle", "T", "x", 3, 0, 0)]
    # Only the busy session is held, as one value and its timer's entries.
    assert min(found.state_rows.values()) <= 3


def test_a_session_that_goes_on_after_its_timer_starts_anew(spark, tmp_path):
    feed = Feed(spark, tmp_path, late="1 SECOND", idle="1 MINUTE")
    for rows in ([("s", k, "T", "x", True, 0) for k in range(3)], [("o", 500, "T", "x", False, 0)], [("s", 900 + k, "T", "x", True, 1) for k in range(3)]):
        feed.land(steps(spark, rows))
        feed.drain()
    feed.land(streams.heartbeat(steps(spark, [("s", 903, "T", "x", True, 1)]), "at", "1 HOUR"))
    feed.drain()
    assert feed.found() == [("s", "T", "x", 3, 0, 0), ("s", "T", "x", 3, 3, 900)]


def test_unanswered_use_comes_out_after_its_time(spark, tmp_path):
    uses, results = str(tmp_path / "uses"), str(tmp_path / "results")

    def timed(rows, schema):
        df = spark.createDataFrame(rows, schema)
        return df.select(*[F.to_timestamp(c).alias(c) if c.endswith("time") else F.col(c) for c in df.columns])

    asked = timed([("a", "2026-01-01 00:00:00"), ("b", "2026-01-01 00:01:00"), ("b", "2026-01-01 02:00:00")], "use_id string, use_time string")
    said = timed([("a", "2026-01-01 00:00:30"), ("a", "2026-01-01 00:10:00"), ("x", "2026-01-01 00:10:00")], "result_of string, result_time string")
    asked.write.parquet(uses)
    said.write.parquet(results)

    def drain():
        left = spark.readStream.schema(asked.schema).parquet(uses)
        right = spark.readStream.schema(said.schema).parquet(results)
        streams.drain(streams.answered_uses(left, right, "1 HOUR", "1 minute"), str(tmp_path / "out"), str(tmp_path / "mark"))
        return sorted(((r.use_id, r.use_time.hour, r.result_of) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=repr)

    assert drain() == [("a", 0, "a"), ("a", 0, "a")]
    # One side's heartbeat alone doesn't move the watermark that both share.
    streams.heartbeat(asked, "use_time", "3 HOURS").write.mode("append").parquet(uses)
    assert ("b", 2, None) not in drain()
    streams.heartbeat(said, "result_time", "9 HOURS").write.mode("append").parquet(results)
    streams.heartbeat(asked, "use_time", "9 HOURS").write.mode("append").parquet(uses)
    assert drain() == [("a", 0, "a"), ("a", 0, "a"), ("b", 0, None), ("b", 2, None)]


def test_a_heartbeat_of_nothing_is_nothing(spark):
    assert streams.heartbeat(steps(spark, []), "at", "1 HOUR").count() == 0


@pytest.fixture
def one_shuffle_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_daily_counts_keep_flat_state_and_count_late_rows(spark, tmp_path, one_shuffle_partition):
    """A hundred batches, half a day each; the state holds the days that are open, not those that passed."""
    (tmp_path / "in").mkdir()
    start = 1_700_006_400_000_000  # midnight

    def land(k, micros):
        file = str(tmp_path / "in" / f"{k:03}.parquet")
        at = pa.array(micros, pa.timestamp("us", tz="UTC"))
        pq.write_table(pa.table({"at": at, "kind": pa.array(["a"] * len(micros))}), file)
        os.utime(file, (1_600_000_000 + k, 1_600_000_000 + k))

    half = 43_200_000_000
    for k in range(100):
        land(k, [start + k * half + 1, start + k * half + 2])

    def drain():
        rows = spark.readStream.schema("at timestamp, kind string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        counts = streams.daily_counts(rows, "at", ["kind"], "1 day")
        return streams.drain(counts, str(tmp_path / "out"), str(tmp_path / "mark"))

    found = drain()
    assert len(found.state_rows) >= 100 and max(found.state_rows.values()) <= 3
    assert found.late_rows == 0
    days = spark.read.parquet(str(tmp_path / "out"))
    assert days.count() >= 48 and {r.events for r in days.collect()} == {4}
    land(100, [start + 5 * half])
    assert drain().late_rows == 1
    assert spark.read.parquet(str(tmp_path / "out")).count() == days.distinct().count()


def test_repeated_responses_come_once(spark, tmp_path):
    path = str(tmp_path / "ev")
    rows = [("m1", "2026-01-01 01:00:00"), ("m1", "2026-01-01 02:00:00"), ("m2", "2026-01-02 01:00:00")]
    df = spark.createDataFrame(rows, "message_id string, at string").withColumn("at", F.to_timestamp("at"))
    df.write.parquet(path)
    once = streams.distinct_responses(spark.readStream.schema(df.schema).parquet(path), "at", "1 day")
    streams.drain(once, str(tmp_path / "out"), str(tmp_path / "mark"))
    assert sorted(r.message_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["m1", "m2"]
