"""Structured Streaming forms of the counters, the dedupe and the use-to-result join, and how they are run.

Sources are topics or landing tables: a file source sees new files, not lines
appended to old ones, so live transcripts are landed as micro-files first.

Everything here appends, so state goes as the watermark passes it. What a stream still holds when its
corpus is complete comes out after a ``heartbeat``: a row without any value but its time, far enough
ahead that the watermark passes all that came before.
"""

from collections.abc import Iterator
from contextlib import contextmanager, nullcontext
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def daily_counts(events: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """Events per day and key. A day comes out, and leaves the state, once the watermark passes it.

    A row later than ``late`` behind the newest one is counted by ``Drained.late_rows``, not here. Rows
    without a time have no day.
    """
    return (
        events.withWatermark(time, late)
        .groupBy(F.window(time, "1 day").alias("w"), *keys)
        .agg(F.count(F.lit(1)).alias("events"))
        .select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), *keys, "events")
    )


def distinct_responses(usage: DataFrame, time: str, late: str) -> DataFrame:
    """Repeated responses dropped while copies can still arrive."""
    return usage.withWatermark(time, late).dropDuplicatesWithinWatermark(["message_id"])


def answered_uses(
    uses: DataFrame, results: DataFrame, answer_within: str, late: str
) -> DataFrame:
    """Calls with their results; a call nobody answers in time comes out with a
    NULL result, once both watermarks are past its time. Needs (use_id, use_time) and (result_of, result_time)."""
    left = uses.withWatermark("use_time", late)
    right = results.withWatermark("result_time", late)
    in_time = (F.col("result_time") >= F.col("use_time")) & (
        F.col("result_time") <= F.col("use_time") + F.expr(f"INTERVAL {answer_within}")
    )
    # Were it joined by the bare column, rows without one, heartbeats among them, would be dropped before they
    # could move the watermark.
    named = F.coalesce(F.col("result_of").cast("string"), F.lit("\0"))
    joined = left.join(right, (F.col("use_id").cast("string") == named) & in_time, "left_outer")
    # A heartbeat is no call. The time in the condition keeps it behind the watermark.
    return joined.where(F.col("use_id").isNotNull() | F.col("use_time").isNull())


def heartbeat(rows: DataFrame, time: str, ahead: str) -> DataFrame:
    """One row of ``rows``' columns, all NULL but ``time``: the newest one and ``ahead`` more. No rows give none."""
    newest = rows.agg(F.max(time).alias("_newest")).where("_newest IS NOT NULL")
    moved = (F.col("_newest") + F.expr(f"INTERVAL {ahead}")).cast(rows.schema[time].dataType)
    return newest.select(
        *[moved.alias(f.name) if f.name == time else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields]
    )


@dataclass
class Drained:
    """What the batches of one run reported, by batch."""

    state_rows: dict[int, int] = field(default_factory=dict)
    dropped: dict[int, int] = field(default_factory=dict)

    @property
    def late_rows(self) -> int:
        """Rows that came after the watermark had closed their time. Rows of one key and day that a task had
        already counted together are one here."""
        return sum(self.dropped.values())

    def _read(self, progress: list) -> None:
        for p in progress:
            operators = p["stateOperators"]
            self.state_rows[p["batchId"]] = sum(o["numRowsTotal"] for o in operators)
            # A batch that ran again after a failure reports again.
            self.dropped[p["batchId"]] = sum(o["numRowsDroppedByWatermark"] for o in operators)


@contextmanager
def _keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state needs, for queries started meanwhile."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def drain(rows: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, keyed: bool = False) -> Drained:
    """Append what ``rows`` gives for all that its sources hold now to the Parquet folder ``path``.

    Called again with the same ``checkpoint`` it goes on where it was, after a failure too, and adds nothing twice.
    ``keyed`` state (``loops``) needs the RocksDB store; other queries keep the session's.
    """
    with _keyed_state(rows.sparkSession) if keyed else nullcontext():
        query = (
            rows.writeStream.format("parquet")
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
    found = Drained()
    # Progress is kept for the last hundred batches only.
    while not query.awaitTermination(2):
        found._read(query.recentProgress)
    found._read(query.recentProgress)
    return found
