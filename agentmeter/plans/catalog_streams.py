"""Streaming forms, each fed over several runs: rows are landed in scan order, every run goes on from
the checkpoint of the one before, and a heartbeat closes what is open."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentmeter.plans.catalog import query
from agentmeter.plans.catalog_calls import loops_sql
from agentmeter.session import scratch_path
from agentmeter.streaming import loops, streams

SLICES = 2


class _Landing:
    """A landing folder that a table's rows come into slice by slice."""

    def __init__(self, rows: DataFrame, time: str, order: str, ahead: str):
        self.rows, self.time, self.order, self.ahead = rows, time, order, ahead
        self.spark = rows.sparkSession
        self.path = scratch_path(self.spark, "landing")
        seconds = F.col(order).cast("timestamp").cast("double") if order == time else F.col(order)
        self.bounds = rows.select(seconds.alias("o")).agg(F.min("o"), F.max("o")).first()
        self.seconds = seconds

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(self.rows.schema).parquet(self.path)

    def land(self, k: int) -> None:
        """Slice ``k``, and with the last the heartbeat."""
        low, high = self.bounds
        mine = self.rows
        if low is not None:
            part = F.floor((self.seconds - low) * SLICES / (high - low + 1))
            mine = mine.where(F.coalesce(part, F.lit(0)) == k)
        if k == SLICES - 1:
            mine = mine.unionByName(streams.heartbeat(self.rows, self.time, self.ahead))
        mine.write.mode("append").parquet(self.path)


def _drained(t, landings: list[_Landing], build, keyed: bool = False) -> DataFrame:
    out, mark = scratch_path(t.spark, "stream-out"), scratch_path(t.spark, "stream-mark")
    for k in range(SLICES):
        for landing in landings:
            landing.land(k)
        rows = build(*(landing.stream() for landing in landings))
        streams.drain(rows, out, mark, keyed=keyed)
    return t.spark.read.schema(rows.schema).parquet(out)


@query(
    "stream_daily_counts",
    "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events FROM events GROUP BY ALL",
)
def _(t):
    events = t.table("events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    landing = _Landing(events, "ts", "ts", "4 DAYS")
    return _drained(t, [landing], lambda rows: streams.daily_counts(rows, "ts", ["event_type"], "2 days"))


@query("stream_distinct_responses", "SELECT DISTINCT message_id FROM usage")
def _(t):
    usage = t.usage.select("message_id", F.to_timestamp("ts").alias("at"), "pos")
    landing = _Landing(usage, "at", "pos", "1 DAY")
    distinct = lambda rows: streams.distinct_responses(rows, "at", "90 days").select("message_id")
    return _drained(t, [landing], distinct).where("message_id IS NOT NULL")


def _answers_sql(within: str) -> str:
    return f"""SELECT o_orderkey AS use_id, l_linenumber, l_orderkey IS NOT NULL AS answered
       FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey
         AND l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL {within}"""


def _answers(t, within: str, beyond: str) -> DataFrame:
    """Orders as calls, line items as results."""
    uses = t.table("orders").select(
        F.col("o_orderkey").alias("use_id"), F.col("o_orderdate").cast("timestamp").alias("use_time")
    )
    results = t.table("lineitem").select(
        F.col("l_orderkey").alias("result_of"), F.col("l_shipdate").cast("timestamp").alias("result_time"), "l_linenumber"
    )
    # The later landing's first slice may hold times beyond the other's, so both wait for the slower watermark.
    landings = [_Landing(uses, "use_time", "use_time", beyond), _Landing(results, "result_time", "result_time", beyond)]
    joined = _drained(t, landings, lambda left, right: streams.answered_uses(left, right, within, "1 day"))
    return joined.select("use_id", "l_linenumber", F.col("result_of").isNotNull().alias("answered"))


@query("stream_answered_uses", _answers_sql("700 DAY"))
def _(t):
    return _answers(t, "700 DAYS", "800 DAYS")


@query("stream_unanswered_uses", f"SELECT use_id FROM ({_answers_sql('7 DAY')}) WHERE NOT answered")
def _(t):
    """Calls that no result answered within a week."""
    return _answers(t, "7 DAYS", "200 DAYS").where("NOT answered").select("use_id")


@query("stream_retry_loops", loops_sql(False))
def _(t):
    """The batch operator's loops, found while the joined results come in."""
    steps = t.matched.select(
        "session", "chunk", "pos", "idx", "tool", "hash", "is_error",
        (F.col("denial") != "").cast("int").alias("denied"), F.to_timestamp("ts").alias("at"),
    )
    landing = _Landing(steps, "at", "pos", "400 DAYS")
    found = _drained(t, [landing], lambda rows: loops.retry_loops(rows, "90 DAYS", "1 DAY"), keyed=True)
    return found.select("session", "tool", "hash", "streak", "denied", "pos")
