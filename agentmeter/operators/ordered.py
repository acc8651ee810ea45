"""Order-dependent operators that stay bounded when one key is huge.

A window over a key would sort everything that key owns in one task. Rows carry
``chunk`` (any orderable value, monotone with scan order and holding a bounded
number of rows: a file split, a range of row ids) and ``pos``/``idx`` inside it.
Every window over rows runs over (key, chunk), for every key alike; one summary
row per chunk crosses chunks and comes back by a join on (key, chunk), which is the
partitioning the rows already have. So wide rows are shuffled once.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentmeter.session import landed

ORDER = ("chunk", "pos", "idx")


def _up_to_here(*keys, order):
    return (
        Window.partitionBy(*keys)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def latest_before(sources: DataFrame, probes: DataFrame, key: str, hit: str) -> DataFrame:
    """Each probe with the latest earlier source row of the same key.

    A source in the same position counts as earlier. Probes keep every row;
    ``hit`` is a struct of the source's columns, NULL when there is none.
    """
    payload = [c for c in sources.columns if c not in (key, *ORDER)]
    carried = [c for c in probes.columns if c not in (key, *ORDER)]
    name = F.coalesce(F.col(key), F.lit("")).alias(key)
    source_rows = sources.select(
        name, *ORDER, F.lit(0).alias("_side"), F.struct(*payload).alias("_source")
    )
    probe_rows = probes.select(
        name, *ORDER, F.lit(1).alias("_side"), F.struct(*carried).alias("_probe")
    )
    in_chunk = _up_to_here(key, "chunk", order=("pos", "_side", "idx"))
    local = (
        source_rows.unionByName(probe_rows, allowMissingColumns=True)
        .withColumn("_local", F.last("_source", ignorenulls=True).over(in_chunk))
        .filter("_side = 1")
    )
    # What each chunk hands on is its last source; a chunk's probes see the
    # sources of strictly earlier chunks, so asking comes before answering.
    tails = source_rows.groupBy(key, "chunk").agg(
        F.max_by("_source", F.struct("pos", "idx")).alias("_tail")
    )
    asking = probes.select(name, "chunk").distinct()
    line = tails.withColumn("_turn", F.lit(1)).unionByName(
        asking.withColumn("_turn", F.lit(0)), allowMissingColumns=True
    )
    carry = (
        line.withColumn(
            "_carry",
            F.last("_tail", ignorenulls=True).over(_up_to_here(key, order=("chunk", "_turn"))),
        )
        .filter("_turn = 0")
        .select(key, "chunk", "_carry")
    )
    return local.join(carry, [key, "chunk"], "left").select(
        F.col(key), *[F.col(c) for c in ORDER], F.col("_probe.*"), F.coalesce("_local", "_carry").alias(hit)
    )


def fill_forward(
    rows: DataFrame, keys: Sequence[str], value: Column, out: str, order: Sequence[str] = ("pos",)
) -> DataFrame:
    """Last non-NULL ``value`` at or before each row. Keys must not be NULL."""
    valued = rows.withColumn("_value", value)
    in_chunk = _up_to_here(*keys, "chunk", order=order)
    local = valued.withColumn("_local", F.last("_value", ignorenulls=True).over(in_chunk))
    carry = (
        valued.groupBy(*keys, "chunk")
        .agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_tail"))
        .select(*keys, "chunk", F.last("_tail", ignorenulls=True).over(_before(*keys)).alias("_carry"))
    )
    return (
        local.join(carry, [*keys, "chunk"], "left")
        .withColumn(out, F.coalesce("_local", "_carry"))
        .select(*rows.columns, out)
    )


def _before(*keys):
    return (
        Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    )


def rank_within(rows: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """1-based position inside each key, in (chunk, order). Keys must not be NULL.

    Counted per chunk: ranks inside a chunk plus the rows before it.
    """
    local = rows.withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*keys, "chunk").orderBy(*order))
    )
    offsets = (
        rows.groupBy(*keys, "chunk")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*keys, "chunk", F.coalesce(F.sum("_rows").over(_before(*keys)), F.lit(0)).alias("_skip"))
    )
    return (
        local.join(offsets, [*keys, "chunk"])
        .withColumn(out, F.col("_rank") + F.col("_skip"))
        .drop("_rank", "_skip")
    )


def numbered(rows: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """``out``: the place of each row in ``order`` over all rows, from 1 and without gaps.

    Rows are dealt to partitions by range and counted there; only the partitions' sizes, a row each,
    are summed up in one place. Rows that compare equal are numbered in any order.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = landed(dealt.withColumns({"_part": F.spark_partition_id(), "_at": within}), "placed")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    skips = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_skip"))
    return placed.join(skips, "_part").withColumn(out, F.col("_at") + F.col("_skip") + 1).drop("_part", "_at", "_skip")


def running_sum(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str
) -> DataFrame:
    """``value`` summed up to and with each row of its key, in (chunk, order). Keys must not be NULL."""
    local = rows.withColumn("_sum", F.sum(value).over(_up_to_here(*keys, "chunk", order=order)))
    offsets = (
        rows.groupBy(*keys, "chunk")
        .agg(F.sum(value).alias("_chunk_sum"))
        .select(*keys, "chunk", F.coalesce(F.sum("_chunk_sum").over(_before(*keys)), F.lit(0)).alias("_carried"))
    )
    return (
        local.join(offsets, [*keys, "chunk"])
        .withColumn(out, F.col("_sum") + F.col("_carried"))
        .drop("_sum", "_carried")
    )


def _numbered_runs(rows: DataFrame, keys: Sequence[str], order: Sequence[str], state: Sequence[str]) -> DataFrame:
    same = F.struct(*state)
    ordered = Window.partitionBy(*keys).orderBy(*order)
    starts = (~F.lag(same).over(ordered).eqNullSafe(same)).cast("int")
    return rows.withColumn("_start", starts).withColumn(
        "_run", F.sum("_start").over(_up_to_here(*keys, order=order))
    )


def collapse_runs(
    rows: DataFrame, keys: Sequence[str], state: Sequence[str], sums: Sequence[str]
) -> DataFrame:
    """Maximal runs of consecutive rows with equal state inside each key.

    One row per run: keys, state, ``chunk``/``pos`` of its first row, and the
    summed measures. Keys must not be NULL. Runs are found inside each chunk and
    then stitched: only the first and the last run of a chunk can continue in
    another one, so only those meet.
    """
    runs = (
        _numbered_runs(rows, [*keys, "chunk"], ("pos", "idx"), state)
        .groupBy(*keys, "chunk", "_run", *state)
        .agg(F.min("pos").alias("pos"), *[F.sum(c).alias(c) for c in sums])
        .withColumn("_last", F.max("_run").over(Window.partitionBy(*keys, "chunk")))
    )
    on_edge = (F.col("_run") == 1) | (F.col("_run") == F.col("_last"))
    columns = [*keys, *state, "chunk", "pos", *sums]
    inner = runs.filter(~on_edge).select(*columns)

    same = F.struct(*state)
    across = Window.partitionBy(*keys).orderBy("chunk", "_run")
    continues = (
        (F.col("_run") == 1)
        & (F.lag("chunk").over(across) < F.col("chunk"))
        & F.lag(same).over(across).eqNullSafe(same)
    )
    stitched = (
        runs.filter(on_edge)
        .withColumn("_start", F.when(continues, 0).otherwise(1))
        .withColumn("_island", F.sum("_start").over(_up_to_here(*keys, order=("chunk", "_run"))))
        .groupBy(*keys, "_island", *state)
        .agg(
            F.min(F.struct("chunk", "pos")).alias("_first"),
            *[F.sum(c).alias(c) for c in sums],
        )
        .select(*keys, *state, "_first.chunk", "_first.pos", *sums)
    )
    return inner.unionByName(stitched)


def first_per_key(rows: DataFrame, key: str, count: str) -> DataFrame:
    """The earliest row of each key and how many rows the key had.

    An aggregate, not a ranking window: partial results combine before the
    shuffle, so a key with any number of copies costs one row per map task.
    """
    order = [c for c in ORDER if c in rows.columns]
    rest = [c for c in rows.columns if c != key]
    return (
        rows.groupBy(key)
        .agg(
            F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"),
            F.count(F.lit(1)).alias(count),
        )
        .select(key, "_first.*", count)
    )


def last_per_key(rows: DataFrame, key: str) -> DataFrame:
    order = [c for c in ORDER if c in rows.columns]
    rest = [c for c in rows.columns if c != key]
    return (
        rows.groupBy(key)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
        .select(key, "_last.*")
    )
