"""What the operators of this folder share: landing tables and turning batches into rows."""

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agentmeter.session import scratch_path


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def land(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Unlike a cached block the copy outlives lost executors, and its readers see
    its true size and only the columns they use.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    landed = df.sparkSession.read.schema(df.schema).parquet(path)
    landed.landed_at = path
    return landed


def drop(*landed: DataFrame) -> None:
    """Give back the space of tables that ``land`` wrote and nothing reads any more."""
    for df in landed:
        df.sparkSession.range(0).write.mode("overwrite").parquet(df.landed_at)


#: Spark's setting that a query's shuffle files go when it ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside give back the space of their shuffles when they end.

    Otherwise files stay until the driver happens to collect its garbage, which many queries in a row may not
    live to see. A query whose files are gone is worked out again if it is asked for once more.
    """
    before = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES_GO, before)


#: Bytes of a batch that Spark hands to Python at once; a longer row is a batch by itself.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Let the session cut Arrow batches by size: ten thousand whole texts may be more than a worker can hold."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, body): the text as UTF-8 bytes, null as it is; every other column is left behind."""
    small_batches(df.sparkSession)
    return df.select(F.col(key).alias("key"), F.col(text).cast("string").cast("binary").alias("body"))


def opened(df: DataFrame, text: str) -> DataFrame:
    """(row, body): the text by itself, and all other columns packed away from clashing names."""
    small_batches(df.sparkSession)
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns) if c != text]
    return df.select(F.struct(F.lit(0).alias("none"), *others).alias("row"), F.col(f"`{text}`").cast("string").alias("body"))


def closed(df: DataFrame, text: str, new: Column | None = None, length: str | None = None) -> list[Column]:
    """The columns of ``df`` out of (row, body) again; ``new``, where it isn't null, replaces the text.

    ``length`` (where there is such a column) then follows the text.
    """
    columns = []
    for i, c in enumerate(df.columns):
        value = F.col("body") if c == text else F.col("row")[f"c{i}"]
        if new is not None and c == text:
            value = F.coalesce(new, value)
        elif new is not None and c == length:
            value = F.coalesce(F.char_length(new).cast(df.schema[c].dataType), value)
        columns.append(value.alias(c))
    return columns


def bodies(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("body").cast(pa.binary()).to_pylist()


#: Bytes to lower-case word bytes or blanks.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(body: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and all beyond ASCII, with A-Z in lower case."""
    return (body or b"").translate(_FOLD).split()


#: What lets go of things that a Python worker keeps from task to task.
KEPT: list[Callable[[], None]] = []


def trim(keep: bool = True) -> None:
    """Give unused memory of this process back to the system; without ``keep`` also what is in ``KEPT``."""
    for forget in [] if keep else KEPT:
        forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run: Callable, keep: bool = False) -> Callable:
    """A mapInArrow function that leaves no unused memory behind: workers are kept for the stages that follow.

    It starts without what other stages left either, unless it is to ``keep`` what its own earlier tasks did.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim(keep)
        try:
            yield from run(batches)
        finally:
            trim()

    return tidied


def per_row(function: Callable[[bytes | None], tuple], kinds: list[pa.DataType]):
    """A mapInArrow function over (key, body) that appends ``function(body)``'s values to each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [function(body.as_py()) for body in batch.column("body")]
            columns = [pa.array([row[i] for row in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), *columns], names=[str(i) for i in range(len(kinds) + 1)]
            )

    return run
