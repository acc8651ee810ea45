"""Session construction and the one place that decides where lineage is cut."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "agentmeter", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Settled rollups are deleted once nothing refers to them.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # Plans here are built from thousands of column calls; recording a Python
        # call site for each of them costs more than planning them.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session, whose
    executors share the driver's disk, gets a temporary folder where nothing is set.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not configured:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        configured = tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Materialise a reduced table that several outputs read.

    A reliable checkpoint keeps the expensive scan and join out of every
    consumer's plan, and the written copy outlives lost executors.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def landed(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back.

    For tables that joins read again: unlike a checkpoint the copy has statistics, and its
    readers see only the columns they use.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
