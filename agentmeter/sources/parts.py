"""The ``part`` table: session_id, time_created (ms) and a JSON document.

The table may come from any Spark source; JDBC readers push the projection
down, so only the columns named here leave the database.
"""

from pyspark.sql import DataFrame, SparkSession


def read_parts(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    reader = spark.read.format(fmt).options(**options)
    loaded = reader.load(path) if path else reader.load()
    return loaded.select("session_id", "time_created", "data")
