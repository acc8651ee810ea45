"""The one output shape: metric rows, warnings and a run header."""

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agentmeter import model
from agentmeter.functions.numbers import concern, percent
from agentmeter.operators.ordered import numbered

METRIC_COLUMNS = (
    "command",
    "ord",
    "name",
    "dimension",
    "key",
    "value_long",
    "value_double",
    "unit",
    "derivation",
    "method",
)


@dataclass(frozen=True)
class Measure:
    """One metric read off a column of a wide table."""

    name: str
    value: Column
    unit: str
    real: bool = False
    method: str | None = None


def unpivot(
    wide: DataFrame,
    command: str,
    section: int,
    dimension: str | Column,
    key: Column,
    measures: Sequence[Measure],
    heaviest: Sequence[Column] = (),
) -> DataFrame:
    """One row per measured value; a NULL value yields no row at all.

    ``ord`` is a sortable struct (section, heaviest first, key, position), so a
    full ordering is a range-partitioned sort and never a global row number.
    """
    dim = F.lit(dimension) if isinstance(dimension, str) else dimension
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("at"),
                F.lit(m.name).alias("name"),
                (F.lit(None) if m.real else m.value).cast("bigint").alias("value_long"),
                (m.value if m.real else F.lit(None)).cast("double").alias("value_double"),
                F.lit(m.unit).alias("unit"),
                F.lit(model.ESTIMATED if m.method else model.MEASURED).alias("derivation"),
                F.lit(m.method).cast("string").alias("method"),
            )
            for i, m in enumerate(measures)
        ]
    )
    weights = F.array(*[-c.cast("bigint") for c in heaviest]).cast("array<bigint>")
    return (
        wide.select(
            dim.alias("dimension"),
            key.cast("string").alias("key"),
            weights.alias("_weights"),
            F.explode(rows).alias("_m"),
        )
        .filter("_m.value_long is not null or _m.value_double is not null")
        .select(
            F.lit(command).alias("command"),
            F.struct(
                F.lit(section).alias("section"),
                F.col("_weights").alias("weights"),
                F.col("key").alias("key"),
                F.col("_m.at").alias("at"),
            ).alias("ord"),
            F.col("_m.name").alias("name"),
            "dimension",
            "key",
            F.col("_m.value_long").alias("value_long"),
            F.col("_m.value_double").alias("value_double"),
            F.col("_m.unit").alias("unit"),
            F.col("_m.derivation").alias("derivation"),
            F.col("_m.method").alias("method"),
        )
    )


def corpus_rows(
    one_row: DataFrame, command: str, section: int, measures: Sequence[Measure]
) -> DataFrame:
    return unpivot(one_row, command, section, "corpus", F.lit(""), measures)


def stack_rows(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def warning_rows(source: DataFrame, command: str, code: str, text: Column, order: Column | None = None) -> DataFrame:
    return source.select(
        F.lit(command).alias("command"),
        F.lit(code).alias("code"),
        (F.lit("") if order is None else order.cast("string")).alias("key"),
        text.alias("text"),
    )


@dataclass(frozen=True)
class Envelope:
    command: str
    metrics: DataFrame
    warnings: DataFrame
    header: DataFrame

    def write(self, path: str, fmt: str = "parquet") -> None:
        """Three folders below ``path``; metric rows leave in ``ord`` order."""
        checked = self.metrics.transform(validated)
        ordered = checked.orderBy("command", "ord")
        self.header.write.format(fmt).mode("overwrite").save(f"{path}/header")
        ordered.write.format(fmt).mode("overwrite").save(f"{path}/metrics")
        self.warnings.orderBy("command", "code", "key").write.format(fmt).mode("overwrite").save(
            f"{path}/warnings"
        )


    def ordered(self) -> DataFrame:
        """The metric rows with their ``place`` in the report, from 1 and without gaps."""
        return numbered(self.metrics, ["command", "ord"], "place")

    def write_run(self, path: str, run: str, fmt: str = "parquet") -> None:
        """The report as one run of the tables below ``path``: header, metrics with their place, warnings and refused rows.

        Rows that break the contract are set apart with the reason, not written among the others. A run that is
        written again replaces itself and nothing else.
        """
        bad = violations(self.metrics)
        sound = self.metrics.join(bad.select("command", "ord").distinct(), ["command", "ord"], "left_anti")
        tables = {
            "header": self.header,
            "metrics": numbered(sound.select(*METRIC_COLUMNS), ["command", "ord"], "place"),
            "warnings": self.warnings,
            "refused": bad.withColumn("reason", _reason()),
        }
        for name, rows in tables.items():
            rows.write.format(fmt).mode("overwrite").save(f"{path}/{name}/run={run}")


def read_runs(spark: SparkSession, path: str, table: str, fmt: str = "parquet") -> DataFrame:
    """One table of all runs that ``Envelope.write_run`` wrote below ``path``, with the column ``run``."""
    return spark.read.format(fmt).option("basePath", f"{path}/{table}").load(f"{path}/{table}")


def _reason() -> Column:
    known = F.coalesce(F.col("derivation").isin(model.MEASURED, model.ESTIMATED), F.lit(False))
    return F.when(known, F.lit("an estimate without a method")).otherwise(F.lit("neither measured nor estimated"))


def violations(metrics: DataFrame) -> DataFrame:
    """Rows that break the contract: an unknown derivation, or an estimate
    that does not name its method."""
    known = F.coalesce(F.col("derivation").isin(model.MEASURED, model.ESTIMATED), F.lit(False))
    unnamed = (F.col("derivation") == model.ESTIMATED) & (
        F.coalesce(F.col("method"), F.lit("")) == ""
    )
    return metrics.filter(~known | unnamed)


def validated(metrics: DataFrame) -> DataFrame:
    """The same rows; evaluating one that breaks the contract raises."""
    known = F.coalesce(F.col("derivation").isin(model.MEASURED, model.ESTIMATED), F.lit(False))
    named = (F.col("derivation") != model.ESTIMATED) | (
        F.coalesce(F.col("method"), F.lit("")) != ""
    )
    broken = F.concat_ws("/", F.lit("metric without derivation or method"), "name", "key")
    return metrics.withColumn(
        "derivation",
        F.when(known & named, F.col("derivation")).otherwise(F.raise_error(broken).cast("string")),
    )


def run_header(
    command: str, directory: str, version: str, window, corpus: DataFrame
) -> DataFrame:
    """``corpus`` is one row with files, bytes, first_ts and last_ts."""
    return corpus.select(
        F.lit(model.TOOL_NAME).alias("tool"),
        F.lit(model.SCHEMA_VERSION).alias("schema_version"),
        F.lit(version).alias("version"),
        F.lit(command).alias("command"),
        F.lit(directory).alias("dir"),
        F.col("files").cast("bigint").alias("files"),
        F.col("bytes").cast("bigint").alias("bytes"),
        F.substring(F.coalesce("first_ts", F.lit("")), 1, 10).alias("from"),
        F.substring(F.coalesce("last_ts", F.lit("")), 1, 10).alias("to"),
        F.lit(window.since).alias("since"),
        F.lit(window.until).alias("until"),
    )


def merge_reports(metrics: DataFrame, priority: Sequence[str]) -> DataFrame:
    """Union of several commands' rows: the first command in ``priority`` wins
    each (name, dimension, key). ``disagrees`` marks ids with unequal values."""
    rank = F.array_position(F.array(*[F.lit(c) for c in priority]), F.col("command"))
    value = F.coalesce(F.col("value_double"), F.col("value_long").cast("double"))
    rest = [c for c in METRIC_COLUMNS if c not in ("name", "dimension", "key")]
    return (
        metrics.withColumns({"_rank": rank, "_value": value})
        .groupBy("name", "dimension", "key")
        .agg(
            F.min_by(F.struct("_rank", *rest), F.col("_rank")).alias("_first"),
            (F.min("_value") != F.max("_value")).alias("disagrees"),
            F.count(F.lit(1)).alias("reporters"),
        )
        .select("name", "dimension", "key", "_first.*", "disagrees", "reporters")
        .withColumnRenamed("_rank", "command_rank")
    )


def disagreement_warnings(metrics: DataFrame, priority: Sequence[str]) -> DataFrame:
    """A row per later command whose value differs from the reported one."""
    value = F.coalesce(F.col("value_double"), F.col("value_long").cast("double"))
    kept = merge_reports(metrics, priority).filter("disagrees")
    kept = kept.select(
        "name", "dimension", "key", F.col("command").alias("kept_by"), value.alias("kept_value")
    )
    later = metrics.join(kept, ["name", "dimension", "key"]).filter(
        (F.col("command") != F.col("kept_by")) & (value != F.col("kept_value"))
    )
    text = F.concat(
        F.concat_ws("/", "name", "dimension", "key"),
        F.lit(" disagrees between "), F.col("kept_by"), F.lit(" ("), F.col("kept_value").cast("string"),
        F.lit(") and "), F.col("command"), F.lit(" ("), value.cast("string"),
        F.lit("); the "), F.col("kept_by"), F.lit(" value is reported"),
    )
    return warning_rows(later, "report", "disagreement", text, F.concat_ws("/", "name", "dimension", "key"))


def derivations(metrics: DataFrame) -> DataFrame:
    """The legend: how many rows of each metric were measured or estimated."""
    return metrics.groupBy(
        "name", "derivation", F.coalesce("method", F.lit("")).alias("method")
    ).agg(F.count(F.lit(1)).alias("rows"))


def top_per_dimension(
    rows: DataFrame, dimension: str, order: Sequence[Column], top: int = model.DEFAULT_TOP
) -> DataFrame:
    """The first ``top`` rows of each dimension plus how many there were.

    The rank filter lets Spark cut each partition to ``top`` rows before the
    shuffle; the totals are a separate combined count. 0 keeps every row.
    """
    totals = rows.groupBy(dimension).agg(F.count(F.lit(1)).alias("total"))
    if top > 0:
        place = F.row_number().over(Window.partitionBy(dimension).orderBy(*order))
        rows = rows.withColumn("place", place).filter(F.col("place") <= top)
    return rows.join(totals, dimension)


def share_of_total(rows: DataFrame, value: str, counted: Column | None = None) -> DataFrame:
    """``share_percent`` and ``grade`` of each row in the total of ``value``.

    Rows outside ``counted`` add nothing to the total and have no share.
    """
    inside = F.lit(True) if counted is None else counted
    whole = rows.agg(F.coalesce(F.sum(F.when(inside, F.col(value))), F.lit(0)).alias("_whole"))
    share = F.when(inside, percent(F.col(value), F.col("_whole")))
    return (
        rows.withColumn("_whole", whole.scalar())
        .withColumn("share_percent", share)
        .withColumn("grade", F.when(F.col("share_percent").isNotNull(), concern(F.col("share_percent"))))
        .drop("_whole")
    )


def share_within(rows: DataFrame, dimension: str, value: str, counted: Column) -> DataFrame:
    """The same share, taken inside each dimension."""
    whole = rows.groupBy(dimension).agg(
        F.coalesce(F.sum(F.when(counted, F.col(value))), F.lit(0)).alias("_whole")
    )
    share = F.when(counted, percent(F.col(value), F.col("_whole")))
    return (
        rows.join(whole, dimension)
        .withColumn("share_percent", share)
        .withColumn("grade", F.when(F.col("share_percent").isNotNull(), concern(F.col("share_percent"))))
        .drop("_whole")
    )


def version_drift(passes: DataFrame, first: str) -> DataFrame:
    """(command, files, bytes, first_files, first_bytes) of the passes that met other files than the pass ``first``.

    ``passes`` are ``transcripts.corpus_version`` rows. A file that was replaced or touched counts, also where
    number and bytes are as before.
    """
    base = passes.filter(F.col("command") == first)
    own = base.select(
        F.col("files").alias("first_files"), F.col("bytes").alias("first_bytes"), F.col("version").alias("_first")
    )
    return (
        passes.filter(F.col("command") != first)
        .join(own, F.col("version") != F.col("_first"))
        .select("command", "files", "bytes", "first_files", "first_bytes")
    )


def drift_warnings(drifted: DataFrame) -> DataFrame:
    text = F.concat(
        F.lit("the corpus changed while it was read: "), F.col("files").cast("string"), F.lit(" files with "),
        F.col("bytes").cast("string"), F.lit(" bytes, before "), F.col("first_files").cast("string"), F.lit(" with "),
        F.col("first_bytes").cast("string"),
    )
    return warning_rows(drifted, "report", "corpus_changed", text, F.col("command"))


def corpus_drift(headers: DataFrame, first: str) -> DataFrame:
    """Commands that read another corpus than the first one did."""
    base = headers.filter(F.col("command") == first)
    return (
        headers.filter(F.col("command") != first)
        .withColumns(
            {
                "first_files": base.select("files").scalar(),
                "first_bytes": base.select("bytes").scalar(),
            }
        )
        .filter("files <> first_files or bytes <> first_bytes")
        .select("command", "files", "bytes", "first_files", "first_bytes")
    )
