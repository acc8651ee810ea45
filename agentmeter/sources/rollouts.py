"""Rollout transcripts: JSONL whose records belong to the last session header."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agentmeter import model
from agentmeter.operators.ordered import fill_forward
from agentmeter.sources.transcripts import JSONL_GLOB, plain_path, scan_chunk

_RFC3339 = (
    r"^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2})(?:[.,](\d+))?(?:Z|([+-])(\d{2}):(\d{2}))$"
)


def json_text(value: Column, path: str) -> Column:
    """A string field of a VARIANT; NULL when absent or not a string."""
    found = F.try_variant_get(value, path, "variant")
    return F.when(
        F.schema_of_variant(found) == "STRING", F.try_variant_get(value, path, "string")
    )


def typed_fields(payload: Column, *names: str) -> Column:
    """Fields of a JSON object as a struct of VARIANTs.

    Each is read by itself: of a key that occurs twice the last value counts, and a value in which a key
    occurs twice, which no VARIANT can hold, loses that field only.
    """
    return F.from_json(payload, ", ".join(f"{name} VARIANT" for name in names))


def field_text(value: Column) -> Column:
    """The text of a VARIANT that is a string; NULL for any other."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def normalise_timestamp(ts: Column) -> Column:
    """RFC 3339 as a fixed nine-digit UTC string that sorts by time; NULL when
    it is not one. Nanoseconds survive because only whole seconds are shifted."""
    part = lambda i: F.regexp_extract(ts, _RFC3339, i)
    local = F.concat(part(1), F.lit(" "), part(2)).try_cast("timestamp_ntz")
    sign = F.when(part(4) == "-", F.lit(-1)).otherwise(F.lit(1))
    hours = F.coalesce(part(5).try_cast("int"), F.lit(0)) * sign
    minutes = F.coalesce(part(6).try_cast("int"), F.lit(0)) * sign
    utc = (local - F.make_dt_interval(F.lit(0), hours, minutes)).cast("string")
    seconds = F.concat(F.substring(utc, 1, 10), F.lit("T"), F.substring(utc, 12, 8))
    fraction = F.rpad(F.substring(part(3), 1, 9), 9, "0")
    return F.when(
        F.rlike(ts, F.lit(_RFC3339)) & local.isNotNull(),
        F.concat(seconds, F.lit("."), fraction, F.lit("Z")),
    )


def read_rollouts(spark: SparkSession, directory: str, glob: str = JSONL_GLOB) -> DataFrame:
    raw = (
        spark.read.schema(model.CODEX_SCHEMA)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .option("lineSep", "\n")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(directory)
    )
    return raw.select(
        scan_chunk().alias("chunk"),
        F.monotonically_increasing_id().alias("pos"),
        plain_path(F.col("_metadata.file_path")).alias("file"),
        "type",
        "timestamp",
        "payload",
        F.col("_corrupt_record").isNotNull().alias("is_broken"),
    )


def scope(records: DataFrame) -> DataFrame:
    """Each usable record with the session it belongs to.

    A session header opens a session for the records after it in the file; a
    malformed header closes the open one, so its records stay unscoped rather
    than being charged to the session before. ``status`` is ok, malformed or
    unscoped.
    """
    usable = (
        ~F.col("is_broken")
        & (F.coalesce(F.col("type"), F.lit("")) != "")
        & F.startswith(F.coalesce(F.col("payload"), F.lit("")), F.lit("{"))
    )
    header = F.coalesce(field_text(typed_fields(F.col("payload"), "id")["id"]), F.lit(""))
    is_header = usable & (F.col("type") == "session_meta")
    scoped = fill_forward(records, ["file"], F.when(is_header, header), "_session")
    session = F.nullif(F.col("_session"), F.lit(""))
    bad = ~usable | (is_header & (header == ""))
    ts = normalise_timestamp(F.col("timestamp"))
    given = F.coalesce(F.col("timestamp"), F.lit("")) != ""
    in_session = usable & session.isNotNull()
    return scoped.withColumns(
        {
            "session": session,
            "is_malformed": bad,
            "status": F.when(~usable, F.lit("malformed"))
            .when(session.isNull(), F.lit("unscoped"))
            .otherwise(F.lit("ok")),
            "is_invalid_time": in_session & given & ts.isNull(),
            "is_unknown": in_session & ~F.col("type").isin(*model.CODEX_EVENT_TYPES),
            "is_header": is_header & (header != ""),
            "ts": F.coalesce(ts, F.lit("")),
        }
    ).drop("_session", "is_broken")


def record_quality(scoped: DataFrame) -> DataFrame:
    per_file = scoped.groupBy("file").agg(
        F.count_if("is_malformed").alias("parse_errors"),
        F.count_if("is_invalid_time").alias("invalid_times"),
        F.count_if(F.col("status") == "unscoped").alias("unscoped_records"),
        F.count_if("is_unknown").alias("unknown_events"),
        F.max("is_header").alias("is_rollout"),
    )
    zero = F.lit(0)
    total = lambda c: F.coalesce(F.sum(c), zero).alias(c)
    return per_file.agg(
        F.count_if("is_rollout").alias("files"),
        F.count_if(~F.col("is_rollout")).alias("excluded_files"),
        *[total(c) for c in ("parse_errors", "invalid_times", "unscoped_records", "unknown_events")],
    )


def require_sessions(quality: DataFrame, directory: str = "") -> None:
    """Refuse a corpus in which no file has a session header: it is empty or of another kind."""
    found = quality.first()
    if not found.files:
        raise ValueError(
            f"no session header with an id in {directory or 'the rollout files'}: "
            f"{found.excluded_files} files, {found.parse_errors} malformed records"
        )
