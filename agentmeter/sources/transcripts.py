"""Append-only JSONL transcripts, from files to the silver tables.

Two scans read a corpus: the JSON source decodes events (handing nested regions
over as the exact bytes of the line) and the text source accounts for lines.
"""

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agentmeter import model
from agentmeter.functions import content, payload
from agentmeter.operators import attachments as attachment_ops
from agentmeter.session import settle
from agentmeter.sources.listing import list_level

JSONL_GLOB = "*.[jJ][sS][oO][nN][lL]"
SIDE_FILE_SCHEMA = "path STRING, length BIGINT"


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def read_events(spark: SparkSession, directory: str, glob: str = JSONL_GLOB) -> DataFrame:
    """One row per decoded line, in scan order by (chunk, pos).

    ``chunk`` is the file split, which bounds how many rows it can hold, and
    ``pos`` rises with the line order inside it. Both are taken on the scan
    itself, so store the result before using it in more than one plan.
    """
    raw = (
        spark.read.schema(model.EVENT_SCHEMA)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .option("lineSep", "\n")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(directory)
    )
    return raw.select(
        scan_chunk().alias("chunk"),
        F.monotonically_increasing_id().alias("pos"),
        plain_path(F.col("_metadata.file_path")).alias("file"),
        *[F.col(f.name) for f in model.EVENT_SCHEMA.fields],
    )


def _lines(spark: SparkSession, directory: str, glob: str) -> DataFrame:
    """(chunk, pos, file, line) of every line, without the white space around it."""
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .option("lineSep", "\n")
        .text(directory)
        .select(
            scan_chunk().alias("chunk"),
            F.monotonically_increasing_id().alias("pos"),
            plain_path(F.col("_metadata.file_path")).alias("file"),
            F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("line"),
        )
    )


def line_identity(spark: SparkSession, directory: str, glob: str = JSONL_GLOB) -> DataFrame:
    """(file, lines, blank_lines, events, journal_records, parse_errors, unknown_events), which account for every line:
    lines = blank + events + journal + errors. Files without a line have no row.

    A line is an event if it holds one JSON object, or ``null``, which is an event without a type. Anything else, arrays
    and plain values too, is an error. Lines are read as text, so each is judged once; ``read_events``, which keeps
    the source text of what it decodes, takes the objects in an array for events.
    """
    line = F.col("line")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    read = _lines(spark, directory, glob).withColumn("e", F.from_json(F.when(line != "", line), model.EVENT_SCHEMA, options))
    names = [f.name for f in model.EVENT_SCHEMA.fields if f.name != "_corrupt_record"]
    shaped = F.startswith(line, F.lit("{")) & F.col("e._corrupt_record").isNull()
    broken = F.when((line != "") & (line != "null") & ~shaped, line)
    judged = classify(read.select("file", "line", *[F.col(f"e.{n}").alias(n) for n in names], broken.alias("_corrupt_record")))
    filled = F.col("line") != ""
    return judged.groupBy("file").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(~filled).alias("blank_lines"),
        F.count_if(filled & ~F.col("is_broken") & ~F.col("is_journal")).alias("events"),
        F.count_if(filled & F.col("is_journal")).alias("journal_records"),
        F.count_if("is_broken").alias("parse_errors"),
        F.count_if(filled & F.col("is_unknown")).alias("unknown_events"),
    )


def corpus_version(spark: SparkSession, directory: str, command: str, glob: str = JSONL_GLOB) -> DataFrame:
    """(command, files, bytes, version), one row: what a pass over the corpus meets.

    ``version`` digests path, length and modification time of every file, whose contents are not read.
    """
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(directory)
        .select("path", "length", "modificationTime")
    )
    return found.agg(
        F.lit(command).alias("command"),
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
        F.coalesce(F.bit_xor(F.xxhash64("path", "length", "modificationTime")), F.lit(0)).alias("version"),
    )


def classify(events: DataFrame) -> DataFrame:
    """Adds ``is_broken``, ``is_journal`` and ``is_unknown`` to decoded lines."""
    broken = F.col("_corrupt_record").isNotNull()
    journal = (
        (_text("sessionId") == "")
        & (_text("agentId") != "")
        & (_text("key") != "")
        & _text("type").isin(*model.JOURNAL_TYPES)
    )
    return events.withColumns(
        {
            "is_broken": broken,
            "is_journal": ~broken & journal,
            "is_unknown": ~broken & ~journal & ~_text("type").isin(*model.KNOWN_TYPES),
        }
    )


def file_quality(classified: DataFrame) -> DataFrame:
    """Line counts per file. A hot file combines before the shuffle."""
    return classified.groupBy("file").agg(
        F.count_if(~F.col("is_journal")).alias("transcript_lines"),
        F.count_if("is_journal").alias("journal_records"),
        F.count_if("is_broken").alias("parse_errors"),
    )


def plain_path(path: Column) -> Column:
    """A file URL as the path it names, so listings and scans agree."""
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, "^file:/+", "/")


def scan_chunk() -> Column:
    """The file split a row came from, as text that sorts in walk order: path
    components compare one by one because their separator sorts lowest."""
    path = F.replace(plain_path(F.col("_metadata.file_path")), F.lit("/"), F.lit("\u0001"))
    block = F.lpad(F.col("_metadata.file_block_start").cast("string"), 19, "0")
    return F.concat(path, F.lit("\u0001"), block)


def glob_pattern(glob: str) -> str:
    """The regular expression for file paths whose name a scan with ``glob`` reads."""
    out, at, depth = [], 0, 0
    while at < len(glob):
        sign = glob[at]
        close = glob.find("]", at + 2) if sign == "[" else -1
        if sign == "*":
            out.append("[^/]*")
        elif sign == "?":
            out.append("[^/]")
        elif close > 0:
            inner = glob[at + 1 : close].replace("\\", "\\\\")
            out.append("[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]")
            at = close
        elif sign == "{":
            depth += 1
            out.append("(?:")
        elif sign == "}" and depth:
            depth -= 1
            out.append(")")
        elif sign == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(sign))
        at += 1
    return "(?:^|/)" + "".join(out) + "$"


def list_files(spark: SparkSession, directory: str, glob: str = JSONL_GLOB) -> DataFrame:
    """Path and length of every file that a scan with ``glob`` reads, and of empty ones.

    Scans skip zero-length files, yet an empty transcript counts as one.
    Tasks list the directories of one depth at a time and each depth is
    written before the next, so no listing is ever held by the driver.
    """
    frontier = spark.createDataFrame([(directory.rstrip("/"),)], "path STRING")
    levels = []
    while True:
        level = settle(
            frontier.repartition("path").mapInPandas(
                list_level, "path STRING, is_dir BOOLEAN, bytes BIGINT"
            )
        )
        levels.append(level.filter("not is_dir"))
        frontier = level.filter("is_dir").select("path")
        if frontier.isEmpty():
            break
    return (
        reduce(DataFrame.unionByName, levels)
        .filter(F.rlike("path", F.lit(glob_pattern(glob))))
        .select(F.regexp_replace("path", "^file:/+", "/").alias("file"), "bytes")
    )


def file_manifest(listing: DataFrame, quality: DataFrame) -> DataFrame:
    """Every file with its class. A file is excluded from the transcripts only
    when it holds journal records and nothing else."""
    unlisted = F.raise_error(F.concat(F.lit("a file was read that the listing lacks: "), "file"))
    joined = (
        listing.join(quality, "file", "full")
        .withColumn("bytes", F.coalesce("bytes", unlisted.cast("bigint")))
        .na.fill(0, ["transcript_lines", "journal_records", "parse_errors"])
    )
    excluded = (F.col("journal_records") > 0) & (F.col("transcript_lines") == 0)
    return joined.withColumns(
        {
            "is_transcript": ~excluded,
            "is_subagent": ~excluded & F.contains("file", F.lit("/subagents/")),
        }
    )


@dataclass(frozen=True)
class Corpus:
    """Silver tables of one corpus; every one of them carries chunk and pos."""

    events: DataFrame
    uses: DataFrame
    results: DataFrame
    usage: DataFrame
    bills: DataFrame
    attachments: DataFrame
    attachment_keys: DataFrame
    manifest: DataFrame
    side_files: DataFrame
    directory: str = ""


def _may_hold(json: str, text: str) -> Column:
    """Whether a JSON text can hold ``text``: as it is, or with escapes in it."""
    return F.contains(json, F.lit(text)) | F.contains(json, F.lit("\\u"))


def decode_lines(lines: DataFrame) -> DataFrame:
    """Everything any command needs from a line, decoded in one pass.

    Blocks, billed counts and attachment keys become nested columns beside the
    event's own fields, and the raw regions are dropped. Stored once, each
    silver table is a column-pruned view of the result.
    """
    attachment = F.when(
        (F.col("type") == "attachment") & (F.coalesce("attachment", F.lit("")) != ""), F.col("attachment")
    )
    # Only messages that ask for a tool are sent to Python, before parsing
    # makes the waiting rows wide.
    asking = F.when(_may_hold("message", '"tool_use"'), F.col("message"))
    hashed = lines.withColumn("hashes", payload.message_input_hashes(asking))
    parsed = attachment_ops.with_keys(hashed, attachment).withColumn(
        "m", F.from_json("message", model.MESSAGE_SCHEMA)
    )
    # Only blocks of these types are used, so other messages needn't be read again.
    of_use = _may_hold("message", '"tool_use"') | _may_hold("message", '"tool_result"')
    plain = F.from_json(F.when(of_use, F.col("message")), model.CONTENT_READINGS["text"])["content"]
    parsed = parsed.withColumn("plain", plain).withColumn("blocks", _message_blocks())
    answers = F.filter("blocks", lambda b: b["type"] == "tool_result")
    failed = F.filter(answers, lambda b: F.coalesce(b["is_error"], F.lit(False)))
    record = F.when(
        _may_hold("toolUseResult", "persistedOutputPath"), F.try_parse_json("toolUseResult")
    )
    kind = F.nullif(F.get_json_object(attachment, "$.type"), F.lit(""))
    return parsed.select(
        "chunk",
        "pos",
        "file",
        _text("sessionId").alias("session"),
        _text("type").alias("type"),
        _text("version").alias("version"),
        _text("timestamp").alias("ts"),
        _text("toolDenialKind").alias("denial"),
        _text("attributionSkill").alias("skill"),
        _text("attributionPlugin").alias("plugin"),
        _text("attributionAgent").alias("agent"),
        _text("attributionMcpServer").alias("mcp_server"),
        _text("attributionMcpTool").alias("mcp_tool"),
        *[F.col(c) for c in ("is_broken", "is_journal", "is_unknown") if c in lines.columns],
        _uses(F.col("blocks"), F.col("hashes")).alias("uses"),
        _results(answers).alias("results"),
        F.size(answers).alias("event_results"),
        F.size(failed).alias("event_errors"),
        F.nullif(
            F.try_variant_get(record, "$.persistedOutputPath", "string"), F.lit("")
        ).alias("persisted_path"),
        F.coalesce(F.try_variant_get(record, "$.persistedOutputSize", "bigint"), F.lit(0)).alias(
            "persisted_size"
        ),
        F.when(
            (F.col("type") == "assistant")
            & F.col("m.usage").isNotNull()
            & (F.coalesce("m.id", F.lit("")) != ""),
            _usage(),
        ).alias("usage"),
        F.coalesce("totalCostUSD", F.lit(0.0)).alias("total_usd"),
        _models(F.when(F.col("type") == "cost-state", F.col("modelUsage"))).alias("models"),
        F.when(
            attachment.isNotNull(),
            F.struct(
                F.coalesce(kind, F.lit(model.UNTYPED)).alias("type"),
                F.octet_length(attachment).cast("bigint").alias("bytes"),
            ),
        ).alias("attached"),
        "attachment_keys",
        attachment_ops.raw_record(attachment).alias("tool_record"),
    )


def _message_blocks() -> Column:
    """Content blocks with their content as (blocks, text).

    A value in which a key occurs twice has no VARIANT: it is lost, and what comes after it
    may be. A message that lost something against its reading as plain text is
    read once for each JSON type instead; text is what reads as a string and as nothing else.
    """
    names = ("type", "id", "name", "input", "tool_use_id", "is_error")
    usual = F.transform(
        "m.content",
        lambda b: F.struct(*(b[n].alias(n) for n in names), content.open_content(b["content"]).alias("content")),
    )
    read = {
        kind: F.col("plain") if kind == "text" else F.from_json("message", schema)["content"]
        for kind, schema in model.CONTENT_READINGS.items()
    }
    apart = F.arrays_zip(*(of.alias(kind) for kind, of in read.items()))
    others = ("array", "object", "number", "truth")

    def opened(b: Column) -> Column:
        other = F.coalesce(*(b[k]["content"].cast("string") for k in others))
        text = F.when(other.isNull(), b["text"]["content"])
        shape = F.struct(b["blocks"]["content"].alias("blocks"), text.alias("text"))
        return F.struct(*(b["text"][n].alias(n) for n in names), shape.alias("content"))

    strict = F.col("m.content")
    beside = F.arrays_zip(strict.alias("strict"), F.col("plain").alias("plain"))
    lost = lambda b: b["strict"]["content"].isNull() & b["plain"]["content"].isNotNull()
    whole = (F.size(strict) == F.size("plain")) & ~F.exists(beside, lost)
    return F.when(F.col("plain").isNotNull(), F.when(whole, usual).otherwise(F.transform(apart, opened)))


def _uses(blocks: Column, hashes: Column) -> Column:
    no_input = F.lit(payload.digest(""))
    every = F.transform(
        blocks,
        lambda b, i: F.struct(
            b["type"].alias("type"),
            i.cast("bigint").alias("idx"),
            F.coalesce(b["id"], F.lit("")).alias("use_id"),
            F.coalesce(b["name"], F.lit("")).alias("tool"),
            F.coalesce(F.when(hashes.isNotNull(), F.get(hashes, i)), no_input).alias("hash"),
            invoked_skill(b["name"], b["input"]).alias("invoked_skill"),
        ),
    )
    return F.filter(every, lambda u: u["type"] == "tool_use")


def invoked_skill(tool: Column, tool_input: Column) -> Column:
    """Skill named by a ``Skill`` call; NULL for anything else."""
    skill = F.get_json_object(F.when(tool == "Skill", tool_input), "$.skill")
    return F.nullif(skill, F.lit(""))


def _results(answers: Column) -> Column:
    """Two steps, so the content is taken apart once per block."""
    opened = F.transform(
        answers,
        lambda b: F.struct(
            F.coalesce(b["tool_use_id"], F.lit("")).alias("use_id"),
            F.coalesce(b["is_error"], F.lit(False)).alias("is_error"),
            b["content"].alias("content"),
        ),
    )
    return F.transform(
        opened,
        lambda r, i: F.struct(
            i.cast("bigint").alias("idx"),
            r["use_id"],
            r["is_error"],
            content.measure_opened(r["content"]).alias("measured"),
        ),
    )


def _count(path: str) -> Column:
    return F.coalesce(F.col(path), F.lit(0)).cast("bigint")


def _usage() -> Column:
    five, hour = (
        _count(f"m.usage.cache_creation.ephemeral_{tier}_input_tokens") for tier in ("5m", "1h")
    )
    split = five + hour > 0
    return F.struct(
        F.col("m.id").alias("message_id"),
        F.coalesce("m.model", F.lit("")).alias("model"),
        _count("m.usage.input_tokens").alias("input"),
        _count("m.usage.output_tokens").alias("output"),
        _count("m.usage.output_tokens_details.thinking_tokens").alias("thinking"),
        _count("m.usage.cache_read_input_tokens").alias("cache_read"),
        F.when(split, five)
        .otherwise(_count("m.usage.cache_creation_input_tokens"))
        .alias("cache_5m"),
        F.when(split, hour).otherwise(F.lit(0).cast("bigint")).alias("cache_1h"),
    )


def _models(raw: Column) -> Column:
    zero = F.lit(0).cast("bigint")
    return F.transform_values(
        F.from_json(raw, model.MODEL_USAGE_SCHEMA),
        lambda _, m: F.struct(
            F.coalesce(m["inputTokens"], zero).alias("input"),
            F.coalesce(m["outputTokens"], zero).alias("output"),
            F.coalesce(m["cacheReadInputTokens"], zero).alias("cache_read"),
            F.coalesce(m["cacheCreationInputTokens"], zero).alias("cache_create"),
            F.coalesce(m["costUSD"], F.lit(0.0)).alias("cost_usd"),
        ),
    )


def event_rows(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        "chunk", "pos", "file", "session", "type", "version", "ts", "mcp_server", "is_unknown"
    )


def use_rows(decoded: DataFrame) -> DataFrame:
    """``tool_use`` blocks with the attribution of the turn that asked."""
    return decoded.select(
        "chunk", "pos", "file", "session", "ts", "skill", "plugin", "mcp_server",
        F.explode_outer("uses").alias("u"),
    ).filter("u is not null").select(
        "chunk", "pos", "u.idx", "file", "session", "ts", "u.use_id", "u.tool", "u.hash",
        "u.invoked_skill", "skill", "plugin", "mcp_server",
    )


def result_rows(decoded: DataFrame) -> DataFrame:
    """``tool_result`` blocks with their measures and the event's labels."""
    event = ("denial", "persisted_path", "persisted_size", "event_results", "event_errors")
    return decoded.select(
        "chunk", "pos", "file", "session", "ts", *event, F.explode_outer("results").alias("r")
    ).filter("r is not null").select(
        "chunk", "pos", "r.idx", "file", "session", "ts", "r.use_id", "r.measured.context_bytes",
        "r.measured.image_bytes", "r.measured.marker", "r.is_error", *event,
    )


def usage_rows(decoded: DataFrame) -> DataFrame:
    """Billed token counts of responses that have an id to dedupe by."""
    return decoded.filter("usage is not null").select(
        "chunk", "pos", "session", "ts", "usage.*", "skill", "plugin", "agent", "mcp_server", "mcp_tool"
    )


def bill_rows(decoded: DataFrame) -> DataFrame:
    """``cost-state`` records with their per-model map."""
    return decoded.filter("models is not null").select(
        "chunk", "pos", "session", "ts", "total_usd", "models"
    )


def attachment_rows(decoded: DataFrame) -> DataFrame:
    """Type level: the attachment object's own raw length."""
    return decoded.filter("attached is not null").select("chunk", "pos", "session", "ts", "attached.*")


def attachment_key_rows(decoded: DataFrame) -> DataFrame:
    place = ("chunk", "pos", "ts")
    keyed = decoded.select(*place, F.explode_outer("attachment_keys").alias("k"))
    keyed = keyed.filter("k is not null").select(*place, "k.*")
    return keyed.unionByName(attachment_ops.record_keys(decoded, "tool_record", *place))


def read_corpus(
    spark: SparkSession,
    directory: str,
    landing: str,
    glob: str = JSONL_GLOB,
    side_files: DataFrame | None = None,
) -> Corpus:
    """Decode a corpus once, store it below ``landing`` and view it as silver.

    The lines are read and parsed exactly once. Storing them also freezes
    ``pos``, which is only stable inside the scan that assigned it.
    """
    decoded = decode_lines(classify(read_events(spark, directory, glob)))
    decoded.write.mode("overwrite").parquet(f"{landing}/lines")
    stored = spark.read.schema(decoded.schema).parquet(f"{landing}/lines")
    manifest = file_manifest(list_files(spark, directory, glob), file_quality(stored))
    manifest.write.mode("overwrite").parquet(f"{landing}/manifest")
    live = stored.filter("not is_broken and not is_journal")
    return Corpus(
        events=event_rows(live),
        uses=use_rows(live),
        results=result_rows(live),
        usage=usage_rows(live),
        bills=bill_rows(live),
        attachments=attachment_rows(live),
        attachment_keys=attachment_key_rows(live),
        manifest=spark.read.schema(manifest.schema).parquet(f"{landing}/manifest"),
        side_files=side_files or spark.createDataFrame([], SIDE_FILE_SCHEMA),
        directory=directory,
    )


def line_accounting(spark: SparkSession, directory: str, glob: str = JSONL_GLOB) -> DataFrame:
    """Lines per file from the text source: total, blank and trimmed bytes."""
    lines = _lines(spark, directory, glob)
    return lines.groupBy("file").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("line") == "").alias("blank_lines"),
        F.sum(F.octet_length("line")).cast("bigint").alias("line_bytes"),
        F.max(F.octet_length("line")).cast("bigint").alias("longest_line"),
    )


def cached_sessions(spark: SparkSession, path: str) -> DataFrame:
    """One row with ``totalSessions`` of the session-count cache document."""
    return (
        spark.read.schema("totalSessions BIGINT")
        .json(path, multiLine=True)
        .select(F.coalesce("totalSessions", F.lit(0)).alias("total_sessions"))
    )


def list_side_files(spark: SparkSession, directory: str) -> DataFrame:
    """Path and length of externalised outputs; file contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(directory)
        .select(plain_path(F.col("path")).alias("path"), "length")
    )
