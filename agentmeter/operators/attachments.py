"""Attachment volume at the key level.

Everything is computed inside the row: an attachment names its own keys, so
exploding them needs no shuffle until the final sum per key.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentmeter.functions import payload

_KEY_BYTES = "array<struct<key: string, bytes: bigint, events: bigint>>"

_PAYLOAD = """
    type STRING, hookName STRING, names ARRAY<STRING>, content VARIANT,
    addedNames ARRAY<STRING>, addedTypes ARRAY<STRING>,
    addedLines ARRAY<STRING>, addedBlocks ARRAY<STRING>,
    files ARRAY<STRUCT<path: STRING, content: STRING>>
"""


def _pair(key: Column, size: Column) -> Column:
    return F.struct(key.alias("key"), size.cast("bigint").alias("bytes"))


def _counted(pairs: Column) -> Column:
    """Byte entries plus one event entry per distinct key of the attachment."""
    zero = F.lit(0).cast("bigint")
    sized = F.transform(
        pairs,
        lambda p: F.struct(p["key"].alias("key"), p["bytes"].alias("bytes"), zero.alias("events")),
    )
    once = F.transform(
        F.array_distinct(F.transform(pairs, lambda p: p["key"])),
        lambda k: F.struct(k.alias("key"), zero.alias("bytes"), F.lit(1).cast("bigint").alias("events")),
    )
    return F.coalesce(F.concat(sized, once), F.array()).cast(_KEY_BYTES)


def names_pattern(names: Column) -> Column:
    """The declared names as regex alternatives, longest first, so a name that
    prefixes another never wins over it. NULL when none is usable."""
    longest_first = F.sort_array(
        F.transform(
            F.filter(names, lambda n: n != ""), lambda n: F.struct(-F.octet_length(n), n.alias("name"))
        )
    )
    quoted = F.transform(
        longest_first,
        lambda s: F.concat(
            F.lit("\\Q"), F.replace(s["name"], F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")
        ),
    )
    return F.nullif(F.array_join(quoted, "|"), F.lit(""))


def listing_pieces(pattern: Column, listing: Column) -> Column:
    """The listing cut in front of every line ``- <declared name>:``.

    A piece then holds the entry line, its continuation lines and the newlines
    joining them; text before the first entry stays a piece of its own.
    """
    cut = F.concat(F.lit("(?:^|(?<=\n))(?=- (?:"), pattern, F.lit("):)"))
    return F.when(listing != "", F.split(listing, cut))


def listing_pairs(pattern: Column, pieces: Column) -> Column:
    """Bytes of each piece by the declared name that opens it."""
    opening = F.concat(F.lit("(?s)^- ("), pattern, F.lit("):"))
    pairs = F.zip_with(
        pieces,
        F.array_repeat(opening, F.size(pieces)),
        lambda piece, regex: _pair(
            F.call_function("regexp_extract", piece, regex, F.lit(1)), F.octet_length(piece)
        ),
    )
    return F.filter(pairs, lambda p: p["key"] != "")


def paired(keys: Column, rendered: Column) -> Column:
    """Each key with the length of the text beside it, or its own length."""
    beside = F.coalesce(rendered, F.array().cast("array<string>"))
    return F.transform(
        F.coalesce(keys, F.array().cast("array<string>")),
        lambda k, i: _pair(k, F.octet_length(F.coalesce(F.get(beside, i), k))),
    )


def instruction_pairs(files: Column) -> Column:
    return F.transform(
        files,
        lambda f: _pair(
            F.coalesce(f["path"], F.lit("")),
            F.octet_length(F.coalesce(f["content"], f["path"], F.lit(""))),
        ),
    )


def with_keys(rows: DataFrame, attachment: Column, out: str = "attachment_keys") -> DataFrame:
    """``out``: (dimension, key, bytes, events) entries of a raw attachment.

    Each step is a column of its own: an expression inlined into a per-element
    function would be evaluated for every element. Tool records are left to
    ``record_keys``.
    """
    a = F.col("_a")
    kind = F.coalesce(a["type"], F.lit(""))
    hook = kind.startswith("hook_") & (F.coalesce(a["hookName"], F.lit("")) != "")
    is_listing = kind == "skill_listing"
    listing = F.when(
        is_listing & (F.schema_of_variant(a["content"]) == "STRING"),
        F.try_variant_get(a["content"], "$", "string"),
    )
    shapes = (
        ("hook_name", hook, F.array(_pair(a["hookName"], F.octet_length("_raw")))),
        ("skill", is_listing, listing_pairs(F.col("_names"), F.col("_pieces"))),
        ("mcp_tool", kind == "deferred_tools_delta", paired(a["addedNames"], a["addedLines"])),
        ("mcp_server", kind == "mcp_instructions_delta", paired(a["addedNames"], a["addedBlocks"])),
        ("agent", kind == "agent_listing_delta", paired(a["addedTypes"], a["addedLines"])),
        ("instruction_file", kind == "instructions", instruction_pairs(a["files"])),
    )
    dimension = pairs = F.lit(None)
    for name, matches, found in reversed(shapes):
        dimension = F.when(matches, F.lit(name)).otherwise(dimension)
        pairs = F.when(matches, found).otherwise(pairs)
    return (
        rows.withColumn("_raw", attachment)
        .withColumn("_a", F.from_json("_raw", _PAYLOAD))
        .withColumn("_names", F.when(is_listing, names_pattern(a["names"])))
        .withColumn("_pieces", listing_pieces(F.col("_names"), listing))
        .withColumns({"_dimension": dimension, "_pairs": pairs})
        .withColumn(
            out,
            F.transform(
                _counted(F.col("_pairs")),
                lambda k: F.struct(
                    F.col("_dimension").alias("dimension"), k["key"], k["bytes"], k["events"]
                ),
            ),
        )
        .drop("_raw", "_a", "_names", "_pieces", "_dimension", "_pairs")
    )


def raw_record(attachment: Column) -> Column:
    """The object itself where it is a tool record, else NULL. The substring
    test, which lets escaped spellings through, spares other objects a second parse."""
    named = F.contains(attachment, F.lit("deferred_tools_record")) | F.contains(attachment, F.lit("\\u"))
    maybe = F.when(named, attachment)
    return F.when(F.get_json_object(maybe, "$.type") == "deferred_tools_record", attachment)


def record_keys(rows: DataFrame, record: str, *keep: str) -> DataFrame:
    """Key entries of tool records: whole entries, charged by their exact source
    text. Only rows that hold a record reach the Python function."""
    pairs = payload.record_entry_bytes(record)
    return (
        rows.filter(F.col(record).isNotNull())
        .withColumn("_pairs", pairs)
        .select(*keep, F.explode(_counted(F.col("_pairs"))).alias("k"))
        .select(*keep, F.lit("mcp_tool").alias("dimension"), "k.*")
    )


def key_rows(rows: DataFrame, attachment: Column, *keep: str) -> DataFrame:
    """Every key entry of raw attachments, one row each."""
    # explode would first filter on the array's size, and that filter is pushed
    # to the scan with every step above inlined into it.
    keyed = with_keys(rows, attachment).select(*keep, F.explode_outer("attachment_keys").alias("k"))
    keyed = keyed.filter("k is not null")
    records = rows.withColumn("_record", raw_record(attachment))
    return keyed.select(*keep, "k.*").unionByName(record_keys(records, "_record", *keep))


def by_type(attachments: DataFrame) -> DataFrame:
    return attachments.groupBy("type").agg(
        F.count(F.lit(1)).alias("attachment_events"), F.sum("bytes").alias("attachment_bytes")
    )


def by_key(attachment_keys: DataFrame) -> DataFrame:
    return attachment_keys.groupBy("dimension", "key").agg(
        F.sum("events").alias("attachment_events"), F.sum("bytes").alias("attachment_bytes")
    )
