"""Tool, server and plugin naming rules."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def mcp_server(tool: Column) -> Column:
    """Server half of ``mcp__<server>__<tool>``; '' for any other name."""
    return F.regexp_extract(tool, r"(?s)^mcp__(.*?)__", 1)


def mcp_canon(name: Column) -> Column:
    """The spelling a tool name uses for its server."""
    return F.translate(name, ":. ", "___")


def _escape_dots(part: Column) -> Column:
    return F.replace(F.replace(part, F.lit("\\"), F.lit("\\\\")), F.lit("."), F.lit("\\."))


def codex_tool_name(namespace: Column, name: Column) -> Column:
    space = F.coalesce(namespace, F.lit(""))
    return F.when(space == "", _escape_dots(name)).otherwise(
        F.concat(_escape_dots(space), F.lit("."), _escape_dots(name))
    )


def codex_mcp_server(namespace: Column, name: Column) -> Column:
    space = F.coalesce(namespace, F.lit(""))
    from_space = F.regexp_extract(space, r"(?s)^mcp__(.+)$", 1)
    legacy = F.regexp_extract(F.coalesce(name, F.lit("")), r"(?s)^mcp__(.*?)__.+$", 1)
    return F.when(space != "", from_space).otherwise(legacy)


def day(ts: Column) -> Column:
    return F.substring(ts, 1, 10)


def millis_to_rfc3339(ms: Column) -> Column:
    """Whole seconds in UTC, whatever the session's time zone is."""
    seconds = F.floor(ms / 1000).cast("decimal(18,6)")
    since_epoch = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    utc = (F.lit("1970-01-01").cast("timestamp_ntz") + since_epoch).cast("string")
    return F.concat(F.replace(utc, F.lit(" "), F.lit("T")), F.lit("Z"))


def prefixes(name: Column, separator: str) -> Column:
    """Every prefix of a name that ends at a separator and leaves a remainder.

    Turning a prefix test into this list makes longest-prefix matching an
    equi-join, so neither side needs to be small.
    """
    parts = F.split(name, F.lit("\\Q" + separator + "\\E"))
    cuts = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(
        F.array().cast("array<int>")
    )
    pairs = F.transform(
        cuts,
        lambda n: F.struct(
            F.array_join(F.slice(parts, F.lit(1), n), separator).alias("prefix"),
            F.array_join(F.slice(parts, n + 1, F.size(parts)), separator).alias("rest"),
        ),
    )
    return F.transform(F.filter(pairs, lambda p: p["rest"] != ""), lambda p: p["prefix"])
