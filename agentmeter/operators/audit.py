"""Static health of configuration, and configuration against observed use."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentmeter import model
from agentmeter.functions.names import mcp_canon, mcp_server, prefixes
from agentmeter.sources.config import is_object
from agentmeter.sources.rollouts import json_text

_BLANK = " \t\n\r\v\f"


def _trim(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANK))


def unquote(value: Column) -> Column:
    """One layer of matching quotes removed."""
    inner = F.substr(value, F.lit(2), F.length(value) - 2)
    quoted = F.lit(False)
    for quote in ('"', "'"):
        quoted = quoted | (F.startswith(value, F.lit(quote)) & F.endswith(value, F.lit(quote)))
    return F.when((F.length(value) >= 2) & quoted, inner).otherwise(value)


def front_matter(skills: DataFrame) -> DataFrame:
    """``state`` (ok, missing, unterminated) and the three fields that matter.

    The block is flat ``key: value`` lines between two ``---`` lines; indented
    and comment lines are skipped and the first occurrence of a key wins.
    """
    lines = F.split(F.replace(F.coalesce("content", F.lit("")), F.lit("\r\n"), F.lit("\n")), "\n")
    after = F.slice("lines", F.lit(2), F.size("lines"))
    close = F.array_position(F.transform("after", _trim), F.lit("---"))
    body = F.filter(
        F.slice("after", F.lit(1), F.greatest(F.col("close").cast("int") - 1, F.lit(0))),
        lambda line: (line != "")
        & ~F.startswith(line, F.lit(" "))
        & ~F.startswith(line, F.lit("\t"))
        & ~F.startswith(_trim(line), F.lit("#"))
        & F.contains(line, F.lit(":")),
    )
    pairs = F.transform(
        body,
        lambda line: F.struct(
            _trim(F.substring_index(line, ":", 1)).alias("key"),
            unquote(_trim(F.substr(line, F.instr(line, ":") + 1))).alias("value"),
        ),
    )
    field = lambda name: F.get(F.filter("pairs", lambda p: p["key"] == name), F.lit(0))["value"]
    return (
        skills.withColumn("lines", lines)
        .withColumn("after", after)
        .withColumn("close", close)
        .withColumn("pairs", pairs)
        .select(
            *skills.columns,
            F.when(_trim(F.get("lines", F.lit(0))) != "---", F.lit("missing"))
            .when(F.col("close") == 0, F.lit("unterminated"))
            .otherwise(F.lit("ok"))
            .alias("state"),
            field("name").alias("name"),
            field("description").alias("description"),
            field("allowed-tools").alias("allowed_tools"),
        )
    )


def allowed_tools_malformed(value: Column) -> Column:
    plain = unquote(_trim(value))
    tokens = F.filter(F.split(plain, "[, \t]+"), lambda t: t != "")
    odd = F.exists(tokens, lambda t: ~F.rlike(t, F.lit(model.ALLOWED_TOOL_TOKEN)))
    return F.coalesce(
        F.when(plain == "", F.lit(False))
        .when(F.startswith(plain, F.lit("[")), ~F.endswith(plain, F.lit("]")))
        .otherwise(odd),
        F.lit(False),
    )


def _explode_kinds(rows: DataFrame, dimension: str, key: Column, kinds: Column) -> DataFrame:
    found = F.filter(kinds, lambda k: k.isNotNull())
    return rows.select(
        "host", F.lit(dimension).alias("dimension"), key.alias("key"), F.explode(found).alias("kind")
    )


def skill_findings(parsed: DataFrame) -> DataFrame:
    ok = F.col("state") == "ok"
    kinds = F.array(
        F.when(F.col("state") == "missing", F.lit(model.FRONTMATTER_MISSING)),
        F.when(F.col("state") == "unterminated", F.lit(model.FRONTMATTER_UNTERMINATED)),
        F.when(ok & ~F.col("name").eqNullSafe(F.col("directory")), F.lit(model.NAME_MISMATCH)),
        F.when(
            ok & (_trim(F.coalesce("description", F.lit(""))) == ""),
            F.lit(model.DESCRIPTION_MISSING),
        ),
        F.when(
            ok & allowed_tools_malformed(F.col("allowed_tools")),
            F.lit(model.ALLOWED_TOOLS_MALFORMED),
        ),
    )
    return _explode_kinds(parsed.filter("content is not null"), "skill", F.col("key"), kinds)


def plugin_findings(plugins: DataFrame) -> DataFrame:
    manifest = F.try_parse_json("content")
    name = F.coalesce(json_text(manifest, "$.name"), F.lit(""))
    invalid = manifest.isNull() | ~is_object(manifest)
    kinds = F.array(
        F.when(
            invalid, F.lit(model.PLUGIN_JSON_INVALID)
        ).when(name != F.col("directory"), F.lit(model.PLUGIN_NAME_MISMATCH))
    )
    present = plugins.filter("has_manifest and content is not null")
    return _explode_kinds(present, "plugin", F.col("directory"), kinds)


def merge_servers(entries: DataFrame) -> DataFrame:
    """The winning definition of each (host, name): later sources override.

    ``overrides`` names the source that was shadowed. A name has at most one
    entry per source once plugin installs are reduced, so a group holds no
    more rows than there are sources.
    """
    # Dealt out first: few input files make many rows, which the tasks that read them can't hold.
    single = entries.repartition("host", "name").groupBy("host", "name", "precedence", "scope").agg(
        F.max_by(F.struct("source", "spec"), F.col("source")).alias("_entry")
    ).select("host", "name", "precedence", "scope", "_entry.*")
    by_name = Window.partitionBy("host", "name").orderBy("precedence")
    latest_first = Window.partitionBy("host", "name").orderBy(F.desc("precedence"))
    return (
        single.withColumns(
            {
                "overrides": F.lag("source").over(by_name),
                "overrides_scope": F.lag("scope").over(by_name),
                "_place": F.row_number().over(latest_first),
            }
        )
        .withColumn("is_winner", F.col("_place") == 1)
        .drop("_place")
    )


def winners(entries: DataFrame) -> DataFrame:
    """The winning definition of each (host, name) alone, as ``merge_servers`` has it."""
    place = F.struct("precedence", "source")
    # Dealt out first: few input files make many rows, which the tasks that read them can't hold.
    dealt = entries.select("host", "name", "scope", "precedence", "source", "spec").repartition("host", "name")
    won = dealt.groupBy("host", "name").agg(F.max_by(F.struct("precedence", "scope", "source", "spec"), place).alias("_entry"))
    return won.select("host", "name", "_entry.*", F.lit(True).alias("is_winner"))


def collisions(merged: DataFrame) -> DataFrame:
    rule = F.when(
        F.col("scope") == F.col("overrides_scope"),
        F.concat(F.lit("last of the "), "scope", F.lit(" sources")),
    ).otherwise(F.lit("project over user"))
    return merged.filter("overrides is not null").select(
        "host", "name", "source", "overrides", rule.alias("rule")
    )


def _server_type(spec: Column) -> Column:
    return F.coalesce(json_text(spec, "$.type"), F.lit(""))


def server_findings(merged: DataFrame) -> DataFrame:
    """Claude-style entries: a local server needs a command to launch."""
    spec = F.col("spec")
    command = _trim(F.coalesce(json_text(spec, "$.command"), F.lit("")))
    kind = _server_type(spec)
    kinds = F.array(
        F.when(~is_object(spec), F.lit(model.SERVER_TYPE_UNKNOWN))
        .when(kind.isin("", "stdio") & (command == ""), F.lit(model.COMMAND_MISSING))
        .when(~kind.isin("", "stdio", "http", "sse"), F.lit(model.SERVER_TYPE_UNKNOWN))
    )
    return _explode_kinds(merged.filter("is_winner"), "mcp_server", F.col("name"), kinds)


def launch_token(spec: Column) -> Column:
    """First command token: an array's first element, or a bare string."""
    argv = F.try_variant_get(spec, "$.command", "array<string>")
    listed = F.startswith(
        F.schema_of_variant(F.try_variant_get(spec, "$.command", "variant")), F.lit("ARRAY")
    )
    token = F.when(listed, F.get(argv, F.lit(0))).otherwise(json_text(spec, "$.command"))
    return _trim(F.coalesce(token, F.lit("")))


def is_disabled(spec: Column) -> Column:
    return F.coalesce(F.try_variant_get(spec, "$.enabled", "boolean") == F.lit(False), F.lit(False))


def opencode_server_findings(merged: DataFrame) -> DataFrame:
    """OpenCode-style entries: a command or a url; disabled is a state."""
    spec = F.col("spec")
    kind = _server_type(spec)
    url = _trim(F.coalesce(json_text(spec, "$.url"), F.lit("")))
    kinds = F.array(
        F.when(~is_object(spec), F.lit(model.SERVER_TYPE_UNKNOWN))
        .when(~kind.isin("", "local", "remote"), F.lit(model.SERVER_TYPE_UNKNOWN))
        .when((launch_token(spec) == "") & (url == ""), F.lit(model.URL_MISSING))
    )
    return _explode_kinds(merged.filter("is_winner"), "mcp_server", F.col("name"), kinds)


def findings_per_key(findings: DataFrame) -> DataFrame:
    return findings.groupBy("host", "dimension", "key").agg(F.count(F.lit(1)).alias("findings"))


CHECKED = ("skills_checked", "plugins_checked", "mcp_servers_checked")


def checked(skills: DataFrame, plugins: DataFrame, merged: DataFrame, state: DataFrame) -> DataFrame:
    """Denominators per host; NULL where a source could not be read or none
    exists, because a partial count is no total. ``withheld`` names the first kind."""

    def count(rows: DataFrame, readable: Column, name: str) -> DataFrame:
        whole = F.bool_and(readable)
        return rows.groupBy("host").agg(
            F.when(whole, F.count(F.lit(1))).alias(name), (~whole).alias(f"{name}_withheld")
        )

    skill_count = count(skills, F.col("content").isNotNull(), "skills_checked")
    plugin_count = count(plugins, ~F.col("has_manifest") | F.col("content").isNotNull(), "plugins_checked")
    server_count = merged.filter("is_winner").groupBy("host").agg(F.count(F.lit(1)).alias("_servers"))
    servers = state.join(server_count, "host", "left").select(
        "host",
        F.when(F.col("saw_source") & ~F.col("is_partial"), F.coalesce("_servers", F.lit(0))).alias(
            "mcp_servers_checked"
        ),
        F.col("is_partial").alias("mcp_servers_checked_withheld"),
    )
    joined = skill_count.join(plugin_count, "host", "full_outer").join(servers, "host", "full_outer")
    withheld = F.array_compact(
        F.array(*[F.when(F.coalesce(f"{c}_withheld", F.lit(False)), F.lit(c)) for c in CHECKED])
    )
    return joined.select("host", *CHECKED, withheld.alias("withheld"))


def fleet_totals(per_host: DataFrame, names: Sequence[str] = CHECKED) -> DataFrame:
    """Sums over hosts; a total that lacks a withheld host is withheld too."""
    lacks = lambda c: F.coalesce(F.bool_or(F.array_contains("withheld", c)), F.lit(False))
    return per_host.agg(*[F.when(~lacks(c), F.sum(c)).alias(c) for c in names])


def observed_servers(events: DataFrame, uses: DataFrame, in_window: Column) -> DataFrame:
    """(host, session, server) sightings from both channels, each counted once:
    the tool name of a call and the server a turn is attributed to."""
    attributed = events.filter(in_window).filter("mcp_server <> ''").select(
        "host", "session", F.col("mcp_server").alias("server")
    )
    called = (
        uses.filter(in_window)
        .select("host", "session", mcp_server(F.col("tool")).alias("server"))
        .filter("server <> ''")
    )
    return attributed.unionByName(called).distinct()


def server_sessions(observed: DataFrame) -> DataFrame:
    """Sessions per server across its spellings; the smallest one names it."""
    return (
        observed.withColumn("canon", mcp_canon(F.col("server")))
        .groupBy("host", "canon", "session")
        .agg(F.min("server").alias("server"))
        .groupBy("host", "canon")
        .agg(F.min("server").alias("server"), F.count(F.lit(1)).alias("sessions"))
    )


def mcp_sessions(observed: DataFrame) -> DataFrame:
    return (
        observed.select("host", "session")
        .distinct()
        .groupBy("host")
        .agg(F.count(F.lit(1)).alias("mcp_sessions"))
    )


def join_configured(configured: DataFrame, observed: DataFrame) -> DataFrame:
    """Both misses of configuration against use, one row per server.

    ``configured`` has (host, name). never_observed carries the denominator and
    is claimed only where some session used a server at all.
    """
    declared = (
        configured.withColumn("canon", mcp_canon(F.col("name")))
        .groupBy("host", "canon")
        .agg(F.min("name").alias("name"))
    )
    return (
        declared.join(server_sessions(observed), ["host", "canon"], "full_outer")
        .join(mcp_sessions(observed), "host", "left")
        .withColumns(
            {
                "never_observed": F.when(
                    F.col("server").isNull() & (F.coalesce("mcp_sessions", F.lit(0)) > 0),
                    F.col("mcp_sessions"),
                ),
                "unconfigured_observed": F.when(F.col("name").isNull(), F.col("sessions")),
                "key": F.coalesce("name", "server"),
            }
        )
        .select("host", "canon", "key", "never_observed", "unconfigured_observed")
    )


def join_configured_by_prefix(configured: DataFrame, observed: DataFrame) -> DataFrame:
    """The same misses where a tool name only starts with its server's name.

    ``configured`` has (host, name, is_disabled); ``observed`` has (host, tool,
    session). A disabled server is never reported as unobserved.
    """
    total = (
        observed.select("host", "session").distinct().groupBy("host")
        .agg(F.count(F.lit(1)).alias("tool_sessions"))
    )
    named = observed.filter("tool <> ''")
    candidates = (
        named.select("host", "tool")
        .distinct()
        .withColumn("_server", F.explode(prefixes(F.col("tool"), "_")))
    )
    best = (
        candidates.join(
            configured.select("host", F.col("name").alias("_server")), ["host", "_server"], "left_semi"
        )
        .groupBy("host", "tool")
        .agg(F.max_by("_server", F.length("_server")).alias("server"))
    )
    owned = named.join(best, ["host", "tool"], "left")
    seen = owned.filter("server is not null").select("host", F.col("server").alias("name")).distinct()
    never = (
        configured.filter("not is_disabled")
        .join(seen, ["host", "name"], "left_anti")
        .join(total, "host")
        .select(
            "host", F.col("name").alias("key"),
            F.col("tool_sessions").alias("never_observed"),
            F.lit(None).cast("bigint").alias("unconfigured_observed"),
        )
    )
    strange = (
        owned.filter("server is null")
        .groupBy("host", "tool", "session").agg(F.lit(1).alias("_one"))
        .groupBy("host", F.col("tool").alias("key"))
        .agg(F.count(F.lit(1)).alias("unconfigured_observed"))
        .withColumn("never_observed", F.lit(None).cast("bigint"))
    )
    return never.unionByName(strange)

