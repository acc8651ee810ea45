"""Config documents of many hosts as one table.

``config_files(host, root, base, path, content)`` has a row per landed file:
``root`` says which tree it came from (user, store, project, install or
opencode), ``base`` is that tree's absolute directory, ``path`` is relative to
it. A NULL ``content`` is a file that exists but could not be read; a path
ending in ``/`` is a directory.
"""

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SERVERS = "MAP<STRING, VARIANT>"
_STORE = f"mcpServers {_SERVERS}, projects MAP<STRING, STRUCT<mcpServers: {_SERVERS}>>"


def read_config_tree(spark: SparkSession, host: str, root: str, base: str) -> DataFrame:
    """The JSON and SKILL.md documents below one landed tree."""
    trimmed = base.rstrip("/")
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "{*.json,SKILL.md}")
        .text(trimmed, wholetext=True)
        .select(
            F.lit(host).alias("host"),
            F.lit(root).alias("root"),
            F.lit(trimmed).alias("base"),
            F.regexp_replace(
                F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "/"),
                "^" + re.escape(trimmed) + "/",
                "",
            ).alias("path"),
            F.col("value").alias("content"),
        )
    )


def is_json(content: Column) -> Column:
    return F.try_parse_json(content).isNotNull()


def is_object(value: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.lit(False))


def _entries(files: DataFrame, servers: Column, scope: str, precedence: int, label: Column) -> DataFrame:
    return files.select(
        "host",
        F.lit(scope).alias("scope"),
        F.lit(precedence).alias("precedence"),
        label.alias("source"),
        # Outer, so that no filter on its size parses each document once more.
        F.explode_outer(servers).alias("name", "spec"),
    ).filter("name is not null")


def _at(files: DataFrame, root: str, path: str) -> DataFrame:
    return files.filter((F.col("root") == root) & (F.col("path") == path))


def _full_path() -> Column:
    return F.concat_ws("/", "base", "path")


def enabled_plugins(files: DataFrame) -> DataFrame:
    """Plugin names of user settings, disabled ones included: the part of each
    ``enabledPlugins`` key before the first @."""
    document = F.from_json("content", "enabledPlugins MAP<STRING, STRING>")
    return (
        _at(files, "user", "settings.json")
        .select("host", F.explode(F.map_keys(document["enabledPlugins"])).alias("_key"))
        .select("host", F.substring_index("_key", "@", 1).alias("plugin"))
        .distinct()
    )


def opencode_servers(files: DataFrame) -> DataFrame:
    """Server names of the user-level ``mcp`` map."""
    document = F.from_json("content", "mcp MAP<STRING, STRING>")
    return (
        _at(files, "opencode", "opencode.json")
        .select("host", F.explode_outer(F.map_keys(document["mcp"])).alias("server"))
        .filter("server is not null")
        # Dealt out first: few input files make many rows, which the tasks that read them can't hold.
        .repartition("host", "server")
        .distinct()
    )


def plugin_server_entries(files: DataFrame) -> DataFrame:
    """Servers that installed plugins declare, as ``plugin:<plugin>:<server>``.

    Only registered install paths are followed; superseded copies in a cache
    directory are never looked at. A document either wraps its servers or is
    the bare map, in which only object values are servers.
    """
    registry = F.from_json("content", "plugins MAP<STRING, ARRAY<STRUCT<installPath: STRING>>>")
    installs = (
        _at(files, "user", "plugins/installed_plugins.json")
        .select("host", F.explode_outer(registry["plugins"]).alias("_key", "_installs"))
        .select(
            "host",
            F.substring_index("_key", "@", 1).alias("plugin"),
            F.explode_outer("_installs.installPath").alias("base"),
        )
        .filter("plugin <> '' and coalesce(base, '') <> ''")
        .groupBy("host", "base")
        .agg(F.min("plugin").alias("plugin"))
    )
    documents = _at(files, "install", ".mcp.json").select("host", "base", "content")
    wrapped = F.from_json("content", f"mcpServers {_SERVERS}")["mcpServers"]
    bare = F.map_filter(F.from_json("content", _SERVERS), lambda _, spec: is_object(spec))
    declared = installs.join(documents, ["host", "base"]).select(
        "host",
        "base",
        "plugin",
        F.explode_outer(F.coalesce(wrapped, bare)).alias("_server", "spec"),
    ).filter("_server is not null")
    return declared.select(
        "host",
        F.lit("plugin").alias("scope"),
        F.lit(5).alias("precedence"),
        F.concat("base", F.lit("/.mcp.json")).alias("source"),
        F.concat(F.lit("plugin:"), "plugin", F.lit(":"), "_server").alias("name"),
        "spec",
    )


def server_entries(files: DataFrame) -> DataFrame:
    """Every declared server with its scope and precedence, five sources."""
    plain = F.from_json("content", f"mcpServers {_SERVERS}")["mcpServers"]
    store = _at(files, "store", ".claude.json").withColumn("doc", F.from_json("content", _STORE))
    project_dirs = files.filter("root = 'project'").select("host", F.col("base").alias("_dir")).distinct()
    section = (
        store.select("host", "base", "path", F.explode_outer("doc.projects").alias("_dir", "_section"))
        .join(project_dirs, ["host", "_dir"])
    )
    section_label = F.concat(_full_path(), F.lit(' projects["'), "_dir", F.lit('"]'))
    return (
        _entries(_at(files, "user", "settings.json"), plain, "user", 1, _full_path())
        .unionByName(_entries(store, F.col("doc.mcpServers"), "user", 2, _full_path()))
        .unionByName(_entries(_at(files, "project", ".mcp.json"), plain, "project", 3, _full_path()))
        .unionByName(_entries(section, F.col("_section.mcpServers"), "project", 4, section_label))
        .unionByName(plugin_server_entries(files))
    )


def opencode_server_entries(files: DataFrame) -> DataFrame:
    servers = F.from_json("content", f"mcp {_SERVERS}")["mcp"]
    return _entries(
        _at(files, "opencode", "opencode.json"), servers, "user", 1, _full_path()
    ).unionByName(_entries(_at(files, "project", "opencode.json"), servers, "project", 2, _full_path()))


def source_state(files: DataFrame, opencode: bool = False) -> DataFrame:
    """Per host: was any server source read, and was one unreadable or broken."""
    if opencode:
        wanted = (F.col("path") == "opencode.json") & F.col("root").isin("opencode", "project")
    else:
        wanted = (
            ((F.col("root") == "user") & F.col("path").isin("settings.json", "plugins/installed_plugins.json"))
            | ((F.col("root") == "store") & (F.col("path") == ".claude.json"))
            | (F.col("root").isin("project", "install") & (F.col("path") == ".mcp.json"))
        )
    registry = F.col("path") == "plugins/installed_plugins.json"
    usable = F.coalesce(is_json(F.col("content")), F.lit(False))
    return (
        files.filter(wanted)
        .groupBy("host")
        .agg(
            F.max(usable & ~registry).alias("saw_source"),
            F.max(~usable).alias("is_partial"),
        )
    )


def skill_files(files: DataFrame, opencode: bool = False) -> DataFrame:
    """SKILL.md documents exactly one level below each skill root."""
    roots = (
        [("opencode", "skills"), ("project", ".opencode/skills")]
        if opencode
        else [("user", "skills")]
    ) + [("project", ".claude/skills"), ("project", ".agents/skills")]
    matching = F.lit(False)
    for root, prefix in roots:
        pattern = "^" + re.escape(prefix) + "/[^/]+/SKILL[.]md$"
        matching = matching | ((F.col("root") == root) & F.rlike("path", F.lit(pattern)))
    return files.filter(matching).select(
        "host",
        F.regexp_replace(_full_path(), "/SKILL[.]md$", "").alias("key"),
        F.regexp_extract("path", "([^/]+)/SKILL[.]md$", 1).alias("directory"),
        "content",
    )


def plugin_files(files: DataFrame) -> DataFrame:
    """Each plugin directory with its manifest text, NULL where it has none."""
    name = F.regexp_extract("path", "^plugins/([^/]+)/", 1)
    manifest = F.rlike("path", F.lit("^plugins/[^/]+/[.]claude-plugin/plugin[.]json$"))
    return (
        files.filter((F.col("root") == "user") & (name != ""))
        .groupBy("host", name.alias("directory"))
        .agg(
            F.max(F.when(manifest, F.col("content"))).alias("content"),
            F.max(manifest).alias("has_manifest"),
        )
    )
