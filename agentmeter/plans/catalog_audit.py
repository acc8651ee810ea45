"""Queries over config documents of a fleet of hosts."""

from pyspark.sql import functions as F

from agentmeter.operators import audit
from agentmeter.plans.catalog import query
from agentmeter.sources import config

ENTRIES = """(
    SELECT host, c_mktsegment AS name, 1 AS precedence, 'user' AS scope, home || '/.claude/settings.json' AS source FROM hosts
    UNION ALL SELECT host, net, 1, 'user', home || '/.claude/settings.json' FROM hosts
    UNION ALL SELECT host, c_mktsegment, 2, 'user', home || '/.claude.json' FROM hosts
    UNION ALL SELECT host, net, 3, 'project', project || '/.mcp.json' FROM hosts WHERE c_acctbal >= 0
    UNION ALL SELECT host, 'five', 3, 'project', project || '/.mcp.json' FROM hosts WHERE c_acctbal >= 0
    UNION ALL SELECT host, 'proj', 4, 'project', home || '/.claude.json projects["' || project || '"]' FROM hosts
    UNION ALL SELECT host, 'plugin:' || plugin || ':srv', 5, 'plugin', '/inst/' || plugin || '/.mcp.json' FROM hosts
    UNION ALL SELECT host, 'plugin:' || plugin || ':bad', 5, 'plugin', '/inst/' || plugin || '/.mcp.json' FROM hosts)"""
MERGED = f"""(SELECT *, lag(source) OVER w AS overrides, lag(scope) OVER w AS overrides_scope,
    precedence = max(precedence) OVER (PARTITION BY host, name) AS is_winner
    FROM {ENTRIES} WINDOW w AS (PARTITION BY host, name ORDER BY precedence))"""
SKILL_FINDINGS = """(
    SELECT host, 'skill' AS dimension, directory AS key, unnest(CASE n_chars % 7
        WHEN 0 THEN ['frontmatter_missing'] WHEN 1 THEN ['frontmatter_unterminated'] WHEN 2 THEN ['name_mismatch']
        WHEN 4 THEN ['description_missing', 'allowed_tools_malformed']
        WHEN 5 THEN ['name_mismatch', 'allowed_tools_malformed'] ELSE [] END) AS kind FROM skills)"""
PLUGIN_FINDINGS = """(
    SELECT host, 'plugin' AS dimension, plugin AS key,
           CASE WHEN c_acctbal < 0 THEN 'plugin_json_invalid' ELSE 'plugin_name_mismatch' END AS kind
    FROM hosts WHERE c_acctbal < 2000)"""
SERVER_FINDINGS = """(
    SELECT host, 'mcp_server' AS dimension, c_mktsegment AS key, 'server_type_unknown' AS kind FROM hosts
    UNION ALL SELECT host, 'mcp_server', net, 'command_missing' FROM hosts WHERE c_acctbal >= 0
    UNION ALL SELECT host, 'mcp_server', 'five', 'server_type_unknown' FROM hosts WHERE c_acctbal >= 0
    UNION ALL SELECT host, 'mcp_server', 'proj', 'command_missing' FROM hosts
    UNION ALL SELECT host, 'mcp_server', 'plugin:' || plugin || ':bad', 'server_type_unknown' FROM hosts)"""


def _merged(t):
    return audit.merge_servers(config.server_entries(t.config_files))


def _won(t):
    return audit.winners(config.server_entries(t.config_files))


@query("config_server_entries", f"SELECT host, name, precedence, scope, source FROM {ENTRIES}")
def _(t):
    return config.server_entries(t.config_files).select("host", "name", "precedence", "scope", "source")


@query(
    "config_merge",
    f"SELECT host, name, precedence, scope, source, overrides, is_winner FROM {MERGED}",
)
def _(t):
    return _merged(t).select("host", "name", "precedence", "scope", "source", "overrides", "is_winner")


@query(
    "config_collisions",
    f"""SELECT host, name, source, overrides, CASE WHEN scope = overrides_scope
              THEN 'last of the ' || scope || ' sources' ELSE 'project over user' END AS rule
        FROM {MERGED} WHERE overrides IS NOT NULL""",
)
def _(t):
    return audit.collisions(_merged(t))


@query(
    "config_source_state",
    "SELECT host, TRUE AS saw_source, c_acctbal < 0 AS is_partial FROM hosts",
)
def _(t):
    return config.source_state(t.config_files)


@query(
    "enabled_plugins",
    "SELECT host, plugin FROM hosts UNION ALL SELECT host, 'field_kit' FROM hosts",
)
def _(t):
    return config.enabled_plugins(t.config_files)


@query(
    "opencode_servers",
    """SELECT host, unnest(['engram', 'engram_mem', 'off', net, c_mktsegment]) AS server FROM hosts""",
)
def _(t):
    return config.opencode_servers(t.config_files)


@query(
    "front_matter",
    """SELECT directory, CASE s.n_chars % 7 WHEN 0 THEN 'missing' WHEN 1 THEN 'unterminated' ELSE 'ok' END AS state,
              CASE s.n_chars % 7 WHEN 3 THEN directory WHEN 4 THEN directory WHEN 5 THEN 'other' WHEN 6 THEN directory END AS name,
              CASE s.n_chars % 7 WHEN 2 THEN 'about' WHEN 3 THEN d.source WHEN 4 THEN '' WHEN 5 THEN 'd' WHEN 6 THEN 'd' END AS description,
              CASE s.n_chars % 7 WHEN 3 THEN 'Read, Bash(go:*)' WHEN 4 THEN 'Read && Bash' WHEN 5 THEN '[Read' WHEN 6 THEN '[Read]' END AS allowed_tools
       FROM skills s JOIN documents d ON directory = 'sk' || CAST(doc_id AS VARCHAR)""",
)
def _(t):
    return audit.front_matter(t.skills).filter("state is not null").select(
        "directory", "state",
        *[F.when(F.col("state") == "ok", F.col(c)).alias(c) for c in ("name", "description", "allowed_tools")],
    )


@query("skill_findings", f"SELECT * FROM {SKILL_FINDINGS}")
def _(t):
    return audit.skill_findings(audit.front_matter(t.skills))


@query("plugin_findings", f"SELECT * FROM {PLUGIN_FINDINGS}")
def _(t):
    return audit.plugin_findings(config.plugin_files(t.config_files))


@query("server_findings", f"SELECT * FROM {SERVER_FINDINGS}")
def _(t):
    return audit.server_findings(_won(t))


@query(
    "opencode_server_findings",
    """SELECT host, 'mcp_server' AS dimension, c_mktsegment AS key, 'server_type_unknown' AS kind FROM hosts
       UNION ALL SELECT host, 'mcp_server', net, 'url_missing' FROM hosts WHERE c_acctbal < 5000""",
)
def _(t):
    return audit.opencode_server_findings(audit.winners(config.opencode_server_entries(t.config_files)))


@query(
    "findings_per_key",
    f"""SELECT host, dimension, key, count(*) AS findings FROM (
            SELECT * FROM {SKILL_FINDINGS} UNION ALL SELECT * FROM {PLUGIN_FINDINGS} UNION ALL SELECT * FROM {SERVER_FINDINGS})
        GROUP BY ALL""",
)
def _(t):
    found = audit.skill_findings(audit.front_matter(t.skills))
    found = found.unionByName(audit.plugin_findings(config.plugin_files(t.config_files)))
    return audit.findings_per_key(found.unionByName(audit.server_findings(_won(t))))


@query(
    "checked_denominators",
    """SELECT host, NULL::BIGINT AS skills_checked, CAST(1 AS BIGINT) AS plugins_checked,
              CASE WHEN c_acctbal >= 0 THEN CAST(6 AS BIGINT) END AS mcp_servers_checked FROM hosts
       UNION ALL SELECT host, count(*), NULL, NULL FROM skills GROUP BY host""",
)
def _(t):
    return _checked(t).drop("withheld")


def _checked(t):
    return audit.checked(
        t.skills, config.plugin_files(t.config_files), _merged(t), config.source_state(t.config_files)
    )


@query(
    "fleet_totals",
    """SELECT (SELECT count(*) FROM skills) AS skills_checked, count(*) AS plugins_checked,
              CASE WHEN bool_and(c_acctbal >= 0) THEN 6 * count(*) END AS mcp_servers_checked FROM hosts""",
)
def _(t):
    """A total is withheld while one host's source could not be read."""
    return audit.fleet_totals(_checked(t))


OBSERVED = """(
    SELECT DISTINCT 'h' || CAST(o_custkey AS STRING) AS host, CAST(o_orderkey AS STRING) AS session,
           CASE o_orderstatus WHEN 'F' THEN 'n' || CAST(o_custkey % 25 AS STRING)
                WHEN 'P' THEN 'plugin_pl' || CAST(o_custkey % 25 AS STRING) || '_srv' ELSE 'claude.ai ' || o_orderpriority END AS server
    FROM orders)"""


@query(
    "configured_against_observed",
    f"""SELECT coalesce(d.host, s.host) AS host, coalesce(d.canon, s.canon) AS canon, coalesce(d.name, s.server) AS key,
              CASE WHEN s.server IS NULL AND m.n > 0 THEN m.n END AS never_observed,
              CASE WHEN d.name IS NULL THEN s.sessions END AS unconfigured_observed
        FROM (SELECT host, translate(name, ':. ', '___') AS canon, min(name) AS name FROM {ENTRIES} GROUP BY ALL) d
        FULL JOIN (SELECT host, translate(server, ':. ', '___') AS canon, min(server) AS server, count(DISTINCT session) AS sessions
                   FROM {OBSERVED} GROUP BY ALL) s ON d.host = s.host AND d.canon = s.canon
        LEFT JOIN (SELECT host, count(DISTINCT session) AS n FROM {OBSERVED} GROUP BY host) m ON m.host = coalesce(d.host, s.host)""",
)
def _(t):
    t.table("orders").createOrReplaceTempView("orders")
    observed = t.spark.sql(f"SELECT * FROM {OBSERVED}")
    return audit.join_configured(_merged(t).filter("is_winner").select("host", "name"), observed)


TOOLS_SEEN = """(
    SELECT DISTINCT 'h' || CAST(o_custkey AS STRING) AS host, CAST(o_orderkey AS STRING) AS session,
           CASE o_orderstatus WHEN 'F' THEN 'engram_mem_' || lower(o_orderpriority)
                WHEN 'O' THEN 'n' || CAST(o_custkey % 25 AS STRING) || '_x_y' ELSE 'off_run' END AS tool
    FROM orders)"""


@query(
    "opencode_configured_against_observed",
    f"""WITH owned AS (
            SELECT s.host, s.tool, s.session, max_by(c.name, length(c.name)) AS name FROM {TOOLS_SEEN} s
            LEFT JOIN (SELECT host, unnest(['engram', 'engram_mem', 'off', net, c_mktsegment]) AS name FROM hosts) c
              ON c.host = s.host AND starts_with(s.tool, c.name || '_') AND length(s.tool) > length(c.name) + 1
            GROUP BY ALL)
        SELECT c.host, c.name AS key, m.n AS never_observed, NULL::BIGINT AS unconfigured_observed
        FROM (SELECT host, unnest(['engram', 'engram_mem', net, c_mktsegment]) AS name FROM hosts) c
        JOIN (SELECT host, count(DISTINCT session) AS n FROM {TOOLS_SEEN} GROUP BY host) m ON m.host = c.host
        WHERE NOT EXISTS (SELECT 1 FROM owned o WHERE o.host = c.host AND o.name = c.name)
        UNION ALL
        SELECT host, tool, NULL, count(DISTINCT session) FROM owned WHERE name IS NULL GROUP BY host, tool""",
)
def _(t):
    t.table("orders").createOrReplaceTempView("orders")
    merged = audit.merge_servers(config.opencode_server_entries(t.config_files)).filter("is_winner")
    configured = merged.select("host", "name", audit.is_disabled(F.col("spec")).alias("is_disabled"))
    return audit.join_configured_by_prefix(configured, t.spark.sql(f"SELECT * FROM {TOOLS_SEEN}"))
