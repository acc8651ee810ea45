"""Queries over calls and results: volume, corruption, failure patterns."""

from pyspark.sql import functions as F

from agentmeter.functions import names, payload
from agentmeter.functions.window import ALWAYS, TimeWindow
from agentmeter.operators import audit, calls as call_ops
from agentmeter.operators import corruption, failures, matching, metrics, tools
from agentmeter.plans.catalog import query
from agentmeter.session import settle


def every():
    return ALWAYS.includes(F.col("ts"))


def january():
    return TimeWindow("2024-01-10", "2024-01-20").includes(F.col("ts"))


IN_JAN = "ts <> '' AND ts >= '2024-01-10' AND substr(ts, 1, 10) <= '2024-01-20'"

PLUGIN_NAMES = """
    SELECT DISTINCT unnest(['dock', 'field', 'field_kit', split_part(p_name, ' ', 1)]) AS plugin FROM part"""

# --- joins -----------------------------------------------------------------


@query(
    "join_result_to_use",
    "SELECT pos, idx, use_id, tool, hash, matched FROM calls",
)
def _(t):
    return t.calls.select(
        "pos", "idx", "use_id", F.col("call.tool").alias("tool"), F.col("call.hash").alias("hash"),
        F.col("call").isNotNull().alias("matched"),
    )


@query("unmatched_results", "SELECT pos, idx, use_id, session FROM calls WHERE NOT matched")
def _(t):
    return call_ops.unmatched(t.calls).select("pos", "idx", "use_id", "session")


UNANSWERED_SQL = "SELECT DISTINCT use_id FROM uses WHERE use_id NOT IN (SELECT use_id FROM calls WHERE matched)"


@query("unanswered_uses", UNANSWERED_SQL)
def _(t):
    return call_ops.unanswered(t.uses, t.calls, every())


@query("unanswered_uses_in_window", f"{UNANSWERED_SQL} AND {IN_JAN}")
def _(t):
    return call_ops.unanswered(t.uses, t.calls, january())


SIDE_FILES = """
    SELECT '/side/' || CAST(pos AS STRING) AS path, pos * 10 + 5 + CASE WHEN k > 50 THEN 1 ELSE 0 END AS length
    FROM t WHERE event_type <> 'click'"""


@query(
    "side_file_check",
    f"""SELECT persisted_path, CAST(persisted_size AS BIGINT) AS persisted_size, length, problem FROM (
            SELECT c.persisted_path, c.persisted_size, s.length,
                   CASE WHEN s.length IS NULL THEN 'missing' WHEN s.length <> c.persisted_size THEN 'size_mismatch' END AS problem
            FROM calls c LEFT JOIN ({SIDE_FILES}) s ON s.path = c.persisted_path
            WHERE c.external AND c.matched
            UNION ALL
            SELECT persisted_path, persisted_size, NULL, 'ambiguous' FROM calls
            WHERE persisted_path IS NOT NULL AND NOT external AND idx = 0
        ) WHERE problem IS NOT NULL""",
)
def _(t):
    t.t.createOrReplaceTempView("t")
    listing = t.spark.sql(SIDE_FILES)
    return call_ops.check_side_files(t.calls, listing)


@query(
    "call_attribution",
    "SELECT pos, idx, skill, plugin, mcp_server, denial FROM calls WHERE matched AND is_error",
)
def _(t):
    return t.matched.filter("is_error").select("pos", "idx", "skill", "plugin", "mcp_server", "denial")


@query(
    "tool_server_by_prefix",
    """SELECT n.tool, max_by(s.server, length(s.server)) AS server
       FROM (SELECT DISTINCT lower(p_type) || '_' || replace(p_name, ' ', '_') || '_' || CAST(p_size AS STRING) AS tool FROM part) n
       LEFT JOIN (SELECT DISTINCT lower(p_type) AS server FROM part WHERE p_size < 25
                  UNION SELECT DISTINCT lower(p_type) || '_' || split_part(p_name, ' ', 1) FROM part WHERE p_size < 10) s
         ON starts_with(n.tool, s.server || '_') AND length(n.tool) > length(s.server) + 1
       GROUP BY n.tool""",
)
def _(t):
    part = t.table("part")
    kind, first = F.lower("p_type"), F.split("p_name", " ")[0]
    tool_names = part.select(
        F.concat_ws("_", kind, F.translate("p_name", " ", "_"), F.col("p_size")).alias("tool")
    ).distinct()
    authority = part.filter("p_size < 25").select(kind.alias("server")).union(
        part.filter("p_size < 10").select(F.concat_ws("_", kind, first))
    )
    return matching.tool_servers(tool_names, authority)


@query(
    "plugin_by_segment",
    f"""SELECT n.segment, coalesce(max_by(s.plugin, length(s.plugin)), 'plugin (unresolved)') AS plugin
        FROM (SELECT DISTINCT 'plugin_' || replace(p_name, ' ', '_') AS segment FROM part
              UNION SELECT 'plugin_field_kit_srv' UNION SELECT 'plugin_field' UNION SELECT 'plugin_dock_buoy-two') n
        LEFT JOIN ({PLUGIN_NAMES}) s
          ON starts_with(n.segment, 'plugin_' || s.plugin || '_') AND length(n.segment) > length(s.plugin) + 8
        GROUP BY n.segment""",
)
def _(t):
    fixed = t.spark.createDataFrame(
        [("plugin_field_kit_srv",), ("plugin_field",), ("plugin_dock_buoy-two",)], "segment string"
    )
    segments = (
        t.table("part")
        .select(F.concat(F.lit("plugin_"), F.translate("p_name", " ", "_")).alias("segment"))
        .union(fixed)
        .distinct()
    )
    found = matching.segment_plugins(segments, t.plugins)
    return found.withColumn("plugin", F.coalesce("plugin", F.lit("plugin (unresolved)")))


@query(
    "rent_segments",
    f"""SELECT n.key, max_by(s.plugin, length(s.plugin)) AS plugin,
              coalesce('plugin_' || max_by(s.plugin, length(s.plugin)) || '_'
                       || substr(n.key, 9 + max(length(s.plugin))), n.key) AS segment,
              translate(coalesce('plugin_' || max_by(s.plugin, length(s.plugin)) || '_'
                       || substr(n.key, 9 + max(length(s.plugin))), n.key), ':. ', '___') AS canon
        FROM (SELECT DISTINCT 'plugin:' || replace(p_name, ' ', ':') AS key FROM part
              UNION SELECT DISTINCT p_name || '.x' FROM part) n
        LEFT JOIN ({PLUGIN_NAMES}) s
          ON starts_with(n.key, 'plugin:' || s.plugin || ':') AND length(n.key) > length(s.plugin) + 8
        GROUP BY n.key""",
)
def _(t):
    part = t.table("part")
    keys = (
        part.select(F.concat(F.lit("plugin:"), F.translate("p_name", " ", ":")).alias("key"))
        .union(part.select(F.concat("p_name", F.lit(".x"))))
        .distinct()
    )
    found = matching.rent_segments(keys, t.plugins)
    return found.withColumn("canon", names.mcp_canon(F.col("segment")))


# --- tool volume -------------------------------------------------------------

STAT_SQL = """count(*) AS calls, CAST(sum(context_bytes) AS BIGINT) AS context_bytes,
    CAST(sum(image_bytes) AS BIGINT) AS image_bytes, CAST(sum(produced_bytes) AS BIGINT) AS produced_bytes,
    count(*) FILTER (WHERE is_error) AS errors"""
SERVER_SQL = "regexp_extract(tool, '^mcp__(.*?)__', 1)"


@query("tools_by_tool", f"SELECT tool, {STAT_SQL} FROM calls WHERE matched GROUP BY tool")
def _(t):
    return tools.by_tool(tools.rollup(t.calls, every()))


@query(
    "tools_by_tool_in_window",
    f"SELECT tool, {STAT_SQL} FROM calls WHERE matched AND {IN_JAN} GROUP BY tool",
)
def _(t):
    return tools.by_tool(tools.rollup(t.calls, january()))


@query(
    "tools_by_server",
    f"SELECT {SERVER_SQL} AS server, {STAT_SQL} FROM calls WHERE matched AND {SERVER_SQL} <> '' GROUP BY 1",
)
def _(t):
    return tools.by_server(tools.by_tool(tools.rollup(t.calls, every())))


@query(
    "tools_by_plugin",
    f"""SELECT coalesce(p.plugin, 'plugin (unresolved)') AS plugin, {STAT_SQL}
        FROM calls c LEFT JOIN (
            SELECT seg, max_by(plugin, length(plugin)) AS plugin
            FROM (SELECT DISTINCT {SERVER_SQL} AS seg FROM uses) JOIN ({PLUGIN_NAMES})
              ON starts_with(seg, 'plugin_' || plugin || '_') AND length(seg) > length(plugin) + 8
            GROUP BY seg) p ON p.seg = {SERVER_SQL}
        WHERE matched AND starts_with({SERVER_SQL}, 'plugin_') GROUP BY 1""",
)
def _(t):
    per_server = tools.by_server(tools.by_tool(tools.rollup(t.calls, every())))
    return tools.by_plugin(per_server, t.plugins)


@query(
    "unresolved_segments",
    f"""SELECT DISTINCT {SERVER_SQL} AS segment FROM calls WHERE matched AND starts_with({SERVER_SQL}, 'plugin_')
        AND NOT EXISTS (SELECT 1 FROM ({PLUGIN_NAMES}) p WHERE starts_with({SERVER_SQL}, 'plugin_' || p.plugin || '_')
                        AND length({SERVER_SQL}) > length(p.plugin) + 8)""",
)
def _(t):
    per_server = tools.by_server(tools.by_tool(tools.rollup(t.calls, every())))
    return tools.unresolved_segments(per_server, t.plugins)


@query(
    "tools_totals",
    """SELECT count(*) FILTER (WHERE NOT matched) AS unmatched_results,
              count(DISTINCT tool) AS distinct_tools, count(*) FILTER (WHERE matched) AS calls,
              CAST(sum(context_bytes) FILTER (WHERE matched) AS BIGINT) AS context_bytes,
              CAST(sum(image_bytes) FILTER (WHERE matched) AS BIGINT) AS image_bytes,
              CAST(sum(produced_bytes) FILTER (WHERE matched) AS BIGINT) AS produced_bytes,
              count(*) FILTER (WHERE matched AND is_error) AS errors,
              count(*) FILTER (WHERE matched AND image_bytes > 0) AS image_results,
              count(*) FILTER (WHERE matched AND external) AS externalised_results,
              CAST(sum(persisted_size) FILTER (WHERE matched AND external) AS BIGINT) AS externalised_produced_bytes,
              CAST(sum(context_bytes) FILTER (WHERE matched AND external) AS BIGINT) AS externalised_context_bytes
       FROM calls""",
)
def _(t):
    rolled = tools.rollup(t.calls, every())
    return rolled.agg(
        F.sum("unmatched_results").alias("unmatched_results"),
        F.count_if(F.col("calls") > 0).alias("distinct_tools"),
        *[F.sum(c).alias(c) for c in (*tools.STATS, *tools.EXTRA)],
    )


RENT_SQL = """
    SELECT translate(CASE WHEN r_name = 'ASIA' THEN 'plugin:dock:crane' WHEN r_name = 'EUROPE' THEN 'search'
                     ELSE 'claude.ai ' || n_name END, ':. ', '___') AS server,
           CAST(sum(c_custkey + 1) AS BIGINT) AS rent_bytes
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1"""


@query(
    "rent_with_calls",
    f"""SELECT coalesce(c.server, r.server) AS server, coalesce(calls, 0) AS calls, coalesce(context_bytes, 0) AS context_bytes,
              coalesce(image_bytes, 0) AS image_bytes, coalesce(produced_bytes, 0) AS produced_bytes,
              coalesce(errors, 0) AS errors, r.rent_bytes, c.server IS NULL AS rent_only
        FROM (SELECT {SERVER_SQL} AS server, {STAT_SQL} FROM calls WHERE matched AND {SERVER_SQL} <> '' GROUP BY 1) c
        FULL JOIN ({RENT_SQL}) r ON c.server = r.server""",
)
def rent_with_calls(t):
    spelled = (
        F.when(F.col("r_name") == "ASIA", F.lit("plugin:dock:crane"))
        .when(F.col("r_name") == "EUROPE", F.lit("search"))
        .otherwise(F.concat(F.lit("claude.ai "), "n_name"))
    )
    rent_keys = (
        t.table("customer")
        .join(t.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy(spelled.alias("key"))
        .agg(F.sum(F.col("c_custkey") + 1).alias("attachment_bytes"))
    )
    per_server = tools.by_server(tools.by_tool(tools.rollup(t.calls, every())))
    return tools.rent_with_calls(per_server, tools.rent_by_server(rent_keys, None), "server")


@query(
    "rent_only_servers",
    f"""SELECT r.server, r.rent_bytes FROM ({RENT_SQL}) r
        WHERE r.server NOT IN (SELECT {SERVER_SQL} FROM calls WHERE matched)""",
)
def _(t):
    return rent_with_calls(t).filter("rent_only").select("server", "rent_bytes")


SKILL_RENT = "SELECT 'sk' || CAST(n_nationkey AS STRING) AS skill, CAST(count(*) AS BIGINT) AS rent_bytes FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1"


@query(
    "skill_calls",
    "SELECT invoked_skill AS skill, count(*) AS skill_calls FROM uses WHERE invoked_skill IS NOT NULL GROUP BY 1",
)
def _(t):
    return tools.skill_calls(t.uses, every())


@query(
    "skill_usage_union",
    f"""SELECT coalesce(r.skill, c.skill) AS skill, r.rent_bytes, coalesce(c.skill_calls, 0) AS skill_calls
        FROM ({SKILL_RENT}) r FULL JOIN (
            SELECT invoked_skill AS skill, count(*) AS skill_calls FROM uses WHERE invoked_skill IS NOT NULL GROUP BY 1) c
          ON r.skill = c.skill""",
)
def _(t):
    nations = t.table("nation").join(t.table("customer"), F.col("c_nationkey") == F.col("n_nationkey"))
    rent = nations.groupBy(F.concat(F.lit("sk"), F.col("n_nationkey").cast("string")).alias("skill")).agg(
        F.count(F.lit(1)).alias("rent_bytes")
    )
    return tools.skill_usage(rent, tools.skill_calls(t.uses, every()))


@query(
    "tool_shares",
    """SELECT tool, context_bytes, share_percent, CASE WHEN share_percent >= 50 THEN '!!' WHEN share_percent >= 35 THEN '***'
              WHEN share_percent >= 20 THEN '**' WHEN share_percent >= 5 THEN '*' ELSE '' END AS grade
       FROM (SELECT tool, CAST(sum(context_bytes) AS BIGINT) AS context_bytes,
                    round(100.0::DOUBLE * sum(context_bytes)::DOUBLE / sum(sum(context_bytes)) OVER ()::DOUBLE, 6) AS share_percent
             FROM calls WHERE matched GROUP BY tool)""",
)
def _(t):
    rows = tools.by_tool(tools.rollup(t.calls, every())).select("tool", "context_bytes")
    return metrics.share_of_total(rows, "context_bytes").withColumn(
        "share_percent", F.round("share_percent", 6)
    )


@query(
    "share_is_gradeable",
    """SELECT max(share) >= 5 AS gradeable FROM (
           SELECT 100.0 * sum(context_bytes)::DOUBLE / sum(sum(context_bytes)) OVER () AS share
           FROM calls WHERE matched GROUP BY tool)""",
)
def _(t):
    rows = tools.by_tool(tools.rollup(t.calls, every())).select("tool", "context_bytes")
    graded = metrics.share_of_total(rows, "context_bytes")
    return graded.agg(F.bool_or(F.col("grade") != "").alias("gradeable"))


@query(
    "top_calls_per_tool",
    """SELECT dimension, key, context_bytes, total, place FROM (
           SELECT tool AS dimension, session AS key, context_bytes,
                  count(*) OVER (PARTITION BY tool) AS total,
                  row_number() OVER (PARTITION BY tool ORDER BY context_bytes DESC, session) AS place
           FROM (SELECT tool, session, CAST(sum(context_bytes) AS BIGINT) AS context_bytes
                 FROM calls WHERE matched GROUP BY ALL)) WHERE place <= 15""",
)
def _(t):
    rows = t.matched.groupBy(F.col("tool").alias("dimension"), F.col("session").alias("key")).agg(
        F.sum("context_bytes").alias("context_bytes")
    )
    top = metrics.top_per_dimension(rows, "dimension", [F.desc("context_bytes"), F.col("key")])
    return top.withColumn("place", F.col("place").cast("bigint"))


@query(
    "tool_concentration",
    """SELECT round(100.0::DOUBLE * sum(b)::DOUBLE / max(w)::DOUBLE, 6) AS top3_percent, string_agg(tool, ',' ORDER BY tool) AS tools
       FROM (SELECT tool, sum(context_bytes) AS b, sum(sum(context_bytes)) OVER () AS w,
                    row_number() OVER (ORDER BY sum(context_bytes) DESC, tool) AS rn
             FROM calls WHERE matched GROUP BY tool) WHERE rn <= 3""",
)
def _(t):
    rows = tools.by_tool(tools.rollup(t.calls, every())).select("tool", "context_bytes")
    top = metrics.share_of_total(rows, "context_bytes").orderBy(F.desc("context_bytes"), "tool").limit(3)
    whole = rows.agg(F.sum("context_bytes"))
    return top.agg(
        F.round(F.lit(100.0) * F.sum("context_bytes").cast("double") / F.max(whole.scalar()).cast("double"), 6).alias("top3_percent"),
        F.array_join(F.sort_array(F.collect_list("tool")), ",").alias("tools"),
    )


# --- corruption ------------------------------------------------------------

CORRUPT_SQL = """count(*) AS calls, count(*) FILTER (WHERE is_error) AS errors,
    count(*) FILTER (WHERE is_error AND denial <> '') AS denied,
    count(*) FILTER (WHERE is_error AND denial = '') AS failures,
    count(*) FILTER (WHERE context_bytes = 0 AND image_bytes = 0 AND persisted_path IS NULL) AS empty_results,
    count(*) FILTER (WHERE marker <> '') AS truncated_results"""


@query(
    "corruption_by_tool",
    f"""SELECT *, round(100.0::DOUBLE * errors / calls, 6) AS error_rate_percent,
              round(100.0::DOUBLE * failures / calls, 6) AS failure_rate_percent
        FROM (SELECT tool, {CORRUPT_SQL} FROM calls WHERE matched AND {IN_JAN} GROUP BY tool)""",
)
def _(t):
    rows = corruption.by_tool(corruption.rollup(t.calls, january()))
    return rows.withColumns(
        {c: F.round(c, 6) for c in ("error_rate_percent", "failure_rate_percent")}
    )


@query(
    "denials_by_kind",
    "SELECT denial, count(*) AS denied FROM calls WHERE matched AND is_error AND denial <> '' GROUP BY 1",
)
def _(t):
    return corruption.by_denial(corruption.rollup(t.calls, every()))


@query(
    "truncated_by_marker",
    "SELECT marker, count(*) AS truncated_results FROM calls WHERE matched AND marker <> '' GROUP BY 1",
)
def _(t):
    return corruption.by_marker(corruption.rollup(t.calls, every()))


@query(
    "corruption_totals",
    f"""SELECT {CORRUPT_SQL}, (SELECT count(*) FROM calls WHERE NOT matched) AS unmatched_results,
              (SELECT count(*) FROM calls WHERE idx = 0 AND denial <> '' AND event_errors > 1) AS ambiguous_denials,
              count(DISTINCT tool) AS distinct_tools, count(DISTINCT nullif(marker, '')) AS truncation_marker_kinds
        FROM calls WHERE matched""",
)
def _(t):
    return corruption.totals(corruption.rollup(t.calls, every())).drop(
        "error_rate_percent", "failure_rate_percent", "empty_rate_percent", "truncation_rate_percent"
    )


# --- failure patterns --------------------------------------------------------


def loops_sql(windowed: bool) -> str:
    having = "count(*) >= 3" + (f" AND bool_or({IN_JAN})" if windowed else "")
    return f"""
        SELECT session, tool, hash, count(*) AS streak, CAST(count(*) FILTER (WHERE denial <> '') AS BIGINT) AS denied,
               min(pos) AS pos
        FROM (
            SELECT *, sum(brk) OVER (PARTITION BY session ORDER BY pos, idx) AS run FROM (
                SELECT *, CASE WHEN tool = lag(tool) OVER w AND hash = lag(hash) OVER w AND is_error = lag(is_error) OVER w
                               THEN 0 ELSE 1 END AS brk
                FROM calls WHERE matched WINDOW w AS (PARTITION BY session ORDER BY pos, idx)))
        WHERE is_error GROUP BY session, tool, hash, run HAVING {having}"""


@query("retry_loops", loops_sql(False))
def _(t):
    return failures.retry_loops(t.matched, every(), False, t.results).select(
        "session", "tool", "hash", "streak", "denied", "pos"
    )


@query("retry_loops_in_window", loops_sql(True))
def _(t):
    return failures.retry_loops(t.matched, january(), True, t.results).select(
        "session", "tool", "hash", "streak", "denied", "pos"
    )


@query(
    "numbered_loops",
    f"""SELECT session || '/' || tool || '/' || hash || CASE WHEN n > 1 THEN '#' || CAST(n AS VARCHAR) ELSE '' END AS key, streak
        FROM (SELECT *, row_number() OVER (PARTITION BY session, tool, hash ORDER BY pos) AS n FROM ({loops_sql(False)}))""",
)
def _(t):
    loops = settle(failures.retry_loops(t.matched, every(), False, t.results))
    return failures.numbered_loops(loops).select("key", "streak")


def _repeated_sql(window: str = "true") -> str:
    return f"""SELECT tool, hash, tool || '/' || hash AS key, count(*) AS calls, count(*) FILTER (WHERE is_error) AS errors,
              count(*) FILTER (WHERE is_error AND denial = '') AS failures,
              count(*) FILTER (WHERE is_error AND denial <> '') AS denied,
              count(DISTINCT session) FILTER (WHERE is_error) AS error_sessions
        FROM calls WHERE matched AND {window} GROUP BY tool, hash HAVING error_sessions >= 2"""


@query("repeated_failures", _repeated_sql())
def _(t):
    return failures.repeated_failures(failures.call_outcomes(t.matched, every()))


@query("repeated_failures_in_window", _repeated_sql(IN_JAN))
def _(t):
    return failures.repeated_failures(failures.call_outcomes(t.matched, january()))


@query(
    "failures_by_attribution",
    """SELECT dimension, key, count(*) AS errors, count(*) FILTER (WHERE denial = '') AS failures,
              count(*) FILTER (WHERE denial <> '') AS denied
       FROM (SELECT 'attribution_skill' AS dimension, skill AS key, denial FROM calls WHERE matched AND is_error
             UNION ALL SELECT 'attribution_plugin', plugin, denial FROM calls WHERE matched AND is_error
             UNION ALL SELECT 'attribution_mcp_server', mcp_server, denial FROM calls WHERE matched AND is_error)
       WHERE key <> '' GROUP BY ALL""",
)
def _(t):
    return failures.by_attribution(t.matched, every())


@query(
    "payload_identity",
    """SELECT substr(sha256('{"a":' || CAST(k AS VARCHAR) || ',"b":{"t":"<' || event_type || '>","z":1.50}}'), 1, 12) = 'x' AS never,
              CAST(count(*) AS BIGINT) AS calls
       FROM t GROUP BY k, event_type""",
)
def _(t):
    spaced = F.concat(
        F.lit('{ "b" : {"z":1.50, "t": "<'), "event_type", F.lit('>"},\n "a" : '),
        F.col("k").cast("string"), F.lit("}"),
    )
    tight = F.concat(
        F.lit('{"a":'), F.col("k").cast("string"), F.lit(',"b":{"t":"<'), "event_type", F.lit('>","z":1.50}}')
    )
    written = F.when(F.col("value") > 50, spaced).otherwise(tight)
    return (
        t.t.select(payload.payload_hash(written).alias("hash"))
        .groupBy("hash")
        .agg(F.count(F.lit(1)).alias("calls"))
        .select((F.col("hash") == "x").alias("never"), "calls")
    )


@query(
    "tool_names",
    """SELECT DISTINCT tool, regexp_extract(tool, '^mcp__(.*?)__', 1) AS server,
              translate('plugin:' || tool || '. x', ':. ', '___') AS canon FROM uses""",
)
def _(t):
    return t.uses.select(
        "tool",
        names.mcp_server(F.col("tool")).alias("server"),
        names.mcp_canon(F.concat(F.lit("plugin:"), "tool", F.lit(". x"))).alias("canon"),
    ).distinct()


@query(
    "server_sessions",
    """SELECT min(server) AS server, translate(server, ':. ', '___') AS canon, count(DISTINCT session) AS sessions
       FROM (SELECT session, mcp_server AS server FROM t WHERE mcp_server <> ''
             UNION ALL SELECT session, regexp_extract(tool, '^mcp__(.*?)__', 1) FROM uses)
       WHERE server <> '' GROUP BY canon""",
)
def _(t):
    host = F.lit("")
    observed = audit.observed_servers(
        t.events.withColumn("host", host), t.uses.withColumn("host", host), every()
    )
    return audit.server_sessions(observed).drop("host")


@query(
    "metric_rows",
    f"""SELECT name, 'tool' AS dimension, tool AS key, CAST(v AS BIGINT) AS value_long, unit FROM (
            SELECT tool, unnest([calls, errors, nullif(image_bytes, 0)]) AS v,
                   unnest(['calls', 'errors', 'image_bytes']) AS name, unnest(['calls', 'calls', 'bytes']) AS unit
            FROM (SELECT tool, {STAT_SQL} FROM calls WHERE matched GROUP BY tool)) WHERE v IS NOT NULL""",
)
def _(t):
    wide = tools.by_tool(tools.rollup(t.calls, every()))
    rows = metrics.unpivot(
        wide, "tools", 0, "tool", F.col("tool"),
        [
            metrics.Measure("calls", F.col("calls"), "calls"),
            metrics.Measure("errors", F.col("errors"), "calls"),
            metrics.Measure("image_bytes", F.nullif("image_bytes", F.lit(0)), "bytes"),
        ],
        [F.col("context_bytes")],
    )
    return metrics.validated(rows).select("name", "dimension", "key", "value_long", "unit")


_TWO_SQL = """SELECT 'tools' AS command, 'calls' AS name, tool AS key, count(*) AS v FROM calls WHERE matched GROUP BY tool
    UNION ALL SELECT 'tools', 'errors', tool, count(*) FILTER (WHERE is_error) FROM calls WHERE matched GROUP BY tool
    UNION ALL SELECT 'corruption', 'calls', tool, count(*) FROM calls WHERE matched GROUP BY tool
    UNION ALL SELECT 'corruption', 'errors', tool, count(*) FILTER (WHERE is_error AND denial = '') FROM calls WHERE matched GROUP BY tool
    UNION ALL SELECT 'corruption', 'truncated_results', tool, count(*) FILTER (WHERE marker <> '') FROM calls WHERE matched GROUP BY tool"""


@query(
    "merged_reports",
    f"""SELECT name, 'tool' AS dimension, key, max(command) AS command, max_by(v, command) AS value_long,
              min(v) <> max(v) AS disagrees, count(*) AS reporters
        FROM ({_TWO_SQL}) GROUP BY name, key""",
)
def _(t):
    return metrics.merge_reports(_two_reports(t), ("tools", "corruption")).select(
        "name", "dimension", "key", "command", "value_long", "disagrees", "reporters"
    )


def _two_reports(t):
    calls = t.calls
    one = metrics.unpivot(
        tools.by_tool(tools.rollup(calls, every())), "tools", 0, "tool", F.col("tool"),
        [metrics.Measure("calls", F.col("calls"), "calls"), metrics.Measure("errors", F.col("errors"), "calls")],
    )
    counted = corruption.by_tool(corruption.rollup(calls, every()))
    two = metrics.unpivot(
        counted, "corruption", 0, "tool", F.col("tool"),
        [
            metrics.Measure("calls", F.col("calls"), "calls"),
            metrics.Measure("errors", F.col("failures"), "calls"),
            metrics.Measure("truncated_results", F.col("truncated_results"), "calls"),
        ],
    )
    return one.unionByName(two)

@query(
    "disagreements",
    f"""SELECT name || '/tool/' || "key" AS key FROM ({_TWO_SQL}) GROUP BY name, "key" HAVING min(v) <> max(v)""",
)
def _(t):
    return metrics.disagreement_warnings(_two_reports(t), ("tools", "corruption")).select("key")


@query(
    "derivation_legend",
    f"SELECT name, 'measured' AS derivation, '' AS method, count(*) AS rows FROM ({_TWO_SQL}) GROUP BY name",
)
def _(t):
    return metrics.derivations(_two_reports(t))
