"""Whole commands over the given tables, as metric rows."""

from pyspark.sql import functions as F

from agentmeter.functions.window import TimeWindow
from agentmeter.operators import attachments
from agentmeter.operators import metrics as metrics_ops
from agentmeter.plans import commands
from agentmeter.plans.catalog import query
from agentmeter.plans.catalog_audit import MERGED, PLUGIN_FINDINGS, SERVER_FINDINGS
from agentmeter.plans.catalog_calls import CORRUPT_SQL, PLUGIN_NAMES, SERVER_SQL, STAT_SQL, loops_sql
from agentmeter.plans.catalog_rollouts import BY_TOOL_SQL, JOINED_SQL, TROUBLED_SQL
from agentmeter.plans.catalog_sources import COUNTERS_SQL, file_rows
from agentmeter.plans.catalog_tokens import ALLOCATED, KEYED_SQL, LISTING_SQL, attached_objects
from agentmeter.session import scratch_path
from agentmeter.sources import config, rollouts, transcripts


def corpus(t):
    """Silver tables: calls, responses and bills from events, attachments from
    documents, files from the users of events."""
    rows = file_rows(t)
    listing = rows.groupBy("file").agg(F.sum("size").cast("bigint").alias("bytes"))
    lines = t.listings.select(
        "pos", F.lit(0).cast("bigint").alias("chunk"), F.lit("").alias("session"), F.lit("").alias("ts"),
        F.col("lang").alias("type"), F.octet_length("text").cast("bigint").alias("bytes"),
    )
    keys = attachments.key_rows(attached_objects(t), F.col("attachment"), "pos")
    return transcripts.Corpus(
        events=t.events,
        uses=t.uses,
        results=t.results,
        usage=t.usage,
        bills=t.bills,
        attachments=lines,
        attachment_keys=keys.withColumn("ts", F.lit("")),
        manifest=transcripts.file_manifest(listing, transcripts.file_quality(rows)),
        side_files=t.spark.createDataFrame([], transcripts.SIDE_FILE_SCHEMA),
    )


def shown(metrics):
    return metrics.select(
        "name", "dimension", "key", "value_long", F.round("value_double", 6).alias("value_double"), "unit", "derivation"
    )


def spread(wide: str, dimension: str, key: str, *specs: str) -> str:
    """SQL for the metric rows of a wide query; spec is name:unit[:real|est]."""
    rows = []
    for spec in specs:
        name, unit, kind = (spec + ":").split(":")[:3]
        value = (
            f"NULL::BIGINT AS value_long, round({name}::DOUBLE, 6) AS value_double"
            if kind == "real"
            else f"CAST({name} AS BIGINT) AS value_long, NULL::DOUBLE AS value_double"
        )
        derivation = "estimated" if kind == "est" else "measured"
        rows.append(
            f"SELECT '{name}' AS name, {dimension} AS dimension, {key} AS key, {value}, '{unit}' AS unit, "
            f"'{derivation}' AS derivation FROM ({wide}) WHERE {name} IS NOT NULL"
        )
    return " UNION ALL ".join(rows)


STATS = ("calls:calls", "context_bytes:bytes", "image_bytes:bytes", "produced_bytes:bytes", "errors:calls")
PCT = "100.0::DOUBLE * {0}::DOUBLE / {1}::DOUBLE AS {2}"

SCAN_SQL = " UNION ALL ".join(
    [
        spread(
            f"SELECT *, 21 AS known_event_types FROM {COUNTERS_SQL}", "'corpus'", "''", "files:files", "bytes:bytes",
            "files_top_level:files", "files_subagent:files", "known_event_types:types", "parse_errors:errors",
            "files_non_transcript:files", "non_transcript_records:records",
        ),
        spread(
            """SELECT count(*) AS events, count(DISTINCT type) AS distinct_event_types,
                      count(DISTINCT nullif(version, '')) AS distinct_cli_versions FROM t""",
            "'corpus'", "''", "events:events", "distinct_event_types:types", "distinct_cli_versions:versions",
        ),
        spread("SELECT type, count(*) AS events FROM t GROUP BY type", "'type'", "type", "events:events"),
        spread(
            "SELECT version, count(*) AS events FROM t WHERE version <> '' GROUP BY version", "'cli_version'", "version",
            "events:events",
        ),
        spread(
            "SELECT type, count(*) AS unknown_type_events FROM t WHERE type = 'glide-path' GROUP BY type",
            "'unknown_type'", "type", "unknown_type_events:events",
        ),
    ]
)


@query("scan_metrics", SCAN_SQL)
def _(t):
    return shown(commands.scan(corpus(t)).metrics)


TOOLS_SQL = " UNION ALL ".join(
    [
        spread(
            f"""SELECT {STAT_SQL}, (SELECT count(*) FROM uses) AS tool_use_blocks, count(*) AS tool_result_blocks,
                      (SELECT count(*) FROM calls WHERE NOT matched) AS unmatched_results,
                      (SELECT count(DISTINCT use_id) FROM uses WHERE use_id NOT IN (SELECT use_id FROM calls WHERE matched)) AS unanswered_uses,
                      count(DISTINCT tool) AS distinct_tools, count(*) FILTER (WHERE image_bytes > 0) AS image_results,
                      count(*) FILTER (WHERE external) AS externalised_results,
                      sum(persisted_size) FILTER (WHERE external) AS externalised_produced_bytes,
                      sum(context_bytes) FILTER (WHERE external) AS externalised_context_bytes
                FROM calls WHERE matched""",
            "'corpus'", "''", "tool_use_blocks:blocks", "tool_result_blocks:blocks", "unmatched_results:blocks",
            "unanswered_uses:blocks", "distinct_tools:tools", *STATS, "image_results:results",
            "externalised_results:results", "externalised_produced_bytes:bytes", "externalised_context_bytes:bytes",
        ),
        spread(f"SELECT tool, {STAT_SQL} FROM calls WHERE matched GROUP BY tool", "'tool'", "tool", *STATS),
        spread(
            f"SELECT {SERVER_SQL} AS server, {STAT_SQL} FROM calls WHERE matched AND {SERVER_SQL} <> '' GROUP BY 1",
            "'mcp_server'", "server", *STATS,
        ),
        spread(
            f"""SELECT coalesce(p.plugin, 'plugin (unresolved)') AS plugin, {STAT_SQL}
                FROM calls c LEFT JOIN (
                    SELECT seg, max_by(plugin, length(plugin)) AS plugin
                    FROM (SELECT DISTINCT {SERVER_SQL} AS seg FROM uses) JOIN ({PLUGIN_NAMES})
                      ON starts_with(seg, 'plugin_' || plugin || '_') AND length(seg) > length(plugin) + 8
                    GROUP BY seg) p ON p.seg = {SERVER_SQL}
                WHERE matched AND starts_with({SERVER_SQL}, 'plugin_') GROUP BY 1""",
            "'plugin'", "plugin", *STATS,
        ),
        spread(
            f"SELECT key, sum(bytes) AS rent_bytes FROM ({LISTING_SQL}) GROUP BY key", "'skill'", "key", "rent_bytes:bytes"
        ),
        spread(
            f"""SELECT coalesce(r.key, c.skill) AS skill, coalesce(c.n, 0) AS skill_calls
                FROM (SELECT DISTINCT key FROM ({LISTING_SQL})) r FULL JOIN (
                    SELECT invoked_skill AS skill, count(*) AS n FROM uses WHERE invoked_skill IS NOT NULL GROUP BY 1) c
                  ON r.key = c.skill""",
            "'skill'", "skill", "skill_calls:calls",
        ),
    ]
)


@query("tools_metrics", TOOLS_SQL)
def _(t):
    return shown(commands.tools(corpus(t), plugins=t.plugins).metrics)


CORRUPTION_SQL = " UNION ALL ".join(
    [
        spread(
            f"""SELECT *, {PCT.format('errors', 'calls', 'error_rate_percent')}, {PCT.format('failures', 'calls', 'failure_rate_percent')},
                      {PCT.format('empty_results', 'calls', 'empty_rate_percent')},
                      {PCT.format('truncated_results', 'calls', 'truncation_rate_percent')}
                FROM (SELECT {CORRUPT_SQL}, (SELECT count(*) FROM calls WHERE NOT matched) AS unmatched_results,
                             count(DISTINCT tool) AS distinct_tools, count(DISTINCT nullif(marker, '')) AS truncation_marker_kinds
                      FROM calls WHERE matched)""",
            "'corpus'", "''", "unmatched_results:blocks", "calls:calls", "distinct_tools:tools", "errors:calls",
            "error_rate_percent:percent:real", "denied:calls", "failures:calls", "failure_rate_percent:percent:real",
            "empty_results:calls", "empty_rate_percent:percent:real", "truncated_results:calls",
            "truncation_rate_percent:percent:real", "truncation_marker_kinds:markers",
        ),
        spread(
            f"""SELECT *, {PCT.format('errors', 'calls', 'error_rate_percent')}, {PCT.format('failures', 'calls', 'failure_rate_percent')}
                FROM (SELECT tool, {CORRUPT_SQL} FROM calls WHERE matched GROUP BY tool)""",
            "'tool'", "tool", "calls:calls", "errors:calls", "error_rate_percent:percent:real", "denied:calls",
            "failures:calls", "failure_rate_percent:percent:real", "empty_results:calls", "truncated_results:calls",
        ),
        spread(
            "SELECT marker, count(*) AS truncated_results FROM calls WHERE matched AND marker <> '' GROUP BY 1",
            "'truncation_marker'", "marker", "truncated_results:calls",
        ),
        spread(
            "SELECT denial, count(*) AS denied FROM calls WHERE matched AND is_error AND denial <> '' GROUP BY 1",
            "'denial_kind'", "denial", "denied:calls",
        ),
    ]
)


@query("corruption_metrics", CORRUPTION_SQL)
def _(t):
    return shown(commands.corruption(corpus(t)).metrics)


PAIRS_SQL = """SELECT tool || '/' || hash AS key, count(*) AS calls, count(*) FILTER (WHERE is_error) AS errors,
    count(*) FILTER (WHERE is_error AND denial = '') AS failures, count(*) FILTER (WHERE is_error AND denial <> '') AS denied,
    count(DISTINCT session) FILTER (WHERE is_error) AS error_sessions
    FROM calls WHERE matched GROUP BY tool, hash HAVING error_sessions >= 2"""
FAILURES_SQL = " UNION ALL ".join(
    [
        spread(
            f"""SELECT (SELECT count(*) FROM ({loops_sql(False)})) AS retry_loops,
                      (SELECT count(*) FROM ({PAIRS_SQL})) AS repeated_failure_pairs,
                      count(*) FILTER (WHERE matched AND is_error) AS errored_results,
                      count(*) FILTER (WHERE NOT matched) AS unmatched_results FROM calls""",
            "'corpus'", "''", "retry_loops:loops", "repeated_failure_pairs:pairs", "errored_results:calls",
            "unmatched_results:blocks",
        ),
        spread(
            f"""SELECT session || '/' || tool || '/' || hash || CASE WHEN n > 1 THEN '#' || CAST(n AS VARCHAR) ELSE '' END AS key,
                      streak AS consecutive_errors, denied AS consecutive_denials
                FROM (SELECT *, row_number() OVER (PARTITION BY session, tool, hash ORDER BY pos) AS n FROM ({loops_sql(False)}))""",
            "'retry_loop'", "key", "consecutive_errors:calls", "consecutive_denials:calls",
        ),
        spread(
            PAIRS_SQL, "'repeated_failure'", "key", "calls:calls", "errors:calls", "failures:calls", "denied:calls",
            "error_sessions:sessions",
        ),
        spread(
            """SELECT d, k, count(*) AS errors, count(*) FILTER (WHERE denial = '') AS failures, count(*) FILTER (WHERE denial <> '') AS denied
               FROM (SELECT unnest(['attribution_skill', 'attribution_plugin', 'attribution_mcp_server']) AS d,
                            unnest([skill, plugin, mcp_server]) AS k, denial FROM calls WHERE matched AND is_error)
               WHERE k <> '' GROUP BY d, k""",
            "d", "k", "errors:calls", "failures:calls", "denied:calls",
        ),
    ]
)


@query("failures_metrics", FAILURES_SQL)
def _(t):
    return shown(commands.failures(corpus(t)).metrics)


RATIO = "CASE WHEN {1} = 0 THEN 0 ELSE {0}::DOUBLE / {1} END AS {2}"
TOKEN_SQL = """count(*) AS responses, CAST(sum(fresh) AS BIGINT) AS fresh_tokens, CAST(sum(cache_read) AS BIGINT) AS rebilled_tokens,
    CAST(sum(output) AS BIGINT) AS output_tokens, CAST(sum(thinking) AS BIGINT) AS thinking_tokens"""
ATTRIBUTE_SQL = " UNION ALL ".join(
    [
        spread(
            f"""SELECT *, {RATIO.format('rebilled_tokens', 'fresh_tokens', 'rebill_multiplier')},
                      {PCT.format('responses_duplicate', 'responses_naive', 'duplicate_rate_percent')}
                FROM (SELECT {TOKEN_SQL}, sum(sightings) AS responses_naive, count(*) AS responses_distinct,
                             sum(sightings) - count(*) AS responses_duplicate FROM responses)""",
            "'corpus'", "''", "responses_naive:responses", "responses_distinct:responses", "responses_duplicate:responses",
            "duplicate_rate_percent:percent:real", "fresh_tokens:tokens", "rebilled_tokens:tokens", "output_tokens:tokens",
            "thinking_tokens:tokens", "rebill_multiplier:ratio:real",
        ),
        spread(
            f"""SELECT *, {PCT.format('sessions_with_cost_state', 'sessions', 'cost_state_coverage_percent')}
                FROM (SELECT count(DISTINCT session) AS sessions, (SELECT count(*) FROM last_bills) AS sessions_with_cost_state,
                             count(DISTINCT session) FILTER (WHERE session NOT IN (SELECT session FROM last_bills)) AS sessions_without_cost_state
                      FROM t)""",
            "'corpus'", "''", "sessions:sessions", "sessions_with_cost_state:sessions", "sessions_without_cost_state:sessions",
            "cost_state_coverage_percent:percent:real",
        ),
        spread(
            f"""SELECT *, {PCT.format('attachment_bytes', f'(SELECT bytes FROM {COUNTERS_SQL})', 'attachment_share_percent')}
                FROM (SELECT count(*) AS attachment_events, sum(strlen(text)) AS attachment_bytes, count(DISTINCT lang) AS attachment_types
                      FROM documents)""",
            "'corpus'", "''", "attachment_events:events", "attachment_bytes:bytes", "attachment_share_percent:percent:real",
            "attachment_types:types",
        ),
        spread(
            f"""SELECT allocated_cost_usd, billed - allocated_cost_usd AS unallocated_cost_usd FROM (
                    SELECT (SELECT sum(CAST(round(total_usd * 1e6) AS BIGINT)) FROM last_bills) AS billed,
                           (SELECT sum(micro) FROM ({ALLOCATED}) WHERE dimension = 'session') AS allocated_cost_usd)""",
            "'corpus'", "''", "allocated_cost_usd:microdollars:est", "unallocated_cost_usd:microdollars:est",
        ),
        spread(
            f"""SELECT d.*, c.cost_usd, {RATIO.format('rebilled_tokens', 'fresh_tokens', 'rebill_multiplier')}
                FROM (SELECT dimension, key, {TOKEN_SQL} FROM dims GROUP BY dimension, key) d
                LEFT JOIN (SELECT dimension, key, sum(micro) AS cost_usd FROM ({ALLOCATED}) GROUP BY ALL) c
                  ON c.dimension = d.dimension AND c.key = d.key""",
            "dimension", "key", "responses:responses", "fresh_tokens:tokens", "rebilled_tokens:tokens",
            "rebill_multiplier:ratio:real", "cost_usd:microdollars:est",
        ),
        spread(
            """SELECT session, CAST(session IN (SELECT session FROM last_bills) AS BIGINT) AS dollars_available
               FROM (SELECT DISTINCT session FROM responses)""",
            "'session'", "session", "dollars_available:sessions",
        ),
        spread(
            """SELECT b.session || '/' || b.model AS key, r.tokens AS transcript_tokens,
                      CASE WHEN r.tokens IS NOT NULL THEN b.billed_tokens END AS billed_tokens,
                      CASE WHEN r.tokens IS NULL THEN 0 ELSE r.tokens::DOUBLE / b.billed_tokens END AS coverage_ratio
               FROM model_bills b LEFT JOIN (
                   SELECT session, model, CAST(sum(fresh + cache_read + output) AS BIGINT) AS tokens FROM responses GROUP BY ALL) r
                 ON b.session = r.session AND b.model = r.model""",
            "'cost_coverage'", "key", "coverage_ratio:ratio:real", "transcript_tokens:tokens", "billed_tokens:tokens",
        ),
        spread(
            "SELECT lang, count(*) AS attachment_events, sum(strlen(text)) AS attachment_bytes FROM documents GROUP BY lang",
            "'attachment_type'", "lang", "attachment_events:events", "attachment_bytes:bytes",
        ),
        spread(
            f"SELECT dimension, key, count(*) AS attachment_events, sum(bytes) AS attachment_bytes FROM ({KEYED_SQL}) GROUP BY ALL",
            "dimension", "key", "attachment_events:events", "attachment_bytes:bytes",
        ),
    ]
)


@query("attribute_metrics", ATTRIBUTE_SQL)
def _(t):
    return shown(commands.attribute(corpus(t)).metrics)


@query(
    "report_metrics",
    f"""SELECT name, dimension, key, value_long, value_double, unit, derivation FROM (
            SELECT *, row_number() OVER (PARTITION BY name, dimension, key ORDER BY place) AS rn FROM (
                SELECT 1 AS place, * FROM ({SCAN_SQL}) UNION ALL SELECT 2, * FROM ({TOOLS_SQL})
                UNION ALL SELECT 3, * FROM ({ATTRIBUTE_SQL}) UNION ALL SELECT 4, * FROM ({CORRUPTION_SQL})))
        WHERE rn = 1""",
)
def _(t):
    return shown(commands.report(corpus(t), plugins=t.plugins).metrics)


@query(
    "report_warnings",
    """SELECT command, code, count(*) AS warnings FROM (
           SELECT 'scan' AS command, 'retention_gap_unavailable' AS code
           UNION ALL SELECT 'scan', 'non_transcript_records'
           UNION ALL SELECT 'scan', 'unknown_type'
           UNION ALL SELECT unnest(['scan', 'tools', 'attribute', 'corruption']), 'parse_errors'
           UNION ALL SELECT 'tools', 'unmatched_result' FROM calls WHERE NOT matched
           UNION ALL SELECT 'tools', 'side_file' FROM calls WHERE matched AND external
           UNION ALL SELECT 'tools', 'side_file' FROM calls WHERE persisted_path IS NOT NULL AND NOT external AND idx = 0
           UNION ALL SELECT 'tools', 'unresolved_segment' FROM (SELECT 1 WHERE EXISTS (SELECT 1 FROM calls WHERE tool LIKE 'mcp__plugin_ghost%'))
           UNION ALL SELECT unnest(['attribute', 'attribute', 'attribute', 'attribute']),
                            unnest(['duplicate_responses', 'sessions_without_bill', 'billed_model_absent', 'attribution_absent'])
           UNION ALL SELECT 'attribute', 'billed_model_absent' FROM (
               SELECT DISTINCT b.model FROM model_bills b WHERE b.model <> 'haiku-bg' AND NOT EXISTS (
                   SELECT 1 FROM responses r WHERE r.session = b.session AND r.model = b.model))
           UNION ALL SELECT 'attribute', 'attribution_thin' FROM (
               SELECT dimension FROM dims WHERE dimension <> 'session' GROUP BY dimension
               HAVING count(*) FILTER (WHERE key <> '(unattributed)') > 0
                  AND sum(cache_read) FILTER (WHERE key = '(unattributed)') > 0.5 * sum(cache_read))
           UNION ALL SELECT 'corruption', unnest(['denials', 'ambiguous_denials', 'truncation']))
       GROUP BY command, code""",
)
def _(t):
    found = commands.report(corpus(t), plugins=t.plugins).warnings
    return found.groupBy("command", "code").agg(F.count(F.lit(1)).alias("warnings"))


@query(
    "report_summary",
    f"""SELECT figure, about, round(value, 6) AS value FROM (
        SELECT name AS figure, '' AS about, coalesce(value_double, value_long::DOUBLE) AS value FROM ({ATTRIBUTE_SQL})
        WHERE dimension = 'corpus' AND name IN ('rebill_multiplier', 'duplicate_rate_percent', 'attachment_share_percent',
                                                'allocated_cost_usd', 'unallocated_cost_usd')
        UNION ALL
        SELECT 'tool_concentration_percent', string_agg(tool, ',' ORDER BY tool), 100.0::DOUBLE * sum(b)::DOUBLE / max(w)::DOUBLE
        FROM (SELECT tool, sum(context_bytes) AS b, sum(sum(context_bytes)) OVER () AS w,
                     row_number() OVER (ORDER BY sum(context_bytes) DESC, tool) AS rn
              FROM calls WHERE matched GROUP BY tool) WHERE rn <= 3
        UNION ALL
        SELECT * FROM (
            SELECT 'thinnest_attribution_percent', dimension, 100.0::DOUBLE * sum(cache_read)::DOUBLE
                   / (SELECT sum(cache_read)::DOUBLE FROM responses)
            FROM dims WHERE key = '(unattributed)' GROUP BY dimension
            ORDER BY sum(cache_read) DESC, list_position(['attribution_skill', 'attribution_plugin', 'attribution_agent',
                'attribution_mcp_server', 'attribution_mcp_tool'], dimension) LIMIT 1))""",
)
def _(t):
    figures = commands.summary(commands.report(corpus(t), plugins=t.plugins).metrics)
    return figures.withColumn("value", F.round("value", 6))


@query(
    "windowed_report_metrics",
    " UNION ALL ".join(
        [
            spread(
                f"SELECT * FROM {COUNTERS_SQL}", "'corpus'", "''", "files:files", "bytes:bytes",
                "files_top_level:files", "files_subagent:files", "parse_errors:errors", "files_non_transcript:files",
                "non_transcript_records:records",
            ),
            spread("SELECT 21 AS known_event_types", "'corpus'", "''", "known_event_types:types"),
            spread(
                "SELECT count(*) AS unmatched_results FROM calls WHERE NOT matched", "'corpus'", "''",
                "unmatched_results:blocks",
            ),
            spread(
                "SELECT type, count(*) AS unknown_type_events FROM t WHERE type = 'glide-path' GROUP BY type",
                "'unknown_type'", "type", "unknown_type_events:events",
            ),
        ]
    ),
)
def _(t):
    """A window without events: only what no window restricts remains."""
    beyond = TimeWindow(since="2031-01-01")
    return shown(commands.report(corpus(t), beyond, plugins=t.plugins).metrics)


@query(
    "doctor_metrics",
    " UNION ALL ".join(
        [
            spread(
                """SELECT count(*) AS plugins_checked,
                          CASE WHEN bool_and(c_acctbal >= 0) THEN 6 * count(*) END AS mcp_servers_checked FROM hosts""",
                "'corpus'", "''", "plugins_checked:plugins", "mcp_servers_checked:servers",
            ),
            spread(
                "SELECT host, 1 AS plugins_checked, CASE WHEN c_acctbal >= 0 THEN 6 END AS mcp_servers_checked FROM hosts",
                "'host'", "host", "plugins_checked:plugins", "mcp_servers_checked:servers",
            ),
            spread(
                f"""SELECT dimension, host || '/' || key AS key, count(*) AS findings
                    FROM (SELECT * FROM {PLUGIN_FINDINGS} UNION ALL SELECT * FROM {SERVER_FINDINGS}) GROUP BY ALL""",
                "dimension", "key", "findings:findings",
            ),
        ]
    ),
)
def _(t):
    return shown(commands.doctor(t.config_files).metrics)


@query(
    "rollout_metrics",
    " UNION ALL ".join(
        [
            spread(
                f"""SELECT count(*) FILTER (WHERE status <> 'unmatched') AS tool_use_blocks,
                          count(*) FILTER (WHERE status = 'joined') AS tool_result_blocks,
                          count(*) FILTER (WHERE status = 'unanswered') AS unanswered_uses,
                          count(DISTINCT tool) FILTER (WHERE status = 'joined') AS distinct_tools,
                          count(*) FILTER (WHERE status = 'joined') AS calls,
                          sum(bytes) FILTER (WHERE status = 'joined') AS context_bytes, 0 AS image_bytes, 0 AS image_results,
                          count(*) FILTER (WHERE status = 'unmatched') AS unmatched_results
                    FROM {JOINED_SQL}""",
                "'corpus'", "''", "tool_use_blocks:blocks", "tool_result_blocks:blocks", "unanswered_uses:blocks",
                "distinct_tools:tools", "calls:calls", "context_bytes:bytes", "image_bytes:bytes", "image_results:results",
                "unmatched_results:blocks",
            ),
            spread(
                f"""SELECT tool, count(*) AS calls, sum(bytes) AS context_bytes, 0 AS image_bytes
                    FROM {JOINED_SQL} WHERE status = 'joined' GROUP BY tool""",
                "'tool'", "tool", "calls:calls", "context_bytes:bytes", "image_bytes:bytes",
            ),
            spread(
                f"""SELECT count(*) AS calls, sum(bytes) AS context_bytes, 0 AS image_bytes
                    FROM {JOINED_SQL} WHERE status = 'joined'""",
                "'mcp_server'", "'docs'", "calls:calls", "context_bytes:bytes", "image_bytes:bytes",
            ),
        ]
    ),
)
def _(t):
    size = t.table("conversations").agg(F.sum(F.octet_length("text")))
    return shown(commands.codex_tools(t.scoped, size, strict=False).metrics)


@query(
    "parts_metrics",
    " UNION ALL ".join(
        [
            spread(
                f"SELECT count(*) AS distinct_tools, sum(calls) AS calls, sum(context_bytes) AS context_bytes FROM ({BY_TOOL_SQL} GROUP BY tool)",
                "'corpus'", "''", "distinct_tools:tools", "calls:calls", "context_bytes:bytes",
            ),
            spread(
                f"{BY_TOOL_SQL} GROUP BY tool", "'tool'", "tool", "calls:calls", "context_bytes:bytes", "errors:calls"
            ),
            spread(
                f"""SELECT server, sum(calls) AS calls, sum(context_bytes) AS context_bytes, sum(errors) AS errors
                    FROM (SELECT *, CASE WHEN starts_with(tool, 'engram_mem_') THEN 'engram_mem'
                                         WHEN starts_with(tool, 'engram_') THEN 'engram' END AS server
                          FROM ({BY_TOOL_SQL} GROUP BY tool)) WHERE server IS NOT NULL GROUP BY server""",
                "'mcp_server'", "server", "calls:calls", "context_bytes:bytes", "errors:calls",
            ),
        ]
    ),
)
def _(t):
    servers = config.opencode_servers(t.config_files).select("server")
    return shown(commands.opencode_tools(t.parts, servers).metrics)


# --- end to end: lines written to files, read back, every command run --------------


def transcript_lines(t):
    """The adapter's events and attachments as JSONL, (pos, line)."""
    text = lambda c: F.col(c).cast("string")
    counts = F.to_json(
        F.struct(
            F.col("input_tokens"), F.col("output").alias("output_tokens"), F.col("cache_read").alias("cache_read_input_tokens"),
            F.struct(F.col("thinking").alias("thinking_tokens")).alias("output_tokens_details"),
            F.struct(
                F.col("cache_5m").alias("ephemeral_5m_input_tokens"), F.col("cache_1h").alias("ephemeral_1h_input_tokens")
            ).alias("cache_creation"),
        )
    )
    asked = F.concat(
        F.lit(',"attributionSkill":"'), "skill", F.lit('","attributionPlugin":"'), "plugin",
        F.lit('","attributionMcpServer":"'), "mcp_server", F.lit('","attributionMcpTool":"'), "mcp_tool",
        F.lit('","message":{"id":"'), "message_id", F.lit('","model":"'), "model", F.lit('","usage":'), counts,
        F.lit(',"content":[{"type":"tool_use","id":"'), "use_id", F.lit('","name":"'), "tool", F.lit('","input":'),
        "tool_input", F.lit("}]}"),
    )
    uses = t.uses.select("pos", "use_id", "tool", F.col("input").alias("tool_input"))
    usage = t.usage.drop("chunk", "session", "ts").withColumnRenamed("input", "input_tokens")
    joined = uses.join(usage, "pos").select("pos", asked.alias("extra"))

    body = F.concat("marker", F.repeat(F.lit("x"), (F.col("context_bytes") - F.length("marker")).cast("int")))
    image = F.repeat(F.lit("A"), F.col("image_bytes").cast("int"))
    shaped = F.when(
        F.col("image_bytes") > 0,
        F.concat(
            F.lit('[{"type":"text","text":"'), body, F.lit('"},{"type":"image","source":{"data":"'), image, F.lit('"}}]')
        ),
    ).otherwise(F.concat(F.lit('"'), body, F.lit('"')))
    block = F.concat(
        F.lit('{"type":"tool_result","tool_use_id":"'), "use_id", F.lit('","is_error":'), text("is_error"),
        F.lit(',"content":'), shaped, F.lit("}"),
    )
    # An event holds at most two results here.
    answers = t.results.groupBy("pos", "denial", "persisted_path", "persisted_size").agg(
        F.array_sort(F.collect_list(F.struct("idx", block.alias("block")))).alias("blocks")
    )
    stored = F.coalesce(
        F.concat(
            F.lit(',"toolUseResult":{"persistedOutputPath":"'), "persisted_path", F.lit('","persistedOutputSize":'),
            text("persisted_size"), F.lit("}"),
        ),
        F.lit(""),
    )
    answered = answers.select(
        "pos",
        F.concat(
            F.lit(',"toolDenialKind":"'), "denial", F.lit('"'), stored, F.lit(',"message":{"content":['),
            F.array_join(F.transform("blocks", lambda b: b["block"]), ","), F.lit("]}"),
        ).alias("extra"),
    )
    models = F.to_json(
        F.transform_values(
            "models",
            lambda _, m: F.struct(
                m["input"].alias("inputTokens"), m["output"].alias("outputTokens"),
                m["cache_read"].alias("cacheReadInputTokens"), m["cache_create"].alias("cacheCreationInputTokens"),
                m["cost_usd"].alias("costUSD"),
            ),
        )
    )
    billed = t.bills.select(
        "pos", F.concat(F.lit(',"totalCostUSD":'), text("total_usd"), F.lit(',"modelUsage":'), models).alias("extra")
    )
    head = F.concat(
        F.lit('{"type":"'), "type", F.lit('","sessionId":"'), "session", F.lit('","timestamp":"'), "ts",
        F.lit('","version":"'), "version", F.lit('"'),
    )
    extras = joined.unionByName(answered).unionByName(billed)
    events = t.t.join(extras, "pos", "left").select(
        "pos", F.concat(head, F.coalesce("extra", F.lit("")), F.lit("}")).alias("line")
    )
    documents = attached_objects(t).select(
        (-1 - F.col("pos")).alias("pos"),
        F.concat(F.lit('{"type":"attachment","attachment":'), "attachment", F.lit("}")).alias("line"),
    )
    return events.unionByName(documents)


#: Lines of a written file. A compressed file can't be split, so this bounds what a task reads at once.
LINES_PER_FILE = 16384


def write_transcripts(t) -> str:
    """JSONL below the shared folder, compressed; file order is scan order."""
    path = scratch_path(t.spark, "transcripts")
    ordered = transcript_lines(t).repartitionByRange("pos").sortWithinPartitions("pos")
    ordered.select("line").write.option("maxRecordsPerFile", LINES_PER_FILE).text(path, compression="gzip")
    return path


_MEASURED = "dimension <> 'attachment_type' AND NOT (dimension = 'corpus' AND name LIKE 'attachment_%')"


@query(
    "commands_from_files",
    f"""SELECT * FROM (
            SELECT 'tools' AS command, * FROM ({TOOLS_SQL}) UNION ALL SELECT 'corruption', * FROM ({CORRUPTION_SQL})
            UNION ALL SELECT 'failures', * FROM ({FAILURES_SQL}) UNION ALL SELECT 'attribute', * FROM ({ATTRIBUTE_SQL}))
        WHERE {_MEASURED}""",
)
def _(t):
    """Written as lines, decoded from files, measured by four commands."""
    found = transcripts.read_corpus(
        t.spark, write_transcripts(t), scratch_path(t.spark, "silver"), glob="*.txt.gz"
    )
    run = commands.start(found)
    parts = [
        commands.tools(found, plugins=t.plugins, run=run),
        commands.corruption(found, run=run),
        commands.failures(found, run=run),
        commands.attribute(found, run=run),
    ]
    every = commands.stack_rows([p.metrics for p in parts]).filter(_MEASURED)
    return every.select(
        "command", "name", "dimension", "key", "value_long", F.round("value_double", 6).alias("value_double"), "unit", "derivation"
    )


# --- order, written reports ------------------------------------------------------


def _placed_sql(rows: str, section: str, weights: list[str], names: str) -> str:
    """Rows with their place: by section, heaviest first, then key, then the order of the measures."""
    heavy = ", ".join(f"coalesce(max({w}), 0) AS w{i}" for i, w in enumerate(weights))
    falling = ", ".join(f"w{i} DESC" for i in range(len(weights)))
    listed = ", ".join(f"'{n}'" for n in names.split())
    return f"""m0 AS ({rows}), w0 AS (SELECT dimension, key, {heavy} FROM m0 GROUP BY dimension, key),
        o0 AS (SELECT row_number() OVER (ORDER BY {section}, {falling}, key, list_position([{listed}], name)) AS place,
                      name, dimension, key, value_long, value_double FROM m0 JOIN w0 USING (dimension, key))"""


def _of(*names: str) -> str:
    return "CASE WHEN name IN (" + ", ".join(f"'{n}'" for n in names) + ") THEN value_long END"


PLACED = {
    "tools": _placed_sql(
        TOOLS_SQL,
        """CASE WHEN name = 'unmatched_results' THEN 0 WHEN dimension = 'corpus' THEN 1 WHEN dimension = 'tool' THEN 2
             WHEN dimension = 'mcp_server' THEN 3 WHEN dimension = 'plugin' THEN 4 WHEN name = 'rent_bytes' THEN 10 ELSE 11 END""",
        [_of("context_bytes", "rent_bytes")],
        """tool_use_blocks tool_result_blocks unanswered_uses distinct_tools calls context_bytes image_bytes produced_bytes errors
           image_results externalised_results externalised_produced_bytes externalised_context_bytes""",
    ),
    "corruption": _placed_sql(
        CORRUPTION_SQL,
        """CASE WHEN name = 'unmatched_results' THEN 0 WHEN dimension = 'corpus' THEN 1 WHEN dimension = 'tool' THEN 2
             WHEN dimension = 'truncation_marker' THEN 3 ELSE 4 END""",
        [_of("failures"), _of("errors"), _of("truncated_results"), _of("empty_results"), _of("denied")],
        """calls distinct_tools errors error_rate_percent denied failures failure_rate_percent empty_results empty_rate_percent
           truncated_results truncation_rate_percent truncation_marker_kinds""",
    ),
    "failures": _placed_sql(
        FAILURES_SQL,
        """CASE WHEN name = 'unmatched_results' THEN 1 WHEN dimension = 'corpus' THEN 0 WHEN dimension = 'retry_loop' THEN 2
             WHEN dimension = 'repeated_failure' THEN 3 ELSE 4 END""",
        ["CASE WHEN starts_with(dimension, 'attribution') AND name = 'failures' THEN value_long END", _of("consecutive_errors", "errors")],
        """retry_loops repeated_failure_pairs errored_results consecutive_errors consecutive_denials calls errors failures denied
           error_sessions""",
    ),
    "attribute": _placed_sql(
        ATTRIBUTE_SQL,
        """CASE WHEN dimension = 'corpus' AND (name LIKE 'responses%' OR name LIKE '%tokens' OR name IN ('duplicate_rate_percent', 'rebill_multiplier')) THEN 0
             WHEN dimension = 'corpus' AND name IN ('sessions', 'sessions_with_cost_state', 'sessions_without_cost_state', 'cost_state_coverage_percent') THEN 1
             WHEN dimension = 'corpus' AND name LIKE 'attachment%' THEN 2 WHEN dimension = 'corpus' THEN 3
             WHEN name = 'dollars_available' THEN 5 WHEN dimension = 'cost_coverage' THEN 6 WHEN dimension = 'attachment_type' THEN 7
             WHEN name LIKE 'attachment%' THEN 8 ELSE 4 END""",
        ["CASE WHEN dimension NOT IN ('corpus', 'cost_coverage') AND name IN ('rebilled_tokens', 'attachment_bytes') THEN value_long END"],
        """responses_naive responses_distinct responses_duplicate duplicate_rate_percent responses fresh_tokens rebilled_tokens
           output_tokens thinking_tokens rebill_multiplier cost_usd sessions sessions_with_cost_state sessions_without_cost_state
           cost_state_coverage_percent coverage_ratio transcript_tokens billed_tokens attachment_events attachment_bytes
           attachment_share_percent attachment_types allocated_cost_usd unallocated_cost_usd""",
    ),
}
_RUNS = {
    "tools": lambda t: commands.tools(corpus(t), plugins=t.plugins),
    "corruption": lambda t: commands.corruption(corpus(t)),
    "failures": lambda t: commands.failures(corpus(t)),
    "attribute": lambda t: commands.attribute(corpus(t)),
}


def _register_order(command: str) -> None:
    @query(f"order_of_{command}", f"WITH {PLACED[command]} SELECT place, name, dimension, key FROM o0")
    def _(t):
        """The rows of a command with their places in its report."""
        return _RUNS[command](t).ordered().select("place", "name", "dimension", "key")


for _command in PLACED:
    _register_order(_command)


@query(
    "written_report",
    f"""WITH {PLACED['corruption']}
        SELECT 'metrics' AS written, '7' AS run, place, name, dimension, key, value_long, '' AS reason FROM o0
        UNION ALL SELECT 'refused', '7', NULL, name, dimension, key, value_long,
            unnest(['neither measured nor estimated', 'an estimate without a method']) FROM m0 WHERE dimension = 'denial_kind'
        UNION ALL SELECT 'header', '7', NULL, 'corruption', '', '', files, '' FROM {COUNTERS_SQL}""",
)
def _(t):
    """A report written twice under one run, with rows that break the contract among the others, and read back."""
    env = commands.corruption(corpus(t))
    last = F.struct(F.lit(9).alias("section"), "ord.weights", "ord.key", F.col("ord.at") + F.when(F.col("derivation") == "estimated", 1).otherwise(0))
    bad = env.metrics.filter("dimension = 'denial_kind'").withColumn(
        "derivation", F.explode(F.array(F.lit("guessed"), F.lit("estimated")))
    )
    bad = bad.withColumn("ord", last.cast(env.metrics.schema["ord"].dataType))
    path = scratch_path(t.spark, "report")
    mixed = metrics_ops.Envelope(env.command, env.metrics.unionByName(bad), env.warnings, env.header)
    for _ in range(2):
        mixed.write_run(path, "7")
    read = lambda table: metrics_ops.read_runs(t.spark, path, table)
    columns = ("name", "dimension", "key", "value_long")
    none, run = F.lit(None).cast("bigint").alias("place"), F.col("run").cast("string").alias("run")
    rows = read("metrics").select(F.lit("metrics").alias("written"), run, "place", *columns, F.lit("").alias("reason"))
    refused = read("refused").select(F.lit("refused").alias("written"), run, none, *columns, "reason")
    header = read("header").select(
        F.lit("header").alias("written"), run, none, F.col("command").alias("name"), F.lit("").alias("dimension"),
        F.lit("").alias("key"), F.col("files").alias("value_long"), F.lit("").alias("reason"),
    )
    return rows.unionByName(refused).unionByName(header)


# --- warnings with their text ------------------------------------------------------


def _said(env):
    return env.warnings.select("code", "key", "text")


_BROKEN_SQL = f"""SELECT 'parse_errors' AS code, '' AS key, parse_errors || ' lines failed to decode' AS text
    FROM {COUNTERS_SQL} WHERE parse_errors > 0"""
_AMBIGUOUS_SQL = """SELECT 'ambiguous_denials', '', count(*) || ' events carry one denial beside several errored results: an upper bound'
    FROM calls WHERE idx = 0 AND denial <> '' AND event_errors > 1 HAVING count(*) > 0"""
_UNCLAIMED_SQL = """SELECT 'dimension_unavailable', d, d || ' carries no row: no errored call recorded the field'
    FROM (SELECT unnest(['attribution_skill', 'attribution_plugin', 'attribution_mcp_server']) AS d,
                 unnest([max(skill), max(plugin), max(mcp_server)]) AS k FROM calls WHERE matched AND is_error) WHERE k = ''"""


@query(
    "failures_warnings",
    f"""{_BROKEN_SQL} UNION ALL {_AMBIGUOUS_SQL} UNION ALL {_UNCLAIMED_SQL}
        UNION ALL SELECT 'denials', '', CAST(n AS BIGINT) || ' of the errors behind these patterns are policy denials'
        FROM (SELECT (SELECT coalesce(sum(denied), 0) FROM ({loops_sql(False)}))
                     + (SELECT coalesce(sum(denied), 0) FROM ({PAIRS_SQL})) AS n) WHERE n > 0""",
)
def _(t):
    return _said(commands.failures(corpus(t)))


@query(
    "failures_warnings_in_window",
    f"""{_BROKEN_SQL} UNION ALL {_AMBIGUOUS_SQL}
        UNION ALL SELECT 'window', '', 'figures cover events dated within [2031-01-01, ...]; counts of files, their bytes, broken '
            || 'lines and results without a call cover everything that was read'
        UNION ALL SELECT 'window_empty', '', 'nothing is dated inside the window, so figures that depend on it are left out'
        UNION ALL SELECT 'untimestamped_type', type, type || ' carries no timestamp: unavailable in a window, not zero'
        FROM t GROUP BY type HAVING max(ts) = ''""",
)
def _(t):
    """A window that nothing is dated in."""
    return _said(commands.failures(corpus(t), TimeWindow(since="2031-01-01")))


@query(
    "doctor_warnings_in_window",
    f"""WITH found AS (SELECT * FROM {PLUGIN_FINDINGS} UNION ALL SELECT * FROM {SERVER_FINDINGS}),
        shadowed AS (SELECT host, name, source, overrides, CASE WHEN scope = overrides_scope
                     THEN 'last of the ' || scope || ' sources' ELSE 'project over user' END AS rule FROM {MERGED} WHERE overrides IS NOT NULL)
        SELECT 'finding' AS code, host || '/' || key AS key, dimension || ' ' || key || ': ' || kind AS text FROM found
        UNION ALL SELECT 'collision', host || '/' || name, 'mcp server ' || name || ': ' || source || ' overrides ' || overrides || ' (' || rule || ')'
        FROM shadowed
        UNION ALL SELECT 'partial_config', host, 'a server source of host ' || host || ' is unreadable: its set is partial' FROM hosts WHERE c_acctbal < 0
        UNION ALL SELECT 'withheld', 'skills_checked', 'skills_checked is omitted, not zero: no source was readable'
        UNION ALL SELECT 'withheld', 'mcp_servers_checked', 'mcp_servers_checked is omitted, not zero: no source was readable'
        FROM hosts HAVING bool_or(c_acctbal < 0)
        UNION ALL SELECT 'static_window', '', 'configuration carries no dates: the window 2024-01-10 to ... restricts nothing here'""",
)
def _(t):
    """A static audit can't be restricted to a window and says so."""
    return _said(commands.doctor(t.config_files, window=TimeWindow(since="2024-01-10")))


@query(
    "parts_warnings",
    f"""SELECT 'unrecorded' AS code, unnest(['image_bytes', 'produced_bytes', 'joins']) AS key, unnest([
            'image bytes are not broken out here: unmeasured, not zero',
            'pre-truncation sizes are not recorded here: unmeasured, not zero',
            'this source stores calls together with their results, so match rates do not apply']) AS text
        UNION ALL SELECT 'unknown_status', tool, 'errors is withheld for ' || tool || ': no call status was recorded'
        FROM ({BY_TOOL_SQL} GROUP BY tool) WHERE errors IS NULL
        UNION ALL SELECT 'unknown_status_total', '', 'errors is withheld from the total: not every call has a status'
        FROM ({BY_TOOL_SQL} GROUP BY tool) HAVING bool_or(errors IS NULL)
        UNION ALL SELECT 'no_servers', '', 'no server list was given: mcp_server rows are omitted, not zeroed'""",
)
def _(t):
    return _said(commands.opencode_tools(t.parts))


@query(
    "rollout_warnings",
    f"""WITH RECURSIVE {TROUBLED_SQL},
        named AS (SELECT DISTINCT t.tool, f.kind FROM faults f JOIN troubled t ON t.kind = 'call' AND t.session = f.session
                  AND f.call_id IN ('', t.call_id)),
        whys AS (SELECT tool, string_agg(kind, ',' ORDER BY CASE kind WHEN 'conflicting_copies' THEN 0 WHEN 'type_mismatch' THEN 1
                     WHEN 'conflicting_ancestry' THEN 2 WHEN 'cyclic_ancestry' THEN 3 ELSE 4 END) AS why FROM named GROUP BY tool),
        copies AS (SELECT sum(n) - count(*) AS n FROM (SELECT count(*) AS n FROM troubled WHERE kind IN ('call', 'result') GROUP BY session, call_id, kind))
        SELECT kind AS code, session || '/' || call_id AS key, CASE kind
            WHEN 'conflicting_copies' THEN 'session ' || session || ': the copies of call ' || call_id || ' differ'
            WHEN 'type_mismatch' THEN 'session ' || session || ': call ' || call_id || ' has a result of another type'
            WHEN 'conflicting_ancestry' THEN 'session ' || session || ' names more than one parent'
            WHEN 'cyclic_ancestry' THEN 'session ' || session || ': its ancestry leads back to itself'
            ELSE 'session ' || session || ': call ' || call_id || ' is also one of session ' || other || ', which it descends from' END AS text
        FROM faults
        UNION ALL SELECT 'withheld', tool, tool || ': figures withheld because of ' || why FROM whys
        UNION ALL SELECT 'withheld_total', '', 'totals that ambiguous joins enter are withheld' FROM faults HAVING count(*) > 0
        UNION ALL SELECT 'ancestry', '', 'records belong to the session of their own header; history outside the corpus is not followed'
        UNION ALL SELECT 'scope', 'unreported', 'errors, produced and externalised bytes are not recorded here: unmeasured, not zero'
        UNION ALL SELECT 'scope', 'unattributed', 'rent, skill calls and plugin ownership are not recorded here: unmeasured, not zero'
        UNION ALL SELECT 'unmatched_result', call_id, 'session ' || session || ': result ' || call_id || ' has no matching call'
        FROM results0 ANTI JOIN calls0 USING (session, call_id)
        UNION ALL SELECT 'unsupported_item', 'web_search_call', count(*) || ' unsupported web_search_call records excluded'
        FROM troubled WHERE kind = 'unsupported' HAVING count(*) > 0
        UNION ALL SELECT 'malformed_item', '', count(*) || ' malformed tool records excluded' FROM troubled WHERE kind = 'malformed' HAVING count(*) > 0
        UNION ALL SELECT 'duplicates', '', CAST(n AS BIGINT) || ' identical copies counted once' FROM copies WHERE n > 0""",
)
def _(t):
    """Every ambiguity of the faulty rollouts, and the figures that it withholds."""
    size = t.table("conversations").agg(F.sum(F.octet_length("text")))
    return _said(commands.codex_tools(rollouts.scope(t.troubled), size, strict=False, withhold=True))
