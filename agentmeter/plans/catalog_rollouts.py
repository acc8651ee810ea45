"""Queries over rollout records and part tables."""

from pyspark.sql import functions as F

from agentmeter.functions import names
from agentmeter.functions.window import ALWAYS, TimeWindow
from agentmeter.operators import codex, opencode
from agentmeter.plans.catalog import query
from agentmeter.session import scratch_path
from agentmeter.sources import rollouts

ROLLOUT_SQL = """(
    SELECT 's' || conv_id AS session, turn, text, role, 'c' || (turn // 2) AS call_id,
           '2024-01-01T00:00:00.' || lpad(CAST(turn AS VARCHAR), 9, '0') || 'Z' AS ts,
           'mcp__docs.' || CASE WHEN length(text) % 2 = 0 THEN 'read\\.page' ELSE 'search' END AS tool
    FROM conversations)"""
JOINED_SQL = f"""(
    SELECT coalesce(c.session, r.session) AS session, coalesce(c.call_id, r.call_id) AS call_id, c.tool,
           c.ts AS call_ts, r.ts AS result_ts, r.bytes,
           CASE WHEN c.session IS NULL THEN 'unmatched' WHEN r.session IS NULL THEN 'unanswered' ELSE 'joined' END AS status
    FROM (SELECT session, call_id, min(ts) AS ts, min_by(tool, turn) AS tool FROM {ROLLOUT_SQL} WHERE role = 'user' GROUP BY ALL) c
    FULL JOIN (SELECT session, call_id, min(ts) AS ts, min_by(strlen(text), turn) AS bytes
               FROM {ROLLOUT_SQL} WHERE role = 'assistant' GROUP BY ALL) r
      ON c.session = r.session AND c.call_id = r.call_id)"""


@query(
    "rollout_scoping",
    """SELECT file, pos, 's' || file AS session, 'ok' AS status,
              '2024-01-01T00:00:00.' || lpad(CAST(turn AS VARCHAR), 9, '0') || 'Z' AS ts FROM rollout""",
)
def _(t):
    return t.scoped.select("file", "pos", "session", "status", "ts")


@query(
    "rollout_scoping_with_bad_headers",
    """SELECT file, pos, CASE WHEN s = '' THEN NULL ELSE s END AS session FROM (
           SELECT file, pos, last_value(h IGNORE NULLS) OVER (PARTITION BY file ORDER BY pos
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s
           FROM (SELECT CAST(user_id AS VARCHAR) AS file, pos,
                        CASE WHEN event_type = 'signup' THEN 's' || pos WHEN event_type = 'error' AND value < 3 THEN '' END AS h
                 FROM t))""",
)
def _(t):
    header = (
        F.when(F.col("event_type") == "signup", F.concat(F.lit('{"id":"s'), F.col("pos").cast("string"), F.lit('"}')))
        .when((F.col("event_type") == "error") & (F.col("value") < 3), F.lit('{"id":7}'))
    )
    records = t.t.select(
        F.col("user_id").cast("string").alias("file"), "chunk", "pos",
        F.when(header.isNotNull(), F.lit("session_meta")).otherwise(F.lit("event_msg")).alias("type"),
        F.lit("").alias("timestamp"), F.coalesce(header, F.lit("{}")).alias("payload"),
        F.lit(False).alias("is_broken"),
    )
    return rollouts.scope(records).select("file", "pos", "session")


@query(
    "rollout_timestamps",
    """SELECT pos, strftime(e.ts - INTERVAL 90 MINUTE, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(pos % 1000000000 AS VARCHAR), 9, '0') || 'Z' AS ts
       FROM t JOIN events e ON e.event_id = t.pos""",
)
def _(t):
    written = F.concat(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."),
        F.lpad((F.col("event_id") % 1000000000).cast("string"), 9, "0"), F.lit("+01:30"),
    )
    return t.table("events").select(
        F.col("event_id").alias("pos"), rollouts.normalise_timestamp(written).alias("ts")
    )


@query(
    "rollout_item_kinds",
    """SELECT CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'ignored' END AS kind, count(*) AS n
       FROM conversations GROUP BY 1""",
)
def _(t):
    return codex.items(t.scoped).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "rollout_collapsed_copies",
    f"""SELECT session, call_id, CASE role WHEN 'user' THEN 'call' ELSE 'result' END AS kind, 2 * count(*) AS copies,
              count(*) > 1 AS is_conflict
        FROM {ROLLOUT_SQL} WHERE role IN ('user', 'assistant') GROUP BY ALL""",
)
def _(t):
    """Every record twice, the copy with other whitespace."""
    spaced = t.scoped.withColumn("payload", F.concat(F.lit("{ "), F.expr("substr(payload, 2)")))
    both = codex.items(t.scoped.unionByName(spaced))
    return codex.collapse_copies(both).select("session", "call_id", "kind", "copies", "is_conflict")


@query(
    "rollout_join",
    f"SELECT session, call_id, tool, bytes AS text_bytes, call_ts, result_ts, status FROM {JOINED_SQL}",
)
def _(t):
    return t.codex_joined.select(
        "session", "call_id", "tool", F.col("size.text_bytes").alias("text_bytes"), "call_ts", "result_ts", "status"
    )


@query(
    "rollout_by_tool",
    f"""SELECT tool, count(*) AS calls, CAST(sum(bytes) AS BIGINT) AS context_bytes, CAST(0 AS BIGINT) AS image_bytes
        FROM {JOINED_SQL} WHERE status = 'joined' GROUP BY tool""",
)
def _(t):
    rolled = codex.rollup(t.codex_joined, ALWAYS.includes_nanos)
    return codex.fold(rolled.filter("calls > 0"), "tool").select("tool", "calls", "context_bytes", "image_bytes")


@query(
    "rollout_in_window",
    f"""SELECT CAST(count(*) FILTER (WHERE status = 'joined' AND result_ts <= '2024-01-01T00:00:00.000000000Z') AS BIGINT) AS calls,
              count(*) FILTER (WHERE call_ts <= '2024-01-01T00:00:00.000000000Z') AS uses,
              count(*) FILTER (WHERE status = 'unanswered' AND call_ts <= '2024-01-01T00:00:00.000000000Z') AS unanswered,
              count(*) FILTER (WHERE status = 'unmatched') AS unmatched
        FROM {JOINED_SQL}""",
)
def _(t):
    window = TimeWindow(until="2024-01-01T00:00:00.000Z")
    return codex.fold(codex.rollup(t.codex_joined, window.includes_nanos)).select(
        "calls", "uses", "unanswered", "unmatched"
    )


@query(
    "rollout_content",
    """SELECT conv_id, turn, CASE WHEN role = 'system' THEN 0 ELSE strlen(text) END AS text_bytes,
              CASE WHEN role = 'assistant' THEN strlen(text) ELSE 0 END AS image_bytes,
              role = 'assistant' AS has_image, role <> 'system' AS text_known,
              role = 'user' OR (role = 'assistant' AND NOT contains(text, ',')) OR role = 'assistant' AS image_known
       FROM conversations""",
)
def _(t):
    text = F.col("text")
    blocks = F.array(
        F.struct(F.lit("input_text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("image_url")),
        F.struct(
            F.lit("input_image").alias("type"), F.lit(None).cast("string").alias("text"),
            F.concat(F.lit("data:image/png;base64,"), text).alias("image_url"),
        ),
    )
    output = (
        F.when(F.col("role") == "user", F.to_json(F.struct(text.alias("o"))))
        .when(F.col("role") == "assistant", F.to_json(F.struct(blocks.alias("o"))))
        .otherwise(F.to_json(F.struct(F.struct(text.alias("body")).alias("o"))))
    )
    value = F.try_variant_get(F.parse_json(output), "$.o", "variant")
    from agentmeter.functions.content import measure_codex

    return t.table("conversations").select("conv_id", "turn", measure_codex(value).alias("m")).select(
        "conv_id", "turn", "m.text_bytes", "m.image_bytes", "m.has_image", "m.text_known", "m.image_known"
    )


@query(
    "rollout_tool_names",
    """SELECT DISTINCT p_brand || '.' || p_type AS namespace, 'mcp__' || replace(p_name, ' ', '__') AS name,
              replace(p_brand || '.' || p_type, '.', '\\.') || '.' || replace('mcp__' || replace(p_name, ' ', '__'), '.', '\\.') AS tool,
              replace('a.b\\' || p_brand, '\\', '\\\\').replace('.', '\\.') AS plain_tool,
              split_part(p_name, ' ', 1) AS legacy_server, p_type AS spaced_server
       FROM part""",
)
def _(t):
    namespace = F.concat("p_brand", F.lit("."), "p_type")
    name = F.concat(F.lit("mcp__"), F.replace("p_name", F.lit(" "), F.lit("__")))
    return (
        t.table("part")
        .select(
            namespace.alias("namespace"),
            name.alias("name"),
            names.codex_tool_name(namespace, name).alias("tool"),
            names.codex_tool_name(F.lit(""), F.concat(F.lit("a.b\\"), "p_brand")).alias("plain_tool"),
            names.codex_mcp_server(F.lit(None).cast("string"), name).alias("legacy_server"),
            names.codex_mcp_server(F.concat(F.lit("mcp__"), "p_type"), name).alias("spaced_server"),
        )
        .distinct()
    )


@query(
    "rollout_parents",
    """SELECT 's' || conv_id AS session, 's' || (conv_id // 2) AS parent, FALSE AS is_conflict
       FROM (SELECT DISTINCT conv_id FROM conversations WHERE turn = 0) WHERE conv_id > 0""",
)
def _(t):
    return codex.parents(t.scoped)


@query(
    "rollout_inherited_calls",
    f"""WITH RECURSIVE ids AS (SELECT DISTINCT session, call_id FROM {ROLLOUT_SQL} WHERE role = 'user'),
        links AS (SELECT DISTINCT 's' || conv_id AS session, 's' || (conv_id // 2) AS parent FROM conversations
                  WHERE turn = 0 AND conv_id > 0),
        up(session, call_id, ancestor, steps) AS (
            SELECT i.session, i.call_id, l.parent, 1 FROM ids i JOIN links l ON i.session = l.session
            UNION ALL
            SELECT u.session, u.call_id, l.parent, steps + 1 FROM up u JOIN links l ON u.ancestor = l.session)
        SELECT u.call_id, u.session, min_by(u.ancestor, u.steps) AS ancestor
        FROM up u JOIN ids i ON i.session = u.ancestor AND i.call_id = u.call_id GROUP BY ALL""",
)
def _(t):
    """The nearest ancestor that has the call as well."""
    calls = t.codex_collapsed.filter("kind = 'call'").select("session", "call_id")
    return codex.inherited_calls(calls, codex.parents(t.scoped))


#: Calls and results of the faulty rollouts, first copies joined, and what makes them ambiguous.
TROUBLED_SQL = """calls0 AS MATERIALIZED (SELECT session, call_id, min_by(tool, pos) AS tool, min(payload) <> max(payload) AS differ
                 FROM troubled WHERE kind = 'call' GROUP BY ALL),
        results0 AS (SELECT session, call_id, min_by(item, pos) AS item, min_by(n, pos) AS n FROM troubled WHERE kind = 'result' GROUP BY ALL),
        joined0 AS (SELECT c.session, c.call_id, c.tool, r.n, CASE WHEN r.item IS NULL THEN 'unanswered'
                    WHEN r.item <> 'function_call_output' THEN 'type_mismatch' ELSE 'joined' END AS status
                    FROM calls0 c LEFT JOIN results0 r USING (session, call_id)),
        parents0 AS MATERIALIZED (SELECT session, min(parent) AS parent, min(parent) <> max(parent) AS differ FROM troubled
                     WHERE kind = 'header' AND parent <> '' GROUP BY ALL),
        -- Lines of parents that end; all others lead into a circle, however long they are.
        ending(session) AS (
            SELECT session FROM parents0 ANTI JOIN (SELECT session AS parent FROM parents0) USING (parent)
            UNION ALL SELECT p.session FROM ending e JOIN parents0 p ON p.parent = e.session),
        circle AS (SELECT session FROM parents0 ANTI JOIN ending USING (session)),
        -- Every call handed down until a session below has it as well.
        below(session, call_id, ancestor) AS (
            SELECT p.session, c.call_id, c.session FROM calls0 c JOIN parents0 p ON p.parent = c.session
            WHERE c.call_id IN (SELECT call_id FROM calls0 GROUP BY call_id HAVING count(*) > 1)
            UNION ALL SELECT p.session, b.call_id, b.ancestor
            FROM (SELECT * FROM below ANTI JOIN calls0 USING (session, call_id)) b JOIN parents0 p ON p.parent = b.session),
        faults AS (
            SELECT 'conflicting_copies' AS kind, session, call_id, '' AS other FROM calls0 WHERE differ
            UNION ALL SELECT 'type_mismatch', session, call_id, '' FROM joined0 WHERE status = 'type_mismatch'
            UNION ALL SELECT 'conflicting_ancestry', session, '', '' FROM parents0 WHERE differ
            UNION ALL SELECT 'cyclic_ancestry', session, '', '' FROM circle WHERE session IN (SELECT session FROM calls0)
            UNION ALL SELECT 'inherited_call', session, call_id, ancestor
            FROM below JOIN (SELECT session, call_id FROM calls0) USING (session, call_id) ANTI JOIN circle USING (session))"""


def _troubled(t):
    """(items, collapsed copies, joined calls, errors) of the faulty rollouts."""
    scoped = rollouts.scope(t.troubled)
    item_rows = codex.items(scoped)
    collapsed = codex.collapse_copies(item_rows)
    joined = codex.join_results(collapsed)
    return item_rows, collapsed, joined, codex.quality_errors(collapsed, joined, codex.parents(scoped))


@query("rollout_quality", f"WITH RECURSIVE {TROUBLED_SQL} SELECT * FROM faults")
def _(t):
    """Everything that makes a joined figure ambiguous."""
    return _troubled(t)[3]


@query(
    "rollout_taint",
    f"""WITH RECURSIVE {TROUBLED_SQL},
        named AS (SELECT DISTINCT t.tool, f.kind FROM faults f JOIN troubled t ON t.kind = 'call' AND t.session = f.session
                  AND f.call_id IN ('', t.call_id)),
        whys AS (SELECT tool, string_agg(kind, ',' ORDER BY CASE kind WHEN 'conflicting_copies' THEN 0 WHEN 'type_mismatch' THEN 1
                     WHEN 'conflicting_ancestry' THEN 2 WHEN 'cyclic_ancestry' THEN 3 ELSE 4 END) AS taint FROM named GROUP BY tool)
        SELECT tool, coalesce(taint, '') AS taint, CASE WHEN taint IS NULL THEN count(*) FILTER (WHERE status = 'joined') END AS calls,
               CASE WHEN taint IS NULL THEN CAST(coalesce(sum(n) FILTER (WHERE status = 'joined'), 0) AS BIGINT) END AS context_bytes,
               CASE WHEN taint IS NULL THEN count(call_id) END AS uses,
               CASE WHEN taint IS NULL THEN count(*) FILTER (WHERE status = 'unanswered') END AS unanswered
        FROM joined0 FULL JOIN whys USING (tool) GROUP BY tool, taint""",
)
def _(t):
    """Figures by tool, those that an ambiguous join enters withheld."""
    item_rows, _, joined, errors = _troubled(t)
    rolled = codex.tainted(codex.rollup(joined, ALWAYS.includes_nanos), item_rows, errors)
    names = codex.taint_names(F.col("taint")).alias("taint")
    by_tool = codex.fold(rolled.filter("tool is not null"), "tool")
    return by_tool.select("tool", names, "calls", "context_bytes", "uses", "unanswered")


@query(
    "rollout_files",
    """SELECT kind, count(*) AS records, CAST(sum(n) AS BIGINT) AS text_bytes, count(DISTINCT session) AS sessions
       FROM troubled WHERE kind <> 'header' GROUP BY kind""",
)
def _(t):
    """The faulty rollouts written as lines and read from files, repeated keys included."""
    path = scratch_path(t.spark, "rollouts")
    line = F.concat(
        F.lit('{"timestamp":"'), "timestamp", F.lit('","type":"'), "type", F.lit('","payload":'), "payload", F.lit("}")
    )
    ordered = t.troubled.repartitionByRange("file").sortWithinPartitions("file", "pos")
    ordered.select(line.alias("value")).write.text(path)
    scoped = rollouts.scope(rollouts.read_rollouts(t.spark, path, "*.txt"))
    rollouts.require_sessions(rollouts.record_quality(scoped), path)
    return codex.items(scoped).groupBy("kind").agg(
        F.count(F.lit(1)).alias("records"),
        F.coalesce(F.sum("size.text_bytes"), F.lit(0)).alias("text_bytes"),
        F.countDistinct("session").alias("sessions"),
    )


@query(
    "rollout_cycles",
    """WITH RECURSIVE links AS (
            SELECT 'n' || n_nationkey AS session, CASE WHEN n_regionkey = 0 THEN 'n' || ((n_nationkey + 5) % 25)
                   ELSE 'n' || (n_nationkey // 2) || 'x' END AS parent FROM nation),
        walk(session, reached, steps) AS (
            SELECT session, parent, 1 FROM links
            UNION ALL SELECT w.session, l.parent, steps + 1 FROM walk w JOIN links l ON w.reached = l.session WHERE steps < 60)
        SELECT DISTINCT session FROM walk WHERE steps = 60""",
)
def _(t):
    nation = t.table("nation")
    key = F.col("n_nationkey")
    links = nation.select(
        F.concat(F.lit("n"), key.cast("string")).alias("session"),
        F.when(F.col("n_regionkey") == 0, F.concat(F.lit("n"), ((key + 5) % 25).cast("string")))
        .otherwise(F.concat(F.lit("n"), F.floor(key / 2).cast("string"), F.lit("x")))
        .alias("parent"),
    )
    return codex.cyclic_sessions(links)


# --- part tables ---------------------------------------------------------------

PARTS_SQL = """(SELECT tool, session_id AS session, time_created AS ms, strlen(output) AS bytes, is_error FROM (
    SELECT json_extract_string(data, '$.tool') AS tool, session_id, time_created,
           json_extract_string(data, '$.state.output') AS output,
           CAST(json_extract_string(data, '$.state.status') = 'error' AS BIGINT) AS is_error
    FROM parts WHERE json_extract_string(data, '$.type') = 'tool'))"""
BY_TOOL_SQL = f"""SELECT tool, count(*) AS calls, CAST(sum(bytes) AS BIGINT) AS context_bytes, CAST(sum(is_error) AS BIGINT) AS errors,
    min(ms) AS min_ms, max(ms) AS max_ms FROM {PARTS_SQL}"""


@query("parts_by_tool", f"{BY_TOOL_SQL} GROUP BY tool")
def _(t):
    return opencode.by_tool(opencode.tool_parts(t.parts), F.lit(True))


@query(
    "parts_by_tool_in_window",
    f"{BY_TOOL_SQL} WHERE ms >= 1704844800000 AND ms < 1705795200000 GROUP BY tool",
)
def _(t):
    window = TimeWindow("2024-01-10", "2024-01-20")
    return opencode.by_tool(opencode.tool_parts(t.parts), window.includes_millis(F.col("ms")))


@query(
    "parts_by_server",
    f"""SELECT server, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(context_bytes) AS BIGINT) AS context_bytes,
              CASE WHEN bool_and(errors IS NOT NULL) THEN CAST(sum(errors) AS BIGINT) END AS errors
        FROM (SELECT *, CASE WHEN starts_with(tool, 'engram_mem_') THEN 'engram_mem' WHEN starts_with(tool, 'engram_') THEN 'engram' END AS server
              FROM ({BY_TOOL_SQL} GROUP BY tool)) WHERE server IS NOT NULL GROUP BY server""",
)
def _(t):
    from agentmeter.sources import config

    servers = config.opencode_servers(t.config_files).select("server")
    return opencode.by_server(opencode.by_tool(opencode.tool_parts(t.parts), F.lit(True)), servers)


@query(
    "parts_totals",
    f"""SELECT count(*) AS distinct_tools, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(context_bytes) AS BIGINT) AS context_bytes,
              NULL::BIGINT AS errors, min(min_ms) AS min_ms, max(max_ms) AS max_ms FROM ({BY_TOOL_SQL} GROUP BY tool)""",
)
def _(t):
    return opencode.totals(opencode.by_tool(opencode.tool_parts(t.parts), F.lit(True)))


@query(
    "parts_observations",
    f"SELECT tool, session, min(ms) AS min_ms, max(ms) AS max_ms FROM {PARTS_SQL} GROUP BY ALL",
)
def _(t):
    return opencode.observations(opencode.tool_parts(t.parts), F.lit(True))


@query(
    "parts_time_text",
    f"SELECT tool, session, ms, strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%SZ') AS stamp, strftime(make_timestamp(ms * 1000), '%Y-%m-%d') AS day FROM {PARTS_SQL}",
)
def _(t):
    stamp = names.millis_to_rfc3339(F.col("ms"))
    return opencode.tool_parts(t.parts).select(
        "tool", "session", "ms", stamp.alias("stamp"), names.day(stamp).alias("day")
    )
