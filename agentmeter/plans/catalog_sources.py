"""Queries that decode records, from landed files and from raw JSON columns."""

from pyspark.sql import functions as F

from agentmeter.functions import content
from agentmeter.functions.window import ALWAYS, TimeWindow
from agentmeter.operators import inventory, metrics
from agentmeter.plans.catalog import query
from agentmeter.session import scratch_path, settle
from agentmeter.sources import transcripts


def every():
    return ALWAYS.includes(F.col("ts"))


def _lines(t):
    """Every event row as one JSONL line; some broken, blank or journal."""
    record = F.to_json(
        F.struct(
            "type",
            F.col("session").alias("sessionId"),
            F.nullif("version", F.lit("")).alias("version"),
            F.nullif("ts", F.lit("")).alias("timestamp"),
            F.struct(F.lit("é [x").alias("note")).alias("message"),
        )
    )
    line = (
        F.when(F.col("k") == 97, F.lit('{"type":'))
        .when(F.col("k") == 98, F.lit("  "))
        .when(F.col("k") == 99, F.lit('{"type":"started","key":"q","agentId":"a"}'))
        .otherwise(record)
    )
    side = F.when(F.col("user_id") % 3 == 0, F.lit("subagents")).otherwise(F.lit("top"))
    return t.t.select(line.alias("value"), side.alias("tree"))


def _landed(t):
    """The lines written by Spark below the shared folder."""
    path = scratch_path(t.spark, "lines")
    _lines(t).write.partitionBy("tree").text(path)
    return path


@query(
    "transcript_scan",
    """SELECT type, count(*) AS records, count(*) FILTER (WHERE is_broken) AS parse_errors,
              count(*) FILTER (WHERE is_journal) AS journal_records, count(*) FILTER (WHERE is_unknown) AS unknown_records,
              count(nullif(stamp, '')) AS timestamped, min(raw) AS message
       FROM (SELECT CASE WHEN k = 97 THEN '' WHEN k = 99 THEN 'started' ELSE type END AS type,
                    k = 97 AS is_broken, k = 99 AS is_journal, k < 97 AND type = 'glide-path' AS is_unknown,
                    CASE WHEN k < 97 THEN ts ELSE '' END AS stamp,
                    CASE WHEN k < 97 THEN '{"note":"é [x"}' END AS raw
             FROM t WHERE k <> 98) GROUP BY type""",
)
def _(t):
    rows = transcripts.classify(transcripts.read_events(t.spark, _landed(t), "*.txt"))
    return rows.groupBy(F.coalesce("type", F.lit("")).alias("type")).agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if("is_broken").alias("parse_errors"),
        F.count_if("is_journal").alias("journal_records"),
        F.count_if("is_unknown").alias("unknown_records"),
        F.count("timestamp").alias("timestamped"),
        F.min("message").alias("message"),
    )


@query(
    "line_accounting",
    """SELECT count(*) AS lines, count(*) FILTER (WHERE k = 98) AS blank_lines FROM t""",
)
def _(t):
    per_file = transcripts.line_accounting(t.spark, _landed(t), "*.txt")
    return per_file.agg(F.sum("lines").alias("lines"), F.sum("blank_lines").alias("blank_lines"))


@query(
    "file_manifest",
    """SELECT CASE WHEN user_id % 3 = 0 THEN '/c/subagents/' ELSE '/c/' END || CAST(user_id AS VARCHAR) AS file,
              CAST(sum(strlen(props)) AS BIGINT) AS bytes,
              count(*) FILTER (WHERE event_type <> 'error') AS transcript_lines,
              count(*) FILTER (WHERE event_type = 'error') AS journal_records,
              count(*) FILTER (WHERE event_type = 'view') AS parse_errors,
              count(*) FILTER (WHERE event_type <> 'error') > 0 OR count(*) = 0 AS is_transcript,
              user_id % 3 = 0 AND count(*) FILTER (WHERE event_type <> 'error') > 0 AS is_subagent
       FROM t GROUP BY user_id""",
)
def _(t):
    rows = file_rows(t)
    listing = rows.groupBy("file").agg(F.sum("size").cast("bigint").alias("bytes"))
    return transcripts.file_manifest(listing, transcripts.file_quality(rows))


def file_rows(t):
    folder = F.when(F.col("user_id") % 3 == 0, F.lit("/c/subagents/")).otherwise(F.lit("/c/"))
    return t.t.select(
        F.concat(folder, F.col("user_id").cast("string")).alias("file"),
        F.octet_length("props").alias("size"),
        (F.col("event_type") == "error").alias("is_journal"),
        (F.col("event_type") == "view").alias("is_broken"),
    )


COUNTERS_SQL = """(
    SELECT count(*) FILTER (WHERE lines > 0) AS files, CAST(sum(bytes) AS BIGINT) AS bytes,
           count(*) FILTER (WHERE lines > 0 AND u % 3 <> 0) AS files_top_level,
           count(*) FILTER (WHERE lines > 0 AND u % 3 = 0) AS files_subagent,
           CAST(sum(broken) AS BIGINT) AS parse_errors, count(*) FILTER (WHERE lines = 0) AS files_non_transcript,
           CAST(sum(journal) AS BIGINT) AS non_transcript_records
    FROM (SELECT user_id AS u, sum(strlen(props)) AS bytes, count(*) FILTER (WHERE event_type <> 'error') AS lines,
                 count(*) FILTER (WHERE event_type = 'error') AS journal, count(*) FILTER (WHERE event_type = 'view') AS broken
          FROM t GROUP BY user_id))"""


def _counters(t):
    rows = file_rows(t)
    listing = rows.groupBy("file").agg(F.sum("size").cast("bigint").alias("bytes"))
    return inventory.file_counters(transcripts.file_manifest(listing, transcripts.file_quality(rows)))


@query("file_counters", f"SELECT * FROM {COUNTERS_SQL}")
def _(t):
    return _counters(t)


@query(
    "retention_gap",
    f"""SELECT files_top_level, (SELECT count(*) FROM customer) AS stats_cache_sessions,
              (SELECT count(*) FROM customer) - files_top_level AS retention_gap FROM {COUNTERS_SQL}""",
)
def _(t):
    cached = t.table("customer").agg(F.count(F.lit(1)).alias("total_sessions"))
    return inventory.retention_gap(_counters(t), cached).select(
        "files_top_level", "stats_cache_sessions", "retention_gap"
    )


# --- inventory ---------------------------------------------------------------


@query("events_by_type", "SELECT type, count(*) AS events FROM t GROUP BY type")
def _(t):
    return inventory.by_type(inventory.rollup(t.events, every()))


@query("events_by_version", "SELECT version, count(*) AS events FROM t WHERE version <> '' GROUP BY version")
def _(t):
    return inventory.by_version(inventory.rollup(t.events, every()))


@query("unknown_types", "SELECT type, count(*) AS unknown_type_events FROM t WHERE type = 'glide-path' GROUP BY type")
def _(t):
    return inventory.unknown_types(inventory.rollup(t.events, every()))


@query(
    "never_timestamped_types",
    "SELECT type, count(*) AS events FROM t GROUP BY type HAVING count(nullif(ts, '')) = 0",
)
def _(t):
    return inventory.never_timestamped(inventory.rollup(t.events, every()))


@query(
    "date_range",
    "SELECT min(nullif(ts, '')) AS first_ts, max(nullif(ts, '')) AS last_ts, count(nullif(ts, '')) AS placed FROM t",
)
def _(t):
    return inventory.date_range(inventory.rollup(t.events, every()))


WINDOWS = (
    ("", "2024-01-15"),
    ("2024-01-15", ""),
    ("2024-01-10", "2024-01-10"),
    ("2024-01-10T12:00:00.000Z", "2024-01-12T00:00:00.500Z"),
)


def _window_sql(since, until):
    parts = ["ts <> ''"]
    if since:
        parts.append(f"ts >= '{since}'")
    if until:
        parts.append(f"substr(ts, 1, {len(until)}) <= '{until}'")
    return f"SELECT '{since}..{until}' AS bounds, type, count(*) AS events FROM t WHERE {' AND '.join(parts)} GROUP BY type"


@query("events_in_windows", " UNION ALL ".join(_window_sql(*w) for w in WINDOWS))
def _(t):
    """Several windows over one pass: each bound pair is a filtered count."""
    flags = F.array(
        *[
            F.struct(F.lit(f"{s}..{u}").alias("bounds"), TimeWindow(s, u).includes(F.col("ts")).alias("inside"))
            for s, u in WINDOWS
        ]
    )
    return (
        t.events.select("type", F.explode(F.filter(flags, lambda f: f["inside"])).alias("f"))
        .groupBy("f.bounds", "type")
        .agg(F.count(F.lit(1)).alias("events"))
    )


@query(
    "run_header",
    f"""SELECT 'agentmeter' AS tool, 1 AS schema_version, '1' AS version, 'scan' AS command, '/c' AS dir, files, bytes,
              (SELECT substr(min(nullif(ts, '')), 1, 10) FROM t) AS "from", (SELECT substr(max(nullif(ts, '')), 1, 10) FROM t) AS "to",
              '' AS since, '2024-01-15' AS until FROM {COUNTERS_SQL}""",
)
def _(t):
    span = inventory.date_range(inventory.rollup(t.events, every()))
    one = _counters(t).select(
        "files", "bytes", span.select("first_ts").scalar().alias("first_ts"), span.select("last_ts").scalar().alias("last_ts")
    )
    return metrics.run_header("scan", "/c", "1", TimeWindow(until="2024-01-15"), one)


@query(
    "corpus_drift",
    """SELECT type AS command, count(*) AS files, CAST(sum(strlen(props)) AS BIGINT) AS bytes,
              (SELECT count(*) FROM t WHERE type = 'user') AS first_files,
              (SELECT CAST(sum(strlen(props)) AS BIGINT) FROM t WHERE type = 'user') AS first_bytes
       FROM t WHERE type <> 'user' GROUP BY type""",
)
def _(t):
    """Event types stand in for commands that read different corpora."""
    headers = t.t.groupBy(F.col("type").alias("command")).agg(
        F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("props")).cast("bigint").alias("bytes")
    )
    return metrics.corpus_drift(headers, "user")


@query(
    "corpus_changed_between_passes",
    """SELECT unnest(['tools', 'attribute']) AS command, CAST(sum(n) AS BIGINT) AS bytes,
              CAST(sum(n) FILTER (WHERE even) AS BIGINT) AS first_bytes
       FROM (SELECT length('{"n":' || event_id || '}') + 1 AS n, event_id % 2 = 0 AS even FROM events)""",
)
def _(t):
    """A file is appended between two passes: the first command and one that ran with it agree, those after don't."""
    path = scratch_path(t.spark, "growing")
    even = F.col("event_id") % 2 == 0
    lines = t.table("events").select(even.alias("even"), F.concat(F.lit('{"n":'), F.col("event_id").cast("string"), F.lit("}")).alias("line"))
    lines.filter("even").select("line").write.text(path)
    version = lambda command: settle(transcripts.corpus_version(t.spark, path, command, "*.txt"))
    passes = version("scan").unionByName(version("corruption"))
    lines.filter("not even").select("line").write.mode("append").text(path)
    passes = passes.unionByName(version("tools")).unionByName(version("attribute"))
    return metrics.version_drift(passes, "scan").select("command", "bytes", "first_bytes")


#: Lines of every kind, by the remainder modulo 13.
LINE_SHAPES = (
    "", " \t ", "\u00a0", '[{"type":"user"},{"type":"user"}]', "[]", "null", "5", '"x"', '{"type":',
    '{"type":"started","agentId":"a","key":"k"}', '{"type":"user","sessionId":"s"}', '{"type":"glide-path"}', '\t{"type":"user"} ',
)


@query(
    "line_identity",
    """SELECT CAST(k % 13 AS INT) AS shape, count(*) AS lines, count(*) FILTER (WHERE k % 13 < 3) AS blank_lines,
              count(*) FILTER (WHERE k % 13 IN (5, 10, 11, 12)) AS events, count(*) FILTER (WHERE k % 13 = 9) AS journal_records,
              count(*) FILTER (WHERE k % 13 IN (3, 4, 6, 7, 8)) AS parse_errors, count(*) FILTER (WHERE k % 13 IN (5, 11)) AS unknown_events
       FROM t GROUP BY 1""",
)
def _(t):
    """Every line is blank, an event, a journal record or an error, one of them and once."""
    path = scratch_path(t.spark, "lines")
    shape = (F.col("k") % 13).cast("int")
    line = F.element_at(F.array(*[F.lit(x) for x in LINE_SHAPES]), shape + 1)
    t.t.select(shape.alias("shape"), line.alias("value")).write.partitionBy("shape").text(path)
    found = transcripts.line_identity(t.spark, path, "*.txt")
    of = F.regexp_extract("file", r"shape=(\d+)", 1).cast("int").alias("shape")
    counts = ("lines", "blank_lines", "events", "journal_records", "parse_errors", "unknown_events")
    return found.groupBy(of).agg(*(F.sum(c).alias(c) for c in counts))


# --- decoding raw JSON ---------------------------------------------------------

_EMPTY = ("uuid", "parentUuid", "agentId", "key", "cwd", "gitBranch", "attributionAgent", "attributionMcpTool")


def _live(rows, message, **fields):
    """Decoded-line columns around one raw message."""
    wanted = {
        "sessionId": F.col("session"), "timestamp": F.col("ts"), "version": F.lit(None).cast("string"),
        "toolDenialKind": F.lit(None).cast("string"), "attributionSkill": F.lit(None).cast("string"),
        "attributionPlugin": F.lit(None).cast("string"), "attributionMcpServer": F.lit(None).cast("string"),
        "toolUseResult": F.lit(None).cast("string"), "attachment": F.lit(None).cast("string"),
        "modelUsage": F.lit(None).cast("string"), "totalCostUSD": F.lit(None).cast("double"),
        **{c: F.lit(None).cast("string") for c in _EMPTY}, **fields,
    }
    return rows.select(
        "chunk", "pos", F.lit("f").alias("file"), message.alias("message"),
        *[c.alias(n) for n, c in wanted.items()],
    )


@query(
    "decode_uses",
    "SELECT pos, idx, session, ts, use_id, tool, hash, invoked_skill, skill, plugin, mcp_server FROM uses",
)
def _(t):
    block = F.concat(
        F.lit('{"role":"assistant","content":[{"type":"tool_use","id":"'), "use_id", F.lit('","name":"'), "tool",
        F.lit('","input": '), "input", F.lit("}]}"),
    )
    live = _live(
        t.uses, block, type=F.lit("assistant"), attributionSkill=F.col("skill"),
        attributionPlugin=F.col("plugin"), attributionMcpServer=F.col("mcp_server"),
    )
    return transcripts.use_rows(transcripts.decode_lines(live)).drop("chunk", "file")


@query(
    "decode_results",
    """SELECT pos, CAST(0 AS BIGINT) AS idx, session, ts, use_id, context_bytes + strlen('é') AS context_bytes, image_bytes, marker, is_error, denial,
              persisted_path, CAST(persisted_size AS BIGINT) AS persisted_size, 1 AS event_results,
              CAST(is_error AS INTEGER) AS event_errors
       FROM results""",
)
def _(t):
    """Each result as its own event: text of its length plus one é, or blocks
    of text and an inline image where it carries one."""
    rest = F.col("context_bytes") - F.length("marker")
    body = F.concat(F.lit("é"), F.col("marker"), F.repeat(F.lit("x"), F.greatest(rest, F.lit(0)).cast("int")))
    sized = F.when(rest >= 0, body)
    short = F.concat(F.lit("é"), F.repeat(F.lit("y"), F.col("context_bytes").cast("int")))
    text = F.coalesce(sized, short)
    blocks = F.to_json(
        F.array(
            F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("struct<data:string>").alias("source")),
            F.struct(
                F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"),
                F.struct(F.repeat(F.lit("A"), F.col("image_bytes").cast("int")).alias("data")).alias("source"),
            ),
        )
    )
    quoted = F.concat(F.lit('"'), text, F.lit('"'))
    message = F.concat(
        F.lit('{"content":[{"type":"tool_result","tool_use_id":"'), F.col("use_id"), F.lit('","is_error":'),
        F.col("is_error").cast("string"), F.lit(',"content":'),
        F.when(F.col("image_bytes") > 0, blocks).otherwise(quoted), F.lit("}]}"),
    )
    persisted = F.when(
        F.col("persisted_path").isNotNull(),
        F.to_json(
            F.struct(
                F.col("persisted_path").alias("persistedOutputPath"), F.col("persisted_size").alias("persistedOutputSize")
            )
        ),
    ).otherwise(F.lit('"plain"'))
    # Results too short for their marker carry none, as the SQL side says.
    live = _live(t.results, message, type=F.lit("user"), toolDenialKind=F.col("denial"), toolUseResult=persisted)
    return transcripts.result_rows(transcripts.decode_lines(live)).drop("chunk", "file")


@query(
    "decode_usage",
    """SELECT pos, session, ts, message_id, model, input, output, thinking, cache_read,
              CASE WHEN cache_5m + cache_1h > 0 AND pos % 3 > 0 THEN cache_5m ELSE cache_5m + cache_1h END AS cache_5m,
              CASE WHEN cache_5m + cache_1h > 0 AND pos % 3 > 0 THEN cache_1h ELSE 0 END AS cache_1h, skill
       FROM usage""",
)
def _(t):
    split = F.when(
        F.col("pos") % 3 > 0,
        F.struct(
            F.col("cache_5m").alias("ephemeral_5m_input_tokens"), F.col("cache_1h").alias("ephemeral_1h_input_tokens")
        ),
    )
    message = F.to_json(
        F.struct(
            F.col("message_id").alias("id"),
            "model",
            F.lit("hello").alias("content"),
            F.struct(
                F.col("input").alias("input_tokens"), F.col("output").alias("output_tokens"),
                F.col("cache_read").alias("cache_read_input_tokens"),
                (F.col("cache_5m") + F.col("cache_1h")).alias("cache_creation_input_tokens"),
                F.struct(F.col("thinking").alias("thinking_tokens")).alias("output_tokens_details"),
                split.alias("cache_creation"),
            ).alias("usage"),
        )
    )
    live = _live(t.usage, message, type=F.lit("assistant"), attributionSkill=F.col("skill"))
    return transcripts.usage_rows(transcripts.decode_lines(live)).select(
        "pos", "session", "ts", "message_id", "model", "input", "output", "thinking", "cache_read",
        "cache_5m", "cache_1h", "skill",
    )


@query(
    "decode_bills",
    """SELECT pos, session, total_usd, main_model AS model, k * 1000 AS input, main_usd AS cost_usd FROM bill_rows
       UNION ALL SELECT pos, session, total_usd, 'haiku-bg', k, side_usd FROM bill_rows""",
)
def _(t):
    models = F.to_json(
        F.transform_values(
            "models",
            lambda _, m: F.struct(m["input"].alias("inputTokens"), m["cost_usd"].alias("costUSD")),
        )
    )
    live = _live(
        t.bills, F.lit(None).cast("string"), type=F.lit("cost-state"), totalCostUSD=F.col("total_usd"), modelUsage=models
    )
    return transcripts.bill_rows(transcripts.decode_lines(live)).select(
        "pos", "session", "total_usd", F.explode("models").alias("model", "m")
    ).select("pos", "session", "total_usd", "model", "m.input", "m.cost_usd")


@query(
    "content_measure",
    """SELECT doc_id, CASE lang WHEN 'de' THEN 0 ELSE strlen(text) + CASE WHEN lang = 'es' THEN 11 ELSE 0 END END AS context_bytes,
              CASE lang WHEN 'fr' THEN strlen(source) ELSE 0 END AS image_bytes,
              CASE lang WHEN 'es' THEN '[truncated]' ELSE '' END AS marker
       FROM documents""",
)
def _(t):
    text = F.col("text")
    shape = (
        F.when(F.col("lang") == "en", F.to_json(F.struct(text.alias("c"))))
        .when(F.col("lang") == "es", F.to_json(F.struct(F.concat(text, F.lit("[truncated]")).alias("c"))))
        .when(
            F.col("lang") == "fr",
            F.to_json(
                F.struct(
                    F.array(
                        F.struct(F.lit("text").alias("type"), text.alias("text"), F.struct(F.lit("n").alias("data")).alias("source")),
                        F.struct(F.lit("image").alias("type"), F.lit("").alias("text"), F.struct(F.col("source").alias("data")).alias("source")),
                    ).alias("c")
                )
            ),
        )
        .otherwise(F.to_json(F.struct(F.struct(text.alias("text")).alias("c"))))
    )
    value = F.try_variant_get(F.parse_json(shape), "$.c", "variant")
    opened = t.table("documents").select("doc_id", content.open_content(value).alias("c"))
    return opened.select("doc_id", content.measure_opened(F.col("c")).alias("m")).select(
        "doc_id", "m.context_bytes", "m.image_bytes", "m.marker"
    )
