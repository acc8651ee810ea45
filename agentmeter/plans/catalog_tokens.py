"""Queries over responses, bills and attachments."""

from pyspark.sql import functions as F

from agentmeter import model
from agentmeter.functions.window import ALWAYS, TimeWindow
from agentmeter.operators import attachments, attribute, metrics
from agentmeter.plans.catalog import query
from agentmeter.session import scratch_path
from agentmeter.sources import transcripts


def january():
    return TimeWindow("2024-01-10", "2024-01-20").includes(F.col("ts"))


IN_JAN = "ts <> '' AND ts >= '2024-01-10' AND substr(ts, 1, 10) <= '2024-01-20'"

ALLOCATED = """
    SELECT d.dimension, d.key, d.session, d.model,
           CAST(round(b.cost_usd * d.weight::DOUBLE / w.whole::DOUBLE * 1e6) AS BIGINT) AS micro
    FROM (SELECT session, model, dimension, key, CAST(sum(weight) AS BIGINT) AS weight FROM dims GROUP BY ALL) d
    JOIN (SELECT session, model, CAST(sum(weight) AS BIGINT) AS whole FROM responses GROUP BY ALL) w
      ON d.session = w.session AND d.model = w.model
    JOIN model_bills b ON b.session = d.session AND b.model = d.model"""


def _responses(t):
    return attribute.distinct_responses(t.usage)


def _rolled(t):
    return attribute.rollup(_responses(t))


def _model_bills(t):
    return attribute.model_bills(attribute.session_bills(t.bills))


@query(
    "first_response",
    "SELECT message_id, pos, session, model, input, output, skill, plugin, mcp_tool, sightings FROM responses",
)
def _(t):
    return _responses(t).select(
        "message_id", "pos", "session", "model", "input", "output", "skill", "plugin", "mcp_tool", "sightings"
    )


@query(
    "response_duplicates",
    """SELECT CAST(sum(sightings) AS BIGINT) AS responses_naive, count(*) AS responses_distinct,
              CAST(sum(sightings) - count(*) AS BIGINT) AS responses_duplicate,
              round(100.0::DOUBLE * (sum(sightings) - count(*))::DOUBLE / sum(sightings)::DOUBLE, 6) AS duplicate_rate_percent
       FROM responses""",
)
def _(t):
    return attribute.duplicate_counters(_responses(t)).withColumn(
        "duplicate_rate_percent", F.round("duplicate_rate_percent", 6)
    )


@query(
    "response_duplicates_in_window",
    f"""SELECT count(*) AS responses_naive, count(DISTINCT message_id) AS responses_distinct,
              count(*) - count(DISTINCT message_id) AS responses_duplicate FROM usage WHERE {IN_JAN}""",
)
def _(t):
    return attribute.duplicate_counters(attribute.distinct_responses(t.usage.filter(january()))).drop(
        "duplicate_rate_percent"
    )


@query(
    "last_bill_per_session",
    "SELECT session, pos, total_usd FROM last_bills",
)
def _(t):
    return attribute.session_bills(t.bills).select("session", "pos", "total_usd")


@query("model_bills", "SELECT session, model, cost_usd, billed_tokens FROM model_bills")
def _(t):
    return _model_bills(t)


@query(
    "response_weights",
    "SELECT message_id, CAST(weight AS BIGINT) AS weight, fresh AS fresh_tokens FROM responses",
)
def _(t):
    return attribute.weighed(_responses(t)).select(
        "message_id", F.col("weight").cast("bigint").alias("weight"), "fresh_tokens"
    )


@query(
    "rebilling_by_dimension",
    """SELECT *, round(CASE WHEN fresh_tokens = 0 THEN 0 ELSE rebilled_tokens::DOUBLE / fresh_tokens END, 6) AS rebill_multiplier
       FROM (SELECT dimension, key, count(*) AS responses, CAST(sum(fresh) AS BIGINT) AS fresh_tokens,
                    CAST(sum(cache_read) AS BIGINT) AS rebilled_tokens, CAST(sum(output) AS BIGINT) AS output_tokens,
                    CAST(sum(thinking) AS BIGINT) AS thinking_tokens FROM dims GROUP BY dimension, key)""",
)
def _(t):
    return attribute.by_dimension(_rolled(t)).withColumn(
        "rebill_multiplier", F.round("rebill_multiplier", 6)
    )


@query(
    "rebilling_totals",
    """SELECT count(*) AS responses, CAST(sum(fresh) AS BIGINT) AS fresh_tokens,
              CAST(sum(cache_read) AS BIGINT) AS rebilled_tokens, CAST(sum(output) AS BIGINT) AS output_tokens,
              CAST(sum(thinking) AS BIGINT) AS thinking_tokens,
              round(sum(cache_read)::DOUBLE / sum(fresh)::DOUBLE, 6) AS rebill_multiplier FROM responses""",
)
def _(t):
    return attribute.totals(_rolled(t)).drop("sightings").withColumn(
        "rebill_multiplier", F.round("rebill_multiplier", 6)
    )


@query(
    "weights_by_session_model",
    """SELECT session, model, dimension, key, CAST(sum(weight) AS BIGINT) AS weight FROM dims GROUP BY ALL""",
)
def _(t):
    return _rolled(t).select("session", "model", "dimension", "key", F.col("weight").cast("bigint").alias("weight"))


@query(
    "cost_by_dimension",
    f"SELECT dimension, key, CAST(sum(micro) AS BIGINT) AS cost_usd FROM ({ALLOCATED}) GROUP BY ALL",
)
def _(t):
    return attribute.cost_by_dimension(attribute.allocation(_rolled(t), _model_bills(t)))


@query(
    "cost_totals",
    f"""SELECT billed, allocated, billed - allocated AS unallocated FROM (
           SELECT (SELECT CAST(sum(CAST(round(total_usd * 1e6) AS BIGINT)) AS BIGINT) FROM last_bills) AS billed,
                  (SELECT CAST(sum(micro) AS BIGINT) FROM ({ALLOCATED}) WHERE dimension = 'session') AS allocated)""",
)
def _(t):
    from agentmeter.functions.numbers import microdollars

    latest = attribute.session_bills(t.bills)
    costs = attribute.cost_by_dimension(attribute.allocation(_rolled(t), attribute.model_bills(latest)))
    spent = costs.filter("dimension = 'session'").agg(F.sum("cost_usd"))
    return (
        latest.agg(F.sum(microdollars(F.col("total_usd"))).alias("billed"))
        .withColumn("allocated", spent.scalar())
        .withColumn("unallocated", F.col("billed") - F.col("allocated"))
    )


@query(
    "cost_coverage",
    """SELECT b.session, b.model, b.cost_usd, CASE WHEN r.tokens IS NULL THEN NULL ELSE b.billed_tokens END AS billed_tokens,
              r.tokens AS transcript_tokens, r.tokens IS NULL AS is_absent,
              round(CASE WHEN r.tokens IS NULL OR b.billed_tokens = 0 THEN 0 ELSE r.tokens::DOUBLE / b.billed_tokens END, 6) AS coverage_ratio
       FROM model_bills b LEFT JOIN (
           SELECT session, model, CAST(sum(fresh + cache_read + output) AS BIGINT) AS tokens FROM responses GROUP BY ALL) r
         ON b.session = r.session AND b.model = r.model""",
)
def _(t):
    rows = attribute.coverage(_model_bills(t), attribute.by_session_model(_rolled(t)))
    return rows.withColumn("coverage_ratio", F.round("coverage_ratio", 6))


@query(
    "dollars_available",
    """SELECT session, CAST(session IN (SELECT session FROM last_bills) AS BIGINT) AS dollars_available
       FROM (SELECT DISTINCT session FROM responses)""",
)
def _(t):
    sessions = _rolled(t).filter("dimension = 'session'").select("session").distinct()
    return attribute.availability(sessions, attribute.session_bills(t.bills))


@query(
    "sessions_without_bill",
    "SELECT DISTINCT session FROM t WHERE session NOT IN (SELECT session FROM last_bills)",
)
def _(t):
    seen = attribute.sessions_seen(t.events, ALWAYS.includes(F.col("ts")))
    return seen.join(attribute.session_bills(t.bills).select("session"), "session", "left_anti")


@query(
    "dimension_health",
    """SELECT *, claimed > 0 AND unclaimed_percent > 50 AS is_thin FROM (
           SELECT dimension, count(*) FILTER (WHERE key <> '(unattributed)') AS claimed,
                  CAST(coalesce(sum(cache_read) FILTER (WHERE key = '(unattributed)'), 0) AS BIGINT) AS unclaimed_tokens,
                  CAST(sum(cache_read) AS BIGINT) AS rebilled_tokens,
                  round(100.0::DOUBLE * coalesce(sum(cache_read) FILTER (WHERE key = '(unattributed)'), 0)::DOUBLE
                        / sum(cache_read)::DOUBLE, 6) AS unclaimed_percent,
                  count(*) FILTER (WHERE key <> '(unattributed)') = 0 AS is_absent
           FROM dims WHERE dimension <> 'session' GROUP BY dimension)""",
)
def _(t):
    return attribute.dimension_health(attribute.by_dimension(_rolled(t))).withColumn(
        "unclaimed_percent", F.round("unclaimed_percent", 6)
    )


@query(
    "thinnest_dimension",
    """SELECT dimension, unclaimed_tokens FROM (
           SELECT dimension, CAST(sum(cache_read) AS BIGINT) AS unclaimed_tokens,
                  list_position(['attribution_skill', 'attribution_plugin', 'attribution_agent',
                                 'attribution_mcp_server', 'attribution_mcp_tool'], dimension) AS place
           FROM dims WHERE key = '(unattributed)' GROUP BY dimension)
       ORDER BY unclaimed_tokens DESC, place LIMIT 1""",
)
def _(t):
    return attribute.thinnest_dimension(attribute.by_dimension(_rolled(t)))


@query(
    "attributed_shares",
    """SELECT dimension, key, rebilled_tokens, CASE WHEN key <> '(unattributed)' THEN
              round(CASE WHEN whole = 0 THEN 0 ELSE 100.0::DOUBLE * rebilled_tokens / whole END, 6) END AS share_percent
       FROM (SELECT *, CAST(coalesce(sum(rebilled_tokens) FILTER (WHERE key <> '(unattributed)')
                            OVER (PARTITION BY dimension), 0) AS DOUBLE) AS whole
             FROM (SELECT dimension, key, CAST(sum(cache_read) AS BIGINT) AS rebilled_tokens FROM dims GROUP BY ALL))""",
)
def _(t):
    rows = attribute.by_dimension(_rolled(t)).select("dimension", "key", "rebilled_tokens")
    shared = metrics.share_within(rows, "dimension", "rebilled_tokens", F.col("key") != model.UNATTRIBUTED)
    return shared.drop("grade").withColumn("share_percent", F.round("share_percent", 6))


@query(
    "top_rebilled_per_dimension",
    """SELECT dimension, key, rebilled_tokens, place, total FROM (
           SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY rebilled_tokens DESC, key) AS place,
                  count(*) OVER (PARTITION BY dimension) AS total
           FROM (SELECT dimension, key, CAST(sum(cache_read) AS BIGINT) AS rebilled_tokens FROM dims GROUP BY ALL))
       WHERE place <= 15""",
)
def _(t):
    rows = attribute.by_dimension(_rolled(t)).select("dimension", "key", "rebilled_tokens")
    top = metrics.top_per_dimension(rows, "dimension", [F.desc("rebilled_tokens"), F.col("key")])
    return top.withColumn("place", F.col("place").cast("bigint"))


WINDOWS = {"whole": TimeWindow(), "january": TimeWindow("2024-01-10", "2024-01-20"), "beyond": TimeWindow(since="2031-01-01")}


@query(
    "windowed_totals_omitted",
    f"""SELECT win, count(DISTINCT message_id) AS responses FROM (
            SELECT 'whole' AS win, message_id FROM usage
            UNION ALL SELECT 'january', message_id FROM usage WHERE {IN_JAN}
            UNION ALL SELECT 'beyond', message_id FROM usage WHERE ts >= '2031-01-01') GROUP BY win""",
)
def _(t):
    """Responses in each window; where a window holds no event the figure is omitted, not zero."""
    rows = None
    for name, window in WINDOWS.items():
        inside = window.includes(F.col("ts"))
        placed = t.events.agg(F.count_if(inside) > 0)
        totals = attribute.totals(attribute.rollup(attribute.distinct_responses(t.usage.filter(inside))))
        one = totals.filter(placed.scalar()).select(F.lit(name).alias("win"), "responses")
        rows = one if rows is None else rows.unionByName(one)
    return rows


# --- attachments -------------------------------------------------------------

NAMES = ["The", "And", "Is", "And: the", "La", "The: of", "", "In", "To"]
NAME_LIST = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"


def attached_objects(t):
    """Every document as one raw attachment object, its shape by language."""
    lines = F.split("text", "\n")
    tail = F.slice(lines, F.lit(2), F.size(lines))
    string_array = F.array(*[F.lit(n) for n in NAMES])
    field = lambda when, value: F.when(F.col("lang") == when, value)
    body = F.to_json(
        F.struct(
            F.when(F.col("lang") == "en", F.lit("skill_listing"))
            .when(F.col("lang") == "fr", F.lit("deferred_tools_delta"))
            .when(F.col("lang") == "de", F.lit("instructions"))
            .otherwise(F.lit("hook_start"))
            .alias("type"),
            field("es", F.col("source")).alias("hookName"),
            field("en", string_array).alias("names"),
            field("en", F.col("content")).alias("content"),
            field("fr", lines).alias("addedNames"),
            field("fr", tail).alias("addedLines"),
            field(
                "de",
                F.transform(
                    lines,
                    lambda s, i: F.struct(
                        F.concat(F.lit("f"), (i % 3).cast("string")).alias("path"),
                        F.when(F.length(s) % 2 == 0, s).alias("content"),
                    ),
                ),
            ).alias("files"),
        )
    )
    return t.listings.select("pos", body.alias("attachment"))


def _keys(t):
    return attachments.key_rows(attached_objects(t), F.col("attachment"), "pos")


LISTING_SQL = f"""
    SELECT pos, 'skill' AS dimension, entry AS key, CAST(sum(strlen(line) + CASE WHEN i < n THEN 1 ELSE 0 END) AS BIGINT) AS bytes
    FROM (
        SELECT *, last_value(opened IGNORE NULLS) OVER (PARTITION BY pos ORDER BY i
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS entry
        FROM (
            SELECT *, (SELECT max_by(x, length(x)) FROM (SELECT unnest({NAME_LIST}) AS x)
                       WHERE x <> '' AND starts_with(line, '- ' || x || ':')) AS opened
            FROM (SELECT pos, unnest(string_split(content, chr(10))) AS line,
                         generate_subscripts(string_split(content, chr(10)), 1) AS i,
                         len(string_split(content, chr(10))) AS n
                  FROM listings WHERE lang = 'en')))
    WHERE entry IS NOT NULL GROUP BY pos, entry"""
KEYED_SQL = f"""
    {LISTING_SQL}
    UNION ALL
    SELECT pos, 'mcp_tool', line, CAST(sum(strlen(coalesce(nxt, line))) AS BIGINT)
    FROM (SELECT pos, line, lead(line) OVER (PARTITION BY pos ORDER BY i) AS nxt FROM (
              SELECT pos, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
              FROM listings WHERE lang = 'fr'))
    GROUP BY pos, 3
    UNION ALL
    SELECT pos, 'instruction_file', 'f' || CAST((i - 1) % 3 AS VARCHAR),
           CAST(sum(CASE WHEN length(line) % 2 = 0 THEN strlen(line) ELSE 2 END) AS BIGINT)
    FROM (SELECT pos, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
          FROM listings WHERE lang = 'de')
    GROUP BY pos, 3
    UNION ALL
    SELECT pos, 'hook_name', source, CAST(strlen('{{"type":"hook_start","hookName":""}}') + strlen(source) AS BIGINT)
    FROM listings WHERE lang NOT IN ('en', 'fr', 'de')"""


@query("attachment_keys", KEYED_SQL)
def _(t):
    keys = _keys(t)
    return keys.groupBy("pos", "dimension", "key").agg(F.sum("bytes").alias("bytes"))


@query(
    "attachments_by_key",
    f"""SELECT dimension, key, count(*) AS attachment_events, CAST(sum(bytes) AS BIGINT) AS attachment_bytes
        FROM ({KEYED_SQL}) GROUP BY ALL""",
)
def _(t):
    return attachments.by_key(_keys(t))


@query("listing_bytes", LISTING_SQL.replace("WHERE lang = 'en'", ""))
def _(t):
    pattern = attachments.names_pattern(F.array(*[F.lit(n) for n in NAMES]))
    pairs = attachments.listing_pairs(F.col("pattern"), F.col("pieces"))
    return (
        t.listings.withColumn("pattern", pattern)
        .withColumn("pieces", attachments.listing_pieces(F.col("pattern"), F.col("content")))
        .select("pos", F.lit("skill").alias("dimension"), F.explode(pairs).alias("p"))
        .groupBy("pos", "dimension", F.col("p.key").alias("key"))
        .agg(F.sum("p.bytes").alias("bytes"))
    )


@query(
    "attachments_by_type",
    """SELECT lang AS type, count(*) AS attachment_events, CAST(sum(strlen(text)) AS BIGINT) AS attachment_bytes,
              round(100.0::DOUBLE * sum(strlen(text))::DOUBLE / (SELECT sum(strlen(text)) FROM documents)::DOUBLE, 6) AS share_percent
       FROM documents GROUP BY lang""",
)
def _(t):
    rows = t.listings.select(F.col("lang").alias("type"), F.octet_length("text").cast("bigint").alias("bytes"))
    shared = metrics.share_of_total(attachments.by_type(rows), "attachment_bytes")
    return shared.drop("grade").withColumn("share_percent", F.round("share_percent", 6))


@query(
    "attachment_records",
    """SELECT user_id % 7 AS grp, 't' || CAST(k % 5 AS VARCHAR) AS key, count(*) AS events,
              CAST(sum(strlen('{"name" : "t' || CAST(k % 5 AS VARCHAR) || '",  "n":1.0,"n":2}')) AS BIGINT) AS bytes FROM t GROUP BY ALL
       UNION ALL SELECT user_id % 7, 'é', count(*), CAST(sum(strlen('{"name":"\\u00e9"}')) AS BIGINT) FROM t GROUP BY ALL""",
)
def _(t):
    """Tool records: every named entry at the length of its source text, spaces, escapes and repeated keys included."""
    first = F.concat(F.lit('{"name" : "t'), (F.col("k") % 5).cast("string"), F.lit('",  "n":1.0,"n":2}'))
    entries = F.concat(first, F.lit(' , {"name":"\\u00e9"},"plain",{"name":""}'))
    record = F.concat(F.lit('{"entries":[ '), entries, F.lit(' ],"type":"deferred_tools_record"}'))
    rows = t.t.select((F.col("user_id") % 7).alias("grp"), record.alias("attachment"))
    keys = attachments.key_rows(rows, F.col("attachment"), "grp")
    return keys.groupBy("grp", "key").agg(F.sum("events").alias("events"), F.sum("bytes").alias("bytes"))


@query(
    "attachment_shapes",
    """SELECT dimension, key, count(*) AS events, CAST(sum(bytes) AS BIGINT) AS bytes FROM (
           SELECT 'mcp_server' AS dimension, p_brand AS key, strlen(p_name) AS bytes FROM part
           UNION ALL SELECT 'mcp_server', p_type, strlen(p_type) FROM part
           UNION ALL SELECT 'agent', p_brand, strlen(p_name) FROM part
           UNION ALL SELECT 'agent', p_type, strlen(p_type) FROM part) GROUP BY ALL""",
)
def _(t):
    """Server and agent listings; an entry without a text of its own counts its name."""
    both = [F.col("p_brand"), F.col("p_type")]
    beside = F.array(F.col("p_name"))
    shapes = (("mcp_instructions_delta", "addedNames", "addedBlocks"), ("agent_listing_delta", "addedTypes", "addedLines"))
    found = None
    for kind, names, texts in shapes:
        body = F.to_json(F.struct(F.lit(kind).alias("type"), F.array(*both).alias(names), beside.alias(texts)))
        keys = attachments.key_rows(t.table("part").select(body.alias("attachment")), F.col("attachment"))
        found = keys if found is None else found.unionByName(keys)
    return found.groupBy("dimension", "key").agg(F.sum("events").alias("events"), F.sum("bytes").alias("bytes"))


@query(
    "attachment_source_bytes",
    """SELECT 'kind' || CAST(k % 4 AS VARCHAR) AS type, count(*) AS attachment_events,
              CAST(sum(strlen('{ "type" : "kind' || CAST(k % 4 AS VARCHAR) || '", "x":1.50, "e":"\\u00e9é" }')) AS BIGINT) AS attachment_bytes
       FROM t GROUP BY ALL""",
)
def _(t):
    """Attachments read from files, at the length of their source text."""
    body = F.concat(F.lit('{ "type" : "kind'), (F.col("k") % 4).cast("string"), F.lit('", "x":1.50, "e":"\\u00e9é" }'))
    line = F.concat(F.lit('{"type":"attachment","attachment":'), body, F.lit("}"))
    path = scratch_path(t.spark, "attachments")
    t.t.select(line.alias("value")).write.text(path)
    corpus = transcripts.read_corpus(t.spark, path, scratch_path(t.spark, "silver"), glob="*.txt")
    return attachments.by_type(corpus.attachments)
