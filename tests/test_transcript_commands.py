"""Commands over small JSONL corpora with hand-counted values."""

import pytest
from helpers import value_of

from agentmeter.functions.window import TimeWindow
from agentmeter.plans import adapters, catalog_commands, commands
from agentmeter.sources.transcripts import line_accounting, read_corpus

S = "s1"


def use(use_id, tool, ts="2026-09-01T10:00:00.000Z", session=S, tool_input=None, **extra):
    block = {"type": "tool_use", "id": use_id, "name": tool, "input": tool_input or {}}
    return {"type": "assistant", "sessionId": session, "timestamp": ts, "version": "2.0.1",
            "message": {"role": "assistant", "content": [block]}, **extra}


def result(use_id, content, ts="2026-09-01T10:00:01.000Z", session=S, is_error=False, **extra):
    block = {"type": "tool_result", "tool_use_id": use_id, "content": content, "is_error": is_error}
    return {"type": "user", "sessionId": session, "timestamp": ts,
            "message": {"role": "user", "content": [block]}, **extra}


def response(mid, session=S, ts="2026-09-01T10:00:00.000Z", model="opus-4", usage=None, **extra):
    base = {"input_tokens": 300, "output_tokens": 70, "cache_read_input_tokens": 26400,
            "cache_creation_input_tokens": 500, "output_tokens_details": {"thinking_tokens": 30},
            "cache_creation": {"ephemeral_5m_input_tokens": 200, "ephemeral_1h_input_tokens": 300}}
    return {"type": "assistant", "sessionId": session, "timestamp": ts,
            "message": {"id": mid, "model": model, "usage": usage or base}, **extra}


def bill(session, total, models):
    return {"type": "cost-state", "sessionId": session, "totalCostUSD": total, "modelUsage": models}


@pytest.fixture
def load(spark, tmp_path):
    def run(directory):
        return read_corpus(spark, directory, str(tmp_path / "landing"))

    return run


def test_inventory_tree(spark, write_jsonl, load, tmp_path):
    plain = {"type": "user", "sessionId": "a", "version": "1.0", "timestamp": "2026-09-02T00:00:00.000Z"}
    write_jsonl("p/a.jsonl", plain, '{"type":', "", {**plain, "type": "glide-path", "version": "1.1"})
    write_jsonl("p/subagents/b.jsonl", {**plain, "timestamp": "2026-09-03T00:00:00.000Z"})
    write_jsonl("p/subagents/workflows/wf/journal.jsonl", {"type": "started", "key": "k", "agentId": "x"})
    directory = write_jsonl("p/empty.JSONL")
    corpus = load(directory)
    cached = spark.createDataFrame([(5,)], "total_sessions bigint")
    env = commands.scan(corpus, cached=cached)
    m = env.metrics.cache()
    assert value_of(m, "files") == 3
    assert value_of(m, "files_subagent") == 1
    assert value_of(m, "files_top_level") == 2
    assert value_of(m, "files_non_transcript") == 1
    assert value_of(m, "non_transcript_records") == 1
    assert value_of(m, "parse_errors") == 1
    assert value_of(m, "events") == 3
    assert value_of(m, "distinct_event_types") == 2
    assert value_of(m, "distinct_cli_versions") == 2
    assert value_of(m, "known_event_types") == 21
    assert value_of(m, "retention_gap") == 3
    assert value_of(m, "unknown_type_events", "unknown_type", "glide-path") == 1
    assert value_of(m, "events", "cli_version", "1.0") == 2
    size = sum(p.stat().st_size for p in (tmp_path / "corpus").rglob("*") if p.is_file())
    assert value_of(m, "bytes") == size
    head = env.header.first()
    assert (head["from"], head["to"], head.files) == ("2026-09-02", "2026-09-03", 3)
    codes = {r.code for r in env.warnings.collect()}
    assert codes == {"parse_errors", "non_transcript_records", "unknown_type"}
    lines = {r.file.rsplit("/", 1)[1]: (r.lines, r.blank_lines) for r in line_accounting(spark, directory).collect()}
    assert lines["a.jsonl"] == (4, 1)


def test_tools_volume(spark, write_jsonl, load):
    blocks = [{"type": "text", "text": "héé"}, {"type": "image", "source": {"data": "QUJD"}},
              {"type": "image", "source": {"url": "http://x"}}]
    directory = write_jsonl(
        "a.jsonl",
        use("t1", "Bash"), result("t1", "[text]"), result("t1", "again"),
        use("t2", "mcp__search__query__deep"), result("t2", blocks),
        use("t3", "mcp__plugin_field_kit_srv__go"), result("t3", "", is_error=True),
        result("nobody", "lost"),
        use("t4", "Skill", tool_input={"skill": "mapper"}),
        use("t5", "Read"),
        result("t5", "<persisted-output>", toolUseResult={"persistedOutputPath": "/gone", "persistedOutputSize": 4000}),
        {"type": "attachment", "sessionId": S, "timestamp": "2026-09-01T10:00:00.000Z",
         "attachment": {"type": "skill_listing", "names": ["mapper", "tidy"], "content": "- mapper: draws a chart of ports\n- tidy: sorts the drawer"}},
        {"type": "attachment", "sessionId": S, "timestamp": "2026-09-01T10:00:00.000Z",
         "attachment": {"type": "mcp_instructions_delta", "addedNames": ["plugin:field_kit:srv", "claude.ai Atlas"], "addedBlocks": ["ten bytes!"]}},
    )
    corpus = load(directory)
    plugins = spark.createDataFrame([("field_kit",), ("field",)], "plugin string")
    env = commands.tools(corpus, plugins=plugins)
    m = env.metrics.cache()
    assert value_of(m, "tool_use_blocks") == 5
    assert value_of(m, "tool_result_blocks") == 5
    assert value_of(m, "unmatched_results") == 1
    assert value_of(m, "unanswered_uses") == 1
    assert value_of(m, "calls", "tool", "Bash") == 2
    assert value_of(m, "context_bytes", "tool", "Bash") == 11
    assert value_of(m, "context_bytes", "mcp_server", "search") == 5
    assert value_of(m, "image_bytes", "mcp_server", "search") == 4
    assert value_of(m, "produced_bytes", "tool", "mcp__search__query__deep") == 9
    assert value_of(m, "image_results") == 1
    assert value_of(m, "produced_bytes", "tool", "Read") == 4000
    assert value_of(m, "externalised_produced_bytes") == 4000
    assert value_of(m, "externalised_context_bytes") == 18
    assert value_of(m, "errors", "plugin", "field_kit") == 1
    assert value_of(m, "rent_bytes", "mcp_server", "plugin_field_kit_srv") == 10
    assert value_of(m, "rent_bytes", "mcp_server", "claude_ai_Atlas") == 15
    assert value_of(m, "calls", "mcp_server", "claude_ai_Atlas") == 0
    assert value_of(m, "rent_bytes", "plugin", "field_kit") == 10
    assert value_of(m, "rent_bytes", "skill", "mapper") == 33
    assert value_of(m, "rent_bytes", "skill", "tidy") == 24
    assert value_of(m, "skill_calls", "skill", "mapper") == 1
    assert value_of(m, "skill_calls", "skill", "tidy") == 0
    codes = sorted(r.code for r in env.warnings.collect())
    assert codes == ["side_file", "unmatched_result"]


def test_window_gates_rows_after_the_join(write_jsonl, load):
    directory = write_jsonl(
        "a.jsonl",
        use("t1", "Bash", ts="2026-09-01T23:00:00.000Z"),
        result("t1", "12345", ts="2026-09-02T01:00:00.000Z"),
        result("zz", "?", ts="2026-09-05T01:00:00.000Z"),
        {"type": "mode", "sessionId": S},
    )
    corpus = load(directory)
    m = commands.tools(corpus, TimeWindow("2026-09-02", "2026-09-02")).metrics.cache()
    assert value_of(m, "calls", "tool", "Bash") == 1
    assert value_of(m, "tool_use_blocks") == 0
    assert value_of(m, "unmatched_results") == 1
    empty = commands.tools(corpus, TimeWindow(since="2027-01-01"))
    m = empty.metrics.cache()
    assert value_of(m, "calls") is None
    assert value_of(m, "unmatched_results") == 1
    codes = {r.code for r in empty.warnings.collect()}
    assert {"window", "window_empty", "untimestamped_type"} <= codes


def test_attribute_rebilling_and_allocation(write_jsonl, load):
    fresh = response("m1", attributionSkill="mapper")
    models = {"opus-4": {"inputTokens": 300, "outputTokens": 70, "cacheReadInputTokens": 26400,
                         "cacheCreationInputTokens": 500, "costUSD": 2.4},
              "haiku": {"inputTokens": 5, "costUSD": 0.6}}
    directory = write_jsonl(
        "a.jsonl", fresh, {**fresh, "attributionSkill": "tidy"}, response("m2", attributionSkill=None),
        bill(S, 9.0, {"opus-4": {"costUSD": 9.0}}), bill(S, 3.0, models),
        response("m3", session="s2"),
    )
    m = commands.attribute(load(directory)).metrics.cache()
    assert value_of(m, "responses_naive") == 4
    assert value_of(m, "responses_distinct") == 3
    assert value_of(m, "fresh_tokens") == 2400
    assert value_of(m, "rebilled_tokens") == 79200
    assert value_of(m, "rebill_multiplier", "attribution_skill", "mapper") == pytest.approx(33.0)
    assert value_of(m, "responses", "attribution_skill", "tidy") is None
    assert value_of(m, "responses", "attribution_skill", "(unattributed)") == 2
    assert value_of(m, "cost_usd", "attribution_skill", "mapper") == 1200000
    assert value_of(m, "cost_usd", "session", S) == 2400000
    assert value_of(m, "cost_usd", "session", "s2") is None
    assert value_of(m, "dollars_available", "session", "s2") == 0
    assert value_of(m, "dollars_available", "session", S) == 1
    assert value_of(m, "allocated_cost_usd") == 2400000
    assert value_of(m, "unallocated_cost_usd") == 600000
    assert value_of(m, "coverage_ratio", "cost_coverage", f"{S}/haiku") == 0.0
    assert value_of(m, "transcript_tokens", "cost_coverage", f"{S}/opus-4") == 2 * (800 + 26400 + 70)
    assert value_of(m, "sessions") == 2
    assert value_of(m, "sessions_without_cost_state") == 1


def test_corruption_split(write_jsonl, load):
    both = {"type": "user", "sessionId": S, "timestamp": "2026-09-01T10:00:01.000Z", "toolDenialKind": "user-rejected",
            "message": {"content": [{"type": "tool_result", "tool_use_id": i, "content": "no", "is_error": True} for i in ("a", "b")]}}
    directory = write_jsonl(
        "a.jsonl",
        use("a", "Bash"), use("b", "Bash"), both,
        use("c", "Read"), result("c", "tail [truncated] (truncated; call x", is_error=True),
        use("d", "Read"), result("d", []),
        use("e", "Read"), result("e", "", toolUseResult={"persistedOutputPath": "/p", "persistedOutputSize": 3}),
    )
    env = commands.corruption(load(directory))
    m = env.metrics.cache()
    assert value_of(m, "errors") == 3
    assert value_of(m, "denied", "denial_kind", "user-rejected") == 2
    assert value_of(m, "failures", "tool", "Read") == 1
    assert value_of(m, "empty_results", "tool", "Read") == 1
    assert value_of(m, "truncated_results", "truncation_marker", "[truncated]") == 1
    assert value_of(m, "error_rate_percent", "tool", "Bash") == 100.0
    assert "ambiguous_denials" in {r.code for r in env.warnings.collect()}


def test_failures_loops_and_pairs(write_jsonl, load):
    from agentmeter.functions.payload import digest

    def call(i, err, session=S, tool_input=None, **extra):
        return [use(i, "Bash", session=session, tool_input=tool_input or {"b": 1.0, "a": 2}, attributionSkill="mapper"),
                result(i, "x", session=session, is_error=err, **extra)]

    lines = []
    for i in range(3):
        lines += call(f"l{i}", True, toolDenialKind="user-rejected" if i == 0 else None)
    lines += call("ok", False)
    for i in range(4):
        lines += call(f"m{i}", True)
    lines += call("other", True, tool_input={"z": 1}) + call("again", True)
    lines += call("s2", True, session="s2")
    directory = write_jsonl("a.jsonl", *lines)
    m = commands.failures(load(directory)).metrics.cache()
    key = f"{S}/Bash/{digest('{\"a\":2,\"b\":1.0}')}"
    assert value_of(m, "retry_loops") == 2
    assert value_of(m, "consecutive_errors", "retry_loop", key) == 3
    assert value_of(m, "consecutive_denials", "retry_loop", key) == 1
    assert value_of(m, "consecutive_errors", "retry_loop", key + "#2") == 4
    pair = key.split("/", 1)[1]
    assert value_of(m, "error_sessions", "repeated_failure", pair) == 2
    assert value_of(m, "errors", "repeated_failure", pair) == 9
    assert value_of(m, "calls", "repeated_failure", pair) == 10
    assert value_of(m, "errors", "attribution_skill", "mapper") == 10
    assert value_of(m, "denied", "attribution_skill", "mapper") == 1


def test_report_merges_and_writes(spark, write_jsonl, load, tmp_path):
    directory = write_jsonl("a.jsonl", use("t1", "Bash"), result("t1", "12345"), response("m1"))
    env = commands.report(load(directory))
    m = env.metrics.cache()
    assert value_of(m, "calls", "tool", "Bash") == 1
    assert m.groupBy("name", "dimension", "key").count().filter("count > 1").count() == 0
    assert "disagreement" not in {r.code for r in env.warnings.collect()}
    env.write(str(tmp_path / "out"), "json")
    assert spark.read.json(str(tmp_path / "out" / "metrics")).count() == m.count()
    figures = {r.figure: r.value for r in commands.summary(m).collect()}
    assert figures["tool_concentration_percent"] == 100.0
    assert figures["rebill_multiplier"] == pytest.approx(33.0)


def test_written_transcripts_are_compressed_and_bounded(spark, monkeypatch):
    """All lines in order, in files of bounded length that take less than a quarter of the lines' own bytes."""
    monkeypatch.setattr(catalog_commands, "LINES_PER_FILE", 300, raising=False)
    t = adapters.Tables(spark, "/root/testdata/sf0.001")
    path = catalog_commands.write_transcripts(t)
    want = [r.line for r in catalog_commands.transcript_lines(t).orderBy("pos").collect()]
    taken = spark.read.format("binaryFile").load(path).agg({"length": "sum"}).first()[0]
    assert taken * 4 < sum(len(line.encode()) + 1 for line in want)
    read = spark.read.text(path).select("value", "_metadata.file_path")
    assert read.groupBy("file_path").count().agg({"count": "max"}).first()[0] <= 300
    assert sorted(r.value for r in read.collect()) == sorted(want)
    files = sorted(r.file_path for r in read.select("file_path").distinct().collect())
    assert [r.value for f in files for r in spark.read.text(f).collect()] == want
