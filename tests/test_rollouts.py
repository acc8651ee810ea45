"""Rollout files: scoping, timestamps, joins and what makes them unsafe."""

import pytest
from helpers import value_of
from pyspark.sql import functions as F

from agentmeter.functions.window import TimeWindow
from agentmeter.plans import commands
from agentmeter.sources import rollouts

T0 = "2026-09-01T10:00:00.123456789Z"


def meta(session, ts=T0, **extra):
    return {"timestamp": ts, "type": "session_meta", "payload": {"id": session, **extra}}


def call(call_id, name="shell", ts=T0, kind="function_call", **extra):
    return {"timestamp": ts, "type": "response_item",
            "payload": {"type": kind, "call_id": call_id, "name": name, "arguments": "{}", **extra}}


def output(call_id, body, ts=T0, kind="function_call_output"):
    return {"timestamp": ts, "type": "response_item", "payload": {"type": kind, "call_id": call_id, "output": body}}


def run(spark, directory, window=TimeWindow(), strict=True):
    scoped = rollouts.scope(rollouts.read_rollouts(spark, directory))
    size = spark.createDataFrame([(123,)], "bytes bigint")
    return commands.codex_tools(scoped, size, window, strict=strict)


def test_volume_taint_and_quality(spark, write_jsonl):
    image = {"type": "input_image", "image_url": "data:image/png;base64,QUJD"}
    directory = write_jsonl(
        "a.jsonl",
        {"timestamp": T0, "type": "response_item", "payload": {"type": "message"}},
        meta("s1"),
        call("c1", namespace="mcp__docs"), output("c1", "héé"),
        call("c1", namespace="mcp__docs"), output("c1", "héé"),
        call("c2", name="view.image"), output("c2", [{"type": "input_text", "text": "ab"}, image]),
        call("c3"), output("c3", {"odd": 1}),
        call("c4"),
        output("lost", "x"),
        call("", name="bad"),
        {"timestamp": "yesterday", "type": "brand_new", "payload": {}},
        {"timestamp": T0, "type": "response_item", "payload": {"type": "web_search_call"}},
        "not json",
    )
    write_jsonl("b.jsonl", {"timestamp": T0, "type": "event_msg", "payload": {}})
    env = run(spark, directory)
    m = env.metrics.cache()
    assert value_of(m, "context_bytes", "tool", "mcp__docs.shell") == 5
    assert value_of(m, "context_bytes", "mcp_server", "docs") == 5
    assert value_of(m, "image_bytes", "tool", "view\\.image") == 4
    assert value_of(m, "context_bytes", "tool", "view\\.image") == 2
    assert value_of(m, "calls", "tool", "shell") == 1
    assert value_of(m, "context_bytes", "tool", "shell") is None
    assert value_of(m, "context_bytes") is None
    assert value_of(m, "image_results") is None
    assert value_of(m, "calls") == 3
    assert value_of(m, "tool_use_blocks") == 4
    assert value_of(m, "unanswered_uses") == 1
    assert value_of(m, "unmatched_results") == 1
    codes = {r.code for r in env.warnings.collect()}
    assert {"duplicates", "unmatched_result", "unmeasured_payload", "malformed_item", "unsupported_item",
            "unknown_event", "invalid_times", "unscoped", "parse_errors"} <= codes
    assert env.header.first().files == 1


def test_malformed_header_closes_the_session(spark, write_jsonl):
    directory = write_jsonl(
        "a.jsonl", meta("s1"), call("c1"), {"timestamp": T0, "type": "session_meta", "payload": {"id": 4}},
        output("c1", "x"), meta("s2"), output("c1", "yy"),
    )
    env = run(spark, directory)
    assert value_of(env.metrics, "unmatched_results") == 1
    assert value_of(env.metrics, "unanswered_uses") == 1


@pytest.mark.parametrize(
    "records, kind",
    [
        ([meta("s"), call("c"), call("c", name="other")], "conflicting_copies"),
        ([meta("s"), call("c"), output("c", "x", kind="custom_tool_call_output")], "type_mismatch"),
        ([meta("p"), call("c"), meta("q", forked_from_id="p"), call("c")], "inherited_call"),
        ([meta("p", parent_thread_id="q"), call("c"), meta("q", forked_from_id="p")], "cyclic_ancestry"),
        ([meta("p", forked_from_id="x"), meta("p", forked_from_id="y")], "conflicting_ancestry"),
    ],
)
def test_unsafe_joins_are_refused(spark, write_jsonl, records, kind):
    directory = write_jsonl("a.jsonl", *records)
    with pytest.raises(ValueError, match=kind):
        run(spark, directory)


def test_timestamps_keep_nanoseconds_and_offsets(spark):
    rows = [
        ("2026-09-01T10:00:00.1Z", "2026-09-01T10:00:00.100000000Z"),
        ("2026-09-01T01:30:00.123456789+02:00", "2026-08-31T23:30:00.123456789Z"),
        ("2026-09-01T10:00:00-00:30", "2026-09-01T10:30:00.000000000Z"),
        ("2026-02-30T10:00:00Z", None),
        ("2026-09-01 10:00:00Z", None),
    ]
    got = spark.createDataFrame(rows, "a string, b string").select(
        rollouts.normalise_timestamp(F.col("a")).alias("x"), "b"
    ).collect()
    assert [r.x for r in got] == [r.b for r in got]


def test_window_is_nanosecond_exact(spark, write_jsonl):
    late = "2026-09-01T23:59:59.999999999Z"
    directory = write_jsonl("a.jsonl", meta("s"), call("c"), output("c", "x", ts=late))
    assert value_of(run(spark, directory, TimeWindow(until="2026-09-01")).metrics, "calls") == 1
    exact = TimeWindow(until="2026-09-01T23:59:59.999Z")
    assert value_of(run(spark, directory, exact).metrics, "calls") == 0


def test_ambiguous_figures_are_withheld_with_a_warning(spark, write_jsonl):
    directory = write_jsonl(
        "a.jsonl",
        meta("sure"), call("k", name="fine"), output("k", "four"),
        meta("s"), call("c", name="one"), call("c", name="two"), output("c", "x"),
        call("d", name="three"), output("d", "y", kind="custom_tool_call_output"),
        meta("p"), call("i", name="four"), meta("q", forked_from_id="p"), call("i", name="four"), output("i", "z"),
        meta("u", forked_from_id="v"), call("u", name="five"), meta("v", forked_from_id="u"),
        meta("w", forked_from_id="a"), meta("w", parent_thread_id="b"), call("w", name="six"),
    )
    scoped = rollouts.scope(rollouts.read_rollouts(spark, directory))
    size = spark.createDataFrame([(123,)], "bytes bigint")
    env = commands.codex_tools(scoped, size, strict=False, withhold=True)
    m = env.metrics.cache()
    assert value_of(m, "calls", "tool", "fine") == 1 and value_of(m, "context_bytes", "tool", "fine") == 4
    for tool in ("one", "two", "three", "four", "five", "six"):
        assert value_of(m, "calls", "tool", tool) is None
    assert value_of(m, "context_bytes") is None and value_of(m, "tool_use_blocks") is None and value_of(m, "distinct_tools") is None
    assert value_of(m, "unmatched_results") == 0
    said = {(r.code, r.text) for r in env.warnings.collect()}
    assert {
        ("conflicting_copies", "session s: the copies of call c differ"),
        ("type_mismatch", "session s: call d has a result of another type"),
        ("inherited_call", "session q: call i is also one of session p, which it descends from"),
        ("cyclic_ancestry", "session u: its ancestry leads back to itself"),
        ("conflicting_ancestry", "session w names more than one parent"),
        ("withheld", "two: figures withheld because of conflicting_copies"),
        ("withheld", "four: figures withheld because of inherited_call"),
        ("withheld_total", "totals that ambiguous joins enter are withheld"),
    } <= said
    unchecked = commands.codex_tools(scoped, size, strict=False)
    assert value_of(unchecked.metrics, "calls") == 3
    assert "unchecked" in {r.code for r in unchecked.warnings.collect()}


def test_a_corpus_without_sessions_is_refused(spark, write_jsonl):
    directory = write_jsonl("a.jsonl", {"timestamp": T0, "type": "event_msg", "payload": {}}, "not json")
    with pytest.raises(ValueError, match="no session header .* 1 files, 1 malformed"):
        run(spark, directory)


def test_repeated_keys_are_read_and_wrong_types_are_not(spark, write_jsonl):
    line = lambda payload: '{"timestamp":"%s","type":"response_item","payload":%s}' % (T0, payload)
    directory = write_jsonl(
        "a.jsonl",
        '{"timestamp":"%s","type":"session_meta","payload":{"id":"old","id":"s","note":{"k":1,"k":2}}}' % T0,
        line('{"type":"message","type":"function_call","call_id":"c","name":"x","name":"shell","arguments":{"a":1,"a":2}}'),
        line('{"type":"function_call_output","call_id":"c","output":[{"type":"input_text","text":"no","text":"héé"}]}'),
        line('{"type":"function_call","call_id":"d","name":"odd"}'),
        line('{"type":"function_call_output","call_id":"d","output":{"k":1,"k":2}}'),
        line('{"type":"function_call","call_id":7,"name":"x"}'),
        line('{"type":"function_call_output","call_id":"e","name":[1],"output":"x"}'),
        line('{"type":{"k":1,"k":2},"call_id":"f","name":"x"}'),
    )
    env = run(spark, directory)
    m = env.metrics.cache()
    assert value_of(m, "calls", "tool", "shell") == 1 and value_of(m, "context_bytes", "tool", "shell") == 5
    assert value_of(m, "calls", "tool", "odd") == 1 and value_of(m, "context_bytes", "tool", "odd") is None
    assert "3 malformed tool records excluded" in {r.text for r in env.warnings.collect()}
