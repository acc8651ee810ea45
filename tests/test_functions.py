"""Scalar rules, attachments, metric rows and the time window."""

import json

import pytest
from pyspark.sql import functions as F

from agentmeter.functions import names, numbers, payload
from agentmeter.functions.content import truncation_marker
from agentmeter.functions.window import TimeWindow
from agentmeter.operators import attachments, matching, metrics

MAPPER = "- mapper: draws a chart of ports\n"
TIDY = "- tidy: sorts the drawer"


@pytest.mark.parametrize(
    "a, b, equal",
    [
        ('{"a":1,"b":2}', '{"b":2,"a":1}', True),
        ('{"a": 1}', '{ "a":1 }\n', True),
        ('{"x":{"b":[1,{"d":1,"c":2}]}}', '{"x":{"b":[1,{"c":2,"d":1}]}}', True),
        ('{"a":1}', '{"a":2}', False),
        ('{"a":123456789012345678901}', '{"a":123456789012345678902}', False),
        ('{"a":1.0}', '{"a":1}', False),
        ('{"a":', ' {"a": ', True),
        ('{"a":', "{}", False),
        ("", "{}", False),
    ],
)
def test_payload_identity(a, b, equal):
    assert (payload.digest(a) == payload.digest(b)) is equal


def test_canonical_text():
    assert payload.canonical('{"b":"<é\\u2028>","a":[true,null,1.50]}') == '{"a":[true,null,1.50],"b":"\\u003cé\\u2028\\u003e"}'
    assert len(payload.digest("{}")) == 12


def test_raw_array_keeps_exact_text():
    text = '{ "x": [1, 2], "entries" : [ {"name": "a",  "d": "\\u00e9"} ,{"name":"b"}]}'
    assert payload.raw_array(text, "entries") == ['{"name": "a",  "d": "\\u00e9"}', '{"name":"b"}']


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_names(spark):
    lit = F.lit
    assert one(spark, names.mcp_server(lit("mcp__a__b__c"))) == "a"
    assert one(spark, names.mcp_server(lit("mcp__a"))) == ""
    assert one(spark, names.mcp_canon(lit("plugin:x.y z"))) == "plugin_x_y_z"
    assert one(spark, names.codex_tool_name(lit("a"), lit("b.c\\d"))) == "a.b\\.c\\\\d"
    assert one(spark, names.codex_mcp_server(lit(""), lit("mcp__s__t"))) == "s"
    assert one(spark, names.codex_mcp_server(lit(""), lit("mcp__s__"))) == ""
    assert one(spark, names.codex_mcp_server(lit("mcp__n"), lit("mcp__s__t"))) == "n"
    assert one(spark, names.codex_mcp_server(lit("other"), lit("mcp__s__t"))) == ""
    assert one(spark, names.prefixes(lit("a_b_"), "_")) == ["a"]
    assert one(spark, truncation_marker(lit("x (truncated; call y [truncated]"))) == "[truncated]"


def test_prefix_matching(spark):
    plugins = spark.createDataFrame([("field_kit",), ("field",), ("dock",)], "plugin string")
    segments = spark.createDataFrame([("plugin_field_kit_srv",), ("plugin_dock_buoy-two",), ("plugin_field",), ("dock_x",)], "segment string")
    got = {r.segment: r.plugin for r in matching.segment_plugins(segments, plugins).collect()}
    assert got == {"plugin_field_kit_srv": "field_kit", "plugin_dock_buoy-two": "dock", "plugin_field": None, "dock_x": None}
    rent = spark.createDataFrame([("plugin:field_kit:a:b",), ("plugin:field:",), ("claude.ai X",)], "key string")
    got = {r.key: (r.plugin, r.segment) for r in matching.rent_segments(rent, plugins).collect()}
    assert got["plugin:field_kit:a:b"] == ("field_kit", "plugin_field_kit_a:b")
    assert got["plugin:field:"] == (None, "plugin:field:")
    assert got["claude.ai X"] == (None, "claude.ai X")


def test_money_and_ratios(spark):
    lit = F.lit
    weight = lambda model: one(
        spark, numbers.response_weight(lit(model), *[lit(n).cast("long") for n in (10, 2, 40, 4, 1)])
    )
    assert weight("opus") == 10000 + 10000 + 4000 + 5000 + 2000
    assert weight("X-Fable-5-1-2026") == 10000 + 10000 + 1000 + 5000 + 2000
    assert one(spark, numbers.allocate(lit(1.0), lit(1), lit(3))) == 333333
    assert one(spark, numbers.allocate(lit(1.0), lit(1), lit(0))) == 0
    assert one(spark, numbers.percent(lit(1), lit(0))) == 0.0
    grades = [one(spark, numbers.concern(lit(v))) for v in (50.0, 49.9, 20.0, 5.0, 4.9)]
    assert grades == ["!!", "***", "**", "*", ""]


def keys_of(spark, *objects):
    rows = [(json.dumps(o, separators=(",", ":"), ensure_ascii=False) if isinstance(o, dict) else o,) for o in objects]
    df = spark.createDataFrame(rows, "attachment string")
    keys = attachments.key_rows(df, F.col("attachment"))
    return {(r.dimension, r.key): (r.attachment_bytes, r.attachment_events) for r in attachments.by_key(keys).collect()}


def test_attachment_keys(spark):
    got = keys_of(
        spark,
        {"type": "hook_success", "hookName": "h"},
        {"type": "skill_listing", "names": ["mapper", "tidy"], "content": MAPPER + TIDY},
        {"type": "deferred_tools_delta", "addedNames": ["mcp__a", "mcp__b", "mcp__a"], "addedLines": ["line of 17 bytes."]},
        {"type": "mcp_instructions_delta", "addedNames": ["srv"], "addedBlocks": ["how to call it"]},
        {"type": "agent_listing_delta", "addedTypes": ["ag"], "addedLines": ["xyz"]},
        {"type": "instructions", "files": [{"path": "guide.md", "content": "short"}, {"path": "none.md"}, {"path": "blank.md", "content": ""}]},
        '{"type":"deferred_tools_record","entries":[{"name": "T", "d": "\\u00e9"},{"x":1},{"name":"T"}]}',
        {"type": "file", "content": {"odd": 1}},
    )
    assert got[("hook_name", "h")] == (len('{"type":"hook_success","hookName":"h"}'), 1)
    assert got[("skill", "mapper")] == (len(MAPPER), 1) and got[("skill", "tidy")] == (len(TIDY), 1)
    assert got[("mcp_tool", "mcp__a")] == (17 + 6, 1) and got[("mcp_tool", "mcp__b")] == (6, 1)
    assert got[("mcp_server", "srv")] == (14, 1)
    assert got[("agent", "ag")] == (3, 1)
    assert got[("instruction_file", "guide.md")] == (5, 1)
    assert got[("instruction_file", "none.md")] == (7, 1)
    assert got[("instruction_file", "blank.md")] == (0, 1)
    assert got[("mcp_tool", "T")] == (len('{"name": "T", "d": "\\u00e9"}') + len('{"name":"T"}'), 1)
    assert len(got) == 11


def test_listing_prefers_the_longest_declared_name(spark):
    content = "ignored\n- plug:skill: text: more\ncontinued\n- plug: x\n- undeclared: y\n\n- a|b: z"
    got = keys_of(spark, {"type": "skill_listing", "names": ["plug", "plug:skill", "a|b", "\\E", ""], "content": content})
    lines = content.split("\n")
    size = lambda a, b, newline: sum(len(x) + 1 for x in lines[a:b]) - (0 if newline else 1)
    assert got[("skill", "plug:skill")][0] == size(1, 3, True)
    assert got[("skill", "plug")][0] == size(3, 6, True)
    assert got[("skill", "a|b")][0] == size(6, 7, False)


def test_window_bounds(spark):
    with pytest.raises(ValueError):
        TimeWindow(since="2026-9-1")
    with pytest.raises(ValueError):
        TimeWindow(until="2026-09-01T10:00:00Z")
    inside = lambda ts, *w: one(spark, TimeWindow(*w).includes(F.lit(ts)))
    assert inside("2026-09-02T23:59:59.999Z", "", "2026-09-02")
    assert not inside("2026-09-03T00:00:00.000Z", "", "2026-09-02")
    assert inside("2026-09-02T00:00:00.000Z", "2026-09-02", "")
    assert not inside("", "2026-09-02", "")
    assert inside("", "", "")
    full = "2026-09-02T10:00:00.500Z"
    assert inside(full, full, full)
    assert not inside("2026-09-02T10:00:00.501Z", "", full)
    millis = lambda ms, *w: one(spark, TimeWindow(*w).includes_millis(F.lit(ms)))
    assert millis(1704844800000, "2024-01-10", "2024-01-10")
    assert not millis(1704931200000, "2024-01-10", "2024-01-10")
    assert millis(1704844800500, "", "2024-01-10T00:00:00.500Z")
    assert not millis(1704844800501, "", "2024-01-10T00:00:00.500Z")


def test_contract_violations_are_refused(spark):
    wide = spark.createDataFrame([("k", 1, None)], "key string, a long, b double")
    rows = metrics.unpivot(
        wide, "c", 0, "d", F.col("key"),
        [metrics.Measure("a", F.col("a"), "x"), metrics.Measure("b", F.col("b"), "y", True)],
    )
    assert [(r.name, r.value_long, r.derivation) for r in metrics.validated(rows).collect()] == [("a", 1, "measured")]
    guess = rows.withColumn("derivation", F.lit("estimated"))
    assert metrics.violations(guess).count() == 1
    with pytest.raises(Exception, match="without derivation or method"):
        metrics.validated(guess).collect()


def test_top_rows_are_cut_before_the_shuffle(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("dimension"), F.col("id").alias("v"))
    top = metrics.top_per_dimension(rows, "dimension", [F.desc("v")], 2)
    assert sorted((r.dimension, r.v, r.total) for r in top.collect())[:2] == [(0, 996, 334), (0, 999, 334)]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    assert metrics.top_per_dimension(rows, "dimension", [F.desc("v")], 0).count() == 1000


def test_window_reaches_the_scan(spark, tmp_path):
    spark.range(10).select(F.col("id").cast("string").alias("ts"), "id").write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p")).filter(TimeWindow("2024-01-10", "2024-01-20").includes(F.col("ts")))
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = df.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-10)" in plan and "LessThanOrEqual(ts,2024-01-20" in plan
