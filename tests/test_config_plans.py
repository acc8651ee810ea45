"""Config rows are dealt out by key before they are grouped, and each document is parsed once."""

import pytest

from agentmeter.operators import audit
from agentmeter.plans import commands
from agentmeter.sources import config

FILES = [
    ("h1", "opencode", "/o", "opencode.json", '{"mcp":{"a":{"command":["x"]},"b":{"type":"odd"}}}'),
    ("h1", "opencode", "/other", "opencode.json", '{"mcp":{"b":{"url":"u"}}}'),
    ("h1", "project", "/p", "opencode.json", '{"mcp":{"a":{"command":" "}}}'),
    ("h2", "opencode", "/o", "opencode.json", "broken"),
    ("h2", "project", "/p", "opencode.json", '{"mcp":{}}'),
    ("h3", "opencode", "/o", "opencode.json", None),
]


@pytest.fixture
def files(spark):
    return spark.createDataFrame(FILES, "host string, root string, base string, path string, content string")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def test_winners_are_those_of_the_merge(files):
    entries = config.opencode_server_entries(files)
    rows = lambda df: sorted((r.host, r.name, r.precedence, r.scope, r.source, str(r.spec)) for r in df.collect())
    won, merged = audit.winners(entries), audit.merge_servers(entries).filter("is_winner")
    assert rows(won) == rows(merged) and [r[:3] for r in rows(won)] == [("h1", "a", 2), ("h1", "b", 1)]
    found = lambda df: sorted(map(tuple, audit.opencode_server_findings(df).collect()))
    assert found(won) == found(merged) == [("h1", "mcp_server", "a", "url_missing")]


def test_servers_once_each(files):
    assert sorted(map(tuple, config.opencode_servers(files).collect())) == [("h1", "a"), ("h1", "b")]


def test_nothing_is_grouped_before_it_is_dealt_out(files):
    for df in (config.opencode_servers(files), audit.winners(config.opencode_server_entries(files))):
        plan = plan_of(df)
        assert plan.count("Exchange hashpartitioning") == 1
        assert "Aggregate" in plan.split("Exchange hashpartitioning")[0]
        assert "Aggregate" not in plan.split("Exchange hashpartitioning")[1]


def test_documents_are_parsed_once(files):
    plan = plan_of(config.opencode_servers(files))
    assert plan.count("from_json") == 1


def test_no_filter_parses_a_document_again(files):
    for df in (config.server_entries(files), config.opencode_server_entries(files), config.opencode_servers(files)):
        lines = plan_of(df).splitlines()
        assert not [line for line in lines if "Filter" in line and "from_json" in line]


def test_doctor_counts_its_denominators_once(files):
    said = commands.doctor(files).warnings
    assert "array_contains" not in said._jdf.queryExecution().optimizedPlan().toString()
