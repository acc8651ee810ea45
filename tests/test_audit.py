"""Config audits and part tables over small literals."""

import json

from helpers import value_of
from pyspark.sql import functions as F

from agentmeter.operators import audit
from agentmeter.plans import commands
from agentmeter.sources import config

SCHEMA = "host string, root string, base string, path string, content string"


def files(spark, *rows):
    dump = lambda c: c if isinstance(c, str) or c is None else json.dumps(c)
    return spark.createDataFrame([("", r, b, p, dump(c)) for r, b, p, c in rows], SCHEMA)


def test_front_matter_rules(spark):
    cases = {
        "plain": ("no block", ["frontmatter_missing"]),
        "open": ("---\nname: open\n", ["frontmatter_unterminated"]),
        "good": ("---\r\nname: \"good\"\r\ndescription: 'x'\r\nallowed-tools: Read, Bash(go:*)\r\n---\r\n", []),
        "bad": ("---\n  name: nested\nname: other\nname: bad\ndescription: ''\nallowed-tools: A && B\n---",
                ["name_mismatch", "description_missing", "allowed_tools_malformed"]),
        "list": ("---\nname: list\ndescription: d: e\nallowed-tools: [Read\n---", ["allowed_tools_malformed"]),
        "empty": ("---\nname: empty\n# c: d\ndescription: d\nallowed-tools: []\n---", []),
    }
    rows = [("h", name, name, text) for name, (text, _) in cases.items()]
    skills = spark.createDataFrame(rows, "host string, key string, directory string, content string")
    got = {}
    for r in audit.skill_findings(audit.front_matter(skills)).collect():
        got.setdefault(r.key, []).append(r.kind)
    assert got == {n: kinds for n, (_, kinds) in cases.items() if kinds}


def test_doctor_static(spark):
    tree = files(
        spark,
        ("user", "/u/.claude", "settings.json", {"mcpServers": {"a": {"command": "x"}, "b": {"type": "odd"}}}),
        ("store", "/u", ".claude.json", {"mcpServers": {"a": {}}, "projects": {"/p": {"mcpServers": {"c": 5}}}}),
        ("project", "/p", ".mcp.json", {"mcpServers": {"a": {"type": "http"}}}),
        ("user", "/u/.claude", "plugins/installed_plugins.json", {"plugins": {"pl@m": [{"installPath": "/i"}]}}),
        ("install", "/i", ".mcp.json", {"srv": {"command": "y"}, "note": 1}),
        ("user", "/u/.claude", "plugins/pl/.claude-plugin/plugin.json", {"name": "other"}),
        ("user", "/u/.claude", "plugins/bare/readme.md", "x"),
        ("user", "/u/.claude", "skills/s1/SKILL.md", "---\nname: s1\ndescription: d\n---"),
        ("project", "/p", ".agents/skills/s2/SKILL.md", "nothing"),
        ("project", "/p", ".agents/skills/deep/er/SKILL.md", "nothing"),
    )
    env = commands.doctor(tree)
    m = env.metrics.cache()
    assert value_of(m, "skills_checked") == 2
    assert value_of(m, "plugins_checked") == 2
    assert value_of(m, "mcp_servers_checked") == 4
    assert value_of(m, "findings", "skill", "/p/.agents/skills/s2") == 1
    assert value_of(m, "findings", "plugin", "pl") == 1
    assert value_of(m, "findings", "mcp_server", "a") is None
    assert value_of(m, "findings", "mcp_server", "b") == 1
    assert value_of(m, "findings", "mcp_server", "c") == 1
    texts = sorted(r.text for r in env.warnings.filter("code = 'collision'").collect())
    assert len(texts) == 2 and "project over user" in texts[0]
    broken = commands.doctor(tree.union(files(spark, ("project", "/q", ".mcp.json", "{"))))
    assert value_of(broken.metrics, "mcp_servers_checked") is None


def test_configured_against_observed(spark):
    configured = spark.createDataFrame([("", "plugin:dock:crane"), ("", "idle"), ("", "claude.ai Atlas")], "host string, name string")
    seen = spark.createDataFrame(
        [("", "s1", "plugin_dock_crane"), ("", "s1", "plugin:dock:crane"), ("", "s2", "stray"), ("", "s3", "claude_ai_Atlas")],
        "host string, session string, server string",
    )
    rows = {r.key: (r.never_observed, r.unconfigured_observed) for r in audit.join_configured(configured, seen).collect()}
    assert rows["idle"] == (3, None)
    assert rows["stray"] == (None, 1)
    assert rows["plugin:dock:crane"] == (None, None)
    nothing = audit.join_configured(configured, seen.limit(0))
    assert {(r.never_observed, r.unconfigured_observed) for r in nothing.collect()} == {(None, None)}


def test_opencode_tools_and_doctor(spark):
    def part(session, ms, tool, status="done", text="é"):
        state = {"output": text, **({"status": status} if status else {})}
        return (session, ms, json.dumps({"type": "tool", "tool": tool, "state": state}, ensure_ascii=False))

    parts = spark.createDataFrame(
        [part("a", 1_700_000_000_000, "engram_mem_search"), part("b", 1_700_000_001_000, "engram_x", "error", "abc"),
         part("b", 1_700_000_002_000, "quiet", None), ("b", 1_700_000_003_000, json.dumps({"type": "text"}))],
        "session_id string, time_created bigint, data string",
    )
    servers = spark.createDataFrame([("engram",), ("engram_mem",)], "server string")
    env = commands.opencode_tools(parts, servers)
    m = env.metrics.cache()
    assert value_of(m, "calls") == 3
    assert value_of(m, "errors") is None
    assert value_of(m, "errors", "tool", "engram_x") == 1
    assert value_of(m, "errors", "tool", "quiet") is None
    assert value_of(m, "context_bytes", "mcp_server", "engram_mem") == 2
    assert value_of(m, "image_bytes", "tool", "engram_x") is None
    tree = files(
        spark,
        ("opencode", "/c", "opencode.json",
         {"mcp": {"engram": {"command": ["run"]}, "off": {"enabled": False, "url": "u"}, "idle": {"type": "local"}}}),
        ("project", "/p", "opencode.json", {"mcp": {"engram": {"command": " run "}}}),
    )
    m = commands.opencode_doctor(tree, parts).metrics.cache()
    assert value_of(m, "never_observed", "mcp_server", "idle") == 2
    assert value_of(m, "never_observed", "mcp_server", "off") is None
    assert value_of(m, "unconfigured_observed", "mcp_server", "quiet") == 1
    assert value_of(m, "unconfigured_observed", "mcp_server", "engram_x") is None
    assert value_of(m, "findings", "mcp_server", "idle") == 1
    assert value_of(m, "mcp_servers_checked") == 3
    assert value_of(m, "tool_sessions") == 2


def test_config_trees_are_read_from_disk(spark, tmp_path):
    (tmp_path / "skills" / "one").mkdir(parents=True)
    (tmp_path / "skills" / "one" / "SKILL.md").write_text("---\nname: one\ndescription: d\n---\n")
    (tmp_path / "settings.json").write_text('{"enabledPlugins":{"pl@m":true}}')
    tree = config.read_config_tree(spark, "h", "user", str(tmp_path))
    assert sorted(r.path for r in tree.collect()) == ["settings.json", "skills/one/SKILL.md"]
    assert [r.plugin for r in config.enabled_plugins(tree).collect()] == ["pl"]
    assert config.skill_files(tree).select(F.col("directory")).first().directory == "one"
