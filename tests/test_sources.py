"""Readers over small files, and what survives executors without this package."""

import pickle
import subprocess
import sys

import pytest
from pyspark import cloudpickle

from agentmeter.functions import payload
from agentmeter.operators import calls as call_ops
from agentmeter.operators import metrics
from agentmeter.sources import listing, parts, transcripts


def test_session_cache_document(spark, tmp_path):
    path = tmp_path / "stats-cache.json"
    path.write_text('{\n "version": 2,\n "totalSessions": 5\n}\n')
    assert transcripts.cached_sessions(spark, str(path)).first().total_sessions == 5


def test_listing_counts_empty_files(spark, tmp_path):
    for name, text in (("a.jsonl", "{}\n"), ("d e/b+c.JSONL", ""), ("d e/deep/c.jsonl", "x"), ("skip.txt", "x")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r.file: r.bytes for r in transcripts.list_files(spark, str(tmp_path)).collect()}
    assert got == {f"{tmp_path}/a.jsonl": 3, f"{tmp_path}/d e/b+c.JSONL": 0, f"{tmp_path}/d e/deep/c.jsonl": 1}


def test_scan_order_is_walk_order(spark, tmp_path):
    for name in ("b/x.jsonl", "b.jsonl", "a b.jsonl", "a/z.jsonl", "a-1.jsonl"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f'{{"type":"{name}"}}\n{{"type":"second"}}\n')
    rows = transcripts.read_events(spark, str(tmp_path)).filter("type <> 'second'").orderBy("chunk", "pos").collect()
    walk = sorted((str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*.jsonl")), key=lambda p: p.split("/"))
    assert [r.type for r in rows] == walk


def test_side_files_are_compared(spark, tmp_path):
    (tmp_path / "ok").write_text("12345")
    (tmp_path / "short").write_text("1")
    listed = transcripts.list_side_files(spark, str(tmp_path))
    rows = [(f"{tmp_path}/{n}", 5, 1, 0, 0, 0) for n in ("ok", "short", "gone")] + [(f"{tmp_path}/ok", 5, 2, 0, 0, 0)]
    calls = spark.createDataFrame(
        rows, "persisted_path string, persisted_size long, event_results int, idx long, context_bytes long, image_bytes long"
    ).selectExpr("*", "struct('Bash' AS tool) AS call")
    got = sorted((r.persisted_path.rsplit("/", 1)[1], r.problem) for r in call_ops.check_side_files(calls, listed).collect())
    assert got == [("gone", "missing"), ("ok", "ambiguous"), ("short", "size_mismatch")]


def test_parts_from_any_source(spark, tmp_path):
    row = spark.createDataFrame([("s", 1, "{}", "more")], "session_id string, time_created bigint, data string, extra string")
    row.write.format("orc").save(str(tmp_path / "p"))
    assert parts.read_parts(spark, str(tmp_path / "p"), "orc").columns == ["session_id", "time_created", "data"]


def test_task_functions_need_no_package_on_executors():
    for function in (payload.payload_hash.func, payload.message_input_hashes.func, payload.record_entry_bytes.func, listing.list_level):
        blob = cloudpickle.dumps(function)
        code = "import sys,pickle;f=pickle.loads(sys.stdin.buffer.read());assert 'agentmeter' not in sys.modules;print(callable(f))"
        done = subprocess.run([sys.executable, "-c", code], input=blob, capture_output=True, cwd="/tmp", check=False)
        assert done.stdout.strip() == b"True", done.stderr[-500:]
    assert pickle.loads(cloudpickle.dumps(payload.digest))("{}") == payload.digest("{}")


def test_corpus_drift(spark):
    headers = spark.createDataFrame(
        [("scan", 3, 10), ("tools", 3, 10), ("attribute", 4, 12)], "command string, files bigint, bytes bigint"
    )
    assert [r.command for r in metrics.corpus_drift(headers, "scan").collect()] == ["attribute"]


def test_a_repeated_key_loses_no_result(spark, write_jsonl, tmp_path):
    """Every literal as content, one block with a key twice, and an escaped type."""
    contents = {
        "a": '"12"', "b": '[{"type":"text","text":"x","text":"yy"}]', "c": '"333"', "d": '{"k":1,"k":2}',
        "e": "7", "f": "null", "g": "true", "h": '[7,"s"]', "i": '"[1]"', "j": '[{"type":"image","source":{"data":"abcd"}}]',
    }
    blocks = ",".join(f'{{"type":"tool_result","tool_use_id":"{k}","content":{c}}}' for k, c in contents.items())
    use = '{"type":"tool\\u005fuse","id":"u","name":"T","input":{"n":1.0}}'
    directory = write_jsonl(
        "x.jsonl",
        f'{{"type":"user","sessionId":"s","message":{{"content":[{blocks}]}}}}',
        f'{{"type":"assistant","sessionId":"s","message":{{"content":[{use}]}}}}',
    )
    corpus = transcripts.read_corpus(spark, directory, str(tmp_path / "silver"))
    got = {r.use_id: (r.context_bytes, r.image_bytes) for r in corpus.results.collect()}
    text = {"a": 2, "b": 2, "c": 3, "i": 3}
    assert got == {k: (text.get(k, 0), 4 if k == "j" else 0) for k in contents}
    (used,) = corpus.uses.collect()
    assert used.tool == "T" and used.hash == payload.digest('{"n":1.0}')


def test_deep_payloads():
    for depth in (600, 5000):
        deep = "[" * depth + "]" * depth
        assert payload.digest(deep) != payload.digest("")
        message = f'{{"content":[{{"input":{deep}}},{{"input":{{"a":1}}}}]}}'
        assert payload._block_hashes(message, payload._decoder()) == [payload.digest(deep), payload.digest('{"a":1}')]
    assert payload.canonical('{"b":1.0,"a":[1,{"y":null}],"c":{},"d":[]}') == '{"a":[1,{"y":null}],"b":1.0,"c":{},"d":[]}'


@pytest.mark.parametrize("glob, hits", [
    ("*.[jJ][sS][oO][nN][lL]", {"a.jsonl", "b.JSONL"}), ("*.txt", {"c.txt"}), ("{a,c}.*", {"a.jsonl", "c.txt"}),
    ("?.[!j]*", {"b.JSONL", "c.txt"}),
])
def test_manifest_lists_what_the_scan_reads(spark, write_jsonl, tmp_path, glob, hits):
    for name in ("a.jsonl", "b.JSONL", "c.txt"):
        directory = write_jsonl(name, {"type": "user", "sessionId": name})
    corpus = transcripts.read_corpus(spark, directory, str(tmp_path / "silver"), glob=glob)
    names = lambda df, c: {r[0].rsplit("/", 1)[1] for r in df.select(c).collect()}
    assert names(corpus.manifest, "file") == names(corpus.events, "file") == hits


def test_a_read_file_must_be_listed(spark):
    listing = spark.createDataFrame([("/a", 1)], "file string, bytes bigint")
    quality = spark.createDataFrame([("/b", 1, 0, 0)], "file string, transcript_lines bigint, journal_records bigint, parse_errors bigint")
    with pytest.raises(Exception, match="listing lacks"):
        transcripts.file_manifest(listing, quality).collect()
