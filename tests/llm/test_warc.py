import base64
import hashlib
import io

import pytest
import zstandard

from agentmeter.llm import warc

SCHEMA = "page_id long, url string, html string, key string, sha1 string, refers_to long"
PAGES = [
    (1, "http://a.example/x?y=1", "same"),
    (2, "http://b.example/a b\nWARC-Type: x", "same"),
    (3, None, None),
    (4, "http://c.example/é", ""),
    (5, "u", "Ünï\r\n\r\nWARC/1.1 日本"),
    (6, "u", "x" * 3_000_000),
    (6, "u", "other"),
    (7, "u", "twice"),
    (7, "u", "twice"),
    (None, "u", "same"),
    (None, "u", "alone"),
]


def make(spark, rows):
    return spark.createDataFrame([(*r, "k", "s", 5) for r in rows], SCHEMA)


def want(rows):
    out, best = [], {}
    for i, _, html in rows:
        best[html or ""] = max(best.get(html or ""), i, key=lambda x: -1 if x is None else x)
    for i, _, html in rows:
        body = (html or "").encode()
        keeper = best[html or ""]
        first = i == keeper or keeper is None
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((i, len(body), digest, "response" if first else "revisit", None if first else keeper))
    return sorted(out, key=str)


def test_round_trip(spark):
    got = warc.round_trip(make(spark, PAGES).repartition(3))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=str) == want(PAGES)


def test_files_are_plain_zstandard_and_seekable(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 4_000)
    monkeypatch.setattr(warc, "FRAME_BYTES", 900)
    rows = [(i, f"http://x/{i}", f"<p>{i}</p>" * 20) for i in range(60)]
    # The limits apply in this process, where the bundles are made by hand.
    bundle = warc.Bundle()
    for i, url, html in rows:
        digest = warc.base32(hashlib.sha1(html.encode()).hexdigest())
        bundle.add(str(i), warc.record(str(i), url, html.encode(), digest, None, "2020-01-01T00:00:00Z"))
    content = bundle.content() + warc._LINE_END.encode("latin-1")
    spans, index = warc.open_bundle(content)
    assert len(spans) > 10 and len(index) == 60
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content), read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == 60
    for name, frame, offset, length in index:
        data = zstandard.ZstdDecompressor().decompress(content[slice(*spans[frame])])
        assert warc.parse(data[offset : offset + length])["payload"] == rows[int(name)][2].encode()


def test_single_records_by_key(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write(make(spark, PAGES), path)
    found = {r.key: r for r in warc.read(spark, path, ["5", "4", "nowhere"]).collect()}
    assert set(found) == {"4", "5"} and bytes(found["5"].payload).decode() == PAGES[4][2]
    assert found["4"].payload == b"" and found["4"].url == "http://c.example/%C3%A9"


def test_string_keys(spark):
    pages = spark.createDataFrame([("a b/ü>", "u", "x"), ("a", "u", "x")], "page_id string, url string, html string")
    got = sorted(warc.round_trip(pages).select("page_id", "refers_to").collect())
    assert [tuple(r) for r in got] == [("a", "a b/ü>"), ("a b/ü>", None)]


def test_damage_is_noticed(spark):
    record = warc.record("1", "u", b"payload", warc.base32(hashlib.sha1(b"other").hexdigest()), None, "d")
    with pytest.raises(ValueError):
        warc.parse(record)
    with pytest.raises(ValueError):
        warc.open_bundle(b"no bundle at all, but long enough")


def test_empty(spark):
    assert warc.round_trip(make(spark, [])).collect() == []
