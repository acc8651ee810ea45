import random
import re
import string

import numpy as np
import pytest

from agentmeter.llm import secrets
from agentmeter.llm.queries import op10_secrets

NAMES = "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"
ASSIGN = re.compile(rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
HEX = "0123456789abcdef" * 2
KEY = "AKIA" + "Z9" * 8


def brute(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(secrets.KINDS[k], a, b) for a, k, b in sorted(found)]


CASES = [
    f"é PassWord = '{HEX}' ß",
    f"token:abcde token: abcdef api_key=\"x\" ApiKey  =  q.w.e.r.t",
    f"token=token=secret=abcdefgh {KEY}{KEY} {KEY[:19]} A{KEY}",
    f"{HEX[:23]} {HEX[:24]}g{HEX[:24]} DEADBEEF{HEX}",
    f"passwd = \n 'nothing' paſsword=longenough toKen=longenough",
    f"日本 secret_key: abcdef secret: {HEX}-日本 {KEY}",
]


def test_base_spans(make_documents, odd):
    rows = [(100 + i, x) for i, x in enumerate(CASES)] + odd
    got = sorted(
        (
            (r.doc_id, [(s.kind, s.start, s.end) for s in r.spans if s.kind != "random"])
            for r in secrets.scan(make_documents(rows)).collect()
        ),
        key=repr,
    )
    assert got == sorted(((i, brute(x)) for i, x in rows), key=repr)


@pytest.fixture(scope="module")
def trained(spark):
    return secrets.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_models_tell_random_strings_from_identifiers(trained):
    rng = random.Random(5)
    signs = string.ascii_letters + string.digits
    keys = ["".join(rng.choice(signs) for _ in range(rng.choice([20, 24, 32, 40]))) for _ in range(200)]
    plain = "getUserByIdentifier2 my_long_variable_name_1 2024-01-15-report-final 4785380592391139 python3/site-packages".split()
    found = [secrets.find(f"use {k} here".encode(), trained, secrets.Rule()) for k in keys]
    assert sum(any(kind == "random" for _, kind, _ in spans) for spans in found) >= 180
    for word in plain:
        assert secrets.find(f"see {word} there".encode(), trained, secrets.Rule()) == []


def test_random_spans_keep_out_of_fixed_ones_and_count_code_points(trained):
    key = "q7ZpX2mKd9RtV4bYw8Hs"
    text = f"ü password={key} ü {key}"
    spans = secrets.find(text.encode(), trained, secrets.Rule())
    assert [(k, text[a:b]) for a, k, b in spans] == [("assign", f"password={key}"), ("random", key)]


def test_training_counts_everything_once(make_documents):
    docs = make_documents([(1, f"plain words {KEY}"), (2, None), (3, "")])
    assert secrets.train(docs).any()
    assert not secrets.train(make_documents([(1, "plain words only")])).any()
    assert not secrets.train(make_documents([])).any()


def test_redact(make_documents, odd):
    docs = make_documents([(100, f"a {KEY} b token={HEX}"), *odd])
    out = secrets.redact(docs)
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[100].text == "a <secret> b <secret>" and rows[100].n_chars == 21
    assert rows[1].text is None and rows[2].text == "" and rows[4].text == dict(odd)[4]


def test_query_digests(spark):
    import hashlib

    directory = "/root/testdata/sf0.001"
    texts = dict(spark.read.parquet(f"{directory}/documents.parquet").select("doc_id", "text").collect())
    for r in op10_secrets(spark, directory).collect():
        want = brute(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for k, _, _ in want) for kind in secrets.KINDS[:3])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()


def test_ratio_is_finite(trained):
    assert np.isfinite(trained).all()


@pytest.mark.parametrize("size", [513, 700, 1600, 2000])
def test_long_keys_are_one_span(trained, size):
    rng = random.Random(size)
    key = "".join(rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(size))
    text = f"ü see {key} there"
    spans = secrets.find(text.encode(), trained, secrets.Rule())
    assert [(kind, text[a:b]) for a, kind, b in spans] == [("random", key)]


def test_long_runs_of_plain_words_are_no_secret(trained):
    text = "see " + "my_long_variable_name_1-" * 100 + " there"
    assert secrets.find(text.encode(), trained, secrets.Rule()) == []


def test_letters_alone_can_be_a_key(trained):
    rng = random.Random(11)
    keys = ["".join(rng.choice(string.ascii_letters) for _ in range(32)) for _ in range(200)]
    found = [secrets.find(f"use {k} here".encode(), trained, secrets.Rule()) for k in keys]
    assert sum([kind for _, kind, _ in spans] == ["random"] for spans in found) >= 198


@pytest.mark.parametrize("beside", ["NAME=", "path/to/the/place/of/", "in_the_other_environment_it_is_the_", "thereisnothinginthispartofthename="])
def test_ordinary_part_does_not_hide_a_key(trained, beside):
    key = "q7ZpX2mKd9RtV4bYw8HsLc3N"
    text = f"set {beside}{key}/{beside}end there"
    spans = secrets.find(text.encode(), trained, secrets.Rule())
    assert any(kind == "random" and key in text[a:b] for a, kind, b in spans)
    assert secrets.find(f"set {beside}{beside}end there".encode(), trained, secrets.Rule()) == []


PLANTED = {
    "alone": lambda key, rng: ("use ", " here"),
    "before an assignment": lambda key, rng: ("see ", "/token=abcdef end"),
    "before hex": lambda key, rng: ("x ", "_" + "".join(rng.choice("0123456789abcdef") for _ in range(24)) + " y"),
    "named by a key": lambda key, rng: ("", "=secret=abcdef"),
    "credential pair": lambda key, rng: ("AKIA" + "".join(rng.choice(string.ascii_uppercase + string.digits) for _ in range(16)) + "/", " z"),
}


@pytest.mark.parametrize("form", PLANTED)
def test_keys_beside_fixed_spans_are_found_whole(trained, form):
    rng, found = random.Random(form), 0
    for _ in range(200):
        key = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40))
        before, after = PLANTED[form](key, rng)
        spans = secrets.find((before + key + after).encode(), trained, secrets.Rule())
        marked = set().union(*(range(a, b) for a, _, b in spans))
        found += set(range(len(before), len(before) + 40)) <= marked
        ordered = [s for s in spans if s[1] == "random"]
        assert all(b <= c or d <= a for a, _, b in ordered for c, kind, d in spans if kind != "random")
    assert found >= 190


def test_time_grows_with_the_text(trained):
    import time

    rng = random.Random(4)
    words = ["token=abcdef12" if i % 2 else "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(24)) for i in range(100_000)]
    start = time.process_time()
    spans = secrets.find(" ".join(words).encode(), trained, secrets.Rule())
    assert len(spans) > 95_000 and time.process_time() - start < 60
