"""Against the tokenizers library, on odd texts, chunks of any size and very long pieces."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from agentmeter.llm import bpe, queries

SIGNS = ["a", "b", " ", "  ", "\n", "\t", "'", "'s", "'re", "'l", "l", "1", "²", "é", "日", "ʰ", "́", "!", "=", "the"]
SIGNS += ["<|endoftext|>", "<|endo", "ing", " ", "\x1c", "😀", "՘", "٣", "r", "e", "v", "İ"]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(bpe.default_path())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def ids_of(text, chunk=bpe.CHUNK):
    return np.frombuffer(bpe.encoder(bpe.default_path()).encode(text, chunk), np.int32).tolist()


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, bpe.CHUNK])
def test_any_chunks_give_the_ids_of_the_whole(library, chunk):
    some = random.Random(chunk)
    for _ in range(1000):
        text = "".join(some.choice(SIGNS) for _ in range(some.randrange(40)))
        assert ids_of(text, chunk) == library.encode(text, add_special_tokens=False).ids, text


def test_long_pieces_are_merged_in_windows(library):
    some = random.Random(5)
    alphabets = [["a"], ["a", "b"], [" "], ["=", "-"], list("theing"), list("aeioustrnl"), [" ", "\n"], ["0", "1"], ["é", "è"]]
    for k in range(90):
        body = "".join(some.choice(alphabets[k % 9]) for _ in range(some.randrange(200, 6000)))
        text = some.choice(["x ", " ", "", "'"]) + body + some.choice(["", " y", "b", "\n"])
        want = library.encode(text, add_special_tokens=False).ids
        assert ids_of(text, 100) == ids_of(text, 1000) == ids_of(text) == want


def test_ids_before_the_lookahead_do_not_depend_on_what_follows():
    merges, some = bpe.encoder(bpe.default_path()).merges, random.Random(7)
    assert max(map(len, merges.bytes)) <= merges.lookahead < 1000
    for _ in range(300):
        same = "".join(some.choice("theingaou") for _ in range(600)).encode()
        ends = []
        for follows in (b"", b"tion", b"aaaa", b"ing" * 30):
            at, kept = 0, []
            for i in merges.merge(same + follows):
                at += len(merges.bytes[i])
                if at <= len(same) - merges.lookahead:
                    kept.append(i)
            ends.append(kept)
        assert ends[0] == ends[1] == ends[2] == ends[3]


def test_a_window_holds_a_bounded_state():
    window = bpe.Window(bpe.encoder(bpe.default_path()).merges)
    most, given = 0, 0
    for _ in range(200):
        given += len(window.push(b"abcd" * 500))
        most = max(most, len(window.held))
    assert given > 0 and most <= window.merges.lookahead + bpe.STEP


def test_decoding_is_incremental_and_replaces_broken_bytes(library):
    machine = bpe.Decoder(bpe.encoder(bpe.default_path()).merges)
    some = random.Random(9)
    for _ in range(300):
        ids = [some.choice([some.randrange(50257), some.randrange(256), 50256]) for _ in range(12)]
        said = "".join(machine.feed([i]) for i in ids) + machine.feed([], True)
        assert said == library.decode(ids, skip_special_tokens=False), ids
    assert machine.feed([None, 60_000, -1], True) == ""


def test_odd_rows(spark, make_documents, odd, library):
    rows = bpe.decode(bpe.encode(make_documents(odd))).collect()
    got = sorted((repr((r.doc_id, list(r.ids), r.text)) for r in rows))
    assert got == sorted(repr((i, library.encode(x or "", add_special_tokens=False).ids, x or "")) for i, x in odd)
    none = bpe.digests(bpe.decode(bpe.encode(make_documents([]))))
    assert none.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and none.count() == 0
    given = spark.createDataFrame([(1, [None, 15496, 99_999]), (2, None)], "doc_id long, ids array<int>")
    assert [r.text for r in bpe.decode(given).orderBy("doc_id").collect()] == ["Hello", ""]


def test_query_equals_the_library(spark, library):
    import hashlib

    directory = "/root/testdata/sf0.001"
    want = []
    for r in spark.read.parquet(f"{directory}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("t")).collect():
        ids = library.encode(r.t, add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()))
    assert sorted(map(tuple, queries.op11_bpe(spark, directory).collect())) == sorted(want)
