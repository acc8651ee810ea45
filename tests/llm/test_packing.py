import random
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from agentmeter.llm import packing, tokens


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.default_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library(library):
    encoder, rng = tokens.Encoder(tokens.default_path()), random.Random(2)
    signs = "abzAZ019 \t\n'sdmtrevl.,!?-_éßÄ½²\x85\xa0\x1c\x00İΣ日ſ"
    texts = [chr(b).join(pair) for b in range(256) for pair in ("ab", "1 ", "!'")]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts += ["<|endoftext|> a", "x<|startoftext|>", ""]
    for text in texts:
        got = np.frombuffer(encoder.encode(text.encode()), "<u4").tolist()
        assert got == ids_of(library, text), repr(text)


def test_forgetting_pieces_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(tokens, "PIECES", 3)
    encoder = tokens.Encoder(tokens.default_path(), 2)
    text = "one two three four five two one"
    assert np.frombuffer(encoder.encode(text.encode()), "<u2").tolist() == ids_of(library, text)
    assert len(encoder.pieces) <= 3


def test_special_strings_as_text():
    plain = tokens.Encoder(tokens.default_path(), 2, plain=True)
    assert 49407 not in np.frombuffer(plain.encode(b"a <|endoftext|> b"), "<u2")


def test_best_fit_decreasing():
    rng = random.Random(4)
    for _ in range(200):
        lengths = [rng.randint(1, 64) for _ in range(rng.randint(0, 60))]
        rooms, want = [], {}
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            room = min((r for r in rooms if r >= lengths[i]), default=None)
            if room is None:
                rooms.append(room := 64)
            rooms.remove(room)
            rooms.append(room - lengths[i])
            want[i] = 64 - room
        spots = packing.place(lengths, 64)
        assert [offset for _, offset in spots] == [want[i] for i in range(len(lengths))]
        used = defaultdict(int)
        for (window, offset), length in sorted(zip(spots, lengths, strict=True)):
            assert offset == used[window]
            used[window] += length
        assert all(n <= 64 for n in used.values()) and len(used) == len(rooms)


def check(library, rows, pieces, window=4096):
    left = defaultdict(list)
    for i, text in rows:
        left[i].append(ids_of(library, text) + [2])
    sequences = defaultdict(list)
    chains = defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length <= window
        sequences[p.sequence_id].append((p.offset, p.length, p.padded_to))
        chains[p.doc_id].append((p.start, ids, p.doc_tokens))
    for key, want in left.items():
        got = sorted(chains.pop(key))
        assert sorted(sum((ids for _, ids, _ in got), [])) == sorted(sum(want, []))
        if len(want) == 1:
            at = 0
            for start, ids, total in got:
                assert (start, total) == (at, len(want[0])) and ids == want[0][at : at + len(ids)]
                at += len(ids)
    assert not chains
    for parts in sequences.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert {p[2] for p in parts} == {at if at & (at - 1) == 0 else window}


def test_odd_documents(make_documents, library, odd):
    pieces = packing.pack(make_documents(odd).repartition(3)).collect()
    check(library, odd, pieces)
    assert any(p.doc_tokens > 3 * 4096 for p in pieces)


def test_blocks(make_documents, library, monkeypatch):
    rows = [(i, "word " * (i % 40)) for i in range(200)]
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 300)
    packed = packing._packer(tokens.default_path(), 2, 16)
    pieces = make_documents(rows).selectExpr("doc_id AS key", "cast(text AS binary) AS body").mapInArrow(
        packed,
        "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, padded_to long",
    )
    check(library, rows, pieces.collect(), 16)


def test_empty(make_documents):
    assert packing.pack(make_documents([])).collect() == []


def test_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pieces = packing.digests(packing.pack(docs))
    total, sequences = pieces.selectExpr("sum(length)", "count(distinct sequence_id)").first()
    assert total / (sequences * 4096) > 0.99


def test_other_stages_start_without_the_encoder():
    from agentmeter.llm import common, tokens

    tokens.encoder(tokens.default_path())
    list(common.tidy(iter, keep=True)([1]))
    held = tokens.encoder.cache_info().currsize
    list(common.tidy(iter)([1]))
    assert (held, tokens.encoder.cache_info().currsize) == (1, 0)
