import re

import pytest

from agentmeter.llm import decontaminate


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute(text, items):
    mine, hit, names = words(text), set(), set()
    for name, item in items:
        w = words(item)
        width = min(10, len(w))
        for k in range(len(w) - width + 1 if w else 0):
            for at in range(len(mine) - width + 1):
                if mine[at : at + width] == w[k : k + width]:
                    hit.update(range(at, at + width))
                    names.add(str(name))
    return len(mine), len(hit), sorted(names)


PASSAGE = "The quick brown fox jumps over the lazy dog while seven wizards brew a strong potion"
ITEMS = [(1, PASSAGE), (2, "short ITEM"), (10, "short item"), (3, None), (4, ""), (5, " ... "), (None, "never used here"), (6, "Größe ist alles")]
DOCS = [
    (20, f"before {PASSAGE.upper()}, after"),
    (21, "the quick brown fox jumps over the lazy dog"),
    (22, "x the-quick,brown\nfox jumps over the lazy dog while seven y " + PASSAGE),
    (23, "a short item and a short. ITEM"),
    (24, "GRÖßE ist alles; größe ist alles"),
    (25, "never used here"),
    (26, "short item"),
]


@pytest.fixture
def benchmark(spark):
    return spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id long, text string, spans string")


def test_scan(make_documents, benchmark, odd):
    rows = DOCS + odd
    found = decontaminate.scan(make_documents(rows), benchmark).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found), key=repr)
    assert got == sorted(((i, *brute(x, [t for t in ITEMS if t[0] is not None])) for i, x in rows), key=repr)
    for r in found:
        assert r.n_hit == sum(s.end - s.start for s in r.spans)


def test_slices_agree_with_one_broadcast(make_documents, benchmark, monkeypatch):
    docs = make_documents(DOCS)
    whole = sorted(map(str, decontaminate.scan(docs, benchmark).collect()))
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 60)
    assert len(decontaminate._slices(benchmark, "item_id", "text")) > 2
    assert sorted(map(str, decontaminate.scan(docs, benchmark).collect())) == whole


def test_remove(make_documents, benchmark, odd):
    docs = make_documents(DOCS + odd)
    kept = decontaminate.remove(docs, benchmark)
    assert kept.columns == docs.columns
    rows = {r.doc_id: r for r in kept.collect()}
    assert 26 not in rows
    assert rows[20].text == "before , after" and rows[20].n_chars == len("before , after")
    assert rows[23].text == "a  and a "
    assert rows[21].text == DOCS[1][1] and rows[1].text is None and rows[2].text == ""
    assert not any(r.n_hit for r in decontaminate.scan(kept, benchmark).collect())


def test_empty(make_documents, benchmark):
    none = benchmark.limit(0)
    assert decontaminate.scan(make_documents([]), benchmark).collect() == []
    assert [r.n_hit for r in decontaminate.scan(make_documents(DOCS[:1]), none).collect()] == [0]
    assert decontaminate.remove(make_documents(DOCS), none).count() == len(DOCS)


def test_equal_hashes_are_told_apart(monkeypatch):
    import numpy as np

    monkeypatch.setattr(decontaminate, "_hashes", lambda ids: np.zeros(len(ids), np.uint64))
    windows = decontaminate.Windows([(str(i), t.encode()) for i, t in [(1, PASSAGE), (2, "short item")]])
    for text in (PASSAGE, "a short item", "item short", "dog " + PASSAGE):
        spans, items = windows.scan(words_of(text))
        _, n_hit, names = brute(text, [(1, PASSAGE), (2, "short item")])
        assert sorted(items) == names
        assert len({k for a, b in spans.tolist() for k in range(a, b)}) == n_hit


def words_of(text):
    from agentmeter.llm.common import words

    return words(text.encode())
