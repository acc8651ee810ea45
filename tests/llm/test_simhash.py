import re
from itertools import combinations

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from agentmeter.llm import simhash
from agentmeter.llm.components import components


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_groups(prints):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= 2:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in prints}


@given(st.text(alphabet="abAB \n\té\x85\xa0日", max_size=40))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) & (1 << 64) - 1 == brute(text)


def signed(p):
    return p - (1 << 64) if p >> 63 else p


def test_links_connect_just_what_is_within_two_bits(spark):
    base = 0x8123456789ABCDEF
    prints = {base, 0, 1 << 63, 3, (1 << 64) - 1, base ^ 7, base ^ 0xFFFF}
    # Every pair of bits flipped, over all segment borders, and a chain of steps of two bits.
    prints |= {base ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(a, 64, 5)}
    step = 0x0F0F0F0F0F0F0F0F
    for k in range(0, 40, 2):
        prints.add(step := step ^ (3 << k))
    df = spark.createDataFrame([(signed(p),) for p in prints], "fingerprint long")
    links = [(a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in simhash.links(df).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in links)
    roots = {r.node & (1 << 64) - 1: r.root for r in components(simhash.links(df)).collect()}
    want = brute_groups(prints)
    for a, b in combinations(sorted(prints), 2):
        assert (roots.get(a, a) == roots.get(b, b)) == (want[a] == want[b])


def test_groups_of_odd_rows(make_documents, odd):
    found = simhash.groups(make_documents(odd)).collect()
    assert len(found) == len(odd)
    want = brute_groups({brute(x) for _, x in odd})
    for r in found:
        mine = {brute(x) for i, x in odd if i == r.doc_id}
        assert int(r.fingerprint, 16) in mine and len(r.fingerprint) == 16
        group = [i for i, x in odd if i is not None and want[brute(x)] == want[int(r.fingerprint, 16)]]
        assert r.component_id == (min(group) if group else None)
    assert {r.component_id for r in found if r.doc_id in (1, 2, 3)} == {1}


def test_one_of_each_keeps_columns_and_the_smallest_id(make_documents, odd):
    docs = make_documents(odd)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == [1, 4, 6, 7, None]


def test_empty(make_documents):
    docs = make_documents([])
    assert simhash.groups(docs).collect() == [] and simhash.one_of_each(docs).collect() == []


def test_long_chains_meet(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(5, 5), (None, 1), (9, 8)], "a long, b long")
    assert {(r.node, r.root) for r in components(links).collect()} == {(i, 0) for i in range(301)}


@pytest.mark.parametrize("text", ["a b c d e", "a b", ""])
def test_short_texts_are_one_shingle(text):
    assert simhash.fingerprint(text.encode()) & (1 << 64) - 1 == brute(text)
