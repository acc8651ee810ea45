"""Forests of parent links against plain walks."""

import random

import pytest

from agentmeter.operators import ancestry, codex

LINKS, CALLS = "session string, parent string", "session string, call_id string"


def walk(links, session):
    seen, at = [], links.get(session)
    while at is not None and at not in seen and at != session:
        seen.append(at)
        at = links.get(at)
    return seen, at is not None


def brute(links, calls):
    owned, found = set(calls), []
    for session, call in owned:
        above, endless = walk(links, session)
        if not endless:
            hit = next((a for a in above if (a, call) in owned), None)
            if hit is not None:
                found.append((call, session, hit))
    return sorted(found)


def inherited(spark, links, calls):
    rows = codex.inherited_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(list(links.items()), LINKS))
    return sorted(map(tuple, rows.collect()))


@pytest.mark.parametrize("seed", range(3))
def test_nearest_owner_of_random_forests(spark, seed):
    rnd = random.Random(seed)
    links = {f"n{k}": f"n{rnd.randrange(max(1, k - 12), k) if rnd.random() < 0.7 else 0}" for k in range(2, 120) if rnd.random() < 0.95}
    links |= {"c1": "c2", "c2": "c3", "c3": "c1", "below": "c2", "self": "self", "n0": "elsewhere"}
    calls = [(rnd.choice([*links, "n0", "n1"]), rnd.choice("abcd")) for _ in range(150)]
    calls += [("c1", "a"), ("c2", "a"), ("below", "a"), ("self", "a")]
    want = brute(links, calls)
    assert len(want) > 20 and inherited(spark, links, calls) == want


def test_intervals_nest_as_the_links_do(spark):
    links = {f"n{k}": f"n{(k - 1) // 3}" for k in range(1, 40)}
    forest = ancestry.climb(spark.createDataFrame(list(links.items()), LINKS))
    spans = {r.node: (r.first, r.size) for r in ancestry.intervals(forest).collect()}
    assert sorted(first for first, _ in spans.values()) == list(range(40))
    for node, (first, size) in spans.items():
        below = {n for n in spans if node in walk(links, n)[0]} | {node}
        assert {n for n, (at, _) in spans.items() if first <= at < first + size} == below


def test_a_chain_of_ten_thousand_takes_as_many_rounds_as_its_logarithm(spark):
    links = {f"s{k}": f"s{k - 1}" for k in range(1, 10_000)}
    forest = ancestry.climb(spark.createDataFrame(list(links.items()), LINKS))
    assert len(forest.jumps) == 14 and forest.cyclic.isEmpty()
    calls = [(f"s{k}", "every") for k in range(0, 10_000, 7)] + [("s0", "ends"), ("s9999", "ends"), ("s3", "once")]
    got = inherited(spark, links, calls)
    assert len(got) == 1429 and ("ends", "s9999", "s0") in got
    assert all(int(up[1:]) == int(s[1:]) - 7 for call, s, up in got if call == "every")


def test_no_links_and_no_calls(spark):
    assert inherited(spark, {}, [("s", "c"), ("t", "c")]) == []
    assert inherited(spark, {"s": "t"}, []) == []
    assert ancestry.climb(spark.createDataFrame([], LINKS)).nodes.count() == 0
