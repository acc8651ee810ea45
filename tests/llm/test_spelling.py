"""Against deletion neighbourhoods in Python."""

import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import pytest

from agentmeter.llm import spelling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 5
    return {w: k for w, k in n.items() if k >= 3}


def links(words):
    buckets, near = defaultdict(set), defaultdict(set)
    for w in words:
        for k in range(len(w)):
            buckets[w[:k], w[k + 1 :]].add(w)
            less = w[:k] + w[k + 1 :]
            if less in words:
                near[w].add(less)
                near[less].add(w)
    for bucket in buckets.values():
        for w in bucket:
            near[w] |= bucket - {w}
    return near


def brute(rows):
    n = counted(rows)
    near, form = links(n), {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, n[w], form.get(w), n.get(form.get(w)), len(near[w]), root(w)) for w in n)


def plain(df):
    return sorted(tuple(r[c] for c in ("word", "n", "form", "form_n", "n_near", "root")) for r in df.collect())


@pytest.mark.parametrize("most", [1, 20, spelling.MOST])
def test_equals_brute_force(spark, make_documents, most):
    some = random.Random(most)
    vocabulary = ["".join(some.choice("abÀé÷") for _ in range(some.randrange(4, 9))) for _ in range(300)]
    rows = [(i, some.choice(" .1_").join(some.choice(vocabulary[: 1 + some.randrange(300)]) for _ in range(60))) for i in range(80)]
    rows += [(i, (x or "").upper()) for i, x in rows[:20]]
    want = brute(rows)
    assert len(want) > 150 and any(w[2] for w in want)
    assert plain(spelling.variants(make_documents(rows), most=most)) == want


def test_odd_rows(spark, make_documents, odd):
    rows = odd + [(None, "Chain chain chain chains chains chains chains chains chains")] * 2 + [(1, "naïve naïve naïve NAÏVE naive")] * 4
    assert plain(spelling.variants(make_documents(rows))) == brute(rows)
    assert plain(spelling.variants(make_documents([]))) == []
    assert plain(spelling.variants(make_documents([(1, None), (2, "")]))) == []


def test_chains_of_forms_end_at_their_root(spark):
    words = ["aaaaa" + "b" * k for k in range(20)]
    forms = spark.createDataFrame([(w, v) for w, v in zip(words, words[1:] + [None], strict=True)], "word string, form string")
    found = {r.word: r.root for r in spelling.rooted(forms).collect()}
    assert found == {w: words[-1] for w in words[:-1]}


def test_acceptors_are_minimal_and_pairs_come_once():
    state = spelling.minimised(["abx", "aby", "cbx", "cby"])
    assert len({id(s) for _, s in state[1]}) == 1
    some = random.Random(2)
    for _ in range(200):
        size = some.choice([1, 2, 3, 4])
        pick = lambda k, n: sorted({"".join(some.choice("abc") for _ in range(k)) for _ in range(n)})
        short, long = pick(size, some.randrange(1, 20)), pick(size + 1, some.randrange(30))
        want = [(a, b) for i, a in enumerate(short) for b in short[i + 1 :] if sum(x != y for x, y in zip(a, b, strict=True)) == 1]
        want += [(a, b) for a in short for b in long if any(b[:k] + b[k + 1 :] == a for k in range(len(b)))]
        assert sorted(spelling.near_pairs(short, long, True)) == sorted(want)


def test_very_long_words(spark):
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1 << 16))
    word = "ab" * 10_000
    given = [word, word[:-1], "c" + word[1:], word + "z", word[:5000] + "q" + word[5001:], "short"]
    words = spark.createDataFrame([(w, i) for i, w in enumerate(given)], "word string, n long")
    found = {r.word: r.n_near for r in spelling.nearest(words).collect()}
    assert found == {w: len(v) for w, v in links(set(given)).items() if v}
    wide = sorted({"a" * k + "b" + "a" * (1500 - k) for k in range(0, 1500, 3)} | {"a" * 1501})
    assert len(list(spelling.near_pairs(wide, [], True))) == len(wide) - 1
