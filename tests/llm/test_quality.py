import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from agentmeter.llm import quality

CLASSES, ORDER = quality.CLASSES, quality.ORDER


def brute_model(texts):
    """Probability of a sign after a context, straight from the counts."""
    top = Counter()
    for text in texts:
        signs = [0] * (ORDER - 1) + quality.classes(text.encode()).tolist()
        top.update(tuple(signs[k : k + ORDER]) for k in range(len(signs) - ORDER + 1))
    counts = {ORDER: top}
    for order in range(ORDER - 1, 0, -1):
        counts[order] = Counter(g[1:] for g in counts[order + 1])
    discounts = {}
    for order, table in counts.items():
        n = Counter(table.values())
        n1 = max(n[1], 1e-9)
        y = n1 / (n1 + 2 * n[2])
        fair = {}
        for k in (1, 2, 3):
            below = {1: n1}.get(k, n[k])
            d = k - (k + 1) * y * n[k + 1] / below if below else None
            fair[k] = d if d is not None and 0 < d <= k else {1: 0.5, 2: 0.75, 3: 0.9}[k]
        discounts[order] = fair
    follow = defaultdict(dict)
    for table in counts.values():
        for gram, n in table.items():
            follow[gram[:-1]][gram[-1]] = n

    def p(context, sign):
        if context not in follow:
            return p(context[1:], sign)
        seen = follow[context]
        total, d = sum(seen.values()), discounts[len(context) + 1]
        cut = lambda n: d[min(n, 3)]
        left = sum(cut(n) for n in seen.values()) / total
        lower = p(context[1:], sign) if context else 1 / CLASSES
        return (max(seen[sign] - cut(seen[sign]), 0) / total if sign in seen else 0) + left * lower

    return p


TRUSTED = ["The cat sat on the mat.", "A dog, a log and a frog!", "the then there these", "Zwölf Boxkämpfer jagen 99 Eulen"] * 3


@pytest.fixture(scope="module")
def model(spark):
    rows = spark.createDataFrame([(x, "en") for x in TRUSTED] + [(None, "en"), ("", "en"), ("été", None)], "text string, lang string")
    return quality.train(rows)


def test_model_is_kneser_ney(model):
    p = brute_model([*TRUSTED, ""])
    rows = model.where("lang = 'en'").collect()
    assert {r.size for r in rows} == set(range(ORDER))
    for r in rows[:: max(1, len(rows) // 60)]:
        context, left = [], r.context
        for _ in range(r["size"]):
            context.insert(0, left % CLASSES)
            left //= CLASSES
        got = np.exp2(np.array(r.logs, float))
        assert math.isclose(got.sum(), 1, rel_tol=1e-5)
        want = [p(tuple(context), s) for s in range(CLASSES)]
        np.testing.assert_allclose(got, want, rtol=2e-5)


@pytest.mark.parametrize("rows", [1 << 16, 40])
def test_bits_of_texts(spark, model, monkeypatch, rows):
    monkeypatch.setattr(quality, "SHARD_CONTEXTS", rows)
    shards = quality.shards(model)
    assert (len(shards) > 3) == (rows == 40)
    p = brute_model([*TRUSTED, ""])
    texts = ["the cat", "xyzzy 日本", "", None, "A dog, a dog!\n" * 50]
    docs = spark.createDataFrame([(i, x, "en") for i, x in enumerate(texts)], "doc_id int, text string, lang string")
    for r in quality._scored(docs, shards, "text", "lang").collect():
        signs = [0] * (ORDER - 1) + quality.classes((texts[r["row"]["c0"]] or "").encode()).tolist()
        want = -sum(math.log2(p(tuple(signs[k - ORDER + 1 : k]), signs[k])) for k in range(ORDER - 1, len(signs)))
        assert r.signs == len(signs) - ORDER + 1 and math.isclose(r.bits, want, rel_tol=1e-4, abs_tol=1e-9)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_junk_goes_and_clean_text_stays(spark):
    directory = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{directory}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.classify(docs, labels).join(labels, "doc_id").groupBy("quality", "accepted").count().collect()
    n = {(r.quality, r.accepted): r["count"] for r in found}
    assert n.get((1, False), 0) / (n[1, False] + n[1, True]) < 0.01
    assert n[0, False] / (n[0, False] + n[0, True]) > 0.7


def test_odd_rows(spark, make_documents, odd):
    plain = [(i, f"the cat {i} sat on the mat and the dog saw it") for i in range(100, 160)]
    rows = [*odd, *plain, (200, "### $$$ %%% *** @@@ ^^^ &&& ((( )))" * 9), (201, "quoi", "fr"), (202, "x", None)]
    docs = make_documents(rows)
    labels = labels_of(spark, [(i, 1, 0) for i, _ in plain] + [(150, 1, 1), (None, 1, 0), (999, 1, 0), (1, None, None), (2, 0, 0)])
    found = {}
    for r in quality.classify(docs, labels).collect():
        found.setdefault(r.doc_id, r)
    assert len(found) == len({r[0] for r in rows})
    assert found[1].perplexity is None and found[1].accepted
    assert not found[200].accepted and found[201].accepted and found[202].accepted
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 200 not in ids and ids.count(7) in (0, 2) and {1, 2, 201, 202, 110} <= set(ids)


def test_nothing_to_learn_from(spark, make_documents, odd):
    none = labels_of(spark, [])
    assert all(r.accepted for r in quality.classify(make_documents(odd), none).collect())
    assert quality.classify(make_documents([]), none).collect() == []


def test_many_ids_are_joined_by_a_shuffle(spark, make_documents, monkeypatch):
    rows = [(i, f"the cat {i} sat on the mat") for i in range(50)]
    labels = labels_of(spark, [(i, 1, 0) for i in range(50)])
    few = sorted(quality.classify(make_documents(rows), labels).collect())
    monkeypatch.setattr(quality, "BROADCAST_IDS", 3)
    many = sorted(quality.classify(make_documents(rows), labels).collect())
    assert [r.accepted for r in few] == [r.accepted for r in many]
    np.testing.assert_allclose([r.perplexity for r in few], [r.perplexity for r in many])


def test_far_letters_are_told_apart(spark, make_documents):
    plain = [(i, f"日本語の文章はここに {i} あります。", "ja") for i in range(60)]
    shifted = "".join(chr(ord(c) + 34) if ord(c) > 0x3040 else c for c in plain[0][1])
    assert quality.classes(shifted.encode()).tolist() != quality.classes(plain[0][1].encode()).tolist()
    labels = labels_of(spark, [(r[0], 1, 0) for r in plain])
    found = {r.doc_id: r for r in quality.classify(make_documents([*plain, (100, shifted * 9, "ja")]), labels).collect()}
    assert found[100].perplexity > 2 * max(found[r[0]].perplexity for r in plain)
    assert not found[100].accepted


def test_model_and_texts_meet_by_shuffles(spark, model, make_documents, odd, monkeypatch):
    def bits():
        rows = quality._scored(make_documents(odd), quality.shards(model), "text", "lang").collect()
        return sorted((str(r["row"]["c0"]), r.body or "", r.signs, round(r.bits, 3)) for r in rows)

    assert all(isinstance(shard, type(model)) for shard in quality.shards(model))
    whole = bits()
    assert sorted((str(i), x or "") for i, x in odd) == [r[:2] for r in whole]
    monkeypatch.setattr(quality, "BLOCK_BYTES", 1 << 10)
    monkeypatch.setattr(quality, "SHARD_CONTEXTS", 40)
    assert bits() == whole
