import random
import time
from itertools import combinations

import corpus_pipeline
from agentmeter.llm import nearcopies, simhash


def shingle_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(rows):
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = {i: shingle_set(x) for i, x in rows}
    for a, b in combinations(sorted(root), 2):
        both = len(sets[a] & sets[b])
        if sets[a] == sets[b] or 9 * both >= 4 * (len(sets[a]) + len(sets[b])):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in root}


def planted():
    """Texts of 200 words with one to ten words changed, others that share only a long passage, and lengths about the bound."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    rows, passage = [], [word() for _ in range(120)]
    for _ in range(12):
        base = [word() for _ in range(200)]
        rows.append(" ".join(base))
        for changed in (1, 2, 3, 4, 5, 6, 8, 10):
            copy = list(base)
            for at in rng.sample(range(200), changed):
                copy[at] = word()
            rows.append(" ".join(copy))
        rows.append(" ".join(base[:164]))
        rows.append(" ".join(base[:160]))
    rows += [" ".join(passage + [word() for _ in range(n)]) for n in range(5, 60, 3) for _ in range(2)]
    return list(enumerate(rows, 1))


def test_groups_are_those_of_all_pairs(make_documents):
    rows = planted()
    found = {r.doc_id: r.component_id for r in nearcopies.groups(make_documents(rows)).collect()}
    assert found == brute_groups(rows)


def test_common_shingles_change_no_group(make_documents, monkeypatch):
    rows = planted()
    monkeypatch.setattr(nearcopies, "OFTEN", 10**6)
    found = {r.doc_id: r.component_id for r in nearcopies.groups(make_documents(rows)).collect()}
    assert found == brute_groups(rows)


def test_stage_drops_copies_with_a_few_changed_words(spark, make_documents):
    rows = planted()
    kept = corpus_pipeline.drop_near_copies(spark, make_documents(rows), "").collect()
    assert {r.doc_id for r in kept} == set(brute_groups(rows).values())


def test_odd_rows_and_none(make_documents, odd):
    docs = make_documents(odd)
    kept = nearcopies.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 4, 6, 7, None]
    assert nearcopies.one_of_each(make_documents([])).collect() == []


def test_versions_of_one_text_do_not_all_meet(make_documents, monkeypatch):
    """160 versions of a text, each with five words of its own: most pairs are below 0.8, some above."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    base, rows = [word() for _ in range(160)], []
    for k in range(160):
        copy = list(base)
        for at in rng.sample(range(160), 2 if k % 40 == 0 else 5):
            copy[at] = word()
        rows.append((k + 1, " ".join(copy)))
    beside, compared = nearcopies._beside, []

    def counted(pairs, sets):
        compared.append(pairs.distinct().count())
        return beside(pairs, sets)

    monkeypatch.setattr(nearcopies, "_beside", counted)
    found = {r.doc_id: r.component_id for r in nearcopies.groups(make_documents(rows)).collect()}
    assert found == brute_groups(rows)
    assert len(set(found.values())) > 20
    assert max(compared) < 160 * 159 // 2 // 5


def test_pairs_that_fingerprints_link_come_first(make_documents, monkeypatch):
    rows = planted()
    links, given = simhash.links, []

    def watched(prints):
        out = links(prints)
        given.append((prints.count(), out.count()))
        return out

    monkeypatch.setattr(simhash, "links", watched)
    found = {r.doc_id: r.component_id for r in nearcopies.groups(make_documents(rows)).collect()}
    assert found == brute_groups(rows)
    assert len(given) == 1 and given[0][0] > 100 and given[0][1] > 0


def test_differences_from_a_larger_hub_are_cut_before_they_are_rows(make_documents, monkeypatch):
    """A long text and a hundred passages of it hang together; each passage differs from the long text in nearly all of it."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    long = [word() for _ in range(3000)]
    rows = [(1, " ".join(long))] + [(k + 2, " ".join(long[30 * k : 30 * k + 30])) for k in range(100)]
    changed = list(long[:30])
    changed[29] = word()
    rows.append((102, " ".join(changed)))
    land, held = nearcopies.land, []

    def watched(df, name):
        out = land(df, name)
        if name == "differences":
            arrays = [c for c, kind in out.dtypes if kind.startswith("array")]
            held.append((out.count(), sum(len(r[c]) for r in out.collect() for c in arrays)))
        return out

    monkeypatch.setattr(nearcopies, "land", watched)
    found = {r.doc_id: r.component_id for r in nearcopies.groups(make_documents(rows)).collect()}
    assert found == brute_groups(rows)
    (sets, kept), sizes = held[0], sum(len(shingle_set(x)) for _, x in rows)
    assert sets > 50
    assert kept <= sizes


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}


def test_shuffles_of_earlier_queries_leave_the_disk(spark, make_documents):
    before = shuffle_files(spark)
    nearcopies.groups(make_documents(planted()[:30]))
    end = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.5)
    assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_pairs_of_a_large_group_are_compared_in_slices(make_documents, monkeypatch):
    """120 versions of a text, most pairs just below 0.8; what lies beside the pairs at once follows the sets."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    base, rows = [word() for _ in range(160)], []
    for k in range(120):
        copy = list(base)
        for at in rng.sample(range(0, 160, 8), 4):
            copy[at] = word() if k % 3 else base[at][::-1]
        rows.append((k + 1, " ".join(copy)))
    monkeypatch.setattr(nearcopies, "AT_ONCE", 1, raising=False)
    beside, given = nearcopies._beside, []

    def watched(pairs, sets):
        given.append((pairs.count(), sets.count()))
        return beside(pairs, sets)

    monkeypatch.setattr(nearcopies, "_beside", watched)
    found = {r.doc_id: r.component_id for r in nearcopies.groups(make_documents(rows)).collect()}
    assert found == brute_groups(rows)
    assert sum(pairs for pairs, _ in given) > 240
    assert all(pairs <= 2 * sets for pairs, sets in given)
