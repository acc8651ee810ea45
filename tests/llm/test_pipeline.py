import pytest

import corpus_pipeline
from agentmeter.llm import decontaminate, queries, secrets

DIRECTORY = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows that each stage returns, by name, and those it was given."""
    from agentmeter.llm.common import land, table

    docs, out = table(spark, DIRECTORY, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        new = land(stage(spark, docs, DIRECTORY), name)
        out[name] = docs, new
        docs = new
    return out


def test_columns(stages):
    for name, (before, after) in stages.items():
        if name != "packing":
            assert after.columns == before.columns


def test_quality_keeps_clean_documents(spark, stages):
    _, after = stages["quality"]
    labels = spark.read.parquet(f"{DIRECTORY}/labels.parquet")
    kept = {r.doc_id for r in after.collect()}
    clean = [r.doc_id for r in labels.where("quality = 1").collect()]
    junk = [r.doc_id for r in labels.where("quality = 0").collect()]
    assert sum(i in kept for i in clean) / len(clean) > 0.97
    assert sum(i in kept for i in junk) / len(junk) < 0.3


def test_one_document_of_each_group_stays(stages):
    """Groups are linked by a Jaccard similarity of 0.8 or more of sets of five-word shingles."""
    before, after = stages["near_copies"]
    rows = {r.doc_id: (r.text or "").encode() for r in before.collect()}
    sets, holders = {}, {}
    for i, body in rows.items():
        words = body.lower().split()
        width = min(5, len(words))
        sets[i] = frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1)) if words else frozenset()
        for shingle in sets[i]:
            holders.setdefault(shingle, []).append(i)
    root = {i: i for i in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, mine in sets.items():
        near = {j for shingle in mine for j in holders[shingle] if j < i} or {j for j in rows if not mine and not sets[j] and j < i}
        for j in near:
            both = len(mine & sets[j])
            if not mine or 5 * both >= 4 * (len(mine) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    assert sorted(r.doc_id for r in after.collect()) == sorted(i for i in rows if top(i) == i)


def test_no_window_and_no_secret_is_left(spark, stages):
    before, after = stages["benchmarks"]
    benchmark = spark.read.parquet(f"{DIRECTORY}/benchmark.parquet")
    assert decontaminate.scan(after, benchmark).where("n_hit > 0").count() == 0
    hit = {r.doc_id for r in decontaminate.scan(before, benchmark).where("n_hit > 0").collect()}
    texts = {r.doc_id: r.text for r in before.collect()}
    assert all(r.text == texts[r.doc_id] for r in after.collect() if r.doc_id not in hit)
    _, clean = stages["secrets"]
    assert not any(secrets.base((r.text or "").encode()) for r in clean.collect())


def test_packing_holds_every_document(stages):
    before, after = stages["packing"]
    assert {r.doc_id for r in after.select("doc_id").distinct().collect()} == {r.doc_id for r in before.collect()}
    lengths = after.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert all(r["sum(length)"] == r["max(doc_tokens)"] for r in lengths)


def test_run_is_the_stages(spark, stages):
    _, last = stages["packing"]
    digest = lambda df: sorted((r.doc_id, r.start, r.length, bytes(r.ids)) for r in df.collect())
    assert digest(queries.pipeline(spark, DIRECTORY)) == digest(last)


def test_every_operator_has_its_query():
    names = queries.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
    assert "pipeline" in names and set(queries.oracle_sql()) <= set(names)
