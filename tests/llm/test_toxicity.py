import zlib

import pytest

from agentmeter.llm import toxicity

NO_WORDS = toxicity.Lexicon({}, {})


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def named(text, lexicon=NO_WORDS):
    return dict(zip(toxicity.FEATURES, toxicity.features(None if text is None else text.encode(), lexicon), strict=True))


def test_features():
    lexicon = toxicity.Lexicon({b"scum": 2.0, b"moron": 3.0}, {b"moro": 1.5})
    got = named("You SCUM, you!! are a m0ron and a moron; l o s e r sooo", lexicon)
    n = got["words"]
    assert n == 15 and got["lexicon_hits"] == 2 and got["lexicon_weight"] == 5 and got["lexicon_best"] == 3
    assert got["near_you"] == 1 and got["you_rate"] == 2 / n
    assert got["stem_hits"] == 1 and got["stem_weight"] == 1.5
    assert got["hidden"] == 1 / n and got["drawn"] == 1 / n and got["shouts"] == 1 / n
    assert got["shouted_words"] == 1 / n and got["spaced"] == 2 / n


@pytest.mark.parametrize("text", [None, "", " ", "0", "!", "日本", "aaa", "a1"])
def test_features_of_odd_texts(text):
    got = named(text)
    assert all(isinstance(v, float) and v == v for v in got.values())
    if not text:
        assert not any(got.values())


def test_hidden_needs_letters_on_both_sides():
    assert named("4ever a4 w0rd w**d 9a9 x")["hidden"] == 2 / 7


@pytest.fixture(scope="module")
def scored(spark):
    directory = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{directory}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, toxicity.score(docs, labels).cache()


def test_held_out_accuracy(scored):
    docs, labels, found = scored
    rows = found.join(labels, "doc_id").collect()
    assert all(r.held_out == held_out(r.doc_id) for r in rows)
    test = [r for r in rows if r.held_out]
    hits = sum(r.predicted and r.toxic for r in test)
    assert hits / sum(r.toxic for r in test) > 0.85
    assert hits / sum(r.predicted for r in test) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_held_out_labels_don_t_matter(spark, scored):
    docs, labels, found = scored
    from pyspark.sql import functions as F

    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    swapped = labels.withColumn("toxic", F.when(fold == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    again = {r.doc_id: r.score for r in toxicity.score(docs, swapped).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in found.collect())


def test_odd_rows(spark, make_documents, odd):
    nice = [(i, f"a fine day number {i} for the garden") for i in range(100, 300)]
    rude = [(i, f"you utter gnarfel number {i} you blorch") for i in range(300, 500)]
    labels = spark.createDataFrame(
        [(i, 1, int(i >= 300)) for i, _ in nice + rude] + [(None, 1, 1), (101, 1, None), (102, 1, 7), (9999, 1, 1)],
        "doc_id long, quality int, toxic int",
    )
    docs = make_documents([*odd, *nice, *rude])
    out = toxicity.score(docs, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.collect()
    assert len(rows) == len(odd) + 400
    assert all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    assert all(r.predicted == (r.doc_id >= 300) for r in rows if r.doc_id is not None and r.doc_id >= 100)


def test_labels_of_one_class_or_none(spark, make_documents):
    docs = make_documents([(i, "some text") for i in range(20)])
    schema = "doc_id long, quality int, toxic int"
    one = spark.createDataFrame([(i, 1, 1) for i in range(20)], schema)
    assert {r.score for r in toxicity.score(docs, one).collect()} == {1.0}
    none = spark.createDataFrame([], schema)
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(make_documents([]), one).collect() == []
