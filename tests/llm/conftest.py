import pytest
from pyspark.sql import types as T

LONG = " ".join(f"w{i % 977}" for i in range(40_000))
DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that the operators use inside.
        *(T.StructField(n, T.StringType()) for n in ("key", "body", "row", "spans", "fingerprint", "threshold", "toxic")),
    ]
)


@pytest.fixture(scope="session")
def make_documents(spark):
    def make(rows):
        """Documents from (id, text) or (id, text, lang), with null and clashing columns beside."""
        full = [(i, x, *(lang or ["en"]), None, None if x is None else len(x), *["x", None] * 3, "1") for i, x, *lang in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return make


#: Null, empty, blank, long and repeated texts, a null id, letters beyond ASCII and a repeated row.
ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t"),
    (4, LONG),
    (5, LONG),
    (6, "Ünï çødé – 日本語 text ß ẞ İ"),
    (7, "one"),
    (7, "one"),
    (None, "no id at all"),
    (9, "ONE"),
]


@pytest.fixture
def odd():
    return list(ODD)
