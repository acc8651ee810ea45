"""Toxicity scores by gradient-boosted trees over dense features, with isotonic calibration.

The labelled rows that may be learnt from are dealt into folds by their id. One part gives the
lexicon: words, and beginnings of words, that occur in toxic documents far more often than
in others. Another trains the trees and a third calibrates them, so neither sees
densities of words that were picked for being in its own documents. Every document's features
come from its text alone.
"""

import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentmeter.llm.common import land, texts
from agentmeter.llm.common import words as words_of

#: Rows are dealt into so many folds by the CRC-32 of their id; fold 0 is never learnt from.
FOLDS = 5
LEXICON_FOLDS, TREE_FOLDS, CALIBRATION_FOLDS = (1, 2), (3,), (4,)
#: Labelled rows that are learnt from at most: those whose ids have the smallest hashes. Twelve bytes each are broadcast.
LABELLED_ROWS = 1 << 18
#: Entries of the lexicon at most, best first.
LEXICON_ENTRIES = 4_000
#: Signs of a word's beginning that is an entry by itself.
STEM = 4
TREES, DEPTH = 20, 4

#: Words by which a reader is addressed, in English, German, French and Spanish.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deiner ihr euch euer sie tu te toi ton ta tes vous "
    "votre vos tú ti tus usted ustedes vosotros vuestro".encode().split()
)
#: Words after or before one of those that count as near it.
NEAR = 5

_SHOUT = re.compile(rb"[!?]{2,}")
_CAPITALS = bytes(range(65, 91))
_SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def _flags(signs: bytes) -> np.ndarray:
    out = np.zeros(256, np.int8)
    out[np.frombuffer(signs, np.uint8)] = 1
    return out


_LETTER = _flags(string.ascii_letters.encode())
_CAPITAL = _flags(_CAPITALS)
#: Digits and signs that stand for a letter inside a word, as in w0rd or w*rd.
_MASK = _flags(b"0123456789@$*#!+")

FEATURES = (
    "words",
    "lexicon_hits",
    "lexicon_rate",
    "lexicon_weight",
    "lexicon_best",
    "stem_hits",
    "stem_rate",
    "stem_weight",
    "near_you",
    "you_rate",
    "capitals",
    "shouted_words",
    "signs",
    "shouts",
    "hidden",
    "drawn",
    "spaced",
)


@dataclass(frozen=True)
class Lexicon:
    words: dict[bytes, float]
    stems: dict[bytes, float]


def _obfuscation(body: bytes) -> tuple[int, int, int]:
    """Runs of masking signs between letters, letters drawn out to three or more, runs of three or more capitals."""
    signs = np.frombuffer(body, np.uint8)
    letter = _LETTER[signs]
    masked = np.diff(_MASK[signs], prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(masked == 1), np.flatnonzero(masked == -1)
    inner = (start > 0) & (end < len(signs))
    hidden = int((letter[start[inner] - 1] & letter[end[inner]]).sum())
    same = (signs[1:] == signs[:-1]) & (letter[1:] == 1)
    drawn = int((same[1:] & same[:-1]).sum())
    capital = np.diff(_CAPITAL[signs], prepend=np.int8(0), append=np.int8(0))
    loud = int((np.flatnonzero(capital == -1) - np.flatnonzero(capital == 1) > 2).sum())
    return hidden, drawn, loud


def features(body: bytes | None, lexicon: Lexicon) -> list[float]:
    """The values of ``FEATURES`` for a whole text in UTF-8; all zero for a null or empty one."""
    body = body or b""
    words = words_of(body)
    n, size = max(len(words), 1), max(len(body), 1)
    known, stems = lexicon.words, lexicon.stems
    at = [i for i, w in enumerate(words) if w in known]
    of_stem = [stems[w[:STEM]] for w in words if w[:STEM] in stems and len(w) > STEM]
    you = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near = 0
    if at and you:
        close = {j for i in you for j in range(i - NEAR, i + NEAR + 1)}
        near = sum(i in close for i in at)
    weights = [known[words[i]] for i in at]
    single = np.fromiter(map(len, words), np.int64, len(words)) == 1
    spaced = int((single[3:] & single[2:-1] & single[1:-2] & single[:-3]).sum()) if len(words) > 3 else 0
    hidden, drawn, loud = _obfuscation(body)
    return [
        float(len(words)),
        float(len(at)),
        len(at) / n,
        float(sum(weights)),
        max(weights, default=0.0),
        float(len(of_stem)),
        len(of_stem) / n,
        float(sum(of_stem)),
        float(near),
        len(you) / n,
        (size - len(body.translate(None, _CAPITALS))) / size if body else 0.0,
        loud / n,
        (size - len(body.translate(None, _SIGNS))) / size if body else 0.0,
        len(_SHOUT.findall(body)) / n,
        hidden / n,
        drawn / n,
        spaced / n,
    ]


def _describe(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(body.as_py(), lexicon) for body in batch.column("body")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(rows, pa.list_(pa.float64()))], names=["key", "features"]
            )

    return run


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entry, stem, toxic, clean): in how many documents of a split a word or a beginning occurs."""
    counts: dict[tuple[bool, int], Counter] = {(s, t): Counter() for s in (False, True) for t in (0, 1)}
    for batch in batches:
        for body, toxic in zip(batch.column("body"), batch.column("toxic"), strict=True):
            words = set(words_of(body.as_py()))
            counts[False, toxic.as_py()].update(words)
            counts[True, toxic.as_py()].update({w[:STEM] for w in words if len(w) > STEM})
    for stem in (False, True):
        toxic, clean = counts[stem, 1], counts[stem, 0]
        found = list(toxic | clean)
        for at in range(0, len(found), 1 << 16):
            part = found[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part, pa.binary()),
                    pa.array([stem] * len(part)),
                    pa.array([toxic[w] for w in part], pa.int64()),
                    pa.array([clean[w] for w in part], pa.int64()),
                ],
                names=["entry", "stem", "toxic", "clean"],
            )


def labelled(labels: DataFrame, key: str = "doc_id", toxic: str = "toxic", rows: int = LABELLED_ROWS) -> DataFrame:
    """(key, toxic, fold) of at most ``rows`` labels that may be learnt from.

    Labels that are null or neither 0 nor 1, and null ids, are left out; an id with both labels counts as toxic.
    """
    usable = (
        labels.where(F.col(key).isNotNull() & F.col(toxic).isin(0, 1))
        .groupBy(F.col(key).alias("key"))
        .agg(F.max(toxic).cast("int").alias("toxic"))
        .withColumn("fold", F.crc32(F.col("key").cast("string").cast("binary")) % FOLDS)
        .where("fold <> 0")
    )
    return usable.orderBy(F.xxhash64("key"), "key").limit(rows)


def learn_lexicon(bodies: DataFrame) -> Lexicon:
    """Words and beginnings that tell toxic documents, from (body, toxic); weights are log-odds.

    A lower bound of an entry's log-odds, two standard errors down, is well above zero.
    """
    total = bodies.groupBy("toxic").count().collect()
    size = {r["toxic"]: r["count"] for r in total}
    if not size.get(0) or not size.get(1):
        return Lexicon({}, {})
    counted = bodies.mapInArrow(_document_counts, "entry binary, stem boolean, toxic long, clean long")
    summed = counted.groupBy("entry", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (size[1] + 1.0)) - F.log((F.col("clean") + 0.5) / (size[0] + 1.0))
    spread = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    best = (
        summed.where("toxic >= 3")
        .withColumn("odds", odds)
        .withColumn("bound", F.col("odds") - 2 * spread)
        .where("bound > 0.7")
        .orderBy(F.desc("bound"), "entry", "stem")
        .limit(LEXICON_ENTRIES)
        .collect()
    )
    of = lambda stem: {bytes(r["entry"]): float(r["odds"]) for r in best if r["stem"] == stem}
    return Lexicon(of(False), of(True))


@dataclass
class Model:
    """Trees and calibration; either is None where the labels hold one class only."""

    lexicon: Lexicon
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    share: float

    def score(self, described: DataFrame) -> DataFrame:
        """``described`` with a score from 0 to 1 in the place of its features."""
        if self.trees is None:
            return described.withColumn("score", F.lit(self.share)).drop("features")
        raw = _raw(self.trees, described)
        fitted = self.calibration.transform(raw).withColumn(
            "score", F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0))
        )
        return fitted.select(*(c for c in described.columns if c != "features"), "score")


def _raw(trees: GBTClassificationModel, described: DataFrame) -> DataFrame:
    vectors = described.withColumn("features", array_to_vector("features"))
    margin = vector_to_array("rawPrediction")[1]
    return trees.transform(vectors).withColumn("raw", margin).drop("features", "rawPrediction", "probability", "prediction")


def fit(described: DataFrame, sample: DataFrame, lexicon: Lexicon) -> Model:
    """Trees from ``TREE_FOLDS`` and their calibration from ``CALIBRATION_FOLDS``.

    Where one of the two lacks a class, all folds serve for both; where those lack one too,
    every score is the share of toxic rows among them.
    """
    rows = land(described.join(F.broadcast(sample), "key").select("features", "toxic", "fold"), "training")
    rows = rows.withColumn("label", F.col("toxic").cast("double")).coalesce(8)
    found = {(r["fold"], r["toxic"]): r["count"] for r in rows.groupBy("fold", "toxic").count().collect()}
    both = lambda folds: all(any(found.get((f, t)) for f in folds) for t in (0, 1))
    toxic, total = sum(n for (_, t), n in found.items() if t), sum(found.values())
    every = tuple(range(1, FOLDS))
    if not both(every):
        return Model(lexicon, None, None, toxic / total if total else 0.0)
    parts = (TREE_FOLDS, CALIBRATION_FOLDS) if both(TREE_FOLDS) and both(CALIBRATION_FOLDS) else (every, every)
    learnt, held = (rows.where(F.col("fold").isin(*folds)) for folds in parts)
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7).fit(
        learnt.withColumn("features", array_to_vector("features"))
    )
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label").fit(_raw(trees, held))
    return Model(lexicon, trees, calibration, toxic / total)


def score(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) of every row of ``documents``.

    held_out tells the rows of fold 0, from whose labels nothing is learnt. Null and empty
    texts are scored like any other. Rows that repeat come back as often as they came; other columns
    are ignored. Without labels of both classes all scores are equal.
    """
    sample = land(labelled(labels, key), "sample")
    lexicon_rows = sample.where(F.col("fold").isin(*LEXICON_FOLDS))
    learnt = texts(documents, key, text).join(F.broadcast(lexicon_rows), "key").select("body", "toxic")
    lexicon = learn_lexicon(learnt)
    kind = documents.schema[key].dataType.simpleString()
    described = texts(documents, key, text).mapInArrow(_describe(lexicon), f"key {kind}, features array<double>")
    described = land(described, "features")
    scored = fit(described, sample, lexicon).score(described)
    fold = F.crc32(F.col("key").cast("string").cast("binary")) % FOLDS
    return scored.select(
        F.col("key").alias(key),
        F.coalesce(fold == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
