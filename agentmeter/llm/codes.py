"""Vector codes: every part of a vector becomes the number of its nearest entry in that part's codebook.

Components are integers, so distances, means and codes are exact. Codebooks start with the parts of
the vectors of smallest id and are improved in rounds of assigning and averaging.

Assigning prunes with pivots (LAESA): a few of a codebook's first entries stay fixed, and the
distance of each part to each pivot is computed once. In a round only the entries' distances to
the pivots are new. Their difference is a lower bound of the distance of part and
entry; entries are tried in its order and the rest is left out once the bound is beyond the nearest
entry found. Bounds are floating-point and give way by more than their error; what they don't
exclude is evaluated in integers, so no pruning changes a result.

A round is one pass over the landed parts. A task sums its parts by entry, Spark adds up the
tasks' sums, and only the codebooks, of a size the input doesn't change, come to the driver.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentmeter.llm.common import land

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
PIVOTS = 4
#: Quantised components within this range leave room for a part's squared distance in 64 bits; others use Python's integers.
NARROW = 1 << 24
#: What a bound gives way: more than 32-bit floats and the root lose.
SLACK = 1e-5
#: Copies of each label's sum, so that rows of one label meet it in several tasks.
COPIES = 32
#: Rows that a task compares at once.
ROWS = 1 << 14


def quantised(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, v): floor(4096 x) of every component.

    Rows whose vector is null or holds null, NaN or infinity take no part. An integer beyond
    64 bits becomes the nearest that isn't.
    """
    wide = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("x"))
    sound = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return wide.where(F.col("x").isNotNull() & sound).select("id", "label", F.transform("x", lambda x: F.floor(x * SCALE)).alias("v"))


def _parts(column: pa.ListArray, width: int) -> np.ndarray:
    """(row, part, component); vectors that are shorter end with zeros."""
    lengths = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten(), np.int64)
    if len(lengths) and (lengths == width * PARTS).all():
        whole = flat.reshape(len(lengths), PARTS, width)
    else:
        whole = np.zeros((len(lengths), PARTS * width), np.int64)
        whole[np.arange(PARTS * width) < lengths[:, None]] = flat
        whole = whole.reshape(len(lengths), PARTS, width)
    if len(whole) and width and (whole.min() <= -NARROW or whole.max() >= NARROW or width > 1 << 10):
        whole = whole.astype(object)
    return whole


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances over the last axis, in integers."""
    if a.dtype == object or b.dtype == object or (b.size and max(-int(b.min()), int(b.max())) >= NARROW):
        apart = a.astype(object) - b.astype(object)
        return (apart * apart).sum(axis=-1)
    apart = a - b
    return np.einsum("...k,...k->...", apart, apart)


def pivots(first: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """``count`` entries of each part's first codebook (part, entry, component), each as far as can be from those before."""
    chosen = []
    for book in first:
        picked = [0]
        while len(picked) < min(count, len(book)):
            near = np.min([_squares(book, book[p]) for p in picked], axis=0)
            picked.append(int(np.argmax(near)))
        chosen.append(book[picked])
    return np.array(chosen, first.dtype)


def roots(parts: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """Distances (row, part, pivot) of parts to their pivots."""
    return np.sqrt(_squares(parts[:, :, None, :], fixed[None]).astype(np.float64))


def nearest(parts: np.ndarray, away: np.ndarray, book: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of one part position: (entry, squared distance) of each row and how many distances were evaluated.

    ``away`` holds the rows' distances to the pivots, ``anchors`` the entries'. Of entries at the same
    distance the first is taken.
    """
    least = np.zeros((len(parts), len(book)))
    for p in range(away.shape[1]):
        a, b = away[:, p, None], anchors[None, :, p]
        np.maximum(least, np.abs(a - b) - SLACK * (a + b), out=least)
    order = np.argsort(least, axis=1, kind="stable")
    least = np.take_along_axis(least, order, 1)
    best = np.full(len(parts), -1, parts.dtype if parts.dtype == object else np.int64)
    entry = np.zeros(len(parts), np.int64)
    limit = np.full(len(parts), np.inf)
    tried, rows = 0, np.arange(len(parts))
    for k in range(len(book)):
        rows = rows[least[rows, k] <= limit[rows]]
        if not len(rows):
            break
        tried += len(rows)
        at = order[rows, k]
        square = _squares(parts[rows], book[at])
        held, held_at = best[rows], entry[rows]
        better = (held < 0) | (square < held) | (square == held) & (at < held_at)
        better = better.astype(bool)
        won = rows[better]
        best[won], entry[won] = square[better], at[better]
        limit[won] = np.sqrt(square[better].astype(np.float64)) * (1 + SLACK)
    return entry, best, tried


def _assigned(batch: pa.RecordBatch, book: np.ndarray, anchors: np.ndarray, width: int):
    """(parts, entries, squared distances) of a batch, rows by part positions."""
    count = anchors.shape[2]
    for at in range(0, batch.num_rows, ROWS):
        some = batch.slice(at, ROWS)
        parts = _parts(some.column("v"), width)
        away = np.asarray(some.column("away").flatten(), np.float64).reshape(len(parts), PARTS, count)
        found = [nearest(parts[:, p], away[:, p], book[p], anchors[p])[:2] for p in range(PARTS)]
        yield some, parts, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _anchoring(fixed: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away = roots(_parts(batch.column("v"), width), fixed).astype(np.float32)
            flat = pa.array(away.reshape(-1))
            ends = pa.array((np.arange(batch.num_rows + 1) * (PARTS * fixed.shape[1])).astype(np.int32))
            columns = [batch.column(n) for n in ("id", "label", "v")]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(ends, flat)], names=["id", "label", "v", "away"])

    return run


def _summing(book: np.ndarray, anchors: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((PARTS, book.shape[1]), np.int64)
        total = np.zeros((PARTS, book.shape[1], width), object)
        for batch in batches:
            for _, parts, entries, _ in _assigned(batch, book, anchors, width):
                for p in range(PARTS):
                    count[p] += np.bincount(entries[:, p], minlength=book.shape[1])
                    some = np.zeros((book.shape[1], width), parts.dtype)
                    np.add.at(some, entries[:, p], parts[:, p])
                    total[p] += some
        used = [(p, e) for p in range(PARTS) for e in range(book.shape[1]) if count[p, e]]
        rows = [(p, e, int(count[p, e]), k, int(total[p, e, k])) for p, e in used for k in range(width)]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.decimal128(38))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "entry", "count", "place", "total"]
        )

    return run


def _coding(book: np.ndarray, anchors: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, _, entries, squares in _assigned(batch, book, anchors, width):
                codes = ["".join(f"{e:02x}" for e in row) for row in entries.tolist()]
                errors = [sum(map(int, row)) for row in squares]
                fits = [e if e < 1 << 63 else None for e in errors]
                yield pa.RecordBatch.from_arrays(
                    [some.column("id"), some.column("label"), pa.array(codes, pa.string()), pa.array(fits, pa.int64())],
                    names=["id", "label", "code", "error"],
                )

    return run


def _first(rows: DataFrame, width: int, entries: int) -> np.ndarray:
    """(part, entry, component) of the vectors of smallest id; of one id the smaller vector first, those without id last."""
    least = rows.select("id", "v").orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()
    whole = np.zeros((len(least), PARTS * width), object)
    for i, row in enumerate(least):
        whole[i, : len(row.v)] = row.v
    return np.ascontiguousarray(_slim(whole.reshape(len(least), PARTS, width).transpose(1, 0, 2)))


def _slim(book: np.ndarray) -> np.ndarray:
    return book.astype(np.int64)


def train(rows: DataFrame, width: int, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(landed rows with their distances to the pivots, codebooks (part, entry, component), entries' distances to the pivots)."""
    first = _first(rows, width, entries)
    fixed = pivots(first)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    held = f"id {kinds['id']}, label {kinds['label']}, v array<bigint>, away array<float>"
    anchored = land(rows.mapInArrow(_anchoring(fixed, width), held), "anchored")
    book, sums = first, "part int, entry int, count long, place int, total decimal(38,0)"
    for _ in range(rounds):
        anchors = roots(book.transpose(1, 0, 2), fixed).transpose(1, 0, 2)
        found = anchored.select("v", "away").mapInArrow(_summing(book, anchors, width), sums)
        book = book.copy()
        added = found.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("count").alias("count"))
        for r in added.collect():
            book[r.part, r.entry, r.place] = int(r.total) // r["count"]
    return anchored, book, roots(book.transpose(1, 0, 2), fixed).transpose(1, 0, 2)


def encode(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    rounds: int = ROUNDS,
    entries: int = ENTRIES,
) -> tuple[DataFrame, np.ndarray]:
    """((key, label, code, error) of every row that takes part, codebooks (part, entry, component)).

    ``code`` has two hex digits for each part, ``error`` is the squared distance to what they stand for, null
    if that doesn't fit 64 bits. See ``quantised`` for the rows that take no part. Repeated rows and ids are rows like
    any other; null ids come last where the first codebooks are chosen. Fewer rows than entries make as many entries.
    Vectors are as long as the longest, rounded up to a multiple of 8, and shorter ones
    end with zeros; empty ones are all zeros. Other columns are ignored; no rows give no rows and empty codebooks.
    """
    rows = land(quantised(vectors, key, vector, label), "quantised")
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    names = [F.col("id").alias(key), F.col("label").alias(label), "code", "error"]
    if longest is None:
        empty = rows.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return empty.select(*names), np.zeros((PARTS, 0, 0), np.int64)
    width = -(-longest // PARTS)
    anchored, book, anchors = train(rows, width, rounds, entries)
    schema = f"id {kinds['id']}, label {kinds['label']}, code string, error long"
    return anchored.mapInArrow(_coding(book, anchors, width), schema).select(*names), book


def stated(books: np.ndarray) -> str:
    """All entries' components by part, entry and place, joined by commas."""
    return ",".join(map(str, books.reshape(-1).tolist()))


def with_label_errors(coded: DataFrame, key: str = "vec_id", label: str = "label") -> DataFrame:
    """``coded`` and label_error, the error summed over the rows of equal label; null labels are equal.

    It is null where it, or an error in it, doesn't fit 64 bits. Every label's sum is there ``COPIES`` times and rows are
    dealt out over them, so a label of a third of all rows isn't one task's work.
    """
    rows = land(coded.select(F.col(key).alias("id"), F.col(label).alias("label"), "code", "error"), "coded")
    whole = F.count("error") == F.count(F.lit(1))
    fits = F.expr("try_cast(sum(cast(error AS decimal(38,0))) AS long)")
    sums = rows.groupBy(F.col("label").alias("of")).agg(F.when(whole, fits).alias("label_error"))
    sums = sums.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    dealt = rows.withColumn("deal", F.pmod(F.xxhash64("id", "code"), F.lit(COPIES)).cast("int"))
    joined = dealt.join(sums, F.col("label").eqNullSafe(F.col("of")) & (F.col("deal") == F.col("copy")))
    return joined.select(F.col("id").alias(key), F.col("label").alias(label), "code", "error", "label_error")
