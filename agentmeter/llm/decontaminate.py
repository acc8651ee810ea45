"""Benchmark decontamination: scan training text for word windows of test items.

Words are what is left between ASCII characters that are neither letters nor digits, A-Z in
lower case. A window is ten consecutive words of an item; an item of fewer is one
window. The windows of a slice of the benchmark are broadcast as sorted hashes; a slice holds
items of at most ``SLICE_BYTES`` of text together (or one item), and a larger
benchmark becomes several slices that the documents flow through in the same stage.
A hash that matches is verified word by word.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentmeter.llm.common import bodies, closed, opened, tidy
from agentmeter.llm.common import words as words_of

WINDOW_WORDS = 10
#: Bytes of item texts whose windows are broadcast at once.
SLICE_BYTES = 4 << 20

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


class Windows:
    """The windows of some items: for each length sorted hashes, the words behind them and their items."""

    def __init__(self, items: list[tuple[str, bytes]]) -> None:
        self.vocabulary = _Vocabulary()
        found: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for name, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            width = min(WINDOW_WORDS, len(words))
            for at in range(len(words) - width + 1 if words else 0):
                found.setdefault(width, {}).setdefault(tuple(words[at : at + width]), set()).add(name)
        self.by_width = []
        for width, windows in sorted(found.items()):
            ids = np.array(list(windows), np.int64).reshape(-1, width)
            hashes = _hashes(ids)
            order = np.argsort(hashes, kind="stable")
            names = [tuple(sorted(x)) for x in windows.values()]
            self.by_width.append((width, hashes[order], ids[order], [names[i] for i in order]))

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """(start, end) of every window that occurs among ``words``, and the items they belong to."""
        ids = np.fromiter(map(self.vocabulary.__getitem__, words), np.int64, len(words))
        known = np.concatenate(([0], np.cumsum(ids >= 0)))
        spans, items = [], set()
        for width, hashes, windows, names in self.by_width:
            if len(ids) < width:
                continue
            at = np.flatnonzero(known[width:] - known[:-width] == width)
            if not len(at):
                continue
            here = np.lib.stride_tricks.sliding_window_view(ids, width)[at]
            low = np.searchsorted(hashes, mine := _hashes(here))
            low_enough = np.minimum(low, len(hashes) - 1)
            for i in np.flatnonzero(hashes[low_enough] == mine):
                k = low[i]
                while k < len(hashes) and hashes[k] == mine[i]:
                    if np.array_equal(windows[k], here[i]):
                        spans.append((at[i], at[i] + width))
                        items.update(names[k])
                    k += 1
        return np.array(spans, np.int64).reshape(-1, 2), items


def _hashes(ids: np.ndarray) -> np.ndarray:
    out = np.zeros(len(ids), np.uint64)
    for column in ids.T:
        out = out * _BASE + column.astype(np.uint64) + np.uint64(1)
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of ``spans`` as disjoint ones in order; those that touch become one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _slices(benchmark: DataFrame, item: str, text: str) -> list:
    """A broadcast of ``Windows`` for each slice; each is collected by itself."""
    spark = benchmark.sparkSession
    items = benchmark.select(
        F.col(item).cast("string").alias("item"), F.col(text).cast("string").cast("binary").alias("body")
    ).where("item IS NOT NULL AND body IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    count = -(-total // (SLICE_BYTES // 2)) or 1
    part = F.pmod(F.xxhash64("item", "body"), F.lit(count))
    out = []
    for k in range(count):
        mine = items.where(part == k) if count > 1 else items
        out.append(spark.sparkContext.broadcast(Windows([tuple(map(_plain, r)) for r in mine.collect()])))
    return out


def _plain(value):
    return bytes(value) if isinstance(value, bytearray) else value


def _scanner(windows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = windows.value.scan
        for batch in batches:
            rows = []
            for body, spans, items in zip(bodies(batch), batch.column("spans"), batch.column("items"), strict=True):
                words = words_of(body)
                found, names = scan(words)
                pairs = [(s["start"], s["end"]) for s in spans.as_py()] + [tuple(f) for f in found.tolist()]
                rows.append((len(words), _merged(pairs), sorted(names.union(items.as_py()))))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("body"),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in r[1]] for r in rows], _SPANS),
                    pa.array([r[2] for r in rows], pa.list_(pa.string())),
                ],
                names=["row", "body", "n_words", "spans", "items"],
            )

    return tidy(run)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scanned(documents: DataFrame, text: str, benchmark: DataFrame, item: str, item_text: str) -> DataFrame:
    """(row, body, n_words, spans, items) of every document; spans are in words."""
    out = opened(documents, text).select(
        "row",
        "body",
        F.lit(0).cast("long").alias("n_words"),
        F.expr("CAST(array() AS array<struct<start: long, end: long>>)").alias("spans"),
        F.expr("CAST(array() AS array<string>)").alias("items"),
    )
    for windows in _slices(benchmark, item, item_text):
        out = out.mapInArrow(_scanner(windows), out.schema)
    return out


def scan(
    documents: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(key, n_words, n_hit, items, spans) of every document.

    n_hit counts the words inside any occurrence of any window; items names the items
    with occurring windows, sorted as strings; spans are the hit words as disjoint
    [start, end) in words. Null and empty texts have no words; a null item text has
    none either, and an item without an id takes no part. Items of one id act together.
    Repeated rows come back as often as they came; other columns are ignored; an empty
    benchmark hits nothing.
    """
    slim = documents.select(key, text)
    width = F.transform("spans", lambda s: s["end"] - s["start"])
    return _scanned(slim, text, benchmark, item, item_text).select(
        closed(slim, text)[0],
        "n_words",
        F.aggregate(width, F.lit(0).cast("long"), lambda a, b: a + b).alias("n_hit"),
        "items",
        "spans",
    )


def _without(body: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``body`` less the words of ``spans``, and what stands between the words of one span."""
    found = list(_WORD.finditer(body))
    kept, at = [], 0
    for start, end in spans:
        kept.append(body[at : found[start].start()])
        at = found[end - 1].end()
    return b"".join([*kept, body[at:]])


def _remover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cleaned, left = [], []
        for body, n_words, spans in zip(bodies(batch), batch.column("n_words"), batch.column("spans"), strict=True):
            pairs = [(s["start"], s["end"]) for s in spans.as_py()]
            cleaned.append(_without(body, pairs).decode("utf-8", "replace") if pairs else None)
            left.append(n_words.as_py() - sum(b - a for a, b in pairs))
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("body"), pa.array(cleaned, pa.string()), pa.array(left, pa.int64())],
            names=["row", "body", "cleaned", "left"],
        )


def remove(
    documents: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    length: str | None = "n_chars",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``documents`` without the passages that windows hit; columns as they came.

    A document of which no word is left goes; one without hits stays as it is, also if
    its text is null or empty. ``length`` (where there is such a column) follows the text.
    """
    scanned = _scanned(documents, text, benchmark, item, item_text)
    row = scanned.schema["row"].dataType.simpleString()
    cut = scanned.mapInArrow(tidy(_remover), f"row {row}, body string, cleaned string, left long")
    return cut.where("cleaned IS NULL OR left > 0").select(*closed(documents, text, F.col("cleaned"), length))
