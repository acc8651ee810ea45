"""Secret scans: fixed patterns, and character Markov models for what has no pattern.

Two first-order models over the characters of key-like strings are trained from all
documents. Labelled samples come from the text itself: the values that the fixed
patterns find are random strings, all other runs of key characters are ordinary
words and identifiers. A stretch of a run is a secret if its log-likelihood ratio, less an
amount for each sign, is high enough; it counts up to the next sign that parts names and
values, so an ordinary part beside a key neither hides it nor is part of it if long.
Only the two count matrices, whose size is fixed by
the alphabet, ever reach the driver.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentmeter.llm.common import bodies, closed, opened, small_batches, texts, tidy

KINDS = ("assign", "access", "hex", "random")
KEY_SIGNS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Class 0 is every other byte, and so the start and the end of a run.
CLASSES = len(KEY_SIGNS) + 1
MIN_ASSIGNED, MIN_ACCESS, MIN_HEX = 6, 20, 24

_ANY_CASE = "|".join(
    "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
    for word in ("password", "passwd", "secret", "token", "api_?key")
)
_ASSIGN = re.compile(rf"""({_ANY_CASE})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".encode())
#: Each match of the pattern holds one of these in lower case.
_NAMES = (b"passw", b"secret", b"token", b"key")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{%d,}" % MIN_HEX)
_CLASS_OF = np.zeros(256, np.intp)
_CLASS_OF[np.frombuffer(KEY_SIGNS, np.uint8)] = np.arange(1, CLASSES)


@dataclass(frozen=True)
class Rule:
    """When a run of key characters counts as random."""

    least: int = 16  # characters
    per_sign: float = 1.5  # nats of log-likelihood ratio that a sign must bring to add to a stretch
    total: float = 26.0  # nats beyond that; held-out ordinary runs of the test tables reach 2.1


def base(body: bytes) -> list[tuple[int, str, int, int]]:
    """(start, kind, end, start of the value) in bytes, ordered by start and kind."""
    found = []
    lower = body.lower()
    if any(name in lower for name in _NAMES):
        for m in _ASSIGN.finditer(body):
            if m.end(2) - m.start(2) >= MIN_ASSIGNED:
                found.append((m.start(), 0, m.end(), m.start(2)))
    if b"AKIA" in body:
        found += [(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(body) if len(m[0]) >= MIN_ACCESS]
    found += [(start, 2, end, start) for start, end in _hex_runs(body)]
    return [(start, KINDS[kind], end, value) for start, kind, end, value in sorted(found)]


_IS_HEX = np.zeros(256, np.int8)
_IS_HEX[np.frombuffer(b"0123456789abcdef", np.uint8)] = 1


def _hex_runs(body: bytes) -> list[tuple[int, int]]:
    starts, ends = _runs(_IS_HEX[np.frombuffer(body, np.uint8)])
    long = ends - starts >= MIN_HEX
    return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ones."""
    edges = np.diff(flags, prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _pairs(body: bytes) -> np.ndarray:
    """For each byte and the end, the transition that leads to it."""
    classes = np.zeros(len(body) + 2, np.intp)
    classes[1:-1] = _CLASS_OF[np.frombuffer(body, np.uint8)]
    return classes[:-1] * CLASSES + classes[1:]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(random, pair, n): how often each transition occurs, in found values and elsewhere."""
    counts = np.zeros((2, CLASSES * CLASSES), np.int64)
    for batch in batches:
        for scalar in batch.column("body"):
            if not (body := scalar.as_py()):
                continue
            pairs = _pairs(body)
            counts[0] += np.bincount(pairs, minlength=CLASSES * CLASSES)
            done = 0
            for _, _, end, value in sorted(base(body), key=lambda s: s[3]):
                if value < done:
                    continue
                done = end
                mine = np.bincount(_pairs(body[value:end]), minlength=CLASSES * CLASSES)
                counts[1] += mine
                counts[0] -= mine
    label, pair = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(label == 1), pa.array(pair, pa.int64()), pa.array(counts[label, pair], pa.int64())],
        names=["random", "pair", "n"],
    )


def train(documents: DataFrame, text: str = "text") -> np.ndarray:
    """Log-likelihood ratio of each transition, random against ordinary; zeros if a class has no samples.

    Both models are smoothed with half a count. The counts of random strings mix in one
    uniform transition for each pair of classes seen together in no sample.
    """
    small_batches(documents.sparkSession)
    body = documents.select(F.col(text).cast("string").cast("binary").alias("body"))
    rows = body.mapInArrow(tidy(_count), "random boolean, pair long, n long").groupBy("random", "pair").agg(F.sum("n"))
    counts = np.zeros((2, CLASSES, CLASSES))
    for random, pair, n in rows.collect():
        # A value may begin inside a run, whose own transition was then counted but once.
        counts[int(random), pair // CLASSES, pair % CLASSES] = max(n, 0)
    # What follows the signs that part runs isn't part of either model.
    counts[:, 0, 0] = 0
    if not counts[0].any() or not counts[1].any():
        return np.zeros(CLASSES * CLASSES)
    logs = []
    for label, matrix in enumerate(counts):
        smooth = matrix + 0.5
        if label == 1:
            # Keys seen so far use few alphabets; any key sign may follow any other in one.
            smooth[1:, 1:] += smooth[1:, 1:].sum() / (CLASSES - 1) ** 2 * 0.2
        logs.append(np.log(smooth / smooth.sum(axis=1, keepdims=True)))
    ratio = logs[1] - logs[0]
    # Where a run starts and ends says how its neighbours are parted, not how random it is.
    ratio[0, :] = ratio[:, 0] = 0
    return ratio.ravel()


def _stretches(gains: np.ndarray, total: float) -> list[tuple[int, int]]:
    """The (first, end) of stretches whose gains sum to ``total`` or more; one ends where ``total`` is lost again."""
    out, at, best, first, end = [], 0.0, 0.0, 0, 0
    for i, gain in enumerate(gains.tolist()):
        at += gain
        if at > best:
            best, end = at, i + 1
        if at <= 0 or best - at >= total:
            if best >= total:
                out.append((first, end))
            at, best, first = 0.0, 0.0, i + 1
    return [*out, (first, end)] if best >= total else out


#: Signs that part names, values and paths.
_PARTS = b"/=_-"


def _free(first: int, last: int, taken: list[tuple[int, int]], at: int) -> tuple[list[tuple[int, int]], int]:
    """The parts of a run outside ``taken`` (disjoint, in order), of which those before ``at`` end before it; and the next ``at``."""
    while at < len(taken) and taken[at][1] <= first:
        at += 1
    parts, start, i = [], first, at
    while i < len(taken) and taken[i][0] < last:
        if taken[i][0] > start:
            parts.append((start, taken[i][0]))
        start = max(start, taken[i][1])
        i += 1
    if start < last:
        parts.append((start, last))
    return parts, at


def _random_runs(
    body: bytes, ratio: np.ndarray, rule: Rule, taken: list[tuple[int, int]] | None = None
) -> list[tuple[int, int]]:
    """Random spans of a text outside ``taken``, in order; time grows with the text and the number of both."""
    pairs = _pairs(body)
    starts, ends = _runs((pairs[:-1] % CLASSES > 0).view(np.int8))
    long = ends - starts >= rule.least
    out, at = [], 0
    parting = np.zeros(256, bool)
    parting[np.frombuffer(_PARTS, np.uint8)] = True
    signs = np.frombuffer(body, np.uint8)
    for run_first, run_last in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
        parts, at = _free(run_first, run_last, taken or [], at)
        for first, last in parts:
            if last - first < rule.least:
                continue
            # The first sign has no transition within the run.
            gains = ratio[pairs[first + 1 : last]] - rule.per_sign
            if gains[gains > 0].sum() < rule.total:
                continue
            # Where the run can be parted, its ends among them.
            cuts = np.flatnonzero(parting[signs[first:last]]) + first
            own = []
            for start, end in _stretches(gains, rule.total):
                start, end = _widened(cuts, first + start, first + end + 1, first, last, rule.least)
                if end - start < rule.least:
                    continue
                if own and start <= own[-1][1]:
                    own[-1] = own[-1][0], max(end, own[-1][1])
                else:
                    own.append((start, end))
            out += own
    return out


def _widened(cuts: np.ndarray, start: int, end: int, first: int, last: int, least: int) -> tuple[int, int]:
    """The stretch up to the next parting sign, or to the ends of its run if less than ``least`` would be left there."""
    i = int(np.searchsorted(cuts, start)) - 1
    start = int(cuts[i]) + 1 if i >= 0 else first
    i = int(np.searchsorted(cuts, end))
    end = int(cuts[i]) if i < len(cuts) else last
    return first if start - first < least else start, last if last - end < least else end


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans as disjoint ones."""
    out: list[tuple[int, int]] = []
    for start, end in spans:
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def find(body: bytes | None, ratio: np.ndarray, rule: Rule) -> list[tuple[int, str, int]]:
    """(start, kind, end) in code points of every span of a text in UTF-8, ordered by start and kind."""
    if not body:
        return []
    spans = [(start, kind, end) for start, kind, end, _ in base(body)]
    taken = _union([(start, end) for start, _, end in spans])
    spans += [(start, "random", end) for start, end in _random_runs(body, ratio, rule, taken)]
    spans.sort(key=lambda s: (s[0], KINDS.index(s[1])))
    if spans and not body.isascii():
        at = sorted({p for s in spans for p in (s[0], s[2])})
        place, points, last = {}, 0, 0
        for p in at:
            points += len(body[last:p].decode("utf-8", "replace"))
            place[p], last = points, p
        spans = [(place[a], kind, place[b]) for a, kind, b in spans]
    return spans


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())])


def _finder(ratio: np.ndarray, rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body in batch.column("body"):
                spans = find(body.as_py(), ratio, rule)
                rows.append([{"start": a, "kind": kind, "end": b} for a, kind, b in spans])
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(rows, pa.list_(_SPAN))], names=["key", "spans"]
            )

    return tidy(run)


def scan(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    rule: Rule | None = None,
    train_on: DataFrame | None = None,
) -> DataFrame:
    """(key, spans) of every document; spans are (start, kind, end) in code points, end exclusive.

    Spans are ordered by start, then by kind as in ``KINDS``. Those of the three fixed kinds stay
    whatever the models say; random spans are sought in what they leave of a run and so overlap none of them. Null and empty texts have no spans; repeated rows come back as
    often as they came; other columns are ignored. Without any sample of either
    class there are no random spans.
    """
    ratio = train(documents if train_on is None else train_on, text)
    kind = documents.schema[key].dataType.simpleString()
    return texts(documents, key, text).mapInArrow(
        _finder(ratio, rule or Rule()),
        f"`{key}` {kind}, spans array<struct<start: long, kind: string, end: long>>",
    )


def _cut(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    kept, at = [], 0
    for start, end in sorted(spans):
        if end > at:
            kept += [text[at : max(start, at)], mark] if start >= at else []
            at = end
    return "".join([*kept, text[at:]])


def _redactor(ratio: np.ndarray, rule: Rule, mark: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body in bodies(batch):
                spans = [(a, b) for a, _, b in find(body, ratio, rule)]
                out.append(_cut(body.decode("utf-8", "replace"), spans, mark) if spans else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("body"), pa.array(out, pa.string())], names=["row", "body", "clean"]
            )

    return tidy(run)


def redact(
    documents: DataFrame,
    text: str = "text",
    length: str | None = "n_chars",
    mark: str = "<secret>",
    rule: Rule | None = None,
) -> DataFrame:
    """``documents`` with ``mark`` in the place of every span; columns as they came.

    Spans that overlap get one mark. Rows without spans stay as they are, also with a null or
    empty text. ``length`` (where there is such a column) follows the text.
    """
    ratio = train(documents, text)
    whole = opened(documents, text)
    row = whole.schema["row"].dataType.simpleString()
    clean = whole.mapInArrow(_redactor(ratio, rule or Rule(), mark), f"row {row}, body string, clean string")
    return clean.select(*closed(documents, text, F.col("clean"), length))


def digests(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the fixed kinds, the SHA-256 of their spans, and all spans as text."""
    shown = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda of: F.array_join(F.transform(of, shown), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return spans.select(
        key,
        *(count(kind).alias(f"n_{kind}") for kind in KINDS[:3]),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "random")), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
        count("random").alias("n_random"),
    )
