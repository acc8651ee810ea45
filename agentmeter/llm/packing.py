"""Sequence packing by best-fit decreasing.

A task packs the documents of its own split, block by block, so no token is shuffled
and the work is spread like the input. Overlong documents are first cut into full
windows; what remains is placed longest first, each piece in the open window with
the least room that still holds it. A segment tree over the room left finds that window.
At most one window in a block stays nearly empty.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentmeter.llm import tokens
from agentmeter.llm.common import texts, tidy

WINDOW = 4096
END_ID = 2
#: Tokens that a task holds while it packs them.
BLOCK_TOKENS = 1 << 22


class OpenWindows:
    """Open windows by the room they have left: a segment tree whose leaves are stacks of windows."""

    def __init__(self, most: int) -> None:
        self.size = 1 << most.bit_length()
        self.held = [0] * (2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(self.size)]

    def _count(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.held[at] += by
            at >>= 1

    def put(self, window: int, room: int) -> None:
        if room:
            self.windows[room].append(window)
            self._count(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """A window with the least room of ``need`` or more, and that room; None if there is none."""
        at = need + self.size
        if not self.held[at]:
            # Climb until a subtree to the right holds a window, then go down its left edge.
            while at > 1 and not (at % 2 == 0 and self.held[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.held[2 * at] else 2 * at + 1
        room = at - self.size
        self._count(room, -1)
        return self.windows[room].pop(), room


def place(lengths: list[int], most: int) -> list[tuple[int, int]]:
    """(window, offset) of each piece of 1 to ``most`` tokens, by best-fit decreasing."""
    spots: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    tree, windows = OpenWindows(most), 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[i])
        if found is None:
            found, windows = (windows, most), windows + 1
        window, room = found
        spots[i] = (window, most - room)
        tree.put(window, room - lengths[i])
    return spots


def _padded(used: int, window: int) -> int:
    return used if used & (used - 1) == 0 else window


_FIELDS = [
    ("start", pa.int64(), "long"),
    ("length", pa.int64(), "long"),
    ("ids", pa.binary(), "binary"),
    ("doc_tokens", pa.int64(), "long"),
    ("sequence_id", pa.int64(), "long"),
    ("offset", pa.int64(), "long"),
    ("padded_to", pa.int64(), "long"),
]


def _packer(path: str, end_id: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = tokens.encoder(path).encode, end_id.to_bytes(4, "little")
        first = TaskContext.get().partitionId() << 33

        def packed(block: list[tuple]) -> pa.RecordBatch:
            nonlocal first
            spots = place([len(p[2]) // 4 for p in block], window)
            used: dict[int, int] = {}
            for piece, (number, _) in zip(block, spots, strict=True):
                used[number] = used.get(number, 0) + len(piece[2]) // 4
            rows = list(zip(*block, strict=True))
            columns = [
                pa.array([k.as_py() for k in rows[0]], rows[0][0].type),
                pa.array(rows[1], pa.int64()),
                pa.array([len(ids) // 4 for ids in rows[2]], pa.int64()),
                pa.array(rows[2], pa.binary()),
                pa.array(rows[3], pa.int64()),
                pa.array([first + number for number, _ in spots], pa.int64()),
                pa.array([offset for _, offset in spots], pa.int64()),
                pa.array([_padded(used[number], window) for number, _ in spots], pa.int64()),
            ]
            first += len(used)
            return pa.RecordBatch.from_arrays(columns, names=["key", *(f[0] for f in _FIELDS)])

        block, held = [], 0
        for batch in batches:
            for key, body in zip(batch.column("key"), batch.column("body"), strict=True):
                ids = encode(body.as_py()) + end
                count = len(ids) // 4
                for at in range(0, count, window):
                    block.append((key, at, ids[4 * at : 4 * (at + window)], count))
                    held += min(window, count - at)
                    if held >= BLOCK_TOKENS:
                        yield packed(block)
                        block, held = [], 0
        if block:
            yield packed(block)

    return tidy(run, keep=True)


def pack(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    path: str | None = None,
    end_id: int = END_ID,
    window: int = WINDOW,
) -> DataFrame:
    """(key, start, length, ids, doc_tokens, sequence_id, offset, padded_to), a row for each piece.

    ids are little-endian unsigned 32-bit; every document ends with ``end_id``, which is
    all that a null or empty text has. padded_to is ``window``, or the tokens in the sequence where
    those are a power of two. Repeated rows and null keys are documents like any other;
    other columns are ignored; no rows give no pieces. Sequence numbers hold the
    number of the split, so they are the same when a lost task runs again.
    """
    kind = documents.schema[key].dataType.simpleString()
    schema = ", ".join([f"`{key}` {kind}", *(f"{name} {sql}" for name, _, sql in _FIELDS)])
    return texts(documents, key, text).mapInArrow(_packer(path or tokens.default_path(), end_id, window), schema)


def digests(pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """The pieces with a CRC-32 in the place of their ids."""
    return pieces.select(
        key, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded_to"
    )
