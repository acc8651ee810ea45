"""Byte-level BPE as a streaming transducer, and its inverse.

Merging can't look ahead without end: how far a text's continuation reaches back into
its ids is bounded by the merge list. Take two texts that agree up to some byte and
apply the rules in order. The boundary up to which both are cut alike only moves left when
a rule (a, b) joins across it in one of them, and then by the length of a. The next
rule (c, d) that does so must find d in one text and not in the other, just where that a
began, so a lies on the left edge of d's own merges. The longest such chain of rules of rising
rank, weighed by its left parts, is the list's sufficient lookahead; one pass over
the list finds it. Ids that end at least so many bytes before the end of what was read are final.

A text is cut into pieces as it streams in (letters, digits, other signs, blanks), a piece
is merged once its end is known, and a piece too long to wait for is merged in a window: what lies
beyond the lookahead leaves it, the rest stays. The state is one short piece and one window,
however long the text. Decoding keeps at most three bytes of an unfinished character.
"""

import codecs
import heapq
import json
import re
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from agentmeter.llm.common import small_batches, texts
from agentmeter.llm.tokens import _shown

VOCABULARY = "byte_bpe_50k.json"
#: Signs read at a time, and signs of a piece beyond which it is merged in a window instead of whole.
CHUNK, LONG = 1 << 16, 256
#: Pieces remembered by a Python worker, and signs of one at most. Beyond that number the memory starts anew.
PIECES, REMEMBERED = 400_000, 24
#: Bytes that leave a window at once (about).
STEP = 1 << 10
#: Signs whose class is part of the pattern; others are replaced by one of the same class before it is applied.
NEAR = 0x250
NEVER = 1 << 30


class Merges:
    """The merge list of a byte-level vocabulary over ids, and what follows from it."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            stated = json.load(file)
        model = stated["model"]
        if model["type"] != "BPE" or (stated["pre_tokenizer"] or {}).get("type") != "ByteLevel" or stated["normalizer"]:
            raise ValueError(f"{path} is not a byte-level BPE")
        shown, vocab = {c: b for b, c in enumerate(_shown())}, model["vocab"]
        self.bytes = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in stated["added_tokens"])]))
        for token, i in vocab.items():
            self.bytes[i] = bytes(shown[c] for c in token) if all(c in shown for c in token) else token.encode()
        self.special = {t["content"]: t["id"] for t in stated["added_tokens"]}
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        signs = _shown()
        self.single = [vocab[c] for c in signs]
        #: Rank of a rule by its parts' ids, the id that it makes by rank, and ids of two parts by id.
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        self.parts: dict[int, tuple[int, int]] = {}
        known = set(self.single)
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, both = vocab[left], vocab[right], vocab[left + right]
            if a not in known or b not in known or both in known:
                raise ValueError(f"merge {rank} of {path} uses a part before it is made, or makes one twice")
            known.add(both)
            self.ranks[a, b], self.parts[both] = rank, (a, b)
            self.made.append(both)
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        """The greatest number of bytes before a text's end in which ids depend on what follows."""
        reach: dict[int, int] = {}  # by left part of a rule: the longest chain that ends with such a rule
        for a, b in self.ranks:
            longest, edge = 0, b
            while True:
                longest = max(longest, reach.get(edge, 0))
                if edge not in self.parts:
                    break
                edge = self.parts[edge][0]
            reach[a] = max(reach.get(a, 0), longest + len(self.bytes[a]))
        return max(reach.values(), default=0)

    def merge(self, body: bytes) -> list[int]:
        """The ids of one piece, by the rule of least rank first and from the left."""
        ids = [self.single[b] for b in body]
        if len(ids) > 48:
            return self._merge_long(ids)
        rank = self.ranks.get
        ranks = [rank(pair, NEVER) for pair in pairwise(ids)]
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            i = ranks.index(best)
            ids[i] = both = self.made[best]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank((ids[i - 1], both), NEVER)
            if i < len(ranks):
                ranks[i] = rank((both, ids[i + 1]), NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """As ``merge``, with a heap and a linked list: time grows with n log n."""
        rules, n = self.ranks, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i) for i, pair in enumerate(pairwise(ids)) if (rank := rules.get(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or rules.get((ids[i], ids[j])) != rank:
                continue
            both = self.made[rank]
            ids[i], ids[j], k = both, -1, after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if (rank := rules.get((both, ids[k]))) is not None:
                    heapq.heappush(heap, (rank, i))
            if (h := before[i]) >= 0 and (rank := rules.get((ids[h], both))) is not None:
                heapq.heappush(heap, (rank, h))
        return [i for i in ids if i >= 0]


class Window:
    """Merges one piece of any length as it arrives; holds the lookahead and one step more."""

    def __init__(self, merges: Merges) -> None:
        self.merges, self.held = merges, b""

    def push(self, body: bytes) -> list[int]:
        """Ids that are final now."""
        out, at = [], 0
        size = self.merges.lookahead + STEP
        while at < len(body):
            more = max(1, size - len(self.held))
            self.held += body[at : at + more]
            at += more
            if len(self.held) >= size:
                out += self._stable()
        return out

    def _stable(self) -> list[int]:
        limit, end, out = len(self.held) - self.merges.lookahead, 0, []
        for i in self.merges.merge(self.held):
            if end + len(self.merges.bytes[i]) > limit:
                break
            end += len(self.merges.bytes[i])
            out.append(i)
        self.held = self.held[end:]
        return out

    def end(self) -> list[int]:
        rest, self.held = self.held, b""
        return self.merges.merge(rest)


class Classes(dict):
    """Signs to others of their class, where that class isn't in the pattern; asked of the tokenizer's own splitter.

    Its tables of letters and digits are of another Unicode version than Python's.
    """

    def __init__(self, path: str) -> None:
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.stands = {}
        groups = {"L": "", "N": "", "O": "", "S": ""}
        for code in range(NEAR):
            groups[self.kind(chr(code))] += f"\\u{code:04x}"
        for kind, sign in (("L", "a"), ("N", "1"), ("O", "!"), ("S", "\t")):
            self.stands[kind] = sign
        letters, digits, blanks = groups["L"], groups["N"], groups["S"]
        self.piece = re.compile(
            f"'(?:s|t|re|ve|m|ll|d)| ?[{letters}]+| ?[{digits}]+| ?[^{blanks}{letters}{digits}]+|[{blanks}]+(?![^{blanks}])|[{blanks}]+"
        )
        self.run = {
            "L": re.compile(f"[{letters}]*"),
            "N": re.compile(f"[{digits}]*"),
            "O": re.compile(f"[^{blanks}{letters}{digits}]*"),
            "S": re.compile(f"[{blanks}]*"),
        }

    def kind(self, sign: str) -> str:
        """L, N, S or O: letter, digit, blank or other."""
        for kind, beside in (("L", "a"), ("N", "1"), ("O", "!")):
            if len(self.split(beside + sign)) == 1:
                return kind
        return "S"

    def __missing__(self, code: int) -> int:
        if len(self) > 1 << 16:
            self.clear()
        self[code] = found = code if code < NEAR else ord(self.stands[self.kind(chr(code))])
        return found

    def shape(self, text: str) -> str:
        """``text`` with all far signs replaced, as long as it was."""
        if text.isascii():
            return text
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text.translate(self)
        return text


class _Remembered(dict):
    """Pieces to their ids."""

    def __init__(self, merges: Merges) -> None:
        self.merges = merges

    def __missing__(self, piece: str) -> bytes:
        if len(piece) > LONG:
            window = Window(self.merges)
            return array("i", window.push(piece.encode()) + window.end()).tobytes()
        ids = array("i", self.merges.merge(piece.encode())).tobytes()
        if len(piece) <= REMEMBERED:
            if len(self) >= PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """A transducer from text to 32-bit ids: ``feed`` gives those that are final, ``end`` the rest."""

    def __init__(self, path: str) -> None:
        self.merges, self.classes = Merges(path), Classes(path)
        self.known = _Remembered(self.merges)
        self.longest = max(map(len, self.merges.special), default=0)
        self.cut = re.compile("|".join(map(re.escape, sorted(self.merges.special, key=len, reverse=True))) or "(?!)")
        self._reset()

    def _reset(self) -> None:
        self.held, self.tail, self.window, self.within = "", "", None, ""

    def _pieces(self, text: str) -> list[str]:
        shape = self.classes.shape(text)
        if shape is text:
            return self.classes.piece.findall(text)
        return [text[m.start() : m.end()] for m in self.classes.piece.finditer(shape)]

    def _split(self, text: str, last: bool) -> Iterator[bytes]:
        """Ids of the pieces that end within what was read, or of all if it is the last of a stretch."""
        text, self.held = self.held + text, ""
        if self.window:
            at = self.classes.run[self.within].match(self.classes.shape(text)).end()
            # The last blank before a sign goes with that sign.
            goes = at - 1 if self.within == "S" and at and not (last and at == len(text)) else at
            yield array("i", self.window.push(text[:goes].encode())).tobytes()
            text = text[goes:]
            if at < goes + len(text) or last:
                yield array("i", self.window.end()).tobytes()
                self.window = None
            else:
                self.held = text
                return
        if not text:
            return
        pieces = self._pieces(text)
        if last:
            yield b"".join(map(self.known.__getitem__, pieces))
            return
        # What a piece looked at to end where it does: the sign after it, and two signs after its own first.
        start = len(text)
        keep = 0
        while pieces and keep < len(pieces):
            piece = pieces[-1 - keep]
            start -= len(piece)
            if start + len(piece) < len(text) and start + 3 <= len(text):
                start += len(piece)
                break
            keep += 1
        done = pieces[: len(pieces) - keep]
        yield b"".join(map(self.known.__getitem__, done))
        rest = text[sum(map(len, done)) :]
        if keep == 1 and len(rest) > LONG:
            self.within = self.classes.kind(rest[-1])
            goes = len(rest) - (self.within == "S")
            self.window = Window(self.merges)
            yield array("i", self.window.push(rest[:goes].encode())).tobytes()
            rest = rest[goes:]
        self.held = rest

    def feed(self, text: str, last: bool = False) -> Iterator[bytes]:
        """Ids that are final once ``text`` was read after all that came before; all of them if it is the last."""
        text, self.tail = self.tail + text, ""
        at = 0
        for found in self.cut.finditer(text):
            yield from self._split(text[at : found.start()], True)
            yield self.merges.special[found.group()].to_bytes(4, "little")
            at = found.end()
        text = text[at:]
        if not last:
            # The beginning of a special token may be its whole string once more is read.
            for size in range(min(self.longest - 1, len(text)), 0, -1):
                if any(s.startswith(text[-size:]) for s in self.merges.special):
                    text, self.tail = text[:-size], text[-size:]
                    break
        yield from self._split(text, last)
        if last:
            self._reset()

    def encode(self, text: str, chunk: int = CHUNK) -> bytes:
        """Ids of a whole text, read ``chunk`` signs at a time."""
        if len(text) <= chunk and self.cut.search(text) is None:
            return b"".join(map(self.known.__getitem__, self._pieces(text)))
        out = []
        for at in range(0, len(text), chunk):
            out += self.feed(text[at : at + chunk], at + chunk >= len(text))
        return b"".join(out)


class Decoder:
    """A machine from ids to text: between ids it keeps at most the three bytes of an unfinished character."""

    def __init__(self, merges: Merges) -> None:
        self.bytes, self.left = merges.bytes, b""

    def feed(self, ids: list[int | None], last: bool = False) -> str:
        """The text that is certain now; ids out of the vocabulary and nulls have none."""
        size = len(self.bytes)
        try:
            body = self.left + b"".join([self.bytes[i] for i in ids])
            sound = not ids or min(ids) >= 0
        except (IndexError, TypeError):
            sound = False
        if not sound:
            body = self.left + b"".join([self.bytes[i] for i in ids if i is not None and 0 <= i < size])
        text, used = codecs.utf_8_decode(body, "replace", last)
        self.left = body[used:]
        return text


@cache
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker, so that what it remembers serves the next task too."""
    return Encoder(path)


def default_path() -> str:
    return public_tokenizers.path(VOCABULARY)


def _lists(buffers: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(b) // 4 for b in buffers)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(buffers), np.int32)))


def _encoding(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            ids = [encode((b.as_py() or b"").decode("utf-8", "replace")) for b in batch.column("body")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), _lists(ids)], names=["key", "ids"])

    return run


def _decoding(path: str, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = encoder(path).merges
        for batch in batches:
            said = []
            for ids in batch.column("ids"):
                machine, out = Decoder(merges), []
                values = ids.values
                for at in range(0, 0 if values is None else len(values), chunk):
                    out.append(machine.feed(values.slice(at, chunk).to_pylist()))
                out.append(machine.feed([], True))
                said.append("".join(out))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("ids"), pa.array(said, pa.string())], names=["key", "ids", "text"]
            )

    return run


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids) of every row: the ids of the whole text, as the tokenizer file ``path`` gives them.

    Nothing is added before or after; the string of a special token is that token. Null and empty texts have
    no ids. Repeated rows and null keys are rows like any other; other columns are ignored; no rows
    give no rows.
    """
    kind = documents.schema[key].dataType.simpleString()
    found = texts(documents, key, text).mapInArrow(_encoding(path or default_path()), f"key {kind}, ids array<int>")
    return found.withColumnRenamed("key", key)


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """(key, ids, text) of every row of ids, special tokens by their strings.

    Bytes that are no UTF-8 become U+FFFD. Null ids and those beyond the vocabulary have no text; a null list
    has the empty one. Repeated rows and null keys are rows like any other; other columns are
    ignored; no rows give no rows.
    """
    small_batches(encoded.sparkSession)
    kind = encoded.schema[key].dataType.simpleString()
    rows = encoded.select(F.col(key).alias("key"), F.col(ids).cast("array<int>").alias("ids"))
    said = rows.mapInArrow(_decoding(path or default_path(), CHUNK), f"key {kind}, ids array<int>, text string")
    return said.select(F.col("key").alias(key), F.col("ids").alias(ids), "text")


def digests(decoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of ``decode``'s rows."""
    return decoded.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("text"), 256).alias("decoded_sha256"),
    )
