"""Token ids by the public word BPE, as little-endian buffers, with a bounded memory of words.

The tokenizer's normalizer and splitter act on each run of letters, single digit or
run of other signs by itself, so a text's ids are its pieces' ids in a row. Texts within
Latin-1 are cut by one regular expression over lower-case bytes and each piece is
looked up among those already encoded; any other text, and one with a special
token in it, goes to the tokenizer whole.
"""

import re
from array import array
from functools import cache

import public_tokenizers
from tokenizers import Tokenizer

from agentmeter.llm.common import KEPT

VOCABULARY = "word_bpe_49k.json"
#: Pieces remembered by a Python worker; beyond it the memory starts anew.
PIECES = 300_000


_SIGNS = bytes(range(256)).decode("latin-1")


def _shown() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(hidden)) for b in range(256)]


def _classes() -> dict[str, str]:
    """Latin-1 in lower case as escapes by class: letters, digits and blanks as the tokenizer's patterns see them."""
    pick = lambda keep: "".join(f"\\x{ord(c):02x}" for c in _SIGNS if keep(c))
    return {
        "L": pick(str.isalpha),
        "N": pick(lambda c: c.isnumeric()),
        "S": "".join(f"\\x{b:02x}" for b in (9, 10, 11, 12, 13, 32, 0x85, 0xA0)),
    }


_PIECE = re.compile(
    "[{L}]+|'(?:s|t|re|ve|m|ll|d)|[{N}]|[^{S}{L}{N}]+".format(**_classes()).encode("latin-1")
)


class Encoder:
    """Ids of whole texts, ``width`` bytes each; equal to the tokenizer's own.

    With ``plain`` the strings of special tokens are ordinary text.
    """

    def __init__(self, path: str, width: int = 4, plain: bool = False) -> None:
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = plain
        # array() writes in the machine's order, which is little-endian wherever Spark runs.
        self.kind, self.tokenizer = {2: "H", 4: "I"}[width], tokenizer
        # What the splitter does to the bytes of a piece before the model sees them.
        self.shown = {ord(c): shown for c, shown in zip(_SIGNS, _shown(), strict=True)}
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.pieces = _Pieces(self)

    def pack(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return array(self.kind, ids).tobytes()

    def pack_piece(self, piece: bytes) -> bytes:
        """The ids of one piece, straight from the model."""
        signs = piece if piece.isascii() else piece.decode("latin-1").encode("utf-8")
        found = self.tokenizer.model.tokenize(signs.decode("latin-1").translate(self.shown))
        return array(self.kind, [t.id for t in found]).tobytes()

    def encode(self, body: bytes | None) -> bytes:
        """The ids of a text in UTF-8; none for a null or empty one."""
        text = (body or b"").decode("utf-8", "replace")
        try:
            signs = text.lower().encode("latin-1")
        except UnicodeEncodeError:
            return self.pack(text)
        if any(s in text for s in self.special) or not text.isascii() and not _plain(text):
            return self.pack(text)
        return b"".join(map(self.pieces.__getitem__, _PIECE.findall(signs)))


def _plain(text: str) -> bool:
    """Whether the text itself, not only its lower case, is Latin-1."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class _Pieces(dict):
    def __init__(self, encoder: Encoder) -> None:
        self.encoder = encoder

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) >= PIECES:
            self.clear()
        self[piece] = ids = self.encoder.pack_piece(piece)
        return ids


@cache
def encoder(path: str, width: int = 4, plain: bool = False) -> Encoder:
    """One encoder for each Python worker, so that what it remembers serves the next task too."""
    return Encoder(path, width, plain)


KEPT.append(encoder.cache_clear)


def default_path() -> str:
    return public_tokenizers.path(VOCABULARY)
