"""Token ids of whole texts from a public tokenizer file, memoised by pre-token.

Byte-level BPE splits a text by a fixed pattern and merges inside each piece only, so the ids of
a text are the ids of its pieces in order. Each worker keeps the pieces that it has met, and has the
tokenizers library's model merge the others.
"""

from __future__ import annotations

import re
import struct

#: Characters on which the classes of ``re`` and of the tokenizer agree; other texts go the slower way.
_PLAIN = re.compile("[^\t\n\r -~À-ÖØ-öø-ɏ]")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def byte_letters() -> dict[int, str]:
    """Byte-level BPE writes a byte as a letter: printable bytes of Latin-1 as they are, the others as the letters
    from U+0100 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) if b in shown else chr(0x100 + rest.index(b)) for b in range(256)}


class _Memo(dict):
    """Piece -> its ids as little-endian unsigned 32-bit integers. Pieces of over ``LONGEST`` characters are not kept."""

    LONGEST = 64

    def __init__(self, model):
        super().__init__()
        self.tokenize, self.letters = model.tokenize, byte_letters()

    def __missing__(self, piece: str) -> bytes:
        found = self.tokenize(piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters))
        ids = struct.pack(f"<{len(found)}I", *[x.id for x in found])
        if len(piece) <= self.LONGEST:
            self[piece] = ids
        return ids


class Encoder:
    """``ids_bytes(text)``: the ids of ``Tokenizer.encode(text, add_special_tokens=False)`` with the library's default
    settings, so that an added token inside a text has its own id. At most about ``limit`` pieces are kept (some 150 MB), from one task of the
    worker to the next."""

    def __init__(self, path: str, limit: int = 600_000):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.exact = regex.compile(public_tokenizers.PATTERN)
        self.whole = Tokenizer.from_file(path)
        self.added = [x.content for x in self.whole.get_added_tokens_decoder().values()]
        self.limit, self.seen = limit, _Memo(self.whole.model)

    def forget(self) -> None:
        """At a task's end, where idle workers should hold no pieces."""
        self.seen.clear()

    def ids_bytes(self, text: str) -> bytes:
        if len(self.seen) > self.limit:
            self.seen.clear()
        if any(x in text for x in self.added):
            found = self.whole.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(found)}I", *found)
        pieces = (self.exact if _PLAIN.search(text) else _PIECES).findall(text)
        return b"".join(map(self.seen.__getitem__, pieces))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's one encoder, whose model is loaded once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
