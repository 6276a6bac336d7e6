"""Exact byte-level BPE ids with a cache of pre-tokens.

The vocabulary's pre-tokeniser never joins a space with what stands before it unless
both of the space's neighbours are white space (or the text ends there). So a text can
be cut before every other space, each piece encoded by the ``tokenizers`` library on its
own, and the ids joined: equal to encoding the whole text, with common pieces encoded
once per Python worker. A text that holds one of the vocabulary's added tokens, which the
library finds before all else, is encoded whole.

Defined results: an empty text has no ids; lone surrogates don't occur in Spark's strings.
"""

from __future__ import annotations

import re
from array import array
from functools import cached_property, lru_cache

from tokenizers import Tokenizer

#: Pieces of a generation of the cache (two are kept per worker), and the longest piece kept.
CACHE_PIECES, CACHE_LENGTH = 350_000, 64
_HARD = re.compile(r"\s (?:\s|\Z)")


def _byte_letters() -> dict[int, str]:
    """The vocabulary's letter for each byte: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*plain}))}


_LETTERS = {b: ord(letter) for b, letter in _byte_letters().items()}
#: Letters up to here are the same to every version of Unicode in use.
_LATIN = "\u024f"
#: Marks of which a run behind letters is one pre-token: the apostrophe may begin a contraction, so it isn't among them.
MARKS = "".join(m for m in map(chr, range(33, 127)) if not m.isalnum() and m != "'")


class _Pieces(dict):
    """Ids of pieces that follow ``prefix``, encoded when first met.

    A run of Latin letters is one pre-token and goes to the library's model as it is; with
    ``MARKS`` behind it, it is that run's ids and theirs. A single line feed between two
    that aren't white space is a pre-token of its own.
    """

    def __init__(self, tokenizer: Tokenizer, prefix: str, plain: _Pieces | None = None) -> None:
        self.plain = self if plain is None else plain
        self.tokenizer, self.tokenize, self.prefix = tokenizer, tokenizer.model.tokenize, prefix
        self.older: dict[str, bytes] = {}
        self.start = prefix.translate(_LETTERS)
        self.marks = lru_cache(1 << 14)(lambda run: self._whole(run, ""))
        self.line_feed = self._whole("\n", "")

    def _whole(self, piece: str, prefix: str) -> bytes:
        return array("I", self.tokenizer.encode(prefix + piece, add_special_tokens=False).ids).tobytes()

    def __missing__(self, piece: str) -> bytes:
        out = self.older.get(piece)
        if out is not None:
            pass
        elif piece.isalpha() and (piece.isascii() or max(piece) <= _LATIN):
            letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_LETTERS)
            out = array("I", [t.id for t in self.tokenize(self.start + letters)]).tobytes()
        elif (word := piece.rstrip(MARKS)) != piece and word.isalpha() and (piece.isascii() or max(piece) <= _LATIN):
            out = self[word] + self.marks(piece[len(word) :])
        elif "\n" in piece and all(r and not r[0].isspace() and not r[-1].isspace() for r in piece.split("\n")):
            first, *rest = piece.split("\n")
            return self.line_feed.join([self[first], *[self.plain[r] for r in rest]])
        else:
            out = self._whole(piece, self.prefix)
        if len(piece) <= CACHE_LENGTH:
            if len(self) >= CACHE_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = out
        return out


class Encoder:
    """Encodes whole texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str) -> None:
        tokenizer = Tokenizer.from_file(path)
        self.path = path
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        # the library's own cache only costs time here: every piece comes to it once
        tokenizer.model._resize_cache(1)
        self.plain = _Pieces(tokenizer, "")
        self.spaced = _Pieces(tokenizer, " ", self.plain)

    @cached_property
    def whole(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(t in text for t in self.added):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        parts = text.split(" ")
        if not _HARD.search(text):
            first = self.plain[parts[0]] if parts[0] else b""
            return first + b"".join(map(self.spaced.__getitem__, parts[1:]))
        runs = [parts[0]]
        for part in parts[1:]:
            if (not runs[-1] or runs[-1][-1].isspace()) and (not part or part[0].isspace()):
                runs[-1] += " " + part
            else:
                runs.append(" " + part)
        return b"".join(self.plain[run] for run in runs if run)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and vocabulary."""
    return Encoder(path)


def default_vocabulary() -> str:
    """Path of the public byte-level vocabulary; callers may pass any other file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
