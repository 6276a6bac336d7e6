"""Exact ids of the lower-casing vocabulary with word ends, with a cache of words.

Its normaliser composes characters, lower-cases and reads white space as a separator, and
its pre-tokeniser drops white space and never joins what stands on both sides of it. White
space neither composes with nor is reordered against its neighbours, and no added token
holds any, so a text can be cut there, each part encoded on its own and the ids joined:
equal to the ``tokenizers`` library on the whole text. Python also takes four control
characters for white space, which the library doesn't; texts with one are cut at spaces.

Defined results: an empty text, or one of white space alone, has no ids.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

from tokenizers import Tokenizer

from stagewise.llm.tokens import _LATIN, _LETTERS, CACHE_LENGTH, CACHE_PIECES

_MARKS = ".,;:!?"
_CONTROLS = re.compile("[\x1c-\x1f]")


class _Words(dict):
    """Little-endian unsigned 32-bit ids of the parts between white space, encoded when first met.

    A run of Latin letters is one pre-token: lower-cased, it goes to the library's model
    as it is; with a last mark it is the ids of the part without it and the mark's. Everything else, added
    tokens included, goes through the whole library.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.model._resize_cache(1)
        self.tokenize = self.tokenizer.model.tokenize
        self.older: dict[str, bytes] = {}
        self.marks = {m: self._whole(m) for m in _MARKS}

    def _whole(self, part: str) -> bytes:
        return array("I", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()

    @staticmethod
    def _plain(part: str) -> bool:
        """Whether the part is a run of Latin letters, whose lower case has no marks of its own."""
        return part.isalpha() and (part.isascii() or max(part) <= _LATIN and part.lower().isalpha())

    def _letters(self, part: str) -> bytes:
        low = part.lower()
        if low != part:
            return self[low]
        letters = low if low.isascii() else low.encode().decode("latin-1").translate(_LETTERS)
        return array("I", [t.id for t in self.tokenize(letters)]).tobytes()

    def __missing__(self, part: str) -> bytes:
        out = self.older.get(part)
        if out is None:
            if self._plain(part):
                out = self._letters(part)
            elif part[-1:] in self.marks and self._plain(part[:-1]):
                out = self[part[:-1]] + self.marks[part[-1]]
            else:
                out = self._whole(part)
        if len(part) <= CACHE_LENGTH:
            if len(self) >= CACHE_PIECES:
                self.older = dict(self)
                self.clear()
            self[part] = out
        return out


@lru_cache(maxsize=2)
def word_encoder(path: str) -> _Words:
    """One cache for each Python worker and vocabulary."""
    return _Words(path)


def encode_words(path: str, text: str) -> bytes:
    return b"".join(map(word_encoder(path).__getitem__, text.split(" ") if _CONTROLS.search(text) else text.split()))


def word_vocabulary() -> str:
    """Path of the public vocabulary with word ends; callers may pass any other file of its kind."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
