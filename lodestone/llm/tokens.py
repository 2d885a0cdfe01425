"""Token ids of whole texts from a public tokenizer file, with a bounded cache of words."""

from __future__ import annotations

import struct
import unicodedata
from functools import lru_cache

#: Words whose ids one generation of a Python worker's cache holds; two generations are kept.
CACHE_WORDS = 250_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_TAIL = b".,;:!?*$%&#)"
#: Byte-level alphabet: printable bytes stand for themselves, the others for the letters from 256 on.
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}


def default_path() -> str:
    """Where the word tokenizer's file is; its package is installed on every node."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokens(dict):
    """Word (UTF-8, ASCII lower case) -> its ids as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never joins what it separates, and it lowers case,
    so a text's ids are the ids of its words in turn. Marks behind a word are a token run of
    their own, so such words are looked up in two parts.
    """

    def __init__(self, path: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_path())
        self.model, self.older = self.tokenizer.model, {}

    def _encode(self, word: bytes) -> bytes:
        text = word.decode()
        if text.isalpha() and "Σ" not in text:  # a single piece: normalised here, merged by the model alone
            low = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower()
            if low.isalpha():
                piece = low.encode().decode("latin-1").translate(_BYTE_LETTERS)
                return struct.pack(f"<{len(found)}I", *found) if (found := [t.id for t in self.model.tokenize(piece)]) else b""
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: bytes) -> bytes:
        if (found := self.older.get(word)) is not None:
            self[word] = found
            return found
        core = word.rstrip(_TAIL)
        if core and core != word and b"<" not in core and unicodedata.category(core[-4:].decode(errors="ignore")[-1:] or " ")[0] in "LN":
            found = self[core] + self[word[len(core) :]]
        else:
            found = self._encode(word)
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found

    def ids(self, text: bytes | None) -> bytes:
        """The ids of the whole text as bytes, four each."""
        if not text:
            return b""
        if b"<|" in text:  # a special token's name may hold capitals
            return b"".join(map(self._encode, text.split()))
        return b"".join(map(self.__getitem__, text.translate(_LOWER).split()))


@lru_cache(maxsize=2)
def worker_tokens(path: str | None = None) -> WordTokens:
    """The tokenizer and its cache, kept for all tasks of one Python worker."""
    return WordTokens(path)
