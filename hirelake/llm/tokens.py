"""Token ids of whole texts, by a tokenizer file, with a memory of the words already seen.

The tokenizer never joins characters over white space, so a text's ids are those of its
white-space-separated chunks in turn.  Chunks repeat, so most of them need a dictionary look-up.
"""

from __future__ import annotations

import re

import numpy as np

from .common import held

#: Characters that Python's ``split`` takes for white space and the tokenizer does not.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_TAIL = re.compile(r"([^\W\d_]+)([.,;:!?|]+)")


#: What an entry of a dictionary takes besides its letters and ids: two objects' heads and its place.
_ENTRY = 200


class Memory(dict):
    """Ids by text, of about ``most`` bytes: what was used since half of it was last full, and what was before that."""

    def __init__(self, most: int):
        self.room = self.half = most // 2
        self.old: dict[str, bytes] = {}

    def keep(self, text: str, ids: bytes) -> None:
        self.room -= _ENTRY + len(text) + len(ids)
        if self.room < 0:
            self.old = dict(self)
            self.clear()
            self.room = self.half
        self[text] = ids


class TokenBytes:
    """ids(text) as little-endian unsigned 32-bit bytes; memories of chunks and of their words."""

    def __init__(self, path: str, chunks: int = 128 << 20, words: int = 224 << 20):
        from tokenizers import Tokenizer

        self._encode = Tokenizer.from_file(path).encode
        self._chunks, self._words = Memory(chunks), Memory(words)

    def _direct(self, text: str) -> bytes:
        return np.array(self._encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """Lower-cased letters, or punctuation."""
        got = self._words.get(word)
        if got is None:
            got = self._words.old.get(word) or self._direct(word)
            if len(word) <= 40:
                self._words.keep(word, got)
        return got

    def _chunk(self, chunk: str) -> bytes:
        if old := self._chunks.old.get(chunk):
            self._chunks.keep(chunk, old)
            return old
        # Letters up to U+00FF are lower-cased one by one and have no other normal form.
        if len(chunk) <= 64 and (chunk.isascii() or max(chunk) < "Ā"):
            if chunk.isalpha():
                got = self._word(chunk.lower())
            elif m := _TAIL.fullmatch(chunk):
                got = self._word(m[1].lower()) + self._word(m[2])
            else:
                got = self._direct(chunk)
        else:
            got = self._direct(chunk)
        if len(chunk) <= 64:
            self._chunks.keep(chunk, got)
        return got

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _ODD_SPACE.search(text):
            return self._direct(text)
        get, new = self._chunks.get, self._chunk
        return b"".join([get(x) or new(x) for x in text.split()])


def token_bytes(path: str, *memory: int) -> TokenBytes:
    """The process's own instance for a tokenizer file; ``memory``: bytes for chunks and for words."""
    return held(("tokens", path, *memory), lambda: TokenBytes(path, *memory))
