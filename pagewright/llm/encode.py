"""Whole texts to token ids with the ``tokenizers`` library, with a bounded cache of words."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

#: A piece begins at a space before something that is no white space: the tokenizer's pattern always
#: starts a new unit there, so pieces encode independently and join to the ids of the whole text.
_CUT = re.compile(r" (?=\S)")
_LOOSE = re.compile(r" \s")
_MARKS = tuple(",.!?;:")


class Encoder:
    """Little-endian unsigned 32-bit ids of texts: the same ids as the library's call for each whole text.

    Units of the tokenizer's pattern go through the library's merge model; ids of words are kept. ``cache_words``
    bounds the memory: at half of it the kept words become the old ones, of which only those met again stay. A text that holds an added token (such as ``<|endoftext|>``) goes through the library whole.
    """

    def __init__(self, path: str, cache_words: int = 1_200_000):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.added = tuple(t.content for t in self.whole.get_added_tokens_decoder().values())
        self.model = self.whole.model.tokenize
        self.units_of = regex.compile(public_tokenizers.PATTERN).findall
        # The byte-level alphabet: printable Latin-1 stands for itself, other bytes for U+0100 and on.
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = [b for b in range(256) if b not in plain]
        self.alphabet = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.space = self.alphabet[32]
        self.of_id = [i.to_bytes(4, "little") for i in range(self.whole.get_vocab_size())]
        # Plain dicts of strings and bytes, which the garbage collector doesn't walk.
        self.after_space: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.at_start: dict[str, bytes] = {}
        self.marks = {m: self._ids(m) for m in _MARKS}
        self.newline = self._ids(self.alphabet[10])
        self.limit = cache_words

    def _ids(self, unit: str) -> bytes:
        """``unit`` in the byte-level alphabet."""
        of_id = self.of_id
        return b"".join([of_id[t.id] for t in self.model(unit)])

    def _spelled(self, unit: str) -> str:
        return unit.encode().decode("latin-1").translate(self.alphabet)

    def _at_start(self, unit: str) -> bytes:
        ids = self.at_start.get(unit)
        if ids is None:
            ids = self.at_start[unit] = self._ids(unit if unit.isascii() and unit.isalpha() else self._spelled(unit))
        return ids

    def _word(self, word: str) -> bytes:
        """Letters alone, after a space."""
        ids = self.after_space.get(word)
        if ids is None:
            ids = self.after_space[word] = self.before.get(word) or self._ids(self.space + (word if word.isascii() else self._spelled(word)))
        return ids

    def _piece(self, piece: str) -> bytes:
        """A piece that is not kept yet, after a space."""
        if piece.isalpha():
            return self._word(piece)
        ids = self.before.get(piece)
        if ids is not None:
            self.after_space[piece] = ids
            return ids
        mark = self.marks.get(piece[-1:])
        if mark and piece[:-1].isalpha():
            ids = self.after_space[piece] = self._word(piece[:-1]) + mark
            return ids
        left, line, right = piece.partition("\n")
        if line and right.isalpha():
            mark = self.marks.get(left[-1:])
            if mark and left[:-1].isalpha():
                return self._word(left[:-1]) + mark + self.newline + self._at_start(right)
            if left.isalpha():
                return self._word(left) + self.newline + self._at_start(right)
        ids = b"".join(map(self._at_start, self.units_of(" " + piece)))
        if not line:
            self.after_space[piece] = ids
        return ids

    def encode_one(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(map(text.__contains__, self.added)):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if 2 * (len(self.after_space) + len(self.at_start)) > self.limit:
            self.before, self.after_space = self.after_space, {}
            self.at_start.clear()
        first, *rest = _CUT.split(text) if _LOOSE.search(text) else text.split(" ")
        get, piece = self.after_space.get, self._piece
        return b"".join([*map(self._at_start, self.units_of(first)), *[get(p) or piece(p) for p in rest]])

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        return [self.encode_one(t) for t in texts]


@lru_cache(maxsize=2)
def encoder(path: str | None = None) -> Encoder:
    """One for each Python worker. Without a path: the public byte-level BPE of 50,257 ids."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return Encoder(path)


def in_blocks(texts: Sequence, characters: int = 4_000_000, weight=lambda t: len(t or "")):
    """Cut a batch into runs of texts of bounded length, so that a few long texts don't fill the memory."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + weight(t) > characters:
            yield at, i
            at, size = i, 0
        size += weight(t) + 1
    if at < len(texts):
        yield at, len(texts)
