"""Token ids of whole texts by the tokenizers library, with a memory of what was encoded before.

Both kinds of vocabulary in use (byte-level, and words with an end mark) cut a text by a public pattern first and encode
each piece by itself. For texts of common Latin characters that pattern is applied here, by one regular expression whose
letters and digits are listed, so that it can't differ from the library's. Pieces met before are looked up; the others
are encoded by the library's model. Texts with any other character, or with what may be a special token, are encoded
whole by the library. So are all texts of a tokenizer of another kind. The memory is bounded, and the ids of any text,
however long, are those of the library; null text counts as empty.
"""

from __future__ import annotations

import functools
import os
import re
from array import array
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker remembers; when that is full, the half met first (mostly the frequent ones) stays.
MEMORY, STAY = 150_000, 0.5
#: Bytes of texts cut up at once, characters of the longest piece that is remembered.
AT_ONCE, LONG = 1 << 20, 64

# The letters and numbers among the characters that are cut here, and the patterns of the two kinds.
LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-įı-ňŊ-ž"
NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACE = "\t\n\r "
BYTES_PATTERN = rf"'(?:[sdmt]|ll|ve|re)| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
WORDS_PATTERN = rf"'(?:[stmd]|re|ve|ll)|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+"
#: Byte-level vocabularies write a byte as a printable character: itself, or for the others, in order, those from U+0100 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_ODD = re.compile("[^\t\n\r\x20-\x7e\xa1-įı-ňŊ-ž‐-‧€]|<\\|")


@functools.cache
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """encode(texts): the ids of all texts end to end, and where each text's begin (and the last's end)."""

    def __init__(self, path: str) -> None:
        self.memory: dict[str, bytes] = {}
        self.library = lib = tokenizer(path)
        self.model, self.cut, self.lower = lib.model, None, False
        if getattr(lib.model, "end_of_word_suffix", None) and type(lib.pre_tokenizer).__name__ == "Sequence":
            self.cut, self.lower = re.compile(WORDS_PATTERN).findall, True
        elif lib.normalizer is None and type(lib.pre_tokenizer).__name__ == "ByteLevel":
            self.cut = re.compile(BYTES_PATTERN).findall

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.cast(pa.large_string()).fill_null("")
        sizes = pc.binary_length(texts).to_numpy().cumsum()
        found, at = [], 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + AT_ONCE)))
            found += self._some(texts.slice(at, end - at).to_pylist())
            at = end
        ends = np.cumsum([0, *map(len, found)]) >> 2
        return np.frombuffer(b"".join(found), "<u4"), ends

    def _some(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        plain = [self.cut is not None and not _ODD.search(t) for t in texts]
        whole = iter(self._library([t for t, p in zip(texts, plain) if not p]))
        pieces = [self.cut(t.lower() if self.lower else t) if p else None for t, p in zip(texts, plain)]
        memory = self.memory
        if len(memory) > MEMORY:
            self.memory = memory = dict(islice(memory.items(), int(MEMORY * STAY)))
        new = set(chain.from_iterable(p for p in pieces if p)).difference(memory)
        self._learn(new)
        known = memory.__getitem__
        out = [next(whole) if p is None else b"".join(map(known, p)) for p in pieces]
        for p in new:
            if len(p) > LONG:
                del memory[p]
        return out

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _learn(self, pieces: set[str]) -> None:
        tokenize, memory, space = self.model.tokenize, self.memory, chr(_BYTES[32])
        for p in pieces:
            if p.isascii() and p.isalpha():
                written = p
            elif p.isascii() and p[0] == " " and p[1:].isalpha():
                written = space + p[1:]
            else:
                written = p.encode().decode("latin-1").translate(_BYTES)
            memory[p] = array("I", [t.id for t in tokenize(written)]).tobytes()


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each worker process: what it has learnt serves its later tasks."""
    return Encoder(path)
