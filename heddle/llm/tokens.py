"""Token ids by a public word-level BPE vocabulary, with caches for repeated words.

The vocabulary's rules lower-case a text, then cut it into runs of letters,
single digits, runs of other marks and a few English endings, and never reach
over white space. A text of ASCII and Latin-1 characters is cut in one pass
here and its parts are given to the BPE model directly, each distinct part once
per cache; any other text goes chunk by chunk, those with other characters
through the tokenizer as a whole. Both give what encoding the text gives.
"""

from __future__ import annotations

import re
import struct

from tokenizers import Tokenizer

#: Entries of each cache before it is started anew, and the longest text that one keeps: at most some 250 bytes an entry.
CACHED, LONGEST = 250_000, 32

#: Characters that NFC leaves alone and whose class and lower case are plain: ASCII without controls, and the letters of Latin-1.
_PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*").fullmatch
_PARTS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\t-\r ]+").findall


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Cache(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= CACHED:
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.words = _Cache(self._word)
        self.chunks = _Cache(self._chunk)

    def _word(self, word: str) -> bytes:
        if not word.isascii():
            word = "".join(map(self.letters.__getitem__, word.encode()))
        ids = [t.id for t in self.model.tokenize(word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if _PLAIN(text) and "<|" not in text:
            return b"".join(map(self.words.__getitem__, _PARTS(text.lower())))
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        if _PLAIN(text) and "<|" not in text:
            return b"".join(map(self.words.__getitem__, _PARTS(text.lower())))
        # bytes.split() cuts at ASCII white space only; other white space stays inside a chunk.
        return b"".join(map(self.chunks.__getitem__, text.encode().split()))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for the vocabulary file at ``path``."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
