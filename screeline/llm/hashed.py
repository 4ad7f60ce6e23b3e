"""Hashed words of texts, for models over many texts at a time."""

from __future__ import annotations

import html
import re
import zlib

import numpy as np

WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")


class _Hashes(dict):
    """Hashes of words; all that begin with a digit count as one."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = zlib.crc32(b"9" if word[0].isdigit() else word.encode("utf-8", "surrogatepass"))
        self[word] = value
        return value


_hashes = _Hashes()


def decoded(text: str) -> str:
    return html.unescape(text) if "&" in text else text


def codes(words: list[str]) -> np.ndarray:
    """The words' hashes, 32 bits each."""
    return np.fromiter(map(_hashes.__getitem__, words), np.int64, len(words))


def named(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass"))
