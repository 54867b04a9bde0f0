"""Word shingles as arrays of 64-bit hashes."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Distinct words whose hashes a worker keeps; the table starts anew beyond.
KEPT_WORDS = 150_000

WORD = re.compile(r"\w+")
_PLAIN = bytes(ord(c.lower()) if (c := chr(b)).isascii() and (c.isalnum() or c == "_") else 32 for b in range(256))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


class WordCodes(dict):
    """Hashes of words (bytes or str), computed once each."""

    def __missing__(self, word):
        if len(self) >= KEPT_WORDS:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


_codes = WordCodes()


def forget_words() -> None:
    """Empty the table of word hashes; at a task's end, since a word costs little to hash again."""
    _codes.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on each other."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ascii_words(text: str) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def plain_words(text: str) -> list:
    """Runs of letters, digits and underscores in lower case; of a text in ASCII as bytes, which hash alike."""
    return text.encode("ascii").translate(_PLAIN).split() if text.isascii() else WORD.findall(text.lower())


def shingles(words: list, n: int) -> np.ndarray:
    """Hash of the shingle that starts at each word; of fewer than n words, one hash of the whole sequence."""
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(_codes.__getitem__, words), np.uint64, len(words))
    if len(codes) < n:
        codes = np.concatenate([codes, np.full(n - len(codes), len(words), np.uint64)])
    size = len(codes) - n + 1
    total = codes[:size] * _ODD[0]
    for k in range(1, n):
        total += mix(codes[k : k + size] + _ODD[k % 8]) * _ODD[k % 8] if n > 8 else codes[k : k + size] * _ODD[k]
    return mix(total)


def shingle_set(words: list, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    found = np.sort(shingles(words, n))
    return found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found
