"""Splitting text into the pieces that a byte-level BPE model encodes independently."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

# The public splitting pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The same splits by the faster standard module, for text of ASCII, and of Latin-1 alone.
ASCII_PATTERN = r" ?[A-Za-z]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
LATIN_PATTERN = r" ?[^\W\d_]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"

#: Latin-1 characters that the two modules class differently.
ODD_LATIN = bytes([*range(0x1C, 0x20), 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE])

#: Pieces handed on at a time, so that a very long text needs no list of all its pieces.
RUN = 200_000


@lru_cache(1)
def _patterns():
    import regex

    return re.compile(ASCII_PATTERN), re.compile(LATIN_PATTERN), regex.compile(PATTERN)


def _pattern(text: str):
    plain, latin, full = _patterns()
    if text.isascii():
        return plain
    try:
        data = text.encode("latin-1")
    except UnicodeEncodeError:
        return full
    return latin if len(data.translate(None, ODD_LATIN)) == len(data) else full


def pieces(text: str) -> list[str]:
    return _pattern(text).findall(text)


def piece_runs(text: str, run: int = RUN) -> Iterator[list[str]]:
    """The pieces of a text in lists of at most ``run``."""
    if len(text) <= run:
        yield pieces(text)
        return
    found = (m.group() for m in _pattern(text).finditer(text))
    while part := list(islice(found, run)):
        yield part


def split_specials(text: str, specials: dict[str, int], matcher) -> Iterator[str | int]:
    """Plain stretches of a text, and the ids of the special strings between them."""
    if matcher is None:
        yield text
        return
    at = 0
    for m in matcher.finditer(text):
        if m.start() > at:
            yield text[at : m.start()]
        yield specials[m.group()]
        at = m.end()
    if at < len(text):
        yield text[at:]


def special_matcher(specials: dict[str, int]):
    """Longest special string first, so that one that starts another does not hide it."""
    return re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
