"""Caches from pieces of text to token ids, kept by each Python worker.

Texts repeat their words, so both tokenizing operators encode a piece once and
look it up afterwards.  A cache holds two generations of bounded size: when the
young one is full it becomes the old one, and what is asked for again moves
back.  Pieces over LONGEST are not kept.  That bounds the memory of a worker
whatever the vocabulary of the corpus.  Very long texts are encoded in segments.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import regex

LONGEST = 100
SEGMENT = 1 << 20
_BETWEEN_WORDS = regex.compile(r"(?<=[!-~]) (?=[A-Za-z])")


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """Parts of a text of about ``size`` code points, the first whole if it is shorter.

    Cuts are made before a single space between an ASCII sign and an ASCII
    letter; no token of the tokenizers used here crosses such a place.  A text
    without one for long is not cut there.
    """
    start = 0
    while len(text) - start > size:
        cut = _BETWEEN_WORDS.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


class Cache(dict):
    """A dict that fills itself, of at most ``2 * limit`` entries."""

    def __init__(self, make: Callable, limit: int = 300_000) -> None:
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > LONGEST:
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
