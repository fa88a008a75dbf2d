"""Text to ids by way of words: byte-level BPE treats each match of a splitting pattern alone, so results can be remembered.

A space after a character that isn't white space starts a match: the pattern's words take one leading space, and nothing that comes before can
take it. A text in which no space follows white space is cut at its spaces, and a word's ids (with the leading space)
come from a bounded table; only words not in the table meet the pattern. Other texts meet the pattern as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

#: Entries of a worker's table of words (that of matches has half as many), and the length in characters of the longest key.
CACHE, CACHED_CHARS = 1_000_000, 40
#: All characters that count as white space, each followed by a space.
_ASCII_THEN_SPACE = tuple(chr(c) + " " for c in range(128) if chr(c).isspace())
_OTHER_THEN_SPACE = tuple(chr(c) + " " for c in range(128, 0x3001) if chr(c).isspace())


def spaces_start_matches(text: str) -> bool:
    """Whether no space of the text follows white space."""
    return not any(map(text.__contains__, _ASCII_THEN_SPACE)) and (text.isascii() or not any(map(text.__contains__, _OTHER_THEN_SPACE)))


class _Memo(dict):
    """Calls ``make`` for what it lacks and forgets all when full."""

    def __init__(self, make: Callable[[str], bytes], most: int) -> None:
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) <= CACHED_CHARS:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


class Pieces:
    """split: matches of the pattern; encode: ids of one match, as bytes; sep: between the ids of two matches."""

    def __init__(self, split: Callable[[str], list[str]], encode: Callable[[str], bytes], sep: bytes, most: int = CACHE) -> None:
        self.split, self.sep = split, sep
        self.pieces = _Memo(encode, most // 2)
        self.spaced = _Memo(lambda word: self.matches(" " + word), most)

    def matches(self, text: str) -> bytes:
        return self.sep.join(map(self.pieces.__getitem__, self.split(text)))

    def joined(self, text: str) -> bytes:
        """The ids of a whole text."""
        if not spaces_start_matches(text):
            return self.matches(text)
        first, *rest = text.split(" ")
        parts = [self.matches(first)] if first else []
        parts += map(self.spaced.__getitem__, rest)
        return self.sep.join(parts)
