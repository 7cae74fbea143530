"""Cutting texts into pre-tokens fast, and a bounded cache from pre-token to ids.

Byte-level BPE works on each pre-token alone, so a worker encodes each distinct
pre-token once and looks up the rest.  Unicode tables differ between regular
expression engines in recently assigned characters.  Texts below U+0530 take
the standard library's engine with spelled-out classes, texts in blocks on
which the engines agree take the ``regex`` module, and any other text goes to
the tokenizer whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import regex

_EDGE = 0x530


def _class(kind: str) -> str:
    """Characters below U+0530 of one Unicode class, as ranges for a character class."""
    points = [c for c in range(_EDGE) if regex.match(kind, chr(c))]
    ranges, low = [], points[0]
    for a, b in zip(points, [*points[1:], -1], strict=True):
        if b != a + 1:
            ranges.append(f"{re.escape(chr(low))}-{re.escape(chr(a))}")
            low = b
    return "".join(ranges)


LETTER, NUMBER, SPACE = _class(r"\p{L}"), _class(r"\p{N}"), _class(r"\s")
NARROW = re.compile(f"[\x00-{chr(_EDGE - 1)}]*")
#: Blocks in which the engines' classes agree.
AGREED = re.compile("[\x00-՗ -₎℀-⅏　-ㆎ㐀-䶿一-鿯가-힣\U0001f300-\U0001f64f]*")


def byte_level_narrow() -> re.Pattern[str]:
    """The byte-level split for texts below U+0530; letters first, as they are most of a text."""
    s, l, n = SPACE, LETTER, NUMBER  # noqa: E741
    return re.compile(f" ?[{l}]+|'(?:[stmd]|re|ve|ll)| ?[{n}]+| ?[^{s}{l}{n}]+|[{s}]+(?![^{s}])|[{s}]+")


def lower_words_narrow() -> re.Pattern[str]:
    """The split of the word-end vocabulary for lower-cased texts below U+0530."""
    s, l, n = SPACE, LETTER, NUMBER  # noqa: E741
    return re.compile(f"[{l}]+|'(?:[stmd]|re|ve|ll)|[{n}]|[^{s}{l}{n}]+")


class PreTokens:
    """``cut(text)``: the pre-tokens, or None where only the tokenizer itself can tell."""

    def __init__(self, narrow: re.Pattern[str], pattern: str) -> None:
        self.narrow, self.wide = narrow.findall, regex.compile(pattern).findall

    @staticmethod
    def agreed(text: str) -> bool:
        """Whether all engines split the text alike."""
        return text.isascii() or bool(NARROW.fullmatch(text)) or bool(AGREED.fullmatch(text))

    def cut(self, text: str) -> list[str] | None:
        if text.isascii() or NARROW.fullmatch(text):
            return self.narrow(text)
        return self.wide(text) if AGREED.fullmatch(text) else None


class Cache(dict):
    """Pre-token to whatever is kept of it.  Emptied when it holds ``most`` entries, so a worker's memory is bounded."""

    def __init__(self, make: Callable[[list[str]], Iterable[object]], most: int = 400_000) -> None:
        super().__init__()
        self.make, self.most = make, most

    def fill(self, words: Iterable[str]) -> None:
        words = words if isinstance(words, set) else set(words)
        new = [w for w in words if w not in self]
        if len(self) + len(new) > self.most:
            self.clear()
            new = list(words)
        if new:
            self.update(zip(new, self.make(new), strict=True))
