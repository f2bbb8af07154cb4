"""Per-text word statistics, computed on the UTF-8 bytes of one whole text.

A word is a run of bytes outside space and 0x09-0x0D, which is exactly what
``bytes.split()`` yields, so no regular expression runs over the text.
"""

from __future__ import annotations

from itertools import islice
from operator import eq

import numpy as np

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
WINDOW = 8

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def code_points(data: bytes) -> int:
    """Code points of valid UTF-8: all bytes but the continuation bytes."""
    raw = np.frombuffer(data, np.uint8)
    return int(np.count_nonzero((raw & 0xC0) != 0x80))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a ``window``-word run found at least twice, first runs included.

    Runs are hashed with a 64-bit polynomial over word hashes; runs that look
    equal are then told apart by their words, so the count is exact.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    runs = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(window):
            runs = runs * _MULTIPLIER + ids[k : k + n]
            runs ^= runs >> np.uint64(29)
    in_order = np.sort(runs)
    if not (in_order[1:] == in_order[:-1]).any():
        return 0
    order = np.argsort(runs, kind="stable")
    in_order = runs[order]
    same = in_order[1:] == in_order[:-1]
    suspect = np.zeros(n, bool)
    suspect[1:] |= same
    suspect[:-1] |= same
    starts = order[suspect]
    seen: dict[tuple, int] = {}
    for s in starts.tolist():
        key = tuple(words[s : s + window])
        seen[key] = seen.get(key, 0) + 1
    edges = np.zeros(len(words) + 1, np.int64)
    for s in starts.tolist():
        if seen[tuple(words[s : s + window])] > 1:
            edges[s] += 1
            edges[s + window] -= 1
    return int(np.count_nonzero(np.cumsum(edges[:-1]) > 0))


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_echo_words")


def text_stats(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The counts named in FIELDS; zeros for null. n_echo_words: words equal to the word before."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return 0, 0, 0, 0, 0, 0
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    with_words = [x for x in data.split(b"\n") if x.strip()]
    dup_lines = len(with_words) - len(set(with_words))
    echoes = sum(map(eq, words, islice(words, 1, None)))
    return len(words), code_points(data.translate(None, SPACES)), symbols, dup_lines, repeated_words(words), echoes
