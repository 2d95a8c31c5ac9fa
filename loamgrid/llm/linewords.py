"""Words of lines as numbers, found for many texts at once.

A text is normalised (lower case, digits as 0, words only) and encoded; words
are the runs of bytes between spaces, hashed all together from sums of powers.
"""

from __future__ import annotations

import re

import numpy as np

#: Scripts that put no spaces between words: each letter of these counts as a word.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\U00020000-\U0003ffff"
_LETTER = re.compile(f"([{_UNSPACED}])")
_OTHER = re.compile(r"[^\w\x00-\x7f]+")
_KEPT = set(b"\nabcdefghijklmnopqrstuvwxyz_0")
_BYTES = bytes(c if c in _KEPT or c > 127 else 48 if c in b"123456789" else 32 for c in range(256))
#: Different characters of a text that are replaced one by one.
FEW = 12
#: What :func:`spaced` has found, of as many characters as there are at most.
SPACED: dict[str, str] = {}
#: Bytes hashed at a time, but for longer words.
CHUNK = 1 << 18
#: Odd multipliers and their inverses modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def spaced(c: str) -> str:
    """A character that isn't ASCII as it stands among words: a space for one of no word, between spaces if it is a word."""
    found = SPACED.get(c)
    if found is None:
        found = SPACED[c] = _LETTER.sub(r" \1 ", _OTHER.sub(" ", c))
    return found


def normal(text: str) -> bytes:
    """``text`` with only words, spaces and newlines left; newlines stay where they are."""
    low = text.lower()
    if not low.isascii():
        apart = [(c, as_what) for c in set(low) if c > "\x7f" and (as_what := spaced(c)) != c]
        # a text has mostly few different ones
        if len(apart) > FEW:
            low = _LETTER.sub(r" \1 ", _OTHER.sub(" ", low))
        else:
            for c, as_what in apart:
                low = low.replace(c, as_what)
    return low.encode("utf-8", "surrogatepass").translate(_BYTES)


def line_words(line: str) -> list[bytes]:
    return normal(line).split()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, and more, of BASE and of its inverse."""
    known = POWERS.get(0)
    if known is None or len(known[0]) < n:
        size = max(n, CHUNK + 1)
        known = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b % (1 << 64), np.uint64))]) for b in (BASE, pow(BASE, -1, 1 << 64)))
        if size <= 4 * CHUNK:
            POWERS[0] = known
    return known


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs ``values[start:end]``."""
    up, down = powers(len(values) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, line, lines): a hash of each word, the line it is in, and the number of lines of each text.

    Lines are numbered over all ``texts``, which are :func:`normal`.
    """
    lines = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
    data = b"\n".join(texts)
    at, base, ids, line = 0, 0, [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    while at < len(data):
        end = min(at + CHUNK, len(data))
        if end < len(data):
            cut = max(data.rfind(b" ", at, end), data.rfind(b"\n", at, end))
            if cut < 0:
                after = [x for x in (data.find(b" ", end), data.find(b"\n", end)) if x >= 0]
                cut = min(after, default=len(data) - 1)
            end = cut + 1
        part = np.frombuffer(data, np.uint8, end - at, at)
        edges = np.flatnonzero(np.diff(np.concatenate([[1], (part <= 32).view(np.int8), [1]])))
        starts, ends = edges[::2], edges[1::2]
        ids.append(run_hashes(part.astype(np.uint64) + np.uint64(1), starts, ends))
        newlines = np.flatnonzero(part == 10)
        line.append(np.searchsorted(newlines, starts) + base)
        base += len(newlines)
        at = end
    return np.concatenate(ids), np.concatenate(line), lines
