"""Words and word shingles of many texts at once, as 64-bit hashes, in numpy.

Texts are handled as UTF-8 bytes, in buffers of about BUFFER bytes (a longer text
is a buffer by itself). A-Z is lower-cased, other letters stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BUFFER = 2 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Space and tab to carriage return end a word.
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
#: All of ASCII but letters and digits end a word.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_BASE, _COMBINE = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """Powers of the base modulo 2**64, at least n of them."""
    global _powers
    if len(_powers) < n:
        base = np.full(max(n, 2 * len(_powers), 256), np.uint64(_BASE))
        base[0] = 1
        _powers = np.multiply.accumulate(base)
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffers(texts: list[bytes], size: int = BUFFER) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts) of runs of texts of about size bytes."""
    at = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > size:
            yield at, texts[at:i]
            at, held = i, 0
        held += len(t) + 1
    if at < len(texts):
        yield at, texts[at:]


def word_hashes(texts: list[bytes], ends_word: np.ndarray = BLANK, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """(hash of each word, number of words of each text), and for each of prefixes the hash
    of each word's first bytes, so many at most (from the longest prefix to the shortest)."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    raw = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    inside = ~ends_word[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    bounds = np.cumsum(lens + 1)
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, bounds))))
    if not len(starts):
        empty = np.zeros(0, np.uint64)
        return empty, counts, *[empty] * len(prefixes)
    size = ends - starts
    values = raw[inside].astype(np.uint64) + np.uint64(1)
    first = np.cumsum(size) - size
    place = np.arange(len(values)) - np.repeat(first, size)
    values *= powers(int(size.max()))[place]
    whole = mixed(np.add.reduceat(values, first))
    heads = []
    for n in sorted(prefixes, reverse=True):
        values[place >= n] = 0
        heads.append(mixed(np.add.reduceat(values, first) ^ np.uint64(0x5851F42D4C957F2D * n % 2**64)))
    return whole, counts, *heads


def shingle_sets(texts: list[bytes], n: int = 5, short_whole: bool = True) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of the n-word shingles of each text. With fewer than n
    words the whole sequence counts as one (or as none); without words the set is empty."""
    for _, part in buffers(texts):
        words, counts = word_hashes(part)
        ends = np.cumsum(counts)
        total = len(words)
        h = np.zeros(max(0, total - n + 1), np.uint64)
        for k in range(n):
            h = h * np.uint64(_COMBINE) + words[k : total - n + 1 + k] if len(h) else h
        h = mixed(h)
        for end, count in zip(ends.tolist(), counts.tolist(), strict=True):
            if count >= n:
                yield np.unique(h[end - count : end - n + 1])
            elif count and short_whole:
                yield np.array([sequence_hash(words[end - count : end], count)], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def sequence_hash(words: np.ndarray, salt: int) -> np.uint64:
    """The hash of one short sequence of words, apart from those of other lengths."""
    h = 0
    for w in words.tolist():
        h = (h * _COMBINE + w) % 2**64
    return mixed(np.array([(h + salt * 0x632BE59BD9B4E019) % 2**64], np.uint64))[0]
