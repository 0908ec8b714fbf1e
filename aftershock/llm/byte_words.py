"""Words of many texts at once, as spans and hashes over their bytes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# An odd multiplier, its inverse modulo 2**64 is derived from it.
BASE = 0x9E3779B97F4A7C15
MIX = 0xD6E8FEB86659FD93
# Bytes handled at once; temporary arrays take about 30 times that. A slice that ends with a long word may have
# this many more; beyond that, words are hashed one by one.
SLICE = 1 << 20
LONGER = 1 << 16


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    size = SLICE + LONGER + 1
    inverse = pow(BASE, -1, 2**64)
    both = []
    for factor in (BASE, inverse):
        powers = np.full(size, factor, np.uint64)
        powers[0] = 1
        both.append(np.multiply.accumulate(powers))
    return both[0], both[1]


def mixed(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(MIX)
    return values ^ (values >> np.uint64(29))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, the same wherever the bytes stand."""
    sums = np.zeros(len(data) + 1, np.uint64)
    if len(data) <= SLICE + LONGER:
        forward, back = _powers()
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * forward[: len(data)], out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * back[starts]
    else:  # a slice with a word longer than itself: hashed in parts
        hashes = np.array([_long_hash(data[a:b]) for a, b in zip(starts, ends)], np.uint64)
    return mixed(hashes + (ends - starts).astype(np.uint64) * np.uint64(BASE))


def _long_hash(data: np.ndarray) -> np.uint64:
    forward, _ = _powers()
    total, factor = 0, 1
    for at in range(0, len(data), SLICE):
        part = data[at : at + SLICE].astype(np.uint64) + np.uint64(1)
        total += int((part * forward[: len(part)]).sum(dtype=np.uint64)) * factor
        factor = factor * pow(BASE, SLICE, 2**64) % 2**64
    return np.uint64(total % 2**64)


def spans(data: np.ndarray, limits: np.ndarray, spaces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words: runs of bytes that are no spaces, within the limits of a text."""
    inside = ~spaces[data]
    flags = np.zeros(len(data) + 2, bool)
    flags[1:-1] = inside
    first = inside & ~flags[:-2]
    last = inside & ~flags[2:]
    edge = limits[(limits > 0) & (limits < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def slices(data: np.ndarray, limits: np.ndarray, spaces: np.ndarray, size: int = SLICE) -> list[tuple[int, int]]:
    """Byte ranges of about ``size`` that end with a text, or after a space within a long one."""
    found, at = [], 0
    while at < len(data):
        if len(data) - at <= size:
            cut = len(data)
        else:
            fits = limits[np.searchsorted(limits, at + size, side="right") - 1]
            if fits > at:
                cut = int(fits)
            else:
                window = np.flatnonzero(spaces[data[at : at + size]])
                if len(window):
                    cut = at + int(window[-1]) + 1
                else:
                    later = np.flatnonzero(spaces[data[at + size :]])
                    cut = at + size + int(later[0]) + 1 if len(later) else len(data)
                over = limits[np.searchsorted(limits, at, side="right") :]
                cut = min(cut, int(over[0])) if len(over) else cut
        found.append((at, cut))
        at = cut
    return found


def table(*members: int) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[list(members)] = True
    return flags


def word_hashes(data: np.ndarray, limits: np.ndarray, spaces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the limits of the texts among them."""
    hashes, upto, before = [np.zeros(0, np.uint64)], np.zeros(len(limits), np.int64), 0
    for a, b in slices(data, limits, spaces):
        low, high = np.searchsorted(limits, [a, b], side="right")
        inner = limits[low:high] - a
        starts, ends = spans(data[a:b], inner, spaces)
        upto[low:high] = before + np.searchsorted(ends, inner, side="right")
        before += len(starts)
        hashes.append(span_hashes(data[a:b], starts, ends))
    return np.concatenate(hashes), np.maximum.accumulate(upto)


# Space and \t \n \v \f \r separate words; A-Z become lower case.
WHITE = table(0x20, *range(0x09, 0x0E))
LOWER_ASCII = np.array([c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)], np.uint8)
