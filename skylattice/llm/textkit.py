"""Words of many texts as numpy arrays: spans and 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Text bytes that are worked on together (a longer single text is worked on alone).
GROUP_BYTES = 1 << 20

_RNG = np.random.default_rng(20240229)
#: One odd random number per byte value; 0 is for bytes outside words.
BYTE_CODES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
POWERS = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, np.uint64))


def byte_table(test) -> np.ndarray:
    return np.array([bool(test(b)) for b in range(256)])


#: ASCII letters and digits and all bytes of non-ASCII characters.
WORD = byte_table(lambda b: b >= 128 or chr(b).isalnum())
#: As WORD, without digits.
LETTERS = byte_table(lambda b: b >= 128 or chr(b).isalpha())
#: Everything but ASCII white space.
SOLID = byte_table(lambda b: b not in (32, 9, 10, 11, 12, 13))


def mix(h: np.ndarray) -> np.ndarray:
    """Final mixing of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def groups(texts: list[str]) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Runs of texts of about GROUP_BYTES: (first, last + 1, bytes joined by a space, start offset of each text and the end)."""
    at = 0
    encoded = [t.encode("utf-8", "replace") for t in texts]
    while at < len(encoded):
        stop, size = at, 0
        while stop < len(encoded) and (stop == at or size + len(encoded[stop]) <= GROUP_BYTES):
            size += len(encoded[stop]) + 1
            stop += 1
        part = encoded[at:stop]
        yield at, stop, b" ".join(part) + b" ", np.concatenate([[0], np.cumsum([len(e) + 1 for e in part])])
        at = stop


def word_hashes(buf: bytes, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, bytes) of the words of a buffer; a word is a run of bytes of ``table``."""
    b = np.frombuffer(buf, np.uint8)
    inside = table[b]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends, b
    place = np.arange(len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b)))) if starts[0] == 0 else None
    if place is None:
        place = np.arange(len(b))
        place[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(b))))
    codes = np.where(inside, BYTE_CODES[b] * POWERS[place & 255], np.uint64(0))
    return mix(np.add.reduceat(codes, starts) + (ends - starts).astype(np.uint64)), starts, ends, b
