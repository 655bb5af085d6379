"""Words as numbers, on flat numpy arrays: keyed hashes, and codes that are exact within a task."""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np

from quadrille.llm.common import mixed

#: Bytes handled at once; only a longer word makes the arrays longer.
CHUNK = 1 << 20
#: Longer words are hashed one by one.
SHORT = 64

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def new_key() -> bytes:
    """A key for one run of a query: no text can be written so that its hashes collide."""
    return secrets.token_bytes(16)


class WordCodes(dict):
    """word -> a number of its own, from 0. Equal numbers mean equal words."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def _slices(text: bytes) -> Iterator[tuple[int, bytes]]:
    """Parts of a text of about CHUNK bytes that end between words, each with its place."""
    at = 0
    while len(text) - at > CHUNK:
        end = at + CHUNK
        part = np.frombuffer(text, np.uint8, offset=end)
        while True:  # the next blank from there
            span = _BLANK[part[:65536]]
            k = int(span.argmax()) if len(span) else 0
            if not len(span) or span[k]:
                break
            part = part[65536:]
        end = len(text) - len(part) + k
        yield at, text[at:end]
        at = end
    yield at, text[at:]


def _batches(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text, place, bytes) of parts, some at a time, of about CHUNK bytes together."""
    batch, size = [], 0
    for i, text in enumerate(texts):
        for at, part in _slices(text):
            if batch and size + len(part) > CHUNK:
                yield batch
                batch, size = [], 0
            batch.append((i, at, part))
            size += len(part)
    if batch:
        yield batch


def _multipliers(key: bytes) -> np.ndarray:
    """Numbers of a key: for both hashes, one for each four bytes of a word and one for its length."""
    return np.frombuffer(hashlib.shake_128(key).digest(2 * 8 * (SHORT // 4 + 1)), np.uint64).reshape(2, -1)


def _hashed(data: np.ndarray, start: np.ndarray, size: np.ndarray, key: bytes) -> np.ndarray:
    numbers = _multipliers(key)
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    masks = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
    total = [numbers[k, -1] * size.astype(np.uint64) for k in range(2)]
    of = np.arange(len(start))
    for j in range(SHORT // 8):
        of = of[size[of] > 8 * j]
        if not len(of):
            break
        block = eight[start[of] + 8 * j] & masks[np.minimum(size[of] - 8 * j, 8)]
        low, high = block & np.uint64(0xFFFFFFFF), block >> np.uint64(32)
        for k in range(2):
            total[k][of] += numbers[k, 2 * j] * low + numbers[k, 2 * j + 1] * high
    out = (total[0] >> np.uint64(32)) << np.uint64(32) | total[1] >> np.uint64(32)
    for i in np.flatnonzero(size > SHORT).tolist():
        word = data[start[i] : start[i] + size[i]].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=key).digest(), "little")
    return mixed(out)


def word_hashes(texts: list[bytes], key: bytes, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Count of words in each text; the hash of each word of all texts, and where it begins and ends in its own text.

    Words are runs of bytes other than blanks; with lower, A-Z count as a-z. A hash
    is the upper halves of two multilinear sums under the key, so that two words
    collide under one key in 2**64; words of more than SHORT bytes take BLAKE2b.
    """
    counts = np.zeros(len(texts), np.int64)
    hashes, starts, ends = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for batch in _batches(texts):
        joined = b"\n" + b"\n".join([p for _, _, p in batch]) + b"\n" * 9
        data = np.frombuffer(joined.lower() if lower else joined, np.uint8)
        blank = _BLANK[data]
        edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        start, end = edges[0::2], edges[1::2]
        begin = np.cumsum([1, *(len(p) + 1 for _, _, p in batch)])
        count = np.diff(np.searchsorted(start, begin))
        np.add.at(counts, [i for i, _, _ in batch], count)
        hashes.append(_hashed(data, start, end - start, key))
        own = np.repeat(begin[:-1] - np.array([at for _, at, _ in batch]), count)
        starts.append(start - own)
        ends.append(end - own)
    return counts, np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)


def word_codes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, int]:
    """Count of words in each text, the code of each word of all texts, and the number of codes."""
    known = WordCodes()
    counts = np.zeros(len(texts), np.int64)
    found = [np.zeros(0, np.int64)]
    for i, text in enumerate(texts):
        for _, part in _slices(text):
            words = (part.lower() if lower else part).split()
            counts[i] += len(words)
            found.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
    return counts, np.concatenate(found), len(known)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base modulo 2**64, and of its inverse."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = 1 << max(10, (n - 1).bit_length())
        both = []
        for b in (_BASE, pow(_BASE, -1, 2**64)):
            p = np.ones(1, np.uint64)
            while len(p) < size:
                p = np.concatenate([p, p * np.uint64(pow(b, len(p), 2**64))])
            both.append(p)
        _POWERS[:] = [(both[0], both[1])]
    return _POWERS[0]


def windows(values: np.ndarray, n: int) -> np.ndarray:
    """Rabin-Karp hashes of every n consecutive values (len(values) - n + 1 of them, or none).

    The modulus is 2**64, which is safe for values that nobody can choose, such as
    keyed hashes of words; bytes or codes must be mixed first.
    """
    if len(values) < n:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return (total[n:] - total[:-n]) * down[: len(values) - n + 1]


def equal_windows(codes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """A number for each window of n codes: equal numbers exactly where the codes are equal.

    Hashes propose groups; every window is then compared, code by code, with the first of its group.
    """
    hashes = windows(mixed(codes.astype(np.uint64)), n)[starts]
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    first = starts[first][group]
    if all((codes[starts + j] == codes[first + j]).all() for j in range(n)):
        return group
    return np.unique(codes[starts[:, None] + np.arange(n)], axis=0, return_inverse=True)[1].ravel()
