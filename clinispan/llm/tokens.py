"""Words, word hashes and window hashes of many texts at once, as numpy arrays inside a task."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Texts are taken together up to this many bytes; a longer one is taken alone.
GROUP_BYTES = 1 << 20
#: Words over this many bytes are hashed one by one.
LONG_WORD = 256

_U = np.uint64
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_IS_SEP = np.zeros(256, dtype=bool)
_IS_SEP[list(SEPARATORS)] = True
_BYTE = np.array([xxhash.xxh64_intdigest(bytes([i]), seed=11) for i in range(256)], dtype=_U)
_LOWER_BYTE = _BYTE.copy()
_LOWER_BYTE[65:91] = _BYTE[97:123]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of an odd number modulo 2**64 and their inverses, as far as asked for."""

    def __init__(self, base: int):
        self.base, self.back = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=_U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.concatenate([[_U(1)], np.cumprod(np.full(size - 1, b, dtype=_U))]) for b in (self.base, self.back))
        return self.up[:n], self.down[:n]


_byte_powers, _word_powers = _Powers(_BASE | 1), _Powers(_STEP | 1)


@dataclass
class Words:
    """The words of some texts: starts and ends in data, hashes, and each text's first word (first has one more entry)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray


def words(data: np.ndarray, bounds: np.ndarray, lower: bool) -> Words:
    """data: UTF-8 bytes of texts one after another, each followed by a separator; bounds: where each begins, and the end."""
    sep = _IS_SEP[data]
    edge = np.flatnonzero(sep[1:] != sep[:-1]) + 1
    if len(data) and not sep[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    up, down = _byte_powers.get(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum((_LOWER_BYTE if lower else _BYTE)[data] * up[:-1], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U))
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        word = data[starts[i] : ends[i]].tobytes()
        hashes[i] = xxhash.xxh64_intdigest(word.lower() if lower else word, seed=5)
    return Words(data, starts, ends, hashes, np.searchsorted(starts, bounds))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hashes of all runs of k words (none if there are fewer)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    up, down = _word_powers.get(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, dtype=_U)
    np.cumsum(hashes * up[:-1], out=total[1:])
    return mix((total[k:] - total[:n]) * down[:n])


def sequence_hash(hashes: np.ndarray) -> int:
    """One hash of a whole run of words, other than that of any window of another length."""
    return int(mix(windows(hashes, len(hashes)) + _U(len(hashes) * 0x632BE59BD9B4E019 % (1 << 64)))[0]) if len(hashes) else 0


def groups(texts: pa.Array, lower: bool) -> Iterator[tuple[int, Words]]:
    """The words of the texts of a column (null: no words), in groups: the number of the first text, and the group's words."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1, offset=8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    missing = texts.is_null().to_numpy(zero_copy_only=False)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + GROUP_BYTES, side="right")) - 1)
        parts, bounds, n = [], [0], 0
        for i in range(at, to):
            if not missing[i]:
                parts += [raw[offsets[i] : offsets[i + 1]]]
                n += len(parts[-1])
            parts.append(_NEWLINE)
            n += 1
            bounds.append(n)
        yield at, words(np.concatenate(parts), np.array(bounds), lower)
        at = to


_NEWLINE = np.array([10], dtype=np.uint8)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
