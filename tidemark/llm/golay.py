"""The perfect binary Golay code of 23 bits, for fuzzy hashing.

Every word of 23 bits is within 3 bits of exactly one of 4,096 codewords; ``decode`` gives that codeword's index. The
keys of a word are the indices to which it and the words one bit away decode: one or six. Words at most two bits
apart have a key in common, as some word is at most one bit from both; of words at most one bit apart, each one's own
index is a key of the other.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

BITS = 23
#: Fixed value: the generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def _remainder(word: int) -> int:
    for i in range(BITS - 1, 10, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - 11)
    return word


_OF_BIT = [_remainder(1 << i) for i in range(BITS)]
_OF_BYTE = [np.array([np.bitwise_xor.reduce([_OF_BIT[8 * k + j] for j in range(8) if v >> j & 1 and 8 * k + j < BITS] or [0]) for v in range(256)], np.uint32) for k in range(3)]
_ERROR = np.zeros(1 << 11, np.uint32)  # by remainder: the only pattern of at most three bits that has it
for _n in range(4):
    for _some in combinations(range(BITS), _n):
        _ERROR[np.bitwise_xor.reduce([_OF_BIT[i] for i in _some] or [0])] = sum(1 << i for i in _some)


def decode(words: np.ndarray) -> np.ndarray:
    """The index (12 bits) of the codeword next to each word."""
    words = words.astype(np.uint32)
    left = _OF_BYTE[0][words & 255] ^ _OF_BYTE[1][words >> 8 & 255] ^ _OF_BYTE[2][words >> 16]
    return (words ^ _ERROR[left]) >> np.uint32(11)


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An array of 6 columns: a word's own index first, then the others, and how many there are (1 or 6)."""
    words = words.astype(np.uint32)
    near = np.stack([decode(words), *(decode(words ^ np.uint32(1 << i)) for i in range(BITS))], axis=1)
    own, rest = near[:, :1], np.sort(near[:, 1:], axis=1)
    new = (rest != own) & np.concatenate([np.ones((len(words), 1), bool), rest[:, 1:] != rest[:, :-1]], axis=1)
    out = np.repeat(own, 6, axis=1)
    row, col = np.nonzero(new)
    out[row, (np.cumsum(new, axis=1))[row, col]] = rest[row, col]
    return out, 1 + new.sum(axis=1)
