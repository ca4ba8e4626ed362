"""The binary Golay code [23, 12, 7]: every 23-bit word has one codeword within 3 bits."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

BITS, MESSAGE = 23, 12
_CHECK = BITS - MESSAGE
#: The code's generator polynomial: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of each word by the generator; 0 for codewords. Linear: syndrome(a ^ b) = syndrome(a) ^ syndrome(b)."""
    rest = words.astype(np.int64).copy()
    for bit in range(BITS - 1, _CHECK - 1, -1):
        rest ^= ((rest >> bit) & 1) * (GENERATOR << (bit - _CHECK))
    return rest


@cache
def _errors() -> np.ndarray:
    """The error pattern of at most 3 bits for each of the 2**11 syndromes; the code is perfect."""
    patterns = np.array([sum(1 << b for b in bits) for n in range(4) for bits in combinations(range(BITS), n)], dtype=np.int64)
    table = np.zeros(1 << _CHECK, dtype=np.int64)
    table[syndrome(patterns)] = patterns
    return table


def decode(words: np.ndarray) -> np.ndarray:
    """Index (0..4095) of the codeword nearest to each word."""
    words = words.astype(np.int64)
    return (words ^ _errors()[syndrome(words)]) >> _CHECK


def near_codes(words: np.ndarray) -> np.ndarray:
    """Codeword indices of each word and of its 23 neighbours, one row of 24 each (6 different ones at most).

    Two words that differ in at most 2 bits have an index in common: one of the
    words, or the word between them, is in both neighbourhoods.
    """
    words = words.astype(np.int64)
    flips = np.concatenate([[0], 1 << np.arange(BITS, dtype=np.int64)])
    around = words[:, None] ^ flips[None, :]
    errors = _errors()[syndrome(words)[:, None] ^ syndrome(flips)[None, :]]
    return (around ^ errors) >> _CHECK
