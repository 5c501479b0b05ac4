"""Hashes of words and word windows, in numpy, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

from leadtide.llm.token_pack import Memo

#: 128 bits of a word; the memo holds at least the last so many different words.
WORDS = Memo(xxhash.xxh3_128_digest, 100_000)

M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))
SHIFT = np.uint64(32)


def both_hashes(words: list[bytes]) -> np.ndarray:
    """Two independent hashes of every word, a row each."""
    return np.frombuffer(b"".join(map(WORDS.__getitem__, words)), "<u8").reshape(-1, 2).T


def word_hashes(words: list[bytes]) -> np.ndarray:
    return both_hashes(words)[0]


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> SHIFT)) * M3
    return (x ^ (x >> SHIFT)) * M2


def join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of two neighbouring windows; the order matters."""
    return scramble(left * M1 + (right ^ M2))


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every window of ``length`` words, by binary composition."""
    out, have, power, width = None, 0, hashes, 1
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    while True:
        if length & width:
            out = power[:n] if out is None else join(out[:n], power[have : have + n])
            have += width
        if have == length:
            return scramble(out)
        power = join(power[:-width], power[width:])
        width *= 2
