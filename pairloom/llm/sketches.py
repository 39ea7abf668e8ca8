"""Sets of word shingles and their sketches, for runs of texts."""

from __future__ import annotations

import numpy as np

from pairloom.llm.common import SPACED, Words, mix

SHINGLE = 5


def shingle_sets(flat: np.ndarray, at: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted 64-bit shingles of all texts, one text after another; the number of each text).

    A text of fewer words than ``size`` has all its words as one shingle; one without words has none.
    """
    words = Words(flat, at, SPACED)
    grams, counts = words.grams(size), words.counts
    first = np.cumsum(counts) - counts
    parts, numbers = [], np.zeros(len(counts), np.int64)
    for i, (k, n) in enumerate(zip(first.tolist(), counts.tolist(), strict=True)):
        if n >= size:
            own = np.sort(grams[k : k + n - size + 1])
            own = own[np.append(True, own[1:] != own[:-1])]
        elif n:
            own = np.array([n], np.uint64)
            for h in words.hash[k : k + n]:
                own = mix(own * np.uint64(0x9FB21C651E98DF25) ^ h)
        else:
            continue
        parts.append(own)
        numbers[i] = len(own)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), numbers


def fast_sketches(elements: np.ndarray, numbers: np.ndarray, size: int) -> np.ndarray:
    """The sketch of each set, one row of ``size`` coordinates for each number above 0.

    Fast similarity sketching (Dahlgaard, Knudsen and Thorup, 2017): in round i of the first ``size``
    rounds every element falls into a hashed bin, with a value that grows with the round; in the
    rounds after that, round size + j places every element in bin j.  A bin keeps its least value, and
    a set is done as soon as all its bins are filled; so large sets take one round and every
    coordinate is filled.  Two sets agree in a coordinate with the probability of their similarity.
    """
    numbers = numbers[numbers > 0]
    out = np.full(len(numbers) * size, np.iinfo(np.uint64).max, np.uint64)
    row = np.repeat(np.arange(len(numbers)), numbers)
    going = elements
    for i in range(2 * size):
        if i:
            open_rows = (out.reshape(-1, size) == np.iinfo(np.uint64).max).any(1)
            stay = open_rows[row]
            row, going = row[stay], going[stay]
            if not len(row):
                break
        value = mix(going + np.uint64((i + 1) * 0xA0761D6478BD642F % (1 << 64)))
        bins = value % np.uint64(size) if i < size else np.full(len(row), i - size, np.uint64)
        value = mix(value) >> np.uint64(10) | np.uint64(i) << np.uint64(54)
        np.minimum.at(out, row * size + bins.astype(np.int64), value)
    return out.reshape(-1, size)


def band_keys(sketches: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` coordinates; bands of different places differ."""
    n, size = sketches.shape
    bands = sketches.reshape(n, size // rows, rows)
    keys = np.zeros(bands.shape[:2], np.uint64) + np.arange(size // rows, dtype=np.uint64)
    for k in range(rows):
        keys = mix(keys * np.uint64(0x9FB21C651E98DF25) ^ bands[:, :, k])
    return keys
