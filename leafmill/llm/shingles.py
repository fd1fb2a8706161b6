"""Sets of word shingles, as sorted 64-bit hashes, for a slice of many documents at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from leafmill.llm.common import LOWER_TABLE, coded, starts, translated, words

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(text: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, all in one array, and how many each text has.

    Words are lower-cased (A-Z).  A text of fewer words than ``size``, but not none, has its whole sequence as one shingle.
    The hash is one function of the words in their order, so equal shingles agree in all tasks.
    """
    flat, counts = words(translated(text, LOWER_TABLE))
    distinct, codes = coded(flat)
    of_word = np.array([xxhash.xxh3_64_intdigest(w) for w in distinct], np.uint64)[codes] if distinct else np.zeros(0, np.uint64)
    n, at = len(of_word), starts(counts)
    doc = np.repeat(np.arange(len(counts)), counts)
    key = np.full(max(0, n - size + 1), size, np.uint64)
    for j in range(size):
        key = mix64(key * _ODD + of_word[j : n - size + 1 + j])
    inside = doc[: len(key)] == doc[size - 1 :] if n >= size else np.zeros(0, bool)
    key, owner = key[inside], doc[: len(key)][inside]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        one = []
        for i in short:
            h = np.array([counts[i]], np.uint64)
            for w in of_word[at[i] : at[i + 1]]:
                h = mix64(h * _ODD + w)
            one.append(h)
        key, owner = np.concatenate([key, *one]), np.concatenate([owner, short])
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    return key[fresh], np.bincount(owner[fresh], minlength=len(counts))
