"""Suffix arrays by difference cover (modulo 3), in numpy."""

from __future__ import annotations

import numpy as np

#: Three letters or names of this many bits, or two and a rank, fit one 64-bit key; so a text has under 2 ** BITS - 3 letters.
BITS = 21
#: Letters that are compared at once; more, if one run of strings has more.
COMPARED = 1 << 20


def _key(*parts: np.ndarray) -> np.ndarray:
    key = parts[0].astype(np.int64)
    for p in parts[1:]:
        key = key << BITS | p
    return key


def _order(*parts: np.ndarray) -> np.ndarray:
    """What puts two or three columns in order, later places last among equals.  Keys that hold their places are sorted as
    numbers, in two steps if there are three columns, which takes a fraction of the time of ``argsort``."""
    low, place = (1 << BITS) - 1, np.arange(len(parts[0]))
    if len(parts) == 2:
        return np.sort(_key(*parts, place)) & low
    last = np.sort(_key(parts[2], place)) & low
    return last[np.sort(_key(parts[0][last], parts[1][last], place)) & low]


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The places of all suffixes of s (letters of 1 to 2 ** BITS - 1) in order; a suffix comes before those that it begins.

    Suffixes at places that 3 does not divide are the sample: their triples are sorted and named, and where names repeat, the
    text of names is sorted by the same function.  The others are sorted by a letter and the sample's ranks, and merged: their
    places among the sample's suffixes are found by search, in the part of each remainder, whose order is known.
    """
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: tuple(s[i:])), np.int64)
    t = np.concatenate([s, np.zeros(3, s.dtype)]).astype(np.int32)  # half the memory to look letters up in
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # a place n, of the empty suffix, parts the two halves
    sample = np.concatenate([one, two])
    triples = t[sample], t[sample + 1], t[sample + 2]
    order = _order(*triples)
    ordered = [x[order] for x in triples]
    new = np.concatenate([[True], np.logical_or.reduce([x[1:] != x[:-1] for x in ordered])])
    names = np.empty(len(sample), np.int32)
    names[order] = np.cumsum(new)
    if not new.all():
        order = suffix_array(names)
    ranks = np.zeros(n + 3, np.int32)
    ranks[sample[order]] = np.arange(1, len(sample) + 1)
    ranks[n:] = 0
    sorted_sample = sample[order]
    sorted_sample = sorted_sample[sorted_sample < n]

    rest = np.arange(0, n, 3)
    rest = rest[_order(t[rest], ranks[rest + 1])]
    first, second = sorted_sample[sorted_sample % 3 == 1], sorted_sample[sorted_sample % 3 == 2]
    before = np.searchsorted(_key(t[first], ranks[first + 1]), _key(t[rest], ranks[rest + 1]))
    before += np.searchsorted(_key(t[second], t[second + 1], ranks[second + 2]), _key(t[rest], t[rest + 1], ranks[rest + 2]))
    out = np.empty(n, np.int64)
    at = before + np.arange(len(rest))
    free = np.ones(n, bool)
    free[at] = False
    out[at] = rest
    out[free] = sorted_sample
    return out


def agree(text: np.ndarray, at: np.ndarray, other: np.ndarray, length: int) -> np.ndarray:
    """Which strings of ``length`` letters at the places ``at`` (each once) equal those at ``other``.

    A few letters tell most strings apart.  Of the rest, pairs that both lie one letter after another pair are compared with it,
    each letter once, and a string is equal if no letter of it differs.
    """
    some = np.arange(len(at))
    for letter in sorted({length - 1, length // 2, length // 4, length // 8, 0}, reverse=True):
        some = some[text[at[some] + letter] == text[other[some] + letter]]
    some = some[np.argsort(at[some])]
    out = np.zeros(len(at), bool)
    a, b = at[some], other[some]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1] + 1) | (b[1:] != b[:-1] + 1)])) if len(a) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(a)))
    sizes = count + length - 1
    ends = np.cumsum(sizes)
    begin = 0
    while begin < len(first):
        done = ends[begin] - sizes[begin]
        end = max(begin + 1, int(np.searchsorted(ends, done + COMPARED, side="right")))
        size, run = sizes[begin:end], first[begin:end]
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        differ = text[np.repeat(a[run], size) + place] != text[np.repeat(b[run], size) + place]
        before = np.concatenate([[0], np.cumsum(differ)])
        k = np.arange(run[0], run[0] + count[begin:end].sum())
        k_at = k - run[0] + np.repeat(np.arange(end - begin) * (length - 1), count[begin:end])
        out[some[k]] = before[k_at + length] == before[k_at]
        begin = end
    return out


def repeated(text: np.ndarray, starts: np.ndarray, length: int, several: np.ndarray) -> np.ndarray:
    """Which of the places ``starts`` begin a string of ``length`` letters that another of them begins, or that ``several`` marks
    as being elsewhere too.  Suffixes are put in order, and each is compared with its neighbour over its first letters."""
    is_start = np.full(len(text), -1, np.int64)
    is_start[starts] = np.arange(len(starts))
    order = is_start[suffix_array(text)]
    order = order[order >= 0]
    at = starts[order]
    same = np.zeros(len(at), bool)
    same[1:] = agree(text, at[1:], at[:-1], length)
    group = np.cumsum(~same) - 1
    many = (np.bincount(group, minlength=1) > 1) | (np.bincount(group, several[order], minlength=1) > 0)
    found = np.zeros(len(starts), bool)
    found[order] = many[group] if len(group) else False
    return found
