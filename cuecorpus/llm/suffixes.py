"""Suffix arrays of a shard by induced sorting, in numpy, and their permuted common prefixes.

A shard is a list of pieces of bytes. They are laid one after the other with a separator, smaller than any byte, after
each; order and common prefixes matter only up to the end of a piece.
"""

from __future__ import annotations

import numpy as np

SIGMA = 257


def layout(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The shard as small integers (a byte plus 1; 0 parts the pieces), and where each piece starts."""
    lengths = np.asarray([len(p) for p in pieces], np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    out = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.int16) + 1
    out[starts + lengths] = 0
    return out, starts


def _types(t: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the next one (S-type); the last is one."""
    n = len(t)
    differs = np.flatnonzero(t[1:] != t[:-1])
    rises = t[differs] < t[differs + 1]
    runs = np.diff(np.concatenate(([-1], differs, [n - 1])))
    return np.repeat(np.append(rises, True), runs)


def _spread(t, chosen, sa, heads, filled, step):
    """Place suffixes, in the order given, at the next free places of their buckets (from the left or the right)."""
    chars = t[chosen]
    counts = np.bincount(chars, minlength=SIGMA)
    used = np.flatnonzero(counts)
    if len(used) > 1:
        chosen = chosen[np.argsort(chars, kind="stable")]
    at = 0
    for c in used:
        own, begin = chosen[at : at + counts[c]], heads[c] + step * filled[c]
        if step > 0:
            sa[begin : begin + len(own)] = own
        else:
            sa[begin - len(own) + 1 : begin + 1] = own[::-1]
        at += counts[c]
    filled += counts


def _induce(t: np.ndarray, small: np.ndarray, seeds: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All suffixes from the seeds (leftmost-smaller suffixes in order), one bucket at a time.

    From left to right each suffix puts its larger predecessor into place, then from right to left each puts its smaller
    one; what a bucket adds to itself is taken in turn until nothing is added.
    """
    sa = np.full(len(t), -1, np.int32)
    heads = np.cumsum(counts) - counts
    tails = heads + counts - 1
    larger = np.zeros(SIGMA, np.int64)
    by_char = np.argsort(t[seeds], kind="stable")
    seeds = seeds[by_char]
    seed_counts = np.bincount(t[seeds], minlength=SIGMA)
    seed_ends = np.cumsum(seed_counts)
    used = np.flatnonzero(counts)
    for c in used:
        done = 0
        while done < larger[c]:
            new = sa[heads[c] + done : heads[c] + larger[c]]
            done = larger[c]
            before = new[new > 0] - 1
            before = before[~small[before]]
            if len(before):
                _spread(t, before, sa, heads, larger, 1)
        before = seeds[seed_ends[c] - seed_counts[c] : seed_ends[c]]
        before = before[before > 0] - 1
        before = before[~small[before]]
        if len(before):
            _spread(t, before, sa, heads, larger, 1)
    smaller = np.zeros(SIGMA, np.int64)
    # The last suffix has no successor to put it into place.
    _spread(t, np.asarray([len(t) - 1]), sa, tails, smaller, -1)
    for c in used[::-1]:
        done = 0
        while done < smaller[c]:
            new = sa[tails[c] - smaller[c] + 1 : tails[c] - done + 1][::-1]
            done = smaller[c]
            before = new[new > 0] - 1
            before = before[small[before]]
            if len(before):
                _spread(t, before, sa, tails, smaller, -1)
        before = sa[heads[c] : heads[c] + larger[c]][::-1]
        before = before[before > 0] - 1
        before = before[small[before]]
        if len(before):
            _spread(t, before, sa, tails, smaller, -1)
    return sa


def _names(t: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Ranks of the leftmost-smaller substrings, in text order, from suffixes sorted by them; equal ones share a rank.

    A substring runs to the next leftmost-smaller place, that included.
    """
    ends = np.append(lms[1:], len(t) - 1)
    number = np.zeros(len(t), np.int32)
    number[lms] = np.arange(len(lms), dtype=np.int32)
    where = number[ordered]
    length = ends[where] - ordered + 1
    a, b = ordered[:-1], ordered[1:]
    same = length[:-1] == length[1:]
    live = np.flatnonzero(same)
    k = 0
    while len(live):
        same[live] = t[a[live] + k] == t[b[live] + k]
        k += 1
        live = live[same[live] & (length[live] > k)]
    names = np.zeros(len(lms), np.int64)
    names[where] = np.concatenate(([0], np.cumsum(~same)))
    return names


def _sort_names(names: np.ndarray, most: int) -> np.ndarray:
    """Order of the suffixes of a string of names, each step sorting by twice as many names as the one before.

    The names' alphabet is as large as the string, so buckets are of one or two names each and a pass from bucket to
    bucket would be a loop over single suffixes; ``most`` is the number of names that the longest piece has.
    """
    n = len(names)
    bits = int(names.max() + 1).bit_length()
    span = min(62 // bits, most)
    key = np.zeros(n, np.int64)
    for k in range(span):
        key <<= bits
        key[: n - k] |= names[k:] + 1
    while True:
        order = np.argsort(key)
        ordered = key[order]
        head = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        if span >= most or head[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = head
        key = rank * (n + 1)
        key[: n - span] += rank[span:] + 1
        span *= 2


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order, up to the ends of their pieces."""
    small = _types(t)
    counts = np.bincount(t, minlength=SIGMA)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if not len(lms):
        return _induce(t, small, np.zeros(0, np.int64), counts)
    by_substring = _induce(t, small, lms, counts)
    is_lms = np.zeros(len(t), bool)
    is_lms[lms] = True
    names = _names(t, lms, by_substring[is_lms[by_substring]])
    parts = np.concatenate(([-1], np.flatnonzero(t[lms] == 0), [len(lms)]))
    order = _sort_names(names, int(np.diff(parts).max()) + 1)
    return _induce(t, small, lms[order], counts)


def common_prefixes(t: np.ndarray, sa: np.ndarray, starts: np.ndarray, lengths: np.ndarray, most: int) -> np.ndarray:
    """By text position: how many bytes a suffix shares with the one before it in order, at most ``most`` or what is left
    of its piece.

    A suffix shares at most one byte less than the suffix one place to its left did; all pieces take a step to the right
    at once, starting from what is left of the step before.
    """
    before = np.full(len(t), -1, np.int32)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(len(t), np.int32)
    by_length = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[by_length], lengths[by_length]
    held = np.zeros(len(starts), np.int64)
    for step in range(int(lengths[0]) if len(lengths) else 0):
        own = int(np.searchsorted(-lengths, -step))  # pieces that go on so far
        at, left = starts[:own] + step, np.minimum(lengths[:own] - step, most)
        held = np.maximum(held[:own] - 1, 0)
        prev = before[at]
        live = np.flatnonzero((held < left) & (prev >= 0))
        while len(live):
            x = t[at[live] + held[live]]
            y = t[np.minimum(prev[live] + held[live], len(t) - 1)]
            live = live[(x == y) & (x > 0)]
            held[live] += 1
            live = live[held[live] < left[live]]
        held[prev < 0] = 0
        out[at] = held
    return out
