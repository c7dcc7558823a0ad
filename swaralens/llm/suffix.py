"""Suffix arrays by induced sorting, in whole-array steps, and permuted common prefixes.

Suffixes are classified as smaller (S) or larger (L) than their right neighbour; an S-suffix behind an
L-suffix is leftmost-smaller (LMS). The LMS substrings are sorted by one induced pass and named; the
reduced text of names is sorted by the same method, recursively, until all names differ. A second
induced pass then sorts all suffixes from the sorted LMS ones in linear time.

A pass goes over spans of buckets: as many neighbouring buckets as place no suffix among themselves,
so that all of them are placed by one array step. A bucket that places suffixes into itself is a span
of its own: runs of its character are placed by their lengths, nearest suffixes first.

With a depth, suffixes are in order of their first `depth` characters, which is all that is needed to
tell whether strings of that length are equal.
"""

from __future__ import annotations

import numpy as np


def classify(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is of type S. The last one counts as S: it is the end mark."""
    n = len(s)
    small = np.zeros(n, bool)
    small[-1] = True
    if n == 1:
        return small
    less, differs = s[:-1] < s[1:], s[:-1] != s[1:]
    # An equal pair takes the type of the next pair that differs.
    at = np.where(differs, np.arange(n - 1), n - 1)
    following = np.minimum.accumulate(at[::-1])[::-1]
    small[:-1] = np.where(following < n - 1, less[np.minimum(following, n - 2)], True)
    return small


def spans(limit: np.ndarray) -> list[tuple[int, int]]:
    """Cuts buckets 0.. into spans [a, b): limit[c] is the greatest bucket that bucket c is placed from
    (-1: none), which must not be in its span; limit[c] = c makes a span of its own."""
    out = []
    a, high = 0, -1
    for c, place in enumerate(limit.tolist()):
        if place >= a and c > a:
            out.append((a, c))
            a, high = c, -1
        if place == c:
            out.append((c, c + 1))
            a = c + 1
    if a < len(limit):
        out.append((a, len(limit)))
    return out


class Buckets:
    """Where each character's suffixes stand in the array, and the spans of both passes. Characters
    are numbered without gaps."""

    def __init__(self, s: np.ndarray, small: np.ndarray) -> None:
        size = np.bincount(s)
        self.end = np.cumsum(size)
        self.start = self.end - size
        at = np.arange(len(s), dtype=np.int32 if len(s) < 2**31 else np.int64)
        #: How many suffixes with the same character stand directly before each.
        self.before = at - np.maximum.accumulate(np.where(np.r_[True, s[1:] != s[:-1]], at, 0))
        many = len(size)
        pair = ~small[:-1]
        limit = np.full(many, -1)
        np.maximum.at(limit, s[:-1][pair], s[1:][pair])
        self.rising = spans(limit)
        # The falling pass sees the buckets in reverse.
        limit = np.full(many, -1)
        np.maximum.at(limit, many - 1 - s[:-1][~pair].astype(np.int64), many - 1 - s[1:][~pair].astype(np.int64))
        self.falling = [(many - b, many - a) for a, b in spans(limit)]


def _spread(sa: np.ndarray, found: np.ndarray, chars: np.ndarray, edge: np.ndarray, step: int) -> None:
    """Appends suffixes to their characters' buckets, in order; edge moves by step a suffix. Most calls
    place few suffixes, so array calls are spared here."""
    n = len(chars)
    order = chars.argsort(kind="stable")
    chars = chars[order]
    fresh = np.empty(n, bool)
    fresh[0] = True
    np.not_equal(chars[1:], chars[:-1], out=fresh[1:])
    first = fresh.nonzero()[0]
    used = chars[first]
    counts = np.empty(len(first), np.int64)
    np.subtract(first[1:], first[:-1], out=counts[:-1])
    counts[-1] = n - first[-1]
    edges = edge[used]
    if step > 0:
        sa[(edges - first).repeat(counts) + np.arange(n)] = found[order]
        edge[used] = edges + counts
    else:
        sa[(edges - 1 + first).repeat(counts) - np.arange(n)] = found[order]
        edge[used] = edges - counts


def _runs(found: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The suffixes that a bucket places into itself: before[p] suffixes with its character stand left
    of p. All left neighbours come first, then all of theirs, and so on."""
    many = before[found]
    if not many.any():
        return found[:0]
    step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + 1
    order = np.argsort(step, kind="stable")
    return (np.repeat(found, many) - step)[order]


def induce(s: np.ndarray, small: np.ndarray, buckets: Buckets, lms: np.ndarray) -> np.ndarray:
    """All suffixes sorted from LMS suffixes that are in order within their first characters."""
    n = len(s)
    sa = np.full(n, -1, lms.dtype)
    tail = buckets.end.copy()
    _spread(sa, lms[::-1], s[lms[::-1]], tail, -1)
    head = buckets.start.copy()
    for a, b in buckets.rising:
        found = sa[buckets.start[a] : buckets.end[b - 1]]
        if b == a + 1:
            own = _runs(sa[buckets.start[a] : head[a]], buckets.before)
            sa[head[a] : head[a] + len(own)] = own
            head[a] += len(own)
        _place(sa, s, small, found[found >= 0], head, False)
    # The LMS suffixes go, and what stands are the L-suffixes; the end mark is the only S-suffix placed.
    stays = np.repeat(head, buckets.end - buckets.start)
    sa[np.arange(n) >= stays] = -1
    tail = buckets.end.copy()
    tail[s[-1]] -= 1
    sa[tail[s[-1]]] = n - 1
    for a, b in buckets.falling:
        found = sa[buckets.start[a] : buckets.end[b - 1]][::-1]
        if b == a + 1:
            own = _runs(sa[tail[a] : buckets.end[a]][::-1], buckets.before)
            sa[tail[a] - len(own) : tail[a]] = own[::-1]
            tail[a] -= len(own)
        _place(sa, s, small, found[found >= 0], tail, True)
    return sa


def _place(sa, s, small, found, edge, want_small: bool) -> None:
    """Places the left neighbours of that type whose character is another one."""
    found = found[found > 0]
    left = found - 1
    chars = s[left]
    keep = ((small[left] == want_small) & (chars != s[found])).nonzero()[0]
    if len(keep):
        _spread(sa, left[keep], chars[keep], edge, -1 if want_small else 1)


def name_substrings(s: np.ndarray, lms: np.ndarray, in_order: np.ndarray, depth: int) -> np.ndarray:
    """A number for each LMS position (in text order) that rises with its substring; in_order are the
    positions sorted by substring. Substrings that agree in `depth` characters may share a number."""
    n = len(s)
    index = np.empty(n, np.int64)
    index[lms] = np.arange(len(lms))
    ends = np.r_[lms[1:], n - 1]
    size = np.minimum(ends - lms + 1, depth)
    rows = index[in_order]
    a, b = rows[:-1], rows[1:]
    same = size[a] == size[b]
    active = np.flatnonzero(same)
    k = 0
    while len(active):
        x, y = lms[a[active]] + k, lms[b[active]] + k
        equal = s[x] == s[y]
        same[active[~equal]] = False
        active = active[equal]
        k += 1
        active = active[size[a[active]] > k]
    names = np.empty(len(lms), np.int32)
    names[rows] = np.r_[0, np.cumsum(~same)]
    return names


def sort_suffixes(s: np.ndarray, reach: int) -> np.ndarray:
    """The suffixes of s in order of `reach` characters at least. Characters are numbered from 0
    without gaps; the last one is the end mark 0, which stands nowhere else."""
    small = classify(s)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32 if len(s) < 2**31 else np.int64)
    buckets = Buckets(s, small)
    if len(lms) > 1:
        is_lms = np.zeros(len(s), bool)
        is_lms[lms] = True
        first = induce(s, small, buckets, lms)
        first = first[is_lms[first]]
        names = name_substrings(s, lms, first, reach + 1)
        if int(names[np.searchsorted(lms, first[-1])]) == len(lms) - 1:
            lms = first  # all names differ
        else:  # each LMS substring but the last has two characters or more before the next one
            lms = lms[sort_suffixes(names, reach // 2 + 2)]
    return induce(s, small, buckets, lms)


def suffix_array(text: np.ndarray, depth: int | None = None) -> np.ndarray:
    """The positions of a uint8 text in order of their suffixes, or of their first `depth` characters.

    An empty text has an empty array. A suffix that ends earlier comes first.
    """
    if not len(text):
        return np.empty(0, np.int64)
    # Characters are numbered from 1; the end mark 0 stands behind the text.
    used = np.unique(text)
    table = np.zeros(256, np.uint8 if len(used) < 256 else np.int16)
    table[used] = np.arange(1, len(used) + 1)
    s = np.append(table[text], np.zeros(1, table.dtype))
    return sort_suffixes(s, depth or len(s))[1:]


def permuted_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The positions of `order` but the first, in text order, and the length of the prefix that each
    shares with the position before it in `order`, at most `depth`.

    Each position's predecessor is looked up in text order, where neighbours' prefixes lie side by
    side, and prefixes are extended eight characters at a time.
    """
    by_place = np.argsort(order[1:], kind="stable")
    position, before = order[1:][by_place], order[:-1][by_place]
    if not len(position):
        return position, np.empty(0, np.int64)
    whole = np.ascontiguousarray(np.append(text, np.zeros(8, np.uint8)))
    words = np.ndarray((len(whole) - 7,), "<u8", whole, strides=(1,))
    room = np.minimum(len(text) - np.maximum(position, before), depth)
    length = np.zeros(len(position), np.int64)
    active = np.arange(len(position))
    k = 0
    while len(active):
        differ = words[position[active] + k] ^ words[before[active] + k]
        equal = differ == 0
        ends, differ = active[~equal], differ[~equal]
        lowest = differ & (~differ + np.uint64(1))
        length[ends] = k + np.bitwise_count(lowest - np.uint64(1)) // 8
        active = active[equal]
        k += 8
        length[active] = k
        active = active[room[active] > k]
    return position, np.minimum(length, room)


def equal_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Whether each position of `order` but the first shares `depth` characters with the one before."""
    position, length = permuted_prefixes(text, order, depth)
    place = np.empty(len(text), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    out = np.zeros(len(position), bool)
    out[place[position[length == depth]] - 1] = True
    return out
