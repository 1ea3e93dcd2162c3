"""Suffix arrays by induced sorting (Nong, Zhang and Chan, 2009) and permuted common prefixes, in whole-array numpy steps.

Induction is a scan in which every entry may place its left neighbour further on. Blocks of the scan are done at once: the
targets of a block's entries are computed in stable order, and if one of them lies inside the block, the block is cut
before it. So the order of a plain scan is kept, at a cost per block instead of per suffix.
"""

from __future__ import annotations

import numpy as np

_FIRST_BLOCK, _LAST_BLOCK = 256, 1 << 18


def _narrow(t: np.ndarray, kinds: int) -> np.ndarray:
    return t.astype(np.uint8 if kinds <= 1 << 8 else np.uint16 if kinds <= 1 << 16 else np.int64, copy=False)


def s_types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last symbol is a unique smallest."""
    n = len(t)
    out = np.ones(n, dtype=bool)
    if n > 1:
        differs = t[:-1] != t[1:]
        up = t[:-1] < t[1:]
        # equal neighbours take the type of the next differing pair
        at = np.where(differs, np.arange(n - 1), n)
        at = np.minimum.accumulate(at[::-1])[::-1]
        out[:-1] = up[np.minimum(at, n - 2)]
    return out


def _induce(sa: np.ndarray, t: np.ndarray, wanted: np.ndarray, ends: np.ndarray, step: int) -> None:
    """Scan ``sa`` (step 1: upwards, -1: downwards); left neighbours of the wanted type go to their bucket's next place."""
    n = len(sa)
    at, block = 0, _FIRST_BLOCK
    line = sa if step == 1 else sa[::-1]
    places = ends if step == 1 else n - 1 - ends  # in the direction of the scan
    count = np.arange(_LAST_BLOCK)
    while at < n:
        stop = min(at + block, n)
        entries = line[at:stop]
        k = (entries > 0).nonzero()[0]
        p = entries[k]
        p -= 1
        m = wanted[p].nonzero()[0]
        if not len(m):
            at, block = stop, min(block * 2, _LAST_BLOCK)
            continue
        p = p[m]
        c = t[p]
        order = c.argsort(kind="stable")
        cs = c[order]
        begin = (cs[1:] != cs[:-1]).nonzero()[0]
        begin += 1
        bounds = np.empty(len(begin) + 2, dtype=np.int64)
        bounds[0], bounds[1:-1], bounds[-1] = 0, begin, len(cs)
        sizes = bounds[1:] - bounds[:-1]
        kinds = cs[bounds[:-1]]
        free = places[kinds]
        inside = int(free.min())  # the first places of the kinds are the least targets
        target = (free - bounds[:-1]).repeat(sizes)
        target += count[: len(cs)]
        if inside >= stop:
            line[target] = p[order]
            places[kinds] = free + sizes
            at, block = stop, min(block * 2, _LAST_BLOCK)
            continue
        # what lies inside the block has to be read later: keep what is read before it
        fine = (k[m][order] + at < inside).nonzero()[0]
        line[target[fine]] = p[order[fine]]
        np.maximum.at(places, cs[fine], target[fine] + 1)
        block = min(max(64, 2 * (inside - at)), _LAST_BLOCK)
        at = inside


def _fill(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Place the given LMS suffixes, in their order, at the ends of their buckets and induce all others from them."""
    n = len(t)
    tails = np.cumsum(sizes)
    heads = tails - sizes
    sa = np.full(n, -1, dtype=np.int64)
    c = t[lms]
    order = np.argsort(c, kind="stable")
    cs = c[order]
    begin = np.flatnonzero(np.append(len(cs) > 0, cs[1:] != cs[:-1]))
    counts = np.diff(np.append(begin, len(cs)))
    sa[np.arange(len(cs)) + np.repeat(tails[cs[begin]] - counts - begin, counts)] = lms[order]
    _induce(sa, t, ~is_s, heads.copy(), 1)
    small = np.flatnonzero(sa >= 0)
    small = small[is_s[sa[small]]]
    sa[small[1:]] = -1  # all but the sentinel are placed anew
    _induce(sa, t, is_s & (np.arange(n) < n - 1), tails - 1, -1)
    return sa


def _names(t: np.ndarray, ordered: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings, in text order, and their number; ``ordered``: the LMS places as sorted."""
    length = np.zeros(len(t), dtype=np.int64)
    length[lms[:-1]] = np.diff(lms) + 1
    length[lms[-1]] = 1
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    active, j = np.flatnonzero(same), 0
    while len(active):
        active = active[length[a[active]] > j]
        differ = t[a[active] + j] != t[b[active] + j]
        same[active[differ]] = False
        active = active[~differ]
        j += 1
    name = np.zeros(len(t), dtype=np.int64)
    name[ordered] = np.concatenate([[0], np.cumsum(~same)])
    return name[lms], int(name[ordered[-1]]) + 1


def suffix_array(t: np.ndarray, kinds: int) -> np.ndarray:
    """Suffix array of symbols below ``kinds``; the last symbol must be 0 and occur nowhere else.

    The LMS substrings are sorted by induction and named; where names repeat, their string is sorted the same way, which
    ends when all names differ.
    """
    n = len(t)
    if n == 1:
        return np.zeros(1, dtype=np.int64)
    t = _narrow(t, kinds)
    is_s = s_types(t)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[1:] = is_s[1:] & ~is_s[:-1]
    lms = np.flatnonzero(is_lms)
    sizes = np.bincount(t, minlength=kinds)
    sa = _fill(t, is_s, lms, sizes)
    ordered = sa[is_lms[sa]]
    reduced, found = _names(t, ordered, lms)
    if found < len(lms):
        ordered = lms[suffix_array(reduced, found)]
    return _fill(t, is_s, ordered, sizes)


def common_prefixes(t: np.ndarray, sa: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(permuted common prefixes, predecessor) by place: each suffix's common prefix with its predecessor in the array.

    ``rest``: symbols left before the next separator; prefixes end there. Only where the symbols before a suffix and its
    predecessor differ is the prefix compared (8 symbols a step); elsewhere it is one less than its left neighbour's.
    """
    n = len(t)
    before = np.empty(n, dtype=np.int64)
    before[sa[0]] = -1
    before[sa[1:]] = sa[:-1]
    place = np.arange(n)
    i, j = place[1:], before[1:]
    reducible = np.zeros(n, dtype=bool)
    reducible[1:] = (j > 0) & (t[i - 1] == t[np.maximum(j, 1) - 1]) & (rest[i - 1] > 0)
    a = np.flatnonzero(~reducible & (before >= 0))
    b = before[a]
    most = np.minimum(rest[a], rest[b])
    words = np.ndarray((n,), dtype="<u8", buffer=np.concatenate([t, np.zeros(8, np.uint8)]), strides=(1,))
    length = np.zeros(len(a), dtype=np.int64)
    active = np.flatnonzero(most > 0)
    while len(active):
        at = length[active]
        x = words[a[active] + at] ^ words[b[active] + at]
        equal = x == 0
        ended = active[~equal]
        y = x[~equal]
        y &= np.uint64(0) - y
        length[ended] += (np.log2(y.astype(np.float64)) // 8).astype(np.int64)
        active = active[equal]
        length[active] += 8
        active = active[length[active] < most[active]]
    out = np.zeros(n, dtype=np.int64)
    out[a] = np.minimum(length, most)
    known = np.maximum.accumulate(np.where(reducible, 0, place))
    out = np.maximum(out[known] - (place - known), 0)
    out[sa[0]] = 0
    return out, before


def repeated(regions: list[bytes], length: int) -> list[np.ndarray]:
    """For each region, which of its starts have ``length`` bytes that also start elsewhere in the regions."""
    sizes = np.fromiter(map(len, regions), dtype=np.int64, count=len(regions))
    n = int(sizes.sum()) + len(regions) + 1
    first = np.cumsum(sizes + 1) - (sizes + 1)
    t = np.ones(n, dtype=np.uint8)  # 1 separates regions; UTF-8 has no byte above 0xF4, so bytes fit two higher
    inner = np.arange(int(sizes.sum())) + np.repeat(np.arange(len(regions)), sizes)
    t[inner] = np.frombuffer(b"".join(regions), dtype=np.uint8) + 2
    t[-1] = 0
    rest = np.zeros(n, dtype=np.int64)
    rest[inner] = np.repeat(first + sizes, sizes) - inner
    prefix, before = common_prefixes(t, suffix_array(t, 256), rest)
    twice = prefix >= length
    twice[before[twice]] = True
    return [twice[a : a + max(s - length + 1, 0)] for a, s in zip(first.tolist(), sizes.tolist(), strict=True)]
