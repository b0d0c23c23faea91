"""Edit distance by Myers' bit-parallel columns, on integers of any width."""

from __future__ import annotations

from collections import Counter

import numpy as np


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def _columns(peq: dict[str, int], m: int, text: str, free_start: bool):
    """The distance of the whole pattern to a part of the text that ends at each place (free_start), or to each prefix."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full | (0 if free_start else 1)
        mh = (mh << 1) & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        yield score


def best_end(peq: dict[str, int], m: int, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best match of the pattern in the text, the first of equals, if within `most`."""
    best = None
    for end, score in enumerate(_columns(peq, m, text, True), 1):
        if score <= most and (best is None or score < best[0]):
            best = (score, end)
            if score == 0:
                break
    return best


def distance(a: str, b: str, most: int) -> int:
    """The edit distance, or most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    low, high = 0, min(len(a), len(b))
    while low < high:  # what both begin with
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a.startswith(b[:mid]) else (low, mid - 1)
    a, b = a[low:], b[low:]
    low, high = 0, min(len(a), len(b))
    while low < high:  # what both end with
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a.endswith(b[len(b) - mid :]) else (low, mid - 1)
    a, b = a[: len(a) - low], b[: len(b) - low]
    if not a or not b:
        return min(max(len(a), len(b)), most + 1)
    peq, m, n = masks(a), len(a), len(b)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, get = full, 0, m, peq.get
    for start in range(0, n, 64):
        for c in b[start : start + 64]:  # the columns of _columns(), without its generator
            eq = get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (full & ~(xh | pv))
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph = ph << 1 | 1
            pv = (mh << 1 | ~(xv | ph)) & full
            mv = ph & xv & full
        if score - max(n - start - 64, 0) > most:
            return most + 1
    return min(score, most + 1)


#: Patterns longer than SIDE_BY_SIDE are compared one pair at a time (over COUNTED, their characters are counted first); shorter ones many pairs side by side, in tables of at most TABLE words.
SIDE_BY_SIDE, COUNTED, TABLE = 4096, 2000, 1 << 22
_ONE, _TOP = np.uint64(1), np.uint64(63)


def _trimmed(a: str, b: str) -> tuple[str, str]:
    """Both without what they begin and end with alike; the shorter first."""
    if len(a) > len(b):
        a, b = b, a
    low, high = 0, len(a)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if b.startswith(a[:mid]) else (low, mid - 1)
    a, b = a[low:], b[low:]
    low, high = 0, len(a)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if b.endswith(a[len(a) - mid :]) else (low, mid - 1)
    return a[: len(a) - low], b[: len(b) - low]


def _codes(texts: list[str], width: int) -> np.ndarray:
    """A row of code points for each text, 0 after its end."""
    return np.frombuffer("".join(t.ljust(width, "\0") for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(texts), width)


def _side_by_side(pairs: list[tuple[str, str, int]]) -> np.ndarray:
    """Which pairs (pattern, text, most) are within their edits: Myers' columns in blocks of 64 rows, all blocks of all pairs at a time.

    Block w takes a letter of the text w steps after the first block did, when the block above it
    has passed on what it carries. Only blocks within the most edits of the diagonal work: one
    that comes in starts 64 above the one over it, and the row over the first one grows by one
    with each column, both as much as can be, so no distance comes out too small."""
    m, n, most = (np.array(x) for x in ([len(p) for p, _, _ in pairs], [len(t) for _, t, _ in pairs], [k for *_, k in pairs]))
    last = (m - 1) // 64
    order = np.argsort(-(n + last), kind="stable")  # the longest first, so that those still at work are the first ones
    m, n, most, last = m[order], n[order], most[order], last[order]
    blocks, width, count = int(last.max()) + 1, int(n.max()), len(pairs)
    patterns, texts = _codes([pairs[i][0] for i in order], 64 * blocks), _codes([pairs[i][1] for i in order], width)
    alphabet = np.unique(patterns)
    alphabet = alphabet[alphabet != 0]
    size = len(alphabet) + 1
    peq = np.zeros((blocks, count, size), np.uint64)  # the last letter stands for all that no pattern has
    for k, letter in enumerate(alphabet):
        peq[:, :, k] = np.packbits(patterns == letter, axis=1, bitorder="little").view(np.uint64).T
    at = np.searchsorted(alphabet, texts)
    letters = np.where(alphabet[np.minimum(at, size - 2)] == texts, at, size - 1)
    letters = np.concatenate([letters, np.full((count, blocks), size - 1)], 1) + np.arange(count)[:, None] * size
    letters, below = np.ascontiguousarray(letters.T), np.arange(blocks)[:, None] * (count * size)
    peq = peq.ravel()
    pv, mv = np.full((blocks, count), ~np.uint64(0)), np.zeros((blocks, count), np.uint64)
    up, down = np.zeros((blocks + 1, count), np.uint64), np.zeros((blocks + 1, count), np.uint64)
    up[0] = 1  # the row above all grows by one with each column
    score, bit, ends, band = m.astype(np.int64), ((m - 1) % 64).astype(np.uint64), n + last, int(most.max())
    bottom = np.full((blocks, count), 64, np.int64)  # the distance at each block's last row
    live, reached = count, 0
    for step in range(int(ends[0])):
        while ends[live - 1] <= step:
            live -= 1
        low, high = max(0, -(-(step - 63 - band) // 65)), min(blocks - 1, (step + band) // 65, step)
        if high > reached:
            reached = high
            over = bottom[high - 1] - up[high].astype(np.int64) + down[high].astype(np.int64)
            bottom[high] = over + 64
            new = last == high
            score[new] = over[new] + (m[new] - 1) % 64 + 1
        if low:
            up[low, :live], down[low, :live] = 1, 0
        if low > high:
            continue
        rows = slice(low, high + 1)
        place = letters[step - high : step - low + 1, :live][::-1] + below[rows]
        eq, p, v = peq[place], pv[rows, :live], mv[rows, :live]
        hp, hn = up[rows, :live], down[rows, :live]
        xv = eq | v
        eq |= hn
        xh = (((eq & p) + p) ^ p) | eq
        ph, mh = v | ~(xh | p), p & xh
        t = step - last[:live]
        ours = np.flatnonzero((t >= 0) & (t < n[:live]) & (last[:live] >= low) & (last[:live] <= high))
        if len(ours):
            own = last[ours] - low
            score[ours] += ((ph[own, ours] >> bit[ours]) & _ONE).astype(np.int64) - ((mh[own, ours] >> bit[ours]) & _ONE).astype(np.int64)
        carry, borrow = ph >> _TOP, mh >> _TOP
        ph = ph << _ONE | hp
        mh = mh << _ONE | hn
        pv[rows, :live], mv[rows, :live] = mh | ~(xv | ph), ph & xv
        up[low + 1 : high + 2, :live], down[low + 1 : high + 2, :live] = carry, borrow
        bottom[rows, :live] += carry.astype(np.int64) - borrow.astype(np.int64)
    out = np.empty(count, bool)
    out[order] = score <= most
    return out


#: Characters of a gram, texts for which grams are looked at, the multiplier of their hashes, and marks of texts made at once.
GRAM, LONG, _ODD, MARKS = 6, 512, np.uint64(0x9E3779B97F4A7C15), 1 << 24


def _gram_marks(texts: list[str], bits: int) -> np.ndarray:
    """A row of 2 ** bits marks for each text, those of its grams' hashes set, as words."""
    sizes = np.array([len(t) for t in texts])
    letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends, marks = np.cumsum(sizes), np.zeros((len(texts), 1 << bits), bool)
    n = len(letters) - GRAM + 1
    if n > 0:
        hashes = letters[:n]
        for k in range(1, GRAM):
            hashes = hashes * _ODD + letters[k : n + k]
        row = np.repeat(np.arange(len(texts)), sizes)[:n]
        whole = np.flatnonzero(np.arange(n) + GRAM <= ends[row])  # grams of one text
        marks[row[whole], (hashes[whole] * _ODD >> np.uint64(64 - bits)).astype(np.int64)] = True
    return np.packbits(marks, axis=1).view(np.uint64)


def may_be_within(pairs: list[tuple[str, str, int]]) -> np.ndarray:
    """False for pairs (a, b, most) of which one has more grams that the other lacks than `most` edits can change, GRAM each. Grams of one hash hide differences and make none, so False is certain."""
    out = np.ones(len(pairs), bool)
    order = sorted(range(len(pairs)), key=lambda i: -max(len(pairs[i][0]), len(pairs[i][1])))
    while order:
        bits = max(6, (8 * max(map(len, pairs[order[0]][:2]))).bit_length())
        part, order = order[: max(1, MARKS >> bits + 1)], order[max(1, MARKS >> bits + 1) :]
        number: dict[str, int] = {}
        x, y = (np.array([number.setdefault(pairs[i][side], len(number)) for i in part]) for side in (0, 1))
        marks, most = _gram_marks(list(number), bits), np.array([pairs[i][2] for i in part])
        lacking = np.maximum(np.bitwise_count(marks[x] & ~marks[y]).sum(1, dtype=np.int64), np.bitwise_count(marks[y] & ~marks[x]).sum(1, dtype=np.int64))
        out[part] = lacking <= GRAM * most
    return out


def all_within(pairs: list[tuple[str, str, int]]) -> np.ndarray:
    """For each (a, b, most) whether the edit distance is at most `most`."""
    out, groups = np.zeros(len(pairs), bool), {}
    long = [i for i, (a, b, most) in enumerate(pairs) if max(len(a), len(b)) >= LONG and abs(len(a) - len(b)) <= most]
    unlike = {i for i, may in zip(long, may_be_within([pairs[i] for i in long]).tolist(), strict=True) if not may}
    for i, (a, b, most) in enumerate(pairs):
        if abs(len(a) - len(b)) > most or i in unlike:
            continue
        a, b = _trimmed(a, b)
        if not a or len(b) <= most:
            out[i] = len(b) <= most
        elif len(a) > SIDE_BY_SIDE or "\0" in a or "\0" in b:
            if len(b) > COUNTED:  # characters that one has more often than the other take an edit each
                x, y = Counter(a), Counter(b)
                if (x - y).total() > most or (y - x).total() > most:
                    continue
            out[i] = distance(a, b, most) <= most
        else:
            groups.setdefault((-(-len(a) // 64)).bit_length(), []).append((i, (a, b, most)))
    for level, found in groups.items():
        found.sort(key=lambda x: -len(x[1][1]))
        step = max(16, TABLE // (128 << level))
        for k in range(0, len(found), step):
            part = found[k : k + step]
            out[[i for i, _ in part]] = _side_by_side([x for _, x in part])
    return out
