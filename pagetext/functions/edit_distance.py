"""E1/E2 edit distance, exact, over many pairs at once.

The bit-vector recurrence (Myers 1999; blocks after Hyyro 2003): one sequence of a
pair is cut into lanes of 64 rows, held in two words each. At step t the lane r of a
pair treats column t - r, so what a lane hands to the next one was computed a step
before, and all lanes of all pairs of a batch advance together as numpy vectors.

Only lanes that a path of at most k edits can reach are open, where k is Hamming's
distance for equal lengths, else an eighth of the longer one. Values outside are taken
too high, so a result of at most k is exact; others are done again with a wider band.
A pair needs no sweep where Hamming's distance is also a lower bound (``settled``).

``sweep_cell`` treats one rectangle of a very long pair between given borders (see
``operators.long_pairs``). Texts of any length, also empty ones, have a distance; a
null text has none.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = 64
BATCH_LANES = 8192          # lanes of a batch of pairs
TABLE_ENTRIES = 1 << 22     # words of a batch's match table
ONE = np.uint64(1)


class Lanes(NamedTuple):
    at: np.ndarray          # first column's place in the codes
    row: np.ndarray         # place within the pair
    start: np.ndarray       # first open column
    end: np.ndarray         # behind the last one
    height: np.ndarray      # rows, at most 64
    prev: np.ndarray        # index of the lane above; the number of lanes where there is none


def sweep(lanes: Lanes, codes: np.ndarray, table: np.ndarray, base: np.ndarray, pv: np.ndarray, mv: np.ndarray,
          border: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """(value at each lane's last row and column, steps along the last lane's bottom).

    ``lanes`` are in order of start + row; ``pv`` and ``mv`` (rows that go up, down) are
    changed in place; ``border`` gives the steps above a single pair's first lane
    (+1 each without it), and only then the bottom is returned.
    """
    begins, ends = lanes.start + lanes.row, lanes.end + lanes.row
    n, steps = len(begins), int(ends.max())
    top = (lanes.height - 1).astype(np.uint64)
    place = lanes.at - lanes.row
    up, down = np.ones(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
    value = np.zeros(n + 1, np.int64)
    value[n] = 1
    bottom = None if border is None else np.empty(int(lanes.end[-1]), np.int8)
    opened = np.searchsorted(begins, np.arange(steps), "right").tolist()
    closed = np.searchsorted(np.maximum.accumulate(ends), np.arange(steps), "right").tolist()
    next_end = np.minimum.accumulate(ends[::-1])[::-1].tolist()
    hi = lo = 0
    for t in range(steps):
        if opened[t] > hi:
            new = slice(hi, opened[t])
            above = lanes.prev[new]
            value[new] = value[above] - up[above].astype(np.int64) + down[above].astype(np.int64) + lanes.height[new]
            hi = new.stop
        if border is not None and t < len(border):
            up[n], down[n] = border[t] > 0, border[t] < 0
        was, lo = lo, closed[t]
        a = slice(lo, hi)
        above = lanes.prev[a]
        plus, minus = up.take(above), down.take(above)
        if lo > was:
            up[was:lo], down[was:lo] = 1, 0
        code = codes.take(place[a] + t, mode="clip")
        eq = table.take(base[a] + code, mode="clip")
        p, m = pv[a], mv[a]
        xv = eq | m
        eq |= minus
        xh = eq & p
        xh += p
        xh ^= p
        xh |= eq
        ph = xh | p
        np.invert(ph, ph)
        ph |= m
        mh = xh
        mh &= p
        out_p, out_m = ph >> top[a], mh >> top[a]
        out_p &= ONE
        out_m &= ONE
        ph <<= ONE
        ph |= plus
        mh <<= ONE
        mh |= minus
        np.bitwise_and(ph, xv, m)
        xv |= ph
        np.invert(xv, xv)
        np.bitwise_or(xv, mh, p)
        some = next_end[lo] <= t
        if some:
            shut = ends[a] <= t
            out_p[shut] = 0
            out_m[shut] = 0
        v = value[a]
        v += out_p.view(np.int64)
        v -= out_m.view(np.int64)
        if some:
            out_p[shut] = 1
        up[a], down[a] = out_p, out_m
        if bottom is not None and t >= n - 1:
            bottom[t - n + 1] = int(up[n - 1]) - int(down[n - 1])
    return value[:n], bottom


def match_table(lane: np.ndarray, bit: np.ndarray, code: np.ndarray, lanes: int, width: int) -> np.ndarray:
    """Word (lane, code): the rows of the lane that hold the code."""
    table = np.zeros(lanes * width, np.uint64)
    np.bitwise_or.at(table, lane * width + code, ONE << bit.astype(np.uint64))
    return table


def characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def pair_of_codes(a: str, b: str, tokens: bool) -> tuple[np.ndarray, np.ndarray]:
    """The two sequences as numbers: code points, or tokens numbered within the pair."""
    if not tokens:
        return characters(a), characters(b)
    # bytes.split() cuts at ASCII white space, as py_split does
    number: dict = {}
    return tuple(np.fromiter((number.setdefault(w, len(number)) for w in x.encode("utf-8", "surrogatepass").split()), np.int64)
                 for x in (a, b))


def trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without shared prefix and suffix, the longer one first."""
    n = min(len(a), len(b))
    lo = int(np.argmin(np.append(a[:n] == b[:n], False)))
    a, b, n = a[lo:], b[lo:], n - lo
    tail = int(np.argmin(np.append(a[len(a) - n:][::-1] == b[len(b) - n:][::-1], False)))
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    return (a, b) if len(a) >= len(b) else (b, a)


def dense(parts: list[np.ndarray]) -> tuple[np.ndarray, int]:
    """All parts in one, renumbered from 0; how many numbers there are."""
    flat = np.concatenate(parts)
    used = np.zeros(int(flat.max()) + 1, bool)
    used[flat] = True
    return (np.cumsum(used) - 1)[flat], int(used.sum())


def banded(pairs: list[tuple[np.ndarray, np.ndarray]], bound: np.ndarray) -> np.ndarray:
    """Values of all pairs (longer, shorter; none empty); exact where at most ``bound``."""
    m, n = (np.array([len(p[side]) for p in pairs]) for side in (0, 1))
    codes, width = dense([p[0] for p in pairs] + [p[1] for p in pairs])
    pattern, text = codes[:m.sum()], codes[m.sum():]
    count = -(-m // WORD)
    of = np.repeat(np.arange(len(pairs)), count)
    first = np.cumsum(count) - count
    row = np.arange(len(of)) - first[of]
    within = np.arange(len(pattern)) - np.repeat(np.cumsum(m) - m, m)
    table = match_table(np.repeat(first, m) + within // WORD, within % WORD, pattern, len(of), width)
    more = m - n
    slack = np.maximum(0, bound - more) // 2      # a path that strays further comes back at more than the bound
    start = np.maximum(0, row * WORD - (more + slack)[of])
    end = np.minimum(n[of], (row + 1) * WORD + slack[of] + 1)
    order = np.argsort(start + row, kind="stable")
    rank = np.empty(len(of) + 1, np.int64)
    rank[order] = np.arange(len(of))
    rank[-1] = len(of)
    prev = np.where(row > 0, np.arange(len(of)) - 1, len(of))
    lanes = Lanes((np.cumsum(n) - n)[of][order], row[order], start[order], end[order],
                  np.minimum(WORD, m[of] - row * WORD)[order], rank[prev[order]])
    pv, mv = np.full(len(of), ~np.uint64(0)), np.zeros(len(of), np.uint64)
    value, _ = sweep(lanes, text, table, order * width, pv, mv)
    return value[rank[first + count - 1]]


def first_bound(a: np.ndarray, b: np.ndarray) -> int:
    part = max(WORD // 2, len(a) - len(b), len(a) // 8)
    if len(a) == len(b):
        differ = int((a != b).sum())
        return differ if differ <= 2 * part else part
    return part


def bag_bound(a: np.ndarray, b: np.ndarray) -> int:
    """No fewer edits than this: the elements that either has more often than the other (both as long)."""
    top = max(int(a.max()), int(b.max())) + 1
    if top > 1024 + 4 * len(a):
        a, b = np.split(np.unique(np.concatenate([a, b]), return_inverse=True)[1].ravel(), 2)
        top = 2 * len(a)
    more = np.bincount(a, minlength=top) - np.bincount(b, minlength=top)
    return int(more[more > 0].sum())


def settled(a: np.ndarray, b: np.ndarray) -> int | None:
    """The distance where Hamming's distance meets the lower bound, as where elements are only misread
    for others that do not come back; else None."""
    if len(a) != len(b):
        return None
    differ = int((a != b).sum())
    return differ if bag_bound(a, b) == differ else None


def alone(a: np.ndarray, b: np.ndarray) -> int:
    """The distance of one pair whose match table would be too large, without a band."""
    words = -(-len(a) // WORD)
    steps = sweep_cell(a, b, np.full(words, ~np.uint64(0)), np.zeros(words, np.uint64), np.ones(len(b), np.int8))
    return len(a) + int(steps.sum(dtype=np.int64))


def batch_distances(pairs: Sequence[tuple[np.ndarray, np.ndarray]]) -> list[int]:
    """The exact distance of each pair of number sequences."""
    cut = [trimmed(a, b) for a, b in pairs]
    out = np.array([len(a) for a, b in cut], np.int64)     # right where the shorter one is empty
    todo = []
    for i, (a, b) in enumerate(cut):
        known = settled(a, b) if len(b) else None
        if known is not None:
            out[i] = known
        elif len(a) * len(b) > TABLE_ENTRIES * WORD and -(-len(a) // WORD) * len(np.unique(np.concatenate([a, b]))) > TABLE_ENTRIES:
            out[i] = alone(a, b)
        elif len(b):
            todo.append((len(b), first_bound(a, b), i))
    while todo:
        todo.sort()
        again, batch, lanes, symbols = [], [], 0, 0
        for place, item in enumerate(todo):
            batch.append(item)
            a = cut[item[2]][0]
            lanes += -(-len(a) // WORD)
            symbols = max(symbols, len(a) + len(cut[item[2]][1]) if len(a) < 512 else 512)
            if lanes < BATCH_LANES and lanes * symbols < TABLE_ENTRIES and place + 1 < len(todo):
                continue
            bound = np.array([k for _, k, _ in batch])
            value = banded([cut[i] for _, _, i in batch], bound)
            for (n, k, i), v in zip(batch, value.tolist()):
                if v > k:
                    again.append((n, min(v, 4 * k), i))
                out[i] = v
            batch, lanes, symbols = [], 0, 0
        todo = again
    return out.tolist()


def levenshtein(a: Sequence, b: Sequence) -> int:
    """Exact unit-cost edit distance between two sequences."""
    number: dict = {}
    x, y = (np.fromiter((number.setdefault(s, len(number)) for s in q), np.int64) for q in (a, b))
    return batch_distances([(x, y)])[0]


def sweep_cell(pattern: np.ndarray, text: np.ndarray, pv: np.ndarray, mv: np.ndarray, border: np.ndarray) -> np.ndarray:
    """The steps along the bottom of one rectangle, whose left border is in ``pv`` and ``mv``
    (afterwards the right one) and whose upper steps are ``border``. Rows are taken in
    groups whose match table is bounded."""
    codes, width = dense([pattern, text])
    pattern, text = codes[:len(pattern)], codes[len(pattern):]
    group = max(1, TABLE_ENTRIES // width)
    for low in range(0, len(pv), group):
        part = pattern[low * WORD:(low + group) * WORD]
        within = np.arange(len(part))
        count = -(-len(part) // WORD)
        table = match_table(within // WORD, within % WORD, part, count, width)
        row = np.arange(count)
        lanes = Lanes(np.zeros(count, np.int64), row, np.zeros(count, np.int64), np.full(count, len(text)),
                      np.minimum(WORD, len(part) - row * WORD), np.where(row > 0, row - 1, count))
        _, border = sweep(lanes, text, table, row * width, pv[low:low + count], mv[low:low + count], border)
    return border


def _distances(ref: pd.Series, hyp: pd.Series, tokens: bool) -> pd.Series:
    known = [i for i, (r, h) in enumerate(zip(ref, hyp)) if r is not None and h is not None]
    found = batch_distances([pair_of_codes(ref.iat[i], hyp.iat[i], tokens) for i in known])
    out = pd.Series([None] * len(ref), dtype="Int64")
    out.iloc[known] = found
    return out


@F.pandas_udf(T.LongType())
def _token_distance(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    return _distances(ref, hyp, True)


@F.pandas_udf(T.LongType())
def _char_distance(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    return _distances(ref, hyp, False)


def char_distance(ref: Column, hyp: Column) -> Column:
    return _char_distance(ref, hyp)


def token_distance(ref: Column, hyp: Column) -> Column:
    """Distance between the white-space tokens of two texts."""
    return _token_distance(ref, hyp)


def py_split(c: Column) -> Column:
    """Split on white-space runs, no empty tokens."""
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def cer(ref: Column, hyp: Column) -> Column:
    """Distance / max(1, len(ref)) over code points."""
    return char_distance(ref, hyp) / F.greatest(F.lit(1), F.length(ref))


def wer(ref: Column, hyp: Column) -> Column:
    """Token distance / max(1, number of tokens of ref)."""
    return token_distance(ref, hyp) / F.greatest(F.lit(1), F.size(py_split(ref)))
