"""One string against several others: edit distances and matching-block ratios, with Python integers as bit rows."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa

#: Strings that are laid side by side in one integer, and matchers remembered per task.
TOGETHER, REMEMBERED = 64, 1_000
#: Length from which on ``difflib`` does not look up the frequent characters of a string.
LONG = 200


def _fields(others: list[str]) -> tuple[dict[str, int], int, int, list[tuple[int, int]]]:
    """Places of each character, all places, first places, and (shift, mask) of each string; a free bit above a string takes its carries."""
    where: dict[str, int] = {}
    every, first, fields, at = 0, 0, [], 0
    for s in others:
        for k, c in enumerate(s, at):
            where[c] = where.get(c, 0) | 1 << k
        mask = (1 << len(s)) - 1
        every |= mask << at
        first |= 1 << at if s else 0
        fields.append((at, mask))
        at += len(s) + 1
    return where, every, first, fields


def edit_distances(text: str, others: list[str]) -> list[int]:
    """Levenshtein distance of ``text`` to each of ``others`` (Myers' bit-parallel columns)."""
    where, every, first, fields = _fields(others)
    up, down = every, 0  # rows that are one more, or one less, than the row above
    for c in text:
        eq = where.get(c, 0)
        x = (((eq & up) + up) ^ up) | eq  # carries into the free bits fall out below
        right = (down | every ^ (x | up) & every) << 1 | first
        left = (up & x) << 1 & every
        x = eq | down
        up, down = left | every ^ (x | right) & every, right & x
    return [len(text) + (up >> at & mask).bit_count() - (down >> at & mask).bit_count() for at, mask in fields]


def common_lengths(text: str, others: list[str]) -> list[int]:
    """Length of the longest common subsequence of ``text`` and each of ``others``."""
    where, every, _, fields = _fields(others)
    row = every
    for c in text:
        hit = row & where.get(c, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & every
    return [mask.bit_count() - (row >> at & mask).bit_count() for at, mask in fields]


def positions(text: str) -> dict[str, list[int]]:
    """Places of each character of a text."""
    where: dict[str, list[int]] = {}
    for i, c in enumerate(text):
        where.setdefault(c, []).append(i)
    return where


def _longest_match(a: str, b: str, spots: list[int], b2j: dict[str, list[int]], alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
    """``SequenceMatcher.find_longest_match`` without junk; ``spots`` are the places of ``a`` whose character ``b2j`` knows.

    In a string of 200 characters or more ``difflib`` looks up its rare characters only, so nearly all places of ``a`` have nothing to look up.
    """
    besti, bestj, size, last = alo, blo, 0, -2
    j2len: dict[int, int] = {}
    for at in range(bisect_left(spots, alo), len(spots)):
        i = spots[at]
        if i >= ahi:
            break
        before, j2len = j2len if i == last + 1 else {}, {}
        last = i
        for j in b2j[a[i]]:
            if j < blo:
                continue
            if j >= bhi:
                break
            k = j2len[j] = before.get(j - 1, 0) + 1
            if k > size:
                besti, bestj, size = i - k + 1, j - k + 1, k
    while besti > alo and bestj > blo and a[besti - 1] == b[bestj - 1]:
        besti, bestj, size = besti - 1, bestj - 1, size + 1
    while besti + size < ahi and bestj + size < bhi and a[besti + size] == b[bestj + size]:
        size += 1
    return besti, bestj, size


def matching_ratio(text: str, matcher: SequenceMatcher, low: float, most: int, where: dict[str, list[int]] | None = None) -> float | None:
    """``difflib`` ratio of ``text`` to the second string of ``matcher``, or None as soon as it can't be above ``low``.

    ``most`` bounds the matched characters; ``where`` are the ``positions`` of the text. The largest open part goes first; the blocks found are the same in any order.
    """
    b, b2j = matcher.b, matcher.b2j
    where = positions(text) if where is None else where
    spots = sorted(i for c in (b2j if len(b2j) < len(where) else where) if c in b2j for i in where.get(c, ()))
    total, matched, left = len(text) + len(b), 0, 0
    parts: list[tuple[int, int, int, int, int]] = []

    def add(alo, ahi, blo, bhi):
        size = min(ahi - alo, bhi - blo)
        if size > 0:
            heappush(parts, (-size, alo, ahi, blo, bhi))
        return max(size, 0)

    left = add(0, len(text), 0, len(b))
    while parts:
        if 2.0 * min(matched + left, most) / total <= low:
            return None
        size, alo, ahi, blo, bhi = heappop(parts)
        i, j, k = _longest_match(text, b, spots, b2j, alo, ahi, blo, bhi)
        left += size
        if k:
            matched += k
            left += add(alo, i, blo, j) + add(i + k, ahi, j + k, bhi)
    return 2.0 * matched / total if total else 1.0


def best_edit_ratio() -> Callable[[str, list[str]], float]:
    """Largest of 1 - distance / longer length."""
    def best(text: str, others: list[str]) -> float:
        return max(1 - d / max(len(text), len(o), 1) for d, o in zip(edit_distances(text, others), others))

    return best


def best_matching_ratio() -> Callable[[str, list[str]], float]:
    """Largest ``difflib`` ratio. Long strings, of which it looks up few places, are matched as they are; of the others, matching blocks form
    a common subsequence, so the string with the longest one goes first."""
    known: dict[str, SequenceMatcher] = {}

    def best(text: str, others: list[str]) -> float:
        top, where = 0.0, positions(text)

        def tried(some: list[str], most: list[int]) -> None:
            nonlocal top
            bound = [2.0 * m / max(len(text) + len(o), 1) for m, o in zip(most, some)]
            for k in sorted(range(len(some)), key=lambda k: -bound[k]):
                if bound[k] <= top:
                    break
                if len(known) >= REMEMBERED:
                    known.clear()
                o = some[k]
                if o not in known:
                    known[o] = SequenceMatcher(None, "", o)
                top = max(top, matching_ratio(text, known[o], top, most[k], where) or 0.0)

        long, short = [o for o in others if len(o) >= LONG], [o for o in others if len(o) < LONG]
        tried(long, [min(len(text), len(o)) for o in long])
        if short:
            tried(short, common_lengths(text, short))
        return top

    return best


def best_of_runs(make: Callable[[], Callable[[str, list[str]], float]]):
    """Arrow batches (hk, a, ha, hb) to (hk, r): the largest ratio of each text of a batch to the others it is paired with."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            a = batch.column("a").to_numpy()
            order = np.argsort(a, kind="stable")
            keys, out = [], []
            for run in np.split(order, np.flatnonzero(np.diff(a[order])) + 1):
                text = batch.column("ha")[int(run[0])].as_py()
                others = batch.column("hb").take(pa.array(run)).to_pylist()
                keys.append(int(run[0]))
                out.append(max(best(text, others[i:i + TOGETHER]) for i in range(0, len(others), TOGETHER)))
            yield pa.RecordBatch.from_arrays([batch.column("hk").take(pa.array(keys)), pa.array(out, pa.float64())], names=["hk", "r"])

    return work
