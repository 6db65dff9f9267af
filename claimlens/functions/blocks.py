"""Similarity of two texts by matching blocks: the longest common block, then the same left and right of it.

The rules are those of the usual sequence matcher: of equally long blocks the first one in the left text, then in the right one; in a right
text of 200 characters or more, a character that makes up over a hundredth of it starts no block, but a block grows over it.
In most texts few characters are rare and they stand in short runs: the windows of these runs are listed by length, and each length is
looked through once from left to right, from the longest on. Where runs are long (short texts, in which all characters are rare), places of equal
rare characters are joined into runs along diagonals once; each search then cuts the runs to its box and takes the longest. Where
these would be too many, common windows are found by rolling hashes and bisection instead.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pairs of equal characters that runs are made of, at most.
PAIRS = 4_000_000
#: Windows of runs that are listed, as a multiple of a text's characters, and of short texts besides.
WINDOWS, BESIDES = 2, 200
_RADIX = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_RADIX), -1, 2**64))


def _popular(b: np.ndarray) -> np.ndarray:
    """Characters that start no block, by code."""
    counts = np.bincount(b, minlength=256)
    return counts > len(b) // 100 + 1 if len(b) >= 200 else np.zeros(len(counts), bool)


class _Runs:
    """Runs of equal rare characters: first places in both texts and lengths."""

    def __init__(self, a: np.ndarray, b: np.ndarray, rare: np.ndarray):
        order = np.argsort(b, kind="stable")
        order = order[rare[b[order]]]
        first, last = np.searchsorted(b[order], np.arange(257))[:-1], np.searchsorted(b[order], np.arange(257))[1:]
        i = np.flatnonzero(rare[a])
        n = (last - first)[a[i]]
        self.i = np.repeat(i, n)
        self.j = order[np.repeat(first[a[i]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        along = np.lexsort((self.i, self.j - self.i))
        self.i, self.j = self.i[along], self.j[along]
        new = np.ones(len(self.i), bool)
        new[1:] = (np.diff(self.i) != 1) | (np.diff(self.j) != 1)
        at = np.flatnonzero(new)
        self.i, self.j, self.n = self.i[at], self.j[at], np.diff(np.append(at, len(new)))

    def longest(self, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        cut = np.maximum(0, np.maximum(alo - self.i, blo - self.j))
        i, j = self.i + cut, self.j + cut
        size = np.minimum(np.minimum(self.n - cut, ahi - i), bhi - j)
        most = int(size.max(initial=0))
        if most <= 0:
            return alo, blo, 0
        best = np.flatnonzero(size == most)
        k = best[np.lexsort((j[best], i[best]))[0]]
        return int(i[k]), int(j[k]), most


class _Windows:
    """Sums of characters times powers, so that windows of equal characters have equal values."""

    def __init__(self, a: np.ndarray, b: np.ndarray, rare: np.ndarray):
        n = max(len(a), len(b)) + 1
        powers, self.back = (np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n, r, np.uint64)))) for r in (_RADIX, _INVERSE))
        # Popular characters differ between the texts, so that no window holds one.
        mixed = lambda x, other: np.where(rare[x], x.astype(np.uint64) + np.uint64(1), np.uint64(other)) * np.uint64(0xBF58476D1CE4E5B9)
        self.sums = [np.concatenate(([np.uint64(0)], np.cumsum(mixed(x, other) * powers[: len(x)], dtype=np.uint64))) for x, other in ((a, 1000), (b, 2000))]

    def of(self, side: int, lo: int, hi: int, n: int) -> np.ndarray:
        s = self.sums[side]
        return (s[lo + n : hi + 1] - s[lo : hi + 1 - n]) * self.back[lo : hi + 1 - n]

    def longest(self, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        low, high = 0, min(ahi - alo, bhi - blo)
        while low < high:
            n = (low + high + 1) // 2
            low, high = (n, high) if np.isin(self.of(0, alo, ahi, n), self.of(1, blo, bhi, n)).any() else (low, n - 1)
        if not low:
            return alo, blo, 0
        right = self.of(1, blo, bhi, low)
        left = self.of(0, alo, ahi, low)
        i = int(np.argmax(np.isin(left, right)))
        return alo + i, blo + int(np.argmax(right == left[i])), low


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    """How many characters of two texts are equal from the start."""
    n, step, at = min(len(a), len(b)), 64, 0
    while at < n:
        differ = a[at : min(n, at + step)] != b[at : min(n, at + step)]
        if differ.any():
            return at + int(np.argmax(differ))
        at, step = at + step, 2 * step
    return n


def _ahead(a: bytes, i: int, ahi: int, b: bytes, j: int, bhi: int) -> int:
    """How many characters are equal from i and j on, within the box."""
    n, at, step = min(ahi - i, bhi - j), 0, 32
    if n <= 0 or a[i] != b[j]:
        return 0
    while at < n:
        size = min(step, n - at)
        x, y = a[i + at : i + at + size], b[j + at : j + at + size]
        if x != y:
            differ = int.from_bytes(x, "little") ^ int.from_bytes(y, "little")
            return at + ((differ & -differ).bit_length() - 1 >> 3)
        at, step = at + size, 2 * step
    return n


def _behind(a: bytes, alo: int, i: int, b: bytes, blo: int, j: int) -> int:
    """How many characters are equal before i and j, within the box."""
    n, at, step = min(i - alo, j - blo), 0, 32
    if n <= 0 or a[i - 1] != b[j - 1]:
        return 0
    while at < n:
        size = min(step, n - at)
        x, y = a[i - at - size : i - at], b[j - at - size : j - at]
        if x != y:
            differ = int.from_bytes(x, "little") ^ int.from_bytes(y, "little")
            return at + size - 1 - (differ.bit_length() - 1 >> 3)
        at, step = at + size, 2 * step
    return n


def rare_characters(text: bytes) -> bytes:
    """The characters of a right text that start a block, in order."""
    codes = np.frombuffer(text, np.uint8)
    return np.flatnonzero((np.bincount(codes, minlength=256) > 0) & ~_popular(codes)).astype(np.uint8).tobytes()


#: By length of the windows: their places in order, and the windows there.
Grams = list[tuple[list[int], list[bytes]]]


def _grams(text: bytes, rare: bytes) -> Grams | None:
    """The windows of a text's runs of rare characters; None if they are too many."""
    out: Grams = []
    if not rare:
        return out
    left = WINDOWS * len(text) + BESIDES
    for run in re.finditer(b"[" + re.escape(rare) + b"]+", text):
        at, x = run.start(), run.group()
        n = len(x)
        left -= n * (n + 1) // 2
        if left < 0:
            return None
        while len(out) < n:
            out.append(([], []))
        for k in range(1, n + 1):
            places, windows = out[k - 1]
            for i in range(n + 1 - k):
                places.append(at + i)
                windows.append(x[i : i + k])
    return out


class Right:
    """A right text, to which left ones are compared: what is known of it is found once. kept holds the windows of left texts by their rare characters."""

    def __init__(self, text: bytes, rare: bytes | None = None):
        self.text, self.rare = text, rare_characters(text) if rare is None else rare
        grams = _grams(text, self.rare)
        self.places: list[dict[bytes, list[int]]] | None = None
        if grams is not None:
            self.places = [{} for _ in grams]
            for found, (places, windows) in zip(self.places, grams):
                for j, x in zip(places, windows):
                    found.setdefault(x, []).append(j)

    def windows(self, left: bytes) -> Grams | None:
        return None if self.places is None else _grams(left, self.rare)

    def matched(self, a: bytes, grams: Grams | None, pairs: int = PAIRS) -> int:
        """Characters in the matching blocks with a left text, whose windows() are grams."""
        if grams is None or self.places is None:
            return _matched_by_runs(a, self.text, pairs)
        b, total, boxes = self.text, 0, [(0, len(a), 0, len(self.text))]
        for k in range(min(len(grams), len(self.places)), 0, -1):
            (at, windows), places, rest = grams[k - 1], self.places[k - 1], []
            for alo, ahi, blo, bhi in boxes:
                # What lies left of a block has no window of this length in common, as it was looked through before; what lies right goes on.
                p, end, last = bisect_left(at, alo), bisect_right(at, ahi - k), bhi - k
                while p < end:
                    found = places.get(windows[p])
                    if found is not None and found[-1] >= blo:
                        j = found[bisect_left(found, blo)]
                        if j <= last:
                            i = at[p]
                            back, on = _behind(a, alo, i, b, blo, j), _ahead(a, i + k, ahi, b, j + k, bhi)
                            total += back + k + on
                            if i - back > alo and j - back > blo:
                                rest.append((alo, i - back, blo, j - back))
                            alo, blo = i + k + on, j + k + on
                            p = bisect_left(at, alo, p + 1)
                            continue
                    p += 1
                if alo < ahi and blo < bhi:
                    rest.append((alo, ahi, blo, bhi))
            boxes = rest
        return total + sum(_ahead(a, alo, ahi, b, blo, bhi) for alo, ahi, blo, bhi in boxes)


def matched(left: str, right: str, pairs: int = PAIRS) -> int:
    """Characters in the matching blocks of two ASCII texts. If pairs isn't the usual number, runs along diagonals or rolling hashes are used."""
    a, b = left.encode("ascii"), Right(right.encode("ascii"))
    return b.matched(a, b.windows(a) if pairs == PAIRS else None, pairs)


def _matched_by_runs(left: bytes, right: bytes, pairs: int) -> int:
    a, b = (np.frombuffer(t, np.uint8) for t in (left, right))
    rare = ~_popular(b)
    count = np.bincount(b, minlength=256) * rare
    search = (_Runs if int(np.bincount(a, minlength=256) @ count) <= pairs else _Windows)(a, b, rare)
    total, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        if alo >= ahi or blo >= bhi:
            continue
        i, j, n = search.longest(alo, ahi, blo, bhi)
        back = _equal(a[alo:i][::-1], b[blo:j][::-1])
        i, j, n = i - back, j - back, n + back
        n += _equal(a[i + n : ahi], b[j + n : bhi])
        if n:
            total += n
            todo += [(alo, i, blo, j), (i + n, ahi, j + n, bhi)]
    return total


def plain(text: Column) -> Column:
    """A text as it is compared: printable ASCII only, other than word characters as spaces, in lower case."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\x20-\\x7E]", "")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(t, "[^A-Za-z0-9_ ]", " "), " +", " ")))


class _Words:
    """The different long words of a text, and those of letters only. Equal words of the texts of a cell are one object."""

    def __init__(self, text: bytes, known: dict[bytes, bytes]):
        self.long = {known.setdefault(w, w) for w in set(text.split(b" ")) if len(w) > 3}

    def letters(self) -> set[bytes]:
        return {w for w in self.long if w.isalpha()}


def compared(texts: dict[object, list[bytes]], pairs: Iterable[tuple]) -> Iterator[tuple]:
    """Of pairs (left key, right key, more): the pair, the similarity of the plain() texts, and how many long words are in the left one only, and in the right one.

    Similarity is twice the matched characters over all; 1 for two empty texts. Right texts with equal rare characters follow each other, so that
    what is known of a left text holds for all of them.
    """
    by_right: dict[object, list[tuple]] = {}
    for pair in pairs:
        by_right.setdefault(pair[1], []).append(pair)
    rights = sorted(((rare_characters(t), key, k) for key in by_right for k, t in enumerate(texts[key])), key=lambda x: x[0])
    known: dict[bytes, bytes] = {}
    words: dict[bytes, _Words] = {}
    windows: dict[bytes, Grams | None] = {}
    rare = None
    for own, key, k in rights:
        right = Right(texts[key][k], own)
        long, letters = (w := _Words(right.text, known)).long, w.letters()
        if own != rare:
            rare, windows = own, {}
        for pair in by_right[key]:
            for a in texts[pair[0]]:
                if a not in words:
                    words[a] = _Words(a, known)
                if a not in windows:
                    windows[a] = right.windows(a)
                both = len(a) + len(right.text)
                similarity = 2.0 * right.matched(a, windows[a]) / both if both else 1.0
                yield *pair, similarity, len(words[a].long - long), len(letters - words[a].long)
