"""Quality rules with suffix-array repetition.

The suffix array of a text's words is built by prefix doubling, for all texts of a batch at once: a round
sorts the suffixes that are still tied by their ranks at twice the length. Of the longest common prefixes of
neighbours, long ones come by Kasai's rule. Maximal repeated substrings are the intervals of the LCP
array (no longer to the right) whose suffixes aren't all preceded by one word (no longer to the left). The
spans of all their occurrences are united. A text is rejected if the spans cover too large a part of it, or
if the longest repeat is too long.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tokens, with_columns

SPACE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """The base rules' limits, and those of the repetition: a repeat is at least min_repeat words long."""

    min_words: int = 50
    max_repeat_words_percent: int = 50
    min_repeat: int = 8
    max_covered: float = 0.3
    max_longest: int = 100


def suffix_array(ids: np.ndarray, doc: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and LCP array (with the suffix before it) of each text, one text behind the other.

    ids: word ids; doc: the text of each position, ascending; left: positions to the text's end, itself included.
    A suffix of a text is a prefix of none of another text's; the end of a text sorts first.
    """
    n = len(ids)
    base = np.int64(ids.max() + 2)
    order = np.argsort(doc * base + ids, kind="stable")
    rank = np.empty(n, np.int64)
    # rank: the first place of the group of suffixes that are equal so far
    key = (doc * base + ids)[order]
    fresh = np.concatenate(([True], key[1:] != key[:-1]))
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    k = 1
    while True:
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        p = order[at]
        more = left[p] > k
        second = np.where(more, rank[np.minimum(p + k, n - 1)] + 1, 0)
        first = rank[p]
        o = np.lexsort((second, first))
        p, first, second = p[o], first[o], second[o]
        order[at] = p
        new = np.concatenate(([True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
        fresh[at] = new
        place = np.where(new, at, 0)
        rank[p] = np.maximum.accumulate(place)
        k *= 2
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, place


def common_prefixes(ids: np.ndarray, order: np.ndarray, doc: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix in order with the one before it in the same text, 0 if none.

    All pairs are compared at once, a word a step; the few that are longer go on by Kasai's rule.
    """
    n = len(order)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    a, b = order[:-1], order[1:]
    live = np.flatnonzero((doc[a] == doc[b]) & (ids[a] == ids[b]))
    a, b, at = a[live], b[live], live + 1
    room = np.minimum(left[a], left[b])
    length = np.ones(len(a), np.int64)
    for _ in range(7):
        go = length < room
        go[go] = ids[a[go] + length[go]] == ids[b[go] + length[go]]
        done = ~go
        lcp[at[done]] = length[done]
        a, b, at, room, length = a[go], b[go], at[go], room[go], length[go] + 1
        if not len(a):
            return lcp
    # Long repeats are few suffixes, but may be long: Kasai's order, in which the length falls by at most one a step.
    by = np.argsort(b)
    last_b, last_len = -2, 0
    words = ids.tolist()
    for i in by.tolist():
        x, y, most = int(a[i]), int(b[i]), int(room[i])
        h = max(int(length[i]), last_len - 1 if y == last_b + 1 else 0)
        h = min(h, most)
        while h < most and words[x + h] == words[y + h]:
            h += 1
        lcp[at[i]] = h
        last_b, last_len = y, h
    return lcp


def lcp_intervals(lcp: np.ndarray, minimum: int) -> list[tuple[int, int, int]]:
    """(length, first, last) of the intervals of the suffix array whose suffixes share a prefix of minimum or more."""
    out, stack, before = [], [], -1

    def close(h: int, last: int, start: int) -> int:
        while stack and stack[-1][0] > h:
            length, start = stack.pop()
            out.append((length, start, last))
        return start

    at = np.flatnonzero(lcp >= minimum)
    for i, h in zip(at.tolist(), lcp[at].tolist()):
        if i != before + 1:
            close(0, before, 0)
        start = close(h, i - 1, i - 1)
        if not stack or stack[-1][0] < h:
            stack.append((h, start))
        before = i
    close(0, before, 0)
    return out


def maximal_repeats(ids: np.ndarray, order: np.ndarray, lcp: np.ndarray, begins: np.ndarray, minimum: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length, first and last place (in the suffix array) of the repeats of minimum words or more that can't be made longer at either end.

    begins: whether a text begins at each position, where nothing is before it.
    """
    found = np.array(lcp_intervals(lcp, minimum), np.int64).reshape(-1, 3)
    before = np.where(begins, -1 - np.arange(len(ids)), np.append(0, ids[:-1]))[order]
    changes = np.cumsum(np.append(0, before[1:] != before[:-1]))
    length, first, last = found[changes[found[:, 2]] > changes[found[:, 1]]].T
    return length, first, last


def spans(order: np.ndarray, length: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the longest of these repeats at each position that has one; inner intervals come before outer ones.

    A position's shorter repeats lie within its longest, so that the union of all occurrences is that of these spans, and
    the work is linear in the intervals' places.
    """
    place, size, after = [], [], {}

    def free(k: int) -> int:
        path = []
        while k in after:
            path.append(k)
            k = after[k]
        for x in path:
            after[x] = k
        return k

    for n, a, b in zip(length.tolist(), first.tolist(), last.tolist()):
        k = free(a)
        while k <= b:
            place.append(k)
            size.append(n)
            after[k] = k + 1
            k = free(k + 1)
    return order[np.array(place, np.int64)], np.array(size, np.int64)


def union_length(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """1 at each of n positions that some span covers."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return (np.cumsum(edge[:-1]) > 0).astype(np.int64)


def repetition(words: Tokens, minimum: int) -> dict[str, np.ndarray]:
    """For each text: words in repeated 3-word windows; words under maximal repeats of minimum words or more, how many these are, and the longest."""
    sizes, ids, doc = words.sizes, words.index, words.texts()
    n, docs = len(ids), len(sizes)
    zero = np.zeros(docs, np.int64)
    if not n:
        return {"repeat_words": zero, "covered": zero, "intervals": zero, "longest": zero}
    left = words.ends()[doc] - np.arange(n)
    order, _ = suffix_array(ids, doc, left)
    lcp = common_prefixes(ids, order, doc, left)
    total = lambda x: np.bincount(doc, weights=x, minlength=docs).astype(np.int64)

    windows = order[np.maximum(lcp, np.append(lcp[1:], 0)) >= 3]
    length, first, last = maximal_repeats(ids, order, lcp, left == sizes[doc], minimum)
    starts, size = spans(order, length, first, last)
    count, longest = zero.copy(), zero.copy()
    np.add.at(count, doc[order[first]], 1)
    np.maximum.at(longest, doc[order[first]], length)
    return {"repeat_words": total(union_length(windows, windows + 3, n)), "covered": total(union_length(starts, starts + size, n)), "intervals": count, "longest": longest}


def dup_lines(text: str) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = text.split("\n")
    if len(lines) == len(set(lines)):
        return 0
    n, seen = 0, set()
    for line in lines:
        if line.strip(SPACE):
            n += line in seen
            seen.add(line)
    return n


RULES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_repeats long, longest_repeat long, covered_words long, kept boolean"


def quality_rules(df: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """df with the counts of the base rules, the repetition of each whole text, and kept.

    Words are what lies between ASCII white space. n_repeats counts the maximal repeats, that is the repeated substrings of
    min_repeat words or more that can't be made longer at either end, covered_words the words under any of their occurrences,
    longest_repeat the words of the longest (0 if there is none). kept is false if a base rule fails, if covered_words is more than max_covered of the words,
    or longest_repeat is over max_longest.

    A null text counts as empty: it has no words, fails the base rules and isn't kept. Repeated rows get the same
    verdict. An empty table gives no rows. Columns of df with these names are replaced.
    """

    def make():
        def columns(texts):
            words = Tokens(texts)
            found = repetition(words, limits.min_repeat)
            out = []
            for i, (t, n) in enumerate(zip(texts.to_pylist(), words.sizes.tolist())):
                repeated = int(found["repeat_words"][i])
                failed = n < limits.min_words or 100 * repeated > limits.max_repeat_words_percent * n
                covered, longest = int(found["covered"][i]), int(found["longest"][i])
                bad = failed or covered > limits.max_covered * n or longest > limits.max_longest
                out.append((n, len(t) - sum(map(t.count, SPACE)), sum(map(t.count, SYMBOLS)), dup_lines(t), repeated, failed, int(found["intervals"][i]), longest, covered, not bad))
            return list(map(list, zip(*out)))

        return columns

    return with_columns(df, text, RULES, make)


def kept_only(df: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The rows of df that quality_rules() keeps, with the columns of df."""
    mark = "_kept_by_quality"
    rules = quality_rules(df.select("*"), text, limits) if not {c.lower() for c in df.columns} & {f.split()[0] for f in RULES.split(", ")} else None
    if rules is not None:
        return rules.where("kept").select(*df.columns)
    packed = df.select(F.struct("*").alias(mark), F.col(text).alias("_text"))
    return quality_rules(packed, "_text", limits).where("kept").select(f"{mark}.*")
