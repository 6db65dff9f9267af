"""Source divergence against plain arithmetic on odd rows, and the collapse of copies."""

import re
from collections import Counter, defaultdict

from claimlens.llm import divergence

ROWS = [
    ("en", "a", "Red fish, red FISH und Éclair"), ("en", "a", "red fish"), ("en", "b", "red red blue éclair"), ("en", "b", "blue fish9red"), ("en", "c", None),
    ("en", None, "red\x00fish blue"), (None, "a", "red"), ("de", "x", "eins zwei"), ("de", "y", ""), ("en", "a", "red fish"), ("en", "b", "red fish"), ("fr", "z", "un un un"),
]


def plain(rows, least=3, top=200):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(fold))
        df[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    share = lambda c, n, v: 1 + 10**9 * (c + 1) // (n + v)
    for lang, source in groups:
        kept = [t for t, n in df[lang].items() if n >= least]
        total = lambda ss: {t: sum(counts[lang, s][t] for s in ss) for t in kept}
        p = lambda c: {t: share(c[t], sum(c.values()), len(kept)) for t in kept}
        mine, others = total([source]), [s for la, s in groups if la == lang]
        ps = p(mine)
        pairs = [(s, sum((ps[t] - q) ** 2 // q for t, q in p(total([s])).items())) for s in others if s != source]
        marked = [(t, (ps[t] - q) ** 2 // q) for t, q in p(total(others)).items() if mine[t] and ps[t] > q]
        for part, items in (("pair", pairs), ("term", marked)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(ranked) if part == "pair" or i < top]
    return sorted(out)


def test_rows(spark):
    df = spark.createDataFrame([(*r, 7, "clash") for r in ROWS], "lang string, source string, text string, n long, term string")
    assert sorted(map(tuple, divergence.divergence(df).collect())) == plain(ROWS)
    assert sorted(map(tuple, divergence.divergence(df, least_docs=1, top=2).collect())) == plain(ROWS, 1, 2)
    assert divergence.divergence(df.limit(0)).collect() == []


def test_copies_are_cut_into_terms_once(spark):
    rows = [("en", f"s{i % 3}", "the same text") for i in range(500)] + [("en", "s0", "long " * 100_000), ("de", "s1", "the same text")]
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(7)
    texts = divergence.collapsed(df)
    held = {(r.lang, r.text[:8]): {x.source: x.n for x in r.copies} for r in texts.collect()}
    assert held == {("en", "the same"): {"s0": 167, "s1": 167, "s2": 166}, ("en", "long lon"): {"s0": 1}, ("de", "the same"): {"s1": 1}}
    assert sorted(map(tuple, divergence.divergence(df).collect())) == plain(rows)
    plan = texts._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_shares_are_exact():
    big = 9 * 10**15
    for count, total in ((0, 1), (2, 3), (big - 1, big), (10**14, big), (6, 7)):
        sql = divergence.share(str(count), str(total)).replace("div", "//")
        assert eval(sql) == 1 + 10**9 * (count + 1) // total
