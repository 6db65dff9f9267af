"""Lexical search against scoring every document, in shards that skip blocks and on odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np

from claimlens.llm import lexical as lx

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(FOLD))


def plain(docs, items, top=50):
    bags = [(i, Counter(words(t))) for i, t in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            n = sum(b.values())
            m = 50 + 50 * n * n_docs // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 20 * m)) for t in set(words(text)) if b[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if missing else i, -s) for k, (s, missing, i) in enumerate(sorted(scored)[:top])]
    return out


def test_odd_rows(spark):
    docs = [(1, "Red fish blue"), (2, "red red RED"), (2, "red red RED"), (None, "red red RED"), (3, None), (4, ""), (5, "éclair 9lives fish-fish"), (6, "blue " * 50_000), (7, "none of these"), (-8, "red red RED")]
    items = [(10, "RED blue?"), (11, "éclair"), (11, "9lives of"), (12, None), (13, "absent"), (None, "fish"), (10, "RED blue?")]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n long, terms string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    key = lambda r: tuple((x is None, x or 0) for x in r)
    want = sorted(plain(docs, items[:-1]), key=key)
    for s in (lx.Settings(), lx.Settings(item_terms=2, cells=8, block=1), lx.Settings(top=2)):
        expected = want if s.top == 50 else sorted(plain(docs, items[:-1], 2), key=key)
        assert sorted(map(tuple, lx.ranked(df, asked, s).collect()), key=key) == expected
    assert lx.ranked(df.limit(0), asked).collect() == lx.ranked(df, asked.limit(0)).collect() == lx.ranked(df.where("doc_id = 4"), asked).collect() == []


def test_blocks_are_skipped_and_nothing_is_lost():
    r = random.Random(5)
    topics = [[f"t{k}w{j}" for j in range(30)] for k in range(12)]
    docs = []
    for i in range(1500):
        own = r.choice(topics)
        docs.append((i, " ".join(r.choices(own, k=r.randrange(3, 40)) + r.choices(["the", "of", "and"], k=10))))
    docs += [(1500 + i, docs[7][1]) for i in range(200)]  # many equal scores
    items = [(k, " ".join(r.sample(topics[k % 12], 6) + ["the", "of"])) for k in range(24)]
    want = plain(docs, items)
    block = lx.Items.of([type("Row", (), {"item_id": i, "terms": sorted(set(words(t)))}) for i, t in items])
    bags = [Counter(words(t)) for _, t in docs]
    df = Counter(t for b in bags for t in b)
    block.weights = lx.weights(len(docs), np.array([df[t] for t in block.vocabulary]))
    total = sum(sum(b.values()) for b in bags)
    plan = lx.Plan(block, lx.Settings(block=16))
    rows = [[(k, b[t]) for k, t in enumerate(block.vocabulary) if b[t]] for b in bags]
    flat = np.array([x for row in rows for x in row], np.int64)
    shard = lx.Shard(
        plan, np.arange(len(docs)), np.zeros(len(docs), bool), np.array([sum(b.values()) for b in bags]), np.array([len(x) for x in rows]), flat[:, 0], flat[:, 1], len(docs), total
    )
    for t, blocks in enumerate(shard.members):  # summaries are the largest impacts, rounded up
        for members, summary in zip(blocks, shard.summaries[t] if blocks else [], strict=True):
            most = shard.impacts[np.ix_(members, plan.coordinates[t])].max(axis=0)
            assert ((summary.astype(int) * lx.STEP >= most) & (summary.astype(int) * lx.STEP < most + lx.STEP)).all()
    seen = 0
    for k, (item, _) in enumerate(items):
        mine = [(d, s) for i, _, d, s in want if i == item]
        docs_found, scores, scored = shard.best(k, 0)
        assert list(zip(docs_found.tolist(), scores.tolist())) == mine
        again = shard.best(k, mine[-1][1])  # with the lower bound that a pilot gives
        assert list(zip(again[0].tolist(), again[1].tolist())) == mine and again[2] <= scored
        seen += scored
    assert seen < 0.5 * len(items) * len(docs)
