"""Similarity by matching blocks against the standard sequence matcher."""

import difflib
import random

from pyspark.sql import functions as F

from claimlens.functions import blocks
from claimlens.plans import crossfile
from claimlens.sources.tables import table

SF = "/root/testdata/sf0.01"


def standard(a, b):
    return sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks())


def changed(r, text):
    out = list(text)
    for _ in range(r.randrange(1, 12)):
        at = r.randrange(len(out) + 1)
        out[at : at + r.randrange(4)] = r.choices("abcdeqz 1", k=r.randrange(5))
    return "".join(out)


def test_matched_characters():
    r = random.Random(11)
    for n, alphabet in ((30, "ab"), (150, "abc "), (260, "aabbccddeeq1z "), (900, "eeeettttaaaaooiinnsshhrrddlluqxz019 ")):
        for _ in range(120 if n < 900 else 25):
            a = "".join(r.choices(alphabet, k=r.randrange(n)))
            b = changed(r, a) if r.random() < 0.7 else "".join(r.choices(alphabet, k=r.randrange(n)))
            want = standard(a, b)
            assert blocks.matched(a, b) == want, (a, b)
            assert blocks.matched(a, b, pairs=-1) == want, (a, b)  # by windows
    assert blocks.matched("", "") == blocks.matched("abc", "") == 0


def test_long_texts():
    r = random.Random(5)
    words = ["".join(r.choices("etaoinshrdlucmfwypvbgkjqxz", k=r.randrange(2, 9))) for _ in range(3000)]
    a = " ".join(r.choices(words, k=60_000))
    b = a[:1000] + "q" * 50 + a[1200:200_000] + a[150_000:]
    assert blocks.matched(a, a) == len(a)
    assert blocks.matched(a, b) == standard(a, b)  # all letters are popular: nothing is found behind the first change
    a, b = (t.replace("the", "7h3")[:40_000] for t in (a, b))
    assert blocks.matched(a, b) == standard(a, b) == blocks.matched(a, b, pairs=-1)


def test_plain(spark):
    df = spark.createDataFrame([("Él  SAYS:\n\"it's\" x_1\t",), (None,)], "t string")
    assert [x[0] for x in df.select(blocks.plain(F.col("t"))).collect()] == ["l says it s x_1", ""]


def test_pairs_of_documents(spark):
    texts = {x.doc_id: x.t for x in table(spark, SF, "documents").select("doc_id", blocks.plain(F.col("text")).alias("t")).collect()}
    got = crossfile.text_layer_similarity(spark, SF).collect()
    assert len(got) > 20
    for x in got:
        a, b = texts[x.key_i], texts[x.key_j]
        want = difflib.SequenceMatcher(None, a, b).ratio()
        assert abs(x.similarity - want) < 1e-6
        left, right = set(a.split()), set(b.split())
        only = len({w for w in left - right if len(w) > 3}), len({w for w in right - left if len(w) > 3 and w.isalpha()})
        assert (x.only_left, x.only_right) == only and x.hidden == (want <= 0.80 and (max(only) > 5 or want < 0.50))


def test_pairs_are_dealt_out(spark):
    """The comparison follows an exchange of its own, whose partitions aren't joined by size."""
    plan = crossfile.text_layer_similarity(spark, SF)._jdf.queryExecution().executedPlan().toString()
    above = plan[plan.index("MapInArrow") :]
    assert "REPARTITION_BY_NUM" in above[: above.index("Join")]


def test_texts_of_a_cell_are_compared_as_the_standard_does():
    r = random.Random(3)
    base = "".join(r.choices("eeeettttaaaaooiinnsshhrrddlluqxz019   ", k=700))
    texts = {k: [changed(r, base).encode()] for k in range(12)} | {20: [b""], 21: [b""], 22: [base[:150].encode()], 23: [changed(r, base[:150]).encode()], 24: [b"x" * 500]}
    pairs = [(a, b, a + b) for a in texts for b in texts if a < b]
    got = list(blocks.compared(texts, iter(pairs)))
    assert sorted(x[:3] for x in got) == pairs
    for a, b, _, similarity, only_left, only_right in got:
        (left,), (right,) = texts[a], texts[b]
        assert abs(similarity - difflib.SequenceMatcher(None, left.decode(), right.decode()).ratio()) < 1e-12
        left, right = set(left.split()), set(right.split())
        assert only_left == len({w for w in left - right if len(w) > 3}) and only_right == len({w for w in right - left if len(w) > 3 and w.isalpha()})


def test_a_text_moves_once_a_cell(spark):
    """Of a group of near copies all pairs are asked for, but its texts aren't moved with each pair."""
    from claimlens.operators import pairs

    near = spark.range(200).selectExpr("id as key_i").crossJoin(spark.range(200).selectExpr("id as key_j")).where("key_i < key_j").selectExpr("*", "key_i + key_j as distance")
    texts = spark.range(300).selectExpr("id as key", "concat('t', id) as t")

    def compare(held, own):
        for n, (i, j, d) in enumerate(own):
            yield i, j, d, 0 if n else len(held), (held[i][0] + held[j][0]).decode()

    got = pairs.compare_in_cells(near, texts, compare, "moved int, both string").collect()
    assert sorted((x.key_i, x.key_j, x.distance, x.both) for x in got) == [(i, j, i + j, f"t{i}t{j}") for i in range(200) for j in range(i + 1, 200)]
    assert sum(x.moved for x in got) <= 16 * 200 < 2 * len(got) / 10
    plan = crossfile.text_layer_similarity(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert " a#" not in plan and " b#" not in plan  # no row has two texts
