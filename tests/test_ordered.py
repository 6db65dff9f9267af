"""Places in large groups, the parallel greedy deduplication and salted joins, against plain loops and without a task that holds a group."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlens.functions import textbits
from claimlens.operators import ordered, pairs
from claimlens.plans import admin, crossfile
from claimlens.sources.tables import table

SF = "/root/testdata/sf0.01"


def largest_tasks(spark, work):
    """The number of records that the largest task of each shuffle-reading stage read while work ran."""
    status = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    listed = lambda: status.stageList(None, False, False, none, None)
    stages = listed()
    before = {stages.apply(i).stageId() for i in range(stages.size())}
    work()
    found, stages = [], listed()
    for i in range(stages.size()):
        s = stages.apply(i)
        if s.stageId() not in before and s.shuffleReadRecords() > 0:
            tasks = status.taskList(s.stageId(), s.attemptId(), 10_000)
            held = [tasks.apply(k).taskMetrics() for k in range(tasks.size())]
            found.append(max(m.get().shuffleReadMetrics().recordsRead() for m in held if m.isDefined()))
    return found


@pytest.fixture(scope="module")
def skewed(spark):
    """19,000 rows of one group and 1,000 of twenty others, with values that are all different."""
    r = random.Random(2)
    rows = [("hot" if i < 19_000 else f"g{i % 20}", r.random() ** 9) for i in range(20_000)]
    return rows, spark.createDataFrame(rows, "g string, v double").repartition(4)


def test_percentiles_of_a_hot_group(spark, skewed):
    rows, df = skewed
    groups = {}
    for g, v in rows:
        groups.setdefault(g, []).append(v)
    qs = {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    got = {}
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so little would be one task
    try:
        tasks = largest_tasks(spark, lambda: got.update({r.g: r for r in ordered.ranks_of(df, ["g"], "v", qs, nearest=True).collect()}))
        medians = {r.g: r.median for r in ordered.medians_of(df, ["g"], "v").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g, vs in groups.items():
        vs.sort()
        assert [got[g][k] for k in qs] == [vs[min(math.floor(len(vs) * q), len(vs) - 1)] for q in qs.values()]
        assert medians[g] == pytest.approx(statistics.median(vs))
    assert tasks and max(tasks) < 0.3 * len(rows)


def test_running_sums(spark):
    r = random.Random(4)
    rows = [(r.choice(["a", None, "b"]), i, r.randrange(5)) for i in range(500)]
    r.shuffle(rows)
    got = ordered.running(spark.createDataFrame(rows, "g string, i int, n int"), ["g"], [-F.col("i")], F.col("n")).collect()
    assert len(got) == 500 and set(got[0].asDict()) == {"g", "i", "n", "_upto", "_total"}
    for x in got:
        own = [n for g, i, n in rows if g == x.g and i >= x.i]
        assert (x._upto, x._total) == (sum(own), sum(n for g, _, n in rows if g == x.g))
    assert ordered.running(spark.createDataFrame([], "g string, i int"), ["g"], ["i"]).collect() == []
    assert ordered.running(spark.range(9), [], ["id"]).where("_upto != id + 1 or _total != 9").count() == 0


def test_hot_digest_is_dealt_to_salts(spark):
    rows = spark.range(20_000).select(F.col("id").alias("k"), F.when(F.col("id") % 20 == 0, F.col("id").cast("string")).otherwise("hot").alias("h")).repartition(4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = []
        tasks = largest_tasks(spark, lambda: out.extend(pairs.duplicate_classes(rows, "k", "h").collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(out) == 19_000 and {(r.class_id, r.n_others) for r in out} == {(1, 18_999)}
    assert max(tasks) < 0.3 * 20_000


def plain_greedy(rows, least):
    kept, out = {}, set()
    for g, i, h in sorted(rows, key=lambda r: (r[0], r[1])):
        near = h is not None and any(((h ^ k) & (2**64 - 1)).bit_count() < least for k in kept.setdefault(g, []))
        if not near:
            out.add((g, i))
            if h is not None:
                kept[g].append(h)
    return out


def test_greedy_firsts(spark):
    r = random.Random(8)
    seeds = [r.getrandbits(64) for _ in range(12)]
    rows = []
    for i in range(400):
        h = r.choice(seeds)
        for _ in range(r.randrange(9)):  # balls of near hashes, and chains in which neighbours' neighbours are far
            h ^= 1 << r.randrange(64)
        h = h - 2**64 if h >= 2**63 else h
        rows.append((r.choice("ab"), i, r.choice([h, h, h, None]) if i % 50 == 0 else h))
    rows += [("a", 1000 + i, rows[0][2]) for i in range(100)]  # copies
    chain = 0
    for i in range(60):  # each one is near the next only
        chain ^= 0b11111 << (5 * (i % 12))
        rows.append(("chain", i, chain - 2**64 if chain >= 2**63 else chain))
    df = spark.createDataFrame(rows, "g string, i int, h long")
    got = {tuple(x) for x in pairs.greedy_firsts(df, "g", "i", "h").collect()}
    assert got == plain_greedy(rows, 10)
    assert got == {(x.g, x.i) for x in pairs.greedy_dedup(df, "g", "i", "h").collect()}
    assert pairs.greedy_firsts(df.limit(0), "g", "i", "h").collect() == []


def test_near_pairs_without_a_join(spark):
    """Candidates are no rows: a long bucket, short ones and the null group are compared in place."""
    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), i, r.getrandbits(10) | r.getrandbits(14) << 24) for i in range(2500)]
    df = spark.createDataFrame(rows, "g string, i int, h long")
    near = pairs.banded_hash_pairs(df, "i", "h", 3, ["g"])
    assert "Join" not in near._jdf.queryExecution().executedPlan().toString()
    got = sorted(((x.g or "", x.key_i, x.key_j, x.distance) for x in near.collect()))
    want = []
    for g in ("a", "b", None):
        firsts = {}
        for x, i, h in rows:
            if x == g:
                firsts.setdefault(h, i)
        own = sorted((i, h) for h, i in firsts.items())
        h = np.array([h for _, h in own], np.uint64)
        d = np.bitwise_count(h[:, None] ^ h[None, :])
        want += [(g or "", own[i][0], own[j][0], int(d[i, j])) for i, j in zip(*np.nonzero(d <= 3)) if i < j]
    assert got == sorted(want) and len(want) > 100


def test_greedy_dedup_of_texts(spark):
    docs = textbits.with_sign_bits(table(spark, SF, "documents").select("doc_id", "lang", "text"), "text", "h")
    rows = [(r.lang, r.doc_id, r.h) for r in docs.collect()]
    got = {(r.lang, r.doc_id) for r in crossfile.greedy_dedup_texts(spark, SF).collect()}
    assert got == plain_greedy(rows, 10) and len(got) < len(rows)


def test_sign_bits():
    import pandas as pd
    import pyarrow as pa

    texts = ["a b c", "", None, "A  b\tc a", "word"]
    h = {w: int(pd.util.hash_array(np.array([w], object), categorize=False)[0]) for w in ("a", "b", "c", "word")}
    three = sum(1 << k for k in range(64) if sum(h[w] >> k & 1 for w in "abc") >= 2)
    assert [int(x) & (2**64 - 1) for x in textbits.sign_bits(pa.array(texts, pa.string()))] == [three, 0, 0, three, h["word"]]


def test_serving_order_by_a_plain_queue(spark):
    """Rounds over the users who still have jobs, the second of them first."""
    sizes = {r.conv_id: r["count"] for r in table(spark, SF, "conversations").groupBy("conv_id").count().collect()}
    single, users = [i for i in sorted(sizes) if sizes[i] <= 1], {}
    for i in sorted(sizes):
        if sizes[i] > 1:
            users.setdefault(i % 37, []).append(i)
    names = list(users)
    order, n = list(single), 0
    while any(len(q) > n for q in users.values()):
        order += [users[u][n] for u in names[1:] + names[:1] if len(users[u]) > n]
        n += 1
    got = sorted(admin.serving_order(spark, SF).collect(), key=lambda r: r.place)
    assert [r.conv_id for r in got] == order and [r.place for r in got] == list(range(1, len(order) + 1))
