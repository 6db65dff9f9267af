"""Best-fit packing against a plain search, and its promises on odd rows."""

import math
import random

from claimlens.llm import packing as pk


def plain(sizes, sources, clusters, capacity, slack):
    limits = {s: max(1, math.ceil(slack * sources.count(s) / max(1, sum(sizes) / capacity))) for s in sources}
    bins, placed = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [
            (room, b)
            for b, (room, ss, cs) in enumerate(bins)
            if room > 0 and room >= sizes[i] and (clusters[i] is None or clusters[i] not in cs) and (sources[i] is None or ss.count(sources[i]) < limits[sources[i]])
        ]
        b = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append((capacity, [], set()))
        room, ss, cs = bins[b]
        bins[b] = (room - sizes[i], ss + [sources[i]], cs | {clusters[i]})
        placed[i] = b
    return placed


def test_best_fit_is_the_tightest_compatible_bin():
    r = random.Random(4)
    for _ in range(60):
        n = r.randrange(0, 60)
        sizes = [r.randrange(0, 40) for _ in range(n)]
        sources = [r.choice(["a", "a", "a", "b", "c", None]) for _ in range(n)]
        clusters = [r.choice(["x", "y", None, str(r.random())]) for _ in range(n)]
        for slack in (0.0, 1.25, 2.0):
            placed, bin_sources, _ = pk.best_fit(sizes, sources, clusters, 50, slack)
            assert placed == plain(sizes, sources, clusters, 50, slack)
            for b, bitmap in enumerate(bin_sources):
                assert bitmap.bit_count() == sum(at == b and s is not None for s, at in zip(sources, placed))


def test_a_hot_source_is_limited_too():
    """A third of all documents in one source: bins stay full, and none has more of it than twice what an even spread needs."""
    r = random.Random(6)
    sizes = [min(2000, int(r.lognormvariate(5.2, 0.9))) for _ in range(4000)]
    sources = ["hot" if r.random() < 1 / 3 else f"s{r.randrange(19)}" for _ in sizes]
    placed, _, _ = pk.best_fit(sizes, sources, [None] * len(sizes), 2048)
    limits = pk.source_limits(sizes, sources, 2048, 2.0)
    assert 1 < limits["hot"] < 10 and all(n == 1 for s, n in limits.items() if s != "hot")
    for s in set(sources):
        held = [b for b, x in zip(placed, sources) if x == s]
        assert max(map(held.count, set(held))) <= limits[s]
    assert sum(sizes) / (2048 * (max(placed) + 1)) > 0.93


def test_packed_rows(spark):
    r = random.Random(1)
    rows = [(i, r.choice(["s1", "s1", None, f"few{i % 30}"]), r.randrange(0, 300), r.choice(["c", None, str(i)]), "clash") for i in range(300)]
    rows += [(300, "s", 1000, "z", "c"), (301, "s", 250, None, "c"), (302, "s", None, "c", "c"), (302, "s", None, "c", "c"), (None, None, 5, None, "c")]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens int, cluster string, shard string")
    out = pk.packed(df, p=pk.Packing(capacity=300, shard_rows=80), keep=("n_tokens", "cluster", "source")).collect()
    assert len({x.bin_id.split("-")[0] for x in out}) == 5
    bins: dict = {}
    for x in out:
        bins.setdefault(x.bin_id, []).append(x)
    for items in bins.values():
        total = sum(x.piece_tokens for x in items)
        assert total <= 300 and all((x.bin_tokens, x.bin_items) == (total, len(items)) for x in items)
        clusters = [x.cluster for x in items if x.cluster]
        assert len(clusters) == len(set(clusters))
        assert items[0].bin_sources == len({x.source for x in items} - {None})
        few = [x.source for x in items if x.source and x.source != "s1"]
        assert len(few) == len(set(few))  # sources with fewer pieces than bins are exclusive
    whole: dict = {}
    for x in out:
        whole.setdefault(x.doc_id, []).append(x)
    assert [x.piece_tokens for x in sorted(whole[300], key=lambda x: x.piece)] == [300, 300, 300, 100]
    assert len(out) == len(rows) + 3
    assert sum(x.piece_tokens for x in out) == sum(t or 0 for _, _, t, _, _ in rows)
    assert pk.packed(df.limit(0)).count() == 0
    again = pk.packed(df.repartition(7, "n_tokens"), p=pk.Packing(capacity=300, shard_rows=80), keep=("n_tokens", "cluster", "source")).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_words_and_cluster(spark):
    df = spark.createDataFrame([(1, "a b  c\n"), (2, None), (3, ""), (4, "a b  c\n")], "doc_id long, text string")
    got = {x.doc_id: (x.n_tokens, x.cluster) for x in pk.words_and_cluster(df).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4)] == [3, 0, 0, 3]
    assert got[1][1] == got[4][1] and got[2][1] is None


def test_near_copies_share_no_bin(spark, tmp_path):
    """The registered query: near copies conflict, also with null and repeated ids."""
    from claimlens.llm.queries import op6_best_fit_packing

    w = [f"w{i}" for i in range(100)]
    near = [" ".join(w[:-1] + [f"end{i}"]) for i in range(6)]
    rows = [(i, "s", t) for i, t in enumerate(near)] + [(0, "s", near[0].replace(" ", "  ")), (None, "s", near[1] + " more")]
    rows += [(100 + i, "t", " ".join(f"x{i}y{n}" for n in range(50))) for i in range(8)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = op6_best_fit_packing(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    copies = [x.bin_id for x in out if x.doc_id is None or x.doc_id < 100]
    assert len(copies) == len(set(copies)) == 8
    assert len({x.bin_id for x in out}) == 8
