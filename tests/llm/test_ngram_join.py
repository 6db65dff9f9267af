"""The similarity join against all pairs, with copies, near copies, blocks and odd rows."""

import random

import numpy as np

from claimlens.llm import ngram_join as nj
from claimlens.llm.common import Tokens


def shingle_set(text, words=5):
    w = (text or "").split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def brute(rows, threshold=0.8):
    sets = [shingle_set(t) for _, t in rows]
    n = len(rows)
    links, root = [0] * n, list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for k in range(i):
            both = len(sets[i] & sets[k])
            if both and both / len(sets[i] | sets[k]) >= threshold:
                links[i] += 1
                links[k] += 1
                root[find(i)] = find(k)
    names = {}
    for i in range(n):
        names.setdefault(find(i), []).append(rows[i][0])
    return {rows[i][0]: (min(names[find(i)]), links[i]) for i in range(n)}


def corpus(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7)))
    base = [" ".join(word() for _ in range(r.randrange(60, 200))) for _ in range(25)]
    rows = list(base)
    for t in base[:12]:
        for _ in range(r.randrange(1, 9)):
            w = t.split()
            for _ in range(r.randrange(0, 3)):
                w[r.randrange(len(w))] = word()
            rows.append(" ".join(w))
    rows += [base[0]] * 4 + ["a", "a", "b c", "b  c", "a b c d e", "", "", None, "x" * 3000]
    r.shuffle(rows)
    return [(100 + i, t) for i, t in enumerate(rows)]


def test_against_all_pairs(spark):
    rows = corpus()
    want = brute(rows)
    df = spark.createDataFrame([(i, t, 5, "clash") for i, t in rows], "doc_id long, text string, n int, root string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in nj.similar_texts(df).collect()}
    assert got == want
    # The same with blocks of a few rows, so that groups are cut.
    small = nj.similar_texts(df.repartition(5), j=nj.Join(block_rows=3, block_shingles=900))
    assert {r.doc_id: (r.class_id, r.n_links) for r in small.collect()} == want


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    near = text.replace("w29", "zz")
    twice = spark.createDataFrame([(1, text), (1, text), (4, near), (4, near), (5, text)], "doc_id long, text string")
    assert sorted(tuple(r) for r in nj.similar_texts(twice).collect()) == [(1, 1, 2), (4, 1, 2), (5, 1, 2)]
    rows = [(1, text), (1, text), (None, text), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in nj.similar_texts(df).collect()), key=str)
    assert got == [(1, 1, 1), (2, 2, 0), (3, 3, 0), (None, 1, 1)]
    assert nj.similar_texts(df.limit(0)).count() == 0


def test_null_ids_are_linked_like_others(spark):
    text = [f"w{i}" for i in range(60)]
    near = lambda k: " ".join([*text[:-1], f"end{k}"])
    other = " ".join(f"v{i}" for i in range(60))
    one_id = " ".join(f"u{i}" for i in range(60))
    rows = [(None, near(1)), (None, near(2)), (7, near(3)), (3, near(3)), (None, other), (None, other + " more"), (9, "alone"), (5, one_id), (5, one_id + " x"), (5, "another")]
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in nj.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 3, 3), (None, 3, 3), (7, 3, 3), (3, 3, 3), (None, None, 1), (None, None, 1), (9, 9, 0), (5, 5, 1), (5, 5, 1), (5, 5, 0)], key=str)


def rounds(monkeypatch, only):
    """How often components() stored a contracted graph."""
    names = []
    real = nj.stored
    monkeypatch.setattr(nj, "stored", lambda df, name: names.append(name) or real(df, name))
    return lambda: sum(n == f"{only}-step" for n in names)


def test_components(spark, monkeypatch):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1200)] + [(2000, i) for i in range(2001, 2100)]
    root = {v: v for e in edges for v in e if e[0] != e[1]}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    count = rounds(monkeypatch, "t")
    groups = {}
    for x in nj.components(spark.createDataFrame(edges, "a long, b long"), "t").collect():
        groups.setdefault(x.root, set()).add(x.v)
    want = {}
    for v, x in root.items():
        want.setdefault(x, set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
    assert count() <= 10


def test_a_chain_of_revisions(spark, monkeypatch):
    """Each of 200 texts is near the next; the first and the last have nothing in common."""
    words = [f"w{i}" for i in range(200 * 3 + 97)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 97])) for i in range(200)]
    count = rounds(monkeypatch, "classes")
    want = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.class_id, x.n_links) for x in nj.similar_texts(df, j=nj.Join(block_rows=20)).collect()}
    assert got == want
    assert count() <= 10


def test_intersections_and_shingles():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 400, 150)).astype(np.uint64) for _ in range(9)]
    got = nj.intersections(sets)
    for i, a in enumerate(sets):
        for k, b in enumerate(sets):
            assert got[i, k] == len(np.intersect1d(a, b))
    values, sizes = nj.shingles(Tokens(["a b c d e f", "", "a b", "a b c d e f a b c d e f"]), 5)
    assert sizes.tolist() == [2, 0, 1, 6] and len(values) == 9


def test_sorted_labels_give_the_nodes():
    """Against prefixes by hand, with the rows in one piece and in pieces."""
    j = nj.Join(trees=2, deepest=6)
    r = np.random.default_rng(5)
    sig = r.integers(0, 2, (80, 2, 6)).astype(np.uint16)
    label = nj.labels([x.tobytes() for x in sig], j)
    rows = sorted((t, int(label[i, t, 0]), int(label[i, t, 1]), i) for i in range(80) for t in range(2))
    for sizes in ([160], [1, 7, 52, 100]):
        nodes, found, at = nj.Nodes(3), [], 0
        for n in sizes:
            part = rows[at : at + n]
            at += n
            found += list(zip(*(x.tolist() for x in nodes.add(*(np.array(c, k) for c, k in zip(zip(*part), (np.int32, np.uint64, np.uint64, np.int64)))))))
        for depth in range(3, 7):
            groups = {i: {i} for i in range(80)}
            for a, b, d in found:
                if d >= depth and groups[a] is not groups[b]:
                    groups[a] |= groups[b]
                    for v in groups[b]:
                        groups[v] = groups[a]
            want = {i: {i} for i in range(80)}
            for t in range(2):
                for i in range(80):
                    for k in range(i):
                        if (sig[i, t, :depth] == sig[k, t, :depth]).all() and want[i] is not want[k]:
                            want[i] |= want[k]
                            for v in want[k]:
                                want[v] = want[i]
            assert groups == want


def test_prefixes_are_shortened_until_the_recall_is_met():
    assert nj.depths(nj.Join()) == [8, 7]
    assert nj.depths(nj.Join(target_recall=0.9)) == [8]
    assert nj.depths(nj.Join(trees=4, shallowest=3)) == [8, 7, 6, 5, 4, 3]
    for d in nj.depths(nj.Join())[:-1]:
        assert nj.found_share(0.8, d, nj.Join()) < nj.Join().target_recall


def test_a_large_group_of_near_copies_hides_no_borderline_pairs(spark):
    """Pairs at 0.80 (80 of 100 shingles) beside 200 near copies, whose many links are nearly all found at any depth."""
    text = [f"g{i}" for i in range(204)]
    rows = [" ".join(text[:-1] + [f"end{i}"]) for i in range(200)]
    for i in range(500):
        w = [f"p{i}x{n}" for n in range(94)]
        rows += [" ".join(w), " ".join(w[:-10] + [f"q{i}x{n}" for n in range(10)])]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in nj.similar_texts(df).collect()}
    assert all(got[i] == (0, 199) for i in range(200))
    # The target is a probability: one of 500 pairs may be lost.
    lost = [i for i in range(200, 1200, 2) if (got[i], got[i + 1]) != ((i, 1), (i, 1))]
    assert len(lost) <= 1, lost


def test_pairs_of_one_block_count_once_beside_an_empty_block(spark):
    """Two long near copies in three blocks: where both fall into one block, the cells across hold that block alone."""
    rows = []
    for i in range(0, 24, 2):
        w = [f"p{i}x{n}" for n in range(300)]
        rows += [(i, " ".join(w)), (i + 1, " ".join(w[:-1] + ["end"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # 592 shingles in a group are over 2 * 250, so that there are 3 blocks.
    got = {r.doc_id: (r.class_id, r.n_links) for r in nj.similar_texts(df, j=nj.Join(block_shingles=250)).collect()}
    assert got == {i: (i - i % 2, 1) for i, _ in rows}
