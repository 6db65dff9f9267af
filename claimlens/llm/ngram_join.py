"""Similarity join of texts by the Jaccard similarity of their word 5-grams, by an LSH forest of MinHash signatures.

1. Each text's set of shingles gets a digest and a signature of `trees` labels of `deepest` MinHash values. Texts with
   equal sets form one row from here on (similarity 1), however many they are.
2. Each tree is a sorted prefix trie: the labels of all trees are sorted over range partitions, and the length of the prefix
   that a label has in common with the one before it says in which nodes both are. A node's rows are linked to its first row.
3. The join starts at the deepest nodes, which only very similar texts share, and shortens the prefixes step by step. At each
   depth, nodes that overlap form candidate groups, and only pairs that were in no common group before are verified, exactly,
   from the shingle sets. A large group is cut into blocks of rows that lie close together in the first trie, and each pair of
   blocks that share a node is compared by itself; it counts links and returns a row per text, not per pair.
4. A link of similarity s is in a node with probability p(s) = 1 - (1 - s^length)^trees. The prefixes are shortened until
   p(threshold) meets the target, so that it is met for each link, whatever the others are.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tokens, mixed, stored, string_hashes, text_batches


@dataclass(frozen=True)
class Join:
    """block_rows and block_shingles bound what a task compares at once; target_recall is that of a link at the threshold itself.

    deepest: values of a label, 8 at most (they are kept as two 64-bit numbers).
    """

    words: int = 5
    threshold: float = 0.8
    trees: int = 32
    deepest: int = 8
    shallowest: int = 5
    target_recall: float = 0.999
    block_rows: int = 300
    block_shingles: int = 400_000
    seed: int = 11


#: Bits of the bitmap of text hashes whose texts are read again: 4 MB at most.
SLOTS = 1 << 25


def found_share(s: float, depth: int, j: Join) -> float:
    """The probability that a link of similarity s is in a node at this depth."""
    return 1 - (1 - s**depth) ** j.trees


def depths(j: Join) -> list[int]:
    """The depths of the join: from the deepest to the first that meets the target, or to the shallowest."""
    all_of = range(j.deepest, j.shallowest - 1, -1)
    enough = next((d for d in all_of if found_share(j.threshold, d, j) >= j.target_recall), j.shallowest)
    return [d for d in all_of if d >= enough]


def shingles(tokens: Tokens, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as 64-bit hashes, sorted by text and hash, and how many each text has.

    A text of fewer words has one shingle of them all, a text of no words has none.
    """
    h = string_hashes(tokens.words)[tokens.index]
    n = len(h)
    doc = tokens.texts()
    left = tokens.ends()[doc] - np.arange(n)
    size = tokens.sizes[doc]
    weights = mixed(np.arange(1, words + 1, dtype=np.uint64))
    value = np.zeros(n, np.uint64)
    for j in range(words):
        part = h[j:] * weights[j]
        value[: n - j] += np.where(left[: n - j] > j, part, np.uint64(0)) if len(part) else 0
    value = mixed(value + np.minimum(size, words).astype(np.uint64))
    start = (left >= words) | (left == size)
    value, doc = value[start], doc[start]
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[fresh], np.bincount(doc[fresh], minlength=len(tokens.sizes)).astype(np.int64)


def digests(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set that isn't empty: sums of hashes of its members, so that order doesn't matter."""
    return tuple(np.add.reduceat(mixed(values ^ np.uint64(salt)), first).view(np.int64) for salt in (0x51ED270B, 0xD6E8FEB86659FD93))


def signatures(values: np.ndarray, first: np.ndarray, j: Join) -> np.ndarray:
    """MinHash values, trees x deepest of 16 bits for each set that isn't empty."""
    r = np.random.default_rng(j.seed)
    k = j.trees * j.deepest
    a = r.integers(1, 2**31, k).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    b = r.integers(0, 2**32, k).astype(np.uint32)
    base = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(first), k), np.uint16)
    end = np.append(first[1:], len(values))
    lo = 0
    while lo < len(first):
        hi = max(lo + 1, int(np.searchsorted(end, first[lo] + 65536, "right")))
        part = base[first[lo] : end[hi - 1]]
        at = first[lo:hi] - first[lo]
        work = np.empty_like(part)
        for i in range(k):
            np.multiply(part, a[i], out=work)
            work += b[i]
            low = np.minimum.reduceat(work, at)
            out[lo:hi, i] = (low * np.uint32(0x9E3779B1)) >> np.uint32(16)
        lo = hi
    return out


def signed(docs: DataFrame, j: Join, text: str = "text") -> DataFrame:
    """doc_id, text_hash, set_a and set_b (the set's digests), n (its size) and sig; a text without words has n = 0."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch, texts in text_batches(batches, text):
            values, sizes = shingles(Tokens(texts), j.words)
            some = sizes > 0
            first = (np.cumsum(sizes) - sizes)[some]
            a, b = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            sig: list = [None] * len(sizes)
            if len(first):
                a[some], b[some] = digests(values, first)
                for i, s in zip(np.flatnonzero(some).tolist(), signatures(values, first, j)):
                    sig[i] = s.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(a), pa.array(b), pa.array(sizes.astype(np.int32)), pa.array(sig, pa.binary())], names=["doc_id", "text_hash", "set_a", "set_b", "n", "sig"])

    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text).mapInArrow(run, f"doc_id {kind}, text_hash long, set_a long, set_b long, n int, sig binary")


def labels(sig: list[bytes], j: Join) -> np.ndarray:
    """The labels of signatures as two numbers each: (sets, trees, 2); earlier values are in higher bits."""
    s = np.frombuffer(b"".join(sig), np.uint16).reshape(-1, j.trees, j.deepest)
    full = np.zeros((*s.shape[:2], 8), np.uint64)
    full[:, :, : j.deepest] = s
    full = full.reshape(*s.shape[:2], 2, 4)
    return (full << np.array([48, 32, 16, 0], np.uint64)).sum(axis=3, dtype=np.uint64)


def common_prefix(hi: np.ndarray, lo: np.ndarray, hi2: np.ndarray, lo2: np.ndarray) -> np.ndarray:
    """How many values, of 8, two labels have in common from the start."""
    out = np.zeros(len(hi), np.int32)
    live = np.ones(len(hi), bool)
    for x in (hi ^ hi2, lo ^ lo2):
        for k in range(4):
            live &= (x >> np.uint64(48 - 16 * k)) & np.uint64(0xFFFF) == 0
            out += live
    return out


def prefixes(label: np.ndarray, depth: int) -> np.ndarray:
    """The node of each label at a depth, as a 64-bit key (of the prefix alone)."""
    hi, lo = label[..., 0], label[..., 1]
    cut = lambda x, n: x >> np.uint64(16 * (4 - n)) if n > 0 else np.zeros_like(x)
    return mixed(mixed(cut(hi, min(depth, 4))) * np.uint64(31) + cut(lo, depth - 4))


class Nodes:
    """Goes along sorted labels and keeps, for each depth, the first row of the node that the last label is in."""

    def __init__(self, shallowest: int):
        self.least, self.last, self.first = shallowest, None, np.zeros(9, np.int64)

    def add(self, tree: np.ndarray, hi: np.ndarray, lo: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row that shares a node with the one before it: the first row of their deepest node, itself, and its depth."""
        before = self.last or (-1, 0, 0, 0)
        shift = lambda x, first: np.concatenate((np.array([first], x.dtype), x[:-1]))
        common = common_prefix(hi, lo, shift(hi, before[1]), shift(lo, before[2]))
        common[shift(tree, before[0]) != tree] = 0
        center = np.empty(len(rep), np.int64)
        at = np.arange(len(rep))
        for d in range(self.least, 9):
            start = np.maximum.accumulate(np.where(common < d, at, -1))
            first = np.where(start >= 0, rep[start], self.first[d])
            on = common == d
            center[on] = first[on]
            self.first[d] = first[-1]
        self.last = (tree[-1], hi[-1], lo[-1], rep[-1])
        on = common >= self.least
        return center[on], rep[on], common[on]


def tries(signs: DataFrame, least: int, j: Join) -> DataFrame:
    """The edges (a, b, depth) that hold the nodes of all tries together, down to the depth least. signs: rep and sig.

    The edges of depth d or more connect the rows of each node at depth d. Range partitions cut nodes where they like, so no node
    is too large for a task; the first and last rows of the partitions, a few numbers each, meet on the driver.
    """
    spark = signs.sparkSession

    def entries(batches):
        for batch in batches:
            both = labels(batch.column(1).to_pylist(), j).view(np.int64)
            n = batch.num_rows
            tree = np.tile(np.arange(j.trees, dtype=np.int32), n)
            yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(both[:, :, 0].reshape(-1)), pa.array(both[:, :, 1].reshape(-1)), pa.array(np.repeat(batch.column(0).to_numpy(), j.trees))], names=["tree", "hi", "lo", "rep"])

    names = ["a", "b", "depth", "part", "tree", "hi", "lo", "firsts"]

    def edges(batches):
        nodes, part, opened = Nodes(least), TaskContext.get().partitionId(), False

        def edge_of(kind: int, row: tuple):
            firsts = pa.array([nodes.first.tolist()], pa.list_(pa.int64()))
            tree, hi, lo, rep = row
            return pa.RecordBatch.from_arrays([pa.array([int(rep)], pa.int64()), pa.array([None], pa.int64()), pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([int(tree)], pa.int32()), pa.array([hi], pa.uint64()).view(pa.int64()), pa.array([lo], pa.uint64()).view(pa.int64()), firsts], names=names)

        for batch in batches:
            if batch.num_rows:
                tree, hi, lo, rep = (batch.column(k).to_numpy() for k in range(4))
                hi, lo = hi.view(np.uint64), lo.view(np.uint64)
                if not opened:
                    yield edge_of(-1, (tree[0], hi[0], lo[0], rep[0]))
                    opened = True
                a, b, depth = nodes.add(tree, hi, lo, rep)
                n = len(a)
                none = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(depth), *none], names=names)
        if opened:
            yield edge_of(-2, nodes.last)

    key = ["tree", "hi", "lo", "rep"]
    rows = signs.select("rep", "sig").mapInArrow(entries, "tree int, hi long, lo long, rep long")
    rows = rows.repartitionByRange(*key).sortWithinPartitions(*key)
    found = stored(rows.mapInArrow(edges, "a long, b long, depth int, part int, tree int, hi long, lo long, firsts array<long>"), "tries")
    ends = found.where("depth < 0").orderBy("part", F.desc("depth")).collect()
    one = lambda r: (np.array([r.hi], np.int64).view(np.uint64), np.array([r.lo], np.int64).view(np.uint64))
    over, centers, before = [], np.zeros(9, np.int64), None
    for first, last in zip(ends[::2], ends[1::2]):
        shared = int(common_prefix(*one(before), *one(first))[0]) if before and before.tree == first.tree else 0
        if shared >= least:
            over.append((int(centers[shared]), first.a, shared))
        # A node that the partition's first row is in may have begun further back.
        own = np.array(last.firsts)
        centers = np.where((own == first.a) & (np.arange(9) <= shared), centers, own)
        before = last
    pairs = found.where("depth > 0").select("a", "b", "depth")
    if over:
        pairs = pairs.unionByName(spark.createDataFrame(over, "a long, b long, depth int"))
    return stored(pairs.groupBy("a", "b").agg(F.max("depth").alias("depth")), "forest")


def components(edges: DataFrame, name: str) -> DataFrame | None:
    """v and root, one id of its component, for each end of the edges (a, b); by repeated contraction. None without edges.

    Each round orders the vertices anew by a hash, maps each to the first of its neighbours and itself and on to where that one
    is mapped, and keeps the edges between different images. Whatever the ids and the shape of the graph (chains, stars), it
    shrinks by a constant factor on average, so the rounds grow with the logarithm of its size. Only aggregates and joins are
    used, and the graph that is left is stored after each round.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stored(both(edges.where("a != b")).distinct(), f"{name}-edges")
    roots, turn = None, 0
    while not edges.isEmpty():
        place = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("id"))
        first = edges.groupBy("a").agg(F.min(place("b")).alias("b")).select("a", F.least(F.col("b"), place("a"))["id"].alias("to"))
        step = stored(first.join(first.select(F.col("a").alias("to"), F.col("to").alias("on")), "to").select("a", F.col("on").alias("to")), f"{name}-step")
        if roots is None:
            roots = step.select(F.col("a").alias("v"), F.col("to").alias("root"))
        else:
            roots = roots.join(step.select(F.col("a").alias("root"), "to"), "root", "left").select("v", F.coalesce("to", "root").alias("root"))
        left, right = step.select("a", F.col("to").alias("ta")), step.select(F.col("a").alias("b"), F.col("to").alias("tb"))
        edges = stored(edges.join(left, "a").join(right, "b").where("ta != tb").select(F.col("ta").alias("a"), F.col("tb").alias("b")).distinct(), f"{name}-edges")
        turn += 1
    if turn > 1:
        roots = stored(roots, f"{name}-roots")
    return roots


def across(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """The edges between the roots of their ends' groups; an end without a group is its own root."""
    a, b = groups.select(F.col("v").alias("a"), F.col("root").alias("ra")), groups.select(F.col("v").alias("b"), F.col("root").alias("rb"))
    return edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))


def united(groups: DataFrame, over: DataFrame) -> DataFrame:
    """groups after their roots, and rows without a group, were put together by over."""
    on = over.select(F.col("v").alias("root"), F.col("root").alias("top"))
    moved = groups.join(on, "root", "left").select("v", F.coalesce("top", "root").alias("root"))
    return moved.unionByName(over.join(groups.select("v"), "v", "left_anti").select("v", "root"))


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """The size of the intersection of each two sets, by products of blocks of the incidence matrix."""
    m = len(sets)
    if m == 2:
        return np.array([[len(sets[0]), (n := len(np.intersect1d(*sets, assume_unique=True)))], [n, len(sets[1])]], np.float32)
    _, which, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    out = np.diag(np.bincount(row[count[which] == 1], minlength=m)).astype(np.float32)
    shared = count > 1
    column = np.cumsum(shared) - 1
    on = shared[which]
    row, column = row[on], column[which[on]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = 4096
    for c in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, (c, c + width))
        x = np.zeros((m, width), np.float32)
        x[row[a:b], column[a:b] - c] = 1
        out += x @ x.T
    return out


def linked(rep: np.ndarray, copies: np.ndarray, block: np.ndarray, seen: np.ndarray, sets: list[np.ndarray], threshold: float, across: bool):
    """Links of the sets of a group, or between two blocks of it: rows of (rep, links to other texts, root).

    Pairs that were seen in one group before don't count. Where the sets are across two blocks, only pairs across them count,
    also if one block turns out to be empty; the pairs within each are another task's. root is the smallest rep that a chain of
    these links leads to.
    """
    size = np.array([len(s) for s in sets], np.float32)
    common = intersections(sets)
    similarity = common / np.maximum(size[:, None] + size - common, 1)
    link = (common > 0) & (similarity >= threshold - 1e-6) & (seen[:, None] != seen)
    if across:
        link &= block[:, None] != block
    on = link.any(axis=1)
    root = rep.copy()
    if on.any():
        inner, label = link[np.ix_(on, on)], rep[on]
        while True:
            near = np.where(inner, label, np.iinfo(np.int64).max).min(axis=1)
            new = np.minimum(label, near)
            if (new == label).all():
                break
            label = new
        root[on] = label
    return rep[on], (link @ copies.astype(np.float64))[on].astype(np.int64), root[on]


def verified(cells: DataFrame, j: Join) -> DataFrame:
    """rep, links and root for the rows of cells (bundle, cell, block, across, seen, rep, copies, members)."""
    threshold = j.threshold

    def compare(table: pa.Table) -> pa.Table:
        rows = table.to_pandas().sort_values(["cell", "rep"], kind="stable")
        found: tuple[list, list, list] = ([], [], [])
        for _, part in rows.groupby("cell", sort=False):
            if len(part) > 1:
                sets = [np.frombuffer(x, np.uint64) for x in part["members"]]
                column = lambda name: part[name].to_numpy()
                for held, values in zip(found, linked(column("rep"), column("copies"), column("block"), column("seen"), sets, threshold, bool(part["across"].iloc[0]))):
                    held.extend(values.tolist())
        return pa.table([pa.array(x, pa.int64()) for x in found], names=["rep", "links", "root"])

    return cells.groupBy("bundle").applyInArrow(compare, "rep long, links long, root long")


def blocks_of(members: DataFrame, signs: DataFrame, depth: int, j: Join) -> tuple[DataFrame, DataFrame]:
    """members (rep, grp, seen, copies, n) of large groups with their blocks, and the pairs of blocks (grp, low, high) that share a node.

    Rows that share a node of the first trie go to one block, but for nodes of many rows, which are dealt out.
    """

    def nodes(batches):
        for batch in batches:
            key = prefixes(labels(batch.column(1).to_pylist(), j), depth)
            key = mixed(key + np.arange(j.trees, dtype=np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(key), pa.list_(pa.int64()))], names=["rep", "nodes"])

    keyed = members.join(signs.select("rep", "sig").mapInArrow(nodes, "rep long, nodes array<long>"), "rep")
    keyed = stored(keyed.withColumn("node", F.element_at("nodes", 1)), "large-groups")
    rows_of = keyed.groupBy("grp", "node").agg(F.count("*").alias("in_node"))
    part = F.pmod(F.xxhash64("rep"), F.ceil(6 * F.col("in_node") / j.block_rows))
    keyed = keyed.join(rows_of, ["grp", "node"]).withColumn("block", F.pmod(F.xxhash64("node", part), F.col("blocks")).cast("int"))
    keyed = stored(keyed.drop("node", "in_node"), "blocks")
    in_node = keyed.select("grp", "block", F.explode("nodes").alias("node")).distinct()
    low, high = in_node.withColumnRenamed("block", "low"), in_node.withColumnRenamed("block", "high")
    pairs = low.join(high, ["grp", "node"]).where("low <= high").select("grp", "low", "high").distinct()
    return keyed.drop("nodes"), pairs


def round_of(groups: DataFrame, before: DataFrame | None, reps: DataFrame, sets: DataFrame, last_depth: int, j: Join) -> DataFrame:
    """The verified links of rows that share a group (v, root) and shared none before, at the depth above it.

    In a large group, what doesn't even share a node at the last depth is left out from the start; so what was seen is verified.
    """
    members = groups.select(F.col("v").alias("rep"), F.col("root").alias("grp")).join(reps.select("rep", "copies", "n"), "rep")
    if before is None:
        members = members.withColumn("seen", F.col("rep"))
    else:
        members = members.join(before.select(F.col("v").alias("rep"), F.col("root").alias("seen")), "rep", "left").withColumn("seen", F.coalesce("seen", "rep"))
    blocks = F.ceil(F.greatest(F.count("*") / j.block_rows, F.sum("n") / j.block_shingles)).cast("int")
    sizes = members.groupBy("grp").agg(blocks.alias("blocks"), F.min("seen").alias("one"), F.max("seen").alias("other"))
    sizes = sizes.where("one != other").drop("one", "other")  # else every pair has been seen
    members = stored(members.join(sizes, "grp"), "members")
    total = members.agg(F.count("*"), F.sum("n")).first()
    bundles = int(max(1, total[0] // j.block_rows, (total[1] or 0) // j.block_shingles))
    small = members.where("blocks = 1").select(F.pmod(F.xxhash64("grp"), F.lit(bundles)).cast("string").alias("bundle"), F.col("grp").cast("string").alias("cell"), F.lit(0).alias("block"), F.lit(False).alias("across"), "seen", "rep", "copies")
    large = members.where("blocks > 1")
    if not large.isEmpty():
        placed, pairs = blocks_of(large, reps, last_depth, j)
        pairs = stored(pairs.withColumn("cell", F.concat_ws("/", "grp", "low", "high")), "cells")
        ends = pairs.select("grp", F.col("low").alias("block"), "cell", (F.col("low") != F.col("high")).alias("across"))
        ends = ends.union(pairs.where("low != high").select("grp", F.col("high").alias("block"), "cell", F.lit(True).alias("across")))
        placed = placed.join(ends, ["grp", "block"]).select(F.col("cell").alias("bundle"), "cell", "block", "across", "seen", "rep", "copies")
        small = small.unionByName(placed)
    return stored(verified(small.join(sets.hint("merge"), "rep"), j), "links")


def shingle_sets(docs: DataFrame, reps: DataFrame, wanted: DataFrame, j: Join, text: str) -> DataFrame:
    """rep and members, the stored shingle set, of the reps in wanted; each is read from the one document that stands for it."""
    carriers = stored(reps.join(wanted, "rep", "left_semi").select("rep", F.col("doc_id").alias("_id"), "text_hash"), "carriers")
    # A bitmap of the wanted hashes, SLOTS bits at most, keeps other texts from being shuffled; where there are so many
    # that it is full, all texts are, and the result is the same.
    slot = lambda c: F.pmod(F.col(c), F.lit(SLOTS))
    marks = carriers.groupBy(F.bitmap_bucket_number(slot("text_hash")).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot("text_hash"))).alias("bits"))
    rows = docs.select("doc_id", F.col(text).alias("text"), F.xxhash64(text).alias("_hash")).withColumn("_bit", F.bitmap_bit_position(slot("_hash")))
    rows = rows.join(F.broadcast(marks), F.bitmap_bucket_number(slot("_hash")) == F.col("bucket"))
    byte = F.conv(F.hex(F.expr("substring(bits, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    rows = rows.where(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1)
    # Always by a shuffle of what is left, so that plans are alike at every size.
    rows = rows.join(carriers.hint("merge"), (F.col("_hash") == F.col("text_hash")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("rep", "text")

    def run(batches):
        for batch, texts in text_batches(batches, "text"):
            values, n = shingles(Tokens(texts), j.words)
            end = np.cumsum(n)
            held = pa.array([values[i:k].tobytes() for i, k in zip((end - n).tolist(), end.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), held], names=["rep", "members"])

    # A repeated row brings its set again; one is kept.
    return stored(rows.mapInArrow(run, "rep long, members binary").dropDuplicates(["rep"]), "shingle-sets")


def similar_texts(docs: DataFrame, text: str = "text", j: Join = Join(), class_key: bool = False) -> DataFrame:
    """doc_id, class_id and n_links of each document of docs (doc_id, an integer, and a text column).

    Two documents are linked if the Jaccard similarity of their sets of shingles of j.words words is j.threshold or more.
    n_links is the number of other documents that a document is linked with; class_id is the smallest doc_id that a
    chain of links leads to. Words are what lies between ASCII white space; a text of fewer than j.words words is one
    shingle. Texts without words (null and empty ones too) are linked with nothing and are classes of their own.
    Rows with equal doc_id and text are one document; rows with one doc_id but different texts get a row each.
    A null doc_id is linked like any other, but names no class: a class of such rows only has a null class_id.
    With class_key, a column of that name has a number of the class that depends on its texts alone, null for texts without words.
    An empty table gives no rows; further columns are not used.
    """
    signs = stored(signed(docs.select("doc_id", text), j, text), "signatures")
    signs = signs.withColumn("doc_id", F.col("doc_id").cast("long"))
    named = stored(signs.select("doc_id", "set_a", "set_b", "n").distinct(), "sets")
    one = ["set_a", "set_b"]
    copies = named.where("n > 0").groupBy(*one).agg(F.count("*").alias("copies"))
    carrier = F.min(F.struct("doc_id", "text_hash")).alias("c")
    reps = signs.where("n > 0").groupBy(*one).agg(carrier, F.first("n").alias("n")).join(copies, one)
    reps = reps.select(*one, "n", "copies", "c.doc_id", "c.text_hash")
    # One document stands for each set; of its repeated rows, one brings the signature.
    sigs = signs.where("n > 0").select(*one, F.col("doc_id").alias("_id"), "sig")
    with_sig = reps.join(sigs, (reps.set_a == sigs.set_a) & (reps.set_b == sigs.set_b) & reps.doc_id.eqNullSafe(sigs._id)).drop(sigs.set_a).drop(sigs.set_b).drop("_id")
    reps = stored(with_sig.dropDuplicates(one).withColumn("rep", F.monotonically_increasing_id()), "reps")
    steps = depths(j)
    edges = tries(reps, steps[-1], j)
    sets = shingle_sets(docs, reps, edges.select(F.col("a").alias("rep")).union(edges.select("b")).distinct(), j, text)
    links, groups = [], None
    for depth in steps:
        new = edges.where(F.col("depth") == depth).select("a", "b")
        over = components(new if groups is None else across(new, groups), f"depth-{depth}")
        if over is not None:  # else no group has grown
            before, groups = groups, over if groups is None else united(groups, over)
            links.append(round_of(groups, before, reps, sets, steps[-1], j))
    found = reduce(DataFrame.unionByName, links) if links else docs.sparkSession.createDataFrame([], "rep long, links long, root long")
    classes = components(found.where("rep != root").select(F.col("rep").alias("a"), F.col("root").alias("b")), "classes")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    per_set = reps.select(*one, "rep", "copies").join(counts, "rep", "left")
    per_set = per_set.withColumn("root", F.col("rep")) if classes is None else per_set.join(classes.withColumnRenamed("v", "rep"), "rep", "left")
    per_set = per_set.select(*one, F.coalesce("root", "rep").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    per_set = stored(per_set, "per-set")
    ids = named.where("n > 0").groupBy(*one).agg(F.min("doc_id").alias("least"))
    smallest = ids.join(per_set, one).groupBy("root").agg(F.min("least").alias("class_id"), F.min("set_a").alias("class_key"))
    per_set = per_set.join(smallest, "root").select(*one, "class_id", "class_key", "n_links", F.lit(True).alias("wordy"))
    out = named.withColumn("wordy", F.col("n") > 0).join(per_set, ["wordy", *one], "left")
    own = ["class_key"] if class_key else []
    return out.select("doc_id", F.when(F.col("wordy"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), *own)
