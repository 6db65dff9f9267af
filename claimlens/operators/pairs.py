"""Pair joins of files: near duplicates by hash and by embedding, within small groups and over all rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from claimlens.functions.columns import cosine, hamming
from claimlens.sources.scratch import stored

#: Pairs of hashes that a task compares at once.
BLOCK = 1 << 20
#: Rows of a bucket that is compared block by block; those of shorter ones are compared at equal distances, all buckets at once.
LONG = 1000
#: Of a cell of pairs: characters of each side's texts, and pairs, on average.
CELL_CHARS, CELL_PAIRS = 16_000_000, 20_000


def pairs_within(df: DataFrame, group: str, order: str, columns: list[str]) -> DataFrame:
    """All pairs i < j of the rows of each group, as left and right columns. Groups are the files of one case: a handful."""
    left = df.select(group, *(F.col(c).alias(f"{c}_i") for c in [order, *columns]))
    right = df.select(group, *(F.col(c).alias(f"{c}_j") for c in [order, *columns]))
    return left.join(right, group).where(F.col(f"{order}_i") < F.col(f"{order}_j"))


def hash_pairs(df: DataFrame, group: str, order: str, h: str, most: int = 8, close: int = 3) -> DataFrame:
    """Pairs of a group whose hashes differ in `most` bits or fewer, and their risk."""
    p = pairs_within(df, group, order, [h]).withColumn("distance", hamming(F.col(f"{h}_i"), F.col(f"{h}_j"))).where(F.col("distance") <= most)
    return p.select(group, f"{order}_i", f"{order}_j", "distance", F.when(F.col("distance") <= close, 0.85).otherwise(0.75).alias("risk"))


def cosine_pairs(df: DataFrame, group: str, order: str, vector: str, least: float = 0.93, least_dims: int = 384) -> DataFrame:
    """Pairs of a group whose vectors are alike; vectors of fewer numbers than least_dims, or of different lengths, aren't compared."""
    p = pairs_within(df.where(F.size(vector) >= least_dims), group, order, [vector]).where(F.size(f"{vector}_i") == F.size(f"{vector}_j"))
    p = p.withColumn("similarity", cosine(F.col(f"{vector}_i"), F.col(f"{vector}_j")))
    return p.where(F.col("similarity") >= least).select(group, f"{order}_i", f"{order}_j", "similarity")


def bands(h: Column, most: int, agree: int = 3) -> Column:
    """Keys of a 64-bit value, so that values that differ in `most` bits or fewer share one at least.

    The bits are cut into most + agree blocks, of which `agree` are untouched by so few differences: a key is the choice of as
    many blocks and their bits. With 8 differences these are 165 keys of 17 bits or more.
    """
    n = most + agree
    cuts = [64 * k // n for k in range(n + 1)]
    part = lambda k: F.shiftrightunsigned(h, cuts[k]).bitwiseAND(F.lit((1 << (cuts[k + 1] - cuts[k])) - 1))
    keys = []
    for chosen in combinations(range(n), agree):
        v = F.lit(0).cast("long")
        for k in chosen:
            v = F.shiftleft(v, cuts[k + 1] - cuts[k]).bitwiseOR(part(k))
        keys.append(v)
    return F.array(*keys)


def _near(h: np.ndarray, run: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of h that differ in `most` bits or fewer and are of one run, in bounded blocks; a run's rows lie side by side."""
    starts = np.flatnonzero(np.diff(run, prepend=run[:1] - 1))
    sizes = np.diff(np.append(starts, len(run)))
    left = np.repeat(starts + sizes, sizes) - np.arange(len(run)) - 1  # rows of the run behind each one
    left[np.repeat(sizes > LONG, sizes)] = 0
    i, k = np.flatnonzero(left), 1
    while len(i):
        at = i[np.bitwise_count(h[i] ^ h[i + k]) <= most]
        yield at, at + k
        i, k = i[left[i] > k], k + 1
    for first, n in zip(starts[sizes > LONG].tolist(), sizes[sizes > LONG].tolist()):
        own, step = h[first : first + n], max(1, BLOCK // n)
        for a in range(0, n, step):
            i, j = np.nonzero(np.bitwise_count(own[a : a + step, None] ^ own[None, a:]) <= most)
            later = i < j
            yield first + a + i[later], first + a + j[later]


def banded_hash_pairs(df: DataFrame, key: str, h: str, most: int = 8, by: list[str] = []) -> DataFrame:
    """Pairs i < j of distinct hashes of all rows, or of the rows of equal by, that differ in `most` bits or fewer.

    Equal hashes are one row from the start, so copies don't multiply. Rows are dealt to buckets of equal bands, sorted, and
    the rows of a bucket are compared with each other in numpy, so that no candidate becomes a row; each pair comes from the
    first band it shares. A bucket holds about a two-thousandth of the rows; of a long one the pairs are compared in blocks.
    """
    agree = 2
    distinct = df.groupBy(*by, h).agg(F.min(key).alias("key"))
    rows = distinct.select(*by, "key", F.col(h).alias("h"), F.posexplode(bands(F.col(h), most, agree)).alias("pos", "band"))
    rows = rows.select(*by, "key", "h", "pos", F.xxhash64(*by, "pos", "band").alias("bucket"))
    cuts = [64 * k // (most + agree) for k in range(most + agree + 1)]
    blocks = np.array([(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])], np.uint64)
    # Of the choice of a pair's blocks: those that are chosen, and those that would be chosen before if they were equal.
    chosen = np.array(list(combinations(range(len(blocks)), agree)))
    earlier = (np.arange(len(blocks)) < chosen[:, -1:]) & (np.arange(len(blocks)) != chosen[:, :1])
    kind = rows.select(*by, F.col("key").alias("key_i"), F.col("key").alias("key_j")).schema.add("distance", "integer")
    names = kind.names

    def found(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bits, pos = rows.column("h").to_numpy().view(np.uint64), rows.column("pos").to_numpy()
        kept, n = [], 0
        for i, j in _near(bits, rows.column("bucket").to_numpy(), most):
            kept.append((i, j))
            n += len(i)
            if n > 100_000:
                yield verified(rows, bits, pos, *(np.concatenate(x) for x in zip(*kept)))
                kept, n = [], 0
        if n:
            yield verified(rows, bits, pos, *(np.concatenate(x) for x in zip(*kept)))

    def verified(rows: pa.RecordBatch, bits: np.ndarray, pos: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        x, p = bits[i] ^ bits[j], pos[i]
        differ = (x[:, None] & blocks) != 0
        good = (p == pos[j]) & ~np.take_along_axis(differ, chosen[p], 1).any(axis=1) & (differ | ~earlier[p]).all(axis=1)
        left, right, x = rows.take(pa.array(i[good])), rows.take(pa.array(j[good])), x[good]
        same = np.ones(len(x), bool)
        for g in by:  # buckets are told apart by a hash
            a, b = left.column(g), right.column(g)
            same &= pc.if_else(pc.or_(a.is_null(), b.is_null()), pc.and_(a.is_null(), b.is_null()), pc.fill_null(pc.equal(a, b), False)).to_numpy(zero_copy_only=False)
        a, b = left.column("key"), right.column("key")
        first = pc.less(a, b)
        columns = [*(left.column(g) for g in by), pc.if_else(first, a, b), pc.if_else(first, b, a), pa.array(np.bitwise_count(x).astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(same))

    def run(batches):
        held = None  # the bucket that the next batch may go on with
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0] if batch.num_rows else held
            bucket = batch.column("bucket").to_numpy()
            last = int(np.argmax(bucket == bucket[-1])) if len(bucket) else 0
            yield from found(batch.slice(0, last))
            held = batch.slice(last)
        if held is not None:
            yield from found(held)

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, kind)


def compare_in_cells(near: DataFrame, texts: DataFrame, compare: Callable[[dict, Iterable[tuple]], Iterator[tuple]], added: str) -> DataFrame:
    """near (key_i, key_j and more) and what compare finds of the texts of its pairs, in the columns added; texts has a row of key and t for each key.

    Keys are dealt to groups, and the pairs of two groups are a cell. A text is moved once to each cell that has a pair of it, not once a pair, so that
    what is moved grows with the pairs only up to the number of groups a text. Cells hold a bounded number of characters and pairs on average, and
    compare gets a cell's texts by key and its pairs in the order of their keys.
    """
    spark = near.sparkSession
    sizes = near.select(F.count("*")).first()[0], texts.select(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    groups = max(16, math.ceil(math.sqrt(2 * sizes[0] / CELL_PAIRS)), math.ceil(sizes[1] / CELL_CHARS))
    group = lambda key: F.pmod(F.xxhash64(key), F.lit(groups))
    dealt = near.withColumn("cell", F.least(group("key_i"), group("key_j")) * groups + F.greatest(group("key_i"), group("key_j")))
    asked = dealt.select("cell", F.col("key_i").alias("key")).union(dealt.select("cell", F.col("key_j").alias("key"))).distinct()
    rows = asked.join(texts, "key").select("cell", F.col("key").alias("key_i"), F.col("t").cast("binary").alias("t"))
    more = [c for c in near.columns if c not in ("key_i", "key_j")]
    kind = T.StructType([*near.select("key_i", "key_j", *more).schema.fields, *T.StructType.fromDDL(added).fields])
    schema = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, pairs = None, {}, []

        def found() -> Iterator[pa.RecordBatch]:
            out = compare(held, pairs)
            while some := list(islice(out, 20_000)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema, strict=True)], schema=schema)

        for batch in batches:
            cells = batch.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if cells[a] != cell:
                    yield from found()
                    cell, held, pairs = cells[a], {}, []
                part = batch.slice(a, b - a)
                is_text = pc.is_valid(part.column("t"))
                own = part.filter(is_text)
                for key, t in zip(own.column("key_i").to_pylist(), own.column("t").to_pylist()):
                    held.setdefault(key, []).append(t)
                own = part.filter(pc.invert(is_text))
                pairs.extend(zip(*(own.column(c).to_pylist() for c in ("key_i", "key_j", *more))))
        yield from found()

    # Few bytes are much work here: a number keeps the cells dealt out, where partitions by size would be one or two.
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, groups * groups // 8)
    both = dealt.unionByName(rows, allowMissingColumns=True).repartition(n, "cell").sortWithinPartitions("cell", F.col("t").isNull(), "key_j", "key_i")
    return both.mapInArrow(run, kind)


def salted_join(rows: DataFrame, few: DataFrame, on: str, spread: str, salts: int = 32) -> DataFrame:
    """rows joined with few, which has a row per value of on. Rows of one value are dealt to salts by their spread, and few is copied to each."""
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [on, "_salt"]).drop("_salt")


def duplicate_classes(df: DataFrame, key: str, h: str) -> DataFrame:
    """key, class_id (the smallest key of an equal hash) and n_others of each row whose hash occurs again.

    A group of copies is one row of counts and never becomes pairs; its rows are dealt to salts. Null hashes are equal to nothing.
    """
    again = df.where(F.col(h).isNotNull()).groupBy(h).agg(F.min(key).alias("class_id"), (F.count("*") - 1).alias("n_others")).where("n_others > 0")
    return salted_join(df.select(key, h), again, h, key).select(key, "class_id", "n_others")


def greedy_firsts(df: DataFrame, group: str, order: str, h: str, least: int = 10) -> DataFrame:
    """What greedy_dedup keeps, for groups of any size: group and order of the rows that stay. Orders are unique within a group.

    The rows that stay are the lexicographically first independent set of the graph of near hashes, which rounds find in parallel: a row
    without an earlier neighbour stays, its neighbours go, and both leave the graph. A round takes two joins; as many rounds are
    needed as the longest chain of rows that decide each other in turn. Of equal hashes only the first can stay, so copies
    are one row from the start. The graph holds the near pairs of distinct hashes: a dense ball of m different hashes has m^2 / 2.
    """
    known = df.where(F.col(h).isNotNull())
    edges = stored(banded_hash_pairs(known, order, h, least - 1, [group]).select(group, "key_i", "key_j"), "near-pairs")
    gone = None
    while not edges.isEmpty():
        later = edges.select(group, F.col("key_j").alias("key_i")).distinct()
        stay = edges.select(group, "key_i").distinct().join(later, [group, "key_i"], "left_anti")
        out = stored(edges.join(stay, [group, "key_i"], "left_semi").select(group, "key_j").distinct(), "decided")
        gone = out if gone is None else gone.union(out)
        edges = stored(edges.join(out, [group, "key_j"], "left_anti").join(out.withColumnRenamed("key_j", "key_i"), [group, "key_i"], "left_anti"), "near-pairs")
    firsts = known.groupBy(group, h).agg(F.min(order).alias(order)).select(group, order)
    if gone is not None:
        firsts = firsts.join(gone.withColumnRenamed("key_j", order), [group, order], "left_anti")
    return firsts.union(df.where(F.col(h).isNull()).select(group, order))


def greedy_dedup(df: DataFrame, group: str, order: str, h: str, least: int = 10) -> DataFrame:
    """The rows that stay if each row goes that differs in fewer than `least` bits from one of its group kept before it.

    What stays depends on the order, so each group is worked through in one Arrow task; groups are categories of images.
    """
    def keep(table: pa.Table) -> pa.Table:
        table = table.sort_by([(order, "ascending")])
        kept: list[int] = []
        on = []
        for x in table.column(h).to_pylist():
            bits = None if x is None else x & 0xFFFFFFFFFFFFFFFF
            on.append(bits is None or all((bits ^ k).bit_count() >= least for k in kept))
            if on[-1] and bits is not None:
                kept.append(bits)
        return table.filter(pa.array(on))

    rows = df.select(group, order, h)
    return rows.groupBy(group).applyInArrow(keep, rows.schema)
