"""Conflict-constrained best-fit packing of documents into bins of a fixed number of tokens.

Documents are dealt at random to shards of a bounded number of rows, and each shard is packed by itself, longest
document first. A shard's open bins are ordered by what room they have left. For a document, the search starts at the
smallest room that is enough and goes on to the next larger ones until a bin has no conflict: a bin carries
a bitmap of the sources and one of the duplicate clusters in it, and a document doesn't go where its cluster already is, or where
its source has as many documents as it may. With no such bin, a new one is opened. Every source is limited, by its share: one that an even
spread would put into each bin at most once is exclusive, and one with more documents than bins may have that many more of them in a bin.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from dataclasses import dataclass
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ngram_join
from .common import free_name, stored


@dataclass(frozen=True)
class Packing:
    """capacity: tokens of a bin. shard_rows: pieces in a shard, on average.

    slack: a bin has at most ceil(slack x n / bins) documents of a source with n pieces in the shard, where bins is what the shard's
    tokens fill; so 1 of a source with few. An even spread needs n / bins; twice that keeps bins fuller (README).
    """

    capacity: int = 2048
    shard_rows: int = 4000
    slack: float = 2.0


def source_limits(sizes: list[int], sources: list, capacity: int, slack: float) -> dict:
    """How many documents of each source a bin may have."""
    bins = max(1.0, sum(sizes) / capacity)
    return {s: max(1, ceil(slack * n / bins)) for s, n in Counter(s for s in sources if s is not None).items()}


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int, slack: float = 2.0) -> tuple[list[int], list[int], list[int]]:
    """The bin of each item, and each bin's source and cluster bitmaps.

    A cluster has a bit, in the order of first use, and a source as many bits as a bin may have documents of it; the lowest free one is
    taken. Items are taken by falling size, ties by their order. Null sources and null clusters conflict with nothing.
    Every size is at most the capacity. Of bins with equal room, the one opened first is tried first.
    """
    again = {c for c, k in Counter(c for c in clusters if c is not None).items() if k > 1}
    bits: dict = {}
    masks, width = {}, 0
    for s, k in source_limits(sizes, sources, capacity, slack).items():
        masks[s] = ((1 << k) - 1) << width
        width += k
    placed = [0] * len(sizes)
    rooms: list[tuple[int, int]] = []  # (room, bin), ascending
    bin_sources: list[int] = []
    bin_clusters: list[int] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        c = clusters[i]
        cluster_bit = 1 << bits.setdefault(c, len(bits)) if c in again else 0
        mask = masks.get(sources[i], 0)
        at = bisect_left(rooms, (sizes[i], -1))
        while at < len(rooms):
            b = rooms[at][1]
            if not (bin_clusters[b] & cluster_bit or (mask and bin_sources[b] & mask == mask)):
                break
            at += 1
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = capacity, len(bin_sources)
            bin_sources.append(0)
            bin_clusters.append(0)
        free = mask & ~bin_sources[b]
        bin_sources[b] |= free & -free
        bin_clusters[b] |= cluster_bit
        placed[i] = b
        if room > sizes[i]:
            insort(rooms, (room - sizes[i], b))
    return placed, bin_sources, bin_clusters


def packed(docs: DataFrame, n_tokens: str = "n_tokens", cluster: str = "cluster", p: Packing = Packing(), keep: tuple[str, ...] = ()) -> DataFrame:
    """The pieces of docs (doc_id, source, n_tokens, cluster) and their bins.

    Returns doc_id, the columns of keep, piece (0, 1, ...), n_pieces, piece_tokens, bin_id, bin_tokens (in the whole bin),
    bin_items and bin_sources (how many of the shard's sources the bin has).

    A document of more tokens than the capacity is cut into full pieces, which fill a bin each, and a rest. A document
    of no tokens, or of a null number, takes no room and is a piece of 0 tokens. Rows are kept as they are: a repeated row
    is a document of its own, and conflicts with its twin if they have a cluster. An empty table gives no rows. Columns of
    docs of other names are not used.

    Shards are dealt by a hash of the row's values and its number among equal rows, so a hot source or cluster is spread over all
    of them, a source's share in a shard is about that in the table, and bins don't depend on the order or the partitions of docs.
    """
    tokens = F.coalesce(F.col(n_tokens), F.lit(0)).cast("long")
    own = ["doc_id", *keep]
    rows = docs.select(*own, F.col("source").cast("string").alias("_source"), tokens.alias("_tokens"), F.col(cluster).cast("string").alias("_cluster"))
    rows = rows.groupBy(*rows.columns).agg(F.count("*").cast("int").alias("_times")).withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    n = F.greatest(F.ceil(F.col("_tokens") / p.capacity), F.lit(1)).cast("int")
    rows = rows.withColumn("n_pieces", n).withColumn("piece", F.explode(F.sequence(F.lit(0), n - 1)))
    size = F.least(F.lit(p.capacity), F.col("_tokens") - F.col("piece") * p.capacity)
    rows = rows.withColumn("piece_tokens", size.cast("int")).withColumn("_order", F.xxhash64(*own, "_source", "_cluster", "piece", "_again"))
    rows = stored(rows.drop("_times", "_tokens"), "pieces")
    # A full piece is a bin by itself; only the others are packed.
    shards = max(1, round(rows.where(F.col("piece_tokens") < p.capacity).count() / p.shard_rows))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("_order"), F.lit(shards)).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_order", "ascending")])
        sizes = table.column("piece_tokens").to_pylist()
        sources = table.column("_source").to_pylist()
        placed, bins, _ = best_fit(sizes, sources, table.column("_cluster").to_pylist(), p.capacity, p.slack)
        total, items, held = [0] * len(bins), [0] * len(bins), [set() for _ in bins]
        for size, source, b in zip(sizes, sources, placed):
            total[b] += size
            items[b] += 1
            held[b].add(source)
        shard = table.column("shard").to_pylist()
        out = table.select([*own, "piece", "n_pieces", "piece_tokens"])
        more = {
            "bin_id": ([f"{s}-{b}" for s, b in zip(shard, placed)], pa.string()),
            "bin_tokens": ([total[b] for b in placed], pa.int32()),
            "bin_items": ([items[b] for b in placed], pa.int32()),
            "bin_sources": ([len(held[b] - {None}) for b in placed], pa.int32()),
        }
        for name, (values, kind) in more.items():
            out = out.append_column(name, pa.array(values, kind))
        return out

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*own).schema)
    schema = f"{kinds}, piece int, n_pieces int, piece_tokens int, bin_id string, bin_tokens int, bin_items int, bin_sources int"
    part = rows.where(F.col("piece_tokens") < p.capacity).groupBy("shard").applyInArrow(pack, schema)
    full = rows.where(F.col("piece_tokens") == p.capacity).select(
        *own,
        "piece",
        "n_pieces",
        "piece_tokens",
        F.concat(F.lit("full-"), F.hex("_order")).alias("bin_id"),
        F.col("piece_tokens").alias("bin_tokens"),
        F.lit(1).alias("bin_items"),
        F.col("_source").isNotNull().cast("int").alias("bin_sources"),
    )
    return part.unionByName(full)


def words_and_cluster(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_tokens, the words of each whole text, and cluster, a digest of the text: exact copies are a cluster. Null texts have none."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({"n_tokens": F.regexp_count(t, F.lit("[^ \\t\\n\\x0B\\f\\r]+")), "cluster": F.md5(F.col(text))})


def words_and_class(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_tokens and cluster as by words_and_cluster, but near copies (ngram_join's classes) are a cluster as well.

    Rows are told apart by a key of their own, so that null and repeated doc_ids do no harm; clusters are named by their texts.
    """
    row = free_name(docs.columns, "_row")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "packing-rows")
    classes = ngram_join.similar_texts(rows.select(F.col(row).alias("doc_id"), text), text, class_key=True)
    linked = classes.where("n_links > 0").select(F.col("doc_id").alias(row), F.col("class_key").cast("string").alias("_class"))
    out = words_and_cluster(rows.select(*docs.columns, row), text).join(linked, row, "left")
    return out.withColumn("cluster", F.coalesce("_class", "cluster")).drop(row, "_class")
