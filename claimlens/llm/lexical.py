"""Operator 11: exact ranked lexical search with geometrically blocked posting lists.

The forward index is a table: a row per document with its length and its counts of the terms that items ask for. It is read in
shards of bounded size. Within a shard each term's posting list is cut into blocks of documents that are alike (nearest of some
centres by the cosine of small random projections), and each block stores a summary: for every term that is asked together with
the list's own, the largest impact in the block, rounded up. An item's terms weighed by a summary bound the score of each document in the
block, so the blocks of all its lists are visited by descending bound until the bound falls under the 50th best score so far. Only
these bounds decide; there is no cap on lists, blocks or documents, and the result equals that of scoring every document.

A sixteenth of the documents, by hash, is searched first; the 50th best score there is a lower bound for all others, which are
searched next. Every document is searched once. A shard returns at most 50 rows an item.

Items go by blocks of bounded size (Settings.item_terms), each with its own pass. Numbers of documents, of terms and document
frequencies are taken over all documents.

Defined results: a null text has no terms, and an item without terms no results; repeated documents are ranked each; a document without
doc_id ranks behind others of its score; equal rows of items are one; of one item_id with several texts each text is ranked. Empty
tables give no rows. Further columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, text_batches
from .terms import LETTERS_AND_DIGITS, byte_map, terms


@dataclass(frozen=True)
class Settings:
    top: int = 50
    #: Documents in a block, on average.
    block: int = 64
    #: Dimensions of the projections by which documents are found alike.
    dims: int = 16
    #: Documents times terms of a shard.
    cells: int = 12_000_000
    #: One in so many documents is searched first.
    pilot: int = 16
    #: Terms of the items that are searched together, about.
    item_terms: int = 16_000


@dataclass
class Items:
    """Some items: ids, the distinct terms of all, and for each item the places of its own."""

    ids: list
    vocabulary: list[str]
    asked: list[np.ndarray]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @classmethod
    def of(cls, rows: list) -> Items:
        place: dict[str, int] = {}
        asked = [np.array(sorted({place.setdefault(t, len(place)) for t in r.terms}), np.int64) for r in rows]
        return cls([r.item_id for r in rows], list(place), asked)


def item_blocks(items: DataFrame, s: Settings) -> Iterator[Items]:
    """The distinct items, in blocks by hash of about s.item_terms terms each."""

    def run(batches):
        mapped = byte_map(LETTERS_AND_DIGITS)
        for batch, texts in text_batches(batches, "text"):
            found = terms(texts, mapped)
            ends = np.concatenate(([0], found.ends()))
            words = [sorted(set(found.words.take(pa.array(found.index[a:b])).to_pylist())) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(words, pa.list_(pa.string())), batch.column("part")], names=["item_id", "terms", "part"])

    hashed = items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().withColumn("part", F.xxhash64("item_id", "text"))
    held = stored(hashed.mapInArrow(run, "item_id long, terms array<string>, part long").where(F.size("terms") > 0), "items")
    parts = -(-(held.agg(F.sum(F.size("terms"))).first()[0] or 0) // s.item_terms)
    for i in range(parts):
        rows = held.where(F.pmod("part", F.lit(parts)) == i).drop("part").collect()  # about item_terms terms
        if rows:
            yield Items.of(rows)


FORWARD = "doc_id long, n long, terms array<int>, tfs array<int>"


def forward(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """A row per document: n, its terms with repeats, and places and counts of the terms in the vocabulary."""

    def run(batches):
        mapped, asked = byte_map(LETTERS_AND_DIGITS), pa.array(vocabulary, pa.string())
        for batch, texts in text_batches(batches, "text"):
            found = terms(texts, mapped)
            place = pc.fill_null(pc.index_in(found.words, value_set=asked), -1).to_numpy(zero_copy_only=False).astype(np.int64)[found.index]
            on = place >= 0
            pairs, tf = np.unique(found.texts()[on] * len(vocabulary) + place[on], return_counts=True)
            of, term = np.divmod(pairs, len(vocabulary))
            offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(texts))))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (term, tf)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.sizes), *lists], names=["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FORWARD)


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


class Plan:
    """What all shards share: for each term the coordinates of its list's summaries, and where an item's terms are among them."""

    def __init__(self, items: Items, s: Settings):
        self.s, self.items = s, items
        width = len(items.vocabulary)
        together: list[set] = [set() for _ in range(width)]
        for asked in items.asked:
            for t in asked.tolist():
                together[t].update(asked.tolist())
        self.coordinates = [np.array(sorted(c), np.int64) for c in together]
        self.places = [[np.searchsorted(self.coordinates[t], asked) for t in asked.tolist()] for asked in items.asked]
        signs = np.random.default_rng(7).integers(0, 2, (width, s.dims)) * 2 - 1
        self.projection = (signs * items.weights[:, None]).astype(np.float32)


#: Impacts are at most 10^6; summaries hold them in steps of 16, rounded up, so that a bound stays one.
STEP = 16


class Shard:
    """Some documents, with the blocks of their posting lists and the blocks' summaries."""

    def __init__(self, plan: Plan, ids: np.ndarray, missing: np.ndarray, n: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray, n_docs: int, n_terms: int):
        self.plan, self.ids, self.missing = plan, ids, missing
        m = 50 + (50 * n * n_docs) // n_terms
        of = np.repeat(np.arange(len(n)), sizes)
        impact = (10**9 * tf) // (1000 * tf + 20 * m[of])
        self.impacts = np.zeros((len(n), len(plan.coordinates)), np.int32)
        self.impacts[of, term] = impact
        steps = -(-self.impacts // STEP)
        steps = steps.astype(np.uint16)
        alike = self.impacts.astype(np.float32) @ plan.projection
        alike /= np.maximum(np.linalg.norm(alike, axis=1, keepdims=True), 1e-9)
        order = np.argsort(term, kind="stable")
        cuts = np.searchsorted(term[order], np.arange(len(plan.coordinates) + 1))
        self.members: list[list[np.ndarray]] = []
        self.summaries: list[np.ndarray | None] = []
        for t, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            docs = of[order[a:b]]
            blocks = clustered(docs, alike, plan.s.block) if len(docs) else []
            self.members.append(blocks)
            here = plan.coordinates[t]
            self.summaries.append(np.stack([steps[np.ix_(x, here)].max(axis=0) for x in blocks]) if blocks else None)

    def best(self, item: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents and scores of at least floor and above 0, the best ones, and how many documents were scored."""
        asked, top = self.plan.items.asked[item], self.plan.s.top
        w = self.plan.items.weights[asked]
        bounds, blocks = [], []
        for t, places in zip(asked.tolist(), self.plan.places[item], strict=True):
            if self.members[t]:
                bounds.append((self.summaries[t][:, places] * w).sum(axis=1) * STEP)
                blocks += self.members[t]
        if not blocks:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        bound = np.concatenate(bounds)
        order = np.argsort(-bound, kind="stable")
        new = np.ones(len(self.ids), bool)
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, width, least, scored = 0, 4, max(1, floor), 0
        while at < len(order) and bound[order[at]] >= least:
            group = order[at : at + width]
            found = np.unique(np.concatenate([blocks[i] for i in group[bound[group] >= least]]))
            found = found[new[found]]
            new[found] = False
            scored += len(found)
            values = (self.impacts[np.ix_(found, asked)] * w).sum(axis=1)
            docs, scores = np.concatenate((docs, found[values >= least])), np.concatenate((scores, values[values >= least]))
            kept = np.lexsort((self.ids[docs], self.missing[docs], -scores))[:top]
            docs, scores = docs[kept], scores[kept]
            if len(docs) == top:
                least = max(least, int(scores[-1]))
            at, width = at + width, 2 * width
        return docs, scores, scored


def clustered(docs: np.ndarray, alike: np.ndarray, size: int) -> list[np.ndarray]:
    """docs in blocks of about size, each of those that are nearest to one of them."""
    if len(docs) <= size:
        return [docs]
    centres = docs[np.linspace(0, len(docs) - 1, -(-len(docs) // size)).astype(np.int64)]
    nearest = np.argmax(alike[docs] @ alike[centres].T, axis=1)
    order = np.argsort(nearest, kind="stable")
    return np.split(docs[order], np.flatnonzero(np.diff(nearest[order])) + 1)


def shards(batches: Iterator[pa.RecordBatch], plan: Plan, n_docs: int, n_terms: int) -> Iterator[Shard]:
    limit = max(64, plan.s.cells // max(1, len(plan.coordinates)))
    held: list[pa.RecordBatch] = []

    def made() -> Shard:
        rows = pa.Table.from_batches(held).combine_chunks()
        flat = lambda c: rows.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        plain = lambda c: c.to_numpy().astype(np.int64)
        ids = rows.column("doc_id")
        return Shard(
            plan, plain(pc.fill_null(ids, 0)), ids.is_null().to_numpy(), plain(rows.column("n")), plain(pc.list_value_length(rows.column("terms"))), flat("terms"), flat("tfs"), n_docs, n_terms
        )

    size = 0
    for batch in batches:
        while len(batch):
            part = batch.slice(0, limit - size)
            held.append(part)
            size += len(part)
            batch = batch.slice(len(part))
            if size == limit:
                yield made()
                held, size = [], 0
    if held:
        yield made()


FOUND = "item int, item_id long, doc_id long, score long"


def searcher(items: Items, n_docs: int, n_terms: int, floors: dict[int, int], s: Settings) -> Callable:
    """The task that finds the best documents of its shards for all items. floors: scores under which a document is of no use."""

    def run(batches):
        plan = Plan(items, s)
        for shard in shards(batches, plan, n_docs, n_terms):
            out = []
            for i in range(len(items.ids)):
                docs, scores, _ = shard.best(i, floors.get(i, 0))
                out.append((np.full(len(docs), i), docs, scores))
            item, docs, scores = map(np.concatenate, zip(*out, strict=True))
            ids = pa.array(shard.ids[docs], pa.int64(), mask=shard.missing[docs])
            owners = pa.array([items.ids[i] for i in item.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), owners, ids, pa.array(scores)], names=["item", "item_id", "doc_id", "score"])

    return run


def search_block(docs: DataFrame, items: Items, s: Settings) -> DataFrame | None:
    index = stored(forward(docs, items.vocabulary), "forward-index")
    n_docs, n_terms = index.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    if not n_docs:
        return None
    df = np.zeros(len(items.vocabulary), np.int64)
    for t, n in index.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most the block's vocabulary
        df[t] = n
    items.weights = weights(n_docs, df)

    best = lambda rows: rows.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))))
    first = F.pmod(F.xxhash64("doc_id", "n"), F.lit(s.pilot)) == 0
    pilot = stored(index.where(first).mapInArrow(searcher(items, n_docs, n_terms, {}, s), FOUND), "pilot")
    floors = {r.item: r.score for r in best(pilot).where(F.col("rank") <= s.top).where(F.col("rank") == s.top).select("item", "score").collect()}
    rest = index.where(~first).mapInArrow(searcher(items, n_docs, n_terms, floors, s), FOUND)
    return best(pilot.union(rest)).where(F.col("rank") <= s.top).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, s: Settings = Settings()) -> DataFrame:
    """item_id, rank, doc_id and score of each item's best documents. docs: doc_id, text; items: item_id, text."""
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in item_blocks(items, s):
        found = search_block(docs, block, s)
        if found is not None:
            out = out.union(found)
    return out
