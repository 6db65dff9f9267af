"""Operator 12: how far the sources of a language diverge from each other and from the language as a whole.

Identical texts of a language are collapsed first, by digests: a text is cut into terms once, with the number of its copies in each source
beside it. Texts that occur once stay where they are; those that occur again cross the network once. Counts and document frequencies are weighted by these numbers. All later work is
on integer counts of (language, term, source), in Spark expressions.

Pairs of sources are evaluated sparsely. Let p0 be what a source gives a term that it doesn't have. The sum of f over all V kept
terms is V f(p0, q0), corrected for terms of the one source, for terms of the other, and for terms of both. Corrections for one
source need only a histogram of its counts; only terms of both sources are paired, in a row per two sources of a term, summed
before the shuffle.

Defined results: null text, lang and source are ''. Repeated rows count as often as they occur. Texts without terms, and sources
of none, make groups with N = 0. A language without kept terms has pairs of value 0 and no terms. An empty table gives no rows.
Further columns don't matter. Ties of value are ranked by item in UTF-8 order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, text_batches, with_mark
from .terms import LETTERS, byte_map, terms

#: Bytes of text whose counts are summed up in a task before they leave it.
CHUNK_BYTES = 16_000_000


def collapsed(docs: DataFrame) -> DataFrame:
    """lang, text and copies (an array of source and n) of each text that differs from the others of its language.

    Only digests are grouped at first; a text that occurs once stays where it is. Rows of texts that occur again are merged within
    each task before they are dealt by digest, so that a text with very many copies brings each task at most one row from every other.
    """
    rows = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    keyed = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    again = stored(keyed.groupBy("lang", "digest").agg(F.count("*").alias("n")).where("n > 1").select("lang", "digest"), "repeated-texts")
    key = lambda: F.concat("digest", F.encode("lang", "UTF-8"))
    keyed = with_mark(keyed, key(), again, key(), "again")
    alone = keyed.where("not again").select("lang", "text", F.array(F.struct("source", F.lit(1).cast("long").alias("n"))).alias("copies"))
    keyed = keyed.where("again")
    copies = keyed.groupBy("lang", "digest", "source").agg(F.count("*").alias("n")).groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "n")).alias("copies"))
    texts = keyed.groupBy("lang", "digest").agg(F.first("text").alias("text"))
    return alone.union(texts.join(copies, ["lang", "digest"]).select("lang", "text", "copies"))


COUNTS = "lang string, source string, term string, n long, docs long"


def term_counts(texts: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents with it), summed within chunks of texts; texts as of collapsed()."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(T._parse_datatype_string(COUNTS))

    def run(batches):
        mapped = byte_map(LETTERS)
        for batch, chunk in text_batches(batches, "text", CHUNK_BYTES):
            found = terms(chunk, mapped)
            width = len(found.words)
            if not width:
                continue
            pairs, tf = np.unique(found.texts() * width + found.index, return_counts=True)
            of, term = np.divmod(pairs, width)
            groups: dict = {}
            owners, first, group, copies = batch.column("copies").to_pylist(), [], [], []
            for lang, held in zip(batch.column("lang").to_pylist(), owners, strict=True):
                first.append(len(group))
                for x in held:
                    group.append(groups.setdefault((lang, x["source"]), len(groups)))
                    copies.append(x["n"])
            first = np.array([*first, len(group)])
            sizes = np.diff(first)[of]  # sources of each pair's text
            place = np.repeat(first[of] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            times = np.array(copies)[place]
            keys, order = np.array(group)[place] * width + np.repeat(term, sizes), None
            order = np.argsort(keys, kind="stable")
            starts = np.flatnonzero(np.diff(keys[order], prepend=-1))
            n = np.add.reduceat((np.repeat(tf, sizes) * times)[order], starts)
            docs = np.add.reduceat(times[order], starts)
            g, t = np.divmod(keys[order][starts], width)
            langs, sources = (pa.array([k[i] for k in groups], pa.string()) for i in (0, 1))
            for a in range(0, len(g), 100_000):
                b = slice(a, a + 100_000)
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(g[b])), sources.take(pa.array(g[b])), found.words.take(pa.array(t[b])), pa.array(n[b]), pa.array(docs[b])], schema=schema)

    return texts.mapInArrow(run, COUNTS)


def kept_terms(docs: DataFrame, least_docs: int = 3) -> DataFrame:
    """lang, term and counts (an array of source and n) of the terms in at least so many documents of their language."""
    counts = term_counts(collapsed(docs)).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("counts"))
    return by_term.where(F.col("docs") >= least_docs).select("lang", "term", "counts")


def share(count: str, total: str) -> str:
    """SQL of 1 + floor(10^9 (count + 1) / total), in three steps of 64-bit integers; count + 1 is at most total."""
    a, steps = f"({count} + 1)", []
    for _ in range(3):
        steps.append(f"(({a} * 1000) div {total})")
        a = f"(({a} * 1000) % {total})"
    return f"(1 + {steps[0]} * 1000000 + {steps[1]} * 1000 + {steps[2]})"


def gap(p: str, q: str) -> str:
    """SQL of floor((p - q)^2 / q)."""
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, v (kept terms of the language), total and lang_total (each N + V), p0 (share of a term of no count; null if v = 0)."""
    groups = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    sums = kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("n"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c["n"])).alias("all_n"))
    joined = groups.join(sums, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["n", "v", "all_n"])
    totals = joined.select("lang", "source", "v", (F.col("n") + F.col("v")).alias("total"), (F.col("all_n") + F.col("v")).alias("lang_total"))
    return totals.withColumn("p0", F.when(F.col("v") > 0, F.expr(share("0", "nullif(total, 0)"))))


def pair_values(held: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, source, item (the other source) and value. held: lang, term, source, p and p0 of the terms that a source has."""
    two = lambda t, x: t.select("lang", *(F.col(c).alias(f"{x}_{c}") for c in ("source", "p0")))
    base = two(totals, "a").join(totals.select("lang", F.col("source").alias("b_source"), F.col("p0").alias("b_p0"), "v"), "lang").where("a_source <> b_source")
    none_of_both = base.select("lang", F.col("a_source").alias("source"), F.col("b_source").alias("item"), F.expr(f"coalesce(v * {gap('a_p0', 'b_p0')}, 0)").alias("value"))

    histogram = held.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("m"))
    against = histogram.join(two(totals, "b"), "lang").where("source <> b_source")
    sides = F.expr(
        f"""array(named_struct('source', source, 'item', b_source, 'value', m * ({gap("p", "b_p0")} - {gap("p0", "b_p0")})),
                  named_struct('source', b_source, 'item', source, 'value', m * ({gap("b_p0", "p")} - {gap("b_p0", "p0")})))"""
    )
    of_one = against.select("lang", F.explode(sides).alias("x")).select("lang", "x.*")

    by_term = held.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("g"))
    both = by_term.where(F.size("g") > 1).select("lang", F.explode("g").alias("a"), "g").select("lang", "a", F.explode("g").alias("b")).where("a.source < b.source")
    more = lambda x, y: f"({gap(f'{x}.p', f'{y}.p')} - {gap(f'{x}.p', f'{y}.p0')} - {gap(f'{x}.p0', f'{y}.p')} + {gap(f'{x}.p0', f'{y}.p0')})"
    summed = both.groupBy("lang", F.col("a.source").alias("s"), F.col("b.source").alias("t")).agg(F.expr(f"sum({more('a', 'b')})").alias("st"), F.expr(f"sum({more('b', 'a')})").alias("ts"))
    ways = F.array(F.struct(F.col("s").alias("source"), F.col("t").alias("item"), F.col("st").alias("value")), F.struct(F.col("t").alias("source"), F.col("s").alias("item"), F.col("ts").alias("value")))
    of_both = summed.select("lang", F.explode(ways).alias("x")).select("lang", "x.*")
    return none_of_both.union(of_one).union(of_both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, least_docs: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value and rank: every other source of the language, and the terms that most set a source apart."""
    kept = stored(kept_terms(docs, least_docs), "kept-terms")
    totals = stored(group_totals(docs, kept), "group-totals")
    sums = F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c["n"])
    held = kept.select("lang", "term", sums.alias("all_n"), F.explode("counts").alias("c")).select("lang", "term", "all_n", "c.*").join(totals, ["lang", "source"])
    held = held.select("lang", "term", "source", "p0", F.expr(share("n", "total")).alias("p"), F.expr(share("all_n", "lang_total")).alias("q"))

    ranked = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(held, totals).withColumn("rank", F.row_number().over(ranked))
    marked = held.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(gap("p", "q")).alias("value"))
    marked = marked.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").union(columns(marked, "term"))
