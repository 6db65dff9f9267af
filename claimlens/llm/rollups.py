"""Token counts as rollups that signed deltas keep up to date.

Every change of a document's count is a row with a sign: an insert adds, a delete takes away, a revision takes
away the old count and adds the new one. A batch of changes is pre-aggregated to deltas by source, language
and tokenizer version, and committed once under its id; a batch that comes again changes nothing. Totals are
the sums of all committed deltas, which are additive, so the order of batches doesn't matter.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import ByteBpe, read_file, read_ranks
from .common import with_columns

KEYS = ["source", "lang", "tokenizer"]
DELTAS = "source string, lang string, tokenizer string, docs long, tokens long"

#: Pre-tokens whose lengths a task keeps; when there are more, it begins anew.
CACHE = 400_000


def word_counts(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, lang, the columns of keep, tokenizer (words-1) and tokens: the runs between ASCII white space of each text.

    A null text has none. Repeated rows stay, null ids, sources and languages too; an empty table gives no rows.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    return df.select("doc_id", "source", "lang", *keep, F.lit("words-1").alias("tokenizer"), F.regexp_count(t, F.lit("[^ \\t\\n\\x0B\\f\\r]+")).cast("long").alias("tokens"))


def token_counts(df: DataFrame, rank_files: dict[str, str], pattern: str, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, lang, the columns of keep, tokenizer and tokens: a row per document and tokenizer version.

    rank_files: the byte-level BPE rank file of each version; their pre-tokens are the matches of pattern, so a text is split once.
    A null or empty text has no tokens, and whole texts are counted however long they are. Repeated rows stay, null ids, sources
    and languages too. An empty table gives no rows. Further columns of df are not used.
    """
    data = {name: df.sparkSession.sparkContext.broadcast(read_file(path)) for name, path in rank_files.items()}
    names = list(data)

    def make():
        coders = [ByteBpe(read_ranks(data[name].value), pattern) for name in names]
        known: list[dict[str, int]] = [{} for _ in coders]

        def columns(texts):
            out: list[list[int]] = []
            for t in texts.to_pylist():
                pretokens = coders[0].split.findall(t)
                missing = list(set(pretokens).difference(known[0]))
                if len(known[0]) + len(missing) > CACHE:
                    for k in known:
                        k.clear()
                    missing = list(set(pretokens))
                for coder, k in zip(coders, known):
                    k.update(zip(missing, coder.lengths(missing)))
                out.append([sum(map(k.__getitem__, pretokens)) for k in known])
            return [pa.array(out, pa.list_(pa.int64()))]

        return columns

    own = ["doc_id", "source", "lang", *keep]
    counted = with_columns(df.select(*own, F.col(text).alias("_text")), "_text", "_counts array<long>", make).drop("_text")
    each = F.arrays_zip(F.array(*map(F.lit, names)).alias("tokenizer"), F.col("_counts").alias("tokens"))
    return counted.select(*own, F.explode(each).alias("c")).select(*own, F.col("c.tokenizer").alias("tokenizer"), F.col("c.tokens").alias("tokens"))


def inserts(rows: DataFrame) -> DataFrame:
    return rows.select(*KEYS, F.lit(1).alias("sign"), "tokens")


def deletes(rows: DataFrame) -> DataFrame:
    return rows.select(*KEYS, F.lit(-1).alias("sign"), "tokens")


def revisions(rows: DataFrame, old: str | Column, new: str | Column) -> DataFrame:
    """Rows whose count was old and now is new: a delete and an insert of each."""
    both = F.array(F.struct(F.lit(-1).alias("sign"), (F.col(old) if isinstance(old, str) else old).alias("tokens")), F.struct(F.lit(1).alias("sign"), (F.col(new) if isinstance(new, str) else new).alias("tokens")))
    return rows.select(*KEYS, F.explode(both).alias("c")).select(*KEYS, "c.sign", "c.tokens")


class Rollup:
    """A rollup in a folder: a folder of deltas for each batch.

    Spark's writer shows a batch's files only with its _SUCCESS marker in place, and reads take only batches that
    have it; a batch whose job died is overwritten when it comes again, a batch that is there is left alone. A batch without rows
    is committed as well. Rows with a null source, language or tokenizer make groups of nulls; a null count adds a document
    and no tokens; repeated rows count as often as they are there; further columns are not used.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _done(self, batch: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch={batch}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch of signed rows (KEYS, sign, tokens); False if it had been committed before."""
        if not batch.replace("-", "").isalnum():
            raise ValueError("a batch id has letters, digits and hyphens only")
        if self._done(batch):
            return False
        deltas = changes.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("docs"), F.coalesce(F.sum(F.col("sign") * F.col("tokens")), F.lit(0)).cast("long").alias("tokens"))
        deltas.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return True

    def batches(self) -> list[str]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(root))
        return [n.removeprefix("batch=") for n in names if n.startswith("batch=") and self._done(n.removeprefix("batch="))]

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs and n_tokens over all committed batches; groups with nothing left are gone."""
        paths = [f"{self.path}/batch={b}" for b in self.batches()]
        deltas = self.spark.read.schema(DELTAS).parquet(*paths) if paths else self.spark.createDataFrame([], DELTAS)
        sums = deltas.groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return sums.where("n_docs != 0 or n_tokens != 0")
