"""What the operators of this subpackage share: tables, scratch tables and Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.sources.scratch import scratch, stored
from claimlens.sources.tables import table

__all__ = ["Tokens", "chunks", "free_name", "mixed", "scratch", "stored", "string_bytes", "string_hashes", "table", "text_batches", "with_columns", "with_mark"]

#: Bytes of text that a task works on at once, besides at most one longer text.
CHUNK_BYTES = 4_000_000


def chunks(lengths: list[int], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose lengths add up to limit at most, or of one row."""
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def text_batches(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """The batches cut into chunks of rows, each with its texts; null texts are empty."""
    for batch in batches:
        texts = pc.fill_null(batch.column(batch.schema.get_field_index(text)).cast(pa.string()), "")
        for a, b in chunks(pc.binary_length(texts).to_pylist(), limit):
            yield batch.slice(a, b - a), texts.slice(a, b - a)


class Tokens:
    """The words of some texts (what lies between ASCII white space), each as an index of the distinct words.

    sizes: words of each text; index: the words of all texts, in order; words: the distinct words, an Arrow array.
    """

    def __init__(self, texts: pa.Array | list[str], lower: bool = False):
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = split.flatten()
        real = pc.not_equal(pc.binary_length(flat), 0)  # white space at either end makes empty words
        on = real.to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(len(counts)), counts)
        self.sizes = np.bincount(of[on], minlength=len(counts)).astype(np.int64)
        coded = flat.filter(real).dictionary_encode()
        self.index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.words = coded.dictionary

    def ends(self) -> np.ndarray:
        return np.cumsum(self.sizes)

    def texts(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.sizes)), self.sizes)


def string_bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all strings in one array, and the end of each."""
    lengths = pc.binary_length(strings).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    _, offsets, data = strings.buffers()
    first = np.frombuffer(offsets, np.int32)[strings.offset] if len(strings) else 0
    total = int(ends[-1]) if len(ends) else 0
    return (np.frombuffer(data, np.uint8)[first : first + total] if total else np.zeros(0, np.uint8)), ends


_BYTE_CODES = np.random.default_rng(20240131).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_RADIX = 0x9E3779B97F4A7C15


def mixed(h: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit value of each 64-bit value, one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def string_hashes(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string that isn't empty; the same on every machine."""
    if not len(strings):
        return np.zeros(0, np.uint64)
    data, ends = string_bytes(strings)
    lengths = np.diff(ends, prepend=0)
    first = ends - lengths
    place = np.arange(len(data)) - np.repeat(first, lengths)
    powers = np.ones(int(lengths.max()) + 1, np.uint64)
    np.multiply.accumulate(np.full(len(powers) - 1, _RADIX, np.uint64), out=powers[1:])
    sums = np.add.reduceat(_BYTE_CODES[data] * powers[place], first)
    return mixed(sums + lengths.astype(np.uint64))


#: Bits of a bitmap: 4 MB at most.
SLOTS = 1 << 25


def with_mark(rows: DataFrame, key: Column, few: DataFrame, few_key: Column, name: str) -> DataFrame:
    """rows with a boolean: true where the key is that of a row of few, and for some others.

    The keys of few become a bitmap of bounded size, which is broadcast; so rows that don't need few stay where they are. Where few has
    so many keys that the bitmap is full, all rows are marked.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS))
    marks = few.select(slot(few_key).alias("_s")).groupBy(F.bitmap_bucket_number("_s").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_s")).alias("_bits"))
    rows = rows.withColumn("_bit", F.bitmap_bit_position(slot(key)))
    rows = rows.join(F.broadcast(marks), F.bitmap_bucket_number(slot(key)) == F.col("_bucket"), "left")
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return rows.withColumn(name, F.coalesce(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1, F.lit(False))).drop("_bit", "_bucket", "_bits")


def free_name(columns: list[str], name: str) -> str:
    """name, with as many underscores behind it as no column has, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def appended(batch: pa.RecordBatch, fields: list[pa.Field], columns: list) -> pa.RecordBatch:
    """batch with more columns; a column of a like name gives way to the new one."""
    new = {f.name.lower() for f in fields}
    keep = [i for i, f in enumerate(batch.schema) if f.name.lower() not in new]
    arrays = [batch.column(i) for i in keep] + [pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=pa.schema([batch.schema.field(i) for i in keep] + fields))


def widened(df: DataFrame, added: str) -> T.StructType:
    """The schema of df after appended() with the columns of the DDL string."""
    more = T._parse_datatype_string(added)
    new = {f.name.lower() for f in more}
    return T.StructType([f for f in df.schema if f.name.lower() not in new] + list(more))


def with_columns(df: DataFrame, text: str, added: str, make: Callable[[], Callable[[pa.Array], list]]) -> DataFrame:
    """df with columns that are computed from whole texts, in Arrow batches.

    make() is called once a task and returns the function from an array of texts to a list of columns,
    in the order of the DDL string. Null texts count as empty. An empty table gives no rows.
    Columns of df that have the names of new ones are replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = list(to_arrow_schema(T._parse_datatype_string(added)))

    def run(batches):
        columns = make()
        for batch, texts in text_batches(batches, text):
            yield appended(batch, fields, columns(texts))

    return df.mapInArrow(run, widened(df, added))
