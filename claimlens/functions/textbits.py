"""A 64-bit hash of texts whose near copies get near values."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Words that a task weighs at once; a longer text is worked on by itself.
WORDS = 400_000


def sign_bits(texts: pa.Array) -> np.ndarray:
    """Bit k of a text is whether most of its different words have bit k in their hashes; a text without words gets 0."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.to_pandas()
    hashes = pd.util.hash_array(words.to_numpy(), categorize=False) if len(words) else np.zeros(0, np.uint64)
    full = (words.str.len() > 0).to_numpy() if len(words) else np.zeros(0, bool)
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros(len(sizes), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for i, (a, b) in enumerate(zip(np.cumsum(sizes) - sizes, np.cumsum(sizes))):
        own = np.unique(codes[a:b])
        own = hashes[own[full[own]]]
        ones = sum(np.unpackbits(own[k : k + WORDS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for k in range(0, len(own), WORDS))
        if len(own):
            out[i] = weights[2 * ones > len(own)].sum()
    return out.view(np.int64)


def with_sign_bits(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the hash of its texts in place of them."""
    keep = [c for c in df.columns if c != text]
    schema = df.select(*keep).schema.add(name, "long")

    def run(batches):
        for batch in batches:
            bits = sign_bits(batch.column(text).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(bits)], names=[*keep, name])

    return df.mapInArrow(run, schema)
