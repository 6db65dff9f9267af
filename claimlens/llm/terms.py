"""Terms of texts: runs of bytes that no separator cuts, as indexes of distinct terms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import Tokens, string_bytes


def byte_map(separators: list[tuple[int, int]]) -> np.ndarray:
    """What each byte becomes: a space where it separates terms (inclusive ranges of ASCII), else itself, A to Z in lower case.

    Bytes of 128 and more belong to characters outside ASCII, so that UTF-8 needs no decoding.
    """
    found = np.arange(256, dtype=np.uint8)
    found[65:91] += 32
    for first, last in separators:
        found[first : last + 1] = 32
    return found


#: Separators of `[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+`: terms of letters and digits.
LETTERS_AND_DIGITS = [(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)]
#: Separators of `[^\x00-\x40\x5B-\x60\x7B-\x7F]+`: terms of letters.
LETTERS = [(0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F)]


def terms(texts: pa.Array, mapped: np.ndarray) -> Tokens:
    """The terms of each text; texts has no nulls."""
    data, ends = string_bytes(texts)
    offsets = np.zeros(len(ends) + 1, np.int32)
    offsets[1:] = ends
    return Tokens(pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(mapped[data])))
