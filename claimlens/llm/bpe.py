"""Byte-level BPE by a sentencepiece model that is serialised directly from a rank file.

Each byte sequence of the vocabulary becomes a piece of printable characters, one per byte. A piece's score
is its negative rank, so that sentencepiece's merging, best score first and leftmost among equals, is that of
ranks. A piece's place in the model is its rank, so piece ids are token ids. Normalisation is the identity.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import chain

import pyarrow.fs as pafs
import regex
import sentencepiece
from pyspark.sql import DataFrame

from .common import with_columns

#: Encoded pre-tokens that a task keeps; when there are more, it begins anew.
CACHE = 400_000


def byte_characters() -> str:
    """A character for each byte: the byte's own where it is printable in Latin-1, others from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return "".join(chr(b if b in own else next(rest)) for b in range(256))


_CHARACTERS = byte_characters()
_TO_CHARACTERS = {b: c for b, c in enumerate(_CHARACTERS)}


def mapped(data: bytes) -> str:
    return data.decode("latin-1").translate(_TO_CHARACTERS)


def read_ranks(data: bytes) -> list[bytes]:
    """The byte sequences of a rank file (base64 and rank in each line), by rank; ranks run from 0 without gaps."""
    ranks = {int(r): base64.b64decode(t) for t, r in (line.split() for line in data.splitlines() if line.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks have gaps")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protocol buffer field: bytes with their length, int as varint, float as four bytes."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


#: Field numbers and enum values of sentencepiece's public ModelProto.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, TYPE, NORMAL, UNKNOWN = 1, 2, 3, 1, 2
MODEL_TYPE, BPE, VOCAB_SIZE, UNK_ID, BOS_ID, EOS_ID, PAD_ID = 3, 2, 4, 40, 41, 42, 43
NAME, ADD_DUMMY_PREFIX, REMOVE_EXTRA_WHITESPACES, ESCAPE_WHITESPACES = 1, 3, 4, 5


def model_proto(vocabulary: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model; the piece <unk>, which can't occur, comes last."""
    none = (1 << 64) - 1
    pieces = [_field(PIECES, _field(PIECE, mapped(t).encode()) + _field(SCORE, -float(r)) + _field(TYPE, NORMAL)) for r, t in enumerate(vocabulary)]
    unknown = _field(PIECES, _field(PIECE, b"<unk>") + _field(SCORE, 0.0) + _field(TYPE, UNKNOWN))
    trainer = _field(MODEL_TYPE, BPE) + _field(VOCAB_SIZE, len(vocabulary) + 1) + _field(UNK_ID, len(vocabulary)) + _field(BOS_ID, none) + _field(EOS_ID, none) + _field(PAD_ID, none)
    normalizer = _field(NAME, b"identity") + _field(ADD_DUMMY_PREFIX, 0) + _field(REMOVE_EXTRA_WHITESPACES, 0) + _field(ESCAPE_WHITESPACES, 0)
    return b"".join(pieces) + unknown + _field(TRAINER, trainer) + _field(NORMALIZER, normalizer)


class ByteBpe:
    """Encodes texts to ids and decodes ids to bytes."""

    def __init__(self, vocabulary: list[bytes], pattern: str):
        self.vocabulary = vocabulary
        self.whole = {t: (i,) for i, t in enumerate(vocabulary)}
        self.split = regex.compile(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(vocabulary))
        self.cache: dict[str, tuple[int, ...]] = {}

    def learn(self, pretokens: set[str]) -> None:
        """Encodes pre-tokens into the cache. One that is in the vocabulary is that token."""
        new = [(p, p.encode("utf-8", "replace")) for p in pretokens]
        rest = []
        for p, b in new:
            if (ids := self.whole.get(b)) is not None:
                self.cache[p] = ids
            else:
                rest.append((p, mapped(b)))
        for (p, _), ids in zip(rest, self.model.encode([m for _, m in rest], num_threads=1)):
            self.cache[p] = tuple(ids)

    def lengths(self, pretokens: list[str]) -> list[int]:
        """How many tokens each pre-token has."""
        data = [p.encode("utf-8", "replace") for p in pretokens]
        out = [1] * len(data)
        rest = [i for i, b in enumerate(data) if b not in self.whole]
        for i, ids in zip(rest, self.model.encode([mapped(data[i]) for i in rest], num_threads=1)):
            out[i] = len(ids)
        return out

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        for text in texts:
            pretokens = self.split.findall(text)
            missing = set(pretokens).difference(self.cache)
            if missing:
                if len(self.cache) + len(missing) > CACHE:
                    self.cache.clear()
                    missing = set(pretokens)
                self.learn(missing)
            yield list(chain.from_iterable(map(self.cache.__getitem__, pretokens)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


def read_file(path: str) -> bytes:
    fs, at = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    with fs.open_input_stream(at) as f:
        return f.read()


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def with_bpe(df: DataFrame, rank_file: str, pattern: str, text: str = "text", keep_ids: bool = False) -> DataFrame:
    """df with the token count of each whole text, the digest of its ids and that of the bytes they decode to.

    Adds n_tokens, ids_sha256 (of the decimal ids joined by one space), decoded_sha256, and with keep_ids the ids
    as token_ids. Special tokens are never made: their strings are ordinary text. A null text counts as empty and
    has no tokens. Equal texts get equal values; repeated rows stay; an empty table gives no rows; columns of
    these names are replaced. The rank file goes to the tasks with the job.
    """
    data = df.sparkSession.sparkContext.broadcast(read_file(rank_file))

    def make():
        bpe = ByteBpe(read_ranks(data.value), pattern)
        decimal = [str(i) for i in range(len(bpe.vocabulary))]

        def columns(texts):
            rows = []
            for ids in bpe.encode(texts.to_pylist()):
                digest = hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest()
                row = (len(ids), digest, hashlib.sha256(bpe.decode(ids)).hexdigest())
                rows.append((*row, ids) if keep_ids else row)
            return list(map(list, zip(*rows)))

        return columns

    return with_columns(df, text, DIGESTS + ", token_ids array<int>" * keep_ids, make)
