"""Byte-level BPE through sentencepiece.

The vocabulary (token bytes by rank) is serialised directly as a sentencepiece BPE
model: each token's bytes are mapped to printable characters, its score is its
negative rank, and the normaliser is the identity.  Pre-tokens (matches of a pattern)
are encoded one by one; decoding maps pieces back to bytes.
"""

from __future__ import annotations

import base64
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import map_text, worker_cache
from .pretokens import ChunkEncoder


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1,
    else the next free code point from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in plain else next(free)) for b in range(256)]


def load_ranks(path: str) -> list[bytes]:
    """Token bytes by rank, from a file with a base64 token and a rank on each line."""
    with open(path, "rb") as lines:
        ranks = {int(r): base64.b64decode(t) for t, r in map(bytes.split, lines)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value) -> bytes:
    """One protocol-buffer field: int as varint, float as fixed32, bytes with a length."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise_model(ranks: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: piece i is token i; the unknown piece comes last
    (no byte string needs it, as every single byte is a token)."""
    if len({t for t in ranks if len(t) == 1}) != 256:
        raise ValueError("every single byte must be a token")
    chars = byte_characters()
    pieces = [_field(1, _field(1, "".join(chars[b] for b in t).encode()) + _field(2, -float(i)) + _field(3, 1)) for i, t in enumerate(ranks)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    # trainer: model type BPE, vocabulary size, ids of unknown; no begin, end or pad piece
    none = (1 << 64) - 1
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(ranks)) + _field(41, none) + _field(42, none) + _field(43, none)
    # normaliser: identity, no dummy prefix, no white-space folding or escaping
    normaliser = _field(1, b"identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes texts and decodes ids with a serialised model."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        back = {c: b for b, c in enumerate(byte_characters())}
        n = self.sp.get_piece_size() - 1
        self.bytes = [bytes(back[c] for c in self.sp.id_to_piece(i)) for i in range(n)]
        self.rank = {t: i for i, t in enumerate(self.bytes)}
        self.map = {b: c for b, c in enumerate(byte_characters())}
        self.words = regex.compile(pattern)
        self.encode = ChunkEncoder(self._encode)

    def _encode(self, chunks: list[str]) -> list[list[int]]:
        found = [[p.encode() for p in self.words.findall(c)] for c in chunks]
        # a pre-token that is itself a token has that id; the others are merged by rank
        rest = list(dict.fromkeys(p for f in found for p in f if p not in self.rank))
        mapped = [p.decode("latin-1").translate(self.map) for p in rest]
        ids = dict(zip(rest, self.sp.encode(mapped, num_threads=1), strict=True)) if rest else {}
        return [[i for p in f for i in ((self.rank[p],) if p in self.rank else ids[p])] for f in found]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def encode(docs: DataFrame, ranks: list[bytes], pattern: str, keep: dict[str, str] | None = None, text: str = "text",
           decoded: bool = False) -> DataFrame:
    """Encodes each whole text; with ``decoded`` the ids are also decoded again.

    Returns the columns of ``keep`` (output name: column; doc_id by default), n_tokens,
    ids (binary, little-endian unsigned 32-bit) and, if asked for, decoded (binary).
    A null or empty text has no ids; repeated rows give repeated results; other columns
    are not read, so their names cannot clash.  The model is as large as the vocabulary,
    whatever the input."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(serialise_model(ranks))

    def make():
        codec = worker_cache(("bpe", hash(model.value), pattern), lambda: Codec(model.value, pattern))

        def work(texts):
            ids, sizes = codec.encode([t or "" for t in texts])
            ends = np.cumsum(sizes)
            raw = [ids[e - n : e].astype("<u4") for e, n in zip(ends, sizes, strict=True)]
            out = [pa.array(sizes, pa.int64()), pa.array([x.tobytes() for x in raw], pa.binary())]
            return out + [pa.array([codec.decode(x.tolist()) for x in raw], pa.binary())] * decoded

        return work

    return map_text(docs, keep or {"doc_id": "doc_id"}, text, make, "n_tokens long, ids binary" + ", decoded binary" * decoded)


def decode(encoded: DataFrame, ranks: list[bytes], ids: str = "ids") -> DataFrame:
    """Adds the column decoded (binary) to a frame with little-endian 32-bit ids; null ids
    give null.  An id outside the vocabulary is an error."""
    spark = encoded.sparkSession
    table = spark.sparkContext.broadcast(ranks)
    schema = StructType([*encoded.schema.fields, StructField("decoded", BinaryType())])

    def run(batches):
        tokens = table.value
        for b in batches:
            made = [None if x is None else b"".join(map(tokens.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.binary())], names=schema.names)

    return encoded.mapInArrow(run, schema)
