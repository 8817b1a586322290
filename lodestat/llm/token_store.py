"""Token ids in a bit-plane-shuffled file format.

Documents are dealt out in ascending order of their id; each partition is a shard, a
stream of ids cut into blocks of a fixed number of ids.  A block's ids are transposed
into byte planes (4) or bit planes (32), and each plane is compressed with zstandard.

A store is a folder of Parquet files that Spark writes (so any file system of the
cluster serves, and a lost task leaves no half-written file), one row for each block:
the chunk index (shard, block, first id, number of ids, plane kind and sizes), the index
of the documents that the block holds a piece of, and the planes.  The index is read
without the planes.  Blocks decode independently of each other.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, worker_cache
from .pretokens import ChunkEncoder

BLOCK_IDS = 65_536
#: Bytes of chunks that a task remembers, and of text that it encodes at once.
MEMO_BYTES, SLICE = 112 << 20, 4 << 20
STORE = (
    "shard int, block int, first long, n_ids int, kind string, plane_bytes array<int>, "
    "docs array<struct<doc_id long, number long, part int, n_ids int, last boolean>>, planes array<binary>"
)
_PIECE = pa.struct([("doc_id", pa.int64()), ("number", pa.int64()), ("part", pa.int32()), ("n_ids", pa.int32()), ("last", pa.bool_())])
_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("kind", pa.string()),
                    ("plane_bytes", pa.list_(pa.int32())), ("docs", pa.list_(_PIECE)), ("planes", pa.list_(pa.binary()))])


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The ids' bytes (least first), or bits (least first, eight ids to a byte), plane by plane."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [p.tobytes() for p in np.ascontiguousarray(raw.T)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [p.tobytes() for p in np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    rows = np.stack([np.frombuffer(p, np.uint8) for p in planes]) if n else np.zeros((len(planes), 0), np.uint8)
    if kind == "bit":
        rows = np.packbits(np.unpackbits(rows, axis=1, bitorder="little", count=n), axis=0, bitorder="little")
    return np.ascontiguousarray(rows.T).view("<u4").ravel()


def library_encoder(spec: str, limit: int = MEMO_BYTES):
    """Encodes texts as the tokenizers library does with this tokenizer file's content
    (byte-level BPE; an added token's string in a text is that token, as the library reads
    it).  Chunks are encoded apart only if no added token reaches over a space."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(spec)

    def encode(texts):
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    added = tokenizer.get_added_tokens_decoder()
    if any(t.lstrip or t.rstrip or t.single_word or any(c.isspace() for c in t.content) for t in added.values()):
        def whole(texts):
            made = encode(texts.to_pylist() if isinstance(texts, pa.Array) else texts)
            return np.fromiter(chain.from_iterable(made), np.uint32), np.fromiter(map(len, made), np.int64, len(made))

        return whole
    # byte-level pieces have one character for each byte; added tokens stand for themselves
    sizes = np.zeros(1 + max(tokenizer.get_vocab().values()), np.int64)
    for token, i in tokenizer.get_vocab().items():
        sizes[i] = len(added[i].content.encode()) if i in added else len(token)
    return ChunkEncoder(encode, sizes, limit, tuple(t.content for t in added.values()))


class _Shard:
    """Cuts a stream of documents into blocks."""

    def __init__(self, shard: int, size: int, kind: str):
        import zstandard

        self.shard, self.size, self.kind = shard, size, kind
        self.pack = zstandard.ZstdCompressor(level=3).compress
        self.blocks = self.number = 0
        self._empty()

    def _empty(self):
        self.held, self.n, self.docs = [], 0, []

    def add(self, doc_id, ids: np.ndarray):
        part, at = 0, 0
        while True:
            take = min(self.size - self.n, len(ids) - at)
            last = at + take == len(ids)
            if take or last:
                self.held.append(ids[at : at + take])
                self.docs.append({"doc_id": doc_id, "number": self.number, "part": part, "n_ids": take, "last": last})
                self.n += take
                part, at = part + 1, at + take
            if self.n == self.size:
                yield self.row()
            if last:
                break
        self.number += 1

    def row(self):
        ids = np.concatenate(self.held) if self.held else np.zeros(0, "<u4")
        planes = [self.pack(p) for p in to_planes(ids, self.kind)]
        out = (self.shard, self.blocks, self.blocks * self.size, self.n, self.kind, [len(p) for p in planes], self.docs, planes)
        self.blocks += 1
        self._empty()
        return out

    def rest(self):
        if self.docs:
            yield self.row()


def write(docs: DataFrame, path: str, spec: str, end_id: int, doc_id: str = "doc_id", text: str = "text",
          block_ids: int = BLOCK_IDS, kind: str = "byte") -> None:
    """Encodes every whole text (null: empty), appends ``end_id``, and writes the store.

    Documents are in ascending order of doc_id, null first; documents with the same id
    are in order of their text's hash.  A long text spans blocks.  An empty table gives
    an empty store.  Other columns are not read."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(spec)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    # rows with one id may be many: the hash deals them out too
    rows = rows.withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h")

    def run(batches):
        shard = _Shard(TaskContext.get().partitionId(), block_ids, kind)
        encoder = worker_cache(("tokenizers", hash(held.value)), lambda: library_encoder(held.value))
        for batch in batches:
            for piece in slices(batch, "text", SLICE):
                ids, sizes = encoder(piece.column("text"))
                at, made = 0, []
                for one, n in zip(piece.column("id").to_pylist(), sizes.tolist(), strict=True):
                    made += shard.add(one, np.append(ids[at : at + n], end_id).astype("<u4"))
                    at += n
                if made:
                    yield _batch(made)
        if made := list(shard.rest()):
            yield _batch(made)

    rows.mapInArrow(run, STORE).write.option("compression", "none").parquet(path)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """The store's rows; selecting other columns than planes reads only the chunk index."""
    return spark.read.schema(STORE).parquet(path)


def shard_starts(store: DataFrame) -> DataFrame:
    """shard, ids_before: ids of all shards before it.  One row for each shard, that is for
    each task that wrote, is summed up on the driver."""
    totals = sorted(tuple(r) for r in store.groupBy("shard").agg(F.sum("n_ids")).collect())
    before = np.cumsum([0, *(n for _, n in totals)]).tolist()
    rows = [(shard, at) for (shard, _), at in zip(totals, before[:-1], strict=True)]
    return store.sparkSession.createDataFrame(rows, "shard int, ids_before long")


def pieces(store: DataFrame, whole: bool) -> DataFrame:
    """The pieces of documents in the blocks: all ids of documents that lie in one block
    (whole), or else the pieces of documents that span blocks.  Columns shard, number,
    part, doc_id, at (position in the shard), ids (binary)."""
    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i in range(batch.num_rows):  # block by block, as a batch may hold many
                row = batch.slice(i, 1).to_pylist()[0]
                wanted = [(d["part"] == 0 and d["last"]) is whole for d in row["docs"]]
                if not any(wanted):
                    continue
                ids = from_planes([unpack(p) for p in row["planes"]], row["n_ids"], row["kind"])
                at, out = 0, []
                for d, take in zip(row["docs"], wanted, strict=True):
                    if take:
                        out.append((row["shard"], d["number"], d["part"], d["doc_id"], row["first"] + at, ids[at : at + d["n_ids"]].tobytes()))
                    at += d["n_ids"]
                columns = zip(*out, strict=True)
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["shard", "number", "part", "doc_id", "at", "ids"])

    needed = store.select("shard", "first", "n_ids", "kind", "docs", "planes")
    return needed.mapInArrow(run, "shard int, number long, part int, doc_id long, at long, ids binary")


def read_documents(store: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (binary) of every
    document.  Only documents that span blocks are shuffled, one group for each."""
    split = pieces(store, False).groupBy("shard", "number").agg(
        F.min("doc_id").alias("doc_id"), F.min("at").alias("at"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "ids"))), lambda x: F.hex(x["ids"])), "").alias("hex"))
    both = pieces(store, True).select("shard", "doc_id", "at", "ids").unionByName(split.select("shard", "doc_id", "at", F.unhex("hex").alias("ids")))
    return both.join(shard_starts(store), "shard").select(
        "doc_id", (F.col("ids_before") + F.col("at")).alias("start"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")
