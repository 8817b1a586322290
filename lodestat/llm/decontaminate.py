"""Benchmark decontamination by spaced-seed hashing.

Fixed masks over a span of tokens name the positions that count; the others may differ.
Every span of a benchmark item and of a document is hashed under each mask, hashes are
joined, and around each hit the item is laid over the document on the hit's diagonal:
its longest stretch that is alike enough is kept if it is long enough.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ENTRY_BYTES, LOWER, MEMO_BYTES, bitmap, slices, written

#: Fixed masks: 1 counts, 0 is ignored.  Wherever a fifth of 13 to 25 tokens lies changed,
#: one of them hits (a greedy search over all masks of six tokens; the tests enumerate it).
#: Of a longer stretch with four fifths equal, one of two halves of at least 13 has them too.
MASKS = ("111111", "11101011", "11001000111", "1101000001101")
SPAN = max(map(len, MASKS))
MIN_TOKENS = 13
SIMILARITY = 0.8
SALTS = 16
#: A table of seeds or items is broadcast up to this many bytes, else its rows are copied to
#: ``SALTS`` parts and merged.
BROADCAST_BYTES = 8 << 20
_SIGNS = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
_CLEAN = bytes(32 if c in _SIGNS or c < 33 or c == 127 else LOWER[c] for c in range(256))


def tokens(text: str) -> list[bytes]:
    """Words: what stands between ASCII white space and punctuation, ASCII letters lower-cased."""
    return text.encode().translate(_CLEAN).split()


def codes(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    import xxhash

    h = xxhash.xxh64_intdigest
    for w in words:
        if w not in known:
            known[w] = h(w)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def seeds(code: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of every span that lies inside one text, for all masks; ``code``
    holds the texts' tokens one after another and ``ends`` where each text ends."""
    hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    upto = ends[np.searchsorted(ends, np.arange(len(code)), side="right")] if len(code) else ends
    for k, mask in enumerate(MASKS):
        n = len(code) - len(mask) + 1
        if n <= 0:
            continue
        inside = np.arange(n) + len(mask) <= upto[:n]
        h = np.full(n, k + 1, np.uint64)
        for i, c in enumerate(mask):
            if c == "1":
                h = h * np.uint64(0x100000001B3) + code[i : i + n]
        hashes.append(_mix(h)[inside])
        places.append(np.flatnonzero(inside))
    return np.concatenate(hashes), np.concatenate(places)


def whole_masks(n: int, similarity: float) -> list[np.ndarray]:
    """Sets of counted positions of an item of ``n`` tokens, so that wherever the tokens
    that may differ lie, some set has none of them: all but one position each if one may,
    else all blocks of three more than may differ but as many."""
    part, whole = Fraction(str(similarity)).as_integer_ratio()
    spare = n * (whole - part) // whole
    blocks = np.array_split(np.arange(n), n if spare < 2 else min(n, spare + 3))
    return [np.concatenate(kept) for kept in combinations(blocks, len(blocks) - spare) if kept]


def whole_seeds(code: np.ndarray, ends: np.ndarray, n: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of every run of ``n`` tokens inside one text, under the masks of
    whole items of that length."""
    size = len(code) - n + 1
    if not n or size <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.arange(size)
    inside = at + n <= ends[np.searchsorted(ends, at, side="right")]
    masks, out = whole_masks(n, similarity), []
    for k, places in enumerate(masks):
        h = np.full(size, (n << 32) + k, np.uint64)
        for i in places.tolist():
            h = h * np.uint64(0x100000001B3) + code[i : i + size]
        out.append(_mix(h)[inside])
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.tile(at[inside], len(masks))


def bench_items(bench: DataFrame, item: str, text: str) -> DataFrame:
    """ikey (hash of id and text), item_id, n_tokens, and the tokens as codes; one row for each
    id and text."""
    def run(batches):
        known: dict[bytes, int] = {}
        for b in batches:
            for i in range(b.num_rows):  # an item may be long
                row = b.slice(i, 1)
                code = codes(tokens(row.column("text")[0].as_py()), known)
                yield pa.RecordBatch.from_arrays([row.column("ikey"), row.column("item_id"), pa.array([len(code)], pa.int64()), pa.array([code.astype("<u8").tobytes()], pa.binary())],
                                                 names=["ikey", "item_id", "n_tokens", "code"])
                known.clear()

    rows = bench.filter(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{item}`").cast("long").alias("item_id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = rows.distinct().select(F.xxhash64("item_id", "text").alias("ikey"), "item_id", "text")
    return rows.mapInArrow(run, "ikey long, item_id long, n_tokens long, code binary")


def bench_seeds(items: DataFrame, least: int = MIN_TOKENS, similarity: float = SIMILARITY) -> DataFrame:
    """ikey, h, j: one row for each span and mask.  An item of fewer than ``least`` tokens has
    the hashes of its whole."""
    def run(batches):
        for b in batches:
            for key, raw in zip(b.column("ikey").to_pylist(), b.column("code").to_pylist(), strict=True):
                code = np.frombuffer(raw, "<u8")
                ends = np.array([len(code)])
                h, at = seeds(code, ends) if len(code) >= least else whole_seeds(code, ends, len(code), similarity)
                for i in range(0, len(h), 100_000):
                    part = h[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), key)), pa.array(part.astype(np.int64)), pa.array(at[i : i + 100_000].astype(np.int32))], names=["ikey", "h", "j"])

    return items.select("ikey", "code").mapInArrow(run, "ikey long, h long, j int")


def longest_alike(doc: np.ndarray, item: np.ndarray, shift: int, similarity: float) -> tuple[int, int, int]:
    """The longest stretch of the diagonal on which doc[shift + j] lies over item[j] with
    at least ``similarity`` equal tokens: (first token in the document, length, equal
    tokens); ties go to more equal tokens, then to the first.  Length 0 if there is none."""
    a, b = max(0, -shift), min(len(item), len(doc) - shift)
    if b <= a:
        return max(0, shift), 0, 0
    same = doc[a + shift : b + shift] == item[a:b]
    part, whole = Fraction(str(similarity)).as_integer_ratio()
    total = np.concatenate([[0], np.cumsum(np.where(same, whole - part, -part))])
    high = np.maximum.accumulate(total[::-1])[::-1]  # of what stands here or later
    size = np.searchsorted(-high, -total, side="right") - 1 - np.arange(len(total))
    first = np.flatnonzero(size == size.max())
    n = int(size.max())
    count = np.concatenate([[0], np.cumsum(same)])
    equal = count[first + n] - count[first]
    k = int(equal.argmax())
    return a + shift + int(first[k]), n, int(equal[k])


def _spread_join(many: DataFrame, table: DataFrame, key: str, spread: tuple[str, ...], volume: int) -> DataFrame:
    """Joins rows with a table of ``volume`` bytes by a key that a third of the rows may have:
    the table is broadcast if it is small, else its rows are copied and the others dealt out
    over the copies by a salt."""
    if volume <= BROADCAST_BYTES:
        return many.join(F.broadcast(table), key)
    copies = table.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return many.withColumn("salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS))).join(copies.hint("merge"), [key, "salt"]).drop("salt")


FOUND = ("doc_id", "item_id", "first_token", "n_tokens", "n_equal")


def contaminated(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
                 min_tokens: int = MIN_TOKENS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, first_token, n_tokens, n_equal: for each document and item the
    longest overlap of at least ``min_tokens`` tokens (all of an item that has fewer, or
    fewer than a seed's span) with at least ``similarity`` of them equal.

    Null texts overlap nothing; repeated rows of a document are found under the same id,
    once; empty tables give no rows; other columns are not read.  Short items are hashed
    whole by their length, and only the lengths that the benchmark has are looked for.

    Whole texts.  The first scan hashes the documents' spans; those that pass a bitmap of the
    benchmark's hashes (sized by their number, bounded) are joined with them as numbers
    alone, salted, since a passage may be that of a third of all documents.  What is left
    are the diagonals on which an item lies over a document.  The second scan takes the
    tokens of the documents that have one; a diagonal gets the document's tokens below the
    item, and the item's, once."""
    spark = docs.sparkSession
    least = max(min_tokens, SPAN)
    items = written(bench_items(bench, item_id, item_text), "bench-items")
    seeded = written(bench_seeds(items, least, similarity), "bench-seeds")
    short = sorted(r[0] for r in items.filter(F.col("n_tokens").between(1, least - 1)).select("n_tokens").distinct().collect())  # fewer than ``least``
    bits = spark.sparkContext.broadcast(bitmap(seeded))
    rows = docs.filter(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = rows.select(F.xxhash64("doc_id", "text").alias("dkey"), "doc_id", "text")

    def coded(batches):
        """(rows, their tokens' codes one after another, where each row's end)."""
        known: dict[bytes, int] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                if len(known) * ENTRY_BYTES > MEMO_BYTES:
                    known.clear()
                words = [tokens(t) for t in part.column("text").to_pylist()]
                yield part, codes([w for ws in words for w in ws], known), np.cumsum([len(w) for w in words])

    def hits(batches):
        for part, code, ends in coded(batches):
            keys = part.column("dkey").to_numpy()
            for n in (0, *short):
                h, at = whole_seeds(code, ends, n, similarity) if n else seeds(code, ends)
                hit = bits.value.has(h)
                h, at = h[hit], at[hit]
                if len(h):
                    d = np.searchsorted(ends, at, side="right")
                    first = np.concatenate([[0], ends])[d]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[d]), pa.array(h.astype(np.int64)), pa.array((at - first).astype(np.int32))], names=["dkey", "h", "i"])

    found = _spread_join(rows.select("dkey", "text").mapInArrow(hits, "dkey long, h long, i int"), seeded, "h", ("dkey", "i"), 20 * seeded.count())
    # one hit of a document on an item's diagonal is enough to verify it
    diagonals = written(found.select("dkey", "ikey", (F.col("i") - F.col("j")).alias("shift")).distinct(), "bench-diagonals")
    wanted = spark.sparkContext.broadcast(bitmap(diagonals.select(F.col("dkey").alias("h")).distinct()))

    def take(batches):
        def some(batches):
            for b in batches:
                kept = b.filter(pa.array(wanted.value.has(b.column("dkey").to_numpy().view(np.uint64))))
                if kept.num_rows:
                    yield kept

        for part, code, ends in coded(some(batches)):
            first = 0
            for i, end in enumerate(ends.tolist()):  # a document may be long
                yield pa.RecordBatch.from_arrays([part.column("dkey").slice(i, 1), part.column("doc_id").slice(i, 1), pa.array([code[first:end].astype("<u8").tobytes()], pa.binary())],
                                                 names=["dkey", "doc_id", "tokens"])
                first = end

    def verify(batches):
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                item, window = np.frombuffer(r["code"], "<u8"), np.frombuffer(r["window"], "<u8")
                first, n, equal = longest_alike(window, item, min(r["shift"], 0), similarity)
                if n >= (min_tokens if len(item) >= least else len(item)):
                    out = (r["doc_id"], r["item_id"], max(r["shift"], 0) + first, n, equal)
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=list(FOUND))

    own = rows.mapInArrow(take, "dkey long, doc_id long, tokens binary").dropDuplicates(["dkey"])
    volume = items.agg(F.sum(F.octet_length("code") + 24)).first()[0] or 0
    laid = _spread_join(diagonals, items, "ikey", ("dkey", "shift"), volume).join(own, "dkey")
    below = F.substring("tokens", 8 * F.greatest("shift", F.lit(0)) + 1, 8 * (F.col("n_tokens") + F.least("shift", F.lit(0))).cast("int"))
    seen = laid.select("doc_id", "item_id", "shift", "code", below.alias("window")).mapInArrow(verify, "doc_id long, item_id long, first_token int, n_tokens int, n_equal int")
    best = F.max(F.struct(F.col("n_tokens").alias("n"), F.col("n_equal").alias("e"), (-F.col("first_token")).alias("f")))
    return seen.groupBy("doc_id", "item_id").agg(best.alias("best")).select(
        "doc_id", "item_id", (-F.col("best.f")).alias("first_token"), F.col("best.n").alias("n_tokens"), F.col("best.e").alias("n_equal"))


def documents_with_overlap(found: DataFrame) -> DataFrame:
    """One row for each contaminated document: doc_id, n_items, item_ids (sorted), and the
    longest overlap's tokens and share of equal tokens.  A document's items are at most
    the benchmark's."""
    return found.groupBy("doc_id").agg(
        F.count("*").alias("n_items"), F.array_sort(F.collect_set("item_id")).alias("item_ids"),
        F.max("n_tokens").alias("n_tokens"), F.round(F.max(F.col("n_equal") / F.col("n_tokens")), 6).alias("similarity"))
