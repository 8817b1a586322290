"""Language-model scoring with a probabilistic suffix tree over words.

States are contexts of up to ``DEPTH`` preceding words.  A context is a candidate if it
stands at ``SUPPORT`` training positions or more, however large the corpus; it is
retained if its next-word distribution diverges from that of its longest proper suffix.
A state's distribution is smoothed by its suffix's (Witten-Bell), the root's by one count
for each known word and for an unknown one.  Each token is scored by the longest retained
suffix of what precedes it.

Words and (context, next word) pairs are known by 64-bit hashes: of a billion distinct
ones about 0.03 pairs are expected to collide.  Contexts grow with the corpus as counts
do, so both are written tables that are only ever joined; tasks have a bitmap of bounded
size for each level, which spares rows and decides nothing.

Hashes are shuffled in bulk: the hash range is cut into buckets, of which each holds the
pairs of some ``BUCKET_BYTES`` of text, and a row carries all that a task has for a bucket,
sorted.  Answers come back in the order of their requests and so need no hashes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import LOWER, Bitmap, bitmap, dropped, slices, written

DEPTH = 4
SUPPORT = 32
LEAST_DIVERGENCE = 0.02
#: Text of a block that is scored at once, and of the pairs of a bucket.
BLOCK_BYTES, BUCKET_BYTES = 16 << 20, 12 << 20
#: Scores are found in so many rounds, whose shuffles stand on the disks one at a time.
ROUNDS = 2
#: Distinct pairs that a task holds before it sends them.
HELD_PAIRS = 750_000
#: Settings while a table is written: its shuffle's files go when it is there, Arrow batches
#: are small beside a block, and a task has a file open for each kind of row.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
           "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.maxConcurrentOutputFileWriters": "4"}
END = b""
_ROOT = np.uint64(0x51ED270B2F6A3C19)
#: Tells a context's own row from the row of a word or pair with the same hash.
_STATE = 0x2545F4914F6CDD1D


def mix(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a context (or the root) and a word."""
    x = (context ^ (word * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, ASCII letters lower-cased, and the end."""
    return [*(text or "").encode().translate(LOWER).split(), END]


def stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the texts' distinct words and the end (which is the last), the number of
    each of the texts' ``tokens`` among them, one text after another, and each text's tokens."""
    import xxhash

    found = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = found.flatten().dictionary_encode()
    known = list(words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False))
    hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, [*known, END])), ">u8").astype(np.uint64)
    at = words.indices.to_numpy()
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(found).to_numpy(zero_copy_only=False))
    if b"" in known:  # before leading and after trailing white space
        real = at != known.index(b"")
        at, text = at[real], text[real]
    out = np.full(len(at) + len(texts), len(known), np.int32)
    out[np.arange(len(at)) + text] = at
    return hashes, out, np.bincount(text, minlength=len(texts)) + 1


def first_contexts(hashes: np.ndarray, bits: Bitmap) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the root and each word of a ``stream``, and which may be contexts (each word
    but the end stands before a token)."""
    own = mix(_ROOT, hashes)
    good = bits.has(own)
    good[-1] = False
    return own, good


def contexts(hashes: np.ndarray, at: np.ndarray, levels: list[Bitmap]):
    """For each level (a bitmap of context hashes) the positions in a ``stream`` whose
    preceding words may be such a context, and their context's hash.  Contexts do not reach
    over a text's end."""
    here = held = None
    for d, bits in enumerate(levels, 1):
        if d == 1:
            own, good = first_contexts(hashes, bits)
            here = np.flatnonzero(good[at[:-1]]) + 1
            held = own[at[here - 1]]
        else:
            here, held = here[here >= d], held[here >= d]
            before = at[here - d]
            held = mix(held, hashes[before])
            good = bits.has(held) & (before != len(hashes) - 1)
            here, held = here[good], held[good]
        yield here, held


def _bits(contexts: DataFrame) -> Bitmap:
    return bitmap(contexts, "context")


def _first(keys: np.ndarray) -> np.ndarray:
    """Which of sorted keys differ from the one before."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return new


def _order(keys: np.ndarray) -> np.ndarray:
    """``np.argsort`` of hashes: sorts numbers made of their upper bits and their places, which
    takes half as long, and then mends where lower bits decide."""
    if not len(keys):
        return np.zeros(0, np.int64)
    upper = keys - keys.min()
    upper <<= np.uint64(64 - int(upper.max()).bit_length() if upper.any() else 0)
    low = np.uint64((1 << len(keys).bit_length()) - 1)
    upper &= ~low
    upper |= np.arange(len(keys), dtype=np.uint64)
    upper.sort()
    order = (upper & low).astype(np.int64)
    there = keys[order]
    return order if (there[1:] >= there[:-1]).all() else order[np.argsort(there, kind="stable")]


def _unique(keys: np.ndarray) -> np.ndarray:
    """``np.unique`` by sorting (its table of hashes takes tens of times as long)."""
    keys = np.sort(keys)
    return keys[_first(keys)]


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key, in ascending order, and each key's number among those."""
    order = _order(keys)
    new = _first(keys[order])
    code = np.empty(len(keys), np.int64)
    code[order] = np.cumsum(new) - 1
    return order[new], code


def _sum(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key, in ascending order, and its summed counts."""
    order = _order(keys)
    new = np.flatnonzero(_first(keys[order]))
    return order[new], np.add.reduceat(counts[order], new) if len(new) else counts


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _pack(x: np.ndarray) -> bytes:
    """Numbers of 8 bytes, as planes of their first, second, ... bytes."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpack(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view(np.uint64).reshape(-1)


def _pack_small(x: np.ndarray) -> bytes:
    """``_pack`` without the upper planes that are empty; the first byte tells how many stand."""
    planes = max(1, -(-int(x.view(np.uint64).max(initial=0)).bit_length() // 8))
    return bytes([planes]) + x.view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()


def _unpack_small(x: bytes) -> np.ndarray:
    found = np.frombuffer(x, np.uint8, offset=1).reshape(x[0], -1)
    out = np.zeros((found.shape[1], 8), np.uint8)
    out[:, : x[0]] = found.T
    return out.view(np.uint64).reshape(-1)


def _pack_sorted(x: np.ndarray) -> bytes:
    return _pack_small(np.diff(x, prepend=np.uint64(0)))


def _unpack_sorted(x: bytes) -> np.ndarray:
    return np.cumsum(_unpack_small(x), dtype=np.uint64)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash: equal ranges of their upper halves, in ascending order."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _cuts(bucket: np.ndarray):
    """Each bucket of an ascending column, and where its rows begin and end."""
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, np.int64)
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        yield int(bucket[i]), i, j


#: Counts in bulk: of a bucket the sorted hashes, n and k of each.
COUNTS = "bucket long, keys binary, n binary, k binary"


def _count_rows(keys: np.ndarray, n: np.ndarray, k: np.ndarray, buckets: int) -> list[tuple]:
    """The rows of counts of ascending hashes."""
    return [(b, _pack_sorted(keys[i:j]), _pack_small(n[i:j]), _pack_small(k[i:j])) for b, i, j in _cuts(_bucket(keys, buckets))]


def in_bulk(counts: DataFrame, buckets: int) -> DataFrame:
    """The counts (key, n and k) in bulk."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                keys, n, k = (b.column(c).to_numpy().view(t) for c, t in (("key", np.uint64), ("n", np.int64), ("k", np.int64)))
                order = _order(keys)
                made = _count_rows(keys[order], n[order], k[order], buckets)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], names=["bucket", "keys", "n", "k"])

    return counts.select("key", "n", "k").mapInArrow(run, COUNTS)


def _counted(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes, n and k of a bucket's rows of counts."""
    if not table.num_rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = np.concatenate([_unpack_sorted(x) for x in table.column("keys").to_pylist()])
    n, k = (np.concatenate([_unpack_small(x) for x in table.column(c).to_pylist()]).view(np.int64) for c in ("n", "k"))
    if table.num_rows == 1:
        return keys, n, k
    order = _order(keys)
    return keys[order], n[order], k[order]


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the wanted hashes stand among sorted ones, and whether they do (fastest if
    they are sorted too)."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return place, keys[place] == wanted


def text_parts(df: DataFrame, text: str, part_bytes: int) -> int:
    """Into how many parts of about ``part_bytes`` the texts are cut: two for each core at least."""
    volume = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-volume // part_bytes))


#: Words counted: their number, n in all and counts in bulk of each bucket (0), and the
#: words that are frequent (1).
WORDS = f"kind int, context long, c long, words long, {COUNTS}"


def count_words(texts: DataFrame, buckets: int, enough: float) -> DataFrame:
    """Counts of every word and of the end, and the words (without it) that stand at
    ``enough`` positions; their keys are hashes of the root and the word."""
    def run(batches):
        keys, n, held = [], [], 0

        def merged():
            key, count = np.concatenate(keys), np.concatenate(n)
            at, count = _sum(key, count)
            return key[at], count

        def batch(key, count):
            made = _count_rows(key, count, np.zeros(len(key), np.int64), buckets)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], names=["bucket", "keys", "n", "k"])

        for b in batches:
            for part in slices(b, "text"):
                hashes, at, _ = stream(part.column("text"))
                count = np.bincount(at, minlength=len(hashes))
                seen = count > 0
                keys.append(mix(_ROOT, hashes[seen]))
                n.append(count[seen])
                held += len(keys[-1])
                if held > HELD_PAIRS:
                    key, count = merged()
                    keys, n, held = [key], [count], len(key)
                    if held > HELD_PAIRS // 2:
                        yield batch(key, count)
                        keys, n, held = [], [], 0
        if held:
            yield batch(*merged())

    def merge(table: pa.Table) -> pa.Table:
        import xxhash

        end = mix(_ROOT, np.array([xxhash.xxh64_intdigest(END)], np.uint64))[0]
        keys, n, _ = _counted(table)
        at, n = _sum(keys, n)
        keys = keys[at]
        often = keys[(n >= enough) & (keys != end)]
        (bucket, *bulk), = _count_rows(keys, n, np.zeros(len(n), np.int64), buckets)
        none = [None] * len(often)
        return pa.table([pa.array([0] + [1] * len(often), pa.int32()), pa.concat_arrays([pa.nulls(1, pa.int64()), _signed(often)]), pa.array([int(n.sum()), *none], pa.int64()),
                         pa.array([len(n), *none], pa.int64()), pa.array([bucket, *none], pa.int64()), *(pa.array([x, *none], pa.binary()) for x in bulk)],
                        names=["kind", "context", "c", "words", "bucket", "keys", "n", "k"])

    return texts.mapInArrow(run, COUNTS).groupBy("bucket").applyInArrow(merge, WORDS)


#: Pairs in bulk: of a bucket the words of each context, oldest first; the distinct next
#: words, and of each the number of its pairs; the pairs' contexts (their numbers) and n.
PAIRS = "bucket long, contexts binary, words binary, runs binary, codes binary, n binary"


def _chain(words: list[np.ndarray]) -> np.ndarray:
    """Hash of the contexts of these words, oldest first."""
    held = np.full(1, _ROOT)
    for w in reversed(words):
        held = mix(held, w)
    return held


def _pair_rows(words: list[np.ndarray], n: np.ndarray, buckets: int) -> pa.RecordBatch:
    """The rows of distinct pairs: the words of their contexts and the next word."""
    *before, word = words
    parent = mix(_chain(before[1:]), word)
    order = _order(parent)
    made = []
    for b, i, j in _cuts(_bucket(parent[order], buckets)):
        own = order[i:j]
        own = own[_order(word[own])]
        first = np.flatnonzero(_first(word[own]))
        next_words, runs = word[own][first], np.diff(first, append=len(own))
        at, code = _distinct(_chain([w[own] for w in before]))
        made.append((b, b"".join(_pack(w[own][at]) for w in before), _pack_sorted(next_words), _pack_small(runs), _pack_small(code), _pack(n[own])))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], names=["bucket", "contexts", "words", "runs", "codes", "n"])


def pairs(texts: DataFrame, levels, depth: int, buckets: int) -> DataFrame:
    """The pairs of the contexts of ``depth`` words (a broadcast of bitmaps tells which) and
    their next words, in bulk.  A pair's bucket is that of its parent: the context's suffix
    and the word."""
    def run(batches):
        known = levels.value
        keys, words, n, held = [], [], [], 0

        def merged():
            key, count = np.concatenate(keys), np.concatenate(n)
            at, count = _sum(key, count)
            return key[at], [np.concatenate(w)[at] for w in zip(*words, strict=True)], count

        for b in batches:
            for part in slices(b, "text"):
                hashes, at, _ = stream(part.column("text"))
                word = hashes[at]
                *_, (here, context) = contexts(hashes, at, known)
                key = mix(context, word[here])
                one, count = _sum(key, np.ones(len(key), np.int64))
                keys.append(key[one])
                words.append([word[here[one] - d] for d in range(depth, -1, -1)])
                n.append(count)
                held += len(one)
                if held > HELD_PAIRS:
                    key, columns, count = merged()
                    keys, words, n, held = [key], [columns], [count], len(key)
                    if held > HELD_PAIRS // 2:
                        yield _pair_rows(columns, count, buckets)
                        keys, words, n, held = [], [], [], 0
        if held:
            yield _pair_rows(*merged()[1:], buckets)

    return texts.mapInArrow(run, PAIRS)


def _merged_pairs(table: pa.Table, depth: int):
    """Of a bucket's rows: hash and suffix of each context, its oldest word and the others;
    then of each distinct pair its hash, the number of its context, its next word and n."""
    before, word, code, n, size = [], [], [], [], 0
    for row in table.select(["contexts", "words", "runs", "codes", "n"]).to_pylist():
        step = len(row["contexts"]) // depth
        before.append([_unpack(row["contexts"][i : i + step]) for i in range(0, step * depth, step)])
        word.append(np.repeat(_unpack_sorted(row["words"]), _unpack_small(row["runs"]).view(np.int64)))
        code.append(_unpack_small(row["codes"]).view(np.int64) + size)
        n.append(_unpack(row["n"]).view(np.int64))
        size += step // 8
    columns = [np.concatenate(c) for c in zip(*before, strict=True)]
    context = _chain(columns)
    at, own = _distinct(context)
    word, code = np.concatenate(word), own[np.concatenate(code)]
    key = mix(context[at][code], word)
    columns, context = [c[at] for c in columns], context[at]
    at, n = _sum(key, np.concatenate(n))
    suffix = np.broadcast_to(_chain(columns[1:]), len(context))
    return context, suffix, columns, key[at], code[at], word[at], n


def _longer(columns: list[np.ndarray], code: np.ndarray, word: np.ndarray, levels: list[Bitmap], end: np.uint64):
    """The context that a context and a next word make, one word longer, and whether it can
    be a candidate: its suffixes are.  It stands before a token wherever the word stands
    after the context, so n counts it too."""
    good, held = word != end, mix(_ROOT, word)
    good &= levels[0].has(held)
    for c, bits in zip(reversed(columns[1:]), levels[1:], strict=True):
        held = mix(held, c[code])
        good &= bits.has(held)
    return mix(held, columns[0][code]), good


def count_next(texts: DataFrame, levels: list[Bitmap], longer: bool) -> DataFrame:
    """For the last level's contexts: key (hash of context and next word), context, parent
    (hash of the context's suffix and the word), suffix, n.  With ``longer`` also the context
    that context and word make, one word longer, or null if it cannot be a candidate."""
    held, depth = texts.sparkSession.sparkContext.broadcast(levels), len(levels)
    names = ["key", "context", "parent", "suffix", *["longer"] * longer, "n"]

    def run(table: pa.Table) -> pa.Table:
        import xxhash

        context, suffix, columns, key, code, word, n = _merged_pairs(table, depth)
        made = [*map(_signed, (key, context[code], mix(suffix[code], word), suffix[code]))]
        if longer:
            more, good = _longer(columns, code, word, held.value, np.uint64(xxhash.xxh64_intdigest(END)))
            made.append(pa.array(more.view(np.int64), mask=~good))
        return pa.table([*made, pa.array(n)], names=names)

    found = pairs(texts, held, depth, text_parts(texts, "text", BUCKET_BYTES))
    return found.groupBy("bucket").applyInArrow(run, ", ".join(f"{c} long" for c in names))


#: What a level leaves: of each bucket and context the parts of its sums (0), contexts one
#: word longer that are frequent (1), and its pairs' counts in bulk (2).
LEVEL = f"kind int, context long, suffix long, c long, s double, {COUNTS.replace('k binary', 'k binary, kinds long')}"


def grow(texts: DataFrame, levels: list[Bitmap], below: DataFrame, buckets: int, enough: float | None) -> DataFrame:
    """The last level's pairs counted and set against their parents' counts ``below`` (in
    bulk); longer contexts are told if they stand at ``enough`` positions, if that is given."""
    held, depth = texts.sparkSession.sparkContext.broadcast(levels), len(levels)
    types = dict(kind=pa.int32(), context=pa.int64(), suffix=pa.int64(), c=pa.int64(), s=pa.float64(), bucket=pa.int64(), keys=pa.binary(), n=pa.binary(), k=pa.binary(), kinds=pa.int64())

    def rows(kind: int, size: int, **columns) -> pa.Table:
        columns["kind"] = np.full(size, kind, np.int32)
        return pa.table([pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in types.items()], names=[*types])

    def run(table: pa.Table, known: pa.Table) -> pa.Table:
        import xxhash

        if not table.num_rows:
            return rows(0, 0)
        context, suffix, columns, key, code, word, n = _merged_pairs(table, depth)
        keys, m, _ = _counted(known)
        parent = mix(suffix[code], word)
        order = _order(parent)
        place, there = _find(keys, parent[order])
        own, share = code[order][there], n[order][there]
        parts = share * np.log(share / m[place[there]])
        made = [rows(0, len(context), context=context.view(np.int64), suffix=np.ascontiguousarray(suffix).view(np.int64), c=np.bincount(own, share, len(context)).astype(np.int64),
                     s=np.bincount(own, parts, len(context)), kinds=np.bincount(own, minlength=len(context)))]
        if enough is not None:
            some = np.flatnonzero(n >= enough)
            more, good = _longer(columns, code[some], word[some], held.value, np.uint64(xxhash.xxh64_intdigest(END)))
            made.append(rows(1, int(good.sum()), context=more[good].view(np.int64), c=n[some][good]))
        bulk = [*zip(*_count_rows(key, n, np.zeros(len(n), np.int64), buckets), strict=True)]
        made.append(rows(2, len(bulk[0]), **dict(zip(("bucket", "keys", "n", "k"), map(list, bulk), strict=True))))
        return pa.concat_tables(made)

    found = pairs(texts, held, depth, buckets)
    return found.groupBy("bucket").cogroup(below.groupBy("bucket")).applyInArrow(run, LEVEL)


def _written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``written`` with the settings of ``WRITING``; with ``by`` a folder for each value."""
    conf = df.sparkSession.conf
    before = {key: conf.get(key, None) for key in WRITING}
    for key, value in WRITING.items():
        conf.set(key, value)
    try:
        return written(df, name, by)
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)


def train(docs: DataFrame, text: str = "text", depth: int = DEPTH, support: int = SUPPORT, p_min: float | None = None, least: float = LEAST_DIVERGENCE) -> dict:
    """The tree of the texts of ``docs``: counts (in bulk: n of each word and pair, n and the
    number of next words k of each retained context), total N, distinct V, and for each level
    a written frame of the retained contexts.  A candidate stands at ``support`` positions or
    more, or if ``p_min`` is given at that share of all.  Null texts are empty; an empty
    table gives N = V = 0 and no context."""
    texts = docs.select(F.col(f"`{text}`").cast("string").alias("text"))
    buckets = text_parts(texts, "text", BUCKET_BYTES)
    total = None
    if p_min is not None:
        total = _written(count_words(texts, buckets, float("inf")), "pst-words").agg(F.sum("c")).first()[0] or 0
    enough = max(2.0, support if p_min is None else p_min * total)
    counts = _written(count_words(texts, buckets, enough), "pst-words")
    total, distinct = (int(x or 0) for x in counts.agg(F.sum("c"), F.sum("words")).first())
    # level 1: a context's hash is that of the root and the word, as is a word's key
    frequent = counts.filter("kind = 1").select("context")
    root = int(np.array([_ROOT]).view(np.int64)[0])
    shorter = docs.sparkSession.createDataFrame([(root, total)], "context long, c long")
    below = counts.filter("kind = 0").select("bucket", "keys", "n", "k")
    levels: list[Bitmap] = []
    candidates: list[DataFrame] = []
    grams: list[DataFrame] = []
    frames = below
    while len(levels) < depth and not frequent.isEmpty():
        levels.append(_bits(frequent))
        own = _written(grow(texts, levels, below, buckets, enough if len(levels) < depth else None), "pst-next", by="kind")
        sums = own.filter("kind = 0").groupBy("context", "suffix").agg(F.sum("c").alias("c"), F.sum("kinds").alias("k"), F.sum("s").alias("s"))
        # the bitmap's strangers go here: what is no candidate
        sums = sums.join(frequent, "context", "left_semi")
        sums = sums.join(shorter.select(F.col("context").alias("suffix"), F.col("c").alias("all")), "suffix")
        gain = F.col("s") / F.col("c") + F.log(F.col("all") / F.col("c")) - (F.col("k") - 1) / (2 * F.col("c"))
        candidates.append(_written(sums.select("context", "suffix", "c", "k", gain.alias("gain")), "pst-contexts"))
        dropped(own, "kind", 0)  # summed up
        below, shorter = own.filter("kind = 2").select("bucket", "keys", "n", "k"), candidates[-1]
        grams.append(below)
        # its suffix and its words but the last are candidates, as they stand wherever it does
        frequent = own.filter("kind = 1").select("context")
    kept: list[DataFrame] = []
    needed = None
    for known in reversed(candidates):  # a retained context's suffixes are states too
        held = known.filter(F.col("gain") >= least)
        if needed is not None:
            held = held.unionByName(known.filter(F.col("gain") < least).join(needed, "context", "left_semi"))
        held = _written(held, "pst-states")
        if kept or not held.isEmpty():
            kept.insert(0, held)
            needed = held.select(F.col("suffix").alias("context")).distinct()
    for held, own in zip(kept, grams, strict=False):
        frames = frames.unionByName(own)
        frames = frames.unionByName(in_bulk(held.select(F.col("context").bitwiseXOR(F.lit(_STATE)).alias("key"), F.col("c").alias("n"), "k"), buckets))
    return {"counts": frames, "N": total, "V": distinct, "levels": kept, "buckets": buckets}


def score(docs: DataFrame, model: dict, keep: dict[str, str] | None = None, text: str = "text", block_bytes: int = BLOCK_BYTES, rounds: int = ROUNDS) -> DataFrame:
    """The columns of ``keep`` (doc_id by default), n_tokens (with the end), n_known (tokens
    that training has), base_score and score (log10 probabilities of the text, of the
    root's distribution alone and of the tree).

    A null text is an empty one: its only token is the end.  Documents are dealt into
    blocks by a hash of their text and kept columns; a block asks each bucket of the model
    for the distinct words, contexts and (context, next word) in it, sorted, and is answered
    in their order.  The blocks are dealt into ``rounds``, and each round's rows are written."""
    spark = docs.sparkSession
    keep = keep or {"doc_id": "doc_id"}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in keep.items()], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__llm_text"))
    buckets = model["buckets"]
    blocks = max(text_parts(rows, "__llm_text", block_bytes), rounds * spark.sparkContext.defaultParallelism)
    rows = rows.withColumn("__llm_block", F.pmod(F.xxhash64(*rows.columns), F.lit(blocks)))
    levels = [_bits(x) for x in model["levels"]]
    held = spark.sparkContext.broadcast((levels, model["N"], model["V"]))

    def pieces(table: pa.Table):
        for b in table.select([n for n in table.column_names if n != "__llm_block"]).to_batches(max_chunksize=4096):
            for part in slices(b, "__llm_text"):
                yield part, *stream(part.column("__llm_text"))

    def requests(parts) -> np.ndarray:
        known, grams, fresh = held.value[0], [], 0
        for _, hashes, at, _ in parts:
            new, word = [mix(_ROOT, hashes)], hashes[at]
            for d, (p, c) in enumerate(contexts(hashes, at, known)):
                new.append(_unique(mix(c, word[p])))
                new.append((_unique(c) if d else new[0][first_contexts(hashes, known[0])[1]]) ^ np.uint64(_STATE))
            grams += new
            fresh += sum(map(len, new))
            if fresh > HELD_PAIRS:
                grams, fresh = [_unique(np.concatenate(grams))], 0
        return _unique(np.concatenate(grams))

    def ask(table: pa.Table) -> pa.Table:
        keys, block = requests(pieces(table)), table.column("__llm_block")[0].as_py()
        made = [(block, b, _pack_sorted(keys[i:j])) for b, i, j in _cuts(_bucket(keys, buckets))]
        return pa.table([pa.array(c) for c in zip(*made, strict=True)], names=["__llm_block", "bucket", "keys"])

    def reply(wanted: pa.Table, counts: pa.Table) -> pa.Table:
        keys, n, k = _counted(counts)
        made = []
        for x in wanted.column("keys"):
            place, there = _find(keys, _unpack_sorted(x.as_py()))
            made.append([_pack_small(np.where(there, c[place], 0) if len(keys) else np.zeros(len(place), np.int64)) for c in (n, k)])
        answers = [pa.array([m[i] for m in made], pa.binary()) for i in (0, 1)]
        return pa.table([wanted.column("__llm_block"), wanted.column("bucket"), *answers], names=["__llm_block", "bucket", "n", "k"])

    schema = [f for f in rows.schema.fields if f.name in keep]
    result = StructType([*schema, StructField("n_tokens", LongType()), StructField("n_known", LongType()), StructField("base_score", DoubleType()), StructField("score", DoubleType())])
    arrow = to_arrow_schema(result)

    def answer(table: pa.Table, answers: pa.Table) -> pa.Table:
        known, total, distinct = held.value
        parts = list(pieces(table))
        keys = requests(parts)
        order = np.argsort(answers.column("bucket").to_numpy())
        counts, kinds_of = (np.concatenate([_unpack_small(x.as_py()) for x in answers.column(c).take(order)]).view(np.int64) for c in ("n", "k"))

        def states(context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            place = np.searchsorted(keys, context ^ np.uint64(_STATE))
            return counts[place], kinds_of[place]

        made = []
        for part, hashes, at, sizes in parts:
            own = mix(_ROOT, hashes)
            one, code = _distinct(own)
            word, n = hashes[at], counts[np.searchsorted(keys, own[one])][code][at]
            root = (n + 1) / (total + distinct + 1)
            p = root.copy()
            for d, (here, context) in enumerate(contexts(hashes, at, known)):
                if d:
                    one, code = _distinct(context)
                    c, kinds = (x[code] for x in states(context[one]))
                else:  # the word before it
                    good = first_contexts(hashes, known[0])[1][one]
                    of_word = np.zeros((2, len(one)), np.int64)
                    of_word[:, good] = states(own[one][good])
                    c, kinds = of_word[:, code[at[here - 1]]]
                state = c > 0
                here, context, c, kinds = here[state], context[state], c[state], kinds[state]
                pair = mix(context, word[here])
                one, code = _distinct(pair)
                seen = counts[np.searchsorted(keys, pair[one])][code]
                p[here] = (seen + kinds * p[here]) / (c + kinds)
            first = np.cumsum(sizes) - sizes
            made.append(pa.RecordBatch.from_arrays(
                [*(part.column(f.name) for f in schema), pa.array(sizes), pa.array(np.add.reduceat((n > 0).astype(np.int64), first)),
                 pa.array(np.add.reduceat(np.log10(root), first)), pa.array(np.add.reduceat(np.log10(p), first))],
                schema=arrow))
        return pa.Table.from_batches(made, schema=arrow)

    made = []
    for i in range(rounds):
        some = rows.filter(F.col("__llm_block") % rounds == i)
        wanted = some.groupBy("__llm_block").applyInArrow(ask, "__llm_block long, bucket long, keys binary")
        found = wanted.groupBy("bucket").cogroup(model["counts"].groupBy("bucket")).applyInArrow(reply, "__llm_block long, bucket long, n binary, k binary")
        scored = some.groupBy("__llm_block").cogroup(found.groupBy("__llm_block")).applyInArrow(answer, result)
        made.append(_written(scored, "pst-scores"))
    return reduce(DataFrame.unionByName, made)
