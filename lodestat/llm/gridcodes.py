"""Vector codes from trained codebooks, with nearest entries found through grid cells.

A vector is cut into consecutive parts; each part is coded by the nearest of up to 256
entries of its place's codebook.  To find them, a task hashes each part's coarse grid cell.
The first time that a cell is met, the entries that can be nearest to any point of its box
are worked out from their least and greatest distances to the box: an entry whose least
distance passes another's greatest is dominated.  The rest are remembered for the cell, and
only they are compared exactly.  All arithmetic is on integers.

Codebooks are refined in rounds.  A round is one pass: tasks sum the parts of each entry,
and the sums are added up; only the codebooks, of fixed size, reach the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Remembered cells of a task, in bytes of their keys and entries.
MEMO_BYTES = 32 << 20
#: Components beyond this would let sums of squares pass 64 bits in a part of 2^15 components.
LARGEST = 1 << 23
#: Positions of an entry that one row of sums holds, and cells or pairs worked on at once.
CHUNK, CELLS, PAIRS = 64, 2048, 1 << 17
SALTS = 16


class NearestEntries:
    """Finds the nearest entry of one codebook (ties to the lower index) for many parts."""

    def __init__(self, entries: np.ndarray, limit: int = MEMO_BYTES):
        self.entries, self.limit = entries.astype(np.int64), limit
        spread = self.entries.std() if self.entries.size else 0.0
        # a cell is a power of two wide, at most half of what the entries spread
        self.shift = max(0, int(np.log2(max(1.0, spread / 2))))
        self.memo: dict[bytes, np.ndarray] = {}
        self.held = 0

    def candidates(self, cells: np.ndarray) -> np.ndarray:
        """A flag for each cell and entry that no other entry dominates across the cell."""
        near, far = (np.zeros((len(cells), len(self.entries)), np.int64) for _ in range(2))
        for k in range(cells.shape[1]):
            # both distances depend on the cell's place along k alone: a row for each place
            place, row = np.unique(cells[:, k], return_inverse=True)
            e = self.entries[:, k][None, :]
            a, b = (place << self.shift)[:, None], ((place + 1) << self.shift)[:, None] - 1
            gap = np.maximum(np.maximum(a - e, e - b), 0)
            near += (gap * gap)[row]
            far += (np.maximum(np.abs(e - a), np.abs(e - b)) ** 2)[row]
        return near <= far.min(axis=1, keepdims=True)

    def __call__(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each part's entry and its squared distance."""
        n = len(parts)
        if not parts.shape[1]:
            return np.zeros(n, np.int64), np.zeros(n, np.int64)
        if self.held > self.limit:
            self.memo.clear()
            self.held = 0
        cells = np.ascontiguousarray(parts >> self.shift)
        keys = cells.view(np.dtype((np.void, cells.dtype.itemsize * cells.shape[1]))).ravel()
        unique, first, cell = np.unique(keys, return_index=True, return_inverse=True)
        names = [k.tobytes() for k in unique]
        new = [i for i, k in enumerate(names) if k not in self.memo]
        for i in range(0, len(new), CELLS):
            some = new[i : i + CELLS]
            for j, flags in zip(some, self.candidates(cells[first[some]]), strict=True):
                self.memo[names[j]] = found = np.flatnonzero(flags).astype(np.uint8)
                self.held += len(found) + len(names[j]) + 200
        own = [self.memo[k] for k in names]
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        flat, start = np.concatenate(own), np.cumsum(sizes) - sizes
        out, error = np.zeros(n, np.int64), np.zeros(n, np.int64)
        ends = np.cumsum(sizes[cell])
        at = 0
        while at < n:  # pairs of parts and entries, a bounded number at once
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
            size, begin = sizes[cell[at:upto]], start[cell[at:upto]]
            first_pair = np.cumsum(size) - size
            pick = flat[np.repeat(begin - first_pair, size) + np.arange(int(size.sum()))]
            apart = np.repeat(parts[at:upto], size, axis=0) - self.entries[pick]
            distance = np.einsum("ij,ij->i", apart, apart)
            least = np.minimum.reduceat(distance, first_pair)
            # entries of a cell are in ascending order: the first that is as near
            nearest = np.where(distance == np.repeat(least, size), pick.astype(np.int64), ENTRIES)
            out[at:upto], error[at:upto] = np.minimum.reduceat(nearest, first_pair), least
            at = upto
        return out, error


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is not null and holds no null or non-finite component."""
    v = F.col(f"`{vector}`")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.filter(v.isNotNull() & ~F.coalesce(F.exists(v, bad), F.lit(False)))


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """The vectors of an Arrow list column as integers floor(scale * x)."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths != (lengths[0] if width is None else width)).any():
        raise ValueError("vectors differ in their number of components")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    made = np.floor(SCALE * flat)
    if len(made) and np.abs(made).max() > LARGEST:
        raise ValueError(f"a component is larger than {LARGEST // SCALE}")
    return made.astype(np.int64).reshape(len(lengths), -1 if len(lengths) and lengths[0] else 0)


def _nearest(books: list[np.ndarray], rows: np.ndarray, finders: list[NearestEntries]) -> tuple[np.ndarray, np.ndarray]:
    width = rows.shape[1] // len(books)
    found = [f(np.ascontiguousarray(rows[:, p * width : (p + 1) * width])) for p, f in enumerate(finders)]
    return np.stack([c for c, _ in found], 1), np.stack([e for _, e in found], 1)


def train(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks, one array of entries for each part position.

    They start as the parts of the ``entries`` rows of smallest id (null last; rows of one
    id in order of their vector); fewer rows give fewer entries, none give empty ones.  Each
    round assigns every part to its nearest entry and replaces each entry by the floor of
    its parts' mean; an entry without parts stays."""
    spark = rows.sparkSession
    kept = usable(rows, vector).select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").toArrow()
    start = matrix(first.column("v").combine_chunks())
    width, rest = divmod(start.shape[1], parts)
    if rest:
        raise ValueError(f"{start.shape[1]} components are not {parts} equal parts")
    books = [start[:, p * width : (p + 1) * width] for p in range(parts)]
    sums = ", ".join(["part int", "entry int", "chunk int", "n long", *(f"s{i} long" for i in range(CHUNK))])
    names = [c.split()[0] for c in sums.split(", ")]
    for _ in range(rounds if len(start) else 0):
        shared = spark.sparkContext.broadcast(books)

        def run(batches, shared=shared):
            books = shared.value
            finders = [NearestEntries(b) for b in books]
            total, count = np.zeros((parts, len(books[0]), width), np.int64), np.zeros((parts, len(books[0])), np.int64)
            for b in batches:
                x = matrix(b.column("v"), parts * width)
                code, _ = _nearest(books, x, finders)
                for p in range(parts):
                    order = np.argsort(code[:, p], kind="stable")
                    entry = code[order, p]
                    at = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]])) if len(entry) else np.zeros(0, np.int64)
                    if len(at):
                        total[p, entry[at]] += np.add.reduceat(x[order, p * width : (p + 1) * width], at, axis=0)
                        count[p] += np.bincount(entry, minlength=count.shape[1])
            where = np.argwhere(count)
            for c in range(0, max(1, width), CHUNK):
                own = total[where[:, 0], where[:, 1], c : c + CHUNK]
                wide = np.zeros((len(where), CHUNK), np.int64)
                wide[:, : own.shape[1]] = own
                yield pa.RecordBatch.from_arrays(
                    [pa.array(where[:, 0].astype(np.int32)), pa.array(where[:, 1].astype(np.int32)), pa.array(np.full(len(where), c // CHUNK, np.int32)),
                     pa.array(count[where[:, 0], where[:, 1]]), *(pa.array(wide[:, i]) for i in range(CHUNK))], names=names)

        made = kept.select("v").mapInArrow(run, sums).groupBy("part", "entry", "chunk").agg(*[F.sum(c).alias(c) for c in names[3:]]).toArrow()
        books = [b.copy() for b in books]
        table = np.stack([made.column(c).to_numpy() for c in names], 1) if made.num_rows else np.zeros((0, len(names)), np.int64)
        for p, e, c, n, *s in table.tolist():
            size = min(CHUNK, width - c * CHUNK)
            books[p][e, c * CHUNK : c * CHUNK + size] = [x // n for x in s[:size]]
        shared.unpersist()
    return books


def codebooks_text(books: list[np.ndarray]) -> str:
    """All entries' components by part, entry and position, joined by commas."""
    return ",".join(str(x) for b in books for x in b.ravel().tolist())


def encode(rows: DataFrame, books: list[np.ndarray], keep: dict[str, str] | None = None, vector: str = "embedding") -> DataFrame:
    """The columns of ``keep`` (vec_id by default), codes (binary, one byte for each part)
    and error (the sum of the parts' squared distances) of every usable row.

    Rows whose vector is null or has a null or non-finite component are left out; repeated
    rows stay; vectors of another length than the codebooks', or with a component beyond
    8192, are an error.  Other columns are not read."""
    spark = rows.sparkSession
    keep = keep or {"vec_id": "vec_id"}
    picked = usable(rows, vector).select(*[F.col(f"`{c}`").alias(n) for n, c in keep.items()], F.col(f"`{vector}`").cast("array<double>").alias("__llm_vector"))
    shared = spark.sparkContext.broadcast(books)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]), "codes binary", "error long"])
    names = [*keep, "codes", "error"]

    def run(batches):
        books = shared.value
        finders = [NearestEntries(b) for b in books]
        for b in batches:
            x = matrix(b.column("__llm_vector"), sum(k.shape[1] for k in books))
            code, error = _nearest(books, x, finders)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([c.tobytes() for c in code.astype(np.uint8)], pa.binary()), pa.array(error.sum(1))], names=names)

    return picked.mapInArrow(run, schema)


def decode(codes: bytes, books: list[np.ndarray]) -> list[int]:
    """The vector (in integers) that a code stands for."""
    return [x for c, b in zip(codes, books, strict=True) for x in b[c].tolist()]


def vector_codes(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code (two hex digits for each part), error, label_error (error summed over the
    rows of the same label, null being one) and codebooks_sha256; see ``train`` and ``encode``.
    An empty table gives no rows."""
    books = train(rows, vec_id, vector)
    made = written(encode(rows, books, {"vec_id": vec_id, "label": label}, vector), "vector-codes")
    sums = made.groupBy("label").agg(F.sum("error").alias("label_error"))
    # a label may be that of a third of all rows: its sum is copied, its rows are dealt out
    copies = sums.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    rows = made.withColumn("salt", F.pmod(F.xxhash64("vec_id", "codes"), F.lit(SALTS)))
    same = rows["label"].eqNullSafe(copies["label"]) & (rows["salt"] == copies["salt"])
    digest = hashlib.sha256(codebooks_text(books).encode()).hexdigest()
    return rows.join(copies, same).select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _codes_sql() -> str:
    """DuckDB: the rounds unrolled, every part compared with every entry."""
    step = """
a{0} AS MATERIALIZED (SELECT id, p, v, arg_min(e, d * 256 + e) AS e, min(d) AS d FROM (
  SELECT x.id, x.p, x.v, b.e, list_sum([(x.v[i] - b.v[i]) * (x.v[i] - b.v[i]) FOR i IN range(1, len(x.v) + 1)])::BIGINT AS d
  FROM parts x JOIN b{0} b ON b.p = x.p) GROUP BY id, p, v)"""
    move = """
m{0} AS (SELECT p, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS v FROM (
  SELECT p, e, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{0}, (SELECT unnest(range(1, 1 + (SELECT max(len(v)) FROM parts))) AS i) GROUP BY p, e, i) GROUP BY p, e),
b{1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{0} b LEFT JOIN m{0} m ON m.p = b.p AND m.e = b.e)"""
    steps = ",".join(x for k in range(ROUNDS) for x in (step.format(k), move.format(k, k + 1)))
    return f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS id, vec_id, label,
    [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
parts AS MATERIALIZED (SELECT id, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS v FROM kept, (SELECT unnest(range({PARTS})) AS p)),
b0 AS (SELECT p, id AS e, v FROM parts WHERE id < {ENTRIES}),{steps},{step.format(ROUNDS)},
codes AS (SELECT id, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY id),
book AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS h FROM b{ROUNDS}),
rows_ AS (SELECT k.vec_id, k.label, c.code, c.error FROM kept k JOIN codes c ON c.id = k.id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT h FROM book) AS codebooks_sha256 FROM rows_
"""


CODES_SQL = _codes_sql()
