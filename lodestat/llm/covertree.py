"""Exact largest inner products by dual-tree search over cover trees.

Queries and data are indexed by cover trees, block by block.  A pair of nodes is pruned
when no inner product between them, bounded by the nodes' centres and covering radii,
can reach the worst k-th score that the queries of the query node have so far.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAF, CHILDREN = 128, 32
DATA_BLOCK, QUERY_BLOCK = 16_384, 4_096
#: Below every score; its negative is an integer too.
NONE = -np.iinfo(np.int64).max


class Node:
    """Points ``at`` within ``radius`` of ``center``; children cover them at a smaller radius."""

    __slots__ = ("at", "center", "radius", "norm", "children")

    def __init__(self, points: np.ndarray, at: np.ndarray, center: int):
        self.at, self.center = at, points[center]
        self.radius = float(np.sqrt(((points[at] - self.center) ** 2).sum(1).max()))
        self.norm = float(np.linalg.norm(self.center))
        self.children: list[Node] = []


def build(points: np.ndarray) -> Node:
    """A cover tree: a node's children are centred on points of it that are chosen
    farthest first, so centres are at least as far apart as the radius at which they
    cover the node, until that is half the node's or ``CHILDREN`` are chosen.  Nodes of
    up to ``LEAF`` points, or of equal points, are leaves."""
    root = Node(points, np.arange(len(points)), 0)
    open_nodes = [root]
    while open_nodes:
        node = open_nodes.pop()
        if len(node.at) <= LEAF or node.radius == 0:
            continue
        own = points[node.at]
        far = ((own - node.center) ** 2).sum(1)
        chosen = [int(far.argmin())]
        nearest = np.zeros(len(own), np.int64)
        while len(chosen) < CHILDREN and far.max() > (node.radius / 2) ** 2:
            chosen.append(int(far.argmax()))
            d = ((own - own[chosen[-1]]) ** 2).sum(1)
            nearest[d < far] = len(chosen) - 1
            far = np.minimum(far, d)
        if len(chosen) == 1:
            continue
        for i, c in enumerate(chosen):
            if len(members := node.at[nearest == i]):
                node.children.append(Node(points, members, int(node.at[c])))
        open_nodes += node.children
    return root


def dual_search(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int):
    """Of each query the k largest inner products with rows of another id, ties to the
    smaller id: (scores, ids), padded with NONE.  Integers; the products are exact
    in floating point where they stay below 2**53, else 64-bit integers are multiplied."""
    exact = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * queries.shape[1] < 2**53
    left, right = queries.astype(float), data.astype(float)
    score = np.full((len(queries), k), NONE)
    found = np.zeros((len(queries), k), np.int64)
    missing = np.iinfo(np.int64).max

    def bound(q: Node, d: Node) -> float:
        return (float(q.center @ d.center) + q.norm * d.radius + d.norm * q.radius + q.radius * d.radius) * (1 + 1e-9) + 1 \
            if q.radius or d.radius else float("inf")

    def scan(q: Node, d: Node):
        a, b = q.at, d.at
        s = np.rint(left[a] @ right[b].T).astype(np.int64) if exact else queries[a] @ data[b].T
        ids = np.broadcast_to(data_ids[b], s.shape)
        own = ids == query_ids[a][:, None]
        ids = np.concatenate([np.where(score[a] == NONE, missing, found[a]), np.where(own, missing, ids)], 1)
        s = np.concatenate([score[a], np.where(own, NONE, s)], 1)
        # only columns that reach a row's k-th score can stay; then ties by id
        kth = -np.partition(-s, k - 1, axis=1)[:, k - 1]
        keep = np.flatnonzero((s >= kth[:, None]).any(0))
        s, ids = s[:, keep], ids[:, keep]
        order = np.lexsort((ids, -s), axis=1)[:, :k]
        score[a], found[a] = np.take_along_axis(s, order, 1), np.take_along_axis(ids, order, 1)

    if not len(queries) or not len(data):
        return score, found
    stack = [(float("inf"), build(left), build(right))]
    while stack:
        most, q, d = stack.pop()
        if most < score[q.at, k - 1].min():
            continue
        if not q.children and not d.children:
            scan(q, d)
            continue
        # the wider node is opened; the most promising pair is taken first
        if not d.children or q.children and q.radius > d.radius:
            pairs = [(c, d) for c in q.children]
        else:
            pairs = [(q, c) for c in d.children]
        stack += sorted(((bound(x, y), x, y) for x, y in pairs), key=lambda p: p[0])
    return score, found


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: for every row whose id is divisible by ``every``, its k
    largest integer inner products with rows of other ids over floor(scale * component);
    ties to the smaller id; fewer rows: all of them.

    Rows with a null id, a null vector, or a null or non-finite component take no part;
    only vectors of one dimension are compared; rows that repeat an id are candidates of
    their own.  The query set meets all rows in tiles (a block of queries and a block of
    data), each searched by two trees in one task; a tile's rows are bounded, and each
    tile sends k rows for each of its queries on."""
    x = F.col(f"`{embedding}`")
    finite = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf")))
    rows = vectors.filter(F.col(f"`{vec_id}`").isNotNull() & finite).select(
        F.col(f"`{vec_id}`").cast("long").alias("id"), F.transform(x, lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("long")).alias("v"))
    query = F.pmod("id", F.lit(every)) == 0
    n, asked = rows.agg(F.count("*"), F.count_if(query)).first()
    spark = vectors.sparkSession
    data_blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // DATA_BLOCK))
    query_blocks = max(1, -(-asked // QUERY_BLOCK))
    block = lambda salt, m: F.pmod(F.xxhash64("id", "v", F.lit(salt)), F.lit(m))
    every_block = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    tile = (F.col("q") * data_blocks + F.col("d")).alias("tile")
    data = rows.withColumn("d", block(0, data_blocks)).withColumn("q", every_block(query_blocks)).select(tile, "id", "v")
    asking = rows.filter(query).withColumn("q", block(1, query_blocks)).withColumn("d", every_block(data_blocks)).select(tile, "id", "v")

    def search(d: pa.Table, q: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        sizes = [np.diff(t.column("v").combine_chunks().offsets.to_numpy()) for t in (d, q)]
        for dim in np.unique(sizes[1]) if len(d) else ():
            ids, points = [], []
            for t, s in zip((d, q), sizes, strict=True):
                own = t.filter(pa.array(s == dim))
                ids.append(own.column("id").to_numpy())
                points.append(own.column("v").combine_chunks().flatten().to_numpy().reshape(len(own), dim))
            score, found = dual_search(points[1], ids[1], points[0], ids[0], k)
            at, place = np.nonzero(score > NONE)
            out["query_id"].append(ids[1][at])
            out["vec_id"].append(found[at, place])
            out["score"].append(score[at, place])
        return pa.table({c: np.concatenate([*v, np.zeros(0, np.int64)]).astype(np.int64) for c, v in out.items()})

    found = data.groupBy("tile").cogroup(asking.groupBy("tile")).applyInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOP_K_SQL = """
WITH rows AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(CAST(x AS DOUBLE))]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM rows q JOIN rows c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
