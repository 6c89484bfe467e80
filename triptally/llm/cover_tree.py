"""Exact top-k inner products by a dual-tree search over cover trees.

Queries and candidates are dealt into blocks of bounded size, a cover tree is built for each, and
every pair of a query block and a candidate block is searched by walking both trees together. All
scores are whole numbers and exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024  # vectors of a block
LEAF = 24  # a node of fewer points is not divided
EXACT = float(1 << 53)  # whole numbers below are exact in a double


@dataclass
class Node:
    """Points order[lo:hi] of a tree; center is one of them, radius reaches all."""

    lo: int
    hi: int
    center: np.ndarray
    norm: float
    radius: float
    children: list[Node]


class CoverTree:
    """A cover tree: the children of a node of radius r have centres more than r/2 apart, and every
    point of the node is within r/2 of its child's centre."""

    def __init__(self, points: np.ndarray):
        self.points = points.astype(np.float64)
        self.order = np.arange(len(points))
        self.root = self._grow(0, len(points)) if len(points) else None

    def _grow(self, lo: int, hi: int) -> Node:
        own = self.order[lo:hi]
        center = self.points[own[0]]
        far = np.sqrt(((self.points[own] - center) ** 2).sum(1))
        radius = float(far.max())
        node = Node(lo, hi, center, float(np.sqrt((center**2).sum())), radius, [])
        if hi - lo <= LEAF or radius == 0.0:
            return node
        reach, rest = radius / 2, np.arange(hi - lo)
        groups = []
        while len(rest):
            start = self.points[own[rest[0]]]
            near = ((self.points[own[rest]] - start) ** 2).sum(1) <= reach * reach
            groups.append(own[rest[near]])
            rest = rest[~near]
        if len(groups) > max(2, (hi - lo) // 4):
            return node  # almost every point stands alone: dividing would save nothing
        at = lo
        for group in groups:
            self.order[at : at + len(group)] = group
            node.children.append(self._grow(at, at + len(group)))
            at += len(group)
        return node


class Search:
    """The k best candidates of each query of one block among one block of candidates."""

    def __init__(self, queries: CoverTree, q_ids: np.ndarray, data: CoverTree, ids: np.ndarray, k: int):
        self.queries, self.data, self.k = queries, data, k
        self.q_ids, self.ids = q_ids[queries.order], ids[data.order]
        self.q_points, self.points = queries.points[queries.order], data.points[data.order]
        n = len(q_ids)
        self.scores = np.full((n, k), -np.inf)
        self.found = np.full((n, k), np.iinfo(np.int64).max)
        self.worst = np.full(n, -np.inf)  # the kth best score so far, which a node pair must reach
        size = float(np.abs(self.points).max(initial=0)) * float(np.abs(self.q_points).max(initial=0))
        if size * self.points.shape[1] >= EXACT:
            raise ValueError("scores must be below 2**53 to be exact")
        if queries.root and data.root:
            self._walk(queries.root, data.root)

    def _bound(self, q: Node, p: Node) -> float:
        """No inner product of a point below q and one below p is larger."""
        exact = float(q.center @ p.center)
        more = q.radius * p.norm + p.radius * q.norm + q.radius * p.radius
        return exact + more * (1 + 1e-9) + 1e-6

    def _walk(self, q: Node, p: Node) -> None:
        if self._bound(q, p) < self.worst[q.lo : q.hi].min():
            return
        if not q.children and not p.children:
            self._compare(q, p)
            return
        if q.children and (not p.children or q.radius >= p.radius):
            for child in q.children:
                self._walk(child, p)
            return
        # Candidates that may score highest first, so that the others are pruned.
        for child in sorted(p.children, key=lambda c: -self._bound(q, c)):
            self._walk(q, child)

    def _compare(self, q: Node, p: Node) -> None:
        scores = self.q_points[q.lo : q.hi] @ self.points[p.lo : p.hi].T
        ids = np.broadcast_to(self.ids[p.lo : p.hi], scores.shape)
        own = self.q_ids[q.lo : q.hi, None] == ids
        scores = np.where(own, -np.inf, scores)
        scores = np.concatenate([self.scores[q.lo : q.hi], scores], axis=1)
        ids = np.concatenate([self.found[q.lo : q.hi], np.where(own, np.iinfo(np.int64).max, ids)], axis=1)
        order = np.lexsort((ids, -scores), axis=1)[:, : self.k]
        self.scores[q.lo : q.hi] = np.take_along_axis(scores, order, 1)
        self.found[q.lo : q.hi] = np.take_along_axis(ids, order, 1)
        self.worst[q.lo : q.hi] = self.scores[q.lo : q.hi, self.k - 1]

    def results(self) -> Iterator[tuple[int, int, int]]:
        for i in range(len(self.q_ids)):
            for score, id_ in zip(self.scores[i], self.found[i], strict=True):
                if score > -np.inf:
                    yield int(self.q_ids[i]), int(id_), int(score)


def whole_vectors(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(id, dim, v): floor(scale * x) of each component as double. Rows without an id, and vectors
    that are null, empty or hold null or non-finite components, are left out."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    rows = vectors.where(
        F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & finite
    )
    whole = F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))
    return rows.select(F.col(key).cast("long").alias("id"), F.size(vector).alias("dim"), whole.alias("v"))


def _blocks(rows: DataFrame, n: int) -> DataFrame:
    """(dim, block, ids, points): rows of one length dealt into n blocks, packed as bytes."""

    def run(key, table):
        dim = key[0].as_py()
        flat = table.column("v").combine_chunks()
        flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
        points = flat.flatten().to_numpy().reshape(-1, dim)
        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        return pa.table({
            "dim": pa.array([dim], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()),
            "ids": pa.array([ids[order].tobytes()], pa.binary()),
            "points": pa.array([points[order].tobytes()], pa.binary()),
        })

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    return dealt.groupBy("dim", "block").applyInArrow(
        run, "dim int, block int, ids binary, points binary"
    )


def _unpack(ids: bytes, points: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(points, np.float64).reshape(-1, dim)


def top_k(
    queries: DataFrame, candidates: DataFrame, key: str = "vec_id", vector: str = "embedding",
    k: int = 5, scale: int = 256,
) -> DataFrame:
    """(query_id, rank, key, score): the k candidates of the highest inner product for each query, all
    if there are fewer; ties go to the smaller key. A query is no candidate of its own.

    Vectors are floor(scale * x) per component and are compared with those of their own length. Both
    sides are dealt into blocks of about `BLOCK` vectors; each pair of blocks is one search in one
    task, whatever the number of vectors or equal vectors. A repeated key counts for each of its rows.
    """
    q = whole_vectors(queries, key, vector, scale)
    c = whole_vectors(candidates, key, vector, scale)
    n_q, n_c = (max(1, -(-frame.count() // BLOCK)) for frame in (q, c))
    q_blocks = _blocks(q, n_q).select(
        F.col("dim").alias("q_dim"), F.col("block").alias("q_block"),
        F.col("ids").alias("q_ids"), F.col("points").alias("q_points"),
    )
    c_blocks = _blocks(c, n_c).withColumn(
        "to", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)))
    )
    pairs = c_blocks.join(
        q_blocks, (F.col("dim") == F.col("q_dim")) & (F.col("to") == F.col("q_block"))
    ).select("dim", "ids", "points", "q_ids", "q_points")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, points = _unpack(row["ids"], row["points"], row["dim"])
                q_ids, q_points = _unpack(row["q_ids"], row["q_points"], row["dim"])
                search = Search(CoverTree(q_points), q_ids, CoverTree(points), ids, k)
                rows = list(search.results())
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)],
                        names=["query_id", "id", "score"],
                    )

    found = pairs.mapInArrow(run, "query_id long, id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")
    )
