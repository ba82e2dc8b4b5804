"""Clusters of vectors around centroids (Lloyd's rounds) in exact integers; nearest centroids by a vantage-point tree.

The tree over the few centroids is rebuilt each round and sent with the task; a task walks it
for a batch of vectors at a time, each vector with its own best-first frontier.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.scratch import written

#: Integers beyond this are taken as this, so that squared distances of up to 64 components stay exact in 64 bits.
LARGEST = 2**27
#: Centroids of a leaf of the tree.
LEAF = 4
#: Rows of a batch that are walked at once.
ROWS = 4096
#: Bounds are real numbers: they prune only beyond this share of doubt, so equal distances stay in.
SLACK = 1e-9


@dataclass
class Tree:
    """A vantage-point tree over integer points.

    A node has either the members of a leaf, or a vantage point and two children, each with
    the least and largest distance of its members to the vantage point.
    """

    points: np.ndarray
    vantage: list[int] = field(default_factory=list)
    children: list[list[tuple[int, float, float]]] = field(default_factory=list)
    members: list[np.ndarray] = field(default_factory=list)

    @staticmethod
    def of(points: np.ndarray) -> Tree:
        tree = Tree(points)
        tree._node(np.arange(len(points)))
        return tree

    def _node(self, held: np.ndarray) -> int:
        at = len(self.vantage)
        self.vantage.append(-1)
        self.children.append([])
        self.members.append(held)
        if len(held) <= LEAF:
            return at
        # The vantage point is the one that lies farthest from the first: it spreads the others.
        far = held[np.argmax(squared(self.points[held], self.points[held[0]]))]
        rest = held[held != far]
        away = np.sqrt(squared(self.points[rest], self.points[far]).astype(float))
        order = np.argsort(away, kind="stable")
        self.vantage[at], self.members[at] = int(far), held[:0]
        for part in (order[: len(order) // 2], order[len(order) // 2 :]):
            self.children[at].append((self._node(rest[part]), float(away[part].min()), float(away[part].max())))
        return at

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest point of each vector, of equal ones the smaller number.

        Each vector has a frontier of nodes with lower bounds and opens the one with the least
        bound until none is within its best distance (a bound that equals it is opened).
        """
        best = np.full(len(vectors), np.iinfo(np.int64).max)
        number = np.full(len(vectors), len(self.points), np.int64)
        frontier = np.full((len(vectors), len(self.vantage)), np.inf)
        frontier[:, 0] = 0.0
        active = np.arange(len(vectors))

        def meet(rows: np.ndarray, point: int) -> np.ndarray:
            found = squared(vectors[rows], self.points[point])
            better = (found < best[rows]) | ((found == best[rows]) & (point < number[rows]))
            best[rows[better]], number[rows[better]] = found[better], point
            return found

        while len(active):
            node = np.argmin(frontier[active], axis=1)
            radius = np.sqrt(best[active].astype(float))
            within = frontier[active, node] <= radius * (1 + SLACK) + SLACK
            active, node = active[within], node[within]
            for k in np.unique(node):
                rows = active[node == k]
                lower = frontier[rows, k]
                frontier[rows, k] = np.inf
                if self.vantage[k] < 0:
                    for point in self.members[k]:
                        meet(rows, int(point))
                    continue
                away = np.sqrt(meet(rows, self.vantage[k]).astype(float))
                for child, least, most in self.children[k]:
                    frontier[rows, child] = np.maximum(lower, np.maximum(least - away, away - most) * (1 - SLACK) - SLACK)
        return number, best


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared Euclidean distances of integer rows."""
    apart = a - b
    return np.einsum("ij,ij->i", apart, apart)


def integers(vectors: Column, size: int, scale: int = 256) -> Column:
    """floor(scale * x) of each component as long, null for arrays of another length or with null or non-finite components."""
    x = F.transform(vectors, lambda v: v.cast("double"))
    sound = vectors.isNotNull() & (F.size(vectors) == size) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(x, lambda v: F.greatest(F.least(F.floor(F.greatest(F.least(v * scale, F.lit(2.0**62)), F.lit(-(2.0**62)))), F.lit(LARGEST)), F.lit(-LARGEST)).cast("long"))
    return F.when(sound, whole)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        yield part, part["q"].flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def _sums(vectors: DataFrame, tree: Tree) -> DataFrame:
    """(cluster, place, total): sums of components and, at place -1, numbers of vectors, a row for each task."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        k, size = tree.points.shape
        totals = np.zeros((k, size + 1), np.int64)
        for batch in batches:
            for _, q in _rows(batch):
                number, _ = tree.nearest(q)
                np.add.at(totals, number, np.hstack([np.ones((len(q), 1), np.int64), q]))
        held = np.flatnonzero(totals[:, 0])
        cluster, place = np.repeat(held, size + 1), np.tile(np.arange(-1, size), len(held))
        yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(place, pa.int32()), pa.array(totals[held].ravel(), pa.int64())], ["cluster", "place", "total"])

    return vectors.select("q").mapInArrow(run, "cluster int, place int, total long")


def _assigned(vectors: DataFrame, tree: Tree) -> DataFrame:
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, q in _rows(batch):
                number, best = tree.nearest(q)
                yield pa.RecordBatch.from_arrays([part["vec_id"], pa.array(number, pa.int32()), pa.array(best, pa.int64())], ["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "q").mapInArrow(run, "vec_id long, cluster int, distance long")


def moved(points: np.ndarray, sums: DataFrame) -> np.ndarray:
    """The centroids after a round: componentwise floor of the mean of their vectors; those without vectors stay."""
    totals = {(r.cluster, r.place): int(r.total) for r in sums.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    out = points.copy()
    for c in range(len(points)):
        if count := totals.get((c, -1)):
            out[c] = [totals[c, i] // count for i in range(points.shape[1])]
    return out


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, scale: int = 256, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid): each vector with its nearest of k centroids after some rounds.

    Kept are the vectors of `size` components that are all finite, as integers floor(scale * x).
    Centroids start as the kept vectors with the k least SHA-256 of `<seed>:<id>` in hex (a
    null id as an empty word; of equal hashes the least vectors first); fewer vectors give
    fewer centroids.  Each round moves a centroid to the floor of its vectors' mean; one
    without vectors stays.  Of centroids equally near the one with the smaller number counts.
    All sums and distances are exact; integers beyond LARGEST are taken as LARGEST, and a
    sum of distances beyond 64 bits is null.

    Each kept row returns once, with null or repeated ids as they are; other rows (null or
    other arrays) do not return; other columns, of any name, are ignored; an empty table
    gives an empty one.  What reaches the driver is k sums a round, and what tasks are sent
    is the tree over k centroids.
    """
    kept = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), integers(F.col(f"`{vector_col}`"), size, scale).alias("q")).where("q is not null")
    kept = written(kept, "vectors")
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    start = [r.q for r in kept.select(mark.alias("mark"), "q").orderBy("mark", "q").limit(k).collect()]
    if not start:
        return kept.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid", "array<long>"))])
    points = np.array(start, np.int64)
    for _ in range(rounds):
        points = moved(points, _sums(kept, Tree.of(points)))
    rows = written(_assigned(kept, Tree.of(points)), "assigned")
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    clusters = {r.cluster: int(r.total) for r in rows.groupBy("cluster").agg(total.alias("total")).collect()}
    fits = lambda x: x if x < 2**63 else None
    found = [(c, fits(x), fits(sum(clusters.values())), points[c].tolist()) for c, x in clusters.items()]
    named = vectors.sparkSession.createDataFrame(found, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return rows.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


