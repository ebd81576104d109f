"""Nearest neighbours by cosine: a vantage-point tree a shard, searched by blocks of queries.

On unit vectors the chord, sqrt(2 - 2 cos), is a metric and orders as the cosine does. A shard's tree splits by distance to a
vantage point at the median and keeps each side's least and greatest distance; by the triangle inequality a side whose
lower bound, times `factor`, exceeds a query's k-th best distance so far is skipped. Factor 1 is exact; larger factors skip more.

Every vector goes to one shard of some SHARD vectors, the queries, a stated set (ids divisible by `every`), to each shard. A task
reads a shard's vectors, builds its tree once and then takes the queries as they come, a batch at a time, so memory is bounded
however many there are; each shard's best k are merged by query. Trees compare unit vectors; what comes within CLOSE of a query's
k-th best is scored on the original vectors, and that score alone ranks.

Vectors that are null, empty, zero, or hold null or non-finite components take no part; neither do null ids. Only vectors of one
dimension are compared. Rows that repeat a vec_id count once (the first in order of their components). Ties go to
the smaller vec_id. With fewer candidates all are returned. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.llm.common import in_arrow, table

SHARD = 16_384
#: Vectors a shard has at least where more cores wait.
LEAST = 2_048
LEAF = 128
#: Unit vectors' products are that near to the cosine.
CLOSE = 1e-9
#: Slack for rounding: distances near 0 lose half the digits of the cosine.
SLACK = 3e-6


@dataclass
class Node:
    rows: np.ndarray | None = None  # of a leaf
    vantage: int = -1
    near: "Node | None" = None
    far: "Node | None" = None
    bounds: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)


def _chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * cosine))


def build(unit: np.ndarray, leaf: int = LEAF) -> Node:
    """The tree over the rows of `unit`; without recursion, so that its depth is no limit."""
    root = Node()
    todo = [(root, np.arange(len(unit)))]
    while todo:
        node, rows = todo.pop()
        if len(rows) <= leaf:
            node.rows = rows
            continue
        node.vantage = int(rows[len(rows) // 2])
        d = _chord(unit[rows] @ unit[node.vantage])
        inside = d <= np.median(d)
        if inside.all():  # many equal vectors
            inside = d < d.max()
            if not inside.any():
                node.vantage, node.rows = -1, rows
                continue
        node.bounds = (d[inside].min(), d[inside].max(), d[~inside].min(), d[~inside].max())
        node.near, node.far = Node(), Node()
        todo += [(node.near, rows[inside]), (node.far, rows[~inside])]
    return root


class Search:
    """The best k of one shard for a batch of queries."""

    def __init__(self, shard: "Vectors", queries: "Vectors", k: int, factor: float):
        self.shard, self.queries, self.k, self.factor = shard, queries, k, factor
        self.score = np.full((len(queries.ids), k), -np.inf)
        self.best = np.full((len(queries.ids), k), np.iinfo(np.int64).max)
        self.visited = 0

    def _leaf(self, q: np.ndarray, rows: np.ndarray) -> None:
        for at in range(0, len(rows), 1024):
            own = rows[at : at + 1024]
            self.visited += len(q) * len(own)
            rough = self.queries.unit[q] @ self.shard.unit[own].T
            rough[self.shard.ids[own][None, :] == self.queries.ids[q][:, None]] = -np.inf
            least = self.score[q][:, -1]
            if len(own) >= self.k:
                least = np.maximum(least, np.partition(rough, len(own) - self.k, axis=1)[:, len(own) - self.k])
            good = rough >= (least - CLOSE)[:, None]
            good &= rough > -np.inf
            live = np.flatnonzero(good.any(axis=1))
            for part in np.array_split(live, max(1, int(good.sum()) // 65_536)):
                self._keep(q[part], own, good[part])

    def _keep(self, p: np.ndarray, own: np.ndarray, good: np.ndarray) -> None:
        """Merge the candidates `good` of the shard's rows `own` into the best of the queries `p`."""
        if not len(p):
            return
        i, j = np.nonzero(good)
        s = np.full(good.shape, -np.inf)
        s[i, j] = cosine(self.queries.raw[p[i]], self.shard.raw[own[j]])
        all_s = np.concatenate([self.score[p], s], axis=1)
        all_i = np.concatenate([self.best[p], np.broadcast_to(self.shard.ids[own], s.shape)], axis=1)
        top = np.lexsort((all_i, -all_s))[:, : self.k]
        self.score[p], self.best[p] = (np.take_along_axis(x, top, 1) for x in (all_s, all_i))

    def run(self, root: Node) -> None:
        # First each query's own leaf, which bounds its k-th distance; then all that the bound leaves.
        every = np.arange(len(self.queries.ids))
        seen: dict[int, np.ndarray] = {}
        todo = [(root, every)]
        while todo:
            node, q = todo.pop()
            if not len(q):
                continue
            if node.rows is not None:
                self._leaf(q, node.rows)
                seen[id(node)] = q
                continue
            d = _chord(self.queries.unit[q] @ self.shard.unit[node.vantage])
            go = d <= (node.bounds[1] + node.bounds[2]) / 2
            todo += [(node.near, q[go]), (node.far, q[~go])]
        todo = [(root, every)]
        while todo:
            node, q = todo.pop()
            if not len(q):
                continue
            if node.rows is not None:
                done = seen.get(id(node))
                q = q if done is None else np.setdiff1d(q, done, assume_unique=True)
                if len(q):
                    self._leaf(q, node.rows)
                continue
            d = _chord(self.queries.unit[q] @ self.shard.unit[node.vantage])
            limit = _chord(self.score[q][:, -1])  # infinite where fewer than k are known
            limit = np.where(np.isfinite(self.score[q][:, -1]), limit, np.inf) + SLACK
            near_lo, near_hi, far_lo, far_hi = node.bounds
            for side, lo, hi in ((node.far, far_lo, far_hi), (node.near, near_lo, near_hi)):
                bound = np.maximum(0.0, np.maximum(d - hi, lo - d))
                todo.append((side, q[bound * self.factor <= limit]))


class Vectors:
    """Ids, original and unit vectors, one row an id: of rows that repeat one, the first in order of components."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray):
        order = np.lexsort((*raw.T[::-1], ids))
        ids, raw = ids[order], raw[order]
        first = np.concatenate([[True], ids[1:] != ids[:-1]])
        self.ids, self.raw = ids[first], raw[first]
        scaled = self.raw / np.abs(self.raw).max(axis=1, keepdims=True)
        self.unit = scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))

    @classmethod
    def of(cls, parts: list[pa.RecordBatch]) -> "Vectors":
        ids = np.concatenate([p.column("vec_id").to_numpy() for p in parts])
        return cls(ids, np.concatenate([p.column("v").flatten().to_numpy() for p in parts]).reshape(len(ids), -1))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row in double precision; scaled only where squares would leave the range."""

    def norm(x):
        return np.sqrt((x * x).sum(axis=1))

    with np.errstate(over="ignore", under="ignore", invalid="ignore", divide="ignore"):
        out = (a * b).sum(axis=1) / (norm(a) * norm(b))
    odd = ~np.isfinite(out)
    if odd.any():
        a, b = (x[odd] / np.abs(x[odd]).max(axis=1, keepdims=True) for x in (a, b))
        out[odd] = (a * b).sum(axis=1) / (norm(a) * norm(b))
    return out


def _searched(k: int, factor: float):
    """Batches sorted by (key, asks): of each key first the shard's vectors, then the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, shard, root = None, [], None, None
        for batch in batches:
            pair = np.stack([batch.column("key").to_numpy(), batch.column("asks").to_numpy()])
            cuts = np.concatenate([[0], np.flatnonzero((pair[:, 1:] != pair[:, :-1]).any(axis=0)) + 1, [batch.num_rows]])
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                own = batch.slice(a, b - a)
                if pair[0, a] != key:
                    key, held, shard, root = pair[0, a], [], None, None
                if not pair[1, a]:
                    held.append(own)
                    continue
                if shard is None and held:
                    shard, held = Vectors.of(held), []
                    root = build(shard.unit)
                if shard is None:
                    continue
                queries = Vectors.of([own])
                found = Search(shard, queries, k, factor)
                found.run(root)
                at, place = np.nonzero(np.isfinite(found.score))
                yield pa.RecordBatch.from_arrays([pa.array(queries.ids[at]), pa.array(found.best[at, place]), pa.array(found.score[at, place])], ["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, factor: float = 1.0, shard: int = SHARD, least: int = LEAST) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0))
    good = table(good.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.size("embedding").alias("dim")), "ann-vectors", scan=True)
    n = good.count()
    shards = max(1, -(-n // shard), min(vectors.sparkSession.sparkContext.defaultParallelism, n // least))
    asked = good.where(F.col("vec_id") % every == 0).groupBy("dim", "vec_id").agg(F.min("v").alias("v"))
    numbers = F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))
    rows = good.select("dim", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("s"), F.lit(0).alias("asks"), "vec_id", "v")
    queries = asked.select("dim", F.explode(numbers).alias("s"), F.lit(1).alias("asks"), "vec_id", "v")
    both = rows.unionByName(queries).select((F.col("dim") * F.lit(shards) + F.col("s")).alias("key"), "asks", "vec_id", "v")
    parts = in_arrow(both.repartition(shards, "key").sortWithinPartitions("key", "asks"), _searched(k, factor), "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return parts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
