"""Approximate nearest neighbours by vantage-point trees per shard, pruned by a relaxed triangle inequality."""

from __future__ import annotations

import io
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_system, shared_dir, table

SLACK = 1e-6  # for rounding: chords near 0 are exact to about 1e-8
FOUND = "query_id long, rank int, vec_id long, score double"


def valid(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """id, v (doubles), norm of the vectors that take part: not null, not zero, all components present and finite, id not null."""
    v = F.col(column).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    return rows.filter(finite & F.exists("v", lambda x: x != 0))


class Tree:
    """Unit vectors in leaf order; node k splits rows lo..hi at mid by distance from its vantage point (the row at lo)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = 256):
        self.norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        unit, order, nodes = vectors / self.norms[:, None], np.argsort(ids, kind="stable"), []
        todo = [(0, len(ids))]
        links: dict[tuple[int, int], int] = {}
        while todo:
            lo, hi = todo.pop()
            links[lo, hi] = len(nodes)
            if hi - lo <= leaf:
                nodes.append([lo, hi, -1, 0, 0, 0, 0])
                continue
            far = lo + int(np.argmax(chord(unit[order[lo]] @ unit[order[lo:hi]].T)))  # an outlying vantage point splits best
            order[lo], order[far] = order[far], order[lo]
            d = chord(unit[order[lo]] @ unit[order[lo + 1 : hi]].T)
            by = np.argsort(d, kind="stable")
            order[lo + 1 : hi], d = order[lo + 1 : hi][by], d[by]
            half = len(d) // 2
            mid = lo + 1 + half
            nodes.append([lo, hi, mid, d[0], d[half - 1], d[half], d[-1]])
            todo += [(mid, hi), (lo + 1, mid)]
        self.ids, self.vectors, self.unit, self.norms = ids[order], vectors[order], unit[order], self.norms[order]
        self.nodes = np.array(nodes, np.float64).reshape(-1, 7)
        self.children = np.array([[links.get((int(n[0]) + 1, int(n[2])), -1), links.get((int(n[2]), int(n[1])), -1)] if n[2] >= 0 else [-1, -1] for n in nodes], np.int64).reshape(-1, 2)

    def save(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, vectors=self.vectors, nodes=self.nodes, children=self.children)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Tree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as z:
            tree.ids, tree.vectors, tree.nodes, tree.children = z["ids"], z["vectors"], z["nodes"], z["children"]
        tree.norms = np.sqrt(np.einsum("ij,ij->i", tree.vectors, tree.vectors))
        tree.unit = tree.vectors / tree.norms[:, None]
        return tree


def chord(cosine: np.ndarray) -> np.ndarray:
    """Euclidean distance of unit vectors, a metric that orders as the cosine does."""
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


class Search:
    """A block of queries and each one's nearest so far; ``look`` searches a tree for all of them at once."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, factor: float):
        self.ids, self.vectors, self.k, self.factor = ids, vectors, k, factor
        self.norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        self.unit = vectors / self.norms[:, None]
        self.best_score, self.best_id = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        self.radius = np.full(len(ids), np.inf)  # chord of the k-th best
        self.compared = 0

    def look(self, tree: Tree) -> None:
        if not len(tree.ids):
            return
        stack = [(0, np.arange(len(self.ids)), np.zeros(len(self.ids)))]
        while stack:
            k, q, bound = stack.pop()
            q = q[self.factor * bound <= self.radius[q] + SLACK]  # factor 1: only what can't hold a nearer vector is left out
            if not len(q):
                continue
            lo, hi, mid, a, b, c, d = tree.nodes[k]
            lo, hi, mid = int(lo), int(hi), int(mid)
            if mid < 0:
                self.offer(q, tree, lo, hi)
                continue
            self.offer(q, tree, lo, lo + 1)
            far = chord(self.unit[q] @ tree.unit[lo])
            inner, outer = np.maximum(np.maximum(a - far, far - b), 0), np.maximum(np.maximum(c - far, far - d), 0)
            near = inner <= outer
            left, right = tree.children[k]
            for first, second, own, x, y in ((left, right, near, inner, outer), (right, left, ~near, outer, inner)):
                if own.any():
                    stack += [(second, q[own], y[own]), (first, q[own], x[own])]

    def offer(self, q: np.ndarray, tree: Tree, lo: int, hi: int) -> None:
        """Compare queries with rows lo..hi of a tree: a matrix product finds who could be among the nearest, those get exact scores."""
        close = self.unit[q] @ tree.unit[lo:hi].T >= self.best_score[q, -1][:, None] - 1e-9
        close &= self.ids[q][:, None] != tree.ids[None, lo:hi]
        self.compared += close.size
        i, j = np.nonzero(close)
        if not len(i):
            return
        who, row = q[i], lo + j
        # the same order of additions for any pair, so that equal vectors have equal scores
        score = (self.vectors[who] * tree.vectors[row]).sum(1) / (self.norms[who] * tree.norms[row])
        have = np.unique(who)
        who = np.concatenate([np.repeat(have, self.k), who])
        score = np.concatenate([self.best_score[have].ravel(), score])
        name = np.concatenate([self.best_id[have].ravel(), tree.ids[row]])
        by = np.lexsort((name, -score, who))
        start = np.searchsorted(who[by], have)
        top = by[start[:, None] + np.arange(self.k)]
        self.best_score[have], self.best_id[have] = score[top], name[top]
        last = self.best_score[have, -1]
        self.radius[have] = np.where(np.isneginf(last), np.inf, chord(np.maximum(last, -1)))


def build(rows: DataFrame, path: str, shard_rows: int, leaf: int = 256) -> None:
    """Deal all vectors to shards of about ``shard_rows`` by a hash of the id (and by dimension), and write each shard's tree."""
    n = rows.count()
    shards = max(1, math.ceil(n / shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards))).withColumn("dim", F.size("v"))
    dealt = dealt.repartitionByRange(shards, "shard", "dim").sortWithinPartitions("shard", "dim")

    def write(batches):
        key, parts = None, []

        def done():
            ids, vectors = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            return pa.record_batch([pa.array([int(key[0])]), pa.array([int(key[1])], pa.int32()), pa.array([Tree(ids, vectors, leaf).save()], pa.binary())], names=["shard", "dim", "tree"])

        for batch in batches:
            shard, dim, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "dim", "id"))
            for own in np.split(np.arange(len(ids)), np.flatnonzero((np.diff(shard) != 0) | (np.diff(dim) != 0)) + 1):
                if not len(own):
                    continue
                now = (shard[own[0]], dim[own[0]])
                if now != key and parts:
                    yield done()
                    parts = []
                key = now
                parts.append((ids[own].astype(np.int64), batch.column("v").slice(int(own[0]), len(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)))
        if parts:
            yield done()

    dealt.mapInArrow(write, "shard long, dim int, tree binary").write.option("compression", "uncompressed").parquet(path)


def nearest(vectors: DataFrame, queries: DataFrame, id_column: str = "vec_id", column: str = "embedding", k: int = 5, factor: float = 1.0, shard_rows: int = 4096, block: int = 512) -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` by cosine for each row of ``queries`` but itself (by id): query_id, rank, vec_id, score.

    Every row is in a tree of its shard. Blocks of ``block`` queries go through all shards' trees, each query keeping its k best, so
    later trees are pruned by what earlier ones gave. A subtree is left out if ``factor`` times its least possible distance by
    the triangle inequality exceeds the distance of the k-th best: factor 1 is exact, more is faster. Scores are exact cosines of
    the original vectors in double precision; ties go to the smaller id. Vectors null, zero or holding null or non-finite
    components, and null ids, take no part; vectors are compared with those of their own length; repeated rows are candidates
    each for itself; other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    path = shared_dir(spark, "vptrees")
    build(valid(vectors, id_column, column), path, shard_rows)
    asked = valid(queries, id_column, column).withColumn("dim", F.size("v"))
    n_blocks = max(1, math.ceil(queries.count() / block))
    blocks = asked.withColumn("block", F.pmod(F.xxhash64(F.col("id"), F.lit(1)), F.lit(n_blocks)))
    blocks = blocks.groupBy("dim", "block").agg(F.collect_list(F.struct("id", "v")).alias("queries"))  # ``block`` queries a row
    files = [r.path for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path").collect()]

    def search(batches):
        import pyarrow.parquet as pq

        for batch in batches:
            for row in range(batch.num_rows):
                dim, rows = batch.column("dim")[row].as_py(), batch.column("queries")[row].values
                ids = rows.field("id").to_numpy(zero_copy_only=False)
                found = Search(ids, rows.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim), k, factor)
                for name in files:
                    fs, at = file_system(name)
                    with fs.open_input_file(at) as f:
                        for part in pq.ParquetFile(f).iter_batches(batch_size=1):
                            if part.column("dim")[0].as_py() == dim:
                                found.look(Tree.load(part.column("tree")[0].as_py()))
                has = ~np.isneginf(found.best_score)
                n, rank = has.sum(1), np.broadcast_to(np.arange(1, k + 1, dtype=np.int32), has.shape)
                yield pa.record_batch([pa.array(np.repeat(ids, n)), pa.array(rank[has]), pa.array(found.best_id[has]), pa.array(found.best_score[has])], names=[c.split()[0] for c in FOUND.split(", ")])

    return blocks.repartitionByRange(n_blocks, "dim", "block").mapInArrow(search, FOUND)


def op5_neighbours(spark, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score of the 5 nearest of each row whose vec_id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 50 = 0"))


OP5_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))) AS score
  FROM e q JOIN e c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
