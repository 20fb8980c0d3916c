"""Quality scores: ridge regression on random Fourier features of document statistics, then isotonic calibration."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slices, stored, table
from .langid import remainder

# Groups of bytes whose shares are statistics.
GROUPS = {
    "space": b" \t\r\n\x0b\x0c", "line": b"\n", "lower": bytes(range(97, 123)), "upper": bytes(range(65, 91)), "digit": bytes(range(48, 58)),
    "stop": b".", "comma": b",;:", "shout": b"!?", "bar": b"|", "mark": b"#$%&*", "bracket": b"()[]{}<>", "quote": b"\"'`", "other": b"@^~_=+/\\-", "high": bytes(range(128, 256)),
}
_MATRIX = np.array([[b in g for b in range(256)] for g in GROUPS.values()], float).T
N_STATS = len(GROUPS) + 14


def statistics(text: str | None) -> np.ndarray:
    """A document's statistics; all are defined for empty texts."""
    text = text or ""
    data = np.frombuffer(text.encode(), np.uint8)
    histogram = np.bincount(data, minlength=256).astype(float)
    shares = histogram / max(len(data), 1)
    words = text.split()
    n = len(words)
    lengths = np.fromiter(map(len, words), float, n) if n else np.zeros(1)
    kinds = len(set(words))
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = len(set(zip(words, words[1:])))
    positive = shares[shares > 0]
    entropy = float(-(positive * np.log2(positive)).sum())
    marked = sum(1 for w in words if not w[-1].isalnum() and w[-1] not in ".,;:") / max(n, 1)
    shouted = sum(1 for w in words if len(w) > 1 and w.isupper()) / max(n, 1)
    titled = sum(1 for w in words if w[0].isupper()) / max(n, 1)
    more = [
        np.log1p(len(data)), np.log1p(n), lengths.mean(), lengths.std(), lengths.max() ** 0.5, (lengths <= 3).mean() if n else 0, kinds / max(n, 1), pairs / max(n - 1, 1),
        np.log1p(len(lines)), 1 - len(set(lines)) / max(len(lines), 1), entropy, marked, shouted, titled,
    ]
    return np.concatenate([np.sqrt(shares @ _MATRIX), more])


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and stats (array of doubles) of each row; null texts count as empty, repeated rows each for itself.

    Other columns, of whatever names, don't come along; an empty table gives no rows. A long text is in one task, with the list of its words.
    """

    def run(batches):
        for batch in batches:
            for some in slices(batch):
                stats = np.array([statistics(t) for t in some.column("text").to_pylist()])
                yield pa.record_batch([some.column("doc_id"), pa.array(list(stats), pa.list_(pa.float64()))], names=["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, stats array<double>")


class Model:
    """Centre, scale, the random features, ridge weights, and the calibration's knots. All sizes are fixed by parameters."""

    def __init__(self, features: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.w = rng.standard_normal((N_STATS, features)) / (width * np.sqrt(N_STATS))
        self.b = rng.uniform(0, 2 * np.pi, features)
        self.mean, self.scale = np.zeros(N_STATS), np.ones(N_STATS)
        self.beta, self.base = np.zeros(features + 1), 0.5
        self.knots, self.levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])

    def lift(self, stats: np.ndarray) -> np.ndarray:
        """Random Fourier features: products of rows approximate exp(-distance**2 / 2 width**2 n); with a constant."""
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / len(self.b)) * np.cos(x @ self.w + self.b), np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.lift(stats) @ self.beta + self.base

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = self.raw(stats)
        return np.clip(0.999 * np.interp(raw, self.knots, self.levels) + 0.001 * np.clip(raw, 0, 1), 0, 1)  # the rest orders rows of one level


def pooled(x: np.ndarray, n: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of s/n on x by pooling adjacent violators: the blocks' centres and levels."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x * n, n, s):
        blocks.append([a, b, c])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], last)]
    return np.array([a / b for a, b, _ in blocks]), np.array([c / b for _, b, c in blocks])


def fit(rows: DataFrame, features: int = 256, width: float = 0.7, ridge: float = 1e-2, seed: int = 11, folds: int = 4, fan_in: int = 16, bins: int = 2000) -> Model:
    """Fit on rows (stats, y in 0..1): every partition sums its normal equations; of these, ``fan_in`` at a time are added in a task, in rounds, and the driver gets one.

    Rows are dealt to ``folds`` by a hash of their statistics. The calibration is fitted on raw scores of each fold by the weights
    that the other folds give (their sums less the fold's), so it isn't misled by how well the weights fit their own rows.
    Without rows, every score is 0.5. With one class only, scores are its rate.
    """
    model = Model(features, width, seed)
    moments = rows.select(F.posexplode("stats").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("d")).collect()
    for r in moments:
        model.mean[r.i], model.scale[r.i] = r.m, max(r.d, 1e-6)
    counted = rows.agg(F.count("*").alias("n"), F.avg("y").alias("y")).first()
    if not counted.n:
        model.levels = np.array([0.5, 0.5])
        return model
    model.base = counted.y
    size = features + 1

    rows = rows.select("stats", "y", F.pmod(F.xxhash64("stats"), F.lit(folds)).alias("fold"))

    def sums(batches):
        from pyspark import TaskContext

        total = np.zeros((folds, size + 2, size))  # products of features, products with y, and the count
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                some = batch.slice(lo, 2000)
                z = model.lift(some.column("stats").flatten().to_numpy().reshape(some.num_rows, -1))
                y, fold = some.column("y").to_numpy() - model.base, some.column("fold").to_numpy()
                for k in np.unique(fold):
                    own = fold == k
                    total[k, :size] += z[own].T @ z[own]
                    total[k, size] += z[own].T @ y[own]
                    total[k, size + 1, 0] += own.sum()
        yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()])], names=["part", "sums"])

    def add(batches):
        """Sum the matrices of each group, one row at a time; groups come sorted."""
        key, total = None, None
        for batch in batches:
            for k, x in zip(batch.column("part").to_pylist(), batch.column("sums")):
                if k != key:
                    if total is not None:
                        yield pa.record_batch([pa.array([key], pa.int32()), pa.array([total.tobytes()])], names=["part", "sums"])
                    key, total = k, np.zeros(folds * (size + 2) * size)
                total += np.frombuffer(x.as_buffer())
        if total is not None:
            yield pa.record_batch([pa.array([key], pa.int32()), pa.array([total.tobytes()])], names=["part", "sums"])

    def solved(total: np.ndarray) -> np.ndarray:
        a, c, n = total[:size], total[size], total[size + 1, 0]
        return np.linalg.solve(a + ridge * n / features * np.diag([*np.ones(features), 0]) + 1e-9 * np.eye(size), c)

    parts = stored(rows.mapInArrow(lean(sums), "part int, sums binary"), "sums")
    n_parts = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while n_parts > 1:  # fan_in sums to one, until one is left
        n_parts = -(-n_parts // fan_in)
        group = parts.withColumn("part", F.expr(f"part div {fan_in}").cast("int")).repartitionById(n_parts, "part").sortWithinPartitions("part")
        parts = stored(group.mapInArrow(lean(add), "part int, sums binary"), "sums", instead_of=parts)
    each = np.frombuffer(parts.first().sums).reshape(folds, size + 2, size)
    model.beta = solved(each.sum(0))
    others = np.array([solved(each.sum(0) - each[k]) for k in range(folds)])

    def scored(batches):
        for batch in batches:
            if batch.num_rows:
                z = model.lift(batch.column("stats").flatten().to_numpy().reshape(batch.num_rows, -1))
                raw = (z * others[batch.column("fold").to_numpy()]).sum(1) + model.base
                yield pa.record_batch([pa.array(np.round(np.clip(raw, -0.5, 1.5) * bins).astype(np.int64)), batch.column("y")], names=["bin", "y"])

    cells = rows.mapInArrow(lean(scored), "bin long, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("s")).orderBy("bin").collect()
    model.knots, model.levels = pooled(*(np.array([float(r[k]) for r in cells]) / (bins if k == "bin" else 1) for k in ("bin", "n", "s")))
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of rows with stats (of ``with_statistics``), each for itself; equal statistics have equal scores; an empty table gives no rows."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                s = model.score(batch.column("stats").flatten().to_numpy().reshape(batch.num_rows, -1))
                yield pa.record_batch([batch.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(lean(run), "doc_id long, score double")


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. Repeated labels of a document are averaged; null labels don't count."""
    stats = stored(with_statistics(table(spark, sf_dir, "documents")), "stats")
    labels = table(spark, sf_dir, "labels").filter("doc_id is not null and quality is not null")
    labels = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.col("quality").cast("double")).alias("y"))
    train = stored(stats.filter(remainder(5) != 0).join(labels, "doc_id").select("stats", "y"), "train")
    out = score(stats, fit(train))
    return out.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
