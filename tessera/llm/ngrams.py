"""Jaccard join of documents' word shingles by R-trees of group-count vectors.

Shingles are hashed to groups, and a document's counts by group are a point. The overlap of two sets is at most the sum, over any
division of the hash space into groups, of the smaller counts. The index has two levels:

* The space of fine group counts is cut into bands of coordinates. Linked sets differ in at most D shingles ((1-t)/(1+t) of their
  sizes' sum), so of D+1+s bands 1+s at least agree in all of their counts: points that agree on a band are a *cell*, a box of no
  extent in those coordinates. With all cells in one order, by how full they are, sets that agree on 1+s share one among each
  one's D+1 emptiest cells, so a set leaves its s fullest cells: those are what a passage makes that many documents share.
* Each cell's points stand in an R-tree of coarse counts, packed by sort-tile-recursive: a box's upper corner bounds the overlap with
  all below it by summed coordinate minima. The tree is joined with itself; every pair that is ever verified comes out of it.

Pairs that survive are bounded once more by finer counts, and then verified on the shingles themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import STRETCH, Filed, dealt_join, dropped, gathered, kept, lean, mix64, pa_bool, prefix_hash, slices, span_hash, stored, table

COORDINATES = 256
FINE = 1 << 20  # groups in a band
HUB = 256  # pairs of a node that go to a task together, at least
BLOCK_BYTES = 16 << 20  # sets that a block holds
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
ODD = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of a text's words, in order; long texts are taken in stretches that end at a space, if there is one."""
    out, at = [], 0
    while at < len(data):
        end = at + STRETCH
        if end < len(data):
            while end < len(data) and not _SPACE[data[end]]:
                end += 1
        b = _LOWER[np.frombuffer(data, np.uint8, min(end, len(data)) - at, at)]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[b], [True]]).astype(np.int8)))
        if len(edge):
            out.append(span_hash(prefix_hash(b), edge[0::2], edge[1::2]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(data: bytes, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``words``-word shingles of a text in UTF-8; of the whole sequence, if it has fewer words."""
    w = word_hashes(data)
    if not len(w):
        return w
    n = min(words, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        h = mix64(h * ODD[0] + w[i : len(w) - n + 1 + i])
    return np.unique(h)


def layouts(threshold: float, top: int = 1 << 40) -> list[tuple[int, int, int]]:
    """(least size, size above the class, bands): sizes by classes half as large again; D + 1 bands for its largest, and spare ones."""

    def make():
        out, lo = [], 1
        while lo < top:
            hi = max(lo + 1, lo * 3 // 2)
            d = int(2 * (hi - 1) * (1 - threshold) / (1 + threshold) + 1e-9)
            out.append((lo, hi, d + 1 + spare(d) if d else 0))
            lo = hi
        return out

    return kept(f"layouts {threshold}", make)


def spare(d: int) -> int:
    """Bands beyond D + 1: linked sets agree on as many more, so each may stay out of that many of its cells, the fullest ones."""
    return max(1, -(-3 * d // 10))


def classes_of(a: int, threshold: float) -> list[tuple[int, int, int]]:
    """(class, bands, D) of the classes that a set of ``a`` shingles is in: its own, and the next if a larger partner could be there."""
    classes, out = layouts(threshold), []
    k = next(i for i, (lo, hi, _) in enumerate(classes) if a < hi) if a else 0
    for j in (k, k + 1) if a else ():
        lo, hi, bands = classes[j]
        if bands and (j == k or int(a / threshold + 1e-9) >= lo):
            out.append((j, bands, int(2 * (hi - 1) * (1 - threshold) / (1 + threshold) + 1e-9)))
    return out


def spare_cells(h: np.ndarray, threshold: float) -> list[int]:
    """How many of the cells of its even and of its odd class a set can do without."""
    out = [0, 0]
    for j, bands, d in classes_of(len(h), threshold):
        taken = len(np.unique(((h >> np.uint64(32)) * np.uint64(bands)) >> np.uint64(32)))
        out[j & 1] = max(0, taken - d - 1)
    return out


def band_keys(h: np.ndarray, threshold: float, fine: int = FINE) -> np.ndarray:
    """Keys of the cells that a set is in. Sets so small that only equal ones link are in none.

    A shingle's high 32 bits give its band and, in it, one of ``fine`` groups. A cell's key is a linear hash of the band's group
    counts: the sum of counts, each times its group's constant. A key's last bit is that of its class, so a set's keys of its two
    classes can be told apart.

    Bands without shingles agree among strangers, so they make no cell: of two linked sets, one with few empty bands (no more than
    there are spare ones) is sure to agree with the other on a band that isn't empty. Sets with more empty bands also have cells
    for those.
    """
    out = []
    for j, bands, d in classes_of(len(h), threshold):
        place = (h >> np.uint64(32)) * np.uint64(bands)
        limit = np.searchsorted(place >> np.uint64(32), np.arange(bands + 1))
        group = ((place & np.uint64(0xFFFFFFFF)) * np.uint64(fine)) >> np.uint64(32)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(group ^ ODD[1]), dtype=np.uint64)])
        n = np.diff(limit)
        key = mix64(mix64(sums[limit[1:]] - sums[limit[:-1]] + np.uint64(j * int(ODD[2]) % (1 << 64))) + np.arange(bands, dtype=np.uint64) * ODD[0])
        key = key & ~np.uint64(1) | np.uint64(j & 1)
        out.append(key if (n == 0).sum() > spare(d) else key[n > 0])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def point(h: np.ndarray, groups: int | None = None) -> bytes:
    """Group counts of a set, a group for about two shingles (a power of two, ``COORDINATES`` at least); the first byte is a count's width."""
    groups = groups or max(COORDINATES, 1 << max(0, len(h) // 2 - 1).bit_length())
    c = np.bincount((h & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    width = 1 if c.max() < 256 else 4
    return bytes([width]) + c.astype(f"<u{width}").tobytes()


def coordinates(data) -> np.ndarray:
    """The counts in a ``point``."""
    return np.frombuffer(data, f"<u{memoryview(data)[0]}", offset=1).astype(np.int64)


def overlap_bound(a: np.ndarray, b: np.ndarray) -> int:
    """Summed coordinate minima of two points, the finer one folded to the other's groups: no less than the overlap of the sets."""
    groups = min(len(a), len(b))
    return int(np.minimum(a.reshape(-1, groups).sum(0), b.reshape(-1, groups).sum(0)).sum())


class RTree:
    """Points packed by sort-tile-recursive: leaves of ``leaf`` points, nodes of ``leaf`` children, each with its upper corner and least size."""

    def __init__(self, points: np.ndarray, leaf: int = 16):
        order = self.tiled(points, np.arange(len(points)), leaf, np.argsort(-points.var(0))[:4]) if len(points) > leaf else np.arange(len(points))
        self.order, self.levels, at = order, [], np.arange(0, len(order), leaf)
        top, low = np.maximum.reduceat(points[order], at), np.minimum.reduceat(points[order].sum(1), at)
        self.levels.append((top, low))
        while len(top) > 1:
            at = np.arange(0, len(top), leaf)
            top, low = np.maximum.reduceat(top, at), np.minimum.reduceat(low, at)
            self.levels.append((top, low))
        self.points, self.sizes, self.leaf = points, points.sum(1), leaf

    @staticmethod
    def tiled(points: np.ndarray, rows: np.ndarray, leaf: int, axes: np.ndarray) -> np.ndarray:
        """Sort by size first, then tile by the coordinates that vary most."""
        rows = rows[np.argsort(points[rows].sum(1), kind="stable")]
        for axis in axes:
            tile = leaf * max(1, int(np.ceil((len(rows) / leaf) ** 0.5)))
            rows = np.concatenate([r[np.argsort(points[r, axis], kind="stable")] for r in np.split(rows, range(tile, len(rows), tile))])
        return rows

    def pairs(self, threshold: float, label: np.ndarray):
        """(rows, rows, bound on the overlap over the overlap needed) of pairs with different labels whose overlap could be large enough: the tree joined with itself, level by level."""
        share, label = threshold / (1 + threshold), label[self.order]
        points, sizes = self.points[self.order], self.sizes[self.order]
        n = len(self.levels[-1][0])
        i, j = np.triu_indices(n)
        below = np.arange(self.leaf)
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low = self.levels[depth]
            good = np.minimum(top[i], top[j]).sum(1) >= share * (low[i] + low[j]) - 1e-9
            i, j = i[good], j[good]
            if depth:
                i, j = (np.broadcast_to(x, (len(i), self.leaf, self.leaf)).ravel() for x in (i[:, None, None] * self.leaf + below[None, :, None], j[:, None, None] * self.leaf + below))
                good = (i <= j) & (j < len(self.levels[depth - 1][0]))
                i, j = i[good], j[good]
        for at in range(0, len(i), 64):
            a, b = (np.broadcast_to(x, (len(x), self.leaf, self.leaf)).ravel() for x in (i[at : at + 64, None, None] * self.leaf + below[None, :, None], j[at : at + 64, None, None] * self.leaf + below))
            good = (a < b) & (b < len(points))
            a, b, over = leaf_pairs(points, sizes, label, a[good], b[good], share)
            yield self.order[a], self.order[b], over


def leaf_pairs(points: np.ndarray, sizes: np.ndarray, label: np.ndarray, a: np.ndarray, b: np.ndarray, share: float):
    """Of pairs of rows, those with different labels whose summed minima are large enough; and how many times as large as needed."""
    good = label[a] != label[b]
    a, b = a[good], b[good]
    need = share * (sizes[a] + sizes[b]) - 1e-9
    good = np.minimum(sizes[a], sizes[b]) >= need
    a, b, need = a[good], b[good], need[good]
    have = np.minimum(points[a], points[b]).sum(1)
    good = have >= need
    return a[good], b[good], have[good] / np.maximum(need[good], 1e-9)


def union_find(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node that the links (u, v) join each to): unions by the smaller root, paths halved, all links at a time."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root, a, b = np.arange(len(nodes)), at[: len(u)], at[len(u) :]
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _united(batches, most: int = 300_000):
    """Of ``most`` links at a time, one for each node, to the smallest that they join it to."""
    held, rows = [], 0

    def done():
        nodes, roots = union_find(*(np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("u", "v")))
        return pa.record_batch([pa.array(nodes[nodes != roots]), pa.array(roots[nodes != roots])], names=["u", "v"])

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows > most:
            yield done()
            held, rows = [], 0
    if rows:
        yield done()


#: Links that one task unites (16 MB); more are first settled across tasks.
FEW_LINKS = 1 << 20


def components(edges: DataFrame, name: str, few: int = FEW_LINKS) -> DataFrame:
    """node, comp (the smallest node that links reach) of nodes with edges (u, v).

    Tasks unite the links that they have. If what is left is at most ``few`` links, one task unites it; else large-star and small-star rounds
    settle what crosses tasks until nothing changes. Every round is written to the shared folder, and the one before it deleted.
    Smallest neighbours are pre-aggregated, and nodes with very many neighbours are dealt out.
    """
    both = lambda e: e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    edges = stored(edges.select("u", "v").mapInArrow(lean(_united), "u long, v long").distinct(), name)
    sign = lambda e: e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    seen = sign(edges)
    if seen.n <= few:
        return stored(edges.coalesce(1).mapInArrow(lean(lambda batches: _united(batches, few)), "u long, v long"), name, instead_of=edges).select(F.col("u").alias("node"), F.col("v").alias("comp"))
    while seen.n:
        around = both(edges)
        least = around.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("times")).withColumn("m", F.least("u", "m"))
        large = dealt_join(around, least, ["u"], "times", 2 * seen.n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("times"))
        small = dealt_join(large, low, ["u"], "times", seen.n).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v"))
        edges = stored(small.filter("u <> v").distinct(), name, instead_of=edges)
        now = sign(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))


def _groups(batches, keys: list[str]):
    """(key, lists of the columns' values) of each run of equal keys in a task's sorted rows."""
    key, held = None, {}
    for batch in batches:
        ks = list(zip(*(batch.column(k).to_pylist() for k in keys)))
        columns = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        lo = 0
        for hi in range(1, len(ks) + 1):
            if hi == len(ks) or ks[hi] != ks[lo]:
                if ks[lo] != key:
                    if held:
                        yield key, held
                    key, held = ks[lo], {c: [] for c in columns}
                for c, x in columns.items():
                    held[c] += x[lo:hi]
                lo = hi
    if held:
        yield key, held


def tree_join(groups: list, threshold: float, forest: bool):
    """Pairs (u, v) of nodes out of the trees of some cells: small cells are a leaf each and are joined together, a large one has a tree of its own.

    With ``forest``, of the pairs that the bound leaves, one for each node, that with the cell's first node among its partners;
    without, all pairs of nodes in different components, one of them at least ``apart``. ``over`` tells how the bound stands to what is needed.
    """
    share, sizes = threshold / (1 + threshold), [len(c["node"]) for _, c in groups]
    column = lambda name: np.array([x for _, c in groups for x in c[name]])
    node = column("node")
    label, apart = (np.arange(len(node)), np.ones(len(node), bool)) if forest else (column("comp"), column("apart"))
    points = np.stack([coordinates(p) for _, c in groups for p in c["corner"]])
    points = points.astype(np.int16 if points.max() < 1 << 15 else np.int32)
    if len(groups) == 1:
        found = RTree(points).pairs(threshold, label)
    else:
        begin = np.cumsum([0, *sizes[:-1]])
        every = [np.stack(np.triu_indices(n, 1)) + at for n, at in zip(sizes, begin)]
        found = [leaf_pairs(points, points.sum(1), label, *np.concatenate(every, 1), share)]
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    a, b, over = (np.concatenate(x) for x in zip(none, *[(np.minimum(x, y), np.maximum(x, y), z) for x, y, z in found]))
    if forest:
        by = np.lexsort((a, b))
        good = by[np.concatenate([[True], b[by][1:] != b[by][:-1]])] if len(b) else by
    else:
        good = apart[a] | apart[b]
    a, b, over = a[good], b[good], over[good]
    return pa.record_batch([pa.array(np.minimum(node[a], node[b])), pa.array(np.maximum(node[a], node[b])), pa.array(over)], names=["u", "v", "over"])


def joined_cells(threshold: float, forest: bool, keys: list[str]):
    """``tree_join`` over a task's cells, which come sorted by ``keys``; small ones by some ten thousand pairs at a time."""

    def run(batches):
        small, pairs = [], 0
        for group in _groups(batches, keys):
            m = len(group[1]["node"])
            if m > 64:
                yield tree_join([group], threshold, forest)
                continue
            small.append(group)
            pairs += m * m // 2
            if pairs > 20_000:
                yield tree_join(small, threshold, forest)
                small, pairs = [], 0
        if small:
            yield tree_join(small, threshold, forest)

    return run


class CountIndex:
    """How sets are brought together by their group counts: cells of bands, and R-trees of corners in a cell."""

    def __init__(self, threshold: float, fine: int = FINE):
        self.threshold, self.fine = threshold, fine

    def spares(self, h: np.ndarray) -> list[int]:
        return spare_cells(h, self.threshold)

    def keys(self, h: np.ndarray) -> np.ndarray:
        return band_keys(h, self.threshold, self.fine)

    def joined(self, forest: bool, keys: list[str]):
        return joined_cells(self.threshold, forest, keys)


def jaccard_classes(docs: DataFrame, threshold: float = 0.9, words: int = 3, bucket_rows: int = 400_000, block: int = 1024, index=None, counts: dict | None = None) -> tuple[DataFrame, DataFrame, Filed, list[str]]:
    """Classes of documents that links of Jaccard similarity ``threshold`` or more connect.

    Words are runs of other characters than space, tab, line feed, vertical tab, form feed and carriage return, A-Z in lower case; a
    document's set holds its distinct ``words``-word shingles, or its whole sequence if it has fewer words. Null texts count as empty;
    empty sets link with nothing; repeated rows link by their equal sets; a table without rows gives none; very long texts are hashed
    in stretches. ``docs`` may have any columns, those of the result's names too.

    Returns (rows, sets, file, names): ``rows`` has ``row`` (a struct of the columns of ``docs``, without text), rid (a number of the
    row), n_shingles, set1, set2; ``sets`` has set1, set2, n_shingles, copies, comp (equal for linked sets), component_id (smallest
    doc_id of the component) and best (rid of the row that has it; null doc_ids last). Empty sets are in ``rows`` alone.

    Equal sets are joined by a 128-bit hash first; the index holds each distinct set once. Cells are joined twice. First every
    cell's tree gives one pair for each node, the first partner that the bound leaves it; of a node's pairs from all its cells, the
    two with the best bounds are verified, and after that those that still lie between components. Then, of cells whose nodes verified
    links don't connect, all pairs between nodes of different components that the bound leaves, but for those between two nodes of
    the cell's largest component, which are connected (in blocks of ``block``, if there are many). So no pair gets into a
    component unverified, no link between components is lost, and no group's pairs are all listed. ``counts``, if given, gets the
    numbers of pairs that the trees gave and of those verified. ``index`` is another way to make cells and to join them, in place of
    a ``CountIndex``; one with ``sketched`` makes a set's keys and corner together, once, and links the sets of a cell itself.
    """
    spark, index = docs.sparkSession, index or CountIndex(threshold)
    once = hasattr(index, "sketched")
    names = [c for c in docs.columns if c != "text"]
    if not names:
        docs, names = docs.select("text", F.lit(0).alias("no_column")), ["no_column"]
    ident = F.col("doc_id").cast("long") if "doc_id" in names else F.lit(None).cast("long")
    docs = docs.select(F.struct(*names).alias("row"), ident.alias("doc_id"), F.col("text").cast("string").alias("text"))

    def first(batches):
        import zstandard
        from pyspark import TaskContext

        rid, pack = TaskContext.get().partitionId() << 33, zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for some in slices(batch):
                texts = [(t or "").encode() for t in some.column("text").to_pylist()]
                sets = [shingles(t, words) for t in texts]
                marks = [[int(mix64(h * odd).sum(dtype=np.uint64).view(np.int64)) for h in sets] for odd in ODD[1:]]
                spares = [(0, 0) if once else index.spares(h) for h in sets]
                columns = [np.arange(rid, rid + len(texts)), list(map(len, sets)), *marks, [x for x, _ in spares], [x for _, x in spares]]
                yield pa.record_batch([some.column("row"), some.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns), pa.array([pack.compress(t) for t in texts], pa.binary())], names=["row", "doc_id", "rid", "n_shingles", "set1", "set2", "spare0", "spare1", "ztext"])
                rid += len(texts)

    added = T._parse_datatype_string("rid long, n_shingles long, set1 long, set2 long, spare0 long, spare1 long, ztext binary")
    have = Filed(docs.mapInArrow(lean(first), T.StructType([docs.schema["row"], docs.schema["doc_id"], *added])), "shingled")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")).alias("best")
    same = have.rows.filter("n_shingles > 0").groupBy("set1", "set2", "n_shingles").agg(F.min("rid").alias("node"), F.count("*").alias("copies"), F.min("spare0").alias("spare0"), F.min("spare1").alias("spare1"), best)
    same = stored(same, "sets")
    read = have.reader(["ztext"])

    def fetch(rids: DataFrame, what: str) -> DataFrame:
        """node and ``what`` (corner: a point of few groups; point; hashes) of the rows numbered in ``rids``, made anew from their texts."""
        make = {"corner": lambda h: point(h, COORDINATES), "point": point, "hashes": np.ndarray.tobytes}[what]

        def run(batches):
            import zstandard

            unpack = zstandard.ZstdDecompressor()
            for _, part in read(batches):
                for some in slices(part, "ztext", 200, 400_000):
                    found = [make(shingles(unpack.decompress(z), words)) for z in some.column("ztext").to_pylist()]
                    yield pa.record_batch([some.column("rid"), pa.array(found, pa.binary())], names=["node", what])

        return have.tasks(rids.distinct()).mapInArrow(lean(run), f"node long, {what} binary")

    # cells: an equal share of the keys' range is a bucket; keys that many of a sample have are dealt out over all buckets
    def keys_of(batches):
        """(keys, the node of each) of sets made anew from their texts, or of sketched ones."""
        import zstandard

        if once:
            for batch in batches:
                keys = batch.column("keys")
                yield keys.flatten().to_numpy(), np.repeat(batch.column("node").to_numpy(), np.diff(keys.offsets.to_numpy()))
            return
        unpack = zstandard.ZstdDecompressor()
        for _, part in read(batches):
            for some in slices(part, "ztext", 100, 200_000):
                keys = [index.keys(shingles(unpack.decompress(z), words)).view(np.int64) for z in some.column("ztext").to_pylist()]
                yield np.concatenate(keys), np.repeat(some.column("rid").to_numpy(), [len(k) for k in keys])

    def sketch(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for _, part in read(batches):
            for some in slices(part, "ztext", 200, 400_000):
                keys, corners = index.sketched([shingles(unpack.decompress(z), words) for z in some.column("ztext").to_pylist()])
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32()), pa.array(keys.ravel().view(np.int64)))
                yield pa.record_batch([some.column("rid"), pa.array(corners, pa.binary()), keys], names=["node", "corner", "keys"])

    def sample(batches):
        for key, node in keys_of(batches):
            yield pa.record_batch([pa.array(key)], names=["key"])

    n_sets = same.count()
    nodes = same.select(F.col("node").alias("rid"))
    if once:
        sketches = stored(have.tasks(nodes).mapInArrow(lean(sketch), "node long, corner binary, keys array<long>"), "sketches")
    source = lambda share: sketches.select("node", "keys").sample(share, seed=3) if once else have.tasks(nodes.sample(share, seed=3))
    sampled = source(min(1.0, 3000 / max(1, n_sets))).mapInArrow(lean(sample), "key long").groupBy("key").count()
    amount = sampled.agg(F.sum("count").alias("n")).first().n or 0
    buckets = int(max(1, -(-amount * max(1, n_sets / 3000) // bucket_rows)))
    often = np.sort(np.array([r.key for r in sampled.filter("count >= 8").collect()], np.int64))  # the sample bounds them
    shared = spark.sparkContext.broadcast(often)

    def common_keys(key: np.ndarray) -> np.ndarray:
        often = shared.value
        if not len(often):
            return np.zeros(len(key), bool)
        return often[np.minimum(np.searchsorted(often, key), len(often) - 1)] == key

    def emit(batches):
        for key, node in keys_of(batches):
            spread = np.where(common_keys(key), mix64(key.view(np.uint64) ^ node.view(np.uint64)), key.view(np.uint64))
            bucket = ((spread >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            yield pa.record_batch([pa.array(bucket), pa.array(key), pa.array(node)], names=["bucket", "key", "node"])

    def met_twice(batches):
        """Rows of keys that come twice in a bucket, and of those dealt out over all buckets."""
        rows = gathered(batches)
        if rows is None:
            return
        key, node = (rows.column(c).to_numpy() for c in ("key", "node"))
        by = np.argsort(key, kind="stable")
        key, node = key[by], node[by]
        run = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        keep = (np.bincount(run) > 1)[run] | common_keys(key)
        yield pa.record_batch([pa.array(key[keep]), pa.array(node[keep])], names=["key", "node"])

    def met_pairs(batches):
        """(key, u, v, over) of a bucket's cells: pairs of a cell's first set with each other one, counted (key null); the first sets of cells that are dealt out (over 0)."""
        rows = gathered(batches)
        if rows is None:
            return
        key, node = (rows.column(c).to_numpy() for c in ("key", "node"))
        by = np.lexsort((node, key))
        key, node = key[by], node[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        head = node[new][np.cumsum(new) - 1]
        pairs, over = np.unique(np.stack([head, node], 1)[head != node], axis=0, return_counts=True)
        tips = np.flatnonzero(new & common_keys(key))
        columns = [pa.array([None] * len(pairs) + key[tips].tolist(), pa.int64()), *(np.concatenate([pairs[:, i], node[tips]]) for i in (0, 1)), np.concatenate([over, np.zeros(len(tips), np.int64)])]
        yield pa.record_batch([columns[0], *(pa.array(c, pa.int64()) for c in columns[1:])], names=["key", "u", "v", "over"])

    cell, pair = "key long, node long", "u long, v long, over double"
    keys = source(1.0).mapInArrow(lean(emit), "bucket int, " + cell).repartitionById(buckets, "bucket").select("key", "node")
    if once:  # pairs of a cell's sets with its first one, by the number of cells in which they meet so
        met = stored(keys.mapInArrow(lean(met_pairs), "key long, u long, v long, over long"), "met")
        tips = met.filter("key IS NOT NULL").select("key", "u")
        tips = tips.withColumnRenamed("u", "v").join(tips.groupBy("key").agg(F.min("u").alias("u")), "key").filter("u <> v").select("u", "v", F.lit(1).cast("long").alias("over"))
        forest = met.filter("key IS NULL").drop("key").unionByName(tips).groupBy("u", "v").agg(F.sum("over").cast("double").alias("over"))
    else:
        cells = stored(keys.mapInArrow(lean(met_twice), cell), "cells")
        # sets leave the fullest cells that they can do without
        full = cells.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").withColumn("times", F.col("m"))
        fullest = Window.partitionBy("node", F.expr("key & 1")).orderBy(F.desc("m"), F.desc("key"))
        ranked = dealt_join(cells, full, ["key"], "times", cells.count()).withColumn("rank", F.row_number().over(fullest))
        ranked = ranked.join(same.select("node", "spare0", "spare1"), "node").filter("rank > if(key & 1 = 0, spare0, spare1)")
        cells = stored(ranked.select("key", "node"), "cells", instead_of=cells)
        mark = [F.bit_xor(F.xxhash64(F.col("node"), F.lit(i))).alias(f"mark{i}") for i in (1, 2)]
        heads = cells.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("m"), *mark).filter("m > 1")
        heads = heads.groupBy("head", "m", "mark1", "mark2").agg(F.min("key").alias("key")).select("key", "head", "m", F.col("m").alias("times"))  # of cells with the same members, one
        cells = stored(dealt_join(cells, heads, ["key"], "times", cells.count()), "cells", instead_of=cells)

    def tested(pairs: DataFrame, what: str, test) -> DataFrame:
        """Of pairs (u, v), those that ``test`` lets pass; what it compares meets in a task, a pair at a time."""
        sides = stored(fetch(pairs.select(F.explode(F.array("u", "v")).alias("rid")), what), f"asked-{what}", "lz4")
        first = sides.select(F.col("node").alias("u"), F.col(what).alias("x"))
        times = pairs.groupBy("u").agg(F.count("*").alias("times"))
        seen = times.agg(F.max("times").alias("most"), F.sum("times").alias("n")).first()
        if (seen.most or 0) <= HUB:
            half = pairs.join(first, "u")
        else:  # a node that is u in very many pairs is dealt out: copies of what it has, a share of its pairs with each
            hubs = times.withColumn("parts", F.ceil(F.col("times") / HUB).cast("int"))
            copies = first.join(hubs.select("u", "parts"), "u").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
            parted = dealt_join(pairs.select("u", "v"), hubs, ["u"], "times", seen.n).withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int")).drop("parts")
            half = parted.join(copies, ["u", "part"]).drop("part")
        whole = half.join(sides.select(F.col("node").alias("v"), F.col(what).alias("y")), "v")

        def run(batches):
            for batch in batches:
                good = pa_bool([test(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column("x"), batch.column("y"))])
                yield pa.record_batch([batch.column("u").filter(good), batch.column("v").filter(good)], names=["u", "v"])

        out = stored(whole.mapInArrow(lean(run), "u long, v long"), f"passed-{what}")
        dropped(spark, [sides._stored])
        return out

    def near_enough(x, y) -> bool:
        a, b = coordinates(x), coordinates(y)
        return overlap_bound(a, b) >= threshold / (1 + threshold) * (a.sum() + b.sum()) - 1e-9

    def linked_sets(x, y) -> bool:
        a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both > 0 and both >= threshold * (len(a) + len(b) - both) - 1e-9

    def verified(pairs: DataFrame) -> DataFrame:
        """Of pairs (u, v), those that link: points first, a byte for two shingles; the sets' hashes only of pairs that these leave."""
        out = tested(pairs if once else tested(pairs, "point", near_enough), "hashes", linked_sets)
        if counts is not None:
            counts["from_trees"] = counts.get("from_trees", 0) + pairs.count()
            counts["linked"] = counts.get("linked", 0) + out.count()
        return out

    if not once:
        corners = stored(fetch(cells.select(F.col("node").alias("rid")), "corner"), "corners")
        blocks = F.expr(f"cast(ceil(m / {block}) as int)")
        own = F.pmod(F.xxhash64("node"), blocks).cast("int")
        places = F.explode(F.when(F.col("node") == F.col("head"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(own)))  # the first node is in each block
        dealt = cells.join(corners, "node").withColumn("i", places).select("key", "i", "node", "corner")
        dealt = dealt.repartition("key", "i").sortWithinPartitions("key", "i", "node")
        forest = dealt.mapInArrow(lean(index.joined(True, ["key", "i"])), pair).groupBy("u", "v").agg(F.max("over").alias("over"))
    forest = stored(forest.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("over"), "u"))), "pairs")
    links = verified(forest.filter("place <= 2").select("u", "v"))
    comp = components(links, "components")
    of = lambda x: comp.select(F.col("node").alias(x), F.col("comp").alias(f"comp_{x}"))
    if not once:
        later = forest.filter("place > 2").join(of("u"), "u", "left").join(of("v"), "v", "left").filter("coalesce(comp_u, u) <> coalesce(comp_v, v)")
        later = stored(later.select("u", "v"), "pairs")
        if not later.isEmpty():
            links = links.unionByName(verified(later))
            comp = components(links, "components")

    def unsettled(labelled: DataFrame) -> DataFrame:
        """Of groups (key) whose nodes aren't all connected: the largest component, its size, and the group's."""
        parts = labelled.groupBy("key", "comp").agg(F.count("*").alias("n"))
        of_group = parts.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("times"), F.max("n").alias("top"), F.count("*").alias("kinds")).filter("kinds > 1")
        return stored(of_group.select("key", "main", "top", "times"), "unsettled")

    if once:  # components that cells bring together are a family: each of its sets goes to a task once for a block
        corners = sketches.select("node", "corner")
        across = forest.select("u", "v").join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("comp_u", "u").alias("u"), F.coalesce("comp_v", "v").alias("v")).filter("u <> v").distinct()
        family = stored(components(across, "families"), "family")
        family = family.unionByName(family.select(F.col("comp").alias("node"), "comp").distinct()).select(F.col("node").alias("comp"), F.col("comp").alias("key"))
        members = comp.unionByName(family.select(F.col("comp").alias("node"), "comp")).distinct()
        times = members.groupBy("comp").agg(F.count("*").alias("times")).join(family, "comp")
        labelled = dealt_join(members, times, ["comp"], "times", members.count())
        labelled = stored(labelled.join(same.select("node", "n_shingles"), "node"), "families")
    else:  # cells whose nodes aren't all connected: the other pairs that may link, but for those in the cell's largest component
        labelled = cells.filter("m > 2").drop("head").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    open_cells = unsettled(labelled)
    if not open_cells.isEmpty():
        rows = stored(dealt_join(labelled, open_cells, ["key"], "times", labelled.count()).withColumn("apart", F.expr("comp <> main")), "apart")
        if once:  # blocks of so many sets, or of sets that take so much
            taken = lambda x: F.coalesce(F.sum(x), F.lit(0)) * 8 / BLOCK_BYTES
            sized = rows.groupBy("key").agg(F.count("*").alias("times"), F.greatest(F.count("*") / block, taken("n_shingles")).alias("js"), F.greatest(F.count_if("apart") / block, taken(F.when(F.col("apart"), F.col("n_shingles")))).alias("is"))
            rows = dealt_join(rows, sized, ["key"], "times", rows.count()).withColumns({x: F.ceil(x).cast("int") for x in ("js", "is")})
        else:
            rows = rows.withColumn("js", F.expr(f"cast(ceil(m / {block}) as int)")).withColumn("is", F.expr(f"cast(ceil((m - top) / {block}) as int)"))
        one, other = F.pmod(F.xxhash64("node"), F.col("is")).cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("js")).cast("int")
        those = rows.withColumn("asks", F.lit(True)).filter("apart").withColumn("i", one).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("js") - 1)))
        all_rows = rows.withColumn("asks", F.lit(False)).withColumn("j", other).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("is") - 1)))
        dealt = those.unionByName(all_rows)
        if once:
            hashes = stored(fetch(rows.select(F.col("node").alias("rid")), "hashes"), "asked-hashes", "lz4")
            dealt = dealt.select("key", "i", "j", "node", "comp", "apart", "asks").join(corners, "node").join(hashes, "node")
        else:
            dealt = dealt.withColumn("apart", F.col("asks")).select("key", "i", "j", "node", "comp", "apart").join(corners, "node")
        dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
        found = dealt.mapInArrow(lean(index.joined(False, ["key", "i", "j"])), pair).select("u", "v").distinct()
        if once:
            links = links.unionByName(stored(found, "links"))
        else:
            links = links.unionByName(verified(stored(found.join(forest.select("u", "v"), ["u", "v"], "left_anti"), "pairs")))
        comp = components(links, "components")

    sets = stored(same.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")).select("set1", "set2", "n_shingles", "copies", "comp", "best"), "sets", instead_of=None)
    classes = stored(sets.groupBy("comp").agg(F.min("best").alias("best"), F.count("*").alias("times")), "classes")
    sets = dealt_join(sets.drop("best"), classes, ["comp"], "times", n_sets)
    sets = stored(sets.select("set1", "set2", "n_shingles", "copies", "comp", F.col("best.doc_id").alias("component_id"), F.col("best.rid").alias("best")), "sets")
    return have.rows.select("row", "rid", "n_shingles", "set1", "set2"), sets, have, names


def with_classes(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without text, and n_shingles, comp, component_id (see ``jaccard_classes``) in place of columns of these names."""
    rows, sets, _, names = jaccard_classes(docs, **options)
    met = dealt_join(rows, sets.drop("best"), ["set1", "set2", "n_shingles"], "copies", rows.count(), "left")
    own = [F.col("row")[c].alias(c) for c in names if c not in ("n_shingles", "comp", "component_id", "no_column")]
    lone = F.col("row.doc_id").cast("long") if "doc_id" in names else F.lit(None).cast("long")
    return met.select(*own, "n_shingles", F.coalesce("comp", "rid").alias("comp"), F.when(F.col("comp").isNull(), lone).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each class that links connect: the one with the smallest doc_id (null ones last; of those, the first row read).

    All columns of ``docs`` stay; texts without words are kept; null texts come back empty.
    """
    rows, sets, have, names = jaccard_classes(docs, **options)
    wanted = sets.select(F.col("best").alias("rid")).distinct().unionByName(rows.filter("n_shingles = 0").select("rid"))
    out = T.StructType([*(docs.schema[c] for c in names if c in docs.columns), T.StructField("text", T.StringType())])
    read = have.reader(["ztext", "row"])

    def kept_rows(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for _, part in read(batches):
            for some in slices(part, "ztext", 200, 400_000):
                text = pa.array([unpack.decompress(z).decode() for z in some.column("ztext").to_pylist()], pa.string())
                row = some.column("row")
                yield pa.record_batch([*(row.flatten()[row.type.get_field_index(f.name)] for f in out.fields[:-1]), text], names=out.names)

    return have.tasks(wanted).mapInArrow(lean(kept_rows), out).select(*docs.columns)


def op7_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""
    return with_classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")
