"""Near-duplicates by SuperMinHash signatures, banding, verification and union-find.

An element of a set has, for each of the signature's places, a rank: the places in a random order of its own give 0, 1, 2, ..., and a
random fraction is added. A place's component is the smallest rank that any element has there. As an element's ranks for different
places are never alike, components agree with less variance than independent ones would. Signatures are made rank by rank for many
sets at a time; a set is done when all its places are filled with less than the next rank, which for large sets is at once.

Sets that agree on a band of components meet in a cell. Each is compared with the first sets of the cells that it is in most often, and
links found so are united. Sets that cells bring together but links don't are a family: there, components tell which other pairs
may link, and these are verified in the task on the shingles themselves, so no pair that doesn't link leaves it (see ``ngrams``, whose
frame this shares).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, table
from .ngrams import ODD, _groups, with_classes

BANDS, ROWS = 64, 6


def signatures(sets: list[np.ndarray], places: int, dense: int = 6, most: int = 40_000) -> np.ndarray:
    """(sets, places) components of sets of 64-bit hashes, each rank << 32 | fraction; of an empty set all bits are set.

    Up to rank ``dense``, the place an element gives a rank to is found by undoing its earlier swaps; then it has its whole order at
    hand, for ``most`` elements at a time.
    """
    out = np.full((len(sets), places), np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(h) for h in sets])
    h = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    swaps: list[np.ndarray] = []
    for rank in range(min(dense, places)):
        if not len(h):
            return out
        swap, value = _drawn(h, rank, places)
        place = swap
        for i in range(rank - 1, -1, -1):
            place = np.where(swaps[i] == place, i, place)
        _lower(out, owner, place, value)
        swaps.append(swap)
        on = _unfinished(out, rank)[owner]
        if not on.all():
            h, owner, swaps = h[on], owner[on], [s[on] for s in swaps]
    begin = 0
    while begin < len(h):
        end = int(np.searchsorted(owner, owner[min(begin + most, len(h)) - 1], "right"))  # whole sets
        _ranked(out, h[begin:end], owner[begin:end], [s[begin:end] for s in swaps], places)
        begin = end
    return out


def _drawn(h: np.ndarray, rank: int, places: int) -> tuple[np.ndarray, np.ndarray]:
    """For each element the position, ``rank`` or later, that changes places with position ``rank`` of its order; and its rank and fraction."""
    x = mix64(h + np.uint64((rank + 1) * int(ODD[0]) % (1 << 64)))
    swap = rank + ((x >> np.uint64(32)) * np.uint64(places - rank) >> np.uint64(32)).astype(np.int64)
    return swap, np.uint64(rank << 32) | x & np.uint64(0xFFFFFFFF)


def _lower(out: np.ndarray, owner: np.ndarray, place: np.ndarray, value: np.ndarray) -> None:
    flat, at = out.reshape(-1), owner * out.shape[1] + place
    less = value < flat[at]
    np.minimum.at(flat, at[less], value[less])


def _unfinished(out: np.ndarray, rank: int) -> np.ndarray:
    """Sets with a place that the next rank could lower."""
    return out.max(1) >= np.uint64(rank + 1 << 32)


def _ranked(out: np.ndarray, h: np.ndarray, owner: np.ndarray, swaps: list[np.ndarray], places: int) -> None:
    """The ranks after those of ``swaps``, the elements' orders held as a whole."""
    order = np.broadcast_to(np.arange(places, dtype=np.uint16), (len(h), places)).copy()
    row = np.arange(len(h))
    for rank, swap in enumerate(swaps):
        order[row, swap] = order[:, rank]
    for rank in range(len(swaps), places):
        swap, value = _drawn(h, rank, places)
        place = order[row, swap].astype(np.int64)
        order[row, swap] = order[:, rank]
        _lower(out, owner, place, value)
        on = _unfinished(out, rank)[owner]
        if not on.any():
            return
        if on.sum() < 0.7 * len(h):
            h, owner, order = h[on], owner[on], order[on]
            row = np.arange(len(h))


class SignatureIndex:
    """Cells of equal bands, and pairs in a family whose signatures agree on enough components.

    Of linked sets at the very threshold, each component agrees with that probability; they share none of 64 bands of 6 in 4 of 10**9
    cases, and fall six standard deviations short of the agreement expected (of independent components) in 1 of 10**9.
    """

    def __init__(self, threshold: float, bands: int = BANDS, rows: int = ROWS):
        self.threshold, self.bands, self.rows, places = threshold, bands, rows, bands * rows
        self.least = int(places * threshold - 6 * (places * threshold * (1 - threshold)) ** 0.5)

    def sketched(self, sets: list[np.ndarray]) -> tuple[np.ndarray, list[bytes]]:
        """(a row of cells' keys for each set, the last byte of each of its components)."""
        found = signatures(sets, self.bands * self.rows)
        key = np.zeros((len(sets), self.bands), np.uint64)
        for i in range(self.rows):
            key = mix64(key * ODD[0] + found[:, i :: self.rows][:, : self.bands])
        key = mix64(key + np.arange(self.bands, dtype=np.uint64) * ODD[2])
        return key, [x.tobytes() for x in (found & np.uint64(0xFF)).astype(np.uint8)]

    def joined(self, forest: bool, keys: list[str]):
        """Links (u, v, similarity) of a task's groups, which come sorted by ``keys``, between sets that ask and others of other components.

        Rows have node, comp, apart, asks, corner and hashes. Two sets apart, each of which asks for the other, are compared once.
        """
        least, threshold = self.least, self.threshold

        def run(batches):
            for _, c in _groups(batches, keys):
                node, comp, apart, asks = (np.array(c[k]) for k in ("node", "comp", "apart", "asks"))
                marks = np.stack([np.frombuffer(x, np.uint8) for x in c["corner"]])
                sets = [np.frombuffer(x, np.uint64) for x in c["hashes"]]
                size = np.array([len(x) for x in sets])
                others = np.flatnonzero(~asks)
                out = []
                for i in np.flatnonzero(asks):
                    j = others[(comp[others] != comp[i]) & (~apart[others] | (node[others] > node[i]))]
                    j = j[np.minimum(size[j], size[i]) >= threshold * np.maximum(size[j], size[i]) - 1e-9]
                    for k in j[(marks[j] == marks[i]).sum(1) >= least]:
                        both = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
                        either = size[i] + size[k] - both
                        if both >= threshold * either - 1e-9:
                            out.append((min(node[i], node[k]), max(node[i], node[k]), both / either))
                if out:
                    u, v, alike = zip(*out)
                    yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(alike, pa.float64())], names=["u", "v", "over"])

        return run


def near_duplicates(docs: DataFrame, threshold: float = 0.8, words: int = 2, bands: int = BANDS, rows: int = ROWS, **options) -> DataFrame:
    """``docs`` without text, and n_shingles, comp, component_id and kept in place of columns of these names.

    Documents link whose sets of ``words``-word shingles have a Jaccard similarity of ``threshold`` or more, confirmed on the whole
    sets; component_id is the smallest doc_id that links reach, and kept tells whether it is the row's own. Words are runs of other
    characters than space, tab, line feed, vertical tab, form feed and carriage return, A-Z in lower case; with fewer words than
    ``words`` the whole sequence is one shingle. Null, empty and blank texts have no shingles, link with nothing and are kept; rows
    of equal texts are of one class, and repeated rows with the smallest doc_id are all kept; a null doc_id is never the smallest,
    and such a row is kept if no row of its class has an id; an empty table gives no rows; long texts are hashed in stretches.
    """
    found = with_classes(docs.drop("kept"), threshold=threshold, words=words, index=SignatureIndex(threshold, bands, rows), **options)
    own = F.col("doc_id").cast("long") if "doc_id" in docs.columns else F.lit(None).cast("long")
    return found.withColumn("kept", own.eqNullSafe(F.col("component_id")))


def op13_superminhash(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", "kept")
