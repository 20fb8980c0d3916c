"""Mixing sources to target weights: fixed-length blocks, drawn by shard, mapped through permutations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, mix64, stored, table

WORD = r"[^\x20\x09-\x0D]+"
SLOTS = "source_no int, block long, epoch int, shard int, slot long"


def targets(sizes: np.ndarray, weights: np.ndarray, share: float, cap: float) -> np.ndarray:
    """Each source's target: ``share`` of all sizes by weight; none above ``cap`` times its size, the excess reshared by weight."""
    out, free, left = np.zeros(len(sizes)), sizes > 0, share * float(sizes.sum())
    while free.any():
        part = left * weights / weights[free].sum()
        over = free & (part > cap * sizes)
        if not over.any():
            out[free] = part[free]
            break
        out[over] = cap * sizes[over]
        left -= float(out[over].sum())
        free &= ~over
    return out


def drawn(slots: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Source counts for each output shard: multinomial draws in the proportions still due, so that totals are exactly ``slots``."""
    rng, left, out = np.random.default_rng(seed), slots.astype(np.int64), np.zeros((shards, len(slots)), np.int64)
    for k in range(shards - 1):
        want = round(int(left.sum()) / (shards - k))
        while want > 0:
            got = np.minimum(rng.multinomial(want, left / left.sum()), left)
            out[k], left, want = out[k] + got, left - got, want - int(got.sum())
    if shards:
        out[shards - 1] = left
    return out


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1: a 4-round Feistel network over the next even power of two, walked until in range."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask, x = np.uint64((1 << int(half)) - 1), index.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> half, x[todo] & mask
        for r in range(4):
            left, right = right, left ^ (mix64(right + np.uint64((key * 4 + r) * 0x9E3779B97F4A7C15 % (1 << 64))) & mask)
        x[todo] = (left << half) | right
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


def mix(docs: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block_words: int = 64, shard_slots: int = 4096, most_shards: int = 1024, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Mix documents by source. Returns (documents, pieces).

    Sources by code point, null last, get ``weights`` in turn; ``targets`` gives their targets. The words of a source, in ascending
    doc_id order, are packed into blocks of ``block_words``. Each output shard draws its source counts; slot j of a source takes
    block permutation_e(j mod blocks), a permutation for each pass e, so no block is taken more than ``ceil(cap)`` times.

    documents: doc_id, size (words; null text: 0), source, source_no, start (of its words in its source), source_size, target.
    pieces: shard, slot, epoch, source_no, block, doc_id, doc_start, word (first word in its document), words.
    Repeated rows count each for itself; a null doc_id comes last in its source; other columns are ignored; an empty table gives
    empty results. The driver holds a row for each source and a count for each (source, shard); shards are ``most_shards`` at most.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    order = [F.col("source").asc_nulls_last(), F.col("doc_id").asc_nulls_last(), F.col("size")]

    def running(batches):
        from pyspark import TaskContext

        part, at, source = TaskContext.get().partitionId(), 0, object()
        for batch in batches:
            sources, sizes = batch.column("source").to_pylist(), batch.column("size").to_pylist()
            starts = []
            for s, n in zip(sources, sizes):
                at, source = (at, source) if s == source else (0, s)
                starts.append(at)
                at += n
            yield pa.record_batch([pa.array([part] * len(starts), pa.int32()), *batch.columns, pa.array(starts, pa.int64())], names=["part", *batch.schema.names, "start"])

    local = stored(sized.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lean(running), "part int, doc_id long, source string, size long, start long"), "layout")
    parts = local.groupBy("part", "source").agg(F.sum("size").alias("size")).collect()
    names = sorted({x.source for x in parts}, key=lambda s: (s is None, s or ""))
    number = {s: i for i, s in enumerate(names)}
    sizes, bases = np.zeros(len(names), np.int64), []
    for x in sorted(parts, key=lambda x: x.part):
        bases.append((x.part, x.source, number[x.source], int(sizes[number[x.source]])))
        sizes[number[x.source]] += x.size
    due = targets(sizes, np.resize(np.array(weights, float), len(names)), share, cap)
    rows = [(*b, int(sizes[b[2]]), float(due[b[2]])) for b in bases]
    base = spark.createDataFrame(rows, "b_part int, b_source string, source_no int, base long, source_size long, target double")
    documents = local.join(base, (F.col("part") == F.col("b_part")) & F.col("source").eqNullSafe(F.col("b_source"))).select("doc_id", "size", "source", "source_no", (F.col("start") + F.col("base")).alias("start"), "source_size", "target")

    blocks = -(-sizes // block_words)
    slots = np.array([min(round(t * b / n), int(cap * b)) if n else 0 for t, b, n in zip(due, blocks, sizes)], np.int64)
    shards = int(max(1, min(most_shards, -(-int(slots.sum()) // shard_slots))))
    counts = drawn(slots, shards, seed)
    before, inside = np.cumsum(counts, 0) - counts, np.cumsum(counts, 1) - counts
    rows = [(int(k), int(s), int(counts[k, s]), int(before[k, s]), int(inside[k, s]), int(counts[k].sum()), int(blocks[s])) for k, s in np.argwhere(counts)]
    plan = spark.createDataFrame(rows, "shard int, source_no int, n long, first long, inside long, in_shard long, blocks long")
    plan = plan.withColumn("skip", F.explode(F.expr("sequence(0L, n - 1, 65536L)"))).repartition(max(1, min(4096, int(slots.sum()) >> 17)))

    def place(batches):
        for batch in batches:
            for x in batch.to_pylist():
                k = np.arange(x["skip"], min(x["n"], x["skip"] + 65536))
                j = x["first"] + k
                epoch, block = j // x["blocks"], np.empty(len(j), np.int64)
                for e in np.unique(epoch):
                    own = epoch == e
                    block[own] = permuted(j[own] % x["blocks"], x["blocks"], (seed << 40) ^ (x["source_no"] << 12) ^ int(e))
                slot = permuted(x["inside"] + k, x["in_shard"], (seed << 41) ^ x["shard"])
                n = len(j)
                yield pa.record_batch([pa.array(np.full(n, x["source_no"]), pa.int32()), pa.array(block), pa.array(epoch, pa.int32()), pa.array(np.full(n, x["shard"]), pa.int32()), pa.array(slot)], names=[c.split()[0] for c in SLOTS.split(", ")])

    placed = plan.mapInArrow(lean(place), SLOTS)
    last = f"(start + size - 1) div {block_words}"
    cut = documents.filter("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {block_words}, {last})")))
    cut = cut.select("source_no", "block", "doc_id", F.col("start").alias("doc_start"), F.expr(f"greatest(block * {block_words} - start, 0L)").alias("word"), F.expr(f"least(start + size, (block + 1) * {block_words}) - greatest(start, block * {block_words})").alias("words"))
    pieces = placed.hint("merge").join(cut, ["source_no", "block"]).select("shard", "slot", "epoch", "source_no", "block", "doc_id", "doc_start", "word", "words")
    return documents, pieces


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: for each document and pass, a row with the words taken, and the document's other columns.

    A document taken whole gives its text as it is; of one taken in part, each stretch of consecutive blocks gives its slice of the
    text, and stretches are joined by a line feed. Texts that are null, empty or without words aren't taken; repeated rows count each
    for itself; columns of any names come back as they are; an empty table gives no rows. A long text is in one task as a whole, with
    the places of its words. A row goes by the shard and slot of its first words: rows are dealt out by a hash of the shard, and lie
    by shard and slot in a partition, those of one slot in the order of the input.
    """
    numbered = stored(docs.select(F.struct(*docs.columns).alias("mix_doc"), F.monotonically_increasing_id().alias("mix_row")), "mix-input")
    documents, pieces = mix(numbered.select(F.col("mix_row").alias("doc_id"), F.col("mix_doc.text").alias("text"), F.col("mix_doc.source").alias("source")), **options)
    taken = pieces.groupBy("doc_id", "epoch").agg(F.sort_array(F.collect_list(F.struct("word", "words"))).alias("spans"), F.sum("words").alias("n"), F.min_by(F.struct("shard", "slot"), "word").alias("place"))
    whole = documents.filter("size > 0").select(F.col("doc_id").alias("mix_row"), "size")
    rows = taken.withColumnRenamed("doc_id", "mix_row").join(whole, "mix_row").join(numbered, "mix_row")
    names, at_text = docs.columns, docs.columns.index("text")

    def cut(batches):
        import re

        word = re.compile(WORD)
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                some, texts = batch.slice(lo, 100), []
                own = some.column("mix_doc").flatten()
                for text, spans, n, size in zip(own[at_text].to_pylist(), *(some.column(c).to_pylist() for c in ("spans", "n", "size"))):
                    if n < size:
                        at, parts, lines = [m.span() for m in word.finditer(text)], [], []
                        for s in spans:
                            if parts and parts[-1][1] == s["word"]:
                                parts[-1][1] += s["words"]
                            else:
                                parts.append([s["word"], s["word"] + s["words"]])
                        text = "\n".join(text[at[a][0] : at[b - 1][1]] for a, b in parts)
                    texts.append(text)
                yield pa.record_batch([pa.array(texts, pa.string()) if i == at_text else x for i, x in enumerate(own)], names=names)

    dealt = rows.select("mix_doc", "spans", "n", "size", "place", "mix_row").repartition("place.shard").sortWithinPartitions("place.shard", "place.slot", "mix_row")
    return dealt.mapInArrow(lean(cut), docs.schema)


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken."""
    documents, pieces = mix(table(spark, sf_dir, "documents"))
    taken = pieces.groupBy("source_no", F.col("doc_start").alias("start")).agg(F.sum("words").alias("n"))
    have = documents.filter("size > 0").join(taken, ["source_no", "start"], "left").unionByName(documents.filter("size = 0").withColumn("n", F.lit(0).cast("long")))
    return have.select("doc_id", "size", "source_size", "target", F.coalesce("n", F.lit(0)).cast("long").alias("taken"))
