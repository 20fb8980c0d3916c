"""Operators on scripts (ordered turns and lines): near repeats, contexts, quotes, chunks, alignment, contracts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pairing import blocks, common_pairs, ratio

WORD = r"[\p{L}\p{N}_']+"


def each_row(batch, *names: str, some: int = 64):
    """Rows of columns as Python values, a few at a time: a batch's words are many times larger as Python strings."""
    for at in range(0, batch.num_rows, some):
        part = batch.slice(at, some)
        yield from zip(*(part.column(c).to_pylist() for c in names))


def adjacent_near_repeats(rows: DataFrame, keys: list[str], pos: str, text: str, least: float, words: int) -> DataFrame:
    """Rows whose words nearly repeat those of the row before: keys, pos, ratio.

    The ratio is 2 * common / total words, common the length of a longest common subsequence; it is ``least`` or more, and both sides have
    ``words`` words at least. Null texts have no words.
    """
    w = Window.partitionBy(*keys).orderBy(pos)
    listed = rows.select(*keys, pos, F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)).alias("b"))
    both = listed.withColumn("a", F.lag("b").over(w)).filter((F.size("a") >= words) & (F.size("b") >= words))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            alike = [ratio(a, b, least) for a, b in each_row(batch, "a", "b")]
            yield pa.record_batch([*(batch.column(c) for c in (*keys, pos)), pa.array(alike, pa.float64())], names=[*keys, pos, "ratio"])

    schema = T.StructType([*(rows.schema[c] for c in (*keys, pos)), T.StructField("ratio", T.DoubleType())])
    return both.mapInArrow(run, schema).filter(F.col("ratio") >= least).withColumn("ratio", F.round("ratio", 6))


def widened(rows: DataFrame, keys: list[str], pos: str, name: str, most_before: int, most_after: int) -> DataFrame:
    """How far a row's context reaches (before, after): as far as the nearest row of another name, on either side, or the caps.

    A row's run of one name tells how far that is, so nothing is widened step by step. ``pos`` counts rows from 1.
    """
    w = Window.partitionBy(*keys).orderBy(pos)
    other = lambda x: ~F.col(name).eqNullSafe(x)
    edges = rows.withColumn("_s", F.when(other(F.lag(name).over(w)) | (F.col(pos) == 1), F.col(pos))).withColumn("_n", F.max(pos).over(Window.partitionBy(*keys)))
    edges = edges.withColumn("_e", F.when(other(F.lead(name).over(w)) | (F.col(pos) == F.col("_n")), F.col(pos)))
    edges = edges.withColumn("_a", F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_b", F.min("_e").over(w.rowsBetween(0, Window.unboundedFollowing)))
    back, ahead = F.when(F.col("_a") > 1, F.col(pos) - F.col("_a") + 1), F.when(F.col("_b") < F.col("_n"), F.col("_b") - F.col(pos) + 1)
    reach = F.least(back, ahead)  # least skips nulls
    out = edges.withColumn("before", F.least(F.coalesce(reach, F.lit(most_before)), F.lit(most_before)).cast("int")).withColumn("after", F.least(F.coalesce(reach, F.lit(most_after)), F.lit(most_after)).cast("int"))
    return out.drop("_s", "_e", "_a", "_b", "_n")


def lines(rows: DataFrame, text: str) -> DataFrame:
    """A row for each line: pos, line."""
    return rows.select(*[c for c in rows.columns if c != text], F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def quote_state(rows: DataFrame, keys: list[str], pos: str, line: str) -> DataFrame:
    """Adds marks (quotation marks in the line) and before (in all lines before it): odd where the line starts inside a quote."""
    marks = F.length(line) - F.length(F.regexp_replace(line, '"', ""))
    before = F.sum("marks").over(Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("marks", marks).withColumn("before", F.coalesce(before, F.lit(0)))


def chunked(text: str, most: int) -> list[tuple[str, bool]]:
    """(chunk, goes on in the next one): paragraphs packed greedily up to ``most`` characters; longer ones are cut at sentences, then words, then anywhere."""

    def pieces(x: str, cuts: tuple) -> list[str]:
        if len(x) <= most:
            return [x]
        if not cuts:
            return [x[i : i + most] for i in range(0, len(x), most)]
        return [z for y in re.split(cuts[0], x) if y for z in pieces(y, cuts[1:])]

    out: list[list] = []
    for paragraph in re.split(r"\n\s*\n", text):
        if not paragraph.strip():
            continue
        parts = pieces(paragraph.strip(), (r"(?<=[.!?])\s+", r"\s+"))
        for i, part in enumerate(parts):
            glue = " " if i else "\n\n"
            if out and len(out[-1][0]) + len(glue) + len(part) <= most:
                out[-1][0] += glue + part
            else:
                if out and i:
                    out[-1][1] = True
                out.append([part, False])
    return [tuple(x) for x in out]


def packed_chunks(docs: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """Chunks of at most ``most`` characters: key, chunk, length, continues, digest. Texts without a word have none."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        kinds = (pa.int32(), pa.int64(), pa.bool_(), pa.string())
        for batch in batches:
            of, rows = [], []
            for i, x in enumerate(batch.column(text).to_pylist()):
                for n, (chunk, more) in enumerate(chunked(x or "", most)):
                    of.append(i)
                    rows.append((n, len(chunk), more, hashlib.md5(chunk.encode()).hexdigest()))
            columns = zip(*rows) if rows else [()] * 4
            yield pa.record_batch([batch.column(key).take(pa.array(of, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[key, "chunk", "length", "continues", "digest"])

    schema = T.StructType([docs.schema[key], *T._parse_datatype_string("chunk int, length long, continues boolean, digest string")])
    return docs.select(key, text).mapInArrow(run, schema)


def midpoint(docs: DataFrame, key: str, text: str, mark: str, least: int) -> DataFrame:
    """Where to cut a text in two: after the ``mark`` nearest its middle that leaves ``least`` characters on each side: key, n, cut."""
    parts = docs.select(key, F.length(text).alias("n"), F.split(text, re.escape(mark)).alias("p")).select(key, "n", F.size("p").alias("m"), F.posexplode("p").alias("i", "part"))
    at = F.sum(F.length("part") + len(mark)).over(Window.partitionBy(key).orderBy("i"))
    cuts = parts.withColumn("at", at).filter((F.col("i") < F.col("m") - 1) & (F.col("at") >= least) & (F.col("n") - F.col("at") >= least))
    best = F.min(F.struct(F.abs(F.col("at") - F.col("n") / 2.0).alias("off"), "at")).alias("best")
    return cuts.groupBy(key).agg(F.max("n").cast("long").alias("n"), best).select(key, "n", F.col("best.at").alias("cut"))


def length_batches(rows: DataFrame, size: str, ids: list[str], most: int, ratio: float) -> DataFrame:
    """Adds batch: rows of about one length together, at most ``most``, the longest at most ``ratio`` times the shortest.

    Rows of a band of lengths (a power of ``ratio``) are of like length, so a band's rows, dealt to ``most`` by their number in
    the band, make the batches. Numbers come from counts by (band, length) and positions in one length.
    """
    band = F.floor(F.log(F.greatest(F.col(size), F.lit(1))) / F.log(F.lit(ratio))).cast("int")
    w = Window.partitionBy("band", size).orderBy(*ids)
    placed = rows.withColumn("band", band).withColumn("_k", F.row_number().over(w) - 1)
    counts = placed.groupBy("band", size).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("band").orderBy(size).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    numbered = placed.join(before, ["band", size])
    return numbered.withColumn("batch", F.concat_ws(".", F.col("band").cast("string"), F.floor((F.col("_before") + F.col("_k")) / most).cast("string"))).select(*ids, size, "batch")


def bridged(rows: DataFrame, keys: list[str], order: list[str], who: str, at: str, gap: int) -> DataFrame:
    """Turns: runs of one ``who`` without a gap of over ``gap``: keys, who, run, length (last less first), n."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = (~F.col(who).eqNullSafe(F.lag(who).over(w))) | (F.col(at) - F.lag(at).over(w) > gap)
    runs = rows.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, who, "run").agg((F.max(at) - F.min(at)).alias("length"), F.count("*").alias("n"))


def nearest_equal(rows: DataFrame, content: Column, key: str) -> DataFrame:
    """Adds other: the nearest key with equal content (the smaller, if two are as near); rows that nothing equals go. Keys are numbers."""
    w = Window.partitionBy("_k").orderBy(key)
    sides = rows.withColumn("_k", content).withColumn("_a", F.lag(key).over(w)).withColumn("_b", F.lead(key).over(w)).filter("_a IS NOT NULL OR _b IS NOT NULL")
    nearer = F.when(F.col("_b").isNull() | (F.col(key) - F.col("_a") <= F.col("_b") - F.col(key)), F.col("_a")).otherwise(F.col("_b"))
    return sides.withColumn("other", nearer).drop("_k", "_a", "_b")


def aligned(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Align two texts' words by a longest common subsequence: adds equal, replaced, deleted, inserted (words; of replaced ones the larger side) and blocks."""
    words = lambda c: F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(WORD), F.lit(0))
    names, own = ["equal", "replaced", "deleted", "inserted", "blocks"], rows.columns

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [alignment(x, y) for x, y in zip(batch.column("_a").to_pylist(), batch.column("_b").to_pylist())]
            columns = [pa.array(c, pa.int64()) for c in zip(*found)] if found else [pa.array([], pa.int64())] * 5
            yield pa.record_batch([*(batch.column(c) for c in own), *columns], names=[*own, *names])

    return rows.withColumn("_a", words(a)).withColumn("_b", words(b)).mapInArrow(run, T.StructType([*rows.schema, *[T.StructField(n, T.LongType()) for n in names]]))


def alignment(a: list[str], b: list[str]) -> tuple[int, int, int, int, int]:
    """(equal, replaced, deleted, inserted, blocks) about the blocks of a longest common subsequence; between two, what both sides have is replaced."""
    equal, replaced, deleted, inserted, i, j = 0, 0, 0, 0, 0, 0
    found = blocks(common_pairs(a, b))
    for x, y, n in [*found, (len(a), len(b), 0)]:
        gone, new = x - i, y - j
        if gone and new:
            replaced += max(gone, new)
        else:
            deleted, inserted = deleted + gone, inserted + new
        equal, i, j = equal + n, x + n, y + n
    return equal, replaced, deleted, inserted, len(found)


def missing(a: list[str], b: list[str], least: int, top: int) -> list[tuple[int, int]]:
    """(start, length) of the longest runs of ``a`` between blocks that it has in common with ``b``, of ``least`` words or more."""
    found, runs, i = blocks(common_pairs(a, b)), [], 0
    for x, _, n in [*found, (len(a), len(b), 0)]:
        if x - i >= least:
            runs.append((i, x - i))
        i = x + n
    return sorted(runs, key=lambda x: (-x[1], x[0]))[:top]


def missing_spans(rows: DataFrame, key: str, a: str, b: str, least: int, top: int) -> DataFrame:
    """The longest spans of words of ``a`` that are missing from ``b``: key, rank, start, length. Words equal at both ends are cut off first."""
    words = lambda c: F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(WORD), F.lit(0))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            of, out = [], []
            for i, (x, y) in enumerate(each_row(batch, "_a", "_b")):
                k = next((n for n, (u, v) in enumerate(zip(x, y)) if u != v), min(len(x), len(y)))
                for rank, (start, length) in enumerate(missing(x[k:], y[k:], least, top), 1):
                    of.append(i)
                    out.append((rank, start + k, length))
            columns = zip(*out) if out else [()] * 3
            yield pa.record_batch([batch.column(key).take(pa.array(of, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64())))], names=[key, "rank", "start", "length"])

    schema = T.StructType([rows.schema[key], *T._parse_datatype_string("rank int, start long, length long")])
    return rows.select(key, words(a).alias("_a"), words(b).alias("_b")).mapInArrow(run, schema)


def picked_source(docs: DataFrame, key: str, source: str, text: str, least: int, margin: float) -> DataFrame:
    """The source whose vocabulary holds most of a document's distinct words, if it leads by ``margin``: key, pick, score.

    A source's vocabulary is what ``least`` of its documents say. Each word has one row with its sources, so a document's words are
    joined once, whatever the number of documents that share them.
    """
    words = docs.select(key, source, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)))).alias("w"))
    said = words.filter(F.col(source).isNotNull()).groupBy("w", source).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    lists = said.groupBy("w").agg(F.collect_set(source).alias("sources"))
    hits = words.select(key, "w").join(lists, "w").select(key, F.explode("sources").alias("pick")).groupBy(key, "pick").agg(F.count("*").alias("n"))
    total = words.groupBy(key).agg(F.count("*").alias("total"))
    scored = hits.join(total, key).withColumn("score", F.col("n") / F.col("total"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "pick"))
    top = scored.withColumn("place", place).filter("place <= 2").groupBy(key).agg(F.max(F.when(F.col("place") == 1, F.col("pick"))).alias("pick"), F.max(F.when(F.col("place") == 1, F.col("score"))).alias("score"), F.coalesce(F.max(F.when(F.col("place") == 2, F.col("score"))), F.lit(0.0)).alias("next"))
    return top.select(key, F.when(F.col("score") - F.col("next") >= margin, F.col("pick")).alias("pick"), F.round(F.col("score") + 1e-9, 6).alias("score"))


def usual_label(rows: DataFrame, key: str, label: str) -> DataFrame:
    """Adds usual (the most frequent label of rows with this key; of equally frequent ones the first) and labelled (rows that have one)."""
    counts = rows.filter(F.col(label).isNotNull()).groupBy(key, label).agg(F.count("*").alias("n"))
    best = counts.groupBy(key).agg(F.max_by(label, F.struct("n", -F.ascii(label))).alias("usual"), F.sum("n").alias("labelled"))
    return rows.join(best, key, "left").withColumn("labelled", F.coalesce("labelled", F.lit(0)))


def argmax_or_none(scores: DataFrame, keys: list[str], choice: str, score: str) -> DataFrame:
    """The choice with the highest score, null where several have it; and how many do."""
    best = scores.groupBy(*keys).agg(F.max(score).alias("_best"))
    top = scores.join(best, keys).filter(F.col(score) == F.col("_best")).groupBy(*keys)
    return top.agg(F.when(F.count("*") == 1, F.min(choice)).alias("choice"), F.count("*").alias("tied"))


def last_mentions(docs: DataFrame, key: str, text: str, name: str, most: int) -> DataFrame:
    """The names (words that match ``name``) that a text mentions, the last mentioned first, ``most`` of them: key, recent."""
    words = docs.select(key, F.posexplode(F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0))).alias("pos", "w")).filter(F.col("w").rlike(name))
    last = words.groupBy(key, "w").agg(F.max("pos").alias("last"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("last")))
    top = last.withColumn("place", place).filter(F.col("place") <= most)
    return top.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "w"))), lambda x: x["w"]), ",").alias("recent"))


def quoted_share(x: Column) -> Column:
    """Share of a text's characters in quotes, marks included; 0 for an empty text."""
    return F.when(F.length(x) == 0, 0.0).otherwise((F.length(x) - F.length(F.regexp_replace(x, '"[^"]*"', ""))) / F.length(x))


def scattered(x: Column, y: Column) -> Column:
    """Share of x's characters that y has too, wherever they stand, each as often as both have it."""
    a, b = F.split(x, ""), F.split(y, "")
    count = lambda chars, k: F.size(F.filter(chars, lambda z: z == k))
    met = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, k: s + F.least(count(a, k), count(b, k)))
    return met / F.size(a)


def reference_similarity(vectors: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """Median cosine (to thousandths, the lower one) of a group's vectors and its first one: group, median, n. Counted by value, so no group is sorted."""
    v = vectors.filter(F.col(vector).isNotNull()).select(group, key, F.col(vector).cast("array<double>").alias("v"))
    first = v.groupBy(group).agg(F.min_by("v", key).alias("ref"), F.min(key).alias("ref_key"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    cosine = dot(F.col("v"), F.col("ref")) / (F.sqrt(dot(F.col("v"), F.col("v"))) * F.sqrt(dot(F.col("ref"), F.col("ref"))))
    counted = v.join(first, group).filter(F.col(key) != F.col("ref_key")).groupBy(group, (F.floor(cosine * 1000 + 1e-7) / 1000).alias("s")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(group)
    upto = counted.withColumn("upto", F.sum("n").over(w.orderBy("s"))).withColumn("total", F.sum("n").over(w))
    return upto.groupBy(group).agg(F.round(F.min(F.when(2 * F.col("upto") >= F.col("total"), F.col("s"))), 3).alias("median"), F.max("total").alias("n"))


def row_contract(rows: DataFrame, keys: list[str], known: DataFrame, good: Column) -> DataFrame:
    """Findings of a row contract with their counts: keys met twice, rows whose parent isn't known, rows that aren't good."""
    one = lambda df, finding: df.agg(F.count("*").alias("n")).select(F.lit(finding).alias("finding"), "n")
    twice = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    return one(twice, "duplicate").unionByName(one(rows.join(known, known.columns, "left_anti"), "foreign")).unionByName(one(rows.filter(~good), "damaged"))


def mentioned(forms: DataFrame, form: str, docs: DataFrame, text: str) -> DataFrame:
    """Forms that stand as a word in any text."""
    said = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)))).alias(form)).distinct()
    return forms.join(said, form, "left_semi")


def kept_aliases(rows: DataFrame, who: str, said: str, alias: str, groups: list[str]) -> DataFrame:
    """Without names said of themselves, and without groups and the narrator."""
    return rows.filter((F.lower(who) != F.lower(said)) & ~F.lower(alias).isin(groups))


def by_priority(evidence: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """(the first value that there is, or unknown; the name of the evidence it comes from, or none)."""
    name = F.lit("none")
    for kind, value in reversed(evidence):
        name = F.when(value.isNotNull(), kind).otherwise(name)
    return F.coalesce(*[v for _, v in evidence], F.lit("unknown")), name


def introduced(rows: DataFrame, a: str, b: str, mark: str = "�", most: float = 0.005) -> DataFrame:
    """Adds introduced (b's characters that a lacks, in order) and acceptable (the replacement mark makes up at most ``most`` of b)."""
    chars = lambda c: F.filter(F.array_distinct(F.split(c, "")), lambda x: x != "")
    load = F.length(b) - F.length(F.regexp_replace(b, mark, ""))
    return rows.withColumn("introduced", F.array_join(F.array_sort(F.array_except(chars(b), chars(a))), "")).withColumn("acceptable", load <= most * F.length(b))
