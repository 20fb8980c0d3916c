"""The prefix trie of conversations, by radix partitioning on coded turns.

Turns are coded by a dictionary, so a conversation is a string of numbers. Equal conversations are a *class* and are sorted once.
Sorting by the most significant digit first makes the trie: what shares its first d turns lies together and is a node. A group of
many classes is partitioned by Spark: what all of it shares is skipped (a chain of nodes), the next turn deals it out, and so on until
groups are small. Small groups are finished by multikey quicksort, a group in a task, and the recursion gives the nodes. What nodes sum
over their subtrees then goes up the partitioned levels.

Strings are cut into segments of some hundred turns. As long as classes share whole segments, the trie of the next ones hangs on the
last; beyond, a class's turns are a path of their own, and no task has to hold a conversation.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dealt_join, lean, stored, table
from .ngrams import _groups

NODE = "key string, root boolean, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends long"
OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
NOBODY = hashlib.sha256(b"").hexdigest()


def coded(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), id, size of each turn: its number in the dictionary of (role, text), and its text's bytes in UTF-8.

    Turns stand in order of ``turn``, null first, equal ones by a digest of role and text; so a long conversation is sorted by as many
    tasks as it takes. Texts aren't shuffled.
    """
    spark = turns.sparkSession
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, 16)
    rows = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    rows = stored(rows.withColumn("salt", F.monotonically_increasing_id()), "turns")
    words = stored(rows.groupBy("digest").agg(F.count("*").alias("times")).withColumn("id", F.monotonically_increasing_id()), "dictionary")
    order, n = ["conv_id", "turn", "digest", "salt"], rows.count()
    ranged = dealt_join(rows, words, ["digest"], "times", n).repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), *order).sortWithinPartitions(*order)
    ranged = stored(ranged.select("conv_id", "id", "size", F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("at")), "ranged", instead_of=rows)
    spans = ranged.groupBy("conv_id", "pid").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("conv_id", "pid", (F.col("first") - before).alias("first"))
    return ranged.join(spans, ["conv_id", "pid"]).select("conv_id", (F.col("at") - F.col("first")).alias("pos"), "id", "size")


def rebuilt(turns: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, id, size) of conversations that begin as their group's first does, and (conv_id) of all, those without turns too.

    ``turns`` is as ``coded`` gives them. The first h turns come from conversation c - c % ``group`` (all if it has fewer, none if it
    isn't there), the others are c's own after its first h; h is the unsigned crc32 of decimal c, modulo ``most``.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = stored(turns.groupBy("conv_id").agg(F.count("*").alias("times")).withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % group}), "conversations")
    taken = convs.join(convs.select(F.col("conv_id").alias("base"), F.col("times").alias("has")), "base", "left").withColumn("k", F.least("h", F.coalesce("has", F.lit(0))))
    taken = stored(taken.select("conv_id", "base", "h", "k", "times"), "taken")
    own = dealt_join(turns, taken.select("conv_id", "h", "k", "times"), ["conv_id"], "times", turns.count())
    own = own.filter("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "id", "size")
    heads = turns.filter(F.col("pos") < most).withColumnRenamed("conv_id", "base")
    first = heads.join(taken.filter("k > 0").select("conv_id", "base", "k"), "base").filter("pos < k").select("conv_id", "pos", "id", "size")
    return own.unionByName(first), convs.select("conv_id")


def sorted_out(ids: list[np.ndarray], depth: int, rows: np.ndarray):
    """Multikey quicksort of ``rows`` by the turn at ``depth``, three ways: (rows of equal turns), in order."""
    todo = [rows]
    while todo:
        own = todo.pop()
        if len(own) < 2:
            if len(own):
                yield own
            continue
        x = np.array([ids[i][depth] for i in own])
        if len(own) <= 64:
            by = np.argsort(x, kind="stable")
            yield from np.split(own[by], np.flatnonzero(np.diff(x[by])) + 1)
            continue
        pivot = x[len(x) // 2]
        less, same = x < pivot, x == pivot
        if same.all():
            yield own
            continue
        todo += [own[~less & ~same], own[same], own[less]]


def local_trie(c: dict) -> dict:
    """Nodes of one group: lists by column, the group's own node first.

    ``c`` has for each class what is left of its turns (ids, sizes), n (conversations), conv (the smallest), ends (its number if it ends
    there, null if it goes on in the next segment) and what hangs below there (kids, leaves, saved); and the group's depth and size.
    """
    ids, sizes = ([np.asarray(x, np.int64) for x in c[k]] for k in ("ids", "sizes"))
    n, conv, long = np.array(c["n"], np.int64), np.array(c["conv"], np.int64), np.array([len(x) for x in ids])
    nodes: list[list] = []  # depth, conv, parent's place, n, kids, leaves, saved, ends
    paths: list[tuple] = []  # what is left of single classes: (class, depth, parent's place)

    def node(depth: int, rows: np.ndarray, size: int, parent: int) -> int:
        total = int(n[rows].sum())
        nodes.append([depth, int(conv[rows].min()), parent, total, 0, 0, (total - 1) * size, None])
        return len(nodes) - 1

    todo = [(node(0, np.arange(len(ids)), c["size"][0], -1), np.arange(len(ids)), 0)]
    while todo:
        at, rows, depth = todo.pop()
        over = rows[long[rows] == depth]
        for i in over:  # one, as classes are distinct
            nodes[at][4] += c["kids"][i]
            nodes[at][5] += c["leaves"][i]
            nodes[at][6] += c["saved"][i]
            nodes[at][7] = c["ends"][i]
        for own in sorted_out(ids, depth, rows[long[rows] > depth]):
            nodes[at][4] += 1
            if len(own) == 1:
                paths.append((int(own[0]), depth, at))
            else:
                todo.append((node(depth + 1, own, int(sizes[own[0]][depth]), at), own, depth + 1))
    out: dict[str, list] = {k: [] for k in ("depth", "conv", "parent", "n", "kids", "leaves", "saved", "ends")}
    for i, depth, at in paths:
        weight = (n[i] - 1) * sizes[i][depth:]
        saved, m = np.cumsum(weight[::-1])[::-1] + c["saved"][i], len(weight)
        nodes[at][5] += (leaves := c["leaves"][i] or int(c["kids"][i] == 0))
        nodes[at][6] += int(saved[0])
        columns = (range(depth + 1, depth + 1 + m), [int(conv[i])] * m, [nodes[at][1]] + [int(conv[i])] * (m - 1), [int(n[i])] * m, [1] * (m - 1) + [c["kids"][i]], [leaves] * m, saved.tolist(), [None] * (m - 1) + [c["ends"][i]])
        for k, x in zip(out, columns):
            out[k].extend(x)
    for x in reversed(nodes):  # children stand after their parent
        x[5] = x[5] or int(x[4] == 0)
        if x[2] >= 0:
            nodes[x[2]][5] += x[5]
            nodes[x[2]][6] += x[6]
    for x in nodes:
        x[2] = nodes[x[2]][1] if x[2] >= 0 else None
    top = c["depth"][0]
    merged = {k: [x[j] for x in nodes] + out[k] for j, k in enumerate(out)}
    merged["depth"] = [top + d for d in merged["depth"]]
    return merged


def _local(batches):
    """Nodes of a task's groups, which come sorted by key."""
    for (key,), c in _groups(batches, ["key"]):
        t = local_trie(c)
        m = len(t["depth"])
        columns = [[key] * m, [True] + [False] * (m - 1), t["depth"], t["conv"], t["parent"], t["n"], t["kids"], t["leaves"], t["saved"], t["ends"]]
        kinds = [pa.string(), pa.bool_(), *[pa.int64()] * 8]
        yield pa.record_batch([pa.array(x, kind) for x, kind in zip(columns, kinds)], names=[f.split()[0] for f in NODE.split(", ")])


def grown(items: DataFrame, most: int = 4096) -> DataFrame:
    """Nodes (columns of NODE) of the tries of ``items``, a trie for each key; ``root`` marks a trie's own node, its parent null.

    ``items`` has key, depth and size (of the key's node), ids, sizes, n, conv, ends, kids, leaves, saved (see ``local_trie``), and no
    sequence twice under a key. Keys with over ``most`` items are partitioned by their next turn, until none is left.
    """
    rest, levels, done = stored(items, "items"), [], None
    while True:
        # what groups share: as far as their first and last sequence agree
        groups = rest.groupBy("key").agg(F.count("*").alias("times"), F.sum("n").alias("n"), F.min("conv").alias("conv"), F.max("depth").alias("depth"), F.max("size").alias("size"))
        groups = stored(groups.filter(F.col("times") > most), "groups")
        if groups.isEmpty():
            last = rest
            break
        total = rest.count()
        met = stored(dealt_join(rest, groups.select("key", F.lit(True).alias("large"), "times"), ["key"], "times", total, "left"), "met")
        small = met.filter("large IS NULL").drop("large")
        done = small if done is None else done.unionByName(small)
        met = met.filter("large").drop("large")
        ends = met.groupBy("key").agg(F.min(F.struct("ids", "sizes")).alias("low"), F.max("ids").alias("high"))
        differ = F.expr("array_position(zip_with(slice(low.ids, 1, least(size(low.ids), size(high))), slice(high, 1, least(size(low.ids), size(high))), (a, b) -> a = b), false)")
        ends = ends.select("key", F.when(differ > 0, differ - 1).otherwise(F.expr("least(size(low.ids), size(high))")).cast("int").alias("shared"), F.col("low.sizes").alias("chain"))
        groups = stored(groups.join(ends.select("key", "shared", F.slice("chain", F.lit(1), F.col("shared")).alias("chain")), "key"), "groups")
        cut = dealt_join(met, groups.select("key", "shared", "times"), ["key"], "times", total)
        over = cut.filter("size(ids) = shared").select("key", "ends", "kids", "leaves", "saved")
        level = stored(groups.join(over, "key", "left"), "level")
        after = F.col("shared") + 2
        rest = stored(
            cut.filter("size(ids) > shared").select(
                F.md5(F.concat_ws("/", "key", F.element_at("ids", F.col("shared") + 1)).cast("binary")).alias("key"), F.col("key").alias("parent"), (F.col("depth") + F.col("shared") + 1).alias("depth"), F.element_at("sizes", F.col("shared") + 1).alias("size"),
                F.slice("ids", after, F.size("ids")).alias("ids"), F.slice("sizes", after, F.size("ids")).alias("sizes"), "n", "conv", "ends", "kids", "leaves", "saved",
            ),
            "rest",
        )
        levels.append((level, stored(rest.groupBy("key").agg(F.first("parent").alias("parent"), F.count("*").alias("times")), "parents")))
        rest = rest.drop("parent")
    done = last if done is None else done.unionByName(last.select(*done.columns))
    nodes = stored(done.repartition("key").sortWithinPartitions("key").mapInArrow(lean(_local), NODE), "local-nodes")
    for level, parents in reversed(levels):
        tops = nodes.filter("root").join(parents.select("key", "parent"), "key").select("key", "parent", F.col("n_leaves").alias("l"), F.col("saved_tokens").alias("s"))
        below = tops.groupBy("parent").agg(F.count("*").alias("c"), F.sum("l").alias("l"), F.sum("s").alias("s")).withColumnRenamed("parent", "key")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        of = stored(level.join(below, "key").withColumns({"kids": zero("kids") + F.col("c"), "leaves": zero("leaves") + F.col("l"), "saved": zero("saved") + F.col("s"), "sizes": F.concat(F.array("size"), "chain")}), "large")
        # the group's own node and its chain, the branching node last
        place = of.select("*", F.posexplode("sizes").alias("i", "bytes"))
        later = F.expr("aggregate(slice(sizes, i + 1, size(sizes)), 0L, (a, x) -> a + x)")
        tail = F.col("i") == F.col("shared")
        chain = place.select(
            "key", (F.col("i") == 0).alias("root"), (F.col("depth") + F.col("i")).alias("depth"), F.col("conv").alias("conv_id"), F.when(F.col("i") > 0, F.col("conv")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
            F.when(tail, F.col("kids")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("saved") + (F.col("n") - 1) * later).alias("saved_tokens"), F.when(tail, F.col("ends")).alias("ends"),
        )
        # tops now know their parent, and are the tops of nothing that is still to come
        named = dealt_join(nodes.filter("root").join(parents.select("key", "parent"), "key"), of.select(F.col("key").alias("parent"), F.col("conv").alias("p"), F.col("c").alias("times")), ["parent"], "times", parents.count())
        named = named.drop("parent_conv_id").withColumnRenamed("p", "parent_conv_id").withColumn("root", F.lit(False))
        older = nodes.filter("root").join(parents.select("key"), "key", "left_anti")
        columns = [f.split()[0] for f in NODE.split(", ")]
        parts = [x.select(*columns) for x in (nodes.filter("NOT root"), older, named, chain)]
        nodes = stored(reduce(DataFrame.unionByName, parts), "nodes", instead_of=nodes)
    return nodes


def digests_of_members(members: DataFrame) -> DataFrame:
    """rep, ends_sha256 of classes: the sha256 of their conversations' decimal ids, in order, joined by commas.

    ``members`` has rep, conv_id, n. Ids are joined by the tasks that have them in order, then a class's pieces are hashed one after the other.
    """
    lone = members.filter("n = 1").select("rep", F.sha2(F.col("conv_id").cast("string").cast("binary"), 256).alias("ends_sha256"))
    spark = members.sparkSession
    ranged = members.filter("n > 1").repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "rep", "conv_id").sortWithinPartitions("rep", "conv_id").select("rep", "conv_id")

    def joined(batches):
        for batch in batches:
            rep, conv = (batch.column(c).to_numpy() for c in ("rep", "conv_id"))
            begin = np.flatnonzero(np.concatenate([[True], rep[1:] != rep[:-1]])) if len(rep) else np.zeros(0, int)
            end = np.append(begin[1:], len(rep))
            text = [",".join(map(str, conv[i:j].tolist())) for i, j in zip(begin, end)]
            yield pa.record_batch([pa.array(rep[begin]), pa.array(conv[begin]), pa.array(text, pa.string())], names=["rep", "first", "part"])

    def hashed(batches):
        rep, state = None, None
        for batch in batches:
            out = []
            for r, part in zip(batch.column("rep").to_pylist(), batch.column("part").to_pylist()):
                if r != rep:
                    if state is not None:
                        out.append((rep, state.hexdigest()))
                    rep, state = r, hashlib.sha256(part.encode())
                else:
                    state.update(b"," + part.encode())
            yield pa.record_batch([pa.array([r for r, _ in out], pa.int64()), pa.array([d for _, d in out], pa.string())], names=["rep", "ends_sha256"])
        if state is not None:
            yield pa.record_batch([pa.array([rep], pa.int64()), pa.array([state.hexdigest()])], names=["rep", "ends_sha256"])

    parts = ranged.mapInArrow(lean(joined), "rep long, first long, part string").repartition("rep").sortWithinPartitions("rep", "first")
    return lone.unionByName(parts.mapInArrow(lean(hashed), "rep long, ends_sha256 string"))


def prefix_trie(turns: DataFrame, convs: DataFrame, segment: int = 512, most: int = 4096) -> DataFrame:
    """The trie's nodes: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` has conv_id, pos, id, size, ``convs`` the conv_id of all conversations; those without turns are members of the root. Without
    conversations there are no nodes.
    """
    one = F.struct("pos", "id", "size")
    rows = turns.withColumn("seg", F.floor(F.col("pos") / segment)).groupBy("conv_id", "seg").agg(F.sort_array(F.collect_list(one)).alias("x"))
    rows = rows.select("conv_id", "seg", F.col("x.id").alias("ids"), F.col("x.size").alias("sizes"))
    rows = stored(rows.withColumn("digest", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256)), "segments")
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("seg", "digest"))).alias("x"), F.sum(F.size("ids")).alias("n_turns"))
    whole = convs.join(whole.select("conv_id", F.col("x.digest").alias("path"), "n_turns"), "conv_id", "left")
    whole = stored(whole.select("conv_id", F.coalesce("path", F.expr("array()").cast("array<string>")).alias("path"), F.coalesce("n_turns", F.lit(0)).alias("n_turns")), "paths")
    mark = F.sha2(F.array_join("path", ",").cast("binary"), 256)
    classes = whole.groupBy(mark.alias("class"), "n_turns").agg(F.min("conv_id").alias("rep"), F.count("*").alias("n"))
    classes = stored(classes, "classes")
    members = dealt_join(whole.select(mark.alias("class"), "conv_id"), classes.select("class", "rep", "n", F.col("n").alias("times")), ["class"], "times", whole.count())
    members = stored(members.select("rep", "conv_id", "n"), "members")
    # the representatives' segments, with what lies before them and up to their end
    paths = whole.join(classes.select(F.col("rep").alias("conv_id"), "n"), "conv_id").withColumn("segments", F.size("path"))
    upto = lambda k: F.sha2(F.array_join(F.slice("path", F.lit(1), k), ",").cast("binary"), 256)
    steps = paths.select("conv_id", "n", "segments", F.posexplode_outer("path").alias("seg", "digest"), "path")
    steps = steps.select("conv_id", F.coalesce("seg", F.lit(0)).cast("long").alias("seg"), "n", "segments", F.when(F.col("seg") > 0, upto(F.col("seg"))).otherwise("").alias("key"), upto(F.coalesce("seg", F.lit(0)) + 1).alias("upto"))
    steps = stored(steps.join(rows.drop("digest"), ["conv_id", "seg"], "left"), "steps")
    empty = F.expr("array()").cast("array<long>")
    steps = steps.withColumns({"ids": F.coalesce("ids", empty), "sizes": F.coalesce("sizes", empty)})
    kinds = steps.groupBy("seg", "key").agg(F.count("*").alias("times"))
    shared = stored(kinds.filter((F.col("times") > 1) | (F.col("seg") == 0)), "shared")  # keys under which several classes go on; and the root
    n_steps = steps.count()
    steps = stored(dealt_join(steps, shared.select("seg", "key", F.lit(True).alias("together"), "times"), ["seg", "key"], "times", n_steps, "left"), "steps")
    # a class alone: a path of its own to its end
    lone = steps.filter("together IS NULL").withColumn("bytes", F.expr("aggregate(sizes, 0L, (a, x) -> a + x)"))
    later = Window.partitionBy("conv_id").orderBy(F.desc("seg")).rowsBetween(Window.unboundedPreceding, -1)
    lone = stored(lone.withColumn("later", F.coalesce(F.sum("bytes").over(later), F.lit(0))), "lone")
    path = lone.select("conv_id", "seg", "n", "segments", "later", "sizes", F.posexplode("sizes").alias("i", "size"))
    last = (F.col("seg") == F.col("segments") - 1) & (F.col("i") == F.size("sizes") - 1)
    after = F.expr("aggregate(slice(sizes, i + 1, size(sizes)), 0L, (a, x) -> a + x)")
    path = path.select("conv_id", (F.col("seg") * segment + F.col("i") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), ((F.col("n") - 1) * (F.col("later") + after)).alias("saved_tokens"), F.when(last, F.col("conv_id")).alias("ends"))
    hangs = lone.groupBy("conv_id").agg(F.min("seg").alias("seg"), F.sum("bytes").alias("bytes")).select("conv_id", (F.col("seg") - 1).alias("seg"), "bytes")
    deepest = shared.agg(F.max("seg").alias("s")).first().s
    found, below = path, None
    for seg in range(-1 if deepest is None else deepest, -1, -1):
        here = steps.filter((F.col("seg") == seg) & F.col("together")).join(hangs.filter(F.col("seg") == seg).drop("seg"), "conv_id", "left")
        goes_on = F.col("segments") > seg + 1
        lone_below = {"kids": F.when(F.col("bytes").isNotNull(), 1).otherwise(0), "leaves": F.when(F.col("bytes").isNotNull(), 1).otherwise(0), "saved": F.coalesce((F.col("n") - 1) * F.col("bytes"), F.lit(0))}
        here = here.withColumns({k: v.cast("long") for k, v in lone_below.items()}).withColumn("ends", F.when(~goes_on, F.col("conv_id")))
        # of classes that share the whole segment too, one item
        alike = here.groupBy("key", "upto").agg(F.first("ids").alias("ids"), F.first("sizes").alias("sizes"), F.sum("n").alias("n"), F.min("conv_id").alias("conv"), F.max("ends").alias("ends"), F.sum("kids").alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        if below is not None:
            more = below.select(F.col("key").alias("upto"), F.col("n_children").alias("c"), F.col("n_leaves").alias("l"), F.col("saved_tokens").alias("s"), F.col("ends").alias("e"))
            alike = alike.join(more, "upto", "left").withColumns({"kids": F.coalesce("c", "kids"), "leaves": F.coalesce("l", "leaves"), "saved": F.coalesce("s", "saved"), "ends": F.coalesce("ends", "e")}).drop("c", "l", "s", "e")
        items = alike.select("key", F.lit(seg * segment).cast("long").alias("depth"), F.lit(0).cast("long").alias("size"), "ids", "sizes", "n", "conv", "ends", "kids", "leaves", "saved")
        nodes = grown(items, most)
        found = found.unionByName(nodes.filter("NOT root" if seg else "true").select(*OUT))
        below = nodes.filter("root") if seg else None
    # the node before a segment may have members that end there, so it is named after all of them
    whole_name = steps.groupBy((F.col("seg") + 1).alias("seg"), F.col("upto").alias("key")).agg(F.min("conv_id").alias("top"))
    tops = steps.filter("seg > 0").select("conv_id", "seg", "key").join(whole_name, ["seg", "key"]).select("conv_id", (F.col("seg") * segment + 1).alias("depth"), "top")
    first = (F.col("depth") > 1) & (F.col("depth") % segment == (1 % segment))
    begun = found.filter(first).join(tops, ["conv_id", "depth"]).withColumn("parent_conv_id", F.col("top")).select(*OUT)
    found = stored(found.filter(~first).unionByName(begun), "nodes")
    hashes = digests_of_members(members)
    ended = found.filter("ends IS NOT NULL").join(hashes.withColumnRenamed("rep", "ends"), "ends")
    return ended.select(*OUT[:-1], "ends_sha256").unionByName(found.filter("ends IS NULL").select(*OUT[:-1], F.lit(NOBODY).alias("ends_sha256")))


def op12_trie(spark, sf_dir: str) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts count as empty; rows without conv_id are of no conversation; of equal turns that with the smaller digest comes
    first; repeated rows are turns of their own; an empty table gives no rows.
    """
    turns, convs = rebuilt(stored(coded(table(spark, sf_dir, "conversations")), "coded"))
    return prefix_trie(turns, convs)


OP12_SQL = r"""
WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, (4294967295 - list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, x: list_reduce(list_prepend(xor(a, x), [0, 0, 0, 0, 0, 0, 0, 0]), lambda b, z: CASE WHEN b % 2 = 1 THEN xor(b // 2, 3988292384) ELSE b // 2 END))) % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS part, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.pos < c.h UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos >= c.h),
s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth, sha256(length(role) || ':' || role || text) AS turn, octet_length(encode(text)) AS bytes FROM r),
p AS (SELECT conv_id, 0 AS depth, '' AS path, 0 AS bytes FROM c UNION ALL SELECT s.conv_id, s.depth, sha256(p.path || s.turn), s.bytes FROM p JOIN s ON s.conv_id = p.conv_id AND s.depth = p.depth + 1),
l AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
n AS (SELECT p.depth, p.path, min(p.conv_id) AS conv_id, count(*) AS n_convs, any_value(p.bytes) AS bytes, sha256(coalesce(string_agg(CASE WHEN l.depth = p.depth THEN CAST(p.conv_id AS VARCHAR) END, ',' ORDER BY p.conv_id), '')) AS ends_sha256 FROM p JOIN l USING (conv_id) GROUP BY p.depth, p.path),
e AS (SELECT DISTINCT a.path AS path, a.depth, b.path AS kid FROM p a JOIN p b ON a.conv_id = b.conv_id AND b.depth = a.depth + 1),
k AS (SELECT n.*, (SELECT count(*) FROM e WHERE e.path = n.path AND e.depth = n.depth) AS n_children FROM n),
d AS (SELECT DISTINCT a.depth AS top_depth, a.path AS top, b.depth, b.path FROM p a JOIN p b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
g AS (SELECT d.top_depth, d.top, count(*) FILTER (k.n_children = 0) AS n_leaves, sum((k.n_convs - 1) * k.bytes) AS saved_tokens FROM d JOIN k ON k.depth = d.depth AND k.path = d.path GROUP BY ALL),
up AS (SELECT e.kid, e.depth + 1 AS depth, n.conv_id AS parent_conv_id FROM e JOIN n ON n.path = e.path AND n.depth = e.depth)
SELECT k.conv_id, CAST(k.depth AS BIGINT) AS depth, up.parent_conv_id, k.n_convs, k.n_children, g.n_leaves, CAST(g.saved_tokens AS BIGINT) AS saved_tokens, k.ends_sha256
FROM k JOIN g ON g.top = k.path AND g.top_depth = k.depth LEFT JOIN up ON up.kid = k.path AND up.depth = k.depth
"""
