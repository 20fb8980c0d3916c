"""Order-dependent picks in parallel rounds that give what the rule gives one row at a time.

A round decides every node whose earlier neighbours are all decided; a node waits for nothing else. Each round's open edges are a
checkpoint, and only they are looked at again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .similarity import cut


def ordered_edges(edges: DataFrame, a: str, b: str, order: DataFrame, node: str, place: list) -> DataFrame:
    """(late, early) of each pair, once: ``place`` (columns of ``order``, a row for each node) tells which of two comes first."""
    at = lambda x, name: order.select(F.col(node).alias(x), F.struct(*place, F.col(node)).alias(name))
    met = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y").join(at("x", "_x"), "x").join(at("y", "_y"), "y")
    first = F.col("_x") < F.col("_y")
    return met.select(F.when(first, F.col("y")).otherwise(F.col("x")).alias("late"), F.when(first, F.col("x")).otherwise(F.col("y")).alias("early")).distinct()


def first_independent(edges: DataFrame) -> DataFrame:
    """``late`` of (late, early) edges that the sequential rule rejects: a node is accepted if no accepted one is among its earlier neighbours."""
    open_edges, rejected = cut(edges.select("late", "early")), None
    while not open_edges.isEmpty():
        waiting = open_edges.select(F.col("late").alias("early")).distinct()
        sure = open_edges.select("early").distinct().join(waiting, "early", "left_anti")  # nothing earlier is open
        out = cut(open_edges.join(sure, "early").select("late").distinct())
        rejected = out if rejected is None else rejected.unionByName(out)
        left = open_edges.join(out, "late", "left_anti").join(sure, "early", "left_anti")
        open_edges = cut(left.join(out.withColumnRenamed("late", "early"), "early", "left_anti"))
    return open_edges.select("late") if rejected is None else rejected


def colours(nodes: DataFrame, node: str, edges: DataFrame) -> DataFrame:
    """node, colour: the smallest colour (from 0) that no earlier neighbour has, nodes taken in the order of (late, early) edges."""
    waiting = edges.select(F.col("late").alias(node)).distinct()
    done = nodes.select(node).distinct().join(waiting, node, "left_anti").withColumn("colour", F.lit(0))
    fresh, seen, open_edges = cut(done), None, cut(edges.select("late", "early"))
    done = fresh
    while not open_edges.isEmpty():
        # what the newly coloured nodes tell their later neighbours
        told = open_edges.join(fresh.withColumnRenamed(node, "early"), "early").groupBy("late").agg(F.collect_set("colour").alias("taken"))
        seen = cut(told if seen is None else seen.unionByName(told).groupBy("late").agg(F.array_distinct(F.flatten(F.collect_list("taken"))).alias("taken")))
        open_edges = cut(open_edges.join(fresh.select(F.col(node).alias("early")), "early", "left_anti"))
        ready = seen.join(open_edges.select("late").distinct(), "late", "left_anti")
        free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("taken")), "taken"))
        fresh = cut(ready.select(F.col("late").alias(node), free.cast("int").alias("colour")))
        seen = seen.join(ready.select("late"), "late", "left_anti")
        done = done.unionByName(fresh)
    return done


def clique_colours(members: DataFrame, node: str, cell: list[str], order: DataFrame, place: list, block: int = 1 << 20) -> DataFrame:
    """node, colour: the smallest colour (from 0) that no earlier neighbour has. Neighbours are nodes that share a cell; no pairs are listed.

    ``order`` has each node once, taken in the order of ``place`` (columns of it), then of the node. ``members`` has node and cell columns; those
    null match nothing. The rule goes from node to node, so blocks of about ``block`` memberships come one after another: a task colours a
    block's nodes in order, given the colours that their cells have had before, a bit for each colour. What cells have had is a table.
    """
    rows = members.select(F.struct(*cell).alias("_cell"), F.col(node).alias("_node")).filter(" AND ".join(f"_cell.`{c}` IS NOT NULL" for c in cell)).distinct()
    numbers = cut(rows.select("_cell").distinct().select("_cell", F.monotonically_increasing_id().alias("_number")))
    rows = rows.join(numbers, "_cell").select("_node", F.col("_number").alias("_cell"))
    each = order.select(F.col(node).alias("_node"), F.struct(*place, F.col(node)).alias("_at"))
    held = cut(each.join(rows.groupBy("_node").agg(F.collect_list("_cell").alias("_cells")), "_node", "left").withColumn("_cells", F.coalesce("_cells", F.array().cast(T.ArrayType(rows.schema["_cell"].dataType)))))
    total = held.agg(F.sum(F.size("_cells") + 1)).first()[0] or 0
    n_blocks = max(1, -(-total // block))
    # ranges of the order, by a sort dealt out over tasks
    if n_blocks > 1:
        held = cut(held.repartitionByRange(n_blocks, "_at").withColumn("_block", F.spark_partition_id()))
    else:
        held = held.withColumn("_block", F.lit(0))
    out_schema = T.StructType([T.StructField("node", each.schema["_node"].dataType), T.StructField("colour", T.IntegerType()), T.StructField("_cell", rows.schema["_cell"].dataType), T.StructField("had", T.BinaryType())])
    had, done = None, None

    def coloured(batches):
        import pyarrow as pa

        nodes, known = [], {}
        for batch in batches:
            for n, c, x in zip(*(batch.column(name).to_pylist() for name in ("_node", "_cell", "had"))):
                nodes.append((n, c))
                if x:
                    known[c] = int.from_bytes(x, "little")
        # rows come sorted, a node's together
        out, i = [], 0
        while i < len(nodes):
            j, taken = i, 0
            while j < len(nodes) and nodes[j][0] == nodes[i][0]:
                taken |= known.get(nodes[j][1], 0)
                j += 1
            free = ~taken & taken + 1
            for n, c in nodes[i:j]:
                if c is not None:
                    known[c] = known.get(c, 0) | free
            out.append((nodes[i][0], free.bit_length() - 1))
            i = j
        for at in range(0, len(out), 10_000):
            part = out[at : at + 10_000]
            yield record(pa, [x for x, _ in part], [x for _, x in part], [None] * len(part), [None] * len(part))
        cells = list(known.items())
        for at in range(0, len(cells), 10_000):
            part = cells[at : at + 10_000]
            yield record(pa, [None] * len(part), [None] * len(part), [c for c, _ in part], [x.to_bytes(-(-x.bit_length() // 8), "little") for _, x in part])

    def record(pa, *columns):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape)], schema=shape)

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = pa.schema([pa.field(f.name, f.type) for f in to_arrow_schema(out_schema)])
    for k in range(n_blocks):
        now = held.filter(F.col("_block") == k).select("_at", "_node", F.explode_outer("_cells").alias("_cell"))
        first = F.row_number().over(Window.partitionBy("_cell").orderBy("_at")) == 1  # only a cell's first row in the block brings what it has had
        now = now.withColumn("_first", first).join(had, "_cell", "left").withColumn("had", F.when(F.col("_first"), F.col("had"))) if had is not None else now.withColumn("had", F.lit(None).cast("binary"))
        made = cut(now.repartition(1).sortWithinPartitions("_at").select("_node", "_cell", "had").mapInArrow(coloured, out_schema))
        part = made.filter("colour IS NOT NULL").select(F.col("node").alias(node), "colour")
        done = part if done is None else done.unionByName(part)
        if k + 1 < n_blocks:
            fresh = made.filter("colour IS NULL").select("_cell", "had")
            had = cut(fresh if had is None else had.join(fresh, "_cell", "left_anti").unionByName(fresh))
    return done


def matched_pairs(probes: DataFrame, candidates: DataFrame, key: str, size: str, cell: list[str], tolerance: float = 0.25) -> DataFrame:
    """key, candidate, cost of every probe: the closest pairs in size first, none used twice, ties to the smaller probe, then candidate.

    A probe takes candidates of its cell whose size differs by at most ``tolerance`` (1 or less) of its own; candidate and cost are null
    where none is left. Null sizes match nothing; ids differ on either side.

    Equal sizes pair off by their order. Then a round joins those that are each other's closest: in a cell's order of sizes that is the
    nearest of the other kind on either side, so no pairs are listed. A cell's rows are sorted in one task: let cells be narrow.
    """
    side = lambda df, kind: df.select((F.struct(*cell) if cell else F.lit(0)).alias("cell"), F.col(size).alias("size"), F.lit(kind).alias("kind"), F.col(key).alias("id")).filter("size IS NOT NULL")
    rows = side(probes, 0).unionByName(side(candidates, 1))
    rows = cut(rows.withColumn("nth", F.row_number().over(Window.partitionBy("cell", "size", "kind").orderBy("id"))))
    of = lambda df, kind, name: df.filter(F.col("kind") == kind).select("cell", "size", "nth", F.col("id").alias(name))
    pairs = cut(of(rows, 0, "p").join(of(rows, 1, "c"), ["cell", "size", "nth"]).select("p", "c", F.lit(0.0).alias("cost")))
    done, left = pairs, rows.select("cell", "size", "kind", "id")
    while True:
        gone = pairs.select(F.col("p").alias("id"), F.lit(0).alias("kind")).unionByName(pairs.select(F.col("c").alias("id"), F.lit(1).alias("kind")))
        left = cut(left.join(gone, ["id", "kind"], "left_anti"))
        heads = left.groupBy("cell", "size", "kind").agg(F.min("id").alias("id"))
        w = Window.partitionBy("cell").orderBy("size")
        item = F.struct("size", "id")
        near = heads
        for kind in (0, 1):  # the nearest of either kind on both sides
            of_kind = F.when(F.col("kind") == kind, item)
            near = near.withColumn(f"before{kind}", F.last(of_kind, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn(f"after{kind}", F.first(of_kind, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))

        def edges(kind: int, own: str, other: str) -> DataFrame:
            met = near.filter(F.col("kind") == kind).select(F.col("id").alias(own), "size", F.explode(F.array(f"before{1 - kind}", f"after{1 - kind}")).alias("x")).filter("x IS NOT NULL")
            met = met.select(own, F.col("x.id").alias(other), F.abs(F.col("x.size") - F.col("size")).cast("double").alias("cost"), (F.col("x.size") if kind else F.col("size")).alias("of"))
            return met.filter(F.col("cost") <= F.col("of") * tolerance).groupBy(own).agg(F.min(F.struct("cost", "p", "c")).alias(f"best_{own}"))

        best = edges(0, "p", "c").select("p", F.col("best_p.c").alias("c"), F.col("best_p.cost").alias("cost"))
        chosen = best.join(edges(1, "c", "p").select("c", F.col("best_c.p").alias("p")), ["p", "c"])
        pairs = cut(chosen.select("p", "c", "cost"))
        if pairs.isEmpty():
            break
        done = done.unionByName(pairs)
    return probes.select(key).join(done, F.col(key) == F.col("p"), "left").select(key, F.col("c").alias("candidate"), "cost")
