"""Runs, islands, neighbours and folds over rows with an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ordered(keys: list[str], pos: str | list[str]):
    return Window.partitionBy(*keys).orderBy(*([pos] if isinstance(pos, str) else pos))


def run_id(df: DataFrame, keys: list[str], pos: str, changed: Column, name: str = "run") -> DataFrame:
    """Number the runs that start wherever ``changed`` is true (null counts as a change)."""
    w = ordered(keys, pos)
    return df.withColumn("_new", F.coalesce(changed, F.lit(True)).cast("int")).withColumn(name, F.sum("_new").over(w)).drop("_new")


def folded(df: DataFrame, keys: list[str], pos: list[str], inputs: list[str], out: str, kind: str, start, step) -> DataFrame:
    """Adds ``out``: ``step(state, *inputs)`` gives (state, out) for each row of a key in order, from ``start()`` on.

    Rows are sorted, by Spark and on disk where need be, and streamed: a task holds a batch and one state, however long a key is.
    """
    names = [*df.columns, out]

    def fold(batches):
        import pyarrow as pa

        last, state = object(), None
        for batch in batches:
            found = []
            for key, *row in zip(zip(*(batch.column(k).to_pylist() for k in keys)), *(batch.column(c).to_pylist() for c in inputs)):
                if key != last:
                    last, state = key, start()
                state, x = step(state, *row)
                found.append(x)
            yield pa.record_batch([*batch.columns, pa.array(found, {"int": pa.int32(), "string": pa.string()}[kind])], names=names)

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.IntegerType() if kind == "int" else T.StringType())])
    return df.repartition(*keys).sortWithinPartitions(*keys, *pos).mapInArrow(fold, schema)


def speaker_runs(df: DataFrame, keys: list[str], pos: str, speaker: str, text: str, most: int) -> DataFrame:
    """Merge consecutive rows of a speaker while the merged text stays within ``most`` characters.

    Runs come from a window; a long run is cut by a streamed fold over its rows' lengths, since each cut depends on the one before.
    """
    w = ordered(keys, pos)
    rows = run_id(df, keys, pos, F.col(speaker) != F.lag(speaker).over(w)).select(*keys, "run", speaker, pos, F.col(text).alias("_text"), F.length(text).alias("_n"))

    def step(s, run, n):
        last, chunk, size = s
        if run != last:
            chunk, size = 0, 0
        if n is None:
            return (run, chunk, size), chunk
        if size > 0 and size + 1 + n > most:
            chunk, size = chunk + 1, n
        else:
            size += (size > 0) + n
        return (run, chunk, size), chunk

    placed = folded(rows, keys, [pos], ["run", "_n"], "chunk", "int", lambda: (None, 0, 0), step)
    line = F.struct(F.col(pos).alias("pos"), F.col("_text").alias("text"))
    merged = placed.groupBy(*keys, "run", "chunk").agg(F.first(speaker).alias(speaker), F.min(pos).alias(pos), F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["text"]), " ").alias(text), F.count("*").alias("n_lines"))
    return merged.drop("run", "chunk")


def nearest_marked(df: DataFrame, keys: list[str], pos: str, marked: Column) -> DataFrame:
    """Adds before and after: distance to the last marked row before and the next one after."""
    w = ordered(keys, pos)
    place = F.when(marked, F.col(pos))
    last = F.last(place, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    following = F.first(place, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return df.withColumn("before", F.col(pos) - last).withColumn("after", following - F.col(pos))


def merged_intervals(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Union of overlapping or touching intervals within keys."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("_new", F.coalesce((F.col(start) > reach), F.lit(True)).cast("int")).withColumn("_i", F.sum("_new").over(w))
    return rows.groupBy(*keys, "_i").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_i")


def timeline(df: DataFrame, keys: list[str], pos: str, length: Column, gap: Column) -> DataFrame:
    """Adds start: lengths and gaps of all rows before, where ``gap`` is the pause before a row (its first row's doesn't count)."""
    w = ordered(keys, pos)
    first = F.row_number().over(w) == 1
    rows = df.withColumn("_len", length).withColumn("_gap", F.when(first, 0).otherwise(gap))
    return rows.withColumn("start", F.sum(F.col("_gap") + F.col("_len")).over(w) - F.col("_len")).drop("_len", "_gap")


def tumbling(df: DataFrame, keys: list[str], pos: list[str], size: Column, most: float) -> DataFrame:
    """Deal rows to chunks, in order; a chunk closes with the row that brings it to ``most``. A streamed fold over the group's sizes."""

    def step(s, size):
        chunk, total = s
        if total is None or size is None:
            return (chunk, None), chunk
        return ((chunk + 1, 0.0) if not total + size < most else (chunk, total + size)), chunk

    rows = df.select(*keys, *pos, size.alias("size"))
    return folded(rows, keys, [*pos, "size"], ["size"], "chunk", "int", lambda: (0, 0.0), step)


def alternating(df: DataFrame, keys: list[str], pos: str, speaker: str) -> DataFrame:
    """Repair turns: a row with the same speaker as the last *output* row gets the last other speaker, if there was one."""

    def step(s, who):
        last, other = s
        same = who is not None and who == last
        if same and other is not None:
            return (other, last), other
        return (who, other if same else last), who

    rows = df.select(*keys, pos, speaker)
    return folded(rows, keys, [pos, speaker], [speaker], "repaired", "string", lambda: (None, None), step)
