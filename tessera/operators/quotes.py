"""Locating quotes in texts by their letters and digits alone."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import prefix_hash, span_hash

LEAST = 12
KEY = r"[^0-9a-z]+"
#: Marks of quotes that are sent to the tasks that read the texts (8 bytes each); of more quotes, all spans of the texts are shuffled.
MOST_MARKS = 1 << 20


def key(column: str = "text"):
    return F.coalesce(F.regexp_replace(F.lower(F.col(column)), KEY, ""), F.lit(""))


def marked(keys: DataFrame, columns: list[str], name: str, one: bool, wanted=None) -> DataFrame:
    """``columns`` and a mark: the hashes of all ``LEAST``-character spans of the key ``name`` (of ``wanted``, if given), or the least of them alone."""

    def spans(batches):
        import pyarrow as pa

        held = wanted.value if wanted is not None else None
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                some, rows, marks = batch.slice(lo, 200), [], []
                for i, k in enumerate(some.column(name).to_pylist()):
                    data = np.frombuffer(k.encode(), np.uint8)
                    if len(data) >= LEAST:
                        at = np.arange(len(data) - LEAST + 1)
                        h = np.unique(span_hash(prefix_hash(data), at, at + LEAST))
                        h = h[:1] if one else h if held is None else h[held[np.minimum(np.searchsorted(held, h), len(held) - 1)] == h]
                        rows.append(np.full(len(h), i))
                        marks.append(h.astype(np.int64))
                if rows:
                    at = pa.array(np.concatenate(rows))
                    yield pa.record_batch([*[some.column(c).take(at) for c in columns], pa.array(np.concatenate(marks))], names=[*columns, "mark"])

    schema = keys.select(*columns).schema.add("mark", "long")
    return keys.select(*columns, *([name] if name not in columns else [])).mapInArrow(spans, schema)


def located(quotes: DataFrame, texts: DataFrame, quote_id: str, text_id: str) -> DataFrame:
    """Where each quote's whole key stands: quote_id, text_id, status.

    A row for each text that holds the key: located (once) or ambiguous (more than once in it); for a quote in none, one row with
    text_id null: too_short (under 12 characters) or not_found. Candidates share a hashed span of 12 characters (of a quote, that of the
    least hash; texts' other spans don't leave their task, if the quotes are ``MOST_MARKS`` at most); they are then searched for the whole key.
    """
    q = quotes.select(quote_id, key().alias("quote"))
    s = texts.select(text_id, key().alias("whole"))
    long = q.filter(F.length("quote") >= LEAST)
    asked = marked(long, [quote_id], "quote", True)
    some = asked.select("mark").distinct().limit(MOST_MARKS + 1).toArrow().column("mark").to_numpy()
    few = texts.sparkSession.sparkContext.broadcast(np.sort(some.view(np.uint64))) if 0 < len(some) <= MOST_MARKS else None
    pairs = marked(s, [text_id], "whole", False, few).join(asked, "mark").select(text_id, quote_id)
    tried = pairs.join(long, quote_id).join(s, text_id).withColumn("at", F.expr("locate(quote, whole)")).filter("at > 0")
    found = tried.select(quote_id, text_id, F.expr("CASE WHEN locate(quote, whole, at + 1) > 0 THEN 'ambiguous' ELSE 'located' END").alias("status"))
    rest = q.join(found, quote_id, "left_anti").select(quote_id, F.lit(None).cast(texts.schema[text_id].dataType).alias(text_id), F.expr(f"CASE WHEN length(quote) < {LEAST} THEN 'too_short' ELSE 'not_found' END").alias("status"))
    return found.unionByName(rest)
