"""Whole forms of queries whose SQL, and so the query of the same row, does only part of the job."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import cascades as C
from ..operators import quotes as Q
from .registry import query


@query("g19_locate_quote_whole")
def g19_whole(t):
    return Q.located(t.benchmark, t.documents, "item_id", "doc_id")


@query("d15_unique_extend_whole", r"WITH x AS (SELECT doc_id, list_concat(regexp_extract_all(string_split(text, chr(10))[1], '[a-z]+'), regexp_extract_all(array_to_string(string_split(text, chr(10))[2:], chr(10)), '[a-z]+')) AS w FROM documents) SELECT doc_id, array_to_string(list_filter(w, lambda v, i: list_position(w, v) = i)[1:8], ',') AS words FROM x")
def d15_whole(t):
    # the first line's words, then the other lines' words: all words of the text
    words = lambda c: F.regexp_extract_all(c, F.lit("[a-z]+"), F.lit(0))
    lines = F.split("text", "\n")
    return t.documents.select("doc_id", F.array_join(F.slice(F.array_distinct(F.concat(words(lines[0]), words(F.array_join(F.slice(lines, 2, F.size(lines)), "\n")))), 1, 8), ",").alias("words"))


@query("g06_alias_classes", "WITH g AS (SELECT p_partkey, unnest(list_distinct([p_brand, p_type])) AS name FROM part) SELECT name, p_partkey, count(*) OVER (PARTITION BY name) AS members FROM g")
def g06_whole(t):
    # two parts are the same where they share a class; the pairs themselves grow with the square of a class
    g = t.part.select("p_partkey", F.explode(F.array_distinct(F.array("p_brand", "p_type"))).alias("name")).filter("name IS NOT NULL")
    return g.join(g.groupBy("name").agg(F.count("*").alias("members")), "name").select("name", "p_partkey", "members")


@query("j15_span_coverage_whole", "SELECT coalesce(c.c_custkey, o.k) AS id, CASE WHEN o.k IS NULL THEN 'missing' ELSE 'unknown' END AS finding, coalesce(o.n, 0) AS n FROM customer c FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1) o ON c.c_custkey = o.k WHERE c.c_custkey IS NULL OR o.k IS NULL UNION ALL SELECT NULL, 'malformed', count(*) FROM orders WHERE o_custkey IS NULL HAVING count(*) > 0")
def j15_whole(t):
    c = t.customer.select(F.col("c_custkey").alias("id"), F.lit(1).alias("a"))
    o = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"))
    finding = F.when(F.col("id").isNull() & F.col("n").isNotNull(), "malformed").when(F.col("n").isNull(), "missing").otherwise("unknown")
    return c.join(o, "id", "full").filter("a IS NULL OR n IS NULL").select("id", finding.alias("finding"), F.coalesce("n", F.lit(0)).alias("n"))


@query("g12_overlap_semi_whole", "WITH i AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS a, floor(epoch(ts))::BIGINT + round(value * 600)::BIGINT AS b FROM events) SELECT event_id FROM i q WHERE a < b AND EXISTS (SELECT 1 FROM i o WHERE o.user_id = q.user_id AND o.event_id <> q.event_id AND o.a < o.b AND q.a < o.b AND o.a < q.b)")
def g12_whole(t):
    # in order of starts, an earlier interval overlaps where its end comes after this start, a later one where the next start is before this end
    at = F.expr("unix_seconds(cast(ts as timestamp))")
    i = t.events.select("event_id", "user_id", at.alias("a"), (at + F.round(F.col("value") * 600).cast("long")).alias("b")).filter("a < b")
    w = Window.partitionBy("user_id").orderBy("a", "event_id")
    reach = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return i.withColumn("reach", reach).withColumn("next", F.lead("a").over(w)).filter("reach > a OR next < b").select("event_id")


@query("f03_duplicate_blocks")
def f03_whole(t):
    return B.adjacent_duplicates(t.documents, "doc_id", "text")


@query("g14_fuzzy_cascade_whole")
def g14_whole(t):
    c = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), "text")
    return C.fuzzy_cascade(t.benchmark, c, "item_id", "turn_id", "text").withColumn("score", F.round("score", 6))


@query("g15_token_f1_whole")
def g15_whole(t):
    return C.token_f1(t.pages.select("page_id", F.col("url").alias("text")), t.benchmark, "page_id", "item_id", "text").withColumn("score", F.round("score", 6))
