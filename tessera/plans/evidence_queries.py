"""More of sections A, C, D and E: tolerant parsing, replacements with evidence, statistics and gates on multisets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evidence as V
from .registry import query

r6 = lambda c: F.round(c, 6)


@query("a16_log_lines", r"SELECT regexp_extract(line, 'level=([a-z]+)', 1) AS level, count(*) AS n, round(sum(TRY_CAST(regexp_extract(line, 'took=([0-9.]+)', 1) AS DOUBLE)), 2) AS took, count(*) FILTER (regexp_matches(line, 'user=[0-9]*[05] ')) AS fives FROM (SELECT 'level=' || event_type || ' user=' || user_id || ' took=' || value AS line FROM events) GROUP BY 1")
def a16(t):
    line = F.concat(F.lit("level="), "event_type", F.lit(" user="), "user_id", F.lit(" took="), "value")
    lines = t.events.select(line.alias("line"))
    mined = lines.select(F.regexp_extract("line", "level=([a-z]+)", 1).alias("level"), F.expr("try_cast(regexp_extract(line, 'took=([0-9.]+)', 1) AS double)").alias("took"), F.col("line").rlike("user=[0-9]*[05] ").alias("five"))
    return mined.groupBy("level").agg(F.count("*").alias("n"), F.round(F.sum("took"), 2).alias("took"), F.count_if("five").alias("fives"))


# one reply is a list of findings, another an object that holds the list
REPLY = "CASE WHEN quality = 1 THEN '[{\"id\": ' || doc_id || ', \"toxic\": ' || toxic || '}]' ELSE '{\"results\": [{\"id\": ' || doc_id || ', \"toxic\": ' || toxic || '}]}' END"


@query("a18_judge_replies", f"WITH r AS (SELECT {REPLY} AS reply FROM labels), p AS (SELECT CASE WHEN json_type(reply) = 'ARRAY' THEN reply ELSE json_extract(reply, '$.results')::VARCHAR END AS items FROM r) SELECT CAST(json_extract(items, '$[0].id') AS BIGINT) AS doc_id, CAST(json_extract(items, '$[0].toxic') AS BIGINT) AS toxic FROM p")
def a18(t):
    item = "array<struct<id: bigint, toxic: bigint>>"
    both = t.labels.select(F.expr(REPLY).alias("reply")).select(F.from_json("reply", item).alias("list"), F.from_json("reply", f"struct<results: {item}>").alias("wrapped"), F.col("reply").startswith("[").alias("bare"))
    found = both.select(F.explode(F.when(F.col("bare"), F.col("list")).otherwise(F.col("wrapped.results"))).alias("x"))
    return found.select(F.col("x.id").alias("doc_id"), "x.toxic")


@query("a20_config_fields", "WITH c AS (SELECT p_partkey, p_size::VARCHAR AS size, p_name AS rate, p_retailprice::VARCHAR AS price FROM part) SELECT p_partkey, TRY_CAST(size AS INTEGER) AS size, TRY_CAST(rate AS DOUBLE) AS rate, CASE WHEN TRY_CAST(price AS DOUBLE) BETWEEN 0 AND 1500 THEN TRY_CAST(price AS DOUBLE) END AS price, array_to_string(list_filter([CASE WHEN TRY_CAST(size AS INTEGER) IS NULL THEN 'size' END, CASE WHEN TRY_CAST(rate AS DOUBLE) IS NULL THEN 'rate' END, CASE WHEN NOT coalesce(TRY_CAST(price AS DOUBLE) BETWEEN 0 AND 1500, false) THEN 'price' END], lambda x: x IS NOT NULL), ',') AS warnings FROM c")
def a20(t):
    c = t.part.select("p_partkey", F.col("p_size").cast("string").alias("size"), F.col("p_name").alias("rate"), F.col("p_retailprice").cast("string").alias("price"))
    typed = c.select("p_partkey", *[F.expr(f"try_cast({n} AS {kind})").alias(n) for n, kind in (("size", "int"), ("rate", "double"), ("price", "double"))])
    typed = typed.withColumn("price", F.when(F.col("price").between(0, 1500), F.col("price")))
    warned = F.concat_ws(",", *[F.when(F.col(n).isNull(), n) for n in ("size", "rate", "price")])
    return typed.withColumn("warnings", warned)


# Misspellings and what they stand for.
CORRUPT = {"thnd": "the and", "eronth": "erosion", "thwh": "the which"}


def _cased(x: str, sql: bool) -> str:
    """Replace every whole word of CORRUPT; a capital stays a capital."""
    for bad, good in CORRUPT.items():
        for a, b in ((bad, good), (bad.capitalize(), good.capitalize())):
            x = rf"regexp_replace({x}, '\b{a}\b', '{b}'{', ' + chr(39) + 'g' + chr(39) if sql else ''})"
    return x


@query("c07_known_corruptions", f"SELECT doc_id, md5({_cased('text', True)}) AS digest, len(regexp_extract_all(text, '(?i)\\b({'|'.join(CORRUPT)})\\b'))::INT AS hits FROM documents WHERE text IS NOT NULL")
def c07(t):
    return t.documents.filter("text IS NOT NULL").select("doc_id", F.md5(V.with_case(F.col("text"), CORRUPT).cast("binary")).alias("digest"), V.word_count("text", list(CORRUPT)).alias("hits"))


LOOKALIKES = ("аеорсухіАВЕКМНОРСТХ", "aeopcyxiABEKMHOPCTX")
MIXED = "text || ' ' || substr(text, 1, 3) || 'о' || substr(text, 4, 2) || ' цвет'"


@query("c09_homoglyph_words", f"WITH d AS (SELECT doc_id, {MIXED} AS text FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, text, list_filter(regexp_extract_all(text, '[^\\s]+'), lambda w: regexp_matches(w, '[Ѐ-ӿ]') AND NOT regexp_matches(translate(w, '{LOOKALIKES[0]}', '{LOOKALIKES[1]}'), '[Ѐ-ӿ]')) AS words FROM d) SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '[Ѐ-ӿ]')) < 0.005 * length(text) THEN len(words) ELSE 0 END::INT AS n_words, CASE WHEN len(regexp_extract_all(text, '[Ѐ-ӿ]')) < 0.005 * length(text) THEN array_to_string(list_transform(words, lambda w: translate(w, '{LOOKALIKES[0]}', '{LOOKALIKES[1]}')), ' ') ELSE '' END AS words FROM w")
def c09(t):
    d = t.documents.filter("text IS NOT NULL").select("doc_id", F.expr(MIXED).alias("text"))
    return V.homoglyph_words(d, "text", *LOOKALIKES).select("doc_id", "n_words", "words")


@query("c29_spoken_dates", "SELECT o_orderkey, strftime(o_orderdate, '%B') || ' ' || day(o_orderdate) || ', ' || year(o_orderdate) AS spoken_date, regexp_replace(regexp_replace('Ord' || o_orderkey || o_orderstatus, '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g') AS spoken_id FROM orders")
def c29(t):
    parts = F.concat(F.lit("Ord"), F.col("o_orderkey"), F.col("o_orderstatus"))
    return t.orders.select("o_orderkey", V.spoken_date(F.col("o_orderdate")).alias("spoken_date"), V.spoken_id(parts).alias("spoken_id"))


LEXICON = {"the": "ðə", "and": "ænd", "widget": "wijit"}
_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in LEXICON.items()) + "}"


@query("c33_lexicon", f"WITH w AS (SELECT conv_id, turn, string_split(lower(text), ' ') AS w FROM conversations WHERE text IS NOT NULL) SELECT conv_id, turn, md5(array_to_string(list_transform(w, lambda x: coalesce({_MAP}[x], x)), ' ')) AS digest, len(list_filter(w, lambda x: {_MAP}[x] IS NOT NULL))::INT AS hits FROM w")
def c33(t):
    words = t.conversations.filter("text IS NOT NULL").select("conv_id", "turn", F.split(F.lower("text"), " ").alias("w"))
    put, hits = V.from_lexicon(F.col("w"), LEXICON)
    return words.select("conv_id", "turn", F.md5(F.array_join(put, " ").cast("binary")).alias("digest"), hits.alias("hits"))


@query("c41_symbols", "SELECT conv_id, turn, 'S' || dense_rank() OVER (PARTITION BY conv_id ORDER BY length(role) DESC, role) AS symbol FROM conversations")
def c41(t):
    # longest names first, so that a name within a name doesn't take its place
    w = Window.partitionBy("conv_id").orderBy(F.length("role").desc(), "role")
    return t.conversations.select("conv_id", "turn", F.concat(F.lit("S"), F.dense_rank().over(w).cast("string")).alias("symbol"))


@query("d03_log_choose", "WITH x AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS k FROM orders GROUP BY 1) SELECT o_custkey, n, k, round(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + 1e-9, 6) AS log_choose FROM x")
def d03(t):
    x = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("k"))
    return x.withColumn("log_choose", r6(V.log_choose(F.col("n"), F.col("k")) + 1e-9))


@query("d14_redacted_maps", "SELECT c_custkey, 'acctbal=[REDACTED],name=' || c_name || ',segment=' || c_mktsegment AS plain FROM customer")
def d14(t):
    fields = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"), F.lit("acctbal"), F.col("c_acctbal").cast("string"))
    return t.customer.select("c_custkey", V.flat(V.hidden(fields, "acctbal|token|secret")).alias("plain"))


@query("d19_group_ranks", "WITH r AS (SELECT l_returnflag, l_quantity AS x, count(*) AS n FROM lineitem GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER (PARTITION BY l_returnflag ORDER BY x) AS upto FROM r) SELECT l_returnflag, x, CAST(n AS BIGINT) AS n, upto - (n - 1) / 2.0 AS average_rank FROM c")
def d19(t):
    # ranks by counts of values: rows of a value share one rank, so no group's rows are sorted in one task
    counted = t.lineitem.groupBy("l_returnflag", F.col("l_quantity").alias("x")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("l_returnflag").orderBy("x"))
    return counted.withColumn("average_rank", upto - (F.col("n") - 1) / 2.0)


@query("e18_clopper_pearson")
def e18(t):
    x = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("k"))
    return V.clopper_pearson(x, "k", "n")


SPLIT = "md5(CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) || ':' || CAST(trial AS VARCHAR)) < '8'"


@query("e24_half_splits", f"WITH s AS (SELECT l_suppkey, trial, {SPLIT} AS half, l_quantity FROM lineitem, range(20) t(trial)), m AS (SELECT l_suppkey, trial, avg(l_quantity) FILTER (half) / avg(l_quantity) FILTER (NOT half) AS ratio FROM s GROUP BY 1, 2) SELECT l_suppkey, count(ratio) AS trials, round(min(ratio) + 1e-9, 6) AS lowest, round(max(ratio) + 1e-9, 6) AS highest, count(*) FILTER (ratio NOT BETWEEN 0.8 AND 1.25) AS outside FROM m GROUP BY 1")
def e24(t):
    return V.half_splits(t.lineitem, ["l_suppkey"], ["l_orderkey", "l_linenumber"], "l_quantity", 20)


@query("e33_label_model")
def e33(t):
    d = t.documents
    votes = d.select("doc_id", F.when(F.col("n_chars") > 800, 1).otherwise(0).alias("a"), F.when(F.col("text").contains("http"), 0).otherwise(1).alias("b"), F.when(F.col("text").rlike("[!#$]{2}"), 0).when(F.col("n_chars") > 300, 1).alias("c"))
    return V.label_model(votes, "doc_id", ["a", "b", "c"]).withColumn("p", r6("p"))


@query("e35_evidence", "WITH c AS (SELECT doc_id, len(regexp_extract_all(lower(text), '\\b(the|that)\\b')) AS a, len(regexp_extract_all(lower(text), '\\b(to|in)\\b')) AS b FROM documents WHERE text IS NOT NULL) SELECT doc_id, a::INT AS a, b::INT AS b, CASE WHEN a + b < 3 THEN 'unknown' WHEN a >= 0.75 * (a + b) THEN 'a' WHEN b >= 0.75 * (a + b) THEN 'b' ELSE 'mixed' END AS verdict FROM c")
def e35(t):
    c = t.documents.filter("text IS NOT NULL").select("doc_id", V.word_count("text", ["the", "that"]).alias("a"), V.word_count("text", ["to", "in"]).alias("b"))
    return c.withColumn("verdict", V.majority(F.col("a"), F.col("b"), 3, 0.75))


@query("e32_word_errors")
def e32(t):
    return V.word_errors(_next_turns(t), "text", "heard").drop("text", "heard")


@query("j16_word_error_gate")
def j16(t):
    return V.word_error_gate(V.word_errors(_next_turns(t), "text", "heard")).select("conv_id", "turn", "n_words", "errors", "limit", "passed")


def _next_turns(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t.conversations.select("conv_id", "turn", "text", F.lead("text").over(w).alias("heard"))


OUTPUT = "regexp_replace(text, '[.!?][^.!?]*$', '')"  # what is left of a text without its last sentence
_GATE = f"WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), s AS (SELECT doc_id, list_filter(string_split(lower(text), ' '), lambda x: x <> '') AS s, list_filter(string_split(lower({OUTPUT}), ' '), lambda x: x <> '') AS o FROM d), g AS (SELECT *, list_transform(range(1, len(s) - 1), lambda i: s[i] || ' ' || s[i + 1] || ' ' || s[i + 2]) AS sg, list_transform(range(1, len(o) - 1), lambda i: o[i] || ' ' || o[i + 1] || ' ' || o[i + 2]) AS og FROM s), p AS (SELECT doc_id, 0 AS kind, x, 1 AS a, 0 AS b FROM (SELECT doc_id, unnest(s) AS x FROM g) UNION ALL SELECT doc_id, 0, x, 0, 1 FROM (SELECT doc_id, unnest(o) AS x FROM g) UNION ALL SELECT doc_id, 1, x, 1, 0 FROM (SELECT doc_id, unnest(sg) AS x FROM g) UNION ALL SELECT doc_id, 1, x, 0, 1 FROM (SELECT doc_id, unnest(og) AS x FROM g)), c AS (SELECT doc_id, kind, x, sum(a) AS a, sum(b) AS b FROM p GROUP BY 1, 2, 3), k AS (SELECT doc_id, kind, sum(a) AS na, sum(b) AS nb, sum(least(a, b)) AS met FROM c GROUP BY 1, 2), w AS (SELECT doc_id, coalesce(max(met) FILTER (kind = 0) / nullif(max(na) FILTER (kind = 0), 0), 1.0) AS recall, coalesce(max(met) FILTER (kind = 1) / nullif(max(na) FILTER (kind = 1), 0), 1.0) AS trigrams, coalesce(max(nb) FILTER (kind = 0) / nullif(max(na) FILTER (kind = 0), 0), 1.0) AS ratio FROM k GROUP BY 1) SELECT doc_id, round(coalesce(recall, 1.0) + 1e-9, 6) AS recall, round(coalesce(trigrams, 1.0) + 1e-9, 6) AS trigrams, round(coalesce(ratio, 1.0) + 1e-9, 6) AS ratio, array_to_string(list_filter([CASE WHEN recall < 0.9 THEN 'recall' END, CASE WHEN trigrams < 0.9 THEN 'trigrams' END, CASE WHEN ratio < 0.9 OR ratio > 1.1 THEN 'ratio' END], lambda x: x IS NOT NULL), ',') AS defects FROM d LEFT JOIN w USING (doc_id)"


@query("j01_chunk_gate", _GATE)
def j01(t):
    d = t.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("output", F.expr(OUTPUT))
    return V.chunk_gate(d, ["doc_id"], "text", "output")
