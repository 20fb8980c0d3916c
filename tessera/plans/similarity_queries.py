"""Queries of sections D (vectors and hashes) and H (duplicates, similarity, graphs)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import similarity as S
from .registry import query

r6 = lambda c: F.round(c, 6)


@query("d01_semitones", "SELECT l_linenumber, round(avg(abs(12 * log2(l_quantity / nullif(l_tax * 100, 0)))), 6) AS semitones FROM lineitem GROUP BY 1")
def d01(t):
    return t.lineitem.groupBy("l_linenumber").agg(r6(F.avg(F.abs(12 * F.log2(F.col("l_quantity") / F.nullif(F.col("l_tax") * 100, F.lit(0.0)))))).alias("semitones"))


@query("d02_octave_ratio", "SELECT l_returnflag, count(*) FILTER (abs(log2(l_quantity / 10)) BETWEEN 0.8 AND 1.2) AS octaves FROM lineitem GROUP BY 1")
def d02(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.count_if(F.abs(F.log2(F.col("l_quantity") / 10)).between(0.8, 1.2)).alias("octaves"))


@query("d04_band_labels", "SELECT CASE WHEN n_chars < 200 THEN 'short' WHEN n_chars < 2000 THEN 'medium' ELSE 'long' END AS band, count(*) AS n FROM documents GROUP BY 1")
def d04(t):
    return t.documents.groupBy(F.when(F.col("n_chars") < 200, "short").when(F.col("n_chars") < 2000, "medium").otherwise("long").alias("band")).agg(F.count("*").alias("n"))


@query("d05_stable_hash", "SELECT o_orderkey, sha256('{\"k\":' || o_orderkey || ',\"p\":\"' || o_orderpriority || '\",\"s\":\"' || o_orderstatus || '\"}') AS hash FROM orders")
def d05(t):
    return t.orders.select("o_orderkey", F.sha2(F.to_json(F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"))), 256).alias("hash"))


@query("d06_content_hash", "SELECT doc_id, sha256(text) AS sha FROM documents")
def d06(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha"))


@query("d07_name_seed", "SELECT c_custkey, ('0x' || substring(sha256(c_name), 1, 8))::BIGINT & 2147483647 AS seed FROM customer")
def d07(t):
    return t.customer.select("c_custkey", F.conv(F.substring(F.sha2("c_name", 256), 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(2147483647)).alias("seed"))


@query("d08_signal_statistics", "SELECT vec_id, round(sqrt(list_avg(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS rms, round(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))), 6) AS peak, round(len(list_filter(embedding, lambda x: abs(x::DOUBLE) < 0.05)) / len(embedding), 6) AS silence FROM embeddings")
def d08(t):
    x = F.transform("embedding", lambda x: x.cast("double"))
    n = F.size("embedding")
    return t.embeddings.select("vec_id", r6(F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v) / n)).alias("rms"), r6(F.array_max(F.transform(x, F.abs))).alias("peak"), r6(F.size(F.filter(x, lambda v: F.abs(v) < 0.05)) / n).alias("silence"))


@query("d09_warnings", "SELECT l_orderkey, l_linenumber, l_partkey, concat_ws(',', CASE WHEN l_discount > 0.08 THEN 'discount' END, CASE WHEN l_tax > 0.07 THEN 'tax' END, CASE WHEN l_quantity < 3 THEN 'small' END) AS warnings FROM lineitem")
def d09(t):
    w = F.array_compact(F.array(F.when(F.col("l_discount") > 0.08, "discount"), F.when(F.col("l_tax") > 0.07, "tax"), F.when(F.col("l_quantity") < 3, "small")))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(w, ",").alias("warnings"))


@query("d10_cosine", "SELECT a.vec_id, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS cosine FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) a JOIN (SELECT vec_id - 1 AS vec_id, embedding::DOUBLE[] AS v FROM embeddings) b USING (vec_id)")
def d10(t):
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return t.embeddings.join(b, "vec_id").select("vec_id", r6(S.cosine(F.col("embedding"), F.col("other"))).alias("cosine"))


@query("d11_histogram_overlap", "WITH m AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem WHERE l_returnflag IN ('A', 'N')), h AS (SELECT l_returnflag AS g, least(floor((l_extendedprice - lo) / (hi - lo) * 20), 19) AS bin, count(*) AS n FROM lineitem, m WHERE l_returnflag IN ('A', 'N') GROUP BY ALL), p AS (SELECT g, bin, n / sum(n) OVER (PARTITION BY g) AS p FROM h) SELECT round(sum(least(a.p, b.p)), 6) AS overlap FROM p a JOIN p b USING (bin) WHERE a.g = 'A' AND b.g = 'N'")
def d11(t):
    x = t.lineitem.filter(F.col("l_returnflag").isin("A", "N"))
    m = x.agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))
    b = F.least(F.floor((F.col("l_extendedprice") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 20), F.lit(19))
    h = x.join(F.broadcast(m)).groupBy(b.alias("bin")).agg(F.count_if(F.col("l_returnflag") == "A").alias("a"), F.count_if(F.col("l_returnflag") == "N").alias("n"))  # m is one row
    total = h.agg(F.sum("a").alias("ta"), F.sum("n").alias("tn"))
    return h.join(F.broadcast(total)).agg(r6(F.sum(F.least(F.col("a") / F.col("ta"), F.col("n") / F.col("tn")))).alias("overlap"))


@query("d12_elapsed", "SELECT event_id, round(epoch_us(ts - TIMESTAMP '2024-01-01') / 1e6, 3) AS seconds FROM events")
def d12(t):
    start = F.expr("unix_micros(cast(timestamp_ntz'2024-01-01 00:00:00' as timestamp))")
    return t.events.select("event_id", F.round((F.expr("unix_micros(cast(ts as timestamp))") - start) / 1e6, 3).alias("seconds"))


@query("d13_progress", "WITH x AS (SELECT user_id, event_id, ts, row_number() OVER w / count(*) OVER (PARTITION BY user_id) AS f, value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, round(f, 6) AS fraction, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS clamped FROM x")
def d13(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", r6(F.row_number().over(w) / F.count("*").over(Window.partitionBy("user_id"))).alias("fraction"), F.max("value").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("clamped"))


@query("d15_unique_extend", "WITH x AS (SELECT doc_id, list_concat(regexp_extract_all(substring(text, 1, 60), '[a-z]+'), regexp_extract_all(substring(text, 61, 60), '[a-z]+')) AS w FROM documents) SELECT doc_id, array_to_string(list_filter(w, lambda v, i: list_position(w, v) = i)[1:8], ',') AS words FROM x")
def d15(t):
    words = lambda c: F.regexp_extract_all(c, F.lit("[a-z]+"), F.lit(0))
    return t.documents.select("doc_id", F.array_join(F.slice(F.array_distinct(F.concat(words(F.substring("text", 1, 60)), words(F.substring("text", 61, 60)))), 1, 8), ",").alias("words"))


@query("d16_boundary_overlap", "WITH x AS (SELECT conv_id, turn, string_split(text, ' ') AS b, lag(string_split(text, ' ')) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations) SELECT conv_id, turn, coalesce(list_max(list_filter(range(1, least(len(a), len(b)) + 1), lambda n: a[len(a) - n + 1:len(a)] = b[1:n])), 0) AS overlap FROM x WHERE a IS NOT NULL")
def d16(t):
    b = F.split("text", " ")
    x = t.conversations.select("conv_id", "turn", b.alias("b"), F.lag(b).over(Window.partitionBy("conv_id").orderBy("turn")).alias("a")).filter("a IS NOT NULL")
    n = F.expr("array_max(filter(sequence(1, least(size(a), size(b))), n -> slice(a, -n, n) = slice(b, 1, n)))")
    return x.select("conv_id", "turn", F.coalesce(n, F.lit(0)).cast("long").alias("overlap"))


@query("d17_ordinal_distance", "SELECT o_orderkey, abs(substring(o_orderpriority, 1, 1)::INT - list_position(['F', 'O', 'P'], o_orderstatus)) AS distance FROM orders")
def d17(t):
    return t.orders.select("o_orderkey", F.abs(F.substring("o_orderpriority", 1, 1).cast("int") - F.array_position(F.array(*map(F.lit, "FOP")), F.col("o_orderstatus")).cast("int")).alias("distance"))


@query("d18_blend_capacity", "SELECT k, (CASE k WHEN 1 THEN 10 WHEN 2 THEN 45 ELSE 120 END * (CASE k WHEN 1 THEN 1 WHEN 2 THEN 4 ELSE 6 END))::BIGINT AS blends FROM (SELECT unnest([1, 2, 3]) AS k)")
def d18(t):
    n, steps = 10, 5
    choose = lambda n, k: F.expr(f"aggregate(sequence(1, {k}), cast(1 as double), (s, i) -> s * ({n} - i + 1) / i)")
    return t.spark.range(1, 4).select(F.col("id").cast("int").alias("k"), F.round(choose(n, "id") * F.when(F.col("id") == 1, 1.0).otherwise(choose(steps - 1, "greatest(id - 1, 1)"))).cast("long").alias("blends"))


@query("h01_exact_dedup", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def h01(t):
    return t.documents.groupBy(F.octet_length("text").alias("n"), F.sha2("text", 256).alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


VECTORS = "WITH u AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)"


@query("h03_group_similarity", f"{VECTORS} SELECT a.label AS a, b.label AS b, round(avg(list_dot_product(a.v, b.v) / (a.n * b.n)), 6) AS similarity FROM u a JOIN u b ON a.label <= b.label GROUP BY ALL")
def h03(t):
    return S.group_similarity(t.embeddings, "label", "embedding").withColumn("similarity", r6("similarity"))


@query("h04_complete_link")
def h04(t):
    return S.complete_link(S.group_similarity(t.embeddings, "label", "embedding"), 0.02)


@query("h05_cohesion", f"{VECTORS} SELECT a.label, round((sum(list_dot_product(a.v, b.v) / (a.n * b.n)) - count(DISTINCT a.vec_id)) / (count(*) - count(DISTINCT a.vec_id)), 6) AS cohesion FROM u a JOIN u b USING (label) GROUP BY 1")
def h05(t):
    # the mean over different members: the mean over all pairs less the diagonal of ones
    same = S.group_similarity(t.embeddings, "label", "embedding").filter("a = b").select(F.col("a").alias("label"), "similarity")
    n = t.embeddings.groupBy("label").agg(F.count("*").alias("n"))
    return same.join(n, "label").select("label", r6((F.col("similarity") * F.col("n") - 1) / (F.col("n") - 1)).alias("cohesion"))


@query("h06_earth_movers", "WITH c AS (SELECT l_returnflag AS g, l_quantity AS x, count(*) AS n FROM lineitem GROUP BY ALL), p AS (SELECT g, x, n / sum(n) OVER (PARTITION BY g) AS p FROM c), k AS (SELECT a.g AS a, b.g AS b FROM (SELECT DISTINCT g FROM p) a JOIN (SELECT DISTINCT g FROM p) b ON a.g < b.g), s AS (SELECT a, b, x, sum(p) AS p FROM (SELECT a, b, x, p FROM k JOIN p ON g = a UNION ALL SELECT a, b, x, -p FROM k JOIN p ON g = b) GROUP BY ALL), w AS (SELECT a, b, abs(sum(p) OVER v) * (lead(x) OVER v - x) AS area FROM s WINDOW v AS (PARTITION BY a, b ORDER BY x)) SELECT a, b, round(sum(area), 6) AS distance FROM w GROUP BY ALL")
def h06(t):
    return S.earth_movers(t.lineitem, "l_returnflag", "l_quantity").withColumn("distance", r6("distance"))


@query("h08_medoid_rank", f"{VECTORS}, s AS (SELECT a.label, a.vec_id, avg(list_dot_product(a.v, b.v) / (a.n * b.n)) AS s FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS k FROM s) SELECT label, vec_id, round(s, 6) AS similarity FROM r WHERE k = 1")
def h08(t):
    # a member's mean similarity to the others is its dot product with the group's sum of unit vectors, less itself
    v = t.embeddings.withColumn("n", F.sqrt(S.dot(F.col("embedding"), F.col("embedding")))).filter("n > 0")
    unit = v.select("label", "vec_id", F.posexplode(F.transform("embedding", lambda x: x.cast("double") / F.col("n"))).alias("i", "x"))
    total = unit.groupBy("label", "i").agg(F.sum("x").alias("t"), F.count("*").alias("m"))
    s = unit.join(total, ["label", "i"]).groupBy("label", "vec_id").agg(((F.sum(F.col("x") * F.col("t")) - 1) / (F.first("m") - 1)).alias("s"))
    return s.groupBy("label").agg(F.max_by(F.struct("vec_id", "s"), F.struct(F.round("s", 9), (-F.col("vec_id")).alias("k"))).alias("b")).select("label", "b.vec_id", r6("b.s").alias("similarity"))


@query("h09_cooccurrence", "SELECT DISTINCT least(a.event_type, b.event_type) AS a, greatest(a.event_type, b.event_type) AS b FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) a JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) b ON a.user_id = b.user_id AND b.rn > a.rn AND b.rn - a.rn < 3 AND a.event_type <> b.event_type")
def h09(t):
    return S.cooccurrence(t.events, ["user_id"], "ts", "event_type", 3)


@query("h10_conflicts", "WITH e AS (SELECT DISTINCT least(a.role, b.role) AS a, greatest(a.role, b.role) AS b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn - a.turn BETWEEN 1 AND 2 AND a.role <> b.role), s AS (SELECT role, length(role) % 2 AS slot FROM conversations GROUP BY 1) SELECT e.a, e.b FROM e JOIN s x ON x.role = a JOIN s y ON y.role = b WHERE x.slot = y.slot")
def h10(t):
    e = S.cooccurrence(t.conversations, ["conv_id"], "turn", "role", 3)
    s = t.conversations.select("role", (F.length("role") % 2).alias("slot")).distinct()
    return e.join(s.select(F.col("role").alias("a"), F.col("slot").alias("x")), "a").join(s.select(F.col("role").alias("b"), F.col("slot").alias("y")), "b").filter("x = y").select("a", "b")


@query("h14_split_identities", "WITH g AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS k, count(*) OVER (PARTITION BY p_brand) AS kinds, count(*) OVER (PARTITION BY p_brand, n) AS ties FROM g) SELECT p_brand, p_type AS winner, kinds, ties > 1 AS ambiguous FROM r WHERE k = 1 AND kinds > 1")
def h14(t):
    g = t.part.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    w = Window.partitionBy("p_brand")
    r = g.withColumn("k", F.row_number().over(w.orderBy(F.desc("n"), "p_type"))).withColumn("kinds", F.count("*").over(w)).withColumn("ties", F.count("*").over(Window.partitionBy("p_brand", "n")))
    return r.filter("k = 1 AND kinds > 1").select("p_brand", F.col("p_type").alias("winner"), "kinds", (F.col("ties") > 1).alias("ambiguous"))


@query("h15_stable_identity", "WITH x AS (SELECT lower(regexp_replace(p_name, '[^A-Za-z0-9]+', '', 'g')) AS key, p_name, p_partkey, length(p_name) - length(replace(p_name, ' ', '')) AS gaps FROM part) SELECT key, arg_min(p_name, gaps * 1000000 + p_partkey) AS name, count(*) AS n FROM x GROUP BY 1")
def h15(t):
    x = t.part.select(F.lower(F.regexp_replace("p_name", "[^A-Za-z0-9]+", "")).alias("key"), "p_name", "p_partkey", (F.length("p_name") - F.length(F.replace("p_name", F.lit(" "), F.lit("")))).alias("gaps"))
    return x.groupBy("key").agg(F.min_by("p_name", F.struct("gaps", "p_partkey")).alias("name"), F.count("*").alias("n"))


@query("h16_name_variants", "SELECT lower(regexp_replace(p_name, '[^A-Za-z]+', '', 'g')) AS key, count(DISTINCT p_name) AS forms, CASE WHEN count(DISTINCT p_name) > 1 THEN 'variants' ELSE 'single' END AS kind FROM part GROUP BY 1")
def h16(t):
    n = F.countDistinct("p_name")
    return t.part.groupBy(F.lower(F.regexp_replace("p_name", "[^A-Za-z]+", "")).alias("key")).agg(n.alias("forms"), F.when(n > 1, "variants").otherwise("single").alias("kind"))


CAPS = "(SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z]?[a-z]+')) AS w FROM documents)"


@query("h17_roster", f"SELECT lower(w) AS name, count(*) FILTER (w <> lower(w)) AS capitalised, count(*) FILTER (w = lower(w)) AS lower_case FROM {CAPS} GROUP BY 1 HAVING count(*) FILTER (w <> lower(w)) >= 3 AND count(*) FILTER (w <> lower(w)) > 2 * count(*) FILTER (w = lower(w))")
def h17(t):
    w = t.documents.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Z]?[a-z]+"), F.lit(0))).alias("w"))
    g = w.groupBy("w").agg(F.count("*").alias("n")).groupBy(F.lower("w").alias("name")).agg(F.coalesce(F.sum(F.when(F.col("w") != F.lower("w"), F.col("n"))), F.lit(0)).alias("capitalised"), F.coalesce(F.sum(F.when(F.col("w") == F.lower("w"), F.col("n"))), F.lit(0)).alias("lower_case"))
    return g.filter("capitalised >= 3 AND capitalised > 2 * lower_case")


@query("h18_proper_nouns", "SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[a-z,] ([A-Z][a-z]+)', 1)) AS w FROM documents) GROUP BY 1 HAVING count(*) >= 2")
def h18(t):
    w = t.documents.select(F.explode(F.regexp_extract_all("text", F.lit("[a-z,] ([A-Z][a-z]+)"), F.lit(1))).alias("w"))
    return w.groupBy("w").agg(F.count("*").alias("n")).filter("n >= 2")


@query("h19_term_verdict", "WITH c AS (SELECT w, count(*) FILTER (lang = 'en') AS en, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]{2,5}')) AS w FROM documents) GROUP BY 1) SELECT w, n, CASE WHEN n < 20 THEN 'rare' WHEN en > 0.9 * n THEN 'en' WHEN en < 0.1 * n THEN 'other' ELSE 'mixed' END AS verdict FROM c")
def h19(t):
    w = t.documents.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,5}"), F.lit(0))).alias("w"))
    c = w.groupBy("w").agg(F.count_if(F.col("lang") == "en").alias("en"), F.count("*").alias("n"))
    return c.select("w", "n", F.expr("CASE WHEN n < 20 THEN 'rare' WHEN en > 0.9 * n THEN 'en' WHEN en < 0.1 * n THEN 'other' ELSE 'mixed' END").alias("verdict"))


@query("h20_unique_lines", "SELECT doc_id FROM (SELECT doc_id, count(*) OVER (PARTITION BY lower(text)) AS n FROM documents WHERE n_chars >= 40) WHERE n = 1")
def h20(t):
    x = t.documents.filter("n_chars >= 40").select("doc_id", F.xxhash64(F.lower("text")).alias("a"), F.crc32(F.lower("text").cast("binary")).alias("b"))
    return x.groupBy("a", "b").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).filter("n = 1").select("doc_id")
