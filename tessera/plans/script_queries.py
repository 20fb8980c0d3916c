"""More of sections F, G, J and N: windows over turns and lines, matching, contracts and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import scripts as S
from .registry import query

r6 = lambda c: F.round(c, 6)


@query("f04_near_repeats")
def f04(t):
    return S.adjacent_near_repeats(t.conversations, ["conv_id"], "turn", "text", 0.9, 5)


@query("f06_context_until_two", "WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events), p AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR pos = 1 THEN pos END AS s, CASE WHEN event_type IS DISTINCT FROM lead(event_type) OVER w OR lead(pos) OVER w IS NULL THEN pos END AS e, max(pos) OVER (PARTITION BY user_id) AS n FROM r WINDOW w AS (PARTITION BY user_id ORDER BY pos)), q AS (SELECT *, max(s) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS a, min(e) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM p), d AS (SELECT event_id, CASE WHEN a > 1 THEN pos - a + 1 END AS back, CASE WHEN b < n THEN b - pos + 1 END AS ahead FROM q) SELECT event_id, least(coalesce(least(back, ahead), 40), 40)::INT AS before, least(coalesce(least(back, ahead), 20), 20)::INT AS after FROM d")
def f06(t):
    pos = Window.partitionBy("user_id").orderBy("event_id")
    rows = t.events.select("user_id", "event_id", "event_type").withColumn("pos", F.row_number().over(pos))
    return S.widened(rows, ["user_id"], "pos", "event_type", 40, 20).select("event_id", "before", "after")


LINES = "WITH q AS (SELECT doc_id, replace(coalesce(text, ''), ',', '\"') AS text FROM documents), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM q), n AS (SELECT *, len(line) - len(replace(line, '\"', '')) AS marks FROM l)"


@query("f18_quote_regions", f"{LINES}, d AS (SELECT *, coalesce(sum(marks) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n) SELECT doc_id, count(*) AS n_lines, count(*) FILTER (before % 2 = 1) AS opened_inside, count(*) FILTER (marks % 2 = 1) AS unbalanced, CASE WHEN sum(marks) % 2 = 1 THEN 'open' ELSE 'closed' END AS at_end FROM d GROUP BY 1")
def f18(t):
    lines = S.lines(t.documents.select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), ",", '"').alias("text")), "text")
    state = S.quote_state(lines, ["doc_id"], "pos", "line")
    return state.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(F.col("before") % 2 == 1).alias("opened_inside"), F.count_if(F.col("marks") % 2 == 1).alias("unbalanced"), F.when(F.sum("marks") % 2 == 1, "open").otherwise("closed").alias("at_end"))


@query("f16_packed_chunks")
def f16(t):
    return S.packed_chunks(t.documents.filter("text IS NOT NULL"), "doc_id", "text", 1000)


@query("f17_midpoint_split", "WITH s AS (SELECT doc_id, text, string_split(text, '. ') AS parts FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, length(text) AS n, unnest(parts) AS part, unnest(range(len(parts))) AS i, len(parts) AS m FROM s), o AS (SELECT doc_id, n, i, m, sum(length(part) + 2) OVER (PARTITION BY doc_id ORDER BY i) AS off FROM p), c AS (SELECT * FROM o WHERE i < m - 1 AND off >= 400 AND n - off >= 400), b AS (SELECT doc_id, n, off, row_number() OVER (PARTITION BY doc_id ORDER BY abs(off - n / 2.0), off) AS r FROM c) SELECT doc_id, n, CAST(off AS BIGINT) AS cut FROM b WHERE r = 1")
def f17(t):
    return S.midpoint(t.documents.filter("text IS NOT NULL"), "doc_id", "text", ". ", 400)


@query("f25_length_batches")
def f25(t):
    rows = t.conversations.select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    return S.length_batches(rows, "n", ["conv_id", "turn"], 16, 1.25)


@query("f28_bridged_turns", "WITH e AS (SELECT user_id, event_id, event_type, floor(epoch(ts))::BIGINT AS ms0 FROM events), f AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR ms0 - lag(ms0) OVER w > 3600 THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms0, event_id)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ms0, event_id ROWS UNBOUNDED PRECEDING) AS run FROM f), d AS (SELECT user_id, event_type, run, max(ms0) - min(ms0) AS took, count(*) AS n FROM g GROUP BY 1, 2, 3) SELECT user_id, event_type, count(*) AS turns, CAST(sum(took) AS BIGINT) AS seconds FROM d GROUP BY 1, 2")
def f28(t):
    e = t.events.select("user_id", "event_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    turns = S.bridged(e, ["user_id"], ["at", "event_id"], "event_type", "at", 3600)
    return turns.groupBy("user_id", "event_type").agg(F.count("*").alias("turns"), F.sum("length").cast("long").alias("seconds"))


@query("g01_nearest_equal", "WITH d AS (SELECT doc_id, md5(text) AS k FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, lag(doc_id) OVER x AS a, lead(doc_id) OVER x AS b FROM d WINDOW x AS (PARTITION BY k ORDER BY doc_id)) SELECT doc_id, CASE WHEN b IS NULL OR doc_id - a <= b - doc_id THEN a ELSE b END AS other FROM w WHERE a IS NOT NULL OR b IS NOT NULL")
def g01(t):
    return S.nearest_equal(t.documents.filter("text IS NOT NULL"), F.sha2("text", 256), "doc_id").select("doc_id", "other")


@query("g09_matching_blocks")
def g09(t):
    turns = t.conversations.groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("a"), F.max(F.when(F.col("turn") == 2, F.col("text"))).alias("b"))
    return S.aligned(turns, "a", "b").drop("a", "b")


@query("g28_pick_source", "WITH w AS (SELECT DISTINCT doc_id, lang, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents), v AS (SELECT w, lang FROM w WHERE lang IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5), h AS (SELECT d.doc_id, v.lang AS pick, count(*) AS n FROM w d JOIN v USING (w) GROUP BY 1, 2), s AS (SELECT doc_id, count(*) AS total FROM w GROUP BY 1), r AS (SELECT doc_id, pick, n / total AS score, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pick) AS place FROM h JOIN s USING (doc_id)) SELECT a.doc_id, CASE WHEN a.score - coalesce(b.score, 0) >= 0.1 THEN a.pick END AS pick, round(a.score + 1e-9, 6) AS score FROM r a LEFT JOIN r b ON a.doc_id = b.doc_id AND b.place = 2 WHERE a.place = 1")
def g28(t):
    return S.picked_source(t.documents, "doc_id", "lang", "text", 5, 0.1)


@query("g29_label_of_text", r"WITH d AS (SELECT doc_id, md5(lower(regexp_replace(text, '\s+', ' ', 'g'))) AS k, lang FROM documents WHERE text IS NOT NULL), c AS (SELECT k, lang, count(*) AS n FROM d WHERE lang IS NOT NULL GROUP BY 1, 2), m AS (SELECT k, arg_max(lang, struct_pack(n := n, l := -ascii(lang))) AS lang, sum(n) AS total FROM c GROUP BY 1) SELECT doc_id, m.lang AS usual, CAST(coalesce(m.total, 0) AS BIGINT) AS labelled FROM d LEFT JOIN m USING (k)")
def g29(t):
    d = t.documents.filter("text IS NOT NULL").select("doc_id", F.sha2(F.lower(F.regexp_replace("text", r"\s+", " ")), 256).alias("k"), "lang")
    return S.usual_label(d, "k", "lang").select("doc_id", "usual", "labelled")


@query("j02_missing_spans")
def j02(t):
    d = t.documents.filter("text IS NOT NULL").select("doc_id", F.col("text").alias("a"), F.regexp_replace("text", r"[.!?][^.!?]*[.!?]", ".").alias("b"))
    return S.missing_spans(d, "doc_id", "a", "b", 5, 3)


@query("n06_argmax_or_abstain", "WITH s AS (SELECT o_custkey, o_orderpriority, round(max(-o_totalprice), -4) AS score FROM orders GROUP BY 1, 2), m AS (SELECT o_custkey, max(score) AS best FROM s GROUP BY 1) SELECT o_custkey, CASE WHEN count(*) = 1 THEN min(o_orderpriority) END AS choice, count(*) AS tied FROM s JOIN m USING (o_custkey) WHERE score = best GROUP BY 1")
def n06(t):
    scores = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.round(F.max(-F.col("o_totalprice")), -4).alias("score"))
    return S.argmax_or_none(scores, ["o_custkey"], "o_orderpriority", "score")


@query("n10_last_mentions", "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w, unnest(range(len(regexp_extract_all(text, '[A-Za-z]+')))) AS pos FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, w, max(pos) AS last FROM w WHERE regexp_matches(w, '^[A-Z][a-z]{3}') GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY last DESC) AS place FROM n) SELECT doc_id, string_agg(w, ',' ORDER BY place) AS recent FROM r WHERE place <= 5 GROUP BY 1")
def n10(t):
    return S.last_mentions(t.documents.filter("text IS NOT NULL"), "doc_id", "text", "^[A-Z][a-z]{3}", 5)


_Q = "replace(coalesce(text, ''), ',', '\"')"


@query("n14_quote_coverage", f"WITH q AS (SELECT conv_id, turn, role, {_Q} AS x FROM conversations), c AS (SELECT *, CASE WHEN length(x) = 0 THEN 0.0 ELSE (length(x) - length(regexp_replace(x, '\"[^\"]*\"', '', 'g'))) / length(x) END AS share FROM q) SELECT conv_id, turn, round(share + 1e-9, 6) AS share, CASE WHEN share >= 0.5 AND role = 'assistant' THEN 'narrator_speaks' WHEN share = 0 AND role = 'user' THEN 'speaker_narrates' ELSE 'ok' END AS verdict FROM c")
def n14(t):
    share = S.quoted_share(F.regexp_replace(F.coalesce("text", F.lit("")), ",", '"'))
    c = t.conversations.select("conv_id", "turn", "role", share.alias("share"))
    verdict = F.when((F.col("share") >= 0.5) & (F.col("role") == "assistant"), "narrator_speaks").when((F.col("share") == 0) & (F.col("role") == "user"), "speaker_narrates").otherwise("ok")
    return c.select("conv_id", "turn", r6(F.col("share") + 1e-9).alias("share"), verdict.alias("verdict"))


@query("n15_scattered_overlap", "WITH c AS (SELECT p_partkey, string_split(replace(p_name, ' ', ''), '') AS a, string_split(lower(p_type), '') AS b, replace(p_name, ' ', '') AS x, lower(p_type) AS y FROM part) SELECT p_partkey, round(list_sum(list_transform(list_distinct(a), lambda k: least(len(list_filter(a, lambda z: z = k)), len(list_filter(b, lambda z: z = k))))) / len(a) + 1e-9, 6) AS scattered, contains(x, y) AS contiguous FROM c")
def n15(t):
    c = t.part.select("p_partkey", F.regexp_replace("p_name", " ", "").alias("x"), F.lower("p_type").alias("y"))
    return c.select("p_partkey", r6(S.scattered(F.col("x"), F.col("y")) + 1e-9).alias("scattered"), F.col("x").contains(F.col("y")).alias("contiguous"))


@query("n16_term_verdicts", "WITH a AS (SELECT o_custkey, o_orderstatus AS arm, avg(o_totalprice) > 150000 AS yes FROM orders GROUP BY 1, 2), c AS (SELECT o_custkey, count(*) AS arms, count(*) FILTER (yes) AS yes FROM a GROUP BY 1) SELECT o_custkey, arms, yes, CASE WHEN arms < 2 THEN 'uncorroborated' WHEN yes = arms THEN 'confirmed' WHEN yes = 0 THEN 'rejected' ELSE 'disputed' END AS verdict FROM c")
def n16(t):
    a = t.orders.groupBy("o_custkey", "o_orderstatus").agg((F.avg("o_totalprice") > 150000).alias("yes"))
    c = a.groupBy("o_custkey").agg(F.count("*").alias("arms"), F.count_if("yes").alias("yes"))
    return c.withColumn("verdict", F.when(F.col("arms") < 2, "uncorroborated").when(F.col("yes") == F.col("arms"), "confirmed").when(F.col("yes") == 0, "rejected").otherwise("disputed"))


@query("n19_reference_similarity", "WITH e AS (SELECT label, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL), f AS (SELECT label, arg_min(v, vec_id) AS ref, min(vec_id) AS ref_id FROM e GROUP BY 1), s AS (SELECT label, floor(list_dot_product(v, ref) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(ref, ref))) * 1000 + 1e-7) / 1000 AS s FROM e JOIN f USING (label) WHERE vec_id <> ref_id), c AS (SELECT label, s, count(*) AS n FROM s GROUP BY 1, 2), u AS (SELECT *, sum(n) OVER (PARTITION BY label ORDER BY s) AS upto, sum(n) OVER (PARTITION BY label) AS total FROM c) SELECT label, round(min(s) FILTER (2 * upto >= total), 3) AS median, CAST(max(total) AS BIGINT) AS n FROM u GROUP BY 1")
def n19(t):
    return S.reference_similarity(t.embeddings, "label", "vec_id", "embedding")


@query("n23_row_contract", "WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT 'duplicate' AS finding, count(*) AS n FROM k WHERE n > 1 UNION ALL SELECT 'foreign', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'damaged', count(*) FROM lineitem WHERE l_quantity IS NULL OR l_quantity <= 0 OR l_discount < 0 OR l_discount > 1")
def n23(t):
    good = F.coalesce((F.col("l_quantity") > 0) & F.col("l_discount").between(0, 1), F.lit(False))
    return S.row_contract(t.lineitem, ["l_orderkey", "l_linenumber"], t.orders.select(F.col("o_orderkey").alias("l_orderkey")), good)


@query("n26_forms_in_text", "WITH f AS (SELECT unnest(string_split(lower(p_name), ' ')) AS form, 'roster' AS origin FROM part UNION SELECT lower(p_type), 'config' FROM part UNION SELECT unnest(string_split(lower(text), ' ')[1:3]), 'alias' FROM benchmark), w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS form FROM documents) SELECT form, origin FROM f SEMI JOIN w USING (form)")
def n26(t):
    forms = t.part.select(F.explode(F.split(F.lower("p_name"), " ")).alias("form"), F.lit("roster").alias("origin"))
    forms = forms.unionByName(t.part.select(F.lower("p_type").alias("form"), F.lit("config").alias("origin")))
    forms = forms.unionByName(t.benchmark.select(F.explode(F.slice(F.split(F.lower("text"), " "), 1, 3)).alias("form"), F.lit("alias").alias("origin"))).distinct()
    return S.mentioned(forms, "form", t.documents, "text")


@query("n27_position_bias", "WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders), b AS (SELECT o_custkey, arg_max(pos, struct_pack(p := o_totalprice, k := o_orderkey)) AS pos, max(n) AS n FROM r GROUP BY 1) SELECT n, count(*) AS lists, round(avg(pos / n) + 1e-9, 6) AS place FROM b GROUP BY 1")
def n27(t):
    w = Window.partitionBy("o_custkey")
    r = t.orders.select("o_custkey", "o_orderkey", "o_totalprice", (F.row_number().over(w.orderBy("o_orderkey")) - 1).alias("pos"), F.count("*").over(w).alias("n"))
    b = r.groupBy("o_custkey").agg(F.max_by("pos", F.struct("o_totalprice", "o_orderkey")).alias("pos"), F.max("n").alias("n"))
    return b.groupBy("n").agg(F.count("*").alias("lists"), r6(F.avg(F.col("pos") / F.col("n")) + 1e-9).alias("place"))


@query("n30_alias_responses", "SELECT c.c_custkey, CASE WHEN lower(n.n_name) = lower(c.c_mktsegment) OR lower(r.r_name) IN ('africa', 'narrator') THEN NULL ELSE r.r_name END AS alias_of FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey WHERE NOT (lower(n.n_name) = lower(c.c_mktsegment) OR lower(r.r_name) IN ('africa', 'narrator'))")
def n30(t):
    n = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("said"), "n_regionkey")
    r = t.region.select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("alias_of"))
    rows = t.customer.select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("who")).join(n, "c_nationkey").join(r, "n_regionkey")
    return S.kept_aliases(rows, "who", "said", "alias_of", ["africa", "narrator"]).select("c_custkey", "alias_of")


@query("n31_traits_by_priority", "SELECT p_partkey, coalesce(nullif(regexp_extract(p_name, '(small|large|medium)', 1), ''), CASE WHEN p_type = 'ECONOMY' THEN 'small' END, CASE WHEN p_size > 25 THEN 'large' END, 'unknown') AS size, CASE WHEN regexp_matches(p_name, '(small|large|medium)') THEN 'name' WHEN p_type = 'ECONOMY' THEN 'type' WHEN p_size > 25 THEN 'number' ELSE 'none' END AS evidence FROM part")
def n31(t):
    named = F.nullif(F.regexp_extract("p_name", "(small|large|medium)", 1), F.lit(""))
    size, evidence = S.by_priority([("name", named), ("type", F.when(F.col("p_type") == "ECONOMY", "small")), ("number", F.when(F.col("p_size") > 25, "large"))])
    return t.part.select("p_partkey", size.alias("size"), evidence.alias("evidence"))


@query("n36_introduced_characters", "WITH d AS (SELECT doc_id, text AS a, replace(text, 'q', '�') AS b FROM documents WHERE text IS NOT NULL) SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct(string_split(b, '')), lambda x: NOT contains(a, x))), '') AS introduced, (length(b) - length(replace(b, '�', ''))) <= 0.005 * length(b) AS acceptable FROM d")
def n36(t):
    d = t.documents.filter("text IS NOT NULL").select("doc_id", F.col("text").alias("a"), F.regexp_replace("text", "q", "�").alias("b"))
    return S.introduced(d, "a", "b").select("doc_id", "introduced", "acceptable")


@query("n38_state_report", "WITH d AS (SELECT source, count(*) AS documents, count(l.doc_id) AS labelled, count(*) FILTER (l.toxic = 1) AS toxic, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY 1) SELECT *, CASE WHEN labelled = 0 THEN 'pending' WHEN labelled < documents THEN 'partial' ELSE 'done' END AS state FROM d")
def n38(t):
    d = t.documents.join(t.labels, "doc_id", "left").groupBy("source").agg(F.count("*").alias("documents"), F.count("toxic").alias("labelled"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))
    return d.withColumn("langs", F.when(F.col("langs") != "", F.col("langs"))).withColumn("state", F.when(F.col("labelled") == 0, "pending").when(F.col("labelled") < F.col("documents"), "partial").otherwise("done"))
