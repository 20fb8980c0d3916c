"""Queries of section G: joins and matching; and those of section N that are joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregations as A
from ..operators import cascades as C
from ..operators import matching as M
from .aggregate_queries import ARMS, P_SQL, arms
from .registry import query

r6 = lambda c: F.round(c, 6)


@query("g02_paired_arms", "SELECT a.o_custkey, a.n AS n_a, b.n AS n_b FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b USING (o_custkey)")
def g02(t):
    arm = lambda s, n: t.orders.filter(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.count("*").alias(n))
    return arm("F", "n_a").join(arm("O", "n_b"), "o_custkey")


@query("g03_unique_keys", "WITH u AS (SELECT text FROM documents GROUP BY 1 HAVING count(*) = 1) SELECT doc_id, source FROM documents SEMI JOIN u USING (text)")
def g03(t):
    return M.unique_only(t.documents, ["text"]).select("doc_id", "source")


@query("g04_anti", "SELECT c_custkey AS key, 'unanswered' AS kind FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'unknown' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def g04(t):
    c, o = t.customer.select(F.col("c_custkey").alias("key")), t.orders.select(F.col("o_custkey").alias("key"))
    return c.join(o, "key", "left_anti").withColumn("kind", F.lit("unanswered")).unionByName(o.join(c, "key", "left_anti").distinct().withColumn("kind", F.lit("unknown")))


@query("g05_changed_rows", "SELECT l.doc_id FROM labels l JOIN documents d USING (doc_id) WHERE l.quality IS DISTINCT FROM (CASE WHEN d.n_chars > 1000 THEN 1 ELSE 0 END)")
def g05(t):
    new = F.when(F.col("n_chars") > 1000, 1).otherwise(0)
    return t.labels.join(t.documents, "doc_id").filter(~F.col("quality").eqNullSafe(new)).select("doc_id")


@query("g06_alias_groups", "WITH g AS (SELECT p_partkey, list_distinct([p_brand, p_type]) AS names FROM part) SELECT a.p_partkey AS a, b.p_partkey AS b FROM g a JOIN g b ON a.p_partkey < b.p_partkey AND list_has_any(a.names, b.names)")
def g06(t):
    return M.sharing_pairs(t.part, "p_partkey", ("p_brand", "p_type"))


@query("g07_alias_chain", "WITH RECURSIVE e AS (SELECT n_nationkey AS alias, n_nationkey // 2 AS canonical FROM nation WHERE n_nationkey > 1), r AS (SELECT alias, canonical AS root, 1 AS hops FROM e UNION ALL SELECT r.alias, e.canonical, r.hops + 1 FROM r JOIN e ON e.alias = r.root WHERE r.hops < 16) SELECT alias::INT AS alias, arg_max(root, hops)::INT AS root, max(hops)::INT AS hops FROM r GROUP BY 1")
def g07(t):
    e = t.nation.filter("n_nationkey > 1").select(F.col("n_nationkey").alias("alias"), F.expr("cast(n_nationkey div 2 as int)").alias("canonical"))
    return M.resolved_aliases(e, "alias", "canonical")


@query("g08_folded_lookup", "SELECT c_custkey, coalesce(n.n_name, 'unknown') AS canonical FROM customer LEFT JOIN nation n ON lower(n.n_name) = lower((SELECT n_name FROM nation WHERE n_nationkey = c_nationkey))")
def g08(t):
    spoken = t.customer.join(t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.upper("n_name").alias("said")), "c_nationkey", "left")
    known = t.nation.select(F.lower("n_name").alias("fold"), F.col("n_name").alias("canonical"))
    return spoken.join(known, F.lower("said") == F.col("fold"), "left").select("c_custkey", F.coalesce("canonical", F.lit("unknown")).alias("canonical"))


TURNS = "p AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS moment FROM events WHERE event_id % 2 = 0), i AS (SELECT event_id AS turn_id, user_id, floor(epoch(ts))::BIGINT AS a, floor(epoch(ts))::BIGINT + round(value * 600)::BIGINT AS b FROM events WHERE event_id % 2 = 1)"


def turns(t):
    at = F.expr("unix_seconds(cast(ts as timestamp))")
    p = t.events.filter("event_id % 2 = 0").select("event_id", "user_id", at.alias("at"))
    i = t.events.filter("event_id % 2 = 1").select(F.col("event_id").alias("turn_id"), "user_id", at.alias("a"), (at + F.round(F.col("value") * 600).cast("long")).alias("b"))
    return p, i


@query("g10_point_in_interval", f"WITH {TURNS} SELECT event_id, turn_id FROM p JOIN i USING (user_id) WHERE a <= moment AND moment < b")
def g10(t):
    p, i = turns(t)
    return M.in_intervals(p, i, ["user_id"], "at", "a", "b", 86_400).select("event_id", "turn_id")


@query("g11_nearest", f"WITH {TURNS}, r AS (SELECT event_id, turn_id, abs(moment - a) AS distance, row_number() OVER (PARTITION BY event_id ORDER BY abs(moment - a), a, turn_id) AS k FROM p JOIN i USING (user_id)) SELECT event_id, turn_id AS near_id, distance FROM r WHERE k = 1")
def g11(t):
    p, i = turns(t)
    return M.asof_nearest(p, i.select("user_id", "turn_id", F.col("a").alias("at")), ["user_id"], "at", "turn_id").filter("near_id IS NOT NULL").select("event_id", "near_id", "distance")


@query("g12_overlap_semi", f"WITH {TURNS}, q AS (SELECT turn_id, user_id, a, b FROM i WHERE turn_id % 4 = 1), o AS (SELECT user_id, a, b FROM i WHERE turn_id % 4 = 3) SELECT DISTINCT turn_id FROM q JOIN o USING (user_id) WHERE q.a < o.b AND o.a < q.b")
def g12(t):
    _, i = turns(t)
    # an interval that is empty or runs backwards overlaps those that hold b to a inside, so it stands in b's cell alone
    last = F.when(F.col("a") < F.col("b"), F.col("b") - 1).otherwise(F.col("b"))
    cut = lambda df: df.filter("a IS NOT NULL AND b IS NOT NULL").withColumn("cell", F.explode(F.sequence(F.floor(F.least("a", "b") / 86400), F.floor(last / 86400))))
    q, o = cut(i.filter("turn_id % 4 = 1")), cut(i.filter("turn_id % 4 = 3")).select("user_id", "cell", F.col("a").alias("oa"), F.col("b").alias("ob"))
    return q.join(o, (q.user_id == o.user_id) & (q.cell == o.cell) & (q.a < o.ob) & (o.oa < q.b), "left_semi").select("turn_id").distinct()


TOKENS = "SELECT {id}, list_distinct(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS w FROM {table}"


@query("g14_fuzzy_cascade", f"WITH a AS ({TOKENS.format(id='item_id', text='text', table='benchmark')}), b AS ({TOKENS.format(id='conv_id * 1000 + turn AS turn_id', text='text', table='conversations')}), s AS (SELECT item_id, turn_id, len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) AS jaccard FROM a, b WHERE list_has_any(a.w, b.w)), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY jaccard DESC, turn_id) AS k FROM s) SELECT item_id, turn_id, round(jaccard, 6) AS jaccard FROM r WHERE k = 1")
def g14(t):
    c = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), "text")
    s = C.best_sharing(t.benchmark, c, "item_id", "turn_id", "text", "item_id", lambda na, nb, shared: shared / (na + nb - shared))
    return s.select("item_id", "turn_id", r6("score").alias("jaccard"))


@query("g15_token_f1", f"WITH a AS ({TOKENS.format(id='item_id', text='text', table='benchmark')}), b AS ({TOKENS.format(id='page_id', text='url', table='pages')}), s AS (SELECT item_id, page_id, 2 * len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w)) AS f1 FROM a, b WHERE list_has_any(a.w, b.w)), r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY f1 DESC, item_id) AS k FROM s) SELECT page_id, item_id, round(f1, 6) AS f1 FROM r WHERE k = 1")
def g15(t):
    s = C.best_sharing(t.benchmark, t.pages.select("page_id", F.col("url").alias("text")), "item_id", "page_id", "text", "page_id", lambda na, nb, shared: 2 * shared / (na + nb))
    return s.select("page_id", "item_id", r6("score").alias("f1"))


@query("g18_contains_name", "SELECT item_id, p.t AS name, strpos(lower(text), lower(p.t)) AS at FROM benchmark, (SELECT DISTINCT role AS t FROM conversations) p WHERE contains(lower(text), lower(p.t))")
def g18(t):
    names = t.conversations.select(F.col("role").alias("name")).distinct()
    return t.benchmark.join(names, F.contains(F.lower("text"), F.lower("name"))).select("item_id", "name", F.expr("cast(locate(lower(name), lower(text)) as bigint)").alias("at"))


KEY = "lower(regexp_replace(text, '[^A-Za-z0-9]+', '', 'g'))"


@query("g19_locate_quote", f"WITH q AS (SELECT conv_id, turn, substring({KEY}, 1, 24) AS k FROM conversations), s AS (SELECT conv_id, string_agg({KEY}, '|' ORDER BY turn) AS whole FROM conversations GROUP BY 1) SELECT conv_id, turn, CASE WHEN length(k) < 12 THEN 'too_short' WHEN strpos(whole, k) = 0 THEN 'not_found' WHEN strpos(substring(whole, strpos(whole, k) + 1), k) > 0 THEN 'ambiguous' ELSE 'located' END AS status FROM q JOIN s USING (conv_id)")
def g19(t):
    key = F.lower(F.regexp_replace("text", "[^A-Za-z0-9]+", ""))
    q = t.conversations.select("conv_id", "turn", F.substring(key, 1, 24).alias("k"))
    s = t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", key.alias("k")))), lambda x: x["k"]), "|").alias("whole"))
    return q.join(s, "conv_id").select("conv_id", "turn", F.expr("CASE WHEN length(k) < 12 THEN 'too_short' WHEN locate(k, whole) = 0 THEN 'not_found' WHEN locate(k, whole, locate(k, whole) + 1) > 0 THEN 'ambiguous' ELSE 'located' END").alias("status"))


@query("g25_pairing", "WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority LIKE '1%') SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'right_only' WHEN b.k IS NULL THEN 'left_only' ELSE 'paired' END AS kind FROM a FULL JOIN b ON a.k = b.k")
def g25(t):
    a = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")).distinct().withColumn("l", F.lit(1))
    b = t.orders.filter("o_orderpriority LIKE '1%'").select(F.col("o_custkey").alias("k")).distinct().withColumn("r", F.lit(1))
    return a.join(b, "k", "full").select("k", F.expr("CASE WHEN l IS NULL THEN 'right_only' WHEN r IS NULL THEN 'left_only' ELSE 'paired' END").alias("kind"))


@query("g27_pool_override", "SELECT coalesce(a.s_nationkey, b.c_nationkey) AS nation, coalesce(a.bal, b.bal) AS balance FROM (SELECT s_nationkey, round(max(s_acctbal), 2) AS bal FROM supplier GROUP BY 1) a FULL JOIN (SELECT c_nationkey, round(max(c_acctbal), 2) AS bal FROM customer GROUP BY 1) b ON a.s_nationkey = b.c_nationkey")
def g27(t):
    a = t.supplier.groupBy(F.col("s_nationkey").alias("nation")).agg(F.round(F.max("s_acctbal"), 2).alias("x"))
    b = t.customer.groupBy(F.col("c_nationkey").alias("nation")).agg(F.round(F.max("c_acctbal"), 2).alias("y"))
    return a.join(b, "nation", "full").select("nation", F.coalesce("x", "y").alias("balance"))


@query("g30_stripped_key", "SELECT p_partkey, s_suppkey FROM part JOIN supplier ON regexp_replace(lower(p_brand), '[^0-9]', '', 'g') = regexp_replace(lower(s_name), '[^0-9]', '', 'g')")
def g30(t):
    key = lambda c: F.regexp_replace(F.lower(c), "[^0-9]", "")
    return t.part.join(t.supplier, key("p_brand") == key("s_name")).select("p_partkey", "s_suppkey")


@query("n01_leave_one_out", "WITH s AS (SELECT o_orderpriority, o_orderstatus, count(*) FILTER (o_totalprice > 150000) AS c, count(*) AS n FROM orders GROUP BY ALL), x AS (SELECT o.o_orderkey, s.o_orderstatus AS opt, (s.c - CASE WHEN o.o_orderstatus = s.o_orderstatus AND o.o_totalprice > 150000 THEN 1 ELSE 0 END) / nullif(s.n - CASE WHEN o.o_orderstatus = s.o_orderstatus THEN 1 ELSE 0 END, 0) AS rate FROM orders o JOIN s USING (o_orderpriority)), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY rate DESC NULLS LAST, opt) AS k FROM x) SELECT o_orderkey, opt AS choice FROM r WHERE k = 1")
def n01(t):
    s = t.orders.groupBy("o_orderpriority", F.col("o_orderstatus").alias("opt")).agg(F.count_if(F.col("o_totalprice") > 150000).alias("c"), F.count("*").alias("n"))
    own = F.col("o_orderstatus") == F.col("opt")
    rate = (F.col("c") - (own & (F.col("o_totalprice") > 150000)).cast("int")) / F.nullif(F.col("n") - own.cast("int"), F.lit(0))
    x = t.orders.join(s, "o_orderpriority").withColumn("rate", rate)
    return M.best_per(x, ["o_orderkey"], [F.desc_nulls_last("rate"), F.col("opt")]).select("o_orderkey", F.col("opt").alias("choice"))


@query("n02_oracle_bound", f"WITH x AS ({ARMS}) SELECT o_orderpriority, round(avg((a OR b)::INT), 6) AS bound FROM x GROUP BY 1")
def n02(t):
    return arms(t).groupBy("o_orderpriority").agg(r6(F.avg((F.col("a") | F.col("b")).cast("int"))).alias("bound"))


@query("n03_representativeness", "WITH p AS (SELECT lang, median(n_chars) AS pop, avg((n_chars > 1500)::INT) AS pop_long FROM documents GROUP BY 1), s AS (SELECT lang, median(n_chars) AS sam, avg((n_chars > 1500)::INT) AS sam_long FROM documents SEMI JOIN labels USING (doc_id) GROUP BY 1) SELECT lang, pop, sam, round(sam_long - pop_long, 6) AS share_gap FROM p JOIN s USING (lang)")
def n03(t):
    long = F.avg((F.col("n_chars") > 1500).cast("int"))
    p = t.documents.groupBy("lang").agg(F.median("n_chars").alias("pop"), long.alias("pl"))
    s = t.documents.join(t.labels, "doc_id", "left_semi").groupBy("lang").agg(F.median("n_chars").alias("sam"), long.alias("sl"))
    return p.join(s, "lang").select("lang", "pop", "sam", r6(F.col("sl") - F.col("pl")).alias("share_gap"))


@query("n04_agreement_split", f"WITH x AS ({ARMS}) SELECT o_orderpriority, a = b AS agree, count(*) AS n, round(avg((o_orderkey % 3 = 0)::INT), 6) AS accuracy FROM x GROUP BY ALL")
def n04(t):
    return arms(t).groupBy("o_orderpriority", (F.col("a") == F.col("b")).alias("agree")).agg(F.count("*").alias("n"), r6(F.avg((F.col("o_orderkey") % 3 == 0).cast("int"))).alias("accuracy"))


@query("n05_first_token_collisions", "SELECT split_part(p_name, ' ', 1) AS token, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def n05(t):
    return t.part.groupBy(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("token")).agg(F.count("*").alias("n")).filter("n > 1")


@query("n11_band_runs", "WITH x AS (SELECT user_id, event_id, row_number() OVER w AS rn, sum(value) OVER w AS upto, value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT a.user_id, a.event_id AS first_id, b.event_id AS last_id, round(b.upto - a.upto + a.value, 4) AS total FROM x a JOIN x b ON a.user_id = b.user_id AND b.rn BETWEEN a.rn AND a.rn + 5 WHERE round(b.upto - a.upto + a.value, 4) BETWEEN 95 AND 105")
def n11(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = t.events.select("user_id", "event_id", "ts", F.sum("value").over(w).alias("upto"), "value")
    ahead = F.collect_list(F.struct(F.col("event_id").alias("last_id"), F.col("upto").alias("to"))).over(w.rowsBetween(0, 5))
    y = x.withColumn("ahead", ahead).select("user_id", F.col("event_id").alias("first_id"), "upto", "value", F.explode("ahead").alias("e"))
    return y.select("user_id", "first_id", F.col("e.last_id").alias("last_id"), F.round(F.col("e.to") - F.col("upto") + F.col("value"), 4).alias("total")).filter("total BETWEEN 95 AND 105")


@query("n13_token_overlap_topk", f"WITH a AS ({TOKENS.format(id='item_id', text='text', table='benchmark')}), b AS ({TOKENS.format(id='doc_id', text='text', table='documents')}), s AS (SELECT item_id, doc_id, len(list_intersect(a.w, b.w)) AS shared FROM a, b WHERE list_has_any(a.w, b.w)), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id) AS k FROM s WHERE shared >= 2) SELECT item_id, doc_id, shared::BIGINT AS shared FROM r WHERE k <= 3")
def n13(t):
    s = C.best_sharing(t.benchmark, t.documents, "item_id", "doc_id", "text", "item_id", lambda na, nb, shared: shared, k=3, least=2)
    return s.select("item_id", "doc_id", "shared")


@query("n17_selectivity", "WITH x AS (SELECT o_orderpriority, o_orderstatus = 'F' AS base, o_totalprice > 150000 AS arm FROM orders) SELECT o_orderpriority, count(*) FILTER (NOT base) AS failed, count(*) FILTER (NOT base AND arm) AS gained, count(*) FILTER (base AND NOT arm) AS lost FROM x GROUP BY 1")
def n17(t):
    a, b = F.col("a"), F.col("b")
    return arms(t).groupBy("o_orderpriority").agg(F.count_if(~a).alias("failed"), F.count_if(~a & b).alias("gained"), F.count_if(a & ~b).alias("lost"))


@query("n18_all_pairs_arms", f"WITH x AS (SELECT o_custkey, o_orderpriority AS arm, bool_or(o_totalprice > 250000) AS ok FROM orders GROUP BY ALL), d AS (SELECT a.arm AS arm_a, b.arm AS arm_b, count(*) AS n, count(*) FILTER (NOT a.ok AND b.ok) AS fixed, count(*) FILTER (a.ok AND NOT b.ok) AS broke FROM x a JOIN x b ON a.o_custkey = b.o_custkey AND a.arm < b.arm GROUP BY ALL) SELECT *, round({P_SQL}, 6) AS p FROM d")
def n18(t):
    x = t.orders.groupBy("o_custkey", F.col("o_orderpriority").alias("arm")).agg(F.bool_or(F.col("o_totalprice") > 250000).alias("ok"))
    pairs = x.select("o_custkey", F.col("arm").alias("arm_a"), F.col("ok").alias("a")).join(x.select("o_custkey", F.col("arm").alias("arm_b"), F.col("ok").alias("b")), "o_custkey").filter("arm_a < arm_b")
    return A.paired_counts(pairs, ["arm_a", "arm_b"], "a", "b").withColumn("p", r6(A.binomial_tail(F.col("fixed"), F.col("broke"))))


@query("n22_grouped_summary", "SELECT o_orderpriority AS class, o_orderstatus AS arm, count(*) AS n, count(*) FILTER (o_totalprice > 300000) AS failures, round(median(o_totalprice), 4) AS median FROM orders GROUP BY ALL")
def n22(t):
    return t.orders.groupBy(F.col("o_orderpriority").alias("class"), F.col("o_orderstatus").alias("arm")).agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 300000).alias("failures"), F.round(F.median("o_totalprice"), 4).alias("median"))


@query("n25_beats_bound", "WITH s AS (SELECT o_orderpriority AS arm, o_orderstatus AS grp, avg(o_totalprice) AS x FROM orders GROUP BY ALL) SELECT a.arm, a.grp FROM s a JOIN s b ON a.grp = b.grp AND b.arm = '1-URGENT' WHERE a.x > b.x")
def n25(t):
    s = t.orders.groupBy(F.col("o_orderpriority").alias("arm"), F.col("o_orderstatus").alias("grp")).agg(F.avg("o_totalprice").alias("x"))
    top = s.filter("arm = '1-URGENT'").select("grp", F.col("x").alias("bound"))
    return s.join(top, "grp").filter("x > bound").select("arm", "grp")


@query("n28_pooled_accuracy", "SELECT d.lang, d.n_chars > 1500 AS feature, count(*) AS n, round(avg(l.quality), 6) AS accuracy FROM documents d JOIN labels l USING (doc_id) GROUP BY ALL")
def n28(t):
    return t.documents.join(t.labels, "doc_id").groupBy("lang", (F.col("n_chars") > 1500).alias("feature")).agg(F.count("*").alias("n"), r6(F.avg("quality")).alias("accuracy"))


@query("n29_disagreements", "SELECT conv_id, turn, role AS first, CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END AS second FROM conversations WHERE role <> CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END")
def n29(t):
    second = F.when(F.col("turn") % 2 == 0, "user").otherwise("assistant")
    return t.conversations.withColumn("second", second).filter("role <> second").select("conv_id", "turn", F.col("role").alias("first"), "second")


@query("n32_upsert", "SELECT coalesce(c.c_custkey, o.k) AS c_custkey, coalesce(o.seg, c.c_mktsegment) AS c_mktsegment, o.seg IS NOT NULL AS changed FROM customer c FULL JOIN (SELECT o_custkey AS k, max(o_orderpriority) AS seg FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) o ON c.c_custkey = o.k")
def n32(t):
    changes = t.orders.filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("c_mktsegment"))
    return M.upsert(t.customer.select("c_custkey", "c_mktsegment"), changes, "c_custkey", ["c_mktsegment"])


@query("n33_catalogue_counts", "SELECT p_brand, count(DISTINCT p_partkey) AS parts, count(l_orderkey) AS lines FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
def n33(t):
    lines = t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n"))
    return t.part.join(lines, F.col("p_partkey") == F.col("l_partkey"), "left").groupBy("p_brand").agg(F.countDistinct("p_partkey").alias("parts"), F.coalesce(F.sum("n"), F.lit(0)).alias("lines"))


@query("n34_review_tally", "SELECT event_type AS choice, count(*) AS n, count(*) FILTER (ts < TIMESTAMP '2024-01-15') AS expired FROM events GROUP BY 1")
def n34(t):
    return t.events.groupBy(F.col("event_type").alias("choice")).agg(F.count("*").alias("n"), F.count_if(F.col("ts") < F.expr("timestamp_ntz'2024-01-15 00:00:00'")).alias("expired"))


@query("n37_label_override", "SELECT conv_id, turn, coalesce(upper(nullif(regexp_extract(text, '^([A-Za-z]+):', 1), '')), role) AS speaker FROM conversations")
def n37(t):
    label = F.nullif(F.regexp_extract("text", r"\A([A-Za-z]+):", 1), F.lit(""))
    return t.conversations.select("conv_id", "turn", F.coalesce(F.upper(label), "role").alias("speaker"))


@query("n39_reset_stuck", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END AS status FROM orders")
def n39(t):
    return t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "O").otherwise(F.col("o_orderstatus")).alias("status"))


@query("n40_arm_deltas", "WITH w AS (SELECT role, conv_id % 2 AS arm, len(regexp_extract_all(text, '[^ ]+')) AS n FROM conversations) SELECT role, count(*) FILTER (arm = 1) - count(*) FILTER (arm = 0) AS entry_delta, (coalesce(sum(n) FILTER (arm = 1), 0) - coalesce(sum(n) FILTER (arm = 0), 0))::BIGINT AS word_delta FROM w GROUP BY 1")
def n40(t):
    sign = F.when(F.col("conv_id") % 2 == 1, 1).otherwise(-1)
    return t.conversations.groupBy("role").agg(F.sum(sign).alias("entry_delta"), F.sum(sign * F.regexp_count("text", F.lit("[^ ]+"))).alias("word_delta"))


@query("n41_run_churn", "WITH x AS (SELECT o_custkey, o_orderpriority AS run, bool_or(o_totalprice > 250000) AS ok FROM orders GROUP BY ALL) SELECT a.run AS run_a, b.run AS run_b, count(*) AS n, count(*) FILTER (a.ok <> b.ok) AS changed FROM x a JOIN x b ON a.o_custkey = b.o_custkey AND a.run < b.run GROUP BY ALL")
def n41(t):
    x = t.orders.groupBy("o_custkey", F.col("o_orderpriority").alias("run")).agg(F.bool_or(F.col("o_totalprice") > 250000).alias("ok"))
    pairs = x.select("o_custkey", F.col("run").alias("run_a"), F.col("ok").alias("a")).join(x.select("o_custkey", F.col("run").alias("run_b"), F.col("ok").alias("b")), "o_custkey").filter("run_a < run_b")
    return pairs.groupBy("run_a", "run_b").agg(F.count("*").alias("n"), F.count_if(F.col("a") != F.col("b")).alias("changed"))
