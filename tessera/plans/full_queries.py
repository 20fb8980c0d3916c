"""More whole forms: rows of the survey of which an earlier query does a part."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregations as A
from ..operators import similarity as S
from .aggregate_queries import P_SQL
from .registry import query
from .similarity_queries import VECTORS

r6 = lambda c: F.round(c, 6)


@query("n11_band_runs_whole", "WITH x AS (SELECT user_id, event_id, row_number() OVER w AS rn, sum(value) OVER w AS upto, value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT a.user_id, a.event_id AS first_id, b.event_id AS last_id, b.rn - a.rn + 1 AS n, round(b.upto - a.upto + a.value, 4) AS total FROM x a JOIN x b ON a.user_id = b.user_id AND b.rn >= a.rn WHERE round(b.upto - a.upto + a.value, 4) BETWEEN 395 AND 405")
def n11_whole(t):
    # a run's sum is the difference of two running sums: rows meet by steps of them as wide as the band's upper end
    w, high = Window.partitionBy("user_id").orderBy("ts", "event_id"), 406.0
    x = t.events.select("user_id", "event_id", "value", F.row_number().over(w).alias("rn"), F.sum("value").over(w).alias("upto"))
    step = lambda c: F.floor(c / high)
    before = F.col("upto") - F.col("value")
    first = x.select("user_id", F.col("event_id").alias("first_id"), F.col("rn").alias("i"), F.col("upto").alias("begin"), "value", F.explode(F.array_distinct(F.array(step(before + 394), step(before + high)))).alias("step"))
    last = x.select("user_id", F.col("event_id").alias("last_id"), F.col("rn").alias("j"), F.col("upto").alias("end"), step(F.col("upto")).alias("step"))
    met = first.join(last, ["user_id", "step"]).filter("j >= i").withColumn("total", F.round(F.col("end") - F.col("begin") + F.col("value"), 4))
    return met.filter("total BETWEEN 395 AND 405").select("user_id", "first_id", "last_id", (F.col("j") - F.col("i") + 1).alias("n"), "total")


SPLIT = "md5(CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) || ':' || CAST(trial AS VARCHAR)) < '8'"


@query("e24_null_distribution", f"WITH s AS (SELECT l_suppkey, trial, {SPLIT} AS half, l_quantity FROM lineitem, range(20) t(trial)), m AS (SELECT l_suppkey, trial, avg(l_quantity) FILTER (half) / avg(l_quantity) FILTER (NOT half) AS ratio FROM s GROUP BY 1, 2) SELECT l_suppkey, count(ratio) AS trials, round(quantile_cont(ratio, 0.05) + 1e-9, 6) AS p5, round(quantile_cont(ratio, 0.95) + 1e-9, 6) AS p95, round(count(*) FILTER (ratio NOT BETWEEN 0.9 AND 1.1) / count(ratio), 6) AS outside FROM m GROUP BY 1")
def e24_whole(t):
    every = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("trial"))
    half = F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "trial")]).cast("binary")) < "8"
    means = every.groupBy("l_suppkey", "trial").agg((F.avg(F.when(half, F.col("l_quantity"))) / F.avg(F.when(~half, F.col("l_quantity")))).alias("ratio"))
    at = lambda p: r6(F.percentile("ratio", F.lit(p)) + 1e-9)  # noqa: E731  of as many values as trials
    return means.groupBy("l_suppkey").agg(F.count("ratio").alias("trials"), at(0.05).alias("p5"), at(0.95).alias("p95"), r6(F.count_if(~F.col("ratio").between(0.9, 1.1)) / F.count("ratio")).alias("outside"))


@query("d06_content_hashes", "SELECT doc_id, sha256(text) AS whole, sha256(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS letters, sha256(substr(text, 1, 256) || '|' || right(text, 256) || '|' || length(text)) AS edges FROM documents")
def d06_whole(t):
    edges = F.concat_ws("|", F.substring("text", 1, 256), F.right("text", F.lit(256)), F.length("text").cast("string"))
    return t.documents.select("doc_id", F.sha2("text", 256).alias("whole"), F.sha2(F.regexp_replace(F.lower("text"), "[^a-z0-9]", ""), 256).alias("letters"), F.when(F.col("text").isNotNull(), F.sha2(edges, 256)).alias("edges"))


PAIRS = {"curly": "“[^“”]*”", "straight": '"[^"]*"', "guillemets": "«[^«»]*»", "corners": "「[^「」]*」"}
QUOTED = "replace(replace(text, ', ', CASE doc_id % 3 WHEN 0 THEN ' “' WHEN 1 THEN ' \"' ELSE ' «' END), '.', CASE doc_id % 3 WHEN 0 THEN '.”' WHEN 1 THEN '.\"' ELSE '.»' END)"


@query("f21_convention", f"WITH q AS (SELECT doc_id, {QUOTED} AS t FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(t, '{p}')) AS {k}" for k, p in PAIRS.items()) + " FROM q) SELECT *, CASE WHEN greatest(curly, straight, guillemets, corners) < 5 THEN 'none' WHEN curly = greatest(curly, straight, guillemets, corners) THEN 'curly' WHEN straight = greatest(curly, straight, guillemets, corners) THEN 'straight' WHEN guillemets = greatest(curly, straight, guillemets, corners) THEN 'guillemets' ELSE 'corners' END AS convention FROM n")
def f21_whole(t):
    # the way of quoting that most spans have, of five at least; of equal ones the first
    q = t.documents.filter("text IS NOT NULL").select("doc_id", F.expr(QUOTED).alias("t"))
    n = q.select("doc_id", *(F.regexp_count("t", F.lit(p)).cast("long").alias(k) for k, p in PAIRS.items()))
    most, said = F.greatest(*PAIRS), F
    for i, k in enumerate(PAIRS):
        said = said.when((F.col(k) == most) & (most >= 5), k)
    return n.withColumn("convention", said.otherwise("none"))


TIMES = "epoch_us(ts) / 1000000.0 AS a, epoch_us(ts) / 1000000.0 + value AS b"


@query("f22_validated_spans", f"WITH s AS (SELECT user_id, event_id, {TIMES} FROM events), e AS (SELECT user_id, max(a) AS last FROM s GROUP BY 1), x AS (SELECT s.*, last, lag(b) OVER (PARTITION BY s.user_id ORDER BY a, event_id) AS p FROM s JOIN e USING (user_id)) SELECT event_id, CASE WHEN b <= a THEN 'not_positive' WHEN a > last + 0.05 THEN 'out_of_bounds' WHEN b > last + 0.05 THEN 'clamped_end' WHEN a < p - 0.05 THEN 'overlaps' WHEN a < p THEN 'clamped_start' ELSE 'ok' END AS finding, round(least(b, last) - CASE WHEN a < p AND a >= p - 0.05 THEN p ELSE a END, 3) AS seconds FROM x")
def f22_whole(t):
    # a user's spans lie before the last event; ends and starts off by 0.05 s at most are put right
    micros = F.expr("unix_micros(cast(ts as timestamp))")
    s = t.events.select("user_id", "event_id", (micros / 1000000.0).alias("a"), (micros / 1000000.0 + F.col("value")).alias("b"))
    w = Window.partitionBy("user_id")
    x = s.withColumn("last", F.max("a").over(w)).withColumn("p", F.lag("b").over(w.orderBy("a", "event_id")))
    finding = F.expr("CASE WHEN b <= a THEN 'not_positive' WHEN a > last + 0.05 THEN 'out_of_bounds' WHEN b > last + 0.05 THEN 'clamped_end' WHEN a < p - 0.05 THEN 'overlaps' WHEN a < p THEN 'clamped_start' ELSE 'ok' END")
    return x.select("event_id", finding.alias("finding"), F.round(F.least("b", "last") - F.expr("CASE WHEN a < p AND a >= p - 0.05 THEN p ELSE a END"), 3).alias("seconds"))


@query("h10_least_gaps", "WITH e AS (SELECT DISTINCT least(a.l_suppkey, b.l_suppkey) AS a, greatest(a.l_suppkey, b.l_suppkey) AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber - a.l_linenumber = 1 AND a.l_suppkey <> b.l_suppkey), s AS (SELECT s_suppkey, s_nationkey AS slot, s_acctbal AS pitch FROM supplier), g AS (SELECT x.slot, abs(x.pitch - y.pitch) AS gap, e.a, e.b FROM e JOIN s x ON x.s_suppkey = a JOIN s y ON y.s_suppkey = b WHERE x.slot = y.slot) SELECT slot, count(*) AS conflicts, round(min(gap), 2) AS least_gap, arg_min(a, struct_pack(g := gap, a := a, b := b)) AS a, arg_min(b, struct_pack(g := gap, a := a, b := b)) AS b FROM g GROUP BY 1")
def h10_whole(t):
    # neighbours that share a slot, and in each slot the pair whose pitches lie closest
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    after = t.lineitem.select("l_orderkey", F.col("l_suppkey").alias("y"), (F.col("l_linenumber") - 1).alias("l_linenumber"))
    e = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("x")).join(after, ["l_orderkey", "l_linenumber"]).filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    side = lambda k: t.supplier.select(F.col("s_suppkey").alias(k), F.col("s_nationkey").alias(f"slot_{k}"), F.col("s_acctbal").alias(f"pitch_{k}"))
    g = e.join(side("a"), "a").join(side("b"), "b").filter("slot_a = slot_b").withColumn("gap", F.abs(F.col("pitch_a") - F.col("pitch_b")))
    best = g.groupBy(F.col("slot_a").alias("slot")).agg(F.count("*").alias("conflicts"), F.min(F.struct("gap", "a", "b")).alias("m"))
    return best.select("slot", "conflicts", F.round("m.gap", 2).alias("least_gap"), "m.a", "m.b")


RESERVED = "SELECT p_name, 1 + p_size % 5 AS k FROM part WHERE p_size % 7 = 0 GROUP BY ALL"


@query("i12_unique_names_whole", f"WITH r AS (SELECT p_name, list(k) AS taken FROM ({RESERVED}) GROUP BY 1), x AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS i, coalesce(taken, []) AS taken FROM part LEFT JOIN r USING (p_name)), n AS (SELECT *, list_filter(range(1, i + len(taken) + 1), lambda k: NOT list_contains(taken, k))[i] AS k FROM x) SELECT p_partkey, p_name || CASE WHEN k > 1 THEN '_' || k ELSE '' END AS name FROM n")
def i12_whole(t):
    # a name's holders get the name, name_2, name_3, ... in order, less what is reserved
    taken = t.part.filter("p_size % 7 = 0").groupBy("p_name").agg(F.collect_set((F.col("p_size") % 5 + 1).cast("int")).alias("taken"))
    x = t.part.select("p_partkey", "p_name", F.row_number().over(Window.partitionBy("p_name").orderBy("p_partkey")).alias("i")).join(taken, "p_name", "left")
    taken = F.coalesce("taken", F.array().cast("array<int>"))
    # the i-th number that isn't reserved: i, moved on once for each reserved number that it reaches
    k = F.aggregate(F.array_sort(taken), F.col("i"), lambda a, r: F.when(r <= a, a + 1).otherwise(a))
    return x.select("p_partkey", F.concat("p_name", F.when(k > 1, F.concat(F.lit("_"), k)).otherwise("")).alias("name"))


@query("j06_attested", "WITH n AS (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL), x AS (SELECT c.conv_id, c.turn, c.role, n.n, first_value(c.role) OVER (PARTITION BY c.conv_id ORDER BY c.turn) AS narrator FROM conversations c LEFT JOIN n ON n.conv_id = c.conv_id AND n.role = c.role) SELECT conv_id, turn, CASE WHEN role IS NULL OR role = '' THEN 'missing' WHEN role IN ('SPOKEN', 'NARRATOR', 'system') THEN 'entry_type' WHEN n < 2 THEN 'not_attested' WHEN turn > 0 AND turn % 4 = 0 AND role <> narrator THEN 'narrator_changed' ELSE 'ok' END AS finding FROM x")
def j06_whole(t):
    # a speaker is attested by another turn of the conversation; every fourth turn is the narrator's, who speaks first
    own = t.conversations.groupBy("conv_id", "role").agg(F.count("*").alias("n"), F.min("turn").alias("first"))
    narrator = own.groupBy("conv_id").agg(F.min_by("role", "first").alias("narrator"))
    x = t.conversations.select("conv_id", "turn", "role").join(own.select("conv_id", "role", "n"), ["conv_id", "role"], "left").join(narrator, "conv_id")
    return x.select("conv_id", "turn", F.expr("CASE WHEN role IS NULL OR role = '' THEN 'missing' WHEN role IN ('SPOKEN', 'NARRATOR', 'system') THEN 'entry_type' WHEN n < 2 THEN 'not_attested' WHEN turn > 0 AND turn % 4 = 0 AND role <> narrator THEN 'narrator_changed' ELSE 'ok' END").alias("finding"))


FINDINGS = {"empty_text": "coalesce(trim(text), '') = ''", "short_text": "length(text) < 40", "long_text": "length(text) > 600", "repeated_role": "role = last_role", "missing_turn": "turn > coalesce(last_turn, -1) + 1", "same_text": "text = last_text", "unbalanced_quotes": "(length(text) - length(replace(text, '\"', ''))) % 2 = 1", "no_stop": "NOT text LIKE '%.' AND NOT text LIKE '%!' AND NOT text LIKE '%?'", "shouting": "text = upper(text) AND text <> lower(text)"}
LAST = "lag(role) OVER w AS last_role, lag(turn) OVER w AS last_turn, lag(text) OVER w AS last_text"


@query("j07_audit_whole", f"WITH x AS (SELECT *, {LAST} FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), f AS (" + " UNION ALL ".join(f"SELECT '{k}' AS finding, conv_id FROM x WHERE {p}" for k, p in FINDINGS.items()) + ") SELECT finding, count(*) AS n, count(DISTINCT conv_id) AS conversations FROM f GROUP BY 1")
def j07_whole(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = t.conversations.withColumns({f"last_{c}": F.lag(c).over(w) for c in ("role", "turn", "text")})
    found = F.array_compact(F.array(*(F.when(F.expr(p), k) for k, p in FINDINGS.items())))
    each = x.select("conv_id", F.explode(found).alias("finding")).groupBy("finding", "conv_id").agg(F.count("*").alias("n"))
    return each.groupBy("finding").agg(F.sum("n").alias("n"), F.count("*").alias("conversations"))


@query("j11_contract_whole", "WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL), s AS (SELECT l_orderkey, count(*) AS rows, count(DISTINCT l_linenumber) AS ids, max(l_linenumber) AS last FROM lineitem GROUP BY 1) SELECT 'duplicate' AS finding, l_orderkey, CAST(l_linenumber AS BIGINT) AS detail FROM k WHERE n > 1 UNION ALL SELECT 'missing_id', l_orderkey, CAST(last - ids AS BIGINT) FROM s WHERE last > ids UNION ALL SELECT 'summary', l_orderkey, rows - last FROM s WHERE rows <> last UNION ALL SELECT 'unknown_arm', l_orderkey, count(*) FROM lineitem WHERE l_returnflag = 'N' AND l_linestatus = 'F' GROUP BY 2 UNION ALL SELECT 'no_rows', o_orderkey, 0 FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def j11_whole(t):
    # rows of an order are numbered from 1, each number once; the last number is the recorded count; N goes with O alone; every order has rows
    l = A.dealt(t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"), "l_orderkey")  # noqa: E741
    k = l.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    s = k.groupBy("l_orderkey").agg(F.sum("n").alias("rows"), F.count("*").alias("ids"), F.max("l_linenumber").cast("long").alias("last"))
    row = lambda df, finding, detail: df.select(F.lit(finding).alias("finding"), "l_orderkey", F.expr(detail).cast("long").alias("detail"))
    lost = A.dealt(t.orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").join(l.select("l_orderkey"), "l_orderkey", "left_anti")
    arm = l.filter("l_returnflag = 'N' AND l_linestatus = 'F'").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return row(k.filter("n > 1"), "duplicate", "l_linenumber").unionByName(row(s.filter("last > ids"), "missing_id", "last - ids")).unionByName(row(s.filter("rows <> last"), "summary", "rows - last")).unionByName(row(arm, "unknown_arm", "n")).unionByName(row(lost, "no_rows", "0"))


RULES = [r"^([A-Z][a-z]+) (?:said|asked|and) ", r" (?:said|of|the) ([A-Z][a-z]+)", r" ([A-Z][a-z]+) [a-z]+\.$", r"^([A-Z][a-z]+)(?:[^\p{L}]|$)"]


@query("j19_four_rules", "SELECT conv_id, turn, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN {i}" for i, p in enumerate(RULES, 1)) + " END AS rule, coalesce(" + ", ".join(f"nullif(regexp_extract(text, '{p}', 1), '')" for p in RULES) + ") AS speaker FROM conversations")
def j19_whole(t):
    # in Java a plain $ also matches before a last line feed, and ^ after none: both ends are said plainly
    rules = [(r"\A" + p[1:] if p[0] == "^" else p).replace("$", r"\z") for p in RULES]
    rule = F
    for i, p in enumerate(rules, 1):
        rule = rule.when(F.col("text").rlike(p), i)
    return t.conversations.select("conv_id", "turn", rule.alias("rule"), F.coalesce(*(F.nullif(F.regexp_extract("text", p, 1), F.lit("")) for p in rules)).alias("speaker"))


BIAS = "WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders), b AS (SELECT o_custkey, arg_max(pos, struct_pack(p := o_totalprice, k := o_orderkey)) AS pos, max(n) AS n FROM r GROUP BY 1), d AS (SELECT n, count(*) FILTER (2 * pos < n - 1) AS fixed, count(*) FILTER (2 * pos > n - 1) AS broke FROM b GROUP BY 1)"


@query("n27_sign_test", f"{BIAS} SELECT n, fixed AS early, broke AS late, round({P_SQL} + 1e-9, 6) AS p FROM d")
def n27_whole(t):
    # whether the best of a list stands before or after its middle, by lists of one length
    w = Window.partitionBy("o_custkey")
    r = t.orders.select("o_custkey", "o_orderkey", "o_totalprice", (F.row_number().over(w.orderBy("o_orderkey")) - 1).alias("pos"), F.count("*").over(w).alias("n"))
    b = r.groupBy("o_custkey").agg(F.max_by("pos", F.struct("o_totalprice", "o_orderkey")).alias("pos"), F.max("n").alias("n"))
    d = b.groupBy("n").agg(F.count_if(F.expr("2 * pos < n - 1")).alias("early"), F.count_if(F.expr("2 * pos > n - 1")).alias("late"))
    return d.withColumn("p", r6(A.binomial_tail(F.col("early"), F.col("late")) + 1e-9))


@query("n41_run_statistics", "WITH x AS (SELECT o_custkey, o_orderpriority AS run, bool_or(o_totalprice > 250000)::INT AS ok FROM orders GROUP BY ALL), k AS (SELECT o_custkey FROM x GROUP BY 1 HAVING count(*) = 5), s AS (SELECT x.* FROM x JOIN k USING (o_custkey)), r AS (SELECT run, avg(ok) AS rate, count(*) AS ids FROM s GROUP BY 1), c AS (SELECT a.run AS run, avg((a.ok <> b.ok)::INT) AS churn FROM s a JOIN s b ON a.o_custkey = b.o_custkey AND a.run <> b.run GROUP BY 1) SELECT run, ids, round(rate + 1e-9, 6) AS rate, round(churn + 1e-9, 6) AS churn, round((SELECT avg(rate) FROM r) + 1e-9, 6) AS mean, round((SELECT stddev_samp(rate) FROM r) + 1e-9, 6) AS sd, round((SELECT max(rate) - min(rate) FROM r) + 1e-9, 6) AS spread FROM r JOIN c USING (run)")
def n41_whole(t):
    # ids that all five runs have; churn: how often another run's answer differs, by counts of right answers and no pairs
    x = t.orders.groupBy("o_custkey", F.col("o_orderpriority").alias("run")).agg(F.bool_or(F.col("o_totalprice") > 250000).cast("int").alias("ok"))
    s = x.join(x.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("ok").alias("right")).filter("n = 5"), "o_custkey")
    other = F.when(F.col("ok") == 1, 5 - F.col("right")).otherwise(F.col("right")) / 4
    r = s.groupBy("run").agg(F.count("*").alias("ids"), F.avg("ok").alias("rate"), F.avg(other).alias("churn"))
    of = r.agg(F.avg("rate").alias("mean"), F.stddev_samp("rate").alias("sd"), (F.max("rate") - F.min("rate")).alias("spread"))
    return r.crossJoin(F.broadcast(of)).select("run", "ids", *(r6(F.col(c) + 1e-9).alias(c) for c in ("rate", "churn", "mean", "sd", "spread")))


@query("b05_split_volumes", "WITH x AS (SELECT *, CASE WHEN md5('42:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey) < '1' THEN 'val' ELSE 'train' END AS split FROM lineitem) SELECT l_suppkey, split, (row_number() OVER (PARTITION BY l_suppkey, split ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1) // 200 AS vol, l_orderkey, l_linenumber, l_partkey FROM x")
def b05_whole(t):
    # a sixteenth of the rows, by a seeded digest of their ids, is for validation; volumes of 200 rows in each part
    split = F.when(F.md5(F.concat_ws(":", F.lit("42"), "l_orderkey", "l_linenumber", "l_partkey").cast("binary")) < "1", "val").otherwise("train")
    x = t.lineitem.withColumn("split", split)
    return x.select("l_suppkey", "split", F.expr("(row_number() OVER (PARTITION BY l_suppkey, split ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1) div 200").alias("vol"), "l_orderkey", "l_linenumber", "l_partkey")


@query("f14_cut_or_sentence_end", "WITH x AS (SELECT user_id, event_id, event_type, epoch_us(lead(ts) OVER w) - epoch_us(ts) AS gap, row_number() OVER w AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), c AS (SELECT *, CASE WHEN gap >= 28800000000 THEN 0 WHEN event_type = 'purchase' THEN 1 ELSE 2 END AS kind FROM x WHERE rn > 0.7 * n AND gap IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY kind, CASE WHEN kind = 0 THEN -gap ELSE -rn END) AS k FROM c) SELECT user_id, event_id AS cut_after, kind FROM r WHERE k = 1")
def f14_whole(t):
    # in the last 30 %: after the longest pause of 8 hours or more; else after the last purchase; else after the last row but one
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = t.events.withColumn("at", F.expr("unix_micros(cast(ts as timestamp))")).withColumn("gap", F.lead("at").over(w) - F.col("at")).withColumn("rn", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("user_id")))
    c = x.filter("rn > 0.7 * n AND gap IS NOT NULL").withColumn("kind", F.expr("CASE WHEN gap >= 28800000000 THEN 0 WHEN event_type = 'purchase' THEN 1 ELSE 2 END"))
    best = F.min(F.struct("kind", F.when(F.col("kind") == 0, -F.col("gap")).otherwise(-F.col("rn")).alias("at"), "event_id")).alias("b")
    return c.groupBy("user_id").agg(best).select("user_id", F.col("b.event_id").alias("cut_after"), "b.kind")


@query("h05_matrix", f"{VECTORS}, m AS (SELECT a.label AS a, b.label AS b, avg(list_dot_product(a.v, b.v) / (a.n * b.n)) AS similarity FROM u a JOIN u b ON a.label <= b.label GROUP BY ALL), r AS (SELECT *, CASE WHEN a < b THEN row_number() OVER (PARTITION BY a < b ORDER BY round(similarity, 9) DESC, a, b) END AS top, CASE WHEN a < b THEN row_number() OVER (PARTITION BY a < b ORDER BY round(similarity, 9), a, b) END AS bottom FROM m) SELECT a, b, round(similarity, 6) AS similarity, CASE WHEN top <= 5 THEN 'top' WHEN bottom <= 5 THEN 'bottom' END AS mark FROM r")
def h05_whole(t):
    # the matrix of groups, its five most and five least alike pairs marked
    m = S.group_similarity(t.embeddings, "label", "embedding")
    alike = F.round("similarity", 9)
    pair = m.filter("a < b")
    top = pair.orderBy(alike.desc(), "a", "b").limit(5).select("a", "b", F.lit("top").alias("mark"))
    bottom = pair.orderBy(alike, "a", "b").limit(5).select("a", "b", F.lit("bottom").alias("low"))
    return m.join(top, ["a", "b"], "left").join(bottom, ["a", "b"], "left").select("a", "b", r6("similarity").alias("similarity"), F.coalesce("mark", "low").alias("mark"))


ROSTER = "SELECT w AS name FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}')) AS w FROM documents) GROUP BY 1 HAVING count(*) >= 4"


@query("g18_names_in_text", f"WITH m AS (SELECT item_id, lower(w) AS w, i FROM (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w, unnest(range(len(regexp_extract_all(text, '[A-Za-z]+')))) AS i FROM benchmark)), r AS ({ROSTER}), h AS (SELECT item_id, r.name, max(i) AS last FROM m JOIN r ON lower(r.name) = m.w GROUP BY ALL) SELECT item_id, CAST(count(*) AS BIGINT) AS n_names, arg_max(name, struct_pack(i := last, n := name)) AS nearest, count(*) = 1 AS sole FROM h GROUP BY 1")
def g18_whole(t):
    # names of the roster that a text has, the one mentioned last before its end, and whether it is the only one; names meet words, not texts
    names = t.documents.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{3,}"), F.lit(0)))).alias("name")).groupBy("name").agg(F.count("*").alias("n")).filter("n >= 4")
    words = t.benchmark.select("item_id", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("i", "w"))
    last = words.withColumn("w", F.lower("w")).join(names.select("name", F.lower("name").alias("w")), "w").groupBy("item_id", "name").agg(F.max("i").alias("last"))
    return last.groupBy("item_id").agg(F.count("*").alias("n_names"), F.max_by("name", F.struct("last", "name")).alias("nearest"), (F.count("*") == 1).alias("sole"))


@query("g04_unlabelled", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def g04_whole(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left_anti")


@query("g30_stripped_titles", "WITH a AS (SELECT DISTINCT p_name AS title, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS k FROM part), b AS (SELECT p_partkey, regexp_replace(lower(upper(replace(p_name, ' ', '-')) || '!'), '[^a-z0-9]', '', 'g') AS k FROM part) SELECT p_partkey, title FROM b JOIN a USING (k)")
def g30_whole(t):
    key = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    titles = t.part.select(F.col("p_name").alias("title"), key("p_name").alias("k")).distinct()
    return t.part.select("p_partkey", key(F.concat(F.upper(F.replace("p_name", F.lit(" "), F.lit("-"))), F.lit("!"))).alias("k")).join(titles, "k").select("p_partkey", "title")


@query("j15_label_coverage", "SELECT coalesce(d.doc_id, l.doc_id) AS id, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'unknown' END AS finding FROM documents d FULL JOIN (SELECT doc_id * 3 AS doc_id FROM labels WHERE doc_id IS NOT NULL) l ON l.doc_id = d.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def j15_whole(t):
    d = t.documents.select(F.col("doc_id").alias("id"), F.lit(1).alias("a"))
    l = t.labels.filter("doc_id IS NOT NULL").select((F.col("doc_id") * 3).alias("id"), F.lit(1).alias("b"))  # noqa: E741
    return d.join(l, "id", "full").filter("a IS NULL OR b IS NULL").select("id", F.when(F.col("b").isNull(), "missing").otherwise("unknown").alias("finding"))
