"""Queries of section E: aggregations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregations as A
from .registry import query

r6 = lambda c: F.round(c, 6)
TOKENS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"
BAND_SQL = "CASE WHEN {x} >= 0.90 THEN '>=0.90' WHEN {x} >= 0.75 THEN '0.75-0.90' WHEN {x} >= 0.60 THEN '0.60-0.75' WHEN {x} >= 0.30 THEN '0.30-0.60' WHEN {x} IS NOT NULL THEN '<0.30' END"


def halves(t):
    """Each document's first half of characters as output, the whole as source."""
    return t.documents.select("doc_id", "text", F.expr("substring(text, 1, length(text) div 2)").alias("output"))


HALF_SQL = f"""
WITH s AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({TOKENS}) AS token FROM documents) GROUP BY ALL),
o AS (SELECT doc_id, token, count(*) AS m FROM (SELECT doc_id, unnest({TOKENS}) AS token FROM (SELECT doc_id, substring(text, 1, length(text) // 2) AS text FROM documents)) GROUP BY ALL)
"""


@query("e01_multiset_recall", HALF_SQL + "SELECT d.doc_id, round(coalesce(r.recall, 1.0), 6) AS recall FROM documents d LEFT JOIN (SELECT doc_id, sum(least(n, coalesce(m, 0)))::DOUBLE / sum(n) AS recall FROM s LEFT JOIN o USING (doc_id, token) GROUP BY doc_id) r USING (doc_id)")
def e01(t):
    source = halves(t)
    recall = A.shared_words(source, ["doc_id"], "text", "output").filter("n_source > 0").select("doc_id", (F.col("met") / F.col("n_source")).alias("recall"))
    return source.select("doc_id").join(recall, "doc_id", "left").select("doc_id", r6(F.coalesce("recall", F.lit(1.0))).alias("recall"))


@query("e02_coverage", HALF_SQL + "SELECT d.doc_id, round(coalesce(r.coverage, 0.0), 6) AS coverage, coalesce(r.missing, 0)::BIGINT AS missing, coalesce(r.extra, 0)::BIGINT AS extra FROM documents d LEFT JOIN (SELECT doc_id, sum(least(coalesce(n, 0), coalesce(m, 0)))::DOUBLE / nullif(sum(coalesce(n, 0)), 0) AS coverage, sum(greatest(coalesce(n, 0) - coalesce(m, 0), 0)) AS missing, sum(greatest(coalesce(m, 0) - coalesce(n, 0), 0)) AS extra FROM s FULL JOIN o USING (doc_id, token) GROUP BY doc_id) r USING (doc_id)")
def e02(t):
    source, n, m, met = halves(t), F.col("n_source"), F.col("n_output"), F.col("met")
    both = A.shared_words(source, ["doc_id"], "text", "output").select("doc_id", (met / F.nullif(n, F.lit(0))).alias("coverage"), (n - met).alias("missing"), (m - met).alias("extra"))
    return source.select("doc_id").join(both, "doc_id", "left").select("doc_id", r6(F.coalesce("coverage", F.lit(0.0))).alias("coverage"), F.coalesce("missing", F.lit(0)).alias("missing"), F.coalesce("extra", F.lit(0)).alias("extra"))


@query("e03_majority_vote", "WITH c AS (SELECT conv_id, role, count(*) AS n, min(turn) AS first FROM conversations WHERE role IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, first) AS rn, sum(n) OVER (PARTITION BY conv_id) AS cast_votes FROM c) SELECT conv_id, role AS winner, n AS votes, round(n / cast_votes, 6) AS confidence FROM r WHERE rn = 1")
def e03(t):
    return A.majority_vote(t.conversations, ["conv_id"], "role", "turn").withColumn("confidence", r6(F.col("confidence")))


@query("e04_line_counts", "SELECT coalesce(role, 'unknown') AS speaker, count(*) AS lines FROM conversations GROUP BY 1")
def e04(t):
    return t.conversations.groupBy(F.coalesce("role", F.lit("unknown")).alias("speaker")).agg(F.count("*").alias("lines"))


ARMS = "SELECT o_orderkey, o_orderpriority, o_orderstatus = 'F' AS a, o_totalprice > 150000 AS b, o_totalprice, o_orderstatus FROM orders"


def arms(t):
    return t.orders.select("o_orderkey", "o_orderpriority", (F.col("o_orderstatus") == "F").alias("a"), (F.col("o_totalprice") > 150000).alias("b"), "o_totalprice", "o_orderstatus", "o_custkey")


@query("e05_group_accuracy", "SELECT o_orderpriority AS book, o_orderstatus AS arm, count(*) AS n, count(*) FILTER (o_totalprice > 150000) AS correct, round(100.0 * count(*) FILTER (o_totalprice > 150000) / count(*), 6) AS accuracy_pct FROM orders GROUP BY ALL")
def e05(t):
    right = F.count_if(F.col("o_totalprice") > 150000)
    return t.orders.groupBy(F.col("o_orderpriority").alias("book"), F.col("o_orderstatus").alias("arm")).agg(F.count("*").alias("n"), right.alias("correct"), r6(100.0 * right / F.count("*")).alias("accuracy_pct"))


@query("e06_conditional_accuracy", f"WITH x AS ({ARMS}) SELECT o_orderpriority, count(*) AS n, round(avg(b::INT), 6) AS accuracy, count(*) FILTER (a) AS available, round(avg(b::INT) FILTER (a), 6) AS accuracy_given_available FROM x GROUP BY 1")
def e06(t):
    b = F.col("b").cast("int")
    return arms(t).groupBy("o_orderpriority").agg(F.count("*").alias("n"), r6(F.avg(b)).alias("accuracy"), F.count_if("a").alias("available"), r6(F.avg(F.when(F.col("a"), b))).alias("accuracy_given_available"))


@query("e07_recall_histogram", f"WITH b AS (SELECT unnest(['<0.30', '0.30-0.60', '0.60-0.75', '0.75-0.90', '>=0.90']) AS band), c AS (SELECT {BAND_SQL.format(x='l_discount * 8')} AS band, count(*) AS n FROM lineitem GROUP BY 1) SELECT band, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (band)")
def e07(t):
    counts = t.lineitem.groupBy(A.band(F.col("l_discount") * 8).alias("band")).agg(F.count("*").alias("n"))
    return A.zero_filled(counts, [x for x, _ in A.BANDS], "band", "n")


@query("e08_recovery_by_band", f"WITH x AS (SELECT user_id, event_type, value, {BAND_SQL.format(x='value / 100')} AS band, coalesce(bool_or(event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) AS later FROM events) SELECT band, count(*) AS n, count(*) FILTER (later) AS recovered FROM x WHERE event_type <> 'purchase' GROUP BY 1")
def e08(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(1, Window.unboundedFollowing)
    later = F.coalesce(F.max(F.col("event_type") == "purchase").over(w), F.lit(False))
    rows = t.events.withColumn("later", later).filter("event_type <> 'purchase'")
    return rows.groupBy(A.band(F.col("value") / 100).alias("band")).agg(F.count("*").alias("n"), F.count_if("later").alias("recovered"))


@query("e09_attempt_distribution", "SELECT attempts, count(*) AS users, sum(views)::BIGINT AS views FROM (SELECT user_id, count(*) AS attempts, count(*) FILTER (event_type = 'view') AS views FROM events GROUP BY 1) GROUP BY 1")
def e09(t):
    each = t.events.groupBy("user_id").agg(F.count("*").alias("attempts"), F.count_if(F.col("event_type") == "view").alias("views"))
    return each.groupBy("attempts").agg(F.count("*").alias("users"), F.sum("views").alias("views"))


@query("e10_latency_percentiles", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, round(count(*) FILTER (value > 50) / count(*), 6) AS pass_rate FROM events GROUP BY 1")
def e10(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"), r6(F.count_if(F.col("value") > 50) / F.count("*")).alias("pass_rate"))


@query("e11_percentile_linear", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY 1")
def e11(t):
    found = A.percentiles(t.lineitem, ["l_returnflag"], "l_extendedprice", [0.1, 0.5, 0.9])
    return found.withColumns({c: F.round(c, 4) for c in ("p10", "p50", "p90")})


@query("e12_percentile_half_even", "WITH s AS (SELECT l_linestatus, list_sort(list(l_quantity)) AS x FROM lineitem GROUP BY 1) SELECT l_linestatus, x[round_even(0.9 * (len(x) - 1), 0)::BIGINT + 1] AS p90 FROM s")
def e12(t):
    # the value at a rank: distinct values are counted first, so no group is collected
    counts = t.lineitem.groupBy("l_linestatus", "l_quantity").agg(F.count("*").alias("n"))
    up = F.sum("n").over(Window.partitionBy("l_linestatus").orderBy("l_quantity"))
    total = F.sum("n").over(Window.partitionBy("l_linestatus"))
    at = F.bround(F.lit(0.9) * (total - 1), 0)
    return counts.select("l_linestatus", "l_quantity", up.alias("up"), at.alias("at")).filter("up > at").groupBy("l_linestatus").agg(F.min("l_quantity").alias("p90"))


@query("e13_group_profile", "SELECT strftime(l_shipdate, '%Y-%m') AS month, count(l_extendedprice) AS n, round(median(l_extendedprice), 4) AS median, round(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25), 4) AS iqr, round(max(l_extendedprice) - min(l_extendedprice), 4) AS spread, round(count(l_extendedprice) / count(*), 6) AS coverage FROM lineitem GROUP BY 1")
def e13(t):
    x = "l_extendedprice"
    return t.lineitem.groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.count(x).alias("n"), F.round(F.median(x), 4).alias("median"), F.round(F.percentile(x, F.lit(0.75)) - F.percentile(x, F.lit(0.25)), 4).alias("iqr"), F.round(F.max(x) - F.min(x), 4).alias("spread"), r6(F.count(x) / F.count("*")).alias("coverage"))


@query("e14_baseline_flags", "WITH m AS (SELECT l_suppkey, median(l_quantity) AS base FROM lineitem GROUP BY 1) SELECT l_suppkey, count(*) AS n, count(*) FILTER (abs(log2(l_quantity / base)) BETWEEN 0.8 AND 1.2) AS octave FROM lineitem JOIN m USING (l_suppkey) GROUP BY 1")
def e14(t):
    base = t.lineitem.groupBy("l_suppkey").agg(F.median("l_quantity").alias("base"))
    off = F.abs(F.log2(F.col("l_quantity") / F.col("base"))).between(0.8, 1.2)
    return t.lineitem.join(base, "l_suppkey").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(off).alias("octave"))


@query("e15_ab_group_means", "SELECT o_orderpriority, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS a_mean, round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 4) AS b_mean, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS failed, CASE WHEN avg(o_totalprice) FILTER (o_orderstatus = 'F') > avg(o_totalprice) FILTER (o_orderstatus = 'O') THEN 'a' WHEN avg(o_totalprice) FILTER (o_orderstatus = 'F') < avg(o_totalprice) FILTER (o_orderstatus = 'O') THEN 'b' ELSE 'tie' END AS winner FROM orders GROUP BY 1")
def e15(t):
    mean = lambda s: F.avg(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    x = t.orders.groupBy("o_orderpriority").agg(mean("F").alias("a"), mean("O").alias("b"), F.count_if(~F.col("o_orderstatus").isin("F", "O")).alias("failed"))
    return x.select("o_orderpriority", F.round("a", 4).alias("a_mean"), F.round("b", 4).alias("b_mean"), "failed", F.expr("CASE WHEN a > b THEN 'a' WHEN a < b THEN 'b' ELSE 'tie' END").alias("winner"))


DISCORDANT = "WITH x AS (SELECT o_custkey % 500 AS grp, o_orderstatus = 'F' AS a, o_totalprice > 150000 AS b FROM orders), d AS (SELECT grp, count(*) AS n, count(*) FILTER (NOT a AND b) AS fixed, count(*) FILTER (a AND NOT b) AS broke FROM x GROUP BY 1)"
P_SQL = "CASE WHEN fixed + broke = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(fixed, broke) + 1), lambda i: exp(lgamma(fixed + broke + 1) - lgamma(i + 1) - lgamma(fixed + broke - i + 1) - (fixed + broke) * ln(2.0))))) END"


@query("e16_exact_mcnemar", f"{DISCORDANT} SELECT grp, n, fixed, broke, round({P_SQL} + 1e-9, 6) AS p FROM d")
def e16(t):
    # p is a multiple of a power of two, often half of the last decimal: both sides are rounded 1e-9 higher
    x = arms(t).withColumn("grp", F.col("o_custkey") % 500)
    return A.paired_counts(x, ["grp"], "a", "b").withColumn("p", r6(A.binomial_tail(F.col("fixed"), F.col("broke")) + 1e-9))


@query("e17_sign_test", f"WITH d AS (SELECT l_suppkey, count(*) FILTER (l_discount > l_tax) AS fixed, count(*) FILTER (l_discount < l_tax) AS broke FROM lineitem WHERE l_orderkey % 10 = 0 GROUP BY 1) SELECT l_suppkey, fixed AS plus, broke AS minus, round({P_SQL}, 6) AS p FROM d".replace("WHERE l_orderkey % 10 = 0 ", ""))
def e17(t):
    x = t.lineitem.groupBy("l_suppkey").agg(F.count_if(F.col("l_discount") > F.col("l_tax")).alias("plus"), F.count_if(F.col("l_discount") < F.col("l_tax")).alias("minus"))
    return x.withColumn("p", r6(A.binomial_tail(F.col("plus"), F.col("minus"))))


@query("e19_pearson", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1")
def e19(t):
    return t.lineitem.groupBy("l_returnflag").agg(r6(F.corr("l_quantity", "l_extendedprice")).alias("r"))


@query("e20_spearman", "WITH r AS (SELECT l_suppkey, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2 AS x, rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_suppkey, l_extendedprice) - 1) / 2 AS y FROM lineitem) SELECT l_suppkey, round(corr(x, y), 6) AS rho FROM r GROUP BY 1")
def e20(t):
    l = A.dealt(t.lineitem.select("l_suppkey", "l_quantity", "l_extendedprice"), "l_suppkey")  # noqa: E741
    x = A.average_rank(A.average_rank(l, ["l_suppkey"], "l_quantity", "x"), ["l_suppkey"], "l_extendedprice", "y")
    return x.groupBy("l_suppkey").agg(r6(F.corr("x", "y")).alias("rho"))


@query("e21_quartile_means", "WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) - 1 AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events), q AS (SELECT *, rn // (n // 4) AS quartile FROM r WHERE n >= 8) SELECT user_id, quartile::INT AS quartile, round(avg(value), 6) AS mean, count(*) AS n FROM q WHERE quartile < 4 GROUP BY 1, 2")
def e21(t):
    return A.quartile_means(t.events, ["user_id"], "value", "value", "event_id").withColumn("mean", r6(F.col("mean")))


@query("e22_f_ratio", "WITH g AS (SELECT l_suppkey, count(*) AS n, avg(l_quantity) AS m, var_pop(l_quantity) * count(*) AS ss FROM lineitem GROUP BY 1 HAVING count(*) >= 2), a AS (SELECT count(*) AS k, sum(n) AS n, sum(n * m) / sum(n) AS grand, sum(ss) AS within, sum(n * m * m) AS squares FROM g) SELECT round((squares - n * grand * grand) / (k - 1) / (within / (n - k)), 4) AS f, k AS n_groups FROM a")
def e22(t):
    return A.f_ratio(t.lineitem, "l_suppkey", "l_quantity").withColumn("f", F.round("f", 4))


@query("e25_adjusted_rand", "WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY ALL), i AS (SELECT sum(n * (n - 1) / 2) AS both_, sum(n) AS n FROM c), x AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT sum(n) AS n FROM c GROUP BY a)), y AS (SELECT sum(n * (n - 1) / 2) AS y FROM (SELECT sum(n) AS n FROM c GROUP BY b)) SELECT round((both_ - x * y / (n * (n - 1) / 2)) / ((x + y) / 2 - x * y / (n * (n - 1) / 2)), 6) AS ari FROM i, x, y")
def e25(t):
    return A.adjusted_rand(t.lineitem, "l_returnflag", "l_linestatus").withColumn("ari", r6(F.col("ari")))


@query("e26_risk_coverage", "WITH b AS (SELECT o_orderpriority, floor(o_totalprice / 10000) AS confidence, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS r FROM orders GROUP BY ALL) SELECT o_orderpriority, confidence::BIGINT AS confidence, (sum(n) OVER w)::BIGINT AS answered, round(sum(n) OVER w / sum(n) OVER (PARTITION BY o_orderpriority), 6) AS coverage, round(sum(r) OVER w / sum(n) OVER w, 6) AS accuracy FROM b WINDOW w AS (PARTITION BY o_orderpriority ORDER BY confidence DESC)")
def e26(t):
    x = t.orders.select("o_orderpriority", F.floor(F.col("o_totalprice") / 10000).alias("confidence"), (F.col("o_orderstatus") == "F").alias("ok"))
    return A.risk_coverage(x, "confidence", "ok", ["o_orderpriority"]).withColumns({c: r6(F.col(c)) for c in ("coverage", "accuracy")})


@query("e27_trivial_baselines", "WITH x AS (SELECT conv_id, turn, role, lag(role) OVER w AS previous, lag(role, 2) OVER w AS alternate FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), m AS (SELECT role FROM conversations GROUP BY 1 ORDER BY count(*) DESC, role LIMIT 1) SELECT count(*) AS n, count(*) FILTER (role = (SELECT role FROM m)) AS majority, count(*) FILTER (role = previous) AS previous, count(*) FILTER (role = alternate) AS alternate FROM x")
def e27(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    top = t.conversations.groupBy("role").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "role").limit(1).select(F.col("role").alias("top"))
    x = t.conversations.withColumn("p", F.lag("role").over(w)).withColumn("q", F.lag("role", 2).over(w)).join(F.broadcast(top))  # one row
    return x.agg(F.count("*").alias("n"), *[F.count_if(F.col("role") == F.col(c)).alias(n) for c, n in (("top", "majority"), ("p", "previous"), ("q", "alternate"))])


@query("e28_overflow_share", "WITH c AS (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, role) AS rn FROM c) SELECT conv_id, round(coalesce(sum(n) FILTER (rn > 2), 0) / sum(n), 6) AS overflow FROM r GROUP BY 1")
def e28(t):
    c = t.conversations.groupBy("conv_id", "role").agg(F.count("*").alias("n"))
    r = c.withColumn("rn", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("n"), "role")))
    return r.groupBy("conv_id").agg(r6(F.coalesce(F.sum(F.when(F.col("rn") > 2, F.col("n"))), F.lit(0)) / F.sum("n")).alias("overflow"))


@query("e29_speaker_usage", "WITH r AS (SELECT role, conv_id, turn, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS rn FROM conversations), n AS (SELECT role, count(*) AS lines FROM conversations GROUP BY 1) SELECT r.role, any_value(lines) AS lines, string_agg(conv_id || ':' || turn, ',' ORDER BY rn) AS first_places FROM r JOIN n USING (role) WHERE rn <= 5 GROUP BY 1")
def e29(t):
    places = F.transform(F.slice(F.sort_array(F.collect_list(F.struct("conv_id", "turn"))), 1, 5), lambda x: F.concat_ws(":", x["conv_id"], x["turn"]))
    r = t.conversations.withColumn("rn", F.row_number().over(Window.partitionBy("role").orderBy("conv_id", "turn"))).filter("rn <= 5")
    n = t.conversations.groupBy("role").agg(F.count("*").alias("lines"))
    return r.groupBy("role").agg(F.array_join(places, ",").alias("first_places")).join(n, "role").select("role", "lines", "first_places")


@query("e30_adapter_usage", "SELECT o_orderpriority AS adapter, count(DISTINCT o_custkey) AS members, count(*) AS lines, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS names FROM orders GROUP BY 1")
def e30(t):
    return t.orders.groupBy(F.col("o_orderpriority").alias("adapter")).agg(F.countDistinct("o_custkey").alias("members"), F.count("*").alias("lines"), F.array_join(F.sort_array(F.collect_set("o_orderstatus")), ",").alias("names"))


@query("e31_text_loss_ratio", "WITH x AS (SELECT doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) AS n, len(regexp_extract_all(substring(text, 1, (length(text) * 9) // 10), '[^ \\t\\n\\r]+')) AS m FROM documents) SELECT doc_id, round(m / n, 6) AS ratio, m / n BETWEEN 0.95 AND 1.05 AS ok FROM x WHERE n > 0")
def e31(t):
    words = lambda c: F.regexp_count(c, F.lit(r"[^ \t\n\r]+"))
    x = t.documents.select("doc_id", words(F.col("text")).alias("n"), words(F.expr("substring(text, 1, (length(text) * 9) div 10)")).alias("m")).filter("n > 0")
    return x.select("doc_id", r6(F.col("m") / F.col("n")).alias("ratio"), (F.col("m") / F.col("n")).between(0.95, 1.05).alias("ok"))


@query("e34_judge_agreement", "SELECT CASE WHEN quality = toxic THEN 'agree' WHEN quality = 1 THEN 'first_only' ELSE 'second_only' END AS kind, count(*) AS n FROM labels GROUP BY 1")
def e34(t):
    return t.labels.groupBy(F.expr("CASE WHEN quality = toxic THEN 'agree' WHEN quality = 1 THEN 'first_only' ELSE 'second_only' END").alias("kind")).agg(F.count("*").alias("n"))


@query("e36_rule_subsets", "WITH x AS (SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 1 WHEN o_orderpriority LIKE '2%' THEN 2 WHEN o_orderpriority LIKE '3%' THEN 3 ELSE 4 END AS rule, o_orderstatus = 'F' AS a, o_totalprice > 150000 AS b FROM orders), k AS (SELECT unnest([1, 2, 3, 4]) AS k) SELECT k, count(*) FILTER (rule <= k AND NOT a AND b) AS fixed, count(*) FILTER (rule <= k AND a AND NOT b) AS broke FROM x, k GROUP BY 1")
def e36(t):
    rule = F.expr("CASE WHEN o_orderpriority LIKE '1%' THEN 1 WHEN o_orderpriority LIKE '2%' THEN 2 WHEN o_orderpriority LIKE '3%' THEN 3 ELSE 4 END")
    each = A.paired_counts(arms(t).withColumn("k", rule), ["k"], "a", "b")
    w = Window.orderBy("k")  # one row a rule
    return each.select("k", F.sum("fixed").over(w).alias("fixed"), F.sum("broke").over(w).alias("broke"))


@query("e37_throughput", "WITH x AS (SELECT user_id, sum(value) AS total, epoch(max(ts)) - epoch(min(ts)) AS wall, list_sort(list(value)) AS v FROM events GROUP BY 1) SELECT user_id, round(total / nullif(wall, 0) * 3600, 6) AS per_hour, v[len(v) // 2 + 1] AS upper_median FROM x")
def e37(t):
    micros = F.expr("(unix_micros(cast(max(ts) as timestamp)) - unix_micros(cast(min(ts) as timestamp))) / 1e6")
    w = Window.partitionBy("user_id")
    upper = t.events.withColumn("rn", F.row_number().over(w.orderBy("value", "event_id"))).withColumn("n", F.count("*").over(w)).filter(F.col("rn") == F.expr("n div 2 + 1")).select("user_id", F.col("value").alias("upper_median"))
    rate = t.events.groupBy("user_id").agg(r6(F.sum("value") / F.nullif(micros, F.lit(0.0)) * 3600).alias("per_hour"))
    return rate.join(upper, "user_id")


@query("e38_conditional_rates", f"WITH x AS ({ARMS}) SELECT o_orderpriority, round(avg(a::INT), 6) AS recall, round(avg(b::INT) FILTER (a), 6) AS selection, round(avg((a AND b)::INT), 6) AS overall FROM x GROUP BY 1")
def e38(t):
    a, b = F.col("a").cast("int"), F.col("b").cast("int")
    return arms(t).groupBy("o_orderpriority").agg(r6(F.avg(a)).alias("recall"), r6(F.avg(F.when(F.col("a"), b))).alias("selection"), r6(F.avg(a * b)).alias("overall"))


@query("e39_duplicate_groups", "SELECT sha256(text) AS sha, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def e39(t):
    g = t.documents.groupBy(F.sha2("text", 256).alias("sha")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    return g.filter("n > 1")


@query("e40_nested_rollup", "SELECT event_type, (ts::DATE)::VARCHAR AS day, count(*) AS n, count(*) FILTER (value > 50) AS large FROM events GROUP BY ROLLUP (event_type, day)")
def e40(t):
    return t.events.withColumn("day", F.to_date("ts").cast("string")).rollup("event_type", "day").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("large"))


@query("e41_all_arms_accuracy", "WITH u AS (SELECT user_id FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1 HAVING count(DISTINCT event_type) = 3) SELECT event_type AS arm, count(*) AS n, round(avg((value > 50)::INT), 6) AS accuracy FROM events SEMI JOIN u USING (user_id) WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1 HAVING count(*) >= 25")
def e41(t):
    x = t.events.filter(F.col("event_type").isin("view", "click", "purchase"))
    every = x.groupBy("user_id").agg(F.countDistinct("event_type").alias("k")).filter("k = 3")
    g = x.join(every, "user_id", "left_semi").groupBy(F.col("event_type").alias("arm")).agg(F.count("*").alias("n"), r6(F.avg((F.col("value") > 50).cast("int"))).alias("accuracy"))
    return g.filter("n >= 25")


@query("e42_rates_per_1000", "WITH x AS (SELECT source, len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) AS w, len(regexp_extract_all(text, '[!?]')) AS m FROM documents) SELECT source, sum(w)::BIGINT AS words, round(sum(m) / nullif(sum(w), 0) * 1000, 6) AS per_1000 FROM x GROUP BY 1")
def e42(t):
    x = t.documents.select("source", F.regexp_count("text", F.lit(r"[^ \t\n\r]+")).alias("w"), F.regexp_count("text", F.lit("[!?]")).alias("m"))
    return x.groupBy("source").agg(F.sum("w").alias("words"), r6(F.sum("m") / F.nullif(F.sum("w"), F.lit(0)) * 1000).alias("per_1000"))
