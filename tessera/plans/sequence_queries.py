"""Queries of section F: windows and sequences; and those of section N that are windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import sequences as S
from .registry import query

CONV_W = "WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"


def turns():
    """The window over a conversation, in order of turns (made on use: it needs a session)."""
    return Window.partitionBy("conv_id").orderBy("turn")


@query("f01_speaker_runs")
def f01(t):
    return S.speaker_runs(t.conversations, ["conv_id"], "turn", "role", "text", 2000)


@query("f02_merge_narrators", f"WITH x AS (SELECT *, CASE WHEN role = lag(role) OVER w THEN 0 ELSE 1 END AS new FROM conversations {CONV_W}), r AS (SELECT *, sum(new) OVER w AS run FROM x {CONV_W}) SELECT conv_id, any_value(role) AS role, min(turn) AS turn, count(*) AS n_lines, sum(length(text))::BIGINT AS chars FROM r GROUP BY conv_id, run")
def f02(t):
    rows = S.run_id(t.conversations, ["conv_id"], "turn", F.col("role") != F.lag("role").over(turns()))
    return rows.groupBy("conv_id", "run").agg(F.first("role").alias("role"), F.min("turn").alias("turn"), F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("chars")).drop("run")


@query("f03_duplicate_lines", "WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents), x AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM l) SELECT doc_id, count(*) AS n FROM x WHERE line = p AND length(line) > 0 GROUP BY 1")
def f03(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    p = F.lag("line").over(Window.partitionBy("doc_id").orderBy("pos"))
    return lines.withColumn("p", p).filter("line = p AND length(line) > 0").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("f05_neighbour_context", f"SELECT conv_id, turn, concat_ws('|', lag(role, 2) OVER w, lag(role) OVER w) AS before, concat_ws('|', lead(role) OVER w, lead(role, 2) OVER w) AS after FROM conversations {CONV_W}")
def f05(t):
    return t.conversations.select("conv_id", "turn", F.array_join(F.collect_list("role").over(turns().rowsBetween(-2, -1)), "|").alias("before"), F.array_join(F.collect_list("role").over(turns().rowsBetween(1, 2)), "|").alias("after"))


@query("f07_nearby_lines", "SELECT DISTINCT b.conv_id, b.turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND abs(a.turn - b.turn) <= 2 WHERE a.role = 'system' AND b.role <> 'system'")
def f07(t):
    near = F.max((F.col("role") == "system").cast("int")).over(Window.partitionBy("conv_id").orderBy("turn").rangeBetween(-2, 2))
    return t.conversations.withColumn("near", near).filter("near = 1 AND role <> 'system'").select("conv_id", "turn")


@query("f08_recent_speakers", f"SELECT conv_id, turn, concat_ws(',', lag(role) OVER w, CASE WHEN lag(role, 2) OVER w <> lag(role) OVER w THEN lag(role, 2) OVER w END) AS recent FROM conversations {CONV_W}")
def f08(t):
    last = F.reverse(F.collect_list("role").over(turns().rowsBetween(-2, -1)))
    return t.conversations.select("conv_id", "turn", F.array_join(F.array_distinct(last), ",").alias("recent"))


@query("f09_continuation_rate", f"WITH x AS (SELECT role = lag(role) OVER w AS same FROM conversations {CONV_W}) SELECT round(avg(same::INT), 6) AS rate FROM x")
def f09(t):
    return t.conversations.withColumn("same", (F.col("role") == F.lag("role").over(turns())).cast("int")).agg(F.round(F.avg("same"), 6).alias("rate"))


@query("f10_turn_neighbours", f"SELECT conv_id, turn, lag(role) OVER w AS previous, lead(role) OVER w AS following FROM conversations {CONV_W}")
def f10(t):
    return t.conversations.select("conv_id", "turn", F.lag("role").over(turns()).alias("previous"), F.lead("role").over(turns()).alias("following"))


@query("f11_alternation_repair")
def f11(t):
    return S.alternating(t.conversations, ["conv_id"], "turn", "role")


@query("f12_timeline", f"WITH x AS (SELECT conv_id, turn, length(text) AS n, CASE WHEN lag(role) OVER w IS NULL THEN 0 WHEN lag(role) OVER w = role THEN 250 ELSE 500 END AS gap FROM conversations {CONV_W}) SELECT conv_id, turn, (sum(gap + n) OVER w - n)::BIGINT AS start FROM x {CONV_W}")
def f12(t):
    gap = F.when(F.lag("role").over(turns()) == F.col("role"), 250).otherwise(500)
    return S.timeline(t.conversations, ["conv_id"], "turn", F.length("text"), gap).select("conv_id", "turn", "start")


CHAPTERS = "l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents)"


@query("f13_chapters", f"WITH {CHAPTERS}, c AS (SELECT *, sum((line LIKE '%:' OR length(line) < 20)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS chapter FROM l) SELECT doc_id, chapter::BIGINT AS chapter, CASE WHEN chapter = 0 THEN 'Introduction' ELSE min_by(line, pos) END AS title, min(pos)::BIGINT AS first_line, max(pos)::BIGINT AS last_line FROM c GROUP BY doc_id, chapter")
def f13(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    heading = F.col("line").endswith(":") | (F.length("line") < 20)
    c = lines.withColumn("chapter", F.sum(heading.cast("int")).over(Window.partitionBy("doc_id").orderBy("pos")))
    title = F.when(F.col("chapter") == 0, "Introduction").otherwise(F.col("title"))
    g = c.groupBy("doc_id", "chapter").agg(F.min_by("line", "pos").alias("title"), F.min("pos").cast("long").alias("first_line"), F.max("pos").cast("long").alias("last_line"))
    return g.withColumn("title", title)


@query("f14_best_cut", "WITH x AS (SELECT user_id, event_id, ts, epoch_us(lead(ts) OVER w) - epoch_us(ts) AS gap, row_number() OVER w AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY gap DESC, rn DESC) AS k FROM x WHERE rn > 0.7 * n AND gap IS NOT NULL) SELECT user_id, event_id AS cut_after, gap FROM r WHERE k = 1")
def f14(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.expr("unix_micros(cast(ts as timestamp))")
    x = t.events.withColumn("at", micros).withColumn("gap", F.lead("at").over(w) - F.col("at")).withColumn("rn", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("user_id")))
    x = x.filter("rn > 0.7 * n AND gap IS NOT NULL")
    return x.groupBy("user_id").agg(F.max_by("event_id", F.struct("gap", "rn")).alias("cut_after"), F.max("gap").alias("gap"))


@query("f15_duration_chunks")
def f15(t):
    return S.tumbling(t.events, ["user_id"], ["ts", "event_id"], F.col("value"), 250.0).groupBy("user_id", "chunk").agg(F.count("*").alias("n"), F.round(F.sum("size"), 4).alias("total"))


SPANS = "s AS (SELECT user_id, event_id, epoch(ts)::BIGINT AS a, epoch(ts)::BIGINT + (value * 600)::BIGINT AS b FROM events)"


def spans(t):
    start = F.expr("unix_seconds(cast(ts as timestamp))")
    return t.events.select("user_id", "event_id", start.alias("a"), (start + F.round(F.col("value") * 600).cast("long")).alias("b"))


@query("f20_interval_union", f"WITH {SPANS.replace('(value * 600)::BIGINT', 'round(value * 600)::BIGINT').replace('epoch(ts)::BIGINT', 'floor(epoch(ts))::BIGINT')}, n AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NOT FALSE THEN 1 ELSE 0 END AS new FROM s), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY a, b) AS i FROM n) SELECT user_id, min(a) AS a, max(b) AS b, count(*) AS n FROM i GROUP BY user_id, i".replace("CASE WHEN a > max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NOT FALSE", "CASE WHEN (a > max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) IS NOT FALSE"))
def f20(t):
    return S.merged_intervals(spans(t), ["user_id"], "a", "b")


@query("f21_quoted_spans", "SELECT doc_id, len(regexp_extract_all(text, '\"[^\"]+\"')) AS n_double, len(regexp_extract_all(text, '«[^»]+»')) AS n_guillemets FROM documents")
def f21(t):
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return t.documents.select("doc_id", n('"[^"]+"').alias("n_double"), n("«[^»]+»").alias("n_guillemets"))


@query("f22_interval_checks", f"WITH {SPANS.replace('(value * 600)::BIGINT', 'round(value * 600)::BIGINT').replace('epoch(ts)::BIGINT', 'floor(epoch(ts))::BIGINT')}, x AS (SELECT *, lag(b) OVER (PARTITION BY user_id ORDER BY a, event_id) AS p FROM s) SELECT event_id, greatest(a, coalesce(p, a)) AS clamped_start, b > a AS positive, coalesce(a >= p, true) AS in_order FROM x")
def f22(t):
    p = F.lag("b").over(Window.partitionBy("user_id").orderBy("a", "event_id"))
    x = spans(t).withColumn("p", p)
    return x.select("event_id", F.greatest("a", F.coalesce("p", "a")).alias("clamped_start"), (F.col("b") > F.col("a")).alias("positive"), F.coalesce(F.col("a") >= F.col("p"), F.lit(True)).alias("in_order"))


@query("f23_fold_pauses", f"WITH x AS (SELECT *, length(text) > 200 AS spoken FROM conversations), i AS (SELECT *, sum(spoken::INT) OVER w AS island FROM x {CONV_W}) SELECT conv_id, island::BIGINT AS island, min(turn) AS turn, max(CASE WHEN spoken THEN 0 ELSE length(text) END)::BIGINT AS pause FROM i GROUP BY conv_id, island")
def f23(t):
    x = t.conversations.withColumn("spoken", F.length("text") > 200)
    i = x.withColumn("island", F.sum(F.col("spoken").cast("int")).over(turns()))
    return i.groupBy("conv_id", "island").agg(F.min("turn").alias("turn"), F.max(F.when(F.col("spoken"), 0).otherwise(F.length("text"))).cast("long").alias("pause"))


@query("f24_unique_batches", "SELECT conv_id, turn, turn // 5 AS win, row_number() OVER (PARTITION BY conv_id, turn // 5, role ORDER BY turn) AS batch FROM conversations")
def f24(t):
    win = F.expr("turn div 5")
    return t.conversations.select("conv_id", "turn", win.alias("win"), F.row_number().over(Window.partitionBy("conv_id", win, "role").orderBy("turn")).cast("long").alias("batch"))


@query("f26_stable_regroup", "WITH x AS (SELECT o_custkey, o_orderkey, o_orderpriority, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS first FROM orders) SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY first, o_orderkey) AS place FROM x")
def f26(t):
    x = t.orders.withColumn("first", F.min("o_orderkey").over(Window.partitionBy("o_custkey", "o_orderpriority")))
    return x.select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("first", "o_orderkey")).cast("long").alias("place"))


@query("f29_neighbour_voters", f"SELECT conv_id, turn, CASE WHEN lag(role) OVER w = lead(role) OVER w AND role <> lag(role) OVER w THEN 1 ELSE 0 END AS island, CASE WHEN regexp_matches(text, '[.!?]$') THEN 0 ELSE 1 END AS unterminated FROM conversations {CONV_W}")
def f29(t):
    p, n = F.lag("role").over(turns()), F.lead("role").over(turns())
    return t.conversations.select("conv_id", "turn", F.when((p == n) & (F.col("role") != p), 1).otherwise(0).alias("island"), F.when(F.col("text").rlike(r"[.!?]\z"), 0).otherwise(1).alias("unterminated"))


@query("f30_sample_windows", "SELECT doc_id, i AS win, ((n_chars - 100) * i // 4)::BIGINT AS start FROM documents, (SELECT unnest(range(5)) AS i) WHERE n_chars >= 100")
def f30(t):
    return t.documents.filter("n_chars >= 100").select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0), F.lit(4)).cast("array<bigint>")).alias("win")).select("doc_id", "win", F.expr("(n_chars - 100) * win div 4").alias("start"))


@query("n07_maximal_runs", f"WITH i AS (SELECT *, sum((role = 'system')::INT) OVER w AS island FROM conversations {CONV_W}) SELECT conv_id, island::BIGINT AS island, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n FROM i WHERE role <> 'system' GROUP BY conv_id, island")
def n07(t):
    i = t.conversations.withColumn("island", F.sum((F.col("role") == "system").cast("int")).over(turns())).filter("role <> 'system'")
    return i.groupBy("conv_id", "island").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("n"))


@query("n08_anchor_distance", f"SELECT conv_id, turn, turn - max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS distance FROM conversations")
def n08(t):
    return S.nearest_marked(t.conversations, ["conv_id"], "turn", F.col("role") == "user").select("conv_id", "turn", F.col("before").alias("distance"))


@query("n09_evidence_distance", "WITH x AS (SELECT conv_id, turn, turn - max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - turn AS after FROM conversations) SELECT conv_id, turn, CASE WHEN least(before, after) <= 3 THEN least(before, after) END AS distance FROM x")
def n09(t):
    x = S.nearest_marked(t.conversations, ["conv_id"], "turn", F.col("role") == "user").withColumn("d", F.least("before", "after"))
    return x.select("conv_id", "turn", F.when(F.col("d") <= 3, F.col("d")).alias("distance"))


@query("n12_overflow_bucket", "WITH c AS (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, role) AS rn FROM c) SELECT conv_id, CASE WHEN rn <= 1 THEN role ELSE 'other' END AS cast_name, sum(n)::BIGINT AS lines FROM r GROUP BY ALL")
def n12(t):
    c = t.conversations.groupBy("conv_id", "role").agg(F.count("*").alias("n"))
    r = c.withColumn("rn", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("n"), "role")))
    return r.groupBy("conv_id", F.when(F.col("rn") <= 1, F.col("role")).otherwise("other").alias("cast_name")).agg(F.sum("n").alias("lines"))


@query("n20_span_envelope", f"WITH {SPANS.replace('(value * 600)::BIGINT', 'round(value * 600)::BIGINT').replace('epoch(ts)::BIGINT', 'floor(epoch(ts))::BIGINT')}, g AS (SELECT *, lead(a) OVER (PARTITION BY user_id ORDER BY a, event_id) - b AS gap FROM s) SELECT user_id, min(a) AS a, max(b) AS b, coalesce(sum(greatest(gap, 0)), 0)::BIGINT AS inner_gap FROM g GROUP BY 1")
def n20(t):
    g = spans(t).withColumn("gap", F.lead("a").over(Window.partitionBy("user_id").orderBy("a", "event_id")) - F.col("b"))
    return g.groupBy("user_id").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.coalesce(F.sum(F.greatest("gap", F.lit(0))), F.lit(0)).alias("inner_gap"))
