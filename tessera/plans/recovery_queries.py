"""Chunks in sources, fuzzy names, order-dependent picks, and objects out of damaged answers."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import functions as F

from ..functions.text import ended_by_stops
from ..operators import alignment as A
from ..operators import colophons as C
from ..operators import greedy as G
from ..operators import names as N
from ..operators import passages as P
from ..operators import resampling as R
from ..operators.similarity import cut
from ..sources import loose_json as J
from .registry import query


@query("g20_best_match")
def g20(t):
    return A.best_matches(t.benchmark, t.documents, "item_id", "doc_id").withColumn("score", F.round("score", 6))


@query("g21_anchors")
def g21(t):
    return A.anchors(A.best_matches(t.benchmark, t.documents, "item_id", "doc_id"), "item_id", "doc_id").withColumn("score", F.round("score", 6))


@query("g22_alignment_quality")
def g22(t):
    matches = cut(A.best_matches(t.benchmark, t.documents, "item_id", "doc_id", limit=Fraction(45, 100)))  # read twice
    return A.quality(matches, matches.select("item_id", "doc_id"), "item_id", "doc_id").withColumn("mean_score", F.round("mean_score", 6))


def title_words(rows, name, least=1):
    """Capitalised words of texts that occur ``least`` times or more, in lower case."""
    words = rows.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{2,}"), F.lit(0))).alias("w")).groupBy(F.lower("w").alias(name)).agg(F.count("*").alias("n"))
    return words.filter(F.col("n") >= least).select(name)


TITLES = "SELECT lower(w) AS {name} FROM (SELECT unnest(regexp_extract_all(text, '[A-Z][a-z]{{2,}}')) AS w FROM {table}) GROUP BY 1 HAVING count(*) >= {least}"
RATIO = "1 - levenshtein({a}, {b}) / greatest(length({a}), length({b}))"


@query("g13_best_names", f"WITH x AS ({TITLES.format(name='name', table='benchmark', least=2)}), y AS ({TITLES.format(name='candidate', table='conversations', least=4)}), p AS (SELECT name, candidate, round(CASE WHEN name = candidate THEN 1.0 ELSE {RATIO.format(a='name', b='candidate')} END, 9) AS score FROM x, y) SELECT name, arg_min(candidate, struct_pack(s := -score, c := candidate)) AS candidate, round(max(score) + 1e-9, 6) AS score FROM p WHERE score >= 0.6 GROUP BY 1")
def g13(t):
    found = N.best_names(title_words(t.benchmark, "name", 2), title_words(t.conversations, "candidate", 4).withColumn("place", F.col("candidate")), "name", "candidate", "place")
    return found.withColumn("score", F.round(F.col("score") + 1e-9, 6))


@query("g16_uncertain_variants", f"WITH x AS ({TITLES.format(name='name', table='documents', least=3)}) SELECT a.name, b.name AS canonical, round({RATIO.format(a='a.name', b='b.name')} + 1e-9, 4) AS similarity FROM x a, x b WHERE a.name <> b.name AND {RATIO.format(a='a.name', b='b.name')} >= 0.9 - 1e-9")
def g16(t):
    names = title_words(t.documents, "name", 3)
    return N.uncertain_variants(names, names.withColumnRenamed("name", "canonical"), "name", "canonical").withColumn("similarity", F.round(F.col("similarity") + 1e-9, 4))


@query("g17_roster_repair", f"WITH x AS ({TITLES.format(name='answer', table='conversations', least=2)}), y AS ({TITLES.format(name='member', table='documents', least=5)}), n AS (SELECT answer, arg_min(member, struct_pack(s := -round({RATIO.format(a='answer', b='member')}, 9), m := member)) AS m FROM x, y WHERE answer NOT IN (SELECT member FROM y) AND {RATIO.format(a='answer', b='member')} >= 0.8 - 1e-9 GROUP BY 1) SELECT x.answer, coalesce(n.m, x.answer) AS repaired FROM x LEFT JOIN n USING (answer)")
def g17(t):
    return N.repaired_to_roster(title_words(t.conversations, "answer", 2), title_words(t.documents, "member", 5), "answer", "member")


@query("h02_accepted_texts")
def h02(t):
    # documents in order of their ids: one is accepted unless it is like an accepted one
    d = t.documents.filter("text IS NOT NULL").select("doc_id", "text")
    pairs = A.like_texts(d, "doc_id", "text")
    return d.select("doc_id").join(G.first_independent(pairs.select(F.col("b").alias("late"), F.col("a").alias("early"))), F.col("doc_id") == F.col("late"), "left_anti")


@query("h11_colours")
def h11(t):
    # customers of orders of one day and priority are neighbours; the busiest come first
    o = t.orders.select("o_custkey", F.to_date("o_orderdate").alias("day"), "o_orderpriority").distinct()
    use = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return G.clique_colours(o, "o_custkey", ["day", "o_orderpriority"], use, [-F.col("n")])


ELEMENT = "'{{\"turn\": ' || turn || ', \"text\": \"' || coalesce(regexp_replace(text, '[^A-Za-z ]', ''{g}), '') || CASE WHEN conv_id % 6 = 5 THEN {feed} || '\",}}' ELSE '\"}}' END"


def damaged(t):
    """Conversations as answers in JSON, each sixth damaged in its own way."""
    el = t.conversations.filter("turn IS NOT NULL").select("conv_id", "turn", F.expr(ELEMENT.format(g="", feed="chr(10)")).alias("e"))
    by = el.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "e"))).alias("x")).select("conv_id", F.col("x.e").alias("e"))
    joined = lambda sep: F.array_join("e", sep)
    kind = F.pmod("conv_id", F.lit(6))
    text = (
        F.when(kind == 1, F.concat(F.lit('<think>or [{"turn": 9}]</think>Sure, "here:\n```json\n['), joined(", "), F.lit("]\n```")))
        .when(kind == 2, F.concat(F.lit("Use {this}: ["), joined(" "), F.lit("] as [asked].")))
        .when(kind == 3, F.expr("concat('[', substring(array_join(e, ', '), 1, length(array_join(e, ', ')) - 4))"))
        .when(kind == 4, F.concat(F.lit("["), F.get("e", F.lit(0)), F.lit("]\n["), F.array_join(F.slice("e", 2, F.greatest(F.size("e") - 1, F.lit(0))), ","), F.lit("]")))
        .otherwise(F.concat(F.lit("["), joined(","), F.lit("]")))
    )
    return by.select("conv_id", text.alias("answer"))


ITEMS = "WITH c AS (SELECT conv_id, turn, coalesce(regexp_replace(text, '[^A-Za-z ]', '', 'g'), '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n, conv_id % 6 AS kind FROM conversations WHERE turn IS NOT NULL), k AS (SELECT conv_id, CASE WHEN kind = 4 AND i > 1 THEN 2 ELSE 1 END AS \"array\", CASE WHEN kind = 4 AND i > 1 THEN i - 2 ELSE i - 1 END AS item, CASE kind WHEN 3 THEN 'salvaged' WHEN 5 THEN 'mended' ELSE 'whole' END AS state, turn, text FROM c WHERE NOT (kind = 3 AND i = n))"


@query("a17_objects", f"{ITEMS} SELECT conv_id, \"array\", CAST(item AS INT) AS item, state, CAST(turn AS VARCHAR) AS turn, md5(text) AS digest FROM k")
def a17(t):
    found = J.objects(damaged(t), "answer", ["conv_id"])
    text = F.regexp_replace(F.get_json_object("value", "$.text"), "\n$", "")
    return found.select("conv_id", "array", "item", "state", F.get_json_object("value", "$.turn").alias("turn"), F.md5(text.cast("binary")).alias("digest"))


@query("a17_answers", f"{ITEMS}, w AS (SELECT *, regexp_extract_all(lower(text), '[a-z]+') AS words FROM k), e AS (SELECT conv_id, max(\"array\") AS n_arrays, count(*) AS n_objects, any_value(state) AS state, arg_max(words, item) FILTER (\"array\" = 1) AS first, arg_min(words, item) FILTER (\"array\" = 2) AS last FROM w GROUP BY 1) SELECT conv_id, CAST(n_arrays AS BIGINT) AS n_arrays, n_objects, CASE WHEN n_arrays > 1 AND len(list_filter(range(3, least(len(first), len(last)) + 1), lambda k: first[len(first) - k + 1:] = last[1:k])) > 0 THEN 'overlap' WHEN state = 'salvaged' THEN 'salvaged' WHEN n_arrays > 1 THEN 'joined' ELSE 'one' END AS state FROM e")
def a17_answers(t):
    return J.one_answer(J.objects(damaged(t), "answer", ["conv_id"]), ["conv_id"])


@query("f19_quote_aware_chunks")
def f19(t):
    parts = P.paragraphs(t.documents, "doc_id", "text", heading="(?!)", sep="\n")
    return P.structural_chunks(parts, "doc_id", 400).select("doc_id", "chunk", "first", F.length("text").cast("long").alias("length"), "depth", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("n21_structural_chunks")
def n21(t):
    # every tenth word "the" that begins a line makes a heading, so that chapters differ in length
    parts = P.paragraphs(t.documents, "doc_id", "text", heading="^[A-C].{0,40}$", sep="\n")
    return P.structural_chunks(parts, "doc_id", 600).select("doc_id", "chunk", "chapter", "first", F.length("text").cast("long").alias("length"), F.md5(F.col("text").cast("binary")).alias("digest"))


def entries(t):
    """Sentences of documents as entries: every fifth changes places with the one before it, every seventh is reworded."""
    found = t.documents.select("doc_id", F.posexplode(ended_by_stops(F.replace("text", F.lit("\n"), F.lit(" ")))).alias("i", "text"))
    at = F.when(F.col("i") % 5 == 3, F.col("i") + 1).when((F.col("i") % 5 == 4), F.col("i") - 1).otherwise(F.col("i"))
    return found.select("doc_id", at.alias("pos"), F.when(F.col("i") % 7 == 6, F.concat(F.lit("reworded "), "text")).otherwise(F.col("text")).alias("text"))


def in_plain(x):
    return f"""trim(regexp_replace(regexp_replace(coalesce({x}, ''), '[「『“」』”"]', '', 'g'), '\\s+', ' ', 'g'))"""


F27_SQL = f"""
WITH RECURSIVE s AS (SELECT doc_id, {in_plain('text')} AS t FROM documents),
x AS (SELECT doc_id, regexp_extract_all(replace(coalesce(text, ''), chr(10), ' '), '[^.]+\\.') AS l FROM documents),
i AS (SELECT doc_id, unnest(l) AS text, unnest(range(len(l))) AS i FROM x),
e AS (SELECT doc_id, CASE i % 5 WHEN 3 THEN i + 1 WHEN 4 THEN i - 1 ELSE i END AS pos, {in_plain("CASE WHEN i % 7 = 6 THEN 'reworded ' || text ELSE text END")} AS n FROM i),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM e),
r AS (SELECT doc_id, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS cursor, CAST(0 AS BIGINT) AS forward, CAST(0 AS BIGINT) AS anywhere, '' AS n FROM s
  UNION ALL SELECT q.doc_id, q.k, q.pos, CASE WHEN q.forward > 0 THEN q.cursor + q.forward - 1 + length(q.n) WHEN q.anywhere > 0 THEN q.anywhere - 1 + length(q.n) ELSE q.cursor END, CASE WHEN q.forward > 0 THEN q.cursor + q.forward ELSE 0 END, CASE WHEN q.forward > 0 THEN 0 ELSE q.anywhere END, q.n
  FROM (SELECT o.doc_id, o.k, o.pos, r.cursor, CAST(instr(substr(s.t, r.cursor + 1), o.n) AS BIGINT) AS forward, CAST(instr(s.t, o.n) AS BIGINT) AS anywhere, o.n FROM r JOIN o ON o.doc_id = r.doc_id AND o.k = r.k + 1 JOIN s ON s.doc_id = o.doc_id) q)
SELECT doc_id, CAST(pos AS INT) AS pos, CASE WHEN forward + anywhere > 0 THEN forward + anywhere - 1 END AS start, CASE WHEN forward + anywhere > 0 THEN forward + anywhere - 1 + length(n) END AS end, CASE WHEN forward > 0 THEN 'forward' WHEN anywhere > 0 THEN 'anywhere' ELSE 'not_found' END AS how FROM r WHERE k > 0
"""


@query("f27_located_forward", F27_SQL)
def f27(t):
    return P.located_forward(entries(t), t.documents, "doc_id", "pos", "text")


@query("c11_colophons")
def c11(t):
    stripped = C.without_colophon(t.documents.select("doc_id", "text"), "text", "\n")
    return stripped.select("doc_id", "front", "back", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("e23_median_ratio")
def e23(t):
    return R.median_ratio(t.lineitem, ["l_linenumber"], "l_returnflag", "l_extendedprice", "A", "R", draws=2000).withColumns({c: F.round(c, 6) for c in ("ratio", "low", "high")})


def heard(t):
    """Turns as they might be heard: every ninth word runs into the next, every eleventh comes apart, every seventh lacks its last letter."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != "")

    def said(x, i):
        half = F.ceil(F.length(x) / 2).cast("int")
        return F.when(i % 11 == 10, F.concat(F.substr(x, F.lit(1), half), F.lit(" "), F.substr(x, half + 1))).when((i % 7 == 6) & (F.length(x) > 4), F.substr(x, F.lit(1), F.length(x) - 1)).otherwise(x)

    joined = F.aggregate(F.transform(words, lambda x, i: F.struct(said(x, i).alias("x"), (i % 9 == 8).alias("run"))), F.lit(""), lambda a, w: F.concat(a, w["x"], F.when(w["run"], "").otherwise(" ")))
    return t.conversations.select("conv_id", "turn", "text", joined.alias("heard"))


@query("g23_boundaries")
def g23(t):
    return A.boundaries(heard(t), "heard", "text").drop("text", "heard")


@query("g24_merged_marks")
def g24(t):
    # a mark stands before every tenth word that is heard
    words = F.filter(F.split("heard", " "), lambda x: x != "")
    marked = F.array_join(F.flatten(F.transform(words, lambda x, i: F.when(i % 10 == 9, F.array(F.lit("[pause]"), x)).otherwise(F.array(x)))), " ")
    out = A.with_marks(heard(t).withColumn("annotated", marked), "annotated", "text", "merged")
    return out.select("conv_id", "turn", F.md5(F.col("merged").cast("binary")).alias("digest"), F.regexp_count("merged", F.lit(r"\[pause\]")).cast("long").alias("marks"))


@query("g26_matched_controls")
def g26(t):
    # each tenth document gets another one of its language that is closest in length, none twice
    d = t.documents.select("doc_id", "lang", "n_chars")
    return G.matched_pairs(d.filter("doc_id % 10 = 0"), d.filter("doc_id % 10 <> 0"), "doc_id", "n_chars", ["lang"])


@query("k05_turns_in_source")
def k05(t):
    # turns located in their conversation's whole text, a cursor carried from turn to turn; streaming.cursors does the same on a stream
    whole = t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return P.located_forward(t.conversations, whole, "conv_id", "turn", "text")
