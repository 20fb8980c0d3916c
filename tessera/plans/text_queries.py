"""Queries of section C: text functions over whole texts, with SQL wherever both engines' regular expressions can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from .registry import query

W = r"[\p{L}\p{N}_]+"
TOKENS = rf"regexp_extract_all(replace(lower(coalesce(text, '')), 'ß', 'ss'), '{W}')"


def replaced(x: str, rules) -> str:
    """Nested SQL of regular-expression replacements."""
    for pattern, by in rules:
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return x


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def digest(x):
    return F.md5(x.cast("binary"))


@query("c01_tokens", f"WITH t AS (SELECT doc_id, flatten(list_transform({TOKENS}, lambda w: CASE WHEN regexp_matches(w, '[\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}\\p{{Hangul}}\\p{{Thai}}]') THEN regexp_extract_all(w, '[\\p{{L}}\\p{{N}}]') ELSE [w] END)) AS t FROM documents) SELECT doc_id, len(t)::INT AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM t")
def c01(t):
    rows = t.documents.select("doc_id", T.tokens(T.plain("text")).alias("t"))
    return rows.select("doc_id", F.size("t").alias("n_tokens"), digest(F.array_join("t", " ")).alias("digest"))


@query("c02_ngrams", f"WITH t AS (SELECT doc_id, {TOKENS} AS t FROM documents), g AS (SELECT doc_id, list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) AS g FROM t) SELECT doc_id, len(g)::INT AS n_grams, len(list_distinct(g))::INT AS n_distinct FROM g")
def c02(t):
    words = F.regexp_extract_all(T.fold(T.plain("text")), F.lit(W), F.lit(0))
    rows = t.documents.select("doc_id", words.alias("t")).select("doc_id", T.ngrams(F.col("t"), 3).alias("g"))
    return rows.select("doc_id", F.size("g").alias("n_grams"), F.size(F.array_distinct("g")).alias("n_distinct"))


@query("c03_spoken_words")
def c03(t):
    rows = t.documents.select("doc_id", T.spoken_words(T.plain("text")).alias("w"))
    return rows.select("doc_id", F.size("w").alias("n_words"), digest(F.array_join("w", " ")).alias("digest"))


@query("c04_compounds", r"SELECT doc_id, len(list_filter(regexp_split_to_array(regexp_replace(coalesce(text, ''), '[-‐‑‒–—―─━]', ' ', 'g'), '\s+'), lambda w: w <> ''))::INT AS n_parts FROM documents")
def c04(t):
    return t.documents.select("doc_id", F.size(T.compounds(T.plain("text"))).alias("n_parts"))


@query("c05_ocr_glitches")
def c05(t):
    clean = T.without_ocr_glitches(T.plain("text"))
    return t.documents.select("doc_id", (F.length(T.plain("text")) - F.length(clean)).alias("dropped"), digest(clean).alias("digest"))


@query("c06_mojibake", "SELECT doc_id, md5(replace(replace(replace(replace(replace(replace(replace(replace(coalesce(text, ''), 'â€™', '’'), 'â€˜', '‘'), 'â€œ', '“'), 'â€' || chr(157), '”'), 'â€?', '”'), 'â€“', '–'), 'â€”', '—'), 'â€¦', '…')) AS digest FROM documents")
def c06(t):
    return t.documents.select("doc_id", digest(T.without_mojibake(T.plain("text"))).alias("digest"))


@query("c08_phrase_loops")
def c08(t):
    clean = T.without_phrase_loops(T.plain("text"))
    return t.documents.select("doc_id", (clean != T.plain("text")).alias("changed"), F.length(clean).alias("n_chars"))


@query("c13_preprocessing")
def c13(t):
    clean = T.without_phrase_loops(T.without_mojibake(T.without_ocr_glitches(T.extracted(T.plain("text")))))
    return t.documents.select("doc_id", F.length(clean).alias("n_chars"), digest(clean).alias("digest"))


@query("c14_source_health", f"SELECT doc_id, len(text) - len(replace(text, chr(65533), '')) AS lost, {' + '.join(count('text', p) for p, _ in T.CONTRACTIONS)} AS broken FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def c14(t):
    x = T.plain("text")
    return t.documents.select("doc_id", F.regexp_count(x, F.lit("�")).cast("long").alias("lost"), T.broken_contractions(x).cast("long").alias("broken"))


@query("c15_quote_balance", r"""WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\n\s*\n')) AS p FROM documents), c AS (SELECT doc_id, len(p) - len(replace(p, '“', '')) AS o, len(p) - len(replace(p, '”', '')) AS c, len(p) - len(replace(p, '"', '')) AS s FROM p)
SELECT doc_id, count(*) FILTER (o + c + s > 0) AS quoted, count(*) FILTER ((s + abs(o - c)) % 2 <> 0) AS unbalanced FROM c GROUP BY 1""")
def c15(t):
    p = t.documents.select("doc_id", F.explode(F.split(T.plain("text"), r"\n\s*\n")).alias("p"))
    n = lambda mark: F.regexp_count("p", F.lit(mark))
    odd = (n('"') + F.abs(n("“") - n("”"))) % 2 != 0
    return p.groupBy("doc_id").agg(F.count_if(n('["“”]') > 0).alias("quoted"), F.count_if(odd).alias("unbalanced"))


@query("c16_structural_regressions", r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM documents), c AS (SELECT doc_id, l, len(l) - len(replace(l, '“', '')) AS o, len(l) - len(replace(l, '”', '')) AS c FROM l)
SELECT doc_id, count(*) FILTER (o > c AND regexp_matches(l, '—\s*$')) AS open_ended, count(*) FILTER (c > o AND regexp_matches(l, '^\s*—')) AS close_started FROM c GROUP BY 1""")
def c16(t):
    lines = t.documents.select("doc_id", F.explode(F.split(T.plain("text"), "\n")).alias("l"))
    o, c = F.regexp_count("l", F.lit("“")), F.regexp_count("l", F.lit("”"))
    return lines.groupBy("doc_id").agg(F.count_if((o > c) & F.col("l").rlike(r"—\s*$")).alias("open_ended"), F.count_if((c > o) & F.col("l").rlike(r"^\s*—")).alias("close_started"))


IN_SQL = [(p, by.replace("$", "\\")) for p, by in T.CONTRACTIONS]


@query("c17_contractions", "SELECT doc_id, md5(" + replaced("coalesce(text, '')", IN_SQL) + ") AS digest FROM documents")
def c17(t):
    return t.documents.select("doc_id", digest(T.restored_contractions(T.plain("text"))).alias("digest"))


@query("c18_repetition_traps")
def c18(t):
    clean = T.without_traps(T.plain("text"))
    return t.documents.select("doc_id", (F.length(T.plain("text")) - F.length(clean)).alias("dropped"))


@query("c19_marker_contexts", r"""WITH c AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), ' ')) AS w FROM documents), k AS (SELECT substr(w, 1, 1) AS first, right(w, 1) AS last, doc_id FROM c WHERE w LIKE '%-%')
SELECT first, last, count(*) AS n, min(doc_id) AS sample FROM k GROUP BY 1, 2""")
def c19(t):
    w = t.documents.select("doc_id", F.explode(F.split(T.plain("text"), " ")).alias("w")).filter(F.contains("w", F.lit("-")))
    return w.groupBy(F.substring("w", 1, 1).alias("first"), F.right("w", F.lit(1)).alias("last")).agg(F.count("*").alias("n"), F.min("doc_id").alias("sample"))


@query("c20_extracted", "SELECT page_id, md5(regexp_replace(regexp_replace(coalesce(html, ''), '[' || chr(8203) || chr(8204) || chr(8205) || chr(8288) || chr(65279) || chr(173) || ']', '', 'g'), '\n{3,}', '\n\n', 'g')) AS digest FROM pages".replace("\n", "\\n").replace("'\\n\\n'", "chr(10) || chr(10)"))
def c20(t):
    return t.pages.select("page_id", digest(T.extracted(T.plain("html"))).alias("digest"))


@query("c22_speaker_fold", rf"SELECT c_custkey, trim(regexp_replace(regexp_replace(upper(c_name), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g')) AS speaker FROM customer")
def c22(t):
    return t.customer.select("c_custkey", T.speaker(F.col("c_name")).alias("speaker"))


@query("c23_identity_key", r"SELECT c_custkey, regexp_replace(replace(lower(c_name), 'ß', 'ss'), '[^\p{L}\p{N}_]+', '', 'g') AS key FROM customer")
def c23(t):
    return t.customer.select("c_custkey", T.identity_key(F.col("c_name")).alias("key"))


@query("c24_honorific_collisions", r"""WITH n AS (SELECT o_orderpriority AS grp, CASE WHEN o_orderkey % 2 = 0 THEN 'Mr. ' ELSE 'Mrs. ' END || 'Name ' || (o_custkey % 7) AS name FROM orders), f AS (SELECT grp, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(name)), '^(mr|mrs|ms|miss|dr|sir|lady|lord)\.?\s+', ''), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) AS stripped, trim(regexp_replace(regexp_replace(lower(trim(name)), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) AS intact FROM n), k AS (SELECT grp, stripped, count(DISTINCT intact) AS n FROM f WHERE stripped <> '' GROUP BY 1, 2) SELECT grp, max(n) > 1 AS distinguishing, sum(n)::BIGINT AS n_names FROM k GROUP BY 1""")
def c24(t):
    names = t.orders.select(F.col("o_orderpriority").alias("grp"), F.concat(F.when(F.col("o_orderkey") % 2 == 0, "Mr. ").otherwise("Mrs. "), F.lit("Name "), F.col("o_custkey") % 7).alias("name"))
    folded = names.select("grp", T.name_fold(F.col("name"), True).alias("stripped"), T.name_fold(F.col("name"), False).alias("intact")).filter("stripped <> ''")
    return folded.groupBy("grp", "stripped").agg(F.count_distinct("intact").alias("n")).groupBy("grp").agg((F.max("n") > 1).alias("distinguishing"), F.sum("n").alias("n_names"))


@query("c25_phonetic_key", "WITH l AS (SELECT c_custkey, replace(regexp_replace(upper(c_name), '[^A-Z]', '', 'g'), 'L', 'R') AS l FROM customer), b AS (SELECT *, string_split(regexp_replace(l, '[AEIOU]', '', 'g'), '') AS b FROM l) SELECT c_custkey, CASE WHEN l = '' THEN '' ELSE regexp_extract(l, '[AEIOU]') || '|' || array_to_string(list_filter(b, lambda c, i: i = 1 OR c <> b[i - 1]), '') END AS key FROM b")
def c25(t):
    return t.customer.select("c_custkey", T.phonetic_key(F.col("c_name")).alias("key"))


@query("c26_comparison_forms", r"""SELECT doc_id, md5(regexp_replace(lower(x), '[^a-z]', '', 'g')) AS letters, md5(trim(regexp_replace(regexp_replace(lower(x), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'))) AS plain, len(list_filter(string_split(regexp_replace(lower(x), '[^\p{L}\p{N}_]+', ' ', 'g'), ' '), lambda w: w <> ''))::INT AS n_words FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents)""")
def c26(t):
    x = T.plain("text")
    return t.documents.select("doc_id", digest(T.letters_only(x)).alias("letters"), digest(T.unpunctuated(x)).alias("plain"), F.size(T.words_plain(x)).alias("n_words"))


@query("c31_risks", r"""SELECT doc_id, regexp_matches(x, '(?i)(?:https?://|https?//|www\.)\S+') AS url, regexp_matches(x, '(?i)\b(?:isbn|issn|doi|sku|serial|model|account|reference|ref|id)\s*(?:no\.?|number|#|:)\s*[a-z0-9]') AS identifier, len(regexp_extract_all(x, '[•·▪◦■□◆●▲─━―*_~]')) >= 2 OR (len(regexp_extract_all(x, '\|')) >= 2 AND contains(x, chr(10))) AS list_or_table FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents)""")
def c31(t):
    x = T.plain("text")
    table = (F.regexp_count(x, F.lit("[•·▪◦■□◆●▲─━―*_~]")) >= 2) | ((F.regexp_count(x, F.lit(r"\|")) >= 2) & F.contains(x, F.lit("\n")))
    return t.documents.select("doc_id", x.rlike(r"(?i)(?:https?://|https?//|www\.)\S+").alias("url"), x.rlike(r"(?i)\b(?:isbn|issn|doi|sku|serial|model|account|reference|ref|id)\s*(?:no\.?|number|#|:)\s*[a-z0-9]").alias("identifier"), table.alias("list_or_table"))


@query("c34_unicode_audit", r"""SELECT doc_id, array_to_string(list_sort(list_filter([CASE WHEN regexp_matches(x, '\p{Latin}') THEN 'Latin' END, CASE WHEN regexp_matches(x, '\p{Cyrillic}') THEN 'Cyrillic' END, CASE WHEN regexp_matches(x, '\p{Hiragana}') THEN 'Hiragana' END, CASE WHEN regexp_matches(x, '\p{Katakana}') THEN 'Katakana' END, CASE WHEN regexp_matches(x, '\p{Han}') THEN 'Han' END, CASE WHEN regexp_matches(x, '\p{Arabic}') THEN 'Arabic' END, CASE WHEN regexp_matches(x, '\p{Hebrew}') THEN 'Hebrew' END, CASE WHEN regexp_matches(x, '\p{Hangul}') THEN 'Hangul' END, CASE WHEN regexp_matches(x, '\p{Greek}') THEN 'Greek' END, CASE WHEN regexp_matches(x, '\p{Thai}') THEN 'Thai' END], lambda s: s IS NOT NULL)), ',') AS scripts, len(x) - len(replace(x, chr(65533), '')) AS lost FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents)""")
def c34(t):
    x = T.plain("text")
    return t.documents.select("doc_id", F.array_join(T.scripts(x), ",").alias("scripts"), F.regexp_count(x, F.lit("�")).cast("long").alias("lost"))


@query("c35_nonprose")
def c35(t):
    score = T.nonprose(T.plain("text"))
    return t.documents.select("doc_id", F.round(score, 6).alias("score"), F.when(score >= 0.45, "nonprose").when(score <= 0.12, "prose").alias("kind"))


@query("c36_surface_features", r"""SELECT doc_id, len(x)::INT AS chars, len(regexp_extract_all(x, '\p{L}+'))::INT AS words, round(len(regexp_extract_all(x, '\p{Nd}')) / greatest(len(x), 1), 6) AS digits, round(len(regexp_extract_all(x, '[^\p{L}\p{N}\s]')) / greatest(len(x), 1), 6) AS punctuation FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents)""")
def c36(t):
    x = T.plain("text")
    return t.documents.select("doc_id", F.length(x).alias("chars"), F.regexp_count(x, F.lit(r"\p{L}+")).alias("words"), F.round(T.share(x, r"\p{Nd}"), 6).alias("digits"), F.round(T.share(x, r"[^\p{L}\p{N}\s]"), 6).alias("punctuation"))


@query("c37_predicates", r"""SELECT conv_id, turn, contains(lower(x), 'your previous response') OR contains(lower(x), 'quality validation') OR contains(lower(x), 'failures:') OR contains(lower(x), '"code":') OR contains(lower(x), '"value":') OR contains(lower(x), 'retry policy') AS machine, b = '' OR (len(b) < 80 AND NOT regexp_matches(b, '[.!?]$')) AS structural, regexp_matches(b, '(?i)^chapter\b') OR (b = upper(b) AND len(b) < 80 AND NOT regexp_matches(b, '[^\x00-\x7F]')) AS section_break, regexp_matches(upper(role), '[/&+]|\b(?:AND|DUAL|CHORUS|TWINS|CROWD|GROUP|UNISON|BOTH|EVERYONE|TOGETHER|VOICES)\b') AS group_label, NOT regexp_matches(x, '[\p{L}\p{N}]') AS nonverbal FROM (SELECT conv_id, turn, role, coalesce(text, '') AS x, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS b FROM conversations)""")
def c37(t):
    x = T.plain("text")
    return t.conversations.select("conv_id", "turn", T.is_machine_output(x).alias("machine"), T.is_structural(x).alias("structural"), T.is_section_break(x).alias("section_break"), T.is_group_label(F.col("role")).alias("group_label"), T.is_nonverbal(x).alias("nonverbal"))


@query("c38_redaction", "SELECT doc_id, md5(" + replaced("coalesce(text, '')", [(p, by.replace("$", "\\")) for p, by in T.secret_shapes()]) + ") AS digest FROM documents")
def c38(t):
    return t.documents.select("doc_id", digest(T.redacted(T.plain("text"))).alias("digest"))


@query("c39_url_tokens", "SELECT page_id, array_to_string(list_filter(regexp_extract_all(lower(coalesce(url, '')), '[a-z0-9]+'), lambda w: NOT regexp_matches(w, '^[0-9]+$') AND w NOT IN ('http', 'https', 'www')), '-') AS slug FROM pages")
def c39(t):
    words = F.regexp_extract_all(F.lower(T.plain("url")), F.lit("[a-z0-9]+"), F.lit(0))
    return t.pages.select("page_id", F.array_join(F.filter(words, lambda w: ~w.rlike("^[0-9]+$") & ~w.isin("http", "https", "www")), "-").alias("slug"))


LISTED = lambda words: ", ".join(f"'{w}'" for w in words)


@query("c42_traits", rf"WITH c AS (SELECT doc_id, len(list_filter(w, lambda x: x IN ({LISTED(T.MALE)}))) AS m, len(list_filter(w, lambda x: x IN ({LISTED(T.FEMALE)}))) AS f FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{W}') AS w FROM documents)) SELECT doc_id, CASE WHEN m > f THEN 'male' WHEN f > m THEN 'female' ELSE 'unknown' END AS gender, CASE WHEN doc_id % 90 <= 12 THEN 'child' WHEN doc_id % 90 <= 19 THEN 'teen' WHEN doc_id % 90 <= 29 THEN 'young_adult' WHEN doc_id % 90 <= 39 THEN 'adult' WHEN doc_id % 90 <= 59 THEN 'middle_aged' ELSE 'elderly' END AS age FROM c")
def c42(t):
    return t.documents.select("doc_id", T.gender(T.plain("text")).alias("gender"), T.age_group(F.col("doc_id") % 90).alias("age"))
