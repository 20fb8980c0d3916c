"""Result artifacts by arm and id, front matter of a known template."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledgers as L
from .registry import query

BOOKS = ["urgent", "high", "medium", "low"]
NAME = "'w' || o_orderstatus || '__' || lower(substr(o_orderpriority, 3)) || '__' || o_orderkey"
EXPERIMENT = "CASE WHEN o_orderstatus = 'F' THEN '' ELSE '\"experiment\": \"e' || year(o_orderdate) || '\"' END"
ROWS = "'{\"arm\": \"a\", \"id\": ' || o_custkey || ', \"correct\": ' || CASE WHEN o_totalprice > 100000 THEN 'true' ELSE 'false' END || '}, {\"arm\": \"b\", \"id\": ' || o_custkey || '}, {\"arm\": null, \"id\": 1}'"
BODY = f"'{{\"meta\": {{' || {EXPERIMENT} || '}}, \"rows\": [' || {ROWS} || ']' || CASE WHEN o_orderpriority LIKE '3%' THEN '}}' WHEN o_orderpriority LIKE '2%' AND o_orderstatus = 'O' THEN ', \"summ' ELSE ', \"summary\": {{\"n\": 3}}}}' END"
BOOK = "CASE " + " ".join(f"WHEN contains(name, '{b}') THEN '{b}'" for b in BOOKS) + " END"


@query("a15_arm_results", f"WITH a AS (SELECT {NAME} AS name, {BODY} AS body FROM orders), v AS (SELECT name, CAST(body AS JSON) AS j, {BOOK} AS book FROM a WHERE json_valid(body)), r AS (SELECT coalesce(json_extract_string(j, '$.meta.experiment'), split_part(name, '__', 1)) AS family, book, name, unnest(from_json(json_extract(j, '$.rows'), '[{{\"arm\": \"VARCHAR\", \"id\": \"BIGINT\", \"correct\": \"BOOLEAN\"}}]')) AS r FROM v WHERE book IS NOT NULL AND json_extract(j, '$.summary') IS NOT NULL) SELECT family, book, r.arm AS arm, r.id AS id, arg_max(coalesce(r.correct, false), name) AS correct FROM r WHERE r.arm IS NOT NULL AND r.id IS NOT NULL GROUP BY 1, 2, 3, 4")
def a15(t):
    artifacts = t.orders.select(F.expr(NAME).alias("name"), F.expr(BODY).alias("body"))
    return L.arm_results(artifacts, "name", "body", BOOKS)


NEWLINE = "chr(10)"
FRONT = f"CASE WHEN lang = 'en' THEN 'Manifesto.' || {NEWLINE} || 'Contents' || {NEWLINE} || 'Original Web Novel Chapter — Complete.' || {NEWLINE} || 'Original Translation by A. N. Other.' || {NEWLINE} || {NEWLINE} || text WHEN lang = 'de' THEN 'Manifesto. ' || text ELSE text END"


@query("c10_front_matter", f"WITH d AS (SELECT doc_id, {FRONT} AS text FROM documents), h AS (SELECT *, CASE WHEN regexp_matches(text, '^[\\x{{FEFF}} \\t\\r\\n]*Manifesto\\.') THEN regexp_extract(text, '(?s)^(.*?{L.ANCHOR})', 1) WHEN text IS NOT NULL THEN '' END AS head FROM d) SELECT doc_id, length(head)::INT AS removed_chars, (length(head) - length(replace(head, chr(10), '')))::INT AS removed_lines, md5(substr(text, length(head) + 1)) AS digest FROM h")
def c10(t):
    d = t.documents.select("doc_id", F.expr(FRONT).alias("text"))
    return L.without_front_matter(d, "text").select("doc_id", "removed_chars", "removed_lines", F.md5(F.col("text").cast("binary")).alias("digest"))
