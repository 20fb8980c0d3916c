"""Queries of sections A (pages to text) and K (stateful work, here over the whole table as a batch)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..streaming import state as S
from .registry import query

# Tags after which a paragraph ends.
BLOCKS = "p|div|h1|h2|h3|h4|h5|h6|li|blockquote|hr|tr|section|article"


def page_text(x):
    """Text of well-formed pages by regular expressions alone (``sources.files.html_to_text`` parses)."""
    x = F.regexp_replace(x, r"(?is)<script\b.*?</script>|<style\b.*?</style>", "")
    x = F.regexp_replace(F.regexp_replace(x, r"(?i)<br\s*/?>", "\n"), rf"(?i)</?(?:{BLOCKS})\b[^>]*>", "\n\n")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", ""), "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


@query("a06_html_text", rf"SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script>|<style\b.*?</style>', '', 'g'), '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</?(?:{BLOCKS})\b[^>]*>', chr(10) || chr(10), 'g'), '<[^>]*>', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM pages")
def a06(t):
    return t.pages.select("page_id", F.md5(page_text(F.coalesce("html", F.lit(""))).cast("binary")).alias("digest"))


@query("k02_done_set", "SELECT user_id, event_type, min(event_id) AS event_id, count(*) - 1 AS skipped FROM events GROUP BY 1, 2")
def k02(t):
    return t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"), (F.count("*") - 1).alias("skipped"))


@query("k04_carried_peak", "SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS peak FROM events")
def k04(t):
    return t.events.select("event_id", F.max("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)).alias("peak"))


@query("k06_last_lines", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 20")
def k06(t):
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return t.events.withColumn("k", F.row_number().over(w)).filter("k <= 20").select("event_id")


@query("k07_sessions", "WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM x) SELECT user_id, epoch_us(min(ts)) // 1000000 AS began, count(*) AS n FROM s GROUP BY user_id, s")
def k07(t):
    return S.sessions(t.events, ["user_id"], "ts", "6 hours").select("user_id", F.col("start").cast("long").alias("began"), "n")


@query("k08_interrupted", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'interrupted' ELSE o_orderstatus END AS status FROM orders")
def k08(t):
    return t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "interrupted").otherwise(F.col("o_orderstatus")).alias("status"))
