"""Objects out of text that was meant to be JSON: prose around it, several arrays, damage inside, an end that is missing."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of the tags between which models think aloud.
THINKING = ["think", "thinking", "reflection", "reasoning"]
ROW = "array int, item int, start long, end long, state string, gap boolean, value string"

BRACKETS, STRING = re.compile(r'["{}\[\]]'), re.compile(r'(?:[^"\\]|\\.)*"', re.S)
STRING_OR_COMMA = re.compile(r'"(?:[^"\\]|\\.)*"|,(?=\s*[}\]])|(?<=[}\]])(?=\s*[{\[])', re.S)
OPENS, CLOSES = {"{": "}", "[": "]"}, {"}": "{", "]": "["}


def answer_range(text: str) -> tuple[str, int, int]:
    """(the text with thinking blanked out, start, end) of the part to scan: what the first code fence holds, if there is one."""
    for tag in THINKING:
        blank = lambda m: " " * len(m[0])  # noqa: E731  offsets stay
        text = re.sub(rf"<{tag}>.*?(?:</{tag}>|$(?![\s\S]))", blank, text, flags=re.S)
    fence = re.search(r"```(?:json)?(.*?)```", text, re.S)
    return text, *(fence.span(1) if fence else (0, len(text)))


def parsed(span: str) -> tuple[str, str] | None:
    """(state, normal form) of an object: whole, or mended (control characters in strings, commas too many or missing); None if it's neither."""
    try:
        return "whole", json.dumps(json.loads(span), ensure_ascii=False, separators=(",", ":"))
    except (ValueError, RecursionError):  # the latter: nested too deep to be read
        pass
    mended = STRING_OR_COMMA.sub(lambda m: m[0] if m[0].startswith('"') else "" if m[0] else ",", span)
    try:
        return "mended", json.dumps(json.loads(mended, strict=False), ensure_ascii=False, separators=(",", ":"))
    except (ValueError, RecursionError):
        return None


class Scan:
    """One pass with a stack of open brackets. Strings count inside brackets only, so quotes in prose don't matter.

    An object that closes is a node if it parses; if not, or if it never closes, the nodes found in it go to what is around it. One in
    an array that doesn't parse and has none is broken.
    """

    def __init__(self, text: str):
        self.text, begin, self.end = answer_range(text)
        self.stack: list[dict] = [{"kind": "", "start": begin, "nodes": []}]
        at = begin
        while m := BRACKETS.search(self.text, at, self.end):
            at, sign = m.end(), m[0]
            if sign == '"':
                if len(self.stack) > 1:
                    closing = STRING.match(self.text, at, self.end)
                    if not closing:
                        break
                    at = closing.end()
            elif sign in OPENS:
                self.stack.append({"kind": sign, "start": m.start(), "nodes": []})
            elif any(f["kind"] == CLOSES[sign] for f in self.stack):
                while self.stack[-1]["kind"] != CLOSES[sign]:
                    self.lost()
                self.closed(at)
        while len(self.stack) > 1:
            self.lost()

    def lost(self) -> None:
        """The innermost bracket never closes."""
        frame = self.stack.pop()
        if frame["kind"] == "[":
            self.stack[-1]["nodes"].append({"array": True, "start": frame["start"], "end": self.end, "nodes": frame["nodes"], "cut": True})
        else:
            self.stack[-1]["nodes"] += frame["nodes"]

    def closed(self, end: int) -> None:
        frame = self.stack.pop()
        if frame["kind"] == "[":
            self.stack[-1]["nodes"].append({"array": True, "start": frame["start"], "end": end, "nodes": frame["nodes"], "cut": False})
            return
        found = parsed(self.text[frame["start"] : end])
        if not found and not frame["nodes"] and any(f["kind"] == "[" for f in self.stack):
            found = "broken", None
        self.stack[-1]["nodes"] += [{"array": False, "start": frame["start"], "end": end, "value": found}] if found else frame["nodes"]

    def rows(self):
        """A row for each object, in order: array (from 1; 0 outside of any), item in it, start, end, state, gap, value.

        ``gap``: other text than blanks and commas stands between the array and the one before it. An object of an array that never
        closes is salvaged. Arrays without objects are counted too.
        """
        last, number = None, 0

        def objects(nodes):
            todo = nodes[::-1]
            while todo:
                n = todo.pop()
                if n["array"]:
                    todo += n["nodes"][::-1]
                else:
                    yield n

        loose = 0
        for node in self.stack[0]["nodes"]:
            if node["array"]:
                number += 1
                gap = last is not None and bool(self.text[last : node["start"]].strip(" \t\r\n,"))
                last = node["end"]
                for i, n in enumerate(objects(node["nodes"])):
                    state, value = n["value"]
                    yield number, i, n["start"], n["end"], "salvaged" if node["cut"] and value else state, gap, value
            else:
                yield 0, loose, node["start"], node["end"], node["value"][0], False, node["value"][1]
                loose += 1


class Objects:
    """The table function: a row of ``ROW`` for each object of a text; none of a null or empty one."""

    def eval(self, text: str):
        if text:
            yield from Scan(text).rows()


def register(spark: SparkSession, name: str = "loose_json") -> str:
    """Register the table function for SQL: ``SELECT * FROM t, LATERAL loose_json(t.text)``."""
    spark.udtf.register(name, F.udtf(Objects, returnType=ROW))
    return name


def objects(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """``columns`` of ``rows`` beside each object of the column ``text`` (see ``Scan.rows``)."""
    name = register(rows.sparkSession)
    return rows.sparkSession.sql(f"SELECT {', '.join(f'r.`{c}`' for c in columns)}, j.* FROM {{rows}} r, LATERAL {name}(r.`{text}`) j", rows=rows)


def one_answer(found: DataFrame, keys: list[str], text: str = "text", least: int = 3) -> DataFrame:
    """keys, n_arrays, n_objects, state of texts' objects, of arrays that have any.

    rejected: an object of an array is broken. ambiguous: other text separates arrays. overlap: an array's first object begins with
    ``least`` words or more (of its field ``text``) that the last object of the array before it ends with. Else salvaged where an end is
    missing, joined for several arrays, or one.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(F.get_json_object("value", f"$.{text}"), F.lit(""))), F.lit(r"[\p{L}\p{N}_']+"), F.lit(0))
    rows = found.filter("array > 0").withColumn("words", words)
    arrays = rows.groupBy(*keys, "array").agg(F.count("value").alias("n"), F.max("gap").alias("gap"), F.max(F.col("state") == "salvaged").alias("cut"), F.max(F.col("state") == "broken").alias("broken"), F.min_by("words", "item").alias("first"), F.max_by("words", "item").alias("last"))
    whole = arrays.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("array", "first", "last"))).alias("a"), F.sum("n").alias("n_objects"), F.max("gap").alias("gap"), F.max("cut").alias("cut"), F.max("broken").alias("broken"))

    def again(i):
        x, y = F.col("a")[i - 1]["last"], F.col("a")[i]["first"]
        longest = F.least(F.size(x), F.size(y))
        return F.exists(F.sequence(F.lit(1), longest), lambda k: (k >= least) & (F.slice(x, -k, k) == F.slice(y, 1, k))) & (longest > 0)

    overlap = (F.size("a") > 1) & F.exists(F.sequence(F.lit(1), F.greatest(F.size("a") - 1, F.lit(1))), again)
    state = F.when(F.col("broken"), "rejected").when(F.col("gap"), "ambiguous").when(overlap, "overlap").when(F.col("cut"), "salvaged").when(F.size("a") > 1, "joined").otherwise("one")
    return whole.select(*keys, F.size("a").cast("long").alias("n_arrays"), "n_objects", state.alias("state"))
