"""Numbers as words and back, and characters lost to U+FFFD, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English number words.
ONES = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]
TENS = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]

VALUES = {w: i for i, w in enumerate(ONES)} | {w: 10 * i for i, w in enumerate(TENS, 2)}
LOST = "�"


def _word(words: list[str], i: Column) -> Column:
    return F.get(F.array(*map(F.lit, words)), i.cast("int"))


def _below_100(n: Column) -> Column:
    tens = _word(TENS, F.floor(n / 10) - 2)
    return F.when(n < 20, _word(ONES, n)).when(n % 10 == 0, tens).otherwise(F.concat_ws(" ", tens, _word(ONES, n % 10)))


def said(digits: Column) -> Column:
    """Digits as a reader says them: to 999 as a number, four digits from 1100 as a year, anything longer digit by digit. Null for anything but digits."""
    n = F.ltrim(digits, F.lit("0"))
    n = F.when(F.length(n) <= 4, F.coalesce(n.try_cast("int"), F.lit(0)))
    high, low = F.floor(n / 100), n % 100
    rest = F.when(low > 0, _below_100(low))  # concat_ws skips nulls
    year = (
        F.when(n.between(2000, 2009), F.concat_ws(" ", F.lit("two thousand"), rest))
        .when(low == 0, F.concat_ws(" ", _below_100(high), F.lit("hundred")))
        .when(low < 10, F.concat_ws(" ", _below_100(high), F.lit("oh"), rest))
        .otherwise(F.concat_ws(" ", _below_100(high), rest))
    )
    apart = F.array_join(F.transform(F.split(digits, ""), lambda d: _word(ONES, d.cast("int"))), " ")
    return F.when(
        digits.rlike("^[0-9]+$"),
        F.when(n < 100, _below_100(n))
        .when(n < 1000, F.concat_ws(" ", _word(ONES, high), F.lit("hundred"), rest))
        .when((F.length(digits) == 4) & (n >= 1100), year)
        .otherwise(apart),
    )


def _total(words: Column, value) -> Column:
    """Fold number words; ``value`` gives a word's own value. Null where a word isn't a number word, there is none, or the result is over 9999."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("current"), F.lit(False).alias("seen"), F.lit(True).alias("ok"))

    def step(s, w):
        v = value(w)
        scale = lambda by: F.greatest(F.lit(1).cast("long"), s.current) * by
        return F.struct(
            F.when(w == "thousand", s.total + scale(1000)).otherwise(s.total).cast("long").alias("total"),
            F.when(w == "thousand", 0).when(w == "hundred", scale(100)).otherwise(s.current + F.coalesce(v, F.lit(0))).cast("long").alias("current"),
            (s.seen | (w != "and")).alias("seen"),
            (s.ok & (v.isNotNull() | w.isin("hundred", "thousand", "and"))).alias("ok"),
        )

    return F.aggregate(words, start, step, lambda s: F.when(s.ok & s.seen & (s.total + s.current <= 9999), s.total + s.current))


def number(words: Column) -> Column:
    """Spelled number (or one word of up to four digits) as an integer from 0 to 9999, else null: "two thousand and eight", "sixteen hundred eleven", "forty-seven"."""
    known = F.create_map(*[F.lit(x) for pair in VALUES.items() for x in pair])
    plain = lambda w: F.try_element_at(known, w)
    part = lambda w: F.when(F.contains(w, F.lit("-")), _total(F.split(w, "-"), plain)).otherwise(plain(w))
    digits = F.when((F.size(words) == 1) & words[0].rlike("^[0-9]{1,4}$"), words[0].try_cast("long"))
    return F.coalesce(digits, _total(F.transform(words, F.lower), part))


def same_number(a: Column, b: Column) -> Column:
    return F.coalesce(number(a) == number(b), F.lit(False))


def restored(text: Column) -> Column:
    """Characters lost to U+FFFD inferred from their neighbours, each on the text as it was; those without a rule stay.

    Texts are cut into runs of lost and of kept characters, so each run sees the last character before it and the first ones after it.
    """
    runs = F.regexp_extract_all(text, F.lit(f"(?s){LOST}+|[^{LOST}]+"), F.lit(0))
    blank = lambda c: c.isin("\n", " ", "\t")

    def mended(runs: Column, run: Column, i: Column) -> Column:
        n = F.length(run)
        before, after = F.coalesce(F.get(runs, i - 1), F.lit("\n")), F.coalesce(F.get(runs, i + 1), F.lit("\n"))
        left, right = F.right(before, F.lit(1)), F.left(after, F.lit(1))
        year = F.left(after, F.lit(6)).rlike(r"^\s*(?:1[89]|20)[0-9]{2}\b")
        letter = left.rlike(r"\p{L}")
        single = (
            F.when(year, "©")
            .when(blank(left) & right.rlike(r"[\p{L}\p{N}]"), "“")
            .when(left.isin(*".!?,;:…") & blank(right), "”")
            .when(letter & right.rlike(r"\p{Ll}"), "’")
            .when(letter & right.rlike(r"\p{Lu}"), "—")
            .when(left.rlike(r"\p{Nd}"), "–")
            .otherwise(LOST)
        )
        first = F.when(left.rlike(r"[\p{L}\p{N}.,!?]"), "…").when(blank(left), "“").otherwise(LOST)
        last = F.when(year, "©").when(blank(right), "”").otherwise(LOST)
        long = F.concat(first, F.repeat(F.lit("…"), n - 2), last)
        return F.when(~run.startswith(LOST), run).when(n == 1, single).otherwise(long)

    # the runs are bound to a name of their own, so a text is cut once and not for each neighbour of each run
    whole = F.get(F.transform(F.array(runs), lambda r: F.array_join(F.transform(r, lambda run, i: mended(r, run, i)), "")), F.lit(0))
    return F.when(F.contains(text, F.lit(LOST)), whole).otherwise(text)
