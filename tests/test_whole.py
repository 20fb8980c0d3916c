"""Whole forms of queries against plain Python, on made-up rows that the cut forms got wrong."""

import random
import re

from pyspark.sql import functions as F

from tessera.operators import blocks, cascades, sequences
from tessera.operators import quotes as Q
from tessera.plans import catalogue


def test_quotes_are_located_by_their_whole_key(spark):
    rng = random.Random(3)
    start = "The same opening of twenty-four characters, then "
    texts = [(i, " ".join(rng.choice(["ab", "cd", "ef", "éß", "x9"]) for _ in range(60))) for i in range(20)]
    texts += [(100, f"{start} one end. {start} two ends!"), (101, "Ah-ha-ha-ha! Ah-ha-ha-ha!\nAh ha ha ha"), (102, ""), (103, None)]
    quotes = [(0, start + "one end"), (1, start + "three"), (2, start), (3, "Ah!"), (4, "ah ha ha ha ah ha"), (5, None)]
    quotes += [(10 + i, text[5:40]) for i, text in texts[:20]]
    norm = lambda x: "".join(re.findall("[0-9a-z]+", (x or "").lower()))
    want = set()
    for i, q in quotes:
        k, found = norm(q), set()
        for d, text in texts:
            s = norm(text)
            at = s.find(k) if len(k) >= 12 else -1
            if at >= 0:
                found.add((i, d, "ambiguous" if s.find(k, at + 1) >= 0 else "located"))
        want |= found or {(i, None, "too_short" if len(k) < 12 else "not_found")}
    got = Q.located(spark.createDataFrame(quotes, "item_id int, text string"), spark.createDataFrame(texts, "doc_id int, text string"), "item_id", "doc_id")
    rows = [tuple(r) for r in got.select("item_id", "doc_id", "status").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert {r[2] for r in rows} == {"located", "ambiguous", "not_found", "too_short"}
    assert (0, 100, "located") in want


def test_words_come_from_the_whole_text(spark, tmp_path):
    text = "a " * 100 + "one two\nthree two four " + "b " * 90 + "five"
    spark.createDataFrame([(1, text)], "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.words for r in catalogue.queries()["d15_unique_extend_whole"](spark, str(tmp_path)).collect()] == ["a,one,two,three,four,b,five"]


def write(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_alias_classes_give_all_pairs_of_parts(spark, tmp_path):
    rng = random.Random(4)
    parts = [(i, f"B{rng.randrange(9)}", rng.choice(["B1", "T1", "T2", "T3", None])) for i in range(120)]
    write(spark, tmp_path, part=(parts, "p_partkey int, p_brand string, p_type string"))
    rows = catalogue.queries()["g06_alias_classes"](spark, str(tmp_path)).collect()
    classes = {}
    for r in rows:
        classes.setdefault(r.name, set()).add(r.p_partkey)
    assert all(r.members == len(classes[r.name]) for r in rows) and len(rows) == sum(map(len, classes.values()))
    got = {(a, b) for c in classes.values() for a in c for b in c if a < b}
    want = {(a, b) for a, *x in parts for b, *y in parts if a < b and set(x) & set(y) - {None}}
    assert got == want
    assert {(r.a, r.b) for r in catalogue.queries()["g06_alias_groups"](spark, str(tmp_path)).collect()} < got


def test_coverage_looks_at_all_ids(spark, tmp_path):
    write(spark, tmp_path, customer=([(i,) for i in range(1, 7)], "c_custkey int"), orders=([(1,), (2,), (2,), (9,), (9,), (None,)], "o_custkey int"))
    got = {tuple(r) for r in catalogue.queries()["j15_span_coverage_whole"](spark, str(tmp_path)).select("id", "finding", "n").collect()}
    assert got == {(i, "missing", 0) for i in (3, 4, 5, 6)} | {(9, "unknown", 2), (None, "malformed", 1)}


def test_overlaps_are_with_any_other_interval(spark, tmp_path):
    from datetime import datetime, timedelta

    rng = random.Random(5)
    ats = [(i, rng.randrange(4), rng.randrange(200_000), rng.choice([0.0, 0.5, 1.0, 5.0, 20.0])) for i in range(150)]
    write(spark, tmp_path, events=([(i, u, datetime(2024, 1, 1) + timedelta(seconds=a), v) for i, u, a, v in ats], "event_id int, user_id int, ts timestamp_ntz, value double"))
    spans = [(i, u, a, a + round(v * 600)) for i, u, a, v in ats if v]
    want = {i for i, u, a, b in spans if any(j != i and w == u and a < d and c < b for j, w, c, d in spans)}
    got = [r.event_id for r in catalogue.queries()["g12_overlap_semi_whole"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and 0 < len(want) < len(spans)


def test_duplicate_blocks_follow_the_greedy_rule(spark):
    def brute(texts):
        found, occupied = [], set()
        for size in range(5, 1, -1):
            i = 0
            while i + 2 * size <= len(texts):
                left, at = texts[i : i + size], set(range(i, i + 2 * size))
                if not at & occupied and left == texts[i + size : i + 2 * size] and all(len(x) >= 8 for x in left):
                    found.append((i + 1, size))
                    occupied |= at
                    i += 2 * size
                else:
                    i += 1
        return found

    rng = random.Random(6)
    pool = ["line number one", "line number two", "line number three", "short"]
    docs = [(i, "\n".join(rng.choice(pool[: rng.randrange(1, 5)]) for _ in range(rng.randrange(40)))) for i in range(400)]
    a, b = pool[0], pool[1]
    docs += [(1000, "\n".join([a, b, a, b])), (1001, f"{a}\n{a}"), (1002, None), (1003, "")]
    want = sorted((i, *x) for i, text in docs if text is not None for x in brute(text.split("\n")))
    got = sorted(tuple(r) for r in blocks.adjacent_duplicates(spark.createDataFrame(docs, "doc_id int, text string"), "doc_id", "text").collect())
    assert got == want and [x for x in got if x[0] >= 1000] == [(1000, 1, 2)] and {x[2] for x in got} == {2, 3, 4, 5}


def test_cascade_ranks_by_tier_and_has_a_limit(spark):
    def resolve(raw, names):
        norm = lambda x: re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", "", x.lower())).strip()
        r = norm(raw)
        if not r:
            return None
        keyed = [(i, norm(n)) for i, n in names if norm(n)]
        for i, n in keyed:
            if n == r:
                return i, 1
        for i, n in keyed:
            if re.search(rf"\b{r}\b", n) or re.search(rf"\b{n}\b", r):
                return i, 2
            if min(len(r), len(n)) >= 3 and abs(len(r) - len(n)) <= 2 and (n.startswith(r) or r.startswith(n)):
                return i, 2
        score = lambda n: len(set(r.split()) & set(n.split())) / len(set(r.split()) | set(n.split()))
        best = max(keyed, key=lambda x: (score(x[1]), -x[0]), default=None)
        return (best[0], 3) if best and score(best[1]) >= 0.4 else None

    rng = random.Random(8)
    pool = ["Ann", "Anna", "al", "Allan", "john", "johnson", "Mr.", "Darcy", "of", "the", "Bennet", "Annabel"]
    some = lambda n: [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(5)))) for i in range(n)]
    raws, names = [*some(120), (500, "?!"), (501, "an of x y z")], some(14)
    got = cascades.fuzzy_cascade(spark.createDataFrame(raws, "raw int, text string"), spark.createDataFrame(names, "name int, text string"), "raw", "name", "text").collect()
    want = {i: x for i, raw in raws if (x := resolve(raw, names))}
    assert {r.raw: (r["name"], r.tier) for r in got} == want and len(got) == len(want)
    assert {t for _, t in want.values()} == {1, 2, 3} and len(want) < len(raws)


def test_files_match_by_stem_then_by_f1(spark):
    files = [(1, "Book1"), (2, "Michael Kramer The Hero of Ages-converted"), (3, "entirely other words of mine"), (4, "Volume 12")]
    books = [(1, "book1 hero"), (2, "Book1"), (3, "Hero of Ages "), (4, "Mistborn The Hero of Ages by some others in a series"), (5, "Volume 13")]
    got = cascades.token_f1(spark.createDataFrame(files, "f int, stem string"), spark.createDataFrame(books, "s int, stem string"), "f", "s", "stem").collect()
    assert {(r.f, r.s, r.tier) for r in got} == {(1, 2, 1), (2, 3, 2)}


def planned(df):
    return df._jdf.queryExecution().toString()


def test_a_long_group_is_streamed_not_collected(spark, tmp_path):
    import hashlib

    rng = random.Random(9)
    docs = [(i, rng.choice("ab"), None if i % 50 == 7 else f"text {rng.random()}") for i in range(3000)]
    docs += [(9001, None, "no source"), (9002, "nulls", None)]
    talk = [(c, i, rng.choice(["x", "y", "z"])) for c in (1, 2) for i in range(3000)]
    sizes = [(u, i, rng.choice([1.0, 50.0, 249.0, 250.0, 300.0])) for u in (1, 2) for i in range(3000)]
    write(spark, tmp_path, documents=(docs, "doc_id int, source string, text string"))
    df = catalogue.queries()["b09_lineage"](spark, str(tmp_path))
    assert "collect_list" not in planned(df)
    want = {}
    for i, s, x in docs:
        want.setdefault(s, []).append(x)
    line = lambda xs: "".join(hashlib.sha256(x.encode()).hexdigest() for x in xs if x is not None)
    want = {s: (len(xs), hashlib.sha256(line(xs).encode()).hexdigest() if line(xs) else None) for s, xs in want.items()}
    assert {r.source: (r.inputs, r.digest) for r in df.collect()} == want

    df = sequences.alternating(spark.createDataFrame(talk, "conv int, turn int, who string").repartition(5), ["conv"], "turn", "who")
    assert "collect_list" not in planned(df)
    want, last, other = [], None, None
    for c, i, who in talk:
        last, other = (None, None) if i == 0 else (last, other)
        out = other if who == last and other else who
        last, other = out, last if out != last else other
        want.append((c, i, who, out))
    assert sorted(tuple(r) for r in df.collect()) == want

    df = sequences.tumbling(spark.createDataFrame(sizes, "u int, i int, v double").repartition(5), ["u"], ["i"], F.col("v"), 250.0)
    assert "collect_list" not in planned(df)
    want, chunk, total = [], 0, 0.0
    for u, i, v in sizes:
        chunk, total = (0, 0.0) if i == 0 else (chunk, total)
        want.append((u, i, v, chunk))
        chunk, total = (chunk + 1, 0.0) if total + v >= 250 else (chunk, total + v)
    assert sorted(tuple(r) for r in df.collect()) == want


def test_speaker_runs_merge_within_their_limit(spark):
    rng = random.Random(10)
    rows = [(c, i, rng.choice("xxxy"), "w" * rng.randrange(30)) for c in (1, 2) for i in range(800)]
    df = sequences.speaker_runs(spark.createDataFrame(rows, "conv int, turn int, who string, text string").repartition(5), ["conv"], "turn", "who", "text", 60)
    assert "array_append" not in planned(df)
    want = []
    for c, i, who, text in rows:
        if want and want[-1][0] == c and want[-1][2] == who and (not want[-1][3].strip() and not want[-1][5] or want[-1][5] + 1 + len(text) <= 60):
            old = want.pop()
            n = old[5] + (old[5] > 0) + len(text)
            want.append((c, old[1], who, old[3] + " " + text, old[4] + 1, n))
        else:
            want.append((c, i, who, text, 1, len(text)))
    got = df.select("conv", "turn", "who", "text", "n_lines").collect()
    assert sorted(tuple(r) for r in got) == [x[:5] for x in want]
