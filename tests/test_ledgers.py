"""Result artifacts and front matter on awkward rows."""

from tessera.operators import ledgers as L


def test_arm_results(spark):
    row = '{"arm": "%s", "id": %s, "correct": %s}'
    one = lambda *rows, end=', "summary": {}}': '{"rows": [' + ", ".join(rows) + "]" + end
    files = [("f__emma1", one(row % ("a", 1, "true"), row % ("a", 1, "false"))), ("f__emma2", one(row % ("a", 2, "true"), '{"arm": "a"}', '{"id": 3}')), ("f__emma3", one(row % ("a", 2, "null"))),
             ("f__emma4", one(row % ("a", 9, "true"), end="}")), ("f__emma5", '{"rows": ['), ("f__emma6", None), ("f__other", one(row % ("a", 8, "true"))), (None, one(row % ("a", 7, "true"))), ("f__emma7", '{"summary": {}}')]
    got = L.arm_results(spark.createDataFrame(files, "name string, body string"), "name", "body", ["emma"])
    assert sorted(map(tuple, got.collect())) == [("f", "emma", "a", 1, False), ("f", "emma", "a", 2, False)]
    assert L.arm_results(spark.createDataFrame([], "name string, body string"), "name", "body", ["emma"]).count() == 0


def test_front_matter(spark):
    head = "﻿\n Manifesto.\nx\nOriginal Light Novel Chapter - Incomplete. \n\nOriginal Translation by B.\n"
    rows = [(1, head + "story\nOriginal"), (2, "Manifesto. no end"), (3, "x" + head), (4, ""), (5, None), (6, head)]
    got = {r.i: (r.t, r.removed_chars, r.removed_lines) for r in L.without_front_matter(spark.createDataFrame(rows, "i int, t string"), "t").collect()}
    assert got == {1: ("story\nOriginal", len(head), head.count("\n")), 2: ("Manifesto. no end", 0, 0), 3: ("x" + head, 0, 0), 4: ("", 0, 0), 5: (None, None, None), 6: ("", len(head), head.count("\n"))}
