"""Fill-in-the-middle, the conversation trie and SuperMinHash against direct computations."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tessera.llm import fim, ngrams, superminhash, trie
from tessera.llm.common import mix64

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ALPHABET = ["a", "bc", " ", "\n", "\t", "é", "漢", " ", "𝄞", "  ", "x" * 9, "\x1f", "\x85"]


def some_texts(seed, n, most):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(most))) for _ in range(n)]


@pytest.mark.parametrize("unit,every,stretch", [("token", 1, 7), ("token", 3, 16), ("token", 256, 1 << 19), ("char", 2, 5), ("char", 64, 11)])
def test_checkpoints_against_a_list_of_units(unit, every, stretch):
    for text in ["", " ", "a", " a", "a ", "\n\n", *some_texts(every, 60, 60)]:
        units = list(text) if unit == "char" else TOKEN.findall(text)
        index = fim.Checkpoints(text.encode(), unit, every, stretch)
        assert (index.n, index.chars) == (len(units), len(text))
        assert len(index.units) == 1 + len(units) // every
        for k in range(len(units) + 1):
            head = "".join(units[:k])
            assert index.cut(k, reach=stretch) == (len(head.encode()), len(head))


def direct_fim(doc_id, text):
    units = TOKEN.findall(text)
    h = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    i, j = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if h4 % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark):
    rng = random.Random(4)
    texts = [None, "", " ", "<P> a", "a <S", "S> <", "<", "<<", "P>", "a<M>", " ".join("w%d" % i for i in range(250_000)), *some_texts(9, 150, 40)]
    texts += ["".join(rng.choice(["<", "P", "S", "M", ">", " "]) for _ in range(12)) for _ in range(150)]
    rows = [(i if i != 20 else None, t, "kept", -i, "clash") for i, t in enumerate(texts)] + [(5, texts[5], "again", 0, "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra string, n long, form string")
    out = fim.fill_in_middle(docs).withColumn("back", fim.restored(*(ngrams.F.col(c) for c in ("output", "form"))))
    got = out.collect()
    want = [("" if i is None else i, e, direct_fim("" if i is None else i, t or ""), t or "") for i, t, e, _, _ in rows]
    key = lambda x: (str(x[0]), x[1])
    assert sorted((("" if r.doc_id is None else r.doc_id, r.extra, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output), r.back) for r in got), key=key) == sorted(want, key=key)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def direct_trie(rows):
    """Nodes by grouping prefixes in plain Python."""
    digest = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(turns)] for c, turns in own.items()}
    strings = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        strings[c] = own.get(base, [])[:h] + own[c][h:]
    nodes = {}
    for c, s in strings.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    kids = {}
    for path in nodes:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        below = kids.get(path, [])
        leaves[path] = sum(leaves[k] for k in below) if below else 1
        saved[path] = (len(nodes[path]) - 1) * (len(path[-1][1].encode()) if path else 0) + sum(saved[k] for k in below)
    out = []
    for path, who in nodes.items():
        ends = ",".join(str(c) for c in sorted(who) if len(strings[c]) == len(path))
        parent = min(nodes[path[:-1]]) if path else None
        out.append((min(who), len(path), parent, len(who), len(kids.get(path, [])), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talks(seed, n, longest):
    rng = random.Random(seed)
    rows, stems = [], [[(rng.choice("us"), rng.choice(["é", "bb", "ccc", ""])) for _ in range(longest)] for _ in range(3)]
    for c in range(-7, n):
        stem = rng.choice(stems)
        turns = stem[: rng.randrange(longest + 1)] + [(rng.choice("us"), rng.choice(["x", "yy", "zzz"])) for _ in range(rng.randrange(4))]
        rows += [(c, i, role, text) for i, (role, text) in enumerate(turns)]
    rows += [(None, 1, "u", "lost"), (3, None, None, "first"), (3, None, None, None), (4, 1, "u", "tie"), (4, 1, "s", "tie"), (4, 1, "s", "tie")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,n,longest,segment,most", [(1, 60, 12, 512, 4096), (2, 40, 10, 4, 3), (3, 12, 4, 1, 2), (4, 40, 9, 5, 1)])
def test_trie_against_prefixes(spark, seed, n, longest, segment, most):
    rows = talks(seed, n, longest)
    turns = trie.coded(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))
    got = trie.prefix_trie(*trie.rebuilt(trie.stored(turns, "coded")), segment=segment, most=most).collect()
    assert sorted((tuple(r) for r in got), key=str) == direct_trie(rows)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    make = lambda rows: sorted((tuple(r) for r in trie.prefix_trie(*trie.rebuilt(trie.stored(trie.coded(spark.createDataFrame(rows, schema)), "coded"))).collect()), key=str)
    assert make([]) == []
    alone = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 9 > 0 and c % 5)
    assert make([(alone, 0, "u", "gone")]) == direct_trie([(alone, 0, "u", "gone")]) and direct_trie([(alone, 0, "u", "gone")])[0][:5] == (alone, 0, None, 1, 0)


def direct_signature(elements, places):
    """An order of its own for each element, by exchanging positions; the smallest rank and fraction at each place."""
    out = [None] * places
    for e in elements.tolist():
        order = list(range(places))
        for rank in range(places):
            x = int(mix64(np.array([(e + (rank + 1) * int(ngrams.ODD[0])) % (1 << 64)], np.uint64))[0])
            k = rank + ((x >> 32) * (places - rank) >> 32)
            order[rank], order[k] = order[k], order[rank]
            value = rank << 32 | x & 0xFFFFFFFF
            out[order[rank]] = value if out[order[rank]] is None else min(out[order[rank]], value)
        assert sorted(order) == list(range(places))
    return out


def test_signatures_by_definition():
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (1, 2, 7, 40, 0, 300)]
    for dense, most in ((6, 40_000), (0, 5), (3, 50)):
        got = superminhash.signatures(sets, 32, dense, most)
        for s, g in zip(sets, got):
            assert g.tolist() == (direct_signature(s, 32) if len(s) else [(1 << 64) - 1] * 32)
    assert superminhash.signatures([], 32).shape == (0, 32)


def test_components_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(3)
    agree = []
    for _ in range(80):
        a = rng.integers(0, 1 << 63, 90, dtype=np.uint64)
        b = np.concatenate([a[:80], rng.integers(0, 1 << 63, 10, dtype=np.uint64)])
        x, y = superminhash.signatures([a, b], 384)
        agree.append((x == y).mean())
    assert abs(np.mean(agree) - 0.8) < 0.01
    assert np.var(agree) < 0.8 * 0.2 / 384  # less than that of independent components


def direct_classes(rows, words, percent):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), least[find(i)], least[find(i)] == d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("block", [1024, 4])
def test_near_duplicates_against_all_pairs(spark, block):
    rng = random.Random(block)
    pool = [f"W{i}É" for i in range(300)]
    texts = [None, "", " \n", "one", "One", "one two", "ONE\ttwo", "two one"]
    for _ in range(12):
        base = [rng.choice(pool) for _ in range(rng.randrange(5, 80))]
        for _ in range(rng.randrange(1, 14)):
            near = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 12)):
                near[rng.randrange(len(near))] = rng.choice(pool)
            texts.append(" ".join(near))
    chain = [rng.choice(pool) for _ in range(60)]
    for k in range(40):  # each is like the next one, the ends aren't alike
        texts.append(" ".join(chain[k:] + pool[:k]))
    ids = rng.sample(range(1000), len(texts))
    rows = [*zip(ids, texts), (ids[9], texts[9])]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, kept string, comp long, n_shingles long")
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in superminhash.near_duplicates(docs, block=block).collect()]
    assert sorted(got) == sorted(direct_classes(rows, 2, 80))
    assert superminhash.near_duplicates(docs.limit(0)).count() == 0


def test_union_find():
    rng = np.random.default_rng(1)
    u, v = rng.integers(0, 500, 400), rng.integers(0, 500, 400)
    least = {int(x): int(x) for x in np.concatenate([u, v])}
    for _ in range(500):
        before = dict(least)
        for a, b in zip(u.tolist(), v.tolist()):
            least[a] = least[b] = min(least[a], least[b])
        if least == before:
            break
    assert dict(zip(*(x.tolist() for x in ngrams.union_find(u, v)))) == least


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_components_by_rounds_and_in_one_task(spark, few):
    rng = random.Random(few)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1001 + i) for i in range(80)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(150)] + [(5, 5)]
    got = {r.node: r.comp for r in ngrams.components(spark.createDataFrame(edges, "u long, v long").repartition(4), "test", few=few).collect()}
    nodes, roots = ngrams.union_find(*(np.array(x) for x in zip(*edges)))
    assert got == {int(n): int(r) for n, r in zip(nodes, roots) if n != r}
