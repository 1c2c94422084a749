"""The dedup operators against brute force, and their odd inputs."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitspark.llm import _graph, lines, minhash, vectors

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def _words(text):
    return WORD.findall((text or "").translate(FOLD))


def _shingles(text, k):
    w = _words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def _components(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def _corpus(seed, n=120):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    docs = []
    for k in range(n):
        if docs and r.random() < 0.5:
            w = r.choice(docs).split(" ")
            for _ in range(r.randrange(3)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            if r.random() < 0.2:
                w = w[: r.randrange(1, len(w) + 1)]
        else:
            w = [r.choice(vocabulary) for _ in range(r.choice([1, 2, 5, 20, 60]))]
        docs.append(" ".join(w))
    odd = ["", None, " \t\n", "One", "ONE", "é É", "x" * 5000, "a " * 3000, "w1 w2 w3"]
    return [(k, t) for k, t in enumerate(docs + odd)]


@pytest.mark.parametrize("shingle", [2, 5])
def test_minhash_equals_brute_force(spark, shingle):
    rows = _corpus(shingle)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df, shingle=shingle).collect()}
    sets = {i: _shingles(t, shingle) for i, t in rows}
    pairs = [(i, j) for i in sets for j in sets if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    comp = _components(pairs, sets)
    assert got == {i: (len(s), comp[i], comp[i] == i) for i, s in sets.items()}


def test_minhash_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, component_id string")
    assert minhash.near_duplicates(empty).count() == 0
    rows = [(None, "a b c", "x"), (1, None, "x"), (1, None, "x"), (2, "q r s t u v", "x"), (2, "q r s t u v", "x"), (3, "q r s t u v", "x")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, empty.schema)).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in got) == [(-1, -1, False), (1, 1, True), (1, 1, True), (2, 2, True), (2, 2, True), (3, 2, False)]


def test_minhash_rows_that_repeat_a_key(spark):
    rows = [("0", "x y z u v w"), ("1", "y only other words here now"), ("1", "x y z u v w"), ("2", ""), ("2", "y only other words here now")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "name string, body string"), key="name", text="body", shingle=2).collect()
    assert sorted((r["name"], r["component_id"], r["kept"]) for r in got) == [("0", "0", True), ("1", "0", False), ("1", "1", True), ("2", "1", False), ("2", "2", True)]


def test_star_with_a_poor_hub_still_joins(spark):
    """Variants that are near the base but not near each other."""
    base = [f"b{k}" for k in range(200)]
    rows = [(99, " ".join(base))]
    for k in range(8):
        w = base[:]
        for j in range(9):
            w[(k * 20 + 2 * j) % 200] = f"v{k}-{j}"
        rows.append((k, " ".join(w)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()
    assert {r["component_id"] for r in got} == {0}


def test_signature_join_loses_no_pair_in_its_bound():
    r = np.random.default_rng(1)
    places = minhash.CHUNKS * minhash.WIDTH
    for _ in range(300):
        pair = np.repeat(r.integers(0, 1 << minhash.BITS, (places, 1), dtype=np.uint64), 2, axis=1)
        pair[r.choice(places, minhash.BOUND, replace=False), 1] ^= np.uint64(1)
        a, b = minhash._keys(pair)
        assert set(a.tolist()) & set(b.tolist())


def test_components(spark):
    r = random.Random(3)
    pairs = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 140)]
    got = {x["node"]: x["component"] for x in _graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == _components(pairs, {x for p in pairs for x in p})


def _brute_lines(rows):
    seen, gone = [], collections.defaultdict(set)
    for i, text in sorted(rows):
        for k, line in enumerate((text or "").split("\n")):
            s = set(_words(line))
            if s:
                if any(100 * len(s & z) >= 80 * len(s | z) for z in seen):
                    gone[i].add(k)
                seen.append(s)
    return gone


def test_lines_equal_brute_force(spark):
    r = random.Random(5)
    pool = [t for _, t in _corpus(9, 80) if t]
    rows = [(k, "\n".join(r.choice(pool) for _ in range(r.randrange(1, 6)))) for k in range(60)] + [(60, None), (61, ""), (62, "\n\n"), (63, "x\n" * 50 + "long " * 2000)]
    out = {x["doc_id"]: x for x in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = _brute_lines(rows)
    for i, text in rows:
        want = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone[i])
        assert out[i]["text"] == want and out[i]["n_removed"] == len(gone[i]), i


def test_lines_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, line string, n_lines string")
    assert lines.dedup_lines(empty).count() == 0
    same = "one two three four five six"
    df = spark.createDataFrame([(None, same, "c", "d"), (7, same, "c", "d"), (7, same, "c", "d"), (8, same, "c", "d")], empty.schema)
    got = sorted((r["doc_id"] or -1, r["text"], r["line"], r["n_removed"]) for r in lines.dedup_lines(df).collect())
    assert got == [(-1, same, "c", 0), (7, "", "c", 1), (7, same, "c", 0), (8, "", "c", 1)]


def test_lines_of_rows_that_repeat_a_key(spark):
    rows = [(1, "one two three four five six"), (2, "one two three four five six"), (2, "quite other words stand on this line"), (2, "q")]
    df = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], "doc_id long, text string, _key string, _gone string, row string")
    out = lines.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "_key", "_gone", "row", "n_lines", "n_removed"]
    got = sorted((r["doc_id"], r["text"], r["n_removed"]) for r in out.collect())
    assert got == [(1, rows[0][1], 0), (2, "", 1), (2, "q", 0), (2, rows[2][1], 0)]
    named = df.select(F.concat(F.lit("k"), "doc_id").alias("name"), F.col("text").alias("body"))
    for parts in (1, 5):
        again = sorted(map(tuple, lines.dedup_lines(named.repartition(parts), key="name", text="body").collect()))
        assert again == [("k1", rows[0][1], 1, 0), ("k2", "", 1, 1), ("k2", "q", 1, 0), ("k2", rows[2][1], 1, 0)]


def test_floor_of_words_leaves_equal_sets(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "d c b a"), (3, "a b c d e"), (4, "e a b c d f")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(df, min_words=5).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 1}


def _line_entries(seed):
    """Sets of words (numbers, the rarer the smaller) with the index's entries of them at 60 %; words share names."""
    r = np.random.default_rng(seed)
    base = [r.choice(400, r.integers(2, 30), replace=False) for _ in range(25)]
    sets = [np.unique(np.append(b[r.random(len(b)) < r.choice([0.7, 0.9, 1])], r.choice(400, r.integers(0, 4)))) for b in base for _ in range(6)]
    sets = [s for s in sets if len(s)]
    k = [int(lines._prefix(len(s), 60)) for s in sets]
    own = np.repeat(np.arange(len(sets)), k)
    h = [minhash.mix(s.astype(np.uint64)) for s in sets]
    b1, b2 = np.concatenate([lines._parity(x, np.zeros(1, np.int64)) for x in h], axis=1)
    c = r.permutation(len(sets))
    tok = np.concatenate([s[:j] % 150 for s, j in zip(sets, k, strict=True)]).astype(np.uint32)
    n = np.array([len(s) for s in sets], np.int32)
    return sets, c, {"tok": tok, "n": n[own], "p": np.concatenate([np.arange(j) for j in k]).astype(np.int32), "c": c[own], "b1": b1[own], "b2": b2[own]}


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_index_of_lines_meets_every_similar_pair(monkeypatch, block):
    monkeypatch.setattr(lines, "PAIR_ROWS", block)
    sets, c, entries = _line_entries(block)
    found = list(lines._pairs(entries, 60))
    got = {(int(x), int(y)) for a, b, _ in found for x, y in zip(a, b, strict=True)}
    named = sorted((int(k), set(s.tolist())) for k, s in zip(c, sets, strict=True))
    want = {(i, j) for i, s in named for j, t in named if i < j and 100 * len(s & t) >= 60 * len(s | t)}
    assert len(want) > 100 and want <= got
    size = {k: len(s) for k, s in named}
    assert all(i < j and min(size[i], size[j]) * 100 >= 60 * max(size[i], size[j]) for i, j in got)


def test_lines_meet_only_where_enough_words_are_left(spark):
    # two lines of ten words: similar ones share nine, so the first that they share is the first or second of either
    at = lambda place: spark.createDataFrame([(c, 10 << 32 | place, 0, 0, 1) for c in (1, 2)], "c long, np long, b1 long, b2 long, tok int")
    assert [lines._candidates(at(p), at(p), 80).count() for p in (0, 1, 2)] == [1, 1, 0]
    one = np.ones(2, np.int64)
    met = [sum(len(a) for a, *_ in lines._pairs({"tok": one, "n": 10 * one, "p": p * one, "c": np.arange(2), "b1": one, "b2": one}, 80)) for p in (0, 1, 2)]
    assert met == [1, 1, 0]


def test_lines_in_small_pieces_equal_brute_force(spark, monkeypatch):
    for name, few in (("RANGES", 1), ("INDEX_ROWS", 3), ("PAIR_ROWS", 5), ("SLICE_BYTES", 300)):
        monkeypatch.setattr(lines, name, few)
    r = random.Random(6)
    pool = [t for _, t in _corpus(11, 60) if t]
    rows = [(k, "\n".join(r.choice(pool) for _ in range(r.randrange(1, 6)))) for k in range(50)]
    gone = _brute_lines(rows)
    out = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {x["doc_id"]: x["n_removed"] for x in out.collect()} == {i: len(gone[i]) for i, _ in rows}


def _vector_rows(seed, n=600, dim=16):
    g = np.random.default_rng(seed)
    centres = g.normal(size=(40, dim))
    rows = []
    for k in range(n):
        v = centres[g.integers(40)] + g.normal(size=dim) * g.choice([0.0, 0.1, 0.3, 2.0])
        rows.append((k, [float(x) for x in v.astype(np.float32)]))
    return rows


def test_vectors_recall_and_precision(spark):
    rows = _vector_rows(0)
    odd = [(9001, None), (9002, []), (9003, [0.0] * 16), (9004, [float("nan")] * 16), (9005, [None] + [1.0] * 15), (9006, [float("inf")] * 16), (9007, [1.0] * 3)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in vectors.near_duplicates(df).collect()}
    assert len(got) == len(rows) + len(odd)
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i, _ in odd)
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.9
    np.fill_diagonal(link, False)
    found = np.array([got[i]["n_links"] for i, _ in rows])
    assert (found <= link.sum(1)).all() and found.sum() >= 0.9 * link.sum()


def test_vectors_of_several_dimensions(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 0.1]), (4, [1.0, 2.0, 3.0]), (5, [1.0, 2.0, 3.0]), (6, [2.0, 4.0, 6.1]), (7, [9.0]), (8, [4.0, 1.0, 1.0, 1.0])]
    rows += [(100 + k, list(v)) for k, v in enumerate(np.random.default_rng(2).normal(size=(60, 5)).tolist())]
    for kind in ("float", "double"):
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")).collect()}
        assert [got[k] for k in range(1, 9)] == [(1, 1), (0, 2), (1, 1), (2, 4), (2, 4), (2, 4), (0, 7), (0, 8)]
        x = np.array([v for k, v in rows if k >= 100])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        assert sum(got[k][0] for k, _ in rows if k >= 100) == (x @ x.T >= 0.9).sum() - 60


def test_split_lists_find_the_same_links(spark, monkeypatch):
    df = spark.createDataFrame(_vector_rows(4, 300), "vec_id long, embedding array<float>")
    whole = sorted(map(tuple, vectors.near_duplicates(df).collect()))
    monkeypatch.setattr(vectors, "SPLIT", 3)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    assert sorted(map(tuple, vectors.near_duplicates(df).collect())) == whole


def test_vectors_copies_and_long_lists(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 8)
    rows = [(k, [1.0, k % 30 / 1000, 0.0]) for k in range(90)] + [(100 + k, [0.0, 0.0, float(k + 1)]) for k in range(5)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(got[k] == (89, 0) for k in range(90)) and all(got[100 + k] == (4, 100) for k in range(5))
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>, v string")).count() == 0
    df = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<double>").withColumn("rep", F.lit(1))
    assert sorted((r["vec_id"] or -1, r["kept"]) for r in vectors.near_duplicates(df).collect()) == [(-1, False), (1, True)]
