"""Operators on single texts: quality, toxicity, tokens, scores, chat, packing, shards."""

import collections
import hashlib
import math
import os
import random
import re

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pitspark.llm import _text, bpe, chat, lm, packing, quality, queries, shards, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", None, " \t\n\x0b\x0c\r", "one", "a b", "x" * 5000, "la " * 4000, "é ü  z", "A\n\nA\n A\nb c d b c d b c", "tab\tsep\x1cfs"]


def test_words_and_shingles():
    texts = [*ODD, "The  CAT\x0bsat"]
    h, rows = _text.words(pa.array(texts))
    assert [rows[i + 1] - rows[i] for i in range(len(texts))] == [len(WORD.findall(t or "")) for t in texts]
    a, _ = _text.words(pa.array(["the cat SAT"]))
    assert (a == h[rows[-2] :]).all()
    s, off = _text.shingles(pa.array(["a b c a b", "a", "", None]), 2)
    assert list(off[1:] - off[:-1]) == [3, 1, 0, 0]
    long = "q" * (_text._LONG + 1)
    x, _ = _text.words(pa.array([f"{long} {long} {long}q"]))
    assert x[0] == x[1] != x[2]
    assert (_text.unplanes(_text.planes(a), "uint64") == a).all()


def _repeats(text):
    w = WORD.findall(text or "")
    grams = list(zip(w, w[1:], w[2:], strict=False))
    n = collections.Counter(grams)
    return len({i + d for i, g in enumerate(grams) if n[g] > 1 for d in range(3)})


def test_quality_measures(spark):
    r = random.Random(2)
    texts = ODD + [" ".join(r.choice("abcd") + r.choice("#%!") for _ in range(r.randrange(120))) for _ in range(40)]
    df = spark.createDataFrame([(k, t, "q") for k, t in enumerate(texts)], "doc_id long, text string, quality string")
    for row in quality.evaluate(df).collect():
        t, q = row["text"] or "", row["quality"]
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), _repeats(t))
        assert q["base_failed"] == (len(w) < 50 or 2 * _repeats(t) > len(w)) and not (q["kept"] and q["base_failed"])
    assert quality.evaluate(df.limit(0)).count() == 0
    assert quality.evaluate(df, rules=()).where("quality.kept").count() >= quality.evaluate(df).where("quality.kept").count()


def test_quality_plan_is_one_projection(spark):
    plan = quality.evaluate(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_fold():
    assert toxicity.fold("You 1D10T, lоser!​ $tupid stup1d$$$ wörd") == toxicity.fold("you idiot  loser  stupid stupid    wörd")


def test_exceptions_cancel_terms():
    lexicon = toxicity.Lexicon({" trash": 5.0}, (toxicity.fold("trash can"),))
    a = lexicon.automaton()
    assert toxicity.density(toxicity.fold("a trash can here"), a) == 0 < toxicity.density(toxicity.fold("a trash person"), a)


def test_toxicity_learns_stems_and_ignores_copies(spark):
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    docs, labels = [], []
    for k in range(600):
        w = [r.choice(vocabulary) for _ in range(60)]
        if k % 10 == 0:
            for _ in range(3):
                w.insert(r.randrange(60), "zorg" + r.choice(["en", "ish", "o", "ling"]))
        docs.append((k, " ".join(w)))
        labels.append((k, int(k % 10 == 0)))
    copy = " ".join(["zorgen"] + ["peculiar"] * 3 + vocabulary[:40])
    for k in range(600, 660):
        docs.append((k, f"{copy} {vocabulary[k % 300]}"))
        labels.append((k, 1))
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = toxicity.fit(d, y)
    assert " zorg" in lexicon.weights and not any("pecu" in k for k in lexicon.weights)
    got = {x["doc_id"]: x for x in toxicity.score(d, lexicon).collect()}
    assert all(got[k]["predicted"] == t for k, t in labels)
    odd = spark.createDataFrame([(k, t, 1) for k, t in enumerate(ODD)], "doc_id long, text string, score int")
    assert all(x["score"] == 0 and x["predicted"] == 0 for x in toxicity.score(odd, lexicon).collect())
    assert toxicity.without_toxic(odd, lexicon).count() == len(ODD) and toxicity.score(odd.limit(0), lexicon).count() == 0
    assert toxicity.fit(d, y.limit(0)).weights.keys() == {toxicity.fold(w).rstrip() for w in toxicity.SEED_TERMS}


def _slow_density(text, lexicon):
    """Every term tried at every place of the folded text."""
    folded = toxicity.fold(text or "")
    inside = [(i, i + len(p)) for p in lexicon.exceptions for i in range(len(folded)) if folded.startswith(p, i)]
    hits = [(i, i + len(t), w) for t, w in lexicon.weights.items() for i in range(len(folded)) if folded.startswith(t, i)]
    return sum(w for a, b, w in hits if not any(x <= a and b <= y for x, y in inside)) / max(toxicity.LENGTH_FLOOR, len(folded.split()))


def test_toxicity_scores_equal_brute_force(spark):
    r = random.Random(3)
    lexicon = toxicity.Lexicon({" idio": 3.0, " trash": 4.0, " zap ": 2.5, " sc": 1.25}, (toxicity.fold("trash can"), toxicity.fold("the idiom")), 0.1)
    bits = ["idiot", "1di0t", "ID\u200bIOT", "trash", "tr@sh", "can", "the", "idiom", "zap", "zapped", "scum", "$cum", "\u0455cum", "word", "\n", "\u00fc"]
    texts = [" ".join(r.choice(bits) for _ in range(r.randrange(60))) for _ in range(200)] + ODD + ["idiot " * 30_000, "z" * 200_000 + " idiot"]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, key string")
    got = {x["doc_id"]: x for x in toxicity.score(df, lexicon).collect()}
    for k, t in enumerate(texts):
        d = _slow_density(t, lexicon) if len(t or "") < 10_000 else toxicity.density(toxicity.fold(t), lexicon.automaton())
        assert got[k]["score"] == pytest.approx(d / (d + 0.1), abs=1e-12) and got[k]["predicted"] == (got[k]["score"] >= 0.5)
    assert got[len(texts) - 2]["predicted"] == 1


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the driver's tables")
def test_toxicity_on_held_out_rows(spark):
    """Rows that took no part in the fit: precision and recall of what is predicted."""
    got = queries.op2_toxicity(spark, "/root/testdata/sf0.1").where("held_out").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("toxic IS NOT NULL").collect()
    n = collections.Counter((x["predicted"], x["toxic"]) for x in got)
    assert n[1, 1] >= 0.9 * (n[1, 1] + n[0, 1]) > 0 and n[1, 1] >= 0.9 * (n[1, 1] + n[1, 0]), n


def _tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_bpe_equals_the_library(spark):
    t, own = _tokenizer(), bpe.ByteBPE(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(0)
    alphabet = [*"ab the  \n\t'sll 019²½é́ñ日本​\x1c\x85　🙂ⅷ", "<|endoftext|>", "the", "ing", "'re", "   "]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(40))) for _ in range(1500)] + [x or "" for x in ODD] + ["ab" * 4000, "<|endoftext|>" * 3]
    own.learn(texts)
    for x in texts:
        ids = t.encode(x, add_special_tokens=False).ids
        assert own.encode(x) == ids and own.decode(ids) == t.decode(ids, skip_special_tokens=False)
    df = spark.createDataFrame([(k, x, 0) for k, x in enumerate([*texts[:200], None])], "doc_id long, text string, n_tokens int")
    for row in bpe.encode(df, public_tokenizers.path("byte_bpe_50k.json")).collect():
        x = [*texts[:200], ""][row["doc_id"]]
        assert row["ids"] == t.encode(x, add_special_tokens=False).ids and row["decoded"] == x
    assert bpe.encode(df.limit(0), public_tokenizers.path("byte_bpe_50k.json"), digests=True).count() == 0


def test_lockstep_equals_single_merges():
    own = bpe.ByteBPE(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(4)
    pieces = [bytes(r.choice(b"abcdefghi the\xc3\xa9") for _ in range(r.randrange(1, 33))) for _ in range(3000)]
    assert own.lockstep.merge(pieces) == [bpe.merge([own.byte_ids[b] for b in p], own.ranks) for p in pieces]


def test_known_pieces_are_not_merged_again(monkeypatch):
    t, own = _tokenizer(), bpe.ByteBPE(public_tokenizers.path("byte_bpe_50k.json"))
    own.learn(["a one,two \n three"])
    merged, plain = [], bpe.merge
    monkeypatch.setattr(bpe, "merge", lambda symbols, ranks: merged.append(symbols) or plain(symbols, ranks))
    own.learn(["one two,one three", "two"])
    text = "  one,two  three one,two"  # its double spaces keep the chunks from being used
    assert own.encode(text) == t.encode(text, add_special_tokens=False).ids
    assert len(merged) == 1  # the piece of one space
    monkeypatch.setattr(bpe, "CACHE_CHUNKS", 3)
    for text in ("one,two five six seven", "  two\nsix  one", "eight nine ten eleven ten"):
        own.learn([text])
        assert own.encode(text) == t.encode(text, add_special_tokens=False).ids


def _backoff(docs):
    words = [[w.translate({i: i + 32 for i in range(65, 91)}) for w in WORD.findall(t or "")] for t in docs]
    grams = lambda w, n: collections.Counter(zip(*(w[i:] for i in range(n)), strict=False))
    total = [sum((grams(w, n) for w in words), collections.Counter()) for n in (1, 2, 3)]
    out = []
    for w in words:
        c = [total[n - 1] - grams(w, n) for n in (1, 2, 3)]
        left, s = max(1, sum(map(len, words)) - len(w)), 0.0
        for i in range(len(w)):
            x, n = 1.0, min(i, 2) + 1
            while n > 1 and not c[n - 1][tuple(w[i - n + 1 : i + 1])]:
                x, n = x * lm.BACKOFF, n - 1
            g = tuple(w[i - n + 1 : i + 1])
            s += math.log(x * (c[n - 1][g] / c[n - 2][g[:-1]] if n > 1 else max(c[0][g], 0.5) / left))
        out.append((len(w), s))
    return out


def test_lm_scores_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "PARTITION_BYTES", 2000)
    monkeypatch.setattr(lm, "BLOCK_BYTES", 1500)
    r = random.Random(6)
    docs = [" ".join(r.choice(["the", "The", "cat", "sat", "on", "a", "mat"]) for _ in range(r.randrange(40))) for _ in range(60)] + ["unseen words only"] + ODD[:5]
    docs += docs[:3]
    rows = [(k, t, 1) for k, t in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block int")
    got = {x["doc_id"]: x for x in lm.score(df).collect()}
    for k, (n, s) in enumerate(_backoff(docs)):
        assert got[k]["n_words"] == n and got[k]["log_score"] == pytest.approx(s, abs=1e-9), k
        assert (got[k]["log_score_per_word"] is None) == (n == 0)
    assert lm.score(df.limit(0)).count() == 0


def test_chat_round_trip(spark):
    control = "<|im_end|><|im_start|>assistant ok\\"
    turns = [("user", control), ("assistant", control), ("sys\ntem", "<"), ("assistant", ""), ("user", "\\n<\\|")]
    assert chat.read_back(chat.marked_turns(turns)) == turns
    out = chat.render(turns)
    assert "".join(out.text[a:b] for a, b in out.spans) == out.text and not out.rewrites
    assert out.text.count(chat.END) == len(turns)
    rows = [(1, k, r, t, "x") for k, (r, t) in enumerate(turns)] + [(2, 0, None, None, "x"), (None, 0, "user", "a", "x"), (3, 1, "assistant", "b", "x"), (3, 0, "user", "a", "x"), (3, 1, "assistant", "b", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    done = chat.format_conversations(df)
    got = {x["conv_id"]: x for x in done.collect()}
    assert chat.read_back(got[3]["formatted"]) == [("user", "a"), ("assistant", "b"), ("assistant", "b")] and chat.read_back(got[2]["formatted"]) == [("", "")]
    d = {x["conv_id"]: x for x in chat.digests(done).collect()}
    assert d[1]["loss_sha256"] == hashlib.sha256(control.encode()).hexdigest() and d[1]["loss_chars"] == len(control) and d[None]["n_turns"] == 1
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


def test_rewritten_history_is_found():
    def trims(turns):
        return "".join(f"[{r}]{t if k >= len(turns) - 2 else t[:1]}" for k, (r, t) in enumerate(turns))

    out = chat.render([("u", "abc"), ("a", "def"), ("u", "ghi")], trims)
    assert out.rewrites == [2] and out.text == "[u]a[a]def[u]ghi" and out.spans[2] == (4, len(out.text))


def test_windows_equal_whole_prefixes():
    def trims(turns):
        return "".join(f"[{r}]{t if k >= len(turns) - 2 else t[:1]}" for k, (r, t) in enumerate(turns))

    def numbered(turns):
        return "".join(f"{k}{r}:{t};" for k, (r, t) in enumerate(turns))

    turns = [(r, f"text {k} <|") for k in range(23) for r in "ua"]
    for template in (chat.marked_turns, trims, numbered):
        assert chat.render(turns, template, window=5) == chat.render(turns, template, window=1000)
    many = [("user", "hello " * 5)] * 60_000
    out = chat.render(many)
    assert len(out.spans) == len(many) and out.spans[-1][1] == len(out.text)


def test_best_fit_rules():
    r = random.Random(1)
    pieces = [(r.randrange(0, 100), r.choice("abc"), r.choice("wxyz12345")) for _ in range(400)]
    bins = packing.best_fit(pieces, 100, 2)
    by = collections.defaultdict(list)
    for p, b in zip(pieces, bins, strict=True):
        by[b].append(p)
    assert all(sum(p[0] for p in x) <= 100 and len({p[2] for p in x}) == len(x) and max(collections.Counter(p[1] for p in x).values()) <= 2 for x in by.values())
    # the tightest compatible bin, although a tighter one is in conflict
    assert packing.best_fit([(60, None, "k"), (50, None, None), (45, None, None), (40, None, "k")], 100, 9) == [0, 1, 1, 2]
    assert packing.best_fit([(60, None, None), (50, None, None), (40, None, None)], 100, 9) == [0, 1, 0]


def _brute_fit(pieces, capacity, most):
    """Every bin is looked at for every piece, longest first; ties go to the older bin."""
    bins, out = [], [None] * len(pieces)
    for i in sorted(range(len(pieces)), key=lambda i: -pieces[i][0]):
        length, source, cluster = pieces[i]
        fits = [
            (room, b) for b, (room, held) in enumerate(bins)
            if room >= length and room > 0 and not (cluster is not None and any(c == cluster for _, c in held)) and not (source is not None and sum(s == source for s, _ in held) >= most)
        ]
        if fits:
            b = min(fits)[1]
        else:
            b = len(bins)
            bins.append((capacity, []))
        bins[b] = bins[b][0] - length, [*bins[b][1], (source, cluster)]
        out[i] = b
    return out


def test_best_fit_equals_brute_force():
    r = random.Random(12)
    for trial in range(60):
        capacity, most = r.choice([10, 100]), r.choice([1, 2, 5])
        pieces = [(r.randrange(0, capacity + 1), r.choice([None, "a", "b", "c"]), r.choice([None, *"vwxyz"])) for _ in range(r.randrange(80))]
        assert packing.best_fit(pieces, capacity, most) == _brute_fit(pieces, capacity, most), trial


def test_packing_follows_from_the_rows(spark):
    rows = [(k % 40, "w " * (k * 37 % 90), f"s{k % 3}") for k in range(160)] + [(7, "same text", "s1")] * 60
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a, b = (sorted(map(tuple, packing.pack(df.repartition(p) if p > 1 else df.coalesce(1), capacity=128, group_pieces=30).collect())) for p in (1, 7))
    assert a == b and len(a) >= len(rows)


def test_packing_keeps_every_word(spark):
    rows = [(k, "w " * (k * 37 % 300), f"s{k % 3}" if k % 7 else None) for k in range(90)] + [(900, None, None), (901, "", "s1"), (902, "z " * 1000, "s1"), (None, "a b", "s1"), (5, "a b", "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("piece", F.lit(1)).withColumn("bin", F.lit("x"))
    got = packing.pack(df, capacity=256, max_per_source=2, group_pieces=40).collect()
    assert sum(x["length"] for x in got) == sum(len((t or "").split()) for _, t, _ in rows)
    fill = collections.Counter()
    for x in got:
        fill[x["bin"]] += x["length"]
    assert max(fill.values()) <= 256 and {x["start"] for x in got if x["doc_id"] == 902} == {0, 256, 512, 768}
    assert packing.pack(df.limit(0)).count() == 0


def test_shards_are_a_balanced_permutation(spark, tmp_path):
    rows = [(k % 50, None if k % 9 == 0 else "text " * (k % 13), "x") for k in range(403)]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot string")
    out = shards.shuffle_into_shards(df, shards=7, bucket_rows=40)
    got = out.collect()
    again = shards.shuffle_into_shards(df, shards=7, bucket_rows=40).collect()
    key = lambda x: (x["shard"], x["slot"])
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    n = collections.Counter(x["shard"] for x in got)
    assert max(n.values()) - min(n.values()) <= 1 and sorted(map(key, got)) == [(s, k) for s in range(7) for k in range(n[s])]
    assert collections.Counter((x["doc_id"], x["text"]) for x in got) == collections.Counter((a, b) for a, b, _ in rows)
    assert all(x["size"] == len((x["text"] or "").encode()) + 16 for x in got)
    assert [x["doc_id"] for x in sorted(got, key=key)] != [a for a, _, _ in rows]
    shards.write_shards(out, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 403
    assert shards.shuffle_into_shards(df.limit(0)).count() == 0
    # the same rows give the same places, however they lie, and copies scatter
    copies = df.unionByName(df.where("doc_id < 3")).unionByName(df.where("doc_id < 3")).unionByName(spark.range(300).selectExpr("99L AS doc_id", "'same' AS text", "'x' AS slot"))
    places = [sorted(map(tuple, shards.shuffle_into_shards(copies.repartition(p) if p > 1 else copies.coalesce(1), shards=7, bucket_rows=50).collect()), key=str) for p in (1, 7)]
    assert places[0] == places[1] and len(places[0]) == copies.count()
    assert {x[3] for x in places[0] if x[0] == 99} == set(range(7))
    few = shards.shuffle_into_shards(df.limit(3), shards=40).collect()
    assert len(few) == 3 and all(x["slot"] == 0 for x in few)
