"""The pipeline's stages on the smallest tables, each against brute force on its own input."""

import collections
import os
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pitspark.llm import packing, quality, queries, toxicity
from tests.llm import test_dedup, test_text

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def _texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def _passes(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    chars, lines = sum(map(len, w)), [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    if len(w) < 50 or 2 * test_text._repeats(text) > len(w):
        return False
    stops = sum(x.lower() in quality.STOP_WORDS for x in w)
    return (
        2 <= chars / len(w) <= 14 and sum(text.count(c) for c in quality.SYMBOLS) / len(w) <= 0.2 and stops / len(w) >= 0.06
        and sum("A" <= c <= "Z" for c in text) / chars <= 0.5 and (len(lines) - len(set(lines))) / len(lines) <= 0.5
    )


def test_stages(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "line_dedup", "minhash_near_dedup", "best_fit_packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    results = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        results.append((docs, out := spark.read.parquet(str(tmp_path / str(k)))))
        docs = out
        if k < 4:
            assert out.columns == list(corpus_pipeline.COLUMNS) and dict(out.dtypes) == dict(results[0][0].dtypes)
    (a, b), (_, c), (_, d), (_, e), (_, f) = results
    assert set(_texts(b)) == {i for i, t in _texts(a).items() if _passes(t or "")}

    lexicon = toxicity.fit(b, labels)
    automaton = lexicon.automaton()
    assert set(_texts(c)) == {i for i, t in _texts(b).items() if toxicity.density(toxicity.fold(t or ""), automaton) < lexicon.threshold}

    gone = test_dedup._brute_lines(_texts(c).items())
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in _texts(c).items()}
    assert _texts(d) == {i: t for i, t in want.items() if t.strip() or not gone[i]}
    assert d.where(F.length("text") != F.col("n_chars")).count() == 0

    sets = {i: test_dedup._shingles(t, 5) for i, t in _texts(d).items()}
    pairs = [(i, j) for i in sets for j in sets if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    comp = test_dedup._components(pairs, sets)
    assert set(_texts(e)) == {i for i in sets if comp[i] == i}

    rows, words = f.collect(), {i: len(test_dedup.WORD.findall(t)) for i, t in _texts(e).items()}
    held, fill = collections.Counter(), collections.Counter()
    for r in rows:
        held[r["doc_id"]] += r["length"]
        fill[r["bin"]] += r["length"]
    assert held == collections.Counter(words) and max(fill.values()) <= packing.CAPACITY


def test_queries_have_the_columns_of_their_contracts(spark):
    want = {
        "op1": {"vec_id", "n_links", "component_id", "kept"}, "op2": {"doc_id", "held_out", "score", "predicted"}, "op3": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
        "op6": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"}, "op8": {"doc_id", "n_shingles", "component_id", "kept"},
        "op9": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"}, "op10": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    }
    found = {k.split("_")[0]: f for k, f in queries.queries().items()}
    assert sorted(found, key=lambda k: int(k[2:])) == [f"op{k}" for k in range(1, 11)]
    for k, columns in want.items():
        df = found[k](spark, SF)
        assert columns <= set(df.columns), k
        assert df.count() > 0
