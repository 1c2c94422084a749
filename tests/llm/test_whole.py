"""The registered queries and stages leave out no part of their input."""

import hashlib
import random
import re

import corpus_pipeline
from pitspark.llm import chat, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _documents(spark, tmp_path, rows):
    df = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], DOCS)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return df


def _without_repeats(rows):
    """Text and number of removed lines by document, every line with a word compared."""
    seen, out = [], {}
    for i, text in sorted(rows):
        kept = []
        for line in text.split("\n"):
            s = set(re.findall(r"[^\x20\x09-\x0D]+", line.lower()))
            if not s or not any(100 * len(s & z) >= 80 * len(s | z) for z in seen):
                kept.append(line)
            if s:
                seen.append(s)
        out[i] = "\n".join(kept), len(text.split("\n")) - len(kept)
    return out


def test_short_lines_are_lines_too(spark, tmp_path):
    r = random.Random(4)
    vocabulary = [f"w{k}" for k in range(14)]
    pool = [" ".join(r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 4, 5, 6, 10]))) for _ in range(150)]
    rows = [(k, "\n".join(r.choice(pool) for _ in range(r.randrange(1, 8)))) for k in range(60)]
    rows += [(60, "a b c d\n\n \n" + "solo " * 40), (61, "d c b a e\nSolo"), (62, "p q r s t"), (63, "s r q p"), (64, "\n\n"), (65, "f g h"), (66, "f g h i")]
    df = _documents(spark, tmp_path, rows)
    want = _without_repeats(rows)
    assert want[61] == ("", 2) and want[63] == ("", 1) and want[64][1] == 0 and want[66][1] == 0
    got = {x["doc_id"]: (x["text_sha256"], x["n_removed"]) for x in queries.op4_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: (hashlib.sha256(t.encode()).hexdigest(), n) for i, (t, n) in want.items()}
    left = {x["doc_id"]: x["text"] for x in corpus_pipeline.repeated_lines(spark, df, str(tmp_path)).collect()}
    assert left == {i: t for i, (t, n) in want.items() if t.strip() or not n}


def test_near_copies_choose_rows(spark, tmp_path):
    text = "one two three four five six seven"
    rows = [(None, "no key at all in this row", "en", "x", 25), (None, text, "en", "x", 33), (1, text, "en", "x", 33), (1, text, "en", "w", 33), (2, text, "en", "x", 33), (3, None, "en", "x", None), (3, None, "en", "x", None), (4, "quite another text", None, "x", 18), (4, text, "en", "x", 33)]
    out = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, DOCS), str(tmp_path))
    assert out.columns == list(corpus_pipeline.COLUMNS)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([rows[0], rows[1], rows[3], rows[5], rows[7]], key=repr)


def test_passing_rewrites_of_long_prefixes_are_reported():
    def drops(turns):
        return chat.marked_turns(turns[1:] if len(turns) > 600 and turns[-1][0] == "user" else turns)

    turns = [("user" if k % 2 == 0 else "assistant", "x") for k in range(604)]
    assert chat.render(turns, drops).rewrites == [600, 601, 602, 603]
