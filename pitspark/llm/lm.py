"""Stupid-backoff language-model scores from n-gram counts of the whole corpus.

The relation of distinct n-grams is exploded block by block, where a block is a few MB of text, and each
block's sorted hashes travel in one compressed row per hash partition. A partition holds the count table
of its n-grams, joins the blocks' rows to it and answers with totals; a block's totals meet its texts
again and are summed per document.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitspark.llm._text import _K1, buffers, mix, planes, slices, unplanes, word_spans, words

ORDER, BACKOFF = 3, 0.4
#: Count that stands for a word that no other document holds.
UNSEEN = 0.5
BLOCK_BYTES, PARTITION_BYTES = 6 << 20, 24 << 20


def _grams(h: np.ndarray, rows: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For n = 1 to order the hash of the n words that end at each word, and each word's place in its document."""
    place = np.arange(len(h)) - np.repeat(rows[:-1], np.diff(rows))
    out = [mix(h + _K1)]
    for _ in range(1, order):
        before = np.zeros_like(h)
        before[1:] = out[-1][:-1]
        out.append(mix(before * _K1 + h))
    return out, place


def _bounds(sorted_hashes: np.ndarray, parts: int) -> np.ndarray:
    """Where each of ``parts`` equal ranges of hashes begins, and the end."""
    edges = np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_hashes, edges), [len(sorted_hashes)]])


def _body(part: pa.RecordBatch) -> bytes:
    """A block's keys and texts."""
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=9))) as out:
        out.write_batch(part)
    return sink.getvalue()


def _block_id(part: pa.RecordBatch) -> int:
    """Follows from the keys and texts. Blocks of equal content share an id and their answers."""
    digest = hashlib.blake2b(repr(part.column("key").to_pylist()).encode(), digest_size=8)
    for x in buffers(part.column("text")):
        digest.update(np.ascontiguousarray(x))
    return int.from_bytes(digest.digest(), "little", signed=True)


def _totals(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of counts of equal ids, at every row."""
    found, at = np.unique(ids, return_inverse=True)
    return np.bincount(at, counts, len(found)).astype(np.int64)[at]


def _log_scores(part: pa.RecordBatch, totals: list[np.ndarray], corpus_words: int, order: int, backoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Words and summed log scores of the documents of a block. totals: of the block's sorted distinct n-grams."""
    h, rows = words(part.column("text"))
    grams, place = _grams(h, rows, order)
    size = np.diff(rows)
    doc = np.repeat(np.arange(part.num_rows), size)
    others = []
    for n, g in enumerate(grams, 1):
        has = np.flatnonzero(place >= n - 1)
        found, at = np.unique(g[has], return_inverse=True)
        # what the document itself holds is taken off
        pairs, where, own = np.unique(doc[has] * np.int64(max(1, len(found))) + at, return_inverse=True, return_counts=True)
        rest = np.zeros(len(h), np.int64)
        rest[has] = totals[n - 1][at] - own[where]
        others.append(rest)
    left = np.maximum(corpus_words - size, 1)[doc]
    log = np.log(np.maximum(others[0], UNSEEN) / left)
    for n in range(2, order + 1):
        context = np.zeros(len(h), np.int64)
        context[1:] = others[n - 2][:-1]
        seen = (place >= n - 1) & (others[n - 1] > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            log = np.where(seen, np.log(others[n - 1] / context), log + np.where(place >= n - 1, np.log(backoff), 0.0))
    out = np.zeros(part.num_rows)
    some = np.flatnonzero(size)
    if len(some):
        out[some] = np.add.reduceat(log, rows[:-1][some])
    return size, out


def score(docs: DataFrame, *, key: str = "doc_id", text: str = "text", order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """Key, ``n_words``, ``log_score`` (sum of natural logs) and ``log_score_per_word`` (null without words) of every row.

    A word's score is that of stupid backoff with the counts of all other rows: count(u v w) / count(u v) if the
    n-gram occurs elsewhere, else ``backoff`` times the score with one word less of context; at the end
    count(w) / words, with a count of 0.5 for a word that occurs nowhere else. The first words of a
    document have the context that there is. Words are those between ASCII white space, A-Z folded.

    A null or empty text has no words and scores 0; equal rows are separate documents; an empty table gives
    none; other columns are left out. ``docs`` is read three times and must be the same each time, as a
    stored table is; if blocks differ between reads, the job fails."""
    kind = docs.schema[key].dataType.simpleString()
    plain = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    parts = max(1, -(-(plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PARTITION_BYTES))
    schema = "block long, n int, part int, body binary, counts binary"

    def rows_of(found: list[tuple]) -> pa.RecordBatch:
        cols = zip(*found, strict=True) if found else [[]] * 5
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=["block", "n", "part", "body", "counts"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                yield rows_of([(_block_id(part), 0, -1, _body(part), b"")])

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                block = _block_id(part)
                h, rows = words(part.column("text"))
                grams, place = _grams(h, rows, order)
                for n, g in enumerate(grams, 1):
                    ids, counts = np.unique(g[place >= n - 1], return_counts=True)
                    cut = _bounds(ids, parts)
                    found = []
                    for p in np.flatnonzero(np.diff(cut)).tolist():
                        x = ids[cut[p] : cut[p + 1]]
                        found.append((block, n, p, planes(np.diff(x, prepend=np.uint64(0))), planes(counts[cut[p] : cut[p + 1]].astype(np.uint32))))
                    yield rows_of(found)

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(mark: tuple[int, int], held: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            sizes = np.cumsum([0] + [len(x) for _, x, _ in held])
            total = _totals(np.concatenate([x for _, x, _ in held]), np.concatenate([c for _, _, c in held]))
            return rows_of([(b, *mark, b"", planes(total[sizes[k] : sizes[k + 1]])) for k, (b, _, _) in enumerate(held)])

        now, held = None, []
        for batch in batches:
            for block, n, p, body, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (n, p) != now:
                    yield flush(now, held)
                    held = []
                now = n, p
                held.append((block, np.cumsum(unplanes(body, np.uint64), dtype=np.uint64), unplanes(counts, np.uint32)))
        if held:
            yield flush(now, held)

    asked = plain.mapInArrow(asks, schema)
    answered = asked.repartition("n", "part").sortWithinPartitions("n", "part").mapInArrow(answers, schema)
    # all words: the counts of 1-grams, from the texts' own count
    corpus_words = int(plain.mapInArrow(_count_words, "n long").agg(F.sum("n")).first()[0] or 0)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, got = None, {}
        for batch in batches:
            for block, n, p, body, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != now:
                    now, got = block, {}
                if p >= 0:
                    got[n, p] = unplanes(counts, np.int64)
                    continue
                part = pa.ipc.open_stream(body).read_all().combine_chunks().to_batches()
                if not part:
                    continue
                totals = [np.concatenate([np.zeros(0, np.int64), *(got[k] for k in sorted(got) if k[0] == m)]) for m in range(1, order + 1)]
                size, log = _log_scores(part[0], totals, corpus_words, order, backoff)
                per = pa.array(np.divide(log, size, out=np.zeros_like(log), where=size > 0), mask=size == 0)
                yield pa.RecordBatch.from_arrays([part[0].column("key"), pa.array(size), pa.array(log), per], names=[key, "n_words", "log_score", "log_score_per_word"])

    # a block's answers come before its texts
    both = answered.unionByName(plain.mapInArrow(blocks, schema)).withColumn("last", F.col("part") < 0)
    return both.repartition("block").sortWithinPartitions("block", "last", "n", "part").drop("last").mapInArrow(finish, f"`{key}` {kind}, n_words long, log_score double, log_score_per_word double")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = 0
    for batch in batches:
        for part in slices(batch, "text"):
            n += len(word_spans(*buffers(part.column("text")))[0])
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])
