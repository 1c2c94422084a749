"""MinHash near-dedup by a multi-index Hamming join.

A document's set of k-word shingles gives a signature of ``CHUNKS * WIDTH`` minima of BITS bits each. Two
signatures that differ in at most ``BOUND`` of these places (so also any two that differ in at most BOUND bits)
have, by the pigeonhole principle, a chunk of WIDTH places with at most ERRORS differences. Every chunk is
indexed under each way to leave out ERRORS of its places, so all such pairs share a key and none is lost.
Candidates are thinned only by sizes that exclude the similarity, and confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitspark.llm._graph import components
from pitspark.llm._io import cut, grows, remove, table
from pitspark.llm._text import _K1, _K2, list_array, mix, shingles, slices

#: At a similarity of 0.8 a chunk of 6 has at most one difference with probability 0.655, so that one
#: of 10 chunks does for all but 2.4e-5 of pairs; at 0.9 for all but 1e-9.
CHUNKS, WIDTH, ERRORS = 10, 6, 1
#: Of each minimum; five of them make a key of 80 bits, so unlike sets hardly meet by chance.
BITS = 16
#: Places (of CHUNKS * WIDTH) in which signatures may differ and are still sure to share a key.
BOUND = CHUNKS * (ERRORS + 1) - 1
#: Numbers of classes go up to this.
LAST = (1 << 55) - 1


def _variants() -> list[tuple[int, tuple[int, ...]]]:
    return [(c, keep) for c in range(CHUNKS) for keep in combinations(range(WIDTH), WIDTH - ERRORS)]


def _seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _K2) | np.uint64(1)


def _minima(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Signatures of non-empty sets: a row per place, BITS bits of the set's minimum under the place's hash function."""
    out = np.empty((CHUNKS * WIDTH, len(off) - 1), np.uint64)
    for i, seed in enumerate(_seeds(CHUNKS * WIDTH)):
        x = h * seed
        x ^= x >> np.uint64(32)
        out[i] = mix(np.minimum.reduceat(x, off[:-1]) + _K1)
    return out & np.uint64((1 << BITS) - 1)


def _keys(minima: np.ndarray) -> np.ndarray:
    """The index keys of signatures, a row per set: each chunk under each way to leave out ERRORS places."""
    keys = np.zeros((minima.shape[1], len(_variants())), np.uint64)
    for j, (c, keep) in enumerate(_variants()):
        acc = np.full(minima.shape[1], j + 1, np.uint64)
        for w in keep:
            acc = mix(acc * _K1 + minima[c * WIDTH + w])
        keys[:, j] = acc
    return keys


def signatures(docs: DataFrame, *, shingle: int) -> DataFrame:
    """doc, th, n_shingles, fp1 and fp2 (a fingerprint of the set), keys of the index. ``docs``: doc, th and text."""
    longs = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                h, off = shingles(part.column("text"), shingle)
                n = np.diff(off)
                full = np.flatnonzero(n)
                fp = np.zeros((len(n), 2), np.uint64)
                keys = np.zeros((0, len(_variants())), np.uint64)
                if len(full):
                    bounds = np.append(off[:-1][full], off[-1])
                    keys = _keys(_minima(h, bounds))
                    fp[full, 0] = np.add.reduceat(mix(h + _K1), bounds[:-1])
                    fp[full, 1] = np.add.reduceat(mix(h ^ _K2), bounds[:-1])
                at = np.zeros(len(n) + 1, np.int64)
                np.cumsum(np.where(n > 0, len(_variants()), 0), out=at[1:])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), part.column("th"), pa.array(n, pa.int64()), longs(fp[:, 0]), longs(fp[:, 1]), list_array(keys.reshape(-1).view(np.int64), at, pa.int64())],
                    names=["doc", "th", "n_shingles", "fp1", "fp2", "keys"],
                )

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc {kind}, th long, n_shingles long, fp1 long, fp2 long, keys array<long>")


def confirm(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b) whose full sets have ``100 * intersection >= percent * union``.
    ``texts`` (doc, text) holds one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "ta", 2 << 20):
                (x, xo), (y, yo) = shingles(part.column("ta"), shingle), shingles(part.column("tb"), shingle)
                nx, ny = np.diff(xo), np.diff(yo)
                ids = np.arange(part.num_rows)
                both = np.concatenate([x, y])
                row = np.concatenate([np.repeat(ids, nx), np.repeat(ids, ny)])
                order = np.lexsort((both, row))
                both, row = both[order], row[order]
                shared = np.bincount(row[1:][(both[1:] == both[:-1]) & (row[1:] == row[:-1])], minlength=part.num_rows)
                ok = (shared > 0) & (100 * shared >= percent * (nx + ny - shared))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(ok))

    kind = pairs.schema["a"].dataType.simpleString()
    full = pairs.join(grows(texts.select(F.col("doc").alias("a"), F.col("text").alias("ta"))), "a").join(grows(texts.select(F.col("doc").alias("b"), F.col("text").alias("tb"))), "b")
    return full.select("a", "b", "ta", "tb").mapInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: its key, ``n_shingles``, ``component_id`` (smallest key that links
    reach), ``kept`` (key = component_id) and ``text_hash`` (``xxhash64``, which tells rows of one key apart). Two documents link where their sets of distinct
    ``shingle``-word shingles (A-Z folded; with fewer words, the whole sequence) have a Jaccard
    similarity of ``percent`` or more.

    A null or empty text, or one of white space, has an empty set and links with nothing. Equal sets are
    one class at once, however many rows they have. Rows with a null key are compared with nothing
    and come back with a null component, not kept. Rows that repeat a key are documents of their own, each with its own
    text's component, and with equal texts are kept alike. Keys are of any ordered type. Other columns are left out;
    an empty table gives none.

    Classes of equal sets are found by a grouping and numbered in the order of their smallest keys; the classes share index
    keys. Under a key each member is first confirmed against the member with the most copies, and only members that
    remain apart are compared among each other, so a group of near copies costs a linear number of
    confirmations."""
    # a row's text is found again by its key and the text's hash
    plain = docs.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    sig = table(signatures(plain.select("doc", "th", "text"), shingle=shingle), "minhash")
    kinds = ["fp1", "fp2", "n_shingles"]
    classes = sig.where("n_shingles > 0 AND doc IS NOT NULL").groupBy(*kinds).agg(F.min(F.struct("doc", "th")).alias("rep"), F.count("*").alias("copies"), F.first("keys").alias("keys"))
    # numbers follow the smallest keys, so the smallest number that links reach is that of the smallest key
    classes = table(classes.orderBy("rep", *kinds).select(F.monotonically_increasing_id().alias("c"), "rep", *kinds, "copies", "keys"), "minhash-classes")

    if (classes.agg(F.max("c")).first()[0] or 0) > LAST:
        raise ValueError("too many partitions: the number of a class must fit 55 bits")

    # w: the bits of the number of copies above the number of the class, counted downwards, so that the greatest w of a key is its hub
    w = F.shiftleft(F.length(F.bin("copies")).cast("long"), LAST.bit_length()).bitwiseOR(F.lit(LAST) - F.col("c"))
    number = lambda c: F.lit(LAST) - F.col(c).bitwiseAND(LAST)
    # one exchange serves the grouping and the join; a group's keys lie in as many partitions as there are keys
    index = classes.select(w.alias("w"), F.col("n_shingles").alias("n"), F.explode("keys").alias("k")).repartition("k")
    hubs = index.groupBy("k").agg(F.count("*").alias("members"), F.max("w").alias("h")).where("members > 1").select("k", number("h").alias("hub"))
    index = cut(index.join(grows(hubs), "k").select("k", number("w").alias("c"), "n", "hub"))
    wanted = cut(index.select("c").distinct().join(classes.select("c", "rep.*"), "c"))
    texts = table(plain.join(grows(wanted), ["doc", "th"]).select(F.col("c").alias("doc"), "text").dropDuplicates(["doc"]), "minhash-texts")

    stars = index.where("c <> hub").select("c", "n", "hub").distinct().join(classes.select(F.col("c").alias("hub"), F.col("n_shingles").alias("hn")), "hub")
    stars = cut(stars.where(_sized("n", "hn", percent)).select(F.least("c", "hub").alias("a"), F.greatest("c", "hub").alias("b")).distinct())
    links = cut(confirm(stars, texts, shingle, percent))
    comp = cut(components(links))

    # under each key, members that are not in its hub's component against all members of other components
    placed = index.join(comp, index["c"] == comp["node"], "left").withColumn("g", F.coalesce("component", "c")).select("k", "c", "n", "g", "hub")
    apart = placed.groupBy("k").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.max(F.when(F.col("c") == F.col("hub"), F.col("g"))).alias("hg")).where("lo <> hi").select("k", "hg")
    rest = cut(placed.join(apart, "k"))
    x = rest.where("g <> hg").select("k", F.col("c").alias("x"), F.col("g").alias("gx"), F.col("n").alias("nx"))
    y = rest.select("k", F.col("c").alias("y"), F.col("g").alias("gy"), "hg", F.col("n").alias("ny"))
    more = x.join(y, "k").where("gx <> gy AND (x < y OR gy = hg)").where(_sized("nx", "ny", percent)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    more = more.join(stars, ["a", "b"], "left_anti")
    comp = components(links.union(confirm(more, texts, shingle, percent)))

    far = comp.where("node <> component").join(classes.select(F.col("c").alias("component"), F.col("rep.doc").alias("first")), "component").select(F.col("node").alias("c"), "first")
    whole = classes.select("c", *kinds, F.col("rep.doc").alias("own")).join(far, "c", "left").select(*kinds, F.coalesce("first", "own").alias("component_id"))
    whole = whole.select("n_shingles", F.col("fp1").alias("_1"), F.col("fp2").alias("_2"), "component_id")
    known = F.col("doc").isNotNull()
    out = sig.select("doc", "th", "n_shingles", F.when(known, F.col("fp1")).alias("_1"), F.when(known, F.col("fp2")).alias("_2")).join(grows(whole), ["n_shingles", "_1", "_2"], "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc"))
    out = cut(out.select(F.col("doc").alias(key), "n_shingles", "component_id", F.coalesce(F.col("doc") == F.col("component_id"), F.lit(False)).alias("kept"), F.col("th").alias("text_hash")))
    for scratch in (texts, sig, classes):
        remove(scratch)
    return out


def _sized(a: str, b: str, percent: int) -> Column:
    """Sets of these sizes can be similar: the smaller is at least that share of the larger."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent
