"""Embedding near-dedup by a pivot-permutation index.

A vector is described by its nearest pivots in order (the prefix of its permutation of all pivots). It is filed in the
inverted list of each, and asks with the first ASKED of them: two vectors meet in the list of a pivot that both
are filed under and one asks with, and are candidates if they share two pivots or more. Long lists are
split by the second shared pivot. Candidates are verified by their cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitspark.llm._graph import components
from pitspark.llm._io import cut, grows, remove, table

#: Pivots are a sample of the vectors: about this many times the square root of their number, at most MAX_PIVOTS a dimension.
PIVOT_FACTOR, MIN_PIVOTS, MAX_PIVOTS = 4, 16, 32_768
#: No two pivots are this close, so that a large group of near copies has one pivot and not all of a vector's nearest.
PIVOT_SPREAD = 0.8
#: Nearest pivots that describe a vector, those of them that it asks with, and shared ones that make a candidate.
NEAREST, ASKED, SHARED = 8, 5, 2
#: Longer lists are split into lists of two pivots.
SPLIT = 8192
#: Vectors that a block of a list holds; the blocks of a longer list are compared two by two in tasks of their own.
BLOCK = 1024


def _unit(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """Unit vectors of rows of one dimension."""
    values = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
    # scaled first, so that squares neither overflow nor vanish
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def _spread(x: np.ndarray) -> np.ndarray:
    """Those rows that are not close to an earlier one of them."""
    kept = np.empty_like(x)
    n = 0
    for v in x:
        if n == 0 or (kept[:n] @ v).max() < PIVOT_SPREAD:
            kept[n] = v
            n += 1
    return kept[:n]


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Those of the edges that join trees."""
    parent = list(range(n))
    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = x, y
        while parent[p] != p:
            parent[p] = p = parent[parent[p]]
        while parent[q] != q:
            parent[q] = q = parent[parent[q]]
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _similar(x: np.ndarray, left: np.ndarray, right: np.ndarray, asks: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a left and a right vector, one of which asks, with a cosine of the threshold or more."""
    found = []
    for some, others in ((left[asks[left]], right), (left[~asks[left]], right[asks[right]])):
        i, j = np.nonzero(x[some] @ x[others].T >= threshold - 1e-12)
        found.append((some[i], others[j]))
    i, j = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    exact = (x[i] * x[j]).sum(axis=1) >= threshold
    return i[exact], j[exact]


def _of_list(near: np.ndarray, i: np.ndarray, j: np.ndarray, p: int, q: int) -> np.ndarray:
    """Which pairs are candidates of this list: they share pivots enough, p is the smallest that they meet under, and q (if the
    list is split) the smallest besides. near: the pivots of each vector, nearest first."""
    k = near.shape[1]
    rank = np.arange(k)
    asked = np.minimum(rank[:, None], rank[None, :]) < ASKED
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 17):
        a, b = near[i[at : at + (1 << 17)]], near[j[at : at + (1 << 17)]]
        same = a[:, :, None] == b[:, None, :]
        shared, met = same.any(axis=2), (same & asked).any(axis=2)
        high = np.iinfo(near.dtype).max
        ok = (shared.sum(axis=1) >= min(SHARED, k)) & (np.where(met, a, high).min(axis=1) == p)
        if q >= 0:
            ok &= np.where(shared & (a != p), a, high).min(axis=1) == q
        out[at : at + (1 << 17)] = ok
    return out


def near_duplicates(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """One row per row of ``vectors``: its key, ``n_links`` (other rows linked directly), ``component_id``
    (smallest key that links reach) and ``kept`` (key = component_id). Rows link at a cosine of ``threshold`` or more.

    A vector that is null, empty or zero, or holds a null or non-finite component, links with nothing. Vectors of
    different dimensions never link; each dimension has pivots and lists of its own. Equal vectors are one class at
    once. Rows with a null key link with nothing and come back with a null component, not kept. Keys are taken to be
    unique; of repeated ones each row counts. An empty table gives none. Other columns are left out.

    Pivots are fitted on a bounded sample; every row is indexed. A list's linked pairs are counted where
    they are found, and only a spanning forest of each list leaves its task."""
    rows = vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").alias("v"))
    if rows.schema["v"].dataType.simpleString() != "array<float>":
        rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    rows = rows.withColumn("ok", F.coalesce(F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False)))
    kind, array = (rows.schema[c].dataType.simpleString() for c in ("id", "v"))
    classes = table(rows.where("ok").groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "vector-classes")
    pivots, base = {}, 0
    for d, n in classes.groupBy(F.size("v")).count().where("count > 1").orderBy(F.size("v")).collect():
        m = min(n, MAX_PIVOTS, max(MIN_PIVOTS, int(PIVOT_FACTOR * n**0.5)))
        sample = classes.where(F.size("v") == d).select("v").orderBy(F.xxhash64("rep"), "rep").limit(m).toArrow()
        chosen = _spread(_unit(sample.combine_chunks().to_batches()[0], "v"))
        if len(chosen) == 1:
            # the second nearest of one is its opposite
            chosen = np.concatenate([chosen, -chosen])
        pivots[d] = base, chosen
        base += len(chosen)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = pa.compute.list_value_length(batch.column("v")).to_numpy()
            for d in np.unique(dims).tolist():
                if d not in pivots:
                    continue
                first, points = pivots[d]
                k = min(NEAREST, len(points))
                mine = batch.filter(pa.array(dims == d))
                for at in range(0, mine.num_rows, 1024):
                    part = mine.slice(at, 1024)
                    sims = _unit(part, "v") @ points.T
                    best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                    order = np.lexsort((best, -np.take_along_axis(sims, best, 1)), axis=1)
                    near = (np.take_along_axis(best, order, 1) + first).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(near), pa.list_(pa.int32()))], names=["v", "rep", "copies", "near"])

    described = table(classes.mapInArrow(describe, f"v {array}, rep {kind}, copies long, near array<int>"), "vector-permutations")

    # lists of two vectors or more; pivots are bounded, so their counts can be broadcast
    lists = described.select("rep", "near", F.explode("near").alias("p"))
    counts = lists.groupBy("p").count().where("count > 1")
    second = F.when(F.col("count") > SPLIT, F.array_remove("near", F.col("p"))).otherwise(F.array(F.lit(-1)))
    lists = lists.join(F.broadcast(counts), "p").select("p", F.explode(second).alias("q"), "rep")
    sizes = lists.groupBy("p", "q").count().where("count > 1").select("p", "q", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    lists = lists.join(sizes, ["p", "q"]).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    tiles = lists.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")).select("p", "q", "rep", "mine", F.least("mine", "o").alias("x"), F.greatest("mine", "o").alias("y"))
    tiles = tiles.join(grows(described), "rep").select("p", "q", "x", "y", "mine", "rep", "copies", "near", "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def flush() -> pa.RecordBatch:
            """Counts of links (a, n), and links of a forest (a, b)."""
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            x, ids, copies = _unit(t, "v"), t.column("rep"), t.column("copies").to_numpy()
            near = t.column("near").flatten().to_numpy().reshape(t.num_rows, -1)
            mine = t.column("mine").to_numpy()
            p, q, bx, by = now
            i, j = _similar(x, np.flatnonzero(mine == bx), np.flatnonzero(mine == by), (near[:, :ASKED] == p).any(axis=1), threshold)
            if bx == by:
                # both orders of a pair may have been met
                i, j = np.minimum(i, j), np.maximum(i, j)
                one = np.unique(i[i < j] * np.int64(len(x)) + j[i < j])
                i, j = one // len(x), one % len(x)
            ok = _of_list(near, i, j, p, q)
            i, j = i[ok], j[ok]
            found = np.bincount(i, copies[j], len(x)) + np.bincount(j, copies[i], len(x))
            some = np.flatnonzero(found)
            edges = _forest(len(x), i, j)
            a = np.array([*some, *(e[0] for e in edges)], np.int64)
            b = np.array([*some, *(e[1] for e in edges)], np.int64)
            return pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array([*found[some].astype(np.int64), *[0] * len(edges)], pa.int64())], names=["a", "b", "n"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("p", "q", "x", "y")], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            bounds = [0, *cuts.tolist(), batch.num_rows] if batch.num_rows else []
            for at, end in zip(bounds, bounds[1:], strict=False):
                mark = tuple(keys[at].tolist())
                if held and mark != now:
                    yield flush()
                    held = []
                now = mark
                held.append(batch.slice(at, end - at))
        if held:
            yield flush()

    order = ("p", "q", "x", "y")
    found = table(tiles.repartition(*order).sortWithinPartitions(*order).mapInArrow(compare, f"a {kind}, b {kind}, n long"), "vector-links")
    remove(described)
    links = found.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    comp = components(found.where("n = 0"))
    known = classes.join(links, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("id", "ok", F.when(F.col("ok"), F.col("v")).alias("v")).join(grows(known), "v", "left")
    component = F.coalesce("component_id", "id")
    out = cut(out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept")))
    for scratch in (classes, found):
        remove(scratch)
    return out
