"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Hashable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitspark.llm._io import table
from pitspark.llm._rows import occurrences

CAPACITY, MAX_PER_SOURCE, GROUP_PIECES = 4096, 8, 16_384


def best_fit(pieces: Sequence[tuple[int, Hashable, Hashable]], capacity: int = CAPACITY, max_per_source: int = MAX_PER_SOURCE) -> list[int]:
    """The bin of each piece (length, source, cluster), longest first. Of the bins with room it is the one
    that the piece fills best, so long as it holds no piece of the same cluster and fewer than
    ``max_per_source`` of the same source; None as source or cluster conflicts with nothing.

    Open bins stand ordered by residual. The search starts at the first residual that suffices and goes
    on from successor to successor until a bin's bitmaps are compatible: one of clusters, and one of
    sources with ``max_per_source`` bits for each source, filled from the lowest."""
    copies, sources = Counter(c for _, _, c in pieces), Counter(s for _, s, _ in pieces)
    # only what occurs twice can conflict and needs bits
    cluster_bit = {c: 1 << k for k, c in enumerate(c for c, n in copies.items() if n > 1 and c is not None)}
    source_at = {s: k * max_per_source for k, s in enumerate(s for s, n in sources.items() if n > max_per_source and s is not None)}
    where = [-1] * len(pieces)
    open_bins: list[tuple[int, int]] = []
    clusters: list[int] = []
    held: list[int] = []
    for i in sorted(range(len(pieces)), key=lambda i: (-pieces[i][0], i)):
        length, source, cluster = pieces[i]
        bit = cluster_bit.get(cluster, 0)
        base = source_at.get(source)
        full = 1 << (base + max_per_source - 1) if base is not None else 0
        at = bisect_left(open_bins, (length, -1))
        while at < len(open_bins) and (clusters[open_bins[at][1]] & bit or held[open_bins[at][1]] & full):
            at += 1
        if at < len(open_bins):
            left, b = open_bins.pop(at)
        else:
            left, b = capacity, len(clusters)
            clusters.append(0)
            held.append(0)
        clusters[b] |= bit
        if base is not None:
            mask = (1 << max_per_source) - 1
            held[b] |= ((((held[b] >> base) & mask) << 1 | 1) & mask) << base
        where[i] = b
        if left > length:
            insort(open_bins, (left - length, b))
    return where


def n_words(text: Column) -> Column:
    """Words between white space."""
    return F.size(F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), " \t\n\x0b\x0c\r", " " * 6), " ", -1), "")).cast("long")


def pack(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    source: str | None = "source",
    cluster: str | None = None,
    length: str | None = None,
    capacity: int = CAPACITY,
    max_per_source: int = MAX_PER_SOURCE,
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """One row per piece of a document: its key, ``piece`` (0, 1, ...), ``start`` and ``length`` in words,
    ``bin`` (string) and ``place`` in the bin.

    A document longer than ``capacity`` is cut into pieces of that length and a rest. Lengths are words of
    the text unless ``length`` names a column. Duplicate clusters are those of the column
    ``cluster``, else of equal texts (case and white space aside); pieces of one document always are one cluster.

    Pieces scatter by a hash of their content, key and (of equal rows) number over groups of about ``group_pieces``, each packed
    in one task's memory; at most the last bins of a group stay ill filled. The same rows give the same bins, however
    files and partitions hold them. A document without words is a piece of length 0. Rows with a null key, equal
    rows and repeated keys are packed like others; a null source conflicts with nothing; an empty table
    gives none. Other columns are left out. Lengths and clusters are computed once, into a table without texts."""
    kind = docs.schema[key].dataType.simpleString()
    words = F.col(f"`{length}`").cast("long") if length else n_words(F.col(f"`{text}`"))
    told = F.col(f"`{cluster}`").cast("string") if cluster else F.md5(F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))), r"[\x20\x09-\x0D]+", " ")))
    rows = docs.select(
        F.col(f"`{key}`").alias("key"), F.greatest(F.coalesce(words, F.lit(0)), F.lit(0)).alias("words"), (F.col(f"`{source}`").cast("string") if source else F.lit(None).cast("string")).alias("source"), told.alias("cluster")
    )
    rows = table(rows.select("*", F.monotonically_increasing_id().alias("place"), F.xxhash64("key", "words", "source", "cluster").alias("h")), "packing")
    last = F.greatest(F.floor((F.col("words") - 1) / capacity), F.lit(0)).cast("int")
    groups = max(1, -(-(rows.agg(F.sum(last.cast("long") + 1)).first()[0] or 0) // group_pieces))
    copies = occurrences(rows.select("place", "h")).where("copy > 1").select("place", "copy")
    pieces = rows.join(copies, "place", "left").select("*", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    by = F.pmod(F.xxhash64("h", "piece", F.coalesce("copy", F.lit(1))), F.lit(groups)).cast("int")
    start = F.col("piece").cast("long") * capacity
    pieces = pieces.select("key", "piece", "source", "cluster", start.alias("start"), F.least(F.lit(capacity).cast("long"), F.col("words") - start).alias("length"), by.alias("group"))
    schema = f"`{key}` {kind}, piece int, start long, length long, bin string, place int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(group: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts).combine_chunks()
            cols = [t.column(c).to_pylist() for c in ("length", "source", "cluster")]
            bins = best_fit(list(zip(*cols, strict=True)), capacity, max_per_source)
            seen: Counter[int] = Counter()
            place = []
            for b in bins:
                place.append(seen[b])
                seen[b] += 1
            arrays = [t.column(c).combine_chunks() for c in ("key", "piece", "start", "length")]
            return pa.RecordBatch.from_arrays([*(a.chunk(0) if isinstance(a, pa.ChunkedArray) else a for a in arrays), pa.array([f"{group}-{b}" for b in bins], pa.string()), pa.array(place, pa.int32())], names=[key, "piece", "start", "length", "bin", "place"])

        parts: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            group = batch.column("group").to_numpy()
            at = 0
            while at < len(group):
                end = at + int((group[at:] == group[at]).sum())
                if parts and group[at] != now:
                    yield flush(now, parts)
                    parts = []
                now = int(group[at])
                parts.append(batch.slice(at, end - at))
                at = end
        if parts:
            yield flush(now, parts)

    order = ("group", "length", "key", "piece", "source", "cluster")
    return pieces.repartition("group").sortWithinPartitions(*order).mapInArrow(run, schema)
