"""Line dedup by an exact set-similarity join.

A line is the set of its words. Words are ordered by rarity, and a line is indexed under the words of its
prefix: two lines of Jaccard similarity t share a word of their prefixes of n - ceil(t n) + 1. Pairs that
share one pass a length filter, a positional filter and a bound from parity bitmaps (sets that differ in
d words differ in at most d bits), and are then verified on their full sets.

The index is exchanged as columns of numbers by ranges of words, a row per range and task, and each range is
joined in arrays: entries ordered by word and size, so that an entry meets only the sizes that its own allows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitspark.llm._io import cut, remove, table
from pitspark.llm._text import _K1, _K2, _LOWER, buffers, hash_spans, mix, planes, slices, unplanes, word_spans, words
from pitspark.llm.minhash import confirm

#: Words are counted in so many buckets by hash, in codes of one byte. Any order of words is exact; that of the
#: counts makes lists short. A bucket that counts one word in all holds none that two lines share.
RARITY_BUCKETS, RARITY_RANGES = 1 << 23, 512
#: Bits of the filter that picks the texts of candidate lines; fuller, it only lets more texts pass.
PICK_BITS = 1 << 24
#: Text that is in arrays at once.
SLICE_BYTES = 2 << 20
PERCENT, MIN_WORDS = 80, 1
#: A Hamming distance of parities stands above the number of a class in one long.
HAM_SHIFT = 55
#: Ranges of words to a shuffle partition, entries of the index that a task collects before it divides them by range,
#: and pairs that are in arrays at once. A task that joins holds one range's entries, 36 bytes each.
RANGES, INDEX_ROWS, PAIR_ROWS = 4, 1 << 20, 1 << 20
#: An entry of the index: word, size of the line, place of the word in it, class, parity.
ENTRY = {"tok": np.uint32, "n": np.int32, "p": np.int32, "c": np.int64, "b1": np.uint64, "b2": np.uint64}


def _codes(counts: np.ndarray) -> np.ndarray:
    """Counts up to 127 as they are, larger ones on a scale of logarithms."""
    with np.errstate(divide="ignore"):
        high = 128 + 8 * np.log2(counts / 128)
    return np.where(counts < 128, counts, np.minimum(255, high)).astype(np.uint8)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(41)).astype(np.int64)


def _rarity(docs: DataFrame) -> np.ndarray:
    """Of each bucket, how many words of all texts fall into it, as a code."""
    width = RARITY_BUCKETS // RARITY_RANGES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(RARITY_BUCKETS, np.uint32)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                h, _ = words(part.column("text"))
                np.add.at(total, _bucket(h), np.uint32(1))
        found = []
        for r in range(RARITY_RANGES):
            some = np.flatnonzero(total[r * width : (r + 1) * width])
            if len(some):
                found.append((r, planes(np.diff(some, prepend=0).astype(np.uint32)), planes(total[r * width + some])))
        cols = list(zip(*found, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["r", "at", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for r, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums.setdefault(r, np.zeros(width, np.int64))[np.cumsum(unplanes(at, np.uint32))] += unplanes(n, np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([_codes(x).tobytes() for x in sums.values()], pa.binary())], names=["r", "codes"])

    out = np.zeros(RARITY_BUCKETS, np.uint8)
    for row in docs.select("text").mapInArrow(run, "r int, at binary, n binary").repartition("r").mapInArrow(add, "r int, codes binary").collect():
        out[row["r"] * width : (row["r"] + 1) * width] = np.frombuffer(row["codes"], np.uint8)
    return out


def _line_sets(col: pa.Array, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word hashes ordered by line, code of rarity and hash, the line and code of each, and row and number of
    each line."""
    data, off = buffers(col)
    starts, lens, _ = word_spans(data, off)
    h = hash_spans(_LOWER[data], starts, lens)
    feeds = np.flatnonzero(data == 10)
    begin = np.concatenate([off[:-1], feeds + 1])
    row = np.concatenate([np.arange(len(off) - 1), np.searchsorted(off, feeds, "right") - 1])
    order = np.lexsort((begin, row))
    begin, row = begin[order], row[order]
    first = np.searchsorted(row, np.arange(len(off) - 1))
    number = np.arange(len(row)) - first[row]
    line = np.searchsorted(begin, starts, "right") - 1
    # line, code of rarity and half of the hash in one number; where that leaves words apart that are equal, all of the hash
    packed = (line.astype(np.uint64) << np.uint64(40)) | (rarity[_bucket(h)].astype(np.uint64) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
    order = np.argsort(packed)
    h, ordered = h[order], packed[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    if (~new[1:] & (h[1:] != h[:-1])).any():
        again = np.lexsort((h, ordered))
        h = h[again]
        new[1:] |= h[1:] != h[:-1]
    ordered = ordered[new]
    return h[new], (ordered >> np.uint64(40)).astype(np.int64), (ordered >> np.uint64(32)).astype(np.uint8), row, number


def _parity(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Two longs a set: every word turns over one of 128 bits."""
    bit = np.uint64(1) << (h & np.uint64(63))
    low = (h >> np.uint64(6) & np.uint64(1)) == 0
    return np.stack([np.bitwise_xor.reduceat(np.where(x, bit, np.uint64(0)), starts) for x in (low, ~low)])


def _prefix(n: np.ndarray, percent: int) -> np.ndarray:
    """Words of a line's prefix: any similar line has one of them in its own prefix."""
    return n - (percent * n + 99) // 100 + 1


def _packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A binary array of the values' bytes, divided at ``cuts``."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _sets(docs: DataFrame, kind: str, min_words: int, percent: int, rarity: np.ndarray) -> DataFrame:
    """key, h, row, line, n, fp1, fp2 (fingerprints of the set), b1, b2 (parity) of every line with a word, and z: the words of its
    prefix that occur more than once, the last of the prefix in four bytes each; none where only an equal set can match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                h, line, code, row, number = _line_sets(part.column("text"), rarity)
                n = np.bincount(line, minlength=len(row))
                full = np.flatnonzero(n)
                n = n[full]
                starts = np.cumsum(n) - n
                sums = [np.add.reduceat(mix(x), starts) if len(full) else np.zeros(0, np.uint64) for x in (h + _K1, h ^ _K2)]
                parity = _parity(h, starts) if len(full) else np.zeros((2, 0), np.uint64)
                own = np.repeat(np.arange(len(full)), n)
                size = _prefix(n, percent)
                place = np.arange(len(h)) - starts[own]
                # a set that not even one word more leaves similar is matched by equal sets only
                size[(percent * (n + 1) > 100 * n) | (n < min_words)] = 0
                prefix = (place < size[own]) & (code > 1)
                # words that occur once come first in the order, so those left are the last of the prefix and their places need no room
                cuts = np.append(0, np.cumsum(np.bincount(own[prefix], minlength=len(full))))
                at = pa.array(row[full])
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c).take(at) for c in ("key", "h", "row")), pa.array(number[full].astype(np.int32)), pa.array(n.astype(np.int32)),
                        pa.array(sums[0].view(np.int64)), pa.array((sums[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                        *(pa.array(p.view(np.int64)) for p in parity), _packed(h[prefix].astype(np.uint32), cuts),
                    ],
                    names=["key", "h", "row", "line", "n", "fp1", "fp2", "b1", "b2", "z"],
                )

    return docs.select("key", "h", "row", "text").mapInArrow(run, f"key {kind}, h long, row long, line int, n int, fp1 long, fp2 int, b1 long, b2 long, z binary")


def _bits(rows: DataFrame, slot: Column) -> np.ndarray:
    """A bitmap of fixed size of the slots (0 to PICK_BITS - 1) that occur."""
    bits = np.zeros(PICK_BITS // 64, np.uint64)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))
    got = rows.groupBy(F.shiftright(slot, 6).cast("int").alias("w")).agg(F.bit_or(one).alias("bits")).toArrow()
    bits[got.column("w").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return bits


def _picker(bits: np.ndarray, column: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lets rows pass whose slot's bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(column).to_numpy().astype(np.int64) & (PICK_BITS - 1)
            hit = bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)
            yield batch.filter(pa.array(hit > 0))

    return run


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc (number of the class) and text of the lines in ``wanted`` (doc, row, line). A filter of fixed size first drops most other rows."""
    bits = _bits(wanted, F.xxhash64("row").bitwiseAND(PICK_BITS - 1))
    found = docs.select("row", "text", F.xxhash64("row").bitwiseAND(PICK_BITS - 1).alias("slot")).mapInArrow(_picker(bits, "slot"), "row long, text string, slot long")
    every = found.select("row", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    return every.join(wanted, ["row", "line"]).select("doc", "text")


def _entries(batch: pa.RecordBatch, percent: int) -> dict[str, np.ndarray]:
    """The index's entries of the lines (c, n, b1, b2, z) of a batch."""
    data, off = buffers(batch.column("z"))
    k = np.diff(off) // 4
    own = np.repeat(np.arange(len(k)), k)
    n = batch.column("n").to_numpy().astype(np.int64)
    place = np.arange(len(own)) - np.repeat(np.cumsum(k) - _prefix(n, percent), k)
    sides = {x: batch.column(x).to_numpy().view(ENTRY[x])[own] for x in ("c", "b1", "b2")}
    return {"tok": data.view(np.uint32), "n": n[own].astype(np.int32), "p": place.astype(np.int32)} | sides


def _index(lines: DataFrame, percent: int) -> DataFrame:
    """r (range of words) and the entries of it as bytes, a column each, ordered by r within partitions that hold whole ranges."""
    ranges = RANGES * int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def divided(some: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        entries = {x: np.concatenate([e[x] for e in some]) for x in ENTRY}
        order = np.argsort(entries["tok"])
        r = (entries["tok"][order].astype(np.uint64) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)
        cuts = np.append(np.flatnonzero(np.diff(r, prepend=-1)), len(r))
        return pa.RecordBatch.from_arrays([pa.array(r[cuts[:-1]]), *(_packed(x[order], cuts) for x in entries.values())], names=["r", *ENTRY])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[dict[str, np.ndarray]] = []
        for batch in batches:
            some.append(_entries(batch, percent))
            if sum(len(e["tok"]) for e in some) >= INDEX_ROWS:
                yield divided(some)
                some = []
        if sum(len(e["tok"]) for e in some):
            yield divided(some)

    made = lines.select("c", "n", "b1", "b2", "z").mapInArrow(run, "r int, " + ", ".join(f"{x} binary" for x in ENTRY))
    return made.repartition("r").sortWithinPartitions("r")


def _pairs(entries: dict[str, np.ndarray], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """a, b and ham of the pairs of lines that ``entries`` make and the filters pass, repeated as they share words; a is earlier than b."""
    order = np.argsort(entries["tok"].astype(np.uint64) << np.uint64(32) | entries["n"].astype(np.uint64))
    tok, n, p, c, b1, b2 = (entries[x][order] for x in ENTRY)
    n = n.astype(np.int64)
    rest = n - p
    key = tok.astype(np.uint64) << np.uint64(32) | n.astype(np.uint64)
    # of the first word that similar lines share, the smaller has at least this many words from there on, as the larger has no fewer than it
    first = np.flatnonzero(rest * (100 + percent) >= 2 * percent * n)
    most = np.minimum(n[first] * 100 // percent, (1 << 32) - 1).astype(np.uint64)
    count = np.searchsorted(key, (key[first] & np.uint64(0xFFFFFFFF << 32)) | most, "right") - first - 1
    first, count = first[count > 0], count[count > 0]
    ends = np.cumsum(count)
    at = 0
    while at < len(first):
        done = ends[at] - count[at]
        to = max(at + 1, int(np.searchsorted(ends, done + PAIR_ROWS, "right")))
        x = np.repeat(first[at:to], count[at:to])
        y = x + 1 + np.arange(len(x)) - np.repeat(ends[at:to] - count[at:to] - done, count[at:to])
        at = to
        total = n[x] + n[y]
        near = (np.minimum(rest[x], rest[y]) * (100 + percent) >= total * percent) & (c[x] != c[y])
        x, y, total = x[near], y[near], total[near]
        ham = np.bitwise_count(b1[x] ^ b1[y]).astype(np.int64) + np.bitwise_count(b2[x] ^ b2[y])
        near = ham * (100 + percent) <= total * (100 - percent)
        x, y, ham = c[x[near]], c[y[near]], ham[near]
        yield np.minimum(x, y), np.maximum(x, y), ham


def _likeliest(index: DataFrame, percent: int) -> DataFrame:
    """b and m: of the earlier lines that are candidates for b in one range, the one of the least Hamming distance, which stands above it."""

    def least(b: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((m, b))
        b, m = b[order], m[order]
        new = np.flatnonzero(np.diff(b, prepend=-1))
        return b[new], m[new]

    def joined(some: dict[str, list[np.ndarray]]) -> pa.RecordBatch:
        best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for a, b, ham in _pairs({x: np.concatenate(v) for x, v in some.items()}, percent):
            best = least(np.append(best[0], b), np.append(best[1], ham << HAM_SHIFT | a))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in best], names=["b", "m"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, some = None, {}
        for batch in batches:
            r = batch.column("r").to_numpy()
            columns = {x: buffers(batch.column(x)) for x in ENTRY}
            cuts = np.append(np.flatnonzero(np.diff(r, prepend=-1)), len(r))
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if some and r[i] != last:
                    yield joined(some)
                    some = {}
                last = r[i]
                for x, (data, off) in columns.items():
                    # a copy, so that its address fits the type and the batch can go
                    some.setdefault(x, []).append(np.frombuffer(data[off[i] : off[j]].tobytes(), ENTRY[x]))
        if some:
            yield joined(some)

    return index.mapInArrow(run, "b long, m long").groupBy("b").agg(F.min("m").alias("m"))


def _candidates(x: DataFrame, y: DataFrame, percent: int) -> DataFrame:
    """a and b of pairs that share a prefix word and pass the filters; a is earlier than b."""
    n, p = ({s: f(F.col(f"{s}.np")) for s in "xy"} for f in (lambda c: F.shiftright(c, 32), lambda c: c.bitwiseAND(0xFFFFFFFF)))
    # the first word that similar lines share has all that they share from there on in either
    total, most = n["x"] + n["y"], F.least(n["x"] - p["x"], n["y"] - p["y"])
    ham = F.bit_count(F.col("x.b1").bitwiseXOR(F.col("y.b1"))) + F.bit_count(F.col("x.b2").bitwiseXOR(F.col("y.b2")))
    alike = (F.least(n["x"], n["y"]) * 100 >= F.greatest(n["x"], n["y"]) * percent) & (ham * (100 + percent) <= total * (100 - percent)) & (most * (100 + percent) >= total * percent)
    joined = x.alias("x").join(y.alias("y"), (F.col("x.tok") == F.col("y.tok")) & (F.col("x.c") < F.col("y.c")) & alike)
    return joined.select(F.col("x.c").alias("a"), F.col("y.c").alias("b"))


def removed_lines(rows: DataFrame, *, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """row and line (0-based) of every line that an earlier line matches (see ``dedup_lines``). ``rows``: row (unique), key, h and
    text; it is read several times and must be the same each time, as a written table is."""
    kind = rows.schema["key"].dataType.simpleString()
    plain = rows.where("key IS NOT NULL")
    rarity = _rarity(plain)
    every = table(_sets(plain, kind, min_words, percent, rarity), "line-sets")
    # lines of equal sets are one class, at the place of the first of them
    classes = every.groupBy("fp1", "fp2", "n").agg(F.min(F.struct("key", "h", "row", "line")).alias("at"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("b1", "b2", "z")))
    # numbers of classes follow their places, so that one number identifies and orders them
    classes = table(classes.orderBy("at").select(F.monotonically_increasing_id().alias("c"), "at.row", "at.line", "fp1", "fp2", "n", "copies", "b1", "b2", "z"), "line-classes")
    if (classes.agg(F.max("c")).first()[0] or 0) >> HAM_SHIFT:
        raise ValueError("too many partitions: the number of a class must fit 55 bits")
    again = classes.where("copies > 1").select("fp1", "fp2", "n", F.col("row").alias("_r"), F.col("line").alias("_l"))
    copies = cut(every.select("row", "line", "fp1", "fp2", "n").join(again, ["fp1", "fp2", "n"]).where("row <> _r OR line <> _l").select("row", "line"))
    remove(every)
    whole = classes.where("length(z) > 0").select("c", "n", "b1", "b2", "z")

    # first each line against its likeliest candidate only; a line that this removes needs no other
    likeliest = cut(_likeliest(_index(whole, percent), percent).select(F.col("m").bitwiseAND((1 << HAM_SHIFT) - 1).alias("a"), "b"))
    sides = lambda d: d.select(F.col("a").alias("doc")).union(d.select("b")).distinct()
    placed = lambda d: cut(sides(d).join(classes.select(F.col("c").alias("doc"), "row", "line"), "doc"))
    done = cut(confirm(likeliest, _texts(plain, placed(likeliest)), 1, percent).select("b"))
    left = cut(likeliest.join(done, "b", "left_anti"))
    more = cut(_with_words(whole.join(left.select(F.col("b").alias("c")), "c", "left_semi"), percent))
    size = _size_class(F.shiftright("np", 32), percent)
    sized = more.select("tok", F.explode(F.sequence(size - 1, size + 1)).alias("c"))
    near = _with_words(whole, percent, _bits(sized, _word_slot("tok", "c")))
    pairs = _candidates(near, more, percent).distinct()
    pairs = cut(pairs.join(left, ["a", "b"], "left_anti"))
    also = confirm(pairs, _texts(plain, placed(pairs)), 1, percent).select("b").distinct()
    out = cut(copies.union(done.union(also).select(F.col("b").alias("c")).join(classes.select("c", "row", "line"), "c").select("row", "line")))
    remove(classes)
    return out


def _size_class(n: Column, percent: int) -> Column:
    """Sizes of similar lines lie in one class or in neighbouring ones: a class spans a little more than their greatest ratio."""
    return F.floor(F.log(n.cast("double")) / F.lit(math.log(100 / percent + 1e-3))).cast("int")


def _word_slot(tok: str, size: str) -> Column:
    return (F.col(tok).cast("long") + F.col(size).cast("long") * 7_368_787).bitwiseAND(PICK_BITS - 1)


def _with_words(lines: DataFrame, percent: int, bits: np.ndarray | None = None) -> DataFrame:
    """A row per word of a prefix: class c, np (size above the word's place), parity and tok. With ``bits``, only words whose
    bit is set for the line's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = _entries(batch, percent)
            tok, n = e["tok"].view(np.int32), e["n"].astype(np.int64)
            if bits is not None:
                k = np.diff(buffers(batch.column("z"))[1]) // 4
                at = (tok.astype(np.int64) + np.repeat(batch.column("size_class").to_numpy().astype(np.int64), k) * 7_368_787) & (PICK_BITS - 1)
                hit = np.flatnonzero(bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1))
            else:
                hit = slice(None)
            sides = (e["c"][hit], n[hit] << 32 | e["p"][hit], e["b1"].view(np.int64)[hit], e["b2"].view(np.int64)[hit], tok[hit])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in sides], names=["c", "np", "b1", "b2", "tok"])

    return lines.select("c", "n", "b1", "b2", "z", _size_class(F.col("n"), percent).alias("size_class")).mapInArrow(run, "c long, np long, b1 long, b2 long, tok int")


def dedup_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``text`` less its removed lines, ``n_lines`` and ``n_removed``.

    Lines are parts between line feeds; a line's words are those between ASCII white space, A-Z folded. A
    line with a word is removed if an earlier line has a set of words with a Jaccard similarity of ``percent`` or more,
    whether or not that line is itself removed. Lines of fewer than ``min_words`` distinct words match equal
    sets only. Earlier: a smaller key, then (rows that repeat a key are documents of their own) a smaller hash
    of the text; of equal texts either; then a smaller number of the line.

    A null text stays null and has no lines; lines without words stay; rows with a null key keep all lines and remove none.
    Other columns pass through under any name (n_lines and n_removed are replaced); an empty table stays
    empty. Rows are numbered in a table that is written once; the number is their identity."""
    rest = docs.drop("n_lines", "n_removed")
    staged = table(rest.select(F.struct("*").alias("record"), F.monotonically_increasing_id().alias("row")), "line-rows")
    value = F.col(f"record.`{text}`").cast("string")
    gone = removed_lines(staged.select("row", F.col(f"record.`{key}`").alias("key"), F.xxhash64(value).alias("h"), value.alias("text")), percent=percent, min_words=min_words)
    out = staged.join(gone.groupBy("row").agg(F.collect_set("line").alias("gone")), "row", "left")
    parts = F.split(value, "\n", -1)
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("gone", i)), "\n")
    made = F.when(F.col("gone").isNull(), F.col(f"record.`{text}`")).otherwise(kept).alias(text)
    n_lines = F.when(value.isNull(), 0).otherwise(F.size(parts)).alias("n_lines")
    return out.select(*(made if c == text else F.col(f"record.`{c}`").alias(c) for c in rest.columns), n_lines, F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).alias("n_removed"))
