"""Byte-level BPE encoding and decoding; merges are found by a segment tree over adjacent pair ranks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pitspark.llm._text import slices

#: The split of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks whose encoding a worker remembers before it starts afresh, and the longest of them in characters.
CACHE_CHUNKS, CACHE_CHARS = 600_000, 64
_NONE = 1 << 62


def _byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def merge(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """``symbols`` after all merges. Leaf i of a segment tree of minima holds ``rank << 32 | i`` of the pair
    that starts at symbol i, so the root is the leftmost pair of the lowest rank; a merge changes three
    leaves, each at logarithmic cost."""
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        if hit := ranks.get((symbols[i], symbols[i + 1])):
            tree[size + i] = hit[0] << 32 | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    if tree[1] == _NONE:
        return symbols
    symbols = symbols[:]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (root := tree[1]) != _NONE:
        i = root & 0xFFFFFFFF
        j = after[i]
        symbols[i] = ranks[symbols[i], symbols[j]][1]
        symbols[j] = -1
        k = after[i] = after[j]
        changed = [(j, _NONE)] if j < size else []
        if k < n:
            before[k] = i
            hit = ranks.get((symbols[i], symbols[k]))
            changed.append((i, hit[0] << 32 | i if hit else _NONE))
        else:
            changed.append((i, _NONE))
        if (h := before[i]) >= 0:
            hit = ranks.get((symbols[h], symbols[i]))
            changed.append((h, hit[0] << 32 | h if hit else _NONE))
        for at, value in changed:
            at += size
            if tree[at] == value:
                continue
            tree[at] = value
            while at > 1:
                a, b = tree[at], tree[at ^ 1]
                at >>= 1
                low = a if a < b else b
                if tree[at] == low:
                    break
                tree[at] = low
    return [s for s in symbols if s >= 0]


class _Spans:
    """The byte strings of all tokens in one array, from which those of many ids are gathered at once."""

    def __init__(self, of: dict[int, bytes]):
        sizes = np.zeros(max(of, default=-1) + 1, np.int64)
        sizes[list(of)] = [len(b) for b in of.values()]
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes
        self.data = np.frombuffer(b"".join(of[i] for i in sorted(of)), np.uint8)

    def gather(self, ids: np.ndarray, off: np.ndarray) -> tuple[bytes, list[int]]:
        """The strings of ``ids`` joined, and the n+1 places in them where the groups that ``off`` bounds begin."""
        sizes = self.sizes[ids]
        ends = np.append(0, np.cumsum(sizes))
        at = np.repeat(self.starts[ids] - ends[:-1], sizes) + np.arange(ends[-1])
        return self.data[at].tobytes(), ends[off].tolist()


class _Lockstep:
    """``merge`` for many short pieces at once: their segment trees are columns of one array, and every
    step applies the root merge of each piece that still has one."""

    LIMIT = 32

    def __init__(self, byte_ids: list[int], ranks: dict[tuple[int, int], tuple[int, int]]):
        keys = np.array([a << 32 | b for a, b in ranks], np.int64)
        rank, new = np.array(list(ranks.values()), np.int64).reshape(-1, 2).T
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], rank[order].astype(np.int32)
        self.new = np.zeros(len(keys), np.int32)
        self.new[rank] = new
        self.bytes = np.array(byte_ids, np.int32)
        self.none = np.int32((1 << 31) - 1)

    def _leaf(self, a: np.ndarray, b: np.ndarray, i: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.rank[at] << 5 | i, self.none).astype(np.int32)

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Pieces of 1 to LIMIT bytes."""
        out: list[list[int]] = [[]] * len(pieces)
        for which, ids, off in self.merged(pieces):
            for i, a, b in zip(which.tolist(), off, off[1:], strict=False):
                out[i] = ids[a:b].tolist()
        return out

    def merged(self, pieces: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pieces of 1 to LIMIT bytes. Yields numbers of pieces, all their ids, and n+1 offsets of the pieces into them."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        for low, size in ((0, 4), (4, 8), (8, 16), (16, 32)):
            which = np.flatnonzero((sizes > low) & (sizes <= size))
            if len(which):
                yield which, *self._merge([pieces[i] for i in which.tolist()], sizes[which], size)

    def _merge(self, pieces: list[bytes], sizes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        m = len(pieces)
        raw = np.frombuffer(b"".join([p.ljust(size, b"\0") for p in pieces]), np.uint8).reshape(m, size)
        ids = np.full((size + 1, m), -1, np.int32)
        ids[:size] = np.where(np.arange(size)[:, None] < sizes, self.bytes[raw].T, -1)
        after = np.repeat(np.arange(1, size + 1, dtype=np.int32)[:, None], m, 1)
        before = after - 2
        tree = np.full((2 * size, m), self.none, np.int32)
        for i in range(size - 1):
            tree[size + i] = self._leaf(ids[i], ids[i + 1], np.int32(i))
        for k in range(size - 1, 0, -1):
            np.minimum(tree[2 * k], tree[2 * k + 1], out=tree[k])
        flat, idf, aff, bef = tree.reshape(-1), ids.reshape(-1), after.reshape(-1), before.reshape(-1)
        live = np.flatnonzero(tree[1] != self.none)
        while len(live):
            root = flat[m + live]
            i = root & 31
            at = i * m + live
            j = aff[at]
            new = self.new[root >> 5]
            idf[at] = new
            idf[j * m + live] = -1
            k = aff[j * m + live]
            aff[at] = k
            inner = k < size
            bef[k[inner] * m + live[inner]] = i[inner]
            h = bef[at]
            first = h < 0
            left = self._leaf(np.where(first, -1, idf[np.maximum(h, 0) * m + live]), new, h)
            inside = j < size  # the last place starts no pair, its leaf is empty anyway
            flat[(size + j[inside]) * m + live[inside]] = self.none
            flat[(size + i) * m + live] = self._leaf(new, idf[k * m + live], i)
            flat[(size + h[~first]) * m + live[~first]] = left[~first]
            for node, rows in ((size + j, live), (size + i, live), (size + h[~first], live[~first])):
                while node.size and node[0] > 1:
                    node = node >> 1
                    flat[node * m + rows] = np.minimum(flat[2 * node * m + rows], flat[(2 * node + 1) * m + rows])
            live = live[flat[m + live] != self.none]
        rows = np.ascontiguousarray(ids.T)
        there = rows >= 0
        return rows[there], np.append(0, np.cumsum(there.sum(1)))


class ByteBPE:
    """A vocabulary file of a byte-level BPE tokenizer, without its truncation and padding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        chars = _byte_chars()
        self.byte_ids = [vocab[chars[b]] for b in range(256)]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(pairs)}
        back = {c: b for b, c in chars.items()}
        self.token_bytes = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.token_bytes |= {i: t.encode() for t, i in self.special.items()}
        self.lockstep = _Lockstep(self.byte_ids, self.ranks)
        self.texts = {i: str(i) for i in self.token_bytes}
        self.text_spans, self.byte_spans = _Spans({i: f"{i},".encode() for i in self.token_bytes}), _Spans(self.token_bytes)
        self.split = regex.compile(PATTERN).findall
        ordered = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, ordered))) if ordered else None
        self.cache: dict[str, tuple[str, bytes]] = {}
        self.seen: dict[str, tuple[str, bytes]] = {}

    def known(self, part: str) -> tuple[str, bytes]:
        """Comma-joined ids and decoded bytes of a part without special tokens."""
        found = [self.seen.get(p) or self._piece(p) for p in self.split(part)]
        if len(found) == 1:
            return found[0]
        return ",".join([x for x, _ in found]), b"".join([x for _, x in found])

    def _piece(self, piece: str) -> tuple[str, bytes]:
        ids = merge([self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")], self.ranks)
        found = ",".join(map(self.texts.__getitem__, ids)), self.decode_bytes(ids)
        if len(piece) <= CACHE_CHARS:
            if len(self.seen) >= CACHE_CHUNKS:
                self.seen.clear()
            self.seen[piece] = found
        return found

    def learn(self, texts: Iterable[str]) -> None:
        """Caches the chunks of the texts that are not known yet; their distinct pieces are merged in lockstep."""
        fresh: set[str] = set()
        for text in texts:
            fresh.update(text.split(" "))
        chunks = [c for c in fresh.difference(self.cache) if 0 < len(c) <= CACHE_CHARS and not c[0].isspace() and not c[-1].isspace()]
        if len(self.cache) + len(chunks) > CACHE_CHUNKS:
            self.cache.clear()
        if not chunks:
            return
        # no piece reaches over the space before a chunk, and only a chunk's first piece begins with a space
        pieces = self.split(" " + " ".join(chunks))
        distinct = set(pieces)
        if len(self.seen) + len(distinct) > CACHE_CHUNKS:
            self.seen.clear()
        self._merged([p for p in distinct if p not in self.seen])
        found = list(map(self.seen.__getitem__, pieces))
        starts = [k for k, p in enumerate(pieces) if p[0] == " "]
        for c, a, b in zip(chunks, starts, [*starts[1:], len(pieces)], strict=True):
            if b - a == 1:
                self.cache[c] = found[a]
            else:
                ids, raw = zip(*found[a:b], strict=True)
                self.cache[c] = ",".join(ids), b"".join(raw)

    def _merged(self, pieces: list[str]) -> None:
        """Caches pieces, those of up to LIMIT bytes together."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        short = [k for k, r in enumerate(raw) if len(r) <= _Lockstep.LIMIT]
        for which, ids, off in self.lockstep.merged([raw[k] for k in short]):
            (text, t), (back, b) = self.text_spans.gather(ids, off), self.byte_spans.gather(ids, off)
            text = text.decode("ascii")
            for i, t0, t1, b0, b1 in zip(which.tolist(), t, t[1:], b, b[1:], strict=False):
                self.seen[pieces[short[i]]] = text[t0 : t1 - 1], back[b0:b1]
        for p, r in zip(pieces, raw, strict=True):
            if len(r) > _Lockstep.LIMIT:
                ids = merge([self.byte_ids[b] for b in r], self.ranks)
                self.seen[p] = ",".join(map(self.texts.__getitem__, ids)), self.decode_bytes(ids)

    def chunk(self, chunk: str) -> tuple[str, bytes] | None:
        """``known`` of a space and the chunk. None if white space begins or ends the chunk, or it is empty:
        then its pieces depend on its neighbours. Else no piece reaches over the space before it."""
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            return None
        found = self.known(" " + chunk)
        if len(chunk) <= CACHE_CHARS:
            if len(self.cache) >= CACHE_CHUNKS:
                self.cache.clear()
            self.cache[chunk] = found
        return found

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text cut at the strings of special tokens; True: such a string."""
        at = 0
        for hit in self.specials.finditer(text) if self.specials else ():
            yield text[at : hit.start()], False
            yield hit.group(), True
            at = hit.end()
        yield text[at:], False

    def pieces(self, text: str) -> list[tuple[str, bytes]]:
        """Comma-joined ids and decoded bytes of consecutive parts of the text."""
        out: list[tuple[str, bytes]] = []
        for part, special in self.segments(text):
            if special:
                i = self.special[part]
                out.append((str(i), self.token_bytes[i]))
            elif part:
                out.extend(self._part(part))
        return out

    def _part(self, part: str) -> list[tuple[str, bytes]]:
        first, *rest = part.split(" ")
        try:
            found = list(map(self.cache.__getitem__, rest))
        except KeyError:
            found = [self.cache.get(c) or self.chunk(c) for c in rest]
            if None in found:
                return [self.known(part)]
        if rest and first[-1:].isspace():
            return [self.known(part)]
        return [self.known(first), *found] if first else found

    def encoded(self, text: str) -> tuple[str, bytes]:
        """The comma-joined ids of a text and the bytes that they decode to."""
        found = self.pieces(text)
        if not found:
            return "", b""
        ids, raw = zip(*found, strict=True)
        return ",".join(ids), b"".join(raw)

    def encode(self, text: str) -> list[int]:
        ids, _ = self.encoded(text)
        return [int(i) for i in ids.split(",")] if ids else []

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@cache
def load(path: str) -> ByteBPE:
    """One per worker process and file."""
    return ByteBPE(path)


def encode(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """Each row's key and ``n_tokens`` and, without ``digests``, ``ids`` (array of int) and ``decoded``; with
    them ``ids_sha256`` (of the decimal ids joined by commas) and ``decoded_sha256``. ``path`` is the
    vocabulary file at the same place on every executor.

    A null text counts as empty: no tokens, digests of the empty string. A row is one task's work in
    O(n log n) of its longest piece; equal rows give equal results, no row is dropped, other columns are
    left out."""
    kind = docs.schema[key].dataType.simpleString()
    out = "n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for part in slices(batch, "text"):
                n, a, b = [], [], []
                texts = part.column("text").to_pylist()
                bpe.learn(filter(None, texts))
                for text in texts:
                    ids, raw = bpe.encoded(text or "")
                    n.append(ids.count(",") + 1 if ids else 0)
                    plain = raw.decode("utf-8", "replace")
                    if digests:
                        a.append(hashlib.sha256(ids.encode()).hexdigest())
                        b.append(hashlib.sha256(plain.encode()).hexdigest())
                    else:
                        a.append([int(i) for i in ids.split(",")] if ids else [])
                        b.append(plain)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(n, pa.int64()), pa.array(a, pa.string() if digests else pa.list_(pa.int32())), pa.array(b, pa.string())],
                    names=[key, "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))],
                )

    return docs.selectExpr(f"`{key}` AS key", f"cast(`{text}` AS string) AS text").mapInArrow(run, f"`{key}` {kind}, {out}")
