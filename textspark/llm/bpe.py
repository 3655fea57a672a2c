"""Byte-level BPE by monoid tree reduction.

``encode`` of a byte string is a monoid image: the two halves are encoded and
joined. A join re-encodes a window of tokens around the boundary and grows it
until both edges of the window are stable. Stable is a proof, not a guess: a
token sequence is the encoding of its bytes exactly if every two neighbours
encode, as bytes of their own, to themselves. (Merges run in the order of
(rank, position). Take the first merge that crosses a boundary of the
sequence; before it, both neighbours only saw merges within themselves, so the
same merge is the first to cross when the two are encoded alone.) Tokens
outside the window were neighbours before, so only the window's two edges need
the test.

Texts are first cut by the vocabulary's pattern; pieces never merge with each
other, so the join of two runs of pieces is concatenation. Decoding
concatenates the bytes of the halves up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame

from .common import Kept, focus, keeps

#: Byte strings up to this length are merged directly.
LEAF = 4
#: The longest string whose direct merges are kept (bytes).
KEPT_BYTES = 16
#: Stretches of text in one generation of those whose ids a worker keeps (35 bytes each); a fifth as many short byte strings, and a third as many pairs of tokens, are kept too.
KEPT = 500_000
#: Bytes of text that are worked on at a time; a longer text is a lot of its own.
LOT_BYTES = 2 << 20
#: Ids that a leaf of the decoding tree concatenates at once.
DECODE_LEAF = 1 << 20
#: Characters that any of the pattern's white space classes may take, as an RE2 class.
SPACES = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BESIDE_SPACE = rf"{SPACES}\x20|\x20{SPACES}"
LONE_SPACE = re.compile(r"(?<=\S)\x20(?=\S)").split


class Encodings:
    """Ids of the stretches met lately, by two 64-bit hashes of each: sorted arrays, about 35 bytes a stretch, in two generations."""

    def __init__(self, make, limit: int):
        self.make, self.limit = make, limit
        self.clear()

    def clear(self) -> None:
        self.tables = [self._empty(), self._empty()]

    @staticmethod
    def _empty() -> tuple[np.ndarray, ...]:
        none = np.empty(0, np.uint64)
        return none, none, np.zeros(1, np.int64), np.empty(0, np.int32)  # hashes, second hashes, where the ids begin, ids

    @staticmethod
    def _find(table: tuple[np.ndarray, ...], h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table[0]):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(table[0], h), len(table[0]) - 1)
        return at, (table[0][at] == h) & (table[1][at] == g)

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each of the distinct ``words`` begin and, on end, end; and the ids."""
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        g = np.fromiter((xxhash.xxh3_64_intdigest(w, 1) for w in words), np.uint64, len(words))
        at, hit = self._find(self.tables[0], h, g)
        before, late = self._find(self.tables[1], h, g)
        late &= ~hit
        new = np.flatnonzero(~hit & ~late)
        made = [self.make(words[i]) for i in new.tolist()]
        sizes = np.zeros(len(words), np.int64)
        sizes[hit] = np.diff(self.tables[0][2])[at[hit]]
        sizes[late] = np.diff(self.tables[1][2])[before[late]]
        sizes[new] = np.fromiter(map(len, made), np.int64, len(made))
        begin = np.r_[0, np.cumsum(sizes)]
        out = np.empty(int(begin[-1]), np.int32)
        for rows, table, where in ((hit, self.tables[0], at), (late, self.tables[1], before)):
            out[_ranges(begin[:-1][rows], sizes[rows])] = table[3][_ranges(table[2][where[rows]], sizes[rows])]
        out[_ranges(begin[new], sizes[new])] = np.fromiter(chain.from_iterable(made), np.int32, int(sizes[new].sum()))
        self._add(h, g, begin, sizes, out, np.flatnonzero(~hit))
        return begin, out

    def _add(self, h, g, begin, sizes, out, rows) -> None:
        if len(self.tables[0][0]) + len(rows) > self.limit:
            self.tables = [self._empty(), self.tables[0]]
        old, rows = self.tables[0], rows[np.argsort(h[rows])]  # two sorted runs: the stable sort merges them
        every_h, every_g = np.concatenate([old[0], h[rows]]), np.concatenate([old[1], g[rows]])
        first, size = np.concatenate([old[2][:-1], begin[rows] + len(old[3])]), np.concatenate([np.diff(old[2]), sizes[rows]])
        order = np.argsort(every_h, kind="stable")
        ids = np.concatenate([old[3], out])[_ranges(first[order], size[order])]
        self.tables[0] = every_h[order], every_g[order], np.r_[0, np.cumsum(size[order])], ids


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers ``first[k]`` to ``first[k] + size[k] - 1`` of each k, on end."""
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.cut = regex.compile(pattern).findall
        self._merged = Kept(self._merge)
        self._pairs = Kept(self._stable)
        self._halves = Kept(self._by_halves)
        self._stretches = Encodings(self._cut, KEPT)
        self.keep(KEPT)
        # The bytes of each id, and each id as text after a space, for joining many at once.
        self.data = pa.array(self.bytes_of, pa.large_binary())
        self.shown = pa.array([f" {i}" for i in range(len(self.bytes_of))], pa.large_string())
        self.data_size = np.fromiter(map(len, self.bytes_of), np.int64, len(self.bytes_of))
        self.shown_size = np.char.str_len(np.arange(len(self.bytes_of)).astype(str)).astype(np.int64) + 1

    def keep(self, stretches: int) -> None:
        """Sets how much is kept; what is found does not depend on it."""
        self._stretches.limit = stretches
        self._merged.limit = self._halves.limit = stretches // 5
        self._pairs.limit = stretches // 3

    def clear(self) -> None:
        """Drops what has been kept; the vocabulary stays."""
        for kept in (self._stretches, self._halves, self._merged, self._pairs):
            kept.clear()

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def merged(self, data: bytes) -> list[int]:
        """Direct merging, lowest rank first, leftmost on ties; short strings are kept."""
        return self._merged[data] if len(data) <= KEPT_BYTES else self.merged_long(data)

    def _merge(self, data: bytes) -> list[int]:
        ranks, parts = self.ranks, [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def stable(self, a: int, b: int) -> bool:
        """Whether the two tokens side by side encode to themselves."""
        return self._pairs[a << 32 | b]

    def _stable(self, pair: int) -> bool:
        a, b = pair >> 32, pair & 0xFFFFFFFF
        data = self.bytes_of[a] + self.bytes_of[b]
        return (self._merge(data) if len(data) <= KEPT_BYTES else self.merged_long(data)) == [a, b]

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of the bytes of ``a`` and ``b``, both encodings themselves."""
        if not a or not b:
            return a or b
        if self._pairs[a[-1] << 32 | b[0]]:
            return a + b
        of, stable = self.bytes_of, self._pairs
        i = j = 1
        while True:
            i, j = min(i, len(a)), min(j, len(b))
            tokens = self.merged(b"".join([of[x] for x in a[len(a) - i :] + b[:j]]))
            left = i == len(a) or stable[a[-i - 1] << 32 | tokens[0]]
            right = j == len(b) or stable[tokens[-1] << 32 | b[j]]
            if left and right:
                return a[: len(a) - i] + tokens + b[j:]
            i, j = (i if left else 2 * i), (j if right else 2 * j)

    def merged_long(self, data: bytes) -> list[int]:
        """Direct merging with a heap, for windows that no smaller window settles."""
        ranks, n = self.ranks, len(data)
        part = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := ranks.get(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i]
            if part[i] is not x or j >= n or part[j] is not y:
                continue
            part[i], part[j] = x + y, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (r := ranks.get(part[k] + part[after[k]])) is not None:
                    heapq.heappush(heap, (r, k, part[k], part[after[k]]))
        return [ranks[p] for p in part if p is not None]

    def encode_bytes(self, data: bytes) -> list[int]:
        """One piece of the pattern; the tree's depth is the logarithm of its length. Short halves are kept."""
        return list(self._by_halves(data)) if data else []

    def _by_halves(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(data) <= LEAF:
            return self._merge(data)
        half = len(data) // 2
        if half < KEPT_BYTES:
            return self.join(self._halves[data[:half]], self._halves[data[half:]])
        return self.join(self._by_halves(data[:half]), self._by_halves(data[half:]))

    def _cut(self, text: str) -> list[int]:
        """Ids of a stretch that no piece of the pattern leaves."""
        ids: list[int] = []
        for piece in self.cut(text):
            ids += self._by_halves(piece.encode("utf-8", "replace"))
        return ids

    def encode_lot(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (no nulls) on end, and where each text's begin; one more at the end.

        A space between two characters that are not white space starts a piece
        of the pattern and ends the one before, so texts part there exactly.
        Each distinct stretch of the lot is encoded once.
        """
        texts = texts.cast(pa.large_string())
        parts = pc.split_pattern(texts, " ")
        beside = np.flatnonzero(pc.match_substring_regex(texts, BESIDE_SPACE).to_numpy(zero_copy_only=False))
        if len(beside):
            rows = parts.to_pylist()
            for i in beside:
                rows[i] = LONE_SPACE(texts[int(i)].as_py())
            parts = pa.array(rows, pa.large_list(pa.large_string()))
        at = parts.offsets.to_numpy()
        found = parts.flatten().dictionary_encode()
        # Of each distinct stretch there are two: as the beginning of a text, and after its space.
        code = found.indices.to_numpy().astype(np.int64) * 2 + 1
        begin = at[:-1][at[1:] > at[:-1]] - at[0]
        code[begin] -= 1
        met = np.zeros(2 * len(found.dictionary), bool)
        met[code] = True
        used = np.flatnonzero(met)
        place = np.zeros(len(met), np.int64)
        place[used] = np.arange(len(used))
        words = found.dictionary.take(pa.array(used >> 1)).to_pylist()
        begin, ids = self._stretches.ids([" " + w if c else w for w, c in zip(words, (used & 1).tolist(), strict=True)])
        code = place[code]
        n = np.diff(begin)[code]
        return ids[_ranges(begin[code], n)], np.r_[0, np.cumsum(n)][at - at[0]]

    def encode(self, text: str) -> list[int]:
        return self.encode_lot(pa.array([text]))[0].tolist()

    def decode(self, ids) -> bytes:
        """Concatenates up the tree of halves; leaves are runs of ids."""
        ids = np.asarray(ids, np.int64)
        if len(ids) <= DECODE_LEAF:
            return _joined(self.data, ids)
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def _joined(of: pa.Array, ids: np.ndarray) -> bytes:
    found = of.take(pa.array(ids)) if len(ids) else None
    return found.buffers()[2].to_pybytes() if found is not None and found.buffers()[2] is not None else b""


def lots(texts: pa.Array):
    """(start, end) of runs of rows with about ``LOT_BYTES`` of text; a row is never parted."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + LOT_BYTES, "right")))
        yield start, end
        start = end


@lru_cache(maxsize=4)
def loaded(path: str, pattern: str) -> ByteBpe:
    found = ByteBpe.load(path, pattern)
    keeps("bpe", found)
    return found


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _encoded(path: str | None, pattern: str | None):
    def run(batches):
        focus("bpe")
        bpe = loaded(*((path, pattern) if path else default_vocabulary()))
        for b in batches:
            for lo, hi in lots(b.column(1)):
                ids, at = bpe.encode_lot(pc.fill_null(b.column(1).slice(lo, hi - lo), ""))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))], ["doc_id", "ids"])

    return run


def encode(documents: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every whole text; null and empty texts have no ids.

    ``path`` is read on the executors; by default it is the public byte-level
    vocabulary of 50,256 ranks. Rows may repeat, an empty table gives none;
    other columns are not read.
    """
    return documents.select("doc_id", "text").mapInArrow(_encoded(path, pattern), _schema(documents, "ids array<int>"))


def _schema(documents: DataFrame, rest: str) -> str:
    return f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, {rest}"


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and data (the bytes) of ``encode``'s rows; null ids give no bytes. Rows may repeat."""

    def run(batches):
        focus("bpe")
        bpe = loaded(*((path, pattern) if path else default_vocabulary()))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(x or []) for x in b.column(1).to_pylist()], pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, _schema(encoded, "data binary"))


def _digests(data: bytes, ends: np.ndarray, skip: int) -> list[str]:
    """SHA-256 of each stretch of ``data`` that ends at ``ends``, without its first ``skip`` bytes."""
    view, begin, out = memoryview(data), 0, []
    for end in ends.tolist():
        out.append(hashlib.sha256(view[min(begin + skip, end) : end]).hexdigest())
        begin = end
    return out


def round_trip(documents: DataFrame, path: str | None = None, pattern: str | None = None, keep: int = KEPT) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, encoded and decoded in one pass over the texts.

    ``keep`` bounds the memory of a worker (``ByteBpe.keep``), not the result.
    Null and empty texts have no ids and the digests of nothing. Rows may
    repeat and are each encoded; other columns are not read; an empty table
    gives an empty result.
    """

    def run(batches):
        focus("bpe")
        bpe = loaded(*((path, pattern) if path else default_vocabulary()))
        bpe.keep(keep)
        for b in batches:
            for lo, hi in lots(b.column(1)):
                ids, at = bpe.encode_lot(pc.fill_null(b.column(1).slice(lo, hi - lo), ""))
                shown = np.r_[0, np.cumsum(bpe.shown_size[ids])][at[1:]]
                data = np.r_[0, np.cumsum(bpe.data_size[ids])][at[1:]]
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(lo, hi - lo), pa.array(np.diff(at).astype(np.int64)),
                    pa.array(_digests(_joined(bpe.shown, ids), shown, 1)), pa.array(_digests(bpe.decode(ids), data, 0)),
                ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select("doc_id", "text").mapInArrow(run, _schema(documents, "n_tokens long, ids_sha256 string, decoded_sha256 string"))


__all__ = ["ByteBpe", "decode", "default_vocabulary", "encode", "loaded", "round_trip"]
