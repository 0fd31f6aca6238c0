"""Byte-level BPE encoding and decoding by merge ranks, in padded numpy matrices.

Distinct pre-tokens of a batch are laid out by length into padded matrices of token ids.  In each round every row merges its
leftmost pair of least rank; pair ranks come from an open-addressing hash table, rows that are done leave, and the matrix is
compacted by the column that the merge freed.  Pre-tokens over ``LONG`` bytes use a heap of pairs instead, which gives the
same merges in n log n steps.  Workers keep bounded caches of the ids of pre-tokens seen before.

Defined cases: null text counts as empty (no ids, empty bytes); null ids of documents stay null; repeated rows give repeated
results; texts of any length are encoded whole; bytes come back exactly; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vireo.llm.common import small_batches, table
from vireo.llm.pretokens import CACHE_CHARS, CACHE_ENTRIES, keys, lookup

NO_RANK = np.int32(2**31 - 1)
LONG, CELLS = 384, 1 << 21
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Ranks:
    """Merge ranks of a vocabulary file; one per worker and file."""

    _made: dict[str, "Ranks"] = {}

    def __init__(self, name: str):
        import public_tokenizers
        import regex

        self.pattern = regex.compile(public_tokenizers.PATTERN)
        with open(public_tokenizers.path(name), "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = [b""] * (max(self.rank.values()) + 1)
        for t, i in self.rank.items():
            self.token[i] = t
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        pairs = [(self.rank[t[:k]], self.rank[t[k:]], i) for t, i in self.rank.items() for k in range(1, len(t)) if t[:k] in self.rank and t[k:] in self.rank]
        self._build(np.array(pairs, np.int64).reshape(-1, 3))
        self.ids: dict[str, bytes] = {}
        self.pre: dict[str, bytes] = {}

    @classmethod
    def of(cls, name: str) -> "Ranks":
        if name not in cls._made:
            cls._made[name] = cls(name)
        return cls._made[name]

    def _build(self, pairs: np.ndarray) -> None:
        bits = max(4, int(len(pairs) * 2).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.vals = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NO_RANK, np.int32)
        key, val = pairs[:, 0] << 32 | pairs[:, 1], pairs[:, 2].astype(np.int32)
        at = self._slot(key)
        while len(key):
            free = self.keys[at] == -1
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            first = first[free[first]]
            self.keys[at[first]], self.vals[at[first]] = key[first], val[first]
            left = np.ones(len(key), bool)
            left[first] = False
            key, val, at = key[left], val[left], (at[left] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _MIX) >> self.shift).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids (NO_RANK where there is no merge; ids below 0 are padding)."""
        key = left.astype(np.int64) << 32 | right
        at = self._slot(key)
        got = self.keys[at]
        out = np.where(got == key, self.vals[at], NO_RANK)
        far = np.flatnonzero((got != key) & (got != -1))
        while len(far):
            at[far] = (at[far] + 1) & self.mask
            got = self.keys[at[far]]
            hit = got == key[far]
            out[far[hit]] = self.vals[at[far[hit]]]
            far = far[~hit & (got != -1)]
        out[(left < 0) | (right < 0)] = NO_RANK
        return out

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of each pre-token."""
        out: list = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        width = np.maximum(2, np.where(sizes <= 16, sizes, -(-sizes // 8) * 8))
        for w in np.unique(width[sizes <= LONG]):
            rows = np.flatnonzero((width == w) & (sizes <= LONG))
            step = max(1, CELLS // int(w))
            for i in range(0, len(rows), step):
                self._merge([words[r] for r in rows[i : i + step]], int(w), rows[i : i + step], out)
        for r in np.flatnonzero(sizes > LONG):
            out[r] = self._merge_long(words[r])
        return out

    def _merge(self, words: list[bytes], w: int, rows: np.ndarray, out: list) -> None:
        flat = np.frombuffer(b"".join(x.ljust(w, b"\0") for x in words), np.uint8).reshape(len(words), w)
        ids = self.byte[flat]
        ids[np.arange(w) >= np.fromiter(map(len, words), np.int64, len(words))[:, None]] = -1
        rank = self.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(words), w - 1)
        while len(rows):
            at = rank.argmin(1) if rank.shape[1] else np.zeros(len(rows), np.int64)
            best = rank[np.arange(len(rows)), at] if rank.shape[1] else np.full(len(rows), NO_RANK)
            if (done := best == NO_RANK).any():
                for r, x in zip(rows[done], ids[done]):
                    out[r] = x[x >= 0].astype("<u4").tobytes()
                ids, rank, rows, at, best = (x[~done] for x in (ids, rank, rows, at, best))
                if not len(rows):
                    return
            n, each = len(rows), np.arange(len(rows))
            ids[each, at] = best
            keep = np.ones(ids.shape, bool)
            keep[each, at + 1] = False
            ids = ids[keep].reshape(n, -1)
            keep = np.ones(rank.shape, bool)
            keep[each, at] = False
            rank = rank[keep].reshape(n, -1)
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at < rank.shape[1])
            rank[before, at[before] - 1] = self.pair_ranks(ids[before, at[before] - 1], ids[before, at[before]])
            rank[after, at[after]] = self.pair_ranks(ids[after, at[after]], ids[after, at[after] + 1])

    def _merge_long(self, word: bytes) -> bytes:
        n, token, rank = len(word), self.token, self.rank
        part, nxt, prv = [rank[word[i : i + 1]] for i in range(n)], list(range(1, n + 1)), list(range(-1, n - 1))
        of = lambda i: rank.get(token[part[i]] + token[part[nxt[i]]]) if nxt[i] < n else None
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := of(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            if part[i] != a or (j := nxt[i]) >= n or part[j] != b:
                continue
            part[i], part[j], nxt[i] = r, -1, nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            for k in (prv[i], i):
                if k >= 0 and (r := of(k)) is not None:
                    heapq.heappush(heap, (r, k, part[k], part[nxt[k]]))
        return np.array([x for x in part if x >= 0], "<u4").tobytes()

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        cut = [self.pattern.findall(p) for p in pieces]
        pre = self.pre
        new = list({w for ws in cut for w in ws if w not in pre})
        made = dict(zip(new, self.encode_words([w.encode() for w in new])))
        if len(pre) + len(made) > CACHE_ENTRIES:
            pre.clear()
            new = None
        get = lambda w: made[w] if w in made else pre.get(w)
        if new is None:  # the cache was cleared: what it held is made anew
            lost = list({w for ws in cut for w in ws if w not in made})
            made.update(zip(lost, self.encode_words([w.encode() for w in lost])))
        out = [b"".join(map(get, ws)) for ws in cut]
        pre.update((w, v) for w, v in made.items() if len(w) <= CACHE_CHARS)
        return out

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        cut = [keys(t) for t in texts]
        first = self.encode_pieces([ks[0] for ks in cut])
        rest = lookup([ks[1:] for ks in cut], self.ids, self.encode_pieces)
        return [f + b"".join(vs) for f, vs in zip(first, rest)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, ranks: str = "byte_bpe_multi_50k.tiktoken", id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: ``doc_id`` and ``ids``, the ids of its whole text as little-endian unsigned 32-bit integers."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(Ranks.of(ranks).encode_texts(b.column(1).to_pylist()), pa.binary())], ["doc_id", "ids"])

    rows = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, ranks: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """encoded (doc_id, ids) with ``decoded``, the bytes of its ids; null ids give empty bytes."""
    small_batches(encoded.sparkSession)

    def run(batches):
        for b in batches:
            made = pa.array([Ranks.of(ranks).decode(x or b"") for x in b.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), made], ["doc_id", "ids", "decoded"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary, decoded binary")


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = decode(encode(table(spark, sf_dir, "documents")))
    n = (F.octet_length("ids") / 4).cast("long")
    return both.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
