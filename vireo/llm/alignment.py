"""Cross-tokenizer alignment by a cogroup of postings.

Each text is encoded by two tokenizers, a byte-level one (A) and a piece model (B).  Byte offsets where tokens of both end cut
them into groups; the two tokens that end there are linked.  How often an id pair is linked in the whole corpus says how good a
link is, and each document gets the sums over its links.

Postings: a document's pairs with their multiplicities are shuffled by B's id, in blocks of many documents, as streams sorted by
id: first the id's counts by A's id, summed in the tasks that made the blocks, then its postings.  The task that holds an id
adds up its counts, takes their maximum and emits what each document gets; these contributions are packed by the task that
encoded their documents, and summed by document there.  An id
that is linked very often is dealt to several tasks; its counts (at most A's ids) are then summed beforehand and sent to
each.  Sorting is Spark's, which spills; a task holds one id's share of postings (about ``SHARE``) and a block of results.

Both tokenizers are cut at the same places (see ``pretokens``): no token of either has white space after another character,
which is checked on loading.  Pieces are aligned once and kept in a bounded cache.  Texts are encoded once; rows have ids of
their own, which are written with the blocks, so documents may share a doc_id.

Defined cases: null and empty texts, and texts that either tokenizer doesn't give back byte for byte (those with U+2581),
have no tokens: zeros and '' for the digest; a null doc_id stays null; repeated rows count and come out each; texts of any
length are aligned whole; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vireo.llm.common import cut, small_batches, table
from vireo.llm.pretokens import Library, keys, lookup

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Postings of an id that a task gets, about; postings that a task collects into blocks, and handles at a time.
SHARE, BLOCK, CHUNK = 200_000, 500_000, 500_000
MARK = "▁"
#: Bits of a row's id below the number of the task that has encoded it.
HOME = 33


def groups_of(a: list[int], b: list[int], a_bytes, b_bytes) -> tuple[list[tuple[list[int], list[int]]], bool]:
    """Ids of both sides (a_bytes, b_bytes: lengths by id) by group, and whether both sides end together."""
    groups, ga, gb, at, of_b = [], [], [], 0, iter(b)
    for x in a:
        ga.append(x)
        at -= a_bytes[x]
        while at < 0 and (y := next(of_b, None)) is not None:
            gb.append(y)
            at += b_bytes[y]
        if at == 0:
            groups.append((ga, gb))
            ga, gb = [], []
    return groups, not ga and next(of_b, None) is None


class Pair:
    """Two tokenizers and the alignments of pieces; one per worker."""

    _made: dict[tuple[str, str], "Pair"] = {}

    def __init__(self, a: str, b: str):
        import public_tokenizers
        import sentencepiece

        self.a, self.b, self.cache = Library.of(a, plain=True), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(b)), {}
        if self.a.ranked is None:
            raise ValueError(f"{a} isn't a byte-level tokenizer whose ids are its merges in order")
        shown = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        plain = [not (self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_byte(i)) for i in range(len(shown))]
        if any(p and (not s or "\n" in s or MARK in s.lstrip(MARK)) for s, p in zip(shown, plain)):
            raise ValueError(f"{b} has pieces with white space after another character")
        self.b_text = [bytes([int(s[3:-1], 16)]) if self.b.is_byte(i) else s.replace(MARK, " ").encode() for i, s in enumerate(shown)]
        self.a_bytes, self.b_bytes, self.space = self.a.n_bytes.tolist(), list(map(len, self.b_text)), self.b.piece_to_id(MARK)

    @classmethod
    def of(cls, a: str, b: str) -> "Pair":
        if (a, b) not in cls._made:
            cls._made[a, b] = cls(a, b)
        return cls._made[a, b]

    def aligned(self, pieces: list[str]) -> list[tuple | None]:
        """Of each piece: numbers of ids and groups, the groups written out, and the links as 64-bit values (B's id above A's).

        A piece starts with a space, which B adds by itself, or with a newline.  None if B doesn't give the piece back.
        """
        out = []
        of_b = self.b.encode([p[1:] if p[:1] == " " else p for p in pieces], num_threads=1) if pieces else []
        for piece, ids, b in zip(pieces, self.a.encode(pieces), of_b):
            a = np.frombuffer(ids, "<u4").tolist()
            if piece == " ":
                b = [self.space]
            elif piece[:1] == "\n":
                b = b[1:]  # the space that B adds
            groups, whole = groups_of(a, b, self.a_bytes, self.b_bytes)
            if not whole or b"".join([self.b_text[y] for y in b]) != piece.encode():
                out.append(None)
                continue
            written = ";".join([f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups]).encode()
            links = np.array([y[-1] << 32 | x[-1] for x, y in groups], np.int64)
            out.append((len(a), len(b), len(groups), written, links.tobytes()))
        return out

    def texts(self, texts: list[str | None]) -> list[list[tuple]]:
        """The aligned pieces of each text; none for a text without tokens."""
        cut = [keys(" " + t) if t else [""] for t in texts]
        first = iter(self.aligned([ks[0] for ks in cut if ks[0]]))
        rest = lookup([ks[1:] for ks in cut], self.cache, self.aligned)
        found = [([next(first)] if ks[0] else []) + vs for ks, vs in zip(cut, rest)]
        return [[] if None in vs else vs for vs in found]


_FIELDS = [("kind", pa.int32()), ("row", pa.int64()), ("doc_id", None), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("b", pa.int32()), ("a", pa.list_(pa.int32())), ("n", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64()))]
#: Kinds of rows: counts of a B id, postings of a B id, a document.
COUNTS, POSTINGS, DOCUMENT = 0, 1, 2


def _batch(of_id: pa.DataType, size: int, **columns) -> pa.RecordBatch:
    arrays = []
    for name, t in _FIELDS:
        t = of_id if t is None else t
        made = columns.get(name)
        arrays.append(pa.nulls(size, t) if made is None else made if isinstance(made, pa.Array) else pa.array(made, t))
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in _FIELDS])


def _lists(starts: np.ndarray, values: np.ndarray, t: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), pa.array(values, t))


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where any of the columns changes."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    new[:1] = True
    return np.flatnonzero(new)


def _blocks(codes: np.ndarray, rows: np.ndarray, n: np.ndarray, kind: pa.DataType):
    """Postings by B's id, and before them their counts by pair."""
    order = np.argsort(codes, kind="stable")
    codes, rows, n = codes[order], rows[order], n[order]
    pairs = _starts(codes)
    for label, c, v, r in ((COUNTS, codes[pairs], np.add.reduceat(n, pairs), None), (POSTINGS, codes, n, rows)):
        b, a = (c >> 32).astype(np.int32), (c & 0xFFFFFFFF).astype(np.int32)
        starts = _starts(b)
        for at in range(0, len(starts), 4096):
            some = starts[at : at + 4096]
            end = starts[at + 4096] if at + 4096 < len(starts) else len(b)
            cut = slice(some[0], end)
            yield _batch(kind, len(some), kind=np.full(len(some), label, np.int32), b=b[some], a=_lists(some - some[0], a[cut], pa.int32()), n=_lists(some - some[0], v[cut], pa.int64()), rows=None if r is None else _lists(some - some[0], r[cut], pa.int64()))


def _encoded(a: str, b: str):
    def run(batches):
        pair, held, count, kind = Pair.of(a, b), [], 0, None
        for batch in batches:
            kind, rows = batch.column(1).type, batch.column(0).to_numpy()
            stats: list[tuple] = []
            for row, found in zip(rows.tolist(), pair.texts(batch.column(2).to_pylist())):
                codes, n = np.unique(np.frombuffer(b"".join([v[4] for v in found]), np.int64), return_counts=True)
                sums = [sum([v[i] for v in found]) for i in range(3)]
                stats.append((*sums, int(n.sum()), hashlib.sha256(b";".join([v[3] for v in found])).hexdigest() if found else ""))
                if len(codes):
                    held.append((codes, np.full(len(codes), row), n))
                    count += len(codes)
                if count >= BLOCK:
                    yield from _blocks(*map(np.concatenate, zip(*held)), kind)
                    held, count = [], 0
            if stats:
                n_a, n_b, n_groups, n_links, sha = zip(*stats)
                yield _batch(kind, len(stats), kind=np.full(len(stats), DOCUMENT, np.int32), row=rows, doc_id=batch.column(1), n_a=n_a, n_b=n_b, n_groups=n_groups, n_links=n_links, groups_sha256=sha)
        if held:
            yield from _blocks(*map(np.concatenate, zip(*held)), kind)

    return run


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False)


def _contributions(batches):
    """Rows of (b, part) sorted by kind, counts first, to what each document row gets.  Holds whole (b, part) groups, a chunk of them at a time."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        b, part = batch.column("b").to_numpy(), batch.column("part").to_numpy()
        if not len(b):
            continue
        held.append(batch)
        size += len(batch.column("a").flatten())
        last = int(_starts(b, part)[-1])
        if size < CHUNK or not last and not _new(held, b[0], part[0]):
            continue
        # all but the last group, which may go on
        ready = [*held[:-1], batch.slice(0, last)]
        held = [batch.slice(last)]
        size = len(held[0].column("a").flatten())
        yield from _summed(ready)
    yield from _summed(held)


def _new(held: list[pa.RecordBatch], b: int, part: int) -> bool:
    """Whether the batch held last starts a group of its own."""
    before = held[-2] if len(held) > 1 else None
    return before is not None and (before.column("b")[-1].as_py(), before.column("part")[-1].as_py()) != (b, part)


def _summed(batches: list[pa.RecordBatch]):
    counts, postings = [], []
    for batch in batches:
        kinds, b, part = batch.column("kind").to_numpy(), batch.column("b").to_numpy().astype(np.int64), batch.column("part").to_numpy()
        for kind, into in ((COUNTS, counts), (POSTINGS, postings)):
            at = np.flatnonzero(kinds == kind)
            if len(at):
                some = batch.take(pa.array(at))
                sizes = np.diff(some.column("a").offsets.to_numpy())
                into.append((np.repeat(b[at] << 32, sizes) | _flat(some, "a"), np.repeat(part[at], sizes), _flat(some, "n"), _flat(some, "rows") if kind == POSTINGS else None))
    if not postings:
        return
    code, part, n = (np.concatenate(c) for c in list(zip(*counts))[:3])
    # parts of an id get the same counts, so those of one part are enough
    order = np.lexsort((part, code))
    code, part, n = code[order], part[order], n[order]
    starts = _starts(code, part)
    code, n = code[starts], np.add.reduceat(n, starts)
    once = _starts(code)
    code, n = code[once], n[once]
    ids = _starts(code >> 32)
    most = np.repeat(np.maximum.reduceat(n, ids), np.diff(np.append(ids, len(code))))
    of, _, m, rows = (np.concatenate(c) for c in zip(*postings))
    at = np.searchsorted(code, of)
    order = np.argsort(rows, kind="stable")
    rows, starts = rows[order], _starts(rows[order])
    best, total = (np.add.reduceat(v[order], starts) for v in (np.where(n[at] == most[at], m, 0), n[at] * m))
    rows = rows[starts]
    homes = _starts(rows >> HOME)
    yield pa.RecordBatch.from_arrays([pa.array(rows[homes] >> HOME), *(_lists(homes, v, pa.int64()) for v in (rows, best, total))], ["home", "rows", "n_best", "count_sum"])


def _totals(batches):
    """Contributions sorted by home to the sums of its rows.  Holds two numbers for each row of a home, which is what a task has encoded."""
    now, sums = None, np.zeros((2, 0), np.int64)

    def told():
        at = np.flatnonzero(sums.any(0))
        return pa.RecordBatch.from_arrays([pa.array(at + (now << HOME)), pa.array(sums[0, at]), pa.array(sums[1, at])], ["row", "n_best", "count_sum"])

    for batch in batches:
        for k, home in enumerate(batch.column("home").to_pylist()):
            if home != now:
                if now is not None:
                    yield told()
                now, sums = home, np.zeros((2, 0), np.int64)
            rows, best, total = (batch.column(c)[k].values.to_numpy() for c in ("rows", "n_best", "count_sum"))
            at = rows - (home << HOME)
            if at[-1] >= sums.shape[1]:
                sums = np.pad(sums, ((0, 0), (0, max(int(at[-1]) + 1 - sums.shape[1], sums.shape[1]))))
            sums[0, at] += best  # rows of one contribution differ
            sums[1, at] += total
    if now is not None:
        yield told()


def postings(docs: DataFrame, a: str = A, b: str = B, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of three kinds, written: documents with their numbers and digest, blocks of postings and their counts by B's id."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return cut(rows.mapInArrow(_encoded(a, b), f"kind int, row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, b int, a array<int>, n array<long>, rows array<long>"))


def pair_counts(made: DataFrame) -> DataFrame:
    """b, a, n: how many links of the corpus have both ids (made: what ``postings`` gives)."""
    return made.where(F.col("kind") == COUNTS).select("b", F.explode(F.arrays_zip("a", "n")).alias("p")).groupBy("b", F.col("p.a").alias("a")).agg(F.sum("p.n").alias("n"))


def align(docs: DataFrame, a: str = A, b: str = B, id: str = "doc_id", text: str = "text", share: int = SHARE) -> DataFrame:
    """Per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is its B id's most frequent), count_sum (of their pairs' counts), groups_sha256."""
    made = postings(docs, a, b, id, text)
    sized = made.where(F.col("kind") == POSTINGS).groupBy("b").agg(F.sum(F.size("a")).alias("size"))
    # at most one row for each of B's ids, which is small enough to be broadcast
    parts = F.broadcast(cut(sized.where(F.col("size") > share).select("b", F.ceil(F.col("size") / share).cast("int").alias("parts"))))
    blocks = made.where(F.col("kind") != DOCUMENT).select("b", "kind", "a", "n", "rows").join(parts, "b", "left")
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(F.element_at("rows", 1)), F.col("parts")).cast("int"))
    own = blocks.where((F.col("kind") == POSTINGS) | F.col("parts").isNull()).select("b", part.alias("part"), "kind", "a", "n", "rows")
    total = pair_counts(made.join(parts.select("b"), "b", "left_semi")).groupBy("b").agg(F.collect_list(F.struct("a", "n")).alias("p")).join(parts, "b")
    sent = total.select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(COUNTS).alias("kind"), F.col("p.a").alias("a"), F.col("p.n").alias("n"), F.lit(None).cast("array<long>").alias("rows"))
    dealt = own.unionByName(sent).repartition("b", "part").sortWithinPartitions("b", "part", "kind")
    parts = dealt.mapInArrow(_contributions, "home long, rows array<long>, n_best array<long>, count_sum array<long>")
    sums = parts.repartition("home").sortWithinPartitions("home").mapInArrow(_totals, "row long, n_best long, count_sum long")
    found = made.where(F.col("kind") == DOCUMENT).select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def written_groups(docs: DataFrame, a: str = A, b: str = B, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and groups: the ids of each group as ``a1,a2|b1;a3|b2,b3``; '' without tokens."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        for batch in batches:
            found = Pair.of(a, b).texts(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b";".join([v[3] for v in vs]).decode() for vs in found], pa.string())], ["doc_id", "groups"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, groups string")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
