"""Sequence packing by Karmarkar-Karp multiway differencing.

A document is its token ids followed by the end id.  Each full run of ``capacity`` ids is a sequence of its own; the rest of
a document is cut into pieces of at most a quarter of the capacity, since large pieces can't fill windows evenly.  The pieces are packed in blocks of ``BLOCK``: differencing merges partial partitions, the one with the
largest imbalance first, laying the heaviest windows of one upon the lightest of the other.  The window count starts at the least
possible one and rises by one whenever some window exceeds the capacity.  Windows come out near-equal, so padding is about one
window in a block.  Packing happens inside the tasks that read the documents: nothing is shuffled.

Sequence ids are (partition << 33) + number, so they are the same when a lost task runs again on the same split.

Defined cases: null text counts as empty and gives one piece with the end id alone; null ids of documents stay null; repeated
rows are packed each; texts of any length are encoded whole; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vireo.llm.common import small_batches, table
from vireo.llm.pretokens import Library, keys, lookup

CAPACITY, BLOCK, FLUSH = 1024, 512, 2048


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Places of sizes dealt to windows so that their sums are near-equal."""
    heap = []
    for i, s in enumerate(sizes):
        sums = np.zeros(windows, np.int64)
        sums[0] = s  # sums fall from left to right
        heap.append((-s, i, sums, [(i,), *[()] * (windows - 1)]))
    heapq.heapify(heap)
    count = len(sizes)
    while len(heap) > 1:
        _, _, a, of_a = heapq.heappop(heap)
        _, _, b, of_b = heapq.heappop(heap)
        sums = a + b[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        sums -= sums[-1]
        both = [x + y if x and y else x or y for x, y in zip(of_a, reversed(of_b))]
        count += 1
        heapq.heappush(heap, (-int(sums[0]), count, sums, [both[k] for k in order.tolist()]))
    return [list(g) for g in heap[0][3] if g] if heap else []


def windows_of(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Places of sizes (each at most capacity) by window; as few windows as differencing can fill within capacity."""
    n = max(1, -(-sum(sizes) // capacity))
    while True:
        dealt = differencing(sizes, n)
        if all(sum(sizes[i] for i in g) <= capacity for g in dealt):
            return dealt
        n += 1


def token_ids(library: Library, texts: list[str]) -> list[bytes]:
    """Ids of whole texts as little-endian unsigned 32-bit integers."""
    if library.ranked is None:
        return library.encode(texts)
    cut = [keys(t) for t in texts]
    first = library.encode([ks[0] for ks in cut])
    rest = lookup([ks[1:] for ks in cut], library.ids, library.encode)
    return [f + b"".join(vs) for f, vs in zip(first, rest)]


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, capacity: int = CAPACITY, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of docs: doc_id, start, length, ids (binary), doc_tokens, sequence_id, offset (in the sequence)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        library, base, made = Library.of(tokenizer), TaskContext.get().partitionId() << 33, 0
        out: list[tuple] = []
        rests: list[tuple] = []
        id_type = None

        def flushed():
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
            out.clear()
            return batch

        def dealt():
            nonlocal made
            for window in windows_of([r[2] for r in rests], capacity):
                at = 0
                for i in window:
                    out.append((*rests[i], base + made, at))
                    at += rests[i][2]
                made += 1
            rests.clear()

        for batch in batches:
            id_type = batch.column(0).type
            for doc, ids in zip(batch.column(0).to_pylist(), token_ids(library, batch.column(1).to_pylist())):
                ids += end
                n = len(ids) // 4
                for at in range(0, n - n % capacity, capacity):
                    out.append((doc, at, capacity, ids[4 * at : 4 * (at + capacity)], n, base + made, 0))
                    made += 1
                    if len(out) >= FLUSH:
                        yield flushed()
                for at in range(n - n % capacity, n, capacity // 4):
                    cut = ids[4 * at : 4 * (at + capacity // 4)]
                    rests.append((doc, at, len(cut) // 4, cut, n))
                    if len(rests) == BLOCK:
                        dealt()
                if len(out) >= FLUSH:
                    yield flushed()
        if rests:
            dealt()
        if out:
            yield flushed()

    return rows.mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences, with their token ids."""
    return pack(docs)
