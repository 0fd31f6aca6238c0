"""Substring dedup by seed and extend.

Seeds: the runs of 26 words whose hash is the least in some window of 50 words (winnowing), so that two equal windows share a
seed.  Documents are joined on their seeds; a seed that two documents share is extended to both sides: the 50-word windows in
which it is the least run are compared, by hash, with those of the smallest document that has them.  Windows found so are
laid over each other, which gives the maximal repeats of at least 50 words; their words are removed.

Only hashes are shuffled for the join: about one seed in 13 words, then the windows around shared seeds alone.  Texts are dealt by
id twice, to look at the documents with shared seeds and to cut the repeats out.  Exact copies are found by a hash of the
whole word sequence beforehand, so a large group of copies counts as one document in the join.  Passages that very many
documents share are told by the seeds of one in SHARE sequences, and their rows are dealt to several tasks.  All state in
tasks is of one document or one run of equal hashes.  Hashes have 64 bits.

Defined cases: null text has no words; a null id has no smaller id and is smaller than none, so such rows stay whole and remove
nothing; rows that share an id don't remove each other's words; of one document's equal windows none removes another; an
empty table gives an empty table; texts of any length are read whole; extra columns are kept by ``dedup``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vireo.llm.common import cut, small, small_batches, spread, table
from vireo.llm.shingles import as_long, runs, sliding_min, word_hashes

LENGTH = 50
SEED = LENGTH // 2 + 1
#: One in SHARE sequences is looked at for seeds that FOUND of them have; rows of such seeds are dealt to SALTS parts.
SHARE, FOUND, SALTS = 32, 16, 64


def sequence_hash(hashes: np.ndarray) -> int:
    """Signed 64-bit hash of a whole word sequence."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).view(np.int64)))


def seeds_of(hashes: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each window of ``length`` words, the least hash of its runs of half its length."""
    k = length // 2 + 1
    return sliding_min(runs(hashes, k), length - k + 1)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(as_long(flat)))


def _scanned(length: int):
    def run(batches):
        for b in batches:
            hashes, seeds = [], []
            for t in b.column(1).to_pylist():
                h = word_hashes(t)
                hashes.append(sequence_hash(h) if len(h) >= length else None)
                seeds.append(np.unique(seeds_of(h, length)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hashes, pa.int64()), _lists(seeds)], ["doc_id", "sequence", "seeds"])

    return run


def _shared(batches):
    """(hash, doc_id, hot) rows sorted by both, to the rows of hashes that several documents have; hot ones are known to be.  Holds one row."""
    held = None  # a hash that one document has so far
    open_hash = None  # a hash known to be shared
    for b in batches:
        h, d, hot = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)
        if not len(h):
            continue
        if held is not None:
            h, d, hot = np.concatenate([[held[0]], h]), np.concatenate([[held[1]], d]), np.concatenate([[False], hot])
            held = None
        new = np.concatenate([[True], h[1:] != h[:-1]])
        starts = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        ends = np.append(starts[1:], len(h)) - 1
        several = (d[starts] != d[ends]) | hot[starts]
        if h[0] == open_hash:
            several[0] = True
        open_hash = h[-1] if several[-1] else None
        keep = several[group]
        if open_hash is None:
            held = h[-1], d[-1]
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array(d[keep]), pa.array(hot[keep])], ["hash", "doc_id", "hot"])


def _owned(batches):
    """(hash, doc_id, hot) rows sorted by both, to the rows whose hash a smaller document has, and as ``open`` those of hot hashes
    for which none has it in this task.  Holds one hash and its owner."""
    last = None
    for b in batches:
        h, d, hot = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)
        if not len(h):
            continue
        new = np.concatenate([[True], h[1:] != h[:-1]])
        owner = d[np.flatnonzero(new)]
        if last is not None and h[0] == last[0]:
            owner[0] = last[1]
        last = h[-1], owner[-1]
        later = d > owner[np.cumsum(new) - 1]
        keep = later | hot
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array(d[keep]), pa.array(~later[keep])], ["hash", "doc_id", "open"])


def _windows(length: int):
    """(doc_id, text, seeds, hot seeds) to the hashes of the windows in which a shared seed is least, and whether it is hot."""

    def run(batches):
        for b in batches:
            ends = [c.offsets.to_numpy() - c.offsets.to_numpy()[0] for c in (b.column(2), b.column(3))]
            flat = [c.flatten().to_numpy().view(np.uint64) for c in (b.column(2), b.column(3))]
            docs, parts, hots = b.column(0).to_numpy(), [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                h = word_hashes(t)
                seeds, hot = (f[e[i] : e[i + 1]] for f, e in zip(flat, ends))
                least = seeds_of(h, length)
                found = np.flatnonzero(np.isin(least, seeds))
                windows, at = np.unique(runs(h, length)[found], return_index=True)
                parts.append(windows)
                hots.append(np.isin(least[found[at]], hot))
            made = np.repeat(docs, [len(p) for p in parts])
            if len(made):
                yield pa.RecordBatch.from_arrays([pa.array(as_long(np.concatenate(parts))), pa.array(made), pa.array(np.concatenate(hots))], ["hash", "doc_id", "hot"])

    return run


def _frequent(scanned: DataFrame) -> DataFrame:
    """Seeds that many different documents have: FOUND of those whose sequence's hash is divisible by SHARE.

    It only decides how rows are dealt, so a seed that is missed costs time, not results.
    """
    some = scanned.where((F.col("sequence") % SHARE == 0) & (F.size("seeds") > 0)).dropDuplicates(["sequence"])
    seeds = some.select(F.explode("seeds").alias("hash"))
    return seeds.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FOUND).select("hash", F.lit(True).alias("hot"))


def _dealt(rows: DataFrame) -> DataFrame:
    """(hash, doc_id, hot) rows with equal hashes together, hot ones in SALTS parts, sorted by hash and document."""
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(0)
    return rows.repartition("hash", salt).sortWithinPartitions("hash", "doc_id")


def repeats(docs: DataFrame, length: int = LENGTH, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, windows (hashes of the windows that a smaller document has) and copies (hashes of whole sequences that one has)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    scanned = cut(rows.mapInArrow(_scanned(length), "doc_id long, sequence long, seeds array<long>")).where("sequence IS NOT NULL")
    first = scanned.groupBy("sequence").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = cut(spread(scanned.select("doc_id", "sequence"), first, "sequence").where("doc_id > first").select("doc_id", "sequence").distinct())
    copies = later.groupBy("doc_id").agg(F.collect_set("sequence").alias("copies"))
    seeds = scanned.join(later, ["doc_id", "sequence"], "left_anti").select(F.explode("seeds").alias("hash"), "doc_id")
    hot = small(_frequent(scanned))
    flagged = seeds.withColumn("hot", F.lit(False)) if hot.isEmpty() else seeds.join(hot, "hash", "left").na.fill(False, ["hot"]).select("hash", "doc_id", "hot")
    dealt = _dealt(flagged).mapInArrow(_shared, "hash long, doc_id long, hot boolean")
    wanted = cut(dealt.groupBy("doc_id").agg(F.collect_set("hash").alias("seeds"), F.collect_set(F.when(F.col("hot"), F.col("hash"))).alias("hots")))
    found = rows.join(wanted, "doc_id").mapInArrow(_windows(length), "hash long, doc_id long, hot boolean")
    owned = cut(_dealt(found).mapInArrow(_owned, "hash long, doc_id long, open boolean"))
    # Of a hot window each part has left its least document open; the least of these owns the window.
    still = owned.where("open").withColumn("least", F.min("doc_id").over(Window.partitionBy("hash"))).where("doc_id > least")
    windows = owned.where("NOT open").select("hash", "doc_id").union(still.select("hash", "doc_id")).groupBy("doc_id").agg(F.collect_set("hash").alias("windows"))
    return windows.join(copies, "doc_id", "full_outer")


def covered_words(hashes: np.ndarray, windows: np.ndarray, copies: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which words lie in a window that is removed."""
    n = len(hashes)
    if n < length or not (len(windows) or len(copies)):
        return np.zeros(n, bool)
    if sequence_hash(hashes) in copies:
        return np.ones(n, bool)
    at = np.flatnonzero(np.isin(runs(hashes, length), windows.view(np.uint64)))
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + length, -1)
    return np.cumsum(change[:-1]) > 0


def _cut_out(length: int):
    def run(batches):
        for b in batches:
            windows, copies = b.column("_vwindows").to_pylist(), b.column("_vcopies").to_pylist()
            n_words, n_removed, kept, starts, ends = [], [], [], [], []
            for t, w, c in zip(b.column("_vt").to_pylist(), windows, copies):
                words = (t or b"").split()
                gone = None
                if w or c:
                    gone = covered_words(word_hashes(t or b""), np.array(w or [], np.int64), np.array(c or [], np.int64), length)
                n_words.append(len(words))
                if gone is None or not gone.any():
                    n_removed.append(0)
                    kept.append(b" ".join(words))
                    starts.append(None)
                    ends.append(None)
                else:
                    n_removed.append(int(gone.sum()))
                    kept.append(b" ".join([x for x, g in zip(words, gone.tolist()) if not g]))
                    change = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                    starts.append(change[::2].tolist())
                    ends.append(change[1::2].tolist())
            held = [b.column(i) for i, name in enumerate(b.schema.names) if name not in ("_vt", "_vwindows", "_vcopies")]
            names = [name for name in b.schema.names if name not in ("_vt", "_vwindows", "_vcopies")]
            made = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*held, *made], [*names, "n_words", "n_removed", "kept", "repeat_starts", "repeat_ends"])

    return run


def dedup(docs: DataFrame, keep: list[str], length: int = LENGTH, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns ``keep`` of docs with n_words, n_removed, kept (the words that stay, joined by one space), repeat_starts and
    repeat_ends (the maximal repeats that were removed, as places of words; null if none)."""
    small_batches(docs.sparkSession)
    marks = repeats(docs, length, id, text).select(F.col("doc_id").alias("_vid"), F.col("windows").alias("_vwindows"), F.col("copies").alias("_vcopies"))
    rows = docs.select(*keep, F.col(id).cast("long").alias("_vdoc"), F.col(text).cast("binary").alias("_vt"))
    joined = rows.join(marks, F.col("_vdoc") == F.col("_vid"), "left").drop("_vdoc", "_vid")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-2])
    return joined.mapInArrow(_cut_out(length), f"{fields}, n_words long, n_removed long, kept string, repeat_starts array<int>, repeat_ends array<int>")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = dedup(table(spark, sf_dir, "documents"), ["doc_id"])
    return made.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the repeats that smaller documents hold, with the columns of docs; texts without repeats stay as they
    are, and documents of which nothing is left go."""
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_vrow"))
    made = dedup(whole, ["_vrow"]).where("n_removed = 0 OR n_removed < n_words")
    text = F.when(F.col("n_removed") == 0, F.col("_vrow").getField("text")).otherwise(F.col("kept"))
    return made.select(*((text if c == "text" else F.col("_vrow").getField(c)).alias(c) for c in docs.columns))
