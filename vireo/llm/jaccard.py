"""N-gram Jaccard join in size-banded tiles.

A document's set holds the hashes of its word shingles.  Equal sets are one node.  Sets that can reach the similarity differ in at most
H = (100 - percent) / percent times the smaller size elements.  Sizes fall into bands; a band's sets are split by hash into H + 2
parts, so two sets that link agree in two parts at least, one of which holds something (sets with two empty parts also report
those).  The parts' hashes, packed by bucket, are matched within buckets.  Sets that agree in a part form a group, and each
different group is looked at once: two of its sets stay together unless their odd sketches (bitmaps in which each element
flips a bit) differ in more bits than linked sets can differ in elements.  Groups of over GROUP sets stay together as they
are.  What stays together makes clusters outside of which there are no links.

Clusters are compared in tiles.  Small ones are one tile.  Larger ones are cut into blocks by size band and salt, each tile
holds two blocks of the same or neighbouring bands, and no task gets more than two blocks.  Bands are twice as wide in
logarithms as linked sizes can differ, and only sets whose partners can lie in a neighbouring band go to its tiles.  In a
tile every set has a
hashed bitmap; the bits in which two bitmaps differ bound the overlap from above, and pairs that pass are settled by exact
intersection of the sorted arrays.  Pairs that are connected already are skipped, so a group of n near copies costs about n
intersections, and at most n - 1 links leave a tile.  Components of the links give the classes.

Defined cases: null and blank texts have the empty set, link with nothing and are classes of their own; texts with fewer words
than a shingle have their whole sequence as one shingle; a null id is no class id while the class has another; repeated
rows are copies; an empty table gives no rows; other columns are ignored.  Hashes have 64 bits.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vireo.llm.common import cut, small, small_batches, spread, table
from vireo.llm.components import components, forest
from vireo.llm.shingles import as_long, mix, runs, word_hashes

#: Part hashes of a bucket on average, those a task holds at most, and shingles of a block of a tile.
BUCKET, HELD, BLOCK = 1_000_000, 3_000_000, 4_000_000
#: Nodes up to which those that share a key are held against each other by sketches.
GROUP = 16_384
#: Places of documents in clusters up to which they are broadcast; beyond, texts are dealt by id.
PLACED = 200_000
#: Ratio of a band's sizes; the least similarity of 67 percent reaches the next band only.
RATIO = 1.5


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of text, A-Z lower-cased."""
    h = word_hashes(text.lower())
    if 0 < len(h) < k:
        return mix(runs(h, len(h)) + np.uint64(len(h)))
    return np.unique(runs(h, k))


def set_hash(s: np.ndarray) -> int | None:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64)) if len(s) else None


def band_starts(top: int) -> list[int]:
    out = [1]
    while out[-1] <= top:
        out.append(max(out[-1] + 1, int(np.ceil(out[-1] * RATIO))))
    return out


_STARTS = np.array(band_starts(1 << 40))


def part_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of the parts of a set, for its own band and, where it can be the larger of a pair, the band below."""
    n = len(s)
    own = int(np.searchsorted(_STARTS, n, "right")) - 1
    sums = None
    out = []
    for band in (own, own - 1):
        if band < 0 or band < own and -(-n * percent // 100) >= _STARTS[own]:
            continue
        differ = int(_STARTS[band + 1] - 1) * (100 - percent) // percent
        if not differ:
            continue  # only equal sets link
        k = differ + 2
        if sums is None:
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s), dtype=np.uint64)])
        part = np.arange(1, k, dtype=np.uint64)
        at = np.concatenate([[0], np.searchsorted(s >> np.uint64(32), (part << np.uint64(32)) // np.uint64(k)), [n]])
        keys = mix(sums[at[1:]] - sums[at[:-1]] + np.arange(k, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band * 0xD6E8FEB86659FD93 % (1 << 64)))
        full = at[1:] > at[:-1]
        out.append(keys if k - full.sum() >= 2 else keys[full])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def odd_sketch(s: np.ndarray) -> bytes:
    """A bitmap in which each element flips one bit: two of them differ in at most as many bits as their sets in elements."""
    width = 1 << max(7, int(0.75 * len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes()


def _scanned(k: int):
    def run(batches):
        for b in batches:
            sets = [shingle_set(t or b"", k) for t in b.column(2).to_pylist()]
            made = [pa.array([len(s) for s in sets], pa.int64()), pa.array(list(map(set_hash, sets)), pa.int64()), pa.array([odd_sketch(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], ["doc_id", "row", "n", "node", "sketch"])

    return run


def _dealt(k: int, percent: int, buckets: int):
    """Texts to, for each bucket, the nodes of a batch that have parts there, how many each has, and the parts' hashes."""

    def run(batches):
        seen: set = set()
        for b in batches:
            if len(seen) > 1_000_000:
                seen.clear()
            rows = []
            for t in b.column(0).to_pylist():
                s = shingle_set(t or b"", k)
                node = set_hash(s)
                if node is not None and node not in seen:
                    seen.add(node)
                    if len(keys := part_keys(s, percent)):
                        rows.append((node, keys))
            if not rows:
                continue
            keys = np.concatenate([r[1] for r in rows])
            owner = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
            bucket = (keys % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((owner, bucket))
            keys, owner, bucket = keys[order], owner[order], bucket[order]
            nodes = np.array([r[0] for r in rows], np.int64)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            out = []
            for i, j in zip(cuts[:-1], cuts[1:]):
                own, counts = np.unique(owner[i:j], return_counts=True)
                out.append((int(bucket[i]), nodes[own].tobytes(), counts.astype(np.uint16 if counts.max() < 1 << 16 else np.uint32).tobytes(), keys[i:j].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "nodes", "counts", "keys"])

    return run


def _matched(batches):
    """Packed keys, sorted by bucket, to groups of nodes that share a key, each group once for a bucket.

    A group of more than GROUP nodes, or one that a full task can't hold, comes as pairs with its least node, ``sure`` to stay
    together; the others are held against each other by their sketches.
    """
    at, held, size, thinned = None, [], 0, False

    def grouped(last: bool):
        nonlocal held, size, thinned
        keys, nodes = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((nodes, keys))
        keys, nodes = keys[order], nodes[order]
        again = np.concatenate([[False], (keys[1:] == keys[:-1]) & (nodes[1:] == nodes[:-1])])
        keys, nodes = keys[~again], nodes[~again]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        thinned = thinned or not last
        whole = (sizes > 1) & (sizes <= GROUP) & (not thinned)
        found = {nodes[s : s + n].tobytes() for s, n in zip(starts[whole].tolist(), sizes[whole].tolist())}
        first = np.repeat(nodes[starts], sizes)
        star = np.repeat((sizes > 1) & ~whole, sizes) & (first != nodes)
        a, b = forest(nodes[star], first[star])
        held, size = [(keys[starts], nodes[starts])], len(starts)
        groups = [np.frombuffer(g, np.int64) for g in found] + list(np.stack([b, a], 1))
        if groups:
            ends = np.concatenate([[0], np.cumsum([len(g) for g in groups])])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(groups)))
            yield pa.RecordBatch.from_arrays([lists, pa.array([False] * len(found) + [True] * len(a))], ["members", "sure"])

    for b in batches:
        for bucket, nodes, counts, keys in zip(*(c.to_pylist() for c in b.columns)):
            if bucket != at:
                if held:
                    yield from grouped(True)
                at, held, size, thinned = bucket, [], 0, False
            elif size > HELD:
                yield from grouped(False)
            nodes = np.frombuffer(nodes, np.int64)
            held.append((np.frombuffer(keys, np.uint64), np.repeat(nodes, np.frombuffer(counts, np.uint16 if len(counts) == 2 * len(nodes) else np.uint32))))
            size += len(held[-1][0])
    if held:
        yield from grouped(True)


def _fitting(percent: int):
    """(group, node, n, sketch) rows sorted by group and size to a forest of the nodes that may link."""

    def settle(members):
        if len(members) < 2:
            return
        width = min(len(x) for _, _, x in members)
        maps = np.zeros((len(members), width // 8), np.uint64)
        for i, (_, _, x) in enumerate(members):
            maps[i] = np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, width // 8))  # folded to the least width
        nodes, n, label = [m[0] for m in members], np.array([m[1] for m in members]), np.arange(len(members))
        until = np.searchsorted(n, n * 100 // percent, "right")
        for i in range(len(members) - 1):
            j = np.arange(i + 1, until[i])
            j = j[label[j] != label[i]]
            if not len(j):
                continue
            apart = np.bitwise_count(maps[j] ^ maps[i]).sum(1, dtype=np.int64)
            j = j[apart * (100 + percent) <= (100 - percent) * (n[j] + n[i])]
            if len(j):
                yield from ((nodes[i], nodes[x]) for x in j.tolist())
                label[np.isin(label, label[j])] = label[i]

    def run(batches):
        at, members = None, []
        for b in batches:
            out = []
            for group, node, n, sketch in zip(*(c.to_pylist() for c in b.columns)):
                if group != at:
                    out += settle(members)
                    at, members = group, []
                members.append((node, n, sketch))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])
        if out := list(settle(members)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    return run


def _tiled(k: int):
    """Documents with their place in a cluster to rows of tiles: (tile, side, node, set)."""

    def run(batches):
        seen: set = set()
        for b in batches:
            out = []
            for text, node, cluster, band, salt, own, below, above, whole in zip(*(c.to_pylist() for c in b.columns)):
                if node in seen:
                    continue  # a repeated row
                s = shingle_set(text, k)
                if set_hash(s) != node:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(node)
                if whole:
                    tiles = [((cluster,), 0)]
                else:
                    tiles = [((cluster, band, min(salt, t), max(salt, t)), int(t < salt)) for t in range(own)]
                    tiles += [((cluster, band - 1, "up", t, salt), 1) for t in range(below)] + [((cluster, band, "up", salt, t), 0) for t in range(above)]
                bits = s.tobytes()
                out += [(int(np.uint64(xxhash.xxh3_64_intdigest(repr(t))).view(np.int64)), side, node, bits) for t, side in tiles]
                if len(out) > 200:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], ["tile", "side", "node", "elements"])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], ["tile", "side", "node", "elements"])

    return run


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """Hashed bitmaps of sets, two bits or more for each element of the largest."""
    width = 1 << max(8, min(14, int(2 * max(map(len, sets)) - 1).bit_length()))
    out = np.zeros((len(sets), width // 64), np.uint64)
    for i, s in enumerate(sets):
        bit = np.zeros(width, bool)
        bit[(s & np.uint64(width - 1)).astype(np.int64)] = True
        out[i] = np.packbits(bit, bitorder="little").view(np.uint64)
    return out


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def tile_links(nodes: np.ndarray, sets: list[np.ndarray], sides: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect what similarity connects in a tile: of one side with itself, or of two sides with each other."""
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    nodes, sides, size, sets = nodes[order], sides[order], size[order], [sets[i] for i in order]
    maps, label, links = bitmaps(sets), np.arange(len(sets)), []
    two = bool((sides != sides[0]).any())
    until = np.searchsorted(size, size * 100 // percent, "right")
    for i in range(len(sets)):
        j = np.arange(i + 1, until[i])
        j = j[label[j] != label[i]]
        if two:
            j = j[sides[j] != sides[i]]
        if not len(j):
            continue
        apart = np.bitwise_count(maps[j] ^ maps[i]).sum(1, dtype=np.int64)
        most = (size[j] + size[i] - apart) // 2  # of the overlap
        j = j[100 * most >= percent * (size[j] + size[i] - most)]
        while len(j):
            x, j = int(j[0]), j[1:]
            both = common(sets[i], sets[x])
            if 100 * both >= percent * (size[i] + size[x] - both):
                links.append((int(nodes[i]), int(nodes[x])))
                label[label == label[x]] = label[i]
                j = j[label[j] != label[i]]
    return links


def _compared(percent: int):
    def run(tile: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, np.uint64) for x in tile.column("elements").to_pylist()]
        nodes, where = np.unique(tile.column("node").to_numpy(), return_index=True)
        links = tile_links(nodes, [sets[i] for i in where], tile.column("side").to_numpy()[where], percent)
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*links) if links else ((), ()))], ["a", "b"])

    return run


def labelled(docs: DataFrame, k: int, percent: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row (xxhash64 of the text), n_shingles, label (of the class; null for empty sets): one row per row of docs.

    percent: the least similarity, 67 to 100; below that the parts of sets that are sure to be shared become too many.
    """
    if not 67 <= percent <= 100:
        raise ValueError("percent must lie between 67 and 100")
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), F.col(text).cast("binary").alias("text"))
    scanned = cut(rows.mapInArrow(_scanned(k), "doc_id long, row long, n long, node long, sketch binary"))
    # About so many parts: those of the own band, and of the band below for some.
    total = (scanned.agg(F.sum("n")).first()[0] or 0) * (100 - percent) / percent * RATIO
    buckets = max(1, math.ceil(total / BUCKET))
    dealt = rows.where("text IS NOT NULL").select("text").mapInArrow(_dealt(k, percent, buckets), "bucket long, nodes binary, counts binary, keys binary")
    groups = cut(dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_matched, "members array<long>, sure boolean").distinct())
    sets = scanned.where("node IS NOT NULL").groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    members = groups.where("NOT sure").select(F.xxhash64("members").alias("group"), F.explode("members").alias("node")).join(sets, "node")
    fits = members.select("group", "node", "n", "sketch").repartition("group").sortWithinPartitions("group", "n").mapInArrow(_fitting(percent), "a long, b long")
    near = components(fits.union(groups.where("sure").select(F.col("members")[0], F.col("members")[1])))
    roots = near.select(F.col("label").alias("node"), "label").distinct()
    placed = scanned.groupBy("node").agg(F.min(F.struct("doc_id", "row")).alias("at"), F.first("n").alias("n")).join(near.union(roots).withColumnRenamed("label", "cluster"), "node")
    links = components(_links(rows, cut(placed), k, percent))
    label = F.coalesce("label", "node")
    found = spread(scanned.select("doc_id", "row", F.col("n").alias("n_shingles"), "node"), links, "node", "left")
    return found.select("doc_id", "row", "n_shingles", label.alias("label"))


def jaccard_classes(docs: DataFrame, k: int = 3, percent: int = 90, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row (xxhash64 of the text), n_shingles, component_id: one row per row of docs."""
    nodes = cut(labelled(docs, k, percent, id, text))
    least = nodes.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("least"))
    return spread(nodes, least, "label", "left").select("doc_id", "row", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def _links(rows: DataFrame, placed: DataFrame, k: int, percent: int) -> DataFrame:
    """A forest of the links between the nodes of each cluster (placed: node, at, n, cluster)."""
    def band(n):
        return F.floor(F.log(n.cast("double")) / float(2 * np.log(100 / percent)) + 1e-9).cast("long") if percent < 100 else n

    least, most = F.ceil(F.col("n") * percent / 100 - 1e-6), F.floor(F.col("n") * 100 / percent + 1e-6)  # sizes of partners
    placed = placed.withColumn("band", band(F.col("n"))).withColumn("down", band(least) < F.col("band")).withColumn("up", band(most) > F.col("band"))
    blocks = placed.groupBy("cluster", "band").agg(F.ceil(F.sum("n") / BLOCK).alias("own"), F.sum("n").alias("size"))
    whole = placed.groupBy("cluster").agg((F.sum("n") <= BLOCK).alias("whole"))
    next_to = lambda d, name: blocks.select("cluster", (F.col("band") + d).alias("band"), F.col("own").alias(name))
    sized = blocks.select("cluster", "band", "own").join(next_to(1, "below"), ["cluster", "band"], "left").join(next_to(-1, "above"), ["cluster", "band"], "left").join(whole, "cluster").na.fill(0)
    at = placed.join(sized, ["cluster", "band"]).select(F.col("at.doc_id").alias("_doc"), F.col("at.row").alias("_row"), "node", "cluster", "band", F.pmod(F.xxhash64("node"), "own").alias("salt"), "own", F.when(F.col("down"), F.col("below")).otherwise(0).alias("below"), F.when(F.col("up"), F.col("above")).otherwise(0).alias("above"), "whole")
    at = small(at, PLACED)
    texts = rows.join(at, (F.col("row") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_doc")))
    tiles = texts.select("text", "node", "cluster", "band", "salt", "own", "below", "above", "whole").mapInArrow(_tiled(k), "tile long, side int, node long, elements binary")
    return tiles.groupBy("tile").applyInArrow(_compared(percent), "a long, b long")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of five-word shingles with a similarity of 0.8, with the columns of docs: that of the smallest id
    (nulls last), then of the smallest hash of the text; of rows equal in both, any one.  Rows with the empty set all stay."""
    held = cut(labelled(docs, k=5, percent=80).where("label IS NOT NULL").groupBy("label", "doc_id", "row").agg(F.count(F.lit(1)).alias("n")))
    first = held.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row") == F.col("first.row"))
    judged = spread(held, first, "label").select(F.col("doc_id").alias("v_doc"), F.col("row").alias("v_hash"), "n", stays.alias("stays"))
    whole = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.struct(*docs.columns).alias("whole"))
    same = F.col("doc_id").eqNullSafe(F.col("v_doc")) & (F.col("hash") == F.col("v_hash"))
    kept = whole.join(small(judged.where("NOT stays").select("v_doc", "v_hash")), same, "left_anti")
    repeated = small(judged.where("stays AND n > 1").select("v_doc", "v_hash"))
    if repeated.isEmpty():
        return kept.select("whole.*")
    once = kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, same, "left_anti").unionByName(once).select("whole.*")
