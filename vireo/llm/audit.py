"""Filter interaction audit: what each of five filters removes in every order, by part of the corpus.

Filters (a document fails): A under 200 words, B less than half of the words distinct, C more than 2 % of the characters in A-Z,
D holding any of #$%&*|, E the text of a document with a smaller id, wherever that one is and whether or not it is removed.

E is found by routing texts to the partition of their xxhash fingerprint.  There, rows sorted by fingerprint are kept as one
collision chain at a time, with each full text and its least id; ids that aren't the least fail.  Tasks that read documents
keep such chains too, up to ``HELD`` bytes of text, and send each text on once, so the copies of a hot text don't meet in one
task.  Documents, with their failures as a mask of five bits, meet their labels in a combineByKey by id; a second one merges
vectors of counts by mask and label for each part.  The 120 orders are read off these vectors.  Sorting and merging spill.

Defined cases: null text counts as empty; null part as ''; a null id has no smaller id, is smaller than none and has no labels;
repeated rows count each and are no copies of each other; a document has a label if any of its label rows has it; texts of
any length are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from itertools import permutations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vireo.llm.common import table

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 200, 50, 2, b"#$%&*|"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
#: Bytes of text that a task keeps in chains before it sends them on.
HELD = 32 << 20
#: Bytes of text that a partition of fingerprints gets, about.
PARTITION = 64 << 20
GOOD, TOXIC = 1, 2
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failures(text: str) -> int:
    """Filters A to D that text fails, as bits in their order."""
    data = text.encode()
    words = data.split()
    n = len(words)
    capitals = len(data) - len(data.translate(None, CAPITALS))
    tests = n < MIN_WORDS, 100 * len(set(words)) < DISTINCT_PERCENT * n, 100 * capitals > CAPITAL_PERCENT * len(text), len(data.translate(None, SYMBOLS)) < len(data)
    return sum(1 << i for i, failed in enumerate(tests) if failed)


class Chains:
    """Texts by fingerprint; each with its least id, its failures, and the rows that have both by part."""

    def __init__(self) -> None:
        self.by_fingerprint: dict[int, list[list]] = {}
        self.size = 0

    def add(self, fingerprint: int, text: str, mask: int, id: int, parts: Counter):
        """Rows (id, part, mask, n) that are now known not to have their text's least id."""
        chain = self.by_fingerprint.setdefault(fingerprint, [])
        for held in chain:
            if held[0] == text:
                break
        else:
            chain.append([text, mask, id, Counter(parts)])
            self.size += len(text)
            return
        if id == held[2]:
            held[3].update(parts)
            return
        lost_id, lost = id, parts
        if id < held[2]:
            lost_id, lost = held[2:]
            held[2:] = id, Counter(parts)
        for part, n in lost.items():
            yield lost_id, part, mask | COPY, n

    def emptied(self):
        for fingerprint, chain in self.by_fingerprint.items():
            for text, mask, id, parts in chain:
                yield fingerprint, (text, mask, id, dict(parts))
        self.by_fingerprint, self.size = {}, 0


def _local(held: int):
    """Rows to be routed by fingerprint; keys below 0, dealt evenly, have rows (id, part, mask, n) that are decided here."""

    def run(rows):
        chains, key = Chains(), 0
        for id, part, text in rows:
            mask = failures(text)
            if id is None:
                decided = [(id, part, mask, 1)]
            else:
                decided = chains.add(xxhash.xxh3_64_intdigest(text.encode()), text, mask, id, Counter({part: 1}))
            for row in decided:
                key -= 1
                yield key, row
            if chains.size > held:
                yield from chains.emptied()
        yield from chains.emptied()

    return run


def _routed(rows):
    """Rows sorted by key, to (id, part, mask, n); one chain is kept at a time."""
    chains, now = Chains(), None
    for key, row in rows:
        if key < 0:
            yield row
            continue
        if key != now:
            yield from _least(chains)
            now = key
        text, mask, id, parts = row
        yield from chains.add(key, text, mask, id, Counter(parts))
    yield from _least(chains)


def _least(chains: Chains):
    for _, (_, mask, id, parts) in chains.emptied():
        for part, n in parts.items():
            yield id, part, mask, n


def _place(key) -> int:
    """Partition of an id or part; independent of Python's own hashing."""
    return xxhash.xxh3_64_intdigest(str(key).encode())


def _merge_rows(a: list, b: list) -> list:
    a[0] |= b[0]
    a[1].update(b[1])
    return a


def _merge_value(a: list, value: tuple) -> list:
    flags, row, n = value
    a[0] |= flags
    if n:
        a[1][row] += n
    return a


def _vector(value: tuple[int, int]) -> np.ndarray:
    return _add(np.zeros(4 << len(FILTERS), np.int64), value)


def _add(vector: np.ndarray, value: tuple[int, int]) -> np.ndarray:
    vector[value[0]] += value[1]
    return vector


def orders(vector: np.ndarray) -> list[tuple]:
    """For each order and step its numbers, from counts by mask and label flags (vector[4 * mask + flags])."""
    counts = vector.reshape(-1, 4)
    masks = np.arange(len(counts))
    n, good, toxic = counts.sum(1), counts[:, [GOOD, GOOD | TOXIC]].sum(1), counts[:, [TOXIC, GOOD | TOXIC]].sum(1)
    rows, share = [], Counter()
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            alive, fails = masks & before == 0, masks & bit > 0
            here = alive & fails
            removed = int(n[here].sum())
            share[name] += removed
            rows.append(["".join(order), step, int(n[alive & ~fails].sum()), removed, int(n[~alive & fails].sum()), int(n[bit]), int(good[here].sum()), int(toxic[here].sum())])
            before |= bit
    return [(*r, share[r[0][r[1] - 1]]) for r in rows]


def audit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "source", held: int = HELD) -> DataFrame:
    """Rows of SCHEMA: for each part, order of the filters and step what is kept, removed, redundant and lost.

    labels: (doc_id, quality, toxic), where 1 means good or toxic.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id).cast("long"), F.coalesce(F.col(part), F.lit("")), F.coalesce(F.col(text), F.lit(""))).rdd
    # shuffles of RDDs aren't resized while they run, so partitions are sized by the texts
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(rows.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION))
    decided = rows.mapPartitions(_local(held)).repartitionAndSortWithinPartitions(n, lambda key: key if key < 0 else key >> 8).mapPartitions(_routed)
    flags = labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").select(F.col("doc_id").cast("long"), F.when(F.col("quality") == 1, GOOD).otherwise(0) + F.when(F.col("toxic") == 1, TOXIC).otherwise(0)).rdd
    mine = decided.map(lambda r: (r[0], (0, (r[1], r[2]), r[3])))
    by_id = mine.union(flags.map(lambda r: (r[0], (r[1], None, 0)))).combineByKey(lambda v: _merge_value([0, Counter()], v), _merge_value, _merge_rows, n, _place)
    counted = by_id.flatMap(lambda r: [(part, (4 * mask + r[1][0], k)) for (part, mask), k in r[1][1].items()])
    vectors = counted.combineByKey(_vector, _add, np.add, n, _place)
    return spark.createDataFrame(vectors.flatMap(lambda r: [(r[0], *row) for row in orders(r[1])]), SCHEMA)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Copies by a window over equal texts, counts by part and mask, then all orders.
ORACLE_OP11 = """WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
  list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
f AS (SELECT doc_id, part, CAST(len(ws) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 50 * len(ws) AS INT)
  + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t) AS INT) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
  + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INT) AS mask FROM w),
l AS (SELECT doc_id, coalesce(max(CAST(quality = 1 AS INT)), 0) AS good, coalesce(max(CAST(toxic = 1 AS INT)), 0) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l ON l.doc_id = f.doc_id GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (SELECT concat(p.x, q.x, r.x, s.x, t.x) AS o, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps AS (SELECT o, i AS step, bits[i] AS bit, coalesce(list_sum(bits[1:i - 1]), 0)::INT AS before FROM orders, range(1, 6) AS z(i)),
d AS (SELECT part, o, step, bit, sum(n) FILTER (mask & before = 0 AND mask & bit = 0) AS kept, sum(n) FILTER (mask & before = 0 AND mask & bit > 0) AS removed,
  sum(n) FILTER (mask & before > 0 AND mask & bit > 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
  sum(good) FILTER (mask & before = 0 AND mask & bit > 0) AS good_lost, sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0) AS toxic_lost FROM c, steps GROUP BY part, o, step, bit)
SELECT part, o AS filter_order, CAST(step AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, bit), 0) AS BIGINT) AS shapley FROM d"""
