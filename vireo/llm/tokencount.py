"""Token counts: a two-tier lookup of pre-token lengths on the map side.

Tier one is a broadcast table with the lengths of the corpus' most frequent pre-tokens (at most ``TABLE`` entries, found from
bounded per-task counts over all texts); tier two is a bounded cache in each Python worker, filled by encoding the misses
with the library.  No pre-token is shuffled; only the tasks' bounded candidate lists are.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows give repeated results;
very long texts and pre-tokens are counted whole (long pre-tokens aren't cached); other columns of the input are ignored.
Special strings inside texts are matched as the library does by default.  The tables change speed only, never counts.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vireo.llm.common import small_batches, table
from vireo.llm.pretokens import Library, keys, lookup, piece

#: Entries of the broadcast table, candidates a task reports, and the entries at which a task drops its rarest pre-tokens.
TABLE, CANDIDATES, COUNTED = 32_768, 8_192, 200_000
MAX_CHARS = 48


def _candidates(batches):
    """Frequent pre-tokens of a task by lossy counting: beyond COUNTED entries, those seen least are dropped."""
    seen: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                seen.update(keys(text)[1:])
        least = 1
        while len(seen) > COUNTED:
            seen = Counter({k: n for k, n in seen.items() if n > least})
            least *= 2
    top = [(k, n) for k, n in seen.most_common(CANDIDATES) if n > 1 and len(k) <= MAX_CHARS]
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["k", "n"])


def frequent_lengths(docs: DataFrame, tokenizer: str, text: str = "text") -> dict[str, int]:
    """Token counts of the most frequent pre-tokens; at most TABLE entries of at most MAX_CHARS characters."""
    found = docs.select(F.col(text)).mapInArrow(_candidates, "k string, n long")
    best = found.groupBy("k").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "k").limit(TABLE).collect()
    ks = [r.k for r in best]
    return dict(zip(ks, [len(x) // 4 for x in Library.of(tokenizer).encode([piece(k) for k in ks])])) if ks else {}


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 1024, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: its id, ``n_bytes``, ``n_tokens`` and ``over_limit`` (n_tokens > limit)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if tokenizer.endswith(".model"):
        counts = _whole_text_counts(tokenizer)
    else:
        counts = _two_tier_counts(tokenizer, docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, tokenizer, text)))

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            n = pa.array(counts(texts.to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.cast(pc.binary_length(texts), pa.int64()), n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def _two_tier_counts(tokenizer: str, frequent):
    def counts(texts: list[str]) -> list[int]:
        library, table = Library.of(tokenizer), frequent.value
        lengths = lambda pieces: [len(x) // 4 for x in library.encode(pieces)]
        if library.ranked is None:
            return lengths(texts)
        cut = [keys(t) for t in texts]
        out = lengths([ks[0] for ks in cut])  # a text's first pre-token has no white space before it
        rest = []
        for i, ks in enumerate(cut):
            del ks[0]
            found = list(map(table.get, ks))
            if None in found:
                rest.append([k for k, v in zip(ks, found) if v is None])
                out[i] += sum(v for v in found if v is not None)
            else:
                rest.append([])
                out[i] += sum(found)
        return [n + sum(vs) for n, vs in zip(out, lookup(rest, library.counts, lengths))]

    return counts


def _whole_text_counts(model: str):
    made: list = []

    def counts(texts: list[str]) -> list[int]:
        if not made:
            import public_tokenizers
            import sentencepiece

            made.append(sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model)))
        return list(map(len, made[0].encode(texts, num_threads=1))) if texts else []

    return counts


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
