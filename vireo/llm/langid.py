"""Language identification by error-correcting output codes.

Each language has a codeword of bits.  For each bit a binary n-gram classifier (multinomial, hashed character 1- to 3-grams
with word ends, one vote a language) tells the languages with that bit from those without.  A text's mean log-odds by bit are decoded by
loss-weighted distance: each codeword loses log(1 + exp(-margin)) for each bit, weighted by how well the bit separates the
training counts; the codeword that loses least wins.  A text is flagged ``ambiguous`` if the two best lose about the same.

The n-gram counts cover every training text.  Tasks count words first, so n-grams are made once per distinct word, and emit
their counts by language whenever they hold many.  The log-odds of a feature are made in a task from its counts by language, so the driver gets
FEATURES rows of two numbers a bit; bits grow with the logarithm of the number of languages, of which there may be any.
Scoring looks words up in bounded worker caches, so whole texts of any length are read.

Defined cases: null text, or text without a letter, gives ``und`` with score 0; rows with null lang or text are not learned
from; without training rows everything is ``und``; with one
language every text with a letter is that language; repeated rows are learned from each; a null id counts as the empty text
for the fold; other columns are ignored.  Predictions use the text alone.
"""

from __future__ import annotations

from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vireo.llm.common import crc_mod, cut, small_batches, table

FEATURES, FOLDS, HELD_OUT = 1 << 15, 4, 2
#: Languages whose n-grams a task counts at once, and numbers that decoding holds at once.
COUNTED, DECODED = 64, 1 << 22
#: Words a worker counts or keeps scores of at most.
WORDS = 150_000
#: Scale of the mean log-odds before decoding, and the score below which a prediction is ambiguous.
SHARPNESS, AMBIGUOUS = 8.0, 0.4

_LETTER = np.zeros(0x110000, bool)


def _letters() -> np.ndarray:
    if not _LETTER[97]:
        _LETTER[:] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of words and, for each, the place of its word.  A letter gives itself, the pair and the triple around it."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    c[~_letters()[c]] = 0
    at = np.flatnonzero(c)
    word = np.searchsorted(np.cumsum(sizes), at - 1, "right")
    one, before, after = c[at], c[at - 1], c[at + 1]
    ends = at[after == 0]
    grams = np.concatenate([one * 4, (before * 0x110000 + one) * 4 + 1, c[ends] * 0x110000 * 4 + 1, (before * 0x110000 + one) * 0x3FFFFF + after * 4 + 2])
    x = grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(49)).astype(np.int64) % FEATURES, np.concatenate([word, word, word[after == 0], word])


def words_of(text: str) -> list[str]:
    return text.lower().split()


def _counts(langs: list[str]):
    """(lang, text) rows to (place of lang, feature, count), for one task."""
    place = {x: i for i, x in enumerate(langs)}

    def run(batches):
        seen: dict[int, Counter] = {}
        totals: dict[int, np.ndarray] = {}

        def counted():
            for i, words in seen.items():
                total = totals.setdefault(i, np.zeros(FEATURES))
                pairs = iter(words.items())
                while part := list(islice(pairs, 20_000)):
                    grams, word = features([w for w, _ in part])
                    total += np.bincount(grams, np.array([n for _, n in part], np.float64)[word], FEATURES)
            seen.clear()

        def told():
            for i, total in totals.items():
                f = np.flatnonzero(total)
                if len(f):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f), i, np.int32)), pa.array(f, pa.int32()), pa.array(total[f].astype(np.int64))], ["lang", "feature", "n"])
            totals.clear()

        held = 0
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = seen.setdefault(place[lang], Counter())
                held -= len(words)
                words.update(words_of(text))
                held += len(words)
                if held > WORDS or len(seen) > COUNTED:
                    counted()
                    held = 0
                    if len(totals) > COUNTED:
                        yield from told()
        counted()
        yield from told()

    return run


def codewords(n: int) -> np.ndarray:
    """n codewords of -1 and 1: every split of the languages for up to 5; beyond, the best separated of seeded random codes."""
    if n <= 5:
        return np.array([[1 if i == 0 or (split >> (i - 1)) & 1 else -1 for split in range(2 ** (n - 1) - 1)] for i in range(n)]).reshape(n, -1)
    rng, bits = np.random.default_rng(7), int(np.ceil(10 * np.log2(n)))
    if n > CHOSEN:  # too many to compare all; random codes of this length are well apart, and none may be there twice
        while True:
            code = rng.choice(np.array([-1, 1], np.int8), (n, 2 * bits))
            code = code[:, np.abs(code.sum(0, dtype=np.int64)) < n]
            if len(np.unique(code, axis=0)) == n:
                return code
    best = None
    for _ in range(50):
        code = rng.choice([-1, 1], (n, bits))
        code = code[:, np.abs(code.sum(0)) < n]
        apart = (code.shape[1] - code @ code.T)[~np.eye(n, dtype=bool)].min()
        if best is None or apart > best[0]:
            best = apart, code
    return best[1]


#: Languages up to which the best separated of several codes is chosen.
CHOSEN = 512


def log_odds(counts: np.ndarray, totals: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds by feature and bit, and how well each feature tells the bit (its part of the symmetric divergence), from counts by language
    and feature and the languages' totals."""
    share = (counts + 0.05) / (totals[:, None] + 0.05 * FEATURES)
    has = (code > 0).astype(float)
    one, other = (share.T @ (h / h.sum(0)) for h in (has, 1 - has))
    odds = np.log(one / other)
    return odds, (one - other) * odds


class Model:
    """Languages, codewords, weights of the bits, and log-odds by feature and bit."""

    def __init__(self, langs: list[str], code: np.ndarray, odds: np.ndarray, trust: np.ndarray):
        self.langs, self.code, self.odds = langs, code, odds.astype(np.float32)
        told = trust.sum(0)  # how well each bit can be told
        self.trust = told / (told.sum() or 1)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best language's place and score of each row of mean log-odds."""
        if len(self.langs) == 1:
            return np.zeros(len(margins), np.int64), np.ones(len(margins))
        best, score = np.zeros(len(margins), np.int64), np.zeros(len(margins))
        step = max(1, DECODED // self.code.size)
        for at in range(0, len(margins), step):
            loss = np.logaddexp(0, -SHARPNESS * margins[at : at + step, None, :] * self.code[None]) @ self.trust
            x = np.exp(2 * (loss.min(1, keepdims=True) - loss))
            best[at : at + step] = x.argmax(1)
            score[at : at + step] = x.max(1) / x.sum(1)
        return best, score


def fit(rows: DataFrame, lang: str = "lang", text: str = "text") -> Model:
    """Counts n-grams of all rows by language; the driver gets the languages' names and, for each feature, two numbers a bit."""
    small_batches(rows.sparkSession)
    rows = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    langs = sorted(r.lang for r in rows.select("lang").distinct().collect())
    code = codewords(len(langs)) if langs else np.zeros((0, 0))
    bits = code.shape[1]
    totals = np.zeros(len(langs))
    odds, trust = np.zeros((2, FEATURES, bits))
    if bits:
        counts = cut(rows.mapInArrow(_counts(langs), "lang int, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")))
        for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect():
            totals[r.lang] = r.n

        def made(batches):
            for b in batches:
                places, ns = b.column("langs"), b.column("ns").flatten().to_numpy()
                held = np.zeros((len(langs), b.num_rows))
                held[places.flatten().to_numpy(), np.repeat(np.arange(b.num_rows), np.diff(places.offsets.to_numpy()))] = ns
                both = log_odds(held, totals, code)
                yield pa.RecordBatch.from_arrays([b.column("feature"), *(pa.array(list(v), pa.list_(pa.float64())) for v in both)], ["feature", "odds", "trust"])

        by_feature = counts.groupBy("feature").agg(F.collect_list(F.struct("lang", "n")).alias("c")).select("feature", F.col("c.lang").alias("langs"), F.col("c.n").alias("ns"))
        got = by_feature.mapInArrow(made, "feature int, odds array<double>, trust array<double>").toArrow()
        odds[:], trust[:] = (v[0] for v in log_odds(np.zeros((len(langs), 1)), totals, code))  # of features that no text has
        at = got.column("feature").to_numpy()
        odds[at], trust[at] = (got.column(c).combine_chunks().flatten().to_numpy().reshape(-1, bits) for c in ("odds", "trust"))
    return Model(langs, code, odds, trust)


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` of docs with lang_pred, score and ambiguous."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col(text).alias("_vt"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches):
        model, place = sent.value, {}
        bits = model.odds.shape[1]
        scores = np.zeros((WORDS + 1, bits + 1), np.float32)  # the last column counts n-grams

        def learn(words):
            grams, word = features(words)
            sums = np.zeros((len(words), bits + 1), np.float32)
            for k in range(bits):
                sums[:, k] = np.bincount(word, model.odds[grams, k], len(words))
            sums[:, bits] = np.bincount(word, minlength=len(words))
            return sums

        for b in batches:
            margins, has = [], []
            for t in b.column(b.num_columns - 1).to_pylist():
                words = words_of(t) if t and model.langs else []
                total = np.zeros(bits + 1)
                new = list({w for w in words if w not in place})
                if len(place) + len(new) > WORDS:
                    place.clear()
                    new = list(set(words))
                if len(new) > WORDS:  # more distinct words than a worker keeps: in parts
                    for at in range(0, len(words), WORDS):
                        total += learn(words[at : at + WORDS]).sum(0, dtype=np.float64)
                elif words:
                    made = learn(new)
                    scores[len(place) : len(place) + len(new)] = made
                    place.update(zip(new, range(len(place), len(place) + len(new))))
                    at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
                    total = scores[at].sum(0, dtype=np.float64)
                has.append(total[bits] > 0)
                margins.append(total[:bits] / max(total[bits], 1))
            if not has:
                continue
            has = np.array(has)
            best, score = model.decode(np.array(margins).reshape(len(has), bits)) if model.langs else (np.zeros(len(has), np.int64), np.zeros(len(has)))
            names = [model.langs[i] if h else "und" for i, h in zip(best.tolist(), has)]
            score = np.where(has, score, 0.0)
            columns = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(score), pa.array(score < AMBIGUOUS)], [*b.schema.names[:-1], "lang_pred", "score", "ambiguous"])

    return rows.mapInArrow(run, f"{fields}, lang_pred string, score double, ambiguous boolean")


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(crc_mod("doc_id", FOLDS) != HELD_OUT)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    made = predict(docs, fit(training_rows(docs)), ["doc_id"])
    return made.select("doc_id", (crc_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score", "ambiguous")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, with the columns of docs; those without letters or with ambiguous language go."""
    whole = docs.select(F.struct(*docs.columns).alias("_vrow"), "text")
    made = predict(whole, fit(training_rows(docs)), ["_vrow"])
    return made.where("lang_pred <> 'und' AND NOT ambiguous").select("_vrow.*")
