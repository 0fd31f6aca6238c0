"""Language-model scoring: a gated recurrent model with a class-factored softmax, in numpy inside Spark tasks.

Counts.  Word counts cover every training text: tasks split a batch of texts with Arrow and hash each of its distinct words
once, Spark sums their counts.  The most frequent words, at most TABLE, of
those seen twice or more, are broadcast; other words of a text are joined with the counts by hash, so no table that grows
with the vocabulary is sent around.  Words seen once stay out, so that training meets the classes of rare words.

Model.  P(word) = P(class | state) P(word | class, state).  The HEAD most frequent words form classes of PER_CLASS with
neural softmaxes; other words are classed by their ending and by whether they are in the table, and share a class in
proportion to count + 1.  Each class of words outside the table keeps a share for unseen words, so probabilities add up
to 1.  The state is a gated recurrence over embeddings of words or classes; it starts empty with each document and is
carried across windows to its end, so a text is scored whole.

Training.  The weights start as the class-factored unigram model.  All documents of the training fold are dealt to
ROUNDS by id and text, each to one, and within a round to parts of about PART tokens.  A part's documents, in the order of a
hash, train the common weights by truncated backpropagation over all their tokens; the weights are averaged over parts, by their
tokens, in levels of at most 64.  The number of parts grows with the corpus, and neither it nor what a part holds depends on how the
input is split into tasks, so scores don't either.

Scoring runs documents of like lengths side by side.

Defined cases: null text is empty, its one token is the end; a null id counts as the empty text for the fold; repeated rows are
counted and scored each; an empty table gives no rows; without training documents every word is unseen; other columns are
ignored.  Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vireo.llm.common import crc_mod, cut, small_batches, table

FOLDS, HELD_OUT = 7, 2
TABLE, HEAD, PER_CLASS, ENDINGS = 1 << 18, 1024, 64, 16
HEADS = HEAD // PER_CLASS
CLASSES = HEADS + 2 * ENDINGS
INPUTS = HEAD + 2 * ENDINGS
HIDDEN, ROUNDS = 24, 3
STREAMS, STEPS, RATE = 512, 8, 0.03
#: Tokens of a part, about.
PART = 1 << 21
#: Tokens that each stream holds at least before streams advance; states that are settled and texts that are scored at once.
SPAN, SETTLED, WIDE = 128, 65_536, 1024
#: States of a softmax layer at once when scoring, so that they stay in the processor's cache.
CACHED = 2048
BATCH, PIECE = 6000, 4 << 20
END = b"\n"
#: Steps of the grid of counts, as logarithms.
GRID = 0.02
RARE = 1 << 62


def ending(word: bytes) -> int:
    return zlib.crc32(word.rstrip(b".,;:!?")[-3:]) % ENDINGS


def word_key(word: bytes) -> int:
    """A 62-bit hash whose low bits are the class by ending."""
    return (xxhash.xxh3_64_intdigest(word) >> 2) // ENDINGS * ENDINGS + ending(word)


END_KEY = word_key(END)


def word_keys(words: pa.Array) -> np.ndarray:
    """word_key of each word of an array of strings; the empty one is the end."""
    tails = pc.binary_slice(pc.ascii_rtrim(words, characters=".,;:!?").cast(pa.binary()), -3, None).dictionary_encode()
    kinds = np.array([zlib.crc32(tail) % ENDINGS for tail in tails.dictionary.to_pylist()], np.int64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words.cast(pa.binary()).to_numpy(zero_copy_only=False)), np.uint64, len(words))
    keys = (hashes >> 2).astype(np.int64) // ENDINGS * ENDINGS + kinds[tails.indices.to_numpy()]
    return np.where(pc.binary_length(words).to_numpy() == 0, END_KEY, keys)


def pieces(texts: pa.Array):
    """Slices of texts (binary) of about PIECE bytes, which bound the copies that splitting makes."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // PIECE)) + 1
    for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)]):
        yield texts.slice(start, end - start)


def split(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Numbers of words of texts (binary), the distinct words, and the place of each word there.

    An empty word after each text stands for its end.  Arrow splits at the same characters as bytes.split().
    """
    lower = pc.ascii_lower(pc.cast(pc.fill_null(texts, b""), options=pc.CastOptions(target_type=pa.string(), allow_invalid_utf8=True)))
    trimmed = pc.ascii_trim_whitespace(lower)
    words = pc.ascii_split_whitespace(pc.if_else(pc.equal(trimmed, ""), "", pc.binary_join_element_wise(trimmed, "", " ")))
    told = words.flatten().dictionary_encode()
    return pc.list_value_length(words).to_numpy(), told.dictionary, told.indices.to_numpy()


def _counted(batches):
    for b in batches:
        for piece in pieces(b.column(0)):
            _, words, places = split(piece)
            yield pa.RecordBatch.from_arrays([pa.array(word_keys(words)), pa.array(np.bincount(places, minlength=len(words)))], ["key", "n"])


def count_words(texts: DataFrame) -> DataFrame:
    """key, n over one binary text column; one end is counted for each text."""
    return texts.mapInArrow(_counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


class Lexicon:
    """The broadcast part of the counts: the table by key, and sums by class."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, total: int, distinct: int, rare_n: np.ndarray, rare_v: np.ndarray):
        """keys in order of rank, the end first."""
        self.place = np.argsort(keys)
        self.keys = keys[self.place]
        self.total, self.distinct = total, distinct
        rank, kind = np.arange(len(keys)), keys % ENDINGS
        self.cls = np.where(rank < HEAD, rank // PER_CLASS, HEADS + kind)
        self.input = np.where(rank < HEAD, rank, HEAD + kind)
        self.log_count = np.log10(counts + 1.0)
        mass = np.bincount(self.cls, counts + 1.0, CLASSES)
        mass[HEADS + ENDINGS :] = rare_n + rare_v + 1.0
        self.log_mass = np.log10(np.maximum(mass, 1.0))
        self.start = np.where(mass > 0, np.log(np.maximum(mass, 1.0) / mass.sum()), -30).astype(np.float32)  # classes without words get nothing
        within = np.full(HEAD, -20, np.float32)
        within[: min(HEAD, len(keys))] = np.log(counts[:HEAD] + 1.0)
        self.within = within.reshape(HEADS, PER_CLASS)

    def coded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places in the table, or RARE + key, of the words and ends of texts (binary), and where each text begins among them."""
        sizes, codes = [np.zeros(1, np.int64)], []
        for piece in pieces(texts):
            n, words, places = split(piece)
            keys = word_keys(words)
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            sizes.append(n)
            codes.append(np.where(self.keys[at] == keys, self.place[at], RARE + keys)[places])
        return np.concatenate(codes), np.cumsum(np.concatenate(sizes), dtype=np.int64)

    def codes(self, text: bytes) -> np.ndarray:
        """The same of one text."""
        return self.coded(pa.array([text], pa.binary()))[0]

    def classed(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and input of each code."""
        rare = codes >= RARE
        kind = codes & (ENDINGS - 1)  # RARE is a multiple of ENDINGS, a power of two
        at = np.where(rare, 0, codes)
        return np.where(rare, HEADS + ENDINGS + kind, self.cls[at]), np.where(rare, HEAD + ENDINGS + kind, self.input[at])


def lexicon(counts: DataFrame) -> Lexicon:
    """From (key, n); the driver gets at most TABLE rows and sums by class."""
    total, distinct = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    # The least count whose words fit the table, from a histogram on a grid of counts, so that only the table's rows are sent.
    step_of = F.floor(F.log(F.col("n").cast("double")) / GRID).cast("long")
    least, room = None, TABLE
    for r in counts.where((F.col("key") != END_KEY) & (F.col("n") > 1)).groupBy(step_of.alias("s")).agg(F.count(F.lit(1)).alias("v")).orderBy(F.desc("s")).collect():
        room -= r.v
        if room <= 0:
            break
        least = r.s
    top = counts.where((F.col("key") != END_KEY) & (F.col("n") > 1) & (step_of >= least if least is not None else F.lit(False))).toPandas().sort_values(["n", "key"], ascending=[False, True])
    ends = counts.where(F.col("key") == END_KEY).first()
    keys, n = np.append(END_KEY, top.key.to_numpy(np.int64)), np.append(ends.n if ends else 0, top.n.to_numpy(np.int64))
    by_kind = {r.kind: (r.n, r.v) for r in counts.groupBy((F.col("key") % ENDINGS).alias("kind")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    rare_n, rare_v = (np.array([by_kind.get(k, (0, 0))[i] for k in range(ENDINGS)], np.float64) for i in (0, 1))
    known = n > 0
    rare_n -= np.bincount((keys % ENDINGS)[known], n[known], ENDINGS)
    rare_v -= np.bincount((keys % ENDINGS)[known], minlength=ENDINGS)
    return Lexicon(keys, n, total or 0, distinct, rare_n, rare_v)


SHAPES = {"embed": (INPUTS, 2 * HIDDEN), "turn": (HIDDEN, 2 * HIDDEN), "bias": (2 * HIDDEN,), "cls": (HIDDEN, CLASSES), "cls_bias": (CLASSES,), "word": (HEADS, HIDDEN, PER_CLASS), "word_bias": (HEADS, PER_CLASS)}


#: Places in a table of embeddings, by input.
CELLS = np.arange(INPUTS * 2 * HIDDEN).reshape(INPUTS, 2 * HIDDEN)


def first_weights(lex: Lexicon) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(5)
    w = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in SHAPES.items()}
    w["embed"] *= 5
    w["bias"][:] = 0
    w["cls"] *= 0.1
    w["word"] *= 0.1
    w["cls_bias"], w["word_bias"] = lex.start.copy(), lex.within.copy()
    return w


def packed(w: dict[str, np.ndarray]) -> bytes:
    return np.concatenate([w[k].ravel() for k in SHAPES]).astype(np.float32).tobytes()


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    """The weights by name, as views of one array."""
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s)
        at += n
    return out


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    return views(np.frombuffer(data, np.float32).copy())


def recur(w, h: np.ndarray, pre: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """One step of the recurrence.  pre: inputs' embeddings and bias; overwritten by twice the gates less one, and the candidates.

    Gates and candidates are squashed by x / (1 + |x|), which numpy does several times as fast as exponentials.
    """
    pre += h @ w["turn"]
    size = np.abs(pre)
    size += 1
    pre /= size
    z, c = 0.5 + 0.5 * pre[:, :HIDDEN], pre[:, HIDDEN:]
    return np.add(h, z * (c - h), out=out)


def _layer(h: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """A softmax layer's logits less their largest, one column a state: numpy reduces columns faster than short rows."""
    x = weights.T @ h.T
    x += bias[:, None]
    x -= x.max(0)
    return x


def _log_soft(h: np.ndarray, weights: np.ndarray, bias: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log of a softmax layer's probability of each state's target."""
    out = np.empty(len(h), np.float32)
    for at in range(0, len(h), CACHED):
        part = slice(at, at + CACHED)
        x = _layer(h[part], weights, bias)
        own = x[target[part], np.arange(x.shape[1])]
        np.exp(x, out=x)
        out[part] = own - np.log(np.ones(len(x), np.float32) @ x)
    return out


def _by_head(cls: np.ndarray):
    """(class, places) for each class of the head that occurs in cls."""
    order = np.argsort(cls.astype(np.uint16), kind="stable")
    ends = np.searchsorted(cls[order], np.arange(HEADS + 1))
    for k in range(HEADS):
        if ends[k] < ends[k + 1]:
            yield k, order[ends[k] : ends[k + 1]]


def log_probs(w, h: np.ndarray, cls: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Natural log of P(class | h), times P(word | class, h) for words of the head."""
    out = _log_soft(h, w["cls"], w["cls_bias"], cls)
    for k, rows in _by_head(cls):
        out[rows] += _log_soft(h.take(rows, 0), w["word"][k], w["word_bias"][k], code[rows] - k * PER_CLASS)
    return out


def _blame(h: np.ndarray, weights: np.ndarray, bias: np.ndarray, target: np.ndarray, n: int):
    """Gradients of a softmax layer's mean loss over n tokens: of its weights, its bias and the states."""
    x = _layer(h, weights, bias)
    np.exp(x, out=x)
    x *= 1 / (n * (np.ones(len(x), np.float32) @ x))
    x[target, np.arange(len(h))] -= 1 / n
    return h.T @ x.T, x @ np.ones(len(h), np.float32), x.T @ weights.T


class Trainer:
    """Truncated backpropagation over documents that arrive one by one, in STREAMS side by side.

    A document goes to the stream with the fewest tokens left and stays whole; streams advance together by windows of STEPS
    tokens, and states and the optimiser's moments are carried from window to window.  ``finish`` cuts what is left into
    streams of equal length, so that no token is dropped.
    """

    def __init__(self, weights: bytes, lex: Lexicon):
        self.lex, self.flat = lex, np.frombuffer(weights, np.float32).copy()
        self.grad, self.m, self.v = (np.zeros_like(self.flat) for _ in range(3))
        self.w, self.g = views(self.flat), views(self.grad)
        self.beat = self.n = 0
        self._start(STREAMS)

    def _start(self, streams: int) -> None:
        self.h, self.last = np.zeros((streams, HIDDEN), np.float32), np.zeros(streams, np.int64)  # the end comes before a text
        self.queues: list[list[np.ndarray]] = [[] for _ in range(streams)]
        self.left = np.zeros(streams, np.int64)

    def feed(self, codes: np.ndarray) -> None:
        k = int(self.left.argmin())
        self.queues[k].append(codes)
        self.left[k] += len(codes)
        if self.left.min() >= SPAN:
            self._advance(int(self.left.min()) // STEPS * STEPS)

    def _advance(self, length: int) -> None:
        rows = np.empty((len(self.queues), length), np.int64)
        for k, queue in enumerate(self.queues):
            whole = queue[0] if len(queue) == 1 else np.concatenate(queue)
            rows[k], queue[:] = whole[:length], [whole[length:]]
        self.left -= length
        self._learn(rows.T)

    def finish(self) -> None:
        rest = np.concatenate([c for queue in self.queues for c in queue] or [np.zeros(0, np.int64)])
        if len(rest):
            streams = max(1, min(STREAMS, len(rest) // STEPS))
            rows = np.full((streams, -(-len(rest) // streams)), -1, np.int64)
            rows.ravel()[: len(rest)] = rest
            self._start(streams)
            self._learn(rows.T)

    def _learn(self, codes: np.ndarray) -> None:
        """codes: one column a stream; -1 where there is no token."""
        there = codes >= 0
        cls, inputs = self.lex.classed(np.where(there, codes, 0).ravel())
        cls, inputs = cls.reshape(codes.shape), inputs.reshape(codes.shape)
        for at in range(0, len(codes), STEPS):
            part = slice(at, at + STEPS)
            xs = np.concatenate([self.last[None], inputs[part][:-1]])
            self._window(xs, cls[part].ravel(), codes[part].ravel(), np.flatnonzero(there[part].ravel()))
            self.last = inputs[part][-1]

    def _window(self, xs: np.ndarray, cls: np.ndarray, code: np.ndarray, there: np.ndarray) -> None:
        w, g, (steps, streams) = self.w, self.g, xs.shape
        live = (xs != 0).astype(np.float32)[:, :, None]
        pre = (w["embed"] + w["bias"]).take(xs, 0)
        before, after = np.empty((2, steps, streams, HIDDEN), np.float32)
        h = self.h
        for t in range(steps):
            before[t] = h * live[t]
            h = recur(w, before[t], pre[t], after[t])
        self.h = h
        slope = 1 - np.abs(pre)  # of the squashing: its square
        slope *= slope
        z, c = 0.5 + 0.5 * pre[:, :, :HIDDEN], pre[:, :, HIDDEN:]
        states, back = after.reshape(-1, HIDDEN), np.zeros((steps * streams, HIDDEN), np.float32)
        if len(there) < len(states):
            states, cls, code = states[there], cls[there], code[there]
        self.grad[:] = 0
        n = len(states)
        g["cls"][:], g["cls_bias"][:], blame = _blame(states, w["cls"], w["cls_bias"], cls, n)
        for k, rows in _by_head(cls):
            g["word"][k], g["word_bias"][k], own = _blame(states.take(rows, 0), w["word"][k], w["word_bias"][k], code[rows] - k * PER_CLASS, n)
            blame[rows] += own
        if n < len(back):
            back[there] = blame
        else:
            back = blame
        back = back.reshape(steps, streams, HIDDEN)
        to_z, to_c, keep = 0.5 * (c - before) * slope[:, :, :HIDDEN], z * slope[:, :, HIDDEN:], 1 - z
        pres, ahead, turned = np.empty((steps, streams, 2 * HIDDEN), np.float32), np.zeros((streams, HIDDEN), np.float32), w["turn"].T.copy()
        for t in range(steps - 1, -1, -1):
            dh = back[t] + ahead
            np.multiply(dh, to_z[t], out=pres[t, :, :HIDDEN])
            np.multiply(dh, to_c[t], out=pres[t, :, HIDDEN:])
            ahead = (dh * keep[t] + pres[t] @ turned) * live[t]
        pres = pres.reshape(-1, 2 * HIDDEN)
        g["turn"][:] = before.reshape(-1, HIDDEN).T @ pres
        g["embed"][:] = np.bincount(CELLS.take(xs.ravel(), 0).ravel(), pres.ravel(), INPUTS * 2 * HIDDEN).reshape(INPUTS, 2 * HIDDEN)
        g["bias"][:] = g["embed"].sum(0)
        self.beat += 1
        self.n += n
        self.m += 0.1 * (self.grad - self.m)
        self.v += 0.001 * (self.grad * self.grad - self.v)
        self.flat -= RATE / (1 - 0.9**self.beat) * self.m / (np.sqrt(self.v / (1 - 0.999**self.beat)) + 1e-8)


def dealt(sample: DataFrame, tokens: int) -> DataFrame:
    """text, round, part and order of (id, text) rows with so many tokens, by hashes of both."""
    by = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "id", "text"), F.lit(n))
    return sample.select("text", by(0, ROUNDS).alias("round"), by(1, max(1, -(-tokens // (ROUNDS * PART)))).alias("part"), F.xxhash64("id", "text").alias("order"))


def fit(sample: DataFrame, lex: Lexicon) -> dict[str, np.ndarray]:
    """Weights after ROUNDS of averaging; sample: id, text (binary)."""
    spark, w = sample.sparkSession, first_weights(lex)
    sent = spark.sparkContext.broadcast(lex)
    rows = dealt(sample, lex.total)

    def averaged(tables: pa.Table) -> pa.Table:
        tables = tables.sort_by("part")
        n = tables.column("n").to_numpy().astype(np.float64)
        flat = [np.frombuffer(x, np.float32) for x in tables.column("w").to_pylist()]
        mean = sum(x * (k / n.sum()) for x, k in zip(flat, n)).astype(np.float32)
        return pa.table([pa.array([tables.column("part")[0].as_py() // 64]), pa.array([int(n.sum())]), pa.array([mean.tobytes()], pa.binary())], ["part", "n", "w"])

    for r in range(ROUNDS):
        weights = packed(w)

        def trained(batches, weights=weights):
            own = at = None

            def told():
                own.finish()
                return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([own.n], pa.int64()), pa.array([own.flat.tobytes()], pa.binary())], ["part", "n", "w"])

            for b in batches:
                codes, starts = sent.value.coded(b.column(0))
                for start, end, part in zip(starts, starts[1:], b.column(1).to_pylist()):
                    if part != at:
                        if own is not None:
                            yield told()
                        own, at = Trainer(weights, sent.value), part
                    own.feed(codes[start:end].copy())  # a view would hold the whole batch
            if own is not None:
                yield told()

        ordered = rows.where(F.col("round") == r).select("text", "part", "order").repartition("part").sortWithinPartitions("part", "order").select("text", "part")
        made = cut(ordered.mapInArrow(trained, "part long, n long, w binary"))
        while (k := made.count()) > 1:
            made = cut(made.groupBy(F.expr("part DIV 64")).applyInArrow(averaged, "part long, n long, w binary"))
        if k:
            w = unpacked(bytes(made.first().w))
    return w


def _score(w, lex: Lexicon, codes: list[np.ndarray]) -> np.ndarray:
    """log10 probabilities of texts, but for the shares of words outside the table within their classes."""
    out = np.zeros(len(codes))
    order = sorted(range(len(codes)), key=lambda i: -len(codes[i]))
    for at in range(0, len(order), WIDE):  # of like lengths, and few enough to stay in the processor's cache
        part = order[at : at + WIDE]
        out[part] = _score_together(w, lex, [codes[i] for i in part])
    return out


def _score_together(w, lex: Lexicon, codes: list[np.ndarray]) -> np.ndarray:
    """The same for texts that run side by side, the longest first."""
    sizes = np.array([len(c) for c in codes])
    flat = np.concatenate(codes)
    cls, inputs = lex.classed(flat)
    start = np.cumsum(sizes) - sizes
    out = np.zeros(len(codes))
    h = np.zeros((len(codes), HIDDEN), np.float32)
    x = np.zeros(len(codes), np.int64)
    embed = w["embed"] + w["bias"]
    states, places, held = [], [], 0

    def settle():
        at = np.concatenate(places)
        code = flat[at]
        lp = log_probs(w, np.concatenate(states), cls[at], code) / np.log(10)
        tail = (code >= HEAD) & (code < RARE)
        lp = lp.astype(np.float64)
        lp[tail] += lex.log_count[code[tail]] - lex.log_mass[cls[at[tail]]]
        rare = code >= RARE
        lp[rare] -= lex.log_mass[cls[at[rare]]]
        out[: len(codes)] += np.bincount(np.concatenate([np.arange(len(p)) for p in places]), lp, len(codes))
        states.clear()
        places.clear()

    live = len(codes)
    for t in range(int(sizes[0])):
        while sizes[live - 1] <= t:
            live -= 1
        pre = embed.take(x[:live], 0)
        h = recur(w, h[:live], pre)
        at = start[:live] + t
        states.append(h)
        places.append(at)
        x = inputs[at]
        held += live
        if held > SETTLED:
            settle()
            held = 0
    if states:
        settle()
    return out


def score(docs: DataFrame, counts: DataFrame, lex: Lexicon, w: dict[str, np.ndarray], id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score: one row per row of docs."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((lex, packed(w)))
    rows = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"), F.monotonically_increasing_id().alias("row"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "row", "n_tokens", "known", "base", "scored", "rare", "times"]

    def run(batches):
        lex, weights = sent.value[0], unpacked(sent.value[1])
        for b in batches:
            if not len(b):
                continue
            codes, starts = lex.coded(b.column(1))
            in_table = codes < RARE
            x = np.where(in_table, lex.log_count[np.where(in_table, codes, 0)], 0.0)
            base, known = np.add.reduceat(x, starts[:-1]), np.add.reduceat(x > 0, starts[:-1], dtype=np.int64)
            # each text's distinct words outside the table and how often it has them
            keys, nth = np.unique(codes[~in_table] - RARE, return_inverse=True)
            doc = np.searchsorted(starts, np.flatnonzero(~in_table), "right") - 1
            pairs, times = np.unique(doc * max(1, len(keys)) + nth, return_counts=True)
            ends = pa.array(np.searchsorted(pairs, np.arange(len(b) + 1) * max(1, len(keys))), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int64))) for v in (keys[pairs % max(1, len(keys))], times)]
            made = [pa.array(np.diff(starts)), pa.array(known), pa.array(base), pa.array(_score(weights, lex, np.split(codes, starts[1:-1]))), *lists]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *made], names)

    part = cut(rows.mapInArrow(run, f"doc_id {kind}, row long, n_tokens long, known long, base double, scored double, rare array<long>, times array<long>"))
    # a row for each document and distinct word outside the table
    rare = part.select("row", F.inline(F.arrays_zip(F.col("rare").alias("key"), F.col("times").alias("times")))).join(counts, "key")
    sums = rare.groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("extra"))
    least = float(np.log10(lex.total + lex.distinct + 1.0))
    extra, more = F.coalesce("extra", F.lit(0.0)), F.coalesce("more", F.lit(0))
    whole = part.drop("rare", "times").join(sums, "row", "left")
    return whole.select("doc_id", "n_tokens", (F.col("known") + more).alias("n_known"), (F.col("base") + extra - F.col("n_tokens") * F.lit(least)).alias("base_score"), (F.col("scored") + extra).alias("score"))


def score_documents(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Learns from the rows of the training fold and scores all rows: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    small_batches(docs.sparkSession, BATCH)
    learned = docs.where(crc_mod(id, FOLDS) != HELD_OUT).select(F.col(id).alias("id"), F.col(text).cast("binary").alias("text"))
    counts = cut(count_words(learned.select("text")))
    lex = lexicon(counts)
    made = score(docs, counts, lex, fit(learned, lex), id, text)
    return made.select("doc_id", (crc_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "n_tokens", "n_known", F.lit(int(lex.total)).cast("long").alias("train_tokens"), "base_score", "score")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
