"""Operators and pipeline stages against plain versions in Python, and under forced hot keys."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from vireo.llm import ann, common, jaccard, langid, lm, packing, quality, substrings

SPACE = re.compile("[^\\x20\\x09-\\x0D]+")


def words_of(text):
    return SPACE.findall(text or "")


# Quality rules ------------------------------------------------------------------------------------------------------


def plain_measures(text):
    text = text or ""
    words = words_of(text)
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {p for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for p in range(i, i + 5)}
    lines = [y for y in text.split("\n") if words_of(y)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall("[#*$%&|<>]", text)), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def plain_failed(m):
    return m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"]


def rates(m):
    part = lambda a, b: m[a] / m[b] if m[b] else None
    mean = part("word_chars", "n_words")
    return {"symbols": part("n_symbols", "word_chars"), "dup_lines": part("n_dup_lines", "n_lines"), "repeats": part("n_repeat_words", "n_words"), "long_words": mean, "short_words": None if mean is None else -mean}


def rejecting(m, level):
    return [r for r, v in rates(m).items() if v is not None and v > quality.RULES[r][1][level - 1]]


def plain_levels(docs, labels):
    """Strictest certified level of each stratum, by summing binomial terms."""
    good, by = {d for d, q in labels if q == 1}, defaultdict(dict)
    for d, lang, text in docs:
        m = plain_measures(text)
        if d in good and not plain_failed(m):
            by[lang or "*"][d] = m
    out = {}
    for stratum, own in by.items():
        n, best = len(own), None
        for level in range(1, quality.LEVELS + 1):
            k = sum(bool(rejecting(m, level)) for m in own.values())
            tail = sum(math.comb(n, i) * quality.RISK**i * (1 - quality.RISK) ** (n - i) for i in range(k + 1))
            if k >= n * quality.RISK or tail > quality.LEVEL / len(by):
                break
            best = level
        out[stratum] = best
    return out


def corpus(n=900, seed=5):
    """Documents of three languages with junk, copies, near copies and shared passages, null and empty texts, and labels."""
    rng = random.Random(seed)
    stems = {"en": "the of and to in that was with for his", "fr": "le de un que et dans les des pour qui", "de": "der die und den von das mit sich ist nicht"}
    vocabulary = {lang: s.split() + ["".join(rng.choice(s.replace(" ", "")) for _ in range(rng.randint(3, 8))) for _ in range(400)] for lang, s in stems.items()}
    prose = lambda lang, k: " ".join(rng.choice(vocabulary[lang]) for _ in range(k))
    passage, docs, labels = prose("en", 70), [], []
    for d in range(n):
        lang = ["en", "en", "fr", "de"][d % 4] if d % 50 else None
        text = prose(lang or "en", rng.randint(40, 120))
        if d % 9 == 0:
            text = " ".join("#$%&*"[rng.randrange(5)] * 3 + w for w in text.split())
        elif d % 11 == 0:
            text += " " + passage
        elif d % 13 == 0 and d > 100:
            text = docs[d - 52][2] or ""  # of the same language
        elif d % 17 == 0:
            w = (docs[d - 4][2] or "x").split() if d >= 4 else ["x"]
            text = " ".join([*w[:-1], "changed"])
        docs.append((d, lang, text))
        labels.append((d, int(not re.search("[#$%&*]{3}", text))))
    docs += [(n, "en", None), (n + 1, "en", ""), (None, "en", prose("en", 60)), (n + 2, "fr", "12 34 56 78 90 12 34 11 22 33 44 55"), docs[3], docs[3]]
    return docs, labels


@pytest.fixture(scope="module")
def small_sf(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    docs, labels = corpus()
    spark.createDataFrame([(d, t, lang, "s", len(t or "")) for d, lang, t in docs], "doc_id long, text string, lang string, source string, n_chars long").coalesce(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(d, q, 0) for d, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), docs, labels


def test_cutoffs_are_certified(spark, small_sf):
    at, docs, labels = small_sf
    measured = common.cut(quality.measures(common.table(spark, at, "documents"), ["doc_id", "lang"]))
    got = {r.stratum: r.asDict() for r in quality.cutoffs(measured, common.table(spark, at, "labels")).collect()}
    want = plain_levels(docs, labels)
    assert {s: r["level"] for s, r in got.items()} == want and sum(v is not None for v in want.values()) >= 1 and None in want.values()
    for s, r in got.items():
        assert all(r[f"cut_{k}"] == (grid[want[s] - 1] if want[s] else None) for k, (_, grid) in quality.RULES.items())
    judged = quality.judge(measured, quality.cutoffs(measured, common.table(spark, at, "labels"))).collect()
    level = lambda lang: want.get(lang if lang in want else "*")
    texts = {d: (lang, t) for d, lang, t in docs}
    for r in judged:
        lang, text = texts[r.doc_id]
        m = plain_measures(text)
        assert r.kept == (not plain_failed(m) and not (level(lang) and rejecting(m, level(lang))))
    assert sum(not r.base_failed and not r.kept for r in judged) > 40


# Language ID --------------------------------------------------------------------------------------------------------


def plain_grams(word):
    """Hashed n-grams of a word, one by one."""
    c = [0, *(ord(x) if x.isalpha() else 0 for x in word), 0]
    out = []

    def put(g):
        x = g * 0x9E3779B97F4A7C15 & (1 << 64) - 1
        x ^= x >> 29
        x = x * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
        out.append((x >> 49) % langid.FEATURES)

    for i in range(1, len(c) - 1):
        if c[i]:
            pair = c[i - 1] * 0x110000 + c[i]
            put(c[i] * 4)
            put(pair * 4 + 1)
            put(pair * 0x3FFFFF + c[i + 1] * 4 + 2)
            if not c[i + 1]:
                put(c[i] * 0x110000 * 4 + 1)
    return out


def plain_language(docs):
    """(id, text) to language and score, learned from the training fold."""
    counts = defaultdict(Counter)
    for d, lang, text in docs:
        if zlib.crc32(b"" if d is None else str(d).encode()) % 4 != 2 and lang is not None and text is not None:
            for w in text.lower().split():
                counts[lang].update(plain_grams(w))
    langs = sorted(counts)
    code = langid.codewords(len(langs))
    share = {x: {f: (n + 0.05) / (sum(counts[x].values()) + 0.05 * langid.FEATURES) for f, n in counts[x].items()} for x in langs}
    none = {x: 0.05 / (sum(counts[x].values()) + 0.05 * langid.FEATURES) for x in langs}
    of = lambda x, f: share[x].get(f, none[x])
    sides = [([x for x, c in zip(langs, bit) if c > 0], [x for x, c in zip(langs, bit) if c < 0]) for bit in code.T]
    odds = lambda f, b: math.log((sum(of(x, f) for x in b[0]) / len(b[0])) / (sum(of(x, f) for x in b[1]) / len(b[1])))
    trust = []
    for b in sides:
        mean = lambda xs, f: sum(of(x, f) for x in xs) / len(xs)
        trust.append(sum((mean(b[0], f) - mean(b[1], f)) * odds(f, b) for f in range(langid.FEATURES)))
    trust = [t / sum(trust) for t in trust]

    def predict(text):
        grams = [g for w in (text or "").lower().split() for g in plain_grams(w)]
        if not grams:
            return "und", 0.0
        margins = [sum(odds(f, b) for f in grams) / len(grams) for b in sides]
        losses = [sum(t * math.log1p(math.exp(-langid.SHARPNESS * m * c)) for t, m, c in zip(trust, margins, row)) for row in code.tolist()]
        x = [math.exp(2 * (min(losses) - v)) for v in losses]
        return langs[losses.index(min(losses))], max(x) / sum(x)

    return predict


def test_language_decoding(spark, small_sf):
    at, docs, _ = small_sf
    df = common.table(spark, at, "documents")
    predict, seen = plain_language(docs), 0
    for r in langid.predict(df, langid.fit(langid.training_rows(df)), ["doc_id", "text"]).collect():
        if r.doc_id is None or r.doc_id % 6 == 0 or r.doc_id >= 900:
            lang, score = predict(r.text)
            assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-4)
            seen += 1
    assert seen > 150


def test_every_letter_counts(spark):
    df = spark.createDataFrame([(k, "the cat sat", "en") for k in range(5)] + [(k, "le chat dort", "fr") for k in range(5, 9)] + [(20, "\U00030000\U00030001", None), (21, "\U00020000", None), (22, "12 ٣ -", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(df, langid.fit(df), ["doc_id"]).collect()}
    assert got[20] != "und" and got[21] != "und" and got[22] == "und"


def test_any_number_of_languages(spark, monkeypatch):
    """Three hundred languages of their own words, learned in tasks that hold counts of a few at a time."""
    monkeypatch.setattr(langid, "COUNTED", 7)
    rng = random.Random(9)
    words = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for _ in range(300)]
    rows = [(i * 4 + k, " ".join(rng.choice(words[i]) for _ in range(60)), f"l{i}") for i in range(300) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.fit(df)
    got = langid.predict(df, model, ["lang"]).collect()
    assert len(model.langs) == 300 and sum(r.lang == r.lang_pred for r in got) > 0.98 * len(got)
    code = langid.codewords(langid.CHOSEN + 100)
    assert len({tuple(c) for c in code.tolist()}) == len(code)


def test_every_language_is_a_stratum(spark):
    """A hundred languages; one with enough good labels is certified by itself."""
    measured = spark.createDataFrame([(i, f"l{i % 100}" if i % 101 else None, 50, 250, 0, 0, 0, 5) for i in range(60_000)], "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long")
    cuts = quality.cutoffs(measured, measured.select("doc_id", F.lit(1).alias("quality"))).collect()
    assert len(cuts) == 101 and sum(r.level is not None for r in cuts) == 100 + (sum(1 for i in range(60_000) if i % 101 == 0) > 400)


# Language model -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("piece", [1, 500, lm.PIECE])
def test_words_of_a_batch(monkeypatch, piece):
    """Batches of texts are split, hashed and looked up as their words would be one by one."""
    monkeypatch.setattr(lm, "PIECE", piece)
    rng = random.Random(6)
    odd = [None, b"", b" \t\n\x0b\x0c\r ", b"  A b ", b"\nb\x1cB a\x85a\x0ba\xc2\xa0a", "É é ÀB.;".encode(), b"\xff\xfe A \xc3", b"a.,;:!? ... x", b"b" * 300]
    texts = odd + [" ".join(rng.choice("aBcdé.") * rng.randint(1, 5) for _ in range(rng.randint(0, 40))).encode() for _ in range(200)]
    words = [(t or b"").lower().split() + [lm.END] for t in texts]
    counts = Counter(lm.word_key(w) for ws in words for w in ws)
    batch = pa.array([b"left out", *texts], pa.binary())[1:]
    got: Counter = Counter()
    for b in lm._counted([pa.RecordBatch.from_arrays([batch], ["text"]), pa.RecordBatch.from_arrays([batch[:0]], ["text"])]):
        got.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist())))
    assert got == counts
    top = [k for k, n in counts.most_common() if n > 2 and k != lm.END_KEY]
    lex = lm.Lexicon(np.array([lm.END_KEY, *top]), np.array([counts[k] for k in [lm.END_KEY, *top]]), sum(counts.values()), len(counts), np.ones(lm.ENDINGS), np.ones(lm.ENDINGS))
    place = {k: i for i, k in enumerate([lm.END_KEY, *top])}
    want = [[place.get(k, lm.RARE + k) for k in map(lm.word_key, ws)] for ws in words]
    codes, starts = lex.coded(batch)
    assert [codes[a:b].tolist() for a, b in zip(starts, starts[1:])] == want and len(starts) == len(texts) + 1
    assert lex.codes(texts[4]).tolist() == want[4] and any(c >= lm.RARE for c in codes)


def test_probabilities_add_up(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 4) + rng.choice(["", "ing", "."]) for _ in range(rng.randint(3, 60))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("CAST(text AS BINARY) AS text")
    lex = lm.lexicon(common.cut(lm.count_words(df)))
    trainer = lm.Trainer(lm.packed(lm.first_weights(lex)), lex)
    for t in texts:
        trainer.feed(lex.codes(t.encode()))
    trainer.finish()
    assert trainer.n == sum(len(t.split()) + 1 for t in texts)  # no token is dropped
    w, h = lm.unpacked(trainer.flat.tobytes()), np.random.default_rng(2).uniform(-1, 1, (3, lm.HIDDEN)).astype(np.float32)
    codes = np.arange(len(lex.cls))
    cls, _ = lex.classed(codes)
    for state in h:
        lp = lm.log_probs(w, np.repeat(state[None], len(codes), 0), cls, codes).astype(float)
        tail = codes >= lm.HEAD
        lp[tail] += np.log(10) * (lex.log_count[codes[tail]] - lex.log_mass[cls[tail]])
        rare = np.arange(lm.HEADS + lm.ENDINGS, lm.CLASSES)  # of words outside the table, the unseen included
        other = lm.log_probs(w, np.repeat(state[None], len(rare), 0), rare, np.full(len(rare), lm.RARE))
        assert np.exp(lp).sum() + np.exp(other).sum() == pytest.approx(1, abs=1e-4)


def test_gradients(spark):
    """Steps against the gradient of the loss of one window, by differences."""
    df = spark.createDataFrame([("a b c a b d e f a b " * 20,)], "text string").selectExpr("CAST(text AS BINARY) AS text")
    lex = lm.lexicon(common.cut(lm.count_words(df)))
    trainer, rng = lm.Trainer(lm.packed(lm.first_weights(lex)), lex), np.random.default_rng(3)
    trainer.flat[:] += rng.standard_normal(len(trainer.flat)).astype(np.float32) * 0.1
    codes = rng.integers(0, len(lex.cls), (lm.STEPS, 3))
    cls, inputs = (x.reshape(codes.shape) for x in lex.classed(codes.ravel()))
    xs = np.concatenate([np.zeros((1, 3), np.int64), inputs[:-1]])

    def loss():
        h, total = np.zeros((3, lm.HIDDEN), np.float32), 0.0
        for t in range(lm.STEPS):
            h = lm.recur(trainer.w, h * (xs[t] != 0)[:, None], trainer.w["embed"][xs[t]] + trainer.w["bias"])
            total -= lm.log_probs(trainer.w, h, cls[t], codes[t]).sum(dtype=np.float64)
        return total / codes.size

    trainer._start(3)
    held = trainer.flat.copy()
    trainer._window(xs, cls.ravel(), codes.ravel(), np.arange(codes.size))
    grad = {k: v.copy() for k, v in trainer.g.items()}
    trainer.flat[:] = held
    for name, own in grad.items():
        view = trainer.w[name]
        for at in rng.permutation(np.flatnonzero(np.abs(own.ravel()) > 1e-3))[:6]:
            place = np.unravel_index(at, view.shape)
            keep = view[place]
            view[place] = keep + 1e-2
            up = loss()
            view[place] = keep - 1e-2
            down = loss()
            view[place] = keep
            assert own[place] == pytest.approx((up - down) / 2e-2, rel=0.05, abs=1e-3), name


def test_held_out_texts_score_better_than_the_base(spark):
    made = lm.op6_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").selectExpr("sum(score) / sum(n_tokens) AS score", "sum(base_score) / sum(n_tokens) AS base").first()
    assert made.score > made.base + 0.1


# Neighbours, joins and repeats under hot keys ---------------------------------------------------------------------------


def test_nearest_with_nulls_repeats_and_lengths(spark, monkeypatch):
    """Several groups and salts; null ids, repeated rows, ids with several vectors, vectors of other lengths."""
    monkeypatch.setattr(ann, "ROWS", 16)
    monkeypatch.setattr(ann, "GROUP", 20)
    monkeypatch.setattr(ann, "SALTED", 30)
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(8 if i % 5 else 12).round(2).tolist()) for i in range(200)]
    rows += [rows[7], rows[7], (50, rng.standard_normal(12).tolist()), (None, rows[9][1]), (-50, rows[11][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    got = sorted(map(tuple, ann.nearest(df, df.where("vec_id % 10 = 0")).collect()))
    known = [(i, np.array(v)) for i, v in dict.fromkeys((i, tuple(v)) for i, v in rows if i is not None)]
    want = []
    for q in sorted({i for i, _ in known if i % 10 == 0}):
        v = np.array(min(tuple(x) for i, x in known if i == q))
        near = sorted((-x @ v / np.linalg.norm(x) / np.linalg.norm(v), i) for i, x in known if i != q and len(x) == len(v))[:5]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(near, 1)]
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want])


def test_hot_keys_change_nothing(spark, small_sf, monkeypatch):
    """The same rows where every frequent key is spread."""
    at, _, _ = small_sf
    df = common.table(spark, at, "documents")
    plain = sorted(map(str, jaccard.jaccard_classes(df, 5, 80).collect())), sorted(map(str, substrings.dedup(df, ["doc_id"]).collect()))
    monkeypatch.setattr(common, "HOT", 1)
    for k, v in (("SHARE", 1), ("FOUND", 3), ("SALTS", 5)):
        monkeypatch.setattr(substrings, k, v)
    assert substrings._frequent(df.mapInArrow(lambda b: b, df.schema).selectExpr("doc_id", "1L AS sequence", "array(1L) AS seeds")).count() == 0  # one sequence
    spread = sorted(map(str, jaccard.jaccard_classes(df, 5, 80).collect())), sorted(map(str, substrings.dedup(df, ["doc_id"]).collect()))
    assert plain == spread


# Packing --------------------------------------------------------------------------------------------------------------


def test_packing_is_whole_and_even(spark, small_sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    at, docs, _ = small_sf
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = Counter()
    for d, _, text in docs:
        ids[d, tuple(t.encode(text or "", add_special_tokens=False).ids) + (0,)] += 1
    pieces = packing.digest(packing.pack(common.table(spark, at, "documents"))).collect()
    by = defaultdict(list)
    for r in pieces:
        by[r.doc_id, r.doc_tokens].append(r)
    want, got = Counter(), Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces)
    for (d, held), n in ids.items():
        cuts = sorted({(r.start, r.length) for r in by[d, len(held)]})
        assert [s for s, _ in cuts] == [0, *np.cumsum([x for _, x in cuts])[:-1]] and sum(x for _, x in cuts) == len(held)
        for s, x in cuts:
            want[d, s, x, zlib.crc32(np.array(held[s : s + x], "<u4").tobytes()), len(held)] += n
    assert got == want
    filled = Counter()
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled[r.sequence_id]
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 1024 and sum(filled.values()) / len(filled) > 0.95 * 1024
    sizes = [random.Random(k).randint(1, 256) for k in range(400)]
    sums = [sum(sizes[i] for i in g) for g in packing.windows_of(sizes)]
    assert max(sums) <= 1024 and max(sums) - min(sums) <= 8 and sorted(i for g in packing.windows_of(sizes) for i in g) == list(range(400))


# The pipeline ----------------------------------------------------------------------------------------------------------


def plain_run(docs, labels):
    """Texts by id after each of the first four stages, in order of the rows."""
    levels = plain_levels(docs, labels)
    kept, out = [], []
    for d, lang, text in docs:
        m, level = plain_measures(text), levels.get(lang if lang in levels else "*")
        if not plain_failed(m) and not (level and rejecting(m, level)):
            kept.append((d, lang, text))
    out.append(kept)
    predict = plain_language(kept)
    kept = [r for r in kept if (p := predict(r[2]))[0] != "und" and p[1] >= langid.AMBIGUOUS]
    out.append(kept)
    sets = []
    for _, _, text in kept:
        w = [x.encode().lower() for x in words_of(text)]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)})
    root = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if root[i] != root[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    classes = defaultdict(list)
    for k, r in enumerate(root):
        classes[r].append(k)
    order = lambda k: (kept[k][0] is None, kept[k][0] or 0)
    kept = [kept[min(own, key=order)] for own in classes.values()]
    out.append(kept)
    first = {}
    for d, _, text in kept:
        w = words_of(text)
        for i in range(len(w) - 49):
            if d is not None:
                first[tuple(w[i : i + 50])] = min(d, first.get(tuple(w[i : i + 50]), d))
    cut = []
    for d, lang, text in kept:
        w = words_of(text)
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if d is not None and first[tuple(w[i : i + 50])] < d:
                gone[i : i + 50] = [True] * 50
        if any(gone):
            text = " ".join(x for x, g in zip(w, gone) if not g)
        if not all(gone) or not w:
            cut.append((d, lang, text))
    out.append(cut)
    return out


def test_pipeline_against_a_plain_version(spark, small_sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    at, docs, labels = small_sf
    want = plain_run(docs, labels)
    assert [len(x) for x in want] == sorted((len(x) for x in want), reverse=True) and len(want[0]) > len(want[2]) + 40 and want[2] != want[3]
    df = common.table(spark, at, "documents")
    for (name, stage), kept in zip(corpus_pipeline.STAGES, want):
        made = stage(spark, df, at)
        assert made.columns == df.columns
        df = common.cut(made)
        assert Counter((r.doc_id, r.lang, r.text) for r in df.collect()) == Counter(kept), name
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = Counter((d, len(t.encode(text, add_special_tokens=False).ids) + 1) for d, _, text in want[3])
    assert Counter((r.doc_id, r.doc_tokens) for r in corpus_pipeline.run(spark, at).where("start = 0").collect()) == tokens


def test_stages_with_clashing_columns_and_empty_tables(spark, small_sf):
    at, _, _ = small_sf
    clash = ["_vhash", "_vdoc", "_vrow", "_vt", "_vwhole", "_vid", "v_doc", "v_hash", "hash", "row", "label", "node", "whole", "n", "stays", "gone_id", "key", "first"]
    df = common.table(spark, at, "documents")
    wide = df.selectExpr("*", *(f"CAST(doc_id AS STRING) AS `{c}`" for c in clash))
    for name, stage in corpus_pipeline.STAGES:
        got, plain = stage(spark, wide, at), stage(spark, df, at)
        assert got.count() == plain.count() > 0, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert got.columns == wide.columns and Counter(map(tuple, got.select(df.columns).collect())) == Counter(map(tuple, plain.collect())), name
        assert stage(spark, wide.where("false"), at).count() == 0, name


def plain_score(w, lex, text):
    """log10 probability of a text, word by word, but for the counts of words outside the table."""
    h, x, total = np.zeros(lm.HIDDEN), 0, 0.0
    codes = lex.codes(text)
    cls, inputs = lex.classed(codes)
    for code, k, following in zip(codes.tolist(), cls.tolist(), inputs.tolist()):
        pre = w["embed"][x].astype(float) + w["bias"] + h @ w["turn"]
        pre = pre / (1 + np.abs(pre))
        z, c = 0.5 + 0.5 * pre[: lm.HIDDEN], pre[lm.HIDDEN :]
        h = h + z * (c - h)
        scores = h @ w["cls"] + w["cls_bias"]
        total += math.log10(math.exp(scores[k] - scores.max()) / np.exp(scores - scores.max()).sum())
        if code < lm.HEAD:
            own = h @ w["word"][k] + w["word_bias"][k]
            total += math.log10(math.exp(own[code - k * lm.PER_CLASS] - own.max()) / np.exp(own - own.max()).sum())
        elif code < lm.RARE:
            total += lex.log_count[code] - lex.log_mass[k]
        else:
            total -= lex.log_mass[k]
        x = following
    return total


def lm_corpus(spark, n=120):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(rng.choice(words[: 5 + i % 50]) for _ in range(rng.randint(1, 90))) + (" odd odd once%d" % i if i % 5 == 0 else "")) for i in range(n)] + [(n, None), (n + 1, ""), (None, "w1 w2"), (3, "w1 w2"), (3, "w1 w2")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_scores_by_plain_loops(spark):

    docs = lm_corpus(spark).cache()
    learned = docs.where(common.crc_mod("doc_id", lm.FOLDS) != lm.HELD_OUT).select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text"))
    counts = common.cut(lm.count_words(learned.select("text")))
    lex = lm.lexicon(counts)
    w = lm.fit(learned, lex)
    n = {r.key: r.n for r in counts.collect()}
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.score) for r in lm.score(docs, counts, lex, w).collect())
    want = []
    for r in docs.collect():
        codes = lex.codes((r.text or "").encode())
        extra = sum(math.log10(n.get(int(c) - lm.RARE, 0) + 1) for c in codes if c >= lm.RARE)
        want.append((r.doc_id if r.doc_id is not None else -1, plain_score(w, lex, (r.text or "").encode()) + extra))
    assert [a for a, _ in got] == [a for a, _ in sorted(want)] and np.allclose([b for _, b in got], [b for _, b in sorted(want)], rtol=1e-4, atol=1e-3)


def test_scores_do_not_depend_on_the_split(spark, monkeypatch):
    monkeypatch.setattr(lm, "PART", 300)
    docs = lm_corpus(spark)
    one, many = (sorted((str(r.doc_id), r.n_tokens, r.score) for r in lm.score_documents(docs.repartition(n, "text")).collect()) for n in (1, 7))
    assert [r[:2] for r in one] == [r[:2] for r in many] and np.allclose([r[2] for r in one], [r[2] for r in many], rtol=1e-5, atol=1e-4)
