"""Operators on small fixtures with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from vireo.llm import ann, bpe, chat, jaccard, langid, lm, packing, quality, registry, substrings, tokencount

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, label string, node int, hash string, key long"


def texts():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = prose(60), prose(120)
    near = base.split()
    near[60] = "other"
    return [None, "", "  \n\t ", "a b", "A  B", prose(80) + " " + passage + " " + prose(30), passage, prose(20) + "\n" + passage, base, base, " ".join(near), base.upper(), prose(6000), "<|endoftext|> x<|endoftext|>", "\u65e5\u672c \u00e9t\u00e9", prose(55) * 2]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], None, None, i, "x", 1, "h", 5) for i, t in enumerate(texts())]
    rows += [(None, texts()[5], "en", None, None, 0, "x", 1, "h", 5), rows[8], rows[8]]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def test_token_counts_and_packing(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {x: t.encode(x, add_special_tokens=False).ids for _, x in plain(docs)}
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.count_tokens(docs).collect())
    assert got == Counter((d, len(x.encode()), len(ids[x]), len(ids[x]) > 1024) for d, x in plain(docs))
    assert tokencount.count_tokens(empty).count() == 0 and packing.pack(empty).count() == 0
    pieces, total = packing.pack(docs).collect(), 0
    for r in pieces:
        total += r.length
    assert total == sum(len(ids[x]) + 1 for _, x in plain(docs))
    filled = Counter()
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled[r.sequence_id]
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 1024
    long = sorted((r.start, r.ids) for r in pieces if r.doc_id == 12)
    assert b"".join(x for _, x in long) == np.array(ids[texts()[12]] + [0], "<u4").tobytes()


def test_bpe(spark, docs, empty):
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in bpe.decode(bpe.encode(docs)).collect())
    assert got == Counter((d, np.array(library.encode_ordinary(x), "<u4").tobytes(), x.encode()) for d, x in plain(docs))
    assert bpe.decode(bpe.encode(empty)).count() == 0


def plain_classes(rows, k, percent):
    """(doc_id, set size, least id of the class) by comparing all pairs."""
    sets = []
    for _, x in rows:
        w = x.encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()})
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    least = {}
    for (d, _), r in zip(rows, root):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return Counter((d, len(s), least.get(r)) for (d, _), s, r in zip(rows, sets, root))


def classes(df, k, percent):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(df, k, percent).collect())


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_jaccard(spark, docs, empty, k, percent):
    assert classes(docs, k, percent) == plain_classes(plain(docs), k, percent)
    assert jaccard.jaccard_classes(empty).count() == 0


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_jaccard_tiles_of_many_blocks(spark, monkeypatch, k, percent):
    """A cluster over many size bands and blocks: texts that grow from one to the next, in steps within and beyond the similarity."""
    monkeypatch.setattr(jaccard, "BLOCK", 400)
    rng = random.Random(11)
    words = [str(rng.randrange(10**6)) for _ in range(4000)]
    rows, n = [], 20
    while n < 2500:
        for _ in range(3):
            own = words[:n]
            own[rng.randrange(n)] = "other"
            rows.append((len(rows), " ".join(own)))
        n = int(n * rng.choice([1.03, 1.1, 1.2, 1.24, 1.3])) + 1
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_classes(rows, k, percent)
    assert 1 < len({c for _, _, c in want}) < len(rows)
    assert classes(df, k, percent) == want


def test_jaccard_stage(spark, docs, empty):
    """One row of each class stays, also where its rows are repeated, share an id or have none; blank texts all stay."""
    rng = random.Random(8)
    prose = lambda: " ".join(str(rng.randrange(10**6)) for _ in range(100))
    repeated, shared, none, mixed, lone, last = (prose() for _ in range(6))
    rows = [(1, repeated, "a"), (1, repeated, "b"), (1, repeated, "a"), (2, repeated, "a"), (3, shared, "a"), (3, shared + " more", "a"), (3, prose(), "a")]
    rows += [(None, none, "a")] * 3 + [(None, none + " more", "a"), (None, mixed, "a"), (9, mixed + " more", "a"), (None, lone, "a"), (7, last, "a"), (6, last, "a")]
    rows += [(4, "", "a"), (4, "", "a"), (None, None, "a"), (None, None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = jaccard.jaccard_stage(spark, df, "")
    assert got.columns == df.columns
    got = [(r.doc_id, r.text) for r in got.collect()]
    least = lambda *texts: [x for x in got if x[1] in texts]
    assert least(repeated) == [(1, repeated)] and least(mixed, mixed + " more") == [(9, mixed + " more")] and least(last) == [(6, last)]
    assert [d for d, _ in least(shared, shared + " more")] == [3] and [d for d, _ in least(none, none + " more")] == [None]
    assert least(lone) == [(None, lone)] and least(rows[6][1]) == [(3, rows[6][1])]
    assert sorted(map(str, least("", None))) == sorted(map(str, [(4, "")] * 2 + [(None, None)] * 2)) and len(got) == 11
    assert jaccard.jaccard_stage(spark, empty, "").count() == 0


def test_substrings(spark, docs, empty):
    rows = plain(docs)
    first = {}
    for d, x in rows:
        w = x.encode().split()
        for i in range(len(w) - 49):
            if d is not None:
                key = tuple(w[i : i + 50])
                first[key] = min(d, first.get(key, d))
    want = Counter()
    for d, x in rows:
        w = x.encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if d is not None and first[tuple(w[i : i + 50])] < d:
                gone[i : i + 50] = [True] * 50
        want[d, len(w), sum(gone), b" ".join(y for y, g in zip(w, gone) if not g).decode()] += 1
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.dedup(docs, ["doc_id"]).collect()) == want
    assert substrings.dedup(empty, ["doc_id"]).count() == 0
    assert substrings.substring_stage(spark, docs, "").columns == docs.columns


def test_nearest(spark):
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((300, 16)).round(2)
    vectors[50:90] = vectors[3]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)] + [(400, None, "x"), (401, [0.0] * 16, "x"), (402, [float("nan")] * 16, "x"), (403, [None] * 16, "x"), (404, [], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, ids string")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann.nearest(df, df.where("vec_id % 50 = 0")).collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for q in range(0, 300, 50):
        cos = unit @ unit[q]
        best = sorted((i for i in range(300) if i != q), key=lambda i: (-cos[i].round(12), i))[:5]
        assert [got[q, r][0] for r in range(1, 6)] == best and np.allclose([got[q, r][1] for r in range(1, 6)], cos[best])
    assert len(got) == 30 and ann.nearest(df.where("false"), df.where("false")).count() == 0


def test_chat(spark):
    turns = [(1, 1, "assistant", "b<|im_end|>"), (1, 0, "user", None), (2, 0, None, "x<\\\\|y"), (None, 0, "assistant", "z"), (1, 2, "assistant", "<\\|c")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digest(chat.format_log(chat.events_of(df))).collect()}
    assert got[1].n_turns == 3 and got[1].turns_sha256 == hashlib.sha256("user\n\nassistant\nb<|im_end|>\nassistant\n<\\|c\n".encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256("b<|im_end|><\\|c".encode()).hexdigest() and set(got) == {1, 2, None}
    log = [(1, 0, 0, "message", "user", "hi"), (1, 1, 1, "delta", "assistant", "he"), (1, 1, 2, "delta", None, "y"), (1, 1, 3, "regenerate", None, None), (1, 1, 4, "delta", None, "yo"), (1, 0, 5, "edit", None, "hello"), (1, 2, 6, "message", "user", "bye"), (1, 2, 7, "delete", None, None)]
    events = spark.createDataFrame(log, "conv_id long, turn long, seq long, kind string, role string, text string")
    assert [chat.read_back(r.segment) for r in chat.format_log(events).collect()] == [("user", "hello"), ("assistant", "yo")]
    assert chat.digest(chat.format_log(events.where("false"))).count() == 0


def test_chat_keeps_every_row(spark):
    """Rows that share a turn's number, repeated rows and null turns, against SQL with a total order."""
    import duckdb

    turns = [(1, 0, "user", "q"), (1, 0, "assistant", "a"), (1, 1, "user", "r"), (1, 1, "user", "r"), (2, None, "user", "x"), (2, None, "assistant", "y"), (2, None, "assistant", "y"), (2, 0, "user", None)]
    turns += [(3, 0, None, "b"), (3, 0, "", "a"), (3, 0, None, None), (None, None, "assistant", "z"), (None, None, "assistant", "w<|")] + [(4, 0, "assistant", f"{i:04}") for i in range(2500)]
    turns += [(5, 0, "a\\b", "t"), (5, 1, "a\nb", "t\\"), (5, 2, "x<|y", "<\\|"), (5, 3, "<\\|\n", "")]  # roles that are escaped
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = chat.digest(chat.format_log(chat.events_of(chat.with_hostile(df)))).toPandas()
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", turns)
    want = con.execute(chat.ORACLE_OP8).df()
    columns = sorted(want)
    assert sorted(got) == columns
    rows = lambda x: Counter(map(tuple, x[columns].astype({"conv_id": "Int64"}).astype(str).values))
    assert rows(got) == rows(want) and got.n_turns.sum() == len(turns) + 2


def test_language(spark, docs, empty):
    got = langid.predict(docs, langid.fit(docs), ["doc_id", "row", "label"]).collect()
    assert len(got) == docs.count() and all((r.lang_pred == "und") == (r.doc_id in (0, 1, 2)) for r in got) and all(0 <= r.score <= 1 for r in got)
    assert langid.predict(docs, langid.fit(empty), ["doc_id"]).where("lang_pred <> 'und'").count() == 0
    for n in (2, 5, 9):
        code = langid.codewords(n)
        assert len({tuple(c) for c in code.tolist()}) == n
    rows = [(i, ["the cat and the dog of the town", "le chat et le chien de la ville"][i % 2] + f" {i}", ["en", "fr"][i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.predict(df, langid.fit(langid.training_rows(df)), ["doc_id", "lang"]).where("lang <> lang_pred").count() == 0


def test_lm(spark, docs, empty):
    rows = [(d, x.encode().lower().split() + [b"\n"]) for d, x in plain(docs)]
    out = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    c = Counter(w for d, ws in rows if not out(d) for w in ws)
    n, v = sum(c.values()), len(c)
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.held_out, round(r.base_score, 5)) for r in lm.score_documents(docs).collect())
    want = sorted((str(d), len(ws), sum(c[w] > 0 for w in ws), n, out(d), round(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws), 5)) for d, ws in rows)
    assert [g[:5] for g in got] == [w[:5] for w in want] and np.allclose([g[5] for g in got], [w[5] for w in want])
    assert all(np.isfinite(r.score) and r.score < 0 for r in lm.score_documents(docs).collect()) and lm.score_documents(empty).count() == 0


def test_lm_trains_on_the_whole_fold(spark, monkeypatch):
    """Every row of the training fold, also of a null id, is in one round; null ids are spread over the rounds."""
    rows = [(i if i % 3 else None, f"word{i} and more") for i in range(90)]
    dealt, deal = [], lm.dealt
    monkeypatch.setattr(lm, "dealt", lambda sample, n: dealt.extend((r.round, bytes(r.text).decode()) for r in deal(sample, n).collect()) or deal(sample, n))
    scored = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    learned = [(d, t) for d, t in rows if zlib.crc32(b"" if d is None else str(d).encode()) % 7 != 2]
    assert len(scored) == 90 and sorted(t for _, t in dealt) == sorted(t for _, t in learned)
    none = {t for d, t in learned if d is None}
    assert len(none) == 30 and {r for r, t in dealt if t in none} == set(range(lm.ROUNDS))


def test_quality(spark, docs, empty):
    import re

    for r in quality.measures(docs, ["doc_id", "text"]).collect():
        x = r.text or ""
        words = re.findall("[^\\x20\\x09-\\x0D]+", x)
        seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {p for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for p in range(i, i + 5)}
        lines = [y for y in x.split("\n") if re.search("[^\\x20\\x09-\\x0D]", y)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(covered))
    assert quality.measures(empty, ["doc_id"]).count() == 0
    assert spark.sql(f"SELECT {quality.binomial_cdf('3e0', '200e0', 0.05)} AS p").first().p == pytest.approx(0.0090, abs=2e-4)


def test_quality_of_blank_texts_under_cutoffs(spark):
    rows = [(1, "en", ""), (2, "en", None), (3, None, " \n "), (4, "en", " ".join(map(str, range(40))) + " ####################")]
    measured = quality.measures(spark.createDataFrame(rows, "doc_id long, lang string, text string"), ["doc_id", "lang"])
    cuts = spark.createDataFrame([("en", 0.1, 0.1, 0.1, 7.0, -1.0), ("*", 0.1, 0.1, 0.1, 7.0, -1.0)], "stratum string, " + ", ".join(f"cut_{r} double" for r in quality.RULES))
    got = {r.doc_id: (r.base_failed, r.failed_rules, r.kept) for r in quality.judge(measured, cuts).collect()}
    assert got == {1: (True, [], False), 2: (True, [], False), 3: (True, [], False), 4: (False, ["symbols"], False)}


@pytest.mark.parametrize("name", ["op3_jaccard_join", "op4_substring_dedup", "op8_chat_formatting", "op10_quality_rules"])
def test_against_sql(spark, name):
    import duckdb

    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("documents", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got, want = registry.QUERIES[name](spark, sf).toPandas(), con.execute(registry.ORACLES[name]).df()
    columns = sorted(want)
    assert sorted(got) == columns
    assert Counter(map(tuple, got[columns].astype(str).values)) == Counter(map(tuple, want[columns].astype(str).values))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    made = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "jaccard_join", "substring_dedup", "sequence_packing"]
    assert made.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0 and made.count() > 0
