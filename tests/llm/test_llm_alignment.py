"""Cross-tokenizer alignment against the libraries on whole texts, links and counts by plain loops."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from vireo.llm import alignment

SCHEMA = "doc_id long, text string, row long, n_a string, b string, kind int"
SF = "/root/testdata/sf0.001"


def plain(rows):
    """Rows of op13 by the definition; rows: (doc_id, text)."""
    a = Tokenizer.from_file(public_tokenizers.path(alignment.A))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.B))
    shown = [n for n in range(256) if 33 <= n <= 126 or 161 <= n <= 172 or 174 <= n <= 255]
    byte = {chr(n): n for n in shown} | {chr(256 + i): n for i, n in enumerate(n for n in range(256) if n not in shown)}
    made, counts = [], Counter()
    for doc, text in rows:
        of_a = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in (a.encode(" " + text, add_special_tokens=False).ids if text else [])]
        of_b = []
        for i in b.encode(text) if text else []:
            p = b.id_to_piece(i)
            of_b.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
        want = (" " + text).encode() if text else b""
        if b"".join(x for _, x in of_a) != want or b"".join(x for _, x in of_b) != want:
            of_a = of_b = []
        ends = []
        for side in (of_a, of_b):
            at, by_end = 0, defaultdict(list)
            for i, x in side:
                at += len(x)
                by_end[at].append(i)
            ends.append(by_end)
        links = Counter((x, y) for e in ends[0] if e in ends[1] for x in ends[0][e] for y in ends[1][e])
        counts += links
        groups, last = [], 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            groups.append("|".join(",".join(str(i) for at in sorted(side) if last < at <= e for i in side[at]) for side in ends))
            last = e
        made.append((doc, len(of_a), len(of_b), groups, links))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [
        (doc, na, nb, len(groups), sum(links.values()), sum(n for (x, y), n in links.items() if counts[x, y] == best[y]), sum(n * counts[p] for p, n in links.items()), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for doc, na, nb, groups, links in made
    ]


TEXTS = [None, "", " ", "\n", "abc ", "  a  b\n\n c\t d", "\ta\x00b\r\n", "<|endoftext|> <s>hi</s> x<unk>", "日本 été ﬁ á 🎉🎉", "a▁b c", "▁", "word " * 3000, "x" * 5000, "the cat\nthe dog the", "the cat\nthe dog the", " trailing  \n \n", "　full　width ", "<0x41> A"]


@pytest.mark.parametrize("share", [alignment.SHARE, 2])
def test_against_plain_loops(spark, share):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(13, TEXTS[13]), (None, "the cat"), (13, "another text, the cat")]
    docs = spark.createDataFrame([(i, t, 7, "x", "y", 3) for i, t in rows], SCHEMA).repartition(3)
    got = alignment.align(docs, share=share)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(plain(rows))


def test_chunks_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK", 5)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    made = alignment.postings(docs).where("kind <> 2").selectExpr("b", "0 AS part", "kind", "a", "n", "rows").orderBy("b", "kind")
    tables = [b for b in made.toArrow().to_batches(max_chunksize=7) if b.num_rows]
    sums = Counter()
    for b in alignment._totals(alignment._contributions(iter(tables))):
        for r in b.to_pylist():
            sums["n_best"] += r["n_best"]
            sums["count_sum"] += r["count_sum"]
    want = plain(rows)
    assert sums == {"n_best": sum(r[5] for r in want), "count_sum": sum(r[6] for r in want)}


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert Counter(map(tuple, alignment.op13_alignment(spark, SF).collect())) == Counter(plain(rows))


def test_groups_and_empty(spark):
    docs = spark.createDataFrame([(1, "the cat"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.groups for r in alignment.written_groups(docs).collect()}
    assert got[2] == "" and hashlib.sha256(got[1].encode()).hexdigest() == plain([(1, "the cat")])[0][-1]
    assert alignment.align(spark.createDataFrame([], SCHEMA)).count() == 0
