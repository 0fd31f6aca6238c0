"""Filter audit against loops over all orders, and its SQL."""

from collections import Counter
from itertools import permutations

import duckdb
import pytest

from vireo.llm import audit

SCHEMA = "doc_id long, text string, source string, part string, step int, quality int"
SF = "/root/testdata/sf0.001"


def fails(rows):
    """The failing filters of each row (doc_id, text, source)."""
    out = []
    for d, t, _ in rows:
        words = (t or "").encode().split()
        f = set()
        if len(words) < 200:
            f.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            f.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t or "") > 2 * len(t or ""):
            f.add("C")
        if any(c in "#$%&*|" for c in t or ""):
            f.add("D")
        if d is not None and any(e is not None and e < d and (u or "") == (t or "") for e, u, _ in rows):
            f.add("E")
        out.append(f)
    return out


def plain(rows, labels):
    good = {d for d, q, _ in labels if q == 1} - {None}
    toxic = {d for d, _, t in labels if t == 1} - {None}
    failing, out = fails(rows), []
    for part in {s or "" for _, _, s in rows}:
        mine = [(d, f) for (d, _, s), f in zip(rows, failing) if (s or "") == part]
        share, made = Counter(), []
        for order in permutations("ABCDE"):
            left, gone = list(mine), []
            for step, x in enumerate(order, 1):
                removed = [r for r in left if x in r[1]]
                made.append((part, "".join(order), step, len(left) - len(removed), len(removed), sum(x in f for _, f in gone), sum(f == {x} for _, f in mine), sum(d in good for d, _ in removed), sum(d in toxic for d, _ in removed)))
                share[x] += len(removed)
                gone += removed
                left = [r for r in left if x not in r[1]]
        out += [(*r, share[r[1][r[2] - 1]]) for r in made]
    return Counter(out)


def prose(n, kinds):
    return " ".join(f"w{i % kinds}" for i in range(n))


def fixture():
    texts = [None, "", prose(300, 250), prose(300, 20), "UPPER CASE", "a b | c", prose(250, 240) + " ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 2, "été É 日本 " * 90, prose(20_000, 15_000)]
    rows = [(i, t, ["web", None, "", "news"][i % 4]) for i, t in enumerate(texts)]
    rows += [(i + 20, prose(300, 250), "web" if i % 2 else "news") for i in range(40)]  # a group of copies
    rows += [(2, prose(300, 250), "web"), (2, prose(300, 250), "other"), (5, "another text", "web"), (None, prose(300, 250), "web"), (None, "", None), (-7, "a b | c", "web")]
    labels = [(d, d % 2, d % 3 == 0) for d in range(0, 60, 2)] + [(2, 1, 0), (5, None, 1), (None, 1, 1), (999, 1, 1)]
    return rows, [(d, q, int(t)) for d, q, t in labels]


@pytest.mark.parametrize("held", [audit.HELD, 100])
def test_against_loops(spark, held):
    rows, labels = fixture()
    docs = spark.createDataFrame([(*r, "x", 1, 1) for r in rows], SCHEMA).repartition(3)
    got = audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), held=held)
    assert Counter(map(tuple, got.collect())) == plain(rows, labels)


def test_equal_fingerprints(spark, monkeypatch):
    """Texts that collide are told apart in their chain."""
    chains, rows = audit.Chains(), []
    for i, t in enumerate(["a", "b", "a", "b", "c"]):
        rows += chains.add(7, t, 1, 9 - i, Counter({"p": 1}))
    assert sorted(rows) == [(8, "p", 17, 1), (9, "p", 17, 1)] and sorted((r[1][0], r[1][2]) for r in chains.emptied()) == [("a", 7), ("b", 6), ("c", 5)]


def test_empty_and_sql(spark):
    rows, labels = fixture()
    assert audit.audit(spark.createDataFrame([], SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR); CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    con.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    assert Counter(con.execute(audit.ORACLE_OP11).fetchall()) == plain(rows, labels)


def test_query(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = audit.op11_filter_audit(spark, SF)
    want = con.execute(audit.ORACLE_OP11)
    assert sorted(got.columns) == sorted(c[0] for c in want.description)
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())
