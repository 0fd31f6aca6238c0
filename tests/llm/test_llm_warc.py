"""Archives: records written and read back, damaged and foreign ones, and the query's SQL."""

import hashlib
import struct
from collections import Counter

import duckdb
import pytest
import zstandard

from vireo.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, digest string, first long"
SF = "/root/testdata/sf0.001"


def pages():
    long = "<p>" + "words and more words " * 10 + "</p>"
    rows = [(i, f"http://example.org/{i}", t) for i, t in enumerate([None, "", "short", "short", long, long, long + "é", long, "x" * 99, "x" * 99, "y" * 100, "y" * 100, "P*M\x18\0\0\0\0" * 30, "é" * 50, "é" * 50, "日本 " * 100_000])]
    return rows + [(4, "again", long), (5, "u\r\nX: y <b>", long), (None, None, long), (None, "n", "only" * 40), (5, "other payload", "z" * 200), (3, "z", "z" * 200), (-2, "", "y" * 100)]


def plain(rows):
    out = []
    for i, _, t in rows:
        data = (t or "").encode()
        same = [j for j, _, u in rows if (u or "") == (t or "") and j is not None]
        again = len(data) >= 100 and i is not None and min(same) < i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", min(same) if again else None))
    return Counter(out)


def written(spark, tmp_path, rows):
    made = spark.createDataFrame([(*r, "p", "d", 1) for r in rows], SCHEMA).repartition(2)
    warc.write_archives(made, f"file://{tmp_path}/a")
    return f"file://{tmp_path}/a"


def digest(found):
    number = lambda x: int(x[len(warc.ID) :]) if x and x != warc.ID else None
    return Counter((number(r.record_id), r.payload_bytes, r.payload_digest.split(":")[1], r.record_type, number(r.refers_to)) for r in found.where("record_type <> 'warcinfo'").collect())


def test_round_trip(spark, tmp_path):
    rows = pages()
    at = written(spark, tmp_path, rows)
    found = warc.read_archives(spark, at).cache()
    assert digest(found) == plain(rows)
    whole = Counter((r.record_id, bytes(r.payload)) for r in warc.resolved(found).collect())
    assert whole == Counter((f"{warc.ID}{'' if i is None else i}", (t or "").encode()) for i, _, t in rows)
    assert {r.target_uri for r in found.collect() if r.record_id == warc.ID + "5"} == {"http://example.org/5", "u%0D%0AX:%20y%20%3Cb%3E", "other%20payload"}
    assert found.where("record_type = 'revisit' AND payload IS NOT NULL").count() == 0


def test_dictionary(spark, tmp_path):
    rows = [(i, f"http://example.org/{i}", f"<html><body class='common head {i % 7}'>" + " ".join(f"term{(i * j) % 997}" for j in range(120)) + "</body></html>") for i in range(600)]
    at = written(spark, tmp_path, rows)
    leading = [struct.unpack("<I", bytes(r.content)[:4])[0] for r in spark.read.format("binaryFile").load(at).collect() if r.length]
    assert leading and set(leading) == {warc.LEADING}
    assert digest(warc.read_archives(spark, at)) == plain(rows)


def test_empty(spark, tmp_path):
    at = written(spark, tmp_path, [])
    assert warc.read_archives(spark, at).count() == 0


def problems(data):
    out = []
    for _, made, problem in warc.records(data):
        if problem is None:
            try:
                warc.parse(made)
            except ValueError as e:
                problem = str(e)
        out.append(problem)
    return out


def test_damage():
    good = warc.page_record(1, "u", b"payload " * 30, hashlib.sha256(b"payload " * 30).hexdigest(), None, "2020-01-01T00:00:00Z")
    coder = zstandard.ZstdCompressor(write_checksum=True)
    frame = coder.compress(good)
    assert problems(frame * 2) == [None, None] and problems(b"") == []
    assert problems(frame[:-1]) == ["the frame isn't complete"] and problems(frame[:-9]) == ["the frame isn't complete"]
    assert problems(b"no frame" + frame) == ["not a frame"] and problems(warc.skippable(b"x" * 9, 0x184D2A50)[:-1]) == ["the skippable frame isn't complete"]
    bent = bytearray(frame)
    bent[len(frame) // 2] ^= 1
    assert problems(bytes(bent) + frame)[-1] is None and problems(bytes(bent) + frame)[0]
    held = lambda a, b: problems(coder.compress(good.replace(a, b, 1)))[0]
    assert "content-length is" in held(b"\r\n\r\nHTTP", b"0\r\n\r\nHTTP") and "content-length is" in held(b"\r\n\r\nHTTP", b"\r\n\r\n HTTP")
    assert held(b"WARC/1.1", b"WARC/3") == "not a WARC version: b'WARC/3'" and held(b"WARC-Date: 2020-01-01T00:00:00Z\r\n", b"") == "no warc-date"
    assert held(b"payload payload", b"payloed payload") == "the block doesn't have its digest" and held(b"WARC-Type: response", b"WARC-Type: reply") == "no such record type: reply"
    assert "is there twice" in held(b"WARC-Type: response\r\n", b"WARC-Type: response\r\n" * 2) and "not a header line" in held(b"WARC-Type: ", b"WARC Type ")
    assert "content-length is" in problems(coder.compress(good + good))[0]
    assert problems(coder.compress(warc.record("revisit", "urn:a:b", "d", b"", {})))[0] == "a revisit without a profile"
    short = warc.record("response", "urn:a:b", "d", b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nabc", {"Content-Type": "application/http"})
    assert "the payload's length is 3" in problems(coder.compress(short))[0]
    wrong = warc.record("response", "urn:a:b", "d", b"HTTP/1.1 200 OK\r\n\r\nabc", {"Content-Type": "application/http", "WARC-Payload-Digest": "sha1:AAAA"})
    assert problems(coder.compress(wrong)) == ["the payload doesn't have its digest"]


def test_foreign_archives():
    """Folded headers, base32 digests, frames of unknown size, dictionaries that are compressed or not."""
    sha1 = __import__("base64").b32encode(hashlib.sha1(b"abc").digest()).decode()
    data = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Date: 2001-01-01T00:00:00Z\r\nX-Long: a\r\n b\r\nWARC-Payload-Digest: sha1:" + sha1.encode() + b"\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    samples = [b"some words %d of records that look alike %d" % (i, i * i) for i in range(2000)]
    dictionary = zstandard.train_dictionary(4096, samples)
    for leading in (dictionary.as_bytes(), zstandard.ZstdCompressor().compress(dictionary.as_bytes())):
        coder = zstandard.ZstdCompressor(dict_data=dictionary)
        stream = coder.compressobj()
        frames = coder.compress(data) + warc.skippable(b"note", 0x184D2A53) + stream.compress(data) + stream.flush()
        assert problems(warc.skippable(leading) + frames) == [None, None]
        assert all(problems(frames))  # without the dictionary
    got = warc.parse(data)
    assert got["record_type"] == "resource" and got["payload"] == b"abc" and got["record_id"] == "urn:uuid:1"


def test_strict(spark, tmp_path):
    (tmp_path / "x.warc.zst").write_bytes(zstandard.ZstdCompressor().compress(b"nothing"))
    at = f"file://{tmp_path}/*.warc.zst"
    assert [r.problem for r in warc.read_archives(spark, at, strict=False).collect()] == ["not a WARC version: b'nothing'"]
    with pytest.raises(Exception, match="not a WARC version"):
        warc.read_archives(spark, at).count()


def test_query(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet')")
    got, want = warc.op12_warc(spark, SF), con.execute(warc.ORACLE_OP12)
    assert got.columns == [c[0] for c in want.description]
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages())
    assert Counter(con.execute(warc.ORACLE_OP12).fetchall()) == plain(pages())
