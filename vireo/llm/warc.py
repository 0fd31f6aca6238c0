"""WARC archives in Zstandard: a frame for each record, the dictionary in a leading skippable frame.

Writing: each task writes an archive of its own through Spark's text sink, so its commit protocol holds and lost tasks leave
nothing.  Lines are frames, and what ends a line is an empty skippable frame, which readers of archives pass over.  A task
trains its dictionary on the first payloads that it writes (at most ``SAMPLE`` bytes), which changes sizes only.  Pages with
equal payloads are told by their SHA-256: the page with the least id is written whole, the others as revisits of it.

Reading: archives are read by Spark's binary source, so up to 2 GB each (a task writes what it has of the input's splits).  A
task takes the dictionary from the leading frame, finds the ends of frames from their block headers, decodes one frame at a
time, and checks its checksum, the record's version, headers, lengths and digests.  A record that fails has ``problem`` set
(``strict``: it is an error); reading goes on with the next frame.

Defined cases: a null payload is empty; a null id has no smaller id and its page is always written whole; rows that share the
least id are all written whole; null and empty urls are left out, control characters in them are percent-encoded; repeated
rows give repeated records; an empty table gives no records; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from datetime import datetime, timezone

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vireo.llm.common import cut, shared_dir, small, small_batches, spread, table

MIN_BYTES = 100
#: Payloads and bytes of them that a dictionary is trained on at most, its size, and the compression level.
SAMPLES, SAMPLE, SAMPLE_EACH, DICTIONARY, LEVEL = 512, 2 << 20, 16 << 10, 32 << 10, 6
# Fixed values of the formats.
FRAME, SKIPPED, LEADING, EMPTY = 0xFD2FB528, range(0x184D2A50, 0x184D2A60), 0x184D2A5D, "P*M\x18\x00\x00\x00\x00"
VERSIONS = (b"WARC/1.0", b"WARC/1.1")
TYPES = ("warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation")
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:vireo:page:"
SCHEMA = "archive string, offset long, record_type string, record_id string, record_date string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, problem string"


# Records


def _encoded(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f<>]", lambda m: f"%{ord(m[0]):02X}", url)


def record(kind: str, id: str, date: str, block: bytes, more: dict[str, str]) -> bytes:
    """A WARC record with its block's digest."""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{id}>", "WARC-Date": date, **more, "WARC-Block-Digest": "sha256:" + hashlib.sha256(block).hexdigest(), "Content-Length": str(len(block))}
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in head.items()), "\r\n"]).encode() + block + b"\r\n\r\n"


def page_record(id, url: str | None, payload: bytes, digest: str, first, date: str) -> bytes:
    """A page as a response, or as a revisit of the page ``first`` with the head of its response alone."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    more = {"WARC-Target-URI": _encoded(url)} if url else {}
    more |= {"Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": "sha256:" + digest}
    if first is None:
        return record("response", f"{ID}{'' if id is None else id}", date, block + payload, more)
    return record("revisit", f"{ID}{id}", date, block, more | {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{ID}{first}>"})


def _headers(data: bytes) -> dict[str, str]:
    """Header lines by lower-case name; lines that start with white space go on with the line before."""
    out: dict[str, str] = {}
    last = None
    for line in data.split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and last:
            out[last] += " " + line.strip().decode()
            continue
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"not a header line: {line[:60]!r}")
        last = name.decode("ascii").lower()
        if last in out and last != "warc-concurrent-to":
            raise ValueError(f"{name.decode()} is there twice")
        out[last] = value.strip().decode()
    return out


def _length(text: str) -> int:
    if not re.fullmatch("[0-9]+", text):
        raise ValueError(f"not a length: {text[:40]!r}")
    return int(text)


def _agrees(digest: str, data: bytes) -> bool:
    """Whether digest (algorithm:value, in hex or base32) is that of data; unknown algorithms count as agreeing."""
    name, _, value = digest.partition(":")
    if name.lower() not in ("sha1", "sha256", "md5"):
        return True
    made = hashlib.new(name.lower(), data)
    return value.lower() == made.hexdigest() or value.upper().rstrip("=") == base64.b32encode(made.digest()).decode().rstrip("=")


def parse(data: bytes) -> dict:
    """Fields of SCHEMA of the one record that data must be; ValueError says what is wrong."""
    head, found, rest = data.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if version not in VERSIONS:
        raise ValueError(f"not a WARC version: {version[:40]!r}")
    if not found:
        raise ValueError("headers don't end")
    of = _headers(lines)
    missing = [k for k in REQUIRED if k not in of]
    if missing:
        raise ValueError("no " + ", ".join(missing))
    n = _length(of["content-length"])
    block, end = rest[:n], rest[n:]
    if len(block) < n or end != b"\r\n\r\n":
        raise ValueError(f"content-length is {n}, the record holds {len(rest) - 4}")
    kind, bare = of["warc-type"], lambda k: of[k].strip("<>") if k in of else None
    if kind not in TYPES:
        raise ValueError(f"no such record type: {kind[:40]}")
    if not re.fullmatch(r"<[^<>\s]+:[^<>\s]*>", of["warc-record-id"]):
        raise ValueError("the record's id isn't a URI")
    if "warc-block-digest" in of and not _agrees(of["warc-block-digest"], block):
        raise ValueError("the block doesn't have its digest")
    if kind == "revisit" and "warc-profile" not in of:
        raise ValueError("a revisit without a profile")
    payload, size = block, n
    if of.get("content-type", "").startswith("application/http"):
        before, found, payload = block.partition(b"\r\n\r\n")
        first, _, fields = before.partition(b"\r\n")
        if not found or not first.startswith(b"HTTP/"):
            raise ValueError("not an HTTP message")
        said = _headers(fields) if fields else {}
        size = _length(said["content-length"]) if "content-length" in said else len(payload)
        if kind != "revisit" and size != len(payload):
            raise ValueError(f"the payload's length is {len(payload)}, its headers say {size}")
    digest = of.get("warc-payload-digest")
    if digest and kind != "revisit" and not _agrees(digest, payload):
        raise ValueError("the payload doesn't have its digest")
    return {"record_type": kind, "record_id": bare("warc-record-id"), "record_date": of["warc-date"], "target_uri": of.get("warc-target-uri"), "refers_to": bare("warc-refers-to"), "payload_digest": digest, "payload_bytes": size, "payload": None if kind == "revisit" else payload}


# Frames


def skippable(data: bytes, magic: int = LEADING) -> bytes:
    return struct.pack("<II", magic, len(data)) + data


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends, from the sizes of its blocks."""
    head = bytes(data[at : at + 18])
    place, last = at + zstandard.frame_header_size(head), False
    while not last:
        if place + 3 > len(data):
            raise ValueError("the frame isn't complete")
        word = int.from_bytes(data[place : place + 3], "little")
        last, kind, size = word & 1, word >> 1 & 3, word >> 3
        if kind == 3:
            raise ValueError("not a block of a frame")
        place += 3 + (1 if kind == 1 else size)
    place += 4 if zstandard.get_frame_parameters(head).has_checksum else 0
    if place > len(data):
        raise ValueError("the frame isn't complete")
    return place


def records(data: bytes):
    """(offset, record as bytes, None) or (offset, None, problem) for each frame of an archive."""
    view, at, decoder = memoryview(data), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        magic, size = struct.unpack("<II", view[at : at + 8]) if len(view) - at >= 8 else (0, 0)
        if magic in SKIPPED:
            end = at + 8 + size
            if end > len(view):
                yield at, None, "the skippable frame isn't complete"
                return
            if at == 0 and magic == LEADING:
                try:
                    held = bytes(view[8:end])
                    held = zstandard.ZstdDecompressor().decompress(held) if held[:4] == struct.pack("<I", FRAME) else held
                    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held, dict_type=zstandard.DICT_TYPE_FULLDICT))
                    decoder.decompress(zstandard.ZstdCompressor().compress(b""))  # loads the dictionary
                except zstandard.ZstdError as e:
                    yield at, None, f"not a dictionary: {e}"
            at = end
            continue
        try:
            if magic != FRAME:
                raise ValueError("not a frame")
            end = frame_end(view, at)
        except (ValueError, zstandard.ZstdError) as e:
            yield at, None, str(e)
            return  # the next frame can't be found
        try:
            frame = decoder.decompressobj()
            made = frame.decompress(view[at:end])
            yield at, made, None
        except zstandard.ZstdError as e:
            yield at, None, str(e)
        at = end


# Archives


def _compressed(date: str):
    """(id, url, payload, digest, first) to frames: dictionary and a record about the archive first."""

    def started(rows: list[tuple]):
        samples, size = [], 0
        for r in rows:
            if r[2] and size < SAMPLE:
                samples.append(r[2][:SAMPLE_EACH])
                size += len(samples[-1])
        try:
            made = zstandard.train_dictionary(DICTIONARY, samples, k=256, d=8)
        except zstandard.ZstdError:  # too little to train on
            made = None
        coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_checksum=True, write_content_size=True)
        about = record("warcinfo", f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, str(rows[0][0]) + date)}", date, b"software: vireo\r\nformat: WARC File Format 1.1\r\n", {"Content-Type": "application/warc-fields"})
        return coder, ([skippable(zstandard.ZstdCompressor(level=LEVEL).compress(made.as_bytes()))] if made else []) + [coder.compress(about)]

    def run(batches):
        coder, held, out, size = None, [], [], 0
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        done = False
        while not done:
            r = next(rows, None)
            done = r is None
            if r is not None:
                held.append(r)
                size += len(r[2])
            if held and (done or coder or len(held) >= SAMPLES or size >= SAMPLE):
                if coder is None:
                    coder, out = started(held)
                out += [coder.compress(page_record(*h, date)) for h in held]
                held = []
            if out and (done or len(out) >= 100 or size >= SAMPLE):
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])
                out, size = [], 0

    return run


def write_archives(pages: DataFrame, path: str, id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = MIN_BYTES) -> None:
    """Write a record for each page to archives under path, which must not exist: of pages with equal payloads of at least
    min_bytes, all but the one with the least id as revisits."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    keyed = cut(rows.where((F.octet_length("payload") >= min_bytes) & F.col("page_id").isNotNull()).select("page_id", F.unhex("digest").alias("key")))
    first = keyed.groupBy("key").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = spread(keyed, first, "key").where("page_id > first").select(F.col("page_id").alias("_id"), F.lower(F.hex("key")).alias("_digest"), "first").distinct()
    told = rows.join(small(again), (F.col("page_id") == F.col("_id")) & (F.col("digest") == F.col("_digest")), "left").select("page_id", "url", "payload", "digest", "first")
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    frames = told.mapInArrow(_compressed(date), "frame binary").select(F.col("frame").cast("string"))
    frames.write.option("lineSep", EMPTY).option("compression", "none").text(path)


def read_archives(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Rows of SCHEMA, one a record.  payload_digest has its algorithm before a colon; a revisit's length is what its headers say."""
    small_batches(spark)

    def run(batches):
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        types = [pa.string(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary(), pa.string()]
        for b in batches:
            for archive, data in zip(b.column(0).to_pylist(), b.column(1)):
                out, size = [], 0
                for offset, made, problem in records(data.as_buffer()):
                    row = {"archive": archive, "offset": offset, "problem": problem}
                    if problem is None:
                        try:
                            row |= parse(made)
                        except ValueError as e:
                            row["problem"] = str(e)
                    if strict and row["problem"]:
                        raise ValueError(f"{archive} at {offset}: {row['problem']}")
                    out.append(row)
                    size += len(row.get("payload") or b"") + 500
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in out], t) for n, t in zip(names, types)], names)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in out], t) for n, t in zip(names, types)], names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SCHEMA)


def resolved(found: DataFrame) -> DataFrame:
    """Responses, and revisits with the payload of the response they refer to (null if it isn't there or has another digest)."""
    found = cut(found.where("record_type IN ('response', 'revisit')"))
    whole = found.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to"), F.col("payload_digest").alias("_d")).agg(F.first("payload").alias("_p"))
    once = whole.groupBy("refers_to").agg(F.collect_list(F.struct("_d", "_p")).alias("_s"))
    back = spread(found.where("record_type = 'revisit'"), once, "refers_to", "left")
    fits = F.filter("_s", lambda s: s["_d"] == F.col("payload_digest"))
    return found.where("record_type = 'response'").unionByName(back.withColumn("payload", F.try_element_at(fits, F.lit(1)).getField("_p")).drop("_s"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/vireo-warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    found = read_archives(spark, path).where("record_type IN ('response', 'revisit')")
    number = lambda c: F.expr(f"try_cast(substr({c}, {len(ID) + 1}) AS long)")
    return found.select(number("record_id").alias("page_id"), "payload_bytes", F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))


ORACLE_OP12 = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS t, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
q AS (SELECT *, strlen(t) >= {MIN_BYTES} AND coalesce(page_id > first, false) AS again FROM p)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, sha256(t) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM q"""
