"""WARC archives with dictionary-compressed records.

Each archive starts with a skippable Zstandard frame (0x184D2A5D) that holds a dictionary built from the archive's first
records; every record follows as a frame of its own, compressed with that dictionary, so records can be read one by one.
Payloads that several pages share are stored once: the page with the smallest id has the response, others are
revisits that refer to it. Archives are written where driver and executors share files (any file system
that Arrow knows), under a name of their own and renamed when whole, so a task that runs again leaves no half archive behind:
only names that a finished task returned are read.

A writer task holds the records of its dictionary sample (bounded in bytes and records) and one record at a time besides.

Edge cases: a null or empty html is an empty payload, which takes part in deduplication when ``least`` is 0; a null url
leaves out the target URI; a null page_id has no refers-to of its own and never is the response of pages with an
id; repeated rows of the smallest page_id are all responses; an empty table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm.common import cut
from kinloom.shipping import ship

DICTIONARY_FRAME = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
SAMPLE_BYTES, SAMPLE_RECORDS, DICTIONARY_BYTES = 4 << 20, 400, 64 << 10
ARCHIVE_BYTES = 256 << 20
READ_BYTES = 1 << 20
SCHEMA = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(text: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def record(page_id, url, payload: bytes, refers_to, digest: str | None = None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit without."""
    name = f"urn:page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, sha1_base32(payload))}"
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{name}>")]
    if url is not None:
        head.append(("WARC-Target-URI", _line(url)))
    head += [
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{digest or sha1_base32(payload)}"),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload
    if refers_to is not None:
        head += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<urn:page:{refers_to}>"),
        ]
        block = http
    head.append(("Content-Length", str(len(block))))
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return lines.encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    top, _, rest = raw.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    head = dict(x.split(": ", 1) for x in lines[1:])
    n = int(head["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("record length differs from its header")
    payload = rest[:n].partition(b"\r\n\r\n")[2]
    kind = head["WARC-Type"]
    page = lambda s: int(s[10:-1]) if s and s.startswith("<urn:page:") else None
    out = {
        "page_id": page(head["WARC-Record-ID"]),
        "url": head.get("WARC-Target-URI"),
        "payload": payload if kind == "response" else None,
        "payload_bytes": int(head["X-Payload-Length"]),
        "payload_digest": head["WARC-Payload-Digest"].removeprefix("sha1:"),
        "record_type": kind,
        "refers_to": page(head.get("WARC-Refers-To")),
    }
    if kind == "response" and (len(payload), sha1_base32(payload)) != (out["payload_bytes"], out["payload_digest"]):
        raise ValueError("payload differs from its digest")
    return out


#: A payload with this share (1 in HOT) of all copies is handled apart.
HOT = 1000


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; where there is too little to train on, the samples themselves serve as raw content."""
    total = sum(map(len, samples))
    if len(samples) >= 16 and total >= 16 * 1024:
        try:
            return zstandard.train_dictionary(min(size, max(1024, total // 8)), samples).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-size:]


class Writer:
    """An archive on an open binary stream."""

    def __init__(self, out, dictionary: bytes, level: int = 6):
        packed = zstandard.ZstdCompressor(level=level).compress(dictionary) if dictionary else b""
        out.write(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
        self.out, self.bytes, self.records = out, 8 + len(packed), 0
        self.frames = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def add(self, raw: bytes) -> None:
        frame = self.frames.compress(raw)
        self.out.write(frame)
        self.bytes += len(frame)
        self.records += 1


def read_records(stream) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    magic, n = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame")
    held = stream.read(n) if n else b""
    if held[:4] == ZSTD_MAGIC:
        held = zstandard.ZstdDecompressor().decompress(held)
    ctx = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held) if held else None)
    data = stream.read(READ_BYTES)
    while data:
        frame, out = ctx.decompressobj(), []
        while True:
            out.append(frame.decompress(data))
            if frame.eof:
                data = frame.unused_data
                break
            data = stream.read(READ_BYTES)
            if not data:
                raise ValueError("archive ends within a record")
        yield b"".join(out)
        data = data or stream.read(READ_BYTES)


def _opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _store(folder: str, level: int, most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def records():
            for b in batches:
                for p, u, h, d, r in zip(b.page_id, b.url, b.html, b.digest, b.refers_to, strict=True):
                    known = lambda x: None if pd.isna(x) else int(x)
                    yield record(known(p), None if u is None or pd.isna(u) else u, (h or "").encode(), known(r), base64.b32encode(bytes.fromhex(d)).decode())

        todo, done = records(), []
        while True:
            sample, size = [], 0
            for raw in todo:
                sample.append(raw)
                size += len(raw)
                if size >= SAMPLE_BYTES or len(sample) >= SAMPLE_RECORDS:
                    break
            if not sample:
                break
            system, top = _opened(folder)
            system.create_dir(top, recursive=True)
            name = f"{uuid.uuid4().hex}.warc.zst"
            with system.open_output_stream(f"{top}/.{name}.open", compression=None) as out:
                w = Writer(out, build_dictionary(sample), level)
                for raw in sample:
                    w.add(raw)
                while w.bytes < most and (raw := next(todo, None)) is not None:
                    w.add(raw)
            system.move(f"{top}/.{name}.open", f"{top}/{name}")
            done.append((f"{folder}/{name}", w.records, w.bytes))
            yield pd.DataFrame(done[-1:], columns=["path", "records", "bytes"])

    return run


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """``page_id, url, html, digest, refers_to``: payloads of at least ``least`` bytes are stored once."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumns({"digest": F.sha1(F.col("html")), "size": F.octet_length("html")})
    again = p.where(F.col("size") >= least).groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    again = cut(again.where(F.col("n") > 1), "copies")
    total = again.agg(F.sum("n")).first()[0] or 0
    # payloads that hold a thousandth of all copies or more are a thousand at most: broadcast, so that their pages don't meet
    often = again.where(F.col("n") * HOT >= total).select("digest", "size", F.col("first").alias("often"))
    p = p.join(F.broadcast(often), ["digest", "size"], "left")
    apart = F.when(F.col("often").isNull(), F.col("digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.col("url"), F.lit(""))))
    again = again.select(F.col("digest").alias("key"), "size", "first")
    got = p.withColumn("key", apart).join(again, ["key", "size"], "left").withColumn("first", F.coalesce("often", "first"))
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return got.select("page_id", "url", "html", "digest", F.when(other, F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str, least: int = 0, level: int = 6, most: int = ARCHIVE_BYTES) -> DataFrame:
    """Archive ``pages`` in ``folder``; a lazy frame ``path, records, bytes``. Store it (``cut``) and read from what is stored: each
    run writes archives of its own. ``drop_orphans`` removes those of attempts that were lost."""
    ship(pages.sparkSession)
    return with_revisits(pages, least).mapInPandas(_store(folder, level, most), "path string, records long, bytes long")


def drop_orphans(written: DataFrame, folder: str) -> int:
    """Remove archives in ``folder`` that ``written`` (stored) does not name: of tasks that failed or ran twice. How many."""
    spark = written.sparkSession
    known = {r.path.rsplit("/", 1)[1] for r in written.select("path").toLocalIterator()}  # a name for each archive
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(folder)
    system = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = [f.getPath() for f in system.listStatus(top) if f.getPath().getName() not in known] if system.exists(top) else []
    for path in gone:
        system.delete(path, False)
    return len(gone)


def read(paths: DataFrame, tasks: int, payloads: bool = True) -> DataFrame:
    """The records of the archives named in ``paths.path``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for uri in b.path:
                system, path = _opened(uri)
                with system.open_input_stream(path, compression=None) as stream:
                    rows, size = [], 0
                    for raw in read_records(stream):
                        rows.append(parse(raw))
                        size += len(raw)
                        if not payloads:
                            rows[-1].pop("payload")
                        if len(rows) >= 2000 or payloads and size >= 16 << 20:
                            yield frame(rows)
                            rows, size = [], 0
                    if rows:
                        yield frame(rows)

    def frame(rows: list[dict]) -> pd.DataFrame:
        out = pd.DataFrame(rows)
        return out.astype({"page_id": "Int64", "refers_to": "Int64"})

    schema = SCHEMA if payloads else SCHEMA.replace("payload binary, ", "")
    return paths.select("path").repartition(tasks).mapInPandas(run, schema)
