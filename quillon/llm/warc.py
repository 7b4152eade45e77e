"""WARC archives as seekable Zstandard bundles.

A task groups its records into frames of about FRAME bytes, each an independent Zstandard frame, and frames into bundle
files of about BUNDLE bytes. A bundle ends with a seek table in a skippable frame: for every frame its compressed and
uncompressed size, then the number of frames, a flags byte and the magic number of the seekable format. The index maps a
record to its bundle, frame and offset within the frame, so one record costs one frame's decompression.

Records of equal payloads of at least REVISIT bytes: the one with the largest id is the response, the others revisit it.
They are told by SHA-1 with length and SHA-256, counted with partial aggregation on digests alone; what is found is joined to
the pages, which are dealt once by id and digest. Reading back deals bundles to READERS tasks at most, one bundle each below.

Bundles go to a folder that driver and executors share, through pyarrow.fs (local paths, hdfs, s3, gs). Files carry the
task attempt in their name and the index names the files of the attempts that succeeded, so retries leave no mixture.

WARC-Date is a parameter, since pages have no date. WARC-Record-ID is <urn:page:ID>; where an id is null or repeats, the
record's place in its writing task follows, so that no two records share one.

Defined results: a null payload is the empty one; a null id is read back as null; repeated ids are records like others (of
equal payloads all with the largest id are responses); null urls are written as an empty target; an empty table writes
nothing and reads back no rows; ids must be whole numbers or text that is one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import stage, work_folder

FRAME, BUNDLE, REVISIT, LEVEL, READERS = 1 << 19, 64 << 20, 1000, 3, 20_000
DATE = "1970-01-01T00:00:00Z"
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "record_id long, bundle string, frame long, frame_at long, frame_bytes long, offset long, length long"


def record(record_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str, place: str = "", date: str = DATE) -> bytes:
    """One WARC/1.1 record; `place` tells records of one id apart. A revisit has no block; its payload's length is in an extension header."""
    name = f"<urn:page:{'' if record_id is None else record_id}{place and ':' + place}>"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {name}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at `at`."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    size = int(head["Content-Length"])
    return head, data[end + 4 : end + 4 + size], end + 8 + size


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(tail: bytes) -> list[tuple[int, int]]:
    """(compressed, uncompressed) size of every frame, from a bundle's bytes or enough of its end."""
    n, _, magic = struct.unpack("<IBI", tail[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    return list(struct.iter_unpack("<II", tail[-9 - 8 * n : -9]))


class Writer:
    """Bundles of one task attempt; index rows as they become known."""

    def __init__(self, folder: str, attempt: str, frame: int = FRAME, bundle: int = BUNDLE):
        import zstandard

        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.folder, self.attempt, self.frame, self.bundle = folder, attempt, frame, bundle
        self.fs.create_dir(self.root, recursive=True)
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.parts, self.held, self.rows, self.done, self.out, self.number = [], 0, [], [], None, 0

    def add(self, record_id: int | None, data: bytes) -> None:
        self.rows.append((record_id, self.held, len(data)))
        self.parts.append(data)
        self.held += len(data)
        if self.held >= self.frame:
            self.close_frame()

    def close_frame(self) -> None:
        if not self.parts:
            return
        if self.out is None:
            self.name = f"{self.attempt}-{self.number:05d}.warc.zst"
            self.out, self.sizes, self.written = self.fs.open_output_stream(f"{self.root}/{self.name}", compression=None), [], 0
        packed = self.packer.compress(b"".join(self.parts))
        self.out.write(packed)
        self.done += [(k, f"{self.folder}/{self.name}", len(self.sizes), self.written, len(packed), at, n) for k, at, n in self.rows]
        self.sizes.append((len(packed), self.held))
        self.written += len(packed)
        self.parts, self.held, self.rows = [], 0, []
        if self.written >= self.bundle:
            self.close()

    def close(self) -> None:
        self.close_frame()
        if self.out is not None:
            self.out.write(seek_table(self.sizes))
            self.out.close()
            self.out, self.number = None, self.number + 1

    def index(self) -> pa.RecordBatch:
        names = [x.split()[0] for x in INDEX.split(", ")]
        columns = list(zip(*self.done, strict=True)) if self.done else [()] * len(names)
        self.done = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "bundle" else pa.int64()) for n, c in zip(names, columns, strict=True)], names)


def revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """id, row (a hash that names the row) and refers_to of the records that only revisit another."""
    body = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), body.alias("body")).filter(F.octet_length("body") >= REVISIT)
    rows = rows.select("id", F.octet_length("body").alias("bytes"), F.sha1("body").alias("sha1"), F.unhex(F.sha2("body", 256)).alias("sha2"))
    same = ["sha1", "sha2", "bytes"]
    held = rows.groupBy(*same).agg(F.max("id").alias("response"), F.count("*").alias("n")).filter("n > 1 AND response IS NOT NULL")
    return rows.join(held, same).filter(~F.col("id").eqNullSafe(F.col("response"))).groupBy("id", "sha1").agg(F.max("response").alias("refers_to"))


def write(pages: DataFrame, folder: str, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", date: str = DATE) -> DataFrame:
    """Write the bundles; the index, one row a record, as a table of the work folder."""
    body = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("body"), F.sha1(body).alias("sha1"))
    ids = rows.select("id", "sha1")
    often = ids.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1 AND id IS NOT NULL").select("id")
    again = ids.join(often, "id", "left_semi").select("id", "sha1", F.lit(None).cast("long").alias("refers_to"), F.lit(True).alias("again"))
    back = revisits(pages, id_col, payload_col).withColumn("again", F.lit(False)).unionByName(again)
    back = back.groupBy(F.col("id").alias("rid"), F.col("sha1").alias("rsha")).agg(F.max("refers_to").alias("refers_to"), F.max("again").alias("again"))
    rows = rows.join(back, rows["id"].eqNullSafe(back["rid"]) & (rows["sha1"] == back["rsha"]), "left")
    unlike = F.col("id").isNull() | F.coalesce("again", F.lit(False))
    rows = rows.select("id", "url", F.col("body").cast("binary").alias("body"), "sha1", "refers_to", unlike.alias("again"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        out, number = Writer(folder, f"part-{task.partitionId():06d}-{task.taskAttemptId()}"), 0
        for b in batches:
            for k in range(b.num_rows):
                i, url, payload, digest, to, again = (c[k].as_py() for c in b.columns)
                number += 1
                out.add(i, record(i, url, payload, to, digest, f"{task.partitionId()}-{number}" if again else "", date))
            yield out.index()
        out.close()
        yield out.index()

    return stage(rows.mapInArrow(run, INDEX), "warc-index")


def read(index: DataFrame) -> DataFrame:
    """Every record of the bundles that the index names, frame by frame through each bundle's seek table."""
    bundles = index.select("bundle").distinct()
    bundles = bundles.repartition(min(READERS, max(1, 2 * bundles.count())), "bundle")  # a set number, so that names of few bytes aren't put into one task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, name = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(name) as f:
                    f.seek(f.size() - 9)
                    n = struct.unpack("<IBI", f.read(9))[0]
                    f.seek(f.size() - 9 - 8 * n)
                    sizes, at = read_seek_table(f.read()), 0
                    for packed, whole in sizes:
                        f.seek(at)
                        yield _rows(unpack.decompress(f.read(packed), max_output_size=whole))
                        at += packed

    return bundles.mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def read_record(index: DataFrame, record_id: int) -> list[tuple[dict[str, str], bytes]]:
    """Headers and block of the records with that id: one frame is read for each."""
    import zstandard

    out = []
    for r in index.filter(F.col("record_id") == record_id).collect():
        fs, name = pafs.FileSystem.from_uri(r.bundle)
        with fs.open_input_file(name) as f:
            f.seek(r.frame_at)
            frame = zstandard.ZstdDecompressor().decompress(f.read(r.frame_bytes))
        out.append(parse(frame, r.offset)[:2])
    return out


def _number(name: str) -> int | None:
    number = name[10:-1].split(":")[0]
    return int(number) if number else None


def _rows(frame: bytes) -> pa.RecordBatch:
    out, at = [], 0
    while at < len(frame):
        head, block, at = parse(frame, at)
        to = head.get("WARC-Refers-To")
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:") if to else hashlib.sha1(block).hexdigest()
        out.append((_number(head["WARC-Record-ID"]), head["WARC-Target-URI"], block, int(head["X-Payload-Length"]) if to else len(block), digest, head["WARC-Type"], _number(to) if to else None))
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), kinds, strict=True)], [n for n, _ in kinds])


def query(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    return read(write(pages, work_folder(spark, "warc"))).drop("payload", "url")


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
                  max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM p
"""
