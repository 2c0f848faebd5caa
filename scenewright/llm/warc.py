"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; the frame sizes stand in a seek table in a skippable frame at
the file's end, so one frame can be read and decompressed by itself. An index maps each record to its bundle, its frame
and its offset within the decompressed frame. One attempt of a task writes one bundle under a name of its own, and the
index, which is committed with the task, names it: an attempt that failed leaves a file that no index names, which
``sweep`` deletes.

Of records with equal payloads one is a response and the others are revisits that refer to it and have no block. Rows that repeat the id
and the payload of a response are counted by url before they are shuffled, so that a page said often is one row.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Cut, as_bytes, pick, scratch_path, small

#: Bytes of records after which a frame is closed.
FRAME = 1 << 20
LEVEL = 3
#: Bytes of records that one task reads back.
READ = 64 << 20
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_BREAK = b"\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(page_id: int | str | None) -> str:
    return f"<urn:page:{'' if page_id is None else quote(str(page_id), safe='')}>"


def record(page_id: int | str | None, url: str | None, payload: bytes, refers_to: int | str | None, revisit: bool) -> bytes:
    """A WARC/1.1 record. A revisit has the payload's digest and length in its header, and no block."""
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(page_id)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%/:?#[]@!$&'()*+,;=-._~"))
    head += ["WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {urn(refers_to)}")
    else:
        head.append("Content-Type: text/html; charset=utf-8")
    block = b"" if revisit else payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + 2 * _BREAK + block + 2 * _BREAK


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes]:
    """The header fields and the block of the record at an offset."""
    end = data.index(2 * _BREAK, at)
    lines = data[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no record begins here")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    block = data[end + 4 : end + 4 + size]
    if len(block) != size or data[end + 4 + size : end + 8 + size] != 2 * _BREAK:
        raise ValueError("the record is cut short")
    return fields, block


class BundleWriter:
    """Writes records to a stream in frames, then the seek table."""

    def __init__(self, out, frame: int = FRAME):
        self.out, self.limit = out, frame
        self.held: list[bytes] = []
        self.size = 0
        self.frames: list[tuple[int, int]] = []
        self.made = zstandard.ZstdCompressor(level=LEVEL)

    def add(self, data: bytes) -> tuple[int, int]:
        """The frame, and the offset within it, of the record."""
        if self.size >= self.limit:
            self.flush()
        at = len(self.frames), self.size
        self.held.append(data)
        self.size += len(data)
        return at

    def flush(self) -> None:
        if self.held:
            packed = self.made.compress(b"".join(self.held))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(table)) + table)
        self.out.close()


class BundleReader:
    """Reads single frames of a bundle by its seek table."""

    def __init__(self, source):
        self.source = source
        total = source.size()
        source.seek(total - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != _SEEKABLE or flags & 0x7F:
            raise ValueError("no seek table")
        width = 12 if flags & 0x80 else 8
        source.seek(total - 9 - n * width)
        table = source.read(n * width)
        self.frames, at = [], 0
        for k in range(n):
            packed, size = struct.unpack_from("<II", table, k * width)
            self.frames.append((at, packed, size))
            at += packed

    def frame(self, k: int) -> bytes:
        at, packed, size = self.frames[k]
        self.source.seek(at)
        return zstandard.ZstdDecompressor().decompress(self.source.read(packed), max_output_size=size)


def decisions(pages: DataFrame) -> DataFrame:
    """(d_id, d_sha, first_id, later, copies) once for each id and payload that occurs again: whether it comes after the payload's first, and how often it occurs.

    The first has the smallest page_id; a null id comes after any.
    """
    keys = pages.select("page_id", F.sha2(F.encode("html", "UTF-8"), 256).alias("sha")).groupBy("page_id", "sha").agg(F.count("*").alias("copies"))
    first = keys.groupBy(F.col("sha").alias("f_sha")).agg(F.min("page_id").alias("first_id"), F.sum("copies").alias("n")).filter("n > 1")
    later = ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return keys.join(first, F.col("sha") == F.col("f_sha")).select(F.col("page_id").alias("d_id"), F.col("sha").alias("d_sha"), "first_id", later.alias("later"), "copies").filter("later or copies > 1")


def write_archives(spark: SparkSession, pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html) below ``folder``, and return the index. Ids are whole numbers or texts.

    The index has (page_id, bundle, frame, at, size). The response of equal payloads of ``least`` bytes or more is the
    row with the smallest page_id, and of rows that repeat that id the one with the smallest url; the others are revisits of it. A null html is an
    empty payload. An empty table gives bundles without records, or none.
    """
    own = pick(pages, page_id="page_id", url="url", html="html").withColumn("html", F.coalesce("html", F.lit("")))
    if own.schema["page_id"].dataType.simpleString() != "string":
        own = own.withColumn("page_id", F.col("page_id").cast("long"))
    later = decisions(own.filter(F.octet_length("html") >= least) if least else own)
    own = own.withColumn("sha", F.sha2(F.encode("html", "UTF-8"), 256))
    on = F.col("page_id").eqNullSafe(F.col("d_id")) & (F.col("sha") == F.col("d_sha"))
    joined = own.join(later, on, "left")
    decided = joined.filter("later is null or later").select("page_id", "url", "html", "first_id", F.col("later").isNotNull().alias("revisit"))
    # the response's own repeats: counted by url, with the payload once
    again = joined.filter("not later").groupBy("page_id", "sha", "url").agg(F.count("*").alias("n"), F.first("html").alias("html"))
    place = F.row_number().over(Window.partitionBy("page_id", "sha").orderBy(F.col("url").asc_nulls_last()))
    spread = again.withColumn("place", place).select("page_id", "url", "html", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"), "place")
    one = F.col("place") * F.col("copy") == 1
    repeats = spread.select("page_id", "url", "html", F.when(~one, F.col("page_id")).alias("first_id"), (~one).alias("revisit"))
    if not later.filter("not later").isEmpty():
        decided = decided.unionByName(repeats)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst"
        writer = None
        for batch in small(batches):
            if not batch.num_rows:
                continue
            if writer is None:
                fs.create_dir(root, recursive=True)
                writer = BundleWriter(fs.open_output_stream(f"{root}/{name}", compression=None))
            ids, urls, first, revisit = (batch.column(k).to_pylist() for k in (0, 1, 3, 4))
            rows = []
            for i, u, payload, f, r in zip(ids, urls, as_bytes(batch.column(2)), first, revisit):
                data = record(i, u, payload, f, r)
                rows.append((i, name, *writer.add(data), len(data)))
            kinds = [batch.column(0).type, pa.string(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], ["page_id", "bundle", "frame", "at", "size"])
        if writer is not None:
            writer.close()

    kind = own.schema["page_id"].dataType.simpleString()
    return Cut(spark)(decided.mapInArrow(write, f"page_id {kind}, bundle string, frame int, at long, size long"), "index")


def sweep(index: DataFrame, folder: str) -> int:
    """Delete the bundles of failed attempts, and return their number. The names, one for each task, come to the driver."""
    fs, root = pafs.FileSystem.from_uri(folder)
    named = {r.bundle for r in index.select("bundle").distinct().toLocalIterator()}
    stray = [f for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.base_name not in named]
    for f in stray:
        fs.delete_file(f.path)
    return len(stray)


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record that the index names, read from the bundles.

    Only the frames with a named record are read, some ``READ`` bytes of records by a task. A response whose payload isn't what its header says raises ValueError.
    """

    kind = index.schema["page_id"].dataType.simpleString()
    text = kind == "string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        bundle = reader = frame = data = None
        number = lambda x: (unquote(x[10:-1]) if text else int(x[10:-1])) if len(x) > 11 else None
        for batch in batches:
            rows = []
            for b, f, at in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if b != bundle:
                    if reader:
                        reader.source.close()
                    bundle, frame = b, None
                    reader = BundleReader(fs.open_input_file(f"{root}/{b}"))
                if f != frame:
                    frame, data = f, reader.frame(f)
                fields, block = parse(data, at)
                want, size = fields["WARC-Payload-Digest"][5:], int(fields["X-Payload-Length"])
                kind = fields["WARC-Type"]
                if kind == "response" and (len(block) != size or digest(block) != want):
                    raise ValueError(f"the payload of {fields['WARC-Record-ID']} is damaged")
                refers = number(fields["WARC-Refers-To"]) if kind == "revisit" else None
                rows.append((number(fields["WARC-Record-ID"]), size, want, kind, refers))
            own = pa.string() if text else pa.int64()
            kinds = [own, pa.int64(), pa.string(), pa.string(), own]
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    total = index.agg(F.sum("size")).first()[0] or 0
    ordered = index.select("bundle", "frame", "at").repartition(total // READ + 1, "bundle", "frame").sortWithinPartitions("bundle", "frame", "at")
    return ordered.mapInArrow(read, f"page_id {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write all of ``pages`` to archives in the shared folder and read them back."""
    folder = scratch_path(spark, "archives")
    return read_archives(write_archives(spark, pages, folder), folder)
