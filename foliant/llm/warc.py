"""WARC archives in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each a group of whole records, and a seek table in a
skippable frame at its end (sizes and checksums of the frames, then their number and a magic number), as
in the public seekable format. Beside it stands an index: for each record, its identifier, its frame, and
its offset and length within the frame's plain bytes. Bundles are rows of a Parquet table in the folder that all executors share, so that
any executor can read them and a lost task is written anew; export() turns them into files.

Of records with equal payloads of at least LEAST_REVISIT bytes, that with the smallest id is a response and
the others refer to it: the first ids are aggregated per digest before they meet the records, and the
join's key is salted, so that many copies of a payload are dealt to many tasks.

Null html is an empty payload; null ids are kept, and never the smallest; a payload that only null ids have is
all responses. Repeated rows are records each, with identifiers of their own: all with the smallest id are responses. Null urls have
no target header. An empty table gives no bundle; a payload of any length is one record, in one frame.
"""

from __future__ import annotations

import hashlib
import io
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import table, written

LEAST_REVISIT = 100
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 4 << 20
SALTS = 16
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
DATE = "2000-01-01T00:00:00Z"
BUNDLES = "bundle string, data binary, ids array<string>, frames array<int>, offsets array<long>, lengths array<long>"


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, place: str = "0") -> bytes:
    """One WARC record: a response with its payload, or a revisit with the response's header only.

    Its identifier is the page's and, as pages may be repeated, its own ``place``; a page without an id has the place only.
    """
    ident = f"urn:none:{place}" if page_id is None else f"urn:page:{quote(page_id, safe='')}#{place}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{ident}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='/:?#[]@!$&()*+,;=%')}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{quote(refers_to, safe='')}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


class Bundle:
    """A bundle in the making."""

    def __init__(self, level: int = 3):
        self.pack = zstandard.ZstdCompressor(level=level, write_content_size=True).compress
        self.out, self.frame, self.held = io.BytesIO(), bytearray(), 0
        self.table: list[tuple[int, int, int]] = []
        self.index: list[tuple[str | None, int, int, int]] = []

    def add(self, page_id: str | None, data: bytes) -> None:
        if self.frame and len(self.frame) + len(data) > FRAME_BYTES:
            self.flush()
        self.index.append((page_id, len(self.table), len(self.frame), len(data)))
        self.frame += data

    def flush(self) -> None:
        if self.frame:
            plain = bytes(self.frame)
            packed = self.pack(plain)
            self.out.write(packed)
            self.table.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
            self.frame.clear()

    def size(self) -> int:
        return self.out.tell() + len(self.frame)

    def done(self) -> bytes:
        self.flush()
        entries = b"".join(struct.pack("<III", *x) for x in self.table)
        footer = struct.pack("<IBI", len(self.table), 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        return self.out.getvalue()


def seek_table(data: bytes) -> list[tuple[int, int, int, int]]:
    """(offset, packed size, plain size, checksum) of each frame, from the bundle's end."""
    count, flags, magic = struct.unpack_from("<IBI", data, len(data) - 9)
    if magic != SEEKABLE or flags != 0x80:
        raise ValueError("no seek table")
    at, out = len(data) - 9 - 12 * count, []
    offset = 0
    for k in range(count):
        packed, plain, check = struct.unpack_from("<III", data, at + 12 * k)
        out.append((offset, packed, plain, check))
        offset += packed
    return out


def frame(data: bytes, entry: tuple[int, int, int, int]) -> bytes:
    offset, packed, size, check = entry
    plain = zstandard.ZstdDecompressor().decompress(data[offset : offset + packed], max_output_size=size) if size else b""
    if len(plain) != size or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != check:
        raise ValueError("a frame is damaged")
    return plain


def seek(data: bytes, frame_no: int, offset: int, length: int) -> bytes:
    """One record's bytes; no other frame is unpacked."""
    return frame(data, seek_table(data)[frame_no])[offset : offset + length]


def records(plain: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers and block of each record of a frame."""
    at = 0
    while at < len(plain):
        end = plain.index(b"\r\n\r\n", at)
        lines = plain[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("no WARC record")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        size = int(headers["Content-Length"])
        yield headers, plain[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, payload, digest, refers_to): refers_to is the response's id for revisits."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = rows.where(F.octet_length("payload") >= LEAST_REVISIT).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    first = first.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    both = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(first, ["digest", "salt"], "left")
    return both.select("id", "url", "payload", "digest", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The table of bundles (BUNDLES) with a record for each row of ``pages``, in the shared folder."""
    rows = with_revisits(pages, id_col, url_col, html_col).withColumns({"id": F.col("id").cast("string"), "refers_to": F.col("refers_to").cast("string")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, part = 0, TaskContext.get().partitionId()

        def row(bundle: Bundle) -> pa.RecordBatch:
            data = bundle.done()
            ids, frames, offsets, lengths = map(list, zip(*bundle.index, strict=True))
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{made:06d}"]), pa.array([data], pa.binary()), pa.array([ids], pa.list_(pa.string())), pa.array([frames], pa.list_(pa.int32())), pa.array([offsets], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64()))], [x.split()[0] for x in BUNDLES.split(", ")])

        bundle = Bundle()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    bundle.add(page_id, record(page_id, url, payload.encode("utf-8", "surrogatepass"), digest, refers_to, f"{part:06d}-{made:06d}-{len(bundle.index)}"))
                    if bundle.size() >= BUNDLE_BYTES:
                        yield row(bundle)
                        made, bundle = made + 1, Bundle()
        if bundle.index:
            yield row(bundle)

    return written(rows.mapInArrow(run, BUNDLES), "warc")


def read(bundles: DataFrame, id_type: str = "long") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, frame, offset): what the archives hold.

    A response's digest is that of the payload read and must equal its header's.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "bundle", "frame", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ident = lambda x: unquote(x.removeprefix("<urn:page:").removesuffix(">").partition("#")[0]) if x.startswith("<urn:page:") else None

        for batch in batches:
            for k in range(batch.num_rows):
                name, data, places = batch.column("bundle")[k].as_py(), batch.column("data")[k].as_py(), iter(zip(batch.column("frames")[k].as_py(), batch.column("offsets")[k].as_py(), strict=True))
                out = []
                for entry in seek_table(data):
                    for headers, block in records(frame(data, entry)):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        size = int(head.rpartition(b"Content-Length: ")[2])
                        kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha256:")
                        if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"a payload in {name} is damaged")
                        refers = ident(headers["WARC-Refers-To"]) if kind == "revisit" else None
                        out.append((ident(headers["WARC-Record-ID"]), size, digest, kind, refers, name, *next(places)))
                columns = list(zip(*out, strict=True))
                types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    found = bundles.select("bundle", "data", "frames", "offsets").mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, bundle string, frame int, offset long")
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def locate(bundles: DataFrame, id_type: str = "long") -> DataFrame:
    """(page_id, bundle, frame, offset, length): the index alone; no bundle's data is read."""
    rows = bundles.select("bundle", F.explode(F.arrays_zip("ids", "frames", "offsets", "lengths")).alias("x"))
    return rows.select(F.col("x.ids").cast(id_type).alias("page_id"), "bundle", F.col("x.frames").alias("frame"), F.col("x.offsets").alias("offset"), F.col("x.lengths").alias("length"))


def export(bundles: DataFrame, folder: str) -> list[str]:
    """The bundles as files <folder>/<bundle>.warc.zst, through Hadoop's file system; one bundle at a time on the driver."""
    spark = bundles.sparkSession
    jvm, conf, out = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for row in bundles.select("bundle", "data").toLocalIterator():
        path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{row['bundle']}.warc.zst")
        stream = path.getFileSystem(conf).create(path, True)
        stream.write(bytearray(row["data"]))
        stream.close()
        out.append(path.toString())
    return out


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return read(write(pages), pages.schema["page_id"].dataType.simpleString()).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
  CASE WHEN f.first IS NOT NULL AND d.page_id IS DISTINCT FROM f.first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN d.page_id IS DISTINCT FROM f.first THEN f.first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""
