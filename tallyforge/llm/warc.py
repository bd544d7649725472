"""WARC archives in seekable Zstandard bundles.

Records lie in independent Zstandard frames; each bundle ends in a skippable frame that holds the seek table (the
published "seekable format": compressed and decompressed size of each frame, number of frames, magic number). The index
gives each record's identifier, frame and offset inside that frame, so one record costs one frame to read.

A bundle is a row of a Parquet table in the shared folder, of bounded size unless one record alone is larger; a lost
executor's bundles are written again by the table's own commit protocol.

Defined results: a null payload is empty; a null url is an empty target; a null page_id is smaller than any other, and
where all ids of equal payloads are null, all are responses; rows that tie at the largest page_id are all responses; an
empty table gives no rows; further columns of the table are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import byte_rows, written

# Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
MIN_REVISIT = 1000
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 1 << 20
SALTS = 16
DATE = "1970-01-01T00:00:00Z"

BUNDLES = "bundle_id string, bundle binary, records array<struct<record_id:string,page_id:bigint,digest:string,frame:int,offset:int,length:int>>"
RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def record_id(archive_id: str, kind: str, part: int, number: int, page_id, url: bytes, digest: str) -> str:
    """The identifier of a record, from its archive, its place there and its content: no two are equal, also of rows whose page_id repeats
    or is null, and of two archives of the same pages; a task that runs again gives the same."""
    name = hashlib.sha1(f"{archive_id}/{kind}/{part}/{number}/{page_id}/{digest}/".encode() + url).hexdigest()
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, name)}"


def make_record(own_id: str, page_id, url: bytes, payload: bytes, length: int, digest: str, refers_to, target_id: str = "", date: str = DATE) -> bytes:
    """One WARC/1.1 record; refers_to (a page_id) is None in a response, target_id is the identifier of its record. A url's control bytes and spaces are percent-coded."""
    target = b"".join(b"%%%02X" % c if c <= 0x20 or c == 0x7F else bytes((c,)) for c in url)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{own_id}>", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http;msgtype=response",
        f"WARC-X-Page-Id: {'' if page_id is None else page_id}", f"WARC-X-Payload-Length: {length}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{target_id}>", f"WARC-X-Refers-To-Page: {refers_to}"]
    lines = "\r\n".join(head).encode() + b"\r\nWARC-Target-URI: " + target
    return lines + b"\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers (lower-case names), payload and end of the record that begins at `at`."""
    stop = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:stop].split(b"\r\n")
    if first != b"WARC/1.1":
        raise ValueError("no WARC record here")
    heads = {k.decode().lower(): v.strip().decode("utf-8", "replace") for k, _, v in (line.partition(b":") for line in lines)}
    begin, size = stop + 4, int(heads["content-length"])
    block = data[begin : begin + size]
    return heads, block[block.index(b"\r\n\r\n") + 4 :], begin + size + 4


def seal(frames: list[tuple[bytes, int]]) -> bytes:
    """Frames with their decompressed sizes, and the seek table behind them."""
    entries = b"".join(struct.pack("<II", len(f), n) for f, n in frames)
    foot = entries + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return b"".join(f for f, _ in frames) + struct.pack("<II", SKIPPABLE, len(foot)) + foot


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, decompressed size) of each frame, from the bundle's foot."""
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    begin, table, at = len(bundle) - 9 - n * width, [], 0
    for k in range(n):
        size, plain = struct.unpack_from("<II", bundle, begin + k * width)
        table.append((at, size, plain))
        at += size
    return table


def read_frame(bundle: bytes, table: list[tuple[int, int, int]], frame: int) -> bytes:
    start, size, plain = table[frame]
    return zstandard.ZstdDecompressor().decompress(bundle[start : start + size], max_output_size=plain)


def read_one(bundle: bytes, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """The record at an offset of a frame: nothing but that frame is decompressed."""
    return parse_record(read_frame(bundle, seek_table(bundle), frame), offset)[:2]


def typed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Each page with its payload, digest and refers_to (null: a response)."""
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.encode(F.col(payload_col), "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"length": F.octet_length("payload").cast("bigint"), "digest": F.sha1("payload")})
    long = rows.where(F.col("length") >= min_revisit)
    heads = long.groupBy(F.col("digest").alias("d")).agg(F.max("page_id").alias("target"), F.count(F.lit(1)).alias("n")).where("n > 1 and target is not null")
    heads = heads.select("d", "target", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    # Rows below the bound, among which are all null and empty payloads, carry salts that join with nothing and spread them.
    part = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
    rows = rows.withColumn("salt", F.when(F.col("length") >= min_revisit, part).otherwise(-1 - part))
    found = rows.join(heads, (F.col("digest") == F.col("d")) & (F.col("salt") == F.col("s")), "left")
    return found.select("page_id", "url", "payload", "length", "digest", F.expr("case when target is not null and not (page_id <=> target) then target end").alias("refers_to"))


def bundled(rows: DataFrame, kind: str, archive_id: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Bundles of rows (page_id, url, payload, length, digest, refers_to, target_id), one or more for each partition."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3, write_content_size=True)
        frames: list[tuple[bytes, int]] = []
        index: list[dict] = []
        open_records: list[bytes] = []
        held, number, part = 0, 0, TaskContext.get().partitionId()

        def close_frame():
            nonlocal held
            if open_records:
                plain = b"".join(open_records)
                frames.append((packer.compress(plain), len(plain)))
                open_records.clear()
                held = 0

        def close_bundle():
            close_frame()
            bundle = seal(frames)
            out = pa.RecordBatch.from_arrays([pa.array([hashlib.sha1(bundle).hexdigest()]), pa.array([bundle], pa.binary()), pa.array([list(index)], INDEX)], ["bundle_id", "bundle", "records"])
            frames.clear()
            index.clear()
            return out

        for batch in batches:
            ids, urls, payloads, lengths, digests, refers, targets = (batch.column(k) for k in range(7))
            for page_id, url, payload, length, digest, to, target in zip(ids.to_pylist(), byte_rows(urls), byte_rows(payloads), lengths.to_pylist(), digests.to_pylist(), refers.to_pylist(), targets.to_pylist()):
                own_id, number = record_id(archive_id, kind, part, number, page_id, bytes(url), digest), number + 1
                record = make_record(own_id, page_id, bytes(url), bytes(payload), length, digest, to, target or "")
                index.append({"record_id": own_id, "page_id": page_id, "digest": digest, "frame": len(frames), "offset": held, "length": len(record)})
                open_records.append(record)
                held += len(record)
                if held >= frame_bytes:
                    close_frame()
                    if sum(len(f) for f, _ in frames) >= bundle_bytes:
                        yield close_bundle()
        if frames or open_records:
            yield close_bundle()

    return rows.mapInArrow(write, BUNDLES)


INDEX = pa.list_(pa.struct([("record_id", pa.string()), ("page_id", pa.int64()), ("digest", pa.string()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())]))


def read_back(bundles: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the bundles, found by the index through the seek table; a response's digest is taken anew from its payload."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle, index in zip(byte_rows(batch.column(1)), batch.column(2).to_pylist()):
                bundle = bytes(bundle)
                table, at, plain, rows = seek_table(bundle), -1, b"", []
                for entry in index:
                    if entry["frame"] != at:
                        at = entry["frame"]
                        plain = read_frame(bundle, table, at)
                    heads, payload, end = parse_record(plain, entry["offset"])
                    if heads["warc-record-id"] != f"<{entry['record_id']}>" or end - entry["offset"] != entry["length"]:
                        raise ValueError("the index and the archive differ")
                    kind, length = heads["warc-type"], int(heads["warc-x-payload-length"])
                    said = base64.b32decode(heads["warc-payload-digest"].removeprefix("sha1:")).hex()
                    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != said):
                        raise ValueError("a payload differs from its digest")
                    number = lambda k: int(v) if (v := heads.get(k)) else None
                    rows.append((number("warc-x-page-id"), heads["warc-target-uri"], length, said, kind, number("warc-x-refers-to-page"), payload if payloads and kind == "response" else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()))], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    return bundles.mapInArrow(read, RECORDS)


def looked_up(bundles: DataFrame, record_ids: list[str]) -> DataFrame:
    """(record_id, headers, payload) of the records named: of each bundle that holds one, only its frame is decompressed."""
    wanted = [x.strip("<>") for x in record_ids]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, heads, payloads = [], [], []
            for bundle, entries in zip(byte_rows(batch.column(0)), batch.column(1).to_pylist()):
                for e in entries:
                    found, payload = read_one(bytes(bundle), e["frame"], e["offset"])
                    names.append(e["record_id"]), heads.append(list(found.items())), payloads.append(payload)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(heads, pa.map_(pa.string(), pa.string())), pa.array(payloads, pa.binary())], ["record_id", "headers", "payload"])

    named = F.filter("records", lambda r: r["record_id"].isin(wanted))
    return bundles.select("bundle", named.alias("records")).where(F.size("records") > 0).mapInArrow(read, "record_id string, headers map<string,string>, payload binary")


def archive(pages: DataFrame, archive_id: str | None = None, **options) -> DataFrame:
    """The bundles of all pages, written to the shared folder: the responses, and then the revisits, which name the responses' identifiers.

    archive_id goes into every record's identifier; without one each archive has its own, so bundles of several may lie in one table."""
    archive_id = archive_id or uuid.uuid4().hex
    rows = typed(pages, **options)
    none = F.lit(None).cast("string").alias("target_id")
    responses = written(bundled(rows.where("refers_to is null").select("*", none), "response", archive_id), "warc")
    known = responses.select(F.inline("records")).groupBy(F.col("digest").alias("d"), F.col("page_id").alias("target")).agg(F.min("record_id").alias("target_id"))
    again = rows.where("refers_to is not null").select("page_id", "url", F.lit(b"").alias("payload"), "length", "digest", "refers_to")
    heads = known.join(again.select("digest", "refers_to").distinct(), (F.col("d") == F.col("digest")) & (F.col("target") == F.col("refers_to")), "left_semi")
    heads = heads.select("d", "target_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    again = again.withColumn("s", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    again = again.join(heads, (F.col("digest") == F.col("d")) & (again["s"] == heads["s"])).select("page_id", "url", "payload", "length", "digest", "refers_to", "target_id")
    return responses.union(written(bundled(again, "revisit", archive_id), "warc"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_back(archive(spark.read.parquet(f"{sf_dir}/pages.parquet")), payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
with p as (select page_id, coalesce(html, '') as h from pages),
q as (select page_id, cast(strlen(h) as bigint) as payload_bytes, sha1(h) as payload_digest from p),
g as (select payload_digest as d, max(page_id) as top from q where payload_bytes >= 1000 group by 1)
select page_id, payload_bytes, payload_digest,
  case when top is not null and page_id is distinct from top then 'revisit' else 'response' end as record_type,
  case when top is not null and page_id is distinct from top then top end as refers_to
from q left join g on q.payload_digest = g.d and q.payload_bytes >= 1000
"""
