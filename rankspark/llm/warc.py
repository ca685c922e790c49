"""WARC archives compressed with Zstandard: one frame per record, a dictionary in the leading frame.

An archive is a file of frames. The first is a skippable frame with the dictionary (itself
compressed); then each record is a frame of its own, with content size and checksum. Spark's text
writer puts the frames into files, so commits and any file system are Spark's; its line separator
is an empty skippable frame, which readers of the format pass over.

Page and response ids travel in extension headers. Equal payloads of at least ``LEAST_REVISIT``
bytes are stored once, in the record of the largest page_id; the others are revisit records
without a payload.

Defined cases: null html is an empty payload; a null url or page_id has no header; a null page_id
is below all others; rows that share the largest page_id and the payload are all responses; an
empty table gives no archive; other columns aren't stored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark import session
from rankspark.llm.registry import query
from rankspark.llm.texts import row_slices, table, utf8
from rankspark.operators import skew

#: Least payload that is worth a revisit record.
LEAST_REVISIT = 1000
#: Payload bytes of an archive, about; an archive is read by one task.
ARCHIVE_BYTES = 24 << 20
#: The dictionary is trained on so many pages (the smallest hashes of the id) of at most so many characters.
SAMPLE_PAGES, SAMPLE_CHARS = 300, 32_768
DICTIONARY_BYTES = 65_536
WARC_DATE = "1970-01-01T00:00:00Z"
# Frame magics of the Zstandard format and of dictionaries in archives.
FRAME_MAGIC, DICTIONARY_MAGIC, SKIPPABLE_MAGIC = 0xFD2FB528, 0x184D2A5D, 0x184D2A50
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

EMPTY_FRAME = struct.pack("<II", SKIPPABLE_MAGIC, 0)
RECORDS = (
    "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response record with the payload, or a revisit record that refers to one."""
    digest = hashlib.sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest.hexdigest())}",
        f"WARC-Date: {WARC_DATE}", f"WARC-Payload-Digest: sha1:{base64.b32encode(digest.digest()).decode()}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"WARC-Page-Id: {page_id}")
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest.hexdigest())}", f"WARC-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes, what: str) -> tuple[str, dict[str, str], bytes]:
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError(f"{what}: no end of the header")
    first, *lines = head.decode().split("\r\n")
    return first, {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}, rest


def parse_record(data: bytes) -> dict:
    """The row of a record; ValueError if its version, headers, lengths or digest don't hold."""
    version, head, rest = _headers(data, "record")
    if not version.startswith("WARC/1."):
        raise ValueError(f"not a record: {version[:40]!r}")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in head:
            raise ValueError(f"record without {name}")
    size = int(head["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("the record's length doesn't hold")
    _, http, payload = _headers(rest[:size], "response")
    digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
    full = int(http["content-length"])
    kind = head["warc-type"]
    if kind == "response" and (full != len(payload) or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("the payload's length or digest doesn't hold")
    if kind == "revisit" and (payload or "warc-refers-to" not in head):
        raise ValueError("a revisit with a payload, or without what it refers to")
    number = {k: int(v) if (v := head.get(k)) is not None else None for k in ("warc-page-id", "warc-refers-to-page-id")}
    url = head.get("warc-target-uri")
    return {
        "page_id": number["warc-page-id"], "url": url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
        "record_type": kind, "refers_to": number["warc-refers-to-page-id"], "payload": payload if kind == "response" else None,
        "payload_bytes": full, "payload_digest": digest,
    }


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that starts at ``at`` ends, from its own headers."""
    if len(data) - at < 8:
        raise ValueError("a frame is cut off")
    (magic,) = struct.unpack_from("<I", data, at)
    if magic & 0xFFFFFFF0 == SKIPPABLE_MAGIC:
        end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    elif magic == FRAME_MAGIC:
        head = data[at : at + 18]
        end = at + zstandard.frame_header_size(head)
        while True:
            block = int.from_bytes(data[end : end + 3], "little")
            end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
            if block & 1 or end > len(data):
                break
        end += 4 * zstandard.get_frame_parameters(head).has_checksum
    else:
        raise ValueError(f"not a frame: {magic:#x}")
    if end > len(data):
        raise ValueError("a frame is cut off")
    return end


def read_frames(data: bytes) -> Iterator[bytes]:
    """The records of an archive, with the dictionary of its leading frame."""
    view, at, unpack = memoryview(data), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        end = frame_end(view, at)
        (magic,) = struct.unpack_from("<I", view, at)
        if magic == DICTIONARY_MAGIC:
            if at:
                raise ValueError("a dictionary that doesn't lead")
            words = bytes(view[8:end])
            if words[:4] == struct.pack("<I", FRAME_MAGIC):
                words = unpack.decompress(words)
            unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))
        elif magic == FRAME_MAGIC:
            yield unpack.decompress(view[at:end])
        at = end


def dictionary_frame(words: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=19).compress(words)
    return struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary for records of such pages, from a bounded sample; empty if that is too little."""
    # Hashes of pages are sorted first; only the chosen pages travel.
    fit = pages.where(F.length("html") <= SAMPLE_CHARS).withColumn("order", F.xxhash64("page_id", "url", "html"))
    chosen = fit.select("order").distinct().orderBy("order").limit(SAMPLE_PAGES)
    rows = fit.join(F.broadcast(chosen), "order", "left_semi").select("order", "page_id", "url", utf8("html").alias("html"))
    # Pages that are repeated in every column stand once.
    sample = rows.groupBy("order").agg(F.first("page_id").alias("page_id"), F.first("url").alias("url"), F.first("html").alias("html")).orderBy("order").collect()
    texts = [record(r["page_id"], r["url"], bytes(r["html"]), None, False) for r in sample]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) to archives under ``path``."""
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    payload, key = utf8("html"), F.coalesce("page_id", F.lit(-(1 << 63)))
    narrow = session.materialise(pages.select("page_id", F.length(payload).cast("long").alias("bytes"), F.sha2(payload, 256).alias("digest")), "payloads")
    groups = narrow.where(F.col("bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.count("*").alias("k"), F.max("page_id").alias("response"))
    # Only what revisits another page is joined, and only ids and digests.
    revisits = (
        skew.attach(narrow, groups.where("k > 1"), ["digest"]).where(F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response")))
        .groupBy(key.alias("key")).agg(F.collect_set(F.struct("digest", "response")).alias("revisits")))
    total = narrow.agg(F.sum("bytes")).first()[0] or 0
    words = train_dictionary(pages)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = zstandard.ZstdCompressionDict(words) if words else None
        packer = zstandard.ZstdCompressor(level=3, dict_data=own, write_checksum=True)
        lead = [dictionary_frame(words)] if words else []
        now, to = None, {}
        for batch in row_slices(batches, 64):
            out = []
            for key, page_id, url, html, others in zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "url", "html", "revisits")), strict=True):
                if key != now:
                    now, to = key, {}
                if others is not None:  # comes before the pages of its key
                    to = {r["digest"]: r["response"] for r in others}
                    continue
                response = to.get(hashlib.sha256(html).hexdigest()) if to else None
                out.append(packer.compress(record(page_id, url, html, response, response is not None)))
            if out:
                yield pa.record_batch({"frame": pa.array(lead + out, pa.binary())})
                lead = []

    n = max(1, -(-total // archive_bytes))
    # What a page revisits goes ahead of it in one exchange; a join would need the texts sorted as well.
    rows = pages.select(key.alias("key"), F.lit(1).alias("kind"), "page_id", "url", payload.alias("html"))
    both = revisits.withColumn("kind", F.lit(0)).unionByName(rows, allowMissingColumns=True)
    dealt = both.repartition(n, "key").sortWithinPartitions("key", "kind")
    dealt.mapInArrow(frames, "frame binary").select(F.col("frame").cast("string")).write.option(
        "lineSep", EMPTY_FRAME.decode("ascii")).option("compression", "none").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under ``path``, validated."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[n] for r in held], k) for n, k in zip(names, kinds, strict=True)], names)

        for batch in row_slices(batches, 1):
            held = []
            for data in read_frames(batch.column(0)[0].as_py()):
                held.append(parse_record(data))
                if len(held) == 256:
                    yield out()
                    held = []
            if held:
                yield out()

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, RECORDS)


@query("op6_warc", """
WITH payloads AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
digests AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest, sha256(payload) AS whole FROM payloads),
largest AS (SELECT whole, max(page_id) AS response FROM digests WHERE n >= 1000 GROUP BY whole)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN response <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN response <> page_id THEN response END AS refers_to
FROM digests LEFT JOIN largest USING (whole)
""")
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages to archives and read these back."""
    path = session.new_path(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
