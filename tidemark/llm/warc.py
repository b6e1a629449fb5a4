"""WARC archives of web pages: written with one gzip member per record, read in sequence.

The reader decompresses a member at a time and a slice at a time, cuts records by their content length and verifies
their digests. Of records with equal payloads one is a response and the others revisit it, without the payload.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import checkpointed, join_groups, parts_for, read_raw, write_raw

#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SLICE = 1 << 16


def record_id(page_id: int | None, url: str | None, digest: str, copy: int = 0) -> str:
    """No two records of an archive share it: ``copy`` counts the repeats of a row."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{url}:{digest}:{copy}')}>"


def block_of(payload_bytes: int, payload: bytes) -> bytes:
    """The HTTP response; its own content length tells a revisit's payload size, too."""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode() + payload


def member(headers: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """A record as a gzip member of its own."""
    headers = [*headers, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    z = zlib.compressobj(level, wbits=31)
    return z.compress(head.encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def _safe(url: str | None, page_id: int | None) -> str:
    """The target, or a name of the page where the URL is missing or has control characters."""
    return url if url and url.isprintable() else f"urn:page:{page_id}"


def _page_record(page_id: int | None, url: str | None, digest: str, payload: bytes, copy: int, refers_to: tuple[int | None, str | None] | None) -> bytes:
    """``refers_to``: page_id and url of the response that this record revisits."""
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, url, digest, copy)),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-Target-URI", _safe(url, page_id)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(*refers_to, digest)), ("WARC-Refers-To-Target-URI", _safe(refers_to[1], refers_to[0]))]
        if refers_to[0] is not None:
            headers.append(("X-Refers-To-Page-ID", str(refers_to[0])))
    return member(headers, block_of(len(payload), payload if refers_to is None else b""))


def closed(data: bytes) -> bytes:
    """``data``, a member, with a short metadata record behind it unless it ends in a zero byte.

    The last four bytes of a member are its length before compression, so one of less than 16 MB ends in zero.
    """
    if data[-1] == 0:
        return data
    name = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, hashlib.sha256(data).hexdigest())}>"
    return data + member([("WARC-Type", "metadata"), ("WARC-Record-ID", name), ("WARC-Date", "2024-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], b"end: true\r\n")


def _archives(file_bytes: int):
    """A partition's archives, one per row, each of whole members and without its last byte, which is zero.

    Rows come sorted by page, the markers of a page's payload (those without html) before it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[bytes] = []
        size, seen, copy, marker = 0, None, 0, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(out)[:-1]], pa.binary())], ["bytes"])

        for batch in batches:
            names = ("page_id", "url", "digest", "html", "first_id", "first_url")
            for page_id, url, digest, html, first_id, first_url in zip(*(batch.column(n).to_pylist() for n in names)):
                if (page_id, url, digest) != seen:
                    seen, copy, marker = (page_id, url, digest), 0, None
                if html is None:
                    marker = (first_id, first_url)
                    continue
                refers_to = marker or ((page_id, url) if copy and len(html) >= LEAST_REVISIT else None)
                out.append(closed(_page_record(page_id, url, digest, html, copy, refers_to)))
                copy += 1
                size += len(out[-1])
                if size >= file_bytes:
                    yield row()
                    out, size = [], 0
        if out:
            yield row()

    return run


def write_warc(pages: DataFrame, path: str, file_bytes: int = 1 << 25, part_bytes: int = 1 << 25) -> None:
    """Writes a record per row of ``pages`` (page_id, url, html), the payload being the html in UTF-8.

    Of rows with equal payloads of at least 100 bytes, that with the smallest page_id (null last, then by url) is the
    response and the others revisit it; of repeated rows the first is. A null html is an empty payload; a null or
    unprintable url becomes ``urn:page:ID``. An empty table gives no archive. Other columns are ignored.

    Digests are taken first and the few rows that revisit others found from them. These markers and the pages then
    move once, to be dealt evenly by page, however many payloads are equal. An archive is closed when it has
    ``file_bytes``, so it is larger by one record at most; a task gets about ``part_bytes`` of html.

    Spark has no sink for raw files. Its text writer puts a line end behind each row and checks no encoding, so a row
    is an archive less its last byte, and the line end is that byte: zero, as in every member of less than 16 MB.
    """
    html = F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    keys = checkpointed(rows.select("page_id", "url", "digest", F.length("html").alias("size")))
    order = F.struct(F.col("page_id").isNull(), F.col("page_id").alias("id"), F.col("url").isNull(), F.col("url").alias("at"))
    large = keys.filter(F.col("size") >= LEAST_REVISIT)
    firsts = checkpointed(large.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1"))
    again = join_groups(large.select("page_id", "url", "digest").distinct(), firsts, "digest", "n")
    again = again.filter(~(F.col("page_id").eqNullSafe(F.col("first.id")) & F.col("url").eqNullSafe(F.col("first.at"))))
    none = lambda kind: F.lit(None).cast(kind)
    markers = again.select("page_id", "url", "digest", none("binary").alias("html"), F.col("first.id").alias("first_id"), F.col("first.at").alias("first_url"))
    both = markers.union(rows.select("page_id", "url", "digest", "html", none("long"), none("string")))
    parts = parts_for(keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0], part_bytes)
    dealt = both.repartition(parts, "page_id", "url", "digest")
    dealt = dealt.sortWithinPartitions("page_id", "url", "digest", F.col("html").isNotNull())
    write_raw(dealt.mapInArrow(_archives(file_bytes), "bytes binary"), "bytes", "\0", path)


@dataclass
class Record:
    headers: dict[str, str]
    block: bytearray = field(default_factory=bytearray)

    @property
    def payload(self) -> bytes:
        """What follows the HTTP header."""
        return bytes(self.block[self.http_end :])

    @property
    def http_end(self) -> int:
        at = self.block.find(b"\r\n\r\n")
        return len(self.block) if at < 0 else at + 4

    @property
    def http_length(self) -> int:
        for line in bytes(self.block[: self.http_end]).split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length":
                return int(value)
        return len(self.block) - self.http_end


def records(data: bytes | memoryview) -> Iterator[Record]:
    """The records of an archive in sequence. Raises ValueError where framing or a digest is wrong.

    Each member is decompressed in slices: the header up to its empty line, then as many bytes as Content-Length
    says, then the two line ends that close a record.
    """
    view, at = memoryview(data), 0
    while at < len(view):
        z, head, record, need, tail, digest = zlib.decompressobj(31), bytearray(), None, 0, 0, hashlib.sha256()
        while not z.eof:
            if at >= len(view):
                raise ValueError("the archive ends within a record")
            part = z.decompress(view[at : at + SLICE])
            at += min(SLICE, len(view) - at) - len(z.unused_data)
            if record is None:
                head += part
                end = head.find(b"\r\n\r\n")
                if end < 0:
                    continue
                lines = bytes(head[:end]).decode().split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError("a member doesn't begin with a WARC header")
                record = Record({k.strip(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])})
                need, part = int(record.headers["Content-Length"]), bytes(head[end + 4 :])
            now = part[: need - len(record.block)]
            record.block += now
            digest.update(now)
            tail += len(part) - len(now)
        if record is None or len(record.block) != need or tail != 4:
            raise ValueError("a record's content length is wrong")
        if record.headers.get("WARC-Block-Digest", said := f"sha256:{digest.hexdigest()}") != said:
            raise ValueError(f"wrong block digest: {record.headers.get('WARC-Record-ID')}")
        kind = record.headers.get("WARC-Type")
        if kind == "response" and (said := record.headers.get("WARC-Payload-Digest")) is not None:
            if said != f"sha256:{hashlib.sha256(memoryview(record.block)[record.http_end :]).hexdigest()}":
                raise ValueError(f"wrong payload digest: {record.headers.get('WARC-Record-ID')}")
        yield record


FIELDS = "page_id long, target_uri string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in FIELDS.split(", ")]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        number = lambda h, k: int(h[k]) if k in h else None
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for r in records(memoryview(content.as_buffer())):
                    h = r.headers
                    if h.get("WARC-Type") not in ("response", "revisit"):
                        continue
                    payload = r.payload if with_payload and h["WARC-Type"] == "response" else None
                    rows.append((number(h, "X-Page-ID"), h["WARC-Target-URI"], h["WARC-Type"], r.http_length, h["WARC-Payload-Digest"].removeprefix("sha256:"), number(h, "X-Refers-To-Page-ID"), payload))
                    size += 200 + len(payload or b"")
                    if size > 1 << 23:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    return run


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Responses and revisits of the archives under ``path``, a task for each file or several.

    An archive is one value of its task, so those of others must be smaller than a task's memory (and 2 GB); those of
    ``write_warc`` are bounded. A folder without archives gives no rows. page_id is null in archives of others.

    page_id, target_uri, record_type, payload_bytes and payload_digest of the full payload, refers_to (the page that a
    revisit refers to) and payload, null for revisits. A wrong length or digest fails the read.
    """
    return read_raw(spark, path).select("content").mapInArrow(_read(with_payload), FIELDS)
