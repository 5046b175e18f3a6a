"""WARC archives: writing with revisits, and a salvage reader.

The writer makes gzip members, one a record, in files that begin anew after ``ARCHIVE`` bytes. A
payload of at least ``LEAST`` bytes is stored once, in the response of the smallest page; other
pages with the payload get revisit records that name it. Which page that is comes from a table
of digests and ids alone: the pages themselves aren't shuffled by payload.

The reader trusts nothing: a member must inflate with its check sum, its version line, headers
and length must be sound and its block must have the stated digest. After a failed check it
searches for the next place where a member (or, in plain archives, a version line) is valid, goes
on there, and reports the bytes between as a quarantined gap. So a damaged record costs itself
alone. A compressed archive is read in byte ranges, each a partition of its own up to ``TASKS``: a
range begins with that same search. A plain archive is one range, since a payload may hold what
looks like a record, and only reading from the start tells. Records and gaps are written to one
table; ``quarantine`` is the log of the gaps.

Revisits name the response by page (``WARC-Refers-To-Page``) and by the standard headers, so other
readers find it too; of foreign archives, which don't number pages, ``record_id`` and
``refers_to_record`` tell the same.

Defined cases: null html is an empty payload; a null page id or url is kept as null or empty, and
a page without an id revisits the response of its payload if there is one; rows with the same id
and payload as the response are responses all; an empty table gives no archives.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as Frame
from pyspark.sql import functions as F

from siftwork.llm._common import materialize, open_fs, workspace

#: Payloads from this size on are stored once. Fixed value of the query.
LEAST = 100
#: Bytes before a new archive is begun, of a reader's range, and of one read.
ARCHIVE, RANGE, READ = 128 << 20, 32 << 20, 4 << 20
#: Partitions that ranges are read in at most; beyond, a task reads several.
TASKS = 100_000
#: All records' date.
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
VERSION = re.compile(rb"WARC/(?:1\.[01]|0\.\d+)\r\n")
MAGIC = b"\x1f\x8b\x08"

RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, record_id string, refers_to_record string, payload binary"
#: Bytes of the table of revisits that is broadcast at most, and of a row besides its URL.
BROADCAST_BYTES, ROW = 64 << 20, 48
READ_SCHEMA = f"kind string, archive string, offset long, length long, reason string, {RECORD}"


def payload(html: Column) -> Column:
    return F.encode(F.coalesce(html, F.lit("")), "UTF-8")


def revisits(pages: DataFrame, path: str, least: int = LEAST) -> DataFrame:
    """_page, _html (a hash that tells rows of one id apart), refers_to and refers_url of the pages whose payload an earlier page holds: a small table of ids."""
    thin = pages.where(F.octet_length("html") >= least).select("page_id", "url", F.xxhash64("html").alias("_html"), F.unhex(F.sha2("html", 256)).alias("digest"))
    low = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("low")
    first = thin.groupBy("digest").agg(low, F.count(F.lit(1)).alias("n")).where("n > 1 and low is not null").select("digest", "low")
    first = materialize(first, f"{path}/first")  # a table of its own: Spark can then split the pages of a frequent payload
    later = thin.join(first, "digest").where(F.col("page_id").isNull() | (F.col("page_id") > F.col("low.page_id")))
    return later.select(F.col("page_id").alias("_page"), "_html", F.col("low.page_id").alias("refers_to"), F.col("low.url").alias("refers_url")).distinct()


def _safe(text: str | None) -> str:
    """Header values without control characters."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in text or "")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>"


def build(page_id: int | None, url: str | None, body: bytes, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """Bytes of a record, not compressed."""
    digest = hashlib.sha256(body).hexdigest()
    kind = "response" if refers_to is None else "revisit"
    block = HTTP + (body if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_safe(url)}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"WARC-Payload-Length: {len(body)}", f"WARC-Page: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}",
            f"WARC-Refers-To-Target-URI: {_safe(refers_url)}", f"WARC-Refers-To-Date: {DATE}", f"WARC-Refers-To-Page: {refers_to}",
        ]
    return ("\r\n".join([*head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def write(pages: DataFrame, path: str, least: int = LEAST, compress: bool = True) -> DataFrame:
    """Writes a record for each row of ``pages`` (page_id, url, html) below ``path``; returns the manifest: archive, bytes, records.

    A task's archives have names that no other attempt uses, and the manifest is a table that
    Spark commits, so a lost task's archives are never read.
    """

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(path)
        fs.create_dir(root, recursive=True)
        name, out, size, records = "", None, 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"archive": [name], "bytes": [size], "records": [records]})

        for batch in batches:
            for page_id, url, html, refers_to, refers_url in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name, size, records = f"pages-{uuid.uuid4().hex}.warc{'.gz' * compress}", 0, 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                raw = build(page_id, url, (html or "").encode(), refers_to, refers_url)
                if compress:
                    z = zlib.compressobj(6, zlib.DEFLATED, 31)
                    raw = z.compress(raw) + z.flush()
                out.write(raw)
                size, records = size + len(raw), records + 1
                if size >= ARCHIVE:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    later = materialize(revisits(pages, path, least), f"{path}/revisits")
    size = later.agg(F.sum(F.coalesce(F.octet_length("refers_url"), F.lit(0)) + ROW)).first()[0] or 0
    if size <= BROADCAST_BYTES:  # else both sides are shuffled
        later = F.broadcast(later)
    same = F.col("page_id").eqNullSafe(F.col("_page")) & (F.xxhash64("html") == F.col("_html"))
    rows = pages.join(later, same, "left").select("page_id", "url", "html", "refers_to", "refers_url")
    return materialize(rows.mapInArrow(archives, "archive string, bytes long, records long"), f"{path}/manifest")


@dataclass
class Found:
    """A record (``head`` and ``body``) or, with a reason, a gap; ``end`` is behind its last byte."""

    start: int
    end: int
    reason: str = ""
    head: dict[str, str] | None = None
    body: bytes = b""


class Window:
    """Bytes of a file by offset, with what is near held in memory."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def get(self, offset: int, size: int) -> bytes:
        size = max(0, min(size, self.size - offset))
        if not (self.at <= offset and offset + size <= self.at + len(self.data)):
            self.file.seek(offset)
            self.at, self.data = offset, self.file.read(max(size, READ))
        return self.data[offset - self.at : offset - self.at + size]


def _parse(raw: bytes) -> tuple[dict[str, str], bytes, int] | str:
    """(headers, block, length of the record) or what is wrong."""
    if not VERSION.match(raw):
        return "no version line"
    cut = raw.find(b"\r\n\r\n")
    if cut < 0:
        return "headers don't end"
    head = {}
    for line in raw[:cut].split(b"\r\n")[1:]:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            return "damaged header"
        head[name.strip().lower()] = value.strip()
    length = head.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return "no length"
    end = cut + 4 + int(length)
    if raw[end : end + 4] != b"\r\n\r\n":
        return "block doesn't end where its length says"
    block = raw[cut + 4 : end]
    said = head.get("warc-block-digest", "")
    kind, _, digest = said.partition(":")
    if kind == "sha256" and hashlib.sha256(block).hexdigest() != digest.lower():
        return "block digest differs"
    if kind == "sha1" and base64.b32encode(hashlib.sha1(block).digest()).decode() != digest.upper():
        return "block digest differs"
    return head, block, end + 4


def _member(w: Window, at: int) -> Found:
    """The gzip member at ``at``, or a gap of one byte with the reason."""
    z, out, pos = zlib.decompressobj(31), [], at
    try:
        while not z.eof:
            data = w.get(pos, 1 << 16)
            if not data:
                return Found(at, at + 1, "member is cut off")
            out.append(z.decompress(data))
            pos += len(data)
            if pos - at <= 1 << 16 and out[0] and not b"WARC/".startswith(out[0][:5]):
                return Found(at, at + 1, "no version line")
    except zlib.error:
        return Found(at, at + 1, "member doesn't inflate")
    end, got = pos - len(z.unused_data), _parse(b"".join(out))
    return Found(at, end, got) if isinstance(got, str) else Found(at, end, "", got[0], got[1])


def _plain(w: Window, at: int) -> Found:
    """The record of a plain archive at ``at``."""
    size = 1 << 16
    head = w.get(at, size)
    if not VERSION.match(head):
        return Found(at, at + 1, "no version line")
    while b"\r\n\r\n" not in head and len(head) == size:
        size *= 4
        head = w.get(at, size)
    m = re.search(rb"\r\ncontent-length:\s*(\d{1,18})\r\n", head[: head.find(b"\r\n\r\n") + 2], re.I)
    if not m:
        return Found(at, at + 1, "no length")
    got = _parse(w.get(at, head.find(b"\r\n\r\n") + 8 + int(m[1])))
    return Found(at, at + 1, got) if isinstance(got, str) else Found(at, at + got[2], "", got[0], got[1])


def salvage(file, size: int, start: int = 0, end: int | None = None, compressed: bool = True) -> Iterator[Found]:
    """Records that begin in [start, end) and the stretches between them, in order.

    A range may begin inside a record of the range before it, so what comes before its first record
    is only perhaps a gap: ``gaps`` tells, when all ranges are read.
    """
    w, at, end = Window(file, size), start, size if end is None else min(end, size)
    read, mark = (_member, MAGIC) if compressed else (_plain, b"WARC/")
    gap, why = -1, ""
    while at < end:
        found = read(w, at) if w.get(at, len(mark)) == mark else Found(at, at + 1, "no record begins here")
        if found.head is not None:
            if gap >= 0:
                yield Found(gap, at, why)
            gap = -1
            yield found
            at = found.end
            continue
        if gap < 0:
            gap, why = at, found.reason
        at += 1
        while at < size:  # to the next place that looks like a beginning
            data = w.get(at, READ)
            k = data.find(mark)
            if k >= 0:
                at += k
                break
            at += max(1, len(data) - len(mark) + 1)
    if gap >= 0:
        # the gap ends with the next valid record, even behind this range
        stop = at
        while stop < size and read(w, stop).head is None:
            k = w.get(stop + 1, READ).find(mark)
            stop = stop + 1 + k if k >= 0 else min(size, stop + 1 + READ - len(mark))
        yield Found(gap, min(stop, size), why)


def read(spark: SparkSession, path: str, manifest: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """All records of the archives of ``manifest`` (archive, bytes), and for each range the stretches in which it found none: kind is record or stretch.

    Byte ranges come from the archives' sizes, and each is a partition: dealt by ranges of their
    order in a number of partitions that is given, so neither hashing nor adaptive execution puts
    many into one task.
    """

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(path)
        for batch in batches:
            for archive, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
                name, rows, held = f"{root}/{archive}", [], 0
                size = fs.get_file_info(name).size
                with fs.open_input_file(name) as f:
                    for x in salvage(f, size, start, stop, archive.endswith(".gz")):
                        rows.append(_row(archive, x))
                        held += len(x.body)
                        if held > READ:
                            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    step = F.when(F.col("archive").endswith(".gz"), F.lit(range_bytes).cast("long")).otherwise(F.greatest("bytes", F.lit(1)))
    parts = manifest.where("bytes > 0").withColumn("step", step).select("archive", "step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.col("step"))).alias("start"))
    parts = parts.select("archive", "start", (F.col("start") + F.col("step")).alias("stop"))
    return parts.repartitionByRange(max(1, min(parts.count(), TASKS)), "archive", "start").mapInArrow(ranges, READ_SCHEMA)


_ARROW = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
ARROW = pa.schema([(name, _ARROW[kind]) for name, kind in (field.split() for field in READ_SCHEMA.split(", "))])


def _row(archive: str, x: Found) -> dict:
    row = {"kind": "stretch" if x.head is None else "record", "archive": archive, "offset": x.start, "length": x.end - x.start, "reason": x.reason or None}
    if x.head is None:
        return row
    number = lambda name: int(v) if (v := x.head.get(name, "")).lstrip("-").isdigit() else None
    kind = x.head.get("warc-type")
    body = x.body.partition(b"\r\n\r\n")[2] if x.body.startswith(b"HTTP/") else x.body
    stored = kind != "revisit"
    return row | {
        "page_id": number("warc-page"), "url": x.head.get("warc-target-uri"), "record_type": kind,
        "payload_bytes": len(body) if stored else number("warc-payload-length"),
        "payload_digest": hashlib.sha256(body).hexdigest() if stored else x.head.get("warc-payload-digest", "").partition(":")[2] or None,
        "refers_to": number("warc-refers-to-page"), "record_id": x.head.get("warc-record-id"), "refers_to_record": x.head.get("warc-refers-to"), "payload": body if stored else None,
    }


def recover(spark: SparkSession, path: str, manifest: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """The records of ``read`` without their payloads; what was found, gaps included, is written to ``path``/found."""
    found = materialize(read(spark, path, manifest, range_bytes).drop("payload"), f"{path}/found")
    return found.where("kind = 'record'").drop("kind", "archive", "offset", "length", "reason")


def gaps(found: DataFrame) -> DataFrame:
    """archive, offset, length, reason of all bytes of archives that no record of ``found`` covers.

    ``found`` has the records and stretches without one of all ranges; a stretch that a record of the
    range before covers is no gap. What an archive of archives holds inside a record's payload may be found as records
    by a range that begins there; they lie within the outer record and open no gap.
    """
    end = (F.col("offset") + F.col("length")).alias("end")
    records = found.where("kind = 'record'").select("archive", "offset", end)
    perhaps = found.where("kind = 'stretch'").select("archive", F.col("offset").alias("from"), end, "reason")
    before = Frame.partitionBy("archive").orderBy("offset", "end").rowsBetween(Frame.unboundedPreceding, -1)
    inner = records.withColumn("last", F.coalesce(F.max("end").over(before), F.lit(0))).where(F.col("offset") > F.col("last")).select("archive", F.col("last").alias("offset"), F.col("offset").alias("stop"))
    ends = records.groupBy("archive").agg(F.max("end").alias("offset"))
    tails = perhaps.groupBy("archive").agg(F.max("end").alias("stop")).join(ends, "archive", "left").select("archive", F.coalesce("offset", F.lit(0)).alias("offset"), "stop").where("offset < stop")
    open_ = inner.unionByName(tails)
    told = open_.join(perhaps, "archive", "left").where((F.col("from") < F.col("stop")) & (F.col("end") > F.col("offset")))
    return told.groupBy("archive", "offset", "stop").agg(F.min_by("reason", "from").alias("reason")).select("archive", "offset", (F.col("stop") - F.col("offset")).alias("length"), "reason")


def quarantine(spark: SparkSession, path: str) -> DataFrame:
    """The log of ``recover``: archive, offset, length and reason of every gap."""
    return gaps(spark.read.parquet(f"{path}/found"))


def roundtrip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and gives what the salvage reader finds, without the payloads."""
    spark = pages.sparkSession
    path = path or workspace(spark, "warc")
    return recover(spark, path, write(pages, path))
