"""Media columns: a Spark data source over directories of archives.

An archive is a tar file whose members are media; beside it lies an index of the members'
offsets, lengths and check sums. The writer is a data source writer: each task writes archives
of its own under a name that no other attempt uses, and the driver's commit lists the archives of
the tasks that succeeded, so retried or doubled tasks leave nothing that is read. The reader
plans byte ranges over the archives; a member belongs to the range that holds its first byte.
Payloads stream out in Arrow batches. A member whose bytes don't match its check sum is read
again by its offset a few times, and then given with an error and no payload, while the others
go on.

``store_texts`` turns texts into 8-bit grey PNG images of one row without loss; ``features`` reads
them back, and gives a damaged member's error with nulls beside it. The format allows rows of
2**31 - 1 samples, more than a text can have; some other readers must be told to accept more than
a million.

Defined cases: a null text is empty; an empty text is one block of zeros; repeated rows are
members of their own; an empty table gives an archive directory without members; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from siftwork.llm._common import open_fs, workspace

FORMAT = "media_archive"
SCHEMA = "key long, media binary, error string"
#: Bytes of a partition, of an archive before the next is begun, of an Arrow batch, and of one read.
RANGE, ARCHIVE, BATCH, READ = 32 << 20, 256 << 20, 4 << 20, 1 << 20
RETRIES = 3
BLOCK = 64
MANIFEST = "_manifest.json"


@dataclass
class Archives(WriterCommitMessage):
    names: list[str]


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Archives:
        fs, root = open_fs(self.path)
        names, out, index = [], None, []

        def close() -> None:
            if out is not None:
                out.write(b"\0" * 1024)
                out.close()
                with fs.open_output_stream(f"{root}/{names[-1]}.idx") as f:
                    f.write(np.array(index, "<i8").tobytes())

        for batch in iterator:
            for key, media in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = media.as_py() or b""
                if out is None or out.tell() > ARCHIVE:
                    close()
                    names.append(f"media-{uuid.uuid4().hex}.tar")
                    out, index = fs.open_output_stream(f"{root}/{names[-1]}"), []
                head = tarfile.TarInfo("none.png" if key is None else f"{key}.png")
                head.size = len(data)
                index.append((out.tell(), len(data), zlib.crc32(data), -1 if key is None else 1, key or 0))
                out.write(head.tobuf(tarfile.GNU_FORMAT) + data + b"\0" * (-len(data) % 512))
        close()
        return Archives(names)

    def commit(self, messages: list[Archives | None]) -> None:
        fs, root = open_fs(self.path)
        names = sorted(n for m in messages if m is not None for n in m.names)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps(names).encode())

    def abort(self, messages: list[Archives | None]) -> None:
        fs, root = open_fs(self.path)
        for name in (n for m in messages if m is not None for n in m.names):
            for x in (name, f"{name}.idx"):
                fs.delete_file(f"{root}/{x}")


@dataclass
class ByteRange(InputPartition):
    archive: str
    start: int
    end: int


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int = RANGE):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[ByteRange]:
        """Ranges from the archives' sizes alone; the members are found by the tasks."""
        fs, root = open_fs(self.path)
        with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
            names = json.loads(f.read())
        sizes = [(n, i.size) for n, i in zip(names, fs.get_file_info([f"{root}/{n}" for n in names]))] if names else []
        return [ByteRange(n, at, at + self.range_bytes) for n, size in sizes for at in range(0, size, self.range_bytes)] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        fs, root = open_fs(self.path)
        with fs.open_input_stream(f"{root}/{partition.archive}.idx") as f:
            index = np.frombuffer(f.read(), "<i8").reshape(-1, 5)
        index = index[(index[:, 0] >= partition.start) & (index[:, 0] < partition.end)]
        source = fs.open_input_file(f"{root}/{partition.archive}")
        window, at = b"", 0

        def fetch(offset: int, size: int) -> bytes:
            """Members lie one behind the other, so one read serves many."""
            nonlocal window, at
            if not (at <= offset and offset + size <= at + len(window)):
                source.seek(offset)
                window, at = source.read(max(size, READ)), offset
            return window[offset - at : offset - at + size]

        def again(offset: int, size: int) -> bytes:
            with fs.open_input_file(f"{root}/{partition.archive}") as f:
                f.seek(offset)
                return f.read(size)

        rows, held = [], 0
        for offset, size, crc, known, key in index.tolist():
            data, error = None, None
            for attempt in range(1 + RETRIES):
                try:
                    raw = (again if attempt else fetch)(offset, 512 + size)
                    if len(raw) == 512 + size and tarfile.TarInfo.frombuf(raw[:512], "utf-8", "strict").size == size and zlib.crc32(raw[512:]) == crc:
                        data, error = raw[512:], None
                        break
                    error = f"check sum at {offset}"
                except (OSError, tarfile.TarError) as x:
                    error = f"{type(x).__name__} at {offset}"
            rows.append((None if known < 0 else key, data, error))
            held += size
            if held >= BATCH:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)
        source.close()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("key", pa.int64()), ("media", pa.binary()), ("error", pa.string()))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])


class MediaArchive(DataSource):
    """``format("media_archive")``: option path, a directory's URI; range_bytes for the reader."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("range_bytes", RANGE)))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        fs, root = open_fs(self.options["path"])
        fs.create_dir(root, recursive=True)
        return ArchiveWriter(self.options["path"])


def to_png(raw: bytes) -> bytes:
    """8-bit grey image of one row, whose samples are the padded bytes. A text chunk holds the unpadded length."""
    payload = pad(raw)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))
    head = struct.pack(">IIBBBBB", len(payload), 1, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"tEXt", b"bytes\0%d" % len(raw)) + part(b"IDAT", zlib.compress(b"\0" + payload, 6)) + part(b"IEND", b"")


def from_png(media: bytes) -> tuple[np.ndarray, int]:
    """(samples by row, unpadded length) of an image as ``to_png`` makes it."""
    f, data, shape, length = io.BytesIO(media), b"", (0, 0), 0
    if f.read(8) != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    while True:
        size, kind = struct.unpack(">I4s", f.read(8))
        body = f.read(size)
        if struct.unpack(">I", f.read(4))[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError("damaged PNG")
        if kind == b"IHDR":
            shape = struct.unpack(">II", body[:8])
        elif kind == b"tEXt" and body.startswith(b"bytes\0"):
            length = int(body[6:])
        elif kind == b"IDAT":
            data += body
        elif kind == b"IEND":
            break
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(shape[1], shape[0] + 1)
    return lines[:, 1:], length


def pad(raw: bytes) -> bytes:
    return raw + b"\0" * (BLOCK if not raw else -len(raw) % BLOCK)


def store_texts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Writes an image for each row of ``docs`` to archives below ``path``."""

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                media = [to_png((t or "").encode()) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary())], names=["key", "media"])

    docs.sparkSession.dataSource.register(MediaArchive)
    made = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(images, "key long, media binary")
    made.write.format(FORMAT).mode("append").save(path)


def read(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """key, media and error of every member."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format(FORMAT).option("range_bytes", range_bytes).load(path)


def features(media: DataFrame) -> DataFrame:
    """Per member: key, n_bytes (without the padding), digests of payload and media, and features of the samples."""

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error")
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        for batch in batches:
            rows = []
            for key, m, error in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                m = m.as_py()
                if m is None:
                    rows.append((key, *[None] * 7, error))
                    continue
                samples, length = from_png(m)
                payload = samples.tobytes()
                flat = samples.reshape(-1)
                shares = np.bincount(flat >> 4, minlength=16) * 1000 // len(flat)
                feature = f"{samples.shape[1]}x{samples.shape[0]};mean={int(flat.sum(dtype=np.int64)) * 1000 // len(flat)};hist={','.join(map(str, shares.tolist()))}"
                rows.append((key, length, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(m), hashlib.sha256(m).hexdigest(), feature, None))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=list(names))

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
    return media.select("key", "media", "error").mapInArrow(computed, schema)


def roundtrip(docs: DataFrame) -> DataFrame:
    """Stores every text and reads it back from the shared folder."""
    spark = docs.sparkSession
    path = workspace(spark, "media")
    store_texts(docs, path)
    return features(read(spark, path))
