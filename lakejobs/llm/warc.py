"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent frames; a bundle ends with the seek table of the Zstandard
seekable format, so any frame can be read alone. The index maps each record to its bundle, frame and
offset within the decompressed frame. Tasks write their own bundles through the file system that the
folder's URI names; an attempt that is lost leaves a file that no index row points to.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejobs.llm.tables import from_files, kept, numbered, small_side

FRAME_BYTES = 256 << 10  # of records, before compression; a longer record has a frame of its own
BUNDLE_BYTES = 64 << 20  # compressed
MIN_PAYLOAD = 0  # smaller payloads are never revisits
LEVEL = 3

# Fixed values of the Zstandard seekable format.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "page-records")

INDEX = "record_id string, bundle string, frame int, offset bigint, length bigint"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id, row) -> str:
    return f"urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}/{row}')}"


def record_bytes(page_id, row, url, payload: bytes, digest: str, refers: str | None) -> bytes:
    """One WARC/1.1 record; a revisit (``refers`` is a record id) has no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers else http + payload
    head = {
        "WARC-Type": "revisit" if refers else "response",
        "WARC-Record-ID": f"<{_record_id(page_id, row)}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": None if url is None else "".join(c if c > " " else f"%{ord(c):02X}" for c in url),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Refers-To": f"<{refers}>" if refers else None,
        "WARC-Profile": _PROFILE if refers else None,
        "X-Page-Id": None if page_id is None else str(page_id),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


class BundleWriter:
    """Writes records to bundles of one task; :meth:`add` and :meth:`close` give the index rows of ended frames."""

    def __init__(self, folder: str, name: str, frame_bytes: int, bundle_bytes: int):
        self.system, self.folder = fs.FileSystem.from_uri(folder)
        self.name, self.frame_bytes, self.bundle_bytes = name, frame_bytes, bundle_bytes
        self.zstd = zstandard.ZstdCompressor(level=LEVEL)
        self.number, self.out = 0, None
        self.buffer, self.pending = bytearray(), []

    def _open(self) -> None:
        self.bundle = f"{self.name}-{self.number:04d}.warc.zst"
        self.system.create_dir(self.folder, recursive=True)
        self.out = self.system.open_output_stream(f"{self.folder}/{self.bundle}", compression=None)
        self.number, self.size, self.frames = self.number + 1, 0, []

    def add(self, record_id: str, record: bytes) -> list[tuple]:
        done = self._end_frame() if self.buffer and len(self.buffer) + len(record) > self.frame_bytes else []
        self.pending.append((record_id, len(self.buffer), len(record)))
        self.buffer += record
        return done

    def _end_frame(self) -> list[tuple]:
        if self.out is None:
            self._open()
        frame = self.zstd.compress(bytes(self.buffer))
        self.out.write(frame)
        rows = [(rid, self.bundle, len(self.frames), at, n) for rid, at, n in self.pending]
        self.frames.append((len(frame), len(self.buffer)))
        self.size += len(frame)
        self.buffer, self.pending = bytearray(), []
        if self.size >= self.bundle_bytes:
            self._end_bundle()
        return rows

    def _end_bundle(self) -> None:
        entries = b"".join(struct.pack("<II", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.out.close()
        self.out = None

    def close(self) -> list[tuple]:
        rows = self._end_frame() if self.buffer else []
        if self.out is not None:
            self._end_bundle()
        return rows


def seek_table(file) -> list[tuple[int, int, int]]:
    """(offset, compressed size, size) of each frame, from the end of an open bundle."""
    size = file.size()
    file.seek(size - 9)
    frames, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != _SEEKABLE:
        raise ValueError("no seek table")
    file.seek(size - 9 - 8 * frames)
    table, at = [], 0
    for packed, raw in struct.iter_unpack("<II", file.read(8 * frames)):
        table.append((at, packed, raw))
        at += packed
    return table


def read_frame(file, entry: tuple[int, int, int]) -> bytes:
    at, packed, raw = entry
    file.seek(at)
    return zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=max(raw, 1))


def parse_record(frame: bytes, at: int) -> tuple[dict, bytes, int]:
    """Headers, payload and end of the record that starts at ``at``."""
    head_end = frame.index(b"\r\n\r\n", at)
    lines = frame[at:head_end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a record")
    head = dict(line.split(": ", 1) for line in lines[1:])
    block = frame[head_end + 4 : head_end + 4 + int(head["Content-Length"])]
    payload = block[block.index(b"\r\n\r\n") + 4 :]
    return head, payload, head_end + 8 + len(block)


def revisits(pages: DataFrame, min_payload: int = MIN_PAYLOAD, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """(_row, to_id, to_row) of the rows whose payload another row holds that has a larger id (or place).

    Payloads meet by SHA-1 and length, added up per task first; payloads themselves are not shuffled.
    """
    body = F.coalesce(payload_col, F.lit("")).cast("binary")
    narrow = numbered(from_files(pages).select(F.col(id_col).alias("_id"), F.sha1(body).alias("_sha"), F.octet_length(body).alias("_n")))
    narrow = narrow.where(F.col("_n") >= min_payload)
    last = F.max(F.struct(F.col("_id").isNotNull().alias("known"), F.col("_id").alias("to_id"), F.col("_row").alias("to_row"))).alias("last")
    groups = narrow.groupBy("_sha", "_n").agg(F.count("*").alias("rows"), last).where("rows > 1")
    return narrow.join(groups, ["_sha", "_n"]).where("_row != last.to_row").select("_row", "last.to_id", "last.to_row")


def write_bundles(
    pages: DataFrame, folder: str, min_payload: int = MIN_PAYLOAD, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES,
    id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
) -> DataFrame:
    """Write a record per row below ``folder`` (a URI every executor reaches); gives the index, kept beside it.

    A null payload is empty, a null url or id leaves its header out; control characters in a url are
    percent-encoded. Of rows with equal payloads the one with the largest id is the response (null
    smallest, then the last in the table). Other columns are not written.
    """
    spark, pages = pages.sparkSession, from_files(pages)
    wide = numbered(pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(payload_col).alias("_body")))
    again = kept(revisits(pages, min_payload, id_col, payload_col))
    joined = wide.join(small_side(again), "_row", "left").select("_row", "_id", "_url", "_body", "to_id", "to_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        writer = BundleWriter(f"{folder}/bundles", f"part-{task.partitionId():06d}-{task.taskAttemptId()}", frame_bytes, bundle_bytes)
        for batch in batches:
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                row, page, url, body, to_id, to_row = (c[i].as_py() for c in batch.columns)
                payload = (body or "").encode()
                refers = None if to_row is None else _record_id(to_id, to_row)
                rows += writer.add(_record_id(page, row), record_bytes(page, row, url, payload, base32_sha1(payload), refers))
            yield _table(rows)
        yield _table(writer.close())

    joined.mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return read_index(spark, folder)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["record_id", "bundle", "frame", "offset", "length"])


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


_RECORDS = "bundle string, frame int, offset bigint, record_id string, page_id string, url string, record_type string, refers_record string, payload_digest string, payload string, measured_digest string, measured_bytes bigint"


def _reader(folder: str, with_payload: bool):
    """Rows (bundle, frame, offsets or null) to records; memory is bounded by a frame."""
    names = [f.split()[0] for f in _RECORDS.split(", ")]
    types = [pa.string(), pa.int32(), pa.int64(), *[pa.string()] * 8, pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(f"{folder}/bundles")
        name, file, table = None, None, []
        for batch in batches:
            for want in batch.to_pylist():
                if want["bundle"] != name:
                    name = want["bundle"]
                    file = system.open_input_file(f"{root}/{name}")
                    table = seek_table(file)
                frame, rows, at = read_frame(file, table[want["frame"]]), [], 0
                for at in sorted(want["offsets"]) if want["offsets"] is not None else _starts(frame):
                    head, payload, _ = parse_record(frame, at)
                    kind, page = head["WARC-Type"], head.get("X-Page-Id")
                    full = kind == "response"
                    rows.append((
                        name, want["frame"], at, head["WARC-Record-ID"].strip("<>"), page, head.get("WARC-Target-URI"), kind,
                        head["WARC-Refers-To"].strip("<>") if not full else None, head["WARC-Payload-Digest"].removeprefix("sha1:"),
                        payload.decode("utf-8", "replace") if full and with_payload else None,
                        base32_sha1(payload) if full else None, len(payload) if full else None,
                    ))
                columns = list(zip(*rows, strict=True)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return run


def _starts(frame: bytes) -> Iterator[int]:
    at = 0
    while at < len(frame):
        yield at
        at = parse_record(frame, at)[2]


def read_bundles(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """All records of the archives, one task row per frame; frames that no index row names are not read."""
    frames = read_index(spark, folder).select("bundle", "frame").distinct().withColumn("offsets", F.lit(None).cast("array<bigint>"))
    # Frames of a bundle side by side, so that it is opened about once per task.
    spread = frames.repartitionByRange("bundle", "frame").sortWithinPartitions("bundle", "frame")
    return spread.mapInArrow(_reader(folder, with_payload), _RECORDS)


def fetch_records(spark: SparkSession, folder: str, record_ids: DataFrame) -> DataFrame:
    """The records of ``record_ids`` (record_id), by index: only their frames are read."""
    wanted = read_index(spark, folder).join(record_ids.select("record_id").distinct(), "record_id", "left_semi")
    frames = wanted.groupBy("bundle", "frame").agg(F.collect_list("offset").alias("offsets"))  # <= records of a frame
    return frames.select("bundle", "frame", "offsets").mapInArrow(_reader(folder, True), _RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """Records with what a revisit refers to: (page_id, record_id, record_type, payload_digest, payload_bytes, refers_to).

    Length and digest are measured on payloads as read; a revisit takes them from its response.
    """
    narrow = kept(records.drop("payload"))
    answers = narrow.where("record_type = 'response'").select(
        F.col("record_id").alias("_to"), F.col("page_id").alias("to_page"), F.col("measured_bytes").alias("to_bytes"), F.col("measured_digest").alias("to_digest")
    )
    joined = narrow.join(answers, F.col("refers_record") == F.col("_to"), "left")
    return joined.select(
        F.col("page_id").cast("bigint").alias("page_id"), "record_id", "record_type", F.coalesce("measured_digest", "to_digest").alias("payload_digest"),
        F.coalesce("measured_bytes", "to_bytes").alias("payload_bytes"), F.col("to_page").cast("bigint").alias("refers_to"),
    )
