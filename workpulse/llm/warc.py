"""Web pages in seekable Zstandard bundles of WARC records, written and read by tasks.

A bundle is a run of independent Zstandard frames. Records are put into a frame until it holds ``FRAME`` bytes; a record never spans two
frames. The last frame is a skippable one that holds the seek table of the public seekable format: compressed and plain size of each
frame, their number, and a closing mark. An index table says for each record in which bundle and frame it lies, at which offset within the
plain frame, and how long it is, so that one record costs one seek and one frame.

Of records with equal payloads of at least ``LEAST`` bytes, the one with the largest page id is the response and the others revisit it:
they carry its id and the digest and length of the payload, but no payload.

Nulls, ties and odd input: a null html is an empty payload; a null url becomes a name of the page's own; null ids are smaller than any id
and a response is never named by a null id, so pages with null ids only are all responses; rows that share the largest id are all
responses. An empty table gives no bundle. Further columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from workpulse.llm.storage import file_system, new_folder, stored

LEAST = 1000
FRAME = 1 << 20
BUNDLE = 256 << 20  # plain bytes after which a task starts another bundle
LEVEL = 3
RUN = 16  # frames of a bundle that are read together
MOST_TASKS = 10_000  # that read archives back; beyond, a task reads several runs
DATE = "2024-01-01T00:00:00Z"
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1  # marks of the seekable format
INDEX = "bundle string, frame bigint, frame_at bigint, frame_size bigint, record_at bigint, record_size bigint, page_id bigint"


# ---- Records ---------------------------------------------------------------------------------------------------------


def _name(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id, url: str | None, payload: bytes, digest: str, size: int, refers_to) -> bytes:
    """One WARC record; with ``refers_to``, a revisit without its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or f"urn:page:{'' if page_id is None else page_id}")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _page(name: str | None):
    inside = name.removeprefix("<urn:page:").removesuffix(">") if name else ""
    return int(inside) if inside else None


def parsed(frame: memoryview):
    """``page_id, size, digest, type, refers_to`` of each record of a plain frame; payloads are checked against their digests."""
    at, plain = 0, bytes(frame)
    while at < len(plain):
        end = plain.index(b"\r\n\r\n", at)
        lines = plain[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("no WARC record here")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        start, length = end + 4, int(fields["Content-Length"])
        body = plain.index(b"\r\n\r\n", start) + 4
        http = dict(line.split(": ", 1) for line in plain[start : body - 4].decode().split("\r\n")[1:])
        digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
        if kind == "response":
            payload = frame[body : start + length]
            if len(payload) != int(http["Content-Length"]) or hashlib.sha1(payload).hexdigest() != digest:
                raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
        yield _page(fields["WARC-Record-ID"]), int(http["Content-Length"]), digest, kind, _page(fields.get("WARC-Refers-To"))
        at = start + length + 4


# ---- Bundles ---------------------------------------------------------------------------------------------------------


class Bundle:
    """A bundle that is being written."""

    def __init__(self, path: str):
        system, place = file_system(path)
        system.create_dir(os.path.dirname(place), recursive=True)
        self.path, self.out, self.press = path, system.open_output_stream(place, compression=None), zstandard.ZstdCompressor(level=LEVEL)
        self.frames, self.at, self.plain, self.held, self.size = [], 0, 0, [], 0
        self.rows, self.open_rows = [], []

    def add(self, page_id, data: bytes) -> None:
        if self.size and self.size + len(data) > FRAME:
            self._flush()
        self.open_rows.append((self.size, len(data), page_id))
        self.held.append(data)
        self.size += len(data)
        self.plain += len(data)

    def _flush(self) -> None:
        if not self.size:
            return
        packed = self.press.compress(b"".join(self.held))
        self.out.write(packed)
        self.rows += [(self.path, len(self.frames), self.at, len(packed), *row) for row in self.open_rows]
        self.frames.append((len(packed), self.size))
        self.at += len(packed)
        self.held, self.size, self.open_rows = [], 0, []

    def close(self) -> list[tuple]:
        self._flush()
        table = b"".join(struct.pack("<II", *frame) for frame in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()
        return self.rows


class Reader:
    """Random access to the frames of a bundle by its footer."""

    def __init__(self, path: str):
        system, place = file_system(path)
        self.file = system.open_input_file(place)
        size = self.file.size()
        frames, _, mark = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if mark != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        self.sizes = np.frombuffer(self.file.read_at(8 * frames, size - 9 - 8 * frames), "<u4").reshape(frames, 2).astype(np.int64)
        self.starts = np.cumsum(self.sizes[:, 0]) - self.sizes[:, 0]

    def frame(self, k: int) -> bytes:
        packed = self.file.read_at(int(self.sizes[k, 0]), int(self.starts[k]))
        return zstandard.ZstdDecompressor().decompress(packed, max_output_size=int(self.sizes[k, 1]))

    def record(self, frame: int, at: int, size: int) -> bytes:
        return self.frame(frame)[at : at + size]


# ---- Spark -----------------------------------------------------------------------------------------------------------


def marked(pages: DataFrame) -> DataFrame:
    """Each page with the digest and size of its payload, and the page that it revisits, if any.

    Only payloads that occur more than once are joined back; the adaptive planner splits the one that holds many pages.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.sha1(payload).alias("digest"), F.octet_length(payload).cast("bigint").alias("size"))
    light = pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size")).filter(F.col("size") >= LEAST)
    kept = light.groupBy("digest").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n")).filter("n > 1 and kept is not null")
    joined = rows.join(kept.select("digest", "kept"), "digest", "left")
    return joined.withColumn("refers_to", F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("kept")), F.col("kept")))


def write(pages: DataFrame) -> DataFrame:
    """Write all pages; return the index of their records.

    An attempt's bundles have names of their own and only those of finished attempts are in the index, so a lost executor does no harm.
    """
    folder = new_folder(pages.sparkSession, "warc")
    names = [field.split()[0] for field in INDEX.split(", ")]

    def bundles(batches):
        bundle = None

        def index(rows):
            return pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True)) for row in rows], schema=pa.schema([(n, pa.string() if n == "bundle" else pa.int64()) for n in names]))

        for batch in batches:
            for k in range(batch.num_rows):
                page_id, url, payload, digest, size, refers_to = (c[k].as_py() for c in batch.columns)
                if bundle is None:
                    bundle = Bundle(f"{folder}/{uuid.uuid4().hex}.warc.zst")
                bundle.add(page_id, record(page_id, url, payload, digest, size, refers_to))
                if bundle.plain >= BUNDLE:
                    yield index(bundle.close())
                    bundle = None
        if bundle is not None:
            yield index(bundle.close())

    payload = F.when(F.col("refers_to").isNull(), F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    rows = marked(pages).select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), payload, "digest", "size", F.col("refers_to").cast("bigint"))
    return stored(rows.mapInArrow(bundles, INDEX), "index")


def read(index: DataFrame) -> DataFrame:
    """All records of the bundles in the index, frame by frame; runs of frames are dealt out, so a bundle is no one task's."""

    def rows(batches):
        reader = None
        for batch in batches:
            for path, frame in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if reader is None or reader[0] != path:
                    reader = (path, Reader(path))
                found = list(zip(*parsed(memoryview(reader[1].frame(frame))), strict=True))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(found, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    frames = index.filter("record_at = 0").select("bundle", "frame", F.floor(F.col("frame") / RUN).alias("run"))
    # A given number of partitions, or the adaptive planner would put the few bytes of the index, and so all bundles, into one task.
    tasks = min(MOST_TASKS, max(1, frames.select("bundle", "run").distinct().count()))
    frames = frames.repartition(tasks, "bundle", "run").sortWithinPartitions("bundle", "frame").select("bundle", "frame")
    return frames.mapInArrow(rows, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def fetched(index: DataFrame, ids: DataFrame) -> DataFrame:
    """``page_id, record`` for chosen ids: one seek and one frame for each run of records in it."""

    def rows(batches):
        for batch in batches:
            out = [Reader(row["bundle"]).record(row["frame"], row["record_at"], row["record_size"]) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["page_id", "record"])

    wanted = index.join(ids.select("page_id").distinct(), "page_id", "left_semi")
    return wanted.select("page_id", "bundle", "frame", "record_at", "record_size").mapInArrow(rows, "page_id bigint, record binary")


def digest(pages: DataFrame) -> DataFrame:
    """Write all pages, then read the archives back."""
    return read(write(pages))
