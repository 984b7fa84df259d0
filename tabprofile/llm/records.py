"""Token ids as length-delimited binary records with a separate offset index (operator 4).

A data file is a row of frames, each

    length of the payload   unsigned 64 bit, little-endian
    masked checksum of it   unsigned 32 bit
    payload
    masked checksum of it   unsigned 32 bit

with payload = doc_id (signed 64 bit), number of ids and bytes per id (unsigned 32 bit
each), then the ids: two bytes each while every id of the vocabulary fits, else four.  The
checksum is CRC-32, masked as ((crc >> 15 | crc << 17) + 0xA282EAD8) mod 2**32, so that a
checksum of data that holds checksums stays useful.  The index file beside a data file
holds (offset, length) of each frame as unsigned 64-bit pairs; readers that shuffle seek
by it and never scan a data file.

Files are written by tasks under unique names into the shared folder; the manifest, a
table committed by Spark, names those that count, so files of lost or repeated attempts are
never read.  Paths may be of any store that pyarrow's file systems reach.

Defined results: null text is empty and gives the end id alone; a null doc_id is written
as the smallest 64-bit number and comes first; repeated rows and ids give a record each;
an empty table gives no file and an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabprofile.llm.chunked import CACHED, worker_encoder
from tabprofile.llm.common import portions, shared_path, slices, stored, texts

FRAME, CHECK, HEAD, PAIR = "<QI", "<I", "<qII", "<QQ"  # length and its checksum; checksum; payload head; index entry
NO_ID = -2**63
MANIFEST = "path string, first_id long, last_id long, records long, tokens long, bytes long"


class CorruptRecord(ValueError):
    """A frame whose checksum doesn't hold."""


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return size + struct.pack(CHECK, masked(size)) + payload + struct.pack(CHECK, masked(payload))


def unframe(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """The payload of the frame at ``at`` and where the next one begins."""
    if len(data) < at + 12:
        raise CorruptRecord(f"record at {at} is cut off")
    size, check = struct.unpack_from(FRAME, data, at)
    if masked(data[at:at + 8]) != check:
        raise CorruptRecord(f"length at {at} is damaged")
    payload, end = data[at + 12:at + 12 + size], at + 16 + size
    if len(data) < end or masked(payload) != struct.unpack_from(CHECK, data, end - 4)[0]:
        raise CorruptRecord(f"payload at {at} is damaged")
    return payload, end


def open_store(uri: str):
    """(file system, path) of a folder or file given as URI or local path."""
    from pyarrow import fs
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if "://" not in uri else fs.FileSystem.from_uri(uri)


def record_of(doc_id, ids: bytes, width: int) -> bytes:
    """One payload; ids as little-endian unsigned 32-bit bytes."""
    import numpy as np
    n = len(ids) // 4
    if width == 2:
        ids = np.frombuffer(ids, "<u4").astype("<u2").tobytes()
    return struct.pack(HEAD, NO_ID if doc_id is None else doc_id, n, width) + ids


def ids_of(payload: bytes):
    """(doc_id, ids as a uint32 array) of a payload."""
    import numpy as np
    doc_id, n, width = struct.unpack_from(HEAD, payload)
    return (None if doc_id == NO_ID else doc_id), np.frombuffer(payload, f"<u{width}", n, struct.calcsize(HEAD)).astype("<u4")


def write(docs: DataFrame, json_text: str, pattern: str, end_id: int, folder: str | None = None,
          cached: int = CACHED) -> DataFrame:
    """Encode every text, append ``end_id`` and write records in ascending doc_id order.

    Ranges of (doc_id, row number) go to tasks, each of which writes one data file and its
    index; so one id that a third of the rows share, or null, is many files.  ``cached`` chunks of
    text are kept in a worker's memory.
    Returns the manifest, one row per data file, itself a table under the shared folder.
    """
    import json
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "records")
    vocab = json.loads(json_text)
    largest = max([end_id, *vocab["model"]["vocab"].values(), *(t["id"] for t in vocab.get("added_tokens", []))])
    width = 2 if largest < 2**16 else 4
    bc = spark.sparkContext.broadcast({"json": json_text, "pattern": pattern, "cached": cached})

    def task(batches):
        import pyarrow as pa
        end, store, name, data, index = struct.pack("<I", end_id), None, "", None, None
        first, last, records, tokens, at = None, None, 0, 0, 0
        try:
            for batch in batches:
                encoder = worker_encoder(bc.value)
                for b in portions(batch, 1, encoder.portion):
                    if data is None:
                        store, base = open_store(folder)
                        store.create_dir(base, recursive=True)
                        name = f"{base}/{uuid.uuid4().hex}"
                        data, index = store.open_output_stream(f"{name}.rec"), store.open_output_stream(f"{name}.idx")
                        first = b.column(0)[0].as_py()
                    last = b.column(0)[-1]
                    for doc_id, ids in zip(b.column(0).to_pylist(), encoder.encode(b.column(1))):
                        out = frame(record_of(doc_id, ids + end, width))
                        data.write(out)
                        index.write(struct.pack(PAIR, at, len(out)))
                        at, records, tokens = at + len(out), records + 1, tokens + len(ids) // 4 + 1
        finally:
            for f in (data, index):
                if f is not None:
                    f.close()
        if records:
            yield pa.RecordBatch.from_pylist([dict(path=f"{folder}/{name.rsplit('/', 1)[1]}", first_id=first, last_id=last.as_py(), records=records,
                                                   tokens=tokens, bytes=at)],
                                             pa.schema([("path", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("records", pa.int64()),
                                                        ("tokens", pa.int64()), ("bytes", pa.int64())]))

    rows = texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("row")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return stored(ordered.mapInArrow(task, MANIFEST), "manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """Each file with the ids and records before it.  The window has one row per file.

    Files of one repeated doc_id share their first id: those that hold it alone come before the
    one that goes on to the next id; the path breaks the tie."""
    w = Window.orderBy(F.col("first_id").asc_nulls_first(), F.col("last_id").asc_nulls_first(), "path").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(w), F.lit(0).cast("long")))


def _spread(files: DataFrame, n: int) -> DataFrame:
    return files.repartition(max(n, 1))


def read(manifest: DataFrame) -> DataFrame:
    """Every record in file order: doc_id, start (ids of all records before it), ids as
    little-endian unsigned 32-bit binary."""
    def task(batches):
        import pyarrow as pa
        for batch in batches:
            for row in batch.to_pylist():
                store, path = open_store(row["path"])
                at, out = row["start"], []
                with store.open_input_stream(f"{path}.rec") as f:
                    while head := f.read(12):
                        size = struct.unpack(FRAME, head)[0] if len(head) == 12 and masked(head[:8]) == struct.unpack(FRAME, head)[1] else 0
                        payload, _ = unframe(head + f.read(size + 4))
                        doc_id, ids = ids_of(payload)
                        out.append((doc_id, at, ids.tobytes()))
                        at += len(ids)
                        if len(out) == 512:
                            yield _rows(pa, out)
                            out = []
                if at - row["start"] != row["tokens"]:
                    raise CorruptRecord(f"{path}.rec holds {at - row['start']} ids, the manifest says {row['tokens']}")
                if out:
                    yield _rows(pa, out)

    files = with_starts(manifest).select("path", "start", "tokens")
    return _spread(files, manifest.count()).mapInArrow(task, "doc_id long, start long, ids binary")


def _rows(pa, out):
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()),
                                       pa.array([x[2] for x in out], pa.binary())], ["doc_id", "start", "ids"])


def read_index(manifest: DataFrame) -> DataFrame:
    """One row per record from the index files alone: path, record, offset, length."""
    def task(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = open_store(uri)
                with store.open_input_file(f"{path}.idx") as f:
                    pairs = np.frombuffer(f.read(), "<u8").reshape(-1, 2).astype("int64")
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(pairs), pa.string()), pa.array(np.arange(len(pairs))),
                                                  pa.array(pairs[:, 0]), pa.array(pairs[:, 1])],
                                                 ["path", "record", "offset", "length"])

    return _spread(manifest.select("path"), manifest.count()).mapInArrow(
        task, "path string, record long, offset long, length long")


def read_shuffled(manifest: DataFrame, seed: int) -> DataFrame:
    """All records in a seeded random order: position, doc_id, ids.  The order is made from
    the index; data files are only read by seeking."""
    def task(batches):
        import pyarrow as pa
        at, handle = None, None
        for batch in batches:
            for b in slices(batch, 512):
                out = []
                for row in b.to_pylist():
                    if row["path"] != at:
                        if handle is not None:
                            handle.close()
                        store, path = open_store(row["path"])
                        at, handle = row["path"], store.open_input_file(f"{path}.rec")
                    payload, _ = unframe(handle.read_at(row["length"], row["offset"]))
                    doc_id, ids = ids_of(payload)
                    out.append((doc_id, row["position"], ids.tobytes()))
                yield _rows(pa, out).rename_columns(["doc_id", "position", "ids"])
        if handle is not None:
            handle.close()

    index = read_index(manifest).withColumn("position", F.xxhash64("path", "record", F.lit(seed)))
    ordered = index.repartitionByRange("position").sortWithinPartitions("position")
    return ordered.select("path", "offset", "length", "position").mapInArrow(task, "doc_id long, position long, ids binary")


def digest(read_back: DataFrame) -> DataFrame:
    """n_tokens and ids_crc32 in place of the ids."""
    return read_back.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                            F.crc32("ids").alias("ids_crc32"))
