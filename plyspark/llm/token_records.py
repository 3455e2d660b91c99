"""Token-id output as length-delimited binary records with an offset index.

A data file holds framed records: length (8 bytes), masked CRC-32C of the length bytes, payload,
masked CRC-32C of the payload, little-endian.  A payload is the document id (8 bytes, signed), a
flag byte (1: the id is null), the width of an id (2 or 4 bytes) and the token ids.  Beside each
data file an index file holds (offset, document id) pairs, so that a reader can fetch records in
any order.  Files hold ascending document ids, and follow each other in ascending order.

Files go to a folder in the shared store under names of their own for each task attempt; the
manifest lists those of the attempts that counted, and readers read only what it lists, so a lost
executor or a repeated task leaves nothing that is read twice.

Defined results: a null or empty text is a record with the end id alone; a null document id sorts
first; rows with equal ids follow each other by text, equal rows keep one record each; other
columns are ignored; an empty table gives an empty manifest.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, shared_dir, written
from .crc32c import crc32c_many, masked
from .textkernel import slices
from .tokens import encoder

HEAD = "<qBB"  # document id, null flag, width of an id
FRAME = 16  # bytes that framing adds
MANIFEST = "part int, file string, n_records long, n_tokens long"
INDEX = np.dtype([("offset", "<i8"), ("doc_id", "<i8")])
#: Records are framed in groups of about this many bytes.
GROUP_BYTES = 4 << 20
#: Texts are encoded in slices of about this many bytes.
ENCODE_BYTES = 1 << 20


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    """Any folder that pyarrow can open: file:, hdfs:, s3:, gs: or a plain path."""
    return pafs.FileSystem.from_uri(folder) if ":" in folder else (pafs.LocalFileSystem(), folder)


def frame(payloads: list[bytes]) -> list[bytes]:
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    a, b = masked(crc32c_many(lengths)).tolist(), masked(crc32c_many(payloads)).tolist()
    pack = struct.Struct("<I").pack
    return [n + pack(x) + p + pack(y) for n, x, p, y in zip(lengths, a, payloads, b, strict=True)]


def unframe(data: memoryview, offsets: np.ndarray) -> list[memoryview]:
    """Payloads of the records at the offsets; ValueError where a checksum differs."""
    read = struct.Struct("<QI").unpack_from
    heads = [read(data, o) for o in offsets.tolist()]
    payloads = [data[o + 12 : o + 12 + n] for o, (n, _) in zip(offsets.tolist(), heads, strict=True)]
    lengths = masked(crc32c_many([bytes(data[o : o + 8]) for o in offsets.tolist()]))
    sums = masked(crc32c_many([bytes(p) for p in payloads]))
    tails = [struct.unpack_from("<I", data, o + 12 + n)[0] for o, (n, _) in zip(offsets.tolist(), heads, strict=True)]
    if not (lengths.tolist() == [c for _, c in heads] and sums.tolist() == tails):
        raise ValueError("a record's checksum does not match")
    return payloads


class _Writer:
    """One data file and its index; opened with the first record."""

    def __init__(self, folder: str, part: int):
        self.fs, self.root = _store(folder)
        self.name = f"part-{part:06d}-{uuid.uuid4().hex}"
        self.part, self.offset, self.tokens, self.index, self.group, self.size = part, 0, 0, [], [], 0
        self.fs.create_dir(self.root, recursive=True)
        self.out = self.fs.open_output_stream(f"{self.root}/{self.name}.records")

    def add(self, doc_id: int | None, payload: bytes, n: int) -> None:
        self.index.append((self.offset + self.size, doc_id or 0))
        self.group.append(payload)
        self.size += len(payload) + FRAME
        self.tokens += n
        if self.size >= GROUP_BYTES:
            self.flush()

    def flush(self) -> None:
        for record in frame(self.group):
            self.out.write(record)
        self.offset += self.size
        self.group, self.size = [], 0

    def close(self) -> tuple[int, str, int, int]:
        self.flush()
        self.out.close()
        with self.fs.open_output_stream(f"{self.root}/{self.name}.index") as out:
            out.write(np.array(self.index, INDEX).tobytes())
        return self.part, self.name, len(self.index), self.tokens


def write_token_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes whole texts and writes them; returns the manifest, one row per data file (schema MANIFEST)."""
    prepare(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, made = None, encoder(tokenizer)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for low, _, words in slices(batch.column(1), ENCODE_BYTES):
                ids, offsets = made.ids(words)
                for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    own = np.append(ids[a:b], np.uint32(end_id))
                    width = 2 if own.max() < 1 << 16 else 4
                    out = out or _Writer(folder, TaskContext.get().partitionId())
                    out.add(doc_ids[low + i], struct.pack(HEAD, doc_ids[low + i] or 0, doc_ids[low + i] is None, width) + own.astype(f"<u{width}").tobytes(), len(own))
        if out:
            part, name, n, tokens = out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name], "n_records": [n], "n_tokens": [tokens]})

    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie", "text")
        .select("doc_id", "text")
    )
    return written(ordered.mapInArrow(write, MANIFEST), "manifest")


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_token_records(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """One row per record, each checksum verified: doc_id, start (ids in all records before), n_tokens,
    ids_crc32 (of the ids as little-endian unsigned 32-bit integers), and on request token_ids."""
    spark = manifest.sparkSession
    files, start = [], 0
    for part, name, _, tokens in manifest.orderBy("part").collect():  # a row per file
        files.append((name, start))
        start += tokens
    schema = READ + (", token_ids array<int>" if with_ids else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _store(folder)
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{name}.index") as f:
                    index = np.frombuffer(f.read(), INDEX)
                with fs.open_input_file(f"{root}/{name}.records") as f:
                    size = f.size()
                    bounds = np.append(index["offset"], size)
                    low = 0
                    while low < len(index):
                        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + GROUP_BYTES, "right")) - 1)
                        data = memoryview(f.read_at(int(bounds[high] - bounds[low]), int(bounds[low])))
                        rows = [_decode(p) for p in unframe(data, index["offset"][low:high] - bounds[low])]
                        counts = np.array([len(ids) for _, ids in rows], np.int64)
                        columns = {
                            "doc_id": pa.array([d for d, _ in rows], pa.int64()),
                            "start": before + np.cumsum(counts) - counts,
                            "n_tokens": counts,
                            "ids_crc32": pa.array([zlib.crc32(ids.tobytes()) for _, ids in rows], pa.int64()),
                        }
                        if with_ids:
                            columns["token_ids"] = pa.array([ids.astype(np.int32) for _, ids in rows], pa.list_(pa.int32()))
                        yield pa.RecordBatch.from_pydict(columns)
                        before += int(counts.sum())
                        low = high

    # As an Arrow table: rows of Python objects would start workers of another kind on every executor.
    table = spark.createDataFrame(pa.table({"file": pa.array([f for f, _ in files], pa.string()), "start": pa.array([s for _, s in files], pa.int64())}))
    return table.repartition(max(1, len(files))).mapInArrow(read, schema)


def _decode(payload: memoryview) -> tuple[int | None, np.ndarray]:
    doc_id, null, width = struct.unpack_from(HEAD, payload)
    return None if null else doc_id, np.frombuffer(payload[struct.calcsize(HEAD) :], f"<u{width}").astype("<u4")


def read_records_at(folder: str, name: str, positions: list[int]) -> list[tuple[int | None, np.ndarray]]:
    """(document id, ids) of the records at these positions of one file, in the order asked: a shuffled read."""
    fs, root = _store(folder)
    with fs.open_input_file(f"{root}/{name}.index") as f:
        index = np.frombuffer(f.read(), INDEX)
    with fs.open_input_file(f"{root}/{name}.records") as f:
        bounds = np.append(index["offset"], f.size())
        out = []
        for i in positions:
            data = memoryview(f.read_at(int(bounds[i + 1] - bounds[i]), int(bounds[i])))
            out.append(_decode(unframe(data, np.zeros(1, np.int64))[0]))
    return out


def token_records(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Writes the records of docs to a new shared folder and reads them back (columns of READ)."""
    folder = shared_dir(docs.sparkSession, "records")
    return read_token_records(write_token_records(docs, folder, tokenizer, end_id), folder)
