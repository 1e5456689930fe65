"""Token ids in fixed-width bit-packed files.

File: a 32-byte header, blocks of BLOCK ids with the width of the vocabulary's largest id, the byte
offset of each block, the id and the end position of each document, and a 48-byte tail that points at the
tables. A block unpacks with a few numpy operations; a range of ids reads only its blocks.

    header   magic "PKID", version u32, bits u32, ids per block u32, zeros
    blocks   little-endian bit strings, each padded to a byte
    tables   block offsets u64, document ids i64, document ends u64 (positions within the file)
    tail     blocks u64, documents u64, ids u64, offset of the tables u64, CRC-32 of the tables u64, magic, zeros

Tasks write through ``pyarrow.fs`` into a shared folder, each attempt under a new name. The manifest is a table
that Spark commits, so files of failed or repeated attempts are never read.
"""

import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageaudit.llm import textbatch as tb
from pageaudit.session import scratch_path

MAGIC, VERSION, HEADER, TAIL, BLOCK = b"PKID", 1, 32, 48, 1 << 16


def bits_for(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """The low ``bits`` bits of each id, one after the other, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    as_bits = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)[None, :] & np.uint64(1)).astype(np.uint8)
    return np.packbits(as_bits.ravel(), bitorder="little").tobytes()


def unpack(packed: bytes, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of a block, as unsigned 32-bit integers."""
    if bits in (8, 16, 32):
        return np.frombuffer(packed, f"<u{bits // 8}", n).astype(np.uint32)
    raw = np.frombuffer(packed + bytes(8), np.uint8)
    at = np.arange(n, dtype=np.int64) * bits
    lead, shift = at >> 3, (at & 7).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for k in range((bits + 14) // 8):
        word |= raw[lead + k].astype(np.uint64) << np.uint64(8 * k)
    return ((word >> shift) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def open_folder(uri: str):
    """File system and path of an address such as ``file:/shared/x`` or ``hdfs://name/x``."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


class Writer:
    """Writes one file; holds a block of ids and the table of documents."""

    def __init__(self, sink, bits: int):
        self.sink, self.bits, self.at, self.total = sink, bits, HEADER, 0
        self.blocks, self.docs, self.ends, self.rest, self.waiting = [], [], [], [], 0
        sink.write(struct.pack("<4sIII16x", MAGIC, VERSION, bits, BLOCK))

    def add(self, docs: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(docs.astype("<i8"))
        self.ends.append((self.total + np.cumsum(sizes)).astype("<u8"))
        self.total += len(ids)
        self.rest.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK:
            ids = np.concatenate(self.rest)
            full = len(ids) // BLOCK * BLOCK
            for k in range(0, full, BLOCK):
                self.block(ids[k : k + BLOCK])
            self.rest, self.waiting = [ids[full:]], len(ids) - full

    def block(self, ids: np.ndarray) -> None:
        packed = pack(ids, self.bits)
        self.blocks.append(self.at)
        self.sink.write(packed)
        self.at += len(packed)

    def close(self) -> None:
        if self.waiting:
            self.block(np.concatenate(self.rest))
        tables = np.array(self.blocks, "<u8").tobytes() + b"".join(x.tobytes() for x in self.docs) + b"".join(x.tobytes() for x in self.ends)
        self.sink.write(tables)
        self.sink.write(struct.pack("<5Q4s4x", len(self.blocks), sum(map(len, self.docs)), self.total, self.at, zlib.crc32(tables), MAGIC))
        self.sink.close()


class Reader:
    """Random access to one file."""

    def __init__(self, source, size: int):
        self.source = source
        head, tail = self.read(0, HEADER), self.read(size - TAIL, TAIL)
        magic, version, self.bits, self.per_block = struct.unpack("<4sIII16x", head)
        n_blocks, n_docs, self.total, where, check, end = struct.unpack("<5Q4s4x", tail)
        tables = self.read(where, size - TAIL - where)
        if magic != MAGIC or end != MAGIC or version != VERSION or zlib.crc32(tables) != check:
            raise ValueError("not a whole file of packed ids")
        self.blocks = np.append(np.frombuffer(tables, "<u8", n_blocks), where).astype(np.int64)
        self.docs = np.frombuffer(tables, "<i8", n_docs, 8 * n_blocks)
        self.ends = np.frombuffer(tables, "<u8", n_docs, 8 * (n_blocks + n_docs)).astype(np.int64)

    def read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids at the positions ``start`` to ``stop``; reads the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        one, two = start // self.per_block, (stop - 1) // self.per_block
        raw = self.read(int(self.blocks[one]), int(self.blocks[two + 1] - self.blocks[one]))
        parts = []
        for k in range(one, two + 1):
            held = min(self.per_block, self.total - k * self.per_block)
            parts.append(unpack(raw[self.blocks[k] - self.blocks[one] : self.blocks[k + 1] - self.blocks[one]], self.bits, held))
        return np.concatenate(parts)[start - one * self.per_block : stop - one * self.per_block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def write_tokens(docs: DataFrame, encode, vocabulary: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Encodes every text, appends ``end_id`` and writes the ids in ascending order of the document id.

    ``encode()`` is called once in each task and gives a function from an Arrow column of texts to
    (ids, sizes). Returns the manifest: file, position of its first id, first and last document, documents and ids. Null texts
    count as empty; null ids come first and are written as the smallest long; rows with the same id are all
    written, in the order of their texts' hashes. Only the two columns are read. An empty table writes no file.
    """
    spark, bits = docs.sparkSession, bits_for(vocabulary)
    folder = folder or scratch_path(spark, "tokens")
    slim = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie")
    )
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), slim.rdd.getNumPartitions())

    def run(batches):
        system, base = open_folder(folder)
        writer, seen = None, [None, None]
        encoder = None
        for batch in tb.slices(batches, "text"):
            if writer is None:
                system.create_dir(base, recursive=True)
                name, encoder = f"{uuid.uuid4().hex}.pkid", encode()
                writer, seen[0] = Writer(system.open_output_stream(f"{base}/{name}"), bits), batch.column("id")[0].as_py()
            ids, sizes = encoder(batch.column("text"))
            whole = np.full(int(sizes.sum()) + len(sizes), end_id, np.uint32)
            ends = np.cumsum(sizes + 1)
            kept = np.ones(len(whole), bool)
            kept[ends - 1] = False
            whole[kept] = ids
            writer.add(batch.column("id").to_numpy(), sizes + 1, whole)
            seen[1] = batch.column("id")[batch.num_rows - 1].as_py()
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({
                "file": [f"{folder}/{name}"], "first_doc": [seen[0]], "last_doc": [seen[1]], "n_docs": [sum(map(len, writer.docs))], "n_ids": [writer.total],
            })

    schema = "file string, first_doc bigint, last_doc bigint, n_docs bigint, n_ids bigint"

    def tagged(batches):
        from pyspark import TaskContext

        for out in run(batches):
            yield out.append_column("part", pa.array([TaskContext.get().partitionId()] * out.num_rows, pa.int32()))

    ordered = slim.repartitionByRange(parts, "id", "tie").sortWithinPartitions("id", "tie")
    ordered.mapInArrow(tagged, f"{schema}, part int").write.parquet(f"{folder}/manifest")
    table = spark.read.schema(f"{schema}, part int").parquet(f"{folder}/manifest")
    # one row per file; the files follow each other in the order of the range partitions
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return table.withColumn("start", F.coalesce(before, F.lit(0).cast("long")))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Per document in the files: doc_id, start (ids of all documents before it), n_tokens, ids (32-bit, little-endian)."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                system, path = open_folder(row["file"])
                with system.open_input_file(path) as source:
                    reader = Reader(source, source.size())
                    ends, done = reader.ends, 0
                    while done < len(ends):
                        from_id = int(ends[done - 1]) if done else 0
                        upto = max(done + 1, int(np.searchsorted(ends, from_id + 8 * BLOCK, "right")))
                        ids = reader.ids(from_id, int(ends[upto - 1])).astype("<u4")
                        cuts = np.concatenate([[0], ends[done:upto] - from_id])
                        yield pa.RecordBatch.from_arrays([
                            pa.array(reader.docs[done:upto]), pa.array(row["start"] + from_id + cuts[:-1]), pa.array(np.diff(cuts)),
                            pa.Array.from_buffers(pa.large_binary(), upto - done, [None, pa.py_buffer((cuts * 4).astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary()),
                        ], ["doc_id", "start", "n_tokens", "ids"])
                        done = upto

    files = manifest.select("file", "start").repartition(max(1, manifest.count()), "file")
    return files.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
