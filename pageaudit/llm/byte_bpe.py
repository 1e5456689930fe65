"""Byte-level BPE encoding and decoding with the tokenizers library, over Arrow batches.

A file of ranks (``base64 rank`` per line) becomes a BPE model over printable characters, one per
byte. Every match of the pattern is encoded for itself and the pair with the lowest resulting rank merges first. Decoding
reverses the byte table: the bytes of all ids are joined before they are read as UTF-8, so characters
split between tokens come out whole.
"""

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageaudit.llm import textbatch as tb
from pageaudit.llm.piece_encoder import PieceEncoder

REPLACEMENT = "�".encode()


def read_ranks(data: bytes) -> list[bytes]:
    """The bytes of each token, in the order of their ids; an id the file leaves out has no bytes."""
    pairs = [line.split() for line in data.splitlines() if line.strip()]
    out = [b""] * (1 + max(int(r) for _, r in pairs))
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where printable in Latin-1, else the next free one from U+0100."""
    out, spare = [], 0x100
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 255 and b != 173:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


def tokenizer(ranks: bytes, pattern: str):
    """The library's tokenizer for a file of ranks. Nothing is trained: the merges are all splits of a token into two tokens."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    tokens, chars = read_ranks(ranks), byte_characters()
    vocabulary = {"".join(chars[b] for b in t): i for i, t in enumerate(tokens) if t}
    merges = []
    for word in vocabulary:  # in the order of the ids
        merges += [(word[:k], word[k:]) for k in range(1, len(word)) if word[:k] in vocabulary and word[k:] in vocabulary]
    out = Tokenizer(models.BPE(vocabulary, merges, ignore_merges=True))
    out.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
    ])
    return out


#: The tokenizer of this worker and its memory of pieces, by the file's digest and pattern.
_made: dict = {}


def encoder(ranks: bytes, pattern: str) -> tuple[PieceEncoder, object]:
    key = (hash(ranks), pattern)
    if key not in _made:
        _made.clear()
        own = tokenizer(ranks, pattern)
        _made[key] = PieceEncoder(lambda pieces: [e.ids for e in own.encode_batch(pieces, add_special_tokens=False)]), own
    return _made[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """Id and ``ids`` (array of int), one row per input row; with ``offsets`` also ``spans``, the characters [start, end) of each id.

    A character split between ids is in the span of each. Null and empty texts have no ids. Repeated rows
    are each encoded; other columns are not read; an empty table gives an empty result. The file is read on the
    driver and sent to the tasks (its size is that of the vocabulary).
    """
    with open(ranks_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        own, library = encoder(ranks.value, pattern)
        for batch in tb.slices(batches, "text"):
            if offsets:
                found = library.encode_batch([t or "" for t in batch.column("text").to_pylist()], add_special_tokens=False)
                rows = [pa.array([e.ids for e in found], pa.list_(pa.int32())), pa.array([[{"start": a, "end": b} for a, b in e.offsets] for e in found], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
            else:
                ids, sizes = own(batch.column("text"))
                rows = [pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(ids, pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *rows], ["id", "ids", "spans"][: 1 + len(rows)])

    kind = slim.schema["id"].dataType.simpleString()
    more = ", spans array<struct<start: int, end: int>>" if offsets else ""
    return slim.mapInArrow(run, f"id {kind}, ids array<int>{more}").withColumnRenamed("id", id_col)


class ByteTable:
    """The bytes of every id, one after the other; ids outside the vocabulary stand for U+FFFD."""

    def __init__(self, ranks: bytes):
        tokens = [t or REPLACEMENT for t in read_ranks(ranks)] + [REPLACEMENT]
        self.flat, self.size = np.frombuffer(b"".join(tokens), np.uint8), np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start = np.cumsum(self.size) - self.size

    def bytes_of(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids and, for the ends of the rows among the ids, those among the bytes."""
        last = len(self.size) - 1
        known = np.where((ids < 0) | (ids >= last), last, ids)
        return tb.gather(self.flat, self.start[known], self.size[known]), np.concatenate([[0], np.cumsum(self.size[known])])[ends]


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids", text: bool = True) -> DataFrame:
    """Id, ``packed`` (the ids as little-endian 32-bit integers), ``data`` (the bytes) and, if asked for, ``text``.

    Bytes that are no UTF-8 become U+FFFD in the text, as do ids outside the vocabulary in the bytes. A null list counts as empty.
    """
    with open(ranks_path, "rb") as f:
        ranks = encoded.sparkSession.sparkContext.broadcast(f.read())
    slim = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def run(batches):
        table = ByteTable(ranks.value)
        for batch in batches:
            column, step = batch.column("ids"), 0
            while step < len(column):
                part = column.slice(step, 512)
                step += 512
                lists = part.fill_null([]) if part.null_count else part
                ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                sizes = np.diff(lists.offsets.to_numpy())
                ends = np.concatenate([[0], np.cumsum(sizes)])
                data, at = table.bytes_of(ids, ends)
                out = [
                    batch.column("id").slice(step - 512, len(part)),
                    pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))]),
                    pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]),
                ]
                if text:
                    out.append(pa.array([x.as_py().decode("utf-8", "replace") for x in out[2]], pa.string()))
                yield pa.RecordBatch.from_arrays(out, ["id", "packed", "data", "text"][: len(out)])

    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, packed binary, data binary" + ", text string" * text).withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``ids``, ``decoded_sha256`` and ``round_trip`` (whether the decoded bytes are those of the text), encoded and decoded in one pass.

    Nulls, empty texts, repeated rows, empty tables and other columns as for ``encode``.
    """
    with open(ranks_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        own, _ = encoder(ranks.value, pattern)
        table = ByteTable(ranks.value)
        for batch in tb.slices(batches, "text"):
            ids, sizes = own(batch.column("text"))
            ends = np.concatenate([[0], np.cumsum(sizes)])
            data, at = table.bytes_of(ids.astype(np.int64), ends)
            text, offsets = tb.buffers(batch.column("text"))
            digests = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:])]
            same = [b - a == d - c and np.array_equal(data[a:b], text[c:d]) for a, b, c, d in zip(at[:-1], at[1:], offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(ids, pa.int32())), pa.array(digests, pa.string()), pa.array(same, pa.bool_())],
                ["id", "ids", "decoded_sha256", "round_trip"],
            )

    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, ids array<int>, decoded_sha256 string, round_trip boolean").withColumnRenamed("id", id_col)
