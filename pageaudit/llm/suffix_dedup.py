"""Removal of byte strings that occur more than once, by suffix order within shards that share an anchor.

An anchor of a string of ``LENGTH`` bytes is the least hash among its runs of ``GRAM`` bytes, so equal strings have equal anchors wherever
they stand. Neighbouring strings with one anchor form a piece (about 280 bytes of text). Anchors are counted over all
documents; an anchor that comes once cannot hold a repeat. Pieces that come again whole are repeats as they are. The
different pieces of an anchor go to one shard, whose suffixes are sorted by external induced sorting (``induced_sort``); a suffix repeats if
it shares ``LENGTH`` bytes with a neighbour. Anchors with more pieces than ``HOT`` would fill one task: their strings
are compared by 128-bit digests instead, a row for each string, dealt out evenly.

Texts go by a 128-bit digest, so null and repeated ids need no care. Only rows of at most a few hundred bytes are grouped, except for the runs of
one text and the text itself.
"""

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageaudit.llm import induced_sort
from pageaudit.llm import textbatch as tb
from pageaudit.llm.bitfilter import BitFilter
from pageaudit.llm.token_pack import open_folder
from pageaudit.session import scratch_path, written

LENGTH, GRAM = 200, 50
#: Strings of a piece at most; pieces of one anchor that are sorted together at most; bytes sorted at a time.
STRINGS, HOT, SHARD_BYTES = 256, 20_000, 1 << 20
INVERSE = np.uint64(pow(int(tb.BASE), -1, 1 << 64))
#: Pieces that a task remembers to send each once.
REMEMBERED = 200_000
_inverse = np.ones(1, np.uint64)


def inverse_powers(n: int) -> np.ndarray:
    """BASE^0, BASE^-1, ..., kept up to two million."""
    global _inverse
    if len(_inverse) >= n:
        return _inverse[:n]
    out = np.full(n, INVERSE, np.uint64)
    out[0] = 1
    out = np.cumprod(out)
    if n <= 1 << 21:
        _inverse = out
    return out


def pieces(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Start, number of strings, anchor, hash and ``own`` of each piece of the rows; ``own``: two strings of the piece may be equal."""
    none = np.zeros(0, np.int64)
    n, window = len(data), length - gram + 1
    m = n - length + 1
    if m <= 0:
        return none, none, none, none, none.astype(bool)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(tb.TABLE[data] * tb.powers(n), out=total[1:])
    back = inverse_powers(n)
    grams = tb.mix((total[gram:] - total[:-gram]) * back[: n - gram + 1])
    # least hash of each window, from running minima of blocks in both directions
    blocks = -(-len(grams) // window)
    padded = np.full(blocks * window, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(grams)] = grams
    padded = padded.reshape(blocks, window)
    ahead = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(ahead[:m], np.minimum.accumulate(padded, axis=1).ravel()[window - 1 : window - 1 + m])
    fits = np.arange(m) + length <= np.repeat(offsets[1:], np.diff(offsets))[:m]
    change = np.empty(m, bool)
    change[0], change[1:] = True, (least[1:] != least[:-1]) | (fits[1:] != fits[:-1])
    change[offsets[:-1][offsets[:-1] < m]] = True
    start = np.flatnonzero(change)
    size = np.diff(np.append(start, m))
    again = np.zeros(m, bool)  # the first run of the string is the least one, and the next string has an equal one later
    again[:-1] = (grams[: m - 1] == least[:-1]) & ~change[1:]
    own = np.logical_or.reduceat(again, start)
    kept = fits[start]
    start, size, own = start[kept], size[kept], own[kept]
    if len(size) and size.max() > STRINGS:  # long runs of strings with one anchor (periodic text)
        parts = -(-size // STRINGS)
        row = np.repeat(np.arange(len(size)), parts)
        k = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        start, size, own = start[row] + k * STRINGS, np.minimum(STRINGS, size[row] - k * STRINGS), own[row]
    text = tb.mix((total[start + size + length - 1] - total[start]) * back[start] + size.astype(np.uint64))
    return start, size, least[start].view(np.int64), text.view(np.int64), own


def per_slice(batches, column: str):
    """The pieces of each slice of a batch, with its bytes, offsets and the row of each piece."""
    for batch in tb.slices(batches, column):
        data, offsets = tb.buffers(batch.column(column))
        found = pieces(data, offsets)
        yield batch, data, offsets, np.searchsorted(offsets, found[0], "right") - 1, found


def key_of(column: str):
    return F.unhex(F.md5(F.coalesce(F.col(column), F.lit("")).cast("binary")))


def repeated_anchors(docs: DataFrame, text_col: str) -> DataFrame:
    """anchor, open (it has different pieces, or one that may hold a repeat itself) and n (its pieces) of the anchors that may hold repeats."""
    def run(batches):
        for _, _, _, _, (start, size, anchor, text, own) in per_slice(batches, text_col):
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(text), pa.array(own.astype(np.int8))], ["anchor", "piece", "own"])

    rows = docs.select(text_col).mapInArrow(run, "anchor bigint, piece bigint, own tinyint")
    counts = rows.groupBy("anchor").agg(F.count("*").alias("n"), F.min("piece").alias("low"), F.max("piece").alias("high"), F.max("own").alias("own"))
    return written(counts.where("n > 1 OR own = 1").select("anchor", ((F.col("low") < F.col("high")) | (F.col("own") == 1)).alias("open"), "n"), "repeat-anchors")


def all_pieces(docs: DataFrame, text_col: str, anchors: DataFrame) -> DataFrame:
    """key (of the text), at, size (bytes), anchor, piece and, for an open anchor, the piece's bytes, once per task at least.

    Anchors are looked up in filters of fixed greatest size; where those are full, pieces without repeats come along and change nothing.
    """
    known, open_ = BitFilter(anchors, "anchor"), BitFilter(anchors.where("open"), "anchor")

    def run(batches):
        seen = set()
        for batch, data, offsets, row, (start, size, anchor, text, _) in per_slice(batches, text_col):
            kept = np.flatnonzero(known.may_hold(anchor.view(np.uint64)))
            start, size, anchor, text, row = start[kept], size[kept], anchor[kept], text[kept], row[kept]
            bytes_ = [None] * len(kept)
            for k in np.flatnonzero(open_.may_hold(anchor.view(np.uint64))).tolist():
                name = (anchor[k], text[k])
                if name not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(name)
                    bytes_[k] = data[start[k] : start[k] + size[k] + LENGTH - 1].tobytes()
            yield pa.RecordBatch.from_arrays([
                batch["key"].take(pa.array(row)), pa.array((start - offsets[row]).astype(np.int64)), pa.array((size + LENGTH - 1).astype(np.int32)), pa.array(anchor), pa.array(text), pa.array(bytes_, pa.binary()),
            ], ["key", "at", "size", "anchor", "piece", "bytes"])

    rows = docs.select(key_of(text_col).alias("key"), text_col)
    return written(rows.mapInArrow(run, "key binary, at bigint, size int, anchor bigint, piece bigint, bytes binary"), "repeat-pieces")


def runs_of(hit: np.ndarray, length: int) -> list[int]:
    """Start and size of each run of bytes covered by the marked strings, one after the other."""
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > length) + 1
    first, last = at[np.concatenate([[0], cut])], at[np.concatenate([cut - 1, [len(at) - 1]])]
    return np.stack([first, last + length - first], axis=1).ravel().tolist()


def shard_runs(rows: DataFrame, folder: str, length: int = LENGTH, shard: int = SHARD_BYTES, **options) -> DataFrame:
    """anchor, piece and runs (repeated bytes within the piece) of the pieces that hold repeats; ``rows``: anchor, piece, bytes.

    A task reads its pieces in order of anchors and sorts the suffixes of whole anchors, ``shard`` bytes or one anchor at a time.
    """
    schema = "anchor bigint, piece bigint, runs array<int>"

    def solve(held):
        size = np.fromiter((len(x[2]) for x in held), np.int64, len(held))
        ends = np.cumsum(size + 1)
        symbols = np.zeros(int(ends[-1]), np.uint16)
        inside = np.ones(len(symbols), bool)
        inside[ends - 1] = False
        symbols[inside] = np.frombuffer(b"".join(x[2] for x in held), np.uint8).astype(np.uint16) + 1
        store = induced_sort.Store(*open_folder(f"{folder}/{uuid.uuid4().hex}"))
        try:
            hit = induced_sort.repeated(symbols, length, store=store, **options)
        finally:
            store.close()
        out = [(a, p, r) for (a, p, _), end, n in zip(held, ends.tolist(), size.tolist()) if (r := runs_of(hit[end - 1 - n : end - 1], length))]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int32())))], ["anchor", "piece", "runs"])

    def run(batches):
        held, own, weight, last = [], [], 0, None
        for batch in batches:
            for anchor, piece, raw in zip(batch["anchor"].to_pylist(), batch["piece"].to_pylist(), batch["bytes"].to_pylist()):
                if own and own[-1][:2] == (anchor, piece):
                    continue
                if own and anchor != last:
                    if len(own) > 1 or len(own[0][2]) > length:  # one piece of one string has no repeat within
                        held += own
                        weight += sum(len(x[2]) for x in own)
                    own = []
                    if weight >= shard:
                        yield solve(held)
                        held, weight = [], 0
                last = anchor
                own.append((anchor, piece, raw))
        if len(held := held + own):
            yield solve(held)

    return rows.repartition("anchor").sortWithinPartitions("anchor", "piece").mapInArrow(run, schema)


def hot_runs(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """As ``shard_runs``, for anchors with too many pieces for one task: a row for each string of each piece, grouped by a 128-bit digest."""
    def strings(batches):
        for batch in batches:
            for anchor, piece, raw in zip(batch["anchor"].to_pylist(), batch["piece"].to_pylist(), batch["bytes"].to_pylist()):
                at = range(len(raw) - length + 1)
                yield pa.RecordBatch.from_arrays([
                    pa.array([anchor] * len(at), pa.int64()), pa.array([piece] * len(at), pa.int64()), pa.array(at, pa.int32()),
                    pa.array([hashlib.blake2b(raw[k : k + length], digest_size=16).digest() for k in at], pa.binary()),
                ], ["anchor", "piece", "at", "digest"])

    each = written(rows.groupBy("anchor", "piece").agg(F.first("bytes").alias("bytes")).mapInArrow(strings, "anchor bigint, piece bigint, at int, digest binary"), "repeat-strings")
    twice = written(each.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "repeat-digests")
    spans = F.flatten(F.transform(F.array_sort(F.collect_list("at")), lambda a: F.array(a, F.lit(length))))
    return each.join(twice, "digest").groupBy("anchor", "piece").agg(spans.alias("runs"))


def repeats(docs: DataFrame, text_col: str = "text", hot: int = HOT, shard: int = SHARD_BYTES, **options) -> DataFrame:
    """key (``key_of`` the text) and runs (start and size, one after the other, in bytes, overlapping ones included) of each text with repeats."""
    anchors = repeated_anchors(docs, text_col)
    found = all_pieces(docs, text_col, anchors)
    raw = found.where("bytes IS NOT NULL").select("anchor", "piece", "bytes")
    crowded = F.col("n") > hot
    many = anchors.where(F.col("open") & crowded).select("anchor")
    if many.isEmpty():
        marks = shard_runs(raw, scratch_path(docs.sparkSession, "repeat-sort"), shard=shard, **options)
    else:
        few = raw.join(many, "anchor", "left_anti")
        marks = shard_runs(few, scratch_path(docs.sparkSession, "repeat-sort"), shard=shard, **options).unionByName(hot_runs(raw.join(many, "anchor", "left_semi")))
    whole = found.groupBy("anchor", "piece").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "piece", F.lit(None).cast("array<int>").alias("runs"))
    marked = written(marks.unionByName(whole), "repeat-marks")
    spans = F.when(F.col("runs").isNull(), F.array("at", F.col("size").cast("long"))).otherwise(
        F.transform("runs", lambda x, k: F.when(k % 2 == 0, x + F.col("at")).otherwise(x.cast("long")))
    )
    rows = found.select("key", "at", "size", "anchor", "piece").join(marked, ["anchor", "piece"]).select("key", spans.alias("spans"))
    return written(rows.groupBy("key").agg(F.flatten(F.collect_set("spans")).alias("runs")), "repeat-runs")


def covered(runs: np.ndarray, n: int) -> np.ndarray:
    """Marks the bytes that lie in a run."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[0::2], 1)
    np.add.at(edge, runs[0::2] + runs[1::2], -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row; with ``keep`` also kept, the remaining bytes.

    A byte goes if a string of 200 bytes that covers it also starts elsewhere in the input, in the same text or another. A null text is
    empty; texts of fewer than 200 bytes lose nothing. Null and repeated ids keep their rows.
    An empty table gives none. Other columns are not read.
    """
    found = repeats(docs, text_col, **options)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), key_of(text_col).alias("key"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in tb.slices(batches, "text"):
            facts = []
            for text, runs in zip(batch["text"], batch["runs"]):
                raw = text.as_buffer()
                sha, removed, spans, kept = hashlib.sha256(), 0, 0, b""
                if runs.is_valid:
                    data = np.frombuffer(raw, np.uint8)
                    gone = covered(runs.values.to_numpy(), len(data))
                    removed, spans = int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                    raw = data[~gone].tobytes()
                sha.update(raw)
                facts.append((text.as_buffer().size, removed, spans, sha.hexdigest(), bytes(raw) if keep else None))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 4 + keep]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array([f[k] for f in facts], t) for k, t in enumerate(types[: 4 + keep])]], ["doc_id", *names])

    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * keep
    return rows.join(found, "key", "left").select("doc_id", "text", "runs").mapInArrow(run, schema)
