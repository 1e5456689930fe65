"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters, digits and bytes beyond ASCII, in lower case. All three-word runs of the test items are
seeds, however common they are. Seeds join passages of the documents to items; each pair that shares enough words is
then aligned word by word, which finds edited and paraphrased copies with replaced, added and lost words.

A fixed-size bit filter of the wanted runs goes to the tasks (its size is bounded whatever the benchmark's); what it lets
through is joined exactly afterwards.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageaudit.llm import textbatch as tb
from pageaudit.llm.bitfilter import BitFilter
from pageaudit.session import written

RUN = 3
#: Words kept on either side of a seed, and the largest gap between seeds of one passage.
MARGIN = 24
MATCH, MISMATCH, GAP = 2, -1, -1
#: A pair counts if the score reaches this share of that of the whole item, or this many words are matched densely.
LEAST_SHARE, LEAST_WORDS, LEAST_DENSITY = 0.4, 30, 0.7
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a column and the first word of each row, with the total last. Latin-1 capitals are lowered too."""
    data, offsets = tb.buffers(texts)
    low = tb.ASCII_LOWER[data]
    if len(low) > 1:
        capital = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
        low[1:][capital] += 0x20
    starts, ends, first = tb.spans_of(WORD[data], offsets)
    return tb.hash_spans(low, starts, ends), first


def as_lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(first.astype(np.int32), pa.array(values.view(np.int64), pa.int64()))


def item_table(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per distinct item row: key, id and the hashes of its words."""
    slim = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).distinct()
    slim = slim.withColumn("key", F.xxhash64("item_id", "text"))

    def run(batches):
        for batch in tb.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("item_id"), as_lists(*words_of(batch.column("text")))], ["key", "item_id", "words"])

    return slim.select("key", "item_id", "text").mapInArrow(run, f"key bigint, item_id {slim.schema['item_id'].dataType.simpleString()}, words array<bigint>")


def runs_of(items: DataFrame) -> DataFrame:
    """key, place and hash of each run of words of each item."""
    def run(batches):
        for batch in batches:
            lists = batch.column("words")
            first = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
            found, at = tb.windows(lists.flatten().to_numpy().view(np.uint64), first, RUN)
            row = tb.row_of(first)[at]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(row)), pa.array((at - first[row]).astype(np.int32)), pa.array(found.view(np.int64))], ["key", "place", "run"])

    return items.select("key", "words").mapInArrow(run, "key bigint, place int, run bigint")


def passages(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """doc_id, start (word), words (hashes) and hits (run and place in the passage) of the stretches around seeds."""
    sieve = docs.sparkSession.sparkContext.broadcast(BitFilter(seeds, "run"))

    def run(batches):
        for batch in tb.slices(batches, "text"):
            words, first = words_of(batch.column("text"))
            found, at = tb.windows(words, first, RUN)
            kept = sieve.value.may_hold(found)
            found, at = found[kept], at[kept]
            row = tb.row_of(first)[at]
            new = np.ones(len(at), bool)
            new[1:] = (row[1:] != row[:-1]) | (np.diff(at) > 2 * MARGIN)
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(at))
            owner = row[begin]
            start = np.maximum(at[begin] - MARGIN, first[owner])
            stop = np.minimum(at[end - 1] + RUN + MARGIN, first[owner + 1]) if len(begin) else start
            inside = tb.gather(words, start, stop - start)
            group = np.repeat(np.arange(len(begin)), end - begin)
            hits = pa.StructArray.from_arrays([pa.array(found.view(np.int64)), pa.array((at - start[group]).astype(np.int32))], ["run", "at"])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(owner)), pa.array((start - first[owner]).astype(np.int32)),
                as_lists(inside, np.concatenate([[0], np.cumsum(stop - start)])), pa.ListArray.from_arrays(np.append(begin, len(at)).astype(np.int32), hits),
            ], ["doc_id", "start", "words", "hits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, start int, words array<bigint>, hits array<struct<run: bigint, at: int>>")


def align(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Best local alignment of each pair: score, matched words, start and end in the right text.

    All pairs move through the table together, one anti-diagonal at a time. A cell is one number: score, matches and
    start from the highest bits down, so the largest is the best.
    """
    n, m, w = len(left), max(map(len, left)), max(map(len, right))
    one = np.int64(1) << 40
    a = np.zeros((n, m), np.uint64)
    b = np.zeros((n, w + 2 * m), np.uint64)  # reversed, with m places free on either side
    real_a, real_b = np.zeros((n, m), bool), np.zeros((n, w + 2 * m), bool)
    for k, (x, y) in enumerate(zip(left, right)):
        a[k, : len(x)], real_a[k, : len(x)] = x, True
        b[k, m + w - len(y) : m + w], real_b[k, m + w - len(y) : m + w] = y[::-1], True
    best, end = np.zeros(n, np.int64), np.zeros(n, np.int64)
    rows, steps = np.arange(n), np.arange(m)
    older = old = np.zeros((n, m + 1), np.int64)  # place 0 stands for the cell before the first word
    for d in range(m + w - 1):
        low = m + w - 1 - d  # right word d - i stands at low + i
        real = real_a & real_b[:, low : low + m]
        same = real & (a == b[:, low : low + m])
        fresh = np.maximum(d - steps + 1, 0)
        diagonal = np.where(older[:, :-1] >= one, older[:, :-1], np.maximum(d - steps, 0)) + np.where(same, MATCH * one + (1 << 20), MISMATCH * one)
        now = np.zeros((n, m + 1), np.int64)
        now[:, 1:] = np.where(real, np.maximum(np.maximum(diagonal, np.maximum(old[:, :-1], old[:, 1:]) + GAP * one), fresh), 0)
        top = now[:, 1:].argmax(1)
        value = now[rows, top + 1]
        better = value >> 20 > best >> 20
        best, end = np.where(better, value, best), np.where(better, d - top + 1, end)
        older, old = old, now
    return best >> 40, (best >> 20) & 0xFFFFF, best & 0xFFFFF, end


def within_reach(left: pa.ListArray, right: pa.ListArray) -> np.ndarray:
    """Whether so many words of the left text occur in the right one that an alignment may count."""
    keys = []
    for lists in (left, right):
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        keys.append(lists.flatten().to_numpy().view(np.uint64) ^ row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    size = np.diff(left.offsets.to_numpy())
    common = np.bincount(np.repeat(np.arange(len(left)), size)[np.isin(*keys)], minlength=len(left))
    return (MATCH * common >= LEAST_SHARE * MATCH * size) | (common >= LEAST_WORDS)


def aligned(pairs: DataFrame) -> DataFrame:
    """The pairs (doc_id, start, words, item_id, item_words) with score, matched, from_word and to_word (in the document).

    Pairs that cannot reach the least share or number of words are left out."""
    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(within_reach(batch.column("item_words"), batch.column("words"))))
            left = [x.values.to_numpy() for x in batch.column("item_words")]
            right = [x.values.to_numpy() for x in batch.column("words")]
            order = sorted(range(len(left)), key=lambda k: (len(left[k]), len(right[k])))
            out = np.zeros((4, len(left)), np.int64)
            while order:  # pairs of like size together, about a million places of the table's front at a time
                size = len(left[order[-1]]) + len(right[order[-1]])
                part, order = order[-max(1, (1 << 18) // size) :], order[: -max(1, (1 << 18) // size)]
                out[:, part] = align([left[k] for k in part], [right[k] for k in part])
            start = batch.column("start").to_numpy()
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("item_id"), pa.array(np.array([len(x) for x in left], np.int64)),
                pa.array(out[0]), pa.array(out[1]), pa.array(start + out[2]), pa.array(start + out[3]),
            ], ["doc_id", "item_id", "item_words", "score", "matched", "from_word", "to_word"])

    kind = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    slim = pairs.select("doc_id", "start", "words", "item_id", "item_words")
    return slim.mapInArrow(run, f"doc_id {kind['doc_id']}, item_id {kind['item_id']}, item_words bigint, score bigint, matched bigint, from_word bigint, to_word bigint")


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and test item that it holds a copy of: doc_id, item_id, item_words, score, matched, from_word, to_word (its best place).

    Nulls, empty texts and items of fewer than three words match nothing; repeated rows give the same pair
    once; an empty table on either side gives an empty result. Other columns are not read.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text")).where(F.col("text").isNotNull())
    book = written(item_table(items, item_id, item_text), "test-items")
    seeds = written(runs_of(book).select("key", "run").distinct(), "test-seeds")
    found = passages(docs, seeds).withColumn("passage", F.xxhash64("doc_id", "start", "words"))
    found = written(found, "test-passages")
    hits = found.select("passage", F.explode("hits.run").alias("run")).distinct().join(seeds, "run")
    pairs = written(hits.select("passage", "key").distinct(), "test-pairs")
    ready = (
        pairs.join(found.select("passage", "doc_id", "start", "words"), "passage")
        .join(book.select("key", "item_id", F.col("words").alias("item_words")), "key")
    )
    good = (F.col("score") >= LEAST_SHARE * MATCH * F.col("item_words")) | (
        (F.col("matched") >= LEAST_WORDS) & (F.col("matched") >= LEAST_DENSITY * (F.col("to_word") - F.col("from_word")))
    )
    best = F.max_by(F.struct("item_words", "score", "matched", "from_word", "to_word"), F.struct("score", "matched", -F.col("from_word")))
    return aligned(ready).where(good).groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no copy of a test item, with all their columns; rows without an id stay."""
    return docs.join(contaminated(docs, items).select("doc_id").distinct(), "doc_id", "left_anti")
