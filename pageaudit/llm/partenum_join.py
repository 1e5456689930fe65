"""N-gram Jaccard join with PartEnum signatures.

Two texts link when their sets of five-word shingles have a Jaccard similarity of at least NUM / DEN. Sets are
put in bands of like size. Sets that link differ in at most k elements, with k fixed by the band. Each
band parts the domain of shingles into n1 parts of n2 subparts; with more parts than differences some part differs in at most k2
elements, so some subset of n2 - k2 of its subparts is equal in both sets. Every subset of every part is a signature (empty ones
are not): linked sets share one for certain. A set signs for its own band and, where larger partners can be there, for the next.

Guarantee: a part is good for a set if more than k2 of its subparts are non-empty. d = k // (k2 + 1) parts at most differ in more
than k2 elements, so a set with more than d good parts shares a non-empty signature with each of its partners. Sets that
have no more (rare; band parameters see to it) sign once more under another seed, where their partners of the same kind do too.

Candidates are verified exactly, on whole sets. Signature groups never become rows of all pairs: first each member is compared with
the group's least, links give components, and only members of different components are compared further, within the task,
after each set has left the most crowded of the signatures that it is certain to share: by sketches those that look most alike, then
by whole sets as far as groups are still apart. Rows grow with the members of a group, not with its pairs.
"""

from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations
from math import comb, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageaudit.llm import textbatch as tb
from pageaudit.llm.bitfilter import BitFilter
from pageaudit.llm.components import components
from pageaudit.session import dealt, written

SHINGLE = 5
NUM, DEN = 75, 100
#: Signatures that one bucket holds, about; sets the number of buckets only.
BUCKET_SIGNATURES = 300_000
#: Members of a signature group that are compared with each other in one place; larger groups are cut into blocks.
BLOCK_MEMBERS = 1024
#: Pairs that a member of a group gives before whole sets are compared in the task.
CANDIDATES = 8
#: Shingles of a block, about, where whole sets are compared.
BLOCK_SHINGLES = 2_000_000
#: Least mean number of shingles below a signature.
MIN_ELEMENTS = 2.2
SEEDS = 8


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row, ascending, and the first of each row, with the total last.

    A-Z are lowered. A text with fewer than five words has its whole sequence of words as its only shingle; without words it has none.
    """
    data, offsets = tb.buffers(texts)
    data = tb.ASCII_LOWER[data]
    starts, ends, first = tb.spans_of(~tb.SEPARATOR[data], offsets)
    words, row, count = tb.hash_spans(data, starts, ends), tb.row_of(first), np.diff(first)
    found, at = tb.windows(words, first, SHINGLE)
    hashes, rows = [found], [row[at]]
    for n in range(1, SHINGLE):
        if (count == n).any():
            found, at = tb.windows(words, first, n)
            own = count[row[at]] == n
            hashes.append(tb.mix(found[own] + np.uint64(n)))
            rows.append(row[at][own])
    hashes, rows = np.concatenate(hashes), np.concatenate(rows)
    order = np.argsort(rows.astype(np.uint64) << np.uint64(40) | hashes >> np.uint64(24))
    hashes, rows = hashes[order], rows[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    hashes, rows = hashes[fresh], rows[fresh]
    return hashes, np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(count)))])


@dataclass(frozen=True)
class Band:
    """Sizes low to high; parts, subparts, subparts that may differ; d within the band and towards the band below."""

    low: int
    high: int
    n1: int
    n2: int
    k2: int
    d_own: int
    d_below: int


def good_share(size: int, n1: int, n2: int, k2: int) -> float:
    """The chance that a part has more than k2 non-empty subparts, for a set of the given size (a lower bound for one part)."""
    if n1 == 1:
        return 1 - sum(comb(n2, k) * (k / n2) ** size for k in range(1, k2 + 1))
    p = 1 - (1 - 1 / (n1 * n2)) ** size
    return sum(comb(n2, k) * p**k * (1 - p) ** (n2 - k) for k in range(k2 + 1, n2 + 1))


def parameters(low: int, high: int, k: int) -> tuple[int, int, int]:
    """(n1, n2, k2) with the fewest signatures among those with enough shingles below each."""
    if k == 0:
        return 1, 1, 0
    choices = []
    for k2 in range(0, 5):
        for n2 in [1] if k2 == 0 else range(k2 + 1, k2 + 5):
            need = k // (k2 + 1) + 1
            n1 = need
            while n1 < 4 * need + 8:
                p = good_share(low, n1, n2, k2)
                if (n1 == 1 and p >= 0.8) or (n1 > 1 and n1 * p - 1.5 * sqrt(n1 * p * (1 - p)) >= need):
                    count, elements = n1 * comb(n2, k2), (low + high) / 2 * (n2 - k2) / (n1 * n2)
                    choices.append(((0, count, -elements) if elements >= MIN_ELEMENTS else (1, -elements, count), (n1, n2, k2)))
                    break
                n1 += 1 + n1 // 50
    # a set with too few good parts signs again, so any parameters are right
    return min(choices)[1] if choices else (k + 1, 1, 0)


@lru_cache(maxsize=8)
def bands(largest: int, num: int = NUM, den: int = DEN) -> list[Band]:
    """Bands up to one beyond the largest size."""
    out, low, below = [], 1, 0
    while not out or out[-2:][0].high < largest:
        high = max(low, low * den // num)
        k = 2 * high * (den - num) // (den + num)
        across = (below + min(high, below * den // num)) * (den - num) // (den + num)
        n1, n2, k2 = parameters(low, high, k)
        out.append(Band(low, high, n1, n2, k2, k // (k2 + 1), min(k, across) // (k2 + 1)))
        low, below = high + 1, high
    return out


def signatures(hashes: np.ndarray, first: np.ndarray, num: int = NUM, den: int = DEN):
    """Signatures of the sets: (signature, row, entry, slack). ``slack``: how many signatures each partner shares at least, for that entry.

    Entries of a set are its own band, the next one, and repeats under further seeds.
    """
    size = np.diff(first)
    table = bands(int(size.max(initial=1)), num, den)
    high = np.array([b.high for b in table])
    row = np.flatnonzero(size)
    band = np.searchsorted(high, size[row])
    reach = size[row] * den // num > high[band]  # a partner may be in the next band
    row = np.concatenate([row, row[reach]])
    own = np.concatenate([np.ones(len(band), bool), np.zeros(int(reach.sum()), bool)])
    band = np.concatenate([band, band[reach] + 1])
    n1, n2, k2, d_own, d_below = (np.array([getattr(b, f) for b in table]) for f in ("n1", "n2", "k2", "d_own", "d_below"))
    out = []
    for seed in range(SEEDS + 1):
        if not len(row):
            break
        need = np.where(own, d_own[band], d_below[band])
        if seed == SEEDS:  # still too few good parts under every seed: all such sets of a band meet
            out.append((tb.mix(band.astype(np.uint64) + np.uint64(7 << 40)), row, np.full(len(row), 2 * SEEDS), np.ones(len(row), np.int64)))
            break
        sizes = size[row]
        element = tb.gather(hashes, first[row], sizes)
        entry = np.repeat(np.arange(len(row)), sizes)
        g = tb.mix(element + tb.mix((band * SEEDS + seed).astype(np.uint64))[entry])
        cells = n1[band] * n2[band]
        base = np.cumsum(cells) - cells
        of = band[entry]
        part = (g >> np.uint64(32)) * n1.astype(np.uint64)[of] >> np.uint64(32)
        cell = base[entry] + part.astype(np.int64) * n2[of] + ((g & np.uint64(0xFFFFFFFF)) * n2.astype(np.uint64)[of] >> np.uint64(32)).astype(np.int64)
        total, full = np.zeros(int(cells.sum()), np.uint64), np.zeros(int(cells.sum()), bool)
        np.add.at(total, cell, tb.mix(g ^ np.uint64(0x5851F42D4C957F2D)))
        full[cell] = True
        good = np.zeros(len(row), np.int64)
        made = []
        for n, k in sorted(set(zip(n2.tolist(), k2.tolist()))):
            own_scheme = np.flatnonzero((n2[band] == n) & (k2[band] == k))
            if not len(own_scheme):
                continue
            parts = n1[band[own_scheme]]
            owner = np.repeat(own_scheme, parts)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
            at = (base[owner] + place * n)[:, None] + np.arange(n)[None, :]
            sums, has = total[at], full[at]
            good += np.bincount(owner, has.sum(1) > k, len(row)).astype(np.int64)
            name = tb.mix((band[owner] * SEEDS + seed).astype(np.uint64) << np.uint64(40) | place.astype(np.uint64) << np.uint64(8))
            for c, chosen in enumerate(combinations(range(n), n - k)):
                some = has[:, chosen].any(1)
                made.append((tb.mix(sums[:, chosen].sum(1, dtype=np.uint64) + name + np.uint64(c))[some], owner[some]))
        enough = good > need
        for found, owner in made:
            out.append((found, row[owner], (2 * seed + ~own[owner]).astype(np.int64) % (2 * SEEDS), np.where(enough, good - need, 0)[owner]))
        row, band, own = row[~enough], band[~enough], own[~enough]
    if not out:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*out))


def documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def sketches(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each set which cells of the hash space hold an element, one bit per cell, and the first byte of each row.

    The cells of a set are a power of two, four times its size at least; coarser cells are the parts of a sketch laid over each other.
    """
    n = np.diff(first)
    bits = np.maximum(3, np.ceil(np.log2(np.maximum(n, 1) * 4)).astype(np.int64))
    base = np.concatenate([[0], np.cumsum(np.where(n > 0, 1 << bits - 3, 0))])
    row = tb.row_of(first)
    held = np.zeros(8 * int(base[-1]), bool)
    held[8 * base[:-1][row] + (tb.mix(hashes) & ((np.uint64(1) << bits.astype(np.uint64)) - np.uint64(1))[row]).astype(np.int64)] = True
    return np.packbits(held, bitorder="little"), base


def most_common(x: np.ndarray, y: np.ndarray, n, m):
    """Upper bound of the shared elements of sets of n and m elements whose sketches are x and the rows of y, equally wide."""
    here, there = (np.bitwise_count(c).sum(-1, dtype=np.int64) for c in (x & ~y, y & ~x))
    return np.minimum(n - here, m - there)


def coarse(cells: np.ndarray, width: int) -> np.ndarray:
    return np.bitwise_or.reduce(cells.reshape(-1, width), axis=0)


def may_link(x: np.ndarray, y: np.ndarray, n: int, m: int, num: int, den: int) -> bool:
    """Whether sets of n and m elements with these sketches can be similar enough; never says no to sets that are."""
    if num * max(n, m) > den * min(n, m):
        return False
    width = min(len(x), len(y))
    common = int(most_common(coarse(x, width), coarse(y, width), n, m))
    return den * common >= num * (n + m - common)


def set_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, a hash of the whole set and its sketch, per row."""
    def run(batches):
        for batch in tb.slices(batches, "text"):
            hashes, first = shingles(batch.column("text"))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tb.mix(hashes), dtype=np.uint64)])
            n = np.diff(first)
            digest = tb.mix(total[first[1:]] - total[first[:-1]] + n.astype(np.uint64))
            cells, base = sketches(hashes, first)
            sketch = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(base.astype(np.int32)), pa.py_buffer(cells)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(digest.view(np.int64)), sketch], ["doc_id", "n_shingles", "digest", "sketch"])

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, digest bigint, sketch binary")


def packed_signatures(docs: DataFrame, buckets: int, num: int = NUM, den: int = DEN) -> DataFrame:
    """bucket and a packed block of signatures with their documents; copies within a batch sign once."""
    def run(batches):
        for batch in tb.slices(batches, "text"):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            hashes, first = shingles(batch.column("text"))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tb.mix(hashes), dtype=np.uint64)])
            _, kept = np.unique(np.stack([total[first[1:]] - total[first[:-1]], np.diff(first).astype(np.uint64)]), axis=1, return_index=True)
            kept = np.sort(kept)
            hashes = tb.gather(hashes, first[kept], np.diff(first)[kept])
            first = np.concatenate([[0], np.cumsum(np.diff(first)[kept])])
            found, row, entry, slack = signatures(hashes, first, num, den)
            to = ((found >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            found, row, tag, to = found[order], row[order], (entry << 12 | np.minimum(slack, 4095))[order].astype("<u2"), to[order]
            cut = np.flatnonzero(np.diff(to, prepend=-1))
            low = found.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]  # the lowest five bytes; the highest make the bucket
            doc = ids[kept][row].astype("<i8").view(np.uint8).reshape(-1, 8)
            side = np.concatenate([doc, tag.view(np.uint8).reshape(-1, 2)], 1)
            blocks = [low[a:b].tobytes() + pa.compress(side[a:b].T.tobytes(), "zstd", asbytes=True) for a, b in zip(cut, [*cut[1:], len(to)])]
            yield pa.RecordBatch.from_arrays([
                pa.array(to[cut].astype(np.int32)), pa.array(np.diff(np.append(cut, len(to))).astype(np.int32)), pa.array(blocks, pa.binary()),
            ], ["bucket", "n", "block"])

    return docs.mapInArrow(run, "bucket int, n int, block binary")


def unpack(n: int, block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Low bytes of the signatures, documents and tags of a block."""
    low = np.zeros((n, 8), np.uint8)
    low[:, :5] = np.frombuffer(block, np.uint8, 5 * n).reshape(n, 5)
    side = np.frombuffer(pa.decompress(block[5 * n :], decompressed_size=10 * n, codec="zstd", asbytes=True), np.uint8).reshape(10, n)
    return low.view("<u8").ravel(), np.ascontiguousarray(side[:8].T).view("<i8").ravel(), np.ascontiguousarray(side[8:].T).view("<u2").ravel()


def shared_signatures(packed: DataFrame) -> DataFrame:
    """Of each signature that several documents have: the pairs with its least document, and for three and more the members.

    kind 0: a (least) and b; kind 1: signature, member a, entry and slack. Pairs come once for each bucket.
    """
    def run(table: pa.Table) -> pa.Table:
        low, doc, tag = (np.concatenate(x) for x in zip(*map(unpack, table["n"].to_pylist(), table["block"].to_pylist())))
        order = np.argsort(low)
        sorted_ = low[order]
        same = sorted_[1:] == sorted_[:-1]
        some = np.zeros(len(low), bool)
        some[1:] |= same
        some[:-1] |= same
        order = order[some]
        low, doc, tag = low[order], doc[order], tag[order]
        order = np.lexsort((doc, low))
        low, doc, tag = low[order], doc[order], tag[order]
        fresh = np.ones(len(low), bool)
        fresh[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
        low, doc, tag = low[fresh], doc[fresh], tag[fresh]
        begin = np.flatnonzero(np.diff(low, prepend=low[:1] + np.uint64(1))) if len(low) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(low)))
        of = np.repeat(np.arange(len(begin)), size)
        rest = np.ones(len(low), bool)
        rest[begin] = False
        pairs = np.unique(np.stack([doc[begin][of][rest], doc[rest]]), axis=1) if rest.any() else np.zeros((2, 0), np.int64)
        many = size[of] >= 3
        bucket = np.uint64(int(table["bucket"][0].as_py())) << np.uint64(40) if table.num_rows else np.uint64(0)
        n_pairs, n_many = pairs.shape[1], int(many.sum())
        tb.release()
        return pa.table({
            "kind": np.repeat(np.array([0, 1], np.int32), [n_pairs, n_many]),
            "sig": np.concatenate([np.zeros(n_pairs, np.int64), (low[many] | bucket).view(np.int64)]),
            "a": np.concatenate([pairs[0], doc[many]]), "b": np.concatenate([pairs[1], np.zeros(n_many, np.int64)]),
            "entry": np.concatenate([np.zeros(n_pairs, np.int32), (tag[many] >> 12).astype(np.int32)]),
            "slack": np.concatenate([np.zeros(n_pairs, np.int32), (tag[many] & 4095).astype(np.int32)]),
        })

    return packed.groupBy("bucket").applyInArrow(run, "kind int, sig bigint, a bigint, b bigint, entry int, slack int")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id and its packed shingles, for the wanted documents and a few others that the filter lets through."""
    sieve = docs.sparkSession.sparkContext.broadcast(BitFilter(wanted.select(F.xxhash64("doc_id").alias("h")), "h"))

    def run(batches):
        for piece in tb.slices(batches, "text"):
            piece = piece.filter(pa.array(sieve.value.may_hold(piece.column("h").to_numpy().view(np.uint64))))
            if piece.num_rows:
                hashes, first = shingles(piece.column("text"))
                whole = pa.Array.from_buffers(pa.binary(), piece.num_rows, [None, pa.py_buffer((8 * first).astype(np.int32)), pa.py_buffer(hashes.astype("<u8"))])
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), whole], ["doc_id", "items"])

    return docs.withColumn("h", F.xxhash64("doc_id")).mapInArrow(run, "doc_id bigint, items binary")


def beside(pairs: DataFrame, values: DataFrame, *names: str) -> DataFrame:
    """The pairs (a, b) with the named columns of both documents, as left_ and right_."""
    right = values.select(F.col("doc_id").alias("b"), *[F.col(c).alias(f"right_{c}") for c in names])
    left = values.select(F.col("doc_id").alias("a"), *[F.col(c).alias(f"left_{c}") for c in names])
    return pairs.join(dealt(right), "b").join(dealt(left), "a").select("a", "b", *[f"{s}_{c}" for c in names for s in ("left", "right")])


def verified(pairs: DataFrame, sizes: DataFrame, docs: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame | None:
    """The pairs (a, b) whose whole sets are similar enough; None if there are none to compare.

    Sketches first leave out pairs that cannot link; whole sets are made and sent for the others only.
    """
    def first_look(batches):
        for batch in batches:
            n, m = batch.column("left_n_shingles").to_numpy(), batch.column("right_n_shingles").to_numpy()
            kept = [
                may_link(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8), n[k], m[k], num, den)
                for k, (x, y) in enumerate(zip(batch.column("left_sketch"), batch.column("right_sketch")))
            ]
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))
            batch = None
            tb.release()

    def compare(batches):
        for batch in batches:
            kept = []
            for x, y in zip(batch.column("left_items"), batch.column("right_items")):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                kept.append(den * common >= num * (len(both) - common) and common > 0)
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))
            batch = x = y = None
            tb.release()

    near = beside(pairs, sizes, "n_shingles", "sketch").mapInArrow(first_look, "a bigint, b bigint")
    near = written(near.distinct(), "near-pairs")
    if near.isEmpty():
        return None
    sets = written(sets_of(docs, near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()), "candidate-sets")
    return beside(near, sets, "items").mapInArrow(compare, "a bigint, b bigint").distinct()


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links, itself included), one row per input row.

    Null and empty texts have no shingles and link with nothing, nor do rows without an id (their component is
    null). Rows that share an id are one document for the links; repeated rows come out as often as they go in. Other columns are
    not read; an empty table gives an empty result.
    """
    slim = documents(docs, id_col, text_col)
    spark = docs.sparkSession
    rows = written(set_digests(slim), "sets")
    known = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    # one document for each set, which stands for its copies from here on
    copies = written(known.groupBy("digest", "n_shingles").agg(F.min("doc_id").alias("rep")), "copies")
    owner = written(known.select("doc_id", "digest", "n_shingles").distinct().join(dealt(copies), ["digest", "n_shingles"]).select("doc_id", "rep").distinct(), "owners")
    total = copies.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_SIGNATURES))
    signed = slim.where("doc_id IS NOT NULL AND text IS NOT NULL")
    found = written(shared_signatures(packed_signatures(signed, buckets, num, den)), "signatures")

    stars = written(found.where("kind = 0").select("a", "b").distinct(), "stars")
    as_a, as_b = owner.select(F.col("doc_id").alias("a"), F.col("rep").alias("x")), owner.select(F.col("doc_id").alias("b"), F.col("rep").alias("y"))
    pairs = written(
        stars.join(dealt(as_a), "a").join(dealt(as_b), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct(), "pairs"
    )
    members = written(
        found.where("kind = 1").join(dealt(owner.withColumnRenamed("doc_id", "a")), "a").groupBy("sig", F.col("rep").alias("doc_id")).agg(F.min("entry").alias("entry"), F.min("slack").alias("slack")), "members"
    )
    # rows that share an id but differ tie their sets together
    links = owner.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"), F.count("*").alias("n"))
    ties = owner.join(dealt(links.where("n > 1").select("doc_id", "a")), "doc_id").select("a", F.col("rep").alias("b")).where("a <> b")
    label = linked_components(members, pairs, ties, known.select("doc_id", "n_shingles", "sketch"), signed, num, den)

    whole = owner.join(dealt(label.withColumnsRenamed({"node": "rep"})), "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("found"))
    return rows.select("doc_id", "n_shingles").join(dealt(written(whole, "components")), "doc_id", "left").select(
        F.col("doc_id").alias(id_col), "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("found", "doc_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def linked_components(members: DataFrame, pairs: DataFrame, ties: DataFrame, sizes: DataFrame, docs: DataFrame, num: int, den: int) -> DataFrame:
    """node and component of the linked sets.

    After the pairs with the least members come those that these did not bring together. A set shares at least
    ``slack`` signatures with each partner, so it can do without its slack - 1 most crowded ones: of the signatures that two linked
    sets share, the least crowded stays in both. The members that remain are compared within their groups, in blocks: first each
    with those that look most alike, then, in groups that are still apart and have further candidates, by whole sets in the task.
    """
    links = verified(pairs, sizes, docs, num, den)
    links = written(ties if links is None else ties.unionByName(links), "links")
    label = written(components(links), "labels")

    crowd = written(members.groupBy("sig").agg(F.count("*").alias("n")), "crowds")
    rank = F.row_number().over(Window.partitionBy("doc_id", "entry").orderBy(F.desc("n"), F.desc("sig")))
    kept = written(members.join(dealt(crowd), "sig").withColumn("rank", rank).where("rank >= slack").select("sig", "doc_id"), "open-members")
    named = label.withColumnsRenamed({"node": "doc_id", "component": "c"})
    kept = kept.join(dealt(named), "doc_id", "left").select("sig", "doc_id", F.coalesce("c", "doc_id").alias("c"))
    groups = kept.groupBy("sig").agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("doc_id").cast("decimal(20,0)")).alias("all"), F.min("c").alias("c0"), F.max("c").alias("c1")
    ).where("c0 <> c1")
    # groups with the same members need but one of their signatures
    one = written(groups.groupBy("n", "all").agg(F.min("sig").alias("sig")).select("sig", F.ceil(F.col("n") / BLOCK_MEMBERS).cast("int").alias("blocks")), "open-groups")
    first = written(open_pairs(kept.join(dealt(one), "sig"), sizes, num, den), "open-pairs")
    todo = first.where("a IS NOT NULL").select("a", "b").distinct().join(dealt(pairs), ["a", "b"], "left_anti")
    more = verified(todo, sizes, docs, num, den)
    if more is not None:
        links = written(links.unionByName(more), "links")
        label = written(components(links), "labels")
    named = label.withColumnsRenamed({"node": "doc_id", "component": "c"})
    rest = first.where("sig IS NOT NULL").select("sig").distinct()
    rest = kept.drop("c").join(dealt(rest), "sig").join(dealt(named), "doc_id", "left").withColumn("c", F.coalesce("c", "doc_id"))
    rest = rest.join(dealt(sizes.groupBy("doc_id").agg(F.max("n_shingles").alias("size"))), "doc_id")
    cut = F.greatest(F.ceil(F.count("*") / BLOCK_MEMBERS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    still = rest.groupBy("sig").agg(cut, F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("sig", "blocks")
    rest = written(rest.drop("size").join(dealt(still), "sig"), "open-members")
    if rest.isEmpty():
        return label
    sets = written(sets_of(docs, rest.select("doc_id").distinct()), "candidate-sets")
    last = written(exact_links(rest, sets, num, den).distinct(), "links")
    return label if last.isEmpty() else written(components(links.unionByName(last)), "labels")


def placed(members: DataFrame, values: DataFrame) -> DataFrame:
    """``members`` (sig, doc_id, c, blocks) with the columns of ``values``, each place (sig, i, j) in one task and in order.

    Every two blocks of a group meet in one place, so no place holds more than two blocks of a group.
    """
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    rows = members.withColumn("block", block).select(
        "sig", "doc_id", "c", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    ).select("sig", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "doc_id", "c", "block")
    return rows.join(dealt(values), "doc_id").repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j", "doc_id")


def by_place(batches):
    """Batches of whole places, each with the edges of its places."""
    held = None
    for batch in _with_end(batches):
        if batch is not None:
            held = batch if held is None else pa.concat_batches([held, batch])
        if held is None or not held.num_rows:
            continue
        new = np.zeros(held.num_rows - 1, bool)
        for c in ("sig", "i", "j"):
            new |= np.diff(held.column(c).to_numpy()) != 0
        edges = [0, *(np.flatnonzero(new) + 1).tolist(), held.num_rows]
        if batch is not None:  # the last place may go on
            edges = edges[:-1]
        if edges[-1]:
            yield held.slice(0, edges[-1]), edges
            tb.release()
        held = held.slice(edges[-1]) if batch is not None else None


def candidates(x: dict, bounds: np.ndarray, cells: np.ndarray, first: int, stop: int, num: int, den: int):
    """For each member of a place outside its largest component: the member, those it may link with by their sketches, and how alike they look.

    Only members of other components count, and of two members outside the largest component the first one looks at the second.
    """
    c, n, far = x["c"][first:stop], x["n_shingles"][first:stop], x["block"][first:stop] == x["j"][first]
    within = x["i"][first] == x["j"][first]
    start, wide = bounds[first:stop], np.diff(bounds[first : stop + 1])
    names, count = np.unique(c, return_counts=True)
    if len(names) == 1:
        return
    home = c == names[count.argmax()]
    least = int(wide.min())
    table = np.stack([coarse(cells[a : a + w], least) for a, w in zip(start, wide)])
    table = table.view("<u8") if least % 8 == 0 else table
    later = np.arange(stop - first)
    for k in np.flatnonzero(~home):
        low, high = np.minimum(n[k], n), np.maximum(n[k], n)
        may = np.flatnonzero((home | (later > k)) & (c != c[k]) & (num * high <= den * low) & (within | (far != far[k])))
        if len(may):
            common = most_common(table[k], table[may], n[k], n[may])
            both = n[k] + n[may] - common
            fit = den * common >= num * both
            if fit.any():
                yield first + k, first + may[fit], common[fit] / np.maximum(both[fit], 1)


def open_pairs(members: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    """Candidate pairs (a, b) of different components within a group, and the sig of each group that has further ones.

    A member gives the pairs that look most alike only, so rows grow with the members; ``exact_links`` sees to what is left.
    """
    names = ["sig", "i", "j", "doc_id", "c", "block", "n_shingles"]

    def run(batches):
        for batch, edges in by_place(batches):
            x = {c: batch.column(c).to_numpy() for c in names}
            cells, bounds = tb.buffers(batch.column("sketch"))
            pairs, left = set(), set()
            for first, stop in zip(edges[:-1], edges[1:]):
                for k, may, alike in candidates(x, bounds, cells, first, stop, num, den):
                    a = int(x["doc_id"][k])
                    for b in x["doc_id"][may[np.argsort(-alike, kind="stable")[:CANDIDATES]]].tolist():
                        pairs.add((min(a, b), max(a, b)))
                    if len(may) > CANDIDATES:
                        left.add(int(x["sig"][first]))
            none = [None] * len(left)
            yield pa.RecordBatch.from_arrays([
                pa.array([a for a, _ in pairs] + none, pa.int64()), pa.array([b for _, b in pairs] + none, pa.int64()),
                pa.array([None] * len(pairs) + list(left), pa.int64()),
            ], ["a", "b", "sig"])

    ready = placed(members, sizes.select("doc_id", "n_shingles", "sketch").distinct())
    return ready.select(*names, "sketch").mapInArrow(run, "a bigint, b bigint, sig bigint")


def exact_links(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) that join all components of a place which any of its links joins.

    Whole sets are compared in the task; once two components are joined, their other members are not compared, so a place
    gives fewer rows than it has members.
    """
    names = ["sig", "i", "j", "doc_id", "c", "block"]

    def run(batches):
        for batch, edges in by_place(batches):
            x = {c: batch.column(c).to_numpy() for c in names}
            data, at = tb.buffers(batch.column("items"))
            hashes, first_of = np.frombuffer(data, "<u8"), (at - at[0]) // 8
            x["n_shingles"] = np.diff(first_of)
            cells, bounds = sketches(hashes, first_of)
            found = set()
            for first, stop in zip(edges[:-1], edges[1:]):
                root = {int(c): int(c) for c in x["c"][first:stop]}

                def top(row):
                    c = int(x["c"][row])
                    while root[c] != c:
                        root[c] = root[root[c]]
                        c = root[c]
                    return c

                for k, may, alike in candidates(x, bounds, cells, first, stop, num, den):
                    mine = hashes[first_of[k] : first_of[k + 1]]
                    for m in may[np.argsort(-alike, kind="stable")]:
                        if top(k) == top(m):
                            continue
                        both = np.sort(np.concatenate([mine, hashes[first_of[m] : first_of[m + 1]]]))
                        common = int((both[1:] == both[:-1]).sum())
                        if common and den * common >= num * (len(both) - common):
                            root[top(k)] = top(m)
                            a, b = int(x["doc_id"][k]), int(x["doc_id"][m])
                            found.add((min(a, b), max(a, b)))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    return placed(members, sets.where(F.octet_length("items") > 0)).select(*names, "items").mapInArrow(run, "a bigint, b bigint")


def _with_end(batches):
    """The batches, then None."""
    yield from batches
    yield None
