"""Suffixes of many strings in order, with common-prefix lengths, by induced sorting through disk-backed queues.

The strings lie one after the other, each closed by a sentinel that is smaller than all symbols; sentinels differ from each other
by their place. Suffixes are of type S (smaller than the next suffix of the string) or L. The leftmost S suffixes of each run
are sorted first: a round of induction sorts the substrings between them, these get names, and the string of names
is sorted the same way (recursion; names that fit in memory are sorted there by doubling). A second round
induces all other suffixes: reading suffixes in order, each puts the suffix one symbol to its left into the queue of that symbol.
A queue takes its tuples (symbol, position, rank of the successor) in order of successors, so it is a priority queue whose buckets
need no sorting; a bucket is read once all smaller ones are done. Beyond a limit, tuples go to run files in order of symbols.

The common prefix of two neighbours of a bucket is one more than the least common prefix between their successors. It goes along with
the tuples. The text, its types and the common prefixes stay in memory (about fifteen bytes a symbol); tuples beyond a limit are on
disk. So a shard may be larger than memory is for its tuples, not for its text.
"""

import io
import uuid

import numpy as np

#: Tuples of a queue in memory; symbols that are sorted in memory by doubling.
QUEUE_TUPLES, BASE_SYMBOLS = 4_000_000, 16_000_000


class Store:
    """A folder for run files through a file system that all tasks see; ``None`` keeps runs as bytes in memory (tests)."""

    def __init__(self, system=None, base: str = ""):
        self.system, self.base, self.files, self.written = system, base, [], 0

    def put(self, arrays) -> str | bytes:
        out = io.BytesIO()
        for a in arrays:
            out.write(np.ascontiguousarray(a).tobytes())
        self.written += out.tell()
        if self.system is None:
            return out.getvalue()
        self.system.create_dir(self.base, recursive=True)
        name = f"{self.base}/run-{uuid.uuid4().hex}"
        with self.system.open_output_stream(name) as f:
            f.write(out.getvalue())
        self.files.append(name)
        return name

    def get(self, name, at: int, size: int) -> bytes:
        if self.system is None:
            return name[at : at + size]
        with self.system.open_input_file(name) as f:
            f.seek(at)
            return f.read(size)

    def close(self) -> None:
        for name in self.files:
            self.system.delete_file(name)
        self.files = []


class TupleQueue:
    """Buckets of (position, value) in order of arrival; the fullest state in memory is bounded, the rest lies in run files."""

    def __init__(self, store: Store, limit: int, kind=np.int64):
        self.store, self.limit, self.held, self.runs, self.count, self.kind = store, limit, {}, [], 0, kind

    def push(self, symbols: np.ndarray, positions: np.ndarray, values: np.ndarray) -> None:
        if not len(symbols):
            return
        order = np.argsort(symbols, kind="stable")
        s, p, v = symbols[order], positions[order].astype(self.kind, copy=False), values[order].astype(self.kind, copy=False)
        edges = np.flatnonzero(np.diff(s)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(s)]):
            self.held.setdefault(int(s[a]), []).append((p[a:b], v[a:b]))
        self.count += len(s)
        if self.count > self.limit:
            self.spill()

    def spill(self) -> None:
        index, at, arrays = {}, 0, []
        for symbol in sorted(self.held):
            chunk = self.held[symbol]
            n = sum(len(p) for p, _ in chunk)
            arrays += [p for p, _ in chunk] + [v for _, v in chunk]
            index[symbol] = (at, n)
            at += 2 * self.width * n
        self.runs.append((self.store.put(arrays), index))
        self.held, self.count = {}, 0

    def symbols(self) -> set:
        return set(self.held).union(*(index for _, index in self.runs))

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        """The whole bucket, oldest first."""
        positions, values = [], []
        for name, index in self.runs:
            if symbol in index:
                at, n = index.pop(symbol)
                raw = self.store.get(name, at, 2 * self.width * n)
                positions.append(np.frombuffer(raw, self.kind, n))
                values.append(np.frombuffer(raw, self.kind, n, self.width * n))
        for p, v in self.held.pop(symbol, []):
            self.count -= len(p)
            positions.append(p)
            values.append(v)
        none = np.zeros(0, self.kind)
        return np.concatenate([none, *positions]), np.concatenate([none, *values])

    @property
    def width(self) -> int:
        return np.dtype(self.kind).itemsize


class Strings:
    """Symbols (from 1; 0 is the sentinel that closes each string) with types and leftmost S positions."""

    def __init__(self, symbols: np.ndarray):
        self.t, n = symbols, len(symbols)
        differs = np.flatnonzero(symbols[1:] != symbols[:-1])
        self.s = np.zeros(n, bool)
        if len(differs):
            # the symbol after the run that a position is in decides
            rises = symbols[differs] < symbols[differs + 1]
            self.s[: differs[-1] + 1] = np.repeat(rises, np.diff(np.concatenate([[-1], differs])))
        self.s[symbols == 0] = True
        self.leftmost = np.flatnonzero(self.s & ~np.concatenate([[True], self.s[:-1]]))
        self.ends = np.flatnonzero(symbols == 0)
        self.slot = np.zeros(n, np.int32)  # of the leftmost S positions
        self.slot[self.leftmost] = np.arange(len(self.leftmost))
        self.words, self.shifted = None, np.concatenate([symbols[:1] * 0, symbols])

    def rest(self, positions: np.ndarray) -> np.ndarray:
        """Symbols from each position to the end of its string."""
        return self.ends[np.searchsorted(self.ends, positions)] - positions

    def before(self, positions: np.ndarray) -> np.ndarray:
        """The symbol left of each position; 0 at the start of a string."""
        return self.shifted[positions]

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Common prefix of each pair of suffixes, ``most`` symbols long at most, by comparing eight bytes at a time."""
        width = self.t.dtype.itemsize
        step = 8 // width
        if self.words is None:
            raw = self.t.tobytes() + bytes(8)
            self.words = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))
        out, open_ = np.zeros(len(a), np.int64), np.flatnonzero(most > 0)
        while len(open_):
            x = self.words[(a[open_] + out[open_]) * width] ^ self.words[(b[open_] + out[open_]) * width]
            low = x & (~x + np.uint64(1))
            equal = np.where(x == 0, step, np.floor(np.log2(np.maximum(low, 1).astype(np.float64))).astype(np.int64) // (8 * width))
            out[open_] += equal
            open_ = open_[(x == 0) & (out[open_] < most[open_])]
        return np.minimum(out, most)

    def common_one(self, a: np.ndarray, b: np.ndarray) -> int:
        return int(self.common(a, b, np.minimum(self.rest(a), self.rest(b)))[0])


class Scan:
    """Common prefixes of the suffixes read so far, each with the one read before it."""

    def __init__(self, n: int):
        self.lcp, self.n = np.zeros(n + 1, np.int32), 0

    def add(self, values) -> int:
        """Appends; returns the rank of the first."""
        at = self.n
        self.lcp[at : at + len(values)] = values
        self.n += len(values)
        return at

    def induced(self, ranks: np.ndarray, last: int) -> np.ndarray:
        """For neighbours of a bucket whose successors have these ascending ranks: one more than the least value between them.

        ``last`` is the rank of the successor of the bucket's element before them, or -1 if there is none.
        """
        if last < 0:
            rest = self.induced(ranks[1:], int(ranks[0])) if len(ranks) > 1 else np.zeros(0, np.int32)
            return np.concatenate([np.zeros(1, np.int32), rest])
        edges = np.concatenate([[last], ranks])
        return 1 + np.minimum.reduceat(self.lcp[last + 1 : int(ranks[-1]) + 1], edges[:-1] - last)


def induce(text: Strings, seeds: np.ndarray, seed_lcp: np.ndarray | None, store: Store, limit: int):
    """Yields (positions, common prefixes with the one yielded before) of all suffixes but sentinels, from the largest down.

    ``seeds``: the leftmost S positions in order; without ``seed_lcp`` they are sorted by their first symbol only, and common prefixes are zeros.
    """
    t, with_lcp = text.t, seed_lcp is not None
    first = t[seeds]
    alphabet = np.unique(t)
    kind = np.int32 if len(t) < 1 << 31 else np.int64
    queue, kept = TupleQueue(store, limit, kind), TupleQueue(store, limit, kind)
    scan = Scan(len(t) if with_lcp else 0)

    def step(positions, keep):
        """Ranks of the positions just read, and which of them have a predecessor of the wanted kind."""
        symbols = text.before(positions)
        wanted = keep(symbols)
        return symbols[wanted], positions[wanted] - 1, wanted

    def settle(positions, ranks, last):
        lcp = scan.induced(ranks, last) if with_lcp else np.zeros(len(positions), np.int32)
        return lcp, scan.add(lcp) if with_lcp else 0

    for c in alphabet.tolist():  # upwards: L suffixes
        positions, ranks = queue.pop(c)
        last, tail = -1, None
        while len(positions):
            lcp, at = settle(positions, ranks, last)
            kept.push(np.full(len(positions), c), positions, lcp)
            last, tail = int(ranks[-1]), positions[-1:]
            symbols, left, mask = step(positions, lambda x: x >= c)
            own = at + np.flatnonzero(mask)
            queue.push(symbols[symbols > c], left[symbols > c], own[symbols > c])
            positions, ranks = left[symbols == c], own[symbols == c]
        lo, hi = np.searchsorted(first, [c, c + 1]) if c == 0 or len(seeds) else (0, 0)
        if hi > lo:
            own = seeds[lo:hi]
            at = 0
            if with_lcp:
                lcp = seed_lcp[lo:hi].copy()
                lcp[0] = text.common_one(tail, own[:1]) if tail is not None else 0
                at = scan.add(lcp)
            symbols, left, mask = step(own, lambda x: x > c)
            queue.push(symbols, left, at + np.flatnonzero(mask))

    queue, scan = TupleQueue(store, limit, kind), Scan(len(t) if with_lcp else 0)
    for c in alphabet[::-1].tolist():  # downwards: S suffixes, then the L suffixes of the bucket
        if c == 0:
            break
        positions, ranks = queue.pop(c)
        last, tail = -1, None
        while len(positions):
            lcp, at = settle(positions, ranks, last)
            yield positions, lcp
            last, tail = int(ranks[-1]), positions[-1:]
            symbols, left, mask = step(positions, lambda x: (x > 0) & (x <= c))
            own = at + np.flatnonzero(mask)
            queue.push(symbols[symbols < c], left[symbols < c], own[symbols < c])
            positions, ranks = left[symbols == c], own[symbols == c]
        positions, lcp = kept.pop(c)
        if len(positions):
            positions, down = positions[::-1], np.zeros(len(positions), np.int32)
            down[1:] = lcp[::-1][:-1]
            if with_lcp and tail is not None:
                down[0] = text.common_one(tail, positions[:1])
            at = scan.add(down) if with_lcp else 0
            yield positions, down
            symbols, left, mask = step(positions, lambda x: (x > 0) & (x < c))
            queue.push(symbols, left, at + np.flatnonzero(mask))


def named(text: Strings, store: Store, limit: int) -> np.ndarray:
    """Names of the leftmost S positions, in text order: sentinels from 0 by place, then the substrings up to the next one by order."""
    t, starts = text.t, text.leftmost
    sentinel = t[starts] == 0
    seeds = starts[np.argsort(t[starts], kind="stable")]
    is_start = np.zeros(len(t), bool)
    is_start[starts] = True
    order = np.concatenate([np.zeros(0, np.int64), *[p[is_start[p]] for p, _ in induce(text, seeds, None, store, limit)]])[::-1]
    place = text.slot[order]
    stop = starts[np.minimum(place + 1, len(starts) - 1)]
    size = stop - order + 1
    # neighbours have one name if their substrings are equal; a longer common prefix than the substring counts as its length
    new = np.ones(len(order), bool)
    if len(order) > 1:
        same = np.flatnonzero(size[1:] == size[:-1])
        new[1 + same] = ~equal_ranges(t, order[same], order[same + 1], size[same])
    names = np.zeros(len(starts), np.int64)
    names[sentinel] = np.arange(int(sentinel.sum()))
    names[place] = int(sentinel.sum()) + np.cumsum(new) - 1
    return names


def equal_ranges(t: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    out, open_, at = np.ones(len(a), bool), np.arange(len(a)), 0
    while len(open_):
        differ = t[a[open_] + at] != t[b[open_] + at]
        out[open_[differ]] = False
        at += 1
        open_ = open_[~differ & (size[open_] > at)]
    return out


def doubled(names: np.ndarray) -> np.ndarray:
    """Positions of a string of names in order of its suffixes; its last name occurs once. Ranks are refined with twice the length each round."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    s = names[order]
    head = np.concatenate([[True], s[1:] != s[:-1]])
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    length, open_ = 1, np.flatnonzero(~(head & np.append(head[1:], True)))  # places in groups of two and more
    while len(open_):
        own = order[open_]
        key = rank[np.minimum(own + length, n)]
        group = rank[own]
        by = np.lexsort((key, group))
        own, key, group = own[by], key[by], group[by]
        order[open_] = own
        head = np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])])
        rank[own] = np.maximum.accumulate(np.where(head, open_, 0))
        open_ = open_[~(head & np.append(head[1:], True))]
        length *= 2
    return order


def sorted_starts(text: Strings, store: Store, limit: int, base: int) -> np.ndarray:
    """The leftmost S positions in order of their suffixes."""
    names = named(text, store, limit)
    if names.max(initial=-1) == len(names) - 1:
        return text.leftmost[np.argsort(names)]
    if len(names) <= base:
        return text.leftmost[doubled(names)]
    # the next level: names from 1 on, and one sentinel at the end
    inner = Strings(np.append(names + 1, 0).astype(np.int64))
    starts = sorted_starts(inner, store, limit, base)
    parts = [p for p, _ in induce(inner, starts, None, store, limit)]
    return text.leftmost[np.concatenate(parts)[::-1]]


def suffixes(symbols: np.ndarray, store: Store | None = None, limit: int = QUEUE_TUPLES, base: int = BASE_SYMBOLS):
    """Yields (positions, common prefixes with the suffix yielded before) of all suffixes but sentinels, from the largest down.

    ``symbols``: strings of symbols from 1 on, each closed by 0; none may be empty. Ties between equal suffixes go by the string's place.
    """
    store = store or Store()
    if not len(symbols):
        return
    text = Strings(symbols)
    seeds = sorted_starts(text, store, limit, base)
    lcp = np.zeros(len(seeds), np.int64)
    real = np.flatnonzero(text.t[seeds[:-1]] > 0)
    rest = text.rest(text.leftmost)[text.slot[seeds]]
    lcp[1 + real] = text.common(seeds[real], seeds[real + 1], np.minimum(rest[real], rest[real + 1]))
    yield from induce(text, seeds, lcp, store, limit)


def repeated(symbols: np.ndarray, length: int, **options) -> np.ndarray:
    """Marks the positions whose string of ``length`` symbols also starts somewhere else."""
    hit, last = np.zeros(len(symbols), bool), np.zeros(0, np.int64)
    for positions, lcp in suffixes(symbols, **options):
        long = lcp >= length
        hit[positions[long]] = True
        before = np.concatenate([last, positions])[: len(positions)] if len(last) else np.concatenate([positions[:1], positions[:-1]])
        hit[before[long]] = True
        last = positions[-1:]
    return hit
