"""Personal data by candidate gradient boosting.

Generators with high recall propose spans, which may overlap. Boosted trees score each candidate from its format, read after
loose spellings are made plain, and from the words around it; a threshold for each kind, calibrated on documents that the
scoring model has not seen, selects those to report. What the strict rules of a kind confirm is always reported.

The trees learn from the whole corpus itself, by weak labels. Positive examples are confirmed spans rewritten, in their place, into forms that the strict
rule does not read: "(at)" and "(dot)", defanged addresses, other separators of cards, phone numbers without their plus sign. Negative ones are
decoys drawn at random places of the same texts, and candidates that cannot be personal data: cards whose checksum fails, address parts above
255, numbers too short or too long for a phone. Other candidates are not labelled and teach nothing.
"""

import bisect
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageaudit.llm import textbatch as tb
from pageaudit.llm.secret_scan import cover
from pageaudit.session import written

KINDS = ("email", "ip", "card", "phone")
# Fixed values of the contract.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# generators beyond the strict rules
DOT = r" ?(?:\.|\(dot\)|\[dot\]|\(\.\)|\[\.\]| dot ) ?"
LOOSE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|@) ?[A-Za-z0-9-]{1,63}(?:" + DOT + "[A-Za-z0-9-]{1,63}){1,6}"),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,5}(?:" + DOT + r"[0-9]{1,5}){3}(?![0-9.])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[\x20./-]{0,3}[0-9]){12,18}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9A-Za-z])(?:\+|00|\()?[0-9][0-9().\x20/-]{5,20}[0-9](?![0-9A-Za-z])"),
}
ANY = r"@|[0-9]{7}|[0-9][\x20()./-]+[0-9]|\((?:at|dot|\.)\)|\[(?:at|dot|\.)\]|[0-9] dot [0-9]"
AT_FORMS, DOT_FORMS = (" (at) ", "(at)", " [at] ", "[at]", " @ "), (" (dot) ", "(dot)", " [dot] ", " dot ", ".")
#: Words that go with a kind.
CUES = {
    "email": ("mail", "email", "write", "contact", "address", "inbox"), "ip": ("ip", "host", "server", "address", "ping", "login"),
    "card": ("card", "visa", "mastercard", "credit", "pay", "paid", "charge"), "phone": ("call", "phone", "tel", "mobile", "fax", "contact", "ring"),
}
#: Scores are whole numbers of 1 / STEP log-odds, gradients of 1 / UNIT; a leaf moves a score by so much log-odds at most.
STEP, UNIT, LARGEST_LEAF = 1024, 1 << 20, 4.0
#: Stricter than what is wanted of the spans added, because a corpus holds more decoys for each loose form than the examples do.
PRECISION = 0.995
#: How much of the text on either side of a span the features read.
BEFORE, AFTER = 40, 20


def emails(text: str):
    """Leftmost, non-overlapping; each @ is looked at once, so long runs cost no more than their length."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = ord(d) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def strict(text: str) -> list[tuple[int, int, str]]:
    """The spans that the strict rules confirm."""
    out = [(a, b, "email") for a, b in emails(text)]
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(len(n := p.lstrip("0")) <= 3 and int(n or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    for m in PHONE.finditer(text):
        if 10 <= len(digits_of(m[0])) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return out


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Proposed spans of all kinds, overlapping or not."""
    return [(m.start(), m.end(), k) for k, pattern in LOOSE.items() for m in pattern.finditer(text)]


def plain_form(span: str) -> str:
    """The span with (at) and (dot) in any spelling as the signs they stand for, without blanks around them."""
    span = re.sub(r" ?(?:\(at\)|\[at\]|@) ?", "@", span)
    return re.sub(DOT, ".", span)


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    """Format of the plain form and context. A text of which only the surroundings are given is enough."""
    span, before, after = text[start:end], text[max(0, start - BEFORE) : start], text[end : end + AFTER]
    plain, digits = plain_form(span), digits_of(span)
    local, _, domain = plain.rpartition("@")
    labels = domain.split(".")
    groups = re.findall("[0-9]+", span)
    sizes = [len(g) for g in groups] or [0]
    left, right = re.findall(r"\w+", before.lower())[-4:], re.findall(r"\w+", after.lower())[:2]
    return [
        KINDS.index(kind), len(plain), len(digits), luhn(digits), len(groups), max(sizes), min(sizes), sizes[0], sizes[-1], len(set(sizes[:-1])), any(int(g) > 255 for g in groups),
        len(set(digits)), span.count("("), len(set(re.findall(r"[^0-9A-Za-z]", span))), span[0] == "0", sum(c.isalpha() for c in local), len(local),
        len(labels), labels[-1].isalpha() and labels[-1].islower(), len(labels[-1]), sum(c.isalpha() for c in domain), labels[0].islower(),
        *(any(w in CUES[k] for w in [*left, *right]) for k in KINDS), before[-1:] in ".-/" and before != "", after[:1] in "-/%" and after != "",
        sum(c.isdigit() for c in before), sum(c.isdigit() for c in after),
    ]


def loosened(span: str, kind: str, rng: random.Random) -> str:
    """A confirmed span in a form that the strict rule of its kind does not read."""
    if kind == "email":
        local, _, domain = span.partition("@")
        return local + rng.choice(AT_FORMS) + rng.choice(DOT_FORMS).join(domain.split("."))
    if kind == "ip":
        return rng.choice(("[.]", "(.)", "(dot)", "[dot]", " dot ")).join(span.split("."))
    if kind == "card":
        digits = digits_of(span)
        return rng.choice((".", "/", "  ", " - ")).join(digits[k : k + 4] for k in range(0, len(digits), 4))
    groups = re.findall("[0-9]+", span)
    forms = ["00" + span[1:], span[1:], "(" + groups[0] + ") " + " ".join(groups[1:])]
    return rng.choice(forms if len(groups) < 3 else [*forms, "0" + "-".join(groups[1:]), "(0" + groups[1] + ") " + "-".join(groups[2:])])


def decoy(kind: str, word: str, rng: random.Random) -> str:
    """Something that a generator proposes and that is no personal data of the kind."""
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    grouped = lambda sizes, sep: sep.join(digits(n) for n in sizes)
    if kind == "email":
        return rng.choice((f"{digits(2)} @ {digits(2)}.{digits(2)}", f"{word} @ {digits(1)}.{digits(2)}", f"{word} (at) {word}. {word.capitalize()}", f"{word} @ {word} . {digits(3)}"))
    if kind == "ip":
        return rng.choice((".", "[.]", " dot ")).join(str(rng.choice((rng.randint(256, 99999), rng.randint(0, 999)))) for _ in range(4))
    if kind == "card":
        # groups as on a card with a wrong checksum, or other groups with a right one
        like, sep = rng.random() < 0.5, rng.choice((".", "/", "  ", " - ", " "))
        sizes = (4, 4, 4, rng.randint(2, 7)) if like else [rng.randint(1, 5) for _ in range(rng.randint(4, 6))]
        head = grouped(sizes, "" if like and rng.random() < 0.2 else sep)[:-1]
        return head + next(d for d in "0123456789" if luhn(digits_of(head + d)) != like)
    date = f"{rng.randint(1900, 2100)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}"
    several = grouped([rng.randint(1, 5) for _ in range(rng.randint(3, 5))], rng.choice((" ", " - ", "/", ".")))
    return rng.choice((date, date.replace("-", "/") + " " + digits(2), digits(rng.randint(7, 22)), several, f"{digits(rng.randint(3, 6))}.{digits(rng.randint(2, 9))}"))


def impossible(span: str, kind: str) -> bool:
    """The candidate cannot be personal data of its kind."""
    digits = digits_of(span)
    return (
        kind == "card" and not luhn(digits)
        or kind == "ip" and any(int(g) > 255 for g in re.findall("[0-9]+", span))
        or kind == "phone" and not 7 <= len(digits) <= 15
    )


def examples(text: str, seed: int) -> list[tuple[list[float], int]]:
    """Features and weak label of the examples that one text gives: see the head of the module."""
    rng, out = random.Random(seed), []

    def placed(new: str, start: int, end: int, kind: str, label: int):
        head = text[max(0, start - BEFORE) : start]
        around = head + new + text[end : end + AFTER]
        here = (len(head), len(head) + len(new))
        known = set(strict(around))
        for a, b, k in candidates(around):
            if (a, b, k) not in known and a < here[1] and here[0] < b and (k != kind or (a, b) == here):
                out.append((features(around, a, b, k), label if k == kind else 0))  # what reads it as another kind is wrong

    sure, rest = text_candidates(text)
    for a, b, kind in sure:
        for k in range(4):
            if k < 2:
                placed(loosened(text[a:b], kind, rng), a, b, kind, 1)
            blank = text.find(" ", rng.randrange(len(text)))
            word = re.match(r"[A-Za-z]{0,12}", text[blank + 1 : blank + 13])[0] or "at"
            new = decoy(kind, word, rng)
            if blank >= 0:
                placed(new, blank + 1, blank, kind, 0)  # a blank on either side
    out += [(x, 0) for a, b, kind, x in rest if impossible(text[a:b], kind)]
    return out


def edges_of(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """The distinct inner ``bins``-quantiles of a feature, given its ascending values and how often each occurs."""
    upto = np.cumsum(counts)
    at = np.linspace(0, 1, bins + 1)[1:-1] * (upto[-1] - 1)
    low, high = (values[np.searchsorted(upto, f(at), "right")].astype(float) for f in (np.floor, np.ceil))
    return np.unique(low + (high - low) * (at - np.floor(at)))


class Trees:
    """Gradient boosting on the logistic loss with depth-limited trees over quantile bins.

    Scores and gradients are whole numbers of small units, so their sums do not depend on the order of the examples. The trees grow
    from histograms, one level at a time (``boost``): what is summed over parts of the examples gives the same trees.
    """

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 10):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.trees, self.base, self.edges = rounds, depth, rate, bins, least, [], 0, []

    def fit(self, x: np.ndarray, y: np.ndarray):
        """Trees of examples in memory. Constant targets give a constant score."""
        if len(y):
            self.edges = [edges_of(*np.unique(c, return_counts=True), self.bins) for c in x.T]
        self.start(len(y), int(y.sum()))
        binned = self.binned(x)
        boost([self], lambda level: [self.histogram(level, binned, y)])
        return self

    def start(self, n: int, positive: int):
        """The score before the first tree; without examples of both labels there will be no tree."""
        share = (positive + 1) / (n + 2)
        self.base = round(np.log(share / (1 - share)) * STEP)
        self.rounds = self.rounds if 0 < positive < n else 0

    def binned(self, x: np.ndarray) -> np.ndarray:
        """The bin of each feature (row) of each example (column)."""
        return np.stack([np.searchsorted(e, c, "left").astype(np.uint8) for e, c in zip(self.edges, x.T)]) if self.edges else np.zeros((0, len(x)), np.uint8)

    def nodes(self, tree, binned: np.ndarray, levels: int) -> np.ndarray:
        feature, cut, _ = tree
        node, rows = np.ones(binned.shape[1], np.int64), np.arange(binned.shape[1])
        for _ in range(levels):
            f = feature[node]
            node = np.where(f < 0, node, 2 * node + (binned[f, rows] > cut[node]))
        return node

    def score(self, binned: np.ndarray, trees=None) -> np.ndarray:
        """Log-odds of the examples as whole numbers of 1 / STEP."""
        score = np.full(binned.shape[1], self.base, np.int64)
        for tree in self.trees if trees is None else trees:
            score += tree[2][self.nodes(tree, binned, self.depth)]
        return score

    def histogram(self, level: int, binned: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Examples, gradients and curvatures of the last tree's nodes at ``level``: (3, node, feature, bin), whole numbers."""
        width, features = 1 << level, len(binned)
        p = probability(self.score(binned, self.trees[:-1]))
        node = self.nodes(self.trees[-1], binned, level) - width
        rows = np.flatnonzero(node >= 0)  # the others have come to a leaf
        at = ((node[rows] * features + np.arange(features)[:, None]) * self.bins + binned[:, rows]).ravel()
        sums = [None, np.rint((p - y)[rows] * UNIT), np.rint((p * (1 - p))[rows] * UNIT)]  # exact as doubles
        return np.stack([np.bincount(at, None if w is None else np.tile(w, features), width * features * self.bins).astype(np.int64) for w in sums]).reshape(3, width, features, self.bins)

    def leaf(self, g: float, h: float) -> int:
        return round(min(LARGEST_LEAF, max(-LARGEST_LEAF, -self.rate * g / (h + 1))) * STEP)

    def split(self, level: int, histogram: np.ndarray):
        """Splits the last tree's nodes at ``level`` or makes them leaves."""
        feature, cut, value = self.trees[-1]
        for k in range(1 << level):
            node, (n, g, h) = (1 << level) + k, histogram[:, k] / np.array([1, UNIT, UNIT])[:, None, None]
            total, total_g, total_h = n[0].sum(), g[0].sum(), h[0].sum()
            if not total:
                continue
            n, g, h = (np.cumsum(c, 1)[:, :-1] for c in (n, g, h))
            gain = g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
            gain[(n < self.least) | (total - n < self.least)] = 0
            f, c = divmod(int(gain.argmax()), self.bins - 1)
            if gain[f, c] <= 1e-6:
                value[node] = self.leaf(total_g, total_h)
                continue
            feature[node], cut[node] = f, c
            if level == self.depth - 1:
                value[2 * node], value[2 * node + 1] = self.leaf(g[f, c], h[f, c]), self.leaf(total_g - g[f, c], total_h - h[f, c])

    def predict(self, x: np.ndarray) -> np.ndarray:
        return probability(self.score(self.binned(x) if len(x) else np.zeros((0, 0), np.uint8)))


def probability(score: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-score / STEP))


def boost(models: list[Trees], histograms) -> None:
    """Grows the trees of all models side by side; ``histograms(level)`` gives those of each that still grows, in their order."""
    for done in range(max(m.rounds for m in models)):
        grow = [m for m in models if done < m.rounds]
        for m in grow:
            # nodes 1 to 2^(depth+1)-1: feature (-1: leaf), cut, value
            m.trees.append((np.full(2 << m.depth, -1), np.zeros(2 << m.depth, np.int64), np.zeros(2 << m.depth, np.int64)))
        for level in range(max(m.depth for m in grow)):
            for m, histogram in zip(grow, histograms(level)):
                m.split(level, histogram)


def text_candidates(text: str):
    """Strict spans, and the other candidates with their features."""
    sure = strict(text)
    known = set(sure)
    return sure, [(*c, features(text, *c)) for c in candidates(text) if c not in known]


def calibrate(kinds: np.ndarray, score: np.ndarray, y: np.ndarray, precision: float = PRECISION, n: np.ndarray | None = None) -> dict[int, float]:
    """For each kind the lowest threshold above which the share of positive examples is at least ``precision``; above 1 if none.

    A row is an example, or ``n`` examples of which ``y`` are positive.
    """
    n, out = np.ones(len(y), np.int64) if n is None else n, {}
    for k in range(len(KINDS)):
        at = np.flatnonzero(kinds == k)
        at = at[np.argsort(-score[at], kind="stable")]
        seen = np.cumsum(n[at])
        right = np.cumsum(y[at]) / seen
        last = np.append(score[at][1:] < score[at][:-1], True) if len(at) else np.zeros(0, bool)
        good = np.flatnonzero((right >= precision) & last & (seen >= 20))
        out[k] = float(score[at[good[-1]]]) if len(good) else 2.0
    return out


def all_examples(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The examples of every document: fold (0 or 1, by a hash of the id), kind, y, and the features as 16-bit numbers one after the other."""
    slim = docs.select(F.xxhash64(F.col(id_col).cast("string"), F.lit(7)).alias("order"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())

    def run(batches):
        for batch in tb.slices(batches, "text"):
            batch = batch.filter(pc.match_substring_regex(batch.column("text"), ANY))  # without that a text has no candidates
            fold, kind, y, x = [], [], [], []
            for o, t in zip(batch.column("order").to_pylist(), batch.column("text").to_pylist()):
                rows = examples(t, o)
                fold += [o % 2] * len(rows)
                kind += [r[0][0] for r in rows]
                y += [r[1] for r in rows]
                x += [np.array(r[0], "<i2").tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(fold, pa.int32()), pa.array(kind, pa.int32()), pa.array(y, pa.int32()), pa.array(x, pa.binary())], ["fold", "kind", "y", "x"])

    return slim.mapInArrow(run, "fold int, kind int, y int, x binary")


def _matrix(batch: pa.RecordBatch, dtype) -> np.ndarray:
    """The features of a batch, a row per example."""
    return tb.buffers(batch.column("x"))[0].view(dtype).reshape(batch.num_rows, -1)


def value_counts(rows: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ascending values and their counts for each feature. Features count characters of bounded spans, so values are few."""
    def run(batches):
        total = {}
        for batch in (b for b in batches if b.num_rows):
            for f, column in enumerate(_matrix(batch, "<i2").T):
                for v, n in zip(*(c.tolist() for c in np.unique(column, return_counts=True))):
                    total[f, v] = total.get((f, v), 0) + n
        yield pa.RecordBatch.from_pydict({"f": pa.array([f for f, _ in total], pa.int32()), "v": pa.array([v for _, v in total], pa.int32()), "n": pa.array(total.values(), pa.int64())})

    found = rows.select("x").mapInArrow(run, "f int, v int, n bigint").groupBy("f", "v").agg(F.sum("n").alias("n")).orderBy("f", "v").toArrow()
    f, v, n = (found[c].to_numpy() for c in ("f", "v", "n"))
    return [(v[f == k], n[f == k]) for k in range(f.max(initial=-1) + 1)]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 40):
    """Trees and thresholds from the weakly labelled examples of every document.

    The documents make two folds. Three models grow side by side: one on either fold, and one on all examples, which is returned.
    The thresholds come from all examples too, each scored by the model that has not seen its fold. A level of the trees is one
    pass over the examples, whose histograms (of fixed size) are summed by Spark; the driver sees sums only. A kind with too
    few examples adds nothing.
    """
    raw = written(all_examples(docs, id_col, text_col), "personal-examples")
    sums = {r["fold"]: (r["n"], r["p"]) for r in raw.groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("p")).collect()}
    if not sums:
        return Trees(), dict.fromkeys(range(len(KINDS)), 2.0)
    whole = Trees(rounds)
    whole.edges = [edges_of(v, n, whole.bins) for v, n in value_counts(raw)]
    models, features = [Trees(rounds), Trees(rounds), whole], len(whole.edges)
    for m, folds in zip(models, ((1,), (0,), (0, 1))):  # the first two are asked about the fold that they have not seen
        m.edges = whole.edges
        m.start(*(sum(c) for c in zip((0, 0), *(sums[f] for f in folds if f in sums))))

    def to_bins(batches):
        for batch in (b for b in batches if b.num_rows):
            x = np.ascontiguousarray(whole.binned(_matrix(batch, "<i2")).T)
            yield batch.set_column(3, "x", pa.array([r.tobytes() for r in x], pa.binary()))

    rows = written(raw.mapInArrow(to_bins, raw.schema), "personal-bins")

    def histograms(level):
        grow = [(k, m) for k, m in enumerate(models) if len(m.trees) and len(m.trees) == max(len(o.trees) for o in models)]
        size = 3 * (1 << level) * features * whole.bins

        def run(batches):
            total = np.zeros((len(grow), size), np.int64)
            for batch in (b for b in batches if b.num_rows):
                fold, y, x = batch.column("fold").to_numpy(), batch.column("y").to_numpy(), _matrix(batch, np.uint8)
                for i, (k, m) in enumerate(grow):
                    use = fold != k
                    total[i] += m.histogram(level, np.ascontiguousarray(x[use].T), y[use]).ravel()
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["at", "total"])

        found = rows.select("fold", "y", "x").mapInArrow(run, "at bigint, total bigint").groupBy("at").agg(F.sum("total").alias("total")).toArrow()
        total = np.zeros(len(grow) * size, np.int64)
        total[found["at"].to_numpy()] = found["total"].to_numpy()
        return total.reshape(len(grow), 3, 1 << level, features, whole.bins)

    boost(models, histograms)

    def unseen(batches):
        for batch in (b for b in batches if b.num_rows):
            fold, x = batch.column("fold").to_numpy(), np.ascontiguousarray(_matrix(batch, np.uint8).T)
            score = np.where(fold == 0, models[0].score(x), models[1].score(x))
            yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.array(score), batch.column("y")], ["kind", "score", "y"])

    # a row for each kind and score, which is a whole number of bounded size
    scored = rows.mapInArrow(unseen, "kind int, score bigint, y int").groupBy("kind", "score").agg(F.sum("y").alias("y"), F.count("*").alias("n")).toArrow()
    kind, score, y, n = (scored[c].to_numpy() for c in ("kind", "score", "y", "n"))
    return whole, calibrate(kind, probability(score), y, n=n)


def select(text: str, trees: Trees, thresholds: dict[int, float]) -> list[tuple[int, int, str]]:
    """Strict spans, and of the other candidates those above the threshold of their kind, the best first, without overlap with any chosen span."""
    sure, rest = text_candidates(text)
    if rest:
        score = trees.predict(np.array([c[3] for c in rest], float))
        taken = []  # in order, without overlap
        for a, b, _ in sorted(sure):
            if taken and a < taken[-1][1]:
                taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
            else:
                taken.append((a, b))
        for k in np.argsort(-score, kind="stable"):
            a, b, kind, _ = rest[k]
            if score[k] >= thresholds[KINDS.index(kind)]:
                at = bisect.bisect_left(taken, (b,))
                if not at or taken[at - 1][1] <= a:
                    taken.insert(at, (a, b))
                    sure.append((a, b, kind))
    return sorted(sure, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model=None) -> DataFrame:
    """Id and ``spans`` (array of kind, start, end, strict; by start, then kind), one row per input row.

    ``model``: trees and thresholds of ``fit`` (fitted on ``docs`` if not given). Null and empty texts have no
    spans; repeated rows are each read; other columns are not; an empty table gives an empty result.
    """
    trees, thresholds = model or fit(docs, id_col, text_col)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("strict", pa.bool_())]))

    def run(batches):
        for batch in tb.slices(batches, "text"):
            texts, out = batch.column("text"), []
            may = pc.fill_null(pc.match_substring_regex(texts, ANY), False).to_pylist()
            for t, x in zip(texts, may):
                if not x:
                    out.append([])
                    continue
                t = t.as_py()
                sure = set(strict(t))
                out.append([{"kind": k, "start": a, "end": b, "strict": (a, b, k) in sure} for a, b, k in select(t, trees, thresholds)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, shape)], ["id", "spans"])

    of = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {of}, spans array<struct<kind: string, start: int, end: int, strict: boolean>>").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "<PERSONAL>", model=None) -> DataFrame:
    """All columns of ``docs``, with every selected span of the text replaced by ``mark``; overlapping spans become one mark.

    One row per input row, repeated rows too. Null texts stay null, texts without a span stay as they are; an empty
    table gives an empty result. ``model`` as in ``find_personal``.
    """
    trees, thresholds = model or fit(docs, id_col, text_col)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in tb.slices(batches, text_col):
            texts = batch.column(at)
            may = pc.fill_null(pc.match_substring_regex(texts, ANY), False).to_pylist()
            new = [cover(t.as_py(), select(t.as_py(), trees, thresholds), mark) if x else t.as_py() for t, x in zip(texts, may)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, texts.type))

    return docs.mapInArrow(run, docs.schema)
