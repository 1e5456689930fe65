"""Quality classifier: naive Bayes support vectors.

Features say which n-grams a text has (words alone and in pairs, and runs of one to four word shapes),
hashed into BUCKETS places. Each is scaled by the log ratio of its smoothed counts in the two classes,
and a linear hinge-loss model is fitted on the scaled features by dual coordinate descent. A logistic
curve on labelled documents kept out of the fit turns margins into scores.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageaudit.llm import textbatch as tb

BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
#: About as many labelled documents are chosen, by a hash of their ids, to fit the model; the bound of the fit.
MAX_TRAIN = 8_192
EPOCHS, COST, CALIBRATION_SHARE = 12, 1.0, 5
THRESHOLD = 0.3


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A small number for the look of each word: letter case, digits, outer signs, size, and whether it repeats the word before."""
    size = ends - starts
    count = lambda mask: np.add.reduceat(mask, starts, dtype=np.int64)  # noqa: E731  what lies between words is never counted
    upper = count((data >= 65) & (data <= 90))
    letters = count(((tb.ASCII_LOWER[data] >= 97) & (tb.ASCII_LOWER[data] <= 122)) | (data >= 0xC0))
    digits = count((data >= 48) & (data <= 57))
    sign = np.where((data < 128) & ~((tb.ASCII_LOWER[data] >= 97) & (tb.ASCII_LOWER[data] <= 122)) & ~((data >= 48) & (data <= 57)), data, 0)
    case = np.where(letters == 0, 3, np.where((upper >= 2) & (2 * upper > letters), 2, (data[starts] >= 65) & (data[starts] <= 90)))
    again = np.zeros(len(starts), np.int64)
    again[1:] = hashes[1:] == hashes[:-1]
    again[first[:-1][first[:-1] < len(starts)]] = 0
    code = sign[ends - 1].astype(np.int64) | sign[starts].astype(np.int64) << 8 | case << 16 | (digits > 0).astype(np.int64) << 18 | again << 19
    return (code | np.searchsorted([2, 4, 8, 16], size, "right") << 20).astype(np.uint64)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of the distinct features of each text, in ascending order; null and empty texts have none."""
    data, offsets = tb.buffers(texts)
    starts, ends, first = tb.spans_of(~tb.SEPARATOR[data], offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = tb.hash_spans(tb.ASCII_LOWER[data], starts, ends)
    look = tb.mix(shapes(data, starts, ends, words, first) + np.uint64(1 << 40))
    row, keys = tb.row_of(first), []
    for hashes, most in ((words, 2), (look, 4)):
        for n in range(1, most + 1):
            found, at = tb.windows(hashes, first, n)
            keys.append(row[at] << BUCKET_BITS | (found >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
    keys = np.unique(np.concatenate(keys))
    return keys >> BUCKET_BITS, keys & (BUCKETS - 1)


@dataclass
class Model:
    """Weight of each bucket (log ratio and support vectors in one), bias, and slope and shift of the logistic curve."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, row: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        size = np.bincount(row, minlength=n)
        return np.bincount(row, self.weights[bucket], n) / np.sqrt(np.maximum(size, 1)) + self.bias

    def score(self, texts: pa.Array) -> np.ndarray:
        m = self.margins(*features(texts), len(texts))
        return 1 / (1 + np.exp(-np.clip(self.slope * m + self.shift, -30, 30)))


def log_count_ratios(examples: list[np.ndarray], labels: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log of the ratio of each feature's smoothed share in class 1 to that in class 0."""
    counts = np.zeros((2, BUCKETS))
    for x, y in zip(examples, labels):
        counts[y, x] += 1
    counts += smooth
    shares = counts / counts.sum(1, keepdims=True)
    return np.log(shares[1] / shares[0])


def dual_coordinate_descent(examples: list[np.ndarray], scale: np.ndarray, labels: np.ndarray, cost: float = COST, epochs: int = EPOCHS):
    """Weights and bias of the linear hinge-loss model; one dual variable per example, changed one at a time in a fixed random order.

    The rarer class gets a higher cost, so that both weigh the same.
    """
    y = np.where(labels == 1, 1.0, -1.0)
    bound = cost * len(y) / (2 * np.maximum(1, np.where(y > 0, (y > 0).sum(), (y < 0).sum())))
    values = [scale[x] / np.sqrt(max(1, len(x))) for x in examples]
    norm = np.array([v @ v + 1.0 for v in values])
    weights, bias, alpha, rng = np.zeros(BUCKETS), 0.0, np.zeros(len(y)), np.random.default_rng(5)
    for _ in range(epochs):
        for k in rng.permutation(len(y)):
            x, v = examples[k], values[k]
            slope = y[k] * (weights[x] @ v + bias) - 1
            new = min(max(alpha[k] - slope / norm[k], 0.0), bound[k])
            if step := (new - alpha[k]) * y[k]:
                weights[x] += step * v
                bias += step
                alpha[k] = new
    return weights, bias


def logistic_curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift that fit the labels, with targets drawn in a little so that they stay finite."""
    n1 = labels.sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (len(labels) - n1 + 2))
    beta, x = np.array([1.0, 0.0]), np.stack([margins, np.ones(len(margins))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - target) + 1e-3 * (beta - [1, 0]))
        beta = beta - step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def train(examples: list[np.ndarray], labels: np.ndarray) -> Model:
    """Every fifth example sets the logistic curve only. With one class or no example every text gets the smoothed share of class 1."""
    held = np.arange(len(labels)) % CALIBRATION_SHARE == 0
    own = [x for x, h in zip(examples, held) if not h]
    if len(set(labels[~held])) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        return Model(np.zeros(BUCKETS), 0.0, 0.0, float(np.log(share / (1 - share))))
    ratios = log_count_ratios(own, labels[~held])
    weights, bias = dual_coordinate_descent(own, ratios, labels[~held])
    model = Model(weights * ratios, bias, 1.0, 0.0)
    rest = [x for x, h in zip(examples, held) if h]
    row = np.repeat(np.arange(len(rest)), [len(x) for x in rest])
    model.slope, model.shift = logistic_curve(model.margins(row, np.concatenate(rest), len(rest)), labels[held])
    return model


def remainder(id_: Column) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(5))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> Model:
    """The model from labelled documents whose id has a remainder other than 0.

    At most ``max_train`` labelled ids are taken, by a hash over all labels (all of them where there are fewer); the
    list of ids is that long at most, so it is sent to every task. Null labels are left out; of differing labels of one id the larger counts.
    """
    known = (
        labels.where(F.col(label_col).isNotNull() & (remainder(F.col(id_col)) != 0))
        .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    )
    order = F.xxhash64(F.col("id").cast("string"), F.lit(3))
    share = min(1.0, max_train / max(1, known.count()))
    chosen = known.withColumn("order", order).where(F.pmod("order", F.lit(1 << 30)) < int(share * (1 << 30)) + 1).orderBy("order", "id").limit(max_train)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("order", "y", "text")

    def run(batches):
        for batch in tb.slices(batches, "text"):
            row, bucket = features(batch.column("text"))
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))])
            packed = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(bucket.astype("<i4"))])
            yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("y"), packed], ["order", "y", "x"])

    rows = texts.mapInArrow(run, "order bigint, y int, x binary").toArrow().sort_by([("order", "ascending"), ("x", "ascending")])
    examples, y = [np.frombuffer(x.as_py(), "<i4") for x in rows["x"]], rows["y"].to_numpy().astype(int)
    del rows
    model = train(examples, y)
    del examples
    tb.release()  # the driver goes on after the fit
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, name: str | None = None) -> DataFrame:
    """Id and ``score`` (0 to 1), one row per input row; with ``keep`` all columns of ``docs`` and ``quality_score`` (replaced if there is one).

    Null and empty texts get the score of the bias alone. Repeated rows get equal scores; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = name or ("quality_score" if keep else "score")
    slim = docs.drop(name) if keep else docs.select(F.col(id_col), F.col(text_col))

    def run(batches):
        for batch in tb.slices(batches, text_col):
            values = pa.array(shared.value.score(batch.column(text_col)))
            out = batch if keep else batch.select([id_col])
            yield out.append_column(name, values)

    kept = [f for f in slim.schema.fields if keep or f.name == id_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return slim.mapInArrow(run, f"{schema}, {name} double")
