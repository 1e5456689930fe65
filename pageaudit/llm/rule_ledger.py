"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements and one failure bit per
rule. Policies (named, versioned masks) and ablations are then bit operations on the ledger and never
read a text again.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageaudit.llm import textbatch as tb

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
WINDOW = 5
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters"]
MEASURE_SCHEMA = ", ".join(f"{m} bigint" for m in MEASURES)


@dataclass(frozen=True)
class Rule:
    """``fails`` is an SQL condition over the measurements; the bit is the rule's place in the ledger and is never reused."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 25 * n_words"),
    Rule(6, "capitals", "2 * n_upper > n_letters"),
)
BASE = ("few_words", "repeated_windows")


def mask_of(names, rules=RULES) -> int:
    wanted = set(names)
    return sum(1 << r.bit for r in rules if r.name in wanted)


#: Versioned policies: a document stays if none of the policy's rules failed.
POLICIES = {("base", 1): mask_of(BASE), ("full", 1): mask_of(r.name for r in RULES)}


def measure_batch(texts: pa.Array) -> dict[str, np.ndarray]:
    """The measurements of each text; null and empty texts measure 0 everywhere."""
    data, offsets = tb.buffers(texts)
    starts, ends, first = tb.spans_of(~tb.SEPARATOR[data], offsets)
    n_words = np.diff(first)
    out = {"n_words": n_words}
    # code points: bytes that do not continue a character
    out["word_chars"] = tb.per_row(~tb.SEPARATOR[data] & ((data & 0xC0) != 0x80), offsets)
    out["n_symbols"] = tb.per_row(SYMBOL[data], offsets)
    out["n_upper"] = tb.per_row((data >= 65) & (data <= 90), offsets)
    out["n_letters"] = tb.per_row((tb.ASCII_LOWER[data] >= 97) & (tb.ASCII_LOWER[data] <= 122), offsets)

    begin, end, first_line = tb.spans_of(data != 10, offsets)
    words_before = np.searchsorted(starts, begin), np.searchsorted(starts, end)
    full = words_before[1] > words_before[0]
    line_row = tb.row_of(first_line)[full]
    out["n_lines"] = np.bincount(line_row, minlength=len(n_words))
    lines = tb.hash_spans(data, begin, end)[full] + tb.mix(line_row.astype(np.uint64))
    order = np.argsort(lines, kind="stable")
    again = order[1:][lines[order[1:]] == lines[order[:-1]]]
    out["n_dup_lines"] = np.bincount(line_row[again], minlength=len(n_words))

    row = tb.row_of(first)
    found, at = tb.windows(tb.hash_spans(data, starts, ends), first, WINDOW)
    found = found + tb.mix(row[at].astype(np.uint64))
    order = np.argsort(found)
    same = found[order[1:]] == found[order[:-1]]
    twice = np.zeros(len(found), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(starts), bool)
    for j in range(WINDOW):
        covered[at[twice] + j] = True
    out["n_repeat_words"] = np.bincount(row[covered], minlength=len(n_words))
    return out


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and measurements, one row per input row; other columns are not read."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in tb.slices(batches, "text"):
            found = measure_batch(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(found[m].astype(np.int64)) for m in MEASURES)], ["id", *MEASURES])

    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, {MEASURE_SCHEMA}").withColumnRenamed("id", id_col)


def failure_bits(rules=RULES) -> Column:
    """One long with the bit of each failed rule set."""
    bits = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """Id, measurements and ``failed_bits``, one row per input row.

    Null and empty texts have no words and fail the rule on few words; repeated rows are
    measured each for itself; an empty table gives an empty ledger.
    """
    return measure(docs, id_col, text_col).withColumn("failed_bits", failure_bits(rules))


def passes(policy: tuple[str, int], policies=None) -> Column:
    """Whether no rule of the policy failed."""
    return F.col("failed_bits").bitwiseAND(F.lit((policies or POLICIES)[policy]).cast("long")) == 0


def ablations(book: DataFrame, policy: tuple[str, int], rules=RULES, policies=None) -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail only it, and that would stay without it.

    The ledger is first counted by its bits (at most 2^rules groups, summed before the
    shuffle), the rest is bit arithmetic on those few rows.
    """
    mask = (policies or POLICIES)[policy]
    counted = (
        book.select(F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits"))
        .groupBy("bits").agg(F.count("*").alias("n"))
    )
    own = [r for r in rules if mask >> r.bit & 1]
    sums = []
    for r in own:
        bit = F.lit(1 << r.bit).cast("long")
        sums.append(F.struct(
            F.lit(r.name).alias("rule"),
            F.sum(F.when(F.col("bits").bitwiseAND(bit) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == bit, F.col("n")).otherwise(0)).alias("n_only"),
            F.sum(F.when(F.col("bits").bitwiseAND(F.lit(mask & ~(1 << r.bit)).cast("long")) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
        ))
    return counted.agg(F.array(*sums).alias("x")).select(F.inline("x"))
