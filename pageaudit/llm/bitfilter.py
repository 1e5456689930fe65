"""A filter of fixed greatest size, for leaving out most rows before a shuffle and an exact join."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageaudit.llm import textbatch as tb

#: Least and greatest size in bits; beyond it more passes the filter, nothing is lost.
FILTER_BITS = (1 << 16, 1 << 27)


class BitFilter:
    """Says surely no or perhaps for the 64-bit hashes of a column; two bits for each."""

    def __init__(self, df: DataFrame, column: str):
        hashes = df.select(F.col(column).alias("h")).distinct()
        self.bits = int(min(max(1 << (16 * hashes.count()).bit_length(), FILTER_BITS[0]), FILTER_BITS[1]))
        mask, half = F.lit(self.bits - 1).cast("long"), self.bits.bit_length()
        at = F.explode(F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", half).bitwiseAND(mask))).alias("at")
        # one long for each 64 bits: never more than the filter's size comes to the driver
        rows = (
            hashes.select(at).groupBy(F.shiftright("at", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("set")).toArrow()
        )
        self.words = np.zeros(self.bits >> 6, np.uint64)
        self.words[rows["word"].to_numpy()] = rows["set"].to_numpy().view(np.uint64)
        del rows
        tb.release()

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in (hashes & np.uint64(self.bits - 1), hashes >> np.uint64(self.bits.bit_length()) & np.uint64(self.bits - 1)):
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out
