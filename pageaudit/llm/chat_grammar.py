"""A shared Re-Pair grammar over sequences of row symbols, with one min-plus transfer matrix per symbol.

Terminals stand for the role and fault of a row. States of the repaired conversation: nothing yet, after the system row, after a
user row, after an assistant row. The matrix of a symbol has, for each pair of states, the least cost of taking its rows from one to the
other and the ASCII-least audit among the cheapest, as a rope. A rule's matrix is the product of its two symbols' matrices,
worked out once and used by all conversations. No cheapest audit is a proper prefix of another one for the same rows
(equal letters cost the same, further insertions cost more), so the least of joined audits is the join of the least.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Prices of the edits; a truncated row that stays adds one more.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: What may follow: the state after a row of that role.
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Roles by initial, the rest as one; each may be sound or truncated, and rows that must go are all alike.
ROLES = "suao"
SOUND, BROKEN, GONE = dict(zip(ROLES, "ABCD")), dict(zip(ROLES, "EFGH")), "Z"
#: Letters of the rules; rules of a round, rounds, and the least count of a pair worth a rule.
FIRST_RULE, RULES_A_ROUND, GRAMMAR_ROUNDS, LEAST_PAIRS = 0x100, 32, 8, 4


class Rope:
    """A text as two joined ropes; put together when it is first read."""

    __slots__ = ("left", "right", "made")

    def __init__(self, left, right=None, made=None):
        self.left, self.right, self.made = left, right, made

    def text(self) -> str:
        if self.made is None:
            parts, stack = [], [self]
            while stack:
                rope = stack.pop()
                if rope.made is not None:
                    parts.append(rope.made)
                else:
                    stack += [rope.right, rope.left]
            self.made, self.left, self.right = "".join(parts), None, None
        return self.made


EMPTY = Rope(None, None, "")


def least(options):
    """The cheapest (cost, rope); of those the ASCII-least. Ropes are read only where costs are equal."""
    best = None
    for cost, rope in options:
        if best is None or cost < best[0] or cost == best[0] and rope.text() < best[1].text():
            best = cost, rope
    return best


def product(a: dict, b: dict) -> dict:
    """The transfer matrix of what ``a`` stands for followed by what ``b`` stands for."""
    ways: dict = {}
    for (p, m), (cost, rope) in a.items():
        for (n, q), (more, tail) in b.items():
            if n == m:
                ways.setdefault((p, q), []).append((cost + more, Rope(rope, tail)))
    return {k: least(v) for k, v in ways.items()}


def _insertions() -> dict:
    """Between rows: the fewest insertions of user and assistant rows that lead from one state to another."""
    out = {(p, p): (0, EMPTY) for p in range(4)}
    step = {(p, q): (INSERT, Rope(None, None, "I")) for (p, role), q in NEXT.items() if role != "s"}
    for _ in range(3):
        for k, way in product(out, step).items():
            out[k] = least([way, *([out[k]] if k in out else [])])
    return out


INSERTIONS = _insertions()


def terminal(role: str, fault: str) -> str:
    """The symbol of a row from the first letter of its role and its fault (blank, duplicate, truncated or empty)."""
    if fault in ("blank", "duplicate"):
        return GONE
    return (BROKEN if fault == "truncated" else SOUND)[role if role in ("s", "u", "a") else "o"]


def _row(role: str, fault: str) -> dict:
    """Insertions before a row, then the row kept, given another role, or deleted."""
    edits = {(p, p): [(DELETE, Rope(None, None, "D"))] for p in range(4)}
    if fault != "gone":
        extra = TRUNCATED * (fault == "truncated")
        for (p, r), q in NEXT.items():
            if r == role:
                edits.setdefault((p, q), []).append((extra, Rope(None, None, "K")))
            if r != "s":
                edits.setdefault((p, q), []).append((REROLE + extra, Rope(None, None, "R")))
    return product(INSERTIONS, {k: least(v) for k, v in edits.items()})


ROWS = {x: _row(r, f) for table, f in ((SOUND, ""), (BROKEN, "truncated")) for r, x in table.items()} | {GONE: _row("", "gone")}


class Grammar:
    """Rules (symbol, pair) in order; a sequence is compressed by applying them one after the other."""

    def __init__(self, rules=()):
        self.rules = list(rules)

    def compress(self, sequence: str) -> str:
        for symbol, pair in self.rules:
            sequence = sequence.replace(pair, symbol)
        return sequence

    def matrices(self) -> dict:
        """Bottom up: the matrix of every symbol."""
        out = dict(ROWS)
        for symbol, (left, right) in self.rules:
            out[symbol] = product(out[left], out[right])
        for matrix in out.values():
            for _, rope in matrix.values():
                rope.text()
        return out


def repair_pairs(sequences: DataFrame, column: str = "symbols", rounds: int = GRAMMAR_ROUNDS) -> Grammar:
    """Re-Pair over all distinct sequences: each round counts the neighbouring symbols everywhere and replaces the most frequent pairs.

    A round's pairs share no symbol, so that none breaks another. At most ``RULES_A_ROUND`` rules a round come to the driver; the
    grammar's size is bounded by rounds times that, whatever the input. Null and empty sequences add nothing.
    """
    grammar = Grammar()
    for _ in range(rounds):
        def count(batches, grammar=grammar):
            for batch in batches:
                joined = grammar.compress("\n".join(x for x in batch.column(0).to_pylist() if x))
                codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
                pairs, n = np.unique(codes[:-1] << 32 | codes[1:], return_counts=True)
                whole = (pairs >> 32 != 10) & (pairs & 0xFFFFFFFF != 10)
                yield pa_batch(pairs[whole], n[whole])

        counts = sequences.select(column).mapInArrow(count, "pair bigint, n bigint").groupBy("pair").sum("n").toDF("pair", "n")
        taken, chosen = set(), []
        top = counts.where(f"n >= {LEAST_PAIRS}").orderBy(counts["n"].desc(), "pair").limit(4 * RULES_A_ROUND).collect()
        for row in top:
            pair = chr(row["pair"] >> 32) + chr(row["pair"] & 0xFFFFFFFF)
            if len(chosen) < RULES_A_ROUND and not taken & set(pair):
                taken |= set(pair)
                chosen.append(pair)
        if not chosen:
            break
        grammar = Grammar(grammar.rules + [(chr(FIRST_RULE + len(grammar.rules) + k), pair) for k, pair in enumerate(chosen)])
    return grammar


def pa_batch(pairs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n.astype(np.int64))], ["pair", "n"])


def transfer(sequence: str, grammar: Grammar, matrices: dict) -> dict:
    """The matrix of a whole sequence, as a balanced product over its compressed symbols."""
    parts = [matrices[x] for x in grammar.compress(sequence)]
    if not parts:
        return {(p, p): (0, EMPTY) for p in range(4)}
    while len(parts) > 1:
        parts = [product(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]


def finish(matrix: dict) -> tuple[int, str]:
    """Cost and audit of a whole conversation: from nothing to nothing, or to an assistant row."""
    done = product(matrix, INSERTIONS)
    cost, rope = least([done[k] for k in ((START, START), (START, ASSISTANT)) if k in done])
    return cost, rope.text()
