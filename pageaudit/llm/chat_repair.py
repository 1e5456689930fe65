"""Repair of conversations: faults of rows, the cheapest edits that give a sound order of roles, and the repaired rows.

1. Rows without their texts (a 128-bit digest, role and fault) are ordered by a range shuffle over (conversation, turn, digest), so a long
   conversation is spread over tasks. Each task cuts its stretch into segments of symbols.
2. A Re-Pair grammar over all segments gives one transfer matrix per rule (``chat_grammar``); each segment's matrix is a product of those.
   Segments of a conversation that was cut are joined in rounds of ``FAN`` neighbours.
3. The rows with their texts meet the audit of their conversation in one shuffle and are read in order, one at a time. A SHA-256 over a whole
   conversation is one chain, so this last pass has a task per conversation at least; it holds one row and the audit.
"""

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from pageaudit.llm import chat_grammar as cg
from pageaudit.session import written

SEPARATORS = " \t\n\x0b\x0c\r"
#: Rows of a segment, segments joined at a time, and rows sent on at a time.
SEGMENT, FAN, ROWS_OUT = 4096, 64, 512
ORDERLY = {"su", "ua", "au"}
COUNTS = ("blank", "duplicate", "truncated", "illegal")


def plain(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (null: one space) and copies = 1."""
    return conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(1).cast("long").alias("copies")
    )


def damaged(conversations: DataFrame, every: int = 20) -> DataFrame:
    """``plain`` rows with planted faults by the CRC-32 of ``conv_id:turn``: dropped (copies 0), emptied, without full stops, doubled, or made a user's."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = plain(conversations.withColumn("turn", F.col("turn").cast("long"))).withColumn("pick", F.crc32(key.cast("binary")) % every)
    pick = F.col("pick")
    return rows.select(
        "conv_id", "turn", F.when(pick == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(pick == 1, F.lit("")).when(pick == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(pick == 0, F.lit(0)).when(pick == 3, F.col("copies") * 2).otherwise(F.col("copies")).cast("long").alias("copies"),
    )


def digest():
    return F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")))


def slim(rows: DataFrame) -> DataFrame:
    """conv_id, turn, digest, role (0 to 3 for s, u, a and others), blank, cut (truncated), n (copies), again (an earlier turn has the same role and text).

    Equal rows are counted before the shuffle. First turns are a table of their own, so that the join back can split a text that is said over and over.
    """
    trimmed = F.rtrim("text", F.lit(SEPARATORS))
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    facts = rows.select(
        "conv_id", "turn", digest().alias("digest"), role.alias("role"), (trimmed == "").cast("int").alias("blank"),
        (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).cast("int").alias("cut"), "copies",
    )
    own = written(facts.groupBy("conv_id", "turn", "digest").agg(*[F.max(c).alias(c) for c in ("role", "blank", "cut")], F.sum("copies").alias("n")), "chat-rows")
    first = written(
        own.where("n > 0").groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d")).agg(F.max(F.col("turn").isNull()).alias("unknown"), F.min("turn").alias("least"), F.count("*").alias("turns"))
        .where("turns > 1"), "chat-first",
    )
    joined = own.join(first, own["conv_id"].eqNullSafe(first["c"]) & (own["digest"] == first["d"]), "left")
    again = F.col("turn").isNotNull() & (F.col("unknown") | (F.col("turn") > F.col("least")))
    return joined.select("conv_id", "turn", "digest", "role", "blank", "cut", "n", F.coalesce(again, F.lit(False)).alias("again"))


class Stretch:
    """Counts of a stretch of one conversation's rows; two neighbouring ones can be joined."""

    __slots__ = ("conv", "symbols", "first", "last", "low", "high", "turns", *COUNTS)

    def __init__(self, conv):
        self.conv, self.symbols, self.first, self.last, self.low, self.high, self.turns = conv, [], None, None, None, None, 0
        self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn, role, blank, cut, again) -> None:
        fault = "blank" if blank else "duplicate" if again else "truncated" if cut else ""
        letter = cg.ROLES[role]
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        if self.last is not None and self.last + letter not in ORDERLY:
            self.illegal += 1
        self.first = self.first or letter
        self.last = letter
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.symbols.append(cg.terminal(letter, fault))

    def facts(self) -> list:
        return [self.first, self.last, self.low, self.high, self.turns, *[getattr(self, c) for c in COUNTS]]


FACTS = "first string, last string, low bigint, high bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"
FACT_NAMES = [x.split()[0] for x in FACTS.split(", ")]


def join_facts(a: list, b: list) -> list:
    """Facts of two neighbouring stretches as one."""
    out = dict(zip(FACT_NAMES, a))
    then = dict(zip(FACT_NAMES, b))
    for c in ("blank", "duplicate", "truncated", "illegal", "turns"):
        out[c] += then[c]
    out["illegal"] += bool(out["last"] and then["first"] and out["last"] + then["first"] not in ORDERLY)
    out["turns"] -= out["high"] is not None and out["high"] == then["low"]
    out["first"], out["last"] = out["first"] or then["first"], then["last"] or out["last"]
    out["low"] = then["low"] if out["low"] is None else out["low"]
    out["high"] = out["high"] if then["high"] is None else then["high"]
    return [out[c] for c in FACT_NAMES]


def segments(rows: DataFrame, length: int = SEGMENT) -> DataFrame:
    """conv_id, place, at, whole, symbols and facts: stretches of at most ``length`` rows in order of (place, at).

    ``whole``: surely the whole conversation; the first and the last one of a task may go on in the next.
    """
    order = ["conv_id", "turn", "digest"]
    kind, id_type = rows.schema["conv_id"].dataType.simpleString(), to_arrow_type(rows.schema["conv_id"].dataType)

    def run(batches):
        place = TaskContext.get().partitionId()
        done, at, cut = [], 0, False
        now = None

        def rows_out():
            batch = pa.RecordBatch.from_arrays([
                pa.array([s.conv for s, _, _ in done], id_type), pa.array([place] * len(done), pa.int64()), pa.array([k for _, k, _ in done], pa.int64()),
                pa.array([w for _, _, w in done], pa.bool_()), pa.array(["".join(s.symbols) for s, _, _ in done], pa.string()),
                *[pa.array([s.facts()[j] for s, _, _ in done], pa.string() if j < 2 else pa.int64()) for j in range(len(FACT_NAMES))],
            ], ["conv_id", "place", "at", "whole", "symbols", *FACT_NAMES])
            done.clear()
            return batch

        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("conv_id", "turn", "role", "blank", "cut", "n", "again")]
            for conv, turn, role, blank, truncated, n, again in zip(*columns):
                if now is None or conv != now.conv:
                    if now is not None:
                        done.append((now, at, not cut and at > 0))  # the task's first may have begun before it
                        at += 1
                    now, cut = Stretch(conv), False
                for k in range(n):
                    if len(now.symbols) == length:
                        done.append((now, at, False))
                        at, now, cut = at + 1, Stretch(conv), True
                    now.add(turn, role, blank, truncated, again or k > 0)
                    if len(done) > ROWS_OUT:
                        yield rows_out()
        if now is not None:
            done.append((now, at, False))
            yield rows_out()

    schema = f"conv_id {kind}, place bigint, at bigint, whole boolean, symbols string, {FACTS}"
    return written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema), "chat-segments")


def pack(matrix: dict) -> tuple[list, list]:
    ways = [matrix.get((p, q)) for p in range(4) for q in range(4)]
    return [w and w[0] for w in ways], [w and w[1].text() for w in ways]


def unpack(cost: list, audit: list) -> dict:
    return {(k // 4, k % 4): (c, cg.Rope(None, None, a)) for k, (c, a) in enumerate(zip(cost, audit)) if c is not None}


def solved(parts: DataFrame, grammar: cg.Grammar, fan: int = FAN) -> DataFrame:
    """conv_id, facts, cost and audit of every conversation."""
    kind = parts.schema["conv_id"].dataType.simpleString()
    out_schema = f"conv_id {kind}, {FACTS}, cost bigint, audit string"
    matrix_schema = f"conv_id {kind}, {FACTS}, idx bigint, costs array<bigint>, audits array<string>"
    rules = grammar.rules

    def each(batches, answer):
        g = cg.Grammar(rules)
        matrices, known = g.matrices(), {}
        for batch in batches:
            found = []
            for symbols in batch["symbols"].to_pylist():
                if symbols not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[symbols] = answer(cg.transfer(symbols, g, matrices))
                found.append(known[symbols])
            yield batch, found

    def whole(batches):
        for batch, found in each(batches, cg.finish):
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in ("conv_id", *FACT_NAMES)], pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], ["conv_id", *FACT_NAMES, "cost", "audit"])

    def part(batches):
        for batch, found in each(batches, pack):
            yield pa.RecordBatch.from_arrays([
                *[batch[c] for c in ("conv_id", *FACT_NAMES, "idx")], pa.array([c for c, _ in found], pa.list_(pa.int64())), pa.array([a for _, a in found], pa.list_(pa.string())),
            ], ["conv_id", *FACT_NAMES, "idx", "costs", "audits"])

    def neighbours(table: pa.Table) -> pa.Table:
        facts = matrix = None
        rows = sorted(table.to_pylist(), key=lambda r: r["idx"])
        for r in rows:
            here, own = unpack(r["costs"], r["audits"]), [r[c] for c in FACT_NAMES]
            facts, matrix = (own, here) if facts is None else (join_facts(facts, own), cg.product(matrix, here))
        costs, audits = pack(matrix)
        row = {"conv_id": rows[0]["conv_id"], **dict(zip(FACT_NAMES, facts)), "idx": rows[0]["idx"] // fan, "costs": costs, "audits": audits}
        return pa.Table.from_pylist([row], table.select([*row]).schema)

    def last(batches):
        for batch in batches:
            found = [cg.finish(unpack(c, a)) for c, a in zip(batch["costs"].to_pylist(), batch["audits"].to_pylist())]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in ("conv_id", *FACT_NAMES)], pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], ["conv_id", *FACT_NAMES, "cost", "audit"])

    out = parts.where("whole").mapInArrow(whole, out_schema)
    in_order = Window.partitionBy("conv_id").orderBy("place", "at")
    rest = written(parts.where("NOT whole").withColumn("idx", (F.row_number().over(in_order) - 1).cast("long")).mapInArrow(part, matrix_schema), "chat-matrices")
    while (rest.agg(F.max("idx")).first()[0] or 0) > 0:
        rest = written(rest.groupBy("conv_id", F.floor(F.col("idx") / fan).alias("group")).applyInArrow(neighbours, matrix_schema), "chat-matrices")
    return out.unionByName(rest.mapInArrow(last, out_schema))


def edited(audit: str, rows):
    """(role, text, edit) of the repaired rows, from the audit and the rows in order, one at a time."""
    role, rows = None, iter(rows)
    for edit in audit:
        row = next(rows) if edit != "I" else None
        if edit == "D":
            continue
        role = row[0] if edit == "K" else "assistant" if role is not None and role[:1] == "u" else "user"
        yield role, "" if row is None else row[1], edit


SUMMARY = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def conversations_in_order(rows: DataFrame, answers: DataFrame, run, schema: str) -> DataFrame:
    """``run`` gets an iterator of (conv_id, summary, rows in order) for each task; each conversation must be read before the next."""
    gaps = F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns"))
    heads = answers.select(
        "conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(1).cast("long").alias("copies"),
        F.struct(gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit").alias("summary"),
    )
    body = rows.where("copies > 0").select("conv_id", F.lit(1).alias("kind"), "turn", digest().alias("digest"), "role", "text", "copies", F.lit(None).cast(heads.schema["summary"].dataType).alias("summary"))
    order = ["conv_id", "kind", "turn", "digest"]

    def task(batches):
        def flat():
            for batch in batches:
                yield from zip(*[batch[c].to_pylist() for c in ("conv_id", "kind", "role", "text", "copies", "summary")])

        stream = flat()
        ahead = [next(stream, None)]

        def own():
            while ahead[0] is not None and ahead[0][1] == 1:
                _, _, role, text, copies, _ = ahead[0]
                for _ in range(copies):
                    yield role, text
                ahead[0] = next(stream, None)

        def each():
            while ahead[0] is not None:
                conv, _, _, _, _, summary = ahead[0]
                ahead[0] = next(stream, None)
                rows_left = own()
                yield conv, summary, rows_left
                for _ in rows_left:
                    pass

        yield from run(each())

    return heads.unionByName(body).repartition("conv_id").sortWithinPartitions(*order).mapInArrow(task, schema)


def answered(rows: DataFrame) -> DataFrame:
    parts = segments(slim(rows))
    return written(solved(parts, cg.repair_pairs(parts.groupBy("symbols").count())), "chat-answers")


def summaries(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation in ``rows`` (as of ``plain`` or ``damaged``).

    Rows of one turn are ordered by the digest of role and text, null turns come first. A conversation whose rows all have copies = 0
    gives zeros and an empty audit. Null ids are one conversation. Equal rows count as often as they come; an empty table gives none.
    """
    kind, id_type = rows.schema["conv_id"].dataType.simpleString(), to_arrow_type(rows.schema["conv_id"].dataType)

    def run(conversations):
        held = []
        for conv, s, own in conversations:
            sha, between = hashlib.sha256(), b""
            for role, text, _ in edited(s["audit"], own):
                sha.update(between + f"{role}:{text}".encode())
                between = b"\n"
            held.append({"conv_id": conv, **s, "repaired_sha256": sha.hexdigest()})
            if len(held) >= ROWS_OUT:
                yield out_batch(held, id_type)
                held = []
        if held:
            yield out_batch(held, id_type)

    return conversations_in_order(rows, answered(rows), run, f"conv_id {kind}, {SUMMARY}, repaired_sha256 string")


def out_batch(held: list, id_type) -> pa.RecordBatch:
    ids = pa.array([h["conv_id"] for h in held], id_type)
    names = [x.split()[0] for x in SUMMARY.split(", ")]
    return pa.RecordBatch.from_arrays(
        [ids, *[pa.array([h[c] for h in held], pa.string() if c == "audit" else pa.int64()) for c in names], pa.array([h["repaired_sha256"] for h in held], pa.string())], ["conv_id", *names, "repaired_sha256"]
    )


def repair(rows: DataFrame) -> DataFrame:
    """The repaired rows: conv_id, position, role, text and edit (K kept, R role changed, I inserted). Conversations left without rows have none."""
    kind, id_type = rows.schema["conv_id"].dataType.simpleString(), to_arrow_type(rows.schema["conv_id"].dataType)

    def run(conversations):
        held = []
        for conv, s, own in conversations:
            for k, (role, text, edit) in enumerate(edited(s["audit"], own)):
                held.append((conv, k, role, text, edit))
                if len(held) >= ROWS_OUT:
                    yield rows_batch(held, id_type)
                    held = []
        if held:
            yield rows_batch(held, id_type)

    return conversations_in_order(rows, answered(rows), run, f"conv_id {kind}, position bigint, role string, text string, edit string")


def rows_batch(held: list, id_type) -> pa.RecordBatch:
    kinds = (id_type, pa.int64(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), kinds)], ["conv_id", "position", "role", "text", "edit"])
