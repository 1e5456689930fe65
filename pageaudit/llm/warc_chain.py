"""WARC files: writing with revisit records, and reading back by boundary chains.

Reading: a file is cut into byte ranges. Each task looks for record magic in its range, parses the
header there and notes, for every candidate, the offset of its successor (header, length and the closing
line ends). A candidate may be a payload that looks like a record. Within a range the offsets are followed until they leave it,
so a candidate points at a candidate of a later range; pointer jumping from the file start, which doubles the
pointers in every round, then finds the one entry of each range that is reachable. Only records on the chain from there are read.
"""

import hashlib
import re
import uuid
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageaudit.llm.token_pack import open_folder
from pageaudit.session import scratch_path, written

MAGIC = b"WARC/1.1\r\n"
CLOSE = b"\r\n\r\n"
#: Equal payloads of at least as many bytes are stored once.
REVISIT_BYTES = 1000
#: Bytes of a file that one task looks through; bytes read for a header first (a longer one is read on).
RANGE_BYTES, HEADER_BYTES = 8 << 20, 64 << 10
#: Tasks of a reading pass; beyond that a task reads several ranges.
MOST_TASKS = 100_000
#: Types of the records that are read back.
PAGES = ("response", "revisit")
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def decide(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """id, url, payload, digest, size and refers_to (null for responses).

    Only digests are grouped. Those that occur more than once are written as a table of their own, so that the join
    with the pages starts from two exchanges and a digest that many pages share can be split. Rows with the largest id of their payload
    stay responses, repeated ones too; without any id nothing is a revisit. A null payload is empty.
    """
    body = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    slim = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("payload"))
    digest = F.sha1("payload")
    shared = written(
        slim.where((F.octet_length("payload") >= least)).select("id", digest.alias("digest"))
        .groupBy("digest").agg(F.max("id").alias("first_id"), F.count("*").alias("n")).where("n > 1 AND first_id IS NOT NULL").drop("n"),
        "warc-shared",
    )
    return (
        slim.withColumn("digest", digest).withColumn("size", F.octet_length("payload").cast("long"))
        .join(shared, "digest", "left")
        .select("id", "url", "payload", "digest", "size", F.when(~F.col("first_id").eqNullSafe(F.col("id")), F.col("first_id")).alias("refers_to"))
    )


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))])
    return MAGIC + lines.encode() + b"\r\n" + block + CLOSE


def target(url: str | None) -> list[tuple[str, str]]:
    """The address as a header field, with white space and control characters escaped; none for null."""
    return [] if url is None else [("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url))]


def write_archives(pages: DataFrame, folder: str | None = None, date: str = "2024-01-01T00:00:00Z", **columns) -> DataFrame:
    """One record per row, one file per task in a shared folder; returns the table of files (file, bytes, records).

    The table is committed by Spark and names the files of the successful attempts only. An empty table writes none.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")

    def run(batches):
        system, base = open_folder(folder)
        out, at, n = None, 0, 0
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                if out is None:
                    system.create_dir(base, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc"
                    out = system.open_output_stream(f"{base}/{name}")
                    at = out.write(record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                own = [] if row["id"] is None else [("WARC-Record-ID", f"<urn:page:{row['id']}>")]
                fields = [*own, ("WARC-Date", date), *target(row["url"]), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{row['digest']}")]
                if row["refers_to"] is None:
                    at += out.write(record("response", fields, HTTP % row["size"] + row["payload"]))
                else:
                    more = [("WARC-Refers-To", f"<urn:page:{row['refers_to']}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
                    at += out.write(record("revisit", fields + more, HTTP % row["size"]))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "bytes": [at], "records": [n]})

    schema = "file string, bytes bigint, records bigint"
    decide(pages, **columns).mapInArrow(run, schema).write.parquet(f"{folder}/files")
    return pages.sparkSession.read.schema(schema).parquet(f"{folder}/files")


def parse_header(raw: bytes) -> tuple[dict, int] | None:
    """Fields of a record header (names in lower case) and where its block starts; None if it is none."""
    end = raw.find(CLOSE)
    if not raw.startswith(MAGIC) or end < 0:
        return None
    fields = {}
    for line in raw[len(MAGIC) : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    size = fields.get("content-length", "")
    return (fields, end + len(CLOSE)) if re.fullmatch("[0-9]{1,18}", size) else None


def header_at(source, at: int, held: bytes = b"", base: int = 0) -> tuple[dict, int, int] | None:
    """Fields, offset of the block and offset of the successor, from the bytes held where they reach; reads on where the header needs it.

    A header may be of any length: pieces of doubled size are read until its end, the file's end or a line that is no field.
    """
    raw, piece = held[at - base : at - base + HEADER_BYTES] if held else b"", HEADER_BYTES
    while CLOSE not in raw:
        if raw and not raw.startswith(MAGIC[: len(raw)]) or any(b":" not in x for x in raw.split(b"\r\n")[1:-1]) or at + len(raw) >= source.size():
            return None
        source.seek(at + len(raw))
        raw, piece = raw + source.read(piece), 2 * piece
    found = parse_header(raw)
    if found is None:
        return None
    fields, start = found
    return fields, at + start, at + start + int(fields["content-length"]) + len(CLOSE)


def ranges(files: DataFrame, step: int) -> DataFrame:
    """file, size, and start of each byte range; a file without bytes has none."""
    return files.where("bytes > 0").select(
        "file", F.col("bytes").alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(step).cast("long"))).alias("start")
    )


def tasks_for(files: DataFrame, step: int) -> int:
    """A task for each ``step`` bytes, about. Rows that stand for bytes are tiny, so Spark would put them all in one task."""
    return max(1, min(MOST_TASKS, -(-int(files.agg(F.sum("bytes")).first()[0] or 0) // step)))


def candidates(files: DataFrame, step: int = RANGE_BYTES) -> DataFrame:
    """file, at (offset of a candidate), next (the first offset on its chain beyond its range; null past a broken link or the end)
    and n (responses and revisits on the chain before that)."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                system, path = open_folder(row["file"])
                with system.open_input_file(path) as source:
                    stop = min(row["start"] + step, row["size"])
                    source.seek(row["start"])
                    held = source.read(min(step + HEADER_BYTES, row["size"] - row["start"]))
                    jump, n = {}, {}
                    at = held.find(MAGIC)
                    while 0 <= at < stop - row["start"]:
                        if found := header_at(source, row["start"] + at, held, row["start"]):
                            jump[row["start"] + at] = found[2]
                            n[row["start"] + at] = int(found[0].get("warc-type") in PAGES and found[2] <= row["size"])
                        at = held.find(MAGIC, at + 1)
                for at in sorted(jump, reverse=True):  # later candidates of the range are settled first
                    after = jump[at]
                    n[at] += n.get(after, 0)
                    jump[at] = jump.get(after) if after < stop else after if after < row["size"] else None
                yield pa.RecordBatch.from_pydict({
                    "file": pa.array([row["file"]] * len(jump), pa.string()), "at": pa.array(list(jump), pa.int64()), "next": pa.array(list(jump.values()), pa.int64()),
                    "n": pa.array([n[at] for at in jump], pa.int64()),
                })

    return ranges(files, step).repartition(tasks_for(files, step), "file", "start").mapInArrow(run, "file string, at bigint, next bigint, n bigint")


def entries(files: DataFrame, step: int = RANGE_BYTES) -> DataFrame:
    """file and at: the offsets at which the chain from the file start enters a range, found by pointer jumping.

    Fails if the chain of a file holds fewer records than ``files`` names.
    """
    pointers = nodes = written(candidates(files, step), "warc-pointers")
    reached = written(pointers.where("at = 0").select("file", "at"), "warc-reached")
    known = reached.count()
    while True:
        hop = pointers.withColumnRenamed("next", "to").where("to IS NOT NULL")
        reached = written(
            reached.unionByName(reached.join(hop, ["file", "at"]).select("file", F.col("to").alias("at"))).distinct(), "warc-reached"
        )
        now = reached.count()
        if now == known:
            break
        known = now
        onward = pointers.select("file", F.col("at").alias("to"), F.col("next").alias("beyond"))
        pointers = written(hop.join(onward, ["file", "to"], "left").select("file", "at", F.col("beyond").alias("next")), "warc-pointers")
    # an offset that holds no record (a broken file) ends the chain there
    entered = written(reached.join(nodes.select("file", "at", "n").distinct(), ["file", "at"]), "warc-entries")
    found = files.join(entered.groupBy("file").agg(F.sum("n").alias("found")), "file", "left").fillna(0, ["found"])
    if short := found.where("found < records").select("file", "found", "records").take(5):
        raise ValueError("fewer records than the table of files names: " + ", ".join(f"{r['file']} {r['found']} of {r['records']}" for r in short))
    return entered.select("file", "at")


def read_archives(files: DataFrame, step: int = RANGE_BYTES) -> DataFrame:
    """Records on the chain from each file's start: file, offset, record_type, record_id, refers_to, url, payload_digest, payload_bytes, payload, intact.

    Records that only look like such inside a payload are never reached. ``intact`` says whether the payload has the digest that
    the header gives (null for revisits, whose size and digest are those that the header gives). A cut-off last record is left out;
    it is an error if fewer records are reached than ``files`` names.
    """
    def records(row, source):
        at, size = row["at"], source.size()
        stop = min((at // step + 1) * step, size)
        while at < stop:
            found = header_at(source, at)
            if found is None or found[2] > size:
                return
            fields, block, at_next = found
            if fields.get("warc-type") in PAGES:
                source.seek(block)
                http, _, payload = source.read(at_next - len(CLOSE) - block).partition(CLOSE)
                digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                length = re.search(rb"(?im)^content-length: *([0-9]{1,18})", http)
                revisit = fields["warc-type"] == "revisit"
                actual = hashlib.sha1(payload).hexdigest()
                yield {
                    "file": row["file"], "offset": at, "record_type": fields["warc-type"], "record_id": fields.get("warc-record-id"),
                    "refers_to": fields.get("warc-refers-to"), "url": fields.get("warc-target-uri"), "payload_digest": digest if revisit else actual,
                    "payload_bytes": int(length[1]) if revisit and length else len(payload), "payload": None if revisit else payload,
                    "intact": None if revisit else actual == digest,
                }
            at = at_next

    def run(batches):
        held, weight = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                system, path = open_folder(row["file"])
                with system.open_input_file(path) as source:
                    for r in records(row, source):
                        held.append(r)
                        weight += 1000 + len(r["payload"] or b"") + len(r["url"] or "")
                        if weight > 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, weight = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    schema = pa.schema([
        ("file", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()),
        ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("intact", pa.bool_()),
    ])
    out = "file string, offset bigint, record_type string, record_id string, refers_to string, url string, payload_digest string, payload_bytes bigint, payload binary, intact boolean"
    return entries(files, step).repartition(tasks_for(files, step), "file", "at").mapInArrow(run, out)


def page_id(urn: Column) -> Column:
    """The page id in ``<urn:page:...>``, as a long; null for any other name."""
    return F.regexp_extract(urn, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
