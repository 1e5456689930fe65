"""Secret scans with structural confirmation.

Patterns propose candidates; a span is reported beside the plain ones only after its structure has been
read: signed-token headers are decoded and parsed as JSON, key blocks and free base64 or hex are decoded and must
hold nested DER lengths that fit exactly, SSH keys must hold length-prefixed fields. Line breaks may be written as escapes;
base64 may be URL-safe or wrapped over lines, hex may have capitals.
"""

import base64
import binascii
import bisect
import json
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageaudit.llm import textbatch as tb

# Fixed values of the contract: patterns and least lengths of the plain kinds.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ASSIGN_MIN = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # 18 characters and more
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
#: Kinds in the order in which spans with the same start are listed.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "jwt", "pem", "ssh", "der")

#: A header begins with an opening brace or with white space; the shortest that names an algorithm has 14 letters.
SIGNED = re.compile(r"(?<![A-Za-z0-9_-])(?=e[wy]|[CDI][A-Za-z])[A-Za-z0-9_-]{12,}+\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*")
BLOCK = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
END = re.compile(r"-----END ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
OPENSSH = b"openssh-key-v1\0"
BLOB = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}={0,2}")
URL_BLOB = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9_-]{40,}={0,2}")
#: Base64 over several lines, from a letter with which DER or an SSH key begins.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[MAb][A-Za-z0-9+/_-]{39,}+(?:[\x20\t]*+\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++)++={0,2}")
LETTER = re.compile(r"[A-Za-z0-9+/_-]")
CAPITAL_HEX = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{30,}")
ESCAPED = re.compile(r"\\+[rn]")
#: A text in which this finds nothing has no candidate of any kind.
ANY = r"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{16}|[0-9A-Fa-f]{32}|[A-Za-z0-9_-]{12}\.[A-Za-z0-9_-]|-----BEGIN|[A-Za-z0-9+/_-]{40}"


def der_members(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """Tag, start and end of each member between two positions; None unless their lengths fill the space exactly."""
    out = []
    while at < end:
        if end - at < 2:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size >= 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at + size > end:
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def der_fits(data: bytes, least: int = 16) -> bool:
    """One DER sequence that fills the bytes, with two members or more; every sequence or set inside is filled exactly by its own."""
    top = der_members(data, 0, len(data)) if len(data) >= least and data[0] == 0x30 else None
    if not top or len(top) != 1:
        return False
    todo, found = [top[0][1:]], 0
    while todo:
        inside = der_members(data, *todo.pop())
        if not inside:
            return False
        found += len(inside)
        todo += [(a, b) for tag, a, b in inside if tag in (0x30, 0x31) and b > a]
    return found >= 2


def ssh_fields(data: bytes, at: int = 0, count: int | None = None) -> tuple[list[bytes], int] | None:
    """``count`` length-prefixed fields from ``at`` (without it, all up to the end) and where they end, or None if a length does not fit."""
    fields = []
    while len(fields) < count if count is not None else at < len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        fields.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return fields, at


def ssh_public(data: bytes) -> bool:
    """Fields that fill the bytes, two or more, the first naming a key type."""
    found = ssh_fields(data)
    return found is not None and len(found[0]) >= 2 and re.match(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]+$", found[0][0]) is not None


def ssh_fits(data: bytes) -> bool:
    """A public key, or an OpenSSH container: cipher, derivation and its options, a count, as many public keys, and the private part to the end."""
    if not data.startswith(OPENSSH):
        return ssh_public(data)
    head = ssh_fields(data, len(OPENSSH), 3)
    if not head or len(data) < head[1] + 4:
        return False
    keys = int.from_bytes(data[head[1] : head[1] + 4], "big")
    if not 1 <= keys <= len(data) // 4:
        return False
    rest = ssh_fields(data, head[1] + 4, keys + 1)
    return rest is not None and rest[1] == len(data) and all(map(ssh_public, rest[0][:-1])) and len(rest[0][-1]) >= 8


def from_base64(text: str) -> bytes | None:
    """The decoded bytes, or None; missing padding is made up for. Both alphabets are read."""
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def signed_token(text: str) -> bool:
    """Three base64url parts whose first is a JSON object that names an algorithm and whose second is a JSON object."""
    def part(x):
        try:
            return json.loads(base64.urlsafe_b64decode(x + "=" * (-len(x) % 4)))
        except (ValueError, RecursionError):
            return None

    header, body, _ = text.split(".")
    header = part(header)
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(part(body), dict)


def wrapped(text: str, start: int, end: int) -> tuple[int, int, str] | None:
    """The span of a structure whose base64 goes over several lines: DER as far as its length says, else a whole SSH key."""
    places = [m.start() for m in LETTER.finditer(text, start, end)]
    head = from_base64("".join(text[k] for k in places[:8]))
    if head[0] == 0x30:
        more = head[1] & 0x7F if head[1] >= 0x80 else 0
        size = 2 + more + (int.from_bytes(head[2 : 2 + more], "big") if more else head[1])
        n = (4 * size + 2) // 3
        if more <= 4 and n <= len(places) and not LETTER.match(text, places[n - 1] + 1):
            data = from_base64("".join(text[k] for k in places[:n]))
            if data and der_fits(data):
                return start, re.compile("={0,2}").match(text, places[n - 1] + 1).end(), "der"
    for stop in (end, start + len(text[start:end].rsplit(None, 1)[0])):  # the last word may be of another line
        data = from_base64("".join(text[start:stop].split()))
        if data and ssh_fits(data):
            return start, stop, "ssh"
    return None


def confirmed(text: str, hexes: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """The spans whose structure holds. Candidates that fail are dropped. Escaped line breaks are read as breaks; places are those of the text."""
    out, taken = [], []
    text = ESCAPED.sub(lambda m: "\n".rjust(len(m[0])), text)
    for m in SIGNED.finditer(text):
        if signed_token(m[0]):
            out.append((m.start(), m.end(), "jwt"))
    blocks, ends = list(BLOCK.finditer(text)), {}
    if blocks:
        for e in END.finditer(text):
            ends.setdefault(e[1], []).append((e.start(), e.end()))
    following = [m.start() for m in blocks[1:]] + [len(text)]
    for m, following_block in zip(blocks, following):
        marks = ends.get(m[1], [])
        k = bisect.bisect_left(marks, (m.end(),))
        # a block that holds another one's first line is not whole
        if k < len(marks) and marks[k][0] <= following_block and (not taken or m.start() >= taken[-1][1]):
            start, end = marks[k]
            lines = [x for x in text[m.end() : start].split() if ":" not in x and "," not in x]
            data = from_base64("".join(lines))
            if data and (der_fits(data) or ssh_fits(data) or "ENCRYPTED" in text[m.start() : start]):
                out.append((m.start(), end, "pem"))
                taken.append((m.start(), end))

    def is_taken(place):  # blocks are in order and apart
        k = bisect.bisect_right(taken, (place, len(text) + 1)) - 1
        return k >= 0 and place < taken[k][1]

    for m in [*BLOB.finditer(text), *URL_BLOB.finditer(text)]:
        if is_taken(m.start()):
            continue
        data = from_base64(m[0])
        if data and ssh_fits(data):
            out.append((m.start(), m.end(), "ssh"))
        elif data and der_fits(data):
            out.append((m.start(), m.end(), "der"))
    for m in WRAPPED.finditer(text):
        if not is_taken(m.start()) and (span := wrapped(text, *m.span())):
            out.append(span)
    for a, b in [*hexes, *(m.span() for m in CAPITAL_HEX.finditer(text))]:
        if (b - a) % 2 == 0 and text.startswith("30", a) and der_fits(bytes.fromhex(text[a:b])):
            out.append((a, b, "der"))
    return out


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then kind in the order of KINDS."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    hexes = [m.span() for m in HEX.finditer(text)]
    found += [(a, b, "hex") for a, b in hexes]
    found += confirmed(text, hexes)
    return sorted(set(found), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and ``spans`` (array of kind, start, end; by start, then kind), one row per input row.

    Null and empty texts and texts without a candidate have no spans. Texts are read whole; one quick pass
    over the batch leaves out those that cannot hold a candidate. Repeated rows are each scanned; other columns are not read; an empty
    table gives an empty result.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in tb.slices(batches, "text"):
            texts = batch.column("text")
            may = pc.fill_null(pc.match_substring_regex(texts, ANY), False).to_pylist()
            spans = [[{"kind": k, "start": a, "end": b} for a, b, k in scan(t.as_py())] if x else [] for t, x in zip(texts, may)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(spans, kind)], ["id", "spans"])

    of = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {of}, spans array<struct<kind: string, start: int, end: int>>").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "<SECRET>") -> DataFrame:
    """All columns of ``docs``, with every found span of the text replaced by ``mark``; overlapping spans become one mark.

    One row per input row, repeated rows too. Null texts stay null, empty ones and those without a span stay as they are; an empty
    table gives an empty result.
    """
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        for batch in tb.slices(batches, text_col):
            texts = batch.column(at)
            may = pc.fill_null(pc.match_substring_regex(texts, ANY), False).to_pylist()
            new = [cover(t.as_py(), scan(t.as_py()), mark) if x else t.as_py() for t, x in zip(texts, may)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, texts.type))

    return docs.mapInArrow(run, docs.schema)


def cover(text: str, spans, mark: str) -> str:
    """The text with the union of the spans replaced by marks."""
    out, done = [], 0
    for a, b, *_ in sorted(spans):
        if a >= done:
            out += [text[done:a], mark]
        done = max(done, b)
    return "".join([*out, text[done:]])
