"""Secret scans with a recursive decoding worklist.

A text is scanned for three kinds of secrets. Its encoded parts (URL escapes, Unicode and
HTML escapes, base64, zlib and gzip within base64) are decoded to new layers, which are
scanned and searched for encoded parts again, until no layer is new: a layer that was seen
before is not entered again, which ends cycles. Each character of a layer knows its span in
the original text, so finds in any layer are reported there.

Edge cases: null and empty texts have no finds; any length is scanned whole; repeated rows
get a row each; an empty table gives an empty result; extra columns are ignored (kept, by
`redact`). Compressed parts are inflated until nothing changes; what is longer than `GROWTH`
bytes is scanned in blocks that share `SHARED` characters. Base64 may be wrapped by lines.
"""

from __future__ import annotations

import base64
import binascii
import codecs
import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolake.llm.common import map_arrow, row_slices, slices

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # greedy, so the same as dropping shorter runs
ESCAPED = re.compile(r"(?:%[0-9A-Fa-f]{2})+|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{18,}={0,2}")
LEAST = 20  # characters of a base64 part, with its padding
NEXT_LINE = re.compile(r"[\x20\t]*\r?\n[\x20\t]*([A-Za-z0-9+/_-]+={0,2})")
GROWTH = 1 << 24
#: Characters that a block of a long stream shares with the one before.
SHARED = 1 << 16

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8] if "=" in text or ":" in text else []
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


class Layer:
    """Decoded text; `starts` and `ends` hold each character's span in the original text."""

    def __init__(self, text: str, starts: np.ndarray, ends: np.ndarray):
        self.text, self.starts, self.ends = text, starts, ends

    def origin(self, a: int, b: int) -> tuple[int, int]:
        return int(self.starts[a:b].min()), int(self.ends[a:b].max())


def decoded_run(match: str) -> str | None:
    """The text of one run of escapes; None if it is no text."""
    if match[0] == "%":
        try:
            return bytes.fromhex(match.replace("%", "")).decode("utf-8")
        except UnicodeDecodeError:
            return None
    code = int(match[2:], 16) if match[0] == "\\" else int(match[3:-1], 16) if match[2] in "xX" else int(match[2:-1])
    return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def unescaped(layer: Layer) -> Layer | None:
    """One step of URL, Unicode and HTML unescaping of a whole layer."""
    text, parts, starts, ends, at = layer.text, [], [], [], 0
    for m in ESCAPED.finditer(text):
        value = decoded_run(m[0])
        if value is None:
            continue
        parts += [text[at : m.start()], value]
        starts += [layer.starts[at : m.start()]]
        ends += [layer.ends[at : m.start()]]
        if m[0][0] == "%":  # three characters a byte
            size = np.array([len(c.encode()) for c in value])
            last = m.start() + 3 * np.cumsum(size)
            starts.append(layer.starts[last - 3 * size])
            ends.append(layer.ends[last - 1])
        else:
            a, b = layer.origin(m.start(), m.end())
            starts.append(np.array([a]))
            ends.append(np.array([b]))
        at = m.end()
    if not parts:
        return None
    return Layer("".join(parts) + text[at:], np.concatenate([*starts, layer.starts[at:]]), np.concatenate([*ends, layer.ends[at:]]))


def inflated(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """What a zlib or gzip stream (or gzip members in a row) holds, in blocks of at most GROWTH bytes; ends where it is no such stream."""
    stream = zlib.decompressobj(47)
    try:
        for data in blocks:
            while data:
                out = stream.decompress(data, GROWTH)
                if out:
                    yield out
                data = stream.unconsumed_tail
                if stream.eof:
                    data = stream.unused_data
                    if data[:2] != b"\x1f\x8b":
                        return
                    stream = zlib.decompressobj(47)
        while not stream.eof and (out := stream.decompress(stream.unconsumed_tail, GROWTH)):
            yield out
    except zlib.error:
        return


def compressed(data: bytes) -> bool:
    return data[:2] == b"\x1f\x8b" or data[:1] == b"\x78" and len(data) > 2 and (data[0] * 256 + data[1]) % 31 == 0


def texts(blocks: Iterator[bytes]) -> Iterator[tuple[str, bool]]:
    """(readable text, whether it was compressed) of bytes, inflated until nothing changes; long texts in blocks that overlap."""
    seen: set[bytes] = set()
    head, depth = next(blocks, b""), 0
    while compressed(head) and head not in seen and not readable(head.decode("utf-8", "replace").replace("\ufffd", "\0")):
        seen.add(head)
        more = inflated(chain([head], blocks))
        first = next(more, None)
        if first is None:
            break
        head, blocks, depth = first, more, depth + 1
    decoder, before = codecs.getincrementaldecoder("utf-8")(), ""
    for data in chain([head], blocks):
        try:
            text = before + decoder.decode(data)
        except UnicodeDecodeError:
            return
        if readable(text):
            yield text, depth > 0
        before = text[-SHARED:]


def readable(text: str) -> bool:
    return bool(text) and sum(c.isprintable() or c in "\t\r\n" for c in text) >= 0.95 * len(text)


def base64_parts(text: str) -> Iterator[list[tuple[int, int]]]:
    """Candidates for base64, as runs (start, end) to be joined: each run, and runs that lines wrap.

    Of wrapped lines the last may be a word of the text, and the first the end of another
    part, so they are also tried without these.
    """
    end = -1
    for m in BASE64.finditer(text):
        if len(m[0]) >= LEAST:
            yield [m.span()]
        if m.start() < end:
            continue
        lines = [m.span()]
        while lines[-1][1] - lines[-1][0] >= LEAST and text[lines[-1][1] - 1] != "=" and (more := NEXT_LINE.match(text, lines[-1][1])):
            lines.append(more.span(1))
        end = lines[-1][1]
        for own in (lines[1:-1], lines[:-1], lines[1:], lines):  # the narrowest that gives a text counts
            if len(own) > 1:
                yield own


def unpacked(layer: Layer) -> Iterator[Layer]:
    """The readable layers in base64 parts, decompressed where they are compressed."""
    for lines in base64_parts(layer.text):
        part = "".join(layer.text[a:b] for a, b in lines)
        body = part.rstrip("=").replace("-", "+").replace("_", "/")
        if len(body) % 4 == 1:
            continue
        try:
            data = base64.b64decode(body + "=" * (-len(body) % 4))
        except binascii.Error:
            continue
        for text, packed in texts(iter([data])):
            if packed:
                a, b = layer.origin(lines[0][0], lines[-1][1])
                yield Layer(text, np.full(len(text), a), np.full(len(text), b))
                continue
            place = np.concatenate([np.arange(a, b) for a, b in lines])
            size = np.array([len(c.encode()) for c in text])
            last = np.cumsum(size)  # byte k comes from characters 4k/3 to 4k/3 + 1
            first, final = (last - size) * 4 // 3, np.minimum((last - 1) * 4 // 3 + 1, len(part) - 1)
            final[-1] = len(part) - 1  # with the padding
            yield Layer(text, layer.starts[place[first]], layer.ends[place[final]])


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), sorted by start, then kind."""
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = sorted(base_spans(text), key=order)
    if not BASE64.search(text) and not ESCAPED.search(text):
        return base, base
    found, seen = set(base), {text}
    worklist = [Layer(text, np.arange(len(text)), np.arange(1, len(text) + 1))]
    while worklist:
        layer = worklist.pop()
        plain = unescaped(layer)
        for more in ([plain] if plain else []) + list(unpacked(layer)):
            if more.text in seen:
                continue
            seen.add(more.text)
            worklist.append(more)
            found |= {(kind, *more.origin(a, b)) for kind, a, b in base_spans(more.text)}
    return base, sorted(found, key=order)


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex (base spans), base_sha256, spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, texts in slices(batch):
                found = [scan(t) for t in texts]
                counts = [[sum(s[0] == kind for s in base) for base, _ in found] for kind in KINDS]
                yield pa.record_batch([pa.array(x, t) for x, t in zip((keys, *counts, [hashlib.sha256(written(b).encode()).hexdigest() for b, _ in found], [written(a) for _, a in found]), [pa.int64()] * 4 + [pa.string()] * 2)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, schema)


def masked(text: str, spans: list[Span], mask: str) -> str:
    """text with the union of the spans replaced by `mask`."""
    out, at, end = [], 0, 0
    for _, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if a >= end:
            out += [text[at:a], mask]
        at = end = max(end, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, column: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with secrets in a text column masked; other columns as they are, null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in row_slices(batch)):
            at = part.schema.get_field_index(column)
            texts = [None if t is None else masked(t, scan(t)[1], mask) for t in part.column(at).to_pylist()]
            yield part.set_column(at, part.schema.field(at), pa.array(texts, pa.string()))

    return map_arrow(docs, run, docs.schema)
