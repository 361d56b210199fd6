"""Secrets in texts, also under nested encodings.

A worklist holds layers of a text: the text itself, and what its URL, Unicode, base64 and compressed
parts decode to, until nothing new decodes. A layer that was seen before at the same place is not opened
again, so cycles end. Each layer is scanned anew, and what is found is mapped to the span in the text itself.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tableferry.llm.tables import named, steps

# The kinds in their order, their patterns and least lengths.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

_URL = re.compile(r"%[0-7][0-9A-Fa-f]|(?:%[89A-Fa-f][0-9A-Fa-f])+")
_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: Runs broken into lines; each line after the first holds nothing else.
_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]+(?![^\s=]))+={0,2}")
_MAGIC = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00")
#: The first bytes of compressed data: gzip, zlib, bzip2, xz.
_UNPACK: tuple[tuple[bytes, Callable[[], object]], ...] = (
    (b"\x1f\x8b", lambda: zlib.decompressobj(31)),
    (b"\x78\x01", zlib.decompressobj), (b"\x78\x5e", zlib.decompressobj),
    (b"\x78\x9c", zlib.decompressobj), (b"\x78\xda", zlib.decompressobj),
    (b"BZh", bz2.BZ2Decompressor), (b"\xfd7zXZ\x00", lzma.LZMADecompressor),
)
#: Compressed data that unpacks to more bytes a member than this isn't opened but counted as `unopened`.
LAYER_BYTES = 16 << 20

Span = tuple[int, int, int]  # start, number of the kind, end


def scan(text: str) -> list[Span]:
    """Leftmost matches of each kind that don't overlap, without those that are too short."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return found


def _views(data: bytes) -> Iterator[str]:
    """`data` as text: UTF-8 or else Latin-1, which keeps all that is ASCII; without zeros too, for UTF-16."""
    try:
        yield data.decode("utf-8")
    except UnicodeDecodeError:
        yield data.decode("latin-1")
    if b"\0" in data:
        yield data.replace(b"\0", b"").decode("latin-1")


def _inflated(data: bytes, at: int) -> tuple[bytes | None, int]:
    """What the compressed members from `at` on hold and where the last whole one ends; None if the first is too large."""
    members, left = [], LAYER_BYTES
    while opener := next((o for magic, o in _UNPACK if data.startswith(magic, at)), None):
        tool, pos, size, member = opener(), at, 256, []
        try:
            while pos < len(data) and not tool.eof and left >= 0:
                piece = data[pos : pos + size]
                member.append(tool.decompress(piece, left + 1))
                left -= len(member[-1])
                pos += len(piece) - len(tool.unused_data)
                size = min(2 * size, 1 << 16)
        except (zlib.error, lzma.LZMAError, OSError, EOFError, ValueError):
            pass  # Damaged data counts as far as it went.
        if left < 0:
            return b"".join(members) if members else None, at
        members += member
        if not tool.eof:
            break
        at = pos
    return b"".join(members), at


def _unpack(data: bytes) -> Iterator[tuple[str | None, bool]]:
    """Texts of plain bytes and of compressed data anywhere in them; None and True for what is too large to open.

    Compressed data in compressed data is opened however deep it is; bytes that were seen before are not opened again.
    """
    work, seen = [data], set()
    while work:
        data, at, plain = work.pop(), 0, 0
        mark = hashlib.blake2b(data, digest_size=16).digest()
        if mark in seen:
            continue
        seen.add(mark)
        while m := _MAGIC.search(data, at):
            inner, end = _inflated(data, m.start())
            if inner is None:
                yield None, True
            elif inner:
                work.append(inner)
            at = m.start() + 1
            if end > m.start():
                # Only whole members are left out of what is read as it is.
                yield from ((t, False) for t in _views(data[plain : m.start()]))
                at = plain = end
        yield from ((t, False) for t in _views(data[plain:]))


def _decoded(token: str) -> Iterator[tuple[str | None, bool]]:
    """What a run of base64 characters holds, wherever in its first four the data begins."""
    core = token.rstrip("=").replace("-", "+").replace("_", "/")
    for start in range(4):
        size = len(core) - start
        part = core[start : len(core) - (size % 4 == 1)]
        yield from _unpack(base64.b64decode(part + "=" * (-len(part) % 4)))


class Layer:
    """A text and where its characters come from: `edges` are (start here, start there, end there, exact)."""

    def __init__(self, text: str, edges: list[tuple[int, int, int, bool]]):
        self.text, self.edges = text, edges
        self.starts = [e[0] for e in edges]

    def origin(self, start: int, end: int) -> tuple[int, int]:
        """The span in the text itself that holds the characters start to end of this layer."""
        from bisect import bisect_right

        first, last = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        here, there, _, exact = self.edges[first]
        begin = there + start - here if exact else there
        here, there, stop, exact = self.edges[last]
        return begin, (there + end - here if exact else stop)

    def mark(self) -> bytes:
        """A digest of the characters and where they come from.

        In a layer of several edges these are the starts, and pieces of one encoded part count as one: a part read
        with and without its padding decodes to the same further layers.
        """
        places = [e[1:3] for e in self.edges]
        if len(self.edges) > 1:
            places = [e[:2] for k, e in enumerate(self.edges) if not k or e[3] or e[1:] != self.edges[k - 1][1:]]
        return hashlib.blake2b(f"{places}\0{self.text}".encode("utf-8", "replace"), digest_size=16).digest()

    def replaced(self, parts: list[tuple[int, int, str]]) -> Layer:
        """The layer with the given spans decoded; the rest keeps its characters."""
        text, edges, at, size = [], [], 0, 0
        for start, end, new in [*parts, (len(self.text), len(self.text), "")]:
            if at < start:
                for here, there, stop, exact in self._edges(at, start):
                    edges.append((size + here - at, there, stop, exact))
                text.append(self.text[at:start])
                size += start - at
            if new:
                edges.append((size, *self.origin(start, end), False))
                text.append(new)
                size += len(new)
            at = end
        return Layer("".join(text), edges)

    def _edges(self, start: int, end: int) -> Iterator[tuple[int, int, int, bool]]:
        for k, (here, there, stop, exact) in enumerate(self.edges):
            until = self.starts[k + 1] if k + 1 < len(self.starts) else len(self.text)
            if until <= start or here >= end:
                continue
            begin = max(here, start)
            yield begin, (there + begin - here if exact else there), stop, exact


def _escaped(m: re.Match) -> str:
    digits = next(k for k, g in enumerate(m.groups()) if g is not None)
    code = int(m.group(digits + 1), 10 if digits == 5 else 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else ""


def _layers(layer: Layer) -> Iterator[tuple[Layer | None, bool]]:
    """What one more decoding of a layer gives; None and True for a part too large to open."""
    text = layer.text
    if "%" in text:
        parts = [(m.start(), m.end(), d) for m in _URL.finditer(text) if (d := unquote(m.group(), errors="replace"))]
        if parts:
            yield layer.replaced(parts), False
    if "\\" in text or "&#" in text:
        parts = [(m.start(), m.end(), d) for m in _ESCAPE.finditer(text) if (d := _escaped(m))]
        if parts:
            yield layer.replaced(parts), False
    runs = [(m.start(), m.end(), m.group()) for m in _BASE64.finditer(text)]
    runs += [(m.start(), m.end(), "".join(m.group().split())) for m in _LINES.finditer(text)]
    for start, end, token in runs:
        for inner, large in _decoded(token):
            if inner:
                yield Layer(inner, [(0, *layer.origin(start, end), False)]), False
            elif large:
                yield None, True


def find(text: str) -> tuple[list[Span], list[Span], int]:
    """Spans in the text itself, spans of all layers, and the number of parts too large to open."""
    base = sorted(scan(text))
    every, unopened = set(base), 0
    if text:
        work = [Layer(text, [(0, 0, len(text), True)])]
        seen = {work[0].mark()}
        while work:
            for inner, large in _layers(work.pop()):
                if inner is None:
                    unopened += large
                    continue
                mark = inner.mark()
                if mark in seen:
                    continue
                seen.add(mark)
                for start, kind, end in scan(inner.text):
                    begin, stop = inner.origin(start, end)
                    every.add((begin, kind, stop))
                work.append(inner)
    return base, sorted(every), unopened


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans, unopened) of every row; spans are (kind, start, end), end exclusive.

    `base` are those of the text itself, `spans` also those of its decoded layers, both ordered by
    start, then kind. A part found under URL or Unicode escapes has the span it takes in the text; one
    under base64 or compression has the span of the whole encoded part. A null text counts as empty.
    """
    source = named(docs, doc_id=id_col, text=text_col)
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([
        source.schema[0], T.StructField("base", T.ArrayType(span)), T.StructField("spans", T.ArrayType(span)),
        T.StructField("unopened", T.IntegerType()),
    ])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def rows(spans: list[Span]) -> list[dict]:
        return [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            found = [find(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([rows(f[0]) for f in found], kind), pa.array([rows(f[1]) for f in found], kind),
                 pa.array([f[2] for f in found], pa.int32())],
                ["doc_id", "base", "spans", "unopened"],
            )

    return source.mapInArrow(run, schema)
