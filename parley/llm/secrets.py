"""Secret scans through nested encodings.

A text is scanned, then unwrapped: percent escapes, Unicode escapes and entities, base64 runs
(over line ends too), bytes written as escapes, and compressed data or two-byte characters inside them.  Each result is a layer that is scanned and
unwrapped in turn, until nothing new comes up; a layer that came up before is
not taken again.  A base64 run is read from each of its first four characters,
and bytes that are no text as a whole give their readable runs and compressed
streams wherever these start.  Each layer carries, for every character, the place it comes
from in the original text, so what is found in it is reported there.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import io
import lzma
import re
import zlib
from collections import deque
from collections.abc import Iterator
from html.entities import html5

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that the layers of one document may unpack to and be held whole.  What is
#: beyond it is read in pieces that overlap, each a layer like any other, and counted
#: as unread: only a layer that is larger than a piece, inside of one that is too large, isn't unwrapped.
MOST_UNPACKED = 64 << 20
#: Such a piece, and how much of it is read again with the next.
PIECE, OVERLAP = 8 << 20, 1 << 20

#: Kinds in order, their patterns, and how long a match must be (group 2 for assign).
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_LEAST = 12
#: These take the same runs as the same classes with "+" and a length of 18 and 16.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2})|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]{1,6}\}|\\U[0-9a-fA-F]{8}|\\x[0-9a-fA-F]{2}|&#[0-9]{1,7};|&#[xX][0-9a-fA-F]{1,6};|&[A-Za-z][A-Za-z0-9]{1,31};")
#: Bytes as escapes, with the bytes between them that need none.
_PERCENT_BYTES = re.compile(r"(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~!*'()+-])+")
_SLASH_BYTES = re.compile(r"(?:\\x[0-9A-Fa-f]{2}|\\[abfnrtv0\\'\"]|[\x20-\x5b\x5d-\x7e])+")
_SLASHED = {"a": 7, "b": 8, "f": 12, "n": 10, "r": 13, "t": 9, "v": 11, "0": 0, "\\": 92, "'": 39, '"': 34}
#: Also over line ends, as mail and key files have it.
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:[\x20\t]*\r?\n[\x20\t>]*[A-Za-z0-9+/_-]{2,})*={0,2}")
_NOT_BASE64 = re.compile(r"[^A-Za-z0-9+/_-]+")


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the secrets in a text, leftmost non-overlapping for each kind, in order."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    out.sort()
    return out


class _Layer:
    """A text and, for each character, where it starts and ends in the original (None: it is the original)."""

    __slots__ = ("hi", "lo", "text")

    def __init__(self, text: str, lo: list[int] | None = None, hi: list[int] | None = None):
        self.text, self.lo, self.hi = text, lo, hi

    def span(self, s: int, e: int) -> tuple[int, int]:
        return (s, e) if self.lo is None else (min(self.lo[s:e]), max(self.hi[s:e]))


def _readable(raw: bytes) -> str | None:
    """The bytes as text, if that is what they are."""
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    odd = sum(1 for c in text if not (c.isprintable() or c in "\t\n\r"))
    return text if text and odd * 20 <= len(text) else None


#: Readable runs that could hold a secret or a layer: none is shorter than 16.
_RUN = re.compile(rb"(?:[\t\n\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){16,}")
#: The same in two bytes a character, either order.
_WIDE = re.compile(rb"(?P<le>(?:[\t\n\r\x20-\x7e]\x00){16,})|(?P<be>(?:\x00[\t\n\r\x20-\x7e]){16,})")
_MAGIC = re.compile(rb"(?P<gzip>\x1f\x8b\x08)|(?P<zlib>x[\x01\x5e\x9c\xda])|(?P<bz2>BZh[1-9])|(?P<xz>\xfd7zXZ\x00)|(?P<zstd>\x28\xb5\x2f\xfd)")
_READER = {"gzip": lambda: zlib.decompressobj(31), "zlib": zlib.decompressobj, "bz2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor}
_PIECE = 1 << 20
_SPACES = re.compile(rb"\x20{64,}")


def _unpacked(raw: bytes, at: int, kind: str) -> Iterator[bytes]:
    """Pieces of what the stream at ``at`` and those of its kind right behind it hold; returns where they end, if they end well."""
    try:
        if kind == "zstd":
            reader = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw[at:]), read_across_frames=True)
            while piece := reader.read(_PIECE):
                yield piece
            return len(raw)
        while True:
            d, data = _READER[kind](), raw[at:]
            while not d.eof:
                piece = d.decompress(data, _PIECE)
                data = getattr(d, "unconsumed_tail", b"")
                if piece:
                    yield piece
                elif not data and not d.eof:
                    return None  # cut short
            at = len(raw) - len(d.unused_data)
            m = _MAGIC.match(raw, at)
            if not m or m.lastgroup != kind:
                return at
    except (zlib.error, OSError, ValueError, EOFError, lzma.LZMAError, zstandard.ZstdError):
        return None


def _replaced(layer: _Layer, pieces: list[tuple[int, int, str]]) -> _Layer:
    """The layer with each (start, end) replaced by a text."""
    text, lo, hi, at = [], [], [], 0
    for s, e, new in [*pieces, (len(layer.text), len(layer.text), "")]:
        text.append(layer.text[at:s])
        if layer.lo is None:
            lo += range(at, s)
            hi += range(at + 1, s + 1)
        else:
            lo += layer.lo[at:s]
            hi += layer.hi[at:s]
        if new:
            a, b = layer.span(s, e)
            text.append(new)
            lo += [a] * len(new)
            hi += [b] * len(new)
        at = e
    return _Layer("".join(text), lo, hi)


def _escaped(token: str) -> str:
    if token[0] == "&" and token[1] != "#":
        return html5.get(token[1:], token)
    if token.startswith("&#"):
        code = int(token[3:-1], 16) if token[2] in "xX" else int(token[2:-1])
    elif len(token) == 12:  # a surrogate pair
        code = 0x10000 + ((int(token[2:6], 16) - 0xD800) << 10) + int(token[8:], 16) - 0xDC00
    else:
        code = int(token[2:].strip("{}"), 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"


class _Document:
    """The worklist of one text."""

    def __init__(self, text: str, most: int):
        self.left, self.unread = most, 0
        self.todo, self.seen = deque(), set()
        self.base = scan(text)
        self.found = set(self.base)
        self.put(_Layer(text))
        while self.todo:
            layer = self.todo.popleft()
            if layer.lo is not None:
                for s, kind, e in scan(layer.text):
                    a, b = layer.span(s, e)
                    self.found.add((a, kind, b))
            self.unwrap(layer)

    def put(self, layer: _Layer) -> None:
        mark = (layer.text, layer.lo and (layer.lo[0], layer.hi[-1]))
        if layer.text and mark not in self.seen:
            self.seen.add(mark)
            self.todo.append(layer)

    def bytes_in(self, layer: _Layer, s: int, e: int, raw: bytes, chars) -> None:
        """Layers of what characters s to e stand for; ``chars(j)``: those of byte j, or None for all."""
        left = [(raw, chars, s, e)]
        while left:
            raw, chars, s, e = left.pop()
            mark = (raw, layer.span(s, e))
            if mark in self.seen:
                continue
            self.seen.add(mark)
            text = _readable(raw)
            for at, t in [(0, text)] if text is not None else ((m.start(), m[0].decode("utf-8", "replace")) for m in _RUN.finditer(raw)):
                self.text_in(layer, s, e, t, at, chars)
            for m in _WIDE.finditer(raw):
                self.text_in(layer, s, e, m[0].replace(b"\0", b"").decode("ascii"), m.start(), chars, 2)
            m = _MAGIC.search(raw)
            while m:
                a = s if chars is None else s + chars(m.start())[0]
                out, end = self.read(_unpacked(raw, m.start(), m.lastgroup), layer, a, e)
                if out:
                    left.append((out, None, a, e if chars is None or not end else min(e, s + chars(end - 1)[1])))
                m = _MAGIC.search(raw, end or m.start() + 1)

    def read(self, pieces, layer: _Layer, s: int, e: int) -> tuple[bytes, int | None]:
        """A stream's bytes and its end; one too large is gone through in pieces and gives no bytes."""
        held, n, over = [], 0, False
        while True:
            piece, end = b"", None
            try:
                piece = next(pieces)
            except StopIteration as stop:
                end = stop.value
                if not over:
                    self.left -= n
                    return b"".join(held), end
            n += len(piece)
            held.append(piece)
            if n <= self.left and not over:
                continue
            if not over:
                over, self.unread = True, self.unread + 1
            if not piece or sum(map(len, held)) >= PIECE:
                own = _SPACES.sub(b" " * 64, b"".join(held))
                self.bytes_in(layer, s, e, own, None)
                held = [own[-OVERLAP:]]
            if not piece:
                return b"", end

    def text_in(self, layer: _Layer, s: int, e: int, text: str, at: int, chars, width: int = 0) -> None:
        """A layer of a text that starts at byte ``at`` of what characters s to e stand for; ``width``: bytes a character, 0: as in UTF-8."""
        if chars is not None:
            lo, hi, j = [], [], at
            for c in text:
                n = width or len(c.encode())
                a, b = layer.span(s + chars(j)[0], min(e, s + chars(j + n - 1)[1]))
                lo.append(a)
                hi.append(b)
                j += n
        else:
            a, b = layer.span(s, e)
            lo, hi = [a] * len(text), [b] * len(text)
        self.put(_Layer(text, lo, hi))

    def unwrap(self, layer: _Layer) -> None:
        text = layer.text
        if "%" in text:
            pieces = []
            for m in _PERCENT.finditer(text):
                raw = bytes.fromhex(m[0].replace("%", ""))
                at, pos = m.start(), 0
                while pos < len(raw):  # each character keeps a place of its own
                    n = 1 if raw[pos] < 0x80 else 2 if raw[pos] < 0xE0 else 3 if raw[pos] < 0xF0 else 4
                    try:
                        pieces.append((at, at + 3 * n, raw[pos : pos + n].decode("utf-8")))
                    except UnicodeDecodeError:
                        n = 1
                    at, pos = at + 3 * n, pos + n
            if pieces:
                self.put(_replaced(layer, pieces))
                self.escaped_bytes(layer, _PERCENT_BYTES, "%")
        if "\\" in text or "&" in text:
            pieces = [(m.start(), m.end(), new) for m in _ESCAPE.finditer(text) if (new := _escaped(m[0])) != m[0]]
            if pieces:
                self.put(_replaced(layer, pieces))
        if "\\x" in text:
            self.escaped_bytes(layer, _SLASH_BYTES, "\\")
        for m in _BASE64.finditer(text):
            run, at = m[0].rstrip("="), None
            if gap := _NOT_BASE64.search(run):  # over line ends: each character's place
                at = [i for i, c in enumerate(run) if c.isalnum() or c in "+/_-"]
                run = _NOT_BASE64.sub("", run)
            run = run.replace("-", "+").replace("_", "/")
            for first in range(4):
                own = run[first:]
                own = own[: len(own) - (len(own) % 4 == 1)]
                try:
                    raw = base64.b64decode(own + "=" * (-len(own) % 4), validate=True)
                except (binascii.Error, ValueError):
                    continue
                if gap is None:
                    self.bytes_in(layer, m.start() + first, m.start() + first + len(own), raw, lambda j: (j * 4 // 3, (j * 8 + 7) // 6 + 1))
                else:
                    self.bytes_in(layer, m.start(), m.start() + at[first + len(own) - 1] + 1, raw, lambda j, f=first: (at[f + j * 4 // 3], at[f + (j * 8 + 7) // 6] + 1))

    def escaped_bytes(self, layer: _Layer, pattern: re.Pattern, mark: str) -> None:
        """Layers of runs of escapes that stand for bytes which are no text, and of the plain characters between them."""
        for m in pattern.finditer(layer.text):
            run = m[0]
            if mark not in run:
                continue
            raw, places, i = bytearray(), [], 0
            while i < len(run):
                n = 1 if run[i] != mark else 3 if mark == "%" else 4 if run[i + 1] == "x" else 2
                raw.append(ord(run[i]) if n == 1 else _SLASHED[run[i + 1]] if n == 2 else int(run[i + n - 2 : i + n], 16))
                places.append((i, i + n))
                i += n
            if len(raw) > 16 and _readable(bytes(raw)) is None:
                self.bytes_in(layer, m.start(), m.end(), bytes(raw), places.__getitem__)


def find(text: str, most_unpacked: int = MOST_UNPACKED) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """Base spans, all spans, and the number of layers too large to read; a span is (start, kind, end)."""
    done = _Document(text, most_unpacked)
    return done.base, sorted(done.found), done.unread


def secrets(docs: DataFrame, most_unpacked: int = MOST_UNPACKED) -> DataFrame:
    """``(doc_id, base, spans, n_unread)`` for every row; spans are arrays of (kind, start, end) in code points, end exclusive.

    ``base`` are those in the text as it stands, ``spans`` all.  A null text
    counts as empty; repeated rows each get their row; other columns are ignored; texts of any
    length are scanned whole; an empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    one = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def named(spans: list) -> list[dict]:
        return [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [find(x.as_py(), most_unpacked) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([named(x[0]) for x in out], pa.list_(one)), pa.array([named(x[1]) for x in out], pa.list_(one)), pa.array([x[2] for x in out], pa.int64())], ["doc_id", "base", "spans", "n_unread"])

    span = "array<struct<kind:string,start:long,end:long>>"
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, base {span}, spans {span}, n_unread long")
