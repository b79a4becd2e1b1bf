"""Secret scans through layers of encoding, by a worklist that runs to its fixpoint.

A layer is a text whose every character knows the span of the original it came from. Each layer is scanned; then its
percent, Unicode and entity escapes are unwrapped, a new layer for each stretch around some, and so is each base64 run (of
either alphabet, on one line or cut into lines of one width). A run may follow a path or a word of the same alphabet, so
its bytes are read at all four alignments, and each stretch of ASCII in them, or of ASCII in UTF-16, is a layer; where
gzip, zlib, bzip2, xz or zstandard data begin in it, all of their members are decompressed, and what they hold is looked
through likewise. New layers join the worklist unless the same text over the same span was seen before, which also ends
data that decompress to themselves. Spans found in a layer are mapped to the original.

Spans are code points, end exclusive. Defined results: a null text counts as empty and has no spans; copies and repeated
rows are scanned separately; a very long text is scanned whole; an empty table gives an empty result; other columns are
passed by. The only limit guards memory: all decompressed data of a document together hold at most ``max_layer_chars``
bytes. A run beyond it is not looked into: it counts in ``n_refused``, and ``redact`` replaces the whole of it.
"""

from __future__ import annotations

import base64
import bisect
import bz2
import hashlib
import itertools
import lzma
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from html.entities import html5

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune

# The kinds and their patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
# Escapes and wrapped data.
ESCAPE = re.compile(r"((?:%[0-9A-Fa-f]{2})+)|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|((?:\\x[0-9A-Fa-f]{2})+)|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});|\\u\{([0-9A-Fa-f]{1,6})\}|&([A-Za-z][A-Za-z0-9]{1,30};)")
# Characters of all patterns, escapes and breaks: what is found or unwrapped lies within such a stretch.
STRETCH = re.compile(r"[A-Za-z0-9+/_.=\-\"':%\\&#;{}\x20\t\r\n]+")
WRAPPED = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
# Runs of one of the alphabets on successive lines; indents and blanks at line ends are passed over.
LINES, STANDARD_LINES, URL_LINES = (re.compile(rf"(?<![{c}])[{c}]++(?:[ \t]*+\r?\n[ \t]*+[{c}]++)++={{0,2}}") for c in ("A-Za-z0-9+/_-", "A-Za-z0-9+/", "A-Za-z0-9_-"))
LINE = re.compile(r"[^ \t\r\n]+")
KEYWORD = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)
# How gzip, bzip2, xz, zstandard and zlib data begin in base64; the last is short and looked for at the start of a part only.
PRESSED = re.compile(r"H4sI|Qlpo|/Td6WFoA|KLUv/|(?:^|(?<=[/+]))e[AFJN]")
# Bytes of text that may hold what is looked for: the shortest find has 12 characters. ASCII, and ASCII in either order of UTF-16.
PLAIN, WIDE = re.compile(rb"[\t\n\r\x20-\x7e]{12,}"), re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){12,}|(?:\x00[\t\n\r\x20-\x7e]){12,}")

Span = tuple[int, int, int]  # start, kind, end


def scan(text: str) -> list[Span]:
    """The base detectors; every match that counts, in a text without layers."""
    out: list[Span] = []
    if (":" in text or "=" in text) and KEYWORD.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def _escape(m: re.Match) -> str | None:
    if run := m[1] or m[4]:
        raw = bytes.fromhex(run.replace("%", "").replace("\\x", ""))
        return raw.decode("utf-8", "replace")
    if m[8]:
        return html5.get(m[8])
    code = int(m[6]) if m[6] else int(m[2] or m[3] or m[5] or m[7], 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


class _Layer:
    """``at`` holds the original starts and ends of the characters; None where they are the text's own, a pair for all.
    ``cost`` is what it takes of the room for decompressed data."""

    def __init__(self, text: str, at: tuple[array, array] | tuple[int, int] | None = None, cost: int = 0) -> None:
        self.text, self.at, self.cost = text, at, cost

    def origin(self, start: int, end: int) -> tuple[int, int]:
        if self.at is None:
            return start, end
        if isinstance(self.at[0], int):
            return self.at
        return self.at[0][start], self.at[1][end - 1]

    def unescaped(self) -> Iterator["_Layer"]:
        """A layer for each stretch with escapes; no pattern reaches over a stretch's ends."""
        if not ("%" in self.text or "\\" in self.text or "&" in self.text) or not ESCAPE.search(self.text):
            return
        for stretch in STRETCH.finditer(self.text):
            parts, starts, ends, last = [], array("i"), array("i"), stretch.start()
            for m in ESCAPE.finditer(self.text, *stretch.span()):
                if (new := _escape(m)) is None:
                    continue
                self._keep(starts, ends, last, m.start())
                parts += [self.text[last : m.start()], new]
                start, end = self.origin(*m.span())
                starts.extend([start] * len(new))
                ends.extend([end] * len(new))
                last = m.end()
            if parts:
                self._keep(starts, ends, last, stretch.end())
                yield _Layer("".join([*parts, self.text[last : stretch.end()]]), (starts, ends))

    def _keep(self, starts: array, ends: array, a: int, b: int) -> None:
        if self.at is None:
            starts.extend(range(a, b))
            ends.extend(range(a + 1, b + 1))
        elif isinstance(self.at[0], int):
            starts.extend([self.at[0]] * (b - a))
            ends.extend([self.at[1]] * (b - a))
        else:
            starts.extend(self.at[0][a:b])
            ends.extend(self.at[1][a:b])

    def runs(self) -> Iterator[list[tuple[int, int]]]:
        """Stretches that may be base64, as pieces to be joined; those with more pieces before the pieces alone."""
        for m in LINES.finditer(self.text):
            yield from _joined([x.span() for x in LINE.finditer(self.text, *m.span())])
            if "-" in m[0] or "_" in m[0]:
                for pattern in (STANDARD_LINES, URL_LINES):
                    for part in pattern.finditer(self.text, *m.span()):
                        yield from _joined([x.span() for x in LINE.finditer(self.text, *part.span())])
        for m in WRAPPED.finditer(self.text):
            yield [m.span()]

    def wrapped(self, room: Callable[[], int]) -> Iterator["_Layer | tuple[int, int]"]:
        """A layer for each stretch of text that a run holds; the span of data that would not fit when decompressed."""
        for pieces in self.runs():
            offsets = [0, *itertools.accumulate(b - a for a, b in pieces)]
            body = "".join(self.text[a:b] for a, b in pieces).rstrip("=").replace("-", "+").replace("_", "/")

            def place(n: int) -> int:
                k = bisect.bisect_right(offsets, n, hi=len(pieces)) - 1  # noqa: B023
                return pieces[k][0] + n - offsets[k]  # noqa: B023

            until = len(body)  # what stands in whole compressed data by chance is no text
            for m in PRESSED.finditer(body):
                if m.start() > until:
                    break
                if m[0][0] == "e" and _decompressed(_decoded(body[m.start() : m.start() + 4096]), 1 << 22) is None:
                    continue
                data, origin = _decoded(body[m.start() :]), self.origin(place(m.start()), pieces[-1][1])
                opened = False
                try:
                    while (inner := _decompressed(data, room())) is not None and inner[0] != data:
                        data, whole = inner
                        until, opened = min(until, m.start()) if whole and not opened else until, True
                except MemoryError:
                    yield origin
                    continue
                if opened:
                    yield from (_Layer(text, origin, len(text)) for _, _, text in _plain(data))
            for phase in range(4):
                for byte, width, text in _plain(_decoded(body[phase:until])):
                    starts, ends = array("i"), array("i")
                    for at in range(byte, byte + width * len(text), width):
                        a, b = self.origin(place(phase + at * 4 // 3), place(phase + min(-(-(at + width) * 4 // 3), len(body) - phase) - 1) + 1)
                        starts.append(a)
                        ends.append(b)
                    yield _Layer(text, (starts, ends))


def _decoded(body: str) -> bytes:
    """Bytes of base64 characters; a last one that stands alone says nothing."""
    body = body[: len(body) - (len(body) % 4 == 1)]
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _plain(raw: bytes) -> Iterator[tuple[int, int, str]]:
    """First byte, bytes of a character, and text of each stretch that may hold something."""
    for m in PLAIN.finditer(raw):
        yield m.start(), 1, m[0].decode()
    for m in WIDE.finditer(raw) if b"\x00" in raw else ():
        yield m.start(), 2, m[0].replace(b"\x00", b"").decode()


def _joined(lines: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Successive lines that encoders may have cut: lines of one width, with or without a shorter one before and after."""
    widths = [b - a for a, b in lines]
    at = 0
    for width, group in itertools.groupby(widths):
        end = at + len(list(group))
        before = at - (at > 0 and widths[at - 1] < width)
        after = end + (end < len(lines) and widths[end] < width)
        for a, b in dict.fromkeys([(before, after), (at, after), (before, end), (at, end)]):
            if b - a > 1 and sum(widths[a:b]) >= 16:
                yield lines[a:b]
        at = end


def _decompressed(raw: bytes, room: int) -> tuple[bytes, bool] | None:
    """What compressed data hold, all members one after the other, and whether the first is whole; None if they are not compressed; MemoryError beyond ``room`` bytes."""
    out, rest, whole = [], raw, False
    while rest:
        if rest[:2] == b"\x1f\x8b":
            tool = zlib.decompressobj(31)
        elif rest[:1] == b"\x78" and len(rest) > 2 and (rest[0] << 8 | rest[1]) % 31 == 0:
            tool = zlib.decompressobj(15)
        elif rest[:3] == b"BZh":
            tool = bz2.BZ2Decompressor()
        elif rest[:6] == b"\xfd7zXZ\x00":
            tool = lzma.LZMADecompressor(lzma.FORMAT_XZ, memlimit=1 << 27)
        elif rest[:4] == b"\x28\xb5\x2f\xfd":
            tool = _Frames()
        else:
            break
        try:
            part = tool.decompress(rest, room + 1)
        except (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError, ValueError):
            break
        room -= len(part)
        if room < 0:
            raise MemoryError
        out.append(part)
        whole |= tool.eof
        if not tool.eof:
            break
        # xz pads members with zero bytes
        rest = tool.unused_data.lstrip(b"\x00")
    return (b"".join(out), whole) if any(out) else None


class _Frames:
    """All zstandard frames of some data, as the other decompressors have it."""

    eof, unused_data = False, b""

    def decompress(self, raw: bytes, most: int) -> bytes:
        parts, reader = [], zstandard.ZstdDecompressor(max_window_size=1 << 24).stream_reader(raw, read_across_frames=True)
        try:
            while most > 0 and (part := reader.read(min(most, 1 << 20))):
                parts.append(part)
                most -= len(part)
            self.eof = most > 0
        except zstandard.ZstdError:
            if not parts:  # what precedes a damaged frame counts
                raise
        return b"".join(parts)


def search(text: str, max_layer_chars: int = 1 << 24) -> tuple[list[Span], list[Span], list[tuple[int, int]]]:
    """Base spans, all spans, and where data stay compressed."""
    base = sorted(scan(text))
    found, seen, refused, room = set(base), set(), set(), max_layer_chars
    todo = [_Layer(text)]
    while todo:
        layer = todo.pop()
        for new in itertools.chain(layer.unescaped(), layer.wrapped(lambda: room)):
            if isinstance(new, tuple):
                refused.add(new)
                continue
            if not new.text or (key := (hashlib.blake2b(new.text.encode("utf-8", "replace"), digest_size=16).digest(), new.origin(0, len(new.text)))) in seen:
                continue
            if new.cost > room:
                refused.add(new.origin(0, len(new.text)))
                continue
            seen.add(key)
            room -= new.cost
            for start, kind, end in scan(new.text):
                a, b = new.origin(start, end)
                found.add((a, kind, b))
            todo.append(new)
    return base, sorted(found), sorted(refused)


def find(text: str, max_layer_chars: int = 1 << 24) -> tuple[list[Span], list[Span], int]:
    """Base spans, all spans, and the number of runs that stayed compressed."""
    base, spans, refused = search(text, max_layer_chars)
    return base, spans, len(refused)


def hidden(spans: list[Span], refused: list[tuple[int, int]]) -> list[Span]:
    """What a redacted text must not show: the finds and what could not be looked into."""
    return sorted([*spans, *((a, len(KINDS), b) for a, b in refused)])


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """``text`` with each stretch of overlapping spans replaced by ``mark``."""
    out, last = [], 0
    stop = -1
    for start, _, end in spans:
        if start < stop:
            stop = max(stop, end)
            last = stop
            continue
        out += [text[last:start], mark]
        last = stop = end
    return "".join(out) + text[last:]


def scan_documents(docs: DataFrame, redact: bool = False, max_layer_chars: int = 1 << 24) -> DataFrame:
    """Counts, digest and spans of each document; with ``redact`` also its ``text`` without the secrets."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in pc.fill_null(batch.column(1), "").to_pylist():
                base, spans, refused = search(text, max_layer_chars)
                kinds = [k for _, k, _ in base]
                rows.append((*(kinds.count(k) for k in range(3)), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), len(spans), len(refused), redacted(text, hidden(spans, refused)) if redact else None))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)

    types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 2 + [pa.string()]
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans", "n_refused", "clean_text"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long, n_refused long, clean_text string")
    return out if redact else out.drop("clean_text")


def redact_documents(docs: DataFrame, mark: str = "[SECRET]", max_layer_chars: int = 1 << 24) -> DataFrame:
    """``docs`` with every secret in ``text``, whatever layers hide it, and all that could not be looked into replaced by ``mark``; a null text stays null."""
    tune(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None else redacted(t, hidden(*search(t, max_layer_chars)[1:]), mark) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    rows = docs.withColumn("text", F.col("text").cast("string"))
    return rows.mapInArrow(run, rows.schema)
