"""Secret scans through nested encodings.

Each text is a worklist of layers. The text itself is the first; a layer gives rise
to one more for each kind of encoding found in it, in which every such stretch is
replaced by what it encodes: URL escapes, Unicode escapes, base64, and base64 of
compressed data (gzip, zlib, bzip2, xz, also nested), on one line or wrapped. A run of base64's characters
that is no text as a whole, such as a path or a name with base64 in it, is tried at each of the four ways to align it, and what
reads as text there is taken; compressed data may begin anywhere in a run. Any that
is UTF-8 is a layer, whatever its characters. A layer that was seen before
is not entered again, so that cycles end; the work stops at the fixpoint. Every
layer is scanned, and what is found in it is mapped back, piece by piece, to code
points of the text: an escape stands for its own characters, a base64 group of four
characters for its three bytes, compressed data as a whole for all it holds.

Defined cases: a null or empty text has no spans; very long texts are scanned whole;
a null ``doc_id`` stays null; repeated rows give one result each; an empty table
gives an empty result. Extra columns are not read by ``scan`` and pass through
``redact``. Decompressed data beyond ``MOST_BYTES`` in one stretch is left
undecoded and counted in ``n_refused``; nothing else is bounded.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.arrow import lean, pieces
from storyloom.llm.common import documents

#: The kinds in order, their patterns and least lengths.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20

#: A decompressed stretch may hold this many bytes.
MOST_BYTES = 64 << 20

_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,6}\})+")
_ONE_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\[uUx]([0-9A-Fa-f]+)")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: The same over several lines, all but the first and the last of them whole.
_FOLDED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{8,}(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]+)+={0,2}")
_PLAIN = str.maketrans("-_", "+/")
#: Bytes that read as text, and how many of them are taken for a message.
_TEXT = re.compile(rb"(?:[\t\n\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")
LEAST_TEXT = 9
#: How compressed data begins, in base64, and how much of it tells whether it is.
_MAGIC = re.compile(r"H4sI|Qlpo|[/_]Td6WFo|[CGKOSWae][A-P]")
_HEAD = 64
#: The first line of base64 over several, which begins as compressed data does; and a line.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:H4sI|Qlpo|[/_]Td6WFo|[CGKOSWae][A-P])[A-Za-z0-9+/_-]*[ \t]*\r?\n(?=[ \t]*[A-Za-z0-9+/_-])")
_WRAPPED_LINE = re.compile(r"[ \t]*([A-Za-z0-9+/_-]+={0,2})(?:[ \t]*\r?\n)?")
_MAY_ASSIGN = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)

#: Stretches of a decoded layer: (start there, end there, start in the layer before, end there, character for character).
Map = list[tuple[int, int, int, int, bool]]


def matches(text: str) -> list[tuple[str, int, int]]:
    """The base spans of one string, by start and then by kind."""
    out = []
    if _MAY_ASSIGN.search(text):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return [(KINDS[k], s, e) for s, k, e in sorted(out)]


def _characters(raw: bytes, first: int, width: Callable[[int], tuple[int, int]]) -> tuple[str, Map] | None:
    """Text of bytes with, for each character, where the bytes it comes from stood; None if they are no text."""
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    out, at = [], 0
    for i, c in enumerate(text):
        n = len(c.encode())
        out.append((i, i + 1, first + width(at)[0], first + width(at + n - 1)[1], False))
        at += n
    return text, out


def _url(m: re.Match, _: list) -> tuple[str, Map] | None:
    return _characters(bytes.fromhex(m[0].replace("%", "")), m.start(), lambda b: (3 * b, 3 * b + 3))


def _unicode(m: re.Match, _: list) -> tuple[str, Map] | None:
    marks = [(int(x[1] or x[2], 16), x.start(), x.end()) for x in _ONE_ESCAPE.finditer(m[0])]
    out, text, i = [], [], 0
    while i < len(marks):
        code, a, b = marks[i]
        if 0xD800 <= code < 0xDC00 and i + 1 < len(marks) and 0xDC00 <= marks[i + 1][0] < 0xE000:  # two halves of one character
            code, b = 0x10000 + ((code - 0xD800) << 10) + marks[i + 1][0] - 0xDC00, marks[i + 1][2]
            i += 1
        if code > 0x10FFFF or 0xD800 <= code < 0xE000:
            return None
        out.append((len(text), len(text) + 1, m.start() + a, m.start() + b, False))
        text.append(chr(code))
        i += 1
    return "".join(text), out


def _raw(body: str) -> bytes:
    """The bytes of characters of base64; one that is left over goes."""
    body = body[: len(body) - (len(body) % 4 == 1)]
    return binascii.a2b_base64(body + "=" * (-len(body) % 4))


def _messages(run: str) -> list[tuple[int, int, bytes]]:
    """Stretches of a run that read as text at one of its four alignments, the longest of those that overlap: start, end, bytes."""
    found = []
    for a in range(4):
        raw = _raw(run[a:])
        found += [(m.end() - m.start(), a + m.start() // 3 * 4, a + -(-m.end() // 3) * 4, m.start() % 3, m[0]) for m in _TEXT.finditer(raw) if m.end() - m.start() >= LEAST_TEXT]
    out: list[tuple[int, int, int, bytes]] = []
    for _, s, e, skip, text in sorted(found, key=lambda x: -x[0]):
        if all(e <= x[0] or s >= x[1] for x in out):
            out.append((s, min(e, len(run)), skip, text))
    return sorted(out)


def _base64(m: re.Match, _: list) -> tuple[str, Map] | None:
    """What a run holds as a whole, if that is text, or else its messages with what lies between them as it stands."""
    at = [i for i, c in enumerate(m[0]) if c not in " \t\r\n="]  # where the run's characters are in the match
    run = "".join(m[0][i] for i in at).translate(_PLAIN) if len(at) < len(m[0]) else m[0].translate(_PLAIN)
    if len(run) < 12:
        return None
    place = lambda i: m.start() + at[i]
    after = lambda i: m.start() + at[i - 1] + 1 if i < len(at) else m.end()
    found = _messages(run)
    raw = _raw(run) if len(run) % 4 != 1 else b""
    whole = raw and (len(found) != 1 or 2 * len(found[0][3]) < len(raw) or found[0][0] == 0) and _characters(raw, 0, lambda b: (place(b // 3 * 4), after(min(b // 3 * 4 + 4, len(run)))))
    if whole and 2 * sum(len(x[3]) for x in found) <= 2 * len(raw):
        return whole
    text, out, end = [], [], 0
    for s, e, skip, body in found:
        got = _characters(body, 0, lambda b, s=s, skip=skip: (place(s + (b + skip) // 3 * 4), after(min(s + (b + skip) // 3 * 4 + 4, len(run)))))
        if got is None:
            continue
        if s > end:
            begin = place(end) if end else m.start()
            out.append((len("".join(text)), len("".join(text)) + place(s) - begin, begin, place(s), True))
            text.append(m.string[begin : place(s)])
        n = sum(map(len, text))
        out += [(n + x, n + y, p, q, same) for x, y, p, q, same in got[1]]
        text.append(got[0])
        end = e
    if not end:
        return None
    if after(end) < m.end() and end < len(run):
        n = sum(map(len, text))
        out.append((n, n + m.end() - after(end), after(end), m.end(), True))
        text.append(m.string[after(end) : m.end()])
    return "".join(text), out


def _makers(raw: bytes) -> list[Callable]:
    """Decompressors of what the first bytes may begin."""
    makers = []
    if raw[:2] == b"\x1f\x8b":
        makers.append(lambda: zlib.decompressobj(31))
    if len(raw) > 2 and raw[0] & 15 == 8 and int.from_bytes(raw[:2], "big") % 31 == 0:
        makers.append(lambda: zlib.decompressobj(15))
    if raw[:3] == b"BZh":
        makers.append(bz2.BZ2Decompressor)
    if raw[:6] == b"\xfd7zXZ\0":
        makers.append(lzma.LZMADecompressor)
    return makers


_NO_DATA = (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError)


def _inflate(raw: bytes, refused: list) -> bytes | None:
    """One compressed layer off; None if raw isn't compressed."""
    for make in _makers(raw):
        try:
            d = make()
            out = d.decompress(raw, MOST_BYTES + 1)
        except _NO_DATA:
            continue
        if len(out) > MOST_BYTES:
            refused.append(len(raw))
            return None
        if d.eof:
            return out
    return None


def _innermost(raw: bytes | None, refused: list) -> str | None:
    """The text of data compressed once or more; None if it isn't compressed, or no text."""
    seen, inner = set(), None
    while raw and (key := hashlib.sha256(raw).digest()) not in seen and (got := _inflate(raw, refused)) is not None:
        seen.add(key)
        raw = inner = got
    try:
        return inner.decode() if inner else None
    except UnicodeDecodeError:
        return None


def _begins(raw: bytes) -> bool:
    """Whether the first bytes pass for the beginning of compressed data."""
    for make in _makers(raw):
        try:
            make().decompress(raw, MOST_BYTES)
        except _NO_DATA:
            continue
        return True
    return False


def _compressed(m: re.Match, refused: list) -> tuple[str, Map] | None:
    """Compressed data from anywhere in a run to its end; what stands before stays."""
    run = m[0].rstrip("=").translate(_PLAIN)
    at = 0
    while (found := _MAGIC.search(run, at)) is not None:
        s, at = found.start(), found.start() + 1
        if _begins(_raw(run[s : s + _HEAD])) and (text := _innermost(_raw(run[s:]), refused)):
            first = [(0, s, m.start(), m.start() + s, True)] if s else []
            return m[0][:s] + text, [*first, (s, s + len(text), m.start() + s, m.end(), False)]
    return None


def _wrapped(m: re.Match, refused: list) -> tuple[str, Map] | None:
    """Compressed data in base64 over several lines, read line by line as far as the data goes."""
    d, raw, body, size, at = None, [], "", 0, m.start()
    while (line := _WRAPPED_LINE.match(m.string, at)) is not None:
        body += line[1].rstrip("=").replace("-", "+").replace("_", "/")
        last = line[1].endswith("=") or not line[0].endswith("\n") or _WRAPPED_LINE.match(m.string, line.end()) is None
        use = len(body) if last and len(body) % 4 != 1 else len(body) // 4 * 4
        part = base64.b64decode(body[:use] + "=" * (-use % 4))
        body, at, end = body[use:], line.end(), line.end(1)
        raw.append(part)
        try:
            if d is None:
                if len(part) < 8 and not last:  # too short to tell what it is
                    body, raw = base64.b64encode(part).decode() + body, []
                    continue
                if not (makers := _makers(part)):
                    return None
                d = makers[0]()
            size += len(d.decompress(part, MOST_BYTES + 1 - size))
        except _NO_DATA:
            return None
        if size > MOST_BYTES:
            refused.append(sum(map(len, raw)))
            return None
        if d.eof or last:
            break
    text = _innermost(b"".join(raw), refused) if d is not None and d.eof else None
    return (text, [(0, len(text), m.start(), end, False)]) if text else None


_DECODERS = ((_URL, _url), (_UNICODE, _unicode), (_BASE64, _base64), (_FOLDED, _base64), (_BASE64, _compressed), (_WRAPPED, _wrapped))


def _unwrapped(text: str, pattern: re.Pattern, decode: Callable, refused: list) -> tuple[str, Map] | None:
    """The text with all stretches of one encoding decoded, and where its characters come from; None if there are none."""
    parts, places, at, n = [], [], 0, 0
    for m in pattern.finditer(text):
        got = decode(m, refused) if m.start() >= at else None
        if got is None:
            continue
        if m.start() > at:
            parts.append(text[at : m.start()])
            places.append((n, n + m.start() - at, at, m.start(), True))
            n += m.start() - at
        parts.append(got[0])
        places += [(n + a, n + b, s, e, same) for a, b, s, e, same in got[1]]
        n += len(got[0])
        at = max(m.end(), got[1][-1][3])
    if not at:
        return None
    if at < len(text):
        parts.append(text[at:])
        places.append((n, n + len(text) - at, at, len(text), True))
    return "".join(parts), places


def _mapped(start: int, end: int, places: Map, begins: list[int]) -> tuple[int, int]:
    first, last = places[bisect_right(begins, start) - 1], places[bisect_right(begins, end - 1) - 1]
    return first[2] + (start - first[0] if first[4] else 0), last[2] + end - last[0] if last[4] else last[3]


def scan_text(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]], int, int]:
    """Base spans, all spans, the number of layers scanned and of stretches refused."""
    base = matches(text)
    found, seen, refused = set(base), {text}, []
    work: list[tuple[str, tuple]] = [(text, ())]
    while work:
        layer, way = work.pop()
        for pattern, decode in _DECODERS:
            got = _unwrapped(layer, pattern, decode, refused)
            if got is None or got[0] in seen:
                continue
            seen.add(got[0])
            here = ((got[1], [p[0] for p in got[1]]), *way)
            work.append((got[0], here))
            for kind, s, e in matches(got[0]):
                for places, begins in here:
                    s, e = _mapped(s, e, places, begins)
                found.add((kind, s, e))
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(found, key=lambda x: (x[1], order[x[0]], x[2])), len(seen), len(refused)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each stretch that spans cover replaced by the kind of the first of them."""
    out, at = [], 0
    runs: list[list] = []
    for kind, s, e in sorted(spans, key=lambda x: x[1]):
        if runs and s < runs[-1][2]:
            runs[-1][2] = max(runs[-1][2], e)
        else:
            runs.append([kind, s, e])
    for kind, s, e in runs:
        out += [text[at:s], f"[{kind}]"]
        at = e
    return "".join(out) + text[at:]


SPANS = "array<struct<kind:string,start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _rows(spans: list[list[tuple[str, int, int]]]) -> pa.Array:
    return pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x] for x in spans], _SPANS)


def scan(df: DataFrame) -> DataFrame:
    """(doc_id, base, spans, n_layers, n_refused) of every row; offsets are code points, ends exclusive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            got = [scan_text(t or "") for t in b.column(1).to_pylist()]
            base, spans, layers, refused = zip(*got, strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), _rows(base), _rows(spans), pa.array(layers, pa.int64()), pa.array(refused, pa.int64())], ["doc_id", "base", "spans", "n_layers", "n_refused"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), f"doc_id long, base {SPANS}, spans {SPANS}, n_layers long, n_refused long")


def redact(df: DataFrame) -> DataFrame:
    """The rows and columns that came, each text with its secrets replaced by their kinds in brackets; nulls stay."""
    at = df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            texts = [t if t is None else redacted(t, scan_text(t)[1]) for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return df.mapInArrow(lean(run), df.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scan(documents(spark, sf_dir))
    line = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return d.select("doc_id", *map(count, KINDS), F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"), "n_layers", "n_refused")
