"""Secret scan through nested encodings by a worklist.

The text itself is the first layer.  Every layer is searched for secrets and for
encoded runs (percent escapes, backslash-u and character references, base64,
compressed data inside base64); each run that decodes to readable text is a new
layer on the worklist, with a map from its characters back to the original text.
The list ends when it is empty; a layer whose content was seen before at the same place
of the original text is not entered again, in whatever order its encodings came off.  A finding in a decoded layer is reported as the span
of the original text that it came from, under the same kind.

Base findings of the text itself are always kept.  Spans are code points, end
exclusive.

Edge cases: null and empty texts have none; whole texts are searched; runs that
don't decode, or decode to something unreadable, are left; compressed data is
inflated whole, all members of it (deflate expands at most 1032 times); base64
wrapped over lines is decoded as one run as well as line by line; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import html
import re
import zlib
from bisect import bisect_right

from pyspark.sql import DataFrame

from .common import map_batches

# The given patterns, by kind in the given order.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_VALUE, MIN_ACCESS = 12, 18
_HINTS = ("passw", "secret", "token", "api")

_ESCAPED = re.compile(r"%[0-9A-Fa-f]{2}")
_UNICODE = re.compile(r"(?:\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&[a-z]{2,8};)")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_=-]+")


def find_base(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the given patterns, in order."""
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


class Layer:
    """A decoded text; ``at[i]`` and ``to[i]`` are the original span of the piece that
    begins at its character ``starts[i]``.  Pieces that are plain copies are ``flat``."""

    __slots__ = ("text", "starts", "at", "to", "flat")

    def __init__(self, text: str, pieces: list[tuple[int, int, int, bool]]) -> None:
        self.text = text
        self.starts = [p[0] for p in pieces]
        self.at = [p[1] for p in pieces]
        self.to = [p[2] for p in pieces]
        self.flat = [p[3] for p in pieces]

    def origin(self, a: int, b: int) -> tuple[int, int]:
        """The original span of the characters a to b."""
        i, j = bisect_right(self.starts, a) - 1, bisect_right(self.starts, b - 1) - 1
        low = self.at[i] + (a - self.starts[i] if self.flat[i] else 0)
        high = self.at[j] + (b - self.starts[j]) if self.flat[j] else self.to[j]
        return low, high


def _readable(text: str) -> bool:
    return len(text) >= 4 and sum(c.isprintable() or c in "\n\r\t" for c in text) >= 0.95 * len(text)


def _inflate(data: bytes) -> bytes | None:
    """All members of compressed data; what follows the last one is no part of it."""
    out = []
    for head, bits in ((b"\x1f\x8b", 31), (b"\x78", 15)):
        while data.startswith(head):
            member = zlib.decompressobj(bits)
            try:
                out.append(member.decompress(data) + member.flush())
            except zlib.error:
                break
            data = member.unused_data
        if out:
            return b"".join(out)
    return None


def _from_base64(run: str) -> str | None:
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        data = base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None
    data = _inflate(data) or data
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if _readable(text) else None


def _percent(run: str) -> list[tuple[str, int, int, bool]]:
    """Decoded pieces (text, start, end, plain) of a run with percent escapes."""
    out, at = [], 0
    for m in re.finditer(r"(?:%[0-9A-Fa-f]{2})+", run):
        if m.start() > at:
            out.append((run[at : m.start()], at, m.start(), True))
        data = bytes.fromhex(m[0].replace("%", ""))
        k = m.start()
        for c in data.decode("utf-8", "replace"):
            size = 3 * (len(c.encode()) if c != "�" else 1)
            out.append((c, k, min(k + size, m.end()), False))
            k = min(k + size, m.end())
        at = m.end()
    if at < len(run):
        out.append((run[at:], at, len(run), True))
    return out


def _character(escape: str) -> str:
    if escape[0] == "&":
        return html.unescape(escape)
    n = int(escape[2:].strip("{}"), 16)
    return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else "�"


def _wrapped(block: str) -> list[tuple[int, int]]:
    """The parts of a block of base64 lines that may be one wrapped run: the first line
    may follow other text; of the others all have the length of the second but the last,
    which may be shorter (with or without it, since a word may follow)."""
    lines = [m.span() for m in _LINE.finditer(block)]
    size = [b - a for a, b in lines]
    out: list[tuple[int, int]] = []
    at = 0
    while at + 1 < len(lines):
        to = at + 2
        if size[at + 1] >= 16:
            while to < len(lines) and size[to] == size[at + 1]:
                to += 1
            if to - at > 1:
                out.append((lines[at][0], lines[to - 1][1]))
            if to < len(lines) and size[to] < size[at + 1]:
                out.append((lines[at][0], lines[to][1]))
        elif size[at] >= 16:
            out.append((lines[at][0], lines[at + 1][1]))
        at = to - 1
    return out


def _runs(text: str):
    """(start, end, decoded pieces) of the encoded runs of a layer."""
    # escapes are rewritten in place, together with the words around them
    if "%" in text:
        for m in re.finditer(r"\S+", text):
            if "%" in m[0] and _ESCAPED.search(m[0]):
                yield m.start(), m.end(), _percent(m[0])
    if "\\" in text or "&" in text:
        for m in re.finditer(r"\S+", text):
            if "\\" not in m[0] and "&" not in m[0]:
                continue
            pieces, at = [], 0
            for e in _UNICODE.finditer(m[0]):
                if e.start() > at:
                    pieces.append((m[0][at : e.start()], at, e.start(), True))
                pieces.append((_character(e[0]), e.start(), e.end(), False))
                at = e.end()
            if at:
                if at < len(m[0]):
                    pieces.append((m[0][at:], at, len(m[0]), True))
                yield m.start(), m.end(), pieces
    for m in _BASE64.finditer(text):
        plain = _from_base64(m[0])
        if plain is not None:
            yield m.start(), m.end(), [(plain, 0, m.end() - m.start(), False)]
    if "\n" in text:
        for m in _WRAPPED.finditer(text):
            for a, b in _wrapped(m[0]):
                plain = _from_base64("".join(_LINE.findall(m[0], a, b)))
                if plain is not None:
                    yield m.start() + a, m.start() + b, [(plain, 0, b - a, False)]


def find_secrets(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base findings, and all findings (base and those of decoded layers), in order."""
    if not text:
        return [], []
    base = find_base(text)
    found = set(base)
    work = [Layer(text, [(0, 0, len(text), True)])]
    seen: set[tuple[bytes, int, int]] = set()  # layers by content and origin
    while work:
        layer = work.pop()
        for a, b, pieces in _runs(layer.text):
            decoded = "".join(p[0] for p in pieces)
            if not decoded or decoded == layer.text[a:b]:
                continue
            mark = (hashlib.md5(decoded.encode("utf-8", "surrogatepass")).digest(), *layer.origin(a, b))
            if mark in seen:
                continue
            seen.add(mark)
            origin, at = [], 0
            for piece, x, y, plain in pieces:
                low, high = layer.origin(a + x, a + y)
                origin.append((at, low, high, plain and high - low == len(piece)))
                at += len(piece)
            inner = Layer(decoded, origin)
            work.append(inner)
            found.update((low, k, high) for s, k, e in find_base(decoded) for low, high in [inner.origin(s, e)])
    return base, sorted(found)


def spans_text(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row."""
    schema = {"doc_id": "long", "n_assign": "long", "n_access": "long", "n_hex": "long", "base_sha256": "string", "spans": "string"}

    def rows(cols: dict[str, list]) -> dict[str, list]:
        both = [find_secrets(t) for t in cols["text"]]
        counts = {f"n_{kind}": [sum(k == i for _, k, _ in base) for base, _ in both] for i, kind in enumerate(KINDS)}
        return {"doc_id": cols["doc_id"]} | counts | {
            "base_sha256": [hashlib.sha256(spans_text(base).encode()).hexdigest() for base, _ in both],
            "spans": [spans_text(every) for _, every in both],
        }

    return map_batches(docs.select("doc_id", "text"), schema, rows)
