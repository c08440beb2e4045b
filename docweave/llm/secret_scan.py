"""Secret scans over texts and over what is encoded in them.

A worklist of layers starts with the text. Each layer is scanned with the base patterns; each encoded run in it (URL
escapes, Unicode escapes, base64, or compressed bytes within base64) is decoded into a layer of its own, until no layer
gives a new one. What a content holds is found once and mapped to each place where it stands; content that stands
within itself is scanned there but not opened again, which ends cycles. Every layer maps its offsets to its parent's,
so that a find is reported where it stands in the original text.

Defined results: null is an empty text and has no spans; repeated rows are scanned alike, row by row; an empty table
gives none; columns other than the identifier and the text are ignored whatever their names. Compressed layers are
read member after member, in windows of STEP bytes or more that end where no find or encoded run can go on, so that
nothing is cut; memory holds such a window, and so the longest stretch without such a place.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import itertools
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

KINDS = ("assign", "access", "hex")
LAYER_KINDS = ("layer_assign", "layer_access", "layer_hex")
_ORDER = {k: i for i, k in enumerate(KINDS + LAYER_KINDS)}

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

STEP = 1 << 20

#: Finds and encoded runs hold only these characters (line ends: wrapped ones), so that a text may be cut at any other without losing one.
_INSIDE = re.compile(r"""[A-Za-z0-9+/_.=:"' \t\r\n%\\-]+""")
_INSIDE_BYTES = bytes(i for i in range(128) if _INSIDE.match(chr(i)))
_URL = re.compile(r"%([0-9A-Fa-f]{2})")
_UNICODE = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})|\\U(00(?:0[0-9a-fA-F]|10)[0-9a-fA-F]{4})")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: Lines of encoded characters; a last one may be short.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}[ \t]*\r?\n[ \t]*)+[A-Za-z0-9+/_-]+={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
#: Within decoded bytes that are no text as a whole: stretches that are, and where compressed bytes may begin.
_READABLE = re.compile(rb"[\t\n\r\x20-\x7E]{12,}")
_GZIP = re.compile(rb"\x1f\x8b\x08")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """The base finds of one text: leftmost, non-overlapping within a kind, failing ones dropped."""
    found = []
    if "=" in text or ":" in text:
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return found


class _Stretches:
    """Where code points stand in the parent, by stretches: some that stand as they are, one after the other, and single
    decoded ones. Of each its first code point and place, and the end if it is a decoded one, else -1."""

    __slots__ = ("ends", "firsts", "places")

    def __init__(self) -> None:
        self.firsts, self.places, self.ends = array("q"), array("q"), array("q")

    def add(self, first: int, place: int, end: int = -1) -> None:
        self.firsts.append(first)
        self.places.append(place)
        self.ends.append(end)

    def start(self, i: int) -> int:
        k = bisect.bisect_right(self.firsts, i) - 1
        return self.places[k] + (i - self.firsts[k] if self.ends[k] < 0 else 0)

    def end(self, i: int) -> int:
        k = bisect.bisect_right(self.firsts, i) - 1
        return self.places[k] + i - self.firsts[k] + 1 if self.ends[k] < 0 else self.ends[k]


class _Encoded:
    """Where the code points of a text from byte `at` of what a base64 run holds from its character `shift` on stand; places
    has those of the run's characters."""

    __slots__ = ("at", "places", "plain", "shift")

    def __init__(self, plain: str, at: int, shift: int, places: Sequence[int]) -> None:
        self.plain, self.at, self.shift, self.places = plain, at, shift, places

    def _byte(self, i: int) -> int:
        return self.at + (i if self.plain.isascii() else len(self.plain[:i].encode()))

    def start(self, i: int) -> int:
        return self.places[self.shift + self._byte(i) * 4 // 3]

    def end(self, i: int) -> int:
        return self.places[min(self.shift - (-self._byte(i + 1) * 4 // 3), len(self.places)) - 1] + 1


class _Layer:
    """Decoded text; places says where its code points stand in the parent, or span holds for all."""

    __slots__ = ("places", "span", "text")

    def __init__(self, text: str, places: _Stretches | _Encoded | None = None, span: tuple[int, int] | None = None) -> None:
        self.text, self.places, self.span = text, places, span

    def above(self, spans: Iterable[Span]) -> Iterator[Span]:
        """Spans of this layer, where they stand in its parent."""
        for k, start, end in spans:
            yield (k, *(self.span or (self.places.start(start), self.places.end(end - 1))))


def _text_of(raw: bytes) -> str | None:
    """Bytes as text, if they look like it."""
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    odd = sum(1 for c in text if not c.isprintable() and c not in "\n\r\t")
    return text if text and 10 * odd <= len(text) else None


def _escaped_layers(text: str, escape: re.Pattern) -> Iterator[_Layer]:
    """The layers in which escapes are decoded: one for each whole stretch of _INSIDE that has any."""
    for m in _INSIDE.finditer(text):
        if run := list(escape.finditer(text, *m.span())):
            yield _unescaped(text, run, *m.span())


def _unescaped(text: str, run: list[re.Match], at: int, end: int) -> _Layer:
    """The stretch [at, end) with its escapes decoded: as UTF-8, neighbouring ones together, or else byte by byte."""
    groups: list[list[re.Match]] = []
    for m in run:
        if groups and groups[-1][-1].end() == m.start():
            groups[-1].append(m)
        else:
            groups.append([m])
    raws = [[bytes([int(m[1], 16)]) if m[0][0] == "%" else chr(int(m[m.lastindex], 16)).encode(errors="replace") for m in g] for g in groups]
    try:
        plain = [b"".join(r).decode() for r in raws]
    except UnicodeDecodeError:
        plain = None
    parts, places, n = [], _Stretches(), 0
    for k, (group, raw) in enumerate(zip(groups, raws, strict=True)):
        if at < group[0].start():
            parts.append(text[at : group[0].start()])
            places.add(n, at)
            n += len(parts[-1])
        parts.append(plain[k] if plain else b"".join(raw).decode("latin-1"))
        escapes = [m for m, b in zip(group, raw, strict=True) for _ in b]  # of each byte
        i = 0
        for c in parts[-1]:
            width = len(c.encode()) if plain else 1
            places.add(n, escapes[i].start(), escapes[i + width - 1].end())
            n, i = n + 1, i + width
        at = group[-1].end()
    if at < end:
        parts.append(text[at:end])
        places.add(n, at)
    return _Layer("".join(parts), places)


def _base64_layers(text: str) -> Iterator[_Layer]:
    for m in _BASE64.finditer(text):
        yield from _decoded(m[0].rstrip("="), range(m.start(), m.end()))
    for m in _WRAPPED.finditer(text):
        for lines in _blocks([x.span() for x in _LINE.finditer(text, *m.span())]):
            places = array("q", itertools.chain.from_iterable(range(*x) for x in lines))
            yield from _decoded("".join(text[start:end] for start, end in lines), places)


def _blocks(lines: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Lines of one length in a row, each time with the next one if it is shorter; two at least."""
    first = 0
    while first < len(lines):
        width, last = lines[first][1] - lines[first][0], first + 1
        while last < len(lines) and lines[last][1] - lines[last][0] == width:
            last += 1
        block = lines[first : last + (last < len(lines) and lines[last][1] - lines[last][0] < width)]
        if len(block) > 1:
            yield block
        first = last


def _decoded(run: str, places: Sequence[int]) -> Iterator[_Layer]:
    """The layers of one encoded run whose characters stand at places.

    If it is no text or compressed bytes from its first character on, other characters may stand before or behind it
    without a gap, so that all four alignments are read for stretches of text and for compressed bytes.
    """
    code = run.replace("-", "+").replace("_", "/")
    for shift in range(4):
        part = code[shift : len(code) - ((len(code) - shift) % 4 == 1)]
        if not part:
            return
        raw = base64.b64decode(part + "=" * (-len(part) % 4))
        whole = _text_of(raw) if not shift else None
        opened: set[int] = set()
        if _compressed(raw) and not shift:
            yield from (_Layer(t, span=(places[0], places[-1] + 1)) for t in _inflated(raw, 0, opened))
        if whole is not None:
            yield _placed(whole, 0, shift, places)
            return
        for m in _READABLE.finditer(raw):
            yield _placed(m[0].decode(), m.start(), shift, places)
        for m in _GZIP.finditer(raw):
            if m.start() not in opened:
                at = shift + m.start() * 4 // 3
                yield from (_Layer(t, span=(places[at], places[-1] + 1)) for t in _inflated(raw, m.start(), opened))


def _placed(plain: str, at: int, shift: int, places: Sequence[int]) -> _Layer:
    return _Layer(plain, _Encoded(plain, at, shift, places))


def _compressed(raw: bytes) -> bool:
    return raw[:2] == b"\x1f\x8b" or (raw[:1] == b"\x78" and len(raw) > 2 and int.from_bytes(raw[:2], "big") % 31 == 0)


def _inflated(raw: bytes, start: int, opened: set[int]) -> Iterator[str]:
    """The windows of what gzip or zlib streams from byte `start` on hold, one after the other; opened gets where they begin."""
    held, size = [], 0
    for piece in _pieces(raw, start, opened):
        held.append(piece)
        size += len(piece)
        if size >= STEP and (cut := len(piece.rstrip(_INSIDE_BYTES))):
            held[-1] = piece[:cut]
            yield b"".join(held).decode("utf-8", "replace")
            held, size = [piece[cut:]], len(piece) - cut
    if size:
        yield b"".join(held).decode("utf-8", "replace")


def _pieces(raw: bytes, start: int, opened: set[int]) -> Iterator[bytes]:
    """The bytes of all members, STEP at most at once; a damaged stream gives what comes before the damage. Plain text behind
    them is a readable stretch of its own."""
    length, raw = len(raw), raw[start:]
    while _compressed(raw):
        opened.add(length - len(raw))
        stream = zlib.decompressobj(47)
        while not stream.eof:
            before = stream.copy()
            try:
                piece = stream.decompress(raw, STEP)
            except zlib.error:
                yield from _before_damage(before, raw)
                return
            raw = stream.unconsumed_tail
            if not piece:
                break
            yield piece
        raw = stream.unused_data.lstrip(b"\0")


def _before_damage(stream: zlib._Decompress, raw: bytes) -> Iterator[bytes]:
    """Fed in smaller and smaller parts, as what a failing call had decoded is lost; the byte that fails gives its output singly."""
    for n in (4096, 64, 1):
        while raw:
            before = stream.copy()
            try:
                piece = stream.decompress(raw[:n])
            except zlib.error:
                stream = before
                break
            raw = raw[n:]
            yield piece
    rest, piece = raw[:1], b""
    while rest or piece:
        try:
            piece = stream.decompress(rest, 1)
        except zlib.error:
            return
        rest = stream.unconsumed_tail
        yield piece


class _Content:
    """A content that is being opened: its layers to come, its finds so far, and the outermost content that it repeats."""

    __slots__ = ("found", "layers", "mark", "place", "repeats")

    def __init__(self, layer: _Layer, mark: bytes, depth: int, base: list[Span]) -> None:
        self.place, self.mark, self.repeats = layer, mark, depth
        self.found, self.layers = set(base), _opened(layer.text)


def _all_spans(text: str, base: list[Span]) -> set[Span]:
    """The finds of a text and of all layers below it, by base kind and by place in the text.

    Finds are kept by content for its other places, but not those from inside a cycle, which are whole only at its start.
    """
    chain = [_Content(_Layer(text), _digest(text), 0, base)]
    known: dict[bytes, set[Span]] = {}
    depth = {chain[0].mark: 0}
    while True:
        content = chain[-1]
        if (layer := next(content.layers, None)) is not None:
            mark = _digest(layer.text)
            if mark in known:
                content.found.update(layer.above(known[mark]))
            elif mark in depth:
                content.repeats = min(content.repeats, depth[mark])
                content.found.update(layer.above(base_spans(layer.text)))
            else:
                depth[mark] = len(chain)
                chain.append(_Content(layer, mark, len(chain), base_spans(layer.text)))
            continue
        chain.pop()
        del depth[content.mark]
        if content.repeats == len(chain):
            known[content.mark] = content.found
        if not chain:
            return content.found
        chain[-1].repeats = min(chain[-1].repeats, content.repeats)
        chain[-1].found.update(content.place.above(content.found))


def scan(text: str) -> list[Span]:
    """All spans of one text: the base ones, and those of its layers under LAYER_KINDS, ordered by start, then kind."""
    base = base_spans(text)
    extra: set[Span] = set()
    if "%" in text or "\\" in text or _BASE64.search(text):
        extra = {(f"layer_{k}", s, e) for k, s, e in _all_spans(text, base).difference(base)}
    return sorted([*base, *extra], key=lambda x: (x[1], _ORDER[x[0]], x[2]))


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode(errors="surrogatepass"), digest_size=16).digest()


def _opened(text: str) -> Iterator[_Layer]:
    if "%" in text:
        yield from _escaped_layers(text, _URL)
    if "\\" in text:
        yield from _escaped_layers(text, _UNICODE)
    yield from _base64_layers(text)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


_SQL_TYPE = "struct<n_assign:bigint,n_access:bigint,n_hex:bigint,n_layer:bigint,base:string,spans:string>"


def _scanned(text: pa.Array) -> pa.Array:
    cols = [[] for _ in range(6)]
    for t in text.to_pylist():
        spans = scan(t or "")
        base = [x for x in spans if x[0] in KINDS]
        values = [sum(x[0] == k for x in base) for k in KINDS] + [len(spans) - len(base), joined(base), joined(spans)]
        for c, v in zip(cols, values, strict=True):
            c.append(v)
    kinds = [pa.int64()] * 4 + [pa.string()] * 2
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["n_assign", "n_access", "n_hex", "n_layer", "base", "spans"])


def scan_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the struct `found` for each row: counts by kind, base spans and all spans."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col(key).alias("key"), F.arrow_udf(_scanned, _SQL_TYPE)(F.col(text)).alias("found"))


def op9(docs: DataFrame) -> DataFrame:
    x = scan_documents(docs)
    f = F.col("found")
    return x.select(F.col("key").alias("doc_id"), f["n_assign"].alias("n_assign"), f["n_access"].alias("n_access"), f["n_hex"].alias("n_hex"), F.sha2(f["base"], 256).alias("base_sha256"), f["spans"].alias("spans"), f["n_layer"].alias("n_layer"))
