"""Secret scans with a worklist of decoded layers.

A text is scanned for the base kinds. Then every encoded stretch of it is unwrapped to a layer of
its own: lines with URL escapes, lines with Unicode or character escapes, base64 tokens, wrapped ones too, and what
those hold when it is compressed (gzip, zlib, bz2, xz). Each layer is scanned and unwrapped in
turn until nothing new comes out; a layer that was seen before at the same place of the text is not
opened again, so nests that contain themselves end. Each character of a layer carries the span of the original
text it came from, and what is found in a layer is reported by that span.

Defined cases: null and empty texts have no secrets; bytes of a
layer that are not printable text are NUL, and a layer without 16 printable characters side by side
is left alone; a compressed stretch is opened to its end, all its members: content over LAYER_BYTES is scanned
in blocks of that size that overlap by OVERLAP, so a bomb costs time and no memory, and only a nested layer
longer than the overlap can be missed, at the edge of such a block; a text is held whole in memory, with some
16 bytes for each character of a layer; time goes with the length of lines; rows may repeat; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import itertools
import lzma
import re
import zlib
from array import array
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import shared

LAYER_BYTES, OVERLAP = 16 << 20, 1 << 20
CHUNK_BYTES = 1 << 20

#: The base patterns and their least lengths.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
KINDS = ("assign", "access", "hex")

_KEYWORD = ("passw", "secret", "token", "apikey", "api_key")
_URL = re.compile(r"%[0-9A-Fa-f]{2}")
_URL_RUN = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPED = re.compile(r"\\u\{?[0-9A-Fa-f]|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9xX]")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|(?:\\x[0-9A-Fa-f]{2})+|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:[\x20\t]*\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)+={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_=-]+")
#: From what may be the first bytes of gzip, zlib, bz2 or xz, as URL escapes or character escapes write them, to the token's end.
_URL_PACKED = re.compile(r"(?:%1[fF]%8[bB]|(?:x|%78)%(?:01|5[eE]|9[cC]|[dD][aA])|(?:x|%78)(?:\^|%5[eE])|BZh|%42%5[aA]%68|%[fF][dD](?:7|%37))(?:%[0-9A-Fa-f]{2}|[!$'()*+,./0-9:;=?@A-Z_a-z~-])*")
_HEX_PACKED = re.compile(r"(?:\\x1[fF]\\x8[bB]|(?:x|\\x78)(?:\^|\\x(?:01|5[eE]|9[cC]|[dD][aA]))|BZh|\\x42\\x5[aA]\\x68|\\x[fF][dD](?:7|\\x37))(?:\\x[0-9A-Fa-f]{2}|\\[nrt\\'\"]|[^\\\n])*")
_URL_UNIT = re.compile(r"%([0-9A-Fa-f]{2})()|.", re.S)
_HEX_UNIT = re.compile(r"\\x([0-9A-Fa-f]{2})|\\([nrt\\'\"])|.", re.S)
_NAMED = {"n": b"\n", "r": b"\r", "t": b"\t"}
#: What can't be text: control characters, and bytes that are not UTF-8.
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f�\udc80-\udcff]")
#: No secret of a base kind, and no stretch that hides one, is shorter.
_PRINTED = re.compile(r"[^\x00]{16}")

Span = tuple[int, int, int]


def scan(text: str) -> list[Span]:
    """(start, kind, end) of the base secrets of one layer."""
    found: list[Span] = []
    low = text.lower()
    if any(k in low for k in _KEYWORD):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Layer:
    """Text with, for each character, the span of the original that it stands for; whole: one span for all of them."""

    def __init__(self, text: str, starts: array | None = None, ends: array | None = None, whole: tuple[int, int] | None = None):
        self.text, self.starts, self.ends, self.whole = text, starts, ends, whole

    def span(self, a: int, z: int) -> tuple[int, int]:
        if self.whole:
            return self.whole
        if self.starts is None:
            return a, z
        return self.starts[a], max(self.ends[a:z])

    def key(self) -> bytes:
        """A digest of the text and its places."""
        h = hashlib.sha256(self.text.encode("utf-8", "surrogatepass"))
        for places in (self.starts, self.ends, self.whole and array("q", self.whole)):
            h.update(places.tobytes() if places else b"")
        return h.digest()

    def rewritten(self, a: int, z: int, run: re.Pattern, decode) -> Layer | None:
        """text[a:z] with each match of run decoded in place; None if nothing decodes."""
        out: list[str] = []
        starts, ends = array("q"), array("q")
        at, changed = a, False

        def keep(p: int, q: int) -> None:
            out.append(self.text[p:q])
            if self.whole:
                return
            starts.extend(range(p, q) if self.starts is None else self.starts[p:q])
            ends.extend(range(p + 1, q + 1) if self.ends is None else self.ends[p:q])

        for m in run.finditer(self.text, a, z):
            keep(at, m.start())
            at = m.end()
            new = decode(m[0])
            if new is None:
                keep(m.start(), m.end())
                continue
            changed = True
            out.append(new)
            if self.whole:
                continue
            s, e = self.span(m.start(), m.end())
            # A run decodes character by character where its parts are of one width.
            even = len(m[0]) % len(new) == 0 if new else False
            for i in range(len(new)):
                if even:
                    step = len(m[0]) // len(new)
                    p, q = self.span(m.start() + i * step, m.start() + (i + 1) * step)
                else:
                    p, q = s, e
                starts.append(p)
                ends.append(q)
        if not changed:
            return None
        keep(at, z)
        return Layer("".join(out), whole=self.whole) if self.whole else Layer("".join(out), starts, ends)


def _url(run: str) -> str | None:
    try:
        return _CONTROL.sub("\0", bytes.fromhex(run.replace("%", "")).decode("utf-8", "surrogateescape"))
    except UnicodeDecodeError:
        return None


def _escape(run: str) -> str | None:
    try:
        if run[:3] == "\\u{":
            return chr(int(run[3:-1], 16))
        if run[:2] == "\\u":
            units = bytes.fromhex(run.replace("\\u", ""))
            return units.decode("utf-16-be")
        if run[:2] == "\\U":
            return chr(int(run[2:], 16))
        if run[:2] == "\\x":
            return _CONTROL.sub("\0", bytes.fromhex(run.replace("\\x", "")).decode("utf-8", "surrogateescape"))
        code = int(run[3:-1], 16) if run[2] in "xX" else int(run[2:-1])
        return chr(code)
    except (ValueError, OverflowError):
        return None


def _decompressor(raw: bytes):
    """A new decompressor for what raw begins with, or None."""
    if raw[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if raw[:1] == b"\x78" and len(raw) > 2 and (raw[0] * 256 + raw[1]) % 31 == 0:
        return zlib.decompressobj()
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if raw[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


class _Content:
    """The content of compressed bytes, all members of it, in blocks; used: how many of the bytes were read so far."""

    def __init__(self, raw: bytes):
        self.raw, self.used = raw, 0

    def __iter__(self):
        raw = self.raw
        while (tool := _decompressor(raw)) is not None:
            data = raw
            try:
                while not tool.eof:
                    part = tool.decompress(data, LAYER_BYTES)
                    # zlib gives back what it hasn't read; the others keep it.
                    data = getattr(tool, "unconsumed_tail", b"")
                    if tool.eof or part:
                        # Zeros may fill the space between members.
                        raw = tool.unused_data.lstrip(b"\0") if tool.eof else raw
                        self.used = len(self.raw) - (len(raw) if tool.eof else 0)
                        yield part
                    elif not data and getattr(tool, "needs_input", True):
                        return
            except (zlib.error, OSError, lzma.LZMAError, EOFError):
                return


def _opened(raw: bytes) -> tuple[Iterable[bytes], int]:
    """What is in raw when it is compressed, however often, in blocks; and how many of its bytes were, 0 if it wasn't."""
    packed, seen = 0, set()
    while hash(raw) not in seen:
        content = _Content(raw)
        blocks = iter(content)
        held, size = [], 0
        for part in blocks:
            held.append(part)
            size += len(part)
            if size > LAYER_BYTES:
                return _overlapping(itertools.chain(held, blocks)), packed or len(raw)
        if not held:
            break
        seen.add(hash(raw))
        packed = packed or content.used
        raw = b"".join(held)
    return [raw], packed


def _overlapping(parts: Iterable[bytes]):
    held = b""
    for part in parts:
        held += part
        if len(held) >= LAYER_BYTES:
            yield held
            held = held[-OVERLAP:]
    yield held


def _plain(raw: bytes) -> tuple[str, str] | None:
    """The bytes as characters, a lone one for each that is not UTF-8, and the same with NUL for what isn't text; None if no text is left."""
    whole = raw.decode("utf-8", "surrogateescape")
    text = _CONTROL.sub("\0", whole)
    return (whole, text) if _PRINTED.search(text) else None


def _spread(blocks: Iterable[bytes], s: int, e: int):
    """Layers of bytes that stand for one span as a whole."""
    for raw in blocks:
        if plain := _plain(raw):
            yield Layer(plain[1], whole=(s, e))


def _unbased(layer: Layer, places) -> Iterable[Layer]:
    """The layers in the base64 characters at these places of this one."""
    token = (layer.text[places.start : places.stop] if isinstance(places, range) else "".join(map(layer.text.__getitem__, places))).rstrip("=").replace("-", "+").replace("_", "/")
    if len(token) % 4 == 1:
        token = token[:-1]
    try:
        raw = base64.b64decode(token + "=" * (-len(token) % 4), validate=True)
    except (binascii.Error, ValueError):
        return
    opened, packed = _opened(raw)
    if packed or layer.whole:
        yield from _spread(opened, *layer.span(places[0], places[-1] + 1))
        return
    plain = _plain(raw)
    if plain is None:
        return
    starts, ends, at = array("q"), array("q"), 0
    for c in plain[0]:
        size = 1 if c < "\x80" else len(c.encode("utf-8", "surrogateescape"))
        p, q = layer.span(places[at * 4 // 3], places[min(len(places), (at + size) * 4 // 3 + 1) - 1] + 1)
        starts.append(p)
        ends.append(q)
        at += size
    yield Layer(plain[1], starts, ends)


def _bodies(m: re.Match):
    """Places of the characters of base64 that may go on over lines: from each line whose width differs from the one before, lines of one width and a last shorter one."""
    lines = [(x.start() + m.start(), x.end() + m.start()) for x in _LINE.finditer(m[0])]
    width = [z - a for a, z in lines]
    for k in range(len(lines) - 1):
        # A first line may begin or be cut within the token, so it need not have the width of the others.
        if k and width[k] == width[k - 1]:
            continue
        z = k + 2
        while z < len(lines) and width[z] == width[k + 1]:
            z += 1
        if z < len(lines) and width[z] < width[k + 1]:
            z += 1
        yield [i for p, q in lines[k:z] for i in range(p, q)]


def _units(m: re.Match, unit: re.Pattern) -> tuple[bytes, list[int]]:
    """The bytes of a stretch of URL or character escapes, and for each the place where it ends."""
    out, ends = bytearray(), []
    for x in unit.finditer(m[0]):
        new = bytes.fromhex(x[1]) if x[1] else _NAMED.get(x[2], (x[2] or x[0]).encode("utf-8", "surrogatepass"))
        out += new
        ends += [m.start() + x.end()] * len(new)
    return bytes(out), ends


def _lines_with(text: str, mark: re.Pattern):
    """Start and end of each line that has the mark: found first, then widened, so a line is read once."""
    at = 0
    while m := mark.search(text, at):
        a, z = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
        z = len(text) if z < 0 else z
        yield a, z
        at = z


def unwrap(layer: Layer):
    """The layers that lie directly in this one."""
    text = layer.text
    if "%" in text:
        for a, z in _lines_with(text, _URL):
            if new := layer.rewritten(a, z, _URL_RUN, _url):
                yield new
    if "\\" in text or "&#" in text:
        for a, z in _lines_with(text, _ESCAPED):
            if new := layer.rewritten(a, z, _ESCAPE, _escape):
                yield new
    for sign, pattern, unit in (("%", _URL_PACKED, _URL_UNIT), ("\\x", _HEX_PACKED, _HEX_UNIT)):
        for m in pattern.finditer(text) if sign in text else ():
            raw, ends = _units(m, unit)
            opened, packed = _opened(raw)
            if packed:
                yield from _spread(opened, *layer.span(m.start(), ends[packed - 1]))
    for m in _BASE64.finditer(text):
        yield from _unbased(layer, range(m.start(), m.end()))
    for m in _WRAPPED.finditer(text):
        for places in _bodies(m):
            yield from _unbased(layer, places)


def secrets(text: str) -> tuple[list[Span], list[Span]]:
    """(base, all) spans of a text, each sorted by start, kind and end."""
    top = Layer(text)
    base = scan(text)
    found, seen, work = set(base), set(), [top]
    while work:
        for layer in unwrap(work.pop()):
            key = layer.key()
            if key in seen:
                continue
            seen.add(key)
            work.append(layer)
            for a, kind, z in scan(layer.text):
                s, e = layer.span(a, z)
                found.add((s, kind, e))
    return base, sorted(found)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in spans)


def _find(batches):
    for batch in batches:
        for part in shared.chunks(batch, "text", CHUNK_BYTES):
            counts: list[list[int]] = [[], [], []]
            digests, spans = [], []
            for text in part.column(1).to_pylist():
                base, all_ = secrets(text or "")
                for k in range(3):
                    counts[k].append(sum(x[1] == k for x in base))
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(all_))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )


def find_secrets(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(_find, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(shared.read_table(spark, sf_dir, "documents"))
