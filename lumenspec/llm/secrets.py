"""Secret scan over a text and every layer that can be decoded inside it.

A worklist holds layers. Each layer is scanned with the base patterns, and
its URL, Unicode-escape, base64 and compressed parts are decoded into new
layers until nothing new appears. Each decoded character remembers the span
of the original text that it came from.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import lzma
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspec.llm.common import shared_dir, ship

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # the key id with its prefix has 16 characters or more
HEX = re.compile(r"[0-9a-f]{32,}")
ESCAPE = re.compile(r"\\u\{([0-9a-fA-F]{1,6})\}|\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})")
ENCODED = re.compile(r"%[0-9A-Fa-f]{2}")
PRINTED = re.compile(r"[!-~]+")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 that is wrapped at 60 to 76 columns.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{60,76}\r?\n)+[A-Za-z0-9+/]+={0,2}")
PART = re.compile(r"[A-Za-z0-9+/]{16,}={0,2}")
#: Characters of a decompressed layer that are scanned at a time, and the place up to which: behind a character that stands in no match, escape or encoded
#: part of any layer, or a line's end that follows a blank too closely for wrapped base64.
PIECE = 1 << 20
CUT = re.compile(r""".*(?:[^A-Za-z0-9+/_.=\-"' :%\\{}\r\n]| [^\n]{0,58}\n)""", re.DOTALL)
#: Characters without such a place that are held at most, and how many of them the next piece begins with again.
LONGEST, OVERLAP = 1 << 22, 1 << 20
#: What follows the first sign of an escape that stands for the first sign of another one, and of any escape, by that sign.
AGAIN = {"%": re.compile(r"25|5[Cc]"), "\\": re.compile(r"u\{0{0,4}(?:25|5[Cc])\}|u00(?:25|5[Cc])|x(?:25|5[Cc])")}
VALID = {"%": re.compile(r"[0-9A-Fa-f]{2}"), "\\": re.compile(r"u\{(?:0{0,5}[0-9A-Fa-f]{1,4}|0?[0-9A-Fa-f]{5}|10[0-9A-Fa-f]{4})\}|u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2}")}
#: The shortest text that holds a match or an encoded part.
LEAST = 14
HEX_DIGITS = frozenset("0123456789abcdefABCDEF")


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, leftmost and non-overlapping per kind."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8] if "=" in text or ":" in text else []
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def _text(data: bytes) -> str:
    """The bytes as text, each byte that is no UTF-8 standing for itself."""
    return data.decode("utf-8", "surrogateescape")


def _decompressor(data: bytes):
    for magic, new in ((b"\x1f\x8b", lambda: zlib.decompressobj(31)), (b"\x78", lambda: zlib.decompressobj(15)), (b"BZh", bz2.BZ2Decompressor), (b"\xfd7zXZ", lzma.LZMADecompressor)):
        if data.startswith(magic):
            return new()
    return None


def _inflated(data: bytes):
    """The decompressed text of all members (gzip, zlib, bzip2, xz) in pieces of about PIECE characters, between which nothing lies that could be found; LONGEST characters that have no place to be cut are cut with an OVERLAP."""
    text, decode = "", codecs.getincrementaldecoder("utf-8")("surrogateescape").decode
    while (member := _decompressor(data)) is not None:
        try:
            while True:
                raw = member.decompress(data, PIECE)
                new = decode(raw)
                text += new
                data = getattr(member, "unconsumed_tail", b"")
                if len(text) >= PIECE:
                    cut = CUT.match(text, max(0, len(text) - len(new) - 60))
                    if cut:
                        yield text[: cut.end()]
                        text = text[cut.end() :]
                    elif len(text) >= LONGEST:
                        yield text
                        text = text[-OVERLAP:]
                if member.eof or not (raw or data):
                    break
        except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
            break
        data = member.unused_data
    if text:
        yield text


def _char(code: int) -> str | None:
    return None if code > 0x10FFFF or 0xD800 <= code < 0xE000 else chr(code)


def _ended(out: list[str]) -> tuple[str, int] | None:
    """What the escape that the last characters form stands for, and their number."""
    last = out[-1]
    if last == "}":
        k = len(out) - 2
        while k >= 0 and len(out) - k < 9 and out[k] in HEX_DIGITS:
            k -= 1
        digits = "".join(out[k + 1 : -1])
        new = _char(int(digits, 16)) if k >= 2 and 1 <= len(digits) <= 6 and out[k - 2 : k + 1] == ["\\", "u", "{"] else None
        return (new, len(digits) + 4) if new else None
    if last not in HEX_DIGITS or len(out) < 3 or out[-2] not in HEX_DIGITS:
        return None
    if out[-3] == "%":
        code = int(out[-2] + last, 16)
        return chr(code if code < 0x80 else 0xDC00 + code), 3
    if out[-3] == "x" and out[-4:-3] == ["\\"]:
        return chr(int(out[-2] + last, 16)), 4
    if out[-6:-4] == ["\\", "u"] and out[-4] in HEX_DIGITS and out[-3] in HEX_DIGITS:
        new = _char(int("".join(out[-4:]), 16))
        return (new, 6) if new else None
    return None


def _settled(text: str) -> tuple[str, np.ndarray, np.ndarray] | None:
    """The text without any escape, however deep they are nested: characters go on a stack, and those that form an escape are replaced there.

    An escape holds no blanks, so only the printed runs that hold one are gone through.
    """
    parts, starts, ends = [], [], 0
    for m in PRINTED.finditer(text):
        if not (ENCODED.search(m[0]) or ESCAPE.search(m[0])):
            continue
        parts.append(text[ends : m.start()])
        starts.append(np.arange(ends, m.start()))
        out, at = [], []
        for k, c in enumerate(m[0], m.start()):
            out.append(c)
            at.append(k)
            while (got := _ended(out)) is not None:
                new, n = got
                del out[-n:], at[1 - n :]
                out.append(new)
        parts.append("".join(out))
        starts.append(np.array(at, np.int64))
        ends = m.end()
    if not parts:
        return None
    first = np.concatenate([*starts, np.arange(ends, len(text))])
    joined = "".join(parts) + text[ends:]
    data = joined.encode("utf-8", "surrogateescape")
    width = _widths(joined)
    spans = np.repeat(np.stack([first, np.append(first[1:], len(text))], axis=1), width, axis=0)
    new = _text(data)
    return new, *_by_bytes(new, spans)


def _code(m: re.Match) -> int | None:
    """The character that a Unicode escape stands for, if there is one."""
    code = int(m[1] or m[2] or m[3], 16)
    return None if code > 0x10FFFF or 0xD800 <= code < 0xE000 else code


def _escaped(text: str) -> bool:
    return "\\" in text and any(_code(m) is not None for m in ESCAPE.finditer(text))


def _layers(text: str):
    """(decoded text, start and end in ``text`` of each decoded character, whether it is the last) of each encoded part, one step down.

    Of escapes that stand for nothing but further escapes, many steps are gone down at once; what the layers skipped hold beyond
    their neighbours comes with the step, matches as (None, starts, ends, False).
    """
    for layer in _base64_parts(text):
        yield *layer, False
    todo = [(m.start(), m.end()) for m in PRINTED.finditer(text) if ENCODED.search(m[0])] if ENCODED.search(text) else []
    unicode = _escaped(text)
    for k, (a, b) in enumerate(todo, 1):
        got = _chains(text, "%") if b - a == len(text) else None
        if got:
            yield from _skipped(text, got[1])
        yield *(_unnested(text, *got) if got else _url(text, a, b)), k == len(todo) and not unicode
    if unicode:
        got = _chains(text, "\\")
        if got:
            yield from _skipped(text, got[1])
        yield *(_unnested(text, *got) if got else _unicode(text)), True


def _url(text: str, a: int, b: int):
    """The layer of one printed part with URL escapes."""
    part = text[a:b]
    data = np.frombuffer(part.encode(), np.uint8).copy()
    step = np.ones(len(part), np.int64)
    codes = np.fromiter((x.start() for x in ENCODED.finditer(part)), np.int64)
    digits = lambda k: (data[k] & 15) + 9 * (data[k] > 57)
    data[codes] = 16 * digits(codes + 1) + digits(codes + 2)
    step[codes + 1] = step[codes + 2] = 0
    step[codes] = 3
    at = np.flatnonzero(step)
    new = _text(data[at].tobytes())
    return new, *_by_bytes(new, a + np.stack([at, at + step[at]], axis=1))


def _unicode(text: str):
    """The layer of all Unicode escapes."""
    ends, parts, spans = 0, [], []
    for m in ESCAPE.finditer(text):
        code = _code(m)
        if code is None:
            continue
        plain = np.arange(ends, m.start())
        parts += [text[ends : m.start()], chr(code)]
        spans += [np.stack([plain, plain + 1], axis=1), np.array([[m.start(), m.end()]])]
        ends = m.end()
    plain = np.arange(ends, len(text))
    both = np.concatenate([*spans, np.stack([plain, plain + 1], axis=1)])
    return "".join(parts) + text[ends:], both[:, 0], both[:, 1]


def _chains(text: str, sign: str) -> tuple[str, list[np.ndarray]] | None:
    """How far all escapes that begin with ``sign`` stand for further escapes only: the sign that they begin with after these steps, and for each
    escape its place and where its code begins after 0, 1, 2, ... steps. None if that is less than two steps.

    After each step all of them begin with the same sign. Escapes with the other sign stand still meanwhile; they commute with the steps, so what both come to
    is found from the layers at the ends of the steps. Where the sign changes, no escape may stand still with the new one, and for URL escapes the text must be one printed part.
    """
    signs, most, found = "", None, []
    for m in (ENCODED if sign == "%" else ESCAPE).finditer(text):
        if sign == "\\" and _code(m) is None:
            continue
        own, q = sign, m.start() + 1
        at, heads = [m.start(), q], []
        while most is None or len(heads) < most:
            x = AGAIN[own].match(text, q)
            if x is None:
                break
            new = "%" if "25" in x[0] else "\\"
            if VALID[new].match(text, x.end()) is None or most is not None and signs[len(heads)] != new:
                break
            own, q = new, x.end()
            heads.append(new)
            at.append(q)
        if len(heads) < 2:
            return None
        if most is None:
            signs = "".join(heads)
            turn = next((k for k, x in enumerate(signs, 1) if x != sign), 0)
            if turn and (PRINTED.fullmatch(text) is None or (ENCODED.search(text) is not None if sign == "\\" else _escaped(text))):
                signs = signs[:turn]
        most = min(len(heads), len(signs))
        if most < 2:
            return None
        found.append(np.array(at, np.int64))
    return (signs[most - 1], [x[: most + 2] for x in found]) if found else None


def _unnested(text: str, sign: str, chains: list[np.ndarray]):
    """The layer at the end of the steps: each escape is down to its last code, which ``sign`` begins."""
    keep = np.ones(len(text), bool)
    parts, ends = [], 0
    for at in chains:
        parts += [text[ends : at[0]], sign]
        ends = int(at[-1])
        keep[at[0] + 1 : ends] = False
    starts = np.flatnonzero(keep)
    return "".join(parts) + text[ends:], starts, np.append(starts[1:], len(text))


def _skipped(text: str, chains: list[np.ndarray]):
    """What the layers between the first and the last of such steps hold beyond those.

    The first signs of escapes lie in no match and no encoded part, so only what begins right behind one is new, where a code begins. Codes of signs
    hold no first letter of an assignment or access key, so what is new is runs of hex digits and base64. For each end, the parts that begin
    there and a multiple of four characters further decode to the same bytes but for the first ones. Of those, only what
    precedes the first character that no match, escape or part can hold is new.
    """
    q = np.sort(np.concatenate([at[2:-1] for at in chains]))
    points = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128)

    def ends(which: str) -> np.ndarray:
        table = np.zeros(129, bool)
        table[[k for k in range(128) if re.match(which, chr(k))]] = True
        out = np.append(np.flatnonzero(~table[points]), len(text))
        return out[np.searchsorted(out, q)]

    hexes = ends("[0-9a-f]")
    long = hexes - q >= 32
    if long.any():
        yield None, q[long], hexes[long], False
    whole, plain = ends("[A-Za-z0-9+/_-]"), ends("[A-Za-z0-9+/]")
    for e, own in [(e, whole == e) for e in np.unique(whole[whole - q >= 16])] + [(e, (plain == e) & (whole > e)) for e in np.unique(plain[(plain - q >= 16) & (whole > plain)])]:
        begins = q[own & (e - q >= 16)]
        pads = len(re.compile("={0,2}").match(text, e)[0])
        for k in (0, 2, 3):
            if len(same := begins[(e - begins) % 4 == k]):
                for layer in _suffixes(text[same[0] : e + pads], same - same[0], int(same[0])):
                    yield *layer, False
    broken = np.append(np.isin(points, (10, 13)), False)
    for a in q[broken[plain] & (plain - q <= 76)]:
        if m := WRAPPED.search(text, a):
            for layer in _wrapped(m):
                yield *layer, False


def _suffixes(part: str, begins: np.ndarray, first: int):
    """The layers of base64 parts that end together and begin at ``begins`` (the first at 0, the others at multiples of four), of which the longest is ``part``; it stands at ``first``."""
    data = base64.b64decode((body := part.rstrip("=").replace("-", "+").replace("_", "/")) + "=" * (-len(body) % 4), validate=True)
    own = np.append(np.frombuffer(data, np.uint8), [0, 0]).astype(np.int64)
    begin = begins // 4 * 3
    one, two = own[begin], own[begin + 1]
    packed = (one == 0x1F) & (two == 0x8B) | (one == 0x78) & ((0x7800 + two) % 31 == 0) | (one == 0x42) & (two == 0x5A) | (one == 0xFD) & (two == 0x37)
    raw = np.flatnonzero(~packed)
    for k in [*np.flatnonzero(packed), *raw[:1]]:
        yield from _base64(part[begins[k] :], np.arange(first + begins[k], first + len(part)))
    stops = np.append(np.flatnonzero((own[:-2] > 0x7E) | (own[:-2] < 0x20) & (own[:-2] != 10) & (own[:-2] != 13)), len(data))
    stop = stops[np.searchsorted(stops, begin)]
    for k in raw[1:]:
        if stop[k] - begin[k] >= LEAST:
            j = np.arange(begin[k], stop[k])
            yield data[begin[k] : stop[k]].decode("ascii"), first + j * 4 // 3, first + np.minimum((j * 4 + 7) // 3, len(part))


def _base64_parts(text: str):
    for m in BASE64.finditer(text):
        yield from _base64(m[0], np.arange(m.start(), m.end()))
        for x in PART.finditer(m[0]):  # words may be glued on by signs of the URL-safe alphabet
            if len(x[0]) < len(m[0]):
                yield from _base64(x[0], np.arange(m.start() + x.start(), m.start() + x.end()))
    if "\n" in text:
        for m in WRAPPED.finditer(text):
            yield from _wrapped(m)


def _wrapped(m: re.Match):
    at = np.array([k for k, c in enumerate(m[0], m.start()) if c not in "\r\n"])
    yield from _base64(re.sub(r"[\r\n]", "", m[0]), at)


def _base64(part: str, at: np.ndarray):
    """The layers of a base64 part whose characters stand at ``at``: its bytes as text, or what they decompress to."""
    body = part.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return
    try:
        data = base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return
    packed = False
    for piece in _inflated(data):
        packed = True
        yield piece, np.broadcast_to(at[0], len(piece)), np.broadcast_to(at[-1] + 1, len(piece))
    if not packed:
        new = _text(data)
        k = np.arange(len(data))
        yield new, *_by_bytes(new, np.stack([at[k * 4 // 3], at[np.minimum((k * 4 + 7) // 3, len(part)) - 1] + 1], axis=1))


def _widths(text: str) -> np.ndarray:
    """The bytes of each character; one that stands for a byte has one."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000) - 2 * ((code >= 0xDC80) & (code <= 0xDCFF))


def _by_bytes(text: str, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of characters from spans of their bytes."""
    if text.isascii():
        return spans[:, 0], spans[:, 1]
    width = _widths(text)
    ends = np.cumsum(width)
    return spans[ends - width, 0], spans[ends - 1, 1]


def _through(places: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The places at ``at``; where all are one, as in a compressed layer, it is held once."""
    return np.broadcast_to(places[at[0]], len(at)) if 0 in places.strides + at.strides else places[at]


def _mark(text: str, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """A digest of a text and of the place of each of its characters."""
    out = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16)
    for places in (starts, ends):
        out.update(np.ascontiguousarray(places if places.strides[0] else places[:1]))
    return out.digest()


def scan(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans) of a text, each by start, then kind, then end.

    Layers are unwrapped depth first, to the last one. Only the pieces on the
    way to the present one that hold further layers are held. A text that was
    seen at the same places, as in a cycle, isn't unwrapped again.
    """
    rank = {k: i for i, k in enumerate(KINDS)}
    by_place = lambda x: (x[1], rank[x[0]], x[2])
    base = sorted(find(text), key=by_place)
    # The same form may stand at several places, and several forms may hold one text: a layer is one text at its places.
    seen, found, todo = set(), set(base), [(_layers(text), None, None)]
    while todo:
        layers, starts, ends = todo[-1]
        layer = next(layers, None)
        if layer is None:
            todo.pop()
            continue
        new, s, e, last = layer
        if last:
            todo.pop()
        if starts is not None:
            s, e = _through(starts, s), _through(ends, e - 1)
        if new is None:  # matches of layers that were skipped
            found.update(("hex", a, b) for a, b in zip(s.tolist(), e.tolist(), strict=True))
            continue
        mark = _mark(new, s, e)
        if mark not in seen:
            seen.add(mark)
            found.update((kind, int(s[a]), int(e[b - 1])) for kind, a, b in find(new))
            todo.append((_layers(new), s, e))
    return base, sorted(found, key=by_place)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, base and spans as arrays of (kind, start, end), in code points, end exclusive.

    base holds the matches in the text itself, spans these and the ones found
    in decoded layers, mapped to the original text. Null and empty texts have
    none. Every row is scanned where it lies, whole; other columns are
    ignored. Compressed layers (gzip, zlib, bzip2, xz, all members) are
    decompressed and scanned in pieces, so their size is no matter of memory;
    all of such a layer has the span of its encoded form. Pieces end where
    nothing can be cut in two; only in a run of LONGEST characters without
    such a place (letters, digits, quotes, blanks and a few signs) a nested
    layer is found if it is no longer than OVERLAP or lies within a piece.
    Escapes within escapes are unwrapped to the last, and all layers between
    count. Steps in which escapes come to further escapes only are taken at
    once, in time and memory linear in the text; each other step scans the
    new layer whole.
    """
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    as_rows = lambda x: [{"kind": k, "start": s, "end": e} for k, s, e in x]

    def run(batches):
        for batch in batches:
            base, spans = [], []
            for text in batch.column(1):
                b, s = scan(text.as_py() or "")
                base.append(as_rows(b))
                spans.append(as_rows(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, span), pa.array(spans, span)], ["i", "base", "spans"])

    shared_dir(docs.sparkSession)
    kind = "array<struct<kind:string,start:long,end:long>>"
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, f"i long, base {kind}, spans {kind}").withColumnRenamed("i", id_col)


ship(__name__)
