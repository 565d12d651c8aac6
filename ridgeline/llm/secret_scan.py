"""Secret scans with structural confirmation.

Three base patterns find assignments, access keys and long hex strings. Beside them, base64 and hex
candidates are decoded and reported only if what they hold parses: a DER private key whose nested
lengths all fit, an OpenSSH key container whose length-prefixed fields fit, or a signed token whose
header and payload are JSON objects with an algorithm. Keys may be wrapped in any way: over lines, with
line ends written out as in JSON, indented, quoted, set apart by blanks, and as base64 of a PEM block. Null texts are empty; spans are in code
points, with exclusive ends.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Callable
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds in the order that breaks ties of equal starts; the first three are the base ones.
KINDS = ("assign", "access", "hex", "key", "token")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: Where the base64 of a DER sequence, of an OpenSSH container or of a PEM block may begin, and their hexadecimal: all have fixed first bits.
_STARTS = re.compile(r"M[A-P]|b3Bl|LS0tLS1CRUdJTi")
_HEX_STARTS = re.compile(r"30[0-9A-Fa-f]{4}|6[Ff]70656[Ee]")
#: What may stand between the pieces of a wrapped key: line ends of any kind, written out as well, blanks, and marks of quotes and comments.
_BETWEEN = r"(?:[\x20\t\r\n]|\\+[nrt]|(?<=[\x20\t\r\n>|#*])[>|#*])+"
_PIECES = re.compile(rf"({_BETWEEN})|(?!-----)[A-Za-z0-9+/_-]+")
_HEX_PIECES = re.compile(rf"({_BETWEEN})|[0-9A-Fa-f]+")
#: Base64 of "{" and a quote or white space, as JSON objects begin.
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(e[yw][A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
_LONG = 32  # what the hexadecimal patterns need in a word at least


Read = Callable[[int, int], bytes]
#: No private key has more elements in a sequence.
_MOST_ELEMENTS = 10


def _elements(read: Read, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the DER elements that fill at to end exactly; None if they don't. Only their heads are read."""
    out = []
    while at < end:
        head = read(at, min(at + 6, end))
        if len(head) < 2 or len(out) == _MOST_ELEMENTS:
            return None
        n, at = head[1], at + 2
        if n & 0x80:
            width = n & 0x7F
            if not 1 <= width <= 4 or len(head) < 2 + width:
                return None
            n = int.from_bytes(head[2 : 2 + width], "big")
            at += width
        if n > end - at:
            return None
        out.append((head[0], at, at + n))
        at += n
    return out


def key_end(read: Read, size: int) -> int | None:
    """Where the private key ends that the bytes begin with: PKCS#1, PKCS#8 or EC in DER, or an OpenSSH container. None if there is none.

    read(a, b) gives some of the size bytes. A container whose fields after the number of keys don't fit takes all.
    """
    if read(0, 15) == b"openssh-key-v1\0":
        at = 15
        for _ in range(3):  # cipher, key derivation, its options
            if size - at < 4 or (n := int.from_bytes(read(at, at + 4), "big")) > size - at - 4:
                return None
            at += 4 + n
        keys = int.from_bytes(read(at, at + 4), "big") if size - at >= 4 else 0
        if not 1 <= keys <= 16:
            return None
        at += 4
        for _ in range(keys + 1):  # the public keys, then the private ones
            if size - at < 4 or (n := int.from_bytes(read(at, at + 4), "big")) > size - at - 4:
                return size
            at += 4 + n
        return at
    head = read(0, 6)
    if len(head) < 6 or head[0] != 0x30:
        return None
    width = head[1] & 0x7F if head[1] & 0x80 else 0
    if width > 4 or head[1] == 0x80:
        return None
    start = 2 + width
    end = start + (int.from_bytes(head[2:start], "big") if width else head[1])
    inner = _elements(read, start, end) if end <= size else None
    if not inner or inner[0][0] != 2 or len(inner) < 3:
        return None
    tags = [x[0] for x in inner]
    if len(tags) >= 9 and set(tags[:9]) == {2}:
        return end  # PKCS#1: version and eight integers
    if tags[1:3] == [0x30, 0x04]:
        algorithm = _elements(read, *inner[1][1:])
        return end if algorithm and algorithm[0][0] == 6 else None  # PKCS#8: an algorithm's identifier, then the key
    return end if tags[1] == 0x04 and set(tags[2:]) <= {0xA0, 0xA1} else None  # EC: the key, then parameters and point


def is_private_key(data: bytes) -> bool:
    """Whether the bytes are a private key in DER, and nothing else, or begin with an OpenSSH container."""
    end = key_end(lambda a, b: data[a:b], len(data))
    return end is not None and (end == len(data) or data[:1] == b"o")


def _base64(run: str) -> bytes:
    run = run.rstrip("=").translate({45: "+", 95: "/"})
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


class _Run:
    """The pieces of base64 or hexadecimal from a place on, as one string of digits that knows where each one stands."""

    def __init__(self, text: str, at: int, pieces: re.Pattern, bits: int):
        self.bits, starts, counts, own, total, end = bits, [], [], [], 0, at
        for m in pieces.finditer(text, at):
            if m.start() != end:
                break
            end = m.end()
            if m[1] is None:
                starts.append(m.start())
                counts.append(total)
                own.append(m[0])
                total += len(m[0])
        self.starts, self.counts, self.digits, self.end = starts, counts, "".join(own), end

    def index(self, at: int) -> int:
        i = bisect_right(self.starts, at) - 1
        return self.counts[i] + at - self.starts[i]

    def place(self, digit: int) -> int:
        i = bisect_right(self.counts, digit) - 1
        return self.starts[i] + digit - self.counts[i]

    def ends_piece(self, digit: int) -> bool:
        """Whether a piece ends before this digit."""
        return digit == len(self.digits) or self.counts[bisect_right(self.counts, digit) - 1] == digit

    def bytes_from(self, first: int) -> tuple[Read, int]:
        """A reader of the bytes that the digits from first on stand for, and their number."""
        bits, digits = self.bits, self.digits

        def read(a: int, b: int) -> bytes:
            if bits == 4:
                own = digits[first + 2 * a : first + 2 * b]
                return bytes.fromhex(own[: len(own) // 2 * 2])
            i = a // 3 * 4
            own = digits[first + i : first - (-b // 3) * 4]
            return _base64(own[: len(own) - (len(own) % 4 == 1)])[a % 3 : a % 3 + b - a]

        return read, (len(digits) - first) * bits // 8


_PEM_END = re.compile(rb"-----END[A-Z0-9 ]*-----")


def _pem_end(run: _Run, first: int) -> int | None:
    """The digit after base64 of a whole PEM block that holds a key. Reads up to the block's end, or the begin of another one."""
    read, size = run.bytes_from(first)
    data, seen = bytearray(), 0
    while len(data) < size:
        more = read(len(data), len(data) + 3 * 1024)
        data += more
        if not more or not more.isascii() or data.find(b"-----BEGIN", max(1, seen)) > 0:
            return None
        if m := _PEM_END.search(data, seen):
            text = data[: m.end()].decode()
            return min(first - (-4 * len(text) // 3), len(run.digits)) if _keys(text, _STARTS, _PIECES, 6) else None
        seen = max(0, len(data) - 100)
    return None


def _inside(text: str, at: int, bits: int) -> bool:
    """Whether a place is within a word of digits: behind a letter, unless that is the end of an escape, or the like."""
    before = text[at - 1] if at else " "
    within = before.isascii() and (before.isalnum() or bits == 6 and before in "+_-")
    return within and not (before in "nrt" and text[at - 2 : at - 1] == "\\")


def _keys(text: str, begins: re.Pattern, pieces: re.Pattern, bits: int) -> list[tuple[int, int]]:
    """Spans of keys in base64 (6 bits a digit) or hexadecimal (4), over any number of lines.

    A run of pieces is gathered once, whatever begins in it; only the heads of a key's elements are decoded, so time
    is in proportion to the text. A key ends where its lengths say: other text may follow it.
    """
    out, at, run = [], 0, None
    while m := begins.search(text, at):
        start = m.start()
        if _inside(text, start, bits):
            at = start + 1
            continue
        if run is None or start >= run.end:
            run = _Run(text, start, pieces, bits)
        first = run.index(start)
        if m[0] == "LS0tLS1CRUdJTi":
            end = _pem_end(run, first)
        else:
            n = key_end(*run.bytes_from(first))
            end = None if n is None else first - (-8 * n // bits)
            if end is not None and bits == 4 and not run.ends_piece(end):
                end = None  # hexadecimal goes on: some other number
        if end is None:
            at = start + 1
            continue
        at = run.place(end - 1) + 1
        while bits == 6 and text[at : at + 1] == "=":
            at += 1
        out.append((start, at))
    return out


def _is_token(header: str, payload: str) -> bool:
    try:
        h, p = json.loads(_base64(header)), json.loads(_base64(payload))
    except (ValueError, RecursionError):
        return False
    return isinstance(h, dict) and isinstance(h.get("alg"), str) and isinstance(p, dict)


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all findings, by start and then kind. A text of any length is read whole; an empty one has none."""
    out, low = [], text.lower()
    if "pass" in low or "secret" in low or "token" in low or "api" in low:
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [("key", *x) for x in _keys(text, _STARTS, _PIECES, 6) + _keys(text, _HEX_STARTS, _HEX_PIECES, 4)]
    if max(map(len, text.split()), default=0) >= _LONG:
        out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    if "ey" in text or "ew" in text:
        out += [("token", *m.span()) for m in _TOKEN.finditer(text) if _is_token(m[1], m[2])]
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(set(out), key=lambda x: (x[1], order[x[0]], x[2]))


def scan_column(text: Column) -> Column:
    """array<struct(kind, start, end)> of each text: empty for a null one. Equal texts give equal arrays; no other column is read."""

    @F.pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def found(batches: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in spans(x)] for x in batches.fillna("")])

    return found(text)


def digest_column(text: Column) -> Column:
    """struct(n_assign, n_access, n_hex, base_sha256, spans) of each text, a null one as empty. No other column is read."""

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def digests(batches: pd.Series) -> pd.DataFrame:
        rows = []
        for x in batches.fillna(""):
            found = spans(x)
            base = ",".join(f"{k}:{a}:{b}" for k, a, b in found if k in KINDS[:3])
            n = [sum(k == kind for k, _, _ in found) for kind in KINDS[:3]]
            rows.append((*n, sha256(base.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for k, a, b in found)))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return digests(text)
