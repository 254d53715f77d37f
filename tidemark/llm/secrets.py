"""Secret scans with structural confirmation.

Three kinds are taken as they are spelt: ``assign`` (a password, secret, token or key that
is set to a value), ``access`` (an access key id) and ``hex`` (a long hexadecimal run).
Further kinds are reported only when decoding shows the structure of a credential:

* ``jwt``: a signed token whose header and payload are JSON objects, with an ``alg``;
* ``der``: base64 or hex of an ASN.1 private key: a sequence whose nested lengths fill it
  exactly and that starts with a version number, followed by key material;
* ``ssh``: base64 of a private key container with its magic string and nested lengths;
* ``pem``: a private-key block whose body is one of the two above, an encrypted ASN.1 key
  (an algorithm of password-based encryption and the cipher text), or cipher text under
  ``Proc-Type`` and ``DEK-Info`` headers.

A key need not stand alone.  The body of a block may be escaped as in JSON, in a quoted
setting, or quoted in mail.  Base64 and hex that are wrapped into lines, with real or escaped
breaks, are read as one run, and in a run that is no key as a whole, keys are looked for wherever
their first bytes stand: the length that they state tells where they end, whatever is glued to either
side.  Lengths are followed from field to field first; only what they add up to is decoded, and
a key has ``MOST_FIELDS`` fields and ``MOST_BYTES`` bytes at most, more than any in use.  So the
work grows with the length of the text, whatever it says.

Spans are in code points, end exclusive.  Defined cases: a null text is empty; a text is
scanned whole; rows are judged one by one, so repeated rows get equal answers.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.frames import ID, plain_id, rows_of

KINDS = ("assign", "access", "hex", "jwt", "der", "ssh", "pem")
BASE = KINDS[:3]
# The patterns and least lengths of the base kinds.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE
)
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(rf"[0-9a-f]{{{HEX_LEAST},}}")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

TOKEN = re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
ENCODED = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
LONG_HEX = re.compile(r"[0-9A-Fa-f]{64,}")
BLOCK = re.compile(
    r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----((?:[A-Za-z0-9+/=\s\"',>]|\\+[nrt\"'/\s])++)-----END \1PRIVATE KEY-----"
)
# What may stand between the lines of one base64 text, and lines of 16 characters or more with it.
BREAK = re.compile(r"(?:[\s\"',>]|\\+[nrt\"'\s])++")
HEADED = re.compile(
    rf"-----BEGIN ([A-Z ]*)PRIVATE KEY-----{BREAK.pattern}Proc-Type: 4,ENCRYPTED{BREAK.pattern}DEK-Info: [A-Z0-9-]++,([0-9A-Fa-f]{{16,32}})"
    rf"{BREAK.pattern}((?:[A-Za-z0-9+/=\s\"',>]|\\+[nrt\"'/\s])++)-----END \1PRIVATE KEY-----"
)
HEX_LINES = re.compile(rf"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{{16,}}+{BREAK.pattern})++[0-9A-Fa-f]*+")
# The first bytes in hex: the same as below.
HEX_START = re.compile(r"30(?:[0-7][0-9a-f]|81..|82.{4}|83.{6}|84.{8})02010[01]")
WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{{16,}}+{BREAK.pattern})++[A-Za-z0-9+/_-]*+")
# The first bytes in base64: a sequence, its length in one to five bytes and a version of 0 or 1; the container's magic.
_X = "[A-Za-z0-9+/_-]"
KEY_START = re.compile(
    rf"M(?:I(?:[I-L]{_X}{{2}}[AQgw]IB|[E-H]{_X}AgE|[M-P]{_X}{{4}}CAQ|[Q-T]{_X}{{5}}AgE)|[B-H]{_X}CAQ)|b3BlbnNzaC1rZXktdjEA"
)
PADDING = re.compile("={0,2}")
_ESCAPED = re.compile(r"\\+[nrt]|[\s\\\"',>]")
MAGIC = b"openssh-key-v1\0"
MOST_FIELDS, MOST_BYTES = 32, 1 << 16
# Object identifiers of password-based encryption start so.
ENCRYPTION = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def _base64(text: str) -> bytes | None:
    plain = _ESCAPED.sub("", text).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _fields(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents when ASN.1 lengths fill the data exactly."""
    found, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at + size > len(data):
            return None
        found.append((tag, data[at : at + size]))
        at += size
    return found


def is_private_key(data: bytes | None) -> bool:
    """A sequence that holds a version and key material, all lengths nested right."""
    outer = _fields(data) if data and data[0] == 0x30 else None
    inner = _fields(outer[0][1]) if outer and len(outer) == 1 else None
    if not inner or len(inner) < 2 or inner[0][0] != 0x02 or len(inner[0][1]) != 1 or inner[0][1][0] > 1:
        return False
    for tag, content in inner[1:]:
        if tag & 0x20 and _fields(content) is None:
            return False
    return any(tag in (0x02, 0x04) and len(content) >= 16 for tag, content in inner[1:])


def is_encrypted_key(data: bytes | None) -> bool:
    """A sequence of an algorithm of password-based encryption and its cipher text."""
    outer = _fields(data) if data and data[0] == 0x30 else None
    inner = _fields(outer[0][1]) if outer and len(outer) == 1 else None
    if not inner or [tag for tag, _ in inner] != [0x30, 0x04] or len(inner[1][1]) < 16:
        return False
    algorithm = _fields(inner[0][1])
    return bool(algorithm) and algorithm[0][0] == 0x06 and algorithm[0][1].startswith(ENCRYPTION)


# Some bytes from a place on, fewer at the end.
Read = Callable[[int, int], bytes]


def _container_size(read: Read, length: int) -> int | None:
    """Bytes of a container at the start: cipher, derivation and options as
    strings with their lengths, a key count, the public keys and the private part.

    What follows the count may be cut short; then all of ``length`` is the container.
    """
    if read(0, len(MAGIC)) != MAGIC:
        return None

    def number(at: int) -> int | None:
        data = read(at, 4) if at + 4 <= length else b""
        return int.from_bytes(data, "big") if len(data) == 4 else None

    at = len(MAGIC)
    for _ in range(3):
        size = number(at)
        if size is None:
            return None
        at += 4 + size
    count = number(at)
    if count is None or not 1 <= count <= 16:
        return None
    at += 4
    for _ in range(count + 1):
        size = number(at)
        if size is None or at + 4 + size > length:
            return length
        at += 4 + size
    return at


def is_key_container(data: bytes | None) -> bool:
    return bool(data) and _container_size(lambda at, n: data[at : at + n], len(data)) is not None


def _header(read: Read, at: int) -> tuple[int, int] | None:
    """Where the content of the ASN.1 field at a place starts and ends."""
    head = read(at, 6)
    if len(head) < 2:
        return None
    if not head[1] & 0x80:
        return at + 2, at + 2 + head[1]
    n = head[1] & 0x7F
    if not 1 <= n <= 4 or len(head) < 2 + n:
        return None
    return at + 2 + n, at + 2 + n + int.from_bytes(head[2 : 2 + n], "big")


def _sequence_size(read: Read, length: int) -> int | None:
    """Bytes of the ASN.1 sequence at the start, if the lengths of its fields add up to its own."""
    outer = _header(read, 0)
    if outer is None or outer[1] > min(length, MOST_BYTES):
        return None
    at, end = outer
    for _ in range(MOST_FIELDS):
        field = _header(read, at)
        if field is None or field[1] > end:
            return None
        at = field[1]
        if at == end:
            return end
    return None


def _ends(data: bytes, last: str) -> bool:
    """Whether ``last`` is the last character that the data alone has."""
    tail = data[-(len(data) % 3 or 3) :]
    return base64.b64encode(tail).rstrip(b"=").decode()[-1] == last.replace("-", "+").replace("_", "/")


def _keys_inside(run: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the keys anywhere in a run of base64 characters without breaks."""
    at = 0
    while m := KEY_START.search(run, at):
        start, at = m.start(), m.start() + 1

        def read(place: int, n: int, start: int = start) -> bytes:
            first = place // 3
            data = _base64(run[start + 4 * first : start - (-(place + n) // 3) * 4]) or b""
            return data[place - 3 * first :][:n]

        length = (len(run) - start) * 3 // 4
        if run[start] == "M":
            size = _sequence_size(read, length)
            end = start + -(-(size or 0) * 4 // 3)
            data = _base64(run[start:end]) if size else None
            # Where a key ends inside a character, its other bits are 0; more bytes would set them.
            if data and is_private_key(data) and _ends(data, run[end - 1]):
                yield "der", start, end
                at = end
        else:
            # A single character over is no byte.
            end = len(run) - ((len(run) - start) % 4 == 1)
            size = _container_size(read, length)
            if size is not None:
                end = min(end, start + -(-size * 4 // 3))
                yield "ssh", start, end
                at = end


def _hex_keys_inside(run: str) -> Iterator[tuple[str, int, int]]:
    """The same in a run of hex digits; a key may start at any digit."""
    run, at = run.lower(), 0
    while m := HEX_START.search(run, at):
        start, at = m.start(), m.start() + 1

        def read(place: int, n: int, start: int = start) -> bytes:
            digits = run[start + 2 * place : start + 2 * (place + n)]
            return bytes.fromhex(digits[: len(digits) // 2 * 2])

        size = _sequence_size(read, (len(run) - start) // 2)
        if size and is_private_key(read(0, size)):
            yield "der", start, start + 2 * size
            at = start + 2 * size


def _keys_in(text: str, start: int, end: int, inside=_keys_inside) -> Iterator[tuple[str, int, int]]:
    """The same in a part of a text that may have breaks, with places of the text."""
    runs, at = [], start
    for m in BREAK.finditer(text, start, end):
        runs.append((at, m.start()))
        at = m.end()
    runs.append((at, end))
    first = list(accumulate((b - a for a, b in runs), initial=0))

    def place(i: int) -> int:
        r = bisect_right(first, i, hi=len(runs)) - 1
        return runs[r][0] + i - first[r]

    for kind, a, b in inside("".join(text[a:b] for a, b in runs)):
        high = place(b - 1) + 1
        yield kind, place(a), high + (len(PADDING.match(text, high)[0]) if inside is _keys_inside else 0)


def _covers(spans: list[tuple[int, int]], at: int) -> bool:
    """Whether one of the ordered spans holds a place."""
    i = bisect_right(spans, at, key=lambda span: span[0]) - 1
    return i >= 0 and at < spans[i][1]


def is_signed_token(text: str) -> bool:
    try:
        header, payload = (json.loads(_base64(part) or b"") for part in text.split(".")[:2])
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(payload, dict)


def spans(text: str) -> list[tuple[str, int, int]]:
    """All (kind, start, end), by start and then by kind."""
    found = []
    lowered = text.lower()
    if any(name in lowered for name in NAMES):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    if "eyJ" in text:
        found += [("jwt", *m.span()) for m in TOKEN.finditer(text) if is_signed_token(m[0])]
    wrapped = [m.span() for m in WRAPPED.finditer(text)]
    keys = [key for span in wrapped for key in _keys_in(text, *span)]
    known = [(start, end) for _, start, end in keys]
    for m in ENCODED.finditer(text):
        # A line of a wrapped key is no key of its own.
        if _covers(known, m.start()):
            continue
        data = _base64(m[0])
        if is_private_key(data):
            keys.append(("der", *m.span()))
        elif is_key_container(data):
            keys.append(("ssh", *m.span()))
        elif not _covers(wrapped, m.start()):
            keys += _keys_in(text, *m.span())
    found += keys
    lines = [m.span() for m in HEX_LINES.finditer(text)]
    in_hex = [key for span in lines for key in _keys_in(text, *span, _hex_keys_inside)]
    known = [(start, end) for _, start, end in in_hex]
    for m in LONG_HEX.finditer(text):
        if not _covers(known, m.start()) and not _covers(lines, m.start()):
            in_hex += _keys_in(text, *m.span(), _hex_keys_inside)
    found += in_hex
    if "PRIVATE KEY-----" in text:
        for m in BLOCK.finditer(text):
            data = _base64(m[2])
            if is_private_key(data) or is_key_container(data) or is_encrypted_key(data):
                found.append(("pem", *m.span()))
        for m in HEADED.finditer(text):
            data = _base64(m[3])
            # Cipher text comes in whole blocks.
            if data and len(data) >= 32 and len(data) % 8 == 0:
                found.append(("pem", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    for batch in batches:
        found = [[dict(zip(("kind", "start", "end"), s)) for s in spans(t.as_py())] for t in batch.column("_text")]
        yield pa.RecordBatch.from_arrays([batch.column(ID), pa.array(found, pa.list_(span))], [ID, "found"])


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, found``: an array of (kind, start, end) for every row of ``docs``."""
    rows = rows_of(docs, id_col=id_col, text_col=text_col).select(ID, "_text")
    found = rows.mapInArrow(_scan, f"{ID} long, found array<struct<kind:string,start:bigint,end:bigint>>")
    return found.select(plain_id().alias("doc_id"), "found")
