"""Secret scans: patterns, and candidates confirmed by their structure.

Three plain patterns report assignments, access identifiers and hexadecimal runs as they
stand.  Base64 and hexadecimal candidates are decoded and reported only when the bytes
parse as what they claim to be: a private key whose DER lengths nest and end exactly, a
key container whose length-prefixed fields nest, or a signed token whose header names an
algorithm.  Base64 is standard or URL-safe, never a mixture, in one line or in several.

Offsets are code points, end exclusive.  Cases: null and empty texts give no spans; whole
texts are scanned, whatever their length; spans of different kinds may overlap; only the
id and text columns are read.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import map_batches, text_of

BASE_KINDS = ("assign", "access", "hex")
#: der: private key in DER; openssh: private key container; jwt: signed token.
KINDS = (*BASE_KINDS, "der", "openssh", "jwt")

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
#: The same runs as _HEX has, but for the short ones.
_HEX_LONG = re.compile(r"[0-9a-f]{24,}")
#: A signed token may stand at any of the dotted parts.
_DOTTED = re.compile(r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_-]*(?:\.[A-Za-z0-9_-]*){2,}")
#: Base64 in one run or wrapped into lines, as armoured keys are, with line ends as they are or
#: written out, as in JSON.  Lines that follow the key, such as dashes or a word, may be taken
#: too; the key's own length tells where it ends.
_NEWLINE = r"(?:\r?\n|(?:\\r)?\\n)"
_BASE64 = re.compile(r"(?:(?<=\\n)|(?<![A-Za-z0-9+/_-])(?!(?<=\\)[nr]))[A-Za-z0-9+/_-]{40,}(?:" + _NEWLINE + r"[A-Za-z0-9+/_-]+)*={0,2}")
_BREAK = re.compile(_NEWLINE)
_MAGIC = b"openssh-key-v1\x00"
#: Beginnings of an object in base64.
_HEADERS = ("ey", "ew", "e3", "IC", "Cn", "DQ")
_HEX_ANY = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")


def der(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the element at ``at`` if its definite, minimal length fits."""
    if at + 2 > end or data[at] & 0x1F == 0x1F:
        return None
    n, body = data[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or body + k > end or data[body] == 0:
            return None
        n, body = int.from_bytes(data[body : body + k], "big"), body + k
        if n < 0x80:
            return None
    return (data[at], body, body + n) if body + n <= end else None


def der_children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill a body exactly."""
    out = []
    while at < end:
        x = der(data, at, end)
        if x is None:
            return None
        out.append(x)
        at = x[2]
    return out


def private_der(data: bytes) -> bool:
    """PKCS#1, SEC 1 or PKCS#8, plain or encrypted: nested elements that end exactly."""
    top = der(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return False
    parts = der_children(data, top[1], top[2])
    if not parts or len(parts) < 2:
        return False
    tags = [t for t, _, _ in parts]
    version = data[parts[0][1] : parts[0][2]] if tags[0] == 0x02 else None
    if version == b"\x00" and len(tags) >= 9 and set(tags[:9]) == {0x02}:
        return all(e > s for _, s, e in parts)  # PKCS#1: modulus, exponents, primes, coefficients
    if version == b"\x01" and tags[1] == 0x04 and set(tags[2:]) <= {0xA0, 0xA1}:
        return 16 <= parts[1][2] - parts[1][1] <= 72  # SEC 1
    algorithm = parts[1] if version in (b"\x00", b"\x01") and len(tags) >= 3 and tags[1:3] == [0x30, 0x04] else None
    if algorithm is None and tags == [0x30, 0x04]:
        algorithm = parts[0]  # PKCS#8, encrypted
    if algorithm is None:
        return False
    inner = der_children(data, algorithm[1], algorithm[2])
    return bool(inner) and inner[0][0] == 0x06 and inner[0][2] > inner[0][1]


def private_container(data: bytes) -> bool:
    """A private-key container: magic, then length-prefixed fields that end exactly."""
    if not data.startswith(_MAGIC):
        return False
    at = len(_MAGIC)

    def take() -> bytes | None:
        nonlocal at
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return None
        at += 4 + n
        return data[at - n : at]

    if any(take() is None for _ in range(3)):  # cipher, key derivation, its options
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= 16:
        return False
    return all(take() for _ in range(keys + 1)) and at == len(data)


def unbase64(text: str) -> bytes | None:
    """What base64 in either alphabet, but not in both, stands for."""
    if ("+" in text or "/" in text) and ("-" in text or "_" in text):
        return None
    plain = re.sub(r"\s", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def signed_token(head: str, body: str, signature: str) -> bool:
    """The header decodes to an object that names an algorithm, the body to an object, and
    a signature is there unless the algorithm is none."""
    try:
        header, claims = (json.loads(unbase64(x) or b"") for x in (head, body))
    except (ValueError, UnicodeDecodeError, RecursionError):
        return False
    if not isinstance(header, dict) or not isinstance(claims, dict) or not isinstance(header.get("alg"), str):
        return False
    return header["alg"].lower() == "none" or len(unbase64(signature) or b"") >= 16


def structure(data: bytes | None) -> str | None:
    if not data:
        return None
    return "der" if private_der(data) else "openssh" if private_container(data) else None


def extent(peek: Callable[[int, int], bytes]) -> int | None:
    """How many bytes a key takes by its own lengths; ``peek`` gives n bytes from a place."""
    if peek(0, len(_MAGIC)) == _MAGIC:
        at = len(_MAGIC)
        for _ in range(3):  # cipher, key derivation, its options
            at += 4 + int.from_bytes(peek(at, 4), "big")
        keys = int.from_bytes(peek(at, 4), "big")
        if not 1 <= keys <= 16:
            return None
        at += 4
        for _ in range(keys + 1):
            at += 4 + int.from_bytes(peek(at, 4), "big")
        return at
    head = peek(0, 6)
    if len(head) < 6 or head[0] != 0x30:
        return None
    k = head[1] & 0x7F if head[1] & 0x80 else 0
    return 2 + k + int.from_bytes(head[2 : 2 + k], "big") if k else 2 + head[1]


def base64_keys(text: str, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    """Keys in the lines of a run of base64: each starts with a line and ends with one."""
    breaks = [m.span() for m in _BREAK.finditer(text, start, end)]
    cuts = [start, *(x for s in breaks for x in s), len(text[start:end].rstrip("=")) + start]
    lines = list(zip(cuts[::2], cuts[1::2], strict=True))
    plain = "".join(text[s:e] for s, e in lines)
    ends = list(accumulate(e - s for s, e in lines))
    k = 0
    while k < len(lines):
        first = ends[k - 1] if k else 0

        def peek(at: int, n: int) -> bytes:
            x = first + at // 3 * 4
            return (unbase64(plain[x : min(x + (n // 3 + 2) * 4, first + (len(plain) - first) // 4 * 4)]) or b"")[at % 3 :][:n]

        size = extent(peek)
        stop = first + -(-size * 4 // 3) if size else 0
        last = bisect_left(ends, stop) if size else len(ends)
        if last < len(ends) and ends[last] == stop and (kind := structure(unbase64(plain[first:stop]))):
            yield kind, lines[k][0], end if last == len(ends) - 1 else lines[last][1]
            k = last + 1
        else:
            k += 1


def signed_tokens(text: str, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    """Signed tokens in a run of dotted parts."""
    parts = text[start:end].split(".")
    at = [start, *accumulate((len(x) + 1 for x in parts), initial=start)][1:]
    k = 0
    while k + 2 < len(parts):
        if len(parts[k]) >= 8 and parts[k].startswith(_HEADERS) and parts[k + 1] and signed_token(*parts[k : k + 3]):
            yield "jwt", at[k], at[k + 2] + len(parts[k + 2])
            k += 3
        else:
            k += 1


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then by kind as listed."""
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in _HEX_LONG.finditer(text)]
    if "." in text:
        out += [t for m in _DOTTED.finditer(text) for t in signed_tokens(text, *m.span())]
    out += [t for m in _BASE64.finditer(text) for t in base64_keys(text, *m.span())]
    for m in _HEX_ANY.finditer(text):
        if kind := structure(bytes.fromhex(m[0])):
            out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``spans array<struct<kind, start, end>>``, for every row."""

    def batch(b: pa.RecordBatch) -> dict[str, object]:
        found = [[{"kind": k, "start": s, "end": e} for k, s, e in spans_of(t)] for t in b.column(1).to_pylist()]
        return {"spans": pa.array(found, _ARROW)}

    rows = docs.select(F.col(id_col), text_of(text_col).alias("_text"))
    return map_batches(rows, batch, [T.StructField("spans", T.ArrayType(SPAN))], [id_col])


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Per document the number of spans of each plain kind, their digest, and all spans."""
    found = scan(docs)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
