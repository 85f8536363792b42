"""Secret scans with structural confirmation.

Base patterns are reported as they match. Everything else is a candidate first: runs of base64 or hex characters and
dotted tokens are decoded, and only what parses is reported:

* jwt: three dotted base64url parts whose header is a JSON object with an ``alg`` and whose payload is a JSON object;
* pem: an armoured block whose body, header lines skipped, decodes to a key encoding or a PGP key packet, or, if the
  header names a cipher, to whole cipher blocks under an initial vector of the block size;
* der: bytes that are one ASN.1 sequence, every nested length filling its parent, with an integer in front as key
  encodings have (at its own level or one down);
* ssh: length-prefixed fields that tile the bytes, the first naming a key type, or a private key container;
* nested: an encoding of text in which the base patterns or one of the above are found.

Runs start at the shortest encoding of a base match, and whatever is not of their alphabet may stand before and after
them. Lines of nothing but such characters are also decoded together: all that follow each other, and lines of one width
with a line of any width before and a shorter one after. Decoding goes ``DEPTH`` levels down. Null and empty texts have no spans. Whole texts are scanned, rows by themselves.
"""
from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ionweave.llm.base import columns_only, query, table

KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "ssh", "nested")
DEPTH = 2

# The base patterns.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

_HEX_RUN = re.compile(r"[0-9a-f]{24,}")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(?<![A-Za-z0-9_-]\.)([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-]|\.[A-Za-z0-9_-])")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,40})-----((?:[^-]|-(?!----))*+)-----END \1-----")
_PEM_HEADER = re.compile(r"([A-Za-z][A-Za-z0-9-]*):[ \t]*(\S*)")
#: Characters of the shortest base64 text that holds a base match: an assignment to the shortest name.
_SHORTEST = -(-4 * min(len("token=") + ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST) // 3)
_ENCODED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}+={0,2}" % _SHORTEST)
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t\r]*+\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_-]++={0,2}")
_ANY_HEX = re.compile(r"\A(?:[0-9a-f]+|[0-9A-F]+)\Z")
_KEY_TYPES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-", b"sk-ssh-")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base matches."""
    out = []
    low = text.lower()
    if "pass" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    return out + [(m.start(), m.end(), "hex") for m in _HEX_RUN.finditer(text)]     # maximal runs either way


def decoded(run: str) -> bytes | None:
    """Bytes of a hex or base64 run in either alphabet, or None."""
    if _ANY_HEX.match(run):
        return bytes.fromhex(run) if len(run) % 2 == 0 else None
    return unbase64(run)


def unbase64(run: str) -> bytes | None:
    body = run.rstrip("=")
    if len(body) % 4 == 1 or ("-" in body or "_" in body) and ("+" in body or "/" in body):
        return None
    try:
        return base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def tlv(data: bytes, at: int) -> tuple[int, int, int] | None:
    """(tag, start of the value, its end) of the element at ``at``, if its length stays within ``data``."""
    if at + 2 > len(data):
        return None
    tag, n, start = data[at], data[at + 1], at + 2
    if n & 0x80:
        size = n & 0x7F
        if not 1 <= size <= 4 or start + size > len(data):
            return None
        n, start = int.from_bytes(data[start:start + size], "big"), start + size
    return (tag, start, start + n) if start + n <= len(data) else None


def elements(data: bytes) -> list[tuple[int, bytes]] | None:
    """The elements that tile ``data``; None if they do not."""
    out, at = [], 0
    while at < len(data):
        e = tlv(data, at)
        if e is None:
            return None
        out.append((e[0], data[e[1]:e[2]]))
        at = e[2]
    return out


def is_der(data: bytes, level: int = 0) -> bool:
    """One sequence that fills ``data``; nested sequences and sets are tiled by their elements; an integer leads."""
    top = elements(data)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False

    def sound(tag: int, value: bytes, depth: int) -> bool:
        if tag not in (0x30, 0x31) or depth > 12:
            return True
        inner = elements(value)
        return inner is not None and all(sound(t, v, depth + 1) for t, v in inner)

    inner = elements(top[0][1])
    if not inner or len(inner) < 2 or not sound(0x30, top[0][1], 0):
        return False
    head = inner[0]
    if head[0] == 0x30:
        head = (elements(head[1]) or [(0, b"")])[0]
        return head[0] in (0x02, 0x06, 0xA0)
    return head[0] == 0x02 and len(head[1]) > 0


def is_ssh(data: bytes) -> bool:
    if data.startswith(b"openssh-key-v1\0"):
        return True
    fields, at = [], 0
    while at < len(data):
        if at + 4 > len(data):
            return False
        n = struct.unpack_from(">I", data, at)[0]
        if at + 4 + n > len(data):
            return False
        fields.append(data[at + 4:at + 4 + n])
        at += 4 + n
    return len(fields) >= 2 and fields[0].startswith(_KEY_TYPES)


def is_jwt(header: str, payload: str) -> bool:
    for part, needs in ((header, "alg"), (payload, None)):
        raw = unbase64(part)
        try:
            value = json.loads(raw.decode("utf-8")) if raw else None
        except (ValueError, RecursionError):
            return False
        if not isinstance(value, dict) or needs and not isinstance(value.get(needs), str):
            return False
    return True


def is_pgp(data: bytes) -> bool:
    """A secret or public key packet of a known version comes first and stays within ``data``."""
    if len(data) < 8 or not data[0] & 0x80:
        return False
    if data[0] & 0x40:
        tag, first = data[0] & 0x3F, data[1]
        if first < 192:
            n, start = first, 2
        elif first < 224:
            n, start = ((first - 192) << 8) + data[2] + 192, 3
        else:
            n, start = int.from_bytes(data[2:6], "big"), 6
            if first != 255:
                return False
    else:
        tag, size = data[0] >> 2 & 0x0F, 1 << (data[0] & 3)
        if size == 8:
            return False
        n, start = int.from_bytes(data[1:1 + size], "big"), 1 + size
    return tag in (5, 6) and n > 6 and start + n <= len(data) and 2 <= data[start] <= 6


def is_armoured(label: str, body: str) -> bool:
    """Whether the body of an armoured block is a key; line ends may be written as escapes."""
    lines = [x.strip(" \t\r\"'\\") for x in body.replace("\\r", "").replace("\\n", "\n").strip().split("\n")]
    fields = {}
    if ":" in lines[0]:
        if "" in lines:
            head, lines = " \n".join(lines[:lines.index("")]), lines[lines.index("") + 1:]
            fields = dict(_PEM_HEADER.findall(head))
        else:
            fields = dict(_PEM_HEADER.findall("\n".join(lines)))
            lines = [_PEM_HEADER.sub("", x) for x in lines]
    run = "".join("".join(lines).split())
    if label.startswith("PGP "):
        raw = unbase64(re.sub(r"=[A-Za-z0-9+/]{4}\Z", "", run))
        return bool(raw) and is_pgp(raw)
    raw = decoded(run)
    if not raw:
        return False
    if "DEK-Info" in fields:
        vector = fields["DEK-Info"].partition(",")[2]
        return bool(_ANY_HEX.match(vector)) and len(vector) in (16, 32) and len(raw) % (len(vector) // 2) == 0
    return is_der(raw) or is_ssh(raw)


def findings(run: str, depth: int) -> tuple[str, int]:
    """Kind of an encoded run and how much was found in it; 0 if nothing was."""
    body = decoded(run)
    if body is None:
        return "", 0
    if is_der(body):
        return "der", 1
    if is_ssh(body):
        return "ssh", 1
    if depth > 1:
        try:
            inner = body.decode("utf-8")
        except UnicodeDecodeError:
            return "", 0
        return "nested", len(base_spans(inner)) + len(confirmed(inner, depth - 1))
    return "", 0


def wraps(widths: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of lines that may be one run: all of them, and lines of one width with the one before and a shorter one
    after, or without."""
    yield 0, len(widths)
    i = 0
    while i < len(widths):
        j = i + 1
        while j < len(widths) and widths[j] == widths[i]:
            j += 1
        for a in (i - 1, i):
            for z in (j + 1, j):
                if a >= 0 and z - a > 1 and (z == j or j < len(widths) and widths[j] < widths[i]):
                    yield a, z
        i = j


def confirmed(text: str, depth: int = DEPTH) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what decodes and parses."""
    out: list[tuple[int, int, str]] = []
    if "-----BEGIN" in text:
        out += [(m.start(), m.end(), "pem") for m in _PEM.finditer(text) if is_armoured(m[1], m[2])]
    if text.count(".") >= 2:
        out += [(m.start(), m.end(), "jwt") for m in _JWT.finditer(text) if is_jwt(m[1], m[2])]
    whole, single = list(out), []
    for m in _ENCODED.finditer(text):
        kind, n = findings(m[0], depth)
        if n and not any(a <= m.start() and m.end() <= z for a, z, _ in whole):
            single.append((m.start(), m.end(), n))
            out.append((m.start(), m.end(), kind))
    if "\n" not in text:
        return out
    for m in _WRAPPED.finditer(text):
        if m.end() - m.start() <= _SHORTEST or any(a <= m.start() and m.end() <= z for a, z, _ in whole):
            continue
        lines = list(_LINE.finditer(text, m.start(), m.end()))
        end = 0
        for a, z in wraps([len(x[0].rstrip("=")) for x in lines]):
            start, stop = lines[a].start(), lines[z - 1].end()
            run = "".join(x[0] for x in lines[a:z])
            if start < end or len(run) < _SHORTEST:
                continue
            kind, n = findings(run, depth)
            if n > sum(k for b, e, k in single if start <= b and e <= stop):
                out.append((start, stop, kind))
                end = stop
    return out


def digest(spans: list[tuple[int, int, str]]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return ",".join(f"{k}:{a}:{z}" for a, z, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, sums, spans = [[], [], []], [], []
            for t in b["text"].to_pylist():
                base = base_spans(t or "")
                for c, kind in zip(counts, KINDS, strict=False):
                    c.append(sum(k == kind for _, _, k in base))
                sums.append(hashlib.sha256(digest(base).encode()).hexdigest())
                spans.append(digest(base + confirmed(t or "")))
            yield pa.RecordBatch.from_arrays([b["doc_id"], *[pa.array(c, pa.int64()) for c in counts], pa.array(sums, pa.string()), pa.array(spans, pa.string())],
                                             ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return columns_only(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


@query("op8_secrets")
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
