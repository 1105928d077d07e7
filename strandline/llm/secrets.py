"""Secrets in text: patterns, and structural confirmation of encoded ones.

Base patterns find assignments, access keys and long hex runs.  The method
adds what only decoding shows.  Runs of base64 and hex characters are searched
for private keys at every place: a DER header whose length and first field fit
is parsed, and reported if its nested lengths all add up and its fields are
those of PKCS#1, PKCS#8 or SEC1; so are OpenSSH keys with their
length-prefixed strings.  Runs are decoded at every alignment, and reported if
the text holds an assignment, an access key or a PEM block.  Signed tokens are
reported if header and payload decode to JSON objects and the header names an
algorithm; PEM blocks if their body, without escaped line breaks and header
lines, is such a key, or a header says that it is encrypted.  Base64 and hex
wrapped over lines are joined before they are decoded: keys are searched for
in all lines that follow each other, texts in lines of one length and a
shorter last one.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds as listed: those of the base patterns first.
KINDS = ("assign", "access", "hex", "jwt", "pem", "key", "encoded")
_ORDER = {k: i for i, k in enumerate(KINDS)}
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_WORDS = ("passw", "secret", "token", "apikey", "api_key")
_JWT = re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
_PEM_RULE = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*PRIVATE KEY)-----")
#: Runs that may encode a secret, from the shortest text that a base pattern matches: "token=" and six characters, 12 bytes.
_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_HEX_RUN = re.compile(r"[0-9a-fA-F]{24,}")
#: Where a DER sequence may start: 0x30 and a length byte, in base64 and in hex.
_DER64 = re.compile(r"(?=M[A-I][A-Za-z0-9+/_-]{14})")
_DER16 = re.compile(r"(?=30(?:[0-7][0-9a-f]|81[0-9a-f]{2}|82[0-9a-f]{4}|83[0-9a-f]{6})0201)", re.I)
_OPENSSH = b"openssh-key-v1\0"
_OPENSSH64, _OPENSSH16 = base64.b64encode(_OPENSSH).decode(), _OPENSSH.hex()
_SEPARATED = re.compile(r"[/_+-]")
_INNER = re.compile(rb"(?i)passw|secret|token|api_?key|AKIA|-----BEGIN")
_TEXT = re.compile(r"[\t\n\r\x20-\x7e\xa0-\U0010fffc]+")
_BREAK = r"[ \t]*(?:\r\n?|\n|\\+r\\+n|\\+n)[ \t]*"
_CHAR = "[A-Za-z0-9+/_-]"
#: Lines of base64 or hex; "n" of an escaped line break is no part of the first, and a PEM rule no line.
_LINES = re.compile(rf"(?:(?<!{_CHAR})(?<!\\)|(?<=\\n)){_CHAR}{{4,}}+(?:{_BREAK}(?!-{{5}}){_CHAR}++)+={{0,2}}")
_LINE = re.compile(rf"(?:{_BREAK})?({_CHAR}+=*)")
_ESCAPED = re.compile(r"(?<!\\)\\+[rnt]")
_SHIELDED = re.compile(r"Proc-Type:\s*4,\s*ENCRYPTED")
_HEADER = re.compile(r"Proc-Type:\s*4,\s*[A-Z-]+|DEK-Info:\s*[A-Z0-9-]+(?:,[0-9A-Fa-f]+)?|^[ \t]*[A-Za-z][A-Za-z0-9-]*:.*$", re.M)
Span = tuple[str, int, int]
SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"


def base_spans(text: str) -> list[Span]:
    """Spans of the three base patterns, by start."""
    out: list[Span] = []
    lower = text.lower()
    if any(w in lower for w in _WORDS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return ordered(out)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], _ORDER[s[0]], s[2]))


def unbase64(run: str) -> bytes | None:
    run = run.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der(data: bytes, at: int, end: int, depth: int = 0) -> list[tuple[int, int, int]] | None:
    """(tag, start, end of contents) of the elements that fill data[at:end] exactly, lengths of nested ones included; else None."""
    out = []
    while at < end:
        if end - at < 2 or depth > 16:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at + size > end or (tag & 0x20 and der(data, at, at + size, depth + 1) is None):
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def is_key(data: bytes) -> bool:
    """Whether the bytes are a private key by their structure."""
    if data.startswith(b"openssh-key-v1\0"):
        at = 15
        for _ in range(3):  # cipher, key derivation, its options
            if at + 4 > len(data):
                return False
            at += 4 + int.from_bytes(data[at : at + 4], "big")
        return at + 4 <= len(data) and 0 < int.from_bytes(data[at : at + 4], "big") <= 64
    if data[:1] != b"\x30":
        return False
    top = der(data, 0, len(data))
    if not top or len(top) != 1:
        return False
    fields = der(data, top[0][1], top[0][2]) or []
    tags = [f[0] for f in fields]
    if tags[:1] != [2] or fields[0][2] - fields[0][1] != 1:
        return False
    return len(tags) >= 9 and set(tags[:9]) == {2} or tags[1:3] == [0x30, 4] or tags[1:2] == [4] and fields[1][2] - fields[1][1] >= 16


def _json(part: str) -> dict | None:
    data = unbase64(part)
    try:
        x = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return x if isinstance(x, dict) else None


class _Covered:
    """Disjoint stretches of a text, as they are found from left to right."""

    def __init__(self, found: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, a, b in sorted(found, key=lambda x: x[1]):
            self.starts.append(a)
            self.ends.append(max(b, self.ends[-1] if self.ends else b))

    def has(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b) - 1
        return k >= 0 and self.ends[k] > a


def pem_blocks(text: str) -> Iterator[tuple[str, int, int, str]]:
    """(label, start, end, body) of the blocks: an END and the last BEGIN of its label before it, with no other rule between."""
    begin = None
    for m in _PEM_RULE.finditer(text):
        if m[1] == "BEGIN":
            begin = m
        elif begin is not None and begin[2] == m[2]:
            yield m[2], begin.start(), m.end(), text[begin.end() : m.start()]
            begin = None


def confirmed_spans(text: str) -> list[Span]:
    """Spans that decoding confirms."""
    out: list[Span] = []
    if "eyJ" in text:
        for m in _JWT.finditer(text):
            head, body, _ = m[0].split(".")
            if isinstance((_json(head) or {}).get("alg"), str) and _json(body) is not None:
                out.append(("jwt", *m.span()))
    if "-----BEGIN" in text:
        for label, start, end, body in pem_blocks(text):
            body = _ESCAPED.sub("\n", body).replace("\\/", "/")
            data = unbase64("".join(_HEADER.sub("", body).split()))
            if data and (is_key(data) or "ENCRYPTED" in label and der(data, 0, len(data)) or _SHIELDED.search(body)):
                out.append(("pem", start, end))
    known = _Covered(out)
    more: list[Span] = []
    for m in _LINES.finditer(text):
        if not known.has(*m.span()):
            more += _wrapped(text, *m.span())
    out += more
    known = _Covered(out)
    for m in _RUN.finditer(text):
        if not known.has(m.start(), m.start() + 1):
            out += [(kind, m.start() + a, m.start() + b) for kind, a, b in in_run(m[0])]
    return out


def der_size(head: bytes) -> int:
    """Bytes of the DER element that starts with ``head`` (6 bytes or more); 0 if its length has no such form."""
    size = head[1]
    if size < 0x80:
        return 2 + size
    n = size & 0x7F
    return 2 + n + int.from_bytes(head[2 : 2 + n], "big") if 1 <= n <= 4 else 0


def keys(run: str) -> list[tuple[int, int]]:
    """(start, end) of the private keys in a run of base64 or hex characters, wherever they start."""
    out: list[tuple[int, int]] = []
    free = 0
    plain = run.rstrip("=")
    if "M" in run or _OPENSSH64 in run:
        for m in _DER64.finditer(plain):
            at = m.start()
            head = unbase64(plain[at : at + 16]) if at >= free else None
            if not head or head[0] != 0x30 or not (size := der_size(head)):
                continue
            inner = 2 + (head[1] & 0x7F if head[1] & 0x80 else 0)
            chars = -(-size * 8 // 6)
            # The first field of a key is a version, an integer of one byte.
            if head[inner : inner + 2] != b"\x02\x01" or at + chars > len(plain):
                continue
            data = unbase64(plain[at : at + chars])
            if data and is_key(data[:size]):
                free = at + chars
                out.append((at, len(run) if free == len(plain) else free))
        at = plain.find(_OPENSSH64)
        if at >= 0 and (data := unbase64(plain[at:][: (len(plain) - at) // 4 * 4])) and is_key(data):
            out.append((at, len(run)))
    for h in _HEX_RUN.finditer(plain):
        for m in _DER16.finditer(h[0]):
            at, data = m.start(), bytes.fromhex(h[0][m.start() : m.start() + 12])
            size = der_size(data) * 2
            if h.start() + at >= free and at + size <= len(h[0]) and is_key(bytes.fromhex(h[0][at : at + size])):
                free = h.start() + at + size
                out.append((h.start() + at, free))
        at = h[0].lower().find(_OPENSSH16)
        if at >= 0 and is_key(bytes.fromhex(h[0][at:][: (len(h[0]) - at) // 2 * 2])):
            out.append((h.start() + at, h.end()))
    return out


def _encoded(run: str, data: bytes, first: int, width: int, unit: int) -> tuple[int, int] | None:
    """(start, end) in the run of the text that holds a secret; ``width`` characters of it, from ``first`` on, are ``unit`` bytes."""
    if not _INNER.search(data):
        return None
    text = data.decode("utf-8", "replace")
    found = [(a, b) for k, a, b in base_spans(text) if k != "hex"] + [(a, b) for _, a, b, _ in pem_blocks(text)]
    if not found:
        return None
    a, b = found[0]
    # The stretch of text around the secret; what stands before or after it in the run isn't encoded text.
    near = next(m for m in _TEXT.finditer(text.replace("\ufffd", "\0")) if m.end() > a)
    low = len(text[: near.start()].encode("utf-8", "replace")) if "\ufffd" not in text[: near.start()] else data.rfind(text[near.start() : b].encode())
    high = low + len(text[near.start() : near.end()].encode())
    secret = low + len(text[near.start() : a].encode())
    start = first + -(-low // unit) * width
    stop = len(run) if high >= len(data) else first + -(-high * width // unit)
    if low > 0 or first > 0:
        # A prefix may happen to decode to letters: the text starts after its last separator, if one stands where it can.
        for m in _SEPARATED.finditer(run, max(start - 1, 0), first + secret // unit * width + 1):
            if (m.end() - first) % width == 0 and m.end() <= first + secret // unit * width:
                start = m.end()
                break
    return start, stop


def in_run(run: str) -> list[Span]:
    """Spans in a run of base64 characters, or of hex ones among them, that decoding confirms."""
    if found := keys(run):
        return [("key", a, b) for a, b in found]
    plain = run.rstrip("=")
    for h in _HEX_RUN.finditer(plain):
        for first in (0, 1):
            x = h[0][first:]
            if at := _encoded(h[0], bytes.fromhex(x[: len(x) // 2 * 2]), first, 2, 1):
                return [("encoded", h.start() + at[0], h.start() + at[1])]
    for first in range(min(4, len(plain))):
        x = plain[first:]
        data = unbase64(x if len(x) % 4 != 1 else x[:-1])
        if data and (at := _encoded(run, data, first, 4, 3)):
            return [("encoded", *at)]
    return []


def _wrapped(text: str, start: int, end: int) -> list[Span]:
    """Spans over several of the lines in text[start:end] that joining them confirms."""
    out: list[Span] = []
    lines = [m.span(1) for m in _LINE.finditer(text, start, end)]
    joined = "".join(text[a:b] for a, b in lines)
    if len(joined) < 16:
        return out
    ends = list(accumulate(b - a for a, b in lines))

    def place(at: int, end: bool = False) -> int:
        k = bisect_left(ends, at if end else at + 1)
        return lines[k][1] - (ends[k] - at)

    taken = []
    for a, b in keys(joined):
        if bisect_left(ends, a + 1) != bisect_left(ends, b):  # else a single line's run holds it
            out.append(("key", place(a), place(b, True)))
            taken.append((a, b))
    i = 0
    while i < len(lines):
        at, width = ends[i] - (lines[i][1] - lines[i][0]), lines[i][1] - lines[i][0]
        j = i + 1
        while j < len(lines) and lines[j][1] - lines[j][0] == width:
            j += 1
        tries = [j + 1] if j < len(lines) and lines[j][1] - lines[j][0] < width else []
        tries += [j] if j > i + 1 else []
        for k in tries:
            run = joined[at : ends[k - 1]]
            if any(a < ends[k - 1] and at < b for a, b in taken):
                continue
            if (found := in_run(run)) and found[0][0] == "encoded":
                out.append(("encoded", place(at + found[0][1]), place(at + found[0][2], True)))
                i = k
                break
        else:
            i = j
    return out


def spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a text, by start and kind."""
    base = base_spans(text or "")
    return base, ordered(base + confirmed_spans(text or ""))


def written(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: list[list] = [[] for _ in range(5)]
        for text in batch.column(1).to_pylist():
            base, full = spans(text)
            kinds = [k for k, _, _ in base]
            row = (*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(written(base).encode()).hexdigest(), written(full))
            for c, v in zip(cols, row, strict=True):
                c.append(v)
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [x.split()[0] for x in SCHEMA.split(", ")])


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, code points).

    Null and empty texts have no spans (base_sha256 is that of the empty
    string).  Whole texts are scanned, line breaks included, in time that
    grows with their length.  Rows are independent of each other: null ids
    and repeated rows are scanned as they come, an empty table gives no rows.
    Spans that start together stand in the order of ``KINDS``.  Columns other
    than doc_id and text are not read, whatever their names.
    """
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_run, SCHEMA)
