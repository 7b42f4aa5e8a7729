"""Secret scan with structural confirmation.

Three base kinds are plain patterns (``assign``, ``access``, ``hex``).  The
method adds kinds that are reported only after their candidate has been
decoded and its structure parsed:

* ``jwt``      three base64url parts whose header is a JSON object with a
               known signing algorithm and whose payload is a JSON object,
* ``der``      base64 (either alphabet) or hex text that decodes to a DER key: nested lengths
               close exactly and the members are those of a PKCS#1, PKCS#8,
               SEC1, traditional DSA or public-key structure,
* ``openssh``  base64 that decodes to an OpenSSH private or public key whose
               length-prefixed strings add up.

Base64 keys may stand behind any sign, over several lines with indentation,
quote marks or escaped line breaks, and in a PEM block encoded once more; hex
keys over lines, with colons or as lists of bytes.  A token may follow letters.

All offsets are code points, end exclusive.  A null or empty text has no
spans.  Equal texts give equal spans; rows are never merged.
"""

from __future__ import annotations

import base64
import bisect
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.llm.common import map_text

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "jwt", "der", "openssh")

# The base patterns and their least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run is matched whole, so the least length can stand in the pattern
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

# Base64url of an opening brace and a quote mark or white space; it may stand anywhere in a run of such characters.
_JWT = re.compile(r"e[wy][A-Za-z0-9_-]{6,}\.e[wy][A-Za-z0-9_-]*\.[A-Za-z0-9_-]*")
_JWT_ALGORITHMS = {"HS256", "HS384", "HS512", "RS256", "RS384", "RS512", "ES256", "ES384", "ES512", "PS256", "PS384",
                   "PS512", "EdDSA", "none"}
# Base64 of a DER sequence of 24 bytes or more begins with M and B to I, an OpenSSH private key with "openssh-key-v1",
# a public one with a four-byte length, a PEM block that was encoded whole with "---".  Any base64 run, and any line of
# one, that begins so is a candidate; what stands before it, or the n of an escaped line break, doesn't matter.
_START = re.compile(r"[MbAL](?:(?<![A-Za-z0-9+/][MbAL])|(?<=\\[nrt][MbAL]))(?:(?<=M)[B-I]|(?<=b)3Bl|(?<=A)AAA|(?<=L)S0t)")
_LINE = re.compile(r"[A-Za-z0-9+/]++")
# Between two lines of a run: line breaks, also escaped ones, with indentation, quote marks, comment signs, and the
# commas or plus signs of joined string literals.  A slash may be escaped within a line.
_GAP = re.compile(r"""(?:[\s"'`>|#*,]|\\+[nrt]?|(?<=[\s"'`])\+(?=\s))++""")
_GAP_BREAKS = re.compile(r"[\r\n]|\\[nr]")
_FOOTER = re.compile(r"\s*-----END [^-]*-----\s*")
# Bytes in hex, in one piece or with colons, commas, 0x or white space between them.
_HEX_DER = re.compile(r"(?<![0-9A-Fa-f])30(?:(?:[:,]?\s*(?:0x)?)[0-9A-Fa-f]{2}){23,}(?![0-9A-Fa-f])")
_HEX_BYTE = re.compile(r"(?:0x)?([0-9A-Fa-f]{2})")
# A key in the URL-safe alphabet, which is told from the other one by its minus signs and underscores.
_URL_DER = re.compile(r"(?<![A-Za-z0-9_-])M[B-I][A-Za-z0-9_-]{30,}")
_LEAST_KEY_BYTES = 24


def _der(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, content start, content end) of the members between ``at`` and ``end``; None if the lengths don't close."""
    found = []
    while at < end:
        if at + 2 > end:
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > end:
                return None
            n = int.from_bytes(data[at:at + k], "big")
            at += k
        if at + n > end:
            return None
        found.append((tag, at, at + n))
        at += n
    return found


def is_der_key(data: bytes) -> bool:
    """Whether the bytes are one DER sequence with the members of a known key structure."""
    top = _der(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != 0x30 or len(data) < _LEAST_KEY_BYTES:
        return False
    inner = _der(data, top[0][1], top[0][2])
    if not inner:
        return False
    tags = [t for t, _, _ in inner]
    if tags[:1] == [0x02] and len(tags) >= 9 and set(tags[:9]) == {0x02}:
        return True                                                     # PKCS#1 private key
    if tags == [0x02] * 6:                                              # DSA: version, p, q, g, public, private
        return data[inner[0][1]:inner[0][2]] == b"\x00"
    if tags[:3] == [0x02, 0x30, 0x04]:                                  # PKCS#8
        algorithm = _der(data, inner[1][1], inner[1][2])
        return bool(algorithm) and algorithm[0][0] == 0x06
    if tags[:2] == [0x02, 0x04]:                                        # SEC1
        return data[inner[0][1]:inner[0][2]] == b"\x01" and inner[1][2] - inner[1][1] >= 16
    if tags == [0x30, 0x03]:                                            # public key info
        algorithm = _der(data, inner[0][1], inner[0][2])
        return bool(algorithm) and algorithm[0][0] == 0x06
    return tags == [0x30, 0x04] and bool(_der(data, inner[0][1], inner[0][2]))  # encrypted PKCS#8


def _strings(data: bytes, at: int, least: int) -> bool:
    """Whether length-prefixed strings fill the rest of the data, at least so many."""
    n = 0
    while at < len(data):
        if at + 4 > len(data):
            return False
        size = int.from_bytes(data[at:at + 4], "big")
        at += 4 + size
        if at > len(data):
            return False
        n += 1
    return n >= least


def is_openssh_key(data: bytes) -> bool:
    magic = b"openssh-key-v1\x00"
    if data.startswith(magic):
        at = len(magic)
        for _ in range(3):                                              # cipher, kdf, kdf options
            if at + 4 > len(data):
                return False
            at += 4 + int.from_bytes(data[at:at + 4], "big")
        keys = int.from_bytes(data[at:at + 4], "big") if at + 4 <= len(data) else 0
        return keys >= 1 and _strings(data, at + 4, keys + 1)
    if len(data) < 8:
        return False
    size = int.from_bytes(data[:4], "big")
    name = data[4:4 + size]
    return size < 64 and name.startswith((b"ssh-", b"ecdsa-sha2-", b"sk-")) and _strings(data, 0, 2)


def _json_part(part: str):
    try:
        return json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, RecursionError):
        return None


def is_signed_token(text: str) -> bool:
    header, payload, signature = text.split(".")
    h = _json_part(header)
    return (isinstance(h, dict) and h.get("alg") in _JWT_ALGORITHMS and isinstance(_json_part(payload), dict)
            and (bool(signature) or h["alg"] == "none"))


class _Run:
    """Lines of base64 with breaks between them, joined; ``end`` is where the last one ends in the text."""

    def __init__(self, text: str, at: int):
        self.text, self.starts, self.offsets = text, [], []
        lines, n = [], 0
        while m := _LINE.match(text, at):
            self.starts.append(at)
            self.offsets.append(n)
            lines.append(m[0])
            self.end, n = m.end(), n + len(m[0])
            gap = _GAP.match(text, self.end)
            if not gap or not (_GAP_BREAKS.search(gap[0]) or gap[0] == "\\" and text[gap.end():gap.end() + 1] == "/"):
                break
            at = gap.end()
        self.body = "".join(lines)

    def offset(self, start: int) -> int | None:
        """Place in the joined body of a line that begins at ``start`` in the text."""
        i = bisect.bisect_left(self.starts, start)
        return self.offsets[i] if i < len(self.starts) and self.starts[i] == start else None

    def place(self, offset: int) -> int:
        """Place in the text behind the first ``offset`` characters of the body and their padding."""
        i = bisect.bisect_left(self.offsets, offset) - 1
        end = self.starts[i] + offset - self.offsets[i]
        return end + len(re.match("={0,2}", self.text[end:end + 2])[0])

    def ends_line(self, offset: int) -> bool:
        i = bisect.bisect_left(self.offsets, offset)
        return offset == len(self.body) or i < len(self.offsets) and self.offsets[i] == offset

    def read(self, offset: int, at: int, n: int) -> bytes:
        """``n`` bytes from byte ``at`` on of what the body encodes from ``offset`` on; fewer at its end."""
        first = offset + at // 3 * 4
        return _bytes(self.body[first:offset + -(-(at + n) // 3) * 4])[at % 3:at % 3 + n]


def _bytes(body: str) -> bytes:
    """The bytes of base64 characters; a last one that begins a byte only is left out."""
    body = body[:-1] if len(body) % 4 == 1 else body
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _chars(n: int) -> int:
    """Base64 characters of so many bytes."""
    return -(-n * 8 // 6)


def _der_end(run: _Run, offset: int) -> int | None:
    """Where in the body a DER key from ``offset`` on ends, by its header's length."""
    head = run.read(offset, 0, 6)
    if len(head) < 6:
        return None
    total = _der_size(head)
    if total is None:
        return None
    end = offset + _chars(total)
    return end if end <= len(run.body) and is_der_key(run.read(offset, 0, total)) else None


def _der_size(head: bytes) -> int | None:
    """Bytes of a DER value by its header."""
    if len(head) < 6:
        return None
    k = head[1] & 0x7F
    if not head[1] & 0x80:
        return 2 + head[1]
    return 2 + k + int.from_bytes(head[2:2 + k], "big") if 1 <= k <= 4 else None


def signed_tokens(text: str) -> list[tuple[str, int, int]]:
    """Spans of signed tokens; a header may begin anywhere in a run, and the decoder decides where."""
    spans, at = [], 0
    while m := _JWT.search(text, at):
        at = m.start() + 1
        if is_signed_token(m[0]):
            spans.append(("jwt", m.start(), m.end()))
            at = m.end()
    return spans


def url_safe_keys(text: str) -> list[tuple[str, int, int]]:
    """Spans of DER keys in URL-safe base64, which end where their length says."""
    spans = []
    for m in _URL_DER.finditer(text):
        body = m[0]
        if "-" not in body and "_" not in body:
            continue
        total = _der_size(base64.urlsafe_b64decode(body[:8]))
        if total and _chars(total) <= len(body):
            part = body[:_chars(total)]
            if is_der_key(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))[:total]):
                end = m.start() + len(part)
                spans.append(("der", m.start(), end + len(re.match("={0,2}", text[end:end + 2])[0])))
    return spans


def hex_keys(text: str) -> list[tuple[str, int, int]]:
    """Spans of DER keys in hex, also over lines, with colons or as a list of bytes; they end where their length says."""
    spans = []
    for m in _HEX_DER.finditer(text):
        places = [(b.start(1), b.end(1)) for b in _HEX_BYTE.finditer(m[0])]
        data = bytes(int(m[0][a:b], 16) for a, b in places)
        total = _der_size(data[:6])
        if total and total <= len(data) and is_der_key(data[:total]):
            spans.append(("der", m.start(), m.start() + places[total - 1][1]))
    return spans


def _openssh_end(run: _Run, offset: int) -> int | None:
    """Where in the body an OpenSSH key from ``offset`` on ends: the last line end up to which its strings add up."""
    head = run.read(offset, 0, 68)
    at, skip = (15, 3) if head.startswith(b"openssh-key-v1\x00") else (0, 0)
    if not skip and not head[4:].startswith((b"ssh-", b"ecdsa-sha2-", b"sk-")):
        return None
    found, n, least, size = None, 0, 2, (len(run.body) - offset) * 6 // 8
    while at + 4 <= size:
        if skip and n == skip:
            least, skip = n + int.from_bytes(run.read(offset, at, 4), "big") + 1, 0
            at += 4
            continue
        at += 4 + int.from_bytes(run.read(offset, at, 4), "big")
        n += 1
        if at <= size and not skip and n >= least and run.ends_line(offset + _chars(at)):
            found = at
    return offset + _chars(found) if found and is_openssh_key(run.read(offset, 0, found)) else None


def _encoded_pem(run: _Run, offset: int) -> tuple[str, int] | None:
    """Kind of the first key in the text that the body encodes from ``offset`` on, and where in the body the last
    key ends, with its END line."""
    inner = _bytes(run.body[offset:]).decode("latin-1")
    keys = encoded_keys(inner)
    if not keys:
        return None
    footer = _FOOTER.match(inner, keys[-1][2])
    return keys[0][0], offset + _chars(footer.end() if footer else keys[-1][2])


def encoded_keys(text: str) -> list[tuple[str, int, int]]:
    """Spans of keys in base64, in order; a PEM block that was encoded once more is one span of its key's kind."""
    spans, run, at, tried = [], None, 0, set()
    while m := _START.search(text, at):
        start, at = m.start(), m.start() + 1
        offset = run.offset(start) if run and start < run.end else None
        if offset is None:
            run, offset, tried = _Run(text, start), 0, set()
        sure = None
        if m[0][0] == "M":
            sure = ("der", end) if (end := _der_end(run, offset)) else None
        elif m[0][0] != "L":
            sure = ("openssh", end) if (end := _openssh_end(run, offset)) else None
        elif offset % 4 not in tried:  # a later line of the same phase encodes an end of the same text
            tried.add(offset % 4)
            sure = _encoded_pem(run, offset)
        if sure:
            at = run.place(sure[1])
            spans.append((sure[0], start, at))
    return spans


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in order of start, then kind."""
    if not text:
        return []
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    spans += signed_tokens(text)
    spans += encoded_keys(text) + url_safe_keys(text) + hex_keys(text)
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(spans, key=lambda s: (s[1], order[s[0]], s[2]))


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                     T.StructField("end", T.LongType())])


def scan(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``row`` (the input row) and ``found`` (array of kind, start, end)."""
    def run(batches):
        for texts in batches:
            yield [[[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t)] for t in texts]]

    return map_text(df, text_col, [T.StructField("found", T.ArrayType(SPAN))], run)


def spans_text(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The input columns, with each stretch of the text that a span covers
    replaced by ``mark``; overlapping spans are one stretch.  Texts without a
    span stay as they are, a null text stays null.  ``n_chars``, where it exists as a number, follows the new text."""
    def run(batches):
        for texts in batches:
            yield [[blank(t, mark) for t in texts]]

    marked = map_text(df, text_col, [T.StructField("clean", T.StringType())], run)
    kinds = dict(df.dtypes)
    changed = ~F.col("clean").eqNullSafe(F.col("row")[text_col])

    def column(c: str) -> Column:
        if c == text_col:
            return F.col("clean").alias(c)
        if c == "n_chars" and kinds[c] in ("int", "bigint"):
            return F.when(changed, F.length("clean").cast(kinds[c])).otherwise(F.col("row")[c]).alias(c)
        return F.col("row")[c].alias(c)

    return marked.select(*[column(c) for c in df.columns])


def blank(text: str | None, mark: str) -> str | None:
    spans = find_spans(text)
    if not spans:
        return text
    out, at = [], 0
    start, end = spans[0][1], spans[0][2]
    for _, a, b in spans[1:]:
        if a < end:
            end = max(end, b)
        else:
            out += [text[at:start], mark]
            at, start, end = end, a, b
    return "".join([*out, text[at:start], mark, text[end:]])
