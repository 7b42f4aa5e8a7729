"""Base spans against the stated patterns one by one, and structures that must or must not be confirmed."""

import base64
import hashlib
import json
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from rollcall.llm import secret_scan as s

STATED = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A,
               lambda m: len(m[2]) >= 6),
    "access": (r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 20),
    "hex": (r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 24),
}


def stated(text):
    spans = [(m.start(), list(STATED).index(k), k, m.end()) for k, (p, f, good) in STATED.items()
             for m in re.finditer(p, text, f) if good(m)]
    return [(k, a, b) for a, _, k, b in sorted(spans)]


PIECE = st.sampled_from(["password", "Token", "API_KEY", "apikey", "secret", ":", "=", " ", '"', "abcdef", "0123456789abcdef",
                         "AKIA", "ABCDEFGHIJKLMNOP", "é", "ſecret", "x", ".", "\n"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECE, max_size=25).map("".join))
def test_base_spans(text):
    assert [x for x in s.find_spans(text) if x[0] in s.BASE_KINDS] == stated(text)


def der(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


def number(n):
    return der(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))


PKCS1 = der(0x30, b"".join([number(0), *(number(3 ** k) for k in range(40, 400, 45))]))
PKCS8 = der(0x30, number(0) + der(0x30, der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01") + b"\x05\x00") + der(4, PKCS1))
SEC1 = der(0x30, number(1) + der(4, bytes(range(32))))


def ssh(*parts):
    return b"".join(len(p).to_bytes(4, "big") + p for p in parts)


OPENSSH = b"openssh-key-v1\x00" + ssh(b"none", b"none", b"") + (1).to_bytes(4, "big") + ssh(b"public" * 9, b"private" * 9)


def test_structures():
    for key in (PKCS1, PKCS8, SEC1):
        assert s.is_der_key(key) and not s.is_der_key(key[:-1]) and not s.is_der_key(key + b"\x00")
        text = "see " + base64.b64encode(key).decode() + " end"
        assert ("der", 4, len(text) - 4) in s.find_spans(text)
        lines = base64.encodebytes(key).decode()
        found = [x for x in s.find_spans("-----BEGIN KEY-----\n" + lines + "nextword") if x[0] == "der"]
        assert found and found[0][2] == 20 + len(lines.rstrip("\n"))
        assert any(k == "der" for k, _, _ in s.find_spans("k " + key.hex()))
    assert any(k == "openssh" for k, _, _ in s.find_spans(base64.encodebytes(OPENSSH).decode()))
    assert not s.is_openssh_key(OPENSSH[:-3])
    b64 = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    good = f"{b64({'alg': 'HS256', 'typ': 'JWT'})}.{b64({'sub': '1'})}.c2lnbmF0dXJl"
    assert ("jwt", 2, 2 + len(good)) in s.find_spans(f"t {good} x")
    for bad in (f"{b64({'alg': 'zzz'})}.{b64({'a': 1})}.abc", f"{b64({'alg': 'HS256'})}.{b64({'a': 1})}.", "eyJxx.eyJyy.zz"):
        assert not [x for x in s.find_spans(bad) if x[0] == "jwt"]
    assert not s.find_spans("M" + "ABCD" * 30) and not s.find_spans("AAAA" + "B" * 80)


DSA = der(0x30, b"".join([number(0), *(number(5 ** k) for k in (200, 60, 199, 198, 59))]))
PUBLIC = ssh(b"ssh-rsa", b"\x01\x00\x01", bytes(range(1, 130)))
PLANTED = [("der", k) for k in (PKCS1, PKCS8, SEC1, DSA)] + [("openssh", k) for k in (OPENSSH, PUBLIC)]


def test_keys_in_every_form():
    for kind, key in PLANTED:
        one = base64.b64encode(key).decode()
        lines = [one[i:i + 64] for i in range(0, len(one), 64)]
        pem = "-----BEGIN PRIVATE KEY-----\n" + "\n".join(lines) + "\n-----END PRIVATE KEY-----\n"
        twice = base64.b64encode(pem.encode()).decode()
        wrapped = base64.encodebytes(pem.encode()).decode().rstrip("\n")
        forms = {one: ["KEY={}", "ssh_key={} me@host", "a\\t{}", "a='{}'", "x={}\nnextword"],
                 "\\n".join(lines): ['"pk": "-----BEGIN KEY-----\\n{}\\n-----END KEY-----\\n"'],
                 "\\\\n".join(lines): ["BEGIN-----\\\\n{}\\\\n-----END"],
                 "\\r\\n".join(lines): ["-----\\r\\n{}\\r\\n-----"],
                 "\n    ".join(lines): ["key: |\n    {}\n    -----END"],
                 "\r\n> ".join(lines): ["> -----BEGIN-----\r\n> {}\r\n> -----END"],
                 '\\n" +\n  "'.join(lines): ['k = "-----\\n" +\n  "{}\\n" +\n  "-----END"'],
                 one.replace("/", "\\/"): ['{{"k":"{}"}}'],
                 twice: ["tls.key: {}", "K={}\nword"], wrapped: ["a\n{}"], wrapped.replace("\n", "\n  "): ["a: |\n  {}\n"],
                 twice.rstrip("="): ["K={} x"]}
        for secret, places in forms.items():
            for place in places:
                text = place.format(secret)
                at = text.index(secret)
                assert [x for x in s.find_spans(text) if x[0] not in s.BASE_KINDS] == [(kind, at, at + len(secret))], text
    two = f"ssh-rsa {base64.b64encode(PUBLIC).decode().rstrip('=')}\nssh-rsa {base64.b64encode(PUBLIC).decode()}"
    assert len(s.find_spans(two)) == 2
    assert not s.is_der_key(DSA[:-1]) and not s.is_der_key(der(0x30, b"".join(number(7 ** k) for k in range(20, 26))))
    certificate = der(0x30, der(0x30, PKCS8) + der(0x30, b"\x06\x01\x2a") + der(3, bytes(40)))
    assert not s.find_spans(base64.b64encode(certificate).decode())
    assert not s.find_spans(base64.b64encode(b"---\nno key here, only words and more words\n").decode())


def test_redaction_and_table_cases(spark):
    rows = [(1, 'token = "abcdef123"; ok', "en", 23, 5), (2, None, "en", None, 5), (3, "", "en", 0, 5),
            (4, "clean text", "en", 99, 5), (4, "clean text", "en", 99, 5), (None, "deadbeef" * 4 + " x" * 50000, None, 1, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, found int")
    out = s.redact(df).collect()
    assert out[0].text == '[SECRET]"; ok' and out[0].n_chars == len(out[0].text)
    assert (out[1].text, out[2].text, out[3].n_chars) == (None, "", 99) and out[3] == out[4]
    assert out[5].text.startswith("[SECRET] x") and s.redact(df).columns == df.columns
    assert s.redact(df.limit(0)).count() == 0 and out[0].found == 5
    assert s.blank("password=abcdefabcdefabcdefabcdefabcdef", "#") == "#"


def test_query_digests(spark):
    from rollcall.llm.queries import QUERIES
    out = QUERIES["op10_secret_scan"](spark, "/root/testdata/sf0.001").toPandas().set_index("doc_id")
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        base, got = stated(r.text or ""), out.loc[r.doc_id]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert got.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (got.n_assign, got.n_access, got.n_hex) == tuple(sum(x[0] == k for x in base) for k in s.BASE_KINDS)
        assert not base or joined.split(",")[0] in got.spans


def _b64u(data: bytes) -> str:
    import base64
    return base64.urlsafe_b64encode(data).decode().rstrip("=")


def _pkcs8() -> bytes:
    key = bytes(range(200, 256)) * 2
    body = b"\x02\x01\x00" + b"\x30\x05\x06\x03\x2b\x65\x70" + b"\x04" + bytes([len(key)]) + key
    return b"\x30\x81" + bytes([len(body)]) + body


def test_tokens_with_white_space_and_prefixes():
    from rollcall.llm.secret_scan import find_spans
    for header, payload in ((b'{ "alg": "HS256" }', b'{ "sub": 1}'), (b'{\n "alg":"none"}', b'{"a":2}'), (b'{"alg":"RS256"}', b'{\t"b":3}')):
        token = f"{_b64u(header)}.{_b64u(payload)}.{_b64u(b'signature')}"
        for before in ("", "x_", "Bearer ", "abc", "they.few "):
            text = f"see {before}{token} there."
            assert ("jwt", 4 + len(before), 4 + len(before) + len(token)) in find_spans(text), (header, before)
    assert not [s for s in find_spans("they were few.eyes.only and newer.eyelids.x") if s[0] == "jwt"]


def test_keys_in_url_safe_base64_and_wrapped_hex():
    from rollcall.llm.secret_scan import find_spans, is_der_key
    der = _pkcs8()
    assert is_der_key(der)
    url = _b64u(der)
    assert "-" in url or "_" in url
    assert ("der", 4, 4 + len(url)) in find_spans(f"key={url} end")
    text = der.hex()
    lines = "\n    ".join(text[i:i + 32] for i in range(0, len(text), 32))
    colons = ":".join(text[i:i + 2] for i in range(0, len(text), 2))
    array = ", ".join("0x" + text[i:i + 2] for i in range(0, len(text), 2))
    for form in (lines, colons, colons.upper(), colons.replace("81:", "81:\n"), array):
        start = 5 + (2 if form is array else 0)
        assert ("der", start, 5 + len(form)) in find_spans("hex: " + form + "; 12"), form[:40]
    assert not [s for s in find_spans("hex: " + "30:82:01:00:" + "ab:" * 60) if s[0] == "der"]
