import base64
import json
import random
import re
import time

from siftstone.llm.secrets import KINDS, crc_base62, find_secrets, secret_digest, secrets

ASSIGN = re.compile(r"""(?ia:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


def test_base_kinds_equal_brute_force():
    r = random.Random(1)
    bits = ["password", "PassWd", "secret", "Token", "api_key", "APIKEY", "=", ": ", '"', "'", " ", "AKIA", "ABCD1234", "akia", "deadbeef" * 4, "x", "é", "İ", "K", "secret=short", "-_/"]
    for _ in range(3000):
        t = "".join(r.choice(bits) for _ in range(r.randrange(14)))
        assert [x for x in secrets(t) if x[1] < 3] == brute(t), t


def test_embedded_checksums():
    body = "aB3" * 10
    good = f"x ghp_{body}{crc_base62(body)} y npm_{body}{crc_base62(body)}"
    assert [KINDS[k] for _, k, _ in secrets(good)] == ["github", "npm"]
    assert secrets(f"ghp_{body}000000") == []
    assert [KINDS[k] for _, k, _ in secrets("eyJhbGciOiJIUzI1NiJ9.e30.abc")] == ["jwt"]
    assert secrets("eyJhbGciOiJ.e30.abc") == []


def pem(label, body, raw=None):
    return f"-----BEGIN {label}-----\n{body or base64.encodebytes(raw).decode()}-----END {label}-----"


def brute_added(t):
    """Every place of every added kind, later ones only beyond the last one taken."""
    out = []
    for kind, rule in ((3, r"gh[opsru]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), (4, r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")):
        out += [(m.start(), kind, m.end()) for m in re.finditer(rule, t) if crc_base62(m[0][4:34]) == m[0][34:]]
    for m in re.finditer(r"(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", t):
        try:
            if "alg" in json.loads(base64.urlsafe_b64decode(m[1] + "=" * (-len(m[1]) % 4))):
                out.append((m.start(), 5, m.end()))
        except (ValueError, TypeError):
            pass
    for m in re.finditer(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----([^-]*)-----END \1-----", t):
        try:
            raw = base64.b64decode("".join(m[2].split()), validate=True)
        except ValueError:
            continue
        if raw[:1] == b"0" and len(raw) == raw[1] + 2:
            out.append((m.start(), 6, m.end()))
    return sorted(out)


def test_added_kinds_equal_brute_force():
    r = random.Random(8)
    body = "Zx9" * 10
    good = body + crc_base62(body)
    bits = [f"ghp_{good}", f"ghs_{body}abcdef", f"npm_{good}", f"npm_{good}z", "eyJhbGciOiJIUzI1NiJ9", "eyJ", "EYJ", ".e30", ".", "-", " ", "x", "é", "İ"]
    bits += [pem("RSA PRIVATE KEY", "", b"0\x03abc"), pem("PRIVATE KEY", "", b"0\x09abc"), "-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----", "\n"]
    for _ in range(4000):
        t = "".join(r.choice(bits) for _ in range(r.randrange(12)))
        assert [x for x in secrets(t) if x[1] > 2] == brute_added(t), t


def test_whole_block():
    raw = b"0\x82\x01\x00" + bytes(256)
    for t, n in [
        (pem("EC PRIVATE KEY", "", raw), 1),
        (pem("EC PRIVATE KEY", "", raw + b"x"), 0),
        (pem("OPENSSH PRIVATE KEY", "", b"openssh-key-v1\0abc"), 1),
        (pem("RSA PRIVATE KEY", "Proc-Type: 4,ENCRYPTED\nDEK-Info: X,1\n\n" + base64.b64encode(bytes(16)).decode() + "\n"), 1),
        (pem("RSA PRIVATE KEY", "no base64!\n"), 0),
        ("-----BEGIN PRIVATE KEY-----\nMAA=\n-----END RSA PRIVATE KEY-----", 0),
    ]:
        assert [(s, KINDS[k], e) for s, k, e in secrets(f"é {t} z")] == [(2, "pem", 2 + len(t))] * n, t


def test_time_in_proportion():
    for t in ("eyJ" * 350_000, "eyJa." * 200_000, "-----BEGIN PRIVATE KEY-----\n" * 40_000, "".join(f"-----BEGIN {chr(65 + i % 26)}{chr(65 + i // 26 % 26)} PRIVATE KEY-----a" for i in range(30_000)) + "-----END PRIVATE KEY-----"):
        began = time.process_time()
        secrets(t)
        assert time.process_time() - began < 2


def test_frames(spark):
    rows = [(1, None, "x"), (2, "", "y"), (2, "token = " + "a" * 9, None), (None, "é token = " + "a" * 9 + " " * 100_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = secret_digest(df).collect()
    assert [r.n_assign for r in got] == [0, 0, 1, 1]
    assert got[3].spans == "assign:2:19"
    assert got[0].base_sha256 == got[1].base_sha256
    assert find_secrets(df).count() == 2
    assert secret_digest(df.limit(0)).count() == 0
