import hashlib
import random
import re

from sieveline.llm import secrets


def brute(text):
    kinds = {"assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), "access": (r"AKIA[A-Z0-9]+", 0), "hex": (r"[0-9a-f]+", 0)}
    out = []
    for k, (p, flags) in kinds.items():
        for m in re.finditer(p, text or "", flags):
            if len(m[2] if k == "assign" else m[0]) >= {"assign": 8, "access": 16, "hex": 32}[k]:
                out.append((k, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(kinds).index(s[0])))


def base(text):
    return [s for s in secrets.find_spans(text) if s[0] in secrets.BASE_KINDS]


def test_base_spans_match_brute_force():
    r = random.Random(5)
    parts = ["password", "PassWD", "token", "API_KEY", "apikey", "secret", "=", ": ", "  :  ", "'", '"', "é", "ſ", "K", "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef" * 2, "abcdefgh", "x", "\n", "passwordpassword"]
    for _ in range(8000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(16)))
        assert base(t) == brute(t), t
    assert secrets.find_spans(None) == secrets.find_spans("") == []


def test_checksums_decide():
    body = "aB3" * 10
    good = "ghp_" + body + secrets.crc_base62(body)
    bad = "ghp_" + body + ("0" if good[-1] != "0" else "1") * 6
    assert [s[0] for s in secrets.find_spans(f"x {good} y")] == ["github"]
    assert secrets.find_spans(f"x {bad} y") == []
    assert secrets.redact(f"é {good} y") == "é [REDACTED-github] y"
    assert secrets.redact("clean") == "clean" and secrets.redact(None) is None


def test_long_texts_take_time_in_proportion():
    import time

    n = 40_000
    for text in ("eyJ" * n, "eyJ" * n + ".eyJ" * n, "eyJaaaaaaaa." * n, "password" * n, "password  " * n, "AKIA" * n, "0123456789abcdef" * n, "0123456789abcdef0123456789abcde " * n, "-----BEGIN " + "A" * n, "-----BEGIN PRIVATE KEY-----" * n, "-----BEGIN PRIVATE KEY-----" + "A" * n, "ghp_" * n, "xoxb-1234567890-" * n):
        began = time.process_time()
        secrets.find_spans(text)
        assert time.process_time() - began < 2


def test_a_token_after_a_missed_one_is_found():
    import base64

    part = lambda x: base64.urlsafe_b64encode(x).decode().rstrip("=")
    token = f"{part(b'{"alg":"HS256"}')}.{part(b'{"sub":"12345678"}')}.{'s' * 20}"
    for before in ("eyJeyJeyJ ", "eyJxxxxxxxxx.eyJ ", "eyJ."):
        text = before + token
        assert ("jwt", len(before), len(text)) in secrets.find_spans(text)


def test_query_and_stage(spark, odd_docs, no_docs):
    docs, wide, rows = odd_docs
    got = secrets.scan_documents(wide).collect()
    want = sorted((str(d), sum(s[0] == "assign" for s in brute(t)), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in brute(t)).encode()).hexdigest()) for d, t, *_ in rows)
    assert sorted((str(g["doc_id"]), g["n_assign"], g["base_sha256"]) for g in got) == want
    clean = secrets.redact_documents(docs)
    assert clean.schema == docs.schema and clean.count() == len(rows)
    for r in clean.where("text like '%REDACTED%'").collect():
        assert base(r["text"]) == [] and r["n_chars"] == len(r["text"])
    assert secrets.scan_documents(no_docs).count() == secrets.redact_documents(no_docs).count() == 0
