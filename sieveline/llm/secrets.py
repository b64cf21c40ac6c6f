"""Secret scans: Aho-Corasick keyword prefilter, anchored expressions at hits, checksum validation.

A text is walked once by an automaton of keywords. Only where a keyword was met is the
expression of its kind tried, anchored at that place. Kinds that embed a checksum or a
decodable header are kept only if it holds. The hexadecimal kind has no keyword; it is found by
one scan for a run of its characters.

Texts: null counts as empty; empty texts have no spans; texts of any length are scanned whole.
Repeated rows are each scanned. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from sieveline.llm.common import lean

#: Kinds in the order in which equal starts are listed; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "private_key", "slack", "google", "gitlab", "stripe")
BASE_KINDS = KINDS[:3]

#: Keywords (lower case) and the kind whose expression each one nominates.
KEYWORDS = {
    "password": "assign",
    "passwd": "assign",
    "secret": "assign",
    "token": "assign",
    "apikey": "assign",
    "api_key": "assign",
    "akia": "access",
    "ghp_": "github",
    "gho_": "github",
    "ghu_": "github",
    "ghs_": "github",
    "ghr_": "github",
    "npm_": "npm",
    "eyj": "jwt",
    "-----begin ": "private_key",
    "xoxb-": "slack",
    "xoxp-": "slack",
    "xoxa-": "slack",
    "xoxs-": "slack",
    "aiza": "google",
    "glpat-": "gitlab",
    "sk_live_": "stripe",
    "rk_live_": "stripe",
}
#: The expression of each kind. They hold ASCII only, so they run on UTF-8 bytes read as Latin-1.
PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]{32,}"),
    "github": re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"),
    "npm": re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"),
    "jwt": re.compile(r"(eyJ[A-Za-z0-9_-]{8,}+)\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{16,}"),
    "private_key": re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----([A-Za-z0-9+/=\s]{64,})-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----", re.A),
    "slack": re.compile(r"xox[bpas]-[0-9]{8,14}-[0-9A-Za-z-]{16,64}"),
    "google": re.compile(r"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])"),
    "gitlab": re.compile(r"glpat-[0-9A-Za-z_-]{20}(?![0-9A-Za-z_-])"),
    "stripe": re.compile(r"[sr]k_live_[0-9A-Za-z]{24,99}(?![0-9A-Za-z])"),
}
#: What a match of a kind cannot leave before its first run of these ends: after a miss, later hits in that run are misses too.
RUNS = {"jwt": re.compile(r"[A-Za-z0-9_-]*+")}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_base62(body: str) -> str:
    """The six-character checksum that some vendors append to a token's body."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out


def _jwt_header(part: str) -> bool:
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, TypeError, binascii.Error):
        return False


def _der_body(body: str) -> bool:
    """Base64 of a DER sequence whose stated length is the length that is there."""
    try:
        raw = base64.b64decode("".join(body.split()), validate=True)
    except (ValueError, binascii.Error):
        return False
    if len(raw) < 4 or raw[0] != 0x30:
        return raw[:14] == b"openssh-key-v1"
    if raw[1] < 0x80:
        return raw[1] == len(raw) - 2
    k = raw[1] & 0x7F
    return int.from_bytes(raw[2 : 2 + k], "big") == len(raw) - 2 - k


def _valid(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[2]) >= 8
    if kind == "access":
        return len(m[0]) >= 16
    if kind in ("github", "npm"):
        return crc_base62(m[1]) == m[2]
    if kind == "jwt":
        return _jwt_header(m[1])
    if kind == "private_key":
        return _der_body(m[1])
    return True


def _missed(seen: str, at: int, run: re.Pattern) -> int:
    """Where the next hit may match: a later hit of this run meets the same end and what follows it, with a shorter first part."""
    return run.match(seen, at).end()


_automaton: list = []


def automaton():
    """Keyword automaton, built once in each worker."""
    if not _automaton:
        import ahocorasick

        a = ahocorasick.Automaton()
        for word, kind in KEYWORDS.items():
            a.add_word(word, (len(word), kind))
        a.make_automaton()
        _automaton.append(a)
    return _automaton[0]


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets, ordered by start and then kind."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    seen, lower = raw.decode("latin-1"), raw.lower().decode("latin-1")
    hits: dict[str, set[int]] = {}
    for end, (n, kind) in automaton().iter(lower):
        hits.setdefault(kind, set()).add(end - n + 1)
    spans = [("hex", *m.span()) for m in PATTERNS["hex"].finditer(seen)]
    for kind, starts in hits.items():
        match, run, last = PATTERNS[kind].match, RUNS.get(kind), 0
        for at in sorted(starts):
            if at < last:
                continue
            if m := match(seen, at):
                last = m.end()
                if _valid(kind, m):
                    spans.append((kind, at, last))
            elif run:
                last = _missed(seen, at, run)
    if len(raw) != len(text):
        places, where, done = {}, 0, 0
        for p in sorted({p for s in spans for p in s[1:]}):
            where += len(raw[done:p].decode("utf-8", "surrogatepass"))
            places[p], done = where, p
        spans = [(k, places[a], places[b]) for k, a, b in spans]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def redact(text: str | None) -> str | None:
    """The text with every span, or run of overlapping spans, replaced by a placeholder of its first kind."""
    out, last, open_to = [], 0, 0
    for kind, a, b in find_spans(text):
        if a >= open_to:
            out += [text[last:a], f"[REDACTED-{kind}]"]
        open_to = last = max(open_to, b)
    return "".join([*out, text[last:]]) if out else text


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: its id, counts of the base kinds, digest of the base spans, and all spans."""
    schema = f"{id_col} bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [find_spans(t.as_py()) for t in b.column(1)]
            base = [[s for s in r if s[0] in BASE_KINDS] for r in rows]
            counts = [pa.array([sum(s[0] == k for s in r) for r in base], pa.int64()) for k in BASE_KINDS]
            digest = pa.array([hashlib.sha256(joined(r).encode()).hexdigest() for r in base], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, digest, pa.array([joined(r) for r in rows], pa.string())], schema_names)

    schema_names = [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    return docs.select(docs[id_col].cast("bigint").alias(id_col), docs[text_col].cast("string").alias("text")).mapInArrow(scan, schema)


def redact_documents(docs: DataFrame) -> DataFrame:
    """Documents with secrets replaced in their text and n_chars counted anew where it changed; no row is dropped."""
    names = docs.columns
    at, n_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols, texts = list(b.columns), b.column(at).to_pylist()
            new = [redact(t) for t in texts]
            cols[at] = pa.array(new, pa.string())
            if n_at is not None:
                cols[n_at] = pa.array([len(x) if x != t else n for t, x, n in zip(texts, new, cols[n_at].to_pylist(), strict=True)], cols[n_at].type)
            yield pa.RecordBatch.from_arrays(cols, b.schema.names)

    return docs.mapInArrow(lean(clean), docs.schema)
