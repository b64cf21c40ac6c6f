"""The rules applied to single Python strings, for texts inside JSON of unknown shape."""

from __future__ import annotations

import base64
import binascii
import math
import re
from collections import Counter

from sieveline.functions import keys, rules

_TEMPLATE = re.compile(r"\\(.)|\$(\d)")
_compiled: dict[str, re.Pattern] = {}


def compiled(pattern: str) -> re.Pattern:
    if pattern not in _compiled:
        _compiled[pattern] = re.compile(pattern.replace(r"\z", r"\Z"))
    return _compiled[pattern]


def _encoded(match: str) -> str | None:
    if len(match) > rules.ENCODED_MOST or len(match) % 4:
        return None
    try:
        plain = base64.b64decode(match, validate=True).decode("utf-8")
    except (binascii.Error, UnicodeDecodeError):
        return None
    m = compiled(rules.ENCODED_FORM).search(plain)
    if not m or len(m[1]) < rules.ENCODED_LEAST_VALUE:
        return None
    shares = [n / len(m[1]) for n in Counter(m[1]).values()]
    return rules.token("encoded-name-value") if -sum(p * math.log2(p) for p in shares) >= rules.ENCODED_ENTROPY else None


def apply_rule(rule: rules.Rule, text: str) -> tuple[str, int]:
    """The text after one rule and how many matches it replaced."""
    n = 0

    def replacement(m: re.Match) -> str:
        nonlocal n
        if m[0] in rules.BENIGN:
            return m[0]
        new = _encoded(m[0]) if rule.decide else _TEMPLATE.sub(lambda t: t[1] if t[1] else m[int(t[2])] or "", rule.template)
        if new is None:
            return m[0]
        n += 1
        return new

    if rule.hints and not any(h in text for h in rule.hints):
        return text, 0
    out = compiled(rule.pattern).sub(replacement, text)
    return out, n


def key_line(line: str) -> tuple[str, int, int, int, bool]:
    """(text, pairs, stray BEGINs, stray ENDs, ambiguous) of one line."""
    if keys.SIGN not in line:
        return line, 0, 0, 0, False
    marks = sorted([(m.start(), m.end(), 0) for m in compiled(keys.BEGIN).finditer(line)] + [(m.start(), m.end(), 1) for m in compiled(keys.END).finditer(line)])
    opened, pairs, strays = [], [], 0
    for s, e, closes in marks:
        if not closes:
            opened.append(s)
        elif opened:
            pairs.append((opened.pop(), e))
        else:
            strays += 1
    out, to, n, done = [], 0, 0, 0
    for s, e in sorted(pairs):
        if s >= to:
            out += [line[done:s], keys.TOKEN]
            to = done = e
            n += 1
        elif e > to:
            return line, 0, len(opened), strays, True
    return "".join([*out, line[done:]]), n, len(opened), strays, False


_HEAD = re.compile(r"-----BEGIN[ A-Z0-9]*PRIVATE KEY[ A-Z]*-----")
_SEP = re.compile(r"(?:\s|\\n|\\r)+")
_PREFIX = re.compile(r"[ \t]*(?:\S*?:\d+[:\-][ \t]*|\d+[:\-\t ][ \t]*|[-+#>|][ \t]*)?")
_BODY = re.compile(r"[A-Za-z0-9+/=]+")
_FOOT = re.compile(r"-----END[ A-Z0-9]*PRIVATE KEY[ A-Z]*-----")
LEAST_BODY = 16


def _row(text: str, at: int) -> tuple[int, int] | None:
    """(length of the body run, where it and the separator behind it end) of a line of key material at `at`, with or without what tools put before a line."""
    best = None
    for start in dict.fromkeys((m.end() if (m := _PREFIX.match(text, at)) else at, at)):
        b = _BODY.match(text, start)
        if b and (best is None or b.end() - b.start() > best[0]):
            sep = _SEP.match(text, b.end())
            if sep or b.end() == len(text):
                best = b.end() - b.start(), sep.end() if sep else b.end()
    return best


def key_blocks_over_lines(text: str) -> tuple[str, int]:
    """Replaces private keys that run over lines, line by line from each header: a header alone, or before prose, stays."""
    out, done, n = [], 0, 0
    for head in _HEAD.finditer(text):
        if head.start() < done or not (sep := _SEP.match(text, head.end())):
            continue
        at, rows = sep.end(), 0
        while (row := _row(text, at)) and row[0] >= LEAST_BODY:
            at, rows = row[1], rows + 1
        if not rows:
            continue
        if row:  # a short last line
            at = row[1]
        p = _PREFIX.match(text, at)
        foot = _FOOT.match(text, at) or p and _FOOT.match(text, p.end())
        out += [text[done : head.start()], keys.TOKEN]
        done, n = foot.end() if foot else at, n + 1
    return "".join([*out, text[done:]]), n


def redact(text: str, some: list[rules.Rule], over_lines: bool = False) -> tuple[str, dict[str, int]]:
    """The text after all rules and key handling, and counts by id; stray markers count nothing."""
    counts: Counter = Counter()
    if over_lines:
        text, n = key_blocks_over_lines(text)
        counts["private-key"] += n
    for rule in some:
        text, n = apply_rule(rule, text)
        counts[rule.id] += n
    if keys.SIGN in text:
        done = [key_line(x) for x in text.split("\n")]
        text = "\n".join(d[0] for d in done)
        counts["private-key"] += sum(d[1] for d in done)
    return text, {k: v for k, v in counts.items() if v}
