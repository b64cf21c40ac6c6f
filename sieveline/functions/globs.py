"""Globs over whole paths as anchored expressions, with two dialects."""

from __future__ import annotations

import fnmatch
import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_expression(glob: str) -> str:
    """Expression for a glob in which * and ? also take slashes, [..] are classes and {a,b} alternatives; an unclosed bracket raises ValueError."""
    out, depth, i = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            while glob[i + 1 : i + 2] == "*":
                i += 1
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = glob.find("]", i + 2 if glob[i + 1 : i + 2] not in ("!", "^") else i + 3)
            if end < 0:
                raise ValueError(f"unclosed [ in {glob!r}")
            body, no = glob[i + 1 : end], ""
            if body[0] in "!^":
                body, no = body[1:], "^"
            out.append("[" + no + re.sub(r"([\\\[\]^&~|])", r"\\\1", body) + "]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c))
        i += 1
    if depth:
        raise ValueError(f"unclosed {{ in {glob!r}")
    return r"^(?s:" + "".join(out) + r")\z"


def matches_any(path: Column, globs: list[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(glob_expression(g))
    return out


def absolute_glob(glob: str) -> str:
    """~ expanded, and a relative glob that does not begin with * made absolute."""
    if glob[:1] == "~":
        return os.path.expanduser(glob)
    return glob if glob[:1] in ("*", "/") else os.path.abspath(glob)


def prefix_excluded(path: str, globs: list[str]) -> bool:
    """Whether a path is excluded; a glob that ends in /* is also a literal prefix."""
    under = (g[:-2] for g in globs if g.endswith("/*"))
    return any(path == d or path.startswith(f"{d}/") for d in under) or any(fnmatch.fnmatch(path, g) for g in globs)


def prefix_excluded_column(path: Column, globs: list[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        if g.endswith("/*"):
            out = out | (path == g[:-2]) | path.startswith(g[:-1])
        out = out | path.rlike(fnmatch.translate(g).replace(r"\Z", r"\z").replace("(?>", "(?:"))
    return out


def escaped(name: str) -> str:
    """A name in which no character has a meaning for a glob."""
    return re.sub(r"[\[\]*?{}]", lambda m: f"[{m[0]}]", name)
