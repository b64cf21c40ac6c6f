"""User rules from a TOML file: [patterns] custom = ["expression", ...]."""

from __future__ import annotations

import re
import tomllib

from sieveline.functions.rules import Rule, simple

#: What the linear-time dialect of the rules does not have.
FOREIGN = re.compile(r"\(\?(?:[=!>]|<[=!])|(?<!\\)(?:\\\\)*\\[1-9]|[+*?}]\+")


def custom_rules(path: str) -> tuple[list[Rule], list[str]]:
    """The rules that are valid, all with the id custom, and a sentence for each problem; these name a place in the file, never an expression."""
    try:
        with open(path, "rb") as f:
            raw = f.read()
    except OSError:
        return [], [f"{path} is missing or unreadable, so custom patterns are off"]
    try:
        some = tomllib.loads(raw.decode("utf-8")).get("patterns", {}).get("custom", [])
        if not isinstance(some, list) or not all(isinstance(x, str) for x in some):
            raise ValueError
    except (ValueError, AttributeError):
        return [], [f"{path} does not parse, so custom patterns are off"]
    rules, problems = [], []
    for i, text in enumerate(some, 1):
        try:
            if FOREIGN.search(text):
                raise re.error("not in the dialect")
            re.compile(text.replace(r"\z", r"\Z"))
            rules.append(simple("custom", text))
        except re.error:
            problems.append(f"{path} has an invalid custom pattern at position {i}, which is off")
    return rules, problems
