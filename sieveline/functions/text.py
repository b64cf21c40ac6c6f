"""Column functions on texts, and the strict JSON gate."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from sieveline.functions.rules import BENIGN, ENCODED_ENTROPY, ENCODED_FORM, ENCODED_LEAST_VALUE, ENCODED_MOST, token

BLANK = r"^(?U)\s*\z"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def entropy(text: Column) -> Column:
    """Shannon entropy of a text in bits a character."""
    chars = F.split(text, "")
    return let(F.filter(chars, lambda c: c != ""), lambda cs: F.aggregate(F.array_distinct(cs), F.lit(0.0), lambda acc, c: acc - let(F.size(F.filter(cs, lambda x: x == c)) / F.size(cs), lambda p: p * F.log2(p))))


def encoded_name_value(match: Column) -> Column:
    """The token if the match is base64 of name=<value> with a long and varied value, else null."""
    text = F.try_to_binary(match, F.lit("base64"))
    plain = F.when(F.is_valid_utf8(text.cast("string")), text.cast("string"))
    fits = let(F.regexp_extract(plain, ENCODED_FORM, 1), lambda v: (F.length(v) >= ENCODED_LEAST_VALUE) & (entropy(v) >= ENCODED_ENTROPY))
    return F.when((F.length(match) <= ENCODED_MOST) & (F.length(match) % 4 == 0) & F.coalesce(fits, F.lit(False)), F.lit(token("encoded-name-value")))


def interleaved(text: Column, pattern: str, decide: Callable[[Column], Column]) -> Column:
    """struct(text, n): each match m replaced by decide(m) unless that is null; n counts replacements.

    The expression must not match an empty text.
    """
    kept = lambda m: F.when(~m.isin(*BENIGN), decide(m))
    pairs = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.struct(m.alias("m"), kept(m).alias("r")))
    gaps = F.split(text, pattern, -1)
    return let(pairs, lambda ps: F.struct(F.array_join(F.flatten(F.zip_with(gaps, F.concat(F.transform(ps, lambda p: F.coalesce(p["r"], p["m"])), F.array(F.lit(""))), lambda g, m: F.array(F.coalesce(g, F.lit("")), F.coalesce(m, F.lit(""))))), "").alias("text"), F.size(F.filter(ps, lambda p: p["r"].isNotNull())).cast("bigint").alias("n")))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def is_blank(line: Column) -> Column:
    return line.rlike(BLANK)


_SURROGATE = re.compile("[\ud800-\udfff]")
MOST_DEPTH = 127


def _strict(value, depth: int = 0) -> bool:
    if isinstance(value, str):
        return not _SURROGATE.search(value)
    if isinstance(value, float):
        return math.isfinite(value)
    if isinstance(value, (list, dict)):
        if depth >= MOST_DEPTH:
            return False
        inner = value if isinstance(value, list) else [*value, *value.values()]
        return all(_strict(v, depth + 1) for v in inner)
    return True


def _no_constant(name: str):
    raise ValueError(name)


def parses(text: str | None) -> bool:
    """Whether a text is one JSON value to a strict parser: no NaN, no number out of range, no lone surrogate, no depth beyond MOST_DEPTH."""
    if text is None:
        return False
    try:
        return _strict(json.loads(text, parse_constant=_no_constant))
    except (ValueError, RecursionError):
        return False


def lines_parse(text: str | None) -> bool:
    """Whether every line that is not blank parses, and there is one."""
    some = [x for x in (text or "").split("\n") if x.strip()]
    return bool(some) and all(map(parses, some))


@F.pandas_udf(BooleanType())
def json_ok(text: pd.Series) -> pd.Series:
    return text.map(parses).astype(bool)


@F.pandas_udf(BooleanType())
def jsonl_ok(text: pd.Series) -> pd.Series:
    return text.map(lines_parse).astype(bool)
