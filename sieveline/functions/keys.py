"""Private-key markers within one line, as a column expression.

BEGIN and END markers are found apart, so they may share dashes. They pair as brackets do; what lies inside a pair goes with it; pairs
that cross make the line ambiguous, and it is left as it is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveline.functions.text import let, lines

#: The markers.
BEGIN = r"-----BEGIN[ A-Z0-9]{0,100}?PRIVATE KEY(?: BLOCK)?-----"
END = r"-----END[ A-Z0-9]{0,100}?PRIVATE KEY(?: BLOCK)?-----"
SIGN, TOKEN = "PRIVATE KEY", "[REDACTED-private-key]"
RESULT = "struct<text:string,pairs:bigint,orphan_begin:bigint,orphan_end:bigint,aborted:boolean>"


def _places(line: Column, pattern: str, kind: int) -> Column:
    """array<struct<s,e,kind>> of the matches, offsets from 0."""
    steps = F.arrays_zip(F.slice(F.split(line, pattern, -1), 1, 1_000_000_000).alias("g"), F.regexp_extract_all(line, F.lit(pattern), F.lit(0)).alias("m"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,kind:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["g"])
        e = s + F.length(x["m"])
        more = F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), F.lit(kind).alias("kind"))))
        return F.when(x["m"].isNull(), acc).otherwise(F.struct(e.alias("at"), more.alias("out")))

    return F.aggregate(steps, start, step)["out"]


def key_line(line: Column) -> Column:
    """The line with its key blocks replaced and what was found, as RESULT."""
    nothing = F.struct(line.alias("text"), F.lit(0).cast("bigint").alias("pairs"), F.lit(0).cast("bigint").alias("orphan_begin"), F.lit(0).cast("bigint").alias("orphan_end"), F.lit(False).alias("aborted"))
    marks = F.array_sort(F.concat(_places(line, BEGIN, 0), _places(line, END, 1)))
    span = "array<struct<s:int,e:int>>"
    start = F.struct(F.array().cast("array<int>").alias("open"), F.array().cast(span).alias("pairs"), F.lit(0).alias("orphans"))

    def match(acc: Column, m: Column) -> Column:
        opened = F.struct(F.concat(acc["open"], F.array(m["s"])).alias("open"), acc["pairs"].alias("pairs"), acc["orphans"].alias("orphans"))
        n = F.size(acc["open"])
        pair = F.array(F.struct(F.get(acc["open"], n - 1).alias("s"), m["e"].alias("e")))
        closed = F.struct(F.slice(acc["open"], F.lit(1), n - 1).alias("open"), F.concat(acc["pairs"], pair).alias("pairs"), acc["orphans"].alias("orphans"))
        stray = F.struct(acc["open"].alias("open"), acc["pairs"].alias("pairs"), (acc["orphans"] + 1).alias("orphans"))
        return F.when(m["kind"] == 0, opened).when(n > 0, closed).otherwise(stray)

    outer_start = F.struct(F.lit(0).alias("to"), F.array().cast(span).alias("out"), F.lit(False).alias("cross"))

    def outer(acc: Column, p: Column) -> Column:
        new = F.struct(p["e"].alias("to"), F.concat(acc["out"], F.array(p)).alias("out"), acc["cross"].alias("cross"))
        inner = F.struct(acc["to"].alias("to"), acc["out"].alias("out"), (acc["cross"] | (p["e"] > acc["to"])).alias("cross"))
        return F.when(p["s"] >= acc["to"], new).otherwise(inner)

    def built(m: Column) -> Column:
        return let(F.aggregate(F.array_sort(m["pairs"]), outer_start, outer), lambda o: F.struct(
            F.when(o["cross"], line).otherwise(rewritten(o["out"])).alias("text"),
            F.when(o["cross"], F.lit(0)).otherwise(F.size(o["out"])).cast("bigint").alias("pairs"),
            F.size(m["open"]).cast("bigint").alias("orphan_begin"), m["orphans"].cast("bigint").alias("orphan_end"), o["cross"].alias("aborted"),
        ))

    def rewritten(spans: Column) -> Column:
        begin = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
        done = F.aggregate(spans, begin, lambda acc, p: F.struct(F.concat(acc["text"], F.substring(line, acc["at"] + 1, p["s"] - acc["at"]), F.lit(TOKEN)).alias("text"), p["e"].alias("at")))
        return let(done, lambda d: F.concat(d["text"], F.substring(line, d["at"] + 1, F.length(line))))

    return F.when(line.contains(SIGN), let(F.aggregate(marks, start, match), built)).otherwise(nothing)


def key_blocks(text: Column) -> Column:
    """Every line of a text by key_line: struct(text, pairs, orphan_begin, orphan_end, aborted_lines counted from 1)."""
    none = F.struct(text.alias("text"), F.lit(0).cast("bigint").alias("pairs"), F.lit(0).cast("bigint").alias("orphan_begin"), F.lit(0).cast("bigint").alias("orphan_end"), F.array().cast("array<int>").alias("aborted_lines"))
    total = lambda rs, f: F.aggregate(rs, F.lit(0).cast("bigint"), lambda acc, r: acc + r[f])
    at = lambda rs: F.transform(F.filter(F.transform(rs, lambda r, i: F.struct((i + 1).alias("i"), r["aborted"].alias("a"))), lambda x: x["a"]), lambda x: x["i"])
    some = let(F.transform(lines(text), key_line), lambda rs: F.struct(F.array_join(F.transform(rs, lambda r: r["text"]), "\n").alias("text"), total(rs, "pairs").alias("pairs"), total(rs, "orphan_begin").alias("orphan_begin"), total(rs, "orphan_end").alias("orphan_end"), at(rs).alias("aborted_lines")))
    return F.when(text.contains(SIGN), some).otherwise(none)
