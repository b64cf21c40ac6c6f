"""Redaction of text columns: rules in order, then private keys; and of line records with a JSON gate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sieveline.functions.keys import key_blocks
from sieveline.functions.rules import Rule
from sieveline.functions.text import interleaved, is_blank, json_ok, lines

SUMMARY = "struct<counts:map<string,bigint>,pairs:bigint,orphan_begin:bigint,orphan_end:bigint,aborted_lines:array<int>>"

#: A character of no meaning that stands behind each replacement until it is counted.
MARK = "\ue000"


def rewrite(df: DataFrame, rule: Rule, text: str, n: str) -> DataFrame:
    """df with one rule applied to column `text` and column `n`, how many matches it replaced; published examples stay and are not counted.

    A text that holds none of the rule's literals is not searched.
    """
    t, zero = F.col(text), F.lit(0).cast("bigint")
    some = None
    for h in rule.hints:
        some = t.contains(h) if some is None else some | t.contains(h)
    guarded = lambda x, otherwise: x if some is None else F.when(some, x).otherwise(otherwise)
    if rule.decide or rule.may_be_benign:
        decide = rule.decide or (lambda m: F.regexp_replace(m, rule.java, rule.template))
        df = df.withColumn("__r", guarded(interleaved(t, rule.java, decide), F.struct(t.alias("text"), zero.alias("n"))))
        return df.withColumns({text: F.col("__r.text"), n: F.col("__r.n")}).drop("__r")
    # one pass: each replacement bears a mark, which is counted and taken off; a text that holds the mark itself is counted and replaced in two
    marked, two = F.col("__m"), guarded(t.contains(MARK), F.lit(False))
    df = df.withColumn("__m", guarded(F.when(~t.contains(MARK), F.regexp_replace(t, rule.java, rule.template + MARK)), F.lit(None)))
    df = df.withColumn("__s", F.replace(marked, F.lit(MARK), F.lit("")))
    counted = ((F.octet_length("__m") - F.octet_length("__s")) / len(MARK.encode())).cast("bigint")
    df = df.withColumn(n, F.when(marked.isNotNull(), counted).when(two, F.regexp_count(t, F.lit(rule.java)).cast("bigint")).otherwise(zero))
    return df.withColumn(text, F.when(marked.isNotNull(), F.col("__s")).when(two, F.regexp_replace(t, rule.java, rule.template)).otherwise(t)).drop("__m", "__s")


def redact_text(df: DataFrame, rules: list[Rule], keys: bool = True, text: str = "text", out: str = "redacted", summary: str = "summary") -> DataFrame:
    """Adds `out`, the text after all rules, and `summary`, what was done to it. A map-only step: no shuffle.

    Each rule sees what the earlier ones left; its count is taken there. Filters on the columns of df move below the rules, to the scan if they can;
    filters on the two new columns stay above them, where the rules are not repeated.
    """
    cols = df.columns
    df = df.withColumn("__t", F.col(text))
    for i, rule in enumerate(rules):
        df = rewrite(df, rule, "__t", f"__n{i}")
    zero = F.lit(0).cast("bigint")
    by_id: dict[str, Column] = {}
    for i, rule in enumerate(rules):
        n = F.coalesce(F.col(f"__n{i}"), zero)
        by_id[rule.id] = by_id[rule.id] + n if rule.id in by_id else n
    entries = F.array(*(F.struct(F.lit(k).alias("key"), n.alias("value")) for k, n in by_id.items())) if by_id else F.array().cast("array<struct<key:string,value:bigint>>")
    df = df.withColumn("__c", F.map_from_entries(F.filter(entries, lambda e: e["value"] > 0)))
    plain = F.struct(F.col("__t").alias("text"), *(zero.alias(x) for x in ("pairs", "orphan_begin", "orphan_end")), F.array().cast("array<int>").alias("aborted_lines"))
    df = df.withColumn("__k", key_blocks(F.col("__t")) if keys else plain)
    made = F.struct(F.col("__c").alias("counts"), *(F.col(f"__k.{x}").alias(x) for x in ("pairs", "orphan_begin", "orphan_end", "aborted_lines")))
    # a generator of one row: predicates on its columns stay above it, all others pass
    return df.select(*cols, F.inline_outer(F.array(F.struct(F.col("__k.text").alias(out), made.alias(summary)))))


def total_redactions(summary: str = "summary") -> Column:
    """Rule matches and key pairs; stray markers are no redactions."""
    return F.aggregate(F.map_values(f"{summary}.counts"), F.lit(0).cast("bigint"), lambda a, x: a + x) + F.col(f"{summary}.pairs")


def has_key_concern(summary: str = "summary") -> Column:
    return (F.col(f"{summary}.orphan_begin") > 0) | (F.col(f"{summary}.orphan_end") > 0) | (F.size(f"{summary}.aborted_lines") > 0)


def redact_lines(df: DataFrame, rules: list[Rule], keys: bool = True, text: str = "text", by_line: Column | None = None) -> DataFrame:
    """One row a line: the columns of df but the text, line_no (from 1), line, redacted, summary, refused.

    A line that parses as JSON and would not any more is refused: it stays, and counts nothing. Blank lines stay. Where by_line is false the
    whole text is one row without this gate. A null text is one row with a null line.
    """
    rest = [c for c in df.columns if c != text]
    by_line = F.lit(True) if by_line is None else by_line
    one = F.when(by_line, lines(F.col(text))).otherwise(F.array(text))
    each = df.select(*rest, by_line.alias("__by"), F.posexplode_outer(one).alias("line_no", "line")).withColumn("line_no", F.coalesce("line_no", F.lit(0)) + 1)
    done = redact_text(each, rules, keys, "line").withColumn("__n", F.when(F.col("__by") & is_blank(F.col("line")), F.lit(0)).otherwise(total_redactions()))
    # the gate is only asked about lines that were rewritten
    ask = F.col("__by") & (F.col("__n") > 0)
    done = done.withColumn("__was", json_ok(F.when(ask, F.col("line")))).withColumn("__is", json_ok(F.when(ask, F.col("redacted"))))
    done = done.withColumn("refused", F.coalesce(ask & F.col("__was") & ~F.col("__is"), F.lit(False)))
    zero = F.lit(0).cast("bigint")
    silent = F.col("refused") | F.col("__by") & is_blank(F.col("line")) | F.col("line").isNull()
    aborted = F.when(F.col("__by") & (F.size("summary.aborted_lines") > 0), F.array("line_no")).otherwise(F.col("summary.aborted_lines"))
    fields = F.struct(
        F.when(silent, F.map_from_entries(F.array().cast("array<struct<key:string,value:bigint>>"))).otherwise(F.col("summary.counts")).alias("counts"),
        *(F.when(silent, zero).otherwise(F.col(f"summary.{x}")).alias(x) for x in ("pairs", "orphan_begin", "orphan_end")),
        F.when(silent, F.array().cast("array<int>")).otherwise(aborted).alias("aborted_lines"),
    )
    kept = F.when((F.col("__n") > 0) & ~F.col("refused"), F.col("redacted")).otherwise(F.col("line"))
    return done.withColumn("redacted", kept).withColumn("summary", fields).drop("__n", "__was", "__is", "__by")


def redact_jsonl(df: DataFrame, rules: list[Rule], keys: bool = True, text: str = "text", by: tuple[str, ...] = ("path",), by_line: Column | None = None) -> DataFrame:
    """by columns, redacted (the text of all lines), summary, unsafe_lines: one row for each row of df, whatever its by columns hold.

    A map-only step: the lines of a text leave the rules one after another, in the task that split it, and are joined there. A null text stays null.
    """
    busy = (F.size("summary.counts") > 0) | (F.col("summary.pairs") > 0) | has_key_concern()
    marked = df.select(*(F.col(c).alias(f"by{i}") for i, c in enumerate(by)), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"), (F.lit(True) if by_line is None else by_line).alias("by_line"))
    each = redact_lines(marked, rules, keys, "text", F.col("by_line")).select("row", *(f"by{i}" for i in range(len(by))), "redacted", "line_no", "refused", F.when(busy, F.col("summary")).alias("summary"), busy.alias("busy"))
    first, last = 1 + len(by), 4 + len(by)
    names = [*by, "redacted", "summary", "unsafe_lines"]
    kinds = [df.schema[c].dataType.simpleString() for c in by]
    schema = ", ".join(f"`{c}` {k}" for c, k in zip(names, [*kinds, "string", SUMMARY, "array<int>"], strict=True))
    shape = to_arrow_schema(StructType.fromDDL(schema))

    def whole(runs: list[pa.RecordBatch]) -> pa.RecordBatch:
        """Every run of rows with one row number as one row."""
        b = pa.Table.from_batches(runs).combine_chunks().to_batches()[0]
        ids, texts, line_nos, refused = (b.column(i) for i in (0, first, first + 1, first + 2))
        busy = pc.fill_null(b.column(last + 1), False)
        begins = np.concatenate([[0], np.flatnonzero(np.diff(ids.to_numpy())) + 1])
        n, bounds = len(begins), np.append(begins, len(ids)).astype(np.int32)
        upto = lambda sizes: np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        # of lines with findings: the text each belongs to, and what the texts' findings come to
        of, owner = b.column(last).filter(busy), np.repeat(np.arange(n), np.diff(bounds))[busy.to_numpy(zero_copy_only=False)]
        counts, aborted = of.field("counts"), of.field("aborted_lines")
        found = pa.table({"at": np.repeat(owner, np.diff(counts.offsets)), "rule": counts.keys.slice(counts.offsets[0].as_py(), len(counts.keys)), "k": counts.items.slice(counts.offsets[0].as_py(), len(counts.items))})
        found = found.group_by(["at", "rule"], use_threads=False).aggregate([("k", "sum")]).sort_by([("at", "ascending"), ("rule", "ascending")]).combine_chunks()
        kinds = {f.name: f.type for f in shape.field(1 + len(by)).type}
        counted = pa.MapArray.from_arrays(pa.array(upto(np.bincount(found["at"].to_numpy(), minlength=n))), found["rule"].combine_chunks(), found["k_sum"].combine_chunks(), type=kinds["counts"])
        sums = []
        for x in ("pairs", "orphan_begin", "orphan_end"):
            total = np.zeros(n, np.int64)
            np.add.at(total, owner, of.field(x).to_numpy())
            sums.append(pa.array(total))
        stopped = pa.ListArray.from_arrays(pa.array(upto(np.bincount(owner, np.diff(aborted.offsets), n))), aborted.flatten())
        unsafe = pa.ListArray.from_arrays(pa.array(upto(refused.to_numpy(zero_copy_only=False))[bounds]), line_nos.filter(refused))
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), texts), "\n")  # the one line of a null text is null, and so is what it gives
        summary = pa.StructArray.from_arrays([counted, *sums, stopped.cast(kinds["aborted_lines"])], fields=list(shape.field(1 + len(by)).type))
        held = [b.column(1 + j).take(pa.array(begins)) for j in range(len(by))]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*held, text], shape, strict=False)] + [summary, unsafe.cast(shape.field(2 + len(by)).type)], schema=shape)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of rows with one row number, the last of which may go on in the next batch, as one row each; one batch out for one in."""
        going: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy()
            changes = np.flatnonzero(np.diff(ids)) + 1
            cut = int(changes[-1]) if len(changes) else 0
            if going and (cut or going[-1].column(0)[-1].as_py() != ids[0]):
                yield whole([*going, b.slice(0, cut)] if cut else going)
                going = []
            elif cut:
                yield whole([b.slice(0, cut)])
            going.append(b.slice(cut))
        if going:
            yield whole(going)

    return each.mapInArrow(join, schema)


def counts_as_rows(df: DataFrame, *by: str, summary: str = "summary") -> DataFrame:
    """(by, rule, n) rows of all counts, summed."""
    return df.select(*by, F.explode_outer(f"{summary}.counts").alias("rule", "k")).where("rule is not null").groupBy(*by, "rule").agg(F.sum("k").alias("n"))
