"""The file sweep: inventory, decisions, redaction, rewrite, state, report."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.globs import matches_any
from sieveline.functions.rules import Rule, fingerprint
from sieveline.operators.redact import SUMMARY, has_key_concern, redact_jsonl, redact_text, total_redactions
from sieveline.sources.files import detected_kind, inventory, is_valid, possibly_live, replace_file, with_text
from sieveline.sources.state import UNRESOLVED, State, with_state


@dataclass(frozen=True)
class Options:
    write: bool = False
    exclude: tuple[str, ...] = ()
    live_window_s: float = 300.0
    state_path: str | None = None
    keys: bool = True


RESULT = f"visit bigint, path string, key string, mtime_ns bigint, size bigint, outcome string, skip_reason string, summary {SUMMARY}, unsafe_lines array<int>, n bigint, written boolean, new_mtime_ns bigint, new_size bigint, from_state boolean"


def decided(files: DataFrame, options: Options, now_ns: int | None = None) -> DataFrame:
    """Adds decision to files that carry their state: excluded, read_error, possibly_live, cached, unchanged or read. The order decides."""
    live = possibly_live(F.col("mtime_ns"), options.live_window_s, now_ns)
    return files.withColumn("decision", F.when(matches_any(F.col("path"), list(options.exclude)), "excluded").when(~F.col("stat_ok"), "read_error").when(live, "possibly_live").when(F.col("unresolved").isNotNull(), "cached").when(F.col("unchanged"), "unchanged").otherwise("read"))


def redacted_files(files: DataFrame, rules: list[Rule], keys: bool) -> DataFrame:
    """files(path, text, ...) -> its columns but the text, kind, redacted, summary, unsafe_lines, n, valid: one plan without a shuffle, so each text is made once."""
    rest = tuple(c for c in files.columns if c != "text")
    kinds = files.withColumn("kind", detected_kind(F.col("path"), F.col("text")))
    both = redact_jsonl(kinds, rules, keys, by=(*rest, "kind"), by_line=F.col("kind") == "jsonl").withColumn("n", total_redactions())
    return both.withColumn("valid", (F.col("kind") == "jsonl") | is_valid(F.col("kind"), F.col("redacted")))


def outcome():
    """Of a file: clean, redacted or validation_failed; null where it could not be read."""
    open_ = has_key_concern() | (F.size("unsafe_lines") > 0)
    return F.when(F.col("redacted").isNull(), None).when((F.col("n") == 0) & ~open_, "clean").when(~F.col("valid"), "validation_failed").otherwise("redacted")


def scan(spark: SparkSession, roots: list[str], rules: list[Rule], options: Options, now_ns: int | None = None) -> tuple[DataFrame, list[tuple[str, str]]]:
    """(RESULT rows, root errors). Only files that no earlier decision settles are opened. Rows of a file that is met again are told from its first visit."""
    rules_id = fingerprint(rules, options.keys)
    state = State.load(options.state_path, rules_id) if options.state_path else State(rules_id)
    files, errors = inventory(spark, roots)
    files = decided(with_state(files, state.frame(spark)), options, now_ns)
    rows = files.select("visit", "path", "key", "mtime_ns", "size", "decision", "unresolved").orderBy("visit").collect()  # stamps only, as many as the inventory the driver made
    seen: dict[str, int] = {}
    todo = []
    for r in rows:
        if r["decision"] == "read" and r["key"] not in seen:
            seen[r["key"]] = r["visit"]
            todo.append((r["visit"], r["path"], r["key"], r["mtime_ns"], r["size"]))
    found = {}
    if todo:
        parts = min(len(todo), 4 * spark.sparkContext.defaultParallelism)
        read = with_text(spark.createDataFrame(todo, "visit bigint, path string, key string, mtime_ns bigint, size bigint").repartition(parts))
        done = redacted_files(read, rules, options.keys).withColumn("outcome", outcome())
        found = {r["visit"]: r for r in _put(done, options.write).collect()}
    out = []
    for r in rows:
        base = (r["visit"], r["path"], r["key"], r["mtime_ns"], r["size"])
        empty = ({}, 0, 0, 0, [])
        if r["decision"] == "cached":
            u = r["unresolved"]
            out.append((*base, "redacted", None, ({}, 0, u["orphan_begin"], u["orphan_end"], u["aborted_lines"] or []), u["unsafe_lines"] or [], 0, False, None, None, True))
        elif r["decision"] != "read":
            out.append((*base, "skipped", r["decision"], empty, [], 0, False, None, None, False))
        else:
            f = found[seen[r["key"]]]
            if f["outcome"] is None:
                out.append((*base, "skipped", "read_error", empty, [], 0, False, None, None, False))
                continue
            settled = f["outcome"] == "clean" or f["outcome"] == "redacted" and f["written"] and not _open(f)
            if r["visit"] != seen[r["key"]] and settled:
                out.append((*base, "skipped", "unchanged", empty, [], 0, False, None, None, False))
                continue
            out.append((*base, f["outcome"], None, f["summary"], f["unsafe_lines"], f["n"], f["written"], f["new_mtime_ns"], f["new_size"], False))
            if r["visit"] == seen[r["key"]]:
                _record(state, f)
    if options.state_path:
        state.save(options.state_path)
    return spark.createDataFrame(out, RESULT), errors


def _open(f) -> bool:
    s = f["summary"]
    return bool(s["orphan_begin"] or s["orphan_end"] or s["aborted_lines"] or f["unsafe_lines"])


def state_action():
    """What the state learns from a file that was read: record, record_unresolved, record_new or nothing."""
    open_ = has_key_concern() | (F.size("unsafe_lines") > 0)
    return F.when(F.col("outcome") == "clean", "record").when((F.col("outcome") == "redacted") & (F.col("n") == 0), "record_unresolved").when(F.col("written") & ~open_, "record_new").otherwise("nothing")


def _record(state: State, f) -> None:
    action = f["action"]
    if action == "record":
        state.record(f["key"], f["mtime_ns"], f["size"])
    elif action == "record_new":
        state.record(f["key"], f["new_mtime_ns"], f["new_size"])
    elif action == "record_unresolved":
        s = f["summary"]
        state.record(f["key"], f["mtime_ns"], f["size"], dict(zip(UNRESOLVED, (s["orphan_begin"], s["orphan_end"], list(s["aborted_lines"]), list(f["unsafe_lines"])), strict=True)))


def _put(done: DataFrame, write: bool) -> DataFrame:
    """Rewrites the files that have redactions and are valid, if asked to, and drops the texts."""
    names = [c for c in done.columns if c != "redacted"]
    due = (F.col("n") > 0) & (F.col("outcome") == "redacted") & F.lit(write)
    done = done.withColumn("__due", F.coalesce(due, F.lit(False))).withColumn("redacted", F.when(F.col("__due"), F.col("redacted")))
    at = {c: i for i, c in enumerate(done.columns)}

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            get = lambda c, b=b: b.column(at[c]).to_pylist()
            new = [replace_file(p, t, m, s) if d else None for d, p, t, m, s in zip(get("__due"), get("path"), get("redacted"), get("mtime_ns"), get("size"), strict=True)]
            extra = [pa.array([x is not None for x in new]), pa.array([x and x[0] for x in new], pa.int64()), pa.array([x and x[1] for x in new], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(b.column(at[c]) for c in names), *extra], [*names, "written", "new_mtime_ns", "new_size"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in done.schema.fields if f.name in names)
    return done.mapInArrow(put, f"{schema}, written boolean, new_mtime_ns bigint, new_size bigint").withColumn("action", state_action())


def totals(results: DataFrame, write: bool) -> DataFrame:
    """One row: what a report counts."""
    red = F.col("outcome") == "redacted"
    return results.agg(
        F.count_if(red).alias("files_with_matches"), F.coalesce(F.sum(F.when(red, F.col("n"))), F.lit(0)).alias("redactions"), F.count_if(F.col("outcome") == "validation_failed").alias("validation_failures"),
        F.count_if(F.col("skip_reason") == "possibly_live").alias("live_skips"), F.count_if(red & (F.size("unsafe_lines") > 0)).alias("unsafe_line_files"), F.count_if(red & has_key_concern()).alias("key_concern_files"),
        F.count_if(red & F.lit(write) & ~F.col("written") & (F.col("n") > 0)).alias("not_written_files"),
    )


def trouble(total: DataFrame, root_errors: int = 0) -> DataFrame:
    """Adds trouble: whether a caller should treat the run as not clean. Live files and unreadable ones do not count."""
    return total.withColumn("trouble", (F.col("validation_failures") + F.col("unsafe_line_files") + F.col("key_concern_files") + F.col("not_written_files") + F.lit(root_errors)) > 0)


def mode_label(write: bool):
    return F.when(F.col("written"), "written").when(F.lit(write) & (F.col("n") > 0), "NOT written: changed during the scan or not replaceable").when(F.lit(write), "nothing to write").otherwise("dry-run")


def report(results: DataFrame, errors: list[tuple[str, str]], write: bool, name: str = "sieveline") -> tuple[list[str], bool]:
    """(lines, trouble)."""
    out = []
    for r in results.withColumn("label", mode_label(write)).orderBy("visit").collect():
        s = r["summary"]
        if r["outcome"] == "redacted":
            out.append(f"{r['path']} [{r['label']}] {r['n']} redaction(s): {dict(sorted(s['counts'].items()))}")
            if s["aborted_lines"]:
                out.append(f"  ! private-key markers cross on line(s) {list(s['aborted_lines'])}: left as they are, needs a person")
            if s["orphan_begin"] or s["orphan_end"]:
                out.append(f"  ! {s['orphan_begin']} BEGIN / {s['orphan_end']} END marker(s) without a partner on their line: left as they are")
            if r["unsafe_lines"]:
                out.append(f"  ! line(s) {list(r['unsafe_lines'])} would break as JSON: left as they are, needs a person")
        elif r["outcome"] == "validation_failed":
            out.append(f"{r['path']} FAILED validity gate, NOT written: {dict(sorted(s['counts'].items()))}")
        elif r["skip_reason"] == "read_error":
            out.append(f"{r['path']} skipped (read error)")
    t = trouble(totals(results, write), len(errors)).first()
    out += [f"{p}: {m}" for p, m in errors]
    if t["live_skips"]:
        out.append(f"{t['live_skips']} file(s) skipped as possibly still being written")
    out.append(f"{name}: {t['files_with_matches']} file(s) with matches, {t['redactions']} total redaction(s), {t['validation_failures']} validation failure(s), {t['unsafe_line_files']} file(s) with unsafe lines, {t['key_concern_files']} file(s) with unresolved markers, {t['not_written_files']} file(s) not written, write_mode={str(write).lower()}")
    return out, bool(t["trouble"])
