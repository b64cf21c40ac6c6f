"""Files: inventory, kinds, contents, and the rewrite that never overwrites a change."""

from __future__ import annotations

import contextlib
import os
import re
import stat
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.text import json_ok, jsonl_ok

#: What replace_file calls the file it writes beside another.
LEFTOVER = re.compile(r"\.(.*)\.[0-9a-f]{32}\.tmp")
INVENTORY = "visit bigint, root string, path string, key string, mtime_ns bigint, size bigint, stat_ok boolean"


def _visit(root: str, path: str) -> tuple:
    try:
        s = os.stat(path)
    except OSError:
        return root, path, os.path.realpath(path), None, None, False
    return root, path, os.path.realpath(path), s.st_mtime_ns, s.st_size, True


def inventory(spark: SparkSession, roots: list[str]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """(INVENTORY rows of all regular files under the roots, [(root, message)] of what could not be walked).

    A root may be a file, also by a link; links met in a walk are passed over.
    """
    rows, errors = [], []
    for root in map(str, roots):
        if not os.path.exists(root):
            errors.append((root, "path does not exist"))
        elif os.path.isfile(root):
            rows.append(_visit(root, root))
        else:
            for d, subs, names in os.walk(root, onerror=lambda e, root=root: errors.append((root, str(e)))):
                subs.sort()
                for name in sorted(names):
                    p = os.path.join(d, name)
                    with contextlib.suppress(OSError):
                        if stat.S_ISREG(os.lstat(p).st_mode):
                            rows.append(_visit(root, p))
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], INVENTORY), errors


def kind_by_name(path: Column) -> Column:
    """jsonl, json or text, by the extension as written."""
    ext = F.regexp_extract(path, r"[^/]\.([^./]+)\z", 1)
    return F.when(ext == "jsonl", "jsonl").when(ext == "json", "json").otherwise("text")


def detected_kind(path: Column, text: Column) -> Column:
    """The kind by name, but a .json that does not parse is jsonl if its lines do, else text."""
    named = kind_by_name(path)
    ask = F.when(named == "json", text)
    return F.when((named != "json") | json_ok(ask), named).when(jsonl_ok(ask), "jsonl").otherwise("text")


def is_valid(kind: Column, text: Column) -> Column:
    """Whether a text still has its kind's structure."""
    return F.when(kind == "json", json_ok(F.when(kind == "json", text))).when(kind == "jsonl", jsonl_ok(F.when(kind == "jsonl", text)) | ~text.rlike(r"(?U)\S")).otherwise(True)


def with_text(files: DataFrame) -> DataFrame:
    """Adds text: the content where it can be read and is UTF-8, else null. Read by the tasks that hold the rows."""
    names = files.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # a file at a time
                row = b.slice(i, 1)
                try:
                    with open(row.column(names.index("path"))[0].as_py(), encoding="utf-8", errors="strict", newline="") as f:
                        text = f.read()
                except (OSError, UnicodeDecodeError):
                    text = None
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([text], pa.string())], [*names, "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return files.mapInArrow(read, f"{schema}, text string")


def replace_file(path: str, text: str | Iterable[str], mtime_ns: int, size: int, at: Callable[[str], None] = lambda phase: None) -> tuple[int, int] | None:
    """Put text, whole or in parts that come one after another, in place of a file that still has this stamp; the new stamp, or None if it was refused.

    The new content lies complete and synced beside the file, with its mode, before it takes the name. `at` is told each phase.
    """

    def same() -> bool:
        s = os.stat(path)
        return (s.st_mtime_ns, s.st_size) == (mtime_ns, size)

    temp = os.path.join(os.path.dirname(path) or ".", f".{os.path.basename(path)[:80]}.{uuid.uuid4().hex}.tmp")
    try:
        if not same():
            return None
        mode = stat.S_IMODE(os.stat(path).st_mode)
        at("open")
        with os.fdopen(os.open(temp, os.O_WRONLY | os.O_CREAT | os.O_EXCL, mode & 0o600), "wb") as f:
            os.fchmod(f.fileno(), mode)
            for part in [text] if isinstance(text, str) else text:
                f.write(part.encode("utf-8"))
            f.flush()
            os.fsync(f.fileno())
            s = os.fstat(f.fileno())
        at("written")
        if not same():
            raise OSError("changed meanwhile")
        os.replace(temp, path)
    except (OSError, ValueError) as e:
        with contextlib.suppress(OSError):
            os.unlink(temp)
        if isinstance(e, ValueError):  # what the parts said of themselves
            raise
        return None
    with contextlib.suppress(OSError):
        d = os.open(os.path.dirname(path) or ".", os.O_RDONLY)
        try:
            os.fsync(d)
        finally:
            os.close(d)
    return s.st_mtime_ns, s.st_size


def possibly_live(mtime_ns: Column, window_s: float, now_ns: int | None = None) -> Column:
    """Changed within the window. A time in the future counts as old, so that no clock hides a file for ever."""
    now = F.lit(time.time_ns() if now_ns is None else now_ns)
    return (mtime_ns <= now) & (now - mtime_ns < int(window_s * 1e9))
