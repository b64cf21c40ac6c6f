"""What earlier runs know about files: a JSON file that keeps, for each resolved path, the stamp of its last full reading."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNRESOLVED = ("orphan_begin", "orphan_end", "aborted_lines", "unsafe_lines")
SCHEMA = "key string, s_mtime_ns bigint, s_size bigint, unresolved struct<orphan_begin:bigint,orphan_end:bigint,aborted_lines:array<int>,unsafe_lines:array<int>>"


@dataclass
class State:
    rules: str = ""
    files: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str, rules: str) -> State:
        """An absent or torn file is an empty state. Under other rules, results kept for want of resolution go; clean stamps stay."""
        try:
            with open(path, encoding="utf-8") as f:
                raw = json.load(f)
            files = {k: v for k, v in raw["files"].items() if {"mtime_nanos", "size"} <= v.keys()}
            known = raw.get("rules", "")
        except (OSError, ValueError, KeyError, TypeError, AttributeError):
            files, known = {}, ""
        if known != rules:
            files = {k: v for k, v in files.items() if not v.get("unresolved")}
        return cls(rules, files)

    def save(self, path: str) -> None:
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        temp = f"{path}.tmp-{os.getpid()}"
        try:
            with open(temp, "w", encoding="utf-8") as f:
                json.dump({"files": self.files, "rules": self.rules}, f, indent=2, sort_keys=True)
            os.replace(temp, path)
        except OSError:
            if os.path.exists(temp):
                os.unlink(temp)
            raise

    def record(self, key: str, mtime_ns: int, size: int, unresolved: dict | None = None) -> None:
        self.files[key] = {"mtime_nanos": mtime_ns, "size": size} | ({"unresolved": unresolved} if unresolved else {})

    def frame(self, spark: SparkSession) -> DataFrame:
        """The state as SCHEMA rows, for the join that decides what is read."""
        rows = [(k, v["mtime_nanos"], v["size"], tuple(v["unresolved"].get(x) for x in UNRESOLVED) if v.get("unresolved") else None) for k, v in self.files.items()]
        return spark.createDataFrame(rows, SCHEMA)


def with_state(files: DataFrame, state: DataFrame) -> DataFrame:
    """Adds unresolved (the kept result, where the stamp is the same) and unchanged (the same stamp and nothing unresolved)."""
    j = files.join(state, "key", "left")
    same = F.coalesce((F.col("mtime_ns") == F.col("s_mtime_ns")) & (F.col("size") == F.col("s_size")), F.lit(False))
    return j.withColumn("unchanged", same & F.col("unresolved").isNull()).withColumn("unresolved", F.when(same, F.col("unresolved"))).drop("s_mtime_ns", "s_size")


def default_path(app: str = "sieveline") -> str:
    base = os.environ.get("XDG_STATE_HOME") or (os.path.join(os.environ["HOME"], ".local/state") if os.environ.get("HOME") else f".{app}-state")
    return os.path.join(base, app, "watermark.json")
