"""A known positive in each run: rows that must be redacted, or the run proves nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.rules import Rule
from sieveline.operators.redact import redact_text, total_redactions


#: Three made-up keys, put together here so that no sweep rewrites them in this file.
KEYS = tuple(f"sk-{kind}-" + "Ab1" * 16 for kind in ("admin", "svcacct", "proj"))


def control_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k,) for k in KEYS], "text string")


def with_control(spark: SparkSession, df: DataFrame, rules: list[Rule], text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(df redacted with the control rows left out, one row: control_ok, files_with_matches, redactions without the control's).

    Both go through one plan, so the control meets what the data meets.
    """
    both = df.withColumn("__control", F.lit(False)).unionByName(control_rows(spark).withColumnRenamed("text", text).withColumn("__control", F.lit(True)), allowMissingColumns=True)
    done = redact_text(both, rules, text=text)
    n, c = total_redactions(), F.col("__control")
    told = done.agg(F.every(~c | ((n > 0) & ~F.col("redacted").contains("Ab1Ab1"))).alias("control_ok"), F.count_if(~c & (n > 0)).alias("files_with_matches"), F.coalesce(F.sum(F.when(~c, n)), F.lit(0)).alias("redactions"))
    return done.where(~c).drop("__control"), told


def verdict(told: DataFrame) -> DataFrame:
    """Adds outcome: control_failed, findings or clean. A failed control is never clean."""
    return told.withColumn("outcome", F.when(~F.col("control_ok"), "control_failed").when(F.col("redactions") > 0, "findings").otherwise("clean"))
