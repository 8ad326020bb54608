"""The environment of a run as a table of fields."""

from __future__ import annotations

import hashlib
import os
import platform
import subprocess
import sys
import time
from collections.abc import Sequence
from pathlib import Path

from pyspark import __version__ as spark_version
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_hash(path: str) -> str | None:
    p = Path(path)
    return hashlib.sha256(p.read_bytes()).hexdigest()[:16] if p.is_file() else None


def git_value(*args: str) -> str | None:
    try:
        done = subprocess.run(["git", *args], capture_output=True, text=True, timeout=10)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.strip() or None if done.returncode == 0 else None


def environment(spark: SparkSession, files: Sequence[str] = ()) -> DataFrame:
    """field and value: system, versions, commit, Spark's size, and hashes of files."""
    found = {
        "os": platform.platform(), "machine": platform.machine(), "cpus": os.cpu_count(), "python": sys.version.split()[0], "spark": spark_version,
        "master": spark.sparkContext.master, "parallelism": spark.sparkContext.defaultParallelism, "commit": git_value("rev-parse", "HEAD"), "branch": git_value("rev-parse", "--abbrev-ref", "HEAD"),
        "time": time.strftime("%Y%m%d_%H%M%S"), **{f"hash:{f}": file_hash(f) for f in files},
    }
    return spark.createDataFrame([(k, None if v is None else str(v)) for k, v in found.items()], "field string, value string")


def diff_text(diff: DataFrame) -> str:
    """Aligned lines of differences."""
    width = diff.agg(F.max(F.length("field"))).first()[0] or 0
    lines = diff.orderBy("field").select(F.concat(F.rpad("field", width, " "), F.lit("  "), F.coalesce("a", F.lit("-")), F.lit(" -> "), F.coalesce("b", F.lit("-"))))
    return "\n".join(r[0] for r in lines.collect())


def warnings(diff: DataFrame) -> list[str]:
    """A warning for each hash that differs: the sides were built from different files."""
    return [f"{r['field'].removeprefix('hash:')} differs between the sides" for r in diff.where(F.col("field").startswith("hash:")).orderBy("field").collect()]
