"""Source trees: which files are read, and reading them (hidden names included, which file sources drop)."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelake.functions import fixed
from sitelake.functions.urls import base_domain, language_of_extension
from sitelake.runtime import ship


def extension(path: Column) -> Column:
    """Lower-cased ending of the name with its dot; a name that begins with its only dot has none."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]*)$", 1))


def wanted(path: Column, size: Column) -> Column:
    parts = F.split(path, "/")
    name, dirs = F.element_at(parts, -1), F.slice(parts, F.lit(1), F.size(parts) - 1)
    bad = F.exists(dirs, lambda d: d.startswith(".") | d.isin(*fixed.SKIP_DIRS))
    return ~bad & ~name.isin(*fixed.SKIP_FILES) & extension(path).isin(*fixed.CODE_EXTENSIONS) & (size > 0) & (size <= fixed.MAX_FILE_BYTES)


def filter_files(files: DataFrame) -> DataFrame:
    """path, content, language, size of the files (path, content, size) that are read."""
    kept = files.filter(wanted(F.col("path"), F.col("size"))).filter(~F.contains(F.col("content"), F.lit("\u0000")))
    return kept.select("path", "content", language_of_extension(extension(F.col("path"))).alias("language"), "size")


def _below(folder: str) -> list[tuple[str, int]]:
    out, stack = [], [""]
    while stack:
        at = stack.pop()
        with os.scandir(os.path.join(folder, at)) as entries:
            for e in entries:
                path = f"{at}/{e.name}" if at else e.name
                if e.is_dir(follow_symlinks=False):
                    if not e.name.startswith(".") and e.name not in fixed.SKIP_DIRS:
                        stack.append(path)
                elif e.is_file():
                    out.append((path, e.stat().st_size))
    return sorted(out)


def read_tree(spark: SparkSession, folder: str, partitions: int = 8) -> DataFrame:
    """seq, path, content, language, size of a tree on a shared file system: listed on the driver, read by the executors."""
    if not os.path.isdir(folder):
        raise FileNotFoundError(folder)
    ship(spark)
    listed = spark.createDataFrame([(i, p, s) for i, (p, s) in enumerate(_below(folder))], "seq long, path string, size long")
    listed = listed.filter(wanted(F.col("path"), F.col("size"))).repartition(partitions)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                with open(os.path.join(folder, row.column(1)[0].as_py()), encoding="utf-8", errors="replace") as f:
                    yield pa.RecordBatch.from_arrays([row.column(0), row.column(1), pa.array([f.read()]), row.column(2)], ["seq", "path", "content", "size"])

    made = listed.mapInArrow(read, "seq long, path string, content string, size long")
    return made.filter(~F.contains("content", F.lit("\u0000"))).select("seq", "path", "content", language_of_extension(extension(F.col("path"))).alias("language"), "size")


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Stored sessions (one JSON file each), the latest used first."""
    return spark.read.schema("domain string, createdAt string, lastUsed string").option("multiLine", True).option("pathGlobFilter", "*.json").json(folder).orderBy(F.desc("lastUsed"))


def with_session(urls: DataFrame, stored: DataFrame, url_col: str = "url") -> DataFrame:
    """The rows whose host, without www., has a stored session (domain)."""
    domains = stored.select(F.regexp_replace(F.lower("domain"), r"^www\.", "").alias("__domain"))
    return urls.join(domains, base_domain(F.col(url_col)) == domains["__domain"], "left_semi")
