"""Markdown files: names, front matter, size cap, and the writer."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelake.functions import text as T
from sitelake.functions import urls as U
from sitelake.runtime import ship

RUNNING_BLOCK = 4096


def file_stem(url: Column, dir_name: Column | str | None = None) -> Column:
    """prefix__path of a page URL, safe as a file name, at most 200 characters."""
    given = F.lit(dir_name).cast("string") if not isinstance(dir_name, Column) else dir_name
    given = F.nullif(given, F.lit(""))
    p = U.url_parts(url)
    is_page = (url.startswith("http://") | url.startswith("https://")) & p.isNotNull()
    path = F.lower(F.translate(F.regexp_replace(F.regexp_replace(p["path"], "^/", ""), "/$", ""), "/", "_"))
    safe = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "(?i)[^a-z0-9._\\-]", "_"), "_+", "_"), "^_|_$", "")
    prefix = F.coalesce(given, F.when(is_page, F.regexp_replace(p["host"], r"^www\.", "")), F.lit("page"))
    tail = F.when(is_page, F.when(path == "", F.lit("index")).otherwise(path)).otherwise(F.lower(F.regexp_replace(url, "(?i)[^a-z0-9._\\-]", "_")))
    return F.left(F.concat(safe(F.lower(prefix)), F.lit("__"), safe(tail)), F.lit(200))


def unique_names(rows: DataFrame, stem: str = "stem", seq: str = "seq", ending: str = ".md", existing: DataFrame | None = None) -> DataFrame:
    """rows with filename: the stem, or the first of -1, -2, ... that no earlier row and no file in existing (filename) has.

    Stems without their number endings are families. Where a family has one stem and no file, a row's place among its stem is its
    number. Other families are named row by row, in one pass over their sorted rows; a task then holds a family's names.
    """
    family = lambda x: F.regexp_replace(x, "(-[0-9]+)+$", "")
    marked = rows.withColumn("__family", family(F.col(stem)))
    mixed = marked.groupBy("__family").agg(F.min(stem).alias("lo"), F.max(stem).alias("hi")).filter("lo <> hi").select("__family")
    taken = None
    if existing is not None:
        ends = F.endswith(F.col("filename"), F.lit(ending))
        taken = existing.filter(ends).select(F.left("filename", F.length("filename") - len(ending)).alias("name")).distinct().withColumn("__family", family(F.col("name")))
        mixed = mixed.union(taken.select("__family")).distinct()
    plain = marked.join(mixed, "__family", "left_anti")
    n = F.row_number().over(Window.partitionBy(stem).orderBy(seq)) - 1
    name = F.concat(F.col(stem), F.when(n > 0, F.concat(F.lit("-"), n.cast("string"))).otherwise(F.lit("")), F.lit(ending))
    plain = plain.withColumn("filename", name).select(*[F.col(c) for c in rows.columns], "filename")

    whole = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(rows.columns)])
    asked = marked.join(mixed, "__family", "left_semi").select("__family", F.lit(True).alias("asked"), F.col(seq).alias("at"), F.col(stem).alias("name"), whole.alias("row"))
    kind = asked.schema["row"].dataType.simpleString()
    if taken is not None:
        held = taken.join(asked.select("__family").distinct(), "__family", "left_semi")
        asked = asked.union(held.select("__family", F.lit(False), F.lit(None), "name", F.lit(None)))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used, following = None, set(), {}
        for batch in batches:
            names, keep = [], []
            for k, (of, is_asked, name) in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True)):
                if of != now:
                    now, used, following = of, set(), {}
                if not is_asked:
                    used.add(name)
                    continue
                made, n = name, following.get(name, 1)
                while made in used:
                    made, n = f"{name}-{n}", n + 1
                following[name] = n
                used.add(made)
                names.append(made)
                keep.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(4).take(pa.array(keep, pa.int64())), pa.array(names, pa.string())], ["row", "name"])

    ship(rows.sparkSession)
    ordered = asked.repartition("__family").sortWithinPartitions("__family", "asked", "at")
    numbered = ordered.mapInArrow(number, f"row {kind}, name string")
    named = numbered.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(rows.columns)], F.concat("name", F.lit(ending)).alias("filename"))
    return plain.unionByName(named)


def front_matter(title: Column, url: Column, author: Column, date: Column, crawled: Column) -> Column:
    quoted = lambda name, x: F.when(x != "", F.concat(F.lit(f'{name}: "'), F.replace(x, F.lit('"'), F.lit('\\"')), F.lit('"')))
    plain = lambda name, x: F.when(x != "", F.concat(F.lit(f'{name}: "'), x, F.lit('"')))
    return F.concat_ws("\n", F.lit("---"), quoted("title", title), plain("url", url), quoted("author", author), plain("date", date), plain("crawled", crawled), F.lit("---"), F.lit(""))


def within_cap(rows: DataFrame, cap_bytes: int | None, bytes_col: str = "bytes", seq: str = "seq") -> DataFrame:
    """rows with written: whether the bytes of all rows before are still below the cap.

    The running sum is over blocks of seq first (a row per block), then inside each block, so no task holds all rows.
    """
    if not cap_bytes:
        return rows.withColumn("written", F.lit(True))
    block = F.floor(F.col(seq) / RUNNING_BLOCK)
    sums = rows.groupBy(block.alias("__block")).agg(F.sum(bytes_col).alias("__sum"))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    inside = Window.partitionBy("__block").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.withColumn("__block", block).join(sums, "__block")
    return joined.withColumn("written", F.col("__before") + F.coalesce(F.sum(bytes_col).over(inside), F.lit(0)) < cap_bytes).select(*[F.col(c) for c in rows.columns], "written")


def page_files(results: DataFrame, dir_name: str | None = None, cap_bytes: int | None = None, crawled: Column | None = None, existing: DataFrame | None = None) -> DataFrame:
    """filename, content, bytes, seq of crawl results (seq, url, title, markdown, author, published_date).

    Rows that are empty are not written; a row is written while the rows before it stay below the cap.
    """
    crawled = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") if crawled is None else crawled
    filled = results.filter(U.js_trim(F.col("markdown")) != "")
    content = F.concat(front_matter(F.col("title"), F.col("url"), F.col("author"), F.col("published_date"), crawled), F.col("markdown"))
    made = filled.select("seq", file_stem(F.col("url"), dir_name).alias("stem"), content.alias("content")).withColumn("bytes", T.byte_size(F.col("content")))
    kept = within_cap(made, cap_bytes).filter("written").drop("written")
    return unique_names(kept, existing=existing).select("filename", "content", "bytes", "seq")


def source_files(files: DataFrame, cap_bytes: int | None = None, crawled: Column | None = None) -> DataFrame:
    """filename, content, bytes, seq of source files (seq, path, content, language, size); a later file of a name replaces an earlier one."""
    crawled = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") if crawled is None else crawled
    head = F.concat(F.lit('---\npath: "'), F.col("path"), F.lit('"\nlanguage: '), F.col("language"), F.lit("\nsize: "), F.col("size").cast("string"), F.lit('\ncrawled: "'), crawled, F.lit('"\n---\n\n'))
    body = F.concat(head, F.lit("```"), F.col("language"), F.lit("\n"), F.col("content"), F.lit("\n```\n"))
    made = files.select("seq", F.concat(F.translate("path", "/", "-"), F.lit(".md")).alias("filename"), body.alias("content")).withColumn("bytes", T.byte_size(F.col("content")))
    kept = within_cap(made, cap_bytes).filter("written")
    return kept.groupBy("filename").agg(F.max_by(F.struct("content", "bytes", "seq"), "seq").alias("w")).select("filename", "w.content", "w.bytes", "w.seq")


def write_files(files: DataFrame, folder: str) -> int:
    """Write filename, content below a folder that executors share; a repeated task writes the same files again. Returns how many."""

    def put(rows) -> None:
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            part = os.path.join(folder, f".{r['filename']}.part")
            with open(part, "w", encoding="utf-8", newline="") as f:
                f.write(r["content"])
            os.replace(part, os.path.join(folder, r["filename"]))

    files.select("filename", "content").foreachPartition(put)
    return files.count()


def ingest_stats(files: DataFrame) -> DataFrame:
    """pages, bytes of written files."""
    return files.agg(F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
