"""The same operators over arriving pages."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from sitelake.functions import urls as U
from sitelake.operators import dedup, extract, sink

PAGES = "page_id long, url string, html string"


def page_stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", max_files).parquet(folder)


def visited_once(stream: DataFrame, event_time: str | None = None, within: str = "1 hour") -> DataFrame:
    """Each normalised URL once; with an event time, state is bounded by the watermark."""
    keyed = stream.withColumn("norm_url", U.normalize_url(F.col("url")))
    if event_time:
        return keyed.withWatermark(event_time, within).dropDuplicatesWithinWatermark(["norm_url"])
    return keyed.dropDuplicates(["norm_url"])


def locale_keep(stream: DataFrame, url_col: str = "url", seq: str = "page_id", preferred: str = dedup.PREFERRED) -> DataFrame:
    """seq, url, keep: the locale rule in arrival order; the state of a key is one of three letters."""
    info = U.locale_info(F.col(url_col))
    kind = F.when(~info["has_locale"], "N").when(info["language"] == preferred, "P").otherwise("O")
    keyed = stream.select(F.concat(U.url_parts(F.col(url_col))["host"], info["canonical_path"]).alias("key"), F.col(seq).cast("long").alias("seq"), F.col(url_col).alias("url"), kind.alias("kind")).filter("key is not null")

    def step(key, frames, state):  # noqa: ANN001, ANN202
        now = state.get[0] if state.exists else ""
        rows = pd.concat(list(frames)).sort_values("seq")
        keep = []
        for k in rows["kind"]:
            keep.append(k == "N" or not now or (k == "P" and now == "O"))
            if keep[-1]:
                now = k
        state.update((now,))
        yield pd.DataFrame({"seq": rows["seq"], "url": rows["url"], "keep": keep})

    return keyed.groupBy("key").applyInPandasWithState(step, "seq long, url string, keep boolean", "now string", "append", "NoTimeout")


def rate_windows(events: DataFrame, every: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Starts per window of event time (ts)."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", every)).agg(F.count(F.lit(1)).alias("starts")).select("window.start", "window.end", "starts")


def idle_sessions(events: DataFrame, key: str = "user_id", gap: str = "15 seconds", late: str = "10 seconds") -> DataFrame:
    """Runs of activity of each key that an idle gap ends."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(key, F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("events")).select(key, "session_window.start", "session_window.end", "events")


def ingest_stream(stream: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """Extract arriving pages and write their files; a batch that is repeated writes the same files again."""

    def put(batch: DataFrame, batch_id: int) -> None:
        made = extract.extract_pages(batch).withColumn("seq", F.col("page_id"))
        files = sink.page_files(made, crawled=F.lit(str(batch_id)))
        sink.write_files(files, os.path.join(folder, f"batch-{batch_id:06d}"))

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
