import os

from pyspark.sql import functions as F

from sitelake.operators import dedup
from sitelake.streaming import pages as S


def run(query, name):
    q = query.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_streams_give_what_batches_give(spark, sf_dir, tmp_path):
    folder = str(tmp_path / "in")
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id"), F.concat(F.lit("https://x.com"), F.element_at(F.array(*map(F.lit, ["", "/en", "/fr"])), (F.col("page_id") % 3 + 1).cast("int")), F.lit("/p"), (F.col("page_id") % 7).cast("string")).alias("url"), F.col("html"))
    for k in range(2):
        rows.filter(F.col("page_id") % 2 == k).coalesce(1).write.mode("append").parquet(folder)
    run(S.visited_once(S.page_stream(spark, folder)).select("norm_url"), "visited")
    assert spark.table("visited").count() == rows.select("url").distinct().count()
    run(S.locale_keep(S.page_stream(spark, folder)), "kept")
    want = {r.seq: r.keep for r in dedup.locale_dedup(rows.select(F.col("page_id").alias("seq"), "url")).collect()}
    assert {r.seq: r.keep for r in spark.table("kept").collect()} == want
    q = S.ingest_stream(S.page_stream(spark, folder), str(tmp_path / "out"), str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(len([f for f in names if f.endswith(".md")]) for _, _, names in os.walk(tmp_path / "out")) == rows.count()


def test_windows(spark, sf_dir, tmp_path):
    folder = str(tmp_path / "events")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    events.coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(events.schema).parquet(folder)
    run(S.rate_windows(stream, "1 hour", "1 second"), "rates")
    run(S.idle_sessions(stream, gap="15 minutes", late="1 second"), "idle")
    batch = {r["w"].start: r.n for r in events.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).collect()}
    got = {r.start: r.starts for r in spark.table("rates").collect()}
    assert got and all(batch[k] == v for k, v in got.items())
    assert spark.table("idle").count() > 0
