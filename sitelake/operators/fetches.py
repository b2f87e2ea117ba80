"""Choosing a fetch result for each URL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from sitelake.functions import blocks
from sitelake.functions import urls as U


def judged(fetches: DataFrame) -> DataFrame:
    """fetches (url, engine, priority, status_code, html, final_url) with blocked, reason, confidence."""
    check = blocks.block_check(F.col("html"), F.col("status_code"))
    return fetches.withColumn("__check", check).select(*fetches.columns, "__check.*")


def pick(fetches: DataFrame, force_engine: str | None = None) -> DataFrame:
    """The first engine in order of priority that was not blocked, per URL; hosts that need a browser skip plain fetches.

    Of rows of one URL, priority and engine the least by its columns in their order is taken, so put what tells which was
    fetched first in front. With force_engine, that engine's row as it is.
    """
    if force_engine is not None:
        return judged(fetches.filter(F.col("engine") == force_engine))
    usable = judged(fetches.filter(~((F.col("engine") == "fetch") & U.needs_browser(F.col("url"))))).filter(~F.col("blocked"))
    names = ["priority", "engine", *[c for c in usable.columns if c not in ("priority", "engine")]]
    tied = [c for c in names if isinstance(usable.schema[c].dataType, AtomicType)]
    whole = F.struct(*names)
    # where all can be ordered, each row is carried once
    first = F.min(whole) if tied == names else F.min_by(whole, F.struct(*tied))
    best = usable.groupBy("url").agg(first.alias("w"))
    return best.select(*[F.col("w")[c].alias(c) for c in usable.columns])


def engine_stats(fetches: DataFrame) -> DataFrame:
    """engine, n: URLs that each engine won, and `blocked` for those that none did."""
    won = pick(fetches).groupBy("engine").agg(F.count(F.lit(1)).alias("n"))
    lost = fetches.select("url").distinct().join(pick(fetches).select("url"), "url", "left_anti")
    return won.unionByName(lost.agg(F.count(F.lit(1)).alias("n")).select(F.lit("blocked").alias("engine"), "n"))
