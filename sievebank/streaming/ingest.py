"""Pages that land in a folder, taken up as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.maintenance import upsert
from ..sources.pages import posts_of
from ..sources.snapshot import PAGES


def page_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """New files of a page folder; the checkpoint remembers which were read."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def follow_posts(pages: DataFrame, checkpoint: str, current: Callable[[], DataFrame | None], replace: Callable[[DataFrame], None]) -> StreamingQuery:
    """Merge the posts of each batch of pages into the table that ``current`` reads and ``replace`` writes.

    Merging a batch twice changes nothing, so a batch repeated after a failure does no harm.
    """

    def merge(batch: DataFrame, _: int) -> None:
        new = posts_of(batch).dropDuplicates(["id"])
        old = current()
        replace(new if old is None else upsert(old, new, "id", ("official_q", "author_name")))

    return pages.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_time(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Rows by type and window of time, for streams and tables alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
