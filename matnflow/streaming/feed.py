"""A feed of posts as a stream: each post once, checked against static corpora, resumable."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.fragments import looks_arabic

PAUSE = "400 milliseconds"


def new_posts(feed: DataFrame, post_id: str = "post_id", seen_at: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Each post once. With a time column the memory of posts is bounded by a watermark of ``delay``."""
    if seen_at:
        return feed.withWatermark(seen_at, delay).dropDuplicatesWithinWatermark([post_id])
    return feed.dropDuplicates([post_id])


def worth_checking(posts: DataFrame, text: str = "text", images: str | None = None, automatic: bool = True) -> DataFrame:
    """Posts with enough Arabic letters, or with pictures; none if checks are started by hand only."""
    test = looks_arabic(text)
    if images:
        test = test | (F.coalesce(F.size(images), F.lit(0)) > 0)
    return posts.where(test if automatic else F.lit(False))


def check_feed(posts: DataFrame, check: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Run ``check`` on every micro-batch and append its rows to ``out``.

    ``check`` is the batch pipeline. Each batch is written to a directory of its own, which
    a repeated batch replaces, so a restart neither loses nor doubles results.
    """

    def sink(batch: DataFrame, number: int) -> None:
        check(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = posts.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=PAUSE)).start()
