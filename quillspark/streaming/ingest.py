"""Ingest by Structured Streaming: pages that land as files become rows of the archive, and the index grows.

Each micro-batch appends what is new by anti-joins with the stored tables, so a batch that is run again
after a failure adds nothing twice. The stream's checkpoint holds the position. Authors, which are
replaced as a whole, are versioned, and the last version published.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.operators import index, store
from quillspark.operators.cards import index_docs
from quillspark.sources.place import delete, others, publish, published

STATUSES = f"store_key string, uri string, content string, created_at string, acct string, id string, url string, spoiler_text string, media {store.MEDIA}"
MARKS = "store_key string, uri string, type string, seq long"
AUTHORS = "store_key string, acct string, display_name string, avatar string, url string"


def table(spark: SparkSession, base: str, name: str, schema: str) -> DataFrame:
    """A stored table, empty if there is none yet."""
    try:
        return spark.read.schema(schema).parquet(f"{base}/{name}")
    except AnalysisException:
        return spark.createDataFrame([], schema)


def authors(spark: SparkSession, base: str) -> DataFrame:
    name = published(spark, f"{base}/authors_current", "name string")
    return table(spark, base, f"authors/{name[0][0]}", AUTHORS) if name else spark.createDataFrame([], AUTHORS)


def statuses(spark: SparkSession, base: str) -> DataFrame:
    """Stored statuses with their types."""
    marked = store.types_of(table(spark, base, "marks", MARKS), "store_key", "uri")
    return table(spark, base, "statuses", STATUSES).join(marked, ["store_key", "uri"], "left")


def save_entries(entries: DataFrame, base: str, batch: int | str) -> None:
    """Stores a batch of entries (``store.unwrapped`` or ``store.typed``)."""
    spark = entries.sparkSession
    store.add_statuses(table(spark, base, "statuses", STATUSES), entries).write.mode("append").parquet(f"{base}/statuses")
    store.add_marks(table(spark, base, "marks", MARKS), entries).write.mode("append").parquet(f"{base}/marks")
    name = f"{batch}-{uuid.uuid4().hex}"
    before = published(spark, f"{base}/authors_current", "name string")
    store.upsert_authors(authors(spark, base), entries).write.parquet(f"{base}/authors/{name}")
    publish(spark.createDataFrame([(name,)], "name string"), f"{base}/authors_current")
    for old in others(spark, f"{base}/authors", {name, *(r[0] for r in before or [])}):
        delete(spark, old)


def grow_index(spark: SparkSession, base: str) -> index.Index:
    """Adds to the stored index what the archive has and it has not, as a segment."""
    return index.append(spark, f"{base}/index", index_docs(table(spark, base, "statuses", STATUSES)))


def ingest(spark: SparkSession, landing: str, base: str, kind: str | None = None, max_files: int = 100) -> StreamingQuery:
    """Reads all pages (JSON, ``store.PAGE``) that have landed, then stops; later runs go on from there.

    ``kind`` is the type of a marked list, or nothing for own entries.
    """

    def batch(pages: DataFrame, number: int) -> None:
        if pages.isEmpty():
            return
        entries = store.typed(pages, kind) if kind else store.unwrapped(pages)
        save_entries(entries, base, f"{kind or 'own'}-{number}")
        grow_index(pages.sparkSession, base)

    pages = spark.readStream.schema(store.PAGE).option("maxFilesPerTrigger", max_files).json(landing)
    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", f"{base}/checkpoints/{kind or 'own'}").trigger(availableNow=True).start()


def deduplicated(pages: DataFrame, delay: str) -> DataFrame:
    """A stream of entries without repeated statuses, for streams with an event time ``at``.

    The watermark bounds the state; statuses that come again later than ``delay`` are left to the
    anti-join with the stored table.
    """
    return pages.withWatermark("at", delay).dropDuplicatesWithinWatermark(["uri"])


def tallied(events: DataFrame, every: str, delay: str) -> DataFrame:
    """Counts of each type by window of event time ``at``."""
    return events.withWatermark("at", delay).groupBy(F.window("at", every), "type").agg(F.count(F.lit(1)).alias("n"))
