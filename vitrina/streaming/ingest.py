"""Captured pages that arrive as files become catalogue offers, micro-batch by micro-batch.

A batch may hold only some pages of a store. Its pages are kept beside the catalogue, a folder a batch; the batch's stores
are extracted again from all their pages so far, the newest capture of each page, and replace their partitions of the
catalogue. A batch that is tried again writes the same folder and the same rows again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from vitrina.schema import PAGE
from vitrina.sources.sites import sites
from vitrina.update import kept_table, refresh


def newest_pages(pages: DataFrame) -> DataFrame:
    """One row for each (store, page): the capture of the latest batch, of several in it the greatest."""
    return pages.groupBy("store", "page").agg(F.max(F.struct("batch", "url", "html")).alias("last")).select("store", "page", "last.url", "last.html")


def ingest_pages(spark: SparkSession, pages_dir: str, catalogue: str, checkpoint: str, registry: DataFrame | None = None) -> StreamingQuery:
    """Start the stream over Parquet captures (store, page, url, html) and run what is there to its end."""
    table = sites(spark) if registry is None else registry
    pages = spark.readStream.schema(PAGE).parquet(pages_dir)
    folder = f"{catalogue}-captures/arrived"

    def merge(batch: DataFrame, number: int) -> None:
        kept_table(batch.withColumn("batch", F.lit(number).cast("long")), f"{folder}/batch-{number}")
        arrived = batch.sparkSession.read.schema(T.StructType([*PAGE.fields, T.StructField("batch", T.LongType())])).option("recursiveFileLookup", True).parquet(folder).filter(F.col("batch") <= number)
        stores = arrived.filter(F.col("batch") == number).select("store").distinct()
        so_far = newest_pages(arrived.join(stores, "store", "left_semi"))
        refresh(kept_table(so_far, f"{catalogue}-captures/pages-of-batch-{number}"), catalogue, table, stores)

    return pages.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
