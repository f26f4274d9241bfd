"""Update: capture the target sites, extract, deduplicate, merge into the catalogue, summarise.

Sites are captured once: pages are written beside the catalogue, and the offers out of them too, before anything in the
catalogue is replaced. What is merged, emptied and summarised is read from these tables, so no step sees another answer of a shop.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrina.operators.catalog import keep_first, merge_into, update_summary, with_match_columns
from vitrina.operators.extract import extract_offers
from vitrina.sources.captures import SiteSource, stop_rows
from vitrina.sources.sites import sites


def fresh_offers(pages: DataFrame, registry: DataFrame) -> DataFrame:
    """Offers of captured pages up to each site's stop, the first of each title, ready for the catalogue."""
    found = stop_rows(extract_offers(pages, registry), pages)
    placed = found.withColumn("row_pos", F.col("page").cast("long") * 1_000_000 + F.col("pos"))
    once = keep_first(placed.drop("page", "pos"), ["store", "title"], ["row_pos"])
    return with_match_columns(once.join(F.broadcast(registry.select("store", "registry_pos")), "store"))  # the registry is a fixed table


def capture(spark: SparkSession, names: list[str] | None = None, dry_run: bool = False, workers: int | None = None) -> DataFrame:
    """Pages of the named sites (all without names); `workers` sites at a time, all at once without it."""
    spark.dataSource.register(SiteSource)
    return spark.read.format("site_pages").option("sites", ",".join(names or [])).option("dry_run", str(dry_run).lower()).option("workers", str(workers or 0)).load()


def kept_table(rows: DataFrame, path: str) -> DataFrame:
    """rows as a table: written, and read from there from now on."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def refresh(pages: DataFrame, catalogue: str, registry: DataFrame, targets: DataFrame) -> DataFrame:
    """Merge captured pages (a table) into the catalogue; the fresh offers, as a table."""
    fresh = kept_table(fresh_offers(pages, registry), f"{catalogue}-captures/offers-{uuid.uuid4().hex}")
    merge_into(catalogue, fresh, targets)
    return fresh


def progress(pages: DataFrame) -> list[str]:
    """A line for each captured site: its pages, and whether the last one failed."""
    seen = pages.groupBy("store").agg(F.count("*").alias("n"), F.max(F.col("html").isNull()).alias("failed")).orderBy("store").collect()  # a row a site
    return [f"[{i}/{len(seen)}] {r['store']}: {r['n']} páginas{' (error)' if r['failed'] else ''}" for i, r in enumerate(seen, 1)]


def update(spark: SparkSession, catalogue: str, names: list[str] | None = None, dry_run: bool = False, workers: int | None = None, show: Callable[[str], None] | None = None) -> DataFrame:
    """Refresh the Parquet catalogue and return its summary; sites without offers become empty."""
    registry = sites(spark)
    targets = registry.filter(F.col("store").isin(names)) if names else registry
    pages = kept_table(capture(spark, names, dry_run, workers), f"{catalogue}-captures/pages-{uuid.uuid4().hex}")
    for line in progress(pages) if show else ():
        show(line)
    fresh = refresh(pages, catalogue, registry, targets)
    written = spark.read.schema(fresh.schema).parquet(catalogue)
    return update_summary(written.join(F.broadcast(targets.select("store")), "store", "left_semi"), targets)
