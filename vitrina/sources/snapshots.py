"""Snapshots: the Parquet catalogue that updates write, a CSV for each store, one merged JSON document, JSON lines.

The merged document is one value, {store: [offers]}, in one file. Lines are the same in a folder: an offer a line with its
store and place, and a line without an offer for each store that has none; any number of tasks write and read them.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrina.operators.catalog import with_match_columns
from vitrina.schema import CATALOGUE, LINE, MERGED, OFFER
from vitrina.sources.sites import site_rows

#: Rows of a CSV file that holds any stores: files are never split, so one is a reading task.
ROWS_A_FILE = 500_000


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system Spark resolves it to."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def is_folder(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()


def read_csv(spark: SparkSession, paths: list[str], by_store: bool = True) -> DataFrame:
    """Raw offers with the file's name and the row's place in it: a file with quoted line feeds is never split, so the
    numbers of its rows rise in their order. by_store as for write_csv(): else the rows tell their store."""
    schema = OFFER if by_store else T.StructType([*OFFER.fields, LINE["store"]])
    raw = spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(paths)
    return raw.select("*", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("row_pos"))


def load_csv(spark: SparkSession, folder: str) -> DataFrame:
    """The registered stores' files in a folder; files that nobody registered are not read, missing ones are skipped."""
    rows = [r for r in site_rows() if exists(spark, f"{folder}/{r[5]}")]
    if not rows:
        return with_match_columns(spark.createDataFrame([], OFFER).select("*", F.lit(None).cast("string").alias("store"), F.lit(None).cast("int").alias("registry_pos"), F.lit(None).cast("long").alias("row_pos")))
    registry = spark.createDataFrame([(r[5], r[1], r[0]) for r in rows], "file string, store string, registry_pos int")
    raw = read_csv(spark, [f"{folder}/{r[5]}" for r in rows])
    return with_match_columns(raw.join(F.broadcast(registry), "file").drop("file"))  # the registry is a fixed table


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Raw offers of a merged document, or of a folder of lines, with store and place. An unreadable document gives none."""
    if is_folder(spark, path):
        return spark.read.schema(LINE).json(path).filter("row_pos is not null")
    text = spark.read.text(path, wholetext=True)
    stores = text.select(F.posexplode(F.map_entries(F.from_json("value", MERGED.simpleString()))).alias("registry_pos", "entry"))
    rows = stores.select("registry_pos", F.col("entry.key").alias("store"), F.posexplode("entry.value").alias("at", "offer"))
    return rows.select("offer.*", "store", "registry_pos", F.col("at").cast("long").alias("row_pos"))


def load_json(spark: SparkSession, path: str) -> DataFrame:
    """The merged document's stores; empty stores have no rows."""
    return with_match_columns(read_json(spark, path))


def load_catalogue(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet catalogue as updates have written it; None if there is none, or nothing in it."""
    if not exists(spark, path):
        return None
    rows = spark.read.schema(CATALOGUE).parquet(path)
    return None if rows.isEmpty() else rows


def load_offers(spark: SparkSession, folder: str, document: str = "products.json", catalogue: str | None = None) -> DataFrame:
    """The catalogue of the last updates if there is one; else the merged document if it is there, readable and not
    empty; else the CSV files; else no rows."""
    if catalogue and (rows := load_catalogue(spark, catalogue)) is not None:
        return rows
    path = f"{folder}/{document}"
    if exists(spark, path):
        try:
            merged = load_json(spark, path)
            if not merged.isEmpty():
                return merged
        except AnalysisException:
            pass
    return load_csv(spark, folder)


def write_csv(offers: DataFrame, folder: str, by_store: bool = True) -> None:
    """by_store: one CSV folder for each store that has offers, in order. Offers are dealt by store and place first: a task
    with a few rows of every store would write as many files, stores times tasks in all; a large store is cut by place.
    Else rows with the store as their last column, in as many files as the rows need, however many stores there are."""
    spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    if by_store:
        order = ["store", *(["row_pos"] if "row_pos" in offers.columns else OFFER.names)]
        dealt = offers.repartitionByRange(*order).sortWithinPartitions(*order)
        writer = dealt.select("store", *OFFER.names).write.partitionBy("store")
    else:
        writer = offers.select(*OFFER.names, "store").write.option("maxRecordsPerFile", ROWS_A_FILE)
    writer.mode("overwrite").options(header=True, escape='"', **spaces).csv(folder)


def merged_document(offers: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a target store: its offers as an array in order, empty if it has none."""
    ordered = F.array_sort(F.collect_list(F.struct("row_pos", *OFFER.names)))
    arrays = offers.groupBy("store").agg(F.transform(ordered, lambda o: F.struct(*[o[n].alias(n) for n in OFFER.names])).alias("offers"))
    return targets.select("store").join(arrays, "store", "left").select("store", F.coalesce("offers", F.array().cast(T.ArrayType(OFFER))).alias("offers"))


def write_json(offers: DataFrame, targets: DataFrame, path: str) -> None:
    """Offers of the target stores as lines, which read_json() reads back; stores without offers have a line of their own."""
    rows = offers.join(targets.select("store").distinct(), "store", "left_semi").select(*LINE.names)
    empty = targets.select("store").distinct().join(offers.select("store"), "store", "left_anti")
    rows.unionByName(empty, allowMissingColumns=True).write.mode("overwrite").json(path)


def write_document(offers: DataFrame, targets: DataFrame, path: str) -> None:
    """The merged document {store: [offers]} as one file, stores and offers in order. One file has one writer: rows
    stream to it in order, a partition at a time, and no store is held."""
    spark = offers.sparkSession
    order = targets.select("store", "registry_pos").dropDuplicates(["store"])
    rows = order.join(offers.select("store", "row_pos", F.to_json(F.struct(*OFFER.names), {"ignoreNullFields": "false"}).alias("offer")), "store", "left")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(hadoop, True)
    try:
        before = None
        for r in rows.orderBy("registry_pos", "store", "row_pos", "offer").toLocalIterator():
            opened = r["store"] != before
            head = ("{" if before is None else "], ") + json.dumps(r["store"], ensure_ascii=False) + ": [" if opened else ", "
            stream.write(bytearray((head + (r["offer"] or "")).encode()))
            before = r["store"]
        stream.write(bytearray(b"{}" if before is None else b"]}"))
    finally:
        stream.close()


def union_stores(parts: list[DataFrame]) -> DataFrame:
    """All stores by column name; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
