"""Helpers shared by the corpus operators: scratch tables, text splitting, row-wise Arrow maps.

Rules that hold for every operator of this subpackage:

* columns are picked by name, so extra columns never matter; a computed column replaces an input
  column of the same name;
* a null text is an empty text, repeated rows are processed row by row, an empty table gives an
  empty result of the same schema.
"""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that separates words: the ASCII characters \x20 and \x09-\x0D.
SPACE = " \t\n\x0b\x0c\r"
#: The letters that ASCII lower-casing changes.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows of a batch that goes back to the JVM.
ROWS_OUT = 1024
#: Where pack_row() puts a row's columns.
ROW = "__packed_row__"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder; by Spark's reader only, so any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, named by the session; only a session of one process may name none."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="vitrina-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends here,
    and a lost executor costs a re-read of files instead of a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys that may be split off a join as frequent: each has more than this share of the rows, so there are no more of them.
FREQUENT_KEYS = 1000


def join_unique(left: DataFrame, right: DataFrame, key: str, how: str = "inner", counted: DataFrame | None = None, grows: bool = False) -> DataFrame:
    """left with the columns of right, which has at most one row a key; how: inner or left. Null keys match none.

    A key with over 1/FREQUENT_KEYS of left's rows would be a task of its own size. There are fewer than FREQUENT_KEYS of them
    whatever the data, so their rows of right are broadcast; all other rows are joined by key. Both sides are
    read more than once and should be tables. counted: (key, n), the rows of each key, if they are known.
    grows: right grows with the data, so the other rows are joined by sorting at every size, never by a broadcast
    that only small inputs allow.
    """
    per_key = left.groupBy(key).agg(F.count("*").alias("n")) if counted is None else counted
    total, most = per_key.agg(F.sum("n"), F.max(F.when(F.col(key).isNotNull(), F.col("n")))).first()
    limit = max(1, (total or 0) / FREQUENT_KEYS)
    frequent = []
    if (most or 0) > limit:
        frequent = [r[0] for r in per_key.filter((F.col("n") > limit) & F.col(key).isNotNull()).select(key).collect()]  # under FREQUENT_KEYS
    rest = right.hint("merge") if grows else right
    if not frequent:
        return left.join(rest, key, how)
    names = left.sparkSession.createDataFrame([(k,) for k in frequent], right.select(key).schema)
    of_frequent = F.broadcast(names.join(right, key, how))  # under FREQUENT_KEYS rows
    often = left.join(of_frequent, key)
    seldom = left.join(F.broadcast(names), key, "left_anti").join(rest, key, how)
    return often.unionByName(seldom)


def give_back() -> None:
    """Return what this process has freed to the system. The C library else keeps the gaps between what is still in use,
    and they count against the driver's memory for the rest of its life."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass  # another C library than glibc


def settled(df: DataFrame) -> DataFrame:
    """df with every column computed once for each row. The optimizer inlines a column that is named once, even
    into a lambda, where it would be computed for each element; nothing is inlined through an explode."""
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("_")).select("_.*")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """Array of the words [^\\x20\\x09-\\x0D]+ of a text; null and blank texts have none."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, "[\\x20\\x09-\\x0D]+"))


def map_rows(df: DataFrame, added: T.StructType, make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]]) -> DataFrame:
    """df with computed columns, by Arrow batches and without a shuffle.

    make() runs once in each task and gives a function from a record batch to the arrays of the
    added columns, in the order of their schema.
    """
    dropped = {f.name for f in added.fields}
    kept = [f for f in df.schema.fields if f.name not in dropped]
    out = T.StructType(kept + added.fields)
    names = [f.name for f in out.fields]
    keep_names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_OUT):
                batch = whole.slice(at, ROWS_OUT)
                yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(n)) for n in keep_names], *work(batch)], names)
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, out)


def pack_row(df: DataFrame, *named: str) -> DataFrame:
    """The columns `named`, and all others of df in one struct: no column that an operator adds can clash with them."""
    row = F.struct(F.lit(0).alias("_"), *[quoted(c).alias(f"c{i}") for i, c in enumerate(df.columns) if c not in named])
    return df.select(row.alias(ROW), *map(quoted, named))


def quoted(name: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def unpack_row(df: DataFrame, columns: list[str], *named: str) -> DataFrame:
    """What pack_row() packed, in the old order: `columns` are the names of the packed table."""
    return df.select(*[quoted(c) if c in named else F.col(f"{ROW}.c{i}").alias(c) for i, c in enumerate(columns)])


def texts_of(batch: pa.RecordBatch, column: str) -> Iterator[str]:
    """The texts of a batch, one at a time; null is empty."""
    array = batch.column(batch.schema.get_field_index(column))
    for i in range(len(array)):
        yield array[i].as_py() or ""


def bytes_of(batch: pa.RecordBatch, column: str) -> Iterator[bytes]:
    """The UTF-8 bytes of a batch's texts, one at a time; null is empty."""
    array = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
    for i in range(len(array)):
        yield array[i].as_py() or b""
