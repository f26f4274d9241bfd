"""The catalogue: keep-first deduplication, search, price tables, deals, lists, summaries, merging.

Order never depends on partitions: registry_pos (the store's place) and row_pos (the offer's place in
its store) order rows, and every sort ends in a total tie-break.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrina.functions.prices import add_prices, filter_price, nonzero, show_pct
from vitrina.functions.similarity import add_token_set_ratio
from vitrina.functions.titles import clean_title, normalize_text, normalize_title_exact
from vitrina.schema import AVAILABLE, SOLD_OUT

SORTS = ("discount", "price", "offer", "original", "store")
LIST_SORTS = ("discount", "price", "offer")
CUTOFF = 80.0
#: Rows of a query set that are broadcast at a time.
QUERY_BLOCK = 10_000


def with_match_columns(offers: DataFrame) -> DataFrame:
    """Cleaned titles and the match key; done once, at load, and once for each different title: the patterns
    run over distinct titles, which are joined back."""
    raw = offers.withColumnRenamed("title", "_raw").drop("norm")
    each = raw.select(F.col("_raw").alias("_of")).distinct().withColumn("title", clean_title(F.col("_of")))
    each = each.withColumn("norm", normalize_title_exact(F.col("title")))
    columns = ["title" if c == "title" else c for c in offers.columns if c != "norm"]
    return raw.join(each, F.col("_raw").eqNullSafe(F.col("_of"))).select(*columns, "norm")


# -- keep-first ---------------------------------------------------------------------------------


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; rows of one place are told apart by their other columns. Aggregates on
    the map side, so a key with very many rows sends one row a task."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    first = F.min(F.struct(*order, *rest)).alias("_first")
    return rows.groupBy(*keys).agg(first).select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in rows.columns])


# -- sorting ------------------------------------------------------------------------------------


def sort_keys(by: str) -> list[Column]:
    """Orders over offers with prices (add_prices); missing and zero prices go last, equal ones keep the load order."""
    keys = {
        "discount": F.coalesce("_pct", F.lit(-1.0)).desc(),
        "price": F.coalesce(nonzero(F.col("_c")), nonzero(F.col("_o"))).desc_nulls_last(),
        "offer": nonzero(F.col("_c")).desc_nulls_last(),
        "original": nonzero(F.col("_o")).asc_nulls_last(),
        "store": F.col("store").asc(),
    }
    if by not in keys:
        raise ValueError(f"unknown sort {by!r}; one of {', '.join(SORTS)}")
    return [keys[by], F.col("registry_pos").asc_nulls_last(), F.col("row_pos").asc_nulls_last()]


def sort_offers(offers: DataFrame, by: str = "discount") -> DataFrame:
    """offers with prices, in order."""
    return add_prices(offers).orderBy(*sort_keys(by))


# -- search -------------------------------------------------------------------------------------


def titles_by_norm(offers: DataFrame) -> DataFrame:
    """norm, the title that stands for it (the first in load order), and that place."""
    firsts = offers.groupBy("norm").agg(F.min(F.struct("registry_pos", "row_pos", "title")).alias("f"))
    return firsts.select("norm", F.col("f.title").alias("title"), F.col("f.registry_pos").alias("registry_pos"), F.col("f.row_pos").alias("row_pos"))


def search(offers: DataFrame, query: str, cutoff: float = CUTOFF) -> DataFrame:
    """title, score of every product at least `cutoff` similar, best first; no limit."""
    wanted = normalize_text(query)
    scored = add_token_set_ratio(titles_by_norm(offers).withColumn("_wanted", F.lit(wanted)), "_wanted", "norm", "score", cutoff)
    return _at_least(scored, cutoff).orderBy(F.desc("score"), "registry_pos", "row_pos", "norm").select("title", "score")


def search_many(offers: DataFrame, queries: DataFrame, cutoff: float = CUTOFF, block: int = QUERY_BLOCK) -> DataFrame:
    """query, title, norm, score for a table of queries (query).

    A score of 80 needs a common word, or two words that begin alike or are in reach of each other
    by length; since no index covers the latter, distinct products are scored against all queries,
    the stated query set being broadcast in blocks of about `block` rows, whatever its size.
    """
    wanted = queries.select("query").distinct().withColumn("wanted", normalize_title_exact(F.col("query"))).filter("wanted <> ''")
    products = titles_by_norm(offers)
    parts = [add_token_set_ratio(products.crossJoin(F.broadcast(some)), "wanted", "norm", "score", cutoff) for some in in_blocks(wanted, "query", block)]
    return _at_least(reduce(DataFrame.unionByName, parts), cutoff).select("query", "title", "norm", "score")


def in_blocks(rows: DataFrame, key: str, block: int) -> list[DataFrame]:
    """rows dealt by a hash of the key into parts of about `block` rows, each fit to be broadcast."""
    n = max(1, -(-rows.count() // block))
    return [rows] if n == 1 else [rows.filter(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def _at_least(scored: DataFrame, cutoff: float) -> DataFrame:
    """Rows that reach the cutoff. The row number keeps the filter above the steps of the score; pushed
    below, it would hold the whole score once more at every step."""
    return scored.withColumn("_row", F.monotonically_increasing_id()).filter((F.col("score") >= cutoff) & (F.col("_row") >= 0)).drop("_row")


# -- presentation -------------------------------------------------------------------------------

LABELS = {
    "store": "Tienda",
    "title": "Producto",
    "original_price": "Precio",
    "current_price": "Oferta",
    "descuento": "Descuento",
    "stock_status": "Disponibilidad",
    "url": "URL",
}


def with_discount(offers: DataFrame) -> DataFrame:
    """Offers with prices, with their discount as it is shown."""
    return offers.withColumn("descuento", show_pct(F.col("_pct")))


def shown_url(url: Column) -> Column:
    return F.when(url.startswith("http"), url).otherwise(F.lit("N/A"))


def present(offers: DataFrame, columns: list[str]) -> DataFrame:
    """The wanted columns that are there, under their headings."""
    return offers.select(*[F.col(c).alias(LABELS.get(c, c)) for c in columns if c in offers.columns])


def modal_title(offers: DataFrame, norm: str) -> DataFrame:
    """The most frequent title of a product, the least among equals."""
    return offers.filter(F.col("norm") == norm).agg(F.mode("title", True).alias("title"))


def price_table(offers: DataFrame, norm: str, sort: str = "discount") -> DataFrame:
    """All offers of one product."""
    own = sort_offers(offers.filter(F.col("norm") == norm), sort)
    filled = with_discount(own).withColumns({"url": shown_url(F.col("url")), "stock_status": F.coalesce("stock_status", F.lit(AVAILABLE)), "current_price": F.coalesce("current_price", F.lit("-"))})
    return present(filled, ["store", "original_price", "current_price", "descuento", "stock_status", "url"])


def in_stock(status: Column) -> Column:
    return F.lower(F.coalesce(status, F.lit(""))) != SOLD_OUT.lower()


def price_bound(text: str | None) -> float | None:
    """A bound as typed: separators dropped; junk is an error."""
    return None if text is None else float(str(text).replace(".", "").replace(",", ""))


def price_bounds(lower: str | None, higher: str | None, price: str | None) -> tuple[float | None, float | None]:
    """A range a:b goes before the single bounds; one of other than two parts bounds nothing."""
    if price:
        parts = str(price).split(":")
        return (price_bound(parts[0]), price_bound(parts[1])) if len(parts) == 2 else (None, None)
    return price_bound(lower), price_bound(higher)


def _checked(sort: str) -> str:
    if sort not in SORTS:
        raise ValueError(f"unknown sort {sort!r}")
    return sort


def select_deals(offers: DataFrame, *, store: str | None = None, in_stock_only: bool = False, lower: str | None = None, higher: str | None = None, price: str | None = None) -> DataFrame:
    """Rows with an offer price that pass the filters, with that price as a number (_price)."""
    rows = offers.filter(F.col("current_price").isNotNull())
    if store:
        rows = rows.filter(F.col("store") == store)
    if in_stock_only:
        rows = rows.filter(in_stock(F.col("stock_status")))
    rows = rows.withColumn("_price", filter_price(F.col("current_price")))
    least, most = price_bounds(lower, higher, price)
    if least is not None:
        rows = rows.filter(F.col("_price") >= least)
    if most is not None:
        rows = rows.filter(F.col("_price") <= most)
    return rows


def deals(offers: DataFrame, *, store: str | None = None, in_stock_only: bool = False, lower: str | None = None, higher: str | None = None, price: str | None = None, sort: str = "discount") -> DataFrame:
    rows = select_deals(offers, store=store, in_stock_only=in_stock_only, lower=lower, higher=higher, price=price)
    filled = with_discount(sort_offers(rows, _checked(sort))).withColumn("stock_status", F.coalesce("stock_status", F.lit(AVAILABLE)))
    return present(filled, ["store", "title", "original_price", "current_price", "descuento", "stock_status", "url"])


def list_offers(offers: DataFrame, *, store: str | None = None, sort: str = "store", in_stock_only: bool = False) -> DataFrame:
    rows = offers
    if store:
        rows = rows.filter(F.col("store") == store)
    if in_stock_only:
        rows = rows.filter(in_stock(F.col("stock_status")))
    filled = with_discount(sort_offers(rows, _checked(sort))).withColumn("stock_status", F.coalesce("stock_status", F.lit(AVAILABLE)))
    return present(filled, ["store", "title", "original_price", "current_price", "descuento", "stock_status", "url"])


# -- summaries and merging ----------------------------------------------------------------------


def update_summary(offers: DataFrame, stores: DataFrame) -> DataFrame:
    """site, total, on_sale, agotado of every store of `stores` (store, registry_pos); zeros for empty ones."""
    counts = offers.groupBy("store").agg(F.count("*").alias("total"), F.count("current_price").alias("on_sale"), F.count_if(F.col("stock_status") == SOLD_OUT).alias("agotado"))
    joined = stores.select("store", "registry_pos").join(counts, "store", "left").orderBy("registry_pos")
    return joined.select(F.col("store").alias("site"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "on_sale", "agotado")])


def column_widths(table: DataFrame) -> DataFrame:
    """The longest content of each column, as one row."""
    return table.agg(*[F.coalesce(F.max(F.length(F.col(f"`{c}`").cast("string"))), F.lit(0)).alias(c) for c in table.columns])


def unknown_stores(wanted: DataFrame, stores: DataFrame) -> DataFrame:
    """Names that were asked for and nobody registered."""
    return wanted.select("store").distinct().join(stores.select("store"), "store", "left_anti")


def merge_stores(current: DataFrame, fresh: DataFrame, targets: DataFrame) -> DataFrame:
    """The catalogue after an update: target stores are replaced as a whole (those without fresh
    offers become empty), all others stay, fresh offers of stores that are no target are ignored."""
    names = targets.select("store").distinct()
    kept = current.join(names, "store", "left_anti")
    return kept.unionByName(fresh.join(names, "store", "left_semi"), allowMissingColumns=True)


def merge_into(path: str, fresh: DataFrame, targets: DataFrame) -> None:
    """merge_stores() on a Parquet catalogue partitioned by store. Only the targets' partitions are
    written; those that became empty are deleted by name."""
    spark = fresh.sparkSession
    wanted = targets.select("store").distinct()
    rows = fresh.join(wanted, "store", "left_semi")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("store").parquet(path)
    emptied = wanted.join(rows.select("store").distinct(), "store", "left_anti").collect()  # names out of the registry
    jvm = spark.sparkContext._jvm
    for r in emptied:
        name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(r["store"])
        gone = jvm.org.apache.hadoop.fs.Path(f"{path}/store={name}")
        gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)


def ranked(offers: DataFrame, by: str, partition: str = "store") -> DataFrame:
    """offers with rank, their place in their store under a sort key."""
    return add_prices(offers).withColumn("rank", F.row_number().over(Window.partitionBy(partition).orderBy(*sort_keys(by))))
