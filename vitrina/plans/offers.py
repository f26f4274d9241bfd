"""The offers view over the star-schema tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrina.functions.titles import NOISE_PHRASES, NOISE_WORDS
from vitrina.operators.catalog import with_match_columns

#: What shops append to titles, by part number.
SUFFIXES = ["", " - Juego de Mesa", " (En Español)", " 2ª Edición", " | Board Game", " Juego de Mesa, Cooperativo"]


def raw_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order line as an offer of its supplier's shop. Dimension sides are planned by their size."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name")
    joined = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    price = lambda c: F.concat(F.lit("$"), F.replace(F.format_number(F.floor(c), 0), F.lit(","), F.lit(".")))
    suffix = F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.col("p_partkey") % len(SUFFIXES) + 1).cast("int"))
    path = F.concat(F.lit("/p/"), F.col("l_partkey").cast("string"))
    place = F.concat(*[F.lpad(F.col(c).cast("string"), 12, "0") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    return joined.select(
        F.concat("p_name", suffix).alias("title"),
        price(F.col("l_extendedprice")).alias("original_price"),
        F.when(F.col("l_discount") > 0, price(F.col("l_extendedprice") * (1 - F.col("l_discount")))).alias("current_price"),
        F.when(F.col("l_returnflag") == "R", "Agotado").when((F.col("l_returnflag") == "A") & (F.col("l_discount") > 0), "Oferta").alias("stock_status"),
        F.when(F.col("l_linestatus") == "O", path).otherwise(F.concat(F.lit("https://shop.example"), path)).alias("url"),
        F.col("s_name").alias("store"),
        F.col("s_suppkey").cast("int").alias("registry_pos"),
        place.alias("row_pos"),
    )


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_match_columns(raw_offers(spark, sf_dir))


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_name").alias("store"), F.col("s_suppkey").cast("int").alias("registry_pos"))


def sql_clean(title: str) -> str:
    """The cleaning rule for an engine without look-behind: the character before is captured and put back."""
    step = rf"regexp_replace({title}, '(^|[\-\|,;:\s])[\-\|,;:\s]*(?:{NOISE_PHRASES})\s*[\-\|,;:]?', '\1 ', 'gi')"
    step = rf"regexp_replace({step}, '([A-Za-záéíóúüñÁÉÍÓÚÜÑ])(?:{NOISE_PHRASES})(?:\s*[\-\|,;:].*)?$', '\1', 'gi')"
    step = rf"regexp_replace({step}, '[\-\|,;:\s]+(?:{NOISE_WORDS})($|[\-\|,;:\s])', '\1', 'gi')"
    return rf"trim(regexp_replace({step}, '\s{{2,}}', ' ', 'g'), ' -|,:;')"


def sql_norm(title: str) -> str:
    step = rf"regexp_replace(lower(coalesce({title}, '')), '[\(\[]?\b(en\s+)?(espa[nñ]ol|ingl[eé]s|english|castellano)\b[\)\]]?', ' ', 'g')"
    step = rf"regexp_replace({step}, '\b\d+[aª]?\s*(edici[oó]n|edition)\b|\b(edici[oó]n|edition)\b', ' ', 'g')"
    return rf"trim(regexp_replace(regexp_replace(strip_accents({step}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def sql_price(text: str) -> str:
    run = rf"regexp_extract({text}, '[\d.,]+')"
    plain = (
        f"CASE WHEN contains({run}, '.') AND contains({run}, ',') THEN "
        rf"CASE WHEN regexp_matches({run}, ',[^.]*$') THEN replace(replace({run}, '.', ''), ',', '.') ELSE replace({run}, ',', '') END "
        rf"WHEN regexp_matches({run}, '[.,]') AND length(regexp_extract({run}, '[.,](\d*)$', 1)) = 3 THEN regexp_replace({run}, '[.,]', '', 'g') "
        f"ELSE replace({run}, ',', '.') END"
    )
    return rf"try_cast(nullif({plain}, '') AS DOUBLE)"


def sql_pct(original: str, current: str) -> str:
    return f"CASE WHEN {original} > 0 AND {current} > 0 AND {current} < {original} THEN round_even((1 - {current} / {original}) * 100, 1) END"


def _sql_money(value: str) -> str:
    return f"'$' || replace(format('{{:,}}', floor({value})::BIGINT), ',', '.')"


RAW = f"""
raw AS (
  SELECT p_name || [{", ".join(f"'{s}'" for s in SUFFIXES)}][p_partkey % {len(SUFFIXES)} + 1] AS raw_title,
    {_sql_money("l_extendedprice")} AS original_price,
    CASE WHEN l_discount > 0 THEN {_sql_money("l_extendedprice * (1 - l_discount)")} END AS current_price,
    CASE WHEN l_returnflag = 'R' THEN 'Agotado' WHEN l_returnflag = 'A' AND l_discount > 0 THEN 'Oferta' END AS stock_status,
    CASE WHEN l_linestatus = 'O' THEN '/p/' ELSE 'https://shop.example/p/' END || l_partkey AS url,
    s_name AS store, s_suppkey::INT AS registry_pos,
    lpad(l_orderkey::VARCHAR, 12, '0') || lpad(l_linenumber::VARCHAR, 12, '0') || lpad(l_partkey::VARCHAR, 12, '0') || lpad(l_suppkey::VARCHAR, 12, '0') AS row_pos
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""
#: CTEs up to the offers view, with numbers beside the texts. Titles are cleaned once for each different one.
RAW_SQL = f"WITH {RAW}"
OFFERS_SQL = f"""WITH {RAW},
t AS (SELECT raw_title, title, {sql_norm("title")} AS norm FROM (SELECT raw_title, {sql_clean("raw_title")} AS title FROM (SELECT DISTINCT raw_title FROM raw))),
offers AS (
  SELECT t.title, t.norm, original_price, current_price, stock_status, url, store, registry_pos, row_pos,
    {sql_price("original_price")} AS o, {sql_price("current_price")} AS c
  FROM raw JOIN t USING (raw_title)),
priced AS (SELECT *, {sql_pct("o", "c")} AS pct FROM offers),
shown AS (SELECT *, coalesce('-' || round_even(pct, 0)::BIGINT || '%', '-') AS descuento FROM priced)"""
