"""Schemas of offers, pages and sites."""

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


#: An offer as a shop shows it; prices are display texts. Never infer this schema: empty columns would become numbers.
OFFER = _strings("title", "original_price", "current_price", "stock_status", "url")
#: A captured page; html is null where the fetch failed.
PAGE = T.StructType([T.StructField("store", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])
#: The merged document: store -> its offers.
MERGED = T.MapType(T.StringType(), T.ArrayType(OFFER))
#: An offer of the merged document as a line of its own.
LINE = T.StructType([*OFFER.fields, T.StructField("store", T.StringType()), T.StructField("registry_pos", T.IntegerType()), T.StructField("row_pos", T.LongType())])
#: The catalogue that updates write.
CATALOGUE = T.StructType([*LINE.fields, T.StructField("norm", T.StringType())])
SOLD_OUT, ON_OFFER, AVAILABLE = "Agotado", "Oferta", "Disponible"
