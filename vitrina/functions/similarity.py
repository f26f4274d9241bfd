"""Token-set similarity, 0 to 100, by JVM expressions.

With A, B the word sets, I = A & B, X = A - B, Y = B - A (each sorted and joined, of s, x, y
characters), the score is the best of the indel ratios of (I X, I Y), (I, I X), (I, I Y); 100 if one set
holds the other; 0 if either is empty. The only costly part is the longest common subsequence of X
and Y. It runs bit-parallel in one long for up to 62 characters of the shorter side and over an array
of counts beyond, and only where the cutoff is still in reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_BITS = 62


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, r"\s+"), lambda t: t != ""))


def _chars(text: Column) -> Column:
    return F.split(text, "")


def _lcs_bits(a: Column, b: Column) -> Column:
    """b has 1 to WORD_BITS characters. A bit of the state is 0 where a prefix gains a match."""
    ones = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(b)) - 1
    places = F.sequence(F.lit(0), F.length(b) - 1)

    def step(v: Column, c: Column) -> Column:
        same = F.aggregate(places, F.lit(0).cast("long"), lambda m, i: F.when(F.substr(b, i + 1, F.lit(1)) == c, m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))).otherwise(m))
        hit = v.bitwiseAND(same)
        return (v + hit).bitwiseOR(v - hit).bitwiseAND(ones)

    return F.length(b) - F.bit_count(F.aggregate(_chars(a), ones, step))


def _lcs_rows(a: Column, b: Column) -> Column:
    """Any lengths: one row of the table of counts at a time."""
    zero = F.transform(F.sequence(F.lit(0), F.length(b)), lambda _: F.lit(0))

    def row(above: Column, c: Column) -> Column:
        def cell(left: Column, j: Column) -> Column:
            up, corner, before = F.get(above, j), F.get(above, j - 1), F.get(left, j - 1)
            return F.array_append(left, F.when(F.substr(b, j, F.lit(1)) == c, corner + 1).otherwise(F.greatest(up, before)))

        return F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(F.lit(0)), cell)

    return F.element_at(F.aggregate(_chars(a), zero, row), -1)


def _lcs_of(longer: str, shorter: str) -> Column:
    a, b = F.col(longer), F.col(shorter)
    return F.when(F.length(b) == 0, 0).when(F.length(b) <= WORD_BITS, _lcs_bits(a, b)).when(F.length(b) > WORD_BITS, _lcs_rows(a, b))


def add_lcs(rows: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """rows with the characters of the longest common subsequence of two columns; null if either is null."""
    first = F.length(a) >= F.length(b)
    sides = rows.withColumns({"_long": F.when(first, F.col(a)).otherwise(F.col(b)), "_short": F.when(first, F.col(b)).otherwise(F.col(a))})
    return sides.withColumn(name, _lcs_of("_long", "_short")).drop("_long", "_short")


def add_token_set_ratio(rows: DataFrame, a: str, b: str, name: str, cutoff: float = 0.0) -> DataFrame:
    """rows with the similarity of the normalised texts in columns a and b; null where it is surely
    below the cutoff. Each step is a column of its own, so nothing is computed twice."""
    joined = lambda t: F.array_join(F.sort_array(t), " ")
    sets = rows.withColumns({"_ta": tokens(F.col(a)), "_tb": tokens(F.col(b))})
    texts = sets.withColumns({"_both": joined(F.array_intersect("_ta", "_tb")), "_xa": joined(F.array_except("_ta", "_tb")), "_xb": joined(F.array_except("_tb", "_ta")), "_empty": (F.size("_ta") == 0) | (F.size("_tb") == 0)})
    sizes = texts.withColumns({"_s": F.length("_both"), "_x": F.length("_xa"), "_y": F.length("_xb"), "_g": F.when(F.length("_both") > 0, 1).otherwise(0)})
    s, x, y, g = (F.col(c) for c in ("_s", "_x", "_y", "_g"))
    ratio = lambda d, n: 100.0 - F.lit(100.0) * d / n
    bounds = sizes.withColumns({"_whole": 2 * (s + g) + x + y, "_inside": F.when(s > 0, F.greatest(ratio(g + x, 2 * s + g + x), ratio(g + y, 2 * s + g + y))).otherwise(0.0), "_same": (s > 0) & ((x == 0) | (y == 0))})
    reach = F.greatest(ratio(F.abs(x - y), F.col("_whole")), F.col("_inside")) >= cutoff
    a_first = x >= y
    needed = ~F.col("_empty") & ~F.col("_same") & reach
    sides = bounds.withColumns({"_long": F.when(needed, F.when(a_first, F.col("_xa")).otherwise(F.col("_xb"))), "_short": F.when(needed, F.when(a_first, F.col("_xb")).otherwise(F.col("_xa")))})
    common = sides.withColumn("_common", _lcs_of("_long", "_short"))
    score = F.when(F.col("_empty"), 0.0).when(F.col("_same"), 100.0).when(F.col("_common").isNotNull(), F.greatest(ratio(x + y - 2 * F.col("_common"), F.col("_whole")), F.col("_inside")))
    return common.withColumn(name, score).drop("_ta", "_tb", "_both", "_xa", "_xb", "_empty", "_s", "_x", "_y", "_g", "_whole", "_inside", "_same", "_long", "_short", "_common")
