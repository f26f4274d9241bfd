"""Quality rules whose cutoffs carry a guarantee, with DataFrame functions only.

Base: counts of every whole text, and a fixed base rule. Method: rules are ratios that are large in bad texts, each with cutoffs
from lax to strict. PATH, fixed beforehand, tightens one rule by one cutoff a step, from no rule at all to all
rules at their strictest. In each stratum (language) the steps are tested in this order on the labelled holdout: "the
rules so far reject together more than alpha of the good documents" must be refuted by the exact binomial tail. Testing
stops at the first step that is not refuted, and the one before it is taken. A fixed sequence needs no correction among its
steps; the strata share the error delta in proportion to their good documents (weighted Bonferroni). So, with
probability 1 - delta, in no stratum are more than alpha of the good documents rejected by the rules together. A stratum with
too few labelled documents takes no step and rejects nothing.

Arrays of a single text are the largest things held; labels and features meet as narrow rows, and the
cutoffs are one row for each stratum. A stratum with very many documents is split off the join.

Defined results: null and empty texts have zero counts and fail the base rule; a null stratum is a
stratum of its own, ""; repeated rows are judged one by one (a repeated id counts once in the holdout by its
least features, a repeated label by its least quality); without labels only the base rule rejects; columns beside
those named never matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina.llm.common import join_unique, quoted, scratch, words

#: Rule, its ratio as SQL over the counts, its cutoffs from lax to strict (a text is rejected above the cutoff).
RULES: list[tuple[str, str, list[float]]] = [
    ("symbols", "n_symbols / greatest(word_chars, 1)", [0.4, 0.2, 0.1, 0.05, 0.02, 0.01]),
    ("long_words", "word_chars / greatest(n_words, 1)", [20.0, 15.0, 12.0, 10.0, 9.0, 8.0]),
    ("short_words", "-(word_chars / greatest(n_words, 1))", [-2.0, -2.5, -3.0, -3.5, -4.0]),
    ("repeats", "n_repeat_words / greatest(n_words, 1)", [0.4, 0.3, 0.2, 0.1, 0.05, 0.02]),
    ("dup_lines", "n_dup_lines / greatest(n_lines, 1)", [0.7, 0.5, 0.3, 0.2, 0.1, 0.05]),
]
#: The steps: each rule in turn goes to its next cutoff.
PATH: list[tuple[str, float]] = [(name, cuts[j]) for j in range(6) for name, _, cuts in RULES if j < len(cuts)]
ALPHA, DELTA = 0.02, 0.05
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def _at(array: str, i: Column) -> Column:
    return F.get(F.col(array), i)


def text_counts(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs without the text, with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long)."""
    made = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    rest = [c for c in docs.columns if c != text_col and c not in made]
    row = F.struct(F.lit(0).alias("_"), *[quoted(c).alias(f"c{i}") for i, c in enumerate(rest)]).alias("row")
    text = F.coalesce(quoted(text_col), F.lit(""))
    split = docs.select(
        row,
        words(text).alias("w"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("l"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).alias("n_symbols"),
    )
    n = F.size("w")
    window = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(_at("w", i), _at("w", i + 1), _at("w", i + 2)))
    none = F.array().cast("array<bigint>")
    counted = split.select(
        "row",
        "w",
        n.alias("n_words"),
        F.length(F.array_join("w", "")).alias("word_chars"),
        "n_symbols",
        F.size("l").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).alias("n_dup_lines"),
        F.when(n >= 3, window).otherwise(none).alias("h"),
    )
    # only texts with some repeated hash are sorted; there windows are compared by their words, hashes only come first
    repeated = counted.withColumn("h", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.col("h")).otherwise(none))
    place = lambda h, i: F.struct(h.alias("h"), _at("w", i).alias("a"), _at("w", i + 1).alias("b"), _at("w", i + 2).alias("c"), i.alias("i"))
    paired = repeated.withColumn("s", F.sort_array(F.transform("h", place)))
    equal = lambda x, y: F.coalesce((x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
    placed = paired.withColumn("p", F.sort_array(F.transform(F.filter("s", lambda x, i: equal(x, _at("s", i - 1)) | equal(x, _at("s", i + 1))), lambda x: x["i"])))
    covered = F.transform("p", lambda p, i: F.least(F.lit(3), F.coalesce(_at("p", i + 1) - p, F.lit(3))))
    counts = placed.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0), lambda a, b: a + b))
    return counts.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(rest)], *[F.col(c).cast("long").alias(c) for c in made])


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial(n, p), terms in logs from X = 0 on; 1 where k is at least n * p, for
    there the tail is large and no test passes."""
    odds = math.log(p / (1 - p))
    start = F.struct((n * math.log1p(-p)).alias("t"), F.exp(n * math.log1p(-p)).alias("s"))

    def step(a: Column, i: Column) -> Column:
        t = a["t"] + F.log((n - i + 1) / i) + F.lit(odds)
        return F.struct(t.alias("t"), (a["s"] + F.exp(t)).alias("s"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k < n * p, F.aggregate(steps, start, step, lambda a: a["s"])).otherwise(F.lit(1.0))


def select_cutoffs(features: DataFrame, labels: DataFrame, *, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, steps (of PATH that are taken) and a column cut_<rule> for each rule (null: none); one row for each stratum with labels.
    features should be a table: its columns are named very often."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1").select("doc_id")
    ratios = [F.expr(sql).cast("double").alias(name) for name, sql, _ in RULES]
    held = features.filter("doc_id is not null").filter(~base_failed()).select("doc_id", "stratum", *ratios).groupBy("doc_id", "stratum").agg(*[F.min(name).alias(name) for name, _, _ in RULES])
    # the step that rejects a document first
    step = F.least(*[F.when(F.col(name) > cut, F.lit(j)) for j, (name, cut) in enumerate(PATH)])
    sums = held.join(good, "doc_id").select("stratum", step.alias("step")).groupBy("stratum").agg(F.count("*").alias("n"), F.array(*[F.count_if(F.col("step") <= j) for j in range(len(PATH))]).alias("k"))
    sums = scratch(sums, "quality-strata")  # a row for each stratum
    total = sums.agg(F.sum("n")).first()[0] or 0
    each = sums.select("stratum", "n", F.posexplode("k").alias("j", "k"))
    refuted = binomial_tail(F.col("k"), F.col("n"), alpha) <= delta * F.col("n") / float(max(1, total))
    taken = each.groupBy("stratum").agg(F.coalesce(F.min(F.when(~refuted, F.col("j"))), F.lit(len(PATH))).alias("steps"))
    reached = {name: [max((c for s, c in PATH[:m] if s == name), key=[c for s, c in PATH if s == name].index, default=None) for m in range(len(PATH) + 1)] for name, _, _ in RULES}
    return taken.select("stratum", "steps", *[F.get(F.array(*[F.lit(c).cast("double") for c in reached[name]]), F.col("steps")).alias(f"cut_{name}") for name, _, _ in RULES])


def judge(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", stratum_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, stratum, counts, base_failed, rejected_by array<string>, kept; one row for each row of docs."""
    narrow = docs.select("doc_id", F.coalesce(quoted(stratum_col).cast("string"), F.lit("")).alias("stratum"), quoted(text_col).alias("text"))
    features = scratch(text_counts(narrow), "quality")
    cuts = scratch(select_cutoffs(features, labels.select("doc_id", "quality"), alpha=alpha, delta=delta), "quality-cutoffs")
    joined = join_unique(features, cuts, "stratum", "left")
    broken = [F.when(F.expr(sql).cast("double") > F.col(f"cut_{name}"), F.lit(name)) for name, sql, _ in RULES]
    told = joined.withColumn("rejected_by", F.array_compact(F.array(*broken))).withColumn("base_failed", base_failed())
    return told.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop("steps", *[f"cut_{name}" for name, _, _ in RULES])


def contract(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What op1 returns."""
    return judge(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle_sql(alpha: float = ALPHA, delta: float = DELTA) -> str:
    """The same in DuckDB; the tail by gamma functions."""
    ratio = ", ".join(f"({sql})::DOUBLE AS {name}" for name, sql, _ in RULES)
    step = "least(" + ", ".join(f"CASE WHEN {name} > {cut!r} THEN {j} ELSE {len(PATH)} END" for j, (name, cut) in enumerate(PATH)) + ")"
    counts = " UNION ALL ".join(f"SELECT stratum, {j} AS j, count(*) AS n, count(*) FILTER (step <= {j}) AS k FROM held GROUP BY 1" for j in range(len(PATH)))
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (SELECT doc_id, k, w[k:k+2] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM d)),
rep AS (SELECT doc_id, k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + 3)) AS p FROM rep) GROUP BY 1),
f AS (
  SELECT doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN cov USING (doc_id)),
r AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, {ratio} FROM f),
s AS (SELECT *, {step} AS step FROM r),
held AS (SELECT * FROM s WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1)),
tests AS ({counts}),
tails AS (
  SELECT *, {delta!r} * n / (SELECT count(*) FROM held) AS level,
    CASE WHEN k < n * {alpha!r} THEN list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({alpha!r}) + (n - i) * ln(1 - {alpha!r})))) ELSE 1 END AS tail
  FROM tests),
taken AS (SELECT stratum, coalesce(min(j) FILTER (tail > level), {len(PATH)}) AS steps FROM tails GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND step >= coalesce(steps, 0) AS kept
FROM s LEFT JOIN taken USING (stratum)
"""
