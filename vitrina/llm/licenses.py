"""Licence scan: TF-IDF cosine to templates, then inheritance from the nearest ancestor folder, with DataFrame functions only.

Passages of a file are its whole text, its blocks (lines up to one without letters and digits), its runs of comment lines, its
lines and the sentences of its lines. A passage's words are runs of letters and digits joined by dots and hyphens, so that "2-clause", "by-nc", "2.1" and
"agpl-3.0-only" are words of their own, and two versions of a licence differ by a word. A passage is compared with every
template by sparse TF-IDF cosine, weights (1 + log tf) * idf. A file's own licence is its best passage's from the threshold on.

No passage is left out that could reach the threshold. If the words outside of a set A hold less than the threshold of
every template's length, no passage without a word of A has such a cosine (Cauchy-Schwarz); anchors() takes common words of prose
out of A as long as that holds. And no cosine is above the share of a passage's length that words of templates can have at
most, given how many different words it has of each kind. Passages that fail either test, most of any text, are dropped
before anything is exploded.

A file whose best passage is at least half of its words, or whose name says so, is a licence file and speaks for its folder;
a file without a licence of its own takes that of the nearest ancestor folder that has one, found by joins of the distinct folders'
ancestors with the licensed folders. Frequent keys (a folder of very many files, the root above all folders) are split off.

Defined results: null and empty texts have no passage and may inherit; equal scores go to the lesser licence name; of several
licence files of a folder the best score counts, then the lesser name; a null path is the root; repeated rows are judged one by
one; columns beside doc_id, text and path never matter; an empty table gives none.
"""

from __future__ import annotations

import math
import re
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina.llm.common import ascii_lower, join_unique, quoted, scratch
from vitrina.llm.license_texts import templates

LICENSE_FILE = r"(?i)(?:^|/)(?:un)?(?:licen[sc]e|copying|notice)[^/]*$"
THRESHOLD, FILE_SHARE = 0.6, 0.5
TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*\+?"
#: A line without letters and digits parts blocks; the end of a sentence.
BLANK = r"\n(?:[^\p{L}\p{N}\n]*\n)+"
SENTENCE = r"([.!?;:])[ \t]+"
#: Lines that begin like a comment, one after the other.
COMMENTS = r"(?m)(?:^[ \t]*(?:#|//|/?\*|--|;|%|!|<!--)[^\n]*\n?)+"
#: Words of ordinary prose, roughly by how common they are: these are the first to be no anchors.
PROSE = (
    "the of and to a in is that it for as with on by at from or an be this are was not have has had which can will would their its all any may no "
    "if but you your our we they he she one two other use used out under over into such each more most see first work works file files form forms part "
    "provided including without following above only also and/or than these those his her do does so up about when where who what there"
).split()


@cache
def template_weights() -> tuple[list[tuple[str, int, str, float]], dict[str, float], float]:
    """(licence, template, word, weight of unit vectors), inverse document frequencies, that of unknown words."""
    texts = [(name, re.findall(TOKEN, text.lower())) for name, text in templates()]
    n = len(texts)
    df: dict[str, int] = {}
    for _, ws in texts:
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log((1 + n) / (1 + d)) + 1 for w, d in sorted(df.items())}
    rows = []
    for i, (name, ws) in enumerate(texts):
        v = {w: (1 + math.log(ws.count(w))) * idf[w] for w in sorted(set(ws))}
        size = math.sqrt(sum(x * x for x in v.values()))
        rows += [(name, i, w, x / size) for w, x in v.items()]
    return rows, idf, math.log(1 + n) + 1


@cache
def anchors(threshold: float = THRESHOLD) -> list[str]:
    """Words, one of which every passage has that reaches the threshold."""
    rows, idf, _ = template_weights()
    room: dict[int, float] = {}
    of_word: dict[str, list[tuple[int, float]]] = {}
    for _, i, w, x in rows:
        room[i] = threshold * threshold - 1e-6
        of_word.setdefault(w, []).append((i, x * x))
    plain = set()
    for w in PROSE:
        if w in of_word and all(room[i] > x for i, x in of_word[w]):
            plain.add(w)
            for i, x in of_word[w]:
                room[i] -= x
    return sorted(set(idf) - plain)


#: Bounds of inverse document frequencies between kinds of known words.
KINDS = (2.5, 4.5)


@cache
def kinds_of_words() -> list[tuple[list[str], float]]:
    """The templates' words in kinds, each with its greatest inverse document frequency."""
    _, idf, _ = template_weights()
    cuts = (0.0, *KINDS, math.inf)
    kinds = [[w for w, x in idf.items() if lo <= x < hi] for lo, hi in zip(cuts, cuts[1:], strict=False)]
    return [(ws, max(idf[w] for w in ws)) for ws in kinds if ws]


def may_reach(own: Column, threshold: float) -> Column:
    """Whether a passage with these words can have a cosine from the threshold on: it has an anchor, and its known words are long
    enough beside its unknown ones. No word occurs more often than all words less all other different ones."""
    _, _, unknown = template_weights()
    different = F.size(F.array_distinct(own))
    times = 1 + F.log((F.size(own) - different + 1).cast("double"))
    sizes = [(F.size(F.array_intersect(own, F.array(*map(F.lit, ws)))), top) for ws, top in kinds_of_words()]
    known = times * times * sum((n * top * top for n, top in sizes), F.lit(0.0))
    others = (different - sum((n for n, _ in sizes), F.lit(0))) * unknown * unknown
    least = (threshold - 1e-6) ** 2
    return F.arrays_overlap(own, F.array(*map(F.lit, anchors(threshold)))) & (known >= least * (known + others))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def passages(text: Column) -> Column:
    """The different passages of a text, the whole first."""
    possessive = lambda pattern: pattern.replace("]*\\n)", "]*+\\n)") + "+"  # no recursion on long runs
    blocks = F.split(text, possessive(BLANK))
    comments = F.regexp_extract_all(text, F.lit(possessive(COMMENTS)), F.lit(0))
    lines = F.split(text, "\n")
    sentences = F.split(F.regexp_replace(text, SENTENCE, "$1\n"), "\n")
    return F.array_distinct(F.concat(F.array(text), blocks, comments, lines, sentences))


def score_passages(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows (key columns, passage) -> key, n_tokens, license, score of the best template, where any shares a word.

    Keys are those of single rows, so none is frequent.
    """
    spark = rows.sparkSession
    weights, idf, unknown = template_weights()
    vectors = F.broadcast(spark.createDataFrame(weights, "license string, template int, word string, weight double"))  # fixed table
    known = F.broadcast(spark.createDataFrame(list(idf.items()), "word string, idf double"))  # fixed table
    each = rows.select(*key, F.explode(tokens(F.col("passage"))).alias("word")).groupBy(*key, "word").agg(F.count("*").alias("tf"))
    weighed = each.join(known, "word", "left").withColumn("w", (1 + F.log("tf")) * F.coalesce("idf", F.lit(unknown)))
    own = F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("word", "w"))).alias("own")  # words of templates only: bounded
    sized = weighed.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"), F.sum("tf").alias("n_tokens"), own)
    met = sized.select(*key, "n_tokens", "size", F.explode("own").alias("o")).select(*key, "n_tokens", "size", "o.word", "o.w").join(vectors, "word")
    dots = met.groupBy(*key, "license", "template").agg((F.sum(F.col("w") * F.col("weight")) / F.first("size")).alias("cosine"), F.first("n_tokens").alias("n_tokens"))
    best = dots.groupBy(*key).agg(F.min(F.struct((-F.round("cosine", 6)).alias("s"), "license")).alias("b"), F.first("n_tokens").alias("n_tokens"))
    return best.select(*key, "n_tokens", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))


def folders(path: str) -> Column:
    """The folder of a path, without a slash at its end; "" is the root."""
    return F.regexp_replace(F.col(path), "/?[^/]*$", "")


def own_licenses(docs: DataFrame, *, text_col: str = "text", path_col: str = "path", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, path, folder, own_license, own_score, speaks; one row for each row of docs."""
    found = F.array(*map(F.lit, anchors(threshold)))
    path = F.coalesce(F.regexp_replace(quoted(path_col), "/+", "/"), F.lit(""))
    text = F.coalesce(quoted(text_col), F.lit(""))
    read = docs.select(quoted("doc_id").alias("doc_id"), path.alias("path"), text.alias("text"), tokens(text).alias("tokens"))
    read_passages = F.transform(passages(F.col("text")), lambda p: F.struct(p.alias("passage"), tokens(p).alias("own")))
    spoken = F.when(F.arrays_overlap("tokens", found), F.transform(F.filter(read_passages, lambda p: may_reach(p["own"], threshold)), lambda p: p["passage"]))
    files = scratch(read.select(F.monotonically_increasing_id().alias("row"), "doc_id", "path", F.size("tokens").alias("n_tokens"), spoken.alias("passages")), "passages")
    units = files.select("row", F.posexplode("passages").alias("unit", "passage"))
    scored = score_passages(units, ["row", "unit"]).filter(F.col("score") >= threshold)
    best = scored.groupBy("row").agg(F.min(F.struct((-F.col("score")).alias("s"), "license", (-F.col("n_tokens")).alias("n"))).alias("b"))
    told = files.select("row", "doc_id", "path", "n_tokens").join(best, "row", "left")
    covers = -F.col("b.n") >= FILE_SHARE * F.col("n_tokens")
    return told.select("doc_id", "path", folders("path").alias("folder"), F.col("b.license").alias("own_license"), (-F.col("b.s")).alias("own_score"), (F.col("b").isNotNull() & (F.col("path").rlike(LICENSE_FILE) | covers)).alias("speaks"))


def scan(docs: DataFrame, *, text_col: str = "text", path_col: str = "path", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, path, own_license, own_score, license, inherited_from (the folder; null: own or none)."""
    told = scratch(own_licenses(docs, text_col=text_col, path_col=path_col, threshold=threshold), "licenses")
    of_folder = told.filter("speaks").groupBy("folder").agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col("own_license").alias("license"))).alias("b")).select(F.col("folder").alias("ancestor"), F.col("b.license").alias("license"))
    parts = F.split("folder", "/")
    up = F.transform(F.sequence(F.lit(0), F.when(F.col("folder") == "", 0).otherwise(F.size(parts))), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("ancestor")))
    climbed = scratch(told.select("folder").distinct().select("folder", F.explode(up).alias("a")).select("folder", "a.depth", F.col("a.ancestor").alias("ancestor")), "ancestors")
    nearest = join_unique(climbed, scratch(of_folder, "folder-licenses"), "ancestor").groupBy("folder").agg(F.max(F.struct("depth", "ancestor", "license")).alias("n"))
    joined = join_unique(told, scratch(nearest, "nearest"), "folder", "left")
    inherits = F.col("own_license").isNull() & F.col("n").isNotNull()
    return joined.select("doc_id", "path", "own_license", "own_score", F.coalesce("own_license", F.col("n.license")).alias("license"), F.when(inherits, F.col("n.ancestor")).alias("inherited_from"))


def contract(docs: DataFrame) -> DataFrame:
    """documents has no paths: a file of the registered query stands in source/thousands/hundreds/doc_id."""
    at = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.expr("doc_id div 1000").cast("string"), F.expr("doc_id div 100").cast("string"), F.col("doc_id").cast("string"))
    return scan(docs.select("doc_id", "text", at.alias("path")))


def oracle_sql(threshold: float = THRESHOLD) -> str:
    """The same in DuckDB: every passage of every text is scored, without the anchors."""
    weights, idf, unknown = template_weights()
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    vectors = ", ".join(f"({quote(name)}, {i}, {quote(w)}, {x!r}::DOUBLE)" for name, i, w, x in weights)
    known = ", ".join(f"({quote(w)}, {x!r}::DOUBLE)" for w, x in idf.items())
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH v(license, template, word, weight) AS (VALUES {vectors}),
k(word, idf) AS (VALUES {known}),
d AS (
  SELECT doc_id, coalesce(text, '') AS text, len(regexp_extract_all({lower.format("coalesce(text, '')")}, '{TOKEN}')) AS n_all,
    coalesce(source, 'none') || '/' || (doc_id // 1000) || '/' || (doc_id // 100) || '/' || doc_id AS path,
    coalesce(source, 'none') || '/' || (doc_id // 1000) || '/' || (doc_id // 100) AS folder
  FROM documents),
u AS (
  SELECT doc_id, unnest(list_distinct(list_concat([text], string_split_regex(text, '{BLANK}'), regexp_extract_all(text, '{COMMENTS}'), string_split(text, chr(10)), string_split(regexp_replace(text, '{SENTENCE}', '\1' || chr(10), 'g'), chr(10))))) AS p
  FROM d),
t AS (SELECT doc_id, p, word, count(*) AS tf FROM (SELECT doc_id, p, unnest(regexp_extract_all({lower.format("p")}, '{TOKEN}')) AS word FROM u) GROUP BY ALL),
w AS (SELECT t.*, (1 + ln(tf)) * coalesce(idf, {unknown!r}) AS w FROM t LEFT JOIN k USING (word)),
z AS (SELECT doc_id, p, sqrt(sum(w * w)) AS size, sum(tf) AS n FROM w GROUP BY ALL),
dot AS (SELECT doc_id, p, license, template, sum(w * weight) AS dot FROM w JOIN v USING (word) GROUP BY ALL),
s AS (SELECT doc_id, license, n, round(dot / size, 6) AS score FROM dot JOIN z USING (doc_id, p)),
own AS (SELECT * FROM s WHERE score >= {threshold!r} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license, n DESC) = 1),
told AS (SELECT d.doc_id, path, folder, license AS own_license, score AS own_score, coalesce(n >= {FILE_SHARE} * n_all, false) AS speaks FROM d LEFT JOIN own USING (doc_id)),
f AS (SELECT folder, own_license AS license FROM told WHERE speaks QUALIFY row_number() OVER (PARTITION BY folder ORDER BY own_score DESC, own_license) = 1),
near AS (
  SELECT told.doc_id, f.folder AS above, f.license FROM told JOIN f ON f.folder = '' OR told.folder = f.folder OR starts_with(told.folder, f.folder || '/')
  QUALIFY row_number() OVER (PARTITION BY told.doc_id ORDER BY length(f.folder) DESC) = 1)
SELECT told.doc_id, path, own_license, own_score, coalesce(own_license, near.license) AS license, CASE WHEN own_license IS NULL THEN above END AS inherited_from
FROM told LEFT JOIN near USING (doc_id)
"""
