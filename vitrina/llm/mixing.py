"""Mixing to target weights by soft membership, with DataFrame functions only.

1. A labelled table (doc_id, domain) and its texts train a multinomial naive Bayes model over hashed
   words; it gives every document a posterior p over the K domains. Words of one text are not independent
   evidence, so n words count as n / (1 + (n - 1) * CORRELATION) (the design effect of correlated draws), for every length
   by the same rule; that keeps memberships soft.
2. Rates r >= 0, one for each document, minimise |sum_d r_d n_d p_d - T|^2 for target token totals T, by
   projected gradient steps in the metric that weighs documents by their tokens:
   r_d <- max(0, r_d - step * p_d . gap). Step lengths are those of Barzilai and Borwein (spectral projected gradient); a step
   that does not lower the loss below the worst of the last few is taken again with the safe length. A pass over
   the table (n, p) sums the K totals and three numbers more; only these reach the driver. It ends when the step is
   shorter than the tolerance (no change of any rate lowers the loss) or the targets are met, and says so in `converged`.

A rate depends on a document's p only, so the steps so far are one column expression: as long as no rate has been
0 they are one sum, afterwards they are nested, and from DEPTH steps on the rates are written as a table.
Nothing is collected but model counts (buckets x K) and K-vectors, whatever the number of documents.

Defined results: a document without words has the class prior as posterior and 0 tokens; rows that repeat
an id are one document with all their words; a null id is a document like any other; targets that no
rates reach get the nearest totals; an empty table gives no rates; without labelled rows there is
one domain, ""; columns beside those named never matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina.llm.common import join_unique, quoted, scratch, words

BUCKETS = 4096
#: How much a text's words repeat each other as evidence: beyond some 1 / CORRELATION words, more add little.
CORRELATION = 1 / 30
#: Labelled rows that the classifier is fitted on.
MAX_LABELLED = 10_000
#: Passes at most; shortest step (root mean square change of the rates, for a step of length 1) and gap of the totals that end them.
STEPS, TOLERANCE = 300, 1e-8
#: Nested steps after which the rates are written, and losses that a step is compared with.
DEPTH, MEMORY = 8, 5


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def fit_domains(docs: DataFrame, labelled: DataFrame, *, max_labelled: int = MAX_LABELLED) -> tuple[list[str], DataFrame, list[float]]:
    """Domains, log-probabilities (bucket, l0 .. lK-1) and log-priors, from a bounded sample of labelled rows."""
    spark = docs.sparkSession
    rows = labelled.filter("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").cast("string").alias("domain"))
    sample = F.broadcast(rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))  # bounded by max_labelled
    counted = docs.select("doc_id", "text").join(sample, "doc_id").select("domain", F.explode(words(F.col("text"))).alias("word")).groupBy("domain", _bucket(F.col("word")).alias("bucket")).count()
    found = counted.groupBy("domain").agg(F.collect_list(F.struct("bucket", "count")).alias("own")).collect()  # domains of the sample, BUCKETS entries each
    domains = sorted(r["domain"] for r in found) or [""]
    own = {r["domain"]: {x["bucket"]: x["count"] for x in r["own"]} for r in found}
    totals = [sum(own.get(d, {}).values()) for d in domains]
    table = [(b, *[math.log((own.get(d, {}).get(b, 0) + 0.5) / (n + 0.5 * BUCKETS)) for d, n in zip(domains, totals, strict=True)]) for b in range(BUCKETS)]
    model = spark.createDataFrame(table, "bucket int, " + ", ".join(f"l{k} double" for k in range(len(domains))))
    return domains, model, [math.log((n + 1) / (sum(totals) + len(domains))) for n in totals]


def posteriors(docs: DataFrame, model: DataFrame, priors: list[float]) -> DataFrame:
    """doc_id, n_tokens, p0 .. pK-1 of each document; words meet the model before any shuffle, and
    what is shuffled is one partial sum for each document and task."""
    k = range(len(priors))
    each = docs.select("doc_id", F.explode_outer(words(F.col("text"))).alias("word")).select("doc_id", "word", _bucket(F.col("word")).alias("bucket"))
    met = each.join(F.broadcast(model), "bucket", "left")  # BUCKETS rows
    sums = met.groupBy("doc_id").agg(F.count("word").alias("n_tokens"), *[F.sum(F.when(F.col("word").isNotNull(), F.col(f"l{i}"))).alias(f"s{i}") for i in k])
    weight = 1.0 / (1.0 + (F.greatest(F.lit(1), "n_tokens") - 1) * CORRELATION)
    logs = sums.select("doc_id", "n_tokens", *[(F.coalesce(F.col(f"s{i}"), F.lit(0.0)) * weight + F.lit(priors[i])).alias(f"s{i}") for i in k])
    top = F.greatest(*[F.col(f"s{i}") for i in k]) if len(priors) > 1 else F.col("s0")
    exps = logs.select("doc_id", "n_tokens", *[F.exp(F.col(f"s{i}") - top).alias(f"s{i}") for i in k])
    total = sum((F.col(f"s{i}") for i in k), F.lit(0.0))
    return exps.select("doc_id", "n_tokens", *[(F.col(f"s{i}") / total).alias(f"p{i}") for i in k])


def _along(step: list[float]) -> Column:
    """p . step of a row."""
    return sum((F.col(f"p{i}") * float(x) for i, x in enumerate(step)), F.lit(0.0))


def fit_rates(members: DataFrame, weights: list[float], *, total: float | None = None, scale_to_keep: float | None = None, steps: int = STEPS, tolerance: float = TOLERANCE) -> tuple[DataFrame, list[float], list[float], bool]:
    """members with rate, the target token totals, the totals reached, and whether it converged.

    weights: the domains' shares of the target; total: its tokens (default: those there are), or with
    scale_to_keep the least total in which no domain shrinks, times this factor.
    """
    k = range(len(weights))
    names = members.columns
    size = sum(weights)
    sums = members.agg(F.sum("n_tokens").alias("n"), *[F.sum(F.col("n_tokens") * F.col(f"p{i}")).alias(f"a{i}") for i in k]).first()
    n = float(sums["n"] or 0)
    if not n:
        return members.withColumn("rate", F.lit(1.0)), [0.0 for _ in k], [0.0 for _ in k], True
    have = [sums[f"a{i}"] for i in k]
    share = [w / size for w in weights]
    if scale_to_keep is not None:
        total = scale_to_keep * max(h / s for h, s in zip(have, share, strict=True) if s > 0)
    target = [s * (n if total is None else total) for s in share]
    gap_of = lambda got: [(g - t) / n for g, t in zip(got, target, strict=True)]
    table, rate = members.withColumn("rate", F.lit(1.0)), F.col("rate")
    nested = 0  # steps since the table, if a rate has been 0 among them
    straight: list[float] | None = [0.0 for _ in k]  # their sum, as long as none has
    gap = gap_of(have)
    reached, losses = have, [sum(x * x for x in gap)]
    length, converged = 1.0, False
    goal = tolerance * sum(target) / n
    for _ in range(steps):
        if math.sqrt(losses[-1]) <= goal:
            converged = True
            break
        for attempt in (length, 1.0):  # 1 is safe: sum_d n_d p_d p_d' / n has no eigenvalue above 1
            step = [attempt * g for g in gap]
            before = rate if straight is None else F.col("rate") - _along(straight)
            after = F.greatest(F.lit(0.0), before - _along(step))
            moved = table.select("n_tokens", *[F.col(f"p{i}") for i in k], before.alias("before"), after.alias("after"))
            got = moved.agg(
                *[F.sum(F.col("n_tokens") * F.col(f"p{i}") * F.col("after")).alias(f"a{i}") for i in k],
                F.min("after").alias("least"),
                F.sum(F.col("n_tokens") * (F.col("after") - F.col("before")) * (F.col("after") - F.col("before"))).alias("change"),
            ).first()
            now = [got[f"a{i}"] or 0.0 for i in k]
            new_gap = gap_of(now)
            loss = sum(x * x for x in new_gap)
            if loss <= max(losses[-MEMORY:]) or attempt == 1.0:
                break
        if straight is not None and got["least"] > 0:
            straight = [a + b for a, b in zip(straight, step, strict=True)]
        else:
            straight, rate, nested = None, after, nested + 1
        change = (got["change"] or 0.0) / n  # squared length of the step
        bent = sum((b - a) ** 2 for a, b in zip(gap, new_gap, strict=True))  # the same through the membership matrix
        gap, reached = new_gap, now
        losses.append(loss)
        if math.sqrt(change) <= tolerance * attempt:
            converged = True
            break
        length = min(1e6, max(1e-3, change / bent)) if bent > 0 else 1.0
        if nested >= DEPTH:
            table, rate, nested = scratch(table.select(*names, rate.alias("rate")), "rates"), F.col("rate"), 0
    last = rate if straight is None else F.col("rate") - _along(straight)
    return table.select(*names, last.alias("rate")), target, reached, converged


def tempered(members: DataFrame, k: int, power: float) -> list[float]:
    """Weights of the domains' own token shares to a power below 1, which lifts small domains."""
    have = members.agg(*[F.sum(F.col("n_tokens") * F.col(f"p{i}")).alias(f"a{i}") for i in range(k)]).first()
    return [max(1e-12, x or 0.0) ** power for x in have]


def mix(docs: DataFrame, labelled: DataFrame, *, power: float = 0.7, weights: dict[str, float] | None = None, total: float | None = None, scale_to_keep: float | None = None) -> tuple[DataFrame, list[str], list[float], list[float]]:
    """(doc_id, n_tokens, posterior array<struct<domain, p>>, rate, converged), domains, target totals, totals reached."""
    domains, model, priors = fit_domains(docs, labelled)
    members = scratch(posteriors(docs, model, priors), "members")
    shares = [weights.get(d, 0.0) for d in domains] if weights else tempered(members, len(domains), power)
    rated, target, reached, converged = fit_rates(members, shares, total=total, scale_to_keep=scale_to_keep)
    posterior = F.array(*[F.struct(F.lit(d).alias("domain"), F.col(f"p{i}").alias("p")) for i, d in enumerate(domains)])
    return rated.select("doc_id", "n_tokens", posterior.alias("posterior"), "rate", F.lit(converged).alias("converged")), domains, target, reached


def draw(docs: DataFrame, rates: DataFrame, *, least: int = 0) -> DataFrame:
    """docs with each document as often as its rate says: its whole part, and once more with the
    fraction as chance, decided by a hash of the id; `least` copies at any rate. A frequent id (null among them) is
    split off the join; a document without a rate is left out."""
    chance = F.pmod(F.xxhash64(F.lit("draw"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    copies = F.greatest(F.lit(least), (F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int"))
    times = scratch(rates.groupBy("doc_id").agg(F.max("rate").alias("rate")).select("doc_id", copies.alias("copies")), "copies")
    packed = docs.select(quoted("doc_id").alias("id"), F.struct(F.lit(0).alias("_"), *[quoted(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("whole"))
    known = join_unique(packed.filter("id is not null"), times.filter("doc_id is not null").select(F.col("doc_id").alias("id"), "copies"), "id", counted=docs.filter("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n")), grows=True)
    of_null = times.filter("doc_id is null").select("copies").first()
    none = packed.filter("id is null").withColumn("copies", F.lit(of_null["copies"] if of_null else 0))
    both = known.select("whole", "copies").unionByName(none.select("whole", "copies")).filter("copies > 0")
    again = both.select("whole", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return again.select(*[F.col(f"whole.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def language_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled table of the registered query: labelled documents with their language as domain."""
    return docs.select("doc_id", F.col("lang").alias("domain")).join(labels.select("doc_id").distinct(), "doc_id", "left_semi")


def contract(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rates, _, _, _ = mix(docs.select("doc_id", "text"), language_labels(docs, labels))
    return rates
