"""Quality rules, toxicity, mixing, licences, page text and the pipeline."""

import math
import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from vitrina.llm import license_texts, licenses, mixing, page_text, quality, toxicity
from vitrina.llm.common import read_table, scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", 0) for i, t in enumerate(texts)], DOCS)


# -- quality ------------------------------------------------------------------------------------


def brute_counts(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    covered = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 3)}
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_counts(spark):
    rng = random.Random(6)
    texts = [None, "", " \n ", "a b", "a a a a", "x\nx\n \nx", "a b c a b c", "é漢😀 #$\n|", " pad\x0b\x0cx "]
    texts += ["".join(rng.choices(["a", "b", "a", " ", " ", "\n", "#", "ß"], k=rng.randint(1, 200))) for _ in range(60)]
    got = quality.text_counts(docs_of(spark, texts)).orderBy("doc_id").collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert [tuple(r[n] for n in names) for r in got] == [brute_counts(t) for t in texts]


def test_binomial_tail(spark):
    cases = [(0, 100), (3, 400), (10, 5000), (600, 40000), (5, 10)]
    got = spark.createDataFrame(cases, "k long, n long").select(quality.binomial_tail(F.col("k"), F.col("n"), 0.02)).collect()
    for (k, n), (x,) in zip(cases, got, strict=True):
        if k >= n * 0.02:
            assert x == 1.0
        else:
            want = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(0.02) + (n - i) * math.log(0.98)) for i in range(k + 1))
            assert math.isclose(x, want, rel_tol=1e-6)


def test_cutoffs_hold_their_promise(spark):
    """Enough good texts without symbols make the rule safe; a stratum that is too small gets none."""
    good = " ".join(f"word{i}" for i in range(60))
    bad = good + " " + "### " * 60
    rows = [(i, good, "en") for i in range(6000)] + [(10_000, bad, "en"), (10_001, bad, "xx"), (10_002, bad, None), (10_003, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(6000)] + [(10_001, 1), (1, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.judge(docs, labels).filter("doc_id >= 10000 or doc_id = 0").collect()}
    assert got[0]["kept"] and not got[10_000]["kept"] and "symbols" in got[10_000]["rejected_by"]
    assert got[10_001]["kept"] and got[10_002]["kept"] and got[10_003]["base_failed"] and not got[10_003]["kept"]
    assert quality.judge(docs.limit(0), labels).count() == 0
    assert quality.judge(docs, labels.limit(0)).filter("not base_failed and not kept").count() == 0


def test_windows_of_equal_hashes_are_told_apart(spark, monkeypatch):
    """Windows are compared by their words: with a hash that is always the same the counts stay."""
    monkeypatch.setattr(quality.F, "xxhash64", lambda *cols: F.lit(7).cast("long"))
    texts = ["a b c a b c", "a b c d e f g", "x y x y x y x", "p q r s p q t r s p"]
    got = quality.text_counts(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert [r["n_repeat_words"] for r in got] == [brute_counts(t)[-1] for t in texts]


def test_fixed_sequence_by_brute_force(spark):
    """Each step of the path is tested by itself; the first failure ends the path, whatever comes after it."""
    rng = random.Random(12)
    rows = []
    for i in range(900):
        lang = "en" if i % 3 else "de"
        text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
        text += " ###" * (rng.choice([0, 0, 0, 2, 8, 30]) if i % 10 == 0 else 0) + "\nsame line" * rng.choice([0, 0, 0, 1, 5])
        rows.append((i, text, lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 10 != 0 or rng.random() < 0.1)) for i in range(800)], "doc_id long, quality int")
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1}
    held = {r["doc_id"]: r for r in quality.text_counts(docs).collect()}
    ratio = {
        "symbols": lambda r: r["n_symbols"] / r["word_chars"],
        "dup_lines": lambda r: r["n_dup_lines"] / r["n_lines"],
        "repeats": lambda r: r["n_repeat_words"] / r["n_words"],
        "long_words": lambda r: r["word_chars"] / r["n_words"],
        "short_words": lambda r: -r["word_chars"] / r["n_words"],
    }
    mine = {lang: [r for i, r in held.items() if r["lang"] == lang and i in good and r["n_words"] >= 50 and 100 * r["n_repeat_words"] <= 50 * r["n_words"]] for lang in ("en", "de")}
    total = sum(map(len, mine.values()))
    features = scratch(quality.text_counts(docs.withColumnRenamed("lang", "stratum")), "test-features")
    for alpha in (0.02, 0.1):
        got = {r["stratum"]: r for r in quality.select_cutoffs(features, labels, alpha=alpha).collect()}
        for lang, rs in mine.items():
            steps, cuts = 0, {}
            for name, cut in quality.PATH:
                now = cuts | {name: cut}
                k, n = sum(any(ratio[c](r) > x for c, x in now.items()) for r in rs), len(rs)
                if sum(math.comb(n, i) * alpha**i * (1 - alpha) ** (n - i) for i in range(k + 1)) > 0.05 * n / total:
                    break
                steps, cuts = steps + 1, now
            assert got[lang]["steps"] == steps and {c: got[lang][f"cut_{c}"] for c, _, _ in quality.RULES} == {c: cuts.get(c) for c, _, _ in quality.RULES}
            assert alpha == 0.02 or 0 < steps < len(quality.PATH)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_the_method_rejects_on_small_tables(spark):
    docs, labels = (read_table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    assert quality.contract(docs, labels).filter("not base_failed and not kept").count() > 0


# -- toxicity -----------------------------------------------------------------------------------


def unit_vectors(rng, n, terms, most):
    import numpy as np

    out = []
    for _ in range(n):
        own = sorted(rng.sample(range(terms), rng.randint(1, most)))
        weights = np.array([rng.choice([0.5, 1.0, rng.random()]) for _ in own])
        out.append((np.array(own), weights / math.sqrt(float((weights * weights).sum()))))
    return out


def test_index_is_exact():
    rng = random.Random(13)
    vectors = unit_vectors(rng, 700, 60, 8)
    for index in (toxicity.Index(vectors, 60, 0.0), toxicity.Index(vectors, 60, 0.08), toxicity.Index(vectors, 60, 1.1)):
        check_index(index, vectors)


def check_index(index, vectors):
    import pickle

    import numpy as np

    index = pickle.loads(pickle.dumps(index))
    for terms, weights in vectors[:80]:
        mine = dict(zip(terms.tolist(), weights.tolist(), strict=True))
        scores = sorted(((-round(sum(w * mine.get(t, 0.0) for t, w in zip(a.tolist(), x.tolist(), strict=True)), 9), i) for i, (a, x) in enumerate(vectors)))
        want = [-s for s, _ in scores if s < 0][:10]
        got = index.top(terms, weights, 10)
        assert [round(s, 9) for s, _ in got] == want
        without = frozenset(i for _, i in got[:3])
        assert not without & {i for _, i in index.top(terms, weights, 10, without)}
    assert index.top(np.zeros(0, np.int64), np.zeros(0), 5) == []


def test_blocks_are_skipped(monkeypatch):
    """Postings of blocks that can't hold a neighbour are not read."""
    import numpy as np

    groups = [(np.array([2 * g, 2 * g + 1]), np.array([0.8, 0.6])) for g in range(30) for _ in range(toxicity.BLOCK)]
    index = toxicity.Index(groups, 60, 1.1)
    seen = []
    plain = toxicity.ranges
    monkeypatch.setattr(toxicity, "ranges", lambda lo, hi: seen.append(int((hi - lo).sum())) or plain(lo, hi))
    terms, weights = np.arange(60), np.full(60, 0.01)
    weights[6], weights[7] = 0.8, 0.6
    found = index.top(terms, weights, 5)
    assert all(i // toxicity.BLOCK == 3 for _, i in found)
    assert sum(seen[1:]) <= toxicity.FIRST_BLOCKS * 2 * toxicity.BLOCK < len(index.rows)


def brute_toxicity(examples, texts, k=15):
    """Scores and neighbours by the definition, over dictionaries: examples (id, toxic, text)."""
    import numpy as np

    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t.lower()) if w]
    sets = [(y, set(split(t))) for _, y, t in examples]
    n, pos = len(sets), sum(y for y, _ in sets)
    weight = {}
    for w in set().union(*(s for _, s in sets)):
        a, c = sum(w in s for y, s in sets if y), sum(w in s for y, s in sets if not y)
        odds = (a / pos) / ((c + toxicity.SMOOTH) / (n - pos))
        weight[w] = (math.log((1 + n) / (1 + a + c)) + 1) * math.log2(2 + odds) ** toxicity.FOCUS

    def vector(t):
        ws = split(t)
        v = {w: (1 + math.log(ws.count(w))) * weight.get(w, math.log(1 + n) + 1) for w in set(ws)}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items() if w in weight}

    vectors = [vector(t) for _, _, t in examples]

    def near(t):
        v = vector(t)
        cos = [(-round(sum(x * u.get(w, 0.0) for w, x in v.items()), 12), i, y) for (i, y, own), u in zip(examples, vectors, strict=True) if own != t]
        return sorted(c for c in cos if c[0] < 0)[:k]

    def votes(t):
        yes, total = 0.1 * pos / n, 0.1
        for s, _, y in near(t):
            total, yes = total + 1 / (1.05 + s), yes + y / (1.05 + s)
        p = min(max(yes / total, 1e-3), 1 - 1e-3)
        return math.log(p / (1 - p))

    xs, ys = np.array([votes(t) for _, _, t in examples]), np.array([y for _, y, _ in examples], float)
    theta = np.array([1.0, 0.0])
    for _ in range(200):  # damped Newton steps on the penalised likelihood
        p = 1 / (1 + np.exp(-(theta[0] * xs + theta[1])))
        g = np.array([((ys - p) * xs).sum() + 1e-2 * (1 - theta[0]), (ys - p).sum() - 1e-3 * theta[1]])
        h = np.array([[(p * (1 - p) * xs * xs).sum() + 1e-2, (p * (1 - p) * xs).sum()], [(p * (1 - p) * xs).sum(), (p * (1 - p)).sum() + 1e-3]])
        theta = theta + np.clip(np.linalg.solve(h, g), -1, 1)
    out = []
    for t in texts:
        own = near(t)
        out.append((1 / (1 + math.exp(-(max(theta[0], 1e-3) * votes(t) + theta[1]))) if own else pos / n, [(i, -s, y) for s, i, y in own]))
    return out


def test_toxicity_brute_force(spark):
    rng = random.Random(41)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(160):
        bad = i % 4 == 0
        rows.append((i, int(bad), " ".join(rng.choices(words, k=rng.randint(1, 40)) + (rng.choices(["vile", "Nasty", "w1"], k=2) if bad else []))))
    rows += [(200, 1, rows[0][2]), (201, 0, rows[1][2]), (202, 0, "")]
    texts = [t for _, _, t in rows] + ["", "  ", "never seen", "nasty!", "w1 w2, VILE w3", "w5 " * 2000 + "nasty"]
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, y, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), model).orderBy("doc_id").collect()
    for r, (score, near) in zip(got, brute_toxicity(rows, texts), strict=True):
        assert math.isclose(r["score"], score, rel_tol=1e-5, abs_tol=1e-9)
        assert [(e["doc_id"], round(e["similarity"], 9), e["toxic"]) for e in r["evidence"]] == [(i, round(s, 9), y) for i, s, y in near]
    # own labels are not looked up: a row's own text does not vote
    assert all(rows[i][0] not in [e["doc_id"] for e in r["evidence"]] for i, r in enumerate(got[: len(rows)]))


def test_examples_are_read_once():
    """A model needs no list of its examples, and its terms survive pickling."""
    import pickle

    examples = [(i, i % 2, i, *toxicity.count_words(f"w{i % 7} W{i % 3}, \xe4{i} both")) for i in range(40)]
    once, listed = toxicity.Model(iter(examples), (1.0, 1.0), 5), toxicity.Model(examples, (1.0, 1.0), 5)
    again = pickle.loads(pickle.dumps(once))
    assert again.number == listed.number and list(again.number) == list(listed.number)
    texts = ["w1 both", "", "w2 \xe47 w2", "unseen"]
    assert again.score(texts) == once.score(texts) == listed.score(texts)


def own_mb():
    """Memory of this process that is no mapped file."""
    with open("/proc/self/smaps_rollup") as f:
        return sum(int(line.split()[1]) for line in f if line.startswith(("Pss_Anon", "Pss_Shmem"))) / 1024


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="memory can't be read here")
def test_driver_keeps_no_model(spark):
    """What fitting takes goes back to the system: the driver keeps it neither as a model nor as freed gaps."""

    def tables(n_docs, n_words):
        text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n_words)), lambda i: F.hex(F.xxhash64("id", i))), " ")
        docs = spark.range(n_docs).select(F.col("id").alias("doc_id"), text.alias("text"))
        return docs, docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))

    toxicity.contract(*tables(20, 5))  # imports
    before = own_mb()
    scored = toxicity.contract(*tables(800, 400))
    assert own_mb() - before < 12  # 22 with the gaps
    assert scored.count() == 800


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables here")
def test_held_out_accuracy(spark):
    docs, labels = (read_table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    got = toxicity.contract(docs, labels).join(labels, "doc_id").filter("held_out").select("doc_id", "predicted", "toxic", "score").collect()
    hits = sum(r["predicted"] and r["toxic"] for r in got)
    assert hits >= 0.9 * sum(r["toxic"] for r in got) and hits >= 0.9 * sum(r["predicted"] for r in got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_held_out_fold(spark):
    ids = spark.range(200).select("id", toxicity.held_out(F.col("id")).alias("out")).collect()
    assert all(r["out"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in ids)


def test_toxicity_odd_input(spark):
    docs = docs_of(spark, [None, "", "idiot " * 5, "fine words here", "fine words here"]).withColumn("score", F.lit("mine"))
    labels = spark.createDataFrame([(2, 1), (3, 0), (3, 0), (99, 1), (None, 1), (1, None)], "doc_id long, toxic int")
    got = toxicity.contract(docs.drop("score"), labels).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.contract(docs.limit(0).drop("score"), labels).count() == 0
    assert [r["predicted"] for r in toxicity.contract(docs.drop("score"), labels.limit(0)).collect()] == [0] * 5
    kept = toxicity.reject(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == 5


# -- mixing -------------------------------------------------------------------------------------


def labelled_corpus(spark, n=400):
    rng = random.Random(17)
    words = {"x": [f"x{i}" for i in range(40)], "y": [f"y{i}" for i in range(40)]}
    rows = []
    for i in range(n):
        d = "x" if i % 4 else "y"
        rows.append((i, " ".join(rng.choices(words[d] + words["x" if d == "y" else "y"][:5], k=rng.randint(0, 60))), d))
    return spark.createDataFrame(rows, "doc_id long, text string, domain string")


def test_rates_reach_their_targets(spark):
    docs = labelled_corpus(spark)
    rates, domains, target, reached = mixing.mix(docs, docs.select("doc_id", "domain").filter("doc_id % 3 = 0"), weights={"x": 1.0, "y": 1.0})
    rows = rates.collect()
    assert domains == ["x", "y"] and len(rows) == docs.count() and all(r["rate"] >= 0 for r in rows)
    for k in range(2):
        own = sum(r["rate"] * r["n_tokens"] * r["posterior"][k]["p"] for r in rows)
        assert math.isclose(own, target[k], rel_tol=1e-6) and math.isclose(own, reached[k], rel_tol=1e-9)
    assert all(abs(sum(x["p"] for x in r["posterior"]) - 1) < 1e-9 for r in rows)


def test_posteriors_brute_force(spark):
    """Naive Bayes over hashed words, in plain Python."""
    import xxhash

    docs = labelled_corpus(spark)
    rows = docs.collect()
    bucket = lambda w: xxhash.xxh64_intdigest(w, 42) % mixing.BUCKETS
    own = {d: {} for d in "xy"}
    for r in rows:
        for w in r["text"].split():
            own[r["domain"]][bucket(w)] = own[r["domain"]].get(bucket(w), 0) + 1
    totals = {d: sum(own[d].values()) for d in "xy"}
    got = {r["doc_id"]: r for r in mixing.mix(docs, docs.select("doc_id", "domain"))[0].collect()}
    for r in rows:
        ws = r["text"].split()
        logs = {}
        for d in "xy":
            s_ = sum(math.log((own[d].get(bucket(w), 0) + 0.5) / (totals[d] + 0.5 * mixing.BUCKETS)) for w in ws)
            logs[d] = s_ / (1 + (max(1, len(ws)) - 1) * mixing.CORRELATION) + math.log((totals[d] + 1) / (sum(totals.values()) + 2))
        top = max(logs.values())
        norm = sum(math.exp(x - top) for x in logs.values())
        assert got[r["doc_id"]]["n_tokens"] == len(ws)
        for x in got[r["doc_id"]]["posterior"]:
            assert math.isclose(x["p"], math.exp(logs[x["domain"]] - top) / norm, rel_tol=1e-9, abs_tol=1e-12)


def test_rates_at_zero_are_nearest(spark):
    """A target without y: rates of y documents stop at zero, and no change of a rate lowers the loss."""
    docs = labelled_corpus(spark)
    rates, _, target, reached = mixing.mix(docs, docs.select("doc_id", "domain"), weights={"x": 1.0})
    rows = [(r["n_tokens"], [x["p"] for x in r["posterior"]], r["rate"], r["converged"]) for r in rates.collect()]
    assert min(r for _, _, r, _ in rows) == 0 and all(c for *_, c in rows)
    total = sum(n for n, *_ in rows)
    gap = [(sum(n * p[k] * r for n, p, r, _ in rows) - target[k]) / total for k in range(2)]
    assert all(math.isclose(sum(n * p[k] * r for n, p, r, _ in rows), reached[k], rel_tol=1e-9, abs_tol=1e-6) for k in range(2))
    for n, p, r, _ in rows:  # first-order conditions of the least squares
        g = sum(p[k] * gap[k] for k in range(2))
        assert not n or (g >= -1e-5 if r < 1e-9 else abs(g) < 1e-5)


def test_too_few_steps_say_so(spark):
    docs = labelled_corpus(spark)
    domains, model, priors = mixing.fit_domains(docs, docs.select("doc_id", "domain"))
    members = mixing.posteriors(docs, model, priors)
    assert mixing.fit_rates(members, [0.1, 5.0], steps=1)[3] is False and mixing.fit_rates(members, [0.1, 5.0])[3] is True


def test_many_domains(spark):
    """More domains than any fixed table of columns: each has documents of its own words."""
    rows = [(i, f"only{i % 70} " * 5, f"d{i % 70:02}") for i in range(210)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    rates, domains, target, reached = mixing.mix(docs, docs.select("doc_id", "domain"), weights={f"d{i:02}": 1.0 + i % 2 for i in range(70)})
    assert len(domains) == 70 and all(math.isclose(a, b, rel_tol=1e-4) for a, b in zip(target, reached, strict=True))
    assert rates.filter("rate < 0").count() == 0


def test_draw_and_odd_input(spark):
    docs = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "c", 3), (4, None, 4)], "doc_id long, text string, rate int")
    rates = spark.createDataFrame([(1, 3.0), (2, 0.0), (None, 1.0), (4, 0.2)], "doc_id long, rate double")
    got = sorted((r["doc_id"] or 0) for r in mixing.draw(docs, rates).collect() if r["doc_id"] != 4)
    assert got == [0, 1, 1, 1] and mixing.draw(docs, rates).columns == docs.columns
    assert mixing.draw(docs, rates, least=1).filter("doc_id = 2").count() == 1
    nothing, _, _, _ = mixing.mix(docs.limit(0), docs.select("doc_id", F.lit("d").alias("domain")))
    assert nothing.count() == 0
    repeated = docs.unionByName(docs)
    assert mixing.mix(repeated, docs.select("doc_id", F.lit("d").alias("domain")))[0].count() == 4
    assert mixing.draw(repeated, rates).filter("doc_id = 1").count() == 6
    alone, domains, _, _ = mixing.mix(docs, docs.select("doc_id", F.lit("d").alias("domain")).limit(0))
    assert domains == [""] and alone.count() == 4


# -- licences -----------------------------------------------------------------------------------


def brute_cosines(passage, wordings):
    """Best licence of a passage by cosines of plain dictionaries, with document frequencies of its own."""
    split = lambda t: re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*\+?", "".join(c.lower() if c.isascii() else c for c in t))
    lists = [split(t) for _, t in wordings]
    idf = lambda w: math.log((1 + len(lists)) / (1 + sum(w in ws for ws in lists))) + 1
    vector = lambda ws: {w: (1 + math.log(ws.count(w))) * idf(w) for w in set(ws)}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    mine = vector(split(passage))
    found = []
    for (name, _), ws in zip(wordings, lists, strict=True):
        other = vector(ws)
        if shared := mine.keys() & other.keys():
            found.append((-round(sum(mine[w] * other[w] for w in shared) / size(mine) / size(other), 6), name))
    return min(found, default=None)


def test_passages_brute_force(spark, sf_dir):
    wordings = license_texts.templates()
    rng = random.Random(3)
    lines = [t for _, t in rng.sample(wordings, 25)] + ["Released under the MIT License.", "licensed under something else entirely", "copyright", "GNU General Public License", "été 漢字", "!!"]
    lines += [x for r in read_table(spark, sf_dir, "documents").collect() for x in r["text"].split("\n") if re.search("(?i)licen[sc]", x)][:10]
    table = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "row long, passage string")
    got = {r["row"]: (-r["score"], r["license"]) for r in licenses.score_passages(table, ["row"]).collect()}
    for i, x in enumerate(lines):
        want = brute_cosines(x, wordings)
        assert (want is None) == (i not in got) and (want is None or math.isclose(got[i][0], want[0], abs_tol=2e-6) and got[i][1] == want[1])


def test_anchors_lose_nothing():
    """Words that are no anchor hold less than the threshold of every template."""
    rows, _, _ = licenses.template_weights()
    for threshold in (0.4, 0.6, 0.8):
        found = set(licenses.anchors(threshold))
        rest = {}
        for _, i, w, x in rows:
            rest[i] = rest.get(i, 0.0) + (0.0 if w in found else x * x)
        assert max(rest.values()) < threshold * threshold


def test_no_passage_is_left_out(spark):
    """Passages that the filter drops are below the threshold, by scoring all."""
    rng = random.Random(19)
    known = sorted(licenses.template_weights()[1])
    prose = [f"w{i}" for i in range(50)] + ["mit", "the", "of", "license"] * 4
    lines = []
    for i in range(400):
        _, text = rng.choice(license_texts.templates())
        ws = text.split()
        kept = [w for w in ws if rng.random() < rng.choice([0.3, 0.9, 1.0])]
        lines.append(" ".join(kept + rng.choices(prose, k=rng.choice([0, 0, 1, 3, 10, 80])) + rng.choices(known, k=rng.choice([0, 0, 5]))))
    table = spark.createDataFrame(list(enumerate(lines)), "row long, passage string")
    scores = {r["row"]: r["score"] for r in licenses.score_passages(table, ["row"]).collect()}
    for threshold in (0.6, 0.8):
        kept = {r["row"] for r in table.filter(licenses.may_reach(licenses.tokens(F.col("passage")), threshold)).select("row").collect()}
        assert {i for i, x in scores.items() if x >= threshold} <= kept and len(kept) < len(lines)


BSD2 = f"BSD 2-Clause License\n\nCopyright (c) 2020, A. Author\n\n{license_texts.BSD_HEAD}\n\n{license_texts.BSD_SOURCE}\n\n{license_texts.BSD_BINARY}\n\n{license_texts.BSD_WARRANTY}\n"


def test_wording_tells_licences_apart(spark):
    free = "# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU {} as published by\n# the Free Software Foundation; either version {} of the License, or\n# (at your option) any later version.\n"
    code = "\n".join(f"value_{i} = call_{i}(argument)" for i in range(40))
    cases = [
        (BSD2, "BSD-2-Clause"),
        (BSD2.replace(license_texts.BSD_BINARY, license_texts.BSD_BINARY + "\n\n" + license_texts.BSD_NAMES).replace("2-Clause", "3-Clause"), "BSD-3-Clause"),
        (f"MIT License\n\nCopyright (c) 2020 A. Author\n\n{license_texts.PERMISSION_MIT}\n\n{license_texts.NOTICE_MIT}\n\n{license_texts.WARRANTY_MIT}", "MIT"),
        (free.format("General Public License", "2") + code, "GPL-2.0-or-later"),
        (free.format("General Public License", "3") + code, "GPL-3.0-or-later"),
        (free.format("Lesser General Public License", "2.1") + code, "LGPL-2.1-or-later"),
        (free.format("Affero General Public License", "3") + code, "AGPL-3.0-or-later"),
        ("    GNU GENERAL PUBLIC LICENSE\n      Version 2, June 1991\n\n" + code, "GPL-2.0-only"),
        *[(f"// SPDX-License-Identifier: {x}\n{code}", x) for x in ("BSD-2-Clause", "BSD-3-Clause", "AGPL-3.0-only", "MPL-2.0", "GPL-2.0-or-later", "LGPL-2.1-only", "CC-BY-SA-4.0", "Apache-2.0")],
        ("Licensed under CC BY 4.0.", "CC-BY-4.0"),
        ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.", "CC-BY-SA-3.0"),
        ("/* Some rights. */ Released under the GPLv2. " + "More text follows here. " * 20, "GPL-2.0-only"),
        (code, None),
        ("The software is a work of many. You may use the copy that you have for any purpose. " * 30, None),
    ]
    rows = [(i, text, f"p{i}/{'LICENSE' if i < 3 else 'code.c'}") for i, (text, _) in enumerate(cases)] + [(100, code, "p0/sub/code.c")]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, path string")).collect()}
    assert {i: got[i]["own_license"] for i in range(len(cases))} == {i: x for i, (_, x) in enumerate(cases)}
    assert got[100]["license"] == "BSD-2-Clause" and got[100]["inherited_from"] == "p0"


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no licence files here")
def test_whole_licence_files(spark):
    want = {"GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "Apache-2.0": "Apache-2.0", "MPL-2.0": "MPL-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0"}
    rows = []
    for i, name in enumerate(sorted(want)):
        with open(f"/usr/share/common-licenses/{name}", encoding="utf-8") as f:
            rows.append((i, f.read(), f"{name}/COPYING"))
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, path string")).collect()
    assert {r["path"].split("/")[0]: r["own_license"] for r in got} == want


def test_licences_of_repeated_and_hot_rows(spark):
    """A folder of most files, a line that all repeat, and rows that are equal."""
    rows = [(i, "Released under the MIT License." if i % 2 else "text", f"hot/f{i}") for i in range(300)] + [(i % 3, "x", "hot/a/b") for i in range(30)]
    rows += [(900, "Licensed under CC BY 4.0.", "hot/LICENSE")] * 2
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, path string"))
    assert got.count() == len(rows) and got.filter("license is null").count() == 0
    assert got.filter("path = 'hot/a/b' and license = 'CC-BY-4.0' and inherited_from = 'hot'").count() == 30


def test_inheritance(spark):
    rows = [
        (1, "Released under the MIT License.", "r/LICENSE"),
        (2, "code", "r/a/b/file"),
        (3, "Licensed under the Apache License, Version 2.0.", "r/a/NOTICE"),
        (4, "code", "r/a/b/c/file"),
        (5, "Licensed under CC BY-NC 4.0.\n" + "prose " * 50, "r/a/file"),
        (6, "code", "r/x"),
        (7, "code", "other/x"),
        (8, None, None),
        (9, "", "r//a/b/empty"),
    ]
    got = {r["doc_id"]: (r["license"], r["inherited_from"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, path string")).collect()}
    assert got == {1: ("MIT", None), 2: ("Apache-2.0", "r/a"), 3: ("Apache-2.0", None), 4: ("Apache-2.0", "r/a"), 5: ("CC-BY-NC-4.0", None), 6: ("MIT", "r"), 7: (None, None), 8: (None, None), 9: ("Apache-2.0", "r/a")}
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string, path string")).count() == 0


# -- pages --------------------------------------------------------------------------------------

HEAD = '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>'


def branch(host, path):
    """The hash of a branch, by its path."""
    found = page_text.host_id(host)
    for step in path.split(">")[1:]:
        found = page_text.path_id(found, f">{step}")
    return found


def importance(pages):
    return {bytes(r["path"]): r for r in page_text.site_importance(page_text.branches_of_pages(pages)).collect()}


def page(body, nav="x"):
    return f'{HEAD}<nav><ul><li><a href="/x">{nav}</a></ul></nav><!-- <p>no</p> --><div class="ad">Buy</div>{body}<footer>&copy; x</footer>'


def test_main_text():
    body = '<article><h1>Head &amp; co</h1><p><b>One  two.<br><p>Three <i>fo</i>ur\n five&nbsp;six.</p><ul><li>a<li>b</ul><table><tr><td>1<td>2</table><section class="comments"><p>nice</p></section><aside>no</aside><form><p>mail</p></form></article>'
    want = "Head & co\nOne two.\nThree four five six.\na\nb\n1 2"
    assert page_text.main_text(page(body)) == want
    assert page_text.main_text(page(body.replace("article", "main"))) == want
    assert page_text.main_text(page(body.replace("article", "div"))) == want
    assert page_text.main_text(page("<div class='sidebar'><article><p>in</p></article></div>")) == "in"
    assert page_text.main_text(page("<article><header><div>by me</div><h1>T</h1></header><p>x &lt;b&gt; &amp y</p></article>")) == "T\nx <b> & y"
    assert [page_text.main_text(x) for x in ("", "<", "plain", "<p", "<article>", "<p>a<p>b", "<script>x")] == ["", "<", "plain", "<p", "", "a\nb", ""]


def test_style_tree(spark):
    """A container that says the same on every page goes; a passage that pages share stays."""
    share = "<p>a passage that all pages quote</p>"
    rows = [(i, f"https://h.example/{i}", page(f"<article><h1>t{i}</h1><p>{'w%d ' % i * 5}</p>{share}<div class='more{i}'>Read our other stories</div></article>", f"n{i}")) for i in range(30)]
    rows += [(100, "https://tiny.example/1", page("<article><p>x</p><div class='more'>kept: too few pages</div></article>")), (101, None, None), (102, "nothing", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in page_text.contract(pages).collect()}
    assert all(got[i] == f"t{i}\n{('w%d ' % i * 5).strip()}\na passage that all pages quote" for i in range(30))
    assert got[100] == "x\nkept: too few pages" and got[101] == got[102] == ""
    assert page_text.contract(pages.limit(0)).count() == 0
    clash = page_text.extract_text(pages.withColumn("text", F.lit("old")).withColumn("n_chars", F.lit(1)))
    assert clash.columns.count("text") == 1 and clash.filter("text = 'old'").count() == 0


def test_large_models_are_joined(spark, monkeypatch):
    monkeypatch.setattr(page_text, "BROADCAST_BYTES", -1)
    test_style_tree(spark)


def test_identical_pages_keep_their_text(spark):
    rows = [(i, "https://same.example/x", page("<article><div><p>only this</p></div></article>")) for i in range(20)]
    assert {r["text"] for r in page_text.contract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"only this"}


def test_site_importance_brute_force(spark):
    rng = random.Random(21)
    rows = [(f"https://h.example/{i}", f"<body><div class='a'>{rng.choice('xyz')}</div><div class='b'><p>{i}</p></div><ul><li><a>{i}</a></ul></body>") for i in range(50)]
    by = importance(spark.createDataFrame(rows, "url string, html string"))
    got = {path: by[branch("h.example", path)]["importance"] for path in (">body>div.a", ">body>div.b", ">body>ul")}
    said = [re.search("'a'>(.)<", h)[1] for _, h in rows]
    entropy = -sum(said.count(c) / 50 * math.log(said.count(c) / 50) for c in set(said)) / math.log(50)
    assert math.isclose(got[">body>div.a"], 0.9 * entropy, rel_tol=1e-9)
    assert math.isclose(got[">body>div.b"], 0.9, rel_tol=1e-9) and got[">body>ul"] == 0


def test_many_shapes_keep_unique_text(spark):
    """Sections of many shapes, each page's text its own: the shapes' entropy falls with the host, the text's does not."""
    many = lambda i: i if 0 < i < 80 else 1
    rows = [(i, f"https://h.example/{i}", f"<article><h1>t{i}</h1><section>{''.join(f'<p>w{i} {k}</p>' for k in range(many(i)))}</section><div class='more'>Read on</div></article>") for i in range(2500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    section = importance(pages)[branch("h.example", ">article>section")]
    assert section["importance"] < page_text.THRESHOLD and math.isclose(section["content"], 1.0)
    got = {r["page_id"]: r["text"] for r in page_text.contract(pages).collect()}
    assert all(f"w{i} 0" in got[i] and "Read on" not in got[i] for i in range(2500))


def test_copies_count_once(spark):
    """250 copies of one page beside 20 pages with texts of their own."""
    body = "<article><h1>{0}</h1><section><p>story {0}</p></section><div class='more'>Read on</div></article>"
    rows = [(i, f"https://c.example/{i}", page(body.format(max(0, i - 249)), f"n{i}")) for i in range(270)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert importance(pages)[branch("c.example", ">html>body>article>section")]["n_pages"] == 21
    assert {r["page_id"]: r["text"] for r in page_text.contract(pages).collect()} == {i: f"{max(0, i - 249)}\nstory {max(0, i - 249)}" for i in range(270)}


def test_unique_parts_keep_what_holds_them(spark):
    """A container that is nearly always the same stays for the judged part inside it that differs."""
    rows = []
    for i in range(1000):
        inside = f"<ul><li>own {i}</li></ul>" if i < 20 else ""
        rows.append((i, f"https://u.example/{i}", f"<article><p>t{i}</p><section><p>same</p>{inside}</section><div class='more'>Read on</div></article>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    section = importance(pages)[branch("u.example", ">article>section")]
    assert max(section["importance"], section["content"]) < page_text.THRESHOLD
    got = {r["page_id"]: r["text"] for r in page_text.contract(pages).collect()}
    assert got[0] == "t0\nsame\nown 0" and got[999] == "t999\nsame"


def test_links_in_the_article_stay(spark):
    """Link texts in a sentence and lists of sources stay; links that are the same on every page go."""
    guide = "<p>see <a href='/g'><span>the guide</span></a> first</p>"
    rows = []
    for i in range(30):
        sources = f"<ul><li><a href='/s'>source {i}</a></li><li><a href='/t'>source b{i}</a></li></ul>"
        rows.append((2 * i, f"https://l.example/{i}", page(f"<article><h1>t{i}</h1>{guide}{sources}<div class='more'><a href='/m'>Read on</a></div></article>")))
        rows.append((2 * i + 1, f"https://m.example/{i}", page(f"<h1>t{i}</h1>{guide}{sources}<div class='more'><a href='/m'>Read on</a></div>")))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in page_text.contract(pages).collect()}
    assert all(got[2 * i] == f"t{i}\nsee the guide first\nsource {i}\nsource b{i}" for i in range(30))
    assert all(got[2 * i + 1].startswith(f"t{i}\nsee the guide first\nsource {i}\nsource b{i}") and "Read on" not in got[2 * i + 1] for i in range(30))
    by = importance(pages)
    assert by[branch("l.example", ">html>body>article>ul")]["importance"] > 0.2 and branch("l.example", ">html>body>article>p>a>span") not in by


def test_least_pages_is_a_parameter(spark):
    rows = [(i, f"https://s.example/{i}", f"<article><p>t{i}</p><div class='more'>Read on</div></article>") for i in range(7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for least, more in ((8, "\nRead on"), (7, "")):
        assert {r["page_id"]: r["text"] for r in page_text.extract_text(pages, min_pages=least).collect()} == {i: f"t{i}{more}" for i in range(7)}


def random_site(rng, n):
    """Pages as trees of (tag, class, children) and texts; some containers are the same on many pages."""
    fixed = [("div", f"box{c}", [("p", "", f"fixed {c} text")]) for c in "abc"]

    def grow(i, depth):
        out = [("p", "", f"w{rng.random():.6f} of {i}")]
        for _ in range(rng.randint(0, 3)):
            pick = rng.random()
            if pick < 0.35:
                out.append(rng.choice(fixed))
            elif pick < 0.6 and depth < 4:
                out.append((rng.choice(["div", "section", "ul"]), rng.choice(["", "m"]), grow(i, depth + 1)))
            elif pick < 0.8 and depth < 4:
                out.append(("div", "hull", [rng.choice(fixed), rng.choice(fixed)] + ([("section", "", grow(i, 4))] if rng.random() < 0.03 else [])))
            else:
                out.append(("p", "", rng.choice(["shared passage", f"own {i} {rng.random():.6f}"])))
        return out

    same = ("p", "", "same words")
    wrap = ("div", "wrap", [("div", "in", [same]), ("ul", "", [same, same])])
    keep = lambda i: ("div", "keep", [same, ("section", "", [("p", "", f"only {i}")])] if i < 3 else [same])
    return [[*grow(i, 0), wrap, ("div", "foot", [same]), keep(i)] for i in range(n)]


def markup(node):
    tag, name, inner = node
    return f"<{tag}{f' class={name}' if name else ''}>{inner if isinstance(inner, str) else ''.join(map(markup, inner))}</{tag}>"


def texts_in(node):
    return [node[2]] if isinstance(node[2], str) else [x for c in node[2] for x in texts_in(c)]


def brute_site(site, threshold=0.2, least=8):
    """The style tree by its definition, over nested tuples: what is left of each page."""
    held = {}  # path -> page -> (presentations, contents)

    def visit(i, node, path):
        tag, name, inner = node
        path = (*path, (tag, name))
        if not isinstance(inner, str):
            for c in inner:
                visit(i, c, path)
            if tag in ("div", "section", "ul"):
                shown, said = held.setdefault(path, {}).setdefault(i, ([], []))
                shown.append(tuple(c[0] for c in inner))
                said.append(tuple(texts_in(node)))

    copies = {}
    for i, page_ in enumerate(site):
        if copies.setdefault(repr(page_), i) == i:
            for node in page_:
                visit(i, node, ())
    entropy = lambda xs: 1.0 if len(xs) < 2 else -sum(xs.count(x) / len(xs) * math.log(xs.count(x) / len(xs)) for x in set(xs)) / math.log(len(xs))
    score = {}
    for path, pages in held.items():
        shown, said = [tuple(a) for a, _ in pages.values()], [tuple(b) for _, b in pages.values()]
        fade = 0.9 ** len(set(shown))
        top = max((1 - fade) * entropy(shown) + fade * entropy(said), entropy(said))
        weight = threshold * least / (1 - threshold)
        score[path] = (weight + len(pages) * top) / (weight + len(pages))
    gone = {p for p in score if all(s <= threshold + 1e-9 for q, s in score.items() if q[: len(p)] == p)}

    def left(node, path):
        path = (*path, node[:2])
        if path in gone:
            return []
        return [node[2]] if isinstance(node[2], str) else [x for c in node[2] for x in left(c, path)]

    return ["\n".join(x for node in page_ for x in left(node, ())) for page_ in site], gone


def test_texts_brute_force(spark):
    rng = random.Random(31)
    site = random_site(rng, 120)
    site += [site[0]] * 30
    want, gone = brute_site(site)
    rows = [(i, f"https://r.example/{i}", "<article>" + "".join(map(markup, page_)) + "</article>") for i, page_ in enumerate(site)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in page_text.contract(pages).collect()}
    assert [got[i] for i in range(len(site))] == want
    assert {(("div", "wrap"),), (("div", "wrap"), ("ul", "")), (("div", "foot"),)} <= gone and (("div", "keep"),) not in gone


def test_deep_and_broken_pages_are_linear(spark):
    """Half a megabyte of nested containers, of tags that never close, of quotes that never close, of unmatched ends."""
    import time

    deep = "<article>" + "<div>" * 45_000 + "x" + "</div>" * 45_000 + "<p>y</p></article>"
    odd = [
        "<article><p>a</p>" + "<b>" * 60_000 + "<dt></dt>" * 30_000 + "</article>",
        "<article><p>a</p>" + "<a b='>'" * 60_000,
        "<article><p>a</p>" + "<a" * 250_000,
        "<article><p>a</p>" + "</b>" * 60_000 + "<b>" * 60_000 + "</i>" * 60_000,
        "<article><p>a</p><script>" + "</script " * 50_000,
        "<article><p>a</p>" + "<div class=x><section>" * 20_000 + "end",
    ]
    began = time.time()
    assert page_text.main_text(deep) == "x\ny"
    assert all(page_text.main_text(x).startswith("a") for x in odd)
    for x in odd:
        page_text.page_branches(x, "h")
    assert time.time() - began < 60
    pages = spark.createDataFrame([(0, "https://d.example/0", deep), (1, "https://d.example/1", "<article><div><p>q</p></div></article>")], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in page_text.contract(pages).collect()} == {0: "x\ny", 1: "q"}


def test_text_of_formulas_and_labels_stays():
    body = "<article><p>if <math><mi>a</mi><mo>=</mo><mi>b</mi></math> then <label>this</label> and <svg><text>that</text></svg></p><form><label>mail</label></form></article>"
    assert page_text.main_text(body) == "if a=b then this and that"
    assert page_text.main_text('<article><p>a <a title="5" tall">b</a> c <i title=\'d>e\'>f</i></p></article>') == "a b c f"


# -- pipeline -----------------------------------------------------------------------------------


def test_pipeline(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = read_table(spark, sf_dir, "documents")
    sizes, now = [], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf_dir)
        assert now.columns == docs.columns, name
        now = spark.createDataFrame(now.collect(), docs.schema)
        sizes.append(now.count())
    assert docs.count() > sizes[0] > sizes[1] >= sizes[2] <= sizes[3]
    last = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir)
    assert last.count() == sizes[3]
    ordered = last.orderBy("start").collect()
    assert all(a["start"] + a["n_tokens"] == b["start"] and a["doc_id"] <= b["doc_id"] for a, b in zip(ordered, ordered[1:], strict=False))
