"""Toxicity scores by nearest labelled examples.

Examples are labelled documents. Every word of every example is a term, and none is left out. A vector's
entry is (1 + log tf) * idf * rf ** FOCUS, scaled to unit length, so that cosine is a dot product. rf is the
relevance frequency log2(2 + odds) of supervised TF-IDF, odds being the term's share of the toxic examples
over its share of the clean ones (smoothed): a word of both classes keeps its plain TF-IDF weight, a word
that toxic examples prefer weighs more. With plain idf the many invented or rare words of a long text outweigh
its few insults (the README has the figures).

The inverted index keeps a term's postings by blocks of 64 examples, each with its largest weight. The sum of
these maxima bounds every cosine in a block. The blocks with the highest bounds are read first; of the others only
those are read whose bound reaches the k-th neighbour found so far. A skipped block's postings are never touched,
and the neighbours are exact. Terms of a tenth of the examples and more have no postings but a row of a matrix; their
part of all cosines is one product for a batch of texts and goes into the bounds as it is.

Votes are weighted by nearness and by what an example stands for in its class; a logistic curve, fitted on each
example's votes without itself, turns them into probabilities. Examples with the very text that is scored don't
vote, neither in fitting nor in scoring: a document does not look up its own label, and doc_id is no input.

The examples are a bounded sample of the labelled rows (max_toxic, max_clean, least hash of the id first), so
the index has a bounded number of rows and is broadcast; every document is scored, whole.

Defined results: null text is empty; ties between neighbours (cosines equal to 12 digits) go to the example with the
lesser id; a document that shares no word with any example (an empty one, say) has no evidence and the score of the
class prior; repeated rows are scored one by one; without usable labels every score is 0.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate, repeat

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrina.llm.common import give_back, map_rows, pack_row, scratch, texts_of, unpack_row

#: Every ASCII byte that is no letter or digit separates words; other bytes belong to words.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Examples in a block of the index, and blocks that are read first to find the bar for the others.
BLOCK, FIRST_BLOCKS = 64, 6
#: Power of the relevance frequency, and what smooths it: so many clean examples more.
FOCUS, SMOOTH = 2.0, 3.0
#: Terms in at least this share of the examples order them, so that alike examples share blocks.
COMMON_SHARE = 0.02
CACHE = 4_000
#: Terms in at least this share of the examples are rows of a matrix; texts that are multiplied with it at a time.
DENSE_SHARE, BATCH = 0.1, 64
ADDED = T.StructType(
    [
        T.StructField("score", T.DoubleType()),
        T.StructField("predicted", T.IntegerType()),
        T.StructField("evidence", T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("toxic", T.IntegerType())]))),
    ]
)


def split_words(text: str) -> list[bytes]:
    return text.lower().encode().translate(TABLE).split()


def text_key(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode())


def ranges(starts, ends):
    """start .. end-1 of each pair, one after the other."""
    import numpy as np

    sizes = ends - starts
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    steps = np.ones(total, np.int64)
    full = sizes > 0
    heads = np.cumsum(sizes[full])[:-1]
    steps[0] = starts[full][0]
    steps[heads] = starts[full][1:] - ends[full][:-1] + 1
    return np.cumsum(steps)


class Index:
    """Exact top-k cosine over unit vectors by block-max bounds.

    vectors: (terms ascending, weights) of each example as arrays. A term's entries are its blocks; an entry
    has the largest weight and the place of its postings. Terms that very many examples have are rows of a matrix
    instead: their part of all cosines is one product for a batch of texts, and a block's bound is its largest such part and the
    maxima of the other terms.
    """

    def __init__(self, vectors: list[tuple], n_terms: int, dense_share: float = DENSE_SHARE) -> None:
        import numpy as np

        self.n, self.n_blocks = len(vectors), -(-len(vectors) // BLOCK)
        terms = np.concatenate([v[0] for v in vectors]).astype(np.int32, copy=False) if vectors else np.zeros(0, np.int32)
        rows = np.repeat(np.arange(self.n, dtype=np.int32), [len(v[0]) for v in vectors])
        weights = np.concatenate([v[1] for v in vectors]) if vectors else np.zeros(0)
        often = np.flatnonzero(np.bincount(terms, minlength=n_terms) >= max(2.0, dense_share * self.n))
        self.column = np.full(n_terms, -1, np.int32)
        self.column[often] = np.arange(len(often))
        common = self.column[terms] >= 0
        self.common = (len(often), self.column[terms[common]], rows[common], weights[common])
        self._matrix = None
        terms, rows, weights = terms[~common], rows[~common], weights[~common]
        order = np.argsort(terms, kind="stable")  # rows ascend already
        terms, self.rows, self.weights = terms[order], rows[order], weights[order]
        del common, rows, weights, order
        blocks = self.rows // BLOCK
        new = np.ones(len(terms), bool)
        new[1:] = (terms[1:] != terms[:-1]) | (blocks[1:] != blocks[:-1])
        at = np.flatnonzero(new)
        self.entry_block = blocks[at].astype(np.int32)
        self.entry_max = np.maximum.reduceat(self.weights, at) if len(at) else np.zeros(0)
        self.entry_at = np.append(at, len(terms)).astype(np.int32)
        self.term_at = np.searchsorted(terms[at], np.arange(n_terms + 1)).astype(np.int32)

    @property
    def matrix(self):
        """Weights of common terms, a row a term; made where it is used, not sent."""
        import numpy as np

        if self._matrix is None:
            n, columns, rows, weights = self.common
            self._matrix = np.zeros((n, self.n_blocks * BLOCK))
            self._matrix[columns, rows] = weights
        return self._matrix

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_matrix": None}

    def common_parts(self, queries: list[tuple]):
        """The part of all cosines that the matrix holds, a row for each query (terms, weights)."""
        import numpy as np

        left = np.zeros((len(queries), len(self.matrix)))
        for i, (terms, weights) in enumerate(queries):
            columns = self.column[terms]
            left[i, columns[columns >= 0]] = weights[columns >= 0]
        return left @ self.matrix

    def top(self, terms, weights, k: int, without: frozenset[int] = frozenset(), part=None) -> list[tuple[float, int]]:
        """(cosine, example) of the k nearest examples with a positive cosine, best first; but for `without`."""
        import numpy as np

        if part is None:
            part = self.common_parts([(terms, weights)])[0]
        rare = self.column[terms] < 0
        terms, weights = terms[rare], weights[rare]
        starts, ends = self.term_at[terms], self.term_at[terms + 1]
        entries, own = ranges(starts, ends), np.repeat(weights, ends - starts)
        blocks = self.entry_block[entries]
        bounds = np.bincount(blocks, own * self.entry_max[entries], self.n_blocks) + part.reshape(-1, BLOCK).max(1, initial=0.0)
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        best: list[tuple[float, int]] = []
        for chosen in (order[:FIRST_BLOCKS], order[FIRST_BLOCKS:]):
            floor = -best[-1][0] if len(best) == k else 0.0
            chosen = chosen[bounds[chosen] >= floor - 1e-9]
            if not len(chosen):
                continue
            reads = np.zeros(self.n_blocks, bool)
            reads[chosen] = True
            read = np.flatnonzero(reads[blocks])
            some = entries[read]
            lo, hi = self.entry_at[some], self.entry_at[some + 1]
            places = ranges(lo, hi)
            rows = (chosen[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            scores = (np.bincount(self.rows[places], np.repeat(own[read], hi - lo) * self.weights[places], self.n_blocks * BLOCK) + part)[rows]
            if without:
                scores[np.isin(rows, list(without))] = 0.0
            if len(scores) > 4 * k:
                floor = max(floor, float(np.partition(scores, -k)[-k]))
            found = np.flatnonzero((scores >= floor - 1e-11) & (scores > 0))
            exact = np.round(scores[found], 12)
            best = sorted(best + [(-s, i) for s, i in zip(exact.tolist(), rows[found].tolist(), strict=True) if s > 0])[:k]
        return [(-s, i) for s, i in best]


class Model:
    """What scoring needs: term weights, index, labels, calibration. Its rows are bounded by the sample."""

    def __init__(self, examples: Iterable[tuple[int, int, int, bytes, bytes]], share: tuple[float, float], k: int, focus: float = FOCUS, smooth: float = SMOOTH) -> None:
        """examples: (id, toxic, text_key, different words joined by spaces, their counts as 4-byte integers), see word_counts();
        they are read once, and their words are not kept."""
        import numpy as np

        self.k = k
        number: dict[bytes, int] = {}
        known: list[tuple[int, int, int]] = []
        vectors: list[tuple] = []  # first of terms and counts
        for doc_id, toxic, key, own, counts in examples:
            known.append((doc_id, toxic, key))
            vectors.append((np.array([number.setdefault(w, len(number)) for w in own.split()], np.int32), np.frombuffer(counts, "<i4")))
        examples, n = known, len(known)
        self.number = number
        n_toxic = sum(x[1] for x in examples)
        n_clean = n - n_toxic
        a, c = np.zeros(len(number)), np.zeros(len(number))
        for (t, _), x in zip(vectors, examples, strict=True):
            (a if x[1] == 1 else c)[t] += 1  # a text's terms are different
        odds = (a / max(1, n_toxic)) / ((c + smooth) / max(1, n_clean))
        relevance = np.log2(2 + odds) ** focus
        self.weight = (np.log((1 + n) / (1 + a + c)) + 1) * relevance
        #: Of a word that no example has: it meets nothing, but counts in a text's length.
        self.unknown = math.log(1 + n) + 1
        for i, (t, counts) in enumerate(vectors):
            at = np.argsort(t)
            w = ((1 + np.log(counts.astype(float))) * self.weight[t])[at]
            vectors[i] = (t[at], w / math.sqrt(float((w * w).sum())) if len(w) else w)
        # similar examples side by side, so that whole blocks can be skipped: by the strongest of the common terms
        common = a + c >= max(2.0, COMMON_SHARE * n)
        lead = [int(t[best]) if len(t) and common[t[(best := int(np.argmax(w * common[t])))]] else -1 for t, w in vectors]
        order = sorted(range(n), key=lambda i: (lead[i], examples[i][0]))
        self.ids = [examples[i][0] for i in order]
        self.toxic = [examples[i][1] for i in order]
        self.same: dict[int, list[int]] = {}
        for at, i in enumerate(order):
            self.same.setdefault(examples[i][2], []).append(at)
        self.stands_for = [share[y] for y in self.toxic]
        total = sum(self.stands_for)
        self.prior = sum(w for w, y in zip(self.stands_for, self.toxic, strict=True) if y) / total if total else 0.0
        vectors = [vectors[i] for i in order]
        self.index = Index(vectors, len(number))
        give_back()
        self.curve = (1.0, 0.0)
        if 0 < n_toxic < n:
            self.curve = self._calibrate([self._votes(near) for near in self._neighbours([(*v, examples[i][2]) for v, i in zip(vectors, order, strict=True)])])
        self.cache: dict[int, tuple] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"number": b" ".join(self.number), "cache": {}}  # words hold no space

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state | {"number": {w: i for i, w in enumerate(state["number"].split())}})

    def vector(self, counts: dict[bytes, int]) -> tuple:
        """Known terms, ascending, and their weights in the unit vector of a text."""
        import numpy as np

        n = len(counts)
        ids = np.fromiter(map(self.number.get, counts, repeat(-1)), np.int64, n)
        tf = 1 + np.log(np.fromiter(counts.values(), float, n))
        known = ids >= 0
        strange = tf[~known] * self.unknown
        terms = ids[known]
        at = np.argsort(terms)
        terms = terms[at]
        weights = tf[known][at] * self.weight[terms] if n else tf
        square = float((weights * weights).sum() + (strange * strange).sum())
        return terms, weights / math.sqrt(square) if square else weights

    def _neighbours(self, queries: list[tuple]) -> Iterator[list[tuple[float, int]]]:
        """Nearest examples of another text for each (terms, weights, text_key): (cosine, row), ties by id."""
        for at in range(0, len(queries), BATCH):
            batch = queries[at : at + BATCH]
            for (terms, weights, key), part in zip(batch, self.index.common_parts([q[:2] for q in batch]), strict=True):
                without = frozenset(self.same.get(key, ()))
                near = self.index.top(terms, weights, self.k + TIES, without, part) if len(terms) else []
                if len(near) > self.k and near[self.k - 1][0] == near[-1][0]:  # more ties at the end than were asked for
                    near = self.index.top(terms, weights, self.index.n, without, part)
                yield sorted(near, key=lambda x: (-x[0], self.ids[x[1]]))[: self.k]

    def _votes(self, near: list[tuple[float, int]]) -> float:
        """Log odds of toxic votes; the class prior has a small vote of its own."""
        yes, total = 0.1 * self.prior, 0.1
        for s, i in near:
            w = self.stands_for[i] / (1.05 - s)
            total += w
            yes += w * self.toxic[i]
        p = min(max(yes / total, 1e-3), 1 - 1e-3)
        return math.log(p / (1 - p))

    def _calibrate(self, xs: list[float]) -> tuple[float, float]:
        """Slope and offset of the curve over log odds, by Newton's method."""
        a, b = 1.0, 0.0
        for _ in range(50):
            ga, gb, haa, hab, hbb = 1e-2 * (1 - a), -1e-3 * b, 1e-2, 0.0, 1e-3
            for x, y, w in zip(xs, self.toxic, self.stands_for, strict=True):
                p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a * x + b))))
                g, h = w * (y - p), w * p * (1 - p)
                ga, gb, haa, hab, hbb = ga + g * x, gb + g, haa + h * x * x, hab + h * x, hbb + h
            det = haa * hbb - hab * hab
            if det <= 1e-12:
                break
            da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
            step = min(1.0, 2.0 / max(abs(da), abs(db), 1e-9))
            a, b = a + step * da, b + step * db
            if max(abs(da), abs(db)) < 1e-8:
                break
        return max(a, 1e-3), b

    def score(self, texts: list[str]) -> list[tuple[float, list[tuple[float, int]]]]:
        """Probability and nearest examples of each text; equal texts are looked up once."""
        if not self.ids or not self.prior:
            return [(0.0, []) for _ in texts]
        keys = list(map(text_key, texts))
        if len(self.cache) >= CACHE:
            self.cache.clear()
        fresh = {key: text for key, text in zip(keys, texts, strict=True) if key not in self.cache}
        queries = [(*self.vector(Counter(split_words(text))), key) for key, text in fresh.items()]
        a, b = self.curve
        for (_, _, key), near in zip(queries, self._neighbours(queries), strict=True):
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a * self._votes(near) + b)))) if near else self.prior
            self.cache[key] = (p, near)
        return [self.cache[key] for key in keys]


#: Neighbours that are asked for beyond k, to order ties at the end by id.
TIES = 16


def count_words(text: str) -> tuple[bytes, bytes]:
    """A text's different words, joined by spaces, and their counts as 4-byte integers."""
    import struct

    found = Counter(split_words(text))
    return b" ".join(found), struct.pack(f"<{len(found)}i", *found.values())


def word_counts(examples: DataFrame) -> DataFrame:
    """doc_id, toxic, key (of the text), words, counts of each example."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = list(texts_of(batch, "text"))
            found = [count_words(t) for t in texts]
            arrays = [batch.column(0), batch.column(1), pa.array([text_key(t) - (1 << 63) for t in texts], pa.int64()), pa.array([w for w, _ in found], pa.binary()), pa.array([c for _, c in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "toxic", "key", "words", "counts"])

    return examples.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, key long, words binary, counts binary")


def fit(docs: DataFrame, labels: DataFrame, *, max_toxic: int = 2000, max_clean: int = 4000, k: int = 15) -> Model:
    """docs (doc_id, text) and labels (doc_id, toxic 0 or 1), all of which may be learned from.

    At most max_toxic + max_clean examples reach the driver, as word counts; all their words are terms.
    """
    one = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    one = scratch(one.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"), "labels")
    of_class = {r["toxic"]: r["count"] for r in one.groupBy("toxic").count().collect()}
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    sample = one.filter("toxic = 1").orderBy(*order).limit(max_toxic).unionByName(one.filter("toxic = 0").orderBy(*order).limit(max_clean))
    sample = F.broadcast(sample)  # at most max_toxic + max_clean rows
    examples = docs.select("doc_id", "text").join(sample, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = word_counts(examples).collect()
    rows.sort(key=lambda r: r["doc_id"], reverse=True)  # different ids
    n = Counter(r["toxic"] for r in rows)
    share = (of_class.get(0, 0) / max(1, n[0]), of_class.get(1, 0) / max(1, n[1]))

    def taken() -> Iterator[tuple]:
        while rows:  # a row goes when it has been read
            r = rows.pop()
            yield r["doc_id"], r["toxic"], r["key"] + (1 << 63), bytes(r["words"]), bytes(r["counts"])

    return Model(taken(), share, k)


def fit_shared(docs: DataFrame, labels: DataFrame, **options) -> Broadcast:
    """fit() as a broadcast variable. The driver keeps no model, and no memory that fitting took."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **options))
    give_back()
    return shared


def score(docs: DataFrame, model: Model | Broadcast, *, text_col: str = "text", threshold: float = 0.3, evidence: bool = True) -> DataFrame:
    """docs with score, predicted and evidence (the nearest examples; left out if they are not wanted)."""
    shared = docs.sparkSession.sparkContext.broadcast(model) if isinstance(model, Model) else model

    def make():
        own = shared.value

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            found, texts = [], []
            for text in texts_of(batch, text_col):
                texts.append(text)
                if len(texts) == BATCH:
                    found += own.score(texts)
                    texts = []
            found += own.score(texts)
            out = [pa.array([x for x, _ in found], pa.float64()), pa.array([int(x >= threshold) for x, _ in found], pa.int32())]
            if evidence:
                near = [x for _, own_near in found for x in own_near]
                parts = [pa.array([own.ids[i] for _, i in near], pa.int64()), pa.array([x for x, _ in near], pa.float64()), pa.array([own.toxic[i] for _, i in near], pa.int32())]
                ends = list(accumulate((len(x) for _, x in found), initial=0))
                out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, ["doc_id", "similarity", "toxic"])))
            return out

        return work

    return map_rows(docs, ADDED if evidence else T.StructType(ADDED.fields[:2]), make)


def held_out(doc_id: Column) -> Column:
    """The fold that labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def contract(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What op2 returns."""
    texts = docs.select("doc_id", "text")
    model = fit_shared(texts, labels.select("doc_id", "toxic").filter(~held_out(F.col("doc_id"))))
    return score(texts, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those predicted toxic; their own columns only."""
    model = fit_shared(docs, labels.select("doc_id", "toxic").filter(~held_out(F.col("doc_id"))))
    # scored beside the text under names of this operator's own, so that no column of docs is lost
    return unpack_row(score(pack_row(docs, "text"), model, evidence=False).filter("predicted = 0"), docs.columns, "text")
