"""Benchmark decontamination by a generalised suffix automaton.

The words of all benchmark items go into one automaton (no path crosses two items). Training
texts are streamed through it word by word; the automaton's state gives the longest suffix read
so far that occurs in any item, so every occurrence of a 13-word window (or of a whole shorter
item) is found in one pass over the words, whatever the number of items.

The automaton grows with the benchmark, not with the corpus: its size is measured before anything is
collected. A benchmark of more than `max_item_words` words is dealt into blocks of items by hash, each with an automaton of its
own; texts pass through one after the other, only documents with hits leave a pass, and their spans and items are merged.

Defined results: a null or empty text has no words and is clean; items without words match
nothing; repeated items and repeated item ids count once; repeated documents are judged one by
one; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrina.llm.common import bytes_of, map_rows, quoted, scratch

#: Words are runs of a-z (after lower-casing A-Z), digits and all non-ASCII characters. On UTF-8
#: bytes that is one table: every other ASCII byte becomes a space, so that split() finds the words.
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
ADDED = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("contaminated", T.BooleanType()),
    ]
)


def split_words(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


class SuffixAutomaton:
    """Generalised suffix automaton over words, with the items that contain each state."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.len = [0]
        paths = [(item, words) for item, words in items if words]
        for _, words in paths:
            last = 0
            for word in words:
                last = self._extend(last, word)
        n = len(self.next)
        #: Items that contain a state's longest string; filled along suffix links.
        self.items: list[set[str]] = [set() for _ in range(n)]
        whole: dict[int, set[str]] = {}
        for item, words in paths:
            state = 0
            for word in words:
                state = self.next[state][word]
                up = state
                while up > 0 and item not in self.items[up]:
                    self.items[up].add(item)
                    up = self.link[up]
            if len(words) < window:
                whole.setdefault(state, set()).add(item)
        #: For a match that ends in a state: the ancestor that holds its last `window` words, and
        #: the ancestors that are whole short items. A short item is its state's longest string,
        #: since it also stands at an item's start, where nothing precedes it.
        self.full = [-1] * n
        self.short: list[tuple[int, ...]] = [()] * n
        for state in sorted(range(1, n), key=self.len.__getitem__):
            up = self.link[state]
            if self.len[state] >= window:
                self.full[state] = self.full[up] if self.len[up] >= window else state
            self.short[state] = ((state,) if state in whole else ()) + self.short[up]
        self.whole = whole

    def _clone(self, p: int, q: int, word: bytes) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.len.append(self.len[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: bytes) -> int:
        q = self.next[last].get(word)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, q, word)
        new = len(self.next)
        self.next.append({})
        self.len.append(self.len[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._clone(p, q, word)
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans [from, to) of words inside occurrences of windows, and the items that own these windows."""
        step, link, length, full, short, window = self.next, self.link, self.len, self.full, self.short, self.window
        root, state, matched = step[0], 0, 0
        spans: list[tuple[int, int]] = []
        states: set[int] = set()
        wholes: set[int] = set()
        for i, word in enumerate(words):
            if state:
                to = step[state].get(word)
                while to is None and state:
                    state = link[state]
                    matched = length[state]
                    to = step[state].get(word)
            else:
                to = root.get(word)
            if to is None:
                matched = 0
                continue
            state = to
            matched += 1
            reach = 0
            if matched >= window:
                states.add(full[state])
                reach = window
            if short[state]:
                for s in short[state]:
                    if length[s] <= matched:
                        wholes.add(s)
                        reach = max(reach, length[s])
            if reach:
                spans.append((i + 1 - reach, i + 1))
        items: set[str] = set()
        for s in states:
            items |= self.items[s]
        for s in wholes:
            items |= self.whole[s]
        return merge_spans(spans), items


def load_items(benchmark: DataFrame, item_col: str, text_col: str, max_item_words: int) -> list[DataFrame]:
    """The benchmark's items (item, text) in blocks that fit one process each; one block unless it is very large."""
    rows = benchmark.select(quoted(item_col).cast("string").alias("item"), F.coalesce(quoted(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    n = max(1, -(-size // (8 * max_item_words)))
    return [rows] if n == 1 else [rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i) for i in range(n)]


def _share(block: DataFrame):
    """An automaton's items as a broadcast variable with a name of its own."""
    items = [(r["item"] or "", split_words(r["text"].encode())) for r in block.distinct().collect()]  # at most a block
    return block.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, items))


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    coverage: float = 0.05,
    max_item_words: int = 5_000_000,
) -> DataFrame:
    """docs with n_words, n_hit, items (ids that own a window found), spans (merged [from, to) in
    words) and contaminated (some word is hit, and hits are at least `coverage` of the words)."""
    blocks = load_items(benchmark, item_col, item_text_col, max_item_words)
    per = round(1 / coverage, 9) if coverage else 0

    def told(found: list[tuple[int, list[tuple[int, int]], list[str]]]) -> list[pa.Array]:
        """The added columns out of words, merged spans and items of each text."""
        hits = [sum(b - a for a, b in spans) for _, spans, _ in found]
        return [
            pa.array([n for n, _, _ in found], pa.int64()),
            pa.array(hits, pa.int64()),
            pa.array([items for _, _, items in found], pa.list_(pa.string())),
            pa.array([[list(x) for x in spans] for _, spans, _ in found], pa.list_(pa.list_(pa.int64()))),
            pa.array([hit > 0 and (not per or per * hit >= n) for (n, _, _), hit in zip(found, hits, strict=True)], pa.bool_()),
        ]

    if len(blocks) == 1:
        shared = _share(blocks[0])

        def make():
            automaton = _automaton(shared, window)

            def work(batch: pa.RecordBatch) -> list[pa.Array]:
                found = []
                for text in bytes_of(batch, text_col):
                    words = split_words(text)
                    spans, owners = automaton.scan(words)
                    found.append((len(words), spans, sorted(owners)))
                return told(found)

            return work

        return map_rows(docs, ADDED, make)

    # the operator's own names stand beside one struct of all columns
    packed = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(F.lit(0).alias("_"), *[quoted(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("whole"), quoted(text_col).alias("text"))
    rows = scratch(packed, "decontaminate")
    passes = [scratch(_hits(rows.select("row", "text"), _share(block), window), "decontaminate-hits") for block in blocks]
    hits = scratch(reduce(DataFrame.unionByName, passes).groupBy("row").agg(F.collect_list(F.struct("spans", "items")).alias("parts")), "decontaminate-parts")  # one for each block

    def merge():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            parts = batch.column(batch.schema.get_field_index("parts")).to_pylist()
            found = []
            for text, own in zip(bytes_of(batch, "text"), parts, strict=True):
                spans = merge_spans([tuple(x) for p in own or [] for x in p["spans"]])
                found.append((len(split_words(text)), spans, sorted({x for p in own or [] for x in p["items"]})))
            return told(found)

        return work

    judged = map_rows(rows.join(hits, "row", "left"), ADDED, merge)
    added = {f.name for f in ADDED.fields}
    return judged.select(*[F.col(f"whole.c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in added], *ADDED.names)


def _hits(rows: DataFrame, shared, window: int) -> DataFrame:
    """row, spans, items of the texts (row, text) in which one block of items is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(shared, window)
        for batch in batches:
            found = [(i, *automaton.scan(split_words(text))) for i, text in enumerate(bytes_of(batch, "text"))]
            hit = [(i, spans, items) for i, spans, items in found if spans]
            keys = batch.column(0).take(pa.array([i for i, _, _ in hit], pa.int64()))
            arrays = [keys, pa.array([[list(x) for x in spans] for _, spans, _ in hit], pa.list_(pa.list_(pa.int64()))), pa.array([sorted(items) for _, _, items in hit], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "spans", "items"])

    return rows.mapInArrow(run, "row long, spans array<array<long>>, items array<string>")


_built: dict = {}


def _automaton(shared, window: int) -> SuffixAutomaton:
    """One automaton for each Python worker and broadcast, reused by its later tasks."""
    name, items = shared.value
    if (name, window) not in _built:
        _built.clear()
        _built[name, window] = SuffixAutomaton(items, window)
    return _built[name, window]


def remove_spans(docs: DataFrame, *, text_col: str = "text", max_words: int = 50) -> DataFrame:
    """Cut spans of more than max_words hit words out of texts that decontaminate() has judged and kept.

    Input: decontaminate()'s output. Texts without such a span stay byte for byte.
    """

    def cut(batches):
        for batch in batches:
            spans = batch.column(batch.schema.get_field_index("spans")).to_pylist()
            if not any(b - a > max_words for found in spans for a, b in found or []):
                yield batch
                continue
            out = []
            for text, found in zip(batch.column(batch.schema.get_field_index(text_col)).to_pylist(), spans, strict=True):
                long = [x for x in found or [] if x[1] - x[0] > max_words]
                if long:
                    raw = text.encode()
                    at = [m.span() for m in WORD.finditer(raw)]
                    for a, b in reversed(long):
                        raw = raw[: at[a][0]] + raw[at[b - 1][1] :]
                    text = raw.decode()
                out.append(text)
            arrays = [pa.array(out, f.type) if f.name == text_col else batch.column(i) for i, f in enumerate(batch.schema)]
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)  # as batches without a cut have it: a task writes one schema

    return docs.mapInArrow(cut, docs.schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", max_words: int = 50, **options) -> DataFrame:
    """docs without contaminated documents; spans of more than max_words hit words are cut out of the
    others, whose n_chars (if there is one) follows. Texts without such a span stay as they are."""
    others = [c for c in docs.columns if c != text_col]
    row = F.struct(F.lit(0).alias("_"), *[quoted(c).alias(f"c{i}") for i, c in enumerate(others)])
    judged = decontaminate(docs.select(row.alias("row"), quoted(text_col).alias("text")), benchmark, **options)
    kept = remove_spans(judged.filter(~F.col("contaminated")).select("row", "text", "spans"), max_words=max_words)
    own = {c: F.col(f"row.c{i}") for i, c in enumerate(others)} | {text_col: F.col("text")}
    if "n_chars" in others:
        cut = F.exists("spans", lambda x: x[1] - x[0] > max_words)
        own["n_chars"] = F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(own["n_chars"])
    return kept.select(*[own[c].alias(c) for c in docs.columns])


def contract(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest that op4 returns."""
    found = decontaminate(docs.select("doc_id", "text"), benchmark.select("item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated")
