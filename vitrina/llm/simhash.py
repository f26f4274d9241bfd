"""SimHash near-duplicates: fingerprints, a byte-position inverted index with count filtering, components.

A 64-bit fingerprint has 8 bytes at fixed positions. Two fingerprints that differ in at most 4
bits share at least 4 positional bytes (the guaranteed minimum). The inverted index therefore
needs no posting list of a single byte, whose lists would make nearly all pairs: its postings are
keyed by three positional bytes at once, over 20 position triples chosen so that every four
positions contain one of them (a Turan system). A pair that meets in a posting is tallied (positional
bytes shared), kept from the minimum on, only in the first triple that it shares, and verified by
its Hamming distance; all that is part of the join's condition, so only links leave it.

Equal fingerprints are collapsed before the index; they and their documents are never paired. Near copies are not
paired with each other either. First each member of a posting is compared with the posting's least and
greatest fingerprint; the verified links make components. Then only postings that hold several components are read
again, and in them only pairs of different components, one of them outside the component of the
posting's least fingerprint. Every link between different components is found, so the components are exact, and a dense
group of m near copies costs about m comparisons a posting, not m * m. Frequent keys (postings,
fingerprints, components) are split off their joins.

Defined results: texts without words have fingerprint 0 and are linked like any other; null text is
empty; repeated rows and equal texts are one fingerprint; a null doc_id gets its component's least
known id (null if there is none); an empty table has no components; columns beside id and text never matter.
"""

from __future__ import annotations

from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrina.llm.common import bytes_of, join_unique, map_rows, quoted, scratch
from vitrina.llm.components import components

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BITS, BYTES = 64, 8


def position_triples() -> list[tuple[int, ...]]:
    """Triples of the 8 positions, one of which lies in any 4 positions: with the positions dealt
    to three classes in a ring, those inside a class, and two of a class with one of the next."""
    ring = [p % 3 for p in range(BYTES)]

    def chosen(triple: tuple[int, ...]) -> bool:
        classes = sorted(ring[p] for p in triple)
        if len(set(classes)) == 1:
            return True
        twice = next((c for c in classes if classes.count(c) == 2), None)
        return twice is not None and (twice + 1) % 3 in classes

    return [t for t in combinations(range(BYTES), 3) if chosen(t)]


def first_triple(triples: list[tuple[int, ...]]) -> list[int]:
    """For each set of equal positions (a mask): the first triple inside it, -1 if none."""
    masks = [sum(1 << p for p in t) for t in triples]
    return [next((i for i, m in enumerate(masks) if m & mask == m), -1) for mask in range(1 << BYTES)]


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """Bits set in over half of the shingles' XXH64 values, repeats included."""
    import numpy as np
    import xxhash

    words = text.translate(LOWER).split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(flat, seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(flat[i:k], seed) for i, k in zip(starts, ends[shingle - 1 :].tolist(), strict=False)])
    n = len(hashes) // BYTES
    offset, bits = _tables()
    counts = np.bincount((np.frombuffer(hashes, np.uint8).reshape(n, BYTES) + offset).ravel(), minlength=BYTES * 256)
    over = 2 * (counts.reshape(BYTES, 256) @ bits) > n
    return int.from_bytes(np.packbits(over.ravel()).tobytes(), "big")


_cached: list = []


def _tables():
    if not _cached:
        import numpy as np

        _cached.append((np.arange(BYTES, dtype=np.int64) * 256, np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)))
    return _cached[0]


def fingerprints(docs: DataFrame, *, text_col: str = "text", shingle: int = 4) -> DataFrame:
    """docs with fp, the fingerprint as a signed long."""

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            out = [fingerprint(t, shingle) for t in bytes_of(batch, text_col)]
            return [pa.array([x - (1 << BITS) if x >> (BITS - 1) else x for x in out], pa.int64())]

        return work

    return map_rows(docs, T.StructType([T.StructField("fp", T.LongType())]), make)


def _byte(fp: Column, p: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255))


def postings(fps: DataFrame) -> DataFrame:
    """key (a triple and its three bytes) and all columns of fps (fp, ...) once for each triple."""
    keys = F.array(*[_byte(F.col("fp"), t[0]).bitwiseOR(F.shiftleft(_byte(F.col("fp"), t[1]), 8)).bitwiseOR(F.shiftleft(_byte(F.col("fp"), t[2]), 16)).bitwiseOR(F.lit(i << 24).cast("long")) for i, t in enumerate(position_triples())])
    return fps.select("*", F.explode(keys).alias("key"))


def _differ(a: str, b: str) -> Column:
    return F.col(a).bitwiseXOR(F.col(b))


def representative_links(posted: DataFrame, max_bits: int) -> DataFrame:
    """Links (a, b) of the members of each posting (fp, key) with its least and greatest one."""
    per_key = scratch(posted.groupBy("key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.count("*").alias("n")).filter("n > 1"), "simhash-postings")
    met = join_unique(posted, per_key.select("key", "lo", "hi"), "key", counted=per_key.select("key", "n"), grows=True)
    ends = met.select("fp", F.explode(F.array("lo", "hi")).alias("end")).filter((F.col("fp") != F.col("end")) & (F.bit_count(_differ("fp", "end")) <= max_bits))
    return ends.select(F.least("fp", "end").alias("a"), F.greatest("fp", "end").alias("b")).distinct()


def crossing_links(posted: DataFrame, max_bits: int) -> DataFrame:
    """Links (a, b) between different components of the members (fp, component, key) of each posting."""
    span = posted.groupBy("key").agg(F.min(F.struct("fp", "component")).alias("m"), F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("n"))
    mixed = scratch(span.filter("c0 <> c1").select("key", F.col("m.component").alias("main"), "n"), "simhash-mixed")
    members = scratch(join_unique(posted, mixed.select("key", "main"), "key", counted=mixed.select("key", "n"), grows=True), "simhash-members")
    left = members.filter("component <> main").select(F.col("fp").alias("a"), F.col("component").alias("of_a"), "key")
    right = members.select(F.col("fp").alias("b"), F.col("component").alias("of_b"), F.col("key").alias("other"), (F.col("component") == F.col("main")).alias("in_main"))
    differ = _differ("a", "b")
    shared = sum((F.when(_byte(differ, p) == 0, F.lit(1 << p)).otherwise(F.lit(0)) for p in range(1, BYTES)), F.when(_byte(differ, 0) == 0, F.lit(1)).otherwise(F.lit(0)))
    first = F.element_at(F.array(*map(F.lit, first_triple(position_triples()))), shared + 1)
    on = (
        (F.col("key") == F.col("other"))
        & (F.col("of_a") != F.col("of_b"))
        & (F.col("in_main") | (F.col("a") < F.col("b")))
        & (F.bit_count(shared) >= BYTES - max_bits)  # the tally of shared positional bytes
        & (first == F.shiftright("key", 24).cast("int"))  # a pair counts in one posting only
        & (F.bit_count(differ) <= max_bits)  # verified
    )
    return left.join(right, on).select("a", "b")


def linked_components(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """fp, component (the least fingerprint reachable by links of at most max_bits differing bits) of distinct fingerprints
    fps (fp); only of those that have a link."""
    if not 0 <= max_bits <= 4:
        raise ValueError("the index guarantees pairs of up to 4 differing bits")
    near = components(representative_links(postings(fps.select("fp")), max_bits)).select(F.col("node").alias("fp"), "component")
    near = scratch(near, "simhash-near")
    labelled = scratch(join_unique(fps.select("fp"), near, "fp", "left", counted=fps.select("fp", F.lit(1).alias("n")), grows=True).select("fp", F.coalesce("component", "fp").alias("component")), "simhash-labelled")
    crossing = scratch(crossing_links(postings(labelled), max_bits), "simhash-links")
    if crossing.isEmpty():
        return near
    # components of components
    ends = crossing.join(labelled.select(F.col("fp").alias("a"), F.col("component").alias("x")), "a").join(labelled.select(F.col("fp").alias("b"), F.col("component").alias("y")), "b")
    joined = scratch(components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("whole")), "simhash-joined")
    of_whole = join_unique(labelled, joined, "component", "left", grows=True)
    return of_whole.filter("whole is not null or component <> fp").select("fp", F.coalesce("whole", "component").alias("component")).unionByName(near.filter("fp = component").join(joined, "component", "left_anti").select("fp", "component"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 4, shingle: int = 4) -> DataFrame:
    """doc_id, fp, component_id, class_size (rows with that fingerprint); one row for each row of docs."""
    marked = scratch(fingerprints(docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text")), shingle=shingle).select("doc_id", "fp"), "simhash")
    classes = scratch(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("class_size")), "simhash-classes")
    linked = scratch(linked_components(classes, max_bits), "simhash-linked")
    one_each = classes.select("fp", F.lit(1).alias("n"))
    whole = scratch(join_unique(classes, linked, "fp", "left", counted=one_each, grows=True).select("fp", "least", "class_size", F.coalesce("component", "fp").alias("component")), "simhash-whole")
    ends = scratch(whole.groupBy("component").agg(F.min("least").alias("component_id")), "simhash-ends")
    named = scratch(join_unique(whole, ends, "component", grows=True).select("fp", "component_id", "class_size"), "simhash-named")
    return join_unique(marked, named, "fp", counted=classes.select("fp", F.col("class_size").alias("n")), grows=True).select("doc_id", "fp", "component_id", "class_size")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without near-duplicates: of each component the document with the least id stays; rows
    that repeat this id are one document, of which the least row stays (columns compared in order, maps left out). Rows
    without an id stay."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    kept = scratch(found.filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")), "simhash-kept")
    kinds = dict(docs.dtypes)
    packed = docs.select(quoted(id_col).alias("doc_id"), F.struct(F.lit(0).alias("_"), *[quoted(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("whole"))
    both = packed.join(kept.filter("n = 1").hint("merge"), "doc_id", "left_semi").select("whole").unionByName(packed.filter("doc_id is null").select("whole"))
    repeated = kept.filter("n > 1")
    if not repeated.isEmpty():
        own = [F.col(f"whole.c{i}") for i, c in enumerate(docs.columns) if c != id_col and "map<" not in kinds[c]]
        again = join_unique(packed, repeated.select("doc_id", F.lit(1).alias("one")), "doc_id", counted=repeated, grows=True)
        both = both.unionByName(again.groupBy("doc_id").agg(F.min_by("whole", F.struct(F.lit(0).alias("_"), *own)).alias("whole")).select("whole"))
    return both.select(*[F.col(f"whole.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def contract(docs: DataFrame) -> DataFrame:
    """The digest that op5 returns."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
