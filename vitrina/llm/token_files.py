"""Token-id shards: canonical length-limited Huffman codes, decoded by table in independent blocks.

Writing takes three passes over the corpus. Texts are encoded once into a scratch table of ids;
global counts (vocabulary-sized) give the code lengths by package-merge; then ids are range-sorted
by doc_id and each task packs its sorted rows into shards.

A shard is one binary value: a header, doc ids, tokens per document, one bit offset for each block
of BLOCK ids (the checkpoints), and the bit stream. Any block is decoded from its checkpoint alone,
so a shard's blocks are decoded side by side, one table look-up for all of them at a time. Shards are
rows (part, seq, payload) of a Parquet table, with the code lengths in a table beside it: only
Spark's readers and writers touch files, so the folder may be on any file system.

Defined results: a null text is empty and holds the end id only; equal doc_ids are ordered by a hash of their
ids, so very many rows of one id are dealt to many tasks; a null doc_id comes first; a document of any length is whole (a shard takes at least
one document); an empty table writes no shard and reads back empty.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrina.llm.common import give_back, scratch, shared_dir, texts_of

MAGIC = b"VTK1"
#: Ids in a block: a checkpoint's 4 bytes are shared by so many ids.
BLOCK = 256
#: Longest code in bits; the decoding table has 2 ** MAX_BITS entries.
MAX_BITS = 18
#: Ids in a shard, and in what one task writes.
SHARD_TOKENS, PART_TOKENS = 1 << 18, 1 << 22
#: Chunks of text whose ids a worker keeps, some 200 bytes each; the cache is cleared when full.
CACHE_CHUNKS = 300_000
#: A single space or line feed between two of these visible characters always starts or is a
#: token of its own in the byte-level split, so a text may be cut there without changing its ids.
SAFE = "!-~¡-¬®-ɏ"
SPACE_CUT = re.compile(f"(?<=[{SAFE}])(?= [{SAFE}])")
LINE_CUT = re.compile(f"(?<=[{SAFE}])(\n)(?=[{SAFE}])")
#: Texts of these characters, spaces and line feeds only are split here by the byte-level pattern
#: itself, since every regex engine agrees on their classes; others are cut as above.
PLAIN = re.compile(f"[{SAFE} \n]*")
LETTER, NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
#: Letters come first, since that is the commonest case; no contraction begins with one.
PRETOKEN = re.compile(rf" ?[{LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{NUMBER}]+| ?[^\s{LETTER}{NUMBER}]+|\s+(?!\S)|\s+")


# -- encoding texts ---------------------------------------------------------------------------


def byte_characters() -> dict[int, str]:
    """The character that stands for a byte in byte-level vocabularies: itself if it is visible, else the next one from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in visible]
    return {b: chr(b) if b in visible else chr(256 + others.index(b)) for b in range(256)}


class Pretokens(dict):
    """Ids of a piece of the byte-level split, as bytes; the library's model is asked once for each."""

    def __init__(self, model, width: str) -> None:
        super().__init__()
        self.model, self.width, self.characters = model, width, byte_characters()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_CHUNKS:
            self.clear()
        mapped = piece.encode().decode("latin-1").translate(self.characters)
        ids = [t.id for t in self.model.tokenize(mapped)]
        self[piece] = found = struct.pack(f"<{len(ids)}{self.width}", *ids)
        return found


class Encoder:
    """Ids of whole texts as bytes, by the tokenizers library; pieces of text met before come from a cache."""

    def __init__(self, tokenizer_json: str, dtype: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.dtype = dtype
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache: dict[str, bytes] = {}
        rules = json.loads(tokenizer_json)
        split = rules.get("pre_tokenizer") or {}
        self.byte_level = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        self.byte_level = self.byte_level and rules.get("normalizer") is None and rules.get("truncation") is None
        self.pretokens = Pretokens(self.tokenizer.model, "H" if dtype == "<u2" else "I")

    def _bytes(self, ids: list[int]) -> bytes:
        import numpy as np

        return np.array(ids, self.dtype).tobytes()

    def whole(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def cut(self, text: str) -> list[str]:
        return [chunk for line in LINE_CUT.split(text) for chunk in SPACE_CUT.split(line)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Texts of a byte-level tokenizer go piece by piece through the cache; one that holds a special token's string goes whole."""
        get, out = self.pretokens.__getitem__, []
        odd: list[int] = []
        for i, text in enumerate(texts):
            if not self.byte_level or any(s in text for s in self.special):
                out.append(self.whole(text))
            elif PLAIN.fullmatch(text):
                out.append(b"".join(map(get, PRETOKEN.findall(text))))
            else:
                odd.append(i)
                out.append(b"")
        for i, ids in zip(odd, self._by_chunks([texts[i] for i in odd]), strict=True):
            out[i] = ids
        return out

    def _by_chunks(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        cuts = [self.cut(t) for t in texts]
        fresh = {c for chunks in cuts for c in chunks if c not in self.cache}
        if len(self.cache) + len(fresh) > CACHE_CHUNKS:
            self.cache = {}
            fresh = {c for chunks in cuts for c in chunks}
        new = list(fresh)
        for i in range(0, len(new), 10_000):
            part = new[i : i + 10_000]
            for chunk, found in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.cache[chunk] = np.array(found.ids, self.dtype).tobytes()
        get = self.cache.__getitem__
        return [b"".join(map(get, chunks)) for chunks in cuts]


_encoders: dict = {}


def _encoder(tokenizer_json: str, dtype: str) -> Encoder:
    """One for each Python worker, so that later tasks find a filled cache."""
    key = (zlib.crc32(tokenizer_json.encode()), len(tokenizer_json), dtype)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(tokenizer_json, dtype)
    return _encoders[key]


def encode(docs: DataFrame, tokenizer_json: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """doc_id, ids (little-endian, as wide as the vocabulary needs) with the end id, one row for each row of docs."""
    dtype = id_type(tokenizer_json)
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encoder = _encoder(shared.value, dtype)
        end = np.array([end_id], dtype).tobytes()
        for batch in batches:
            keys = batch.column(0)
            texts: list[str] = []
            at = size = 0

            def flush():
                ids = [x + end for x in encoder.encode(texts)]
                return pa.RecordBatch.from_arrays([keys.slice(at, len(texts)), pa.array(ids, pa.binary())], ["doc_id", "ids"])

            for text in texts_of(batch, "text"):
                texts.append(text)
                size += len(text)
                if size > 4_000_000:
                    yield flush()
                    at, size, texts = at + len(texts), 0, []
            if texts:
                yield flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def id_type(tokenizer_json: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_str(tokenizer_json).get_vocab_size() <= 1 << 16 else "<u4"


# -- the code ---------------------------------------------------------------------------------


def code_lengths(counts, max_bits: int = MAX_BITS):
    """Lengths of an optimal prefix code with none longer than max_bits (package-merge); counts are positive."""
    import numpy as np

    counts = np.asarray(counts, np.float64)
    n = len(counts)
    if n > 1 << max_bits:
        raise ValueError(f"{n} ids do not fit codes of {max_bits} bits")
    if n < 2:
        return np.ones(n, np.int64)
    order = np.argsort(counts, kind="stable")
    leaves = counts[order]
    levels = [np.zeros(n, bool)]  # which items of a level are packages
    items = leaves
    for _ in range(max_bits - 1):
        packages = items[: len(items) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate([leaves, packages])
        place = np.argsort(merged, kind="stable")
        items = merged[place]
        levels.append(place >= n)
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for packages in reversed(levels):
        used = int(packages[:take].sum())
        lengths[: take - used] += 1
        take = 2 * used
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


def canonical_codes(ids, lengths):
    """Codes in order of (length, id): the lengths alone restore them."""
    import numpy as np

    ids, lengths = np.asarray(ids, np.int64), np.asarray(lengths, np.int64)
    order = np.lexsort((ids, lengths))
    codes = np.zeros(len(ids), np.int64)
    if len(ids):
        sized = lengths[order]
        top = int(sized[-1])
        room = np.left_shift(1, top - sized)  # what each code takes of the longest codes' space
        codes[order] = (np.cumsum(room) - room) >> (top - sized)
    return codes


class Code:
    def __init__(self, ids: list[int], lengths: list[int]) -> None:
        import numpy as np

        self.ids, self.lengths = np.asarray(ids, np.int64), np.asarray(lengths, np.int64)
        self.codes = canonical_codes(self.ids, self.lengths)
        size = int(self.ids.max()) + 1 if len(self.ids) else 1
        self.code_of, self.length_of = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.code_of[self.ids], self.length_of[self.ids] = self.codes, self.lengths
        self._table = None

    @property
    def table(self):
        """For each MAX_BITS bits: id << 5 | length of the code that they begin with."""
        import numpy as np

        if self._table is None:
            table = np.zeros(1 << MAX_BITS, np.int64)
            order = np.lexsort((self.ids, self.lengths))
            filled = np.repeat(self.ids[order] << 5 | self.lengths[order], np.left_shift(1, MAX_BITS - self.lengths[order]))
            table[: len(filled)] = filled
            self._table = table
        return self._table

    def pack(self, ids) -> tuple[bytes, list[int]]:
        """Bit stream (first bit highest) and the bit offset of each block."""
        import numpy as np

        lengths = self.length_of[ids]
        ends = np.cumsum(lengths)
        starts = ends - lengths
        total = int(ends[-1]) if len(ends) else 0
        word, shift = starts >> 5, 64 - (starts & 31) - lengths
        placed = self.code_of[ids] << shift.astype(np.uint64)
        n = (total >> 5) + 2
        # disjoint bits: sums below 2 ** 32 are exact in doubles
        acc = np.bincount(word, (placed >> np.uint64(32)).astype(np.float64), n) + np.bincount(word + 1, (placed & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
        return acc.astype(np.uint32).astype(">u4").tobytes()[: (total + 7) // 8], starts[::BLOCK]

    def unpack(self, stream: bytes, offsets, n: int):
        """The n ids of a stream; all blocks advance together, one id of each at a time."""
        import numpy as np

        raw = np.frombuffer(stream + bytes(BLOCK * MAX_BITS // 8 + 8), np.uint8).astype(np.int64)
        bits = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]  # the 32 bits from each byte on
        at = np.asarray(offsets, np.int64).copy()
        out = np.empty((BLOCK, len(at)), np.int64)
        table, mask, down = self.table, (1 << MAX_BITS) - 1, 32 - MAX_BITS
        for i in range(min(BLOCK, n)):
            found = table[bits[at >> 3] >> (down - (at & 7)) & mask]
            out[i] = found >> 5
            at += found & 31
        return out.T.ravel()[:n] if len(at) else out.ravel()[:0]


_codes: dict = {}


def _code(name: str, ids: list[int], lengths: list[int]) -> Code:
    if name not in _codes:
        _codes.clear()
        _codes[name] = Code(ids, lengths)
    return _codes[name]


# -- shards -----------------------------------------------------------------------------------


def pack_shard(code: Code, keys: list[int | None], chunks: list[bytes], dtype: str) -> bytes:
    import numpy as np

    ids = np.frombuffer(b"".join(chunks), dtype).astype(np.int64)
    sizes = np.array([len(c) // np.dtype(dtype).itemsize for c in chunks], "<u4")
    stream, offsets = code.pack(ids)
    known = np.array([k is not None for k in keys], np.uint8)
    head = struct.pack("<4sQQQ", MAGIC, len(keys), len(ids), len(offsets))
    return b"".join([head, np.array([k or 0 for k in keys], "<i8").tobytes(), known.tobytes(), sizes.tobytes(), np.asarray(offsets, "<u8").tobytes(), stream])


def unpack_shard(code: Code, payload: bytes) -> tuple[list[int | None], list, "object"]:
    """Doc ids, ids of each document before it in the shard (one more at the end), all ids."""
    import numpy as np

    magic, docs, total, blocks = struct.unpack_from("<4sQQQ", payload)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    at = struct.calcsize("<4sQQQ")
    keys = np.frombuffer(payload, "<i8", docs, at)
    known = np.frombuffer(payload, np.uint8, docs, at := at + 8 * docs)
    sizes = np.frombuffer(payload, "<u4", docs, at := at + docs)
    offsets = np.frombuffer(payload, "<u8", blocks, at := at + 4 * docs)
    ids = code.unpack(payload[at + 8 * blocks :], offsets, total)
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    return [int(k) if ok else None for k, ok in zip(keys, known, strict=True)], ends, ids


SHARD = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()), T.StructField("n_docs", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("payload", T.BinaryType())])


def write_token_files(docs: DataFrame, tokenizer_json: str, path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> None:
    """Write {path}/shards and {path}/code, documents in ascending doc_id order."""
    import numpy as np

    spark = docs.sparkSession
    dtype = id_type(tokenizer_json)
    encoded = scratch(encode(docs, tokenizer_json, id_col=id_col, text_col=text_col, end_id=end_id), "ids")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for row in batch.column(0):
                own = np.bincount(np.frombuffer(row.as_py(), dtype))
                if len(own) > len(total):
                    total, own = own.astype(np.int64), total
                total[: len(own)] += own
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    counted = encoded.select("ids").mapInArrow(tally, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").collect()  # a row for each id of the vocabulary
    ids = [r["id"] for r in counted]
    lengths = [int(x) for x in code_lengths([r["n"] for r in counted])]
    spark.createDataFrame(list(zip(ids, lengths, strict=True)), "id long, bits int").coalesce(1).write.parquet(f"{path}/code")
    tokens = sum(r["n"] for r in counted)
    parts = max(1, min(100_000, -(-tokens // PART_TOKENS)), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // 50_000)))
    name, shared = uuid.uuid4().hex, spark.sparkContext.broadcast((ids, lengths))
    del counted, ids, lengths
    give_back()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code, part, seq, width = _code(name, *shared.value), TaskContext.get().partitionId(), 0, np.dtype(dtype).itemsize
        keys: list = []
        chunks: list[bytes] = []
        size = 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([size], pa.int64()), pa.array([pack_shard(code, keys, chunks, dtype)], pa.binary())], SHARD.names)

        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.column(1)[i].as_py()
                keys.append(batch.column(0)[i].as_py())
                chunks.append(own)
                size += len(own) // width
                if size >= SHARD_TOKENS:
                    yield flush()
                    seq, size, keys, chunks = seq + 1, 0, [], []
        if keys:
            yield flush()

    # dealt by the id, a hash of the ids and the row: the sample of range bounds that reaches the driver holds no payloads,
    # and rows that are equal in all but their place may go anywhere
    order = [F.asc_nulls_first("doc_id"), F.asc("hash"), F.asc("row")]
    placed = encoded.select("doc_id", "ids", F.hash("ids").alias("hash"), F.monotonically_increasing_id().alias("row"))
    dealt = placed.repartitionByRange(parts, *order) if parts > 1 else placed.coalesce(1)
    ordered = dealt.sortWithinPartitions(*order)
    ordered.select("doc_id", "ids").mapInArrow(pack, SHARD).write.option("compression", "uncompressed").parquet(f"{path}/shards")


DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """part, seq, start: ids of all shards before; from the shards' sizes only."""
    sizes = spark.read.parquet(f"{path}/shards").select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row for each writing task: a running sum over a few thousand numbers
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = sizes.select("part", "seq", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")).alias("inside"))
    return inside.join(before, "part").select("part", "seq", (F.col("before") + F.col("inside")).alias("start"))


def read_token_files(spark: SparkSession, path: str, *, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids array<long>) of each document, from the files alone."""
    rows = spark.read.parquet(f"{path}/code").collect()  # vocabulary-sized
    name, shared = uuid.uuid4().hex, spark.sparkContext.broadcast(([r["id"] for r in rows], [r["bits"] for r in rows]))
    del rows
    give_back()
    schema = T.StructType(DOC.fields + ([T.StructField("ids", T.ArrayType(T.LongType()))] if with_ids else []))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = _code(name, *shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                part, seq = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                keys, ends, ids = unpack_shard(code, batch.column(2)[i].as_py())
                flat = ids.astype("<u4")
                n = len(keys)
                cols = [
                    pa.array(keys, pa.int64()),
                    pa.array([part] * n, pa.int32()),
                    pa.array([seq] * n, pa.int32()),
                    pa.array(ends[:-1], pa.int64()),
                    pa.array(ends[1:] - ends[:-1], pa.int64()),
                    pa.array([zlib.crc32(flat[ends[k] : ends[k + 1]].tobytes()) for k in range(n)], pa.int64()),
                ]
                if with_ids:
                    cols.append(pa.array([ids[ends[k] : ends[k + 1]] for k in range(n)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, schema.names)

    read = spark.read.parquet(f"{path}/shards").select("part", "seq", "payload").mapInArrow(unpack, schema)
    out = read.join(shard_starts(spark, path), ["part", "seq"])
    return out.select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def contract(docs: DataFrame, tokenizer_json: str) -> DataFrame:
    """The digest that op6 returns, read back from the files."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, tokenizer_json, path)
    return read_token_files(spark, path)
