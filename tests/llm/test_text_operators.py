"""Token counts, decontamination, SimHash, token files and chat formatting against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from vitrina.llm import chat, components, decontaminate, simhash, token_counts, token_files
from vitrina.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "a", "a b c", "  double  space ", "▁x▁▁y", "漢字 ab\n\n d <|endoftext|>x", "😀😀 é", "tab\t x y \r\n z", "<0x0A>\x00x   ", "long " * 30000]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def docs_of(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


# -- token counts -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return token_counts.load_vocabulary(tokenizer_path("piece_bpe_32k.model"))


def message(fields):
    """A protocol buffer message out of (number, wire type, value)."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    return b"".join(varint(n << 3 | kind) + (varint(v) if kind == 0 else v if kind == 5 else varint(len(v)) + v) for n, kind, v in fields)


def unigram_model(path, scores):
    """The sentencepiece library's own unigram model with the pieces of a file and other scores for text pieces."""
    import struct

    import sentencepiece

    with open(path, "rb") as f:
        fields = token_counts.proto_fields(f.read())
    out, left = [], iter(scores)
    for n, kind, v in fields:
        if n == 1:
            own = {a: c for a, _, c in token_counts.proto_fields(v)}
            if own.get(3, 1) == 1:
                v = message([(1, 2, own[1]), (2, 5, struct.pack("<f", next(left)))])
        elif n == 2:
            v = message([x if x[0] != 3 else (3, 0, 1) for x in token_counts.proto_fields(v)])
        out.append((n, kind, v))
    return sentencepiece.SentencePieceProcessor(model_proto=message(out))


def test_token_counts_match_the_library(spark, sf_dir, vocabulary):
    """Texts are compared line by line: the library adds in single precision, which is exact for short texts only."""
    library = unigram_model(tokenizer_path("piece_bpe_32k.model"), [s for _, s in vocabulary.pieces])
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + [t for t in ODD if t is None or len(t) < 1000]
    texts += ["<s> </s> <unk> <0x41>", "internationalization of tokenizers", "hello  world   ▁ x", " lead", "trail "]
    lines = [line[i : i + 2000] for t in texts for line in (t or "").split("\n") for i in range(0, len(line) or 1, 2000)]
    got = token_counts.count_tokens(spark.createDataFrame([(x,) for x in lines], "text string"), vocabulary).collect()
    assert [(r["text"], r["n_tokens"]) for r in got] == [(x, len(library.encode(x))) for x in lines]


def test_token_counts_of_whole_texts(spark, vocabulary):
    """A whole text, against the same program without chunks and automaton."""
    scores = dict(vocabulary.pieces)
    longest, unknown = max(map(len, scores)), min(scores.values()) - 10

    def brute(text):
        marked = "▁" + text.replace(" ", "▁") if text else ""
        best = [(0.0, 0)] + [None] * len(marked)
        for end in range(1, len(marked) + 1):
            for start in range(max(0, end - longest), end):
                if marked[start:end] in scores:
                    x = (best[start][0] + scores[marked[start:end]], best[start][1] + 1)
                    if best[end] is None or x[0] > best[end][0]:
                        best[end] = x
            x = (best[end - 1][0] + unknown, best[end - 1][1] + len(marked[end - 1].encode()))
            if marked[end - 1] not in scores and (best[end] is None or x[0] > best[end][0]):
                best[end] = x
        return best[-1][1]

    texts = [*ODD[:-1], "<0x41><s>", "long " * 300, "x" * 5000, "    " * 200 + "end", "é漢\u0301 " * 50]
    got = token_counts.count_tokens(docs_of(spark, [*texts, ODD[-1]]), vocabulary).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in got][:-1] == [brute(t or "") for t in texts]
    assert got[-1]["n_tokens"] == 30000 * brute("long") + brute("long ") - brute("long")


def test_zipf_scores(vocabulary):
    import math

    scores = [s for _, s in vocabulary.pieces]
    assert scores == sorted(scores, reverse=True) and all(s * 1024 == int(s * 1024) for s in scores)
    assert abs(sum(map(math.exp, scores)) - 1) < 0.01 and len(vocabulary.pieces) == 32000 - 3 - 256 and vocabulary.byte_fallback
    assert not any(p in ("<s>", "</s>", "<unk>", "<0x41>") for p, _ in vocabulary.pieces)


def test_token_count_ties():
    """Equal scores: the path whose last piece starts earlier stays."""
    from tokenizers import Tokenizer, models

    rng = random.Random(3)
    for _ in range(200):
        pieces = {"<unk>": 0.0} | {"".join(rng.choices("ab▁", k=rng.randint(1, 4))): float(-rng.randint(1, 3)) for _ in range(6)}
        vocabulary = list(pieces.items())
        t, own = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=False)), token_counts.Counter(token_counts.Vocabulary(vocabulary, False))
        for _ in range(10):
            word = "▁" + "".join(rng.choices("ab", k=rng.randint(0, 6)))
            ids = t.encode(word, add_special_tokens=False).ids
            assert 0 in ids or own.count(word) == len(ids)


def test_token_counts_empty_table(spark, vocabulary):
    got = token_counts.count_tokens(docs_of(spark, []).withColumnRenamed("n_chars", "n_tokens"), vocabulary)
    assert got.count() == 0 and got.columns.count("n_tokens") == 1


# -- decontamination ----------------------------------------------------------------------------


def brute_hits(texts, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for item, text in items:
        ws = word.findall(lower(text or ""))
        for w in [tuple(ws)] if 0 < len(ws) < 13 else [tuple(ws[i : i + 13]) for i in range(len(ws) - 12)]:
            windows.setdefault(w, set()).add(str(item))
    out = []
    for text in texts:
        ws, hit, own = word.findall(lower(text or "")), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(ws) - n + 1):
                if (w := tuple(ws[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    own |= windows[w]
        out.append((len(ws), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws)))
    return out


def test_decontamination_brute_force(spark):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choices("ab", k=rng.choice([0, 1, 2, 5, 12, 13, 14, 30])))) for i in range(14)] + [(3, "a b"), (90, None), (91, "Ünïcode, word; x" * 5)]
    texts = [" ".join(rng.choices(["a", "B", "b", "c"], [5, 2, 5, 1], k=rng.choice([0, 3, 40, 400]))) for _ in range(40)] + ODD + ["x ünïcode, word; x" * 5]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contract(docs_of(spark, texts), bench).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute_hits(texts, items)
    assert decontaminate.contract(docs_of(spark, texts), bench.limit(0)).filter("contaminated or n_hit > 0").count() == 0
    assert decontaminate.contract(docs_of(spark, []), bench).count() == 0


def test_decontamination_bounds_and_cuts(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    docs = docs_of(spark, [f"before, {passage}. After " + "x " * 3000, "clean", passage])
    assert [r["doc_id"] for r in decontaminate.keep_clean(docs, bench).orderBy("doc_id").collect()] == [0, 1]
    assert decontaminate.keep_clean(docs, bench).columns == docs.columns
    cut = decontaminate.remove_spans(decontaminate.decontaminate(docs, bench)).orderBy("doc_id").collect()
    assert cut[0]["text"].startswith("before, . After x") and cut[1]["text"] == "clean"


def test_large_benchmarks_go_block_by_block(spark):
    """Several automata one after the other give what one gives; no benchmark is refused."""
    rng = random.Random(7)
    items = [(i, " ".join(rng.choices("abc", k=rng.choice([1, 4, 13, 20, 40])))) for i in range(30)] + [(30, None), (3, "a b")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(spark, [" ".join(rng.choices(["a", "B", "c", "zz"], [5, 4, 5, 1], k=rng.choice([0, 3, 40, 200]))) for _ in range(30)] + ODD)
    clash = docs.withColumn("row", F.lit(1)).withColumn("whole", F.lit(2)).withColumn("spans", F.lit(3)).withColumn("items", F.lit("x"))
    whole = decontaminate.decontaminate(clash, bench).orderBy("doc_id")
    parts = decontaminate.decontaminate(clash, bench, max_item_words=30).orderBy("doc_id")
    assert len(decontaminate.load_items(bench, "item_id", "text", 30)) > 3
    assert whole.columns == parts.columns and whole.collect() == parts.collect() and "row" in whole.columns


def test_batches_with_and_without_cuts_share_a_task(spark):
    """One task gives batches that stay as they came and batches with a cut text, in either order."""
    passage = " ".join(f"p{i}" for i in range(60))
    around = [" ".join(f"w{i}x{n}" for n in range(1500)) for i in range(12)]
    cut = {i for i in range(12) if i // 2 in (1, 4)}
    bench = spark.createDataFrame([("b", passage)], "item_id string, text string")
    docs = spark.createDataFrame([(i, f"{around[i]} {passage} end" if i in cut else f"{around[i]} end", -1) for i in range(12)], "doc_id long, text string, n_chars long").coalesce(1)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 2)
    try:
        got = {r["doc_id"]: r for r in decontaminate.keep_clean(docs, bench).collect()}
    finally:
        spark.conf.set(key, before)
    assert sorted(got) == list(range(12))
    assert all(got[i]["text"] == (f"{around[i]}  end" if i in cut else f"{around[i]} end") for i in got)
    assert all(got[i]["n_chars"] == (len(got[i]["text"]) if i in cut else -1) for i in got)


def test_keep_clean_cuts_long_spans(spark, sf_dir):
    """A long document holds 900 benchmark words, below the coverage limit: it stays, its passage goes."""
    import corpus_pipeline

    passage = " ".join(f"w{i}" for i in range(900))
    bench = spark.createDataFrame([(1, passage), (2, " ".join(f"v{i}" for i in range(50)))], "item_id long, text string")
    short = " ".join(f"v{i}" for i in range(50)) + " é" * 2000
    texts = [f"é before, {passage}. After" + " x" * 20000, short, None, passage]
    docs = docs_of(spark, texts)
    got = {r["doc_id"]: r for r in decontaminate.keep_clean(docs, bench).collect()}
    want = "é before, . After" + " x" * 20000
    assert {i: (r["text"], r["n_chars"]) for i, r in got.items()} == {0: (want, len(want)), 1: (short, len(short)), 2: (None, 0)}
    assert decontaminate.keep_clean(docs, bench).schema == docs.schema
    assert decontaminate.keep_clean(docs.withColumnRenamed("text", "body").select("body"), bench, text_col="body").count() == 3
    assert decontaminate.keep_clean(docs.limit(0), bench).count() == 0
    item = next(r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if len(decontaminate.split_words(r["text"].encode())) > 50)
    stage = corpus_pipeline.remove_contaminated(spark, docs_of(spark, [f"{item} " + "漢 " * 20000]), sf_dir).collect()
    assert len(stage) == 1 and item not in stage[0]["text"] and stage[0]["n_chars"] == len(stage[0]["text"])


# -- SimHash ------------------------------------------------------------------------------------


def brute_print(text):
    import xxhash

    ws = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    if not ws:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 4]).encode(), 42) for i in range(max(1, len(ws) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(ids, linked):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_position_triples():
    triples = simhash.position_triples()
    assert len(triples) == 20 and all(any(set(t) <= set(four) for t in triples) for four in itertools.combinations(range(8), 4))


def test_simhash_brute_force(spark, sf_dir):
    rng = random.Random(11)
    base = [rng.choices([f"w{i}" for i in range(50)], k=60) for _ in range(5)]
    near = [" ".join(rng.choice(["w1", "zz"]) if rng.random() < 0.03 else w for w in rng.choice(base)) for _ in range(150)]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(docs_of(spark, ODD + near, 10**6))
    rows = docs.select("doc_id", "text").collect()
    prints = {r["doc_id"]: brute_print(r["text"]) for r in rows}
    linked = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    want = roots(prints, linked)
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.contract(docs).collect()} == {(i, f"{p:016x}", want[i]) for i, p in prints.items()}
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == set(want.values())


def test_components_of_dense_prints(spark):
    """Dense groups, chains through the middle of a group, and groups that share postings without a link."""
    rng = random.Random(2)
    prints = set()
    for _ in range(4):
        center = rng.getrandbits(64)
        prints |= {center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(120)}
        other = center ^ 0xFF_FF_00_00_00_00  # two bytes away: shares postings
        prints |= {other ^ (1 << rng.randrange(64)) for _ in range(30)}
        chain = center
        for _ in range(12):
            chain ^= sum(1 << b for b in rng.sample(range(64), 4))
            prints.add(chain)
    prints = sorted(prints)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    for bits in (4, 2):
        linked = [(signed(a), signed(b)) for a, b in itertools.combinations(prints, 2) if (a ^ b).bit_count() <= bits]
        want = {x: r for x, r in roots([signed(p) for p in prints], linked).items() if any(x in e for e in linked)}
        got = simhash.linked_components(table, bits).collect()
        assert {r["fp"]: r["component"] for r in got} == want and len(got) == len(want)
    with pytest.raises(ValueError):
        simhash.linked_components(table, 5)


def test_dense_groups_make_few_links(spark):
    """Links between representatives, not between all pairs: a group of m near copies has far fewer than m * m."""
    rng = random.Random(3)
    center = rng.getrandbits(63)
    prints = sorted({center ^ sum(1 << b for b in rng.sample(range(60), 2)) for _ in range(800)})
    table = spark.createDataFrame([(p,) for p in prints], "fp long")
    first = simhash.representative_links(simhash.postings(table), 4).count()
    assert first < 20 * 2 * len(prints)


def test_keep_one_odd_rows(spark):
    docs = spark.createDataFrame([(1, "same text", "x", 0), (1, "same text", "x", 0), (2, "same text", "y", 1), (None, "same text", "z", 2)], "doc_id long, text string, fp string, component_id int")
    assert sorted((r["doc_id"] or 0, r["fp"]) for r in simhash.keep_one(docs).collect()) == [(0, "z"), (1, "x")]
    assert simhash.contract(docs.limit(0)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 300), (7, 7)] + [(500, x) for x in range(501, 540)]
    rng = random.Random(1)
    rng.shuffle(chain)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    nodes = {x for e in chain for x in e}
    assert got == roots(nodes, chain)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- token files --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer_json():
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def test_token_files_round_trip(spark, sf_dir, tokenizer_json, tmp_path):
    import numpy as np
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(docs_of(spark, ODD, -50))
    path = str(tmp_path / "files")
    token_files.write_token_files(docs, tokenizer_json, path)
    got = {r["doc_id"]: r for r in token_files.read_token_files(spark, path, with_ids=True).collect()}
    t, start = Tokenizer.from_str(tokenizer_json), 0
    for r in sorted(docs.select("doc_id", "text").collect()):
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        own = got[r["doc_id"]]
        assert (own["start"], own["n_tokens"], own["ids"]) == (start, len(ids), ids)
        assert own["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert len(got) == docs.count()


def test_token_files_empty_and_repeated(spark, tokenizer_json, tmp_path):
    token_files.write_token_files(docs_of(spark, []), tokenizer_json, str(tmp_path / "none"))
    assert token_files.read_token_files(spark, str(tmp_path / "none")).count() == 0
    twice = spark.createDataFrame([(1, "b"), (1, "a"), (None, None)], "doc_id long, text string")
    token_files.write_token_files(twice, tokenizer_json, str(tmp_path / "twice"))
    got = token_files.read_token_files(spark, str(tmp_path / "twice")).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in got] == [(None, 0, 1), (1, 1, 2), (1, 3, 2)]


def test_token_files_of_one_id(spark, tokenizer_json, tmp_path, monkeypatch):
    """Very many rows of one id, or of none, are dealt to several parts and come back whole and in order."""
    monkeypatch.setattr(token_files, "PART_TOKENS", 500)
    rows = [(7 if i % 2 else None, f"text {i % 40} " * 3) for i in range(600)] + [(3, "first"), (9, "last")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    token_files.write_token_files(docs, tokenizer_json, str(tmp_path / "hot"))
    got = token_files.read_token_files(spark, str(tmp_path / "hot"), with_ids=True).orderBy("start").collect()
    assert sorted((r["doc_id"] or -1) for r in got) == sorted((i or -1) for i, _ in rows) == [r["doc_id"] or -1 for r in got]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:], strict=False))
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(tokenizer_json)
    assert sorted((r["doc_id"] or -1, r["ids"]) for r in got) == sorted((i or -1, [*t.encode(x, add_special_tokens=False).ids, 0]) for i, x in rows)
    shards = spark.read.parquet(str(tmp_path / "hot") + "/shards")
    assert shards.agg(F.max("n_docs")).first()[0] < 200


def test_cuts_never_change_ids(tokenizer_json):
    from tokenizers import Tokenizer

    rng, t = random.Random(4), Tokenizer.from_str(tokenizer_json)
    encoder = token_files.Encoder(tokenizer_json, "<u2")
    import numpy as np

    parts = ["a", "É", "don't", "'s", " ", "  ", "\n", "\n\n", "\t", "1", "23", "!", "。", "漢", "\xa0", "\xad", "é", "...", "\x1c", "\x85", "​", "ﬁ"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        assert np.frombuffer(encoder.encode([text])[0], "<u2").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def huffman_cost(counts):
    import heapq

    heap, cost = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        cost += x
        heapq.heappush(heap, x)
    return cost


def test_huffman_code():
    import numpy as np

    rng = random.Random(9)
    for n in (2, 3, 7, 100, 2000):
        counts = [rng.randint(1, 10**6) for _ in range(n)]
        assert sum(c * int(x) for c, x in zip(counts, token_files.code_lengths(counts, 40), strict=True)) == huffman_cost(counts)
        lengths = token_files.code_lengths(counts)
        assert sum(2.0 ** -int(x) for x in lengths) == 1.0
    steep = token_files.code_lengths([2**i for i in range(40)], 8)
    assert max(steep) == 8 and sum(2.0 ** -int(x) for x in steep) <= 1
    codes = token_files.canonical_codes(range(2000), lengths)
    assert len({(int(c), int(x)) for c, x in zip(codes, lengths, strict=True)}) == 2000
    code = token_files.Code([5], [1])
    stream, offsets = code.pack(np.full(1000, 5))
    assert code.unpack(stream, offsets, 1000).tolist() == [5] * 1000
    with pytest.raises(ValueError):
        token_files.code_lengths([1] * 300, 8)


# -- chat ---------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"


def brute_chats(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn, role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {}
    for conv, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
    return out


def test_chats(spark, sf_dir):
    rng = random.Random(8)
    marks = ["<turn>", "</turn>", "</turn>\n", "<part>", "<", "\\", "\\\\", "\n", "é😀", "a", "$1", "<\\turn>", "<\\\\/turn>", "### Assistant:"]
    rows = [(-1 - i, t, rng.choice(["user", "assistant", "assistant", "a\\b\n", None, "\\n"]), rng.choice([None, "", "".join(rng.choices(marks, k=rng.randint(1, 7)))])) for i in range(60) for t in range(rng.randint(1, 6))]
    rows += [rows[0], (-100, 0, "user", chat.PLANTED), (-100, 1, "assistant", chat.PLANTED)]
    table = spark.createDataFrame(rows, TURNS).unionByName(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    want = brute_chats([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    got = chat.contract(table).collect()
    assert {r["conv_id"]: tuple(r)[1:5] for r in got} == want
    chats = {r["conv_id"]: r for r in chat.format_chats(table).collect()}
    assert all(len(chats[r["conv_id"]]["formatted"]) == r["formatted_chars"] for r in got)
    assert chat.contract(table.limit(0)).count() == 0


def test_merged_roles(spark):
    rows = [(1, 2, "assistant", "c"), (1, 0, "user", "a"), (1, 1, "user", "b")]
    assert chat.format_chats(spark.createDataFrame(rows, TURNS)).first()["formatted"] == "<turn>user\na<part>b</turn>\n<turn>assistant\nc</turn>\n"
