"""Tokens, packing, grammar files, BPE, suffixes, quality, toxicity, HTML, pipeline."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import PATTERN
from public_tokenizers import path as vocabulary
from pyspark.sql import functions as F

from populace.llm import bpe, html_text, packing, quality, queries, repair, suffix, tokens, toxicity

SCHEMA = "doc_id long, text string"
TRICKY = ["", " ", "a  b", "a   b c", " a b ", "a\n b", "a \n  b\t c", "x\n\ny\n\n\nz", "it's  'S ’s İstanbul ΑΣ ς", "é x y　z \x1c q", "<|endoftext|> a <|endoftext|>", "é ́x", "١٢ ²½ ª", "a" * 300, "日本語 テキスト", "don't we'll I'M", " x   y"]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    with open(vocabulary("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def whole(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    t.encode_special_tokens = True
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name,mode", [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_pieces_equal_whole_texts(docs, name, mode):
    enc, ref = tokens.PieceEncoder(vocabulary(name), mode, cache=500), whole(name)
    for t in [*TRICKY, *(t for _, t in docs[:80])]:
        assert enc.encode(t).tolist() == ref(t), t[:60]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'sÉßΣİ́ \n\t .,!5²<|>"), max_size=40))
def test_pieces_equal_whole_texts_of_any_kind(text):
    for name, mode in (("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")):
        key = name, "own"
        if key not in tokens._made:
            tokens._made[key] = tokens.PieceEncoder(vocabulary(name), mode), whole(name)
        enc, ref = tokens._made[key]
        assert enc.encode(text).tolist() == ref(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), min_size=1, max_size=60), max_size=8))
def test_grammar_round_trip(rows):
    arrays = [np.array(r, np.uint32) for r in rows]
    block = repair.Block(repair.pack_block(list(range(len(rows))), arrays, 6, min_count=2, per_round=4))
    assert [block.document(i).tolist() for i in range(len(rows))] == rows
    flat = [x for r in rows for x in r]
    for a, b in ((0, len(flat)), (1, 7), (len(flat) // 2, len(flat) + 3)):
        assert block.span(a, b).tolist() == flat[a:b]
    assert all(len(block.expand(np.array([6 + k]))) == block.lengths[6 + k] for k in range(len(block.rules)))


def test_grammar_compresses_repeats():
    rng = np.random.default_rng(0)
    phrase = rng.integers(0, 1000, 40).astype(np.uint32)
    docs = [np.concatenate([phrase, rng.integers(0, 1000, 5).astype(np.uint32)]) for _ in range(300)]
    assert len(repair.pack_block(list(range(300)), docs, 1000, rounds=6)) < 0.5 * 2 * sum(d.size for d in docs)


def check_op1(spark, rows, got):
    ref, at = whole("word_bpe_49k.json"), 0
    got = {r["doc_id"]: r for r in got}
    for d, t in sorted(rows):
        ids = np.array([*ref(t), 1], "<u4")
        r = got[d]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, ids.size, zlib.crc32(ids.tobytes()))
        at += ids.size


def test_op1_matches_direct_encoding(spark, sf, docs):
    check_op1(spark, docs, queries.op1_repair_output(spark, sf).collect())


def test_op1_small_blocks_nulls_and_order(spark):
    rows = [(5, None), (2, "hello world hello"), (9, ""), (-3, "x " * 500), (7, "Hello, World!")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("start", F.lit(1)).withColumn("part", F.lit("p"))
    check_op1(spark, rows, repair.read_documents(repair.write_blocks(df, vocabulary("word_bpe_49k.json"), block_tokens=20)).collect())
    assert repair.read_documents(repair.write_blocks(df.limit(0), vocabulary("word_bpe_49k.json"))).count() == 0
    odd = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b"), (1, "c")], SCHEMA)
    out = sorted(tuple(r[:3]) for r in repair.read_documents(repair.write_blocks(odd, vocabulary("word_bpe_49k.json"))).collect() if r[0] is not None)
    assert [r[1] for r in out] == [2, 4, 6]


def test_grammar_goes_to_its_end():
    """No rule that pays is left: what is frequent still overlaps itself or a better pair."""
    rng = np.random.default_rng(1)
    phrases = [rng.integers(0, 500, rng.integers(3, 30)).astype(np.uint32) for _ in range(60)]
    rows = [np.concatenate([phrases[i] for i in rng.integers(0, 60, 12)]) for _ in range(400)]
    ids, ends = np.concatenate(rows), np.zeros(sum(r.size for r in rows), bool)
    ends[np.cumsum([r.size for r in rows]) - 1] = True
    seq, last, rules = repair.compress(ids, ends, 500)
    again = repair.compress(seq, last, 500 + len(rules))[2]
    assert len(again) == 0 and len(np.unique(rules, axis=0)) == len(rules) and seq.size < 0.3 * ids.size
    assert seq.size < repair.compress(ids, ends, 500, rounds=2)[0].size


def test_op1_finds_documents_by_id(spark, docs):
    rows = [*docs[:60], (None, "a null id"), (10**6, "word " * 3000)]
    blocks = repair.write_blocks(spark.createDataFrame(rows, SCHEMA), vocabulary("word_bpe_49k.json"), block_tokens=4000)
    ref, asked = whole("word_bpe_49k.json"), [docs[3][0], docs[41][0], 10**6, -5]
    got = {r["doc_id"]: r["ids"] for r in repair.find_documents(blocks, asked).collect()}
    assert got == {d: [*ref(t), 1] for d, t in rows if d in asked}
    found = blocks.where((F.col("first_id") <= docs[3][0]) & (F.col("last_id") >= docs[3][0]))
    assert found.count() == 1 < blocks.count()


def check_packing(rows, got, capacity=1024):
    ref = whole("byte_bpe_50k.json")
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    total = 0
    for d, t in rows:
        ids = np.array([*ref(t), 2], "<u4")
        total += ids.size
        parts = sorted(by_doc[d], key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts)))
        at = 0
        for k, r in enumerate(parts):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            assert r["length"] == capacity if k or len(parts) == 1 and ids.size == capacity else r["length"] <= capacity
            at += r["length"]
        assert at == ids.size and len(parts) == -(-ids.size // capacity)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_seq), -(-total // capacity)


def test_op5_packs_tightly(spark, sf, docs):
    n, least = check_packing(docs, queries.op5_vector_packing(spark, sf).collect())
    assert n <= least * 1.02 + 1


def test_op5_nulls_and_empty(spark):
    rows = [(1, None), (2, ""), (3, "word " * 3000), (4, "a")]
    parts = packing.pieces(spark.createDataFrame(rows, SCHEMA).withColumn("shard", F.lit(0)), vocabulary("byte_bpe_50k.json"))
    check_packing(rows, packing.pack(parts).collect())
    assert packing.pack(parts.limit(0)).count() == 0
    null_id = packing.pieces(spark.createDataFrame([(None, "x"), (2**62 + 1, "y"), (2**62 + 1, "y")], SCHEMA), vocabulary("byte_bpe_50k.json"))
    assert sorted(str(r["doc_id"]) for r in packing.pack(null_id).collect()) == sorted(["None", str(2**62 + 1), str(2**62 + 1)])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=80), st.sampled_from(["norm", "dot"]), st.integers(2, 6), st.integers(2500, 4000))
def test_vector_constraints_hold(lengths, rule, docs, attention):
    x = np.array(lengths)
    seq, off = packing.best_fit(x, 60, docs, float(attention), rule=rule)
    for s in set(seq.tolist()):
        own = x[seq == s]
        assert own.sum() <= 60 and own.size <= docs and (own.astype(float) ** 2).sum() <= attention
        assert sorted(off[seq == s]) == sorted(np.cumsum(own[np.argsort(off[seq == s])]) - own[np.argsort(off[seq == s])])


def test_op5_constraints_bind():
    """Short and nearly full pieces: the query's capacities of documents and tiles are met, at few sequences more."""
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.integers(1, 20, 3000), rng.integers(900, 1024, 300), rng.integers(1, 1025, 1000)])
    limit = (1024 / packing.TILE) ** 2 + packing.SPARE_TILES
    seq, _ = packing.best_fit(x, 1024, packing.MAX_DOCS, limit, tile=packing.TILE)
    tiles = np.bincount(seq, np.ceil(x / packing.TILE) ** 2)
    assert np.bincount(seq).max() == packing.MAX_DOCS and tiles.max() == limit and np.bincount(seq, x).max() <= 1024
    free, _ = packing.best_fit(x, 1024, 1024, 1024.0**2)
    assert np.bincount(free).max() > packing.MAX_DOCS and free.max() <= seq.max()


def test_op5_constraints_cost_few_sequences(spark):
    """On the given documents: hardly more sequences than by tokens alone."""
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    x = np.array([r["length"] for r in packing.pieces(d, vocabulary("byte_bpe_50k.json")).select("length").collect()])
    limit = (1024 / packing.TILE) ** 2 + packing.SPARE_TILES
    seq, _ = packing.best_fit(x, 1024, packing.MAX_DOCS, limit, tile=packing.TILE)
    free, _ = packing.best_fit(x, 1024, 1024, 1024.0**2)
    assert seq.max() <= 1.002 * free.max()


def test_op5_repeated_texts(spark):
    rows = [(i % 3, "same words here") for i in range(50)] + [(None, "same words here")]
    parts = packing.pieces(spark.createDataFrame(rows, SCHEMA).withColumn("length", F.lit("x")), vocabulary("byte_bpe_50k.json"))
    got = packing.pack(parts).collect()
    assert len(got) == 51 and max(sum(r["sequence_id"] == s for r in got) for s in {r["sequence_id"] for r in got}) == packing.MAX_DOCS


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdehlost 'éß日\n1"), max_size=80))
def test_bpe_equals_the_library(text):
    import tiktoken

    if "bpe" not in tokens._made:
        enc = bpe.BytePairEncoder(vocabulary("byte_bpe_50k.tiktoken"), PATTERN)
        tokens._made["bpe"] = enc, tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=enc.ranks, special_tokens={})
    enc, ref = tokens._made["bpe"]
    ids = enc.encode(text)
    assert ids == ref.encode_ordinary(text) and enc.decode(ids) == text.encode()


def test_bpe_order_of_equal_ranks():
    """A merge may make a pair of lower rank that takes the next occurrence's part."""
    ranks = {bytes([c]): c for c in range(256)} | {b"xyx": 256, b"xy": 257}
    assert bpe.merge(b"xyxy", ranks) == [256, ord("y")]
    assert bpe.merge(b"", ranks) == []


def test_bpe_long_pre_tokens(tiktoken_encoding):
    enc = bpe.BytePairEncoder(vocabulary("byte_bpe_50k.tiktoken"), PATTERN)
    rng = random.Random(0)
    for t in ("a" * 5000, "ab" * 3000, "".join(rng.choice("abcdefgh") for _ in range(6000))):
        assert enc.encode(t) == tiktoken_encoding.encode_ordinary(t)


def test_op7_matches_the_library(spark, sf, docs, tiktoken_encoding):
    got = {r["doc_id"]: r for r in queries.op7_bpe_rank_queue(spark, sf).collect()}
    for d, t in docs:
        ids = tiktoken_encoding.encode_ordinary(t)
        assert got[d]["n_tokens"] == len(ids) and got[d]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[d]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    odd = bpe.encode_documents(spark.createDataFrame([(None, None), (1, "")], SCHEMA).withColumn("n_tokens", F.lit(3)), vocabulary("byte_bpe_50k.tiktoken"), PATTERN, with_ids=True).collect()
    assert [r["n_tokens"] for r in odd] == [0, 0] and odd[0]["ids"] == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60), st.integers(1, 4))
def test_suffix_array(s, scale):
    x = np.array(s, np.uint16) * (scale if scale < 4 else 1000)
    assert (suffix.suffix_array(x).tolist() if x.size else []) == sorted(range(x.size), key=lambda i: x[i:].tolist())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60), st.sampled_from([1, 1 << 20, 1 << 22, 1 << 30]))
def test_suffix_array_of_wide_symbols(s, scale):
    """Symbols whose triples or pairs don't fit one key."""
    x = np.array(s, np.uint32) * np.uint32(scale)
    assert (suffix.suffix_array(x).tolist() if x.size else []) == sorted(range(x.size), key=lambda i: x[i:].tolist())
    key, place = suffix._sorted_places(x.astype(np.uint64) << np.uint64(32), 64)
    assert place.tolist() == np.argsort(x, kind="stable").tolist() and (np.diff(key.astype(float)) >= 0).all()


@pytest.mark.parametrize("piece", [150, 1000, 1 << 18])
def test_op6_anchors_of_pieces(monkeypatch, piece):
    """Each window of each text has one anchor, equal windows have equal ones at equal places."""
    monkeypatch.setattr(suffix, "PIECE", piece)
    rng = random.Random(piece)
    block = bytes(rng.choices(b"abc ", k=700))
    texts = [block, b"", b"x" + block, block[:99], block[200:300], b"z" * 500, b"ab" * 300]
    of, seen = {}, {}
    for some in suffix.pieces(list(enumerate(texts)), 100):
        for part, g, at, first, n in zip(*suffix.anchors([p[2] for p in some], 100)):
            u, begin, _ = some[part]
            for k in range(begin + first, begin + first + n):
                assert (u, k) not in of and k <= begin + at <= k + 68
                of[u, k] = (g, begin + at - k)
    assert set(of) == {(u, k) for u, t in enumerate(texts) for k in range(len(t) - 99)}
    for (u, k), found in of.items():
        assert seen.setdefault(texts[u][k : k + 100], found) == found


def test_op6_shards_sort_only_what_can_repeat():
    """Before, every window around an anchor that occurs twice was sorted, whatever surrounds it."""
    rng = random.Random(8)
    gram, say = bytes(rng.choices(b"abcdefgh", k=32)), lambda n: bytes(rng.choices(b"ijklmnop", k=n))
    contexts = [say(a) + gram + say(136 - a) for a in rng.choices(range(69), k=400)]  # nothing but the gram in common
    lead = [c.index(gram) for c in contexts]
    for i in range(0, 40, 2):  # one window or more in common
        a = rng.randrange(min(lead[i], 68) + 1)
        window = contexts[i][lead[i] - a : lead[i] - a + 100 + rng.randrange(8)]
        contexts.append(say(68 - a) + window + say(9))
        lead.append(68)
    windows = np.minimum(np.array(lead) + 1, [len(c) - 99 for c in contexts])
    own, first, n = suffix.perhaps_repeated(contexts, np.full(len(contexts), 5), np.array(lead), windows, 100)
    kept = {(c, k) for c, a, m in zip(own.tolist(), first.tolist(), n.tolist()) for k in range(a, a + m)}
    assert len(kept) == n.sum() and all(0 <= k < windows[c] for c, k in kept)
    held = {}
    for c, m in enumerate(windows.tolist()):
        for k in range(m):
            held.setdefault(contexts[c][k : k + 100], []).append((c, k))
    again = {w for all_ in held.values() if len(all_) > 1 for w in all_}
    assert again and again <= kept
    assert len(kept) < windows.sum() / 8


def brute_repeats(rows, length):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                gone[k : k + length] = True
            seen.add(w)
        left = np.frombuffer(b, np.uint8)[~gone].tobytes() if b else b""
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if b else 0
        out[d] = (len(b), int(gone.sum()), runs, hashlib.sha256(left).hexdigest())
    return out


def as_rows(df):
    return {r[0]: tuple(r[1:5]) for r in df.collect()}


def test_op6_matches_brute_force(spark, sf, docs):
    assert as_rows(queries.op6_difference_cover(spark, sf)) == brute_repeats(docs, 100)


@pytest.mark.parametrize("hot,shard", [(20_000, 1 << 20), (2, 3000)])
def test_op6_overlaps_and_edges(spark, hot, shard):
    rng = random.Random(2)
    block = "".join(rng.choice("ab ") for _ in range(400))
    rows = [(1, block), (2, block), (3, block[:99]), (4, block[50:160] + "é" * 10 + block[200:301]), (5, None), (6, ""), (7, "z" * 450), (8, "yz" * 200), (9, "q" + block[150:] + block[:150]), (10, "z" * 120)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("uid", F.lit("u")).repartition(3)
    assert as_rows(suffix.remove(df, 100, hot=hot, shard_bytes=shard)) == brute_repeats(rows, 100)


def test_op6_repeated_rows_and_empty(spark):
    rng = random.Random(4)
    t = "".join(rng.choice("abcdefgh ") for _ in range(300))
    out = suffix.remove(spark.createDataFrame([(1, t), (1, t), (None, "x"), (3, t)], SCHEMA)).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in out) == [("1", 0), ("1", 0), ("3", 300), ("None", 0)]
    assert suffix.remove(spark.createDataFrame([], SCHEMA)).count() == 0


def test_op6_matches_sql(spark, sf, duck):
    from ..oracle import same_rows

    same_rows(queries.op6_difference_cover(spark, sf), duck, queries.oracle_sql()["op6_difference_cover"])


def test_op3_matches_sql(spark, sf, duck):
    from ..oracle import same_rows

    same_rows(queries.op3_host_quality(spark, sf), duck, queries.oracle_sql()["op3_host_quality"])


def test_op3_counts_and_hosts(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, "spam.example", "a b c " * 40) for i in range(60)] + [(60, "spam.example", good)] + [(100 + i, "fine.example", good) for i in range(60)] + [(300, None, None), (301, "fine.example", ""), (302, "fine.example", "x#y\nx#y\n \n \nz$")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("kept", F.lit("own")).withColumn("_t", F.lit(1))
    got = {r["doc_id"]: r for r in quality.judge(df, ["doc_id"]).collect()}
    assert got[0]["base_failed"] and got[0]["n_repeat_words"] == 120 and not got[60]["base_failed"] and not got[60]["kept"]
    assert got[100]["kept"] and got[300]["n_words"] == 0 and got[301]["base_failed"]
    r = got[302]
    assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == (3, 8, 3, 1)
    kept = quality.passing(df)
    assert kept.columns == df.columns and {r["kept"] for r in kept.collect()} == {"own"} and kept.count() == 60
    assert quality.judge(df.limit(0), ["doc_id"]).count() == 0


def test_op8_held_out_accuracy(spark):
    big = "/root/testdata/sf0.1"
    got = queries.op8_toxicity_nb(spark, big).where("held_out").join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id")
    right = got.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0]
    assert right > 0.97


def test_op8_never_learns_held_out_labels(spark, sf):
    d, lab = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    flipped = lab.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.score_documents(d, x).collect())) for x in (lab, flipped))
    assert a == b
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h, *_ in a)


def test_op8_without_labels_and_texts(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "fine words"), (None, "x")], SCHEMA).withColumn("score", F.lit(7))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.score_documents(d, none).collect()} == {0}
    one = spark.createDataFrame([(1, 1), (3, 1)], "doc_id long, toxic int")
    assert all(0 <= r["score"] <= 1 for r in toxicity.score_documents(d, one).collect())
    assert toxicity.score_documents(d.limit(0), one).count() == 0


def test_op8_a_long_text_costs_the_others_nothing(spark, monkeypatch):
    """A labelled text beyond the sample's characters is left out alone, wherever it stands in order."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(("fine", "good", "calm", "words")) if i % 2 else rng.choice(("vile", "awful", "nasty", "words")) for _ in range(30))) for i in range(120)]
    lab = spark.createDataFrame([(i, 1 - i % 2) for i, _ in rows] + [(1000 + i, 1) for i in range(40)], "doc_id long, toxic int")
    long_rows = [(1000 + i, "long text " * 3000) for i in range(40)]
    df = spark.createDataFrame(rows + long_rows + rows[:2], SCHEMA)
    m = toxicity.train(df, lab, max_chars=25_000)
    assert (m.weights != 0).any() and all((m.score(t) >= 0.5) == (i % 2 == 0) for i, t in rows)
    assert toxicity.train(df, lab, max_chars=0).weights.any() == False  # noqa: E712


PAGE = """<!doctype html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=1>Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<main><article><h1>Head &amp; line</h1><p>First  para <b>bold</b>,<br>more.<p>Second &lt;para&gt; with enough words to be dense.
<div class="ad">Buy</div><p>Tiny.</p><form><input value=x>Search</form><aside>Side</aside></article></main>
<section id="comments"><p>A reader says a long thing that is as dense as the article and goes on for a while.</p></section>
<footer>&copy; me</footer></body></html>"""


def test_op10_extracts_the_article(spark):
    assert html_text.extract(PAGE) == "Head & line\n\nFirst para bold, more.\n\nSecond <para> with enough words to be dense.\n\nTiny."
    assert html_text.extract(None) == html_text.extract("") == html_text.extract("<nav>x</nav>") == ""
    assert html_text.extract("plain text") == "plain text"
    assert html_text.extract("<p>cut off <b>he") == "cut off he"
    rows = [(1, "u", PAGE), (2, None, None), (None, "v", "<p>x</p>")]
    got = html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(0))).collect()
    assert [r["n_chars"] for r in got] == [len(html_text.extract(PAGE)), 0, 1]


def test_op10_on_the_given_pages(spark, sf):
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries.op10_html_ratio(spark, sf).collect():
        body = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", body))
        assert r["text"] == "\n\n".join(b for b in blocks if b)


def bare_page(rng):
    """A page without article or main, or any telling name, and its text."""
    say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    menu = lambda n: "<ul>" + "".join(f"<li><a href='/{i}'>{say(rng.randrange(1, 4))}</a></li>" for i in range(n)) + "</ul>"
    title, parts = say(6), [say(rng.randrange(15, 60)) for _ in range(rng.randrange(3, 8))] + [say(3)]
    rng.shuffle(parts)
    body = f"<h2>{title}</h2>" + "".join(f"<p>{t[:20]}<i>{t[20:]}</i></p>" for t in parts)
    if rng.random() < 0.5:
        body += f"<div>{menu(6)}</div>"
    low = "".join(f"<div><a href=#>{say(2)}</a> <b>{say(1)}</b></div>" for _ in range(8))
    return f"<html><body><div id=top>{menu(9)}</div><div class='c1'><div>{body}</div></div><div>{low}</div><div class=foot>{menu(4)}<span>{say(2)}</span></div></body></html>", "\n\n".join([title, *(t for t in parts)])


def test_op10_ratios_find_content_without_names():
    rng = random.Random(0)
    pages = [bare_page(rng) for _ in range(60)]
    right = lambda **how: sum(html_text.extract(h, **how) == t for h, t in pages)
    assert right() >= 57 and right(ratios=False) <= 6


@pytest.mark.parametrize("page,text", [
    ("<p>a</p><![foo[ x ]]><p>b</p>", "a\n\nb"),
    ('<div class="content has-sidebar"><article><p>in it</p></article></div>', "in it"),
    ('<article><div class="entry-header"><h1>Title</h1></div><p>text</p></article>', "Title\n\ntext"),
    ('<div class="ad-layout"><article><p>in it</p></article></div>', "in it"),
    ('<main><p>in it</p><div class="post-comments"><article><p>A reader.</p></article></div></main>', "in it"),
    ("<div><h1>T</h1><div><p>body text of some length</p><p>more of it</p></div></div>", "T\n\nbody text of some length\n\nmore of it"),
    ("<p>x<!-- never ends <p>y", "x"),
    ("<nav>a</nav><aside>b</aside><form>c</form>", ""),
])
def test_op10_markup_of_many_kinds(page, text):
    assert html_text.extract(page) == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<", ">", "<!", "<![", "[", "]]>", "<p", "<div>", "</div>", "</p>", "<b class='", "'", "&", "&#x;", "<!--", "-->", "<?", "<script>", "</script>", "text", " ", "\x00", "<article>", "é"]), max_size=40))
def test_op10_never_fails(parts):
    assert isinstance(html_text.extract("".join(parts)), str)


def test_op10_long_pages_repeats_and_empty_table(spark):
    import time

    began = time.process_time()
    for part in ("<", "<p ", "<a href='", "<!--", "<![x", "</x ", "&"):
        html_text.extract(part * 50_000)
    html_text.extract("<div>" * 30_000 + "</b>" * 30_000)
    assert time.process_time() - began < 20
    page = "<article>" + "".join(f"<p>paragraph {i} of a long page</p>" for i in range(20_000)) + "</article>"
    rows = [(1, "u", page), (1, "u", page), (2, "v", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("n_chars", F.lit("x"))
    got = html_text.extract_pages(df).collect()
    assert sorted(r["n_chars"] for r in got) == [0, *[len("\n\n".join(f"paragraph {i} of a long page" for i in range(20_000)))] * 2]
    assert html_text.extract_pages(df.limit(0)).count() == 0


def test_op3_repeated_rows_nulls_and_long_texts(spark):
    rows = [(1, "h", "a b c d"), (1, "h", "a b c d"), (None, None, "x " * 60), (2, "h", " ".join(f"w{i}" for i in range(20_000))), (3, "h", " ".join(f"w{i % 10_000}" for i in range(20_001)))]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, source string, text string"), ["doc_id"]).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 5 and by[1]["n_words"] == 4 and by[None]["n_repeat_words"] == 60
    assert (by[2]["n_words"], by[2]["n_repeat_words"], by[3]["n_repeat_words"]) == (20_000, 0, 20_001)
    assert not by[2]["base_failed"] and by[3]["base_failed"]


def test_op7_repeats_and_empty_table(spark, tiktoken_encoding):
    rows = [(1, "same text"), (1, "same text"), (2, "x" * 50_000 + " y")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"ids": F.lit(0), "decoded_sha256": F.lit("z")})
    how = vocabulary("byte_bpe_50k.tiktoken"), PATTERN
    got = bpe.encode_documents(df, *how).collect()
    assert sorted(r["n_tokens"] for r in got) == sorted(len(tiktoken_encoding.encode_ordinary(t)) for _, t in rows)
    assert bpe.encode_documents(df.limit(0), *how).count() == 0


def test_op6_long_text_and_equal_hashes(spark):
    rng = random.Random(9)
    long = " ".join(str(rng.randrange(10**6)) for _ in range(120_000))
    rows = [(1, long), (2, "head " + long[5000:400_000] + " tail"), (3, long[300_000:300_050]), (4, "other " * 40), (5, None), (6, "other " * 40)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert as_rows(suffix.remove(df)) == brute_repeats(rows, 100)
    assert as_rows(suffix.remove(df, hash_of=lambda c: F.lit(3).cast("long"))) == brute_repeats(rows, 100)


def test_pipeline_odd_input(spark, sf):
    """Nulls, repeated rows, clashing extra columns and a long text, through every stage; and an empty table."""
    import corpus_pipeline as C

    rng = random.Random(4)
    own = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    twice = say(80)
    odd = [(None, say(70)), (None, None), (9001, twice), (9001, twice), (9002, say(60_000)), (9003, ""), (9004, twice)]
    rows = [(i, t, None, None, len(t or "")) for i, t in odd]
    docs = own.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select(*(F.col(c).cast(own.schema[c].dataType).alias(c) for c in own.columns)))
    docs = docs.withColumns({c: F.lit("own") for c in ("uid", "doc", "kept", "component_id", "_doc", "n_removed")})
    empty = docs.limit(0)
    for name, stage in C.STAGES:
        last = name == "packing"
        assert stage(spark, empty, sf).count() == 0
        docs = stage(spark, docs, sf)
        assert last or docs.columns == empty.columns and {r["uid"] for r in docs.collect()} == {"own"}
    ids = [r["doc_id"] for r in docs.select("doc_id", "piece").collect()]
    assert {None, 9001, 9002} <= set(ids) and not {9003, 9004} & set(ids) and ids.count(9001) == 2


def test_pipeline_against_single_stages(spark, sf, docs):
    """Each stage against a plain version of its rule on its own input."""
    import corpus_pipeline as C

    raw = spark.read.parquet(f"{sf}/documents.parquet")
    by_name = dict(C.STAGES)
    clean = by_name["toxicity"](spark, raw, sf)
    assert clean.columns == raw.columns
    model = toxicity.train(raw, spark.read.parquet(f"{sf}/labels.parquet"))
    assert {r["doc_id"] for r in clean.collect()} == {i for i, t in docs if model.score(t) < 0.5} and clean.count() > 0.8 * len(docs)
    good = by_name["quality"](spark, clean, sf)
    text = dict(docs)

    def fails(t):
        w = t.split()
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        hit = {i + k for i, g in enumerate(tri) if tri.count(g) > 1 for k in range(3)}
        return len(w) < 50 or 100 * len(hit) > 50 * len(w)

    kept = {r["doc_id"] for r in good.collect()}
    assert kept == {r["doc_id"] for r in clean.collect() if not fails(text[r["doc_id"]])}
    single = {r["doc_id"] for r in by_name["near_copies"](spark, good, sf).collect()}
    shingles = {i: {tuple(text[i].lower().split()[k : k + 5]) for k in range(len(text[i].split()) - 4)} for i in kept}
    alike = lambda a, b: len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])
    gone = kept - single
    assert all(any(alike(i, j) for j in kept if j != i) for i in gone)
    assert not [i for i in single for j in single if j < i and text[i] == text[j]]
    packed = C.run(spark, sf).collect()
    assert {r["doc_id"] for r in packed} <= single and len({r["doc_id"] for r in packed}) >= 0.9 * len(single)
    assert C.ORACLE_SQL is None and [n for n, _ in C.STAGES] == ["toxicity", "quality", "near_copies", "repeats", "packing"]
