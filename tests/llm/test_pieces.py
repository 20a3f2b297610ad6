"""SentencePiece with offsets, and token alignment."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from public_tokenizers import path as vocabulary
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from populace.llm import align, pieces, queries
from populace.llm.tokens import byte_letters

SCHEMA = "doc_id long, text string"
MODEL = vocabulary("piece_bpe_32k.model")
ALPHABET = "#b#ab'sÉßΣİ́ \n\t .,!5²<|>▁　ﬁ㍿ｶﾞÁ̀e¨ 日本😀​\x00"
TRICKY = ["", " ", "  ", "a  b", " a ", "a\n b", "日本語 テキスト", "▁a▁ b", "\x00x", "<s> </s> <unk> <0x0A>", "ﬁ Å　x", "a" * 500, "½ ㍿ ｶﾞ", "¨ ¨", "x 　", "ab\nab" * 40]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


def variant(folder, strip, bytes_, suffix, users):
    """The model with the compiled map of another normaliser, and other settings."""
    m, q = sentencepiece_model_pb2.ModelProto(), sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as f:
        m.ParseFromString(f.read())
    q.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    m.normalizer_spec.precompiled_charsmap = q.normalizer_spec.precompiled_charsmap
    m.normalizer_spec.remove_extra_whitespaces = strip
    m.trainer_spec.byte_fallback, m.trainer_spec.treat_whitespace_as_suffix = bytes_, suffix
    for p in m.pieces if not bytes_ else ():
        if p.type == pieces.BYTE:
            p.type, p.piece = pieces.NORMAL, "no longer " + p.piece
    if users:
        for i in (300, 301, 302, 400, 1000):
            m.pieces[i].type = pieces.UNUSED
        for name in ("ab#", "#b s"):
            m.pieces.add(piece=name, score=0, type=pieces.USER_DEFINED)
    file = folder / f"{strip}{bytes_}{suffix}{users}.model"
    file.write_bytes(m.SerializeToString())
    return str(file)


def library(file):
    sp = sentencepiece.SentencePieceProcessor(model_file=file)

    def encode(text):
        got = sp.encode(text, return_type="proto").pieces
        return [p.id for p in got], [p.begin for p in got], [p.end for p in got]

    return sp, encode


def texts(n, seed=0):
    rng = random.Random(seed)
    return [*TRICKY, *("".join(rng.choices(ALPHABET, k=rng.randint(1, 40))) for _ in range(n))]


@pytest.mark.parametrize("changed", [None, *[(a, b, c, d) for a in (0, 1) for b in (0, 1) for c in (0, 1) for d in (0, 1)]])
def test_ids_and_offsets_equal_the_library(tmp_path, docs, changed):
    file = variant(tmp_path, *map(bool, changed)) if changed else MODEL
    sp, ref = library(file)
    enc = pieces.SentencePieces(file, cache=300)
    for t in [*texts(300), *(t for _, t in docs[:20])]:
        ids, begin, end = (x.tolist() for x in enc.encode(t))
        assert (ids, begin, end) == ref(t), t[:60]
        assert enc.decode(ids) == sp.decode(ids)
    rng = random.Random(1)
    for _ in range(300):
        ids = rng.choices([0, 1, 2, *range(3, 259), 300, 500, 28705, 28705], k=8)
        assert enc.decode(ids) == sp.decode(ids)


def test_long_words_and_equal_scores(docs):
    enc, (_, ref) = pieces.SentencePieces(MODEL), library(MODEL)
    rng = random.Random(0)
    for t in ("a" * 5000, "ab" * 3000, "".join(rng.choices("abcdefgh", k=6000)), " " * 900, "日" * 2000, "x" + " " * 300 + "y\n\n\n" * 200):
        assert tuple(x.tolist() for x in enc.encode(t)) == ref(t)
        assert enc._merge_queued(t[:20]) == enc._merge(t[:20])


def test_map_takes_the_longest_entry(tmp_path):
    enc = pieces.SentencePieces(variant(tmp_path, False, True, False, False))
    assert enc.map.longest("A\u0301x".encode(), 0) == (3, "\u00c1".encode()) and enc.map.longest(b"Ax", 0) is None
    data, src = enc.normalise("ﬁ x")
    assert data.decode() == "▁fi▁x" and src.tolist() == [0, 0, 0, 0, 0, 3, 3, 3, 4, 5]


def check_op11(rows, got):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    for d, t in rows:
        r, ids = by_id[d], sp.encode(t or "", add_eos=True)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_op11_equals_the_library(spark, sf, docs):
    check_op11(docs, queries.op11_piece_offsets(spark, sf).collect())


def test_op11_odd_input(spark):
    rows = [(None, None), (1, ""), (2, "x " * 40_000), *((i + 3, t) for i, t in enumerate(texts(60)))]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n_tokens", F.lit("x")).withColumn("ids", F.lit(1))
    got = pieces.encode_documents(df, MODEL, with_pieces=True).collect()
    check_op11(rows, got)
    for r in got:
        t = (dict(rows)[r["doc_id"]] or "").encode()
        spans = np.column_stack([r["begins"], r["ends"]]).astype("<u4")
        assert r["spans_crc32"] == zlib.crc32(spans.tobytes()) and r["begins"][-1] == r["ends"][-1] == len(t)
        assert b"".join(t[a:b] for a, b in spans.tolist()) == t  # this model keeps every byte
    assert pieces.encode_documents(df.limit(0), MODEL).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c")], SCHEMA)
    assert sorted(r["n_tokens"] for r in pieces.encode_documents(twice, MODEL).collect()) == [2, 3, 3]


def plain_alignment(rows):
    """Every A token against every B token, by the libraries' own calls."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    letters = {c: b for b, c in byte_letters().items()}
    a_bytes = lambda i: bytes(letters[c] for c in t.id_to_token(i))
    b_bytes = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    made, n_docs = [], Counter()
    for d, text in rows:
        want = b" " + (text or "").encode()
        a = t.encode(" " + (text or ""), add_special_tokens=False).ids
        b = sp.encode(text or "")
        if not text or b"".join(map(a_bytes, a)) != want or b"".join(map(b_bytes, b)) != want:
            a, b = [], []
        spans = [[(sum(map(len, x[:i])), sum(map(len, x[: i + 1]))) for i in range(len(x))] for x in (list(map(a_bytes, a)), list(map(b_bytes, b)))]
        links = [(a[i], b[j]) for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if s < v and u < e]
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, (s, e) in zip(x, sp_) if low < e <= cut) for x, sp_ in zip((a, b), spans)))
            low = cut
        made.append((d, len(a), len(b), len(groups), links, ";".join(groups)))
        n_docs.update(set(links))
    best = defaultdict(int)
    for (a, _), n in n_docs.items():
        best[a] = max(best[a], n)
    return [(d, na, nb, ng, len(ls), sum(n_docs[x] == best[x[0]] for x in ls), sum(n_docs[x] for x in ls), hashlib.sha256(g.encode()).hexdigest() if g else "") for d, na, nb, ng, ls, g in made]


def aligned(df, **how):
    got = align.align_documents(df, vocabulary("byte_bpe_50k.json"), MODEL, **how)
    assert got.columns == [c.split()[0] for c in align._ROWS.split(", ")]
    return sorted(map(tuple, got.collect()), key=str)


def test_op12_equals_all_against_all(spark, sf, docs):
    some = [(d, t) for d, t in docs if len(t) < 1500][:60]
    rows = [*some, (None, "the  end"), (10**6, None), (10**6 + 1, ""), *((10**7 + i, t) for i, t in enumerate(texts(80)) if len(t) < 400), (5, "see <|endoftext|> here"), (5, "see <|endoftext|> here")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("links", F.lit(1)).withColumn("pair", F.lit("x")).repartition(5)
    assert aligned(df) == sorted(plain_alignment(rows), key=str)
    assert aligned(df, sent=10) == aligned(df) and aligned(df.limit(0), sent=-1) == []  # counts that go back by a join
    assert any(r[1] == 0 for r in aligned(df)) and aligned(df.limit(0)) == []


def test_op12_batches_do_not_change_counts(spark, sf, docs):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    df = spark.createDataFrame(docs[:80], SCHEMA).repartition(3)
    once, before = aligned(df), spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        assert aligned(df) == once
    finally:
        spark.conf.set(key, before)


def test_op12_long_text_and_whole_table(spark, sf, docs):
    got = {r["doc_id"]: r for r in queries.op12_token_alignment(spark, sf).collect()}
    assert len(got) == len(docs)
    for d, t in docs:
        r = got[d]
        assert r["n_links"] == r["n_a"] + r["n_b"] - r["n_groups"] and r["n_best"] <= r["n_links"] <= r["count_sum"]
    long = aligned(spark.createDataFrame([(1, "ab cd\n" * 30_000)], SCHEMA))[0]
    assert long[4] == long[1] + long[2] - long[3] and long[6] == long[4]


def test_op12_rows_grow_with_pairs_not_links(spark):
    """A text that repeats itself has few pairs, each with the number of its links."""
    df = spark.createDataFrame([(1, "ab cd\n" * 30_000), (2, "ab"), (3, None)], SCHEMA).coalesce(1)
    rows = align.link_batches(df, vocabulary("byte_bpe_50k.json"), MODEL)
    lists = [c for c, kind in rows.dtypes if kind.startswith("array")]
    (row,) = rows.collect()
    assert row["doc_ids"] == [1, 2, 3] and row["n_a"][0] > 30_000
    assert all(len(row[c]) < 50 for c in lists)
    assert sum(row["times"]) == sum(row["n_links"]) == sum(row["n_a"]) + sum(row["n_b"]) - sum(row["n_groups"])
    assert aligned(df, sent=-1) == aligned(df)


def test_op12_reads_few_wide_rows_at_once(spark, docs, monkeypatch):
    """Neither the reader nor an aggregate gathers all rows of a file or many batches' lists."""
    key, seen = "spark.sql.parquet.columnarReaderBatchSize", {}
    before, save = spark.conf.get(key), align.save

    def watched(df, name):
        seen[name] = int(spark.conf.get(key)), df._jdf.queryExecution().executedPlan().toString()
        return save(df, name)

    monkeypatch.setattr(align, "save", watched)
    df = spark.createDataFrame(docs[:20], SCHEMA).repartition(3)
    for how in ({}, {"sent": -1}):
        aligned(df, **how)
        assert all(seen[name][0] <= 16 for name in ("aligned-counts", "aligned-documents"))
        assert "ObjectHashAggregate" not in seen["aligned-documents"][1] and spark.conf.get(key) == before
    assert "collect_list" in seen["aligned-documents"][1]
