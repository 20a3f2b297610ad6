"""Fingerprints, near-copies, vectors, components."""

import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from populace.llm import buckets, common, queries, simhash, substring, suffix, vectors

SCHEMA = "doc_id long, text string"


def least_labels(adj, ids):
    lab = list(ids)
    while True:
        new = [min([lab[j] for j in np.flatnonzero(adj[i])] + [lab[i]]) for i in range(len(ids))]
        if new == lab:
            return lab
        lab = new


@pytest.mark.parametrize("n,m,seed", [(1, 0, 0), (30, 20, 1), (200, 150, 2), (300, 700, 3)])
def test_components_match_union_find(spark, n, m, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(n) - 5, rng.randrange(n) - 5) for _ in range(m)] + [(i, i + 1) for i in range(400, 430)] * (seed > 0)
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    touched = {v for a, b in edges if a != b for v in (a, b)}
    for few in (0, common.FEW_EDGES):
        got = dict(common.components(spark.createDataFrame(edges, "a long, b long"), few=few).collect())
        assert got == {v: find(v) for v in touched}


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=5))
def test_near_fingerprints_share_a_segment_variant(fp, flips):
    other = fp
    for b in flips:
        other ^= 1 << b
    near = [((fp ^ other) >> low & (1 << bits) - 1).bit_count() for low, bits in simhash.segments(5)]
    assert len(near) == 3 and min(near) <= 1
    assert sum(bits for _, bits in simhash.segments(7)) == 64 and len(simhash.segments(7)) == 4


def test_variant_keys_are_equal_for_one_bit(spark):
    a, b = 0x0123456789ABCDEF, 0x0123456789ABCDEF ^ (1 << 30)
    keys = [set(r[0]) for r in spark.createDataFrame([(a,), (b,)], "fp long").select(simhash.variant_keys(F.col("fp"), 4)).collect()]
    assert keys[0] & keys[1] and len(keys[0]) == 64


def slow_fingerprint(text, width):
    import re

    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + width]).encode(), 42) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aBÀ é\n\t.\x0b\x1c ", max_size=60))
def test_fingerprint_is_the_majority(text):
    assert simhash.fingerprint(text, 4) == slow_fingerprint(text, 4)


def check_links(rows, got):
    fp = [slow_fingerprint(t, 4) for _, t in rows]
    adj = np.array([[(a ^ b).bit_count() <= 4 for b in fp] for a in fp])
    want = least_labels(adj, [d for d, _ in rows])
    assert {r["doc_id"]: (r["fp"] & 2**64 - 1, r["component_id"]) for r in got} == {d: (f, c) for (d, _), f, c in zip(rows, fp, want)}


def test_op2_matches_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = simhash.link(spark.createDataFrame(rows, SCHEMA), 4, 4).collect()
    check_links(rows, got)
    q = {r["doc_id"]: r for r in queries.op2_simhash_variants(spark, sf).collect()}
    assert all(q[r["doc_id"]]["fingerprint"] == f"{r['fp'] & 2**64 - 1:016x}" and q[r["doc_id"]]["component_id"] == r["component_id"] for r in got)


def test_op2_large_key_groups(spark):
    """Many fingerprints of few bits: keys of more than five ids, linked in chains."""
    rng = random.Random(5)
    fps = sorted({sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) - (1 << 63) for _ in range(300)} | {(1 << 40) - 1, ((1 << 40) - 1) ^ 31})
    got = dict(simhash.fingerprint_components(spark.createDataFrame([(f,) for f in fps], "fp long"), 4).collect())
    u = [f & 2**64 - 1 for f in fps]
    adj = np.array([[(a ^ b).bit_count() <= 4 for b in u] for a in u])
    want = least_labels(adj, fps)
    assert {f: got.get(f, f) for f in fps} == dict(zip(fps, want))


@pytest.mark.parametrize("refine,block,chunk", [(512, 256, 500_000), (40, 16, 90), (10**9, 7, 1000)])
def test_op2_hot_keys_in_blocks_and_refined(spark, refine, block, chunk):
    """Keys with hundreds of fingerprints that aren't all linked, over small chunks and blocks."""
    rng = random.Random(8)
    base = rng.getrandbits(63)
    fps = {base}
    for _ in range(700):  # one segment in common: the other bits at random, or few of them
        v = (base & (1 << 21) - 1) | rng.getrandbits(42) << 21 if rng.random() < 0.5 else base
        for b in rng.sample(range(63), rng.randrange(9)):
            v ^= 1 << b
        fps.add(v)
    fps = sorted(fps)
    got = dict(simhash.fingerprint_components(spark.createDataFrame([(f,) for f in fps], "fp long"), 4, refine=refine, block=block, chunk=chunk).collect())
    u = np.array(fps, np.uint64)
    adj = np.bitwise_count(u[:, None] ^ u[None, :]) <= 4
    assert {f: got.get(f, f) for f in fps} == dict(zip(fps, least_labels(adj, fps)))


def test_finer_keys_hold_every_pair(spark):
    """Of two fingerprints of a key, the finer keys share one again."""
    rng = random.Random(3)
    rows = []
    for i in range(300):
        v = rng.getrandbits(63)
        other = v
        for b in rng.sample(range(63), rng.randrange(5)):
            other ^= 1 << b
        rows += [(i, 0, v), (i, 1, other)]
    k = spark.createDataFrame(rows, "i long, side int, fp long").select("i", "side", "fp", F.explode(simhash.variant_keys(F.col("fp"), 4)).alias("k"))
    k = k.select("i", "side", F.explode(simhash.finer_keys(4)(F.col("k"), F.col("fp"))).alias("k")).distinct()
    assert k.groupBy("i", "k").count().where("count > 1").select("i").distinct().count() == 300


def test_similar_block_is_exact():
    rng = random.Random(2)
    sets = [np.unique(np.array([rng.randrange(60) for _ in range(rng.randrange(1, 80))], np.uint64)) for _ in range(60)]
    want = [[len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) for b in sets[25:]] for a in sets[:25]]
    assert substring.similar_block(sets[:25], sets[25:]).tolist() == want


def test_unlike_group_makes_no_pairs(spark):
    """A large group under the limit: each text is compared with all, and none is linked."""
    rng = random.Random(6)
    base = [f"b{i}" for i in range(100)]
    rows = [(i, edited(base, rng, 5)) for i in range(400)] + [(1000, " ".join(base[:99]))] + [(2000 + i, edited(base[:99], rng, 1)) for i in range(60)]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows]
    adj = np.array([[len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets])
    got = dict(simhash.near_copies(spark.createDataFrame(rows, SCHEMA)).collect())
    want = dict(zip([i for i, _ in rows], least_labels(adj, [i for i, _ in rows])))
    assert sum(got[i] == want[i] for i in got) >= 0.97 * len(got) and all(got[i] >= want[i] for i in got)


def test_equal_hashes_keep_both_texts(spark):
    """Texts whose 64-bit hashes are all equal stay apart."""
    rng = random.Random(7)
    rows = [(i, " ".join(words(rng, 60))) for i in range(6)] + [(10, None), (11, "")]
    rows += [(20, rows[0][1])]
    df = spark.createDataFrame(rows, SCHEMA)
    same = lambda c: F.lit(5).cast("long")
    near = dict(simhash.near_copies(df, hash_of=same).collect())
    assert near == {**{i: i for i in range(6)}, 10: 10, 11: 10, 20: 0}
    left = {r["doc_id"]: r["text"] for r in substring.cut(df, hash_of=same).select("doc.doc_id", "text").collect()}
    assert left == {**dict(rows), 20: ""}
    kept = simhash.without_near_copies(df.withColumn("uid", F.lit("u")), hash_of=same)
    assert kept.columns == ["doc_id", "text", "uid"] and sorted(r["doc_id"] for r in kept.collect()) == [*range(6), 10]
    odd = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (1, "c")], SCHEMA)
    assert sorted((str(r["doc_id"]), r["text"]) for r in simhash.without_near_copies(odd).collect()) == [("1", "c"), ("None", "a b")]
    assert simhash.without_near_copies(odd.limit(0)).count() == 0


def test_op2_nulls_copies_and_empties(spark):
    rows = [(5, None), (3, ""), (9, " \n"), (1, "one two three four five"), (7, "ONE two three four five"), (8, "z")]
    check_links(rows, simhash.link(spark.createDataFrame(rows, SCHEMA), 4, 4).collect())
    assert simhash.link(spark.createDataFrame([], SCHEMA), 4, 4).count() == 0
    again = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, "q")], SCHEMA).withColumn("fp", F.lit("x")).withColumn("k", F.lit(0))
    out = simhash.link(again, 4, 4).collect()
    assert len(out) == 4 and sum(r["component_id"] == 1 for r in out) == 3


def edited(words, rng, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return " ".join(out)


def test_near_copies_by_similarity(spark):
    rng = random.Random(1)
    bases = [[f"b{k}x{rng.randrange(10**6)}" for _ in range(200)] for k in range(6)]
    rows = [(i * 10 + j, edited(b, rng, j)) for i, b in enumerate(bases) for j in range(4)] + [(1000 + i, edited(bases[0], rng, 120)) for i in range(3)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i * 10 + j] == i * 10 for i in range(6) for j in range(4))
    assert all(got[1000 + i] == 1000 + i for i in range(3))


def test_near_copies_finds_all_pairs_at_the_limit(spark):
    """Against all pairs: of texts at 0.8 to 0.9, next to none is missed."""
    rng = random.Random(12)
    rows, alike = [(-1, None), (-2, "two words"), (-3, "Two  words")], set()
    for k in range(400):
        base = [f"b{k}x{rng.randrange(10**6)}" for _ in range(rng.choice((80, 200, 500)))]
        copy = edited(base, rng, round(len(base) * rng.uniform(0.01, 0.025))).split()
        s, t = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (base, copy))
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        if len(s & t) >= 0.8 * len(s | t):
            alike.add(k)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    linked = {k for k in range(400) if got[2 * k + 1] == 2 * k}
    assert len(alike) > 150 and linked <= alike and len(linked) >= 0.99 * len(alike)
    assert got[-1] == -1 and got[-2] == -3


def brute_vectors(rows):
    ids = [i for i, _ in rows]
    ok = [v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    adj = np.zeros((len(rows), len(rows)), bool)
    for i in range(len(rows)):
        for j in range(len(rows)):
            if i != j and ok[i] and ok[j]:
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                adj[i, j] = a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.9
    return adj.sum(1), least_labels(adj, ids)


@pytest.mark.parametrize("block", [20, 2000])
def test_op4_matches_brute_force(spark, block):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 16))
    data = [c + rng.normal(scale=0.15, size=16) for c in centres for _ in range(12)] + [centres[0]] * 30 + [2 * centres[1]] * 3
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.array(data, np.float32))]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [None] + [1.0] * 15), (904, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("n", F.lit(1)).withColumn("cid", F.lit("x"))
    got = {r["vec_id"]: r for r in vectors.link(df, block=block).collect()}
    n, comp = brute_vectors(rows)
    found = sum(got[i]["n_links"] for i, _ in rows)
    assert found >= 0.9 * n.sum() and all(got[i]["n_links"] <= k for (i, _), k in zip(rows, n))
    if found == n.sum():
        assert [got[i]["component_id"] for i, _ in rows] == comp
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in range(900, 905))


def test_op4_sql_counts_links(tmp_path):
    """The tables have no vectors at cosine 0.9, so the SQL is tried on some that do."""
    import duckdb

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 16))
    rows = [(i, [float(x) for x in c + rng.normal(scale=0.15, size=16)]) for i, c in enumerate(np.repeat(centres, 8, axis=0))]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [None] + [1.0] * 15), (904, [1.0] * 3)]
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding float[])")
    con.executemany("insert into embeddings values (?, ?)", rows)
    held = con.execute("select vec_id, embedding from embeddings order by 1").fetchall()
    n, comp = brute_vectors([(i, v if v is None or len(v) == 16 else None) for i, v in held])
    got = con.execute(queries.oracle_sql()["op4_pivot_permutation"] + " ORDER BY 1").fetchall()
    assert n.sum() > 100
    assert got == [(i, k, c, i == c) for (i, _), k, c in zip(held, n.tolist(), comp)]


def test_op4_matches_sql(spark, sf, duck):
    from ..oracle import same_rows

    same_rows(queries.op4_pivot_permutation(spark, sf), duck, queries.oracle_sql()["op4_pivot_permutation"])


def test_op4_recall_on_the_given_vectors(spark, sf):
    d = pd.DataFrame([tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()], columns=["vec_id", "v"])
    x = np.array(d["v"].tolist(), float)
    noisy = np.concatenate([x, x + np.random.default_rng(1).normal(scale=0.35 * x.std(), size=x.shape)])
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(noisy)]
    got = vectors.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    u = noisy / np.linalg.norm(noisy, axis=1, keepdims=True)
    true = int((u @ u.T >= 0.9).sum() - len(u))
    assert true > 300 and got.agg(F.sum("n_links")).first()[0] >= 0.9 * true


@pytest.mark.parametrize("spread", [0.2, 0.3, 0.36])
def test_op4_recall_with_a_dense_group(spark, spread):
    """A third of all vectors in one group of unequal near copies."""
    rng = np.random.default_rng(4)
    centre = rng.normal(size=64)
    x = np.concatenate([rng.normal(size=(4000, 64)), centre + spread * rng.normal(size=(2000, 64))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = vectors.link(df).toPandas().set_index("vec_id")["n_links"].sort_index()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = (u @ u.T >= 0.9).sum(1) - 1
    assert true.sum() > 5000 and got.sum() >= 0.9 * true.sum() and (got.to_numpy() <= true).all()


def test_op4_all_in_one_group(spark):
    x = np.random.default_rng(5).normal(size=16) + 0.1 * np.random.default_rng(6).normal(size=(200, 16))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = vectors.link(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    assert got.agg(F.sum("n_links")).first()[0] == (u @ u.T >= 0.9).sum() - 200


def test_op4_lists_of_two_pivots(spark):
    """Lists beyond SPLIT blocks are dealt by pairs of pivots: the same links, each counted once."""
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(500, 24)), rng.normal(size=24) + 0.25 * rng.normal(size=(250, 24))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    plain, dealt = (vectors.link(df, **how).toPandas().sort_values("vec_id") for how in ({}, {"block": 10, "split": 1}))
    assert plain["n_links"].sum() > 2000
    for c in ("n_links", "component_id", "kept"):
        assert (plain[c].to_numpy() == dealt[c].to_numpy()).all()


def test_op4_repeated_and_null_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [2.0, 0.0]), (5, [0.0, 1.0]), (6, [0.0, 1.0, 2.0])]
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in vectors.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [("1", 2, "None", False), ("1", 2, "None", False), ("5", 0, "5", True), ("6", 0, "6", True), ("None", 2, "None", True)]


def test_op4_empty(spark):
    assert vectors.link(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def words(rng, n):
    return [f"{rng.choice('bcdfg')}{rng.randrange(10**5)}" for _ in range(n)]


def test_op9_cuts_copies_and_passages(spark):
    rng = random.Random(3)
    para, passage = words(rng, 60), words(rng, 55)
    near = list(para)
    near[30] = "changed"
    clean = [(100 + i, " ".join(words(rng, 80)) + "\n" + " ".join(words(rng, 40))) for i in range(10)]
    rows = [
        (1, " ".join(para)),
        (2, "short line\n" + " ".join(near)),
        (3, " ".join([*words(rng, 30), *passage, *words(rng, 30)])),
        (4, " ".join([*words(rng, 25), *passage, *words(rng, 35)])),
        (5, " ".join(para)),
        (6, None),
        (7, ""),
        (8, " ".join(["again"] * 200)),
        (9, "license words\n" * 3),
        *clean,
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"n_removed": F.lit("own"), "uid": F.lit(1), "doc": F.lit(2)})
    got = {r["doc_id"]: r for r in substring.cut_documents(df).collect()}
    text = dict(rows)
    assert got[1]["text"] == text[1] and got[5]["text"] == "" and got[2]["text"] == "short line\n"
    assert got[3]["text"] == text[3] and " ".join(passage) not in got[4]["text"]
    assert got[4]["text"].split() == [w for w in text[4].split() if w not in set(passage)]
    assert got[6]["text"] is None and got[7]["text"] == ""
    assert all(got[i]["text"] == t and got[i]["n_removed"] == 0 for i, t in clean) and got[9]["n_removed"] == 0
    assert all(len(t or "") - len(got[i]["text"] or "") == got[i]["n_removed"] for i, t in rows)
    assert got[1]["uid"] == 1


def test_op9_passage_in_several_versions(spark):
    """Later documents repeat each other where the first one has another version, or a phrase of it."""
    rng = random.Random(21)
    rows, around = [], {}
    for k in range(60):
        passage = words(rng, rng.randrange(52, 61))
        changed = list(passage)
        changed[len(passage) // 2] = "changed"
        phrase = passage[20 : 20 + rng.randrange(8, 30)]
        for j, part in enumerate([changed, phrase, passage, passage, passage]):
            head, tail = words(rng, 40), words(rng, 40)
            rows.append((10 * k + j, " ".join([*head, *part, *tail])))
            around[10 * k + j] = head + tail
    got = {r["doc_id"]: r["text"] or "" for r in substring.cut_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    text = dict(rows)
    assert all(got[i] == text[i] for i in text if i % 10 < 2)
    assert not [i for i in text if i % 10 > 2 and got[i].split() != around[i]]


def test_op9_leaves_no_repeat_of_fifty_words(spark, sf):
    out = sorted((r["doc_id"], r["text"]) for r in queries.op9_paragraph_minhash(spark, sf).collect())
    seen = {}
    for i, t in out:
        w = t.lower().split()
        for k in range(len(w) - 49):
            assert seen.setdefault(tuple(w[k : k + 50]), i) == i


def test_op9_near_paragraphs_by_exact_similarity(spark):
    """Against all pairs: every pair of paragraphs at 0.8 or more is linked, none below it."""
    rng = random.Random(9)
    texts = []
    for _ in range(8):
        base = words(rng, 50)
        for k in (0, 1, 2, 3, 6):
            t = list(base)
            for j in rng.sample(range(50), k):
                t[j] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(t))
    s = [substring.shingles(substring.word_hashes(t)) for t in texts]
    adj = np.array([[len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) for b in s] for a in s])
    got = dict(substring.paragraph_roots(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "pid long, words string, n long")).collect())
    assert [got.get(i, i) for i in range(len(texts))] == least_labels(adj, range(len(texts)))


def test_long_texts_nulls_and_repeats(spark):
    """A text of 150,000 words, null ids and repeated rows, in fingerprints and passages."""
    rng = random.Random(11)
    long = words(rng, 150_000)
    rows = [(1, " ".join(long)), (2, " ".join([*long[:70_000], "x", *long[70_001:]])), (None, " ".join(words(rng, 45))), (4, " ".join(words(rng, 90))), (5, " ".join([*words(rng, 40), *long[500:560]]))]
    rows += [rows[3]]
    df = spark.createDataFrame(rows, SCHEMA)
    check_links([(d if d is not None else -1, t) for d, t in rows], [r.asDict() | {"doc_id": -1 if r["doc_id"] is None else r["doc_id"], "component_id": -1 if r["component_id"] is None else r["component_id"]} for r in simhash.link(df, 4, 4).collect()])
    got = [(r["doc_id"], r["n_removed"], r["text"]) for r in substring.cut_documents(df).collect()]
    by = {d: (n, t) for d, n, t in got}
    assert by[1][0] == 0 and by[None][0] == 0 and len(by[2][1].split()) < 70 and len(by[5][1].split()) == 40
    assert len(got) == 6 and [n for d, n, _ in got if d == 4] == [0, 0]


def test_op9_empty_table(spark):
    assert substring.cut_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_perhaps_lists_all_wanted_and_few_others(spark, monkeypatch):
    rows = spark.range(-5000, 5000).selectExpr("if(id = 0, null, id) as id", "string(id) as words")
    wanted = spark.range(0, 5000, 100).selectExpr("id as other")
    found = {r.id for r in common.perhaps(rows, "id", wanted).where("listed").collect()}
    assert found >= set(range(100, 5000, 100)) and len(found) < 60
    assert common.perhaps(rows, "id", wanted).where("not listed").count() + len(found) >= 9999
    assert not common.perhaps(rows, "id", wanted.limit(0)).where("listed").count()
    monkeypatch.setattr(common, "FILTER_BITS", 64)  # a full filter costs rows, never results
    assert common.perhaps(rows, "id", wanted).where("listed").count() > 1000


def moved_texts(df):
    """The most rows with a text that one exchange of the plan that ran has."""
    df.collect()
    plan, most = df._jdf.queryExecution().executedPlan().finalPhysicalPlan(), 0
    todo = [plan]
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
        if node.nodeName() == "Exchange" and any(c in node.output().mkString(",") for c in ("text#", "doc#")):
            most = max(most, node.metrics().apply("shuffleRecordsWritten").value())
    return most


@pytest.mark.parametrize("stage", ["near", "spans"])
def test_rows_that_stay_are_not_shuffled(spark, stage):
    """Before, the final joins dealt every text anew once the list was too long to be sent."""
    docs = spark.range(400).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 40), i -> sha(concat(if(id % 100 = 1, id - 1, id), '-', i)))) as text")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        if stage == "near":
            out = simhash.without_near_copies(docs)
            assert moved_texts(out) <= 40
            assert {r.doc_id for r in out.collect()} == set(range(400)) - {1, 101, 201, 301}
        else:
            out = suffix.remove(docs)
            assert moved_texts(out) <= 40
            assert {r.doc_id for r in out.collect() if r.n_removed} == {1, 101, 201, 301}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("n", [300, 1200])
def test_near_copies_of_a_group_are_settled_in_their_keys(spark, n):
    """Before, each of the group's index rows was held back and joined with its component."""
    rng = random.Random(n)
    marginal = rng.sample(range(64), 14)
    fps = {0, *(sum(1 << b for b in rng.sample(marginal, rng.randint(1, 4))) for _ in range(8 * n))}
    fps = sorted(fps)[:n]
    frame = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    source = simhash.fingerprint_source(frame, 4)
    one_key = source.index.groupBy("k").count().agg(F.max("count")).first()[0]
    held = buckets._sweep(source, buckets.LAGS, buckets.CHUNK, buckets.BLOCK).where("k is not null").count()
    assert source.index.count() == 64 * len(fps) and held <= 8 * one_key  # the edges of 4 tasks
    roots = simhash.fingerprint_components(frame, 4).collect()
    assert len(roots) == len(fps) and {r.root for r in roots} == {min(r.node for r in roots)}


@pytest.mark.parametrize("block", [2, 8, 64])
def test_components_inside_keys_equal_all_pairs(block):
    rng = np.random.default_rng(block)
    run = np.sort(rng.integers(0, 6, 150))
    base = rng.integers(0, 2**40, 3)
    x = base[rng.integers(0, 3, 150)] ^ (np.int64(1) << rng.integers(0, 40, 150)) ^ (np.int64(1) << rng.integers(0, 40, 150))
    low, unknown = buckets._joined(run, x, 3, block)
    near = (np.bitwise_count((x[:, None] ^ x[None, :]).view(np.uint64)) <= 3) & (run[:, None] == run[None, :])
    want = np.array(least_labels(near, range(150)))
    assert (low[~unknown] == want[~unknown]).all() and (want[low] == want).all()
    assert block < 64 or not unknown.any()
